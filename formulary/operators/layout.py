"""Words, lines and boxes of recognised pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import has_trigger, let, strip


def lines_of_words(words: DataFrame, keys: tuple[str, ...] = ("doc_id", "page", "block_num", "par_num", "line_num")) -> DataFrame:
    """A row a line: its words in order, their text, box (x0, y0, x1, y1) and mean confidence, where words
    without one (-1) count as 0, blank words included. Lines of blank words alone have no box and go."""
    t = strip(F.col("text"))
    word = F.when(t != "", F.struct("word_num", t.alias("text"), "left", "top", "width", "height"))
    on = lambda c: F.when(t != "", c)
    out = words.groupBy(*keys).agg(
        F.array_sort(F.collect_list(word)).alias("words"),
        F.avg(F.when(F.col("conf") < 0, 0.0).otherwise(F.coalesce(F.col("conf").cast("double"), F.lit(0.0)))).alias("mean_conf"),
        F.min(on(F.col("left"))).alias("x0"), F.min(on(F.col("top"))).alias("y0"), F.max(on(F.col("left") + F.col("width"))).alias("x1"), F.max(on(F.col("top") + F.col("height"))).alias("y1"),
    )
    return out.where(F.size("words") > 0).withColumn("line_text", F.array_join(F.transform("words", lambda w: w["text"]), " "))


def math_lines(lines: DataFrame, min_mean_conf: float = 30) -> DataFrame:
    """Lines confident enough of which a word, or else the text, has a trigger symbol."""
    return lines.where((F.col("mean_conf") >= min_mean_conf) & (F.exists("words", lambda w: has_trigger(w["text"])) | has_trigger(F.col("line_text"))))


def refined_box(words: Column, margin: int = 8, neighbors: int = 3) -> Column:
    """struct(x0, y0, x1, y1) around the words from ``neighbors`` before the first trigger word to as many
    after the last, by x, with a margin and not below 0. Without a trigger all words, without margin;
    without words zeros. Words are sorted by left, then by their own number."""
    sorted_words = F.array_sort(F.transform(words, lambda w: F.struct(w["left"].alias("left"), w["word_num"].alias("word_num"), w["top"].alias("top"), w["width"].alias("width"), w["height"].alias("height"), has_trigger(w["text"]).alias("hit"))))

    def chosen(ws: Column) -> Column:
        at = F.filter(F.transform(ws, lambda w, k: F.when(w["hit"], k)), lambda k: k.isNotNull())
        return let(at, lambda at: F.struct((F.size(at) > 0).alias("some"), F.when(F.size(at) > 0, F.slice(ws, F.greatest(F.array_min(at) - neighbors, F.lit(0)) + 1, F.array_max(at) - F.greatest(F.array_min(at) - neighbors, F.lit(0)) + neighbors + 1)).otherwise(ws).alias("ws")))

    def box(c: Column) -> Column:
        start = F.struct(F.lit(None).cast("int").alias("x0"), F.lit(None).cast("int").alias("y0"), F.lit(None).cast("int").alias("x1"), F.lit(None).cast("int").alias("y1"))
        grow = lambda a, w: F.struct(F.least(a["x0"], w["left"]).alias("x0"), F.least(a["y0"], w["top"]).alias("y0"), F.greatest(a["x1"], w["left"] + w["width"]).alias("x1"), F.greatest(a["y1"], w["top"] + w["height"]).alias("y1"))
        b, zero = F.aggregate(c["ws"], start, grow), F.lit(0)
        m = F.when(c["some"], margin).otherwise(0)
        low = lambda v: F.when(c["some"], F.greatest(v - margin, zero)).otherwise(v)
        return let(b, lambda b: F.struct(F.coalesce(low(b["x0"]), zero).alias("x0"), F.coalesce(low(b["y0"]), zero).alias("y0"), F.coalesce(b["x1"] + m, zero).alias("x1"), F.coalesce(b["y1"] + m, zero).alias("y1")))

    return let(let(sorted_words, chosen), box)


def merge_boxes(boxes: DataFrame, keys: tuple[str, ...] = ("doc_id", "page"), max_gap: float = 40) -> DataFrame:
    """Boxes of a page, from the top, then the left: one that overlaps the last (grown) box by over 0.3 of
    the lesser height, and lies less than ``max_gap`` behind and less than 20 before its end, joins it.
    A true fold over a page's boxes (hundreds), as a higher-order aggregate."""
    kind = "array<struct<y0:double,x0:double,x1:double,y1:double>>"
    d = lambda c: F.col(c).cast("double").alias(c)
    listed = boxes.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(d("y0"), d("x0"), d("x1"), d("y1")))).alias("b"))

    def step(done: Column, box: Column) -> Column:
        last = F.element_at(done, -1)
        least = F.least(last["y1"] - last["y0"], box["y1"] - box["y0"])
        overlap = F.greatest(F.lit(0.0), F.least(last["y1"], box["y1"]) - F.greatest(last["y0"], box["y0"]))
        gap = box["x0"] - last["x1"]
        joins = (F.size(done) > 0) & (least > 0) & (overlap > 0.3 * least) & (gap > -20) & (gap < max_gap)
        union = F.struct(F.least(last["y0"], box["y0"]).alias("y0"), F.least(last["x0"], box["x0"]).alias("x0"), F.greatest(last["x1"], box["x1"]).alias("x1"), F.greatest(last["y1"], box["y1"]).alias("y1"))
        return F.when(joins, F.array_append(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), union)).otherwise(F.array_append(done, box))

    folded = listed.select(*keys, F.posexplode(F.aggregate("b", F.array().cast(kind), step)).alias("box_no", "x"))
    return folded.select(*keys, "box_no", "x.x0", "x.y0", "x.x1", "x.y1")


def plausible_boxes(boxes: DataFrame, page_width: Column, zoom: float = 3.0) -> DataFrame:
    """Not wider than 0.9 of the page, and neither side below 20 pixels at ``zoom``."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return boxes.where((w <= page_width * 0.9) & (w >= 20 / zoom) & (h >= 20 / zoom))


def clipped(boxes: DataFrame, width: Column, height: Column, margin: int = 0) -> DataFrame:
    """Boxes grown by ``margin`` and clamped to the page; those left without area go."""
    zero = F.lit(0)
    out = boxes.withColumns({"x0": F.greatest(F.col("x0") - margin, zero), "y0": F.greatest(F.col("y0") - margin, zero), "x1": F.least(F.col("x1") + margin, width), "y1": F.least(F.col("y1") + margin, height)})
    return out.where("x1 > x0 and y1 > y0")
