"""Lines of documents: splitting, reading order, joining of broken lines, first occurrences.

Order is always carried in columns. Windows are per document, as lines join across its pages; a
document's lines go to one task, sorted and spillable, never to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_line, strip


def split_lines(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with line_no and line (stripped; blank ones go). Null text gives no rows."""
    kept = [c for c in df.columns if c not in ("line_no", "line")]
    return df.select(*kept, F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line")).withColumn("line", strip(F.col("line"))).where("line <> ''")


def reading_order(blocks: DataFrame, page_keys: tuple[str, ...] = ("doc_id", "page")) -> DataFrame:
    """Blocks (y0, x0, text, and kind and no where they are there) of text kind 0, with their rank by rows of ten
    units, then x0; of equal ones as the page has them (no)."""
    w = Window.partitionBy(*page_keys).orderBy(F.bround(F.col("y0") / 10), "x0", *(c for c in ("no", "text") if c in blocks.columns))
    texts = blocks.where("kind = 0") if "kind" in blocks.columns else blocks
    return texts.withColumn("block_no", F.row_number().over(w) - 1)


def digital_lines(pages: DataFrame, blocks: DataFrame, recognised: DataFrame, fallback: DataFrame | None = None, least_text: int = 50) -> DataFrame:
    """doc_id, line_no (in order), line: cleaned lines of pages (doc_id, page, text). A page whose text has ``least_text``
    characters gives its blocks (doc_id, page, no, y0, x0, text) in reading order, others what was recognised on
    them (doc_id, page, text). Documents that come out empty take ``fallback``'s lines of their pages (doc_id, page, text)."""
    own = pages.select("doc_id", "page", (F.length(strip(F.coalesce("text", F.lit("")))) >= least_text).alias("own"))
    by_block = reading_order(blocks.join(own.where("own"), ["doc_id", "page"], "left_semi")).select("doc_id", "page", F.col("block_no").cast("long").alias("block_no"), "text")
    by_page = recognised.join(own.where("not own"), ["doc_id", "page"], "left_semi").select("doc_id", "page", F.lit(0).cast("long").alias("block_no"), "text")

    def cleaned(parts: DataFrame) -> DataFrame:
        out = parts.select("doc_id", F.col("page").cast("long").alias("page"), "block_no", F.posexplode(F.split("text", "\n")).alias("k", "line"))
        place = F.struct("page", "block_no", F.col("k").cast("long").alias("k")).alias("line_no")
        return out.select("doc_id", place, clean_line(F.col("line")).alias("line")).where("line <> ''")

    found = cleaned(by_block.unionByName(by_page))
    if fallback is not None:
        found = found.unionByName(cleaned(fallback.select("doc_id", "page", F.lit(0).cast("long").alias("block_no"), "text")).join(found.select("doc_id").distinct(), "doc_id", "left_anti"))
    return found


def merge_broken_lines(lines: DataFrame, doc: str = "doc_id", order: tuple[str, ...] = ("line_no",), line: str = "line") -> DataFrame:
    """doc, line_no (of the first part) and line: a line joins the one before if that ends in an operator,
    or if it begins with one or with a lower-case letter. Lines are stripped and not empty, so adjacent
    pairs decide: breaks are counted up into islands."""
    w = Window.partitionBy(doc).orderBy(*order)
    before = F.lag(line).over(w)
    joins = before.rlike(r"[+\-*/=^,(\\]\z") | F.col(line).rlike(r"(?U)\A(?:[+\-*/^),]|\p{Lower})")
    marked = lines.withColumn("__new", F.when(before.isNull() | ~joins, 1).otherwise(0)).withColumn("__at", F.row_number().over(w))
    islands = marked.withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct("__at", F.col(line).alias("s"))))
    out = islands.groupBy(doc, "__island").agg(parts.alias("p"), F.min_by(order[-1], "__at").alias("line_no"))
    return out.select(doc, "line_no", F.array_join(F.transform("p", lambda x: x["s"]), " ").alias("line"))


def first_occurrences(df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """Of the rows that agree in ``keys`` the first by ``order``: a pre-aggregated minimum, so copies
    combine before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    lead = F.struct(*order, *(c for c in rest if c not in order))
    out = df.groupBy(*keys).agg(F.min(lead).alias("__x"))
    return out.select(*[c if c in keys else F.col(f"__x.{c}").alias(c) for c in df.columns])
