"""The whole ways through the library: records of a corpus, the balanced dataset, the corpus registry,
and candidates out of text. Each is a plan over DataFrames; providers stand in for optional libraries."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_line, file_name, is_math_latex, long_enough, math_text, normalize_latex, normalize_spaces, page_type, strip
from ..operators import corpus, dataset, extract, layout, lines, records
from ..sources import pdf


def typed_pages(pages: DataFrame) -> DataFrame:
    """``pages`` with text_char_count and page_type; a page without text counts 0 characters."""
    n = F.length(normalize_spaces(F.col("text")))
    pages = pages.where("page is not null")  # rows of errors have none
    return pages.withColumn("text_char_count", n).withColumn("page_type", page_type(F.col("text_char_count")))


def text_records(pages: DataFrame) -> DataFrame:
    """Records of the delimited formulas in the pages' text layers."""
    return records.text_layer_records(extract.text_layer_latex(pages.select("doc_id", "pdf_file", "page", "text")))


def cropped(image: bytes, x0: float, y0: float, x1: float, y1: float) -> bytes:
    """A part of an encoded image, by Pillow; the whole image without it."""
    if not pdf.capabilities()["PIL"]:
        return image
    import io

    from PIL import Image

    out = io.BytesIO()
    Image.open(io.BytesIO(image)).crop((int(x0), int(y0), int(x1), int(y1))).save(out, "PNG")
    return out.getvalue()


def with_crops(boxes: DataFrame, images: DataFrame, crop: Callable[..., bytes] = cropped) -> DataFrame:
    """``boxes`` (doc_id, page, x0, y0, x1, y1 in pixels) with image, their part of the page's. A page's boxes
    meet its image in one row, so an image moves once at most, and is cut there for all of them."""
    names = [c for c in boxes.columns if c != "image"]
    per_page = boxes.groupBy("doc_id", "page").agg(F.collect_list(F.struct(*names)).alias("boxes"))
    corners = F.transform("boxes", lambda b: F.array(*[b[c].cast("double") for c in ("x0", "y0", "x1", "y1")]))

    @F.pandas_udf("array<binary>")
    def cut(image: pd.Series, boxes: pd.Series) -> pd.Series:
        return pd.Series([[crop(bytes(i), *b) for b in bs] for i, bs in zip(image, boxes, strict=True)], dtype=object)

    page = images.select("doc_id", "page", F.col("image").alias("__page")).where("__page is not null")
    cuts = per_page.join(page, ["doc_id", "page"]).select("boxes", cut("__page", corners).alias("cuts"))
    one = cuts.select(F.explode(F.arrays_zip("boxes", "cuts")).alias("x"))
    return one.select(*(F.col(f"x.boxes.{c}").alias(c) for c in names), F.col("x.cuts").alias("image"))


def recognised_records(pages: DataFrame, words: DataFrame, min_mean_conf: float = 30, text_poor_only: bool = False, load: Callable = pdf.pix2tex, crop: Callable = cropped) -> DataFrame:
    """Records of the mathematical lines of page images: words to lines, confident lines with a trigger,
    their refined boxes, crops, recognition; what isn't mathematics goes. With ``text_poor_only`` only
    scanned and mixed pages are looked at."""
    gated = typed_pages(pages)
    if text_poor_only:
        gated = gated.where(F.col("page_type").isin("scanned", "mixed"))
    found = layout.math_lines(layout.lines_of_words(words), min_mean_conf)
    found = found.withColumn("b", layout.refined_box(F.col("words"))).select("doc_id", "page", F.col("line_text").alias("line_text_ocr"), "mean_conf", "b.*").where("x1 > x0 and y1 > y0")
    crops = with_crops(found.join(gated.select("doc_id", "page", "pdf_file"), ["doc_id", "page"]), pages, crop)
    read = pdf.recognised(crops, load).drop("image")
    return records.ocr_records(read.where(is_math_latex(normalize_latex(F.col("latex_raw")))))


def visual_candidates(pages: DataFrame, boxes: DataFrame, words: DataFrame, load: Callable = pdf.pix2tex, crop: Callable = cropped, zoom: float = 3.0) -> DataFrame:
    """text, latex, source of the regions of page images that look like formulas: boxes are merged along
    lines and gated by size, the words within 2 units decide whether they are mathematics, and their crops
    (5 units wider) are recognised; formulas of at most two characters go. Words are in page units."""
    kept = layout.plausible_boxes(layout.merge_boxes(boxes).join(pages.select("doc_id", "page", "page_width", "page_height"), ["doc_id", "page"]), F.col("page_width"), zoom)
    w = words.select("doc_id", "page", "word_num", F.col("text").alias("w"), "left", "top", "width", "height")
    middle_x, middle_y = F.col("left") + F.col("width") / 2, F.col("top") + F.col("height") / 2
    inside = middle_x.between(F.col("x0") - 2, F.col("x1") + 2) & middle_y.between(F.col("y0") - 2, F.col("y1") + 2)
    keys = ["doc_id", "page", "box_no", "x0", "y0", "x1", "y1", "page_width", "page_height"]
    texts = kept.join(w, ["doc_id", "page"]).where(inside).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("top", "left", "word_num", "w"))).alias("ws"))
    texts = texts.withColumn("text", F.array_join(F.transform("ws", lambda x: x["w"]), " ")).drop("ws").where(math_text(F.col("text"))["is_math"])
    clipped = layout.clipped(texts, F.col("page_width"), F.col("page_height"), 5)
    pixels = clipped.withColumns({c: F.col(c) * zoom for c in ("x0", "y0", "x1", "y1")})
    read = pdf.recognised(with_crops(pixels, pages, crop), load).where(long_enough(F.col("latex_raw")))
    return read.select(strip(F.col("text")).alias("text"), F.col("latex_raw").alias("latex"), F.col("doc_id").alias("source"), F.concat_ws("|", "doc_id", "page", "box_no").alias("key"))


def build_dataset(candidates: DataFrame, per_class: int = 100, seed: int = 42) -> DataFrame:
    """The balanced, validated dataset of candidates (text, latex, source, key); without any it is
    synthetic throughout."""
    return dataset.validate(dataset.balance(dataset.classify(candidates), per_class, seed))


def recognised_pages(pages: DataFrame, read: Callable = pdf.tesseract_words, prepare: Callable | None = None, load: Callable = pdf.pix2tex, crop: Callable = cropped, **settings: float) -> DataFrame:
    """Records of page images from the beginning: scanned and mixed pages' images are enhanced, words are read on all,
    and ``recognised_records`` goes on from them."""
    ready = pdf.enhanced(typed_pages(pages), prepare)
    return recognised_records(ready.select(*pages.columns), pdf.words(ready, read), load=load, crop=crop, **settings)


def update_corpus(files: DataFrame, registry: DataFrame, force: bool = False, added_at: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(judged files with status, registry rows of the accepted ones). Files may have a url; ``added_at`` is a parameter, so
    that a run can be repeated."""
    judged = corpus.admit(files, registry, force)
    url = F.coalesce("url", F.lit("")) if "url" in files.columns else F.lit("")
    size = F.bround(F.col("size") / (1 << 20), 2)
    return judged, judged.where("status = 'accepted'").select("name", F.col("md5").alias("hash"), F.lit(added_at).alias("added_at"), size.alias("size_mb"), url.alias("url"))


def fetched(urls: DataFrame, fetch: Callable[[str], bytes]) -> DataFrame:
    """Files (path, name, md5, size, content, url) of URLs, by a function that fetches one; what fails or isn't
    a PDF goes. The path is the URL, which ``update_corpus`` takes for its order."""

    @F.pandas_udf("binary")
    def get(s: pd.Series) -> pd.Series:
        def one(url: str | None) -> bytes | None:
            try:
                return fetch(url) if url else None
            except Exception:  # noqa: BLE001
                return None

        return s.map(one)

    got = urls.select("url", file_name(F.col("url")).alias("name"), get.asNondeterministic()("url").alias("content")).where(corpus.is_pdf(F.col("content")))
    return got.select(F.col("url").alias("path"), "name", F.md5("content").alias("md5"), F.octet_length("content").cast("long").alias("size"), "content", "url")


def _deduplicated(lines_in: DataFrame, passes: int) -> DataFrame:
    found = extract.candidates(lines.merge_broken_lines(lines_in), passes=passes)
    return lines.first_occurrences(found.select("doc_id", "text", "line_no", "ord"), ("doc_id", "text"), ("line_no", "ord"))


def text_candidates(pages: DataFrame, ocr: bool = False) -> DataFrame:
    """doc_id, text: the distinct candidates of each document, out of its lines joined across pages. Lines of the
    digital route are cleaned, and candidates normalised twice; those of recognised texts (``ocr``) are only stripped."""
    split = lines.split_lines(pages.where("page is not null").select("doc_id", "page", "text"))
    if not ocr:
        split = split.withColumn("line", clean_line(F.col("line"))).where("line <> ''")
    numbered = split.select("doc_id", (F.col("page").cast("long") * (1 << 32) + F.col("line_no")).alias("line_no"), "line")
    return _deduplicated(numbered, 1 if ocr else 2)


def digital_candidates(pages: DataFrame, blocks: DataFrame, recognised: DataFrame, fallback: DataFrame | None = None, least_text: int = 50) -> DataFrame:
    """doc_id, text: the distinct candidates of documents by the digital route: pages routed by their text, blocks in reading
    order, lines cleaned, the second reader for documents that come out empty, joining, two passes."""
    return _deduplicated(lines.digital_lines(pages, blocks, recognised, fallback, least_text), 2)


def scanned_candidates(pages: DataFrame, recognised: DataFrame, least_text: int = 50) -> DataFrame:
    """doc_id, text: the distinct candidates of scanned and mixed documents: a page's own text or what was recognised
    on it, lines stripped but not cleaned, joining, one pass."""
    return text_candidates(pdf.routed_lines(pages.where("page is not null"), recognised, least_text), ocr=True)
