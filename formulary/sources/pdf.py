"""PDF corpora. Files are listed and read by Spark; pages, images and models come from providers.

A provider is a plain function given by the caller, or one of the optional libraries (PyMuPDF,
Tesseract, pix2tex, OpenCV), found at run time. Without its library a built-in provider gives no rows,
as a missing recogniser does; none of these libraries are needed to import or test this module.
Pages stream out of a partition one at a time, so images never pile up, and are not shuffled."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE = "doc_id string, pdf_file string, page int, text string, n_images int, page_width double, page_height double, metadata map<string,string>, image binary, error string"
WORD = "doc_id string, page int, block_num int, par_num int, line_num int, word_num int, text string, left int, top int, width int, height int, conf double"
BOX = "doc_id string, page int, x0 double, y0 double, x1 double, y1 double"


def capabilities() -> dict[str, bool]:
    """Which optional libraries there are."""
    return {m: importlib.util.find_spec(m) is not None for m in ("fitz", "pytesseract", "cv2", "PIL", "pix2tex", "latex2mathml", "sympy")}


def corpus_files(spark: SparkSession, path: str, recursive: bool = False, with_content: bool = True) -> DataFrame:
    """path, name, size, md5, sha1 (and content) of the PDFs under ``path``. Without content nothing of a
    file is kept but its hashes."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").option("recursiveFileLookup", str(recursive).lower()).load(path)
    out = f.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.md5("content").alias("md5"), F.sha1("content").alias("sha1"), "content")
    return out if with_content else out.drop("content")


def fitz_pages(name: str, content: bytes, dpi: int | None = None) -> Iterator[dict]:
    """Pages by PyMuPDF: text layer, metadata and, with ``dpi``, the rendered image."""
    if not capabilities()["fitz"]:
        return
    import fitz

    with fitz.open(stream=content, filetype="pdf") as doc:
        about = {k: str(v) for k, v in (doc.metadata or {}).items() if v}
        for number, page in enumerate(doc, 1):
            image = page.get_pixmap(dpi=dpi).tobytes("png") if dpi else None
            yield {"page": number, "text": page.get_text("text"), "n_images": len(page.get_images()), "page_width": page.rect.width, "page_height": page.rect.height, "metadata": about, "image": image}


def pages(files: DataFrame, provider: Callable[[str, bytes], Iterable[dict]] = fitz_pages, max_pages: int | None = None) -> DataFrame:
    """A row a page, from 1 to ``max_pages``. A document that fails gives the pages read so far and a row
    without a page that holds the error; plans leave such rows out, and reports count them."""
    names = [f.split()[0] for f in PAGE.split(", ")]

    def read(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for name, content in zip(pdf["name"], pdf["content"], strict=True):
                own = dict.fromkeys(names) | {"doc_id": name.rsplit(".", 1)[0], "pdf_file": name}
                try:
                    for p in provider(name, bytes(content)):
                        if max_pages and p["page"] > max_pages:
                            break
                        row = own | p
                        yield pd.DataFrame([[row[c] for c in names]], columns=names)
                except Exception as e:  # noqa: BLE001  a broken file must not stop the others
                    yield pd.DataFrame([[(own | {"error": f"{type(e).__name__}: {e}"})[c] for c in names]], columns=names)

    return files.select("name", "content").mapInPandas(read, PAGE)


def _per_page(df: DataFrame, provider: Callable[[bytes], Iterable[dict]], schema: str) -> DataFrame:
    names = [f.split()[0] for f in schema.split(", ")]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for r in pdf.itertuples(index=False):
                got = list(provider(bytes(r.image))) if r.image is not None else []
                if got:
                    yield pd.DataFrame([[{"doc_id": r.doc_id, "page": r.page}.get(c, x.get(c)) for c in names] for x in got], columns=names)

    return df.select("doc_id", "page", "image").mapInPandas(run, schema)


def tesseract_words(image: bytes, lang: str = "rus+eng", psm: int = 6) -> Iterator[dict]:
    if not (capabilities()["pytesseract"] and capabilities()["PIL"]):
        return
    import io

    import pytesseract
    from PIL import Image

    table = pytesseract.image_to_data(Image.open(io.BytesIO(image)), lang=lang, config=f"--psm {psm}", output_type="data.frame")
    yield from table[table["text"].notna()].to_dict("records")


def _confidence(x: object) -> float:
    try:
        return float(x)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return -1.0


def words(page_images: DataFrame, provider: Callable[[bytes], Iterable[dict]] = tesseract_words) -> DataFrame:
    """The word table of each page image; words without text go, confidences that aren't numbers are -1."""

    def read(image: bytes) -> Iterator[dict]:
        for w in provider(image):
            if w.get("text") is not None:
                yield w | {"conf": _confidence(w.get("conf"))}

    return _per_page(page_images, read, WORD)


def tesseract_text(image: bytes, lang: str = "rus+eng", psm: int = 6, oem: int = 3) -> str:
    """A page's text; empty without the recogniser."""
    if not (capabilities()["pytesseract"] and capabilities()["PIL"]):
        return ""
    import io

    import pytesseract
    from PIL import Image

    return pytesseract.image_to_string(Image.open(io.BytesIO(image)), lang=lang, config=f"--psm {psm} --oem {oem}")


def page_texts(page_images: DataFrame, provider: Callable[[bytes], str] = tesseract_text, prepare: Callable[[bytes], bytes] | None = None) -> DataFrame:
    """doc_id, page, text recognised on each page image, which ``prepare`` (``binarise`` if it isn't given) works on
    first; pages without an image and errors give the empty text."""
    prepare = prepare or binarise

    @F.pandas_udf("string")
    def read(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(image: bytes | None) -> str:
            try:
                return provider(prepare(bytes(image))) or "" if image is not None else ""
            except Exception:  # noqa: BLE001
                return ""

        for s in it:
            yield s.map(one)

    return page_images.where("page is not null").select("doc_id", "page", read.asNondeterministic()(F.col("image")).alias("text"))


def enhanced(pages: DataFrame, prepare: Callable[[bytes], bytes] | None = None) -> DataFrame:
    """``pages`` (typed) whose images of scanned and mixed pages ``prepare`` (``enhance`` if it isn't given) has worked on."""
    prepare = prepare or enhance

    @F.pandas_udf("binary")
    def run(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for image, wanted in it:
            yield pd.Series([prepare(bytes(x)) if x is not None and w else x for x, w in zip(image, wanted, strict=True)], dtype=object)

    return pages.withColumn("image", run("image", F.col("page_type").isin("scanned", "mixed")))


def cv2_boxes(image: bytes, zoom: float = 3.0) -> Iterator[dict]:
    """Outlines of dark regions, widened by 50 x 10 pixels, in page units."""
    if not capabilities()["cv2"]:
        return
    import cv2
    import numpy as np

    gray = cv2.imdecode(np.frombuffer(image, np.uint8), cv2.IMREAD_GRAYSCALE)
    dark = cv2.threshold(gray, 240, 255, cv2.THRESH_BINARY_INV)[1]
    wide = cv2.dilate(dark, cv2.getStructuringElement(cv2.MORPH_RECT, (50, 10)))
    for outline in cv2.findContours(wide, cv2.RETR_EXTERNAL, cv2.CHAIN_APPROX_SIMPLE)[0]:
        x, y, w, h = cv2.boundingRect(outline)
        yield {"x0": x / zoom, "y0": y / zoom, "x1": (x + w) / zoom, "y1": (y + h) / zoom}


def boxes(page_images: DataFrame, provider: Callable[[bytes], Iterable[dict]] = cv2_boxes) -> DataFrame:
    return _per_page(page_images, provider, BOX)


def enhance(image: bytes, sharpen: float = 1.6) -> bytes:
    """Local contrast, unsharp mask and denoising for recognition; the image itself without OpenCV."""
    if not capabilities()["cv2"]:
        return image
    import cv2
    import numpy as np

    gray = cv2.imdecode(np.frombuffer(image, np.uint8), cv2.IMREAD_GRAYSCALE)
    gray = cv2.createCLAHE(clipLimit=2.0, tileGridSize=(8, 8)).apply(gray)
    gray = cv2.addWeighted(gray, sharpen, cv2.GaussianBlur(gray, (0, 0), 1.2), 1 - sharpen, 0)
    return cv2.imencode(".png", cv2.fastNlMeansDenoising(gray, None, h=10))[1].tobytes()


def binarise(image: bytes, threshold: int = 140) -> bytes:
    """Twice sharpened, contrast doubled, black and white; the image itself without Pillow."""
    if not capabilities()["PIL"]:
        return image
    import io

    from PIL import Image, ImageEnhance, ImageFilter

    img = Image.open(io.BytesIO(image)).convert("L").filter(ImageFilter.SHARPEN).filter(ImageFilter.SHARPEN)
    img = ImageEnhance.Contrast(img).enhance(2.0).point(lambda v: 0 if v < threshold else 255)
    out = io.BytesIO()
    img.save(out, "PNG")
    return out.getvalue()


def pix2tex() -> Callable[[bytes], str]:
    """The recogniser of crops; gives empty strings without its library."""
    if not capabilities()["pix2tex"]:
        return lambda image: ""
    import io

    from PIL import Image
    from pix2tex.cli import LatexOCR

    model = LatexOCR()
    return lambda image: model(Image.open(io.BytesIO(image)))


def recognised(crops: DataFrame, load: Callable[[], Callable[[bytes], str]] = pix2tex) -> DataFrame:
    """``crops`` with latex_raw: ``load`` is called once a task. What fails is the empty string. The
    function counts as nondeterministic, so it isn't evaluated twice."""

    @F.pandas_udf("string")
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()

        def one(image: bytes | None) -> str:
            try:
                return model(bytes(image)) if image is not None else ""
            except Exception:  # noqa: BLE001
                return ""

        for s in it:
            yield s.map(one)

    return crops.withColumn("latex_raw", run.asNondeterministic()(F.col("image")))


def swapped_channels(pixels: np.ndarray) -> np.ndarray:
    """RGB to BGR and back: the last axis reversed."""
    return pixels[..., ::-1]


def latex_to_mathml(x: str) -> str:
    import latex2mathml.converter

    return latex2mathml.converter.convert(x)


def latex_to_sympy(x: str) -> str:
    from sympy.parsing.latex import parse_latex

    return str(parse_latex(x))


def optional_markup(df: DataFrame, mathml: Callable[[str], str] = latex_to_mathml, sympy: Callable[[str], str] = latex_to_sympy) -> DataFrame:
    """``df`` with mathml and sympy of latex_norm by the optional libraries; null without them or on errors."""

    @F.pandas_udf("mathml string, sympy string")
    def run(s: pd.Series) -> pd.DataFrame:
        def tried(f: Callable[[str], str], x: str | None) -> str | None:
            try:
                return f(x) if x is not None else None
            except Exception:  # noqa: BLE001
                return None

        return pd.DataFrame({"mathml": [tried(mathml, x) for x in s], "sympy": [tried(sympy, x) for x in s]})

    return df.drop("mathml", "sympy").withColumn("__m", run(F.col("latex_norm"))).select("*", "__m.mathml", "__m.sympy").drop("__m")


def routed_lines(page_texts: DataFrame, recognised_texts: DataFrame, least_text: int = 50) -> DataFrame:
    """doc_id, page, text: a page's own text where that has ``least_text`` characters, else what was
    recognised on it."""
    from ..functions.text import strip

    other = recognised_texts.select("doc_id", "page", F.col("text").alias("__ocr"))
    own = F.length(strip(F.coalesce("text", F.lit("")))) >= least_text
    return page_texts.join(other, ["doc_id", "page"], "left").select("doc_id", "page", F.when(own, F.col("text")).otherwise(F.coalesce("__ocr", F.lit(""))).alias("text"))


def with_fallback(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """Lines by the primary reader, and of documents it found none in, by the secondary one."""
    return primary.unionByName(secondary.join(primary.select("doc_id").distinct(), "doc_id", "left_anti"))


def by_document_type(types: DataFrame, digital: DataFrame, scanned: DataFrame, ocr_available: bool = True) -> DataFrame:
    """Lines of digital documents by their text, of others by recognition (by text where that is missing)."""
    text_kinds = ["DIGITAL"] if ocr_available else ["DIGITAL", "SCAN", "MIXED"]
    pick = lambda lines, kinds: lines.join(types.where(F.col("type").isin(kinds)).select("doc_id"), "doc_id", "left_semi")
    return pick(digital, text_kinds).unionByName(pick(scanned, [k for k in ("SCAN", "MIXED") if k not in text_kinds]))
