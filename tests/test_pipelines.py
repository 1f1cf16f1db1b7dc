import sys

from pyspark import cloudpickle
from pyspark.sql import functions as F

from formulary.plans import pipelines
from formulary.sources import pdf

cloudpickle.register_pickle_by_value(sys.modules[__name__])
PAGES = [("d", "d.pdf", 1, "2 +\n3 = 5\nAbc $x < 3$", 0, 300.0, 400.0, None, b"png", None), ("d", "d.pdf", 2, None, 1, 300.0, 400.0, None, b"png", None), ("e", "e.pdf", 1, "7 - 5 = 2\n7 - 5 = 2", 0, 300.0, 400.0, None, None, None), ("f", "f.pdf", None, None, None, None, None, None, None, "broken")]
WORDS = [("d", 2, 1, 1, 1, k, w, 20 + 40 * k, 100, 30, 12, 80.0) for k, w in enumerate(["y", "=", "5"])] + [("d", 2, 1, 1, 2, 0, "prose", 20, 200, 30, 12, 90.0)]


def same(image, *box):
    return image


def load():
    return lambda image: "y = 5"


def test_text_path(spark):
    pages = spark.createDataFrame(PAGES, pdf.PAGE)
    assert {(r.doc_id, r.text) for r in pipelines.text_candidates(pages).collect()} == {("d", "2 + 3 = 5"), ("e", "7 - 5 = 2")}
    assert [(r.cls, r.page) for r in pipelines.text_records(pages).collect()] == [("INEQ", 1)]
    assert {r.page_type for r in pipelines.typed_pages(pages).collect()} == {"scanned"}


def test_recognised_path(spark):
    pages, words = spark.createDataFrame(PAGES, pdf.PAGE), spark.createDataFrame(WORDS, pdf.WORD)
    got = pipelines.recognised_records(pages, words, text_poor_only=True, load=load, crop=same).collect()
    assert [(r.doc_id, r.cls, r.rhs_number_float, r.bbox_px, r.ocr_confidence) for r in got] == [("d", "EQ_NUM", 5.0, [12, 92, 138, 120], 80.0)]


def test_visual_path_to_the_dataset(spark):
    pages, words = spark.createDataFrame(PAGES, pdf.PAGE), spark.createDataFrame(WORDS, pdf.WORD)
    boxes = spark.createDataFrame([("d", 2, 18.0, 98.0, 80.0, 114.0), ("d", 2, 90.0, 98.0, 135.0, 114.0), ("d", 2, 18.0, 198.0, 60.0, 214.0)], pdf.BOX)
    found = pipelines.visual_candidates(pages, boxes, words, load=load, crop=same)
    assert [(r.text, r.latex, r.source) for r in found.collect()] == [("y = 5", "y = 5", "d")]
    data = pipelines.build_dataset(found)
    assert data.count() == 500 and data.where("source = 'd'").count() == 1


def test_recognition_from_the_page_images_on(spark):
    pages = spark.createDataFrame(PAGES, pdf.PAGE)

    def read(image):
        assert image.startswith(b"+")  # all pages with images are short of text here
        for r in WORDS:
            yield dict(zip(("block_num", "par_num", "line_num", "word_num", "text", "left", "top", "width", "height", "conf"), r[2:], strict=True))

    got = pipelines.recognised_pages(pages, read, lambda image: b"+" + image, load=load, crop=same).collect()
    assert {(r.doc_id, r.page, r.cls) for r in got} == {("d", 1, "EQ_NUM"), ("d", 2, "EQ_NUM")}


def test_crops_of_one_page_meet_its_image_once(spark):
    boxes = spark.createDataFrame([("d", 1, k, 1.0 * k, 0.0, 2.0 + k, 1.0) for k in range(5)] + [("e", 1, 0, 0.0, 0.0, 1.0, 1.0)], "doc_id string, page int, no int, x0 double, y0 double, x1 double, y1 double")
    images = spark.createDataFrame([("d", 1, b"abcdefg"), ("e", 1, None)], "doc_id string, page int, image binary")
    got = pipelines.with_crops(boxes, images, lambda image, x0, y0, x1, y1: image[int(x0) : int(x1)]).collect()
    assert sorted((r.no, bytes(r.image)) for r in got) == [(k, b"abcdefg"[k : k + 2]) for k in range(5)]


def test_cleaning_on_the_digital_route_alone(spark):
    pages = spark.createDataFrame([("d", 1, "π + 2  = 5\nСумма 1,2,3 + 1 = 7,5")], "doc_id string, page int, text string")
    assert {r.text for r in pipelines.text_candidates(pages).collect()} == {"+ 2 = 5", "Cyммa 1.2.3 + 1 = 7.5"}
    assert any(r.text.startswith("π") for r in pipelines.text_candidates(pages, ocr=True).collect())
    read = spark.createDataFrame([("d", 1, "2 + 2 = 4")], "doc_id string, page int, text string")
    assert [r.text for r in pipelines.scanned_candidates(pages, read, 500).collect()] == ["2 + 2 = 4"]


def test_fetched_files(spark):
    urls = spark.createDataFrame([("http://a/b c.pdf?x",), ("http://a/no",), ("http://a/bad",), (None,)], "url string")

    def fetch(url):
        if url.endswith("bad"):
            raise OSError
        return b"%PDF-1.7" if "pdf" in url else b"<html>"

    got = pipelines.fetched(urls, fetch).collect()
    assert [(r.name, r.size, r.url) for r in got] == [("b_c.pdf", 8, "http://a/b c.pdf?x")]


def test_corpus_path(spark, tmp_path):
    files = spark.createDataFrame([("1", "a.pdf", "x", 1 << 20), ("2", "b.pdf", "x", 5)], "path string, name string, md5 string, size long")
    judged, rows = pipelines.update_corpus(files, spark.createDataFrame([], "name string, hash string"))
    assert judged.count() == 2 and [tuple(r) for r in rows.collect()] == [("a.pdf", "x", None, 1.0, "")]
    from formulary.sources import sinks

    path, known = str(tmp_path / "registry"), rows.withColumn("added_at", F.lit("now"))
    for _ in range(2):  # a run that is repeated leaves no copies
        sinks.append_registry(known, path)
        assert [tuple(r) for r in sinks.read_json(spark, path, sinks.REGISTRY).collect()] == [("a.pdf", "x", "now", 1.0, "")]
