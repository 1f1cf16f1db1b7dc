import pytest
from pyspark.sql import functions as F

from formulary.operators import corpus, dataset, layout, lines, records
from formulary.sources import pdf, sinks
from formulary.streaming import incremental


@pytest.mark.parametrize(("given", "want"), [(["2 +", "3 = 5", "Abc"], ["2 + 3 = 5", "Abc"]), (["Abc", "def"], ["Abc def"]), (["x = 1", "= 2"], ["x = 1", "= 2"]), ([], [])])
def test_broken_lines(spark, given, want):
    df = spark.createDataFrame([("d", k, x) for k, x in enumerate(given)], "doc_id string, line_no int, line string").repartition(3)
    assert [r.line for r in lines.merge_broken_lines(df).orderBy("line_no").collect()] == want


def test_boxes_are_folded_from_the_top(spark):
    rows = [("d", 1, 0.0, 0.0, 10.0, 10.0), ("d", 1, 20.0, 0.0, 30.0, 10.0), ("d", 1, 100.0, 0.0, 110.0, 10.0), ("d", 1, 25.0, 0.5, 50.0, 9.0)]
    df = spark.createDataFrame(rows, "doc_id string, page int, x0 double, y0 double, x1 double, y1 double")
    got = [(r.x0, r.x1) for r in layout.merge_boxes(df).orderBy("box_no").collect()]
    assert got == [(0.0, 30.0), (100.0, 110.0), (25.0, 50.0)]  # the last is compared with the far box only


def test_refined_box(spark):
    w = "array<struct<word_num:int,text:string,left:int,top:int,width:int,height:int>>"
    df = spark.createDataFrame([([(k, t, 100 * k, 50, 40, 10) for k, t in enumerate(["a", "b", "c", "d", "=", "e", "f", "g", "h"])],), ([(0, "a", 5, 5, 5, 5)],), ([],)], f"words {w}")
    got = [tuple(r.b) for r in df.select(layout.refined_box(F.col("words")).alias("b")).collect()]
    assert got == [(92, 42, 748, 68), (5, 5, 10, 10), (0, 0, 0, 0)]


def test_word_lines_count_blank_words_in_the_confidence(spark):
    rows = [("d", 1, 1, 1, 1, 0, " x ", 0, 0, 5, 5, 90.0), ("d", 1, 1, 1, 1, 1, " ", 9, 9, 5, 5, -1.0)]
    df = spark.createDataFrame(rows, pdf.WORD)
    r = layout.lines_of_words(df).first()
    assert (r.line_text, r.mean_conf, r.x1) == ("x", 45.0, 5)


def test_balanced_whatever_the_partitions(spark):
    base = spark.range(500).selectExpr("cast(id as string) as text", "'a = b' as latex", "'doc' as source", "cast(id as string) as key")
    items = dataset.classify(base)
    one, many = dataset.balance(items.repartition(1)), dataset.balance(items.repartition(7))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))
    assert {r["class"]: r.n for r in dataset.class_status(one).collect()} == {name: 100 for name, _ in dataset.CLASSES}
    assert dataset.stats(one, "now").first().total == 500
    assert dataset.balance(items.limit(0)).count() == 500


def test_validate_drops_blanks_and_unknown_classes(spark):
    rows = [("t", "l", "s", "equation"), (" ", "l", "s", "equation"), (None, "l", "s", "equation"), ("t", "l", "s", "other")]
    assert dataset.validate(spark.createDataFrame(rows, "text string, latex string, source string, class string")).count() == 1


def test_admission(spark):
    files = spark.createDataFrame([("1", "a.pdf", "x"), ("2", "b.pdf", "x"), ("3", "c.PDF", "y"), ("4", "d.txt", "z"), ("5", "e.pdf", "w"), ("6", None, "v")], "path string, name string, md5 string")
    known = spark.createDataFrame([("e.pdf", "q"), ("old.pdf", "y")], "name string, hash string")
    got = {r.path: r.status for r in corpus.admit(files, known).collect()}
    assert got == {"1": "accepted", "2": "duplicate", "3": "duplicate", "4": "bad_extension", "5": "name_taken", "6": "bad_extension"}
    assert corpus.admit(files, known, force=True).where("status = 'accepted'").count() == 4


def test_admission_goes_file_by_file(spark):
    """A refused file registers nothing: neither its content nor its name stands in a later one's way."""
    files = [("1", "a.pdf", "x"), ("2", "b.pdf", "x"), ("3", "c.pdf", "p"), ("4", "c.pdf", "q"), ("5", "d.pdf", "q"), ("6", "d.pdf", "q"), ("7", "e.pdf", None), ("8", "e.pdf", None), ("9", ".pdf", "r"), ("10", "f.pdf", "x")]
    df = spark.createDataFrame(files, "path string, name string, md5 string")
    known = spark.createDataFrame([("a.pdf", "old")], "name string, hash string")
    got = {r.path: r.status for r in corpus.admit(df, known).collect()}
    # paths sort as text: 1, 10, 2, ...
    want = {"1": "name_taken", "10": "accepted", "2": "duplicate", "3": "accepted", "4": "name_taken", "5": "accepted", "6": "duplicate", "7": "accepted", "8": "name_taken", "9": "bad_extension"}
    assert got == want


def test_admission_against_a_loop(spark):
    import random

    rng = random.Random(3)
    files = [(f"{k:04d}", f"n{rng.randrange(60)}.pdf", f"h{rng.randrange(60)}") for k in range(150)]
    files += [(f"z{k:03d}", f"m{k // 2}.pdf", f"g{(k + 1) // 2}") for k in range(40)]  # each conflicts with the next
    known = [("n1.pdf", "h2"), ("n3.pdf", "h4")]
    names, hashes, want = {n for n, _ in known}, {h for _, h in known}, {}
    for path, name, h in sorted(files):
        want[path] = "duplicate" if h in hashes else "name_taken" if name in names else "accepted"
        if want[path] == "accepted":
            names.add(name)
            hashes.add(h)
    df = spark.createDataFrame(files, "path string, name string, md5 string").repartition(5)
    got = {r.path: r.status for r in corpus.admit(df, spark.createDataFrame(known, "name string, hash string")).collect()}
    assert got == want and set(want.values()) == {"accepted", "duplicate", "name_taken"}


def test_rejected_rows(spark):
    df = spark.createDataFrame([("ab",), (None,), ("abc",), ("  x  ",)], "latex string")
    assert sorted((r.latex or "", r.reason) for r in dataset.rejected(df).collect()) == [("", "missing"), ("  x  ", "too short"), ("ab", "too short")]
    assert dataset.classify(df).count() == 1


def test_balanced_with_an_empty_and_a_short_class(spark):
    rows = [("\\int x", k) for k in range(150)] + [("\\sum x", k) for k in range(30)] + [("a = b", k) for k in range(100)] + [("\\lim x", 0)]
    items = dataset.classify(spark.createDataFrame([(f, f, "d", f"{f}{k}") for f, k in rows], "text string, latex string, source string, key string"))
    out = dataset.balance(items)
    assert {r["class"]: (r.n, r.s) for r in out.groupBy("class").agg(F.count("*").alias("n"), F.count_if(F.col("source") == "synthetic").alias("s")).collect()} == {"integral": (100, 0), "summation": (100, 70), "derivative_limit": (100, 99), "equation": (100, 0), "mixed": (100, 100)}
    assert [(r["class"], r.n, r.ok) for r in dataset.class_status(items).orderBy("class_no").collect()] == [("integral", 150, True), ("summation", 30, False), ("derivative_limit", 1, False), ("equation", 100, True), ("mixed", 0, False)]


def test_digital_lines(spark):
    pages = spark.createDataFrame([("d", 1, "x" * 60), ("d", 2, "short"), ("e", 1, None), ("f", 1, "")], "doc_id string, page int, text string")
    blocks = spark.createDataFrame([("d", 1, 0, 51.0, 0.0, "third"), ("d", 1, 1, 12.0, 9.0, "second  π\n\nline"), ("d", 1, 2, 14.0, 1.0, "first"), ("d", 1, 3, 12.0, 9.0, "tie"), ("d", 2, 0, 0.0, 0.0, "not read")], "doc_id string, page int, no int, y0 double, x0 double, text string")
    read = spark.createDataFrame([("d", 1, "no"), ("d", 2, " read  on \nπ\nlast"), ("e", 1, "")], "doc_id string, page int, text string")
    other = spark.createDataFrame([("d", 1, "no"), ("e", 1, "other"), ("f", 1, "π")], "doc_id string, page int, text string")
    got = lines.digital_lines(pages, blocks, read, other, 50).orderBy("doc_id", "line_no").collect()
    assert [(r.doc_id, r.line) for r in got] == [("d", x) for x in ("first", "second", "line", "tie", "third", "read on", "last")] + [("e", "other")]


def test_recognised_pages_and_words_by_stubs(spark, tmp_path):
    rows = [("d", 1, b"img", "scanned"), ("d", 2, None, "scanned"), ("e", 1, b"bad", "text")]
    df = spark.createDataFrame(rows, "doc_id string, page int, image binary, page_type string")

    def text(image):
        if image == b"ready bad":
            raise ValueError
        return image.decode() + "\nx = 1"

    got = {(r.doc_id, r.page): r.text for r in pdf.page_texts(df, text, lambda image: b"ready " + image).collect()}
    assert got == {("d", 1): "ready img\nx = 1", ("d", 2): "", ("e", 1): ""}
    assert {r.text for r in pdf.page_texts(df).collect()} == {""} or pdf.capabilities()["pytesseract"]
    assert [r.image for r in pdf.enhanced(df, lambda image: b"+" + image).orderBy("doc_id", "page").collect()] == [b"+img", None, b"bad"]
    assert [r.image for r in pdf.enhanced(df).orderBy("doc_id", "page").collect()][2] == b"bad"

    def words(image):
        base = {"block_num": 1, "par_num": 1, "line_num": 1, "left": 0, "top": 0, "width": 5, "height": 5}
        yield from ({**base, "word_num": k, "text": t, "conf": c} for k, (t, c) in enumerate([("a", "90"), ("b", "n/a"), (None, 3), ("c", None), ("d", 7)]))

    found = pdf.words(df.where("doc_id = 'e'"), words).orderBy("word_num").collect()
    assert [(r.text, r.conf) for r in found] == [("a", 90.0), ("b", -1.0), ("c", -1.0), ("d", 7.0)]
    images = df.selectExpr("concat(doc_id, '/', page) as name", "image")
    for _ in range(2):
        written = sinks.write_images(images, str(tmp_path / "png")).collect()
        assert sorted(p.name for p in (tmp_path / "png").iterdir()) == ["d_1.png", "e_1.png"] and len(written) == 2
    assert (tmp_path / "png" / "d_1.png").read_bytes() == b"img"


def test_markup_and_channels(spark):
    import numpy as np

    df = spark.createDataFrame([("x",), ("bad",), (None,)], "latex_norm string")

    def strict(x):
        if x == "bad":
            raise ValueError
        return f"<{x}>"

    got = {r.latex_norm: (r.mathml, r.sympy) for r in pdf.optional_markup(df, strict, str.upper).collect()}
    assert got == {"x": ("<x>", "X"), "bad": (None, "BAD"), None: (None, None)}
    if not pdf.capabilities()["latex2mathml"]:
        assert pdf.optional_markup(df).where("mathml is not null").count() == 0
    image = np.arange(12).reshape(2, 2, 3)
    assert (pdf.swapped_channels(image)[0, 0] == [2, 1, 0]).all() and (pdf.swapped_channels(pdf.swapped_channels(image)) == image).all()


def test_pages_by_a_stub_provider_and_records(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF one")
    (tmp_path / "bad.pdf").write_bytes(b"broken")
    (tmp_path / "c.txt").write_bytes(b"no")

    def stub(name, content):
        for k in (1, 2, 3):
            if content == b"broken" and k == 2:
                raise ValueError
            yield {"page": k, "text": f"$x = {k}$"}

    files = pdf.corpus_files(spark, str(tmp_path))
    assert files.count() == 2
    got = pdf.pages(files, stub, max_pages=2)
    assert sorted((r.doc_id, r.page or 0, r.error) for r in got.collect()) == [("a", 1, None), ("a", 2, None), ("bad", 0, "ValueError: "), ("bad", 1, None)]
    types = {r.doc_id: (r.type, r.total_pages, r.needs_ocr, r.error) for r in corpus.document_types(corpus.page_flags(got)).collect()}
    assert types == {"a": ("DIGITAL", 2, False, None), "bad": ("ERROR", None, False, "ValueError: ")}
    got = got.where("page is not null")
    from formulary.operators.extract import text_layer_latex

    rec = records.text_layer_records(text_layer_latex(got.select("doc_id", "pdf_file", "page", "text")))
    assert rec.columns == list(records.FIELDS)
    assert {r.cls for r in rec.collect()} == {"EQ_EXPR"}  # delimiters stay, so never a number
    sinks.write_records(rec, str(tmp_path / "out"))
    sinks.write_records(rec, str(tmp_path / "out"))  # a repeated run leaves no copies
    assert spark.read.json(str(tmp_path / "out")).count() == 3
    assert sinks.read_json(spark, str(tmp_path / "none"), "a int").count() == 0
    assert pdf.pages(files).count() == 0 or pdf.capabilities()["fitz"]
    crops = got.select("doc_id", F.lit(b"img").alias("image"))
    assert {r.latex_raw for r in pdf.recognised(crops, lambda: lambda image: "y = 1").collect()} == {"y = 1"}


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    pages = spark.createDataFrame([("d", "d.pdf", 1, "$a < b$ and \\(c = 5\\)"), ("e", "e.pdf", 1, None)], incremental.PAGES)
    pages.write.parquet(str(tmp_path / "in"))
    incremental.start_records(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    assert sorted(r.cls for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["EQ_EXPR", "INEQ"]


def test_registry_stream_admits_each_batch_against_what_is_registered(spark, tmp_path):
    schema, where = "path string, name string, md5 string, size long", str(tmp_path / "in")
    batches = [[("1", "a.pdf", "x", 1), ("2", "b.pdf", "x", 2)], [("3", "b.pdf", "x", 3), ("4", "a.pdf", "y", 4), ("5", "c.pdf", "z", 5)]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(where)
        files = spark.readStream.schema(schema).parquet(where)
        incremental.start_registry(files, str(tmp_path / "registry"), str(tmp_path / "ck")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "registry")).collect()
    assert sorted((r.name, r.hash) for r in got) == [("a.pdf", "x"), ("c.pdf", "z")]
