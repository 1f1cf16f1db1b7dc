"""The class-balanced dataset: classify, sample, fill up, validate, report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import operator_class

# The classes in order, with their descriptions.
CLASSES = (
    ("integral", r"Интегралы (\int, \oint)"),
    ("summation", r"Суммы и произведения (\sum, \prod)"),
    ("derivative_limit", r"Производные и пределы (\partial, \nabla, \lim)"),
    ("equation", r"Базовые уравнения/неравенства (=, \le, \ge)"),
    ("mixed", "Смешанные формулы (содержат >= 2 разных главных операторов)"),
)
# Class, text and formula of synthetic rows, in the order they take turns; {a} is 0 to 5, {b} 6 to 10, {n} 10 to 100.
TEMPLATES = (
    ("integral", "Интеграл от {a} до {b}", r"\int_{{a}}^{{b}} f(x) dx = 0"),
    ("summation", "Сумма до {n}", r"\sum_{i=1}^{{n}} x_i = Y"),
    ("derivative_limit", "Производная функции", r"\frac{\partial f}{\partial x} + \frac{\partial f}{\partial y} = 0"),
    ("derivative_limit", "Предел на бесконечности", r"\lim_{n \to \infty} \left( 1 + \frac{1}{n} \right)^n = e"),
    ("equation", "Квадратное уравнение", "ax^2 + bx + c = 0"),
    ("equation", "Неравенство", r"x^2 + y^2 \le R^2"),
    ("mixed", "Предел интеграла", r"\lim_{t \to 0} \int_0^t f(x) dx = 0"),
    ("mixed", "Интеграл суммы", r"\int_{\Omega} \sum_{i=1}^n x_i d\mu \ge 0"),
)
SYNTHETIC = "synthetic"


def vocabulary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, name, text) for k, (name, text) in enumerate(CLASSES)], "class_no int, class string, description string")


def classify(df: DataFrame, latex: str = "latex") -> DataFrame:
    """``df`` with class; formulas too short for one go."""
    return df.withColumn("class", operator_class(F.col(latex))).where("class is not null")


def rejected(df: DataFrame, latex: str = "latex") -> DataFrame:
    """The rows that ``classify`` lets go, with a reason."""
    return df.where(operator_class(F.col(latex)).isNull()).withColumn("reason", F.when(F.col(latex).isNull(), "missing").otherwise("too short"))


def drawn(seed: int, cls: Column, i: Column, what: str, lo: int, hi: int) -> Column:
    """An integer from lo to hi, by hash: the same on any partitioning."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), cls, F.lit("|"), i.cast("string"), F.lit(f"|{what}")).cast("binary")), 1, 8), 16, 10).cast("long")
    return (F.pmod(h, F.lit(hi - lo + 1)) + lo).cast("string")


def synthetic(wanted: DataFrame, seed: int = 42) -> DataFrame:
    """text, latex, source, class, key for the ``shortage`` of each class in ``wanted``; its templates take
    turns. Classes without templates give none."""
    spark = wanted.sparkSession
    turns = [[t for t in TEMPLATES if t[0] == name] for name, _ in CLASSES]
    rows = [(name, k, len(ts), text, latex) for ts in turns for k, (name, text, latex) in enumerate(ts)]
    templates = spark.createDataFrame(rows, "class string, turn int, turns int, text string, latex string")  # eight rows
    numbered = wanted.where("shortage > 0").select("class", F.explode(F.sequence(F.lit(0), (F.col("shortage") - 1).cast("int"))).alias("i"))
    out = numbered.join(F.broadcast(templates), "class").where(F.pmod("i", F.col("turns")) == F.col("turn"))
    for what, lo, hi in (("a", 0, 5), ("b", 6, 10), ("n", 10, 100)):
        value = drawn(seed, F.col("class"), F.col("i"), what, lo, hi)
        out = out.withColumn("text", F.replace("text", F.lit(f"{{{what}}}"), value)).withColumn("latex", F.replace("latex", F.lit(f"{{{{{what}}}}}"), F.concat(F.lit("{"), value, F.lit("}"))))
    return out.select("text", "latex", F.lit(SYNTHETIC).alias("source"), "class", F.concat(F.lit(f"{SYNTHETIC}|"), "class", F.lit("|"), F.col("i").cast("string")).alias("key"))


def balance(items: DataFrame, per_class: int = 100, seed: int = 42) -> DataFrame:
    """``per_class`` rows of each class of the vocabulary, in a shuffled order (position): of a class with
    enough, those of least hash of seed and ``key`` (unique); others whole, filled up with synthetic rows.
    Other classes are dropped. The rank's limit is applied before its shuffle as well, so a class with
    most of the rows moves ``per_class`` of them from each task."""
    spark = items.sparkSession
    of = lambda c: F.md5(F.concat(F.lit(f"{seed}|"), c).cast("binary"))
    vocab = vocabulary(spark)
    known = items.join(F.broadcast(vocab.select("class")), "class", "left_semi")
    w = Window.partitionBy("class").orderBy(of(F.col("key")), "key")
    real = known.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= per_class).select("text", "latex", "source", "class", "key")
    counts = real.groupBy("class").agg(F.count("*").alias("n"))  # of what was taken, whose exchange serves both
    wanted = vocab.join(counts, "class", "left").select("class", (F.lit(per_class) - F.coalesce("n", F.lit(0))).alias("shortage"))
    return real.unionByName(synthetic(wanted, seed)).withColumn("position", of(F.concat(F.lit("shuffle|"), "key")))


def validate(items: DataFrame) -> DataFrame:
    """Rows whose four fields are there and not blank and whose class is in the vocabulary."""
    out = items
    for c in ("text", "latex", "source", "class"):
        out = out.where(F.trim(c) != "")
    return out.join(F.broadcast(vocabulary(items.sparkSession).select("class")), "class", "left_semi")


def counts_by(items: DataFrame) -> DataFrame:
    """by (class or source), name, n: one pass with grouping sets."""
    g = items.groupingSets([["class"], ["source"]], "class", "source").agg(F.grouping("class").alias("g"), F.count("*").alias("n"))
    return g.select(F.when(F.col("g") == 0, "class").otherwise("source").alias("by"), F.when(F.col("g") == 0, F.col("class")).otherwise(F.col("source")).alias("name"), "n")


def stats(items: DataFrame, generated_at: str) -> DataFrame:
    """One row: generated_at, total, by_class, by_source, class_descriptions."""
    c = counts_by(items)
    as_map = lambda kind: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("by") == kind, F.struct("name", "n")))))
    out = c.agg(F.coalesce(F.sum(F.when(F.col("by") == "class", F.col("n"))), F.lit(0)).alias("total"), as_map("class").alias("by_class"), as_map("source").alias("by_source"))
    texts = F.create_map(*[F.lit(x) for pair in CLASSES for x in pair])
    return out.select(F.lit(generated_at).alias("generated_at"), "total", "by_class", "by_source", texts.alias("class_descriptions"))


def class_status(items: DataFrame, enough: int = 100) -> DataFrame:
    """class, n (0 if none) and ok for each class of the vocabulary."""
    counts = items.groupBy("class").agg(F.count("*").alias("n"))
    return vocabulary(items.sparkSession).join(counts, "class", "left").select("class_no", "class", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) >= enough).alias("ok"))


def source_report(items: DataFrame) -> DataFrame:
    return items.groupBy("source").agg(F.count("*").alias("n")).withColumn("kind", F.when(F.col("source") == SYNTHETIC, "synthetic").otherwise("pdf")).orderBy(F.desc("n"), "source")


def examples(items: DataFrame) -> DataFrame:
    """The first item of each class by position, cut to 40 and 80 characters."""
    first = items.groupBy("class").agg(F.min(F.struct("position", "text", "latex")).alias("x"))
    return first.select("class", F.substring("x.text", 1, 40).alias("text"), F.substring("x.latex", 1, 80).alias("latex"))
