"""Document fingerprints, in SQL functions alone: bottom-k sketches of word-shingle hashes.

A sketch is the ``k`` least distinct hashes of a text's shingles (``width`` lower-cased words; with
fewer words the whole sequence is one shingle). Sketches of parts merge by union into the sketch of
the whole; two of them estimate resemblance and containment, one alone the distinct shingle count.

Neighbours in id order are found without a global sort of texts: ids are dealt into ranges of about
``rows_a_range`` rows, each range is a window, and the first row of the next range is added to each one.
Ranges are even parts of at most 4,096 groups, which quantiles bound; their number grows with the input
without limit, and none of the ranges' bounds but the groups' goes to the driver. Where ids lie unevenly within
a group a range is larger; windows spill. The rows added are found by a broadcast of the ranges' first ids while
these are few (``most_sent``), else by a shuffled join.

Defined cases: null texts are empty; an empty text has an empty sketch, whose resemblance is 1 to
another empty one and 0 to others; repeated ids are ordered by their text; a null id comes first; a
single document is its own next one; an empty table gives no rows; other columns are not carried."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, table

K, WIDTH, BITS = 128, 5, 40
SPACE = " \t\n\x0b\f\r"


def with_sketch(df: DataFrame, text: str, name: str, k: int = K, width: int = WIDTH) -> DataFrame:
    """``df`` with the sketch of its column ``text``: a sorted array of at most ``k`` hashes of BITS bits."""
    # each step is a projection of its own: what a lambda refers to is computed once a row
    own, hashed = f"__{name}_words", f"__{name}_hashes"
    words = F.split(F.btrim(F.lower(text), F.lit(SPACE)), "[ \\t\\n\\x0B\\f\\r]+", -1)
    df = df.withColumn(own, F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w)))
    n = F.size(own)
    rolled = F.transform(F.sequence(F.lit(0), n - width), lambda i: F.shiftrightunsigned(F.xxhash64(*(F.get(own, i + j) for j in range(width))), 64 - BITS))
    whole = F.array(F.shiftrightunsigned(F.xxhash64(own), 64 - BITS))
    df = df.withColumn(hashed, F.when(n >= width, rolled).when(n > 0, whole).otherwise(F.array().cast("array<bigint>"))).drop(own)
    return df.withColumn(name, F.slice(F.sort_array(F.array_distinct(hashed)), 1, k)).drop(hashed)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of both parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    union = merged(a, b, k)
    both = F.array_intersect(F.array_intersect(union, a), b)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(both) / F.size(union))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Exact below ``k``, else (k - 1) over the share of the hash space up to the k-th hash."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) * float(1 << BITS) / F.element_at(a, -1))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Share of a's shingles that b has too."""
    r = resemblance(a, b, k)
    shared = r * (distinct_shingles(a, k) + distinct_shingles(b, k)) / (1 + r)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), shared / distinct_shingles(a, k)))


def as_text(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda x: F.lpad(F.lower(F.hex(x)), BITS // 4, "0")), "")


def _range_of(key: str, splits: list[int]) -> Column:
    """How many splits are at or below the key, in two steps of at most 64 comparisons."""
    groups = [splits[k : k + 64] for k in range(0, len(splits), 64)] or [[]]
    array = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs]).cast("array<bigint>")
    coarse = F.size(F.filter(array([g[-1] for g in groups if g]), lambda s: s <= F.col(key)))
    fine = F.size(F.filter(F.get(F.array(*[array(g) for g in groups]), coarse), lambda s: s <= F.col(key)))
    return (coarse * 64 + F.when(fine >= 0, fine).otherwise(0)).cast("int")


def in_order(docs: DataFrame, rows_a_range: int = 500, most_groups: int = 4096, most_sent: int = 1 << 20) -> DataFrame:
    """doc_id, text, and for windows: range (a group and a part of it), extra (a row repeated from the next range), at."""
    d = documents(docs).withColumn("at", F.coalesce("doc_id", F.lit(-(1 << 63))))
    n, low, high = d.agg(F.count("*"), F.min("at"), F.max("at")).first()
    groups = max(1, min(most_groups, n // rows_a_range))
    splits = sorted(set(d.agg(F.percentile_approx("at", [k / groups for k in range(1, groups)], 20_000)).first()[0] or [])) if groups > 1 else []
    parts = max(1, n // (rows_a_range * groups))
    d = d.withColumn("group", _range_of("at", splits))
    if parts > 1:  # doubles: ids may lie further apart than a long holds, and any monotone place will do
        bounds = [float(x) for x in [low, *splits, high + 1]]
        place = lambda xs, k: F.get(F.array(*[F.lit(x) for x in xs]), k)
        left, right = place(bounds, F.col("group")), place(bounds, F.col("group") + 1)
        part = F.floor((F.col("at").cast("double") - left) / F.greatest(right - left, F.lit(1.0)) * parts)
        d = d.withColumn("part", F.greatest(F.lit(0), F.least(F.lit(parts - 1), part)).cast("long"))
    else:
        d = d.withColumn("part", F.lit(0).cast("long"))
    d = d.select("doc_id", "text", "at", F.struct("group", "part").alias("range"))
    firsts = d.groupBy("range").agg(F.min("at").alias("at")).withColumn("group", F.col("range.group"))
    ends = [r[1] for r in firsts.groupBy("group").agg(F.max("range")).orderBy("group").collect()]  # a row a group
    if not ends:
        return d.withColumn("extra", F.lit(0))
    spark = docs.sparkSession
    before = spark.createDataFrame([(tuple(e), ends[k - 1]) for k, e in enumerate(ends)], "e struct<group: int, part: long>, last struct<group: int, part: long>").select(F.col("e.group").alias("group"), "last")
    w = Window.partitionBy("group").orderBy("range")
    follow = firsts.join(F.broadcast(before), "group").select("at", F.coalesce(F.lag("range").over(w), "last").alias("to"))
    follow = F.broadcast(follow) if len(ends) * parts <= most_sent else follow
    extra = d.drop("range").join(follow, "at").select("doc_id", "text", "at", F.col("to").alias("range"), F.lit(1).alias("extra"))
    return d.withColumn("extra", F.lit(0)).unionByName(extra)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Every document with its sketch, its edited text's, and their likenesses (see the contract)."""
    w = Window.partitionBy("range").orderBy("extra", "at", "text")
    d = in_order(docs).withColumn("next", F.lead("text").over(w)).withColumn("n_chars", F.char_length("text"))
    q = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars") - q), F.substring("next", F.lit(1), q))
    d = d.withColumn("edited", F.when(F.col("extra") == 0, edited)).drop("next")
    d = with_sketch(with_sketch(d, "text", "sketch"), "edited", "edited_sketch")
    d = d.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)).drop("edited")
    d = d.withColumn("next_sketch", F.lead("sketch").over(w)).where("extra = 0")
    return d.select("doc_id", F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256", "sketch", "edited_sketch", resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"), distinct_shingles(F.col("sketch")).alias("n_shingles"), containment(F.col("edited_sketch"), F.col("sketch")).alias("edited_contained"))


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fingerprints(table(spark, sf_dir, "documents"))
    return f.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("sketch")).alias("fingerprint"), as_text(F.col("edited_sketch")).alias("edited_fingerprint"), "near_edited", "near_next")
