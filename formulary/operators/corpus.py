"""A corpus of files: what is new, what is a copy, what kind of document it is, and totals."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from .lines import first_occurrences


def unchanged(files: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(to process, skipped): skipped if the state has the file's name with this sha1. Read name and hash
    first; contents need only be decoded for what is to be processed."""
    keys = ["name", "sha1"]
    known = state.select(*keys).distinct()
    return files.join(known, keys, "left_anti"), files.join(known, keys, "left_semi")


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed into the folder of ``spark.checkpoint.dir``; in local mode one of our own where it is unset."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoints-")
        context.setCheckpointDir(folder)
    return df.checkpoint()


def admit(files: DataFrame, registry: DataFrame, force: bool = False) -> DataFrame:
    """``files`` (path, name, md5) with status, as if added one by one in order of path (then name and md5):
    bad_extension; duplicate, if its content is registered or was accepted before; name_taken, if its name
    was; or accepted. A refused file registers nothing. ``force`` passes over duplicate and name_taken. A
    null content or name is no one's copy; a null name has no extension.

    The order is resolved in rounds: a file that is first among those left of its content and of its name is
    accepted, and what conflicts with it goes. Rounds end when none is left; most files are decided by the first."""
    pdf = F.coalesce(F.lower("name").rlike(r"(?s).\.pdf\z"), F.lit(False))
    if force:
        return files.withColumn("status", F.when(pdf, "accepted").otherwise("bad_extension"))
    hashes = registry.select(F.col("hash").alias("md5")).where("md5 is not null").distinct().withColumn("__h", F.lit(True))
    names = registry.select("name").where("name is not null").distinct().withColumn("__n", F.lit(True))
    known = files.withColumn("__row", F.monotonically_increasing_id()).join(hashes, "md5", "left").join(names, "name", "left")
    known = cut(known.withColumn("__key", F.struct("path", "name", "md5", "__row")))
    left, rounds = known.where(pdf & F.col("__h").isNull() & F.col("__n").isNull()).select("__key"), []
    while not left.isEmpty():
        first = left
        for c in ("md5", "name"):  # minima combine before their shuffle, so a hot content is no hot task
            least = left.groupBy(F.col(f"__key.{c}").alias("k")).agg(F.min("__key").alias("least"))
            alone = F.col(f"__key.{c}").isNull() | (F.col("__key") == F.col("least"))
            first = first.join(least, F.col(f"__key.{c}") == F.col("k"), "left").where(alone).select("__key")
        now = cut(first)
        rounds.append(now)
        for c in ("md5", "name"):
            taken = now.select(F.col(f"__key.{c}").alias("k")).where("k is not null")
            left = left.join(taken, F.col(f"__key.{c}") == F.col("k"), "left_anti")
        # what is neither null nor in conflict with a round's files is still to be judged; nulls alone are never
        left = cut(left.join(now.select(F.col("__key.__row").alias("r")), F.col("__key.__row") == F.col("r"), "left_anti"))
    accepted = known.limit(0).select("__key")
    for r in rounds:
        accepted = accepted.unionByName(r)
    of_hash = accepted.where("__key.md5 is not null").select(F.col("__key.md5").alias("md5"), F.col("__key").alias("__a"))
    own = accepted.select(F.col("__key.__row").alias("__row"), F.lit(True).alias("__ok"))
    out = known.join(of_hash, "md5", "left").join(own, "__row", "left")
    copy = F.col("__h").isNotNull() | (F.col("__a") < F.col("__key"))
    status = F.when(~pdf, "bad_extension").when(F.col("__ok"), "accepted").when(copy, "duplicate").otherwise("name_taken")
    return out.withColumn("status", status).select(*files.columns, "status")


def distinct_contents(files: DataFrame) -> DataFrame:
    """Of each md5 the file of the least path."""
    return first_occurrences(files, ("md5",), ("path",))


def totals(registry: DataFrame) -> DataFrame:
    return registry.agg(F.count("*").alias("n_files"), F.sum("size").alias("total_size"))


def registry_rows(arrays: DataFrame) -> DataFrame:
    """The column-oriented registry (parallel arrays) as a row a file."""
    zipped = F.arrays_zip("files", "hashes", "added_at", "sizes_mb", "urls")
    r = arrays.select(F.explode(zipped).alias("r"))
    return r.select(F.col("r.files").alias("name"), F.col("r.hashes").alias("hash"), F.col("r.added_at").alias("added_at"), F.col("r.sizes_mb").alias("size_mb"), F.col("r.urls").alias("url"))


def is_pdf(content: Column) -> Column:
    return F.coalesce(F.substring(content, 1, 4) == F.lit(b"%PDF"), F.lit(False))


def page_flags(pages: DataFrame) -> DataFrame:
    """doc_id, page, text_len (stripped), n_images and error of the provider's pages, for ``document_types``."""
    return pages.select("doc_id", "page", F.length(strip(F.coalesce("text", F.lit("")))).alias("text_len"), "n_images", "error")


def document_types(pages: DataFrame, scan_ratio: float = 0.8, mixed_ratio: float = 0.2, least_text: int = 30) -> DataFrame:
    """doc_id with page counters and type: the share of pages with images but no text (over ``least_text``
    characters) above ``scan_ratio`` is SCAN, above ``mixed_ratio`` MIXED, else DIGITAL. Where there is a column
    error and a row of a document has one, its type is ERROR, without counters, and it needs no recognition."""
    text, image = F.coalesce(F.col("text_len"), F.lit(0)) > least_text, F.coalesce(F.col("n_images"), F.lit(0)) > 0
    error = F.max("error") if "error" in pages.columns else F.lit(None).cast("string")
    out = pages.groupBy("doc_id").agg(
        F.count("*").alias("total_pages"), F.count_if(text & ~image).alias("text_pages"), F.count_if(~text & image).alias("image_pages"),
        F.count_if(text & image).alias("mixed_pages"), F.count_if(~text & ~image).alias("empty_pages"), error.alias("error"),
    )
    fine = F.col("error").isNull()
    out = out.withColumns({c: F.when(fine, F.col(c)) for c in ("total_pages", "text_pages", "image_pages", "mixed_pages", "empty_pages")})
    ratio = F.col("image_pages") / F.col("total_pages")
    kind = F.when(~fine, "ERROR").when(ratio > scan_ratio, "SCAN").when(ratio > mixed_ratio, "MIXED").otherwise("DIGITAL")
    out = out.withColumns({"scan_ratio": ratio, "type": kind}).withColumn("needs_ocr", F.col("type").isin("SCAN", "MIXED"))
    return out if "error" in pages.columns else out.drop("error")
