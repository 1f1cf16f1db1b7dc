"""Formula records of both kinds, and the per-document result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bbox_payload, formula_id, normalize_latex, relation_of, right_of, value_of

FIELDS = (
    "formula_id", "doc_id", "pdf_file", "page", "source", "bbox_px", "crop_path", "line_text_ocr", "latex_raw", "latex_norm", "mathml", "sympy", "cls",
    "rhs_number_raw", "rhs_number_float", "ocr_confidence",
)


def _with_relation(df: DataFrame) -> DataFrame:
    df = df.withColumn("latex_norm", normalize_latex(F.col("latex_raw")))
    df = df.withColumn("cls", relation_of(F.col("latex_norm"))).withColumn("rhs_number_raw", F.when(F.col("cls") == "EQ_NUM", right_of(F.col("latex_norm"))))
    return df.withColumn("rhs_number_float", value_of(F.col("rhs_number_raw")))


def _filled(df: DataFrame) -> DataFrame:
    kinds = {"bbox_px": "array<int>", "ocr_confidence": "double"}
    for c in FIELDS:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast(kinds.get(c, "string")))
    return df.select(*FIELDS)


def text_layer_records(hits: DataFrame) -> DataFrame:
    """Records of hits (doc_id, pdf_file, page, latex_raw); equal hits of a page share their id."""
    df = _with_relation(hits).withColumn("source", F.lit("text_layer"))
    return _filled(df.withColumn("formula_id", formula_id(F.col("doc_id"), F.col("page"), F.col("source"), F.col("latex_norm"))))


def ocr_records(hits: DataFrame) -> DataFrame:
    """Records of recognised crops (doc_id, pdf_file, page, x0, y0, x1, y1, latex_raw and, if there,
    crop_path, line_text_ocr, mean_conf, ocr_confidence)."""
    df = _with_relation(hits).withColumn("source", F.lit("ocr"))
    corners = [F.col(c).cast("int") for c in ("x0", "y0", "x1", "y1")]
    df = df.withColumn("bbox_px", F.array(*corners))
    confidence: Column = F.coalesce(*(F.col(c).cast("double") for c in ("ocr_confidence", "mean_conf") if c in df.columns), F.lit(None).cast("double"))
    df = df.withColumn("ocr_confidence", confidence)
    return _filled(df.withColumn("formula_id", formula_id(F.col("doc_id"), F.col("page"), F.col("source"), bbox_payload(*corners, F.col("latex_norm")))))


def class_counts(records: DataFrame) -> DataFrame:
    """doc_id, counts (map of class to number)."""
    n = records.groupBy("doc_id", "cls").agg(F.count("*").alias("n"))
    return n.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("cls", "n")))).alias("formula_counts"))


def document_results(documents: DataFrame, pages: DataFrame, records: DataFrame) -> DataFrame:
    """One nested row a document: document, pages, formulas (in order of page and id)."""
    p = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "page_type", "text_char_count"))).alias("pages"))
    r = records.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("page").alias("at"), F.col("formula_id").alias("id"), F.struct(*FIELDS).alias("x")))).alias("fs"))
    r = r.select("doc_id", F.transform("fs", lambda f: f["x"]).alias("formulas"))
    doc = F.struct(*documents.columns).alias("document")
    return documents.select("doc_id", doc).join(p, "doc_id", "left").join(r, "doc_id", "left").drop("doc_id")
