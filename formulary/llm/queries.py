"""Queries of the training-data operators, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fingerprints import op6_document_fingerprints
from .hnsw import OP10_SQL, op10_embedding_near_dedup
from .lm import op4_lm_scoring
from .ngram_join import op1_ngram_jaccard_join
from .packing import op2_best_fit_packing
from .pieces import op9_sentencepiece
from .quality import op5_quality_classifier
from .secrets import op3_secret_scans
from .toxicity import op8_toxicity
from .url_filters import OP7_SQL, op7_url_filters


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_ngram_jaccard_join, op2_best_fit_packing, op3_secret_scans, op4_lm_scoring, op5_quality_classifier, op6_document_fingerprints, op7_url_filters, op8_toxicity, op9_sentencepiece, op10_embedding_near_dedup)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op7_url_filters": OP7_SQL, "op10_embedding_near_dedup": OP10_SQL}
