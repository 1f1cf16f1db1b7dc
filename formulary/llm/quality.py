"""Compression classifier of quality: zstandard dictionaries built from good and bad labelled text.

Texts are cut into pieces of ``piece`` bytes (all of them: whole texts), each compressed with either
dictionary; the difference of the two sums, normalised by the text's own size, is calibrated to a probability
by a logistic curve, and nothing else is. Labelled rows are learned from a bounded sample: the ``most_docs`` labelled rows of
the least hash, of ``most_bytes`` together; half of them give pieces for the dictionaries (at most ``most_pieces`` a class),
the other half calibrates. Scoring maps every text where it lies, without a shuffle.

Defined cases: null or empty texts have difference 0 and get the score of that; label
rows that are null or name no document are not learned from; without both classes the score is 0.5
(one class only: 1 or 0 for it, softened); repeated rows are scored each; other columns are kept,
and columns called score or predicted are replaced."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Batches, batch, documents, remainder, small_batches, table, text_bytes, written

PIECE, LEVEL = 2048, 3


def labelled(docs: DataFrame, labels: DataFrame, label: str, fold: "F.Column", most_docs: int, most_bytes: int) -> DataFrame:
    """doc_id, text, y (written) of the ``most_docs`` learnable labelled rows of least hash, passing over
    those with which the texts would be more than ``most_bytes`` together. The sample of ids is bounded by
    ``most_docs``, which bounds what is broadcast; of a repeated id the least text is taken."""
    y = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).where(fold)
    y = y.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label).cast("int").alias("y"))
    y = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_docs)
    rows = written(documents(docs).join(F.broadcast(y), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("doc_id", "text", "y"), "labelled")
    sizes = rows.select("doc_id", F.octet_length("text").cast("long").alias("size")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()  # most_docs rows
    total, over = 0, []
    for r in sizes:
        if total + r["size"] > most_bytes:
            over.append((r["doc_id"],))
        else:
            total += r["size"]
    return rows.join(F.broadcast(rows.sparkSession.createDataFrame(over, "doc_id long")), "doc_id", "left_anti") if over else rows


def pieces(text: bytes, size: int = PIECE) -> list[bytes]:
    return [text[k : k + size] for k in range(0, len(text), size)]


class Model:
    def __init__(self, good: list[bytes], bad: list[bytes], size: int = 65536):
        self.blobs = [self.trained(good, size), self.trained(bad, size)]
        self.w = np.zeros(2)  # slope and intercept of the calibration

    def probability(self, x: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.w[0] * x + self.w[1], -30, 30))))

    @staticmethod
    def trained(samples: list[bytes], size: int) -> bytes:
        try:
            return zstandard.train_dictionary(size, samples, level=LEVEL).as_bytes()
        except zstandard.ZstdError:  # too few samples: their text itself is the dictionary
            return b"".join(samples)[-size:]

    def coders(self) -> list[zstandard.ZstdCompressor]:
        out = []
        for x in self.blobs:
            d = zstandard.ZstdCompressionDict(x or b" " * 8)
            d.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
        return out


def measure(text: bytes, coders: list[zstandard.ZstdCompressor]) -> float:
    """The difference of the sizes with the bad and the good dictionary over the text's own, in tenths: positive if
    good fits better."""
    good = bad = 0
    for x in pieces(text):
        good += len(coders[0].compress(x))
        bad += len(coders[1].compress(x))
    return 10 * (bad - good) / len(text) if text else 0.0


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 200, ridge: float = 1e-2) -> np.ndarray:
    """Weights and intercept of P(y=1) by damped Newton steps."""
    z = np.concatenate([x, np.ones((len(x), 1))], 1)
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (y - p) - ridge * w)
        w = w + step * min(1.0, 3.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, fold: "F.Column", label: str = "quality", most_docs: int = 20_000, most_bytes: int = 128 << 20, most_pieces: int = 4_000) -> Model:
    small_batches(docs.sparkSession)
    rows = labelled(docs, labels, label, fold, most_docs, most_bytes)
    half = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)) == 0
    schema = pa.schema([("y", pa.int32()), ("h", pa.int64()), ("piece", pa.binary())])

    def cut(it: Batches) -> Batches:
        import xxhash

        for b in it:
            out = [(y, xxhash.xxh3_64_intdigest(p, seed=k) >> 1, p) for y, t in zip(b["y"].to_pylist(), text_bytes(b["text"]), strict=True) for k, p in enumerate(pieces(t))]
            if out:
                yield batch(schema, list(zip(*out, strict=True)))

    # the most_pieces of least hash in a class; those far above are left out before tasks send theirs
    cuts = rows.where(half).mapInArrow(cut, "y int, h long, piece binary")
    samples: dict[int, list[bytes]] = {1: [], 0: []}
    for y, n in cuts.groupBy("y").agg(F.count("*")).collect():
        share = min(1.0, (most_pieces + 8 * most_pieces**0.5) / n)
        low = cuts.where((F.col("y") == y) & (F.col("h") <= (int(share * (1 << 53)) << 10) - 1))
        samples[y] = [bytes(r["piece"]) for r in low.orderBy("h", "piece").limit(most_pieces).collect()]
    model = Model(samples[1], samples[0])
    if not samples[0] or not samples[1]:
        model.w[1] = 3.0 * (bool(samples[1]) - bool(samples[0]))
        return model
    out = pa.schema([("y", pa.int32()), ("x", pa.float64())])

    def measured(it: Batches) -> Batches:
        coders = model.coders()
        for b in it:
            yield batch(out, [b["y"], [measure(t, coders) for t in text_bytes(b["text"])]])

    found = rows.where(~half).mapInArrow(measured, "y int, x double").collect()
    if found:
        model.w = logistic(np.array([[r["x"]] for r in found]), np.array([r["y"] for r in found], float))
    return model


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with score and predicted."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def scored(it: Iterator[pd.Series]) -> Iterator[pd.Series]:  # dictionaries are loaded once a task
        coders = model.coders()
        for s in it:
            yield s.map(lambda t: model.probability(measure(t.encode(), coders))).astype(float)

    kept = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    return docs.select(*kept, scored(F.coalesce(F.col(text), F.lit(""))).alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def learnable() -> "F.Column":
    return remainder("doc_id", 3) != 1


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(table(spark, sf_dir, "documents"))
    model = fit(docs, table(spark, sf_dir, "labels"), learnable())
    return score(docs, model).select("doc_id", (~learnable()).alias("held_out"), "score", "predicted")
