"""Toxicity by multiple-instance learning: a document is a bag of its distinct sentences. A sentence's score
is a logistic function of its words and their beginnings; the document's is a noisy-or of a leak, which
stands for what no sentence explains, and of the sentences' scores, trained from document labels alone;
afterwards the sentence scores locate the offending sentences.

What repeats in a text is one sentence of its bag, and in scoring a sentence below ``floor`` is background
that the leak stands for already, so a text's length by itself is no evidence: a clean text stays clean
however often it is repeated.

Learned from a bounded sample: the ``most_docs`` labelled rows of least hash (whole texts, of
``most_bytes`` together); the model is at most ``most_words`` word weights, so what is sent to the tasks is
bounded. Scoring maps every whole text where it lies, without a shuffle.

Defined cases: null or empty texts have no sentences, so their score is the leak's;
labels that are null or name no document are not learned from; without both classes every score is
the share of toxic labels; of a repeated id the least text is learned from; repeated rows are scored each;
other columns are kept, and columns called score, predicted or offending are replaced."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Batches, batch, documents, hashes, remainder, small_batches, table, text_bytes
from .quality import labelled

FLOOR = 0.05  # below it a sentence is background
ENDS = b".!?\n\r"
#: Sentence ends become line feeds, other ASCII signs spaces; letters, digits and non-ASCII bytes stay.
SIGNS = bytes(10 if c in ENDS else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def sentences(text: bytes) -> list[list[bytes]]:
    """The distinct words of each distinct sentence (sorted, so sums don't depend on the process)."""
    return [sorted(set(s.split())) for s in dict.fromkeys(map(bytes.strip, text.lower().translate(SIGNS).split(b"\n"))) if s]


@dataclass
class Model:
    leak: float = 0.01  # -log(1 - P(toxic without any sentence))
    bias: float = -4.0
    weights: dict[int, float] = field(default_factory=dict)  # by the feature's 64-bit hash
    floor: float = FLOOR


def noisy_or(p: np.ndarray, leak: float, floor: float) -> float:
    """P(toxic) by the scores of a document's sentences."""
    return float(-np.expm1(-leak + np.log1p(-np.minimum(p[p >= floor], 1 - 1e-12)).sum()))


def train(bags: list[list[np.ndarray]], y: np.ndarray, n_words: int, epochs: int = 150, rate: float = 0.5, ridge: float = 1e-5, sparse: float = 2e-5, start: float = -6.0) -> tuple[np.ndarray, float, float]:
    """Adagrad on the noisy-or likelihood: weights, bias and leak. bags: for each document its sentences'
    word numbers."""
    flat = [s for bag in bags for s in bag]
    sizes = np.array([len(s) for s in flat], np.int64)
    word = np.concatenate([*flat, np.empty(0, np.int64)]).astype(np.int64)
    sent = np.repeat(np.arange(len(flat)), sizes)
    doc = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    w, b, gw, gb = np.zeros(n_words), start, np.full(n_words, 1e-6), 1e-6
    leak, gl = -5.0, 1e-6  # its logarithm
    for _ in range(epochs):
        z = np.clip(np.bincount(sent, w[word], len(flat)) + b, -30, 30)
        p = 1 / (1 + np.exp(-z))
        none = np.exp(np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), len(bags)) - np.exp(leak))
        pull = np.where(y > 0, -none / np.maximum(1 - none, 1e-9), 1.0) / len(bags)
        g = p * pull[doc]
        dw, db, dl = np.bincount(word, g[sent], n_words) + ridge * w, g.sum(), pull.sum() * np.exp(leak)
        gw += dw * dw
        gb += db * db
        gl += dl * dl
        w -= rate * dw / np.sqrt(gw)
        w = np.sign(w) * np.maximum(np.abs(w) - rate * sparse / np.sqrt(gw), 0)
        b = min(b - 0.1 * db / np.sqrt(gb), -4.0)  # no words, no evidence: below the floor
        leak = min(leak - 0.1 * dl / np.sqrt(gl), -1.0)
    return w, float(b), float(np.exp(leak))


def features(word: bytes) -> list[bytes]:
    """The word and its beginnings of 4 to 6 bytes, which inflected forms share."""
    return [word, *(word[:k] + b"*" for k in (4, 5, 6) if len(word) > k)]


def fit(docs: DataFrame, labels: DataFrame, fold: "F.Column", label: str = "toxic", most_docs: int = 12_000, most_bytes: int = 64 << 20, most_words: int = 20_000, least_docs: int = 4) -> Model:
    small_batches(docs.sparkSession)
    rows = labelled(docs, labels, label, fold, most_docs, most_bytes)
    counted = pa.schema([("f", pa.int64()), ("n", pa.int64()), ("t", pa.int64())])

    def count(it: Batches) -> Batches:
        for b in it:
            found = [np.unique(hashes([f for s in sentences(t) for w in s for f in features(w)])) for t in text_bytes(b["text"])]
            names, at = np.unique(np.concatenate([*found, np.empty(0, np.uint64)]), return_inverse=True)
            y = np.repeat(np.array(b["y"].to_pylist(), float), [len(x) for x in found])
            yield batch(counted, [names.view(np.int64), np.bincount(at, minlength=len(names)), np.bincount(at, y, len(names)).astype(np.int64)])

    # a feature must be frequent enough; of those the most telling by their signed chi square, so many at most
    total = rows.agg(F.count("*").alias("n"), F.sum("y").alias("t")).first()
    n, t = total["n"], total["t"] or 0
    if not n or t in (0, n):
        share = min(max(t / n if n else 0.0, 0.01), 0.99)
        return Model(float(-np.log1p(-share)))
    per = rows.mapInArrow(count, "f long, n long, t long").groupBy("f").agg(F.sum("n").alias("n"), F.sum("t").alias("t")).where(F.col("n") >= least_docs)
    expected = F.col("n") * (t / n)
    per = per.withColumn("telling", F.abs(F.col("t") - expected) / F.sqrt(expected + 1)).where("telling > 2").orderBy(F.desc("telling"), "f").limit(most_words)
    kept = np.sort(np.array([r["f"] for r in per.select("f").collect()], np.int64).view(np.uint64))
    schema = pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), ("at", pa.binary()), ("sizes", pa.binary())])

    def numbers(s: list[bytes]) -> np.ndarray:
        h = hashes([f for w in s for f in features(w)])
        pos = np.minimum(np.searchsorted(kept, h), max(len(kept) - 1, 0))
        return pos[kept[pos] == h].astype(np.int32) if len(kept) else np.empty(0, np.int32)

    def bagged(it: Batches) -> Batches:
        for b in it:
            bags = [[x for x in map(numbers, sentences(t)) if len(x)] for t in text_bytes(b["text"])]
            yield batch(schema, [b["doc_id"], b["y"], [np.concatenate([*x, np.empty(0, np.int32)]).tobytes() for x in bags], [np.array([len(s) for s in x], np.int32).tobytes() for x in bags]])

    got = sorted(rows.mapInArrow(bagged, "doc_id long, y int, at binary, sizes binary").collect(), key=lambda r: (r["doc_id"], r["y"], bytes(r["at"])))
    bags = [np.split(np.frombuffer(bytes(r["at"]), np.int32), np.cumsum(np.frombuffer(bytes(r["sizes"]), np.int32)))[:-1] for r in got]
    w, bias, leak = train(bags, np.array([r["y"] for r in got]), len(kept))
    return Model(leak, bias, {int(f): float(x) for f, x in zip(kept, w, strict=True) if x})


def score(docs: DataFrame, model: Model, text: str = "text", sentence_at: float = 0.5) -> DataFrame:
    """``docs`` with score, predicted and offending: the sentences (number, start and end in code
    points, score) of ``sentence_at`` or more."""
    small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c.lower() not in ("score", "predicted", "offending")]
    kind = "score double, offending array<struct<sentence:int,start:int,end:int,score:double>>"

    weights, bias, leak, floor = model.weights, model.bias, model.leak, model.floor

    class Known(dict):
        """Weights by word; what isn't known yet is looked up by its hash. Emptied when it grows."""

        def __missing__(self, w: bytes) -> float:
            x = sum(weights.get(xxhash.xxh3_64_intdigest(f), 0.0) for f in features(w))
            if len(self) > 200_000:
                self.clear()
            self[w] = x
            return x

    known = None

    def one(t: str) -> tuple[float, list]:
        nonlocal known
        known = Known() if known is None else known
        raw = t.encode()
        parts = raw.lower().translate(SIGNS).split(b"\n")
        own = dict.fromkeys(map(bytes.strip, parts))
        own.pop(b"", None)
        z = np.fromiter((sum(map(known.__getitem__, sorted(set(s.split())))) for s in own), float, len(own))
        p = 1 / (1 + np.exp(-np.clip(z + bias, -30, 30)))
        found = []
        if len(p) and p.max() >= sentence_at:
            at, start, of = 0, 0, dict(zip(own, p.tolist(), strict=True))
            for number, s in enumerate(parts):
                end = start + len(raw[at : at + len(s)].decode())
                if of.get(s.strip(), 0.0) >= sentence_at:
                    found.append((number, start, end, of[s.strip()]))
                at, start = at + len(s) + 1, end + 1
        return noisy_or(p, leak, floor), found

    @F.pandas_udf(kind)
    def scored(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(t) for t in s], columns=["score", "offending"])

    out = docs.select(*kept, scored(F.coalesce(F.col(text), F.lit(""))).alias("__tox"))
    return out.select(*kept, F.col("__tox.score").alias("score"), (F.col("__tox.score") >= 0.5).cast("int").alias("predicted"), F.col("__tox.offending").alias("offending"))


def learnable() -> "F.Column":
    return remainder("doc_id", 5) != 0


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(table(spark, sf_dir, "documents"))
    model = fit(docs, table(spark, sf_dir, "labels"), learnable())
    return score(docs, model).select("doc_id", (~learnable()).alias("held_out"), "score", "predicted")
