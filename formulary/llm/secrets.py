"""Secret scans, in SQL functions alone: patterns of known secrets, and high-entropy strings.

Candidate strings are runs of token characters. A window slides over a candidate; its character
counts change by the one character that enters and the one that leaves, and with them the sum of
c*log2(c), which gives the window's Shannon entropy without counting again. Each character class
(hex digits; letters and digits; base64; all others) has its own window and threshold. An allow list drops
identifiers that look random but are no secrets: UUIDs, digits alone, strings without any digit, and example values.

Positions are code points: a pattern's matches and the text between them, both as arrays, give the
running offsets, summed in parts so that many matches in one text do not cost their square.
Documents without a match of a pattern cost one search.

Defined cases: null texts are empty; no match gives an empty list, whose digest is that of the empty
string; overlapping spans of different kinds are all kept, but entropy spans inside others are not
added; other columns are kept, and a column called spans is replaced."""

from __future__ import annotations

import math
import operator
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, table

#: Fixed values of the contract: kind, pattern, the group that must be so long, that length.
BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", "AKIA[A-Z0-9]+", 0, 18),
    ("hex", "[0-9a-f]{16,}", 0, 16),  # maximal runs, so runs that are shorter fail
)
CANDIDATE = "[A-Za-z0-9+/_-]{20,}"
#: Kind, what the whole candidate must look like, window, least bits; the first that fits counts.
CLASSES = (
    ("entropy_hex", "^[0-9A-Fa-f]+$", 16, 3.0),
    ("entropy_alnum", "^(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9]+$", 20, 3.6),
    ("entropy_base64", "^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])[A-Za-z0-9+/_-]+$", 20, 3.9),
    ("entropy_mixed", "^.+$", 20, 4.1),  # letters of one case with signs
)
#: Digits alone, or none at all; UUIDs; example values.
ALLOWED = "^(?:[0-9]+|[^0-9]+|[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}|.*(?i:example|sample|dummy|placeholder|xxxx).*)$"
KINDS = [k for k, *_ in BASE] + [k for k, *_ in CLASSES]
SPAN = "array<struct<start:int,kind:int,end:int>>"
PART = 512  # elements that are appended one by one


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _parts(xs: Column) -> Column:
    """An array cut into arrays of ``PART``; none of an empty one."""
    return F.when(F.size(xs) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / PART).cast("int")), lambda k: F.slice(xs, k * PART + 1, PART))).otherwise(F.slice(F.array(xs), 1, 0))


def running(xs: Column, op: Callable[[Column, Column], Column]) -> Column:
    """``op`` (a sum or a maximum, of integers from 0 on) of each element and all before it. An append
    copies what is there, so parts are run through on their own, each from the total before it."""
    none = F.array().cast("array<int>")

    def run(part: Column, first: Column) -> Column:
        start = F.struct(first.alias("at"), none.alias("out"))
        return F.aggregate(part, start, lambda a, x: F.struct(op(a["at"], x).alias("at"), F.array_append(a["out"], op(a["at"], x)).alias("out")), lambda a: a["out"])

    def of(parts: Column) -> Column:
        totals = F.transform(parts, lambda part: F.aggregate(part, F.lit(0), lambda a, x: op(a, x)))
        firsts = F.slice(F.concat(F.array(F.lit(0)), run(totals, F.lit(0))), 1, F.size(parts))
        return F.flatten(F.zip_with(parts, firsts, run))

    return _let(xs, lambda xs: F.when(F.size(xs) <= PART, run(xs, F.lit(0))).otherwise(_let(_parts(xs), of)))


def _matches(text: Column, pattern: str, group: int, alias: str) -> Column:
    """array<struct<start, end, s>>, s: the group's text; null without a match."""
    p = F.lit(pattern)
    gaps = F.transform(F.split(text, pattern, -1), F.char_length)
    hit = F.regexp_extract_all(text, p, F.lit(0))

    def spans(hits: Column) -> Column:
        ends = running(F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: g + h["n"]), operator.add)
        return F.zip_with(hits, ends, lambda h, e: F.struct((e - h["n"]).alias("start"), e.alias("end"), h["s"].alias("s")))

    if group:
        hits = F.zip_with(hit, F.regexp_extract_all(text, p, F.lit(group)), lambda h, s: F.struct(F.char_length(h).alias("n"), s.alias("s")))
    else:
        hits = F.transform(hit, lambda h: F.struct(F.char_length(h).alias("n"), h.alias("s")))
    return F.when(text.rlike(pattern), _let(hits, spans)).alias(alias)


def most_entropy(s: Column, window: int) -> Column:
    """The largest Shannon entropy in bits of ``window`` successive characters of the ASCII string."""
    # the count of what enters can be one over the window for a moment, so the table has a spare entry
    weights = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)])
    codes = F.transform(F.split(s, ""), F.ascii)
    # what enters, what leaves (128: nothing yet)
    steps = F.zip_with(codes, F.slice(F.concat(F.array_repeat(F.lit(128), window), codes), 1, F.char_length(s)), lambda i, o: F.struct(i.alias("i"), o.alias("o")))
    start = F.struct(F.array_repeat(F.lit(0), 129).alias("c"), F.lit(0.0).alias("sum"), F.lit(0).alias("n"), F.lit(0.0).alias("best"))

    def step(a: Column, x: Column) -> Column:
        came, left = F.get(a["c"], x["i"]), F.get(a["c"], x["o"]) + (x["o"] == x["i"]).cast("int")
        total = a["sum"] + F.get(weights, came + 1) - F.get(weights, came) - F.when(x["o"] < 128, F.get(weights, left) - F.get(weights, left - 1)).otherwise(0.0)
        counts = F.transform(a["c"], lambda c, k: c + (k == x["i"]).cast("int") - ((k == x["o"]) & (x["o"] < 128)).cast("int"))
        bits = F.when(a["n"] + 1 >= window, math.log2(window) - total / window).otherwise(0.0)
        return F.struct(counts.alias("c"), total.alias("sum"), (a["n"] + 1).alias("n"), F.greatest(a["best"], bits).alias("best"))

    return F.aggregate(steps, start, step, lambda a: a["best"])


def _kept(matches: Column, kind: int, least: int) -> Column:
    """Spans of the matches whose part is at least so long."""
    long = F.filter(matches, lambda m: F.char_length(m["s"]) >= least)
    return F.transform(long, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")))


def n_of(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def secret_spans(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with spans: array<struct<start, kind, end>> in order; kind is a number in KINDS."""
    kept = [c for c in df.columns if c.lower() != "spans"]
    t = F.coalesce(F.col(text), F.lit(""))
    found = df.select(*kept, *(_matches(t, p, g, f"__{k}") for k, p, g, _ in BASE), _matches(t, CANDIDATE, 0, "__candidate"))
    none = F.array().cast(SPAN)
    spans = [F.coalesce(_kept(F.col(f"__{k}"), j, n), none) for j, (k, _, _, n) in enumerate(BASE)]
    found = found.select(*kept, "__candidate", F.array_sort(F.concat(*spans)).alias("__base"))

    def kind(s: Column) -> Column:
        out = F.lit(-1)
        for j, (_, like, window, bits) in reversed(list(enumerate(CLASSES, len(BASE)))):
            out = F.when(s.rlike(like), F.when(most_entropy(s, window) >= bits, j).otherwise(-1)).otherwise(out)
        return F.when(s.rlike(ALLOWED), -1).otherwise(out)

    def outside(both: Column) -> Column:
        """The candidates that no base span holds: none that begins at or before it ends as late."""
        held = running(F.transform(both, lambda m: F.when(m["base"], m["end"]).otherwise(0)), F.greatest)
        return F.filter(F.zip_with(both, held, lambda m, h: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["s"].alias("s"), (~m["base"] & (h < m["end"])).alias("out"))), lambda m: m["out"])

    # in order of starts, base spans first
    side = lambda base, s: lambda m: F.struct(m["start"].alias("start"), F.lit(not base).alias("late"), m["end"].alias("end"), F.lit(base).alias("base"), s(m).alias("s"))
    both = F.array_sort(F.concat(F.transform("__base", side(True, lambda m: F.lit(""))), F.transform("__candidate", side(False, lambda m: m["s"]))))
    judged = F.transform(_let(both, outside), lambda m: F.struct(m["start"].alias("start"), kind(m["s"]).alias("kind"), m["end"].alias("end")))
    more = F.coalesce(F.when(F.size("__candidate") > 0, F.filter(judged, lambda m: m["kind"] >= 0)), none)
    found = found.select(*kept, "__base", more.alias("__more"))
    return found.select(*kept, F.when(F.size("__more") > 0, F.array_sort(F.concat("__base", "__more"))).otherwise(F.col("__base")).alias("spans"))


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every stretch that spans cover replaced by ``mark``."""

    def kept(held: Column) -> Column:
        """from, to of the text before each new stretch."""
        before = F.concat(F.array(F.lit(0)), F.slice(held, 1, F.size(spans) - 1))
        gaps = F.zip_with(spans, before, lambda s, at: F.struct(at.alias("at"), s["start"].alias("to")))
        return F.filter(gaps, lambda g: g["to"] >= g["at"])

    def cut(part: Column) -> Column:
        """A part's texts, from its own stretch of the text: a substring walks from the beginning."""
        first = F.get(part, 0)["at"]
        own = F.substring(text, first + 1, F.element_at(part, -1)["to"] - first)
        return F.struct(part.alias("part"), first.alias("first"), own.alias("own"))

    gaps = _let(running(F.transform(spans, lambda s: s["end"]), F.greatest), kept)
    texts = F.transform(F.transform(_let(gaps, _parts), cut), lambda c: F.transform(c["part"], lambda g: F.substring(c["own"], g["at"] - c["first"] + 1, g["to"] - g["at"])))
    last = F.array_max(F.transform(spans, lambda s: s["end"]))
    whole = F.concat(F.array_join(F.concat(F.flatten(texts), F.array(F.lit(""))), mark), F.substring(text, last + 1, F.char_length(text)))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat(F.get(names, s["kind"]), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(documents(table(spark, sf_dir, "documents"))).select("doc_id", "spans")
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    counts = [n_of(F.col("spans"), j).alias(f"n_{k}") for j, (k, *_) in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
