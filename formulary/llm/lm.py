"""Language-model scoring by Brown's class-based bigrams.

Words are counted over all training documents. The ``n_words`` most frequent ones are units of their
own, the core; every other word starts in one of ``n_forms`` units by its ending. Exchange clustering moves
these units between classes while that raises the class bigrams' likelihood. Then every further word that
occurs ``least`` times is exchanged too, by its own counts of classes before and after it: all such words
leave their ending's class at once for the one that gives the likelihood most. Only rarer and unknown
words stay with their ending's unit. The number of classes grows with the cube root of the classed words'.
A token's probability is P(class | class before) * P(unit | class), times P(word | unit) where a unit stands
for many words (those of an ending, or those that came to a class); all three are smoothed. Every document
begins after an end token.

At scale: word counts are pre-aggregated in each task, then shuffled by word. The bigram table of
units has a fixed size and is summed from compressed chunks; words' counts of classes go as compressed
sparse chunks to a task for each share of the words. Counts and units of the most frequent words (at
most ``most_kept``) are sent to all tasks; a text's rarer words, each once, fetch their count and class by one
shuffled join, and go back to their text by another. Texts are cut into words once for counting and once
for coding; training and scoring go on from the codes. Nothing else is sent to or gathered in one place.

Defined cases: a null or empty text is one end token; repeated ids are rows of their own; without
training documents every token is unknown; an empty table gives no rows; other columns aren't carried."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Batches, batch, documents, hashes, remainder, small_batches, table, text_bytes, words, written

END = b"\n"  # no word holds white space
CHUNKS = 64


@dataclass
class Units:
    """The most frequent words by hash (sorted), their counts and units. Units are the core's words, then
    the endings, then (once words are classed) each class's other words."""

    names: np.ndarray
    counts: np.ndarray
    unit: np.ndarray
    n_words: int
    n_forms: int
    whole: bool  # no word that is classed is missing from ``names``

    @property
    def size(self) -> int:
        return self.n_words + self.n_forms

    def of(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes: the place in ``names``, or -1 - k for the k-th of the other words; those and their endings."""
        h = hashes(tokens)
        pos = np.minimum(np.searchsorted(self.names, h), max(len(self.names) - 1, 0))
        kept = self.names[pos] == h if len(self.names) else np.zeros(len(h), bool)
        at = np.nonzero(~kept)[0]
        rare, first, back = np.unique(h[at], return_index=True, return_inverse=True)
        pos[at] = -1 - back
        return pos.astype(np.int32), rare.view(np.int64), endings([tokens[k] for k in at[first]], self.n_forms).astype(np.int32)


def endings(tokens: list[bytes], n_forms: int) -> np.ndarray:
    if not tokens:
        return np.empty(0, np.int64)
    last = np.frombuffer(b"".join([(b"  " + t)[-3:] for t in tokens]), np.uint8).reshape(-1, 3).astype(np.int64)
    return (last @ np.array([7919, 104729, 1299709]) >> 3) % n_forms


def tokens(text: bytes) -> list[bytes]:
    return [*words(text), END]


def word_counts(train: DataFrame, n_forms: int) -> DataFrame:
    """word (hash), form, n over all texts."""
    schema = pa.schema([("word", pa.int64()), ("form", pa.int32()), ("n", pa.int64())])

    def count(it: Batches) -> Batches:
        h, form, n = np.empty(0, np.uint64), np.empty(0, np.int32), np.empty(0, np.int64)

        def out() -> pa.RecordBatch:
            return batch(schema, [h.view(np.int64), form, n])

        for b in it:
            all_tokens = [w for t in text_bytes(b["text"]) for w in tokens(t)]
            got, first, times = np.unique(hashes(all_tokens), return_index=True, return_counts=True)
            forms = endings([all_tokens[k] for k in first], n_forms).astype(np.int32)
            h, at, back = np.unique(np.concatenate([h, got]), return_index=True, return_inverse=True)
            n = np.bincount(back, np.concatenate([n, times]), len(h)).astype(np.int64)
            form = np.concatenate([form, forms])[at]
            if len(h) > 1_000_000:  # bounds a task's memory; the rest is summed after the shuffle
                yield out()
                h, form, n = h[:0], form[:0], n[:0]
        if len(h):
            yield out()

    return train.mapInArrow(count, "word long, form int, n long").groupBy("word", "form").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names, endings and counts of the words with so high a count that at most ``most`` have it, the most
    frequent first: no sort of all words."""
    levels = counts.groupBy(F.floor(F.log2("n") * 32).alias("level")).agg(F.count("*").alias("k")).orderBy(F.desc("level")).collect()
    total, level = 0, None
    for r in levels:
        total += r["k"]
        if total > most:
            break
        level = r["level"]
    found = counts.where(F.floor(F.log2("n") * 32) >= level) if level is not None else counts.limit(0)
    t = found.select("word", "form", "n").toArrow()
    word, form, n = (t[c].to_numpy() for c in ("word", "form", "n"))
    order = np.lexsort((word, -n))
    return word[order].view(np.uint64), form[order].astype(np.int64), n[order]


CODED = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("train", pa.bool_()), ("codes", pa.binary()), ("rare", pa.binary()), ("forms", pa.binary())])


def coded(docs: DataFrame, units: Units) -> DataFrame:
    """Each text (doc_id, text, train) as codes (after an end token), with its words that aren't kept and their endings."""

    def run(it: Batches) -> Batches:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 36
        for b in it:
            out = []
            for doc, train, t in zip(b["doc_id"].to_pylist(), b["train"].to_pylist(), text_bytes(b["text"]), strict=True):
                c, rare, forms = units.of(tokens(t))
                out.append((row, doc, train, np.concatenate([c[-1:], c]).tobytes(), rare.tobytes(), forms.tobytes()))
                row += 1
            if out:
                yield batch(CODED, list(zip(*out, strict=True)))

    return written(docs.mapInArrow(run, "row long, doc_id long, train boolean, codes binary, rare binary, forms binary"), "coded")


def resolved(texts: DataFrame, counts: DataFrame) -> DataFrame:
    """Coded texts with ns and classes: the count (0: unknown) and the class (-1: none of its own) of each of
    their words that aren't kept."""
    place = pa.schema([("row", pa.int64()), ("k", pa.int32()), ("word", pa.int64())])
    gathered = pa.schema([("row", pa.int64()), ("ns", pa.binary()), ("classes", pa.binary())])

    def places(it: Batches) -> Batches:
        for b in it:
            words = [np.frombuffer(x, np.int64) for x in b["rare"].to_pylist()]
            n = np.array([len(x) for x in words], np.int64)
            if n.sum():
                first = np.repeat(np.cumsum(n) - n, n)
                yield batch(place, [np.repeat(b["row"].to_numpy(), n), (np.arange(n.sum()) - first).astype(np.int32), np.concatenate(words)])

    def gather(it: Batches) -> Batches:
        """Rows come sorted by row and k; one that goes on in the next batch waits for it."""
        held: list[np.ndarray] = []

        def out(row: np.ndarray, n: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
            at = np.nonzero(np.concatenate([[True], row[1:] != row[:-1]]))[0]
            ends = np.append(at[1:], len(row))
            return batch(gathered, [row[at], [n[i:j].tobytes() for i, j in zip(at, ends, strict=True)], [c[i:j].tobytes() for i, j in zip(at, ends, strict=True)]])

        for b in it:
            own = [b["row"].to_numpy(), b["n"].to_numpy(), b["cls"].to_numpy()]
            if not len(own[0]):
                continue
            held = [np.concatenate(x) for x in zip(held, own, strict=True)] if held else own
            cut = int(np.searchsorted(held[0], held[0][-1]))
            if cut:
                yield out(*(x[:cut] for x in held))
                held = [x[cut:] for x in held]
        if held:
            yield out(*held)

    rare = texts.select("row", "rare").mapInArrow(places, "row long, k int, word long")
    found = rare.join(counts.select("word", "n", "cls"), "word", "left").select("row", "k", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("cls", F.lit(-1)).alias("cls"))
    by_row = found.repartition("row").sortWithinPartitions("row", "k").mapInArrow(gather, "row long, ns binary, classes binary")
    out = texts.drop("rare").join(by_row, "row", "left")
    return written(out.select("doc_id", "train", "codes", "forms", F.coalesce("ns", F.lit(b"")).alias("ns"), F.coalesce("classes", F.lit(b"")).alias("classes")), "resolved")


def decoded(b: pa.RecordBatch, *columns: tuple[str, type]) -> tuple:
    """The codes of a batch in one array, where a text goes on from a token to the next, and what further columns
    hold of the texts' other words."""
    codes = [np.frombuffer(x, np.int32) for x in b["codes"].to_pylist()]
    held = [[np.frombuffer(x, kind) for x in b[c].to_pylist()] for c, kind in columns]
    n, k = np.array([len(x) for x in codes]), np.array([len(x) for x in held[0]])
    c = np.concatenate(codes)
    c = np.where(c < 0, c - np.repeat(np.cumsum(k) - k, n), c)
    goes_on = np.ones(len(c), bool)
    goes_on[np.cumsum(n) - 1] = False
    return c, goes_on[:-1], *map(np.concatenate, held)


FORMS, CLASSES = ("forms", np.int32), ("classes", np.int32)


def looked_up(c: np.ndarray, kept: np.ndarray, rare: np.ndarray) -> np.ndarray:
    """For each code what ``kept`` or ``rare`` holds for it."""
    out = np.empty(len(c), np.int64)
    is_rare = c < 0
    out[~is_rare], out[is_rare] = kept[c[~is_rare]], rare[-1 - c[is_rare]]
    return out


def bigrams(train: DataFrame, units: Units) -> np.ndarray:
    """How often each unit follows each one in coded texts, summed from compressed chunks of a fixed size."""
    size = units.size

    def pairs(b: pa.RecordBatch) -> np.ndarray:
        c, goes_on, forms = decoded(b, FORMS)
        u = looked_up(c, units.unit, units.n_words + forms)
        return (u[:-1] * size + u[1:])[goes_on]

    return table_of(train, pairs, size)


def table_of(train: DataFrame, pairs, size: int) -> np.ndarray:  # noqa: ANN001
    """A square table of how often ``pairs`` gives each number, over all batches."""
    schema = pa.schema([("chunk", pa.int32()), ("data", pa.binary())])
    span = -(-size * size // CHUNKS)

    def counted(it: Batches) -> Batches:
        total = np.zeros(span * CHUNKS, np.uint32)
        for b in it:
            if b.num_rows:
                at, n = np.unique(pairs(b), return_counts=True)
                total[at] += n.astype(np.uint32)
        c = zstandard.ZstdCompressor(level=1)
        for k in range(CHUNKS):
            part = total[k * span : (k + 1) * span]
            if part.any():
                yield batch(schema, [[k], [c.compress(part.tobytes())]])

    def added(it: Batches) -> Batches:
        totals: dict[int, np.ndarray] = {}
        d = zstandard.ZstdDecompressor()
        for b in it:
            for k, x in zip(b["chunk"].to_pylist(), b["data"].to_pylist(), strict=True):
                totals[k] = totals.get(k, np.zeros(span, np.int64)) + np.frombuffer(d.decompress(x), np.uint32)
        c = zstandard.ZstdCompressor(level=1)
        for k, x in totals.items():
            yield batch(schema, [[k], [c.compress(x.tobytes())]])

    kind = "chunk int, data binary"
    total, d = np.zeros(span * CHUNKS, np.int64), zstandard.ZstdDecompressor()
    for r in train.mapInArrow(counted, kind).repartition(CHUNKS, "chunk").mapInArrow(added, kind).toLocalIterator():
        total[r["chunk"] * span : (r["chunk"] + 1) * span] = np.frombuffer(d.decompress(bytes(r["data"])), np.int64)
    return total[: size * size].reshape(size, size)


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(n: np.ndarray, n_classes: int, rounds: int = 6) -> np.ndarray:
    """The class of each unit. Units start by frequency rank; each in turn goes to the class that gives
    the class bigrams the highest likelihood, until a round moves few."""
    size = len(n)
    total = n.sum(0) + n.sum(1)
    cls = np.empty(size, np.int64)
    cls[np.argsort(-total, kind="stable")] = np.arange(size) % n_classes
    n = n.astype(float)
    one = np.eye(n_classes)[cls]
    right, left = n @ one, n.T @ one  # unit to class that follows, class before to unit
    m = one.T @ right
    fm = _f(m)
    for _ in range(rounds):
        moved = 0
        for w in np.argsort(-total, kind="stable"):
            if not total[w]:
                continue
            c, own = cls[w], n[w, w]
            r, l = right[w].copy(), left[w].copy()  # noqa: E741
            r[c] -= own
            l[c] -= own
            m[c] -= r
            m[:, c] -= l
            m[c, c] -= own
            fm[c], fm[:, c] = _f(m[c]), _f(m[:, c])
            by_row, by_col = _f(m + r) - fm, _f(m + l[:, None]) - fm
            d = np.diag(m)
            gain = by_row.sum(1) - np.diag(by_row) + by_col.sum(0) - np.diag(by_col) + _f(d + r + l + own) - _f(d)
            rows, cols = m.sum(1) + l, m.sum(0) + r
            gain -= _f(rows + r.sum() + own) - _f(rows) + _f(cols + l.sum() + own) - _f(cols)
            best = int(np.argmax(gain))
            if gain[best] <= gain[c] + 1e-9:
                best = c
            m[best] += r
            m[:, best] += l
            m[best, best] += own
            fm[best], fm[:, best] = _f(m[best]), _f(m[:, best])
            if best != c:
                moved += 1
                cls[w] = best
                right[:, c] -= n[:, w]
                right[:, best] += n[:, w]
                left[:, c] -= n[w]
                left[:, best] += n[w]
        if moved <= size // 200:
            break
    return cls


CONTEXT = np.dtype([("word", "<i8"), ("at", "<i4"), ("start", "<i4"), ("n", "<i8")])


def summed(x: np.ndarray) -> np.ndarray:
    """Contexts sorted by word and place, equal ones added."""
    x = x[np.lexsort((x["at"], x["word"]))]
    if not len(x):
        return x
    new = np.nonzero(np.concatenate([[True], (x["word"][1:] != x["word"][:-1]) | (x["at"][1:] != x["at"][:-1])]))[0]
    out = x[new]
    out["n"] = np.add.reduceat(x["n"], new)
    return out


def best_classes(x: np.ndarray, m: np.ndarray, least: int, items: int = 1 << 14) -> tuple[np.ndarray, np.ndarray]:
    """The words that occur ``least`` times and, for each, the class in which the class bigrams ``m`` become
    likeliest when it alone leaves its start. Contexts (summed) are at k: class k before the word; at K + k:
    class k after it; at 2 * K: the word itself after it."""
    size = len(m)
    new = np.concatenate([[True], x["word"][1:] != x["word"][:-1]]) if len(x) else np.empty(0, bool)
    number = np.cumsum(new) - 1
    times = np.bincount(number, np.where((x["at"] < size) | (x["at"] == 2 * size), x["n"], 0), int(new.sum()))
    x = x[(times >= least)[number]]
    if not len(x):
        return np.empty(0, np.int64), np.empty(0, np.int32)
    begin = np.nonzero(np.concatenate([[True], x["word"][1:] != x["word"][:-1]]))[0]
    fm, f_rows, f_cols, diag = _f(m), m.sum(1), m.sum(0), np.diag(m)
    best, lo = [], 0
    ends = np.append(begin[1:], len(x))
    while lo < len(begin):
        hi = max(lo + 1, int(np.searchsorted(ends, begin[lo] + items, "right")))
        part, w = x[begin[lo] : ends[hi - 1]], np.repeat(np.arange(hi - lo), (ends - begin)[lo:hi])
        c, at, n, k = x["start"][begin[lo:hi]], part["at"], part["n"].astype(float), np.arange(hi - lo)
        sides = np.zeros((hi - lo, 2 * size + 1))
        sides[w, at] = n
        l, r, own = sides[:, :size], sides[:, size : 2 * size], sides[:, -1]  # noqa: E741
        gain = np.zeros((hi - lo, size))
        for here, table, f_table, other in ((at // size == 1, m.T, fm.T, l), (at < size, m, fm, r)):
            here &= at < 2 * size
            y, v, of = at[here] % size, n[here], w[here]
            base, f_base = table[y], f_table[y]
            j = np.arange(len(y))
            base[j, c[of]] -= v
            same = np.nonzero(y == c[of])[0]
            base[same] -= other[of[same]]
            base[same, c[of[same]]] -= own[of[same]]
            f_base[j, c[of]] = _f(base[j, c[of]])
            f_base[same] = _f(base[same])
            d = _f(base + v[:, None]) - f_base
            d[j, y] = 0  # the diagonal follows
            first = np.nonzero(np.concatenate([[True], of[1:] != of[:-1]]))[0] if len(of) else np.empty(0, np.int64)
            if len(of):
                gain[of[first]] += np.add.reduceat(d, first)
        d, rows, cols = (np.repeat(z[None], hi - lo, 0) for z in (diag, f_rows, f_cols))
        d[k, c] -= r[k, c] + l[k, c] + own
        rows[k, c] -= r.sum(1) + own
        cols[k, c] -= l.sum(1) + own
        gain += _f(d + r + l + own[:, None]) - _f(d)
        gain -= _f(rows + (r.sum(1) + own)[:, None]) - _f(rows) + _f(cols + (l.sum(1) + own)[:, None]) - _f(cols)
        to = gain.argmax(1)
        best.append(np.where(gain[k, to] > gain[k, c] + 1e-9, to, c))
        lo = hi
    return x["word"][begin], np.concatenate(best).astype(np.int32)


def classed(train: DataFrame, units: Units, cls: np.ndarray, m: np.ndarray, least: int) -> DataFrame:
    """word, cls for every word outside the core that occurs ``least`` times in the coded texts."""
    size = len(m)
    parts = max(int(train.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    schema, kind = pa.schema([("part", pa.int32()), ("data", pa.binary())]), "part int, data binary"
    result = pa.schema([("word", pa.int64()), ("cls", pa.int32())])

    def contexts(it: Batches) -> Batches:
        names, start = units.names.view(np.int64), cls[units.unit]
        wanted = (units.unit >= units.n_words) & (units.counts >= least)
        z, held, rows = zstandard.ZstdCompressor(level=1), [], 0

        def out() -> Batches:
            x = summed(np.concatenate(held))
            part = np.ascontiguousarray(x["word"]).view(np.uint64) % np.uint64(parts)
            order = np.argsort(part, kind="stable")
            at = np.searchsorted(part[order], np.arange(parts + 1))
            for k in np.nonzero(np.diff(at))[0]:
                yield batch(schema, [[k], [z.compress(x[order[at[k] : at[k + 1]]].tobytes())]])

        for b in it:
            if not b.num_rows:
                continue
            c, goes_on, rare, forms = decoded(b, ("rare", np.int64), FORMS)
            w, k = looked_up(c, names, rare), looked_up(c, start, cls[units.n_words + forms])
            tail = looked_up(c, wanted, np.full(len(rare), not units.whole)).astype(bool)
            same = w[1:] == w[:-1]
            left, right, own = (np.nonzero(goes_on & y)[0] for y in (tail[1:] & ~same, tail[:-1] & ~same, tail[1:] & same))
            x = np.empty(len(left) + len(right) + len(own), CONTEXT)
            x["word"] = np.concatenate([w[left + 1], w[right], w[own]])
            x["at"] = np.concatenate([k[left], size + k[right + 1], np.full(len(own), 2 * size)])
            x["start"] = np.concatenate([k[left + 1], k[right], k[own]])
            x["n"] = 1
            held.append(summed(x))
            rows += len(held[-1])
            if rows > 2_000_000:  # bounds a task's memory
                yield from out()
                held, rows = [], 0
        if rows:
            yield from out()

    def chosen(it: Batches) -> Batches:
        d, held = zstandard.ZstdDecompressor(), {}
        for b in it:
            for k, x in zip(b["part"].to_pylist(), b["data"].to_pylist(), strict=True):
                held.setdefault(k, []).append(x)
        for k in list(held):
            x = summed(np.concatenate([np.frombuffer(d.decompress(y), CONTEXT) for y in held.pop(k)]))
            yield batch(result, list(best_classes(x, m, least)))

    return written(train.mapInArrow(contexts, kind).repartition(parts, "part").mapInArrow(chosen, "word long, cls int"), "classed")


def class_of(forms: np.ndarray, classes: np.ndarray, cls: np.ndarray, units: Units) -> np.ndarray:
    """The classes of words that aren't kept: their own, else those of their endings."""
    return np.where(classes >= 0, classes, cls[units.n_words + forms])


def class_bigrams(train: DataFrame, units: Units, cls: np.ndarray, size: int) -> np.ndarray:
    """How often each class follows each one in the resolved texts."""
    local = cls[units.unit]

    def pairs(b: pa.RecordBatch) -> np.ndarray:
        c, goes_on, forms, classes = decoded(b, FORMS, CLASSES)
        k = looked_up(c, local, class_of(forms, classes, cls, units))
        return (k[:-1] * size + k[1:])[goes_on]

    return table_of(train, pairs, size)


@dataclass
class Model:
    units: Units
    cls: np.ndarray
    log_step: np.ndarray  # [class before, class]
    log_unit: np.ndarray  # P(unit | class)
    log_form: np.ndarray  # of the denominators of P(word | form)
    total: int
    distinct: int


DELTA = 0.5  # added to a word's count within its form


def fit(docs: DataFrame, train: "F.Column | None" = None, n_words: int = 1536, n_forms: int = 512, n_classes: int | None = None, most_kept: int = 1 << 18, least: int = 4) -> tuple[Model, DataFrame, DataFrame]:
    """The model learned from the ``docs`` (doc_id, text) that are ``train`` (all if it isn't given); the written
    counts of all words (word, form, n, and cls where a word outside the core is classed); and all of ``docs`` ready to be scored."""
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text", (F.lit(True) if train is None else F.coalesce(train, F.lit(False))).alias("train"))
    counts = written(word_counts(docs.where("train"), n_forms), "counts")
    often = counts.where(F.col("n") >= least).count()
    n_classes = n_classes or max(64, int(2 * often ** (1 / 3)))
    names, forms, times = most_frequent(counts, most_kept)
    order = np.argsort(names)
    number = np.where(np.arange(len(names)) < n_words, np.arange(len(names)), n_words + forms)
    units = Units(names[order], times[order], number[order], n_words, n_forms, int((times >= least).sum()) == often)
    own = np.zeros(n_words)
    own[: len(names)] = times[:n_words]
    core = forms[:n_words]
    texts = coded(docs, units)
    of_train = texts.where("train")
    n = bigrams(of_train, units)
    cls = exchange(n, n_classes)
    one = np.eye(n_classes)[cls]
    known = classed(of_train, units, cls, one.T @ n @ one, least)
    counts = written(counts.join(known, "word", "left"), "counts")
    # kept words that came to a class are in its last unit
    for b in kept_only(known, units.names).toArrow().to_batches():
        at = np.searchsorted(units.names, b["word"].to_numpy().view(np.uint64))
        units.unit[at] = units.size + b["cls"].to_numpy()
    cls = np.concatenate([cls, np.arange(n_classes)])
    ready = resolved(texts, counts)
    m = class_bigrams(ready.where("train"), units, cls, n_classes)
    words_in, tokens_in = np.zeros(len(cls)), np.zeros(len(cls))
    for r in counts.groupBy("form", "cls").agg(F.sum("n").alias("n"), F.count("*").alias("k")).collect():
        at = n_words + r["form"] if r["cls"] is None else units.size + r["cls"]
        words_in[at] += r["k"]
        tokens_in[at] += r["n"]
    total, distinct = int(tokens_in.sum()), int(words_in.sum())
    np.subtract.at(words_in, n_words + core, 1)
    np.subtract.at(tokens_in, n_words + core, own[: len(core)])
    freq = tokens_in.copy()
    freq[:n_words] = own
    one = np.eye(n_classes)[cls]
    per_class = one.T @ freq
    prior = (per_class + 1) / (per_class.sum() + n_classes)
    step = (m + 100 * prior) / (m.sum(1, keepdims=True) + 100)
    added = np.where((np.arange(len(cls)) < units.size) | (words_in > 0), 0.5, 0)  # none to a class without further words
    unit = (freq + added) / np.maximum(per_class + one.T @ added, 0.5)[cls]
    log_form = np.zeros(len(cls))
    log_form[n_words : units.size] = np.log10(tokens_in + DELTA * (words_in + 1))[n_words : units.size]
    log_form[units.size :] = np.log10(np.maximum(tokens_in + DELTA * words_in, 1))[units.size :]
    return Model(units, cls, np.log10(step), np.log10(np.maximum(unit, 1e-300)), log_form, total, distinct), counts, ready


def kept_only(known: DataFrame, names: np.ndarray) -> DataFrame:
    """The rows of ``known`` whose word is among the sorted ``names``."""
    schema = pa.schema([("word", pa.int64()), ("cls", pa.int32())])

    def run(it: Batches) -> Batches:
        for b in it:
            w = b["word"].to_numpy().view(np.uint64)
            if len(w) and len(names):
                here = names[np.minimum(np.searchsorted(names, w), len(names) - 1)] == w
                yield batch(schema, [b["word"].filter(pa.array(here)), b["cls"].filter(pa.array(here))])

    return known.mapInArrow(run, "word long, cls int")


def prepared(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """Other texts (doc_id, text) than those ``fit`` was given, ready to be scored."""
    return resolved(coded(docs.select("doc_id", "text", F.lit(False).alias("train")), model.units), counts)


def score(ready: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity for each row made ready."""
    small_batches(ready.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
    log_all = math.log10(model.total + model.distinct + 1)
    units, cls, emitted = model.units, model.cls, model.log_unit - model.log_form

    def run(it: Batches) -> Batches:
        of_kept = cls[units.unit]
        own_kept = emitted[units.unit] + np.where(units.unit >= units.n_words, np.log10(units.counts + DELTA), 0)
        base_kept = np.log10(units.counts + 1)
        for b in it:
            if not b.num_rows:
                continue
            c, goes_on, forms, classes, ns = decoded(b, FORMS, CLASSES, ("ns", np.int64))
            # in a class of its own a word is in the class's last unit
            own = emitted[np.where(classes >= 0, units.size + classes, units.n_words + forms)] + np.log10(ns + DELTA)
            k = looked_up(c, of_kept, class_of(forms, classes, cls, units))
            ends = np.append(np.nonzero(~goes_on)[0], len(c) - 1)
            text = np.repeat(np.arange(len(ends)), np.diff(np.append(-1, ends)))[1:][goes_on]  # of each token but the first, which isn't one
            rare, at = c < 0, np.concatenate([[False], goes_on])
            per = np.empty((3, len(c)))
            per[0, ~rare], per[0, rare] = base_kept[c[~rare]], np.log10(ns + 1)[-1 - c[rare]]
            per[1, ~rare], per[1, rare] = own_kept[c[~rare]], own[-1 - c[rare]]
            per[2, ~rare], per[2, rare] = 1, (ns > 0)[-1 - c[rare]]
            per[1, 1:] += model.log_step[k[:-1], k[1:]]
            base, total, known = (np.bincount(text, x[at], len(ends)) for x in per)
            n = np.bincount(text, minlength=len(ends))
            yield batch(schema, [b["doc_id"], n, known.astype(np.int64), base - n * log_all, total])

    kind = "doc_id long, n_tokens long, n_known long, base_score double, score double"
    out = ready.mapInArrow(run, kind).select("doc_id", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def held_out() -> "F.Column":
    return remainder("doc_id", 7) == 2


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(table(spark, sf_dir, "documents"))
    model, _, ready = fit(docs, ~held_out())
    return score(ready, model).select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
