"""N-gram Jaccard join by multiple-global-order filtering.

A document's set is that of its distinct word shingles, as 64-bit hashes. Two sets of similarity ``t``
or more share a token among the first ``n - ceil(t*n) + 1`` tokens of each, whatever total order of
all tokens is taken. Three orders are used: rare tokens first (by hashed counts over all documents,
a table of fixed size; ties by hash), least hash first, greatest hash first. Pairs come from blocks of
the first order; the prefixes under the other two orders travel as a signature of each set, and a pair
must share a token of both before any set is fetched and compared exactly.

Blocks also go by length: a set is filed under its length's range, and under the next one if a set that
much longer may lie there. The signature further holds a parity bitmap (bits flip with each token that
hashes to them, so at most as many bits differ as tokens do), which is as exact as the prefixes. A signature is
a small part of a set in size; only survivors' sets are fetched.

Copies are one class (equal sets); classes are joined. Pairs within a block are not all written out:
first each block's members are paired with one of them (a star), links unite components, and only
blocks that still hold several components give further pairs, across components alone, so that no link
between different components is lost. Small blocks give them all; large ones, joined where they share members, are
gone through by signatures in tiles, from which those pairs leave that pass all filters: first a few for
any two components, then, where these didn't link, the others. Hot tokens' blocks are split by a
salt; the stars' centres meet in a second pass.

Defined cases: a document without words or text has an empty set, links with nothing and is its own
component; fewer words than the width are one shingle; a null id is carried but links with nothing;
repeated ids with different texts count as one document that has both sets, so ``class_components`` links these
(``survivors`` doesn't); an empty table gives no rows; other columns aren't carried."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Batches, batch, documents, mixed, shingles, small_batches, table, text_bytes, written
from .components import components

BUCKETS, CHUNKS = 1 << 22, 64
SPAN = BUCKETS // CHUNKS
HOT = 2000  # documents in a block, by the hashed counts, from which it is split


def set_id(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def prefix(n: int, num: int, den: int) -> int:
    """Length of a prefix that sets of similarity num/den share a token of."""
    return n - -(-num * n // den) + 1


def parity(s: np.ndarray) -> bytes:
    """A bitmap of a power of two of bits, the set's size or more: each token flips one bit."""
    bits = max(64, 1 << max(len(s) - 1, 0).bit_length())
    at = np.bincount((s * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(65 - bits.bit_length())).astype(np.int64), minlength=bits)
    return np.packbits((at & 1).astype(bool)).tobytes()


def may_link(a: bytes, b: bytes, most: int) -> bool:
    """Whether bitmaps differ in at most ``most`` bits; the longer is folded upon itself first."""
    u, v = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(u) < len(v):
        u, v = v, u
    while len(u) > len(v):  # neighbouring bits fold into one, as the slot is the hash's leading bits
        pairs = np.unpackbits(u)
        u = np.packbits(pairs[::2] ^ pairs[1::2])
    return int(np.bitwise_count(u ^ v).sum()) <= most


def ranges_of(n: int, num: int, den: int, width: int = 3) -> list[int]:
    """The length range of a set, and the next one where a set to link with may lie."""
    x = math.log(n) / math.log(den / num)
    k = int(x // width)
    return [k, k + 1] if x - k * width >= width - 1 - 1e-6 else [k]


SIGNED = [("bits", pa.binary()), ("second", pa.binary()), ("third", pa.binary())]


def signature(s: np.ndarray, num: int, den: int) -> tuple[bytes, bytes, bytes]:
    """The parity bitmap, and 32 bits of each token of the prefixes under the second and the third order."""
    p = prefix(len(s), num, den)
    return parity(s), np.unique(s[:p].astype(np.uint32)).tobytes(), np.unique(s[-p:].astype(np.uint32)).tobytes()


def shared(a: bytes, b: bytes) -> bool:
    """Whether two prefixes have a token in common."""
    u, v = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
    if len(u) > len(v):
        u, v = v, u
    return bool((v[np.minimum(np.searchsorted(v, u), len(v) - 1)] == u).any())


def first_pass(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """doc_id, mark, n, cid and signature for each document; and rows with chunk and data: hashed counts of shingles."""
    schema = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("n", pa.int64()), ("cid", pa.int64()), *SIGNED, ("chunk", pa.int32()), ("data", pa.binary())])

    def run(it: Batches) -> Batches:
        total = np.zeros(BUCKETS, np.uint32)
        for b in it:
            sets = [shingles(t, width) for t in text_bytes(b["text"])]
            at, times = np.unique(np.concatenate([*sets, np.empty(0, np.uint64)]) >> np.uint64(42), return_counts=True)
            total[at] += times.astype(np.uint32)
            k = len(sets)
            signed = [signature(s, num, den) if len(s) else (None, None, None) for s in sets]
            yield batch(schema, [b["doc_id"], b["mark"], [len(s) for s in sets], [set_id(s) if len(s) else None for s in sets], *([x[j] for x in signed] for j in range(3)), [None] * k, [None] * k])
        c = zstandard.ZstdCompressor(level=1)
        for k in range(CHUNKS):
            part = total[k * SPAN : (k + 1) * SPAN]
            if part.any():
                yield batch(schema, [[None]] * 7 + [[k], [c.compress(part.tobytes())]])

    return written(docs.mapInArrow(run, "doc_id long, mark long, n long, cid long, bits binary, second binary, third binary, chunk int, data binary"), "sets")


def frequencies(first: DataFrame) -> tuple[np.ndarray, float]:
    """8 * log2 of the hashed counts, one byte a bucket (a fixed size, however large the input), and
    what other tokens in a bucket can be taken to add to one's count: twice the mean."""
    kind, schema = "chunk int, data binary", pa.schema([("chunk", pa.int32()), ("data", pa.binary())])

    def added(it: Batches) -> Batches:
        d, totals = zstandard.ZstdDecompressor(), {}
        for b in it:
            for k, x in zip(b["chunk"].to_pylist(), b["data"].to_pylist(), strict=True):
                totals[k] = totals.get(k, np.zeros(SPAN, np.int64)) + np.frombuffer(d.decompress(x), np.uint32)
        for k, x in totals.items():
            yield batch(schema, [[k], [np.minimum(8 * np.log2(1 + x), 255).astype(np.uint8).tobytes()]])

    out = np.zeros(BUCKETS, np.uint8)
    for r in first.where("chunk is not null").select("chunk", "data").repartition(CHUNKS, "chunk").mapInArrow(added, kind).collect():
        out[r["chunk"] * SPAN : (r["chunk"] + 1) * SPAN] = np.frombuffer(bytes(r["data"]), np.uint8)
    return out, 2 * float(np.mean(np.exp2(out / 8) - 1))


def blocks(docs: DataFrame, freq, width: int, num: int, den: int) -> DataFrame:  # noqa: ANN001
    """token (with its length range), salt, cid, n for the prefix of each set under the first order; copies
    within a partition once."""
    schema = pa.schema([("token", pa.int64()), ("salt", pa.int32()), ("cid", pa.int64()), ("n", pa.int32())])

    def run(it: Batches) -> Batches:
        (q, even), seen = freq.value, set()
        for b in it:
            cols: list[list[np.ndarray]] = [[], [], [], []]
            for t in text_bytes(b["text"]):
                s = shingles(t, width)
                n, cid = len(s), set_id(s)
                if not n or cid in seen:
                    continue
                seen.add(cid)
                f = q[s >> np.uint64(42)]
                at = np.argsort(f, kind="stable")[: prefix(n, num, den)]
                docs_in = np.exp2(f[at] / 8) - even
                salt = np.where(docs_in >= HOT, cid % np.maximum(docs_in // (HOT // 2), 1).astype(np.int64), -1).astype(np.int32)
                for k in ranges_of(n, num, den):
                    cols[0].append(mixed(s[at] + np.uint64(k) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64))
                    cols[1].append(salt)
                    cols[2].append(np.full(len(at), cid))
                    cols[3].append(np.full(len(at), n, np.int32))
            if len(seen) > 200_000:
                seen.clear()
            if cols[0]:
                yield batch(schema, [np.concatenate(c) for c in cols])

    return docs.mapInArrow(run, "token long, salt int, cid long, n int")


def stars(rows: DataFrame) -> DataFrame:
    """token, salt, a, na, b, nb: each member b of a block with its centre a, the member of least id.
    Rows stream through sorted, so a block of any size takes no memory."""
    schema = pa.schema([("token", pa.int64()), ("salt", pa.int32()), ("a", pa.int64()), ("na", pa.int32()), ("b", pa.int64()), ("nb", pa.int32())])

    def run(it: Batches) -> Batches:
        last = None
        for batch_in in it:
            t, s, c, n = (batch_in[k].to_numpy(zero_copy_only=False) for k in ("token", "salt", "cid", "n"))
            if not len(t):
                continue
            again = last is not None
            if again:
                t, s, c, n = (np.concatenate([[x], y]).astype(y.dtype) for x, y in zip(last, (t, s, c, n), strict=True))
            new = np.concatenate([[True], (t[1:] != t[:-1]) | (s[1:] != s[:-1])])
            centre = np.maximum.accumulate(np.where(new, np.arange(len(t)), 0))
            fresh = np.concatenate([[True], new[1:] | (c[1:] != c[:-1])])  # a copy from another partition isn't
            fresh[0] &= not again
            keep = fresh & ((c != c[centre]) | new & (s >= 0))  # centres of split blocks meet again
            at = centre[-1]
            if keep.any():
                k = np.nonzero(keep)[0]
                yield batch(schema, [t[k], s[k], c[centre[k]], n[centre[k]], c[k], n[k]])
            last = (t[at], s[at], c[at], n[at])

    parts = rows.repartition("token", "salt").sortWithinPartitions("token", "salt", "cid")
    return parts.mapInArrow(run, "token long, salt int, a long, na int, b long, nb int")


def plausible(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose signatures allow a link: parity bitmaps, then the second and third orders' prefixes."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    parts = [f"{c}{x}" for x in ("bits", "second", "third") for c in "ab"]

    def run(it: Batches) -> Batches:
        for x in it:
            most = (den - num) * (x["na"].to_numpy() + x["nb"].to_numpy()) // (den + num)
            kept = [
                (a, b) for a, b, m, pa_, pb, sa, sb, ta, tb in zip(x["a"].to_pylist(), x["b"].to_pylist(), most.tolist(), *(x[c].to_pylist() for c in parts), strict=True)
                if may_link(pa_, pb, m) and shared(sa, sb) and shared(ta, tb)
            ]
            if kept:
                yield batch(schema, list(zip(*kept, strict=True)))

    side = lambda c: classes.select(F.col("cid").alias(c), F.col("n").alias(f"n{c}"), *(F.col(x).alias(f"{c}{x}") for x in ("bits", "second", "third")))
    return pairs.select("a", "b").join(side("b"), "b").join(side("a"), "a").select("a", "b", "na", "nb", *parts).mapInArrow(run, "a long, b long")


def similar(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets pass the exact test."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(it: Batches) -> Batches:
        for x in it:
            kept = []
            for a, b, sa, sb in zip(x["a"].to_pylist(), x["b"].to_pylist(), x["sa"].to_pylist(), x["sb"].to_pylist(), strict=True):
                u, v = np.frombuffer(sa, np.uint64), np.frombuffer(sb, np.uint64)
                both = len(np.intersect1d(u, v, assume_unique=True))
                if den * both >= num * (len(u) + len(v) - both):
                    kept.append((a, b))
            if kept:
                yield batch(schema, list(zip(*kept, strict=True)))

    with_b = pairs.join(sets.select(F.col("cid").alias("b"), F.col("data").alias("sb")), "b")
    both = with_b.join(sets.select(F.col("cid").alias("a"), F.col("data").alias("sa")), "a")
    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def bloom_of(ids: DataFrame) -> np.ndarray:
    """A Bloom filter of 2**26 bits of the column doc_id, or'ed together from compressed chunks."""
    kind, schema = "chunk int, data binary", pa.schema([("chunk", pa.int32()), ("data", pa.binary())])

    def marked(it: Batches) -> Batches:
        own = np.zeros(BLOOM_BITS, bool)
        for b in it:
            own[slots(b["doc_id"].to_numpy(zero_copy_only=False)).ravel()] = True
        parts = np.split(np.packbits(own), CHUNKS)
        yield batch(schema, [range(CHUNKS), [zstandard.compress(x.tobytes(), 1) for x in parts]])

    def joined(it: Batches) -> Batches:
        totals: dict[int, np.ndarray] = {}
        for b in it:
            for k, x in zip(b["chunk"].to_pylist(), b["data"].to_pylist(), strict=True):
                part = np.frombuffer(zstandard.decompress(x), np.uint8)
                totals[k] = totals[k] | part if k in totals else part
        for k, x in totals.items():
            yield batch(schema, [[k], [zstandard.compress(x.tobytes(), 1)]])

    whole = np.zeros((CHUNKS, BLOOM_BITS // 8 // CHUNKS), np.uint8)
    for r in ids.select("doc_id").mapInArrow(marked, kind).repartition(CHUNKS, "chunk").mapInArrow(joined, kind).collect():
        whole[r["chunk"]] = np.frombuffer(zstandard.decompress(bytes(r["data"])), np.uint8)
    return whole.ravel()


BLOOM_BITS = 1 << 26


def slots(ids: np.ndarray) -> np.ndarray:
    x = ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return np.stack([x >> np.uint64(38), (x * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(38)], 1).astype(np.int64)


def sets_of(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """cid, data of the documents ``wanted`` (doc_id, cid). A Bloom filter of a fixed size lets most
    others go before their texts are cut; what passes besides is dropped by the join."""
    bloom = docs.sparkSession.sparkContext.broadcast(bloom_of(wanted))
    result = pa.schema([("doc_id", pa.int64()), ("cid", pa.int64()), ("data", pa.binary())])

    def cut(it: Batches) -> Batches:
        held = np.unpackbits(bloom.value).view(bool)
        for b in it:
            ids = b["doc_id"].to_numpy(zero_copy_only=False)
            k = np.nonzero(held[slots(ids)].all(1))[0]
            if len(k):
                sets = [shingles(t, width) for t in text_bytes(b["text"].take(pa.array(k)))]
                yield batch(result, [ids[k], [set_id(s) for s in sets], [s.tobytes() for s in sets]])

    found = docs.mapInArrow(cut, "doc_id long, cid long, data binary")
    # repeated ids can give a set twice: aggregated, not windowed
    return found.join(wanted, ["doc_id", "cid"]).groupBy("cid").agg(F.first("data").alias("data"))


def small_pairs(rows: DataFrame, num: int, den: int) -> DataFrame:
    """a, b: pairs across components in blocks of at most SMALL members. rows: token, cid, n, root."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(it: Batches) -> Batches:
        block: list[tuple] = []

        def pairs(block: list[tuple]) -> list[tuple]:
            return [(min(x[1], y[1]), max(x[1], y[1])) for k, x in enumerate(block) for y in block[:k] if x[3] != y[3] and max(x[2], y[2]) * num <= min(x[2], y[2]) * den]

        for b in it:
            out: set[tuple] = set()
            for x in zip(*(b[k].to_pylist() for k in ("token", "cid", "n", "root")), strict=True):
                if block and block[0][0] != x[0]:
                    out.update(pairs(block))
                    block = []
                block.append(x)
            if out:
                yield batch(schema, list(zip(*sorted(out), strict=True)))
        if found := pairs(block):
            yield batch(schema, list(zip(*found, strict=True)))

    return rows.repartition("token").sortWithinPartitions("token", "cid").mapInArrow(run, "a long, b long").distinct()


def folded(bits: np.ndarray, to: int) -> np.ndarray:
    """Rows of bitmaps folded upon themselves to ``to`` bytes: neighbouring bits become one."""
    while bits.shape[1] > to:
        x = np.unpackbits(bits, axis=1)
        bits = np.packbits(x[:, ::2] ^ x[:, 1::2], axis=1)
    return bits


def close_pairs(n: np.ndarray, root: np.ndarray, bits: list[bytes], part: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows across components whose lengths and parity bitmaps allow a link: within the one part, or
    of the one part with the other."""
    sizes = np.array([len(x) for x in bits])
    groups = [(z, p, np.nonzero((sizes == z) & (part == p))[0]) for z in np.unique(sizes) for p in np.unique(part)]
    two, out = len(np.unique(part)) > 1, [(np.empty(0, int), np.empty(0, int))]
    rows = {g: np.frombuffer(b"".join([bits[k] for k in at]), np.uint8).reshape(len(at), z) for g, (z, _, at) in enumerate(groups)}
    for g, (z, p, at) in enumerate(groups):
        for h, (y, q, to) in enumerate(groups):
            if not len(at) or not len(to) or (p >= q if two else g > h):
                continue
            u, v = (np.ascontiguousarray(folded(rows[x], min(z, y))).view(np.uint64) for x in (g, h))
            step = max(1, (1 << 25) // max(v.size * 8, 1))
            for lo in range(0, len(at), step):
                far = np.bitwise_count(u[lo : lo + step, None] ^ v[None]).sum(2, dtype=np.int32)
                na, nb = n[at[lo : lo + step], None], n[to][None]
                ok = (far <= (den - num) * (na + nb) // (den + num)) & (np.maximum(na, nb) * num <= np.minimum(na, nb) * den) & (root[at[lo : lo + step], None] != root[to][None])
                k, j = np.nonzero(ok)
                k, j = at[lo + k], to[j]
                keep = (k < j) | two | (g != h)
                out.append((k[keep], j[keep]))
    return tuple(map(np.concatenate, zip(*out, strict=True)))


def tile_pairs(members: DataFrame, classes: DataFrame, num: int, den: int, few: int | None) -> DataFrame:
    """a, b, more: pairs across components within the teams of large blocks (members: team, cid, root) whose signatures
    allow a link; of any two components' in a tile at most ``few``, and whether there are more. A team's
    members are dealt into parts by hash, and each pair of parts is a task."""
    sized = members.join(classes.select("cid", "n", "bits", "second", "third"), "cid")
    teams = sized.groupBy("team").agg(F.count("*").alias("g"), F.sum(F.length("bits") + F.length("second") + F.length("third")).alias("bytes"))
    k = F.greatest(F.ceil(F.col("g") / TILE), F.ceil(F.col("bytes") / (4 << 20))).cast("int")
    dealt = sized.join(teams.select("team", k.alias("k")), "team").withColumn("part", F.pmod(F.xxhash64("cid"), F.col("k")).cast("int"))
    own = ("team", "cid", "n", "root", "bits", "second", "third", "part")
    tiles = dealt.select(*own, F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other")).select(*own, F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("more", pa.bool_())])

    def compare(t: pa.Table) -> pa.Table:
        cid, root = t["cid"].to_numpy(), np.unique(t["root"].to_numpy(), return_inverse=True)[1]
        bits, second, third = (t[c].to_pylist() for c in ("bits", "second", "third"))
        i, j = t["i"][0].as_py(), t["j"][0].as_py()
        part = t["part"].to_numpy()
        u, v = close_pairs(t["n"].to_numpy(), root, bits, part, num, den) if i == j or len(np.unique(part)) > 1 else (np.empty(0, int),) * 2
        more = np.zeros(len(u), bool)
        if few is not None and len(u):
            key = np.minimum(root[u], root[v]) * (root.max() + 1) + np.maximum(root[u], root[v])
            order = np.argsort(key, kind="stable")
            u, v, key = u[order], v[order], key[order]
            first = np.concatenate([[True], key[1:] != key[:-1]])
            rank = np.arange(len(key)) - np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))
            more = np.append(rank[1:] >= few, False) & (rank == few - 1)
            u, v, more = u[rank < few], v[rank < few], more[rank < few]
        ok = np.array([m or shared(second[x], second[y]) and shared(third[x], third[y]) for x, y, m in zip(u, v, more, strict=True)], bool)
        u, v, more = u[ok], v[ok], more[ok]
        return pa.Table.from_arrays([pa.array(np.minimum(cid[u], cid[v])), pa.array(np.maximum(cid[u], cid[v])), pa.array(more)], schema=schema)

    return tiles.groupBy("team", "i", "j").applyInArrow(compare, "a long, b long, more boolean")


SMALL, TILE, FEW = 48, 4096, 32


def joined(docs: DataFrame, width: int, num: int, den: int, by_id: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of ``docs`` (doc_id, text, mark): each row's class (doc_id, mark, n, cid); the classes (cid, doc_id); and the roots
    (node, root) of those that have links. ``by_id`` links texts under one id."""
    spark = docs.sparkSession
    small_batches(spark)
    first = first_pass(docs, width, num, den)
    of_doc = first.where("chunk is null").select("doc_id", "mark", "n", "cid")
    usable_rows = first.where("cid is not null and doc_id is not null")
    reps = written(usable_rows.groupBy("cid").agg(F.min("doc_id").alias("doc_id"), *(F.first(c).alias(c) for c in ("n", "bits", "second", "third"))), "classes")
    freq = spark.sparkContext.broadcast(frequencies(first))
    usable = docs.where("doc_id is not null").select("doc_id", "text")
    near = F.greatest("na", "nb") * num <= F.least("na", "nb") * den
    one = written(stars(blocks(usable, freq, width, num, den)), "stars")
    split = one.where("salt >= 0 and a = b")
    two = stars(split.select("token", F.lit(-1).alias("salt"), F.col("a").alias("cid"), F.col("na").alias("n")))
    rows = one.where("a <> b").unionByName(two)
    tested = written(rows.where(near).select("a", "b").distinct(), "pairs")
    good = written(plausible(tested, reps, num, den), "plausible")
    ends = lambda df: df.select(F.explode(F.array("a", "b")).alias("cid")).distinct()

    def linked(pairs: DataFrame) -> DataFrame:
        sets = written(sets_of(usable, reps.join(ends(pairs), "cid").select("doc_id", "cid"), width), "data")
        return similar(pairs, sets, num, den)

    links = linked(good)
    if by_id:  # texts under one id are one document
        named = of_doc.where("cid is not null and doc_id is not null").select("doc_id", "cid")
        twice = named.groupBy("doc_id").agg(F.min("cid").alias("a"), F.max("cid").alias("b")).where("a <> b").select("doc_id", "a")
        links = links.unionByName(named.join(twice, "doc_id").where("a <> cid").select("a", F.col("cid").alias("b")))
    links = written(links, "links")
    roots = components(links)
    # blocks that still hold several components
    ra, rb = roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    named = rows.join(ra, "a", "left").join(rb, "b", "left").withColumn("ra", F.coalesce("ra", "a")).withColumn("rb", F.coalesce("rb", "b"))
    open_tokens = named.groupBy("token").agg(F.count("*").alias("m"), F.max((F.col("ra") != F.col("rb")).cast("int")).alias("open")).where("open = 1").select("token", "m")
    side = lambda c, n, r: F.struct(F.col(c).alias("cid"), F.col(n).alias("n"), F.col(r).alias("root"))
    left = written(named.join(open_tokens, "token").select("token", "m", "a", "b", F.explode(F.array(side("a", "na", "ra"), side("b", "nb", "rb"))).alias("x")).select("token", "m", "a", "b", "x.*"), "open")
    few = left.where(F.col("m") < SMALL).select("token", "cid", "n", "root").distinct()
    more = plausible(small_pairs(few, num, den).join(tested, ["a", "b"], "left_anti"), reps, num, den)
    many = left.where(F.col("m") >= SMALL)
    members = written(many.select("cid", "root").distinct().join(components(many.select("a", "b")).select(F.col("node").alias("cid"), F.col("root").alias("team")), "cid"), "members")
    tiles = written(tile_pairs(members, reps, num, den, FEW), "tiles")
    more = written(more.unionByName(tiles.select("a", "b").join(tested, ["a", "b"], "left_anti")).distinct(), "plausible")
    links = written(links.unionByName(linked(more)), "links")
    roots = components(links)
    # components whose first pairs didn't unite them: all other pairs of theirs, in their teams
    cut = tiles.where("more").select("a", "b")
    for c in ("a", "b"):
        cut = cut.join(roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")), c, "left").withColumn(f"r{c}", F.coalesce(f"r{c}", c))
    cut = written(cut.where("ra <> rb").select(F.col("a").alias("cid")).distinct(), "cut")
    if not cut.isEmpty():
        now = members.join(members.join(cut, "cid", "left_semi").select("team").distinct(), "team", "left_semi").drop("root")
        now = now.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
        rest = tile_pairs(now, reps, num, den, None).select("a", "b").join(tested.unionByName(more), ["a", "b"], "left_anti")
        roots = components(links.unionByName(linked(written(rest.distinct(), "plausible"))))
    return of_doc, reps.select("cid", "doc_id"), roots


def marked(docs: DataFrame) -> DataFrame:
    return documents(docs).withColumn("mark", F.xxhash64("text"))


def class_components(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, class_id (least id with an equal set) and component_id for each row of ``docs``."""
    of_doc, reps, roots = joined(marked(docs), width, num, den, True)
    named = reps.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    classes = written(named.join(least, "root").select("cid", F.col("doc_id").alias("class_id"), "component_id"), "components")
    out = of_doc.join(classes, "cid", "left")
    own = lambda c: F.when(F.col("doc_id").isNotNull(), F.coalesce(c, "doc_id")).alias(c)
    return out.select("doc_id", F.col("n").alias("n_shingles"), own("class_id"), own("component_id"))


def survivors(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` (with doc_id, text and whatever else) without near-duplicates: of each component of similar texts one row of the
    least id stays. Ids link nothing here, so a text that none is similar to stays, whatever else its id has;
    rows without words or id all stay."""
    keyed = docs.withColumn("__mark", F.xxhash64(F.coalesce(F.col("text"), F.lit("")))).withColumn("__id", F.col("doc_id").cast("long"))
    of_doc, _, roots = joined(marked(docs), width, num, den, False)
    named = of_doc.where("cid is not null and doc_id is not null").select("doc_id", "mark", "cid").join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    rows = named.groupBy("root", "doc_id", "mark").agg(F.count("*").alias("k"))
    least = rows.groupBy("root").agg(F.min(F.struct("doc_id", "mark")).alias("kept"))
    judged = rows.join(least, "root").withColumn("stays", F.col("kept") == F.struct("doc_id", "mark"))
    gone = written(judged.where("not stays or k > 1").select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark"), "stays"), "gone")
    kept = keyed.join(gone.select("__id", "__mark"), ["__id", "__mark"], "left_anti")
    # rows that are repeated whole, or but for other columns: one of them
    again = keyed.join(gone.where("stays").select("__id", "__mark"), ["__id", "__mark"], "left_semi")
    again = again.groupBy("__id", "__mark").agg(F.min(F.struct(*docs.columns)).alias("x")).select("x.*")
    return kept.select(*docs.columns).unionByName(again)


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_components(table(spark, sf_dir, "documents"), 3, 90, 100).select("doc_id", "n_shingles", "component_id")
