"""Embedding near-duplicates by hierarchical navigable small-world graphs, one for each shard.

Vectors are compared within their label only. Equal vectors are one class, whose least id stands for
it. A label's classes are dealt into shards of about ``shard_rows``; a task builds a shard's graph.
Every query then goes to every shard of its label: a task holds one graph and streams the queries past it
in sorted order, so a graph is shuffled once for every ``slice_rows`` queries and memory is that of one
graph and one batch. A beam walks down the layers, and at the bottom goes on through everything at or
above the threshold.

Two audits widen the beam (it is doubled, and at the last covers the shard) until the share of true links
found, which brute force over the shard tells, is ``recall``: one by probes, nodes of the graph turned to a
cosine just above the threshold, so that each has a true link whatever the queries are; one by a part of
each batch of queries, themselves left out of what counts. Candidates are verified in double precision, and
links unite components.

Graphs hold all vectors (nothing is sampled) and are bounded by the shard's size; a search's links
leave the task only as counts, one edge a query and the edges that unite the shard's nodes, never as all
pairs.

Defined cases: a vector that is null, zero, or holds a null or a non-finite component, and any with a
null label, links with nothing; vectors of different lengths don't link; a null id is carried and
links with nothing; repeated ids are one vector each for counts and one node for components; an empty
table gives no rows; other columns aren't carried."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, table, written
from .components import components

M, M0, EF_BUILD = 12, 24, 48


def beam(x: np.ndarray, links: np.ndarray, q: np.ndarray, entry: np.ndarray, ef: int, floor: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Searches for all queries in step. Gives the ef best nodes (-1: none) and likenesses for each;
    with ``floor`` also which nodes at or above it were reached, going on through all of those."""
    b, n = len(q), len(x)
    width = entry.shape[1]
    seen = np.zeros((b, n + 1), bool)
    rows = np.arange(b)
    node = np.full((b, ef), n)
    sim = np.full((b, ef), -np.inf, np.float32)
    first = np.where(entry < 0, n, entry)
    take = min(ef, width)
    node[:, :take] = first[:, :take]
    seen[rows[:, None], node[:, :take]] = True
    padded = np.concatenate([x, np.zeros((1, x.shape[1]), x.dtype)])
    sim[:, :take] = np.where(node[:, :take] < n, np.einsum("bd,bkd->bk", q, padded[node[:, :take]]), -np.inf)
    done = node == n
    hits = np.zeros((b, n + 1), bool) if floor is not None else None
    walked = np.zeros((b, n + 1), bool) if floor is not None else None
    if hits is not None:
        hits[rows[:, None], node] |= sim >= floor
    steps = np.full((1, links.shape[1]), -1)
    adjacent = np.concatenate([links, steps])

    def expand(act: np.ndarray, at: np.ndarray) -> None:
        """act: query rows; at: the nodes they expand, [len(act), k]."""
        near = adjacent[at].reshape(len(act), -1)
        near = np.where(near < 0, n, near)
        near = np.where(seen[act[:, None], near], n, near)
        near = np.sort(near, 1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = n
        seen[act[:, None], near] = True
        seen[:, n] = False
        s = np.where(near < n, np.einsum("bd,bkd->bk", q[act], padded[near]), -np.inf).astype(np.float32)
        if hits is not None:
            hits[act[:, None], near] |= s >= floor
            hits[:, n] = False
            walked[act[:, None], at] = True
        all_n, all_s = np.concatenate([node[act], near], 1), np.concatenate([sim[act], s], 1)
        all_d = np.concatenate([done[act], near == n], 1)
        top = np.argpartition(-all_s, ef - 1, 1)[:, :ef]
        node[act], sim[act], done[act] = (np.take_along_axis(v, top, 1) for v in (all_n, all_s, all_d))

    k = 3
    act = rows
    while len(act):
        open_ = np.where(done[act], -np.inf, sim[act])
        kk = min(k, ef)
        best = np.argpartition(-open_, kk - 1, 1)[:, :kk]
        ok = np.take_along_axis(open_, best, 1) > -np.inf
        live = ok.any(1)
        act, best, ok = act[live], best[live], ok[live]
        if not len(act):
            break
        at = np.where(ok, node[act[:, None], best], n)
        d = done[act]
        np.put_along_axis(d, best, True, 1)
        done[act] = d
        expand(act, at)
    if hits is not None:
        while True:
            front = hits & ~walked
            act = np.nonzero(front.any(1))[0]
            if not len(act):
                break
            kk = min(8, n + 1)
            at = np.argpartition(~front[act], kk - 1, 1)[:, :kk]
            at = np.where(np.take_along_axis(front[act], at, 1), at, n)
            expand(act, at)
        hits = hits[:, :n]
    order = np.argsort(-sim, 1)
    node, sim = np.take_along_axis(node, order, 1), np.take_along_axis(sim, order, 1)
    return np.where((node == n) | (sim == -np.inf), -1, node), sim, hits


def diverse(x: np.ndarray, q: np.ndarray, cand: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates (-1: none), first those nearer to the query than to any kept before,
    then the nearest of the rest; at most ``most``."""
    out = np.full((len(q), most), -1)
    for lo in range(0, len(q), 512):
        c, qq = cand[lo : lo + 512], q[lo : lo + 512]
        v = x[np.maximum(c, 0)]
        s = np.where(c >= 0, np.einsum("bd,bkd->bk", qq, v), -np.inf)
        order = np.argsort(-s, 1, kind="stable")
        c, s, v = np.take_along_axis(c, order, 1), np.take_along_axis(s, order, 1), np.take_along_axis(v, order[:, :, None], 1)
        among = np.matmul(v, v.transpose(0, 2, 1))
        kept = np.zeros(c.shape, bool)
        for j in range(c.shape[1]):
            nearest = np.where(kept, among[:, j], -np.inf).max(1)
            kept[:, j] = (c[:, j] >= 0) & (nearest < s[:, j]) & (kept.sum(1) < most)
        rank = np.argsort(np.where(c < 0, 2, np.where(kept, 0, 1)), 1, kind="stable")[:, :most]
        picked = np.take_along_axis(c, rank, 1)
        out[lo : lo + 512, : picked.shape[1]] = picked
    return out


def layer(x: np.ndarray, order: np.ndarray, entry: np.ndarray, most: int) -> np.ndarray:
    """The links of a layer's nodes, put in by growing batches. entry: for each node of x where to begin."""
    links = np.full((len(x), most), -1)
    at, size = 0, 32
    start = order[:1]
    while at < len(order):
        new = order[at : at + size]
        q = x[new]
        inner = q @ q.T
        np.fill_diagonal(inner, -np.inf)
        k = min(8, len(new) - 1)
        mates = new[np.argsort(-inner, 1)[:, :k]] if k > 0 else np.empty((len(new), 0), int)
        cand = mates
        if at:
            e = np.concatenate([entry[new], np.repeat(start[None], len(new), 0)], 1)
            e[:, :-1][e[:, :-1] == start[0]] = -1
            cand = np.concatenate([beam(x, links, q, e, EF_BUILD)[0], mates], 1)
        cand = np.where(cand == new[:, None], -1, cand)  # a node of an upper layer begins at itself
        if cand.shape[1]:
            picked = diverse(x, q, cand, most // 2)
            links[new, : picked.shape[1]] = picked
            src, dst = np.repeat(new, picked.shape[1]), picked.ravel()
            src, dst = src[dst >= 0], dst[dst >= 0]
            # what the targets have, and what they get
            o = np.lexsort((-np.einsum("bd,bd->b", x[src], x[dst]), dst))
            src, dst = src[o], dst[o]
            targets, first = np.unique(dst, return_index=True)
            rank = np.arange(len(dst)) - np.repeat(first, np.diff(np.append(first, len(dst))))
            fits = rank < 2 * most
            got = np.full((len(targets), 2 * most), -1)
            got[np.searchsorted(targets, dst[fits]), rank[fits]] = src[fits]
            both = np.concatenate([links[targets], got], 1)
            both = np.sort(both, 1)
            both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
            over = (both >= 0).sum(1) > most
            packed = -np.sort(-both, 1)[:, :most]
            if over.any():
                packed[over] = diverse(x, x[targets[over]], both[over], most)
            links[targets] = packed
        at, size = at + len(new), min(512, at + len(new))
    return reachable(x, links, order)


def reachable(x: np.ndarray, links: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Pruning can leave a node that none of its nearest neighbours links to, so that a walk through its
    surroundings misses it. Each such node gets a link from one of them, in further columns."""
    more: dict[int, list[int]] = {}
    for lo in range(0, len(order), 1024):
        u = order[lo : lo + 1024]
        near = links[u]
        s = np.where(near >= 0, np.einsum("bd,bkd->bk", x[u], x[near]), -np.inf)
        best = np.argsort(-s, 1, kind="stable")[:, :4]
        near, s = np.take_along_axis(near, best, 1), np.take_along_axis(s, best, 1)
        back = (links[near] == u[:, None, None]).any(2) & (near >= 0)
        for k in np.nonzero(~back.any(1) & (near >= 0).any(1))[0]:
            w = min(near[k][near[k] >= 0].tolist(), key=lambda w: len(more.get(w, ())))
            more.setdefault(w, []).append(int(u[k]))
    if not more:
        return links
    extra = np.full((len(links), max(map(len, more.values()))), -1)
    for w, us in more.items():
        extra[w, : len(us)] = us
    return np.concatenate([links, extra], 1)


class Graph:
    """Layers of a hierarchical navigable small world over unit vectors."""

    def __init__(self, x: np.ndarray):
        self.x = x = x.astype(np.float32)
        n = len(x)
        draw = np.random.default_rng(n).random(n)
        level = np.minimum(np.floor(-np.log(np.maximum(draw, 1e-12)) / np.log(M)), 6).astype(int)
        order = np.argsort(-level, kind="stable")
        self.layers: list[np.ndarray] = []
        self.top = order[:1]
        for k in range(level.max() if n else 0, -1, -1):
            here = order[level[order] >= k]
            self.layers.append(layer(x, here, self.descend(x, here), M if k else M0))

    def descend(self, x: np.ndarray, wanted: np.ndarray | None = None) -> np.ndarray:
        """For each query of x, nodes from which to begin at the next layer."""
        e = np.full((len(x), 4), -1)
        e[:, 0] = self.top[0]
        rows = np.arange(len(x)) if wanted is None else wanted
        for links in self.layers:
            for lo in range(0, len(rows), 1024):
                r = rows[lo : lo + 1024]
                e[r] = beam(self.x, links, x[r], e[r], 4)[0]
        return e

    def near(self, q: np.ndarray, floor: float, ef: int) -> np.ndarray:
        """Which nodes at or above ``floor`` each query reaches."""
        saved, self.layers = self.layers, self.layers[:-1]
        try:
            e = self.descend(q)
        finally:
            self.layers = saved
        return beam(self.x, self.layers[-1], q, e, ef, floor)[2]


def unite(root: np.ndarray, u: np.ndarray, w: np.ndarray) -> None:
    """Joins the sets of u and w, pair by pair; root holds for each node the least one of its set."""
    while not np.array_equal(root[u], root[w]):
        low = np.minimum(root[u], root[w])
        np.minimum.at(root, root[u], low)
        np.minimum.at(root, root[w], low)
        while not np.array_equal(root, root[root]):
            root[:] = root[root]


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(1, keepdims=True)  # before squares, which could overflow
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def probes(x: np.ndarray, most: int, cosine: float) -> np.ndarray:
    """Nodes spread over the graph, each turned by a random direction to ``cosine``."""
    at = np.unique(np.linspace(0, len(x) - 1, most).astype(int))
    r = np.random.default_rng(len(x)).normal(size=(len(at), x.shape[1]))
    r -= (r * x[at]).sum(1, keepdims=True) * x[at]
    size = np.linalg.norm(r, axis=1, keepdims=True)
    return np.where(size > 1e-9, cosine * x[at] + np.sqrt(1 - cosine**2) * r / np.maximum(size, 1e-9), x[at]).astype(np.float32)


class Shard:
    """A graph with what its queries have found so far."""

    def __init__(self, row: dict, least: float, recall: float, ef: int, audited: int):
        self.ids, self.weights = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["weights"], np.int64)
        self.x = np.frombuffer(row["vectors"], np.float64).reshape(-1, row["shape"])
        self.graph = g = Graph.__new__(Graph)
        g.x, g.top = self.x.astype(np.float32), np.array([row["top"]])
        g.layers = [np.frombuffer(y, np.int32).astype(np.int64).reshape(len(self.x), -1) for y in row["layers"]]
        self.least, self.floor, self.recall, self.audited = least, np.float32(least - 1e-4), recall, audited
        self.root, self.wide, self.true, self.found = np.arange(len(self.x)), ef, 0, 0
        q = probes(g.x, audited, least + (1 - least) / 4)
        self.audit(q, q @ g.x.T >= least)

    def audit(self, q: np.ndarray, true: np.ndarray) -> None:
        """Widens the beam until the queries' true links are found."""
        total = int(true.sum())
        got = total
        while total and self.wide < len(self.x):
            got = int((true & self.graph.near(q, self.floor, self.wide)).sum())
            if got >= self.recall * total:
                break
            self.wide *= 2
            got = total  # unless the next beam is tried, the shard is covered
        self.true, self.found = self.true + total, self.found + got

    def links(self, ids: np.ndarray, own: np.ndarray) -> tuple[list, list, list]:
        """Columns a, b, n: numbers of links, and for each query an edge to its first one."""
        single = own.astype(np.float32)
        sample = np.unique(np.linspace(0, len(own) - 1, self.audited).astype(int))
        self.audit(single[sample], (single[sample] @ self.graph.x.T >= self.least) & (self.ids != ids[sample][:, None]))
        a, b, n = [], [], []
        for lo in range(0, len(own), 128):
            part = slice(lo, lo + 128)
            hits = self.graph.near(single[part], self.floor, self.wide) if self.wide < len(self.x) else single[part] @ self.graph.x.T >= self.floor
            k, j = np.nonzero(hits)
            ok = (np.einsum("ij,ij->i", own[part][k], self.x[j]) >= self.least) & (self.ids[j] != ids[part][k])
            k, j = k[ok], j[ok]  # sorted by query
            if not len(k):
                continue
            first = np.concatenate([[True], k[1:] != k[:-1]])
            head = np.maximum.accumulate(np.where(first, np.arange(len(k)), 0))
            unite(self.root, j[head], j)
            a += ids[part][k[first]].tolist()
            b += self.ids[j[first]].tolist()
            n += np.add.reduceat(self.weights[j], np.nonzero(first)[0]).tolist()
        return a, b, n

    def end(self) -> tuple[list, list, list]:
        """The edges that unite the shard's own nodes, and a row with no a of what the audits looked for and found."""
        moved = np.nonzero(self.root != np.arange(len(self.root)))[0]
        return [*self.ids[moved].tolist(), None], [*self.ids[self.root[moved]].tolist(), self.true], [*[None] * len(moved), self.found]


BUILT = pa.schema([("team", pa.string()), ("shard", pa.int32()), ("slices", pa.int32()), ("ids", pa.binary()), ("weights", pa.binary()), ("vectors", pa.binary()), ("shape", pa.int32()), ("layers", pa.list_(pa.binary())), ("top", pa.int32())])
FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])


def searched(df: DataFrame, least: float = 0.98, recall: float = 0.99, ef: int = 32, shard_rows: int = 16_384, slice_rows: int = 131_072, audited: int = 32) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Written tables: every row's class (vec_id, team, key); the classes (team, key, id, m and more); and
    what was found (a, b, n): an edge, with the number of a's links in the shard or null, or, where a is null,
    how many links the audits looked for (b) and found (n)."""
    e = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("long").alias("label"))
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda c: c != 0)
    e = e.withColumn("team", F.when(usable, F.concat_ws(":", "label", F.size("v")))).withColumn("key", F.when(usable, F.md5(F.col("v").cast("string").cast("binary"))))
    members = written(e.select("vec_id", "team", "key"), "vectors")
    one = e.where("team is not null").groupBy("team", "key").agg(F.min("vec_id").alias("id"), F.count("*").alias("m"), F.first("v").alias("v"))
    teams = members.where("team is not null").groupBy("team").agg(F.count("*").alias("g"))
    teams = teams.select("team", F.ceil(F.col("g") / shard_rows).cast("int").alias("shards"), F.ceil(F.col("g") / slice_rows).cast("int").alias("slices"))
    dealt = one.join(teams, "team").withColumn("h", F.xxhash64("id"))
    dealt = written(dealt.select("team", "key", "id", "m", "v", "shards", "slices", F.pmod("h", "shards").cast("int").alias("shard"), F.pmod(F.shiftrightunsigned("h", 20), F.col("slices")).cast("int").alias("slice")), "dealt")
    kind = "team string, shard int, slices int, ids binary, weights binary, vectors binary, shape int, layers array<binary>, top int"

    def vectors(v: pa.Array) -> np.ndarray:
        return np.array(v.flatten()).reshape(len(v), -1)

    def build(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        v = unit(vectors(t["v"].combine_chunks()))
        g = Graph(v)
        row = [t["team"][0].as_py(), t["shard"][0].as_py(), t["slices"][0].as_py(), t["id"].to_numpy().tobytes(), t["m"].to_numpy().tobytes(), v.tobytes(), v.shape[1], [x.astype(np.int32).tobytes() for x in g.layers], int(g.top[0])]
        return pa.Table.from_arrays([pa.array([x], f.type) for x, f in zip(row, BUILT, strict=True)], schema=BUILT)

    graphs = written(dealt.groupBy("team", "shard").applyInArrow(build, kind), "graphs")
    by, parts = ("team", "shard", "slice"), ("ids", "weights", "vectors", "shape", "layers", "top")
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    served = graphs.select("team", "shard", each("slices").alias("slice"), *parts)
    queries = dealt.select("team", each("shards").alias("shard"), "slice", "id", "v")

    def search(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = at = None
        for b in it:
            is_graph, place = b["id"].is_null().to_numpy(zero_copy_only=False), b["place"].to_numpy()
            if not len(place):
                continue
            new = is_graph | np.concatenate([[True], is_graph[:-1] | (place[1:] != place[:-1])])
            cuts = np.append(np.nonzero(new)[0], len(new))
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if is_graph[lo]:  # it comes before its queries
                    if shard:
                        yield batch(FOUND, shard.end())
                    shard, at = Shard({c: b[c][lo].as_py() for c in parts}, least, recall, ef, audited), place[lo]
                elif place[lo] == at:  # or its shard is empty
                    q = b.slice(lo, hi - lo)
                    yield batch(FOUND, shard.links(q["id"].to_numpy(), unit(vectors(q["v"]))))
        if shard:
            yield batch(FOUND, shard.end())

    rows = served.unionByName(queries, allowMissingColumns=True).withColumn("place", F.xxhash64(*by)).repartition(*by).sortWithinPartitions(*by, F.col("id").asc_nulls_first())
    return members, dealt, written(rows.mapInArrow(search, "a long, b long, n long"), "links")


def near_duplicates(df: DataFrame, **settings: float) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of ``df`` (vec_id, embedding, label)."""
    members, dealt, out = searched(df, **settings)
    counts = out.where("a is not null and n is not null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    roots = components(out.where("a is not null").select("a", "b"))
    classes = dealt.select("team", "key", "id", "m").join(counts, "id", "left").join(roots.withColumnRenamed("node", "id"), "id", "left")
    classes = classes.select("team", "key", "m", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("root", "id").alias("component_id"))
    got = members.join(classes, ["team", "key"], "left")
    return got.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


#: Brute force, which the query agrees with where its audits find every link.
OP10_SQL = """
with recursive v as (
  select vec_id, label, list_transform(embedding, lambda x: x::double) as e,
         embedding is not null and label is not null and len(embedding) > 0
           and coalesce(list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x))), false)
           and coalesce(list_bool_or(list_transform(embedding, lambda x: x <> 0)), false) as ok
  from embeddings),
u as (select vec_id, label, e, sqrt(list_dot_product(e, e)) as size from v where ok),
p as (select a.vec_id as a, b.vec_id as b from u a join u b on a.label = b.label and a.vec_id <> b.vec_id
      where list_dot_product(a.e, b.e) / (a.size * b.size) >= 0.98),
r(a, b) as (select a, b from p union select r.a, p.b from r join p on r.b = p.a)
select v.vec_id, (select count(*) from p where p.a = v.vec_id)::bigint as n_links,
       least(v.vec_id, coalesce((select min(b) from r where r.a = v.vec_id), v.vec_id)) as component_id,
       v.vec_id = least(v.vec_id, coalesce((select min(b) from r where r.a = v.vec_id), v.vec_id)) as kept
from v
"""
