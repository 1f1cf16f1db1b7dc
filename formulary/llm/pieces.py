"""SentencePiece encoding and decoding as weighted finite-state transduction.

A model file is compiled into three transducers. ``Rewriter`` replaces by the normaliser's character rules,
the longest that begins at a place (a trie, deterministic). ``Spacing`` treats white space: three states that
drop, join and escape spaces, and the dummy prefix as what the start emits. ``Lexicon`` goes from characters
to pieces: a trie whose arcs back to the root emit piece ids, and for a character without a piece of its own an
arc that emits its byte pieces, or the unknown id. An input is composed with the first two, which are functions,
so the result is one string; that is composed lazily with the lexicon, state by state as the search reaches
it, and the tropical semiring's shortest path is the encoding, for both kinds of model by one search.

For unigram models an arc weighs minus its piece's log-probability, and for an unknown character what the
library takes. For BPE models an arc weighs 0 or infinity and the states also hold the piece before: two pieces
may be neighbours if merging their characters by rank gives just these two. A sequence of pieces is what BPE
gives if and only if all its neighbours may be, so the path of weight 0 is unique. Which merges would have
crossed the boundary is read from the pieces' own last merges (``Merges``).

Paths of segments (stretches that no piece crosses) are kept in each Python process. Texts are mapped
where they lie, without a shuffle; the model's path must be readable on every worker, as installed
vocabularies are.

Defined cases: null or empty texts have no ids; characters that the model doesn't know become byte
pieces (or, a run of them, one unknown id without byte fallback); user-defined pieces are matched first; repeated
rows are encoded each; an empty table gives no rows; other columns are kept, and columns called ids or decoded
are replaced. U+2581 in a text is the model's space sign, so it decodes as a space."""

from __future__ import annotations

import gc
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, kept_in_worker, small_batches, table

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protocol buffer message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            c = data[at]
            at += 1
            out |= (c & 127) << shift
            shift += 7
            if c < 128:
                return out

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        elif key & 7 == 2:
            n = varint()
            yield key >> 3, data[at : at + n]
            at += n
        else:
            n = 4 if key & 7 == 5 else 8
            yield key >> 3, struct.unpack("<f" if n == 4 else "<d", data[at : at + n])[0]
            at += n


def character_rules(blob: bytes) -> dict[bytes, bytes]:
    """What a compiled normaliser's double-array trie replaces: walked from its root."""
    if not blob:
        return {}
    size = struct.unpack("<I", blob[:4])[0]
    units = struct.unpack(f"<{size // 4}I", blob[4 : 4 + size])
    texts = blob[4 + size :]
    out: dict[bytes, bytes] = {}
    offset = lambda u: (u >> 10) << ((u & 512) >> 6)
    todo = [(offset(units[0]), b"")]
    while todo:
        base, key = todo.pop()
        for label in range(1, 256):
            at = base ^ label
            if at < len(units) and units[at] & 0x800000FF == label:
                below = at ^ offset(units[at])
                if units[at] >> 8 & 1:
                    value = units[below] & 0x7FFFFFFF
                    out[key + bytes([label])] = texts[value : texts.index(b"\0", value)]
                todo.append((below, key + bytes([label])))
    return out


class Rewriter:
    """Character rules as a deterministic transducer: from the root of their trie the longest rule that
    matches, or else the character itself."""

    def __init__(self, rules: dict[str, str]):
        self.trie: dict = {}
        for key, out in rules.items():
            node = self.trie
            for c in key:
                node = node.setdefault(c, {})
            node[""] = out

    def __call__(self, text: str) -> str:
        if not self.trie:  # the identity
            return text
        out, at = [], 0
        while at < len(text):
            node, end, found = self.trie, at + 1, text[at]
            for k in range(at, len(text)):
                node = node.get(text[k])
                if node is None:
                    break
                if "" in node:
                    end, found = k + 1, node[""]
            out.append(found)
            at = end
        return "".join(out)


class Spacing:
    """White space as a transducer of three states: before the first word, in a word, and after one, where
    what the space emits waits for the next word. Without squeezing only the second is left, a map of characters."""

    def __init__(self, squeeze: bool, dummy: bool, escape: bool):
        self.squeeze, self.sign = squeeze, SPACE if escape else " "
        self.start = self.sign if dummy else ""

    def __call__(self, text: str) -> str:
        if not self.squeeze:
            return self.start + text.replace(" ", self.sign) if text else ""
        out, waiting = [], self.start  # what the next word's first character is preceded by
        for c in text:
            if c != " ":
                out.append(waiting + c)
                waiting = ""
            elif out:
                waiting = self.sign
        return "".join(out)


class Merges:
    """Which pieces of a BPE model may be neighbours."""

    def __init__(self, ranks: dict[str, float]):
        self.ranks, self.kept = ranks, {}
        self.parts: dict[str, tuple[str, str]] = {}
        self.odd: set[str] = set()  # pieces that rank no later than a part of theirs, or have such a part
        for p in sorted(ranks, key=len):
            if len(p) > 1:
                *_, before = self.steps(p)
                if len(before) == 2:
                    self.parts[p] = (before[0], before[1])
                    if any(x in self.odd or len(x) > 1 and ranks[x] >= ranks[p] for x in before):
                        self.odd.add(p)
        self.spines: dict[tuple[str, int], list[tuple[str, float, float]]] = {}

    def steps(self, text: str) -> Iterator[list[str]]:
        """What merging by rank goes through: at last, if all is merged, the two parts of the whole, else its result."""
        own = list(text)
        while True:
            best, at = None, -1
            for k in range(len(own) - 1):
                r = self.ranks.get(own[k] + own[k + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, k
            if at < 0 or len(own) == 2:
                yield own + [""] * (at < 0 and len(own) == 2)  # two parts that don't merge aren't one piece's
                return
            own = [*own[:at], own[at] + own[at + 1], *own[at + 2 :]]

    def whole(self, p: str) -> bool:
        """Whether merging gives the piece itself."""
        return len(p) == 1 or p in self.parts

    def spine(self, p: str, side: int) -> list[tuple[str, float, float]]:
        """The part at an end (side) of p before each merge, latest first, with the ranks of the merges that
        make and that use it."""
        found = self.spines.get((p, side))
        if found is None:
            found, use, x = [], float("inf"), p
            while True:
                made = self.ranks[x] if len(x) > 1 else -1.0
                found.append((x, made, use))
                if len(x) == 1:
                    break
                use, x = made, self.parts[x][side]
            self.spines[p, side] = found
        return found

    def neighbours(self, p: str, q: str) -> bool:
        """Whether no merge goes across the boundary of p and q (both whole): back from the last merges, at any
        time the parts that touch must not have a merge before the one that uses either (if it's the
        same rank, the one to the left)."""
        if p in self.odd or q in self.odd:
            *_, last = self.steps(p + q)
            return last[:2] == [p, q] and p + q not in self.ranks
        ranks, left, right = self.ranks, self.spine(p, 1), self.spine(q, 0)
        i = j = 0
        while True:
            x, made_x, use_x = left[i]
            y, made_y, use_y = right[j]
            r = ranks.get(x + y)
            if r is not None and r < use_x and r <= use_y:
                return False
            if made_x > made_y:
                i += 1
            elif made_y >= 0:
                j += 1
            else:
                return True


class Lexicon:
    """From characters to pieces: a trie whose nodes are (children, piece that ends there or None), and for each
    piece or unknown character its weight and the ids it emits."""

    def __init__(self, weights: dict[str, float], ids: dict[str, int], unknown: float, fallback: dict[int, int], unknown_id: int):
        self.root: tuple = ({}, None)
        self.weights, self.unknown, self.fallback, self.unknown_id = weights, unknown, fallback, unknown_id
        self.emitted = {p: (ids[p],) for p in weights}
        tree: dict = {}
        for p in weights:
            node = tree
            for c in p:
                node = node.setdefault(c, {})
            node[""] = p
        self.root, self.longest = self.frozen(tree), max(map(len, weights), default=1)

    def frozen(self, node: dict) -> tuple:
        return {c: self.frozen(x) for c, x in node.items() if c}, node.get("")

    def arcs(self, text: str, at: int) -> list[str]:
        """The pieces that lead from ``at``, the shortest first; the one character if it is none itself."""
        out, (node, _) = [], self.root
        for c in text[at : at + self.longest]:
            below = node.get(c)
            if below is None:
                break
            node, piece = below
            if piece is not None:
                out.append(piece)
        if not out or len(out[0]) > 1:
            out.insert(0, text[at])
        return out

    def weight(self, piece: str) -> float:
        return self.weights.get(piece, self.unknown)

    def emits(self, piece: str) -> tuple[int, ...]:
        found = self.emitted.get(piece)
        if found is None:
            return tuple(self.fallback[b] for b in piece.encode()) if self.fallback else (self.unknown_id,)
        return found


class Transducer:
    def __init__(self, path: str):
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        self.scores: list[float] = []
        with open(path, "rb") as f:
            model = f.read()
        trainer, normaliser = b"", b""
        for k, v in fields(model):
            if k == 1:
                p = dict(fields(v))
                self.pieces.append(p[1].decode())
                self.scores.append(p.get(2, 0.0))
                self.kinds.append(p.get(3, NORMAL))
            elif k == 2:
                trainer = v
            elif k == 3:
                normaliser = v
        t, n = dict(fields(trainer)), dict(fields(normaliser))
        self.bpe, fallback = t.get(3, 1) == 2, bool(t.get(35, 0))
        self.dummy, squeeze, escape = (bool(n.get(k, 1)) for k in (3, 4, 5))
        self.rewriter = Rewriter({k.decode(): v.decode() for k, v in character_rules(n.get(2, b"")).items()})
        self.spacing = Spacing(squeeze, self.dummy, escape)
        ids = {p: k for k, (p, kind) in enumerate(zip(self.pieces, self.kinds, strict=True)) if kind in (NORMAL, USER)}
        user = {p for p, k in ids.items() if self.kinds[k] == USER}
        self.unknown = self.kinds.index(UNKNOWN)
        by_byte = {int(p[3:5], 16): k for k, (p, kind) in enumerate(zip(self.pieces, self.kinds, strict=True)) if kind == BYTE}
        self.byte_of = {k: b for b, k in by_byte.items()}
        self.silent = {k for k, kind in enumerate(self.kinds) if kind == CONTROL}
        normal = {p: self.scores[k] for p, k in ids.items() if p not in user}
        if self.bpe:
            self.merges = Merges({p: -x for p, x in normal.items()})
            weights, unknown = {p: 0.0 for p in normal if self.merges.whole(p)}, 0.0
        else:
            # fixed values: the library's bonus of user-defined pieces and penalty of unknown characters
            most, least = max(normal.values()), min(normal.values())
            weights = {p: -normal[p] if p in normal else 0.1 - most * len(p.encode()) for p in ids}
            unknown = 10.0 - least
        self.lexicon = Lexicon(weights, ids, unknown, by_byte if fallback else {}, self.unknown)
        self.ids, self.user = ids, None
        if user and self.bpe:
            self.user = re.compile("(" + "|".join(map(re.escape, sorted(user, key=len, reverse=True))) + ")")
        # segments, as fine as no piece crosses: with the spaces before it a run of letters or of others, or of both
        cuts = (f"{SPACE}*[^\\W\\d_]+|{SPACE}*[^{SPACE}\\w]+|{SPACE}*[\\d_]+|{SPACE}+", f"{SPACE}*[^\\W\\d_]+|{SPACE}*(?:[\\d_]|[^{SPACE}\\w])+|{SPACE}+", f"{SPACE}*[^{SPACE}]+|{SPACE}+", r"(?s:.+)")
        self.cut = next(c for c in map(re.compile, cuts) if all(c.fullmatch(p) and c.match(p).end() == len(p) for p in ids))
        self.pairs: dict[tuple[str, str], bool] = {}
        self.paths: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def normalise(self, text: str) -> str:
        return self.spacing(self.rewriter(text))

    def may_follow(self, p: str, q: str) -> bool:
        """Weight 0 (true) or infinity of the step from p to q in a BPE model's composition."""
        if len(self.pairs) > 1_000_000:
            self.pairs.clear()
        found = self.pairs[p, q] = self.merges.neighbours(p, q)
        return found

    def shortest(self, text: str) -> list[int]:
        """The ids of the shortest path through the composition, over states (place, piece before, state before)."""
        state = self.depth_first(text) if self.bpe else self.least_cost(text)
        pieces = []
        while state[2] is not None:
            pieces.append(state[1])
            state = state[2]
        return [k for p in reversed(pieces) for k in self.lexicon.emits(p)]

    def depth_first(self, text: str) -> tuple:
        """All finite weights are 0, so the first path to arrive is a shortest one: longest pieces first,
        weights looked up when a step is taken, states that were left for good remembered."""
        n, arcs, pairs, done = len(text), self.lexicon.arcs, self.pairs, set()
        stack: list[tuple] = [(0, "", None)]
        while stack:
            state = stack.pop()
            at, last, before = state
            if at:
                if before[0]:
                    ok = pairs.get((before[1], last))
                    if ok is None:
                        ok = self.may_follow(before[1], last)
                    if not ok:
                        continue
                if at == n:
                    return state
                if (at, last) in done:
                    continue
                done.add((at, last))
            for p in arcs(text, at):
                stack.append((at + len(p), p, state))
        raise AssertionError("every character has an arc, so there is a path")

    def least_cost(self, text: str) -> tuple:
        """The place alone is the state: the least weight to each one, in order."""
        best: list[tuple[float, tuple] | None] = [None] * (len(text) + 1)
        best[0] = (0.0, (0, "", None))
        for at in range(len(text)):
            if best[at] is None:
                continue
            so_far, state = best[at]
            for p in self.lexicon.arcs(text, at):
                end, w = at + len(p), so_far + self.lexicon.weight(p)
                if best[end] is None or w < best[end][0]:
                    best[end] = (w, (end, p, state))
        return best[-1][1]

    def path(self, segment: str) -> bytes:
        """Ids (little-endian, 32 bits) of a segment. Of the paths kept the older half goes when there are many."""
        found = self.older.get(segment)
        if found is None:
            found = array("I", self.shortest(segment)).tobytes()
        if len(segment) < 200:
            if len(self.paths) > 300_000:
                self.older, self.paths = self.paths, {}
            self.paths[segment] = found
        return found

    def encode(self, text: str) -> bytes:
        text, kept, out = self.normalise(text), self.paths, []
        for part in self.user.split(text) if self.user else (text,):
            if self.user and part in self.ids and self.kinds[self.ids[part]] == USER:
                out.append(array("I", [self.ids[part]]).tobytes())
                continue
            for segment in self.cut.findall(part):
                found = kept.get(segment)
                if found is None:
                    found = self.path(segment)
                    kept = self.paths
                out.append(found)
        if not self.lexicon.fallback:  # a run of unknown characters is one id
            ids = np.frombuffer(b"".join(out), "<u4")
            same = ids == self.unknown
            return ids[~(same & np.concatenate([[False], same[:-1]]))].tobytes()
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        if not self.byte_of.keys() & set(ids):
            text = "".join([self.pieces[k] for k in ids if k not in self.silent])
        else:
            text = b"".join([bytes([self.byte_of[k]]) if k in self.byte_of else self.pieces[k].encode() for k in ids if k not in self.silent]).decode(errors="replace")
        text = text.replace(SPACE, " ")
        return text[1:] if self.dummy and text[:1] == " " else text


def transducer(path: str) -> Transducer:
    def load() -> Transducer:
        out = Transducer(path)
        gc.freeze()  # a lasting model need not be gone through by every collection
        return out

    return kept_in_worker(f"transducer {path}", load)


def encode(df: DataFrame, model: str, text: str = "text") -> DataFrame:
    """``df`` with ids."""
    small_batches(df.sparkSession)

    @F.pandas_udf("array<int>")
    def ids(s: pd.Series) -> pd.Series:
        t = transducer(model)
        return s.map(lambda x: np.frombuffer(t.encode(x), "<u4").astype(np.int32))

    return df.select(*[c for c in df.columns if c.lower() != "ids"], ids(F.coalesce(F.col(text), F.lit(""))).alias("ids"))


def decode(df: DataFrame, model: str, ids: str = "ids") -> DataFrame:
    """``df`` with decoded."""
    small_batches(df.sparkSession)

    @F.pandas_udf("string")
    def text(s: pd.Series) -> pd.Series:
        t = transducer(model)
        return s.map(lambda x: t.decode([k for k in x.tolist()]))

    return df.select(*[c for c in df.columns if c.lower() != "decoded"], text(F.coalesce(F.col(ids), F.array().cast("array<int>"))).alias("decoded"))


def digests(df: DataFrame, model: str) -> DataFrame:
    """doc_id, n_ids, n_bytes (of byte fallback), ids_crc32, and whether decoding gives back the text."""
    small_batches(df.sparkSession)

    @F.pandas_udf("n_ids long, n_bytes long, ids_crc32 long, round_trip boolean")
    def digest(s: pd.Series) -> pd.DataFrame:
        t = transducer(model)
        is_byte = np.array([k in t.byte_of for k in range(len(t.pieces))])
        out = []
        for x in s:
            raw = t.encode(x)
            ids = np.frombuffer(raw, "<u4")
            out.append((len(ids), int(is_byte[ids].sum()), zlib.crc32(raw), t.decode(ids.tolist()) == x))
        return pd.DataFrame(out, columns=["n_ids", "n_bytes", "ids_crc32", "round_trip"])

    return documents(df).select("doc_id", digest("text").alias("d")).select("doc_id", "d.*")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
