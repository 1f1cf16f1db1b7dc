"""Best-fit packing of documents into sequences: bounded-space online best-fit. A packer keeps at most
``open_bins`` open bins; a bitset keyed by free space finds the open bin with the least room that
still holds a piece, in one shift and one lowest-set-bit. When a new bin is needed and all are open,
the fullest closes first.

Every input partition has a packer of its own and is tokenised and packed in one pass where it lies:
nothing is shuffled, and a partition that is run again gives the same rows. Bins left open at the end
of a partition cost at most ``open_bins`` part-filled sequences for each partition.

Defined cases: a null or empty text is its end token alone; repeated rows are packed each; an empty
table gives no rows; other columns are not carried."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Batches, batch, documents, kept_in_worker, small_batches, table


class Packer:
    def __init__(self, length: int, open_bins: int, first: int):
        self.length, self.open_bins, self.next = length, open_bins, first
        self.bits, self.count = 0, 0
        self.bins: list[list[int]] = [[] for _ in range(length + 1)]

    def _take(self, free: int) -> int:
        at = self.bins[free].pop()
        self.count -= 1
        if not self.bins[free]:
            self.bits &= ~(1 << free)
        return at

    def place(self, size: int) -> tuple[int, int]:
        """(bin, offset) for a piece of ``size`` tokens, 1 to length."""
        fit = self.bits >> size
        if fit:
            free = (fit & -fit).bit_length() - 1 + size
            at = self._take(free)
        else:
            if self.count >= self.open_bins and size < self.length:
                self._take((self.bits & -self.bits).bit_length() - 1)
            free, at = self.length, self.next
            self.next += 1
        if free > size:
            self.bins[free - size].append(at)
            self.bits |= 1 << (free - size)
            self.count += 1
        return at, self.length - free


class Encoder:
    """Ids as the ``tokenizers`` library gives them for the file at ``path``. Its byte-level BPE is run
    by ``tiktoken`` over the same vocabulary, several times as fast; texts with a special token, or
    with white space so long that its expression would have to go back far, go to ``tokenizers``."""

    def __init__(self, path: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        spec = json.loads(self.slow.to_str())
        self.special = [x["content"] for x in spec["added_tokens"]]
        byte = {v: k for k, v in byte_letters().items()}
        ranks = {bytes(byte[c] for c in piece): k for piece, k in spec["model"]["vocab"].items() if piece not in self.special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.long_space = re.compile(r"\s{2000}")

    def __call__(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special) or len(text) > 2000 and self.long_space.search(text):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.fast(text), np.uint32)


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(other)}


def pack(docs: DataFrame, tokenizer: str, length: int = 1024, end: int = 2, open_bins: int = 128, keep_ids: bool = True) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids if
    kept. Only documents over ``length`` are cut; their first piece takes the remainder."""
    small_batches(docs.sparkSession)
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
    schema = pa.schema(fields + ([("ids", pa.list_(pa.int32()))] if keep_ids else []))

    def packed(it: Batches) -> Batches:
        from pyspark import TaskContext

        encode, packer = kept_in_worker(f"encoder {tokenizer}", lambda: Encoder(tokenizer)), Packer(length, open_bins, TaskContext.get().partitionId() << 36)
        for b in it:
            out: list[tuple] = []
            for doc, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
                ids = np.append(encode(text or ""), np.uint32(end)).astype("<u4")
                start, piece = 0, 0
                size = len(ids) % length or length
                while start < len(ids):
                    part = ids[start : start + size]
                    at, offset = packer.place(size)
                    out.append((doc, piece, start, size, zlib.crc32(part.tobytes()), at, offset) + ((part.astype(np.int32),) if keep_ids else ()))
                    start, piece, size = start + size, piece + 1, length
            if out:
                yield batch(schema, list(zip(*out, strict=True)))

    kind = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids array<int>" * keep_ids
    return documents(docs).mapInArrow(packed, kind)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), keep_ids=False)
