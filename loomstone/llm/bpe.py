"""Byte-level BPE by a two-tier lookup, and its inverse.

A text is cut into pre-tokens by a pattern.  Tier one asks a minimal perfect
hash, built once per worker over the vocabulary, whether the whole pre-token is
a token: one slot to look at, confirmed by comparing bytes.  Tier two merges the
pre-tokens that miss: bytes form a linked list, and a heap of neighbouring pairs
ordered by (rank, position) gives the next merge, so a pre-token of n bytes
takes O(n log n) steps.

Ids are exchanged as binary columns of little-endian unsigned 32-bit integers.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .memory import hold
from .shared import need, without
from .wordcache import CUTTABLE, WordCache, chunks

_MIX = np.uint64(0x9E3779B97F4A7C15)


def read_ranks(path: str) -> dict[bytes, int]:
    """A ``.tiktoken`` file: base64 of a token's bytes and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PerfectHash:
    """Minimal perfect hash of byte strings: ``len(keys)`` slots, one key in each.

    Keys fall into small buckets.  The largest bucket first, each looks for a
    displacement that sends all its keys to free slots; a bucket of one key
    simply names a free slot (stored as a negative number).
    """

    def __init__(self, keys: list[bytes]):
        self.n, self.buckets = len(keys), max(1, len(keys) // 4)
        h = self.digest(keys)
        if len(np.unique(h)) != self.n:
            raise ValueError("keys repeat, or their 64-bit digests collide")
        bucket = (h % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        first = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        self.shift = np.zeros(self.buckets, dtype=np.int64)
        free, slot = np.ones(self.n, dtype=bool), np.empty(self.n, dtype=np.int64)
        sizes = np.diff(first)
        for b in np.argsort(-sizes, kind="stable"):
            members = order[first[b] : first[b + 1]]
            if len(members) < 2:
                break
            for base in range(1, 1 << 30, 32):
                tries = np.arange(base, base + 32)
                at = self._place(h[members][None, :], tries[:, None])
                good = free[at].all(axis=1)
                if len(members) > 1:
                    s = np.sort(at, axis=1)
                    good &= (s[:, 1:] != s[:, :-1]).all(axis=1)
                if good.any():
                    k = int(np.argmax(good))
                    self.shift[b], slot[members] = tries[k], at[k]
                    free[at[k]] = False
                    break
        alone = np.flatnonzero(sizes == 1)
        rest = np.flatnonzero(free)
        self.shift[alone] = -1 - rest[: len(alone)]
        slot[order[first[alone]]] = rest[: len(alone)]
        self.slot_of_key = slot

    @staticmethod
    def digest(keys: list[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))

    def _place(self, h: np.ndarray, shift: np.ndarray) -> np.ndarray:
        x = (h ^ (shift.astype(np.uint64) * _MIX)) * np.uint64(0xC2B2AE3D27D4EB4F)
        return ((x >> np.uint64(29)) % np.uint64(self.n)).astype(np.int64)

    def slots(self, keys: list[bytes]) -> np.ndarray:
        """The only slot where each key can be."""
        h = self.digest(keys)
        d = self.shift[(h % np.uint64(self.buckets)).astype(np.int64)]
        return np.where(d < 0, -1 - d, self._place(h, np.where(d < 0, 0, d)))


class BPE:
    """Encoder and decoder of one vocabulary. Every single byte must be a token, else ValueError."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks single bytes: {missing[:5]}")
        self.ranks = ranks
        # the pattern's white space is Unicode's property; Python's \s also takes U+001C to U+001F
        self.pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        keys = list(ranks)
        self.hash = PerfectHash(keys)
        self.slot_key: list[bytes] = [b""] * len(keys)
        for key, slot in zip(keys, self.hash.slot_of_key.tolist(), strict=True):
            self.slot_key[slot] = key
        self.slot_id = np.array([ranks[k] for k in self.slot_key], "<u4")
        self.by_id = {i: k for k, i in ranks.items()}

    def merge(self, word: bytes) -> list[int]:
        """Ids of a pre-token by merging the pair of lowest rank, the leftmost first, until none is a token."""
        ranks, n = self.ranks, len(word)
        end = list(range(1, n + 1))  # end of the part that starts here; 0 once it is merged away
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, mid, stop = heappop(heap)
            if end[i] != mid or mid >= n or end[mid] != stop:
                continue
            end[i], end[mid] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := ranks.get(word[i : end[stop]])) is not None:
                    heappush(heap, (r, i, stop, end[stop]))
            if i and (r := ranks.get(word[(p := before[i]) : stop])) is not None:
                heappush(heap, (r, p, i, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[word[i : end[i]]])
            i = end[i]
        return out

    def encode_parts(self, parts: list[str]) -> list[bytes]:
        find = self.pattern.findall
        cut = [[m.encode() for m in find(p)] for p in parts]
        words = list({w for ws in cut for w in ws})
        known: dict[bytes, bytes] = {}
        if words:
            slots = self.hash.slots(words)
            whole = self.slot_id[slots]
            for w, s, i in zip(words, slots.tolist(), whole, strict=True):
                known[w] = i.tobytes() if self.slot_key[s] == w else np.array(self.merge(w), "<u4").tobytes()
        return [b"".join([known[w] for w in ws]) for ws in cut]

    def decode(self, ids: bytes) -> bytes:
        """The tokens' bytes; an id outside the vocabulary raises KeyError."""
        return b"".join(map(self.by_id.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _worker(path: str, pattern: str) -> tuple[BPE, Callable[[list[str]], list[bytes]]]:
    """The tokeniser and its encoder of texts: in parts with a memory where the pattern allows it, else whole."""

    def build() -> tuple[BPE, Callable[[list[str]], list[bytes]]]:
        bpe = BPE(read_ranks(path), pattern)
        return bpe, WordCache(bpe.encode_parts) if pattern == CUTTABLE else bpe.encode_parts

    return hold(("bpe", path, pattern), build)


def _mapped(df: DataFrame, source: str, target: str, make) -> DataFrame:
    """``df`` with binary column ``target`` made from ``source``, a few rows at a time."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            values = batch.column(names.index(source)).to_pylist()
            for at, stop in chunks([v or "" for v in values]):  # very long texts must not add up
                made = pa.array(f(values[at:stop]), pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.slice(at, stop - at).columns, made], names=[*names, target])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(target, T.BinaryType())]))


def encode(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Adds ``ids_col``: ids of every text. Null and empty texts give no ids (empty binary, not null). A column named ``ids_col`` is replaced.

    Any pattern gives the library's ids; texts are cut and words remembered only
    for the one that :mod:`.wordcache` knows, so others take longer.
    """
    need(df, text_col)
    return _mapped(without(df, ids_col), text_col, ids_col, lambda: lambda texts: _worker(ranks_path, pattern)[1]([t or "" for t in texts]))


def decode(df: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """Adds ``bytes_col``: the bytes that the ids stand for; null ids count as none. A column named ``bytes_col`` is replaced."""
    need(df, ids_col)
    return _mapped(without(df, bytes_col), ids_col, bytes_col, lambda: lambda rows: [_worker(ranks_path, pattern)[0].decode(r or b"") for r in rows])


def n_tokens(ids_col: str = "ids"):
    return (F.octet_length(ids_col) / 4).cast("long")
