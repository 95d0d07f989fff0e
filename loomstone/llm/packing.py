"""Best-two-fit packing of tokenised documents into fixed-length sequences.

Only the *lengths* of the pieces matter for packing and there are at most
``capacity`` different ones, so the plan is made from a histogram:

1. :func:`tokenise` cuts documents into pieces of at most ``capacity`` tokens
   (the short piece of a long document comes first, all others are full);
2. a histogram of lengths (at most ``capacity`` rows, whatever the input) goes
   to the driver, where :func:`plan_bins` runs best-two-fit on it.  A bin
   pattern is repeated as long as its lengths last, so the plan has a few
   thousand rows for any number of documents;
3. every piece gets its rank among the pieces of its length: its rank inside
   its partition plus the partition's offset, so no length is ever gathered in
   one task;
4. the plan's slots (a bounded table) are broadcast and each piece looks up
   ``(length, rank) -> (sequence_id, offset)``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import need, save, without
from .wordcache import chunks, id_encoder

PIECES = "piece int, start long, length long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece of ``n`` tokens; only the first may be short."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def tokenise(docs: DataFrame, tokenizer_path: str, end_id: int | None = 2, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text", remember: int | None = None, ids: bool = True, characters: int = 2_000_000) -> DataFrame:
    """Pieces of every document: ``id_col, piece, start, length, ids``.

    ``ids`` holds little-endian unsigned 32-bit integers.  A null or empty text
    has no tokens besides ``end_id``; without ``end_id`` it gives no piece.  A
    null id is kept.  Repeated rows give repeated pieces.  ``remember`` bounds the
    words that a worker keeps: more of them cost memory and save time.  Without
    ``ids`` that column is left out and never leaves the worker.  ``characters``
    is about how many are encoded at a time.
    """
    need(docs, id_col, text_col)
    columns = ["piece", "start", "length", *["ids"] * ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = id_encoder(tokenizer_path, remember)
        tail = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for at, stop in chunks(texts, characters):  # very long texts must not add up
                who = batch.column(0).slice(at, stop - at)
                rows, piece, start, length, blobs = [], [], [], [], []
                for i, raw in enumerate(encode(texts[at:stop])):
                    raw += tail
                    if not raw:
                        continue
                    for k, (s, n) in enumerate(cut(len(raw) // 4, capacity)):
                        rows.append(i)
                        piece.append(k)
                        start.append(s)
                        length.append(n)
                        if ids:
                            blobs.append(raw[4 * s : 4 * (s + n)])
                out = [who.take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64())]
                yield pa.RecordBatch.from_arrays([*out, pa.array(blobs, pa.binary())] if ids else out, names=[id_col, *columns])

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {id_type}, {PIECES}{', ids binary' * ids}")


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-two-fit on a histogram of lengths: [(lengths of a bin, number of such bins)].

    A bin takes the longest length left and then, again and again, the longest
    that still fits.  Then its shortest member is taken out if two lengths that
    are left fill the gap, so expanded, more tightly; the tightest pair is taken
    and, if the bin has room, the step is tried again.
    """
    bad = [n for n in counts if not 0 < n <= capacity]
    if bad:
        raise ValueError(f"lengths must be 1 to {capacity}: {bad[:3]}")
    left = np.zeros(capacity + 1, dtype=np.int64)
    for n, c in counts.items():
        left[n] = c
    plan: list[tuple[tuple[int, ...], int]] = []
    while True:
        there = np.flatnonzero(left)
        if not len(there):
            return plan
        use = np.zeros(capacity + 1, dtype=np.int64)
        members: list[int] = []

        def take(n: int) -> None:
            use[n] += 1
            members.append(int(n))

        take(there[-1])
        gap = capacity - members[0]
        while gap > 0:
            fits = np.flatnonzero((left[: gap + 1] - use[: gap + 1]) > 0)
            if not len(fits):
                break
            take(fits[-1])
            gap -= members[-1]
        while gap > 0 and len(members) > 1:
            small = min(members)
            pair = _tightest_pair(left - use, gap + small)
            if pair is None or sum(pair) <= small:
                break
            members.remove(small)
            use[small] -= 1
            gap += small - sum(pair)
            for n in pair:
                take(n)
        used = np.flatnonzero(use)
        times = int((left[used] // use[used]).min())
        left[used] -= times * use[used]
        plan.append((tuple(sorted(members, reverse=True)), times))


def _tightest_pair(left: np.ndarray, room: int) -> tuple[int, int] | None:
    """Two lengths that are left (twice the same if two are) with the largest sum of at most ``room``."""
    sizes = np.flatnonzero(left[:room] > 0)
    best, lo, hi = None, 0, len(sizes) - 1
    while lo <= hi:
        total = int(sizes[lo] + sizes[hi])
        if total > room:
            hi -= 1
            continue
        if (lo < hi or left[sizes[lo]] > 1) and (best is None or total > sum(best)):
            best = (int(sizes[hi]), int(sizes[lo]))
            if total == room:
                break
        lo += 1
    return best


def slots(plan: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, rank after the last, first sequence, offset) of every place in the plan."""
    rows, used, sequence = [], {}, 0
    for members, times in plan:
        offset = 0
        for n in members:
            at = used.get(n, 0)
            rows.append((n, at, at + times, sequence, offset))
            used[n] = at + times
            offset += n
        sequence += times
    return rows


SLOTS = T.StructType([T.StructField(c, T.LongType(), False) for c in ("length", "_from", "_to", "_sequence", "offset")])


def best_two_fit(pieces: DataFrame, capacity: int = 1024, length_col: str = "length") -> DataFrame:
    """Adds ``sequence_id, offset`` to every row of ``pieces``; rows of a sequence are gapless from 0.

    ``pieces`` may hold any columns besides (one named like an added one is replaced); lengths must lie in 1 to
    ``capacity`` (ValueError otherwise; nulls likewise).  Equal lengths are
    exchangeable: which of them goes where is not defined.  An empty table gives
    an empty result.
    """
    need(pieces, length_col)
    pieces = without(pieces, "sequence_id", "offset")
    spark, own = pieces.sparkSession, pieces.columns
    kept = save(pieces.withColumn("__uid", F.monotonically_increasing_id()), "pieces")
    keyed = kept.withColumn("__part", F.shiftright("__uid", 33)).withColumn("__n", F.col(length_col).cast("long"))
    if not keyed.where(F.col("__n").isNull()).isEmpty():
        raise ValueError("a piece has no length")
    cells = keyed.groupBy("__part", "__n").agg(F.count(F.lit(1)).alias("__c"))
    counts = {r[0]: r[1] for r in cells.groupBy("__n").agg(F.sum("__c")).collect()}  # at most `capacity` rows
    plan = spark.createDataFrame(slots(plan_bins(counts, capacity)), SLOTS)
    before = cells.withColumn("__before", F.sum("__c").over(Window.partitionBy("__n").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = keyed.withColumn("__in", F.row_number().over(Window.partitionBy("__part", "__n").orderBy("__uid")) - 1)
    placed = ranked.join(before.drop("__c"), ["__part", "__n"]).withColumn("__rank", F.col("__in") + F.coalesce("__before", F.lit(0)))
    s = F.broadcast(plan.select(F.col("length").alias("__len"), "_from", "_to", "_sequence", F.col("offset").alias("__off")))
    hit = (F.col("__n") == F.col("__len")) & (F.col("__rank") >= F.col("_from")) & (F.col("__rank") < F.col("_to"))
    return placed.join(s, hit).select(*own, (F.col("_sequence") + F.col("__rank") - F.col("_from")).alias("sequence_id"), F.col("__off").alias("offset"))


def sequences(packed: DataFrame, ids_col: str = "ids") -> DataFrame:
    """One row per sequence: ``sequence_id, n_tokens, ids`` (the pieces' bytes in place). A sequence holds at most ``capacity`` tokens, so its group is bounded."""
    need(packed, "sequence_id", "offset", ids_col, "length")
    parts = F.array_sort(F.collect_list(F.struct("offset", F.col(ids_col).alias("b"))))
    joined = F.unhex(F.array_join(F.transform(parts, lambda x: F.hex(x["b"])), ""))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), joined.alias("ids"))
