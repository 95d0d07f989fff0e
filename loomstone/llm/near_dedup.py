"""Near duplicates by MinHash bands, sequential Bayesian verification and exact confirmation.

1. A pass over the texts makes each document's set of word shingles (64-bit
   hashes), a key of the whole set, and a MinHash signature.  Equal sets are one
   *class* from here on, so exact copies cost nothing further.
2. The first ``bands * rows`` minima form bands.  Classes that share a band meet
   in a bucket; a bucket of many classes is cut in blocks, and pairs of blocks
   go to different tasks.
3. In a task, signatures are compared batch by batch.  After each batch a pair
   is dropped once the posterior probability (uniform prior) that its similarity
   reaches the threshold falls below ``miss``.  Of the pairs that survive all
   batches the spanning forest of most matches is kept: it connects whatever
   they connect, with fewer edges than members.
4. The components of the forests are clusters; every link lies inside one.
   Survivors are verified exactly on whole sets, the likeliest first, and what
   is confirmed is contracted: a pair whose ends are already tied needs no
   verification.  A cluster of few members is settled in one task.  Of a large
   one the forest's edges are verified first; then only its survivors *between*
   the parts that these left are, in blocks, and blocks that hold one and the
   same part never meet.
5. Components of the confirmed links give each document its component.

At similarity 0.8 the default bands miss a pair with probability below 3e-6,
and verification drops it with probability of the order of ``miss``.  Whole sets
meet in blocks bounded by members and by bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .memory import hold
from .shared import need, save

BANDS, ROWS, HASHES, BATCH = 25, 4, 128, 32
BUCKET_BLOCK, CLUSTER_BLOCK = 256, 128  # classes of a bucket (signatures) or cluster (whole sets) that are held against as many others at a time
BLOCK_BYTES = 16 << 20  # of whole sets in a block, about; a single set may be larger
MISS = 1e-7
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_MULT = np.random.default_rng(20240229).integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_C1, _C2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _C1
    x = (x ^ (x >> np.uint64(29))) * _C2
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``width`` words; of the whole sequence if it is shorter; empty without words."""
    words = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    known = hold(("words",), dict)  # word -> hash
    got = list(map(known.get, words))
    if None in got:
        if len(known) > 300_000:
            known.clear()
        for i, h in enumerate(got):
            if h is None:
                got[i] = known[words[i]] = xxhash.xxh3_64_intdigest(words[i])
    h = np.array(got, dtype=np.uint64)
    n = max(1, len(h) - width + 1)
    x = np.full(n, min(width, len(h)), dtype=np.uint64)
    for k in range(min(width, len(h))):
        x = _mix(x * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    return np.unique(x)


def signature(s: np.ndarray) -> np.ndarray:
    """The minima of ``HASHES`` hash functions over a set that is not empty."""
    low = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint64)
    for at in range(0, len(s), 2048):
        low = np.minimum(low, ((s[at : at + 2048, None] * _MULT) >> np.uint64(32)).min(0))
    return low


@cache
def least_matches(percent: int, miss: float) -> tuple[int, ...]:
    """After each batch of hashes, the matches below which P(similarity >= percent/100) is under ``miss``."""
    t, out = percent / 100, []
    for n in range(BATCH, HASHES + 1, BATCH):
        # with a uniform prior: P(J >= t | m of n) = P(Binomial(n + 1, t) <= m)
        tail, m = 0.0, 0
        while m <= n:
            tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if tail >= miss:
                break
            m += 1
        out.append(m)
    return tuple(out)


def survivors(x: np.ndarray, y: np.ndarray, percent: int, miss: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index pairs (of rows of signature matrices ``x`` and ``y``) that no batch has ruled out, and their matches."""
    i, j, have = None, None, None
    for k, least in enumerate(least_matches(percent, miss)):
        part = slice(k * BATCH, (k + 1) * BATCH)
        if i is None:
            match = (x[:, None, part] == y[None, :, part]).sum(2)
            i, j = np.nonzero(match >= least)
            have = match[i, j]
        else:
            have = have + (x[i, part] == y[j, part]).sum(1)
            good = have >= least
            i, j, have = i[good], j[good], have[good]
    return i, j, have


def likeliest(sigs: list[bytes], first: int, percent: int, miss: float) -> list[tuple[int, int]]:
    """The surviving pairs among rows (``first`` = their number) or between the first ``first`` and the others, most matches first."""
    m = np.frombuffer(b"".join(sigs), np.uint8).reshape(len(sigs), HASHES)
    i, j, have = survivors(m[:first], m if first == len(m) else m[first:], percent, miss)
    if first == len(m):
        one = i < j
        i, j, have = i[one], j[one], have[one]
    else:
        j = j + first
    order = np.lexsort((j, i, -have))
    return list(zip(i[order].tolist(), j[order].tolist(), strict=True))


class Forest:
    """Parts of 0..n-1 that confirmed pairs tie together; ``edges`` are the pairs that tied something."""

    def __init__(self, n: int, parts: list | None = None) -> None:
        self.root, self.edges = list(range(n)), []
        seen: dict = {}
        for k, p in enumerate(parts or ()):
            self.root[k] = seen.setdefault(p, k)

    def find(self, k: int) -> int:
        root = self.root
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    def grow(self, pairs: list[tuple[int, int]], linked=lambda i, j: True) -> list[tuple[int, int]]:
        """Goes through ``pairs`` in order; those between different parts are asked of ``linked`` and, if so, tie them."""
        for i, j in pairs:
            a, b = self.find(i), self.find(j)
            if a != b and linked(i, j):
                self.root[max(a, b)] = min(a, b)
                self.edges.append((i, j))
        return self.edges


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Decides exactly, on sorted sets of hashes."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of equal keys of sorted batches. The caller bounds a run's rows."""
    held: list[pa.RecordBatch] = []

    def cut(t: pa.Table, final: bool) -> Iterator[pa.Table]:
        change = np.zeros(t.num_rows, dtype=bool)
        for k in keys:
            c = t.column(k).to_numpy()
            change[1:] |= c[1:] != c[:-1]
        ends = [*np.flatnonzero(change).tolist(), t.num_rows]
        start = 0
        for e in ends if final else ends[:-1]:
            yield t.slice(start, e - start)
            start = e
        held[:] = [] if final else t.slice(start).combine_chunks().to_batches()

    for b in batches:
        if b.num_rows:
            yield from cut(pa.Table.from_batches([*held, b]), False)
    if held:
        yield from cut(pa.Table.from_batches(held), True)


def _blocked(df: DataFrame, block: int, id_col: str = "node") -> DataFrame:
    """Adds ``i, j``: each row of a group of more than ``block`` rows goes to every pair of blocks that its own is part of.

    ``own`` tells which of the two it belongs to.
    """
    n = (F.floor((F.col("members") - 1) / block) + 1).cast("int")
    mine = F.pmod(F.xxhash64(id_col), n).cast("int")
    out = df.withColumn("__n", n).withColumn("own", mine)
    out = out.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    return out.select(*[c for c in df.columns if c != "members"], F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own")


PAIRS = "a long, b long"


def _run_groups(work: DataFrame, keys: list[str], values: list[str], decide) -> DataFrame:
    """``a, b``: the edges that ``decide(values of the rows, how many are of the first block)`` finds in each group, as pairs of nodes.

    ``work`` holds ``keys``, ``node``, ``own`` (the block of a row) and ``values``.
    """

    def batch(a: list, b: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for g in _groups(batches, keys):
            if g.num_rows < 2:
                continue
            ids, own = g.column("node").to_numpy(), g.column("own").to_numpy()
            order = np.lexsort((ids, own))
            g = g.take(pa.array(order))
            ids, own = ids[order], own[order]
            edges = decide([g.column(v).to_pylist() for v in values], int((own == own[0]).sum()))
            a += [int(ids[i]) for i, _ in edges]
            b += [int(ids[j]) for _, j in edges]
            if len(a) > 10_000:
                yield batch(a, b)
                a, b = [], []
        if a:
            yield batch(a, b)

    return work.repartition(*keys).sortWithinPartitions(*keys).select(*keys, "own", "node", *values).mapInArrow(run, PAIRS)


def _verified(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``edges`` (``a, b``) that are links. ``sets``: ``node, bytes, hashes``.

    The neighbours of a node are dealt in groups of bounded size and bytes, and
    in a group their sets pass by one batch at a time.
    """
    size = sets.select(F.col("node").alias("b"), "bytes")
    load = edges.join(size, "b").groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    load = save(load.select("a", F.greatest(F.ceil(F.col("n") / CLUSTER_BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int").alias("groups")), "groups")
    hashes = sets.select("node", "hashes")
    heads = load.select("a", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("g")).join(hashes.withColumnRenamed("node", "a"), "a").select("a", "g", F.lit(None).cast("long").alias("b"), "hashes")
    tails = edges.join(load, "a").select("a", F.pmod(F.xxhash64("b"), "groups").cast("int").alias("g"), "b").join(hashes.withColumnRenamed("node", "b"), "b").select("a", "g", "b", "hashes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, None
        for batch in batches:
            good = []
            for a, g, b, h in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b is None:
                    now, own = (a, g), np.frombuffer(h, np.uint64)
                elif now == (a, g) and similar(own, np.frombuffer(h, np.uint64), percent):
                    good.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in good], pa.int64()) for k in (0, 1)], names=["a", "b"])

    dealt = heads.unionByName(tails).repartition("a", "g").sortWithinPartitions("a", "g", F.col("b").asc_nulls_first())
    return dealt.select("a", "g", "b", "hashes").mapInArrow(run, PAIRS)


def _between_parts(sets: DataFrame, links: DataFrame) -> DataFrame:
    """Rows of large clusters in pairs of blocks, ``i <= j``, for what is left to decide between the parts that ``links`` tie.

    ``sets``: ``component, node, bytes, ...``.  A large part has blocks of its
    own, which never meet each other; small parts share blocks.
    """
    parts = components(links).withColumnRenamed("component", "part")
    rows = sets.join(parts, "node", "left").withColumn("part", F.coalesce("part", "node"))
    size = save(rows.groupBy("component", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")), "parts")
    blocks = lambda n, b: F.greatest(F.ceil(n / CLUSTER_BLOCK), F.ceil(b / BLOCK_BYTES)).cast("int")
    size = size.withColumn("large", blocks(F.col("n"), F.col("bytes")) > 1)
    small = size.where("NOT large").groupBy("component").agg(blocks(F.sum("n"), F.sum("bytes")).alias("mixed"))
    open_ones = size.groupBy("component").agg(F.count(F.lit(1)).alias("parts")).where("parts > 1").select("component")
    size = save(size.join(open_ones, "component").join(small, "component", "left"), "parts")
    at = size.select("component", "part", F.when(F.col("large"), F.col("part")).alias("whose"), F.when(F.col("large"), blocks(F.col("n"), F.col("bytes"))).otherwise(F.col("mixed")).alias("of"))
    every = save(at.select("component", "whose", "of").distinct().select("component", "whose", F.explode(F.sequence(F.lit(0), F.col("of") - 1)).alias("chunk")).select("component", "whose", F.xxhash64("whose", "chunk").alias("block")), "blocks")
    x, y = every.select("component", F.col("whose").alias("w"), F.col("block").alias("own")), every.select("component", F.col("whose").alias("v"), F.col("block").alias("other"))
    # blocks, not rows, of a cluster meet; those of one large part do not
    meet = x.join(y, "component").where(~F.coalesce(F.col("w") == F.col("v"), F.lit(False))).select("component", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    chunk = F.when(F.col("whose").isNotNull(), F.pmod(F.xxhash64("node"), "of")).otherwise(F.pmod(F.xxhash64("part"), "of")).cast("int")
    placed = rows.join(at, ["component", "part"]).withColumn("own", F.xxhash64("whose", chunk))
    return placed.join(meet, ["component", "own"])


SKETCH = T.StructType([T.StructField("n_shingles", T.LongType()), T.StructField("set_key", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sig", T.BinaryType())])


def sketches(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_shingles, set_key (128 bits), bands, sig`` of every row; the last three are null for an empty set."""
    need(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, keys, bands, sigs = [], [], [], []
            for t in b.column(1).to_pylist():
                s = shingles(t, width)
                n.append(len(s))
                if not len(s):
                    keys.append(None)
                    bands.append(None)
                    sigs.append(None)
                    continue
                keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                low = signature(s)
                x = np.arange(1, BANDS + 1, dtype=np.uint64)
                for k in range(ROWS):
                    x = _mix(x * np.uint64(0x9E3779B97F4A7C15) + low[k : BANDS * ROWS : ROWS])
                bands.append(x.view(np.int64).tolist())
                sigs.append(low.astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())], names=[id_col, *SKETCH.names])

    schema = T.StructType([T.StructField(id_col, T.LongType()), *SKETCH.fields])
    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)


def near_dedup(docs: DataFrame, width: int = 5, percent: int = 80, miss: float = MISS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_shingles, component_id, kept`` for every row of ``docs``; ids are integers.

    Two documents are linked if their sets of ``width``-word shingles have a
    Jaccard similarity of at least ``percent``/100; ``component_id`` is the
    smallest id reachable over links and ``kept`` tells whether it is the row's
    own.  Words are runs of characters other than ASCII white space; A-Z are
    lower-cased.  Texts without words, and null ids, are linked with nothing (a
    null id has a null component and is kept).  Rows with one id form one
    document for linking and each keep their own ``n_shingles``.  An empty table
    gives an empty result.
    """
    if id_col.lower() in {"n_shingles", "component_id", "kept", "set_key", "bands", "sig", "node"}:
        raise ValueError(f"the id column may not be called {id_col}")
    seen = save(sketches(docs, width, id_col, text_col), "sketches")
    live = seen.where(F.col("set_key").isNotNull() & F.col(id_col).isNotNull())
    # one row per different set; its node is the smallest id, bands and signature are the same in all its rows
    reps = save(live.groupBy("set_key").agg(F.min(id_col).alias("node"), F.first("bands").alias("bands"), F.first("sig").alias("sig"), (F.first("n_shingles") * 8).alias("bytes")), "classes")

    banded = reps.select("node", F.posexplode("bands").alias("band", "bucket"))
    full = banded.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    work = _blocked(banded.join(full, ["band", "bucket"]), BUCKET_BLOCK).join(reps.select("node", "sig"), "node")

    def by_signature(values: list[list], first: int) -> list[tuple[int, int]]:
        return Forest(len(values[0])).grow(likeliest(values[0], first, percent, miss))

    forest = save(_run_groups(work, ["band", "bucket", "i", "j"], ["sig"], by_signature).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "forest")
    clusters = save(components(forest).join(reps.select("node", "sig", "bytes"), "node"), "clusters")

    load = clusters.groupBy("component").agg(F.count(F.lit(1)).alias("members"), F.sum("bytes").alias("load"))
    load = save(load.withColumn("large", (F.col("members") > CLUSTER_BLOCK) | (F.col("load") > BLOCK_BYTES)).select("component", "large"), "load")
    wanted = save(clusters.join(load, "component"), "wanted")
    texts = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("text"))

    def sets_of(nodes: DataFrame) -> DataFrame:
        found = among(texts, "__id", nodes.select("node"))
        return _sets(found.hint("merge").join(nodes.withColumnRenamed("node", "__id"), "__id"), width)  # the same way at every size

    def exactly(values: list[list], first: int) -> list[tuple[int, int]]:
        sigs, hashes, parts = values
        sets = [np.frombuffer(h, np.uint64) for h in hashes]
        return Forest(len(sets), parts).grow(likeliest(sigs, first, percent, miss), lambda i, j: similar(sets[i], sets[j], percent))

    columns = ["sig", "hashes", "part"]
    links = _run_groups(sets_of(wanted.where("NOT large")).select("component", "node", F.lit(0).alias("own"), "sig", "hashes", F.col("node").alias("part")), ["component"], columns, exactly)
    if not load.where("large").isEmpty():
        sets = save(sets_of(wanted.where("large")), "sets")
        ends = forest.join(sets.select(F.col("node").alias("a")), "a", "left_semi")
        tied = save(_verified(ends, sets, percent), "links")
        links = links.union(tied).union(_run_groups(_between_parts(sets, tied), ["component", "i", "j"], columns, exactly))
    # an id with several sets ties them together
    nodes = live.select(F.col(id_col).alias("__id"), "set_key").join(reps.select("set_key", "node"), "set_key").select("__id", "node")
    several = nodes.groupBy("__id").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("__id", "lo")
    ties = nodes.join(several, "__id").select(F.col("node").alias("a"), F.col("lo").alias("b"))
    linked = components(links.union(ties))

    rows = seen.select(F.col(id_col), "n_shingles", F.when(F.col(id_col).isNotNull(), F.col("set_key")).alias("set_key"))
    out = rows.join(reps.select("set_key", "node"), "set_key", "left").join(linked, "node", "left")
    component = F.coalesce("component", "node", F.col(id_col))
    return out.select(id_col, "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col(id_col)).alias("kept"))


def among(texts: DataFrame, id_col: str, nodes: DataFrame) -> DataFrame:
    """``texts`` less most rows whose id is not among ``nodes`` (column ``node``); no row whose id is.

    A bitmap of the wanted ids' hashes is broadcast: of 2^20 to 2^26 bits, so at
    most 1.1 million words of 63 bits, whatever the input.  With more than some
    ten million wanted ids it lets more and more rows through, and they fall out
    in the join that follows.
    """
    bits = 1 << min(26, max(20, (16 * nodes.count()).bit_length()))
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    word, bit = F.expr("__at div 63"), F.expr("cast(__at % 63 as int)")
    words = nodes.select(at("node").alias("__at")).groupBy(word.alias("__word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("__bits"))
    spotted = texts.withColumn("__at", at(id_col)).join(F.broadcast(words), word == F.col("__word"))
    return spotted.where(F.call_function("shiftright", F.col("__bits"), bit).bitwiseAND(F.lit(1)) == 1).select(*texts.columns)


def _sets(texts: DataFrame, width: int) -> DataFrame:
    """``component, node, bytes, sig, hashes`` of rows that hold ``__id, text, component, bytes, sig``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                p = b.slice(at, 64)
                h = [shingles(t, width).tobytes() for t in p.column(4).to_pylist()]
                yield pa.RecordBatch.from_arrays([*p.columns[:4], pa.array(h, pa.binary())], names=["component", "node", "bytes", "sig", "hashes"])

    return texts.select("component", F.col("__id").alias("node"), "bytes", "sig", "text").mapInArrow(run, "component long, node long, bytes long, sig binary, hashes binary")
