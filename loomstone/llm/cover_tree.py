"""Exact top-k by inner product: a dual search of cover trees inside blocks, and bounds between blocks.

1. Vectors are dealt to the nearest of a bounded number of pivots; one pass
   finds each pivot's number of vectors and its covering radius.  A pivot of
   many vectors is cut in blocks by a hash, so that no task gets more than about
   ``data_block`` vectors at a time.
2. Every query is answered inside one block of the pivot with the highest bound.
   Its worst k-th score goes on to the next step.
3. A pivot is searched for a query only if the pivot's bound
   ``q.p + |q| r`` reaches that score.  Queries are dealt in blocks, too, and a
   vector travels only to the blocks of queries that need its pivot.
4. The best k of all blocks meet in one last ranking.

In a task there are two cover trees, one over the queries and one over the
vectors, which are walked together.  For a pair of nodes with centres q and p
and covering radii r and s, no inner product inside exceeds
``q.p + r |p| + s |q| + r s``; if that is below the worst k-th score of the
node's queries, the pair is dropped.  Equal vectors share a place in the tree,
with the k + 1 smallest ids: others can never be among the best k.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import need, save

DATA_BLOCK, QUERY_BLOCK, LEAF, STRIP = 8192, 2048, 32, 2048
PIVOTS = 1024  # at most; a table of them goes to every task
_NET = 256  # points among which centres of a level are picked at a time
NONE, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


@dataclass
class Tree:
    """A cover tree in flat arrays; node 0 is the root. ``kids`` of a node are node numbers, of a leaf none; ``rows`` its points."""

    centre: np.ndarray
    radius: np.ndarray
    kids: list[np.ndarray]
    rows: list[np.ndarray]

    @property
    def norm(self) -> np.ndarray:
        return np.sqrt((self.centre**2).sum(1))


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1)[None, :] - 2 * (x @ y.T), 0))


def net(x: np.ndarray, first: int, apart: float) -> list[tuple[int, np.ndarray]]:
    """(centre, members) of points ``x``: centres, ``first`` among them, lie more than ``apart`` from each other and members at most so far from theirs."""
    out, left, start = [], np.arange(len(x)), np.array([first])
    while len(left):
        pick = start if start is not None else left[:_NET]
        start = None
        d = _distances(x[pick], x[pick])
        centres, free = [], np.ones(len(pick), dtype=bool)
        for k in range(len(pick)):
            if free[k]:
                centres.append(k)
                free &= d[k] > apart
        d = _distances(x[left], x[pick[centres]])
        d[np.searchsorted(left, pick[centres]), np.arange(len(centres))] = 0  # whatever rounding says
        nearest = d.argmin(1)
        covered = d[np.arange(len(left)), nearest] <= apart
        out += [(int(pick[c]), left[covered & (nearest == k)]) for k, c in enumerate(centres)]
        left = left[~covered]
    return out


def cover_tree(x: np.ndarray) -> Tree:
    """Cover tree of the points ``x``.

    A node's children are centred on points of its own, its centre among them,
    lie apart by more than half its radius and cover their points within that
    half.  A node of at most ``LEAF`` points is a leaf, and so is one of equal
    points.  Points without structure give a node many children; no node is
    left whole for that.
    """
    centre, radius, kids, rows = [], [], [], []

    def node(members: np.ndarray, at: int) -> int:
        centre.append(x[at])
        radius.append(float(np.sqrt(((x[members] - x[at]) ** 2).sum(1).max())) if len(members) > 1 else 0.0)
        kids.append(np.zeros(0, dtype=np.int64))
        rows.append(members)
        return len(rows) - 1

    todo = [(node(np.arange(len(x)), 0), 0)]
    while todo:
        k, at = todo.pop()
        own = rows[k]
        if len(own) <= LEAF or not radius[k]:
            continue
        parts = [(int(own[c]), own[m]) for c, m in net(x[own], int(np.searchsorted(own, at)), radius[k] / 2)]
        if len(parts) == 1:  # only where floating point cannot tell the points apart
            continue
        kids[k] = np.array([node(m, c) for c, m in parts])
        todo += [(int(j), c) for j, (c, _) in zip(kids[k], parts, strict=True)]
    return Tree(np.array(centre), np.array(radius), kids, rows)


class Best:
    """The best k (score, id) of each query so far, an id once; ties go to the smaller id. ``least``: scores below it do not matter.

    ``pairs`` and ``dropped`` count node pairs that were looked at and ruled out,
    ``compared`` pairs of points.
    """

    def __init__(self, n: int, k: int, least: np.ndarray | None = None):
        self.k, self.score = k, np.full((n, k), NONE)
        self.id = np.tile(MOST - np.arange(k), (n, 1))
        self.least = np.full(n, NONE) if least is None else least
        self.pairs = self.dropped = self.compared = 0

    def floor(self, rows: np.ndarray) -> np.ndarray:
        """What a score must reach to matter, for each query."""
        return np.maximum(self.score[rows, -1], self.least[rows])

    def worst(self, rows: np.ndarray) -> float:
        low = self.floor(rows).min()
        return -np.inf if low == NONE else float(low)

    def add(self, q: np.ndarray, r: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Candidates: ``score`` and ``ids`` of the queries ``q[r]``."""
        good = score >= self.floor(q)[r]
        r, score, ids = r[good], score[good], ids[good]
        if not len(r):
            return
        mine = np.unique(r)
        row = np.concatenate([r, np.repeat(mine, self.k)])
        s = np.concatenate([score, self.score[q[mine]].reshape(-1)])
        i = np.concatenate([ids, self.id[q[mine]].reshape(-1)])
        order = np.lexsort((~s, i, row))  # ~s falls as s rises, without overflow
        row, s, i = row[order], s[order], i[order]
        once = np.ones(len(row), dtype=bool)
        once[1:] = (row[1:] != row[:-1]) | (i[1:] != i[:-1])
        row, s, i = row[once], s[once], i[once]
        order = np.lexsort((i, ~s, row))
        first = np.searchsorted(row[order], mine)
        pick = order[first[:, None] + np.arange(self.k)]  # each row has at least the k it had before
        self.score[q[mine]], self.id[q[mine]] = s[pick], i[pick]


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers, of any size; beyond a long they count as the largest or smallest one."""
    out = [sum(int(a) * int(b) for a, b in zip(u, v, strict=True)) for u, v in zip(q.tolist(), x.tolist(), strict=True)]
    return np.array([min(max(s, NONE + 1), MOST) for s in out], dtype=np.int64)


def dual_search(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: list[np.ndarray], k: int, least: np.ndarray | None = None) -> Best:
    """The best k rows for each query, its own id left out. ``ids[j]``: ids of point j, ascending, at most k + 1 needed.

    Components are whole numbers.  Where products stay under 2^53, floating
    point is exact; else it only picks candidates, with room for its error, and
    their scores are computed in whole numbers.
    """
    best = Best(len(q), k, least)
    if not len(q) or not len(x):
        return best
    width = max(map(len, ids))
    padded = np.full((len(ids), width), -1, dtype=np.int64)
    there = np.zeros((len(ids), width), dtype=bool)
    for j, own in enumerate(ids):
        padded[j, : len(own)], there[j, : len(own)] = own, True
    a, b = cover_tree(q), cover_tree(x)
    norm_a, norm_b = a.norm, b.norm
    largest = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    slack, small = 1e-9 * (1 + largest), largest < 2**53
    inner = np.array([len(c) > 0 for c in b.kids], dtype=bool)

    def bounds(n: int, nodes: np.ndarray) -> np.ndarray:
        """No inner product of a query of node ``n`` with a point of each of ``nodes`` is larger."""
        r = a.radius[n]
        return b.centre[nodes] @ a.centre[n] + r * norm_b[nodes] + b.radius[nodes] * (norm_a[n] + r) + slack

    def compare(rows: np.ndarray, points: np.ndarray) -> None:
        for at in range(0, len(points), STRIP):
            part = points[at : at + STRIP]
            best.compared += len(rows) * len(part)
            s = q[rows] @ x[part].T
            r, c = np.nonzero(s >= np.maximum(best.floor(rows).astype(float), -1e300)[:, None] - (0 if small else slack))
            s = s[r, c].astype(np.int64) if small else _exact(q[rows[r]], x[part[c]])
            who = padded[part[c]]
            ok = there[part[c]] & (who != q_ids[rows[r], None])
            best.add(rows, np.repeat(r, width)[ok.reshape(-1)], np.repeat(s, width)[ok.reshape(-1)], who[ok])

    stack = [(0, np.zeros(1, dtype=np.int64))]
    while stack:
        n, front = stack.pop()
        leaf = not len(a.kids[n])
        while len(front):
            limit = bounds(n, front)
            stays = limit >= best.worst(a.rows[n])
            best.pairs += len(front)
            best.dropped += len(front) - int(stays.sum())
            front, limit = front[stays], limit[stays]
            wide = inner[front]
            if not leaf:
                wide &= b.radius[front] >= a.radius[n]
            if not wide.any():
                break
            if leaf and best.worst(a.rows[n]) == -np.inf:
                # go down to the most promising leaf first: what it brings rules others out
                down = int(front[np.argmax(limit)])
                while inner[down]:
                    down = int(b.kids[down][np.argmax(bounds(n, b.kids[down]))])
                compare(a.rows[n], b.rows[down])
            front = np.concatenate([front[~wide], *(b.kids[k] for k in front[wide])])
        if not leaf:
            stack += [(int(c), front) for c in a.kids[n]]
            continue
        # leaves of the data, the most promising first
        limit = bounds(n, front)
        order = np.argsort(-limit, kind="stable")
        front, limit, at = front[order], limit[order], 0
        size = np.cumsum([len(b.rows[k]) for k in front])
        step = 4 * k
        while at < len(front) and limit[at] >= best.worst(a.rows[n]):
            stop = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + step)))
            take = front[at:stop][limit[at:stop] >= best.worst(a.rows[n])]
            compare(a.rows[n], np.concatenate([b.rows[k] for k in take]))
            at, step = stop, min(STRIP, 4 * step)
        best.pairs += len(front)
        best.dropped += len(front) - at
    return best


def _matrix(vectors: list[np.ndarray], wide: int | None = None) -> np.ndarray:
    """Rows of floats; shorter vectors end in zeros."""
    wide = max((len(v) for v in vectors), default=0) if wide is None else wide
    out = np.zeros((len(vectors), max(1, wide)))
    for row, v in zip(out, vectors, strict=True):
        row[: min(len(v), out.shape[1])] = v[: out.shape[1]]
    return out


def _search_block(frame: pd.DataFrame, k: int) -> pd.DataFrame:
    asks, data = frame[frame["ask"]], frame[~frame["ask"]]
    if asks.empty or data.empty:
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
    both = _matrix([*asks["v"], *data["v"]])
    q, x = both[: len(asks)], both[len(asks) :]
    x, place = np.unique(x, axis=0, return_inverse=True)
    ids: list[np.ndarray] = [np.zeros(0, np.int64)] * len(x)
    order = np.lexsort((data["id"].to_numpy(), place.reshape(-1)))
    sorted_place, sorted_id = place.reshape(-1)[order], data["id"].to_numpy()[order]
    cuts = np.searchsorted(sorted_place, np.arange(len(x) + 1))
    for j in range(len(x)):
        ids[j] = np.unique(sorted_id[cuts[j] : cuts[j + 1]])[: k + 1]
    q_ids = asks["id"].to_numpy()
    best = dual_search(q, q_ids, x, ids, k, asks["least"].to_numpy(np.int64))
    row, col = np.nonzero(best.score > NONE)
    return pd.DataFrame({"query_id": q_ids[row], "vec_id": best.id[row, col], "score": best.score[row, col]})


@dataclass(frozen=True)
class Pivots:
    """``blocks``: into how many a pivot's vectors are cut."""

    centre: np.ndarray
    radius: np.ndarray | None = None
    blocks: np.ndarray | None = None

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = _distances(x, self.centre)
        at = d.argmin(1)
        return at, np.sqrt(((x - self.centre[at]) ** 2).sum(1))

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """queries x pivots: no inner product with a vector of the pivot is larger."""
        norm = np.sqrt((q**2).sum(1))
        dot = q @ self.centre.T
        out = dot + norm[:, None] * self.radius[None, :]
        return out + 1e-9 * (1 + np.abs(out) + norm[:, None] * np.sqrt((self.centre**2).sum(1))[None, :])


def _by_batch(df: DataFrame, columns: list[str], schema: str, work) -> DataFrame:
    """``work`` (columns as Arrow arrays, vectors as a matrix) on every batch; the vectors are the last column of ``columns``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                vectors = part.column(len(columns) - 1)
                flat = vectors.flatten().to_numpy(zero_copy_only=False)
                cuts = np.concatenate([[0], np.cumsum(vectors.value_lengths().to_numpy(zero_copy_only=False))]).astype(int)
                yield work([part.column(k) for k in range(len(columns) - 1)], [flat[i:j] for i, j in zip(cuts, cuts[1:], strict=False)], vectors)

    return df.select(*columns).mapInArrow(run, schema)


def top_k(vectors: DataFrame, k: int = 5, is_query=None, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", data_block: int = DATA_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query the ``k`` rows of highest integer inner product.

    Components become ``floor(scale * x)``.  ``is_query`` is a Column (default:
    ids divisible by 50).  A query never meets its own id.  Ties go to the
    smaller id; a query with fewer than ``k`` candidates has fewer rows.  Rows
    with a null id, a null vector, or a null or non-finite component take no
    part.  Vectors of different lengths are compared as if the shorter ended in
    zeros; an empty vector scores 0.  Repeated rows count once; an id with
    several vectors takes part with its best, as candidate and as query.
    Components beyond a long count as the largest or smallest long, and so do
    scores; below that all scores are exact.
    """
    need(vectors, id_col, vector_col)
    ask = (F.pmod(F.col(id_col), F.lit(50)) == 0) if is_query is None else is_query
    x = F.col(vector_col).cast("array<double>")
    sound = F.col(id_col).isNotNull() & x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.where(F.coalesce(sound, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c * scale).cast("double")).alias("v"), F.coalesce(ask, F.lit(False)).alias("ask"))
    rows = save(rows.groupBy("id", "v").agg(F.max("ask").alias("ask")), "vectors")
    n, asked, wide = rows.agg(F.count(F.lit(1)), F.count_if("ask"), F.max(F.size("v"))).first()
    n_query = max(1, -(-asked // query_block))
    # the same few rows at every run: those of smallest hash
    few = max(1, min(PIVOTS, -(-n // data_block)))
    some = rows.select("v").orderBy(F.xxhash64("id", "v"), "id").limit(few).collect()
    spark, width = rows.sparkSession, max(1, wide or 0)
    pivots = Pivots(_matrix([np.array(r[0]) for r in some] or [np.zeros(width)], width))
    sent = spark.sparkContext.broadcast(pivots)  # at most PIVOTS vectors

    def assign(own: list, each: list[np.ndarray], vectors: pa.Array) -> pa.RecordBatch:
        at, far = sent.value.nearest(_matrix(each, width))
        return pa.RecordBatch.from_arrays([*own, pa.array(at.astype(np.int32)), pa.array(far), vectors], names=["id", "ask", "pivot", "far", "v"])

    dealt = save(_by_batch(rows, ["id", "ask", "v"], "id long, ask boolean, pivot int, far double, v array<double>", assign), "dealt")
    spans = dealt.groupBy("pivot").agg(F.max("far").alias("far"), F.count(F.lit(1)).alias("n")).collect()  # at most PIVOTS rows
    radius, blocks = np.full(len(pivots.centre), -np.inf), np.ones(len(pivots.centre), dtype=int)
    for r in spans:
        radius[r["pivot"]], blocks[r["pivot"]] = r["far"] * (1 + 1e-9), max(1, -(-r["n"] // data_block))
    sent_all = spark.sparkContext.broadcast(Pivots(pivots.centre, radius, blocks))
    cut = spark.createDataFrame([(int(p), int(b)) for p, b in enumerate(blocks)], "pivot int, blocks int")  # at most PIVOTS rows
    data = dealt.join(F.broadcast(cut), "pivot").select("id", "v", F.lit(False).alias("ask"), F.lit(NONE).alias("least"), "pivot", F.pmod(F.xxhash64("id", "v"), "blocks").cast("int").alias("part"))
    asks = dealt.where("ask").select("id", "v", F.pmod(F.xxhash64("id", "v"), F.lit(n_query)).cast("int").alias("qb"))

    def first_place(ids: pa.Array, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = limit.argmax(1)
        return at, ids.to_numpy(zero_copy_only=False) % sent_all.value.blocks[at]

    def first(own: list, each: list[np.ndarray], vectors: pa.Array) -> pa.RecordBatch:
        at, part = first_place(own[0], sent_all.value.bounds(_matrix(each, width)))
        return pa.RecordBatch.from_arrays([*own, pa.array(at.astype(np.int32)), pa.array(part.astype(np.int32)), vectors], names=["id", "qb", "pivot", "part", "v"])

    def search(work: DataFrame) -> DataFrame:
        """Of ``work``: queries with the pivots and parts to search them in."""
        places = work.select("qb", "pivot", "part").distinct()
        both = data.join(places, ["pivot", "part"]).select("qb", "pivot", "part", "id", "v", "ask", "least").unionByName(work.select("qb", "pivot", "part", "id", "v", F.lit(True).alias("ask"), "least"))
        found = both.groupBy("qb", "pivot", "part").applyInPandas(lambda f: _search_block(f, k), "query_id long, vec_id long, score long")
        return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    begun = save(_by_batch(asks, ["id", "qb", "v"], "id long, qb int, pivot int, part int, v array<double>", first).withColumn("least", F.lit(NONE)), "begun")
    early = save(search(begun).withColumn("rank", rank).where(F.col("rank") <= k).drop("rank"), "early")
    least = early.groupBy("query_id").agg(F.count(F.lit(1)).alias("c"), F.min("score").alias("s")).select(F.col("query_id").alias("id"), F.when(F.col("c") >= k, F.col("s")).otherwise(NONE).alias("least"))
    known = asks.join(least, "id", "left").select("id", "qb", F.coalesce("least", F.lit(NONE)).alias("least"), "v")

    def rest(own: list, each: list[np.ndarray], vectors: pa.Array) -> pa.RecordBatch:
        p = sent_all.value
        low = own[2].to_numpy(zero_copy_only=False)
        limit = p.bounds(_matrix(each, width))
        need_it = (limit >= np.where(low == NONE, -np.inf, low.astype(float))[:, None]) & (p.radius > -np.inf)[None, :]
        done = zip(*first_place(own[0], limit), strict=True)
        where = [[(int(j), b) for j in np.flatnonzero(row) for b in range(p.blocks[j]) if (j, b) != was] for row, was in zip(need_it, done, strict=True)]
        places = pa.array([[{"pivot": j, "part": b} for j, b in w] for w in where], pa.list_(pa.struct([("pivot", pa.int32()), ("part", pa.int32())])))
        return pa.RecordBatch.from_arrays([*own, places, vectors], names=["id", "qb", "least", "places", "v"])

    todo = _by_batch(known, ["id", "qb", "least", "v"], "id long, qb int, least long, places array<struct<pivot:int,part:int>>, v array<double>", rest)
    todo = save(todo.select("id", "qb", "least", F.explode("places").alias("at"), "v").select("id", "qb", "least", "at.*", "v"), "todo")
    found = early.unionByName(search(todo)).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


__all__ = ["Best", "Pivots", "Tree", "cover_tree", "dual_search", "net", "top_k"]
