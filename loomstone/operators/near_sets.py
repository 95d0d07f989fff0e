"""Which rows have equal token sets in some fields and which sets are similar, for all fields in one go.

Sets of all fields meet together, so that a text that is the same in two fields
counts once.  Texts are read three times: for the names of the sets, for the
keys by which they meet (``token_sets.meetings``) and, of sets that met, for
their tokens.  No token list goes through a shuffle but those.  Sets are told
apart by 64 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..store import keep
from . import token_sets as T

RECORDS = 250_000  # keys that meet in one go
PAIRS = 50_000  # pairs that are verified in one go
FEW = 500_000  # ids that are sent to every executor


def sound(field: str) -> Column:
    """A column; null where it is blank."""
    return F.when(F.col(field).rlike(r"(?U)\S"), F.col(field))


class NearSets:
    """``members``: ``id, s0, s1, ...``, the set of each field, null without tokens; ``pairs``: ``a, b, both, size_a, size_b`` of the similar sets (a < b)."""

    def __init__(self, rows: DataFrame, fields: list[Column | str], percent: int = 90, id_col: str = "id") -> None:
        """A field is a text, the name of a column, or two names joined by ``+``."""
        if len(fields) > 7:
            raise ValueError("seven fields at most")
        texts: dict[str, Column] = {}
        self.fields: list[tuple[int, ...]] = []
        for k, field in enumerate(fields):
            parts = {f"text {k}": field} if isinstance(field, Column) else {f"column {x}": sound(x) for x in field.split("+")}
            if len(parts) > 2:
                raise ValueError(f"a field is one column or two joined by +, not {field}")
            texts |= parts
            self.fields.append(tuple(list(texts).index(x) for x in parts))
        self.percent = percent
        self.rows = rows.select(F.col(id_col).alias("id"), *[F.lower(c).alias(f"t{k}") for k, c in enumerate(texts.values())])
        self.spark = rows.sparkSession
        self.id_type = self.rows.schema["id"].dataType.simpleString()
        columns, kinds = [f"s{k}" for k in range(len(fields))], self.fields

        def name(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for b in batches:
                sets = T.field_sets(b.columns[1:], kinds)
                none = [np.diff(ends) == 0 for _, ends in sets]
                named = [pa.array(T.names(*x), mask=m) for x, m in zip(sets, none)]
                size = np.sum([np.diff(ends) for _, ends in sets], axis=0)
                yield pa.RecordBatch.from_arrays([b.column(0), *named, pa.array(size, pa.int64())], names=["id", *columns, "n"])

        named = self.rows.mapInArrow(name, f"id {self.id_type}, {', '.join(f'{c} long' for c in columns)}, n long")
        self.members = keep(named, "members")
        self.pairs = keep(self._pairs(), "pairs")

    def sets(self) -> DataFrame:
        """``field, s, id`` of every row that has tokens in a field."""
        each = F.array(*[F.struct(F.lit(k).alias("field"), F.col(f"s{k}").alias("s")) for k in range(len(self.fields))])
        return self.members.select("id", F.explode(each).alias("x")).select("x.field", "x.s", "id").where("s is not null")

    def _pairs(self) -> DataFrame:
        percent, kinds = self.percent, self.fields
        pair = "a long, b long, both long, size_a long, size_b long"
        if percent >= 100:
            return self.spark.createDataFrame([], pair)
        tokens = self.members.agg(F.sum("n")).first()[0] or 0
        share = (100 - percent) / (100 + percent) * 4.5  # keys of a set for each of its tokens, about
        groups = max(16, math.ceil(tokens * share / RECORDS))
        parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(groups / 8))

        def meet(batches: Iterator) -> Iterator:
            import pyarrow as pa

            sizes, seen, waiting, count = T.Sizes(percent, 1 << 31), {}, [], 0

            def dealt():
                at = np.concatenate([x for x, _ in waiting]) * groups >> 32
                order = np.argsort(at, kind="stable")
                at, x = at[order], np.concatenate([x for _, x in waiting])[order]
                start = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
                blobs = [x[i:j].tobytes() for i, j in zip(start.tolist(), [*start[1:].tolist(), len(x)])]
                return pa.RecordBatch.from_arrays([pa.array(at[start].astype(np.int32)), pa.array(blobs, pa.binary())], names=["part", "x"])

            for b in batches:
                fields = T.field_sets(b.columns[1:], kinds)
                fresh: dict[int, list[int]] = {}  # the set, then its fields, a field and a row where it is
                for k, (h, ends) in enumerate(fields):
                    for i, s in enumerate(T.names(h, ends).tolist()):
                        if ends[i + 1] > ends[i]:
                            fresh.setdefault(s, [0, k, i])[0] |= 1 << k
                new = [(s, *x) for s, x in fresh.items() if x[0] & ~seen.get(s, 0)]
                if len(seen) < 1_000_000:  # copies beyond those are dropped where they meet
                    seen.update((s, x | seen.get(s, 0)) for s, x, _, _ in new)
                if new:
                    cut = [fields[k][0][fields[k][1][i] : fields[k][1][i + 1]] for _, _, k, i in new]
                    got = T.meetings(np.concatenate(cut), np.cumsum([0, *map(len, cut)]), np.array([s for s, *_ in new]), np.array([x for _, x, _, _ in new]), sizes)
                    if len(got[0]):
                        waiting.append(got)
                        count += len(got[0])
                if count > RECORDS:
                    yield dealt()
                    waiting, count = [], 0
            if waiting:
                yield dealt()

        def meeting(batches: Iterator) -> Iterator:
            import pyarrow as pa

            def found():
                x = [np.concatenate(z) for z in zip(*T.met(np.frombuffer(b"".join(waiting), T.MEET), percent))]
                if x:
                    a, b, home = np.minimum(x[0], x[1]), np.maximum(x[0], x[1]), x[2]
                    order = np.lexsort((home, b, a))
                    a, b, home = a[order], b[order], home[order]
                    first = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
                    yield pa.RecordBatch.from_arrays([pa.array(z[first]) for z in (a, b, home)], names=["a", "b", "home"])

            waiting, part = [], None
            for batch in batches:
                for p, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if p != part and waiting:
                        yield from found()
                        waiting = []
                    part = p
                    waiting.append(x)
            if waiting:
                yield from found()

        keys = self.rows.drop("id").select(F.lit(0).alias("id"), *self.rows.columns[1:]).mapInArrow(meet, "part int, x binary")
        pairs = keys.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(meeting, "a long, b long, home long")
        pairs = keep(pairs.groupBy("a", "b").agg(F.min("home").alias("home")), "candidates")
        return self._verified(pairs, pair)

    def _verified(self, pairs: DataFrame, pair: str) -> DataFrame:
        """Pairs with the same home are verified together, those of a large one in pieces, so that each set goes to few places."""
        percent, kinds = self.percent, self.fields
        ends = keep(pairs.select(F.col("a").alias("s")).union(pairs.select("b")).distinct(), "wanted")
        ids = self.sets().join(ends, "s", "left_semi").groupBy("s").agg(F.min("id").alias("id")).select(F.col("id").alias("wanted")).distinct()
        ids = keep(ids, "ids")
        chosen = self.rows.join(F.broadcast(ids) if ids.count() <= FEW else ids, F.col("id").eqNullSafe(F.col("wanted")), "left_semi")

        def read(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for b in batches:
                out: dict[int, bytes] = {}
                for h, ends in T.field_sets(b.columns[1:], kinds):
                    for i, s in enumerate(T.names(h, ends).tolist()):
                        if ends[i + 1] > ends[i] and s not in out:
                            out[s] = h[ends[i] : ends[i + 1]].tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.array(list(out.values()), pa.binary())], names=["s", "t"])

        tokens = chosen.mapInArrow(read, "s long, t binary")
        # one row for 50,000 pairs at most
        large = pairs.groupBy("home").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > PAIRS).select("home", F.ceil(F.col("n") / PAIRS).alias("pieces"))
        places = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(pairs.count() / PAIRS) * 2)
        piece = F.when(F.col("pieces").isNull(), F.xxhash64("home")).otherwise(F.xxhash64("home", F.pmod(F.xxhash64("a"), F.col("pieces"))))
        placed = keep(pairs.join(F.broadcast(large), "home", "left").select(F.pmod(piece, F.lit(places)).cast("int").alias("place"), "a", "b"), "placed")
        needed = placed.select("place", F.col("a").alias("s")).union(placed.select("place", "b")).distinct().join(tokens, "s").select(F.col("place").alias("at"), "s", "t")

        def verify(pairs, sets):
            import pyarrow as pa

            if not pairs.num_rows:
                return pa.table({c: pa.array([], pa.int64()) for c in ("a", "b", "both", "size_a", "size_b")})
            known = {s: np.frombuffer(t.as_buffer(), np.uint64) for s, t in zip(sets.column("s").to_pylist(), sets.column("t"))}
            a, b, both = T.overlaps(pairs.column("a").to_numpy(), pairs.column("b").to_numpy(), known)
            na, nb = (np.array([len(known[x]) for x in z.tolist()], np.int64) for z in (a, b))
            near = both * 100 >= percent * (na + nb - both)
            return pa.table({c: z[near] for c, z in (("a", a), ("b", b), ("both", both), ("size_a", na), ("size_b", nb))})

        return placed.groupBy("place").cogroup(needed.groupBy("at")).applyInArrow(verify, pair)
