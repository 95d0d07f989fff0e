"""Exact groups, Jaccard similarity join, leak removal and greedy deduplication.

Texts are token *sets* (lower case, runs of ASCII letters and digits) and are
similar from ``percent``/100 on, compared in whole numbers.  Texts with equal
sets form one class; the join runs between classes only, so copies are never
paired with each other one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..store import keep
from .near_sets import NearSets, sound

SEPARATORS = r"[^a-zA-Z0-9]+"
AT_ONCE = 4_000_000  # links that one task of greedy_dedup takes


def tokens(c: Column) -> Column:
    """Tokens in order."""
    return F.filter(F.split(F.lower(c), SEPARATORS), lambda x: x != "")


def has_token(c: Column) -> Column:
    """Cheaper than counting tokens, which a filter would compute once more."""
    return F.lower(c).rlike("[a-zA-Z0-9]")


def joined_field(field: str) -> Column:
    """A field, or two joined by ``+``; null where a part is null or blank."""
    parts = field.split("+")
    if len(parts) > 2:
        raise ValueError(f"a field is one column or two joined by +, not {field}")
    return sound(field) if len(parts) == 1 else F.concat(sound(parts[0]), F.lit("\n"), sound(parts[1]))


def exact_groups(df: DataFrame, text: Column, id_col: str = "id", ord_col: str = "ord") -> DataFrame:
    """``id, rep, copies``: for each row with tokens the first row (by ``ord``) with the same token sequence, and how many there are."""
    joined = F.trim(F.regexp_replace(F.lower(text), SEPARATORS, " "))  # the tokens with one space between
    t = keep(df.where(has_token(text)).select(F.col(id_col).alias("id"), F.col(ord_col).alias("ord"), F.md5(joined).alias("h")), "hashes")  # texts are tokenised once
    g = t.groupBy("h").agg(F.min_by("id", "ord").alias("rep"), F.count(F.lit(1)).alias("copies"))
    return t.join(g, "h").select("id", "rep", "copies")


def classes(df: DataFrame, text: Column, id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """(members: ``id, class``; sets: ``class, copies, t``) of rows that have tokens. A class is named by its smallest id."""
    t = df.where(has_token(text)).select(F.col(id_col).alias("id"), F.array_sort(F.array_distinct(tokens(text))).alias("t"))
    t = t.withColumn("h", F.md5(F.array_join("t", " ")))
    g = keep(t.groupBy("h").agg(F.min("id").alias("class"), F.count(F.lit(1)).alias("copies"), F.first("t").alias("t")), "sets")
    return t.select("id", "h").join(g.select("h", "class"), "h").select("id", "class"), g.select("class", "copies", "t")


def similar_classes(sets: DataFrame, percent: int = 90, left: Column | None = None, right: Column | None = None) -> DataFrame:
    """``a, b, both, size_a, size_b`` (a < b) of the pairs of different sets that are similar.

    With conditions ``left`` and ``right`` over ``sets``, only pairs of a set of
    the left with one of the right, as ``a`` and ``b`` in any order; sets of one
    side are not held against each other.

    Tokens are ordered from rare to frequent.  Similar sets share one of the
    first ``n - ceil(t n) + 1`` tokens of both, so a frequent token leads two
    sets together only if they have little else.  Sets meet on a token *and* a
    class of sizes, which of similar sets are equal or next to each other; and
    only if what lies behind the token in either still suffices.  Candidates are
    then verified on whole sets.
    """
    sides = left is not None and right is not None
    each = sets.select("class", F.explode("t").alias("token"))
    often = each.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    ranked = each.join(often, "token").groupBy("class").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("r"))
    if sides:
        ranked = ranked.join(sets.select("class", left.alias("l"), right.alias("g")), "class")
    n = F.size("r")
    first = n - F.ceil(n * percent / 100).cast("int") + 1
    step = F.floor(F.log(n.cast("double")) / F.log(F.lit(100 / percent)) + 1e-9).cast("int") if percent < 100 else n
    shown = ["class", n.alias("n"), step.alias("step"), *(["l", "g"] if sides else [])]
    heads = keep(ranked.select(*shown, F.posexplode(F.slice(F.transform("r", lambda x: F.xxhash64(x["token"])), F.lit(1), first)).alias("pos", "token")), "prefixes")
    x = heads.select("token", F.col("step").alias("k"), F.col("class").alias("a"), F.col("n").alias("size_a"), F.col("pos").alias("pa"), F.col("step").alias("ka"), *(["l"] if sides else []))
    # the other side comes to its own class of sizes and the next smaller one; with sides, to the next larger one as well
    steps = [F.col("step"), F.col("step") - 1, *([F.col("step") + 1] if sides else [])]
    y = heads.select("token", F.explode(F.array(*steps)).alias("k"), F.col("class").alias("b"), F.col("n").alias("size_b"), F.col("pos").alias("pb"), F.col("step").alias("kb"), *(["g"] if sides else []))
    if sides:
        x, y = x.where("l").drop("l"), y.where("g").drop("g")
    close = (F.col("size_b") * 100 >= F.col("size_a") * percent) & (F.col("size_a") * 100 >= F.col("size_b") * percent)
    rest = F.least(F.col("size_a") - F.col("pa"), F.col("size_b") - F.col("pb"))  # the token (places count from 0) and what lies behind it
    enough = rest * (100 + percent) >= percent * (F.col("size_a") + F.col("size_b"))
    once = (F.col("a") != F.col("b")) if sides else (F.col("a") < F.col("b")) | (F.col("ka") != F.col("kb"))
    pairs = x.join(y, ["token", "k"]).where(once & close & enough)
    if not sides:
        turned = F.col("a") > F.col("b")
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(turned, F.col("size_b")).otherwise(F.col("size_a")).alias("size_a"), F.when(turned, F.col("size_a")).otherwise(F.col("size_b")).alias("size_b"))
    pairs = pairs.select("a", "b", "size_a", "size_b").distinct()
    hashed = sets.select("class", F.transform("t", lambda w: F.xxhash64(w)).alias("s"))
    both = pairs.join(hashed.select(F.col("class").alias("a"), F.col("s").alias("sa")), "a").join(hashed.select(F.col("class").alias("b"), F.col("s").alias("sb")), "b")
    out = both.select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("both"), "size_a", "size_b")
    return out.where(F.col("both") * 100 >= percent * (F.col("size_a") + F.col("size_b") - F.col("both")))


def similarity(both: str = "both") -> Column:
    return F.col(both) / (F.col("size_a") + F.col("size_b") - F.col(both))


def neighbours(members: DataFrame, sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """``id, class, links``: each row's class and the number of other rows that are similar to it, copies included."""
    size = sets.select("class", "copies")
    ends = pairs.select(F.col("a").alias("class"), F.col("b").alias("other")).union(pairs.select(F.col("b").alias("class"), F.col("a").alias("other")))
    near = ends.join(size.select(F.col("class").alias("other"), "copies"), "other").groupBy("class").agg(F.sum("copies").alias("near"))
    links = size.join(near, "class", "left").select("class", (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("links"))
    return members.join(links, "class").select("id", "class", "links")


def neighbour_lists(pairs: DataFrame) -> DataFrame:
    """``class, nearest``: for each class the similar ones with their similarity, in order of name."""
    sim = F.round(similarity(), 6).alias("sim")
    ends = pairs.select(F.col("a").alias("class"), F.col("b").alias("other"), sim).union(pairs.select(F.col("b").alias("class"), F.col("a").alias("other"), sim))
    return ends.groupBy("class").agg(F.array_sort(F.collect_set(F.struct("other", "sim"))).alias("nearest"))


def pair_statistics(members: DataFrame, sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row: pairs of similar rows, those with similarity 1, rows that have a neighbour, rows with tokens. Copies count as pairs without being listed."""
    c = F.col("copies").cast("long")
    own = sets.agg(F.coalesce(F.sum(c * (c - 1) / 2), F.lit(0)).cast("long").alias("equal"), F.coalesce(F.sum(c), F.lit(0)).alias("items"))
    size = sets.select("class", c.alias("n"))
    across = pairs.join(size.select(F.col("class").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("class").alias("b"), F.col("n").alias("nb")), "b").agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0)).cast("long").alias("across"))
    near = neighbours(members, sets, pairs).agg(F.count_if(F.col("links") > 0).alias("with_neighbour"))
    return own.crossJoin(across).crossJoin(near).select((F.col("equal") + F.col("across")).alias("pairs"), "equal", "with_neighbour", "items")  # one row each


def row_pair_values(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """``v, weight``: the similarity in percent and the number of pairs of rows that have it, by pair of classes and, at 100, by class with copies."""
    size = sets.select("class", F.col("copies").cast("long").alias("n"))
    across = pairs.join(size.select(F.col("class").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("class").alias("b"), F.col("n").alias("nb")), "b")
    across = across.select((F.col("both") * 100 / (F.col("size_a") + F.col("size_b") - F.col("both"))).alias("v"), (F.col("na") * F.col("nb")).alias("weight"))
    return across.union(size.where("n > 1").select(F.lit(100.0), F.expr("n * (n - 1) div 2")))


def histogram(values: DataFrame, column: str, bins: int = 10, width: int = 40, weight: str | None = None) -> DataFrame:
    """``bin, low, n, bar``: equal bins from the least to the greatest value (the last one closed), bars scaled to ``width``. No values give no rows.

    A row counts once, or as often as its column ``weight`` says.
    """
    span = values.agg(F.min(column).alias("lo"), F.max(column).alias("hi")).where("lo is not null")
    lo, step = F.col("lo"), (F.col("hi") - F.col("lo")) / bins
    at = F.when(step == 0, F.lit(bins // 2)).otherwise(F.least(F.lit(bins - 1), F.floor((F.col(column) - lo) / step)))
    counted = values.crossJoin(F.broadcast(span)).groupBy(at.cast("int").alias("bin")).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("n"))  # span is one row
    every = span.select("lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")).join(counted, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    most = every.agg(F.max("n").alias("most"))
    return every.crossJoin(F.broadcast(most)).select("bin", F.round(lo + F.col("bin") * step, 6).alias("low"), "n", F.floor(F.col("n") * width / F.col("most")).cast("int").alias("bar"))


def without_leaks(train: DataFrame, test: DataFrame, texts: list[Column], percent: int = 90, id_col: str = "id") -> DataFrame:
    """``train`` less the rows similar to a row of ``test`` in any of ``texts`` (Columns over both). Train rows are not held against each other."""
    out = train
    for text in texts:
        both = train.select(F.concat(F.lit("1"), F.col(id_col)).alias("id"), text.alias("x")).union(test.select(F.concat(F.lit("0"), F.col(id_col)).alias("id"), text.alias("x")))
        members, sets = classes(both, F.col("x"))
        members = keep(members, "members")
        in_test = F.startswith("id", F.lit("0"))
        where = members.groupBy("class").agg(F.bool_or(in_test).alias("tested"), F.bool_or(~in_test).alias("trained"))
        sets = keep(sets.join(where, "class"), "sides")
        near = similar_classes(sets, percent, F.col("tested"), F.col("trained")).select(F.col("b").alias("class"))
        leaky = members.where(~in_test).join(near.union(sets.where("tested AND trained").select("class")).distinct(), "class", "left_semi")
        out = out.join(leaky.select(F.substr("id", F.lit(2)).alias("__leak")), F.col(id_col).cast("string") == F.col("__leak"), "left_anti")
    return out


def near_rows(rows: DataFrame, fields: list[Column | str], percent: int = 90, id_col: str = "id") -> DataFrame:
    """``field, id, class, links, nearest`` of every row that has tokens in a field (its place in ``fields``): its class there, the number of other rows similar to it and the classes near its own with their similarity."""
    found = NearSets(rows, fields, percent, id_col)
    members = found.sets()
    sets = keep(members.groupBy("field", "s").agg(F.min("id").alias("class"), F.count(F.lit(1)).alias("copies")), "sets")
    ends = found.pairs.select(F.col("a").alias("s"), F.col("b").alias("o"), F.round(similarity(), 6).alias("sim"))
    ends = ends.union(found.pairs.select("b", "a", F.round(similarity(), 6)))
    ends = ends.join(sets.select("field", F.col("s").alias("o"), F.col("class").alias("other"), "copies"), "o").join(sets.select("field", "s"), ["field", "s"], "left_semi")
    near = ends.groupBy("field", "s").agg(F.sum("copies").alias("near"), F.array_sort(F.collect_set(F.struct("other", "sim"))).alias("nearest"))
    known = sets.join(near, ["field", "s"], "left").select("field", "s", "class", (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("links"), "nearest")
    return members.join(known, ["field", "s"]).select("field", "id", "class", "links", "nearest")


def greedy_dedup(rows: DataFrame, texts: list[Column | str], percent: int = 90, id_col: str = "id", ord_col: str = "ord") -> DataFrame:
    """``id, kept``: going through rows in order, a row stays unless it is similar to one that stayed.

    ``texts`` are Columns or fields as ``near_sets`` takes them.  Rows that share
    no class and have no similar one stay at once.  Rounds settle every other
    row whose earlier neighbours are settled: it stays if all of those went and
    goes if one stayed.  Copies beyond the first of their class in any text go
    at once when that first one settles, as all they are similar to it.  Each
    round's state is written to the shared folder.  As soon as what is open
    fits one task (``AT_ONCE`` links), that task goes through it in order.
    """
    base = rows.select(F.col(id_col).alias("id"), F.col(ord_col).alias("ord"))
    found = NearSets(rows, texts, percent, ord_col)
    # class -> class links and member -> class links keep the graph linear in the copies
    member = keep(found.sets().select(F.col("id").alias("node"), "field", F.col("s").alias("class")).where("node IS NOT NULL").distinct(), "nodes")
    counted = member.groupBy("field", "class").agg((F.count(F.lit(1)) > 1).alias("shared"))
    pair = found.pairs.select("a", "b")
    both = pair.union(pair.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = both.join(counted.select("field", F.col("class").alias("a")), "a").join(counted.select("field", F.col("class").alias("b")), ["field", "b"]).select("field", "a", "b")
    both = keep(both.union(counted.where("shared").select("field", "class", "class")).union(counted.where("NOT shared").select("field", F.col("class").alias("a")).join(both.select("field", "a").distinct(), ["field", "a"], "left_semi").select("field", "a", "a")), "links")
    live = keep(member.join(both.select("field", F.col("a").alias("class")).distinct(), ["field", "class"], "left_semi"), "live")
    gone = None
    while (left := live.count()) and left + both.count() > AT_ONCE:
        # the first open row of each class; a row is settled now if it is first among all open rows around it
        first = live.groupBy("field", "class").agg(F.min("node").alias("low"))
        around = both.join(first.select("field", F.col("class").alias("b"), "low"), ["field", "b"]).groupBy("field", F.col("a").alias("class")).agg(F.min("low").alias("low"))
        lowest = live.join(around, ["field", "class"]).groupBy("node").agg(F.min("low").alias("low"))
        now = keep(lowest.where("low >= node").select("node"), "stay")
        hit = live.join(now, "node").select("field", F.col("class").alias("b")).distinct()
        near = live.join(both.join(hit, ["field", "b"]).select("field", F.col("a").alias("class")).distinct(), ["field", "class"], "left_semi").select("node").distinct()
        settled = keep(near.join(now.withColumn("stay", F.lit(True)), "node", "left"), "settled")
        lost = settled.where("stay IS NULL").select("node")
        gone = lost if gone is None else keep(gone.union(lost), "gone")
        live = keep(live.join(settled.select("node"), "node", "left_anti"), "live")
        open_classes = live.select("field", "class").distinct()
        both = keep(both.join(open_classes.withColumnRenamed("class", "a"), ["field", "a"], "left_semi").join(open_classes.withColumnRenamed("class", "b"), ["field", "b"], "left_semi"), "links")
    if left:
        lost = keep(_in_order(live, both), "lost")
        gone = lost if gone is None else gone.union(lost)
    if gone is None:
        return base.select("id", F.lit(True).alias("kept"))
    return base.join(gone.select(F.col("node").alias("ord"), F.lit(False).alias("kept")), "ord", "left").select("id", F.coalesce("kept", F.lit(True)).alias("kept"))


def _in_order(live: DataFrame, both: DataFrame) -> DataFrame:
    """``node``: the rows that go, by one task through all of them. A class is taken once a row near it stays."""

    def go(batches):
        import numpy as np
        import pyarrow as pa

        t = pa.Table.from_batches(list(batches))
        link, node, field, x, y = (t.column(c).to_numpy() for c in ("link", "node", "field", "x", "y"))
        known, at = np.unique(np.concatenate([x, y[link]]), return_inverse=True)  # every class is at an end of a link
        of = len(known) * field.astype(np.int64)
        x, y = at[: len(x)] + of, at[len(x) :] + of[link]
        order = np.argsort(x[link], kind="stable")
        y = y[order]
        first = np.searchsorted(x[link][order], np.arange(len(known) * (int(field.max()) + 1) + 1))
        node, x = node[~link], x[~link]
        order = np.argsort(node, kind="stable")
        node, x = node[order], x[order]
        start = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        taken, lost = np.zeros(len(first), bool), []
        for i, j in zip(start.tolist(), [*start[1:].tolist(), len(x)]):
            if taken[x[i:j]].any():
                lost.append(int(node[i]))
            else:
                for c in x[i:j].tolist():
                    taken[y[first[c] : first[c + 1]]] = True
        yield pa.RecordBatch.from_arrays([pa.array(lost, pa.int64())], names=["node"])

    zero = F.lit(0).cast("long")
    both = both.select(F.lit(True).alias("link"), zero.alias("node"), "field", F.col("a").alias("x"), F.col("b").alias("y"))
    return both.union(live.select(F.lit(False), F.col("node").cast("long"), "field", "class", zero)).coalesce(1).mapInArrow(go, "node long")
