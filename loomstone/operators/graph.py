"""Call-graph operators: callee context, closure, pruning and bottom-up scheduling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..store import keep


def edges(functions: DataFrame) -> DataFrame:
    """``src, pos, dst`` of the callees of every row, in order; repeated ones stay."""
    return functions.select(F.col("id").alias("src"), F.posexplode("to").alias("pos", "dst"))


def inner_edges(functions: DataFrame) -> DataFrame:
    """Edges whose callee is a row itself."""
    return edges(functions).join(functions.select(F.col("id").alias("dst")), "dst", "left_semi")


def callee_context(functions: DataFrame, doc: str = "doc", separator: str = "\n*\n", with_parameters: bool = False, stripped: bool = False, late_null: str = "") -> DataFrame:
    """``id, context`` for every row: its callees' names and docs in order, without itself and unknown ones.

    A null doc reads as empty; with ``late_null`` set, a callee that comes later
    than its caller reads as that text instead.
    """
    text = F.col(doc)
    callee = functions.select(F.col("id").alias("dst"), F.col("ord").alias("dst_ord"), X.last_part("name", "::").alias("n"), text.alias("d"), (X.parameters("code") if with_parameters else F.lit("")).alias("p"))
    d = F.coalesce("d", F.when(F.col("dst_ord") > F.col("ord"), F.lit(late_null)).otherwise(""))
    p = F.col("p")
    if stripped:
        d, p = X.strip(d), X.strip(p)
    point = F.concat("n", F.lit("("), p, F.lit("): "), d) if with_parameters else F.concat("n", F.lit(": "), d)
    if stripped:
        point = X.strip(point)
    e = functions.select(F.col("id").alias("src"), "ord", F.posexplode("to").alias("pos", "dst")).where("src <> dst").join(callee, "dst")
    lists = e.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("pos", point.alias("t")))).alias("l"))
    context = F.array_join(F.transform("l", lambda x: x["t"]), separator)
    out = functions.select("id").join(lists.select(F.col("src").alias("id"), (X.strip(context) if stripped else context).alias("context")), "id", "left")
    return out.select("id", F.coalesce("context", F.lit("")).alias("context"))


def closure(functions: DataFrame, roots: DataFrame, depth: int | None = None) -> DataFrame:
    """``id, distance``: rows reachable from ``roots`` (column ``id``) over at most ``depth`` calls (None: any number; 0: nothing).

    One step per call: the newest ids meet the edges, those seen before are left out.
    """
    if depth is not None and depth <= 0:
        return functions.select("id", F.lit(0).alias("distance")).where("false")
    e = keep(inner_edges(functions).select("src", "dst").distinct(), "calls")
    front = functions.select("id").join(roots.select("id").distinct(), "id", "left_semi").withColumn("distance", F.lit(0))
    seen = front = keep(front, "front")
    step = 0
    while depth is None or step < depth:
        step += 1
        new = e.join(front.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct().join(seen.select("id"), "id", "left_anti")
        front = keep(new.withColumn("distance", F.lit(step)), "front")
        if front.isEmpty():
            break
        seen = keep(seen.union(front), "seen")
    return seen


def prune_to(functions: DataFrame, allowed: DataFrame) -> DataFrame:
    """``functions`` with ``to`` reduced to ids of ``allowed``, order and repetition kept."""
    e = edges(functions).join(allowed.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi")
    lists = e.groupBy("src").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "dst"))), lambda x: x["dst"]).alias("__to"))
    out = functions.join(lists.withColumnRenamed("src", "id"), "id", "left")
    return out.select(*[F.coalesce("__to", F.slice("to", 1, 0)).alias("to") if c == "to" else F.col(c) for c in functions.columns])


def referentially_closed(functions: DataFrame, known: DataFrame) -> DataFrame:
    """Rows all of whose callees are ids of ``known``. Applied once, not to a fixed point."""
    dangling = edges(functions).join(known.select(F.col("id").alias("dst")), "dst", "left_anti").select(F.col("src").alias("id")).distinct()
    return functions.join(dangling, "id", "left_anti")


def strong_components(functions: DataFrame) -> DataFrame:
    """``id, component``: rows that call each other in a circle share the smallest id among them.

    Rows without an open caller or callee are peeled off as single; in what is
    left, each round colours rows by the smallest id that reaches them and cuts
    off the rows of that colour that reach it back.
    """
    ids = keep(functions.select("id").distinct(), "ids")
    e = keep(inner_edges(functions).where("src <> dst").select("src", "dst").distinct(), "calls")
    done = None
    while True:
        while True:  # peel
            inside = e.select(F.col("src").alias("id")).intersect(e.select(F.col("dst").alias("id")))
            new = keep(e.join(inside.withColumnRenamed("id", "src"), "src", "left_semi").join(inside.withColumnRenamed("id", "dst"), "dst", "left_semi"), "calls")
            same = new.count() == e.count()
            e = new
            if same:
                break
        if e.isEmpty():
            break
        color = keep(e.select(F.col("src").alias("id")).union(e.select("dst")).distinct().withColumn("color", F.col("id")), "color")
        while True:  # smallest id that reaches each row
            better = e.join(color, e.src == color.id).select(F.col("dst").alias("id"), "color").union(color).groupBy("id").agg(F.min("color").alias("color"))
            new = keep(better, "color")
            moved = not new.exceptAll(color).isEmpty()
            color = new
            if not moved:
                break
        same_color = keep(e.join(color.select(F.col("id").alias("src"), F.col("color").alias("cs")), "src").join(color.select(F.col("id").alias("dst"), F.col("color").alias("cd")), "dst").where("cs = cd").select("src", "dst"), "calls")
        back = color.where("id = color").select("id")
        front = back
        while True:  # rows that reach their colour back
            new = keep(same_color.join(front.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id")).distinct().join(back, "id", "left_anti"), "back")
            if new.isEmpty():
                break
            back, front = keep(back.union(new), "back"), new
        found = keep(color.join(back, "id", "left_semi").select("id", F.col("color").alias("component")), "component")
        done = found if done is None else keep(done.union(found), "component")
        e = keep(e.join(found.select(F.col("id").alias("src")), "src", "left_anti").join(found.select(F.col("id").alias("dst")), "dst", "left_anti"), "calls")
    if done is None:
        return ids.select("id", F.col("id").alias("component"))
    return ids.join(done, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def schedule(functions: DataFrame, cycle_repeats: int = 2) -> DataFrame:
    """``id, height, visit``: callees have a smaller height than their callers; members of a circle are visited ``cycle_repeats`` times.

    Generations are longest paths from rows that no one calls, taken in reverse.
    A circle of k members takes ``k * cycle_repeats`` heights of its own; single
    rows of a generation share a height.  Inside a generation circles come first,
    by smallest id, and circle members go by ``ord``.
    """
    comp = keep(strong_components(functions), "components")
    e = inner_edges(functions).select("src", "dst").join(comp.select(F.col("id").alias("src"), F.col("component").alias("a")), "src").join(comp.select(F.col("id").alias("dst"), F.col("component").alias("b")), "dst")
    e = keep(e.where("a <> b").select("a", "b").distinct(), "calls")
    level = keep(comp.select(F.col("component").alias("c")).distinct().withColumn("gen", F.lit(0)), "level")
    while True:
        pushed = e.join(level.withColumnRenamed("c", "a"), "a").groupBy(F.col("b").alias("c")).agg((F.max("gen") + 1).alias("g"))
        new = keep(level.join(pushed, "c", "left").select("c", F.greatest("gen", F.coalesce("g", F.lit(0))).alias("gen")), "level")
        if new.exceptAll(level).isEmpty():
            break
        level = new
    members = comp.join(functions.select("id", "ord"), "id").join(level.withColumnRenamed("c", "component"), "component")
    size = members.groupBy("component", "gen").agg(F.count(F.lit(1)).alias("k"))
    spans = size.withColumn("span", F.when(F.col("k") > 1, F.col("k") * cycle_repeats).otherwise(0))
    # only circles need a place in their generation; single rows, most of a call graph, share a height
    in_gen = Window.partitionBy("gen").orderBy("component").rowsBetween(Window.unboundedPreceding, -1)
    circles = spans.where("k > 1").withColumn("before", F.coalesce(F.sum("span").over(in_gen), F.lit(0)))
    spans = circles.unionByName(spans.where("k = 1").withColumn("before", F.lit(0).cast("long")))
    # one row per generation: a running total over them needs one task, of as many rows as there are levels
    gens = spans.groupBy("gen").agg((F.sum("span") + F.max(F.when(F.col("k") == 1, 1).otherwise(0))).alias("tall"), F.sum("span").alias("cycles"))
    gens = gens.withColumn("base", F.coalesce(F.sum("tall").over(Window.orderBy(F.desc("gen")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = members.join(spans.select("component", "k", "before"), "component").join(gens.select("gen", "base", "cycles"), "gen")
    nth = F.row_number().over(Window.partitionBy("component").orderBy("ord")) - 1
    placed = placed.withColumn("nth", F.when(F.col("k") > 1, nth).otherwise(0))
    visits = placed.withColumn("visit", F.explode(F.sequence(F.lit(0), F.when(F.col("k") > 1, cycle_repeats - 1).otherwise(0))))
    height = F.when(F.col("k") > 1, F.col("base") + F.col("before") + F.col("visit") * F.col("k") + F.col("nth")).otherwise(F.col("base") + F.col("cycles"))
    return visits.select("id", "ord", height.cast("long").alias("height"), "visit")


def level_batches(scheduled: DataFrame, size: int) -> DataFrame:
    """Adds ``batch``: at most ``size`` rows of one height, by ``ord``. Numbered within the height.

    Rows are dealt in ranges of height and ``ord``; a row's number is that inside
    its range plus what the ranges before hold of its height, so a height of very
    many rows is never gathered.
    """
    if size < 1:
        raise ValueError(f"a batch has at least one row, not {size}")
    dealt = keep(scheduled.repartitionByRange("height", "ord").withColumn("__range", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("height", "__range").agg(F.count(F.lit(1)).alias("n"))  # a row for each height, and one more for each range
    earlier = Window.partitionBy("height").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("height", "__range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__offset"))
    nth = F.row_number().over(Window.partitionBy("height", "__range").orderBy("ord")) - 1 + F.col("__offset")
    return dealt.join(offsets, ["height", "__range"]).withColumn("batch", F.floor(nth / size).cast("long")).select(*scheduled.columns, "batch")


def dynamic_batches(lengths: list[int], size: int, longest_answer: int, most: int = 32) -> list[tuple[int, int]]:
    """(first, count) of batches over prompts sorted by length: the shorter a batch's first prompt against the very first, the more rows it takes."""
    if size < 1:
        raise ValueError(f"a batch has at least one prompt, not {size}")
    out, at = [], 0
    while at < len(lengths):
        n = size * max(1, min(most, lengths[0] // max(1, lengths[at] + longest_answer)))
        out.append((at, min(n, len(lengths) - at)))
        at += n
    return out


