"""Projections, joins and aggregates over function tables and evaluation results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def prefix_ids(df: DataFrame, repo: Column) -> DataFrame:
    """``id`` and every id in ``to`` get their repository in front."""
    return df.withColumns({"id": F.concat_ws("/", repo, "id"), "to": F.transform("to", lambda x: F.concat_ws("/", repo, x))})


def in_one_order(rows: DataFrame, repo: str = "repo", order: str = "ord") -> DataFrame:
    """``order`` counts on from repository to repository (by name), so that it tells all rows apart. The offsets are one row a repository."""
    spans = rows.groupBy(repo).agg((F.max(order) + 1).alias("span"))
    before = F.sum("span").over(Window.orderBy(repo).rowsBetween(Window.unboundedPreceding, -1))
    offsets = spans.select(F.col(repo).alias("__repo"), F.coalesce(before, F.lit(0)).alias("__before"))
    return rows.join(offsets, F.col(repo).eqNullSafe(F.col("__repo"))).withColumn(order, F.col(order) + F.col("__before")).drop("__repo", "__before")


def ready_repositories(rows: DataFrame, info: DataFrame, name: str = "name", ready: str = "ready", repo: str = "repo") -> DataFrame:
    """Rows of repositories that ``info`` lists as ready; unknown ones are left out, one listed twice raises ValueError."""
    twice = info.groupBy(name).count().where("count > 1").select(name)
    bad = rows.select(F.col(repo).alias(name)).distinct().join(twice, name, "left_semi").take(1)
    if bad:
        raise ValueError(f"repository {bad[0][0]} has more than one row of information")
    return rows.join(info.where(F.col(ready)).select(F.col(name).alias(repo)), repo, "left_semi")


def route(df: DataFrame, train: list[str], test: list[str], test_paths: list[str], repo: str = "repo", path: str = "path") -> DataFrame:
    """Adds ``split``: by test repository, then test path, then train repository; other rows are dropped. Repositories ignore case."""
    low = F.lower(repo)
    in_path = reduce(lambda a, b: a | b, [F.col(path).contains(p) for p in test_paths], F.lit(False))
    split = F.when(low.isin([x.lower() for x in test]), "test").when(in_path, "test").when(low.isin([x.lower() for x in train]), "train")
    return df.withColumn("split", split).where("split is not null")


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with one key the last by ``order``."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*")


def overlay(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join on ``key``; columns of ``right`` replace those of ``left``, nulls included."""
    own = [c for c in left.columns if c == key or c not in right.columns]
    return left.select(*own).join(right, key)


def merge_metrics(annotated: DataFrame, automatic: DataFrame, key: str = "id") -> DataFrame:
    """``overlay``, after a check that both sides have the same keys (ValueError otherwise)."""
    a, b = annotated.select(key), automatic.select(key)
    if not a.exceptAll(b).isEmpty() or not b.exceptAll(a).isEmpty():
        raise ValueError("annotated and automatic rows do not have the same keys")
    return overlay(annotated, automatic, key)


def keep_benchmark(predicted: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``benchmark`` ids; a name that differs raises ValueError."""
    wrong = predicted.join(benchmark.select("id", F.col("name").alias("__name")), "id").where(~F.col("name").eqNullSafe(F.col("__name"))).take(1)
    if wrong:
        raise ValueError(f"the name of {wrong[0]['id']} differs from the benchmark's")
    return predicted.join(benchmark.select("id"), "id", "left_semi")


def prediction(df: DataFrame) -> DataFrame:
    """From ``whole_text`` and ``prompt_len``: ``prompt`` and ``generated_summary``; an own column of that name wins; tokens are dropped."""
    n = F.col("prompt_len")
    made = {"prompt": F.substr("whole_text", F.lit(1), n), "generated_summary": F.substr("whole_text", n + 1)}
    return df.withColumns({k: v for k, v in made.items() if k not in df.columns}).drop("input_ids", "attention_mask", "labels")


def anchor_pairs(anchor: DataFrame, base: DataFrame) -> DataFrame:
    """Base rows of each anchor's name: ``name, anchor_id, base_id``; not one to one raises ValueError."""
    a, b = anchor.select("name", F.col("id").alias("anchor_id")), base.select("name", F.col("id").alias("base_id"))
    out = a.join(b, "name")
    n, m, k = anchor.count(), base.count(), out.count()
    if not n == m == k:
        raise ValueError(f"{n} anchors and {m} base rows make {k} pairs")
    return out


def contained_in(tests: DataFrame, predictions: DataFrame) -> DataFrame:
    """Tests with the only prediction of their name whose id is part of theirs; test columns win. None or several raise ValueError."""
    p = predictions.select("name", F.col("id").alias("__pid"), *[c for c in predictions.columns if c not in tests.columns])
    out = tests.join(p, "name").where(F.contains("id", F.col("__pid")))
    counts = tests.select("id").join(out.groupBy("id").count(), "id", "left").where(~F.col("count").eqNullSafe(F.lit(1))).take(1)
    if counts:
        raise ValueError(f"{counts[0][0]} has {counts[0][1] or 0} predictions")
    return out.drop("__pid")


def side_by_side(left: DataFrame, right: DataFrame, doc: str = "generated_summary", most: int = 1000) -> DataFrame:
    """``id, code, left_doc, right_doc`` of the ids in both, the first ``most`` by ``ord``: a sheet for labelling. Different code or context raises ValueError."""
    a = left.select("id", "ord", "code", "context", F.col(doc).alias("left_doc"))
    b = right.select("id", F.col("code").alias("__code"), F.col("context").alias("__context"), F.col(doc).alias("right_doc"))
    both = a.join(b, "id")
    wrong = both.where(~F.col("code").eqNullSafe(F.col("__code")) | ~F.col("context").eqNullSafe(F.col("__context"))).take(1)
    if wrong:
        raise ValueError(f"{wrong[0]['id']} has different code or context on the two sides")
    return both.orderBy("ord", "id").limit(most).select("id", "code", "left_doc", "right_doc")


def verdict(c: Column) -> Column:
    """A judge's answer if it is one character, else ``N``."""
    return F.when(F.length(c) == 1, c).otherwise("N")


def win_rate(verdicts: DataFrame, column: str = "verdict") -> DataFrame:
    """One row: ``wins, losses, score``; the score runs from -1 (anchor A always wins) to 1, 0 without decisions."""
    a, b = F.count_if(F.col(column) == "A"), F.count_if(F.col(column) == "B")
    share = F.when(F.col("wins") + F.col("losses") == 0, 0.5).otherwise(F.col("wins") / (F.col("wins") + F.col("losses")))
    return verdicts.agg(a.alias("wins"), b.alias("losses")).select("wins", "losses", (((1 - share) - 0.5) * 2).alias("score"))


def pass_score(answers: Column, asked: Column, wanted: str = "Yes") -> Column:
    """Share of answers (a map by question) that start with ``wanted`` among the questions asked; null if none were."""
    good = F.size(F.filter(F.map_values(answers), lambda x: F.startswith(x, F.lit(wanted))))
    return F.when(F.size(asked) > 0, good / F.size(asked))


def score_register(results: DataFrame) -> DataFrame:
    """From ``test, passed, total``: ``test, low, high, pooled`` with four digits, half to even."""
    each = F.bround(F.col("passed") / F.col("total") * 10000, 0) / 10000
    return results.groupBy("test").agg(F.min(each).alias("low"), F.max(each).alias("high"), (F.bround(F.sum("passed") / F.sum("total") * 10000, 0) / 10000).alias("pooled"))


def within_budget(df: DataFrame, limit: int = 21) -> DataFrame:
    """``df`` if it has fewer rows than ``limit``, else ValueError: every row costs a paid call."""
    n = df.limit(limit).count()
    if n >= limit:
        raise ValueError(f"{limit} rows or more; the budget is under {limit}")
    return df


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names or ("id", "code", "doc", "name", "to") if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
