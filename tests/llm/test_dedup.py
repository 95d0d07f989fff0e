"""Exact, near and line deduplication against brute force, and their edge cases."""

import random
import re

import pytest
from pyspark.sql import functions as F

from loomstone.llm import components, exact_dedup, line_dedup, near_dedup


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "'x' AS kept", "1 AS n_lines")


def test_exact_groups(spark):
    rows = [(5, "a  b", "s"), (3, "a\tb", "s"), (9, "a b ", "s"), (2, None, "s"), (1, "", "s"), (4, "\x0b", None), (None, "a b", "s"), (3, "a\tb", "s"), (7, "ä " * 5000, "s")]
    got = {(r["doc_id"], r["text"]): r for r in exact_dedup.exact_dedup(docs_of(spark, rows)).collect()}
    assert got[5, "a  b"]["keep_id"] == 3 and got[5, "a  b"]["group_size"] == 4 and not got[5, "a  b"]["kept"]
    assert got[3, "a\tb"]["kept"] and got[9, "a b "]["group_size"] == 1
    assert got[2, None]["keep_id"] == 1 and got[4, "\x0b"]["keep_id"] == 4 and got[7, "ä " * 5000]["kept"]
    assert not got[None, "a b"]["kept"]
    assert exact_dedup.exact_dedup(docs_of(spark, rows).where("false")).count() == 0


def test_hash_collisions_are_told_apart_by_bytes(spark):
    rows = [(i, t, "s") for i, t in enumerate(["a", "b", "a", "c", "b", "a"])]
    poor = lambda c: F.when(c == "c", F.lit("x")).otherwise(F.lit("y"))
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.exact_dedup(docs_of(spark, rows), hash_fn=poor).collect()}
    assert got == {0: (0, 3), 2: (0, 3), 5: (0, 3), 1: (1, 2), 4: (1, 2), 3: (3, 1)}


def brute_components(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates(spark, width, monkeypatch):
    monkeypatch.setattr(near_dedup, "BUCKET_BLOCK", 8)
    monkeypatch.setattr(near_dedup, "CLUSTER_BLOCK", 4)
    rng = random.Random(width)
    base = [[f"w{rng.randrange(500)}" for _ in range(rng.randrange(20, 120))] for _ in range(6)]
    rows = [(1000, None), (1001, ""), (1002, " \t"), (1003, "one two"), (1004, "ONE  two"), (1005, "x " * 9000), (1006, "x")]
    for i in range(120):
        t = list(base[i % 6])
        for _ in range(rng.randrange(5)):
            t[rng.randrange(len(t))] = f"w{rng.randrange(500)}"
        rows.append((i, " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS kept", "2 AS node", "3 AS bands")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_dedup(df, width, 80).collect()}
    assert got == brute_components(rows, width, 80)


def variants(rng, base, n, changes):
    """``n`` copies of a list of words, each with a few words replaced."""
    for _ in range(n):
        t = list(base)
        for _ in range(rng.randrange(1, changes)):
            t[rng.randrange(len(t))] = f"w{rng.randrange(10**6)}"
        yield " ".join(t)


@pytest.mark.parametrize("block", [4, 16])
def test_large_clusters_are_contracted(spark, block, monkeypatch):
    """Clusters far larger than a block, with parts at all distances, links between parts and copies that chain."""
    monkeypatch.setattr(near_dedup, "BUCKET_BLOCK", 2 * block)
    monkeypatch.setattr(near_dedup, "CLUSTER_BLOCK", block)
    rng = random.Random(block)
    base = [f"w{rng.randrange(500)}" for _ in range(90)]
    texts = list(variants(rng, base, 60, 9))
    for step in range(8):  # a chain that walks away from the base, with a family at each end
        base = base[:]
        for k in range(step * 5, step * 5 + 3):
            base[k] = f"v{rng.randrange(10**6)}"
        texts.append(" ".join(base))
    texts += variants(rng, base, 40, 12)
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 4, 80).collect()}
    want = brute_components(rows, 4, 80)
    assert got == want and 1 < len({c for _, c, _ in want.values()}) < len(rows)


def test_a_family_of_thousands_and_a_text_of_two_million_words(spark):
    rng = random.Random(9)
    base = [f"w{rng.randrange(5000)}" for _ in range(400)]
    rows = list(enumerate(variants(rng, base, 3000, 6)))
    long = [f"w{k * 7919 % 999_983}" for k in range(2_000_000)]
    rows += [(9000, " ".join(long)), (9001, " ".join([*long[:1000], "x", *long[1001:]]))]
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), 4, 80).collect()}
    # every variant differs from the base by five words at most: at least 375 of 397 shingles are the base's
    assert got == {i: 0 for i, _ in rows[:3000]} | {9000: 9000, 9001: 9000}


def test_a_bitmap_of_ids_loses_none(spark):
    texts = spark.range(-5000, 5000).select(F.col("id").alias("__id"), F.lit("x").alias("text"))
    nodes = spark.range(-4000, 4000, 40).select(F.col("id").alias("node"))
    found = {r[0] for r in near_dedup.among(texts, "__id", nodes).collect()}
    assert found >= set(range(-4000, 4000, 40)) and len(found) < 400
    assert near_dedup.among(texts, "__id", nodes.where("false")).count() == 0


def test_near_edge_cases(spark):
    rows = [(None, "a b c d e f"), (4, "a b c d e f"), (4, "q r s t u v"), (9, "q r s t u v"), (7, "a b c d e f"), (7, "a b c d e f")]
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in got) == [(0, 0, True), (4, 4, True), (4, 4, True), (7, 4, False), (7, 4, False), (9, 4, False)]
    assert near_dedup.near_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_verification_bounds():
    for n, least in zip(range(32, 129, 32), near_dedup.least_matches(80, 1e-7), strict=True):
        assert 0 < least < 0.8 * n


def test_components_of_chains_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (102, 102), (None, 3)] + [(200, k) for k in range(201, 230)]
    got = dict(components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, **{k: 200 for k in range(200, 230)}}


LONG = "This line stands on every page of many sites"


def test_boilerplate_lines(spark):
    rows = [(i, f"own text number {i} that is long\n {LONG}\t\nshort", f"site{i % 6}") for i in range(12)]
    rows += [(50, f"{LONG}\nother line of some length here", None), (51, None, "s"), (52, "", "s"), (53, "\n\n", "s"), (None, f"{LONG}", "site1"), (3, rows[3][1], "site3")]
    got = line_dedup.line_dedup(docs_of(spark, rows)).collect()
    by_id = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows)
    assert by_id[0]["text"] == rows[0][1] and by_id[0]["n_removed"] == 0
    assert by_id[5]["text"] == "own text number 5 that is long\nshort" and (by_id[5]["n_lines"], by_id[5]["n_removed"]) == (3, 1)
    assert by_id[50]["text"] == "other line of some length here"
    assert by_id[51]["text"] is None and by_id[52]["n_lines"] == 0 and by_id[53]["text"] == "\n\n"
    assert by_id[None]["text"] == ""
    few = line_dedup.line_dedup(docs_of(spark, [r for r in rows if r[2] in ("site0", "site1", "site2", "site3")]))
    assert few.where("n_removed > 0").count() == 0  # four sites are under the threshold
    assert line_dedup.line_dedup(docs_of(spark, rows).where("false")).count() == 0


def test_sketches_far_from_the_threshold_are_trusted(spark):
    lines = spark.createDataFrame([(h, i, f"s{i % m}") for h, m in ((1, 5), (2, 4), (3, 300)) for i in range(600)], "hash long, id long, site string")
    got = {r["hash"]: r for r in line_dedup.site_counts(lines).collect()}
    assert set(got) == {1, 3} and got[1]["exact"] and got[1]["sites"] == 5 and not got[3]["exact"]


