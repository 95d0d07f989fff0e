"""Token sets by hashes, the pairs of similar ones over several fields, and greedy deduplication over them."""

import random
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from loomstone.operators import near_sets, similarity, token_sets
from loomstone.plans import pipelines
from loomstone.store import shared_folder

from tests.test_operators import near, some_texts


def words(x):
    return {t for t in re.split(r"[^a-z0-9]+", (x or "").lower()) if t}


def some_rows(seed, n=150):
    """Rows whose code is like another row's doc, or its own, or nothing; sets of up to 200 tokens with few changes."""
    rng = random.Random(seed)
    out = some_texts(seed, 40)
    for size in (9, 10, 40, 41, 120, 200):
        base = [f"t{rng.randrange(5000)}" for _ in range(size)]
        for _ in range(n // 6):
            t = list(base)
            for _ in range(rng.randrange(size // 9 + 1)):
                t[rng.randrange(size)] = f"t{rng.randrange(5000)}"
            out.append(" ".join(t))
    rng.shuffle(out)
    return [(str(i), i, t, rng.choice([t, out[rng.randrange(len(out))], None, f"int f {t}"])) for i, t in enumerate(out)]


def fields_of(rows):
    both = [f"{d}\n{c}" if (d or "").strip() and (c or "").strip() else None for _, _, d, c in rows]
    return {"doc": [words(r[2]) for r in rows], "code": [words(r[3]) for r in rows], "doc+code": [words(x) for x in both]}


def frame(spark, rows):
    return spark.createDataFrame(rows, "id string, ord long, doc string, code string").selectExpr("*", "false AS vendor")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_duplicates_of_all_fields_against_all_pairs(spark, seed):
    rows = some_rows(seed)
    got = {(r["field"], r["id"]): (r["class"], r["links"], {x["other"] for x in r["nearest"] or []}) for r in pipelines.find_duplicates(frame(spark, rows)).collect()}
    want = {}
    for field, s in fields_of(rows).items():
        names = [min((str(j) for j, y in enumerate(s) if y == x), default=None) for x in s]
        for i, x in enumerate(s):
            if x:
                want[field, str(i)] = (names[i], sum(near(x, s[j]) for j in range(len(s)) if j != i), {names[j] for j, y in enumerate(s) if y != x and near(x, y)})
    assert got == want and sum(bool(x[2]) for x in want.values()) > 50


@pytest.mark.parametrize("percent", [55, 80, 95, 99])
def test_pairs_at_other_thresholds(spark, percent):
    rows = some_rows(percent)
    s = [x for x in {frozenset(x) for x in fields_of(rows)["doc"]} if x]
    want = sum(100 * len(a & b) >= percent * len(a | b) for i, a in enumerate(s) for b in s[:i])
    assert near_sets.NearSets(frame(spark, rows), ["doc"], percent).pairs.count() == want


@pytest.mark.parametrize("at_once", [0, 30, 4_000_000])
def test_greedy_dedup_over_fields_by_rounds_and_at_once(spark, monkeypatch, at_once):
    monkeypatch.setattr(similarity, "AT_ONCE", at_once)
    rows = some_rows(7)
    fields, kept = fields_of(rows).values(), []
    for i in range(len(rows)):
        if not any(near(s[i], s[j]) for s in fields for j in kept):
            kept.append(i)
    got = similarity.greedy_dedup(frame(spark, rows), list(pipelines.FIELDS)).collect()
    assert len(got) == len(rows) and sorted(int(r["id"]) for r in got if r["kept"]) == kept


def test_no_token_lists_are_written(spark):
    """What goes to the shared folder is far less than the texts; they used to be written several times over as lists of tokens."""
    rng = random.Random(5)
    texts = [" ".join(f"t{rng.randrange(10**9)}" for _ in range(400)) for _ in range(200)]
    rows = frame(spark, [(str(i), i, t, f"int f({i}) {t}") for i, t in enumerate(texts)])
    used = lambda: sum(p.stat().st_size for p in Path(shared_folder(spark).removeprefix("file:")).rglob("*.parquet"))
    for run in (lambda: pipelines.find_duplicates(rows).count(), lambda: similarity.greedy_dedup(rows, list(pipelines.FIELDS)).count()):
        before = used()
        run()
        assert used() - before < 0.3 * sum(map(len, texts))


def test_tokens_end_with_their_row_and_long_ones_count_whole(monkeypatch):
    monkeypatch.setattr(token_sets, "STRETCH", 50)
    long = "x" * 300
    texts = ["ab", "cd ab", None, "", "é", "abc-é9", long, long + "y", "y" + long, "a" * 64, "a" * 65, "12345678", "123456789", "one two one"] + [" ".join(f"w{i % 7}" for i in range(k)) for k in range(40)]
    want = [words(x) for x in texts]
    h, row = token_sets.hashes(pa.array(["skipped", *texts])[1:])
    h, ends = token_sets.distinct(h, row, len(texts))
    assert np.diff(ends).tolist() == [len(x) for x in want]
    names = token_sets.names(h, ends).tolist()
    for i, x in enumerate(want):
        for j, y in enumerate(want):
            assert (x == y) == (names[i] == names[j])
            both = np.intersect1d(h[ends[i] : ends[i + 1]], h[ends[j] : ends[j + 1]])
            assert len(both) == len(x & y)
