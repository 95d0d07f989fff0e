"""Filter chains, similarity, graph, relational and generation operators on small tables."""

import json
import random

import pytest
from pyspark.sql import functions as F

from loomstone.operators import filters, generate, graph, obfuscate, relational, similarity
from loomstone.plans import pipelines
from loomstone.sources import tables


def graph_of(spark, links, docs=None):
    rows = [(k, i, f"ns::{k}", f"{k}.c", (docs or {}).get(k, k.lower()), f"int {k}(int a) {{ return 1; }}", "", v) for i, (k, v) in enumerate(links.items())]
    return spark.createDataFrame(rows, "id string, ord long, name string, path string, doc string, code string, context string, to array<string>")


def test_context(spark):
    f = graph_of(spark, {"A": ["B", "A", "X", "C", "B"], "B": [], "C": []})
    assert dict(graph.callee_context(f).collect())["A"] == "B: b\n*\nC: c\n*\nB: b"
    late = graph_of(spark, {"A": ["B"], "B": []}, {"B": None})
    assert dict(graph.callee_context(late).collect())["A"] == "B: "
    assert dict(graph.callee_context(late, late_null="None").collect())["A"] == "B: None"


@pytest.mark.parametrize(("depth", "want"), [(0, ""), (1, "ABC"), (2, "ABCD"), (None, "ABCD")])
def test_closure(spark, depth, want):
    f = graph_of(spark, {"A": ["B", "C"], "B": ["C"], "C": ["D"], "D": [], "E": ["A"]})
    roots = spark.createDataFrame([("A",), ("Z",)], "id string")
    assert "".join(sorted(r[0] for r in graph.closure(f, roots, depth).collect())) == want


def test_prune_and_closed(spark):
    f = graph_of(spark, {"A": ["B", "C", "B"], "B": ["A"], "C": []})
    allowed = spark.createDataFrame([("A",), ("B",)], "id string")
    assert {r["id"]: r["to"] for r in graph.prune_to(f, allowed).collect()} == {"A": ["B", "B"], "B": ["A"], "C": []}
    assert {r["id"] for r in graph.referentially_closed(f, allowed).collect()} == {"B", "C"}


def test_schedule(spark):
    f = graph_of(spark, {"A": ["B", "D"], "B": ["C"], "C": ["B"], "D": []})
    got = {(r["id"], r["visit"]): r["height"] for r in graph.schedule(f).collect()}
    assert got == {("B", 0): 0, ("C", 0): 1, ("B", 1): 2, ("C", 1): 3, ("D", 0): 4, ("A", 0): 5}


def test_strong_components_against_reachability(spark):
    rng = random.Random(3)
    for _ in range(3):
        n = 12
        links = {f"{i:02d}": [f"{rng.randrange(n):02d}" for _ in range(rng.randrange(3))] for i in range(n)}
        reach = {k: {k} for k in links}
        for _ in range(n):
            for k in links:
                reach[k] |= set().union(*[reach[x] for x in links[k]]) if links[k] else set()
        want = {k: min(x for x in links if x in reach[k] and k in reach[x]) for k in links}
        assert dict(graph.strong_components(graph_of(spark, links)).collect()) == want


def test_batches_of_one_height(spark):
    rows = [(f"r{k}", k, 0 if k < 300 else k % 3, 0) for k in random.Random(1).sample(range(400), 400)]
    got = graph.level_batches(spark.createDataFrame(rows, "id string, ord long, height long, visit int").repartition(7), 4).collect()
    want = {}
    for height in range(3):
        own = sorted(o for _, o, h, _ in rows if h == height)
        want |= {f"r{o}": n // 4 for n, o in enumerate(own)}
    assert {r["id"]: r["batch"] for r in got} == want
    assert graph.level_batches(spark.createDataFrame([], "id string, ord long, height long, visit int"), 4).count() == 0


def test_dynamic_batches():
    assert graph.dynamic_batches([1000, 200, 100], 2, 100) == [(0, 2), (2, 1)]
    assert graph.dynamic_batches([], 2, 100) == []


def rows_of(spark, texts):
    return spark.createDataFrame([(str(i), i, t) for i, t in enumerate(texts)], "id string, ord long, doc string")


def sets_of(texts):
    import re

    return [frozenset(x for x in re.split(r"[^a-zA-Z0-9]+", (t or "").lower()) if x) for t in texts]


def near(a, b):
    return bool(a) and bool(b) and 10 * len(a & b) >= 9 * len(a | b)


def some_texts(seed, n=60):
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(40)}" for _ in range(rng.randrange(1, 30))] for _ in range(8)]
    out = [None, "", "!!", "A b", "a B"]
    for _ in range(n):
        t = list(rng.choice(base))
        for _ in range(rng.randrange(3)):
            t[rng.randrange(len(t))] = f"w{rng.randrange(60)}"
        out.append(" ".join(t))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_similarity_join_against_all_pairs(spark, seed):
    texts = some_texts(seed)
    s = sets_of(texts)
    members, sets = similarity.classes(rows_of(spark, texts).withColumn("id", F.col("ord")), F.col("doc"))
    links = {r["id"]: r["links"] for r in similarity.neighbours(members, sets, similarity.similar_classes(sets)).collect()}
    assert links == {i: sum(near(s[i], s[j]) for j in range(len(s)) if j != i) for i in range(len(s)) if s[i]}


@pytest.mark.parametrize(("seed", "percent"), [(1, 90), (2, 80), (3, 100), (4, 55)])
def test_leaks_against_all_pairs(spark, seed, percent):
    """Sets of all sizes and thresholds; with sides only pairs across them count."""
    train, test = some_texts(seed, 50), some_texts(seed, 12) + some_texts(seed + 10, 10)
    s, t = sets_of(train), sets_of(test)
    alike = lambda a, b: bool(a) and bool(b) and 100 * len(a & b) >= percent * len(a | b)
    got = {int(r["id"]) for r in similarity.without_leaks(rows_of(spark, train), rows_of(spark, test), [F.col("doc")], percent).collect()}
    assert got == {i for i, x in enumerate(s) if not any(alike(x, y) for y in t)}
    _, sets = similarity.classes(rows_of(spark, train).withColumn("id", F.col("ord")), F.col("doc"))
    pairs = sorted((r["a"], r["b"]) for r in similarity.similar_classes(sets, percent).collect())
    first = {x: i for i, x in reversed(list(enumerate(s))) if x}
    assert pairs == sorted((i, j) for x, i in first.items() for y, j in first.items() if i < j and alike(x, y))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_greedy_dedup_against_a_loop(spark, seed):
    texts = some_texts(seed)
    s, kept = sets_of(texts), []
    for i in range(len(s)):
        if not any(near(s[i], s[j]) for j in kept):
            kept.append(i)
    got = similarity.greedy_dedup(rows_of(spark, texts), [F.col("doc")])
    assert sorted(int(r["id"]) for r in got.where("kept").collect()) == kept


def test_registered_greedy_dedup_sees_the_code(spark, tmp_path):
    from loomstone.plans import catalogue

    rows = [(0, None, "en", "src1"), (1, None, "en", "src1"), (2, None, "de", "src1"), (3, "some words", "en", "src2"), (4, "some words", "en", "src3")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["id"] for r in catalogue.QUERIES["greedy_dedup"](spark, str(tmp_path)).where("kept").collect()}
    assert got == {"0", "2", "3"}


def test_leaks_and_groups(spark):
    ten = "a b c d e f g h i j"
    train, test = rows_of(spark, [ten, "a b c d e f g h i", "z", None]), rows_of(spark, [ten])
    assert [r["id"] for r in similarity.without_leaks(train, test, [F.col("doc")]).orderBy("id").collect()] == ["2", "3"]
    groups = similarity.exact_groups(rows_of(spark, ["x y", "X, y", "y x", ""]), F.col("doc"))
    assert {r["id"]: (r["rep"], r["copies"]) for r in groups.collect()} == {"0": ("0", 2), "1": ("0", 2), "2": ("2", 1)}
    with pytest.raises(ValueError, match="two joined"):
        similarity.joined_field("a+b+c")


def test_histogram_of_nothing_and_of_one_value(spark):
    empty = spark.createDataFrame([], "v double")
    assert similarity.histogram(empty, "v").collect() == []
    assert sum(r["n"] for r in similarity.histogram(spark.createDataFrame([(1.0,), (1.0,)], "v double"), "v").collect()) == 2


@pytest.mark.parametrize("seed", [1, 2])
def test_histogram_of_row_pairs_against_all_pairs(spark, seed):
    texts = some_texts(seed)
    s = sets_of(texts)
    members, sets = similarity.classes(rows_of(spark, texts).withColumn("id", F.col("ord")), F.col("doc"))
    values = similarity.row_pair_values(sets, similarity.similar_classes(sets))
    want = [len(a & b) * 100 / len(a | b) for i, a in enumerate(s) for b in s[:i] if near(a, b)]
    got = values.groupBy(F.round("v", 6).alias("v")).agg(F.sum("weight")).collect()
    assert dict(map(tuple, got)) == {v: sum(round(x, 6) == v for x in want) for v in {round(x, 6) for x in want}}
    assert sum(x == 100 for x in want) > 0 and sum(r["n"] for r in similarity.histogram(values, "v", weight="weight").collect()) == len(want)


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_registered_row_histogram(spark, folder):
    import duckdb

    from loomstone.plans import catalogue

    path = f"/root/testdata/{folder}"
    got = catalogue.QUERIES["similarity_row_histogram"](spark, path).collect()
    assert sum(r["n"] for r in got) == catalogue.QUERIES["similarity_statistics"](spark, path).first()["pairs"]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/documents.parquet')")
    assert sorted(map(tuple, got)) == sorted(con.execute(catalogue.ORACLE_SQL["similarity_row_histogram"]).fetchall())


def test_filter_chain_fails_first(spark):
    row = ("x", 0, "ns::foo_", "p", "too short", "int f(int a) { return 1; }", "", [])
    f = spark.createDataFrame([row], "id string, ord long, name string, path string, doc string, code string, context string, to array<string>")
    f = f.withColumns({c: F.lit(None).cast("boolean") for c in tables.FLAGS})
    assert f.select(filters.TRAIN.first_fail()).first()[0] == 1
    good = f.withColumns({"doc": F.lit("Adds one to the given value"), "code": F.lit("int f(int a) { return a + 1; /* a comment of some length */ }")})
    assert good.select(filters.TRAIN.first_fail()).first()[0] == 7  # a name that ends in _ starts every doc
    assert good.withColumn("name", F.lit("foo")).select(filters.TRAIN.first_fail()).first()[0] == -1
    assert good.select(filters.SHARED.first_fail()).first()[0] == -1
    assert good.withColumn("code", F.lit("void f() { }")).select(filters.SHARED.first_fail()).first()[0] == 2
    assert {r["fail_idx"]: r["n"] for r in filters.TRAIN.histogram(good).collect()} == {k: int(k == 7) for k in range(-1, 18)}
    for chain in (filters.pre_synthesis(True, True), filters.STRICT_TARGET, filters.history_target(True)):
        assert good.withColumn("synth_doc", F.col("doc")).select(chain.first_fail()).first()[0] >= -1


def test_routing_and_information(spark):
    df = spark.createDataFrame([("FFmpeg", "x"), ("other", "/tidy/x"), ("redis", "y"), ("zzz", "z")], "repo string, path string")
    assert {r["repo"]: r["split"] for r in relational.route(df, ["redis"], ["ffmpeg"], ["/tidy"]).collect()} == {"FFmpeg": "test", "other": "test", "redis": "train"}
    info = spark.createDataFrame([("redis", True), ("zzz", False)], "name string, ready boolean")
    assert [r["repo"] for r in relational.ready_repositories(df, info).collect()] == ["redis"]
    with pytest.raises(ValueError, match="more than one"):
        relational.ready_repositories(df, info.union(info))


def test_scores(spark):
    v = lambda *x: relational.win_rate(spark.createDataFrame([(y,) for y in x], "verdict string")).first()["score"]
    assert v("A", "A", "B", "C", "N") == pytest.approx(-1 / 3)
    assert v("C", "C") == 0
    r = relational.score_register(spark.createDataFrame([("t", 1, 3), ("t", 2, 4)], "test string, passed int, total int")).first()
    assert (r["low"], r["high"], r["pooled"]) == (0.3333, 0.5, 0.4286)


def test_merges(spark):
    a = spark.createDataFrame([("1", "x", "old")], "id string, a string, b string")
    b = spark.createDataFrame([("1", None)], "id string, b string")
    assert relational.merge_metrics(a, b).first().asDict() == {"id": "1", "a": "x", "b": None}
    with pytest.raises(ValueError, match="same keys"):
        relational.merge_metrics(a, b.where("false"))
    tests, predicted = spark.createDataFrame([("r/1", "f")], "id string, name string"), spark.createDataFrame([("1", "f", "said")], "id string, name string, text string")
    assert relational.contained_in(tests, predicted).first()["text"] == "said"
    with pytest.raises(ValueError, match="2 predictions"):
        relational.contained_in(tests, predicted.union(predicted))
    assert relational.last_wins(spark.createDataFrame([("k", 1, "a"), ("k", 2, "b")], "k string, o int, v string"), "k", "o").first()["v"] == "b"


def test_obfuscation_is_stable_and_unique(spark):
    f = graph_of(spark, {"A": ["helper", "helper2"], "helper": [], "helper2": []}).withColumns({"code": F.lit("int helper(int a) { helper(1); helper2(); }"), "context": F.lit("helper: x")})
    names = dict(obfuscate.new_names(f).collect())
    assert len(set(names.values())) == len(names) and all(n.isalpha() for n in names.values())
    got = {r["id"]: r for r in obfuscate.obfuscate(f, f, rate=1.0).collect()}
    assert got["A"]["context"] == f"{names['helper']}: x"
    assert got["A"]["code"] == f"int helper(int a) {{ {names['helper']}(1); helper2(); }}"
    assert got["helper"]["code"] == "int helper(int a) { helper(1); helper2(); }"


def test_bottom_up_generation(spark):
    class Names:
        def generate(self, prompts):
            return [f" <{p.count('<')}>" for p in prompts]

    f = graph_of(spark, {"A": ["B"], "B": ["C"], "C": []})
    out = {r["id"]: r for r in generate.generate_bottom_up(f, "{context}|{code}", Names()).collect()}
    assert out["C"]["generated_context"] == ""
    assert out["A"]["generated_context"].startswith("B(int a): <1>")
    assert len(out) == 3


def test_sources(spark, tmp_path):
    rows = {"a": {"name": "f", "to": ["b"], "code": "x"}, "b": {"name": "g", "id": "own", "macro": True}}
    (tmp_path / "one.json").write_text(json.dumps(rows))
    got = {r["id"]: r for r in tables.read_functions(spark, str(tmp_path / "one.json")).collect()}
    assert got["a"]["to"] == ["b"] and got["own"]["macro"] is True and got["own"]["ord"] == 1
    (tmp_path / "two.json").write_text(json.dumps({"test": [{"id": "x", "name": "h"}]}))
    assert tables.read_functions(spark, str(tmp_path / "two.json")).first()["id"] == "x"
    (tmp_path / "three.json").write_text(json.dumps({"train": rows, "test": {}}))
    assert {r["split"] for r in tables.read_splits(spark, str(tmp_path / "three.json")).collect()} == {"train"}
    (tmp_path / "repos/redis/0").mkdir(parents=True)
    (tmp_path / "repos/redis/0/raw_dataset.json").write_text(json.dumps(rows))
    assert {r["repo"] for r in tables.read_repositories(spark, str(tmp_path / "repos")).collect()} == {"redis"}
    tables.write_new(spark.range(1), str(tmp_path / "out"))
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        tables.write_new(spark.range(1), str(tmp_path / "out"))


def test_pipelines_end_to_end(spark):
    f = graph_of(spark, {"A": ["B"], "B": [], "C": ["A"]}).withColumns({c: F.lit(False) for c in tables.FLAGS}).withColumns({"macro_code": F.lit(None).cast("string"), "code": F.concat(F.col("code"), F.lit("// padding of some length so that the code is long enough"))})
    assert {r["id"] for r in pipelines.get_context(f, False).collect()} == {"A", "B", "C"}
    synth = pipelines.synthesize(f, "{code}{doc}", generate.EchoGenerator())
    assert synth.count() == 3 and "synth_doc" in synth.columns
    assert pipelines.finalize_synthesis(synth, strict=False).count() >= 0
    flat = pipelines.predict(f, "{context}{code}{doc}", generate.EchoGenerator())
    assert pipelines.evaluate(flat).select("Verbosity_auto", "Triviality_auto").count() == 3
    assert pipelines.dedup_train(f).count() >= 1


def test_names_that_meet_stay_different(spark):
    """Letters that are one name's stem and another's filled-up stem, and many names for few letters."""
    names = spark.range(60_000).select(F.concat(F.lit("ns::f"), F.col("id").cast("string")).alias("name"))
    got = obfuscate.new_names(names, shortest=1, longest=3).agg(F.count("name"), F.countDistinct("new_name")).first()
    assert got[0] == got[1] == 60_000
    assert obfuscate.new_names(names).agg(F.countDistinct("new_name")).first()[0] == 60_000
