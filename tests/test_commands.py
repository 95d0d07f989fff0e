import json
import sys
import types

import pytest
from pyspark.sql import functions as F

from loomstone import cli
from loomstone.operators import judging, relational
from loomstone.plans import catalogue, pipelines
from loomstone.sources import tables
from tests.test_operators import graph_of

BODY = "int f(int a) { return a + 1; /* a comment of a length that passes */ }"
DOCS = {"A": "Adds one to a number", "B": "Opens the socket and waits", "C": "Adds one to a number"}


class Judge:
    """Answers by what the prompt holds; longer summaries win."""

    def generate(self, prompts):
        def one(p):
            if "one letter" in p:
                a, b = (p.split(f"<summary_{x}>")[1].split(f"</summary_{x}>")[0] for x in "AB")
                return "A" if len(a) > len(b) else "B" if len(b) > len(a) else "they are alike"
            if "Questions:" in p:
                doc = p.split('"""')[1]
                return "\n".join("Yes" if q.split(" that ")[1].rstrip("?") in doc else "No." for q in p.split("Questions:\n")[1].split("\n"))
            return f"thought about {len(p)}"

        return [one(p) for p in prompts]


@pytest.fixture
def plugged():
    module = types.ModuleType("plugged_parts")
    module.Judge, module.seen = Judge, []
    module.train = lambda rows: module.seen.append(sorted(rows.columns))
    from loomstone.operators.generate import EchoGenerator

    module.Echo = EchoGenerator
    sys.modules["plugged_parts"] = module
    yield module
    del sys.modules["plugged_parts"]


def repositories(folder):
    for repo, rows in {"redis": {"A": ["B"], "B": [], "C": []}, "curl": {"A": [], "B": ["A"]}, "draft": {"A": []}}.items():
        (folder / repo / "0").mkdir(parents=True)
        (folder / repo / "0/raw_dataset.json").write_text(json.dumps({k: {"name": f"{repo}::f{k.lower()}", "path": f"/{repo}/x.c", "doc": DOCS[k] if repo == "redis" else f"{DOCS[k]} in {repo}", "code": BODY, "to": to} for k, to in rows.items()}))
    (folder / "info.csv").write_text("name,ready\nredis,true\ncurl,true\ndraft,false\n")


def run(spark, *arguments):
    assert cli.main(list(map(str, arguments)), spark) == 0


def test_all_commands_from_repositories_to_scores(spark, tmp_path, plugged):
    repositories(tmp_path / "in")
    at = lambda n: tmp_path / n
    run(spark, "merge_json", "--input", at("in"), "--output", at("merged"), "--csv", at("in/info.csv"))
    merged = spark.read.parquet(str(at("merged")))
    assert {r["id"] for r in merged.collect()} == {"redis/A", "redis/B", "redis/C", "curl/A", "curl/B"}
    assert merged.select("ord").distinct().count() == 5
    run(spark, "find_duplicates", "--input", at("merged"), "--output", at("pairs"), "--threshold", "0.9")
    links = {(r["field"], r["id"]): (r["class"], r["links"]) for r in spark.read.parquet(str(at("pairs"))).collect()}
    assert links["doc", "redis/C"] == ("redis/A", 1) and links["doc", "redis/B"][1] == 0 and links["code", "curl/A"][1] == 4
    run(spark, "convert_data_to_array", "--input", at("merged"), "--output", at("array.jsonl"))
    assert set(tables.read_rows(spark, str(at("array.jsonl"))).select("split").collect()) == {("test",)}
    run(spark, "get_subset", "--input", at("merged"), "--output", at("subset"), "--ids", "curl/B", "--depth", "1")
    assert {r["id"] for r in spark.read.parquet(str(at("subset"))).collect()} == {"curl/A", "curl/B"}
    merged.where("id = 'curl/B'").write.parquet(str(at("benchmark")))
    run(spark, "merge_and_dedup", "--input", at("in"), "--output", at("split"), "--csv", at("in/info.csv"), "--benchmark", at("benchmark"), "--train", "redis", "--test", "curl", "--test-paths", "/none/")
    split = {r["id"]: r["split"] for r in spark.read.parquet(str(at("split"))).collect()}
    assert split == {"curl/A": "test", "curl/B": "test"}  # all train rows have the code of a test row
    merged.withColumn("split", F.when(F.col("repo") == "redis", "train").otherwise("test")).write.parquet(str(at("splits")))
    run(spark, "get_context", "--input", at("splits"), "--output", at("context"))
    context = {r["id"]: r["context"] for r in spark.read.parquet(str(at("context"))).collect()}
    assert context["redis/A"] == "fb: Opens the socket and waits" and context["curl/B"] == "fa: Adds one to a number in curl"
    run(spark, "obfuscate", "--input", at("context"), "--output", at("obfuscated"), "--everything", at("merged"), "--rate", "1")
    run(spark, "dedup_train", "--input", at("context"), "--output", at("dedup"))
    assert {r["id"] for r in spark.read.parquet(str(at("dedup"))).collect() if r["split"] == "train"} == {"redis/A"}
    at("template.txt").write_text("{context}\n{code} {doc}")
    more = ("--template", at("template.txt"), "--generator", "plugged_parts:Echo")
    spark.read.parquet(str(at("context"))).where("split = 'test'").write.parquet(str(at("tests")))
    for name in ("run_predict", "run_recursive_predict"):
        run(spark, name, "--input", at("tests"), "--output", at(name), *more, "--benchmark", at("benchmark"), "--short", at(f"{name}_short"))
        assert spark.read.parquet(str(at(name))).count() == 2
        assert [r["id"] for r in spark.read.parquet(str(at(f"{name}_short"))).collect()] == ["curl/B"]
    run(spark, "evaluate_auto_metrics", "--input", at("run_predict"), "--output", at("metrics"))
    run(spark, "merge_all_metrics", "--automatic", at("metrics"), "--annotated", at("run_predict"), "--output", at("all_metrics"))
    assert {"Verbosity_auto", "Triviality_auto"} <= set(spark.read.parquet(str(at("all_metrics"))).columns)
    run(spark, "add_gpt_fact_halluc_responses", "--input", at("run_predict"), "--output", at("facts"), "--judge", "plugged_parts:Judge")
    assert spark.read.parquet(str(at("facts"))).where("fact_halluc_response like 'thought%'").count() == 2
    run(spark, "compare_pairwise_sufficiency_by_gpt", "--anchor", at("run_predict"), "--base", at("run_predict"), "--output", at("pairwise.json"), "--judge", "plugged_parts:Judge")
    got = spark.read.json(str(at("pairwise.json"))).first()
    assert got["score"] == 0 and sorted(got["pair_assessments"]) == ["N (curl::fa, curl/A)", "N (curl::fb, curl/B)"]
    at("template.txt").write_text("{code} {doc}")
    run(spark, "run_synthesize", "--input", at("context"), "--output", at("synth"), *more)
    run(spark, "run_finalize_synth", "--input", at("synth"), "--output", at("final"), "--lenient")
    run(spark, "run_train", "--input", at("context"), "--trainer", "plugged_parts:train")
    at("pairs.json").write_text(json.dumps({"prompt": ["a", "b"], "chosen": ["c", "d"]}))
    run(spark, "run_alignment", "--input", at("pairs.json"), "--trainer", "plugged_parts:train", "--columns", "prompt", "chosen")
    assert plugged.seen[1] == ["chosen", "ord", "prompt"]
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        run(spark, "dedup_train", "--input", at("context"), "--output", at("dedup"))
    assert len(cli.COMMANDS) == 19


def test_comparison_scores_and_order(spark):
    f = graph_of(spark, {"A": [], "B": [], "C": []}).withColumn("name", F.col("id"))
    anchor = f.withColumn("generated_summary", F.lit("four"))
    base = f.withColumn("generated_summary", F.expr("CASE id WHEN 'A' THEN 'longer' WHEN 'B' THEN 'x' ELSE 'four' END"))
    row = pipelines.compare(anchor, base, Judge(), "anchor", "base").first()
    assert [x.split(" ")[0] for x in row["pair_assessments"]] == ["B", "A", "N"] and row["score"] == 0
    with pytest.raises(ValueError, match="budget"):
        pipelines.compare(anchor, base, Judge(), "anchor", "base", budget=3)


def test_questions(spark):
    schema = "id string, name string, sufficiency_claims array<string>, illegal_facts array<string>"
    tests = spark.createDataFrame([("r/1", "f", ["opens", "closes", "opens"], []), ("r/2", "g", ["waits"], ["sorts"]), ("r/3", "h", [], None)], schema)
    said = spark.createDataFrame([("1", "f", "opens it"), ("2", "g", "waits"), ("3", "h", None)], "id string, name string, generated_summary string")
    rows, register = pipelines.question(tests, said, Judge())
    got = {r["id"]: r for r in rows.collect()}
    assert got["r/1"]["sufficiency_claims_score"] == pytest.approx(1 / 3)  # equal claims share one answer
    assert got["r/1"]["illegal_facts_answers"] is None and got["r/2"]["illegal_facts_score"] == 1
    assert got["r/3"]["sufficiency_claims_answers"] is None
    assert {r["test"]: r["pooled"] for r in register.collect()} == {"sufficiency_claims_score": 0.5, "illegal_facts_score": 1.0}


def test_null_prompts_are_not_asked(spark):
    class Strict:
        def generate(self, prompts):
            assert None not in prompts
            return ["x"] * len(prompts)

    df = spark.createDataFrame([("p",), (None,)], "said string")
    assert [r["answer"] for r in judging.ask(df, F.col("said"), Strict(), "answer").collect()] == ["x", None]
    assert judging.ask(df.where("false"), F.col("said"), Strict(), "answer").collect() == []


def test_side_by_side(spark):
    f = graph_of(spark, {"A": [], "B": []}).withColumns({"generated_summary": F.lit("x"), "context": F.lit("")})
    assert relational.side_by_side(f, f.where("id = 'A'")).count() == 1
    with pytest.raises(ValueError, match="different code"):
        relational.side_by_side(f, f.withColumn("code", F.lit("other")))


@pytest.mark.parametrize("name", ["find_duplicates", "rows_as_array", "one_order", "claim_scores", "paired_summaries"])
def test_new_queries_match_their_sql(spark, name):
    import duckdb

    folder = "/root/testdata/sf0.001"
    got = catalogue.QUERIES[name](spark, folder)
    con = duckdb.connect()
    for t in ("documents", "orders", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    want = con.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.fetchall())
