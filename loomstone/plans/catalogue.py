"""The queries over the driver's tables and the SQL that says the same.

``documents`` stand in for functions: text is the doc, a made-up head around it
the code, source the repository, and ids link to others by a fixed rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions import text as X
from ..operators import filters, generate, graph, judging, obfuscate, relational, similarity
from ..sources import tables
from ..store import keep
from . import more_queries, pipelines

TEST, TRAIN, PATHS = ["SRC1"], ["src0", "src2", "src3", "src4"], ["/es/"]
TEMPLATE = "Summarise.\n{context}\n----\n{code} {doc}"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    n = d.count()
    callee = lambda a, b: F.pmod(F.col("doc_id") * a + b, F.lit(n)).cast("string")
    return d.select(
        F.col("doc_id").cast("string").alias("id"), F.col("doc_id").alias("ord"), F.concat(F.lit("ns::"), "source", F.lit("_"), "lang").alias("name"), F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/a.c")).alias("path"),
        F.col("source").alias("repo"), F.col("text").alias("doc"), F.concat(F.lit("int "), "source", F.lit("("), "lang", F.lit(") { "), F.coalesce("text", F.lit("")), F.lit(" }")).alias("code"), F.lit("").alias("context"),
        F.array(callee(3, 1), callee(7, 2)).alias("to"), *[F.when(F.col("source") == s, True).otherwise(False).alias(c) for c, s in (("system", "src5"), ("macro", "src6"), ("macro_exp", "src7"), ("vendor", "src8"), ("decl", "src9"), ("non_function", "src10"))],
    )


_FUNCTIONS = """f AS (SELECT CAST(doc_id AS VARCHAR) AS id, doc_id AS ord, 'ns::' || source || '_' || lang AS name, '/' || source || '/' || lang || '/a.c' AS path, source AS repo, lang, text AS doc,
    'int ' || source || '(' || lang || ') { ' || coalesce(text, '') || ' }' AS code, source = 'src5' AS system, source = 'src6' AS macro, source = 'src7' AS macro_exp, source = 'src8' AS vendor, source = 'src9' AS decl,
    [CAST((3 * doc_id + 1) % (SELECT count(*) FROM documents) AS VARCHAR), CAST((7 * doc_id + 2) % (SELECT count(*) FROM documents) AS VARCHAR)] AS "to" FROM documents)"""
_EDGES = """e AS (SELECT id AS src, ord, unnest(range(0, 2)) AS pos, unnest("to") AS dst FROM f)"""


def filter_first_fail(spark, sf_dir):
    return functions(spark, sf_dir).select("id", filters.TRAIN.first_fail().cast("int").alias("fail_idx"))


_FAIL = (
    r"""c AS (SELECT *, string_split(doc, '') AS ch, len(list_filter(regexp_split_to_array(doc, '\s+'), lambda x: x <> '')) AS w, lower(doc) AS lo FROM f),
    r AS (SELECT id, CAST(CASE WHEN length(doc) >= 250 THEN 0 WHEN NOT (w > 2 AND w < 70) THEN 1 WHEN length(code) <= 50 THEN 2 WHEN length(code) >= 4000 THEN 3
      WHEN contains(lo, '@') OR contains(lo, '\return') OR contains(lo, '\param') OR contains(lo, '\brief') OR contains(lo, '\since') THEN 4
      WHEN NOT macro AND regexp_matches(code, '^[^{]*\{\s*\}') THEN 5
      WHEN len(list_filter(range(1, len(ch) - 2), lambda i: ch[i] = ch[i+1] AND ch[i] = ch[i+2] AND ch[i] = ch[i+3])) > 0 THEN 6
      WHEN starts_with(lo, lower(name)) OR starts_with(lo, lower(string_split(name, ':')[-1])) OR starts_with(lo, lower(string_split(name, '_')[-1])) THEN 7
      WHEN contains(lo, 'see') OR contains(lo, 'fixme') OR contains(lo, 'todo') OR contains(lo, 'deprecated') OR contains(doc, 'NOTE') THEN 8
      WHEN system THEN 9 WHEN macro THEN 10 WHEN macro_exp THEN 11 WHEN vendor THEN 12 WHEN decl THEN 13
      WHEN doc <> '' AND NOT regexp_matches(doc, '[\x20-\x7E\s]') THEN 15 WHEN length(doc) + length(code) >= 5000 THEN 17 ELSE -1 END AS INTEGER) AS fail_idx FROM c)"""
)


def filter_histogram(spark, sf_dir):
    return filters.TRAIN.histogram(functions(spark, sf_dir)).select("fail_idx", "n")


def clean_text(spark, sf_dir):
    return functions(spark, sf_dir).select("id", X.collapse_repeats(X.trim_edges("doc")).alias("doc"))


def no_four_repeat(spark, sf_dir):
    return functions(spark, sf_dir).where(~X.four_repeated("doc")).select("id")


def split_route(spark, sf_dir):
    return relational.route(functions(spark, sf_dir), TRAIN, TEST, PATHS).select("id", "split")


def repo_info_join(spark, sf_dir):
    info = _table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").isin(1, 2).alias("ready"), "n_nationkey")
    rows = _table(spark, sf_dir, "supplier").join(info.select(F.col("n_nationkey").alias("s_nationkey"), F.col("name").alias("repo")), "s_nationkey").select("s_suppkey", "repo")
    return relational.ready_repositories(rows, info.select("name", "ready")).select("s_suppkey", "repo")


def exact_groups(spark, sf_dir):
    return similarity.exact_groups(functions(spark, sf_dir), F.col("doc"))


def _similar(spark, sf_dir):
    members, sets = similarity.classes(_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), F.col("text"))
    return members, sets, keep(similarity.similar_classes(sets), "pairs")


def similarity_links(spark, sf_dir):
    return similarity.neighbours(*_similar(spark, sf_dir))


def similarity_pairs(spark, sf_dir):
    return _similar(spark, sf_dir)[2].select("a", "b", F.round(similarity.similarity(), 6).alias("sim"))


def similarity_statistics(spark, sf_dir):
    return similarity.pair_statistics(*_similar(spark, sf_dir))


def neighbour_lists(spark, sf_dir):
    lists = similarity.neighbour_lists(_similar(spark, sf_dir)[2])
    return lists.select("class", F.array_join(F.transform("nearest", lambda x: x["other"].cast("string")), ",").alias("others"))


def similarity_histogram(spark, sf_dir):
    """Of pairs of different sets, each once; ``similarity_row_histogram`` is of all pairs of rows."""
    values = _similar(spark, sf_dir)[2].select((F.col("both") * 100 / (F.col("size_a") + F.col("size_b") - F.col("both"))).alias("v"))
    return similarity.histogram(values, "v").select("bin", "n", "bar")


def similarity_row_histogram(spark, sf_dir):
    """Of all pairs of similar rows, copies among them, as the reference prints it."""
    _, sets, pairs = _similar(spark, sf_dir)
    return similarity.histogram(similarity.row_pair_values(sets, pairs), "v", weight="weight").select("bin", "n", "bar")


_SETS = r"""t AS (SELECT doc_id AS id, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-zA-Z0-9]+'), lambda x: x <> ''))) AS t FROM documents WHERE text IS NOT NULL),
    s AS (SELECT t, min(id) AS class, count(*) AS copies, len(t) AS n FROM t WHERE len(t) > 0 GROUP BY t),
    q AS (SELECT x.class AS a, y.class AS b, x.n AS na, y.n AS nb, x.copies AS ca, y.copies AS cb, len(list_intersect(x.t, y.t)) AS o FROM s x JOIN s y ON x.class < y.class AND y.n * 100 >= x.n * 90 AND x.n * 100 >= y.n * 90),
    p AS (SELECT *, o / (na + nb - o) AS sim FROM q WHERE o * 100 >= 90 * (na + nb - o))"""


def leak_free_train(spark, sf_dir):
    train = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    test = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    return similarity.without_leaks(train, test, [F.col("text")]).select("id")


def greedy_dedup(spark, sf_dir):
    return similarity.greedy_dedup(functions(spark, sf_dir), list(pipelines.FIELDS))


def callee_context(spark, sf_dir):
    return graph.callee_context(functions(spark, sf_dir)).select("id", F.length("context").alias("n"), F.md5("context").alias("digest"))


def closure_depth2(spark, sf_dir):
    f = functions(spark, sf_dir)
    return graph.closure(f, f.where("repo = 'src3'"), 2)


def closure_full(spark, sf_dir):
    f = functions(spark, sf_dir)
    return graph.closure(f, f.where("repo = 'src3' AND name LIKE '%fr'")).select("id")


def prune_to(spark, sf_dir):
    f = functions(spark, sf_dir)
    return graph.prune_to(f, f.where("repo <> 'src0'")).select("id", F.array_join("to", ",").alias("to_ids"))


def referentially_closed(spark, sf_dir):
    f = functions(spark, sf_dir)
    return graph.referentially_closed(f, f.where("repo <> 'src0'")).select("id")


def schedule(spark, sf_dir):
    return graph.level_batches(graph.schedule(functions(spark, sf_dir)), 4).select("id", "height", "visit", "batch")


def verbosity(spark, sf_dir):
    return functions(spark, sf_dir).select("id", F.round(M.verbosity(F.col("doc")), 6).alias("verbosity"))


def triviality(spark, sf_dir):
    return functions(spark, sf_dir).select("id", F.round(M.triviality(F.col("doc"), F.col("name"), F.col("code")), 6).alias("triviality"))


def partial_ratio(spark, sf_dir):
    p = _table(spark, sf_dir, "conversations")
    return p.select("conv_id", "turn", M.partial_ratio(F.lower("role"), F.lower("text")).alias("ratio"))


def obfuscated(spark, sf_dir):
    f = functions(spark, sf_dir).withColumn("context", F.concat(F.lit("main: "), X.last_part("name", ":")))
    return obfuscate.obfuscate(f, f).select("id", F.md5("code").alias("code_digest"), "context")


def win_rate(spark, sf_dir):
    v = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "A").when(F.col("quality") == 0, "B").otherwise("tie")
    return relational.win_rate(_table(spark, sf_dir, "labels").select(relational.verdict(v).alias("verdict"))).select("wins", "losses", F.round("score", 6).alias("score"))


def score_register(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels"), "doc_id").groupBy("lang", "source").agg(F.sum("quality").alias("passed"), F.count("quality").alias("total"))
    return relational.score_register(d.where("total > 0").select(F.col("lang").alias("test"), "passed", "total"))


def metrics_merge(spark, sf_dir):
    labels, docs = _table(spark, sf_dir, "labels"), _table(spark, sf_dir, "documents")
    automatic = docs.join(labels.select("doc_id"), "doc_id", "left_semi").select("doc_id", F.col("n_chars").alias("quality"), "lang")
    return relational.merge_metrics(labels, automatic, "doc_id").select("doc_id", "toxic", "quality", "lang")


def prompt_render(spark, sf_dir):
    c = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("doc"), F.col("role").alias("code"), F.lit("{doc}").alias("context"))
    return c.select("conv_id", "turn", generate.context_prompt("{lever}{num_doc_words}: {context} {code} {doc}", False).alias("prompt"))


def predict_short(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("name"), F.col("text").alias("whole_text"), F.lit(20).alias("prompt_len"))
    marks = _table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("id")).join(d.select("id", "name"), "id")
    return relational.prediction(relational.keep_benchmark(d, marks)).select("id", "prompt", "generated_summary")


def variables(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", F.array_join(F.array_sort(X.variables("html")), ",").alias("names"))


def enclosed(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", X.enclosed("html", "(", ")", 1).alias("ok"))


def comments_removed(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", F.md5(X.remove_comments("html")).alias("digest"))


def substring_copy(spark, sf_dir):
    c = _table(spark, sf_dir, "conversations")
    a, b = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("doc")), c.where("role <> 'user'").select("conv_id", F.col("turn").alias("other"), F.col("text").alias("ref"))
    return a.join(b, "conv_id").select("conv_id", "turn", "other", X.shares_substring("doc", "ref", 35).alias("copied"))


def dict_to_array(spark, sf_dir):
    c = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("l"))
    return c.select("conv_id", F.array_join(F.transform("l", lambda x: x["role"]), "|").alias("roles"))


def generated_flat(spark, sf_dir):
    out = generate.generate(functions(spark, sf_dir), generate.context_prompt(TEMPLATE, True), generate.EchoGenerator())
    return relational.prediction(out).select("id", "prompt_len", "generated_summary")


def find_duplicates(spark, sf_dir):
    return pipelines.find_duplicates(functions(spark, sf_dir)).select("field", "id", "class", "links")


def rows_as_array(spark, sf_dir):
    return tables.as_array(functions(spark, sf_dir), "test").select("split", "id", "ord")


def one_order(spark, sf_dir):
    o = _table(spark, sf_dir, "orders")
    rows = o.select("o_orderkey", F.col("o_orderpriority").alias("repo"), F.col("o_custkey").alias("ord"))
    return relational.in_one_order(rows).select("o_orderkey", "ord")


def claim_scores(spark, sf_dir):
    says = lambda k: F.when(F.col("turn") % k == 0, "Yes, it does").otherwise("No")
    claims = F.array(F.lit("it sorts"), F.lit("it frees"), F.lit("it locks"))
    c = _table(spark, sf_dir, "conversations").select("conv_id", "turn", claims.alias("claims"), F.concat_ws("\n", says(2), says(3), "role").alias("response"))
    answers = X.answers_by_question(judging.questions_of("claims", "Does it say that"), "response")
    return c.select("conv_id", "turn", F.round(relational.pass_score(answers, F.col("claims")), 6).alias("score"))


def paired_summaries(spark, sf_dir):
    f = functions(spark, sf_dir).withColumn("generated_summary", F.concat("name", F.lit("."), "ord"))
    again = f.withColumn("generated_summary", F.md5("doc"))
    return relational.side_by_side(f, again).select("id", "left_doc", "right_doc")


QUERIES = {
    f.__name__: f
    for f in (
        filter_first_fail, filter_histogram, clean_text, no_four_repeat, split_route, repo_info_join, exact_groups, similarity_links, similarity_pairs, similarity_statistics, neighbour_lists, similarity_histogram, similarity_row_histogram, leak_free_train, greedy_dedup, callee_context,
        closure_depth2, closure_full, prune_to, referentially_closed, schedule, verbosity, triviality, partial_ratio, obfuscated, win_rate, score_register, metrics_merge, prompt_render, predict_short, variables, enclosed, comments_removed, substring_copy,
        dict_to_array, generated_flat, find_duplicates, rows_as_array, one_order, claim_scores, paired_summaries,
    )
}

ORACLE_SQL = {
    "filter_first_fail": f"WITH {_FUNCTIONS}, {_FAIL} SELECT id, fail_idx FROM r",
    "filter_histogram": f"WITH {_FUNCTIONS}, {_FAIL} SELECT CAST(i AS INTEGER) AS fail_idx, count(r.id) AS n FROM range(-1, 18) t(i) LEFT JOIN r ON r.fail_idx = i GROUP BY i",
    "clean_text": r"""WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS id, regexp_replace(text, '^[/\\:*\s]*|[/\\:*\s]*$', '', 'g') AS t FROM documents)
        SELECT id, CASE WHEN contains(t, '    ') OR contains(t, chr(10) || chr(10) || chr(10) || chr(10)) THEN t
          ELSE regexp_replace(regexp_replace(regexp_replace(t, ' +', ' ', 'g'), ',+', ',', 'g'), '\n+', chr(10), 'g') END AS doc FROM d""",
    "no_four_repeat": """WITH c AS (SELECT doc_id, string_split(text, '') AS ch FROM documents)
        SELECT CAST(doc_id AS VARCHAR) AS id FROM c WHERE len(list_filter(range(1, len(ch) - 2), lambda i: ch[i] = ch[i+1] AND ch[i] = ch[i+2] AND ch[i] = ch[i+3])) = 0""",
    "split_route": f"""WITH {_FUNCTIONS}, r AS (SELECT id, CASE WHEN repo = 'src1' THEN 'test' WHEN contains(path, '/es/') THEN 'test' WHEN repo IN ('src0', 'src2', 'src3', 'src4') THEN 'train' END AS split FROM f)
        SELECT id, split FROM r WHERE split IS NOT NULL""",
    "repo_info_join": "SELECT s_suppkey, n_name AS repo FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey IN (1, 2)",
    "exact_groups": r"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-zA-Z0-9]+'), lambda x: x <> '') AS t FROM documents WHERE text IS NOT NULL),
        g AS (SELECT t, min(doc_id) AS rep, count(*) AS copies FROM t WHERE len(t) > 0 GROUP BY t)
        SELECT CAST(doc_id AS VARCHAR) AS id, CAST(rep AS VARCHAR) AS rep, copies FROM t JOIN g ON t.t = g.t""",
    "similarity_links": f"""WITH {_SETS}, l AS (SELECT class, sum(c) AS near FROM (SELECT a AS class, cb AS c FROM p UNION ALL SELECT b, ca FROM p) GROUP BY class)
        SELECT t.id, s.class, CAST(s.copies - 1 + coalesce(near, 0) AS BIGINT) AS links FROM t JOIN s ON t.t = s.t LEFT JOIN l ON l.class = s.class""",
    "similarity_pairs": f"WITH {_SETS} SELECT a, b, round(sim, 6) AS sim FROM p",
    "similarity_statistics": f"""WITH {_SETS}, w AS (SELECT class FROM s WHERE copies > 1 UNION SELECT a FROM p UNION SELECT b FROM p)
        SELECT CAST((SELECT coalesce(sum(copies * (copies - 1) // 2), 0) FROM s) + (SELECT coalesce(sum(ca * cb), 0) FROM p) AS BIGINT) AS pairs, CAST((SELECT coalesce(sum(copies * (copies - 1) // 2), 0) FROM s) AS BIGINT) AS "equal",
          CAST((SELECT coalesce(sum(copies), 0) FROM s JOIN w USING (class)) AS BIGINT) AS with_neighbour, CAST((SELECT coalesce(sum(copies), 0) FROM s) AS BIGINT) AS items""",
    "neighbour_lists": f"WITH {_SETS}, l AS (SELECT a AS class, b AS o2 FROM p UNION ALL SELECT b, a FROM p) SELECT class, string_agg(CAST(o2 AS VARCHAR), ',' ORDER BY o2) AS others FROM l GROUP BY class",
    "similarity_histogram": f"""WITH {_SETS}, v AS (SELECT o * 100 / (na + nb - o) AS v FROM p), m AS (SELECT min(v) AS lo, max(v) AS hi FROM v),
        c AS (SELECT CASE WHEN hi = lo THEN 5 ELSE least(9, CAST(floor((v - lo) / ((hi - lo) / 10)) AS INTEGER)) END AS bin FROM v, m),
        n AS (SELECT CAST(i AS INTEGER) AS bin, count(c.bin) AS n FROM range(0, 10) r(i) LEFT JOIN c ON c.bin = i GROUP BY i)
        SELECT bin, n, CAST(floor(n * 40 / (SELECT max(n) FROM n)) AS INTEGER) AS bar FROM n WHERE (SELECT count(*) FROM v) > 0""",
    "similarity_row_histogram": f"""WITH {_SETS}, v AS (SELECT o * 100 / (na + nb - o) AS v, ca * cb AS w FROM p UNION ALL SELECT 100, copies * (copies - 1) // 2 FROM s WHERE copies > 1), m AS (SELECT min(v) AS lo, max(v) AS hi FROM v),
        c AS (SELECT CASE WHEN hi = lo THEN 5 ELSE least(9, CAST(floor((v - lo) / ((hi - lo) / 10)) AS INTEGER)) END AS bin, w FROM v, m),
        n AS (SELECT CAST(i AS INTEGER) AS bin, CAST(coalesce(sum(c.w), 0) AS BIGINT) AS n FROM range(0, 10) r(i) LEFT JOIN c ON c.bin = i GROUP BY i)
        SELECT bin, n, CAST(floor(n * 40 / (SELECT max(n) FROM n)) AS INTEGER) AS bar FROM n WHERE (SELECT count(*) FROM v) > 0""",
    "leak_free_train": r"""WITH x AS (SELECT doc_id AS id, 1 AS k, text FROM documents UNION ALL SELECT item_id, 0, text FROM benchmark),
        t AS (SELECT id, k, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-zA-Z0-9]+'), lambda x: x <> '')) AS t FROM x),
        leak AS (SELECT DISTINCT a.id FROM t a JOIN t b ON a.k = 1 AND b.k = 0 AND len(a.t) > 0 AND len(b.t) > 0 AND len(list_intersect(a.t, b.t)) * 100 >= 90 * (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))))
        SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT id FROM leak)""",
    "callee_context": f"""WITH {_FUNCTIONS}, {_EDGES}, c AS (SELECT e.src, string_agg(string_split(g.name, '::')[-1] || ': ' || coalesce(g.doc, ''), chr(10) || '*' || chr(10) ORDER BY e.pos) AS context FROM e JOIN f g ON e.dst = g.id WHERE e.src <> e.dst GROUP BY e.src)
        SELECT f.id, CAST(length(coalesce(context, '')) AS INTEGER) AS n, md5(coalesce(context, '')) AS digest FROM f LEFT JOIN c ON f.id = c.src""",
    "closure_depth2": f"""WITH {_FUNCTIONS}, {_EDGES}, a AS (SELECT id, 0 AS d FROM f WHERE repo = 'src3'), b AS (SELECT dst AS id, 1 AS d FROM e JOIN a ON e.src = a.id), c AS (SELECT dst AS id, 2 AS d FROM e JOIN b ON e.src = b.id)
        SELECT id, CAST(min(d) AS INTEGER) AS distance FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) GROUP BY id""",
    "closure_full": f"""WITH RECURSIVE {_FUNCTIONS}, {_EDGES}, r AS (SELECT id FROM f WHERE repo = 'src3' AND name LIKE '%fr' UNION SELECT e.dst FROM e JOIN r ON e.src = r.id) SELECT id FROM r""",
    "prune_to": f"""WITH {_FUNCTIONS}, {_EDGES}, p AS (SELECT e.src, string_agg(e.dst, ',' ORDER BY pos) AS l FROM e JOIN f g ON e.dst = g.id AND g.repo <> 'src0' GROUP BY e.src)
        SELECT f.id, coalesce(l, '') AS to_ids FROM f LEFT JOIN p ON f.id = p.src""",
    "referentially_closed": f"WITH {_FUNCTIONS}, {_EDGES} SELECT id FROM f WHERE id NOT IN (SELECT e.src FROM e WHERE e.dst NOT IN (SELECT id FROM f WHERE repo <> 'src0'))",
    "verbosity": r"""WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS id, text, length(text) AS n FROM documents),
        w AS (SELECT id, n, CASE WHEN n <= 550 THEN [list_filter(list_transform(range(1, greatest(1, n - k + 1)), lambda i: substr(text, i, k)), lambda s: len(list_filter(regexp_split_to_array(s, '\s+'), lambda x: x <> '')) > 3) FOR k IN [30, 50]] END AS s FROM d)
        SELECT id, round(CASE WHEN n > 550 THEN 1.0 ELSE least(1.0, CASE WHEN n > 250 AND n < 550 THEN (n - 250) / 300 ELSE 0 END + CASE WHEN len(s[2]) > len(list_distinct(s[2])) THEN 1.0 WHEN len(s[1]) > len(list_distinct(s[1])) THEN 0.4 ELSE 0 END) END::DOUBLE, 6) AS verbosity FROM w""",
    "win_rate": """WITH v AS (SELECT count(*) FILTER (quality = 1 AND toxic = 0) AS wins, count(*) FILTER (quality = 0) AS losses FROM labels)
        SELECT wins, losses, round(((1 - CASE WHEN wins + losses = 0 THEN 0.5 ELSE wins / (wins + losses) END) - 0.5) * 2, 6)::DOUBLE AS score FROM v""",
    "score_register": """WITH g AS (SELECT lang, source, sum(quality) AS p, count(quality) AS t FROM documents JOIN labels USING (doc_id) GROUP BY ALL HAVING count(quality) > 0)
        SELECT lang AS test, min(round_even(p / t * 10000, 0) / 10000) AS low, max(round_even(p / t * 10000, 0) / 10000) AS high, round_even(sum(p) / sum(t) * 10000, 0) / 10000 AS pooled FROM g GROUP BY lang""",
    "metrics_merge": "SELECT l.doc_id, l.toxic, d.n_chars AS quality, d.lang FROM labels l JOIN documents d USING (doc_id)",
    "prompt_render": r"""SELECT conv_id, turn, trim(CAST(len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS VARCHAR) || ': {doc} ' || role || ' ' || text, ' ' || chr(9) || chr(10) || chr(13)) AS prompt FROM conversations""",
    "predict_short": "SELECT CAST(doc_id AS VARCHAR) AS id, substr(text, 1, 20) AS prompt, substr(text, 21) AS generated_summary FROM documents WHERE doc_id IN (SELECT item_id FROM benchmark)",
    "variables": r"""WITH w AS (SELECT page_id, list_sort(list_distinct(list_filter(regexp_split_to_array(html, '[\s*(),;&\[\]\-!=><''`"%:/.]+'), lambda x: contains(x, '_') AND x <> '_' AND NOT regexp_matches(x, '\p{Lu}|^\p{Nd}')))) AS l FROM pages)
        SELECT page_id, array_to_string(l, ',') AS names FROM w""",
    "find_duplicates": rf"""WITH {_FUNCTIONS}, x AS (SELECT 'doc' AS field, id, doc AS v FROM f WHERE NOT vendor UNION ALL SELECT 'code', id, code FROM f WHERE NOT vendor UNION ALL SELECT 'doc+code', id, doc || chr(10) || code FROM f WHERE NOT vendor AND doc <> ''),
        t AS (SELECT field, id, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(v), '[^a-zA-Z0-9]+'), lambda x: x <> ''))) AS t FROM x WHERE v IS NOT NULL),
        s AS (SELECT field, t, min(id) AS class, count(*) AS copies, len(t) AS n FROM t WHERE len(t) > 0 GROUP BY field, t),
        p AS (SELECT x.field, x.class AS a, y.copies AS c FROM s x JOIN s y ON x.field = y.field AND x.class <> y.class AND y.n * 100 >= x.n * 90 AND x.n * 100 >= y.n * 90 AND len(list_intersect(x.t, y.t)) * 100 >= 90 * (x.n + y.n - len(list_intersect(x.t, y.t)))),
        l AS (SELECT field, a, sum(c) AS near FROM p GROUP BY field, a)
        SELECT t.field, t.id, s.class, CAST(s.copies - 1 + coalesce(near, 0) AS BIGINT) AS links FROM t JOIN s ON t.field = s.field AND t.t = s.t LEFT JOIN l ON l.field = s.field AND l.a = s.class""",
    "rows_as_array": "SELECT 'test' AS split, CAST(doc_id AS VARCHAR) AS id, doc_id AS ord FROM documents",
    "one_order": """WITH r AS (SELECT o_orderpriority AS p, max(o_custkey) + 1 AS span FROM orders GROUP BY ALL), b AS (SELECT p, coalesce(sum(span) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r)
        SELECT o_orderkey, CAST(o_custkey + before AS BIGINT) AS ord FROM orders JOIN b ON o_orderpriority = p""",
    "claim_scores": "SELECT conv_id, turn, round((CASE WHEN turn % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN turn % 3 = 0 THEN 1 ELSE 0 END) / 3, 6) AS score FROM conversations",
    "paired_summaries": f"WITH {_FUNCTIONS} SELECT id, name || '.' || ord AS left_doc, md5(doc) AS right_doc FROM f ORDER BY ord, id LIMIT 1000",
    "dict_to_array": "SELECT conv_id, string_agg(role, '|' ORDER BY turn, role) AS roles FROM conversations GROUP BY conv_id",
}

QUERIES |= more_queries.queries(_table, functions)
ORACLE_SQL |= more_queries.oracle_sql(_FUNCTIONS, _EDGES)
