"""Queries of the smaller operators over the driver's tables, and their SQL; ``catalogue`` registers them with its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import filters, graph, relational


def queries(table, functions) -> dict:
    """By name. ``table`` reads a table of the driver's, ``functions`` makes the function rows."""

    def prefixed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
        return relational.prefix_ids(functions(spark, sf_dir), F.col("repo")).select("id", F.array_join("to", ",").alias("to_ids"))

    def last_of_each(spark: SparkSession, sf_dir: str) -> DataFrame:
        return relational.last_wins(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "props"), "user_id", "event_id")

    def named_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = table(spark, sf_dir, "customer")
        return relational.anchor_pairs(c.select(F.col("c_name").alias("name"), F.col("c_custkey").alias("id")), c.select(F.col("c_name").alias("name"), (-F.col("c_custkey")).alias("id")))

    def contained_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = table(spark, sf_dir, "supplier")
        tests = s.select(F.concat(F.lit("repo/"), "s_suppkey").alias("id"), F.col("s_name").alias("name"))
        return relational.contained_in(tests, s.select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name"), "s_nationkey"))

    def paid_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
        return relational.within_budget(table(spark, sf_dir, "region")).select("r_regionkey", "r_name")

    def model_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
        return relational.require_columns(functions(spark, sf_dir)).select("id", "name", F.length("code").alias("n"))

    def entity_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, "pages").select("page_id", X.leaks_entity("html", "url", F.lit(""), "html").alias("leaks"))

    def names_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
        f = functions(spark, sf_dir)
        short = X.last_part("name", ":")
        start = F.when(F.col("ord") % 3 == 0, F.concat(short, F.lit(" - "))).when(F.col("ord") % 3 == 1, F.concat(short, F.lit(" - "), short, F.lit(": "))).otherwise("")
        return f.select("id", F.md5(X.drop_name_prefix(F.concat(start, "doc"), "name")).alias("digest"))

    def signatures_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
        head = F.concat(F.lit("int "), "repo", F.lit("("), F.substring_index("name", "_", -1), F.lit(")"))
        return functions(spark, sf_dir).select("id", F.md5(X.cut_signature(F.concat(F.lit("Does "), head, F.lit(" twice: "), head, "doc"), "code")).alias("digest"))

    def parameter_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, "pages").select("page_id", F.md5(X.parameters("html")).alias("digest"))

    def context_with_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
        got = graph.callee_context(functions(spark, sf_dir), with_parameters=True, stripped=True)
        return got.select("id", F.length("context").alias("n"), F.md5("context").alias("digest"))

    def lines_trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
        return functions(spark, sf_dir).select("id", F.md5(X.trim_lines("doc")).alias("digest"))

    def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
        said = F.concat("text", F.lit(" Yes"), F.when(F.col("turn") % 2 == 0, " No, Yes").otherwise(" none"))
        return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(X.yes_no(said), ",").alias("said"))

    def _first_fail(chain: filters.FilterChain):
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            f = functions(spark, sf_dir).withColumn("synth_doc", F.col("doc"))
            return f.select("id", chain.first_fail().cast("int").alias("fail_idx"))

        return query

    plain = (prefixed_ids, last_of_each, named_pairs, contained_predictions, paid_rows, model_columns, entity_leaks, names_dropped, signatures_cut, parameter_lists, context_with_parameters, lines_trimmed, answers)
    return {q.__name__: q for q in plain} | {
        "shared_first_fail": _first_fail(filters.SHARED),
        "pre_synthesis_first_fail": _first_fail(filters.pre_synthesis(use_doc=True, use_context=True)),
        "strict_target_first_fail": _first_fail(filters.STRICT_TARGET),
        "history_target_first_fail": _first_fail(filters.history_target()),
    }


def oracle_sql(with_functions: str, with_edges: str) -> dict[str, str]:
    def nesting(source: str, key: str, text: str, left: str, right: str, name: str) -> str:
        """A CTE ``name`` of ``key, ok``: brackets balance, never close too early and nest at least once."""
        return rf"""{name}_b AS (SELECT {key} AS k, regexp_replace({text}, '[^\{left}\{right}]', '', 'g') AS b FROM {source}),
            {name}_u AS (SELECT k, unnest(range(1, length(b) + 1)) AS i, b FROM {name}_b),
            {name}_s AS (SELECT k, i, sum(CASE WHEN substr(b, i, 1) = '{left}' THEN 1 ELSE -1 END) OVER (PARTITION BY k ORDER BY i) AS s FROM {name}_u),
            {name} AS (SELECT k, min(s) >= 0 AND max(s) >= 1 AND arg_max(s, i) = 0 AS ok FROM {name}_s GROUP BY k)"""

    braces, parens = nesting("f", "id", "code", "{", "}", "braces"), nesting("f", "id", "code", "(", ")", "parens")
    valid = "(macro OR coalesce(braces.ok, false)) AND coalesce(parens.ok, false)"
    body = r"(macro OR NOT regexp_matches(code, '^[^{]*\{\s*\}'))"
    joined = "f LEFT JOIN braces ON f.id = braces.k LEFT JOIN parens ON f.id = parens.k"
    flags = "WHEN system THEN 0 WHEN macro THEN 1 WHEN macro_exp THEN 2 WHEN vendor THEN 3 WHEN decl THEN 4"
    strip = lambda c: rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"
    four = "len(list_filter(range(1, length(doc) - 2), lambda i: ch[i] = ch[i+1] AND ch[i] = ch[i+2] AND ch[i] = ch[i+3])) > 0"
    return {
        "prefixed_ids": """SELECT source || '/' || doc_id AS id, source || '/' || ((3 * doc_id + 1) % n) || ',' || source || '/' || ((7 * doc_id + 2) % n) AS to_ids FROM documents, (SELECT count(*) AS n FROM documents)""",
        "last_of_each": "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(props, event_id) AS props FROM events GROUP BY user_id",
        "named_pairs": "SELECT c_name AS name, c_custkey AS anchor_id, -c_custkey AS base_id FROM customer",
        "contained_predictions": "SELECT 'repo/' || s_suppkey AS id, s_name AS name, s_nationkey FROM supplier",
        "paid_rows": "SELECT r_regionkey, r_name FROM region",
        "model_columns": f"WITH {with_functions} SELECT id, name, CAST(length(code) AS INTEGER) AS n FROM f",
        "entity_leaks": r"""WITH w AS (SELECT page_id, html, lower(url) AS seen, list_filter(regexp_split_to_array(regexp_replace(html, '[^\p{L}\p{M}\p{Nd}\p{Pc}]', ' ', 'g'), '\s+'), lambda x: length(x) > 3) AS l FROM pages)
            SELECT page_id, len(list_filter(l, lambda x: (contains(x, '_') OR regexp_matches(substr(x, 2), '\p{Lu}')) AND NOT contains(seen, lower(x)))) > 0 AS leaks FROM w""",
        "names_dropped": f"""WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS id, doc_id % 3 AS k, source || '_' || lang AS s, text FROM documents)
            SELECT id, md5(CASE WHEN k = 2 THEN CASE WHEN starts_with(text, s || ' - ') OR starts_with(text, s || ': ') THEN NULL ELSE text END ELSE {strip("text")} END) AS digest FROM d""",
        "signatures_cut": f"""WITH {with_functions} SELECT id, md5('Does  twice: int ' || repo || '(' || lang || ')' || doc) AS digest FROM f""",
        "parameter_lists": "SELECT page_id, md5(coalesce(string_split(string_split(html, '(')[2], ')')[1], '')) AS digest FROM pages",
        "context_with_parameters": f"""WITH {with_functions}, {with_edges},
            c AS (SELECT e.src, string_agg({strip("g.repo || '_' || g.lang || '(' || g.lang || '): ' || " + strip("coalesce(g.doc, '')"))}, chr(10) || '*' || chr(10) ORDER BY e.pos) AS x FROM e JOIN f g ON e.dst = g.id WHERE e.src <> e.dst GROUP BY e.src),
            s AS (SELECT f.id, {strip("coalesce(x, '')")} AS context FROM f LEFT JOIN c ON f.id = c.src)
            SELECT id, CAST(length(context) AS INTEGER) AS n, md5(context) AS digest FROM s""",
        "lines_trimmed": r"""SELECT CAST(doc_id AS VARCHAR) AS id, md5(array_to_string(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^[/\\:*\s]*|[/\\:*\s]*$', '', 'g')), chr(10))) AS digest FROM documents""",
        "answers": "SELECT conv_id, turn, array_to_string(regexp_extract_all(text || ' Yes' || CASE WHEN turn % 2 = 0 THEN ' No, Yes' ELSE ' none' END, '(Yes|No)', 1), ',') AS said FROM conversations",
        "shared_first_fail": f"""WITH {with_functions}, {braces}, {parens} SELECT id, CAST(CASE WHEN NOT ({valid}) THEN 0 WHEN length(code) >= 5000 THEN 1 WHEN NOT {body} THEN 2 WHEN repo = 'src10' THEN 3 WHEN decl THEN 4 ELSE -1 END AS INTEGER) AS fail_idx FROM {joined}""",
        "pre_synthesis_first_fail": rf"""WITH {with_functions}, {braces}, {parens}, c AS (SELECT *, string_split(doc, '') AS ch FROM {joined})
            SELECT id, CAST(CASE WHEN length(code) <= 50 THEN 0 WHEN length(code) >= 4000 THEN 1 WHEN NOT ((macro OR coalesce(ok, false)) AND coalesce(ok_1, false)) THEN 2 WHEN NOT {body} THEN 3 WHEN repo = 'src10' THEN 5
              WHEN coalesce(length(doc) >= 800, true) THEN 6 WHEN {four} THEN 7 WHEN doc <> '' AND NOT regexp_matches(doc, '[\x20-\x7E\s]') THEN 8 WHEN length(doc) + length(code) >= 5000 THEN 10 ELSE -1 END AS INTEGER) AS fail_idx FROM c""",
        "strict_target_first_fail": f"WITH {with_functions} SELECT id, CAST(CASE {flags} WHEN coalesce(length(doc) + length(code) >= 5000, true) THEN 6 ELSE -1 END AS INTEGER) AS fail_idx FROM f",
        "history_target_first_fail": f"WITH {with_functions} SELECT id, CAST(CASE {flags} WHEN coalesce(length(doc) + length(code) >= 5000, true) THEN 6 WHEN length(doc) > 35 THEN 7 ELSE 9 END AS INTEGER) AS fail_idx FROM f",
        # rows in order; the list of those that stayed grows by a row that is similar to none of them in any field
        "greedy_dedup": rf"""WITH RECURSIVE {with_functions}, o AS (SELECT *, row_number() OVER (ORDER BY ord) AS rn FROM f),
            x AS (SELECT 'doc' AS field, rn, doc AS v FROM o WHERE regexp_matches(doc, '\S') UNION ALL SELECT 'code', rn, code FROM o WHERE regexp_matches(code, '\S') UNION ALL SELECT 'both', rn, doc || chr(10) || code FROM o WHERE regexp_matches(doc, '\S')),
            t AS (SELECT field, rn, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(v), '[^a-zA-Z0-9]+'), lambda x: x <> ''))) AS t FROM x),
            c AS (SELECT field, t, len(t) AS n, list(rn) AS l FROM t WHERE len(t) > 0 GROUP BY field, t),
            p AS (SELECT a.l AS l, b.l AS m FROM c a JOIN c b ON a.field = b.field AND b.n * 100 >= a.n * 90 AND a.n * 100 >= b.n * 90 AND (a.t = b.t OR len(list_intersect(a.t, b.t)) * 100 >= 90 * (a.n + b.n - len(list_intersect(a.t, b.t))))),
            e AS (SELECT v, unnest(m) AS u FROM (SELECT unnest(l) AS v, m FROM p)),
            n AS (SELECT rn AS v, coalesce(list(DISTINCT u) FILTER (u < rn), []) AS before FROM o LEFT JOIN e ON e.v = rn GROUP BY rn),
            r AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS stay UNION ALL SELECT i + 1, CASE WHEN list_has_any(before, stay) THEN stay ELSE list_append(stay, v) END FROM r JOIN n ON v = i + 1)
            SELECT id, list_contains((SELECT stay FROM r ORDER BY i DESC LIMIT 1), rn) AS kept FROM o""",
        "enclosed": f"""WITH {nesting("pages", "page_id", "html", "(", ")", "p")} SELECT page_id, coalesce(p.ok, false) AS ok FROM pages LEFT JOIN p ON page_id = p.k""",
        "comments_removed": r"""SELECT page_id, md5(regexp_replace(html, '/\*[\s\S]*\*/|//.*|"+[\s\S]*"+|''+[\s\S]*''+|`+[\s\S]*`+', '', 'g')) AS digest FROM pages""",
        "substring_copy": """WITH a AS (SELECT conv_id, turn, text AS doc FROM conversations WHERE role = 'user'), b AS (SELECT conv_id, turn AS other, text AS ref FROM conversations WHERE role <> 'user')
            SELECT conv_id, turn, other, CASE WHEN length(doc) < 35 OR length(ref) < 35 THEN false ELSE len(list_filter(range(1, length(doc) - 34), lambda i: contains(substr(ref, 1, length(ref) - 1), substr(doc, i, 35)))) > 0 END AS copied FROM a JOIN b USING (conv_id)""",
    }
