"""Top-k search and archives against brute force; the pipeline's stages."""

import gzip
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan

import corpus_pipeline
from loomstone.llm import cover_tree, packing, warc


@pytest.mark.parametrize("seed", range(20))
def test_dual_trees(seed, monkeypatch):
    rng = np.random.default_rng(seed)
    monkeypatch.setattr(cover_tree, "LEAF", int(rng.integers(1, 20)))
    monkeypatch.setattr(cover_tree, "STRIP", int(rng.integers(1, 50)))
    n, m, d = rng.integers(1, 300), rng.integers(1, 40), rng.integers(1, 4)
    x, place = np.unique(rng.integers(-3, 4, (n, d)) + rng.integers(0, 3, (n, 1)) * 50.0, axis=0, return_inverse=True)
    place = place.reshape(-1)
    q, own = rng.integers(-3, 4, (m, d)).astype(float), rng.integers(0, n + 5, m)
    best = cover_tree.dual_search(q, own, x, [np.flatnonzero(place == j)[:6] for j in range(len(x))], 5)
    for j in range(m):
        want = sorted((-float(q[j] @ x[place[i]]), i) for i in range(n) if i != own[j])[:5]
        assert [(-s, i) for s, i in zip(best.score[j], best.id[j], strict=True) if s > cover_tree.NONE] == want


def clusters(rng, n, centres, spread, d=64):
    at = rng.normal(0, 2000, (centres, d))
    return np.unique(np.floor(at[rng.integers(0, centres, n)] + rng.normal(0, spread, (n, d))), axis=0)


def test_node_pairs_are_pruned_in_64_dimensions():
    rng = np.random.default_rng(3)
    x = clusters(rng, 4000, 40, 20)
    q = x[::50]
    best = cover_tree.dual_search(q, np.arange(0, len(x), 50), x, [np.array([j]) for j in range(len(x))], 5)
    assert best.dropped > 0 and best.compared < 0.2 * len(q) * len(x)
    for j, i in enumerate(range(0, len(x), 50)):
        want = sorted((-int(s), k) for k, s in enumerate(x @ q[j]) if k != i)[:5]
        assert [(-s, k) for s, k in zip(best.score[j].tolist(), best.id[j].tolist(), strict=True)] == want


@pytest.mark.parametrize("spread", [0, 1, 1000])
def test_trees_are_cover_trees(spread):
    """Children cover their parent's points within half its radius, are centred on points of their own and lie further apart than that."""
    x = clusters(np.random.default_rng(spread), 900, 9, spread, 16)
    t = cover_tree.cover_tree(x)
    for k, kids in enumerate(t.kids):
        assert np.sqrt(((x[t.rows[k]] - t.centre[k]) ** 2).sum(1)).max() <= t.radius[k]
        if not len(kids):
            assert len(t.rows[k]) <= cover_tree.LEAF or t.radius[k] == 0
            continue
        assert sorted(np.concatenate([t.rows[c] for c in kids]).tolist()) == t.rows[k].tolist()
        assert (t.radius[kids] <= t.radius[k] / 2 * (1 + 1e-6)).all()
        apart = np.sqrt(((t.centre[kids][:, None] - t.centre[kids][None]) ** 2).sum(2)) + np.eye(len(kids)) * 1e9
        assert (apart > t.radius[k] / 2 * (1 - 1e-6)).all()


@pytest.mark.parametrize("largest", [50_000.0, 2.0**45, 2.0**58])
def test_scores_beyond_floating_point_are_exact(spark, largest):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.uniform(-1, 1, 6) * (largest if i % 3 == 0 else 1.0)]) for i in range(0, 200, 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows}
    whole = {i: [min(max(x, -(2**63)), 2**63 - 1) for x in v] for i, v in whole.items()}
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in cover_tree.top_k(df, data_block=10, query_block=2).collect())
    want = []
    for q in (i for i in whole if i % 50 == 0):
        exact = {i: min(max(sum(a * b for a, b in zip(whole[q], v, strict=True)), -(2**63) + 1), 2**63 - 1) for i, v in whole.items() if i != q}
        want += [(q, k, i, exact[i]) for k, i in enumerate(sorted(exact, key=lambda i: (-exact[i], i))[:5], 1)]
    assert got == want


def test_an_id_with_many_vectors_hides_no_other(spark):
    rows = [(7, [1.0, 0.001 * k]) for k in range(60)] + [(k, [0.5, 0.1 * k]) for k in (100, 101, 102, 103, 104, 105)] + [(9, [0.3, 0.3])] * 40
    got = cover_tree.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), is_query=F.col("vec_id").isin(7, 105), data_block=16).collect()
    for q in (7, 105):
        own = [r for r in got if r["query_id"] == q]
        assert sorted(r["rank"] for r in own) == [1, 2, 3, 4, 5] and len({r["vec_id"] for r in own}) == 5
        dot = {}
        for i, v in rows:
            dot[i] = max([dot.get(i, -(10**18))] + [sum(int(np.floor(256 * a)) * int(np.floor(256 * b)) for a, b in zip(u, v, strict=True)) for j, u in rows if j == q])
        assert [r["vec_id"] for r in sorted(own, key=lambda r: r["rank"])] == sorted((i for i in dot if i != q), key=lambda i: (-dot[i], i))[:5]


def test_pivots_spare_blocks(spark):
    """On clustered vectors bounds between blocks keep most of them from most queries, and the result is that of all pairs."""
    x = clusters(np.random.default_rng(5), 3000, 30, 5, 8) / 256
    df = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in cover_tree.top_k(df, data_block=50, query_block=10).collect())
    y = np.floor(256 * x)
    want = [(q, k, i, -s) for q in range(0, len(x), 50) for k, (s, i) in enumerate(sorted((-int(s), i) for i, s in enumerate(y @ y[q]) if i != q)[:5], 1)]
    assert got == want


def test_search_of_a_table(spark):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(5)]) for i in range(120)] + [(200 + i, [0.5] * 5) for i in range(30)]
    odd = [(50, None), (150, [float("nan")] * 5), (300, [None] * 5), (350, [float("inf")] * 5), (None, [1.0] * 5), (100, rows[100][1]), (400, [])]
    rows = [r for r in rows if r[0] != 50] + odd
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("ask", F.lit(1))
    got = {}
    for r in cover_tree.top_k(df, data_block=40, query_block=2).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    sound = {i: np.floor(256 * np.float32(v).astype(float)).astype(int) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    dot = lambda a, b: int(sum(x * y for x, y in zip(a, b, strict=False)))
    for q in (i for i in sound if i % 50 == 0):
        want = sorted((-dot(sound[q], v), i) for i, v in sound.items() if i != q)[:5]
        assert sorted(got.pop(q)) == [(k, i, -s) for k, (s, i) in enumerate(want, 1)]
    assert not got
    assert cover_tree.top_k(df.where("false")).count() == 0


def pages_of(spark):
    big = "<p>é" + "x" * 200 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"
    rows = [(3, "u3", big), (1, "u1\r\nX: y", big), (2, None, big), (5, "u", "tiny"), (4, "u", "tiny"), (6, "u", None), (7, "u", ""), (None, "u", big), (9, "u", "y" * 200_000)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_archives_round_trip(spark, compression):
    p = pages_of(spark).withColumn("payload", F.encode(F.coalesce("html", F.lit("")), "UTF-8"))
    p = warc.revisits(p.withColumn("digest", F.sha2("payload", 256)))
    records = p.select(F.coalesce(F.col("page_id").cast("string"), F.lit("none")).alias("record_id"), "record_type", F.col("url").alias("target_uri"), F.lit("2024-01-01T00:00:00Z").alias("date"), F.col("first_id").cast("string").alias("refers_to"), F.col("digest").alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_length"), "payload")
    folder = warc.write_archives(records, compression=compression)
    got = {r["record_id"]: r for r in warc.read_archives(spark, folder).collect()}
    assert len(got) == 9
    for r in p.collect():
        x = got["none" if r["page_id"] is None else str(r["page_id"])]
        assert x["record_type"] == r["record_type"] and x["payload_length"] == len(r["payload"])
        assert x["payload"] is None if x["record_type"] == "revisit" else hashlib.sha256(bytes(x["payload"])).hexdigest() == r["digest"]
    assert {k for k, r in got.items() if r["record_type"] == "revisit"} == {"2", "3", "none"} and got["3"]["refers_to"] == "1"
    assert got["1"]["target_uri"] == "u1  X: y"
    few = warc.read_archives(spark, folder, payload=False).where("record_type = 'response' AND target_uri LIKE 'u%'")
    assert {r["record_id"] for r in few.collect()} == {"1", "5", "4", "6", "7", "9"}
    assert all(r["payload"] is None for r in few.collect())
    assert warc.read_archives(spark, warc.write_archives(records.where("false"))).count() == 0


def test_headers_decide_before_payloads():
    reader = warc.WarcReader({"path": "/nowhere"})

    left = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), GreaterThan(("payload_length",), 3)]))
    assert len(left) == 1 and not reader.wanted({"record_type": "response"}) and reader.wanted({"record_type": "revisit"})


def test_pipeline_stages_survive_odd_tables(spark, tmp_path):
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = [(1, None, "en", "s", 0), (2, "", None, None, None), (3, "plain words " * 30, "en", "s", 1), (3, "plain words " * 30, "en", "s", 1), (None, "no id here", "en", "s", 1), (5, "x y " * 9000, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 AS score", "2 AS kept", "3 AS offset", "4 AS gone")
    for table in (docs, docs.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, str(tmp_path))
            assert name and out.count() >= 0
            if stage is not corpus_pipeline.pack:
                assert out.columns == docs.columns


def test_a_stage_by_itself_bounds_what_its_workers_get(spark, tmp_path):
    """Called without the entry, as the stages may be, workers get 1,000 rows at a time, not 10,000, and no ids come back that nothing reads."""
    bounds = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"]
    before = {name: spark.conf.getAll.get(name) for name in bounds}
    docs = spark.range(2500).selectExpr("id AS doc_id", "'some words' AS text").coalesce(1)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    try:
        for stage in (corpus_pipeline.keep_good, corpus_pipeline.pack):
            for name in bounds:
                spark.conf.unset(name)
            out = stage(spark, docs, str(tmp_path))
            rows = docs.mapInArrow(lambda batches: (b.slice(0, 1) for b in batches), docs.schema).count()  # one row a batch
            assert rows == 3 and spark.conf.get(bounds[1]) == str(32 << 20)
        assert out.columns == ["doc_id", "piece", "start", "length", "sequence_id", "offset"] and out.count() == 2500
        bare = packing.tokenise(docs, public_tokenizers.path("byte_bpe_50k.json"), ids=False)
        assert bare.columns == ["doc_id", "piece", "start", "length"] and bare.first()[1:] == packing.tokenise(docs, public_tokenizers.path("byte_bpe_50k.json")).first()[1:4]
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def test_near_copies_leave_one(spark):
    text = " ".join(f"w{i}" for i in range(100))
    rows = [(4, text), (2, text.replace("w50", "other")), (9, "something else that is not near"), (None, text), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(str(r["doc_id"]) for r in corpus_pipeline.keep_one_of_near_copies(spark, docs, "").collect()) == ["2", "7", "9", "None"]


def test_revisits_at_every_size(spark):
    """Broadcast, merge join and hot digests agree; clashing columns are replaced; null ids, digests and payloads are defined."""
    rows = [(k, f"d{k % 7}", b"x" * 200) for k in range(60)] + [(100, "few", b"y"), (101, "few", b"y"), (None, "d0", b"x" * 200), (102, None, b"x" * 200), (103, None, b"x" * 200), (104, "d0", None), (None, "none", b"z" * 200), (None, "none", b"z" * 200)]
    pages = spark.createDataFrame(rows, "page_id long, digest string, payload binary").selectExpr("*", "1 AS first_id", "2 AS record_type", "3 AS copied_digest", "4 AS smallest_id", "5 AS digest_salt", "6 AS hot_digest", "7 AS n")
    want = None
    for bounds in ((1000, 1000), (0, 1000), (5, 9), (0, 1)):
        out = warc.revisits(pages, broadcast_rows=bounds[0], hot_rows=bounds[1])
        assert sorted(out.columns) == sorted(pages.columns)
        got = sorted((str(r["page_id"]), str(r["digest"]), r["record_type"], str(r["first_id"]), r["copied_digest"]) for r in out.collect())
        want = want or got
        assert got == want
    firsts = {(i, d): (t, f) for i, d, t, f, _ in want}
    assert firsts["7", "d0"] == ("revisit", "0") and firsts["0", "d0"] == ("response", "None") and firsts["None", "d0"] == ("revisit", "0")
    assert {firsts[k][0] for k in (("100", "few"), ("101", "few"), ("102", "None"), ("103", "None"), ("104", "d0"), ("None", "none"))} == {"response"}
    assert warc.revisits(pages.where("false")).count() == 0


def foreign(records):
    return [b"WARC/1.0\r\nWARC-Type: %s\r\nWARC-Record-ID: <%s>\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (kind, name, len(body), body) for kind, name, body in records]


@pytest.mark.parametrize("window", [7, 64, 1 << 16])
@pytest.mark.parametrize("kind", ["plain", "members", "one member"])
def test_archives_of_other_origin(spark, tmp_path, monkeypatch, window, kind):
    """Without offsets, plain or gzip in one or many members; unwanted blocks, however long, are passed over."""
    monkeypatch.setattr(warc, "_WINDOW", window)
    rng = random.Random(window)
    bodies = [(b"request" if k % 3 else b"response", b"r%d" % k, b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n" * (k % 2) + rng.randbytes(rng.choice((0, 1, 500, 70_000)))) for k in range(25)]
    parts = foreign(bodies)
    data = b"".join(parts) if kind == "plain" else b"".join(gzip.compress(p) for p in parts) if kind == "members" else gzip.compress(b"".join(parts))
    path = tmp_path / ("a.warc" if kind == "plain" else "a.warc.gz")
    path.write_bytes(data)
    for wanted in ({b"request", b"response"}, {b"response"}):
        reader = warc.WarcReader({"path": str(path)})
        if len(wanted) == 1:
            list(reader.pushFilters([EqualTo(("record_type",), "response")]))
        got = [(r[0].encode(), r[-1]) for p in reader.partitions() for r in reader.read(p)]
        assert got == [(n, b[25:] if b.startswith(b"HTTP") else b) for t, n, b in bodies if t in wanted]
    path.write_bytes(data[: len(data) * 2 // 3])
    reader = warc.WarcReader({"path": str(path)})
    with pytest.raises(ValueError, match="an archive ends"):
        list(reader.read(reader.partitions()[0]))


def test_unwanted_members_stay_compressed(spark, tmp_path, monkeypatch):
    rows = [(str(k), "response" if k % 4 else "metadata", b"x" * 300_000) for k in range(12)]
    df = spark.createDataFrame(rows, "record_id string, record_type string, payload binary").selectExpr("*", "NULL AS target_uri", "NULL AS date", "NULL AS refers_to", "NULL AS payload_digest", "CAST(300000 AS BIGINT) AS payload_length")
    folder = warc.write_archives(df.coalesce(1), str(tmp_path / "w"), "gzip")
    assert not list((tmp_path / "w").glob("*.tmp"))
    inflated = []
    monkeypatch.setattr(warc.Inflated, "more", (lambda real: lambda self, least: inflated.append(1) or real(self, least))(warc.Inflated.more))
    reader = warc.WarcReader({"path": folder})
    list(reader.pushFilters([EqualTo(("record_type",), "metadata")]))
    assert len([r for p in reader.partitions() for r in reader.read(p)]) == 3
    assert 0 < len(inflated) <= 3 * 8  # of the three wanted records only


def test_each_stage_gives_what_it_should(spark, tmp_path):
    """Junk, letterless texts and boilerplate go, clean documents stay, pieces lie gapless in sequences."""
    rng = random.Random(6)
    words = "river stone window garden paper under little walking summer bread early north music house people over again".split()
    prose = lambda n: ". ".join(" ".join(rng.choice(words) for _ in range(9)).capitalize() for _ in range(n)) + "."
    junk = lambda: " ".join(rng.choice(["$$$", "###", "x9x9", "BUY", "%%", "!!!1"]) for _ in range(60))
    line = "This line is on every site of the whole web, word for word."
    rows = [(k, prose(6) if k % 2 else junk(), "en", f"site{k % 7}", k % 2) for k in range(240)]
    rows += [(300 + k, prose(4) + "\n" + line, "en", f"site{k}", 1) for k in range(6)]
    docs = spark.createDataFrame([r[:4] for r in rows], "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    spark.createDataFrame([(r[0], r[4], 0) for r in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    good = {r[0] for r in rows if r[4]}
    assert {r["doc_id"] for r in corpus_pipeline.keep_good(spark, docs, str(tmp_path)).collect()} == good
    few = docs.where("doc_id % 2 = 1").unionByName(spark.createDataFrame([(900, "123 456 !!", "en", "s", 10), (901, None, None, None, 0)], docs.schema))
    assert {r["doc_id"] for r in corpus_pipeline.keep_known_language(spark, few, "").collect()} == {k for k in range(240) if k % 2} | {301, 303, 305}
    left = {r["doc_id"]: r for r in corpus_pipeline.drop_boilerplate(spark, docs, "").collect()}
    assert len(left) == len(rows) and line in left[300]["text"] and not any(line in left[k]["text"] for k in range(301, 306))
    assert all(r["n_chars"] == len(r["text"]) for r in left.values())
    places = {}
    for r in corpus_pipeline.pack(spark, docs, "").collect():
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 1024
