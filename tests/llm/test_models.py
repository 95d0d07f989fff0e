"""Language, quality and toxicity: held-out accuracy on the driver's documents, and edge cases."""

import itertools
import random
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstone.llm import langid, quality, queries, shared, toxicity

DATA = "/root/testdata/sf0.01"
there = pytest.mark.skipif(not Path(DATA).exists(), reason="the driver's tables are not here")
EDGES = [(1, None), (2, ""), (3, "12 34 !!"), (4, "x" * 20_000), (None, "plain words of a text"), (5, "same"), (5, "same")]


def edge_docs(spark):
    return spark.createDataFrame(EDGES, "doc_id long, text string").selectExpr("*", "'en' AS lang", "'a' AS score", "2 AS predicted", "'c' AS first", "'d' AS evidence")


def model_of(texts):
    counts = {k: sum(langid.ngram_counts(t) for t in v) for k, v in texts.items()}
    return langid.Languages.from_counts(sorted(counts), np.array([counts[k] for k in sorted(counts)], float))


def test_mixtures_are_found():
    a, b = "the quick brown fox jumps over the lazy dog and runs away from it", "der schnelle braune fuchs springt über den faulen hund und läuft weg"
    model = model_of({"en": [a] * 5, "de": [b] * 5})
    assert langid.predict(a, model)[:2] == ("en", 1.0)
    mixed = langid.predict(f"{a} {a} {a} {b} {b}", model)
    assert mixed[0] == "en" and 0.5 < mixed[1] < 0.75 and set(mixed[2]) == {"en", "de"}
    assert sum(mixed[2].values()) == pytest.approx(1)
    for text in (None, "", "123 ... 456", "\n"):
        assert langid.predict(text, model) == ("und", 0.0, {})
    assert langid.predict("words", langid.Languages((), np.zeros((1 << langid.BITS, 0))))[0] == "und"


def plainly(counts, model, penalty=4.0):
    """(value, names) of the best of all sets of languages, by plain EM over many rounds."""
    at = np.flatnonzero(counts)
    c, p, best = counts[at].astype(float), model.prob[at], []
    for size in range(1, len(model.names) + 1):
        for pick in itertools.combinations(range(len(model.names)), size):
            q, share = p[:, pick], np.full(size, 1 / size)
            for _ in range(3000):
                share = share * ((c / (q @ share)) @ q) / c.sum()
            best.append((float(c @ np.log(q @ share)) - penalty * np.log(c.sum() + 1) * (size - 1), tuple(model.names[k] for k in pick), share))
    return max(best, key=lambda b: b[0])


def test_mixtures_against_all_sets_of_four_languages():
    texts = {
        "en": "the quick brown fox jumps over the lazy dog and runs away from it into the forest",
        "de": "der schnelle braune fuchs springt über den faulen hund und läuft davon in den wald",
        "fr": "le rapide renard brun saute par-dessus le chien paresseux et court dans la forêt",
        "es": "el rápido zorro marrón salta sobre el perro perezoso y corre hacia el bosque",
    }
    model, rng, sizes = model_of({k: [v] * 3 for k, v in texts.items()}), np.random.default_rng(2), set()
    for _ in range(25):
        parts = [" ".join([texts[k]] * int(rng.integers(1, 4))) for k in rng.choice(sorted(texts), int(rng.integers(1, 5)), replace=False)]
        words = " ".join(parts).split()
        text = " ".join(words[: int(rng.integers(5, len(words) + 1))])
        value, names, share = plainly(langid.ngram_counts(text), model)
        got = langid.infer(langid.ngram_counts(text), model)
        sizes.add(len(names))
        assert tuple(sorted(got)) == tuple(sorted(names))
        assert all(abs(got[n] - x) < 0.02 for n, x in zip(names, share, strict=True))
    assert len(sizes) > 2


def test_letters_decide():
    model = model_of({"en": ["the quick brown fox"]})
    for text in ("ℂ", "々", "〆", "ⁱ", "ª", "漢", "ก", "x"):
        assert langid.predict(text, model)[0] == "en" and langid.ngram_counts(text).sum() > 0, text
    for text in ("৴", "½", "Ⅻ", "\u0301", "_", "٣"):
        assert langid.predict(text, model) == ("und", 0.0, {}), text


def test_repeated_ids_lose_no_training_rows(spark):
    """Ten thousand labelled rows of one id, or one row ten thousand times, still teach their language."""
    words = "the quick brown fox jumps over the lazy dog".split()
    for text in (F.lit("the quick brown fox"), F.concat(F.lit("the quick "), F.element_at(F.array(*map(F.lit, words)), (F.col("id") % len(words) + 1).cast("int")), F.col("id").cast("string"))):
        for doc_id in (7, 11):
            docs = spark.range(10_000).select(F.lit(doc_id).cast("long").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"))
            model = langid.fit(docs, F.lit(True), max_labelled=50)
            assert model.names == ("en",) and langid.predict("the quick brown fox", model)[0] == "en"
    labels = spark.createDataFrame([(11, 0, 0)] * 5000 + [(k, 1, 1) for k in range(20, 40)] + [(50, 0, 0), (50, 1, 1)], "doc_id long, quality int, toxic int")
    known = shared.labels_by_id(labels, "doc_id", "quality", F.lit(True))
    assert sorted((r[0], r[1]) for r in shared.bounded(known, 4000, F.xxhash64("__id")).collect()) == [(11, 0)] + [(k, 1) for k in range(20, 40)]
    same = spark.range(10_000).select(F.lit(11).alias("x"))
    assert shared.bounded(same, 100, F.xxhash64("x")).count() == 100


def test_ngrams_do_not_depend_on_blocks(monkeypatch):
    text = "Ein Text, der über Grenzen geht. " * 50
    whole = langid.ngram_counts(text)
    monkeypatch.setattr(langid, "BLOCK", 7)
    assert (langid.ngram_counts(text) == whole).all()


def test_language_edge_cases(spark):
    docs = edge_docs(spark)
    model = langid.fit(docs, F.lit(True))
    out = langid.language_id(docs, model).collect()
    assert len(out) == len(EDGES)
    assert {r["lang_pred"] for r in out if r["doc_id"] in (1, 2, 3)} == {"und"}
    assert langid.fit(docs.where("false"), F.lit(True)).names == ()
    assert langid.fit(docs.withColumn("lang", F.lit(None).cast("string")), F.lit(True)).names == ()
    assert langid.language_id(docs.where("false"), model).count() == 0


def test_rare_languages_are_learned_whole(spark):
    texts = {"en": "the quick brown fox jumps over the lazy dog", "de": "der schnelle braune fuchs springt über den faulen hund"}
    rows = [(k, texts["en"], "en") for k in range(2000)] + [(k, texts["de"], "de") for k in range(2000, 2004)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model, want = langid.fit(docs, F.lit(True), max_labelled=20), model_of({"en": [texts["en"]], "de": [texts["de"]] * 4})
    assert model.names == ("de", "en") and np.allclose(model.prob[:, 0], want.prob[:, 0])
    assert langid.predict(texts["de"], model)[0] == "de" and langid.predict(texts["en"], model)[0] == "en"
    one = langid.fit(docs.withColumn("doc_id", F.lit(7).cast("long")), F.lit(True), max_labelled=2)
    assert one.names == langid.fit(docs.withColumn("doc_id", F.lit(None).cast("long")), F.lit(True), max_labelled=2).names == ("de", "en")


def test_quality_edge_cases(spark):
    docs = edge_docs(spark)
    labels = spark.createDataFrame([(3, 0, 0), (4, 1, None), (5, 1, 0), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    for lab, want in ((labels, None), (labels.where("false"), 0.5), (labels.where("quality = 1"), 1.0)):
        model = quality.train(docs, lab, F.lit(True))
        got = quality.quality_scores(docs, model, tuple(docs.columns)).collect()
        assert len(got) == len(EDGES) and all(0 <= r["score"] <= 1 for r in got)
        assert want is None or {r["score"] for r in got} == {want}
    assert quality.quality_scores(docs.where("false"), model).count() == 0


def test_discriminant_is_the_textbook_one():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 1, (300, 3)), rng.normal(1, 2, (300, 3))])
    y = np.repeat([0, 1], 300)
    m = quality.fit(x, y, shrink=0.0)
    z = (x - m.centre) / m.scale
    plain = []
    for k in (0, 1):
        cov = np.linalg.inv(m.factors[k]) @ np.linalg.inv(m.factors[k]).T
        d = z - m.means[k]
        plain.append(-0.5 * np.einsum("ni,ij,nj->n", d, np.linalg.inv(cov), d) - 0.5 * np.linalg.slogdet(cov)[1])
    assert np.allclose(m.margin(x), plain[1] - plain[0])


def plain_symbols(text):
    """Sentences of a lower-case text as lists of symbols: ``_`` for an edge, ``.`` for a gap."""
    out = []
    for sentence in re.split(r"(?<=[.!?])\s+|\n", text):
        words = [re.sub(r"^[^\w]+|[^\w]+$", "", w) for w in sentence.split()]
        words = [re.sub(r"[^\w]", ".", w) for w in words if w]
        if words:
            out.append("_" + "_".join(words) + "_")
    return out


def subsequences(s, start, stop):
    out = {}
    for i in range(start, stop):
        for j in range(i + 1, min(len(s), i + 1 + toxicity.REACH)):
            for k in range(j + 1, min(len(s), j + 1 + toxicity.REACH)):
                if "." not in (s[i], s[j], s[k]):
                    key = s[i] + s[j] + s[k]
                    out[key] = out.get(key, 0) + toxicity.DECAY ** (k - i + 1)
    return out


def brute_stretches(text):
    """(sentence, start, stop) of every stretch."""
    for s in plain_symbols(text):
        for width in toxicity.WIDTHS:
            for at in range(0, max(1, len(s) - width + toxicity.STRIDE), toxicity.STRIDE):
                yield s, at, min(len(s), at + width)


def dot(p, q):
    return sum(v * q.get(k, 0) for k, v in p.items())


def stretch_strings(text):
    chars, whose = next(toxicity.pieces([text]))
    s = toxicity.stretches(toxicity.symbols(chars), whose)
    return [s.string(k) for k in range(len(s.start))]


SENTENCES = ["You are an idiot. A quiet garden, it is!", "what a m-o-r-o-n you are\nnothing here", "漢字 也 是 字母 的 句子. ไทย", "a waste of space. x", "  ... plain words, of a 2nd kind"]


def test_the_kernel_of_stretches_is_that_of_brute_force():
    strings = [w for t in SENTENCES for w in stretch_strings(t)]
    want = [subsequences(s, i, j) for t in SENTENCES for s, i, j in sorted(brute_stretches(t.lower()), key=lambda x: 0)]
    codes, weights = toxicity.features(*toxicity.read(strings))
    norms = toxicity.norms(codes, weights)
    each = []
    for row in codes:
        own = {}
        for c, w in zip(row.tolist(), weights.tolist(), strict=True):
            if c:
                own[c] = own.get(c, 0) + w
        each.append(own)
    got = np.array([[dot(a, b) for b in each] for a in each]) / norms[:, None] / norms[None]
    root = [max(np.sqrt(dot(a, a)), 1e-9) for a in want]
    plain = np.array([[dot(a, b) / x / y for b, y in zip(want, root, strict=True)] for a, x in zip(want, root, strict=True)])
    # stretches come by width, the plain ones by sentence: kernels are compared as bags
    assert len(got) == len(plain) and np.allclose(np.sort(got.reshape(-1)), np.sort(plain.reshape(-1)), atol=1e-6)


def test_folded_landmarks_give_the_kernel_machine():
    """The value of a stretch is linear in its brute-force kernels to the landmarks, and a document's is the highest of its stretches."""
    bad, good = [stretch_strings(t) for t in ("such an idiot he is. you moron there. scum", "the house and garden. a window. idle hours of it")]
    bad, good = [w for w in bad if len(w) > 8], [w for w in good if len(w) > 8]
    m = toxicity.train(bad, good)
    plain = lambda w: subsequences("".join("_" if c == chr(1) else "." if c == chr(0) else c for c in w[1:]), 0, ord(w[0]) - 1)
    marks = [plain(w) for w in [*bad, *good]]
    kernel = lambda w: [dot(plain(w), q) / np.sqrt(dot(plain(w), plain(w)) * dot(q, q)) for q in marks]
    raw = m.weight[toxicity.features(*toxicity.read([*bad, *good]))[0]]
    codes, weights = toxicity.features(*toxicity.read([*bad, *good]))
    beta = np.linalg.lstsq(np.array([kernel(w) for w in [*bad, *good]]), raw @ weights / toxicity.norms(codes, weights), rcond=None)[0]
    for text in ("an idxiot she is", "in the garden", "i-d-i-o-t of them"):
        strings = stretch_strings(text)
        want = np.maximum([np.dot(kernel(w), beta) for w in strings], 0) + m.bias
        assert np.allclose(m.values(*toxicity.read(strings)), want, atol=1e-3)
        assert toxicity.tops([text], m)[0][0, 0] == pytest.approx(max(toxicity.FLOOR, want.max()), abs=1e-3)
    assert toxicity.tops(["an idxiot she is"], m)[0][0, 0] > toxicity.tops(["in the garden"], m)[0][0, 0]


def test_values_do_not_depend_on_company_or_blocks(monkeypatch):
    rng = np.random.default_rng(0)
    m = toxicity.Machine(0.5, rng.normal(0, 1, toxicity.CODES).astype(np.float32), -0.2)
    texts = [None, "", "...", *SENTENCES, "i d i o t !", "x" * 500, "long text of many words. " * 400]
    alone = [toxicity.tops([t], m) for t in texts]
    value, words, strings = toxicity.tops(texts, m)
    for k, (v, w, s) in enumerate(alone):
        assert np.allclose(value[k], v[0]) and words[k] == w[0] and strings[k] == s[0]
    assert [words[k] for k in range(3)] == [None] * 3 and (value[:3] == toxicity.FLOOR).all()
    monkeypatch.setattr(toxicity, "BLOCK", 1500)
    assert np.allclose(toxicity.tops(texts, m)[0][:, 0], value[:, 0], atol=0.35)  # the long text's stretches start elsewhere
    assert np.allclose(toxicity.tops(texts, m)[0][:-1], value[:-1])


def test_an_insult_of_two_harmless_words_is_learned(spark):
    """Either word is in many clean sentences; together they are an insult, also with a character put in."""
    rng, fill = random.Random(8), "river stone window garden paper under little walking summer bread early north music".split()
    some = lambda n: " ".join(rng.choice(fill) for _ in range(n))
    rows = []
    for k in range(600):
        kind = k % 3
        middle = ("dirt bag", rng.choice(["dirt road", "dirt floor", "the dirt"]), rng.choice(["paper bag", "my bag", "bag of bread"]))[kind]
        rows.append((k, f"{some(8)}. {some(3)} {middle} {some(3)}. {some(9)}.", int(kind == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    machine = toxicity.fit(docs.drop("toxic"), docs.select("doc_id", "toxic"), F.col("doc_id") < 450)
    got = toxicity.toxicity_scores(docs.where("doc_id >= 450"), machine).join(docs, "doc_id").toPandas()
    assert ((got["score"] >= 0.5) == (got["toxic"] == 1)).mean() >= 0.95
    texts = [f"{some(4)} {w} {some(4)}." for w in ("dirt bag", "dirt-bag", "dirxt bag", "dirt baag", "DIRT BAG") for _ in range(10)]
    clean = [f"{some(4)} {w} {some(4)}." for w in ("dirt", "bag", "paper bag", "dirt road") for _ in range(10)]
    toxic = lambda texts: (machine.probability(toxicity.tops(texts, machine)[0]) >= queries.TOXIC).mean()
    assert toxic(texts) >= 0.9 and toxic(clean) <= 0.1


def test_insults_in_other_scripts_are_learned(spark):
    rng = random.Random(3)
    words = {"zh": ("笨蛋", "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往"), "hi": ("मूर्ख", "पानी घर नदी किताब सड़क रात दिन फूल".split())}
    rows = []
    for k in range(400):
        insult, fill = words["zh" if k % 2 else "hi"]
        text = [("".join if k % 2 else " ".join)(rng.choice(fill) for _ in range(6)) for _ in range(6)]
        if k % 4 < 2:
            text[rng.randrange(6)] += " " + insult
        rows.append((k, " ".join(text) + ".", int(k % 4 < 2)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    machine = toxicity.fit(docs.drop("toxic"), docs.select("doc_id", "toxic"), F.col("doc_id") < 300)
    got = toxicity.toxicity_scores(docs.where("doc_id >= 300"), machine).join(docs, "doc_id").toPandas()
    assert ((got["score"] >= 0.5) == (got["toxic"] == 1)).mean() >= 0.95


def test_contradicting_labels_count_as_none(spark):
    docs = spark.createDataFrame([(k, f"word{k % 7} idiot" if k < 20 else f"word{k % 7} garden") for k in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k < 20)) for k in range(60)] + [(3, 0), (41, 1)], "doc_id long, toxic int")
    assert sorted(r[0] for r in shared.labels_by_id(labels, "doc_id", "toxic", F.lit(True)).collect()) == sorted({*range(60)} - {3, 41})
    assert 0 <= toxicity.toxicity_scores(docs, toxicity.fit(docs, labels, F.lit(True))).agg(F.max("score")).first()[0] <= 1


def test_toxicity_edge_cases(spark):
    docs = edge_docs(spark)
    labels = spark.createDataFrame([(3, 0, 0), (4, 1, 1), (5, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for lab in (labels, labels.where("false"), labels.where("toxic = 0")):
        got = toxicity.toxicity_scores(docs, toxicity.fit(docs, lab, F.lit(True))).collect()
        assert len(got) == len(EDGES) and all(0 <= r["score"] <= 1 for r in got)


@there
@pytest.mark.parametrize(("query", "label", "wrong"), [("op7_quality", "quality", 0.05), ("op10_toxicity", "toxic", 0.1)])
def test_held_out_labels(spark, query, label, wrong):
    out = queries.QUERIES[query](spark, DATA).where("held_out").join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").toPandas()
    assert (out["predicted"] != out[label]).mean() <= wrong


@pytest.mark.skipif(not Path("/root/testdata/sf0.1").exists(), reason="the driver's tables are not here")
def test_one_insult_is_enough(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    machine = toxicity.fit(docs, labels, ~toxicity.toxicity_fold())
    held = docs.join(labels.where("toxic = 0"), "doc_id").where(toxicity.toxicity_fold() & F.col("text").isNotNull()).orderBy("doc_id").select("text").toPandas()["text"].tolist()
    toxic = lambda texts: (machine.probability(toxicity.tops(texts, machine)[0]) >= queries.TOXIC).mean()
    assert len(held) > 500 and toxic(held) <= 0.02
    for w in ("idiot", "moron", "scum", "pathetic", "disgusting"):
        for form in (w, w.upper() + "!", " ".join(w), "-".join(w), f"{w[:2]}*{w[2:]}"):
            assert toxic([f"{t} {form} ." for t in held]) >= 0.99, form
        assert toxic([f"{t} {w}. {w} {w}!" for t in held]) >= 0.99
        assert w in toxicity.tops([f"a plain text {w}"], machine)[1][0].split()
    longer = [f"{w[:at]}{c}{w[at:]}" for w in ("pathetic", "disgusting", "worthless") for at in range(2, len(w) - 1) for c in "xk"]
    assert toxic([f"{held[0]} {w}" for w in longer]) >= 0.9


@there
def test_held_out_languages(spark):
    out = queries.op2_language_id(spark, DATA).where("held_out").join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    assert (out["lang_pred"] != out["lang"]).mean() <= 0.02
