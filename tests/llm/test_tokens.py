"""Packing, byte-level BPE and the word memory against plain versions."""

import base64
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from loomstone.llm import bpe, packing, wordcache

PLAIN, MULTI = P.path("byte_bpe_50k.json"), P.path("byte_bpe_multi_50k.tiktoken")
ODD = "ab1é .,'\n\n  \t　\r\x1c\x00<|>s日̀aaaa"


def odd_texts(n, seed=1, most=16):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, most))) for _ in range(n)]


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(MULTI, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_word_memory_gives_the_library_s_ids(monkeypatch):
    monkeypatch.setattr(wordcache, "REMEMBERED", 50)  # ages all the time
    t, encode = Tokenizer.from_file(PLAIN), wordcache.id_encoder(PLAIN)
    texts = [*odd_texts(3000), "It's a test.\nNext line, it's fine.", "<|endoftext|> a <|endoftext|>b", "word " * 5000]
    for at in range(0, len(texts), 100):
        some = texts[at : at + 100]
        assert encode(some) == [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in some]


def test_bpe_is_that_of_the_library(reference):
    own = bpe._worker(MULTI, P.PATTERN)
    texts = [*odd_texts(3000, 2), "a" * 20_000, "supercalifragilistic unbelievable"]
    assert own[1](texts) == [np.array(reference.encode_ordinary(x), "<u4").tobytes() for x in texts]
    assert [own[0].decode(i).decode() for i in own[1](texts)] == texts


def test_perfect_hash_is_minimal_and_perfect():
    keys = [f"key{i}".encode() for i in range(3001)]
    h = bpe.PerfectHash(keys)
    assert sorted(h.slots(keys).tolist()) == list(range(len(keys)))
    assert (h.slots(keys) == h.slot_of_key).all()
    with pytest.raises(ValueError, match="repeat"):
        bpe.PerfectHash([b"x", b"x"])


def test_encode_and_decode_tables(spark, reference):
    rows = [(1, "hello wörld"), (2, None), (3, ""), (3, ""), (None, "x " * 9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'mine' AS ids", "1 AS decoded")
    out = bpe.decode(bpe.encode(df, MULTI, P.PATTERN), MULTI, P.PATTERN)
    got = out.select("doc_id", "text", "ids", "decoded", bpe.n_tokens().alias("n")).collect()
    assert len(got) == 5
    for r in got:
        assert bytes(r["decoded"]).decode() == (r["text"] or "")
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == reference.encode_ordinary(r["text"] or "")
        assert r["n"] == len(r["ids"]) // 4
    assert bpe.encode(df.where("false"), MULTI, P.PATTERN).count() == 0


def brute_fits(counts, capacity, plan):
    used = {}
    for members, times in plan:
        assert sum(members) <= capacity and times > 0
        for m in members:
            used[m] = used.get(m, 0) + times
    return used == counts


def test_plans_use_every_piece_once():
    rng = random.Random(5)
    for _ in range(30):
        capacity = rng.randint(1, 60)
        counts = {n: rng.randint(1, 50) for n in rng.sample(range(1, capacity + 1), rng.randint(1, min(capacity, 20)))}
        assert brute_fits(counts, capacity, packing.plan_bins(counts, capacity))
    assert packing.plan_bins({}, 10) == []
    with pytest.raises(ValueError, match="lengths"):
        packing.plan_bins({11: 1}, 10)


def test_smallest_is_replaced_by_a_tighter_pair():
    # greedy: 6 + 3, gap 1; instead of the 3, the 2 and the 2 fill the gap of 4
    assert packing.plan_bins({6: 1, 3: 1, 2: 2}, 10)[0] == ((6, 2, 2), 1)


def test_packing_of_a_table(spark):
    rows = [(i, " ".join(["word"] * (i * 7 % 50))) for i in range(60)] + [(100, None), (101, ""), (7, "twice"), (7, "twice"), (None, "no id"), (102, "long " * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS offset", "2 AS sequence_id").repartition(5)
    out = packing.best_two_fit(packing.tokenise(docs, PLAIN, 2, 64), 64).collect()
    t = Tokenizer.from_file(PLAIN)
    want = sorted((i is None, i or 0, zlib.crc32(np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4").tobytes())) for i, x in rows if i != 7)
    by_doc = {}
    for r in out:
        by_doc.setdefault(r["doc_id"], []).append(r)
    got = []
    for i, pieces in by_doc.items():
        if i == 7:
            continue
        pieces.sort(key=lambda r: r["piece"])
        assert [p["piece"] for p in pieces] == list(range(len(pieces)))
        assert all(p["length"] == 64 for p in pieces[1:])
        got.append((i is None, i or 0, zlib.crc32(b"".join(bytes(p["ids"]) for p in pieces))))
    assert sorted(got) == want
    bins = {}
    for r in out:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= 1.05 * sum(r["length"] for r in out) / 64 + 1
    assert packing.best_two_fit(packing.tokenise(docs.where("false"), PLAIN), 64).count() == 0
    whole = packing.sequences(packing.best_two_fit(packing.tokenise(docs, PLAIN, 2, 64), 64))
    assert all(len(r["ids"]) == 4 * r["n_tokens"] for r in whole.collect())


def test_other_patterns_are_the_librarys_too(spark):
    """A pattern that joins marks and line feeds, for which texts may not be cut between them."""
    pattern, path = r" ?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s+", P.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    rng = random.Random(2)
    texts = ["hi!\n\nyou ... \n x", "a!\nb", "", None, "12345 6"] + ["".join(rng.choice(["a", "bc", "!", "\n", " ", "é", "7", "?!"]) for _ in range(60)) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in bpe.encode(df, path, pattern).collect():
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == library.encode_ordinary(texts[r["doc_id"]] or "")


def test_a_word_is_encoded_once_whatever_marks_follow_it():
    t = Tokenizer.from_file(PLAIN)
    joined, asked = wordcache.Joined(t), []
    encode = wordcache.WordCache(lambda parts: asked.extend(parts) or joined(parts))
    texts = ["some word, word. word! word", "word?! word... don't, 'word' 12, x́.", "", ",", "word,\0 word."]
    for some in (texts[:1], texts, ["", ""]):
        assert encode(some) == [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in some]
    assert asked.count(" word") == 1
    assert " word," not in asked
    assert " don't," in asked  # no word alone: encoded in place


def test_words_by_the_model_alone_have_the_library_s_ids():
    t, rng = Tokenizer.from_file(PLAIN), random.Random(3)
    joined = wordcache.Joined(t)
    assert joined.by_model
    letters = [c for c in map(chr, range(0xD7FF)) if wordcache.WORD(c)]
    assert all(c.isalpha() for c in letters)
    assert not any(c.isalnum() or c.isspace() for c in wordcache.MARKS)
    words = [*letters, *(rng.choice(["", " "]) + "".join(rng.choice(letters[: rng.choice([52, 400, 30_000])]) for _ in range(rng.randint(1, 12))) for _ in range(5000))]
    assert joined(words) == [np.array(e.ids, "<u4").tobytes() for e in t.encode_batch(words, add_special_tokens=False)]
    encode = wordcache.WordCache(joined)
    texts = [w + "".join(rng.choice(wordcache.MARKS) for _ in range(rng.randint(1, 3))) + rng.choice(["", " b", "b", "\nb"]) for w in words[-5000:]]
    texts += [f"a{c}" for c in wordcache.MARKS]
    assert encode(texts) == [np.array(e.ids, "<u4").tobytes() for e in t.encode_batch(texts, add_special_tokens=False)]


def test_added_tokens_of_words_and_marks_are_left_to_the_library():
    t = Tokenizer.from_file(PLAIN)
    t.add_tokens(["c++"])
    joined = wordcache.Joined(t)
    assert not joined.by_model
    encode = wordcache.WordCache(joined, closing=joined.by_model)
    assert encode(["in c++, c+"]) == [np.array(t.encode("in c++, c+", add_special_tokens=False).ids, "<u4").tobytes()]
