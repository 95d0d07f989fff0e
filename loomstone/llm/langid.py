"""Language proportions of a document by expectation-maximisation over n-gram likelihoods.

A language is a smoothed distribution over hashed character n-grams (1 to 3
characters, word edges included).  A document is a bag of n-grams drawn from a
mixture of languages; EM estimates the proportions, until the likelihood is
within ``TOLERANCE`` of its maximum (the gap is known, as the likelihood is
concave in the proportions).  Which languages are in the mixture is chosen by
penalised likelihood: each language beyond the first must raise the
log-likelihood by ``penalty * log(n-grams)``.  No mixture is likelier than that
of all languages, which bounds the size of the sets that can pay; if not even
two can, the best single language stands.  Else all sets up to that size are
tried of the ``CANDIDATES`` languages with the largest shares in the mixture of
all.  With up to as many learned languages the choice is exact; with more it is
exact among those.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .memory import hold
from .shared import fold, map_text, need, save

BITS = 15
UNKNOWN = "und"
TOLERANCE, ROUNDS, CANDIDATES = 0.01, 500, 6  # of a log-likelihood, at most for one EM, and see above
_MULT = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)
BLOCK = 1 << 16  # characters that are hashed at a time


@cache
def letters() -> np.ndarray:
    """By code point, whether it belongs to a word: letters (what ``str.isalpha`` says), and the marks that some scripts write vowels with."""
    return np.array([unicodedata.category(chr(c))[0] in "LM" for c in range(0x110000)])


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def ngram_counts(text: str) -> np.ndarray:
    """Counts of the hashed n-grams of the whole text: its letters in lower case, everything else one space."""
    out = np.zeros(1 << BITS, dtype=np.int64)
    shift = np.uint32(32 - BITS)
    for at in range(0, len(text), BLOCK):  # two characters of overlap, as an n-gram belongs to where it ends
        seen = 2 if at else 0
        part = text[at - seen : at + BLOCK]
        low = part.lower()
        if len(low) != len(part):  # a few capitals become two characters
            low = "".join(c.lower()[0] for c in part)
        c = np.frombuffer(low.encode("utf-32-le", "replace"), "<u4")
        c = np.where(letters()[c], c, np.uint32(32))
        m = c[max(seen, 0) :]
        h = m * _MULT[0]
        out += np.bincount(h[m != 32] >> shift, minlength=1 << BITS)
        if len(c) > 1:
            two, first = c[1:], c[:-1]
            h2 = (first * _MULT[1] ^ (two + np.uint32(77)) * _MULT[0]) * _MULT[2]
            use = (two != 32) | (first != 32)
            out += np.bincount((h2 >> shift)[max(seen - 1, 0) :][use[max(seen - 1, 0) :]], minlength=1 << BITS)
        if len(c) > 2:
            h3 = ((c[:-2] * _MULT[2] ^ c[1:-1] * _MULT[1]) * _MULT[0] ^ (c[2:] + np.uint32(191)) * _MULT[1]) * _MULT[2]
            use3 = (c[1:-1] != 32) & ((c[:-2] != 32) | (c[2:] != 32))
            out += np.bincount((h3 >> shift)[use3], minlength=1 << BITS)
    return out


@dataclass(frozen=True)
class Languages:
    names: tuple[str, ...]
    prob: np.ndarray  # n-grams x languages

    @classmethod
    def from_counts(cls, names: list[str], counts: np.ndarray, alpha: float = 0.1) -> Languages:
        """``counts``: languages x n-grams."""
        p = counts + alpha
        return cls(tuple(names), np.ascontiguousarray((p / p.sum(1, keepdims=True)).T))


def em(prob: np.ndarray, count: np.ndarray, rounds: int = ROUNDS, enough: float | None = None) -> tuple[np.ndarray, float, float]:
    """(proportions, log-likelihood, its upper bound) of the mixture of the columns of ``prob``; the maximum lies between the last two.

    Ends when they are within ``TOLERANCE``, or as soon as the bound is under ``enough``.
    """
    total = count.sum()
    share = np.full(prob.shape[1], 1 / prob.shape[1])
    for k in range(rounds):
        mixed = prob @ share
        slope = (count / mixed) @ prob  # of the log-likelihood
        gap = float(slope.max() - total)
        if gap <= TOLERANCE or k == rounds - 1 or enough is not None and k % 5 == 4:
            value = float(count @ np.log(mixed))
            if gap <= TOLERANCE or k == rounds - 1 or value + gap < enough:
                return share, value, value + max(0.0, gap)
        share = share * slope / total
    raise ValueError("at least one round")


def infer(counts: np.ndarray, model: Languages, penalty: float = 4.0) -> dict[str, float]:
    """Proportions of the languages chosen for a bag of n-grams; they sum to 1. Empty without n-grams or languages."""
    at = np.flatnonzero(counts)
    if not len(at) or not model.names:
        return {}
    c, p = counts[at].astype(float), model.prob[at]
    single = c @ np.log(p)
    best = int(np.argmax(single))
    cost = penalty * np.log(c.sum() + 1)
    chosen, score, share = (best,), float(single[best]), np.ones(1)
    if len(model.names) > 1:
        every, _, most = em(p, c, enough=score + cost)
        likely = sorted(np.argsort(-every, kind="stable")[:CANDIDATES].tolist())
        size = 2
        while size <= len(likely) and most - cost * (size - 1) > score:
            for trial in combinations(likely, size):
                s, value, _ = em(p[:, trial], c, enough=score + cost * (size - 1))
                if value - cost * (size - 1) > score:
                    chosen, score, share = trial, value - cost * (size - 1), s
            size += 1
    return {model.names[k]: float(x) for k, x in zip(chosen, share / share.sum(), strict=True)}


def predict(text: str | None, model: Languages) -> tuple[str, float, dict[str, float]]:
    """(language, score, proportions). ``und`` with score 0 for a text without letters, or without a model."""
    if not text or not has_letter(text):
        return UNKNOWN, 0.0, {}
    counts = ngram_counts(text)
    mix = infer(counts, model)
    if not mix:
        return UNKNOWN, 0.0, {}
    lang = max(mix, key=lambda k: (mix[k], k))
    return lang, min(1.0, max(0.0, mix[lang])), mix


def fit(docs: DataFrame, trainable: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", max_labelled: int = 4_000) -> Languages:
    """Learns from ``text_col`` and non-null ``lang_col`` of rows where ``trainable`` holds.

    Of a language with more than ``max_labelled`` different such rows about so
    many are used, those with a small hash of id and text; of any other all are.
    Rows with equal id, text and language count once.  Texts are whole.  The
    rows are drawn in a pass over all of them and written down; the few tasks
    that count their n-grams read those alone and send one array for each
    language they met.
    """
    need(docs, text_col, lang_col, id_col)
    rows = docs.where(trainable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.xxhash64(id_col, F.col(text_col).cast("string")).alias("at"))
    size = rows.groupBy("lang").agg(F.approx_count_distinct("at", 0.02).alias("n"))
    bound = -(2.0**63) + 2.0**64 * max_labelled / F.col("n")
    use = rows.join(F.broadcast(size), "lang").where((F.col("n") <= max_labelled) | (F.col("at").cast("double") < bound))  # size has a row a language
    use = save(use.dropDuplicates(["lang", "at"]).select("lang", "text"), "labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold(("language",))
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got = ngram_counts(text)
                total[lang] = total[lang] + got if lang in total else got
        for lang, c in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([c.astype("<i8").tobytes()], pa.binary())], names=["lang", "counts"])

    out: dict[str, np.ndarray] = {}
    for r in use.coalesce(8).mapInArrow(count, "lang string, counts binary").toLocalIterator():
        out[r[0]] = out.get(r[0], 0) + np.frombuffer(r[1], "<i8")
    out.pop(UNKNOWN, None)
    names = sorted(out)
    return Languages.from_counts(names, np.array([out[k] for k in names], dtype=float).reshape(len(names), -1)) if names else Languages((), np.zeros((1 << BITS, 0)))


def language_id(docs: DataFrame, model: Languages, carry: tuple[str, ...] = ("doc_id",), text_col: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "mixture")) -> DataFrame:
    """Columns ``carry`` and ``names`` of every row of ``docs``.

    ``mixture`` maps each chosen language to its proportion; ``score`` is that of
    ``lang_pred``.  A text that is null, empty or has no letter gives ``und``, 0
    and an empty map.  Equal shares go to the later name.  Repeated rows give
    repeated results; an empty table gives an empty one.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # languages x 2^15 doubles, whatever the input

    def make():
        m = sent.value
        hold(("language",))

        def run(texts: list[str | None]) -> list[pa.Array]:
            got = [predict(t, m) for t in texts]
            return [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([list(g[2].items()) for g in got], pa.map_(pa.string(), pa.float64()))]

        return run

    return map_text(docs, text_col, list(carry), list(zip(names, ("string", "double", "map<string,double>"), strict=True)), make)


def language_fold(id_col: str = "doc_id") -> Column:
    """The rows that are held out: crc32 of the id, modulo 3, is 1."""
    return fold(id_col, 3) == 1


__all__ = ["Languages", "em", "fit", "has_letter", "infer", "language_fold", "language_id", "letters", "ngram_counts", "predict"]
