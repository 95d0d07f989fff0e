"""Toxicity by a support vector machine with a gap-weighted subsequence kernel over labelled sentences.

A sentence is a string of symbols: its letters and digits in lower case, of any
script; one mark for each stretch of white space and for either end; other
characters inside a word are *gaps*, and around a word nothing.  Letters that
stand alone with one space between them are joined.  Sentences are compared by
*stretches* of up to ``WIDTHS`` symbols, which overlap (``STRIDE``): two
stretches are alike by the subsequences of three symbols that start in them.  One
whose symbols lie apart counts less (``DECAY`` for each place it spans), and at
most ``REACH`` places lie between neighbours, so inserted characters and gaps
leave an insult recognisable, in one word or over several.  The kernel is
normalised, so a stretch is 1 like itself.  Symbols are told apart by hashing the
triple, so no alphabet is learned or left out.

Training is on labelled sentences: every different sentence of the labelled
documents counts once, as toxic if only toxic documents hold it.  Most sentences
of a toxic document are harmless, so the label of a sentence holds for its most
telling stretch only.  At first that is the one around a run of characters that
toxic sentences hold far more often than chance allows (a likelihood-ratio test,
corrected for the number of runs); in later rounds the one that the machine
itself values most, if it speaks more for toxicity than nearly all clean
sentences do.  The machine is fitted on these stretches against stretches of
clean sentences, the most telling ones among them.  A bounded number of landmarks, stretches
of both kinds, spans the kernel's feature space (Nyström), and a linear
squared-hinge machine is fitted there.  As it is a weighted sum of kernels to
landmarks, those fold into one weight for each of the 2^20 hashed subsequences:
scoring needs no landmark any more and gives the same value.

Toxic stretches that are disguised, with gaps between all letters or a character
put in, are examples as well, and so are clean ones that are treated likewise.

A sentence is as toxic as its most toxic stretch.  Two logistic curves through
the labelled documents give the score, and the higher one counts.  The first has
the document's highest value alone for its input, so one insult is enough, however
often it is repeated and whatever else the document holds; it passes one half
only where at most a ``DOUBT``-th of the documents with values so high are clean.
The second has the two highest values of different stretches apart: where clean
documents hold a word, too, one is no proof and two may be.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .memory import hold
from .shared import bounded, fold, labels_by_id, map_text, need, save

DECAY, REACH, WIDTHS, STRIDE = 0.7, 3, (10, 20), 2
ROUNDS = 3
RUNS = (4, 5, 7, 9)  # symbols of the runs that the first round looks at
#: A sentence labelled toxic teaches if it speaks more for toxicity than this share of clean sentences.
SURE = 0.997
#: By its highest value alone a document is toxic if at most this share of the labelled documents with values so high are clean.
DOUBT = 0.03
BITS = 20
CODES = 1 << BITS
GAP, EDGE = 0, 1  # symbols; all others are code points
BLOCK = 1 << 16  # characters that are looked at together
SENTENCE_END = r"(?<=[.!?])\s+|\n+"
FLOOR, MINED = 0.0, -0.5  # lower values count as this in a score, and when stretches for training are looked for
_BREAKS = [ord(c) for c in ".!?\n。！？"]
_STEPS = [(a, b) for a in range(1, REACH + 1) for b in range(1, REACH + 1)]
WIDTH, _SPAN = max(WIDTHS), 2 * REACH
_A, _B, _C = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)
#: Three or more single characters with one space between them: letters of a word spelt out.
_SPELT = re.compile(r"(?<!\S)\S(?: \S){2,}(?!\S)")


@cache
def kinds() -> np.ndarray:
    """By code point: 0 other, 1 white space, 2 letter, mark of a script's vowels, or digit."""
    out = np.zeros(0x110000, dtype=np.uint8)
    for c in range(0x110000):
        x = chr(c)
        out[c] = 1 if x.isspace() else 2 if x.isalnum() or unicodedata.category(x) in ("Mn", "Mc") else 0
    return out


@dataclass(frozen=True)
class Symbols:
    """``code``: symbols of several texts, each sentence after the other; ``at``: where in the characters each came from; ``start, stop``: of each sentence."""

    code: np.ndarray
    at: np.ndarray
    start: np.ndarray
    stop: np.ndarray


def symbols(chars: np.ndarray) -> Symbols:
    """Of lower-case characters (code points); a line feed or the end of a sentence parts."""
    kind = kinds()[chars]
    n = np.arange(len(chars))
    letter, space = kind == 2, kind == 1
    last_letter = np.maximum.accumulate(np.where(letter, n, -1))
    last_space = np.maximum.accumulate(np.where(space, n, -1))
    next_letter = np.minimum.accumulate(np.where(letter, n, len(n))[::-1])[::-1]
    next_space = np.minimum.accumulate(np.where(space, n, len(n))[::-1])[::-1]
    inside = (kind == 0) & (last_letter > last_space) & (next_letter < next_space)
    keep = np.flatnonzero(letter | inside)
    if not len(keep):
        return Symbols(*(np.zeros(0, dtype=np.int64) for _ in range(4)))
    # between two kept characters: nothing, white space, or the end of a sentence
    spaces = np.cumsum(space)
    gap = spaces[keep[1:]] > spaces[keep[:-1]]
    marks = np.cumsum(np.isin(chars, _BREAKS))
    ends = gap & (marks[keep[1:]] > marks[keep[:-1]])
    # a word's symbols are followed by one edge, a sentence's by one more
    extra = np.concatenate([np.where(ends, 2, np.where(gap, 1, 0)), [1]])
    place = np.arange(len(keep)) + 1 + np.concatenate([[0], np.cumsum(extra[:-1])])
    code = np.full(len(keep) + 1 + int(extra.sum()), EDGE, dtype=np.uint32)
    at = np.zeros(len(code), dtype=np.int64)
    code[place] = np.where(letter[keep], chars[keep], GAP)
    at[place] = keep
    cut = place[:-1][ends]
    start = np.concatenate([[0], cut + 2])
    stop = np.concatenate([cut + 2, [len(code)]])
    at[start] = at[start + 1]
    return Symbols(code, np.maximum.accumulate(at), start, stop)


def triples(code: np.ndarray, a: int, b: int) -> np.ndarray:
    """Hashed subsequences (i, i + a, i + a + b) for each place i along the last axis; 0 where one holds a gap or leaves the array."""
    n = code.shape[-1]
    out = np.zeros(code.shape, dtype=np.int32)
    if n <= a + b:
        return out
    x, y, z = code[..., : n - a - b], code[..., a : n - b], code[..., a + b :]
    h = ((x * _A) ^ (y * _B + (y >> np.uint32(7)))) * _C
    h = (h ^ (h >> np.uint32(15)) ^ z * _A) * _B
    h = (h >> np.uint32(32 - BITS)) | np.uint32(1)  # never 0
    out[..., : n - a - b] = np.where((x != GAP) & (y != GAP) & (z != GAP), h, 0)
    return out


@dataclass(frozen=True)
class Stretches:
    """Of some texts: where each stretch starts and stops, and where its sentence stops."""

    of: Symbols
    owner: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    end: np.ndarray

    def reach(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbols that their subsequences may reach, how many of them start one)."""
        place = self.start[which, None] + np.arange(WIDTH + _SPAN)
        raw = np.where(place < self.end[which, None], self.of.code[np.minimum(place, len(self.of.code) - 1)], np.uint32(GAP))
        return raw, self.stop[which] - self.start[which]

    def string(self, k: int) -> str:
        """The same as a text: the number, as a character one higher, before the symbols."""
        raw, n = self.reach(np.array([k]))
        return chr(1 + int(n[0])) + raw[0, : min(WIDTH + _SPAN, self.end[k] - self.start[k])].astype("<u4").tobytes().decode("utf-32-le", "replace")


def stretches(s: Symbols, owners: np.ndarray) -> Stretches:
    """Every sentence in stretches of each of ``WIDTHS`` symbols, the last one up to its end."""
    each = []
    for width in WIDTHS:
        n = np.maximum(1, -(-(s.stop - s.start - width) // STRIDE) + 1)
        sentence = np.repeat(np.arange(len(n)), n)
        nth = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        start = s.start[sentence] + nth * STRIDE
        each.append((start, np.minimum(start + width, s.stop[sentence]), s.stop[sentence]))
    start, stop, end = (np.concatenate(x) for x in zip(*each, strict=True))
    return Stretches(s, owners[s.at[start]] if len(start) else start, start, stop, end)


def features(raw: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, weights): of each stretch (as :meth:`Stretches.reach` gives it) its subsequences, 0 where there is none, and the weights of the columns."""
    own = np.arange(WIDTH) < n[:, None]
    codes = np.concatenate([np.where(own, triples(raw, a, b)[:, :WIDTH], 0) for a, b in _STEPS], 1)
    return codes, np.concatenate([np.full(WIDTH, DECAY ** (a + b + 1)) for a, b in _STEPS])


def read(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """What :meth:`Stretches.reach` gives, of strings."""
    wide = WIDTH + _SPAN
    raw = np.frombuffer("".join([w[1:].ljust(wide, "\0") for w in strings]).encode("utf-32-le", "replace"), "<u4").reshape(len(strings), wide)
    return raw, np.array([ord(w[0]) - 1 for w in strings], dtype=np.int64)


def norms(codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Root of the kernel of each stretch with itself before it is normalised; at least 1e-9."""
    order = np.argsort(codes, axis=1, kind="stable")
    c = np.take_along_axis(codes, order, 1)
    w = np.where(c > 0, weights[order], 0.0)
    total = np.cumsum(w, axis=1)
    last = np.ones_like(c, dtype=bool)
    last[:, :-1] = c[:, 1:] != c[:, :-1]
    ends = np.where(last, total, 0.0)
    before = np.maximum.accumulate(np.concatenate([np.zeros((len(c), 1)), ends[:, :-1]], 1), axis=1)
    return np.maximum(np.sqrt((np.where(last, total - before, 0.0) ** 2).sum(1)), 1e-9)


@dataclass(frozen=True)
class Machine:
    """``base`` is the score where nothing could be learned."""

    base: float
    weight: np.ndarray | None = None  # per hashed subsequence: the landmarks, folded
    bias: float = 0.0
    one: tuple[float, float] = (1.0, 0.0)  # curve of the highest value: slope and constant
    two: tuple[float, float, float] = (0.0, 0.0, -40.0)  # curve of the two highest: slopes and constant

    def values(self, raw: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Decision values of stretches; one that speaks against toxicity counts as one that says nothing."""
        out = [np.zeros(0)]
        for at in range(0, len(raw), 2048):
            codes, weights = features(raw[at : at + 2048], n[at : at + 2048])
            out.append(np.maximum(self.weight[codes] @ weights, 0) / norms(codes, weights) + self.bias)
        return np.concatenate(out)

    def probability(self, top: np.ndarray) -> np.ndarray:
        """``top``: columns of the highest and the second highest value."""
        z = np.maximum(top[:, 0] * self.one[0] + self.one[1], top[:, 0] * self.two[0] + top[:, 1] * self.two[1] + self.two[2])
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def best(self, s: Stretches, n: int, floor: float = FLOOR) -> tuple[np.ndarray, np.ndarray]:
        """(values, stretches), n x 2: of each owner the highest stretch and the highest of those that are different from it and lie apart from it; ``floor`` and -1 where none is higher.

        Sums of weights and of their squares run over places, so a bound of a
        stretch's value costs two differences: the root of the sum of squares is
        no more than the norm.  Only stretches whose bound is over ``floor`` get
        their value computed.
        """
        value, which = np.full((n, 2), floor), np.full((n, 2), -1)
        if not len(s.start):
            return value, which
        raw, square = np.zeros(len(s.of.code)), np.zeros(len(s.of.code))
        left = np.repeat(s.of.stop, s.of.stop - s.of.start) - np.arange(len(s.of.code))  # places to the sentence's end
        for a, b in _STEPS:
            c = triples(s.of.code, a, b)
            c[left <= a + b] = 0
            w = DECAY ** (a + b + 1)
            raw += self.weight[c] * w
            square += (c > 0) * (w * w)
        raw, square = np.concatenate([[0.0], np.cumsum(raw)]), np.concatenate([[0.0], np.cumsum(square)])
        each = np.maximum(raw[s.stop] - raw[s.start], 0) / np.maximum(np.sqrt(np.maximum(square[s.stop] - square[s.start], 0)), 1e-9) + self.bias
        likely = np.flatnonzero(each + 1e-6 > floor)
        each[likely] = self.values(*s.reach(likely))
        order = likely[each[likely] > floor]
        order = order[np.lexsort((s.start[order], -each[order], s.owner[order]))]
        for k in (0, 1):
            owner = s.owner[order]
            pick = order[np.concatenate([[True], owner[1:] != owner[:-1]])] if len(order) else order
            value[s.owner[pick], k], which[s.owner[pick], k] = each[pick], pick
            top = which[s.owner, 0]
            # equal stretches have equal values
            apart = (s.start >= s.stop[top]) | (s.stop <= s.start[top])
            order = order[(apart & (np.abs(each - each[top]) > 1e-6))[order]]
        return value, which


def pieces(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(characters, whose they are): lower-case texts one after the other, at most about ``BLOCK`` at a time.

    A longer text comes in parts that overlap by some stretches and are cut at
    white space where there is any near.
    """
    held, size = [], 0

    def put() -> tuple[np.ndarray, np.ndarray]:
        chars = np.frombuffer("\n".join(t for _, t in held).encode("utf-32-le", "replace"), "<u4")
        whose = np.repeat([k for k, _ in held], [len(t) + 1 for _, t in held])[: len(chars)]
        held.clear()
        return chars, whose

    for k, text in enumerate(texts):
        low = _SPELT.sub(lambda m: m.group().replace(" ", ""), (text or "").lower())
        at = 0
        while at < len(low):
            stop = at + BLOCK
            if stop < len(low):
                stop = max((low.rfind(c, stop - 1000, stop) for c in " \n"), default=-1)
                stop = stop if stop > at else at + BLOCK
            held.append((k, low[at:stop]))
            size += len(held[-1][1])
            if size >= BLOCK:
                yield put()
                size = 0
            if stop >= len(low):
                break
            back = max((low.rfind(c, max(at, stop - 200), max(at, stop - 4 * WIDTH)) for c in " \n"), default=-1)
            at = back if back > at else max(at + 1, stop - 4 * WIDTH)
    if held:
        yield put()


def tops(texts: list[str | None], machine: Machine, floor: float = FLOOR) -> tuple[np.ndarray, list[str | None], list[str | None]]:
    """Of each text its two highest values (:meth:`Machine.best`), the words behind the highest, and their stretch; ``floor`` and None where none is higher.

    Words that the stretch cuts are given whole, up to 40 characters on either side.
    """
    found: list[list[tuple[float, str, str]]] = [[] for _ in texts]
    for chars, whose in pieces(texts):
        s = stretches(symbols(chars), whose)
        own = np.unique(whose)
        value, which = machine.best(replace(s, owner=np.searchsorted(own, s.owner)), len(own), floor)
        for k, vs, ws in zip(own.tolist(), value.tolist(), which.tolist(), strict=True):
            for v, w in zip(vs, ws, strict=True):
                if w < 0:
                    continue
                lo, hi = s.of.at[s.start[w]], s.of.at[s.stop[w] - 1]
                around = chars[max(0, lo - 40) : hi + 41].astype("<u4").tobytes().decode("utf-32-le", "replace")
                lo, hi = min(lo, 40), min(lo, 40) + hi + 1 - lo
                words = (re.search(r"\S*\Z", around[:lo]).group() + around[lo:hi] + re.match(r"\S*", around[hi:]).group()).strip()
                found[k].append((v, words, s.string(w)))
    out = np.full((len(texts), 2), floor)
    for k, each in enumerate(found):  # a text in several pieces has more than two, and what lies in the overlap twice
        each.sort(key=lambda x: -x[0])
        if each:
            out[k] = each[0][0], next((v for v, words, _ in each if words != each[0][1]), floor)
    return out, [e[0][1] if e else None for e in found], [e[0][2] if e else None for e in found]


def disguised(strings: list[str]) -> list[str]:
    """Of each stretch two forms: its middle letters with gaps between them, and the stretch with one character more near its middle, which a hash picks."""
    out = []
    for s in strings:
        n, own = ord(s[0]) - 1, s[1:]
        if n < 5:
            continue
        h = zlib.crc32(s.encode("utf-8", "replace"))
        spread = chr(GAP).join(own[max(0, n // 2 - 6) : n // 2 + 6]).replace(f"{chr(EDGE)}{chr(GAP)}", chr(EDGE)).replace(f"{chr(GAP)}{chr(EDGE)}", chr(EDGE))
        out.append(chr(1 + min(WIDTH, len(spread))) + spread[: WIDTH + _SPAN])
        at = n // 2 - 2 + h % 4
        more = own[:at] + (chr(GAP) if h % 3 == 0 else own[h % n]) + own[at:]
        out.append(chr(1 + min(WIDTH, n + 1)) + more[: WIDTH + _SPAN])
    return out


def svm(x: np.ndarray, y: np.ndarray, cost: float = 1.0, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear squared-hinge machine (Newton steps on the active rows); classes weigh alike."""
    z = np.concatenate([x, np.ones((len(x), 1))], 1)
    s = np.where(y > 0, 1.0, -1.0)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum())) * len(y) * cost
    ridge = np.eye(z.shape[1])
    ridge[-1, -1] = 1e-6
    a, active = np.zeros(z.shape[1]), None
    for _ in range(rounds):
        now = s * (z @ a) < 1
        if active is not None and (now == active).all():
            break
        active, c = now, weight * now
        a = np.linalg.solve(ridge + (z * c[:, None]).T @ z, (z * c[:, None]).T @ s)
    return a[:-1], float(a[-1])


def _profiles(codes: np.ndarray, weights: np.ndarray, norms_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes in use, their normalised weights: codes x stretches)."""
    used = np.unique(codes)
    used = used[used > 0]
    out = np.zeros((len(used) + 1, len(codes)), dtype=np.float32)
    np.add.at(out, (np.searchsorted(used, codes) + (codes > 0), np.arange(len(codes))[:, None]), np.where(codes > 0, weights, 0) / norms_of[:, None])
    return used, out[1:]


def train(toxic: list[str], clean: list[str], landmarks: int = 384) -> Machine:
    """The machine for stretches of toxic and of clean sentences; evenly spaced ones of either are the landmarks.

    Landmarks go in groups, so that only a group's few thousand subsequences are
    held as a matrix at a time.
    """
    half, words, y = landmarks // 2, [*toxic, *clean], np.array([1] * len(toxic) + [0] * len(clean))
    marks = [*range(0, len(toxic), max(1, -(-len(toxic) // half))), *range(len(toxic), len(words), max(1, -(-len(clean) // half)))]
    each = [features(*read(words[at : at + 2048])) for at in range(0, len(words), 2048)]
    weights = each[0][1]
    codes, root = np.concatenate([c for c, _ in each]), np.concatenate([norms(*e) for e in each])
    groups = [_profiles(codes[marks[at : at + 64]], weights, root[marks[at : at + 64]]) for at in range(0, len(marks), 64)]
    near = np.zeros((len(words), len(marks)), dtype=np.float32)
    for g, (used, profile) in enumerate(groups):
        rows = np.concatenate([np.zeros((1, profile.shape[1]), dtype=np.float32), profile])
        place = np.zeros(CODES, dtype=np.int32)  # of a code in the group, 0 for all others
        place[used] = np.arange(1, len(used) + 1)
        for at in range(0, len(words), 128):
            part = slice(at, at + 128)
            near[part, 64 * g : 64 * g + profile.shape[1]] = np.einsum("ntm,t->nm", rows[place[codes[part]]], weights.astype(np.float32)) / root[part, None]
    val, vec = np.linalg.eigh(near[marks].astype(float))
    keep = val > 1e-5 * max(val.max(), 1e-12)
    to_space = vec[:, keep] / np.sqrt(val[keep])
    w, bias = svm(near @ to_space, y)
    alpha = (to_space @ w).astype(np.float32)
    weight = np.zeros(CODES, dtype=np.float32)
    for g, (used, profile) in enumerate(groups):
        weight[used] += profile @ alpha[64 * g : 64 * g + profile.shape[1]]
    return Machine(0.5, weight, bias)


def _best_stretches(sentences: DataFrame, machine: Machine) -> DataFrame:
    """``stretch, value, y`` of every sentence; no stretch where none is over ``MINED``."""
    sent = sentences.sparkSession.sparkContext.broadcast(machine)  # 2^20 weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold(("toxicity",))
        for b in batches:
            value, _, strings = tops(b.column(0).to_pylist(), sent.value, MINED)
            yield pa.RecordBatch.from_arrays([pa.array(strings, pa.string()), pa.array(value[:, 0]), b.column(1)], names=["stretch", "value", "y"])

    return sentences.select("sentence", "y").mapInArrow(run, "stretch string, value double, y int")


def runs(code: np.ndarray) -> np.ndarray:
    """Hashes of the runs of ``RUNS`` symbols that start at each place, one row for each length; 0 where one holds a gap or two edges in a row."""
    out = np.zeros((len(RUNS), len(code)), dtype=np.int64)
    for row, k in zip(out, RUNS, strict=True):
        n = len(code) - k + 1
        if n <= 0:
            continue
        h, whole = np.full(n, k, dtype=np.uint32), np.ones(n, dtype=bool)
        for j in range(k):
            part = code[j : j + n]
            h = (h ^ part * _A) * _C
            h ^= h >> np.uint32(15)
            whole &= part != GAP
            if j:
                whole &= (part != EDGE) | (code[j - 1 : j - 1 + n] != EDGE)
        row[:n] = np.where(whole, (h * _B).astype(np.int64) + 1, 0)
    return out


def _telling(sentences: DataFrame) -> dict[int, float]:
    """Runs that toxic sentences hold too often for chance, with the likelihood ratio."""

    def table(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        run, bad = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        run, at, n = np.unique(run, return_inverse=True, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(run), pa.array(np.bincount(at, weights=bad, minlength=len(run)).astype(np.int64)), pa.array(n)], names=["run", "bad", "all"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for b in batches:
            y = b.column(1).to_numpy()
            for chars, whose in pieces(b.column(0).to_pylist()):
                found = symbols(chars)
                code = runs(found.code)
                at = np.broadcast_to(whose[found.at], code.shape)[code > 0].astype(np.int64)
                run = code[code > 0]
                _, once = np.unique((run * -7046029254386353131) ^ (at * 2654435761), return_index=True)  # of each sentence its different runs
                held.append((run[once], y[at[once]]))
                if sum(len(r) for r, _ in held) > 2_000_000:
                    yield table(held)
        if held:
            yield table(held)

    each = save(sentences.select("sentence", "y").mapInArrow(count, "run long, bad long, all long").groupBy("run").agg(F.sum("bad").alias("bad"), F.sum("all").alias("all")), "runs")
    bad, every, n = each.agg(F.sum("bad"), F.sum("all"), F.count(F.lit(1))).first()
    rate = min(0.5, max((bad or 0) / max(1, every or 1), 1e-6))
    gain = lambda part, of, base: F.when(part > 0, part * F.log(part / of / base)).otherwise(0.0)
    ratio = gain(F.col("bad"), F.col("all"), rate) + gain(F.col("all") - F.col("bad"), F.col("all"), 1 - rate)
    found = each.where((F.col("bad") > 0.8 * F.col("all")) & (ratio > float(np.log(n + 1)) + 1)).select("run", ratio.alias("ratio"))
    return {r[0]: r[1] for r in found.orderBy(F.desc("ratio"), "run").limit(20_000).collect()}


def _first_stretches(sentences: DataFrame, telling: dict[int, float]) -> DataFrame:
    """``stretch, value, y``: of each sentence the stretch around its most telling run, or one at a place that a hash picks, with value 0."""
    known = np.array(sorted(telling), dtype=np.int64)
    gains = np.array([telling[k] for k in known.tolist()])
    sent = sentences.sparkSession.sparkContext.broadcast((known, gains))  # at most 20,000 runs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, gains = sent.value
        for b in batches:
            out: dict[int, tuple[float, str]] = {}
            for chars, whose in pieces(b.column(0).to_pylist()):
                s = stretches(symbols(chars), whose)
                code = runs(s.of.code)
                spot = np.minimum(np.searchsorted(known, code), max(0, len(known) - 1))
                gain = np.where(known[spot] == code, gains[spot], 0.0).max(0) if len(known) else np.zeros(len(s.of.code))
                middle = (s.start + s.stop) // 2
                best = np.zeros(len(s.start))
                for k in range(-4, 2):  # runs that start near the middle
                    best = np.maximum(best, np.where((middle + k >= s.start) & (middle + k < s.stop), gain[np.clip(middle + k, 0, len(gain) - 1)], 0))
                order = np.lexsort(((s.start * 2654435761) % 1009, -best, s.owner))
                first = np.concatenate([[True], s.owner[order][1:] != s.owner[order][:-1]]) if len(order) else np.zeros(0, dtype=bool)
                for k in order[first].tolist():
                    if out.get(int(s.owner[k]), (-1.0, ""))[0] < best[k]:
                        out[int(s.owner[k])] = (float(best[k]), s.string(k))
            at = sorted(out)
            yield pa.RecordBatch.from_arrays([pa.array([out[k][1] for k in at], pa.string()), pa.array([out[k][0] for k in at], pa.float64()), b.column(1).take(pa.array(at, pa.int64()))], names=["stretch", "value", "y"])

    return sentences.select("sentence", "y").mapInArrow(run, "stretch string, value double, y int")


def fit(docs: DataFrame, labels: DataFrame, trainable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = 8_000, max_toxic: int = 2_000, max_clean: int = 8_000, landmarks: int = 384) -> Machine:
    """Fits on texts of labelled rows for which ``trainable`` (over ``id_col``) holds and the label is 0 or 1.

    Bounds, all parameters: ``max_labelled`` labelled ids (those with the
    smallest hash) and as many different texts of theirs; ``max_toxic``
    stretches of toxic sentences, ``max_clean`` of clean ones, and ``landmarks``.
    An id with both labels has none; a sentence of documents with both labels is
    clean.
    """
    need(docs, id_col, text_col)
    known = bounded(labels_by_id(labels, id_col, label_col, trainable), max_labelled, F.xxhash64("__id"), F.col("__id"))
    rows = docs.join(F.broadcast(known), F.col(id_col) == F.col("__id")).select("__id", F.col(text_col).cast("string").alias("text"), F.col("__y").alias("y")).where("text is not null")
    rows = save(bounded(rows.distinct(), max_labelled, F.xxhash64("__id", "text"), "__id").select("text", "y"), "labelled")
    count = {r[0]: r[1] for r in rows.groupBy("y").count().collect()}
    if len(count) < 2:
        return Machine(base=float(next(iter(count), 0.0)))
    sentences = rows.select(F.explode(F.split("text", SENTENCE_END)).alias("sentence"), "y").groupBy("sentence").agg(F.min("y").alias("y"))
    sentences = save(sentences.repartition(16), "sentences")
    machine, first, clean, mixed = None, [], [], F.xxhash64("stretch")
    for k in range(ROUNDS):
        best = save(_best_stretches(sentences, machine) if machine else _first_stretches(sentences, _telling(sentences)), "stretches")
        limit = best.where("y = 0").agg(F.percentile("value", F.lit(SURE))).first()[0]
        best = best.where("stretch IS NOT NULL")
        sure = best.where((F.col("y") == 1) & (F.col("value") > max(0.0, limit or 0.0))).select("stretch").distinct()
        toxic = sorted(r[0] for r in sure.orderBy(mixed, "stretch").limit(max_toxic).collect())
        hard = best.where("y = 0").groupBy("stretch").agg(F.max("value").alias("value")).orderBy(F.desc("value"), mixed, "stretch").limit(max_clean // 4 if machine else 0)
        fair = best.where("y = 0").select("stretch").distinct().orderBy(mixed, "stretch").limit(max_clean // 16 if machine else max_clean // 2)
        first = first or toxic
        toxic = list(dict.fromkeys([*first, *toxic]))
        bad = frozenset(toxic)
        clean = [c for c in dict.fromkeys([*clean, *(r[0] for r in hard.select("stretch").collect()), *(r[0] for r in fair.collect())]) if c not in bad]
        if not toxic or not clean:
            return Machine(base=count[1] / (count[0] + count[1]))
        machine = train([*toxic, *disguised(toxic[::2])], [*clean, *disguised(clean[::4])], landmarks)
    top = _evidence(rows, machine, ["y"], "text").select("y", "first", "second").toPandas()
    x, y = top[["first", "second"]].to_numpy(float), top["y"].to_numpy(int)
    slope, at = _curve(x[:, :1], y)
    order = np.argsort(-x[:, 0], kind="stable")
    clean_share = np.cumsum(y[order] == 0) / np.arange(1, len(y) + 1)
    proof = np.flatnonzero(clean_share <= DOUBT)
    least = x[order[proof[-1]], 0] if len(proof) else np.inf
    # no value is proof: the curve never passes one half
    return replace(machine, one=(slope, min(at, -slope * least)) if np.isfinite(least) else (0.0, -40.0), two=_curve(x, y))


def _curve(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[float, ...]:
    """Slopes (not negative) and constant of a logistic curve."""
    z = np.concatenate([x, np.ones((len(x), 1))], 1)
    a = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ a, -40, 40)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(len(a)), z.T @ (p - y) + 1e-3 * a)
        a = a - step / max(1.0, float(np.abs(step).max()) / 2)
        if np.abs(step).max() < 1e-7:
            break
    return (*(max(float(k), 0.0) for k in a[:-1]), float(a[-1]))


def _evidence(docs: DataFrame, machine: Machine, carry: list[str], text_col: str) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(machine)  # 2^20 weights

    def make():
        m = sent.value
        hold(("toxicity",))

        def run(texts: list[str | None]) -> list[pa.Array]:
            value, words, _ = tops(texts, m)
            return [pa.array(value[:, 0]), pa.array(value[:, 1]), pa.array(words, pa.string())]

        return run

    return map_text(docs, text_col, carry, [("first", "double"), ("second", "double"), ("evidence", "string")], make)


def toxicity_scores(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, score, evidence`` for every row: the probability of label 1 and the words that speak most for it.

    A text without a stretch of any likeness to a toxic one, a null or empty one
    among them, has a null evidence and the score that goes with that.  Without labels every score is 0, with labels of one class that
    label.  Repeated rows give repeated scores; an empty table gives an empty one.
    """
    need(docs, id_col, text_col)
    if machine.weight is None:
        return docs.select(id_col, F.lit(float(machine.base)).alias("score"), F.lit(None).cast("string").alias("evidence"))
    first, second = F.col("first"), F.col("second")
    z = F.greatest(first * machine.one[0] + machine.one[1], first * machine.two[0] + second * machine.two[1] + machine.two[2])
    return _evidence(docs, machine, [id_col], text_col).select(id_col, (1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), z))))).alias("score"), "evidence")


def toxicity_fold(id_col: str = "doc_id") -> Column:
    """The rows that are held out: crc32 of the id, modulo 5, is 0."""
    return fold(id_col, 5) == 0
