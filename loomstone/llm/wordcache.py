"""Token ids with a bounded memory of words seen before.

The pre-token pattern :data:`CUTTABLE` always ends a token before a lone space
and on both sides of a lone line feed that stand between two visible
characters.  So a text may be cut there, each part encoded by itself, and the
ids put together: the result is that of the whole text.  Parts recur (they are
mostly words); each worker keeps the ids of a bounded number of short parts.
A token also ends between a word's last letter and the marks that close its
part, so a word is kept once, whatever marks follow it.
"""

from __future__ import annotations

import os
import re
import string
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .memory import hold

REMEMBERED, LONGEST = 500_000, 40
#: Fixed value: the public pattern for which the cuts are right. Others may join a mark and a line feed.
CUTTABLE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space other than space and line feed.
_OTHER = re.compile(r"[^\S \n]")
_SAFE = re.compile(r"(?<=\S)(?= \S)|(?<=\S)(?=\n\S)|(?<=\S\n)(?=\S)")
_PAIRS = ("  ", "\n\n", " \n", "\n ")
#: Letters, and marks that are no letter, number or white space, in every version of Unicode that a pattern may be of. Others are encoded in place.
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏΆΈ-ΊΌΎ-ΡΣ-ϵЀ-ҁҊ-ԓぁ-ゖァ-ヺ一-龥가-힣"
MARKS = string.punctuation + "¡§¶·¿«»" + "".join(map(chr, [*range(0x2010, 0x2028), *range(0x2030, 0x205F)]))
WORD = re.compile(f" ?[{_LETTERS}]+").fullmatch
_CLOSED = f"^(?P<word> ?[{_LETTERS}]+)(?P<marks>[{re.escape(MARKS)}]+)$"
_WORD_OR_MARKS = re.compile(f" ?[{_LETTERS}]*[{re.escape(MARKS)}]*").fullmatch


def marked(text: str) -> str:
    """``text`` with a NUL between parts that are encoded alike alone and in place. It holds no NUL itself."""
    if not text:
        return text
    if text[0] in " \n" or text[-1] in " \n" or any(p in text for p in _PAIRS) or _OTHER.search(text):
        return "\0".join(_SAFE.split(text))
    return text.replace(" ", "\0 ").replace("\n", "\0\n\0")


def chunks(texts: list[str], characters: int = 2_000_000) -> list[tuple[int, int]]:
    """Ranges of texts that together have about so many characters (a longer text has a range of its own)."""
    out, start, total = [], 0, 0
    for k, t in enumerate(texts):
        if total and total + len(t) > characters:
            out.append((start, k))
            start, total = k, 0
        total += len(t)
    return [*out, (start, len(texts))] if texts else []


def strings(column: pa.Array) -> list[str]:
    """The list of a column of large strings without null and NUL: one string made and split takes a tenth of the time of ``to_pylist``."""
    return pc.binary_join(pa.ListArray.from_arrays([0, len(column)], column), pa.scalar("\0", pa.large_string()))[0].as_py().split("\0") if len(column) else []


class WordCache:
    """Encodes lists of texts to little-endian unsigned 32-bit ids; ``encode_new`` does so for parts not in memory.

    Memory has two generations of half the size: when the young one is full it
    becomes the old one, and what is used again moves on to the next.  With
    ``closing`` a word and the marks that close its part are encoded and kept apart.
    """

    def __init__(self, encode_new: Callable[[list[str]], list[bytes]], remember: int | None = None, closing: bool = True):
        self.encode_new, self.remember, self.closing, self.seen, self.old = encode_new, remember or REMEMBERED, closing, {}, {}

    def __call__(self, texts: list[str]) -> list[bytes]:
        whole = [k for k, t in enumerate(texts) if "\0" in t]
        if whole:  # NUL marks the cuts; a text that holds one is encoded as it is
            odd = dict(zip(whole, self.encode_new([texts[k] for k in whole]), strict=True))
            rest = iter(self([t for t in texts if "\0" not in t]))
            return [odd[k] if k in odd else next(rest) for k in range(len(texts))]
        if not texts:
            return []
        parts = pc.split_pattern(pa.array([marked(t) for t in texts], pa.large_string()), "\0")
        coded = parts.values.dictionary_encode()
        known = self._known(coded.dictionary)
        # the ids of all parts in order: each takes its part's run out of the different ones' ids
        size = np.fromiter(map(len, known), np.int64, len(known)) // 4
        start = np.cumsum(size) - size
        at = coded.indices.to_numpy()
        n = size[at]
        ends = np.cumsum(n)
        ids = np.frombuffer(b"".join(known), "<u4")[np.repeat(start[at] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        cut = np.concatenate([[0], ends])[parts.offsets.to_numpy()].tolist()
        return [ids[i:j].tobytes() for i, j in zip(cut, cut[1:], strict=False)]

    def _known(self, column: pa.Array) -> list[bytes]:
        """The ids of a column of different parts."""
        if not self.closing:
            return self._ids(strings(column))
        ends = pc.indices_nonzero(pc.not_equal(pc.binary_length(pc.utf8_rtrim(column, MARKS)), pc.binary_length(column)))
        both = pc.extract_regex(column.take(ends), _CLOSED)  # null where it is not a word that stands before the marks
        ends, both = ends.filter(both.is_valid()).to_numpy(), both.drop_null()
        mask = np.zeros(len(column), bool)
        mask[ends] = True
        own = pa.concat_arrays([pc.replace_with_mask(column, pa.array(mask), both.field("word")), both.field("marks")]).dictionary_encode()
        ids = self._ids(strings(own.dictionary))
        known = list(map(ids.__getitem__, own.indices.to_numpy().tolist()))
        for k, marks in zip(ends.tolist(), known[len(column) :], strict=True):
            known[k] += marks
        return known[: len(column)]

    def _ids(self, parts: list[str]) -> list[bytes]:
        """The ids of different parts."""
        if len(self.seen) > self.remember // 2:
            self.seen, self.old = {}, self.seen
        seen, old = self.seen, self.old
        found = list(map(seen.get, parts))
        if None not in found:
            return found
        missed = [p for p, i in zip(parts, found, strict=True) if i is None]
        fresh = {p: old[p] for p in missed if p in old} if old else {}
        new = [p for p in missed if p not in fresh] if fresh else missed
        if new:
            fresh.update(zip(new, self.encode_new(new), strict=True))
        seen.update(fresh if max(map(len, fresh)) <= LONGEST else {p: b for p, b in fresh.items() if len(p) <= LONGEST})
        return [fresh[p] if i is None else i for p, i in zip(parts, found, strict=True)]


def byte_letters() -> dict[int, str]:
    """The visible character by which byte-level vocabularies write each byte."""
    own = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0, 0xAD)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Joined:
    """Encodes many parts at a time as the lines of one text.

    A line feed between parts that hold none is a token of its own, so the ids
    fall apart at it.  Parts with other white space than one leading space, and
    all parts if the line feed has not one id, are encoded one by one.

    Where ``by_model``, words, which the pattern leaves whole, go to the
    tokenizer's model at once, written in the letters of its vocabulary: the
    library then has no pattern to match.  That takes a byte-level tokenizer
    without a normalizer, none of whose added tokens could lie in a word and its marks.
    """

    LINES = 300

    def __init__(self, tokenizer):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = tokenizer
        feed = tokenizer.encode("\n", add_special_tokens=False).ids
        self.feed = feed[0] if len(feed) == 1 else None
        cut, vocabulary, self.letters = tokenizer.pre_tokenizer, tokenizer.get_vocab(with_added_tokens=False), byte_letters()
        plain = isinstance(cut, pre_tokenizers.ByteLevel) and cut.use_regex and not cut.add_prefix_space and tokenizer.normalizer is None and all(c in vocabulary for c in self.letters.values())
        self.by_model = plain and not any(_WORD_OR_MARKS(t.content) for t in tokenizer.get_added_tokens_decoder().values())
        self.bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.bytes[list(vocabulary.values())] = list(map(len, vocabulary))
        self.model, self.letters[10] = Tokenizer(tokenizer.model), "\n"
        self.model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """The ids of words by the model alone; a word ends with the token that brings as many bytes as it and those before it have."""
        raw = [("\n".join(words[at : at + self.LINES]) + "\n").encode() for at in range(0, len(words), self.LINES)]
        coded = self.model.encode_batch_fast([r.decode("latin-1").translate(self.letters) for r in raw], add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, "<u4") for e in coded])
        stops = np.flatnonzero(np.frombuffer(b"".join(raw), np.uint8) == 10)
        ends = np.searchsorted(np.cumsum(self.bytes[ids]), stops - np.arange(len(stops))) * 4 + 4
        all_ids, ends = ids.tobytes(), ends.tolist()
        return [all_ids[i:j] for i, j in zip([0, *ends], ends, strict=False)]

    def __call__(self, parts: list[str]) -> list[bytes]:
        words = list(filter(WORD, parts)) if self.by_model else []
        if parts and len(words) == len(parts):
            return self._words(words)
        out: dict[str, bytes] = dict(zip(words, self._words(words), strict=True)) if words else {}
        left = [p for p in parts if p not in out]
        plain = [p for p in left if p and len(p.split()) == 1 and not p[-1].isspace() and not p[1:2].isspace() and p[0] != "\n" and (p[0] == " " or not p[0].isspace())] if self.feed is not None else []
        lines = [plain[at : at + self.LINES] for at in range(0, len(plain), self.LINES)]
        for own, ids in zip(lines, self._encode(["\n".join(x) for x in lines]), strict=True):
            ends, raw, start = np.flatnonzero(ids == self.feed).tolist(), ids.tobytes(), 0
            for p, end in zip(own, [*ends, len(ids)], strict=True):
                out[p] = raw[4 * start : 4 * end]
                start = end + 1
        rest = [p for p in left if p not in out]
        out.update(zip(rest, (x.tobytes() for x in self._encode(rest)), strict=True))
        return [out[p] for p in parts]


def id_encoder(path: str, remember: int | None = None) -> WordCache:
    """The worker's encoder by the ``tokenizers`` file at ``path``, without added special tokens; it keeps ``remember`` parts (some 200 bytes each)."""

    def build() -> WordCache:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        joined = Joined(Tokenizer.from_file(path))
        return WordCache(joined, remember, closing=joined.by_model)

    return hold(("ids", path, remember), build)
