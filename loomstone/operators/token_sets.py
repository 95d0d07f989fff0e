"""Token sets as sorted 64-bit hashes, and the keys by which similar ones meet. NumPy over Arrow batches.

A token of up to 64 bytes is hashed by its words of 8 bytes (up to 8 bytes: one
to one), a longer one by blake2b.  A set is named by the sum of its tokens'
mixed hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np

LONG = 64
STRETCH = 1 << 18  # bytes of text at once
AHEAD = 3  # parts behind a part that its sketch covers

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

#: What stands for a set in one part: key of the part, sketch of the parts behind it, the set, key of the part before, size, bits (1: in the bucket of its own class of sizes; 2, 4, ...: fields)
MEET = np.dtype([("key", "<u4"), ("sketch", "<u4"), ("s", "<i8"), ("before", "<u8"), ("n", "<u4"), ("bits", "<u1")])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits (the finaliser of splitmix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def distinct(h: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ends): of each row, in order, the different hashes, sorted. ``row`` ascends."""
    at = np.searchsorted(row, np.arange(rows + 1))
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a > 1:
            h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], np.concatenate([[0], np.cumsum(new)])[at]


def hashes(texts) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every token of an Arrow array of lower-case strings."""
    import pyarrow as pa

    texts = texts.cast(pa.large_string()).fill_null("")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    found, rows, p = [], [], 0
    while p < len(data):
        q = min(p + STRETCH, len(data))
        while q < len(data) and _WORD[data[q]]:  # up to the end of a token
            inside = _WORD[data[q : q + 4096]]
            q += len(inside) if inside.all() else int(inside.argmin())
        text = np.zeros(q - p + 8, np.uint8)
        text[:-8] = data[p:q]
        word = _WORD.take(text)
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        cut = ends[np.searchsorted(ends, p) : np.searchsorted(ends, q)] - p  # a row begins a token of its own
        first[cut] = word[cut]
        last[cut[cut > 0] - 1] = word[cut[cut > 0] - 1]
        start = np.flatnonzero(first)
        if len(start):
            length = np.flatnonzero(last) + 1 - start
            eight = np.ndarray(q - p + 1, "<u8", text, strides=(1,))
            h = mix(eight[start] & _MASK[np.minimum(length, 8)])
            more = np.flatnonzero(length > 8)
            done = 8
            while len(more) and done < LONG:
                h[more] = mix(h[more] ^ mix(eight[start[more] + done] & _MASK[np.minimum(length[more] - done, 8)]))
                done += 8
                more = more[length[more] > done]
            for i in more.tolist():
                a = int(start[i])
                h[i] = int.from_bytes(hashlib.blake2b(text[a : a + int(length[i])].tobytes(), digest_size=8).digest(), "little")
            found.append(h)
            rows.append(np.searchsorted(ends, p + start, "right") - 1)
        p = q
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(found), np.concatenate(rows)


def field_sets(columns: list, fields: list[tuple[int, ...]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(hashes, ends) for each field, which joins columns; a row where one of them is null has the empty set."""
    rows = len(columns[0])
    each = []
    for c in columns:
        h, row = hashes(c)
        each.append(distinct(h, row, rows))
    out = []
    for parts in fields:
        if len(parts) == 1:
            out.append(each[parts[0]])
            continue
        null = np.zeros(rows, bool)
        for k in parts:
            null |= columns[k].is_null().to_numpy(zero_copy_only=False)
        h = np.concatenate([each[k][0] for k in parts])
        row = np.concatenate([np.repeat(np.arange(rows), np.diff(each[k][1])) for k in parts])
        h, row = h[~null[row]], row[~null[row]]
        order = np.argsort(row.astype(np.int16) if rows < 1 << 15 else row, kind="stable")
        out.append(distinct(h[order], row[order], rows))
    return out


def sums(x: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The sum of each row; 0 for an empty one."""
    out = np.zeros(len(ends) - 1, x.dtype)
    some = np.flatnonzero(np.diff(ends))
    if len(some):
        out[some] = np.add.reduceat(x, ends[:-1][some])
    return out


def names(h: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return sums(mix(h), ends).view(np.int64)


class Sizes:
    """Classes of sizes: similar sets are in the same one or in neighbouring ones; and how many parts a set has in each.

    Where the smaller of two similar sets is in class ``k``, they differ in less
    than ``parts[k]`` tokens, so that they are equal in one part at least.
    """

    def __init__(self, percent: int, largest: int) -> None:
        self.low, self.parts = [1], []
        while self.low[-1] <= max(largest, 1):
            high = self.low[-1] * 100 // percent
            small = max(high, self.low[-1])
            self.low.append(small + 1)
            self.parts.append((100 - percent) * (small + small * 100 // percent) // (100 + percent) + 1)
        self.low, self.parts = np.array(self.low), np.array(self.parts)

    def of(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, n, "right") - 1


def meetings(h: np.ndarray, ends: np.ndarray, s: np.ndarray, bits: np.ndarray, sizes: Sizes) -> tuple[np.ndarray, np.ndarray]:
    """(upper half of the key, the rest as MEET) of each set's keys: in the bucket of its class of sizes and in that of the next smaller one.

    Parts are ranges of hashes. If sets of P parts differ in less than P tokens,
    then from one of the parts on, that part is equal, it and the next differ in
    one token at most, it and the next two in two, and so on around; and unless
    all parts are equal, the one before can be taken to differ.
    """
    n = np.diff(ends)
    k = sizes.of(n)
    out = []
    for down in (0, 1):
        rows = np.flatnonzero((k >= down) & (n > 0))
        rows = rows[sizes.parts[k[rows] - down] > 1]  # sets that differ in nothing are one
        if not len(rows):
            continue
        bucket, m = k[rows] - down, n[rows]
        parts = sizes.parts[bucket]
        base = np.concatenate([[0], np.cumsum(parts)])
        mine = np.repeat(np.arange(len(rows)), m)
        x = h[np.repeat(ends[:-1][rows] - np.concatenate([[0], np.cumsum(m)[:-1]]), m) + np.arange(m.sum())]
        part = base[:-1][mine] + (((x >> np.uint64(32)) * parts[mine].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        inner = np.searchsorted(part, np.arange(base[-1] + 1))
        which = np.repeat(np.arange(len(rows)), parts)
        at = np.arange(base[-1]) - base[:-1][which]
        key = mix(mix(sums(mix(x), inner) + at.astype(np.uint64)) + bucket.astype(np.uint64)[which])
        seen = np.zeros(base[-1], np.uint32)
        some = np.flatnonzero(np.diff(inner))
        seen[some] = np.bitwise_xor.reduceat(np.uint32(1) << (x & np.uint64(31)).astype(np.uint32), inner[:-1][some])
        p = parts[which]
        sketch = np.zeros(base[-1], np.uint32)
        for step in range(1, AHEAD + 1):
            sketch ^= np.where(step < p, seen[base[:-1][which] + (at + step) % p], np.uint32(0))
        got = np.empty(base[-1], MEET)
        got["key"], got["s"], got["sketch"], got["before"] = key & np.uint64(0xFFFFFFFF), s[rows][which], sketch, key[base[:-1][which] + (at - 1) % p]
        got["n"], got["bits"] = m[which], (bits[rows][which] << 1) | (1 - down)
        out.append(((key >> np.uint64(32)).astype(np.int64), got))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, MEET)
    return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])


def met(x: np.ndarray, percent: int, block: int = 1 << 20):
    """(a, b, home) in pieces: pairs of sets that may be similar; ``home`` is the smallest set with the key at which they met."""
    x = x[np.argsort(x["key"])]
    same = x["key"][1:] == x["key"][:-1]
    x = x[np.concatenate([same, [False]]) | np.concatenate([[False], same])] if len(x) else x
    x = x[np.lexsort((x["before"], x["s"], x["key"]))]
    if not len(x):
        return
    fresh = np.flatnonzero(np.concatenate([[True], (x["key"][1:] != x["key"][:-1]) | (x["s"][1:] != x["s"][:-1]) | (x["before"][1:] != x["before"][:-1])]))
    bits = np.bitwise_or.reduceat(x["bits"], fresh)  # copies may have come with other fields
    key, s, sketch, before, n = (x[c][fresh] for c in ("key", "s", "sketch", "before", "n"))
    n = n.astype(np.int64)
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(start, append=len(key))
    home = np.repeat(s[start], size)
    later = np.repeat(start + size, size) - np.arange(len(key)) - 1  # partners of each
    upto = np.cumsum(later)
    i = 0
    while i < len(key):
        done = upto[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(upto, done + block, "right")))
        a = np.repeat(np.arange(i, j), later[i:j])
        b = a + 1 + np.arange(len(a)) - np.repeat(upto[i:j] - later[i:j] - done, later[i:j])
        for ok in (  # what settles most comes first
            lambda: np.bitwise_count(sketch[a] ^ sketch[b]) <= AHEAD,
            lambda: (before[a] != before[b]) & (s[a] != s[b]),
            lambda: (np.minimum(n[a], n[b]) * 100 >= np.maximum(n[a], n[b]) * percent) & ((bits[a] & bits[b]) > 1) & (((bits[a] | bits[b]) & 1) > 0),
        ):
            good = ok()
            a, b = a[good], b[good]
        if len(a):
            yield s[a], s[b], home[a]
        i = j


def overlaps(a: np.ndarray, b: np.ndarray, sets: dict[int, np.ndarray]):
    """(a, b, tokens of both): for pairs of sets, by ``a``."""
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    start = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else a
    out = np.zeros(len(a), np.int64)
    for i, j in zip(start.tolist(), [*start[1:].tolist(), len(a)]):
        left = sets[int(a[i])]
        for k in range(i, j, 1000):
            others = [sets[x] for x in b[k : min(k + 1000, j)].tolist()]
            right = np.concatenate(others)
            hit = left[np.minimum(np.searchsorted(left, right), len(left) - 1)] == right
            out[k : k + len(others)] = np.add.reduceat(hit, np.cumsum([0, *map(len, others[:-1])]), dtype=np.int64)
    return a, b, out
