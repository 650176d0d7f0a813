"""Vectorised tokenisation of batches of texts.

Texts are handled as UTF-8 bytes in numpy arrays, so a batch of documents is
tokenised, hashed and windowed without a Python loop over words.  A word is
identified by a 64-bit hash of its (ASCII lower-cased) bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_U = np.uint64
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 5      # odd multiplier of the rolling hash
_BLOCK = 1 << 20                    # positions whose powers are tabulated


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser: a bijection that spreads 64-bit values."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, _U)
    out[0] = 1
    k = 1
    step = base
    while k < n:                    # doubling: out[k:2k] = out[:k] * base**k
        m = min(k, n - k)
        out[k:k + m] = out[:m] * _U(step)
        step = step * step & _MASK
        k += m
    return out


_POW = _powers(_BASE, _BLOCK + 1)
_INV = _powers(pow(_BASE, -1, 1 << 64), _BLOCK + 1)
_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: byte tables of what belongs to a word; bytes over 0x7F always do
NON_SPACE = np.ones(256, bool)
NON_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


def batches(texts: list[str | None], budget: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Index ranges of texts with about ``budget`` characters each."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= budget:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def join_bytes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one byte array with a space after each, and the start of
    each text in it (one more entry closes the last).  Null reads as empty;
    a lone surrogate keeps its three bytes."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    starts = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(b) + 1 for b in raw], out=starts[1:])
    buf = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    return buf, starts


def range_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of ``buf[start:end]`` for sorted ranges, from prefix sums of
    a rolling hash; ranges may be of any length."""
    out = np.zeros(len(start), _U)
    n = len(buf)
    for lo in range(0, max(n, 1), _BLOCK):
        hi = min(lo + _BLOCK, n)
        # ranges that overlap this block
        a, b = np.searchsorted(end, lo, "right"), np.searchsorted(start, hi, "left")
        if a >= b:
            continue
        pre = np.zeros(hi - lo + 1, _U)
        np.cumsum(_BYTE[buf[lo:hi]] * _POW[:hi - lo], out=pre[1:])
        s, e = start[a:b], end[a:b]
        s0, e0 = np.maximum(s, lo) - lo, np.minimum(e, hi) - lo
        part = (pre[e0] - pre[s0]) * _INV[s0]
        if b > a:                    # at most the first range began in an earlier block
            done = np.maximum(lo - s, 0)
            far = done > 0
            if far.any():
                part[far] *= np.array([pow(_BASE, int(d), 1 << 64) for d in done[far]], _U)
        out[a:b] += part
    return mix(out + (end - start).astype(_U) * _U(0xD6E8FEB86659FD93))


def words(buf: np.ndarray, starts: np.ndarray, table: np.ndarray, lower: bool = True):
    """Words of the joined texts: (hash, text index, byte start, byte end).
    ``table`` says which bytes belong to words."""
    inside = np.empty(len(buf) + 2, np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = table[buf]
    inside[starts[1:]] = 0          # the separators (shifted by one) end words in any case
    edge = np.diff(inside)
    s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    h = range_hashes(LOWER[buf] if lower else buf, s, e)
    return h, np.searchsorted(starts, s, "right") - 1, s, e


def shingles(h: np.ndarray, doc: np.ndarray, n_docs: int, k: int):
    """Distinct k-word shingles of each text: (hash sorted within the text,
    text index).  A text with fewer words, but not none, has its whole
    sequence as its one shingle."""
    count = np.bincount(doc, minlength=n_docs)
    first = np.concatenate(([0], np.cumsum(count)[:-1]))
    parts_h, parts_d = [], []
    if len(h) >= k:
        full = np.flatnonzero(doc[:len(h) - k + 1] == doc[k - 1:])
        v = np.zeros(len(full), _U)
        for j in range(k):
            v = mix(v * _U(0x2545F4914F6CDD1D) + h[full + j] + _U(j + 1))
        parts_h.append(v)
        parts_d.append(doc[full])
    for d in np.flatnonzero((count > 0) & (count < k)):
        v = np.zeros(1, _U)
        for j in range(count[d]):
            v = mix(v * _U(0x2545F4914F6CDD1D) + h[first[d] + j:first[d] + j + 1] + _U(j + 1))
        parts_h.append(mix(v + _U(count[d])))
        parts_d.append(np.array([d]))
    if not parts_h:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    v, d = np.concatenate(parts_h), np.concatenate(parts_d)
    if len(parts_d) > 1:
        order = np.argsort(d, kind="stable")
        v, d = v[order], d[order]
    cut = np.flatnonzero(np.diff(d)) + 1
    for a, b in zip(np.concatenate(([0], cut)), np.concatenate((cut, [len(d)]))):
        v[a:b].sort()
    keep = np.ones(len(v), bool)
    keep[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
    return v[keep], d[keep]


def sequence_keys(h: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Two 64-bit hashes of each text's whole word sequence (shape n_docs x 2);
    texts with equal word sequences have equal keys."""
    out = np.zeros((n_docs, 2), _U)
    count = np.bincount(doc, minlength=n_docs)
    pos = np.arange(len(h)) - np.repeat(np.concatenate(([0], np.cumsum(count)[:-1])), count)
    for c, salt in enumerate((0x5851F42D4C957F2D, 0x14057B7EF767814F)):
        v = mix(h ^ mix(pos.astype(_U) * _U(salt) + _U(salt)))
        full = np.concatenate((np.zeros(1, _U), np.cumsum(v, dtype=_U)))
        end = np.cumsum(count)
        out[:, c] = mix(full[end] - full[end - count] + count.astype(_U))
    return out
