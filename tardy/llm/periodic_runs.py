"""Runs (maximal periodic stretches) of words, by suffix-tree longest common
extensions.

Every run has a Lyndon root, which is the longest Lyndon word at its first
place in one of the two symbol orders.  The longest Lyndon word at a place ends
before the next smaller suffix, so the suffix ranks of one tree give a
candidate root (place, length) for every place and order.  A candidate is
extended to the right by the longest common extension of the place and the
place one root later, and to the left by that of the reversed text; both are
lowest common ancestors of suffix trees.  What is at least as long as asked is
a run, and its root's length is its least period.

A run of at least ``MIN_LENGTH`` words and ``MIN_REPEATS`` periods holds with
every stretch of ``MIN_LENGTH // 3`` words the same stretch one period on or
back.  Words outside all stretches that occur twice in their document can
therefore be in no run, and cut the document into parts; a part below
``MIN_LENGTH`` words holds none.  The parts of a batch of documents are joined
by symbols of their own, which no run crosses, and share one tree and one
reversed tree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tardy.llm.suffix_tree import SuffixTree
from tardy.llm.text import NON_SPACE, batches, join_bytes, mix, words

_U = np.uint64
MIN_LENGTH, MIN_REPEATS = 24, 3
#: characters of text whose words are searched at once
BATCH_CHARS = 2 << 20
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _next_below(rank: list[int]) -> list[int]:
    """For each place the next one with a smaller rank, or the end."""
    out = [len(rank)] * len(rank)
    stack: list[int] = []
    for i, r in enumerate(rank):
        while stack and rank[stack[-1]] > r:
            out[stack.pop()] = i
        stack.append(i)
    return out


def runs(symbols: np.ndarray, min_length: int = MIN_LENGTH, min_repeats: int = MIN_REPEATS) -> np.ndarray:
    """Rows (start, length, period), sorted, of all runs of at least
    ``min_length`` symbols and ``min_repeats`` >= 3 periods; symbols are >= 0."""
    n = len(symbols)
    if n < max(min_length, min_repeats):
        return np.zeros((0, 3), np.int64)
    text = np.append(symbols, symbols.max() + 1)                    # a last symbol of its own
    tree = SuffixTree(text)
    place = np.arange(n + 1)
    found = []
    for rank in (tree.rank, n - tree.rank):
        size = np.array(_next_below(rank.tolist()), np.int64) - place
        at = np.flatnonzero(place + size <= n)
        at = at[text[at] == text[at + size[at]]]
        right = tree.lce(at, at + size[at])
        whole = right >= (min_repeats - 2) * size[at]               # a run holds its first root and this much after it
        found.append(np.stack((at[whole], size[at][whole], right[whole])))
    at, period, right = np.concatenate(found, axis=1)
    if not len(at):
        return np.zeros((0, 3), np.int64)
    back = SuffixTree(np.append(symbols[::-1], text[-1]))
    left = np.zeros(len(at), np.int64)
    inner = np.flatnonzero(at > 0)
    left[inner] = back.lce(n - at[inner], n - at[inner] - period[inner])
    start, length = at - left, left + period + right
    keep = (length >= min_length) & (length >= min_repeats * period)
    return np.unique(np.stack((start[keep], length[keep], period[keep]), axis=1), axis=0)


def _parts(h: np.ndarray, doc: np.ndarray, min_length: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the parts of documents that can hold a run."""
    gram = min_length // 3
    none = np.zeros(0, np.int64)
    if len(h) < min_length:
        return none, none
    m = len(h) - gram + 1
    key = mix(doc[:m].astype(_U) + _U(1))
    for j in range(gram):
        key = key * _U(0x2545F4914F6CDD1D) + h[j:j + m]
    key = mix(key)[doc[:m] == doc[gram - 1:]]
    owner = np.flatnonzero(doc[:m] == doc[gram - 1:])
    order = np.sort(key)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return none, none
    gate = np.zeros(1 << 16, bool)
    gate[(twice >> _U(48)).astype(np.int64)] = True
    near = np.flatnonzero(gate[(key >> _U(48)).astype(np.int64)])
    hit = owner[near[twice[np.minimum(np.searchsorted(twice, key[near]), len(twice) - 1)] == key[near]]]
    cover = np.zeros(len(h) + 1, np.int64)
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + gram, -1)
    inside = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
    cut = np.flatnonzero((np.diff(inside) > 1) | (np.diff(doc[inside]) > 0)) + 1
    begin, end = inside[np.concatenate(([0], cut))], inside[np.concatenate((cut - 1, [len(inside) - 1]))] + 1
    keep = end - begin >= min_length
    return begin[keep], end[keep]


def document_runs(texts: list[str | None], min_length: int = MIN_LENGTH, min_repeats: int = MIN_REPEATS):
    """(words of each text, rows (text, start, length, period) of all runs)."""
    buf, starts = join_bytes(texts)
    h, doc, _, _ = words(buf, starts, NON_SPACE, lower=False)
    count = np.bincount(doc, minlength=len(texts))
    base = np.concatenate(([0], np.cumsum(count)))
    begin, end = _parts(h, doc, min_length)
    if not len(begin):
        return count, np.zeros((0, 4), np.int64)
    size = end - begin
    offset = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
    step = np.arange(int(size.sum())) - np.repeat(np.concatenate(([0], np.cumsum(size)[:-1])), size)
    names, sym = np.unique(h[np.repeat(begin, size) + step], return_inverse=True)
    joined = np.empty(int((size + 1).sum()), np.int64)
    joined[np.repeat(offset, size) + step] = sym
    joined[offset + size] = len(names) + np.arange(len(size))        # ends of parts
    found = runs(joined, min_length, min_repeats)
    part = np.searchsorted(offset, found[:, 0], "right") - 1
    owner = doc[begin[part]]
    start = found[:, 0] - offset[part] + begin[part] - base[owner]
    out = np.stack((owner, start, found[:, 1], found[:, 2]), axis=1)
    return count, out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def _kept(text: str, found: np.ndarray) -> bytes:
    """Words outside every run's part after its first period, joined by a space."""
    w = (text or "").encode("utf-8", "surrogatepass").split()
    if len(found):
        cover = np.zeros(len(w) + 1, np.int64)
        np.add.at(cover, found[:, 1] + found[:, 3], 1)
        np.add.at(cover, found[:, 1] + found[:, 2], -1)
        w = [w[i] for i in np.flatnonzero(np.cumsum(cover[:-1]) == 0).tolist()]
    return b" ".join(w)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
                  min_repeats: int = MIN_REPEATS, edit: Callable[[list, list], list] | None = None) -> DataFrame:
    """One row per row of ``docs``: ``id_col, n_words, runs, collapsed``.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0.  ``runs`` lists (start,
    length, period) of every maximal stretch with least period ``period`` of at
    least ``min_length`` words and ``min_repeats`` (3 or more) periods, sorted
    by start, then period.  ``collapsed`` is the text's words joined by one
    space without those that lie in a run after its first period.  ``edit``
    maps the (ids, texts) of a batch to the texts that are searched.

    A null or empty text has no words, no runs and an empty collapsed text.
    Whole texts are searched, about two million characters at a time (a longer
    text by itself; memory follows the words of parts that repeat a stretch).
    Repeated rows and ids are documents of their own, null ids stay null, an
    empty table gives an empty result; other columns are not read.
    """
    if min_repeats < 3 or min_length < 3:
        raise ValueError("runs take three periods and three words at least")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = batch.column(1).to_pylist()
            if edit:
                texts = edit(batch.column(0).to_pylist(), texts)
            for lo, hi in batches(texts, BATCH_CHARS):
                count, found = document_runs(texts[lo:hi], min_length, min_repeats)
                cut = np.searchsorted(found[:, 0], np.arange(hi - lo + 1))
                kept = [_kept(t, found[cut[i]:cut[i + 1]]) for i, t in enumerate(texts[lo:hi])]
                rows = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(found[:, k])) for k in (1, 2, 3)], fields=list(RUN))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(count.astype(np.int64)),
                     pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), rows), pa.array(kept, pa.string())],
                    names=["_id", "n_words", "runs", "collapsed"])

    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    out = src.mapInArrow(run, "_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return out.withColumnRenamed("_id", id_col)
