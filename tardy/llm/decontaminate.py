"""Benchmark decontamination with an FM-index per shard of training documents.

A shard is a run of documents of about eight million characters inside one
task.  Its words are mapped to the symbols of the phrases' vocabulary; a word
outside that vocabulary cannot be part of an occurrence, so it becomes a
boundary, and stretches between boundaries that are shorter than the shortest
phrase are left out.  What remains is indexed (suffix array, wavelet matrix,
sampled positions); every phrase is looked up by backward search, its
occurrences are located, and the words they cover merge into removal spans.

The phrases are the query set.  They go to the executors in blocks of a stated
size, and each shard is searched block by block, so memory does not follow the
number of benchmark items.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tardy.llm.fm_index import FMIndex
from tardy.llm.text import ALNUM, batches, join_bytes, words

_U = np.uint64
#: characters of benchmark text in one block of phrases
BLOCK_CHARS = 8 << 20


class Phrases:
    """Distinct windows of a block of items, as symbols 1.. of a vocabulary of
    word hashes, grouped by length; each window knows its items."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        buf, starts = join_bytes([t for _, t in items])
        h, owner, _, _ = words(buf, starts, ALNUM)
        self.names = [None if i is None else str(i) for i, _ in items]
        self.vocab, sym = np.unique(h, return_inverse=True)
        self.gate = np.zeros(1 << 16, bool)
        self.gate[(self.vocab >> _U(48)).astype(np.int64)] = True
        sym = sym + 1
        cut = np.searchsorted(owner, np.arange(len(items) + 1))
        rows: dict[int, list[np.ndarray]] = {}
        owners: dict[int, list[np.ndarray]] = {}
        for i in range(len(items)):
            s = sym[cut[i]:cut[i + 1]]
            if len(s):
                w = min(window, len(s))
                rows.setdefault(w, []).append(np.lib.stride_tricks.sliding_window_view(s, w))
                owners.setdefault(w, []).append(np.full(len(s) - w + 1, i))
        self.groups = []
        for w in sorted(rows):
            distinct, which = np.unique(np.concatenate(rows[w]), axis=0, return_inverse=True)
            order = np.argsort(which.ravel(), kind="stable")
            item = np.concatenate(owners[w])[order]
            self.groups.append((w, distinct, np.searchsorted(which.ravel()[order], np.arange(len(distinct) + 1)), item))
        self.shortest = min(rows, default=0)

    def symbols(self, h: np.ndarray) -> np.ndarray:
        """Symbol of each word hash, 0 outside the vocabulary."""
        out = np.zeros(len(h), np.int64)
        at = np.flatnonzero(self.gate[(h >> _U(48)).astype(np.int64)])
        if len(at):
            k = np.minimum(np.searchsorted(self.vocab, h[at]), len(self.vocab) - 1)
            out[at] = np.where(self.vocab[k] == h[at], k + 1, 0)
        return out

    def occurrences(self, h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word position, length, item) of every occurrence of a window within
        one document; ``h``, ``doc`` hold the words of a shard."""
        none = np.zeros(0, np.int64)
        if not self.groups or not len(h):
            return none, none, none
        sym = self.symbols(h)
        # maximal stretches of vocabulary words inside a document
        new = np.ones(len(sym), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (sym[1:] == 0) | (sym[:-1] == 0)
        begin = np.flatnonzero(new)
        length = np.diff(np.concatenate((begin, [len(sym)])))
        keep = (sym[begin] > 0) & (length >= self.shortest)
        begin, length = begin[keep], length[keep]
        if not len(begin):
            return none, none, none
        total = int((length + 1).sum())
        offset = np.concatenate(([0], np.cumsum(length + 1)[:-1]))
        place = np.arange(int(length.sum())) - np.repeat(np.concatenate(([0], np.cumsum(length)[:-1])), length)
        source, target = np.repeat(begin, length) + place, np.repeat(offset, length) + place
        text, origin = np.zeros(total, np.int64), np.zeros(total, np.int64)
        text[target], origin[target] = sym[source], source
        index = FMIndex(text, len(self.vocab) + 1)
        pos, size, item = [], [], []
        for w, patterns, cut, owner in self.groups:
            lo, hi = index.search(patterns)
            hit = np.flatnonzero(hi > lo)
            if not len(hit):
                continue
            n = (hi - lo)[hit]
            step = np.arange(int(n.sum())) - np.repeat(np.concatenate(([0], np.cumsum(n)[:-1])), n)
            at = origin[index.locate(np.repeat(lo[hit], n) + step)]
            pattern = np.repeat(hit, n)
            items = (cut[1:] - cut[:-1])[pattern]
            inner = np.arange(int(items.sum())) - np.repeat(np.concatenate(([0], np.cumsum(items)[:-1])), items)
            pos.append(np.repeat(at, items))
            item.append(owner[np.repeat(cut[:-1][pattern], items) + inner])
            size.append(np.full(int(items.sum()), w))
        if not pos:
            return none, none, none
        return np.concatenate(pos), np.concatenate(size), np.concatenate(item)


def _scan(texts: list[str | None], blocks) -> tuple:
    """Words of a shard and what of them the phrases cover: joined bytes, word
    starts and ends, document of each word, hit mask, items of each document."""
    buf, starts = join_bytes(texts)
    h, doc, s, e = words(buf, starts, ALNUM)
    cover = np.zeros(len(h) + 1, np.int64)
    items: list[set] = [set() for _ in texts]
    for block in blocks:
        phrases = block.value
        pos, size, item = phrases.occurrences(h, doc)
        np.add.at(cover, pos, 1)
        np.add.at(cover, pos + size, -1)
        found = np.unique(np.stack((doc[pos], item)), axis=1) if len(pos) else np.zeros((2, 0), np.int64)
        for d, i in found.T.tolist():
            items[d].add(phrases.names[i])
        if len(blocks) > 1:
            block.__dict__.pop("_value", None)       # only one block is held at a time
    return buf, starts, s, e, doc, np.cumsum(cover[:-1]) > 0, items


def _runs(hit: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last word of each maximal stretch of hit words in a document."""
    at = np.flatnonzero(hit)
    if not len(at):
        return at, at
    split = np.flatnonzero((np.diff(at) > 1) | (np.diff(doc[at]) > 0)) + 1
    return at[np.concatenate(([0], split))], at[np.concatenate((split - 1, [len(at) - 1]))]


_REPORT = "_id long, n_words long, n_hit long, items array<string>, spans array<struct<first:long,last:long>>"


def _report(blocks):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
                            ("spans", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))])
        for batch in it:
            texts = batch.column(1).to_pylist()
            for lo, hi in batches(texts):
                n = hi - lo
                _, _, _, _, doc, hit, items = _scan(texts[lo:hi], blocks)
                base = np.searchsorted(doc, np.arange(n))
                spans: list[list[dict]] = [[] for _ in range(n)]
                for a, b in zip(*_runs(hit, doc)):
                    spans[doc[a]].append({"first": int(a - base[doc[a]]), "last": int(b - base[doc[a]])})
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, n), pa.array(np.bincount(doc, minlength=n).astype(np.int64)),
                     pa.array(np.bincount(doc[hit], minlength=n).astype(np.int64)),
                     pa.array([sorted(x - {None}) for x in items], pa.list_(pa.string())), pa.array(spans, schema.field("spans").type)], schema=schema)
    return run


def _cleaned(blocks):
    def clean(texts: list[str | None]) -> list[str | None]:
        out = list(texts)
        todo = list(range(len(texts)))
        while todo:                                  # a cut may bring the parts of a phrase together
            again = []
            part = [out[i] for i in todo]
            for lo, hi in batches(part):
                buf, starts, s, e, doc, hit, _ = _scan(part[lo:hi], blocks)
                cuts: dict[int, list] = {}
                for a, b in zip(*_runs(hit, doc)):
                    cuts.setdefault(int(doc[a]), []).append((int(s[a]), int(e[b])))
                for d, spans in cuts.items():
                    kept, at = [], int(starts[d])
                    for a, b in spans:
                        kept.append(buf[at:a].tobytes())
                        at = b
                    kept.append(buf[at:int(starts[d + 1]) - 1].tobytes())
                    out[todo[lo + d]] = b"".join(kept).decode("utf-8", "surrogatepass")
                    again.append(todo[lo + d])
            todo = again
        return out

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            at = batch.schema.get_field_index("_text")
            col = pa.array(clean(batch.column(at).to_pylist()), batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([col if i == at else c for i, c in enumerate(batch.columns)], schema=batch.schema)
    return run


def phrase_blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> list:
    """The phrases as broadcasts, one for each block of about ``BLOCK_CHARS``
    characters; the driver holds one block at a time."""
    sc = benchmark.sparkSession.sparkContext
    rows = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t"))
    chars = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    n = int(-(-chars // BLOCK_CHARS)) or 1
    return [sc.broadcast(Phrases([(r["i"], r["t"]) for r in
                                  rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).collect()], window)) for k in range(n)]


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text", window: int = 10) -> DataFrame:
    """One row per row of ``docs``: ``id_col, n_words, n_hit, items, spans``.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the ASCII-lower-cased
    text.  A phrase is ``window`` consecutive words of an item, or a whole item
    of fewer.  ``n_hit`` counts the document's words inside any occurrence,
    ``items`` lists the ids of items with an occurrence (sorted, distinct) and
    ``spans`` the merged stretches of hit words (first and last word index).

    A null or empty text has no words and no hits.  Items without words match
    nothing; an item with a null id hits but is not listed; items that share an
    id are listed once.  Empty tables are fine.  Other columns are not read.
    """
    blocks = phrase_blocks(benchmark, item_col, item_text, window)
    src = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return src.mapInArrow(_report(blocks), _REPORT).withColumnRenamed("_id", id_col)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                  item_text: str = "text", window: int = 10) -> DataFrame:
    """``docs`` with the merged spans of all phrase occurrences cut out of
    ``text_col``, from the first byte of a span's first word to the last byte
    of its last, repeated until no occurrence is left.  Other columns and the
    number of rows stay; null texts stay null."""
    blocks = phrase_blocks(benchmark, item_col, item_text, window)
    names = docs.columns
    inner = docs.select(*[F.col(f"`{c}`").alias("_text" if c == text_col else f"c{i}") for i, c in enumerate(names)])
    return inner.mapInArrow(_cleaned(blocks), inner.schema).toDF(*names)
