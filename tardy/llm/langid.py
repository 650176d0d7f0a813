"""Language identification with bit-sliced Bloom filters of n-grams.

One table of slots serves all languages: every slot is a bit mask with one bit
for each language, so a lookup of an n-gram (the AND of the masks at its hash
positions) returns all languages whose filter holds it at once.  A text counts
for each language how many of its n-grams the filter holds; from that count
the hits that chance alone would give at the filter's fill rate are taken off.
The language with the largest corrected count wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tardy.llm.text import batches, join_bytes, mix

_U = np.uint64
_IS_LETTER = np.zeros(256, bool)
_IS_LETTER[97:123] = _IS_LETTER[128:] = True

_BITS = (np.arange(256)[:, None] >> np.arange(8)) & 1

UNKNOWN = "und"
ORDERS = (2, 3, 4)


def ngrams(texts: list[str | None], orders: tuple[int, ...] = ORDERS):
    """Yields, for each order, (n-gram key, text index) over the bytes of the
    lower-cased texts; every stretch of other characters reads as one space."""
    buf, starts = join_bytes([(t or "").lower() for t in texts])
    letter = _IS_LETTER[buf]
    first = np.zeros(len(buf), bool)
    first[starts[:-1]] = True
    keep = letter.copy()
    keep[1:] |= letter[:-1] & ~first[1:]          # the first other byte after a letter stays as a space
    at = np.flatnonzero(keep)
    doc = np.searchsorted(starts, at, "right") - 1
    b = np.where(letter[at], buf[at], 32).astype(_U)
    key = b.copy()
    for n in range(2, max(orders) + 1):
        if len(b) < n:
            return
        key = key[:-1] | (b[n - 1:] << _U(8 * (n - 1)))
        if n in orders:
            whole = doc[:len(key)] == doc[n - 1:]
            yield n, key[whole] | _U(n << 56), doc[:len(key)][whole]


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


@dataclass
class NgramFilters:
    """Bloom filters of all languages: ``slots`` (n_slots x words of 64
    languages), ``fill`` the share of slots with each language's bit."""

    languages: list[str]
    slots: np.ndarray
    hashes: int

    @property
    def fill(self) -> np.ndarray:
        return np.array([((self.slots[:, i // 64] >> _U(i % 64)) & _U(1)).mean() for i in range(len(self.languages))])

    @classmethod
    def build(cls, grams: dict[str, np.ndarray], hashes: int = 2, bits_per_gram: int = 16) -> NgramFilters:
        """Filters of the given n-gram keys, sized by the largest language."""
        languages = sorted(grams)
        most = max((len(g) for g in grams.values()), default=1)
        size = 1 << max(10, int(most * bits_per_gram - 1).bit_length())
        out = cls(languages, np.zeros((size, max(1, -(-len(languages) // 64))), _U), hashes)
        for i, lang in enumerate(languages):
            for at in out._positions(grams[lang]):
                out.slots[at, i // 64] |= _U(1 << i % 64)
        return out

    def _positions(self, keys: np.ndarray) -> Iterator[np.ndarray]:
        h = mix(keys)
        step = (h >> _U(32)) | _U(1)
        for k in range(self.hashes):
            yield ((h + _U(k) * step) & _U(len(self.slots) - 1)).astype(np.int64)

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """Mask words (n x words) of the languages that hold each n-gram."""
        out = None
        for at in self._positions(keys):
            out = self.slots[at] if out is None else out & self.slots[at]
        return out

    def counts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(n-grams of each text, popcounts of each text and language)."""
        total = np.zeros(len(texts), np.int64)
        hit = np.zeros((len(texts), len(self.languages)), np.int64)
        for _, key, doc in ngrams(texts):
            total += np.bincount(doc, minlength=len(texts))
            masks = self.lookup(key)
            for lo in range(0, len(self.languages), 8):           # popcounts of eight languages at once
                byte = ((masks[:, lo // 64] >> _U(lo % 64)) & _U(255)).astype(np.int64)
                table = np.bincount((doc << 8) | byte, minlength=len(texts) << 8).reshape(-1, 256)
                hit[:, lo:lo + 8] += table @ _BITS[:, :len(self.languages) - lo]
        return total, hit

    def predict(self, texts: list[str | None], known: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score: the winner's corrected count over all n-grams'."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        total, hit = self.counts(texts)
        chance = self.fill ** self.hashes
        real = np.maximum(hit - total[:, None] * chance, 0) / np.maximum(1 - chance, 1e-9)
        best = real.argmax(axis=1)
        score = np.clip(real[np.arange(len(texts)), best] / np.maximum(total, 1), 0, 1)
        return ([self.languages[b] if k else UNKNOWN for b, k in zip(best, known)], np.where(known, score, 0.0))


def _count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lo, hi in batches(texts):
            names, lang = np.unique(np.array(langs[lo:hi], object), return_inverse=True)
            for n, key, doc in ngrams(texts[lo:hi]):
                for i, name in enumerate(names):
                    k, c = np.unique(key[lang[doc] == i], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(k), pa.string()), pa.array(np.full(len(k), n, np.int32)),
                                                      pa.array(k.view(np.int64)), pa.array(c.astype(np.int64))], ["lang", "n", "gram", "c"])


def fit_filters(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", per_language: int = 3000,
                min_rate: float = 2e-5, min_ratio: float = 0.2) -> NgramFilters:
    """Filters learnt from labelled texts.

    Fit on a bounded sample: about ``per_language`` rows of each language
    (chosen by a hash of the text).  A language's filter holds the n-grams that
    make up at least ``min_rate`` of its n-grams of that order and at least
    ``min_ratio`` of the rate of the language where they are most frequent
    (so passages quoted from other languages leave no trace).  No more than
    1 / ``min_rate`` n-grams of an order and language can pass, which bounds
    what the driver receives.  Rows without language or text teach nothing.
    """
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.lit(0.0)
    for lang, n in sorted(sizes.items()):
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, per_language / n))).otherwise(share)
    sample = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < share * (1 << 20))
    counted = sample.mapInArrow(_count, "lang string, n int, gram long, c long").groupBy("lang", "n", "gram").agg(F.sum("c").alias("c"))
    totals = counted.groupBy(F.col("lang").alias("l2"), F.col("n").alias("n2")).agg(F.sum("c").alias("total"))
    rated = counted.join(F.broadcast(totals), (F.col("lang") == F.col("l2")) & (F.col("n") == F.col("n2"))).select(
        "lang", "gram", (F.col("c") / F.col("total")).alias("rate"))
    rated = rated.where(F.col("rate") >= min_rate)
    got = rated.toPandas()
    top = got.groupby("gram")["rate"].transform("max")
    got = got[got["rate"] >= min_ratio * top]
    return NgramFilters.build({lang: g["gram"].to_numpy(np.int64).view(_U) for lang, g in got.groupby("lang")})


def predict_language(docs: DataFrame, filters: NgramFilters, text_col: str = "text",
                     lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """``docs`` with the predicted language and a score from 0 to 1.

    A null text or one without any letter gives ``und`` with score 0, as does
    an empty model.  Equal counts go to the language first in alphabetical
    order.  Whole texts are read, in pieces of bounded size.  Columns named
    like the two outputs are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(filters)
    keep = [c for c in docs.columns if c not in (lang_out, score_out)]
    inner = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.col(f"`{text_col}`").cast("string").alias("_text"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in it:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            names, scores = [], []
            for lo, hi in batches(texts):
                known = np.array([has_letter(t) for t in texts[lo:hi]], bool)
                p, s = model.predict(texts[lo:hi], known)
                names += p
                scores.append(s)
            out = batch.columns[:-1] + [pa.array(names, pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64())]
            yield pa.RecordBatch.from_arrays(out, names=[f"c{i}" for i in range(len(keep))] + ["_lang", "_score"])

    schema = ", ".join([f"c{i} {t}" for i, (_, t) in enumerate(docs.select(*[F.col(f"`{c}`") for c in keep]).dtypes)] + ["_lang string", "_score double"])
    return inner.mapInArrow(run, schema).toDF(*keep, lang_out, score_out)


def held_out(id_col: str, folds: int, fold: int):
    """Whether crc32 of the id as text falls into the held-out fold (false for a null id)."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def train_language(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text") -> NgramFilters:
    """Filters from the rows whose crc32(id) mod 4 is not 2; rows without id teach nothing."""
    return fit_filters(docs.where(F.col(id_col).isNotNull() & ~held_out(id_col, 4, 2)), lang_col, text_col)
