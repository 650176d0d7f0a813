"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of a fixed number of words.  Every passage is
encoded on its own: a histogram of hashed byte pairs and a few shares (symbols,
capitals, digits, repeated and distinct words), through one learnt layer.
Gated attention, learnt from document labels alone, weighs the passages; the
weighted sum is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tardy.llm.text import ALNUM, NON_SPACE, batches, join_bytes, mix, words

_U = np.uint64
PASSAGE_WORDS = 64
BUCKETS = 64
STATS = 9
FEATURES = BUCKETS + STATS

_PAIR = (mix(np.arange(1 << 16, dtype=_U)) & _U(BUCKETS - 1)).astype(np.int64)
_SYMBOL = ~ALNUM
_SYMBOL[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def passages(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(features, text index) of all passages; a text without words is one
    passage of zeros, so every text has a bag."""
    buf, starts = join_bytes(texts)
    h, doc, s, e = words(buf, starts, NON_SPACE)
    count = np.bincount(doc, minlength=len(texts))
    n_pass = np.maximum(1, -(-count // PASSAGE_WORDS))
    base = np.concatenate(([0], np.cumsum(n_pass)[:-1]))
    total = int(n_pass.sum())
    owner = np.repeat(np.arange(len(texts)), n_pass)
    out = np.zeros((total, FEATURES), np.float32)
    if not len(h):
        return out, owner
    place = np.arange(len(h)) - np.repeat(np.concatenate(([0], np.cumsum(count)[:-1])), count)
    wp = base[doc] + place // PASSAGE_WORDS                       # passage of each word
    n = np.maximum(np.bincount(wp, minlength=total), 1)
    # passage of each byte inside a word
    inside = np.repeat(np.arange(len(h)), e - s)
    offset = np.arange(len(inside)) - np.repeat(np.concatenate(([0], np.cumsum(e - s)[:-1])), e - s)
    at = s[inside] + offset
    bp = wp[inside]
    b = buf[at]
    size = np.maximum(np.bincount(bp, minlength=total), 1)
    pair = _PAIR[(b.astype(np.int64) << 8) | buf[at + 1]]         # the byte after a word is its separator
    hist = np.bincount(bp * BUCKETS + pair, minlength=total * BUCKETS).reshape(total, BUCKETS)
    out[:, :BUCKETS] = np.sqrt(hist / size[:, None])

    def share(mask, per, weight):
        return np.bincount(per[mask], minlength=total) / weight

    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (wp[1:] == wp[:-1])
    ordered = np.lexsort((h, wp))                                 # distinct words of each passage
    new = np.ones(len(h), bool)
    new[1:] = (h[ordered][1:] != h[ordered][:-1]) | (wp[ordered][1:] != wp[ordered][:-1])
    tail = _SYMBOL[buf[e - 1]]
    alone = (e - s == 1) & tail
    k = BUCKETS
    for col, value in enumerate((share(_SYMBOL[b], bp, size), share(_UPPER[b], bp, size), share(_DIGIT[b], bp, size),
                                 share(b >= 128, bp, size), share(same, wp, n), share(new, wp[ordered], n),
                                 share(tail, wp, n), share(alone, wp, n), np.log1p(np.bincount(wp, minlength=total)) / 5)):
        out[:, k + col] = value
    return out, owner


@dataclass
class GatedAttention:
    """Encoder layer, attention (V, U, w) and scoring layer, with the
    standardisation of the inputs."""

    mean: np.ndarray
    scale: np.ndarray
    w: dict[str, np.ndarray]

    @staticmethod
    def _forward(w, x, cut):
        e = np.tanh(x @ w["E"] + w["e"])
        t, g = np.tanh(e @ w["V"]), 1 / (1 + np.exp(-np.clip(e @ w["U"], -30, 30)))
        a = (t * g) @ w["a"]
        a = np.exp(np.clip(a - np.repeat(np.maximum.reduceat(a, cut[:-1]), np.diff(cut)), -60, 0))
        a /= np.repeat(np.add.reduceat(a, cut[:-1]), np.diff(cut))
        z = np.add.reduceat(a[:, None] * e, cut[:-1], axis=0)
        return e, t, g, a, z, z @ w["c"] + w["b"][0]

    @classmethod
    def fit(cls, x: np.ndarray, cut: np.ndarray, y: np.ndarray, hidden: int = 32, gate: int = 16, epochs: int = 30,
            bags: int = 64, rate: float = 3e-3, decay: float = 1e-4, seed: int = 7) -> GatedAttention:
        """Adam on the log loss of bags; ``cut`` bounds the bags' rows in ``x``."""
        rng = np.random.default_rng(seed)
        mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        x = (x - mean) / scale
        w = {"E": rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), "e": np.zeros(hidden),
             "V": rng.normal(0, 1 / np.sqrt(hidden), (hidden, gate)), "U": rng.normal(0, 1 / np.sqrt(hidden), (hidden, gate)),
             "a": rng.normal(0, 0.1, gate), "c": rng.normal(0, 0.1, hidden), "b": np.zeros(1)}
        m, v, step = {k: np.zeros_like(p) for k, p in w.items()}, {k: np.zeros_like(p) for k, p in w.items()}, 0
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for lo in range(0, len(order), bags):
                pick = np.sort(order[lo:lo + bags])
                length = np.diff(cut)[pick]
                local = np.concatenate(([0], np.cumsum(length)))
                rows = np.repeat(cut[:-1][pick] - local[:-1], length) + np.arange(local[-1])
                xb = x[rows]
                e, t, g, a, z, logit = cls._forward(w, xb, local)
                d_logit = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y[pick]) / len(pick)
                d_z = np.repeat(d_logit, length)[:, None] * w["c"]
                own = (d_z * e).sum(axis=1)
                d_a = a * (own - np.repeat(np.add.reduceat(a * own, local[:-1]), length))
                d_tg = d_a[:, None] * w["a"]
                d_t, d_g = d_tg * g * (1 - t * t), d_tg * t * g * (1 - g)
                d_e = (a[:, None] * d_z + d_t @ w["V"].T + d_g @ w["U"].T) * (1 - e * e)
                grad = {"E": xb.T @ d_e, "e": d_e.sum(axis=0), "V": e.T @ d_t, "U": e.T @ d_g, "a": (t * g).T @ d_a,
                        "c": z.T @ d_logit, "b": np.array([d_logit.sum()])}
                step += 1
                for k, gk in grad.items():
                    gk = gk + decay * w[k]
                    m[k] = 0.9 * m[k] + 0.1 * gk
                    v[k] = 0.999 * v[k] + 0.001 * gk * gk
                    w[k] -= rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
        return cls(mean, scale, w)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        x, owner = passages(texts)
        cut = np.searchsorted(owner, np.arange(len(texts) + 1))
        logit = self._forward(self.w, (x - self.mean) / self.scale, cut)[-1]
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def _features(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        texts = batch.column(1).to_pylist()
        for lo, hi in batches(texts):
            x, owner = passages(texts[lo:hi])
            cut = np.searchsorted(owner, np.arange(hi - lo + 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo),
                 pa.array([x[cut[i]:cut[i + 1]].tobytes() for i in range(hi - lo)], pa.binary())], ["_id", "y", "x"])


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                label_col: str = "quality", max_docs: int = 4000, max_chars: int = 100_000) -> GatedAttention | None:
    """Model learnt from labelled documents.

    Fit on a bounded sample: about ``max_docs`` labelled rows (by a hash of
    the id) whose text has ``max_chars`` characters at most.  Rows without id,
    label or text teach nothing; with no row, or rows of one class only, there
    is no model (None).
    """
    lab = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("double").alias("y")).where("_id is not null and y is not null")
    n = lab.count()
    lab = lab.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) < F.lit(min(1.0, max_docs / max(n, 1))) * (1 << 20))
    rows = (docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
            .where(F.length("_text") <= max_chars).join(F.broadcast(lab), "_id").select("_id", "_text", "y"))
    got = sorted(rows.mapInArrow(_features, "_id long, y double, x binary").collect(), key=lambda r: (r["_id"], r["y"], bytes(r["x"])))
    y = np.array([r["y"] > 0.5 for r in got], float)
    if len(y) == 0 or y.min() == y.max():
        return None
    bags = [np.frombuffer(r["x"], np.float32).reshape(-1, FEATURES) for r in got]
    cut = np.concatenate(([0], np.cumsum([len(b) for b in bags])))
    return GatedAttention.fit(np.concatenate(bags).astype(np.float64), cut, y)


def score_quality(docs: DataFrame, model: GatedAttention | None, text_col: str = "text", score_out: str = "score") -> DataFrame:
    """``docs`` with a quality score from 0 to 1 (higher: label 1 likelier).

    Every passage of the whole text counts.  Null, empty and blank texts are a
    bag of one passage of zeros.  Without a model every score is 0.5.  A column
    named like the output is replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c != score_out]
    inner = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.col(f"`{text_col}`").cast("string").alias("_text"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in it:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            parts = [m.scores(texts[lo:hi]) if m else np.full(hi - lo, 0.5) for lo, hi in batches(texts)]
            yield pa.RecordBatch.from_arrays(batch.columns[:-1] + [pa.array(np.concatenate(parts) if parts else [], pa.float64())],
                                             names=[f"c{i}" for i in range(len(keep))] + ["_score"])

    schema = ", ".join([f"c{i} {t}" for i, (_, t) in enumerate(docs.select(*[F.col(f"`{c}`") for c in keep]).dtypes)] + ["_score double"])
    return inner.mapInArrow(run, schema).toDF(*keep, score_out)
