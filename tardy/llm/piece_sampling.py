"""SentencePiece encoding by sampling distinct segmentations, and decoding."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tardy.llm.piece_lattice import default_model, load, sample_segmentations
from tardy.llm.text import batches

SAMPLES = 2
#: characters whose lattices are held at once (a hundred bytes of arrays each)
LATTICE_CHARS = 1 << 18


def _keys(column: pa.Array) -> np.ndarray:
    return np.array([x or 0 for x in column.to_pylist()], np.int64).view(np.uint64)


def sample_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SAMPLES, seed: int = 0,
                  model: str | None = None) -> DataFrame:
    """``docs`` without ``text_col`` and with up to ``k`` segmentations a row:
    ``sample, n_ids, ids, log_prob, log_inclusion, round_trip`` (whether the
    ids, decoded again, spell the text).

    Each row's text is cut into pieces of the model in ``k`` distinct ways,
    drawn without replacement from the piece lattice's distribution (see
    :func:`tardy.llm.piece_lattice.sample_segmentations`).  The random stream
    depends on the row's id and ``seed`` alone, not on partitions.
    ``log_inclusion`` is the logarithm of the inclusion score.

    Every sample decodes to the text exactly.  A null text reads as empty; an
    empty text has the one segmentation of its leading space.  A null id draws
    as id 0; repeated rows draw alike.  Whole texts are read; lattices are
    built for about a quarter of a million characters at a time.  Columns named like an
    output are replaced.
    """
    path = model or default_model()
    outs = ("sample", "n_ids", "ids", "log_prob", "log_inclusion", "round_trip")
    keep = [c for c in docs.columns if c != text_col and c not in outs]
    inner = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)],
                        F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(path)
        for batch in it:
            texts, keys = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()], _keys(batch.column(batch.num_columns - 2))
            for lo, hi in batches(texts, LATTICE_CHARS):
                found = sample_segmentations(pieces, texts[lo:hi], keys[lo:hi], k, seed)
                row = np.repeat(np.arange(lo, hi), [len(x) for x in found])
                flat = [y for x in found for y in x]
                sizes = np.array([len(y[0]) for y in flat], np.int64)
                cut = np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes)))
                every = np.concatenate([y[0] for y in flat]) if flat else np.zeros(0, np.int32)
                spelt = pieces.decode_many(every, cut)
                ids = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(every, pa.int32()))
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [c.take(take) for c in batch.columns[:-2]]
                    + [pa.array([i for x in found for i in range(len(x))], pa.int32()), pa.array(sizes), ids,
                       pa.array([y[1] for y in flat], pa.float64()), pa.array([y[2] for y in flat], pa.float64()),
                       pa.array([t == texts[i] for t, i in zip(spelt, row.tolist())], pa.bool_())],
                    names=[f"c{i}" for i in range(len(keep))] + list(outs))

    schema = ", ".join([f"c{i} {t}" for i, (_, t) in enumerate(docs.select(*[F.col(f"`{c}`") for c in keep]).dtypes)]
                       + ["sample int, n_ids long, ids array<int>, log_prob double, log_inclusion double, round_trip boolean"])
    return inner.mapInArrow(run, schema).toDF(*keep, *outs)


def decode_pieces(samples: DataFrame, ids_col: str = "ids", text_out: str = "text", model: str | None = None) -> DataFrame:
    """``samples`` with the text that each row's ids spell (null ids: null).
    A column named like the output is replaced."""
    path = model or default_model()
    keep = [c for c in samples.columns if c != text_out]
    inner = samples.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.col(f"`{ids_col}`").alias("_ids"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(path)
        for batch in it:
            lists = batch.column(batch.num_columns - 1)
            cut = np.concatenate((np.zeros(1, np.int64), np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))))
            texts = pieces.decode_many(lists.flatten().to_numpy(zero_copy_only=False), cut)
            texts = [t if v else None for t, v in zip(texts, lists.is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays(batch.columns[:-1] + [pa.array(texts, pa.string())], names=[f"c{i}" for i in range(len(keep))] + ["_out"])

    schema = ", ".join([f"c{i} {t}" for i, (_, t) in enumerate(samples.select(*[F.col(f"`{c}`") for c in keep]).dtypes)] + ["_out string"])
    return inner.mapInArrow(run, schema).toDF(*keep, text_out)
