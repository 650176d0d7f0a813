"""Ranked lexical search, term at a time with a limited set of accumulators.

Documents are read once: each gives its number of terms and how often it holds
the terms of the queries.  From that table come the corpus counts, and a second
pass ranks it.  A task takes its documents batch by batch; for a query it walks
the posting lists of the query's terms from the rarest on and adds every
posting's share to its document's accumulator.  A term can add at most the
largest share in its list, so once the bounds of this and all later terms
together stay below the k-th best partial score, no document without an
accumulator can still be among the best: none is created from there on, and
those that exist are updated exactly.  The k-th best score of earlier batches
serves as a floor.  Tasks hand on k rows a query, which are merged in two steps.

The queries go to the tasks in blocks of a stated size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tardy.llm.text import ALNUM, batches, join_bytes, words
from tardy.session import materialize

_U = np.uint64
#: characters of query text in one block
BLOCK_CHARS = 2 << 20
#: characters of documents whose terms are counted at once
BATCH_CHARS = 4 << 20
#: parts that the best rows of one query are merged in before the last merge
MERGE_PARTS = 32


class Queries:
    """Terms of a block of queries as numbers of a sorted vocabulary of word
    hashes; each query has its distinct terms and how often it repeats them."""

    def __init__(self, texts: list[str | None]):
        buf, starts = join_bytes(texts)
        h, owner, _, _ = words(buf, starts, ALNUM)
        self.vocab, term = np.unique(h, return_inverse=True)
        self.gate = np.zeros(1 << 16, bool)
        self.gate[(self.vocab >> _U(48)).astype(np.int64)] = True
        cut = np.searchsorted(owner, np.arange(len(texts) + 1))
        self.terms = [np.unique(term[a:b], return_counts=True) for a, b in zip(cut[:-1], cut[1:])]

    def numbers(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, terms) of the words that are in the vocabulary."""
        at = np.flatnonzero(self.gate[(h >> _U(48)).astype(np.int64)])
        if not len(at):
            return at, at
        k = np.minimum(np.searchsorted(self.vocab, h[at]), len(self.vocab) - 1)
        same = self.vocab[k] == h[at]
        return at[same], k[same]


def _postings(sent):
    schema = pa.schema([("_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tf", pa.list_(pa.int32()))])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: Queries = sent.value
        span = max(len(queries.vocab), 1)
        for batch in it:
            texts = batch.column(1).to_pylist()
            for lo, hi in batches(texts, BATCH_CHARS):
                buf, starts = join_bytes(texts[lo:hi])
                h, doc, _, _ = words(buf, starts, ALNUM)
                at, term = queries.numbers(h)
                pair, tf = np.unique(doc[at] * span + term, return_counts=True)
                cut = pa.array(np.searchsorted(pair // span, np.arange(hi - lo + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(np.bincount(doc, minlength=hi - lo).astype(np.int64)),
                     pa.ListArray.from_arrays(cut, pa.array((pair % span).astype(np.int32))),
                     pa.ListArray.from_arrays(cut, pa.array(tf.astype(np.int32)))], schema=schema)
    return run


class Best:
    """The k best (score, id) of one query so far: highest score, then lowest
    id, null ids last."""

    def __init__(self, k: int):
        self.k = k
        self.score, self.id, self.null = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def floor(self) -> int:
        """A document below this score is not among the k best."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        score, ids, null = np.concatenate((self.score, score)), np.concatenate((self.id, ids)), np.concatenate((self.null, null))
        order = np.lexsort((ids, null, -score))[:self.k]
        self.score, self.id, self.null = score[order], ids[order], null[order]


def accumulate(lists: list[tuple[np.ndarray, np.ndarray]], n_docs: int, k: int, floor: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of all documents that can be among the ``k`` best
    with a score of ``floor`` or more; their scores are exact.  ``lists`` holds
    (documents, shares) of each term, rarest first."""
    bound = [int(share.max()) if len(share) else 0 for _, share in lists]
    rest = np.cumsum(bound[::-1])[::-1].tolist()
    score, live = np.zeros(n_docs, np.int64), np.zeros(n_docs, bool)
    creating = True
    for (doc, share), most in zip(lists, rest):
        if creating:
            kth = floor
            held = score[live]
            if len(held) >= k:
                kth = max(kth, int(np.partition(held, len(held) - k)[len(held) - k]))
            creating = most >= kth
        if creating:
            live[doc] = True
            score[doc] += share
        else:
            old = live[doc]
            score[doc[old]] += share[old]
    found = np.flatnonzero(live & (score >= floor))
    return found, score[found]


def _rank(sent, stats, k: int):
    schema = pa.schema([("_q", pa.int32()), ("_id", pa.int64()), ("score", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: Queries = sent.value
        total, length, weight, place = stats.value
        best = [Best(k) for _ in queries.terms]
        walk = []                                   # terms of each query, rarest first, that weigh anything
        for term, times in queries.terms:
            order = np.argsort(place[term], kind="stable")
            walk.append([(int(t), int(c)) for t, c in zip(term[order], times[order]) if weight[t] > 0])
        for batch in it:
            n = batch.column(1).to_pylist()
            m = np.array([25 + 75 * x * total // length if length else 25 for x in n], np.int64)
            cut = batch.column(2).offsets.to_numpy().astype(np.int64)
            term = batch.column(2).values.to_numpy()[cut[0]:cut[-1]]
            tf = batch.column(3).flatten().to_numpy().astype(np.int64)
            doc = np.repeat(np.arange(len(n)), np.diff(cut))
            order = np.argsort(term, kind="stable")
            term, tf, doc = term[order], tf[order], doc[order]
            share = weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
            first = np.searchsorted(term, np.arange(len(queries.vocab) + 1)).tolist()
            null = np.asarray(batch.column(0).is_null())
            ids = batch.column(0).fill_null(0).to_numpy()
            for q, terms in enumerate(walk):
                lists = [(doc[first[t]:first[t + 1]], share[first[t]:first[t + 1]] * c) for t, c in terms if first[t] < first[t + 1]]
                if lists:
                    at, score = accumulate(lists, len(n), k, best[q].floor)
                    best[q].add(score, ids[at], null[at])
        for q, b in enumerate(best):
            if len(b.score):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b.score), q, np.int32)), pa.array(b.id, mask=b.null), pa.array(b.score)], schema=schema)
    return run


def _first(rows: DataFrame, by: list, k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.col("_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The ``k`` best documents of every query: ``item_col, rank, id_col, score``.

    Terms are ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` of whole texts,
    A-Z lower-cased.  With N documents that have a term, L terms in all, n
    terms of a document, df documents that hold a term and tf its occurrences,
    a term weighs w = floor(1000 ln((2N+2)/(2df+1))) and adds, as often as the
    query repeats it, w * ((10^9 tf) div (1000 tf + 8m)) with
    m = 25 + (75 n N) div L.  Documents with a score above 0 are ranked by
    score, then by id (nulls last).

    A null or empty text has no terms: such a document is never found, such a
    query finds nothing.  Repeated document ids are documents of their own;
    every row of ``queries`` is a query, also with a repeated or null id.
    Empty tables give an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    asked = queries.select(F.col(f"`{item_col}`").alias("_item"), F.col(f"`{item_text}`").cast("string").alias("_t"))
    chars = asked.agg(F.sum(F.length("_t") + 20)).first()[0] or 0
    blocks = int(-(-chars // BLOCK_CHARS)) or 1
    out = []
    for b in range(blocks):
        # a block is bounded, so its queries, vocabulary and counts may pass the driver
        rows = asked.where(F.pmod(F.xxhash64("_item", "_t"), F.lit(blocks)) == b).collect()
        made = Queries([r["_t"] for r in rows])
        sent = spark.sparkContext.broadcast(made)
        table = materialize(texts.mapInArrow(_postings(sent), "_id long, n long, terms array<int>, tf array<int>"))
        total, length = table.where("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(made.vocab), np.int64)
        for r in table.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("c")).collect():
            df[r["t"]] = r["c"]
        weight = np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
        place = np.empty(len(df), np.int64)
        place[np.argsort(df, kind="stable")] = np.arange(len(df))
        stats = spark.sparkContext.broadcast((total, length, weight, place))
        part = table.mapInArrow(_rank(sent, stats, k), "_q int, _id long, score long")
        part = _first(part, ["_q", F.pmod(F.xxhash64("_id"), F.lit(MERGE_PARTS))], k)
        names = spark.createDataFrame([(i, r["_item"]) for i, r in enumerate(rows)],
                                      T.StructType([T.StructField("_q", T.IntegerType()), T.StructField("_item", asked.schema["_item"].dataType)]))
        out.append(_first(part, ["_q"], k).join(names, "_q"))
    found = reduce(DataFrame.unionByName, out)
    return found.select(F.col("_item").alias(item_col), "rank", F.col("_id").alias(id_col), "score")


def oracle_sql(k: int = 10) -> str:
    """Every document scored for every item from the definition, in DuckDB SQL."""
    def terms(table: str, key: str) -> str:
        low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
        return rf"select row_number() over () as rn, {key}, regexp_extract_all({low}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from {table} where text is not null"
    return f"""
with d as ({terms('documents', 'doc_id')}),
n as (select rn, doc_id, len(w) as n from d where len(w) > 0),
g as (select count(*) as n_all, cast(coalesce(sum(n), 0) as bigint) as l_all from n),
tf as (select rn, term, count(*) as tf from (select rn, unnest(w) as term from d) group by 1, 2),
q as (select rn as q, item_id, term, count(*) as c from (select rn, item_id, unnest(w) as term from ({terms('benchmark', 'item_id')})) group by 1, 2, 3),
wt as (select term, cast(floor(1000 * ln((2 * n_all + 2) / (2 * df + 1))) as bigint) as w
  from (select term, count(*) as df from tf where term in (select term from q) group by 1), g),
s as (select q.q, q.item_id, n.rn, n.doc_id, cast(sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * n_all) // l_all))))) as bigint) as score
  from q join wt using (term) join tf using (term) join n using (rn), g group by 1, 2, 3, 4)
select item_id, cast(rank as integer) as rank, doc_id, score
from (select *, row_number() over (partition by q order by score desc, doc_id) as rank from s where score > 0) where rank <= {k}"""
