"""Document fingerprints by consistent weighted sampling, in DataFrame functions.

A text is the weighted set of its word pairs (weight: how often each occurs).
Every one of ``ROUNDS * DRAWS`` samples is drawn over all pairs of the text.
For a sample every pair k has, by hash alone, gamma variates r and c (shape 2)
and a uniform b; with t = floor(ln(weight) / r + b) and ln y = r (t - b) it
offers ln a = ln c - ln y - r.  The pair with the least offer is the sample,
and two texts agree on it with probability sum(min) / sum(max) of their
weights, the generalised Jaccard similarity.  The least offer itself stands for
(pair, t): equal offers come from equal pairs and levels.  The likeness of two
texts is the share of samples on which they agree.

A gamma variate of shape 2 is -ln(u v) with two uniforms cut from hash bits.  A
text and its edited text share most pairs, and r, c and b belong to the pair:
they are drawn once for both weights.  A row makes ``DRAWS`` offers for each
text; many more would make a generated method too long to be compiled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tardy.session import materialize

ROUNDS, DRAWS = 8, 4
#: characters of text in one bucket of neighbouring documents
BUCKET_CHARS = 4_000_000
#: most buckets, and keys of the sample for each of them that finds their
#: bounds; buckets of more text spill, they do not fail
MAX_BUCKETS, SAMPLE_KEYS = 1 << 15, 32
_LEAST_ID = -(1 << 63)


def word_pairs(text: Column) -> Column:
    """Neighbouring words of a text with an empty word at either end, as an
    array of structs; a text without words has pairs of empty words."""
    w = F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")
    return F.arrays_zip(F.concat(F.array(F.lit("")), w).alias("l"), F.concat(w, F.array(F.lit(""))).alias("r"))


def _uniform(h: Column, shift: int, bits: int) -> Column:
    """``bits`` bits of a hash from ``shift`` on, as a uniform within (0, 1)."""
    return (F.shiftrightunsigned(h, shift).bitwiseAND(F.lit((1 << bits) - 1)) + F.lit(0.5)) * F.lit(2.0 ** -bits)


def _signatures(weights: DataFrame, keys: list[str], counts: list[str]) -> DataFrame:
    """(keys, one signature for each of ``counts``) of a table of pair hashes
    ``k`` with how often each occurs: the least offer of each sample over all
    pairs; a count of 0 offers nothing."""
    draws = range(DRAWS)
    turns = weights.select(*keys, "k", *[F.when(F.col(n) > 0, F.log(F.col(n).cast("double"))).alias(f"w{i}") for i, n in enumerate(counts)],
                           F.explode(F.sequence(F.lit(0), F.lit(ROUNDS - 1))).alias("round"))
    logs = [f"w{i}" for i in range(len(counts))]
    hashed = turns.select(*keys, "round", *logs, *[F.xxhash64("k", "round", F.lit(2 * j + i)).alias(f"{x}{j}") for j in draws for i, x in enumerate("gh")])
    drawn = hashed.select(*keys, "round", *logs, *[c for j in draws for c in (
        (-F.log(_uniform(F.col(f"g{j}"), 0, 32) * _uniform(F.col(f"g{j}"), 32, 32))).alias(f"r{j}"),
        F.log(-F.log(_uniform(F.col(f"h{j}"), 0, 25) * _uniform(F.col(f"h{j}"), 25, 25))).alias(f"c{j}"),
        _uniform(F.col(f"h{j}"), 50, 14).alias(f"b{j}"))])
    offers = drawn.select(*keys, "round", *[
        (F.col(f"c{j}") - F.col(f"r{j}") * (F.floor(F.col(w) / F.col(f"r{j}") + F.col(f"b{j}")) - F.col(f"b{j}") + 1)).alias(f"{w}_{j}")
        for w in logs for j in draws])
    least = offers.groupBy(*keys, "round").agg(*[F.min(f"{w}_{j}").alias(f"{w}_{j}") for w in logs for j in draws])
    whole = least.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("round", *[f"{w}_{j}" for w in logs for j in draws]))).alias("_t"))

    def in_order(w: str) -> Column:
        return F.flatten(F.transform("_t", lambda t: F.array(*[t[f"{w}_{j}"] for j in draws])))
    return whole.select(*keys, *[in_order(w).alias(f"sig{i}") for i, w in enumerate(logs)])


def samples(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, sig): the signature of one text a row.  Needs no shuffle if
    ``texts`` is partitioned by one of the keys."""
    pair = texts.select(*keys, F.explode(word_pairs(F.col(text))).alias("p"))
    weight = pair.select(*keys, F.xxhash64("p").alias("k")).groupBy(*keys, "k").agg(F.count(F.lit(1)).alias("n"))
    return _signatures(weight, keys, ["n"]).withColumnRenamed("sig0", "sig")


def sample_both(texts: DataFrame, keys: list[str], first: str, second: str) -> DataFrame:
    """(keys, sig0, sig1): the signatures of two texts a row, with the variates
    of a pair drawn once for both."""
    one = F.array(*[F.struct(F.lit(v).alias("v"), F.col(t).alias("t")) for v, t in ((0, first), (1, second))])
    both = texts.select(*keys, F.explode(one).alias("x"))
    pair = both.select(*keys, F.col("x.v").alias("v"), F.explode(word_pairs(F.col("x.t"))).alias("p"))
    weight = pair.select(*keys, "v", F.xxhash64("p").alias("k")).groupBy(*keys, "k").agg(
        F.sum(1 - F.col("v")).alias("n"), F.sum("v").alias("m"))
    return _signatures(weight, keys, ["n", "m"])


def likeness(a: str, b: str) -> Column:
    """Share of samples on which two signatures agree."""
    same = F.lit(0)
    for j in range(ROUNDS * DRAWS):
        same = same + (F.get(a, F.lit(j)) == F.get(b, F.lit(j))).cast("int")
    return same / F.lit(float(ROUNDS * DRAWS))


def digest(sig: str) -> Column:
    """Signature as text: eight hex digits for each sample."""
    return F.array_join(F.transform(sig, lambda x: F.lpad(F.lower(F.hex(F.shiftrightunsigned(F.xxhash64(x), 32))), 8, "0")), "")


def _long_array(values: list[int]) -> Column:
    """An array literal from one string, which the optimizer folds."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _rank(bounds: list[tuple[int, int]], id_col: str, tie_col: str) -> Column:
    """How many of the descending ``bounds`` lie above a row: among every
    ``step``-th one first, then among those up to the next of them."""
    step = math.isqrt(len(bounds)) + 1

    def above(b: Column) -> Column:
        return (b["i"] > F.col(id_col)) | ((b["i"] == F.col(id_col)) & (b["t"] > F.col(tie_col)))

    def pairs(values: list[tuple[int, int]]) -> Column:
        return F.arrays_zip(_long_array([v[0] for v in values]).alias("i"), _long_array([v[1] for v in values]).alias("t"))
    coarse = F.size(F.filter(pairs(bounds[::step]), above))
    # bounds[step * (coarse - 1)] lies above, bounds[step * coarse] does not
    first = F.greatest(coarse - 1, F.lit(0)) * F.lit(step)
    return first + F.size(F.filter(F.slice(pairs(bounds), first + 1, F.lit(step)), above))


def _neighbour_buckets(rows: DataFrame) -> tuple[DataFrame, int]:
    """``rows`` (_id, _tie, _text) with a bucket number, and the number of
    buckets; buckets follow the order (_id, _tie) descending and hold about
    ``BUCKET_CHARS`` characters, more beyond ``MAX_BUCKETS`` of them.

    The bounds come from a hash sample of the order columns of at most
    ``MAX_BUCKETS * SAMPLE_KEYS`` keys; a row counts the bounds above it in two
    steps, each over the square root of their number."""
    stat = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("_text")).alias("c")).first()
    wanted = min(MAX_BUCKETS, max(1, math.ceil((stat["c"] or 0) / BUCKET_CHARS)))
    if wanted == 1:
        return rows.withColumn("_bucket", F.lit(0)), 1
    share = min(1.0, SAMPLE_KEYS * wanted / max(1, stat["n"]))
    sample = sorted((r["_id"], r["_tie"]) for r in rows.where(
        F.pmod(F.xxhash64("_tie", "_id", F.lit(1)), F.lit(1 << 30)) < int(share * (1 << 30))).select("_id", "_tie").collect())
    if not sample:
        return rows.withColumn("_bucket", F.lit(0)), 1
    bounds = sorted({sample[-1 - (i + 1) * len(sample) // wanted] for i in range(wanted - 1)}, reverse=True)
    return rows.withColumn("_bucket", _rank(bounds, "_id", "_tie")), len(bounds) + 1


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text.

    Returns ``id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next``.  The edited text ends, instead of the last
    floor(n_chars / 2) code points, with as many (or all) first ones of the
    next document by descending id (after the last: the first).

    A null text reads as empty; all texts without words share one fingerprint.
    Null ids come last in the order.  Rows that repeat an id are ordered by a
    hash of their text and each is a document of its own; a table of one row
    is its own next document; an empty table gives an empty result.  Other
    columns are not read.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LEAST_ID)).alias("_id"), F.col(id_col).isNull().cast("int").alias("_null"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    null_ids = F.col("_id") == _LEAST_ID
    rows = rows.select("_id", F.xxhash64("_text", "_null").alias("_tie"), "_text")
    placed, buckets = _neighbour_buckets(rows)
    order = Window.partitionBy("_bucket").orderBy(F.desc("_id"), F.desc("_tie"))
    # the first document of every bucket follows the last one of the bucket before
    heads = materialize(placed.groupBy("_bucket").agg(F.max_by("_text", F.struct("_id", "_tie")).alias("_head")))
    every = Window.orderBy("_bucket")                         # one row for each bucket, numbers only
    chain = heads.select(F.col("_bucket").alias("_from"), F.coalesce(
        F.lag("_bucket").over(every), F.max("_bucket").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("_to"))
    head_sig = samples(heads, ["_bucket"], "_head").withColumnRenamed("sig", "_head_sig")
    ends = materialize(heads.join(head_sig, "_bucket").join(chain, F.col("_bucket") == F.col("_from"))
                       .select(F.col("_to").alias("_bucket"), "_head", "_head_sig"))
    # a task counts the pairs of few buckets, so the counts fit its memory; a given number is not coalesced
    lead = (placed.repartition(2 * buckets, "_bucket").withColumn("_rn", F.row_number().over(order)).withColumn("_next", F.lead("_text").over(order)))
    joined = lead.join(ends.select(F.col("_bucket").alias("_b"), "_head"), (F.col("_bucket") == F.col("_b")) & F.col("_next").isNull(), "left")
    n = F.length("_text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("_text", F.lit(1), n - half), F.substring(F.coalesce("_next", "_head", F.lit("")), F.lit(1), half))
    base = joined.select("_bucket", "_rn", F.when(null_ids, F.lit(None)).otherwise(F.col("_id")).cast("long").alias("_id"), "_text",
                         n.cast("long").alias("n_chars"), edited.alias("_edited"))
    sigs = sample_both(base, ["_bucket", "_rn"], "_text", "_edited").withColumnRenamed("sig0", "s0").withColumnRenamed("sig1", "s1")
    sigs = sigs.withColumn("s2", F.lead("s0").over(Window.partitionBy("_bucket").orderBy("_rn")))
    facts = base.select("_bucket", "_rn", "_id", "n_chars", F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"))
    out = (facts.join(sigs, ["_bucket", "_rn"])
           .join(ends.select(F.col("_bucket").alias("_b"), "_head_sig"), (F.col("_bucket") == F.col("_b")) & F.col("s2").isNull(), "left")
           .withColumn("s2", F.coalesce("s2", "_head_sig")))
    return out.select(F.col("_id").alias(id_col), "n_chars", "edited_sha256", digest("s0").alias("fingerprint"), digest("s1").alias("edited_fingerprint"),
                      likeness("s0", "s1").alias("near_edited"), likeness("s0", "s2").alias("near_next"))
