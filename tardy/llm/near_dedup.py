"""Near-duplicate documents by SuperMinHash signatures.

1. Every text becomes its set of distinct k-word shingles and, from it, a
   SuperMinHash signature; rows of consecutive positions are hashed into bands.
2. Texts with the same word sequence are one class; only one document of each
   class goes on, so copies never meet in a bucket.
3. Classes that share a band are candidates.  Each class is first compared
   with one pivot (the smallest id of its buckets); the links found give
   components.  Buckets whose members then still lie in different components
   are merged by pivot into clusters, and what is outside a cluster's largest
   component is compared, in blocks, with the rest of the cluster.  So a group
   of linked copies costs one comparison each, pairs are never rows of a
   table, and no candidate link between components is left out.
4. A candidate counts only if the exact Jaccard similarity of the full shingle
   sets reaches the threshold.
5. Links are merged by distributed union-find.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tardy.llm.components import connected_components, union_find
from tardy.llm.text import NON_SPACE, batches, join_bytes, mix, sequence_keys, shingles, words
from tardy.session import materialize

_U = np.uint64
_NONE = np.iinfo(np.uint64).max
_CHUNK = 1 << 17                     # elements whose permutation state is held at once
_MEMBERS = 512                       # texts compared with one copy of a pivot
_BLOCK = 1024                        # texts on either side of a block comparison
_COLUMNS = 4096                      # shingles counted at once in a block comparison


@dataclass(frozen=True)
class Bands:
    """Signature layout: ``bands`` bands of ``rows`` positions."""

    bands: int
    rows: int

    @property
    def size(self) -> int:
        return self.bands * self.rows


def band_plan(percent: int, rows: int = 6, miss: float = 1e-6) -> Bands:
    """Fewest bands such that a pair exactly at the threshold shares none with
    probability ``miss`` at most."""
    return Bands(max(1, math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** rows))) if percent < 100 else 1, rows)


def superminhash(v: np.ndarray, owner: np.ndarray, n_sets: int, m: int) -> np.ndarray:
    """SuperMinHash signatures (n_sets x m) of sets of 64-bit elements.

    Each element walks through its own random permutation of the m positions
    (an inside-out shuffle); step j offers position p_j the value j + r_j with
    r_j in [0, 1).  All elements take step j together.  A set stops as soon as
    all its positions hold values below j + 1, since later steps only offer
    more.  Values are j in the high and r_j in the low 32 bits; positions of
    empty sets hold the largest value.  Long sets are worked on in pieces
    whose signatures are merged by minimum.
    """
    sig = np.full(n_sets * m, _NONE, _U)
    for lo in range(0, len(v), _CHUNK):
        x, d = v[lo:lo + _CHUNK], owner[lo:lo + _CHUNK]
        first, last = int(d[0]), int(d[-1]) + 1
        part = np.full((last - first) * m, _NONE, _U)
        base = (d - first) * m
        perm = np.broadcast_to(np.arange(m, dtype=np.uint16), (len(x), m)).copy()
        at = np.arange(len(x))
        for j in range(m):
            r = mix(x + _U(((j + 1) * 0x9E3779B97F4A7C15) & ((1 << 64) - 1)))
            k = j + ((r >> _U(32)) * _U(m - j) >> _U(32)).astype(np.int64)
            p = perm[at, k]
            perm[at, k] = perm[at, j]
            np.minimum.at(part, base + p, (r & _U(0xFFFFFFFF)) | _U(j << 32))
            if j + 1 == m:
                break
            open_ = part.reshape(-1, m).max(axis=1) >= _U((j + 1) << 32)
            keep = open_[base // m]
            if not keep.all():
                x, base, at = x[keep], base[keep], at[keep]
            if not len(x):
                break
        out = sig[first * m:last * m]
        np.minimum(out, part, out=out)
    return sig.reshape(n_sets, m)


def band_hashes(sig: np.ndarray, plan: Bands) -> np.ndarray:
    """One 64-bit hash for each set and band (n_sets x bands)."""
    s = sig.reshape(len(sig), plan.bands, plan.rows)
    h = np.broadcast_to(mix(np.arange(1, plan.bands + 1, dtype=_U)), s.shape[:2]).copy()
    for r in range(plan.rows):
        h = mix(h * _U(0x2545F4914F6CDD1D) + s[:, :, r])
    return h


def text_shingles(texts: list[str | None], k: int):
    """(hash, text index) of the distinct shingles of each text, and the words' (hash, text index)."""
    buf, starts = join_bytes(texts)
    h, d, _, _ = words(buf, starts, NON_SPACE)
    return shingles(h, d, len(texts), k), (h, d)


_SIGNED = "_id long, n_shingles long, k1 long, k2 long, bands array<long>"


def _sign(k: int, plan: Bands):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = batch.column(1).to_pylist()
            for lo, hi in batches(texts):
                n = hi - lo
                (v, d), (h, hd) = text_shingles(texts[lo:hi], k)
                bands = band_hashes(superminhash(v, d, n, plan.size), plan).view(np.int64)
                keys = sequence_keys(h, hd, n).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * plan.bands, plan.bands, dtype=np.int32)),
                                                 pa.array(bands.reshape(-1)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, n), pa.array(np.bincount(d, minlength=n).astype(np.int64)),
                     pa.array(np.ascontiguousarray(keys[:, 0])), pa.array(np.ascontiguousarray(keys[:, 1])), lists],
                    ["_id", "n_shingles", "k1", "k2", "bands"])
    return run


def _compare(k: int, percent: int):
    """Rows come sorted by (center, salt, member): the center's own text first,
    then the texts compared with it."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sets = None, []
        for batch in it:
            center, salt, member = (batch.column(i).to_pylist() for i in range(3))
            texts = batch.column(3).to_pylist()
            a, b = [], []
            for lo, hi in batches(texts):
                (v, d), _ = text_shingles(texts[lo:hi], k)
                cut = np.searchsorted(d, np.arange(hi - lo + 1))
                for i in range(hi - lo):
                    key, own = (center[lo + i], salt[lo + i]), v[cut[i]:cut[i + 1]]
                    if key != at:
                        at, sets = key, []
                    if member[lo + i] is None:
                        sets.append(own)
                        continue
                    for s in sets:
                        both = len(np.intersect1d(s, own, assume_unique=True))
                        if both and 100 * both >= percent * (len(s) + len(own) - both):
                            a.append(key[0])
                            b.append(member[lo + i])
                            break
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["center", "member"])
    return run


def _verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Those (center, member) pairs whose full shingle sets are similar enough.

    A center with many members gets a copy for every ``_MEMBERS`` of them, so
    the comparison is spread however often one text is a center.
    """
    copies = pairs.groupBy("center").agg(F.ceil(F.count(F.lit(1)) / _MEMBERS).cast("int").alias("copies"))
    members = pairs.join(copies, "center").select(
        F.col("member").alias("_id"), "center", F.pmod(F.xxhash64("member"), F.col("copies")).cast("int").alias("salt"), "member")
    centers = copies.select(F.col("center").alias("_id"), "center",
                            F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"), F.lit(None).cast("long").alias("member"))
    rows = members.unionByName(centers).join(texts.hint("merge"), "_id")
    return (rows.repartition("center", "salt").sortWithinPartitions("center", "salt", F.col("member").asc_nulls_first())
            .select("center", "salt", "member", "_text")
            .mapInArrow(_compare(k, percent), "center long, member long"))


def block_links(a: list[np.ndarray], b: list[np.ndarray], percent: int) -> np.ndarray:
    """Which sets of ``a`` and ``b`` are similar enough (len(a) x len(b)), by
    exact intersection sizes: products of membership matrices, a slice of the
    shared shingles at a time."""
    na, nb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    va, vb = np.concatenate(a), np.concatenate(b)
    ids = np.intersect1d(va, vb)
    both = np.zeros((len(a), len(b)), np.float64)
    ra, rb = np.repeat(np.arange(len(a)), na), np.repeat(np.arange(len(b)), nb)
    ca, cb = np.searchsorted(ids, va), np.searchsorted(ids, vb)
    if len(ids):
        ka, kb = ids[np.minimum(ca, len(ids) - 1)] == va, ids[np.minimum(cb, len(ids) - 1)] == vb
        ra, ca, rb, cb = ra[ka], ca[ka], rb[kb], cb[kb]
    for lo in range(0, len(ids), _COLUMNS):
        width = min(_COLUMNS, len(ids) - lo)
        parts = []
        for r, c, n in ((ra, ca, len(a)), (rb, cb, len(b))):
            m = np.zeros((n, width), np.float32)
            on = (c >= lo) & (c < lo + width)
            m[r[on], c[on] - lo] = 1
            parts.append(m)
        both += parts[0] @ parts[1].T                    # counts below 2**24 are exact
    return (both > 0) & (100 * both >= percent * (na[:, None] + nb[None, :] - both))


def _compare_blocks(k: int, percent: int):
    """Rows come sorted by (cluster, i, j); those with ``side`` 0 are compared
    with those of side 1 (block i with itself where there is no side 1).  Of
    the links found in a block, a spanning forest goes on."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sets, ids, group, sides = None, [], [], [], []

        def links():
            side, comp, rep = np.array(sides), np.array(group, np.int64), np.array(ids, np.int64)
            left = np.flatnonzero(side == 0)
            right = np.flatnonzero(side == 1)
            right = right if len(right) else left
            if not len(left):
                return np.zeros(0, np.int64), np.zeros(0, np.int64)
            ok = block_links([sets[i] for i in left], [sets[i] for i in right], percent)
            x, y = np.nonzero(ok & (comp[left][:, None] != comp[right][None, :]))
            return union_find(rep[left[x]], rep[right[y]])

        for batch in it:
            rows = batch.select(["_cluster", "_i", "_j", "_side", "_id", "_component"]).to_pylist()
            texts = batch.column(batch.schema.get_field_index("_text")).to_pylist()
            for lo, hi in batches(texts):
                (v, d), _ = text_shingles(texts[lo:hi], k)
                cut = np.searchsorted(d, np.arange(hi - lo + 1))
                for n, r in enumerate(rows[lo:hi]):
                    key = (r["_cluster"], r["_i"], r["_j"])
                    if key != at:
                        if sets:
                            u, w = links()
                            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(w)], ["center", "member"])
                        at, sets, ids, group, sides = key, [], [], [], []
                    sets.append(v[cut[n]:cut[n + 1]].copy())
                    ids.append(r["_id"])
                    group.append(r["_component"])
                    sides.append(r["_side"])
        if sets:
            u, w = links()
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(w)], ["center", "member"])
    return run


def _between_components(members: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links between members (pivot, rep, component) of a cluster that lie in
    different components.  What is outside a cluster's largest component is
    dealt into blocks, and each is compared with itself, with the later ones,
    and with every block of the largest component."""
    parts = members.groupBy("pivot", "component").agg(F.count(F.lit(1)).alias("n"))
    sizes = materialize(parts.groupBy("pivot").agg(F.max_by("component", F.struct("n", "component")).alias("home"), F.max("n").alias("inside"), F.sum("n").alias("n"))
                        .where("n > inside").select("pivot", "home", F.ceil((F.col("n") - F.col("inside")) / _BLOCK).cast("int").alias("outer"),
                                                    F.ceil(F.col("inside") / _BLOCK).cast("int").alias("inner")))
    rows = members.join(sizes, "pivot")
    is_home = F.col("component") == F.col("home")
    block = F.pmod(F.xxhash64("rep"), F.when(is_home, F.col("inner")).otherwise(F.col("outer"))).cast("int")
    every = F.sequence(F.lit(0), F.col("outer") - 1)

    def pair(i, j, side):
        return F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))

    home = F.transform(every, lambda i: pair(i, F.col("outer") + F.col("_b"), F.lit(1)))
    outer = F.concat(
        F.transform(every, lambda x: F.when(x < F.col("_b"), pair(x, F.col("_b"), F.lit(1))).otherwise(pair(F.col("_b"), x, F.lit(0)))),
        F.transform(F.sequence(F.lit(0), F.col("inner") - 1), lambda j: pair(F.col("_b"), F.col("outer") + j, F.lit(0))))
    dealt = rows.withColumn("_b", block).select(
        F.col("rep").alias("_id"), F.col("pivot").alias("_cluster"), F.col("component").alias("_component"),
        F.explode(F.when(is_home, home).otherwise(outer)).alias("x"))
    dealt = dealt.select("_id", "_cluster", "_component", F.col("x.i").alias("_i"), F.col("x.j").alias("_j"), F.col("x.side").alias("_side"))
    full = dealt.join(texts.hint("merge"), "_id")
    return (full.repartition("_cluster", "_i", "_j").sortWithinPartitions("_cluster", "_i", "_j")
            .select("_cluster", "_i", "_j", "_side", "_id", "_component", "_text").mapInArrow(_compare_blocks(k, percent), "center long, member long"))


def _same_id(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the classes of an id whose rows differ in their words."""
    rows = signed.where("n_shingles > 0 and _id is not null")
    several = rows.groupBy("_id").agg(F.min(F.struct("k1", "k2")).alias("a"), F.max(F.struct("k1", "k2")).alias("b")).where("a <> b").select("_id")
    reps = materialize(rows.join(several, "_id", "left_semi").select("_id", "k1", "k2").distinct()
                       .join(classes.select("k1", "k2", "rep"), ["k1", "k2"]).select("_id", F.col("rep").alias("member")))
    return reps.join(reps.groupBy("_id").agg(F.min("member").alias("center")), "_id").where("member <> center").select("center", "member")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80,
                    k: int = 5, plan: Bands | None = None) -> DataFrame:
    """One row per document: ``id_col, n_shingles, component_id, kept``.

    ``n_shingles`` is the size of the document's set of k-word shingles over
    ASCII-lower-cased words ``[^\\x20\\x09-\\x0D]+`` (with fewer words the
    whole sequence is the one shingle).  Two documents are linked when
    100 * intersection >= ``percent`` * union of these sets; ``component_id``
    is the smallest id reachable over links and ``kept`` marks the document
    that bears it.

    Null, empty and blank texts have no shingle and are linked with nothing
    (kept).  Rows that repeat an id are the same document and are linked when
    any of their texts is.  A row with a null id takes its text's component
    (null if no row with an id has that text; then kept) and starts none.  An
    empty table gives an empty result.  Other columns are not read, whatever
    their names.
    """
    plan = plan or band_plan(percent)
    src = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    signed = materialize(src.mapInArrow(_sign(k, plan), _SIGNED))
    # one document of each word sequence goes on
    classes = materialize(signed.where("n_shingles > 0").groupBy("k1", "k2")
                          .agg(F.min("_id").alias("rep"), F.first("bands").alias("bands"),
                               F.count(F.lit(1)).alias("copies")))
    banded = classes.where("rep is not null").select("rep", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("rep").alias("pivot"), F.max("rep").alias("top")).where("pivot <> top").select("band", "pivot")
    members = materialize(banded.join(shared, "band").select("pivot", "rep").distinct())
    # a merge join at every size: what is wanted follows the input and is no broadcast
    texts = materialize(src.where("_id is not null").join(members.select(F.col("rep").alias("_id")).distinct().hint("merge"), "_id", "left_semi"))
    # each class against the smallest id it shares a band with
    first = members.groupBy(F.col("rep").alias("member")).agg(F.min("pivot").alias("center")).where("member <> center")
    links = materialize(_verified(materialize(first), texts, k, percent))
    # what shares a band and still lies in different components
    found = connected_components(links, "center", "member").withColumnRenamed("node", "rep")
    placed = materialize(members.join(found, "rep", "left").select("pivot", "rep", F.coalesce("component", "rep").alias("component")))
    more = materialize(_between_components(placed, texts, k, percent))
    label = connected_components(links.union(more).union(_same_id(signed, classes)), "center", "member")
    grouped = materialize(classes.select("k1", "k2", "rep", "copies").join(label.withColumnRenamed("node", "rep"), "rep", "left")
                          .select("k1", "k2", F.coalesce("component", "rep").alias("_component"), (F.col("copies") > 1).alias("more"), "component")
                          .where("more or component is not null").select("k1", "k2", "_component"))
    return (signed.select("_id", "n_shingles", "k1", "k2").join(grouped, ["k1", "k2"], "left")
            .select(F.col("_id").alias(id_col), "n_shingles",
                    F.when(F.col("n_shingles") > 0, F.coalesce("_component", "_id")).otherwise(F.col("_id")).alias("component_id"))
            .withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id"))))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, k: int = 5) -> DataFrame:
    """The rows of ``docs`` without the documents that :func:`near_duplicates`
    does not keep.  Rows that repeat an id with other texts are judged one by
    one here, each by its own text, so no text goes without a copy that stays.
    Rows with a null id all stay."""
    ids, text = F.col(f"`{id_col}`"), F.xxhash64(F.col(f"`{text_col}`"))
    several = materialize(docs.where(ids.isNotNull()).groupBy(ids.alias(id_col)).agg(F.min(text).alias("a"), F.max(text).alias("b")).where("a <> b").select(id_col))
    node = id_col
    if not several.isEmpty():
        node = "__node"
        own = F.when(F.col("__several"), F.xxhash64(ids, F.col(f"`{text_col}`"))).otherwise(ids.cast("long"))
        docs = docs.join(several.withColumn("__several", F.lit(True)), id_col, "left").select(*docs.columns, own.alias(node))
    gone = materialize(near_duplicates(docs, node, text_col, percent, k).where(F.col(node).isNotNull() & ~F.col("kept")).select(node).distinct())
    kept = docs.join(gone, node, "left_anti")
    return kept if node == id_col else kept.drop(node)
