"""Near-duplicate groups: min-max hashing, banding, and confirmation on full shingle sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Texts, chunks, in_batches, materialize, mix
from ._graph import components

#: Words of a shingle; documents are linked at 100 * intersection >= SIMILAR * union.
SHINGLE, SIMILAR = 5, 75
#: Each permutation gives its minimum and its maximum. ROWS values make a band: at a similarity of 0.75 a pair
#: shares none of the 32 bands with probability (1 - 0.75**4)**32, 5 in a million.
PERMUTATIONS, ROWS = 64, 4
_rng = np.random.default_rng(7)
_FACTORS = _rng.integers(0, 1 << 63, PERMUTATIONS).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _rng.integers(0, 1 << 63, PERMUTATIONS).astype(np.uint64) * np.uint64(2)


def shingles(texts: Texts, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text side by side, and where each text's begin. A shingle's hash mixes its words one after another."""
    _, _, words, first = texts.words(lower=True)
    m = np.diff(first)
    count = np.where(m >= size, m - size + 1, (m > 0).astype(m.dtype))
    at = np.concatenate([[0], np.cumsum(count)])
    all_ = np.empty(at[-1], np.uint64)
    h = np.full(len(words), 0x8CB92BA72F3D8DD7, np.uint64)
    for j in range(size):
        h = mix(h[: max(len(words) - j, 0)] ^ words[j:])  # of words i .. i + j
        if j + 1 < size:
            few = np.flatnonzero(m == j + 1)
            all_[at[few]] = h[first[few]]
    full = np.repeat(m >= size, count)
    all_[full] = h[(np.arange(at[-1]) - np.repeat(at[:-1] - first[:-1], count))[full]]
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a > 1:
            all_[a:b].sort()
    keep = np.ones(len(all_), bool)
    keep[1:] = all_[1:] != all_[:-1]
    keep[at[:-1][count > 0]] = True
    return all_[keep], np.concatenate([[0], np.cumsum(keep)])[at]


def min_max_bands(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Band keys (sets x bands) of non-empty sets that begin at `at`."""
    low, high = [], []
    for factor, term in zip(_FACTORS, _TERMS, strict=True):
        v = values * factor + term
        low.append(np.minimum.reduceat(v, at))
        high.append(np.maximum.reduceat(v, at))
    sketch = np.array(low + high)
    keys = np.arange(1, len(sketch) // ROWS + 1, dtype=np.uint64)[:, None] * np.ones(len(at), np.uint64)
    for row in range(ROWS):
        keys = mix(keys ^ sketch[row::ROWS])
    return keys.T


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, s1 and s2 (digest of the set), bands (empty without shingles) of each row."""

    def of(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                values, at = shingles(Texts(part.column("text")))
                n = np.diff(at)
                full = at[:-1][n > 0]
                digests = np.zeros((2, len(n)), np.uint64)
                lists = np.zeros(len(n) + 1, np.int32)
                bands = np.zeros((0, 0), np.uint64)
                if len(full):
                    digests[0, n > 0] = np.add.reduceat(mix(values), full)
                    digests[1, n > 0] = np.add.reduceat(mix(values ^ np.uint64(0xA5A5A5A55A5A5A5A)), full)
                    bands = min_max_bands(values, full)
                    lists[1:] = np.cumsum(n > 0) * bands.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(n),
                        _signed(digests[0]),
                        _signed(digests[1]),
                        pa.ListArray.from_arrays(pa.array(lists), _signed(bands.ravel())),
                    ],
                    ["doc_id", "n_shingles", "s1", "s2", "bands"],
                )

    return docs.select(F.col("doc_id").cast("bigint"), "text").transform(
        in_batches,
        of, "doc_id bigint, n_shingles bigint, s1 bigint, s2 bigint, bands array<bigint>"
    )


def full_sets(docs: DataFrame) -> DataFrame:
    """doc_id and its sorted shingle hashes as bytes."""

    def of(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                values, at = shingles(Texts(part.column("text")))
                sets = [values[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sets, pa.binary())], ["id", "shingles"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").transform(in_batches, of, "id bigint, shingles binary")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of pairs a, b whose full sets are similar enough."""

    def of(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) else 0
                keep.append(both > 0 and 100 * both >= SIMILAR * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    x, y = (sets.select(F.col("id").alias(c), F.col("shingles").alias(s)) for c, s in (("a", "x"), ("b", "y")))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").transform(in_batches, of, "a bigint, b bigint").distinct()


def prefix_pairs(open_: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs a, b of open_ (rep, component) in different components that can be similar enough; all that are similar enough are among them.

    Shingles are put in one order, rare ones first. Of two sets with a similarity of t, the smaller one's first n - ceil(2t / (1 + t) n) + 1 shingles and the larger one's
    first n - ceil(t n) + 1 have one in common, and what follows the first common one must be long enough for the rest. Shingles of one set only fill these beginnings where texts
    differ enough, so variants of one text that aren't similar enough don't meet.
    """

    def of(batches):
        for batch in batches:
            each = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column("shingles")]
            n = np.array([len(x) for x in each], np.int64)
            at = pa.array(np.repeat(np.arange(len(n)), n))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(at) for c in ("rep", "component", "set")), pa.array(np.repeat(n, n)), pa.array(np.concatenate(each) if each else np.zeros(0, np.int64))],
                ["rep", "component", "set", "n", "token"],
            )

    own = sets.join(open_, F.col("id") == F.col("rep")).select("rep", "component", F.xxhash64("shingles").alias("set"), "shingles")
    tokens = materialize(own.transform(in_batches, of, "rep bigint, component bigint, set bigint, n bigint, token bigint"))
    often = materialize(tokens.groupBy("token").agg(F.count("*").alias("c")).where("c > 1"))
    lists = tokens.join(often, "token").groupBy("set", "rep", "component", "n").agg(F.array_sort(F.collect_list(F.struct("c", "token"))).alias("o"))
    lists = lists.withColumn("alone", F.col("n") - F.size("o"))
    probe = lists.select(
        "rep", "component", "n", "alone", F.posexplode(F.expr("slice(o, 1, cast(greatest(n - (3 * n + 3) div 4 + 1 - alone, 0) as int))")).alias("i", "t")
    )
    probe = materialize(probe.select("rep", "component", "n", F.col("t.token").alias("token"), (F.col("alone") + F.col("i") + 1).alias("at")))
    small = probe.where(F.expr("at <= n - (6 * n + 6) div 7 + 1")).select(
        "token", F.col("rep").alias("b"), F.col("component").alias("cb"), F.col("n").alias("nb"), F.col("at").alias("atb")
    )
    met = probe.join(small, "token").where("component <> cb and (nb < n or nb = n and b < rep) and 100 * nb >= 75 * n")
    met = met.where("175 * (1 + least(n - at, nb - atb)) >= 75 * (n + nb)")
    return met.select(F.greatest("rep", "b").alias("a"), F.least("rep", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links) and kept of each row.

    Texts are lower-cased (A-Z) and cut at ASCII white space; shingles are runs of five words, or all words of a text with fewer. Texts without words, and null texts, have
    empty sets and are linked with nothing; they are kept. Rows with one doc_id are one node, so what their texts are linked with is one component. A null doc_id takes no part:
    its component is null and it is kept. Extra columns are not read.

    Equal sets form a class first, so copies cost one row each. Classes that share a band meet one of their bucket, the pivot: the class
    that shares most bands with others, as the text has that the others were made from. Links are confirmed on full sets. Members of
    buckets that are not all in one component by then are compared by an exact prefix join (prefix_pairs), so no candidate is dropped.
    """
    docs = docs.select("doc_id", "text")
    rows = materialize(signatures(docs))
    shingled = rows.where("n_shingles > 0 and doc_id is not null")
    classes = materialize(
        shingled.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    )
    differ = (F.min("s1") != F.max("s1")) | (F.min("s2") != F.max("s2"))
    again = materialize(shingled.groupBy("doc_id").agg(F.count("*").alias("times"), differ.alias("differ")).where("times > 1"))
    several = shingled.join(again.where("differ"), "doc_id", "left_semi").select("doc_id", "s1", "s2").distinct()
    own = materialize(several.join(classes.select("s1", "s2", "rep"), ["s1", "s2"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    banded = classes.select("rep", "n", F.explode("bands").alias("key"))
    shared = materialize(banded.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"))
    members = materialize(banded.join(shared, "key"))
    sets = full_sets(docs.join(members.select("rep").distinct(), F.col("doc_id") == F.col("rep"), "left_semi"))
    sets = materialize(sets)
    if not again.isEmpty():  # rows with one id: each of their sets once
        twice = again.select(F.col("doc_id").alias("id"))
        one = sets.join(twice, "id", "left_semi").groupBy("id", F.xxhash64("shingles").alias("h")).agg(F.first("shingles").alias("shingles"))
        sets = materialize(sets.join(twice, "id", "left_anti").unionByName(one.drop("h")))
    weight = materialize(members.groupBy("rep").agg(F.sum("size").alias("weight")))
    left = materialize(members.join(weight, "rep").select("key", "rep", "n", "weight"))
    first = left.groupBy("key").agg(F.max_by(F.struct("rep", "n"), F.struct("weight", -F.col("rep"))).alias("pivot"))
    first = materialize(first)
    close = 100 * F.least("n", "pivot.n") >= SIMILAR * F.greatest("n", "pivot.n")
    ends = (F.greatest("rep", "pivot.rep").alias("a"), F.least("rep", "pivot.rep").alias("b"))
    met = left.join(first, "key").where(F.col("rep") != F.col("pivot.rep"))
    links = materialize(confirmed(met.where(close).select(*ends).distinct(), sets).unionByName(own))
    found = components(links)
    node = found.select(F.col("node").alias("rep"), "component")
    left = met.select("key", "rep").join(node, "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
    left = materialize(left)
    still = left.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    open_ = materialize(left.join(materialize(still), "key").select("rep", "component").distinct())
    more = materialize(confirmed(prefix_pairs(open_, sets), sets))
    if not more.isEmpty():
        found = components(links.unionByName(more))
    ids = classes.select("s1", "s2", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    ids = materialize(ids.select("s1", "s2", F.coalesce("component", "rep").alias("component_id")))
    out = rows.join(ids.withColumn("full", F.lit(True)), ["s1", "s2"], "left")
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs that near_duplicates keeps, with all their columns, whatever their names. Rows with a kept id stay as often as they are there; a null id stays."""
    dropped = near_duplicates(docs).where("not kept").select("doc_id")
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)
