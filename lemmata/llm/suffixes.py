"""Suffix-array dedup: byte strings that also start earlier, judged in shards of sorted suffixes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Texts, chunks, in_batches, materialize
from ._repeats import Unit, byte_symbols, covered, estimated_repeated, keyed, runs_of, sketch

#: Bytes of a string that counts as repeated, and of the grams that anchor it.
LENGTH, GRAM = 100, 32
#: Bytes of a shard, about; stretches of one anchor in a shard. An anchor with more is dealt over several shards, which are merged.
SHARD_BYTES, ANCHOR_ROWS = 1 << 20, 4096


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes (Larsson and Sadakane's refinement).

    Suffixes are sorted by eight bytes; then only groups that are still equal are sorted, by the rank of the suffix `h` bytes on, and h doubles.
    """
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = key << np.uint64(8) | padded[i : i + n]
    order = np.argsort(key, kind="stable")
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    rank = np.empty(n, np.int64)
    h = 8
    while True:
        first = np.flatnonzero(new)
        size = np.diff(np.concatenate([first, [n]]))
        rank[order] = np.repeat(first, size)
        open_ = np.repeat(size > 1, size)
        if not open_.any():
            return order
        at = np.flatnonzero(open_)
        own = order[at]
        after = own + h
        # of suffixes that end before h bytes the shorter comes first
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + h + 1, n - own)
        by = np.argsort(rank[own] * (n + h + 2) + second, kind="stable")
        own, second = own[by], second[by]
        order[at] = own
        new[at[1:]] |= (rank[own][1:] != rank[own][:-1]) | (second[1:] != second[:-1])
        h *= 2


def common_prefixes(text: np.ndarray, order: np.ndarray, first: np.ndarray, size: np.ndarray, most: int) -> np.ndarray:
    """lcp[i] of suffixes order[i - 1] and order[i], up to `most`, by Kasai's rule: from one suffix to the next it falls by one at most.

    The rule is followed along all stretches (from `first`, of `size` bytes) at once.
    """
    n = len(text)
    padded = np.concatenate([text.astype(np.int16), np.full(most + 1, -1, np.int16)])
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    lcp = np.zeros(n, np.int64)
    by = np.argsort(-size, kind="stable")
    first, size = first[by], size[by]
    h = np.zeros(len(first), np.int64)
    for t in range(int(size[0]) if len(size) else 0):
        alive = int(np.searchsorted(-size, -t, "left"))
        at = first[:alive] + t
        r = rank[at]
        h = np.maximum(h[:alive] - 1, 0)
        before = order[np.maximum(r - 1, 0)]
        h[r == 0] = 0
        go = np.flatnonzero((r > 0) & (h < most))
        while len(go):
            a, b = at[go] + h[go], before[go] + h[go]
            same = (padded[a] == padded[np.minimum(b, n)]) & (a < n) & (b < n)
            go = go[same]
            h[go] += 1
            go = go[h[go] < most]
        lcp[r] = h
    return lcp


def earlier_in_shard(stretches: list[bytes], where: np.ndarray, windows: np.ndarray, length: int) -> np.ndarray:
    """For each window of each stretch, side by side: whether an equal string starts earlier.

    `where` orders the stretches' first windows; the next window of a stretch follows by one.
    """
    text = np.frombuffer(b"".join(stretches), np.uint8)
    size = np.array([len(s) for s in stretches])
    first = np.cumsum(size) - size
    order = suffix_array(text)
    lcp = common_prefixes(text, order, first, size, length)
    group = np.cumsum(lcp < length) - 1
    of = np.empty(len(text), np.int64)
    of[order] = group
    at = np.concatenate([[0], np.cumsum(windows)])
    i = np.arange(at[-1]) - np.repeat(at[:-1], windows)
    place, moment = np.repeat(first, windows) + i, np.repeat(where, windows) + i
    least = np.full(int(group[-1]) + 1 if len(group) else 0, np.iinfo(np.int64).max)
    np.minimum.at(least, of[place], moment)
    return moment > least[of[place]]


def _moments(ids: list[int | None], start: np.ndarray) -> np.ndarray:
    """Places in the order of (doc_id, start), null ids first."""
    rank = {d: i for i, d in enumerate(sorted(set(ids), key=lambda d: (d is not None, d or 0)))}
    return np.array([rank[d] for d in ids], np.int64) * (1 << 40) + start


def earlier_across(shard: np.ndarray, strings: np.ndarray, moment: np.ndarray) -> np.ndarray:
    """Whether an equal string starts earlier in any shard. Each shard's sorted strings are merged into those of the shards before it by binary search."""
    merged, least = np.zeros(0, strings.dtype), np.zeros(0, np.int64)
    for one in np.unique(shard):
        own = np.flatnonzero(shard == one)
        own = own[np.argsort(strings[own], kind="stable")]
        s, when = strings[own], moment[own]
        first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        s, when = s[first], np.minimum.reduceat(when, first)
        at = np.searchsorted(merged, s)
        known = np.zeros(len(s), bool)
        known[at < len(merged)] = merged[at[at < len(merged)]] == s[at < len(merged)]
        least[at[known]] = np.minimum(least[at[known]], when[known])
        merged, least = np.insert(merged, at[~known], s[~known]), np.insert(least, at[~known], when[~known])
    return moment > least[np.searchsorted(merged, strings)]


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """key, spans: array<struct<start, n, which>> of the strings of each row that also start earlier, as in substrings.repeated_windows.

    A sketch of anchors (_repeats.sketch) leaves out text that can't repeat. Runs of strings under equal anchors are grouped: of equal runs all
    but the earliest are repeated throughout. Where an anchor has several different runs, one of each, cut from its text only then, goes to a shard: shards are dealt by anchor, so equal
    strings meet, and the shard's suffix array with its common prefixes says which strings start earlier. An anchor with very many runs is dealt over several shards;
    what each finds first is merged by binary search in their sorted strings (earlier_across), by parts of the strings so that no group grows with the anchor.
    """
    unit = Unit(length, gram, byte_symbols, raw=True)
    docs = keyed(docs)
    sent = docs.sparkSession.sparkContext.broadcast(sketch(docs, unit))

    def of(batches):
        bits = sent.value
        for batch in batches:
            for part in chunks(batch, "text"):
                runs = runs_of(Texts(part.column("text")), unit)
                keep = np.flatnonzero(estimated_repeated(runs.anchor, bits))
                own = pa.array(runs.text[keep])
                head = np.diff(runs.text[keep], prepend=-1) != 0
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("key").take(own),
                        part.column("doc_id").take(own),
                        pa.array(runs.start[keep]),
                        pa.array(runs.count[keep].astype(np.int32)),
                        pa.array(runs.anchor[keep].view(np.int64)),
                        pa.array(runs.covered(keep, unit).view(np.int64)),
                        pa.array(head),
                    ],
                    ["key", "doc_id", "start", "n", "anchor", "run", "head"],
                )

    rows = materialize(docs.transform(in_batches, of, "key bigint, doc_id bigint, start bigint, n int, anchor bigint, run bigint, head boolean"))
    classes = rows.groupBy("anchor", "run").agg(F.min(F.struct("doc_id", "start", "key")).alias("first"), F.first("n").alias("n"), F.count("*").alias("copies"))
    classes = materialize(classes.select("anchor", "run", F.struct("first.doc_id", "first.start").alias("at"), F.col("first.key").alias("key"), "n", "copies"))
    several = materialize(
        classes.groupBy("anchor").agg(F.count("*").alias("runs"), F.sum(F.col("n") + (length - 1)).alias("bytes")).where("runs > 1")
    )
    total = several.agg(F.sum("bytes")).first()[0] or 0
    shards = max(1, -(-total // SHARD_BYTES))
    parts = F.ceil(F.col("runs") / ANCHOR_ROWS)
    wanted = classes.join(several.select("anchor", "runs"), "anchor").select(
        "key",
        F.struct(
            F.pmod(F.xxhash64("anchor", F.pmod("run", parts)), F.lit(shards)).alias("shard"),
            "anchor",
            "run",
            "at.doc_id",
            "at.start",
            "n",
            parts.cast("int").alias("parts"),
        ).alias("run"),
    )
    wanted = wanted.groupBy("key").agg(F.collect_list("run").alias("runs"))

    def cut(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                runs = part.column("runs")
                at = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(runs)))])
                values = pa.RecordBatch.from_struct_array(runs.flatten())
                starts, n = values.column("start").to_pylist(), values.column("n").to_pylist()
                stretches = []
                for text, a, b in zip(part.column("text"), at[:-1].tolist(), at[1:].tolist(), strict=True):
                    data = text.as_py().encode()
                    stretches += [data[starts[i] : starts[i] + n[i] + length - 1] for i in range(a, b)]
                yield values.append_column("stretch", pa.array(stretches, pa.binary()))

    texts = docs.select("key", "text")
    again = materialize(rows.where("head").groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"))
    if not again.isEmpty():  # of equal rows one is cut
        texts = texts.join(again, "key", "left_anti").unionByName(texts.join(again, "key", "left_semi").groupBy("key").agg(F.first("text").alias("text")))
    open_ = texts.join(wanted, "key").transform(
        in_batches, cut, "shard bigint, anchor bigint, run bigint, doc_id bigint, start bigint, n int, parts int, stretch binary"
    )

    def judge(table: pa.Table) -> pa.Table:
        stretches = table.column("stretch").to_pylist()
        start = np.asarray(table.column("start"))
        windows = np.asarray(table.column("n")).astype(np.int64)
        where = _moments(table.column("doc_id").to_pylist(), start)
        earlier = earlier_in_shard(stretches, where, windows, length)
        at = np.concatenate([[0], np.cumsum(windows)])
        which, strings = [], []
        for s, a, b, parts in zip(stretches, at[:-1], at[1:], table.column("parts").to_pylist(), strict=True):
            gone = np.flatnonzero(earlier[a:b])
            which.append(gone.astype(np.int32))
            stay = np.flatnonzero(~earlier[a:b]).tolist() if parts > 1 else []
            strings.append([{"i": i, "s": s[i : i + length]} for i in stay])
        columns = [table.column(c) for c in ("shard", "anchor", "run", "doc_id", "start", "parts")]
        columns += [pa.array(which, pa.list_(pa.int32())), pa.array(strings, pa.list_(pa.struct([("i", pa.int32()), ("s", pa.binary())])))]
        return pa.table(columns, names=["shard", "anchor", "run", "doc_id", "start", "parts", "which", "strings"])

    def merge(table: pa.Table) -> pa.Table:
        # numpy drops zero bytes at the end of a string, so each gets another byte there
        strings = np.array([x + b"." for x in table.column("s").to_pylist()], f"S{length + 1}")
        moment = _moments(table.column("doc_id").to_pylist(), np.asarray(table.column("start")))
        late = earlier_across(np.asarray(table.column("shard")), strings, moment)
        return table.select(["anchor", "run", "i"]).filter(pa.array(late))

    judged = materialize(
        open_.groupBy("shard").applyInArrow(
            judge,
            "shard bigint, anchor bigint, run bigint, doc_id bigint, start bigint, parts int, which array<int>, strings array<struct<i:int,s:binary>>",
        )
    )
    dealt = judged.where("parts > 1").select("*", F.explode("strings").alias("x"))
    dealt = dealt.select("shard", "anchor", "run", "doc_id", (F.col("start") + F.col("x.i")).alias("start"), "x.i", "x.s", F.pmod(F.xxhash64("x.s"), "parts").alias("part"))
    late = dealt.groupBy("anchor", "part").applyInArrow(merge, "anchor bigint, run bigint, i int")
    late = late.groupBy("anchor", "run").agg(F.collect_list("i").alias("more"))
    which = judged.select("anchor", "run", "which").join(late, ["anchor", "run"], "left")
    which = which.select("anchor", "run", F.concat("which", F.coalesce("more", F.array().cast("array<int>"))).alias("which"))
    found = classes.where("copies > 1").select("anchor", "run", "at").join(which, ["anchor", "run"], "full")
    found = materialize(found.where("at is not null or size(which) > 0"))
    # the earliest of equal runs loses the listed strings, the others all
    all_ = rows.select("key", "doc_id", "start", "n", "anchor", "run").join(found, ["anchor", "run"])
    later = F.col("at").isNotNull() & (F.struct("doc_id", "start") > F.col("at"))
    all_ = all_.select(
        "key", F.struct("start", "n", F.when(~later, F.coalesce("which", F.array().cast("array<int>"))).alias("which")).alias("span")
    ).where("span.which is null or size(span.which) > 0")
    return all_.distinct().groupBy("key").agg(F.collect_list("span").alias("spans"))


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed stretches) and kept (the bytes that stay) of each row.

    A byte goes if a string of `length` bytes covers it that also starts earlier: in a row with a smaller doc_id (null before all), or earlier in the same row. Texts
    are UTF-8 bytes, null is empty; strings lie within one text, may overlap, and are judged on the input. Of rows that share a doc_id neither is
    the earlier one, unless the string starts earlier in its text. Extra columns are not read.
    """
    spans = repeated_spans(docs, length, gram).withColumnRenamed("key", "k")

    def of(batches):
        for batch in batches:
            out = []
            for text, mask in zip(batch.column("text"), covered(batch.column("spans"), length), strict=True):
                own = text.as_py().encode()
                removed = parts = 0
                n = len(own)
                if mask:
                    gone = mask(n)
                    removed = int(gone.sum())
                    parts = int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum())
                    own = np.frombuffer(own, np.uint8)[~gone].tobytes()
                out.append((n, removed, parts, own))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array([o[i] for o in out], pa.int64() if i < 3 else pa.binary()) for i in range(4))],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    rows = keyed(docs).join(spans, F.col("key") == F.col("k"), "left").select("doc_id", "text", "spans")
    return rows.transform(in_batches, of, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
