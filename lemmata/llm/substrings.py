"""Substring dedup: word windows that occur more than once, found behind a count-min sketch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Texts, chunks, in_batches, materialize
from ._repeats import Unit, covered, estimated_repeated, keyed, runs_of, sketch, window_hashes, word_symbols

#: Words of a window, and of the grams that anchor it.
WORDS, GRAM = 35, 18
#: Runs that share an anchor are looked up in so many parts, as one anchor may have very many.
PARTS = 8


def repeated_windows(docs: DataFrame, words: int = WORDS, gram: int = GRAM) -> DataFrame:
    """key, spans: array<struct<start, n, which>> of the windows of each row that occur more than once; rows without any are absent.

    start is the first window's first word, n counts windows, which lists those that repeat (null: all n).

    Pass one sketches the anchors of all windows (_repeats.sketch). Pass two groups exactly, and only runs of windows whose anchor the
    sketch may have seen twice: equal runs first, so that copies cost a row each before the shuffle, then single windows of the runs that share an anchor with other runs. Equal windows are
    those with equal hashes of both the anchor and the window.
    """
    unit = Unit(words, gram, word_symbols)
    docs = keyed(docs)
    sent = docs.sparkSession.sparkContext.broadcast(sketch(docs, unit))

    def of(batches):
        bits = sent.value
        for batch in batches:
            for part in chunks(batch, "text"):
                runs = runs_of(Texts(part.column("text")), unit)
                keep = np.flatnonzero(estimated_repeated(runs.anchor, bits))
                hashes, at = window_hashes(runs, unit, keep)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("key").take(pa.array(runs.text[keep])),
                        pa.array(runs.start[keep].astype(np.int32)),
                        pa.array(runs.count[keep].astype(np.int32)),
                        pa.array(runs.anchor[keep].view(np.int64)),
                        pa.array(runs.covered(keep, unit).view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(hashes.view(np.int64))),
                    ],
                    ["key", "start", "n", "anchor", "run", "windows"],
                )

    rows = materialize(docs.transform(in_batches, of, "key bigint, start int, n int, anchor bigint, run bigint, windows array<bigint>"))
    classes = materialize(rows.groupBy("anchor", "run").agg(F.count("*").alias("copies"), F.first("windows").alias("windows")))
    several = classes.groupBy("anchor").agg(F.count("*").alias("runs")).where("runs > 1")
    several = several.select("anchor", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    dealt = classes.withColumn("part", F.pmod("run", F.lit(PARTS)).cast("int")).join(several, ["anchor", "part"], "left_semi")
    open_ = materialize(dealt.select("anchor", "run", "copies", F.posexplode("windows").alias("i", "window")))
    again = open_.groupBy("anchor", "window").agg(F.sum("copies").alias("c")).where("c > 1").select("anchor", "window")
    which = open_.where("copies = 1").join(materialize(again), ["anchor", "window"]).groupBy("anchor", "run").agg(F.collect_list("i").alias("which"))
    whole = classes.where("copies > 1").select("anchor", "run", F.lit(None).cast("array<int>").alias("which"))
    repeated = materialize(whole.unionByName(which))
    found = rows.select("key", "start", "n", "anchor", "run").join(repeated, ["anchor", "run"])
    return found.select("key", F.struct("start", "n", "which").alias("span")).distinct().groupBy("key").agg(F.collect_list("span").alias("spans"))


def dedup(docs: DataFrame, words: int = WORDS, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that stay, joined by one space) of each row.

    A word goes if a window of `words` words covers it whose words also start anywhere else, in another row or the same. Words are
    runs without ASCII white space, unchanged; windows are judged on the input. Null and white-space texts have no words; texts with fewer words than a window keep
    all. Rows that are equal throughout count as occurrences each, and null ids are ids like others. Extra columns are not read.
    """
    spans = repeated_windows(docs, words, gram).withColumnRenamed("key", "k")

    def of(batches):
        for batch in batches:
            n, removed, kept = [], [], []
            for text, mask in zip(batch.column("text"), covered(batch.column("spans"), words), strict=True):
                own = text.as_py().encode().split()
                n.append(len(own))
                if mask:
                    own = [w for w, gone in zip(own, mask(len(own)).tolist(), strict=True) if not gone]
                removed.append(n[-1] - len(own))
                kept.append(b" ".join(own))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "n_removed", "kept"],
            )

    rows = keyed(docs).join(spans, F.col("key") == F.col("k"), "left").select("doc_id", "text", "spans")
    return rows.transform(in_batches, of, "doc_id bigint, n_words bigint, n_removed bigint, kept string")
