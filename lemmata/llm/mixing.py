"""Mixing to target weights: soft membership of documents in domains, and rates fitted by projected gradient."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Texts, chunks, in_batches, materialize, mix
from .langid import ftrl, softmax

#: Word features fall into 2**BITS cells; at most SAMPLE labelled rows of at most TEXT_CHARS characters fit the classifier.
BITS, SAMPLE, TEXT_CHARS = 16, 4000, 20_000
#: Weight of a word that occurs; learning rate and elastic-net penalties of the classifier.
PRESENT, ALPHA, L1, L2 = 0.3, 0.1, 2.0, 0.01
#: Steps at most, and the largest error of a domain's share at which they end; the pull of rates towards 1.
STEPS, CLOSE, PULL = 80, 0.001, 1e-3
#: Rates are written every so many steps; between, each task works them out from there.
KEEP_EVERY = 16
#: Shares of all tokens that are wanted: domains are (quality, toxic) of the labelled table.
TARGETS = {"1/0": 0.88, "0/0": 0.10, "1/1": 0.015, "0/1": 0.005}


@dataclass
class Mixture:
    """What a document's rate depends on: the classifier, and what each step subtracted along the posteriors."""

    domains: list[str]
    weights: np.ndarray
    bias: np.ndarray
    steps: list[tuple[np.ndarray, float]] = field(default_factory=list)  # pull along posteriors, momentum after the step
    shrink: float = 0.0

    def posteriors(self, part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Words and domain posteriors of each text."""
        vectors, words = word_vectors(Texts(part.column("text")))
        p = np.array([softmax(v @ self.weights[at] + self.bias) for at, v in vectors]).reshape(len(words), len(self.domains))
        return words, p

    def rates(self, p: np.ndarray) -> np.ndarray:
        """Rates after all steps. They start from 1."""
        return self.moved(p, np.ones(len(p)), np.ones(len(p)))[0]

    def moved(self, p: np.ndarray, rate: np.ndarray, ahead: np.ndarray, after: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Rates, and where the next step starts, after the steps from number `after` on; each is max(0, rate - pull), with momentum."""
        for pull, momentum in self.steps[after:]:
            new = np.maximum(0.0, ahead - p @ pull - self.shrink * (ahead - 1))
            rate, ahead = new, new + momentum * (new - rate)
        return rate, ahead


def word_vectors(texts: Texts) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each text the cells of the lower-cased words that occur in it, with weights; and its number of words."""
    _, _, words, first = texts.words(lower=True)
    cells = (words & np.uint64((1 << BITS) - 1)).astype(np.int64)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        at = np.unique(cells[a:b])
        out.append((at, np.full(len(at), PRESENT)))
    return out, np.diff(first)


def train(docs: DataFrame, labels: DataFrame, targets: dict[str, float]) -> Mixture:
    """Classifier of the domains (quality/toxic) fitted on at most SAMPLE labelled rows, those with the least hashes of their ids: a bounded sample."""
    domains = sorted(targets)
    named = labels.where("doc_id is not null").select("doc_id", F.concat_ws("/", "quality", "toxic").alias("domain"))
    named = named.where(F.col("domain").isin(domains)).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    chosen = named.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    rows = docs.where("text is not null").where(F.length("text") <= TEXT_CHARS).select("doc_id", "text")
    got = rows.join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id", F.lit(1)), "text").limit(SAMPLE).toArrow()
    n = len(domains)
    if not got.num_rows:
        return Mixture(domains, np.zeros((1 << BITS, n)), np.zeros(n))
    vectors = [v for batch in got.to_batches() for part in chunks(batch, "text") for v in word_vectors(Texts(part.column("text")))[0]]
    labels_ = [domains.index(d) for d in got.column("domain").to_pylist()]
    weights, bias = ftrl(vectors, labels_, 1 << BITS, n, ALPHA, L1, L2)
    bias[np.setdiff1d(np.arange(n), labels_)] = -np.inf  # nothing is known of a domain without labels: it has no posterior
    return Mixture(domains, weights, bias)


def fitted(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> tuple[Mixture, DataFrame]:
    """The mixture, and the written table of doc_id, words and posteriors p that it was fitted on.

    Least squares: nonnegative rates r whose expected domain totals sum(words * p * r) match `targets` shares of all words, with a slight
    pull towards 1. A step needs only the domains' totals at the present rates, one row of sums from each task; rates are written every KEEP_EVERY steps, and each task works them out from
    there. Errors are weighed by 1 / wanted total, so that small domains count and a domain that posteriors hardly show doesn't outweigh the others. Steps are
    accelerated (Nesterov) and scaled by the largest eigenvalue of the domains' moments. A domain without labelled rows can't be told: its posteriors are 0, and the
    others' targets are scaled up to all words, with a warning.
    """
    mixture = train(docs, labels, targets)
    sent = docs.sparkSession.sparkContext.broadcast((mixture.domains, mixture.weights, mixture.bias))

    def score(batches):
        model = Mixture(*sent.value)
        for batch in batches:
            for part in chunks(batch, "text"):
                words, p = model.posteriors(part)
                at = np.arange(len(words) + 1, dtype=np.int32) * p.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(words.astype(np.int64)), pa.ListArray.from_arrays(pa.array(at), pa.array(p.ravel()))],
                    ["doc_id", "words", "p"],
                )

    rows = docs.select(F.col("doc_id").cast("bigint"), "text").transform(in_batches, score, "doc_id bigint, words bigint, p array<double>")
    rows = materialize(rows)
    n = len(mixture.domains)
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    sums = rows.agg(
        F.sum("words").alias("all"), *(F.sum(F.col("words") * F.get("p", F.lit(i)) * F.get("p", F.lit(j))).alias(f"m{i}_{j}") for i, j in pairs)
    ).first()
    if not sums["all"]:
        return mixture, rows
    moments = np.zeros((n, n))
    for i, j in pairs:
        moments[i, j] = moments[j, i] = sums[f"m{i}_{j}"]
    share = np.array([targets[d] for d in mixture.domains]) * np.isfinite(mixture.bias)
    if unknown := [d for d in mixture.domains if targets[d] and not np.isfinite(mixture.bias[mixture.domains.index(d)])]:
        warnings.warn(f"no labelled rows of {', '.join(unknown)}: the other targets are scaled up to all words", stacklevel=3)
    want = share / share.sum() * float(sums["all"])
    scale = np.divide(1.0, want, out=np.zeros(n), where=want > 0)
    top = float(np.linalg.eigvalsh(np.sqrt(scale)[:, None] * moments * np.sqrt(scale)).max()) + PULL
    mixture.shrink = PULL / top
    t, done = 1.0, 0
    one = F.lit(1.0)
    now = rows.select("words", "p", one.alias("rate"), one.alias("ahead"))

    def steps_on(batch, steps, shrink):
        p, rate, ahead = np.asarray(batch.column("p").flatten()).reshape(batch.num_rows, -1), *(np.asarray(batch.column(c)) for c in ("rate", "ahead"))
        return p, *Mixture([], np.zeros(0), np.zeros(0), steps, shrink).moved(p, rate, ahead)

    for k in range(STEPS):

        def advance(batches, steps=mixture.steps[done:], shrink=mixture.shrink):
            for batch in batches:
                _, rate, ahead = steps_on(batch, steps, shrink)
                yield pa.RecordBatch.from_arrays([batch.column("words"), batch.column("p"), pa.array(rate), pa.array(ahead)], ["words", "p", "rate", "ahead"])

        if k and k % KEEP_EVERY == 0:
            now = materialize(now.transform(in_batches, advance, "words bigint, p array<double>, rate double, ahead double"))
            done = len(mixture.steps)

        def total(batches, steps=mixture.steps[done:], shrink=mixture.shrink):
            out = np.zeros(n)
            for batch in batches:
                p, _, ahead = steps_on(batch, steps, shrink)
                out += (np.asarray(batch.column("words")) * ahead) @ p
            yield pa.RecordBatch.from_arrays([pa.array([out.tolist()], pa.list_(pa.float64()))], ["s"])

        parts = now.transform(in_batches, total, "s array<double>")
        have = np.array(parts.agg(*(F.sum(F.get("s", F.lit(i))) for i in range(n))).first(), float)
        error = have - want
        if np.abs(error).max() <= CLOSE * want.sum():
            break
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        mixture.steps = [*mixture.steps, (scale * error / top, (t - 1) / after)]
        t = after
    return mixture, rows


def copies_of(ids: np.ndarray, rates: np.ndarray) -> np.ndarray:
    """Whole numbers of copies with the rates as their means, drawn by a hash of the id."""
    chance = mix(ids.astype(np.int64).view(np.uint64) ^ np.uint64(0x5DEECE66D)) / np.float64(2**64)
    return np.floor(rates + chance).astype(np.int64)


def mixed_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """doc_id, words, domain (most probable), posteriors array<double> in order of the domains' names, rate and copies of each row.

    Texts without words and null texts have the classifier's prior as posteriors and weigh nothing. A null doc_id draws as id 0. Without labels all domains are
    equally probable. Repeated rows get equal rates; extra columns are not read.
    """
    mixture, rows = fitted(docs, labels, targets)
    domains, steps, shrink = mixture.domains, mixture.steps, mixture.shrink

    def of(batches):
        model = Mixture(domains, np.zeros(0), np.zeros(0), steps, shrink)
        for batch in batches:
            p = np.asarray(batch.column("p").flatten()).reshape(batch.num_rows, -1)
            rates = model.rates(p)
            ids = np.asarray(batch.column("doc_id").fill_null(0))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("words"),
                    pa.array([domains[i] for i in p.argmax(axis=1)], pa.string()),
                    batch.column("p"),
                    pa.array(rates),
                    pa.array(copies_of(ids, rates)),
                ],
                ["doc_id", "words", "domain", "posteriors", "rate", "copies"],
            )

    return rows.transform(in_batches, of, "doc_id bigint, words bigint, domain string, posteriors array<double>, rate double, copies bigint")


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """The rows of docs, with all their columns, each as often as its rate says (mixed_rates). Rows don't move: their posteriors are worked out where they lie.

    Rows with one id and text have one rate and draw alike; null texts and null ids are drawn as in mixed_rates. An empty table stays empty.
    """
    mixture, _ = fitted(docs, labels, targets)
    sent = docs.sparkSession.sparkContext.broadcast(mixture.__dict__)

    def of(batches):
        model = Mixture(**sent.value)
        for batch in batches:
            for part in chunks(batch, "text"):
                _, p = model.posteriors(part)
                ids = np.asarray(part.column("doc_id").fill_null(0))
                yield part.take(pa.array(np.repeat(np.arange(part.num_rows), copies_of(ids, model.rates(p)))))

    return docs.transform(in_batches, of, docs.schema)
