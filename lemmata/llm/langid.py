"""Language identification: sparse multinomial logistic regression on character n-grams."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import in_batches

#: n-grams of one to ORDER characters fall into 2**BITS features.
ORDER, BITS = 3, 15
#: Bounds of the training sample, on which the classifier alone is fitted: texts in all, texts of each language, characters of a text. Of many languages each has
#: fewer texts; of a longer text a piece is taken, at a place chosen by a hash of its id.
TEXTS, TEXTS_EACH, TEXT_CHARS = 20_000, 500, 8000
#: FTRL-proximal: learning rate, its offset, elastic-net penalties, passes.
ALPHA, BETA, L1, L2, PASSES = 0.5, 1.0, 0.02, 0.02, 3
#: One in so many texts of the sample is kept for the temperature.
CALIBRATION = 6
#: Texts with a lower score are rejected as of no known language.
LEAST_SCORE = 0.4
UNKNOWN = "und"
_MAYBE = re.compile(r"[^\W\d_]")
_FACTORS = (2654435761, 2246822519, 3266489917, 668265263, 374761393)


def has_letter(text: str) -> bool:
    """Whether any character is of Unicode's category L; numbers such as a half or a circled one are none."""
    return any(m[0].isalpha() for m in _MAYBE.finditer(text))


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features of a whole text, lower-cased, and 1 + log of their counts."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    counts = np.zeros(1 << BITS, np.int64)
    for a in range(0, len(c), 1 << 20):  # very long texts by pieces that overlap by ORDER - 1
        part = c[a : a + (1 << 20) + ORDER - 1]
        mine = min(len(part), 1 << 20)
        for n in range(1, ORDER + 1):
            m = min(mine, len(part) - n + 1)
            if m <= 0:
                continue
            h = np.full(m, n * 40503 & 0xFFFFFFFF, np.uint32)
            for i in range(n):
                h = (h ^ part[i : i + m]) * np.uint32(_FACTORS[i])
                h ^= h >> np.uint32(15)
            counts += np.bincount(h >> np.uint32(32 - BITS), minlength=1 << BITS)
    at = np.flatnonzero(counts)
    return at, 1 + np.log(counts[at])


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        at, value = features(text)
        value = value * self.idf[at]
        return at, value / (np.sqrt((value**2).sum()) or 1)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        at, value = self.vector(text)
        p = softmax((value @ self.weights[at] + self.bias) / self.temperature)
        best = int(np.argmax(p))
        return self.languages[best], float(p[best])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def fit(texts: list[str], labels: list[str]) -> Model:
    """Follow the regularised leader over the texts in the order given; every CALIBRATION-th text sets the temperature instead."""
    languages = sorted(set(labels))
    size, n = 1 << BITS, max(1, len(languages))
    seen = np.zeros(size)
    raw = [features(t) for t in texts]
    train = [i for i in range(len(texts)) if i % CALIBRATION]
    for i in train:
        seen[raw[i][0]] += 1
    model = Model(languages, np.log((1 + len(train)) / (1 + seen)) + 1, np.zeros((size, n)), np.zeros(n), 1.0)
    vectors = []
    for at, value in raw:
        value = value * model.idf[at]
        vectors.append((at, value / (np.sqrt((value**2).sum()) or 1)))
    model.weights, model.bias = ftrl([vectors[i] for i in train], [languages.index(labels[i]) for i in train], size, n)
    held = [i for i in range(len(texts)) if not i % CALIBRATION]
    scores = [(vectors[i][1] @ model.weights[vectors[i][0]] + model.bias, languages.index(labels[i])) for i in held]
    losses = {
        t: sum(-np.log(max(softmax(s / t)[y], 1e-12)) for s, y in scores) for t in np.exp(np.linspace(np.log(0.05), np.log(5), 60))
    }
    model.temperature = float(min(losses, key=losses.get)) if scores else 1.0
    return model


def ftrl(
    vectors: list[tuple[np.ndarray, np.ndarray]], labels: list[int], size: int, n: int, alpha: float = ALPHA, l1: float = L1, l2: float = L2
) -> tuple[np.ndarray, np.ndarray]:
    """Weights (size x n) and bias of multinomial logistic regression on sparse vectors, by FTRL-proximal with an elastic net."""
    z, g2 = np.zeros((size, n)), np.zeros((size, n))
    bz, bg2 = np.zeros(n), np.zeros(n)
    for _ in range(PASSES):
        for (at, value), label in zip(vectors, labels, strict=True):
            w = weights_of(z[at], g2[at], l1, l2, alpha)
            b = weights_of(bz, bg2, 0.0, 0.0, alpha)
            error = softmax(value @ w + b)
            error[label] -= 1
            grad = value[:, None] * error
            step = (np.sqrt(g2[at] + grad**2) - np.sqrt(g2[at])) / alpha
            z[at] += grad - step * w
            g2[at] += grad**2
            step = (np.sqrt(bg2 + error**2) - np.sqrt(bg2)) / alpha
            bz += error - step * b
            bg2 += error**2
    return weights_of(z, g2, l1, l2, alpha), weights_of(bz, bg2, 0.0, 0.0, alpha)


def weights_of(z: np.ndarray, g2: np.ndarray, l1: float, l2: float, alpha: float) -> np.ndarray:
    return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(g2)) / alpha + l2))


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5, is 0. False for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame) -> Model:
    """Fits on at most TEXTS texts, and of each language TEXTS_EACH, chosen by a hash of the id from texts with text, lang and id that aren't held out.

    A pass without texts counts the languages; a second reads the chosen rows, which go to the driver: a bounded sample. Every language has a text at least, unless there are more than TEXTS.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).where(F.col("lang") != UNKNOWN)
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(TEXTS).collect()
    if not counts:
        return Model([], np.zeros(1 << BITS), np.zeros((1 << BITS, 1)), np.zeros(1), 1.0)
    each = max(1, min(TEXTS_EACH, TEXTS // len(counts)))
    shares = docs.sparkSession.createDataFrame([(r["lang"], int(min(1.0, (1.15 * each + 20) / r["count"]) * (1 << 30))) for r in counts], "known_lang string, share bigint")
    place = F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 30) - 1))
    chosen = known.select("doc_id", "lang", "text").where(F.col("text").rlike(r"\p{L}"))
    chosen = chosen.join(F.broadcast(shares), F.col("lang") == F.col("known_lang")).where(place < F.col("share"))  # TEXTS rows at most
    start = F.lit(1) + F.pmod(F.xxhash64("doc_id", F.lit(2)), F.greatest(F.length("text") - TEXT_CHARS, F.lit(0)) + 1)
    chosen = chosen.select("lang", F.substring("text", start.cast("int"), F.lit(TEXT_CHARS)).alias("text"), F.xxhash64("doc_id", F.lit(1)).alias("h"))
    rows = chosen.orderBy("h", "text").limit(2 * TEXTS).toArrow()
    texts, labels, had = [], [], {}
    for lang, text in zip(rows.column("lang").to_pylist(), rows.column("text").to_pylist(), strict=True):
        if had.get(lang, 0) < each:
            had[lang] = had.get(lang, 0) + 1
            texts.append(text)
            labels.append(lang)
    return fit(texts, labels)


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred and score (calibrated probability, 0 to 1) of each row.

    The prediction sees the whole text and nothing else. Null texts, texts without a letter, and all texts if nothing could be learned, are
    `und` with a score of 0. A null doc_id is not held out and not learned from. One row for each row; extra columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model or train(docs)).__dict__)

    def of(batches):
        model = Model(**sent.value)
        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array([p for p, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    docs = docs.select(F.col("doc_id").cast("bigint"), "text", held_out(F.col("doc_id")).alias("held_out"))
    return docs.transform(in_batches, of, "doc_id bigint, held_out boolean, lang_pred string, score double")


def known_language(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, whose text is in a language that was learned: not `und`, and scored LEAST_SCORE or more. Rows don't move.

    Null and empty texts, and those without a letter, go; so do all if nothing could be learned. Repeated rows stay as often as they are there, null ids are ids like others.
    """
    sent = docs.sparkSession.sparkContext.broadcast(train(docs).__dict__)

    def of(batches):
        model = Model(**sent.value)
        for batch in batches:
            keep = []
            for t in batch.column("text"):
                lang, score = model.predict(t.as_py())
                keep.append(lang != UNKNOWN and score >= LEAST_SCORE)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.transform(in_batches, of, docs.schema)
