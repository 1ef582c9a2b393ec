"""Document fingerprints by winnowing, with DataFrame expressions alone."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import materialize, width

#: Words of a gram and grams of a window. Any GRAM + WINDOW - 1 equal words in a row share a fingerprint.
GRAM, WINDOW = 3, 6
#: Words are runs without white space. In a run of more than 32 characters, as of a script without spaces, each character is a word, so that what is selected doesn't depend on where the run began.
WORD = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]{1,32}+(?![^\x20\x09-\x0D])|[^\x20\x09-\x0D]"
#: Bits by which a gram's hash turns from word to word.
_TURN = 21
_MOST = (1 << 63) - 1


def _turned(x: str, times: int) -> str:
    n = _TURN * times % 64
    return f"(shiftleft({x}, {n}) | shiftrightunsigned({x}, {64 - n}))" if n else x


def with_grams(df: DataFrame, text: str, out: str, gram: int = GRAM) -> DataFrame:
    """Adds the 63-bit hashes of all grams in order.

    They roll (cyclic polynomial): a gram's hash is the one before it, turned, with the word that leaves taken out and the word that comes put in by exclusive or. Each
    word is hashed once; the few terms of a gram are written out here, so that no gram waits for the one before it.
    """
    df = df.withColumn("w", F.transform(F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0)), lambda x: F.xxhash64(x)))
    terms = " ^ ".join([_turned("x", gram - 1), *(_turned(f"get(w, i + {j})", gram - 1 - j) for j in range(1, gram))])
    return df.withColumn(
        out,
        F.expr(
            f"case when w is null or size(w) = 0 then cast(array() as array<bigint>)"
            f" when size(w) < {gram} then array(aggregate(w, 0L, (a, x) -> {_turned('a', 1)} ^ x) & {_MOST}L)"
            f" else transform(slice(w, 1, size(w) - {gram - 1}), (x, i) -> ({terms}) & {_MOST}L) end"
        ),
    ).drop("w")


def with_selected(df: DataFrame, grams: str, window: int = WINDOW) -> DataFrame:
    """Replaces the hashes by array<struct<position, hash>> of those that are least in a window of `window` grams; of equal hashes the rightmost is taken."""
    g = grams
    at = ["x", *(f"get({g}, i + {j})" for j in range(1, window))]
    least = lambda n: at[0] if n == 1 else f"least({', '.join(at[:n])})"
    rightmost = " ".join(f"when {at[j]} <= {least(j)} then {j}" for j in range(window - 1, 0, -1))
    chosen = f"case {rightmost} else 0 end" if rightmost else "0"
    df = df.withColumn(
        "at",
        F.expr(
            f"case when size({g}) = 0 then cast(array() as array<int>)"
            f" when size({g}) <= {window} then array(size({g}) - cast(array_position(reverse({g}), array_min({g})) as int))"
            f" else array_distinct(transform(slice({g}, 1, size({g}) - {window - 1}), (x, i) -> i + {chosen})) end"
        ),
    )
    return df.withColumn(g, F.expr(f"transform(at, p -> named_struct('position', p, 'hash', get({g}, p)))")).drop("at")


def winnow(df: DataFrame, text: str = "text", out: str = "fingerprint", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Adds `out`: array<struct<position, hash>>, the selected grams in order of their windows.

    Positions count words from 0. A text with fewer words than a gram has one gram, all its words; one with fewer grams than a
    window has one window. Null, empty and white-space texts have an empty array. The work columns w, at and `out` must not be in df.
    """
    return with_selected(with_grams(df, text, out, gram), out, window)


def likeness(a: Column, b: Column) -> Column:
    """Dice's coefficient of two arrays of distinct hashes; 1 if both are empty."""
    both = F.size(a) + F.size(b)
    return F.when(both == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / both)


def buckets(df: DataFrame, per_partition: int = 4) -> list[tuple[int, int]]:
    """Lower ends (k, h) of ranges of about equal row counts, a few times as many as shuffle partitions. A key k that fills several ranges is split by h, which is even."""
    n = width(df.sparkSession) * per_partition
    low, some = df.agg(F.min("k"), F.percentile_approx("k", [i / n for i in range(1, n)], F.lit(min(10 * n, 1_000_000)))).first()
    if low is None:
        return [(0, -(1 << 63))]
    return sorted({(k, (j << 64) // c - (1 << 63)) for k, c in Counter([low, *some]).items() for j in range(c)})


def with_bucket(df: DataFrame, bounds: list[tuple[int, int]]) -> DataFrame:
    """Adds bucket, the number of the range that (k, h) lies in, by binary search."""
    steps = F.array(*(F.lit(1 << s) for s in range(len(bounds).bit_length() - 1, -1, -1)))
    ks, hs = (F.split(F.lit(",".join(str(b[i]) for b in bounds)), ",").cast("array<bigint>") for i in range(2))
    find = F.aggregate(
        steps,
        F.lit(0),
        lambda at, s: F.when((F.get(ks, at + s - 1) < F.col("k")) | ((F.get(ks, at + s - 1) == F.col("k")) & (F.get(hs, at + s - 1) <= F.col("h"))), at + s).otherwise(at),
    )
    return df.withColumn("bucket", find - 1)


def with_next(df: DataFrame) -> DataFrame:
    """Rows of df (k, h, text and more) with bucket and ghost: each range holds its rows and, as a ghost, the first row of the next range that has any (the last range: of the first).

    Within a bucket, ordered by ghost, k, h and text, the row after another is thus the next row of the whole table.
    """
    df = with_bucket(df, buckets(df.select("k")))
    heads = materialize(df.groupBy("bucket").agg(F.min(F.struct("k", "h", "text")).alias("m")))
    some = sorted(r["bucket"] for r in heads.select("bucket").collect())  # as many as ranges
    before = df.sparkSession.createDataFrame(list(zip(some, some[-1:] + some[:-1], strict=True)), "bucket int, before int")
    ghosts = heads.join(F.broadcast(before), "bucket").select(F.col("before").alias("bucket"), "m.k", "m.h", "m.text", F.lit(True).alias("ghost"))
    return df.withColumn("ghost", F.lit(False)).unionByName(ghosts, allowMissingColumns=True).repartition(width(df.sparkSession), "bucket")


def fingerprints(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Fingerprints of each text and of its edited text, and how alike they are.

    The edited text has its last floor(n / 4) characters replaced by the first as many of the next document's text, in order of
    doc_id (then of the text's xxhash64 and the text, for rows with one doc_id); the first follows the last, and a single row follows itself. Returns doc_id, n_chars, edited_sha256,
    keys and edited_keys (array<struct<position, hash>>), near_edited, near_next. A null text is empty; a null doc_id comes first. Equal rows give equal numbers of rows.
    Documents travel once, to ranges of ids; each range meets the next one's first row. An id that very many rows share is split over several ranges.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("k", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63)))).withColumn("h", F.xxhash64("text"))
    docs = with_next(docs)
    docs = with_selected(with_grams(docs, "text", "keys", gram), "keys", window)
    in_order = Window.partitionBy("bucket").orderBy("ghost", "k", "h", "text")
    docs = docs.select(
        "*", F.lead("text").over(in_order).alias("next_text"), F.lead("keys").over(in_order).alias("next_keys")
    ).where("not ghost")
    docs = docs.withColumn("n_chars", F.length("text").cast("bigint"))
    docs = docs.withColumn(
        "edited",
        F.expr(
            "concat(substring(text, 1, cast(n_chars - n_chars div 4 as int)), substring(next_text, 1, cast(n_chars div 4 as int)))"
        ),
    )
    docs = with_selected(with_grams(docs, "edited", "edited_keys", gram), "edited_keys", window)
    hashes = lambda c: F.array_distinct(F.transform(c, lambda x: x["hash"]))
    docs = docs.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "keys",
        "edited_keys",
        hashes("keys").alias("a"),
        hashes("edited_keys").alias("b"),
        hashes("next_keys").alias("c"),
    )
    return docs.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "keys",
        "edited_keys",
        likeness(F.col("a"), F.col("b")).alias("near_edited"),
        likeness(F.col("a"), F.col("c")).alias("near_next"),
    )
