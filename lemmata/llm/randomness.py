"""Secret scans: fixed patterns, and tokens that a battery of randomness tests can't tell from chance and that are too odd for ordinary text."""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import in_batches, materialize

#: Kinds in the order in which they are listed, with their patterns.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Tokens that are tested.
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
#: Lower ends of the lengths within which discoveries are counted.
LENGTHS = (20, 24, 32, 48, 64, 128)
#: Level of the battery: of random tokens about so many are lost to it.
LEVEL = 1e-5
#: Expected share of ordinary tokens among those found.
FALSE_SHARE = 0.05
#: -log2 of the chance under ordinary text counts up to here.
MOST_BITS = 64

_ORDER = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
_VALUES = {k: {c: i for i, c in enumerate(v)} for k, v in _ORDER.items()}
#: Cells of the chi-squared test: upper ends of ranges of values, so that short tokens still fill them.
_CELLS = {"hex": (2, 4, 6, 8, 10, 12, 14, 16), "base32": (5, 10, 16, 21, 26, 32), "base64": (13, 26, 39, 52, 64)}


def encoding_of(token: str) -> tuple[str, str]:
    """The smallest encoding that has all characters, and the token in that encoding's own alphabet, without padding."""
    token = token.rstrip("=")
    low = token.lower()
    if (token == low or token == token.upper()) and not set(low) - set(_ORDER["hex"]):
        return "hex", low
    if not set(token) - set(_ORDER["base32"]):
        return "base32", token
    return "base64", token.replace("-", "+").replace("_", "/").replace("=", "")


def _normal(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _chi_tail(x: float, k: int) -> float:
    """Upper tail of chi-squared with k degrees of freedom (Wilson and Hilferty)."""
    z = ((max(x, 1e-12) / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k))
    return 0.5 * math.erfc(z / math.sqrt(2))


def p_values(token: str) -> tuple[float, float, float]:
    """Uniformity, runs above and below the middle, correlation of neighbours: chance of values as odd in a random token."""
    kind, text = encoding_of(token)
    v = [_VALUES[kind][c] for c in text]
    n, cells, top = len(v), _CELLS[kind], len(_ORDER[kind])
    if n < 8:
        return 0.0, 0.0, 0.0
    seen = [0] * len(cells)
    for x in v:
        seen[next(i for i, end in enumerate(cells) if x < end)] += 1
    widths = [b - a for a, b in zip((0, *cells), cells, strict=False)]
    chi = sum((s - n * w / top) ** 2 / (n * w / top) for s, w in zip(seen, widths, strict=True))
    high = [2 * x >= top for x in v]
    a = sum(high)
    b = n - a
    if not a or not b:
        runs = 0.0
    else:
        mean = 2 * a * b / n + 1
        spread = (mean - 1) * (mean - 2) / (n - 1)
        count = 1 + sum(x != y for x, y in zip(high, high[1:], strict=False))
        runs = _normal((count - mean) / math.sqrt(spread)) if spread > 0 else 0.0
    middle = sum(v) / n
    total = sum((x - middle) ** 2 for x in v)
    serial = sum((x - middle) * (y - middle) for x, y in zip(v, v[1:], strict=False)) / total if total else 1.0
    return _chi_tail(chi, len(cells) - 1), runs, _normal((serial + 1 / n) * math.sqrt(n))


def randomness(token: str) -> float:
    """Fisher's combination of the battery: about even in 0..1 for random tokens, about 0 for words."""
    if token.isalpha() and token[1:].islower():
        return 0.0  # a word: all values in one part of any alphabet that has them
    p = p_values(token)
    if min(p) <= 0:
        return 0.0
    return _chi_tail(-2 * sum(map(math.log, p)), 6)


#: Ordinary text: chances of a lower-case letter, an upper-case letter, a digit and a sign after each state, and letters by 1,000 (European languages).
_NEXT = {
    "start": (0.50, 0.30, 0.15, 0.05),
    "lower": (0.86, 0.04, 0.03, 0.07),
    "upper": (0.70, 0.20, 0.03, 0.07),
    "caps": (0.05, 0.82, 0.05, 0.08),
    "digit": (0.06, 0.05, 0.76, 0.13),
    "sign": (0.50, 0.20, 0.20, 0.10),
}
_LETTERS = dict(zip("abcdefghijklmnopqrstuvwxyz", (78, 18, 33, 41, 132, 16, 21, 34, 76, 5, 13, 43, 27, 76, 66, 25, 4, 67, 69, 73, 38, 14, 12, 4, 12, 8), strict=True))


def _text_bits() -> dict[str, tuple[dict[str, float], str]]:
    """For each state and character: bits of the character there, and the next state (caps: at least two upper-case letters in a row)."""
    out, all_ = {}, sum(_LETTERS.values())
    for state, (lower, upper, digit, sign) in _NEXT.items():
        at = {c: (-math.log2(lower * n / all_), "lower") for c, n in _LETTERS.items()}
        at |= {c.upper(): (-math.log2(upper * n / all_), "caps" if state in ("upper", "caps") else "upper") for c, n in _LETTERS.items()}
        at |= {c: (-math.log2(digit / 10), "digit") for c in "0123456789"}
        out[state] = at | {c: (-math.log2(sign / 5), "sign") for c in "+/_=-"}
    return out


_TEXT_BITS = _text_bits()


def oddness(token: str) -> int:
    """-log2 of a bound on the chance that ordinary text looks as random as this, rounded down; 0 to MOST_BITS.

    By Markov's inequality text reaches a likelihood ratio (random to text) of r with a chance of at most 1 / r. A random token has one of four alphabets (hex in either case, base32, base64).
    """
    if randomness(token) < LEVEL:
        return 0
    kind, text = encoding_of(token)
    state, bits = "start", -2.0
    for c in token.rstrip("="):
        more, state = _TEXT_BITS[state][c]
        bits += more
    return max(0, min(MOST_BITS, math.floor(bits - len(token.rstrip("=")) * math.log2(len(_ORDER[kind])))))


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and without overlaps in each kind."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[1])))


def tested_tokens(text: str, base: list[tuple[int, str, int]]) -> list[tuple[int, int, int]]:
    """(start, end, oddness) of tokens that overlap no base span. Both come in order, so each base span is passed once."""
    out, ends, i = [], -1, 0
    for m in TOKEN.finditer(text):
        while i < len(base) and base[i][0] < m.end():
            ends = max(ends, base[i][2])
            i += 1
        if ends <= m.start():
            out.append((m.start(), m.end(), oddness(m[0])))
    return out


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, kind, b in spans)


def tested_rows(docs: DataFrame) -> DataFrame:
    """Base spans of each row, its tested tokens that some threshold may let in, and how many were tested in each range of lengths; written once."""

    def of(batches):
        for batch in batches:
            base, counts, tested, sizes = [], [], [], []
            for text in batch.column("text"):
                text = text.as_py() or ""
                found = base_spans(text)
                base.append([{"start": a, "kind": KINDS.index(k), "end": b} for a, k, b in found])
                counts.append([sum(k == kind for _, k, _ in found) for kind in KINDS[:3]])
                tokens = tested_tokens(text, found)
                tested.append([{"start": a, "end": b, "bits": x} for a, b, x in tokens if x])
                ranges = [stratum_of(b - a) for a, b, _ in tokens]
                sizes.append([ranges.count(i) for i in range(len(LENGTHS))])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    *(pa.array([c[i] for c in counts], pa.int64()) for i in range(3)),
                    pa.array(base, pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))),
                    pa.array(tested, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("bits", pa.int32())]))),
                    pa.array(sizes, pa.list_(pa.int64())),
                ],
                ["doc_id", "n_assign", "n_access", "n_hex", "base", "tested", "sizes"],
            )

    return materialize(
        docs.select(F.col("doc_id").cast("bigint"), "text").transform(
            in_batches,
            of,
            "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base array<struct<start:bigint,kind:int,end:bigint>>,"
            " tested array<struct<start:bigint,end:bigint,bits:int>>, sizes array<bigint>",
        )
    )


def stratum_of(n: int) -> int:
    return sum(n >= x for x in LENGTHS[1:])


def thresholds(rows: DataFrame) -> list[int]:
    """For each range of lengths the least oddness at which the tokens found hold the share of ordinary ones (Benjamini and Hochberg, over whole bits)."""
    sizes = rows.agg(*(F.sum(F.get("sizes", F.lit(i))) for i in range(len(LENGTHS)))).first()
    tokens = rows.select(F.explode("tested").alias("t")).select((F.col("t.end") - F.col("t.start")).alias("n"), "t.bits")
    stratum = sum(((F.col("n") >= x).cast("int") for x in LENGTHS[1:]), F.lit(0))
    seen = [[0] * (MOST_BITS + 1) for _ in LENGTHS]
    for row in tokens.groupBy(stratum.alias("s"), "bits").count().collect():  # MOST_BITS rows at most for each range of lengths
        seen[row["s"]][row["bits"]] = row["count"]
    return [
        next((x for x in range(1, MOST_BITS + 1) if sum(found[x:]) and tested * 2.0**-x <= FALSE_SHARE * sum(found[x:])), MOST_BITS + 1)
        for tested, found in zip(sizes, seen, strict=True)
    ]


def scan(docs: DataFrame) -> DataFrame:
    """Spans of secrets in each whole text.

    Returns doc_id, n_assign, n_access, n_hex, n_random, base array<string> and spans array<struct<start, kind, end>> by start and kind; positions count characters and ends
    are exclusive. A null text is empty and has no spans. One row for each row; extra columns are not read.

    Base spans come from fixed patterns. Further tokens of 20 characters and more are tested in their inferred encoding: those that the battery doesn't reject as random have a
    chance of looking that random if they were ordinary text (oddness). For each range of lengths, over all rows, those with the least chances are taken as long as the expected share of ordinary tokens among
    them is at most FALSE_SHARE. A token that is random enough is thus found on its own strength, whatever else the table has.
    """
    rows = tested_rows(docs)
    limits = thresholds(rows)

    def limit(n):
        at = F.when(n < LENGTHS[1], F.lit(limits[0]))
        for x, t in zip(LENGTHS[2:], limits[1:-1], strict=True):
            at = at.when(n < x, F.lit(t))
        return at.otherwise(F.lit(limits[-1]))

    more = F.transform(
        F.filter("tested", lambda t: t["bits"] >= limit(t["end"] - t["start"])),
        lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("kind"), t["end"].alias("end")),
    )
    names = F.array(*map(F.lit, KINDS))
    told = lambda c: F.transform(
        c, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    )
    rows = rows.withColumn("more", more).withColumn("all", F.array_sort(F.concat("base", "more")))
    return rows.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.size("more").cast("bigint").alias("n_random"), told("base").alias("base"), told("all").alias("spans")
    )


def without_secrets(docs: DataFrame) -> DataFrame:
    """docs with each secret replaced by its kind in brackets, and n_chars to match. Other texts, and all other columns, stay as they are.

    Of overlapping spans the union is replaced, under the first one's kind. The text is not moved: thresholds come from the scan, and each row
    is scanned again where it lies.
    """
    limits = thresholds(tested_rows(docs))

    def clean(text: str | None) -> str | None:
        if text is None:
            return None
        base = base_spans(text)
        spans = base + [(a, "random", b) for a, b, x in tested_tokens(text, base) if x >= limits[stratum_of(b - a)]]
        out, at = [], 0
        for a, kind, b in sorted(spans, key=lambda s: (s[0], KINDS.index(s[1]))):
            if a >= at:
                out += [text[at:a], f"[{kind}]"]
            at = max(at, b)
        return text if not spans else "".join(out) + text[at:]

    def of(batches):
        for batch in batches:
            i = batch.schema.get_field_index("text")
            texts = pa.array([clean(t.as_py()) for t in batch.column(i)], batch.schema.field(i).type)
            batch = batch.set_column(i, batch.schema.field(i), texts)
            if (j := batch.schema.get_field_index("n_chars")) >= 0:
                sizes = pa.array([None if t is None else len(t) for t in texts.to_pylist()], batch.schema.field(j).type)
                batch = batch.set_column(j, batch.schema.field(j), sizes)
            yield batch

    return docs.transform(in_batches, of, docs.schema)
