"""The operators against brute force, and on awkward rows: nulls, empty and very long texts, ties, repeated rows, empty tables, extra columns."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from lemmata.llm import _graph, bpe, covertree, langid, minhash, mixing, randomness, substrings, suffixes, urls, winnow

SCHEMA = "doc_id bigint, text string, key string, spans string, n int, k bigint, w string"
_rng = random.Random(5)
_WORDS = ["".join(_rng.choice("abcdeé") for _ in range(_rng.randint(1, 6))) for _ in range(400)]


def prose(n, rng=_rng):
    return " ".join(rng.choice(_WORDS) for _ in range(n))


def awkward():
    base, passage = prose(120), prose(60)
    edited = base.split()
    edited[50] = "CHANGED"
    texts = [
        None, "", " \t\n", "one", "one two three four", base, base, base.upper().lower(), " ".join(edited), base + " tail", passage + " " + prose(20), prose(30) + " " + passage + "\n" + prose(9),
        "x" * 3000, "ab" * 700, prose(4000), prose(10) + "　é\U0001f600 " + passage, passage + " " + passage, "\0\0\0" * 50, "\0" * 130,
    ]
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    rows += [rows[5], (None, base), (None, None), (7, prose(50))]
    return rows


@pytest.fixture(scope="module")
def rows():
    return awkward()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(d, t, "key", "spans", 1, 2, "w") for d, t in rows], SCHEMA).repartition(3).cache()


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_row(found):
    return sorted(map(tuple, found), key=repr)


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3), (200, 100)] + [(500, i) for i in range(501, 560)]
    found = _graph.components(spark.createDataFrame(chain, "a bigint, b bigint"))
    got = {r.node: r.component for r in found.collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in (100, 101, 200)} | {i: 500 for i in range(500, 560)}


def test_urls(spark):
    canonical = '<html><link REL="canonical" href={}></html>'
    rows = [
        (1, "http://A.Example.ORG/es/1?x#y", None), (2, "https://example.org/en/12", ""), (3, "http://b.com/de/7", canonical.format("'//c.net/start'")),
        (4, "http://c.net/start#top", '<meta http-equiv="refresh" content="0; url=/next">'), (5, "https://c.net/next", None), (6, "http://org", None), (7, None, None), (8, "no scheme", "x"),
        (9, "http://d.net/a/b", canonical.format('"../c"')), (10, "http://fr.org/", canonical.format("http://c.net/next")), (11, "http://example.org.evil.com/de/", None), (1, "http://A.Example.ORG/es/1?x#y", None),
        (12, "http://x.net/p", canonical.format("https://y.com/de/z")),
    ]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "page_id bigint, url string, html string, rule string")
    got = [tuple(r) for r in urls.judge(df).collect()]
    told = {r[0]: r[1:] for r in got}
    assert len(got) == len(rows)
    assert told[1] == ("a.example.org", "/es/1", "example.org/es/", "block", "rule")
    assert told[2][2:4] == ("example.org/en/1", "block")
    assert told[6] == ("org", "", None, "allow", "default")
    assert told[7] == ("", "", None, "allow", "default") and told[8] == told[7]
    assert told[11][2] == "com/de/"
    # 10 is allowed by org/, so its component (with 3's block) is not blocked as a whole
    assert told[3][3] == "block" and told[4][3:] == ("allow", "default") and told[5][3:] == ("allow", "default") and told[10][3] == "allow"
    assert told[12][2:] == (None, "block", "alias")
    assert urls.judge(df.where("false")).count() == 0


def test_addresses_with_queries_are_apart(spark):
    """A page with ?id=1 that is canonical to a blocked page says nothing of ?id=2; all tags of a page count, and targets are resolved."""
    link = '<link href="{}" rel="{}">'.format
    rows = [
        (1, "http://a.net/v?id=1", link("http://b.com/de/x", "canonical")), (2, "http://a.net/v?id=2", None), (3, "http://a.net/v", None), (4, "https://a.net/v?id=1#part", None),
        (5, "http://c.net/p/q/r", link("/other", "stylesheet") + link("../../s?a=1&amp;b=2", "alternate canonical") + link("./t", "CANONICAL") + "<meta content='1; URL=?z' http-equiv=Refresh>"),
        (6, "http://c.net/s?a=1&b=2", link("http://b.com/de/y", "canonical")), (7, "http://c.net/p/q/t", None), (8, "http://c.net/p/q/r?z", None), (9, "http://d.net", link("http://b.com/de/y", "canonical")),
        (10, "http://d.net/", None), (11, "http://e.net/x", link("http://b.com/de/y", "noncanonical")), (12, "http://c.net/../p/./q/t", None),
    ]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    told = {r.page_id: (r.verdict, r.decided_by) for r in urls.judge(df).collect()}
    blocked = {i for i, (v, _) in told.items() if v == "block"}
    assert blocked == {1, 4, 5, 6, 7, 8, 9, 10, 12} and {told[i][1] for i in blocked} == {"alias"}
    more = spark.createDataFrame([("http://a.net/v?id=2", "http://www.example.org/es/1"), (None, "http://a.net/v")], "a string, b string")
    assert {r.page_id for r in urls.judge(df, redirects=more).collect() if r.verdict == "block"} == blocked | {2}


def brute_winnow(text, k=winnow.GRAM, w=winnow.WINDOW):
    """(position, hash) of the selected grams, in order."""
    words = [x for run in re.findall(r"[^\x20\x09-\x0D]+", text or "") for x in ([run] if len(run) <= 32 else run)]
    turn = lambda x, n: (x << n % 64 | x >> (64 - n % 64)) & (2**64 - 1) if n % 64 else x
    each = [xxhash.xxh64_intdigest(x.encode(), 42) for x in words]
    grams = []
    for i in range(max(1, len(each) - k + 1) if each else 0):
        h = 0
        for x in each[i : i + k]:
            h = turn(h, 21) ^ x
        grams.append(h & (2**63 - 1))
    chosen = []
    for i in range(max(1, len(grams) - w + 1) if grams else 0):
        least = min(range(i, min(i + w, len(grams))), key=lambda p: (grams[p], -p))
        if least not in chosen[-1:]:
            chosen.append(least)
    return [(p, grams[p]) for p in chosen]


def test_winnowing(spark, docs, rows):
    rows = rows + [(901, "a a a a a a a a a a a b"), (902, "漢字かな" * 30), (903, "x" + "漢字かな" * 30)]
    extra = spark.createDataFrame([(d, t) for d, t in rows if d is not None], "doc_id bigint, text string")
    for r in winnow.winnow(extra, out="fp").collect():
        assert [(p.position, p.hash) for p in r.fp] == brute_winnow(r.text), r.doc_id
    one, other = ({h for _, h in brute_winnow(t)} for d, t in rows if d in (902, 903))
    assert len(one & other) >= len(one) - 1  # a character in front moves nothing


def likeness(a, b):
    a, b = ({h for _, h in brute_winnow(t)} for t in (a, b))
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0


def brute_fingerprints(rows):
    key = lambda r: (r[0] is not None, r[0] or 0, np.int64(np.uint64(xxhash.xxh64_intdigest((r[1] or "").encode(), 42))), r[1] or "")
    order = sorted(rows, key=key)
    out = []
    for (d, text), (_, nxt) in zip(order, order[1:] + order[:1], strict=True):
        text, nxt = text or "", nxt or ""
        q = len(text) // 4
        edited = text[: len(text) - q] + nxt[:q]
        out.append((d, len(text), hashlib.sha256(edited.encode()).hexdigest(), brute_winnow(text), brute_winnow(edited), likeness(text, edited), likeness(text, nxt)))
    return out


def test_edited_texts(spark, docs, rows):
    found = winnow.fingerprints(docs).collect()
    plain = lambda keys: [(p.position, p.hash) for p in keys]
    assert by_row((r.doc_id, r.n_chars, r.edited_sha256, plain(r.keys), plain(r.edited_keys), r.near_edited, r.near_next) for r in found) == by_row(brute_fingerprints(rows))
    assert winnow.fingerprints(docs.where("false")).count() == 0
    assert winnow.fingerprints(docs.where("doc_id = 15").limit(1)).first().near_next == 1.0


def test_an_id_of_very_many_rows_is_split(spark):
    rng = random.Random(21)
    rows = [(None, prose(8, rng)) for _ in range(300)] + [(i, prose(8, rng)) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    keyed = docs.withColumn("k", F.coalesce("doc_id", F.lit(-(1 << 63)))).withColumn("h", F.xxhash64("text"))
    sizes = [r["count"] for r in winnow.with_next(keyed).where("not ghost").groupBy("bucket").count().collect()]
    assert max(sizes) < 100 and sum(sizes) == 320
    found = winnow.fingerprints(docs).collect()
    assert by_row((r.doc_id, r.n_chars, r.edited_sha256) for r in found) == by_row(w[:3] for w in brute_fingerprints(rows))


def shingle_sets(rows):
    out = []
    for d, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        out.append((d, {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    return out


def brute_groups(rows):
    sets, up = shingle_sets(rows), {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and 100 * len(x & y) >= 75 * len(x | y):
                hi, lo = max(top(a), top(b)), min(top(a), top(b))
                up[hi] = lo
    return [(d, len(s), None if d is None else top(d) if s else d) for d, s in sets]


def test_near_duplicates(spark, docs, rows, empty):
    found = minhash.near_duplicates(docs).collect()
    assert by_row((r.doc_id, r.n_shingles, r.component_id) for r in found) == by_row(brute_groups(rows))
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in found)
    assert minhash.near_duplicates(empty).count() == 0


def test_variants_that_meet_in_their_source_only(spark):
    rng = random.Random(1)
    base = prose(200, rng).split()
    rows = [(50, " ".join(base))]
    for i in range(40):
        w = list(base)
        for j in rng.sample(range(0, 200, 5), 5):
            w[j] = f"v{i}x{j}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, prose(40, rng) + " " + " ".join(base[:80])) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = minhash.near_duplicates(df).collect()
    assert by_row((r.doc_id, r.n_shingles, r.component_id) for r in found) == by_row(brute_groups(rows))


def test_mixing(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        bad, toxic = i % 5 == 0, i % 7 == 0
        rows.append((i, prose(30, rng) + (" $$$ %%%" if bad else "") + (" insult" if toxic else ""), "x"))
        if i % 2 == 0:
            labels.append((i, int(not bad), int(toxic)))
    rows += [(None, None, "x"), (1000, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, words string")
    labels = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    targets = {"1/0": 0.65, "0/0": 0.21, "1/1": 0.11, "0/1": 0.03}
    found = mixing.mixed_rates(docs, labels, targets).collect()
    assert len(found) == len(rows) and all(r.rate >= 0 and abs(sum(r.posteriors) - 1) < 1e-9 for r in found)
    total = sum(r.words for r in found)
    for i, d in enumerate(sorted(targets)):
        assert abs(sum(r.words * r.rate * r.posteriors[i] for r in found) / total - targets[d]) < 0.02
    kept = mixing.mixed(docs, labels, targets)
    assert kept.schema == docs.schema
    copies = {r.doc_id: r.copies for r in found}
    got = {r.doc_id: r["count"] for r in kept.groupBy("doc_id").count().collect()}
    assert got == {d: c for d, c in copies.items() if c}
    assert mixing.mixed_rates(docs.where("false"), labels).count() == 0
    assert {r.rate for r in mixing.mixed_rates(docs.limit(3), labels.where("false")).collect()} != set()


def test_mixing_without_labels_of_a_domain(spark):
    rng = random.Random(3)
    rows = [(i, prose(30, rng) + (" $$$ %%%" if i % 5 == 0 else "")) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(0, 500, 2)], "doc_id bigint, quality int, toxic int")
    targets = {"1/0": 0.6, "0/0": 0.15, "0/1": 0.25}
    found = mixing.mixed_rates(docs, labels, targets).collect()
    total = sum(r.words for r in found)
    wanted = {"0/0": 0.2, "0/1": 0.0, "1/0": 0.8}
    for i, d in enumerate(sorted(targets)):
        assert abs(sum(r.words * r.rate * r.posteriors[i] for r in found) / total - wanted[d]) < 0.02
    assert all(r.posteriors[1] == 0 for r in found) and max(r.rate for r in found) < 5
    assert 400 < sum(r.copies for r in found) < 600


def test_default_targets_reweigh(spark):
    """Toxic words come down from an eighth to what the default targets want."""
    rng = random.Random(4)
    rows = [(i, prose(30, rng) + (" $$$ %%%" if i % 8 == 1 else "") + (" insult" if i % 8 == 0 else "")) for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 8 != 1), int(i % 8 == 0)) for i in range(0, 800, 3)], "doc_id bigint, quality int, toxic int")
    found = mixing.mixed_rates(docs, labels).collect()
    total = sum(r.words * r.rate for r in found)
    assert sum(r.words for r in found if r.doc_id % 8 == 0) > 0.11 * sum(r.words for r in found)
    assert sum(r.words * r.rate for r in found if r.doc_id % 8 == 0) < 0.03 * total
    assert sum(share for domain, share in mixing.TARGETS.items() if domain.endswith("/1")) < 0.03


def test_secrets(spark, empty):
    hexes = hashlib.md5(b"x").hexdigest()
    rng = random.Random(9)
    blob = "".join(rng.choice(randomness._ORDER["base64"]) for _ in range(60))
    texts = [
        None, "", 'PassWord = "abcdefgh1"', "token: secret: abcdefghijk", "api_key=short", f"AKIA{'A1B2C3D4E5F6'} AKIAB", f"see {hexes}0 é token={hexes}", f"é{hexes}",
        "an ordinary sentence about donaudampfschifffahrtsgesellschaft and antidisestablishmentarianism", f"key is {blob} ok",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in randomness.scan(docs).collect()}
    assert got[0].spans == got[1].spans == got[3].spans == got[4].spans == got[8].spans == []
    assert got[2].base == ["assign:0:21"]
    assert got[5].base == ["access:0:16"]
    assert got[6].base == ["hex:4:37", "assign:40:78", "hex:46:78"] and got[6].n_hex == 2
    assert got[7].base == ["hex:1:33"]
    assert [s.split(":")[0] for s in got[9].spans] == (["random"] if randomness.randomness(blob) >= 0.5 else [])
    clean = {r.doc_id: r.text for r in randomness.without_secrets(docs).collect()}
    assert clean[8] == texts[8] and clean[0] is None and clean[7] == "é[hex]" and clean[2] == '[assign]"'
    assert randomness.scan(empty).count() == 0


def test_isolated_secrets_are_found(spark):
    """Whatever else the table has: alone in its range of lengths, or among many paths, slugs and class names."""
    rng = random.Random(12)
    blobs = ["".join(rng.choice(randomness._ORDER["base64"]) for _ in range(n)) for n in (33, 40, 44, 48, 56, 63) for _ in range(4)]
    assert min(map(randomness.randomness, blobs)) < 0.2
    parts = ["server", "Abstract", "Factory", "2024", "index", "user-guide", "HTTP", "config", "v2", "Bean", "news", "MAX_SIZE"]
    ordinary = [rng.choice("/-_").join(rng.choice(parts) for _ in range(7)) for _ in range(600)]
    for blob in blobs[::6]:
        docs = spark.createDataFrame([(0, f"key is {blob} ok")], "doc_id bigint, text string")
        assert list(randomness.scan(docs).first().spans) == [f"random:7:{7 + len(blob)}"]
    rows = [(i, f"key is {blob} ok") for i, blob in enumerate(blobs)] + [(100 + i, f"see {t} there") for i, t in enumerate(ordinary)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    found = {r.doc_id: list(r.spans) for r in randomness.scan(docs).collect()}
    assert found == {i: [f"random:7:{7 + len(blobs[i])}"] if i < 100 else [] for i in found} and len(found) == len(rows)
    one = spark.createDataFrame(rows[3:4] + rows[len(blobs) :], "doc_id bigint, text string")
    assert {r.doc_id for r in randomness.scan(one).collect() if r.n_random} == {3}
    clean = {r.doc_id: r.text for r in randomness.without_secrets(one).collect()}
    assert clean[3] == "key is [random] ok" and all(clean[d] == t for d, t in rows[len(blobs) :])


def test_randomness_tells_words_from_chance():
    rng = random.Random(3)
    found = [randomness.randomness("".join(rng.choice(randomness._ORDER["base64"]) for _ in range(40))) for _ in range(300)]
    assert 0.35 < np.mean([p > 0.5 for p in found]) < 0.65
    words = ["".join(rng.choice(["the", "ing", "tion", "er", "an"]) for _ in range(12)) + "1" for _ in range(200)]
    assert np.mean([randomness.randomness(w) > 0.01 for w in words]) < 0.02


@pytest.fixture(scope="module")
def ranks():
    return bpe.ranks_from(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def test_bpe(spark, docs, rows, ranks, empty):
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = bpe.encode(docs, ranks, public_tokenizers.PATTERN, digests=False).collect()
    want = [(d, own.encode_ordinary(t or ""), (t or "").encode()) for d, t in rows]
    assert by_row((r.doc_id, list(r.ids), bytes(r.decoded)) for r in found) == by_row(want)
    assert bpe.encode(empty, ranks, public_tokenizers.PATTERN).count() == 0


def test_bpe_pieces(ranks):
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec = bpe.Codec(ranks, public_tokenizers.PATTERN)
    rng = random.Random(4)
    alphabet = list("ab1.,' \n\t\x1c\x85 　 é'sß中\U0001f600") + ["'re", "  ", " \n", "<|endoftext|>"]
    for _ in range(2000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30)))
        ids = np.frombuffer(codec.encode(text), "<u4").tolist()
        assert ids == own.encode_ordinary(text), repr(text)
        assert codec.decode(codec.encode(text)) == text.encode()
    for text in ("a" + " " * 5000 + "b", "\n" * 3000, " " * 2000 + "\nx"):
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == own.encode_ordinary(text)
    assert codec.decode(codec.encode(" " * 2_000_000 + "x")) == b" " * 2_000_000 + b"x"


def test_top_k(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(0, 0.2, (700, 16)).astype(np.float32)
    v[100:160] = v[100]  # equal vectors: ties go to smaller ids
    rows = [(int(i), x.tolist(), "x") for i, x in enumerate(v)]
    rows += [(1000, None, "x"), (1050, [float("nan")] * 16, "x"), (1100, [None] * 16, "x"), (1150, [float("inf")] * 16, "x"), (None, v[0].tolist(), "x"), (1200, [], "x")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, score string").repartition(3)
    found = covertree.top_k(df, df.where("vec_id % 50 = 0")).collect()
    whole = np.floor(256 * v.astype(float)).astype(np.int64)
    want = []
    for q in range(0, 700, 50):
        s = whole @ whole[q]
        order = [i for i in np.lexsort((np.arange(700), -s)) if i != q][:5]
        want += [(q, r + 1, int(i), int(s[i])) for r, i in enumerate(order)]
    assert sorted(map(tuple, found)) == sorted(want)
    few = df.where("vec_id in (0, 50)")
    assert covertree.top_k(few, few).count() == 2
    assert covertree.top_k(df.where("false"), df.where("false")).count() == 0


def test_cover_tree():
    """Nesting, covering and separation of its levels; covering radii; and what is pruned on clustered vectors."""
    rng = np.random.default_rng(1)
    points = np.floor(256 * np.concatenate([rng.normal(c * 10, 0.2, (500, 4)) for c in range(8)]))
    points[7] = points[300]
    tree, best = covertree.CoverTree(points), covertree.Best(50, 5)
    real = tree.nodes[: len({*tree.nodes["centre"].tolist()})]  # those of rows at centres follow
    at, level = points[real["centre"]], real["level"]
    apart = np.sqrt(((at[:, None] - at[None]) ** 2).sum(axis=2))
    for i in range(1, len(real)):
        assert apart[i, real["up"][i]] <= 2.0 ** (level[i] + 1) and level[real["up"][i]] > level[i]
        others = np.flatnonzero((level >= level[i]) & (np.arange(len(real)) != i))
        assert (apart[i, others] > 2.0 ** level[i]).all()
    assert sorted(tree.order.tolist()) == list(range(len(points))) and len(real) > 100
    for node, (lo, hi) in enumerate(tree.stretch):
        far = np.sqrt(((points[tree.order[lo:hi]] - tree.centre[node]) ** 2).sum(axis=1)).max()
        assert far <= tree.radius[node] + 1e-9
        assert not tree.children[node] or sorted(x for c in tree.children[node] for x in range(*tree.stretch[c])) == list(range(lo, hi))
    again = covertree.CoverTree.from_bytes(4, *tree.to_bytes())
    assert (again.points == points[tree.order]).all() and again.stretch == tree.stretch and (again.centre == tree.centre).all()
    queries = covertree.CoverTree(points[-50:])
    scored = covertree.search(queries, np.arange(50), tree, np.arange(len(points)), best)
    assert scored < 50 * len(points) / 4
    score = points[-50:] @ points.T
    score[np.arange(50), np.arange(50)] = -np.inf
    assert (best.score == -np.sort(-score, axis=1)[:, :5]).all()
    centres = rng.normal(0, 1, (40, 64))
    many = np.floor(256 * rng.permutation(np.concatenate([x + rng.normal(0, 0.05, (100, 64)) for x in centres])))
    best, ids = covertree.Best(80, 5), np.arange(len(many))
    scored = covertree.search(covertree.CoverTree(many[::50]), ids[::50], covertree.CoverTree(many), ids, best)
    score = many[::50] @ many.T
    score[np.arange(80), ids[::50]] = -np.inf
    assert (best.score == -np.sort(-score, axis=1)[:, :5]).all() and scored < 0.25 * score.size
    assert covertree.CoverTree(np.zeros((0, 4))).stretch == [] and covertree.CoverTree(np.ones((90, 2))).stretch == [(0, 90)]


def spans_of(which):
    n = sum(1 for i, x in enumerate(which) if x and (i == 0 or not which[i - 1]))
    return sum(which), n


def test_suffix_dedup(spark, docs, rows, empty):
    L = suffixes.LENGTH
    first = {}
    texts = [(d, (t or "").encode()) for d, t in rows]
    key = lambda d: (d is not None, d or 0)
    for d, b in sorted(texts, key=lambda x: key(x[0])):
        for i in range(len(b) - L + 1):
            at = (key(d), i)
            first[b[i : i + L]] = min(first.get(b[i : i + L], at), at)
    want = []
    for d, b in texts:
        gone = [False] * len(b)
        for i in range(len(b) - L + 1):
            if first[b[i : i + L]] < (key(d), i):
                gone[i : i + L] = [True] * L
        want.append((d, len(b), *spans_of(gone), bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    found = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.dedup(docs).collect()]
    assert by_row(found) == by_row(want)
    assert suffixes.dedup(empty).count() == 0


def test_dealt_anchors(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "ANCHOR_ROWS", 2)
    monkeypatch.setattr(suffixes, "SHARD_BYTES", 500)
    rng = random.Random(8)
    passage = prose(40, rng)
    rows = [(i, prose(rng.randint(3, 20), rng) + " " + passage[rng.randint(0, 30) :] + " " + prose(9, rng)) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    L, first = suffixes.LENGTH, {}
    for d, t in rows:
        b = t.encode()
        for i in range(len(b) - L + 1):
            first.setdefault(b[i : i + L], (d, i))
    for r in suffixes.dedup(df).collect():
        b = rows[r.doc_id][1].encode()
        gone = [False] * len(b)
        for i in range(len(b) - L + 1):
            if first[b[i : i + L]] < (r.doc_id, i):
                gone[i : i + L] = [True] * L
        assert r.n_removed == sum(gone)


def test_suffix_array():
    rng = random.Random(6)
    for text in (b"", b"a", b"banana", b"\0\0\0\0", bytes(rng.choice(b"ab") for _ in range(500)), b"abc" * 100):
        if text:
            order = suffixes.suffix_array(np.frombuffer(text, np.uint8)).tolist()
            assert order == sorted(range(len(text)), key=lambda i: text[i:])


def test_substring_dedup(spark, docs, rows, empty):
    L, count = substrings.WORDS, {}
    words = [(d, (t or "").encode().split()) for d, t in rows]
    for _, w in words:
        for i in range(len(w) - L + 1):
            count[tuple(w[i : i + L])] = count.get(tuple(w[i : i + L]), 0) + 1
    want = []
    for d, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - L + 1):
            if count[tuple(w[i : i + L])] > 1:
                gone[i : i + L] = [True] * L
        want.append((d, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    found = [(r.doc_id, r.n_words, r.n_removed, r.kept) for r in substrings.dedup(docs).collect()]
    assert by_row(found) == by_row(want)
    assert substrings.dedup(empty).count() == 0


def test_language(spark, docs, rows):
    sf = "/root/testdata/sf0.01"
    real = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.train(real)
    found = real.select("doc_id", "lang").join(langid.identify(real, model), "doc_id").collect()
    held = [r for r in found if r.held_out]
    assert len(held) > 100 and np.mean([r.lang == r.lang_pred for r in held]) > 0.95
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
    got = langid.identify(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    und = {r.doc_id for r in got if r.lang_pred == "und"}
    assert {0, 3, 6} <= und and 15 not in und
    assert {model.predict(t)[0] for t in ("½", "x²"[1:], "①", "__ 12 \u0301")} == {"und"} and model.predict("½ the house")[0] != "und"
    assert langid.identify(docs.where("false"), model).count() == 0
    untaught = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identify(untaught).collect()} == {"und"}


def test_batches_without_rows(spark):
    """Rows larger than a batch, and batches of which nothing stays."""
    docs = spark.createDataFrame([(i, "12 " * 2_000_000 if i % 3 == 0 else "7") for i in range(12)], "doc_id bigint, text string").coalesce(1)
    model = langid.fit(["the cat sat", "le chat est"] * 6, ["en", "fr"] * 6)
    assert {(r.lang_pred, r.score) for r in langid.identify(docs, model).collect()} == {("und", 0.0)}
    assert langid.known_language(docs.withColumn("lang", F.lit("en"))).count() == 0
