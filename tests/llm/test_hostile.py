"""Rows made to break shortcuts: words whose polynomial hashes cancel out, repeated ids and rows, letters that aren't."""

import random

import numpy as np
import pytest

from lemmata.llm import _repeats, minhash, substrings, suffixes
from lemmata.llm._common import Texts, word_hashes
from test_operators import brute_groups, prose


def morse(n, pair="ab"):
    return "".join(pair[bin(i).count("1") % 2] for i in range(n))


def test_words_that_cancel_out(spark):
    """A Thue-Morse word and its complement are hashed alike by any polynomial modulo a power of two."""
    for size in (8, 40, 1024, 4096):
        data = np.frombuffer((morse(size) + morse(size, "ba")).encode(), np.uint8)
        a, b = word_hashes(data, np.array([0, size]), np.array([size, 2 * size])).tolist()
        assert a != b
    one, other = morse(1024), morse(1024, "ba")
    docs = spark.createDataFrame([(1, one), (2, other)], "doc_id bigint, text string")
    assert all(r.kept for r in minhash.near_duplicates(docs).collect())
    rows = [(i, " ".join(w if j == 17 else f"w{j}" for j in range(35))) for i, w in enumerate((one, other))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert [r.n_removed for r in substrings.dedup(docs).collect()] == [0, 0]


def test_patterns_of_words_that_cancel_out(spark):
    rows = [(i, " ".join(morse(4096, pair))) for i, pair in enumerate(("ab", "ba"))]
    got = substrings.dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    count = {}
    for _, t in rows:
        w = t.split()
        for i in range(len(w) - 34):
            count[tuple(w[i : i + 35])] = count.get(tuple(w[i : i + 35]), 0) + 1
    for r in got:
        w, gone = rows[r.doc_id][1].split(), [False] * 4096
        for i in range(len(w) - 34):
            if count[tuple(w[i : i + 35])] > 1:
                gone[i : i + 35] = [True] * 35
        assert r.n_removed == sum(gone)


def test_word_hashes_see_bytes_alone():
    texts = ["", "a", "a b", "abcdefgh", "abcdefghi", "x" * 64, "y" * 65, "abcdefgh abcdefgh\0 " + "z" * 200 + " a"]
    import pyarrow as pa

    seen = {}
    for order in (texts, texts[::-1]):
        t = Texts(pa.array(order))
        starts, ends, hashes, _ = t.words()
        for a, b, h in zip(starts.tolist(), ends.tolist(), hashes.tolist(), strict=True):
            assert seen.setdefault(t.data[a:b].tobytes(), h) == h
    assert len(set(seen.values())) == len(seen)


def test_times_modulo_the_prime():
    rng = np.random.default_rng(3)
    p = _repeats._PRIME
    a = np.concatenate([rng.integers(0, p, 200), [0, 1, p - 1, p - 1]]).astype(np.uint64)
    b = np.concatenate([rng.integers(0, p, 200), [5, p - 1, p - 1, 2]]).astype(np.uint64)
    assert _repeats._window_powers.times(a, b).tolist() == [x * y % p for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    power, inverse = _repeats._window_powers(100)
    assert set(_repeats._window_powers.times(power, inverse).tolist()) == {1}


def test_rows_with_one_id(spark):
    rng = random.Random(11)
    a, b, c = (prose(50, rng) for _ in range(3))
    for rows in ([(9, a), (5, a), (5, b), (2, b), (2, c), (7, c), (13, prose(50, rng))], [(4, a), (4, b), (4, a), (6, b + " tail"), (3, c), (5, c)]):
        docs = spark.createDataFrame(rows, "doc_id bigint, text string")
        found = minhash.near_duplicates(docs).collect()
        want = {d: g for d, _, g in brute_groups_by_id(rows)}
        assert {(r.doc_id, r.component_id, r.kept) for r in found} == {(d, g, d == g) for d, g in want.items()} and len(found) == len(rows)


def brute_groups_by_id(rows):
    """Rows with one id are one node."""
    plain = brute_groups([(i, t) for i, (_, t) in enumerate(rows)])
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for (d, _), (_, _, g) in zip(rows, plain, strict=True):
        hi, lo = max(top(("d", d)), top(("g", g))), min(top(("d", d)), top(("g", g)))
        up[hi] = lo
    least = {}
    for d, _ in rows:
        least[top(("d", d))] = min(least.get(top(("d", d)), d), d)
    return [(d, None, least[top(("d", d))]) for d, _ in rows]


def test_repeated_rows_cost_no_more(spark):
    """Sets and cut stretches are taken once for all rows that are equal."""
    rng = random.Random(13)
    text = prose(200, rng)
    rows = [(1, text), (2, text + " tail"), (3, prose(30, rng) + " " + text)]
    many = spark.createDataFrame(rows * 60, "doc_id bigint, text string").repartition(4)
    once = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = minhash.near_duplicates(many).collect()
    assert len(found) == 180 and {(r.doc_id, r.component_id) for r in found} == {(d, g) for d, _, g in brute_groups(rows)}
    # rows with one id are no earlier than each other, so repeats of a row keep what the row alone keeps
    found = suffixes.dedup(many).collect()
    assert len(found) == 180 and {(r.doc_id, bytes(r.kept)) for r in found} == {(r.doc_id, bytes(r.kept)) for r in suffixes.dedup(once).collect()}


@pytest.mark.parametrize("seed", range(3))
def test_merge_by_binary_search(seed):
    rng = random.Random(seed)
    strings = np.array([bytes(rng.choice(b"ab\0") for _ in range(3)) + b"." for _ in range(200)])
    shard = np.array([rng.randint(0, 6) for _ in strings])
    moment = np.array(rng.sample(range(1000), 200))
    late = suffixes.earlier_across(shard, strings, moment)
    for i, s in enumerate(strings.tolist()):
        assert late[i] == any(t == s and m < moment[i] for t, m in zip(strings.tolist(), moment.tolist(), strict=True))
