"""Periodic runs against every period tried at every place."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import queries
from graphloom.llm.runs import branching_squares, common_prefixes, periodic_runs, runs_of, smaller_children, suffix_array


def brute(words, min_words=24, exponent=3):
    found = {}
    for period in range(1, len(words) // exponent + 1):
        i = 0
        while i + period < len(words):
            j = i
            while j + period < len(words) and words[j] == words[j + period]:
                j += 1
            length = j - i + period
            if j > i and length >= max(min_words, exponent * period):
                found.setdefault((i, length), period)
            i = max(j, i) + 1
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=80), st.sampled_from([(4, 2), (6, 2), (9, 3), (12, 4)]))
def test_runs_of_random_words(words, limits):
    assert runs_of(np.array(words, np.int64), *limits) == brute(words, *limits)


def test_runs_of_planted_loops():
    rng = random.Random(5)
    for _ in range(300):
        words = [rng.randrange(40) for _ in range(rng.randint(24, 300))]
        for _ in range(rng.randint(1, 3)):
            start, period, length = rng.randrange(len(words)), rng.randint(1, 30), rng.randint(20, 120)
            for i in range(start + period, min(len(words), start + length)):
                words[i] = words[i - period]
        assert runs_of(np.array(words, np.int64)) == brute(words)


def test_suffix_array_and_squares():
    words = np.array([3, 1, 3, 1, 3, 1, 2, 2])
    order, place = suffix_array(words)
    assert order.tolist() == sorted(range(8), key=lambda i: words[i:].tolist()) and place[order].tolist() == list(range(8))
    lcp = common_prefixes(words, order, place)
    squares = branching_squares(order, place, smaller_children(lcp, 2, 2))
    assert squares == {(6, 1), (2, 2)}  # the square at 1 is the one at 2 rotated


def test_periodic_long_text_stays_fast_and_whole():
    """A very long text of one word, and one of nested repetitions."""
    assert runs_of(np.zeros(100_000, np.int64)) == [(0, 100_000, 1)]
    a, b = [0], [0, 1]
    while len(b) < 1500:
        a, b = b, b + a
    assert runs_of(np.array(b)) == brute(b)


def test_cases_of_tables(spark):
    loop = " ".join(["a", "b", "c"] * 10)
    rows = [(1, None, 9), (2, "", 9), (3, "x y z", 9), (4, f"head {loop} tail", 9), (4, f"head {loop} tail", 9), (None, loop.replace(" ", "\t\n"), 9), (5, "é " * 30, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    got = sorted(map(tuple, periodic_runs(docs).collect()), key=str)
    run = (1, 30, 3)
    assert got == sorted(
        [(1, 0, [], ""), (2, 0, [], ""), (3, 3, [], "x y z"), (4, 32, [run], "head a b c tail"), (4, 32, [run], "head a b c tail"),
         (None, 30, [(0, 30, 3)], "a b c"), (5, 30, [(0, 30, 1)], "é")], key=str,
    )
    assert periodic_runs(docs.where("false")).count() == 0


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(11)
    rows = [(i, " ".join(rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(rng.choice([0, 1, 10, 60, 200])))) for i in range(120)]
    rows += [(500, None), (501, "   x\x0bx"), (6, "w " * 500)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, queries.QUERIES["op12_periodic_runs"](spark, str(tmp_path)).collect()), key=str)
    sha, expected = lambda x: hashlib.sha256(x.encode()).hexdigest(), []
    for doc_id, text in rows:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            a, g = (h // 10) % n, h // 10
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        found = brute(words)
        best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else None
        drop = {k for s, length, p in found for k in range(s + p, s + length)}
        kept = " ".join(w for k, w in enumerate(words) if k not in drop)
        expected.append(
            (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
             sha("".join(f"{s},{length},{p}\n" for s, length, p in found)), sha(kept))
        )
    assert got == sorted(expected, key=str) and any(r[1] for r in got)
