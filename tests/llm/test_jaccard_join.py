"""The n-gram Jaccard join against all pairs."""

import random

import pytest

from graphloom.llm import jaccard_join
from graphloom.llm.jaccard_join import jaccard_components


def gram_set(text, size):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = lower.translate({k: " " for k in (9, 10, 11, 12, 13)}).split(" ")
    w = [x for x in w if x]
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def brute(rows, size, percent):
    sets = [gram_set(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            same_id = rows[i][0] is not None and rows[i][0] == rows[j][0]
            similar = a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j])
            if same_id and a and sets[j] or similar and None not in (rows[i][0], rows[j][0]):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return sorted(((d, len(s), least[find(i)] if d is not None else None) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def corpus(seed, families=14, copies=12):
    """Families of edited copies, a passage that many documents share, exact copies, short texts."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    passage = [word() for _ in range(50)]
    rows, k = [], 0
    for f in range(families):
        base = [word() for _ in range(rng.choice([3, 5, 6, 9, 30, 120, 400]))] + (passage if f % 2 else [])
        for _ in range(rng.randint(1, copies)):
            text = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                text[rng.randrange(len(text))] = word()
            k += 1
            rows.append((k, rng.choice([" ", "\n", " \t"]).join(text).upper() if rng.random() < 0.3 else " ".join(text)))
            if rng.random() < 0.3:
                k += 1
                rows.append((k, rows[-1][1]))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("few", "long", "rows", "hot", "hottest"), [(8, 1024, 40_000, 32, 1 << 20), (0, 4, 50, 2, 1 << 20), (10**9, 5, 100, 3, 40)])
def test_components_are_those_of_all_pairs(spark, monkeypatch, few, long, rows, hot, hottest):
    """With rounds of stars or without, with cut columns, small blocks and hot n-grams last: always the same components."""
    for name, value in (("FEW", few), ("LONG", long), ("ROWS", rows), ("HOT", hot), ("HOTTEST", hottest)):
        monkeypatch.setattr(jaccard_join, name, value)
    table = corpus(few % 7 + long)
    got = jaccard_components(spark.createDataFrame(table, "doc_id long, text string").repartition(4))
    assert sorted(map(tuple, got.collect()), key=str) == brute(table, 5, 80)


def test_exactly_eighty_percent(spark):
    """A long pair at exactly 80 is linked, one n-gram less is not."""
    w = [f"a{i}" for i in range(904)]
    at, below = w[:804] + [f"b{i}" for i in range(100)], w[:803] + [f"c{i}" for i in range(101)]
    for other, linked in ((at, True), (below, False)):
        a, b = set(w), set(other)
        del a, b
        table = [(1, " ".join(w)), (2, " ".join(other))]
        sets = [gram_set(t, 5) for _, t in table]
        share = 100 * len(sets[0] & sets[1]) >= 80 * len(sets[0] | sets[1])
        assert share is linked
        got = {r["doc_id"]: r["component_id"] for r in jaccard_components(spark.createDataFrame(table, "doc_id long, text string")).collect()}
        assert (got[2] == 1) is linked


def test_cases_of_tables(spark):
    """Nulls in any column, empty and blank texts, repeated ids with equal and other texts, ties, a very long text, clashing columns."""
    long = " ".join(f"x{i % 7919}{i % 13}" for i in range(30_000))
    rows = [
        (9, None), (8, ""), (7, " \n"), (3, "one two"), (2, "ONE\ttwo"), (5, long), (4, long + " end"), (None, long), (None, None),
        (6, "p q r s t u"), (6, "one two"), (10, "p q r s t u"), (10, "p q r s t u"),
    ]
    docs = spark.createDataFrame([(*r, None, 1, "z") for r in rows], "doc_id long, text string, gram string, cls long, label string")
    got = sorted(map(tuple, jaccard_components(docs).collect()), key=str)
    assert got == brute(rows, 5, 80)
    assert jaccard_components(docs.where("false")).count() == 0
