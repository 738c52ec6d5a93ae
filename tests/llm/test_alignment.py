"""Tokenizer alignment against a plain walk over both sides' ends."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from graphloom.llm import alignment, queries
from graphloom.llm.alignment import Aligner, align, coalesce, overlapping

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "  a  b ", "\n\nfoo\tbar\n baz  qux\n  x", "a\r\nb\r", "<|endoftext|> hi <s> </s> <0x41>", "▁x y", "a\xa0 b\xa0  c",
    "日本語 テスト 🙂🙂 x", "\x00 a", "\x1c b !\x1c", "é ﬁ ½", "it's don't 'S I'M", "word " * 3000, "word " * 3, "　a  b", "\ta", "a\n", "x" * 5000, "foo\n\n  bar\t\tz \n",
]


class Plain:
    def __init__(self):
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in own]
        self.byte = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}
        self.a, self.b = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
        self.a.encode_special_tokens = True

    def sides(self, text):
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        raw_a = [bytes(self.byte[c] for c in self.a.id_to_token(k)) for k in a]
        raw_b = [bytes([int(self.b.id_to_piece(k)[3:5], 16)]) if self.b.is_byte(k) else self.b.id_to_piece(k).replace("▁", " ").encode() for k in b]
        if not text or not b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
            return [], [], [], []
        return a, b, np.cumsum(list(map(len, raw_a))).tolist(), np.cumsum(list(map(len, raw_b))).tolist()

    def rows(self, docs):
        counts, per = Counter(), []
        for doc_id, text in docs:
            a, b, end_a, end_b = self.sides(text or "")
            at = dict(zip(end_a, a, strict=True))
            links = [(at[e], k) for k, e in zip(b, end_b, strict=True) if e in at]
            cuts = np.array(sorted(set(end_a) & set(end_b)))
            inside: list[tuple[list[str], list[str]]] = [([], []) for _ in cuts]
            for side, ids, ends in ((0, a, end_a), (1, b, end_b)):
                for k, g in zip(ids, np.searchsorted(cuts, ends).tolist(), strict=True):
                    inside[g][side].append(str(k))
            groups = [",".join(x) + "|" + ",".join(y) for x, y in inside]
            counts.update(links)
            per.append((doc_id, len(a), len(b), groups, links))
        best = defaultdict(int)
        for (_, b), n in counts.items():
            best[b] = max(best[b], n)
        return [
            (i, na, nb, len(g), len(x), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "",
             sum(counts[k] == best[k[1]] for k in x), sum(counts[k] for k in x), ";".join(g))
            for i, na, nb, g, x in per
        ]


@pytest.fixture(scope="module")
def plain():
    return Plain()


@pytest.mark.parametrize("block", [200, 1 << 20])
def test_alignment_of_odd_texts(spark, plain, block):
    """Nulls, empty and very long texts, ties, repeated rows and ids, other white space, marks as plain text; other columns are ignored."""
    docs = [(k, text) for k, text in enumerate(TEXTS)] + [(3, TEXTS[3]), (None, "word x"), (4, "other text")]
    frame = spark.createDataFrame([(*d, 1, "p") for d in docs], "doc_id long, text string, block int, pairs string").repartition(2)
    got = align(frame, *PATHS, with_groups=True, block=block)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum", "groups"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(plain.rows(docs), key=str)


def test_empty_table(spark):
    assert align(spark.createDataFrame([], "doc_id long, text string"), *PATHS).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab 'sé\n\t\r\xa0日.1▁<"), max_size=30))
def test_by_word_as_whole(text):
    """Words one after another give what the whole text gives."""
    side = _aligner()
    assert side.by_word
    whole = side.align([" " + text])[0] if text else None
    from graphloom.llm.alignment import ODD, WORDS

    if whole and not ODD.search(text):
        parts = side.align(WORDS.findall(" " + text))
        assert None not in parts
        assert (";".join(p[0] for p in parts), sum(p[1] for p in parts), sum(p[2] for p in parts), b"".join(p[3] for p in parts)) == whole


def _aligner(kept={}):  # noqa: B006
    return kept.setdefault(0, Aligner(*PATHS))


@given(st.lists(st.integers(1, 4), min_size=1, max_size=12), st.lists(st.integers(1, 4), min_size=1, max_size=12))
def test_coalescing(a, b):
    a, b = np.array(a), np.array(b)
    shorter = min(a.sum(), b.sum())
    a, b = (np.append(x[np.cumsum(x) < shorter], shorter - x[np.cumsum(x) < shorter].sum()) for x in (a, b))
    ea, eb = np.cumsum(a), np.cumsum(b)
    group_a, group_b = coalesce(ea - a, ea, eb - b, eb)
    cuts = sorted(set(ea.tolist()) & set(eb.tolist()))
    assert group_a.tolist() == np.searchsorted(cuts, ea).tolist() and group_b.tolist() == np.searchsorted(cuts, eb).tolist()
    pairs = {(i, j) for i in range(len(a)) for j in range(len(b)) if ea[i] - a[i] < eb[j] and eb[j] - b[j] < ea[i]}
    assert set(zip(*(x.tolist() for x in overlapping(ea - a, ea, eb - b, eb)), strict=True)) == pairs


def test_query_against_brute_force(spark, plain):
    """Over the whole small table."""
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = queries.QUERIES["op11_tokenizer_alignment"](spark, "/root/testdata/sf0.001")
    want = {r[0]: dict(zip(["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"], r[1:8], strict=True)) for r in plain.rows(docs)}
    assert {r["doc_id"]: {k: v for k, v in r.asDict().items() if k != "doc_id"} for r in got.collect()} == want


def test_words_are_encoded_many_at_a_time(monkeypatch):
    """A call per word was most of the work. Words that one side does not give back fail alone."""
    side, calls = Aligner(*PATHS), []
    words = [f" w{k}é{'' if k % 50 else '▁'}" for k in range(300)] + ["\tx", "\n\n y", "  ", " "]
    alone = [side.align([w])[0] for w in words]
    assert None in alone and alone.count(None) < 20
    for name in ("_ids_a", "_ids_b"):
        own = getattr(side, name)
        monkeypatch.setattr(side, name, lambda parts, own=own: calls.append(len(parts)) or own(parts))
    assert side.align(words) == alone
    calls.clear()
    assert None not in side.align([f" w{k}é" for k in range(300)])
    assert sum(calls) <= 2 * (300 // 64 + 1)


def test_blocks_lie_few_to_a_file(spark, monkeypatch):
    """A block is a row of megabytes; a file's writer and reader hold all rows of a file that has less than a hundred."""
    kept, own = [], alignment.keep
    monkeypatch.setattr(alignment, "keep", lambda *args: kept.append(own(*args)) or kept[-1])
    docs = spark.createDataFrame([(k, f"some words {k}") for k in range(40)], "doc_id long, text string").coalesce(1)
    assert align(docs, *PATHS, block=1).count() == 40
    files = kept[0].groupBy(F.input_file_name().alias("file")).count().collect()
    assert sum(r["count"] for r in files) == 40 and max(r["count"] for r in files) <= 2
