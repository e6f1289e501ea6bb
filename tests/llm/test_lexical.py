"""Ranked lexical search against a scan of all documents."""

import math
import random
import re
from collections import Counter

import pytest
from brute import SCHEMA, awkward_rows, nothing, prose

from funnelkit.llm import lexical as L

SF = "/root/testdata/sf0.001"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def _terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def _scan(docs, items, k=10):
    """{item_id: [(score, doc_id)] of all documents with a score, best first}."""
    counts = [(d, Counter(_terms(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n_docs, n_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = {}
    for item_id, text in items:
        rows = []
        for d, c in counts:
            m = 100 - 75 + (75 * sum(c.values()) * n_docs) // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                for t in _terms(text) if t in c
            )
            if score > 0:
                rows.append((-score, math.inf if d is None else d))
        out[item_id] = [(-s, None if d == math.inf else d) for s, d in sorted(rows)][:k]
    return out


def _check(out, want):
    got = {}
    for r in sorted(out, key=lambda r: (str(r.item_id), r.rank)):
        got.setdefault(r.item_id, []).append((r.score, r.doc_id))
        assert r.rank == len(got[r.item_id])
    assert got == {i: rows for i, rows in want.items() if rows}


@pytest.mark.parametrize("first", [L.FIRST, 10, 1])
def test_whole_table_matches_a_scan(spark, first):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    want = _scan([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    _check(L.rank_documents(spark, docs.repartition(5), items, first=first, item_block=16).collect(), want)


ITEMS = [(1, prose(1, 12)), (2, "alpha alpha ALPHA beta"), (3, ""), (4, None), (5, "É naïve größe straße"), (6, "nowhere"), (None, "the other text"), (7, "aaaa 7")]


@pytest.mark.parametrize("width,first", [(1 << 16, 40), (8, 10), (1 << 16, 2)])
def test_awkward_rows(spark, width, first):
    """Also with eight coordinates, where most bounds are far too high."""
    rows = awkward_rows() + [(100 + i, prose(1, 12), None, None, 1, None, None, None) for i in range(60)]  # ties by the dozen
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    want = _scan([(r[0], r[1]) for r in rows], ITEMS)
    assert len(want[1]) == 10 and want[6] == want[3] == []
    _check(L.rank_documents(spark, docs, items, first=first, width=width).collect(), want)


def test_frequencies_beyond_the_stored_peak(spark):
    rows = [(i, "alpha " * n + "beta", *[None] * 6) for i, n in enumerate([1, 254, 255, 256, 400, 9000])]
    items = [(1, "alpha"), (2, "beta alpha")]
    want = _scan([(r[0], r[1]) for r in rows], items, k=3)
    out = L.rank_documents(spark, spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id bigint, text string"), k=3, first=3)
    _check(out.collect(), want)


def test_empty_tables_and_repeated_items(spark):
    docs = spark.createDataFrame(awkward_rows(), SCHEMA)
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert L.rank_documents(spark, docs, none).collect() == []
    assert L.rank_documents(spark, nothing(spark), spark.createDataFrame(ITEMS, "item_id bigint, text string")).collect() == []
    blank = spark.createDataFrame([(1, None, *[None] * 6), (2, " ", *[None] * 6)], SCHEMA)
    assert L.rank_documents(spark, blank, spark.createDataFrame(ITEMS, "item_id bigint, text string")).collect() == []
    twice = spark.createDataFrame([(1, "beta"), (1, "alpha"), (1, None)], "item_id bigint, text string")
    _check(L.rank_documents(spark, docs, twice).collect(), _scan([(r[0], r[1]) for r in awkward_rows()], [(1, "alpha")]))


def test_bounds_are_never_below_the_score(spark):
    r = random.Random(3)
    docs = [(i, " ".join(r.choice("abcdefghij") * r.randrange(1, 4) for _ in range(r.randrange(1, 300)))) for i in range(120)]
    index = L.build_index(spark, spark.createDataFrame(docs, "doc_id bigint, text string"), width=64)
    weights = [{t.encode() * n: r.randrange(9000) for t in "abcdef"} for n in (1, 2, 3)]
    block = L.Block([1, 2, 3], weights, index.n_docs, index.n_terms, index.width)
    sketches = index.sketches.toArrow().combine_chunks().to_batches()
    texts = dict(docs)
    seen = 0
    for batch, bound in L.bounds(block, iter(sketches)):
        for doc_id, row in zip(batch.column("doc_id").to_pylist(), bound):
            words = L.terms(texts[doc_id].encode())
            tf, m = Counter(words), L.length_factor(len(words), index.n_docs, index.n_terms)
            for w, b in zip(weights, row):
                assert b >= sum(v * L.impact(tf[t], m) for t, v in w.items() if t in tf)
            seen += 1
    assert seen == len(docs)
