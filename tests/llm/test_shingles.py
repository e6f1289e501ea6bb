"""The n-gram Jaccard join against all pairs."""

import random
import re

import numpy as np
import pytest
from brute import SCHEMA, awkward_rows, classes, nothing, prose

from funnelkit.llm import shingles as S

SF = "/root/testdata/sf0.001"


def _set(text, size=4):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} or ({tuple(words)} if words else set())


def _linked(a, b):
    return bool(a and b) and 100 * len(a & b) >= 85 * len(a | b)


def _scan(rows):
    sets = [_set(t) for _, t in rows]
    label = classes(len(rows), lambda i, j: _linked(sets[i], sets[j]))
    least: dict = {}
    for (d, _), x in zip(rows, label):
        if d is not None:
            least[x] = min(least.get(x, d), d)
    return sorted(((d, len(s), least.get(x)) for (d, _), s, x in zip(rows, sets, label)), key=str)


def _check(out, rows):
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=str) == _scan(rows)


def test_whole_table_matches_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert len({x[2] for x in _scan(rows)}) < len(rows)
    _check(S.jaccard_join(spark, docs.repartition(3)).collect(), rows)


def test_awkward_rows(spark):
    rows = awkward_rows() + [(50, "one two three", *[None] * 6), (51, "One  two THREE", *[None] * 6), (52, "one two", *[None] * 6)]
    _check(S.jaccard_join(spark, spark.createDataFrame(rows, SCHEMA).repartition(3)).collect(), [(r[0], r[1]) for r in rows])
    assert S.jaccard_join(spark, nothing(spark)).collect() == []
    blank = [(1, None, *[None] * 6), (2, " ", *[None] * 6), (None, "", *[None] * 6)]
    _check(S.jaccard_join(spark, spark.createDataFrame(blank, SCHEMA)).collect(), [(r[0], r[1]) for r in blank])


def _edited(r, words, n):
    words = list(words)
    for _ in range(n):
        i = r.randrange(len(words))
        words[i : i + 1] = r.choice([[], ["new%d" % r.randrange(10**6)], [words[i], "more%d" % r.randrange(10**6)]])
    return words


def _families(seed):
    """Families of edits around the threshold, chains of edits, shared passages, copies, strangers."""
    r = random.Random(seed)
    word = lambda: "w%d" % r.randrange(4000)
    passage = [word() for _ in range(60)]
    texts = []
    for size in (5, 9, 30, 80, 200):
        base = [word() for _ in range(size)]
        texts += [_edited(r, base, r.randrange(0, max(2, size // 25))) for _ in range(12)]
        chain = base
        for _ in range(8):  # neighbours are linked, the ends are not
            chain = _edited(r, chain, max(1, size // 60))
            texts.append(chain)
    texts += [[word() for _ in range(r.randrange(5, 120))] + passage + [word() for _ in range(r.randrange(0, 20))] for _ in range(40)]
    texts += [passage[: r.randrange(50, 60)] for _ in range(10)] + [[word() for _ in range(r.randrange(1, 90))] for _ in range(30)]
    texts += texts[:5] * 3
    r.shuffle(texts)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed,rounds,part_tokens", [(1, 1, S.PART_TOKENS), (2, 3, 300), (3, 0, 500), (4, 0, S.PART_TOKENS)])
def test_families(spark, seed, rounds, part_tokens):
    """Also with no links to centres, so that the matrix finds every link."""
    rows = _families(seed)
    out = S.jaccard_join(spark, spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), rounds=rounds, part_tokens=part_tokens)
    _check(out.collect(), rows)


def test_a_third_of_the_rows_is_one_text(spark):
    base = prose(9, 60)
    rows = [(i, base) for i in range(60)] + [(100 + i, base + f" tail {i}") for i in range(60)] + [(200 + i, prose(20 + i, 50)) for i in range(60)]
    rows += [(None, base), (7, "another text of the same id here")] * 3
    _check(S.jaccard_join(spark, spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect(), rows)


def test_lead_tokens_of_linked_sets():
    """Two sets that meet the threshold share the promised number of lead tokens, whatever their order."""
    r = np.random.default_rng(4)
    for _ in range(3000):
        union = int(r.integers(1, 300))
        shared = -(-85 * union // 100)
        cut = int(r.integers(0, union - shared + 1))
        order = r.permutation(union)
        both, a, b = np.split(order, [shared, shared + cut])
        a, b = np.sort(np.concatenate([both, a])), np.sort(np.concatenate([both, b]))
        leads = [set(x[: S.lead_size(len(x))].tolist()) for x in (a, b)]
        for x in (a, b):
            assert len(leads[0] & leads[1]) >= S.shared_lead(S.required(len(x)))


def test_opened_parts_match_set_arithmetic():
    r = np.random.default_rng(7)
    sets = [np.unique(r.integers(0, 60, r.integers(1, 60))) for _ in range(40)]
    sets += [np.unique(np.append(s, r.integers(0, 60))) for s in sets]
    got = {(i, j) for i, linked in S.open_part(sets[:50], sets, 85) for j in linked.tolist()}
    assert got == {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:50]) if _linked(set(a.tolist()), set(b.tolist()))}


def test_bounds_in_spark_are_those_in_python(spark):
    from pyspark.sql import functions as F

    rows = spark.range(1, 5000).select("id", S._required(F.col("id"), 85).alias("r"), S._needed(F.col("id"), 85).alias("s")).collect()
    bands = {r.n: r.band for r in spark.range(1, 5000).select(F.col("id").alias("n"), S.size_band(F.col("id"), 85).alias("band")).collect()}
    assert all(abs(bands[n] - bands[m]) <= 1 for n in bands for m in (S.required(n), n * 100 // 85) if m in bands)
    assert all(x.r == S.required(x.id) and x.s == S.shared_lead(S.required(x.id)) for x in rows)
