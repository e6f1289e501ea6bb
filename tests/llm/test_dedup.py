"""Exact dedup, SimHash near-dedup and suffix dedup against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from brute import awkward, awkward_rows, classes, nothing, prose, removed, simhash
from pyspark.sql import functions as F

from funnelkit.llm import exact_dedup as E
from funnelkit.llm import simhash as H
from funnelkit.llm import suffixes as S
from funnelkit.llm.graph import components


def _normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def _check_exact(rows, out):
    groups: dict[str, list] = {}
    for r in rows:
        groups.setdefault(_normal(r[1]), []).append(r[0])
    expected = []
    for norm, ids in groups.items():
        least = min((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(norm.encode()).hexdigest()
        expected += [(str(i), str(least), len(ids), sha) for i in ids]
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in out) == sorted(expected)
    kept = [r for r in out if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)


def test_exact_dedup(spark):
    _check_exact(awkward_rows(), E.exact_dedup(spark, awkward(spark)).collect())
    assert E.exact_dedup(spark, nothing(spark)).count() == 0


def test_exact_dedup_draws_clashing_identifiers_again(spark, monkeypatch):
    real = E.chunk_ids
    monkeypatch.setattr(E, "chunk_ids", lambda c, salt: real(F.substring(c, 1, 3), salt) if salt == 0 else real(c, salt))
    assert E.clashes(E.chunk_dictionary(awkward(spark), "text", E.chunk_pattern(), 0)) > 0
    _check_exact(awkward_rows(), E.exact_dedup(spark, awkward(spark)).collect())


def test_chunks_follow_the_content(spark):
    """Chunks give the text back, keep their bounds, and resume after an insertion."""
    text = prose(9, 4000)
    df = spark.createDataFrame([(text,), ("inserted words here " + text,)], "text string")
    one, two = (r.c for r in df.select(E.chunks_of(E.normalised(F.col("text")), E.chunk_pattern()).alias("c")).collect())
    assert "".join(one) == text
    assert all(len(c) <= E.MAX_CHUNK for c in one) and all(len(c) >= E.MIN_CHUNK for c in one[:-1])
    assert len(set(one) & set(two)) >= len(one) - 3


def test_drop_exact_duplicates_keeps_columns(spark):
    docs = awkward(spark)
    out = E.drop_exact_duplicates(spark, docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert len(rows) == len({_normal(r[1]) for r in awkward_rows()})
    assert {r.doc_id for r in rows if _normal(r.text) == _normal(prose(1, 120))} == {1}
    assert E.drop_exact_duplicates(spark, nothing(spark)).count() == 0


def test_row_keys_tell_nulls_in_different_columns_apart(spark):
    from funnelkit.llm.common import row_key

    docs = spark.createDataFrame([(1, "x", None), (1, None, "x"), (1, None, None), (1, "x", "x"), (1, "x", None)], "doc_id bigint, text string, lang string")
    keys = [tuple(r) for r in docs.select(*row_key(docs)).collect()]
    assert len(set(keys)) == 4 and keys[0] == keys[4]


def test_fingerprints_match_the_definition():
    for text in [r[1] for r in awkward_rows()] + ["a", "A b", "É é ß", "one two three"]:
        assert H.fingerprint((text or "").encode()) == simhash(text)


def test_bk_tree_finds_what_a_scan_finds():
    r = random.Random(5)
    values = list({r.getrandbits(64) for _ in range(200)})
    values += [v ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for v in values]
    values = list(dict.fromkeys(values))
    tree = H.BKTree()
    for v in values:
        tree.add(v)
    for v in values[:100]:
        assert sorted(tree.within(v, 2)) == [i for i, x in enumerate(values) if (x ^ v).bit_count() <= 2]


def test_shards_hold_every_close_pair():
    """Any two values at most two bits apart agree on the shared bits of some shard, at every level."""
    r = random.Random(6)
    levels = H.shard_masks()
    assert [len(x) for x in levels] == [6, 36, 216] and {m.bit_count() for m in levels[-1]} == {56}
    for _ in range(300):
        a = r.getrandbits(64)
        b = a ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64))
        for masks in levels:
            assert any(a & m == b & m for m in masks)


@pytest.mark.parametrize("cap", [H.SHARD_CAP, 3])
def test_near_links_join_all_close_values(spark, cap):
    r = random.Random(cap)
    base = [r.getrandbits(64) for _ in range(6)]
    values = set(base)
    for v in base:  # families of edits; chains that reach further than the radius
        for _ in range(25):
            v ^= 1 << r.randrange(12)
            values.add(v)
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = H.near_links(spark, spark.createDataFrame([(v,) for v in signed], "fp bigint"), shard_cap=cap)
    roots = {r.node: r.root for r in components(spark, links).collect()}
    expected = classes(len(values), lambda i, j: (values[i] ^ values[j]).bit_count() <= 2)
    got = [roots.get(v, v) for v in signed]
    assert len(set(zip(got, expected))) == len(set(got)) == len(set(expected))


def test_components(spark):
    r = random.Random(8)
    edges = [(i, i + 1) for i in range(60)] + [(1000, i) for i in range(1001, 1100)] + [(r.randrange(2000, 2100), r.randrange(2000, 2100)) for _ in range(60)]
    got = {x.node: x.root for x in components(spark, spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    real = {(a, b) for a, b in edges if a != b}
    nodes = sorted({x for e in real for x in e})
    assert sorted(got) == nodes
    expected = classes(len(nodes), lambda i, j: (nodes[i], nodes[j]) in real or (nodes[j], nodes[i]) in real)
    assert len(set(zip([got[n] for n in nodes], expected))) == len(set(got.values())) == len(set(expected))


def test_near_duplicates(spark):
    rows = awkward_rows()
    out = H.near_duplicates(spark, awkward(spark)).collect()
    prints = [simhash(r[1]) for r in rows]
    group = classes(len(rows), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 2)
    least = {g: min((r[0] for r, x in zip(rows, group) if x == g and r[0] is not None), default=None) for g in group}
    expected = sorted((str(r[0]), p, str(least[g])) for r, p, g in zip(rows, prints, group))
    assert sorted((str(r.doc_id), r.fp % (1 << 64), str(r.component_id)) for r in out) == expected
    kept = H.drop_near_duplicates(spark, awkward(spark)).collect()
    assert len(kept) == len(set(group)) and sorted(str(r.doc_id) for r in kept) == sorted(str(least[g]) for g in set(group))
    assert H.near_duplicates(spark, nothing(spark)).count() == 0
    assert H.drop_near_duplicates(spark, nothing(spark)).count() == 0


def test_multikey_equal():
    r = np.random.default_rng(1)
    first, words = r.integers(0, 5, 500).astype(np.uint64), r.integers(0, 3, (500, 4)).astype(np.uint64)
    label = S.multikey_equal(first, words)
    keys = [(f, *w) for f, w in zip(first.tolist(), words.tolist())]
    assert [x >= 0 for x in label] == [keys.count(k) > 1 for k in keys]
    assert len({(k, x) for k, x in zip(keys, label.tolist()) if x >= 0}) == len({k for k, x in zip(keys, label.tolist()) if x >= 0})


def test_anchors_depend_on_the_window_only(monkeypatch):
    """Equal 50-byte windows have equal leads at equal offsets, in whatever segment they fall."""
    passage = prose(11, 60).encode()
    texts = [prose(12, 900).encode() + passage + prose(13, 40).encode(), passage, prose(14, 3).encode() + passage, b"short", b""]
    monkeypatch.setattr(S, "SEGMENT", 1000)
    seen = S.anchors(*S.laid_out(texts))
    monkeypatch.setattr(S, "SEGMENT", 1 << 17)
    for x, y in zip(seen, S.anchors(*S.laid_out(texts))):
        assert (x == y).all()
    by_window: dict[bytes, set] = {}
    for t, at, start, stop, lead, _ in zip(*(x.tolist() for x in seen)):
        for s in range(start, stop + 1):
            by_window.setdefault(texts[t][s : s + 50], set()).add((at - s, lead))
    assert all(len(v) == 1 for v in by_window.values())
    assert sum(len(t) - 49 for t in texts if len(t) >= 50) == sum((seen[3] - seen[2] + 1).tolist())


def test_blocks_equal_in_48_bits_only_are_not_combined(monkeypatch):
    nothing_ = np.zeros(0, np.uint64)

    def covered(anchors):
        """Documents with covered blocks, and the number of suffixes sent, of one task."""
        doc, lead, block = (np.array(x) for x in zip(*anchors))
        found = doc * 0, doc * 0, doc * 0, doc * 0, lead.astype(np.uint64), block.astype(np.uint64)
        monkeypatch.setattr(S, "anchors", lambda data, offsets: (np.arange(len(doc)), *found[1:]))
        batch = pa.RecordBatch.from_arrays([pa.array(doc), pa.array(["x"] * len(doc))], names=["doc", "text"])
        rows = [r for b in S._anchor_task((nothing_, nothing_))(iter([batch])) for r in b.to_pylist()]
        return [r["doc"] for r in rows if r["bucket"] < 0], sum(len(r["blocks"]) // 6 for r in rows if r["bucket"] >= 0)

    assert covered([(1, 5, 7), (2, 5, 7)]) == ([2], 1)
    assert covered([(1, 5, 7), (2, 6, 7)]) == ([], 2)
    assert covered([(1, 5, 7), (2, 5, 7 + (1 << 48))]) == ([], 2)


@pytest.mark.parametrize("options", [{}, {"bucket_rows": 500, "hot_rows": 2}])
def test_suffix_dedup(spark, options):
    rows = awkward_rows()
    r = random.Random(3)
    line = "a very common line that many documents share, word for word, to the end."
    for i in range(100, 140):
        a, b = r.randrange(300), r.randrange(300)
        rows.append((i, prose(i, 30) + " " + line + " " + prose(500 + i % 5, 60)[a : a + b] + prose(i + 900, 8), "en", "s1", 1, "", "", ""))
    from brute import SCHEMA

    out = S.remove_repeats(spark, spark.createDataFrame(rows, SCHEMA).repartition(4), **options).collect()
    expected = sorted((str(x[0]), *y) for x, y in zip(rows, removed([x[:2] for x in rows])))
    assert sorted((str(x.doc_id), x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in out) == expected
    assert sum(y[2] for y in expected) > 30
    assert all(sum(s.end - s.start for s in x.spans) == x.n_removed for x in out)
    assert S.remove_repeats(spark, nothing(spark), **options).count() == 0


@pytest.fixture
def with_maps(spark):
    """Columns of types that Spark cannot hash, also inside others; equal rows, and rows that differ in them only."""
    rows = [(1, prose(1, 40), "s", {"a": 1}, [{"x": "y"}]), (1, prose(1, 40), "s", {"a": 1}, [{"x": "y"}]), (1, prose(1, 40), "s", {"a": 2}, None),
            (2, prose(1, 40), "t", None, []), (3, prose(2, 40), None, {"a": None}, [{}]), (None, None, "s", {}, None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, m map<string,int>, n array<map<string,string>>").repartition(2)


def test_map_columns(spark, with_maps):
    from funnelkit.llm import curriculum as C
    from funnelkit.llm.common import row_key

    assert len({tuple(r) for r in with_maps.select(*row_key(with_maps)).collect()}) == 5
    for rows in (E.exact_dedup(spark, with_maps), H.near_duplicates(spark, with_maps), C.curriculum_mix(spark, with_maps)):
        assert rows.count() == 6 and "__key_a" not in rows.columns
    for docs in (E.drop_exact_duplicates(spark, with_maps), H.drop_near_duplicates(spark, with_maps)):
        assert docs.schema == with_maps.schema and docs.count() == 3
    assert C.mix_documents(spark, with_maps).schema == with_maps.schema


def test_only_the_columns_needed_are_read(spark, tmp_path):
    spark.createDataFrame(awkward_rows(), "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, row_id string, lead string") \
        .write.parquet(f"{tmp_path}/docs")
    plan = H.fingerprints(spark.read.parquet(f"{tmp_path}/docs"))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
