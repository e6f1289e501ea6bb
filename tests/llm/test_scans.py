"""Licence scans, pseudonyms, toxicity and quality."""

import datetime as dt
import pickle
import random
import re
import tracemalloc
from pathlib import Path

import numpy as np
import pytest
from brute import awkward, awkward_rows, nothing, prose

from funnelkit.llm import licenses as L
from funnelkit.llm import pii as P
from funnelkit.llm import quality as Q
from funnelkit.llm import toxicity as T
from funnelkit.llm.common import shared_dir
from funnelkit.llm.license_texts import TEMPLATES

SF = "/root/testdata/sf0.01"


def test_every_template_is_found_whole_and_edited():
    index = L.TemplateIndex()
    r = random.Random(1)
    for name, form, text in TEMPLATES:
        around = prose(1, 30) + "\n", "\n" + prose(2, 30)
        found = L.scan((around[0] + text + around[1]).encode(), index)
        assert [(m["license"], m["form"], m["coverage"]) for m in found] == [(name, form, 1.0)]
        whole = (around[0] + text + around[1]).encode()
        assert L.words_of(whole[found[0]["start"] : found[0]["end"]]) == L.words_of(text.encode())
        words = text.split()
        if len(words) > 40:  # one word in twenty left out, some put in
            edited = [w for i, w in enumerate(words) if i % 20 != 7]
            edited.insert(len(edited) // 2, "furthermore")
            found = L.scan((around[0] + " ".join(edited) + around[1]).encode(), index)
            assert [(m["license"], m["form"]) for m in found] == [(name, form)] and 0.9 <= found[0]["coverage"] < 1
    assert L.scan(prose(r.random(), 500).encode(), index) == []


def test_like_notices_are_told_apart():
    index = L.TemplateIndex()
    gpl3 = next(t for name, form, t in TEMPLATES if (name, form) == ("GPL-3.0", "header"))
    lgpl = gpl3.replace("General", "Lesser General")
    for text, names in (
        (gpl3, ["GPL-3.0"]), (gpl3.replace("version 3", "version 2"), ["GPL-2.0"]), (gpl3.replace("General", "Affero General"), ["AGPL-3.0"]),
        (lgpl, ["LGPL-3.0"]), (lgpl.replace("version 3", "version 2.1").replace("program", "library"), ["LGPL-2.1"]),
        (gpl3.replace("version 3", "version 1"), []), ("This work is licensed under the GNU General Public License, version 1.", []),
        ("Licensed under the ISC License.", []), ("Licensed under CC BY-SA 3.0.", []), ("Licensed under CC BY-SA 4.0.", ["CC-BY-SA-4.0"]),
    ):
        assert [m["license"] for m in L.scan(f"{prose(1, 20)} {text} {prose(2, 20)}".encode(), index)] == names


@pytest.mark.parametrize("times", [2, 3, 400])
def test_short_notices_repeated_at_once_are_all_found(times):
    index = L.TemplateIndex()
    for notice, name in (("All rights reserved.", "LicenseRef-Proprietary"), ("Licensed under the MIT License.", "MIT")):
        found = L.scan(f"{prose(1, 20)} {' '.join([notice] * times)} {prose(2, 20)}".encode(), index)
        assert [m["license"] for m in found] == [name] * times and all(m["coverage"] == 1.0 for m in found)


def test_alignment_counts_like_a_full_table():
    r = random.Random(2)
    for _ in range(60):
        a = [b"%d" % r.randrange(6) for _ in range(r.randrange(1, 9))]
        b = [b"%d" % r.randrange(6) for _ in range(r.randrange(1, 12))]
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                table[i][j] = max(table[i - 1][j], table[i][j - 1], table[i - 1][j - 1] + (x == y))
        hits, first, end = L.align(a, b, -20, 20)
        assert hits == table[-1][-1] and (not hits or b[first] in a and b[end - 1] in a)


def test_scan_licenses(spark):
    rows = {r.doc_id: r for r in L.scan_licenses(awkward(spark)).collect()}
    assert all(r.licenses == [] and r.matches == [] for r in rows.values())
    docs = spark.createDataFrame([(1, "x\nReleased under the MIT License.\ny", "z")] * 2 + [(2, None, "z")], "doc_id bigint, text string, matches string")
    out = sorted((r.doc_id, r.licenses, len(r.matches)) for r in L.scan_licenses(docs).collect())
    assert out == [(1, ["MIT"], 1), (1, ["MIT"], 1), (2, [], 0)]
    assert L.scan_licenses(nothing(spark)).count() == 0


def test_feistel_is_a_permutation_and_inverts():
    f = P.Feistel(b"key")
    for n in (2, 3, 97, 1000, 4097):
        moved = [f.permute("k", n, i) for i in range(n)]
        assert sorted(moved) == list(range(n))
        assert [f.invert("k", n, m) for m in moved] == list(range(n))
    assert [P.Feistel(b"other").permute("k", 1000, i) for i in range(20)] != [f.permute("k", 1000, i) for i in range(20)]
    assert f.invert("k", 10**30, f.permute("k", 10**30, 12345)) == 12345


def test_formats_stay_valid_and_values_linked():
    move = P.Feistel(b"key").permute
    text = (
        "card 4539 1488 0343 6467 or 4539148803436467, born 1980-02-29 = 29.02.1980 = 02/29/1980 = 29 February 1980, "
        "iban GB82 WEST 1234 5698 7654 32, ssn 123-45-6789, ip 10.1.2.3, call +1 (415) 555-2671, mail jo.doe7@site.example.org"
    )
    out, found = P.pseudonymise(text, move)
    by = {}
    for m in found:
        by.setdefault(m["kind"], []).append(m["pseudonym"])
        assert len(m["pseudonym"]) == m["end"] - m["start"] or m["kind"] in ("ip", "date")
        assert m["pseudonym"] != text[m["start"] : m["end"]]
    cards = ["".join(c for c in x if c.isdigit()) for x in by["card"]]
    assert cards[0] == cards[1] and P.luhn_digit(cards[0][:-1]) == int(cards[0][-1])
    days = {dt.date.fromisoformat(by["date"][0]), dt.datetime.strptime(by["date"][1], "%d.%m.%Y").date(),
            dt.datetime.strptime(by["date"][3], "%d %B %Y").date()}
    assert len(by["date"]) == 4 and len(days) == 1
    flat = by["iban"][0].replace(" ", "")
    assert flat.startswith("GB") and int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1
    assert all(0 <= int(x) < 256 for x in by["ip"][0].split("."))
    assert by["email"][0].endswith("@site.example.org") and by["phone"][0].startswith("+1 (")
    assert by["ssn"][0][3] == "-" and by["ssn"][0][6] == "-"
    again, _ = P.pseudonymise("elsewhere: jo.doe7@site.example.org", move)
    assert by["email"][0] in again


def test_invalid_candidates_and_clean_texts_stay():
    move = P.Feistel(b"key").permute
    for text in ("4539 1488 0343 6468", "2023-02-30", "999.1.2.3", "000-12-3456", "version 4.0.", "chapter 12, page 345", prose(1, 300), ""):
        assert P.pseudonymise(text, move) == (text, [])


def test_values_without_separators_or_before_capitals_are_found():
    move = P.Feistel(b"key").permute
    for text, value, kept in (
        ("call +8613812345678 now", "+8613812345678", "+86"), ("call +4915112345678", "+4915112345678", "+49"), ("+35812345", "+35812345", "+358"),
        ("+86138-1234-5678", "+86138-1234-5678", "+86"), ("ES91 2100 0418 4502 0005 1332 BIC", "ES91 2100 0418 4502 0005 1332", "ES"),
        ("ES9121000418450200051332 IBAN", "ES9121000418450200051332", "ES"), ("GB82 WEST 1234 5698 7654 32 OK", "GB82 WEST 1234 5698 7654 32", "GB"),
        ("DB_PASSWORD=hunter22x", "hunter22x", ""), ("export MY_API_KEY='abcd1234efgh'", "abcd1234efgh", ""),
    ):
        out, found = P.pseudonymise(text, move)
        assert len(found) == 1 and text[found[0]["start"] : found[0]["end"]] == value and value not in out
        assert found[0]["pseudonym"].startswith(kept) and out == text.replace(value, found[0]["pseudonym"])
    a, b = (P.pseudonymise(t, move)[1][0]["pseudonym"] for t in ("+49 15112345678", "+4915112345678"))
    assert a.replace(" ", "") == b
    two = "ES91 2100 0418 4502 0005 1332 GB82 WEST 1234 5698 7654 32"
    assert [m["kind"] for m in P.pseudonymise(two, move)[1]] == ["iban", "iban"]
    assert P.pseudonymise("mypassword=hunter22x and ES91 2100 0418 4502 0005 1333 BIC", move)[1] == []


def test_dates_of_all_spans_and_month_names():
    feistel = P.Feistel(b"key")
    for text, span in (
        ("1850-05-04", (1, 1899)), ("0999/12/31", (1, 1899)), ("2150-01-01", (2100, 9999)), ("31.12.9999", (2100, 9999)), ("1900-01-01", (1900, 2099)),
        ("5. März 2020", (1900, 2099)), ("3 mars 1999", (1900, 2099)), ("Jan 5, 2020", (1900, 2099)), ("5 january 2020", (1900, 2099)),
        ("1 de enero de 1850", (1, 1899)), ("Sept 5, 2020", None), ("12 DÉCEMBRE 2001", (1900, 2099)), ("3 Feb. 1987", (1900, 2099)), ("jUne 5, 2020", None),
        ("30 février 2020", None),
    ):
        out, found = P.pseudonymise(f"on {text} it", feistel.permute)
        assert len(found) == (span is not None), text
        if span:
            new = found[0]["pseudonym"]
            assert out == f"on {new} it" and new != text and span[0] <= int(re.search(r"\d{4}", new)[0]) <= span[1]
            assert re.sub(r"\d", "", re.sub(r"[^\W\d]+", "a", new)) == re.sub(r"\d", "", re.sub(r"[^\W\d]+", "a", text))
            assert P.pseudonymise(new, feistel.invert)[0] == text, (text, new)
    out, found = P.pseudonymise("5th January 2020", feistel.permute)
    assert re.fullmatch(r"(\d*1st|\d*2nd|\d*3rd|\d+th) [A-Z][a-z]+ \d{4}", out) and found[0]["kind"] == "date"
    names = [n for form in P.MONTHS.values() for n in form.split()]
    for name in names:
        for text in (f"7 {name} 1950", f"7 {name.upper()} 1950", f"7 {name.lower()} 1950"):
            new = P.pseudonymise(text, feistel.permute)[0]
            assert new != text and P.pseudonymise(new, feistel.invert)[0] == text


def test_pseudonymise_documents(spark):
    docs = spark.createDataFrame([(1, "at 10.1.2.3", 5), (1, "at 10.1.2.3", 5), (2, None, 6), (None, "a@b.org", 7)], "doc_id bigint, text string, found bigint")
    out = P.pseudonymise_documents(docs, b"key").collect()
    assert len(out) == 4 and len({r.text for r in out if r.doc_id == 1}) == 1
    assert [r.text for r in out if r.doc_id == 2] == [""] and sum(r.n_found for r in out) == 3
    clean = {r.doc_id: r.text for r in P.pseudonymise_documents(awkward(spark), b"key").collect()}
    assert clean[8] == prose(4, 30_000)
    assert P.pseudonymise_documents(nothing(spark), b"key").count() == 0


def test_block_max_index_is_exact():
    r = np.random.default_rng(4)
    vectors = []
    for _ in range(400):
        terms = r.choice(60, r.integers(0, 8), replace=False)
        w = r.random(len(terms)) + 0.01
        norm = np.sqrt((w**2).sum()) if len(w) else 1
        vectors.append({int(t): float(x / norm) for t, x in zip(terms, w)})
    vectors[10] = vectors[20] = vectors[30]
    index = T.BlockMaxIndex.build(vectors, 60, block=16)
    for q, v in enumerate(vectors):
        scan = sorted((-sum(w * vectors[i].get(t, 0.0) for t, w in v.items()), i) for i in range(400) if i != q)
        expected = [(-c, i) for c, i in scan if c < 0][:7]
        got = index.nearest(v, 7, skip=q)
        assert len(got) == len(expected) and np.allclose([c for c, _ in got], [c for c, _ in expected])
        assert all(abs(-dict((i, c) for c, i in scan)[i] - c) < 1e-9 for c, i in got)


def _topics(n, seed):
    """Unit vectors of 6 topics over 20 shared terms, 30 of the topic and some that few hold."""
    r, vectors = np.random.default_rng(seed), []
    for i in range(n):
        own = 20 + 30 * (i % 6) + r.choice(30, 12, replace=False)
        terms = np.concatenate([r.choice(20, 8, replace=False), own, 200 + r.choice(400, 3, replace=False)])
        w = np.where(terms < 20, 0.3, 1.0) * (0.2 + r.random(len(terms)))
        vectors.append({int(t): float(x) for t, x in zip(terms, w / np.sqrt((w**2).sum()))})
    return vectors


def test_block_max_index_skips_blocks_and_finds_what_a_scan_finds():
    vectors, labels = _topics(3_000, 1), np.arange(3_000) % 4 == 0
    lean = np.random.default_rng(2).normal(size=600)
    index = T.BlockMaxIndex.build(vectors, 600, labels.astype(float), lean, block=200)
    dense = np.zeros((3_000, 600))
    for i, v in enumerate(vectors):
        dense[i, list(v)] = list(v.values())
    queries = [*_topics(300, 3), {}, vectors[5]]
    for query, got in zip(queries, index.nearest_of_each(queries, 15), strict=True):
        q = np.zeros(600)
        q[list(query)] = list(query.values())
        cosines, expected = dense @ q, []
        for y in (False, True):
            some = np.flatnonzero((labels == y) & (cosines > 0))
            expected += [(-cosines[i], i) for i in some[np.lexsort((some, -cosines[some]))][:15]]
        assert [i for _, i, _ in got] == [i for _, i in sorted(expected)]
        assert np.allclose([c for c, _, _ in got], [-c for c, _ in sorted(expected)], atol=1e-12)
        for _, i, share in got:
            assert share == pytest.approx((dense[i] * q * np.maximum(lean if labels[i] else -lean, 0)).sum(), abs=1e-12)
    assert index.seen == 302 * (len(index.blocks) - 1) and 0 < index.opened < 0.5 * index.seen
    sent = pickle.loads(pickle.dumps(index))
    assert list(sent.nearest_of_each(queries[:40], 15)) == list(index.nearest_of_each(queries[:40], 15))
    whole = T.BlockMaxIndex.build(vectors, 600, labels.astype(float), lean)
    assert [[i for _, i, _ in x] for x in whole.nearest_of_each(queries, 15)] == [[i for _, i, _ in x] for x in index.nearest_of_each(queries, 15)]


def test_queries_that_are_alike_are_searched_together(monkeypatch):
    """Each call of the search opens blocks for all its queries at once, whatever the order they come in."""
    r, vectors = np.random.default_rng(7), []
    for i in range(2 * T.SECTION):  # two groups of examples without a common term
        terms = 40 * (i % 2) + r.choice(40, 12, replace=False)
        vectors.append({int(t): 12**-0.5 for t in terms})
    index, searched = T.BlockMaxIndex.build(vectors, 80, block=80), []
    search = index._search
    monkeypatch.setattr(index, "_search", lambda some, *rest: searched.append({int(q[0][0]) // 40 for q in some}) or search(some, *rest))
    queries = vectors[: 2 * T.TOGETHER]
    found = list(index.nearest_of_each(queries, 5))
    assert sorted(searched, key=min) == [{0}, {1}]
    assert all(i % 2 == j % 2 for j, near in enumerate(found) for _, i, _ in near)
    assert found == [next(index.nearest_of_each([q], 5)) for q in queries]
    assert list(index.nearest_of_each([], 5)) == []


def test_association_is_none_where_chance_explains_it():
    lean = T.association(np.array([40.0, 0.0, 2.0, 5.0]), np.array([40.0, 60.0, 2.0, 50.0]), 50, 450)
    assert lean[0] > 2 and lean[2] == lean[3] == 0 and lean[1] == 0 < -T.association(np.array([0.0]), np.array([300.0]), 50, 450)[0]


def _held_out(scores, labels, name):
    y = {r.doc_id: r[name] for r in labels.collect()}
    rows = [(r.score, r.predicted, y[r.doc_id]) for r in scores.filter("held_out").collect() if y.get(r.doc_id) is not None]
    s, p, t = (np.array(x) for x in zip(*rows))
    order = s.argsort().argsort()
    auc = (order[t == 1].sum() - (t == 1).sum() * ((t == 1).sum() - 1) / 2) / ((t == 1).sum() * (t == 0).sum())
    return auc, (p == t).mean()


def test_toxicity_on_held_out_documents(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    scores = T.toxicity_scores(spark, docs, labels).cache()
    auc, accuracy = _held_out(scores, labels, "toxic")
    assert scores.count() == docs.count() and auc > 0.75 and accuracy > 0.93
    assert scores.filter("score < 0 OR score > 1 OR score IS NULL").count() == 0
    flagged = scores.filter("predicted = 1").collect()
    assert flagged and all(r.evidence for r in flagged)


def test_every_term_of_the_examples_counts(spark):
    """Common words without any association with the label still find the nearest example."""
    docs = [(i, f"{w} {w}ish and the {prose(i, 12)}") for i, w in enumerate(("harbour", "window", "garden", "letter", "mountain", "candle", "river", "basket") * 3)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in docs], "doc_id bigint, toxic int")
    docs = [*docs, (100, "the river riverish"), (101, "of letters, letterish"), (102, "qqq 17")]
    none = lambda doc_id: doc_id < 0
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    rows = {r.doc_id: r for r in T.toxicity_scores(spark, frame, labels, fold=none).collect()}
    assert {e.doc_id % 8 for e in rows[100].evidence[:3]} == {6} and {e.doc_id % 8 for e in rows[101].evidence[:3]} == {3}
    assert rows[102].evidence == []
    model = T.fit_toxicity(spark, frame, labels, fold=none)
    assert (model.idf > 0).all() and model.vocabulary.size == len({t for i, x in docs if i < 100 for t in T.term_set(x.encode())})


def test_toxicity_without_usable_labels(spark):
    labels = spark.createDataFrame([(1, None), (None, 1), (99, 1)], "doc_id bigint, toxic int")
    rows = T.toxicity_scores(spark, awkward(spark), labels).collect()
    assert len(rows) == len(awkward_rows()) and len({r.score for r in rows}) == 1 and all(0 <= r.score <= 1 for r in rows)
    assert T.toxicity_scores(spark, nothing(spark), labels).count() == 0


def test_flattened_trees_follow_the_splits():
    r = np.random.default_rng(2)
    x = r.random((600, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(float)
    trees = Q.fit_trees(x, y, n_trees=30, depth=3)
    assert ((trees.score(x) >= 0.5) == y).mean() > 0.97

    def walk(row):
        total = trees.base
        for t in range(len(trees.feature)):
            at = 0
            while trees.left[t, at] != at:
                at = trees.left[t, at] if row[trees.feature[t, at]] <= trees.threshold[t, at] else trees.right[t, at]
            total += trees.value[t, at]
        return total

    assert np.allclose(trees.margin(x[:50]), [walk(row) for row in x[:50]])


def test_statistics_are_finite():
    for row in awkward_rows():
        values = Q.statistics((row[1] or "").encode())
        assert len(values) == len(Q.FEATURES) and np.isfinite(values).all()


def test_quality_on_held_out_documents(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    scores = Q.quality_scores(spark, docs, labels)
    auc, accuracy = _held_out(scores, labels, "quality")
    assert auc > 0.98 and accuracy > 0.97
    kept = Q.keep_good(spark, docs, labels)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(r.doc_id for r in scores.filter("predicted = 1").collect())


def test_quality_without_usable_labels(spark):
    labels = spark.createDataFrame([(1, None), (None, 1), (99, 1)], "doc_id bigint, quality int")
    rows = Q.quality_scores(spark, awkward(spark), labels).collect()
    assert len(rows) == len(awkward_rows()) and {r.score for r in rows} == {0.5}
    assert Q.quality_scores(spark, nothing(spark), labels).count() == 0
    assert Q.keep_good(spark, nothing(spark), labels).count() == 0


@pytest.mark.parametrize("fold, modulus, rest", [(Q.HELD_OUT, 3, 1), (T.held_out, 5, 0)])
def test_folds_follow_the_checksum(spark, fold, modulus, rest):
    from zlib import crc32

    from pyspark.sql import functions as F

    got = {r.id: r.h for r in spark.range(200).select("id", fold(F.col("id")).alias("h")).collect()}
    assert got == {i: crc32(str(i).encode()) % modulus == rest for i in range(200)}


def test_a_labelled_id_with_many_rows_is_one_example(spark):
    """A third of the rows under one labelled id: the sample stays bounded, and the model does not see them all."""
    from funnelkit.llm import quality as Q

    rows = [(i, prose(i, 30)) for i in range(60)] + [(3, prose(100 + i, 20)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(60)], "doc_id bigint, quality int, toxic int")
    model = T.fit_toxicity(spark, docs, labels)
    assert len(model.ids) == len(set(model.ids.tolist())) <= 60
    for scores in (T.toxicity_scores(spark, docs, labels), Q.quality_scores(spark, docs, labels)):
        assert scores.count() == 120
    least = {i: min(t for d, t in rows if d == i) for i in range(60)}
    single = spark.createDataFrame(sorted(least.items()), "doc_id bigint, text string")
    assert T.fit_toxicity(spark, single, labels).ids.tolist() == model.ids.tolist()


def test_rows_are_scored_together_and_equal_rows_get_equal_sums():
    rng = np.random.default_rng(5)
    weights = rng.random(7)
    starts, terms = np.array([0, 7, 7, 14, 16]), np.concatenate([np.arange(7), np.arange(7), [2, 5]])
    query = rng.random(8)
    got = T._sums(np.array([2, 1, 3, 0]), starts, terms, np.concatenate([weights, weights, [1.0, 2.0]]), query)
    assert got[0] == got[3] and got[1] == 0
    np.testing.assert_allclose(got, [query[:7] @ weights, 0, query[2] + 2 * query[5], query[:7] @ weights], rtol=1e-12)
    # both labels in one call, each with its own k nearest
    vectors = [{0: 1.0}, {0: 0.6, 1: 0.8}, {1: 1.0}, {0: 0.8, 1: 0.6}, {2: 1.0}]
    index = T.BlockMaxIndex.build(vectors, 3, np.array([0, 1, 0, 1, 1]))
    near = index.nearest({0: 0.8, 1: 0.6}, 1)
    assert [i for _, i in near] == [3, 0]
    np.testing.assert_allclose([c for c, _ in near], [1.0, 0.8])
    assert T.BlockMaxIndex.build([], 3).nearest({0: 1.0}, 2) == []


def test_fit_writes_no_table_and_keeps_nothing(spark):
    """The sample is no table of one file per shuffle partition, and nothing of the fit stays in the session."""
    docs = spark.createDataFrame([(i, ("bad " if i % 2 else "good ") + prose(i, 20)) for i in range(40)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, toxic int")
    shared = Path(shared_dir(spark).removeprefix("file:"))
    kept = lambda: (set(shared.iterdir()), set(spark.sparkContext._jsc.getPersistentRDDs().keySet()))
    before = kept()
    assert 0 < len(T.fit_toxicity(spark, docs, labels).ids) < 40
    assert kept() == before


def test_grouping_like_examples_takes_one_copy_of_them():
    rng = np.random.default_rng(3)
    weights = rng.random((8_192, 128), np.float32)
    tracemalloc.start()
    blocks = T._like_together(np.arange(len(weights)), weights)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(np.concatenate(blocks).tolist()) == list(range(len(weights))) and max(map(len, blocks)) <= T.WIDTH
    assert peak < 1.5 * weights.nbytes
