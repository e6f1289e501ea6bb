"""Source mixing, packing, top-k search and the pipeline."""

import random
import zlib

import numpy as np
import pytest
from brute import SCHEMA, awkward, awkward_rows, nothing, prose
from pyspark.sql import functions as F

from funnelkit.llm import curriculum as C
from funnelkit.llm import mtree as M
from funnelkit.llm import packing as K

public_tokenizers = pytest.importorskip("public_tokenizers")
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def _targets(sizes: dict, budget=1.5, cap=2.0):
    """Reshare round by round until no source is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(order)}
    total, full = budget * sum(sizes.values()), set()
    while len(full) < len(sizes):
        rate = (total - sum(cap * sizes[s] for s in full)) / sum(weight[s] for s in sizes if s not in full)
        more = {s for s in sizes if s not in full and rate * weight[s] > cap * sizes[s]}
        if not more:
            return {s: cap * sizes[s] if s in full else rate * weight[s] for s in sizes}
        full |= more
    return {s: cap * sizes[s] for s in sizes}


def _mix_rows(seed=1, n=300):
    r = random.Random(seed)
    names = ["a", "b", "c", "d", None, "e"]
    return [(i, prose(i, r.randrange(1, 60)), "en", r.choices(names, [30, 2, 5, 5, 5, 1])[0], 1, "", "", "") for i in range(n)]


@pytest.mark.parametrize("rows", [awkward_rows(), _mix_rows()])
def test_mix_takes_each_target(spark, rows):
    out = C.curriculum_mix(spark, spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert len(out) == len(rows)
    sizes: dict = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len((r[1] or "").split())
    targets = _targets(sizes)
    for s in sizes:
        mine = [r for r in out if r.source == s]
        assert {r.source_size for r in mine} == {sizes[s]} and all(abs(r.target - targets[s]) < 1e-6 for r in mine)
        assert sum(r.taken for r in mine) == round(targets[s])
    assert all(0 <= r.taken <= 2 * r.size and r.copies <= 2 for r in out)
    again = C.curriculum_mix(spark, spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    key = lambda rs: sorted((str(r.doc_id), r.size, r.taken, tuple(r.positions)) for r in rs)
    assert key(out) == key(again)


def test_whole_documents_stay_near_the_target(spark):
    rows = _mix_rows(2)
    out = C.curriculum_mix(spark, spark.createDataFrame(rows, SCHEMA), whole_documents=True).collect()
    for s in {r.source for r in out}:
        mine = [r for r in out if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= max(r.size for r in mine) / 2 + 1
        assert all(r.taken in (0, r.size, 2 * r.size) for r in mine)
    docs = spark.createDataFrame(rows, SCHEMA)
    mixed = C.mix_documents(spark, docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in out)


def test_inverse_demand_inverts_the_integral(spark):
    for schedule in (*C.SCHEDULES, ((0.0, 0.0), (0.3, 2.0), (0.6, 2.0), (1.0, 0.0))):
        shares = [i / 40 for i in range(41)]
        df = spark.createDataFrame([(u,) for u in shares], "u double")
        times = [r.t for r in df.select(C.inverse_demand(schedule, F.col("u")).alias("t")).collect()]
        grid = np.linspace(0, 1, 200_001)
        w = np.interp(grid, *zip(*schedule))
        area = np.concatenate(([0], np.cumsum((w[1:] + w[:-1]) / 2 * np.diff(grid))))
        met = np.interp(times, grid, area / area[-1])
        assert np.allclose(met, shares, atol=1e-6) and times == sorted(times)


def test_early_sources_come_early(spark):
    """The fading source is over-represented in the first half, and positions come sorted."""
    out = C.curriculum_mix(spark, spark.createDataFrame(_mix_rows(3, 900), SCHEMA))
    order = [r.position for r in C.training_order(out).collect()]
    assert order == sorted(order) and 0 <= order[0] and order[-1] <= 1
    first = [p for r in out.filter("source = 'a'").collect() for p in r.positions]
    assert np.mean(np.array(first) < 0.5) == pytest.approx(0.6, abs=0.05)  # (7 + 5) / 2 of 10 by half time


def test_mix_of_nothing(spark):
    assert C.curriculum_mix(spark, nothing(spark)).count() == 0
    assert C.mix_documents(spark, nothing(spark)).count() == 0
    blank = spark.createDataFrame([(1, None, None, None, None, "", "", ""), (2, "", "en", "s", 0, "", "", "")], SCHEMA)
    assert [(r.size, r.taken) for r in C.curriculum_mix(spark, blank).collect()] == [(0, 0), (0, 0)]


def test_word_encoder_gives_the_tokenizers_ids():
    with open(VOCABULARY, encoding="utf-8") as f:
        encoder = K.WordEncoder(f.read())
    texts = [r[1] or "" for r in awkward_rows()] + [
        "It's o'clock, don't! 'tis 'S", "x<|endoftext|>y <|STARTOFTEXT|>", "ÉCOLE Straße İstanbul ΑΣ Σ. ﬁ ½ á Å", "a b c", "日本語 テスト。", "... ,,, 3.14 #tag @you"
    ]
    for text in texts:
        expected = encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode(text.encode()), "<u4").tolist() == expected


def test_word_encoder_on_random_words():
    """Letters that change their kind when lower-cased or normalised, final sigmas, combining marks, marks on either side."""
    with open(VOCABULARY, encoding="utf-8") as f:
        encoder = K.WordEncoder(f.read())
    r = random.Random(11)
    letters = [*"abzAHJTZ019", "\u0331", "\u030c", *"éßñİıŁÅΣσςΩЖяשあ漢ʼⅧªﬁǅK", "\u0307", "\u0301", "\u093c", "\u0958", "e\u0301", "I\u0307", "\u00a0", "\u200d"]
    marks = [*".,!?'\"-()_@#&", "--", "'s", "'LL", "…", "’s", "<|", "|>"]
    texts = ["ALİ.", "KADINLARİ,", "İ--", "İ'S", "\u0958!", "ΟΔΟΣ.", "ΟΔΟΣ", "H\u0331 T\u0308. J\u030c", "I\u0307\u093c"]
    for _ in range(20_000):
        words = ["".join(r.choice(marks if r.random() < 0.3 else letters) for _ in range(r.randrange(1, 7))) for _ in range(r.randrange(1, 4))]
        texts.append(" ".join(words))
    wrong = [t for t in texts if np.frombuffer(encoder.encode(t.encode()), "<u4").tolist() != encoder.tokenizer.encode(t, add_special_tokens=False).ids]
    assert wrong == []


def test_exchanges_raise_squared_fill_until_bins_empty():
    r = random.Random(1)
    for _ in range(40):
        sizes = [r.randrange(1, 60) for _ in range(r.randrange(1, 40))]
        start = [[i] for i in range(len(sizes))]
        done = K.local_search(start, sizes, 100)
        best = K.pack(sizes, 100)
        for bins in (done, best):
            assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
            assert all(0 < sum(sizes[i] for i in b) <= 100 for b in bins)
        square = lambda bins: sum(sum(sizes[i] for i in b) ** 2 for b in bins)
        assert square(done) >= square(start) and square(best) >= square(K.best_fit(sizes, 100))
        assert len(best) <= len(K.best_fit(sizes, 100)) and len(best) >= -(-sum(sizes) // 100)
    # A two-for-one exchange is needed: 60+20 | 50+30 | 40 in bins of 100 -> 60+40, 50+30+20.
    assert len(K.pack([60, 50, 40, 30, 20], 100)) == 2


@pytest.mark.parametrize("group_rows", [K.GROUP_ROWS, 5])
def test_pack_documents(spark, group_rows):
    rows = awkward_rows()
    out = K.pack_documents(spark, awkward(spark), VOCABULARY, sequence=64, group_rows=group_rows).collect()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(VOCABULARY)
    expected = []
    for r in rows:
        ids = tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [1]
        parts = [ids[i : i + 64] for i in range(0, len(ids), 64)]
        expected += [(str(r[0]), k, 64 * k, len(p), zlib.crc32(np.array(p, "<u4").tobytes())) for k, p in enumerate(parts)]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in out) == sorted(expected)
    held: dict = {}
    for r in out:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    bound = -(-sum(r.length for r in out) // 64)
    assert bound <= len(held) <= bound + (2 if group_rows > 5 else 0.2 * bound + 3)
    assert K.pack_documents(spark, nothing(spark), VOCABULARY).count() == 0


def _search(vectors, k=5, step=50):
    """Brute force over (id, quantised vector); scores end at 64 bits."""
    out, most = [], 2**63 - 1
    for q, v in {i: v for i, v in sorted(vectors, key=lambda x: (x[0], x[1]), reverse=True) if i % step == 0}.items():
        scored = sorted((-max(-most, min(most, sum(a * b for a, b in zip(v, w)))), i) for i, w in vectors if i != q and len(w) == len(v))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("options", [{}, {"shard_rows": 40, "query_block": 3, "page": 4}])
def test_top_k_equals_a_scan(spark, options):
    r = np.random.default_rng(7)
    rows = [(i, [float(x) for x in r.normal(size=6) / 4]) for i in range(0, 400)]
    same = [0.5, -0.25, 0.125, 0.0, 0.3, 0.1]
    rows += [(i, same) for i in range(400, 520)] + [(401, same), (50, same)]
    rows += [(1000, [1.0, 2.0]), (1001, [0.5, 0.5])]  # another length
    usable = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows]
    bad = [(2000, None), (2050, [float("nan")] * 6), (2100, [float("inf")] + [0.0] * 5), (2150, [None] + [0.1] * 5), (None, same)]
    far = [(2200, []), (2250, [1e30] * 6), (2251, [-1e30, 1e30, 1.0, 0.0, 0.0, 0.0]), (2300, [2.0**40] + [0.1] * 5), (2301, [-(2.0**33)] * 6), (2350, []), (3, [])]
    rows += far
    usable += [(i, [max(-(2**63), min(2**63 - 1, int(np.floor(256 * x)))) for x in v]) for i, v in far]
    df = spark.createDataFrame(rows + bad, "vec_id bigint, embedding array<double>").withColumn("v", F.lit("clash")).repartition(4)
    out = M.top_k(spark, df, lambda i: i % 50 == 0, **options).collect()
    assert sorted((x.query_id, x.rank, x.vec_id, x.score) for x in out) == _search(usable)


def test_top_k_of_little(spark):
    few = spark.createDataFrame([(0, [0.5]), (1, [0.25])], "vec_id bigint, embedding array<double>")
    assert [tuple(r) for r in M.top_k(spark, few, lambda i: i % 50 == 0).collect()] == [(0, 1, 1, 128 * 64)]
    none = spark.createDataFrame([], "vec_id bigint, embedding array<double>")
    assert M.top_k(spark, none, lambda i: i % 50 == 0).count() == 0


def test_tree_radii_cover_their_points():
    r = np.random.default_rng(3)
    points = np.concatenate([r.normal(size=(300, 5)), np.zeros((200, 5))])
    root = M.build(points, np.arange(500), points.mean(axis=0), page=8)

    def below(page):
        if page.rows is not None:
            assert len(page.rows) <= 8
            return page.rows.tolist()
        found = []
        assert len(page.children) <= 64
        for child, centre, radius, up in zip(page.children, page.vectors, page.radii, page.to_parent):
            rows = below(child)
            assert M.distances(points[rows], centre).max() <= radius + 1e-9
            assert abs(np.linalg.norm(centre - page.centre) - up) < 1e-9
            found += rows
        return found

    assert sorted(below(root)) == list(range(500))


def test_pipeline_stages(spark, tmp_path):
    import re

    import corpus_pipeline as pipeline
    from brute import classes, simhash

    sf = str(tmp_path)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.01/labels.parquet").write.parquet(f"{sf}/labels.parquet")
    frames = [docs]
    for name, stage in pipeline.STAGES:
        stage(spark, frames[-1], sf).write.parquet(f"{sf}/out-{name}")
        frames.append(spark.read.parquet(f"{sf}/out-{name}"))
    rows = [f.collect() for f in frames]
    assert all(f.columns == docs.columns for f in frames[:-1])
    good, exact, near, mixed, packed = rows[1:]
    assert 0 < len(good) < len(rows[0])
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    first = {}
    for r in sorted(good, key=lambda r: r.doc_id):
        first.setdefault(norm(r.text), r.doc_id)
    assert sorted(r.doc_id for r in exact) == sorted(first.values())
    prints = [simhash(r.text) for r in exact]
    group = classes(len(exact), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 2)
    assert sorted(r.doc_id for r in near) == sorted(min(r.doc_id for r, g in zip(exact, group) if g == x) for x in set(group))
    copies = {r.doc_id: r.copies for r in C.curriculum_mix(spark, frames[3], whole_documents=True).collect() if r.copies}
    assert {i: sum(r.doc_id == i for r in mixed) for i in {r.doc_id for r in mixed}} == copies
    assert sum(r.piece == 0 for r in packed) == len(mixed)
    assert pipeline.run(spark, sf).count() == len(packed)


def test_pipeline_stages_on_awkward_rows(spark, tmp_path):
    import corpus_pipeline as pipeline

    sf = str(tmp_path)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)] + [(None, None, None)], "doc_id bigint, quality int, toxic int")
    labels.write.parquet(f"{sf}/labels.parquet")
    for start in (awkward(spark), nothing(spark)):
        for _, stage in pipeline.STAGES:
            assert stage(spark, start, sf).count() <= 2 * max(1, start.count()) + 50
