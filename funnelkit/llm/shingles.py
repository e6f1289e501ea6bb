"""Operator 13: exact n-gram Jaccard join with a token-group matrix.

Texts become sets of shingle hashes; equal sets are one class from there on. Similar classes are put in
groups, a group's tokens are united, and a class is compared with the members of a group only if its
overlap with that union can reach the similarity:

1. The pass over the texts keeps the class and a lead: its lowest hashes, so many that two linked
   sets share a known number of them. A class whose lead tokens occur too rarely in other classes
   has no link and goes. That leaves near copies and texts with long shared passages.
2. What is left is linked to centres: every class votes, by its lead tokens, for one class that has them
   too, and is compared with that one. Linked classes get one label, and the next
   round counts tokens under other labels only. So most of a family of copies is joined,
   whatever its size, by comparisons that are linear in it.
3. The rest goes through the matrix. Classes that share tokens form a group; the matrix holds the distinct
   (token, group) pairs. Any partner has one of a class's least spread tokens, so these look up
   the groups to consider. A group is cut by set size and then into parts of bounded size. A task holds one
   part, unites its tokens, bounds each query's overlap with the union, and opens the part only
   for queries that qualify.

Links between classes of one label are never looked for, as they cannot change the components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from funnelkit.llm.common import id_and_text, materialize, parts_of
from funnelkit.llm.graph import components

SHINGLE = 4
PERCENT = 85
ROUNDS = 1  # rounds of links to centres
BROADCAST_ROWS = 500_000  # a table of a few numbers a row is broadcast up to this many rows
PART_TOKENS = 250_000  # tokens of the members of one part
WORDS = 1 << 17  # words whose hashes a task remembers

#: Odd multipliers of a shingle's words and of the final mix (digits of pi in hexadecimal).
_PLACES = np.array([0x243F6A8885A308D3, 0x13198A2E03707345, 0xA4093822299F31D1, 0x082EFA98EC4E6C89], dtype=np.uint64)
_MIX = np.uint64(0x452821E638D01377)


def required(n, percent: int = PERCENT):
    """Tokens that a set of n shares with any linked set, at least: ceil(n * percent / 100). For
    numbers and, with integer division written so that Spark understands it, see ``_required``."""
    return -(-n * percent // 100)


def shared_lead(n: int, percent: int = PERCENT) -> int:
    """Lead tokens that two linked sets have in common if the smaller has n."""
    return 1 + (n - required(n, percent)) // 4


def lead_size(n: int, percent: int = PERCENT) -> int:
    """Two sets in one order that share ``required`` tokens share s of their first
    n - required + s ones."""
    return n - required(n, percent) + shared_lead(n, percent)


def _required(n: Column, percent: int) -> Column:
    return F.ceil(n * percent / 100).cast("long")


def _needed(n: Column, percent: int) -> Column:
    """``shared_lead`` of the smallest set that n can be linked with."""
    least = _required(n, percent)
    return F.floor((least - _required(least, percent)) / 4).cast("long") + 1


class _Hashes(dict):
    """Signed 64-bit hash of a word, made once."""

    def __init__(self, seed: int) -> None:
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word, self.seed)
        self[word] = h = h - (1 << 64) if h >> 63 else h
        return h


def token_set(text: bytes, hashes: _Hashes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes (unsigned) of the shingles; of the whole sequence if it has fewer words."""
    words = text.lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(words) < shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), hashes.seed + 1)], dtype=np.uint64)
    if len(hashes) > WORDS:
        hashes.clear()
    at = np.array(list(map(hashes.__getitem__, words)), dtype=np.int64).view(np.uint64)
    n = len(words) - shingle + 1
    mixed = np.zeros(n, dtype=np.uint64)
    for i in range(shingle):
        mixed = mixed * _MIX + at[i : i + n] * _PLACES[i % 4]
    mixed ^= mixed >> np.uint64(31)
    mixed *= _MIX
    mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def _arrays(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0] + [len(p) for p in parts])
    flat = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat.view(np.int64)))


def lead_table(rows: DataFrame, seed: int, shingle: int, percent: int) -> DataFrame:
    """doc_id, mark, n, class, proof, lead: of every row. class and proof are 128 bits of the set's
    hash; both are null for a text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes(seed)
        for batch in parts_of(batches):
            sets = [token_set(t, hashes, shingle) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            both = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes(), seed) for s in sets), dtype=np.int64).reshape(-1, 2)
            blank = np.array([not len(s) for s in sets], dtype=bool)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("mark"), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array(both[:, 0], mask=blank), pa.array(both[:, 1], mask=blank), _arrays([s[: lead_size(len(s), percent)] for s in sets])],
                names=["doc_id", "mark", "n", "class", "proof", "lead"])

    return rows.mapInArrow(run, "doc_id long, mark long, n long, class long, proof long, lead array<long>")


def whole_sets(rows: DataFrame, wanted: DataFrame, seed: int, shingle: int) -> DataFrame:
    """class, tokens: sets of the wanted classes (class, w_id, w_mark: a row that has it), made again from the
    text. Rows equal in id and text give a class at most once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = _Hashes(seed), set()
        for batch in parts_of(batches):
            classes = batch.column("class").to_pylist()
            new = [i for i, c in enumerate(classes) if not (c in seen or seen.add(c))]
            texts = batch.column("text").cast(pa.binary()).take(pa.array(new, pa.int64())).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([classes[i] for i in new], pa.int64()), _arrays([token_set(t, hashes, shingle) for t in texts])], names=["class", "tokens"]
            )

    texts = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("mark") == F.col("w_mark")))
    return texts.select("class", "text").mapInArrow(run, "class long, tokens array<long>")


def narrow(table: DataFrame) -> DataFrame:
    """A written table of a few numbers a row, broadcast in joins if its row count allows it."""
    return F.broadcast(table) if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else table


def elsewhere(tokens: DataFrame, flip: int = 0, label: str = "label") -> DataFrame:
    """``tokens`` (token, class and the class's label, ...) that a class of another label has as well, with ``lo`` and
    ``hi``: two labels that have the token, the same for all its rows. ``flip`` changes which ones."""
    turned = F.lit(flip).cast("long")
    order = F.col(label).bitwiseXOR(turned)
    per = tokens.groupBy("token").agg(F.min(order).alias("lo"), F.max(order).alias("hi")).filter("lo <> hi")
    return tokens.join(per, "token").select(*tokens.columns, *[F.col(c).bitwiseXOR(turned).alias(c) for c in ("lo", "hi")])


def voted(leads: DataFrame, classes: DataFrame, flip: int, percent: int, label: str = "label") -> DataFrame:
    """class, centre of the classes with enough lead tokens under other labels; centre is the label that most of
    them name, null if that are too few. ``leads``: class, label, token, as often as ``classes`` says in copies."""
    own = F.col(label)
    votes = elsewhere(leads, flip, label).groupBy("class", F.when(F.col("lo") != own, F.col("lo")).otherwise(F.col("hi")).alias("other"))
    per = votes.agg(F.count("*").alias("votes")).groupBy("class").agg(
        F.sum("votes").alias("shared"), F.max("votes").alias("most"), F.max_by("other", F.col("votes")).alias("other")
    )
    needed = _needed(F.col("n"), percent) * F.col("copies")
    return (
        per.join(classes.select("class", "n", "copies"), "class")
        .filter(F.col("shared") >= needed)
        .select("class", F.when(F.col("most") >= needed, F.col("other")).alias("centre"))
    )


def is_linked(shared: Column, a: Column, b: Column, percent: int) -> Column:
    return 100 * shared >= percent * (a + b - shared)


def centre_links(spark: SparkSession, sets: DataFrame, choice: DataFrame, percent: int) -> DataFrame:
    """a, b: classes linked with the centre they chose."""
    pairs = materialize(spark, choice.filter("centre is not null").select("class", "centre"), "pairs")
    named = materialize(spark, pairs.select(F.col("centre").alias("class")).distinct(), "centres")
    own = sets.join(narrow(pairs), "class")
    centres = sets.join(narrow(named), "class").select(F.col("class").alias("centre"), F.col("tokens").alias("there"))
    shared = F.size(F.array_intersect("tokens", "there"))
    return own.join(centres, "centre").filter(is_linked(shared, F.size("tokens"), F.size("there"), percent)).select(
        F.col("class").alias("a"), F.col("centre").alias("b")
    )


def labelled(classes: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``classes`` (class) with the label of each: its component so far, else itself."""
    if labels is None:
        return classes.withColumn("label", F.col("class"))
    named = labels.select(F.col("node").alias("class"), "root")
    return classes.join(named, "class", "left").withColumn("label", F.coalesce("root", "class")).drop("root")


def reachable(whole: DataFrame, percent: int) -> DataFrame:
    """class, label of the rows of ``whole`` (class, label, tokens) with as many tokens under other labels as a link needs."""
    shared = elsewhere(whole.select("class", "label", F.explode("tokens").alias("token"))).groupBy("class").agg(F.count("*").alias("shared"))
    sizes = whole.select("class", "label", F.size("tokens").alias("n"))
    return shared.join(sizes, "class").filter(F.col("shared") >= _required(F.col("n"), percent)).select("class", "label")


def token_groups(spark: SparkSession, whole: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The matrix of ``whole`` (class, label, tokens): (class, label, group), and for each class the groups
    (other) to consider.

    Classes that share tokens vote for the same label, the least that has a token; the label most
    named is the class's group. So similar classes meet in one group, linked or not, and a
    token they share is one cell."""
    cells = materialize(spark, elsewhere(whole.select("class", "label", F.explode("tokens").alias("token"))).drop("hi"), "cells")
    votes = cells.groupBy("class", "label", "lo").agg(F.count("*").alias("votes"))
    home = votes.groupBy("class", "label").agg(F.max_by("lo", F.col("votes")).alias("group"), F.sum("votes").alias("shared"))
    home = home.join(whole.select("class", _required(F.size("tokens"), percent).alias("needed")), "class")
    home = home.filter("shared >= needed").select("class", "label", "group", (F.col("shared") - F.col("needed") + 1).cast("int").alias("probes"))
    home = materialize(spark, home, "home")
    matrix = materialize(spark, cells.join(home.select("class", "group"), "class").select("token", "group").distinct(), "matrix")
    spread = matrix.groupBy("token").agg(F.count("*").alias("spread"))
    # All but needed - 1 of the shared tokens: a partner has one of them. The least spread ones are the cheapest.
    ranked = cells.join(home.select("class", "probes"), "class").join(spread, "token").groupBy("class", "probes").agg(
        F.sort_array(F.collect_list(F.struct("spread", "token"))).alias("t")
    )
    probes = ranked.select("class", F.explode(F.expr("slice(t, 1, probes)")).alias("t")).select("class", "t.token")
    pairs = probes.join(matrix, "token").select("class", F.col("group").alias("other")).distinct()
    return home.drop("probes"), pairs


def size_band(n: Column, percent: int) -> Column:
    """Sets that can be linked are at most one band apart."""
    return F.floor(F.log(n.cast("double")) / float(np.log(100 / percent)) * (1 - 1e-9)).cast("long")


def forest(pairs: list[tuple[int, int, int, int]]) -> list[tuple[int, int]]:
    """Of links (class, its label, class, its label) as many as join the same labels."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    found = []
    for a, label_a, b, label_b in pairs:
        if (x := root(label_a)) != (y := root(label_b)):
            parent[x] = y
            found.append((a, b))
    return found


def open_part(members: list[np.ndarray], queries: list[np.ndarray], percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """(query, members linked with it) by position. Each token set is sorted."""
    every = np.concatenate(members)
    order = np.argsort(every, kind="stable")
    holder = np.repeat(np.arange(len(members)), list(map(len, members)))[order]
    union, starts = np.unique(every[order], return_index=True)
    ends = np.append(starts[1:], len(every))
    sizes = np.array(list(map(len, members)))
    for i, tokens in enumerate(queries):
        at = np.minimum(np.searchsorted(union, tokens), len(union) - 1)
        at = at[union[at] == tokens]
        if len(at) < required(len(tokens), percent):
            continue  # the union rules every member out
        counts = ends[at] - starts[at]
        first = np.cumsum(counts) - counts
        shared = np.bincount(holder[np.arange(counts.sum()) + np.repeat(starts[at] - first, counts)], minlength=len(members))
        yield i, np.flatnonzero(100 * shared >= percent * (sizes + len(tokens) - shared))


def _opened(percent: int):
    def run(members: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int, int, int]] = []
        if len(members) and len(queries):
            sets = [np.sort(t) for t in members["tokens"]]
            there = list(zip(members["class"].tolist(), members["label"].tolist()))
            here = list(zip(queries["class"].tolist(), queries["label"].tolist()))
            for i, linked in open_part(sets, [np.sort(t) for t in queries["tokens"]], percent):
                found += [(*here[i], *there[j]) for j in linked.tolist() if here[i][1] != there[j][1]]
        return pd.DataFrame(forest(found), columns=["a", "b"], dtype=np.int64)

    return run


def matrix_links(spark: SparkSession, whole: DataFrame, percent: int, part_tokens: int = PART_TOKENS) -> DataFrame:
    """a, b: links between classes of ``whole`` (class, label, tokens) under different labels, as many as join what they join."""
    live = narrow(materialize(spark, reachable(whole, percent), "reachable"))
    home, pairs = token_groups(spark, whole.drop("label").join(live, "class"), percent)
    whole = whole.drop("label").join(narrow(home), "class").withColumn("band", size_band(F.size("tokens"), percent))
    whole = materialize(spark, whole.select("class", "label", "group", "band", "tokens"), "whole")
    parts = whole.groupBy("group", "band").agg(F.ceil(F.sum(F.size("tokens")) / part_tokens).alias("parts"))
    members = whole.join(parts, ["group", "band"]).select(
        "group", "band", F.pmod(F.xxhash64("class"), "parts").alias("part"), "class", "label", "tokens"
    )
    zero = F.lit(0).cast("long")
    near = F.explode(F.array(*[F.col("band") + d for d in (-1, 0, 1)])).alias("band")
    asked = pairs.join(whole.select("class", "band", F.size("tokens").alias("n")), "class").select("class", "n", F.col("other").alias("group"), near)
    asked = asked.join(parts, ["group", "band"]).select("class", "n", "group", "band", F.explode(F.sequence(zero, F.col("parts") - 1)).alias("part"))
    asked = materialize(spark, asked, "asked")
    # Many queries for one part go to several tasks, each with the part's members.
    keys = ["group", "band", "part"]
    turns = asked.groupBy(*keys).agg(F.ceil(F.sum("n") / (4 * part_tokens)).alias("turns"))
    there = members.join(turns, keys).select(*keys, F.explode(F.sequence(zero, F.col("turns") - 1)).alias("turn"), "class", "label", "tokens")
    here = asked.join(turns, keys).select(*keys, F.pmod(F.xxhash64("class"), "turns").alias("turn"), "class")
    here = here.join(whole.select("class", "label", "tokens"), "class").select(*keys, "turn", "class", "label", "tokens")
    keys.append("turn")
    there, here = there.toDF(*there.columns), here.toDF(*here.columns)  # both come from ``whole``: names of their own
    return there.groupBy(*keys).cogroup(here.groupBy(*keys)).applyInPandas(_opened(percent), "a long, b long")


def jaccard_links(
    spark: SparkSession, rows: DataFrame, table: DataFrame, classes: DataFrame, seed: int, shingle: int, percent: int, rounds: int, part_tokens: int
) -> DataFrame | None:
    """Links (a, b) of classes that connect all linked ones; None if there is none."""
    leads = table.filter("class is not null").select("class", F.explode("lead").alias("token"))
    choice = materialize(spark, voted(leads, classes, 0, percent, "class"), "choice")
    if choice.isEmpty():
        return None
    wanted = choice.join(classes, "class").select("class", F.col("row.doc_id").alias("w_id"), F.col("row.mark").alias("w_mark"))
    wanted = narrow(materialize(spark, wanted, "wanted"))  # where it is small the texts need no shuffle
    sets = materialize(spark, whole_sets(rows, wanted, seed, shingle), "sets")
    if not sets.groupBy("class").count().filter("count > 1").isEmpty():
        sets = materialize(spark, sets.dropDuplicates(["class"]), "sets")
    leads = materialize(spark, table.join(narrow(choice.select("class")), "class").select("class", "lead").dropDuplicates(["class"]), "leads")
    single = classes.withColumn("copies", F.lit(1))
    links = labels = None
    for turn in range(rounds):
        new = centre_links(spark, sets, choice, percent)
        links = materialize(spark, new if links is None else links.union(new), "links")
        labels = components(spark, links)
        now = materialize(spark, labelled(choice.select("class"), labels), "labels")
        tokens = leads.join(narrow(now), "class").select("class", "label", F.explode("lead").alias("token"))
        choice = materialize(spark, voted(tokens, single, xxhash.xxh64_intdigest(str(turn)) >> 1, percent), "choice")
        if choice.isEmpty():
            return links
    left = materialize(spark, labelled(choice.select("class"), labels), "labels")
    found = matrix_links(spark, sets.join(narrow(left), "class").select("class", "label", "tokens"), percent, part_tokens)
    return found if links is None else links.union(found)


def jaccard_join(
    spark: SparkSession,
    docs: DataFrame,
    shingle: int = SHINGLE,
    percent: int = PERCENT,
    rounds: int = ROUNDS,
    part_tokens: int = PART_TOKENS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per input row.

    Two texts are linked when the sets of their shingles have percent / 100 of their union in common;
    component_id is the smallest doc_id that links reach, null only if all ids of the component are. Null,
    empty and blank texts have no shingles and are linked with nothing, so their component_id is their
    own id. A text with fewer words than a shingle has one, the whole of it. Repeated rows and equal texts
    are one class and cost no comparison. Very long texts are read whole. Other columns are not read. An
    empty table gives an empty result. ``docs`` must give the same rows each time it is read.

    Shingles are compared by 64-bit hashes. Should two classes agree in the 64 bits that name
    them and not in 64 others, all hashes are drawn again with another seed.
    """
    rows = docs.select(*id_and_text(docs, id_col, text_col)).withColumn("mark", F.xxhash64("text"))
    seed = 0
    while True:
        table = materialize(spark, lead_table(rows, seed, shingle, percent), "leads")
        classes = materialize(
            spark,
            table.filter("class is not null").groupBy("class").agg(
                F.min("n").alias("n"), F.count("*").alias("copies"), F.min("doc_id").alias("first_id"), F.min(F.struct("doc_id", "mark")).alias("row"),
                (F.min("proof") != F.max("proof")).alias("mixed"),
            ),
            "classes",
        )
        if classes.filter("mixed").isEmpty():
            break
        seed += 2
    links = jaccard_links(spark, rows, table, classes, seed, shingle, percent, rounds, part_tokens)
    roots = classes.select("class", "first_id", F.col("class").alias("root"))
    if links is not None:
        labels = components(spark, links).select(F.col("node").alias("class"), F.col("root").alias("label"))
        roots = classes.join(labels, "class", "left").select("class", "first_id", F.coalesce("label", "class").alias("root"))
    firsts = roots.groupBy("root").agg(F.min("first_id").alias("component_id"))
    per_class = roots.join(firsts, "root").select("class", "component_id")
    return table.select("doc_id", F.col("n").alias("n_shingles"), "class").join(per_class, "class", "left").select(
        "doc_id", "n_shingles", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )
