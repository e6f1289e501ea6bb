"""Operator 5: toxicity from the nearest labelled examples.

Terms are lower-cased words and word beginnings, weighted by term and inverse document frequency. A
bounded sample of labelled examples gives the vocabulary (every term of theirs) and the index; document
frequencies are counted over all documents. A document's ``k`` nearest examples of either label by the cosine
are found exactly with a block-max index. Each votes for its label by its closeness and by how
much of the cosine comes from terms that go with this label; a logistic curve, fitted to the
leave-one-out votes of the examples themselves, turns the votes into a probability. The
neighbours are the evidence. Whatever is chosen by labels (associations, curve) is learned from the examples,
none of which is held out.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from funnelkit.llm.common import id_and_text, parts_of

PER_LABEL = 6_000  # most examples of a label
SIGNIFICANT = 15.0  # log-likelihood ratio of a term with the label that chance gives one term in 10,000
ALONE = 0.002  # vote of closeness alone, beside that of the terms that go with the label
UNKNOWN = 0.0002  # votes of the examples without any neighbour
BATCH = 6 << 20  # bytes of text that are looked up at a time
PREFIX = 4
NEIGHBOURS = 15  # of each label
WIDTH = 32  # examples of a block
FIRST = 3  # blocks of highest bound, beside those that k examples fill, that are opened first
SECTION = 1_024  # rows that have their common terms in common
COMMON = 16  # terms in more than one in so many of these rows are bounded block by block
MOST_COMMON = 2_048  # terms at most
TOGETHER = 128  # queries searched at a time
MOST = 0.3  # share of a section's blocks from which on they are summed as one
ROUNDING = 1e-4  # relative, of a sum of some thousand products in single precision

#: A-Z to lower case, ASCII marks and digits to spaces.
FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if c < 128 and not chr(c).isalpha() else c for c in range(256))


def held_out(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def tokens(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def term_set(text: bytes) -> set[bytes]:
    """Words, and beginnings of longer words marked with a leading ^."""
    words = set(tokens(text))
    return words | {b"^" + p for p in {w[:PREFIX] for w in words if len(w) > PREFIX}}


class Vocabulary:
    def __init__(self, terms: list[bytes]) -> None:
        start = np.array([t.startswith(b"^") for t in terms], bool)
        self.words = pa.array([t for t in terms if not t.startswith(b"^")], pa.binary())
        self.starts = pa.array([t[1:] for t in terms if t.startswith(b"^")], pa.binary())
        self.word_terms, self.start_terms = (np.append(np.flatnonzero(x), -1) for x in (~start, start))
        self.size = len(terms)

    def counts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Occurrences of the vocabulary's terms: text, term and number, in the order of text and
        term. Every distinct word is looked up once."""
        split = pc.ascii_split_whitespace(pa.array([t.translate(FOLD) for t in texts], pa.binary()).view(pa.string()))
        text = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
        coded = pc.list_flatten(split).dictionary_encode()
        words, code = coded.dictionary.view(pa.binary()), coded.indices.to_numpy()
        long = pc.binary_length(words).to_numpy(zero_copy_only=False) > PREFIX
        start = pc.binary_slice(words, 0, PREFIX).dictionary_encode()
        word = self.word_terms[_found(words, self.words)]
        start = np.where(long, self.start_terms[_found(start.dictionary, self.starts)][start.indices.to_numpy()], -1)
        keys = [(text * self.size + x[code])[x[code] >= 0] for x in (word, start)]
        keys, n = np.unique(np.concatenate(keys), return_counts=True)
        return keys // max(1, self.size), (keys % max(1, self.size)).astype(np.int32), n


def _found(words: pa.Array, known: pa.Array) -> np.ndarray:
    """Position of each word among the known ones, -1 for others."""
    return pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy(zero_copy_only=False)


Vector = tuple[np.ndarray, np.ndarray]  # terms, weights


def _like_together(rows: np.ndarray, weights: np.ndarray) -> list[np.ndarray]:
    """Blocks of rows that are like each other: halved across the direction in which they spread
    most (some steps of power iteration), until a block is left."""
    if len(rows) <= WIDTH:
        return [rows] if len(rows) else []
    apart = weights[rows]
    apart -= apart.mean(axis=0)
    spread = [(x * x).sum(axis=1) for x in np.array_split(apart, -(-len(rows) // SECTION))]
    along = apart[np.argmax(np.concatenate(spread))]
    for _ in range(4):
        along = apart.T @ (apart @ along)
        along /= np.linalg.norm(along) + 1e-12
    rows = rows[np.argsort(apart @ along, kind="stable")]
    del apart
    half = -(-len(rows) // (2 * WIDTH)) * WIDTH
    return _like_together(rows[:half], weights) + _like_together(rows[half:], weights)


class Runs:
    """Numbers in runs, each run with two arrays of them. Arrow copies a run of bytes as a whole, where numpy
    would gather number by number."""

    def __init__(self, starts: np.ndarray, *values: np.ndarray) -> None:
        self.sizes = np.diff(starts)
        self.kinds = [x.dtype for x in values]
        self.values = [
            pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int64) * x.itemsize), pa.py_buffer(np.ascontiguousarray(x))])
            for x in values
        ]

    def of(self, which: np.ndarray) -> tuple[np.ndarray, ...]:
        """Lengths of some runs and their numbers, one run after the other."""
        sizes, which = self.sizes[which], pa.array(which)
        n = int(sizes.sum())
        if not n:
            return sizes, *(np.zeros(0, kind) for kind in self.kinds)
        return sizes, *(np.frombuffer(x.take(which).buffers()[2], kind, n) for x, kind in zip(self.values, self.kinds))

    def sums(self, which: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Of each run of places and weights the products of its weights and the query's, summed in their order: equal
        runs have equal sums."""
        sizes, places, weights = self.of(which)
        return np.bincount(np.repeat(np.arange(len(which)), sizes), query.take(places) * weights, minlength=len(which))


@dataclass
class Section:
    """Blocks of like examples and the terms that are common in them."""

    low: int  # rows
    high: int
    blocks: slice
    terms: np.ndarray  # the common ones
    columns: slice | None = None  # among those of all sections
    dense: np.ndarray | None = None  # rows x common terms
    largest: np.ndarray | None = None  # blocks x common terms


@dataclass
class BlockMaxIndex:
    """Examples in blocks of like ones of one label, and these in sections. The postings of terms that
    are common in a section are kept block by block with each term's largest weight there; all other
    postings, of terms that few of its examples hold, as one list a term.

    A search sums the other terms first. A block's bound is the largest such sum in it and,
    of every common term of the query, the block's largest weight; common terms are summed only in
    blocks whose bound reaches the k-th best of some examples scored at once, all other
    blocks are skipped. Single precision leaves all that may be among the nearest; those are scored in double precision.
    """

    example: np.ndarray  # of each row
    groups: list[tuple[int, int]]  # rows of each label
    blocks: np.ndarray  # first row of each block
    sections: list[Section]
    section: np.ndarray  # of each block
    starts: np.ndarray  # other postings of each term
    rows: np.ndarray
    weights: np.ndarray
    common_starts: np.ndarray  # common terms of the rows (columns of their section), in double precision
    common_columns: np.ndarray
    common_weights: np.ndarray
    lean_starts: np.ndarray  # terms of the rows that go with the label, weights times how far they do
    lean_terms: np.ndarray
    lean_weights: np.ndarray
    postings: Runs | None = None  # rows and weights by term
    common: Runs | None = None  # columns among those of all sections and weights by row
    lean: Runs | None = None  # places among the leaning terms and weights by row
    columns: np.ndarray | None = None  # of all sections by term
    column_starts: np.ndarray | None = None
    column_section: np.ndarray | None = None
    usual: np.ndarray | None = None  # mean weight in each column
    leaning: np.ndarray | None = None  # terms that go with a label
    seen: int = 0  # blocks times queries so far
    opened: int = 0

    @classmethod
    def build(
        cls, vectors: Sequence[dict[int, float] | Vector], n_terms: int,
        labels: np.ndarray | None = None, lean: np.ndarray | None = None, block: int | None = None,
    ) -> BlockMaxIndex:
        """If given, the ``block`` most frequent terms (the first ones) are common in every section. ``lean`` is
        each term's association with label 1 (above 0) or 0 (below)."""
        vectors = [_vector(v) for v in vectors]
        labels = np.zeros(len(vectors)) if labels is None else np.asarray(labels)
        held = np.zeros(n_terms, np.int64)
        for terms, _ in vectors:
            held[terms] += 1
        frequent = np.sort(np.argsort(-held, kind="stable")[: min(MOST_COMMON, int((held > len(vectors) / COMMON).sum()))])
        column = np.full(n_terms, -1)
        column[frequent] = np.arange(len(frequent))
        parts = []
        for y in np.unique(labels):
            mine = np.flatnonzero(labels == y)
            dense = np.zeros((len(mine), len(frequent)), np.float32)
            for row, (terms, weights) in enumerate(vectors[i] for i in mine):
                low = column[terms] >= 0
                dense[row, column[terms[low]]] = weights[low]
            parts.append([mine[b] for b in _like_together(np.arange(len(mine)), dense)])
            del dense
        ends = np.cumsum([0] + [sum(map(len, p)) for p in parts]).tolist()
        example = np.concatenate([np.zeros(0, np.int64), *(b for p in parts for b in p)]).astype(np.int64)
        blocks = np.cumsum([0] + [len(b) for p in parts for b in p])

        terms = np.concatenate([np.zeros(0, np.int32), *(vectors[i][0] for i in example)]).astype(np.int32, copy=False)
        weights = np.concatenate([np.zeros(0), *(vectors[i][1] for i in example)])
        sizes = [len(vectors[i][0]) for i in example]
        row, starts = np.repeat(np.arange(len(example), dtype=np.int32), sizes), np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        sections, columns = [], np.full(len(terms), -1, np.int16)
        for low, high in ((a, min(a + SECTION, y)) for x, y in zip(ends[:-1], ends[1:]) for a in range(x, y, SECTION)):
            here = slice(starts[low], starts[high])
            held = np.bincount(terms[here], minlength=n_terms)
            if block is None:
                some = np.argsort(-held, kind="stable")[: min(MOST_COMMON, int((held > (high - low) / COMMON).sum()))]
            else:
                some = np.arange(min(block, n_terms))
            column = np.full(n_terms, -1, np.int16)
            column[some] = np.arange(len(some))
            columns[here] = column[terms[here]]
            sections.append(Section(low, high, slice(*np.searchsorted(blocks, (low, high)).tolist()), some.astype(np.int32)))
        common = columns >= 0
        order = np.flatnonzero(~common)
        order = order[np.argsort(terms[order], kind="stable")]
        sign = np.where(labels[example] == 1, 1.0, -1.0)
        going = np.zeros(0, np.int64) if lean is None else np.flatnonzero(lean[terms] * sign[row] > 0)
        index = cls(
            example, list(zip(ends[:-1], ends[1:])), blocks, sections,
            np.repeat(np.arange(len(sections)), [x.blocks.stop - x.blocks.start for x in sections]),
            np.searchsorted(terms[order], np.arange(n_terms + 1)), row[order], weights[order],
            np.searchsorted(row[common], np.arange(len(example) + 1)), columns[common], weights[common],
            np.searchsorted(row[going], np.arange(len(example) + 1)), terms[going], weights[going] * (0.0 if lean is None else np.abs(lean[terms[going]])),
        )
        return index

    def _fill(self) -> None:
        """What follows from the postings, made where a search is: matrices of the sections, indices as
        numpy wants them. Only the postings are sent to the tasks."""
        self.rows = self.rows.astype(np.min_scalar_type(len(self.example)))
        self.postings = Runs(self.starts, self.rows, self.weights)
        # The sections' common terms one after the other, as columns, and the columns of each term.
        terms, ends = _joined([x.terms for x in self.sections]), np.cumsum([0] + [len(x.terms) for x in self.sections]).tolist()
        self.column_section = np.repeat(np.arange(len(self.sections)), np.diff(ends))
        self.columns = np.argsort(terms, kind="stable")
        self.column_starts = np.searchsorted(terms[self.columns], np.arange(len(self.starts)))
        self.usual = np.zeros(len(terms))
        places = np.zeros(len(self.common_columns), np.min_scalar_type(len(terms)))
        for x, low, high in zip(self.sections, ends[:-1], ends[1:]):
            here = slice(self.common_starts[x.low], self.common_starts[x.high])
            x.columns = slice(low, high)
            places[here] = self.common_columns[here] + np.int64(low)
            row = np.repeat(np.arange(x.high - x.low), np.diff(self.common_starts[x.low : x.high + 1]))
            x.dense = np.zeros((x.high - x.low, len(x.terms)), np.float32)
            x.dense[row, self.common_columns[here]] = self.common_weights[here]
            x.largest = np.maximum.reduceat(x.dense, self.blocks[x.blocks] - x.low)
            self.usual[x.columns] = x.dense.mean(axis=0)
        self.common = Runs(self.common_starts, places, self.common_weights)
        # Terms that go with a label are few: numbered by themselves.
        self.leaning, places = np.unique(self.lean_terms, return_inverse=True)
        self.lean = Runs(self.lean_starts, places.reshape(-1).astype(np.min_scalar_type(len(self.leaning))), self.lean_weights)

    def nearest(self, query: dict[int, float] | Vector, k: int, skip: int = -1) -> list[tuple[float, int]]:
        """The k examples (of each label) of largest positive cosine as (cosine, example), ties to the
        smaller example."""
        return [(c, i) for c, i, _ in next(self.nearest_of_each([query], k, [skip]))]

    def nearest_of_each(
        self, queries: Sequence[dict[int, float] | Vector], k: int, skips: Sequence[int] | None = None
    ) -> Iterator[list[tuple[float, int, float]]]:
        """``nearest`` of many queries, in order, with the part of the cosine that terms going with the
        example's label give, each times how far it does. Exact: weights are positive, so a sum in
        single precision is off by less than ``ROUNDING`` of itself, and what is within twice that of
        the k-th best is scored again."""
        if self.postings is None:
            self._fill()
        if not len(self.example):
            yield from ([] for _ in queries)
            return
        queries = [_vector(q) for q in queries]
        where = np.argsort(self.example)  # row of each example
        left = np.array([-1 if skips is None or skips[j] < 0 else where[skips[j]] for j in range(len(queries))], np.int64)
        common = [self._common(queries[at : at + SECTION]) for at in range(0, len(queries), SECTION)]
        # Queries that are like the same section open the same blocks: they are searched together.
        order = np.argsort(_joined([self._likest(*x) for x in common]), kind="stable").tolist()
        found: list = [None] * len(queries)
        for at in range(0, len(order), TOGETHER):
            some = order[at : at + TOGETHER]
            places = [_part(*common[j // SECTION], j % SECTION) for j in some]
            for j, near in zip(some, self._found([queries[j] for j in some], places, k, left[some])):
                found[j] = near
        yield from found

    def _common(self, queries: list[Vector]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Columns of the queries' common terms in all sections and their weights; where each query's begin."""
        terms, weights = (_joined(x) for x in zip(*queries))
        first = self.column_starts[terms]
        sizes = self.column_starts[terms + 1] - first
        at = np.repeat(first - np.cumsum(sizes) + sizes, sizes)
        at += np.arange(len(at))
        ends = np.concatenate(([0], np.cumsum(sizes)))[np.cumsum([0] + [len(t) for t, _ in queries])]
        return self.columns.take(at), np.repeat(weights, sizes), ends

    def _likest(self, columns: np.ndarray, weights: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The section that each query is like most, by the sections' means."""
        key = np.repeat(np.arange(len(ends) - 1) * len(self.sections), np.diff(ends)) + self.column_section[columns]
        mean = np.bincount(key, weights * self.usual[columns], minlength=(len(ends) - 1) * len(self.sections))
        return mean.reshape(len(ends) - 1, -1).argmax(axis=1)

    def _found(self, queries: list[Vector], common: list[Vector], k: int, left: np.ndarray) -> list[list[tuple[float, int, float]]]:
        """``nearest_of_each`` of some queries; ``common`` are their columns and weights there."""
        rare, about, least = self._search(queries, common, k, left)
        near = [[] for _ in queries]
        for g, (low, high) in enumerate(self.groups):
            enough = np.flatnonzero(about[:, low:high] >= np.maximum(least[:, g : g + 1], np.finfo(np.float32).tiny))
            ends = np.searchsorted(enough, np.arange(len(queries) + 1) * (high - low))
            for j, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
                rows = enough[a:b] + (low - j * (high - low))
                if len(rows) > k:
                    sums = about[j, rows]
                    rows = rows[sums >= np.partition(sums, len(rows) - k)[len(rows) - k] * (1 - 2 * ROUNDING)]
                near[j].append(rows)
        # Of each query and group the k best by double precision, nearest first.
        exact, cosine = np.zeros(len(self.usual)), []
        for j, (places, weights) in enumerate(common):
            exact[places] = weights
            rows = near[j] = _joined(near[j])
            cosine.append(np.minimum(1.0, rare[j, rows] + self.common.sums(rows, exact)))
            exact[places] = 0.0
        query = np.repeat(np.arange(len(near)), [len(x) for x in near])
        rows, cosine = _joined(near), _joined(cosine)
        group = query * len(self.groups) + np.searchsorted([y for _, y in self.groups], rows, side="right")
        order = np.lexsort((self.example[rows], -cosine, group))
        group = group[order]
        best = order[np.arange(len(order)) - np.searchsorted(group, group) < k]
        best = best[np.lexsort((self.example[rows[best]], -cosine[best], query[best]))]
        ends = np.searchsorted(query[best], np.arange(len(queries) + 1)).tolist()
        rows, cosine = rows[best], cosine[best].tolist()
        example, exact, out = self.example[rows].tolist(), np.zeros(len(self.leaning)), []
        for (terms, weights), a, b in zip(queries, ends[:-1], ends[1:]):
            lean = []
            if b > a:
                at = np.searchsorted(self.leaning, terms)
                some = np.flatnonzero(self.leaning.take(at, mode="clip") == terms) if len(self.leaning) else at[:0]
                exact[at[some]] = weights[some]
                lean = self.lean.sums(rows[a:b], exact).tolist()
                exact[at[some]] = 0.0
            out.append(list(zip(cosine[a:b], example[a:b], lean)))
        return out

    def _search(self, queries: list[Vector], common: list[Vector], k: int, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each query and row the sum of the other terms and the cosine in single precision, whole where
        a block was opened; what the k nearest of each group have at least."""
        size = len(self.example)
        sums = np.zeros((len(queries), size))
        for j, (terms, weights) in enumerate(queries):
            sizes, rows, products = self.postings.of(terms)
            sums[j] = np.bincount(rows, products * np.repeat(weights, sizes), minlength=size)
            if left[j] >= 0:
                sums[j, left[j]] = -np.inf
        about = sums.astype(np.float32)
        least = np.zeros((len(queries), len(self.groups)), np.float32)
        weights = np.zeros((len(queries), len(self.usual)), np.float32)
        for j, (places, some) in enumerate(common):
            weights[j, places] = some
        bound = np.maximum.reduceat(about, self.blocks[:-1], axis=1)
        for x in self.sections:
            bound[:, x.blocks] += weights[:, x.columns] @ x.largest.T

        def add(opened: np.ndarray) -> None:
            """Adds the sums of the common terms in the blocks opened: a section at once where most are, else
            a block for all its queries at once. Blocks summed before get the same sums."""
            for x in self.sections:
                here = opened[:, x.blocks]
                who, some = (np.flatnonzero(here.any(axis=i)) for i in (1, 0))
                if not len(who):
                    continue
                who = slice(None) if len(who) == len(queries) else who
                here, mine = here[who], weights[who, x.columns]
                if here.sum() > MOST * len(here) * (some[-1] + 1 - some[0]):
                    rows = slice(self.blocks[x.blocks.start + some[0]], self.blocks[x.blocks.start + some[-1] + 1])
                    about[who, rows] = sums[who, rows] + mine @ x.dense[rows.start - x.low : rows.stop - x.low].T
                    opened[who, x.blocks.start + some[0] : x.blocks.start + some[-1] + 1] = True
                    continue
                for b in some.tolist():
                    rows, of = slice(self.blocks[x.blocks.start + b], self.blocks[x.blocks.start + b + 1]), np.flatnonzero(here[:, b])
                    at = of if isinstance(who, slice) else who[of]
                    about[at, rows] = sums[at, rows] + mine[of] @ x.dense[rows.start - x.low : rows.stop - x.low].T

        # The k-th best in the blocks of highest bound, which the k-th best of all is not below.
        first, opened = {}, np.zeros(bound.shape, bool)
        for g, (low, high) in enumerate(self.groups):
            mine = slice(*np.searchsorted(self.blocks, (low, high)))
            if high - low > k:
                n = min(FIRST + -(-k // WIDTH), mine.stop - mine.start)
                first[g] = mine.start + np.argsort(-bound[:, mine], axis=1, kind="stable")[:, :n]
                np.put_along_axis(opened, first[g], True, axis=1)
        add(opened)
        need = np.zeros(bound.shape, bool)
        for g, (low, high) in enumerate(self.groups):
            mine = slice(*np.searchsorted(self.blocks, (low, high)))
            for j, some in enumerate(first[g].tolist() if g in first else ()):
                whole = np.concatenate([about[j, self.blocks[b] : self.blocks[b + 1]] for b in some])
                if len(whole) >= k:
                    least[j, g] = np.partition(whole, len(whole) - k)[len(whole) - k]
            least[:, g] = np.maximum(least[:, g], 0) * (1 - 2 * ROUNDING)
            need[:, mine] = (bound[:, mine] * (1 + ROUNDING) >= least[:, g : g + 1]) & (bound[:, mine] > 0)
        need &= ~opened
        add(need)
        self.seen, self.opened = self.seen + need.size, self.opened + int((need | opened).sum())
        return sums, about, least


def _joined(parts: Sequence[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if len(parts) else np.zeros(0, np.int64)


def _part(columns: np.ndarray, weights: np.ndarray, ends: np.ndarray, i: int) -> Vector:
    return columns[ends[i] : ends[i + 1]], weights[ends[i] : ends[i + 1]]


def _sums(rows: np.ndarray, starts: np.ndarray, terms: np.ndarray, weights: np.ndarray, query: np.ndarray) -> np.ndarray:
    """``Runs.sums`` of rows given by their terms and weights."""
    return Runs(starts, terms, weights).sums(rows, query)


def _vector(v: dict[int, float] | Vector) -> Vector:
    if isinstance(v, dict):  # by term, so that equal vectors are summed in one order
        v = sorted(v.items())
        return np.array([t for t, _ in v], np.int32), np.array([w for _, w in v], float)
    return v


@dataclass
class ToxicityModel:
    vocabulary: Vocabulary
    idf: np.ndarray
    index: BlockMaxIndex
    ids: np.ndarray
    labels: np.ndarray
    prior: float
    slope: float = 1.0
    shift: float = 0.0
    k: int = NEIGHBOURS

    def vectors(self, n_texts: int, text: np.ndarray, terms: np.ndarray, n: np.ndarray) -> list[Vector]:
        """Unit vectors of texts, of ``Vocabulary.counts``."""
        raw = 1 + np.log(n)
        raw *= self.idf[terms]
        ends = np.searchsorted(text, np.arange(n_texts + 1))
        raw /= np.sqrt(np.bincount(text, raw * raw, minlength=n_texts))[text]
        return [(terms[a:b], raw[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def votes(self, found: list[list[tuple[float, int, float]]]) -> np.ndarray:
        """Share of label 1 among the votes of each text's neighbours. An example votes by its closeness
        and by the part of the cosine whose terms go with its label; a few votes of what documents
        without any neighbour are get mixed in."""
        text = np.repeat(np.arange(len(found)), [len(x) for x in found])
        cosine, example, lean = _columns(found)
        w = (ALONE + lean) * cosine / (1.05 - cosine)
        yes, total = (np.bincount(text, x, minlength=len(found)) for x in (w * self.labels[example.astype(int)], w))
        return np.clip((yes + UNKNOWN * self.prior) / (total + UNKNOWN), 1e-6, 1 - 1e-6)

    def probabilities(self, votes: np.ndarray) -> np.ndarray:
        z = self.slope * np.log(votes / (1 - votes)) + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def scores(self, texts: list[bytes]) -> tuple[np.ndarray, list[list[tuple[float, int, float]]]]:
        """Probability and nearest examples of each text."""
        found = list(self.index.nearest_of_each(self.vectors(len(texts), *self.vocabulary.counts(texts)), self.k))
        return self.probabilities(self.votes(found)), found


def _columns(found: list[list[tuple[float, int, float]]]) -> np.ndarray:
    return np.array([x for near in found for x in near], float).reshape(-1, 3).T


def log_likelihood_ratio(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int) -> np.ndarray:
    """G statistic of the 2x2 table of term and label, per term."""
    total = n_pos + n_neg
    g = np.zeros(len(pos))
    for seen, label in ((pos, n_pos), (neg, n_neg)):
        for here, expected in ((seen, (pos + neg) * label / total), (label - seen, (total - pos - neg) * label / total)):
            with np.errstate(divide="ignore", invalid="ignore"):
                g += np.where(here > 0, here * np.log(here / expected), 0.0)
    return 2 * g


def association(pos: np.ndarray, n: np.ndarray, n_pos: int, n_neg: int) -> np.ndarray:
    """Log odds ratio of each term with label 1, 0 where chance may explain it."""
    g = log_likelihood_ratio(pos, n - pos, n_pos, n_neg)
    ratio = np.log((pos + 0.5) * (n_neg + 1) / ((n - pos + 0.5) * (n_pos + 1)))
    return np.where(g >= SIGNIFICANT, ratio, 0.0)


def calibrate(votes: np.ndarray, y: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve from vote log-odds to labels (Newton, weighted)."""
    z = np.log(votes / (1 - votes))
    coef = np.array([1.0, 0.0])
    x = np.stack([z, np.ones_like(z)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ coef, -30, 30)))
        grad = x.T @ (weights * (p - y)) + 1e-2 * (coef - [1.0, 0.0])
        hess = (x * (weights * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        coef = coef - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return max(float(coef[0]), 1e-3), float(coef[1])


def fit_toxicity(
    spark: SparkSession, docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL,
    fold=held_out, id_col: str = "doc_id", text_col: str = "text",
) -> ToxicityModel:
    """The index over at most ``per_label`` examples of either label outside the held-out fold,
    the ones whose hashed id comes first. What the driver gets is bounded by their
    texts; every term of theirs is in the vocabulary, the most frequent first. Document frequencies are summed over all documents."""
    texts = docs.select(*id_and_text(docs, id_col, text_col))
    usable = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y"))
        .filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~fold(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("y").alias("y"))
    )
    totals = {r["y"]: r["count"] for r in usable.groupBy("y").count().collect()}
    first = lambda y: usable.filter(F.col("y") == y).orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(per_label)
    # One text per id, whatever the number of documents that have it, so that the sample is bounded.
    labelled = texts.join(F.broadcast(first(0).union(first(1))), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    # Read four times, kept on the executors' disks: a table would be as many files as shuffle partitions, a process each to set
    # the mode of a file where Hadoop has no native library. Lost parts are computed again, to the same rows.
    sample = labelled.persist(StorageLevel.DISK_ONLY)

    def terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches):
            rows = [(t, y) for x, y in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("y").to_pylist()) for t in term_set(x)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([t for t, _ in rows], pa.binary()), pa.array([y for _, y in rows], pa.int32())], names=["term", "y"]
            )

    sizes = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    n_pos, n_neg = sizes.get(1, 0), sizes.get(0, 0)
    seen = (
        sample.select("text", "y").mapInArrow(terms_of, "term binary, y int")
        .groupBy("term").agg(F.sum("y").alias("pos"), F.count("*").alias("n"))
        .toArrow()
    )
    seen = seen.sort_by([("n", "descending"), ("term", "ascending")])
    terms = seen["term"].to_pylist()
    pos, n = (seen[c].to_numpy().astype(float) for c in ("pos", "n"))
    vocabulary = Vocabulary(terms)
    known = spark.sparkContext.broadcast(vocabulary)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(known.value.size + 1, dtype=np.int64), 0
        for batch in parts_of(batches, size=BATCH):
            df[:-1] += np.bincount(known.value.counts(batch.column("text").cast(pa.binary()).to_pylist())[1], minlength=known.value.size)
            n += len(batch)
        df[-1] = n
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], names=["term", "df"])

    counted = texts.select("text").mapInArrow(frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(vocabulary.size + 1)
    df[counted["term"].to_numpy()] = counted["df"].to_numpy()
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1e-3

    def counts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches):
            text, terms, n = known.value.counts(batch.column("text").cast(pa.binary()).to_pylist())
            ends = pa.array(np.searchsorted(text, np.arange(len(batch) + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("y"), pa.ListArray.from_arrays(ends, pa.array(terms)), pa.ListArray.from_arrays(ends, pa.array(n.astype(np.int32)))],
                names=["doc_id", "y", "terms", "counts"],
            )

    rows = sample.mapInArrow(counts_of, "doc_id long, y int, terms array<int>, counts array<int>").toArrow()
    rows = rows.take(np.argsort(rows["doc_id"].to_numpy(), kind="stable")).combine_chunks()
    ids, y = rows["doc_id"].to_numpy(), rows["y"].to_numpy().astype(float)
    per = {c: totals.get(c, 0) / max(1, sizes.get(c, 0)) for c in (0, 1)}  # labelled rows that an example stands for
    weights = np.array([per[int(c)] for c in y], dtype=float)
    model = ToxicityModel(vocabulary, idf, BlockMaxIndex.build([], 0), ids, y, 0.5)
    held = np.repeat(np.arange(len(ids)), pc.list_value_length(rows["terms"]).to_numpy())
    flat = [pc.list_flatten(rows[c]).to_numpy() for c in ("terms", "counts")]
    del rows, seen
    vectors = model.vectors(len(ids), held, *flat)
    del held, flat
    lone = np.array([not len(t) for t, _ in vectors], dtype=bool)
    model.prior = float(((weights * y)[lone].sum() + 0.5) / (weights[lone].sum() + 1)) if len(ids) else 0.5
    both = bool(n_pos and n_neg)
    model.index = BlockMaxIndex.build(vectors, vocabulary.size, y, association(pos, n, n_pos, n_neg) if both else None)
    if both:
        del vectors
        sent = spark.sparkContext.broadcast(model)

        def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = sent.value
            for batch in parts_of(batches):
                vectors = m.vectors(len(batch), *m.vocabulary.counts(batch.column("text").cast(pa.binary()).to_pylist()))
                itself = np.searchsorted(m.ids, batch.column("doc_id").to_numpy())
                votes = m.votes(list(m.index.nearest_of_each(vectors, m.k, itself)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(votes)], names=["doc_id", "vote"])

        votes = sample.select("doc_id", "text").mapInArrow(alone, "doc_id long, vote double").toArrow().sort_by("doc_id")["vote"].to_numpy()
        model.slope, model.shift = calibrate(votes, y, weights)
        sent.destroy()
    known.destroy()
    sample.unpersist()
    return model


def toxicity_scores(
    spark: SparkSession, docs: DataFrame, labels: DataFrame, fold=held_out, id_col: str = "doc_id", text_col: str = "text", **options
) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted, evidence (the neighbours' doc_id
    and cosine, nearest first).

    A text without any word of the examples (null and empty ones too) has no evidence and the score
    of such texts among the examples; words that no example has count for nothing. Rows that repeat an id are scored
    each; of a labelled id the least text is an example. Labels that are null or neither 0 nor 1, or have no
    document, are not learned from; without labels of both kinds every score is 0.5 or
    the smoothed share of the one label. An empty table gives an empty result.
    """
    model = spark.sparkContext.broadcast(fit_toxicity(spark, docs, labels, fold=fold, id_col=id_col, text_col=text_col, **options))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in parts_of(batches, size=BATCH):
            scores, found = m.scores(batch.column("text").cast(pa.binary()).to_pylist())
            cosine, example, _ = _columns(found)
            near = pa.StructArray.from_arrays([pa.array(m.ids[example.astype(int)], pa.int64()), pa.array(cosine)], ["doc_id", "cosine"])
            ends = np.cumsum([0] + [len(x) for x in found]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)), pa.ListArray.from_arrays(ends, near)],
                names=["doc_id", "held_out", "score", "predicted", "evidence"],
            )

    rows = docs.select(*id_and_text(docs, id_col, text_col), fold(F.col(id_col)).alias("held_out"))
    return rows.mapInArrow(
        run, "doc_id long, held_out boolean, score double, predicted int, evidence array<struct<doc_id: long, cosine: double>>"
    )
