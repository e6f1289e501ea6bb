"""Operator 3: removal of repeated byte strings by a sampled, sorted suffix array.

A byte goes if a string of ``SPAN`` (50) bytes that covers it also starts in a document with a
smaller doc_id. Only sampled suffixes move: of the 31 leading 20-byte strings inside each 50-byte
window the one of least hash is its anchor (the first of equals), so equal windows
have equal anchors at equal offsets, and one suffix in about 17 is an anchor. An anchor
stands for a run of consecutive windows, its block (at most 80 bytes).

1. Range partitioning. Suffixes are ordered by (hash of the leading bytes, hash of the block) and
   dealt into buckets by splitters drawn from a sample, so leading bytes that very many
   documents share are spread over several buckets. Equal blocks are combined before the shuffle.
2. Buckets sort their suffixes. A block that a smaller document holds too is covered as a whole. A
   suffix whose leading bytes also occur in a smaller document, but in other blocks, is
   undecided. Leading bytes that a splitter cuts through are compared across the boundary.
3. Undecided blocks and the ones they may match are fetched, and their windows are sorted by
   multikey quicksort (runs of equal first words go on to the next word) and compared byte by byte.
   Where more than ``HOT_ROWS`` blocks share their leading bytes, each of their windows is a row
   of its own instead, and Spark aggregates and joins those by 128-bit keys of the windows.
4. The removed runs are cut out of the texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from funnelkit.llm.common import id_and_text, materialize, parts_of

SPAN = 50
LEAD = 20
OFFSETS = SPAN - LEAD + 1
BLOCK = SPAN + OFFSETS - 1
SEGMENT = 1 << 17
FLUSH = 1_500_000  # anchors a task combines before it sends them
BUCKET_ROWS = 250_000
MAX_BUCKETS = 100_000  # splitters are broadcast: 16 bytes each
HOT_ROWS = 20_000  # undecided blocks with equal leading bytes that one task compares
SAMPLE_DOCS = 2_000
SAMPLE_ANCHORS = 256
NO_ID = (1 << 63) - 1  # null ids: after all others

_P, _Q, _R, _S = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
_LOW = np.uint64((1 << 20) - 1)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_P), n, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _Q
    return x ^ (x >> np.uint64(32))


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchors of texts laid end to end (text i is data[offsets[i]:offsets[i + 1]]).

    Returns per anchor: text number, position, first and last window start (positions in the
    text), hash of the leading bytes, and hash of the block with the anchor's place in it. They
    depend on nothing but the text's bytes. Texts shorter than ``SPAN`` have none.
    """
    n_starts = len(data) - SPAN + 1
    none = np.zeros(0, dtype=np.int64)
    if n_starts <= 0:
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    begin, end = offsets[:-1], offsets[1:]
    gap = np.maximum(begin, end - SPAN + 1)  # window starts gap..end-1 would run over the text's end
    start_at, place, lead, first, before = [], [], [], [], []
    prev, prev_window = np.int64(-2), np.uint64(0)
    for i in range(0, n_starts, SEGMENT):
        j = min(i + SEGMENT, n_starts)
        h1 = data[i : j + SPAN - 1].astype(np.uint64) + np.uint64(1)
        h2 = h1[:-1] * _power(1) + h1[1:]
        h4 = h2[:-2] * _power(2) + h2[2:]
        h8 = h4[:-4] * _power(4) + h4[4:]
        h16 = h8[:-8] * _power(8) + h8[8:]
        m = len(h1) - LEAD + 1
        grams = _mix(h16[:m] * _power(4) + h4[16 : 16 + m])
        least = (grams & ~_LOW) | np.arange(m, dtype=np.uint64)  # ties: the first position
        for step in (1, 2, 4, 8, OFFSETS - 16):
            least = np.minimum(least[:-step], least[step:])
        at = (least & _LOW).astype(np.int64)
        mine = np.searchsorted(end, i, side="right")
        for lo, hi in zip(gap[mine:], end[mine:]):
            if lo >= j:
                break
            at[max(lo - i, 0) : hi - i] = -1 - i
        at += i
        window = lambda s: _mix(((h16[s] * _Q + h16[s + 16]) * _Q + h16[s + 32]) * _R + h16[s + 34])
        new = np.flatnonzero(np.concatenate(([at[0] != prev], at[1:] != at[:-1])))
        start_at.append(new + i)
        place.append(at[new])
        lead.append(grams[np.maximum(at[new] - i, 0)])
        first.append(window(new))
        last = window(np.maximum(new - 1, 0))
        if len(new) and new[0] == 0:
            last[0] = prev_window
        before.append(last)
        prev, prev_window = at[-1], window(np.array([j - i - 1]))[0]
    start_at, place, lead, first, before = map(np.concatenate, (start_at, place, lead, first, before))
    stop_at = np.append(start_at[1:] - 1, n_starts - 1)
    last = np.append(before[1:], prev_window)
    real = place >= 0
    start_at, stop_at, place, lead, first, last = (x[real] for x in (start_at, stop_at, place, lead, first, last))
    block = _mix(first * _S + last + (stop_at - start_at).astype(np.uint64) * _R + (place - start_at).astype(np.uint64) * _P)
    text = np.searchsorted(offsets, start_at, side="right") - 1
    base = offsets[text]
    return text, place - base, start_at - base, stop_at - base, lead, block


def laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), dtype=np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))


def bucket_of(lead: np.ndarray, block: np.ndarray, split_lead: np.ndarray, split_block: np.ndarray) -> np.ndarray:
    """Bucket in the order of (lead, block): how many splitters come before."""
    at = np.searchsorted(split_lead, lead, side="left")
    for i in np.unique(at[(at < len(split_lead)) & (split_lead[np.minimum(at, len(split_lead) - 1)] == lead)]) if len(split_lead) else ():
        same = lead == split_lead[i]
        at[same] += np.searchsorted(split_block[split_lead == split_lead[i]], block[same], side="left")
    return at


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(values))


def _by_doc(doc: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """One list of blocks per document."""
    order = np.lexsort((block, doc))
    ids, sizes = np.unique(doc, return_counts=True)
    return ids, _lists(block[order].view(np.int64), sizes)


#: What tasks send: ``bucket`` rows hold suffixes (docs, their counts, leads and blocks), bucket -1 rows hold
#: the blocks of one document that a smaller one in the same task holds too.
_SENT = "bucket int, docs binary, counts binary, leads binary, blocks binary, doc long, covered array<long>"


def _send(doc: np.ndarray, lead: np.ndarray, block: np.ndarray, splitters) -> Iterator[pa.RecordBatch]:
    """Combine equal blocks, by all 64 bits of both hashes (the smallest document stands for them),
    then deal out by bucket; only 48 bits of the block's hash go on."""
    order = np.lexsort((doc, lead, block))
    doc, lead, block = doc[order], lead[order], block[order]
    head = np.concatenate(([True], (block[1:] != block[:-1]) | (lead[1:] != lead[:-1])))
    least = doc[head][np.cumsum(head) - 1]
    block = block & _LOW48
    ids, lists = _by_doc(doc[doc > least], block[doc > least])
    n = len(ids)
    empty = pa.nulls(n, pa.binary())
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, -1, np.int32)), empty, empty, empty, empty, pa.array(ids), lists], names=["bucket", "docs", "counts", "leads", "blocks", "doc", "covered"])
    doc, lead, block = doc[head], lead[head], block[head]
    bucket = bucket_of(lead, block, *splitters)
    order = np.lexsort((doc, bucket))
    doc, lead, block, bucket = doc[order], lead[order], block[order], bucket[order]
    numbers, starts = np.unique(bucket, return_index=True)
    rows = []
    for number, a, b in zip(numbers.tolist(), starts.tolist(), [*starts[1:].tolist(), len(doc)]):
        d = doc[a:b]
        new = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1])))
        counts = np.diff(np.append(new, b - a)).astype("<u4")
        # 48 bits of the block's hash and 32 of the lead's: with the bucket, that tells enough apart.
        raw = block[a:b].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
        rows.append((number, d[new].astype("<i8").tobytes(), counts.tobytes(), (lead[a:b] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes(), raw))
    cols = list(zip(*rows))
    n = len(rows)
    yield pa.RecordBatch.from_arrays(
        [pa.array(cols[0], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[1:]], pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64()))],
        names=["bucket", "docs", "counts", "leads", "blocks", "doc", "covered"],
    )


_LOW48 = np.uint64((1 << 48) - 1)


def _anchor_task(splitters):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in parts_of(batches):
            text, _, _, _, lead, block = anchors(*laid_out(batch.column("text").cast(pa.binary()).to_pylist()))
            held.append((batch.column("doc").to_numpy()[text], lead, block))
            n += len(text)
            if n >= FLUSH:
                yield from _send(*map(np.concatenate, zip(*held)), splitters)
                held, n = [], 0
        if n:
            yield from _send(*map(np.concatenate, zip(*held)), splitters)

    return run


#: What buckets decide: kind 0: covered blocks of a document; 1: blocks to fetch; 3: the same, of leading
#: bytes that very many have; 2: suffixes whose leading bytes a splitter cuts through, with those bytes' hash.
_DECIDED = "kind int, doc long, blocks array<long>, lead long"


def _decided(kind: int, ids: np.ndarray, lists: pa.Array, lead: np.ndarray | None = None) -> pa.RecordBatch:
    n = len(ids)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, kind, np.int32)), pa.array(ids), lists, pa.array(lead) if lead is not None else pa.nulls(n, pa.int64())],
        names=["kind", "doc", "blocks", "lead"],
    )


def _bucket_task(splitters, hot_rows: int):
    split_lead = splitters[0]

    def run(key: tuple, table: pa.Table) -> pa.Table:
        number = key[0].as_py()
        schema = pa.schema([("kind", pa.int32()), ("doc", pa.int64()), ("blocks", pa.list_(pa.int64())), ("lead", pa.int64())])
        docs = np.concatenate([np.repeat(np.frombuffer(d, "<i8"), np.frombuffer(c, "<u4")) for d, c in zip(table["docs"].to_pylist(), table["counts"].to_pylist())])
        lead = np.frombuffer(b"".join(table["leads"].to_pylist()), "<u4")
        raw = np.zeros((len(docs), 8), np.uint8)
        raw[:, :6] = np.frombuffer(b"".join(table["blocks"].to_pylist()), np.uint8).reshape(-1, 6)
        block = raw.view("<u8").ravel()
        order = np.lexsort((docs, block, lead))
        docs, lead, block = docs[order], lead[order], block[order]
        new_lead = np.concatenate(([True], lead[1:] != lead[:-1]))
        group = np.cumsum(new_lead) - 1
        least = docs if not len(docs) else np.minimum.reduceat(docs, np.flatnonzero(new_lead))[group]
        new_block = new_lead | np.concatenate(([True], block[1:] != block[:-1]))
        covered = docs > docs[np.flatnonzero(new_block)][np.cumsum(new_block) - 1]
        # Leading bytes at the bucket's ends may go on in the next bucket.
        edges = np.unique((split_lead[max(0, number - 1) : number + 1] & np.uint64(0xFFFFFFFF)).astype("<u4"))
        cut = np.isin(lead, edges)
        unsure = ~covered & (docs > least) & ~cut
        asked = np.zeros(group[-1] + 1, dtype=bool)
        asked[group[unsure]] = True
        fetch = ~covered & asked[group] & ~cut & (new_block | unsure)
        hot = np.bincount(group[fetch], minlength=group[-1] + 1)[group] > hot_rows
        out = [_decided(0, *_by_doc(docs[covered], block[covered]))]
        out += [_decided(kind, *_by_doc(docs[some], block[some])) for kind, some in ((1, fetch & ~hot), (3, fetch & hot))]
        rest = np.flatnonzero(cut & ~covered)
        if len(rest):
            out.append(_decided(2, docs[rest], _lists(block[rest].view(np.int64), np.ones(len(rest), np.int64)), lead[rest].astype(np.int64)))
        return pa.Table.from_batches([b.cast(schema) for b in out], schema)

    return run


def multikey_equal(first: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Number of each row's class of equal (first, words...), -1 for rows that equal no other.

    Multikey quicksort by whole words: rows are sorted by one word at a time, and only runs of
    equals go on to the next word.
    """
    label = np.full(len(first), -1, dtype=np.int64)
    rows = np.arange(len(first))
    order = np.argsort(first, kind="stable")
    value = first[order]
    group = np.cumsum(np.concatenate(([True], value[1:] != value[:-1]))) - 1 if len(value) else np.zeros(0, np.int64)
    rows = rows[order]
    for w in range(words.shape[1] + 1):
        sizes = np.bincount(group) if len(group) else np.zeros(0, np.int64)
        keep = sizes[group] > 1 if len(group) else np.zeros(0, bool)
        rows, group = rows[keep], group[keep]
        if w == words.shape[1] or not len(rows):
            break
        word = words[rows, w]
        order = np.lexsort((word, group))
        rows, group, word = rows[order], group[order], word[order]
        group = np.cumsum(np.concatenate(([True], (group[1:] != group[:-1]) | (word[1:] != word[:-1])))) - 1
    label[rows] = group
    return label


def matched_windows(lead: np.ndarray, doc: np.ndarray, blocks: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Per block a bit mask: bit o is set if its window that starts o bytes before the anchor also
    starts in a smaller document. ``blocks`` has the anchors in one column; a block has the
    windows o = right..left."""
    mask = np.zeros(len(doc), dtype=np.int64)
    for o in range(OFFSETS):
        has = np.flatnonzero((right <= o) & (o <= left))
        if len(has) < 2:
            continue
        window = np.zeros((len(has), 56), dtype=np.uint8)
        window[:, :SPAN] = blocks[has, OFFSETS - 1 - o : OFFSETS - 1 - o + SPAN]
        label = multikey_equal(lead[has], window.view(">u8"))
        some = np.flatnonzero(label >= 0)
        if not len(some):
            continue
        least = np.full(label.max() + 1, NO_ID, dtype=np.int64)
        np.minimum.at(least, label[some], doc[has[some]])
        hit = has[some[doc[has[some]] > least[label[some]]]]
        mask[hit] |= 1 << o
    return mask


_BLOCKS = "lead long, doc long, block long, left int, right int, bytes binary"


def _wanted(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, ...]:
    """Of the anchors of a batch's texts the ones whose block is in the text's list in ``column``:
    document, anchor less first and less last window start, lead, block, and the blocks' bytes
    laid out with the anchor in one column."""
    data, offsets = laid_out(batch.column("text").cast(pa.binary()).to_pylist())
    text, at, start, stop, lead, block = anchors(data, offsets)
    block &= _LOW48
    lists = batch.column(column)
    ends = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))))
    asked = pc.list_flatten(lists).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    wanted = np.zeros(len(block), dtype=bool)
    bounds = np.searchsorted(text, np.arange(len(batch) + 1))
    for k in np.flatnonzero((np.diff(ends) > 0) & (np.diff(bounds) > 0)):
        x, y = bounds[k], bounds[k + 1]
        wanted[x:y] = np.isin(block[x:y], asked[ends[k] : ends[k + 1]])
    text, at, start, stop, lead, block = (v[wanted] for v in (text, at, start, stop, lead, block))
    col = np.arange(BLOCK)[None, :] - (OFFSETS - 1)
    inside = (col >= (start - at)[:, None]) & (col < (stop - at)[:, None] + SPAN)
    place = np.where(inside, (offsets[text] + at)[:, None] + col, 0)
    laid = np.where(inside, data[place] if len(data) else 0, 0).astype(np.uint8)
    return batch.column("doc").to_numpy()[text], at - start, at - stop, lead.view(np.int64), block.view(np.int64), laid


def _fetch_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts_of(batches):
        doc, left, right, lead, block, laid = _wanted(batch, "fetch")
        yield pa.RecordBatch.from_arrays(
            [pa.array(lead), pa.array(doc), pa.array(block), pa.array(left.astype(np.int32)), pa.array(right.astype(np.int32)), pa.array([r.tobytes() for r in laid], pa.binary())],
            names=["lead", "doc", "block", "left", "right", "bytes"],
        )


_WINDOWS = "key_a long, key_b long, doc long, block long, mask long"


def _window_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per window of the blocks asked for: its 128-bit key (with its place before the anchor)."""
    for batch in parts_of(batches):
        doc, left, right, _, block, laid = _wanted(batch, "hot")
        out = []
        for o in range(OFFSETS):
            for i in np.flatnonzero((right <= o) & (o <= left)):
                digest = hashlib.blake2b(laid[i, OFFSETS - 1 - o : OFFSETS - 1 - o + SPAN].tobytes(), digest_size=16, salt=bytes([o])).digest()
                out.append((int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True), int(doc[i]), int(block[i]), 1 << o))
        cols = list(zip(*out)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["key_a", "key_b", "doc", "block", "mask"])


def _match_task(table: pa.Table) -> pa.Table:
    lead, doc, block, left, right = (table[c].to_numpy() for c in ("lead", "doc", "block", "left", "right"))
    blocks = np.frombuffer(b"".join(table["bytes"].to_pylist()), np.uint8).reshape(-1, BLOCK)
    mask = matched_windows(lead, doc, blocks, left, right)
    hit = mask != 0
    return pa.table({"doc": doc[hit], "block": block[hit], "mask": mask[hit]})


def removed_bytes(n: int, start: np.ndarray, stop: np.ndarray, at: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Which of n bytes go: all of the blocks whose mask is -1, else those of the windows in the mask."""
    change = np.zeros(n + 1, dtype=np.int64)
    whole = mask == -1
    np.add.at(change, start[whole], 1)
    np.add.at(change, stop[whole] + SPAN, -1)
    for o in range(OFFSETS):
        some = at[~whole & (mask >> o & 1 == 1)] - o
        np.add.at(change, some, 1)
        np.add.at(change, some + SPAN, -1)
    return np.cumsum(change[:-1]) > 0


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, end: long>>"


def _cut_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts_of(batches):
        out = []
        columns = (batch.column(c).to_pylist() for c in ("doc_id", "covered", "partly"))
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        for doc_id, covered, partly, text in zip(*columns, texts):
            spans = []
            kept = text
            if (covered or partly) and len(text) >= SPAN:
                data, offsets = laid_out([text])
                _, at, start, stop, _, block = anchors(data, offsets)
                block = (block & _LOW48).view(np.int64)
                mask = np.where(np.isin(block, np.array(covered or [], dtype=np.int64)), -1, 0)
                part: dict[int, int] = {}
                for p in partly or []:
                    part[p["block"]] = part.get(p["block"], 0) | p["mask"]
                if part:
                    for i in np.flatnonzero((mask == 0) & np.isin(block, np.array(list(part), dtype=np.int64))):
                        mask[i] = part[int(block[i])]
                gone = removed_bytes(len(text), start, stop, at, mask)
                edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
                spans = [{"start": x, "end": y} for x, y in edge.reshape(-1, 2).tolist()]
                kept = data[~gone].tobytes()
            out.append((doc_id, len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), spans))
        cols = list(zip(*out)) or [()] * 6
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), span)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def _sample_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts_of(batches):
        for text in batch.column("text").cast(pa.binary()).to_pylist():
            _, _, _, _, lead, block = anchors(*laid_out([text]))
            some = np.argsort(_mix(block ^ _S), kind="stable")[:SAMPLE_ANCHORS]
            yield pa.RecordBatch.from_arrays([pa.array(lead[some].view(np.int64)), pa.array((block[some] & _LOW48).view(np.int64))], names=["lead", "block"])


def draw_splitters(texts: DataFrame, bucket_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Splitters (lead, block) from the anchors of about ``SAMPLE_DOCS`` documents, at most
    ``SAMPLE_ANCHORS`` each: a bounded sample that balances the buckets; no result depends on it."""
    n, size = texts.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    n_buckets = min(MAX_BUCKETS, max(1, -(-size // (17 * bucket_rows))))
    nothing = np.zeros(0, dtype=np.uint64)
    if n_buckets == 1:
        return nothing, nothing
    every = max(1, n // SAMPLE_DOCS)
    drawn = texts.filter(F.pmod(F.xxhash64("doc"), F.lit(every)) == 0).select("text").mapInArrow(_sample_task, "lead long, block long").toPandas()
    lead, block = (drawn[c].to_numpy(dtype=np.int64).view(np.uint64) for c in ("lead", "block"))
    order = np.lexsort((block, lead))
    picks = order[(np.arange(1, n_buckets) * len(order)) // n_buckets] if len(order) else order
    return lead[picks], block[picks]


def remove_repeats(
    spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = BUCKET_ROWS, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (first and end
    byte of each removed run).

    A null text is empty; texts shorter than 50 bytes lose nothing. Rows of one doc_id do not
    take from each other, so repeated rows get equal results. Null ids count as larger than all
    others and equal to each other. An empty table gives an empty result.
    """
    texts = docs.select(*id_and_text(docs, id_col, text_col)).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), "text")
    splitters = draw_splitters(texts, bucket_rows)
    sent = texts.select("doc", "text").mapInArrow(_anchor_task(splitters), _SENT)
    # Rows of the tasks' own findings only pass through; they are spread by document.
    dealt = sent.withColumn("key", F.when(F.col("bucket") < 0, F.pmod(F.xxhash64("doc"), F.lit(64)).cast("int")).otherwise(F.col("bucket")))
    decide = _bucket_task(splitters, hot_rows)

    def bucket(key: tuple, table: pa.Table) -> pa.Table:
        own = pc.less(table["bucket"], 0)
        passed, rows = table.filter(own), table.filter(pc.invert(own))
        n = len(passed)
        through = pa.table({"kind": pa.array(np.zeros(n, np.int32)), "doc": passed["doc"], "blocks": passed["covered"], "lead": pa.nulls(n, pa.int64())})
        return pa.concat_tables([through, decide(key, rows)]) if len(rows) else through

    decided = materialize(spark, dealt.groupBy("key").applyInArrow(bucket, _DECIDED), "decided")
    # Leading bytes cut by a splitter: compared over all buckets that hold them.
    cut = decided.filter("kind = 2").select("doc", "lead", F.col("blocks")[0].alias("block"))
    spans = cut.groupBy("lead").agg(F.min("doc").alias("least"), F.max("doc").alias("most"), F.count("*").alias("n"))
    kind = F.when(F.col("n") > hot_rows, 3).otherwise(1)
    across = cut.join(spans.filter("most > least"), "lead").select(kind.alias("kind"), "doc", F.array("block").alias("blocks"))
    sides = decided.filter("kind <> 2").select("kind", "doc", "blocks").union(across)
    lists = {"covered": 0, "fetch": 1, "hot": 3}
    side = sides.groupBy("doc").agg(
        *[F.flatten(F.collect_list(F.when(F.col("kind") == k, F.col("blocks")))).alias(name) for name, k in lists.items()]
    )
    side = materialize(spark, side, "side")
    # The joins below shuffle the same columns of the texts alike, so Spark writes that shuffle once.
    fetched = texts.join(side, "doc", "left").select("doc", "text", *lists)
    blocks = fetched.filter(F.size("fetch") > 0).select("doc", "text", "fetch").mapInArrow(_fetch_task, _BLOCKS)
    windows = fetched.filter(F.size("hot") > 0).select("doc", "text", "hot").mapInArrow(_window_task, _WINDOWS)
    n_groups = max(64, len(splitters[0]) + 1)
    cold = (
        blocks.withColumn("group", F.pmod(F.xxhash64("lead"), F.lit(n_groups)))
        .groupBy("group").applyInArrow(_match_task, "doc long, block long, mask long")
    )
    if not side.filter(F.size("hot") > 0).isEmpty():
        least = windows.groupBy("key_a", "key_b").agg(F.min("doc").alias("least"))
        cold = cold.union(windows.join(least, ["key_a", "key_b"]).filter("doc > least").select("doc", "block", "mask"))
    partly = cold.groupBy("doc").agg(F.collect_list(F.struct("block", "mask")).alias("partly"))
    whole = texts.join(side.select("doc", "covered"), "doc", "left").join(partly, "doc", "left")
    whole = whole.withColumn("doc_id", F.nullif("doc", F.lit(NO_ID)))
    return whole.select("doc_id", "text", "covered", "partly").mapInArrow(_cut_task, _RESULT)
