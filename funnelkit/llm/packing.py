"""Operator 4: best-fit packing of documents into fixed-length sequences, with local search.

A document's token ids are made in one pass over the texts; from there on only lengths
count. Documents longer than a sequence are cut into full pieces and a rest. The pieces are
dealt by a hash of their row number into groups of about ``group_rows``, each packed by one
task: best fit in order of falling length, then a local search among the underfull
sequences that moves a document, exchanges one for one, or one for two, whenever the
sum of squared fills grows, until no exchange helps or sequences run empty. What a group
leaves in underfull sequences is dealt anew and packed together with the other groups' rests.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from string import punctuation
from unicodedata import is_normalized, normalize

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from funnelkit.llm.common import id_and_text, materialize, parts_of

SEQUENCE = 4096
END_ID = 1
GROUP_ROWS = 8192
MAX_TASKS = 20_000
CACHE_WORDS = 500_000
MARKS = punctuation.encode()
LATIN_END = "\u0250"


def byte_symbols() -> list[str]:
    """The character by which byte-level vocabularies write each byte: printable Latin-1 characters
    stand for themselves, the other bytes for U+0100 and on, in order."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(rest)) for b in range(256)]


def is_letters(text: str) -> bool:
    """Is a word letters only, before and after the tokenizer has normalised it? Some capitals become a letter and a
    mark (U+0130), and the pre-tokenizer joins that mark with those behind it."""
    return text.isalpha() and normalize("NFC", text).lower().isalpha()


class WordEncoder:
    """Token ids of UTF-8 texts by a tokenizer whose pre-tokens never hold white space.

    The ids of a text are then those of its white-space separated words, one after the
    other, so each word is encoded once and remembered (beyond ``cache_words`` the memory is
    emptied). ASCII letters are lower-cased first, as
    the tokenizer would, but for words with combining marks: these it composes before it lower-cases, and some
    letters compose in one case only. Letters and the ASCII marks behind them are pre-tokens of their
    own. A word of Latin letters is one pre-token and goes straight to the tokenizer's
    model; all other words go through the whole tokenizer, and so do texts that hold
    ``<|``, which may hold special tokens.
    """

    def __init__(self, tokenizer_json: str, cache_words: int = CACHE_WORDS) -> None:
        from tokenizers import Tokenizer

        self.cache: dict[bytes, bytes] = {}
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.model = self.tokenizer.model
        self.cache_words = cache_words
        self.symbols = byte_symbols()

    def _encode(self, text: str) -> bytes:
        if text.isalpha():
            if text.isascii():
                return array("I", [t.id for t in self.model.tokenize(text.lower())]).tobytes()
            lower = text.lower()
            if max(lower) < LATIN_END and lower.isalpha() and is_normalized("NFC", text):
                spelt = "".join([self.symbols[b] for b in lower.encode()])
                return array("I", [t.id for t in self.model.tokenize(spelt)]).tobytes()
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _learn(self, word: bytes) -> bytes:
        """Ids of a word that may not be remembered yet."""
        if word in self.cache:
            return self.cache[word]
        core = word.rstrip(MARKS)
        if core and len(core) < len(word) and is_letters(core.decode()):
            ids = self._learn(core) + self._learn(word[len(core) :])
        else:
            ids = self._encode(word.decode())
        self.cache[word] = ids
        return ids

    def encode(self, text: bytes) -> bytes:
        """Little-endian 32-bit ids of a text."""
        if len(self.cache) > self.cache_words:
            self.cache.clear()
        if b"<|" in text:
            return self._encode(text.decode())
        known, learn = self.cache.get, self._learn
        if b"\xcc" in text or b"\xcd" in text:  # U+0300 to U+037F, all marks that compose with ASCII letters
            words = [w if b"\xcc" in w or b"\xcd" in w else w.lower() for w in text.split()]
        else:
            words = text.lower().split()
        return b"".join([known(w) or learn(w) for w in words])


def pieces(
    spark: SparkSession, docs: DataFrame, tokenizer_path: str, sequence: int = SEQUENCE, end_id: int = END_ID, **columns
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: one row per piece of every document."""
    with open(tokenizer_path, encoding="utf-8") as f:
        model = spark.sparkContext.broadcast(f.read())  # a vocabulary file: its size does not depend on the documents
    end = np.array([end_id], dtype="<u4").tobytes()
    step = 4 * sequence

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(model.value)
        for batch in parts_of(batches):
            ids = batch.column("doc_id").to_pylist()
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            out = []
            for doc_id, text in zip(ids, texts):
                tokens = encoder.encode(text) + end
                for k, at in enumerate(range(0, len(tokens), step)):
                    part = tokens[at : at + step]
                    out.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*out)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    return docs.select(*id_and_text(docs, **columns)).mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best fit in order of falling length; returns positions per bin."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # (room left, bin), sorted
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        at = bisect_left(room, (lengths[i], -1))
        if at == len(room):
            left, b = capacity, len(bins)
            bins.append([])
        else:
            left, b = room.pop(at)
        bins[b].append(i)
        if left > lengths[i]:
            insort(room, (left - lengths[i], b))
    return bins


def exchange(a: list[int], b: list[int], size: list[int], room: int, lead: int) -> tuple[list[int], list[int]] | None:
    """What to give from bin a to bin b, and what to take back, so that b (with ``room`` left and
    ``lead`` = fill of b - fill of a) gains g tokens: 1 <= g <= room. The squared fills
    then change by 2 g (lead + g), so any g above -lead helps. Positions are sorted by size.
    The largest gain among moves, one-for-one and one-for-two exchanges is returned."""
    best, give = max(0, -lead), None
    sizes = [size[y] for y in b]
    for x in a:
        if best >= room:
            break
        s = size[x]
        if best < s <= room:
            best, give = s, ([x], [])
            continue
        at = bisect_left(sizes, s - room)
        if at < len(b) and best < s - sizes[at]:
            best, give = s - sizes[at], ([x], [b[at]])
        i, j = 0, len(b) - 1  # two of b: the smallest sum of at least s - room
        while i < j:
            both = sizes[i] + sizes[j]
            if both < s - room:
                i += 1
            else:
                if best < s - both:
                    best, give = s - both, ([x], [b[i], b[j]])
                j -= 1
    if best < room:  # two of a for one of b
        ours = [size[x] for x in a]
        for y in b:
            top = bisect_right(ours, room + size[y])
            i, j = 0, top - 1
            while i < j:
                gain = ours[i] + ours[j] - size[y]
                if gain > room:
                    j -= 1
                else:
                    if best < gain:
                        best, give = gain, ([a[i], a[j]], [y])
                    i += 1
    return give


def local_search(bins: list[list[int]], size: list[int], capacity: int) -> list[list[int]]:
    """Raise the sum of squared fills by exchanges between underfull bins until none helps.

    The sum is a whole number that grows with each exchange and is bounded, so this ends.
    """
    full = [b for b in bins if sum(size[i] for i in b) == capacity]
    under = [sorted(b, key=lambda i: (size[i], i)) for b in bins if sum(size[i] for i in b) < capacity]
    fill = [sum(size[i] for i in b) for b in under]
    again = True
    while again:
        again = False
        for a in sorted(range(len(under)), key=lambda k: fill[k]):
            for b in sorted(range(len(under)), key=lambda k: -fill[k]):
                if a == b or not under[a] or fill[b] == capacity or fill[b] < fill[a]:
                    continue
                found = exchange(under[a], under[b], size, capacity - fill[b], fill[b] - fill[a])
                if found is None:
                    continue
                give, take = found
                gain = sum(size[i] for i in give) - sum(size[i] for i in take)
                key = lambda i: (size[i], i)
                under[a] = sorted([i for i in under[a] if i not in give] + take, key=key)
                under[b] = sorted([i for i in under[b] if i not in take] + give, key=key)
                fill[a], fill[b], again = fill[a] - gain, fill[b] + gain, True
    return full + [b for b in under if b]


def pack(lengths: list[int], capacity: int) -> list[list[int]]:
    return local_search(best_fit(lengths, capacity), lengths, capacity)


def _pack_groups(rows: DataFrame, n_groups: int, capacity: int, keep_all: bool) -> DataFrame:
    """row_id, length, group, bin, offset, settled; bins that are not full are not settled unless
    ``keep_all``."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row_id", ignore_index=True)
        size = pdf["length"].tolist()
        bins = pack(size, capacity)
        order = [i for b in bins for i in b]
        out = pdf.loc[order, ["row_id", "length", "group"]].reset_index(drop=True)
        out["bin"] = np.repeat(np.arange(len(bins)), [len(b) for b in bins]).astype(np.int64)
        ends = out.groupby("bin")["length"].cumsum()
        out["offset"] = ends - out["length"]
        out["settled"] = True if keep_all else out.groupby("bin")["length"].transform("sum") == capacity
        return out

    dealt = rows.withColumn("group", F.pmod(F.xxhash64("row_id", F.lit(n_groups)), F.lit(n_groups)))
    # A stated number of partitions: by bytes, which are few, Spark would put many groups into one task.
    return dealt.repartition(min(n_groups, MAX_TASKS), "group").groupBy("group").applyInPandas(
        run, "row_id long, length long, group long, bin long, offset long, settled boolean"
    )


def pack_documents(
    spark: SparkSession,
    docs: DataFrame,
    tokenizer_path: str,
    sequence: int = SEQUENCE,
    end_id: int = END_ID,
    group_rows: int = GROUP_ROWS,
    **columns,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end token alone. Repeated rows and ids are packed
    each; a null id stays null. Sequences have no gaps, and none is longer than ``sequence``. An
    empty table gives an empty result.
    """
    made = materialize(
        spark,
        pieces(spark, docs, tokenizer_path, sequence, end_id, **columns).withColumn("row_id", F.monotonically_increasing_id()),
        "pieces",
    )
    open_ = made.filter(F.col("length") < sequence).select("row_id", "length")
    placed, n_groups = None, 0
    rows, first = open_, 0
    for last in (False, True):
        n_groups = max(1, -(-rows.count() // group_rows))
        packed = materialize(spark, _pack_groups(rows, n_groups, sequence, keep_all=last or n_groups == 1), "packed")
        settled = packed.filter("settled").select(
            "row_id", "offset", F.struct(F.lit(first).alias("round"), "group", "bin").alias("place")
        )
        placed = settled if placed is None else placed.union(settled)
        if last or n_groups == 1:
            break
        rows, first = packed.filter(~F.col("settled")).select("row_id", "length"), 1
    # A bin's number: round, group and place in the group (a bin has a document, so fewer than 2^24 of them).
    number = F.col("place.round") * (1 << 62) + F.col("place.group") * (1 << 24) + F.col("place.bin")
    joined = made.join(placed, "row_id", "left")
    return joined.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        F.when(F.col("place").isNull(), -F.col("row_id") - 1).otherwise(number).alias("sequence_id"),
        F.coalesce("offset", F.lit(0)).cast("long").alias("offset"),
    )
