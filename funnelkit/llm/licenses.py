"""Operator 2: licence scans.

Templates and texts are word sequences (lower case; marks and white space separate words). The
winnowed fingerprints of the templates form an inverted index: of every ``window``
consecutive hashes of ``shingle`` words the least is kept, so any run of
``shingle + window - 1`` template words holds a kept one. A text's own shingles are looked up
in it; hits of one template on nearby diagonals make a candidate region, and a banded
alignment of the template with that region gives the share of template words matched
in order (coverage) and where. The words that tell a notice from others (name, version) must be
there without gaps. Templates are a fixed, small table that travels with the task.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Sequence
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelkit.llm.common import id_and_text, parts_of
from funnelkit.llm.license_texts import TELLING, TEMPLATES

SHINGLE = 3
WINDOW = 3
BAND = 6  # words inserted or left out that an alignment may drift by
MIN_COVERAGE = 0.8

#: A-Z to lower case; everything but letters, digits and bytes beyond ASCII to spaces.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))
_WORD = re.compile(rb"[^ ]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def winnow(hashes: Sequence[int], window: int) -> set[int]:
    """Positions of the least hash of every window (the last of equals); all of a short sequence
    count as one window."""
    if not hashes:
        return set()
    starts = range(max(1, len(hashes) - window + 1))
    return {min(range(s, min(s + window, len(hashes))), key=lambda i: (hashes[i], -i)) for s in starts}


def _telling(name: str, form: str, text: str) -> tuple[str, ...]:
    if name == "CC-BY-4.0":  # two lines that name it differently
        return ("CC BY 4.0",) if "CC BY" in text else ("Attribution 4.0",)
    return TELLING.get((name, form), ())


def holds(words: list[bytes], run: list[bytes]) -> bool:
    """Is ``run`` in ``words``, without gaps?"""
    return any(words[i : i + len(run)] == run for i in range(len(words) - len(run) + 1))


class TemplateIndex:
    def __init__(self, templates: Sequence[tuple[str, str, str]] = TEMPLATES, shingle: int = SHINGLE, window: int = WINDOW) -> None:
        self.templates, self.shingle = list(templates), shingle
        self.words = [words_of(t.encode()) for _, _, t in templates]
        self.telling = [[words_of(p.encode()) for p in _telling(*t)] for t in templates]
        self.known = {w for ws in self.words for w in ws}
        self.postings: dict[tuple[bytes, ...], list[tuple[int, int]]] = defaultdict(list)
        for t, ws in enumerate(self.words):
            k = min(shingle, len(ws))
            grams = [tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)]
            for i in winnow([crc32(b" ".join(g)) for g in grams], window):
                self.postings[grams[i]].append((t, i))

    def regions(self, words: list[bytes], band: int) -> list[tuple[int, int, int]]:
        """Candidate (template, lowest, highest diagonal) of a text: hits of a template whose diagonals
        lie within ``band`` of the one before, widened by the band."""
        known = self.known
        runs, start = [], None
        for i, w in enumerate(words):
            if w in known:
                start = i if start is None else start
            elif start is not None:
                runs.append((start, i))
                start = None
        if start is not None:
            runs.append((start, len(words)))
        diagonals: dict[int, list[int]] = defaultdict(list)
        k = self.shingle
        for a, b in runs:
            for i in range(a, b - k + 1):
                for t, at in self.postings.get(tuple(words[i : i + k]), ()):
                    diagonals[t].append(i - at)
        out = []
        for t, found in diagonals.items():
            found.sort()
            low = high = found[0]
            for d in [*found[1:], None]:
                if d is not None and d - high <= band:
                    high = d
                    continue
                out.append((t, low - band, high + band))
                low = high = d
        return out


def align(template: list[bytes], words: list[bytes], low: int, high: int) -> tuple[int, int, int]:
    """Best alignment of a template with a stretch of words inside the band of diagonals ``low`` to
    ``high`` (word position less template position): matched words, first and end
    position of the matched part. Gaps cost nothing but a match (longest common subsequence);
    of equally many matches the shortest stretch is taken."""
    # row[j]: (matches, first position) of the best alignment of the template so far with words before j
    row: dict[int, tuple[int, int]] = {}
    for i, w in enumerate(template):
        new: dict[int, tuple[int, int]] = {}
        for j in range(max(0, i + low), min(len(words), i + high + 1) + 1):
            best = max(row.get(j, (0, -1)), new.get(j - 1, (0, -1)))
            if j and words[j - 1] == w:
                hits, first = row.get(j - 1, (0, -1))
                best = max(best, (hits + 1, first if hits else j - 1))
            new[j] = best
        if not new:  # the text ends here
            break
        row = new
    if not row:
        return 0, 0, 0
    hits, first = max(row.values())
    return hits, first, min(j for j, v in row.items() if v == (hits, first))


def scan(text: bytes, index: TemplateIndex, band: int = BAND, min_coverage: float = MIN_COVERAGE) -> list[dict]:
    """Licence notices in a UTF-8 text, by position: license, form, coverage, start and end (bytes).

    Of matches that overlap the one with more matched words stands (then the larger coverage),
    so a header is not reported again as the line it holds.
    """
    words = words_of(text)
    found = []
    for t, low, high in index.regions(words, band):
        n = len(index.words[t])
        # A notice repeated many times is one wide region: it is aligned once as a whole, and in pieces.
        step = 4 * band + 2 * n
        wide = high - low > step
        todo = [(x, x + step, max(0, x), x + step + n) for x in range(low, high, step - 2 * band)] if wide else []
        todo.append((low, high, max(0, low), high + n))
        while todo:
            low_, high_, a, b = todo.pop()
            part = words[a:b]
            hits, first, end = align(index.words[t], part, low_ - a, high_ - a)
            coverage = hits / n
            if coverage < min_coverage:
                continue
            if all(holds(part[first:end], run) for run in index.telling[t]):
                found.append((-hits, -coverage, a + first, a + end, t))
            if not wide or high_ - low_ == step:  # once more before and after it
                todo += [(low_, high_, x, y) for x, y in ((a, a + first), (a + end, min(b, len(words)))) if y - x >= min_coverage * n]
    taken, kept = [], []
    for hits, coverage, first, end, t in sorted(found):
        if all(end <= x or first >= y for x, y in taken):
            taken.append((first, end))
            kept.append((first, end, t, -coverage))
    if not kept:
        return []
    places = [m.span() for m in _WORD.finditer(text.translate(SPACED))]
    return [
        {"license": index.templates[t][0], "form": index.templates[t][1], "coverage": c, "start": places[x][0], "end": places[y - 1][1]}
        for x, y, t, c in sorted(kept)
    ]


#: As ``FOLD``, with every ASCII white space a plain space (positions stay).
SPACED = bytes(32 if c in b"\t\n\v\f\r" else FOLD[c] for c in range(256))

_KIND = pa.list_(pa.struct([("license", pa.string()), ("form", pa.string()), ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))


def scan_licenses(
    docs: DataFrame, templates: Sequence[tuple[str, str, str]] = TEMPLATES, band: int = BAND, min_coverage: float = MIN_COVERAGE,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per input row: doc_id, licenses (names found, sorted, each once) and matches (license,
    form, coverage, first and end byte of each notice, by position).

    Null and empty texts and texts without a notice have empty lists. Repeated rows are scanned
    each. An empty table gives an empty result. Texts are scanned whole and in one pass.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = TemplateIndex(templates)
        for batch in parts_of(batches):
            found = [scan(t, index, band, min_coverage) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([sorted({m["license"] for m in f}) for f in found], pa.list_(pa.string())), pa.array(found, _KIND)],
                names=["doc_id", "licenses", "matches"],
            )

    return docs.select(*id_and_text(docs, id_col, text_col)).mapInArrow(
        run,
        "doc_id long, licenses array<string>, matches array<struct<license: string, form: string, coverage: double, start: long, end: long>>",
    )
