"""Brute-force versions of the operators and the awkward rows they are tried on."""

import hashlib
import random
import re

import numpy as np
import xxhash

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, row_id string, lead string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "", ",", "."]) + (str(r.randrange(999)) if r.random() < 0.2 else "") for _ in range(n))


def awkward_rows() -> list[tuple]:
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows and ids; columns
    whose names the operators use themselves."""
    a, b, shared = prose(1, 120), prose(2, 80), prose(3, 40)
    rows = [
        (1, a, "en", "s1"), (2, a.replace(" ", "  \n"), "en", "s1"), (3, a, "de", "s2"), (3, a, "de", "s2"), (4, b, None, None),
        (5, None, "en", "s1"), (6, "", "en", "s2"), (7, " \t\n", "en", "s2"), (None, a, "en", "s1"), (None, b, "en", None),
        (8, prose(4, 30_000), "en", "s3"), (9, b + " tail", "en", "s2"), (9, "other text under the same id", "en", "s2"),
        (10, prose(5, 50) + shared + prose(6, 50), "fr", "s1"), (11, prose(7, 20) + shared, "fr", "s2"), (12, "x", "en", "s1"),
        (13, "Größe naïve Straße É " * 9, "de", "s1"), (14, "aaaa " * 200, "en", "s2"), (15, "a" * 500, "en", "s2"), (16, a.upper(), "en", "s1"),
    ]
    return [(i, t, lang, s, None if t is None else len(t), "7", None, "x") for i, t, lang, s in rows]


def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA).repartition(3)


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def simhash(text: str | None) -> int:
    text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall("[^\x20\x09-\x0d]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = np.array([xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles], dtype=np.uint64)
    return sum(1 << b for b in range(64) if 2 * int(((hashes >> np.uint64(b)) & np.uint64(1)).sum()) > len(hashes))


def classes(n: int, linked) -> list[int]:
    """Class number of 0..n-1, where ``linked(i, j)`` says whether two are linked."""
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                parent[root(i)] = root(j)
    return [root(i) for i in range(n)]


def removed(rows: list[tuple[int | None, str | None]]) -> list[tuple]:
    """(n_bytes, n_removed, n_spans, kept_sha256) of each (doc_id, text), by sets of 50-byte strings."""
    far = 1 << 63
    least: dict[bytes, int] = {}
    texts = [((far if d is None else d), (t or "").encode()) for d, t in rows]
    for d, t in texts:
        for s in range(len(t) - 49):
            w = t[s : s + 50]
            least[w] = min(least.get(w, far), d)
    out = []
    for d, t in texts:
        gone = np.zeros(len(t), dtype=bool)
        for s in range(len(t) - 49):
            if least[t[s : s + 50]] < d:
                gone[s : s + 50] = True
        edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        out.append((len(t), int(gone.sum()), len(edges) // 2, hashlib.sha256(kept).hexdigest()))
    return out
