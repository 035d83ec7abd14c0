"""Hard rows for every operator, and reference forms by brute force."""

from __future__ import annotations

import random
import re
from collections import Counter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: The same with extra columns whose names operators use inside.
CLASHING = "row long, key string, token string, n int, score double, _text string, _row int, kind string, file string, term string"


def documents(spark, extra: bool = False, seed: int = 11):
    """Texts of all kinds: null, empty, short, long, repeated rows, copies, near copies, benchmark passages, personal data."""
    rng = random.Random(seed)
    vocabulary = [w + e for w in ("alpha", "beta", "gamma", "delta", "omega", "Straße", "naïve", "El", "le") for e in ("", "s", "ing", ".", ",", "é")]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base, passage = prose(160), prose(90)
    texts = [None, "", " ", "one", "one two three", "ONE two Three", "\n\n", "a" * 3000, prose(20_000), base, base, base.replace("alpha", "alphas", 1), base + " tail", base.upper(), passage + " " + prose(60), prose(50) + " " + passage,
             "mail Anna.Schmidt@mail.example.com or a@b@c.org, 10.0.0.300 1.2.3.4, card 4111 1111 1111 1111 call +49 (30) 1234-5678.", "x@y.z_q@w.e", "Licensed under the Apache License, Version 2.0.", "\x00 nul \x01", "😀 🎉 日本語 ▁x", "</s>[INST] <|x|> \\ [/INST]"]
    texts += [prose(rng.randint(5, 120)) for _ in range(30)]
    rows = [(i, t, ("en", "de", None)[i % 3], f"src{i % 4}" if i % 7 else None, None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[9], rows[0], (None, base, "en", "src0", 1), (None, None, None, None, None)]
    schema = SCHEMA
    if extra:
        schema += ", " + CLASHING
        rows = [(*r, 1, "k", "t", 2, 0.5, "x", 3, "q", "f", "m") for r in rows]
    return spark.createDataFrame(rows, schema).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingles(text: str | None) -> set[tuple]:
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(texts: list[str | None]) -> list[int]:
    """By position, the smallest position reached by links."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


def repeats(texts: list[bytes], length: int) -> list[list[bool]]:
    """Of each byte, whether a string of that length that also starts elsewhere covers it."""
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        out.append(gone)
    return out


def edit_distance(a: bytes, b: bytes) -> int:
    """The least distance of a to any stretch of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return min(row)
