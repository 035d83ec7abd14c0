"""Benchmark decontamination by pigeonhole edit matching.

A test item of m bytes may be found with k = floor(rate * m) edits. It is split
into k + 1 pieces; if a stretch of a document is within k edits of the item, one
piece at least occurs in it unchanged. An Aho-Corasick automaton over the pieces
of all items runs once over each whole document; every piece hit names a window
of the document, and Myers' bit-parallel algorithm verifies the item there (the
best edit distance over all stretches that end in the window).

Items and documents are compared in a normal form: lower case, ASCII punctuation
dropped, runs of white space as one space, UTF-8 bytes. Null or empty texts hold
nothing; items that are null or empty in the normal form match nothing; an item so short
that rate * m is below 1 must match exactly, and so must one of less than
`exact_below` bytes where a caller sets that. Repeated items and ties are each
reported by their own id. Items form the query set: they come to the workers in
blocks of at most `block` bytes, one pass over the documents for each block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm.common import ship, strings, text_of, tidied

#: The ASCII punctuation that the normal form drops.
_DROP = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def normal(text: str) -> bytes:
    """The normal form in which items and documents are compared."""
    return b" ".join(text.lower().encode("utf-8", "replace").translate(None, _DROP).split())


def myers(pattern: bytes, text: bytes, most: int) -> tuple[int, int] | None:
    """(distance, end) of the best stretch of the text, if the distance is at most `most`; the first end among equals."""
    m = len(pattern)
    masks: dict[int, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, most + 1, -1
    get = masks.get
    for j, c in enumerate(text):
        eq = get(c, 0)
        xv = eq | mv
        xh = ((((eq & pv) + pv) ^ pv) | eq) & full
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
        if score < best:
            best, end = score, j + 1
            if not best:
                break
    return (best, end) if end >= 0 else None


@dataclass(frozen=True)
class Item:
    item_id: int
    text: bytes
    budget: int


def pieces(text: bytes, budget: int) -> list[tuple[int, bytes]]:
    """The item cut into budget + 1 pieces of nearly equal length, with their offsets."""
    n = budget + 1
    edges = [len(text) * i // n for i in range(n + 1)]
    return [(a, text[a:b]) for a, b in zip(edges, edges[1:], strict=False)]


class Matcher:
    """Finds items in documents."""

    def __init__(self, items: list[tuple[int, str | None]], rate: float, exact_below: int = 0):
        import ahocorasick

        self.items: list[Item] = []
        where: dict[bytes, list[tuple[int, int]]] = {}
        for item_id, text in items:
            own = normal(text or "")
            if not own:
                continue
            budget = int(rate * len(own)) if len(own) >= exact_below else 0
            for at, piece in pieces(own, budget):
                where.setdefault(piece, []).append((len(self.items), at))
            self.items.append(Item(item_id, own, budget))
        self._automaton = ahocorasick.Automaton()
        for piece, found in where.items():
            self._automaton.add_word(piece.decode("latin-1"), (len(piece), found))
        if where:
            self._automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int]]:
        """(item_id, distance) of each item within its budget."""
        if not self.items or not text:
            return []
        own = normal(text)
        windows: dict[int, list[tuple[int, int]]] = {}
        for end, (size, found) in self._automaton.iter(own.decode("latin-1")):
            start = end + 1 - size
            for i, at in found:
                item = self.items[i]
                windows.setdefault(i, []).append((max(0, start - at - item.budget), min(len(own), start - at + len(item.text) + item.budget)))
        out = []
        for i, spans in windows.items():
            item, best = self.items[i], None
            spans.sort()
            merged = [list(spans[0])]
            for a, b in spans[1:]:
                if a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            for a, b in merged:
                if item.budget == 0:
                    hit = (0, b) if own.find(item.text, a, b) >= 0 else None
                elif b - a < len(item.text) - item.budget:
                    hit = None
                else:
                    hit = (0, b) if own.find(item.text, a, b) >= 0 else myers(item.text, own[a:b], item.budget)
                if hit and (best is None or hit[0] < best):
                    best = hit[0]
            if best is not None:
                out.append((item.item_id, best))
        return sorted(out)


def blocks(items: DataFrame, block: int, id_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of at most `block` bytes (one larger item stands alone); the driver holds one block at a time."""
    own, size = [], 0
    for item_id, text in items.select(id_col, text_of(text_col)).toLocalIterator():
        if own and size + len(text) > block:
            yield own
            own, size = [], 0
        own.append((item_id, text))
        size += len(text) + 16
    yield own


def matches(docs: DataFrame, items: DataFrame, rate: float = 0.08, exact_below: int = 0, block: int = 8_000_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Pairs: the document's id, item_id and distance, for every item within its budget anywhere in a document."""
    spark = docs.sparkSession
    ship(spark)
    kinds = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    rows = docs.select(F.col(id_col), text_of(text_col).alias("_text_to_search"))

    def one(block_of_items: list[tuple[int, str]]) -> DataFrame:
        sent = spark.sparkContext.broadcast(block_of_items)  # at most `block` bytes
        made: list[Matcher] = []

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            made.append(Matcher(sent.value, rate, exact_below))
            for batch in batches:
                take, ids, distances = [], [], []
                for i, text in enumerate(strings(batch.column(1))):
                    for item_id, distance in made[-1].find(text):
                        take.append(i)
                        ids.append(item_id)
                        distances.append(distance)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(take, pa.int64())), pa.array(ids, pa.int64()), pa.array(distances, pa.int64())], names=[id_col, item_col, "distance"])

        return rows.mapInArrow(run, f"`{id_col}` {kinds[0]}, `{item_col}` long, distance long")

    out = None
    for part in blocks(items, block, item_col, item_text_col):
        out = one(part) if out is None else out.unionByName(one(part))
    return out


def contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """Documents with a match: doc_id, items (array of item_id, ascending), nearest (the least distance)."""
    id_col = options.get("id_col", "doc_id")
    return matches(docs, items, **options).groupBy(id_col).agg(F.sort_array(F.collect_set("item_id")).alias("items"), F.min("distance").alias("nearest"))


def clean(docs: DataFrame, items: DataFrame, rate: float = 0.08, exact_below: int = 0, block: int = 8_000_000, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """docs without the rows in which an item is found, all columns as they are; nothing is shuffled. A pass for each block of items."""
    spark = docs.sparkSession
    ship(spark)
    out = docs
    for part in blocks(items, block, item_col, item_text_col):
        out = _without(out, spark.sparkContext.broadcast(part), rate, exact_below, text_col)
    return out


def _without(docs: DataFrame, sent, rate: float, exact_below: int, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(sent.value, rate, exact_below)
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            yield batch.filter(pa.array([not matcher.find(t) for t in strings(batch.column(at))], pa.bool_()))

    return docs.mapInArrow(tidied("decontaminate", run), docs.schema)
