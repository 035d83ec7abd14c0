"""Suffix-array dedup with a run-length index: bytes covered by long strings that also start elsewhere.

The corpus is split into segments that can be indexed apart without losing a match:

1. Every string of LENGTH bytes names an anchor inside it, the 64-byte gram of the
   least hash (leftmost among equals). Equal strings name equal grams at equal
   places. Strings with the same anchor are neighbours, and form one segment.
2. Segments meet by their gram (hashes only are shuffled). Equal segments of which
   there are several repeat as a whole. A gram with different segments sends one copy
   of each to the index.
3. Segments of one gram are indexed together: their suffixes are sorted, the
   Burrows-Wheeler transform is kept as runs, with a sample of position and
   neighbour match length at each run's head and end. Streaming over the text from
   the samples gives the matching statistics (within a run a position's match
   is its predecessor's less one); a position whose longest match elsewhere has
   LENGTH bytes or more starts a repeated string.
4. A gram with more than `group_bytes` of different segments is split by where its strings lie
   around the anchor: those that reach far to the left by the bytes there, the
   others by the bytes on the right; each part halves again where it must. Equal
   strings stay together at every split, so nothing is lost, and no group grows
   with the corpus.

Repeats are judged on the input. Null texts count as empty; matches never cross
documents; repeated rows repeat each other. Rows are told apart by a 64-bit hash of
id and text, so null ids do no harm; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm.common import dropped, joined_once, ship, strings, text_of, written

LENGTH = 400
#: Bytes of an anchor, a power of two.
GRAM = 64
#: Bytes of different segments that one group may bring to an index, and that one index holds.
GROUP_BYTES, INDEX_BYTES = 1_000_000, 2_000_000


# -- anchors ------------------------------------------------------------------
def gram_hashes(raw: np.ndarray, width: int = GRAM) -> np.ndarray:
    """A 64-bit hash of each window of `width` bytes (a power of two), by doubling."""
    with np.errstate(over="ignore"):
        h = (raw.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        step = 1
        while step < width:
            h = h[:-step] * np.uint64(0xBF58476D1CE4E5B9 + 2 * step) + h[step:]
            h ^= h >> np.uint64(31)
            step *= 2
    return h


def least_in_windows(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each window of that width: block-wise minima from both sides."""
    n = len(x)
    blocks = -(-n // width)
    full = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = x
    rows = full.reshape(blocks, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def segments(raw: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first start, number of starts, anchor, gram hash) of the segments of one text; none if it is shorter than `length`."""
    n, wide = len(raw), length - gram + 1
    if n < length:
        e = np.zeros(0, np.int64)
        return e, e, e, e.astype(np.uint64)
    starts, counts, anchors, hashes = [], [], [], []
    # Blocks of at most 2**22 starts, so that a place fits in 24 bits beside 40 bits of hash.
    for base in range(0, n - length + 1, 1 << 22):
        stop = min(n - length + 1, base + (1 << 22))
        h = gram_hashes(raw[base : stop + length - 1], gram)
        with np.errstate(over="ignore"):
            mixed = h * np.uint64(0x94D049BB133111EB)
        mixed ^= mixed >> np.uint64(32)
        packed = (mixed & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=np.uint64)
        at = (least_in_windows(packed, wide) & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        starts.append(first + base)
        counts.append(np.diff(np.append(first, len(at))))
        anchors.append(at[first] + base)
        hashes.append(h[at[first]])
    return tuple(map(np.concatenate, (starts, counts, anchors, hashes)))


# -- the index ------------------------------------------------------------------
@dataclass
class RunIndex:
    """A run-compressed Burrows-Wheeler transform of concatenated texts, with samples at the ends of runs.

    chars, begins: each run's character and its place in the transform. heads, head_match: text position of a run's
    first row, and its match with the row before; ends, end_match: of the last row, with the row after.
    """

    chars: np.ndarray
    begins: np.ndarray
    heads: np.ndarray
    head_match: np.ndarray
    ends: np.ndarray
    end_match: np.ndarray
    size: int

    @classmethod
    def build(cls, text: np.ndarray, ends: np.ndarray) -> RunIndex:
        """text: bytes of all texts in turn; ends: where each ends. The end of each text is a character of its own, least of all."""
        n = len(text)
        left = np.repeat(ends, np.diff(np.concatenate([[0], ends]))) - np.arange(n)  # bytes up to the end of the own text
        order, ranks = _sorted_suffixes(text, left, int(left.max(initial=0)))
        before = np.where(np.concatenate([[True], left[:-1] == 1]), -1, np.concatenate([[0], text[:-1]]).astype(np.int16))
        bwt = before[order]
        # The characters that end texts differ from each other, so each makes a run.
        new = np.concatenate([[True], (bwt[1:] != bwt[:-1]) | (bwt[1:] < 0)])
        begins = np.flatnonzero(new)
        lasts = np.append(begins[1:], n) - 1
        head_match, end_match = np.zeros(len(begins), np.int64), np.zeros(len(begins), np.int64)
        head_match[1:] = _match(order[begins[1:] - 1], order[begins[1:]], ranks, text, left)
        end_match[:-1] = head_match[1:]
        return cls(bwt[begins], begins, order[begins], head_match, order[lasts], end_match, n)

    def matching_statistics(self) -> np.ndarray:
        """For each text position, the longest match that starts elsewhere, streamed from the samples."""
        out = np.zeros(self.size, np.int64)
        places = np.arange(self.size)
        for at, match in ((self.heads, self.head_match), (self.ends, self.end_match)):
            # The sum of place and match is constant from one sample to the next.
            known = np.full(self.size, -1, np.int64)
            known[at] = at + match
            last = np.maximum.accumulate(np.where(known >= 0, places, 0))
            np.maximum(out, known[last] - places, out=out)
        return out


def _sorted_suffixes(text: np.ndarray, left: np.ndarray, longest: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Suffix order, and the ranks by the first 8, then by more and more bytes."""
    n = len(text)
    key = np.zeros(n, np.uint64)
    for j in range(8):
        own = np.zeros(n, np.uint64)
        own[: max(0, n - j)] = text[j:]
        own += np.uint64(1)
        own[left <= j] = 0
        key = key << np.uint64(8) | own
    order = np.argsort(key)
    short = left < 8
    some = np.flatnonzero(short)
    # Equal ends of texts are ordered by place.
    order[short[order]] = some[np.lexsort((some, key[some]))]
    starts = np.concatenate([[True], left[:-1] == 1])
    number = (np.cumsum(starts) - 1).astype(np.uint64)
    texts = np.uint64(starts.sum())
    blocks, bits = (3, np.uint64(21)) if n + int(texts) < 1 << 21 else (2, np.uint64(32))
    ranks: list[tuple[int, np.ndarray]] = []
    sorted_key, width = key[order], 8
    new = np.concatenate([[True], (sorted_key[1:] != sorted_key[:-1]) | short[order][1:]])
    while True:
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(new)
        ranks.append((width, rank))
        if new.all() or width >= longest:
            return order, ranks
        # Only rows that tie are sorted again, within their places.
        rows = np.flatnonzero(~(new & np.append(new[1:], True)))
        own = order[rows]
        key = rank[own]
        for k in range(1, blocks):
            # A text that has ended comes first, in the order of texts.
            over = left[own] <= k * width
            key = key << bits | np.where(over, number[own], texts + rank[np.minimum(own + k * width, n - 1)])
        by = np.argsort(key)
        order[rows] = own[by]
        sorted_key = key[by]
        new[rows[1:]] |= sorted_key[1:] != sorted_key[:-1]
        width *= blocks


def _match(a: np.ndarray, b: np.ndarray, ranks: list[tuple[int, np.ndarray]], text: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The common length of suffixes a and b."""
    out = np.zeros(len(a), np.int64)
    most = np.minimum(left[a], left[b])
    for width, rank in reversed(ranks):
        for _ in range(2):
            some = np.flatnonzero(most - out >= width)
            some = some[rank[a[some] + out[some]] == rank[b[some] + out[some]]]
            out[some] += width
    for _ in range(8):
        some = np.flatnonzero(most > out)
        some = some[text[a[some] + out[some]] == text[b[some] + out[some]]]
        if not len(some):
            break
        out[some] += 1
    return out


def repeated_starts(texts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each text, the starts of its strings of `length` bytes that also start elsewhere in these texts."""
    text = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    if not len(text):
        return [np.zeros(0, np.int64) for _ in texts]
    found = np.flatnonzero(RunIndex.build(text, ends).matching_statistics() >= length)
    cuts = np.searchsorted(found, ends)
    return [part - base for part, base in zip(np.split(found, cuts[:-1]), np.concatenate([[0], ends[:-1]]), strict=True)]


# -- Spark ------------------------------------------------------------------
def _spans(starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts, ascending, as ranges [first, last + length)."""
    if not len(starts):
        return starts, starts
    gap = np.flatnonzero(np.diff(starts) > 1)
    return starts[np.concatenate([[0], gap + 1])], starts[np.append(gap, len(starts) - 1)] + length


def _with_row(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_of(text_col)
    return docs.select(F.xxhash64(F.col(id_col), text).alias("row"), F.col(id_col).alias("_id"), text.alias("_text"))


def _occurrences(rows: DataFrame) -> DataFrame:
    """(row, start, count, gram, digest, times): a row per different segment of each document; times: how often it has it."""
    import xxhash

    names = ["row", "start", "count", "gram", "digest", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                out: list[list[np.ndarray]] = [[] for _ in names]
                for row, text in zip(part.column(0).to_pylist(), strings(part.column(1)), strict=True):
                    data = text.encode()
                    raw = np.frombuffer(data, np.uint8)
                    first, count, anchor, gram = segments(raw)
                    if not len(first):
                        continue
                    # The digest holds the text, the number of starts and where the anchor is.
                    own = np.array([digest(data[a : a + c + LENGTH - 1], seed=int(c * 1024 + g - a)) for a, c, g in zip(first.tolist(), count.tolist(), anchor.tolist(), strict=True)], np.uint64).view(np.int64)
                    _, at, times = np.unique(own, return_index=True, return_counts=True)
                    for column, x in zip(out, (np.full(len(at), row, np.int64), first[at], count[at], gram[at].view(np.int64), own[at], times), strict=True):
                        column.append(x)
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in out], names=names)

    return rows.select("row", "_text").mapInArrow(run, "row long, start long, count long, gram long, digest long, times long")


def marks(rows: DataFrame, group_bytes: int = GROUP_BYTES, index_bytes: int = INDEX_BYTES, few: int = 1_000_000) -> DataFrame:
    """(row, digests or spans): what repeats. rows: row, _text. Columns: row, start, end, digest (whole segment repeats, at all its places in the row; else null).

    Segments are summed up by content before they meet by gram, so a gram or a segment that a large part of all
    documents share is a few rows from each partition; only the segments' own rows are read again for what repeats.
    """
    found = written(_occurrences(rows), "occurrences")
    first = F.min(F.struct("row", "start", "count"))
    by_digest = written(found.groupBy("gram", "digest").agg(F.sum("times").alias("all"), first.alias("first")), "segments")
    by_gram = by_digest.groupBy("gram").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low != high").select("gram")
    mixed = written(by_gram, "mixed")
    again = written(by_digest.where("all > 1").select("gram", "digest"), "again")
    whole = joined_once(found, again, ["gram", "digest"], few).select("row", F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("end"), "digest")
    whole = written(whole, "whole")

    # One copy of each different segment of mixed grams, with its text.
    wanted = joined_once(by_digest, mixed, "gram", few).select("gram", "digest", "all", "first.*")
    wanted = wanted.groupBy("row").agg(F.collect_list(F.struct("start", "count", "gram", "digest", (F.col("all") == 1).alias("open"))).alias("parts"))
    cut = _cut(rows.join(wanted, "row").select("row", "_text", "parts").dropDuplicates(["row"]))
    parts = written(cut, "parts")
    dropped(found, by_digest, mixed, again)
    out = whole
    while True:
        # Sums per gram, made before the shuffle as far as they go; the grams beyond the size are few.
        over = written(parts.where("high > low").groupBy("gram").agg(F.sum(F.length("data")).alias("bytes")).where(F.col("bytes") > group_bytes).select("gram"), "large")
        if over.isEmpty():
            return out.unionByName(_indexed(parts, index_bytes))
        out = out.unionByName(_indexed(parts.join(over, "gram", "left_anti"), index_bytes))
        halves = written(_halved(parts.join(over, "gram", "left_semi")), "halves")
        # A group's range of offsets is the same in all its parts, and "low", "high" and "anchor" follow from the segment.
        kinds = written(halves.groupBy("gram", "digest").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("row", "start")).alias("one")), "kinds")
        repeated = joined_once(halves, written(kinds.where("times > 1").select("gram", "digest"), "again"), ["gram", "digest"], few).where("open")
        out = out.unionByName(repeated.select("row", F.col("start"), (F.col("start") + F.length("data")).alias("end"), F.lit(None).cast("long").alias("digest")))
        kept = halves.join(kinds.select("gram", "digest", "times", F.col("one.row").alias("row"), F.col("one.start").alias("start")), ["gram", "digest", "row", "start"])
        parts = written(kept.withColumn("open", F.col("open") & (F.col("times") == 1)).dropDuplicates(["gram", "digest"]).select(*parts.columns), "parts")


#: A part: its row and first start there, the anchor's place in data, and the group's range of offsets (anchor less start) from low to high.
_PART = "row long, start long, gram long, digest long, open boolean, anchor int, low int, high int, data binary"


def _cut(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _PART.split(", ")]
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                out = []
                for row, text, wanted in zip(part.column(0).to_pylist(), strings(part.column(1)), part.column(2).to_pylist(), strict=True):
                    data = text.encode()
                    first, _, anchor, _ = segments(np.frombuffer(data, np.uint8))
                    for w in wanted:
                        a, c = w["start"], w["count"]
                        g = int(anchor[np.searchsorted(first, a)]) - a
                        out.append((row, a, w["gram"], w["digest"], w["open"], g, 0, LENGTH - GRAM, data[a : a + c + LENGTH - 1]))
                yield _batch(out, names)

    return rows.mapInArrow(run, _PART)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 4 + [pa.bool_()] + [pa.int32()] * 3 + [pa.binary()]
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _halved(parts: DataFrame) -> DataFrame:
    """Each part as two: strings that reach further left of the anchor, under the bytes there, and the others, under the bytes to the right."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _PART.split(", ")]
        digest = xxhash.xxh3_64_intdigest
        sign = lambda x: x - (1 << 64) if x >> 63 else x
        for batch in batches:
            out = []
            for row, start, gram, _, is_open, anchor, low, high, data in zip(*(batch.column(i).to_pylist() for i in range(9)), strict=True):
                middle = (low + high + 1) // 2
                for least, most in ((middle, high), (low, middle - 1)):
                    # All strings of offsets least..most hold the bytes from anchor - least to anchor - most + LENGTH.
                    a, b = max(least, anchor - len(data) + LENGTH), min(most, anchor)
                    if a <= b:
                        own = data[anchor - b : anchor - a + LENGTH]
                        shared = data[anchor - least : anchor - most + LENGTH]
                        key = sign(digest(shared, seed=(gram ^ (least * 1024 + most)) & (1 << 64) - 1))
                        out.append((row, start + anchor - b, key, sign(digest(own, seed=b)), is_open, b, least, most, own))
            yield _batch(out, names)

    return parts.select("row", "start", "gram", "digest", "open", "anchor", "low", "high", "data").mapInArrow(run, _PART)


def _indexed(parts: DataFrame, index_bytes: int) -> DataFrame:
    """Spans of open parts whose strings repeat within their gram; grams are indexed together up to a size, each one whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bool, bytes]] = []
        size, before = 0, None

        def done() -> pa.RecordBatch:
            rows, starts, ends = [], [], []
            for (row, start, is_open, _), found in zip(held, repeated_starts([h[3] for h in held]), strict=True):
                if is_open and len(found):
                    a, b = _spans(found, LENGTH)
                    rows += [row] * len(a)
                    starts += (a + start).tolist()
                    ends += (b + start).tolist()
            return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.nulls(len(rows), pa.int64())], names=["row", "start", "end", "digest"])

        for batch in batches:
            for gram, row, start, is_open, data in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if gram != before and size >= index_bytes // 2:
                    yield done()
                    held, size = [], 0
                before = gram
                held.append((row, start, is_open, data))
                size += len(data)
        if held:
            yield done()

    dealt = parts.select("gram", "row", "start", "open", "data").repartition("gram").sortWithinPartitions("gram")
    return dealt.mapInArrow(run, "row long, start long, end long, digest long")


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, **options) -> DataFrame:
    """Per document: id, n_bytes, n_removed, n_spans, kept_sha256, and with_text the remaining bytes."""
    ship(docs.sparkSession)
    rows = _with_row(docs, id_col, text_col)
    found = written(marks(rows.select("row", "_text"), **options), "marks")
    per_row = found.groupBy("row").agg(F.collect_list(F.when(F.col("digest").isNull(), F.struct("start", "end"))).alias("spans"), F.collect_set("digest").alias("digests"))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                out: list[list] = [[], [], [], [], []]
                for text, spans, whole in zip(strings(part.column(1)), part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    data = text.encode()
                    n = len(data)
                    change = np.zeros(n + 1, np.int64)
                    if whole:
                        keys = set(whole)
                        first, count, anchor, _ = segments(np.frombuffer(data, np.uint8))
                        for a, c, g in zip(first.tolist(), count.tolist(), anchor.tolist(), strict=True):
                            x = digest(data[a : a + c + LENGTH - 1], seed=c * 1024 + g - a)
                            if (x - (1 << 64) if x >> 63 else x) in keys:
                                change[a] += 1
                                change[a + c + LENGTH - 1] -= 1
                    for s in spans or ():
                        change[s["start"]] += 1
                        change[s["end"]] -= 1
                    gone = np.cumsum(change[:n]) > 0
                    edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                    kept, at = [], 0
                    for a, b in edges.reshape(-1, 2).tolist():
                        kept.append(data[at:a])
                        at = b
                    kept.append(data[at:])
                    own = b"".join(kept)
                    for column, x in zip(out, (n, n - len(own), len(edges) // 2, hashlib.sha256(own).hexdigest(), own), strict=True):
                        column.append(x)
                columns = [pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)]
                names = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns][: 6 if with_text else 5], names=names[: 6 if with_text else 5])

    return rows.join(per_row, "row", "left").select(F.col("_id").alias(id_col), "_text", "spans", "digests").mapInArrow(run, schema)
