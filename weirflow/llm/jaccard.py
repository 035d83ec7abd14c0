"""N-gram Jaccard join: an exact metric-space join on sets of word shingles.

The distance 1 - |A n B| / |A u B| is a metric. Unrelated documents all lie at
distance 1 from each other, where no pivot can part them; so the first regions come
from shared shingles, and pivots, Voronoi regions, windows and recursion work inside:

1. Documents with equal sets form a class; the join runs between classes.
2. Two sets that link share SHARED = 3 shingles at least among the first
   n - ceil(0.75 n) + 3 shingles of each, in any fixed order of all shingles (sets of
   under 3 link with no other). A shingle that few sets lead with gives their pairs, and
   the smaller class of a pair with 3 of them is a pivot whose cell has both: a pair
   that shares one or two by chance, of which there are more and more as a corpus
   grows, sends no set. Each other shingle
   spans a region, whose pivot is its smallest class; regions of one pivot
   make its cell, and a class is in the cell of each of its regions. The order puts
   shingles that many documents share last (a hint from counts over all documents; any
   order is exact). Of shingles that are counted often the pivots are found first, so
   their members name the cell without meeting by shingle.
3. A cell that one task can't hold is cut by Voronoi: up to PIVOTS of its members are
   drawn by hash, every member is placed in the region of its nearest pivot, and the
   members of a region that are known to be connected alike have a box of least and
   greatest distances to all pivots. A member is replicated to each region that comes
   after its own and has a box, of members that it isn't connected with, within the
   window of the triangle inequality: |d(x, p) - d(y, p)| <= 0.25 for all pivots p.
   A member in no box's window leaves. Regions recurse with pivots of their own until
   a task can hold them; one that pivots don't part is joined in blocks.
4. Of a cell or region in one task, members without a partner of a like size leave, and
   so do those (of cells) whose sketch, a quarter of the set, differs too much from all
   others'. The others are compared by the sizes, by the window of one pivot, and only
   if they aren't connected yet.
5. Links make components; each document gets the smallest id of its component.

Pairs of a group are never emitted, only links that connect its parts. Null texts count as empty; documents without words link with nothing.
Repeated rows are equal sets; null ids take part, and a component of null ids only
has a null component_id. Rows are told apart by a 64-bit hash of id and text,
shingles and sets by 64-bit hashes of their own. Members travel as 32 bits of these: what may
collide is bounded by spare(), and a pair that this leaves open is compared by all 64.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weirflow.llm.common import dropped, fits, joined_once, raw_texts, ship, text_of, tidied, written

#: Words of a shingle; a link is 100 * intersection >= PERCENT * union.
SIZE, PERCENT = 5, 75
#: Shingles counted as frequent (an ordering hint), at most.
HEAVY = 200_000
#: Different sets of slices that make a shingle hot; those of less, or not among HEAVY, have few rows of any task.
HOT = 1_000
#: Leading shingles that sets that link share at least: no set of fewer members links with another.
SHARED = 3
#: Rows of a shingle that are taken as pairs; shingles of more span a region.
PAIRED = 8
#: Pivots of a region that is cut, at most, and levels of the recursion.
PIVOTS, LEVELS = 8, 12
#: Shingles of the sets of a cell (and members, by 256 each) that one task joins, at most; also the size of blocks, doubled.
CELL = 2_000_000
#: Links of which components are made by one task (16 MB); more are dealt over the cluster.
FEW_LINKS = 1_000_000


def spare(k):
    """Differences between sets of k members in all that collisions of 32 bits may hide: with about k^2 / 2^33 of them expected, six deviations and one more, two members each."""
    expected = np.asarray(k, float) ** 2 / 2.0**33
    return 2 * np.ceil(expected + 6 * np.sqrt(expected) + 1).astype(np.int64)


#: An odd multiplier, and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes of text that are hashed together, which keeps arrays in the processor's cache.
_CHUNK = 1 << 18


def _powers(x: int, n: int) -> np.ndarray:
    out = np.full(n, x, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Shingler:
    """Sets of shingle hashes of texts. Words are hashed by differences of a running polynomial sum over the bytes of many texts."""

    def __init__(self) -> None:
        import xxhash

        self._digest = xxhash.xxh3_64_intdigest
        rng = np.random.default_rng(20240229)
        self._table = rng.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
        self._space = np.zeros(256, bool)
        self._space[list(b" \t\n\x0b\x0c\r")] = True
        self._table[list(range(65, 91))] = self._table[list(range(97, 123))]  # A-Z as a-z
        self._grow(_CHUNK + 1)

    def _grow(self, n: int) -> None:
        self._up, self._down = _powers(_BASE, n), _powers(_INVERSE, n)

    def _words(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and starts of all words."""
        raw = np.frombuffer(data, np.uint8)
        n = len(raw)
        if n >= len(self._up):
            self._grow(2 * n)
        inside = ~self._space[raw]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if n and inside[0]:
            edge = np.concatenate([[0], edge])
        if n and inside[-1]:
            edge = np.append(edge, n)
        starts, ends = edge[::2], edge[1::2]
        total = np.zeros(n + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(self._table[raw] * self._up[:n], out=total[1:])
            h = (total[ends] - total[starts]) * self._down[starts]
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(29)
        return h, starts

    def many(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """The distinct shingle hashes of each text, ascending (uint64)."""
        at = 0
        while at < len(texts):
            stop, size = at, 0
            while stop < len(texts) and (stop == at or size + len(texts[stop]) < _CHUNK):
                size += len(texts[stop]) + 1
                stop += 1
            part = texts[at:stop]
            h, starts = self._words(b"\n".join(part))
            offsets = np.cumsum([0] + [len(t) + 1 for t in part])
            cuts = np.searchsorted(starts, offsets).tolist()
            x = self._mixed(h, SIZE)
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b - a >= SIZE:
                    yield np.unique(x[a : b - SIZE + 1])
                else:
                    yield self._mixed(h[a:b], b - a) if b > a else np.zeros(0, np.uint64)
            at = stop

    @staticmethod
    def _mixed(h: np.ndarray, width: int) -> np.ndarray:
        n = len(h) - width + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            x = np.full(n, 0x9E3779B97F4A7C15 + width, np.uint64)
            for j in range(width):
                x ^= h[j : n + j]
                x *= np.uint64(0xFF51AFD7ED558CCD)
                x ^= x >> np.uint64(32)
        return x

    def shingles(self, text: bytes) -> np.ndarray:
        return next(self.many([text]))

    def key(self, own: np.ndarray) -> int:
        return _signed(self._digest(own.tobytes()))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


_SHINGLER: list[Shingler] = []


def _shingler() -> Shingler:
    if not _SHINGLER:
        _SHINGLER.append(Shingler())
    return _SHINGLER[0]


def _slices(batch: pa.RecordBatch, rows: int = 2048) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def survey(docs: DataFrame, least: int = 3, held: int = 1_500_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """First pass. kind 0: id, row (a hash of id and text), n (size of the set), key (of the set, null if empty). kind 1: key (a shingle), n (different sets of a slice that share it).

    A slice has about `held` shingles, which bounds memory.
    """
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["kind", "id", "row", "n", "key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = _shingler()
        sets: dict[int, np.ndarray] = {}
        size, kind_of_id = 0, pa.int64()

        def shared() -> pa.RecordBatch:
            found, counts = np.unique(np.concatenate([*sets.values(), np.zeros(0, np.uint64)]), return_counts=True)
            some = counts >= least
            m = int(some.sum())
            return pa.RecordBatch.from_arrays([pa.array(np.ones(m, np.int32)), pa.nulls(m, kind_of_id), pa.nulls(m, pa.int64()), pa.array(counts[some]), pa.array(found[some].view(np.int64))], names=names)

        for batch in batches:
            kind_of_id = batch.schema.field(0).type
            for part in _slices(batch):
                sizes, keys = [], []
                for own in s.many(raw_texts(part.column(2))):
                    k = s.key(own) if len(own) else None
                    sizes.append(len(own))
                    keys.append(k)
                    if k is not None and k not in sets:
                        sets[k] = own
                        size += len(own)
                yield pa.RecordBatch.from_arrays([pa.array([0] * len(sizes), pa.int32()), part.column(0), part.column(1), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64())], names=names)
                if size > held:
                    yield shared()
                    sets, size = {}, 0
        if sets:
            yield shared()

    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), _row(id_col, text_col).alias("_row"), text_of(text_col).alias("_text"))
    return rows.mapInArrow(tidied("jaccard", run, _SHINGLER.clear), f"kind int, id {kind}, row long, n long, key long")


def _row(id_col: str, text_col: str):
    return F.xxhash64(F.col(f"`{id_col}`"), text_of(text_col))


def prefixes(docs: DataFrame, heavy: np.ndarray, ranks: np.ndarray, hot: np.ndarray | None = None, cells: tuple[np.ndarray, np.ndarray] | None = None, text_col: str = "text") -> DataFrame:
    """(token, cell, key, n) for the leading shingles of each set; equal sets of a slice give them once.

    heavy, ranks: frequent shingles, ascending, and the rank of their counts; at most HEAVY, so they are broadcast. With
    hot (shingles), only those are given. With hot and cells (hot shingles, ascending, and the cell of each), a set names
    each cell of its hot shingles once, under a token of its own; hot shingles without a cell are left out.
    """
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast((heavy, ranks, hot if hot is not None else np.zeros(0, np.uint64), cells))

    def found(common: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(common):
            return np.zeros(len(own), np.int64), np.zeros(len(own), bool)
        at = np.searchsorted(common, own)
        at[at == len(common)] = 0
        return at, common[at] == own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, (common, rank, often, celled) = _shingler(), sent.value
        for batch in batches:
            for part in _slices(batch):
                seen, tokens, named, keys, sizes = set(), [], [], [], []
                for own in s.many(raw_texts(part.column(0))):
                    n = len(own)
                    if not n or (k := s.key(own)) in seen:
                        continue
                    seen.add(k)
                    lead = n - -(-PERCENT * n // 100) + SHARED
                    at, hit = found(common, own)
                    if hit.any():
                        own = own[np.argsort(np.where(hit, rank[at], 0), kind="stable")]
                    own = own[:lead]
                    _, is_hot = found(often, own)
                    direct = np.zeros(0, np.int64)
                    if celled is None:
                        own = own[is_hot] if len(often) else own
                    else:
                        at, known = found(celled[0], own[is_hot])
                        direct, own = np.unique(celled[1][at[known]]), own[~is_hot]
                    with np.errstate(over="ignore"):
                        alone = (direct ^ np.int64(k)) * np.int64(0x2545F4914F6CDD1D) + 1
                    tokens += [own.view(np.int64), alone]
                    named += [pa.nulls(len(own), pa.int64()), pa.array(direct, pa.int64())]
                    keys.append(np.full(len(own) + len(direct), k, np.int64))
                    sizes.append(np.full(len(own) + len(direct), n, np.int32))
                if tokens:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), pa.concat_arrays(named), pa.array(np.concatenate(keys)), pa.array(np.concatenate(sizes))], names=["token", "cell", "key", "n"])

    return docs.select(text_of(text_col).alias("_text")).mapInArrow(tidied("jaccard", run, _SHINGLER.clear), "token long, cell long, key long, n int")


def sets_of(docs: DataFrame, classes: DataFrame, wanted: DataFrame, exact: bool = False, small: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, n, sketch, members) of the wanted keys, written, from one document of each class (key, doc: its row's hash).

    members: the upper 32 bits of each member's hash, or all 64 if `exact`; sketch: 16 bits of those whose hash is divisible by 4.
    """
    ship(docs.sparkSession)
    ids = written(classes.join(wanted, "key", "left_semi").select(F.col("doc").alias("_row"), "key"), "wanted")
    number = ids.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = _shingler()
        for batch in batches:
            for part in _slices(batch):
                keys, sizes, sketches, members = [], [], [], []
                for key, own in zip(part.column(0).to_pylist(), s.many(raw_texts(part.column(1))), strict=True):
                    keys.append(key)
                    sizes.append(len(own))
                    sketches.append(np.unique((own[own & np.uint64(3) == 0] >> np.uint64(48)).astype(np.uint16)).tobytes())
                    members.append(own.tobytes() if exact else np.unique((own >> np.uint64(32)).astype(np.uint32)).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sizes, pa.int32()), pa.array(sketches, pa.binary()), pa.array(members, pa.binary())], names=["key", "n", "sketch", "members"])

    rows = docs.select(_row(id_col, text_col).alias("_row"), text_of(text_col).alias("_text"))
    # Broadcast up to 16 MB, which is checked; else both sides are shuffled.
    own = rows.join(F.broadcast(ids) if number <= small else ids, "_row").select("key", "_text")
    sets = written(own.mapInArrow(tidied("jaccard", run, _SHINGLER.clear), "key long, n int, sketch binary, members binary"), "sets")
    dropped(ids)
    # A row may be there several times.
    return sets if sets.count() == number else written(sets.dropDuplicates(["key"]), "sets")


def _common(x: pa.Scalar, y: pa.Scalar, kind) -> tuple[int, int]:
    """(size of the intersection, size of the union) of two ascending arrays."""
    p, q = np.frombuffer(x.as_buffer(), kind), np.frombuffer(y.as_buffer(), kind)
    if len(p) > len(q):
        p, q = q, p
    if not len(p):
        return 0, len(q)
    at = np.searchsorted(q, p)
    at[at == len(q)] = 0
    both = int((q[at] == p).sum())
    return both, len(p) + len(q) - both


def _two_sets(pairs: DataFrame, sets: DataFrame, column: str) -> DataFrame:
    own = pairs.join(sets.select(F.col("key").alias("a"), F.col("n"), F.col(column).alias("own")), "a")
    return own.join(sets.select(F.col("key").alias("b"), F.col("n").alias("m"), F.col(column).alias("other")), "b").select("a", "b", "n", "m", "own", "other")


def _links_of(pairs: DataFrame) -> DataFrame:
    """(a, b) of the pairs with two sets, by all 64 bits, that link: sets of n and m members that differ in at most (n + m) / 7."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n, m, x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), batch.column(5), strict=True):
                both, union = _common(x, y, np.uint64)
                keep.append(7 * (union - both) <= n + m)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(tidied("jaccard", run, _SHINGLER.clear), "a long, b long")


def bounds(differ, k) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest distance of sets of k members in all that were seen to differ in so many."""
    most = differ + spare(k)
    return 2 * differ / (k + differ), 2 * most / (k + most)


class _Cell:
    """Members of a cell (or of two of its blocks) with their sets; finds links that connect them."""

    def __init__(self, keys: list[int], sizes: list[int], sets: list[np.ndarray]):
        # size: of the sets; length: of what represents them, which collisions shorten.
        self.keys, self.size, self.length, self.sets = keys, np.array(sizes, np.int64), np.array([len(x) for x in sets], np.int64), sets
        of, member = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.length)
        order = np.argsort(of, kind="stable")
        ordered = of[order]
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(of) else np.zeros(0, np.int64)
        self.values, self.cuts = ordered[first], np.append(first, len(of))
        self.posting = member[order]

    def shared_with(self, i: int) -> np.ndarray:
        """How many members of set i each set has."""
        at = np.searchsorted(self.values, self.sets[i])
        begins, counts = self.cuts[at], self.cuts[at + 1] - self.cuts[at]
        total = int(counts.sum())
        places = np.repeat(begins - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(total)
        return np.bincount(self.posting[places], minlength=len(self.sets))

    def open(self) -> np.ndarray:
        """Who may link to someone, as far as the sketches that stand for the sets show."""
        out = np.zeros(len(self.keys), bool)
        for i in range(len(self.keys) - 1):
            alike = 100 * np.minimum(self.size[i + 1 :], self.size[i]) >= PERCENT * np.maximum(self.size[i + 1 :], self.size[i])
            if out[i]:
                alike &= ~out[i + 1 :]  # only who has found no one yet matters
            if alike.any():
                differ = self.length[i + 1 :] + self.length[i] - 2 * self.shared_with(i)[i + 1 :]
                near = alike & (7 * differ <= self.size[i + 1 :] + self.size[i])
                if near.any():
                    out[i] = True
                    out[i + 1 :] |= near
        return out

    def links(self, pivot: int, labels: list[int | None], guests: np.ndarray, blocks: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(a, b, state): links (2), and undecided pairs (1), that connect what is not connected yet.

        pivot: whose distances make the window. labels: members of one label are connected. Guests aren't compared with
        each other, and members of a block only if all are of one block.
        """
        m = len(self.keys)
        root, groups = np.arange(m), {}
        for i, label in enumerate(labels):
            if label is not None:
                groups.setdefault(label, []).append(i)
        for own in groups.values():
            root[own] = own[0]
        settled = np.zeros(m, bool)
        if groups:
            settled[max(groups.values(), key=len)] = True  # the others are compared with these, which is enough
        low, high = bounds(self.length + self.length[pivot] - 2 * self.shared_with(pivot), self.size + self.size[pivot])
        reach = 1 - PERCENT / 100 + 1e-9
        whole = len(np.unique(blocks)) == 1
        done = np.zeros(m, bool)
        # The pivot first: who links to it is connected before others are compared.
        for i in [pivot] + [i for i in range(m) if i != pivot and not settled[i]]:
            done[i] = True
            open_to = ~done & (root != root[i]) & (100 * np.minimum(self.size, self.size[i]) >= PERCENT * np.maximum(self.size, self.size[i]))
            if i != pivot:
                open_to &= (low - high[i] <= reach) & (low[i] - high <= reach)
            if guests[i]:
                open_to &= ~guests
            if not whole:
                open_to &= blocks != blocks[i]
            if not open_to.any():
                continue
            some = np.flatnonzero(open_to)
            differ = self.length[some] + self.length[i] - 2 * self.shared_with(i)[some]
            limit = self.size[some] + self.size[i]
            sure = 7 * (differ + spare(limit)) <= limit
            for j in some[sure].tolist():
                if root[j] != root[i]:
                    root[root == root[j]] = root[i]
                    yield self.keys[i], self.keys[j], 2
            for j in some[~sure & (7 * differ <= limit)].tolist():
                if root[j] != root[i]:
                    yield self.keys[i], self.keys[j], 1


def _by_cell(rows: DataFrame, names: list[str], make, schema: str) -> DataFrame:
    """make(cell, rows) for all rows of a (cell, i, j), dealt by these; rows are tuples of the named columns, the cell in front."""
    columns = ["cell", "i", "j", *names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                for row in zip(*(part.column(c).to_pylist() for c in range(len(columns))), strict=True):
                    if row[:3] != now:
                        if len(held) > 1:
                            yield make(now[0], held)
                        now, held = row[:3], []
                    held.append(row[3:])
        if len(held) > 1:
            yield make(now[0], held)

    return rows.select(*columns).repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j").mapInArrow(tidied("jaccard", run, _SHINGLER.clear), schema)


def narrowed(cells: DataFrame) -> DataFrame:
    """(cell, key, n) of members that may link to another member of their cell; cells: cell, i, j, key, n, sketch."""

    def make(cell: int, held: list[tuple]) -> pa.RecordBatch:
        keep = np.flatnonzero(_Cell([h[0] for h in held], [h[1] for h in held], [np.frombuffer(h[2], np.uint16) for h in held]).open()).tolist()
        return pa.RecordBatch.from_arrays([pa.array([cell] * len(keep), pa.int64()), pa.array([held[i][0] for i in keep], pa.int64()), pa.array([held[i][1] for i in keep], pa.int32())], names=["cell", "key", "n"])

    return _by_cell(cells, ["key", "n", "sketch"], make, "cell long, key long, n int")


def joined(cells: DataFrame) -> DataFrame:
    """(a, b, state) of cells, regions and pairs of blocks: rows (cell, i, j, key, n, members, label, guest, block)."""

    def make(cell: int, held: list[tuple]) -> pa.RecordBatch:
        guests = np.array([h[4] for h in held], bool)
        pivot = next((k for k, h in enumerate(held) if h[0] == cell), int(np.argmin(guests)))
        own = _Cell([h[0] for h in held], [h[1] for h in held], [np.frombuffer(h[2], np.uint32) for h in held])
        found = list(own.links(pivot, [h[3] for h in held], guests, np.array([h[5] for h in held])))
        columns = zip(*found, strict=True) if found else [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32()), strict=True)], names=["a", "b", "state"])

    return _by_cell(cells, ["key", "n", "members", "label", "guest", "block"], make, "a long, b long, state int")


# -- Voronoi regions ------------------------------------------------------------------
_PLACED = "region long, salt int, key long, n int, guest boolean, label long, home int, low array<double>, high array<double>, pivots array<long>, states array<int>"
_REGION = "region long, key long, n int, guest boolean, label long"


def _place(members: pa.Table, pivots: pa.Table) -> pa.Table:
    """Distances of the members of a region (or a part of them) to its pivots: _PLACED. A label says what a member is connected with."""
    own = [np.frombuffer(x.as_buffer(), np.uint32) for x in pivots.column("members").combine_chunks()] if pivots.num_rows else []
    keys, sizes = pivots.column("key").to_pylist(), np.array(pivots.column("n").to_pylist(), np.int64)
    lengths = np.array([len(x) for x in own], np.int64)

    def compared(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        both = np.array([int(np.isin(x, p, assume_unique=True).sum()) if len(x) < len(p) else int(np.isin(p, x, assume_unique=True).sum()) for p in own], np.int64)
        differ, k = len(x) + lengths - 2 * both, n + sizes
        return differ, np.where(7 * differ > k, 0, np.where(7 * (differ + spare(k)) <= k, 2, 1))

    # Pivots that link to each other share a label: every part of the region finds the same.
    names = list(keys)
    for i, x in enumerate(own):
        for j in np.flatnonzero(compared(x, int(sizes[i]))[1] == 2).tolist():
            a, b = sorted((names[i], names[j]))
            names = [a if y == b else y for y in names]
    rows: dict[str, list] = {c.split()[0]: [] for c in _PLACED.split(", ")}
    for region, salt, key, n, guest, label, x in zip(*(members.column(c).to_pylist() if c != "members" else members.column(c).combine_chunks() for c in ("region", "salt", "key", "n", "guest", "label", "members")), strict=True):
        differ, state = compared(np.frombuffer(x.as_buffer(), np.uint32), n)
        low, high = bounds(differ, n + sizes)
        home = int(np.argmin(low))
        linked = np.flatnonzero(state == 2)
        if label is None and len(linked):
            label = names[linked[np.argmin(low[linked])]]
        some = [i for i in np.flatnonzero(state > 0).tolist() if keys[i] != key]
        for c, v in zip(rows, (region, salt, key, n, guest, label, home, low, high, [keys[i] for i in some], [int(state[i]) for i in some]), strict=True):
            rows[c].append(v)
    return pa.table({c: pa.array(v, t) for (c, v), t in zip(rows.items(), (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.int32())), strict=True)})


def _replicate(members: pa.Table, boxes: pa.Table) -> pa.Table:
    """Members of a region (or a part of them) in the regions inside it that they belong to, by the boxes of these: (child, key, n, guest, label)."""
    m, reach = members.num_rows, 1 - PERCENT / 100 + 1e-9
    low, high = (np.array(members.column(c).to_pylist(), float).reshape(m, -1) for c in ("low", "high"))
    n, home, guest = (members.column(c).to_numpy(zero_copy_only=False) for c in ("n", "home", "guest"))
    labels = members.column("label").to_pylist()
    open_to = np.zeros((m, int(max(boxes.column("home").to_pylist())) + 1), bool)
    for child, label, least, most, small, large in zip(*(boxes.column(c).to_pylist() for c in ("home", "label", "least", "most", "n_least", "n_most")), strict=True):
        near = ((low - np.array(most) <= reach) & (np.array(least) - high <= reach)).all(axis=1)
        near &= (100 * n >= PERCENT * small) & (PERCENT * n <= 100 * large)
        if label is not None:
            near &= np.array([x != label for x in labels], bool)
        open_to[:, child] |= near
    # At home if any box is near; elsewhere as a guest, where the region comes later (pairs need to meet once only).
    at = np.arange(open_to.shape[1])
    place = open_to & (guest[:, None] | (at > home[:, None]))
    rows, children = np.nonzero(place)
    stay = np.flatnonzero(open_to.any(axis=1) & ~guest)
    take = np.concatenate([stay, rows])
    return pa.table({
        "child": pa.array(np.concatenate([home[stay], children]), pa.int32()), "key": members.column("key").take(take), "n": members.column("n").take(take),
        "guest": pa.array(np.concatenate([np.zeros(len(stay), bool), np.ones(len(rows), bool)])), "label": members.column("label").take(take), "region": members.column("region").take(take),
    })


def _weights(regions: DataFrame) -> DataFrame:
    return regions.groupBy("region").agg(F.sum(F.col("n") + 256).alias("weight"), F.count(F.lit(1)).alias("rows"), F.sum(F.when(F.col("guest"), 0).otherwise(1)).alias("homes"))


def voronoi(regions: DataFrame, sets: DataFrame, cell: int = CELL, pivots: int = PIVOTS, levels: int = LEVELS) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Cuts regions (_REGION) that are over `cell` until tasks can hold them: (small regions, regions that pivots don't part, links found on the way)."""
    pick = lambda df, keys: df.join(F.broadcast(keys) if fits(keys, 1_000_000) else keys, "region")
    small, stuck, links = [], [], []
    for level in range(levels):
        weights = written(_weights(regions).withColumn("parts", F.ceil(F.col("weight") / cell).cast("int")).select("region", "weight", "parts"), "weights")
        salted = pick(regions, weights.select("region", "parts")).withColumn("salt", F.pmod(F.xxhash64("key", F.lit(level)), F.col("parts")).cast("int"))
        own = sets.select("key", "members").join(salted, "key").select("region", "salt", "key", "n", "guest", "label", "members")
        # One pivot of each of so many hashes, of those at home; every part of a region gets them all.
        drawn = regions.where("NOT guest").groupBy("region", F.pmod(F.xxhash64("key", F.lit(level + 100)), F.lit(pivots)).alias("b")).agg(F.min_by(F.struct("key", "n"), F.xxhash64("key", F.lit(level))).alias("p"))
        drawn = written(sets.select("key", "members").join(drawn.select("region", "p.key", "p.n"), "key"), "pivots")
        dealt = pick(drawn, weights.select("region", "parts")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        in_order = lambda left, right: _place(left, right.sort_by("key"))
        placed = written(own.groupBy("region", "salt").cogroup(dealt.select("region", "salt", "key", "n", "members").groupBy("region", "salt")).applyInArrow(in_order, _PLACED), "placed")
        links.append(placed.where(F.size("pivots") > 0).select(F.col("key").alias("a"), F.explode(F.arrays_zip("pivots", "states")).alias("p")).select("a", F.col("p.pivots").alias("b"), F.col("p.states").alias("state")))
        sides = [f(F.get(F.col(c), F.lit(q))).alias(f"{c}_{q}") for c, f in (("low", F.min), ("high", F.max)) for q in range(pivots)]
        boxes = placed.where("NOT guest").groupBy("region", "home", "label").agg(*sides, F.min("n").alias("n_least"), F.max("n").alias("n_most"))
        listed = lambda c: F.filter(F.array(*[F.col(f"{c}_{q}") for q in range(pivots)]), lambda x: x.isNotNull())
        boxes = written(boxes.select("region", "home", "label", listed("low").alias("least"), listed("high").alias("most"), "n_least", "n_most"), "boxes")
        dealt = pick(boxes, weights.select("region", "parts")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        inside = placed.select("region", "salt", "key", "n", "guest", "label", "home", "low", "high").groupBy("region", "salt").cogroup(dealt.groupBy("region", "salt")).applyInArrow(_replicate, "child int, key long, n int, guest boolean, label long, region long")
        inside = written(inside.withColumn("parent", F.col("region")).withColumn("region", F.xxhash64("region", "child", F.lit(level))), "regions")
        told = _weights(inside).join(inside.groupBy("region").agg(F.first("parent").alias("parent")), "region").where("rows > 1 AND homes > 0")
        told = told.join(weights.select(F.col("region").alias("parent"), F.col("weight").alias("above")), "parent")
        told = written(told.select("region", F.when(F.col("weight") <= cell, "small").when(F.col("weight") > 0.7 * F.col("above"), "stuck").otherwise("large").alias("what")), "told")
        with_what = pick(inside, told).select("region", "key", "n", "guest", "label", "what")
        small.append(with_what.where("what = 'small'").drop("what"))
        stuck.append(with_what.where("what = 'stuck'").drop("what"))
        regions = written(with_what.where("what = 'large'").drop("what"), "regions")
        if regions.isEmpty():
            break
    union = lambda frames: reduce(DataFrame.unionByName, frames)
    return union(small), union([*stuck, regions]), links


def in_blocks(regions: DataFrame, cell: int) -> DataFrame:
    """Regions that are too large for a task as pairs of blocks, each a task: (cell, i, j, key, n, label, guest, block)."""
    parts = _weights(regions).select("region", F.ceil(2 * F.col("weight") / cell).cast("int").alias("parts"))
    placed = written(regions.join(parts, "region").withColumn("block", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int") + 1), "blocks")
    # A block meets each block of its region: as i those from it on, as j those before it.
    others = F.explode(F.sequence(F.lit(1), F.col("parts")))
    return placed.withColumn("other", others).select(F.col("region").alias("cell"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "key", "n", "label", "guest", "block")


def _with_sets(members: DataFrame, sets: DataFrame, column: str, small: int = 1_000_000) -> DataFrame:
    """members joined with a column of their sets; members are broadcast if they are few (counted), for the sets are large."""
    few = F.broadcast(members) if members.count() <= small else members
    return sets.select("key", column).join(few, "key")


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, root) of all nodes of the links (two columns of longs), by union and find."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for batch in batches:
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for node in (x, y):
                root.setdefault(node, node)
            p, q = find(x), find(y)
            root[max(p, q)] = min(p, q)
    keys = list(root)
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([find(k) for k in keys], pa.int64())], names=["key", "root"])


def components(links: DataFrame, a: str = "a", b: str = "b", few: int = FEW_LINKS) -> DataFrame:
    """(key, root) for every node of the links: root is the smallest node that it reaches.

    Up to `few` links, which are counted first, by one task; more by large-star and small-star rounds.
    """
    if links.count() <= few:
        return links.select(a, b).coalesce(1).mapInArrow(_united, "key long, root long")
    edges = written(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        fresh = written(small, "edges")
        now = fresh.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        dropped(edges)
        edges = fresh
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("key"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("key"), F.col("v").alias("root"))).groupBy("key").agg(F.min("root").alias("root"))


def members_of(led: DataFrame, paired: int = PAIRED) -> DataFrame:
    """(cell, key, n): each class once in each of its cells. led: token, cell, key, n of leading shingles.

    Sets that link share SHARED leading shingles at least. If one of them has a cell, or more than `paired` rows, they meet in
    its cell; else all have few rows, and the pair is found SHARED times among the pairs of these. Copies that are
    counted twice only bring more pairs.
    """
    token = Window.partitionBy("token").orderBy("key")
    every = token.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    led = led.withColumn("pivot", F.min("key").over(every)).withColumn("last", F.max("key").over(every)).withColumn("rows", F.count(F.lit(1)).over(every))
    led = led.where("cell IS NOT NULL OR pivot != last")
    before = F.array(*[F.struct(F.lag("key", i).over(token).alias("cell"), F.lag("n", i).over(token).alias("size"), F.lit(1).alias("times")) for i in range(1, paired)])
    alone = F.array(F.struct(F.coalesce("cell", "pivot").alias("cell"), F.lit(None).cast("int").alias("size"), F.lit(SHARED).alias("times")))
    is_pair = F.col("cell").isNull() & (F.col("rows") <= paired)
    led = led.withColumn("before", before).select("key", "n", F.explode(F.when(is_pair, F.filter("before", lambda x: x["cell"] != F.col("key"))).otherwise(alone)).alias("at"))
    found = written(led.groupBy("at.cell", "key").agg(F.max("n").alias("n"), F.max("at.size").alias("size"), F.sum("at.times").alias("times")).where(F.col("times") >= SHARED), "met")
    both = found.select("cell", "key", "n").unionByName(found.where("size IS NOT NULL").select("cell", F.col("cell").alias("key"), F.col("size").alias("n")))
    return both.groupBy("cell", "key").agg(F.max("n").alias("n"))


def class_links(docs: DataFrame, surveyed: DataFrame, heavy: int = HEAVY, cell: int = CELL, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(links, roots): links (a, b) that connect classes, and the component of every linked class."""
    classes = surveyed.where("kind = 0 AND key IS NOT NULL").groupBy("key").agg(F.min("row").alias("doc"))
    top = surveyed.where("kind = 1").groupBy("key").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "key").limit(heavy).toArrow()
    tokens = np.array(top.column("key").to_pylist(), np.int64).view(np.uint64)
    counts = np.array(top.column("n").to_pylist(), np.float64)
    order = np.argsort(tokens)
    tokens, counts = tokens[order], counts[order]
    ranks = (4 * np.log2(np.maximum(counts, 2))).astype(np.int16)
    often, cells = tokens[counts >= hot], None
    if len(often):
        # The pivots of hot shingles, at most `heavy`: least keys, made in each partition first.
        least = prefixes(docs, tokens, ranks, often, text_col=text_col).groupBy("token").agg(F.min("key").alias("cell"), F.max("key").alias("last")).where("cell != last").toArrow()
        named = np.array(least.column("token").to_pylist(), np.int64).view(np.uint64)
        by = np.argsort(named)
        cells = named[by], np.array(least.column("cell").to_pylist(), np.int64)[by]

    # Shingles that aren't hot have at most `hot` rows, two of each slice, or one of `heavy` of all, so a window takes them.
    led = prefixes(docs, tokens, ranks, often, cells, text_col) if cells is not None else prefixes(docs, tokens, ranks, text_col=text_col)
    members = written(members_of(led), "cells")
    sets = sets_of(docs, classes, members.select("key").distinct(), id_col=id_col, text_col=text_col)
    large = written(members.groupBy("cell").agg(F.sum(F.col("n") + 256).alias("weight")).where(F.col("weight") > cell).select("cell"), "large")

    # Of cells for one task, members that have someone of a like size, by the nearest sizes; then those whose sketches come near another's.
    zero, nothing = F.lit(0), F.lit(None).cast("long")
    sizes = Window.partitionBy("cell").orderBy("n")
    near = lambda m: F.coalesce(100 * F.least("n", m) >= PERCENT * F.greatest("n", m), F.lit(False))
    alike = members.join(large, "cell", "left_anti").withColumn("before", F.lag("n").over(sizes)).withColumn("after", F.lead("n").over(sizes)).where(near(F.col("before")) | near(F.col("after")))
    small_cells = written(alike.select("cell", zero.alias("i"), zero.alias("j"), "key", "n"), "alike")
    plain = narrowed(_with_sets(small_cells, sets, "sketch")).select("cell", zero.alias("i"), zero.alias("j"), "key", "n", nothing.alias("label"), F.lit(False).alias("guest"), zero.alias("block"))
    links = []
    if not large.isEmpty():
        regions = written(members.join(large, "cell", "left_semi").select(F.col("cell").alias("region"), "key", "n", F.lit(False).alias("guest"), nothing.alias("label")), "regions")
        small, stuck, links = voronoi(regions, sets, cell)
        plain = plain.unionByName(small.select(F.col("region").alias("cell"), zero.alias("i"), zero.alias("j"), "key", "n", "label", "guest", zero.alias("block")))
        stuck = written(stuck, "stuck")
        if not stuck.isEmpty():
            plain = plain.unionByName(in_blocks(stuck, cell))
    plain = written(plain, "tasks")
    found = written(joined(_with_sets(plain, sets, "members")), "links")
    found = written(reduce(DataFrame.unionByName, [found, *links]), "links") if links else found
    undecided, links = found.where("state = 1").select("a", "b"), found.where("state = 2").select("a", "b")
    roots = written(components(links), "roots")
    # What is undecided, and would join components, by all 64 bits of each member.
    sides = undecided
    for side in ("a", "b"):
        sides = sides.join(roots.select(F.col("key").alias(side), F.col("root").alias(f"_{side}")), side, "left").withColumn(f"_{side}", F.coalesce(f"_{side}", side))
    open_pairs = written(sides.where("_a != _b").select("a", "b").distinct(), "undecided")
    if not open_pairs.isEmpty():
        exact = sets_of(docs, classes, open_pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), exact=True, id_col=id_col, text_col=text_col)
        links = links.unionByName(written(_links_of(_two_sets(open_pairs, exact, "members")), "exact"))
        roots = written(components(links), "roots")
    dropped(members, sets, large, small_cells, plain, open_pairs)
    return links, roots


def _rooted(docs: DataFrame, id_col: str, text_col: str, options: dict) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): id, row, n, key of every document, and key, root of every class."""
    surveyed = written(survey(docs, id_col=id_col, text_col=text_col), "survey")
    _, roots = class_links(docs, surveyed, id_col=id_col, text_col=text_col, **options)
    rows = surveyed.where("kind = 0").select("id", "row", "n", "key")
    return rows, rows.where("key IS NOT NULL").select("key").distinct().join(roots, "key", "left").select("key", F.coalesce("root", "key").alias("root"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per document: id, n_shingles, component_id (the smallest id that links reach)."""
    rows, classes = _rooted(docs, id_col, text_col, options)
    least = rows.where("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("least"))
    rooted = classes.join(least, "key")
    # One row per class, of two longs and an id.
    named = written(rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("key", "component_id"), "named")
    full = joined_once(rows.where("key IS NOT NULL"), named, "key").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
    empty = rows.where("key IS NULL").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    return full.unionByName(empty)


def kept(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, of the smallest id (one without an id only where none has one), with all columns of docs.

    Documents that share an id but don't link all stay, and so do those without words, which link with nothing.
    """
    rows, classes = _rooted(docs, id_col, text_col, {})
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    best = rows.where("key IS NOT NULL").groupBy("key").agg(F.min(rank).alias("best"), F.count(F.lit(1)).alias("times"))
    rooted = classes.join(best, "key").groupBy("root").agg(F.min("best").alias("best"), F.sum("times").alias("times"))
    stay = rooted.select(F.col("best.row").alias("_row"), (F.col("times") > 1).alias("_several")).unionByName(rows.where("key IS NULL").select(F.col("row").alias("_row"), F.lit(False).alias("_several")).distinct())
    stay = written(stay, "stay")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_docs"), _row(id_col, text_col).alias("_row"))
    own = keyed.join(stay, "_row")
    # The row that stays may itself be there several times, equal in id and text.
    again = rows.where("key IS NOT NULL").groupBy("row").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("row").alias("_row"))
    again = written(again.join(stay, "_row", "left_semi"), "again")
    if not again.isEmpty():
        often = F.broadcast(again) if fits(again, 1_000_000) else again
        once = own.join(often, "_row", "left_semi").groupBy("_row").agg(F.first("_docs").alias("_docs")).select("_docs")
        return own.join(often, "_row", "left_anti").select("_docs").unionByName(once).select("_docs.*")
    return own.select("_docs.*")
