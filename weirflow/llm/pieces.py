"""SentencePiece encoding and decoding of merge-type (BPE) models, exactly.

Encoding by backtracking: at each position the longest piece that starts there
is tried (an Aho-Corasick automaton tells it for the positions that are reached),
shorter pieces, which begin it, follow. A piece may stand after its left neighbour only if the two
are compatible: re-merging their joined characters by the model's scores gives
back exactly these two. That is told without merging, by undoing the merges that made
the two, the latest first, as long as each came after those of its parts (looked
up piece by piece; others are re-merged): the two stay if no pair of pieces that met on the way
would have merged before one of them was used up. A bitfield keeps positions from which no continuation
was found, so that each is left at most once. A sequence whose neighbours are
all compatible is the one that merging the whole text gives.

Texts are cut at places that no piece crosses, which is proved on the loaded
vocabulary: before each word mark, and around characters that have no piece of
their own (they are spelled with byte pieces). Encodings of cuts are kept in
caches of bounded size, which forget what wasn't asked for lately. Runs of word marks, whose pieces all share one score, are
merged directly, left to right.

Nulls are encoded as empty texts; an empty text gives the end id alone. Texts may
be of any length. Other columns, of whatever name, are ignored by the query.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm.common import ship, strings, text_of, tidied

MARK = "▁"
#: Types of pieces in the model file.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protocol-buffer message; values: int, 4 or 8 bytes, or bytes."""
    i, n = 0, len(data)

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            byte = data[i]
            i += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while i < n:
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind)
        if size is None:
            size = varint()
        yield tag >> 3, data[i : i + size]
        i += size


class Recent:
    """Values by key, in two generations: as the newer reaches `most`, it becomes the older, and the one before is forgotten."""

    def __init__(self, most: int):
        self.most, self.new, self.old = most, {}, {}

    def get(self, key):
        """The value, None if it isn't kept."""
        found = self.new.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.new) >= self.most:
            self.new, self.old = {}, self.new
        self.new[key] = value


class PieceModel:
    """A merge-type model read from its file: encode(text) and decode(ids).

    cache: pairs of pieces in a generation; there are half as many words, and a quarter as many cuts.
    """

    def __init__(self, data: bytes, cache: int = 400_000):
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        self.scores: list[float] = []
        self.dummy_prefix, squeeze, escape, normalizer, self.end_id, kind_of_model = True, True, True, b"", 2, 1
        for number, value in _fields(data):
            if number == 1:
                own = dict(_fields(value))
                self.pieces.append(own[1].decode())
                self.scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                self.kinds.append(own.get(3, NORMAL))
            elif number == 2:
                own = dict(_fields(value))
                kind_of_model, self.end_id = own.get(3, 1), own.get(42, 2)
            elif number == 3:
                own = dict(_fields(value))
                normalizer, self.dummy_prefix, squeeze, escape = own.get(2, b""), bool(own.get(3, 1)), bool(own.get(4, 1)), bool(own.get(5, 1))
        if kind_of_model != 2 or normalizer or squeeze or not escape or set(self.kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("only merge-type models with identity normalisation are supported")
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] == NORMAL}
        self.unknown = self.kinds.index(UNKNOWN)
        self.bytes_ids = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.kinds[i] == BYTE}
        self.byte_of = {i: b for b, i in self.bytes_ids.items()}
        # What a piece decodes to; None: a byte, which is read with its neighbours.
        self._shown = [{UNKNOWN: " ⁇ ", CONTROL: "", BYTE: None}.get(k, p.replace(MARK, " ")) for p, k in zip(self.pieces, self.kinds, strict=True)]
        if any(MARK in p.lstrip(MARK) or (p.startswith(MARK * 2) and p.strip(MARK)) for p in self.ids):
            raise ValueError("a piece crosses the start of a word; texts can't be cut there")
        runs = [p for p in self.ids if len(p) > 1 and not p.strip(MARK)]
        low = max((self.scores[self.ids[p]] for p in runs), default=-1e9)
        if any(self.scores[i] <= low for p, i in self.ids.items() if len(p) > 1 and p not in runs):
            raise ValueError("runs of word marks must merge after everything else")
        self.chars = {p for p in self.ids if len(p) == 1}
        self._pairs, self._cuts, self._words = Recent(cache), Recent(cache // 4), Recent(cache // 2)
        self._whole: dict[int, bool] = {}
        # Order of merges, which is that of falling scores: by piece, and by id with -1 for characters, None where scores are shared.
        order = {x: k for k, x in enumerate(sorted({self.scores[i] for i in self.ids.values()}, reverse=True))}
        alone = Counter(self.scores[i] for p, i in self.ids.items() if len(p) > 1)
        self._rank = {p: order[self.scores[i]] for p, i in self.ids.items() if len(p) > 1}
        self._ranks: list[int | None] = [None] * len(self.pieces)
        for p, i in self.ids.items():
            if len(p) == 1:
                self._ranks[i] = -1
            elif alone[self.scores[i]] == 1:
                self._ranks[i] = self._rank[p]
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._decimal = list(map(str, range(len(self.pieces))))
        self._runs: dict[int, tuple[int, ...]] = {}
        import ahocorasick

        self._automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            if p not in runs:
                self._automaton.add_word(p, (len(p) - 1, i))
        self._automaton.make_automaton()
        # The pieces that a piece begins with, itself last, and their sizes.
        self._prefixes = {i: tuple((k, self.ids[p[:k]]) for k in range(1, len(p) + 1) if p[:k] in self.ids) for p, i in self.ids.items() if p not in runs}

    # -- merging -----------------------------------------------------------
    def merge(self, text: str, made: list[tuple[int, int]] | None = None) -> list[int]:
        """What merging the characters of a text gives: best score first, then leftmost. All characters have pieces. made: takes the pairs that merge, in turn."""
        parts: list[str | None] = list(text)
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < n:
                joined = parts[a] + parts[b]
                if (i := self.ids.get(joined)) is not None:
                    heapq.heappush(heap, (-self.scores[i], a, b, joined))

        for k in range(n - 1):
            offer(k, k + 1)
        while heap:
            _, a, b, joined = heapq.heappop(heap)
            if parts[a] is None or parts[b] is None or after[a] != b or len(parts[a]) + len(parts[b]) != len(joined):
                continue
            if made is not None:
                made.append((self.ids[parts[a]], self.ids[parts[b]]))
            parts[a], parts[b] = joined, None
            after[a] = after[b]
            if after[b] < n:
                before[after[b]] = a
            offer(before[a], a)
            offer(a, after[a])
        return [self.ids[p] for p in parts if p is not None]

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two pieces, side by side, stay as they are when re-merged."""
        key = left * len(self.pieces) + right
        found = self._pairs.new.get(key)
        if found is None and (found := self._pairs.get(key)) is None:
            found = self._stay(left, right)
            self._pairs.put(key, found)
        return found

    def _halved(self, piece: int) -> tuple[int, int] | None:
        """The two pieces whose merge made a piece that stands; None for characters, and where a merge on the way didn't come after those of its parts."""
        if piece not in self._halves:
            found, rank = None, self._ranks[piece]
            if rank is not None and rank >= 0 and self._stands(piece):
                made: list[tuple[int, int]] = []
                self.merge(self.pieces[piece], made)
                ranks = [self._ranks[half] for half in made[-1]]
                if None not in ranks and max(ranks) < rank and all(r < 0 or self._halved(half) for r, half in zip(ranks, made[-1], strict=True)):
                    found = made[-1]
            self._halves[piece] = found
        return self._halves[piece]

    def _stay(self, left: int, right: int) -> bool:
        """compatible(), not from the cache."""
        if not (self._stands(left) and self._stands(right)):
            return False
        ranks, rank, pieces, halves = self._ranks, self._rank, self.pieces, self._halves
        if any(ranks[p] != -1 and not self._halved(p) for p in (left, right)):
            return self.merge(pieces[left] + pieces[right]) == [left, right]
        # Both as they stood before `limit`: pieces side by side merge if their rank comes before the merge that used one of them up.
        limit = len(pieces)
        while True:
            if rank.get(pieces[left] + pieces[right], limit) < limit:
                return False
            a, b = ranks[left], ranks[right]
            if a > b:
                limit, left = a, halves[left][1]
            elif b >= 0:
                limit, right = b + 1, halves[right][0]  # of equal merges the left one comes first, and what stands left of this one too
            else:
                return True

    # -- encoding ----------------------------------------------------------
    def backtrack(self, text: str) -> tuple[int, ...]:
        """The encoding of a cut whose characters all have pieces."""
        n = len(text)
        # The longest piece by start, for starts that are reached. Every character has a piece, so that one match begins where another ends.
        longest = {end - back: piece for end, (back, piece) in self._automaton.iter_long(text)}
        prefixes, kept, size_of_ids = self._prefixes, self._pairs.new.get, len(self.pieces)
        failed: bytearray | None = None
        out: list[tuple[int, int, int]] = []  # (start, index in options, piece)
        at, last = 0, -1
        options = prefixes[longest[0]] if n else ()
        tries = len(options) - 1
        while at < n:
            placed = False
            while tries >= 0:
                size, piece = options[tries]
                end = at + size
                if failed is None or end >= n or not failed[end >> 3] >> (end & 7) & 1:
                    if last < 0:
                        fits = self._stands(piece)
                    else:
                        fits = kept(last * size_of_ids + piece)
                        if fits is None:
                            fits = self.compatible(last, piece)
                            kept = self._pairs.new.get
                    if fits:
                        out.append((at, tries, piece))
                        at, last, placed = end, piece, True
                        if at < n:
                            if at not in longest:
                                for end, (back, other) in self._automaton.iter_long(text, at):
                                    if end - back in longest:
                                        break
                                    longest[end - back] = other
                            options = prefixes[longest[at]]
                            tries = len(options) - 1
                        break
                tries -= 1
            if not placed:
                if not out:
                    return tuple(self.merge(text))
                if failed is None:
                    failed = bytearray(n // 8 + 1)
                failed[at >> 3] |= 1 << (at & 7)
                at, tries, _ = out.pop()
                last = out[-1][2] if out else -1
                options = prefixes[longest[at]]
                tries -= 1
        return tuple([p for _, _, p in out])

    def _stands(self, piece: int) -> bool:
        """Whether merging the piece's own characters gives the piece."""
        found = self._whole.get(piece)
        if found is None:
            found = self._whole[piece] = self.merge(self.pieces[piece]) == [piece]
        return found

    def _cut(self, text: str) -> tuple[int, ...]:
        found = self._cuts.new.get(text)
        if found is None and (found := self._cuts.get(text)) is None:
            found = self.backtrack(text)
            if len(text) <= 64:
                self._cuts.put(text, found)
        return found

    def _word(self, word: str) -> tuple[int, ...]:
        """A word with one mark before it, cut at characters without pieces."""
        text, chars = MARK + word, self.chars
        if chars.issuperset(text):
            return self._cut(text)
        out: list[int] = []
        start = 0
        for i, c in enumerate(text):
            if c not in chars:
                if start < i:
                    out += self._cut(text[start:i])
                if self.bytes_ids:
                    out += [self.bytes_ids[b] for b in c.encode()]
                elif not out or out[-1] != self.unknown:
                    out.append(self.unknown)
                start = i + 1
        if start < len(text):
            out += self._cut(text[start:])
        return tuple(out)

    def _run(self, n: int) -> tuple[int, ...]:
        """n word marks in a row."""
        found = self._runs.get(n)
        if found is None:
            found = tuple(self.merge(MARK * n))
            if n < 256:
                self._runs[n] = found
        return found

    def _spaced(self, empties: int, word: str) -> tuple[int, ...]:
        """Word marks, more than one, and a word."""
        if not word:
            return self._run(empties)
        own = self._word(word)
        if own[0] == self.ids.get(MARK):  # the last mark stays alone, so it joins the run
            return self._run(empties + 1) + own[1:]
        return self._run(empties) + own

    def _units(self, text: str) -> list[tuple[int, str]]:
        """(marks before the one that the word has, word)."""
        parts = text.replace(MARK, " ").split(" ")
        if not self.dummy_prefix:
            raise ValueError("models without the leading mark are not supported")
        out: list[tuple[int, str]] = []
        empties = 0
        for p in parts:
            if p:
                out.append((empties, p))
                empties = 0
            else:
                empties += 1
        if empties:
            out.append((empties, ""))
        return out

    def encode(self, text: str, end: bool = True) -> list[int]:
        """The ids of a text, the end id last."""
        out: list[int] = []
        if text:
            for empties, word in self._units(text):
                out += self._spaced(empties, word) if empties else self._word(word)
        return [*out, self.end_id] if end else out

    # -- decoding ----------------------------------------------------------
    def _plain(self, ids: tuple[int, ...] | list[int]) -> str:
        """The text of ids, marks as spaces, bytes joined to characters; the leading space stays."""
        shown = [self._shown[i] for i in ids]
        if None not in shown:
            return "".join(shown)
        out: list[str] = []
        pending = bytearray()

        def flush() -> None:
            if pending:
                out.append(_lenient(bytes(pending)))
                pending.clear()

        for i in ids:
            if (b := self.byte_of.get(i)) is not None:
                pending.append(b)
                continue
            flush()
            out.append(self._shown[i])
        flush()
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of a list of ids; the mark that encoding puts first is taken off."""
        first = next((i for i in ids if self.kinds[i] != CONTROL), None)
        text = self._plain(ids)
        return text[1:] if first is not None and self.kinds[first] == NORMAL and text.startswith(" ") else text

    # -- both, for whole texts ----------------------------------------------
    def _unit(self, empties: int, word: str) -> tuple[str, int, str]:
        ids = self._spaced(empties, word) if empties else self._word(word)
        return " ".join([self._decimal[i] for i in ids]), len(ids), self._plain(ids)

    def round_trip(self, text: str) -> tuple[int, str, str]:
        """(number of ids, ids in decimal joined by spaces, decoded text); no byte piece's character spans two cuts."""
        if not text:
            return 1, str(self.end_id), ""
        if MARK in text or "  " in text or text[0] == " " or text[-1] == " ":
            ids, sizes, plain = zip(*[self._unit(e, w) for e, w in self._units(text)], strict=True)
            decoded = "".join(plain)
            return sum(sizes) + 1, f"{' '.join(ids)} {self.end_id}", decoded[1:] if decoded[:1] == " " else decoded
        # Kept by word: its ids where they decode to the word with a space before it, else ids and decoded text.
        cache, asked = self._words, text.split(" ")
        found, odd = list(map(cache.new.get, asked)), {}
        for k in [k for k, x in enumerate(found) if type(x) is not str]:
            w = asked[k]
            x = cache.get(w)
            if x is None:
                x, _, plain = self._unit(0, w)
                if plain != " " + w:
                    x = x, plain
                if len(w) <= 48:
                    cache.put(w, x)
            if type(x) is not str:
                x, odd[k] = x
            found[k] = x
        joined, decoded = " ".join(found), text
        if odd:
            decoded = "".join([odd.get(k, " " + w) for k, w in enumerate(asked)])
            decoded = decoded[1:] if decoded[:1] == " " else decoded
        return joined.count(" ") + 2, f"{joined} {self.end_id}", decoded


def _lenient(data: bytes) -> str:
    """UTF-8, each byte that belongs to no character as U+FFFD."""
    try:
        return data.decode()
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(data):
            for n in (1, 2, 3, 4):
                try:
                    out.append(data[i : i + n].decode())
                    i += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                i += 1
        return "".join(out)


_LOADED: dict[str, PieceModel] = {}


def load(path: str) -> PieceModel:
    """The model of a file, kept by the Python worker for later tasks. The file is on every machine."""
    if path not in _LOADED:
        with open(path, "rb") as f:
            _LOADED[path] = PieceModel(f.read())
    return _LOADED[path]


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Per row: id, n_tokens, ids_sha256, decoded_sha256, and with_ids the ids and the decoded text."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path)
        sha = hashlib.sha256
        for batch in batches:
            counts, ids, texts, all_ids, decoded = [], [], [], [], []
            for text in strings(batch.column(1)):
                n, joined, plain = model.round_trip(text)
                counts.append(n)
                ids.append(sha(joined.encode()).hexdigest())
                texts.append(sha(plain.encode()).hexdigest())
                if with_ids:
                    all_ids.append([int(x) for x in joined.split()])
                    decoded.append(plain)
            columns = {id_col: batch.column(0), "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(ids, pa.string()), "decoded_sha256": pa.array(texts, pa.string())}
            if with_ids:
                columns |= {"ids": pa.array(all_ids, pa.list_(pa.int32())), "decoded": pa.array(decoded, pa.string())}
            yield pa.RecordBatch.from_pydict(columns)

    return docs.select(F.col(id_col), text_of(text_col).alias("text")).mapInArrow(tidied("pieces", run, _LOADED.clear), schema)
