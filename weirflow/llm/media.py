"""Media columns: what a binary column really holds, found by signature sniffing.

An Aho-Corasick automaton over the magic bytes of the known formats runs once
over each blob. Every hit is handed to the format's validator, which walks the
structure (chunks, lengths, checksums, sample data) and gives the exact length of
the medium or rejects the hit. Valid media are carved greedily from the left,
outermost first; a medium at offset 0 that fills the blob corrects the declared
type, others are embedded. Text that merely contains magic bytes is rejected.

Formats: PNG, WAV, BMP, GIF, PGM (P5). A null blob
counts as empty and holds nothing; an empty table gives no rows; ties cannot
occur, as two formats never start with the same bytes. Other columns pass by.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm.common import ship, strings, text_of

#: Magic bytes by format, and the type that each format stands for.
PNG, WAV, BMP, GIF87, GIF89, PGM = b"\x89PNG\r\n\x1a\n", b"RIFF", b"BM", b"GIF87a", b"GIF89a", b"P5\n"
TYPES = {"png": "image/png", "wav": "audio/wav", "bmp": "image/bmp", "gif": "image/gif", "pgm": "image/x-portable-graymap"}


@dataclass(frozen=True)
class Medium:
    kind: str
    offset: int
    length: int
    detail: str


def _png(blob: bytes, at: int) -> tuple[int, str] | None:
    i, head, data, ended = at + 8, None, 0, False
    while i + 12 <= len(blob):
        size, kind = struct.unpack_from(">I4s", blob, i)
        if i + 12 + size > len(blob) or zlib.crc32(blob[i + 4 : i + 8 + size]) != struct.unpack_from(">I", blob, i + 8 + size)[0]:
            return None
        if head is None:
            if kind != b"IHDR" or size != 13:
                return None
            head = struct.unpack_from(">IIBBBBB", blob, i + 8)
        data += size * (kind == b"IDAT")
        i += 12 + size
        if kind == b"IEND":
            ended = size == 0
            break
    if not ended or not data or not head or not head[0] or not head[1]:
        return None
    return i - at, f"{head[0]}x{head[1]}x{head[2]}"


def _wav(blob: bytes, at: int) -> tuple[int, str] | None:
    if at + 12 > len(blob) or blob[at + 8 : at + 12] != b"WAVE":
        return None
    end = at + 8 + struct.unpack_from("<I", blob, at + 4)[0]
    if end > len(blob):
        return None
    i, form, data = at + 12, None, None
    while i + 8 <= end:
        kind, size = struct.unpack_from("<4sI", blob, i)
        if i + 8 + size > end:
            return None
        if kind == b"fmt " and size >= 16:
            form = struct.unpack_from("<HHIIHH", blob, i + 8)
        if kind == b"data":
            data = size
        i += 8 + size + size % 2
    if not form or data is None or form[4] != form[1] * form[5] // 8 or form[3] != form[2] * form[4] or data % max(1, form[4]):
        return None
    return end - at, f"{form[1]}ch{form[2]}Hz{form[5]}bit{data}"


def _bmp(blob: bytes, at: int) -> tuple[int, str] | None:
    if at + 54 > len(blob):
        return None
    size, _, start, head, width, height, planes, bits = struct.unpack_from("<IIIIiiHH", blob, at + 2)
    if head < 40 or planes != 1 or bits not in (1, 4, 8, 24, 32) or width <= 0 or height == 0 or at + size > len(blob):
        return None
    if start + (width * bits + 31) // 32 * 4 * abs(height) != size:
        return None
    return size, f"{width}x{abs(height)}x{bits}"


def _gif(blob: bytes, at: int) -> tuple[int, str] | None:
    if at + 13 > len(blob):
        return None
    width, height, flags = struct.unpack_from("<HHB", blob, at + 6)
    i = at + 13 + (3 << (flags & 7) + 1 if flags & 128 else 0)

    def blocks(i: int) -> int | None:
        while i < len(blob):
            if not blob[i]:
                return i + 1
            i += blob[i] + 1
        return None

    while i is not None and i < len(blob):
        mark = blob[i]
        if mark == 0x3B:
            return (i + 1 - at, f"{width}x{height}") if width and height else None
        if mark == 0x21:
            i = blocks(i + 2)
        elif mark == 0x2C and i + 10 < len(blob):
            own = blob[i + 9]
            i = blocks(i + 11 + (3 << (own & 7) + 1 if own & 128 else 0))
        else:
            return None
    return None


def _pgm(blob: bytes, at: int) -> tuple[int, str] | None:
    parts = blob[at : at + 64].split(b"\n", 3)
    if len(parts) < 4 or not all(x.isdigit() for x in parts[1].split(b" ")) or parts[1].count(b" ") != 1 or parts[2] != b"255":
        return None
    width, height = map(int, parts[1].split(b" "))
    start = sum(len(p) + 1 for p in parts[:3])
    if not width or not height or at + start + width * height > len(blob):
        return None
    return start + width * height, f"{width}x{height}"


VALIDATORS: dict[bytes, tuple[str, Callable[[bytes, int], tuple[int, str] | None]]] = {PNG: ("png", _png), WAV: ("wav", _wav), BMP: ("bmp", _bmp), GIF87: ("gif", _gif), GIF89: ("gif", _gif), PGM: ("pgm", _pgm)}


class Sniffer:
    def __init__(self) -> None:
        import ahocorasick

        self._automaton = ahocorasick.Automaton()
        for magic in VALIDATORS:
            self._automaton.add_word(magic.decode("latin-1"), magic)
        self._automaton.make_automaton()

    def find(self, blob: bytes) -> list[Medium]:
        """Valid media from left to right; what lies inside one of them is part of it."""
        out: list[Medium] = []
        clear = 0
        for end, magic in self._automaton.iter(blob.decode("latin-1")):
            at = end + 1 - len(magic)
            if at < clear:
                continue
            kind, valid = VALIDATORS[magic]
            if found := valid(blob, at):
                out.append(Medium(kind, at, *found))
                clear = at + found[0]
        return out


def png_gray(samples: bytes, width: int) -> bytes:
    """8-bit grey samples as a PNG of that width, rows unfiltered."""
    rows = len(samples) // width
    flat = bytearray()
    for r in range(rows):
        flat += b"\0" + samples[r * width : (r + 1) * width]

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", width, rows, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(bytes(flat), 1)) + chunk(b"IEND", b"")


def wav_bytes(samples: bytes, rate: int = 8000) -> bytes:
    """8-bit mono samples as a WAV."""
    pad = b"\0" * (len(samples) % 2)
    body = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(samples)) + samples + pad
    return b"RIFF" + struct.pack("<I", len(body)) + body


def samples_of(kind: str, blob: bytes) -> bytes:
    """The 8-bit samples of a stored PNG or WAV."""
    if kind == "wav":
        i = 12
        while blob[i : i + 4] != b"data":
            i += 8 + (n := struct.unpack_from("<I", blob, i + 4)[0]) + n % 2
        return blob[i + 8 : i + 8 + struct.unpack_from("<I", blob, i + 4)[0]]
    if kind != "png":
        raise ValueError(f"no samples are read from {kind}")
    i, parts, width, bits, colour, woven = 8, [], 0, 0, 0, 0
    while True:
        size, name = struct.unpack_from(">I4s", blob, i)
        if name == b"IHDR":
            width, _, bits, colour, _, _, woven = struct.unpack_from(">IIBBBBB", blob, i + 8)
        elif name == b"IDAT":
            parts.append(blob[i + 8 : i + 8 + size])
        elif name == b"IEND":
            break
        i += 12 + size
    flat, out = zlib.decompress(b"".join(parts)), bytearray()
    if (bits, colour, woven) != (8, 0, 0) or any(flat[:: width + 1]):
        raise ValueError("only unfiltered, 8-bit grey rows are read")
    for r in range(0, len(flat), width + 1):
        out += flat[r + 1 : r + 1 + width]
    return bytes(out)


def sniff(df: DataFrame, blob_col: str, declared_col: str, id_col: str) -> DataFrame:
    """One row per medium found: id, declared, actual type, corrected (they differ), embedded, offset, length, detail, medium."""
    ship(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, declared string, actual string, corrected boolean, embedded boolean, offset long, length long, detail string, medium binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sniffer = Sniffer()
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                take, rows = [], []
                for i, (declared, blob) in enumerate(zip(strings(part.column(1)), part.column(2).to_pylist(), strict=True)):
                    for m in sniffer.find(blob or b""):
                        take.append(i)
                        rows.append((declared, TYPES[m.kind], declared != TYPES[m.kind], m.offset > 0 or m.length < len(blob), m.offset, m.length, m.detail, blob[m.offset : m.offset + m.length]))
                columns = zip(*rows, strict=True) if rows else [[]] * 8
                kinds = [pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(take, pa.int64())), *(pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True))], names=[id_col, "declared", "actual", "corrected", "embedded", "offset", "length", "detail", "medium"])

    return df.select(id_col, F.col(declared_col).cast("string").alias("declared"), F.col(blob_col).alias("blob")).mapInArrow(run, schema)


#: Payloads are padded by spaces to a positive multiple of this; it is also the width of images.
BLOCK = 192


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts as media inside containers: id, n_bytes, declared type (the wrong one), blob.

    The payload becomes a PNG if its number of blocks is even and a WAV if odd; a container header comes before it
    and a trailer after it, so that reading must find and carve the medium.
    """
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                sizes, declared, blobs = [], [], []
                for text in strings(part.column(1)):
                    raw = text.encode()
                    payload = raw + b" " * (max(1, -(-len(raw) // BLOCK)) * BLOCK - len(raw))
                    image = len(payload) // BLOCK % 2 == 0
                    sizes.append(len(raw))
                    declared.append(TYPES["wav" if image else "png"])
                    blobs.append(b"CONT" + struct.pack("<I", len(payload)) + (png_gray(payload, BLOCK) if image else wav_bytes(payload)) + b"TAIL")
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(declared), pa.array(blobs, pa.binary())], names=[id_col, "n_bytes", "declared", "blob"])

    return docs.select(F.col(id_col), text_of(text_col).alias("text")).mapInArrow(run, f"{id_col} {kind}, n_bytes long, declared string, blob binary")


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per carved medium: what its samples, read back from the stored bytes, come to. n_bytes is read off the id struct."""
    kind = found.schema[id_col].dataType["key"].dataType.simpleString()
    schema = f"{id_col} {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, declared string, actual string, corrected boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        kinds = {v: k for k, v in TYPES.items()}
        for batch in batches:
            rows = []
            for actual, detail, medium in zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("actual", "detail", "medium")), strict=True):
                samples = samples_of(kinds[actual], medium)
                x = np.frombuffer(samples, np.uint8)
                shares = np.bincount(x >> 5, minlength=8) * 1000 // len(x)
                rows.append((len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), len(medium), hashlib.sha256(medium).hexdigest(), f"{actual};{detail};mean={int(x.sum(dtype=np.int64)) * 1000 // len(x)};hist={','.join(map(str, shares))}"))
            key = batch.column(0)
            cols = zip(*rows, strict=True) if rows else [[]] * 6
            own = [pa.array(list(c), t) for c, t in zip(cols, [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()], strict=True)]
            rest = [batch.column(batch.schema.get_field_index(n)) for n in ("declared", "actual", "corrected")]
            yield pa.RecordBatch.from_arrays([key.field("key"), key.field("n"), *own, *rest], names=[x.split()[0] for x in schema.split(", ")])

    return found.mapInArrow(run, schema)


def stored_and_sniffed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts stored as media, sniffed, carved and read back; one row per document."""
    stored = store_texts(docs, id_col, text_col).select(F.struct(F.col(id_col).alias("key"), F.col("n_bytes").alias("n")).alias(id_col), "declared", "blob")
    return digests(sniff(stored, "blob", "declared", id_col), id_col)
