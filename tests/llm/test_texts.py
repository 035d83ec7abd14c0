"""Chat formatting, media, pieces and decontamination."""

from __future__ import annotations

import hashlib
import random
import struct
from collections import Counter
import zlib
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm import cases
from weirflow.llm import chat, decontaminate, media, pieces
from weirflow.llm.queries import piece_model_path


# -- chat ---------------------------------------------------------------------------
CONTROL = chat.Codec(chat.CHAT).template.controls()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*CONTROL, "\\", "<", "[", "s>", "INST]", "a", "\n"]), max_size=12).map("".join), st.sampled_from(["user", "assistant", "system", "tool", "", "[ROLE]"]))
def test_turns_are_read_back(text, role):
    codec = chat.Codec(chat.CHAT)
    line = "".join(t for t, _ in codec.segments(role, text)) * 2
    once = codec.read(line)
    assert once[:2] == (role, text) and codec.read(line, once[2])[:2] == (role, text) and codec.read(line, once[2])[2] == len(line)
    assert not any(c in codec.escape(text) for c in CONTROL)


def test_ambiguous_templates_are_refused():
    with pytest.raises(ValueError):
        chat.Codec(chat.Template({"user": chat.Turn("<a>", "<a>x")}, chat.Turn("<b>", "</b>"), "<n>"))


def test_chat_rows(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (2, 0, "assistant", "x"), (1, 1, "assistant", None), (None, 0, None, "n"), (3, 0, "system", "s"), (3, 1, "user", "u"), (3, 2, "assistant", "äö<s>")]
    df = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, first int")
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(df)).collect()}
    assert got[1].n_turns == 3 and not got[1].in_order and got[3].in_order and not got[2].in_order
    assert got[3].turns_sha256 == hashlib.sha256("system\ns\nuser\nu\nassistant\näö<s>\n".encode()).hexdigest()
    assert (got[3].loss_chars, got[3].loss_sha256) == (5, hashlib.sha256("äö<s>".encode()).hexdigest())
    assert got[None].n_turns == 1 and got[1].loss_chars == 0
    assert chat.read_back(chat.format_turns(df.where("conv_id > 9"))).collect() == []


# -- media ----------------------------------------------------------------------------
def test_sniffer_rejects_and_carves():
    png, wav = media.png_gray(bytes(range(192)) * 2, 192), media.wav_bytes(b"abc")
    bmp = b"BM" + (54 + 8).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + (2).to_bytes(4, "little") + (2).to_bytes(4, "little") + (1).to_bytes(2, "little") + (8).to_bytes(2, "little") + bytes(24) + bytes(8)
    gif = b"GIF89a\x01\x00\x01\x00\x00\x00\x00,\x00\x00\x00\x00\x01\x00\x01\x00\x00\x02\x02D\x01\x00;"
    pgm = b"P5\n2 2\n255\nabcd"
    blob = b"RIFF BM GIF89a P5\n" + png + b"BMxx" + wav + bmp + gif + pgm + png[:-5]
    found = media.Sniffer().find(blob)
    assert [m.kind for m in found] == ["png", "wav", "bmp", "gif", "pgm"]
    assert [blob[m.offset : m.offset + m.length] for m in found] == [png, wav, bmp, gif, pgm]
    broken = bytearray(png)
    broken[40] ^= 1
    assert media.Sniffer().find(bytes(broken)) == [] and media.Sniffer().find(b"") == []


def test_declared_types_are_corrected(spark):
    png = media.png_gray(b" " * 192, 192)
    df = spark.createDataFrame([(1, "image/gif", bytearray(png)), (2, "image/png", bytearray(png)), (3, None, bytearray(b"--" + png)), (4, "x", None)], "id int, declared string, blob binary")
    got = {r.id: (r.corrected, r.embedded) for r in media.sniff(df, "blob", "declared", "id").collect()}
    assert got == {1: (True, False), 2: (False, False), 3: (True, True)}


@pytest.mark.parametrize("extra", [False, True])
def test_texts_survive_media(spark, extra):
    docs = cases.documents(spark, extra)
    got = sorted(((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in media.stored_and_sniffed(docs).collect()), key=repr)
    want = []
    for r in docs.collect():
        raw = (r.text or "").encode()
        full = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        want.append((r.doc_id, len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:])))
    assert got == sorted(want, key=repr)
    assert media.stored_and_sniffed(cases.empty(spark)).collect() == []


# -- pieces ---------------------------------------------------------------------------
@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=piece_model_path())


PARTS = ["a", "the", "in", "ing", " ", "  ", "   ", "\n", "é", "ß", "😀", "1", "99", ".", "###", "▁", "\x00", "日本", "\t", "</s>", "<0x0A>", "퟿", "aaaa", "==", "e", "t"]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=30).map("".join))
def test_pieces_as_the_library(library, text):
    model = pieces.load(piece_model_path())
    ids = library.encode(text, add_bos=False, add_eos=True)
    n, joined, plain = model.round_trip(text)
    assert model.encode(text) == ids and joined == " ".join(map(str, ids)) and n == len(ids)
    assert model.decode(ids) == plain == library.decode(ids)


def test_decoding_of_any_ids(library):
    model, rng = pieces.load(piece_model_path()), random.Random(4)
    for _ in range(300):
        ids = [rng.choice([0, 1, 2, 3 + rng.randrange(256), rng.randrange(32_000)]) for _ in range(rng.randint(0, 9))]
        assert model.decode(ids) == library.decode(ids), ids


def test_caches_forget_what_is_not_asked_for(library, monkeypatch):
    """Caches are bounded in memory (by rough bytes of an entry), words that come again and again stay, and ids are the same."""
    with open(piece_model_path(), "rb") as f:
        data = f.read()
    small, rng, made = pieces.PieceModel(data, cache=40), random.Random(6), Counter()
    unit = small._unit
    monkeypatch.setattr(small, "_unit", lambda e, w: made.update([w]) or unit(e, w))
    for _ in range(300):
        text = "often " + "".join(rng.choice("abcdeé") for _ in range(7))
        assert small.round_trip(text)[1] == " ".join(map(str, library.encode(text, add_bos=False, add_eos=True)))
    assert made["often"] == 1
    for kept in (small._words, small._cuts, small._pairs):
        assert 0 < len(kept.new) <= kept.most and len(kept.old) <= kept.most
    usual = pieces.PieceModel(data)
    assert 2 * (330 * usual._words.most + 250 * usual._cuts.most + 110 * usual._pairs.most) < 300e6


def test_pairs_are_told_without_merging(library, monkeypatch):
    """Only pieces themselves are merged, once for each use, whatever pairs come up; ids are the library's."""
    model, rng, merged = pieces.PieceModel(Path(piece_model_path()).read_bytes()), random.Random(8), Counter()
    merge = model.merge
    monkeypatch.setattr(model, "merge", lambda text, *made: merged.update([text]) or merge(text, *made))
    for _ in range(300):
        text = " ".join("".join(rng.choice(["th", "er", "in", "ou", "s", "e", ".", "é", "on"]) for _ in range(rng.randint(1, 9))) for _ in range(6))
        assert model.encode(text) == library.encode(text, add_bos=False, add_eos=True)
    assert merged and all(t in model.ids for t in merged) and max(merged.values()) <= 2


def test_pairs_of_any_scores():
    """Pairs and texts against merging, with shared scores and parts that merge after what they make."""
    field = lambda number, value: bytes([number << 3 | 2, len(value)]) + value
    for seed in range(60):
        rng = random.Random(seed)
        names = ["<unk>", "a", "b", "c", pieces.MARK, *{"".join(rng.choice("abc") for _ in range(rng.randint(2, 5))) for _ in range(16)}]
        scores = [-rng.randrange(12) if seed % 2 else -k for k in range(len(names))]
        if seed % 3 == 0:
            rng.shuffle(scores)
        own = [field(1, p.encode()) + b"\x15" + struct.pack("<f", s) + (b"\x18\x02" if p == "<unk>" else b"") for p, s in zip(names, scores, strict=True)]
        model = pieces.PieceModel(b"".join(field(1, x) for x in own) + field(2, b"\x18\x02") + field(3, b"\x20\x00"))
        for left in model.ids.values():
            for right in model.ids.values():
                assert model.compatible(left, right) == (model.merge(names[left] + names[right]) == [left, right]), (seed, names[left], names[right])
        for _ in range(60):
            text = "".join(rng.choice("abc") for _ in range(rng.randint(1, 12)))
            assert list(model.backtrack(text)) == model.merge(text), (seed, text)


@pytest.mark.parametrize("extra", [False, True])
def test_pieces_of_documents(spark, library, extra):
    docs = cases.documents(spark, extra)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in docs.collect():
        ids = library.encode(r.text or "", add_bos=False, add_eos=True)
        want.append((r.doc_id, len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids))))
    assert sorted(map(tuple, pieces.encode_documents(docs, piece_model_path()).collect()), key=repr) == sorted(want, key=repr)
    assert pieces.encode_documents(cases.empty(spark), piece_model_path()).collect() == []
    full = pieces.encode_documents(docs, piece_model_path(), with_ids=True).where("doc_id = 4").first()
    assert full.decoded == "one two three" and full.ids == library.encode("one two three", add_eos=True)


# -- decontamination --------------------------------------------------------------------
@settings(max_examples=100, deadline=None)
@given(st.binary(min_size=1, max_size=12), st.binary(max_size=30), st.integers(0, 12))
def test_myers_distance(pattern, text, most):
    found, best = decontaminate.myers(pattern, text, most), cases.edit_distance(pattern, text)
    # The empty stretch, which costs the whole pattern, has no end in the text.
    if best <= most and best < len(pattern):
        assert found and found[0] == best
    elif best > most:
        assert found is None


def test_matches_against_brute_force(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdeg") for _ in range(rng.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(20))) for i in range(6)] + [(6, None), (7, ""), (8, "short one"), (0, "again under an id that is taken " * 3)]
    docs = [(0, None), (1, ""), (2, items[0][1]), (2, items[0][1])]
    for k in range(60):
        text = list(items[k % 6][1])
        for _ in range(rng.randint(0, 14)):
            at = rng.randrange(len(text))
            text[at : at + rng.choice([0, 1])] = [rng.choice("abcdegxyz")] * rng.choice([0, 1])
        docs.append((10 + k, f"{word()} {word()}, {''.join(text).upper() if k % 2 else ''.join(text)}! {word()}"))
    docs += [(100, "It is a SHORT one."), (101, "short two")]
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, item_id int")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = []
    for doc_id, text in docs:
        for item_id, own in {i: t for i, t in enumerate(items)}.values():
            n = decontaminate.normal(own or "")
            budget = int(0.08 * len(n))
            if n and (best := cases.edit_distance(n, decontaminate.normal(text or ""))) <= budget:
                want.append((doc_id, item_id, best))
    got = sorted(map(tuple, decontaminate.matches(d, b).collect()))
    assert got == sorted(want) and len(want) > 30
    assert sorted(map(tuple, decontaminate.matches(d, b, block=150).collect())) == got
    gone = {w[0] for w in want}
    assert sorted(r.doc_id for r in decontaminate.clean(d, b).collect()) == sorted(i for i, _ in docs if i not in gone)
    assert {r.doc_id for r in decontaminate.contaminated(d, b).collect()} == gone
    assert decontaminate.matches(d, b.where("item_id > 99")).collect() == [] == decontaminate.matches(d.where("doc_id < 0"), b).collect()


def test_short_items_long_texts_and_null_ids(spark):
    b = spark.createDataFrame([(1, "what color is the sky above us today"), (2, "tiny one"), (None, "an item without an id of its own")], "item_id long, text string")
    rows = [(1, "Asked: what colour is the sky above us todey?"), (2, "what is the colour of this sky above all of us"), (3, "a tiny onf"), (4, "a tiny one"), (None, "What color is the sky above us today"), (6, "x " * 1_500_000 + "what color iss the sky above us today" + " y" * 1_500_000), (7, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id, r.distance) for r in decontaminate.matches(d, b).collect()}
    assert got == {(1, 1, 2), (4, 2, 0), (None, 1, 0), (6, 1, 1)}
    assert {(r.doc_id, r.item_id) for r in decontaminate.matches(d, b, exact_below=60).collect()} == {(4, 2), (None, 1)}
    assert sorted(r.doc_id for r in decontaminate.clean(d, b).collect()) == [2, 3, 7]
