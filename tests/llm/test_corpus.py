"""Repeats, near copies, PII, quality, language model and licenses."""

from __future__ import annotations

import hashlib
import math
import random
import re
import textwrap
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from tests.llm import cases
from weirflow.llm import common, jaccard, language_model, licenses, pii, quality, repeats

SF = "/root/testdata/sf0.001"


# -- repeats ---------------------------------------------------------------------------
def test_run_index_against_brute_force():
    rng = random.Random(3)
    for _ in range(150):
        length, letters = rng.choice([5, 12, 30, 60]), rng.choice([b"a", b"ab", b"abc", b"abcdefgh"])
        base = bytes(rng.choice(letters) for _ in range(rng.randint(1, 150)))
        texts = []
        for _ in range(rng.randint(1, 8)):
            t = bytearray(base * rng.randint(1, 3))
            for _ in range(rng.randint(0, 4)):
                t[rng.randrange(len(t))] = rng.choice(b"abxyz\x00")
            texts.append(bytes(t)[rng.randint(0, 5) :])
        seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
        want = [[i for i in range(len(t) - length + 1) if seen[t[i : i + length]] > 1] for t in texts]
        assert [x.tolist() for x in repeats.repeated_starts(texts, length)] == want
    index = repeats.RunIndex.build(np.frombuffer(b"abcd" * 200, np.uint8), np.array([400, 800]))
    assert len(index.heads) < 20  # runs, not characters


def check_repeats(docs, **options):
    rows = docs.collect()
    gone = cases.repeats([(r.text or "").encode() for r in rows], 400)
    want = []
    for r, g in zip(rows, gone, strict=True):
        data = (r.text or "").encode()
        kept = bytes(b for b, x in zip(data, g, strict=True) if not x)
        spans = sum(x and not y for x, y in zip(g, [False, *g], strict=False))
        want.append((r.doc_id, len(data), sum(g), spans, hashlib.sha256(kept).hexdigest()))
    assert sorted(map(tuple, repeats.removed(docs, **options).collect()), key=repr) == sorted(want, key=repr)
    return sum(w[2] for w in want)


@pytest.mark.parametrize("options", [{}, {"group_bytes": 700}])
def test_repeats_of_documents(spark, options):
    assert check_repeats(cases.documents(spark, extra=bool(options)), **options) > 3000


def test_hot_anchor_is_split(spark):
    rng = random.Random(8)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    hot = noise(300)
    long = noise(900)
    texts = [noise(300) + hot + noise(300) for _ in range(20)] + [noise(200) + hot + long[:250], noise(150) + hot + long[:320], noise(99) + long, long[50:700]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert check_repeats(docs, group_bytes=2000) > 1000
    assert repeats.removed(cases.empty(spark)).collect() == []


# -- near copies -------------------------------------------------------------------------
@pytest.mark.parametrize("options", [{}, {"cell": 900, "heavy": 300, "hot": 3}])
def test_components_of_documents(spark, options):
    docs = cases.documents(spark, extra=bool(options)).where("doc_id is not null")
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: r[0])
    want = {}
    for (doc_id, text), c in zip(rows, cases.components([t for _, t in rows]), strict=True):
        want[doc_id] = (len(cases.shingles(text)), rows[c][0])
    got = jaccard.near_copies(docs, **options).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_dense_families(spark):
    """Families whose members link in chains, and many sets that share common shingles but don't link."""
    rng = random.Random(2)
    common = [f"c{i}" for i in range(60)]
    texts = []
    for f in range(6):
        base = [f"f{f}w{i}" for i in range(80)]
        for k in range(14):
            own = list(base)
            for i in range(k):
                own[5 * i : 5 * i + 1] = [f"f{f}x{i}"]
            texts.append(" ".join(own))
    texts += [" ".join([f"u{i}n{j}" for j in range(rng.randint(10, 60))] + common + [f"v{i}n{j}" for j in range(rng.randint(10, 60))]) for i in range(40)]
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = dict(enumerate(cases.components(texts)))
    for options in ({}, {"cell": 3000, "heavy": 5}, {"cell": 6000, "hot": 3}):
        assert {r.doc_id: r.component_id for r in jaccard.near_copies(docs, **options).collect()} == want


def test_shingles_shared_by_chance_send_no_sets(spark, monkeypatch):
    """Texts that share one or two leading shingles with others, none of which links: sets of near copies only are sent."""
    words = lambda a, n: [f"{a}w{i}" for i in range(n)]
    passages = [words(f"p{i}", 5 + i % 2) for i in range(30)]
    texts = [" ".join([*words(f"d{i}", 6), *passages[i], *words(f"e{i}", 4), *passages[(i + 1) % 30]]) for i in range(30)]
    base = words("near", 60)
    texts += [" ".join(base), " ".join([*base[3:], "tail"])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sent, sets_of = [], jaccard.sets_of
    monkeypatch.setattr(jaccard, "sets_of", lambda *args, **more: sent.append(args[2].count()) or sets_of(*args, **more))
    got = {r.doc_id: r.component_id for r in jaccard.near_copies(docs).collect()}
    assert got == dict(enumerate(cases.components(texts))) and got[31] == 30
    assert sent == [2]


def test_shuffle_files_go_with_the_write(spark):
    """What a written table was shuffled by isn't kept on disk."""
    cleaning = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, disk = spark.conf.get(cleaning, "false"), spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: {x.rpartition("/")[2] for x in disk.getAllFiles().mkString("\n").split("\n") if "shuffle_" in x}
    old = held()
    df = common.written(spark.range(5000).groupBy((F.col("id") % 97).alias("k")).count(), "probe")
    for _ in range(50):
        if not held() - old:
            break
        time.sleep(0.2)
    assert not held() - old and df.count() == 97 and spark.conf.get(cleaning, "false") == before


def test_kept_documents(spark):
    docs = cases.documents(spark, extra=True)
    kept = jaccard.kept(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(9) == 1 and 10 not in ids and 11 not in ids and 0 in ids and ids.count(None) == 1 and ids.count(8) == 1
    assert jaccard.near_copies(cases.empty(spark)).collect() == []


def test_rows_that_share_an_id_or_have_none(spark):
    words = lambda a: " ".join(f"{a}{i}" for i in range(60))
    chain = words("c").split()
    a, b, c = " ".join(chain), " ".join(chain[8:]), " ".join([*chain[8:], *[f"t{i}" for i in range(9)]])
    rows = [(1, a), (None, b), (2, c), (7, words("x")), (7, words("y")), (7, words("y")), (None, words("z")), (None, None), (9, words("y"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id) for r in jaccard.near_copies(docs).collect() if r.doc_id is not None)
    sets = [cases.shingles(t) for t in (a, b, c)]
    assert [100 * len(x & y) >= 75 * len(x | y) for x, y in ((sets[0], sets[1]), (sets[1], sets[2]), (sets[0], sets[2]))] == [True, True, False]
    assert got == [(1, 1), (2, 1), (7, 7), (7, 7), (7, 7), (9, 7)]
    stay = sorted(((r.doc_id, r.text) for r in jaccard.kept(docs).collect()), key=repr)
    assert stay == sorted([(1, a), (7, words("x")), (7, words("y")), (None, words("z")), (None, None)], key=repr)


def test_voronoi_regions_lose_no_link(spark):
    """A hot group of near copies around one text, with outliers that link to some of them only, in regions much larger than a task's."""
    rng = random.Random(12)
    base = [f"b{i}" for i in range(70)]
    texts = []
    for _ in range(160):
        own = list(base)
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(70)] = f"r{rng.randrange(10_000)}"
        texts.append(" ".join(own))
    for k in range(60):
        texts.append(" ".join([f"q{k}w{i}" for i in range(rng.randint(20, 50))] + base[:25]))
    want = dict(enumerate(cases.components(texts)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for options in ({"cell": 8000, "hot": 20}, {"cell": 2500, "hot": 1000}):
        assert {r.doc_id: r.component_id for r in jaccard.near_copies(docs, **options).collect()} == want
    assert 5 < len(set(want.values())) < 200


def test_spare_of_collisions():
    rng = np.random.default_rng(3)
    for k in (200, 20_000, 400_000):
        x = rng.integers(0, 1 << 63, k, np.uint64)
        hidden = k - len(np.unique(x >> np.uint64(32) & np.uint64(0x7FFFFFFF)))
        assert 2 * hidden <= jaccard.spare(k * 2**0.5)


# -- PII ------------------------------------------------------------------------------------
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple]:
    out = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and max(map(int, m[0].split("."))) > 255 or kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def check_pii(docs):
    for r in docs.join(pii.found(docs).withColumnRenamed("doc_id", "d"), F.col("doc_id").eqNullSafe(F.col("d"))).dropDuplicates(["doc_id"]).where("doc_id is not null").collect():
        spans = base_spans(r.text or "")
        listed = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest(), (r.doc_id, listed, r.spans)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[3] == k for s in spans) for k in PATTERNS)
        assert {x for x in listed.split(",") if x} <= set(r.spans.split(","))


def test_base_spans(spark):
    check_pii(cases.documents(spark))
    rng = random.Random(5)
    parts = ["a", "b.c", "@", ".", "_", "-", " ", "1", "23", "255", "256", "4111111111111111", "+", "+49", "(", ")", "é", "😀", "x@y.de", "10.0.0.1", "79927398713", "%", "\n"]
    texts = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(1, 40)))) for i in range(1500)]
    texts += [(9000, "a" * 50_000), (9001, "1" * 50_000), (9002, "a@b" + ".c" * 20_000), (9003, "+1" + "(" * 20_000), (9004, "1 " * 20_000)]
    check_pii(spark.createDataFrame(texts, "doc_id long, text string"))
    assert pii.found(cases.empty(spark)).collect() == [] == pii.sanitised(cases.empty(spark)).collect()


def test_terms_that_disclose(spark):
    filler = ["stone river cloud mountain", "green table under window", "paper without letters here"]
    rows = [(i, f"{filler[i % 3]} number{chr(97 + i % 26)}{chr(97 + i // 26)}") for i in range(200)]
    rows += [(300 + i, f"{filler[i]} Zorblax writes from zorb@mail.example.com {filler[(i + 1) % 3]}") for i in range(3)]
    rows += [(400, "Uniqueterm single@mail.example.com stone"), (401, "Uniqueterm single@mail.example.com stone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.found(docs).collect()}
    for i in range(3):
        text = dict(rows)[300 + i]
        at = text.index("Zorblax")
        assert f"removed:{at}:{at + 7}" in got[300 + i].spans and "stone" not in [text[int(s.split(":")[1]) : int(s.split(":")[2])] for s in got[300 + i].spans.split(",")]
    assert got[400].n_terms == 0 and got[0].spans == ""
    clean = {r.doc_id: r.text for r in pii.sanitised(docs).collect()}
    assert "Zorblax" not in clean[300] and "[EMAIL]" in clean[300] and clean[0] == rows[0][1]


def test_terms_of_entities_in_one_text(spark):
    rows = [(i, f"stone river cloud mountain number{chr(97 + i % 26)}{chr(97 + i // 26)}") for i in range(200)]
    rows += [(300, "stone Quellmann river lone@one.example.org cloud"), (301, "river Quellmann cloud stone")]
    rows += [(302, "stone Firmwerk anna@firm.example.net"), (303, "river Firmwerk bert@firm.example.net cloud")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.found(docs).collect()}
    assert "term:6:15" in got[300].split(",")  # one text has the entity, two have the term
    assert "removed:6:14" in got[302].split(",") and "removed:6:14" in got[303].split(",")  # by the domain
    assert all(s.split(":")[0] == "email" or s in ("term:6:15", "removed:6:14") for k in (300, 302, 303) for s in got[k].split(","))


def test_terms_far_away_and_in_other_documents(spark):
    far = "stone river cloud mountain " * 10
    rows = [(i, f"{far}number{chr(97 + i % 26)}{chr(97 + i // 26)}") for i in range(200)]
    rows += [(300, f"lone@one.example.org {far}\n\nQuellmann Yx K7791 stone QUELLMANN"), (301, f"two@two.example.org {far} quellmann yx k7791"), (302, "river\nQuellmann cloud YX, K7791. Quellmanns")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clean = {r.doc_id: r.text for r in pii.sanitised(docs, generalise=0.75).collect()}
    assert clean[300] == f"[EMAIL] {far}\n\n[TERM] [TERM] [TERM] stone [TERM]" and clean[301] == f"[EMAIL] {far} [TERM] [TERM] [TERM]"
    assert clean[302] == "river\n[TERM] cloud [TERM], [TERM]. Quellmanns" and clean[5] == rows[5][1]


def test_sanitised_keeps_columns(spark):
    docs = cases.documents(spark, extra=True)
    out = pii.sanitised(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    texts = {r.doc_id: r.text for r in out.collect() if r.doc_id is not None}
    assert texts[0] is None and texts[1] == "" and "Anna" not in texts[16] and "[CARD]" in texts[16] and "[PHONE]" in texts[16]
    # The same by joins, as for more terms than can be broadcast.
    assert sorted(map(tuple, pii.sanitised(docs, few=0).collect()), key=repr) == sorted(map(tuple, out.collect()), key=repr)
    # An ip's last part and a card make one greedy run of digits, which is no card.
    joined = spark.createDataFrame([(1, "1.2.3.4 4111 1111 1111 1111")], "doc_id long, text string")
    assert pii.sanitised(joined).first().text == "[IP] 4111 1111 1111 1111"


def test_told_terms_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {(r.doc_id, r.text or "") for r in docs.collect()}
    word = regex.compile(r"[\p{L}\p{M}\p{N}_]{2,}")
    terms_of = lambda t: {w.lower() for w in word.findall(t)}
    df_term, texts, df_entity, both = Counter(), {}, Counter(), Counter()
    for _, text in rows:
        for t in terms_of(text):
            df_term[t] += 1
            texts.setdefault(t, set()).add(text)
        pools, blank, at = set(), "", 0
        for a, _, b, kind in base_spans(text):
            value = text[a:b].lower() if kind in ("email", "ip") else re.sub("[^0-9]", "", text[a:b])
            pools.add((kind, value))
            pools |= {("local", value[: value.index("@")]), ("domain", value[value.rindex("@") + 1 :])} if kind == "email" else {("net", value[: value.rindex(".")])} if kind == "ip" else set()
            blank, at = blank + text[at : max(a, at)] + "\n", max(b, at)
        df_entity.update(pools)
        both.update((e, t) for e in pools for t in terms_of(blank + text[at:]))
    n, told = len(rows), {}
    for (e, t), k in both.items():
        share = math.log2(n * k / (df_entity[e] * df_term[t])) / math.log2(n / df_entity[e])
        if len(texts[t]) >= 2 and share >= 0.8:
            told[t] = max(told.get(t, 0), share)
    got = {r.term: r.share for r in pii.told_terms(pii._rows(docs, "doc_id", "text")).collect()}
    assert len(told) > 20 and got.keys() == told.keys() and all(abs(got[t] - told[t]) < 1e-9 for t in told)
    removed = {t for t, x in told.items() if x >= 0.95}
    for r in pii.found(docs).collect():
        text = dict(rows)[r.doc_id]
        spans = base_spans(text)
        inside = lambda a, b: any(x < b and a < y for x, _, y, _ in spans)
        want = [f"{'removed' if m[0].lower() in removed else 'term'}:{m.start()}:{m.end()}" for m in word.finditer(text) if m[0].lower() in told and not inside(*m.span())]
        assert [x for x in r.spans.split(",") if x.split(":")[0] in ("term", "removed")] == want


def test_many_spans_in_one_text(spark):
    text = "a@b.de " * 1500 + "é 10.0.0.1 " * 700
    row = pii.found(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row.n_email, row.n_ip) == (1500, 700)
    assert row.spans == ",".join(f"{k}:{a}:{b}" for a, _, b, k in base_spans(text))


# -- quality ----------------------------------------------------------------------------------
def test_quality_on_held_out_labels(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.train(docs, labels)
    got = quality.score(docs, model).join(labels, "doc_id").where(quality.remainder() == 2).collect()
    assert len(got) > 50 and sum((r.score >= 0.7) == (r.quality == 1) for r in got) / len(got) > 0.95
    assert all((zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)


def test_quality_of_hard_rows(spark):
    docs = cases.documents(spark, extra=True)
    labels = spark.createDataFrame([(9, 1, 0), (9, 1, 0), (7, 0, 0), (None, 1, 0), (8, None, 0), (3, 5, 0), (14, 1, 0), (1, 0, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    scores = quality.score(docs, model).collect()
    assert len(scores) == docs.count() and all(0 <= r.score <= 1 for r in scores)
    assert quality.accepted(docs, model).columns == docs.columns
    none = quality.train(docs, labels.where("quality = 1"))
    assert {r.score for r in quality.score(docs, none).collect()} == {0.7}
    assert quality.score(cases.empty(spark), model).collect() == []


def plain_features(text: str) -> list[float]:
    """quality.features() character by character."""
    data = text.encode()
    if not data:
        return [0.0] * (len(quality.SURFACE) + quality.GRAMS)
    n, tokens, lines = len(data), text.split(), text.split("\n")
    m = max(1, len(tokens))
    of = lambda f: sum(1 for b in data if f(chr(b)) and b < 128)
    upper, lower, digit, prose = of(str.isupper), of(str.islower), of(str.isdigit), of(lambda c: c in ".,;:'\"-()?!")
    symbol = of(lambda c: 32 < ord(c) < 127 and not c.isalnum() and c not in ".,;:'\"-()?!")
    other = of(lambda c: (ord(c) < 32 and c not in "\t\n") or ord(c) == 127)
    letters, counts = max(1, upper + lower), Counter(tokens)
    out = [math.log1p(len(tokens)), math.log1p(n), upper / letters, digit / n, prose / n, symbol / n, other / n, data.count(b"\n") / m, len(counts) / m, len(set(lines)) / len(lines), n / m / 10]
    out += [sum(a == b for a, b in zip(tokens, tokens[1:], strict=False)) / m, max(counts.values(), default=0) / m, math.log1p(m / len(lines)), sum(not t[-1].isalnum() and t[-1] not in ".,;:?!'\")" for t in tokens) / m, sum(t.isupper() for t in tokens) / m]
    small, bins = data.lower(), [0] * quality.GRAMS
    for i in range(n - 2):
        bins[((small[i] << 16 | small[i + 1] << 8 | small[i + 2]) * 2_654_435_761 % 2**32) >> 24] += 1
    return out + [math.sqrt(b / max(1, n - 2)) for b in bins]


def test_quality_against_brute_force(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(docs, labels)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert np.allclose(quality.features("A|b! \x00\n\t ß 12"), plain_features("A|b! \x00\n\t ß 12")) and not quality.features("").any()
    # The drawn pairs, one by one: at the minimum of the logistic loss its slope is nought in every direction.
    fitted = sorted((r.quality, plain_features(texts[r.doc_id])) for r in labels.collect() if r.doc_id in texts and zlib.crc32(str(r.doc_id).encode()) % 4 != 2)
    better, worse = [x for q, x in fitted if q == 1], [x for q, x in fitted if q == 0]
    every = np.array([x for _, x in fitted])
    scale = [s if s >= 1e-9 else 1.0 for s in every.std(axis=0)]
    wins, pairs = np.zeros(every.shape[1]), 4000
    rng = random.Random(5)
    for _ in range(pairs):
        d = (np.array(rng.choice(better)) - np.array(rng.choice(worse))) / scale
        wins += d / (1 + math.exp(min(30, float(d @ model.weights))))
    ridge = np.where(np.arange(len(scale)) < len(quality.SURFACE), quality.RIDGE, quality.GRAM_RIDGE)
    assert np.abs(wins / pairs - ridge * model.weights).max() < 0.02  # other pairs of the same documents were drawn
    assert np.allclose(model.scale, scale, rtol=1e-3)
    for r in quality.score(docs, model).collect():
        z = sum(float(x) / float(s) * float(w) for x, s, w in zip(plain_features(texts[r.doc_id]), model.scale, model.weights, strict=True))
        want = 1 / (1 + math.exp(-max(-30, min(30, (z - model.threshold) / model.spread + math.log(0.7 / 0.3)))))
        assert abs(r.score - want) < 1e-6


def test_pairs_rank_by_strength():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3))
    y = (x @ [2.0, -1.0, 0.0] + rng.normal(size=400) * 0.3 > 0).astype(int)
    model = quality.fit(x, y)
    assert ((model.scores(x) >= 0.7) == (y == 1)).mean() > 0.9
    assert model.weights[0] > 0 > model.weights[1]


# -- language model ------------------------------------------------------------------------------
def test_gradient_of_the_network():
    texts = [b"a b c d e f a b", b"b c a", b"", b"zz yy a b c d"] * 2
    shape = language_model.Shape(hidden=4, frequent=5, fine=2, coarse=3, lanes=3)
    v = language_model.Vocabulary([b"a", b"b", b"c", language_model.END, b"d", b"e", b"f"], [9, 8, 7, 6, 3, 2, 1], 40, 9, shape)
    net = language_model.Network(v)
    net.flat = np.random.default_rng(0).normal(0, 0.4, len(net.flat)).astype(np.float32)
    net = language_model.Network(v, net.flat)
    lanes = language_model.Lanes.of(*v.encode(texts), 3)
    read = lambda: net.window_gradient(v.kind_of[x], *language_model._read(v, y), fresh, y >= 0, np.zeros((on, 4), np.float32))
    _, on, x, y, fresh = next(lanes.windows(9))
    gradient, _, _ = read()
    for k in np.flatnonzero(np.abs(gradient) > 5e-3)[::7]:
        kept = net.flat[k]
        net.flat[k] = kept + 1e-2
        up = read()[1]
        net.flat[k] = kept - 1e-2
        down = read()[1]
        net.flat[k] = kept
        assert abs((up - down) / 2e-2 / (y >= 0).sum() - gradient[k]) < 2e-3


def test_a_window_costs_what_its_tokens_do():
    import tracemalloc

    n = 60_000
    counts = [2 * n - k for k in range(n)]
    v = language_model.Vocabulary([b"w%d" % k for k in range(n)], counts, sum(counts) + 8, n + 1, language_model.Shape(frequent=n))
    net = language_model.Network.fresh(v)
    _, on, x, y, fresh = next(language_model.Lanes.of(*v.encode([b"w5 w70 w5 w59999"] * 8), 8).windows(language_model.WINDOW))
    tracemalloc.start()
    gradient, _, _ = net.window_gradient(v.kind_of[x], *language_model._read(v, y), fresh, y >= 0, np.zeros((on, net.h), np.float32))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # Besides the gradient, what each word reads is held, but no gates, weights or sums of all words.
    assert peak < gradient.nbytes + 2.5 * net.embedded().nbytes
    g = language_model.Network(v, gradient).p
    assert set(np.flatnonzero(g["E"][v.classes :].any(axis=1))) == {5, 70, n - 1}  # the words that are read
    trainer = language_model.Trainer(net)
    trainer.step(gradient)
    m, s = 0.1 * gradient.astype(float), 0.01 * gradient.astype(float) ** 2
    norm = max(1.0, float(np.sqrt((gradient.astype(float) ** 2).sum())))
    assert np.allclose(trainer.m, m / norm, rtol=1e-4, atol=1e-9) and np.allclose(trainer.s, s / norm**2, rtol=1e-4, atol=1e-12)


def test_probabilities_sum_to_one_and_state_is_carried():
    shape = language_model.Shape(hidden=4, frequent=3, fine=2, coarse=3, lanes=4)
    tokens, counts = [b"a", b"b", language_model.END, b"c", b"d"], [9, 8, 6, 3, 2]
    v = language_model.Vocabulary(tokens, counts, 30, 7, shape)  # two words of the rest: 2 tokens in all
    net = language_model.Network(v, np.random.default_rng(3).normal(0, 0.5, len(language_model.Network(v).flat)).astype(np.float32))
    net.p["cb"][np.bincount(v.class_of, minlength=v.classes) == 0] = -50  # as fresh networks have it: no class without words
    prefix = b"a b " * 60  # longer than a window
    at = {}
    for w in (b"a", b"b", b"c", b"d", b"other"):
        both = language_model.log10_of(net, [prefix + w, prefix.strip()])[0]
        whole = language_model.log10_of(net, [prefix + w])[0][0]
        assert abs(both[0] - whole) < 1e-4 * abs(whole)
        at[w] = whole
    # One step: the probabilities of all tokens sum to one. What is not broadcast counts as one token here.
    state, _ = net.step(net.p["b"][None, :].copy(), np.zeros((1, 4), np.float32))
    places = np.arange(6)
    logs = net.outputs(np.repeat(state, 6, axis=0), v.class_of[places], np.where(places < 3, places, -1)) / math.log(10) + v.within[places]
    # In the last class, broadcast words and the rest share the mass.
    rest = np.log10((30 - 28 + 0.1 * (7 - 5 + 1)) / v.mass[v.class_of[5]])
    logs[5] += rest
    assert abs((10**logs).sum() - 1) < 1e-4


def scalar_log10(net, words: list[bytes]) -> float:
    """The score of one text, token by token in plain Python: unit by unit, class by class."""
    v, p, h, out = net.v, {k: x.astype(float).tolist() for k, x in net.p.items()}, net.h, 0.0
    state, before = [0.0] * h, None
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    for w in [*words, language_model.END]:
        read = [0.0] * h
        if before is not None:
            c = int(v.class_of[before])
            read = [p["E"][c][i] + (p["E"][v.classes + before][i] if before < v.frequent else 0.0) for i in range(h)]
        g = [sum(read[i] * p["W"][i][j] for i in range(h)) + p["b"][j] for j in range(3 * h)]
        if before is None:
            g = p["b"]
        z, r = ([sigmoid(g[o + j] + sum(state[i] * p["U"][i][o + j] for i in range(h))) for j in range(h)] for o in (0, h))
        fresh = [math.tanh(g[2 * h + j] + sum(r[i] * state[i] * p["Un"][i][j] for i in range(h))) for j in range(h)]
        state = [(1 - z[j]) * fresh[j] + z[j] * state[j] for j in range(h)]
        at = v.index.get(w, len(v.index))
        c = int(v.class_of[at])
        logits = [sum(state[i] * p["C"][i][k] for i in range(h)) + p["cb"][k] for k in range(v.classes)]
        out += (logits[c] - math.log(sum(map(math.exp, logits)))) / math.log(10)
        if at < v.frequent:
            own = range(int(v.starts[c]), int(v.starts[c] + v.members[c]))
            logits = {k: sum(state[i] * p["O"][k][i] for i in range(h)) + p["ob"][k] for k in own}
            out += (logits[at] - math.log(sum(map(math.exp, logits.values())))) / math.log(10)
        else:
            out += float(v.within[at]) - (v.rest_log10 if at == len(v.index) else 0)
        before = at
    return out


def test_scores_against_a_scalar_network(monkeypatch):
    shape = language_model.Shape(hidden=4, frequent=3, fine=2, coarse=3, lanes=3)
    v = language_model.Vocabulary([b"a", b"b", language_model.END, b"c", b"d"], [9, 8, 6, 3, 2], 30, 7, shape)
    net = language_model.Network(v, np.random.default_rng(4).normal(0, 0.5, len(language_model.Network(v).flat)).astype(np.float32))
    rng = random.Random(3)
    texts = [b" ".join(rng.choice([b"a", b"b", b"c", b"D", b"other"]) for _ in range(n)) for n in (0, 1, 40, 3, 200, 7, 1)]
    want = [scalar_log10(net, t.lower().split()) for t in texts]
    for long in (1 << 30, 50, 5):  # whole, or in pieces with the state carried
        monkeypatch.setattr(language_model, "LONG", long)
        got = language_model.log10_of(net, texts)
        assert np.allclose(got[0], want, rtol=1e-4) and got[1].tolist() == [len(t.split()) + 1 for t in texts]
    # A long text beside short ones needs memory for its tokens, not for a grid.
    monkeypatch.undo()
    import tracemalloc

    many = [b"a b " * 200_000, *[b"a"] * 511]
    tracemalloc.start()
    language_model.log10_of(net, many)
    assert tracemalloc.get_traced_memory()[1] < 150_000_000
    tracemalloc.stop()
    trainer = language_model.Trainer(language_model.Network.fresh(v))
    monkeypatch.setattr(language_model, "LONG", 100)
    loss, tokens = language_model.train_on(trainer.net, trainer, [b"a b " * 100, b"c d"])
    assert tokens == 204 and math.isfinite(loss)


def test_scores_do_not_depend_on_the_layout(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scores = [{r.doc_id: r.score for r in language_model.scored(d, quality.remainder(n=10) != 0).collect()} for d in (docs, docs.repartition(7), docs.orderBy("text").coalesce(1))]
    assert all(abs(scores[0][k] - x[k]) <= 1e-4 * abs(x[k]) for x in scores[1:] for k in x)


def test_modelled_vocabulary_grows_with_the_counts(spark):
    sizes = []
    for top in (2_000, 100_000):
        counts = [top // (k + 1) + 1 for k in range(20 * int(top**0.5))]
        total = sum(counts) * 5 // 4  # a fifth of the tokens is not broadcast
        v = language_model.Vocabulary([b"w%d" % k for k in range(len(counts))], counts, total, 2 * len(counts), language_model.Shape())
        assert sum(counts[: v.frequent]) >= 0.7 * total > sum(counts[: v.frequent - 1])
        assert v.members.sum() == v.frequent <= v.shape.fine**2
        sizes.append(v.frequent)
    assert sizes[0] < sizes[1]
    big = np.zeros((70_000, 1), np.float32)
    language_model._add_rows(big, np.array([66_000, 464, 66_000, 464]), np.ones((4, 1), np.float32))
    assert big[66_000] == big[464] == 2
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    v = language_model.vocabulary(language_model.token_counts(docs, F.lit(True)), language_model.Shape())
    assert v.counts[: v.frequent].sum() >= 0.7 * v.total and v.frequent > 5_000


def test_thin_windows_move_weights_by_their_tokens():
    shape = language_model.Shape(hidden=4, frequent=5, fine=2, coarse=3, lanes=64)
    v = language_model.Vocabulary([b"a", b"b", b"c", language_model.END, b"d", b"e"], [9, 8, 7, 6, 3, 2], 35, 6, shape)
    net = language_model.Network.fresh(v)
    trainer = language_model.Trainer(net)
    texts = [b"a b c"] * 64
    language_model.train_on(net, trainer, texts)
    before, t = net.flat.copy(), trainer.t
    language_model.train_on(net, trainer, [*texts[1:], b"d e " * 2400])
    assert trainer.t - t == 5  # 201 windows, nearly all of them with one lane of 64, up to 64 together
    assert np.abs(net.flat - before).max() < 5 * trainer.rate
    # Windows together are the sum of windows: gradients are cut between them, states are not.
    lanes = language_model.Lanes.of(*v.encode([b"a b c d " * 30]), 1)
    parts = [np.zeros(len(net.flat)), np.zeros((1, 4), np.float32), 0]
    for _, _, x, y, fresh in lanes.windows(language_model.WINDOW):
        gradient, _, parts[1] = net.window_gradient(v.kind_of[x], *language_model._read(v, y), fresh, y >= 0, parts[1])
        parts[0] += gradient * (y >= 0).sum()
        parts[2] += (y >= 0).sum()
    _, _, x, y, fresh = next(lanes.windows(language_model.WINDOW, full=64))
    both = net.window_gradient(v.kind_of[x], *language_model._read(v, y), fresh, y >= 0, np.zeros((1, 4), np.float32))
    assert len(y) == 121 == parts[2] and np.allclose(both[0], parts[0] / parts[2], atol=1e-5) and np.allclose(both[2], parts[1], atol=1e-5)


@pytest.mark.parametrize("extra", [False, True])
def test_base_scores(spark, extra):
    docs = cases.documents(spark, extra)
    out = F.coalesce(quality.remainder(n=10), F.lit(-1)) == 0
    got = language_model.scored(docs, ~out, language_model.Shape(hidden=4, frequent=8, fine=2, coarse=4, lanes=8, head=20))
    rows, counts = docs.collect(), Counter()
    for r in rows:
        if r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 10:
            counts.update(cases.words(r.text))
            counts["\n"] += 1
    n, v = sum(counts.values()), len(counts)
    want = []
    for r in rows:
        w = [*cases.words(r.text), "\n"]
        want.append((r.doc_id, len(w), sum(counts[t] > 0 for t in w), n, round(sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in w), 4)))
    assert sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got.collect()), key=repr) == sorted(want, key=repr)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got.collect())


def test_network_beats_counts_and_takes_empty_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = quality.remainder(n=10) == 0
    by = language_model.scored(docs, ~out).groupBy(out.alias("out")).agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).collect()
    print([(r.out, r.s / r.n, r.b / r.n) for r in by])
    assert len(by) == 2 and all(r.s > r.b for r in by)  # held out, and trained on
    assert language_model.scored(cases.empty(spark), F.lit(True)).collect() == []
    lone = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert language_model.scored(lone, F.lit(False)).first().train_tokens == 0


# -- licenses ----------------------------------------------------------------------------------
def test_licenses_and_inheritance(spark):
    mit = "MIT License\n\nCopyright (c) 2021 Somebody Else\n\n" + textwrap.fill(licenses._MIT, 70, replace_whitespace=False)
    gnu = "".join(f" * {line}\n" for line in textwrap.wrap(licenses._GNU.format(licenses._GPL, "either version 3"), 60))
    prose = "stone river cloud mountain " * 30
    rows = [("/a/LICENSE", mit), ("/a/b/c/x.txt", "prose only"), ("/a/b/LICENSE", "Licensed under the Apache License, Version 2.0."), ("/a/d/y.c", f"/*\n{gnu} */\n\n{prose}"), ("/z.txt", None), ("/q/w.txt", ""), ("/a/e/f.txt", "license plates"),
            (None, "x"), ("/a/b/c/x.txt", "prose only"), ("/a/g.py", f"# SPDX-License-Identifier: Apache-2.0\n{prose}"), ("/a/h.txt", f"{prose}\nReleased under the MIT License.\n{prose}"), ("/a/long.txt", prose * 3000 + "\nLicensed under CC BY-NC 4.0.")]
    inside = ["license", "own_license", "near", "is_file", "n_statements", "_path", "_dir", "_hash", "file", "kind", "at", "term", "input_license", "_own", "_in", "hash"]
    df = spark.createDataFrame([(*r, *[f"{c}!" for c in inside]) for r in rows], "path string, text string, " + ", ".join(f"`{c}` string" for c in inside))
    out = licenses.scan(df, "path", "text")
    assert sorted(out.columns) == sorted(["path", "near", "is_file", *inside[5:], "input_input_license", "input_own_license", "input_n_statements", *licenses.RESULTS])
    found = out.collect()
    assert len(found) == len(rows) and all(r[c] == f"{c}!" for r in found for c in inside[5:]) and all(r.input_n_statements == "n_statements!" for r in found)
    got = {r.path: r for r in found}
    assert got["/a/LICENSE"].own_license == "MIT" and got["/a/LICENSE"].is_license_file and got["/a/LICENSE"].own_score > 0.95
    assert (got["/a/b/c/x.txt"].license, got["/a/b/c/x.txt"].inherited_from) == ("Apache-2.0", "/a/b")
    assert (got["/a/d/y.c"].own_license, got["/a/d/y.c"].is_license_file) == ("GPL-3.0", False)
    assert got["/a/g.py"].own_license == "Apache-2.0" and got["/a/h.txt"].own_license == "MIT" and got["/a/long.txt"].own_license == "CC-BY-NC-4.0"
    assert (got["/a/e/f.txt"].license, got["/a/e/f.txt"].inherited_from) == ("MIT", "/a")
    assert got["/z.txt"].license is None and got["/q/w.txt"].license is None and got[None].license is None
    assert licenses.scan(df.where("path = 'none'"), "path", "text").collect() == []


def test_cosine_against_brute_force(spark):
    texts = ["Licensed under the MIT License", "This is the GNU General Public License, version 3", "You may not use the Apache License here, license license", "copyright holders of nothing", "Licensed under CC BY-NC 4.0.", "Licensed under\nthe MIT\n*\nLicense. MIT License? License"]
    given = licenses.templates()
    df = {t: sum(t in licenses.terms_of(x) for x in texts) for _, y in given for t in licenses.terms_of(y)}
    idf = lambda t: math.log((1 + len(texts)) / (1 + df.get(t, 1))) + 1
    vector = lambda x: {t: k * idf(t) for t, k in Counter(licenses.terms_of(x)).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    want = {}
    for i, text in enumerate(texts):
        units = [p for line in text.split("\n") for p in re.split(r"(?<=[.!?])\s+", line)] + re.split(r"\n[^a-zA-Z0-9\n]*\n", text) + [text]
        for u in (vector(u) for u in units):
            for name, y in given:
                v = vector(y)
                cosine = round(sum(x * v.get(t, 0) for t, x in u.items()) / norm(u) / norm(v), 6) if u else 0
                if cosine >= 0.3:
                    want[i] = min(want.get(i, (0, "")), (-cosine, name))
    rows = spark.createDataFrame([(f"/{i}", t) for i, t in enumerate(texts)], "path string, text string")
    got = {int(r.path[1:]): (-r.own_score, r.own_license) for r in licenses.scan(rows, "path", "text", least=0.3).where("own_license is not null").collect()}
    assert {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in want.items()} and all(abs(got[k][0] - want[k][0]) < 2e-6 for k in want)


def test_components_by_either_way(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    links = spark.createDataFrame([p for p in pairs if p[0] != p[1]], "a long, b long")
    assert sorted(map(tuple, jaccard.components(links).collect())) == sorted(map(tuple, jaccard.components(links, few=0).collect()))
    assert jaccard.components(links.where("a < 0")).collect() == [] == jaccard.components(links.where("a < 0"), few=0).collect()


def test_long_texts_are_split_in_pieces(monkeypatch):
    texts = [b"", b"  a  B a\x0b", "É é b\x85c".encode(), b"one two " * 50 + b"end", b"x" * 300, b"\n"]
    for long in (1 << 30, 20, 1):
        monkeypatch.setattr(language_model, "LONG", long)
        got = Counter()
        for which, own in language_model._portions(texts):
            values, firsts = language_model._split(own)
            for i, n in zip(which.tolist(), np.diff(firsts).tolist(), strict=True):
                got.update((i, w.as_buffer().to_pybytes()) for w in values[:n])
                values = values[n:]
        got = Counter({k: n for k, n in got.items() if k[1]})
        assert got == Counter((i, w) for i, t in enumerate(texts) for w in t.lower().split())
