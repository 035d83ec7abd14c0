"""PII removal: exact patterns, then information-theoretic sanitisation of what reveals the entities.

Base spans are found by four patterns over each whole text: email, ip (parts at most
255), card (12 to 19 digits with a valid check digit) and phone (9 to 15 digits).

Terms, which are words of two letters or digits at least, may reveal an entity. With
N documents, df(e) those with the entity, df(t) those with the term anywhere and
df(e, t) those with the entity and, anywhere outside base spans, the term, the term tells PMI(e; t) = log2(N df(e, t) / (df(e) df(t))) of the
IC(e) = log2(N / df(e)) bits that identify the entity. A term that tells at least
`generalise` of them is replaced by its kind, from `remove` on it is taken out, wherever
any document says it outside base spans.
Most entities stand in one text, so the pair needs no second one: the term must be
said by at least `support` different texts, with the entity or without it, so words of
a single document, or of copies of one, flag nothing. Parts that entities share count
as entities of their own: a mail's local part and its domain, and the first three
parts of an ip; cards and phones are compared by their digits. Counts cover all
documents and are exact.

A number that is one greedy run of digits with another, such as an ip's last part and a card after a space, fails its check
as the patterns make no retries, and stays.

Everything here is DataFrame functions: no Python runs on the executors. Null texts
count as empty; rows are told apart by a 64-bit hash of id and text, so null ids and
repeated rows do no harm; spans are offsets in code points, end exclusive. Ties are
ordered by start, kind, end. An empty table gives no rows. Other columns pass by.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.llm.common import fits, joined_once, text_of, written

#: Kinds in the order of the contract.
KINDS = ("email", "ip", "card", "phone")

#: The contract's patterns, written so that a scan is linear. Starts inside a run, which could only
#: fail again, are skipped (but a match may begin where the last one ended); loops are possessive, as nothing
#: after them could use what they give back; a card's length is counted in its pattern; a look behind comes after the first
#: character, which rules out most places.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9](?<![0-9]{2})[0-9]*+(?:\.[0-9]++){3}",
    "card": r"[0-9](?<![0-9]{2})(?<![0-9][\x20-][0-9])(?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_SMALL_PART = r"^0*(?:[0-9]|[1-9][0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.0*(?:[0-9]|[1-9][0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$"

#: A term: a longest run of these characters.
_OF_TERM = r"\p{L}\p{M}\p{N}_"
TERM = rf"[{_OF_TERM}]{{2,}}"


def _valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return match.rlike(_SMALL_PART)
    if kind == "card":
        return F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _valid_span(kind: str):
    return lambda span: _valid(kind, span["value"])


#: Matches are placed in blocks of so many, as arrays grow by copying.
_BLOCK = 256
_PLACES = "array<struct<start:int,end:int,value:string>>"


def _pairs(matches: Column, text: Column, pattern) -> Column:
    """Matches with the lengths of the pieces before them: array<struct<m, g>>, empty without a match."""
    pairs = F.arrays_zip(matches.alias("m"), F.transform(F.split(text, pattern, -1), lambda g: F.length(g)).alias("g"))
    return F.when(F.size(matches) > 0, pairs).otherwise(F.expr("cast(array() as array<struct<m:string,g:int>>)"))


def _located(pairs: str) -> Column:
    """Matches with their places, of a column of _pairs(): array<struct<start, end, value>>."""
    kind, starts_kind = f"struct<at:int,found:{_PLACES}>", "struct<at:int,list:array<int>>"
    none = F.expr(f"cast(array() as {_PLACES})")

    def add(s: Column, p: Column) -> Column:
        start = s["at"] + p["g"]
        end = start + F.length(p["m"])
        return F.when(p["m"].isNull(), s).otherwise(F.struct(end.alias("at"), F.concat(s["found"], F.array(F.struct(start.alias("start"), end.alias("end"), p["m"].alias("value")))).alias("found"))).cast(kind)

    placed = lambda own, at: F.aggregate(own, F.struct(at.alias("at"), none.alias("found")).cast(kind), add)["found"]
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.size(pairs) - 1, F.lit(0)), F.lit(_BLOCK)), lambda k: F.slice(pairs, k + 1, _BLOCK))
    widths = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda s, p: s + p["g"] + F.coalesce(F.length(p["m"]), F.lit(0))))
    begin = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("list")).cast(starts_kind)
    starts = F.aggregate(widths, begin, lambda s, w: F.struct((s["at"] + w).alias("at"), F.concat(s["list"], F.array(s["at"])).alias("list")).cast(starts_kind))["list"]
    return F.when(F.size(pairs) <= _BLOCK, placed(F.col(pairs), F.lit(0))).otherwise(F.flatten(F.zip_with(blocks, starts, placed)))


#: What every match of a kind contains; texts without it aren't scanned.
_NEEDED = {"email": "@", "ip": ".", "phone": "+"}


def with_spans(rows: DataFrame, text_col: str) -> DataFrame:
    """rows with a column per kind, array<struct<start, end, value>>, of the base spans."""
    none, text = F.expr(f"cast(array() as {_PLACES})"), F.col(text_col)
    matches = {k: F.regexp_extract_all(text, F.lit(p), F.lit(0)) for k, p in PATTERNS.items()}
    for kind, needed in _NEEDED.items():
        matches[kind] = F.when(F.contains(text, F.lit(needed)), matches[kind]).otherwise(F.expr("cast(array() as array<string>)"))
    out = rows.withColumns({f"_{k}": m for k, m in matches.items()})
    out = out.withColumns({f"_{k}": _pairs(F.col(f"_{k}"), text, p) for k, p in PATTERNS.items()})
    return out.withColumns({f"_{k}": F.when(F.size(f"_{k}") > 0, F.filter(_located(f"_{k}"), _valid_span(k))).otherwise(none) for k in KINDS})


def _listed(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined, by start, the kinds' order, and end."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _of_kind(kind: str, rank: int, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def _base(kinds: tuple[str, ...] = KINDS) -> Column:
    return F.concat(*[_of_kind(k, i, F.col(f"_{k}")) for i, k in enumerate(kinds)])


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_of(text_col)
    return docs.select(F.xxhash64(F.col(id_col), text).alias("_row"), F.col(id_col).alias("_id"), text.alias("_text"))


def _entity(kind: str):
    value = F.lower if kind in ("email", "ip") else lambda v: F.regexp_replace(v, "[^0-9]", "")
    return lambda s: F.struct(F.concat(F.lit(f"{kind}:"), value(s["value"])).alias("entity"), s["start"].alias("start"), s["end"].alias("end"))


def _pools(e: Column) -> Column:
    """An entity and the parts of it that other entities may share."""
    mail = F.array(e, F.concat(F.lit("local:"), F.regexp_extract(e, "^email:([^@]*)@", 1)), F.concat(F.lit("domain:"), F.substring_index(e, "@", -1)))
    ip = F.array(e, F.concat(F.lit("net:"), F.regexp_extract(e, r"^ip:(.*)\.", 1)))
    return F.when(e.startswith("email:"), mail).when(e.startswith("ip:"), ip).otherwise(F.array(e))


def _replaced(text: Column, spans: Column, label, keep: bool = False) -> Column:
    """The text with label(span) for each of the sorted spans. Of overlapping ones the earlier is replaced, and what reaches beyond it is cut out, or blanked to keep places."""
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def replace(s: Column, x: Column) -> Column:
        between = F.substring(text, s["at"] + 1, x["start"] - s["at"])
        rest = F.concat(s["out"], F.repeat(F.lit("\n"), x["end"] - s["at"])) if keep else s["out"]
        return F.when(x["end"] <= s["at"], s).when(x["start"] < s["at"], F.struct(x["end"].alias("at"), rest.alias("out"))).otherwise(F.struct(x["end"].alias("at"), F.concat(s["out"], between, label(x)).alias("out")))

    return F.aggregate(spans, begin, replace, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))


def _words(text: Column) -> Column:
    """The different words of a text, as they stand there."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)))


def _terms(text: Column) -> Column:
    return F.array_distinct(F.transform(_words(text), F.lower))


def contexts(spanned: DataFrame) -> DataFrame:
    """(entities, terms) of each document with base spans: entities with their pools, and all terms outside base spans."""
    spans = F.concat(*[F.transform(F.col(f"_{k}"), _entity(k)) for k in KINDS])
    entities = F.array_distinct(F.flatten(F.transform(spans, lambda s: _pools(s["entity"]))))
    some = spanned.where(F.size(_base()) > 0)
    return some.select(entities.alias("entities"), _terms(_replaced(F.col("_text"), F.array_sort(_base()), lambda _: F.lit("\n"))).alias("terms"))


def _texts(support: int) -> Column:
    """The number of different texts, exact up to `support`: of up to two, the least and the greatest hash tell, without a set."""
    return F.count_distinct("text_hash") if support > 2 else F.when(F.min("text_hash") < F.max("text_hash"), 2).otherwise(1)


def disclosing(rows: DataFrame, own: DataFrame, support: int = 2, generalise: float = 0.8, few: int = 1_000_000) -> DataFrame:
    """(entity, term, share): pairs whose term tells at least `generalise` of the entity's information. rows: _text of all documents; own: their contexts(), written."""
    df_entity = written(own.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("entity_docs")), "entities")
    n, most = rows.count(), df_entity.agg(F.max("entity_docs")).first()[0] or 1
    said = rows.select(F.xxhash64("_text").alias("text_hash"), F.explode(_terms(F.col("_text"))).alias("term"))
    asked = written(own.select(F.explode("terms").alias("term")).distinct(), "asked")
    if fits(asked, few):  # only these terms can disclose, so others needn't be counted
        said = said.join(F.broadcast(asked), "term", "left_semi")
    df_term = said.groupBy("term").agg(F.count(F.lit(1)).alias("term_docs"), _texts(support).alias("texts")).where(F.col("texts") >= support)
    # PMI is log2(N / df(t)) at most, so terms of more documents tell too little of any entity.
    least_bits = generalise * math.log2(max(n, 1) / most) - 1e-9
    rare = df_term.where(F.log2(F.lit(float(n)) / F.col("term_docs")) >= least_bits).select("term", "term_docs")
    rare = written(rare.join(asked, "term", "left_semi"), "rare")
    terms = own.select("entities", F.explode("terms").alias("term"))
    pairs = joined_once(terms, rare, "term", few).select("term", "term_docs", F.explode("entities").alias("entity"))
    both = written(pairs.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("both"), F.first("term_docs").alias("term_docs")), "both")
    full = joined_once(both, df_entity, "entity", few)
    pmi, ic = F.log2(F.lit(float(n)) * F.col("both") / (F.col("entity_docs") * F.col("term_docs"))), F.log2(F.lit(float(n)) / F.col("entity_docs"))
    share = F.when(ic > 0, pmi / ic).otherwise(F.lit(0.0))
    return full.withColumn("share", share).where(F.col("share") >= generalise).select("entity", "term", "share")


def told_terms(rows: DataFrame, **options) -> DataFrame:
    """(term, share): the terms that disclose an entity, with the most that they tell of one. rows: _text of all documents."""
    own = written(contexts(with_spans(rows.select("_text"), "_text")), "contexts")
    return written(disclosing(rows, own, **options).groupBy("term").agg(F.max("share").alias("share")), "told")


def with_terms(rows: DataFrame, told: DataFrame, few: int = 200_000) -> DataFrame:
    """rows (_row, _text and others) with the base spans by kind and _spans, those of told terms outside them, by value.

    Words are joined with the terms (a broadcast up to `few` of these, which are counted), and each row with what its
    words found, for which each text crosses one exchange.
    """
    said = rows.select("_row", F.explode(_words(F.col("_text"))).alias("word"))
    terms = told.withColumnRenamed("term", "_term")
    hit = said.join(F.broadcast(terms) if fits(told, few) else terms, F.lower("word") == F.col("_term"))
    # Repeated rows have one hash and the same words.
    by_row = written(hit.groupBy("_row").agg(F.map_from_entries(F.collect_set(F.struct("word", "share"))).alias("_share")), "hits")
    found = rows.join(by_row, "_row", "left").withColumn("_share", F.coalesce("_share", F.expr("cast(map() as map<string,double>)")))
    # Base spans are blanked, so that places stay.
    blank = _replaced(F.col("_text"), F.array_sort(_base()), lambda x: F.repeat(F.lit("\n"), x["end"] - x["start"]), keep=True)
    pattern = F.concat(F.lit(rf"(?<![{_OF_TERM}])(?:"), F.array_join(F.map_keys("_share"), "|"), F.lit(rf")(?![{_OF_TERM}])"))
    some = F.size("_share") > 0
    placed = with_spans(found, "_text").withColumn("_blank", F.when(some, blank)).withColumn("_pattern", F.when(some, pattern))
    placed = placed.withColumn("_found", F.regexp_extract_all("_blank", F.col("_pattern"), F.lit(0))).withColumn("_spans", _pairs(F.col("_found"), F.col("_blank"), F.col("_pattern")))
    return placed.withColumn("_spans", _located("_spans")).drop("_blank", "_pattern", "_found")


def _term_spans(remove: float) -> Column:
    """Spans of told terms: kind 'removed' from `remove` on, 'term' below."""
    kind = lambda t: F.when(F.element_at("_share", t["value"]) >= remove, "removed").otherwise("term")
    spans = F.transform("_spans", lambda t: F.struct(t["start"].alias("start"), F.lit(len(KINDS)).alias("rank"), t["end"].alias("end"), kind(t).alias("kind")))
    return F.coalesce(spans, F.expr("cast(array() as array<struct<start:int,rank:int,end:int,kind:string>>)"))


def found(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", remove: float = 0.95, few: int = 200_000, **options) -> DataFrame:
    """Per document: id, n_<kind> of the base kinds, n_terms, base_sha256, spans (base and added)."""
    rows = _rows(docs, id_col, text_col)
    placed = with_terms(rows, told_terms(rows, **options), few)
    full = placed.withColumn("_base", _base()).withColumn("_terms", _term_spans(remove))
    return full.select(F.col("_id").alias(id_col), *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS], F.size("_terms").cast("long").alias("n_terms"), F.sha2(_listed(F.col("_base")), 256).alias("base_sha256"), _listed(F.concat("_base", "_terms")).alias("spans"))


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", remove: float = 0.95, few: int = 200_000, **options) -> DataFrame:
    """docs with personal data replaced by [KIND], generalised terms by [TERM], and removed terms by nothing; all columns stay.

    Where spans overlap, the earlier one is replaced, and the rest of a later one that reaches beyond it is cut out.
    """
    told = told_terms(_rows(docs, id_col, text_col), **options)
    # One struct holds all columns, so that none of their names can clash with those made here.
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_docs"), text_of(text_col).alias("_text"), F.xxhash64(F.col(f"`{id_col}`"), text_of(text_col)).alias("_row"))
    spans = F.array_sort(F.concat(_base(), _term_spans(remove)))
    label = lambda x: F.when(x["kind"] == "removed", "").otherwise(F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")))
    full = with_terms(keyed, told, few).withColumn("_all", spans)
    clean = F.when(F.size("_all") == 0, F.col("_docs")[text_col]).otherwise(_replaced(F.col("_text"), F.col("_all"), label))
    return full.select(*[(clean if c == text_col else F.col("_docs")[c]).alias(c) for c in docs.columns])
