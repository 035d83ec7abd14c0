"""Delimited text with strict rules.

A line is cut at the field delimiter. A field in double quotes (blanks may stand
around them) may hold delimiters; quotes have no escape. Numbers are digits with an
optional minus; an empty integer field is 0, an empty float is an error, an empty
string is "". Fields beyond the declared ones are ignored. A line with too few
fields (a missing last one included), a malformed or unterminated quote and a number
that does not parse or fit are errors; with lenient=True such lines are dropped.
A carriage return at the end of a line is dropped if lines end with a newline.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_REAL = (T.FloatType, T.DoubleType)


def _value(raw: Column, kind: T.DataType, last: Column) -> tuple[Column, Column]:
    """(value, whether the field is good); raw is null where the line has no such field, last says that nothing follows it."""
    if isinstance(kind, _WHOLE):
        name = kind.simpleString()
        value = F.when((raw == "") & ~last, F.lit(0).cast(kind)).when(raw.rlike("^-?[0-9]+$"), raw.try_cast(name))
    elif isinstance(kind, _REAL):
        value = F.when(raw != "", raw.try_cast(kind.simpleString()))
    elif isinstance(kind, T.StringType):
        quoted = F.regexp_extract(raw, r'^[ \t]*"([^"]*)"[ \t]*$', 1)
        value = F.when(raw.rlike(r'^[ \t]*"[^"]*"[ \t]*$'), quoted).when(~raw.rlike(r'^[ \t]*"') & ~((raw == "") & last), raw)
    else:
        raise TypeError(f"no parser for {kind.simpleString()}")
    return value, value.isNotNull()


def read_csv(
    spark: SparkSession, path: str | list[str], schema: str | T.StructType, field_delimiter: str = ",", line_delimiter: str = "\n", header: bool = False, lenient: bool = False, include: Sequence[int | bool] | None = None
) -> DataFrame:
    """Delimited text as rows. schema names the fields in file order; include selects some, by position or by a mask."""
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if len(field_delimiter) < 1 or not field_delimiter.isascii():
        raise ValueError("the field delimiter must be ASCII")
    wanted = list(range(len(fields)))
    if include is not None:
        wanted = [i for i, x in enumerate(include) if x] if all(isinstance(x, bool) for x in include) else [int(x) for x in include]
    if header:
        # A reader that sees one field per line knows which line is the first of its file.
        lines = spark.read.option("header", True).option("sep", "\x01").option("quote", "").option("lineSep", line_delimiter).option("enforceSchema", True).schema("value string").csv(path)
        lines = lines.withColumn("value", F.coalesce("value", F.lit("")))
    else:
        lines = spark.read.option("lineSep", line_delimiter).text(path)
    line = F.regexp_replace("value", "\r$", "") if line_delimiter == "\n" else F.col("value")
    mark = re.escape(field_delimiter)
    # A field and what ends it: quoted as a whole, or anything up to a delimiter.
    pattern = rf'(?:[ \t]*"[^"]*"[ \t]*(?={mark}|$)|(?:(?!{mark})[\s\S])*+)(?:{mark}|$)'
    pieces = F.regexp_extract_all(line, F.lit(pattern), F.lit(0))
    cut = lines.select(line.alias("_line"), pieces.alias("_pieces"))
    values, good = [], None
    most = max(wanted, default=-1)
    for i, f in enumerate(fields):
        if i > most and i not in wanted and i != len(fields) - 1:
            continue
        piece = F.get(F.col("_pieces"), F.lit(i))
        ended = piece.endswith(field_delimiter)
        raw = F.when(ended, F.substring(piece, F.lit(1), F.length(piece) - len(field_delimiter))).otherwise(piece)
        if i in wanted:
            value, own = _value(raw, f.dataType, ~ended)
            values.append((wanted.index(i), value.alias(f.name)))
        else:
            own = piece.isNotNull() & ~((raw == "") & ~ended)
        good = own if good is None else good & own
    made = cut.select(F.coalesce(good, F.lit(False)).alias("_good"), "_line", *[v for _, v in sorted(values, key=lambda x: x[0])])
    names = [fields[i].name for i in wanted]
    if lenient:
        return made.where("_good").select(*names)
    checked = F.when(F.col("_good"), True).otherwise(F.raise_error(F.concat(F.lit("malformed line: "), F.col("_line"))).cast("boolean"))
    return made.where(checked).select(*names)


def write_csv(df: DataFrame, path: str, field_delimiter: str = ",", quote_strings: bool = False, allow_nulls: bool = False) -> DataFrame:
    """Writes lines over what is at the path, a file per partition, and gives df for further use. Nulls are errors unless allowed."""
    cells = []
    for f in df.schema:
        text = F.col(f"`{f.name}`").cast("string")
        if quote_strings and isinstance(f.dataType, T.StringType):
            text = F.concat(F.lit('"'), text, F.lit('"'))
        null = F.lit("") if allow_nulls else F.raise_error(F.lit(f"null in column {f.name}")).cast("string")
        cells.append(F.coalesce(text, null))
    df.select(F.concat_ws(field_delimiter, *cells).alias("value")).write.mode("overwrite").text(path)
    return df
