"""Several values packed in one text field: one row per value, position kept.

The cell grammar is a parsing expression grammar with ordered alternatives::

    cell      <- blank / 'nan' / list / delimited
    list      <- '[' (entry (',' entry)*)? ','? ']'
    entry     <- quoted(backslash escapes) / bare
    delimited <- value (delimiter value)*
    value     <- quoted(doubled quotes) &(delimiter / end) / bare
    delimiter <- '||' / '|' / ',' / ';' / tab / line break

A quote that does not close, or closes in the middle of a value, makes the
quoted alternative fail; the parser goes back and reads the same place as a bare
value, whose row then carries ``malformed_quote``. A list without its closing
bracket is read on as entries and flagged ``unclosed_bracket``. Entries of a list
that are bare ``None``, ``null`` or ``nan`` hold no value. Alternatives are tried
by one compiled pattern per rule, so a cell costs one pass over its text.

Defined results: null, blank, ``[]`` and ``nan`` cells give no rows; empty pieces
take no position; repeated values each count; rows sent again (same key) count
once, the one with the least ``order_by`` value standing for all of them; a null
key is kept as one record with a null id.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BLANK = " \t\r\n\f\v\u00a0\u200b\ufeff"
_VALUE = re.compile(
    r"""[ \u00a0]*(?:"((?:[^"]|"")*)"|'((?:[^']|'')*)')[ \u00a0]*(?=[|,;\t\r\n]|$)"""  # quoted
    r"""|([^|,;\t\r\n]*)"""  # bare
)
_DELIMITER = re.compile(r"\|\||\r\n|[|,;\t\r\n]")
_ENTRY = re.compile(
    r"""\s*(?:"((?:[^"\\]|\\.)*)"|'((?:[^'\\]|\\.)*)')\s*(?=,|\]\s*$|$)"""  # quoted
    r"""|([^,]*)""",  # bare
    re.S,
)
_ESCAPE = re.compile(r"\\(u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|.)", re.S)
_PLAIN = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}
_NO_VALUE = {"none", "null", "nan"}


def _unescape(text: str) -> str:
    if "\\" not in text:
        return text
    out = _ESCAPE.sub(lambda m: chr(int(m[1][1:], 16)) if len(m[1]) > 1 else _PLAIN.get(m[1], m[1]), text)
    # A pair of surrogate escapes is one character.
    return out.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _list(body: str) -> list[tuple[str, str | None]]:
    """Entries of a list literal; ``body`` starts behind the opening bracket."""
    body = body.rstrip(_BLANK)
    flag = None if body.endswith("]") else "unclosed_bracket"
    if flag is None:
        body = body[:-1]
    out, at, end = [], 0, len(body)
    while at <= end:
        m = _ENTRY.match(body, at)
        double, single, bare = m.groups()
        at = m.end() + 1
        if bare is None:
            item = _unescape(double if double is not None else single).strip(_BLANK)
            if item:
                out.append((item, flag))
            continue
        item = bare.strip(_BLANK)
        if item and item.lower() not in _NO_VALUE:
            out.append((item, "malformed_quote" if item[0] in "\"'" else flag))
    return out


def _delimited(text: str) -> list[tuple[str, str | None]]:
    out, at, end = [], 0, len(text)
    while at <= end:
        m = _VALUE.match(text, at)
        double, single, bare = m.groups()
        at = m.end()
        if bare is None:
            item = (double.replace('""', '"') if double is not None else single.replace("''", "'")).strip(_BLANK)
            flag = None
        else:
            item = bare.strip(_BLANK)
            flag = "malformed_quote" if item[:1] == '"' else None
        if item:
            out.append((item, flag))
        d = _DELIMITER.match(text, at)
        if not d:
            break
        at = d.end()
    return out


def parse_cell(text: str | None) -> list[tuple[str, str | None]]:
    """The values of one cell in order, each with its error flag or None."""
    if text is None:
        return []
    text = text.strip(_BLANK)
    if not text or text.lower() == "nan":
        return []
    return _list(text[1:]) if text[0] == "[" else _delimited(text)


def split_packed(df: DataFrame, key: str, fields: Sequence[str], order_by: str | None = None) -> DataFrame:
    """One row per packed value: record_id, field_name, pos (from 1), item, error."""
    picked = F.struct(*([F.col(order_by).alias("__o")] if order_by else []), *[F.col(c).cast("string").alias(f"f{i}") for i, c in enumerate(fields)])
    once = df.groupBy(F.col(key).alias("record_id")).agg(F.min(picked).alias("r")).select("record_id", *[F.col(f"r.f{i}").alias(f"f{i}") for i in range(len(fields))])
    schema = T.StructType([once.schema["record_id"], T.StructField("field_name", T.StringType()), T.StructField("pos", T.IntegerType()), T.StructField("item", T.StringType()), T.StructField("error", T.StringType())])
    names = list(fields)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            origin, field, pos, item, error = [], [], [], [], []
            for i, name in enumerate(names):
                for row, text in enumerate(batch.column(i + 1).to_pylist()):
                    for n, (value, flag) in enumerate(parse_cell(text), 1):
                        origin.append(row)
                        field.append(i)
                        pos.append(n)
                        item.append(value)
                        error.append(flag)
            ids = batch.column(0).take(pa.array(origin, pa.int64()))
            named = pa.array(names, pa.string()).take(pa.array(field, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, named, pa.array(pos, pa.int32()), pa.array(item, pa.string()), pa.array(error, pa.string())], ["record_id", "field_name", "pos", "item", "error"])

    return once.mapInArrow(parse, schema)
