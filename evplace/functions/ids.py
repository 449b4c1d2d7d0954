"""Stable content-hash identities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# The fields of a piece of evidence that its id covers, in their sorted order.
EVIDENCE_FIELDS = ("author", "category", "fact", "published_at", "source", "title", "url")


def question_id(query: Column) -> Column:
    """SHA-256 of the stripped query; null counts as empty."""
    return F.sha2(strip(F.coalesce(query, F.lit(""))), 256)


def query_fingerprint(query: Column) -> Column:
    return F.substring(question_id(query), 1, 16)


def _quoted(c: Column) -> Column:
    text = F.to_json(F.array(strip(F.coalesce(c, F.lit("")))))
    return F.substring(text, F.lit(2), F.length(text) - 2)


def canonical_evidence(fields: dict[str, Column]) -> Column:
    """The fields as JSON text with sorted keys and ``", "`` / ``": "`` separators; null counts as empty."""
    parts: list[Column] = []
    for i, name in enumerate(EVIDENCE_FIELDS):
        parts += [F.lit(("{" if i == 0 else ", ") + f'"{name}": '), _quoted(fields[name])]
    return F.concat(*parts, F.lit("}"))


def scoped_evidence_id(source_question_id: Column, fields: dict[str, Column]) -> Column:
    """First 32 hex digits of the hash of question id, line break and canonical JSON."""
    return F.substring(F.sha2(F.concat(source_question_id, F.lit("\n"), canonical_evidence(fields)), 256), 1, 32)


def with_evidence_ids(source_question_id: Column, evidence: Column) -> Column:
    """An array of evidence, each with its scoped id; null stays null."""
    return F.transform(evidence, lambda e: e.withField("evidence_id", scoped_evidence_id(source_question_id, {name: e[name] for name in EVIDENCE_FIELDS})))


def session_id(query: Column, evidence_id: Column, persona: Column | None = None) -> Column:
    base = F.concat(F.lit("q-"), query_fingerprint(query), F.lit("__ev-"), evidence_id)
    return base if persona is None else F.concat(base, F.lit("__p-"), persona)


def evidence_id_of_session(session: Column) -> Column:
    """The evidence id inside a session id, null if there is none."""
    part = F.get(F.filter(F.split(session, "__"), lambda p: F.startswith(p, F.lit("ev-")) & (F.length(p) > 3)), F.lit(0))
    return F.substring(part, F.lit(4), F.length(part))


def record_evidence_id(top: Column, nested: Column) -> Column:
    """The evidence id of a record: its own, else that of its nested evidence; empty counts as missing."""
    return F.coalesce(F.nullif(top, F.lit("")), F.nullif(nested, F.lit("")))


def persona_of_session(session: Column) -> Column:
    part = F.get(F.filter(F.split(session, "__"), lambda p: F.startswith(p, F.lit("p-")) & (F.length(p) > 2)), F.lit(0))
    return F.substring(part, F.lit(3), F.length(part))


def normal_question_idx(value: Column) -> Column:
    """An integral number without its fraction (174.0 is 174); anything else as it is."""
    number = value.try_cast("double")
    return F.when(number.isNotNull() & (number == F.floor(number)), F.floor(number).cast("long").cast("string")).otherwise(value)


def resolve_question_id(question: Column, idx: Column, query: Column, position: Column) -> Column:
    """question id, else index (not if fractional), else hash of the query, else position."""
    number = idx.try_cast("double")
    whole = F.when(strip(idx) == "", None).when(number.isNull(), strip(idx)).when(number == F.floor(number), F.floor(number).cast("long").cast("string"))
    hashed = F.when(strip(F.coalesce(query, F.lit(""))) != "", question_id(query))
    return F.coalesce(F.nullif(strip(question), F.lit("")), whole, hashed, position.cast("string"))


def hash_rank(seed: object, *keys: Column) -> Column:
    """The order of all samplers: MD5 of seed and keys, as text, the same in any engine and partitioning."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def hash_unit(seed: object, *keys: Column) -> Column:
    """A number in [0, 1) from the same hash."""
    return F.conv(F.substring(hash_rank(seed, *keys), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
