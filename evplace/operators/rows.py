"""Row shapes: run rows, answers, variants, required fields, derived numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.ids import hash_rank
from ..functions.text import strip
from .evidence import PERSONA_ORDER, VARIANTS
from .relational import first_column


def run_rows(df: DataFrame) -> DataFrame:
    """The canonical columns of a run, whatever names its table uses; a null question type is empty."""
    names = {
        "question_idx": ("question_idx", "question_id"),
        "block_id": ("block_id", "Block1"),
        "original_persona": ("original_persona", "persona"),
        "eval_persona": ("eval_persona", "persona"),
        "variant": ("variant", "dist"),
        "agent": ("agent",),
        "prediction": ("prediction", "final_answer"),
        "gold_answer": ("answer", "final_answer_gold", "gold_answer"),
    }
    kind = F.coalesce(first_column(df, "question_type"), F.lit(""))
    return df.select(*[first_column(df, *options).alias(name) for name, options in names.items()], kind.alias("question_type"))


def answer_of(df: DataFrame) -> Column:
    """The first answer column that is not null; a row without any is an error."""
    return F.coalesce(first_column(df, "answer", "final_answer", "gold_answer"), F.raise_error(F.lit("row without answer")))


def answer_fields(result: Column) -> dict[str, Column]:
    """The fields of an agent's result: a bare text is the prediction, a JSON object has prediction or final_answer."""
    fields = F.from_json(result, "prediction string, final_answer string, reasoning string, inference_error string")
    text = F.when(strip(result).startswith("{"), F.coalesce(fields["prediction"], fields["final_answer"])).otherwise(result)
    return {"prediction": text, "reasoning": fields["reasoning"], "inference_error": fields["inference_error"]}


def valid_variant(variant: Column) -> Column:
    """The variant in lower case; anything unknown is an error."""
    v = F.lower(strip(variant))
    return F.when(v.isin(*VARIANTS), v).otherwise(F.raise_error(F.concat(F.lit("unknown variant "), F.coalesce(variant, F.lit("null")))))


def known_persona(persona: Column) -> Column:
    """The persona, or an error for one that has no character text."""
    return F.when(persona.isin(*PERSONA_ORDER[:4]), persona).otherwise(F.raise_error(F.concat(F.lit("unknown persona "), F.coalesce(persona, F.lit("null")))))


def required_query(query: Column) -> Column:
    """The stripped query; an error for null or blank."""
    q = strip(F.coalesce(query, F.lit("")))
    return F.when(q != "", q).otherwise(F.raise_error(F.lit("empty query")))


def all_required_present(topic: Column, source: Column, key_information: Column, published_at: Column, temporal: Column) -> Column:
    """Every required field has a location; the date too for temporal sessions."""
    has = lambda c: F.coalesce(F.size(c), F.lit(-1)) > 0
    return has(topic) & has(source) & has(key_information) & (~F.coalesce(temporal, F.lit(False)) | has(published_at))


def actual_turns(n_messages: Column, fallback: Column) -> Column:
    """Half the messages of a session, else the other corpus's number."""
    return F.coalesce(F.floor(n_messages / 2).cast("int"), fallback.cast("int"))


def row_seed(seed: int, key: Column) -> Column:
    """The seed of one row: the first eight hex digits of the hash of seed and key."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256), 1, 8), 16, 10).cast("long")


def coin(seed: int, key: Column) -> Column:
    return F.conv(F.substring(hash_rank(seed, F.lit("coin"), key), 1, 8), 16, 10).cast("long") % 2


def weighted_marginal(weights: DataFrame, shares: DataFrame, group: str, key: str, level: str) -> DataFrame:
    """Share of each level per group: the sum over keys of weight x share, scaled to one; all equal if nothing has weight.

    weights: group, key, weight. shares: key, level, share.
    """
    g = weights.join(shares, key).groupBy(group, level).agg(F.sum(F.col("weight") * F.col("share")).alias("raw"))
    w = W.Window.partitionBy(group)
    total = F.sum("raw").over(w)
    return g.select(group, level, F.round(F.when(total > 0, F.col("raw") / total).otherwise(1.0 / F.count("*").over(w)), 6).alias("share"))


def hop_count(memory: Column, documents: Column) -> Column:
    """Pieces of evidence in both channels, repeats counted; null counts as none."""
    n = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    return n(memory) + n(documents)


def attach_persona(df: DataFrame, known: DataFrame) -> DataFrame:
    """``df`` with the persona of its query, ``tbd`` without one. known: query (stripped, unique), persona."""
    return df.withColumn("__q", F.trim("query")).join(known.select(F.col("query").alias("__q"), "persona"), "__q", "left").drop("__q").withColumn("persona", F.coalesce("persona", F.lit("tbd")))


def record_persona(df: DataFrame) -> Column:
    """The target persona of a record, else its persona, else unknown; empty counts as missing."""
    named = [F.nullif(F.col(c), F.lit("")) for c in ("target_persona_id", "persona_id") if c in df.columns]
    return F.coalesce(*named, F.lit("unknown"))


def audit_rows(sessions: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, orphans): sessions joined to their manifest entry, and the ids of those without entry, evidence or turns.

    sessions: session_id, session. manifest: custom_id, evidence, is_temporal, question_type. Blank ids are left out.
    """
    entry = manifest.select(F.col("custom_id").alias("session_id"), "evidence", "is_temporal", "question_type", F.lit(True).alias("__known"))
    j = sessions.withColumn("session_id", strip(F.col("session_id"))).where("session_id <> ''").join(entry, "session_id", "left")
    sound = F.coalesce(F.col("__known"), F.lit(False)) & F.col("evidence").isNotNull() & F.col("session").isNotNull()
    temporal = F.coalesce("is_temporal", F.lit(False)) | F.coalesce(F.col("question_type") == "temporal_query", F.lit(False))
    return j.where(sound).withColumn("is_temporal", temporal).drop("__known"), j.where(~sound).select("session_id")
