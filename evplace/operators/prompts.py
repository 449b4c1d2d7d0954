"""Prompts and case reports as text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import markdown_cell, turn_range_label

PLACEMENT = {"early": "in the first third", "middle": "in the middle", "late": "in the last third"}
DENSITY = {"single_message": "in one message", "multi_message": "over several messages"}
DRIFT = {"tight": "Stay on the topic.", "moderate": "Wander off once and come back.", "wide": "Change the topic several times."}


def _choice(column: Column, table: dict[str, str], default: str) -> Column:
    out = None
    for key, value in table.items():
        out = F.when(column == key, value) if out is None else out.when(column == key, value)
    return out.otherwise(default)


def structural_rules(turn_range: Column, placement: Column, density: Column, temporal: Column) -> Column:
    """How long the session is and where its evidence goes; temporal sessions must name the date."""
    lines = F.array(
        F.concat(F.lit("Write "), turn_range_label(turn_range), F.lit(" turns.")),
        F.concat(F.lit("Place the evidence "), _choice(placement, PLACEMENT, "anywhere"), F.lit(", "), _choice(density, DENSITY, "in one message"), F.lit(".")),
        F.when(temporal, "Name the date of publication."),
    )
    return F.array_join(F.array_compact(lines), "\n")


def generation_prompt(persona: Column, evidence: Column, scenario: Column, turn_range: Column, placement: Column, density: Column, drift: Column, temporal: Column, off_topic: Column) -> Column:
    """The system prompt that asks for a session which carries one piece of evidence."""
    role = F.concat(F.lit("You write a chat between a user and an assistant. The user is "), persona, F.when(off_topic, ", outside their usual topics.").otherwise("."))
    return F.concat_ws("\n\n", role, F.concat(F.lit("Scenario: "), F.coalesce(scenario, F.lit("any"))), structural_rules(turn_range, placement, density, F.coalesce(temporal, F.lit(False))), _choice(drift, DRIFT, "Stay on the topic."), F.concat(F.lit("Evidence:\n"), evidence))


def audit_prompt(title: Column, source: Column, fact: Column, published: Column, transcript: Column, temporal: Column) -> Column:
    """The prompt that asks which user turns carry which field of the evidence."""
    fields = F.array_join(F.array_compact(F.array(F.concat(F.lit("topic: "), title), F.concat(F.lit("source: "), source), F.concat(F.lit("key_information: "), fact), F.when(temporal, F.concat(F.lit("published_at: "), published)))), "\n")
    return F.concat_ws("\n\n", F.lit("List the user turns that state each field."), fields, transcript)


def case_report(rows: DataFrame, key: str) -> DataFrame:
    """One markdown report per case: a table of its runs. rows: key, run_id, dist, prediction, gold_answer, notes."""
    line = F.concat_ws(" | ", F.col("run_id").cast("string"), "dist", markdown_cell(F.col("prediction")), markdown_cell(F.col("gold_answer")), markdown_cell(F.col("notes")))
    listed = rows.select(key, "run_id", line.alias("line")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("run_id", "line"))).alias("l"))
    head = "run | dist | prediction | gold | notes\n--- | --- | --- | --- | ---\n"
    return listed.select(key, F.concat(F.lit(head), F.array_join(F.col("l.line"), "\n")).alias("report"))
