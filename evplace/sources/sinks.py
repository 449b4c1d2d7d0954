"""Writers of the pipeline's results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.relational import require_unique


def format_of(path: str) -> str:
    """The output format by suffix; without a known one Parquet."""
    for suffix, name in ((".jsonl", "json"), (".json", "json"), (".csv", "csv"), (".tsv", "csv"), (".parquet", "parquet")):
        if path.endswith(suffix):
            return name
    return "parquet"


def write_rows(df: DataFrame, path: str, mode: str = "append") -> None:
    """Rows in the format of the path. Each call commits on its own, so a run can go on where it stopped."""
    kind = format_of(path)
    if kind == "csv":
        nested = [f.name for f in df.schema if f.dataType.typeName() in ("array", "map", "struct")]
        df.withColumns({c: F.to_json(c) for c in nested}).write.mode(mode).option("header", True).option("escape", '"').csv(path)
    else:
        getattr(df.write.mode(mode), kind)(path)


def write_by(df: DataFrame, path: str, *columns: str, mode: str = "overwrite") -> None:
    """One folder per value of the columns (variant, persona), for later partition pruning."""
    df.write.mode(mode).partitionBy(*columns).parquet(path)


def output_path(template: str, variant: str | None = None, eval_persona: str | None = None, several: bool = False) -> str:
    """A path from a template with {variant} and {eval_persona}; several values need the place holder."""
    if several and "{variant}" not in template and "{eval_persona}" not in template:
        raise ValueError("the path needs {variant} or {eval_persona}")
    return template.replace("{variant}", variant or "").replace("{eval_persona}", eval_persona or "")


def write_corpus(df: DataFrame, path: str) -> None:
    """Documents sorted by url, one JSON object a line; a url may occur once."""
    rows = df.withColumn("url", F.coalesce("url", F.lit("")))
    require_unique(rows, "url").orderBy("url").write.mode("overwrite").json(path)


def write_evidence_urls(df: DataFrame, path: str) -> None:
    """evidence_id and url sorted by id; an error for two urls, a missing id or a missing url."""
    missing = df.where("trim(coalesce(evidence_id, '')) = '' or trim(coalesce(url, '')) = ''").head()
    if missing is not None:
        raise ValueError(f"evidence without id or url: {missing.asDict()}")
    g = df.groupBy("evidence_id").agg(F.min("url").alias("url"), F.count_distinct("url").alias("n"), F.min("question_idx").alias("question_idx"))
    bad = g.where("n > 1").head()
    if bad is not None:
        raise ValueError(f"two urls for {bad['evidence_id']}")
    g.drop("n").orderBy("evidence_id").write.mode("overwrite").json(path)


def write_requests(df: DataFrame, requests: str, manifest: str) -> None:
    """Batch requests and their manifest entries, one JSON object a line each."""
    df.select("custom_id", "prompt").write.mode("overwrite").json(requests)
    df.drop("prompt").write.mode("overwrite").json(manifest)


def write_batch_meta(df: DataFrame, path: str, **settings: str) -> None:
    """One JSON object about a batch: its number of requests, the settings it was made with, and no time (so equal batches give equal files)."""
    row = df.agg(F.count("*").alias("n_requests"), F.count_distinct("custom_id").alias("n_custom_ids"))
    row.select("*", *[F.lit(v).alias(k) for k, v in sorted(settings.items())]).write.mode("overwrite").json(path)


def write_audit(rows: DataFrame, orphans: DataFrame, path: str, orphans_path: str) -> None:
    """Audit rows appended to what is there, and the list of sessions without a manifest entry, sorted."""
    write_rows(rows, path)
    orphans.select("session_id").distinct().orderBy("session_id").coalesce(1).write.mode("overwrite").text(orphans_path)
