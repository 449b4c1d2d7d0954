"""Readers of the pipeline's files: JSON lines, JSON arrays and objects, CSV, run folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import ids
from ..operators.relational import keep_one, pending
from ..operators.rows import attach_persona, hop_count
from . import schemas as s


def corpus_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Documents, one JSON object a line; blank lines are skipped."""
    return spark.read.schema(s.DOCUMENT).json(path).where("url is not null or title is not null or body is not null")


def _check_array(spark: SparkSession, path: str) -> None:
    first = spark.read.text(path, wholetext=True).select(F.substring(F.trim(F.regexp_replace("value", r"^\s+", "")), 1, 1).alias("c")).where("c <> '['").head()
    if first is not None:
        raise ValueError(f"{path} is not a JSON array")


def persona_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Sessions of persona files (JSON arrays); of several files with one id the last file wins."""
    _check_array(spark, path)
    raw = spark.read.schema(s.SESSION).option("multiLine", True).json(path).withColumn("persona_file", F.input_file_name())
    return keep_one(raw.where("session_id is not null"), ["session_id"], ["persona_file"], last=True)


def manifest_object(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object keyed by custom_id, one row per entry."""
    text = spark.read.text(path, wholetext=True)
    entries = F.map_entries(F.from_json("value", T.MapType(T.StringType(), s.MANIFEST)))
    return text.select(F.posexplode(entries).alias("entry_no", "e")).select("entry_no", F.col("e.key").alias("custom_id"), "e.value.*")


def gold_evidence_by_url(manifest: DataFrame) -> DataFrame:
    """url to evidence, the last entry wins."""
    e = manifest.where("evidence.url is not null and trim(evidence.url) <> ''")
    return e.groupBy(F.col("evidence.url").alias("url")).agg(F.max_by("evidence", F.struct("entry_no", "custom_id")).alias("evidence"))


def evidence_id_to_url(spark: SparkSession, path: str) -> DataFrame:
    """The map of evidence to url; blank ids and urls are dropped."""
    return spark.read.schema(s.EVIDENCE_URL).json(path).where("trim(evidence_id) <> '' and trim(url) <> ''")


def audit_map(spark: SparkSession, path: str) -> DataFrame:
    """Audit results: error rows and blank ids out, missing key turns are empty, the last row of an id wins."""
    # Spark may read files and blocks in any order; the order of rows is that of file, block and row in it.
    raw = spark.read.schema(s.AUDIT).json(path).select("*", F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id()).alias("__at"))
    ok = raw.where("error is null and trim(session_id) <> ''").withColumn("key_information", F.coalesce("key_information", F.array().cast("array<int>")))
    return keep_one(ok, ["session_id"], ["__at"], last=True).drop("__at")


def run_files(spark: SparkSession, path: str) -> DataFrame:
    """Runs of one file by its suffix, or of all ``agent_*`` files of a folder, united by name."""
    if path.endswith((".jsonl", ".json")):
        return spark.read.schema(s.RUN).json(path)
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    if path.endswith((".csv", ".tsv")):
        return spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("sep", "\t" if path.endswith(".tsv") else ",").csv(path)
    lines = spark.read.schema(s.RUN).option("pathGlobFilter", "agent_*.jsonl").json(path)
    try:
        table = run_csv_folder(spark, path)
    except ValueError:
        return lines
    return lines.unionByName(table, allowMissingColumns=True)


def run_csv_folder(spark: SparkSession, path: str) -> DataFrame:
    """Runs of the ``agent_*.csv`` files of a folder; array columns are JSON cells, as the writer makes them."""
    df = spark.read.option("header", True).option("enforceSchema", False).option("multiLine", True).option("escape", '"').option("pathGlobFilter", "agent_*.csv").csv(path)
    if not df.columns:
        raise ValueError("no CSV files")
    read = lambda f: F.from_json(f.name, f.dataType) if isinstance(f.dataType, T.ArrayType) else F.col(f.name).cast(f.dataType)
    return df.select(*[read(f).alias(f.name) for f in s.RUN if f.name in df.columns])


def failures(spark: SparkSession, path: str) -> DataFrame:
    """Failed runs; on Parquet the filter and the projection reach the scan."""
    from ..operators.reports import FAILED

    columns = ["question_idx", "agent", "variant", "eval_persona", "question_type", "latency_s", "input_tokens", "output_tokens", "total_tokens", "prediction", "gold_answer"]
    return run_files(spark, path).where(F.col("prediction") == FAILED).select(*columns)


def newest(spark: SparkSession, folder: str, pattern: str) -> str:
    """The lexicographically last file of a folder that matches a glob."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{pattern}")
    found = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop)
    if not found:
        raise FileNotFoundError(f"{folder}/{pattern}")
    return max(f.getPath().toString() for f in found)


def resume(todo: DataFrame, spark: SparkSession, path: str, key: str) -> DataFrame:
    """Rows of ``todo`` without a sound result in ``path``: rows with an error are tried again.

    A missing or unreadable file means nothing is done.
    """
    try:
        done = spark.read.json(path)
        if key not in done.columns:
            return todo
        if "error" in done.columns:
            done = done.where("error is null")
    except Exception:  # noqa: BLE001
        return todo
    return pending(todo, done, key)


def persona_by_query(df: DataFrame) -> DataFrame:
    """query to persona; an error for an empty map or a query with two personas."""
    g = df.groupBy(F.trim("query").alias("query")).agg(F.min("persona").alias("persona"), F.count_distinct("persona").alias("n"))
    bad = g.where("n > 1").head()
    if bad is not None:
        raise ValueError(f"two personas for {bad['query']}")
    if g.isEmpty():
        raise ValueError("no personas")
    return g.drop("n")


def questions(spark: SparkSession, path: str, personas: DataFrame | None = None) -> DataFrame:
    """The questions file: ids resolved, evidence of all four arrays with scoped ids, hops counted where missing.

    ``personas`` (query, persona) names the persona of questions that have none; others are tbd.
    """
    raw = spark.read.schema(s.QUESTION).json(path).withColumn("question_idx", ids.normal_question_idx(F.col("question_idx")))
    raw = raw.withColumn("question_id", ids.resolve_question_id(F.col("question_id"), F.col("question_idx"), F.col("query"), F.monotonically_increasing_id()))
    for name in ("memory_evidence", "evidence_list", "golden_memory_evidence", "golden_document_evidence"):
        raw = raw.withColumn(name, ids.with_evidence_ids(F.col("question_id"), F.col(name)))
    raw = raw.withColumn("hop_count", F.coalesce("hop_count", hop_count(F.col("golden_memory_evidence"), F.col("golden_document_evidence"))))
    if personas is None:
        return raw.withColumn("original_persona", F.coalesce("original_persona", F.lit("tbd")))
    return attach_persona(raw, persona_by_query(personas)).withColumn("original_persona", F.coalesce("original_persona", "persona")).drop("persona")


def fillers(sessions: DataFrame) -> dict[str, DataFrame]:
    """Filler conversations by the origin named in their id."""
    return {name: sessions.where(F.contains("session_id", F.lit(name))) for name in ("ultrachat", "sharegpt")}


def batch_sessions(output: DataFrame, manifest: DataFrame) -> DataFrame:
    """Generated sessions joined to their manifest entry, with a parse error or the turns.

    The errors are no_response, empty_body, no_output, no_content, no_text, json_decode and session_validate (4 to 10
    turns, known roles). An id that the manifest lacks is an error.
    """
    lost = output.join(manifest, "custom_id", "left_anti").head()
    if lost is not None:
        raise ValueError(f"unknown custom_id {lost['custom_id']}")
    out = F.get(F.col("response.body.output"), F.lit(0))
    content = F.get(out["content"], F.lit(0))
    text = content["text"]
    turns = F.from_json(text, s.TURNS)["turns"]
    sound = F.size(turns).between(4, 10) & F.forall(turns, lambda t: t["role"].isin("user", "assistant"))
    error = (
        F.when(F.col("response").isNull(), "no_response")
        .when(F.col("response.body").isNull(), "empty_body")
        .when(out.isNull(), "no_output")
        .when(content.isNull(), "no_content")
        .when(F.coalesce(text, F.lit("")) == "", "no_text")
        .when(turns.isNull(), "json_decode")
        .when(~sound, "session_validate")
    )
    rows = output.select("custom_id", error.alias("session_parse_error"), F.when(error.isNull(), turns).alias("session"))
    return rows.join(manifest, "custom_id")


def evidence_cell(cell: Column) -> Column:
    """A JSON cell of evidence as an array; null, blank and unreadable ones are empty."""
    return F.coalesce(F.from_json(cell, T.ArrayType(s.EVIDENCE)), F.array().cast(T.ArrayType(s.EVIDENCE)))


def failed_generation(error: Column) -> Column:
    """The JSON text inside an error message that carries a failed generation."""
    found = F.regexp_extract(F.coalesce(error, F.lit("")), r"failed_generation['\"]?\s*:\s*(['\"]?)(\{.*\})\1\s*\}", 2)
    return F.when((found != "") & F.try_parse_json(found).isNotNull(), found)
