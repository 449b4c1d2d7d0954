"""Views that queries share, each with its SQL twin (first delivery of every record)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import category_key
from ..operators.chunking import session_turns
from ..operators.relational import keep_one
from ..sources.tables import table

SEARCH_STEP = 50  # searches take every row whose id is divisible by this as a query


def _first(df: DataFrame, key: str, order: str, columns: tuple[str, ...]) -> DataFrame:
    """The first delivery of every record; named columns keep all others out of the shuffle."""
    return keep_one(df.select(*dict.fromkeys([key, order, *columns])) if columns else df, [key], [order])


def runs(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return _first(table(spark, d, "labeled_runs"), "run_id", "arrived_at", columns)


def questions(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return _first(table(spark, d, "experiment_questions"), "question_idx", "arrived_at", columns)


def evidence(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return _first(table(spark, d, "evidence_items"), "evidence_id", "row_id", columns)


def manifest(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return _first(table(spark, d, "session_manifest"), "custom_id", "arrived_at", columns)


def screening(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return _first(table(spark, d, "screening_results"), "result_id", "arrived_at", columns)


def turns(spark: SparkSession, d: str) -> DataFrame:
    return session_turns(table(spark, d, "documents").where("doc_kind = 'session'"), "doc_id", "text")


def question_categories(spark: SparkSession, d: str) -> DataFrame:
    """question_idx, question_id and the sorted distinct categories of its evidence."""
    cats = evidence(spark, d, "source_question_id", "category").groupBy(F.col("source_question_id").alias("question_id")).agg(F.array_sort(F.array_compact(F.collect_set(category_key(F.col("category"))))).alias("categories"))
    q = questions(spark, d, "question_id", "original_persona", "question_type").drop("arrived_at")
    return q.join(cats, "question_id", "left").withColumn("categories", F.coalesce("categories", F.expr("cast(array() as array<string>)")))


def run_categories(spark: SparkSession, d: str) -> DataFrame:
    r = runs(spark, d, "question_idx", "eval_persona", "variant", "agent")
    return r.join(question_categories(spark, d).select("question_idx", "categories"), "question_idx")


# The same views for DuckDB.
RUNS = "runs AS (SELECT * FROM labeled_runs QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY arrived_at) = 1)"
QUESTIONS = "questions AS (SELECT * FROM experiment_questions QUALIFY row_number() OVER (PARTITION BY question_idx ORDER BY arrived_at) = 1)"
EVIDENCE = "evidence AS (SELECT * FROM evidence_items QUALIFY row_number() OVER (PARTITION BY evidence_id ORDER BY row_id) = 1)"
MANIFEST = "manifest AS (SELECT * FROM session_manifest QUALIFY row_number() OVER (PARTITION BY custom_id ORDER BY arrived_at) = 1)"
SCREENING = "screening AS (SELECT * FROM screening_results QUALIFY row_number() OVER (PARTITION BY result_id ORDER BY arrived_at) = 1)"
TURNS = r"""raw_turns AS (
    SELECT doc_id AS session_id, list_filter(string_split(regexp_replace(text, '(^|\n)(User|Assistant|System): ', chr(1) || '\2' || chr(2), 'g'), chr(1)), lambda p: contains(p, chr(2))) AS ps
    FROM documents WHERE doc_kind = 'session'),
  turns AS (SELECT session_id, i - 1 AS turn, lower(split_part(ps[i], chr(2), 1)) AS role, split_part(ps[i], chr(2), 2) AS content
    FROM (SELECT session_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM raw_turns))"""
CATEGORIES = f"""{QUESTIONS}, {EVIDENCE},
  cats AS (SELECT source_question_id AS question_id, list_sort(list_distinct(list(nullif(lower(regexp_replace(category, '^\\s+|\\s+$', '', 'g')), '')))) AS categories FROM evidence GROUP BY 1),
  qcats AS (SELECT q.question_idx, q.question_id, q.original_persona, q.question_type, list_filter(coalesce(categories, []), lambda x: x IS NOT NULL) AS categories
    FROM questions q LEFT JOIN cats USING (question_id))"""
DOMAINS = "domains AS (SELECT * FROM (VALUES ('persona_1', ['technology']), ('persona_2', ['business', 'technology']), ('persona_3', ['sports'])) AS t(persona, domains))"


def strip_sql(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def em_sql(c: str, unicode: bool = True) -> str:
    """The tokens of an answer without punctuation and articles."""
    punct = r"[^\p{L}\p{N}_\s]" if unicode else r"[!\"#$%&''()*+,\-./:;<=>?@\[\\\]^_`{|}~]"
    stripped = strip_sql("coalesce(" + c + ", '')")
    return rf"list_filter(string_split_regex(regexp_replace(lower({stripped}), '{punct}', '', 'g'), '\s+'), lambda w: w NOT IN ('', 'a', 'an', 'the'))"


def norm_sql(c: str) -> str:
    """Evidence normalisation."""
    inner = strip_sql(f"coalesce({c}, '')")
    quotes = "[\"''`‘’“”]"
    plain = f"regexp_replace(lower({inner}), '{quotes}', '', 'g')"
    return strip_sql(rf"regexp_replace({plain}, '\s+', ' ', 'g')")


def hash_sql(seed: object, *keys: str) -> str:
    return f"md5(concat_ws('|', '{seed}', {', '.join(keys)}))"


def unit_sql(seed: object, *keys: str) -> str:
    return f"(('0x' || substr({hash_sql(seed, *keys)}, 1, 8))::BIGINT / 4294967296.0)"
