"""Scores of retrieval and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.text import covers, evidence_normalise

Z = 1.96


def mixed_top(runs: DataFrame, k: int = 10) -> DataFrame:
    """(run_id, gold_id, rank): the best chunk per url of the documents, then memory, one ranking of k.

    Null scores count as 0; equal scores put documents before memory, then the place in their list.
    """
    doc = runs.select("run_id", F.posexplode("retrieved_documents").alias("pos", "r")).select("run_id", "pos", F.col("r.url").alias("id"), F.coalesce("r.score", F.lit(0.0)).alias("score")).where("id is not null")
    best = W.Window.partitionBy("run_id", "id").orderBy(F.desc("score"), "pos")
    doc = doc.withColumn("__r", F.row_number().over(best)).where("__r = 1").drop("__r").withColumns({"src": F.lit(0), "gold_id": F.concat(F.lit("doc::"), "id")})
    mem = runs.select("run_id", F.posexplode("retrieved_memory").alias("pos", "r")).select("run_id", "pos", F.col("r.session_id").alias("id"), F.coalesce("r.score", F.lit(0.0)).alias("score"))
    mem = mem.where("id is not null").withColumns({"src": F.lit(1), "gold_id": F.concat(F.lit("mem::"), "id")})
    w = W.Window.partitionBy("run_id").orderBy(F.desc("score"), "src", "pos")
    both = doc.unionByName(mem).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return both.select("run_id", "gold_id", "rank")


def chunks_by_score(runs: DataFrame, column: str) -> DataFrame:
    """(run_id, place, r): every retrieved chunk by score, null scores as 0, equal ones as they came; no url is merged."""
    rows = runs.select("run_id", F.posexplode(column).alias("pos", "r"))
    w = W.Window.partitionBy("run_id").orderBy(F.desc(F.coalesce("r.score", F.lit(0.0))), "pos")
    return rows.select("run_id", F.row_number().over(w).alias("place"), "r")


def mixed_recall(runs: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    """Share of each run's gold ids among its first k; null without gold. ``gold``: run_id, gold_id (repeats count)."""
    found = mixed_top(runs, k).select("run_id", "gold_id").distinct().withColumn("hit", F.lit(1))
    n = gold.groupBy("run_id").agg(F.count("*").alias("n_gold"))
    hits = gold.distinct().join(found, ["run_id", "gold_id"]).groupBy("run_id").agg(F.count("*").alias("n_hit"))
    out = runs.select("run_id").join(n, "run_id", "left").join(hits, "run_id", "left").na.fill(0, ["n_gold", "n_hit"])
    return out.withColumn("recall", F.round(F.col("n_hit") / F.nullif("n_gold", F.lit(0)), 6))


def gold_ids(variant: Column, urls: Column, sessions: Column) -> Column:
    """Gold ids of a run: documents unless memory only, sessions unless documents only."""
    empty = F.expr("cast(array() as array<string>)")
    docs = F.when(variant != "memory_only", F.transform(F.coalesce(urls, empty), lambda u: F.concat(F.lit("doc::"), u))).otherwise(empty)
    mem = F.when(variant != "document_only", F.transform(F.coalesce(sessions, empty), lambda s: F.concat(F.lit("mem::"), s))).otherwise(empty)
    return F.concat(docs, mem)


def strict_doc_hit(fact: Column, title: Column, source: Column, texts: Column) -> Column:
    """The pool of one url holds the fact (20 characters or more), else title and source (those that exist)."""
    pool = F.array_join(texts, "\n")
    inside = lambda needle: F.exists(texts, lambda t: covers(needle, t)) | covers(needle, pool)
    has = lambda c: F.length(F.trim(F.coalesce(c, F.lit("")))) > 0
    short = F.when(has(title) & has(source), inside(title) & inside(source)).when(has(title), inside(title)).when(has(source), inside(source)).otherwise(False)
    return F.when(F.coalesce(F.size(texts), F.lit(0)) <= 0, False).when(F.length(F.coalesce(fact, F.lit(""))) >= 20, inside(fact)).otherwise(short)


def match_pairs(retrieved: DataFrame, pairs: DataFrame) -> DataFrame:
    """The one pair chunk of its session that each retrieved text stands for.

    retrieved: key, session_id, text. pairs: session_id, chunk_index, text. One equal text decides; several decide
    nothing; none leaves containment either way, the longest common part, if one is longest.
    """
    norm = pairs.select("session_id", "chunk_index", evidence_normalise(F.col("text")).alias("p"))
    j = retrieved.select("key", "session_id", evidence_normalise(F.col("text")).alias("r")).join(norm, "session_id")
    inside = (F.length("r") > 0) & (F.length("p") > 0) & (F.contains("r", "p") | F.contains("p", "r"))
    j = j.withColumns({"eq": F.col("r") == F.col("p"), "len": F.when(inside, F.least(F.length("r"), F.length("p")))})
    g = j.groupBy("key").agg(
        F.count_if("eq").alias("n_eq"),
        F.min(F.when(F.col("eq"), F.col("chunk_index"))).alias("eq_index"),
        F.max("len").alias("best"),
        F.max_by("chunk_index", "len").alias("best_index"),
        F.collect_list("len").alias("lens"),
    )
    unique = F.size(F.filter("lens", lambda x: x == F.col("best"))) == 1
    return g.select("key", F.when(F.col("n_eq") == 1, F.col("eq_index")).when(F.col("n_eq") > 1, None).when(unique, F.col("best_index")).alias("chunk_index"))


def strict_memory_hits(retrieved: DataFrame, pairs: DataFrame, audit: DataFrame) -> DataFrame:
    """Whether a retrieved text is an audited key turn of its session. audit: session_id, key_information (pair indexes).

    A text that stands for no single pair, or a session without audit, is no hit.
    """
    at = match_pairs(retrieved, pairs).join(retrieved.select("key", "session_id"), "key").join(audit.select("session_id", "key_information"), "session_id", "left")
    return at.select("key", "session_id", F.coalesce(F.array_contains("key_information", F.col("chunk_index").cast("int")), F.lit(False)).alias("hit"))


def strict_recall(document_hits: DataFrame, memory_gold: DataFrame, memory_hits: DataFrame | None = None) -> DataFrame:
    """Share of all gold of a run, documents and sessions, that is hit.

    document_hits: run_id, hit, one row per gold document. memory_gold: run_id, session_id (repeats count). memory_hits:
    run_id, session_id, hit, one row per retrieved text; without it, or for sessions not in it, there is no hit.
    """
    gold = memory_gold.select("run_id", "session_id")
    if memory_hits is None:
        mem = gold.select("run_id", F.lit(False).alias("hit"))
    else:
        best = memory_hits.groupBy("run_id", "session_id").agg(F.max("hit").alias("hit"))
        mem = gold.join(best, ["run_id", "session_id"], "left").select("run_id", "hit")
    both = document_hits.select("run_id", "hit").unionByName(mem).select("run_id", F.coalesce("hit", F.lit(False)).cast("int").alias("hit"))
    return both.groupBy("run_id").agg(F.count("*").alias("n_gold"), F.round(F.avg("hit"), 6).alias("strict_recall"))


def gold_document_hit(document_hit: Column, memory_hit: Column) -> Column:
    """Memory gold that may also be met by the text of its article."""
    return F.coalesce(document_hit, F.lit(False)) | F.coalesce(memory_hit, F.lit(False))


def wilson(n: Column, k: Column) -> tuple[Column, Column]:
    """The 95 % Wilson interval of k of n, clamped to [0, 1]."""
    p = k / n
    centre = (p + Z * Z / (2 * n)) / (1 + Z * Z / n)
    half = Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n)) / (1 + Z * Z / n)
    return F.round(F.greatest(F.lit(0.0), centre - half), 6), F.round(F.least(F.lit(1.0), centre + half), 6)
