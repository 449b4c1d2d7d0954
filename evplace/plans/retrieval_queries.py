"""Retrieval, hybrid ranking and store deltas."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids
from ..operators import retrieval as r
from ..operators.sampling import split_fifty_fifty
from ..session import materialise
from ..sources.tables import table
from . import views as v

QUERIES = {}
SQL = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _chunks(spark, d):
    return v.evidence(spark, d, "title", "fact").select(F.col("evidence_id").alias("chunk_id"), F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("fact", F.lit(""))).alias("text"))


def _memory(spark, d):
    return v.manifest(spark, d, "scenario", "human_message", "target_persona_id").select(F.col("custom_id").alias("chunk_id"), F.concat_ws(" ", F.coalesce("scenario", F.lit("")), F.coalesce("human_message", F.lit(""))).alias("text"), F.col("target_persona_id").alias("persona"))


def _asked(spark, d):
    return v.questions(spark, d, "query", "question_id").where(F.col("question_idx") % v.SEARCH_STEP == 0).select(F.col("question_idx").alias("query_id"), "query", "question_id")


def _bm25_top(spark, d, k=10):
    return r.bm25_top_k(_chunks(spark, d), _asked(spark, d), k)


_TERMS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"
_BM25 = f"""{v.EVIDENCE}, {v.QUESTIONS},
  c AS (SELECT evidence_id AS chunk_id, {_TERMS.format("coalesce(title, '') || ' ' || coalesce(fact, '')")} AS t FROM evidence),
  q AS (SELECT question_idx AS query_id, question_id, unnest(list_distinct({_TERMS.format("query")})) AS term FROM questions WHERE question_idx % {v.SEARCH_STEP} = 0),
  st AS (SELECT count(*) AS n, sum(len(t)) / count(*) AS mean FROM c),
  p AS (SELECT chunk_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT chunk_id, len(t) AS dl, unnest(t) AS term FROM c) GROUP BY ALL),
  f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
  s AS (SELECT query_id, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean))), 6) AS score
    FROM q JOIN p USING (term) JOIN f USING (term), st GROUP BY ALL),
  bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s QUALIFY rank <= 10)"""


@query(f"WITH {_BM25} SELECT query_id, chunk_id, score, rank FROM bm")
def bm25_topk(spark, d):
    return _bm25_top(spark, d).select("query_id", "chunk_id", "score", "rank")


@query(f"""WITH {_BM25}, g AS (SELECT q.query_id, e.evidence_id AS chunk_id FROM (SELECT DISTINCT query_id, question_id FROM q) q JOIN evidence e ON e.source_question_id = q.question_id)
    SELECT g.query_id, count(*) AS n_gold, count(bm.chunk_id) AS n_found, round(count(bm.chunk_id) / count(*), 6) AS recall FROM g LEFT JOIN bm USING (query_id, chunk_id) GROUP BY 1""")
def bm25_recall_at_10(spark, d):
    """Flagship: retrieve evidence for the asked questions by BM25 and measure recall of their own evidence."""
    gold = _asked(spark, d).join(v.evidence(spark, d, "source_question_id").select(F.col("source_question_id").alias("question_id"), F.col("evidence_id").alias("chunk_id")), "question_id").select("query_id", "chunk_id")
    return r.recall_at_k(_bm25_top(spark, d), gold)


@query(f"""WITH {_BM25}, ex AS (SELECT DISTINCT q.query_id, e.evidence_id AS chunk_id FROM q JOIN evidence e ON e.source_question_id = q.question_id),
    cq AS (SELECT * FROM (SELECT qs.query_id, c.chunk_id, len(c.t) AS dl FROM (SELECT DISTINCT query_id FROM q) qs CROSS JOIN c) z ANTI JOIN ex USING (query_id, chunk_id)),
    sq AS (SELECT query_id, count(*) AS n, sum(dl) / count(*) AS mean FROM cq GROUP BY 1),
    pq AS (SELECT q.query_id, p.chunk_id, term, tf, dl FROM q JOIN p USING (term) ANTI JOIN ex ON ex.query_id = q.query_id AND ex.chunk_id = p.chunk_id),
    fq AS (SELECT query_id, term, count(*) AS df FROM pq GROUP BY ALL),
    xs AS (SELECT query_id, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean))), 6) AS score FROM pq JOIN fq USING (query_id, term) JOIN sq USING (query_id) GROUP BY ALL)
    SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM xs QUALIFY rank <= 10""")
def bm25_under_delta(spark, d):
    """BM25 when a question's own evidence is taken out of its corpus, statistics and all."""
    asked = _asked(spark, d)
    own = asked.join(v.evidence(spark, d, "source_question_id").select(F.col("source_question_id").alias("question_id"), F.col("evidence_id").alias("chunk_id")), "question_id").select("query_id", "chunk_id")
    return r.bm25_top_k(_chunks(spark, d), asked, 10, exclude=own).select("query_id", "chunk_id", "score", "rank")


def _vectors(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return e.withColumnRenamed("vec_id", "chunk_id"), e.where(F.col("vec_id") % v.SEARCH_STEP == 0).withColumnRenamed("vec_id", "query_id")


_DENSE = f"""d AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, round(list_sum(list_transform(list_zip(q.embedding, c.embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)), 6) AS score
    FROM embeddings q, embeddings c WHERE q.vec_id % {v.SEARCH_STEP} = 0),
  dr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM d)"""


@query(f"WITH {_DENSE} SELECT query_id, chunk_id, round(score + 1e-9, 4) AS score, rank FROM dr WHERE rank <= 10")
def dense_topk(spark, d):
    c, q = _vectors(spark, d)
    return r.dense_top_k(c, q, 10).select("query_id", "chunk_id", F.round(F.col("score") + 1e-9, 4).alias("score"), "rank")


@query(f"WITH {_DENSE} SELECT query_id, chunk_id, round(score + 1e-9, 4) AS score, rank FROM dr WHERE rank <= 10 AND score >= 0.25")
def dense_min_score(spark, d):
    c, q = _vectors(spark, d)
    return r.dense_top_k(c, q, 10, min_score=0.25).select("query_id", "chunk_id", F.round(F.col("score") + 1e-9, 4).alias("score"), "rank")


@query(f"""WITH {_DENSE}, seen AS (SELECT query_id, chunk_id FROM dr WHERE rank <= 3)
    SELECT query_id, chunk_id, round(score + 1e-9, 4) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM d ANTI JOIN seen USING (query_id, chunk_id) QUALIFY rank <= 5""")
def dense_exclude_seen(spark, d):
    """A second round of retrieval that leaves out what the first one returned."""
    c, q = _vectors(spark, d)
    seen = r.dense_top_k(c, q, 3).select("query_id", "chunk_id")
    return r.dense_top_k(c, q, 5, exclude=seen).select("query_id", "chunk_id", F.round(F.col("score") + 1e-9, 4).alias("score"), "rank")


def _hashed(spark, d):
    c = r.hashed_vectors(_chunks(spark, d), "chunk_id", "text")
    q = r.hashed_vectors(_asked(spark, d), "query_id", "query", "query_id")
    return c, q


_HASHED = f"""w AS (SELECT 'c' AS kind, chunk_id AS id, unnest(t) AS term FROM c
    UNION ALL SELECT 'q', question_idx::VARCHAR, unnest({_TERMS.format("query")}) FROM questions WHERE question_idx % {v.SEARCH_STEP} = 0),
  sl AS (SELECT kind, id, ('0x' || substr(md5(term), 1, 8))::BIGINT % 64 AS slot, count(*)::DOUBLE AS n FROM w GROUP BY ALL),
  nm AS (SELECT kind, id, sqrt(sum(n * n)) AS norm FROM sl GROUP BY ALL),
  un AS (SELECT kind, id, slot, n / norm AS x FROM sl JOIN nm USING (kind, id)),
  hs AS (SELECT a.id::BIGINT AS query_id, b.id AS chunk_id, round(sum(a.x * b.x), 6) AS score FROM un a JOIN un b USING (slot) WHERE a.kind = 'q' AND b.kind = 'c' GROUP BY ALL),
  hr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM hs QUALIFY rank <= 10)"""


@query(f"WITH {_BM25}, {_HASHED} SELECT query_id, chunk_id, score, rank FROM hr")
def hashed_dense_topk(spark, d):
    c, q = _hashed(spark, d)
    return r.dense_top_k(c, q, 10).select("query_id", "chunk_id", "score", "rank")


@query(f"""WITH {_BM25}, {_HASHED}, u AS (SELECT query_id, chunk_id, rank FROM bm UNION ALL SELECT query_id, chunk_id, rank FROM hr),
    z AS (SELECT query_id, chunk_id, round(sum(0.5::DOUBLE / (60 + rank)), 8) AS score FROM u GROUP BY ALL)
    SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM z QUALIFY rank <= 10""")
def hybrid_rrf(spark, d):
    c, q = _hashed(spark, d)
    return r.reciprocal_rank_fusion([(_bm25_top(spark, d), 0.5), (r.dense_top_k(c, q, 10), 0.5)], 10).select("query_id", "chunk_id", "score", "rank")


@query(f"""WITH {v.MANIFEST}, {v.EVIDENCE}, {v.QUESTIONS},
  c AS (SELECT evidence_id AS chunk_id, 'document' AS source_type, {_TERMS.format("coalesce(title, '') || ' ' || coalesce(fact, '')")} AS t FROM evidence
    UNION ALL SELECT custom_id, 'memory', {_TERMS.format("coalesce(scenario, '') || ' ' || coalesce(human_message, '')")} FROM manifest),
  q AS (SELECT question_idx AS query_id, unnest(list_distinct({_TERMS.format("query")})) AS term FROM questions WHERE question_idx % {v.SEARCH_STEP} = 0),
  st AS (SELECT count(*) AS n, sum(len(t)) / count(*) AS mean FROM c),
  p AS (SELECT chunk_id, source_type, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT chunk_id, source_type, len(t) AS dl, unnest(t) AS term FROM c) GROUP BY ALL),
  f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
  s AS (SELECT query_id, chunk_id, source_type, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean))), 6) AS score
    FROM q JOIN p USING (term) JOIN f USING (term), st GROUP BY ALL),
  k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s QUALIFY rank <= 20)
  SELECT query_id, chunk_id, score, rank FROM k WHERE source_type = 'memory'""")
def unified_topk_memory(spark, d):
    """One ranking over documents and memory; the source filter comes after the cut."""
    mem = _memory(spark, d).drop("persona").withColumn("source_type", F.lit("memory"))
    both = _chunks(spark, d).withColumn("source_type", F.lit("document")).unionByName(mem)
    top = r.bm25_top_k(both, _asked(spark, d), 20)
    return top.join(mem.select("chunk_id"), "chunk_id", "left_semi").select("query_id", "chunk_id", "score", "rank")


# Per-run store deltas: gold of a run by variant.


def _halves(spark, d):
    return split_fifty_fifty(v.evidence(spark, d, "source_question_id", "url").select("source_question_id", "evidence_id", "url"), "source_question_id", "evidence_id")


def _gold(spark, d):
    """run_id, persona, variant, url, session_id, side of every gold evidence of a run."""
    q = v.questions(spark, d, "question_id", "query").select("question_idx", F.col("question_id").alias("source_question_id"), "query")
    run = v.runs(spark, d, "question_idx", "eval_persona", "variant").join(q, "question_idx")
    g = run.join(_halves(spark, d), "source_question_id")
    return g.select("run_id", F.col("eval_persona").alias("persona"), "variant", "url", ids.session_id(F.col("query"), F.col("evidence_id"), F.col("eval_persona")).alias("session_id"), "side")


def _delta(spark, d):
    g = materialise(_gold(spark, d), "gold")  # read three times
    variant, side = F.col("variant"), F.col("side")
    exclude = g.where((variant == "memory_only") | ((variant == "integrated") & (side == "memory"))).select("run_id", "url")
    ensure = g.where((variant == "memory_only") | ((variant == "integrated") & (side == "memory"))).select("run_id", "session_id")
    strip = g.where((variant == "document_only") | ((variant == "integrated") & (side == "document"))).select("run_id", "session_id")
    return exclude, ensure, strip


_HALVES = f"""hv AS (SELECT source_question_id, evidence_id, url, count(*) OVER w AS n, row_number() OVER (PARTITION BY source_question_id ORDER BY {v.hash_sql(42, 'source_question_id', 'evidence_id')}, evidence_id) AS rn,
    ('0x' || substr({v.hash_sql(42, "'coin'", 'source_question_id')}, 1, 8))::BIGINT % 2 AS coin FROM evidence WINDOW w AS (PARTITION BY source_question_id)),
  halves AS (SELECT source_question_id, evidence_id, url, CASE WHEN rn <= n // 2 + (CASE WHEN n % 2 = 1 AND coin = 0 THEN 1 ELSE 0 END) THEN 'memory' ELSE 'document' END AS side FROM hv)"""
_GOLD = f"""{v.RUNS}, {v.QUESTIONS}, {v.EVIDENCE}, {_HALVES},
  gold AS (SELECT r.run_id, r.eval_persona AS persona, r.variant, h.url, 'q-' || substr(sha256({v.strip_sql('q.query')}), 1, 16) || '__ev-' || h.evidence_id || '__p-' || r.eval_persona AS session_id, h.side
    FROM runs r JOIN questions q USING (question_idx) JOIN halves h ON h.source_question_id = q.question_id),
  ex AS (SELECT run_id, url FROM gold WHERE variant = 'memory_only' OR (variant = 'integrated' AND side = 'memory')),
  en AS (SELECT run_id, session_id FROM gold WHERE variant = 'memory_only' OR (variant = 'integrated' AND side = 'memory')),
  sp AS (SELECT run_id, session_id FROM gold WHERE variant = 'document_only' OR (variant = 'integrated' AND side = 'document'))"""


@query(f"WITH {v.EVIDENCE}, {_HALVES} SELECT source_question_id, evidence_id, side FROM halves")
def split_fifty_fifty_sides(spark, d):
    return _halves(spark, d).select("source_question_id", "evidence_id", "side")


@query(f"""WITH {_GOLD}, a AS (SELECT run_id, string_agg(url, '|' ORDER BY url) AS exclude_urls FROM (SELECT DISTINCT * FROM ex) GROUP BY 1), b AS (SELECT run_id, string_agg(session_id, '|' ORDER BY session_id) AS ensure_sessions FROM (SELECT DISTINCT * FROM en) GROUP BY 1),
    c AS (SELECT run_id, string_agg(session_id, '|' ORDER BY session_id) AS strip_sessions FROM (SELECT DISTINCT * FROM sp) GROUP BY 1)
    SELECT run_id, coalesce(exclude_urls, '') AS exclude_urls, coalesce(ensure_sessions, '') AS ensure_sessions, coalesce(strip_sessions, '') AS strip_sessions FROM runs LEFT JOIN a USING (run_id) LEFT JOIN b USING (run_id) LEFT JOIN c USING (run_id)""")
def prepare_spec(spark, d):
    """What each run excludes, ensures and strips, as texts; runs without evidence have no delta."""
    g = _gold(spark, d)
    variant, side = F.col("variant"), F.col("side")
    near = (variant == "memory_only") | ((variant == "integrated") & (side == "memory"))
    far = (variant == "document_only") | ((variant == "integrated") & (side == "document"))
    join = lambda cond, c: F.array_join(F.array_sort(F.collect_set(F.when(cond, F.col(c)))), "|")
    spec = g.groupBy("run_id").agg(join(near, "url").alias("exclude_urls"), join(near, "session_id").alias("ensure_sessions"), join(far, "session_id").alias("strip_sessions"))
    return v.runs(spark, d, "variant").select("run_id").join(spec, "run_id", "left").na.fill("")


@query(f"""WITH {_GOLD}, {v.MANIFEST},
  mem AS (SELECT target_persona_id AS persona, custom_id AS session_id, len(string_split_regex(coalesce(human_message, ''), '\\s+')) AS words FROM manifest),
  docs AS (SELECT url, len(string_split_regex(coalesce(fact, ''), '\\s+')) AS words FROM evidence),
  per AS (SELECT persona, count(*) AS m_n, sum(words) AS m_w FROM mem GROUP BY 1), tot AS (SELECT count(*) AS n, sum(words) AS w FROM docs),
  gone AS (SELECT r.run_id, count(*) AS o_n, sum(m.words) AS o_w FROM sp JOIN runs r USING (run_id) JOIN mem m ON m.session_id = sp.session_id AND m.persona = r.eval_persona GROUP BY 1),
  add AS (SELECT r.run_id, count(*) AS i_n, coalesce(sum(one.words), 0) AS i_w FROM en JOIN runs r USING (run_id) LEFT JOIN mem m ON m.session_id = en.session_id AND m.persona = r.eval_persona
    LEFT JOIN sp ON sp.run_id = en.run_id AND sp.session_id = en.session_id LEFT JOIN (SELECT session_id, max(words) AS words FROM mem GROUP BY 1) one ON one.session_id = en.session_id
    WHERE m.session_id IS NULL OR sp.session_id IS NOT NULL GROUP BY 1),
  cut AS (SELECT run_id, count(*) AS c_n, sum(words) AS c_w FROM ex JOIN docs USING (url) GROUP BY 1)
  SELECT r.run_id, (coalesce(m_n, 0) - coalesce(o_n, 0) + coalesce(i_n, 0))::BIGINT AS n_memory, (coalesce(m_w, 0) - coalesce(o_w, 0) + coalesce(i_w, 0))::BIGINT AS memory_words,
    (n - coalesce(c_n, 0))::BIGINT AS n_docs, (w - coalesce(c_w, 0))::BIGINT AS doc_words
  FROM runs r LEFT JOIN per ON per.persona = r.eval_persona LEFT JOIN gone USING (run_id) LEFT JOIN add USING (run_id) LEFT JOIN cut USING (run_id), tot""")
def candidates_after_delta(spark, d):
    exclude, ensure, strip = _delta(spark, d)
    words = lambda c: F.size(F.split(F.coalesce(F.col(c), F.lit("")), r"\s+"))
    mem = v.manifest(spark, d, "target_persona_id", "human_message").select(F.col("target_persona_id").alias("persona"), F.col("custom_id").alias("session_id"), words("human_message").alias("words"))
    docs = v.evidence(spark, d, "url", "fact").select("url", words("fact").alias("words"))
    run = v.runs(spark, d, "eval_persona").select("run_id", F.col("eval_persona").alias("persona"))
    return r.delta_counts(run, mem, docs, strip, ensure, exclude)
