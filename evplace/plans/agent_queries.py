"""Agents, prompts and streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import agents, retrieval
from ..session import materialise
from ..sources.tables import table
from ..streaming import runs as streaming
from . import views as v
from ..functions import ids
from .evidence_queries import _EVAL
from .retrieval_queries import _BM25, _HALVES, _asked, _bm25_top, _chunks, _halves, _memory

QUERIES = {}
SQL = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query(f"""WITH {v.EVIDENCE}, {v.QUESTIONS}, l AS (SELECT q.question_idx, e.row_id, concat_ws('; ', 'Title: ' || title, 'Source: ' || source, CASE WHEN question_type = 'temporal_query' THEN 'Published: ' || published_at END, 'Fact: ' || fact) AS line
      FROM questions q JOIN evidence e ON e.source_question_id = q.question_id), n AS (SELECT question_idx, row_number() OVER (PARTITION BY question_idx ORDER BY row_id) AS i, line FROM l),
    e2 AS (SELECT question_idx, string_agg(i || '. ' || line, chr(10) ORDER BY i) AS evidence FROM n GROUP BY 1)
    SELECT question_idx, 'Evidence:' || chr(10) || evidence || chr(10) || chr(10) || 'Question: ' || query AS prompt FROM questions JOIN e2 USING (question_idx)""")
def golden_context_prompt(spark, d):
    """The prompt of the golden-context baseline."""
    q = v.questions(spark, d).select("question_idx", "question_type", "query", F.col("question_id").alias("source_question_id"))
    rows = q.join(v.evidence(spark, d).withColumnRenamed("row_id", "ordinal"), "source_question_id")
    block = agents.evidence_block(rows, "question_idx", F.col("question_type") == "temporal_query")
    return q.join(block, "question_idx").select("question_idx", F.concat(F.lit("Evidence:\n"), "evidence", F.lit("\n\nQuestion: "), "query").alias("prompt"))


@query(f"WITH {v.QUESTIONS} SELECT question_idx, 'Question: ' || query AS prompt FROM questions")
def no_context_prompt(spark, d):
    return v.questions(spark, d).select("question_idx", F.concat(F.lit("Question: "), "query").alias("prompt"))


def _found(spark, d, k=10):
    return _bm25_top(spark, d, k).join(_chunks(spark, d), "chunk_id").select("query_id", "chunk_id", "rank", "text", F.lit("document").alias("source_type"))


def _stub_sql(prompts: str, passage: str) -> str:
    """The answers of the offline client over (key, prompt): ``passage`` finds the first passage and the number of passages is counted."""
    n = f"len(regexp_extract_all(prompt, '(?m){passage}.'))"
    first = f"regexp_extract(prompt, '(?m){passage}(.*)$', 1)"
    words = "string_split_regex(trim(f), '[\\s\\p{Z}]+')"
    return f"""x AS ({prompts}), y AS (SELECT *, {n} AS n, {first} AS f FROM x),
      z AS (SELECT *, CASE WHEN n = 0 THEN 'Insufficient information' ELSE left(array_to_string({words}[1:7], ' '), 70) END AS final_answer, n || ' passages' AS reasoning FROM y)"""


_WORDS = "len(list_filter(string_split_regex(prompt, '[\\s\\p{Z}]+'), lambda x: x <> ''))::INT"


@query(f"""WITH {_BM25}, {_stub_sql("SELECT query_id, query, 'Passages:' || chr(10) || 'From documents:' || chr(10) || block || chr(10) || chr(10) || 'Question: ' || query AS prompt FROM (SELECT query_id, string_agg('[D' || rank || '] ' || coalesce(e.title, '') || ' ' || coalesce(e.fact, ''), chr(10) ORDER BY rank) AS block FROM bm JOIN evidence e ON e.evidence_id = bm.chunk_id GROUP BY 1) JOIN questions ON question_idx = query_id", "^\\[D[0-9]+\\] ")}
    SELECT query_id, query, final_answer, reasoning, NULL::VARCHAR AS inference_error, {_WORDS} AS input_tokens FROM z""")
def naive_rag_stub(spark, d):
    return agents.build_agent("agent_1")(_asked(spark, d).select("query_id", "query"), _found(spark, d)).drop("output_tokens")


def _retriever(spark, d):
    """Search in both channels; each corpus is tokenised and counted once, whatever the number of rounds."""
    chunks = {"document": _chunks(spark, d), "memory": _memory(spark, d).drop("persona")}
    index = {c: retrieval.bm25_index(x) for c, x in chunks.items()}

    def retrieve(channel, asked, seen, k):
        return retrieval.bm25_top_k(index[channel], asked, k, drop=seen).join(chunks[channel], "chunk_id").select("query_id", "chunk_id", "rank", "text")

    return retrieve


@query()
def corrective_v1_stub(spark, d):
    return agents.build_agent("agent_3")(_asked(spark, d).select("query_id", "query"), _retriever(spark, d))


@query()
def corrective_v2_stub(spark, d):
    return agents.build_agent("agent_3_v2")(_asked(spark, d).select("query_id", "query"), _retriever(spark, d))


_GOLDEN = "SELECT question_idx, 'Evidence:' || chr(10) || evidence || chr(10) || chr(10) || 'Question: ' || query AS prompt FROM questions JOIN e2 USING (question_idx)"
_LINES = """l AS (SELECT q.question_idx, e.row_id, concat_ws('; ', 'Title: ' || e.title, 'Source: ' || e.source, CASE WHEN question_type = 'temporal_query' THEN 'Published: ' || e.published_at END, 'Fact: ' || e.fact) AS line
      FROM questions q JOIN evidence e ON e.source_question_id = q.question_id{}), n AS (SELECT question_idx, row_number() OVER (PARTITION BY question_idx ORDER BY row_id) AS i, line FROM l),
    e2 AS (SELECT question_idx, string_agg(i || '. ' || line, chr(10) ORDER BY i) AS evidence FROM n GROUP BY 1)"""


@query(f"""WITH {v.EVIDENCE}, {v.QUESTIONS}, {_LINES.format('')}, {_stub_sql(_GOLDEN, '^[0-9]+[.] ')} SELECT question_idx, final_answer, reasoning, NULL::VARCHAR AS inference_error, {_WORDS} AS input_tokens FROM z""")
def golden_context_stub(spark, d):
    return agents.call_model(golden_context_prompt(spark, d), "prompt").drop("prompt", "output_tokens")


@query(f"""WITH {v.EVIDENCE}, {v.QUESTIONS}, {_HALVES}, {_LINES.format(" JOIN halves h ON h.evidence_id = e.evidence_id AND h.side = 'document'")}, {_stub_sql(_GOLDEN, '^[0-9]+[.] ')}
    SELECT question_idx, final_answer, reasoning, NULL::VARCHAR AS inference_error, {_WORDS} AS input_tokens FROM z""")
def partial_golden_stub(spark, d):
    """The baseline that sees one pool of the gold evidence only: here the half that goes to the documents."""
    q = v.questions(spark, d, "question_type", "query", "question_id").select("question_idx", "question_type", "query", F.col("question_id").alias("source_question_id"))
    pool = _halves(spark, d).where("side = 'document'").select("evidence_id")
    rows = q.join(v.evidence(spark, d).withColumnRenamed("row_id", "ordinal").join(pool, "evidence_id", "left_semi"), "source_question_id")
    block = agents.evidence_block(rows, "question_idx", F.col("question_type") == "temporal_query")
    prompt = q.join(block, "question_idx").select("question_idx", F.concat(F.lit("Evidence:\n"), "evidence", F.lit("\n\nQuestion: "), "query").alias("prompt"))
    return agents.call_model(prompt, "prompt").drop("prompt", "output_tokens")


@query(f"""WITH {v.TURNS} SELECT session_id, [1] AS topic, [1] AS source, [1] AS key_information, NULL::INT[] AS published_at, '' AS notes, NULL::VARCHAR AS error, false AS recovered, true AS all_required_present FROM turns GROUP BY 1""")
def session_audit_stub(spark, d):
    """Audit rows of the chat sessions of the documents."""
    from .evidence_queries import audit_prompts

    rows = audit_prompts(spark, d).withColumn("prompt", F.concat(F.lit("Task: locations\n"), "prompt"))
    return agents.audit_sessions(rows, "prompt", F.lit(False)).drop("input_tokens", "output_tokens")


@query()
def design_run_stub(spark, d):
    """The asked questions under every variant and persona, answered from the stores as each run's delta leaves them."""
    asked = _asked(spark, d).select(F.col("query_id").alias("question_idx"), "query", F.col("question_id").alias("source_question_id"))
    lits = lambda xs: F.explode(F.array(*[F.lit(x) for x in xs]))
    runs = asked.withColumn("variant", lits(("memory_only", "document_only", "integrated"))).withColumn("persona", lits(_EVAL))
    runs = materialise(runs.withColumn("run_id", F.concat_ws("/", "question_idx", "variant", "persona")), "design")
    g = runs.join(_halves(spark, d), "source_question_id").select("run_id", "variant", "side", "url", ids.session_id(F.col("query"), F.col("evidence_id"), F.col("persona")).alias("session_id"))
    near = (F.col("variant") == "memory_only") | ((F.col("variant") == "integrated") & (F.col("side") == "memory"))
    spec = materialise(g.select("run_id", "url", "session_id", near.alias("near")), "spec")
    docs = v.evidence(spark, d, "url", "title", "fact").select(F.col("evidence_id").alias("chunk_id"), "url", F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("fact", F.lit(""))).alias("text"))
    memory = _memory(spark, d)
    hidden = spec.where("near").join(docs, "url").select(F.col("run_id").alias("query_id"), "chunk_id")

    def retrieve(channel, runs):
        """Documents without the excluded ones; per persona the persona's own sessions without the stripped ones, those to ensure among them."""
        ask = runs.select(F.col("run_id").alias("query_id"), "query", "persona")
        if channel == "document":
            out = retrieval.bm25_top_k(docs, ask, 10, exclude=hidden)
            return out.join(docs, "chunk_id").select(F.col("query_id").alias("run_id"), "chunk_id", "rank", "text")
        out = None
        for persona in _EVAL:
            mine = memory.where(F.col("persona") == persona)
            strip = spec.where("not near").join(ask.where(F.col("persona") == persona).select(F.col("query_id").alias("run_id")), "run_id", "left_semi")
            top = retrieval.bm25_top_k(mine, ask.where(F.col("persona") == persona), 10, exclude=strip.select(F.col("run_id").alias("query_id"), F.col("session_id").alias("chunk_id")))
            top = top.join(mine, "chunk_id").select(F.col("query_id").alias("run_id"), "chunk_id", "rank", "text")
            out = top if out is None else out.unionByName(top)
        return out

    out = agents.run_design(runs, retrieve, "agent_1")
    gold = spec.groupBy("run_id").agg(F.array_sort(F.collect_set(F.when(F.col("near"), F.col("session_id")))).alias("golden_memory_session_ids"), F.array_sort(F.collect_set(F.when(~F.col("near"), F.col("url")))).alias("golden_document_urls"))
    return out.join(gold, "run_id", "left")


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events
    WHERE time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR GROUP BY ALL""")
def stream_event_windows(spark, d):
    """The windows that the watermark has passed, two hours behind the newest event."""
    out = streaming.run_to_table(streaming.windowed_counts(streaming.event_stream(spark, d)))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def batch_event_windows(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    g = e.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total")
