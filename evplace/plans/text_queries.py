"""Identities, text functions and chunking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids, text
from ..operators import chunking
from ..operators.relational import with_ordinal
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


@query(f"""WITH {v.QUESTIONS} SELECT question_idx, sha256({v.strip_sql("coalesce(query, '')")}) AS qid, substr(sha256({v.strip_sql("coalesce(query, '')")}), 1, 16) AS fingerprint,
    question_id = sha256({v.strip_sql("coalesce(query, '')")}) AS same FROM questions""")
def question_ids(spark, d):
    q = v.questions(spark, d)
    qid = ids.question_id(F.col("query"))
    return q.select("question_idx", qid.alias("qid"), ids.query_fingerprint(F.col("query")).alias("fingerprint"), (F.col("question_id") == qid).alias("same"))


_JSON = " || ', ' || ".join(f"""'"{f}": ' || to_json({v.strip_sql(f"coalesce({f}, '')")})""" for f in ids.EVIDENCE_FIELDS)


@query(f"WITH {v.EVIDENCE} SELECT evidence_id, left(sha256(source_question_id || chr(10) || '{{' || {_JSON} || '}}'), 32) AS scoped_id FROM evidence")
def scoped_evidence_ids(spark, d):
    e = v.evidence(spark, d)
    return e.select("evidence_id", ids.scoped_evidence_id(F.col("source_question_id"), {f: F.col(f) for f in ids.EVIDENCE_FIELDS}).alias("scoped_id"))


@query(f"""WITH {v.MANIFEST}, {v.QUESTIONS} SELECT custom_id, 'q-' || substr(sha256({v.strip_sql("q.query")}), 1, 16) || '__ev-' || evidence_id || '__p-' || target_persona_id AS session_id
    FROM manifest m JOIN questions q ON m.source_question_id = q.question_id""")
def session_ids(spark, d):
    m = v.manifest(spark, d).join(v.questions(spark, d).select("query", F.col("question_id").alias("source_question_id")), "source_question_id")
    return m.select("custom_id", ids.session_id(F.col("query"), F.col("evidence_id"), F.col("target_persona_id")).alias("session_id"))


@query(f"""WITH {v.MANIFEST}, p AS (SELECT custom_id, string_split(custom_id, '__') AS ps FROM manifest)
    SELECT custom_id, substr(list_filter(ps, lambda x: starts_with(x, 'ev-') AND len(x) > 3)[1], 4) AS ev, substr(list_filter(ps, lambda x: starts_with(x, 'p-') AND len(x) > 2)[1], 3) AS persona FROM p""")
def session_ids_parse(spark, d):
    c = F.col("custom_id")
    return v.manifest(spark, d).select("custom_id", ids.evidence_id_of_session(c).alias("ev"), ids.persona_of_session(c).alias("persona"))


@query(f"WITH {v.QUESTIONS} SELECT question_idx, question_id, row_number() OVER (ORDER BY question_idx) AS block_id FROM questions")
def ordinal_blocks(spark, d):
    return with_ordinal(v.questions(spark, d).select("question_idx", "question_id"), ["question_idx"]).select("question_idx", "question_id", "block_id")


@query(f"""WITH {v.RUNS}, x AS (SELECT run_id, CASE run_id % 3 WHEN 0 THEN question_idx || '.0' WHEN 1 THEN question_idx || '.5' ELSE 'q' || question_idx END AS raw FROM runs)
    SELECT run_id, CASE WHEN try_cast(raw AS DOUBLE) = floor(try_cast(raw AS DOUBLE)) THEN floor(try_cast(raw AS DOUBLE))::BIGINT::VARCHAR ELSE raw END AS idx FROM x""")
def question_idx_normalise(spark, d):
    raw = F.when(F.col("run_id") % 3 == 0, F.concat(F.col("question_idx"), F.lit(".0"))).when(F.col("run_id") % 3 == 1, F.concat(F.col("question_idx"), F.lit(".5"))).otherwise(F.concat(F.lit("q"), "question_idx"))
    return v.runs(spark, d, "question_idx").select("run_id", ids.normal_question_idx(raw).alias("idx"))


@query(f"""WITH {v.QUESTIONS}, x AS (SELECT question_idx, CASE WHEN question_idx % 4 = 0 THEN question_id END AS qid, CASE WHEN question_idx % 4 < 2 THEN question_idx || '.0' WHEN question_idx % 4 = 2 THEN question_idx || '.5' END AS raw, query FROM questions)
    SELECT question_idx, coalesce(qid, CASE WHEN try_cast(raw AS DOUBLE) = floor(try_cast(raw AS DOUBLE)) THEN floor(try_cast(raw AS DOUBLE))::BIGINT::VARCHAR END, sha256({v.strip_sql("query")})) AS resolved FROM x""")
def question_id_resolve(spark, d):
    q = v.questions(spark, d)
    m = F.col("question_idx") % 4
    raw = F.when(m < 2, F.concat("question_idx", F.lit(".0"))).when(m == 2, F.concat("question_idx", F.lit(".5")))
    return q.select("question_idx", ids.resolve_question_id(F.when(m == 0, F.col("question_id")), raw, F.col("query"), F.col("question_idx")).alias("resolved"))


@query(f"WITH {v.RUNS} SELECT run_id, array_to_string({v.em_sql('prediction', False)}, ' ') AS normal FROM runs")
def em_normalise_ascii(spark, d):
    return v.runs(spark, d, "prediction").select("run_id", text.em_normalise_ascii(F.col("prediction")).alias("normal"))


@query(f"WITH {v.RUNS} SELECT run_id, array_to_string({v.em_sql('prediction')}, ' ') AS normal FROM runs")
def em_normalise_unicode(spark, d):
    return v.runs(spark, d, "prediction").select("run_id", text.em_normalise_unicode(F.col("prediction")).alias("normal"))


@query(f"""WITH {v.RUNS} SELECT run_id, {v.em_sql('prediction', False)} = {v.em_sql('gold_answer', False)} AS em_ascii, {v.em_sql('prediction')} = {v.em_sql('gold_answer')} AS em_unicode FROM runs""")
def exact_matches(spark, d):
    r = v.runs(spark, d, "prediction", "gold_answer")
    p, g = F.col("prediction"), F.col("gold_answer")
    return r.select("run_id", text.exact_match(p, g, False).alias("em_ascii"), text.exact_match(p, g).alias("em_unicode"))


@query(f"""WITH {v.RUNS}, t AS (SELECT run_id, {v.em_sql('prediction', False)} AS p, {v.em_sql('gold_answer', False)} AS g FROM runs),
    s AS (SELECT run_id, len(p) AS n, len(g) AS m, coalesce(list_sum(list_transform(list_distinct(p), lambda x: least(len(list_filter(p, lambda y: y = x)), len(list_filter(g, lambda y: y = x))))), 0) AS shared FROM t)
    SELECT run_id, CASE WHEN n = 0 AND m = 0 THEN 1.0::DOUBLE WHEN n = 0 OR m = 0 OR shared = 0 THEN 0.0::DOUBLE ELSE round((2.0 * shared)::DOUBLE / (n + m), 6) END AS f1 FROM s""")
def token_f1(spark, d):
    return v.runs(spark, d, "prediction", "gold_answer").select("run_id", text.token_f1(F.col("prediction"), F.col("gold_answer")).alias("f1"))


@query(f"WITH {v.EVIDENCE} SELECT evidence_id, {v.norm_sql('title')} AS title_norm, {v.norm_sql('fact')} AS fact_norm FROM evidence")
def evidence_textnorm(spark, d):
    return v.evidence(spark, d).select("evidence_id", text.evidence_normalise(F.col("title")).alias("title_norm"), text.evidence_normalise(F.col("fact")).alias("fact_norm"))


@query(f"WITH {v.EVIDENCE} SELECT evidence_id, len({v.norm_sql('title')}) > 0 AND contains({v.norm_sql('fact')}, {v.norm_sql('split_part(title, chr(32), 1)')}) AS covered FROM evidence")
def text_covers(spark, d):
    return v.evidence(spark, d).select("evidence_id", text.covers(F.split_part("title", F.lit(" "), F.lit(1)), F.col("fact")).alias("covered"))


_TAGS = [f"M{i}" for i in range(1, 13)] + [f"D{i}" for i in range(1, 6)]


@query(f"""WITH {v.RUNS}, x AS (SELECT run_id, CASE WHEN run_id % 5 = 0 THEN 'None' ELSE 'Relevant: M' || (run_id % 12 + 1) || ', d' || (run_id % 7 + 1) END AS reply FROM runs),
    y AS (SELECT run_id, reply, list_filter({_TAGS}, lambda t: contains(lower(reply), lower(t))) AS found FROM x)
    SELECT run_id, CASE WHEN contains(lower(reply), 'none') AND len(reply) < 20 THEN '' ELSE array_to_string(found, ',') END AS tags FROM y""")
def grading_reply_parse(spark, d):
    i = F.col("run_id")
    reply = F.when(i % 5 == 0, "None").otherwise(F.concat(F.lit("Relevant: M"), (i % 12 + 1).cast("string"), F.lit(", d"), (i % 7 + 1).cast("string")))
    return v.runs(spark, d, "agent").select("run_id", F.array_join(text.grading_reply(reply, F.array(*[F.lit(t) for t in _TAGS])), ",").alias("tags"))


@query(f"""WITH {v.MANIFEST} SELECT custom_id, array_to_string(turn_range, '-') AS turns, CASE WHEN len(human_message) > 40 THEN substr(human_message, 1, 37) || '...' ELSE human_message END AS short_message,
    strftime(arrived_at, '%Y/%m/%d (%a) %H:%M') AS stamp, strftime(arrived_at, '%B %d, %Y at %I:%M %p UTC') AS human FROM manifest""")
def labels_and_dates(spark, d):
    m = v.manifest(spark, d)
    return m.select("custom_id", text.turn_range_label(F.col("turn_range")).alias("turns"), text.shorten(F.col("human_message"), 40).alias("short_message"),
                    F.date_format("arrived_at", "yyyy/MM/dd (EEE) HH:mm").alias("stamp"), F.date_format("arrived_at", "MMMM dd, yyyy 'at' hh:mm a 'UTC'").alias("human"))


@query(f"WITH {v.TURNS} SELECT session_id, session_id::VARCHAR AS chunk_id, string_agg(role || ': ' || content, chr(10) ORDER BY turn) AS text FROM turns GROUP BY session_id")
def chunk_session(spark, d):
    return chunking.chunk_session(v.turns(spark, d))


_NEXT = "SELECT *, lead(role) OVER w AS nr, lead(content) OVER w AS nc FROM turns WINDOW w AS (PARTITION BY session_id ORDER BY turn)"


@query(f"""WITH {v.TURNS}, n AS ({_NEXT}), k AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY turn) - 1 AS chunk_index,
    'user: ' || content || CASE WHEN nr = 'assistant' THEN chr(10) || 'assistant: ' || nc ELSE '' END AS text FROM n WHERE role = 'user')
    SELECT session_id, session_id || '__pair_' || chunk_index AS chunk_id, chunk_index, text FROM k""")
def chunk_pair(spark, d):
    return chunking.chunk_pair(v.turns(spark, d))


@query(f"""WITH {v.TURNS}, k AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY turn) - 1 AS chunk_index, content AS text FROM turns WHERE role = 'user')
    SELECT session_id, session_id || '__turn_' || chunk_index AS chunk_id, chunk_index, text FROM k""")
def chunk_turn(spark, d):
    return chunking.chunk_turn(v.turns(spark, d))


@query(f"""WITH {v.TURNS}, k AS (SELECT session_id, turn, CASE role WHEN 'user' THEN '[U' || sum((role = 'user')::INT) OVER (PARTITION BY session_id ORDER BY turn) || '] ' WHEN 'assistant' THEN '[A] ' ELSE '[' || upper(role) || '] ' END || content AS line FROM turns)
    SELECT session_id, string_agg(line, chr(10) || chr(10) ORDER BY turn) AS transcript FROM k GROUP BY session_id""")
def transcript_render(spark, d):
    return chunking.transcript(v.turns(spark, d))


_DOC = "concat_ws(chr(10), nullif(concat_ws(chr(10), 'source: ' || source, 'category: ' || category, 'author: ' || author), ''), title, text)"


@query(rf"""WITH w AS (SELECT doc_id AS doc_key, list_filter(string_split_regex({_DOC}, '\s+'), lambda x: x <> '') AS w FROM documents),
    k AS (SELECT doc_key, w, unnest(range(0, CASE WHEN len(w) <= 256 THEN 1 ELSE 1 + ceil((len(w) - 256) / 224.0)::INT END)) AS chunk_index FROM w WHERE len(w) > 0)
    SELECT doc_key, doc_key || '__chunk_' || chunk_index AS chunk_id, chunk_index, array_to_string(w[chunk_index * 224 + 1:chunk_index * 224 + 256], ' ') AS text FROM k""")
def chunk_document_words(spark, d):
    return chunking.chunk_words(table(spark, d, "documents"), "doc_id", chunking.document_text())


@query()
def chunk_document_recursive(spark, d):
    return chunking.chunk_recursive(table(spark, d, "documents"), "doc_id", chunking.document_text())


@query(f"""WITH {v.EVIDENCE}, {v.MANIFEST} SELECT m.custom_id AS session_id, m.custom_id || '__golddoc_0' AS chunk_id, 0 AS chunk_index, e.title || chr(10) || e.fact AS text, 'memory' AS source_type
    FROM manifest m JOIN evidence e USING (evidence_id)""")
def gold_document_memory(spark, d):
    e = v.evidence(spark, d)
    chunks = e.select(F.col("url").alias("doc_key"), F.lit(0).alias("chunk_index"), F.concat_ws("\n", "title", "fact").alias("text"))
    s = v.manifest(spark, d).select(F.col("custom_id").alias("session_id"), "evidence_id")
    return chunking.gold_document_chunks(s, e.select("evidence_id", "url"), chunks)
