"""Evidence sets, personas, domains, metrics and feature tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import ids, text
from ..operators import evidence as ev
from ..operators import metrics, prompts, relational, reports, sampling
from ..operators.chunking import transcript
from ..operators.chunking import chunk_pair as pair_chunks
from ..session import materialise
from ..sources.tables import table
from . import views as v
from .report_queries import OK_SQL, POOL_COUNTS, pool_inventory_counts
from .retrieval_queries import _GOLD, _gold

QUERIES = {}
SQL = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query("""SELECT source_question_id, evidence_id, min(row_id) AS first_position, arg_max(title, row_id) AS title, arg_max(fact, row_id) AS fact
    FROM evidence_items WHERE evidence_id IS NOT NULL AND trim(evidence_id) <> '' GROUP BY ALL""")
def evidence_union(spark, d):
    e = table(spark, d, "evidence_items").select("source_question_id", "evidence_id", "row_id", "title", "fact")
    return ev.evidence_union(e, "source_question_id", "evidence_id", "row_id")


@query("SELECT evidence_id, min(url) AS url, count(DISTINCT url) AS n_urls FROM evidence_items WHERE trim(evidence_id) <> '' AND trim(url) <> '' GROUP BY 1")
def evidence_url_map(spark, d):
    return ev.evidence_urls(table(spark, d, "evidence_items"))


_PERSONA = "CASE WHEN len(categories) = 0 THEN 'tbd' WHEN categories = ['technology'] THEN 'persona_1' WHEN categories = ['business', 'technology'] THEN 'persona_2' WHEN categories = ['sports'] THEN 'persona_3' ELSE 'persona_4' END"


@query(f"WITH {v.CATEGORIES} SELECT question_idx, array_to_string(categories, '|') AS domains, {_PERSONA} AS persona FROM qcats")
def persona_assign(spark, d):
    q = v.question_categories(spark, d)
    return q.select("question_idx", F.array_join("categories", "|").alias("domains"), ev.persona_for_domains(F.col("categories")).alias("persona"))


@query(f"""WITH {v.CATEGORIES}, t AS (SELECT {_PERSONA} AS persona, unnest(categories) AS c FROM qcats), o AS (SELECT unnest({ev.PERSONA_ORDER}) AS persona, unnest([0, 1, 2, 3, 4])::INT AS place)
    SELECT o.persona, o.place, coalesce(string_agg(DISTINCT c, '|' ORDER BY c), '') AS domains FROM o LEFT JOIN t USING (persona) GROUP BY ALL""")
def persona_domains(spark, d):
    q = v.question_categories(spark, d)
    return ev.persona_domain_table(q.select(ev.persona_for_domains(F.col("categories")).alias("persona"), F.col("categories").alias("domains")))


_RCATS = f"{v.RUNS}, {v.CATEGORIES}, {v.DOMAINS}, rc AS (SELECT r.*, c.categories, coalesce(d.domains, []) AS known FROM runs r JOIN qcats c USING (question_idx) LEFT JOIN domains d ON d.persona = r.eval_persona)"
_SUBSET = "len(list_filter(categories, lambda x: NOT list_contains(known, x))) = 0"
_RELEVANCE = f"CASE WHEN len(categories) = 0 OR len(known) = 0 OR NOT list_has_any(categories, known) THEN 'out_of_domain' WHEN {_SUBSET} THEN 'in_domain' ELSE 'partial' END"


@query(f"""WITH {_GOLD}, {v.DOMAINS}, mc AS (SELECT g.run_id, list_distinct(list(nullif(lower({v.strip_sql('e.category')}), ''))) AS categories FROM gold g JOIN evidence e USING (url) WHERE g.variant <> 'integrated' OR g.side = 'memory' GROUP BY 1),
    x AS (SELECT r.run_id, r.variant, list_filter(coalesce(mc.categories, []), lambda x: x IS NOT NULL) AS categories, coalesce(d.domains, []) AS known FROM runs r LEFT JOIN mc USING (run_id) LEFT JOIN domains d ON d.persona = r.eval_persona)
    SELECT run_id, variant = 'document_only' OR len(categories) = 0 OR {_SUBSET} AS in_domain FROM x""")
def in_domain_label(spark, d):
    """Whether the evidence of the memory channel (all of it, or the memory half of integrated runs) is the persona's."""
    g = _gold(spark, d).where("variant <> 'integrated' or side = 'memory'").select("run_id", "url")
    e = v.evidence(spark, d, "url", "category").select("url", text.category_key(F.col("category")).alias("category"))
    cats = g.join(e, "url").groupBy("run_id").agg(F.array_compact(F.collect_set("category")).alias("categories"))
    r = v.runs(spark, d, "variant", "eval_persona").join(cats, "run_id", "left")
    known = F.coalesce("categories", F.expr("cast(array() as array<string>)"))
    return r.select("run_id", ev.is_in_domain(F.col("variant"), known, F.col("eval_persona")).alias("in_domain"))


@query(f"WITH {_RCATS} SELECT run_id, {_RELEVANCE} AS relevance FROM rc")
def topical_relevance(spark, d):
    return v.run_categories(spark, d).select("run_id", ev.topical_relevance(F.col("categories"), F.col("eval_persona")).alias("relevance"))


@query(f"""WITH {v.MANIFEST}, {v.EVIDENCE}, {v.DOMAINS}, x AS (SELECT m.custom_id, nullif(lower({v.strip_sql('e.category')}), '') AS c, d.domains
    FROM (SELECT *, target_persona_id AS persona FROM manifest) m JOIN evidence e USING (evidence_id) LEFT JOIN domains d USING (persona))
    SELECT custom_id, coalesce(list_contains(domains, c), false) AS single, CASE WHEN domains IS NULL THEN true ELSE coalesce(list_contains(domains, c), false) END AS session,
      CASE WHEN domains IS NULL THEN false ELSE NOT coalesce(list_contains(domains, c), false) END AS off_topic,
      CASE WHEN c IS NULL THEN false ELSE coalesce(list_contains(domains, c), false) END AS wants_inside, CASE WHEN c IS NULL THEN true ELSE NOT coalesce(list_contains(domains, c), false) END AS wants_outside FROM x""")
def domain_predicates(spark, d):
    """The domain rules side by side, for every session and its own persona."""
    m = v.manifest(spark, d, "evidence_id", "target_persona_id").select("custom_id", "evidence_id", F.col("target_persona_id").alias("persona"))
    j = m.join(v.evidence(spark, d, "category").select("evidence_id", "category"), "evidence_id")
    c, p = F.col("category"), F.col("persona")
    key = F.array_compact(F.array(text.category_key(c)))
    return j.select("custom_id", ev.evidence_in_domain(c, p).alias("single"), ev.session_in_domain(c, p).alias("session"), ev.is_off_topic(key, p).alias("off_topic"),
                    ev.matches_wanted_domain(c, p, True).alias("wants_inside"), ev.matches_wanted_domain(c, p, False).alias("wants_outside"))


@query(f"""WITH {v.QUESTIONS} SELECT question_idx, row_number() OVER (ORDER BY CASE original_persona WHEN 'persona_1' THEN 1 WHEN 'persona_2' THEN 2 WHEN 'persona_3' THEN 3 WHEN 'persona_4' THEN 4 WHEN 'tbd' THEN 5 ELSE 6 END, question_idx) AS place FROM questions""")
def persona_order(spark, d):
    q = v.questions(spark, d).select("question_idx", ev.persona_rank(F.col("original_persona")).alias("pr"))
    return relational.with_ordinal(q, ["pr", "question_idx"], "place").select("question_idx", "place")


# Answers and screening.


@query(f"""WITH {v.SCREENING}, s AS (SELECT screening_agent, question_idx, question_type, {v.em_sql('final_answer', False)} = {v.em_sql('gold_answer', False)} AS ok FROM screening),
    g AS (SELECT question_idx FROM s WHERE screening_agent = 'golden_context' AND ok), n AS (SELECT question_idx FROM s WHERE screening_agent = 'no_context' AND ok)
    SELECT DISTINCT question_idx FROM g WHERE question_idx NOT IN (SELECT question_idx FROM n)""")
def reasonable_questions(spark, d):
    """Right with golden context, wrong without any."""
    s = v.screening(spark, d, "screening_agent", "question_idx", "final_answer", "gold_answer").where(text.exact_match(F.col("final_answer"), F.col("gold_answer"), False))
    right = s.where("screening_agent = 'golden_context'").select("question_idx").distinct()
    return right.join(s.where("screening_agent = 'no_context'").select("question_idx"), "question_idx", "left_anti")


_F1 = f"""f AS (SELECT screening_agent, {v.em_sql('final_answer', False)} AS p, {v.em_sql('gold_answer', False)} AS g FROM screening),
    s AS (SELECT screening_agent, p = g AS em, len(p) AS n, len(g) AS m, coalesce(list_sum(list_transform(list_distinct(p), lambda x: least(len(list_filter(p, lambda y: y = x)), len(list_filter(g, lambda y: y = x))))), 0) AS sh FROM f)"""


@query(f"""WITH {v.SCREENING}, {_F1} SELECT screening_agent, count(*) AS n, round(avg(em::INT), 6) AS mean_em, round(avg(CASE WHEN n = 0 AND m = 0 THEN 1.0::DOUBLE WHEN n = 0 OR m = 0 OR sh = 0 THEN 0.0::DOUBLE ELSE round(2.0::DOUBLE * sh / (n + m), 6) END), 6) AS mean_f1
    FROM s GROUP BY 1""")
def screening_scores(spark, d):
    a, g = F.col("final_answer"), F.col("gold_answer")
    s = v.screening(spark, d, "screening_agent", "final_answer", "gold_answer")
    return s.groupBy("screening_agent").agg(F.count("*").alias("n"), F.round(F.avg(text.exact_match(a, g, False).cast("int")), 6).alias("mean_em"), F.round(F.avg(text.token_f1(a, g)), 6).alias("mean_f1"))


# Retrieval metrics of runs.


def _gold_ids(spark, d, g=None):
    g = _gold(spark, d) if g is None else g
    docs = g.where("variant <> 'memory_only'").select("run_id", F.concat(F.lit("doc::"), "url").alias("gold_id"))
    return docs.unionByName(g.where("variant <> 'document_only'").select("run_id", F.concat(F.lit("mem::"), "session_id").alias("gold_id")))


_MIXED = f"""{_GOLD}, gid AS (SELECT run_id, 'doc::' || url AS gold_id FROM gold WHERE variant <> 'memory_only' UNION ALL SELECT run_id, 'mem::' || session_id FROM gold WHERE variant <> 'document_only'),
  rd AS (SELECT run_id, i - 1 AS pos, retrieved_documents[i].url AS id, coalesce(retrieved_documents[i].score, 0) AS score FROM (SELECT run_id, retrieved_documents, unnest(range(1, len(retrieved_documents) + 1)) AS i FROM runs)),
  rb AS (SELECT * FROM rd WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY run_id, id ORDER BY score DESC, pos) = 1),
  rm AS (SELECT run_id, i - 1 AS pos, retrieved_memory[i].session_id AS id, coalesce(retrieved_memory[i].score, 0) AS score FROM (SELECT run_id, retrieved_memory, unnest(range(1, len(retrieved_memory) + 1)) AS i FROM runs)),
  al AS (SELECT run_id, 'doc::' || id AS gold_id, score, 0 AS src, pos FROM rb UNION ALL SELECT run_id, 'mem::' || id, score, 1, pos FROM rm WHERE id IS NOT NULL),
  tp AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY score DESC, src, pos) AS rank FROM al QUALIFY rank <= 10),
  ht AS (SELECT run_id, count(*) AS n_hit FROM (SELECT DISTINCT run_id, gold_id FROM gid) JOIN (SELECT DISTINCT run_id, gold_id FROM tp) USING (run_id, gold_id) GROUP BY 1),
  ng AS (SELECT run_id, count(*) AS n_gold FROM gid GROUP BY 1),
  rec AS (SELECT run_id, coalesce(n_gold, 0) AS n_gold, coalesce(n_hit, 0) AS n_hit, round(coalesce(n_hit, 0) / nullif(coalesce(n_gold, 0), 0), 6) AS recall FROM runs LEFT JOIN ng USING (run_id) LEFT JOIN ht USING (run_id))"""


@query(f"WITH {_MIXED} SELECT * FROM rec")
def recall_at_k_mixed(spark, d, gold=None):
    return metrics.mixed_recall(v.runs(spark, d, "retrieved_documents", "retrieved_memory"), _gold_ids(spark, d, gold))


@query(f"""WITH {_GOLD} SELECT run_id, coalesce(len(list(url) FILTER (variant <> 'memory_only')), 0) + coalesce(len(list(session_id) FILTER (variant <> 'document_only')), 0) AS n_gold FROM gold GROUP BY 1""")
def gold_ids_per_run(spark, d):
    g = _gold(spark, d).groupBy("run_id").agg(F.first("variant").alias("variant"), F.collect_list("url").alias("urls"), F.collect_list("session_id").alias("sessions"))
    return g.select("run_id", F.size(metrics.gold_ids(F.col("variant"), F.col("urls"), F.col("sessions"))).alias("n_gold"))


_STRICT = f"""{_GOLD},
  ret AS (SELECT run_id, question_idx, unnest(list_distinct(list_transform(retrieved_documents, lambda x: x.url))) AS url FROM runs),
  pool AS (SELECT ret.run_id, ret.url, e.title || chr(10) || e.fact AS txt FROM ret JOIN evidence e USING (url)),
  gd AS (SELECT r.run_id, e.url, e.title, e.fact, e.source, e.evidence_id FROM runs r JOIN questions q USING (question_idx) JOIN evidence e ON e.source_question_id = q.question_id WHERE r.variant <> 'memory_only'),
  hit AS (SELECT gd.run_id, gd.url, CASE WHEN p.txt IS NULL THEN false WHEN len(coalesce(fact, '')) >= 20 THEN contains({v.norm_sql('p.txt')}, {v.norm_sql('fact')})
    WHEN len(trim(coalesce(title, ''))) > 0 AND len(trim(coalesce(source, ''))) > 0 THEN contains({v.norm_sql('p.txt')}, {v.norm_sql('title')}) AND contains({v.norm_sql('p.txt')}, {v.norm_sql('source')})
    WHEN len(trim(coalesce(title, ''))) > 0 THEN contains({v.norm_sql('p.txt')}, {v.norm_sql('title')}) WHEN len(trim(coalesce(source, ''))) > 0 THEN contains({v.norm_sql('p.txt')}, {v.norm_sql('source')}) ELSE false END AS hit
    FROM gd LEFT JOIN pool p ON p.run_id = gd.run_id AND p.url = gd.url)"""


def _strict_hits(spark, d):
    """Hit per gold document of a run, matched in the whole title and fact of the documents it retrieved."""
    e = v.evidence(spark, d, "source_question_id", "url", "title", "fact", "source")
    run = v.runs(spark, d, "question_idx", "variant", "retrieved_documents")
    got = run.select("run_id", F.explode(F.array_distinct(F.transform("retrieved_documents", lambda x: x.url))).alias("url"))
    seen = F.concat("title", F.lit("\n"), "fact")
    pool = got.join(e.select("url", "title", "fact"), "url").select("run_id", "url", F.array(seen).alias("texts"))
    q = v.questions(spark, d, "question_id").select("question_idx", F.col("question_id").alias("source_question_id"))
    gold = run.where("variant <> 'memory_only'").select("run_id", "question_idx").join(q, "question_idx").join(e.select("source_question_id", "url", "title", "fact", "source"), "source_question_id")
    j = gold.join(pool, ["run_id", "url"], "left")
    return j.select("run_id", "url", metrics.strict_doc_hit(F.col("fact"), F.col("title"), F.col("source"), F.col("texts")).alias("hit"))


@query(f"WITH {_STRICT} SELECT run_id, url, hit FROM hit")
def strict_doc_hit(spark, d):
    return _strict_hits(spark, d)


@query(f"""WITH {_STRICT}, every_gold AS (SELECT run_id, hit FROM hit UNION ALL SELECT run_id, false FROM gold WHERE variant <> 'document_only')
    SELECT run_id, count(*) AS n_gold, round(avg(hit::INT), 6) AS strict_recall FROM every_gold GROUP BY 1""")
def strict_recall(spark, d):
    """Over document and memory gold. The tables hold neither audits nor retrieved texts, so memory gold is never hit (a session without audit is no hit)."""
    memory = _gold(spark, d).where("variant <> 'document_only'").select("run_id", "session_id")
    return metrics.strict_recall(_strict_hits(spark, d), memory)


_PAIRS = f"""{v.TURNS}, n AS (SELECT *, lead(role) OVER w AS nr, lead(content) OVER w AS nc FROM turns WINDOW w AS (PARTITION BY session_id ORDER BY turn)),
  prs AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY turn) - 1 AS chunk_index, 'user: ' || content || CASE WHEN nr = 'assistant' THEN chr(10) || 'assistant: ' || nc ELSE '' END AS text FROM n WHERE role = 'user')"""


@query(f"""WITH {_PAIRS}, r AS (SELECT session_id || '#' || chunk_index AS key, session_id, text FROM prs),
  j AS (SELECT r.key, p.chunk_index, {v.norm_sql('r.text')} AS a, {v.norm_sql('p.text')} AS b FROM r JOIN prs p USING (session_id)),
  k AS (SELECT key, chunk_index, a = b AS eq, CASE WHEN len(a) > 0 AND len(b) > 0 AND (contains(a, b) OR contains(b, a)) THEN least(len(a), len(b)) END AS l FROM j),
  g AS (SELECT key, count(*) FILTER (eq) AS n_eq, min(chunk_index) FILTER (eq) AS ei, max(l) AS best FROM k GROUP BY 1),
  u AS (SELECT k.key, count(*) AS c, min(chunk_index) AS ci FROM k JOIN g ON g.key = k.key AND k.l = g.best GROUP BY 1)
  SELECT g.key, CASE WHEN n_eq = 1 THEN ei WHEN n_eq > 1 THEN NULL WHEN u.c = 1 THEN u.ci END AS chunk_index FROM g LEFT JOIN u USING (key)""")
def pair_match(spark, d):
    """Every pair's whole text back to its pair; texts that repeat in a session stand for no single pair."""
    p = pair_chunks(v.turns(spark, d))
    got = p.select(F.concat("session_id", F.lit("#"), "chunk_index").alias("key"), "session_id", "text")
    return metrics.match_pairs(got, p)


@query(f"""WITH {_PAIRS}, k AS (SELECT session_id, list(chunk_index) FILTER (regexp_matches(text, '[0-9]')) AS key_turns FROM prs GROUP BY 1),
  j AS (SELECT r.session_id || '#' || r.chunk_index AS key, r.session_id, p.chunk_index, {v.norm_sql('r.text')} AS a, {v.norm_sql('p.text')} AS b FROM prs r JOIN prs p USING (session_id)),
  g AS (SELECT key, any_value(session_id) AS session_id, count(*) FILTER (a = b) AS n_eq, min(chunk_index) FILTER (a = b) AS ei FROM j GROUP BY 1)
  SELECT key, session_id, coalesce(n_eq = 1 AND list_contains(key_turns, ei), false) AS hit FROM g JOIN k USING (session_id)""")
def audited_turn_hit(spark, d):
    """Whether each pair of a chat session is one of its audited key turns; here the audit names the pairs that state a number."""
    p = pair_chunks(v.turns(spark, d))
    audit = p.groupBy("session_id").agg(F.array_compact(F.collect_list(F.when(F.col("text").rlike("[0-9]"), F.col("chunk_index").cast("int")))).alias("key_information"))
    got = p.select(F.concat("session_id", F.lit("#"), "chunk_index").alias("key"), "session_id", "text")
    return metrics.strict_memory_hits(got, p, audit)


@query(f"""WITH {_STRICT}, m AS (SELECT g.run_id, g.session_id, g.url, coalesce(list_contains(list_transform(r.retrieved_memory, lambda x: x.session_id), g.session_id), false) AS by_session FROM gold g JOIN runs r USING (run_id) WHERE g.variant = 'integrated'),
    h AS (SELECT run_id, url, max(hit::INT) = 1 AS hit FROM hit GROUP BY ALL)
    SELECT m.run_id, count(*) AS n_gold, round(avg((m.by_session OR coalesce(h.hit, false))::INT), 6) AS recall FROM m LEFT JOIN h USING (run_id, url) GROUP BY 1""")
def gold_document_memory_recall(spark, d):
    """Recall of integrated runs where a gold session is also met by the text of its article among the documents."""
    g = _gold(spark, d).where("variant = 'integrated'").join(v.runs(spark, d, "retrieved_memory"), "run_id")
    m = g.select("run_id", "url", F.exists("retrieved_memory", lambda x: x["session_id"] == F.col("session_id")).alias("by_session"))
    h = _strict_hits(spark, d).groupBy("run_id", "url").agg(F.max("hit").alias("hit"))
    met = metrics.gold_document_hit(F.col("hit"), F.col("by_session")).cast("int")
    return m.join(h, ["run_id", "url"], "left").groupBy("run_id").agg(F.count("*").alias("n_gold"), F.round(F.avg(met), 6).alias("recall"))


# Feature tables.

_CATEGORIES = ("professional", "casual", "transactional")
_DIV = f"""{_GOLD}, {v.MANIFEST}, dv AS (SELECT g.run_id, m.* FROM gold g JOIN manifest m ON m.custom_id = g.session_id WHERE g.variant <> 'document_only'),
  df AS (SELECT run_id, count(*) AS n_sessions, round(avg(coalesce((evidence_placement = 'late')::INT, 0)), 6) AS frac_late, round(avg(coalesce((evidence_placement = 'middle')::INT, 0)), 6) AS frac_middle,
    round(avg(coalesce((topic_drift IN ('moderate', 'wide'))::INT, 0)), 6) AS frac_drift, round(avg(coalesce((evidence_density = 'multi_message')::INT, 0)), 6) AS frac_multi,
    round(avg(coalesce((topic_drift = 'wide')::INT, 0)), 6) AS frac_wide, {', '.join(f"round(avg(coalesce((lower(trim(scenario_category)) = '{c}')::INT, 0)), 6) AS frac_{c}" for c in _CATEGORIES)},
    max(turn_range[2]) AS max_turns, max(turn_range[2]) - min(turn_range[2]) AS turns_spread, round(avg((turn_range[1] + turn_range[2]) / 2.0), 6) AS mean_turns FROM dv GROUP BY 1)"""


def _diversity(spark, d, g=None):
    g = (_gold(spark, d) if g is None else g).where("variant <> 'document_only'").select("run_id", F.col("session_id").alias("custom_id"))
    m = v.manifest(spark, d, "evidence_placement", "topic_drift", "evidence_density", "turn_range", "scenario_category").drop("arrived_at")
    share = lambda cond: F.round(F.avg(F.coalesce(cond.cast("int"), F.lit(0))), 6)
    upper, lower = F.get("turn_range", F.lit(1)), F.get("turn_range", F.lit(0))
    return g.join(m, "custom_id").groupBy("run_id").agg(
        F.count("*").alias("n_sessions"),
        share(F.col("evidence_placement") == "late").alias("frac_late"),
        share(F.col("evidence_placement") == "middle").alias("frac_middle"),
        share(F.col("topic_drift").isin("moderate", "wide")).alias("frac_drift"),
        share(F.col("evidence_density") == "multi_message").alias("frac_multi"),
        share(F.col("topic_drift") == "wide").alias("frac_wide"),
        *[share(text.category_key(F.col("scenario_category")) == c).alias(f"frac_{c}") for c in _CATEGORIES],
        F.max(upper).alias("max_turns"),
        (F.max(upper) - F.min(upper)).alias("turns_spread"),
        F.round(F.avg((lower + upper) / 2.0), 6).alias("mean_turns"),
    )


@query(f"WITH {_DIV} SELECT * FROM df")
def diversity_features(spark, d):
    return _diversity(spark, d)


@query(f"""WITH {_MIXED}, {_DIV.replace(_GOLD + ', ', '')}, {v.CATEGORIES.replace(v.QUESTIONS + ', ' + v.EVIDENCE + ',', '')}, {v.DOMAINS},
  rc AS (SELECT r.*, c.categories, coalesce(dm.domains, []) AS known FROM runs r JOIN qcats c USING (question_idx) LEFT JOIN domains dm ON dm.persona = r.eval_persona)
  SELECT rc.run_id, block_id, agent, variant AS dist, eval_persona AS persona, ({v.em_sql('prediction')} = {v.em_sql('gold_answer')})::INT AS correct, {_RELEVANCE} AS relevance, recall, q.hop_count, coalesce(n_sessions, 0) AS n_sessions, frac_late, max_turns
  FROM rc JOIN rec USING (run_id) LEFT JOIN df USING (run_id) LEFT JOIN (SELECT question_idx, hop_count FROM questions) q USING (question_idx) WHERE agent IN ('agent_1', 'agent_2', 'agent_3', 'agent_4')""")
def model_features(spark, d):
    """The table that models are fitted on: labels, relevance, recall, hops and diversity of each run."""
    r = v.runs(spark, d, "question_idx", "block_id", "agent", "eval_persona", "variant", "prediction", "gold_answer").where(F.col("agent").isin("agent_1", "agent_2", "agent_3", "agent_4"))
    r = relational.rename_missing(r, {"eval_persona": "persona", "variant": "dist"})
    c = v.question_categories(spark, d).select("question_idx", "categories")
    h = v.questions(spark, d, "hop_count").drop("arrived_at")
    g = materialise(_gold(spark, d), "gold")  # recall and diversity both read it
    out = r.join(c, "question_idx").join(h, "question_idx", "left").join(recall_at_k_mixed(spark, d, g).select("run_id", "recall"), "run_id").join(_diversity(spark, d, g), "run_id", "left")
    return out.select("run_id", "block_id", "agent", "dist", "persona", text.exact_match(F.col("prediction"), F.col("gold_answer")).cast("int").alias("correct"),
                      ev.topical_relevance(F.col("categories"), F.col("persona")).alias("relevance"), "recall", "hop_count", F.coalesce("n_sessions", F.lit(0)).alias("n_sessions"), "frac_late", "max_turns")


@query(f"""WITH {_GOLD}, {v.MANIFEST}, {v.DOMAINS}, au AS (SELECT g.run_id, g.session_id, m.evidence_placement, m.evidence_density, m.is_temporal, list_contains(list_transform(r.retrieved_memory, lambda x: x.session_id), g.session_id) AS retrieved,
    CASE WHEN m.session_parse_error IS NOT NULL THEN NULL ELSE m.evidence_placement IS NOT NULL END AS complete,
    CASE WHEN nullif(lower({v.strip_sql('e.category')}), '') IS NOT NULL THEN coalesce(list_contains(d.domains, lower({v.strip_sql('e.category')})), false) END AS evidence_in_domain
    FROM gold g JOIN runs r USING (run_id) JOIN manifest m ON m.custom_id = g.session_id LEFT JOIN evidence e ON e.evidence_id = m.evidence_id LEFT JOIN domains d ON d.persona = g.persona WHERE g.variant = 'memory_only') SELECT * FROM au""")
def audit_table(spark, d):
    """One row per gold session of a memory-only run, with its diversity, hit and completeness (unknown after a parse error)."""
    r = v.runs(spark, d, "variant", "retrieved_memory").where("variant = 'memory_only'").select("run_id", F.transform("retrieved_memory", lambda x: x.session_id).alias("got"))
    g = _gold(spark, d).select("run_id", "session_id", "persona").join(r, "run_id")
    e = v.evidence(spark, d, "category").select("evidence_id", "category")
    m = v.manifest(spark, d, "evidence_id", "session_parse_error", "evidence_placement", "evidence_density", "is_temporal").withColumnRenamed("custom_id", "session_id").join(e, "evidence_id", "left")
    in_domain = F.when(text.category_key(F.col("category")).isNotNull(), ev.evidence_in_domain(F.col("category"), F.col("persona")))
    complete = F.when(F.col("session_parse_error").isNotNull(), None).otherwise(F.col("evidence_placement").isNotNull())
    return g.join(m, "session_id").select("run_id", "session_id", "evidence_placement", "evidence_density", "is_temporal", F.array_contains("got", F.col("session_id")).alias("retrieved"), complete.alias("complete"), in_domain.alias("evidence_in_domain"))


@query(f"""WITH {_GOLD}, x AS (SELECT g.run_id, g.session_id, list_contains(list_transform(r.retrieved_memory, lambda x: x.session_id), g.session_id) AS by_session, list_contains(list_transform(r.retrieved_documents, lambda x: x.url), g.url) AS by_url
    FROM gold g JOIN runs r USING (run_id) WHERE g.variant <> 'document_only') SELECT run_id, session_id, coalesce(by_session, false) AS by_session, coalesce(by_url, false) AS by_url FROM x""")
def gold_identity_hits(spark, d):
    r = v.runs(spark, d, "retrieved_memory", "retrieved_documents")
    g = _gold(spark, d).where("variant <> 'document_only'").join(r, "run_id")
    has = lambda c, f, x: F.coalesce(F.exists(c, lambda y: y[f] == x), F.lit(False))
    return g.select("run_id", "session_id", has("retrieved_memory", "session_id", F.col("session_id")).alias("by_session"), has("retrieved_documents", "url", F.col("url")).alias("by_url"))


_NOTES = f"""{_MIXED}, t AS (SELECT r.run_id, ({v.em_sql('prediction')} = {v.em_sql('gold_answer')}) AS ok, prediction, n_gold, n_hit FROM runs r JOIN rec USING (run_id)),
    nt AS (SELECT run_id, concat_ws(', ', CASE WHEN contains(lower(coalesce(prediction, '')), 'insufficient information') THEN 'abstained' END, CASE WHEN prediction = '[INFERENCE_FAILED]' THEN 'inference failed' END,
      CASE WHEN n_gold > 0 AND n_hit = n_gold AND NOT ok THEN 'full retrieval, wrong answer' END, CASE WHEN n_gold > 0 AND n_hit = 0 THEN 'retrieval miss' END, CASE WHEN n_hit > 0 AND n_hit < n_gold THEN 'partial recall' END) AS notes FROM t)"""


@query(f"WITH {_NOTES} SELECT run_id, notes FROM nt")
def failure_notes(spark, d):
    r = v.runs(spark, d, "prediction", "gold_answer").join(recall_at_k_mixed(spark, d), "run_id")
    notes = reports.failure_notes(F.col("prediction"), F.col("n_hit"), F.col("n_gold"), text.exact_match(F.col("prediction"), F.col("gold_answer")))
    return r.select("run_id", F.array_join(notes, ", ").alias("notes"))




# Designs, requests and prompts.

_CELLS = [(dist, f"agent_{a}") for dist in ev.VARIANTS for a in range(1, 5)]
_EVAL = ("persona_1", "persona_2", "persona_3")


@query(f"""WITH {v.QUESTIONS}, b AS (SELECT *, row_number() OVER (ORDER BY question_idx) AS block_id FROM questions), c AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(_CELLS))}) AS t(i, dist, agent)),
    k AS (SELECT block_id, (block_id + s * 3) % 12 AS i FROM b, (SELECT unnest([0, 1, 2, 3]) AS s))
    SELECT block_id, dist, agent, question_idx, question_type FROM k JOIN c USING (i) JOIN b USING (block_id) WHERE agent = 'agent_2'""")
def design_join(spark, d):
    """The design joined to its questions by block; a block without question is an error. One agent's slice."""
    q = relational.with_ordinal(v.questions(spark, d, "question_type"), ["question_idx"]).select("block_id", "question_idx", "question_type")
    design = sampling.cyclic_block_design(q.select("block_id"), "block_id", _CELLS, 4)
    return relational.require_joined(design, q, ["block_id"]).where("agent = 'agent_2'").select("block_id", "dist", "agent", "question_idx", "question_type")


@query(f"""WITH {v.QUESTIONS} SELECT question_idx, variant, persona FROM questions, (SELECT unnest({list(ev.VARIANTS)}) AS variant), (SELECT unnest({list(_EVAL)}) AS persona)""")
def full_design(spark, d):
    """Every question with every variant and evaluation persona (small literal sets, no join)."""
    lits = lambda xs: F.array(*[F.lit(x) for x in xs])
    q = v.questions(spark, d, "question_type").select("question_idx", F.explode(lits(ev.VARIANTS)).alias("variant"))
    return q.select("question_idx", "variant", F.explode(lits(_EVAL)).alias("persona"))


@query(f"""WITH {v.QUESTIONS}, {v.EVIDENCE} SELECT 'q-' || substr(sha256({v.strip_sql('q.query')}), 1, 16) || '__ev-' || e.evidence_id || '__p-' || persona AS custom_id, q.question_idx, e.evidence_id, persona, question_type = 'temporal_query' AS is_temporal
    FROM questions q JOIN evidence e ON e.source_question_id = q.question_id, (SELECT unnest({list(_EVAL)}) AS persona)""")
def request_fanout(spark, d):
    """One generation request per question, evidence and target persona."""
    q = v.questions(spark, d, "query", "question_id", "question_type").withColumnRenamed("question_id", "source_question_id")
    j = q.join(v.evidence(spark, d, "source_question_id").select("source_question_id", "evidence_id"), "source_question_id")
    j = j.withColumn("persona", F.explode(F.array(*[F.lit(p) for p in _EVAL])))
    return j.select(ids.session_id(F.col("query"), F.col("evidence_id"), F.col("persona")).alias("custom_id"), "question_idx", "evidence_id", "persona", (F.col("question_type") == "temporal_query").alias("is_temporal"))


@query(f"""WITH {v.EVIDENCE}, {v.DOMAINS}, {POOL_COUNTS}, s AS (SELECT persona_id AS persona, sum(short_in) AS n_in, sum(short_off) AS n_off FROM pool_counts JOIN pool_inventory USING (pool_id) GROUP BY 1),
    x AS (SELECT d.persona, e.evidence_id, CASE WHEN coalesce(list_contains(d.domains, nullif(lower({v.strip_sql('e.category')}), '')), false) THEN 'in_domain' ELSE 'off_topic' END AS domain, {v.hash_sql(42, 'd.persona', 'e.evidence_id')} AS h
      FROM evidence e, domains d WHERE NOT EXISTS (SELECT 1 FROM manifest m WHERE m.target_persona_id = d.persona AND m.evidence_id = e.evidence_id)),
    k AS (SELECT *, row_number() OVER (PARTITION BY persona, domain ORDER BY h, evidence_id) AS r FROM x)
    SELECT k.persona, evidence_id, domain FROM k JOIN s USING (persona) WHERE r <= 3 * CASE domain WHEN 'in_domain' THEN n_in ELSE n_off END""")
def supplement_candidates(spark, d):
    """Evidence that a persona's pools do not hold yet, in domain and off topic, by least hash: three times what the pools of the persona lack of each."""
    short = pool_inventory_counts(spark, d).join(table(spark, d, "pool_inventory").select("pool_id", F.col("persona_id").alias("persona")), "pool_id")
    sides = F.explode(F.array(F.struct(F.lit("in_domain").alias("domain"), F.col("short_in").alias("n")), F.struct(F.lit("off_topic").alias("domain"), F.col("short_off").alias("n"))))
    need = short.select("persona", sides.alias("x")).groupBy("persona", "x.domain").agg((3 * F.sum("x.n")).alias("n")).where("n > 0")
    e = v.evidence(spark, d, "category").select("evidence_id", "category", F.explode(F.array(*[F.lit(p) for p in _EVAL])).alias("persona"))
    e = e.withColumn("domain", F.when(ev.matches_wanted_domain(F.col("category"), F.col("persona"), True), "in_domain").otherwise("off_topic"))
    have = v.manifest(spark, d, "target_persona_id", "evidence_id").select(F.col("target_persona_id").alias("persona"), "evidence_id").distinct()
    w = W.Window.partitionBy("persona", "domain").orderBy(ids.hash_rank(42, F.col("persona"), F.col("evidence_id")), "evidence_id")
    ranked = e.join(have, ["persona", "evidence_id"], "left_anti").withColumn("r", F.row_number().over(w))
    return ranked.join(F.broadcast(need), ["persona", "domain"]).where("r <= n").select("persona", "evidence_id", "domain")


@query()
def persona_corpus(spark, d):
    """The memory corpus of each pool: 375 sessions in domain and 125 off topic, tiers in order, dated and sorted in time.

    A pool that holds fewer usable sessions gives all of them, none twice.
    """
    m = v.manifest(spark, d).where("session_parse_error is null and is_off_topic is not null").withColumn("turns", text.turn_range_label(F.col("turn_range")))
    levels = ["scenario_category", "turns", "topic_drift"]
    weights = {p: [w["categories"], dict(zip(sampling.TURN_RANGES, w["turns"])), sampling.drift_weights(w)] for p, w in sampling.PROFILES.items()}
    even = [dict.fromkeys(labels, 1.0) for labels in weights["persona_1"]]
    tier = F.when(F.col("pool_tier") == "primary", 1).otherwise(2)
    chosen = sampling.corpus_fill(m, "pool_id", "target_persona_id", "is_off_topic", "custom_id", "evidence_id", tier, {False: 375, True: 125}, levels, weights, even)
    kept = chosen.join(m, ["pool_id", "custom_id"])
    dated = sampling.session_times(kept, "custom_id", F.to_timestamp(F.substring("session_date", 1, 10), "yyyy/MM/dd"), "2023-07-01", "2024-02-29")
    return dated.select("pool_id", "custom_id", "is_off_topic", "tier", "session_time").repartition("pool_id").sortWithinPartitions("pool_id", "session_time", "custom_id")


@query(f"""WITH {v.MANIFEST}, {v.EVIDENCE} SELECT custom_id, 'You write a chat between a user and an assistant. The user is ' || target_persona_id || CASE WHEN is_off_topic THEN ', outside their usual topics.' ELSE '.' END || chr(10) || chr(10) || 'Scenario: ' || coalesce(scenario, 'any') || chr(10) || chr(10)
      || 'Write ' || array_to_string(turn_range, '-') || ' turns.' || chr(10) || 'Place the evidence ' || CASE evidence_placement WHEN 'early' THEN 'in the first third' WHEN 'middle' THEN 'in the middle' WHEN 'late' THEN 'in the last third' ELSE 'anywhere' END || ', '
      || CASE evidence_density WHEN 'multi_message' THEN 'over several messages' ELSE 'in one message' END || '.' || CASE WHEN coalesce(is_temporal, false) THEN chr(10) || 'Name the date of publication.' ELSE '' END || chr(10) || chr(10)
      || CASE topic_drift WHEN 'moderate' THEN 'Wander off once and come back.' WHEN 'wide' THEN 'Change the topic several times.' ELSE 'Stay on the topic.' END || chr(10) || chr(10) || 'Evidence:' || chr(10) || e.fact AS prompt
    FROM manifest JOIN evidence e USING (evidence_id)""")
def generation_prompts(spark, d):
    m = v.manifest(spark, d, "target_persona_id", "evidence_id", "scenario", "turn_range", "evidence_placement", "evidence_density", "topic_drift", "is_temporal", "is_off_topic")
    j = m.join(v.evidence(spark, d, "fact").select("evidence_id", "fact"), "evidence_id")
    c = F.col
    return j.select("custom_id", prompts.generation_prompt(c("target_persona_id"), c("fact"), c("scenario"), c("turn_range"), c("evidence_placement"), c("evidence_density"), c("topic_drift"), c("is_temporal"), c("is_off_topic")).alias("prompt"))


@query(f"""WITH {v.TURNS}, k AS (SELECT session_id, turn, CASE role WHEN 'user' THEN '[U' || sum((role = 'user')::INT) OVER (PARTITION BY session_id ORDER BY turn) || '] ' WHEN 'assistant' THEN '[A] ' ELSE '[' || upper(role) || '] ' END || content AS line FROM turns),
    t AS (SELECT session_id, string_agg(line, chr(10) || chr(10) ORDER BY turn) AS transcript FROM k GROUP BY session_id)
    SELECT session_id, 'List the user turns that state each field.' || chr(10) || chr(10) || concat_ws(chr(10), 'topic: ' || title, 'source: ' || source, 'key_information: ' || category) || chr(10) || chr(10) || transcript AS prompt FROM t JOIN documents ON doc_id = session_id""")
def audit_prompts(spark, d):
    """Audit prompts over the chat sessions of the documents (their category stands for the fact)."""
    t = transcript(v.turns(spark, d))
    docs = table(spark, d, "documents").where("doc_kind = 'session'").select(F.col("doc_id").alias("session_id"), "title", "source", "category")
    j = t.join(docs, "session_id")
    return j.select("session_id", prompts.audit_prompt(F.col("title"), F.col("source"), F.col("category"), F.lit(None), F.col("transcript"), F.lit(False)).alias("prompt"))


def _cell_sql(c: str) -> str:
    return rf"replace(regexp_replace(coalesce({c}, ''), '\s*\n\s*', ' ', 'g'), '|', '\|')"


@query(f"""WITH {_NOTES}, split_blocks AS (SELECT block_id FROM runs GROUP BY 1 HAVING count(DISTINCT {OK_SQL}) > 1),
    l AS (SELECT block_id, run_id, concat_ws(' | ', run_id::VARCHAR, variant, {_cell_sql('prediction')}, {_cell_sql('gold_answer')}, {_cell_sql('notes')}) AS line FROM runs JOIN nt USING (run_id) WHERE block_id IN (SELECT block_id FROM split_blocks))
    SELECT block_id, 'run | dist | prediction | gold | notes' || chr(10) || '--- | --- | --- | --- | ---' || chr(10) || string_agg(line, chr(10) ORDER BY run_id) AS report FROM l GROUP BY 1""")
def case_reports(spark, d):
    """Markdown reports of the blocks whose runs disagree."""
    r = v.runs(spark, d, "block_id", "variant", "prediction", "gold_answer").withColumn("ok", text.exact_match(F.col("prediction"), F.col("gold_answer")))
    split = r.groupBy("block_id").agg(F.count_distinct("ok").alias("n")).where("n > 1").select("block_id")
    rows = r.join(split, "block_id", "left_semi").join(failure_notes(spark, d), "run_id")
    return prompts.case_report(rows.withColumnRenamed("variant", "dist"), "block_id")


@query(f"""WITH {_MIXED}, {v.CATEGORIES.replace(v.QUESTIONS + ', ' + v.EVIDENCE + ',', '')}, {v.DOMAINS}, rc AS (SELECT r.*, c.categories, coalesce(dm.domains, []) AS known FROM runs r JOIN qcats c USING (question_idx) LEFT JOIN domains dm ON dm.persona = r.eval_persona),
    x AS (SELECT {_RELEVANCE} AS relevance, variant AS dist, recall, ({v.em_sql('prediction')} = {v.em_sql('gold_answer')})::INT AS ok FROM rc JOIN rec USING (run_id))
    SELECT relevance, dist, count(*) AS n, round(avg(recall), 6) AS mean_recall, round(avg(ok), 6) AS accuracy FROM x GROUP BY ALL""")
def topic_recall(spark, d):
    """Mean recall (over runs with gold) and accuracy by topical relevance and variant."""
    r = v.runs(spark, d, "question_idx", "eval_persona", "variant", "prediction", "gold_answer").join(v.question_categories(spark, d).select("question_idx", "categories"), "question_idx")
    x = r.join(recall_at_k_mixed(spark, d).select("run_id", "recall"), "run_id")
    ok = text.exact_match(F.col("prediction"), F.col("gold_answer")).cast("int")
    return x.groupBy(ev.topical_relevance(F.col("categories"), F.col("eval_persona")).alias("relevance"), F.col("variant").alias("dist")).agg(F.count("*").alias("n"), F.round(F.avg("recall"), 6).alias("mean_recall"), F.round(F.avg(ok), 6).alias("accuracy"))


@query(f"WITH {v.RUNS} SELECT variant, eval_persona, count(*) AS n FROM runs GROUP BY ALL")
def variant_counts(spark, d):
    return v.runs(spark, d, "variant", "eval_persona").groupBy("variant", "eval_persona").agg(F.count("*").alias("n"))


@query(f"""WITH {_GOLD}, gu AS (SELECT run_id, list(DISTINCT url) AS gold FROM gold WHERE variant <> 'memory_only' GROUP BY 1),
    fo AS (SELECT run_id, list_filter(list_transform(retrieved_documents, lambda x: x.url), lambda x: x IS NOT NULL) AS found FROM runs),
    li AS (SELECT run_id, i, found[i] || CASE WHEN list_contains(gold, found[i]) THEN ' [gold]' ELSE '' END AS line FROM (SELECT run_id, gold, found, unnest(range(1, len(found) + 1)) AS i FROM fo JOIN gu USING (run_id)))
    SELECT gu.run_id, coalesce((SELECT string_agg(i || '. ' || line, chr(10) ORDER BY i) FROM li WHERE li.run_id = gu.run_id), '') AS retrieved,
      array_to_string(list_sort(list_filter(gold, lambda x: NOT list_contains(coalesce(found, []), x))), ', ') AS missed FROM gu JOIN fo USING (run_id)""")
def inspection_lists(spark, d):
    """Per run with document gold: the documents it retrieved, gold marked, and the gold it missed."""
    gold = _gold(spark, d).where("variant <> 'memory_only'").groupBy("run_id").agg(F.collect_set("url").alias("gold"))
    r = v.runs(spark, d, "retrieved_documents").select("run_id", F.array_compact(F.transform("retrieved_documents", lambda x: x["url"])).alias("found")).join(gold, "run_id")
    return r.select("run_id", reports.retrieved_list(F.col("found"), F.col("gold")).alias("retrieved"), reports.missed_gold(F.col("found"), F.col("gold")).alias("missed"))
