"""Sampling, allocation, reports and comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import text
from ..operators import metrics, relational, reports, rows, sampling
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


OK_SQL = f"({v.em_sql('prediction')} = {v.em_sql('gold_answer')})"


def _scored(spark, d):
    r = v.runs(spark, d, "question_idx", "block_id", "eval_persona", "variant", "agent", "prediction", "gold_answer", "question_type", "latency_s", "input_tokens")
    return r.withColumn("correct", text.exact_match(F.col("prediction"), F.col("gold_answer")).cast("int"))


@query(f"""WITH {v.RUNS} SELECT agent, count(*) AS n_runs, count(*) FILTER (prediction = '[INFERENCE_FAILED]') AS n_failed, count(*) FILTER (prediction = '[INFERENCE_FAILED]' AND coalesce(input_tokens = 0, false)) AS n_pre_llm,
    count(*) FILTER (prediction = '[INFERENCE_FAILED]' AND NOT coalesce(input_tokens = 0, false)) AS n_llm_stage, round(coalesce(avg(latency_s) FILTER (prediction = '[INFERENCE_FAILED]'), 0), 6) AS mean_latency_s,
    round(coalesce(avg(input_tokens) FILTER (prediction = '[INFERENCE_FAILED]'), 0), 6) AS mean_input_tokens,
    round(count(*) FILTER (prediction = '[INFERENCE_FAILED]') / count(*), 6) AS failure_rate FROM runs GROUP BY 1""")
def failure_by_agent(spark, d):
    return reports.failures_by(v.runs(spark, d, "agent", "prediction", "input_tokens", "latency_s"), "agent")


@query(f"""WITH {v.RUNS} SELECT CASE WHEN grouping(agent) = 1 THEN 'All' ELSE coalesce(agent, '(null)') END AS agent, CASE WHEN grouping(variant) = 1 THEN 'All' ELSE coalesce(variant, '(null)') END AS variant, count(*) AS n
    FROM runs WHERE prediction = '[INFERENCE_FAILED]' GROUP BY CUBE (agent, variant)""")
def failure_crosstab_margins(spark, d):
    return reports.crosstab_with_margins(v.runs(spark, d, "agent", "variant", "prediction").where(F.col("prediction") == reports.FAILED), "agent", "variant")


@query(f"WITH {v.RUNS} SELECT question_idx, count(*) AS n FROM runs WHERE prediction = '[INFERENCE_FAILED]' GROUP BY 1 HAVING count(*) > 1")
def multi_failure_questions(spark, d):
    return v.runs(spark, d, "question_idx", "prediction").where(F.col("prediction") == reports.FAILED).groupBy("question_idx").agg(F.count("*").alias("n")).where("n > 1")


@query(f"""WITH {v.RUNS}, x AS (SELECT variant AS dist, agent, eval_persona AS persona, {OK_SQL}::INT AS ok FROM runs WHERE question_type IS DISTINCT FROM 'null_query'), g AS (SELECT dist, agent, persona, count(*) AS n, sum(ok)::BIGINT AS k FROM x GROUP BY ALL)
    SELECT *, round(k / n, 6) AS accuracy, round(greatest(0, (k / n + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4 * n * n)) / (1 + 1.96 * 1.96 / n)), 6) AS low,
      round(least(1, (k / n + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) + 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4 * n * n)) / (1 + 1.96 * 1.96 / n)), 6) AS high FROM g""")
def wilson_accuracy(spark, d):
    x = _scored(spark, d).where(~F.col("question_type").eqNullSafe(F.lit("null_query")))
    g = x.groupBy(F.col("variant").alias("dist"), "agent", F.col("eval_persona").alias("persona")).agg(F.count("*").alias("n"), F.sum("correct").alias("k"))
    low, high = metrics.wilson(F.col("n").cast("double"), F.col("k").cast("double"))
    return g.select("*", F.round(F.col("k") / F.col("n"), 6).alias("accuracy"), low.alias("low"), high.alias("high"))


@query(f"WITH {v.RUNS} SELECT question_idx, round(avg({OK_SQL}::INT), 6) AS mean_correct FROM runs WHERE agent = 'agent_1' GROUP BY 1 HAVING avg({OK_SQL}::INT) > 0 AND avg({OK_SQL}::INT) < 1")
def variable_questions(spark, d):
    x = _scored(spark, d).where("agent = 'agent_1'").groupBy("question_idx").agg(F.avg("correct").alias("m")).where("m > 0 and m < 1")
    return x.select("question_idx", F.round("m", 6).alias("mean_correct"))


@query(f"""WITH {v.RUNS} SELECT block_id, eval_persona AS persona, agent, count(DISTINCT variant) AS n_dists FROM runs GROUP BY ALL HAVING count(DISTINCT variant) >= 2 AND count(DISTINCT {OK_SQL}) > 1""")
def disagreement_units(spark, d):
    g = _scored(spark, d).groupBy("block_id", F.col("eval_persona").alias("persona"), "agent").agg(F.count_distinct("variant").alias("n_dists"), F.count_distinct("correct").alias("c"))
    return g.where("n_dists >= 2 and c > 1").drop("c")


@query(f"""WITH {v.RUNS}, u AS (SELECT block_id, eval_persona, agent FROM runs GROUP BY ALL HAVING count(DISTINCT variant) >= 2 AND count(DISTINCT {OK_SQL}) > 1),
    s AS (SELECT r.*, row_number() OVER (PARTITION BY variant ORDER BY {v.hash_sql(42, 'r.run_id')}, r.run_id) AS rn FROM runs r JOIN u USING (block_id, eval_persona, agent)) SELECT run_id, variant FROM s WHERE rn <= 20""")
def disagreement_sample(spark, d):
    """Runs of disagreeing units, 20 per variant by least hash."""
    x = _scored(spark, d)
    u = x.groupBy("block_id", "eval_persona", "agent").agg(F.count_distinct("variant").alias("n"), F.count_distinct("correct").alias("c")).where("n >= 2 and c > 1")
    hit = x.join(u.select("block_id", "eval_persona", "agent"), ["block_id", "eval_persona", "agent"], "left_semi")
    return sampling.least_hashes(hit, "run_id", 20, ["variant"]).select("run_id", "variant")


_ATTRS = ["scenario_category", "topic_drift", "evidence_placement", "evidence_density"]


@query(f"""WITH {v.MANIFEST}, l AS ({' UNION ALL '.join(f"SELECT target_persona_id, '{a}' AS attribute, coalesce({a}, '(null)') AS label FROM manifest" for a in _ATTRS)}), g AS (SELECT *, count(*) AS n FROM l GROUP BY ALL)
    SELECT *, round(100.0 * n / sum(n) OVER (PARTITION BY target_persona_id, attribute), 6)::DOUBLE AS percent FROM g""")
def attribute_histogram(spark, d):
    return reports.histogram(v.manifest(spark, d), "target_persona_id", _ATTRS)


POOL_COUNTS = f"""{v.MANIFEST}, c AS (SELECT pool_id, count(*) FILTER (pool_tier = 'primary' AND NOT is_off_topic) AS pin, count(*) FILTER (pool_tier = 'primary' AND is_off_topic) AS poff, count(*) FILTER (pool_tier = 'supplement' AND NOT is_off_topic) AS sin,
      count(*) FILTER (pool_tier = 'supplement' AND is_off_topic) AS soff FROM manifest WHERE session_parse_error IS NULL GROUP BY 1),
    pool_counts AS (SELECT p.pool_id, coalesce(pin, 0) AS primary_in, coalesce(poff, 0) AS primary_off, coalesce(sin, 0) AS supplement_in, coalesce(soff, 0) AS supplement_off, greatest(0, target_in_domain - coalesce(pin, 0) - coalesce(sin, 0)) AS short_in,
      greatest(0, target_off_topic - coalesce(poff, 0) - coalesce(soff, 0)) AS short_off FROM pool_inventory p LEFT JOIN c USING (pool_id))"""


@query(f"WITH {POOL_COUNTS} SELECT * FROM pool_counts")
def pool_inventory_counts(spark, d):
    m = v.manifest(spark, d).where("session_parse_error is null")
    n = lambda t, off: F.count_if((F.col("pool_tier") == t) & (F.col("is_off_topic") == off))
    c = m.groupBy("pool_id").agg(n("primary", False).alias("primary_in"), n("primary", True).alias("primary_off"), n("supplement", False).alias("supplement_in"), n("supplement", True).alias("supplement_off"))
    p = table(spark, d, "pool_inventory").select("pool_id", "target_in_domain", "target_off_topic").join(c, "pool_id", "left").na.fill(0, ["primary_in", "primary_off", "supplement_in", "supplement_off"])
    short = lambda t, a, b: F.greatest(F.lit(0), F.col(t) - F.col(a) - F.col(b))
    return p.select("pool_id", "primary_in", "primary_off", "supplement_in", "supplement_off", short("target_in_domain", "primary_in", "supplement_in").alias("short_in"), short("target_off_topic", "primary_off", "supplement_off").alias("short_off"))


@query(f"""WITH {v.RUNS}, x AS (SELECT question_idx, eval_persona, variant, agent, prediction, {OK_SQL} AS ok, run_id FROM runs), a AS (SELECT * FROM x WHERE agent = 'agent_3'), b AS (SELECT * FROM x WHERE agent = 'agent_3_v2')
    SELECT a.run_id AS run_a, b.run_id AS run_b, a.ok = b.ok AS em_match FROM a JOIN b USING (question_idx, eval_persona, variant)""")
def compare_runs(spark, d):
    """One agent against its successor on the same units."""
    x = _scored(spark, d).select("question_idx", "eval_persona", "variant", "agent", "correct", "run_id")
    a = x.where("agent = 'agent_3'").select("question_idx", "eval_persona", "variant", F.col("run_id").alias("run_a"), F.col("correct").alias("ca"))
    b = x.where("agent = 'agent_3_v2'").select("question_idx", "eval_persona", "variant", F.col("run_id").alias("run_b"), F.col("correct").alias("cb"))
    return a.join(b, ["question_idx", "eval_persona", "variant"]).select("run_a", "run_b", (F.col("ca") == F.col("cb")).alias("em_match"))


@query(f"WITH {v.QUESTIONS}, m AS (SELECT median(hop_count) AS h FROM questions) SELECT question_idx, coalesce(hop_count::DOUBLE, h) AS hops FROM questions, m")
def median_impute(spark, d):
    return reports.with_median(v.questions(spark, d), "hop_count", "hops").select("question_idx", "hops")


@query(f"WITH {v.QUESTIONS} SELECT original_persona, count(*) AS n, round(avg(hop_count), 6) AS mean_hops, min(hop_count) AS min_hops, max(hop_count) AS max_hops, count(*) FILTER (hop_count = 2) AS two_hops FROM questions GROUP BY 1")
def hop_stats(spark, d):
    q = v.questions(spark, d)
    return q.groupBy("original_persona").agg(F.count("*").alias("n"), F.round(F.avg("hop_count"), 6).alias("mean_hops"), F.min("hop_count").alias("min_hops"), F.max("hop_count").alias("max_hops"), F.count_if(F.col("hop_count") == 2).alias("two_hops"))


@query(f"WITH {v.MANIFEST} SELECT count(DISTINCT coalesce(source_question_id, '')) AS n_questions, count(DISTINCT coalesce(evidence_id, '')) AS n_evidence FROM manifest")
def distinct_counts(spark, d):
    return v.manifest(spark, d).agg(F.count_distinct(F.coalesce("source_question_id", F.lit(""))).alias("n_questions"), F.count_distinct(F.coalesce("evidence_id", F.lit(""))).alias("n_evidence"))


@query(f"WITH {v.QUESTIONS} SELECT hop_count, count(*) AS n FROM questions GROUP BY 1 HAVING count(*) < 20")
def low_coverage(spark, d):
    return reports.low_coverage(v.questions(spark, d), "hop_count", 20)


@query(f"WITH {v.QUESTIONS} SELECT CASE WHEN grouping(original_persona) = 1 THEN 'All' ELSE coalesce(original_persona, '(null)') END AS original_persona, CASE WHEN grouping(question_type) = 1 THEN 'All' ELSE coalesce(question_type, '(null)') END AS question_type, count(*) AS n FROM questions GROUP BY CUBE (original_persona, question_type)")
def covariate_crosstab(spark, d):
    return reports.crosstab_with_margins(v.questions(spark, d), "original_persona", "question_type")


@query(f"""WITH {v.MANIFEST} SELECT count(*) AS n_sessions, count(*) FILTER (session_parse_error IS NOT NULL) AS n_failed, count(*) FILTER (session_parse_error LIKE 'json%') AS n_json, count(*) FILTER (session_parse_error LIKE 'turn count%') AS n_turns,
    count(*) FILTER (session_parse_error LIKE 'empty%') AS n_empty, count(*) FILTER (session_parse_error LIKE 'missing%') AS n_missing FROM manifest""")
def audit_stats(spark, d):
    e = F.col("session_parse_error")
    return v.manifest(spark, d).agg(F.count("*").alias("n_sessions"), F.count_if(e.isNotNull()).alias("n_failed"), F.count_if(e.startswith("json")).alias("n_json"), F.count_if(e.startswith("turn count")).alias("n_turns"), F.count_if(e.startswith("empty")).alias("n_empty"), F.count_if(e.startswith("missing")).alias("n_missing"))


@query(f"""WITH {v.RUNS}, bad AS (SELECT DISTINCT block_id, variant, eval_persona FROM runs WHERE prediction = '[INFERENCE_FAILED]') SELECT run_id, bad.block_id IS NOT NULL AS cell_failed
    FROM runs LEFT JOIN bad ON bad.block_id = runs.block_id AND bad.variant = runs.variant AND bad.eval_persona = runs.eval_persona""")
def failed_cells(spark, d):
    r = v.runs(spark, d, "block_id", "variant", "eval_persona", "prediction")
    bad = r.where(F.col("prediction") == reports.FAILED).select("block_id", "variant", "eval_persona").distinct().withColumn("f", F.lit(True))
    return r.join(bad, ["block_id", "variant", "eval_persona"], "left").select("run_id", F.coalesce("f", F.lit(False)).alias("cell_failed"))


@query(f"WITH {v.RUNS}, {v.SCREENING} SELECT DISTINCT question_idx FROM runs WHERE question_idx NOT IN (SELECT question_idx FROM screening WHERE question_idx IS NOT NULL)")
def resume_antijoin(spark, d):
    """Questions of runs that were never screened: what a resumed screening would still do."""
    todo = v.runs(spark, d, "question_idx").select("question_idx").distinct()
    return relational.pending(todo, table(spark, d, "screening_results"), "question_idx")


@query(f"""WITH {v.RUNS}, {v.MANIFEST}, s AS (SELECT run_id, unnest(list_transform(retrieved_memory, lambda x: x.session_id)) AS sid FROM runs)
    SELECT CASE WHEN m.custom_id IS NULL THEN 'unknown id' WHEN m.session_parse_error IS NOT NULL THEN 'parse error' ELSE 'ok' END AS outcome, count(*) AS n FROM s LEFT JOIN manifest m ON m.custom_id = s.sid GROUP BY 1""")
def batch_merge_errors(spark, d):
    """Retrieved sessions against the manifest: unknown ids, parse errors, sound ones."""
    s = v.runs(spark, d, "retrieved_memory").select(F.explode("retrieved_memory.session_id").alias("custom_id"))
    m = v.manifest(spark, d).select("custom_id", F.lit(1).alias("known"), "session_parse_error")
    outcome = F.when(F.col("known").isNull(), "unknown id").when(F.col("session_parse_error").isNotNull(), "parse error").otherwise("ok")
    return s.join(m, "custom_id", "left").groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query(f"WITH {v.RUNS}, r AS (SELECT run_id, 'latency_s' AS metric, latency_s AS value FROM runs UNION ALL SELECT run_id, 'total_tokens', total_tokens::DOUBLE FROM runs) SELECT run_id, metric, value FROM r WHERE value IS NOT NULL")
def unpivot_metrics(spark, d):
    r = v.runs(spark, d, "latency_s", "total_tokens").select("run_id", "latency_s", F.col("total_tokens").cast("double").alias("total_tokens"))
    return r.unpivot("run_id", ["latency_s", "total_tokens"], "metric", "value").where("value is not null")


# Sampling.


@query(f"WITH {v.QUESTIONS} SELECT question_idx, {v.hash_sql(42, 'question_idx')} AS h FROM questions ORDER BY h, question_idx LIMIT 50".replace("SELECT question_idx, ", "SELECT question_idx FROM (SELECT question_idx, ").replace(" FROM questions ORDER", " FROM questions) ORDER"))
def simple_sample(spark, d):
    return sampling.least_hashes(v.questions(spark, d), "question_idx", 50).select("question_idx")


@query(f"WITH {v.QUESTIONS}, c AS (SELECT question_idx FROM (SELECT question_idx, {v.hash_sql(42, 'question_idx')} AS h FROM questions) ORDER BY h, question_idx LIMIT 50) SELECT question_idx FROM questions WHERE question_idx NOT IN (SELECT question_idx FROM c)")
def sample_rest(spark, d):
    return sampling.sample_and_rest(v.questions(spark, d), "question_idx", 50)[1].select("question_idx")


_ALLOC = f"""{v.QUESTIONS}, w AS (SELECT original_persona, count(*)::DOUBLE AS weight FROM questions WHERE original_persona IS NOT NULL AND question_type <> 'null_query' GROUP BY 1),
  a AS (SELECT original_persona, weight, round(60 * weight / sum(weight) OVER (), 9) AS raw FROM w), b AS (SELECT *, floor(raw) AS base FROM a),
  alloc AS (SELECT original_persona, (base + CASE WHEN row_number() OVER (ORDER BY round(raw - base, 9) DESC, original_persona) <= 60 - sum(base) OVER () THEN 1 ELSE 0 END)::BIGINT AS n FROM b)"""


def _alloc(spark, d, total=60):
    q = v.questions(spark, d).where("original_persona is not null and question_type <> 'null_query'")
    w = q.groupBy("original_persona").agg(F.count("*").cast("double").alias("weight"))
    return q, sampling.largest_remainder(w, total, order="original_persona").select("original_persona", "n")


@query(f"WITH {_ALLOC} SELECT original_persona, n FROM alloc")
def largest_remainder(spark, d):
    return _alloc(spark, d)[1]


@query(f"""WITH {_ALLOC}, r AS (SELECT question_idx, original_persona, row_number() OVER (PARTITION BY original_persona ORDER BY {v.hash_sql(42, 'question_idx')}, question_idx) AS rn FROM questions WHERE original_persona IS NOT NULL AND question_type <> 'null_query')
    SELECT question_idx, original_persona FROM r JOIN alloc USING (original_persona) WHERE rn <= n""")
def stratified_sample(spark, d):
    q, alloc = _alloc(spark, d)
    return sampling.stratified(q, "original_persona", "question_idx", alloc).select("question_idx", "original_persona")


@query(f"""WITH {_ALLOC}, pool AS (SELECT * FROM questions WHERE original_persona IS NOT NULL AND question_type <> 'null_query'),
  l AS (SELECT question_idx, 'question_type' AS covariate, question_type AS level FROM pool UNION ALL SELECT question_idx, 'hop_count', hop_count::VARCHAR FROM pool WHERE hop_count IS NOT NULL),
  z AS (SELECT covariate, level, count(*) AS size, count(*)::DOUBLE / (SELECT count(*) FROM pool) * 60 AS expected FROM l GROUP BY ALL),
  need AS (SELECT covariate, level, CASE WHEN size < 12 THEN size WHEN expected < 12 THEN 12 - floor(expected)::BIGINT ELSE 0 END AS need FROM z),
  rk AS (SELECT question_idx, covariate, level, row_number() OVER (PARTITION BY covariate, level ORDER BY {v.hash_sql(42, 'question_idx')}, question_idx) AS rn FROM l),
  res AS (SELECT DISTINCT question_idx FROM rk JOIN need USING (covariate, level) WHERE rn <= need),
  f AS (SELECT p.question_idx, p.original_persona, res.question_idx IS NOT NULL AS reserved, row_number() OVER (PARTITION BY p.original_persona ORDER BY (res.question_idx IS NOT NULL)::INT DESC, {v.hash_sql(42, 'p.question_idx')}, p.question_idx) AS rn
    FROM pool p LEFT JOIN res ON res.question_idx = p.question_idx) SELECT question_idx, original_persona, reserved::INT AS reserved FROM f JOIN alloc USING (original_persona) WHERE rn <= n""")
def coverage_sample(spark, d):
    q, alloc = _alloc(spark, d)
    return sampling.coverage_sample(q, "question_idx", "original_persona", alloc, ["question_type", "hop_count"], 12).select("question_idx", "original_persona", "reserved")


@query(f"WITH {v.QUESTIONS}, s AS (SELECT question_idx, {v.hash_sql(42, 'question_idx')} AS h FROM questions WHERE question_type = 'null_query') SELECT question_idx FROM s ORDER BY h, question_idx LIMIT 12")
def null_query_sample(spark, d):
    return sampling.least_hashes(v.questions(spark, d).where("question_type = 'null_query'"), "question_idx", 12).select("question_idx")


_TIER = f"""{v.MANIFEST}, m AS (SELECT pool_id, custom_id, evidence_id, CASE WHEN pool_tier = 'primary' THEN 1 ELSE 2 END AS tier, {v.hash_sql(42, 'custom_id')} AS h FROM manifest WHERE session_parse_error IS NULL AND NOT is_off_topic),
  o AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY pool_id, evidence_id ORDER BY tier, h, custom_id) = 1),
  k AS (SELECT *, row_number() OVER (PARTITION BY pool_id ORDER BY tier, h, custom_id) AS place FROM o)"""


@query(f"WITH {_TIER} SELECT k.pool_id, custom_id, tier, place FROM k JOIN pool_inventory p ON p.pool_id = k.pool_id WHERE place <= p.target_in_domain")
def tiered_fill(spark, d):
    m = v.manifest(spark, d).where("session_parse_error is null and not is_off_topic").join(table(spark, d, "pool_inventory").select("pool_id", "target_in_domain"), "pool_id")
    return sampling.tiered_fill(m, ["pool_id"], "custom_id", "evidence_id", F.when(F.col("pool_tier") == "primary", 1).otherwise(2), F.col("target_in_domain")).select("pool_id", "custom_id", "tier", "place")


@query()
def diversity_sample(spark, d):
    m = v.manifest(spark, d, "session_parse_error", "target_persona_id", "scenario_category", "turn_range", "topic_drift").where("session_parse_error is null")
    m = m.withColumn("turns", text.turn_range_label(F.col("turn_range")))
    weights = {p: {"scenario_category": w["categories"], "turns": dict(zip(sampling.TURN_RANGES, w["turns"])), "topic_drift": sampling.drift_weights(w)} for p, w in sampling.PROFILES.items()}
    return sampling.diversity_sample(m, "target_persona_id", "custom_id", ["scenario_category", "turns", "topic_drift"], 100, weights)


@query(f"""WITH {v.QUESTIONS}, x AS (SELECT question_idx, CASE WHEN question_type IN ('null_query', 'temporal_query') THEN question_type ELSE 'other' END AS role, CASE WHEN question_type IN ('null_query', 'temporal_query') THEN lpad(question_idx::VARCHAR, 20, '0') ELSE {v.hash_sql(42, 'question_idx')} END AS o FROM questions)
    SELECT question_idx, role FROM x QUALIFY row_number() OVER (PARTITION BY role ORDER BY o, question_idx) = 1""")
def smoke_subset(spark, d):
    return sampling.smoke_subset(v.questions(spark, d), "question_idx", "question_type").select("question_idx", "role")


def _pick(unit: str, names, weights) -> str:
    upper, out = 0.0, "CASE"
    for k, w in zip(names, weights):
        upper += w / sum(weights)
        out += f" WHEN {unit} < {upper!r}::DOUBLE THEN '{k}'"
    return f"{out} ELSE '{names[-1]}' END"


_U = {n: v.unit_sql(42, f"'{n}'", "evidence_id", "persona") for n in ("category", "turns", "drift", "scenario", "placement", "density", "message")}
_P = sampling.PROFILES
_BY = lambda f: "CASE persona " + " ".join(f"WHEN '{p}' THEN {f(w)}" for p, w in _P.items()) + f" ELSE {f(sampling.GLOBAL)} END"
_DRIFT = lambda w: "CASE turns " + " ".join(f"WHEN '{t}' THEN {_pick(_U['drift'], sampling.TOPIC_DRIFTS, x)}" for t, x in zip(sampling.TURN_RANGES, w["drift"])) + " END"


@query(f"""WITH {v.EVIDENCE}, p AS (SELECT evidence_id, unnest({[*_P, "persona_4"]}) AS persona FROM evidence), c AS (SELECT *, {_BY(lambda w: _pick(_U['category'], list(w['categories']), list(w['categories'].values())))} AS category FROM p),
    t AS (SELECT *, CASE WHEN category = 'transactional' THEN {_pick(_U['turns'], sampling.TURN_RANGES[:2], sampling.TRANSACTIONAL['turns'])} ELSE {_BY(lambda w: _pick(_U['turns'], sampling.TURN_RANGES, w['turns']))} END AS turns FROM c)
    SELECT evidence_id, persona, category, turns, CASE WHEN category = 'transactional' THEN {_pick(_U['drift'], sampling.TOPIC_DRIFTS[:2], sampling.TRANSACTIONAL['drift'])} ELSE {_BY(_DRIFT)} END AS drift,
      (floor({_U['scenario']} * CASE category WHEN 'transactional' THEN 3 ELSE 6 END) + 1)::INT AS scenario_no, CASE WHEN category = 'transactional' THEN 'early' ELSE {_pick(_U['placement'], sampling.PLACEMENTS, [1, 1, 1])} END AS placement,
      {_pick(_U['density'], sampling.DENSITIES, [1, 1])} AS density, (floor({_U['message']} * 10) + 1)::INT AS message_no FROM t""")
def diversity_draw(spark, d):
    e = v.evidence(spark, d, "url").select("evidence_id", F.explode(F.array(*[F.lit(p) for p in [*_P, "persona_4"]])).alias("persona"))
    return sampling.diversity_draw(e, "evidence_id", "persona")


@query(f"""WITH {v.MANIFEST}, x AS (SELECT custom_id, greatest(coalesce(try_strptime(left(session_date, 10), '%Y/%m/%d')::DATE, DATE '2023-07-01'), DATE '2023-07-01') AS first, {v.unit_sql(42, "'delay'", 'custom_id')} AS u, {v.unit_sql(42, "'second'", 'custom_id')} AS w FROM manifest),
    y AS (SELECT *, date_diff('day', first, DATE '2024-02-29') AS span FROM x),
    z AS (SELECT *, greatest(0, least(floor(-14.0::DOUBLE * ln(1 - u * (1 - exp(-span / 14.0::DOUBLE))))::INT, span)) AS n FROM y)
    SELECT custom_id, (first + n::INT)::TIMESTAMP + to_seconds(floor(w * 54000)::BIGINT + 28800) AS session_time FROM z""")
def corpus_timestamps(spark, d):
    m = v.manifest(spark, d).select("custom_id", F.to_timestamp(F.substring("session_date", 1, 10), "yyyy/MM/dd").alias("published"))
    return sampling.session_times(m, "custom_id", F.col("published"), "2023-07-01", "2024-02-29").select("custom_id", "session_time")


_CELLS = [(v_, f"agent_{a}") for v_ in ("memory_only", "document_only", "integrated") for a in range(1, 5)]


@query(f"""WITH {v.QUESTIONS}, c AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(_CELLS))}) AS t(i, dist, agent)), k AS (SELECT question_idx, (question_idx + s * 3) % 12 AS i FROM questions, (SELECT unnest([0, 1, 2, 3]) AS s))
    SELECT question_idx, dist, agent FROM k JOIN c USING (i)""")
def block_design(spark, d):
    """Four of the twelve cells per question, every cell equally often."""
    return sampling.cyclic_block_design(v.questions(spark, d), "question_idx", _CELLS, 4)


# Row shapes and derived numbers.


@query(f"WITH {v.RUNS} SELECT question_idx, block_id, original_persona, eval_persona, variant, agent, prediction, gold_answer, coalesce(question_type, '') AS question_type FROM runs")
def run_rows(spark, d):
    return rows.run_rows(v.runs(spark, d, "question_idx", "block_id", "original_persona", "eval_persona", "variant", "agent", "prediction", "gold_answer", "question_type"))


@query(f"WITH {v.QUESTIONS} SELECT question_idx, ('0x' || left(sha256('42:' || question_id), 8))::BIGINT AS seed, ('0x' || substr({v.hash_sql(42, "'coin'", 'question_id')}, 1, 8))::BIGINT % 2 AS coin FROM questions")
def row_seeds(spark, d):
    q = v.questions(spark, d, "question_id")
    return q.select("question_idx", rows.row_seed(42, F.col("question_id")).alias("seed"), rows.coin(42, F.col("question_id")).alias("coin"))


_MARGINAL = [(p, t, w["turns"][i], lvl, w["drift"][i][j]) for p, w in sampling.PROFILES.items() for i, t in enumerate(sampling.TURN_RANGES) for j, lvl in enumerate(sampling.TOPIC_DRIFTS)]


@query(f"""WITH x AS (SELECT * FROM (VALUES {', '.join(f"('{p}', {w}::DOUBLE, '{lvl}', {s}::DOUBLE)" for p, _, w, lvl, s in _MARGINAL)}) AS t(persona, w, drift, s)), g AS (SELECT persona, drift, sum(w * s) AS raw FROM x GROUP BY ALL)
    SELECT persona, drift, round(raw / sum(raw) OVER (PARTITION BY persona), 6) AS share FROM g""")
def drift_marginal(spark, d):
    """Topic drift per persona: the drift weights of its turn ranges, averaged by the turn-range weights."""
    rows_ = F.array(*[F.struct(F.lit(p).alias("persona"), F.concat(F.lit(p + " "), F.lit(t)).alias("k"), F.lit(w).alias("weight"), F.lit(lvl).alias("drift"), F.lit(s).alias("share")) for p, t, w, lvl, s in _MARGINAL])
    x = spark.range(1).select(F.explode(rows_).alias("x")).select("x.*")
    return rows.weighted_marginal(x.select("persona", "k", "weight").distinct(), x.select("k", "drift", "share"), "persona", "k", "drift")


@query(f"""WITH {v.TURNS}, {v.MANIFEST} SELECT session_id, (count(*) // 2)::INT AS turns, count(*) FILTER (role = 'user') > 0 AND count(*) FILTER (role = 'assistant') > 0 AS complete FROM turns GROUP BY 1""")
def actual_turns(spark, d):
    t = v.turns(spark, d).groupBy("session_id").agg(F.count("*").alias("n"), F.array_compact(F.collect_list(F.when(F.col("role") == "user", F.col("turn")))).alias("u"), F.array_compact(F.collect_list(F.when(F.col("role") == "assistant", F.col("turn")))).alias("a"))
    return t.select("session_id", rows.actual_turns(F.col("n"), F.lit(0)).alias("turns"), rows.all_required_present(F.col("u"), F.col("a"), F.col("u"), F.lit(None).cast("array<int>"), F.lit(False)).alias("complete"))


@query(f"WITH {v.QUESTIONS}, {v.EVIDENCE} SELECT question_idx, count(e.evidence_id) AS hop_count FROM questions q LEFT JOIN evidence e ON e.source_question_id = q.question_id GROUP BY 1")
def hop_counts(spark, d):
    """Hops of a question: the pieces of its evidence in memory and in documents."""
    n = v.evidence(spark, d, "source_question_id").groupBy(F.col("source_question_id").alias("question_id")).agg(F.collect_list("evidence_id").alias("e"))
    q = v.questions(spark, d, "question_id").select("question_idx", "question_id").join(n, "question_id", "left")
    half = F.floor(F.size("e") / 2).cast("int")
    return q.select("question_idx", F.when(F.col("e").isNull(), 0).otherwise(rows.hop_count(F.slice("e", F.lit(1), half), F.slice("e", half + 1, F.size("e")))).cast("long").alias("hop_count"))


@query(f"""WITH {v.QUESTIONS}, m AS (SELECT trim(query) AS query, min(original_persona) AS persona FROM questions WHERE original_persona IS NOT NULL GROUP BY 1 HAVING count(DISTINCT original_persona) = 1)
    SELECT q.question_idx, coalesce(m.persona, 'tbd') AS persona FROM questions q LEFT JOIN m ON m.query = trim(q.query)""")
def persona_column(spark, d):
    """The persona of each question by its query, tbd where the map has none."""
    q = v.questions(spark, d, "query", "original_persona")
    known = q.where("original_persona is not null").groupBy(F.trim("query").alias("query")).agg(F.min("original_persona").alias("persona"), F.count_distinct("original_persona").alias("n")).where("n = 1").drop("n")
    return rows.attach_persona(q, known).select("question_idx", "persona")


@query(f"WITH {v.MANIFEST} SELECT coalesce(nullif(target_persona_id, ''), 'unknown') AS persona, count(*) AS n FROM manifest GROUP BY 1")
def records_by_persona(spark, d):
    m = v.manifest(spark, d, "target_persona_id")
    return m.groupBy(rows.record_persona(m).alias("persona")).agg(F.count("*").alias("n"))


@query(f"""WITH {v.RUNS}, {v.MANIFEST}, s AS (SELECT DISTINCT sid FROM (SELECT unnest(list_transform(retrieved_memory, lambda x: x.session_id)) AS sid FROM runs) WHERE sid <> '')
    SELECT count(*) FILTER (m.custom_id IS NOT NULL) AS joined, count(*) FILTER (m.custom_id IS NULL) AS orphans, count(*) FILTER (m.custom_id IS NOT NULL AND m.session_parse_error IS NULL) AS ok, count(*) FILTER (m.session_parse_error IS NOT NULL) AS failed
    FROM s LEFT JOIN manifest m ON m.custom_id = s.sid""")
def audit_run_stats(spark, d):
    """Retrieved sessions against the manifest: joined, without an entry, sound, failed."""
    s = v.runs(spark, d, "retrieved_memory").select(F.explode("retrieved_memory.session_id").alias("session_id")).where("session_id <> ''").distinct()
    m = v.manifest(spark, d, "session_parse_error").select(F.col("custom_id").alias("session_id"), "session_parse_error", F.lit(True).alias("known"))
    j = s.join(m, "session_id", "left")
    return j.agg(F.count("known").alias("joined"), F.count_if(F.col("known").isNull()).alias("orphans"), F.count_if(F.col("known") & F.col("session_parse_error").isNull()).alias("ok"), F.count_if(F.col("session_parse_error").isNotNull()).alias("failed"))


@query(f"""WITH {v.RUNS}, x AS (SELECT run_id, i - 1 AS pos, retrieved_documents[i] AS r FROM (SELECT run_id, retrieved_documents, unnest(range(1, len(retrieved_documents) + 1)) AS i FROM runs))
    SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY coalesce(r.score, 0) DESC, pos) AS place, r.url AS url FROM x""")
def document_chunks_by_score(spark, d):
    """All document chunks of a run by score, repeated urls kept."""
    return metrics.chunks_by_score(v.runs(spark, d, "retrieved_documents"), "retrieved_documents").select("run_id", F.col("place").cast("long").alias("place"), F.col("r.url").alias("url"))
