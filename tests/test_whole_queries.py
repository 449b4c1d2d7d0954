"""Registered queries do the whole job; cut texts and unknown personas are fixtures here, not parts of a query."""

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from evplace.operators import evidence as ev
from evplace.operators import metrics, sampling
from evplace.operators.chunking import chunk_pair
from evplace.plans import evidence_queries as eq
from evplace.plans import report_queries
from evplace.plans import views as v


def test_strict_hits_see_whole_documents(spark):
    e = v.evidence(spark, SMALL, "url", "fact").groupBy("url").agg(F.min(F.length("fact")).alias("n"))
    got = v.runs(spark, SMALL, "retrieved_documents").select("run_id", F.explode("retrieved_documents.url").alias("url")).distinct()
    hits = eq.strict_doc_hit(spark, SMALL).join(got, ["run_id", "url"]).join(e, "url").where("n > 60")
    per = {r["m"]: (r["n"], r["hits"]) for r in hits.groupBy((F.col("run_id") % 3).alias("m")).agg(F.count("*").alias("n"), F.count_if("hit").alias("hits")).collect()}
    assert per[0][0] > 0 and all(n == k for n, k in per.values())


def test_strict_hit_of_a_cut_text(spark):
    fact = "the harbour company sold the old dock to the city after a long dispute over its debts"
    df = spark.createDataFrame([(fact, ["A Title\n" + fact]), (fact, ["A Title\n" + fact[:60]])], "f string, x array<string>")
    hit = metrics.strict_doc_hit(F.col("f"), F.lit("A Title"), F.lit("Src"), F.col("x"))
    assert [r[0] for r in df.select(hit).collect()] == [True, False]


def test_pair_match_takes_whole_texts(spark):
    pairs = chunk_pair(v.turns(spark, SMALL))
    norm = metrics.evidence_normalise(F.col("text"))
    alone = pairs.groupBy("session_id", norm.alias("t")).agg(F.count("*").alias("n"), F.min("chunk_index").alias("want")).where("n = 1")
    want = {f"{r['session_id']}#{r['want']}": r["want"] for r in alone.collect()}
    got = {r["key"]: r["chunk_index"] for r in eq.pair_match(spark, SMALL).collect()}
    assert len(got) == pairs.count() and {k: x for k, x in got.items() if x is not None} == want


def test_pair_match_tells_pairs_of_one_beginning_apart(spark, tmp_path):
    text = "User: the harbour was sold to Anna\nUser: the harbour was sold to Bert"
    spark.createDataFrame([(1, text, "session")], "doc_id long, text string, doc_kind string").write.parquet(f"{tmp_path}/documents.parquet")
    assert dict(map(tuple, eq.pair_match(spark, str(tmp_path)).collect())) == {"1#0": 0, "1#1": 1}


def test_pair_of_a_text_cut_in_half(spark):
    p = spark.createDataFrame([("s", 0, "user: the harbour was sold"), ("s", 1, "user: the dock was not")], "session_id string, chunk_index int, text string")
    half = p.where("chunk_index = 1").select(F.lit("k").alias("key"), "session_id", F.substring("text", 1, 14).alias("text"))
    assert metrics.match_pairs(half, p).first()["chunk_index"] == 1


def test_domain_predicates_keep_the_persona(spark, tmp_path):
    ids = ["a" * 6, "a" * 7, "a" * 14]
    m = spark.createDataFrame([(i, "e", "persona_1") for i in ids], "custom_id string, evidence_id string, target_persona_id string").withColumn("arrived_at", F.current_timestamp())
    m.write.parquet(f"{tmp_path}/session_manifest.parquet")
    spark.createDataFrame([(1, "e", "technology")], "row_id long, evidence_id string, category string").write.parquet(f"{tmp_path}/evidence_items.parquet")
    got = eq.domain_predicates(spark, str(tmp_path)).collect()
    assert {tuple(r)[1:] for r in got} == {(True, True, False, True, False)} and sorted(r[0] for r in got) == ids


@pytest.mark.parametrize("persona,want", [("persona_x", (False, True, False)), ("persona_3", (False, False, True))])
def test_domain_rules_of_an_unknown_persona(spark, persona, want):
    c, p = F.lit("technology"), F.lit(persona)
    row = spark.range(1).select(ev.evidence_in_domain(c, p), ev.session_in_domain(c, p), ev.is_off_topic(F.array(c), p)).first()
    assert tuple(row) == want


def test_persona_corpus_is_filled_to_its_size(spark, tmp_path):
    n = F.col("id")
    m = spark.range(1200).select(
        F.concat(F.lit("c"), n).alias("custom_id"), F.lit("pool").alias("pool_id"), F.when(n % 4 == 0, "primary").otherwise("supplement").alias("pool_tier"), F.lit("persona_1").alias("target_persona_id"),
        F.concat(F.lit("e"), n % 1000).alias("evidence_id"), F.when(n % 40 == 1, "professional").otherwise("casual").alias("scenario_category"), F.array(F.lit(4), F.lit(4)).alias("turn_range"),
        F.lit("tight").alias("topic_drift"), (n % 3 == 0).alias("is_off_topic"), F.lit(None).cast("string").alias("session_parse_error"), F.lit("2023/08/01 (Tue) 10:00").alias("session_date"), F.current_timestamp().alias("arrived_at"),
    )
    m.write.parquet(f"{tmp_path}/session_manifest.parquet")
    got = eq.persona_corpus(spark, str(tmp_path)).join(m.select("custom_id", "evidence_id", "pool_tier", "scenario_category"), "custom_id").collect()
    assert sum(not r["is_off_topic"] for r in got) == 375 and sum(r["is_off_topic"] for r in got) == 125
    assert len({r["evidence_id"] for r in got}) == 500
    # Tier 1 is used up first; then every rare professional session comes, as its share asks for more than there are.
    inside = [r for r in got if not r["is_off_topic"]]
    assert sum(r["tier"] == 1 for r in inside) == m.where("pool_tier = 'primary' and not is_off_topic").select("evidence_id").distinct().count()
    free = m.where("pool_tier = 'supplement' and not is_off_topic and scenario_category = 'professional'").join(m.where("pool_tier = 'primary' and not is_off_topic").select("evidence_id"), "evidence_id", "left_anti")
    assert sum(r["tier"] == 2 and r["scenario_category"] == "professional" for r in inside) == free.select("evidence_id").distinct().count() > 0


def test_spread_over_levels_follows_weights_and_evidence():
    rows = [(i, f"e{i % 50}", "a" if i < 40 else "b") for i in range(60)]
    used = {"e0"}
    got = sampling.spread_over_levels(rows, 10, [{"a": 0.5, "b": 0.5}], used)
    assert len(got) == 10 and sum(r[2] == "b" for r in got) == 5 and "e0" not in {r[1] for r in got} and len({r[1] for r in got}) == 10
    assert len(sampling.spread_over_levels(rows, 100, [{"a": 1.0}], set())) == 50


def test_strict_recall_counts_document_and_memory_gold(spark):
    docs = spark.createDataFrame([(1, True), (1, False), (2, True)], "run_id long, hit boolean")
    gold = spark.createDataFrame([(1, "s"), (1, "t"), (3, "s"), (3, "u")], "run_id long, session_id string")
    hits = spark.createDataFrame([(1, "s", False), (1, "s", True), (3, "x", True)], "run_id long, session_id string, hit boolean")
    got = lambda *h: {r["run_id"]: (r["n_gold"], r["strict_recall"]) for r in metrics.strict_recall(docs, gold, *h).collect()}
    assert got(hits) == {1: (4, 0.5), 2: (1, 1.0), 3: (2, 0.0)} and got() == {1: (4, 0.25), 2: (1, 1.0), 3: (2, 0.0)}


def test_strict_recall_has_every_run_with_gold(spark):
    want = {r["run_id"]: r["n_gold"] for r in eq.recall_at_k_mixed(spark, SMALL).where("n_gold > 0").collect()}
    assert {r["run_id"]: r["n_gold"] for r in eq.strict_recall(spark, SMALL).collect()} == want


def test_supplement_candidates_follow_the_shortfall(spark):
    short = spark.read.parquet(f"{SMALL}/pool_inventory.parquet").select("pool_id", "persona_id").join(report_queries.pool_inventory_counts(spark, SMALL), "pool_id")
    need = {}
    for r in short.collect():
        for domain, n in (("in_domain", r["short_in"]), ("off_topic", r["short_off"])):
            need[r["persona_id"], domain] = need.get((r["persona_id"], domain), 0) + 3 * n
    have = {(r["target_persona_id"], r["evidence_id"]) for r in v.manifest(spark, SMALL).collect()}
    free = {}
    for r in v.evidence(spark, SMALL, "category").collect():
        for p in ("persona_1", "persona_2", "persona_3"):
            inside = (r["category"] or "").strip().lower() in ev.PERSONA_DOMAINS[p]
            if (p, r["evidence_id"]) not in have:
                free.setdefault((p, "in_domain" if inside else "off_topic"), set()).add(r["evidence_id"])
    got = {}
    for r in eq.supplement_candidates(spark, SMALL).collect():
        got.setdefault((r["persona"], r["domain"]), set()).add(r["evidence_id"])
    assert {k: len(x) for k, x in got.items()} == {k: min(n, len(free.get(k, ()))) for k, n in need.items() if min(n, len(free.get(k, ())))}
    assert all(x <= free[k] for k, x in got.items()) and {d for _, d in got} == {"in_domain", "off_topic"}
