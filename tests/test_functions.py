"""One rule each: normalisation, ids, domains, recall, chunking, allocation."""

import hashlib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evplace.functions import ids, text
from evplace.operators import evidence as ev
from evplace.operators import metrics, relational, reports, rows, sampling
from evplace.operators.chunking import chunk_pair, chunk_recursive, chunk_session, chunk_turn, chunk_words, session_turns, split_recursive, transcript


def one(spark, column, **values):
    types = ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'array<string>' if isinstance(v, list) else 'boolean' if isinstance(v, bool) else 'bigint' if isinstance(v, int) else 'double'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], types).select(column).first()[0]


def test_exact_match_variants(spark):
    p, g = F.col("p"), F.col("g")
    assert one(spark, text.exact_match(p, g, False), p="a_b", g="ab") and not one(spark, text.exact_match(p, g), p="a_b", g="ab")
    assert one(spark, text.exact_match(p, g), p=None, g="") and one(spark, text.exact_match(p, g), p="The  Cafés.", g="cafés")


@pytest.mark.parametrize("p,g,f1", [("x x y", "x y y", 0.666667), ("", "", 1.0), ("", "x", 0.0), (None, None, 1.0), ("a b", "c d", 0.0), ("the cat sat", "cat", 0.666667)])
def test_token_f1(spark, p, g, f1):
    assert one(spark, text.token_f1(F.col("p"), F.col("g")), p=p, g=g) == f1


def test_containment(spark):
    n, h = F.col("n"), F.col("h")
    assert one(spark, text.covers(n, h), n="“Big”  News", h="the big news'")
    assert not one(spark, text.covers(n, h), n="", h="x") and not one(spark, text.covers(n, h), n=None, h="x")
    assert one(spark, text.pool_covers(n, F.col("t")), n="end start", t=["the end", "start here"])


def test_labels(spark):
    assert one(spark, text.shorten(F.col("s"), 10), s="abcdefghijk") == "abcdefg..." and one(spark, text.shorten(F.col("s"), 10), s="abcdefghij") == "abcdefghij"
    assert one(spark, text.turn_range_label(F.col("t")), t=["4", "6"]) == "4-6"
    assert one(spark, text.markdown_cell(F.col("s")), s="a|b\nc") == "a\\|b c" and one(spark, text.markdown_fence(F.col("s")), s="```x") == "'''x"


def test_grading_reply(spark):
    tags = F.array(F.lit("M1"), F.lit("M10"))
    r = F.col("r")
    assert one(spark, text.grading_reply(r, tags), r="M10") == ["M1", "M10"] and one(spark, text.grading_reply(r, tags, True), r="M10") == ["M10"]
    assert one(spark, text.grading_reply(r, tags), r="None.") == [] and one(spark, text.grading_reply(r, tags), r=None) == []
    assert one(spark, text.grading_reply(r, tags), r="none of these but m1 is close enough") == ["M1"]


def test_ids(spark):
    q = " Who? \n"
    assert one(spark, ids.question_id(F.col("q")), q=q) == hashlib.sha256(b"Who?").hexdigest()
    fields = {"author": None, "category": "a", "fact": 'say "é"\n', "published_at": "", "source": "s", "title": "t/u", "url": "u"}
    canonical = json.dumps({k: (v or "").strip() for k, v in fields.items()}, sort_keys=True, ensure_ascii=False)
    got = one(spark, ids.scoped_evidence_id(F.lit("q1"), {k: F.col(k) for k in fields}), **fields)
    assert got == hashlib.sha256(f"q1\n{canonical}".encode()).hexdigest()[:32]
    sid = one(spark, ids.session_id(F.col("q"), F.lit("e1"), F.lit("persona_2")), q=q)
    assert sid == "q-" + hashlib.sha256(b"Who?").hexdigest()[:16] + "__ev-e1__p-persona_2"
    assert one(spark, ids.evidence_id_of_session(F.col("s")), s=sid) == "e1" and one(spark, ids.persona_of_session(F.col("s")), s=sid) == "persona_2"
    assert one(spark, ids.evidence_id_of_session(F.col("s")), s="q-1__ev-") is None
    assert [one(spark, ids.normal_question_idx(F.col("v")), v=v) for v in ("174.0", "1.5", "x")] == ["174", "1.5", "x"]
    assert one(spark, ids.resolve_question_id(F.lit(None).cast("string"), F.col("i"), F.col("q"), F.lit(7)), i="1.5", q="Who?") == hashlib.sha256(b"Who?").hexdigest()
    assert one(spark, ids.resolve_question_id(F.lit(None).cast("string"), F.col("i"), F.col("q"), F.lit(7)), i=None, q=" ") == "7"


def test_personas_and_domains(spark):
    d = F.col("d")
    assert [one(spark, ev.persona_for_domains(d), d=x) for x in ([], ["technology"], ["business", "technology"], ["sports"], ["health", "technology"])] == ["tbd", "persona_1", "persona_2", "persona_3", "persona_4"]
    assert one(spark, ev.evidence_domains(d), d=[" Tech ", "tech", None, "", "Arts"]) == ["arts", "tech"]
    assert one(spark, ev.is_in_domain(F.lit("integrated"), d, F.lit("persona_1")), d=[]) and one(spark, ev.topical_relevance(d, F.lit("persona_1")), d=[]) == "out_of_domain"
    assert one(spark, ev.topical_relevance(d, F.lit("persona_1")), d=["sports", "technology"]) == "partial"
    c = F.col("c")
    assert one(spark, ev.session_in_domain(c, F.lit("persona_4")), c="x") and not one(spark, ev.session_in_domain(c, F.lit("persona_1")), c=None)
    assert not one(spark, ev.is_off_topic(d, F.lit("nobody")), d=["x"]) and one(spark, ev.is_off_topic(d, F.lit("persona_1")), d=[])
    assert not one(spark, ev.matches_wanted_domain(c, F.lit("persona_1"), True), c=None) and one(spark, ev.matches_wanted_domain(c, F.lit("persona_1"), False), c=None)
    assert not one(spark, ev.evidence_in_domain(c, F.lit("nobody")), c="technology") and one(spark, ev.evidence_in_domain(c, F.lit("persona_1")), c=" Technology")


def test_union_keeps_first_place_and_last_value(spark):
    df = spark.createDataFrame([("q", "a", 1, "v1"), ("q", "b", 2, "x"), ("q", "a", 3, "v2"), ("q", None, 4, "n"), ("q", " ", 5, "n")], "g string, k string, pos int, val string")
    assert sorted(map(tuple, ev.evidence_union(df, "g", "k", "pos").collect())) == [("q", "a", 1, "v2"), ("q", "b", 2, "x")]


def turns(spark, *rows):
    return spark.createDataFrame([("s", i, *r) for i, r in enumerate(rows)], "session_id string, turn int, role string, content string")


def test_pair_chunks(spark):
    got = lambda *r: [x["text"] for x in chunk_pair(turns(spark, *r)).orderBy("chunk_index").collect()]
    assert got(("user", "1"), ("user", "2"), ("assistant", "3")) == ["user: 1", "user: 2\nassistant: 3"]
    assert got(("system", "0"), ("user", "1"), ("assistant", "2")) == ["user: 1\nassistant: 2"]
    t = turns(spark, ("user", "1"), ("assistant", "2"), ("user", "3"))
    assert [x["text"] for x in chunk_turn(t).orderBy("chunk_index").collect()] == ["1", "3"]
    assert chunk_session(t).first()["text"] == "user: 1\nassistant: 2\nuser: 3"
    assert transcript(t).first()["transcript"] == "[U1] 1\n\n[A] 2\n\n[U2] 3"


def test_turns_of_text(spark):
    df = spark.createDataFrame([(1, "User: Hi: there\nmore\nAssistant: Yes\nUser: "), (2, None), (3, "no roles")], "id int, t string")
    assert [tuple(r) for r in session_turns(df, "id", "t").orderBy("turn").collect()] == [(1, 0, "user", "Hi: there\nmore"), (1, 1, "assistant", "Yes"), (1, 2, "user", "")]


def test_word_chunks(spark):
    df = spark.createDataFrame([(1, " ".join(map(str, range(600)))), (2, ""), (3, "x"), (4, None)], "id int, t string")
    rows = chunk_words(df, "id", F.col("t")).orderBy("doc_key", "chunk_index").collect()
    assert [r["doc_key"] for r in rows] == [1, 1, 1, 3]
    w = [r["text"].split() for r in rows[:3]]
    assert w[0][-32:] == w[1][:32] and w[-1][-1] == "599" and all(len(x) <= 256 for x in w)
    assert chunk_recursive(df, "id", F.col("t")).where("doc_key = 1").count() >= 3


@given(st.text("ab .\n", max_size=300))
@settings(max_examples=60, deadline=None)
def test_recursive_pieces_fit(s):
    count = lambda x: len(x.split())
    for piece in split_recursive(s, 5, 1, count):
        assert count(piece) <= 5 and piece.strip()
    assert set(" ".join(split_recursive(s, 5, 1, count)).split()) <= set(s.split()) | {w.rstrip(".") for w in s.split()}


def test_strict_hits(spark):
    hit = metrics.strict_doc_hit(F.col("f"), F.col("t"), F.col("s"), F.col("x"))
    v = {"f": "short fact", "t": "A Title", "s": "Src", "x": ["a title", "src"]}
    assert one(spark, hit, **v) and not one(spark, hit, **{**v, "x": ["a title"]}) and not one(spark, hit, **{**v, "x": []})
    long = "this fact is long enough to count"
    assert one(spark, hit, f=long, t="", s="", x=["so this fact is long", "enough to count."]) and not one(spark, hit, f=long, t="A Title", s="Src", x=["a title src"])
    assert one(spark, hit, f="", t="A Title", s=None, x=["a title"])


def test_pair_matching(spark):
    pairs = spark.createDataFrame([("s", 0, "user: aa"), ("s", 1, "user: aa"), ("s", 2, "user: bb\nassistant: long text"), ("s", 3, "user: cc")], "session_id string, chunk_index int, text string")
    got = spark.createDataFrame([("dup", "s", "user: aa"), ("part", "s", "assistant: long"), ("exact", "s", "USER: cc"), ("none", "s", "zz")], "key string, session_id string, text string")
    assert dict(map(tuple, metrics.match_pairs(got, pairs).collect())) == {"dup": None, "part": 2, "exact": 3, "none": None}
    audit = spark.createDataFrame([("s", [2])], "session_id string, key_information array<int>")
    assert {r["key"]: r["hit"] for r in metrics.strict_memory_hits(got, pairs, audit).collect()} == {"dup": False, "part": True, "exact": False, "none": False}
    assert one(spark, metrics.gold_document_hit(F.lit(None).cast("boolean"), F.lit(True)), z="")


def test_mixed_recall_ties_and_nulls(spark):
    r = "array<struct<session_id string, url string, score double, source_type string>>"
    docs = [(None, "u1", 0.5, "document"), (None, "u1", 0.9, "document"), (None, "u2", None, "document")]
    runs = spark.createDataFrame([(1, docs, [("m1", None, 0.9, "memory")]), (2, [], [])], f"run_id long, retrieved_documents {r}, retrieved_memory {r}")
    assert [x["gold_id"] for x in metrics.mixed_top(runs).orderBy("rank").collect()] == ["doc::u1", "mem::m1", "doc::u2"]
    gold = spark.createDataFrame([(1, "doc::u1"), (1, "doc::zz")], "run_id long, gold_id string")
    assert {r["run_id"]: r["recall"] for r in metrics.mixed_recall(runs, gold).collect()} == {1: 0.5, 2: None}


@pytest.mark.parametrize("weights,total", [([1, 1, 1], 10), ([5, 0, 1], 7), ([1], 3), ([0.1, 0.2, 0.7], 100)])
def test_largest_remainder(spark, weights, total):
    df = spark.createDataFrame([(i, float(w)) for i, w in enumerate(weights)], "place int, weight double")
    n = [r["n"] for r in sampling.largest_remainder(df, total).orderBy("place").collect()]
    assert sum(n) == total and all(abs(x - total * w / sum(weights)) < 1 for x, w in zip(n, weights))
    if weights == [1, 1, 1]:
        assert n == [4, 3, 3]


def test_split_is_a_balanced_partition(spark):
    df = spark.range(400).select((F.col("id") % 37).alias("g"), F.col("id").cast("string").alias("k"))
    out = sampling.split_fifty_fifty(df, "g", "k")
    assert out.count() == 400
    n = out.groupBy("g").agg(F.count_if(F.col("side") == "memory").alias("m"), F.count_if(F.col("side") == "document").alias("d")).collect()
    assert all(abs(r["m"] - r["d"]) <= 1 for r in n)
    again = sampling.split_fifty_fifty(df.repartition(7), "g", "k")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, again.collect()))


def test_samplers(spark):
    df = spark.range(200).select(F.col("id"), (F.col("id") % 4).cast("string").alias("s"), F.when(F.col("id") < 3, "rare").otherwise("common").alias("c"))
    sizes = spark.createDataFrame([("0", 5), ("1", 7)], "s string, n long")
    assert sampling.stratified(df, "s", "id", sizes).groupBy("s").count().orderBy("s").collect() == [("0", 5), ("1", 7)]
    with pytest.raises(ValueError, match="too small"):
        sampling.stratified(df, "s", "id", spark.createDataFrame([("0", 51)], "s string, n long"))
    chosen, rest = sampling.sample_and_rest(df, "id", 30)
    assert chosen.count() == 30 and rest.count() == 170 and chosen.join(rest, "id").count() == 0
    cover = sampling.coverage_sample(df, "id", "s", spark.createDataFrame([(str(i), 5) for i in range(4)], "s string, n long"), ["c"], 3)
    assert cover.count() == 20 and cover.where("c = 'rare'").count() == 3
    tiers = sampling.tiered_fill(df.withColumn("e", (F.col("id") % 10).cast("string")).withColumn("g", F.lit("g")), ["g"], "id", "e", F.when(F.col("id") < 5, 1).otherwise(2), F.lit(7)).collect()
    assert len(tiers) == 7 and len({r["e"] for r in tiers}) == 7 and sum(r["tier"] == 1 for r in tiers) == 5
    div = sampling.diversity_sample(df, "s", "id", ["c"], 10).groupBy("s").count().collect()
    assert {r["count"] for r in div} == {10}
    design = sampling.cyclic_block_design(spark.range(12), "id", [(str(i), "a") for i in range(12)], 4)
    assert design.count() == 48 and {r["count"] for r in design.groupBy("dist").count().collect()} == {4}


def test_session_times_stay_in_the_window(spark):
    df = spark.range(2000).select("id", F.when(F.col("id") % 3 == 0, F.lit("2024-01-20")).when(F.col("id") % 3 == 1, F.lit("2020-01-01")).cast("date").alias("p"))
    out = sampling.session_times(df, "id", F.col("p"), "2023-07-01", "2024-02-29")
    bad = out.where("date(session_time) < coalesce(p, date'2023-07-01') or date(session_time) < date'2023-07-01' or date(session_time) > date'2024-02-29' or hour(session_time) not between 8 and 22")
    assert bad.count() == 0 and out.where("session_time is null").count() == 0


def test_relational(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, None), (None, 1, "n")], "k int, o int, v string")
    assert sorted(map(tuple, relational.keep_one(df, ["k"], ["o"]).collect()), key=str) == [(1, 1, "a"), (2, 1, None), (None, 1, "n")]
    assert relational.keep_one(df, ["k"], ["o"], last=True).where("k = 1").first()["v"] == "b"
    with pytest.raises(ValueError, match="duplicate"):
        relational.require_unique(df, "k")
    with pytest.raises(ValueError, match="no partner"):
        relational.require_joined(df, df.where("k = 1"), ["k"])
    with pytest.raises(ValueError, match="row counts"):
        relational.require_same_count(df, df.limit(1))
    assert [r["block_id"] for r in relational.with_ordinal(spark.range(50, 0, -1).repartition(6), ["id"]).orderBy("id").collect()] == list(range(1, 51))
    assert relational.with_ordinal(spark.range(0), ["id"]).count() == 0
    assert relational.rename_missing(df, {"k": "v", "o": "p"}).columns == ["k", "p", "v"]


def test_reports(spark):
    df = spark.createDataFrame([("a", "x", reports.FAILED, 0, 1.0), ("a", None, reports.FAILED, None, 3.0), ("b", "x", "ok", 5, 9.0)], "agent string, v string, prediction string, input_tokens int, latency_s double")
    rows = {r["agent"]: r for r in reports.failures_by(df, "agent").collect()}
    assert (rows["a"]["n_pre_llm"], rows["a"]["n_llm_stage"], rows["a"]["mean_latency_s"], rows["b"]["n_failed"], rows["b"]["mean_latency_s"]) == (1, 1, 2.0, 0, 0.0)
    cube = {(r["agent"], r["v"]): r["n"] for r in reports.crosstab_with_margins(df, "agent", "v").collect()}
    assert cube["All", "All"] == 3 and cube["a", "(null)"] == 1 and cube["All", "x"] == 2
    low, high = metrics.wilson(F.lit(10.0), F.lit(10.0))
    assert one(spark, low, z="") == 0.72246 and one(spark, high, z="") == 1.0


def test_row_shapes(spark):
    df = spark.createDataFrame([(1, "p", "x", None, "a")], "question_id int, persona string, dist string, question_type string, final_answer string")
    r = rows.run_rows(df).first()
    assert (r["question_idx"], r["eval_persona"], r["variant"], r["question_type"], r["prediction"], r["agent"]) == (1, "p", "x", "", "a", None)
    assert df.select(rows.answer_of(df)).first()[0] == "a"
    assert one(spark, rows.answer_fields(F.col("x"))["prediction"], x="plain") == "plain" and one(spark, rows.answer_fields(F.col("x"))["prediction"], x='{"final_answer": "f"}') == "f"
    for bad in (rows.valid_variant(F.col("x")), rows.known_persona(F.col("x")), rows.required_query(F.lit(" "))):
        with pytest.raises(Exception, match="unknown|empty"):
            one(spark, bad, x="nope")
    assert one(spark, rows.valid_variant(F.col("x")), x=" Integrated") == "integrated"
    a = F.array(F.lit(1))
    none = F.lit(None).cast("array<int>")
    assert one(spark, rows.all_required_present(a, a, a, none, F.lit(False)), x="") and not one(spark, rows.all_required_present(a, a, a, none, F.lit(True)), x="")
    assert one(spark, rows.actual_turns(F.lit(None).cast("int"), F.lit(4)), x="") == 4 and one(spark, rows.actual_turns(F.lit(7), F.lit(4)), x="") == 3
    assert one(spark, rows.row_seed(42, F.col("x")), x="q") == int(hashlib.sha256(b"42:q").hexdigest()[:8], 16)


def test_draws_follow_the_profile(spark):
    df = spark.range(6000).select("id", F.lit("persona_3").alias("p"))
    out = sampling.diversity_draw(df, "id", "p")
    n = {r["category"]: r["count"] / 6000 for r in out.groupBy("category").count().collect()}
    assert all(abs(n[c] - w) < 0.03 for c, w in sampling.PROFILES["persona_3"]["categories"].items())
    assert {r["turns"] for r in out.where("category = 'transactional'").select("turns").distinct().collect()} == {"4-4", "4-6"}
    assert out.where("drift is null or (category = 'transactional' and drift = 'wide')").count() == 0
    assert abs(sum(sampling.drift_weights(sampling.PROFILES["persona_1"]).values()) - 1) < 1e-9
