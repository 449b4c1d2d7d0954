"""Files in and out, retrieval, agents and streaming."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from evplace.functions import ids
from evplace.functions.text import human_date
from evplace.operators import agents, retrieval, rows
from evplace.sources import readers, sinks
from evplace.sources.schemas import strict_schema
from evplace.streaming.runs import event_stream, run_to_table, windowed_counts

SMALL = "/root/testdata/sf0.001"


def write(path, text):
    path.write_text(text)
    return str(path)


def test_corpus_and_sessions(spark, tmp_path):
    doc = {"url": "u1", "title": "t", "body": "b"}
    path = write(tmp_path / "c.jsonl", json.dumps(doc) + "\n\n" + json.dumps({**doc, "url": "u0"}) + "\n")
    docs = readers.corpus_jsonl(spark, path)
    assert docs.count() == 2
    sinks.write_corpus(docs, str(tmp_path / "out.jsonl"))
    assert [r["url"] for r in spark.read.json(str(tmp_path / "out.jsonl")).collect()] == ["u0", "u1"]
    with pytest.raises(ValueError, match="duplicate"):
        sinks.write_corpus(docs.union(docs), str(tmp_path / "x.jsonl"))
    session = {"session_id": "s1", "session": [{"role": "user", "content": "hi"}], "source": "a"}
    write(tmp_path / "persona_1.json", json.dumps([session]))
    write(tmp_path / "persona_2.json", json.dumps([{**session, "source": "b"}, {**session, "session_id": "ultrachat_1"}]))
    got = readers.persona_sessions(spark, str(tmp_path / "persona_*.json"))
    assert {r["session_id"]: r["source"] for r in got.collect()} == {"s1": "b", "ultrachat_1": "a"}
    assert readers.fillers(got)["ultrachat"].count() == 1
    with pytest.raises(ValueError, match="not a JSON array"):
        readers.persona_sessions(spark, write(tmp_path / "bad.json", "{}"))
    assert readers.newest(spark, str(tmp_path), "persona_*.json").endswith("persona_2.json")
    with pytest.raises(FileNotFoundError):
        readers.newest(spark, str(tmp_path), "zzz*")


def test_manifest_and_batch_output(spark, tmp_path):
    entry = {"evidence_id": "e1", "evidence": {"url": "u1", "fact": "f"}, "diversity": {"turn_range": [4, 6]}}
    manifest = readers.manifest_object(spark, write(tmp_path / "m.json", json.dumps({f"c{i}": entry for i in range(8)})))
    assert manifest.count() == 8 and readers.gold_evidence_by_url(manifest).first()["url"] == "u1"
    ok = json.dumps({"turns": [{"role": "user", "content": "x"}, {"role": "assistant", "content": "y"}] * 2})
    body = lambda t: {"response": {"status_code": 200, "body": {"output": [{"content": [{"text": t}]}]}}}
    lines = [{"custom_id": "c0", **body(ok)}, {"custom_id": "c1"}, {"custom_id": "c2", "response": {"status_code": 500}}, {"custom_id": "c3", "response": {"body": {"output": []}}},
             {"custom_id": "c4", "response": {"body": {"output": [{"content": []}]}}}, {"custom_id": "c5", **body("")}, {"custom_id": "c6", **body("{oops")}, {"custom_id": "c7", **body(json.dumps({"turns": []}))}]
    from evplace.sources.schemas import BATCH_OUTPUT

    out = spark.read.schema(BATCH_OUTPUT).json(write(tmp_path / "o.jsonl", "\n".join(map(json.dumps, lines))))
    errors = {r["custom_id"]: r["session_parse_error"] for r in readers.batch_sessions(out, manifest).collect()}
    assert errors == {"c0": None, "c1": "no_response", "c2": "empty_body", "c3": "no_output", "c4": "no_content", "c5": "no_text", "c6": "json_decode", "c7": "session_validate"}
    with pytest.raises(ValueError, match="unknown custom_id"):
        readers.batch_sessions(out, manifest.where("custom_id <> 'c3'"))


def test_audit_maps_runs_and_resume(spark, tmp_path):
    rows = [{"session_id": "s", "key_information": [1]}, {"session_id": "s"}, {"session_id": " "}, {"session_id": "t", "error": "x"}]
    audit = readers.audit_map(spark, write(tmp_path / "a.jsonl", "\n".join(map(json.dumps, rows)))).collect()
    assert [(r["session_id"], r["key_information"]) for r in audit] == [("s", [])]
    urls = readers.evidence_id_to_url(spark, write(tmp_path / "u.jsonl", "\n".join(map(json.dumps, [{"evidence_id": "e", "url": "u"}, {"evidence_id": "", "url": "u"}, {"evidence_id": "f"}]))))
    assert urls.count() == 1
    folder = tmp_path / "runs"
    folder.mkdir()
    write(folder / "agent_1.jsonl", json.dumps({"question_idx": 1, "agent": "a", "prediction": "[INFERENCE_FAILED]"}))
    write(folder / "agent_2.csv", "question_idx,agent,prediction\n2,b,ok\n")
    runs = readers.run_files(spark, str(folder))
    assert sorted((r["question_idx"], r["agent"]) for r in runs.collect()) == [(1, "a"), (2, "b")]
    assert readers.failures(spark, str(folder / "agent_1.jsonl")).count() == 1
    todo = spark.createDataFrame([(1,), (2,)], "question_idx int")
    assert readers.resume(todo, spark, str(folder / "agent_1.jsonl"), "question_idx").collect() == [(2,)]
    assert readers.resume(todo, spark, str(tmp_path / "nothing.jsonl"), "question_idx").count() == 2
    failed = write(tmp_path / "f.jsonl", '{"question_idx": 1, "error": "x"}\n{"question_idx": 2, "error": null}')
    assert readers.resume(todo, spark, failed, "question_idx").collect() == [(1,)]
    personas = spark.createDataFrame([("q", "p1"), (" q", "p1"), ("r", "p2")], "query string, persona string")
    assert readers.persona_by_query(personas).count() == 2
    with pytest.raises(ValueError, match="two personas"):
        readers.persona_by_query(personas.union(spark.createDataFrame([("q", "p9")], "query string, persona string")))


def test_cells_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([("[{\"url\": \"u\"}]",), ("",), (None,), ("{",)], "c string")
    assert [len(r[0]) for r in df.select(readers.evidence_cell(F.col("c"))).collect()] == [1, 0, 0, 0]
    err = spark.createDataFrame([("400 {'failed_generation': '{\"a\": 1}'}",), ("boom",), (None,)], "e string")
    assert [r[0] for r in err.select(readers.failed_generation(F.col("e"))).collect()] == ['{"a": 1}', None, None]
    rows = spark.createDataFrame([(1, ["x"], "v"), (2, [], "w")], "a int, b array<string>, variant string")
    for name in ("o.csv", "o.jsonl", "o.parquet"):
        sinks.write_rows(rows, str(tmp_path / name))
        sinks.write_rows(rows, str(tmp_path / name))
    assert spark.read.option("header", True).csv(str(tmp_path / "o.csv")).count() == spark.read.json(str(tmp_path / "o.jsonl")).count() == 4
    # Array cells survive a CSV folder.
    sinks.write_rows(spark.createDataFrame([(7, ["u1", "u2"])], "question_idx int, golden_document_urls array<string>").coalesce(1), str(tmp_path / "w.csv"))
    (tmp_path / "runs").mkdir()
    next((tmp_path / "w.csv").glob("*.csv")).rename(tmp_path / "runs" / "agent_1.csv")
    assert [(r["question_idx"], r["golden_document_urls"]) for r in readers.run_csv_folder(spark, str(tmp_path / "runs")).collect()] == [(7, ["u1", "u2"])]
    ids_ = spark.createDataFrame([("b",), ("a",), ("b",)], "session_id string")
    sinks.write_audit(rows, ids_, str(tmp_path / "audit.jsonl"), str(tmp_path / "orphans"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "orphans")).collect()] == ["a", "b"] and spark.read.json(str(tmp_path / "audit.jsonl")).count() == 2
    sinks.write_batch_meta(spark.createDataFrame([("c",)], "custom_id string"), str(tmp_path / "meta"), model="m")
    assert spark.read.json(str(tmp_path / "meta")).first().asDict() == {"n_requests": 1, "n_custom_ids": 1, "model": "m"}
    assert [r[0] for r in spark.createDataFrame([("2023-11-05T08:07:09+02:00",), ("soon",), (None,)], "d string").select(human_date(F.col("d"))).collect()] == ["November 05, 2023 at 08:07 AM UTC", "soon", None]
    sinks.write_by(rows, str(tmp_path / "p"), "variant")
    assert (tmp_path / "p" / "variant=v").exists()
    assert sinks.output_path("a_{variant}.json", "x") == "a_x.json"
    with pytest.raises(ValueError):
        sinks.output_path("a.json", several=True)
    e = spark.createDataFrame([("e", "u", "1"), ("e", "v", "2")], "evidence_id string, url string, question_idx string")
    with pytest.raises(ValueError, match="two urls"):
        sinks.write_evidence_urls(e, str(tmp_path / "e"))
    sinks.write_evidence_urls(e.limit(1), str(tmp_path / "e"))
    sinks.write_requests(spark.createDataFrame([("c", "p", "x")], "custom_id string, prompt string, k string"), str(tmp_path / "r"), str(tmp_path / "m"))


def test_dense_exclusion_equals_excluding_first(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(300, 8))
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    m[7] = m[3]  # a tie
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(m)], "chunk_id long, vector array<double>").repartition(5)
    q = df.where("chunk_id % 50 = 3").withColumnRenamed("chunk_id", "query_id")
    ex = spark.createDataFrame([(3, 3), (3, 9), (53, 1)], "query_id long, chunk_id long")
    got = {}
    for r in retrieval.dense_top_k(df, q, 4, exclude=ex, block=2).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["chunk_id"]))
    out = {tuple(x) for x in ex.collect()}
    for i in range(3, 300, 50):
        s = np.round(m @ m[i], 6)
        want = [j for j in np.lexsort((np.arange(300), -s)) if (i, j) not in out][:4]
        assert [c for _, c in sorted(got[i])] == want
    assert retrieval.dense_top_k(df, q.limit(0), 4).count() == 0


def test_bm25_and_fusion(spark):
    chunks = spark.createDataFrame([("a", "red red fox"), ("b", "fox"), ("c", "dog"), ("d", None)], "chunk_id string, text string")
    q = spark.createDataFrame([(1, "Red fox!"), (2, None)], "query_id long, query string")
    top = retrieval.bm25_top_k(chunks, q, 5).orderBy("rank").collect()
    assert [r["chunk_id"] for r in top] == ["a", "b"]
    # Excluding chunks equals building the index without them.
    out = spark.createDataFrame([(1, "b"), (1, "c")], "query_id long, chunk_id string")
    less = retrieval.bm25_top_k(chunks.where("chunk_id not in ('b', 'c')"), q, 5).collect()
    assert sorted(map(tuple, retrieval.bm25_top_k(chunks, q, 5, exclude=out).collect())) == sorted(map(tuple, less)) and less
    # What is only dropped leaves the scores of the rest as they are; blocks of queries do not matter; k cuts inside tasks.
    assert [(r["chunk_id"], r["score"]) for r in retrieval.bm25_top_k(chunks, q, 5, drop=out).collect()] == [(top[0]["chunk_id"], top[0]["score"])]
    rows = [(f"c{i:03}", " ".join(f"w{j}" for j in range(i % 7 + 1)) + " w0" * (i % 3)) for i in range(400)]
    many = spark.createDataFrame(rows, "chunk_id string, text string").repartition(5)
    asks = spark.createDataFrame([(i, f"w{i} w0 w3") for i in range(6)], "query_id long, query string")
    want = sorted(map(tuple, retrieval.bm25_top_k(many, asks, 400).where("rank <= 9").collect()))
    assert sorted(map(tuple, retrieval.bm25_top_k(many, asks, 9, block=4).collect())) == want and len(want) == 54
    assert retrieval.bm25_top_k(chunks, q.limit(0), 5).count() == 0 and retrieval.bm25_top_k(chunks.limit(0), q, 5).count() == 0
    lists = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "query_id long, chunk_id string, rank int")
    other = spark.createDataFrame([(1, "b", 1), (1, "c", 2)], "query_id long, chunk_id string, rank int")
    assert [r["chunk_id"] for r in retrieval.reciprocal_rank_fusion([(lists, 0.5), (other, 0.5)], 3).orderBy("rank").collect()] == ["b", "a", "c"]
    v = retrieval.hashed_vectors(chunks, "chunk_id", "text").collect()
    assert all(abs(sum(x * x for x in r["vector"]) - (r["chunk_id"] != "d")) < 1e-9 for r in v)


def clients():
    class Broken:
        def complete(self, prompts):
            raise agents.PermanentError("no")

    class OneBad(agents.StubClient):
        def complete(self, prompts):
            if any("bad" in p for p in prompts):
                raise agents.PermanentError("{'error': {'failed_generation': '" + json.dumps({"topic": [2, 2, 0], "source": [1], "key_information": [3]}) + "'}}")
            return super().complete(prompts)

    return Broken, OneBad


def test_model_calls(spark):
    Broken, OneBad = clients()

    class Flaky:
        def __init__(self):
            self.calls = 0

        def complete(self, prompts):
            self.calls += 1
            if self.calls < 3:
                raise RuntimeError("again")
            return [{"content": "x"}] * len(prompts)

    assert agents.with_retry(Flaky(), ["a"], wait=0) == [{"content": "x"}]
    with pytest.raises(agents.PermanentError):
        agents.with_retry(Broken(), ["a"])
    df = spark.createDataFrame([(1, "p"), (2, None)], "id int, prompt string")
    rows = agents.call_model(df, "prompt", Broken).collect()
    assert len(rows) == 2 and all(r["final_answer"] == "[INFERENCE_FAILED]" and r["input_tokens"] == 0 for r in rows)
    # One bad prompt costs no other row its reply.
    many = spark.createDataFrame([(i, "[1] bad word" if i == 7 else "[1] good word") for i in range(20)], "id int, prompt string").coalesce(1)
    got = {r["id"]: r["final_answer"] for r in agents.call_model(many, "prompt", OneBad).collect()}
    assert got == {i: "[INFERENCE_FAILED]" if i == 7 else "good word" for i in range(20)}

    class Long:
        def complete(self, prompts):
            return [{"content": '{"final_answer": "%s"}' % ("x" * (70 + i)), "input_tokens": 1} for i, _ in enumerate(prompts)]

    assert [r["inference_error"] for r in agents.call_model(df.coalesce(1), "prompt", Long).orderBy("id").collect()] == [None, "ValidationError: final_answer too long"]
    with pytest.raises(KeyError):
        agents.build_agent("agent_9")
    assert spark.range(1).select(agents.passages_block(F.array(F.lit("m")), F.array(F.lit("d"))), agents.passages_block(F.lit(None), F.lit(None))).first() == ("From memory:\n[M1] m\n\nFrom documents:\n[D1] d", "(no passages retrieved)")


def test_session_audit(spark):
    Broken, OneBad = clients()
    df = spark.createDataFrame([(1, "Task: locations\n[U1] x", True), (2, "Task: locations\nbad", False), (3, None, False)], "session_id int, prompt string, t boolean")
    out = {r["session_id"]: r for r in agents.audit_sessions(df, "prompt", F.col("t"), OneBad).collect()}
    assert out[1]["published_at"] == [1] and out[1]["all_required_present"] and out[1]["error"] is None
    assert out[2]["recovered"] and (out[2]["topic"], out[2]["key_information"], out[2]["published_at"]) == ([2], [3], None) and out[2]["all_required_present"]
    failed = agents.audit_sessions(df, "prompt", F.col("t"), Broken).collect()
    assert all(r["error"].startswith("PermanentError") and r["topic"] == [] and not r["all_required_present"] for r in failed)


def test_corrective_loops(spark):
    Broken, _ = clients()
    texts = {"memory": [(f"m{i}", "Alpha facts" if i < 2 else "other words") for i in range(6)], "document": [(f"d{i}", "Alpha news" if i < 1 else "other words") for i in range(6)]}
    chunks = {c: spark.createDataFrame(x, "chunk_id string, text string") for c, x in texts.items()}
    calls = []

    def retrieve(channel, ask, seen, k):
        calls.append((channel, {r["query_id"]: r["query"] for r in ask.collect()}))
        j = ask.crossJoin(chunks[channel])
        if seen is not None:
            j = j.join(seen, ["query_id", "chunk_id"], "left_anti")
        return retrieval.top_k(j.withColumn("score", F.lit(1.0)), k).select("query_id", "chunk_id", "rank", "text")

    q = spark.createDataFrame([(1, "Does Alpha win?"), (2, "Does Gamma Delta win?")], "query_id long, query string")
    v2 = {r["query_id"]: r for r in agents.corrective_v2(q, retrieve, memory_k=2, document_k=1).collect()}
    assert v2[1]["n_kept"] == 3 and v2[1]["n_rounds"] == 1 and v2[1]["final_answer"] == "Alpha facts"
    assert v2[2]["n_kept"] == 0 and v2[2]["n_rounds"] == 3 and v2[2]["final_answer"] == "Insufficient information"
    # Both channels have their own rewritten query; a run that is done is not asked again.
    assert calls[2:4] == [("memory", {2: v2[2]["history"][1]["memory_query"]}), ("document", {2: v2[2]["history"][1]["document_query"]})]
    assert v2[2]["history"][1]["memory_query"] != v2[2]["history"][1]["document_query"]
    # A failing model: the grader keeps all, the judge finds it insufficient, the rewriter leaves the question.
    broken = {r["query_id"]: r for r in agents.corrective_v2(q, retrieve, memory_k=2, document_k=1, client=Broken, wait=0).collect()}
    assert all(r["n_kept"] == 6 and r["final_answer"] == "[INFERENCE_FAILED]" and r["n_rounds"] == 3 for r in broken.values())
    v1 = {r["query_id"]: r for r in agents.corrective_v1(q, retrieve, k=5).collect()}
    assert v1[1]["n_rounds"] == 1 and v1[1]["relevant"] and v1[1]["n_kept"] == 10
    assert v1[2]["n_rounds"] == 3 and not v1[2]["relevant"] and v1[2]["n_kept"] == 10 and v1[2]["last_query"] != "Does Gamma Delta win?"
    assert all(r["n_rounds"] == 1 for r in agents.corrective_v1(q, retrieve, client=Broken, wait=0).collect())


def test_stream_writes_passed_windows_once_and_drops_late_rows(spark, tmp_path):
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1)
    event = lambda i, hours: (i, start + timedelta(hours=hours), "view", 1.0)
    schema = "event_id long, ts timestamp_ntz, event_type string, value double"
    # Files are taken one by one, in order of their time: on time, sent again, two days late.
    for n, rows in enumerate(([event(i, i) for i in range(48)], [event(47, 47), event(100, 49)], [event(200, 1), event(201, 60)])):
        part = tmp_path / f"part{n}"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(part))
        target = tmp_path / "in" / "events.parquet"
        target.mkdir(parents=True, exist_ok=True)
        (file,) = part.glob("*.parquet")
        file.rename(target / f"{n}.parquet")
        os.utime(target / f"{n}.parquet", (1000 + n, 1000 + n))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "events.parquet")).withColumn("ts", F.col("ts").cast("timestamp"))
    out = run_to_table(windowed_counts(stream)).collect()
    hours = {(r["window"]["start"] - start).total_seconds() / 3600: r["n"] for r in out}
    assert len(hours) == len(out) and hours == {float(h): 1 for h in [*range(48), 49]}  # window 60 is not passed yet, the late row of hour 1 is gone


def test_stream_equals_batch(spark):
    out = run_to_table(windowed_counts(event_stream(spark, SMALL), late="3650 days"), mode="complete")
    assert out.agg(F.sum("n")).first()[0] == spark.read.parquet(f"{SMALL}/events.parquet").select("event_id").distinct().count()


def test_audit_rows_and_orphans(spark):
    turns = "array<struct<role:string,content:string>>"
    sessions = spark.createDataFrame([(" a ", [("user", "x")]), ("b", None), ("c", [("user", "x")]), ("d", [("user", "x")]), ("", None)], f"session_id string, session {turns}")
    manifest = spark.createDataFrame([("a", ("f",), None, "temporal_query"), ("b", ("f",), False, None), ("c", None, False, None)], "custom_id string, evidence struct<fact:string>, is_temporal boolean, question_type string")
    joined, orphans = rows.audit_rows(sessions, manifest)
    assert [(r["session_id"], r["is_temporal"]) for r in joined.collect()] == [("a", True)] and sorted(r[0] for r in orphans.collect()) == ["b", "c", "d"]


def test_small_shapes(spark):
    assert strict_schema({"type": "object", "properties": {"a": {"type": "array", "items": [{"type": "object", "properties": {}}]}}}) == {"type": "object", "properties": {"a": {"type": "array", "items": [{"type": "object", "properties": {}, "additionalProperties": False}]}}, "additionalProperties": False}
    df = spark.createDataFrame([("", "e1"), ("e2", "x"), (None, "")], "t string, n string")
    assert [r[0] for r in df.select(ids.record_evidence_id(F.col("t"), F.col("n"))).collect()] == ["e1", "e2", None]
    runs = spark.createDataFrame([(1, " q ", "p")], "run_id long, query string, persona_id string")
    none = retrieval.Delta.none(runs)
    assert none.exclude.count() == none.strip.count() == none.ensure.count() == 0 and none.exclude.columns == ["run_id", "url"]
    known = spark.createDataFrame([("q", "persona_1")], "query string, persona string")
    assert rows.attach_persona(runs, known).first()["persona"] == "persona_1" and rows.attach_persona(runs, known.limit(0)).first()["persona"] == "tbd"
    assert runs.select(rows.record_persona(runs)).first()[0] == "p"
    h = spark.range(1).select(rows.hop_count(F.array(F.lit("a"), F.lit("a")), F.lit(None).cast("array<string>"))).first()[0]
    assert h == 2


def test_questions_file(spark, tmp_path):
    e = {"title": "T", "fact": "F", "url": "u"}
    lines = [{"question_idx": "7.0", "query": " q ", "golden_memory_evidence": [e, e], "golden_document_evidence": [e]}, {"question_idx": "8", "query": "r", "hop_count": 5, "original_persona": "persona_2", "memory_evidence": None}]
    path = write(tmp_path / "q.jsonl", "\n".join(map(json.dumps, lines)))
    got = {r["question_idx"]: r for r in readers.questions(spark, path, spark.createDataFrame([("q", "persona_1")], "query string, persona string")).collect()}
    assert (got["7"]["hop_count"], got["7"]["original_persona"], got["8"]["hop_count"], got["8"]["original_persona"]) == (3, "persona_1", 5, "persona_2")
    one, two = got["7"]["golden_memory_evidence"]
    assert len(one["evidence_id"]) == 32 and one["evidence_id"] == two["evidence_id"] == got["7"]["golden_document_evidence"][0]["evidence_id"] and got["8"]["memory_evidence"] is None
    assert readers.questions(spark, path).where("original_persona = 'tbd'").count() == 1


def test_the_last_row_of_an_audit_wins_whatever_the_files(spark, tmp_path):
    row = lambda i, n: json.dumps({"session_id": i, "key_information": [n], "error": None})
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "1.jsonl").write_text("\n".join([row("s", 1), row("s", 2)]) + "\n")
    (tmp_path / "a" / "2.jsonl").write_text("\n".join([row("s", 3), *[row(f"x{i}", 0) for i in range(2000)]]) + "\n")
    got = {r["session_id"]: r["key_information"] for r in readers.audit_map(spark, str(tmp_path / "a")).collect()}
    assert got["s"] == [3]


def test_entry_and_oracles():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert {"p5_found", "p6_found", "bm25_recall_at_10"} <= set(e.queries())


@pytest.mark.parametrize("partitions", ["1", "13"])
def test_results_do_not_depend_on_partitions(spark, partitions):
    import __spark_entry__ as e

    old = spark.conf.get("spark.sql.shuffle.partitions")
    names = ["bm25_topk", "prepare_spec", "coverage_sample", "tiered_fill", "p5_found", "p6_found"]
    want = {n: sorted(map(str, e.queries()[n](spark, SMALL).collect())) for n in names}
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        for n in names:
            assert sorted(map(str, e.queries()[n](spark, SMALL).collect())) == want[n], n
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
