"""Question-answering agents as relational plans around one pluggable model.

The model is a client object with ``complete(prompts) -> list[dict]``: ``content`` (a text; structured replies are JSON
texts), ``input_tokens``, ``output_tokens``. It is called once per row inside ``mapInPandas`` and its replies are written
before anything branches on them, so no reply is ever paid for twice. ``StubClient`` is the deterministic offline stand-in.
Corrective loops are unrolled to a bounded number of rounds; a round sees only the runs that are still active, and what a
run has seen or kept is a relation keyed by run.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import grading_reply
from ..session import materialise
from .reports import FAILED

#: Structured replies (fixed values: the fields of each).
ANSWER = "final_answer string, reasoning string"
SUFFICIENCY = "sufficient boolean, knowledge_gap string"
DUAL_QUERY = "memory_query string, document_query string"
LOCATIONS = "topic array<int>, source array<int>, key_information array<int>, published_at array<int>, notes string"
SESSION = "turns array<struct<role: string, content: string>>"
FACT_COVERAGE = "covered array<string>, missing array<string>, notes string"
HALLUCINATION = "hallucinated boolean, claims array<string>, notes string"
ANSWER_LIMIT = 70  # characters of a final answer (fixed value)


class Client(Protocol):
    def complete(self, prompts: Sequence[str]) -> list[dict]: ...


class PermanentError(Exception):
    """A request that must not be tried again."""


_NAME = re.compile(r"\b[^\W\d_a-zß-öø-ÿ][^\W\d_]{3,}")
_PASSAGE = re.compile(r"^(?:\[([MD]?\d+)\]|(\d+)\.) (.*)$", re.M)


class StubClient:
    """Replies from the prompt alone, by the task that its first line names.

    grade: the tags of passages that hold a capitalised name of the question, or none; relevant: yes if one does;
    sufficiency: two passages are enough; rewrite: the names of the question; locations: the first user turn carries
    every field; anything else: the first seven words of the first passage.
    """

    def complete(self, prompts: Sequence[str]) -> list[dict]:
        out = []
        for p in prompts:
            task = p.split("\n", 1)[0].removeprefix("Task: ")
            question = p.rsplit("Question: ", 1)[-1].split("\n", 1)[0]
            names = list(dict.fromkeys(_NAME.findall(question)))
            passages = [(m[1] or m[2], m[3]) for m in _PASSAGE.finditer(p)]
            good = [tag for tag, text in passages if any(n in text for n in names)]
            content = {
                "grade": lambda: ", ".join(good) or "none",
                "relevant": lambda: "yes" if good else "no",
                "sufficiency": lambda: json.dumps({"sufficient": len(passages) >= 2, "knowledge_gap": None if len(passages) >= 2 else "More about " + " ".join(names[:1])}),
                "rewrite": lambda: " ".join(names[1:]) or question,
                "dual rewrite": lambda: json.dumps({"memory_query": " ".join(names[1:]) or question, "document_query": " ".join(names) or question}),
                "locations": lambda: json.dumps({"topic": [1], "source": [1], "key_information": [1], "published_at": [1], "notes": ""}),
            }.get(task, lambda: json.dumps({"final_answer": " ".join(passages[0][1].split()[:7])[:ANSWER_LIMIT] if passages else "Insufficient information", "reasoning": f"{len(passages)} passages"}))()
            out.append({"content": content, "input_tokens": len(p.split()), "output_tokens": len(content.split())})
        return out


def with_retry(client: Client, prompts: Sequence[str], tries: int = 5, wait: float = 1.0) -> list[dict]:
    """One call with exponential backoff; a permanent error is raised at once."""
    for attempt in range(tries):
        try:
            return client.complete(prompts)
        except PermanentError:
            raise
        except Exception:
            if attempt == tries - 1:
                raise
            time.sleep(wait * 2**attempt)
    return []


def ask_model(df: DataFrame, prompt: str, client: Callable[[], Client] = StubClient, batch: int = 64, wait: float = 1.0) -> DataFrame:
    """``df`` with reply, reply_error, input_tokens and output_tokens.

    A batch that fails is asked again row by row, so one bad prompt costs no other row its reply; no row is ever lost.
    """
    names = df.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", reply string, reply_error string, input_tokens int, output_tokens int"

    def ask(model: Client, prompts: list[str]) -> list[tuple]:
        try:
            return [(r.get("content"), None, r.get("input_tokens"), r.get("output_tokens")) for r in with_retry(model, prompts, wait=wait)]
        except Exception as error:  # noqa: BLE001
            if len(prompts) > 1:
                return [x for p in prompts for x in ask(model, [p])]
            return [(None, f"{type(error).__name__}: {error}"[:2000], 0, 0)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = client()
        for pdf in batches:
            prompts = pdf[prompt].fillna("").tolist()
            rows = [x for start in range(0, len(pdf), batch) for x in ask(model, prompts[start : start + batch])]
            extra = pd.DataFrame(rows, columns=["reply", "reply_error", "input_tokens", "output_tokens"], index=pdf.index)
            yield pd.concat([pdf[names], extra], axis=1)

    return df.mapInPandas(run, schema)


def call_model(df: DataFrame, prompt: str, client: Callable[[], Client] = StubClient, batch: int = 64, wait: float = 1.0) -> DataFrame:
    """``df`` with final_answer, reasoning, inference_error and tokens; a failed or unreadable reply gives the failure sentinel."""
    asked = ask_model(df, prompt, client, batch, wait)
    parsed = F.from_json("reply", ANSWER)
    answer = F.when(F.col("reply").startswith("{"), parsed["final_answer"]).otherwise(F.col("reply"))
    error = F.when(F.col("reply_error").isNotNull(), F.col("reply_error")).when(answer.isNull(), "ParsingError: no final_answer").when(F.length(answer) > ANSWER_LIMIT, "ValidationError: final_answer too long")
    return asked.select(*df.columns, F.when(error.isNull(), answer).otherwise(FAILED).alias("final_answer"), F.when(error.isNull(), parsed["reasoning"]).alias("reasoning"), error.alias("inference_error"), "input_tokens", "output_tokens")


# Prompts.


def passages_block(memory: Column, documents: Column) -> Column:
    """The passages in two sections, memory first, each numbered by itself; a placeholder if there are none."""

    def section(title: str, tag: str, texts: Column) -> Column:
        lines = F.transform(texts, lambda x, i: F.concat(F.lit(f"[{tag}"), (i + 1).cast("string"), F.lit("] "), x))
        return F.when(F.coalesce(F.size(texts), F.lit(0)) > 0, F.concat(F.lit(f"{title}\n"), F.array_join(lines, "\n")))

    typed = lambda c: c.cast("array<string>")
    both = F.concat_ws("\n\n", section("From memory:", "M", typed(memory)), section("From documents:", "D", typed(documents)))
    return F.when(both == "", "(no passages retrieved)").otherwise(both)


def rag_prompt(block: Column, query: Column) -> Column:
    return F.concat(F.lit("Passages:\n"), block, F.lit("\n\nQuestion: "), query)


def evidence_block(rows: DataFrame, key: str, temporal: Column, with_author: bool = False) -> DataFrame:
    """Per key the numbered evidence lines: title, source, fact; the date only for temporal questions."""
    part = lambda label, c: F.concat(F.lit(f"{label}: "), c)
    line = F.array_join(F.array_compact(F.array(part("Title", F.col("title")), part("Source", F.col("source")), F.when(F.lit(with_author), part("Author", F.col("author"))), F.when(temporal, part("Published", F.col("published_at"))), part("Fact", F.col("fact")))), "; ")
    listed = rows.select(key, "ordinal", line.alias("line")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ordinal", "line"))).alias("l"))
    return listed.select(key, F.array_join(F.transform("l", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["line"])), "\n").alias("evidence"))


# Loops.


def naive_rag(queries: DataFrame, retrieved: DataFrame, client: Callable[[], Client] = StubClient) -> DataFrame:
    """One retrieval, one prompt, one call; the retrieval is logged as it was used. retrieved: query_id, source_type, rank, text."""
    lists = retrieved.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("source_type") == "memory", F.struct("rank", "text")))).alias("m"),
        F.array_sort(F.collect_list(F.when(F.col("source_type") == "document", F.struct("rank", "text")))).alias("d"),
    )
    ready = queries.join(lists, "query_id", "left").withColumn("prompt", rag_prompt(passages_block(F.col("m.text"), F.col("d.text")), F.col("query")))
    return materialise(call_model(ready.select("query_id", "query", "prompt"), "prompt", client), "answers").drop("prompt")


def listed(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """Per key the memory texts (``m``) and document texts (``d``) in order. rows: key, channel, text and the order columns."""
    side = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col("channel") == c, F.struct(*order, "text")))), lambda x: x["text"])
    return rows.groupBy(key).agg(side("memory").alias("m"), side("document").alias("d"))


def _task(name: str, question: Column, block: Column | None = None, gap: Column | None = None) -> Column:
    parts = [F.concat(F.lit(f"Task: {name}\nQuestion: "), question)]
    parts += [F.concat(F.lit("Missing: "), gap)] if gap is not None else []
    parts += [F.concat(F.lit("Passages:\n"), block)] if block is not None else []
    return F.concat_ws("\n\n", *parts)


def _tokens(log: list[DataFrame], asked: DataFrame) -> None:
    log.append(asked.select("query_id", "input_tokens", "output_tokens"))


def _with_tokens(answers: DataFrame, log: list[DataFrame]) -> DataFrame:
    """The answers with the tokens of all their calls."""
    every = answers.select("query_id", "input_tokens", "output_tokens")
    for x in log:
        every = every.unionByName(x)
    total = every.groupBy("query_id").agg(F.sum("input_tokens").cast("int").alias("input_tokens"), F.sum("output_tokens").cast("int").alias("output_tokens"))
    return answers.drop("input_tokens", "output_tokens").join(total, "query_id")


#: retrieve(channel, asked, seen, k): (query_id, chunk_id, rank, text) for asked (query_id, query), without the chunks of seen.
Retrieve = Callable[[str, DataFrame, "DataFrame | None", int], DataFrame]
CHANNELS = ("memory", "document")


def corrective_v1(queries: DataFrame, retrieve: Retrieve, k: int = 10, rewrites: int = 2, client: Callable[[], Client] = StubClient, wait: float = 1.0) -> DataFrame:
    """Retrieve, grade all passages at once, rewrite, generate.

    A round stands alone: passages of earlier rounds are forgotten, the grader and the answer get the last question as it
    was rewritten. A grader that fails counts as yes. At most ``rewrites`` more rounds.
    """
    log: list[DataFrame] = []
    active = queries.select("query_id", F.col("query").alias("question"))
    done: DataFrame | None = None
    for no in range(rewrites + 1):
        asked = active.select("query_id", F.col("question").alias("query"))
        found = [retrieve(c, asked, None, k).select("query_id", "rank", "chunk_id", "text").withColumn("channel", F.lit(c)) for c in CHANNELS]
        rows = active.join(listed(found[0].unionByName(found[1]), "query_id", "rank", "chunk_id"), "query_id", "left")
        graded = materialise(ask_model(rows.withColumn("prompt", _task("relevant", F.col("question"), passages_block(F.col("m"), F.col("d")))), "prompt", client, wait=wait), "graded")
        _tokens(log, graded)
        relevant = F.col("reply_error").isNotNull() | F.lower(F.trim(F.col("reply"))).startswith("yes")
        graded = graded.select("query_id", "question", "m", "d", F.coalesce(relevant, F.lit(False)).alias("relevant"), F.lit(no + 1).alias("n_rounds"))
        ended = graded if no == rewrites else graded.where("relevant")
        done = ended if done is None else done.unionByName(ended)
        if no == rewrites:
            break
        rest = graded.where("not relevant").select("query_id", "question")
        rest = materialise(ask_model(rest.withColumn("prompt", _task("rewrite", F.col("question"))), "prompt", client, wait=wait), "rewritten")
        if rest.isEmpty():
            break
        _tokens(log, rest)
        active = rest.select("query_id", F.coalesce(F.nullif(F.trim("reply"), F.lit("")), "question").alias("question"))
    ready = done.withColumn("prompt", rag_prompt(passages_block(F.col("m"), F.col("d")), F.col("question"))).join(queries.select("query_id", "query"), "query_id")
    kept = F.coalesce(F.size("m"), F.lit(0)) + F.coalesce(F.size("d"), F.lit(0))
    ready = ready.select("query_id", "query", F.col("question").alias("last_query"), "relevant", "n_rounds", F.greatest(kept, F.lit(0)).alias("n_kept"), "prompt")
    return _with_tokens(materialise(call_model(ready, "prompt", client, wait=wait), "answers"), log).drop("prompt")


def corrective_v2(queries: DataFrame, retrieve: Retrieve, memory_k: int = 10, document_k: int = 10, rewrites: int = 2, client: Callable[[], Client] = StubClient, wait: float = 1.0) -> DataFrame:
    """Retrieve twice what is still missing per channel, grade each passage, judge sufficiency, rewrite for both channels, generate.

    Chunks once seen are not fetched again; relevant ones are kept over rounds. A grader that fails keeps everything, a
    judge that fails finds the evidence insufficient, a rewriter that fails leaves the question. The answer is asked for
    with the question as it was. At most ``rewrites`` more rounds.
    """
    want = {"memory": memory_k, "document": document_k}
    log: list[DataFrame] = []
    active = queries.select("query_id", F.col("query").alias("question"), F.col("query").alias("memory_query"), F.col("query").alias("document_query"))
    kept = seen = rounds = None
    for no in range(rewrites + 1):
        have = None if kept is None else kept.groupBy("query_id").agg(*[F.count_if(F.col("channel") == c).alias(f"n_{c}") for c in CHANNELS])
        state = active.withColumns({f"n_{c}": F.lit(0) for c in CHANNELS}) if have is None else active.join(have, "query_id", "left").na.fill(0, [f"n_{c}" for c in CHANNELS])
        pending = None
        for c in CHANNELS:
            budget = state.select("query_id", F.col(f"{c}_query").alias("query"), (F.lit(want[c]) - F.col(f"n_{c}")).alias("budget")).where("budget > 0")
            got = retrieve(c, budget.select("query_id", "query"), None if seen is None else seen.where(F.col("channel") == c).select("query_id", "chunk_id"), 2 * want[c])
            got = got.join(budget.select("query_id", "budget"), "query_id").where("rank <= 2 * budget").select("query_id", "chunk_id", "rank", "text", F.lit(c).alias("channel"))
            pending = got if pending is None else pending.unionByName(got)
        pending = materialise(pending.withColumn("tag", F.concat(F.when(F.col("channel") == "memory", "M").otherwise("D"), F.col("rank").cast("string"))), "pending")
        marked = pending.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct((F.col("channel") == "document").alias("second"), "rank", "tag", "text"))).alias("l"))
        marked = state.join(marked, "query_id").select("query_id", "question", F.col("l.tag").alias("tags"), F.array_join(F.transform("l", lambda x: F.concat(F.lit("["), x["tag"], F.lit("] "), x["text"])), "\n\n").alias("block"))
        graded = materialise(ask_model(marked.withColumn("prompt", _task("grade", F.col("question"), F.col("block"))), "prompt", client, wait=wait), "graded")
        _tokens(log, graded)
        good = graded.select("query_id", F.explode(F.when(F.col("reply_error").isNotNull(), F.col("tags")).otherwise(grading_reply(F.col("reply"), F.col("tags")))).alias("tag"))
        new = pending.join(good, ["query_id", "tag"]).select("query_id", "channel", "chunk_id", "rank", "text", F.lit(no).alias("round_no"))
        kept = materialise(new if kept is None else kept.unionByName(new), "kept")
        ids = pending.select("query_id", "channel", "chunk_id")
        seen = ids if seen is None else seen.unionByName(ids)
        both = listed(kept, "query_id", "round_no", "rank", "chunk_id")
        context = active.join(both, "query_id", "left").withColumn("block", passages_block(F.col("m"), F.col("d")))
        judged = materialise(ask_model(context.withColumn("prompt", _task("sufficiency", F.col("question"), F.col("block"))).drop("block"), "prompt", client, wait=wait), "judged")
        _tokens(log, judged)
        said = F.from_json("reply", SUFFICIENCY)
        size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
        gap = F.when(F.col("reply_error").isNotNull(), "Assessment failed").when(said["sufficient"].isNull(), "Failed to assess").otherwise(F.coalesce(F.nullif(said["knowledge_gap"], F.lit("")), F.lit("General information needed")))
        judged = judged.select("query_id", "question", "memory_query", "document_query", size("m").alias("n_memory"), size("d").alias("n_document"), F.coalesce(said["sufficient"], F.lit(False)).alias("sufficient"), gap.alias("gap"))
        this = judged.select("query_id", F.struct(F.lit(no + 1).alias("round"), "memory_query", "document_query", "n_memory", "n_document", "sufficient").alias("r"))
        rounds = this if rounds is None else rounds.unionByName(this)
        if no == rewrites:
            break
        rest = judged.where("not sufficient").select("query_id", "question", "gap")
        rest = materialise(ask_model(rest.withColumn("prompt", _task("dual rewrite", F.col("question"), gap=F.col("gap"))), "prompt", client, wait=wait), "rewritten")
        if rest.isEmpty():
            break
        _tokens(log, rest)
        two = F.from_json("reply", DUAL_QUERY)
        active = rest.select("query_id", "question", *[F.coalesce(F.nullif(F.trim(two[f"{c}_query"]), F.lit("")), "question").alias(f"{c}_query") for c in CHANNELS])
    history = rounds.groupBy("query_id").agg(F.array_sort(F.collect_list("r")).alias("history"))
    ready = queries.select("query_id", "query").join(listed(kept, "query_id", "round_no", "rank", "chunk_id"), "query_id", "left").join(history, "query_id")
    ready = ready.withColumn("prompt", rag_prompt(passages_block(F.col("m"), F.col("d")), F.col("query")))
    ready = ready.select("query_id", "query", (size("m") + size("d")).alias("n_kept"), F.size("history").alias("n_rounds"), "history", "prompt")
    return _with_tokens(materialise(call_model(ready, "prompt", client, wait=wait), "answers"), log).drop("prompt")


def audit_sessions(rows: DataFrame, prompt: str, temporal: Column, client: Callable[[], Client] = StubClient, wait: float = 1.0) -> DataFrame:
    """Where each session states each field of its evidence, from the model's locations; an error row where that fails.

    A failed call whose message carries the rejected generation is recovered from it. Turns are counted from 1; others
    are dropped. The date is only asked for in temporal sessions (null else).
    """
    from ..sources.readers import failed_generation
    from .rows import all_required_present

    asked = materialise(ask_model(rows.withColumn("__temporal", F.coalesce(temporal, F.lit(False))), prompt, client, wait=wait), "audits")
    saved = failed_generation(F.col("reply_error"))
    said = F.from_json(F.coalesce("reply", saved), LOCATIONS)
    asked = asked.withColumns({"__l": said, "recovered": F.col("reply_error").isNotNull() & saved.isNotNull()})
    ok = F.col("__l")["topic"].isNotNull() | F.col("__l")["key_information"].isNotNull()
    empty = F.expr("cast(array() as array<int>)")
    place = lambda c: F.when(ok, F.array_sort(F.array_distinct(F.filter(F.coalesce(F.col("__l")[c], empty), lambda x: x >= 1)))).otherwise(empty)
    fields = {c: place(c) for c in ("topic", "source", "key_information")} | {"published_at": F.when(F.col("__temporal"), place("published_at"))}
    error = F.when(~ok, F.coalesce("reply_error", F.lit("ParsingError: no locations")))
    out = asked.select(*[c for c in rows.columns if c != prompt], *[v.alias(k) for k, v in fields.items()], F.coalesce(F.col("__l")["notes"], F.lit("")).alias("notes"), error.alias("error"), (F.col("recovered") & ok).alias("recovered"), "input_tokens", "output_tokens", "__temporal")
    present = all_required_present(F.col("topic"), F.col("source"), F.col("key_information"), F.col("published_at"), F.col("__temporal"))
    return out.withColumn("all_required_present", present).drop("__temporal")


def run_design(runs: DataFrame, retrieve: Callable[[str, DataFrame], DataFrame], agent: str, client: Callable[[], Client] = StubClient) -> DataFrame:
    """The rows of an experiment: every run answered from the stores as its delta leaves them.

    runs: run_id, query, persona, variant and whatever else the rows keep. ``retrieve(channel, runs)`` returns (run_id,
    chunk_id, rank, text) under the run's delta, which is a relation keyed by run: nothing is mutated, so nothing has to
    be restored. Each run's retrieval is recorded as it was used.
    """
    found = [materialise(retrieve(c, runs).select(F.col("run_id").alias("query_id"), "chunk_id", "rank", "text").withColumn("source_type", F.lit(c)), f"found-{c}") for c in CHANNELS]
    every = found[0].unionByName(found[1])
    answers = naive_rag(runs.select(F.col("run_id").alias("query_id"), "query"), every, client).withColumnRenamed("query_id", "run_id").drop("query")
    lists = every.groupBy(F.col("query_id").alias("run_id")).agg(*[F.transform(F.array_sort(F.collect_list(F.when(F.col("source_type") == c, F.struct("rank", "chunk_id")))), lambda x: x["chunk_id"]).alias(f"retrieved_{c}") for c in CHANNELS])
    out = runs.join(answers, "run_id").join(lists, "run_id", "left").withColumn("agent", F.lit(agent))
    return out.withColumnRenamed("final_answer", "prediction")


AGENTS: dict[str, Callable[..., DataFrame]] = {
    "agent_1": naive_rag,
    "agent_2": naive_rag,
    "agent_3": corrective_v1,
    "agent_3_v2": corrective_v2,
    "agent_4": naive_rag,
}


def build_agent(name: str) -> Callable[..., DataFrame]:
    """The pipeline of a registered agent."""
    if name not in AGENTS:
        raise KeyError(f"unknown agent {name}; known: {sorted(AGENTS)}")
    return AGENTS[name]


def prompt_key(prompt: str) -> str:
    """A stable key for caching answers by prompt."""
    return hashlib.sha256(prompt.encode()).hexdigest()[:32]
