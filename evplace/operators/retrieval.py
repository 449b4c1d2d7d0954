"""Top-k retrieval: dense, BM25 and hybrid, with exclusions and per-run store deltas.

Queries are a stated set (never all rows against all rows). Dense search and BM25 alike send the
queries in blocks of bounded size to the chunks, where they lie, and every task keeps its own top k,
so k rows per query and task are shuffled, however common a term is. The corpus is tokenised twice:
once for the document frequencies (aggregated before the shuffle), once for the scores.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from ..session import materialise

K1, B = 1.5, 0.75


def terms(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"))


def top_k(scored: DataFrame, k: int, query: str = "query_id", chunk: str = "chunk_id") -> DataFrame:
    """The k best chunks per query by rounded score, ties by chunk id."""
    w = W.Window.partitionBy(query).orderBy(F.desc("score"), chunk)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def term_statistics(tokens: DataFrame) -> DataFrame:
    """(term, df, words): chunks that hold the term and their words; the empty term has those of the whole corpus."""
    marked = tokens.select(F.size("t").cast("long").alias("dl"), F.explode(F.array_append(F.array_distinct("t"), F.lit(""))).alias("term"))
    return marked.groupBy("term").agg(F.count("*").alias("df"), F.sum("dl").alias("words"))


@dataclass
class Bm25Index:
    """A corpus tokenised and counted once, for searches that come again and again."""

    tokens: DataFrame  # chunk_id, t
    stats: DataFrame  # term, df, words


def bm25_index(chunks: DataFrame, text: str = "text") -> Bm25Index:
    tokens = materialise(chunks.select("chunk_id", terms(F.col(text)).alias("t")), "tokens")
    return Bm25Index(tokens, materialise(term_statistics(tokens), "index-statistics"))


def query_weights(tokens: DataFrame, statistics: DataFrame, queries: DataFrame, query_text: str, exclude: DataFrame | None) -> DataFrame:
    """(query_id, term, idf, mean): the weight of each query term, and the mean length of the query's corpus.

    Excluded chunks leave a query's corpus without rebuilding anything: its number of chunks, word sum and document
    frequencies are the corpus's less those of the chunks.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(terms(F.col(query_text)))).alias("term"))
    asked = materialise(asked, "query-terms")
    wanted = asked.select("term").unionByName(asked.sparkSession.range(1).select(F.lit("").alias("term"))).distinct()
    stats = materialise(statistics.join(wanted, "term", "left_semi"), "term-statistics")
    total = stats.where("term = ''").first()
    n, words = (total["df"], total["words"]) if total else (0, 0)
    own = asked.join(stats.select("term", "df"), "term")
    if exclude is None:
        own = own.withColumns({"n": F.lit(n), "mean": F.lit(float(words) / n if words else 1.0)})
    else:
        out = exclude.select("query_id", "chunk_id").distinct().join(tokens, "chunk_id")
        out = materialise(out, "excluded")
        gone = out.groupBy("query_id").agg(F.count("*").alias("n_out"), F.sum(F.size("t")).alias("words_out"))
        gone_df = out.select("query_id", F.explode(F.array_distinct("t")).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("df_out"))
        own = own.join(gone_df, ["query_id", "term"], "left").join(gone, "query_id", "left").na.fill(0, ["df_out", "n_out", "words_out"])
        own = own.withColumns({"df": F.col("df") - F.col("df_out"), "n": F.lit(n) - F.col("n_out")}).where("df > 0").withColumn("mean", (F.lit(words) - F.col("words_out")) / F.col("n"))
    return own.select("query_id", "term", F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), "mean")


class QueryBlock:
    """The terms of a block of queries: for each term the queries that ask for it and its weight in them."""

    def __init__(self, rows: list[tuple], skip: list[tuple]) -> None:
        self.names = sorted({r[0] for r in rows})
        place = {q: i for i, q in enumerate(self.names)}
        self.terms = {t: i for i, t in enumerate(sorted({r[1] for r in rows}))}
        by_term: list[list[tuple[int, float]]] = [[] for _ in self.terms]
        self.mean = np.ones(len(self.names))
        for q, term, idf, mean in rows:
            by_term[self.terms[term]].append((place[q], idf))
            self.mean[place[q]] = mean
        self.ask = [np.array([q for q, _ in x], np.int64) for x in by_term]
        self.idf = [np.array([w for _, w in x]) for x in by_term]
        self.skip: dict[object, list[int]] = {}
        for q, chunk in skip:
            if q in place:
                self.skip.setdefault(chunk, []).append(place[q])

    def scores(self, ids: list, words: list[list[str]]) -> np.ndarray:
        """Score of every query (line) and chunk (column), 0 where they share no term."""
        out = np.zeros((len(self.names), len(ids)))
        length = np.array([len(w) for w in words], np.float64)
        known = [(j, self.terms[w]) for j, ws in enumerate(words) for w in ws if w in self.terms]
        if known:
            at = np.array(known, np.int64)
            code, tf = np.unique(at[:, 1] * len(ids) + at[:, 0], return_counts=True)
            term, chunk = np.divmod(code, len(ids))
            first = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
            for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(code)]):
                q, c, n = self.ask[term[lo]], chunk[lo:hi], tf[lo:hi]
                part = n * (K1 + 1) / (n + K1 * (1 - B + B * length[c][None, :] / self.mean[q][:, None]))
                out[np.ix_(q, c)] += self.idf[term[lo]][:, None] * part
        for j, chunk_id in enumerate(ids):
            if chunk_id in self.skip:
                out[self.skip[chunk_id], j] = 0.0
        return np.round(out, 6)


def bm25_of_partition(shared, k: int, arrow: pa.Schema, rows: int = 512):
    """The function that keeps the k best chunks of a whole partition for every query of a block; equal scores go by chunk id."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: QueryBlock = QueryBlock.__new__(QueryBlock)
        block.__dict__.update(shared.value)
        least = np.full(len(block.names), 1e-9)
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def compact() -> None:
            q, score, ids = (np.concatenate(x) for x in zip(*kept))
            order = np.lexsort((ids, -score, q))
            q, score, ids = q[order], score[order], ids[order]
            start = np.searchsorted(q, q, "left")
            best = np.arange(len(q)) - start < k
            q, score, ids = q[best], score[best], ids[best]
            full = np.flatnonzero(np.arange(len(q)) - np.searchsorted(q, q, "left") == k - 1)
            least[q[full]] = score[full]
            kept[:] = [(q, score, ids)]

        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                ids = part.column(0).to_pylist()
                scores = block.scores(ids, part.column(1).to_pylist())
                q, c = np.nonzero(scores >= least[:, None])
                if len(q):
                    kept.append((q, scores[q, c], np.array(ids)[c]))
                    if sum(len(x[0]) for x in kept) > 4 * k * len(block.names):
                        compact()
        if kept:
            compact()
            q, score, ids = kept[0]
            yield pa.RecordBatch.from_arrays([pa.array([block.names[i] for i in q.tolist()], arrow.field(0).type), pa.array(ids.tolist(), arrow.field(1).type), pa.array(score)], arrow.names)

    return search


def bm25_top_k(chunks: DataFrame | Bm25Index, queries: DataFrame, k: int, text: str = "text", query_text: str = "query", exclude: DataFrame | None = None, drop: DataFrame | None = None, block: int = 20_000) -> DataFrame:
    """(query_id, chunk_id, score, rank): the k best chunks per query among those that share a term with it, ties by chunk id.

    Okapi BM25 with k1 = 1.5, b = 0.75 and idf ln(1 + (N - df + .5) / (df + .5)). ``exclude`` (query_id, chunk_id) takes
    chunks out of a query's corpus, statistics and all; those of ``drop`` are only left out of its result. Queries travel
    in blocks of about ``block`` terms.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = queries.sparkSession
    base = chunks.tokens if isinstance(chunks, Bm25Index) else chunks.select("chunk_id", terms(F.col(text)).alias("t"))
    statistics = chunks.stats if isinstance(chunks, Bm25Index) else term_statistics(base)
    own = materialise(query_weights(base, statistics, queries, query_text, exclude), "query-weights")
    blocks = max(1, -(-own.count() // block))
    schema = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("chunk_id", base.schema["chunk_id"].dataType), T.StructField("score", T.DoubleType())])
    arrow = to_arrow_schema(schema)
    skip = [x.select("query_id", "chunk_id") for x in (exclude, drop) if x is not None]
    skip = materialise((skip[0] if len(skip) == 1 else skip[0].unionByName(skip[1])).distinct(), "left-out") if skip else None
    out: DataFrame | None = None
    for i in range(blocks):
        mine = F.expr(f"pmod(xxhash64(query_id), {blocks}) = {i}")
        rows = [tuple(r) for r in own.where(mine).select("query_id", "term", "idf", "mean").collect()]
        if rows:
            left_out = [tuple(r) for r in skip.where(mine).select("query_id", "chunk_id").collect()] if skip is not None else []
            part = base.mapInArrow(bm25_of_partition(spark.sparkContext.broadcast(vars(QueryBlock(rows, left_out))), k, arrow), schema)
            out = part if out is None else out.unionByName(part)
    return top_k(out if out is not None else spark.createDataFrame([], schema), k)


def best_of_partition(shared, keep: int, rows: int = 1024):
    """The function that keeps the best chunks of a whole partition for every query of a block.

    Slices of ``rows`` chunks are scored at a time, so the score matrix stays small whatever the size of a batch, and
    only ``keep`` rows per query leave the partition. Equal scores go by chunk id.
    """

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, matrix, skip = shared.value
        best_scores = np.zeros((len(names), 0))
        best_ids: np.ndarray | None = None
        for pdf in batches:
            for start in range(0, len(pdf), rows):
                part = pdf.iloc[start : start + rows]
                scores = np.round(matrix @ np.stack(part["vector"].to_numpy()).astype(np.float64).T, 6)
                for j, chunk_id in enumerate(part["chunk_id"].tolist() if skip else ()):
                    if chunk_id in skip:
                        scores[skip[chunk_id], j] = -np.inf
                ids = np.broadcast_to(part["chunk_id"].to_numpy(), scores.shape)
                scores = np.concatenate([best_scores, scores], axis=1)
                ids = ids if best_ids is None else np.concatenate([best_ids, ids], axis=1)
                by_id = np.argsort(ids, axis=1, kind="stable")
                by_score = np.argsort(-np.take_along_axis(scores, by_id, 1), axis=1, kind="stable")[:, :keep]
                top = np.take_along_axis(by_id, by_score, 1)
                best_scores, best_ids = np.take_along_axis(scores, top, 1), np.take_along_axis(ids, top, 1)
        if best_ids is not None:
            out = pd.DataFrame({"query_id": np.repeat(names, best_ids.shape[1]), "chunk_id": best_ids.ravel(), "score": best_scores.ravel()})
            yield out[out["score"] > -np.inf]

    return search


def dense_top_k(chunks: DataFrame, queries: DataFrame, k: int, exclude: DataFrame | None = None, min_score: float | None = None, block: int = 2000) -> DataFrame:
    """(query_id, chunk_id, score, rank): cosine of unit vectors, best k per query.

    ``chunks``: chunk_id, vector. ``queries``: query_id, vector. ``exclude``: (query_id, chunk_id) left out before ranking.
    ``min_score`` filters after ranking. Queries travel in blocks of ``block`` vectors.
    """
    spark = chunks.sparkSession
    ask = materialise(queries.select("query_id", "vector"), "query-vectors")
    blocks = max(1, -(-ask.count() // block))
    base = chunks.select("chunk_id", "vector")
    types = f"query_id {queries.schema['query_id'].dataType.simpleString()}, chunk_id {chunks.schema['chunk_id'].dataType.simpleString()}, score double"
    left_out = None if exclude is None else materialise(exclude.select("query_id", "chunk_id").distinct(), "left-out")
    out: DataFrame | None = None
    for i in range(blocks):
        mine = F.expr(f"pmod(xxhash64(query_id), {blocks}) = {i}")
        rows = ask.where(mine).collect()
        if not rows:
            continue
        ids = np.array([r[0] for r in rows], dtype=object)
        place = {q: n for n, q in enumerate(ids.tolist())}
        skip: dict[object, list[int]] = {}
        for q, chunk in [] if left_out is None else left_out.where(mine).collect():
            if q in place:
                skip.setdefault(chunk, []).append(place[q])
        shared = spark.sparkContext.broadcast((ids, np.array([r[1] for r in rows], dtype=np.float64), skip))

        part = base.mapInPandas(best_of_partition(shared, k), types)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], types)
    ranked = top_k(out, k)
    return ranked if min_score is None else ranked.where(F.col("score") >= min_score)


DIMENSIONS = 64


def hashed_vectors(df: DataFrame, key: str, text: str, out: str = "chunk_id") -> DataFrame:
    """The offline embedding: counts of hashed terms in 64 dimensions, scaled to unit length (zero without terms)."""

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots: dict[str, int] = {}
        for batch in batches:
            lists = batch.column(1)
            words = lists.flatten().to_pylist()
            if len(slots) > 1_000_000:
                slots = {}
            for w in set(words):
                if w not in slots:
                    slots[w] = int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % DIMENSIONS
            owner = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            counts = np.zeros((batch.num_rows, DIMENSIONS))
            np.add.at(counts, (owner, np.fromiter((slots[w] for w in words), np.int64, len(words))), 1.0)
            norm = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
            flat = np.divide(counts, norm, out=counts, where=norm > 0).ravel()
            offsets = pa.array(np.arange(0, DIMENSIONS * batch.num_rows + 1, DIMENSIONS), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(flat))], [out, "vector"])

    return df.select(F.col(key).alias(out), terms(F.col(text)).alias("t")).mapInArrow(embed, f"{out} {df.schema[key].dataType.simpleString()}, vector array<double>")


def reciprocal_rank_fusion(lists: list[tuple[DataFrame, float]], k: int, c: int = 60) -> DataFrame:
    """Hybrid ranking: sum of weight / (c + rank) over the lists, ties by chunk id."""
    every: DataFrame | None = None
    for ranked, weight in lists:
        part = ranked.select("query_id", "chunk_id", (F.lit(weight) / (F.lit(c) + F.col("rank"))).alias("part"))
        every = part if every is None else every.unionByName(part)
    return top_k(every.groupBy("query_id", "chunk_id").agg(F.round(F.sum("part"), 8).alias("score")), k)


def recall_at_k(found: DataFrame, gold: DataFrame) -> DataFrame:
    """Per query: gold chunks, those found, and their share (null without gold). ``gold``: query_id, chunk_id."""
    hits = gold.join(found.select("query_id", "chunk_id", F.lit(1).alias("hit")), ["query_id", "chunk_id"], "left")
    out = hits.groupBy("query_id").agg(F.count("*").alias("n_gold"), F.count("hit").alias("n_found"))
    return out.withColumn("recall", F.round(F.col("n_found") / F.nullif("n_gold", F.lit(0)), 6))


# Store deltas: what one run removes from and adds to the candidates, as relations keyed by run.


@dataclass
class Delta:
    """exclude (run_id, url), strip and ensure (run_id, session_id). The stores themselves are never changed, so nothing is restored."""

    exclude: DataFrame
    strip: DataFrame
    ensure: DataFrame

    @classmethod
    def none(cls, runs: DataFrame) -> Delta:
        """The delta of a dry run: nothing is excluded, stripped or ensured."""
        empty = runs.select("run_id").limit(0)
        named = lambda c: empty.withColumn(c, F.lit(None).cast("string"))
        return cls(named("url"), named("session_id"), named("session_id"))


def delta_counts(runs: DataFrame, memory: DataFrame, docs: DataFrame, strip: DataFrame, ensure: DataFrame, exclude: DataFrame) -> DataFrame:
    """Candidates of each run after its delta, without building run x chunk.

    runs: run_id, persona. memory: persona, session_id, words. docs: url, words. strip, ensure: run_id, session_id.
    exclude: run_id, url. Strip comes before ensure; an ensured session that is present (and not stripped) is not
    added again. Counts and word sums adjust the corpus statistics of each run.
    """
    per = memory.groupBy("persona").agg(F.count("*").alias("m_n"), F.sum("words").alias("m_words"))
    d = docs.agg(F.count("*").alias("n"), F.sum("words").alias("w")).first()
    one = memory.groupBy("session_id").agg(F.max("words").alias("words"))
    gone = strip.join(runs, "run_id").join(memory, ["persona", "session_id"]).groupBy("run_id").agg(F.count("*").alias("out_n"), F.sum("words").alias("out_words"))
    kept = runs.select("run_id", "persona").join(ensure, "run_id")
    present = memory.select("persona", "session_id", F.lit(1).alias("present"))
    stripped = strip.select("run_id", "session_id", F.lit(1).alias("stripped"))
    added = kept.join(present, ["persona", "session_id"], "left").join(stripped, ["run_id", "session_id"], "left").where("present is null or stripped = 1")
    added = added.join(one, "session_id", "left").groupBy("run_id").agg(F.count("*").alias("in_n"), F.coalesce(F.sum("words"), F.lit(0)).alias("in_words"))
    cut = exclude.join(docs, "url").groupBy("run_id").agg(F.count("*").alias("cut_n"), F.sum("words").alias("cut_words"))
    out = runs.join(per, "persona", "left").join(gone, "run_id", "left").join(added, "run_id", "left").join(cut, "run_id", "left").na.fill(0)
    return out.select(
        "run_id",
        (F.col("m_n") - F.col("out_n") + F.col("in_n")).alias("n_memory"),
        (F.col("m_words") - F.col("out_words") + F.col("in_words")).alias("memory_words"),
        (F.lit(d["n"] or 0) - F.col("cut_n")).alias("n_docs"),
        (F.lit(d["w"] or 0) - F.col("cut_words")).alias("doc_words"),
    )
