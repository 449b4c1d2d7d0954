"""Sessions and documents to chunks."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


def session_turns(df: DataFrame, session: str, text: str) -> DataFrame:
    """Rows (session_id, turn, role, content) of texts written as ``User: ...`` / ``Assistant: ...`` lines."""
    marked = F.regexp_replace(F.col(text), r"(^|\n)(User|Assistant|System): ", "\u0001$2\u0002")
    parts = F.filter(F.split(marked, "\u0001"), lambda p: F.contains(p, F.lit("\u0002")))
    rows = df.select(F.col(session).alias("session_id"), F.posexplode(parts).alias("turn", "p"))
    return rows.select("session_id", "turn", F.lower(F.split_part("p", F.lit("\u0002"), F.lit(1))).alias("role"), F.split_part("p", F.lit("\u0002"), F.lit(2)).alias("content"))


def chunk_session(turns: DataFrame) -> DataFrame:
    """One chunk per session: "role: content" lines."""
    lines = turns.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), "content").alias("line")))).alias("l"))
    return lines.select("session_id", F.col("session_id").cast("string").alias("chunk_id"), F.array_join(F.col("l.line"), "\n").alias("text"))


def chunk_pair(turns: DataFrame) -> DataFrame:
    """One chunk per user turn with the assistant turn right after it; other turns are skipped."""
    w = W.Window.partitionBy("session_id").orderBy("turn")
    next_ = turns.withColumns({"nr": F.lead("role").over(w), "nc": F.lead("content").over(w)}).where("role = 'user'")
    reply = F.when(F.col("nr") == "assistant", F.concat(F.lit("\nassistant: "), F.col("nc"))).otherwise(F.lit(""))
    out = next_.withColumns({"chunk_index": F.row_number().over(w) - 1, "text": F.concat(F.lit("user: "), F.col("content"), reply)})
    return out.select("session_id", F.concat(F.col("session_id").cast("string"), F.lit("__pair_"), "chunk_index").alias("chunk_id"), "chunk_index", "text")


def chunk_turn(turns: DataFrame) -> DataFrame:
    """One chunk per user turn, without a role prefix."""
    w = W.Window.partitionBy("session_id").orderBy("turn")
    out = turns.where("role = 'user'").withColumn("chunk_index", F.row_number().over(w) - 1)
    return out.select("session_id", F.concat(F.col("session_id").cast("string"), F.lit("__turn_"), "chunk_index").alias("chunk_id"), "chunk_index", F.col("content").alias("text"))


def transcript(turns: DataFrame) -> DataFrame:
    """User turns as [U1], [U2], ..., assistant turns as [A], other roles in capitals, joined by blank lines."""
    w = W.Window.partitionBy("session_id").orderBy("turn")
    users = F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(w)
    tag = F.when(F.col("role") == "user", F.concat(F.lit("[U"), users, F.lit("] "))).when(F.col("role") == "assistant", F.lit("[A] ")).otherwise(F.concat(F.lit("["), F.upper("role"), F.lit("] ")))
    tagged = turns.withColumn("line", F.concat(tag, "content"))
    lines = tagged.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("turn", "line"))).alias("l"))
    return lines.select("session_id", F.array_join(F.col("l.line"), "\n\n").alias("transcript"))


def document_prefix() -> Column:
    """The lines of metadata before a document's text: source, category, author; null ones are left out."""
    line = lambda name: F.concat(F.lit(f"{name}: "), F.col(name))
    return F.array_join(F.array_compact(F.array(line("source"), line("category"), line("author"))), "\n")


def document_text() -> Column:
    return F.array_join(F.array_compact(F.array(F.nullif(document_prefix(), F.lit("")), F.col("title"), F.col("text"))), "\n")


def chunk_words(df: DataFrame, key: str, text: Column, size: int = 256, overlap: int = 32) -> DataFrame:
    """Windows of ``size`` words that step by ``size - overlap``; the last may be shorter. All built-in."""
    step = size - overlap
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    rows = df.select(F.col(key).alias("doc_key"), words.alias("w")).where(F.size("w") > 0)
    n_windows = F.when(F.size("w") <= size, 0).otherwise(F.ceil((F.size("w") - size) / step)).cast("int")
    out = rows.select("doc_key", "w", F.explode(F.sequence(F.lit(0), n_windows)).alias("chunk_index"))
    return out.select("doc_key", F.concat(F.col("doc_key").cast("string"), F.lit("__chunk_"), "chunk_index").alias("chunk_id"), "chunk_index", F.array_join(F.slice("w", F.col("chunk_index") * step + 1, F.lit(size)), " ").alias("text"))


_TOKEN = re.compile(r"\w+|[^\w\s]+")


def word_punctuation_count(text: str) -> int:
    """Tokens of the public word-punctuation tokenizer: word runs and runs of other non-blank characters."""
    return len(_TOKEN.findall(text))


def split_recursive(text: str, size: int, overlap: int, count: Callable[[str], int], separators: tuple[str, ...] = ("\n\n", "\n", ". ", " ", "")) -> list[str]:
    """Pieces of at most ``size`` tokens, cut at the coarsest separator that serves, with overlap between pieces.

    Every part is counted once; a window's size is the sum of its parts and separators, which no joined text exceeds.
    """
    sep = next((s for s in separators if s and s in text), "")
    finer = separators[separators.index(sep) + 1 :] if sep else ()
    between = count(sep) if sep.strip() else 0
    out: list[str] = []
    window: deque[tuple[str, int]] = deque()
    total = 0  # tokens of the window, each part with the separator after it

    def flush() -> None:
        joined = sep.join(p for p, _ in window).strip()
        if joined:
            out.append(joined)

    for part in text.split(sep) if sep else list(text):
        n = count(part)
        if n > size and finer:
            flush()
            window.clear()
            total = 0
            out.extend(split_recursive(part, size, overlap, count, finer))
            continue
        if window and total + n > size:
            flush()
            while window and (total - between > overlap or total + n > size):
                total -= window.popleft()[1] + between
        window.append((part, n))
        total += n + between
    flush()
    return out


def chunk_recursive(df: DataFrame, key: str, text: Column, size: int = 256, overlap: int = 32, counter: Callable[[str], int] | None = None) -> DataFrame:
    """Chunks of a recursive splitter; the token counter is pluggable (default: the public word-punctuation tokenizer)."""
    count = counter or word_punctuation_count
    kind = df.schema[key].dataType

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [split_recursive(t, size, overlap, count) if t else [] for t in batch.column(1).to_pylist()]
            sizes = np.array([len(x) for x in each], np.int64)
            origin = np.repeat(np.arange(len(each)), sizes)
            place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(origin)), pa.array(place.astype(np.int32)), pa.array([p for x in each for p in x], pa.string())], ["doc_key", "chunk_index", "text"])

    rows = df.select(F.col(key).alias("doc_key"), text.alias("t")).mapInArrow(pieces, f"doc_key {kind.simpleString()}, chunk_index int, text string")
    return rows.select("doc_key", F.concat(F.col("doc_key").cast("string"), F.lit("__chunk_"), "chunk_index").alias("chunk_id"), "chunk_index", "text")


def gold_document_chunks(sessions: DataFrame, urls: DataFrame, doc_chunks: DataFrame) -> DataFrame:
    """Article chunks standing for memory sessions: session to url to document, under ids of the session."""
    hit = sessions.join(urls, "evidence_id").join(doc_chunks.withColumnRenamed("doc_key", "url"), "url")
    return hit.select("session_id", F.concat("session_id", F.lit("__golddoc_"), "chunk_index").alias("chunk_id"), "chunk_index", "text", F.lit("memory").alias("source_type"))
