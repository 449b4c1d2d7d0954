"""Held-out test passages inside a training corpus, by greedy string tiling.

Words are the lower-cased runs of letters and digits; all else is ignored, so
changed case, punctuation, markup and line breaks hide nothing. A seed is a run
of ``tile_words`` words that a document shares with an item. Seeds are found by a
running Karp-Rabin hash over whole documents, joined with the hashes of all item
windows. A pair whose seeds could make a common run of ``run_words`` words, or cover
``coverage`` of the item's words, is tiled: the longest common run that overlaps no
earlier tile is marked, again and again, down to ``tile_words`` words, so a passage
whose parts were reordered still covers. What the tiles then say decides.

The items are the stated query set. They reach the executors in blocks of at most
``block_words`` words (about 30 MB each), chosen by a hash of the item; a task takes one
block after another for every slice of its documents and holds one at a time, so what is
in memory never grows with the items. Documents are read once, in place: no shuffle of text.

Defined results: null or empty texts and items of fewer than ``tile_words`` words
hold nothing; repeated item rows count once; repeated document rows each give
their rows; documents of any length are read whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise

_WORD = re.compile(r"[^\W_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_FILTER_BITS = 22


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters and digits."""
    return _WORD.findall(text.lower()) if text else []


def running_hashes(codes: np.ndarray, width: int) -> np.ndarray:
    """The Karp-Rabin hash (modulo 2**64) of every window of ``width`` codes."""
    n = len(codes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(width):
        h *= _BASE
        h += codes[j : n + j]
    return h ^ (h >> np.uint64(29))


def common_runs(doc: np.ndarray, item: np.ndarray, least: int, most: int = 2_000_000) -> np.ndarray:
    """Lines (place in doc, place in item, words) of all maximal common runs of ``least`` words or more.

    Windows that match are taken ``most`` pairs at a time and joined along their diagonals, so repetitive texts cost
    time but no memory beyond their runs.
    """
    h = running_hashes(item, least)
    order = np.argsort(h, kind="stable")
    h = h[order]
    hashes = running_hashes(doc, least)
    left, right = np.searchsorted(h, hashes, "left"), np.searchsorted(h, hashes, "right")
    at = np.flatnonzero(right > left)
    size = (right - left)[at]
    cuts = np.r_[0, np.flatnonzero(np.diff(np.cumsum(size) // most)) + 1, len(at)]
    runs = []
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        n = size[lo:hi]
        i = np.repeat(at[lo:hi], n)
        j = order[np.repeat(left[at[lo:hi]], n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))]
        same = np.ones(len(i), bool)
        for k in range(least):  # equal hashes, checked word by word
            same &= doc[i + k] == item[j + k]
        runs.append(joined_runs(i[same], j[same], np.ones(same.sum(), np.int64)))
    every = np.concatenate(runs) if runs else np.zeros((0, 3), np.int64)
    every = joined_runs(every[:, 0], every[:, 1], every[:, 2]) if len(runs) > 1 else every
    every[:, 2] += least - 1
    return every


def joined_runs(i: np.ndarray, j: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Runs of matching windows, joined where one begins right after another on the same diagonal."""
    order = np.lexsort((i, i - j))
    i, j, k = i[order], j[order], k[order]
    first = np.flatnonzero(np.r_[True, (i[1:] - j[1:] != i[:-1] - j[:-1]) | (i[1:] != i[:-1] + k[:-1])]) if len(i) else np.zeros(0, np.int64)
    return np.stack([i[first], j[first], np.add.reduceat(k, first) if len(first) else k], 1).astype(np.int64)


def greedy_tiles(doc: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in doc, place in item, words), longest first.

    Ties go to the earlier place in the document, then in the item.
    """
    heap = [(-k, i, j) for i, j, k in common_runs(doc, item, least).tolist()]
    heapify(heap)
    in_doc, in_item = np.zeros(len(doc), bool), np.zeros(len(item), bool)
    tiles: list[tuple[int, int, int]] = []
    while heap:
        k, i, j = heappop(heap)
        k = -k
        free = ~(in_doc[i : i + k] | in_item[j : j + k])
        if free.all():
            in_doc[i : i + k] = in_item[j : j + k] = True
            tiles.append((i, j, k))
            continue
        # Partly covered by a longer tile: what is left of it takes its place among the rest.
        edge = np.flatnonzero(np.diff(np.r_[False, free, False].astype(np.int8)))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if b - a >= least:
                heappush(heap, (a - b, i + a, j + a))
    return tiles


class ItemIndex:
    """The windows of one block of items: word codes, hashes (each once per item) and a bit filter."""

    def __init__(self, items: list[tuple[object, str]], seed: int) -> None:
        self.seed = seed
        self.vocabulary: dict[str, int] = {}
        self.ids: list[object] = []
        self.codes: list[np.ndarray] = []
        hashes, owners = [], []
        for item_id, text in items:
            codes = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)], np.uint64)
            if len(codes) < seed:
                continue
            h = np.unique(running_hashes(codes, seed))
            hashes.append(h)
            owners.append(np.full(len(h), len(self.ids)))
            self.ids.append(item_id)
            self.codes.append(codes)
        self.hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.owners = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        order = np.argsort(self.hashes, kind="stable")
        self.hashes, self.owners = self.hashes[order], self.owners[order]
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[(self.hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True

    @classmethod
    def of(cls, state: dict) -> ItemIndex:
        """The index of a state that was sent to an executor."""
        index = cls.__new__(cls)
        index.__dict__.update(state)
        return index

    def search(self, texts: list[list[str]], run: int, coverage: float) -> list[tuple[int, int, np.ndarray]]:
        """(row, item, codes of the document) for every pair whose seeds could make such a run or coverage."""
        get = self.vocabulary.get
        each = [np.array([get(w, 0) for w in words], np.uint64) for words in texts]
        gap = np.zeros(1, np.uint64)  # no item holds code 0, so no seed crosses from one text to the next
        ends = np.cumsum([len(c) + 1 for c in each]) if each else np.zeros(0, np.int64)
        codes = np.concatenate([x for c in each for x in (c, gap)]) if each else gap
        h = running_hashes(codes, self.seed)
        at = np.flatnonzero(self.filter[(h >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        row = np.searchsorted(ends, at, "right")
        left, right = np.searchsorted(self.hashes, h[at], "left"), np.searchsorted(self.hashes, h[at], "right")
        hit = right > left
        # Each seed once per text, then one line per (text, item, seed).
        row, left, n = row[hit], left[hit], (right - left)[hit]
        _, once = np.unique(np.stack([row, left], 1), axis=0, return_index=True)
        row, left, n = row[once], left[once], n[once]
        owner = self.owners[np.repeat(left, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))]
        seed = self.hashes[np.repeat(left, n)]
        row = np.repeat(row, n)
        order = np.lexsort((owner, row))
        row, owner, seed = row[order], owner[order], seed[order]
        first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (owner[1:] != owner[:-1])]) if len(row) else np.zeros(0, np.int64)
        out = []
        for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(row)]):
            item = int(owner[lo])
            words = self.codes[item]
            # A coverage c takes at least c / seed of the item's words in tiles of seeds.
            if hi - lo + self.seed - 1 < min(run, coverage * len(words)) and (hi - lo) * self.seed < coverage * len(words):
                continue
            mine = np.isin(running_hashes(words, self.seed), seed[lo:hi])
            edge = np.flatnonzero(np.diff(np.r_[False, mine, False].astype(np.int8)))
            lengths = edge[1::2] - edge[::2] + self.seed - 1
            covered = np.zeros(len(words) + 1, np.int64)
            np.add.at(covered, edge[::2], 1)
            np.add.at(covered, edge[1::2] + self.seed - 1, -1)
            if lengths.max() >= run or np.count_nonzero(np.cumsum(covered)[:-1]) >= coverage * len(words):
                out.append((int(row[lo]), item, each[row[lo]]))
        return out


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    run_words: int = 12,
    coverage: float = 0.6,
    tile_words: int = 5,
    block_words: int = 1_000_000,
) -> DataFrame:
    """One row per (document, item) whose longest tile has ``run_words`` words or whose tiles cover ``coverage`` of the item.

    Columns: doc_id, item_id, longest_run, n_tiles, covered_words, item_words,
    coverage (share of the item's words that tiles cover).
    """
    spark = docs.sparkSession
    wanted = materialise(items.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).alias("item_id"), F.col(item_text).alias("t")).distinct(), "items")
    total = wanted.agg(F.coalesce(F.sum(F.length("t") / 5 + 1), F.lit(0.0))).first()[0]
    n_blocks = max(1, math.ceil(total / block_words))
    fields = [("longest_run", pa.int32()), ("n_tiles", pa.int32()), ("covered_words", pa.int32()), ("item_words", pa.int32()), ("coverage", pa.float64())]
    kinds = ", ".join([f"doc_id {docs.schema[doc_id].dataType.simpleString()}", f"item_id {items.schema[item_id].dataType.simpleString()}", "longest_run int", "n_tiles int", "covered_words int", "item_words int", "coverage double"])
    # The driver makes one block at a time; broadcasts lie on its disk.
    blocks = [spark.sparkContext.broadcast(vars(ItemIndex([tuple(r) for r in wanted.where(F.expr(f"pmod(xxhash64(item_id), {n_blocks}) = {i}")).collect()], tile_words))) for i in range(n_blocks)]
    id_type = pa.string() if items.schema[item_id].dataType.typeName() == "string" else None

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Slices of about a million words keep the arrays small whatever the batch holds.
            column, start = batch.column(1), 0
            while start < batch.num_rows:
                texts, size = [], 0
                while start + len(texts) < batch.num_rows and size < 6_000_000:
                    value = column[start + len(texts)].as_py()
                    texts.append(words_of(value))
                    size += len(value or "")
                for shared in blocks:
                    index = ItemIndex.of(shared.value)
                    rows, named, result = [], [], []
                    for row, item, codes in index.search(texts, run_words, coverage):
                        tiles = greedy_tiles(codes, index.codes[item], tile_words)
                        longest, covered, words = max((k for _, _, k in tiles), default=0), sum(k for _, _, k in tiles), len(index.codes[item])
                        if longest >= run_words or covered >= coverage * words:
                            rows.append(start + row)
                            named.append(index.ids[item])
                            result.append((longest, len(tiles), covered, words, covered / words))
                    if len(blocks) > 1:
                        shared.__dict__.pop("_value", None)  # one block in memory at a time
                    if rows:
                        values = [pa.array([r[i] for r in result], kind) for i, (_, kind) in enumerate(fields)]
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(named, id_type), *values], ["doc_id", "item_id", *[name for name, _ in fields]])
                start += len(texts)

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t")).mapInArrow(search, kinds)
