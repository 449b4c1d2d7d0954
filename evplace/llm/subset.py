"""A varied subset of given size, by systematic selection along a Hilbert curve.

Each feature is quantised to a few levels (null and unlisted values have levels of
their own); a record's levels are a cell of a grid, and the cell's place on the
Hilbert curve is its key, so neighbours on the curve are alike in all features.
One aggregation finds the distinct cells (partial, so a cell holding a third of all
rows costs one row per task), they are sorted globally without gathering them in one
task, and evenly spaced cells are chosen with the best record of each. A size above
the number of cells takes the best ``t`` records of every cell, with ``t`` the most
that fits, and one more from evenly spaced cells that have more: large groups never
get more than one record above any other cell that still has some.

The best record is the one without error, with most features known, of the rarest
``spread`` value (so one message does not fill a cell), then by hash.

Defined results: null ids are left out, records sent again count once, a size of 0
or an empty table gives no rows, a size beyond the records gives all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.text import category_key
from ..session import materialise


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of integer points (rows), by Skilling's transform."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[dims - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


def global_rank(df: DataFrame, key: str, name: str) -> DataFrame:
    """``df`` with the 0-based rank of its distinct ``key``, ranked in ranges and never in one task."""
    ranged = materialise(df.repartitionByRange(F.col(key)).sortWithinPartitions(key).withColumn("__part", F.spark_partition_id()), "ranged")
    sizes = {r[0]: r[1] for r in ranged.groupBy("__part").count().collect()}  # one number per partition
    start, offsets = 0, {}
    for part in sorted(sizes):
        offsets[part] = start
        start += sizes[part]
    base = F.create_map(*[F.lit(v).cast("long") for kv in offsets.items() for v in kv]) if offsets else F.lit(None).cast("map<bigint,bigint>")
    within = F.row_number().over(W.Window.partitionBy("__part").orderBy(key)) - 1
    return ranged.withColumn(name, within + base[F.col("__part").cast("long")]).drop("__part")


def fair_share(sizes: list[tuple[int, int]], size: int) -> tuple[int, int]:
    """(t, rest): the most records per cell whose sum stays within the size, and what is left. ``sizes``: (cell size, cells), ascending."""
    done, cells, t = 0, sum(n for _, n in sizes), 0
    for s, n in sizes:
        if done + cells * s > size:
            t = (size - done) // cells
            return t, size - done - cells * t
        done, cells, t = done + n * s, cells - n, s
    return t, size - done


def varied_subset(
    df: DataFrame,
    key: str,
    features: dict[str, list[str]],
    size: int,
    error: str | None = None,
    spread: str | None = None,
    seed: str = "42",
) -> DataFrame:
    """The chosen records: key, the normalised features, hilbert_key, cell_rank, cell_size and pick (1 = best of its cell).

    ``features`` gives each feature's levels in their natural order.
    """
    bits = max(2, max(len(levels) + 2 for levels in features.values()).bit_length())
    names = list(features)
    clean = {f: F.coalesce(category_key(F.col(f).cast("string")), F.lit("")) for f in names}
    code = lambda f: F.when(clean[f] == "", 0).otherwise(F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in features[f]]), clean[f]).cast("int"), F.lit(0)), F.lit(len(features[f]) + 1)))
    bad = F.col(error).isNotNull().cast("int") if error else F.lit(0)
    each = df.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), *[clean[f].alias(f"v{i}") for i, f in enumerate(names)], *[code(f).alias(f"c{i}") for i, f in enumerate(names)], bad.alias("bad"), (F.col(spread).cast("string") if spread else F.lit(None).cast("string")).alias("s"))
    values = [c for c in each.columns if c != "id"]
    each = materialise(each.groupBy("id").agg(F.min(F.struct("bad", *[c for c in values if c != "bad"])).alias("r")).select("id", *[F.col(f"r.{c}").alias(c) for c in values]), "records")
    if spread:
        common = each.groupBy(F.xxhash64("s").alias("hs")).agg(F.count("*").alias("common"))
        each = each.withColumn("hs", F.xxhash64("s")).join(common, "hs").drop("hs")
    else:
        each = each.withColumn("common", F.lit(1))
    codes = [f"c{i}" for i in range(len(names))]
    unknown = sum((F.col(c) == 0).cast("int") for c in codes)
    best = F.struct("bad", unknown.alias("unknown"), "common", F.xxhash64(F.lit(seed), "id").alias("h"), "id")
    each = each.withColumn("best", best)
    cells = each.groupBy(*codes).agg(F.count("*").alias("cell_size"), F.min("best").alias("top"))

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(hilbert_key=hilbert_keys(pdf[codes].to_numpy().reshape(-1, len(codes)), bits))

    flat = cells.select(*codes, "cell_size")
    ranked = materialise(global_rank(flat.mapInPandas(keyed, ", ".join(f"{c} int" for c in codes) + ", cell_size bigint, hilbert_key bigint"), "hilbert_key", "cell_rank"), "cells")
    n = ranked.count()
    if n == 0 or size <= 0:
        t, extra_cells = 0, ranked.limit(0).select(*codes).withColumn("extra", F.lit(1))
    else:
        # The most records per cell, t, whose sum over all cells stays within the size: from one histogram of the cells'
        # sizes, which has at most ``size`` + 1 rows as larger cells count alike.
        sizes = sorted((r[0], r[1]) for r in ranked.groupBy(F.least("cell_size", F.lit(size + 1)).alias("s")).count().collect())
        t, rest = fair_share(sizes, size)
        more = materialise(global_rank(ranked.where(F.col("cell_size") > t).select(*codes, "hilbert_key"), "hilbert_key", "open_rank"), "open")
        m = max(1, more.count())
        extra_cells = more.where(F.expr(f"((open_rank + 1) * {rest}) div {m} > (open_rank * {rest}) div {m}")).select(*codes).withColumn("extra", F.lit(1)) if rest > 0 else more.limit(0).select(*codes).withColumn("extra", F.lit(1))
    take = ranked.join(extra_cells, codes, "left").withColumn("take", F.lit(t) + F.coalesce("extra", F.lit(0)))
    pick = F.row_number().over(W.Window.partitionBy(*codes).orderBy("best"))
    chosen = each.withColumn("pick", pick).where(F.col("pick") <= t + 1).join(take, codes).where(F.col("pick") <= F.col("take"))
    return chosen.select(F.col("id").alias(key), *[F.nullif(F.col(f"v{i}"), F.lit("")).alias(f) for i, f in enumerate(names)], "hilbert_key", "cell_rank", "cell_size", "pick")
