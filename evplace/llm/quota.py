"""Samples that match target counts, category shares and minimums, with a report.

Usable records are pre-aggregated to one row per (pool, record). One pass over them then
feeds a reservoir per stratum (pool x domain x category) in every task: the number of its
records and those with the least hashes, at most as many as the pool can take. Reservoirs
are mergeable (add the numbers, keep the least hashes), so a pool holding a third of all
rows is spread over many tasks and only bounded reservoirs are shuffled. The merged
numbers (a handful per pool) give feasible quotas by a minimum-cost flow: the domain
targets hold first, then the minimums, then the shares, then other categories, last
records without category. The merged reservoirs are trimmed to the quotas by hash, which
is a uniform choice within each stratum.

Defined results: records with a null id, null pool or non-null error are not usable;
records sent again count once (differing copies: the least category, off-topic if any
copy is); category is compared without case and outer blanks, and null, empty or
unlisted categories belong to none; a null domain flag belongs to neither domain but
counts for its category; null targets are 0; a pool without records is reported.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.text import category_key
from ..session import materialise

NONE = "(none)"
RANGE_BITS = 12


def reservoirs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per stratum of a task: one row with the number of its records, and one for each of its ``bound`` least hashes.

    Columns in: pool_id, domain, category, custom_id, rank_hash, bound. A reservoir is cut back whenever it is twice
    its bound, so a task holds no more than that whatever the size of a stratum.
    """
    seen: dict[tuple, int] = {}
    kept: dict[tuple, list[tuple]] = {}
    bounds: dict[tuple, int] = {}
    for batch in batches:
        for pool, domain, category, record, rank, bound in zip(*[c.to_pylist() for c in batch.columns]):
            stratum = (pool, domain, category)
            seen[stratum] = seen.get(stratum, 0) + 1
            bounds[stratum] = bound
            if bound <= 0:
                continue
            mine = kept.setdefault(stratum, [])
            mine.append((rank, record))
            if len(mine) >= 2 * bound + 64:
                mine.sort()
                del mine[bound:]
    for stratum, n in seen.items():
        rows = sorted(kept.get(stratum, []))
        yield reservoir_batch(stratum, n, rows[: bounds[stratum]])


def reservoir_batch(stratum: tuple, n: int, rows: list[tuple]) -> pa.RecordBatch:
    size = len(rows) + 1
    columns = [pa.array([x] * size, pa.string()) for x in stratum]
    columns += [pa.array([n] + [None] * len(rows), pa.int64()), pa.array([None, *[r for _, r in rows]], pa.string()), pa.array([None, *[h for h, _ in rows]], pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["pool_id", "domain", "category", "n", "custom_id", "rank_hash"])


def flow_quotas(targets: dict[str, int], available: dict[tuple[str, str], int], shares: dict[str, tuple[float, int]]) -> dict[tuple[str, str], int]:
    """Quota per (domain, category): as much of every target as there is, at least cost.

    Cost of a unit: 0 up to a category's minimum, 1 up to its share, 4 beyond it, 9 without category.
    """
    wanted = {d: min(t, sum(n for (e, _), n in available.items() if e == d)) for d, t in targets.items()}
    total = sum(wanted.values())
    raw = {c: s * total for c, (s, _) in shares.items()}
    goal = {c: int(x) for c, x in raw.items()}
    for c in sorted(raw, key=lambda c: (goal[c] - raw[c], c))[: max(0, round(sum(raw.values())) - sum(goal.values()))]:
        goal[c] += 1
    edges: list[list[int]] = []  # from, to, capacity, cost; edge i ^ 1 is its reverse
    names: dict[object, int] = {}
    node = lambda x: names.setdefault(x, len(names))

    def edge(a: object, b: object, capacity: int, cost: int) -> int:
        edges.extend(([node(a), node(b), capacity, cost], [node(b), node(a), 0, -cost]))
        return len(edges) - 2

    for d, t in sorted(wanted.items()):
        edge("source", ("d", d), t, 0)
    arcs = {}
    for (d, c), n in sorted(available.items()):
        if d in wanted:
            arcs[d, c] = edge(("d", d), ("c", c), n, 0)
    for c in sorted({c for _, c in arcs}):
        if c not in shares:
            edge(("c", c), "sink", total, 9)
            continue
        least = min(shares[c][1], total)
        edge(("c", c), "sink", least, 0)
        edge(("c", c), "sink", max(0, goal[c] - least), 1)
        edge(("c", c), "sink", total, 4)
    source, sink = node("source"), node("sink")
    while True:
        best, via = {source: 0}, {}
        for _ in names:
            changed = False
            for i, (a, b, capacity, cost) in enumerate(edges):
                if capacity > 0 and a in best and best[a] + cost < best.get(b, 1 << 60):
                    best[b], via[b], changed = best[a] + cost, i, True
            if not changed:
                break
        if sink not in best:
            break
        path, at = [], sink
        while at != source:
            path.append(via[at])
            at = edges[via[at]][0]
        push = min(edges[i][2] for i in path)
        for i in path:
            edges[i][2] -= push
            edges[i ^ 1][2] += push
    return {k: edges[i ^ 1][2] for k, i in arcs.items()}


def sample_to_targets(sessions: DataFrame, pools: DataFrame, shares: DataFrame, seed: str = "42") -> tuple[DataFrame, DataFrame]:
    """(sample, report).

    sample: pool_id, custom_id, domain, category. report: pool_id, stratum, kind
    (target, minimum, share), wanted, usable, taken, met (by what the sample takes; a share
    within one record) and exhausted (there are fewer usable records than wanted).
    """
    category = category_key(F.col("scenario_category"))
    known = shares.select(category_key(F.col("scenario_category")).alias("category"), "persona_id", F.coalesce("target_share", F.lit(0.0)).alias("share"), F.coalesce("min_count", F.lit(0)).alias("least"))
    usable = sessions.where(F.col("pool_id").isNotNull() & F.col("custom_id").isNotNull() & F.col("session_parse_error").isNull())
    usable = usable.groupBy("pool_id", "custom_id").agg(F.max("is_off_topic").alias("off"), F.min(category).alias("category"))
    targets = pools.where("pool_id is not null").groupBy("pool_id").agg(F.min("persona_id").alias("persona_id"), F.max(F.coalesce("target_in_domain", F.lit(0))).alias("t_in"), F.max(F.coalesce("target_off_topic", F.lit(0))).alias("t_off"))
    domain = F.when(F.col("off"), "off_topic").when(~F.col("off"), "in_domain").otherwise(NONE)
    # Categories that the persona does not list are one stratum, so a pool has a handful of strata whatever is written.
    listed = targets.join(known, "persona_id").select("pool_id", "category", F.lit(True).alias("listed")).distinct()
    usable = usable.join(listed, ["pool_id", "category"], "left")
    usable = usable.select("pool_id", "custom_id", domain.alias("domain"), F.when(F.col("listed"), F.col("category")).otherwise(NONE).alias("category"))
    usable = usable.withColumn("rank_hash", F.xxhash64(F.lit(seed), "pool_id", "custom_id"))

    # One pass: the numbers and the bounded reservoirs of every stratum.
    usable = usable.join(targets.select("pool_id", F.greatest("t_in", "t_off").cast("long").alias("bound")), "pool_id")
    usable = usable.select("pool_id", "domain", "category", F.col("custom_id").cast("string").alias("custom_id"), "rank_hash", "bound")
    held = materialise(usable.mapInArrow(reservoirs, "pool_id string, domain string, category string, n bigint, custom_id string, rank_hash bigint"), "reservoirs")
    counts = held.where("n is not null").groupBy("pool_id", "domain", "category").agg(F.sum("n").alias("n"))
    parts = held.where("n is null").drop("n")

    per_pool = counts.groupBy("pool_id").agg(F.collect_list(F.struct("domain", "category", "n")).alias("counts"))
    per_persona = known.groupBy("persona_id").agg(F.collect_list(F.struct("category", "share", "least")).alias("shares"))
    state = targets.join(per_pool, "pool_id", "left").join(per_persona, "persona_id", "left").select("pool_id", "t_in", "t_off", "counts", "shares")

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                listed = {x["category"]: (float(x["share"]), int(x["least"])) for x in (r.shares if r.shares is not None else [])}
                available: dict[tuple[str, str], int] = {}
                for x in r.counts if r.counts is not None else []:
                    available[x["domain"], x["category"]] = int(x["n"])
                goals = {"in_domain": int(r.t_in), "off_topic": int(r.t_off)}
                quota = flow_quotas(goals, available, listed)
                total = sum(quota.values())
                for (d, c), n in available.items():
                    rows.append((r.pool_id, d, c, "quota", quota.get((d, c), 0), n, quota.get((d, c), 0)))
                for d, goal in goals.items():
                    rows.append((r.pool_id, d, "", "target", goal, sum(n for (e, _), n in available.items() if e == d), sum(n for (e, _), n in quota.items() if e == d)))
                for c, (share, least) in listed.items():
                    have = sum(n for (_, e), n in available.items() if e == c)
                    took = sum(n for (_, e), n in quota.items() if e == c)
                    rows.append((r.pool_id, c, "", "minimum", least, have, took))
                    rows.append((r.pool_id, c, "", "share", int(share * total + 0.5), have, took))
            yield pd.DataFrame(rows, columns=["pool_id", "stratum", "category", "kind", "wanted", "usable", "taken"])

    solved = materialise(state.mapInPandas(solve, "pool_id string, stratum string, category string, kind string, wanted bigint, usable bigint, taken bigint"), "quotas")
    quotas = solved.where("kind = 'quota'").select("pool_id", F.col("stratum").alias("domain"), "category", F.col("taken").alias("quota"))

    # Trim: records by ranges of their hash. Whole ranges below the quota are taken; only the range in which the quota
    # falls is ranked, so no task holds a stratum, however large its pool and target are.
    stratum = ["pool_id", "domain", "category"]
    merged = parts.withColumn("range", F.shiftright("rank_hash", 64 - RANGE_BITS))
    sizes = merged.groupBy(*stratum, "range").agg(F.count("*").alias("in_range"))
    before = sizes.withColumn("before", F.sum("in_range").over(W.Window.partitionBy(*stratum).orderBy("range")) - F.col("in_range")).join(quotas, stratum)
    wanted = before.where(F.col("before") < F.col("quota")).select(*stratum, "range", (F.col("quota") - F.col("before")).alias("left"), (F.col("before") + F.col("in_range") <= F.col("quota")).alias("whole"))
    near = merged.join(wanted, [*stratum, "range"])
    last = W.Window.partitionBy(*stratum, "range").orderBy("rank_hash", "custom_id")
    ranked = near.where("not whole").withColumn("rn", F.row_number().over(last)).where(F.col("rn") <= F.col("left")).drop("rn")
    sample = near.where("whole").unionByName(ranked)
    sample = sample.select("pool_id", F.col("custom_id").cast(sessions.schema["custom_id"].dataType).alias("custom_id"), "domain", F.nullif("category", F.lit(NONE)).alias("category"))
    met = F.when(F.col("kind") == "share", F.abs(F.col("taken") - F.col("wanted")) <= 1).otherwise(F.col("taken") >= F.col("wanted"))
    report = solved.where("kind <> 'quota'").select("pool_id", "stratum", "kind", "wanted", "usable", "taken", met.alias("met"), (F.col("usable") < F.col("wanted")).alias("exhausted"))
    return sample, report
