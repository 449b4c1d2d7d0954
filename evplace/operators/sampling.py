"""Seeded sampling, splitting and allocation.

Every sampler takes the records with the least hash of seed and key within their stratum, so results do not depend
on row order, partitioning or engine. Row limits per stratum are window ranks. Spark prunes ranks before the shuffle only
against a constant, so a rank is first compared with the greatest limit of any stratum, then with its own.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.ids import hash_rank, hash_unit


def split_fifty_fifty(df: DataFrame, group: str, key: str, seed: int = 42) -> DataFrame:
    """Each group's members to memory or documents, halves that differ by at most one; a coin of the group decides the odd one."""
    w = W.Window.partitionBy(group)
    n = F.count("*").over(w)
    coin = F.conv(F.substring(hash_rank(seed, F.lit("coin"), F.col(group)), 1, 8), 16, 10).cast("long") % 2
    rank = F.row_number().over(w.orderBy(hash_rank(seed, F.col(group), F.col(key)), key))
    n_memory = F.floor(n / 2) + F.when((n % 2 == 1) & (coin == 0), 1).otherwise(0)
    return df.withColumn("side", F.when(rank <= n_memory, "memory").otherwise("document"))


def least_hashes(df: DataFrame, key: str, n: int, strata: Sequence[str] = (), seed: int = 42) -> DataFrame:
    """The n records of least hash, per stratum if any is given."""
    if not strata:
        return df.withColumn("__h", hash_rank(seed, F.col(key))).orderBy("__h", key).limit(n).drop("__h")
    w = W.Window.partitionBy(*strata).orderBy(hash_rank(seed, F.col(key)), key)
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def sample_and_rest(df: DataFrame, key: str, n: int, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    chosen = least_hashes(df, key, n, seed=seed)
    return chosen, df.join(chosen.select(key), key, "left_anti")


def largest_remainder(weights: DataFrame, total: int, weight: str = "weight", order: str = "place", groups: Sequence[str] = ()) -> DataFrame:
    """Shares of ``total`` in whole numbers: floors, then one more by fraction, ties in input order. Sums exactly."""
    w = W.Window.partitionBy(*groups) if groups else W.Window.partitionBy(F.lit(1))
    raw = F.lit(total) * F.col(weight) / F.sum(weight).over(w)
    out = weights.withColumn("__raw", F.round(raw, 9)).withColumn("__base", F.floor("__raw"))
    left = F.lit(total) - F.sum("__base").over(w)
    rank = F.row_number().over(w.orderBy(F.desc(F.round(F.col("__raw") - F.col("__base"), 9)), order))
    return out.withColumn("n", (F.col("__base") + F.when(rank <= left, 1).otherwise(0)).cast("long")).drop("__raw", "__base")


def _most(sizes: DataFrame, column: str | Column) -> int:
    """The greatest limit of any stratum: one number, against which ranks are pruned before the shuffle."""
    return sizes.agg(F.max(column)).first()[0] or 0


def stratified(df: DataFrame, stratum: str, key: str, sizes: DataFrame, seed: int = 42) -> DataFrame:
    """Exact sizes per stratum (``sizes``: stratum, n); an error if one has too few."""
    short = sizes.join(df.groupBy(stratum).count(), stratum, "left").where(F.coalesce("count", F.lit(0)) < F.col("n")).head()
    if short is not None:
        raise ValueError(f"stratum too small: {short.asDict()}")
    w = W.Window.partitionBy(stratum).orderBy(hash_rank(seed, F.col(key)), key)
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= _most(sizes, "n")).join(sizes, stratum).where(F.col("__r") <= F.col("n")).drop("__r", "n")


def coverage_reserve(df: DataFrame, key: str, covariates: Sequence[str], total: int, minimum: int, seed: int = 42) -> DataFrame:
    """Keys reserved so that rare levels are met: all of a level below the minimum, else what its expected share lacks."""
    pool = df.count()
    long = df.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("covariate"), F.col(c).cast("string").alias("level")) for c in covariates])).alias("x")).select(key, "x.covariate", "x.level").where("level is not null")
    size = long.groupBy("covariate", "level").agg(F.count("*").alias("size"))
    expected = F.col("size") / F.lit(max(pool, 1)) * F.lit(total)
    need = F.when(F.col("size") < minimum, F.col("size")).when(expected < minimum, F.lit(minimum) - F.floor(expected)).otherwise(0)
    w = W.Window.partitionBy("covariate", "level").orderBy(hash_rank(seed, F.col(key)), key)
    # A level needs the minimum at most.
    ranked = long.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= minimum).join(size.select("covariate", "level", need.alias("need")).where("need > 0"), ["covariate", "level"])
    return ranked.where(F.col("__r") <= F.col("need")).select(key).distinct()


def coverage_sample(df: DataFrame, key: str, stratum: str, sizes: DataFrame, covariates: Sequence[str], minimum: int, seed: int = 42) -> DataFrame:
    """Per stratum its size: reserved records first, then the rest, each by least hash."""
    total = sizes.agg(F.sum("n")).first()[0] or 0
    kept = coverage_reserve(df, key, covariates, total, minimum, seed).withColumn("reserved", F.lit(1))
    rows = df.join(kept, key, "left").withColumn("reserved", F.coalesce("reserved", F.lit(0)))
    w = W.Window.partitionBy(stratum).orderBy(F.desc("reserved"), hash_rank(seed, F.col(key)), key)
    return rows.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= _most(sizes, "n")).join(sizes, stratum).where(F.col("__r") <= F.col("n")).drop("__r", "n")


def tiered_fill(df: DataFrame, groups: Sequence[str], key: str, evidence: str, tier: Column, needed: Column, seed: int = 42) -> DataFrame:
    """Fill from tier 1, then tier 2, ..., by least hash, never taking one piece of evidence twice in a group."""
    h = hash_rank(seed, F.col(key))
    rows = df.withColumns({"__t": tier, "__h": h, "__need": needed})
    once = rows.withColumn("__e", F.row_number().over(W.Window.partitionBy(*groups, evidence).orderBy("__t", "__h", key))).where("__e = 1")
    w = W.Window.partitionBy(*groups).orderBy("__t", "__h", key)
    return once.withColumn("place", F.row_number().over(w)).where(F.col("place") <= _most(df, needed)).where(F.col("place") <= F.col("__need")).withColumnRenamed("__t", "tier").drop("__h", "__need", "__e")


def smoke_subset(df: DataFrame, key: str, kind: str, seed: int = 42) -> DataFrame:
    """The first null query, the first temporal query, and one other record by hash."""
    role = F.when(F.col(kind) == "null_query", "null_query").when(F.col(kind) == "temporal_query", "temporal_query").otherwise("other")
    order = F.when(role == "other", hash_rank(seed, F.col(key))).otherwise(F.lpad(F.col(key).cast("string"), 20, "0"))
    rows = df.withColumns({"role": role, "__o": order})
    return rows.withColumn("__r", F.row_number().over(W.Window.partitionBy("role").orderBy("__o", key))).where("__r = 1").drop("__r", "__o")


# The turn ranges and topic drifts, and per persona the weights of categories, of turn ranges, and of
# topic drift at each turn range.
TURN_RANGES = ["4-4", "4-6", "6-10", "8-10"]
TOPIC_DRIFTS = ["tight", "moderate", "wide"]
PROFILES = {
    "persona_1": {
        "categories": {"professional": 0.55, "casual": 0.30, "transactional": 0.15},
        "turns": [0.15, 0.30, 0.35, 0.20],
        "drift": [[0.80, 0.15, 0.05], [0.70, 0.22, 0.08], [0.45, 0.42, 0.13], [0.40, 0.45, 0.15]],
    },
    "persona_2": {
        "categories": {"professional": 0.50, "casual": 0.32, "transactional": 0.18},
        "turns": [0.20, 0.30, 0.30, 0.20],
        "drift": [[0.82, 0.14, 0.04], [0.72, 0.20, 0.08], [0.48, 0.40, 0.12], [0.42, 0.44, 0.14]],
    },
    "persona_3": {
        "categories": {"professional": 0.30, "casual": 0.50, "transactional": 0.20},
        "turns": [0.30, 0.30, 0.25, 0.15],
        "drift": [[0.75, 0.18, 0.07], [0.65, 0.25, 0.10], [0.42, 0.42, 0.16], [0.38, 0.44, 0.18]],
    },
}
TRANSACTIONAL = {"turns": [0.55, 0.45], "drift": [0.78, 0.22]}  # fixed values: over the first two turn ranges and drifts
# For a persona without profile. Categories count their scenarios, of which one is drawn evenly.
SCENARIOS = {"professional": 6, "casual": 6, "transactional": 3}
GLOBAL = {"categories": SCENARIOS, "turns": [0.35, 0.25, 0.25, 0.15], "drift": [[0.88, 0.10, 0.02], [0.78, 0.18, 0.04], [0.5, 0.4, 0.1], [0.45, 0.45, 0.1]]}
PLACEMENTS = ["early", "middle", "late"]
DENSITIES = ["single_message", "multi_message"]
N_MESSAGES = 10  # fixed value: wordings of the request


def drift_weights(profile: dict) -> dict[str, float]:
    """Topic-drift weights of a profile, averaged over its turn ranges."""
    raw = [sum(w * d[j] for w, d in zip(profile["turns"], profile["drift"])) for j in range(len(TOPIC_DRIFTS))]
    return {name: x / sum(raw) for name, x in zip(TOPIC_DRIFTS, raw)}


def weighted_pick(unit: Column, names: Sequence[str], weights: Sequence[float]) -> Column:
    """The name whose share of [0, 1) holds the number."""
    total, upper, out = sum(weights), 0.0, None
    for name, weight in zip(names, weights):
        upper += weight / total
        out = F.when(unit < upper, name) if out is None else out.when(unit < upper, name)
    return out.otherwise(names[-1])


def diversity_draw(df: DataFrame, key: str, persona: str, seed: int = 42) -> DataFrame:
    """Category, scenario, turn range, topic drift, placement, density and wording of each request, drawn by its persona's weights.

    Each draw has its own hash, so none depends on the order of rows. Transactional sessions draw from the two shortest
    turn ranges and the two narrowest drifts, with early evidence. A persona without profile draws by the global weights.
    """
    unit = lambda name: hash_unit(seed, F.lit(name), F.col(key), F.col(persona))

    def by_persona(pick) -> Column:
        out = None
        for name, profile in PROFILES.items():
            out = F.when(F.col(persona) == name, pick(profile)) if out is None else out.when(F.col(persona) == name, pick(profile))
        return out.otherwise(pick(GLOBAL))

    rows = df.withColumn("category", by_persona(lambda p: weighted_pick(unit("category"), list(p["categories"]), list(p["categories"].values()))))
    short = F.col("category") == "transactional"
    rows = rows.withColumn("turns", F.when(short, weighted_pick(unit("turns"), TURN_RANGES[:2], TRANSACTIONAL["turns"])).otherwise(by_persona(lambda p: weighted_pick(unit("turns"), TURN_RANGES, p["turns"]))))

    def drift(profile: dict) -> Column:
        out = None
        for name, weights in zip(TURN_RANGES, profile["drift"]):
            pick = weighted_pick(unit("drift"), TOPIC_DRIFTS, weights)
            out = F.when(F.col("turns") == name, pick) if out is None else out.when(F.col("turns") == name, pick)
        return out

    rows = rows.withColumn("drift", F.when(short, weighted_pick(unit("drift"), TOPIC_DRIFTS[:2], TRANSACTIONAL["drift"])).otherwise(by_persona(drift)))
    each = F.create_map(*[F.lit(x) for kv in SCENARIOS.items() for x in kv])[F.col("category")]
    return rows.withColumns(
        {
            "scenario_no": (F.floor(unit("scenario") * each) + 1).cast("int"),
            "placement": F.when(short, PLACEMENTS[0]).otherwise(weighted_pick(unit("placement"), PLACEMENTS, [1.0] * len(PLACEMENTS))),
            "density": weighted_pick(unit("density"), DENSITIES, [1.0] * len(DENSITIES)),
            "message_no": (F.floor(unit("message") * N_MESSAGES) + 1).cast("int"),
        }
    )


def _allocate(n: int, weights: list[float]) -> list[int]:
    total = sum(weights)
    if not total:
        return [0] * len(weights)
    raw = [n * w / total for w in weights]
    out = [int(x) for x in raw]
    for i in sorted(range(len(raw)), key=lambda i: (out[i] - raw[i], i))[: n - sum(out)]:
        out[i] += 1
    return out


def diversity_sample(df: DataFrame, group: str, key: str, levels: Sequence[str], n: int, weights: dict | None = None, seed: int = 42) -> DataFrame:
    """n records per group, spread over nested levels by largest remainder, with fallback where a bin is empty.

    ``weights`` gives, per group and level, the weight of each label; without it the labels of a level share evenly.

    Each bin (group x levels) first keeps its n least hashes, so a task gets at most n records per bin whatever the
    size of the group; the stateful allocation then runs per group.
    """
    bins = [F.coalesce(F.lower(F.trim(F.col(c).cast("string"))), F.lit("")).alias(f"__l{i}") for i, c in enumerate(levels)]
    rows = df.select("*", *bins, hash_rank(seed, F.col(key)).alias("__h"))
    names = [f"__l{i}" for i in range(len(levels))]
    w = W.Window.partitionBy(group, *names).orderBy("__h", key)
    small = rows.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).select(group, key, *names, "__h")

    def take(pdf: pd.DataFrame, want: int, depth: int) -> pd.DataFrame:
        if want <= 0 or pdf.empty:
            return pdf.iloc[:0]
        if depth == len(names):
            return pdf.head(want)
        parts = list(pdf.groupby(names[depth], sort=True))
        shares = (weights or {}).get(pdf[group].iloc[0], {}).get(levels[depth])
        each = [shares.get(label, 0.0) if shares else 1.0 for label, _ in parts]
        got = [take(p, q, depth + 1) for (_, p), q in zip(parts, _allocate(want, each))]
        chosen = pd.concat(got)
        if len(chosen) < want:  # a bin was short: fill from what is left, by hash
            chosen = pd.concat([chosen, pdf.drop(chosen.index).head(want - len(chosen))])
        return chosen

    def sample(pdf: pd.DataFrame) -> pd.DataFrame:
        ordered = pdf.sort_values(["__h", key], kind="stable").reset_index(drop=True)
        return take(ordered, n, 0)[[group, key]]

    types = f"{group} {df.schema[group].dataType.simpleString()}, {key} {df.schema[key].dataType.simpleString()}"
    return small.groupBy(group).applyInPandas(sample, types)


def spread_over_levels(rows: list, n: int, weights: Sequence[dict[str, float]], used: set) -> list:
    """Up to n rows (key, evidence, label per level), in order, spread by the weights of each level and topped up in order.

    A label without rows left gives its share to the rows of the level above. No evidence in ``used`` is taken; what is taken is added.
    """
    chosen: list = []
    keys: set = set()
    free = lambda r: r[0] not in keys and (r[1] is None or r[1] not in used)

    def pick(pool: list, want: int) -> None:
        for r in pool:
            if want <= 0:
                return
            if free(r):
                want -= 1
                chosen.append(r)
                keys.add(r[0])
                if r[1] is not None:
                    used.add(r[1])

    def take(pool: list, want: int, depth: int) -> None:
        if depth == len(weights):
            pick(pool, want)
            return
        for label, share in zip(weights[depth], _allocate(want, list(weights[depth].values()))):
            left = [r for r in pool if r[2 + depth] == label and free(r)] if share else []
            if not left and depth and share:
                left = [r for r in pool if free(r)]
            if left:
                take(left, min(share, len(left)), depth + 1)

    if sum(map(free, rows)) > n:
        take(rows, n, 0)
    pick(rows, n - len(chosen))
    return chosen


def corpus_fill(df: DataFrame, group: str, persona: str, side: str, key: str, evidence: str, tier: Column, needed: dict[bool, int], levels: Sequence[str], weights: dict[str, Sequence[dict[str, float]]], even: Sequence[dict[str, float]], seed: int = 42) -> DataFrame:
    """Per group and side its number of records (false before true): tier 1 by least hash, then tier 2 spread over the levels.

    No piece of evidence is taken twice in a group. A group takes at most ``total`` records, so the least ``total`` hashes
    with different evidence per bin hold every possible choice; a task gets no more, whatever the size of the group.
    """
    total = sum(needed.values())
    names = [f"__l{i}" for i in range(len(levels))]
    rows = df.select("*", tier.alias("tier"), hash_rank(seed, F.col(key)).alias("__h"))
    rows = rows.select("*", *[F.when(F.col("tier") > 1, F.coalesce(F.lower(F.trim(F.col(c).cast("string"))), F.lit(""))).otherwise("").alias(n) for c, n in zip(levels, names)])
    strata = [group, side, "tier", *names]
    once = rows.withColumn("__e", F.row_number().over(W.Window.partitionBy(*strata, F.coalesce(F.col(evidence), F.concat(F.lit("\0"), F.col(key)))).orderBy("__h", key))).where("__e = 1")
    small = once.withColumn("__r", F.row_number().over(W.Window.partitionBy(*strata).orderBy("__h", key))).where(F.col("__r") <= total)
    small = small.select(group, persona, side, key, evidence, "tier", "__h", *names)

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["__h", key], kind="stable")
        by_level = weights.get(pdf[persona].iloc[0], even)
        used: set = set()
        out = []
        for flag in sorted(needed):
            left = needed[flag]
            for t in (1, 2):
                part = pdf[(pdf[side] == flag) & (pdf["tier"] == t)]
                ordered = [(r[0], None if pd.isna(r[1]) else r[1], *r[2:]) for r in part[[key, evidence, *names]].itertuples(index=False, name=None)]
                got = spread_over_levels(ordered, left, by_level if t > 1 else (), used)
                left -= len(got)
                out += [(pdf[group].iloc[0], r[0], t) for r in got]
        return pd.DataFrame(out, columns=[group, key, "tier"])

    types = f"{group} {df.schema[group].dataType.simpleString()}, {key} {df.schema[key].dataType.simpleString()}, tier int"
    return small.groupBy(group).applyInPandas(fill, types)


def session_times(df: DataFrame, key: str, published: Column, start: str, end: str, hours: tuple[int, int] = (8, 22), mean_days: float = 14.0, seed: int = 42) -> DataFrame:
    """A time in the window for each record, not before its publication, within the hours of the day.

    The delay after publication is exponential, cut off at the end of the window (inverse distribution, no rejection).
    """
    u, v = hash_unit(seed, F.lit("delay"), F.col(key)), hash_unit(seed, F.lit("second"), F.col(key))
    first = F.greatest(F.coalesce(F.to_date(published), F.lit(start).cast("date")), F.lit(start).cast("date"))
    span = F.datediff(F.lit(end).cast("date"), first)
    delay = F.floor(-F.lit(mean_days) * F.ln(1 - u * (1 - F.exp(-span / mean_days)))).cast("int")
    day = F.date_add(first, F.greatest(F.lit(0), F.least(delay, span)))
    seconds = F.floor(v * ((hours[1] - hours[0] + 1) * 3600)).cast("long") + hours[0] * 3600
    return df.withColumn("session_time", F.timestamp_seconds(F.unix_date(day).cast("long") * 86400 + seconds).cast("timestamp_ntz"))


def cyclic_block_design(blocks: DataFrame, block: str, cells: Sequence[tuple[str, str]], per_block: int) -> DataFrame:
    """``per_block`` of the cells for each block, shifted by the block's number: every cell is used equally often."""
    n = len(cells)
    table = F.array(*[F.struct(F.lit(a).alias("dist"), F.lit(b).alias("agent")) for a, b in cells])
    step = max(1, n // per_block)
    picks = F.transform(F.sequence(F.lit(0), F.lit(per_block - 1)), lambda i: F.get(table, ((F.col(block) + i * step) % n).cast("int")))
    return blocks.select(block, F.explode(picks).alias("c")).select(block, "c.dist", "c.agent")
