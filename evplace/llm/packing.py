"""Texts into containers of fixed capacity, by hierarchical residual packing.

Sizes are counted in the JVM; texts never leave the scan. Items are spread over
groups of about ``group_items`` by a hash of their id (so the result depends on
the data alone, not on how files were split), and each group is packed best-fit,
largest first. Containers filled to ``full_share`` are final. All others become
items of a coarser group (``fan_in`` groups each) and are packed again, up a tree,
until one group is left. Only ids and sizes move.

What a task holds is bounded by splitting, never by ending the merge: a group with
more than ``2 * group_items`` items is cut into parts by a hash that is drawn anew
each round, and if the last group still has several parts, rounds go on until one
combines nothing. After best fit at most one container of a part is half empty or
more, so few containers can still be combined and the rounds end soon.

A text longer than the capacity is cut into full pieces, each a container of its
own, and a rest that is packed like any item. No other text is ever split.

Defined results: null and blank texts are items of size 0 and are placed like all
others; equal sizes go by id, then piece; limits that are null or not positive are
left out; repeated limit rows count once; repeated documents are each placed.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise

#: The public word-punctuation tokenizer: word runs and runs of other non-blank characters.
WORD_PUNCTUATION = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}\x85\x1c-\x1f]+"


def token_count(text: Column) -> Column:
    """Tokens of the word-punctuation tokenizer, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PUNCTUATION)), F.lit(0)).cast("long")


def best_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Container number of each item, taken in order, and the fill of each container."""
    fills: list[int] = []
    free: dict[int, list[int]] = {}
    keys: list[int] = []
    placed = []
    for size in sizes:
        k = bisect_left(keys, size)
        if k == len(keys):
            no = len(fills)
            fills.append(0)
        else:
            left = keys[k]
            no = free[left].pop()
            if not free[left]:
                del free[left], keys[k]
        fills[no] += size
        placed.append(no)
        left = capacity - fills[no]
        if left not in free:
            free[left] = []
            insort(keys, left)
        free[left].append(no)
    return placed, fills


def merge_round(level: int, full_share: float):
    """The function that packs the containers of one part of round ``level``."""

    def merge(group: pa.Table) -> pa.Table:
        group = group.sort_by([("fill", "descending"), ("container_id", "ascending")])
        capacity, no, part = (group[c][0].as_py() for c in ("capacity", "grp", "part"))
        placed, fills = best_fit(group["fill"].to_pylist(), capacity)
        members = [0] * len(fills)
        for x in placed:
            members[x] += 1
        made = [
            pa.array([f"{level}.{no}.{part}.{x}" for x in placed], pa.string()),
            pa.array([fills[x] for x in placed], pa.int64()),
            group["grp"],
            pa.array([members[x] > 1 for x in placed], pa.bool_()),
            pa.array([fills[x] < capacity * full_share for x in placed], pa.bool_()),
        ]
        return pa.Table.from_arrays([group["limit_name"], group["capacity"], group["container_id"], *made], ["limit_name", "capacity", "child", "container_id", "fill", "grp", "combined", "open"])

    return merge


def in_parts(df: DataFrame, most: int, salt: Column) -> DataFrame:
    """``df`` with the part of its (limit_name, grp): groups of more than ``most`` rows are cut by the salt."""
    parts = df.groupBy("limit_name", "grp").agg(F.ceil(F.count("*") / most).alias("parts")).where("parts > 1")
    out = df.join(parts, ["limit_name", "grp"], "left")
    return out.withColumn("part", F.when(F.col("parts") > 1, F.pmod(salt, F.col("parts"))).otherwise(F.lit(0)).cast("long")).drop("parts")


def pack_texts(
    docs: DataFrame,
    limits: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    group_items: int = 20_000,
    fan_in: int = 8,
    full_share: float = 0.98,
) -> DataFrame:
    """The contents of every container, one row per text or piece of a text.

    Columns: limit_name, capacity_tokens, container_id, container_tokens, doc_id,
    piece (from 0), n_pieces, first_token (from 0), n_tokens.
    """
    # The limits are parameters, not data: a handful of names and capacities.
    pairs = sorted({(r[0], int(r[1])) for r in limits.select("limit_name", "capacity_tokens").where("limit_name is not null and capacity_tokens > 0").distinct().limit(1001).collect()})
    if len(pairs) > 1000:
        raise ValueError("more than 1000 capacities")
    doc_type = docs.schema[doc_id].dataType.simpleString()
    sized = materialise(docs.select(F.col(doc_id).alias("doc_id"), token_count(F.col(text)).alias("tokens"), F.monotonically_increasing_id().alias("place")), "sizes")
    groups = max(1, math.ceil(sized.count() / group_items))
    every = F.array(*[F.struct(F.lit(n).alias("limit_name"), F.lit(c).cast("long").alias("capacity")) for n, c in pairs]) if pairs else F.expr("cast(array() as array<struct<limit_name:string,capacity:bigint>>)")
    items = sized.select("doc_id", "tokens", "place", F.explode(every).alias("l")).select("doc_id", "tokens", "place", "l.limit_name", "l.capacity")
    over = F.col("tokens") > F.col("capacity")
    full = F.when(over, F.floor(F.col("tokens") / F.col("capacity"))).otherwise(F.lit(0)).cast("int")
    rest = F.col("tokens") - full * F.col("capacity")
    items = items.withColumns({"n_full": full, "rest": rest.cast("long")})
    items = items.withColumn("n_pieces", F.col("n_full") + F.when((F.col("rest") > 0) | (F.col("n_full") == 0), 1).otherwise(0))

    whole = items.where("n_full > 0").select("limit_name", "capacity", "doc_id", F.explode(F.sequence(F.lit(0), F.col("n_full") - 1)).alias("piece"), "n_pieces", F.col("capacity").alias("n_tokens"))
    whole = whole.withColumns({"container_id": F.concat_ws(".", F.lit("f"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "piece"), "fill": F.col("capacity"), "level": F.lit(-1), "grp": F.lit(0).cast("long")})
    loose = items.where("n_pieces > n_full").select("limit_name", "capacity", "doc_id", F.col("n_full").alias("piece"), "n_pieces", F.col("rest").alias("n_tokens"), F.expr(f"pmod(xxhash64(doc_id), {groups})").alias("grp"), "place")
    # An id that repeats over and over would fill its group; such a group is cut into parts of bounded size.
    loose = in_parts(loose, 2 * group_items, F.col("place")).drop("place")

    order = ["limit_name", "capacity", "doc_id", "piece", "n_pieces", "n_tokens", "container_id", "fill", "level", "grp"]

    def pack_group(group: pa.Table) -> pa.Table:
        group = group.sort_by([("n_tokens", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        placed, fills = best_fit(group["n_tokens"].to_pylist(), group["capacity"][0].as_py())
        no, part = group["grp"][0].as_py(), group["part"][0].as_py()
        made = {"container_id": pa.array([f"0.{no}.{part}.{x}" for x in placed], pa.string()), "fill": pa.array([fills[x] for x in placed], pa.int64()), "level": pa.array([0] * len(placed), pa.int32())}
        for name, column in made.items():
            group = group.append_column(name, column)
        return group.select(order)

    schema0 = f"limit_name string, capacity bigint, doc_id {doc_type}, piece int, n_pieces int, n_tokens bigint, container_id string, fill bigint, level int, grp bigint"
    contents = materialise(loose.groupBy("limit_name", "grp", "part").applyInArrow(pack_group, schema0).unionByName(whole.select(*order)), "contents")

    # The tree: underfull containers are the items of the next round.
    fresh = contents.where((F.col("level") == 0) & (F.col("fill") < F.col("capacity") * full_share)).select("limit_name", "capacity", "container_id", "fill", "grp").distinct()
    schema = "limit_name string, capacity bigint, child string, container_id string, fill bigint, grp bigint, combined boolean, open boolean"
    chain: DataFrame | None = None
    level, again = 0, groups > 1
    while again:
        level += 1
        crowded = groups <= fan_in and fresh.groupBy("limit_name").count().where(F.col("count") > 2 * group_items).head() is not None
        groups = math.ceil(groups / fan_in)
        step = in_parts(fresh.withColumn("grp", F.floor(F.col("grp") / fan_in).cast("long")), 2 * group_items, F.xxhash64(F.lit(level), "container_id"))
        moved = materialise(step.groupBy("limit_name", "grp", "part").applyInArrow(merge_round(level, full_share), schema), f"round{level}")
        link = moved.select("limit_name", "child", F.col("container_id").alias("parent"), F.col("fill").alias("parent_fill"))
        if chain is None:
            chain = link
        else:
            up = link.select("limit_name", F.col("child").alias("parent"), F.col("parent").alias("p2"), F.col("parent_fill").alias("f2"))
            chain = materialise(
                chain.join(up, ["limit_name", "parent"], "left").select("limit_name", "child", F.coalesce("p2", "parent").alias("parent"), F.coalesce("f2", "parent_fill").alias("parent_fill")),
                f"chain{level}",
            )
        fresh = moved.where("open").select("limit_name", "capacity", "container_id", "fill", "grp").distinct()
        # The root is one group; only if it had several parts, another round may combine what they kept.
        again = groups > 1 or (crowded and not moved.where("combined").isEmpty())
    if chain is not None:
        contents = contents.join(chain.withColumnRenamed("child", "container_id"), ["limit_name", "container_id"], "left")
        contents = contents.withColumns({"container_id": F.coalesce("parent", "container_id"), "fill": F.coalesce("parent_fill", "fill")})
    return contents.select(
        "limit_name",
        F.col("capacity").cast("int").alias("capacity_tokens"),
        "container_id",
        F.col("fill").alias("container_tokens"),
        "doc_id",
        "piece",
        "n_pieces",
        (F.col("piece") * F.col("capacity")).alias("first_token"),
        "n_tokens",
    )
