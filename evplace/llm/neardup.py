"""Near-duplicate records with small edits, by HyperMinHash banding.

A record is the bag of its words (repeats counted). The k-th repeat of a word is an
element of its own, so the Jaccard similarity of two sets of elements is exactly
the similarity of the two bags (sum of lesser counts over sum of greater counts).

1. Records of one bag are one class; all later steps see each class once, so a
   third of all rows being copies costs one row.
2. HyperMinHash: per hash function the least hash of a class's elements is stored
   as its leading-zero count and the next 10 bits: 2 bytes per bucket.
3. Each band is a set of ``rows`` registers; classes that agree on all of them are
   candidates. ``rows`` grows with the logarithm of the classes, so that classes
   that meet by chance grow less than with the square, and the number of bands
   follows from it: the least that misses a pair at the threshold with
   probability ``miss`` at most (``bands_for``). Band keys travel in columnar blocks,
   one per part of the key space, and are sorted part by part; keys that very many
   classes share are spread over tasks by a join instead (``hot``).
4. The similarity of a candidate is estimated from its sketch, corrected for
   registers that agree by chance; candidates more than four standard errors
   below the threshold are dropped. Bags are fetched for the rest only, which are
   verified on them.

Defined results: null texts count as empty; records without any word are similar
to nothing; a record id with several texts keeps all of them; rows sent again
count once; null ids are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .components import components

SLICE = 16_384  # classes whose band keys are in memory at once (their places must fit 16 bits)
PART_KEYS = 4_000_000  # band keys of one part of the key space


def bag_text(*columns: Column) -> Column:
    """The words of the joined columns, lower-cased and sorted, in one text."""
    joined = F.lower(F.concat_ws(" ", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]))
    return F.array_join(F.array_sort(F.regexp_extract_all(joined, F.lit(r"([\p{L}\p{N}]+)"))), " ")


def elements(bag: str) -> list[str]:
    """The elements of a bag: each word with the number of its repeat."""
    out, last, k = [], None, 0
    for word in bag.split(" "):
        k = k + 1 if word == last else 0
        last = word
        out.append(f"{word} {k}" if k else word)
    return out


def least_hashes(hashed: np.ndarray, xor: np.ndarray, mul: np.ndarray) -> np.ndarray:
    """Per hash function the least hash of one set; a very large set is folded block by block."""
    least = np.full(len(xor), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(hashed), 4096):
        least = np.minimum(least, ((hashed[at : at + 4096, None] ^ xor[None, :]) * mul[None, :]).min(axis=0))
    return least


def registers(least: np.ndarray) -> np.ndarray:
    """HyperMinHash registers: leading zeros of the least hash, and the 10 bits after its first one."""
    bits = np.frexp(least.astype(np.float64))[1].astype(np.uint32)  # bit length
    shifted = least.astype(np.uint64) << (np.uint64(33) - bits.astype(np.uint64))  # the first one falls out of 32 bits
    tail = ((shifted & np.uint64(0xFFFFFFFF)) >> np.uint64(22)).astype(np.uint16)
    return ((np.uint16(32) - bits.astype(np.uint16)) << np.uint16(10)) | tail


def signatures(bags: list[str], count: int, stream: int) -> tuple[np.ndarray, np.ndarray]:
    """Registers (one line per bag) and sizes. Streams have independent hash functions."""
    from xxhash import xxh3_64_intdigest as h64

    rng = np.random.Generator(np.random.PCG64(20240229 + stream))
    xor, mul = rng.integers(0, 2**32, count, np.uint32), rng.integers(0, 2**32, count, np.uint32) | np.uint32(1)
    reg, sizes = np.empty((len(bags), count), np.uint16), np.empty(len(bags), np.int64)
    for start in range(0, len(bags), 1024):
        part = bags[start : start + 1024]
        least = np.empty((len(part), count), np.uint32)
        for i, bag in enumerate(part):
            el = elements(bag)
            sizes[start + i] = len(el)
            least[i] = least_hashes(np.fromiter((h64(e) >> 32 for e in el), np.uint32, len(el)), xor, mul)
        reg[start : start + len(part)] = registers(least)
    return reg, sizes


def chance_agreement(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Probability that registers of two disjoint sets of n and m elements agree.

    Within one leading-zero count the hashes of the two minima are near uniform over
    2**10 cells, so it is the probability of equal counts divided by 2**10.
    """
    z = np.arange(0, 32)[:, None]
    upper, lower = 2.0**-z, 2.0 ** -(z + 1)
    p = (1 - lower) ** n - (1 - upper) ** n
    q = (1 - lower) ** m - (1 - upper) ** m
    return (p * q).sum(axis=0) / 1024


def miss_probability(threshold: float, rows: int, bands: int, count: int) -> float:
    """Probability that a pair at the threshold shares no band, over how many of ``count`` registers agree."""
    k = np.arange(count + 1)
    log = np.array([math.lgamma(count + 1) - math.lgamma(i + 1) - math.lgamma(count - i + 1) for i in k])
    weight = np.exp(log + k * math.log(threshold) + (count - k) * math.log1p(-threshold))
    agree = np.ones(count + 1)
    for i in range(rows):
        agree *= np.maximum(k - i, 0) / (count - i)
    return float((weight * (1 - agree) ** bands).sum())


def bands_for(threshold: float, rows: int, count: int, miss: float) -> int:
    """The least number of bands whose miss probability at the threshold is ``miss`` at most."""
    high = 1
    while miss_probability(threshold, rows, high, count) > miss:
        high *= 2
    low = high // 2
    while low + 1 < high:
        mid = (low + high) // 2
        low, high = (low, mid) if miss_probability(threshold, rows, mid, count) <= miss else (mid, high)
    return high


def rows_for(classes: int) -> int:
    """Registers per band: those with which classes of similarity a quarter would share a band with one other class at most."""
    return max(6, round(math.log(max(classes, 2)) / math.log(4)))


def banding(rows: int, bands: int, count: int) -> np.ndarray:
    """The registers of each band: different ones within a band, drawn evenly."""
    rng = np.random.Generator(np.random.PCG64(7))
    return np.argsort(rng.random((bands, count)), axis=1)[:, :rows]


def band_keys(reg: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """One 64-bit key per line of registers and band."""
    bands, rows = chosen.shape
    weight = np.random.Generator(np.random.PCG64(11)).integers(0, 2**64, (rows, bands), np.uint64) | np.uint64(1)
    key = np.broadcast_to((np.arange(bands, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F), (len(reg), bands)).copy()
    for j in range(rows):
        key += reg[:, chosen[:, j]].astype(np.uint64) * weight[j]
        key ^= key >> np.uint64(29)
        key *= np.uint64(0xFF51AFD7ED558CCD)
    return key ^ (key >> np.uint64(32))


def meet(keys: np.ndarray, ids: np.ndarray, hot: int, most: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(a, b, False): pairs of ids (lesser first) with equal keys, about ``most`` at a time, each once in its batch; and
    (id, key, True) of keys that more than ``hot`` ids share."""
    order = np.argsort(keys, kind="stable")
    keys, ids = keys[order], ids[order]
    start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    length = np.diff(np.r_[start, len(keys)])
    many = length > hot
    at_hot = np.repeat(start[many], length[many]) + (np.arange(length[many].sum()) - np.repeat(np.cumsum(length[many]) - length[many], length[many]))
    yield ids[at_hot], keys[at_hot].astype(np.int64), True
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []

    def batch() -> tuple[np.ndarray, np.ndarray, bool]:
        x, y = np.concatenate(a), np.concatenate(b)
        pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1)[x != y], axis=0)
        return pairs[:, 0], pairs[:, 1], False

    start, length = start[(length > 1) & ~many], length[(length > 1) & ~many]
    for gap in range(1, int(length.max()) if len(length) else 0):
        runs = length > gap
        start, length = start[runs], length[runs]
        first = np.repeat(start, length - gap) + (np.arange((length - gap).sum()) - np.repeat(np.cumsum(length - gap) - (length - gap), length - gap))
        a.append(ids[first])
        b.append(ids[first + gap])
        if sum(map(len, a)) >= most:
            yield batch()
            a, b = [], []
    if a:
        yield batch()


def blob_values(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of packed arrays in a row, and how many each row has."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    size = np.dtype(kind).itemsize
    return np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]].view(kind), np.diff(at) // size


def blobs(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """One packed array per pair of cuts, without copying row by row."""
    return pa.BinaryArray.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * values.itemsize).astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])


def near_duplicates(
    df: DataFrame,
    key: str,
    texts: list[str],
    threshold: float = 0.8,
    miss: float = 1e-3,
    rows: int | None = None,
    sketch: int = 64,
    hot: int = 1000,
) -> tuple[DataFrame, DataFrame]:
    """(members, links): member (record_id, class_id) and links between classes (a, b, similarity), a < b."""
    import xxhash  # noqa: F401  (needed on the executors; fail early)

    spark = df.sparkSession
    named = df.where(F.col(key).isNotNull()).select(F.col(key).alias("record_id"), bag_text(*[F.col(c) for c in texts]).alias("bag")).where("bag <> ''")
    named = materialise(named.select("record_id", F.unhex(F.md5("bag")).alias("class_id"), "bag"), "bags")
    members = materialise(named.select("record_id", "class_id").distinct(), "members")

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                reg, sizes = signatures(part.column(1).to_pylist(), sketch, 0)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sizes.astype(np.int32)), pa.array([r.tobytes() for r in reg], pa.binary())], ["class_id", "bag", "n", "sketch"])

    # The bag follows from its hash, so this is one row per class, without an aggregate of strings.
    classes = named.select("class_id", "bag").distinct().mapInArrow(sketched, "class_id binary, bag string, n int, sketch binary")
    classes = materialise(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    total = classes.count()
    rows = rows or rows_for(total)
    count = 64 * rows
    chosen = banding(rows, bands_for(threshold, rows, count, miss), count)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total * len(chosen) / PART_KEYS))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per run of ids and part of the key space: the first id, and key and offset of every band key."""
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                block = batch.slice(at, SLICE)
                ids = block.column(0).to_numpy()
                all_keys = band_keys(signatures(block.column(1).to_pylist(), count, 1)[0], chosen)
                breaks = np.r_[0, np.flatnonzero(np.diff(ids) != 1) + 1, len(ids)]
                for i, j in zip(breaks[:-1], breaks[1:]):
                    keys = all_keys[i:j].ravel()
                    part = (((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int32)
                    offset = np.repeat(np.arange(j - i, dtype=np.uint16), len(chosen))
                    order = np.argsort(part, kind="stable")
                    present, first = np.unique(part[order], return_index=True)
                    cuts = np.r_[first, len(order)]
                    yield pa.RecordBatch.from_arrays([pa.array(present), pa.array(np.full(len(present), ids[i])), blobs(keys[order].astype(np.uint32), cuts), blobs(offset[order], cuts)], ["part", "base", "keys", "offsets"])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of one part after another (its blocks come one after another); members of hot keys as they are."""

        def done(part: int, keys: list, ids: list) -> Iterator[pa.RecordBatch]:
            for a, b, is_hot in meet(np.concatenate(keys), np.concatenate(ids), hot):
                if len(a):
                    two = b | (np.int64(part) << np.int64(32)) if is_hot else b
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(two, pa.int64()), pa.array(np.full(len(a), is_hot))], ["a", "b", "is_hot"])

        now, keys, ids = -1, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(0).to_numpy()
            k, n = blob_values(batch.column(2), np.uint32)
            i = np.repeat(batch.column(1).to_numpy(), n) + blob_values(batch.column(3), np.uint16)[0].astype(np.int64)
            ends = np.cumsum(n)
            rows = np.r_[0, np.flatnonzero(np.diff(part)) + 1, len(part)]
            for lo, hi in zip(rows[:-1].tolist(), rows[1:].tolist()):
                if part[lo] != now:
                    if keys:
                        yield from done(now, keys, ids)
                    now, keys, ids = int(part[lo]), [], []
                span = slice(ends[lo] - n[lo], ends[hi - 1])
                keys.append(k[span].copy())
                ids.append(i[span])
        if keys:
            yield from done(now, keys, ids)

    blocks = classes.select("id", "bag").mapInArrow(keyed, "part int, base bigint, keys binary, offsets binary").repartition(parts, "part").sortWithinPartitions("part")
    found = materialise(blocks.mapInArrow(met, "a bigint, b bigint, is_hot boolean"), "met")
    spread = found.where("is_hot").select(F.col("a").alias("id"), F.col("b").alias("hot_key"))
    spread = spread.alias("x").join(spread.alias("y"), "hot_key").where("x.id < y.id").select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    pairs = found.where("not is_hot").select("a", "b").unionByName(spread).distinct()
    margin = 4 * (threshold * (1 - threshold) / sketch) ** 0.5

    def estimated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            u, v = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, sketch) for i in (2, 3))
            n, m = (batch.column(i).to_numpy().astype(float) for i in (4, 5))
            chance = chance_agreement(n, m)
            estimate = ((u == v).mean(axis=1) - chance) / (1 - chance)
            keep = pa.array(np.flatnonzero((estimate >= threshold - margin) & (np.minimum(n, m) >= np.maximum(n, m) * threshold)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], ["a", "b"])

    def side(name: str, *columns: str) -> DataFrame:
        return classes.select(F.col("id").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in columns])

    joined = pairs.join(side("a", "sketch", "n"), "a").join(side("b", "sketch", "n"), "b").select("a", "b", "sketch_a", "sketch_b", "n_a", "n_b")
    likely = materialise(joined.mapInArrow(estimated, "a bigint, b bigint"), "likely")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, exact = [], []
            for i, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                s, t = set(elements(x)), set(elements(y))
                shared = len(s & t)
                if shared >= threshold * (len(s) + len(t) - shared) - 1e-9:
                    keep.append(i)
                    exact.append(shared / (len(s) + len(t) - shared))
            take = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(exact, pa.float64())], ["a", "b", "similarity"])

    bags = likely.join(side("a", "class_id", "bag"), "a").join(side("b", "class_id", "bag"), "b").select("class_id_a", "class_id_b", "bag_a", "bag_b")
    links = bags.mapInArrow(verified, "a binary, b binary, similarity double")
    links = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity")
    return members, materialise(links, "verified")


def similar_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """All pairs of different record ids (record_id_a < record_id_b), copies included, with their similarity.

    The result grows with the square of a group of copies; ``duplicate_groups`` is the form for scale.
    """
    m1 = members.select(F.col("record_id").alias("r1"), F.col("class_id").alias("a"))
    m2 = members.select(F.col("record_id").alias("r2"), F.col("class_id").alias("b"))
    between = links.join(m1, "a").join(m2, "b").select("r1", "r2", "similarity")
    within = m1.join(m2, m1.a == m2.b).where("r1 < r2").select("r1", "r2", F.lit(1.0).alias("similarity"))
    both = between.where("r1 <> r2").unionByName(within)
    return both.groupBy(F.least("r1", "r2").alias("record_id_a"), F.greatest("r1", "r2").alias("record_id_b")).agg(F.max("similarity").alias("similarity"))


def duplicate_groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """One row per record id and text: its class, its group (connected classes), and its number of links.

    ``n_links`` counts the other records of the class and the records of every linked class.
    """
    sizes = members.groupBy("class_id").agg(F.count("*").alias("size"), F.min("record_id").alias("first_id"))
    sizes = materialise(sizes, "sizes")
    label = components(sizes.select(F.col("class_id").alias("node")), links)
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    linked = both.join(sizes.select(F.col("class_id").alias("b"), "size"), "b").groupBy(F.col("a").alias("class_id")).agg(F.sum("size").alias("linked"))
    named = label.join(sizes.select(F.col("class_id").alias("node"), "size", "first_id"), "node")
    group = named.groupBy("label").agg(F.min("first_id").alias("group_id"), F.sum("size").alias("group_size"))
    info = named.join(group, "label").join(linked.withColumnRenamed("class_id", "node"), "node", "left")
    info = info.select(F.col("node").alias("class_id"), "group_id", "group_size", (F.col("size") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    return members.join(info, "class_id").select("record_id", F.hex("class_id").alias("class_id"), "group_id", "group_size", "n_links")
