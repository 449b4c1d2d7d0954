"""Packing: nothing lost, nothing over capacity, close to the lower bound."""

import math
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from evplace.llm.packing import best_fit, pack_texts


@given(st.lists(st.integers(0, 50), max_size=200))
@settings(max_examples=100, deadline=None)
def test_best_fit(sizes):
    placed, fills = best_fit(sorted(sizes, reverse=True), 50)
    again = [0] * len(fills)
    for s, b in zip(sorted(sizes, reverse=True), placed):
        again[b] += s
    assert again == fills and all(f <= 50 for f in fills)
    assert sum(f * 2 <= 50 for f in fills) <= 1  # two half-empty containers would have been one


def check(rows, docs, limits):
    count = lambda t: len(re.findall(r"\w+|[^\w\s]+", t or ""))
    for name, cap in limits:
        mine = [r for r in rows if r["limit_name"] == name]
        fill, per = {}, {}
        for r in mine:
            fill[r["container_id"]] = fill.get(r["container_id"], 0) + r["n_tokens"]
            per.setdefault(r["doc_id"], []).append(r)
            assert r["first_token"] == r["piece"] * cap
        assert all(f <= cap for f in fill.values())
        assert all(fill[r["container_id"]] == r["container_tokens"] for r in mine)
        for d, t in docs:
            n = count(t)
            assert sum(r["n_tokens"] for r in per[d]) == n
            assert {r["n_pieces"] for r in per[d]} == {max(1, math.ceil(n / cap))} and len(per[d]) == max(1, math.ceil(n / cap))
        total = sum(fill.values())
        assert len([f for f in fill.values() if f]) <= math.ceil(total / cap) * 1.2 + 2


def test_pack_whole_tree(spark):
    docs = [(i, "a b, " * (i * 37 % 90)) for i in range(400)] + [(1000, None), (1001, ""), (1002, "w " * 5000), (1003, "x" * 100_000), (None, "a null id"), (2**62 + 1, "a large id")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    limits = [("s", 64), ("l", 300)]
    lf = spark.createDataFrame(limits + limits + [("null", None), ("zero", 0)], "limit_name string, capacity_tokens int")
    first = sorted(map(tuple, pack_texts(df, lf, group_items=40, fan_in=2).collect()), key=str)
    check(pack_texts(df, lf, group_items=40, fan_in=2).collect(), docs, limits)
    check(pack_texts(df, lf).collect(), docs, limits)
    # The layout of the input does not matter.
    assert first == sorted(map(tuple, pack_texts(df.repartition(7), lf, group_items=40, fan_in=2).collect()), key=str)


def test_an_id_that_holds_most_rows(spark):
    docs = [(7, "a b c")] * 900 + [(i, "x y") for i in range(100, 200)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = pack_texts(df, spark.createDataFrame([("s", 10)], "limit_name string, capacity_tokens int"), group_items=50, fan_in=3).collect()
    fill = {}
    for r in rows:
        fill[r["container_id"]] = fill.get(r["container_id"], 0) + r["n_tokens"]
    assert len(rows) == 1000 and max(fill.values()) <= 10 and sum(fill.values()) == 2900 and len(fill) <= 340


def containers(rows):
    fill = {}
    for r in rows:
        fill[r["container_id"]] = fill.get(r["container_id"], 0) + r["n_tokens"]
        assert r["container_tokens"] <= r["capacity_tokens"]
    return fill


def test_no_underfull_container_leaves_the_tree(spark):
    # 3,001 containers of two thirds after the first round, and small items that fill them up later.
    docs = [(i, "w " * 34) for i in range(6001)] + [(10_000 + i, "w " * 32) for i in range(3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    lf = spark.createDataFrame([("s", 100)], "limit_name string, capacity_tokens int")
    fill = containers(pack_texts(df, lf, group_items=300, fan_in=4).collect())
    assert sum(fill.values()) == 6001 * 34 + 3000 * 32 and len(fill) <= 3001 * 1.02
    # Only items of two thirds: nothing can be combined, every item is placed, and the rounds end.
    fill = containers(pack_texts(spark.createDataFrame([(i, "w " * 67) for i in range(2000)], "doc_id long, text string"), lf, group_items=100, fan_in=4).collect())
    assert len(fill) == 2000


def test_waste_is_small(spark):
    docs = [(i, "w " * (1 + i * 7919 % 61)) for i in range(5000)]
    total = sum(1 + i * 7919 % 61 for i in range(5000))
    lf = spark.createDataFrame([("s", 128)], "limit_name string, capacity_tokens int")
    fill = containers(pack_texts(spark.createDataFrame(docs, "doc_id long, text string"), lf, group_items=200, fan_in=4).collect())
    assert sum(fill.values()) == total and len(fill) <= math.ceil(total / 128) * 1.01 + 1


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, capacity int")
    lf = spark.createDataFrame([("s", 5)], "limit_name string, capacity_tokens int")
    assert pack_texts(df, lf).count() == 0
    assert pack_texts(spark.createDataFrame([(1, "a")], "doc_id long, text string"), lf.limit(0)).count() == 0
