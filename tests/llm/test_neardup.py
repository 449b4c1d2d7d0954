"""Near duplicates against all pairs, on a small collection."""

import random
import re
from collections import Counter

import numpy as np

from evplace.llm.components import components
from evplace.llm.neardup import banding, bands_for, blob_values, blobs, chance_agreement, duplicate_groups, elements, meet, miss_probability, near_duplicates, rows_for, signatures, similar_pairs


def bag(*texts):
    return Counter(re.findall(r"[^\W_]+", " ".join(t or "" for t in texts).lower()))


def sim(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def data():
    rng = random.Random(5)
    vocab = [f"word{i}" for i in range(400)]
    rows = []
    for i in range(60):
        w = [rng.choice(vocab) for _ in range(rng.randint(6, 30))]
        rows.append((f"e{i:03}", " ".join(w[:4]), " ".join(w[4:])))
        for k in range(rng.randint(0, 3)):
            x = list(w)
            for _ in range(rng.randint(0, max(1, len(w) // 6))):
                x[rng.randrange(len(x))] = rng.choice(vocab)
            rng.shuffle(x)
            rows.append((f"e{i:03}v{k}", " ".join(x[:4]).upper(), "; ".join(x[4:])))
    copies = [(f"c{i:03}", "Same Title", "the very same fact again and again") for i in range(30)]
    return rows + copies + [("n1", None, None), ("n2", "", "..."), (None, "a b c", "d"), ("n3", "x " * 30_000, None), ("n4", None, "x " * 30_001)] + rows[:5]


def test_pairs_equal_brute_force(spark):
    rows = data()
    df = spark.createDataFrame([(*r, "clash") for r in rows], "id string, title string, fact string, class_id string")
    for t in (0.7, 0.8):
        members, links = near_duplicates(df, "id", ["title", "fact"], t)
        got = {(r[0], r[1]) for r in similar_pairs(members, links).select("record_id_a", "record_id_b").collect()}
        kept = sorted({r for r in rows if r[0]}, key=str)
        bags = [(r[0], bag(r[1], r[2])) for r in kept]
        want = {(min(a, b), max(a, b)) for i, (a, x) in enumerate(bags) for b, y in bags[i + 1 :] if a != b and x and y and sim(x, y) >= t}
        assert got == want and len(want) > 400


def test_groups(spark):
    df = spark.createDataFrame(data(), "id string, title string, fact string")
    members, links = near_duplicates(df, "id", ["title", "fact"], 0.7)
    pairs = similar_pairs(members, links).collect()
    partners = Counter(x for r in pairs for x in (r[0], r[1]))
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for r in pairs:
        a, b = sorted((find(r[0]), find(r[1])))
        parent[b] = a
    out = duplicate_groups(members, links).collect()
    assert len(out) == len({r["record_id"] for r in out})
    for r in out:
        assert r["n_links"] == partners[r["record_id"]] and r["group_id"] == find(r["record_id"])


def test_estimate_is_close():
    rng = random.Random(1)
    for j in (0.0, 0.3, 0.7, 0.9):
        errors = []
        for _ in range(12):
            n = 100
            shared = round(2 * n * j / (1 + j))
            words = rng.sample(range(10**9), 2 * n - shared)
            reg, sizes = signatures([" ".join(map(str, words[:n])), " ".join(map(str, words[n - shared :]))], 600, 0)
            assert sizes.tolist() == [n, n]
            chance = chance_agreement(np.array([n]), np.array([n]))[0]
            errors.append(((reg[0] == reg[1]).mean() - chance) / (1 - chance) - shared / (2 * n - shared))
        assert abs(np.mean(errors)) < 0.02


def test_bands_keep_their_promise():
    for rows in (6, 8, 10):
        count = 64 * rows
        bands = bands_for(0.7, rows, count, 1e-3)
        assert miss_probability(0.7, rows, bands, count) <= 1e-3 < miss_probability(0.7, rows, bands - 1, count)
        assert miss_probability(0.8, rows, bands, count) < 1e-6
    assert rows_for(10**5) < rows_for(10**7) < rows_for(10**9)
    # Seen: pairs that agree on 70 % of the registers share a band about as often as promised.
    rng = np.random.default_rng(3)
    chosen = banding(6, bands_for(0.7, 6, 384, 0.02), 384)
    agree = rng.random((3000, 384)) < 0.7
    missed = 1 - agree[:, chosen].all(axis=2).any(axis=1).mean()
    assert missed < 0.035


def test_meet_against_brute_force():
    rng = np.random.default_rng(2)
    keys, ids = rng.integers(0, 60, 400).astype(np.uint32), rng.integers(0, 150, 400)
    keys[:90] = 7
    want = {(min(x, y), max(x, y)) for k in set(keys.tolist()) - {7} for i, x in enumerate(ids[keys == k].tolist()) for y in ids[keys == k].tolist()[i + 1 :] if x != y}
    for most in (10**6, 20):  # all pairs at once, and few at a time
        out = list(meet(keys, ids, 50, most))
        got = [(x, y) for a, b, is_hot in out if not is_hot for x, y in zip(a.tolist(), b.tolist())]
        assert set(got) == want and (len(got) == len(want) or most == 20)
        (hot_ids, hot_keys, _), *_ = [x for x in out if x[2]]
        assert set(hot_keys.tolist()) == {7} and sorted(hot_ids.tolist()) == sorted(ids[keys == 7].tolist())
    assert all(len(a) == 0 for a, _, _ in meet(keys[:0], ids[:0], 50))
    # Packed arrays and back, also of a slice.
    column = blobs(np.arange(10, dtype=np.uint32), np.array([0, 3, 3, 10]))
    values, sizes = blob_values(column, np.uint32)
    assert values.tolist() == list(range(10)) and sizes.tolist() == [3, 0, 7] and blob_values(column.slice(1), np.uint32)[0].tolist() == list(range(3, 10))


def test_hot_keys_take_the_join(spark):
    df = spark.createDataFrame(data(), "id string, title string, fact string")
    pairs = lambda **k: {tuple(r) for r in similar_pairs(*near_duplicates(df, "id", ["title", "fact"], 0.7, **k)).select("record_id_a", "record_id_b").collect()}
    assert pairs(hot=1) == pairs()


def test_elements_number_repeats():
    assert elements("a a b") == ["a", "a 1", "b"]


def test_empty_and_components(spark):
    members, links = near_duplicates(spark.createDataFrame([], "id string, t string"), "id", ["t"], 0.8)
    assert similar_pairs(members, links).count() == 0 and duplicate_groups(members, links).count() == 0
    n = 40
    nodes = spark.createDataFrame([(i,) for i in range(n + 2)], "node long")
    chain = spark.createDataFrame([(i, i + 1) for i in range(n - 1)], "a long, b long")
    got = dict(map(tuple, components(nodes, chain).collect()))
    assert got == {**{i: 0 for i in range(n)}, n: n, n + 1: n + 1}
