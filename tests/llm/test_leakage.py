"""Seeds and tiles against brute force."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from evplace.llm.leakage import find_leaks, greedy_tiles, running_hashes, words_of


def arr(x):
    return np.array(x, np.uint64)


@given(st.lists(st.integers(1, 4), max_size=40), st.lists(st.integers(1, 4), max_size=20), st.integers(1, 4))
@settings(max_examples=200, deadline=None)
def test_tiles_are_disjoint_matches_and_maximal(doc, item, least):
    tiles = greedy_tiles(arr(doc), arr(item), least)
    used_d, used_i = set(), set()
    for i, j, k in tiles:
        assert k >= least and doc[i : i + k] == item[j : j + k]
        d, t = set(range(i, i + k)), set(range(j, j + k))
        assert not d & used_d and not t & used_i
        used_d |= d
        used_i |= t
    # Nothing of the least length is left unmarked on both sides.
    for i in range(len(doc) - least + 1):
        for j in range(len(item) - least + 1):
            if doc[i : i + least] == item[j : j + least]:
                assert set(range(i, i + least)) & used_d or set(range(j, j + least)) & used_i
    # The first tile is a longest common run.
    best = max((k for i in range(len(doc)) for j in range(len(item)) for k in range(min(len(doc) - i, len(item) - j) + 1) if doc[i : i + k] == item[j : j + k]), default=0)
    assert (tiles[0][2] if tiles else 0) == (best if best >= least else 0)


def test_running_hashes_are_equal_for_equal_windows():
    h = running_hashes(arr([1, 2, 3, 1, 2, 3, 4]), 3)
    assert h[0] == h[3] and len(set(h.tolist())) == 4 and len(running_hashes(arr([1]), 3)) == 0


def brute(docs, items, n=12):
    out = set()
    for d, text in docs:
        w = words_of(text)
        grams = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
        for i, t in items:
            v = words_of(t)
            if any(tuple(v[k : k + n]) in grams for k in range(len(v) - n + 1)):
                out.add((d, i))
    return out


def test_find_leaks_equals_brute_force(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(60)]
    item_words = [[rng.choice(vocab) for _ in range(rng.randint(8, 40))] for _ in range(25)]
    items = [(i, ", ".join(w).upper()) for i, w in enumerate(item_words)] + [(90, None), (91, ""), (92, "too short")]
    docs = [(0, None), (1, ""), (2, "x " * 50_000)]
    for d in range(3, 60):
        body = [rng.choice(vocab) for _ in range(rng.randint(5, 80))]
        if d % 2:
            w = rng.choice(item_words)
            a = rng.randrange(len(w))
            body[5:5] = w[a : a + rng.randint(10, 20)]
        docs.append((d, " -- ".join(body)))
    docs.append((59, docs[-1][1]))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    it = spark.createDataFrame(items + items[:3], "item_id long, text string")
    want = brute(docs, [x for x in items if x[1]])
    for block in (1_000_000, 200):  # one block of items, and many
        got = find_leaks(df, it, block_words=block).collect()
        assert {(r["doc_id"], r["item_id"]) for r in got if r["longest_run"] >= 12} == want and want
        assert all((r["longest_run"] >= 12 or r["coverage"] >= 0.6) and 0 < r["coverage"] <= 1 for r in got)
        # Coverage decides alike: brute force tiles every pair.
        codes = {w: k for k, w in enumerate(vocab, 1)}
        as_codes = lambda t: arr([codes.get(w, 99) for w in words_of(t)])
        tiled = {(d, i): sum(k for _, _, k in greedy_tiles(as_codes(t), as_codes(x), 5)) / len(words_of(x)) for d, t in docs if d != 2 and t for i, x in items if x and len(words_of(x)) >= 5}
        assert {(r["doc_id"], r["item_id"]) for r in got} == want | {k for k, c in tiled.items() if c >= 0.6}
    assert find_leaks(df.limit(0), it).count() == 0 and find_leaks(df, it.limit(0)).count() == 0


def test_reordered_passage_is_covered(spark):
    first, second = [f"a{i}" for i in range(15)], [f"b{i}" for i in range(14)]
    df = spark.createDataFrame([(1, " ".join(second + ["zz"] + first))], "doc_id long, text string")
    it = spark.createDataFrame([(7, " ".join(first + second))], "item_id long, text string")
    r = find_leaks(df, it).collect()[0]
    assert (r["n_tiles"], r["covered_words"], r["coverage"], r["longest_run"]) == (2, 29, 1.0, 15)


def test_passage_in_short_reordered_pieces_is_found(spark):
    rng = random.Random(9)
    docs, items, want = [], [], set()
    for n in range(40):
        words = [f"v{n}x{i}" for i in range(rng.randint(30, 50))]
        pieces, at = [], 0
        while at < len(words):
            step = rng.randint(6, 11)
            pieces.append(words[at : at + step])
            at += step
        rng.shuffle(pieces)
        docs.append((n, " ".join(x for p in pieces for x in [*p, "zz"])))
        items.append((n, " ".join(words)))
        want.add((n, n))
    got = find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and all(r["coverage"] >= 0.8 for r in got)


def test_repetitive_texts():
    import time

    began = time.perf_counter()
    tiles = greedy_tiles(arr([1] * 20_000), arr([1] * 1_000), 5)
    assert tiles[0] == (0, 0, 1000) and len(tiles) == 1
    assert sum(k for _, _, k in greedy_tiles(arr([1, 2] * 3000), arr([2, 1] * 400), 5)) >= 790
    assert time.perf_counter() - began < 20
