"""Quotas against the definition; the subset against its promises."""

from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from evplace.llm.quota import flow_quotas, reservoirs, sample_to_targets
from evplace.llm.subset import fair_share, hilbert_keys, varied_subset

CATS = {"casual": (0.3, 3), "professional": (0.5, 2), "transactional": (0.2, 4)}


@given(st.dictionaries(st.tuples(st.sampled_from(["in_domain", "off_topic"]), st.sampled_from([*CATS, "(none)"])), st.integers(0, 40), max_size=8), st.integers(0, 60), st.integers(0, 60))
@settings(max_examples=150, deadline=None)
def test_quotas_are_feasible_and_fill_the_targets(available, t_in, t_off):
    q = flow_quotas({"in_domain": t_in, "off_topic": t_off}, available, CATS)
    for k, n in q.items():
        assert 0 <= n <= available[k]
    for d, t in (("in_domain", t_in), ("off_topic", t_off)):
        assert sum(n for (e, _), n in q.items() if e == d) == min(t, sum(n for (e, _), n in available.items() if e == d))


def test_shares_and_minimums_hold_when_there_is_enough():
    q = flow_quotas({"in_domain": 60, "off_topic": 40}, {(d, c): 500 for d in ("in_domain", "off_topic") for c in [*CATS, "(none)"]}, CATS)
    by = Counter()
    for (_, c), n in q.items():
        by[c] += n
    assert by == {"casual": 30, "professional": 50, "transactional": 20, "(none)": 0}
    q = flow_quotas({"in_domain": 10, "off_topic": 0}, {("in_domain", c): 500 for c in CATS}, CATS)
    assert sum(n for (_, c), n in q.items() if c == "transactional") >= 4


def sessions(spark):
    rows = []
    for i in range(300):
        rows.append((f"s{i}", "p1", ["casual", " Casual", "PROFESSIONAL", "transactional", None, "", "odd"][i % 7], i % 5 == 0, None if i % 11 else "bad", str(i)))
    rows += rows[:40]
    rows += [(f"t{i}", "p2", "casual", False, None, "x") for i in range(3)] + [(None, "p1", "casual", False, None, "x"), ("u", None, "casual", False, None, "x"), ("v", "p1", "casual", None, None, "x")]
    return rows, spark.createDataFrame(rows, "custom_id string, pool_id string, scenario_category string, is_off_topic boolean, session_parse_error string, domain string")


def test_sample_and_report(spark):
    rows, df = sessions(spark)
    pools = spark.createDataFrame([("p1", "a", 100, 80), ("p2", "a", 5, 0), ("p3", "b", 1, None)], "pool_id string, persona_id string, target_in_domain int, target_off_topic int")
    shares = spark.createDataFrame([("a", c, s, m) for c, (s, m) in CATS.items()], "persona_id string, scenario_category string, target_share double, min_count int")
    sample, report = sample_to_targets(df, pools, shares)
    s = sample.collect()
    assert len({(r["pool_id"], r["custom_id"]) for r in s}) == len(s)
    ok = {r[0]: r for r in rows if r[0] and r[4] is None}
    assert all(r["custom_id"] in ok for r in s)
    n_off = len({r[0] for r in rows if r[0] and r[1] == "p1" and r[4] is None and r[3]})
    got = Counter((r["pool_id"], r["domain"]) for r in s)
    assert got[("p1", "in_domain")] == 100 and got[("p1", "off_topic")] == min(80, n_off) and got[("p2", "in_domain")] == 3
    unmet = {(r["pool_id"], r["stratum"]) for r in report.collect() if r["exhausted"] and r["kind"] != "share"}
    assert unmet == {("p1", "off_topic"), ("p2", "in_domain"), ("p2", "professional"), ("p2", "transactional"), ("p3", "in_domain")}
    assert sorted(map(tuple, s), key=str) == sorted(map(tuple, sample_to_targets(df.repartition(5), pools, shares)[0].collect()), key=str)
    empty, rep = sample_to_targets(df.limit(0), pools, shares)
    # A minimum that the target leaves no room for is not met, though there are records enough.
    tight = spark.createDataFrame([("p1", "a", 2, 0)], "pool_id string, persona_id string, target_in_domain int, target_off_topic int")
    least = spark.createDataFrame([("a", "casual", 1.0, 10)], "persona_id string, scenario_category string, target_share double, min_count int")
    row = sample_to_targets(df, tight, least)[1].where("kind = 'minimum'").collect()[0]
    assert (row["taken"], row["wanted"], row["met"], row["exhausted"]) == (2, 10, False, False) and row["usable"] > 10
    assert empty.count() == 0 and rep.where("kind = 'target' and not met").count() == 4


def test_reservoirs_merge_and_keep_the_least_hashes():
    rng = np.random.default_rng(5)
    ranks = rng.permutation(5000) - 2500
    rows = [("p", "in_domain", "casual", f"r{i}", int(h), 20) for i, h in enumerate(ranks)]
    batch = lambda part: pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*part)], ["pool_id", "domain", "category", "custom_id", "rank_hash", "bound"])
    out = [r for i in range(0, 5000, 1000) for b in reservoirs(iter([batch(rows[i : i + 500]), batch(rows[i + 500 : i + 1000])])) for r in b.to_pylist()]
    assert sum(r["n"] or 0 for r in out) == 5000 and len(out) == 5 * 21
    assert sorted(r["rank_hash"] for r in out if r["n"] is None)[:20] == list(range(-2500, -2480))


def test_hilbert_curve_visits_neighbours():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        pts = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = hilbert_keys(pts, bits)
        assert sorted(keys.tolist()) == list(range(len(pts)))
        assert (np.abs(np.diff(pts[np.argsort(keys)], axis=0)).sum(1) == 1).all()


@given(st.lists(st.integers(1, 12), max_size=30), st.integers(1, 200))
@settings(max_examples=200, deadline=None)
def test_fair_share(cells, size):
    t, rest = fair_share(sorted(Counter(min(c, size + 1) for c in cells).items()), size)
    taken = sum(min(c, t) for c in cells)
    assert taken + rest == size and rest >= 0
    assert sum(min(c, t + 1) for c in cells) > size or taken == sum(cells)


FEATURES = {"a": ["x", "y", "z"], "b": ["lo", "hi"]}


def test_subset(spark):
    rows = [(f"r{i:04}", "x", "lo", None, "same") for i in range(500)]
    rows += [(f"q{a}{b}{i}", a, b, None if i else "bad", f"m{i}") for a in ("y", " Z", None, "new") for b in ("lo", "HI", "") for i in range(3)]
    rows += rows[:50] + [(None, "x", "lo", None, "s")]
    df = spark.createDataFrame(rows, "id string, a string, b string, err string, msg string")
    n = len({r[0] for r in rows if r[0]})
    for size in (0, 5, 13, 20, 40, 100, 10_000):
        out = varied_subset(df, "id", FEATURES, size, error="err", spread="msg").collect()
        assert len(out) == min(size, n) and len({r["id"] for r in out}) == len(out)
        per = Counter((r["a"], r["b"]) for r in out)
        if 13 <= size <= 39:
            assert len(per) == 13 and max(per.values()) - min(per.values()) <= 1
        if size == 13:
            errors = {r[0] for r in rows if r[3]}
            assert not errors & {r["id"] for r in out}  # the best record of a cell has no error
    assert varied_subset(df.limit(0), "id", FEATURES, 5).count() == 0
    a = sorted(r["id"] for r in varied_subset(df, "id", FEATURES, 20).collect())
    assert a == sorted(r["id"] for r in varied_subset(df.repartition(9), "id", FEATURES, 20).collect())
