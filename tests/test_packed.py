"""Round trips of the cell grammar, and its defined results."""

import json

from hypothesis import given, settings
from hypothesis import strategies as st

from evplace.operators.packed import parse_cell, split_packed

TEXT = st.text(st.characters(blacklist_categories=("Cs", "Cc", "Zs", "Cf")), min_size=1, max_size=12).map(lambda s: s.strip()).filter(lambda s: s and s.lower() != "nan")


def items(cell):
    return [i for i, _ in parse_cell(cell)]


@given(st.lists(TEXT, max_size=6))
@settings(max_examples=200, deadline=None)
def test_json_and_csv_round_trips(values):
    assert items(json.dumps(values)) == values
    assert items(json.dumps(values, ensure_ascii=False)) == values
    quoted = ['"' + v.replace('"', '""') + '"' for v in values]
    for sep in (",", " , ", ";", "|", " || ", "\t", "\n"):
        assert items(sep.join(quoted)) == values


@given(st.lists(st.sampled_from(["a b", 'say "hi"', "it's", "x;y", "a, b", "p|q"]), max_size=5))
@settings(max_examples=100, deadline=None)
def test_python_lists(values):
    assert items(repr(values)) == values


def test_defined_results():
    for nothing in (None, "", "  ", "[]", "[ ]", "nan", "NaN", " \n"):
        assert parse_cell(nothing) == []
    assert items("a,,b, ,c,") == ["a", "b", "c"]
    assert items(' x | "y, z"||w ;v') == ["x", "y, z", "w", "v"]
    assert items("a;a;a") == ["a", "a", "a"]
    assert items("[None, 'x', nan, \"y\"]") == ["x", "y"]
    assert items('"a ""b"" c";d') == ['a "b" c', "d"]
    assert items(r'["a \"b\"", "é\n"]') == ['a "b"', "é"]


def test_malformed_quotes_backtrack_to_bare_values():
    assert parse_cell('"open, b') == [('"open', "malformed_quote"), ("b", None)]
    assert parse_cell('"a"x,b') == [('"a"x', "malformed_quote"), ("b", None)]
    assert parse_cell("['a', 'b'") == [("a", "unclosed_bracket"), ("b", "unclosed_bracket")]
    assert parse_cell("l'aide|b") == [("l'aide", None), ("b", None)]


def test_very_long_cell():
    assert len(parse_cell(",".join(["abc"] * 100_000))) == 100_000
    assert len(parse_cell('"' * 20_001)) >= 0


def test_split_counts_resent_rows_once(spark):
    rows = [(1, "a;b", "[]", "2024-01-02", "x"), (1, "a;b", "[]", "2024-01-05", "x"), (2, None, '["c", "c"]', "2024-01-01", "y"), (None, "z", None, "2024-01-01", "q")]
    df = spark.createDataFrame(rows, "k long, f string, g string, at string, item string")
    got = sorted((r["record_id"] or 0, r["field_name"], r["pos"], r["item"]) for r in split_packed(df, "k", ["f", "g"], "at").collect())
    assert got == [(0, "f", 1, "z"), (1, "f", 1, "a"), (1, "f", 2, "b"), (2, "g", 1, "c"), (2, "g", 2, "c")]
    assert split_packed(df.limit(0), "k", ["f", "g"], "at").count() == 0
