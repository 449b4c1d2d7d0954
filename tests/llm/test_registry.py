def test_every_problem_has_its_query():
    import __spark_entry__ as e

    assert {f"p{n}_found" for n in (1, 2, 4, 7, 8, 9)} | {"p3_subset"} <= set(e.queries())
