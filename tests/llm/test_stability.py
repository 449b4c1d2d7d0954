"""The same results for any number of shuffle partitions."""

import pytest

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("partitions", ["1", "11"])
def test_results_do_not_depend_on_partitions(spark, partitions):
    import __spark_entry__ as e

    old = spark.conf.get("spark.sql.shuffle.partitions")
    names = ["p1_found", "p2_groups", "p3_subset", "p4_sample", "p7_containers", "p8_report", "p9_source_rates"]
    want = {n: sorted(map(str, e.queries()[n](spark, SMALL).collect())) for n in names}
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        for n in names:
            assert sorted(map(str, e.queries()[n](spark, SMALL).collect())) == want[n], n
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
