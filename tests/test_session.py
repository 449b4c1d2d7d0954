"""Where stage tables go, and that they can be dropped."""

import os

import pytest

from evplace.session import drop_stages, materialise, shared_dir


def test_stage_tables(spark):
    drop_stages(spark)
    df = materialise(spark.range(10), "x")
    assert df.count() == 10 and df.columns == ["id"]
    folder = shared_dir(spark)
    assert any(n.startswith("evplace-x-") for n in os.listdir(folder))
    assert drop_stages(spark) == 1 and not any(n.startswith("evplace-x-") for n in os.listdir(folder))


def test_a_cluster_needs_the_shared_folder():
    class Conf:
        def get(self, name, default=None):
            return default

    class Option:
        def isDefined(self):  # noqa: N802
            return False

    class Sc:
        master, applicationId = "spark://x:7077", "a"  # noqa: N815
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: Option()})()})()

    fake = type("Spark", (), {"conf": Conf(), "sparkContext": Sc()})()
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(fake)


def test_the_configured_folder_wins():
    conf = type("C", (), {"get": lambda self, n, d=None: "file:///shared/"})()
    assert shared_dir(type("Spark", (), {"conf": conf})()) == "file:///shared"
