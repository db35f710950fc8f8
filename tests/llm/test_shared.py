import os

import pytest

from paperloom.llm import shared


def test_stored_tables_and_their_removal(spark):
    table = shared.stored(spark.range(5).toDF("x"), "some")
    folder = table.stored_at.removeprefix("file://").removeprefix("file:")
    assert sorted(r.x for r in table.collect()) == [0, 1, 2, 3, 4] and os.path.isdir(folder)
    shared.discard(table)
    assert not os.path.exists(folder)
    shared.stored(spark.range(1).toDF("x"), "other")
    shared.discard_all(spark)
    assert not shared._stored


def test_a_cluster_must_name_its_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"
        getConf = staticmethod(Conf)

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        shared.shared_dir(Session())


def test_free_names(spark):
    docs = spark.createDataFrame([(1, 2, 3)], "Told int, told_ int, x int")
    assert shared.free(docs, "told") == "told__" and shared.free(docs, "row") == "row"
