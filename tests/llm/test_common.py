import os

import numpy as np
import pytest

from quillet.llm import common as C


def test_written_tables_are_released(spark):
    df = spark.createDataFrame([(1, "a"), (None, None)], "k long, v string")
    back = C.written(df, "t")
    d = C.DigestArray.store(df, "k", "v", "d")
    assert back.count() == 2 and os.path.isdir(d.path)
    assert C.release(spark) >= 3
    assert not os.path.exists(d.path) and C.release(spark) == 0
    kept = C.fresh_path(spark, "k", keep=True)
    df.write.parquet(kept)
    C.release(spark)
    assert spark.read.parquet(kept).count() == 2


def test_other_columns_may_have_any_name(spark):
    df = spark.createDataFrame([(1, 2)], "id long, `a.b` long")
    assert C.need(df, "id").columns == ["id"]
    with pytest.raises(ValueError):
        C.need(df, "text")
    assert C.local_path("file:///x/y") == "/x/y"
    with pytest.raises(ValueError):
        C.local_path("hdfs://n/x")


def test_a_scope_deletes_its_own_tables_alone(spark):
    outer = C.written(spark.range(5), "outer")
    with C.scope(spark):
        inner = C.written(spark.range(3), "inner")
        with C.scope(spark):
            deep = C.written(spark.range(2), "deep")
        assert inner.count() == 3 and not os.path.exists(C.local_path(deep._written_to))
    assert outer.count() == 5 and not os.path.exists(C.local_path(inner._written_to))
    C.discard(outer)
    assert not os.path.exists(C.local_path(outer._written_to))


def test_numbers_of_an_array(spark):
    d = C.DigestArray.store(spark.range(1000).selectExpr("id * 7 as k", "id - 500 as v"), "k", "v", "numbers")
    which, where = d.find(np.array([7, 8, 700, 6993], np.uint64))
    assert which.tolist() == [0, 2, 3] and d.numbers(where).tolist() == [-499, -400, 499]
