import pytest
from pyspark.sql import functions as F

from quillet.operators import cells as C
from quillet.operators import rules as R
from quillet.streaming import null_sink, stream_audit, windowed_counts


def test_edit_and_round_trip(spark):
    wide = spark.createDataFrame([(1, "a", None), (4, None, "b")], "row long, x string, y string")
    cells = C.to_cells(wide, row="row")
    assert sorted(tuple(r) for r in cells.select("row", "col", "value").collect()) == [(1, 1, "a"), (4, 2, "b")]
    back = C.fill_rows(C.to_rows(cells, 2, names=["x", "y"]), "row")
    assert sorted(tuple(r) for r in back.collect()) == [(1, "a", None), (2, None, None), (3, None, None), (4, None, "b")]
    model = cells.select("row", "col", "value", F.lit(None).cast("string").alias("formula"))
    changes = spark.createDataFrame([(1, 1, None, "A2"), (4, 2, None, None), (9, 9, "new", None)], "row long, col int, value string, formula string")
    assert sorted(tuple(r) for r in C.edit(model, changes).collect()) == [(1, 1, None, "A2"), (9, 9, "new", None)]


def test_fill_rows_of_nothing_and_of_groups(spark):
    df = spark.createDataFrame([("a", 2, 1), ("b", 1, 5)], "g string, row long, v long")
    assert C.fill_rows(df, "row", by=["g"]).count() == 3
    assert C.fill_rows(df.limit(0), "row").count() == 0


def test_color_scale_ends_and_equal_values(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (5.0,), (None,)], "v double")
    rows = {r.v: (r.scale, r.color) for r in R.color_scale(df, "v").collect()}
    assert rows[1.0] == (0.0, "F8696B") and rows[2.0] == (0.5, "FFFFFF") and rows[5.0] == (1.0, "63BE7B") and rows[None] == (None, None)
    same = R.color_scale(spark.createDataFrame([(3.0,), (3.0,)], "v double"), "v").collect()
    assert {r.scale for r in same} == {0.5}
    assert {r.bar for r in R.data_bar(spark.createDataFrame([(3.0,), (3.0,), (None,)], "v double"), "v").collect()} == {0.0, None}


def test_dense_ids(spark):
    import random

    rng = random.Random(1)
    values = [rng.choice([rng.randrange(-50, 50), rng.randrange(10**15)]) for _ in range(300)]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v long, i long")
    got = sorted((r.id, r.v, r.i) for r in C.dense_ids(df, "v", "i", out="id").collect())
    assert got == [(k, v, i) for k, (v, i) in enumerate(sorted((v, i) for i, v in enumerate(values)))]
    assert C.dense_ids(df.limit(0), "v", out="id").count() == 0


def test_caps_reject(spark):
    df = spark.createDataFrame([(1, 5), (2, 50)], "i long, size long")
    assert R.assert_within(df, "size", 50, "too large").count() == 2
    with pytest.raises(Exception, match="too large"):
        R.assert_within(df, "size", 49, "too large").collect()


def test_unknown_operator():
    with pytest.raises(ValueError):
        R.cell_is("a", "like", 1)
    with pytest.raises(ValueError):
        R.cell_is("a", "between", 1)


def test_streams(spark, small, tmp_path):
    schema = spark.read.parquet(f"{small}/events.parquet").schema
    events = lambda: spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(small)
    null_sink(events(), str(tmp_path / "n")).awaitTermination()
    for _ in range(2):  # the second run finds nothing new
        stream_audit(events().selectExpr("event_id as job_id", "ts as started"), str(tmp_path / "a"), str(tmp_path / "c")).awaitTermination()
    assert spark.read.text(str(tmp_path / "a")).count() == spark.read.parquet(f"{small}/events.parquet").count()
    counts = windowed_counts(events(), "ts", "1 day", slide="12 hours", by=("event_type",))
    q = counts.writeStream.format("memory").queryName("w").outputMode("append").option("checkpointLocation", str(tmp_path / "w")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("w").count() > 0


def test_plans_stay_in_the_engine(spark, small, capsys):
    """Filters and columns reach the scan, and no Python runs, in a query over columns alone."""
    from quillet.plans import QUERIES

    QUERIES["validate_between"](spark, small).explain("formatted")
    plan = capsys.readouterr().out
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_quantity:double,l_discount:double,l_tax:double>" in plan
    assert "Python" not in plan and "Exchange" not in plan


def test_numbering_without_groups_is_many_tasks(spark):
    """Like a loop, with given numbers anywhere, and by buckets."""
    import random

    rng = random.Random(2)
    for share in (0.0, 0.02, 0.5):
        orders = rng.sample(range(100_000), 800)
        rows = [(o, rng.randrange(10_000) if rng.random() < share else None) for o in orders] + [(None, None)]
        df = spark.createDataFrame(rows, "o long, given long")
        want, now = {}, 0
        for o, g in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
            now = g if g is not None else now + 1
            want[o] = now
        numbered = C.number_rows(df, "given", "o")
        assert {r.o: r.row for r in numbered.collect()} == want
        assert numbered.columns == ["o", "given", "row"]
    words = spark.createDataFrame([("b", None), ("a", 5), ("c", 9), ("d", None)], "o string, given long")
    assert {r.o: r.row for r in C.number_rows(words, "given", "o").collect()} == {"a": 5, "b": 6, "c": 9, "d": 10}
    assert C.number_rows(df.limit(0), "given", "o").count() == 0


def test_filling_is_many_tasks(spark):
    df = spark.createDataFrame([(200_000, "x"), (3, "y")], "row int, v string")
    out = C.fill_rows(df, "row")
    assert tuple(out.selectExpr("count(*)", "sum(row)", "count(v)").first()) == (200_000, 200_000 * 200_001 // 2, 2)
    both = spark.createDataFrame([("a", 3, 1), ("b", 0, 1), ("b", 2, 1)], "g string, row int, v int")
    assert sorted((r.g, r.row) for r in C.fill_rows(both, "row", by=["g"]).collect()) == [("a", 1), ("a", 2), ("a", 3), ("b", 1), ("b", 2)]
    assert C.fill_rows(df.limit(0), "row").count() == 0
