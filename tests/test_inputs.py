"""Repeated inputs are computed once, and a nested call mentions its arguments once."""

import math

from pyspark.sql import functions as F

from tabulon.functions import fn


def test_repeated_inputs_give_each_row_its_result(spark):
    from tabulon.plans.registry import computed

    df = spark.range(400).select("id", F.when(F.col("id") % 4 != 0, F.col("id") % 4).alias("a"), (F.col("id") % 3).cast("double").alias("b"))
    made = [F.concat_ws("/", F.coalesce(F.col("a"), F.lit(-1)), "b").alias("a"), fn.SQRT(F.col("b")).value.alias("root")]
    out = computed(df, ["id"], {"a": F.col("a"), "b": F.col("b")}, made)
    assert out.columns == ["id", "a", "root"] and "Broadcast" in out._jdf.queryExecution().executedPlan().toString()
    want = {(i, f"{i % 4 or -1}/{float(i % 3)}", float(i % 3) ** 0.5) for i in range(400)}
    assert set(map(tuple, out.collect())) == want
    # Inputs that don't repeat are computed row by row.
    rows = computed(df, ["id"], {"b": F.col("id") + 0.0}, [fn.SQRT(F.col("b")).value.alias("root")])
    assert "Join" not in rows._jdf.queryExecution().executedPlan().toString()
    assert {(x["id"], x["root"]) for x in rows.collect()} == {(i, float(i) ** 0.5) for i in range(400)}


def test_nested_calls_are_held_once(spark):
    z = fn.IMREAL(fn.IMPRODUCT(fn.COMPLEX(F.col("id"), 1), "2-3i"))
    df = spark.range(5).select(z.value.alias("v"))
    # A complex number's text mentions re twice and im twice; there are two such texts.
    assert df._jdf.queryExecution().analyzed().toString().lower().count("log10(") <= 8
    assert [x["v"] for x in df.collect()] == [2.0 * i + 3 for i in range(5)]
    normal = spark.range(1, 5).select(fn.NORM_S_INV(fn.NORM_S_DIST(F.col("id") / 4, True)).value.alias("v"))
    assert normal._jdf.queryExecution().analyzed().toString().count("aggregate(") <= 4
    assert all(abs(x["v"] - (i + 1) / 4) < 1e-6 for i, x in enumerate(normal.collect()))


def test_errors_pass_through_held_calls(spark):
    df = spark.range(1).select(fn.IMREAL(fn.IMSUM("x", "1+i")).shown().alias("a"), fn.IMABS(fn.IMDIV("1+i", "0")).shown().alias("b"), fn.PMT(fn.SQRT(-1), 3, 100).shown().alias("c"), fn.NORM_S_INV(fn.NORM_S_DIST("q", True)).shown().alias("d"))
    assert tuple(df.first()) == ("#NUM!", "#NUM!", "#NUM!", "#VALUE!")


def test_rounding_keeps_large_results(spark):
    from tabulon.plans.registry import r

    rows = spark.createDataFrame([(1.0952764069285457e26,), (-3e20,), (2.00004999,), (-0.5,), (None,)], "v double").select(r(F.col("v"), 4)).collect()
    assert abs(rows[0][0] / 1.0952764069285457e26 - 1) < 1e-15 and abs(rows[1][0] / -3e20 - 1) < 1e-15
    assert [x[0] for x in rows[2:]] == [2.0, -0.5, None]


def test_radix_texts_are_read_once(spark):
    z = fn.BIN2HEX(fn.DEC2BIN(F.col("id")))
    df = spark.range(3).select(z.shown().alias("v"))
    plan = df._jdf.queryExecution().analyzed().toString()
    assert plan.count("aggregate(") == 0 and plan.lower().count("conv(") <= 12
    assert [x["v"] for x in df.collect()] == ["0", "1", "2"]
    cells = [fn.HEX2DEC("fffffffffe"), fn.HEX2DEC(""), fn.HEX2DEC("12345678901"), fn.OCT2DEC("8"), fn.BIN2DEC("1111111111"), fn.BIN2HEX("1000000000"), fn.OCT2BIN("7777777770"), fn.HEX2BIN("400"), fn.HEX2OCT(" 1F "), fn.HEX2DEC("1\n"), fn.ARABIC("MCMXCIX"), fn.ARABIC("Q"), fn.BIN2OCT(fn.SQRT(-1))]
    row = spark.range(1).select(*[x.shown().alias(f"x{i}") for i, x in enumerate(cells)]).first()
    assert tuple(row) == ("-2", "0", "#NUM!", "#NUM!", "-1", "FFFFFFFE00", "1111111000", "#NUM!", "37", "#NUM!", "1999", "#VALUE!", "#NUM!")


def test_columns_over_different_inputs_are_computed_apart(spark, tmp_path):
    from tabulon.plans.registry import ORACLES, QUERIES, scalars

    spark.range(300).withColumn("w", F.col("id") * 2).write.parquet(str(tmp_path / "t.parquet"))
    id_ = F.col("id")
    scalars("_apart", "t", ["id"], {"a": (fn.MOD(id_, 5), "0"), "b": (fn.SQRT(F.col("w")), "0"), "c": (fn.MOD(id_, 7), "0")}, apart=[({"id": id_ % 5}, "a"), ({"id": id_ % 7}, "c")])
    try:
        out = QUERIES["_apart"](spark, str(tmp_path))
        assert out.columns == ["id", "a", "b", "c"]
        assert out._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin") == 2
        assert {tuple(x) for x in out.collect()} == {(i, float(i % 5), round((2 * i) ** 0.5, 6), float(i % 7)) for i in range(300)}
    finally:
        del QUERIES["_apart"], ORACLES["_apart"]


def test_logic_holds_what_it_looks_at(spark):
    ratio = fn["/"](F.col("id"), fn.MOD(F.col("id"), 2))
    df = spark.range(3).select(fn.IFERROR(fn.ERROR_TYPE(ratio), 0).value.alias("e"), fn.IFERROR(ratio, -1).value.alias("r"), fn.CHOOSE(fn["+"](fn.MOD(F.col("id"), 3), 1), "x", fn.CONCAT("y", fn.SQRT(-1))).shown().alias("c"))
    # Each of the three quotients by a remainder is mentioned as often as a remainder mentions itself, not once per error code.
    assert df._jdf.queryExecution().analyzed().toString().count("FLOOR(") <= 40
    assert [tuple(x) for x in df.collect()] == [(2.0, -1.0, "x"), (0.0, 1.0, "#NUM!"), (2.0, -1.0, "#VALUE!")]
    codes = [fn.ERROR_TYPE(fn.NA()), fn.ERROR_TYPE(F.lit(1)), fn.ERROR_TYPE(fn.SQRT(-1)), fn.CHOOSE(fn.SQRT(-1), 1), fn.CHOOSE("q", 1), fn.CHOOSE(2, 5, 6), fn.IFERROR(fn.SQRT(-1), fn.LN(-1))]
    assert tuple(spark.range(1).select(*[x.shown().alias(f"x{i}") for i, x in enumerate(codes)]).first()) == ("7", "#N/A", "6", "#NUM!", "#VALUE!", "6", "#NUM!")


def test_annuities_over_one_column_are_plain_expressions(spark):
    x = F.col("id") * 1000.0
    df = spark.range(1, 3).select(fn.PMT(0.005, 36, x).value.alias("a"), fn.IPMT(0.005, 1, 36, x).value.alias("b"), fn.RRI(5, 1000, x).value.alias("c"))
    plan = df._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "transform(" not in plan and "pow(1.005" not in plan
    row = df.collect()[1]
    assert abs(row["a"] + 2000 * 1.005**36 * 0.005 / (1.005**36 - 1)) < 1e-9 and abs(row["b"] + 10) < 1e-9 and abs(row["c"] - (2**0.2 - 1)) < 1e-12
    assert tuple(spark.range(1).select(fn.PMT(0.1, 0, F.col("id")).shown(), fn.PMT(0.0, 4, F.lit("x")).shown(), fn.PMT(F.lit(0.0), F.col("id") + 4, 8).shown()).first()) == ("#NUM!", "#VALUE!", "-2")


def test_dates_of_many_times_are_computed_once_a_day(spark, tmp_path):
    import duckdb

    from tabulon.plans.registry import ORACLES, QUERIES

    made = "SELECT i AS o_orderkey, CASE WHEN i <> 7 THEN TIMESTAMP '1997-11-20 00:00:00' + to_seconds(i * 4001) END AS o_orderdate FROM range(2000) r(i)"
    con = duckdb.connect()
    con.execute(f"CREATE TABLE orders AS {made}")
    con.execute(f"COPY orders TO '{tmp_path}/orders.parquet' (FORMAT parquet)")
    for name in ("date_parts", "date_spans", "networkdays", "bills"):
        df = QUERIES[name](spark, str(tmp_path))
        assert "BroadcastHashJoin" in df._jdf.queryExecution().executedPlan().toString()
        want = con.execute(f"SELECT * FROM ({ORACLES[name]}) WHERE o_orderkey <> 7 ORDER BY o_orderkey").fetchall()
        got = df.filter("o_orderkey <> 7").orderBy("o_orderkey").collect()
        assert [tuple(float(f"{v:.9g}") if isinstance(v, float) else v for v in x) for x in got] == [tuple(float(f"{v:.9g}") if isinstance(v, float) else v for v in x) for x in want]
    assert "BroadcastHashJoin" in QUERIES["bonds"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()


def test_numbers_are_checked_by_short_expressions(spark):
    df = spark.range(1, 4).select((F.col("id") / 2).alias("x")).select(fn.SIN(F.col("x")).value.alias("v"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("SIN(") <= 2 and "#VALUE!" not in plan
    values = [(2.5,), (float("nan"),), (float("inf"),), (float("-inf"),), (None,), (-0.0,), (1e308,)]
    doubles = [x[0] for x in spark.createDataFrame(values, "x double").select(fn.ABS(F.col("x")).shown().alias("v")).collect()]
    assert doubles == ["2.5", "#NUM!", "#NUM!", "#NUM!", "0", "0", "1.0E308"]
    texts = [x[0] for x in spark.createDataFrame([("12",), ("x",), ("",), (None,), ("NaN",)], "x string").select(fn.ABS(F.col("x")).shown().alias("v")).collect()]
    assert texts == ["12", "#VALUE!", "#VALUE!", "0", "#NUM!"]
    row = spark.sql("SELECT true AS b, 7 AS i, 7L AS l, 1.25BD AS d, CAST(NULL AS int) AS n").select(*[fn.INT(F.col(k)).shown().alias(k) for k in "bildn"]).first()
    assert tuple(row) == ("1", "7", "7", "1", "0")


def test_many_columns_row_by_row_are_compiled(spark, tmp_path):
    from tabulon.plans.registry import METHOD_LIMIT, QUERIES

    spark.range(500).selectExpr("id AS l_orderkey", "id AS l_partkey", "id AS l_suppkey", "int(id) AS l_linenumber", "id / 5001 AS l_discount").write.parquet(str(tmp_path / "lineitem.parquet"))
    before = spark.conf.get(METHOD_LIMIT, None)
    try:
        spark.conf.unset(METHOD_LIMIT)
        df = QUERIES["trigonometry"](spark, str(tmp_path))
        assert "Join" not in df._jdf.queryExecution().executedPlan().toString()
        # Beyond so many bytes of a method HotSpot doesn't compile it.
        assert int(spark.conf.get(METHOD_LIMIT)) <= 8000
        assert all(abs(x["sin_"] - math.sin(x["l_orderkey"] / 5001 * 9 + 0.05)) < 1e-6 for x in df.collect())
        spark.conf.set(METHOD_LIMIT, 20000)
        QUERIES["trigonometry"](spark, str(tmp_path))
        assert spark.conf.get(METHOD_LIMIT) == "20000"
    finally:
        spark.conf.unset(METHOD_LIMIT)
        if before is not None:
            spark.conf.set(METHOD_LIMIT, before)
