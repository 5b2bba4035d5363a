import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyweave.operators import groups, placement, ranking


def rows(df, *names):
    return sorted(map(tuple, df.select(*names).collect()), key=str)


def sample(spark, n=700, hot=0.4):
    rng = random.Random(5)
    data = []
    for i in range(n):
        key = "hot" if rng.random() < hot else rng.choice(["a", "b", None, "c"])
        data.append((i, key, rng.choice(["5", "70", "x", None, "30"])))
    return spark.createDataFrame(data, "id long, I01 string, P03 string")


def test_geographic_aggregates_match_plain_windows(spark):
    df = sample(spark)
    got = groups.geographic_aggregates(df, "t", ["id"])
    w = Window.partitionBy("I01")
    plain = df.withColumn("n", F.count("*").over(w))
    order = Window.orderBy(F.desc("n"), "I01", "id")
    plain = plain.withColumn("r", F.dense_rank().over(Window.orderBy(F.desc("n")))).withColumn("t", F.ntile(100).over(order))
    assert rows(
        got, "id", "poblacion_total_provincia_t", "ranking_provincial_t", "percentil_poblacional_t"
    ) == rows(plain, "id", "n", "r", "t")


def test_household_aggregates_match_plain_windows(spark):
    df = sample(spark).select((F.col("id") % 90).alias("ID_VIV"), F.col("I01").alias("ID_HOG"), "id", "P03")
    got = groups.household_aggregates(df)
    w = Window.partitionBy("ID_VIV", "ID_HOG")
    age = F.col("P03").try_cast("double")
    plain = df.select(
        "id",
        F.count("*").over(w).alias("n"),
        F.avg(age).over(w).alias("m"),
        F.max(age).over(w).alias("x"),
        F.sum(F.when((age < 15) | (age >= 65), 1).otherwise(0)).over(w).alias("d"),
    )
    names = ["id", "tamaño_hogar_calculado", "edad_promedio_hogar", "edad_maxima_hogar", "dependientes_hogar"]
    assert rows(got, *names) == rows(plain, "id", "n", "m", "x", "d")


def test_many_groups_are_joined_without_broadcast(spark, monkeypatch):
    from tallyweave.operators import bounded

    df = sample(spark)
    small = groups.with_group_values(df, ["I01"], {"n": F.count("*")}, few_groups=True)
    real = bounded.small_copy
    monkeypatch.setattr(bounded, "small_copy", lambda d, *a: real(d, 1, 10))
    large = groups.with_group_values(df, ["I01"], {"n": F.count("*")}, few_groups=True)
    assert rows(small, "id", "n") == rows(large, "id", "n")


def test_ntile_with_fewer_rows_than_tiles(spark):
    df = spark.range(7).withColumn("k", F.lit(1))
    out = ranking.with_global_index(df, ["k", "id"], "i", "n")
    tiles = out.select("id", ranking.ntile_of(F.col("i"), F.col("n"), 10).alias("t"))
    assert rows(tiles, "id", "t") == [(i, i + 1) for i in range(7)]


def test_ntile_formula_matches_spark(spark):
    for n in (1, 99, 100, 101, 250, 1000):
        df = spark.range(1, n + 1)
        plain = F.ntile(100).over(Window.orderBy("id"))
        own = ranking.ntile_of(F.col("id"), F.lit(n).cast("long"), 100)
        assert df.select((plain == own).alias("same")).filter(~F.col("same")).count() == 0


def test_copies_are_spread_over_partitions(spark):
    df = spark.range(4000).select(F.lit("same").alias("a"), F.lit(1).alias("b"))
    placed = placement.range_placed(df, ["a", "b"], partitions=4)
    sizes = [r.n for r in placed.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 4000 and len(sizes) > 1 and placed.columns == ["a", "b"]
    numbered = ranking.with_global_index(df, ["a", "b"], "i", "n")
    got = numbered.agg(F.min("i"), F.max("i"), F.count_distinct("i"), F.max("n")).first()
    assert tuple(got) == (1, 4000, 4000, 4000)
    # a key of 3 % of the rows spreads too
    few = spark.range(40_000).select(F.when(F.col("id") < 1200, F.lit(-1)).otherwise(F.col("id")).alias("a"))
    spread = placement.range_placed(few, ["a"], partitions=200).where("a = -1").groupBy(F.spark_partition_id()).count()
    assert spread.count() > 3


def test_hot_group_join_is_split_at_run_time(spark):
    """A group with most of the rows: the join back is split by adaptive execution."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10000",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    old = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        df = spark.range(0, 60000, 1, 8).select(
            F.when(F.col("id") < 40000, 1).otherwise(F.col("id")).alias("ID_VIV"),
            F.lit(1).alias("ID_HOG"),
            F.lit("30").alias("P03"),
            F.sha2(F.col("id").cast("string"), 256).alias("payload"),
        )
        out = groups.household_aggregates(df)
        out.collect()
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
        assert out.filter("ID_VIV = 1").agg(F.min("tamaño_hogar_calculado")).first()[0] == 40000
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_folded_rows_come_back_the_same(spark):
    rows = [
        (i, None if i % 5 == 0 else f"g{i % 7}", None if i % 11 == 0 else i % 3, [True, False, None][i % 3], "" if i % 2 else " x", i * 31 % 997, [0.0, -0.0, None][i % 3])
        for i in range(1000)
    ]
    df = spark.createDataFrame(rows, "id long, g string, k int, b boolean, e string, many int, d double")
    narrow, unfold = placement.folded(df, {"id"})
    # columns of few values went as themselves before
    assert narrow.columns == ["id", "many", "d", "__fold0"]
    back = unfold(narrow.withColumn("more", F.lit(1)).repartition(3, "many"))
    assert back.schema.names == [*df.columns, "more"] and [t for _, t in back.dtypes[:-1]] == [t for _, t in df.dtypes]
    assert sorted(map(repr, back.drop("more").collect())) == sorted(map(repr, df.collect()))
    empty, unfold = placement.folded(df.where("id < 0"), set())
    assert unfold(empty).dtypes == df.dtypes and unfold(empty).count() == 0
