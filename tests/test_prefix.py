import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkrag.operators.prefix import first_wins, int_bucket, prefix


def test_prefix_equals_plain_windows(spark):
    rng = random.Random(3)
    rows = [(rng.choice("aaab"), i, rng.randint(0, 5), rng.choice([None, "t%d" % i]))
            for i in range(400)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, pos int, n int, t string")
    got = prefix(df, ["k"], ["pos"], int_bucket("pos", 7), {"s": F.col("n"), "c": F.lit(1)},
                 {"last": F.col("t")}, {"before": F.col("n")})
    w = Window.partitionBy("k").orderBy("pos")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("*", F.sum("n").over(upto).alias("s"), F.row_number().over(w).alias("c"),
                     F.last("t", True).over(upto).alias("last"),
                     F.lag("n").over(w).alias("before"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_first_wins_keeps_the_first(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 5, "z")],
                               "k string, o int, v string")
    assert sorted(map(tuple, first_wins(df, ["k"], ["o"]).collect())) == [("a", 1, "y"),
                                                                          ("b", 5, "z")]
