from newsmill.session import hot_join, hot_keys


def test_hot_join_is_the_join(spark):
    left = spark.createDataFrame([(i, i % 3 if i % 2 else 7, "x") for i in range(300)] + [(900, None, "y")], "id long, k int, v string")
    right = spark.createDataFrame([(7, "seven"), (1, "one"), (99, "none")], "k int, w string")
    sizes = left.where("k is not null").groupBy("k").count().withColumnRenamed("count", "n")
    hot = hot_keys(sizes, ["k"])
    assert {r.k for r in hot.collect()} == {0, 1, 2, 7}
    for how in ("left", "inner"):
        got = sorted(map(str, hot_join(left, right, ["k"], "id", hot, how).select("id", "k", "v", "w").collect()))
        assert got == sorted(map(str, left.join(right, "k", how).select("id", "k", "v", "w").collect()))
    none = sizes.limit(0)
    assert hot_keys(none, ["k"]).count() == 0
