"""Nearest matches read each bucket in running frames."""

from pyspark.sql import functions as F

from skerry.operators import asof


def test_no_frame_to_the_end_of_a_bucket(spark):
    wanted = spark.range(300).select((F.col("id") * 0.37 % 50).alias("p"))
    series = spark.range(120).select((F.col("id") * 0.71 % 50).alias("s"), F.col("id").alias("v"))
    found = asof.nearest(wanted, series, "p", "s", "v", [], 10.0, 0.4)
    assert "unboundedfollowing" not in found._jdf.queryExecution().optimizedPlan().toString().lower()
    got = {r.p: (r.s, r.v) for r in found.collect()}
    rows = [(r.s, r.v) for r in series.collect()]
    for (p,) in wanted.distinct().collect():
        gap, s, v = min((abs(s - p), s, v) for s, v in rows)
        assert got.get(p) == ((s, v) if gap <= 0.4 else None)
