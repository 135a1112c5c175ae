"""Nearest matches against all pairs, lookups and their errors."""

import random

import pytest

from skerry.operators import asof


@pytest.mark.parametrize("bucket, width", [(10.0, 10.0), (3.0, 10.0), (100.0, 5.0), (0.5, 2.0)])
def test_nearest_against_all_pairs(spark, bucket, width):
    rng = random.Random(int(bucket * width))
    wanted = [(rng.choice("ab"), rng.choice([rng.uniform(0, 80), float(rng.randint(0, 80)), None, 40.0])) for _ in range(150)]
    series = [(rng.choice("abc"), rng.choice([rng.uniform(20, 90), float(rng.randint(20, 90)), None, 42.0]), rng.randint(0, 9)) for _ in range(40)]
    got = asof.nearest(spark.createDataFrame(wanted, "g string, x double"), spark.createDataFrame(series, "g string, s double, v int"), "x", "s", "v", ["g"], bucket, width)
    want = set()
    for g, x in wanted:
        near = [(abs(s - x), s, v) for h, s, v in series if h == g and s is not None and x is not None and abs(s - x) <= width]
        if near:
            want.add((g, x, *min(near)[1:]))
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)


def test_last_match_and_nearest_day(spark):
    records = spark.createDataFrame([("temp", 1, 0, 5.0), ("temp", 1, 3, 6.0), ("temp", 1, 2, 7.0), ("salt", 1, 1, 8.0)], "field string, level int, record int, value double")
    ask = lambda *rows: spark.createDataFrame(rows, "field string, level int")
    got = asof.last_match(ask(("temp", 1), ("salt", 1)), records, ["field", "level"], ["record"], ["value"]).collect()
    assert {tuple(r) for r in got} == {("temp", 1, 6.0), ("salt", 1, 8.0)}
    with pytest.raises(Exception, match="no record of temp, 2"):
        asof.last_match(ask(("temp", 2)), records, ["field", "level"], ["record"], ["value"]).collect()
    found = asof.exact_match(ask(("temp", 1), ("temp", 2)), records, ["field", "level"], ["record"]).collect()
    assert {tuple(r) for r in found} == {("temp", 1, 3), ("temp", 2, None)}
    days = spark.createDataFrame([("wind", 10.0, "a"), ("wind", 11.0, "b"), ("rain", 10.4, "c")], "field string, day double, file string")
    at = lambda *rows: spark.createDataFrame(rows, "field string, day double")
    got = asof.nearest_day(at(("wind", 10.5), ("wind", 12.0), ("rain", 9.4)), days, "field", "day", "file").collect()
    assert {(r.field, r.day, r.file) for r in got} == {("wind", 10.5, "a"), ("wind", 12.0, "b"), ("rain", 9.4, "c")}
    with pytest.raises(Exception, match="within the limit of day 12.1"):
        asof.nearest_day(at(("wind", 12.1)), days, "field", "day", "file").collect()
    assert asof.nearest_day(at(("wind", 12.1)), days, "field", "day", "file", missing="null").first().file is None
