import duckdb
import pytest
from pyspark.sql import functions as F

from quarry.functions import udfs

PAIRS = [("martha", "marhta"), ("dixon", "dicksonx"), ("small_ring", "small_rung"), ("a", "b"), ("", "x"), ("abc", "abc"), ("crate", "trace")]


@pytest.mark.parametrize(("a", "b"), PAIRS)
def test_jaro_winkler(a, b):
    want = duckdb.execute("SELECT jaro_winkler_similarity(?, ?)", [a, b]).fetchall()[0][0]
    got = udfs.jaro_winkler_of(a, b)
    if want >= 0.7:
        assert got == pytest.approx(want)
    else:
        assert got < 0.7


def test_batches(spark):
    rows = spark.createDataFrame([("martha", "marhta"), (None, "x"), ("é", "é")], "a string, b string")
    got = rows.select(udfs.jaro_winkler("a", "b").alias("j"), udfs.nfc("b").alias("n")).collect()
    assert got[0].j == pytest.approx(0.961111, abs=1e-5) and got[1].j is None and got[2].n == "é"
    assert rows.where(F.col("a").isNull()).count() == 1
