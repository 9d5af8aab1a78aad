"""The relational store over JDBC, with the database that Spark brings along."""

import pytest
from pyspark.sql import functions as F

from tarifflow.sources import tables

URL = "jdbc:derby:memory:tarifflow;create=true"
DRIVER = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    spark._jvm.System.setProperty("derby.stream.error.file", str(tmp_path_factory.mktemp("derby") / "derby.log"))
    tables._statements(spark, URL, ["CREATE TABLE price (id BIGINT PRIMARY KEY, name VARCHAR(20) NOT NULL, active BOOLEAN DEFAULT TRUE)"], DRIVER)
    return URL


def held(spark, **bounds):
    return sorted(map(tuple, tables.read_store(spark, URL, "price", **bounds, **DRIVER).collect()))


def staged(spark):
    return tables.read_store(spark, URL, "(SELECT TABLENAME FROM SYS.SYSTABLES WHERE LOWER(TABLENAME) LIKE 'staging%') t", **DRIVER).count()


def test_append_overwrite_and_ranges(spark, store):
    rows = lambda a, b: spark.range(a, b).select("id", F.concat(F.lit("n"), "id").alias("name")).repartition(4)
    tables.write_store(rows(0, 50), store, "price", **DRIVER)
    tables.write_store(rows(50, 60), store, "price", connections=2, **DRIVER)
    assert held(spark) == [(k, f"n{k}", True) for k in range(60)]
    read = tables.read_store(spark, store, "price", column="ID", bounds=(0, 60), connections=3, **DRIVER)
    assert read.rdd.getNumPartitions() == 3 and read.count() == 60
    tables.write_store(rows(7, 9), store, "price", mode="overwrite", **DRIVER)
    assert held(spark) == [(7, "n7", True), (8, "n8", True)]


@pytest.mark.parametrize("mode", ["append", "overwrite"])
def test_all_rows_or_none(spark, store, mode):
    before = held(spark)
    # one breaks a constraint of the table
    bad = spark.createDataFrame([(100, "fine"), (101, None)], "id bigint, name string").repartition(2)
    with pytest.raises(Exception, match="(?i)null"):
        tables.write_store(bad, store, "price", mode=mode, **DRIVER)
    fails = F.udf(lambda k: 1 / (k - 105) and "x", "string")
    with pytest.raises(Exception, match="ZeroDivision"):
        tables.write_store(spark.range(103, 107).select("id", fails("id").alias("name")), store, "price", mode=mode, **DRIVER)
    assert held(spark) == before and staged(spark) == 0
    with pytest.raises(ValueError, match="ignore"):
        tables.write_store(bad, store, "price", mode="ignore", **DRIVER)
