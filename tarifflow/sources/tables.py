"""Sinks and relational stores."""

from __future__ import annotations

import contextlib
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles, dates and times as ISO text."""
    out = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DecimalType):
            column = column.cast("double")
        elif isinstance(field.dataType, T.DateType):
            column = F.date_format(column, "yyyy-MM-dd")
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            column = F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        out.append(column.alias(field.name))
    return df.select(*out)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines; nulls are written."""
    plain(df).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """CSV with a header. `one_file` is for reports of known small size."""
    out = plain(df)
    (out.coalesce(1) if one_file else out).write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def write_all(tables: dict[str, DataFrame], folder: str) -> None:
    """Partners, documents and report as JSON, items as CSV."""
    for name in ("partners", "documents", "parse_report"):
        write_json(tables[name], f"{folder}/{name}.json")
    write_csv(tables["price_items"], f"{folder}/price_items.csv")


def write_review_queue(queue: DataFrame, folder: str) -> None:
    write_csv(queue, f"{folder}/review_queue.csv")


def read_store(spark: SparkSession, url: str, table: str, column: str | None = None, bounds: tuple[int, int] | None = None, connections: int = 10, **properties: str) -> DataFrame:
    """A table over JDBC, through at most `connections` of them."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, numPartitions=connections, **properties)
    if column and bounds:
        reader = reader.options(partitionColumn=column, lowerBound=bounds[0], upperBound=bounds[1])
    return reader.load()


def _statements(spark: SparkSession, url: str, statements: list[str], properties: dict[str, str]) -> None:
    """All of them or none, over one connection of the driver."""
    jvm = spark._jvm
    options = jvm.java.util.Properties()
    for key, value in properties.items():
        options.setProperty(key, value)
    if "driver" in properties:
        jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(properties["driver"])
    connection = jvm.java.sql.DriverManager.getConnection(url, options)
    try:
        connection.setAutoCommit(False)
        statement = connection.createStatement()
        for sql in statements:
            statement.executeUpdate(sql)
        connection.commit()
    except BaseException:
        connection.rollback()
        raise
    finally:
        connection.close()


def write_store(df: DataFrame, url: str, table: str, mode: str = "append", connections: int = 10, **properties: str) -> None:
    """Append to, or overwrite, a table over JDBC, all rows or none.

    The rows go to a table of their own over at most `connections`, then into `table` by one
    statement in one transaction, within the database.  So a job that fails, or tasks that
    run again, leave `table` as it was.  To be there is the table's part, with its constraints;
    columns that `df` doesn't have get their defaults.
    """
    if mode not in ("append", "overwrite"):
        raise ValueError(mode)
    spark = df.sparkSession
    staging = f"staging_{uuid.uuid4().hex[:12]}"
    columns = ", ".join(df.columns)
    try:
        df.coalesce(connections).write.format("jdbc").options(url=url, dbtable=staging, numPartitions=connections, **properties).mode("overwrite").save()
        quoted = ", ".join(f'"{c}"' for c in df.columns)
        empty = [f"DELETE FROM {table}"] if mode == "overwrite" else []
        _statements(spark, url, [*empty, f"INSERT INTO {table} ({columns}) SELECT {quoted} FROM {staging}"], properties)
    finally:
        # there is none if the first task didn't get to it
        with contextlib.suppress(Py4JJavaError):
            _statements(spark, url, [f"DROP TABLE {staging}"], properties)
