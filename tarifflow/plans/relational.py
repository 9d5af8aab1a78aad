"""The relational store: appends that keep its constraints, decisions of operators, and active rows kept up by batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import store
from ..operators.constraints import RULES, checked, filled
from ..schema import STORED, conform
from ..sources.shared import new_folder, shuffle_files_go, written
from ..sources.snapshots import BUCKETS, Conflict, Table

TRIES = 10
#: Rows that decisions are joined to at a time.
AT_ONCE = 4_000_000


@dataclass(frozen=True)
class Store:
    """Tables under `path`; price items lie by what makes them unique, others by their key."""

    spark: SparkSession
    path: str
    buckets: int = BUCKETS

    def table(self, name: str) -> Table:
        rules = RULES[name]
        return Table(self.spark, f"{self.path}/{name}", STORED[name], rules.once or (rules.key,), self.buckets)

    def read(self, name: str) -> DataFrame:
        return self.table(name).read()

    def rejects(self, name: str) -> DataFrame:
        """All rows that were refused, with the rules that they break."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/rejects/{name}")
        schema = f"{STORED[name]}, violations array<string>"
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{self.path}/rejects/{name}")


def _touched(table: Table, rows: DataFrame) -> list[int]:
    """Buckets of rows; as many values as there are buckets at most."""
    return [r[0] for r in rows.select(table.bucket().alias("bucket")).distinct().collect()]


def _until_first(tries: int, write: Callable[[], int]) -> int:
    """`write` again from what is there by then, as long as another writer is first."""
    for _ in range(tries - 1):
        try:
            return write()
        except Conflict:
            continue
    return write()


def insert(target: Store, name: str, rows: DataFrame, tries: int = TRIES) -> int:
    """Store the rows that keep the table's constraints, with defaults; the others go to its rejects. The new version."""
    spark, rules, table = target.spark, RULES[name], target.table(name)
    # written once, so that ids and times made here are the same in every try
    draft = new_folder(spark, f"draft-{name}")
    batch = written(filled(rows, STORED[name], rules).withColumn("ordinal", F.monotonically_increasing_id()), draft)

    def write() -> int:
        base = table.version()
        there = table.read(base)
        active = table.read(base, _touched(table, batch)).where(rules.where).select(*rules.once) if rules.once else None
        parents = {c: target.read(p).select(RULES[p].key) for c, p in rules.parents.items()}
        found = new_folder(spark, f"checked-{name}")
        refused = f"{target.path}/rejects/{name}/{uuid.uuid4().hex}"
        try:
            verdict = checked(batch, rules, parents, there.select(rules.key), active, lambda df: written(df, f"{found}/{uuid.uuid4().hex}"))
            written(verdict.where("size(violations) > 0"), refused)
            return table.append(base, verdict.where("size(violations) = 0").drop("violations"))
        except BaseException:
            _delete(spark, refused)
            raise
        finally:
            _delete(spark, found)

    try:
        return _until_first(tries, write)
    finally:
        _delete(spark, draft)


def insert_returning(target: Store, name: str, rows: DataFrame, tries: int = TRIES) -> DataFrame:
    """`insert`, and the rows that it stored, with the keys and defaults that they got."""
    return target.table(name).added(insert(target, name, rows, tries))


def _first(rows: DataFrame, condition: Column, key: str) -> DataFrame:
    """The key of the first row by key that meets a condition; no row if none does."""
    return rows.where(condition).orderBy(key).limit(1).select(key)


def seed(target: Store, partner: str, service: str, file_name: str, matched: DataFrame, open_items: DataFrame, effective_date: Column | None = None) -> DataFrame:
    """A document of the first partner of a name, with `matched` items of the first service of a name and `open_items` of none; the stored items.

    Without such a partner nothing is stored, without such a service only the open items.
    """
    day = F.current_date() if effective_date is None else effective_date
    owner = _first(target.read("partner"), F.col("name") == partner, "partner_id")
    document = owner.select("partner_id", F.lit(file_name).alias("file_name"), F.lit("xlsx").alias("file_format"), F.lit("done").alias("parse_status"), day.alias("effective_date"))
    about = insert_returning(target, "price_document", document).select("doc_id", "partner_id", "effective_date")
    # one row each at most
    of_service = about.crossJoin(_first(target.read("service"), F.col("service_name") == service, "service_id"))
    rows = matched.crossJoin(of_service).unionByName(open_items.crossJoin(about), allowMissingColumns=True)
    return insert_returning(target, "price_item", rows)


def set_match(target: Store, decisions: DataFrame, tries: int = TRIES) -> int:
    """Set service_id and match_confidence of items from (item_id, service_id, match_confidence); only the buckets of those items are written again.

    Decisions for items or services that aren't there change nothing.
    """
    spark, table = target.spark, target.table("price_item")

    def write() -> int:
        base = table.version()
        path = new_folder(spark, "decisions")
        try:
            known = written(decisions.join(target.read("service").select("service_id"), "service_id", "left_semi").dropDuplicates(["item_id"]), path)
            with shuffle_files_go(spark):
                touched = sorted(_touched(table, table.read(base).join(known, "item_id", "left_semi")))
            groups = min(len(touched), -(-table.read(base, touched).count() // AT_ONCE))
            staged = [table.stage(conform(store.set_match(table.read(base, own), known), table.schema)) for own in (touched[k::groups] for k in range(groups))]
            return table.swap(base, staged, touched)
        finally:
            _delete(spark, path)

    return _until_first(tries, write)


def upsert_active(table: Table, batch: DataFrame, order: list[Column], tries: int = TRIES) -> int:
    """Keep one active row for each key (`store.active_once`) over all batches so far; a batch reads and writes its own buckets only.

    The order has to be total: then batches in any order give what one run over all would.
    """

    def write() -> int:
        base = table.version()
        touched = _touched(table, batch)
        kept = table.read(base, touched).unionByName(batch.select(*table.read(0).columns))
        return table.replace(base, store.active_once(kept, order, table.key), touched)

    return _until_first(tries, write)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
