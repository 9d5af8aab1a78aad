"""Versions of tables, constraints of appends, decisions, and active rows by batches."""

import datetime as dt
import itertools
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tarifflow.operators import constraints, store
from tarifflow.plans import relational
from tarifflow.sources.snapshots import Conflict, Table

DAY = dt.date(2025, 1, 1)
ITEM = "item_id string, doc_id string, partner_id string, service_name_raw string, price_original string, currency_original string, effective_date date, is_active boolean"


def rows_of(table, version=None):
    return sorted(map(tuple, table.read(version).collect()), key=repr)


@pytest.fixture
def table(spark, tmp_path):
    return Table(spark, f"file://{tmp_path}/t", "k int, v string", ("k",), 4)


def pairs(spark, *rows):
    return spark.createDataFrame(rows, "k int, v string")


def test_versions(spark, table):
    assert (table.version(), rows_of(table)) == (0, [])
    assert table.append(0, pairs(spark, (1, "a"), (2, "b"))) == 1
    assert table.append(1, pairs(spark, (3, "c"))) == 2
    bucket = pairs(spark, (2, "")).select(table.bucket()).first()[0]
    held = [r for r in ((1, "a"), (2, "b"), (3, "c")) if pairs(spark, r).select(table.bucket()).first()[0] == bucket]
    assert table.replace(2, pairs(spark, (2, "new")), [bucket]) == 3
    assert rows_of(table) == sorted({(1, "a"), (2, "b"), (3, "c")} - {*held} | {(2, "new")})
    assert rows_of(table, 2) == [(1, "a"), (2, "b"), (3, "c")] and rows_of(table, 1) == [(1, "a"), (2, "b")]
    assert table.compact(3) == 4 and len(table.parts(4)) == 1 and rows_of(table) == rows_of(table, 3)


def test_one_of_two_writers_wins(spark, table):
    base = table.version()
    late = table.stage(pairs(spark, (2, "late")))
    table.append(base, pairs(spark, (1, "first")))
    with pytest.raises(Conflict):
        table.commit(base, [*table.parts(base), late])
    assert rows_of(table) == [(1, "first")]
    again = table.version()
    table.commit(again, [*table.parts(again), late])
    assert rows_of(table) == [(1, "first"), (2, "late")]


def test_a_failed_write_changes_nothing(spark, table):
    table.append(0, pairs(spark, (1, "a")))

    @F.udf("string")
    def broken(v):
        raise ValueError(v)

    with pytest.raises(Exception, match="bad"):
        table.append(1, pairs(spark, (2, "bad")).withColumn("v", broken("v")))
    assert (table.version(), rows_of(table)) == (1, [(1, "a")])


def test_only_wanted_buckets_are_read(spark, table):
    table.append(0, spark.range(100).selectExpr("CAST(id AS INT) AS k", "'x' AS v"))
    read = table.read(buckets=[1])
    assert {r[0] for r in read.select(table.bucket()).distinct().collect()} == {1}
    files = {f.split("bucket=")[1].split("/")[0] for f in (r[0] for r in read.select(F.input_file_name()).distinct().collect()) if f}
    assert files == {"1"}


@pytest.fixture
def target(spark, tmp_path):
    out = relational.Store(spark, f"file://{tmp_path}/store", 4)
    relational.insert(out, "service", spark.createDataFrame([("s1", "Анализ"), ("s2", "Осмотр"), ("s2", "again"), ("s3", None)], "service_id string, service_name string"))
    relational.insert(out, "partner", spark.createDataFrame([("p1", "Клиника", "123456789012"), ("p2", "Other", "1234567890123")], "partner_id string, name string, bin string"))
    relational.insert(out, "price_document", spark.createDataFrame([("d1", "p1", "a.pdf", "pdf", None), ("d2", None, "b.xlsx", "xlsx", "done"), ("d3", "p9", "c", "doc", "open")], "doc_id string, partner_id string, file_name string, file_format string, parse_status string"))
    return out


def refused(target, name, key):
    return {r[key]: sorted(r["violations"]) for r in target.rejects(name).collect()}


def test_constraints_of_parents(target):
    assert {r["service_id"]: (r["is_active"], r["synonyms"]) for r in target.read("service").collect()} == {"s1": (True, []), "s2": (True, [])}
    assert refused(target, "service", "service_id") == {"s2": ["service_id again"], "s3": ["service_name is null"]}
    assert refused(target, "partner", "partner_id") == {"p2": ["length of bin"]}
    assert {r["doc_id"]: r["parse_status"] for r in target.read("price_document").collect()} == {"d1": "pending", "d2": "done"}
    assert refused(target, "price_document", "doc_id") == {"d3": ["partner_id without a row", "value of file_format", "value of parse_status"]}
    assert all(r["created_at"] for r in target.read("price_document").collect())


def test_constraints_of_items(spark, target):
    rows = [
        ("1", "d1", "p1", "a", "10.005", None, DAY, None),
        ("2", "d1", "p1", "a", "11", "USD", DAY, True),  # as 1
        ("3", "d1", "p1", "a", "12", "KZT", DAY, False),  # not active
        ("4", "d1", "p1", "a", "12", "KZT", None, True),  # no date
        ("5", "d1", "p1", "a", "12", "KZT", None, True),
        ("6", "d9", "p1", "b", "12", "EUR", DAY, True),
        ("7", None, None, None, "1e13", "KZT", DAY, True),
        ("8", "d1", "p1", "c", "x", "KZT", DAY, True),
        ("9", "d1", "p1", "d", "1", "KZT", DAY, True),
        ("9", "d1", "p1", "d", "1", "KZT", DAY, True),  # the same row twice
        (None, "d1", "p1", "e", "1", "KZT", DAY, True),
    ]
    frame = spark.createDataFrame(rows, ITEM)
    assert relational.insert(target, "price_item", frame.withColumn("extra", F.lit(1))) == 1
    stored = {r["item_id"]: r for r in target.read("price_item").collect()}
    assert {k for k in stored if len(k) == 1} == {"1", "3", "4", "5", "9"} and len(stored) == 6
    assert (stored["1"]["price_original"], stored["1"]["currency_original"], stored["1"]["is_active"], stored["1"]["is_verified"]) == (Decimal("10.01"), "KZT", True, False)
    again = "partner_id, service_name_raw, effective_date again"
    assert refused(target, "price_item", "item_id") == {"2": [again], "6": ["doc_id without a row", "value of currency_original"], "7": ["service_name_raw is null", "type of price_original"], "8": ["type of price_original"], "9": ["item_id again"]}
    later = spark.createDataFrame([("1", "d1", "p1", "new", "1", "KZT", DAY, True), ("10", "d1", "p1", "d", "1", "KZT", DAY, True), ("11", "d1", "p1", "f", "1", "KZT", DAY, True)], ITEM)
    assert relational.insert(target, "price_item", later) == 2
    assert len(target.read("price_item").collect()) == 7
    assert refused(target, "price_item", "item_id")["10"] == [again] and refused(target, "price_item", "item_id")["1"] == ["item_id again"]


def test_an_insert_tries_again_after_another_writer(spark, target, monkeypatch):
    row = lambda i, name: spark.createDataFrame([(i, "d1", "p1", name, "1", "KZT", DAY, True)], ITEM)
    append, others = Table.append, [row("other", "same")]

    def late(self, base, rows):
        if others:
            relational.insert(target, "price_item", others.pop())
        return append(self, base, rows)

    monkeypatch.setattr(Table, "append", late)
    assert relational.insert(target, "price_item", row("mine", "same").union(row("own", "own"))) == 2
    assert {r["item_id"] for r in target.read("price_item").collect()} == {"other", "own"}
    assert refused(target, "price_item", "item_id") == {"mine": ["partner_id, service_name_raw, effective_date again"]}


def test_decisions_write_their_buckets_only(spark, target):
    rows = [(str(k), "d1", "p1", f"n{k}", "1", "KZT", DAY, True) for k in range(30)]
    relational.insert(target, "price_item", spark.createDataFrame(rows, ITEM))
    relational.set_match(target, spark.createDataFrame([("3", "s1", 0.9), ("4", "gone", 0.9), ("99", "s1", 0.9)], "item_id string, service_id string, match_confidence double"))
    stored = {r["item_id"]: (r["service_id"], r["match_confidence"]) for r in target.read("price_item").collect()}
    assert len(stored) == 30 and {k: v for k, v in stored.items() if v != (None, None)} == {"3": ("s1", Decimal("0.900"))}
    table = target.table("price_item")
    first, second = table.parts(2)
    assert len(second.buckets) == 1 and not set(first.buckets) & set(second.buckets)


def test_batches_in_any_order_give_one_run(spark, tmp_path):
    rng = random.Random(1)
    schema = "item_id int, partner_id string, service_name_raw string, effective_date date, is_active boolean"
    rows = [(k, rng.choice("pq"), rng.choice("abc"), rng.choice([DAY, None]), rng.random() < 0.8) for k in range(60)]
    whole = sorted(map(tuple, store.active_once(spark.createDataFrame(rows, schema), [F.col("item_id")]).collect()), key=repr)
    for number, order in enumerate(itertools.permutations(range(3))):
        if number % 2:
            continue
        table = Table(spark, f"file://{tmp_path}/{number}", schema, ("partner_id", "service_name_raw", "effective_date"), 8)
        for k in order:
            relational.upsert_active(table, spark.createDataFrame(rows[k::3], schema), [F.col("item_id")])
        assert rows_of(table) == whole
    touched = relational._touched(table, spark.createDataFrame([(99, "p", "a", DAY, True)], schema))
    relational.upsert_active(table, spark.createDataFrame([(99, "p", "a", DAY, True)], schema), [F.col("item_id")])
    assert [p.buckets for p in table.parts(table.version())][-1] == tuple(touched) and rows_of(table) == whole


def test_seed(spark, target):
    matched = spark.sql("SELECT * FROM VALUES ('a', 3500, 0.97), ('b', 10, 0.5) AS v(service_name_raw, price_resident_kzt, match_confidence)")
    rest = spark.sql("SELECT 'c' AS service_name_raw")
    rows = relational.seed(target, "Клиника", "Анализ", "a.xlsx", matched, rest, F.lit(DAY)).collect()
    assert sorted((r["service_name_raw"], r["partner_id"], r["service_id"], r["effective_date"], r["is_verified"]) for r in rows) == [("a", "p1", "s1", DAY, False), ("b", "p1", "s1", DAY, False), ("c", "p1", None, DAY, False)]
    (doc,) = {r["doc_id"] for r in rows}
    assert [r["file_name"] for r in target.read("price_document").where(F.col("doc_id") == doc).collect()] == ["a.xlsx"]
    # the same items of that day again are refused; so are those of nobody
    assert relational.seed(target, "Клиника", "Анализ", "a.xlsx", matched, rest, F.lit(DAY)).count() == 0
    assert relational.seed(target, "Nobody", "Анализ", "b.xlsx", matched, rest).count() == 0
    assert [r["service_name_raw"] for r in relational.seed(target, "Клиника", "gone", "c.xlsx", matched, rest, F.lit(dt.date(2025, 2, 2))).collect()] == ["c"]


def test_rules_name_columns_that_there_are():
    for name, rules in constraints.RULES.items():
        columns = {c for c, _ in constraints._fields(relational.STORED[name])}
        assert {rules.key, *rules.required, *rules.defaults, *rules.accepted, *rules.longest, *rules.parents, *rules.once} <= columns


def left_on_disk(spark):
    """Bytes of shuffle files of this session."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().toList()
    return sum(files.apply(k).length() for k in range(files.size()) if files.apply(k).getName().startswith("shuffle_"))


def test_an_insert_leaves_no_rows_on_local_disks(spark, target):
    rng, before = random.Random(3), left_on_disk(spark)
    rows = [(str(k), "d1", "p1", f"{k} {rng.getrandbits(6000):x}", "1", "KZT", DAY, True) for k in range(2000)]
    relational.insert(target, "price_item", spark.createDataFrame(rows, ITEM))
    assert target.read("price_item").count() == 2000
    assert left_on_disk(spark) - before < 500_000


def test_decisions_in_turns(spark, target, monkeypatch):
    monkeypatch.setattr(relational, "AT_ONCE", 15)
    rows = [(str(k), "d1", "p1", f"n{k}", "1", "KZT", DAY, True) for k in range(40)]
    relational.insert(target, "price_item", spark.createDataFrame(rows, ITEM))
    relational.set_match(target, spark.createDataFrame([(str(k), "s1", 0.9) for k in range(0, 40, 2)], "item_id string, service_id string, match_confidence double"))
    assert {(r["item_id"], r["service_id"]) for r in target.read("price_item").collect()} == {(str(k), None if k % 2 else "s1") for k in range(40)}
    assert target.read("price_item").count() == 40 and len(target.table("price_item").parts(2)) > 1
