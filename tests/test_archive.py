"""Members of archives, dealt to tasks one by one."""

import io
import zipfile

from pyspark.sql import functions as F

from tarifflow.sources import archive


def zipped(files, **options):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", **options) as z:
        for name, data in files.items():
            z.writestr(name, data)
    return out.getvalue()


def test_members_as_stored_and_deflated():
    files = {"a.pdf": b"", "dir/b.pdf": b"x" * 10_000, "../c.pdf": "й".encode()}
    want = [("a.pdf", b"", None), ("dir/b.pdf", b"x" * 10_000, None), ("c.pdf", "й".encode(), None)]
    for method in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        assert list(archive.members(zipped(files, compression=method))) == want
    assert list(archive.members(b"before it" + zipped(files))) == want


def test_broken_members_are_error_rows():
    content = bytearray(zipped({"good.pdf": b"good" * 99, "bad.pdf": b"bad" * 99, "dir/": b"", "..": b"x"}, compression=zipfile.ZIP_DEFLATED))
    info = zipfile.ZipFile(io.BytesIO(content)).getinfo("bad.pdf")
    content[info.header_offset + 40] ^= 0xFF
    got = list(archive.members(bytes(content)))
    assert [(n, d, e is None) for n, d, e in got] == [("good.pdf", b"good" * 99, True), ("bad.pdf", None, False), ("..", None, False)]
    assert got[1][2].startswith("bad.pdf: ")
    packed = zipped({"x.pdf": b"x" * 99}, compression=zipfile.ZIP_BZIP2)
    assert list(archive.members(packed)) == [("x.pdf", b"x" * 99, None)]
    name, data, error = next(archive.members(packed.replace(b"BZh9", b"BZh0")))
    assert (name, data) == ("x.pdf", None) and error.startswith("x.pdf: ")


def test_a_thousand_members_spread_over_tasks(spark, tmp_path):
    (tmp_path / "many.zip").write_bytes(zipped({f"{k}.pdf": f"line {k} " * 500 for k in range(1000)}, compression=zipfile.ZIP_DEFLATED))
    (tmp_path / "broken.zip").write_bytes(b"junk")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = archive.read_files(spark, str(tmp_path)).select("name", "error", F.octet_length("content").alias("n"), F.spark_partition_id().alias("task")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert {r["name"]: r["n"] for r in got if not r["error"]} == {f"{k}.pdf": len(f"line {k} " * 500) for k in range(1000)}
    assert [r["error"][:8] for r in got if r["error"]] == ["archive:"]
    tasks = [r["task"] for r in got]
    assert len(set(tasks)) == 8 and max(map(tasks.count, set(tasks))) < 250
