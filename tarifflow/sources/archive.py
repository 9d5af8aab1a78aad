"""Files and members of archives as rows.

A row that can't be read has an error instead of content, and the job goes on.
"""

from __future__ import annotations

import io
import lzma
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import files as N

FILES = "path string, name string, content binary, error string"
STORED = "path string, name string, method int, checksum bigint, data binary, error string"
_ESCAPE = re.compile("#U([0-9A-Fa-f]{4})")


def decode_name(name: str) -> str:
    """`#UXXXX` is the character of that code point."""
    return _ESCAPE.sub(lambda m: chr(int(m[1], 16)), name)


def safe_name(name: str) -> str:
    """A member's path without parts that lead out of the archive."""
    return "/".join(p for p in name.replace("\\", "/").split("/") if p not in ("", ".", ".."))


def entries(content: bytes) -> Iterator[tuple[str, int, int, bytes | None, str | None]]:
    """(name, method, checksum, data as it is stored, error) of each file of a zip archive, unsupported ones too."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile as error:
        yield "", 0, 0, None, f"archive: {error}"
        return
    for info in archive.infolist():
        name = safe_name(decode_name(info.filename))
        if info.is_dir():
            continue
        if not name:
            yield info.filename, 0, 0, None, f"unsafe archive member: {info.filename}"
            continue
        at = info.header_offset
        if info.flag_bits & 1:
            yield name, 0, 0, None, f"{name}: it is encrypted"
        elif info.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
            # rare methods are read here
            try:
                yield name, zipfile.ZIP_STORED, info.CRC, archive.read(info), None
            except (zipfile.BadZipFile, NotImplementedError, RuntimeError, OSError, EOFError, lzma.LZMAError) as error:
                yield name, 0, 0, None, f"{name}: {error}"
        elif content[at : at + 4] != b"PK\3\4":
            yield name, 0, 0, None, f"{name}: no file header"
        else:
            # a header of its own before the data, of 30 bytes, the name and more
            start = at + 30 + sum(struct.unpack_from("<2H", content, at + 26))
            yield name, info.compress_type, info.CRC, content[start : start + info.compress_size], None


def inflate(method: int, checksum: int, data: bytes) -> bytes:
    out = data if method == zipfile.ZIP_STORED else zlib.decompress(data, -zlib.MAX_WBITS)
    if zlib.crc32(out) != checksum:
        raise zipfile.BadZipFile("bad checksum")
    return out


def _opened(name: str, method: int, checksum: int, data: bytes | None, error: str | None) -> tuple[bytes | None, str | None]:
    if error is None:
        try:
            return inflate(method, checksum, data), None
        except (zipfile.BadZipFile, zlib.error) as problem:
            error = f"{name}: {problem}"
    return None, error


def members(content: bytes) -> Iterator[tuple[str, bytes | None, str | None]]:
    """(name, content, error) of each file of a zip archive."""
    for name, *stored in entries(content):
        yield name, *_opened(name, *stored)


def _listed(batches):
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for name, method, checksum, data, error in entries(content):
                row = {"path": [path], "name": [name], "method": pa.array([method], pa.int32()), "checksum": [checksum], "data": pa.array([data], pa.binary()), "error": pa.array([error], pa.string())}
                yield pa.RecordBatch.from_pydict(row)


def _inflated(batches):
    for batch in batches:
        for k in range(batch.num_rows):
            path, name, *stored = (batch.column(c)[k].as_py() for c in range(6))
            data, error = _opened(name, *stored)
            row = {"path": [f"{path}!/{name}"], "name": [name.rpartition("/")[2]], "content": pa.array([data], pa.binary()), "error": pa.array([error], pa.string())}
            yield pa.RecordBatch.from_pydict(row)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, content, error) of every supported file under `path` and every member of its zip archives."""
    return files_of(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))


def files_of(found: DataFrame) -> DataFrame:
    """The same from binaryFile rows, batch or stream."""
    plain = found.where(N.is_supported(F.col("path"))).select("path", N.base_name(F.col("path")).alias("name"), "content", F.lit(None).cast("string").alias("error"))
    # an archive is read by one task and only cut there; its members are dealt out as they are stored, then inflated and read
    stored = found.where(N.suffix(F.col("path")) == "zip").select("path", "content").mapInArrow(_listed, STORED)
    zipped = stored.repartition("path", "name").mapInArrow(_inflated, FILES)
    return plain.unionByName(zipped)


def with_identity(files: DataFrame) -> DataFrame:
    """Files with doc_id, partner_id, partner name, format and date that their names tell; ids are the same in every run."""
    return files.select(
        "*",
        N.stable_id(F.lit("document"), F.col("path")).alias("doc_id"),
        N.stable_id(F.lit("partner"), F.col("path")).alias("partner_id"),
        N.guess_partner_name(F.col("name")).alias("partner_name"),
        N.suffix(F.col("name")).alias("file_format"),
        N.guess_effective_date(F.col("name")).alias("effective_date"),
    )
