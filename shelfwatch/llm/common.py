"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Used only where the session names no shared folder and runs on one machine (tests).
LOCAL_SHARED_DIR = "/tmp/checkpoints/shelfwatch"

#: What separates words in every contract of this subpackage: space and \t \n \v \f \r.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir.

    Where it is unset, a local folder if the master is local; on a cluster that raises, for executors would write where
    the driver can't read.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return LOCAL_SHARED_DIR


def shared_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


#: By application, the paths that operators have written and not discarded.
_written: dict[str, list[str]] = {}


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def discard_all(spark: SparkSession) -> None:
    """Delete what operators have written to the shared folder in this application: for callers who have read their results."""
    for path in _written.pop(spark.sparkContext.applicationId, []):
        _delete(spark, path)


def _stored(df: DataFrame, path: str, compression: str = "zstd") -> DataFrame:
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage and survives lost executors."""
    return _stored(df, shared_path(df.sparkSession, name))


class Scratch:
    """Written tables that an operator needs until it has written its result; drop deletes them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.n = spark, shared_path(spark, name), 0

    def table(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        return _stored(df, f"{self.path}/{self.n}-{name}")

    def drop(self) -> None:
        _delete(self.spark, self.path)


def with_columns_replaced(df: DataFrame, names: list[str]) -> DataFrame:
    """df without the columns called names (compared as Spark does, without case), so that an operator can add its own."""
    taken = {n.lower() for n in names}
    return df.select([df[f"`{c}`"] for c in df.columns if c.lower() not in taken])


def schema_with(df: DataFrame, added: str) -> T.StructType:
    """df's schema and the fields of a DDL string; df's own schema isn't touched."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(added).fields])


def utf8_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string or binary Arrow array without copying the text; nulls are empty."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return np.zeros(n + 1, np.int64), np.zeros(0, np.uint8)
    off = np.frombuffer(offsets, kind, n + 1 + column.offset)[column.offset:].astype(np.int64)
    raw = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return off - off[0], raw[off[0]: off[-1]]


def doc_slices(offsets: np.ndarray, most: int):
    """Row ranges (i, j) whose bytes come to most at most; a longer row gets a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def code_point_key(column):
    """Sort key by code point with nulls last: UTF-8 order is code-point order."""
    return column.asc_nulls_last()


def crc_text(column):
    """crc32 of a column's text form."""
    return F.crc32(column.cast("string").cast("binary"))


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of each range, one range after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - sizes), sizes)


KEPT_POWERS = 1 << 20  # bytes whose powers a worker keeps; a longer text has its own computed


def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Powers of two odd 64-bit bases, up, and of their inverses."""
    out = []
    for base in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        for x in (base, pow(base, -1, 1 << 64)):
            p = np.full(n, np.uint64(x))
            p[0] = 1
            out.append(np.multiply.accumulate(p))
    return out[0], out[1], out[2], out[3]


@lru_cache(maxsize=1)
def _kept_powers() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return _powers(KEPT_POWERS)


_BYTE_CODES = np.random.default_rng(7).integers(1, 2**63, (2, 256), dtype=np.uint64) | np.uint64(1)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each byte range, by prefix sums of polynomial codes."""
    up1, down1, up2, down2 = _kept_powers() if len(data) <= KEPT_POWERS else _powers(len(data))
    out = []
    for codes, up, down in ((_BYTE_CODES[0], up1, down1), (_BYTE_CODES[1], up2, down2)):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(codes[data] * up[: len(data)], out=sums[1:])
        out.append((sums[ends] - sums[starts]) * down[starts])
    return out[0], out[1]
