"""Shared pieces: shared scratch tables, Arrow buffers and vectorised byte-level text handling."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at once by one task; bounds the numpy temporaries at about 40 times this.
BLOCK_BYTES = 1 << 20

ASCII_SPACE = (9, 10, 11, 12, 13, 32)


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share, under spark.checkpoint.dir (a temporary one where that is unset, and all is one machine)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/ledgerloom-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Writes df to the shared scratch folder and reads it again: cuts the lineage, and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path  # noqa: SLF001
    return out


def discard(df: DataFrame) -> None:
    """Deletes what materialize() wrote; only for tables that no later plan reads."""
    jvm = df.sparkSession._jvm  # noqa: SLF001
    path = jvm.org.apache.hadoop.fs.Path(df._scratch_path)  # noqa: SLF001
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)  # noqa: SLF001


def sweep(spark: SparkSession) -> None:
    """Has Spark delete the shuffles of plans that have run: else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark._jvm.System.gc()  # noqa: SLF001


def wide(spark: SparkSession) -> int:
    """Number of partitions for exchanges that Python tasks read whole."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows that go to a Python worker at once: texts are long, and a batch is held by the JVM and the worker, twice each.
ARROW_ROWS = 1000


def small_batches(df: DataFrame | SparkSession) -> None:
    """Sets the session's Arrow batches to ARROW_ROWS rows at most; called by each operator as it builds its plan."""
    conf = (df if isinstance(df, SparkSession) else df.sparkSession).conf
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(conf.get(name))
    if now <= 0 or now > ARROW_ROWS:
        conf.set(name, str(ARROW_ROWS))


def quoted(name: str) -> Column:
    """A column by its very name, whatever signs it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def spare(df: DataFrame, name: str) -> str:
    """A column name like `name` that df has not, in any case."""
    have = {c.lower() for c in df.columns}
    while name in have:
        name += "_"
    return name


def text_columns(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under fixed names; other columns, whatever their names, are left out."""
    return df.select(*[quoted(c).alias(name) for name, c in columns.items()])


def flat(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all strings one after another, and n + 1 offsets; null counts as empty."""
    if values.null_count:
        values = pc.fill_null(values, "")
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    large = pa.types.is_large_string(values.type) or pa.types.is_large_binary(values.type)
    _, offsets, data = values.buffers()
    if len(values) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if large else np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def blocks(batch: pa.RecordBatch, column: str, limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with about `limit` bytes of text each (a longer text stands alone), with their bytes and offsets."""
    i = batch.schema.get_field_index(column)
    _, at = flat(batch.column(i))
    n, start = len(at) - 1, 0
    while start < n:
        stop = int(np.searchsorted(at, at[start] + limit, "right")) - 1
        stop = min(n, max(stop, start + 1))
        part = batch.slice(start, stop - start)
        yield part, *flat(part.column(i))
        start = stop


def key_bound(n: int, wanted: int) -> int:
    """The bound up to which about `wanted` of n evenly spread 64-bit keys lie; all of them where there are no more."""
    return (1 << 63) - 1 if n <= wanted else -(1 << 63) + (wanted << 64) // n


def table_of(*codes: int) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(codes)] = True
    return out


#: Bytes of words that end at ASCII white space: [^\x20\x09-\x0D]+
SPACED = ~table_of(*ASCII_SPACE)
#: Bytes of words of letters and digits once A-Z are lower-cased: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
ALNUM = ~table_of(*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80))
ALNUM[65:91] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_ODD = np.uint64(0x9E3779B97F4A7C15)
_R = 0xD6E8FEB86659FD93 | 1
_R_INV = pow(_R, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: A random 64-bit value for each byte.
BYTE_VALUES = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _ODD)


def words(data: np.ndarray, at: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each run of kept bytes, and its text's number."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    inside = kept[data]
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    after[-1], after[:-1] = False, inside[1:]
    before[at[:-1][at[:-1] < len(data)]] = False
    after[at[1:][at[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(at, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = BYTE_VALUES) -> np.ndarray:
    """64-bit hash of each span of bytes, the same wherever the span stands."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * _power(_R, len(data)), out=total[1:])
    out = (total[ends] - total[starts]) * _power(_R_INV, len(data) + 1)[starts]
    return mix(out + (ends - starts).astype(np.uint64) * _ODD)


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each `size` values in a row: len(h) - size + 1 of them."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, step, have = None, 0, h, 1
    k = 0xC2B2AE3D27D4EB4F
    left = size
    while left:  # binary splitting of the window
        if left & 1:
            part = step[done : done + n]
            out = part.copy() if out is None else out * np.uint64(pow(k, have, 1 << 64)) + part
            done += have
        left >>= 1
        if left:
            step = step[:-have] * np.uint64(pow(k, have, 1 << 64)) + step[have:]
            have *= 2
    return mix(out)


def code_points(data: np.ndarray) -> np.ndarray:
    """Code points before each byte: n + 1 counts."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out


def per_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of a value per byte over each text."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
