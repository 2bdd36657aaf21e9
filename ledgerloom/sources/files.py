"""Readers with fixed headers: delimited text in any encoding, JSON records, ZIP members and workbooks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.errors import Refused


#: What Spark's own text readers decode.
_CHARSETS = ("iso-8859-1", "us-ascii", "utf-16", "utf-16be", "utf-16le", "utf-32", "utf-8")


def read_delimited(spark: SparkSession, path: str, columns: list[str], separator: str = ",", encoding: str = "utf-8") -> DataFrame:
    """Text columns of files whose header must be exactly `columns`; malformed rows fail instead of being dropped.

    Encodings that Spark's reader does not know (cp949) are decoded file by file; their header is checked as they are read.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    if encoding.lower() not in _CHARSETS:
        return spark.read.format("binaryFile").load(path).select("content").mapInArrow(lambda batches: _decoded(batches, columns, separator, encoding), schema)
    reader = spark.read.option("sep", separator).option("encoding", encoding)
    header = reader.option("header", True).csv(path).columns
    if header != columns:
        raise Refused("HEADER_MISMATCH", f"{header} is not {columns}")
    return reader.option("header", True).option("mode", "FAILFAST").schema(schema).csv(path)


def _rows(stream, columns: list[str], separator: str):
    """Batches of a text stream's rows; another header or row width fails."""
    import csv

    import pyarrow as pa

    lines = csv.reader(stream, delimiter=separator)
    if next(lines, None) != columns:
        raise ValueError("HEADER_MISMATCH")
    part: list[list[str]] = []
    batch = lambda: pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], pa.string()) for i in range(len(columns))], names=columns)
    for line in lines:
        if len(line) != len(columns):
            raise ValueError("ROW_WIDTH")
        part.append(line)
        if len(part) == 10_000:
            yield batch()
            part = []
    yield batch()


def _decoded(batches, columns: list[str], separator: str, encoding: str):
    import io

    for b in batches:
        for content in b.column(0).to_pylist():
            yield from _rows(io.TextIOWrapper(io.BytesIO(content), encoding, newline=""), columns, separator)


def read_json_rows(spark: SparkSession, path: str, rows_at: str, columns: list[str]) -> DataFrame:
    """Rows of an array at `rows_at` (dotted) in JSON files, as text columns; a file without the array fails."""
    record = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    kind: T.DataType = T.ArrayType(record)
    for name in reversed(rows_at.split(".")):
        kind = T.StructType([T.StructField(name, kind)])
    whole = spark.read.option("multiLine", True).schema(kind).json(path)
    checked = whole.select(F.when(F.col(rows_at).isNull(), F.raise_error(F.lit("ROWS_MISSING")).cast(T.ArrayType(record))).otherwise(F.col(rows_at)).alias("rows"))
    return checked.select(F.explode("rows").alias("r")).select("r.*")


def read_zip_members(spark: SparkSession, path: str, member: str, columns: list[str], separator: str = "\t", most_bytes: int = 1 << 30) -> DataFrame:
    """Rows of one delimited member of each archive; larger members, missing ones and other headers fail."""

    def rows(batches):
        import io
        import zipfile

        for batch in batches:
            for content in batch.column("content").to_pylist():
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    if z.getinfo(member).file_size > most_bytes:
                        raise ValueError("MEMBER_TOO_LARGE")
                    with z.open(member) as f:
                        yield from _rows(io.TextIOWrapper(f, "utf-8", newline=""), columns, separator)

    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(rows, schema)


def read_workbook(spark: SparkSession, path: str, columns: list[str], expected_rows: int | None = None) -> DataFrame:
    """Rows of a workbook's first sheet: exact header, short rows padded with null, wide rows and other counts refused."""
    try:
        import openpyxl
    except ImportError as e:  # optional library
        raise Refused("WORKBOOK_READER_MISSING") from e
    sheet = openpyxl.load_workbook(path, read_only=True, data_only=True).worksheets[0]
    lines = sheet.iter_rows(values_only=True)
    return workbook_rows(spark, [list(x) for x in lines], columns, expected_rows)


def workbook_rows(spark: SparkSession, lines: list[list], columns: list[str], expected_rows: int | None = None) -> DataFrame:
    if not lines or [c for c in lines[0] if c is not None] != columns:
        raise Refused("HEADER_MISMATCH")
    out = []
    for i, line in enumerate(lines[1:], 2):
        if any(c is not None for c in line[len(columns):]):
            raise Refused("ROW_TOO_WIDE", str(i))
        out.append([None if c is None else str(c) for c in line[: len(columns)]] + [None] * (len(columns) - len(line)))
    if expected_rows is not None and len(out) != expected_rows:
        raise Refused("ROW_COUNT", f"{len(out)} rows")
    return spark.createDataFrame(out, T.StructType([T.StructField(c, T.StringType()) for c in columns]))


#: Fixed value: header of a workbook's sheet that describes the columns of another.
SCHEMA_HEADER = ["순번", "컬럼명", "데이터타입", "Nullable", "컬럼코멘트"]


def check_schema_sheet(lines: list[list], columns: list[str]) -> None:
    """Refuses a schema sheet (its lines) whose header or whose named columns, in order, are not those expected."""
    if not lines or list(lines[0][:5]) != SCHEMA_HEADER or [x[1] for x in lines[1:] if len(x) > 1 and x[1] is not None] != columns:
        raise Refused("SOURCE_SCHEMA_MISMATCH")


def restore(spark: SparkSession, folder: str, expected: dict[str, tuple[list[str], int]]) -> dict[str, DataFrame]:
    """Tables of a backup folder, each a Parquet folder; refused if one's columns or number of rows is not the expected."""
    out = {name: spark.read.parquet(f"{folder}/{name}") for name in expected}
    for name, (columns, n) in expected.items():
        if out[name].columns != columns or out[name].count() != n:
            raise Refused("RESTORE_MISMATCH", name)
    return out


def read_quads(spark: SparkSession, path: str) -> DataFrame:
    """graph, s, p, o of N-Quads lines; o keeps its quotes and type."""
    pattern = r"^\s*(<[^>]*>|_:\S+)\s+(<[^>]*>)\s+(.+?)\s+(<[^>]*>)\s*\.\s*$"
    lines = spark.read.text(path).where(F.trim("value") != "")
    bad = F.when(~F.col("value").rlike(pattern), F.raise_error(F.lit("QUAD_MALFORMED")).cast("string")).otherwise(F.col("value"))
    return lines.select(*[F.regexp_extract(bad, pattern, i).alias(n) for i, n in ((4, "graph"), (1, "s"), (2, "p"), (3, "o"))])


def write_quads(df: DataFrame, path: str) -> None:
    df.select(F.concat_ws(" ", "s", "p", "o", "graph", F.lit("."))).write.text(path)


def values_relation(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A literal list of rows as a relation, small by construction."""
    return F.broadcast(spark.createDataFrame(rows, schema))
