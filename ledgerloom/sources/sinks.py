"""Exact, idempotent writes into versioned tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.errors import Refused


def record_hash(columns: list[str]):
    """sha256 of a row's canonical JSON: sorted keys, nulls kept."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}), 256)


def key_conflicts(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose rows differ."""
    return df.withColumn("_h", record_hash(df.columns)).groupBy(*keys).agg(F.countDistinct("_h").alias("versions"), F.count("*").alias("n")).where("versions > 1")


def dedupe_exact(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row a key; refuses keys whose rows differ."""
    if not key_conflicts(df, keys).isEmpty():
        raise Refused("KEY_CONFLICT", ",".join(keys))
    return df.dropDuplicates(keys)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)  # noqa: SLF001


def write_exact(df: DataFrame, path: str, keys: list[str]) -> int:
    """Appends rows whose keys are new; keys that are there must have equal rows, else nothing is written."""
    spark = df.sparkSession
    new = dedupe_exact(df, keys)
    if not _exists(spark, path):
        new.write.parquet(path)
        return new.count()
    there = spark.read.parquet(path).select(*df.columns)
    both = new.withColumn("_new", record_hash(df.columns)).join(there.withColumn("_old", record_hash(df.columns)).select(*keys, "_old"), keys)
    if not both.where("_new != _old").isEmpty():
        raise Refused("STORED_ROW_DRIFT", path)
    added = new.join(there.select(*keys), keys, "left_anti").select(*df.columns)
    n = added.count()
    added.write.mode("append").parquet(path)
    return n


def table_hash(df: DataFrame) -> tuple[int, int]:
    """Order-free content hash: rows, and the sum of their 64-bit hashes modulo 2^63; partial sums, one row back."""
    h = F.xxhash64(*sorted(df.columns))
    row = df.agg(F.count("*"), F.sum(h.cast("decimal(38,0)"))).first()
    return row[0], int(row[1] or 0) % (1 << 63)


def ordered_hash(df: DataFrame, keys: list[str]) -> str:
    """sha256 over row hashes in key order, read one partition at a time."""
    import hashlib

    out = hashlib.sha256()
    for row in df.withColumn("_h", record_hash(df.columns)).orderBy(*keys).select("_h").toLocalIterator():
        out.update(row[0].encode())
    return out.hexdigest()


def table_counts(tables: dict[str, DataFrame], version: str) -> dict[str, int]:
    return {n: t.where(F.col("dataset_version") == version).count() for n, t in tables.items()}


class Datasets:
    """Dataset versions: building, then ready, then the one active; kept as small Parquet folders, one a version."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def create(self, version: str, manifest_hash: str, cutoff_date: str) -> None:
        """Same call again is fine; another hash or cutoff is refused."""
        at = f"{self.path}/versions/dataset_version={version}"
        if _exists(self.spark, at):
            row = self.spark.read.parquet(at).first()
            if (row.manifest_hash, row.cutoff_date) != (manifest_hash, cutoff_date):
                raise Refused("DATASET_DRIFT", version)
            return
        self.spark.createDataFrame([(manifest_hash, cutoff_date, "building")], "manifest_hash string, cutoff_date string, status string").write.parquet(at)

    def all(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/versions")

    def activate(self, version: str, problems: list[DataFrame]) -> None:
        """Swaps the pointer if no check finds a row."""
        if any(not p.isEmpty() for p in problems):
            raise Refused("DATASET_INVALID", version)
        if self.all().where(F.col("dataset_version") == version).isEmpty():
            raise Refused("DATASET_UNKNOWN", version)
        self.spark.createDataFrame([(version,)], "dataset_version string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/active")

    def active(self) -> str | None:
        return self.spark.read.parquet(f"{self.path}/active").first()[0] if _exists(self.spark, f"{self.path}/active") else None

    def remove_building(self, version: str) -> None:
        """Drops a version that is not active."""
        if self.active() == version:
            raise Refused("DATASET_ACTIVE", version)
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/versions/dataset_version={version}")  # noqa: SLF001
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)  # noqa: SLF001


#: What must be checked of a version before it is activated.
COMPONENTS = ("tables", "graph", "vectors", "evidence")


class Lifecycle(Datasets):
    """Versions that go from building to validated or failed, from validated to active, and from active to retired; no other way.

    Each step is a record of its own that is written once, so that a step that is repeated finds what it left.
    """

    def _record(self, at: str, row: tuple, schema: str, code: str) -> None:
        where = f"{self.path}/{at}"
        if _exists(self.spark, f"{where}/_SUCCESS"):
            if tuple(self.spark.read.schema(schema).parquet(where).first()) != row:
                raise Refused(code, at)
            return
        self.spark.createDataFrame([row], schema).coalesce(1).write.mode("overwrite").parquet(where)

    def _manifest(self, version: str) -> str:
        at = f"{self.path}/versions/dataset_version={version}"
        if not _exists(self.spark, at):
            raise Refused("DATASET_NOT_FOUND", version)
        return self.spark.read.parquet(at).first().manifest_hash

    def state(self, version: str) -> str:
        self._manifest(version)
        if self.active() == version:
            return "active"
        if _exists(self.spark, f"{self.path}/activations/version={version}"):
            return "retired"
        at = f"{self.path}/validations/version={version}"
        return self.spark.read.parquet(at).first().status if _exists(self.spark, at) else "building"

    def require_building(self, version: str) -> None:
        """Tables of a version are written only while it is being built."""
        if self.state(version) != "building":
            raise Refused("DATASET_NOT_BUILDING", version)

    def finish_validation(self, version: str, manifest_hash: str, problems: list[DataFrame]) -> str:
        """validated if no check finds a row, else failed; for a version that is being built, against its own manifest."""
        self.require_building(version)
        if self._manifest(version) != manifest_hash:
            raise Refused("DATASET_MANIFEST_MISMATCH", version)
        status = "failed" if any(not p.isEmpty() for p in problems) else "validated"
        self._record(f"validations/version={version}", (manifest_hash, status), "manifest_hash string, status string", "VALIDATION_CONFLICT")
        return status

    def record_readiness(self, version: str, component: str, component_hash: str) -> None:
        if component not in COMPONENTS:
            raise Refused("COMPONENT_UNKNOWN", component)
        if self.state(version) != "validated":
            raise Refused("SUCCESSFUL_VALIDATION_REQUIRED", version)
        self._record(f"readiness/version={version}/component={component}", (component_hash,), "component_hash string", "READINESS_CONFLICT")

    def activate(self, version: str, problems: list[DataFrame] = []) -> None:  # noqa: B006  (never changed)
        """Makes a validated version the active one, once all COMPONENTS are ready; the one before is retired."""
        state = self.state(version)
        if state == "active":
            return
        if state != "validated":
            raise Refused("DATASET_NOT_VALIDATED", version)
        if not all(_exists(self.spark, f"{self.path}/readiness/version={version}/component={c}") for c in COMPONENTS):
            raise Refused("DATASET_READINESS_INCOMPLETE", version)
        self._record(f"activations/version={version}", (version,), "dataset_version string", "ACTIVATION_CONFLICT")
        super().activate(version, problems)

    def remove_building(self, version: str) -> None:
        self.require_building(version)
        super().remove_building(version)


def import_supplement(rows: DataFrame, identifiers: DataFrame, path: str, keys: list[str]) -> int:
    """Writes rows under the one entity that their identifier names; returns how many are new.

    rows: identifier_value and others; identifiers: identifier_value, entity_id.  A value that names no entity or several
    refuses all rows, before anything is written; rows that are there must be equal (write_exact), and are read back.
    """
    per = identifiers.groupBy("identifier_value").agg(F.min("entity_id").alias("entity_id"), F.count_distinct("entity_id").alias("n"))
    matched = rows.join(per, "identifier_value", "left")
    for code, broken in (("SUPPLEMENT_UNMATCHED", matched.where("n is null")), ("SUPPLEMENT_AMBIGUOUS", matched.where("n > 1"))):
        if not broken.isEmpty():
            raise Refused(code, str(broken.first().identifier_value))
    out = matched.drop("n", "identifier_value")
    n = write_exact(out, path, keys)
    there = rows.sparkSession.read.parquet(path).select(*out.columns)
    if not out.exceptAll(there.join(out.select(*keys), keys, "left_semi").select(*out.columns)).isEmpty():
        raise Refused("SUPPLEMENT_READ_BACK", path)
    return n
