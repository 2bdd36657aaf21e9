"""The evidence ledger: entities, observations, relations and evidence, pinned to one dataset version."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.errors import Refused

STATUSES = ("present", "zero", "missing", "placeholder", "unavailable", "inapplicable", "unknown")


@dataclass(frozen=True)
class Pin:
    """A dataset version, its content hash and its cutoff."""

    dataset_version: str
    manifest_hash: str
    cutoff_date: str


@dataclass(frozen=True)
class Ledger:
    """A thin bundle of DataFrames, each one version's rows.

    Observations of a stored ledger carry their lineage (LINEAGE), summed once as the version was written; others get it
    from observation_evidence as they are read.
    """

    pin: Pin
    products: DataFrame
    observations: DataFrame
    observation_evidence: DataFrame
    relations: DataFrame
    relation_evidence: DataFrame

    def hydrated(self, metric_ids: list[str]) -> DataFrame:
        """Observations of some metrics with evidence_ids and source_ids (null without evidence) and proven."""
        rows = self.observations.where(F.col("metric_id").isin(*metric_ids))
        if set(LINEAGE) <= set(rows.columns):
            return rows
        wanted = self.observation_evidence.join(sorted_by_key(rows.select("observation_id")), "observation_id", "left_semi")
        return rows.join(sorted_by_key(lineage(wanted)), "observation_id", "left").withColumn("proven", F.coalesce("proven", F.lit(False)))


    def proven_relations(self, predicate: str) -> DataFrame:
        """Relations of a predicate that have eligible evidence, with eligible_ids."""
        rows = self.relations.where(F.col("predicate_id") == predicate)
        if "eligible_ids" in rows.columns:
            return rows.where(F.col("eligible_ids").isNotNull())
        return rows.join(sorted_by_key(eligible_ids(self.relation_evidence)), "relation_id")


def sorted_by_key(df: DataFrame) -> DataFrame:
    """df as a side of a join that is sorted, whatever its size is taken for.

    Spark tells a table's size by its files' bytes: rows of a few distinct words, or that a stack or explode makes many of,
    are a hundred times as large in memory, and a broadcast gathers them in the driver.
    """
    return df.hint("merge")


#: What evidence says of an observation: all of it, where it comes from, and whether some may support a claim.
LINEAGE = ("evidence_ids", "source_ids", "proven")


def lineage(evidence: DataFrame) -> DataFrame:
    """One row for each observation that has evidence."""
    eligible = F.col("eligible_for_claim") & (F.col("cutoff_status") == "eligible")
    return evidence.groupBy("observation_id").agg(
        F.array_sort(F.collect_set("evidence_id")).alias("evidence_ids"), F.array_sort(F.collect_set("source_id")).alias("source_ids"), F.coalesce(F.max(eligible), F.lit(False)).alias("proven"))


def check_pin(datasets: DataFrame, pin: Pin) -> None:
    """Reads the version's one row and refuses if anything about it has changed."""
    rows = datasets.where(F.col("dataset_version") == pin.dataset_version).select("manifest_hash", F.col("cutoff_date").cast("string")).limit(2).collect()
    if len(rows) != 1 or tuple(rows[0]) != (pin.manifest_hash, pin.cutoff_date):
        raise Refused("DATASET_PIN_CHANGED", pin.dataset_version)


def scan(spark: SparkSession, path: str, pin: Pin) -> DataFrame:
    """One version's rows of a stored table; the version is a partition folder, so others are not read."""
    return spark.read.parquet(path).where(F.col("dataset_version") == pin.dataset_version)


def eligible_ids(evidence: DataFrame) -> DataFrame:
    """One row for each relation that has eligible evidence."""
    return evidence.where("eligible_for_claim and cutoff_status = 'eligible'").groupBy("relation_id").agg(F.array_sort(F.collect_set("evidence_id")).alias("eligible_ids"))


#: Tables of a stored ledger, and the folders each is dealt to within a version.
FOLDERS = {"products": ("product_family",), "observations": ("metric_id",), "observation_evidence": (), "relations": ("predicate_id",), "relation_evidence": ()}

#: Bytes of a row group. A task holds all of one until it is full, so Spark's 128 MB take more than a small heap from eight tasks at once.
ROW_GROUP = 16 << 20

#: Observations of a part as they are joined and sorted, about 10 MB of rows.  Where eight tasks share a heap of 750 MB, each may sort 33 MB.
PART_ROWS = 50_000


def store(ledger: Ledger, path: str) -> None:
    """Writes a version's tables: a folder for each version, in it one for each family, metric or predicate.

    Observations and relations are written with their lineage and in the order of entities, so that a query reads one metric's folder,
    joins no evidence, and skips row groups by entity.  A version that is there is not written again.
    """
    for name in FOLDERS:
        _store_table(ledger, path, name)


def _store_table(ledger: Ledger, path: str, name: str) -> None:
    df, folders = getattr(ledger, name), FOLDERS[name]
    target = f"{path}/{name}/dataset_version={ledger.pin.dataset_version}"
    if _exists(df.sparkSession, f"{target}/_SUCCESS"):
        return
    parts = _parts(df)
    if name == "observations":
        parts = max(parts, -(-df.count() // PART_ROWS))
        df = dealt(df, "observation_id", parts).join(sorted_by_key(lineage(dealt(ledger.observation_evidence, "observation_id", parts))), "observation_id", "left").withColumn("proven", F.coalesce("proven", F.lit(False)))
    if name == "relations":
        df = dealt(df, "relation_id").join(sorted_by_key(eligible_ids(dealt(ledger.relation_evidence, "relation_id"))), "relation_id", "left")
    order = "entity_id" if "entity_id" in df.columns else "subject_id" if "subject_id" in df.columns else None
    if order:  # few files a folder, each with a range of its own
        df = df.repartitionByRange(parts, *folders, order).sortWithinPartitions(*folders, order)
    df.write.partitionBy(*folders).option("parquet.block.size", ROW_GROUP).mode("overwrite").parquet(target)


def _parts(df: DataFrame) -> int:
    """All the shuffle's partitions, for rows that are sorted.

    Left to itself Spark puts them together to one for each core.  Their sorts then spill again and again in a small heap, and
    reading spills back takes a buffer of 1 MB or more for each.
    """
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def dealt(df: DataFrame, key: str, parts: int | None = None) -> DataFrame:
    """df by a key in all the shuffle's partitions or so many; whatever it is joined with by that key is sorted in as many."""
    return df.repartition(parts or _parts(df), key)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)  # noqa: SLF001


def stored(spark: SparkSession, path: str, pin: Pin) -> Ledger:
    """A version of a stored ledger; its folders tell families, metrics and predicates, so filters on them read no others."""
    return Ledger(pin, **{name: scan(spark, f"{path}/{name}", pin).drop("dataset_version") for name in FOLDERS})


class _Written:
    """A ledger that writes each table as it is first asked for, and reads it from there: a query of products waits for no edges."""

    def __init__(self, ledger: Ledger, path: str) -> None:
        self.pin, self._source, self._path = ledger.pin, ledger, path

    def __getattr__(self, name: str) -> DataFrame:
        if name not in FOLDERS:
            raise AttributeError(name)
        _store_table(self._source, self._path, name)
        df = scan(self._source.products.sparkSession, f"{self._path}/{name}", self.pin).drop("dataset_version")
        setattr(self, name, df)
        return df

    hydrated, proven_relations = Ledger.hydrated, Ledger.proven_relations


_STARS: dict[tuple[str, str], _Written] = {}


def star(spark: SparkSession, sf_dir: str) -> _Written:
    """The ledger over the star-schema tables, each written once for each application and folder and read from there."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _STARS:
        _STARS[at] = _Written(from_star_schema(spark, sf_dir), shared_folder(spark))
    return _STARS[at]


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share, in spark.checkpoint.dir; where that is unset a temporary one, on one machine only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise Refused("SHARED_FOLDER_MISSING", "spark.checkpoint.dir")
        base = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/ledgerloom-{uuid.uuid4().hex}"


def classify(value: Column, numeric: bool, zero_is_value: bool = True) -> Column:
    """Value status of a cleaned value: missing, zero or present (unknown for a zero that means nothing)."""
    out = F.when(value.isNull(), "missing")
    if numeric:
        out = out.when(value == 0, "zero" if zero_is_value else "unknown")
    return out.otherwise("present")


def status_violations(observations: DataFrame) -> DataFrame:
    """Rows whose status and values contradict each other: present and zero have one value, the others none and a reason."""
    columns = [c for c in ("numeric_value", "text_value", "boolean_value", "date_value", "timestamp_value") if c in observations.columns]
    filled = reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in columns])
    number = F.col("numeric_value")
    fine = (
        F.when(F.col("value_status") == "present", (filled == 1) & (number.isNull() | (number != 0)))
        .when(F.col("value_status") == "zero", (filled == 1) & number.isNotNull() & (number == 0))
        .when(F.col("value_status").isin(*STATUSES[2:]), (filled == 0) & (F.trim(F.coalesce("reason_code", F.lit(""))) != ""))
        .otherwise(False)
    )
    return observations.where(~F.coalesce(fine, F.lit(False)))


GRADES = ("AAA", "AA+", "AA0", "AA-", "A+", "BBB")


def from_star_schema(spark: SparkSession, sf_dir: str) -> Ledger:
    """A ledger over the star-schema tables: parts are products, their columns observations, supply edges relations.

    Every third part or so is a variant of the part with the next lower multiple of six as its key, some only until 1995;
    grade, maturity and remaining_days follow from the key.  promo_size is a part's size where its key is no multiple of 4 and else missing, and 0 where the size is over 45, so
    that every status the engine tells apart occurs; every seventh part has two evidence rows for each observation, every
    eleventh none.
    """
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    part = read("part")
    who = F.concat(F.lit("P:"), F.col("p_partkey").cast("string"))
    products = part.select(who.alias("entity_id"), F.col("p_name").alias("product_name"), F.col("p_type").alias("product_family"))
    promo = F.when(F.col("p_partkey") % 4 == 0, None).when(F.col("p_size") > 45, 0).otherwise(F.col("p_size"))
    values = part.select(
        "p_partkey", who.alias("entity_id"), F.col("p_retailprice").cast("decimal(38,12)").alias("price"), F.col("p_size").cast("decimal(38,12)").alias("size"),
        promo.cast("decimal(38,12)").alias("promo"), F.col("p_brand").alias("brand"), F.element_at(F.array(*[F.lit(g) for g in GRADES]), (F.col("p_partkey") % len(GRADES) + 1).cast("int")).alias("grade"),
        F.date_add(F.lit("1998-01-01").cast("date"), (F.col("p_partkey") % 400).cast("int")).alias("maturity"), (F.col("p_partkey") % 5 - 1).cast("decimal(38,12)").alias("remaining"))
    long = values.select("p_partkey", "entity_id", F.expr(
        "stack(7, 'part.retail_price', price, cast(null as string), cast(null as date), 'amount', 'part.size', size, null, null, 'unit',"
        " 'part.promo_size', promo, null, null, 'unit', 'part.brand', null, brand, null, null, 'part.grade', null, grade, null, null,"
        " 'part.maturity', null, null, maturity, null, 'part.remaining_days', remaining, null, null, 'day')"
        " as (metric_id, numeric_value, text_value, date_value, unit)"))
    filled = F.coalesce(F.col("numeric_value").cast("string"), "text_value", F.col("date_value").cast("string"))
    observations = long.select(
        F.concat_ws(":", F.lit("O"), "metric_id", F.col("p_partkey").cast("string")).alias("observation_id"), "entity_id", "metric_id", F.lit("1").alias("metric_definition_version"),
        F.when(filled.isNull(), "missing").when(F.col("numeric_value") == 0, "zero").otherwise("present").alias("value_status"),
        "numeric_value", "text_value", F.lit(None).cast("boolean").alias("boolean_value"), "date_value", "unit",
        F.when(F.col("unit") == "amount", "USD").alias("currency"), F.to_date(F.lit("1998-08-02")).alias("applicable_date"), F.when(filled.isNull(), "not_offered").alias("reason_code"), "p_partkey")
    copies = F.when(F.col("p_partkey") % 11 == 0, F.array()).when(F.col("p_partkey") % 7 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a")))
    evidence = observations.select("observation_id", "p_partkey", F.explode(copies.cast("array<string>")).alias("copy")).select(
        "observation_id", F.concat_ws(":", F.lit("E"), "observation_id", "copy").alias("evidence_id"), F.concat(F.lit("part-"), F.col("copy")).alias("source_id"),
        (F.col("p_partkey") % 5 != 0).alias("eligible_for_claim"), F.lit("eligible").alias("cutoff_status"))
    edges = read("lineitem").groupBy("l_partkey", "l_suppkey").agg(F.min(F.to_date("l_shipdate")).alias("first"), F.max(F.to_date("l_shipdate")).alias("last"))
    relations = edges.select(
        F.concat_ws(":", F.lit("R"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("relation_id"), F.concat(F.lit("P:"), F.col("l_partkey").cast("string")).alias("subject_id"),
        F.lit("suppliedBy").alias("predicate_id"), F.concat(F.lit("S:"), F.col("l_suppkey").cast("string")).alias("object_id"), F.col("first").alias("valid_from"),
        F.when((F.col("l_partkey") + F.col("l_suppkey")) % 3 != 0, F.col("last")).alias("valid_to"))
    main = F.col("p_partkey") - F.col("p_partkey") % 6
    variants = part.where((F.col("p_partkey") % 6).isin(1, 2) & (main > 0)).select(
        F.concat_ws(":", F.lit("V"), F.col("p_partkey").cast("string")).alias("relation_id"), who.alias("subject_id"), F.lit("variantOf").alias("predicate_id"), F.concat(F.lit("P:"), main.cast("string")).alias("object_id"),
        F.lit("1992-01-01").cast("date").alias("valid_from"), F.when(F.col("p_partkey") % 4 == 0, F.lit("1995-12-31").cast("date")).alias("valid_to"))
    relations = relations.unionByName(variants)
    relation_evidence = relations.select("relation_id", F.concat(F.lit("E:"), F.col("relation_id")).alias("evidence_id"), F.lit("lineitem").alias("source_id"), F.lit(True).alias("eligible_for_claim"), F.lit("eligible").alias("cutoff_status"))
    return Ledger(Pin("star", "", "1998-08-02"), products, observations.drop("p_partkey"), evidence, relations, relation_evidence)
