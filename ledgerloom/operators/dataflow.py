"""Selection per key, unpivoting, identity resolution, cycles, checks and metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.errors import Refused
from ..sources.ledger import shared_folder


def latest_per_key(df: DataFrame, keys: list[str], date: str, cutoff: Column, first_seen: str) -> DataFrame:
    """The row with the latest date up to the cutoff of each key; ties keep the row seen first."""
    w = Window.partitionBy(*keys).orderBy(F.desc(date), F.asc(first_seen))
    return df.where(F.col(date) <= cutoff).withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def latest_filing(filings: DataFrame) -> DataFrame:
    """Two steps: the last filing of each (cik, series_id, report_date), then the last report of each (cik, series_id)."""
    a = Window.partitionBy("cik", "series_id", "report_date").orderBy(F.desc("filed_at"), F.desc("accession"))
    b = Window.partitionBy("cik", "series_id").orderBy(F.desc("report_date"))
    return filings.withColumn("_k", F.row_number().over(a)).where("_k = 1").withColumn("_k", F.row_number().over(b)).where("_k = 1").drop("_k")


def distinct_on(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in an order."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def with_total(df: DataFrame, name: str = "population") -> DataFrame:
    """Each row beside the number of all rows: a count and a join with its one row, no single-task window."""
    return df.crossJoin(F.broadcast(df.agg(F.count("*").alias(name))))


def hash_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """n rows by the order of sha256 of the key: the same rows every time."""
    return df.orderBy(F.sha2(F.col(key).cast("string"), 256), key).limit(n)


def ceiling(df: DataFrame, most: int = 10_000) -> list:
    """All rows, or a refusal where there are more: never a cut result."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise Refused("ROW_CEILING", str(most))
    return rows


def unpivot(df: DataFrame, ids: list[str], columns: list[str]) -> DataFrame:
    """One row per id and column: metric and its text value."""
    return df.unpivot([F.col(i) for i in ids], [F.col(c).cast("string").alias(c) for c in columns], "metric", "value")


def explode_ordered(df: DataFrame, column: str, name: str = "item") -> DataFrame:
    """An array's items with their places from 0."""
    return df.select(*[c for c in df.columns if c != column], F.posexplode(column).alias("ordinal", name))


def single_date(df: DataFrame, date: str, cutoff: Column) -> DataFrame:
    """One row: the date that all rows share, null unless there are rows, none lacks it, all agree and it is not after the cutoff."""
    s = df.agg(F.min(date).alias("a"), F.max(date).alias("b"), F.count("*").alias("n"), F.count(date).alias("m"))
    return s.select(F.when((F.col("n") > 0) & (F.col("n") == F.col("m")) & (F.col("a") == F.col("b")) & (F.col("b") <= cutoff), F.col("a")).alias("as_of"))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def conflicts(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Keys with several values in what should be fixed; null counts as a value."""
    sign = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    return df.groupBy(*keys).agg(F.countDistinct(sign).alias("n_values")).where("n_values > 1")


def resolve_identities(records: DataFrame) -> DataFrame:
    """record_id, entity_id, resolution over (record_id, kind, scheme, value).

    Records that share a global identifier belong together only in pairs: exactly one DomesticETF and one FundShareClass
    that share nothing with others are merged under the lesser id; all others that share something are AMBIGUOUS.  Sums
    per value (least and greatest record) tell it: no value's records are gathered, however many hold it.
    """
    kinds = F.min("kind").alias("kind_a"), F.max("kind").alias("kind_b")
    held = records.groupBy("scheme", "value").agg(F.min("record_id").alias("a"), F.max("record_id").alias("b"), F.count_distinct("record_id").alias("n"), *kinds).where("n > 1")
    pair = (F.col("n") == 2) & (F.col("kind_a") == "DomesticETF") & (F.col("kind_b") == "FundShareClass")
    shared = records.select("record_id", "scheme", "value").distinct().join(held.withColumn("pair", pair).drop("kind_a", "kind_b"), ["scheme", "value"])
    # every value that a record shares must name the same pair, for it and for the other one
    per = shared.groupBy("record_id").agg(F.min("a").alias("a"), F.max("a").alias("a2"), F.min("b").alias("b"), F.max("b").alias("b2"), F.min("pair").alias("pair"))
    own = per.withColumn("fine", F.col("pair") & (F.col("a") == F.col("a2")) & (F.col("b") == F.col("b2")))
    agreed = own.where("pair").groupBy("a", "b").agg(F.count_if("fine").alias("fine_ends"))
    good = own.join(agreed, ["a", "b"], "left").select("record_id", "a", (F.col("fine") & (F.coalesce("fine_ends", F.lit(0)) == 2)).alias("merge"))
    return records.select("record_id").distinct().join(good, "record_id", "left").select(
        "record_id", F.when(F.col("merge"), F.col("a")).otherwise(F.col("record_id")).alias("entity_id"),
        F.when(F.col("merge").isNull(), "SINGLE").when(F.col("merge"), "MERGED").otherwise("AMBIGUOUS").alias("resolution"))


#: Rounds in which edges that lie on no cycle are taken away one by one; what they leave is doubled.
TRIMS = 16


def in_cycles(edges: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """Nodes that reach themselves, however long the cycle; null ends are left out.

    First edges that lie on no cycle go: those that start where none ends or end where none starts, TRIMS rounds at most,
    each a pair of semi-joins; an ordinary graph without cycles is empty then.  Of what is left, `steps` are the pairs
    exactly 2^k edges apart and `reach` those up to 2^k apart, doubled and written out each round; a node that has reached
    itself is not followed any further, and the rounds (log2 of the longest way) end when no pair is new.
    """
    spark = edges.sparkSession
    reach, path = _written(edges.select(F.col(child).alias("start"), F.col(parent).alias("at")).dropna().distinct())
    have, before, trims = reach.count(), -1, 0
    while have != before and trims < TRIMS and have:
        kept = reach.join(reach.select(F.col("at").alias("start")), "start", "left_semi")
        kept = kept.join(reach.select(F.col("start").alias("at")), "at", "left_semi").select("start", "at")
        old = path
        reach, path = _written(kept)
        _deleted(spark, old)
        have, before, trims = reach.count(), have, trims + 1
    steps, steps_path = reach, path
    found: list[DataFrame] = []
    before = -1
    while have and have != before:
        own, _ = _written(reach.where("start = at").select(F.col("start").alias("node")).distinct())
        found.append(own)
        hop = steps.select(F.col("start").alias("at"), F.col("at").alias("end"))
        open_ = reach.join(own.select(F.col("node").alias("start")), "start", "left_anti").select("start", "at")
        further = open_.join(hop, "at").select("start", F.col("end").alias("at"))
        now, now_path = _written(open_.unionByName(further).distinct())
        have, before = now.count(), open_.count()
        after, after_path = _written(steps.join(hop, "at").select("start", F.col("end").alias("at")).distinct()) if have != before else (steps, None)
        for old in {path, steps_path} if after_path else ():
            _deleted(spark, old)
        reach, path = now, now_path
        if after_path:
            steps, steps_path = after, after_path
    none = edges.select(F.col(child).alias("node")).limit(0)
    return reduce(lambda a, b: a.unionByName(b), found, none).distinct()


def _written(df: DataFrame) -> tuple[DataFrame, str]:
    """df, written to a new folder that executors share and read again; the folder."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def _deleted(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)  # noqa: SLF001


def difference(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """Rows on one side only, with the side's name."""
    columns = expected.columns
    a = expected.select(columns).exceptAll(observed.select(columns)).withColumn("side", F.lit("expected"))
    return a.unionByName(observed.select(columns).exceptAll(expected.select(columns)).withColumn("side", F.lit("observed")))


def audit_values(source: DataFrame, ledger: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Full outer comparison of source cells and ledger values: verdict matched, differs, only_source or only_ledger."""
    s, t = source.select(*keys, F.col(value).alias("source_value"), F.lit(True).alias("_s")), ledger.select(*keys, F.col(value).alias("ledger_value"), F.lit(True).alias("_t"))
    return s.join(t, keys, "full_outer").select(*keys, "source_value", "ledger_value", F.when(F.col("_t").isNull(), "only_source").when(F.col("_s").isNull(), "only_ledger").when(F.col("source_value").eqNullSafe(F.col("ledger_value")), "matched").otherwise("differs").alias("verdict"))


def unsupported(rows: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """Rows without evidence."""
    return rows.join(evidence.select(key), key, "left_anti")


def not_ended(df: DataFrame, end: str, day: Column) -> DataFrame:
    """Rows whose end date (yyyyMMdd text) is blank, unreadable, or not before the day."""
    date = F.expr(f"try_to_date(`{end}`, 'yyyyMMdd')")
    return df.where(date.isNull() | (date >= day))


def known_weight_relations(relations: DataFrame, weights: DataFrame) -> DataFrame:
    """Relations without reported weights, or with some known one; none with a weight outside 0 to 100."""
    flags = weights.groupBy("relation_id").agg(F.max(F.col("weight").isNotNull()).alias("known"), F.max(F.coalesce(~F.col("weight").between(0, 100), F.lit(False))).alias("outside"))
    return relations.join(flags.where("not known or outside"), "relation_id", "left_anti")


def entity_classes(products: DataFrame, relations: DataFrame) -> DataFrame:
    """entity_id and its class names: the family's, and Supplied where an edge starts from it."""
    roles = relations.groupBy(F.col("subject_id").alias("entity_id")).agg(F.collect_set("predicate_id").alias("roles"))
    return products.join(roles, "entity_id", "left").select("entity_id", F.array_sort(F.concat(F.array("product_family"), F.when(F.array_contains("roles", "suppliedBy"), F.array(F.lit("Supplied"))).otherwise(F.array().cast("array<string>")))).alias("classes"))


def classification(pairs: DataFrame) -> DataFrame:
    """One row of micro precision, recall and F1 over (expected, predicted) flags."""
    c = pairs.agg(F.count_if(F.col("expected") & F.col("predicted")).alias("tp"), F.count_if(~F.col("expected") & F.col("predicted")).alias("fp"), F.count_if(F.col("expected") & ~F.col("predicted")).alias("fn"))
    p, r = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    return c.select("tp", "fp", "fn", p.alias("precision"), r.alias("recall"), F.try_divide(2 * p * r, p + r).alias("f1"))


def nearest_rank(df: DataFrame, column: str, percents: list[int]) -> DataFrame:
    """Nearest-rank percentiles."""
    return df.agg(*[F.expr(f"percentile_disc({p / 100}) WITHIN GROUP (ORDER BY `{column}`)").alias(f"p{p}") for p in percents])


def graph_violations(edges: DataFrame) -> DataFrame:
    """Shape checks of edges as one table of (shape, relation_id): loops, ends before starts, repeated edges."""
    loops = edges.where("subject_id = object_id").select(F.lit("loop").alias("shape"), "relation_id")
    ends = edges.where("valid_to < valid_from").select(F.lit("ends_before_start").alias("shape"), "relation_id")
    again = edges.groupBy("subject_id", "predicate_id", "object_id").agg(F.min("relation_id").alias("relation_id"), F.count("*").alias("n")).where("n > 1").select(F.lit("repeated").alias("shape"), "relation_id")
    return loops.unionByName(ends).unionByName(again)
