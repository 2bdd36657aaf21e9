"""Joins of a ledger stay off the driver though Spark takes its tables for small."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import DataFrame

from ledgerloom import integrity_queries, plan_queries  # noqa: F401  (they add their queries to the catalog)
from ledgerloom.catalog_queries import QUERIES
from ledgerloom.sources import ledger as L


@pytest.fixture
def trusting(spark):
    """A session that broadcasts whatever it takes for less than 1 GB."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def _broadcasts(df: DataFrame) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")  # noqa: SLF001


@pytest.fixture
def plans(monkeypatch):
    """The plans of the tables that are written, by name."""
    from pyspark.sql.readwriter import DataFrameWriter

    seen, put = {}, DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **b: (seen.__setitem__(path.split("/")[-2], self._df._jdf.queryExecution().executedPlan().toString()), put(self, path, *a, **b))[1])  # noqa: SLF001
    return seen


def test_storing_sorts_in_all_partitions(spark, sf_dir, plans):
    # Spark puts no partitions together that were asked for by number
    L.store(L.from_star_schema(spark, sf_dir), L.shared_folder(spark))
    assert [plans[t].count("REPARTITION_BY_NUM") for t in ("products", "observations", "relations")] == [1, 3, 3]
    assert "REPARTITION_BY_COL" not in "".join(plans.values()) and "ENSURE_REQUIREMENTS" not in plans["observations"]


def test_row_groups_are_small(spark, tmp_path):
    import pyarrow.parquet as pq
    from pyspark.sql import functions as F

    name = F.concat(*[F.sha2((F.col("id") * 400 + i).cast("string"), 512) for i in range(400)])  # 50 KB
    big = spark.range(0, 2400, numPartitions=1).select(F.concat(F.lit("P:"), F.col("id").cast("string")).alias("entity_id"), name.alias("product_name"), F.lit("f").alias("product_family"))
    L._store_table(L.Ledger(L.Pin("v", "", "1998-08-02"), big, big, big, big, big), f"file://{tmp_path}", "products")  # noqa: SLF001
    groups = [meta.row_group(i).total_byte_size for p in tmp_path.rglob("*.parquet") for meta in [pq.read_metadata(p)] for i in range(meta.num_row_groups)]
    assert sum(groups) > 100e6  # dealt to four tasks
    assert max(groups) < 20e6


def test_weights_are_summed_for_the_asked_name_only(spark, sf_dir):
    plan = QUERIES["holding_weight"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()  # noqa: SLF001
    assert plan.index("LeftSemi") > plan.index("sum(l_quantity")


def test_storing_broadcasts_nothing(trusting, sf_dir, monkeypatch):
    from pyspark.sql.readwriter import DataFrameWriter

    written = {}
    put = DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **b: (written.__setitem__(path.split("/")[-2], _broadcasts(self._df)), put(self, path, *a, **b))[1])
    L.store(L.from_star_schema(trusting, sf_dir), L.shared_folder(trusting))
    assert written == dict.fromkeys(L.FOLDERS, 0)


@pytest.mark.parametrize("name", ["lookup_fields", "rank_multi_key", "relation_open_ended", "prior_result_rank_then_screen", "agg_lineage_rows", "count_lineage_rows", "rank_return", "example_observed", "example_holdings", "claims_of_rows", "row_validation"])
def test_queries_broadcast_nothing(trusting, sf_dir, name):
    assert _broadcasts(QUERIES[name](trusting, sf_dir)) == (name == "rank_return")  # its one-row total


@pytest.mark.parametrize("name", ["agg_lineage_rows", "agg_max_group", "agg_min_group"])
def test_joined_partitions_stay_apart(spark, sf_dir, name):
    # several sorts of a task share its memory; of partitions put together they spill page by page
    df = QUERIES[name](spark, sf_dir)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()  # noqa: SLF001
    ran = plan[: plan.index("== Initial Plan ==")]
    assert re.search(r"SortMergeJoin \[entity_id", ran)
    assert not re.search(r"Sort \[entity_id#\d+ ASC NULLS FIRST\], false[^\n]*\n[^\n]*AQEShuffleRead", ran)


def test_a_plan_with_a_prior_result_is_dealt(spark, sf_dir):
    plan = QUERIES["prior_result_rank_then_screen"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()  # noqa: SLF001
    assert "REPARTITION_BY_NUM" in plan


def test_observations_are_dealt_by_their_number(spark, sf_dir, plans, monkeypatch):
    monkeypatch.setattr(L, "PART_ROWS", 100)
    L.store(L.from_star_schema(spark, sf_dir), L.shared_folder(spark))  # 1400 of them
    assert len(re.findall(r"(?:hash|range)partitioning\([^\n]*, 14\), REPARTITION_BY_NUM", plans["observations"])) == 3


def test_a_ledger_is_written_table_by_table(spark, sf_dir, tmp_path):
    ledger = L._Written(L.from_star_schema(spark, sf_dir), f"file://{tmp_path}/l")  # noqa: SLF001
    assert ledger.products.count() == 200
    assert [p.name for p in (tmp_path / "l").iterdir()] == ["products"]
    assert ledger.hydrated(["part.size"]).count() == 200
    assert sorted(p.name for p in (tmp_path / "l").iterdir()) == ["observations", "products"]
