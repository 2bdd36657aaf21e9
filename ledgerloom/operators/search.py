"""Entity search over identifiers, names and aliases; surfaces inside a text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

PER_MENTION, SIMILAR = 5, 0.30


def trigram_index(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """g, entity_id, sid (a name or alias of it), b (its number of trigrams): a row for each trigram of each surface.

    Written once in the order of g, it spares each search the trigrams of all names, and a search reads the row groups
    that hold its own.
    """
    surfaces = entities.select("entity_id", F.col("name").alias("surface")).unionByName(aliases.select("entity_id", F.col("alias").alias("surface")))
    own = surfaces.select("entity_id", T.padded_trigrams(F.col("surface")).alias("sg")).withColumn("sid", F.xxhash64("entity_id", "sg"))
    return own.select("entity_id", "sid", F.size("sg").alias("b"), F.explode("sg").alias("g"))


def store_index(index: DataFrame, path: str) -> DataFrame:
    """The index, written in the order of its trigrams and read again."""
    index.repartitionByRange("g").sortWithinPartitions("g").write.parquet(path)
    return index.sparkSession.read.parquet(path)


def match_entities(
    mentions: DataFrame, entities: DataFrame, identifiers: DataFrame, aliases: DataFrame, per_mention: int = PER_MENTION, similar: float = SIMILAR, index: DataFrame | None = None, most: int | None = None
) -> DataFrame:
    """mention_id, entity_id, strategy, score (millionths): four strategies united, the best one of each entity kept.

    identifier beats name, name beats alias, alias beats trigram; within a strategy the higher score, then the lesser id.
    Trigram candidates come from an equi-join on exploded trigrams (of `index`, see trigram_index, where one is stored), so
    no pair without a shared one is scored.  `most` bounds all candidates, by rank, then mention.
    """
    m = mentions.select("mention_id", "mention", T.compact_upper(F.col("mention")).alias("compact"))
    name = entities.select("entity_id", F.col("name").alias("surface"), T.compact_upper(F.col("name")).alias("compact"))
    alias = aliases.select("entity_id", F.col("alias").alias("surface"), T.compact_upper(F.col("alias")).alias("compact"))
    ident = identifiers.select("entity_id", T.compact_upper(F.col("identifier_value")).alias("compact"))
    exact = [m.join(d.select("entity_id", "compact"), "compact").select("mention_id", "entity_id", F.lit(p).alias("priority"), F.lit(s).alias("strategy"), F.lit(1_000_000).alias("score")) for p, s, d in ((1, "identifier", ident), (2, "name", name), (3, "alias", alias))]
    grams = m.select("mention_id", T.padded_trigrams(F.col("mention")).alias("mg"))
    index = trigram_index(entities, aliases) if index is None else index
    shared = grams.select("mention_id", F.size("mg").alias("a"), F.explode("mg").alias("g")).join(index, "g")
    scored = shared.groupBy("mention_id", "entity_id", "sid", "a", "b").agg(F.count("*").alias("both")).withColumn("s", F.col("both") / (F.col("a") + F.col("b") - F.col("both"))).where(F.col("s") >= similar)
    near = scored.select("mention_id", "entity_id", F.lit(4).alias("priority"), F.lit("trigram").alias("strategy"), T.millionths(F.col("s")).alias("score"))
    united = exact[0].unionByName(exact[1]).unionByName(exact[2]).unionByName(near)
    order = ["priority", F.desc("score")]
    best = united.withColumn("_k", F.row_number().over(Window.partitionBy("mention_id", "entity_id").orderBy(*order))).where("_k = 1").drop("_k")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("mention_id").orderBy(*order, "entity_id"))).where(F.col("rank") <= per_mention).select("mention_id", "entity_id", "strategy", "score", "rank")
    return ranked if most is None else ranked.orderBy("rank", "mention_id").limit(most)


def surfaces_in_text(surfaces: DataFrame, segments: list[str], least_length: int = 2) -> DataFrame:
    """Distinct surfaces that occur in one of a question's few segments, white space and case aside."""
    compact = ["".join(s.split()).upper() for s in segments]
    hit = F.lit(False)
    for s in compact:
        hit = hit | F.contains(F.lit(s), T.compact_upper(F.col("surface")))
    return surfaces.where((F.length(T.compact_upper(F.col("surface"))) >= least_length) & hit).distinct()
