"""Fixed plans with a keyword and a limit, the documents' section choice, and the example listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.errors import Refused
from ..sources.ledger import sorted_by_key
from .dataflow import with_total

MOST = {"rank_return": 5, "holding_weight": 5, "document_risk": 3}


def check(plan: str, keyword: str, limit: int) -> None:
    if plan not in MOST:
        raise Refused("UNKNOWN_PLAN", plan)
    if not keyword.strip() or len(keyword) > 40:
        raise Refused("KEYWORD_INVALID")
    if any(c in keyword for c in "%_\\"):
        raise Refused("LITERAL_KEYWORD_REQUIRED")
    if not 1 <= limit <= MOST[plan]:
        raise Refused("LIMIT_INVALID", str(limit))


def name_contains(df: DataFrame, name: str, keyword: str) -> DataFrame:
    """Rows whose name holds the keyword, whatever its case."""
    return df.where(F.col(name).ilike(f"%{keyword}%"))


def rank_return(products: DataFrame, observations: DataFrame, keyword: str, day: Column, limit: int) -> DataFrame:
    """Products whose name holds the keyword, by their value of that day, the highest first; matched_products counts them all."""
    check("rank_return", keyword, limit)
    found = name_contains(products, "product_name", keyword).join(sorted_by_key(observations).where(F.col("value_status").isin("present", "zero") & (F.col("applicable_date") == day)), "entity_id")
    rows = found.select("entity_id", "product_name", "observation_id", "numeric_value", "unit", "value_status", "applicable_date")
    return with_total(rows, "matched_products").orderBy(F.desc("numeric_value"), "entity_id").limit(limit)


def called(names: DataFrame, keyword: str) -> DataFrame:
    """names whose holding_name is the keyword, spaces aside."""
    return names.where(F.replace("holding_name", F.lit(" "), F.lit("")) == keyword.replace(" ", ""))


def holding_weight(products: DataFrame, holdings: DataFrame, names: DataFrame, keyword: str, limit: int) -> DataFrame:
    """Holders of what has that name (spaces aside), by weight, unknown weights last.

    holdings: subject_id, object_id, weight (null: unknown, never taken as zero); names: object_id, holding_name.
    products_with_known_weight below matched_products says that the order of the whole is not known: ranked is false.
    """
    check("holding_weight", keyword, limit)
    rows = holdings.join(called(names, keyword), "object_id").join(sorted_by_key(products).withColumnRenamed("entity_id", "subject_id"), "subject_id")
    total = rows.agg(F.count("*").alias("matched_products"), F.count("weight").alias("products_with_known_weight"))
    out = rows.crossJoin(F.broadcast(total)).withColumn("ranked", F.col("matched_products") == F.col("products_with_known_weight"))  # one row
    return out.orderBy(F.desc_nulls_last("weight"), "product_name", "subject_id").limit(limit)


def document_risk(chunks: DataFrame, documents: DataFrame, keyword: str, cutoff: Column, limit: int, section: str = "risk") -> DataFrame:
    """The first chunk of each eligible document that holds the keyword in that section, the latest documents first.

    The excerpt is cut only from text whose hash is the stored one; a chunk whose hash differs fails the query.
    """
    check("document_risk", keyword, limit)
    own = documents.where(F.col("cutoff_eligible") & (F.col("published_on") <= cutoff))
    hits = chunks.where((F.col("section_type") == section) & (F.instr("text", keyword) > 0)).join(own, "doc_id")
    first = hits.withColumn("_k", F.row_number().over(Window.partitionBy("doc_id").orderBy("ordinal", "chunk_id"))).where("_k = 1").drop("_k")
    top = with_total(first, "matched_documents").orderBy(F.desc("published_on"), "doc_id").limit(limit)
    return top.withColumn("excerpt", checked_excerpt(F.col("text"), F.col("content_hash"), keyword)).drop("text")


def checked_excerpt(text: Column, content_hash: Column, keyword: str) -> Column:
    wrong = F.raise_error(F.lit("DOCUMENT_HASH_MISMATCH")).cast("string")
    return F.when(F.sha2(text, 256) == content_hash, T.excerpt(text, keyword)).otherwise(wrong)


def canonical_sections(sections: DataFrame, concise: Column, wanted: tuple[str, ...]) -> DataFrame:
    """doc_id, section_type, ordinal of the sections that answer for a document.

    Of each wanted type the concise ones, all where there is none; a text that comes twice in a document counts once, for
    the first type by name.  sections: doc_id, section_type, ordinal, text.
    """
    own = sections.where(F.col("section_type").isin(*wanted)).withColumn("concise", concise)
    best = F.max("concise").over(Window.partitionBy("doc_id", "section_type"))
    kept = own.withColumn("best", best).where(F.col("concise") == F.col("best")).withColumn("h", F.sha2("text", 256))
    order = Window.partitionBy("doc_id", "h").orderBy("section_type", "ordinal")
    return kept.withColumn("_k", F.row_number().over(order)).where("_k = 1").select("doc_id", "section_type", "ordinal")


def missing_sections(documents: DataFrame, sections: DataFrame, wanted: tuple[str, ...]) -> DataFrame:
    """doc_id and section_type of the wanted types that a document has none of."""
    asked = documents.select("doc_id", F.explode(F.array(*[F.lit(w) for w in wanted])).alias("section_type"))
    return asked.join(sections.select("doc_id", "section_type"), ["doc_id", "section_type"], "left_anti")


def holdings_per_product(products: DataFrame, relations: DataFrame, predicate: str, limit: int = 15) -> DataFrame:
    """Products with edges of a predicate and how many; a product that is not listed has none in this sample."""
    n = relations.where(F.col("predicate_id") == predicate).groupBy(F.col("subject_id").alias("entity_id")).agg(F.count("*").alias("holdings"))
    return products.join(sorted_by_key(n), "entity_id").orderBy("product_family", "product_name", "entity_id").limit(limit)


def observed_with_locators(products: DataFrame, observations: DataFrame, evidence: DataFrame, keyword: str, limit: int = 10) -> DataFrame:
    """Values of products whose name holds the keyword, each beside its evidence and source."""
    rows = name_contains(products, "product_name", keyword).join(sorted_by_key(observations), "entity_id").join(sorted_by_key(evidence).select("observation_id", "evidence_id", "source_id"), "observation_id")
    return rows.orderBy("entity_id", "metric_id", "evidence_id").limit(limit)


def nearest_to_stored(vectors: DataFrame, limit: int = 5) -> DataFrame:
    """Vectors nearest by cosine to the one with the least id, itself left out: the anchor is one row, joined to all."""
    from ..functions.vectors import METRICS

    anchor = vectors.orderBy("vec_id").limit(1).select(F.col("vec_id").alias("anchor_id"), F.col("embedding").alias("anchor"))
    near = vectors.crossJoin(F.broadcast(anchor)).where("vec_id != anchor_id")
    return near.withColumn("distance", METRICS["cosine"](F.col("embedding"), F.col("anchor"))).orderBy("distance", "vec_id").limit(limit)
