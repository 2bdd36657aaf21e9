"""Document retrieval: trigram keyword search, exact vector search, rank fusion, chunking."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vectors import METRICS
from ..plans.errors import Refused

MAX_K = 50


def _k(k: int) -> int:
    if not 1 <= k <= MAX_K:
        raise Refused("TOP_K", str(k))
    return k


def keyword_topk(chunks: DataFrame, query: str, k: int, text: str = "text", ties: tuple[str, ...] = ("doc_id",), threshold: float = 0.0) -> DataFrame:
    """The k chunks most like the query by padded trigrams; the query's white space is collapsed and its case folded."""
    q = F.lit(" ".join(query.split()).casefold())
    scored = chunks.withColumn("score", T.set_similarity(T.padded_trigrams(F.col(text)), T.padded_trigrams(q))).where(F.col("score") > threshold)
    return scored.orderBy(F.desc("score"), *ties).limit(_k(k))


def vector_topk(vectors: DataFrame, query: list[float], k: int, metric: str = "cosine", vector: str = "embedding", ties: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    """The k nearest vectors by brute force; the query is a literal, vectors of another size are left out."""
    if metric not in METRICS:
        raise Refused("METRIC_UNKNOWN", metric)
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.where(F.size(vector) == len(query)).withColumn("distance", METRICS[metric](F.col(vector), q)).orderBy("distance", *ties).limit(_k(k))


def rank_fusion(lists: dict[str, DataFrame], identity: tuple[str, ...], k: int = 5, constant: int = 60) -> DataFrame:
    """Sum of 1 / (constant + rank) over lists of (identity, rank); ties by identity; an identity twice in a list is refused."""
    for name, hits in lists.items():
        if not hits.groupBy(*identity).count().where("count > 1").isEmpty():
            raise Refused("DUPLICATE_HIT", name)
    united = None
    for name, hits in lists.items():
        part = hits.select(*identity, F.col("rank"), F.lit(name).alias("list"))
        united = part if united is None else united.unionByName(part)
    fused = united.groupBy(*identity).agg(F.sum(F.lit(1.0) / (constant + F.col("rank"))).alias("score"), F.count("*").cast("long").alias("n_lists"))
    return fused.orderBy(F.round("score", 12).desc(), *identity).limit(_k(k))


def first_chunk(chunks: DataFrame, keyword: str, text: str = "text") -> DataFrame:
    """The first chunk of each document that holds the keyword."""
    w = Window.partitionBy("doc_id").orderBy("ordinal", "chunk_id")
    return chunks.where(F.instr(text, keyword) > 0).withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def eligible(documents: DataFrame, cutoff: str, zone: str = "Asia/Seoul") -> DataFrame:
    """Documents that were published, available and in force on the cutoff day in `zone`, with a version that is not blank."""
    day = F.to_date(F.lit(cutoff))
    at = lambda c: T.local_date(F.col(c), zone)
    return documents.where(
        (at("published_at") <= day) & (at("available_at") <= day) & (F.col("effective_from").isNull() | (F.col("effective_from") <= day)) & (F.col("effective_to").isNull() | (F.col("effective_to") >= day)) & F.col("document_version").rlike(r"\S"))


def canonical_document(documents: DataFrame) -> DataFrame:
    """One document per entity: summaries first, then the latest in force, then the latest published, then the least id."""
    order = [F.when(F.col("kind") == "summary", 0).otherwise(1), F.desc("effective_from"), F.desc("published_at"), F.asc("document_id")]
    return documents.withColumn("_k", F.row_number().over(Window.partitionBy("entity_id").orderBy(*order))).where("_k = 1").drop("_k")


_SECTIONS = (("risk", r"(?i)\brisks?\b|위험"), ("strategy", r"(?i)\b(strategy|objective)\b|전략|목적"), ("fee", r"(?i)\b(fees?|expenses?)\b|보수|수수료"))


def section_type(title: Column) -> Column:
    out = F.lit("other")
    for name, pattern in reversed(_SECTIONS):
        out = F.when(title.rlike(pattern), name).otherwise(out)
    return out


def chunk_text(text: str, least: int = 300, most: int = 800, overlap: int = 75) -> list[tuple[int, int]]:
    """Word ranges [start, end) of chunks: whole paragraphs up to `most` words, long ones cut at sentences or words.

    A chunk begins `overlap` words before the end of the one before; a last chunk under `least` words is evened out with
    its neighbour.
    """
    words = list(re.finditer(r"\S+", text))
    n = len(words)
    if not n:
        return []
    ends = {i + 1 for i in range(n - 1) if "\n\n" in text[words[i].end() : words[i + 1].start()]}
    stops = {i + 1 for i in range(n) if words[i].group()[-1] in ".!?"}
    out, start = [], 0
    while n - start > most:
        window = range(start + least, start + most + 1)
        end = max((e for e in window if e in ends), default=None) or max((e for e in window if e in stops), default=None) or start + most
        out.append((start, end))
        start = max(end - overlap, start + 1)
    out.append((start, n))
    if len(out) > 1 and out[-1][1] - out[-1][0] < least:
        a, b = out[-2][0], n
        middle = (a + b) // 2
        out[-2:] = [(a, min(b, middle + overlap // 2)), (max(a, middle - overlap // 2), b)] if b - a > most else [(a, b)]
    return out


def chunk_documents(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", **bounds: int) -> DataFrame:
    """doc_id, ordinal, start_word, end_word, text, content_hash of every chunk; of equal chunks of a document the first stays.

    Null and empty texts have no chunk; rows are independent, so repeated rows keep their own chunks.
    """

    def run(batches):
        for b in batches:
            rows = []
            for who, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                spans = [m.span() for m in re.finditer(r"\S+", t or "")]
                seen: set[str] = set()
                for x, y in chunk_text(t or "", **bounds):
                    piece = t[spans[x][0] : spans[y - 1][1]]
                    h = hashlib.sha256(piece.encode()).hexdigest()
                    if h not in seen:
                        rows.append((who, len(seen), x, y, piece, h))
                        seen.add(h)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))], names=["doc_id", "ordinal", "start_word", "end_word", "text", "content_hash"])

    source = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return source.mapInArrow(run, "doc_id long, ordinal long, start_word long, end_word long, text string, content_hash string")


def reconcile_embeddings(chunks: DataFrame, embeddings: DataFrame, dimension: int) -> DataFrame:
    """One row: missing, orphan, stale, duplicate and wrong_dimension counts of embeddings against chunks, by chunk_id and hash."""
    missing = chunks.join(embeddings, "chunk_id", "left_anti").agg(F.count("*").alias("missing"))
    orphan = embeddings.join(chunks, "chunk_id", "left_anti").agg(F.count("*").alias("orphan"))
    stale = embeddings.alias("e").join(chunks.alias("c"), "chunk_id").where(F.col("e.content_hash") != F.col("c.content_hash")).agg(F.count("*").alias("stale"))
    duplicate = embeddings.groupBy("chunk_id").count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicate"))
    wrong = embeddings.agg(F.count_if(F.size("embedding") != dimension).alias("wrong_dimension"))
    return missing.crossJoin(orphan).crossJoin(stale).crossJoin(duplicate).crossJoin(wrong)  # one row each


def quality_at_k(hits: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """Per mode: gold entries, those found among the first k, and recall; hits(mode, case_id, chunk_id, rank), gold(case_id, chunk_id)."""
    found = hits.where(F.col("rank") <= k).join(gold, ["case_id", "chunk_id"]).select("mode", "case_id", "chunk_id").distinct().groupBy("mode").agg(F.count("*").alias("found"))
    total = gold.agg(F.count("*").alias("n_gold"))
    return hits.select("mode").distinct().join(found, "mode", "left").crossJoin(F.broadcast(total)).select("mode", "n_gold", F.coalesce("found", F.lit(0)).alias("found"), (F.coalesce("found", F.lit(0)) / F.col("n_gold")).alias("recall"))


#: What a question about a topic looks for: section types, and the words of its query.
TOPICS: dict[str, tuple[tuple[str, ...], str]] = {
    "investment_strategy": (("investment_objective", "investment_strategy"), "투자 목적 주요 투자대상 투자 전략"),
    "risk_factor": (("risk_factor",), "주요 투자위험 위험 요인"),
    "official_update": (("official_update", "change_history"), "공식 변경 공시 변경 이력"),
    "product_structure": (("legal_structure",), "상품 구조 법적 구조"),
    "supporting_document": (("investment_objective", "investment_strategy", "risk_factor"), "공식 문서 근거"),
}


def explain(chunks: DataFrame, topic: str, k: int = 5, ties: tuple[str, ...] = ("doc_id", "chunk_id")) -> DataFrame:
    """The k chunks of a topic's sections most like its words; topics that are not listed are refused."""
    if topic not in TOPICS:
        raise Refused("TOPIC_UNKNOWN", topic)
    sections, words = TOPICS[topic]
    return keyword_topk(chunks.where(F.col("section_type").isin(*sections)), words, k, ties=ties)


def embed_missing(chunks: DataFrame, embeddings: DataFrame, embed, dimension: int) -> DataFrame:
    """embeddings with those of the chunks that have none of their present text; texts are embedded batch by batch.

    chunks: chunk_id, text, content_hash; embeddings: chunk_id, content_hash, embedding.  embed takes a list of texts and
    gives as many vectors; one of another size fails.  What is there is neither embedded again nor changed.
    """
    todo = chunks.join(embeddings.select("chunk_id", "content_hash"), ["chunk_id", "content_hash"], "left_anti").select("chunk_id", "content_hash", "text")

    def run(batches):
        for b in batches:
            vectors = embed(b.column(2).to_pylist())
            if len(vectors) != b.num_rows or any(len(v) != dimension for v in vectors):
                raise ValueError("EMBEDDING_DIMENSION_MISMATCH")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([list(map(float, v)) for v in vectors], pa.list_(pa.float32()))], names=["chunk_id", "content_hash", "embedding"])

    kind = chunks.schema["chunk_id"].dataType.simpleString()
    made = todo.mapInArrow(run, f"chunk_id {kind}, content_hash string, embedding array<float>")
    return embeddings.select("chunk_id", "content_hash", F.col("embedding").cast("array<float>").alias("embedding")).unionByName(made)


def check_same_metadata(lists: dict[str, DataFrame], identity: tuple[str, ...], columns: tuple[str, ...]) -> None:
    """Refuses lists of hits that say different things of the same hit: fusing them would mix versions."""
    united = None
    for hits in lists.values():
        part = hits.select(*identity, *columns)
        united = part if united is None else united.unionByName(part)
    if not united.groupBy(*identity).agg(F.count_distinct(F.struct(*columns)).alias("n")).where("n > 1").isEmpty():
        raise Refused("HIT_METADATA_DRIFT")
