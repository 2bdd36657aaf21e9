"""Language ID by compression: per-language zstandard raw-content dictionaries, the smallest encoding wins."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import key_bound, quoted, small_batches, text_columns

#: Bytes of the raw-content dictionary of one language, and rows looked at for it: the bounds of the fitted sample.
DICTIONARY_BYTES = 112 << 10
SAMPLE_ROWS = 400
#: Rows looked at for one that a dictionary takes.
SPARE = 4
#: A dictionary goes to every worker for each label: more labels are refused, so that is 28 MB at most.
MAX_LANGUAGES = 256
#: Text is encoded in pieces, so that each piece leans on the dictionary and not on the text's own beginning.
PIECE_BYTES = 4096
#: Relative gap of the two smallest encodings below which the prediction is rejected.  Of 1960 held-out texts of sf0.1 it
#: rejects 1.1 % (ties alone are 0.9 %), of texts of random letters all, of texts that mix two languages by words 87 %.
MIN_MARGIN = 0.05
LEVEL = 5

#: Everything in ASCII but letters becomes a space.
_SPACED = bytes(b if not b < 128 or chr(b).isalpha() else 32 for b in range(256))


def letters(text: str) -> bytes:
    """Lower-cased words of letters, one space between them: what is encoded, and what dictionaries hold."""
    return b" ".join(text.lower().encode().translate(_SPACED).split())


_LETTER = re.compile(r"[^\W\d_]")


class Model:
    """Dictionaries by language; compressors are made in each worker."""

    def __init__(self, samples: dict[str, bytes]) -> None:
        self.languages = sorted(samples)
        self.samples = [samples[x] for x in self.languages]
        self._compressors: list | None = None

    def __getstate__(self):
        return {"languages": self.languages, "samples": self.samples, "_compressors": None}

    def compressors(self) -> list:
        if self._compressors is None:
            self._compressors = []
            for x in self.samples:
                d = zstandard.ZstdCompressionDict(x, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=LEVEL)
                self._compressors.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))
        return self._compressors

    def sizes(self, data: bytes) -> list[int]:
        pieces = [data[i : i + PIECE_BYTES] for i in range(0, len(data), PIECE_BYTES)]
        return [sum(len(c.compress(p)) for p in pieces) for c in self.compressors()]

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, accepted)."""
        if not text or not self.languages or not _LETTER.search(text):
            return "und", 0.0, False
        sizes = self.sizes(letters(text))
        order = np.argsort(sizes, kind="stable")  # ties go to the first language by name
        best = sizes[order[0]]
        margin = 1.0 if len(sizes) == 1 else (sizes[order[1]] - best) / max(1, sizes[order[1]])
        return self.languages[order[0]], float(1 / (1 + np.exp(-40 * margin))), bool(margin >= MIN_MARGIN)


def held_out(doc_id: str = "doc_id"):
    """Rows that are never learned from: crc32 of the id as text is a multiple of 5."""
    return F.coalesce(F.crc32(quoted(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Fits one dictionary a language on SAMPLE_ROWS rows of it at most (the rows with the smallest hashed ids), never held-out ones.

    Each row gives its middle DICTIONARY_BYTES / SAMPLE_ROWS bytes and more, so that no few texts fill a dictionary.
    """
    small_batches(documents)
    docs = text_columns(documents, doc_id=doc_id, text=text, lang=lang)
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out() & F.col("text").rlike("[\\p{L}]"))
    per_row = max(256, 4 * DICTIONARY_BYTES // SAMPLE_ROWS)
    piece = F.expr(f"substring(text, cast(1 + (length(text) - least(length(text), {per_row})) / 2 as int), {per_row})")
    key = F.xxhash64("doc_id", "text")
    # counts without text tell how small a key must be: what is gathered for the choice does not grow with the input
    counts = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if not counts:
        return Model({})
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    bounds = F.create_map(*[F.lit(x) for r in counts for x in (r.lang, key_bound(r.n, SPARE * SAMPLE_ROWS))])
    ranked = known.select("lang", key.alias("k"), piece.alias("piece")).where(F.col("k") <= bounds[F.col("lang")])
    chosen = _smallest(ranked).toPandas()
    samples = {}
    for language, rows in chosen.sort_values(["lang", "k", "piece"]).groupby("lang"):
        joined = b" ".join(letters(x) for x in dict.fromkeys(rows["piece"]))
        samples[language] = joined[:DICTIONARY_BYTES] if len(joined) > 8 else joined + b" " * 8
    return Model(samples)


def _smallest(ranked: DataFrame) -> DataFrame:
    """SAMPLE_ROWS rows of each language with the smallest keys, first within each task, then over all."""

    def local(batches):
        import heapq

        kept: dict[str, list] = {}
        for b in batches:
            for language, k, piece in zip(*(c.to_pylist() for c in b.columns), strict=True):
                heap = kept.setdefault(language, [])
                if len(heap) < SAMPLE_ROWS:
                    heapq.heappush(heap, (-k, piece))
                elif -k > heap[0][0]:
                    heapq.heapreplace(heap, (-k, piece))
        rows = [(language, -k, piece) for language, heap in kept.items() for k, piece in heap]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], names=["lang", "k", "piece"])

    schema = "lang string, k long, piece string"
    return ranked.mapInArrow(local, schema).repartition(16, F.abs(F.hash("k")) % 16).mapInArrow(local, schema).coalesce(1).mapInArrow(local, schema)


def identify(documents: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", keep: bool = False) -> DataFrame:
    """Predicts the language of every whole text.

    Returns doc_id, held_out, lang_pred, score (0 to 1), accepted (false where the margin is narrow); with `keep` also
    `kept`, the whole row as a struct, so that no column of it can clash with these.  Null texts and texts without a
    letter get `und`, score 0, not accepted; rows are independent, so repeated rows and ties (the first language by name)
    need no order; an empty table gives an empty result.
    """
    small_batches(documents)
    docs = documents.select(quoted(doc_id).alias("doc_id"), held_out(doc_id).alias("held_out"), *([F.struct(*[quoted(c) for c in documents.columns]).alias("kept")] if keep else [quoted(text).alias("text")]))
    shared = documents.sparkSession.sparkContext.broadcast(model)
    place = documents.columns.index(text)
    schema = T.StructType([*docs.schema.fields[: 3 if keep else 2], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())])

    def predict(batches):
        for b in batches:
            texts = pc.struct_field(b.column(2), [place]) if keep else b.column(2)
            out = [shared.value.predict(x.as_py()) for x in texts]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[: 3 if keep else 2], pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64()), pa.array([x[2] for x in out], pa.bool_())], names=schema.names)

    return docs.mapInArrow(predict, schema)
