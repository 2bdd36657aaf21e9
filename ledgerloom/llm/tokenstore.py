"""Token ids in a content-addressed store: rolling hashes cut id streams into chunks, each unique chunk is stored once.

Layout of a store (a folder that any Spark reader can open):

* chunks/    Parquet: digest (16 bytes, blake2b of the payload), n (ids), payload (little-endian ids, 2 or 4 bytes each)
* recipes/   Parquet, one shard a file, shards and rows in ascending doc_id order: shard, row, doc_id, n_tokens, digests, root
* manifest/  one row a shard: shard, n_docs, n_tokens, first_doc, start, root, store_root (the Merkle root over the shards' roots)

A document's root is the Merkle root over its chunks' digests, a shard's root that over its documents' roots.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import _ODD, blocks, mix, small_batches, text_columns, wide

#: Chunks end where the rolling hash of the last 32 ids has TARGET_BITS zero bits, between MIN_IDS and MAX_IDS ids.
TARGET_BITS, MIN_IDS, MAX_IDS = 8, 64, 2048
END_ID = 2
#: Documents of a shard, about: what one task sorts and hashes when a store is written and read.
SHARD_DOCS = 200_000
#: Bytes of text encoded at once; a longer text stands alone.
AT_ONCE = 2 << 20
#: Words kept with their ids in each worker; longer words than this are encoded each time.
CACHE_WORDS, CACHE_WORD_BYTES = 1_000_000, 64
_GEAR = mix(np.arange(1 << 16, dtype=np.uint64) * _ODD)


#: Words of Latin-1 letters and trailing ASCII marks but no apostrophe: two pre-tokens, plain under any normal form.
_PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\[-`{-~]*)")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for the code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _word_by_word(file: dict) -> bool:
    """Whether a tokenizer's file says that a text's ids are its words' ids, joined.

    White space becomes one space and letters lower case before a pattern cuts what is neither; the pattern's matches hold
    no white space and the rest is removed; bytes are looked up without a prefix space; nothing is added behind.
    """
    steps = (file.get("normalizer") or {}).get("normalizers", [])
    kinds = [(x["type"], x.get("pattern", {}).get("Regex"), x.get("content")) for x in steps]
    cuts = (file.get("pre_tokenizer") or {}).get("pretokenizers", [])
    if kinds != [("NFC", None, None), ("Replace", r"\s+", " "), ("Lowercase", None, None)] or [x["type"] for x in cuts] != ["Split", "ByteLevel"] or file.get("post_processor"):
        return False
    split, letters = cuts
    return (split["behavior"], split["invert"], split["pattern"]) == ("Removed", True, {"Regex": _PATTERN}) and not letters["add_prefix_space"] and not letters["use_regex"] and file["model"]["type"] == "BPE" and not file["model"].get("dropout")


#: Fixed value: the pattern of the word tokenizer's file; none of its branches takes white space.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class WordEncoder:
    """Ids of whole texts.

    Where the tokenizer's file says that a text's ids are its words' ids joined (_word_by_word), words that a worker has
    seen are not encoded again; texts with the start of a special token, and all texts of other tokenizers, go to the
    tokenizer as they are.
    """

    def __init__(self, path: str, width: int = 4) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.word_by_word = _word_by_word(json.load(f))
        self.width = np.dtype(f"<u{width}")
        self.specials = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cache: dict[bytes, bytes] = {}
        letters = _byte_letters()
        self.alphabet = {c: "".join(letters[b] for b in chr(c).encode()) for c in range(256)}

    def plain(self, text: str) -> bytes:
        """Ids of one pre-token of lower-case Latin-1 letters or of ASCII marks, by the tokenizer's model alone."""
        key = text.encode()
        out = self.cache.get(key)
        if out is None:
            out = self.cache[key] = self.pack([t.id for t in self.tokenizer.model.tokenize(text.translate(self.alphabet))])
        return out

    def pack(self, ids: list[int]) -> bytes:
        return np.array(ids, self.width).tobytes()

    def whole(self, text: str) -> bytes:
        return self.pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if not self.word_by_word:
            return [self.pack(e.ids) for e in self.tokenizer.encode_batch([x or "" for x in texts], add_special_tokens=False)]
        cache = self.cache
        split = [(x or "").encode().lower().split() for x in texts]  # ASCII only; the tokenizer lower-cases as well
        unseen = set().union(*split).difference(cache)
        once: dict[bytes, bytes] = {}
        if unseen:
            if len(cache) + len(unseen) > CACHE_WORDS:
                once = {w: cache[w] for ws in split for w in ws if w in cache}
                cache.clear()
            todo = []
            for w in unseen:
                m = _PLAIN.fullmatch(w.decode()) if len(w) <= CACHE_WORD_BYTES else None
                if m:
                    a, b = m.groups()
                    cache[w] = self.plain(a.lower()) + self.plain(b) if b else self.plain(a.lower())
                else:
                    todo.append(w)
            for i in range(0, len(todo), 4096):
                part = todo[i : i + 4096]
                for w, e in zip(part, self.tokenizer.encode_batch([w.decode() for w in part], add_special_tokens=False), strict=True):
                    (cache if len(w) <= CACHE_WORD_BYTES else once)[w] = self.pack(e.ids)
        known = {**once, **{w: cache[w] for ws in split for w in ws if w in cache}} if once else cache
        out = [b"".join(itemgetter(*ws)(known)) if len(ws) > 1 else known[ws[0]] if ws else b"" for ws in split]
        for i, x in enumerate(texts):
            if x and "<|" in x and any(s in x.encode() for s in self.specials):
                out[i] = self.whole(x)
        return out


_encoders: dict[str, WordEncoder] = {}


def encoder_of(path: str) -> WordEncoder:
    """The worker's encoder of a file: kept from task to task with the words it knows."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def marks(ids: np.ndarray) -> np.ndarray:
    """Places where chunks may end, by content alone: a gear hash over the last 32 ids."""
    if not len(ids):
        return np.zeros(0, np.int64)
    h = _GEAR[ids & 0xFFFF] ^ (ids.astype(np.uint64) >> np.uint64(16))
    step = 1
    while step < 32:  # h[i] = sum of gear[id[i - j]] << j for j < 32, by doubling
        shifted = h.copy()
        shifted[step:] += h[:-step] << np.uint64(step)
        h, step = shifted, step * 2
    return np.flatnonzero((h >> np.uint64(64 - TARGET_BITS)) == 0) + 1


def ends(places: list[int], n: int) -> list[int]:
    """Ends of the chunks of n ids that may end at some places; those before MIN_IDS do not count."""
    if n <= MIN_IDS:
        return [n] if n else []
    out, last = [], 0
    for m in [*places, n]:
        while m - last > MAX_IDS:
            last += MAX_IDS
            out.append(last)
        if m - last >= MIN_IDS or m == n:
            if m > last:
                out.append(m)
            last = m
    return out


def cut(ids: np.ndarray) -> np.ndarray:
    """Ends of the chunks of an id stream."""
    n = len(ids)
    return np.array(ends([m for m in marks(ids).tolist() if m < n], n), np.int64)


def cut_all(ids: np.ndarray, sizes: np.ndarray) -> list[list[int]]:
    """Ends of the chunks of each of several id streams that stand one behind another.

    One pass over all: the hash at a stream's place knows ids of the one before only within its first 31 places, where no
    chunk ends (MIN_IDS).
    """
    stop = np.cumsum(sizes)
    start = stop - sizes
    places = marks(ids)
    low, high = np.searchsorted(places, start, "right").tolist(), np.searchsorted(places, stop, "left").tolist()
    spots = places.tolist()
    return [ends([m - a for m in spots[x:y]], n) for a, n, x, y in zip(start.tolist(), sizes.tolist(), low, high, strict=True)]


def digest(payload: bytes) -> bytes:
    return hashlib.blake2b(payload, digest_size=16).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root over leaves in order; an odd last node moves up as it is, no leaves give the digest of nothing."""
    level = leaves or [digest(b"")]
    while len(level) > 1:
        pairs = [digest(b"\1" + level[i] + level[i + 1]) for i in range(0, len(level) - 1, 2)]
        level = pairs + level[len(level) & ~1 :]
    return level[0]


def write(documents: DataFrame, path: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end_id: int | None = END_ID, shards: int | None = None) -> None:
    """Encodes every whole text (null: empty) and writes the store.

    Rows keep their own recipes even where texts or ids repeat; rows with equal doc_id are ordered by their ids' root.
    An empty table gives a store without rows.  One pass over the texts: tasks drop chunks they have seen, chunks are
    then dealt by digest, so only ids cross the network, and a chunk that every document holds crosses once a task.
    """
    small_batches(documents)
    spark = documents.sparkSession
    docs = text_columns(documents, doc_id=doc_id, text=text)
    raw = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("digests", pa.binary()), ("root", pa.binary()), ("digest", pa.binary()), ("n", pa.int32()), ("payload", pa.binary())])

    def encode(batches):
        encoder = encoder_of(tokenizer)
        narrow = encoder.tokenizer.get_vocab_size() <= 1 << 16 and (end_id is None or end_id < 1 << 16)
        width = np.dtype("<u2" if narrow else "<u4")
        if encoder.width != width:
            encoder.width = width
            encoder.cache.clear()
        end = encoder.pack([end_id]) if end_id is not None else b""
        seen: set[bytes] = set()
        for batch in batches:
            for part, _, _ in blocks(batch, "text", AT_ONCE):
                rows: list[tuple] = []
                new: list[tuple] = []
                payloads = [x + end for x in encoder.encode(part.column(1).to_pylist())]
                size = encoder.width.itemsize
                sizes = np.fromiter(map(len, payloads), np.int64, len(payloads)) // size
                stops = cut_all(np.frombuffer(b"".join(payloads), encoder.width), sizes)
                for who, payload, n_ids, own_stops in zip(part.column(0).to_pylist(), payloads, sizes.tolist(), stops, strict=True):
                    own, last = [], 0
                    for stop in own_stops:
                        chunk = payload[last * size : stop * size]
                        own.append(d := digest(chunk))
                        if d not in seen:
                            if len(seen) >= 2_000_000:  # bounded; a chunk may then be sent again
                                seen.clear()
                            seen.add(d)
                            new.append((d, stop - last, chunk))
                        last = stop
                    rows.append((who, n_ids, b"".join(own), merkle(own)))
                k = len(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[j] for r in rows] + [None] * len(new), raw[j].type) for j in range(4)] + [pa.array([None] * k + [c[j] for c in new], raw[j + 4].type) for j in range(3)], schema=raw)

    staged = f"{path}/staged"
    kinds = "doc_id long, n_tokens long, digests binary, root binary, digest binary, n int, payload binary"
    docs.mapInArrow(encode, kinds).write.option("compression", "zstd").parquet(staged)
    both = spark.read.schema(kinds).parquet(staged)  # recipes and chunks have columns of their own
    chunks, recipes = both.where("digest is not null").select("digest", "n", "payload"), both.where("root is not null").select("doc_id", "n_tokens", "digests", "root")
    n = shards or max(wide(spark), -(-recipes.count() // SHARD_DOCS))
    chunks.repartition(n, "digest").dropDuplicates(["digest"]).write.option("compression", "zstd").parquet(f"{path}/chunks")
    ordered = recipes.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), "root").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "root")
    ordered.withColumn("shard", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()).write.parquet(f"{path}/recipes")
    _drop(spark, staged)
    stored = spark.read.parquet(f"{path}/recipes")
    shard_roots = stored.groupBy("shard").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.min("doc_id").alias("first_doc"))
    totals = sorted(shard_roots.collect(), key=lambda r: r.shard)  # as many rows as shards
    roots = {r.shard: bytes(r.root) for r in _shard_roots(stored).collect()}
    top = merkle([roots[r.shard] for r in totals])
    start, rows = 0, []
    for r in totals:
        rows.append((r.shard, r.n_docs, r.n_tokens, r.first_doc, start, roots[r.shard], top))
        start += r.n_tokens
    spark.createDataFrame(rows, "shard int, n_docs long, n_tokens long, first_doc long, start long, root binary, store_root binary").coalesce(1).write.parquet(f"{path}/manifest")


def _shard_roots(stored: DataFrame) -> DataFrame:
    """Merkle root of each shard's documents in file order; a shard is one file, read in order by one task."""

    def roots(batches):
        own: dict[int, list] = {}
        for b in batches:
            for s, n, r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                own.setdefault(s, []).append((n, r))
        yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int32()), pa.array([merkle([r for _, r in sorted(v)]) for v in own.values()], pa.binary())], names=["shard", "root"])

    return stored.select("shard", "row", "root").repartition("shard").mapInArrow(roots, "shard int, root binary")


def _drop(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)  # noqa: SLF001


def _shift(n: int, known: dict) -> list[int]:
    """Columns of the linear map that appends n zero bytes to a crc32."""
    if n not in known:
        zeros = bytes(n)
        base = zlib.crc32(zeros, 0)
        known[n] = [zlib.crc32(zeros, 1 << i) ^ base for i in range(32)]
    return known[n]


def crc32_join(parts: list[tuple[int, int]], known: dict | None = None) -> int:
    """crc32 of joined pieces from (crc32, bytes) of each."""
    known = {} if known is None else known
    out = 0
    for crc, n in parts:
        if out:
            moved = 0
            for column in _shift(n, known):
                if out & 1:
                    moved ^= column
                out >>= 1
            out = moved
        out ^= crc
    return out


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Reads a store back: doc_id, start, n_tokens, ids_crc32 (over the ids as 32-bit little-endian), n_chunks, verified.

    Every stored chunk is read, its digest recomputed from its bytes; verified says that all chunks of the document were
    there, as long as the recipe says, that the Merkle root over the recomputed digests is the stored one, and that the
    recipes of its shard are those of the manifest: their number, tokens and Merkle root.  A store whose manifest does not
    add up to its own root, or that lacks a shard, is refused.  Chunks yield their crc32, which joins into that of the
    document, so no ids cross the network.
    """
    small_batches(spark)
    manifest = spark.read.parquet(f"{path}/manifest")
    recipes = spark.read.parquet(f"{path}/recipes")
    told = sorted(manifest.collect(), key=lambda r: r.shard)  # as many rows as shards
    found = {r.shard: (r.n_docs, r.n_tokens) for r in recipes.groupBy("shard").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).collect()}
    roots = {r.shard: bytes(r.root) for r in _shard_roots(recipes).collect()}
    if any(bytes(r.store_root) != merkle([bytes(x.root) for x in told]) for r in told) or set(found) != {r.shard for r in told}:
        raise ValueError(f"the manifest of {path} does not fit its shards")
    whole = [(r.shard, r.start, found[r.shard] == (r.n_docs, r.n_tokens) and roots[r.shard] == bytes(r.root)) for r in told]

    def inspect(batches):
        for b in batches:
            out = []
            for d, n, payload in zip(*(c.to_pylist() for c in b.columns), strict=True):
                width = len(payload) // n
                out.append((d, n if digest(payload) == d else -1, zlib.crc32(np.frombuffer(payload, f"<u{width}").astype("<u4").tobytes())))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.binary(), pa.int32(), pa.int64()))], names=["digest", "n", "crc"])

    chunks = spark.read.parquet(f"{path}/chunks").mapInArrow(inspect, "digest binary, n int, crc long")
    shards = spark.createDataFrame(whole, "shard int, shard_start long, shard_whole boolean")
    placed = recipes.withColumn("before", F.sum("n_tokens").over(W.partitionBy("shard").orderBy("row").rowsBetween(W.unboundedPreceding, -1)))
    pieces = recipes.select("shard", "row", _pieces())
    joined = pieces.join(chunks, "digest", "left").groupBy("shard", "row").agg(F.sort_array(F.collect_list(F.struct("pos", "n", "crc", "digest"))).alias("parts"))

    def combine(batches):
        known: dict = {}
        for b in batches:
            parts = b.column("parts")
            at = [0, *np.cumsum(pc.fill_null(pc.list_value_length(parts), 0).to_numpy(zero_copy_only=False)).tolist()]
            flat = parts.flatten()  # one array a field, not one object a chunk
            n, crc, own = (flat.field(i).to_pylist() for i in (1, 2, 3))
            crcs, verified = [], []
            for i, (tokens, root, fine) in enumerate(zip(*(b.column(c).to_pylist() for c in ("n_tokens", "root", "shard_whole")), strict=True)):
                x, y = at[i], at[i + 1]
                there = all(k is not None and k > 0 for k in n[x:y])
                crcs.append(crc32_join([(c, 4 * k) for c, k in zip(crc[x:y], n[x:y], strict=True)], known) if there else None)
                verified.append(there and fine and sum(n[x:y]) == tokens and merkle(own[x:y]) == root)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), b.column("n_tokens"), pa.array(crcs, pa.int64()), pa.array(np.diff(at).astype(np.int64)), pa.array(verified, pa.bool_())], names=["doc_id", "start", "n_tokens", "ids_crc32", "n_chunks", "verified"])

    whole = placed.join(shards, "shard").join(joined, ["shard", "row"], "left").select("doc_id", (F.col("shard_start") + F.coalesce("before", F.lit(0))).alias("start"), "n_tokens", "root", "shard_whole", "parts")
    return whole.mapInArrow(combine, "doc_id long, start long, n_tokens long, ids_crc32 long, n_chunks long, verified boolean")


def _pieces():
    """A recipe's chunks: pos and digest."""
    return F.posexplode(F.expr("transform(sequence(1, length(digests) - 15, 16), i -> substring(digests, i, 16))")).alias("pos", "digest")


def read_ids(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """doc_id and ids (array of int) of the documents whose doc_id is in `wanted`, all without one."""
    small_batches(spark)
    recipes = spark.read.parquet(f"{path}/recipes")
    if wanted is not None:
        recipes = recipes.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    pieces = recipes.select("shard", "row", "doc_id", _pieces())
    joined = pieces.join(spark.read.parquet(f"{path}/chunks"), "digest", "left").groupBy("shard", "row", "doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "n", "payload"))).alias("parts"))

    def ids(batches):
        for b in batches:
            out = [np.concatenate([np.frombuffer(p["payload"], f"<u{len(p['payload']) // p['n']}").astype(np.int64) for p in r]) if r else [] for r in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return joined.select("doc_id", "parts").mapInArrow(ids, "doc_id long, ids array<long>")
