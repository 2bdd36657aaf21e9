"""Benchmark decontamination: a broadcast set of hashed test n-grams, scanned over every document, hits verified word by word."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, BYTE_VALUES, LOWER, blocks, discard, materialize, quoted, small_batches, span_hashes, text_columns, window_hashes, words

WINDOW = 13
#: Above this many windows the set is dealt over several passes instead of one broadcast (40 bytes a window).
BROADCAST_WINDOWS = 2_000_000

_VALUES = BYTE_VALUES[LOWER]


#: Stands for an item without an id: its windows are hits, and it counts as no item.
_NO_ITEM = -(1 << 63)


def _digest(lowered: list[bytes]) -> bytes:
    return hashlib.blake2b(b"\0".join(lowered), digest_size=16).digest()


def item_windows(items: DataFrame, size: int) -> DataFrame:
    """n (words), hash, digest (of the words) and item_id of each distinct window of benchmark texts, made by the executors."""

    def emit(batches):
        for batch in batches:
            for part, data, at in blocks(batch, "text"):
                starts, ends, doc = words(data, at, ALNUM)
                hashes = span_hashes(data, starts, ends, _VALUES)
                lowered = LOWER[data].tobytes()
                base = np.searchsorted(doc, np.arange(len(at))).tolist()
                for k, item in enumerate(part.column(0).to_pylist()):
                    a, b = base[k], base[k + 1]
                    if a == b:
                        continue
                    n = min(size, b - a)
                    seen = [lowered[x:y] for x, y in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True)]
                    h = window_hashes(hashes[a:b], n).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([n] * len(h), pa.int32()), pa.array(h), pa.array([_digest(seen[i : i + n]) for i in range(len(h))], pa.binary()), pa.array([item] * len(h), pa.int64())], names=["n", "hash", "digest", "item_id"])

    return items.mapInArrow(emit, "n int, hash long, digest binary, item_id long").distinct()


class WindowSet:
    """Sorted hashes of windows by their length, with the digests and items behind each, all as plain arrays."""

    def __init__(self, table: pa.Table) -> None:
        length = table.column("n").to_numpy().astype(np.int64)
        h = table.column("hash").to_numpy().view(np.uint64)
        digests = np.frombuffer(b"".join(table.column("digest").to_pylist()), "S16") if len(h) else np.zeros(0, "S16")
        items = table.column("item_id").fill_null(_NO_ITEM).to_numpy()
        self.known: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in np.unique(length).tolist():
            own = np.flatnonzero(length == n)
            own = own[np.argsort(h[own], kind="stable")]
            self.known[n] = h[own], digests[own], items[own]

    def prepare(self) -> None:
        self.first = {}
        for n, (known, _, _) in self.known.items():  # a bit for each 20-bit prefix spares most searches
            bits = np.zeros(1 << 20, bool)
            bits[(known >> np.uint64(44)).astype(np.int64)] = True
            self.first[n] = bits

    def scan(self, data: np.ndarray, at: np.ndarray):
        """Per text: number of words, (position, length, items) of verified hits, and the words' byte spans."""
        starts, ends, doc = words(data, at, ALNUM)
        hashes = span_hashes(data, starts, ends, _VALUES)
        found = []
        for n, (known, digests, items) in self.known.items():
            h = window_hashes(hashes, n)
            maybe = np.flatnonzero(self.first[n][(h >> np.uint64(44)).astype(np.int64)])
            maybe = maybe[doc[maybe] == doc[maybe + n - 1]]
            low, high = np.searchsorted(known, h[maybe]), np.searchsorted(known, h[maybe], "right")
            for i, a, b in zip(maybe[low < high].tolist(), low[low < high].tolist(), high[low < high].tolist(), strict=True):
                own = np.array(_digest([LOWER[data[starts[j] : ends[j]]].tobytes() for j in range(i, i + n)]), "S16")
                who = items[a:b][digests[a:b] == own].tolist()
                if who:
                    found.append((i, n, who))
        return starts, ends, doc, found


def decontaminate(documents: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, keep: bool = False) -> DataFrame:
    """Words of each document inside windows of benchmark texts.

    Words are runs of ASCII letters (A-Z lower-cased), digits and non-ASCII characters; a window is `window` words in
    a row of one item, or all words of a shorter one.  hit_spans are character spans [start, end) of runs of hit words.
    With `keep` also `kept`, the whole row as a struct, so that no column of it can clash with these.  Null or empty texts
    have no words and no hits; repeated rows, ties and items with equal texts all count, items without an id in n_hit
    alone; an empty benchmark hits nothing.  The benchmark's windows are broadcast in parts of BROADCAST_WINDOWS at most;
    each part is a further pass over the rows, which carry their hits from pass to pass without a shuffle.
    """
    small_batches(documents)
    whole = [F.struct(*[quoted(c) for c in documents.columns]).alias("kept")] if keep else []
    rows = documents.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("text"), *whole)
    windows = materialize(item_windows(text_columns(benchmark, item_id=item_id, text=item_text), window))
    parts = max(1, -(-windows.count() // BROADCAST_WINDOWS))
    for i in range(parts):  # the driver holds one part at a time
        part = WindowSet(windows.where(F.pmod(F.xxhash64("hash"), F.lit(parts)) == i).toArrow())
        rows = _scan(rows, part, i == 0, i == parts - 1)
    discard(windows)
    n_hit = F.size("hits").cast("long")
    as_text = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return rows.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(as_text, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"), F.col("spans").alias("hit_spans"), *(["kept"] if keep else []))


def _scan(rows: DataFrame, windows: WindowSet, first: bool, last: bool) -> DataFrame:
    """One pass: hits (places of hit words) and items of the rows, added to those of the passes before; the last pass gives
    the number of words and the spans, the others the text for the next."""
    shared = rows.sparkSession.sparkContext.broadcast(windows)
    extra = [f for f in rows.schema.fields if f.name == "kept"]
    word, place = T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))
    schema = T.StructType([rows.schema["doc_id"], *([word, place] if last else [rows.schema["text"]]), *extra, T.StructField("hits", T.ArrayType(T.IntegerType())), T.StructField("items", T.ArrayType(T.LongType()))])

    def scan(batches):
        windows = shared.value
        windows.prepare()
        for batch in batches:
            for part, data, at in blocks(batch, "text"):
                starts, ends, doc, found = windows.scan(data, at)
                n = part.num_rows
                counts = np.bincount(doc, minlength=n)
                base = np.concatenate([[0], np.cumsum(counts)])
                hits: list[list[int]] = [[] for _ in range(n)] if first else part.column("hits").to_pylist()
                items: list[list[int]] = [[] for _ in range(n)] if first else part.column("items").to_pylist()
                by_doc: dict[int, list] = {}
                for hit in found:
                    by_doc.setdefault(int(doc[hit[0]]), []).append(hit)
                for d, own in by_doc.items():
                    mark = np.zeros(counts[d] + 1, np.int64)
                    for i, size, who in own:
                        mark[i - base[d]] += 1
                        mark[i - base[d] + size] -= 1
                        items[d] += who
                    covered = np.cumsum(mark[:-1]) > 0
                    covered[hits[d]] = True
                    hits[d] = np.flatnonzero(covered).tolist()
                    items[d] = sorted(set(items[d]) - {_NO_ITEM})
                spans: list[list[dict]] = [[] for _ in range(n)]
                for d in [d for d in range(n) if hits[d]] if last else []:
                    own = np.array(hits[d])
                    new = np.flatnonzero(np.diff(own) > 1)
                    chars = np.cumsum((data[at[d] : at[d + 1]] & 0xC0) != 0x80)
                    for a, b in zip(own[np.append(0, new + 1)].tolist(), own[np.append(new, len(own) - 1)].tolist(), strict=True):
                        s, e = starts[base[d] + a] - at[d], ends[base[d] + b] - at[d]
                        spans[d].append({"start": int(chars[s]) - 1, "end": int(chars[e - 1])})
                told = [pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))] if last else [part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *told, *([part.column("kept")] if extra else []), pa.array(hits, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.int64()))], names=schema.names)

    return rows.mapInArrow(scan, schema)
