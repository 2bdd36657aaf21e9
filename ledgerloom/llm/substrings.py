"""Substring dedup: a gear rolling hash over words cuts texts where their content says so; chunks are deduplicated by digest.

A cut depends on the words just before it alone, so text before or after a passage shifts no cut within it.  Runs of
neighbouring chunks that other documents hold too are repeated passages; the document with the least doc_id owns a chunk.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_VALUES, SPACED, blocks, code_points, materialize, mix, quoted, small_batches, span_hashes, text_columns, wide, words
from .exchange import GROUP_KEYS, GROUP_TEXTS, deal, runs

#: A cut comes after a word whose gear hash has CUT_BITS zero bits from bit 2 on (the last four words), at least MIN_WORDS
#: and at most MAX_WORDS words after the one before.
CUT_BITS, MIN_WORDS, MAX_WORDS = 2, 3, 24
#: Shorter runs of repeated chunks are no passages.
RUN_WORDS = 24
#: Bytes of packed chunks that one task joins, about; there are fewer than bytes of text.
PART_BYTES = 32 << 20


def gear(word_hashes: np.ndarray) -> np.ndarray:
    """h[i] = sum of hash[i - j] << j for j < 8; the low bits know the last words only."""
    h, step = word_hashes, 1
    while step < 8:
        shifted = h.copy()
        shifted[step:] += h[:-step] << np.uint64(step) if step < len(h) else 0
        h, step = shifted, step * 2
    return h


def chunk_ends(word_hashes: np.ndarray) -> list[int]:
    """Ends of one text's chunks, in words."""
    n = len(word_hashes)
    marks = np.flatnonzero((gear(word_hashes) >> np.uint64(2)) & np.uint64((1 << CUT_BITS) - 1) == 0) + 1
    out, last = [], 0
    for m in marks.tolist():
        while m - last > MAX_WORDS:
            last += MAX_WORDS
            out.append(last)
        if m - last >= MIN_WORDS:
            out.append(m)
            last = m
    while n - last > MAX_WORDS:
        last += MAX_WORDS
        out.append(last)
    if n > last:
        out.append(n)
    return out


def repeated_passages(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", run_words: int = RUN_WORDS) -> DataFrame:
    """One row for each passage of a document that other documents hold too.

    doc_id, start and end (code points, end exclusive), n_words, n_chunks, owner_id (the least doc_id that holds its first
    chunk), duplicate (false where this document owns every chunk of it: the occurrence that dedup keeps).  Repeats within
    one document alone, and rows that share a doc_id, are no repeats across documents.  Null, empty and short texts have
    none; rows without a doc_id count as one document with id null; an empty table gives an empty result.
    """
    small_batches(documents)
    spark = documents.sparkSession
    docs = text_columns(documents, doc_id=doc_id, text=text)
    length = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(wide(spark), -(-length // PART_BYTES))
    schema = pa.schema([("kind", pa.string()), ("part", pa.int32()), ("grp", pa.int64()), *[(n, pa.binary()) for n in "abcd"]])
    both = pa.schema([*schema, *[(f"m{n}", pa.binary()) for n in "abcd"]])  # meta rows have columns of their own
    null_id = -(1 << 63)

    def emit(batches):
        context = TaskContext.get()
        grp = (context.partitionId() if context else 0) << 20
        hashes: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        meta: list[tuple] = []
        texts = total = 0

        def close():
            if not total:
                return
            k, who = np.concatenate(hashes), np.concatenate(owners)
            order = np.lexsort((who, k))
            ks, ws = k[order], who[order]
            at = runs(ks)
            length = np.diff(np.concatenate([at, [len(ks)]]))
            several = ws[at] != ws[at + length - 1]
            same = np.empty(len(k), np.uint32)  # each chunk's distinct key in the group
            same[order] = np.repeat(np.arange(len(at), dtype=np.uint32), length)
            ids, counts, chars, n_words = zip(*meta, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(["meta"]), pa.array([0], pa.int32()), pa.array([grp]), *[pa.nulls(1, pa.binary())] * 4, pa.array([np.array([(d, c) for d, c in zip(ids, counts, strict=True)], np.int64).tobytes()]), pa.array([np.concatenate(chars).tobytes()]), pa.array([np.concatenate(n_words).tobytes()]), pa.array([same.tobytes()])], schema=both)
            distinct, least = ks[at], ws[at]
            for part, s in deal(distinct, parts):
                yield pa.RecordBatch.from_arrays([pa.array(["key"]), pa.array([part], pa.int32()), pa.array([grp]), pa.array([distinct[s].tobytes()]), pa.array([least[s].tobytes()]), pa.array([np.arange(s.start, s.stop, dtype=np.uint32).tobytes()]), pa.array([several[s].tobytes()]), *[pa.nulls(1, pa.binary())] * 4], schema=both)

        for batch in batches:
            for piece, data, at in blocks(batch, "text"):
                starts, ends, doc = words(data, at, SPACED)
                h = span_hashes(data, starts, ends, BYTE_VALUES)
                base = np.searchsorted(doc, np.arange(len(at)))
                chars = code_points(data)
                for i, who in enumerate(piece.column(0).to_pylist()):
                    a, b = base[i], base[i + 1]
                    if a == b:
                        continue
                    cuts = np.concatenate([[0], chunk_ends(h[a:b])])
                    first, last = starts[a + cuts[:-1]], ends[a + cuts[1:] - 1]
                    values = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h[a:b] * _odd_powers(b - a)[0])])
                    digests = mix((values[cuts[1:]] - values[cuts[:-1]]) * _odd_powers(b - a)[1][cuts[:-1]] + np.diff(cuts).astype(np.uint64))
                    who = null_id if who is None else who
                    hashes.append(digests)
                    owners.append(np.full(len(digests), who, np.int64))
                    meta.append((who, len(digests), np.stack([chars[first], chars[last]], 1).astype(np.int32) - np.int32(chars[at[i]]), np.diff(cuts).astype(np.uint8)))
                    texts, total = texts + 1, total + len(digests)
            if texts >= GROUP_TEXTS or total >= GROUP_KEYS:
                yield from close()
                hashes, owners, meta, texts, total, grp = [], [], [], 0, 0, grp + 1
        yield from close()

    def meet(batches):
        groups, keys, least, place, several = [], [], [], [], []
        for b in batches:
            for g, a, w, i, s in zip(b.column("grp").to_pylist(), *(b.column(x).to_pylist() for x in "abcd"), strict=True):
                k = np.frombuffer(a, np.uint64)
                groups.append(np.full(len(k), g))
                keys.append(k)
                least.append(np.frombuffer(w, np.int64))
                place.append(np.frombuffer(i, np.uint32))
                several.append(np.frombuffer(s, bool))
        if not keys:
            return
        g, k, w, i, s = map(np.concatenate, (groups, keys, least, place, several))
        order = np.lexsort((w, k))
        ks, ws = k[order], w[order]
        at = runs(ks)
        length = np.diff(np.concatenate([at, [len(ks)]]))
        repeated = np.repeat((ws[at] != ws[at + length - 1]) | np.logical_or.reduceat(s[order], at), length)
        owner = np.repeat(ws[at], length)[repeated]
        hit = order[repeated]
        by = np.argsort(g[hit], kind="stable")
        hit, owner = hit[by], owner[by]
        edges = np.append(runs(g[hit]), len(hit))
        for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(["hit"]), pa.array([0], pa.int32()), pa.array([int(g[hit[x]])]), pa.array([i[hit[x:y]].tobytes()]), pa.array([owner[x:y].tobytes()]), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary())], schema=schema)

    columns = "kind string, part int, grp long, a binary, b binary, c binary, d binary"
    dealt = materialize(docs.mapInArrow(emit, columns + ", ma binary, mb binary, mc binary, md binary"))
    of = lambda kind: dealt.where(F.col("kind") == kind).select("kind", "part", "grp", *[F.col(f"m{n}" if kind == "meta" else n).alias(n) for n in "abcd"])
    hits = of("key").repartitionById(parts, F.col("part")).mapInArrow(meet, columns)

    def passages(batches):
        """A group's meta row comes first, then its hits: one group at a time is in memory."""
        grp, meta, found = None, None, []
        for b in batches:
            for kind, _, g, *rest in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if g != grp:
                    if meta is not None:
                        yield group(meta, found)
                    grp, meta, found = g, None, []
                if kind == "meta":
                    meta = rest
                else:
                    found.append(rest[:2])
        if meta is not None:
            yield group(meta, found)

    def group(meta, found):
        same = np.frombuffer(meta[3], np.uint32)
        owner_of = np.full(int(same.max()) + 1, 0, np.int64)
        repeated = np.zeros(len(owner_of), bool)
        for a, w in found:
            at = np.frombuffer(a, np.uint32)
            repeated[at], owner_of[at] = True, np.frombuffer(w, np.int64)
        table = np.frombuffer(meta[0], np.int64).reshape(-1, 2)
        chars, n_words = np.frombuffer(meta[1], np.int32).reshape(-1, 2), np.frombuffer(meta[2], np.uint8).astype(np.int64)
        doc = np.repeat(np.arange(len(table)), table[:, 1])
        flag, owner = repeated[same], owner_of[same]
        edge = np.concatenate([[True], (flag[1:] != flag[:-1]) | (doc[1:] != doc[:-1])])
        begin = np.flatnonzero(edge)
        end = np.append(begin[1:], len(flag))
        total = np.add.reduceat(n_words, begin)
        pick = flag[begin] & (total >= run_words)
        begin, end, total = begin[pick], end[pick], total[pick]
        ids = table[doc[begin], 0]
        foreign = np.concatenate([[0], np.cumsum(owner != table[doc, 0])])
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, mask=ids == null_id), pa.array(chars[begin, 0], pa.int64()), pa.array(chars[end - 1, 1], pa.int64()), pa.array(total), pa.array(end - begin), pa.array(owner[begin], mask=owner[begin] == null_id), pa.array(foreign[end] > foreign[begin])],
            names=["doc_id", "start", "end", "n_words", "n_chunks", "owner_id", "duplicate"])

    placed = of("meta").unionByName(hits).repartition(parts, "grp").sortWithinPartitions("grp", F.desc("kind"))
    return placed.mapInArrow(passages, "doc_id long, start long, end long, n_words long, n_chunks long, owner_id long, duplicate boolean")


_R = 0x9FB21C651E98DF25
_R_INV = pow(_R, -1, 1 << 64)


def _odd_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    from .common import _power

    return _power(_R, n), _power(_R_INV, n)


def remove_repeats(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", run_words: int = RUN_WORDS) -> DataFrame:
    """doc_id and text without the passages that another document owns; refuses ids that several rows have, as spans are told by id."""
    if not documents.groupBy(quoted(doc_id)).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        raise ValueError("doc_id must be unique")
    spans = repeated_passages(documents, doc_id, text, run_words).where("duplicate").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    docs = text_columns(documents, doc_id=doc_id, text=text)
    joined = docs.join(spans, "doc_id", "left")
    pieces = F.expr("""transform(sequence(0, size(spans)), i -> substring(text, if(i = 0, 0, spans[i - 1].end) + 1, if(i = size(spans), length(text), spans[i].start) - if(i = 0, 0, spans[i - 1].end)))""")
    return joined.select("doc_id", F.when(F.col("spans").isNull(), F.col("text")).otherwise(F.concat_ws("", pieces)).alias("text"))
