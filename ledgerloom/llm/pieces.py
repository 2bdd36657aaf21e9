"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

At each position the automaton's output links give every piece that ends there, the longest first; the best score at the
piece's start is relaxed to its end.  For unigram models a path's score is the sum of its pieces' scores.  For BPE models such a sum would
choose other pieces than the model's merges do, so there a step scores zero if merging would leave the two pieces side
by side and minus infinity otherwise: exactly one path then has a finite score, the model's own encoding.

The pass runs over many words (units that no piece crosses) at once, sign by sign in numpy: the automaton's states, the
links and the pieces chosen so far are arrays, one place a word.
"""

from __future__ import annotations

import re
import zlib
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks, small_batches

#: Encoded units kept by each worker in two halves, the older of which is dropped; the longest that is kept or encoded
#: beside others; pairs of pieces kept.
CACHE_UNITS, UNIT_CHARS, CACHE_PAIRS = 200_000, 64, 250_000
#: Places of the tables of steps of the automaton and of pairs of pieces: a place holds the key seen there last.
SLOTS = 1 << 20
#: Bytes of text encoded at once; a longer text stands alone.
AT_ONCE = 2 << 20
SPACE = "▁"
_UNIT = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _slots(keys: np.ndarray) -> np.ndarray:
    return ((keys.view(np.uint64) * _MIX) >> np.uint64(44)).astype(np.int64)


class Steps:
    """The Aho-Corasick automaton as arrays: for each state its depth, failure state, piece and next state with a piece."""

    def __init__(self, pieces: dict[str, int]) -> None:
        signs = sorted(set("".join(pieces)))
        self.code = np.zeros(0x110000, np.int64)
        self.code[[ord(c) for c in signs]] = np.arange(1, len(signs) + 1)
        self.width = len(signs) + 1
        number = {c: i + 1 for i, c in enumerate(signs)}
        edges: dict[int, int] = {}
        depth, own, before = [0], [-1], [(0, 0)]
        for p in sorted(pieces, key=len):  # so that states come in the order of their depth but for their siblings
            at = 0
            for c in p:
                key = at * self.width + number[c]
                if key not in edges:
                    edges[key] = len(depth)
                    depth.append(depth[at] + 1)
                    own.append(-1)
                    before.append((at, number[c]))
                at = edges[key]
            own[at] = pieces[p]
        n = len(depth)
        fail, first = np.zeros(n, np.int64), np.full(n, -1, np.int64)
        for at in sorted(range(1, n), key=depth.__getitem__):
            parent, c = before[at]
            up = int(fail[parent])
            while parent and up and up * self.width + c not in edges:
                up = int(fail[up])
            fail[at] = edges.get(up * self.width + c, 0) if parent else 0
            first[at] = at if own[at] >= 0 else first[fail[at]]
        keys = np.array(sorted(edges), np.int64)
        self.keys, self.ends = keys, np.array([edges[k] for k in keys.tolist()], np.int64)
        self.depth, self.own, self.fail, self.first = np.array(depth, np.int64), np.array(own, np.int64), fail, first
        #: The next state with a piece on the way of failure links.
        self.link = np.where(np.arange(n) > 0, first[fail], -1)
        self.seen, self.told = np.full(SLOTS, -1, np.int64), np.zeros(SLOTS, np.int64)

    def step(self, states: np.ndarray, signs: np.ndarray) -> np.ndarray:
        keys = states * self.width + signs
        slots = _slots(keys)
        out = self.told[slots]
        todo = np.flatnonzero(self.seen[slots] != keys)
        if len(todo):
            at, new, left = states[todo], np.zeros(len(todo), np.int64), np.arange(len(todo))
            while len(left):
                k = at[left] * self.width + signs[todo[left]]
                place = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
                there = self.keys[place] == k
                new[left[there]] = self.ends[place[there]]
                left = left[~there & (at[left] > 0)]
                at[left] = self.fail[at[left]]
            out[todo] = new
            self.seen[slots[todo]], self.told[slots[todo]] = keys[todo], new
        return out


class PieceModel:
    """Pieces, scores and rules of a model file; reads it without training or changing anything."""

    def __init__(self, path: str) -> None:
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        self.bpe = model.trainer_spec.model_type == 2
        if model.normalizer_spec.precompiled_charsmap or model.normalizer_spec.remove_extra_whitespaces or not model.normalizer_spec.escape_whitespaces:
            raise ValueError("only models with identity normalisation that keep white space are read")
        self.prefix = model.normalizer_spec.add_dummy_prefix
        self.pieces = [p.piece for p in model.pieces]
        self.scores = [p.score for p in model.pieces]
        self.types = [p.type for p in model.pieces]
        self.unknown = self.types.index(2)
        self.bytes = {int(p[1:-1], 16): i for i, p in enumerate(self.pieces) if self.types[i] == 6}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.types[i] in (1, 4)}
        #: Units never share a piece: pieces hold the space mark only in front, or nothing else, and no line end.
        self.splits = not any("\n" in p or SPACE in p.lstrip(SPACE) for p in self.ids)
        self.chars = {p for p in self.ids if len(p) == 1}
        if self.bpe and not self.chars.issuperset("".join(self.ids)):
            raise ValueError("a merge model whose pieces hold characters that are no pieces is not read")
        self.raw = [bytes([self.byte_of[i]]) if i in self.byte_of else b"" if self.types[i] == 3 else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        #: Score of a character that is no piece.
        self.least = min((self.scores[i] for i in self.ids.values() if self.types[i] == 1), default=0.0) - 10
        self.fits: dict[int, bool] = {}
        self.pair_seen, self.pair_told = np.full(SLOTS, -1, np.int64), np.zeros(SLOTS, bool)
        reached = {p: i for p, i in self.ids.items() if not self.bpe or self.merged(p) == [p]}
        self.automaton = ahocorasick.Automaton()
        for p, i in reached.items():
            self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.steps = Steps(reached) if self.bpe and reached else None
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """The model's merges, one by one: of neighbours whose join is a piece the best scored, the leftmost among equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = self.ids.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or self.scores[k] > best):
                    best, at = self.scores[k], i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def side_by_side(self, a: int, b: int) -> bool:
        """Whether the merges of both pieces' text end with just these two."""
        key = a << 32 | b
        out = self.fits.get(key)
        if out is None:
            if len(self.fits) > CACHE_PAIRS:
                self.fits.clear()
            x, y = self.pieces[a], self.pieces[b]
            out = self.fits[key] = self.merged(x + y) == [x, y]
        return out

    def _fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """side_by_side of many pairs; those that are not in their place of the table are asked for one by one."""
        keys = a << 32 | b
        slots = _slots(keys)
        out = self.pair_told[slots]
        todo = np.flatnonzero(self.pair_seen[slots] != keys)
        if len(todo):
            asked, back = np.unique(keys[todo], return_inverse=True)
            told = np.array([self.side_by_side(k >> 32, k & 0xFFFFFFFF) for k in asked.tolist()], bool)
            out[todo] = told[back]
            self.pair_seen[slots[todo]], self.pair_told[slots[todo]] = keys[todo], out[todo]
        return out

    def _together(self, units: list[str]) -> list[bytes]:
        """The merges' paths of units whose characters all are pieces, sign by sign over all units at once."""
        steps = self.steps
        length = np.fromiter(map(len, units), np.int64, len(units))
        begin = np.cumsum(length) - length
        signs = steps.code[np.frombuffer("".join(units).encode("utf-32-le"), "<u4")]
        order = np.argsort(-length, kind="stable")
        begin, length = begin[order], length[order]
        n, most = len(units), int(length[0])
        state = np.zeros(n, np.int64)
        last, size = np.full((most + 1, n), -1, np.int64), np.zeros((most + 1, n), np.int64)
        for end in range(1, most + 1):
            k = int(np.searchsorted(-length, -end, "right"))
            state[:k] = steps.step(state[:k], signs[begin[:k] + (end - 1)])
            todo, at = np.arange(k), steps.first[state[:k]]
            while len(todo):
                piece, start = steps.own[at], end - steps.depth[at]
                fits = start == 0
                ask = np.flatnonzero(~fits)
                if len(ask):
                    fits[ask] = self._fit(last[start[ask], todo[ask]], piece[ask])
                done = todo[fits]
                last[end, done], size[end, done] = piece[fits], end - start[fits]
                todo, at = todo[~fits], steps.link[at[~fits]]
        count, at, alive = np.zeros(n, np.int64), length.copy(), np.arange(n)
        path = []  # pieces from the end, the units that are not done yet
        while len(alive):
            path.append((alive, last[at[alive], alive]))
            at[alive] -= size[at[alive], alive]
            count[alive] += 1
            alive = alive[at[alive] > 0]
        stop = np.cumsum(count)
        out = np.zeros(int(stop[-1]), "<u4")
        for back, (who, piece) in enumerate(path):
            out[stop[who] - 1 - back] = piece
        raw = out.tobytes()
        encoded: list[bytes] = [b""] * n
        for i, a, b in zip(order.tolist(), (4 * (stop - count)).tolist(), (4 * stop).tolist(), strict=True):
            encoded[i] = raw[a:b]
        return encoded

    def _chars_known(self, unit: str) -> list[int]:
        """The merges' path where every character is a piece: then each position has exactly one piece that fits."""
        last = [-1] * (len(unit) + 1)
        size_of = [0] * (len(unit) + 1)
        fits = self.fits
        for end, (piece, size) in self.automaton.iter(unit):
            end += 1
            if size_of[end]:
                continue
            start = end - size
            if start:
                known = fits.get(last[start] << 32 | piece)
                if known is None:
                    known = self.side_by_side(last[start], piece)
                if not known:
                    continue
            last[end], size_of[end] = piece, size
        out, at = [], len(unit)
        while at:
            out.append(last[at])
            at -= size_of[at]
        out.reverse()
        return out

    def _any(self, unit: str) -> list[int]:
        """A unit with characters that are no piece: each becomes its bytes, or one unknown piece with those beside it."""
        n = len(unit)
        score = [-np.inf] * (n + 1)
        last = [(-1, 1)] * (n + 1)
        score[0] = 0.0
        done = 0  # positions up to here are settled
        matches = self.automaton.iter(unit)
        end, match = next(matches, (n, None))
        while done < n:
            done += 1
            while end + 1 == done:  # the longest first: the one that starts first wins a tie
                piece, size = match
                start = done - size
                if self.bpe:
                    before = last[start][0] if start else -1
                    if score[start] == 0.0 and score[done] == -np.inf and (before < 0 or self.side_by_side(before, piece)):
                        score[done], last[done] = 0.0, (piece, size)
                elif score[start] + self.scores[piece] > score[done]:
                    score[done], last[done] = score[start] + self.scores[piece], (piece, size)
                end, match = next(matches, (n, None))
            if unit[done - 1] not in self.chars and score[done - 1] + self.least > score[done]:
                score[done], last[done] = 0.0 if self.bpe else score[done - 1] + self.least, (-1, 1)
        out: list[int] = []
        at, unknown = n, False
        while at:
            piece, size = last[at]
            if piece >= 0:
                out.append(piece)
            elif self.bytes:
                out += [self.bytes[b] for b in reversed(unit[at - 1].encode())]
            elif not unknown:
                out.append(self.unknown)
            unknown = piece < 0
            at -= size
        out.reverse()
        return out

    def _unit(self, unit: str) -> bytes:
        ids = self._chars_known(unit) if self.bpe and self.chars.issuperset(unit) else self._any(unit)
        return np.array(ids, "<u4").tobytes()

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as 32-bit little-endian; units that the worker does not know are encoded together."""
        marked = [(SPACE if self.prefix else "") + x.replace(" ", SPACE) if x else "" for x in texts]
        if not self.splits:
            return [np.array(self._any(x), "<u4").tobytes() if x else b"" for x in marked]
        split = [_UNIT.findall(x) for x in marked]
        wanted = set().union(*split)
        known = {u: self.older[u] for u in wanted.intersection(self.older)}
        unknown = wanted.difference(self.cache).difference(known)
        short = [u for u in unknown if self.bpe and len(u) <= UNIT_CHARS and self.chars.issuperset(u)]
        for i in range(0, len(short), 1 << 14):
            part = short[i : i + (1 << 14)]
            known.update(zip(part, self._together(part), strict=True))
        for u in unknown.difference(known):
            known[u] = self._unit(u)
        if len(self.cache) + len(known) > CACHE_UNITS // 2:
            known.update((u, self.cache[u]) for u in wanted.intersection(self.cache))
            self.older, self.cache = self.cache, {}
        self.cache.update((u, x) for u, x in known.items() if len(u) <= UNIT_CHARS)
        known.update((u, self.cache[u]) for u in wanted.difference(known))
        return [b"".join(itemgetter(*us)(known)) if len(us) > 1 else known[us[0]] if us else b"" for us in split]

    def encode_bytes(self, text: str | None) -> bytes:
        """Ids as 32-bit little-endian."""
        return self.encode_all([text])[0]

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.raw.__getitem__, ids)).decode(errors="replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


_models: dict[str, PieceModel] = {}


def model_of(path: str) -> PieceModel:
    """The worker's model of a file: kept from task to task with the units it knows."""
    if path not in _models:
        _models.clear()
        _models[path] = PieceModel(path)
    return _models[path]


def encode(documents: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text", keep_ids: bool = True) -> DataFrame:
    """Ids of every whole text: doc_id, n_tokens, ids_crc32 (ids as 32-bit little-endian), round_trip, and ids if asked for.

    round_trip says that decoding the ids gives the text again (texts that hold the space mark itself do not, as with the
    model's own library).  Null and empty texts have no ids; rows are independent, so ties and repeated rows keep their
    own results; an empty table gives an empty result.
    """
    small_batches(documents)
    docs = documents.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    fields = [T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("round_trip", T.BooleanType())]
    if keep_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))

    def run(batches):
        m = model_of(model)
        for batch in batches:
            for b, _, _ in blocks(batch, "text", AT_ONCE):
                texts = b.column(1).to_pylist()
                packed = m.encode_all(texts)
                same = [m.decode(np.frombuffer(x, "<u4").tolist()) == (t or "") for x, t in zip(packed, texts, strict=True)]
                counts = np.array([len(x) // 4 for x in packed], np.int64)
                columns = [b.column(0), pa.array(counts), pa.array([zlib.crc32(x) for x in packed], pa.int64()), pa.array(same, pa.bool_())]
                names = ["doc_id", "n_tokens", "ids_crc32", "round_trip"]
                if keep_ids:
                    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), "<i4"))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, T.StructType(fields))


def decode(encoded: DataFrame, model: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id and text of ids; null ids give a null text, ids outside the model fail."""
    small_batches(encoded)

    def run(batches):
        m = model_of(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else m.decode(x) for x in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    source = encoded.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{ids}`").alias("ids"))
    return source.mapInArrow(run, T.StructType([T.StructField("doc_id", source.schema["doc_id"].dataType), T.StructField("text", T.StringType())]))
