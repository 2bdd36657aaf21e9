"""Personal data: exact base patterns, and a character-level bidirectional LSTM with CRF transitions that adds spans.

The network is trained in numpy from labelled spans: those the base patterns find in a bounded sample, and rewritten
forms of them (numbers without a plus, spaced digits, spelt-out signs) that the patterns miss.  Every span holds a digit,
an at sign or the word "at" (`_plausible` takes no other), so the network reads the surroundings of each of those, to the
ends of the words they touch; elsewhere its labels could not make a span.
Overlapping windows give each character's label scores; where windows overlap the scores are averaged, nearer the middle
of a window counting more, and one Viterbi pass over the whole region decides.
"""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import key_bound, quoted, small_batches, text_columns

KINDS = ("email", "ip", "card", "phone")
#: Documents with a base span that training looks at, at most: those with the smallest hashed ids.
SAMPLE_ROWS = 400
#: Documents looked at for one that training takes, and base spans of one that it takes at most.
SPARE, SAMPLE_SPANS = 100, 4
WINDOW, STRIDE, REACH = 64, 32, 32
HIDDEN, EMBED, STEPS, BATCH = 32, 12, 800, 32
#: An added span needs this mean marginal probability over its characters.
MIN_PROBABILITY = 0.95
LABELS = 1 + 2 * len(KINDS)

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_HOST = re.compile(r"[A-Za-z0-9.-]*")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: An at sign, or one spelt out: bare, spaced or in brackets of any kind.
_AT = re.compile(r"@|(?<![^\W_])at(?![^\W_])", re.I)
_SIGN = re.compile(rf"[ (\[{{]*(?:{_AT.pattern})[ )\]}}]*", re.I)
_SIGN_LAST = re.compile(rf"(?:{_AT.pattern})[ )\]}}]*\Z", re.I)
_AFTER = re.compile(r"[ )\]}]*")
_TRIGGER = re.compile(rf"[0-9]+|{_AT.pattern}", re.I)
#: What values are written in without a space.
_UNBROKEN = re.compile(r"[\w.%+@(){}\[\]-]*")


def _emails(text: str):
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)
            done = max(done, start)  # the run was looked at; none of its ends can begin before its at sign again


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by the fixed patterns, by kind and start; code points, end exclusive."""
    out = []
    if "@" in text:
        out += [("email", a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
                out.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c in "0123456789" for c in m.group()) <= 15:
                    out.append(("phone", *m.span()))
    return out


def char_codes(text: str) -> np.ndarray:
    """ASCII as it is, other letters 128, all else 129."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.minimum(raw, 129).astype(np.int64)
    for i in np.flatnonzero(raw > 127).tolist():
        out[i] = 128 if text[i].isalpha() else 129
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Tagger:
    """Embedding, one LSTM each way, a linear layer and CRF transitions."""

    def __init__(self, seed: int = 7) -> None:
        g = np.random.default_rng(seed)
        h, e = HIDDEN, EMBED
        self.p = {"emb": g.normal(0, 0.3, (130, e)), "out": g.normal(0, 0.2, (2 * h, LABELS)), "bias": np.zeros(LABELS), "trans": g.normal(0, 0.1, (LABELS, LABELS))}
        for way in "fb":
            self.p["w" + way] = g.normal(0, 0.25, (e + h, 4 * h))
            self.p["c" + way] = np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)])
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _run(self, x: np.ndarray, way: str, keep: bool):
        n, t, e = x.shape
        h = HIDDEN
        w, c0 = self.p["w" + way], self.p["c" + way]
        inputs = x.reshape(-1, e) @ w[:e] + c0
        inputs = inputs.reshape(n, t, -1)
        hs, cs = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        out, saved = np.zeros((n, t, h), np.float32), []
        for i in range(t) if way == "f" else range(t - 1, -1, -1):
            z = inputs[:, i] + hs @ w[e:]
            gates = _sigmoid(z[:, : 3 * h])
            new = np.tanh(z[:, 3 * h :])
            before_c, before_h = cs, hs
            cs = gates[:, h : 2 * h] * cs + gates[:, :h] * new
            tc = np.tanh(cs)
            hs = gates[:, 2 * h :] * tc
            out[:, i] = hs
            if keep:
                saved.append((i, gates, new, before_c, before_h, tc))
        return out, saved

    def scores(self, codes: np.ndarray) -> np.ndarray:
        x = self.p["emb"][codes]
        return np.concatenate([self._run(x, "f", False)[0], self._run(x, "b", False)[0]], 2) @ self.p["out"] + self.p["bias"]

    def gradients(self, codes: np.ndarray, labels: np.ndarray) -> tuple[float, dict]:
        p, h, e = self.p, HIDDEN, EMBED
        n, t = codes.shape
        x = p["emb"][codes]
        runs = {w: self._run(x, w, True) for w in "fb"}
        hidden = np.concatenate([runs["f"][0], runs["b"][0]], 2)
        s = hidden @ p["out"] + p["bias"]
        loss, ds, dtrans = crf_loss(s, p["trans"], labels)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["trans"] = dtrans
        g["out"], g["bias"] = hidden.reshape(-1, 2 * h).T @ ds.reshape(-1, LABELS), ds.sum((0, 1))
        dhidden = ds @ p["out"].T
        dx = np.zeros_like(x)
        for k, way in enumerate("fb"):
            w = p["w" + way]
            dh_next, dc_next = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
            for i, gates, new, before_c, before_h, tc in reversed(runs[way][1]):
                dh = dhidden[:, i, k * h : (k + 1) * h] + dh_next
                gi, gf, go = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
                dc = dh * go * (1 - tc * tc) + dc_next
                dz = np.concatenate([dc * new * gi * (1 - gi), dc * before_c * gf * (1 - gf), dh * tc * go * (1 - go), dc * gi * (1 - new * new)], 1)
                g["w" + way][:e] += x[:, i].T @ dz
                g["w" + way][e:] += before_h.T @ dz
                g["c" + way] += dz.sum(0)
                back = dz @ w.T
                dx[:, i] += back[:, :e]
                dh_next, dc_next = back[:, e:], dc * gf
        np.add.at(g["emb"], codes, dx)
        return loss, g

    def fit(self, codes: np.ndarray, labels: np.ndarray, steps: int = STEPS, seed: int = 7) -> None:
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        for t in range(1, steps + 1):
            pick = r.integers(0, len(codes), min(BATCH, len(codes)))
            _, g = self.gradients(codes[pick], labels[pick])
            norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            rate = 0.02 * min(1.0, 2 * (1 - t / (steps + 1)))
            for k in self.p:
                x = g[k] / max(1.0, norm / 5)
                m[k] = 0.9 * m[k] + 0.1 * x
                v[k] = 0.99 * v[k] + 0.01 * x * x
                self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


def crf_loss(s: np.ndarray, trans: np.ndarray, labels: np.ndarray):
    """Mean negative log likelihood, and its gradients by scores and transitions (forward-backward)."""
    n, t, k = s.shape
    s = s.astype(np.float64)
    alpha, beta = np.zeros((t, n, k)), np.zeros((t, n, k))
    alpha[0] = s[:, 0]
    for i in range(1, t):
        alpha[i] = _logsum(alpha[i - 1][:, :, None] + trans, 1) + s[:, i]
    for i in range(t - 2, -1, -1):
        beta[i] = _logsum(trans + (s[:, i + 1] + beta[i + 1])[:, None, :], 2)
    z = _logsum(alpha[-1], 1)
    rows = np.arange(n)
    gold = s[rows[:, None], np.arange(t), labels].sum(1) + trans[labels[:, :-1], labels[:, 1:]].sum(1)
    ds = np.exp(alpha + beta - z[None, :, None]).transpose(1, 0, 2)
    ds[rows[:, None], np.arange(t), labels] -= 1
    dtrans = np.zeros((k, k))
    for i in range(1, t):
        dtrans += np.exp(alpha[i - 1][:, :, None] + trans + (s[:, i] + beta[i])[:, None, :] - z[:, None, None]).sum(0)
    np.add.at(dtrans, (labels[:, :-1], labels[:, 1:]), -1)
    return float((z - gold).mean()), (ds / n).astype(np.float32), (dtrans / n).astype(np.float32)


def viterbi(s: np.ndarray, trans: np.ndarray) -> np.ndarray:
    best, back = s[0].astype(np.float64), np.zeros(s.shape, np.int64)
    for i in range(1, len(s)):
        step = best[:, None] + trans
        back[i] = step.argmax(0)
        best = step.max(0) + s[i]
    out = np.zeros(len(s), np.int64)
    out[-1] = best.argmax()
    for i in range(len(s) - 1, 0, -1):
        out[i - 1] = back[i, out[i]]
    return out


def marginals(s: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Probability of each label at each place, by forward and backward passes over the scores and transitions."""
    emit = np.exp(s.astype(np.float64) - s.max(1, keepdims=True))
    step = np.exp(trans.astype(np.float64))
    ahead, behind = np.empty_like(emit), np.ones_like(emit)
    ahead[0] = emit[0] / emit[0].sum()
    for i in range(1, len(emit)):
        x = (ahead[i - 1] @ step) * emit[i]
        ahead[i] = x / x.sum()
    for i in range(len(emit) - 2, -1, -1):
        x = step @ (behind[i + 1] * emit[i + 1])
        behind[i] = x / x.sum()
    out = ahead * behind
    return out / out.sum(1, keepdims=True)


def regions(text: str) -> list[tuple[int, int]]:
    """Surroundings of every trigger to the ends of the words they touch, joined where they meet."""
    out: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        a, b = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        last = out[-1][1] if out else 0
        if b > last:
            b = _UNBROKEN.match(text, b).end() if _UNBROKEN.match(text[b - 1]).end() else b
        while a > last and _UNBROKEN.match(text[a - 1]).end():
            a -= 1
        if out and a <= last:
            out[-1][1] = max(last, b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


_WEIGHT = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float32)


def added_spans(tagger: Tagger, texts: list[str], base: list[list]) -> list[list[tuple[str, int, int]]]:
    """Spans of the network that meet no base span, for several texts at once."""
    where, windows = [], []
    for n, text in enumerate(texts):
        for a, b in regions(text):
            first = len(windows)
            codes = char_codes(text[a:b])
            for at in range(0, max(1, len(codes) - WINDOW + STRIDE), STRIDE):
                w = codes[at : at + WINDOW]
                windows.append(np.concatenate([w, np.full(WINDOW - len(w), 32)]) if len(w) < WINDOW else w)
            where.append((n, a, b, first, len(windows)))
    out: list[list] = [[] for _ in texts]
    if not windows:
        return out
    scores = np.concatenate([tagger.scores(np.stack(windows[i : i + 512])) for i in range(0, len(windows), 512)])
    for n, a, b, first, last in where:
        size = b - a
        total, weight = np.zeros((size + WINDOW, LABELS), np.float32), np.zeros(size + WINDOW, np.float32)
        for i in range(first, last):
            at = (i - first) * STRIDE
            total[at : at + WINDOW] += scores[i] * _WEIGHT[:, None]
            weight[at : at + WINDOW] += _WEIGHT
        s = total[:size] / weight[:size, None]
        path = viterbi(s, tagger.p["trans"])
        prob = None
        i = 0
        while i < size:
            if path[i] == 0:
                i += 1
                continue
            kind, j = (path[i] - 1) // 2, i + 1
            while j < size and path[j] == 2 + 2 * kind:
                j += 1
            start, end = (a + i, a + j) if KINDS[kind] != "email" else _whole(texts[n], a + i, a + j)
            span = (KINDS[kind], start, end)
            if _plausible(KINDS[kind], texts[n][start:end]) and not any(x < end and start < y for _, x, y in base[n]):
                prob = marginals(s, tagger.p["trans"]) if prob is None else prob
                if prob[np.arange(i, j), path[i:j]].mean() >= MIN_PROBABILITY:
                    out[n].append(span)
            i = j
    return out


def _whole(text: str, start: int, end: int) -> tuple[int, int]:
    """An address to the ends of its first and last word, as the base pattern takes it; a sign has a word before and after it."""
    first, last = start, end
    if m := _SIGN.match(text, first, last):
        while first > 0 and text[first - 1] in " ([{":
            first -= 1
        if m.end() == last:
            last = _AFTER.match(text, last).end()
    elif m := _SIGN_LAST.search(text, first, last):
        last = _AFTER.match(text, last).end()
    while first > 0 and text[first - 1] in _LOCAL:
        first -= 1
    while first < start and not text[first].isalnum():
        first += 1
    last = _HOST.match(text, last).end()
    while last > end and not text[last - 1].isalnum():
        last -= 1
    return first, last


def _plausible(kind: str, text: str) -> bool:
    """What a kind cannot be without."""
    digits = sum(c in "0123456789" for c in text)
    if kind == "email":
        return len(text) >= 6 and bool(_AT.search(text)) and text[0].isalnum() and text[-1].isalnum()
    if kind == "ip":
        return 4 <= digits <= 12 and text.count(".") == 3
    if kind == "card":
        return 13 <= digits <= 19 and _luhn("".join(c for c in text if c in "0123456789"))
    return 9 <= digits <= 15 and digits * 2 > len(text)


def _rewritten(kind: str, value: str, r: random.Random) -> str:
    """A form of a value that the base patterns do not know, or the value itself."""
    way = r.random()
    if kind == "email" and way < 0.5:
        word = r.choice(["at", "at", "AT", "At"])
        return value.replace("@", r.choice([*[f" {word} "] * 5, *(f"{a}{x}{word}{x}{b}" for x in ("", " ") for a, b in ("()", "[]", "{}")), *(f" {a}{word}{b} " for a, b in ("()", "[]", "{}"))]))
    if kind == "phone" and way < 0.3:
        return value.split(" ", 1)[-1] if " " in value else value
    if kind == "phone" and way < 0.5:
        return " ".join(c for c in value if c in "0123456789")
    if kind == "card" and way < 0.3 and value.isdigit():
        return r.choice([".", "/"]).join(value[i : i + 4] for i in range(0, len(value), 4))
    return value


def _invented(kind: str, r: random.Random) -> str:
    word = lambda: "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(3, 9)))
    if kind == "email" and r.random() < 0.25:
        return f"{word()}{''.join(r.choice('.-_') + word() for _ in range(r.randint(1, 3)))}@{word()}-{word()}.{r.choice(['com', 'org', 'net', 'de', 'co.uk'])}"
    if kind == "email":
        return f"{word()}{r.choice(['.', '_', ''])}{r.choice([word(), str(r.randint(1, 99))])}@{word()}.{r.choice(['com', 'org', 'net', 'de', 'co.uk'])}"
    if kind == "ip":
        return ".".join(str(r.randint(1, 255)) for _ in range(4))
    if kind == "card":
        digits = r.choice("3456") + "".join(r.choice("0123456789") for _ in range(14))
        return next(digits + c for c in "0123456789" if _luhn(digits + c))
    return f"+{r.randint(1, 99)} ({r.randint(200, 999)}) {r.randint(200, 999)}-{r.randint(1000, 9999)}"


def _decoy(r: random.Random) -> str:
    """Numbers and signs that are nobody's data."""
    return r.choice([
        f"{r.randint(1, 12)}.{r.randint(0, 20)}", f"{r.randint(1900, 2100)}", f"version {r.randint(1, 9)}.{r.randint(0, 99)}.{r.randint(0, 99)}", "".join(r.choice("0123456789abcdef") for _ in range(r.randint(16, 40))),
        "".join(r.choice("ABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(20)), f"{r.randint(10, 999999)}", f"{r.randint(0, 23):02}:{r.randint(0, 59):02}", f"{r.randint(1, 31)}/{r.randint(1, 12)}/{r.randint(1990, 2030)}", f"{r.randint(1, 99)}%",
        "".join(r.choice("0123456789") for _ in range(r.choice([8, 10, 12, 20]))), f"${r.randint(1, 9)},{r.randint(100, 999)}.{r.randint(10, 99)}", "@home", f"item {r.randint(1, 500)}", f"at {r.randint(1, 12)}", " ".join(str(i) for i in range(1, r.randint(3, 13))), " ".join(r.choice("0123456789") for _ in range(r.randint(1, 6)))])


def _prose(text: str, r: random.Random) -> str:
    """Words of a text around an "at" that is none of an address."""
    words = [w for w in text.split() if w.isalpha()] or ["the"]
    some = lambda: " ".join(r.choice(words) for _ in range(r.randint(1, 3)))
    return f"{some()}{r.choice(['', '', '.', ','])} {r.choice(['at', 'at', 'At', 'AT', '(at'])} {some()}{r.choice(['', '', '. ' + some().capitalize(), ', ' + some(), '.'])}"


def training_windows(labelled: list[tuple[str, list]], count: int = 6000, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Windows and labels: surroundings of labelled spans, with values kept, rewritten or invented anew, and decoys."""
    r = random.Random(seed)
    contexts = [(t[max(0, a - WINDOW) : a], kind, t[a:b], t[b : b + WINDOW]) for t, spans in labelled for kind, a, b in spans]
    contexts = contexts or [("the ", "email", "a@b.cc", " and the")]
    codes, labels = [], []
    for _ in range(count):
        left, kind, value, right = r.choice(contexts)
        way = r.random()
        if way < 0.25:
            kind, value = None, _decoy(r) if r.random() < 0.6 else _prose(left + right, r)
        elif way < 0.75:
            kind = r.choice(KINDS)
            value = _rewritten(kind, _invented(kind, r), r)
        else:
            value = _rewritten(kind, value, r)
        left = left if r.random() < 0.9 else left.rstrip()
        parts = [(kind, value)]
        if kind and r.random() < 0.3:  # values side by side, of which a greedy pattern makes one match and drops it
            parts += [(None, r.choice([" ", " ", "-", ", ", "\n"])), (kind, value if r.random() < 0.5 else _invented(kind, r))]
        at, middle = len(left), "".join(v for _, v in parts)
        text = left + middle + right
        mark = np.zeros(len(text), np.int64)
        known = base_spans(left) + [(k, a + at + len(middle), b + at + len(middle)) for k, a, b in base_spans(right)]
        begin = at
        for k, v in parts:
            known += [(k, begin, begin + len(v))] if k else []
            begin += len(v)
        for k, a, b in known:
            mark[a:b], mark[a] = 2 + 2 * KINDS.index(k), 1 + 2 * KINDS.index(k)
        start = max(0, min(len(text) - WINDOW, at - r.randint(0, WINDOW - 8)))
        c = char_codes(text)[start : start + WINDOW]
        pad = WINDOW - len(c)
        codes.append(np.concatenate([c, np.full(pad, 32)]))
        labels.append(np.concatenate([mark[start : start + WINDOW], np.zeros(pad, np.int64)]))
    return np.stack(codes), np.stack(labels)


def fit(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", rows: int = SAMPLE_ROWS, steps: int = STEPS) -> Tagger:
    """Trains a tagger on surroundings of base spans in `rows` documents at most, and on rewritten and invented values.

    The documents are those with the smallest hashed ids among about SPARE * rows that are looked at (all of a smaller
    table); each gives SAMPLE_SPANS spans at most, so that no document of nothing but numbers fills the sample.
    """
    small_batches(documents)
    docs = text_columns(documents, doc_id=doc_id, text=text).select(F.xxhash64("doc_id", "text").alias("k"), "text").where("text is not null")
    docs = docs.where(F.col("k") <= key_bound(documents.count(), SPARE * rows))  # what is gathered does not grow with the input

    def surroundings(batches):
        for b in batches:
            found = [(k, pick) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if (pick := [t[max(0, x - WINDOW) : y + WINDOW] for _, x, y in base_spans(t)[:SAMPLE_SPANS]])]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), pa.array([p for _, p in found], pa.list_(pa.string()))], names=["k", "near"])

    picked = docs.mapInArrow(surroundings, "k long, near array<string>").orderBy("k").limit(rows).toPandas()
    labelled = [(x, base_spans(x)) for row in picked.sort_values("k")["near"] for x in row]
    tagger = Tagger()
    tagger.fit(*training_windows([(t, s) for t, s in labelled if s]), steps=steps)
    return tagger


def _text_of(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def find_personal_data(documents: DataFrame, tagger: Tagger | None, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Personal data in every whole text.

    doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (base and added, as kind:start:end by kind
    and start), n_added, masked (the text with each span replaced by its kind in square brackets; of spans that overlap
    the earlier one counts); with `keep` also `kept`, a struct of those columns, so that none can clash with these.  Null
    texts count as empty and stay null in masked; rows are independent, so ties and repeated rows keep their own spans; an
    empty table gives an empty result.
    """
    small_batches(documents)
    docs = documents.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("text"), *([F.struct(*[quoted(c) for c in keep]).alias("kept")] if keep else []))
    shared = documents.sparkSession.sparkContext.broadcast(tagger)
    schema = T.StructType([docs.schema["doc_id"], *[T.StructField(f"n_{k}", T.LongType()) for k in KINDS], T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_added", T.LongType()), T.StructField("masked", T.StringType()), *docs.schema.fields[2:]])

    def find(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                b = whole.slice(i, 256)
                raw = b.column(1).to_pylist()
                texts = [x or "" for x in raw]
                base = [base_spans(x) for x in texts]
                more = added_spans(shared.value, texts, base) if shared.value is not None else [[] for _ in texts]
                counts = [pa.array([sum(k == s[0] for s in x) for x in base], pa.int64()) for k in KINDS]
                digests = pa.array([hashlib.sha256(_text_of(x).encode()).hexdigest() for x in base])
                masked = [None if r is None else mask(t, x + y) for r, t, x, y in zip(raw, texts, base, more, strict=True)]
                spans = pa.array([_text_of(x + y) for x, y in zip(base, more, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([b.column(0), *counts, digests, spans, pa.array([len(x) for x in more], pa.int64()), pa.array(masked, pa.string()), *b.columns[2:]], names=schema.names)

    return docs.mapInArrow(find, schema)


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    if not spans:
        return text
    out, done = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= done:
            out += [text[done:a], f"[{kind.upper()}]"]
        if b > done:
            done = b
    return "".join(out) + text[done:]


