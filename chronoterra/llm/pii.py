"""PII: pattern spans, and a character-level bidirectional LSTM with CRF transitions that adds more.

Base spans come from four patterns over the whole text. The tagger is trained in numpy on labelled
spans: windows of a bounded sample of texts, labelled by the patterns, and the same windows with their
spans rewritten as people write them to avoid patterns (``varied``: "name at host dot org", "00" for
"+", other signs between the digits), which the patterns don't match. It then reads every stretch of
text that can hold personal data of these kinds (tiles with a digit, an '@' or a spelled-out one, and
their neighbours): overlapping windows are scored, their emissions are averaged by the distance to the
window's edge, and one Viterbi pass over the whole stretch reconciles them. Spans that overlap no base
span are added.

Spans are (kind, start, end) in code points. Defined cases: null text is empty; a null doc_id is
returned as null; repeated rows are read each; an empty table trains no tagger and gives an empty
table; texts of any length are read whole, in time linear in their length.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, scratch

KINDS = ("email", "ip", "card", "phone")
MAX_TRAIN = 1500
TILE, WINDOW, EMBED, HIDDEN, BATCH, RATE, SEED = 48, 96, 12, 16, 32, 0.01, 7
#: Batches the tagger is trained on, however few the windows are.
STEPS = 320

# Fixed patterns; each search starts where a leftmost search would, so that long runs cost no more than their length.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HINT = re.compile(r"[0-9@]")
#: What the tagger reads around: a hint, or an address spelled out.
_CUE = re.compile(r"[0-9@]|[\[({] ?at ?[\])}]| at [^ \n]{1,40} dot ")

Span = tuple[int, int]


def _emails(text: str) -> Iterator[Span]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> dict[str, list[Span]]:
    """Leftmost non-overlapping matches of each kind that pass its check."""
    if not _HINT.search(text):
        return {k: [] for k in KINDS}
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    return {
        "email": list(_emails(text)),
        "ip": [m.span() for m in _IP.finditer(text) if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m.group().split(".")))],
        "card": [m.span() for m in _CARD.finditer(text) if 16 <= len(d := digits(m)) <= 19 and _luhn(d)],
        "phone": [m.span() for m in _PHONE.finditer(text) if 8 <= len(digits(m)) <= 15],
    }


# ---- tagger ----------------------------------------------------------------------------------

TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind


def char_ids(text: str) -> np.ndarray:
    """Printable ASCII as itself, other characters by three classes; 0 pads."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    return np.where((codes >= 32) & (codes < 127), codes - 28, np.where(codes < 32, 1, np.where(codes < 0x250, 2, 3)))


N_CHARS = 99


def tag_ids(n: int, spans: dict[str, list[Span]], start: int = 0) -> np.ndarray:
    tags = np.zeros(n, np.int64)
    for k, kind in enumerate(KINDS):
        for a, b in spans[kind]:
            a, b = a - start, b - start
            if 0 <= a < n and not tags[a : min(b, n)].any():
                tags[a : min(b, n)] = 2 + 2 * k
                tags[a] = 1 + 2 * k
    return tags


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Tagger:
    """Embeddings, one LSTM in each direction, a linear layer and CRF transitions."""

    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        g = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"e": g(N_CHARS, EMBED) * 3, "o": g(2 * HIDDEN, TAGS), "ob": np.zeros(TAGS, np.float32), "t": np.zeros((TAGS, TAGS), np.float32)}
        for d in "fb":
            self.p[d + "x"], self.p[d + "h"], self.p[d + "b"] = g(EMBED, 4 * HIDDEN), g(HIDDEN, 4 * HIDDEN), np.zeros(4 * HIDDEN, np.float32)
            self.p[d + "b"][HIDDEN : 2 * HIDDEN] = 1  # remember by default

    def _lstm(self, x: np.ndarray, d: str):
        """x: time x batch x embed. Gates in the order input, forget, output, candidate."""
        p, n, b = self.p, len(x), x.shape[1]
        pre = x @ p[d + "x"] + p[d + "b"]
        h, c, saved, out = np.zeros((b, HIDDEN), np.float32), np.zeros((b, HIDDEN), np.float32), [], np.empty((n, b, HIDDEN), np.float32)
        for t in range(n):
            z = pre[t] + h @ p[d + "h"]
            s = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o, g = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
            before, c0 = h, c
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            out[t] = h
            saved.append((i, f, o, g, before, c0, tc))
        return out, saved

    def _lstm_back(self, x: np.ndarray, d: str, saved, grad: np.ndarray, g_out: dict) -> np.ndarray:
        p, n = self.p, len(x)
        dz_all, dh, dc = np.empty((n, x.shape[1], 4 * HIDDEN), np.float32), 0.0, 0.0
        wh = np.zeros_like(p[d + "h"])
        for t in range(n - 1, -1, -1):
            i, f, o, g, before, c0, tc = saved[t]
            dh_t = grad[t] + dh
            dc_t = dc + dh_t * o * (1 - tc * tc)
            dz = np.concatenate([dc_t * g * i * (1 - i), dc_t * c0 * f * (1 - f), dh_t * tc * o * (1 - o), dc_t * i * (1 - g * g)], 1)
            dz_all[t] = dz
            wh += before.T @ dz
            dh, dc = dz @ p[d + "h"].T, dc_t * f
        flat = dz_all.reshape(-1, 4 * HIDDEN)
        g_out[d + "h"], g_out[d + "x"], g_out[d + "b"] = wh, x.reshape(-1, EMBED).T @ flat, flat.sum(0)
        return dz_all @ p[d + "x"].T

    def emissions(self, ids: np.ndarray, keep: bool = False):
        """ids: batch x time; tag scores, time x batch x tags."""
        x = self.p["e"][ids.T]
        f, sf = self._lstm(x, "f")
        b, sb = self._lstm(x[::-1], "b")
        h = np.concatenate([f, b[::-1]], 2)
        e = h @ self.p["o"] + self.p["ob"]
        return (e, x, h, sf, sb) if keep else e

    def gradient(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean CRF loss of a batch and its gradient, by the forward-backward recursions."""
        e, x, h, sf, sb = self.emissions(ids, True)
        tr, y, (n, b, _) = self.p["t"], tags.T, e.shape
        lse = lambda a, axis: (m := a.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - m).sum(axis))
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0]
        for t in range(1, n):
            alpha[t] = e[t] + lse(alpha[t - 1][:, :, None] + tr, 1)
        for t in range(n - 2, -1, -1):
            beta[t] = lse(tr + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        z = lse(alpha[-1], 1)
        de = np.exp(alpha + beta - z[None, :, None])
        dt = np.zeros_like(tr)
        for t in range(1, n):
            dt += np.exp(alpha[t - 1][:, :, None] + tr + (e[t] + beta[t])[:, None, :] - z[:, None, None]).sum(0)
        rows, cols = np.arange(n)[:, None], np.arange(b)[None]
        gold = e[rows, cols, y].sum() + tr[y[:-1], y[1:]].sum()
        de[rows, cols, y] -= 1
        np.subtract.at(dt, (y[:-1], y[1:]), 1)
        g = {"t": dt / b}
        de = (de / b).astype(np.float32)
        g["o"], g["ob"] = h.reshape(-1, 2 * HIDDEN).T @ de.reshape(-1, TAGS), de.sum((0, 1))
        dh = de @ self.p["o"].T
        dx = self._lstm_back(x, "f", sf, dh[:, :, :HIDDEN], g) + self._lstm_back(x[::-1], "b", sb, dh[::-1, :, HIDDEN:], g)[::-1]
        g["e"] = np.zeros_like(self.p["e"])
        np.add.at(g["e"], ids.T, dx)
        return float((z.sum() - gold) / b), g

    def fit(self, ids: np.ndarray, tags: np.ndarray, steps: int = STEPS, seed: int = SEED) -> Tagger:
        """Adam over about ``steps`` shuffled batches, in whole epochs."""
        r, step = np.random.default_rng(seed), 0
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        for _ in range(max(1, round(steps * BATCH / len(ids)))):
            order = r.permutation(len(ids))
            for i in range(0, len(order), BATCH):
                _, g = self.gradient(ids[order[i : i + BATCH]], tags[order[i : i + BATCH]])
                step += 1
                scale = min(1.0, 5.0 / (np.sqrt(sum(float((x * x).sum()) for x in g.values())) + 1e-9))
                for k, x in g.items():
                    x = x * scale
                    m[k] = 0.9 * m[k] + 0.1 * x
                    v[k] = 0.999 * v[k] + 0.001 * x * x
                    self.p[k] = (self.p[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def viterbi(self, e: np.ndarray) -> np.ndarray:
        best, back, tr = e[0], [], self.p["t"]
        for t in range(1, len(e)):
            s = best[:, None] + tr
            back.append(s.argmax(0))
            best = s.max(0) + e[t]
        tags = [int(best.argmax())]
        for b in reversed(back):
            tags.append(int(b[tags[-1]]))
        return np.array(tags[::-1])


def stretches(text: str) -> list[Span]:
    """Joined runs of tiles that hold a cue, each with the tile before and after."""
    out: list[list[int]] = []
    for t in sorted({m.start() // TILE for m in _CUE.finditer(text)}):
        a, b = max(0, (t - 1) * TILE), min(len(text), (t + 2) * TILE)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _windows(n: int) -> list[int]:
    """Starts of windows at half their width, the last one flush with the end."""
    return [*range(0, max(1, n - WINDOW // 2), WINDOW // 2)]


_EDGE = np.minimum(np.arange(WINDOW) + 1, np.arange(WINDOW, 0, -1)).astype(np.float32)


def tagged_spans(texts: list[str], tagger: Tagger) -> list[list[tuple[str, int, int]]]:
    """Spans that the tagger finds in each text."""
    jobs = [(i, a, b) for i, t in enumerate(texts) for a, b in stretches(t)]
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    for lo in range(0, len(jobs), 128):
        part, ids, owner = jobs[lo : lo + 128], [], []
        for j, (i, a, b) in enumerate(part):
            c = char_ids(texts[i][a:b])
            for s in _windows(b - a):
                w = np.zeros(WINDOW, np.int64)
                w[: len(c[s : s + WINDOW])] = c[s : s + WINDOW]
                ids.append(w)
                owner.append((j, s))
        sums = [np.zeros((b - a, TAGS), np.float32) for _, a, b in part]
        weight = [np.zeros((b - a, 1), np.float32) for _, a, b in part]
        for k in range(0, len(ids), 512):
            e = tagger.emissions(np.array(ids[k : k + 512]))
            for w, (j, s) in enumerate(owner[k : k + 512]):
                n = min(WINDOW, len(sums[j]) - s)
                sums[j][s : s + n] += e[:n, w] * _EDGE[:n, None]
                weight[j][s : s + n] += _EDGE[:n, None]
        for (i, a, _), e, w in zip(part, sums, weight, strict=True):
            tags, at = tagger.viterbi(e / np.maximum(w, 1e-6)), 0
            while at < len(tags):
                kind = (tags[at] - 1) // 2
                if tags[at] == 0:
                    at += 1
                    continue
                end = at + 1
                while end < len(tags) and tags[end] == 2 + 2 * kind:
                    end += 1
                span = texts[i][a + at : a + end]
                if tags[at] % 2 == 1 and len(span) >= 6 and _CUE.search(span):  # begins with a begin tag
                    out[i].append((KINDS[kind], a + at, a + end))
                at = end
    return out


# ---- Spark jobs ------------------------------------------------------------------------------


def varied(text: str, tags: list[int], r: random.Random) -> tuple[str, list[int]]:
    """A labelled window with each of its spans rewritten so that its pattern doesn't match, cut to WINDOW characters."""
    out, labels, at = [], [], 0
    while at < len(text):
        kind = (tags[at] - 1) // 2
        if tags[at] == 0 or tags[at] % 2 == 0:
            out.append(text[at])
            labels.append(0)
            at += 1
            continue
        end = at + 1
        while end < len(text) and tags[end] == 2 + 2 * kind:
            end += 1
        span, name = text[at:end], KINDS[kind]
        if name == "email":
            dot = r.choice([" dot ", ".", " dot "])
            user, _, host = span.partition("@")
            span = user + r.choice([" at ", " at ", " [at] ", "(at)", " (at) "]) + host.replace(".", dot)
        elif name == "ip":
            span = span.replace(".", r.choice([" . ", "[.]", " dot ", ". "]))
        elif name == "card":
            digits, sign = re.sub("[^0-9]", "", span), r.choice([".", "_", "/", " . "])
            span = sign.join(digits[i : i + 4] for i in range(0, len(digits), 4))
        else:
            span = r.choice(["00", "(0)", "tel "]) + re.sub(r"[ ().-]+", r.choice([".", "/", "-", " "]), span[1:])
        out.append(span)
        labels += [1 + 2 * kind] + [2 + 2 * kind] * (len(span) - 1)
        at = end
    return "".join(out)[:WINDOW], labels[:WINDOW]


def training_windows(docs: DataFrame, text: str = "text", max_train: int = MAX_TRAIN) -> list[tuple[str, list[int]]]:
    """The ``max_train`` distinct labelled windows of the corpus with the least digests: a sample that copies of a window don't sway.

    A task keeps and hands on no more than that many.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, tuple[str, list[int]]] = {}
        most = 1 << 62
        for b in batches:
            for value in b.column(0):
                t = value.as_py()
                if not t or not _HINT.search(t):
                    continue
                spans, done = None, -1
                for m in _HINT.finditer(t):
                    if m.start() <= done:
                        continue
                    a = max(0, m.start() - 16 - zlib.crc32(t[m.start() : m.start() + 40].encode("utf-8", "replace")) % 48)
                    done = a + WINDOW
                    part = t[a:done]
                    key = int(hashlib.md5(part.encode("utf-8", "replace")).hexdigest()[:15], 16)
                    if key >= most or key in kept:
                        continue
                    spans = spans or base_spans(t)
                    kept[key] = part, tag_ids(len(part), spans, a).tolist()
                    if len(kept) >= 2 * max_train:
                        kept = dict(sorted(kept.items())[:max_train])
                        most = max(kept)
        kept = dict(sorted(kept.items())[:max_train])
        yield pa.RecordBatch.from_arrays([pa.array([x[0].encode("utf-8", "replace").decode() for x in kept.values()], pa.string()), pa.array([x[1] for x in kept.values()], pa.list_(pa.int32())), pa.array(list(kept), pa.int64())], ["win", "tags", "key"])

    windows = docs.select(F.col(text).cast("string").alias("t")).mapInArrow(run, "win string, tags array<int>, key long")
    kept = scratch(windows.groupBy("key").agg(F.min(F.struct("win", "tags")).alias("x")), "windows")
    bound = kept.select("key").orderBy("key").limit(max_train).agg(F.max("key")).first()[0]
    rows = kept.filter(F.col("key") <= F.lit(bound)).orderBy("key").collect()  # max_train of them at most
    discard(kept)
    return [(r.x.win, list(r.x.tags)) for r in rows]


def fit_windows(windows: list[tuple[str, list[int]]], seed: int = SEED) -> Tagger | None:
    """A tagger from labelled windows and one rewriting of each that has spans."""
    if not windows:
        return None
    r = random.Random(seed)
    every = windows + [varied(w, t, r) for w, t in windows if any(t)]
    ids, tags = np.zeros((len(every), WINDOW), np.int64), np.zeros((len(every), WINDOW), np.int64)
    for i, (w, t) in enumerate(every):
        n = min(len(w), len(t))
        ids[i, :n], tags[i, :n] = char_ids(w[:n]), t[:n]
    return Tagger().fit(ids, tags)


def train_tagger(docs: DataFrame, text: str = "text", max_train: int = MAX_TRAIN) -> Tagger | None:
    return fit_windows(training_windows(docs, text, max_train))


def find_pii(docs: DataFrame, text: str = "text", max_train: int = MAX_TRAIN) -> DataFrame:
    """(doc_id, base, added): base and added spans as arrays of (kind, start, end), in order of kind and start."""
    tagger = train_tagger(docs, text, max_train)
    held = docs.sparkSession.sparkContext.broadcast(tagger)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    struct = "array<struct<kind:string,start:bigint,end:bigint>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                b = whole.slice(lo, 1000)
                texts = [t or "" for t in b.column(1).to_pylist()]
                base = [[(k, s, e) for k, x in base_spans(t).items() for s, e in x] for t in texts]
                extra = tagged_spans(texts, held.value) if held.value else [[] for _ in texts]
                added = [sorted((x for x in new if not any(x[1] < e and s < x[2] for _, s, e in old)), key=lambda x: (KINDS.index(x[0]), x[1])) for old, new in zip(base, extra, strict=True)]
                arrays = [pa.array([[dict(zip(("kind", "start", "end"), x, strict=True)) for x in r] for r in rows], kind) for rows in (base, added)]
                yield pa.RecordBatch.from_arrays([b.column(0), *arrays], ["doc_id", "base", "added"])

    own = docs.select("doc_id", F.col(text).cast("string").alias("text"))
    return own.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, base {struct}, added {struct}")
