"""Toxicity by noisy-channel deobfuscation.

1. A character trigram model is counted over every text of the corpus, at hashed places.
2. Stretches written with leetspeak, separators or repeated letters become lattices: each character
   may stand for itself, a letter it imitates, nothing, or a word gap, at a channel cost. Viterbi
   decoding under the model picks the cheapest reading; the rest of the text is read as it is.
3. The restored text is scored. Evidence is whole words and word beginnings whose share of toxic
   training documents is significantly above the base rate; the most telling word makes the score,
   which is scaled so that the best cut on the training rows is at one half.

Training uses labelled rows with crc32(doc_id) mod 5 != 0, at most about ``max_train`` of them taken
by hash (documented bound); the language model, decoding and scoring cover all documents whole.

Defined cases: null or empty texts score the base rate; very long texts are counted and read whole;
equal texts score alike, so ties stay ties; a null doc_id is scored but never labelled and
counts as not held out; contradicting labels of one doc_id count as toxic; without toxic training
rows every score is 0; repeated rows are scored each; other columns pass
through whatever their names, but for ``score``, which is replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import checkpoint, quoted, slices

MAX_TRAIN = 12_000
#: Expected number of features that pass by chance.
CHANCE = 0.1
PREFIXES = (3, 4, 5, 6)
#: Readings and word scores that a task remembers; the others are worked out anew.
CACHE = 50_000

#: Letters that a digit or sign imitates.
IMITATES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c", "*": "aeiou"}
SEPARATORS = " .-_*\t\n"
#: Costs (negative log probabilities) of the channel.
LEET_COST, STAR_COST, REPEAT_COST, JOIN_COST, GAP_COST, DROP_COST = 1.0, 2.5, 0.3, 0.3, 1.5, 3.0

_WORD = re.compile(r"[^\W\d_]+")
_RUN = re.compile(r"[0-9@$!|€(*.\-_]+")
_REPEAT = re.compile(r"([^\W\d_])\1\1")
_SPACED = re.compile(r"(?<![^\W_])[^\W_](?:[ .\-_*]{1,2}[^\W_]){2,}(?![^\W_])")
#: Holds wherever _SPACED matches (its last two signs), and is found faster.
_SPACED_END = re.compile(r"[ .\-_*][^\W_][ .\-_*]{1,2}[^\W_](?![^\W_])")


# ---- character model -------------------------------------------------------------------------

#: Hashed places of trigrams, bigrams and letters: what is counted, collected and broadcast is bounded by them.
TRI, BI, ONE = 1 << 18, 1 << 16, 1 << 14
#: Characters counted at once.
STRIDE = 500_000
_K = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)

_letter_codes: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For every code point itself if it is a letter, else the gap's."""
    if not _letter_codes:
        _letter_codes.append(np.fromiter((i if chr(i).isalpha() else 32 for i in range(0x110000)), np.uint32, 0x110000))
    return _letter_codes[0]


def _place(n: int, a: int, b: int = 0, c: int = 0) -> int:
    h = (a * _K[0] ^ b * _K[1] ^ c * _K[2]) & 0xFFFFFFFF
    return (h ^ h >> 15) & n - 1


def _places(n: int, *codes: np.ndarray) -> np.ndarray:
    """_place of whole arrays."""
    h = codes[0] * np.uint32(_K[0])
    for x, k in zip(codes[1:], _K[1:], strict=False):
        h = h ^ x * np.uint32(k)
    return (h ^ h >> np.uint32(15)) & np.uint32(n - 1)


def trigram_counts(text: str) -> np.ndarray:
    """Counts of the letter trigrams, bigrams and letters of lower-cased ``text`` at their places; anything but a letter is a gap."""
    out = np.zeros(TRI + BI + ONE, np.int64)
    for lo in range(0, len(text), STRIDE):
        codes = _letters()[np.frombuffer(text[max(0, lo - 2) : lo + STRIDE].lower().encode("utf-32-le", "replace"), np.uint32)]
        if len(codes) > 2:
            a, b, c = codes[:-2], codes[1:-1], codes[2:]
            out[:TRI] += np.bincount(_places(TRI, a, b, c), minlength=TRI)
            out[TRI : TRI + BI] += np.bincount(_places(BI, b, c), minlength=BI)
            out[TRI + BI :] += np.bincount(_places(ONE, c), minlength=ONE)
    return out


class CharModel:
    """Trigram model that backs off to bigrams and letters; ``counts`` from the whole corpus."""

    def __init__(self, counts: np.ndarray):
        self.tri, self.bi, self.one = counts[:TRI], counts[TRI : TRI + BI], counts[TRI + BI :]
        self.total = int(self.one.sum()) or 1
        self.known: dict[str, float] = {}

    def cost(self, a: str, b: str, c: str) -> float:
        if (known := self.known.get(a + b + c)) is not None:
            return known
        i, j, k = ord(a), ord(b), ord(c)
        one = (int(self.one[_place(ONE, k)]) + 0.5) / (self.total + 30)
        two = (int(self.bi[_place(BI, j, k)]) + 5 * one) / (int(self.one[_place(ONE, j)]) + 5)
        fresh = -math.log((int(self.tri[_place(TRI, i, j, k)]) + 5 * two) / (int(self.bi[_place(BI, i, j)]) + 5))
        if len(self.known) < CACHE:
            self.known[a + b + c] = fresh
        return fresh


def decode(stretch: str, model: CharModel) -> str:
    """The cheapest reading of a lower-cased stretch: exact Viterbi over the last two letters written."""
    best: dict[tuple[str, str], tuple[float, str]] = {(" ", " "): (0.0, "")}
    runs = {i for m in _REPEAT.finditer(stretch) for i in range(m.start() + 1, _run_end(stretch, m.start()))}
    for i, ch in enumerate(stretch):
        options: list[tuple[str, float]] = []
        if ch.isalpha():
            options.append((ch, 0.0))
            if i in runs:
                options.append(("", REPEAT_COST))
        elif ch in SEPARATORS:
            options += [("", JOIN_COST), (" ", GAP_COST), *((x, STAR_COST) for x in IMITATES.get(ch, ""))]
        else:
            options += [(x, LEET_COST) for x in IMITATES.get(ch, "")]
            options.append((" ", 2 * GAP_COST))
            if not ch.isdigit():
                options.append(("", DROP_COST))
        fresh: dict[tuple[str, str], tuple[float, str]] = {}
        for (a, b), (cost, path) in best.items():
            for x, price in options:
                if not x or (x == " " and b == " "):
                    key, total, text = (a, b), cost + price, path
                else:
                    key, total, text = (b, x), cost + price + model.cost(a, b, x), path + x
                if key not in fresh or total < fresh[key][0]:
                    fresh[key] = (total, text)
        best = fresh
    end = {k: (c + (0 if k[1] == " " else model.cost(*k, " ")), t) for k, (c, t) in best.items()}
    return min(end.values())[1].strip()


def _run_end(text: str, at: int) -> int:
    end = at
    while end < len(text) and text[end] == text[at]:
        end += 1
    return end


def _is_letter(ch: str) -> bool:
    return ch.isalnum() and not ch.isdecimal()


def _odd_places(low: str) -> Iterator[int]:
    """Places in tokens with leetspeak (signs within letters, before two or after two of them) or a letter three times over."""
    end = len(low)
    for m in _RUN.finditer(low):
        a, b = m.span()
        before, after = a > 0 and _is_letter(low[a - 1]), b < end and _is_letter(low[b])
        if before and after:
            yield a
        elif after and not (set(m.group()) & set("*.-_")):
            if (a == 0 or low[a - 1].isspace()) and b + 1 < end and _is_letter(low[b + 1]):
                yield a
        elif before and a > 1 and _is_letter(low[a - 2]) and (b == end or low[b].isspace()) and not (set(m.group()) & set("*.-_€(")):
            yield a
    codes = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    same = codes[1:] == codes[:-1]
    for i in np.flatnonzero(same[1:] & same[:-1]).tolist():
        if _is_letter(low[i]):
            yield i


def restore(text: str, model: CharModel, cache: dict[str, str]) -> str:
    """Lower-cased ``text`` with its suspicious stretches replaced by their readings."""
    low = text.lower()
    spans = {m.span() for m in _SPACED.finditer(low)} if _SPACED_END.search(low) else set()
    first, reach = 0, 0
    for at in _odd_places(low):
        if first <= at < reach:
            continue  # in the token found last
        first, reach = at, at + 1
        while first and not low[first - 1].isspace():
            first -= 1
        while reach < len(low) and not low[reach].isspace():
            reach += 1
        spans.add((first, reach))
    if not spans:
        return low
    out, at = [], 0
    for a, b in sorted(spans):
        if a < at:
            continue
        s = low[a:b]
        if (fresh := cache.get(s)) is None:
            fresh = decode(s, model)
            if len(cache) < CACHE:
                cache[s] = fresh
        out += [low[at:a], fresh]
        at = b
    return "".join([*out, low[at:]])


# ---- Spark jobs ------------------------------------------------------------------------------


def character_model(docs: DataFrame, text: str = "text") -> CharModel:
    """Counted over every text; what is shuffled and collected is bounded by the places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, size = np.zeros(TRI + BI + ONE, np.int64), [], 0
        for b in batches:
            for x in b.column(0):
                held.append(x.as_py() or "")
                size += len(held[-1]) + 1
                if size > STRIDE:
                    total += trigram_counts(" ".join(held))
                    held, size = [], 0
        total += trigram_counts(" ".join(held))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["place", "n"])

    counts = docs.select(F.col(text).cast("string").alias("t")).mapInArrow(run, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(TRI + BI + ONE, np.int64)
    total[counts.column("place").to_numpy()] = counts.column("n").to_numpy()
    return CharModel(total)


def evidence(words: set[str]) -> set[str]:
    """Whole words ('w' first) and their beginnings ('p' first)."""
    out = {"w" + w for w in words}
    for n in PREFIXES:
        out |= {"p" + w[:n] for w in words if len(w) > n}
    return out


def training_rows(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, text: str = "text") -> DataFrame:
    """(text, toxic) of about ``max_train`` labelled rows at most, none of them held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic")).filter("id is not null and toxic is not null").groupBy("id").agg(F.max("toxic").alias("toxic"))
    known = known.filter(F.crc32(F.col("id").cast("string").cast("binary")) % 5 != 0)
    n = known.count()
    million = 1_000_000
    part = min(million, int(million * max_train / max(1, n)))
    known = known.filter(F.pmod(F.xxhash64("id"), F.lit(million)) < part)
    held = F.broadcast(known) if min(n, max_train) * 16 <= 8_000_000 else known  # the sample's bound
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.col(text).cast("string").alias("text")).join(held, "id").select("text", "toxic")


def toxic_evidence(train: DataFrame, model: CharModel) -> tuple[dict[str, float], float]:
    """Precision of each significant feature, and the base rate. The features are those of the training sample, so its bound is theirs."""
    held = train.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good, bad, sizes, cache = Counter(), Counter(), [0, 0], {}
        for b in batches:
            for text, toxic in zip((x.as_py() for x in b.column(0)), b.column(1).to_pylist(), strict=True):
                (bad if toxic else good).update(evidence(set(_WORD.findall(restore(text or "", held.value, cache)))))
                sizes[bool(toxic)] += 1
        names = ["", *(bad.keys() | good.keys())]
        yield pa.RecordBatch.from_arrays(
            [pa.array(names), pa.array([sizes[1], *(bad[x] for x in names[1:])], pa.int64()), pa.array([sizes[0], *(good[x] for x in names[1:])], pa.int64())],
            ["f", "pos", "neg"],
        )

    counts = checkpoint(train.mapInArrow(run, "f string, pos long, neg long").groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).filter("f = '' or pos >= 3 or pos + neg >= 5"))
    sizes = counts.filter("f = ''").first()
    if not sizes or not sizes.pos:
        return {}, 0.0
    base = sizes.pos / (sizes.pos + sizes.neg)
    tried = counts.count()
    p = F.col("pos") / (F.col("pos") + F.col("neg"))
    kl = p * F.log(p / base) + F.when(p < 1, (1 - p) * F.log((1 - p) / (1 - base + 1e-9))).otherwise(0.0)
    strength = (F.col("pos") + F.col("neg")) * kl
    kept = counts.filter((F.col("f") != "") & (F.col("pos") >= 3) & (p > min(1.0, 2 * base)) & (strength > math.log(tried / CHANCE)))
    precision = ((F.col("pos") + 2 * base) / (F.col("pos") + F.col("neg") + 2)).alias("p")
    kept = checkpoint(kept.select("f", precision))
    # a whole word seen often enough speaks for itself, whatever its beginning says
    words = counts.filter(F.col("f").startswith("w") & (F.col("pos") + F.col("neg") >= 5)).withColumn("word", F.substring("f", 2, 1_000_000))
    begins = F.explode(F.array(*[F.concat(F.lit("p"), F.substring("word", 1, n)) for n in PREFIXES]))
    common = words.select("f", precision, begins.alias("begin")).join(kept.select(F.col("f").alias("begin")), "begin", "left_semi").select("f", "p").distinct()
    found = {r.f: r.p for r in common.collect()}
    return found | {r.f: r.p for r in kept.collect()}, base


def word_score(word: str, weights: dict[str, float]) -> float:
    """Precision of the whole word if it is known, else of its most telling beginning."""
    if (p := weights.get("w" + word)) is not None:
        return p
    return max((weights.get("p" + word[:n], 0.0) for n in PREFIXES if len(word) > n), default=0.0)


def raw_score(text: str | None, model: CharModel, weights: dict[str, float], base: float, restored: dict[str, str], words: dict[str, float]) -> float:
    """The best word's precision, a little higher with every further word of half that precision."""
    most, more = min(base, 0.4), 0
    for w in set(_WORD.findall(restore(text or "", model, restored))):
        if (p := words.get(w)) is None:
            p = word_score(w, weights)
            if len(words) < CACHE:
                words[w] = p
        if p >= 0.5:
            more += 1
        most = max(most, p)
    return most + (1 - most) * 0.1 * (1 - 0.5 ** max(0, more - 1))


def best_cut(train: DataFrame, model: CharModel, weights: dict[str, float], base: float) -> float:
    """The raw score from which training rows are called toxic with the best F1 (from a histogram)."""
    held = train.sparkSession.sparkContext.broadcast((model, weights, base))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restored, words = {}, {}
        for b in batches:
            s = [int(1000 * raw_score(t.as_py(), *held.value, restored, words)) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(s, pa.int32()), b.column(1)], ["s", "toxic"])

    rows = sorted(train.mapInArrow(run, "s int, toxic int").groupBy("s").agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).collect(), reverse=True)
    total, hit, called, best = sum(r.t for r in rows), 0, 0, (0.0, 0.5)
    for i, r in enumerate(rows):
        hit, called = hit + r.t, called + r.n
        below = rows[i + 1].s if i + 1 < len(rows) else 0
        best = max(best, (2 * hit / (total + called), (r.s + below + 1) / 2000), key=lambda x: x[0])
    return min(max(best[1], 0.05), 0.95)


def score(raw: float, cut: float) -> float:
    """Maps raw scores to 0..1 so that ``cut`` is at one half."""
    return 0.5 * raw / cut if raw < cut else 0.5 + 0.5 * (raw - cut) / (1 - cut)


def toxicity_scores(docs: DataFrame, corpus: DataFrame, labels: DataFrame, text: str = "text", max_train: int = MAX_TRAIN, columns: list[str] | None = None) -> DataFrame:
    """Columns of ``docs`` (or the listed ``columns``) and ``score``. The models come from ``corpus`` and ``labels``; ``score`` replaces a column of that name."""
    model = character_model(corpus, text)
    train = training_rows(corpus, labels, max_train, text)
    weights, base = toxic_evidence(train, model)
    cut = best_cut(train, model, weights, base) if weights else 1.0
    held = docs.sparkSession.sparkContext.broadcast((model, weights, base))
    kept = [c for c in (docs.columns if columns is None else columns) if c != "score" or text == "score"]
    names = kept if text in kept else [*kept, text]
    own = docs.select(*[quoted(c) for c in names]).toDF(*[f"c{i}" for i in range(len(names))])
    at, fields = names.index(text), own.columns[: len(kept)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restored: dict[str, str] = {}
        words: dict[str, float] = {}
        for b in batches:
            for part in slices(b):
                s = [score(raw_score(t.as_py(), *held.value, restored, words), cut) for t in part.column(at)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], pa.array(s, pa.float64())], [*fields, "score"])

    return own.mapInArrow(run, StructType([*own.schema.fields[: len(kept)], StructField("score", DoubleType())])).toDF(*kept, "score")
