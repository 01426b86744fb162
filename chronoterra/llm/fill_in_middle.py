"""Fill-in-middle transformation: a kernel over the UTF-8 bytes of whole Arrow batches.

1. A table maps every byte to its class, and a table of class pairs says whether a unit begins between
   two adjacent bytes; the first byte of a document always begins one.
2. Cumulative sums of these marks, reset at documents, number the units and count them per document.
3. Two cuts per document are drawn from its hash; one search in the sums finds the bytes of all cuts.
4. One gather puts together prefix, middle, suffix and sentinels of all rows.

Units are code points (``chars``) or runs of anything but ASCII white space with the white space before
them (``words``). ``restore`` rebuilds the texts from outputs and forms by the same gather.

Defined cases: null and empty texts are plain with n = 0 and an empty output; a null doc_id is hashed
as the empty string; very long texts are cut whole; repeated rows give equal rows; extra columns pass
unchanged unless they have the name of a new column, whose values win; empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .token_files import by_bytes

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM, SPM_BELOW = 90, 20
SEED = "1"
#: Bytes of text that the kernel takes at once.
STEP_BYTES = 2_000_000

FORMS = ("plain", "psm", "spm")


def _classes(unit: str) -> tuple[np.ndarray, np.ndarray]:
    """Class of every byte, and whether a unit begins between classes (before, after)."""
    of = np.zeros(256, np.uint8)
    if unit == "chars":  # 1: continuation bytes
        of[0x80:0xC0] = 1
        return of, np.array([[True, False], [True, False]])
    if unit == "words":  # 1: white space; a unit begins where white space does
        of[[0x20, *range(0x09, 0x0E)]] = 1
        return of, np.array([[False, True], [False, False]])
    raise ValueError(f"no unit {unit!r}")


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of texts; null is empty."""
    texts = pc.cast(pc.fill_null(texts, ""), pa.large_string())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.array([], np.uint8)
    return raw, at - at[0]


def unit_sums(raw: np.ndarray, at: np.ndarray, unit: str = "chars") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cumulative units by byte, units of all documents before by document, units by document)."""
    of, begins = _classes(unit)
    cls, mark = of[raw], np.ones(len(raw), bool)
    mark[1:] = begins[cls[:-1], cls[1:]]
    mark[at[:-1][at[:-1] < at[1:]]] = True
    sums = np.cumsum(mark)
    upto = np.concatenate([[0], sums])[at]
    return sums, upto[:-1], np.diff(upto)


def cut_bytes(sums: np.ndarray, before: np.ndarray, at: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The byte at which each document's cut (units from its start) lies."""
    return np.minimum(np.searchsorted(sums, before + cuts + 1), at[1:])


def holds(raw: np.ndarray, at: np.ndarray, mark: bytes) -> np.ndarray:
    """Which documents hold ``mark``."""
    n = len(raw) - len(mark) + 1
    if n <= 0:
        return np.zeros(len(at) - 1, bool)
    hit = np.ones(n, bool)
    for i, b in enumerate(mark):
        hit &= raw[i : n + i] == b
    places = np.flatnonzero(hit)
    doc = np.searchsorted(at, places, side="right") - 1
    out = np.zeros(len(at) - 1, bool)
    out[doc[places + len(mark) <= at[doc + 1]]] = True
    return out


def first_places(raw: np.ndarray, at: np.ndarray, mark: bytes) -> np.ndarray:
    """The byte of each document's first ``mark``; its end where there is none."""
    n = max(0, len(raw) - len(mark) + 1)
    hit = np.ones(n, bool)
    for i, b in enumerate(mark):
        hit &= raw[i : n + i] == b
    places = np.append(np.flatnonzero(hit), len(raw) + len(mark))
    first = places[np.searchsorted(places, at[:-1])]
    return np.where(first + len(mark) <= at[1:], first, at[1:])


def gather(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Texts from parts of ``raw``: starts and sizes are rows x parts."""
    size = sizes.sum(axis=1)
    at = np.concatenate([[0], np.cumsum(size)])
    s, n = starts.ravel(), sizes.ravel()
    last = np.cumsum(n)
    source = np.arange(at[-1]) + np.repeat(s - last + n, n)
    return pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(at), pa.py_buffer(raw[source])]).cast(pa.string())


def transform(texts: pa.Array, hashes: list[np.ndarray], unit: str = "chars", marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> tuple[pa.Array, ...]:
    """(n, form, prefix units, middle units, output) of all texts together."""
    raw, at = _bytes_of(texts)
    sums, before, n = unit_sums(raw, at, unit)
    h1, h2, h3, h4 = hashes
    low, high = np.minimum(h1 % (n + 1), h2 % (n + 1)), np.maximum(h1 % (n + 1), h2 % (n + 1))
    plain = (n == 0) | (h3 % 100 >= PLAIN_FROM)
    for m in marks:
        plain |= holds(raw, at, m.encode())
    spm = ~plain & (h4 % 100 < SPM_BELOW)
    a, b = cut_bytes(sums, before, at, low), cut_bytes(sums, before, at, high)
    # sentinels follow the texts' bytes; a plain row is one part
    said = [m.encode() for m in marks]
    whole = np.concatenate([raw, np.frombuffer(b"".join(said), np.uint8)])
    where = len(raw) + np.concatenate([[0], np.cumsum([len(x) for x in said])])[:3]
    start, end = at[:-1], at[1:]
    p, s, m = ((np.full_like(a, w), np.full_like(a, len(x))) for w, x in zip(where, said, strict=True))
    pre, mid, suf = (start, a - start), (a, b - a), (b, end - b)
    rows = lambda parts: (np.stack([x[0] for x in parts], 1), np.stack([x[1] for x in parts], 1))
    psm_rows, spm_rows = rows([p, pre, s, suf, m, mid]), rows([s, suf, p, pre, m, mid])
    starts, sizes = (np.where(spm[:, None], x, y) for x, y in zip(spm_rows, psm_rows, strict=True))
    starts[plain, 0], sizes[plain, 0], sizes[plain, 1:] = start[plain], (end - start)[plain], 0
    form = pa.DictionaryArray.from_arrays(np.where(plain, 0, np.where(spm, 2, 1)).astype(np.int32), list(FORMS)).cast(pa.string())
    return pa.array(n), form, pa.array(low, mask=plain), pa.array(high - low, mask=plain), gather(whole, starts, sizes)


def rebuild(outputs: pa.Array, forms: pa.Array, marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> pa.Array:
    """The texts behind outputs of these forms."""
    raw, at = _bytes_of(outputs)
    p, s, m = (x.encode() for x in marks)
    kind = pc.fill_null(pc.index_in(forms, pa.array(FORMS)), 0).to_numpy()
    plain, spm = kind == 0, kind == 2
    start, end = at[:-1], at[1:]
    at_p, at_s, at_m = (first_places(raw, at, x) for x in (p, s, m))
    pre = np.where(spm, at_p, start) + len(p), np.where(spm, at_m, at_s)
    suf = np.where(spm, start, at_s) + len(s), np.where(spm, at_p, at_m)
    mid = at_m + len(m), end
    starts, ends = (np.stack([pre[i], mid[i], suf[i]], 1) for i in (0, 1))
    starts[plain, 0], ends[plain, 0] = start[plain], end[plain]
    starts[plain, 1:] = ends[plain, 1:] = 0
    return gather(raw, starts, ends - starts)


def _hashes(doc_id: Column, seed: str) -> list[Column]:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def _plain_names(df: DataFrame, new: tuple[str, ...]) -> tuple[list[Column], list[Column]]:
    """All columns under plain names, and back; names that ``new`` takes are left out."""
    taken = {x.lower() for x in new}
    named = [(f"c{i}", c) for i, c in enumerate(df.columns) if c.lower() not in taken]
    return [F.col(f"`{c.replace('`', '``')}`").alias(x) for x, c in named], [F.col(x).alias(c) for x, c in named]


def fill_in_middle(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", unit: str = "chars", marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE), seed: str = SEED) -> DataFrame:
    """The columns of ``docs`` without the text, and n, form, prefix_units, middle_units, output."""
    new = ("n", "form", "prefix_units", "middle_units", "output")
    there, back = _plain_names(docs.drop(text), new)
    hashes = [h.alias(f"h{i}") for i, h in enumerate(_hashes(F.col(doc_id), seed))]
    own = docs.select(*there, *hashes, F.col(text).cast("string").alias("text"))
    fields = [f for f in own.schema.fields if f.name.startswith("c")]
    schema = StructType([*fields, *[StructField(c, StringType() if c in ("form", "output") else LongType()) for c in new]])
    k = len(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in by_bytes(whole, k + 4, STEP_BYTES):
                made = transform(b.column(k + 4), [b.column(k + i).to_numpy() for i in range(4)], unit, marks)
                yield pa.RecordBatch.from_arrays([*b.columns[:k], *made], [*[f.name for f in fields], *new])

    return own.mapInArrow(run, schema).select(*back, *new)


def restore(made: DataFrame, output: str = "output", form: str = "form", marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE), text: str = "text") -> DataFrame:
    """The columns of ``made`` and the exact text behind each output."""
    there, back = _plain_names(made, (text,))
    own = made.select(*there, F.col(form).cast("string").alias("f"), F.col(output).cast("string").alias("o"))
    fields = own.schema.fields[:-2]
    schema = StructType([*fields, StructField("restored", StringType())])
    k = len(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in by_bytes(whole, k + 1, STEP_BYTES):
                yield pa.RecordBatch.from_arrays([*b.columns[:k], rebuild(b.column(k + 1), b.column(k), marks)], [*[f.name for f in fields], "restored"])

    return own.mapInArrow(run, schema).select(*back, F.col("restored").alias(text))
