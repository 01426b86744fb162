"""Packed token files: packing, encoding, reading back."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronoterra.llm import queries, token_files

from ..oracle import SMALL

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
PATH = public.path("word_bpe_49k.json")


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 32).flatmap(lambda bits: st.tuples(st.just(bits), st.lists(st.integers(0, 2**bits - 1), max_size=50))))
def test_packing_round_trip(x):
    bits, ids = x
    data = token_files.pack(np.array(ids, np.uint32), bits)
    assert len(data) == -(-len(ids) // 8) * bits
    whole = int.from_bytes(data, "little")  # id i takes the bits from i * width on
    assert [whole >> i * bits & (1 << bits) - 1 for i in range(len(ids))] == ids
    assert token_files.unpack(data, bits, len(ids)).tolist() == ids


def test_too_large_ids_are_refused():
    with pytest.raises(ValueError):
        token_files.pack(np.array([8]), 3)
    assert [token_files.width_of(v) for v in (1, 2, 3, 49_408, 65_536, 65_537)] == [1, 1, 2, 16, 16, 17]


@pytest.mark.parametrize("bits", [11, 16, 17])
def test_random_access(tmp_path, bits):
    r = random.Random(bits)
    docs = [np.array([r.randrange(1 << bits) for _ in range(r.choice([0, 1, 5, 5000, 20_000]))], np.uint32) for _ in range(40)]
    with open(tmp_path / "x.ids", "wb") as f:
        out = token_files.FileWriter(pa.PythonFile(f, "w"), bits)
        for i in range(0, 40, 7):
            part = docs[i : i + 7]
            out.add(np.arange(i, i + len(part)), np.zeros(len(part)), np.concatenate(part), np.array([len(d) for d in part]))
        out.close()
    file = token_files.PackedFile(str(tmp_path / "x.ids"))
    flat = np.concatenate(docs)
    assert file.n_ids == len(flat) and file.bits == bits
    for i in r.sample(range(40), 20):
        assert file.document(i).tolist() == docs[i].tolist()
    for _ in range(50):
        a, b = sorted((r.randrange(len(flat) + 1), r.randrange(len(flat) + 1)))
        assert (file.ids(a, b) == flat[a:b]).all()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40), st.lists(st.sampled_from(["it's", "don't.", "<|endoftext|>", "a<|startoftext|>.", "X)", "e", "\u0301", ",", "9,5", "re", "'re", " ", "!!", "İ", "Straße", "ÀÿØ", "ÉtÉ", "e\u0301t", "word", "Word"]), max_size=12).map("".join), st.text(alphabet="aB1'.!)<>| \t\n\r\x0b\x0c\x1c\x85\xa0 ́eÉ語.,<|endoftext|>", max_size=40)), min_size=1, max_size=8))
def test_words_give_the_ids_of_the_whole_text(texts):
    encoder = token_files.Encoder.of(PATH)
    ids, lengths = encoder(pa.array(texts, pa.string()))
    want = [[*encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]
    assert lengths.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]


def test_query_equals_encoding_one_by_one(spark):
    t, start = tokenizers.Tokenizer.from_file(PATH), 0
    got = queries.op13_token_files(spark, SMALL).orderBy("doc_id").collect()
    for r, d in zip(got, spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect(), strict=True):
        ids = [*t.encode(d.text or "", add_special_tokens=False).ids, 1]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_odd_rows(spark, tmp_path, monkeypatch, name):
    long = "lorem ipsum dolor " * 50_000
    rows = [(3, "c d"), (None, "no id"), (1, None), (2, ""), (3, "c d"), (3, "other"), (5, long), (4, "a b")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, start long, `a.b` string")
    out = token_files.token_files(docs, public.path(name), str(tmp_path / "ids"), by_words=name.startswith("word")).collect()
    out.sort(key=lambda r: r.start)
    assert [r.doc_id for r in out] == [None, 1, 2, 3, 3, 3, 4, 5]
    assert [r.start for r in out] == np.concatenate([[0], np.cumsum([r.n_tokens for r in out])[:-1]]).tolist()
    t = tokenizers.Tokenizer.from_file(public.path(name))
    want = sorted([*t.encode(x or "", add_special_tokens=False).ids, 1] for _, x in rows)
    assert sorted(np.frombuffer(r.ids, "<u4").tolist() for r in out) == want
    assert token_files.token_files(docs.filter("false"), PATH).collect() == []


def test_many_files_keep_the_order(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text number {i} " * (i % 7)) for i in range(500)], "doc_id long, text string").repartition(5)
    dealt = docs.repartitionByRange(6, "doc_id").sortWithinPartitions("doc_id")
    token_files.write_token_files(dealt, str(tmp_path / "many"), 49_408, PATH)
    assert len(list((tmp_path / "many").glob("part-*.ids"))) > 1
    (tmp_path / "many" / "part-000000-left-by-a-lost-task.ids").write_bytes(b"rubbish")
    got = token_files.read_token_files(spark, str(tmp_path / "many"), ids_per_task=300)
    assert got.rdd.getNumPartitions() > 6
    rows = got.orderBy("start").collect()
    assert [r.doc_id for r in rows] == list(range(500))
    assert [r.start for r in rows] == np.concatenate([[0], np.cumsum([r.n_tokens for r in rows])[:-1]]).tolist()
    assert got.agg(F.sum("n_tokens")).first()[0] == rows[-1].start + rows[-1].n_tokens
    # ids that are there already are packed as they are
    token_files.write_token_files(got.select("doc_id", "ids").orderBy("doc_id"), str(tmp_path / "again"), 49_408)
    again = token_files.read_token_files(spark, str(tmp_path / "again")).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.ids) for r in again] == [(r.doc_id, r.start, r.ids) for r in rows]
