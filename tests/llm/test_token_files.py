from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from reviewlake.llm import token_files
from reviewlake.llm.queries import TOKENIZER


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(TOKENIZER)


def texts():
    rng = random.Random(5)
    return ["", " ", "a", " a", "a  b", "a \n b", "a b c", "it's ok, isn't it?", "　x y",
            "end <|endoftext|> of it", "y" * 9000, "tab\there and there",
            *("".join(rng.choices(" a\n'1.éb ", k=40)) for _ in range(500)),
            *(" ".join(rng.choices(["one", "two,", "3", "four.\nFive"], k=50)) for _ in range(50))]


@pytest.mark.parametrize("memo", [10, 800_000])
def test_pieces_give_the_ids_of_whole_texts(tokenizer, monkeypatch, memo):
    monkeypatch.setattr(token_files, "MEMO_PIECES", memo)
    encoder = token_files.Encoder(TOKENIZER)
    all_texts = texts()
    for at in range(0, len(all_texts), 7):
        part = all_texts[at:at + 7]
        for text, ids in zip(part, encoder.encode(part)):
            assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


class Watched:
    """A tokenizer that notes the pieces of the longest text it was given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.most = tokenizer, 0

    def encode_batch_fast(self, texts, **options):
        self.most = max(self.most, *(text.count(" ") for text in texts))
        return self.tokenizer.encode_batch_fast(texts, **options)


def test_new_pieces_are_encoded_few_at_once(tokenizer):
    encoder = token_files.Encoder(TOKENIZER)
    encoder.tokenizer = Watched(encoder.tokenizer)
    sizes = [0, 1, 299, 300, 301, 901]
    part = [" ".join(["a", *(f"w{n}x{k}," for k in range(n))]) for n in sizes]
    for text, ids in zip(part, encoder.encode(part)):
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert encoder.tokenizer.most <= 300


def plain_index(rows, tokenizer):
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("parts", [1, 5])
def test_round_trip(spark, tmp_path, docs, tokenizer, parts):
    path = str(tmp_path / "tokens")
    token_files.write_tokens(docs, path, TOKENIZER, parts=parts)
    got = token_files.token_index(spark, path).orderBy("start").collect()
    assert [tuple(r) for r in got] == plain_index([(r.doc_id, r.text) for r in docs.collect()],
                                                  tokenizer)
    one = token_files.read_tokens(spark, path).where("doc_id = 17").collect()
    assert len(one) == 1 and one[0].ids[-1] == 0


def test_odd_rows(spark, tmp_path, odd_docs, no_docs, tokenizer):
    path = str(tmp_path / "odd")
    token_files.write_tokens(odd_docs, path, TOKENIZER)
    got = token_files.token_index(spark, path).orderBy("start").collect()
    assert [tuple(r) for r in got] == plain_index([(r.doc_id, r.text)
                                                   for r in odd_docs.collect()], tokenizer)
    token_files.write_tokens(no_docs, str(tmp_path / "none"), TOKENIZER)
    assert token_files.token_index(spark, str(tmp_path / "none")).count() == 0


def rows_read(frame) -> int:
    """Rows that the scan hands on."""
    frame.collect()
    return frame._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply(
        "numOutputRows").value()


def test_lookups_skip_row_groups(spark, tmp_path):
    path = str(tmp_path / "tokens")
    docs = spark.range(20_000).select((2 * F.col("id")).alias("doc_id"), F.lit("a b").alias("text"))
    token_files.write_tokens(docs, path, TOKENIZER, parts=1)
    files = token_files.read_tokens(spark, path)
    assert rows_read(files) == 20_000
    found = files.where("doc_id = 24690")
    assert found.count() == 1
    assert rows_read(files.where("doc_id = 24690")) <= 2 * token_files.INDEX_STRIDE  # row index
    assert rows_read(files.where("doc_id = 24691")) <= 2 * token_files.INDEX_STRIDE


def test_no_id_that_a_row_group_spans_but_lacks_is_read(spark, tmp_path):
    """Least and largest ids can't tell; the Bloom filter can."""
    path = str(tmp_path / "tokens")
    docs = spark.range(20_000).select((2 * F.col("id")).alias("doc_id"), F.lit("a b").alias("text"))
    token_files.write_tokens(docs, path, TOKENIZER, parts=1)
    files = token_files.read_tokens(spark, path)
    read = [rows_read(files.where(f"doc_id = {n}")) for n in range(10_001, 30_001, 2_000)]
    assert read.count(0) >= 8


def test_equal_ids_and_other_types(spark, tmp_path, tokenizer):
    rows = [("k", f"text {i}") for i in range(40)] + [("a", "x"), (None, "y")]
    starts = []
    for n in (1, 7):
        path = str(tmp_path / f"{n}")
        docs = spark.createDataFrame(rows, "doc_id string, text string").repartition(n)
        token_files.write_tokens(docs, path, TOKENIZER)
        index = token_files.token_index(spark, path, id_type="string").orderBy("start").collect()
        starts.append([tuple(r) for r in index])
    assert starts[0] == starts[1] and [r[0] for r in starts[0][:2]] == [None, "a"]


def test_other_space_by_plain_search():
    every = [chr(c) for c in range(0x3100)]
    assert [c for c in every if token_files._other_space(f"a{c}b")] == [
        c for c in every if c.isspace() and c not in " \n"]
    assert token_files._other_space("é\tb") and not token_files._other_space("é b\nc")
