import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T
from tokenizers import Tokenizer

from tallyfield.llm import plans
from tallyfield.llm.bpe import Encoder, decode_bpe, encode_bpe
from tests.llm.cases import SF_DIR, documents, real_documents, with_clashes


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(plans.VOCABULARY)


ENCODER = Encoder(plans.VOCABULARY)
ODD = [
    None, "", " ", "a" * 5000, "ab" * 3000, " " * 300 + "x", "<|endoftext|>", "a <|endoftext|><|endoftext|> b",
    "<|endoftext", "x\x1c\x85​y", "日本語 🙂🙂 don't", "\x00\x01\n\n a", "9" * 700,
]


def packed(ids):
    return np.array(ids, "<u4").tobytes()


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_any_text(text):
    want = Tokenizer.from_file(plans.VOCABULARY) if not hasattr(test_any_text, "t") else test_any_text.t
    test_any_text.t = want
    assert ENCODER.encode([text]) == [packed(want.encode(text, add_special_tokens=False).ids)]


def test_odd_rows(spark, tokenizer):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(0, None), (None, "same"), (None, "same")]
    df = with_clashes(documents(spark, rows))
    got = decode_bpe(encode_bpe(df, plans.VOCABULARY), plans.VOCABULARY).collect()
    assert len(got) == len(rows)
    for row in got:
        ids = tokenizer.encode(row.text or "", add_special_tokens=False).ids
        assert row.token_ids == packed(ids) and row.n_tokens == len(ids)
        assert row.decoded == tokenizer.decode(ids, skip_special_tokens=False) == (row.text or "")


def test_empty_and_broken_ids(spark):
    assert encode_bpe(documents(spark, []), plans.VOCABULARY).count() == 0
    schema = T.StructType([T.StructField("token_ids", T.BinaryType())])
    half = ENCODER.encode(["é"])[0]
    euro = packed([ENCODER.merges.first[0xE2]])
    rows = decode_bpe(spark.createDataFrame([(None,), (euro,), (half,)], schema), plans.VOCABULARY).collect()
    assert [r.decoded for r in rows] == ["", "�", "é"]


def test_query(spark, tokenizer):
    got = {r.doc_id: r for r in plans.op10_bpe(spark, SF_DIR).collect()}
    docs = real_documents()
    assert len(got) == len(docs)
    for doc_id, text, *_ in docs:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        row = got[doc_id]
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(packed(ids)).hexdigest()
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        assert row.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
