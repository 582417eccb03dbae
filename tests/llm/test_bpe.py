import hashlib
import random

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

import public_tokenizers as P
from segue.llm import bpe


@pytest.fixture(scope="module")
def reference():
    vocab = bpe.vocabulary(bpe.default_path())
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=vocab.ranks, special_tokens={})


def texts():
    rng = random.Random(1)
    parts = ["'", "s", "t", "re", "ve", "m", "ll", "d", " ", "  ", "\n", "\t", "a", "B", "é", "1", "²", "中", "!", " ", " ", "\r\n", "x'll", "😀", "́"]
    made = ["".join(rng.choices(parts, k=rng.randint(1, 30))) for _ in range(400)]
    return [None, "", " ", "'s", "''s", " 's", "\n's", "a'sure", "a" * 3000, " " * 700 + "x", "=" * 999, "the end. " * 9000, *made]


def test_ids_and_round_trip(spark, reference):
    rows = [(k, x, 1) for k, x in enumerate(texts())] + [(3, "'s", 1)]
    out = bpe.round_trip(spark.createDataFrame(rows, "doc_id long, text string, ids int"), bpe.default_path()).collect()
    assert len(out) == len(rows)
    by_id = dict((k, x) for k, x, _ in rows)
    for r in out:
        text = by_id[r.doc_id] or ""
        assert r.ids == reference.encode_ordinary(text)
        assert bytes(r.decoded) == text.encode()


def test_encode_then_decode_and_empty(spark, reference):
    df = spark.createDataFrame([(1, "Two words"), (2, None)], "doc_id long, text string")
    encoded = bpe.encode(df, bpe.default_path())
    back = {r.doc_id: bytes(r.decoded) for r in bpe.decode(encoded, bpe.default_path()).collect()}
    assert back == {1: b"Two words", 2: b""}
    assert bpe.decode(encoded.withColumn("ids", F.lit(None).cast("array<int>")), bpe.default_path()).count() == 2
    assert bpe.encode(df.limit(0), bpe.default_path()).count() == 0


def test_query(spark, reference):
    out = {r.doc_id: r for r in bpe.op3_byte_bpe(spark, "/root/testdata/sf0.001").collect()}
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        ids = reference.encode_ordinary(r.text or "")
        assert out[r.doc_id].n_tokens == len(ids)
        assert out[r.doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert out[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_ranks_of_all_pairs():
    """The table of pairs that merge holds each of them, and no other."""
    vocab = bpe.vocabulary(bpe.default_path())
    keys = np.fromiter(vocab.pairs, np.int64)
    keys = np.concatenate([keys, np.random.default_rng(0).integers(0, vocab.size**2, 50_000), (256 * np.arange(vocab.size, dtype=np.int64)) % vocab.size**2])
    want = [vocab.pairs.get(k, int(vocab.none)) for k in keys.tolist()]
    assert vocab.rank_of(keys // vocab.size, keys % vocab.size).tolist() == want
    pairs = [(a, b) for a in range(256) for b in range(256)]
    want = [vocab.pairs.get(int(vocab.byte_ids[a]) * vocab.size + int(vocab.byte_ids[b]), int(vocab.none)) for a, b in pairs]
    assert vocab.byte_pairs.tolist() == want
