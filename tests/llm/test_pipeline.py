"""The pipeline against plain versions of its stages."""

import re
from collections import Counter

import tiktoken

import corpus_pipeline
import public_tokenizers as P
from segue.llm import bpe

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_their_decisions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()} if name != "byte_bpe" else None
        docs = stage(spark, docs, SF)
        docs.cache()
        if k + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == columns
            seen[name] = (before, docs.collect())
    before, after = seen["language_id"]
    assert len(after) == sum(bool(re.search(r"[^\W\d_]", r.text or "")) for r in before.values())
    before, after = seen["near_duplicates"]
    assert len({r.doc_id for r in after}) == len(after) <= len(before)
    texts = Counter(r.text for r in after)
    assert max(texts.values()) == 1  # exact copies are near copies
    before, after = seen["substring_dedup"]
    for r in after:
        whole, kept = before[r.doc_id].text.split(), r.text.split()
        rest = iter(whole)
        assert kept and all(w in rest for w in kept) and r.n_chars == len(r.text)
    before, after = seen["source_mix"]
    assert max(Counter(r.doc_id for r in after).values()) <= 3
    words, taken = Counter(), Counter()
    for r in before.values():
        words[r.source] += len(r.text.split())
    for r in after:
        taken[r.source] += len(r.text.split())
    assert abs(sum(taken.values()) - sum(words.values())) < 0.3 * sum(words.values())
    vocab = bpe.vocabulary(bpe.default_path())
    reference = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=vocab.ranks, special_tokens={})
    want = Counter((r.doc_id, tuple(reference.encode_ordinary(r.text))) for r in after)
    assert Counter((r.doc_id, tuple(r.ids)) for r in docs.collect()) == want


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"] and out.count() > 0


def test_no_rows_and_names_used_inside(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    odd = docs.selectExpr("*", "1 AS keys", "'t' AS tkey", "2 AS starts", "3 AS copies", "4 AS _text", "true AS rejected", "map('a', 1) AS row_low", "doc_id AS component_id", "5 AS c0")
    for some in (odd, odd.limit(0)):
        docs = some
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == odd.columns
        assert (docs.count() > 0) == (some is odd)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"]
