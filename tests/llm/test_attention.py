import math
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest

from segue.llm import attention
from segue.llm._exchange import unpack

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def by_hand(rows):
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    counts = Counter()
    for d, t in rows:
        if not held(d):
            counts.update([*words(t), None])
    n, v = sum(counts.values()), len(counts)
    out = []
    for d, t in rows:
        tokens = [*words(t), None]
        out.append((d, held(d), len(tokens), sum(counts[x] > 0 for x in tokens), n, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in tokens)))
    return out


def matches(got, rows):
    want = by_hand(rows)
    key = lambda r: (str(r[0]), r[2], round(r[5], 5))
    have = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=key)
    for a, b in zip(have, sorted(want, key=key), strict=True):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], rel=1e-9)


@pytest.mark.parametrize("head", [attention.HEAD, 50])
def test_query_against_hand(spark, monkeypatch, head):
    monkeypatch.setattr(attention, "HEAD", head)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = attention.op7_lm_score(spark, "/root/testdata/sf0.001").collect()
    matches(got, rows)


def test_better_than_subwords_alone(spark):
    """On held-out texts the model beats a unigram of its own subwords."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = [r for r in attention.op7_lm_score(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    texts = {r.doc_id: r.text for r in docs.collect()}
    speller = attention.Speller(attention.default_path())
    ids, first = [], [0]
    for run in attention.runs(attention.pa.array([texts[r.doc_id] for r in got], attention.pa.large_string())):
        _, _, subwords, _, _ = speller.words(run)
        ids.append(subwords)
    ids = np.concatenate(ids)
    p = np.bincount(ids) / len(ids)
    assert sum(r.score for r in got) > 0.85 * np.log10(p[ids]).sum()


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "The cat"), (4, "the cat"), (4, "the cat"), (None, "a cat"), (7, "x" * 5000), (8, "so long " * 20000), (9, "é 日本")]
    df = spark.createDataFrame([(d, t, 1.0) for d, t in rows], "doc_id long, text string, score double")
    got = attention.score(df, attention.default_path()).collect()
    matches(got, rows)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert attention.score(df.limit(0), attention.default_path()).count() == 0


def test_a_proper_distribution_and_windows():
    """Probabilities of all next subwords sum to one, and blocks change nothing that is causal."""
    rng = np.random.default_rng(0)
    size = 30
    ids = rng.integers(0, size - 2, 700)
    net = attention.train(ids, np.array([0, 300, 700]), size, epochs=2)
    assert np.allclose(net.out.sum(axis=0), 1, atol=1e-5)
    for n in (1, 15, 16, 17, 33, 40):
        start = ids[: n - 1]
        total = sum(10 ** net.log10(np.append(start, t), np.array([0, n]))[-1] for t in range(size))
        assert total == pytest.approx(1, abs=1e-4)
    a = net.log10(ids[:100], np.array([0, 100]))
    b = net.log10(ids[:60], np.array([0, 60]))
    assert np.allclose(a[:60], b, atol=1e-5)


def test_training_learns_a_pattern():
    ids = np.tile([3, 5, 7, 9], 400)
    net = attention.train(ids, np.array([0, 800, 1600]), 14)
    assert net.log10(ids[:200], np.array([0, 200]))[20:].mean() > math.log10(0.6)


def test_long_unknown_words_cost(spark):
    """A held-out word of many subwords, not in the training texts, costs about what its subwords do."""
    rows = [(d, "the cat sat on the mat") for d in range(1, 40)]
    held = next(d for d in range(100, 200) if zlib.crc32(str(d).encode()) % 7 == 2)
    long = "".join(chr(97 + k * k * 7 % 26) + str(k % 10) for k in range(400))
    df = spark.createDataFrame([*rows, (held, "the"), (held, f"the {long}")], "doc_id long, text string")
    short, whole = sorted((r.n_tokens, r.score) for r in attention.score(df, attention.default_path()).collect() if r.doc_id == held)
    assert whole[1] < short[1] - 300


def test_all_rows_are_learned_from(spark, monkeypatch):
    """A pattern that only rows outside the start and long texts hold is learned."""
    monkeypatch.setattr(attention, "SAMPLE", 1)
    monkeypatch.setattr(attention, "SAMPLE_TEXT", 40)
    path = attention.default_path()
    df = spark.createDataFrame([(k, "zebra quilt " * 2500) for k in range(20)], "doc_id long, text string").repartition(4)
    scorer, _ = attention.fit(df, attention.Scratch(spark, "test"), path)
    speller = attention.Speller(path)
    _, first, subwords, upto, _ = speller.words(next(attention.runs(attention.pa.array(["zebra quilt " * 40], attention.pa.large_string()))))
    assert scorer.net.log10(subwords, upto[first])[30:-1].mean() > math.log10(0.3)
    assert scorer.net.out.sum(axis=0, dtype=np.float64) == pytest.approx(1, abs=1e-4)


def naive(net, ids):
    """log10 of each subword, one place after the other: it attends to those before it in its block and the block before."""
    keys = net.here.shape[1] - net.mix.shape[1]
    given, out = [net.pad, *ids[:-1]], []
    for t, wanted in enumerate(ids):
        start = (t // attention.BLOCK - 1) * attention.BLOCK
        weight, value = 0.0, np.zeros(net.mix.shape[0])
        for pos in range(start, t + 1):
            near = net.near[given[pos] if pos >= 0 else net.pad].astype(float)
            s = float(net.here[given[t], :keys].astype(float) @ near[:keys])
            w = math.exp(min(max(s, -attention.MOST), attention.MOST) + float(net.bias[t % attention.BLOCK, pos - start]))
            weight, value = weight + w, value + w * near[keys:-1]
        gate = value / weight @ net.mix.astype(float) + net.here[given[t], keys:].astype(float)
        gate = np.exp(np.clip(gate, -attention.MOST, attention.MOST))
        out.append(math.log10(float(gate @ net.out[wanted].astype(float)) / float(gate.sum())))
    return out


def test_scores_against_naive_attention(spark):
    """Whole scores of short, long, empty and unknown texts: naive masked attention, then the mixture with counted words."""
    path = attention.default_path()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(60).collect()]
    docs = [(d, t[:1500]) for d, t in docs] + [(901, ""), (902, None), (903, "Qzx-17 unheardof " * 20), (904, "the " * 100)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).cache()
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    counts = Counter(x for d, t in docs if not held(d) for x in [*words(t), None])
    total, spell = sum(counts.values()), attention.Speller(path)
    # the model as it is fitted for the scores that are told
    kept = {}
    plain = attention.fit

    def fit(*a):
        kept["scorer"], table_ = plain(*a)
        return kept["scorer"], table_

    attention.fit = fit
    try:
        got = {r.doc_id: r.score for r in attention.score(df, path).collect()}
    finally:
        attention.fit = plain
    net = kept["scorer"].net
    share = (1 - attention.FREE) * attention.DISCOUNT * len(counts) / total + attention.FREE
    for d, t in docs:
        tokens, _, subwords, upto, _ = spell.words(next(attention.runs(attention.pa.array([t or ""], attention.pa.large_string()))))
        logs, want = naive(net, subwords.tolist()), 0.0
        for k, word in enumerate([*words(t), None]):
            logp = sum(logs[upto[k] : upto[k + 1]])
            seen = (1 - attention.FREE) * max(counts[word] - attention.DISCOUNT, 0) / total
            want += math.log10(seen + share * 10**logp) if seen > 0 else math.log10(share) + logp
        assert len(tokens) == len(words(t)) + 1
        assert got[d] == pytest.approx(want, rel=2e-4, abs=2e-3)


def test_every_window_makes_steps():
    """What a task learns from holds every subword of every row, in steps as in distributions."""
    path = attention.default_path()
    spell = attention.Speller(path)
    texts = [f"w{k} " * 30 + "the end of it " * k for k in range(40)]
    ids, first = [], [0]
    for run in attention.runs(attention.pa.array(texts, attention.pa.large_string())):
        _, cut, subwords, upto, _ = spell.words(run)
        ids.append(subwords)
        first += upto[cut][1:].tolist()
    ids = np.concatenate(ids)

    class Shared:
        value = path, attention.begin(ids[: first[3]], np.array(first[:4]), spell.size, epochs=1)

    batch = attention.pa.RecordBatch.from_arrays([attention.pa.array(texts)], ["text"])
    (sent,) = attention._learn(Shared, 1)(iter([batch]))
    got = unpack(attention.pa.Table.from_batches([sent]), attention.LEARNED)
    own = got["token"] < spell.size
    assert got["n"][own].sum() == sum(-(-(b - a) // attention.BLOCK) for a, b in zip(first[:-1], first[1:], strict=True)) * attention.BLOCK
    drawn = got["row"].view(np.float32).reshape(len(own), -1)[own][:, attention.WIDTH :].sum(axis=1)
    assert np.array_equal(np.bincount(got["token"][own], weights=drawn, minlength=spell.size), np.bincount(ids, minlength=spell.size))


def a_learner(size=40, n=6000):
    rng = np.random.default_rng(3)
    ids, first = rng.integers(0, size - 2, n), np.array([0, 5, 300, n])
    return ids, first, attention.begin(ids[:300], np.array([0, 300]), size, epochs=1)


def test_blocks_in_a_row_learn_as_single_windows_do():
    """A step on pieces of many blocks, worked on some at a time, changes what one on the same windows one by one does."""
    ids, first, start = a_learner()
    got = []
    for length in (1, 5, 16):
        now, expected = start.copy(), np.zeros_like(start.out)
        parts = attention.pieces(ids, first, len(start.out), length)
        assert parts[2].sum() == len(ids)
        now.step(*parts, expected)
        got.append({**now.w, "expected": expected})
    assert np.allclose(got[0]["expected"].sum(axis=1), np.bincount(ids, minlength=len(start.out)), rtol=1e-4)
    for other in got[1:]:
        for name, x in got[0].items():
            assert np.allclose(x, other[name], rtol=1e-3, atol=1e-4 if name != "expected" else 1e-2), name


def test_gradients_against_differences():
    """What a step takes for the gradient is what the mean log probability changes by."""
    ids, first, start = a_learner()
    now, rng = start.copy(), np.random.default_rng(1)
    now.mean = {k: np.zeros_like(x) for k, x in now.mean.items()}
    now.step(*attention.pieces(ids, first, len(start.out), 16), np.zeros_like(start.out))
    for name, mean in now.mean.items():
        way = rng.normal(0, 1, mean.shape).astype(np.float32)
        loss = []
        for far in (0.01, -0.01):
            moved = start.copy()
            moved.w[name] = moved.w[name] + np.float32(far) * way
            loss.append(-math.log(10) * moved.net().log10(ids, first).mean())
        assert (loss[0] - loss[1]) / 0.02 == pytest.approx(10 * float((mean * way).sum()), rel=0.05, abs=2e-4), name


def test_a_step_needs_little_memory():
    """A step's arrays are of some windows at a time, not of all its windows, so they stay near the processor."""
    ids, first, start = a_learner(n=16 * 1024)
    now, expected = start.copy(), np.zeros_like(start.out)
    parts = attention.pieces(ids, first, len(start.out), attention.PIECE)
    tracemalloc.start()
    now.step(*parts, expected, rng=np.random.default_rng(0))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10 << 20
