import hashlib
import random
import tempfile

import numpy as np
import pytest

from segue.llm import induction, suffixes


def by_hand(rows, width=50):
    """(id, bytes, removed, spans, hash of what is kept) for each row."""
    first = {}
    data = [(d, (t or "").encode()) for d, t in rows]
    for d, b in data:
        for i in range(len(b) - width + 1):
            if d is not None:
                first[b[i : i + width]] = min(first.get(b[i : i + width], d), d)
    out = []
    for d, b in data:
        gone = [False] * len(b)
        for i in range(len(b) - width + 1):
            if d is not None and first[b[i : i + width]] < d:
                gone[i : i + width] = [True] * width
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def compare(spark, rows, width=50, tasks=3):
    df = spark.createDataFrame([(d, t, 0, "x") for d, t in rows], "doc_id long, text string, keys int, tkey string").repartition(tasks)
    got = suffixes.dedup(df, width=width).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) == by_hand(rows, width)
    for r in got:
        assert sum(s.end - s.start for s in r.spans) == r.n_removed and len(r.spans) == r.n_spans
        assert (r.kept is None) == (r.n_removed == 0)


def passages(seed, alphabet, n=90):
    rng = random.Random(seed)
    text = lambda k: "".join(rng.choices(alphabet, k=k))
    shared = [text(rng.choice([49, 50, 51, 60, 150, 700])) for _ in range(8)]
    rows = []
    for d in rng.sample(range(-200, 1000), n):
        parts = [text(rng.randint(0, 120))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(shared), text(rng.randint(0, 60))]
        if rng.random() < 0.2:
            parts.append(text(1) * rng.randint(40, 130))
        if rng.random() < 0.2:
            parts.append(text(rng.randint(2, 5)) * rng.randint(20, 70))
        rows.append((d, "".join(parts)))
    return rows


@pytest.mark.parametrize("alphabet", ["ab", "abcdefgh \n", "äöé中🎵"])
def test_against_brute_force(spark, alphabet):
    rows = passages(3, alphabet)
    rows += [(2000, rows[0][1]), (2000, rows[1][1]), (2000, rows[1][1]), (None, rows[0][1]), (2001, None), (2002, ""), (2003, " \n "), (1 << 40, rows[5][1])]
    compare(spark, rows)


@pytest.mark.parametrize("width", [1, 2, 7, 20, 130])
def test_other_widths(spark, width):
    compare(spark, passages(5, "abcdefghijkl", 40), width)


def test_hot_anchors_and_long_texts(spark, monkeypatch):
    """A line that all documents have, with other words around it, and texts that are read in parts."""
    monkeypatch.setattr(suffixes, "HOT", 8)
    monkeypatch.setattr(suffixes, "HOT_SHARE", 0.0)
    monkeypatch.setattr(suffixes, "SEGMENT", 300)
    monkeypatch.setattr(suffixes, "LONGEST", 30)
    monkeypatch.setattr(suffixes, "HELD", 50)
    rng = random.Random(7)
    line = "All rights reserved, copying is allowed for personal use."
    rows = [(k, "".join(rng.choices("abcd", k=rng.randint(0, 90))) + line + "".join(rng.choices("xy", k=rng.randint(0, 900)))) for k in range(60)]
    rows += [(100 + k, rows[k][1]) for k in range(5)] + [(200, "=" * 3000), (201, "=" * 1000), (202, "ab" * 900)]
    compare(spark, rows, tasks=5)


def test_empty_and_bad_width(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert suffixes.dedup(none).count() == 0
    with pytest.raises(ValueError, match="byte"):
        suffixes.dedup(none, width=0)


def test_query_by_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = suffixes.op11_suffix_dedup(spark, "/root/testdata/sf0.001").collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) == by_hand(rows)


def sorted_by_hand(text):
    order = sorted(range(len(text)), key=lambda i: text[i:])
    lcp = [0] * len(text)
    for k in range(1, len(text)):
        a, b = text[order[k - 1] :], text[order[k] :]
        lcp[k] = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return order, lcp


@pytest.mark.parametrize("held", [4, 64, 1 << 23])
def test_suffix_array_against_sorting(monkeypatch, held):
    """Random and periodic texts, runs; queues that spill, small ranges and batches, chains cut short."""
    rng = np.random.default_rng(held)
    close = induction.Batch.close
    for turn in range(250):
        monkeypatch.setattr(induction, "RANGE", int(rng.choice([2, 8, 1 << 16])))
        monkeypatch.setattr(induction, "BATCH", int(rng.choice([2, 5, 1 << 18])))
        rounds = int(rng.choice([1, 2, 8]))
        monkeypatch.setattr(induction.Batch, "close", lambda self, *a, rounds=rounds: close(self, *a, rounds))
        text = rng.integers(1, int(rng.integers(2, 7)), int(rng.integers(1, 120)))
        if turn % 3 == 0:
            text = np.tile(text[: int(rng.integers(1, 8))], 30)
        if turn % 4 == 0:
            text = np.repeat(text, rng.integers(1, 6, len(text)))
        text = np.append(text, 0).astype(np.int32)
        with tempfile.TemporaryDirectory() as folder:
            order, lcp = induction.suffix_array(text, folder, held)
        want = sorted_by_hand(text.tolist())
        assert order.tolist() == want[0] and lcp.tolist() == want[1]


def test_queues_spill_and_files_go(tmp_path, monkeypatch):
    spilled = []
    spill = induction.Queue._spill
    monkeypatch.setattr(induction.Queue, "_spill", lambda self: (spill(self), spilled.append(self.spilled)))
    rng = np.random.default_rng(1)
    text = np.append(rng.integers(1, 30, 60_000), 0).astype(np.int32)
    order, lcp = induction.suffix_array(text, str(tmp_path), 4096)
    again = induction.suffix_array(text, str(tmp_path))
    assert np.array_equal(order, again[0]) and np.array_equal(lcp, again[1])
    assert max(spilled) > 0 and not list(tmp_path.iterdir())


def test_lists_of_anchors_take_six_bytes_each():
    keys = np.array([0, 1, 255, 1 << 20, (1 << 48) - 1], np.uint64)
    lists = suffixes.pa.array([keys[:2].tobytes(), b"", keys[2:].tobytes()], suffixes.pa.binary())
    for part, want in ((lists, [keys[:2], keys[:0], keys[2:]]), (lists.slice(0, 0), [])):
        narrow = suffixes._narrow(part).to_pylist()
        assert [len(x) for x in narrow] == [6 * len(w) for w in want]
        assert all(np.array_equal(suffixes._wide([x]), w) for x, w in zip(narrow, want, strict=True))
    assert np.array_equal(suffixes._wide([]), keys[:0])


def test_shuffles_of_anchors_go_before_pieces_are_dealt(spark, monkeypatch):
    """What the anchors were dealt with is let go of as soon as they are written."""
    calls, free, send = [], suffixes.Scratch.free, suffixes._send_pieces
    monkeypatch.setattr(suffixes.Scratch, "free", lambda self: calls.append("free") or free(self))
    monkeypatch.setattr(suffixes, "_send_pieces", lambda *a: calls.append("send") or send(*a))
    compare(spark, passages(5, "abc", 20))
    assert calls == ["free", "send"]


def test_windows_that_no_other_document_has_are_not_sorted(monkeypatch):
    """A line shorter than a window, in many documents among other words, and a passage that some have."""
    sizes, sort = [], induction.suffix_array
    monkeypatch.setattr(induction, "suffix_array", lambda text, *a: sizes.append(len(text)) or sort(text, *a))
    rng = random.Random(11)
    text = lambda k: bytes(rng.choices(range(97, 123), k=k))
    line, passage = text(45), text(80)
    texts = [text(60) + line + text(60) for _ in range(200)]
    for d in (10, 20, 30):
        texts[d] += passage[: 80 - d // 2] + text(20)
    offsets = np.append(0, np.cumsum([len(t) for t in texts]))
    data = np.frombuffer(b"".join(texts), np.uint8)
    s = suffixes.Stretches(data, offsets, 50, suffixes.spans_of(50)[0])
    box = suffixes.Pieces(1, 50)
    box.add(data, s.at, key=s.key, size=s.n + 49, doc=s.row, tkey=np.zeros(len(s.key), np.int64), pos=s.pos)
    found = suffixes._shard(50)(suffixes.pa.Table.from_batches(list(box.close())))
    late = {(d, p) for d, ranges in zip(found["doc_id"].to_pylist(), found["starts"].to_pylist(), strict=True) for x in np.frombuffer(ranges, np.uint64).tolist() for p in range(x >> 32, (x >> 32) + (x & 0xFFFFFFFF))}
    first, want = {}, set()
    for d, t in enumerate(texts):
        for p in range(len(t) - 49):
            if first.setdefault(t[p : p + 50], d) < d:
                want.add((d, p))
    assert late == want and want
    assert max(sizes, default=0) < 300
