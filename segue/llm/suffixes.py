"""Removal of byte strings that an earlier document already has, by suffix arrays.

A window is ``width`` bytes in a row. A byte goes if a window over it also
starts in a document with a smaller id.

A shard must hold every place of a window. So a window goes by its anchor, the
k-gram in it with the least hash; windows in a row with one anchor are a piece
of text. A first round tells each document which of its anchors another has, a
second one deals the pieces with those to shards, where pieces with an anchor
are together. Equal pieces are one there, of the least document that has it:
in all others all its windows are late. A piece whose anchor no other document's
piece has, and windows whose longer anchor only one document has, are equal to
nothing else and stay out. That is asked with longer and longer anchors, at last
the window itself, and what is left of equal pieces is one piece again.

What is left of a shard is one text, and ``induction`` sorts its suffixes. A
stretch of the suffix array whose common prefixes reach the width holds the
places of one window: it is late in all documents but the least.

An anchor that more than a small share of all documents' pieces have is hot.
Its windows go by the hash of the whole window instead, each a piece of its own.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import induction
from ._common import Scratch, buckets_for, table
from ._exchange import Outbox, exchange, first_of, grouped, last_of, pack, schema_of, unpack
from ._text import BYTE_CODE, Run, gather, mix64, runs, span_hashes, spread, window_hashes

WIDTH = 50

#: Bytes of the first and of further anchors, for windows of 50.
ANCHOR, FURTHER = 16, (32, 50, 50)

#: Bits of an anchor that are kept: two of a bucket that agree in them are taken for one, and the bytes tell.
KEY = np.uint64((1 << 48) - 1)

#: Bytes of a text that are looked at at once; windows of a piece; pieces and anchors held in a task.
SEGMENT, LONGEST, HELD, ANCHORS_HELD = 1 << 22, 2048, 1 << 15, 1 << 18

#: Pieces of a shard, on average; an anchor is hot with so many holders, and this share of all.
IN_SHARD, HOT, HOT_SHARE = 1 << 16, 4096, 1 / (1 << 18)

ANCHORS = {"key": "u4", "key_high": "u2", "doc": "u4", "doc_high": "u4", "n": "u4", "done": "u1"}
PIECES = {"size": "u4", "doc": "u4", "doc_high": "u4", "tkey": "i8", "pos": "u4", "n": "u4"}


def anchors(codes: np.ndarray, width: int, k: int) -> np.ndarray:
    """The least hash of a k-gram, for each window."""
    least, left = window_hashes(codes, k), width - k + 1
    if len(codes) < width:
        return np.empty(0, np.uint64)
    span = 1
    while 2 * span <= left:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    return np.minimum(least[: len(least) - (left - span)], least[left - span :]) if span < left else least


def spans_of(width: int) -> tuple[int, ...]:
    """Lengths of all anchors, for windows of a width."""
    return tuple(max(1, width * k // WIDTH) for k in (ANCHOR, *FURTHER))


class Stretches:
    """Windows in a row of one anchor, of some texts: anchor, row, place of the first window in the text, windows, and first byte."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, width: int, k: int):
        self.codes = BYTE_CODE[data]
        key = anchors(self.codes, width, k)
        key &= KEY
        windows = np.maximum(np.diff(offsets) - width + 1, 0)
        turn = np.ones(len(key), bool)
        np.not_equal(key[1:], key[:-1], out=turn[1:])
        turn[offsets[:-1][windows > 0]] = True
        for r in np.flatnonzero(windows > LONGEST):
            turn[offsets[r] : offsets[r] + windows[r] : LONGEST] = True
        first = np.flatnonzero(turn)
        row = np.searchsorted(offsets, first, side="right") - 1
        end = (offsets[:-1] + windows)[row]
        n = np.minimum(np.append(first[1:], len(key))[: len(first)], end) - first
        some = np.flatnonzero(first < end)  # others begin in a text's last bytes, where windows would span two
        self.row, self.at, self.n = row[some], first[some], n[some]
        self.key, self.pos = key[self.at], self.at - offsets[self.row]


def stretches_of(flat: np.ndarray, size: np.ndarray, width: int, k: int, at_once: int = 1 << 19) -> Stretches:
    """The stretches of texts that lie one behind the other, found some texts at a time."""
    ends = np.cumsum(size)
    parts, a = [], 0
    while a < len(size):
        begin = int(ends[a] - size[a])
        b = max(a + 1, int(np.searchsorted(ends, begin + at_once, side="right")))
        s = Stretches(flat[begin : int(ends[b - 1])], np.append(0, ends[a:b] - begin), width, k)
        s.row, s.at, s.codes = s.row + a, s.at + begin, None
        parts.append(s)
        a = b
    whole = parts[0]
    for name in ("key", "row", "pos", "at", "n"):
        setattr(whole, name, np.concatenate([getattr(s, name) for s in parts]))
    return whole


def segments(run: Run, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place in the text, bytes, offsets): the run itself, or parts of a long text that overlap by a window less one."""
    if run.rows > 1 or len(run.data) <= SEGMENT + width:
        yield 0, run.data, run.offsets
        return
    for at in range(0, max(len(run.data) - width + 1, 1), SEGMENT):
        part = run.data[at : at + SEGMENT + width - 1]
        yield at, part, np.array([0, len(part)])


def _combine_anchors(x: dict) -> tuple[dict, np.ndarray]:
    """One entry for an anchor and document. Anchors that two documents of the
    task have are known to be shared: their holders pass through, and two of
    them ask, for hot ones must be told."""
    key, doc = _keys(x), _docs(x)
    order = np.lexsort([doc, key])
    key, doc = key[order], doc[order]
    new = first_of(key, doc) == np.arange(len(key))
    key, doc = key[new], doc[new]
    here = np.arange(len(key))
    first, last = first_of(key), last_of(key)
    shared = first != last
    edge = shared & ((first == here) | (last == here))
    n = np.where(first == here, last - first + 1, 0)
    keys = np.concatenate([key, key[edge]])
    out = {
        "n": np.concatenate([np.where(shared, 0, 1), n[edge]]).astype(np.uint32),
        "done": np.concatenate([shared, np.full(int(edge.sum()), 2)]).astype(np.uint8),
    } | _split(np.concatenate([doc, doc[edge]])) | _split_key(keys)
    spots = mix64(keys)
    over = out["done"] == 1
    spots[over] = mix64(_docs(out)[over].astype(np.uint64))
    return {c: out[c] for c in ANCHORS}, spots


def _split_key(key: np.ndarray) -> dict:
    return {"key": (key & np.uint64(0xFFFFFFFF)).astype(np.uint32), "key_high": (key >> np.uint64(32)).astype(np.uint16)}


def _keys(x: dict) -> np.ndarray:
    return x["key_high"].astype(np.uint64) << np.uint64(32) | x["key"]


def _narrow(blobs: pa.Array) -> pa.Array:
    """Lists of anchors in the six bytes of each that are kept."""
    cuts = np.frombuffer(blobs.buffers()[1], np.int32)[: len(blobs) + 1] // 8 * 6
    data = np.frombuffer(blobs.buffers()[2] or b"", np.uint8)
    return pa.Array.from_buffers(pa.binary(), len(blobs), [None, pa.py_buffer(cuts.astype(np.int32).tobytes()), pa.py_buffer(data.reshape(-1, 8)[:, :6].tobytes())])


def _wide(blobs: list[bytes]) -> np.ndarray:
    """The anchors of lists of six bytes each."""
    data = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, 6)
    out = np.zeros((len(data), 8), np.uint8)
    out[:, :6] = data
    return out.view(np.uint64).ravel()


def _split(doc: np.ndarray) -> dict:
    bits = doc.astype(np.int64).view(np.uint64)
    return {"doc": (bits & np.uint64(0xFFFFFFFF)).astype(np.uint32), "doc_high": (bits >> np.uint64(32)).astype(np.uint32)}


def _docs(x: dict) -> np.ndarray:
    return (x["doc_high"].astype(np.uint64) << np.uint64(32) | x["doc"]).view(np.int64)


def _shared_anchors(x: dict) -> pa.Table:
    """(doc_id, keys, n): a document's anchors that another has; without a document, an anchor of many, and its holders."""
    asked = x["done"] != 1
    doc, key, n, done = _docs(x), _keys(x), x["n"], x["done"]
    order = np.flatnonzero(asked)[np.lexsort([doc[asked], key[asked]])]
    k, d = key[order], doc[order]
    first, last = first_of(k), last_of(k)
    found = (done[order] == 0) & (d[first] != d[last])
    out = grouped([np.concatenate([doc[~asked], d[found]])], np.concatenate([key[~asked], k[found]]), ["doc_id", "keys"])
    keys = _narrow(out.column("keys").combine_chunks() if out.num_rows else pa.array([b""], pa.binary()).slice(0, 0))
    out = pa.table({"doc_id": out.column("doc_id"), "keys": keys, "n": pa.array(np.array([len(b) // 6 for b in keys.to_pylist()], np.int64))})
    heads = np.flatnonzero(first == np.arange(len(k)))
    sums = np.add.reduceat(n[order].astype(np.int64), heads) if len(heads) else np.empty(0, np.int64)
    many = sums >= HOT
    hot = pa.table({"doc_id": pa.nulls(int(many.sum()), pa.int64()), "keys": pa.array([x.tobytes() for x in k[heads[many]]], pa.binary()), "n": pa.array(sums[many])})
    return pa.concat_tables([out, hot])


def _send_anchors(buckets: int, width: int):
    k = spans_of(width)[0]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        box = Outbox(ANCHORS, buckets, _combine_anchors, ANCHORS_HELD)
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for run in runs(batch.column("text")):
                for _, data, offsets in segments(run, width):
                    s = Stretches(data, offsets, width, k)
                    if len(s.key):
                        zero = np.zeros(len(s.key), np.uint32)
                        box.add(n=zero, done=zero.astype(np.uint8), **_split(ids[run.first + s.row]), **_split_key(s.key))
                    yield from box.full()
        yield from box.close()

    return work


def cut_out(flat: np.ndarray, first: np.ndarray, lengths: np.ndarray, at_once: int = 1 << 14) -> np.ndarray:
    """The concatenation of flat[first:first + length], some at a time, so that places take little memory."""
    out = np.empty(int(lengths.sum()), flat.dtype)
    at = 0
    for k in range(0, len(first), at_once):
        part = gather(flat, first[k : k + at_once], lengths[k : k + at_once])
        out[at : at + len(part)] = part
        at += len(part)
    return out


def packed(data: bytes) -> bytes:
    """Text of many pieces in little room: its length, then its bytes by Zstandard."""
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def unpacked(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)


def _pack_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as ``packed``, so that dealing the documents by id takes less room."""
    for batch in batches:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tkey"), pa.array([None if t is None else packed(t) for t in texts], pa.binary())], ["doc_id", "tkey", "packed"])


def _in_parts(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Batches of fewer rows, so that less text is unpacked at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _texts(column: pa.Array) -> pa.Array:
    return pa.array([None if t is None else unpacked(t) for t in column.to_pylist()], pa.large_binary())


class Pieces:
    """Pieces of text of a task. Of equal ones only the least document's go on,
    the text once; the others' windows are late, and go to their document's bucket in ranges."""

    def __init__(self, buckets: int, width: int):
        self.buckets, self.width = buckets, width
        self.fields: list[dict] = []
        self.data: list[np.ndarray] = []
        self.held = 0

    def add(self, data: np.ndarray, at: np.ndarray, **fields: np.ndarray) -> None:
        self.fields.append(fields)
        self.data.append(cut_out(data, at, fields["size"].astype(np.int64)))
        self.held += len(at)

    def close(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        x = {k: np.concatenate([f[k] for f in self.fields]).astype(t, copy=False) for k, t in (("key", "u8"), ("size", "i8"), ("doc", "i8"), ("tkey", "i8"), ("pos", "u4"))}
        flat = np.concatenate(self.data)
        begin = np.cumsum(x["size"]) - x["size"]
        self.fields, self.data, self.held = [], [], 0
        same = distinct(flat, x["size"])
        order = np.lexsort([x["doc"], same])
        first = first_of(same[order])
        asks = x["doc"][order] == x["doc"][order][first]
        late = _merged({c: x[c][order[~asks]] for c in ("doc", "tkey", "pos")} | {"n": x["size"][order[~asks]] - (self.width - 1)})
        once = np.where(first == np.arange(len(first)), x["size"][order], 0)[asks]  # a piece's text goes with its first place
        order = order[asks]
        spots = np.concatenate([mix64(x["key"][order]), mix64(late["doc"].astype(np.uint64))])
        bucket = (spots % np.uint64(self.buckets)).astype(np.int64)
        none = np.zeros(len(late["doc"]), np.int64)
        doc = _split(np.concatenate([x["doc"][order], late["doc"]]))
        both = {"size": np.concatenate([once, none]), **doc, **{c: np.concatenate([x[c][order], late[c]]) for c in ("tkey", "pos")}, "n": np.concatenate([np.zeros(len(order), np.int64), late["n"]])}
        batch = pack({c: both[c].astype(t, copy=False) for c, t in PIECES.items()}, bucket)
        inner = np.argsort(bucket, kind="stable")
        lengths = both["size"][inner]
        text = cut_out(flat, np.concatenate([begin[order], none])[inner], lengths)
        tail = np.flatnonzero(np.append(bucket[inner][1:] != bucket[inner][:-1], True))
        cuts = np.append(0, np.cumsum(lengths)[tail]).tolist()
        blob = pa.array([packed(text[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns, blob], [*batch.schema.names, "data"])


def _merged(x: dict) -> dict:
    """Ranges of places, those that follow on each other as one."""
    order = np.lexsort([x["pos"], x["tkey"], x["doc"]])
    doc, tkey, pos, n = (x[c][order] for c in ("doc", "tkey", "pos", "n"))
    pos = pos.astype(np.int64)
    new = np.ones(len(pos), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (tkey[1:] != tkey[:-1]) | (pos[1:] != pos[:-1] + n[:-1])
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(pos))[: len(at)] - 1
    return {"doc": doc[at], "tkey": tkey[at], "pos": pos[at], "n": pos[last] + n[last] - pos[at]}


def distinct(flat: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A number for each of the strings that lie in ``flat`` one behind the other; equal strings have one."""
    ends = np.append(0, np.cumsum(size))
    column = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(np.ascontiguousarray(flat).tobytes())])
    return column.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _send_pieces(buckets: int, width: int, hot):
    k = spans_of(width)[0]
    salt = np.uint64(0x9E3779B97F4A7C15)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        box = Pieces(buckets, width)
        hot_keys = hot.value
        for batch in _in_parts(batches):
            ids, tkeys = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "tkey"))
            lists = batch.column("keys").to_pylist()
            for run in runs(_texts(batch.column("packed"))):
                known = [_wide(lists[run.first + r]) for r in range(run.rows)]
                rows = np.repeat(np.arange(run.rows), [len(x) for x in known])
                shared = np.unique(np.concatenate(known) ^ mix64(rows.astype(np.uint64) * salt))
                for begin, data, offsets in segments(run, width):
                    s = Stretches(data, offsets, width, k)
                    asked = s.key ^ mix64(s.row.astype(np.uint64) * salt)
                    some = np.flatnonzero(shared[np.minimum(np.searchsorted(shared, asked), len(shared) - 1)] == asked) if len(shared) else np.empty(0, np.int64)
                    key, row, pos, at, n = (v[some] for v in (s.key, s.row, s.pos, s.at, s.n))
                    is_hot = hot_keys[np.minimum(np.searchsorted(hot_keys, key), len(hot_keys) - 1)] == key if len(hot_keys) else np.zeros(len(key), bool)
                    if is_hot.any():
                        of, step = spread(n[is_hot])
                        one_at = at[is_hot][of] + step
                        whole = span_hashes(s.codes, one_at, one_at + width)
                        key, row, pos, at, n = (np.concatenate([v[~is_hot], w]) for v, w in ((key, whole), (row, row[is_hot][of]), (pos, pos[is_hot][of] + step), (at, one_at), (n, np.ones(len(of), np.int64))))
                    for k0 in range(0, len(key), HELD):
                        part = slice(k0, k0 + HELD)
                        spot = run.first + row[part]
                        box.add(data, at[part], key=key[part], size=n[part] + width - 1, doc=ids[spot], tkey=tkeys[spot], pos=begin + pos[part])
                        if box.held >= HELD:
                            yield from box.close()
        yield from box.close()
        pa.default_memory_pool().release_unused()

    return work


def _held_by_several(keys: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether two documents have a key, for each place of it."""
    order = np.lexsort([doc, keys])
    key, holder = keys[order], doc[order]
    out = np.empty(len(keys), bool)
    out[order] = holder[first_of(key)] != holder[last_of(key)]
    return out


def _sorted_out(width: int, flat: np.ndarray, size: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(piece, place) of the windows that a piece of a smaller document has, too, by the suffix array of all pieces."""
    # one text: bytes are symbols from 2 on, 1 ends a piece, 0 ends the text
    ends = np.cumsum(size + 1)
    symbols = np.ones(int(ends[-1]) + 1, np.int32)
    symbols[-1] = 0
    inside = np.ones(int(ends[-1]), bool)
    inside[ends - 1] = False
    symbols[:-1][inside] = flat
    symbols[:-1][inside] += 2
    del inside
    first, windows = ends - size - 1, size - (width - 1)
    with tempfile.TemporaryDirectory() as folder:
        order, lcp = induction.suffix_array(symbols, folder)
        piece = np.searchsorted(ends, order, side="right").astype(np.int32)
        piece[0] = 0
        place = order - first[piece]
        valid = (place < windows[piece]) & (order < len(symbols) - 1)
        owner = doc[piece]
        heads = np.flatnonzero(np.concatenate([[True], lcp[1:] < width]))
        least = np.repeat(np.minimum.reduceat(np.where(valid, owner, np.iinfo(np.int64).max), heads), np.diff(np.append(heads, len(order))))
        late = np.flatnonzero(valid & (owner > least))
        return piece[late], np.asarray(place[late])


def _narrowed(width: int, flat: np.ndarray, size: np.ndarray, doc: np.ndarray, spans: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``_late_ranges`` of distinct pieces: windows whose anchor of the first of ``spans`` no other document has stay out, and what is left is less of the pieces."""
    none = np.empty(0, np.int64)
    if not len(size):
        return none, none, none
    if not spans:
        piece, place = _sorted_out(width, flat, size, doc)
        return piece, place, np.ones(len(piece), np.int64)
    s = stretches_of(flat, size, width, spans[0])
    stay = np.flatnonzero(_held_by_several(s.key, doc[s.row]))
    if not len(stay):
        return none, none, none
    # stretches in a row that stay are one piece
    head = np.ones(len(stay), bool)
    head[1:] = (s.row[stay[1:]] != s.row[stay[:-1]]) | (s.pos[stay[1:]] != s.pos[stay[:-1]] + s.n[stay[:-1]])
    windows = np.add.reduceat(s.n[stay], np.flatnonzero(head))
    row, pos, at = (v[stay[head]] for v in (s.row, s.pos, s.at))
    del s, stay, head
    size = windows + width - 1
    piece, place, n = _late_ranges(width, cut_out(flat, at, size), size, doc[row], spans[1:])
    return row[piece], pos[piece] + place, n


def _late_ranges(width: int, flat: np.ndarray, size: np.ndarray, doc: np.ndarray, spans: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, place, windows): ranges of windows that a piece of a smaller document has, too.

    Equal pieces are one, of the least document that has it; all windows of the others are late.
    """
    same = distinct(flat, size)
    _, one = np.unique(same, return_index=True)
    least = np.full(len(one), np.iinfo(np.int64).max)
    np.minimum.at(least, same, doc)
    after = doc > least[same]
    whole = np.flatnonzero(after)
    which, place, n = _narrowed(width, cut_out(flat, (np.cumsum(size) - size)[one], size[one]), size[one], least, spans)
    mine = np.flatnonzero(~after)
    piece, place, n = _at_all(mine[np.argsort(same[mine], kind="stable")], same, which, place, n)
    return np.concatenate([whole, piece]), np.concatenate([np.zeros(len(whole), np.int64), place]), np.concatenate([size[whole] - (width - 1), n])


def _at_all(mine: np.ndarray, same: np.ndarray, which: np.ndarray, place: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of distinct pieces at all of ``mine``, which are in order of what piece they are."""
    lo, hi = np.searchsorted(same[mine], which), np.searchsorted(same[mine], which, side="right")
    of, step = spread(hi - lo)
    return mine[lo[of] + step], place[of], n[of]


def _late_places(width: int, flat: np.ndarray, size: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``_late_ranges`` of distinct pieces, each of one first anchor; ``doc`` is the least document that has each."""
    begin = np.cumsum(size) - size
    key = np.empty(len(size), np.uint64)  # of a piece's first window, and so of all
    for k in range(0, len(size), 1 << 14):
        part = slice(k, k + (1 << 14))
        s = Stretches(cut_out(flat, begin[part], np.full(len(size[part]), width)), width * np.arange(len(size[part]) + 1), width, spans_of(width)[0])
        key[part] = s.key
    several = np.flatnonzero(_held_by_several(key, doc))
    piece, place, n = _narrowed(width, cut_out(flat, begin[several], size[several]), size[several], doc[several], spans_of(width)[1:])
    return several[piece], place, n


def _shard(width: int):
    """A bucket's pieces to (doc_id, tkey, starts): ranges of places where late windows begin; the first in the upper half, their number in the lower."""

    def work(rows: pa.Table) -> pa.Table:
        x = unpack(rows, PIECES)
        flat = np.frombuffer(b"".join(unpacked(d) for d in rows.column("data").to_pylist()), np.uint8)
        x = {"doc": _docs(x), "size": x["size"].astype(np.int64), "tkey": x["tkey"], "pos": x["pos"].astype(np.int64), "n": x["n"].astype(np.int64)}
        over = x["n"] > 0
        late = [{c: x[c][over] for c in ("doc", "tkey", "pos", "n")}]
        if not over.all():
            asks = {c: v[~over] for c, v in x.items()}
            sent = asks["size"] > 0
            same = distinct(flat, asks["size"][sent])
            piece = same[np.cumsum(sent) - 1]
            _, one = np.unique(same, return_index=True)
            size = asks["size"][sent][one]
            begin = (np.cumsum(asks["size"][sent]) - asks["size"][sent])[one]
            doc = np.full(len(one), np.iinfo(np.int64).max)
            np.minimum.at(doc, piece, asks["doc"])
            after = asks["doc"] > doc[piece]
            late.append({c: asks[c][after] for c in ("doc", "tkey", "pos")} | {"n": size[piece[after]] - (width - 1)})
            which, place, windows = _late_places(width, cut_out(flat, begin, size), size, doc)
            # each late range at all places of the least document's piece
            mine = np.flatnonzero(~after)
            at, place, windows = _at_all(mine[np.argsort(piece[mine], kind="stable")], piece, which, place, windows)
            late.append({"doc": asks["doc"][at], "tkey": asks["tkey"][at], "pos": asks["pos"][at] + place, "n": windows})
        out = _merged({c: np.concatenate([p[c] for p in late]) for c in ("doc", "tkey", "pos", "n")})
        pa.default_memory_pool().release_unused()
        return grouped([out["doc"], out["tkey"]], out["pos"].astype(np.uint64) << np.uint64(32) | out["n"].astype(np.uint64), ["doc_id", "tkey", "starts"])

    return work


def late_windows(docs: DataFrame, dealt: DataFrame, scratch: Scratch, width: int = WIDTH) -> DataFrame:
    """(doc_id, late array<struct<tkey, starts>>) of documents with windows that an earlier one has.

    ``docs`` has doc_id and text, ``dealt`` has doc_id, tkey and the packed text, and both have no null ids.
    """
    spark = docs.sparkSession
    sent = docs.select("doc_id", "text").mapInArrow(_send_anchors(128, width), schema_of(ANCHORS))
    found = scratch.keep(exchange(sent, ANCHORS, _shared_anchors, "doc_id long, keys binary, n long"))
    scratch.free()  # what the anchors were dealt with
    asked = found.where("doc_id IS NOT NULL")
    total = asked.agg(F.sum("n")).first()[0] or 0
    hot = found.where("doc_id IS NULL").where(F.col("n") >= max(HOT, int(total * HOT_SHARE))).select("keys").toArrow()
    hot = np.unique(np.frombuffer(b"".join(hot.column(0).to_pylist()), np.uint64))  # fewer than one in HOT_SHARE
    shared = asked.groupBy("doc_id").agg(F.collect_list("keys").alias("keys"))
    buckets = buckets_for(total, IN_SHARD)
    sent = dealt.join(shared, "doc_id").mapInArrow(_send_pieces(buckets, width, spark.sparkContext.broadcast(hot)), schema_of(PIECES) + ", data binary")
    late = sent.groupBy("bucket").applyInArrow(_shard(width), "doc_id long, tkey long, starts binary")
    return late.groupBy("doc_id").agg(F.collect_list(F.struct("tkey", "starts")).alias("late"))


DIGESTS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
DEDUPED = f"{DIGESTS}, kept binary, spans array<struct<start:long,end:long>>"


def _strip(width: int, texts: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _in_parts(batches):
            tkeys = batch.column("tkey").to_pylist()
            lists = [[x["starts"] for x in some or () if x["tkey"] == k] for some, k in zip(batch.column("late").to_pylist(), tkeys, strict=True)]
            for run in runs(_texts(batch.column("packed"))):
                rows = []
                for r in range(run.rows):
                    data = run.data[run.offsets[r] : run.offsets[r + 1]]
                    found = lists[run.first + r]
                    if not found:
                        rows.append((len(data), 0, 0, hashlib.sha256(data).hexdigest(), None, []))
                        continue
                    ranges = np.frombuffer(b"".join(found), np.uint64)
                    lo = (ranges >> np.uint64(32)).astype(np.int64)
                    hi = lo + (ranges & np.uint64(0xFFFFFFFF)).astype(np.int64) + width - 1
                    cover = np.cumsum(np.bincount(lo, minlength=len(data) + 1) - np.bincount(hi, minlength=len(data) + 1))
                    gone = cover[:-1] > 0
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                    kept = data[~gone].tobytes()
                    rows.append((len(data), int(gone.sum()), len(edge) // 2, hashlib.sha256(kept).hexdigest(), kept, [{"start": a, "end": b} for a, b in edge.reshape(-1, 2).tolist()]))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
                told = 6 if texts else 4
                columns = [pa.array(c, t) for c, t in list(zip(zip(*rows, strict=True), kinds, strict=True))[:told]]
                names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(run.first, run.rows), *columns], ["doc_id", *names[:told]])

    return work


def rows_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, tkey); tkey tells apart rows that share an id. Columns that are so already stay as they are, so that Spark sees one exchange where the rows are used twice."""
    kinds = dict(docs.dtypes)
    did = F.col(id_col) if id_col == "doc_id" and kinds[id_col] == "bigint" else F.col(id_col).cast("long").alias("doc_id")
    text = F.col(text_col) if text_col == "text" and kinds[text_col] == "string" else F.col(text_col).cast("string").alias("text")
    return docs.select(did, text).select("doc_id", "text", F.xxhash64("text").alias("tkey"))


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, texts: bool = True) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with ``texts`` kept, spans.

    Bytes are those of the text in UTF-8. ``spans`` are the maximal removed
    runs (start, end); ``kept`` is what remains, null where nothing is removed;
    it may begin or end inside a character. Null and empty texts have no
    bytes, texts shorter than a window lose nothing. Rows of one id remove
    nothing from each other; rows without an id neither lose nor remove. Windows
    never span two rows. Other columns are not read, whatever their names.
    Texts are never cut, and any width from 1 is exact. An empty table has no
    rows.
    """
    if width < 1:
        raise ValueError(f"a window has a byte at least, not {width}")
    scratch = Scratch(docs.sparkSession, "suffixes")
    own = rows_of(docs, id_col, text_col)
    named, pack = own.where("doc_id IS NOT NULL"), "doc_id long, tkey long, packed binary"
    dealt = named.mapInArrow(_pack_texts, pack).where("doc_id IS NOT NULL")  # as a join asks, so that both joins read one exchange
    alone = F.count("*").over(Window.partitionBy("doc_id")) == 1
    dealt = dealt.withColumn("tkey", F.when(alone, F.lit(0)).otherwise(F.col("tkey")))  # no key where there is nothing to tell apart
    late = late_windows(named, dealt, scratch, width)
    # the documents are dealt by id once, for their anchors and for what is late
    both = dealt.join(late, "doc_id", "left").select("doc_id", "tkey", "packed", "late")
    rest = own.where("doc_id IS NULL").mapInArrow(_pack_texts, pack).withColumn("late", F.lit(None).cast(late.schema["late"].dataType))
    return scratch.result(both.union(rest).mapInArrow(_strip(width, texts), DEDUPED if texts else DIGESTS))


def op11_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"), texts=False)


QUERIES = {"op11_suffix_dedup": op11_suffix_dedup}
ORACLE: dict[str, str] = {}
