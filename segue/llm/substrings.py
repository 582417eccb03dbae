"""Removal of long word passages that an earlier document already has.

A window is ``width`` consecutive words. A word goes if a window over it also
starts in a document with a smaller id.

Recompression turns each text into symbols, level by level: runs of one symbol
get a name, then pairs of a left and a right symbol do; a symbol's side is one
bit of its name, another bit at each level. A name is the fingerprint of its
rule (the two names joined, or the name and length of a run), so it is the same
in all documents and tasks. With each symbol goes the span of words on which
its being there depends: a pair depends on its two parts alone, an unpaired
symbol on one neighbour, an unrepeated one beside runs on both. Whatever
lies inside a window with its whole span is there wherever the window stands.

A first Spark round asks of two kinds of symbols which documents have them.
Long ones, of ``width`` words and more: where a smaller document has one, all
windows inside it are repeats, proven by the symbol alone. And each window's
anchor, the longest symbol of the highest level whose span lies inside the
window: equal windows have equal anchors, words being the lowest level, and
most texts' anchors occur in them alone. In a second round the windows that are
still open and whose anchor two documents share are compared, by 96 bits of
all their words; the least document of each is kept. Both rounds combine in
the task first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, free_names, table
from ._exchange import Outbox, exchange, first_of, grouped, last_of, schema_of
from ._text import BYTE_CODE, Run, gather, mix64, runs, span_hashes, spread, window_hashes

WIDTH = 50

#: Levels before which runs are named; of all others only pairs are.
RUN_LEVELS = (0, 4, 8, 12)

#: Most levels; a level leaves three quarters of the symbols.
LEVELS = 40

SYMBOL = {"key": "u8", "more": "u4", "doc": "i8", "done": "u1"}
WINDOW = {"hash": "u8", "more": "u4", "doc": "i8", "tkey": "i8", "pos": "u4", "n": "u4"}

_SECOND = 0x8CB92BA72F3D8DD7
_PAIR, _RUN = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD1342543DE82EF95)


class Symbols:
    """The symbols of one level over the words of a run of texts.

    ``at`` is each symbol's first word, ``head`` whether it begins a text;
    ``lo`` and ``hi`` bound the words on which it depends. What depends on a
    text's end has a bound outside the text, which no window reaches. Levels
    above the anchors' need no bounds and have none.
    """

    def __init__(self, name, at, head, lo, hi, n_words):
        self.name, self.at, self.head, self.lo, self.hi, self.n_words = name, at, head, lo, hi, n_words

    @classmethod
    def of_words(cls, codes: np.ndarray, row_starts: np.ndarray) -> Symbols:
        n = len(codes)
        head = np.zeros(n + 1, bool)
        head[row_starts] = True
        at = np.arange(n)
        return cls(codes, at, head[:n], at, at + 1, n)

    def ends(self) -> np.ndarray:
        return np.append(self.at[1:], self.n_words)

    def _before(self) -> np.ndarray:
        """Where the neighbour before begins to matter."""
        out = np.empty_like(self.lo)
        out[1:] = self.lo[:-1]
        out[:1] = -1
        return np.where(self.head, self.at - 1, out)

    def _after(self) -> np.ndarray:
        out = np.empty_like(self.hi)
        out[:-1] = np.where(self.head[1:], self.at[1:] + 1, self.hi[1:])
        out[-1:] = self.n_words + 1
        return out

    def runs_named(self) -> tuple[Symbols, np.ndarray]:
        """Symbols after runs have a name each, and which are new."""
        same = np.zeros(len(self.name), bool)
        same[1:] = (self.name[1:] == self.name[:-1]) & ~self.head[1:]
        first = np.flatnonzero(~same)
        last = np.append(first[1:], len(same)) - 1
        times = last - first + 1
        many = times > 1
        name = self.name[first]
        name[many] = mix64(name[many] * _RUN + times[many].astype(np.uint64))
        lo, hi = (None, None) if self.lo is None else (self._before()[first], self._after()[last])
        return Symbols(name, self.at[first], self.head[first], lo, hi, self.n_words), many

    def pairs_named(self, level: int) -> tuple[Symbols, np.ndarray]:
        """Symbols after left ones have joined the right ones behind them, and which are new."""
        right = (self.name >> np.uint64(level + 8) & np.uint64(1)).astype(bool)
        joins = np.zeros(len(right), bool)
        joins[1:] = ~right[:-1] & right[1:] & ~self.head[1:]
        second = np.flatnonzero(joins)
        name = self.name.copy()
        name[second - 1] = mix64(self.name[second - 1] * _PAIR + self.name[second])
        new = np.zeros(len(right), bool)
        new[second - 1] = True
        keep = ~joins
        lo, hi = (None, None) if self.lo is None else (np.where(right, self._before(), self.lo)[keep], np.where(right, self.hi, self._after())[keep])
        return Symbols(name[keep], self.at[keep], self.head[keep], lo, hi, self.n_words), new[keep]


def levels_for(width: int) -> int:
    """The anchors' highest level: its symbols are about a seventh of a window long."""
    return int(max(0, round(np.log(width / 7) / np.log(4 / 3)))) if width > 7 else 0


def parse(codes: np.ndarray, row_starts: np.ndarray, width: int) -> tuple[list[Symbols], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Symbols of the levels that anchors come from, highest first; and the
    long symbols: name, first word, end."""
    now = Symbols.of_words(codes, row_starts)
    top = levels_for(width)
    kept, long = [now], []
    for level in range(LEVELS):
        steps = [now.runs_named] if level in RUN_LEVELS else []
        for step in [*steps, None]:
            now, new = step() if step else now.pairs_named(level)
            size = now.ends() - now.at
            at = np.flatnonzero(new & (size >= width))
            if len(at):
                long.append((now.name[at], now.at[at], now.at[at] + size[at]))
        if level + 1 in {top, top - 3, top - 5}:
            kept.append(now)
        if level + 1 >= top:
            now = Symbols(now.name, now.at, now.head, None, None, now.n_words)
            if now.head.all():
                break
    none = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return kept[::-1], tuple(np.concatenate(c) for c in zip(none, *long, strict=True))


def _least_of_ranges(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The least of x[lo:hi] for each non-empty range."""
    size = hi - lo
    out = np.empty(len(lo), x.dtype)
    table_, span = x, 1
    most = int(size.max(initial=1))
    while True:
        some = (size >= span) & (size < 2 * span)
        out[some] = np.minimum(table_[lo[some]], table_[hi[some] - span])
        if 2 * span > most:
            return out
        table_ = np.minimum(table_[: len(table_) - span], table_[span:])
        span *= 2


def anchors(levels: list[Symbols], at: np.ndarray, width: int) -> np.ndarray:
    """Each window's anchor, an even number, for windows that begin at these words (in order).

    The spans' bounds never fall along a level, so the symbols whose span lies
    in a window are neighbours.
    """
    out = np.empty(len(at), np.uint64)
    todo = np.arange(len(at))
    for symbols in levels:
        some = at[todo]
        lo, hi = np.searchsorted(symbols.lo, some), np.searchsorted(symbols.hi, some + width, side="right")
        has = hi > lo
        size = np.minimum(symbols.ends() - symbols.at, 63).astype(np.uint64)
        key = (np.uint64(63) - size) << np.uint64(58) | symbols.name >> np.uint64(6)
        out[todo[has]] = _least_of_ranges(key, lo[has], hi[has])
        todo = todo[~has]
        if not len(todo):
            break
    return out & ~np.uint64(1)


class Windows:
    """Words, windows and symbols of a run of texts."""

    def __init__(self, run: Run, width: int = WIDTH):
        self.run, self.width = run, width
        self.starts, self.ends, self.first = run.words()
        n = len(self.starts)
        self.codes = span_hashes(BYTE_CODE[run.data], self.starts, self.ends) if n else np.empty(0, np.uint64)
        words = np.diff(self.first)
        self.row, self.pos = spread(np.maximum(words - width + 1, 0))
        self.at = self.first[self.row] + self.pos
        if not len(self.at):
            return
        levels, (name, self.long_from, self.long_end) = parse(self.codes, self.first[:-1][words > 0], width)
        self.anchor = anchors(levels, self.at, width)
        self.long_key = name | np.uint64(1)
        self.long_row = np.searchsorted(self.first, self.long_from, side="right") - 1

    def long_more(self) -> np.ndarray:
        return (span_hashes(self.codes, self.long_from, self.long_end, base=_SECOND) >> np.uint64(32)).astype(np.uint32)

    def hashes(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """96 bits of the words of the windows at these places."""
        more = window_hashes(self.codes, self.width, base=_SECOND)[self.at[which]] >> np.uint64(32)
        return window_hashes(self.codes, self.width)[self.at[which]], more.astype(np.uint32)


def _combine_symbols(x: dict) -> tuple[dict, np.ndarray]:
    """One entry per symbol and document. An anchor that two documents of the
    task have is known to be shared: its holders are marked done, and it goes
    on with two of them. A long symbol's holders are done but for the least."""
    order = np.lexsort([x["doc"], x["more"], x["key"]])
    key, more, doc = (x[k][order] for k in ("key", "more", "doc"))
    new = first_of(key, more, doc) == np.arange(len(key))
    key, more, doc = key[new], more[new], doc[new]
    first, last = first_of(key, more), last_of(key, more)
    long = key & np.uint64(1) == 1
    here = np.arange(len(key))
    shared = ~long & (first != last)
    edge = shared & ((first == here) | (last == here))
    done = np.where(long, here != first, shared).astype(np.uint8)
    fields = {
        "key": np.concatenate([key, key[edge]]),
        "more": np.concatenate([more, more[edge]]),
        "doc": np.concatenate([doc, doc[edge]]),
        "done": np.concatenate([done, np.full(int(edge.sum()), 2, np.uint8)]),
    }
    spots = mix64(fields["key"])
    over = fields["done"] == 1  # those only pass through; deal them out evenly
    spots[over] = mix64(fields["doc"][over].astype(np.uint64))
    return fields, spots


def _shared_symbols(x: dict) -> pa.Table:
    """(doc_id, keys): the shared anchors, and the long symbols that a smaller
    document has, that this bucket knows of."""
    asked = x["done"] != 1
    key, more, doc, done = (x[k][asked] for k in ("key", "more", "doc", "done"))
    order = np.lexsort([doc, more, key])
    key, more, doc, done = key[order], more[order], doc[order], done[order]
    least, most = doc[first_of(key, more)], doc[last_of(key, more)]
    found = (done == 0) & (least != np.where(key & np.uint64(1) == 1, doc, most))
    docs = np.concatenate([x["doc"][~asked], doc[found]])
    keys = np.concatenate([x["key"][~asked], key[found]])
    return grouped([docs], keys, ["doc_id", "keys"])


def _send_symbols(buckets: int, width: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        box = Outbox(SYMBOL, buckets, _combine_symbols)
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for run in runs(batch.column("text")):
                w = Windows(run, width)
                if len(w.at):
                    turn = np.ones(len(w.at), bool)  # neighbours mostly have the same anchor
                    turn[1:] = (w.anchor[1:] != w.anchor[:-1]) | (w.row[1:] != w.row[:-1])
                    key, row = np.concatenate([w.anchor[turn], w.long_key]), np.concatenate([w.row[turn], w.long_row])
                    more = np.concatenate([np.zeros(int(turn.sum()), np.uint32), w.long_more()])
                    box.add(key=key, more=more, doc=ids[run.first + row], done=np.zeros(len(key), np.uint8))
                yield from box.full()
        yield from box.close()

    return work


def _ranges(x: dict) -> dict:
    """Late windows with their neighbours as one entry: the first of them, and how many."""
    order = np.lexsort([x["pos"], x["tkey"], x["doc"]])
    doc, tkey, pos = x["doc"][order], x["tkey"][order], x["pos"][order]
    new = np.ones(len(pos), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (tkey[1:] != tkey[:-1]) | (pos[1:].astype(np.int64) - pos[:-1] > 1)
    at = np.flatnonzero(new)
    last = np.append(at, len(pos))[1:] - 1
    zero = np.zeros(len(at), np.uint64)
    return {"hash": zero, "more": zero.astype(np.uint32), "doc": doc[at], "tkey": tkey[at], "pos": pos[at], "n": (pos[last] - pos[at] + 1).astype(np.uint32)}


def _judged(x: dict) -> tuple[dict, dict]:
    """Windows of the least document that has them, and the late ones in ranges with those known before."""
    asked = np.flatnonzero(x["n"] == 0)
    order = asked[np.lexsort([x["doc"][asked], x["more"][asked], x["hash"][asked]])]
    asks = {k: v[order] for k, v in x.items()}
    late = asks["doc"] != asks["doc"][first_of(asks["hash"], asks["more"])]
    more = _ranges({k: v[late] for k, v in asks.items()})
    known = x["n"] > 0
    return {k: v[~late] for k, v in asks.items()}, {k: np.concatenate([x[k][known], more[k]]) for k in x}


def _combine_windows(x: dict) -> tuple[dict, np.ndarray]:
    """Windows that an earlier document of the task has are done, and go to the
    document's bucket in ranges; of the others, the least document's go on."""
    asks, late = _judged(x)
    spots = np.concatenate([mix64(asks["hash"]), mix64(late["doc"].astype(np.uint64))])
    return {k: np.concatenate([asks[k], late[k]]) for k in x}, spots


def _late_windows(x: dict) -> pa.Table:
    """(doc_id, tkey, starts): windows that an earlier document has; each range's first in the upper half, its length in the lower."""
    _, late = _judged(x)
    return grouped([late["doc"], late["tkey"]], late["pos"].astype(np.uint64) << np.uint64(32) | late["n"], ["doc_id", "tkey", "starts"])


def _send_windows(buckets: int, width: int):
    salt = np.uint64(0x9E3779B97F4A7C15)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        box = Outbox(WINDOW, buckets, _combine_windows)
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            tkeys = batch.column("tkey").to_numpy(zero_copy_only=False)
            lists = batch.column("keys").to_pylist()
            for run in runs(batch.column("text")):
                w = Windows(run, width)
                if len(w.at):
                    known = [np.frombuffer(b"".join(lists[run.first + r]), np.uint64) for r in range(run.rows)]
                    rows = np.repeat(np.arange(run.rows), [len(k) for k in known])
                    shared = np.unique(np.concatenate(known) ^ mix64(rows.astype(np.uint64) * salt))

                    def among(key: np.ndarray, row: np.ndarray, shared=shared) -> np.ndarray:
                        asked = key ^ mix64(row.astype(np.uint64) * salt)
                        return shared[np.minimum(np.searchsorted(shared, asked), len(shared) - 1)] == asked

                    found = among(w.long_key, w.long_row)
                    n = len(w.codes) + 1
                    inside = np.cumsum(np.bincount(w.long_from[found], minlength=n) - np.bincount(w.long_end[found] - width + 1, minlength=n))[w.at] > 0
                    open_ = np.flatnonzero(~inside)
                    asked = open_[among(w.anchor[open_], w.row[open_])]
                    hashes, more = w.hashes(asked)
                    at, zero = run.first + w.row[asked], np.zeros(len(asked), np.uint32)
                    box.add(hash=hashes, more=more, doc=ids[at], tkey=tkeys[at], pos=w.pos[asked].astype(np.uint32), n=zero)
                    at = run.first + w.row[inside]
                    box.add(**_ranges({"doc": ids[at], "tkey": tkeys[at], "pos": w.pos[inside].astype(np.uint32)}))
                yield from box.full()
        yield from box.close()

    return work

def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, tkey): tkey tells apart rows that share an id."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tkey"))


def late_windows(docs: DataFrame, scratch: Scratch, width: int = WIDTH) -> DataFrame:
    """(doc_id, tkey, starts array<binary>): ranges of word places where windows begin that an earlier document has.

    ``docs`` has doc_id, text and tkey. Only rows with such windows come out.
    """
    buckets = max(128, docs.rdd.getNumPartitions())
    docs = docs.where("doc_id IS NOT NULL")
    sent = docs.select("doc_id", "text").mapInArrow(_send_symbols(buckets, width), schema_of(SYMBOL))
    shared = exchange(sent, SYMBOL, _shared_symbols, "doc_id long, keys binary")
    shared = scratch.keep(shared.groupBy("doc_id").agg(F.collect_list("keys").alias("keys")))
    sent = docs.join(shared, "doc_id").mapInArrow(_send_windows(buckets, width), schema_of(WINDOW))
    late = exchange(sent, WINDOW, _late_windows, "doc_id long, tkey long, starts binary")
    return scratch.keep(late.groupBy("doc_id", "tkey").agg(F.collect_list("starts").alias("starts")))


def kept_words(run: Run, late: list[list[bytes] | None], width: int) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray]:
    """Per row: words, words removed; and the kept words joined by blanks, with offsets."""
    starts, ends, first = run.words()
    n = len(starts)
    cover = np.zeros(n + 1, np.int64)
    for r, found in enumerate(late):
        if found:
            ranges = np.frombuffer(b"".join(found), np.uint64)
            at = first[r] + (ranges >> np.uint64(32)).astype(np.int64)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + (ranges & np.uint64(0xFFFFFFFF)).astype(np.int64) + width - 1, -1)
    keep = np.cumsum(cover)[:n] == 0
    upto = np.concatenate([[0], np.cumsum(keep)])
    size = (ends - starts)[keep] + 1
    flat = gather(np.append(run.data, np.uint8(32)), starts[keep], size)
    ends_at = np.concatenate([[0], np.cumsum(size)])
    flat[ends_at[1:] - 1] = 32
    row_end = ends_at[upto[first]]
    words = np.diff(first)
    return words, words - np.diff(upto[first]), flat.tobytes(), row_end


def _strip(width: int):
    """Rows with ``text`` and ``starts`` to rows with n_words, n_removed and the kept text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("starts").to_pylist()
            for run in runs(batch.column("text")):
                words, removed, flat, ends = kept_words(run, lists[run.first : run.first + run.rows], width)
                texts = [flat[a : b - 1] if b > a else b"" for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                rows = batch.slice(run.first, run.rows)
                shas = [hashlib.sha256(x).hexdigest() for x in texts]
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), rows.column("tkey"), pa.array(words.astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array(shas), pa.array([x.decode() if gone else None for x, gone in zip(texts, removed.tolist(), strict=True)], pa.string())],
                    ["doc_id", "tkey", "n_words", "n_removed", "kept_sha256", "kept_text"],
                )

    return work


STRIPPED = "doc_id long, tkey long, n_words long, n_removed long, kept_sha256 string, kept_text string"


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256, kept_text.

    kept_text is the kept words joined by blanks where words were removed, null
    where none were. Null and empty texts have no words. Texts shorter than a
    window lose nothing, and rows of one id remove nothing from each other;
    rows without an id neither lose nor remove. Windows never span two rows.
    Other columns are not read. Texts are never cut. Any width from 1 is exact.
    """
    if width < 1:
        raise ValueError(f"a window has a word at least, not {width}")
    scratch = Scratch(docs.sparkSession, "substrings")
    own = keyed(docs, id_col, text_col)
    late = late_windows(own, scratch, width)
    out = own.join(late, ["doc_id", "tkey"], "left").mapInArrow(_strip(width), STRIPPED)
    return scratch.result(out.drop("tkey"))


def stripped(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """The documents with their text replaced by what is kept; rows that lose
    every word go, rows that lose none keep their text as it is."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "substrings")
    late = scratch.result(late_windows(keyed(docs, id_col, text_col), scratch, width))
    did, key, starts = free_names(docs.columns, "late_id", "late_key", "late_starts")
    late = late.select(F.col("doc_id").alias(did), F.col("tkey").alias(key), F.col("starts").alias(starts))
    text = F.col(text_col).cast("string")
    both = docs.join(late, (F.col(id_col).cast("long") == F.col(did)) & (F.xxhash64(text) == F.col(key)), "left").drop(did, key)
    schema = docs.schema
    spot = docs.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(docs_columns)).to_pylist()
            for run in runs(batch.column(spot)):
                rows = batch.slice(run.first, run.rows)
                part = lists[run.first : run.first + run.rows]
                keep = np.ones(run.rows, bool)
                if any(part):
                    _, removed, flat, ends = kept_words(run, part, width)
                    old = rows.column(spot)
                    texts = [(flat[a : b - 1].decode() if b > a else "") if gone else old[r].as_py() for r, (a, b, gone) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), removed.tolist(), strict=True))]
                    keep = np.array([not (gone and not x) for x, gone in zip(texts, removed.tolist(), strict=True)], bool)
                    columns = [pa.array(texts, pa.string()) if i == spot else rows.column(i) for i in range(len(docs_columns))]
                else:
                    columns = [rows.column(i) for i in range(len(docs_columns))]
                yield pa.RecordBatch.from_arrays(columns, docs_columns).filter(pa.array(keep))

    docs_columns = docs.columns
    return both.mapInArrow(work, schema)


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).drop("kept_text")


QUERIES = {"op9_substring_dedup": op9_substring_dedup}
ORACLE: dict[str, str] = {}
