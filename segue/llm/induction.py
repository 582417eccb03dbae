"""Suffix arrays with common prefixes by induced sorting, in disk-backed queues.

A suffix is of type S if it is less than the next one, else of type L; an S
suffix behind an L is a mark. The substrings from mark to mark are named by
their order, the names are a shorter text, and its suffix array (the recursion)
is the order of the marks. One pass up the symbols then induces the L suffixes
from the marks, one pass down the S suffixes from the L.

A pass is a priority queue of tuples (symbol, place, common prefix). The queue
deals tuples to ranges of symbols; what it holds beyond ``HELD`` tuples goes to
files, a range at a time, and only the range in turn is in memory. Tuples of a
symbol arrive in their order, so a symbol's tuples are a first-in-first-out
list. They leave in batches of whole symbols that induce nothing into the batch
itself, and a batch is a few array operations. With each tuple goes its common
prefix with the tuple before it of the same symbol: one more than the least
common prefix between the two suffixes that induced them, carried from batch to
batch per symbol.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np

#: Tuples that a queue holds in memory, tuples of a range at most, and of a batch where a symbol has more.
HELD, RANGE, BATCH = 1 << 23, 1 << 16, 1 << 18

_FAR = np.iinfo(np.int32).max


def least_of_ranges(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The least of x[lo:hi] for each range; of an empty one, the greatest number there is."""
    out = np.full(len(lo), _FAR, x.dtype)
    size = hi - lo
    most = int(size.max(initial=0))
    span, table = 1, x
    while span <= most:
        some = np.flatnonzero((size >= span) & (size < 2 * span))
        out[some] = np.minimum(table[lo[some]], table[hi[some] - span])
        if 2 * span <= most:
            table = np.minimum(table[: len(table) - span], table[span:])
        span *= 2
    return out


class Queue:
    """Tuples by range of symbols, in order of arrival; a row is (symbol, place, common prefix)."""

    def __init__(self, cuts: np.ndarray, folder: str, held: int):
        self.cuts, self.folder, self.held = cuts, folder, held
        self.blocks: list[list[np.ndarray]] = [[] for _ in cuts]
        self.sizes = np.zeros(len(cuts), np.int64)
        self.files: list[str | None] = [None] * len(cuts)
        self.spilled = 0

    def push(self, rows: np.ndarray) -> None:
        """Rows in the order of symbols, each symbol's in order of arrival."""
        at = np.append(np.searchsorted(rows[:, 0], self.cuts), len(rows))
        for r in np.flatnonzero(at[1:] > at[:-1]).tolist():
            self.blocks[r].append(rows[at[r] : at[r + 1]])
        self.sizes += np.diff(at)
        if self.sizes.sum() > self.held:
            self._spill()

    def _spill(self) -> None:
        """The largest ranges go to their files until half of what may be held is left."""
        for r in np.argsort(-self.sizes, kind="stable").tolist():
            if self.sizes.sum() <= self.held // 2:
                break
            if self.files[r] is None:
                fd, self.files[r] = tempfile.mkstemp(dir=self.folder)
                os.close(fd)
            with open(self.files[r], "ab") as f:
                for block in self.blocks[r]:
                    np.ascontiguousarray(block).tofile(f)
            self.spilled += int(self.sizes[r])
            self.blocks[r], self.sizes[r] = [], 0

    def take(self, r: int) -> np.ndarray:
        """All rows of a range, by symbol and then in order of arrival."""
        parts = []
        if self.files[r] is not None:
            parts.append(np.fromfile(self.files[r], np.int32).reshape(-1, 3))
            os.unlink(self.files[r])
            self.files[r] = None
        rows = np.concatenate([*parts, *self.blocks[r]]) if parts or self.blocks[r] else np.empty((0, 3), np.int32)
        self.blocks[r], self.sizes[r] = [], 0
        return rows[np.argsort(rows[:, 0], kind="stable")]


class Carry:
    """For each symbol, the least common prefix since a tuple was last pushed to it."""

    def __init__(self, symbols: int):
        self.batch = np.full(symbols, -1, np.int64)
        self.rest = np.empty(symbols, np.int32)
        self.now = 0
        self.ids, self.least, self.top = np.empty(64, np.int64), np.empty(64, np.int32), 0  # least rises from batch to batch

    def since(self, symbols: np.ndarray) -> np.ndarray:
        last = self.batch[symbols]
        at = np.searchsorted(self.ids[: self.top], last, side="right")
        between = np.full(len(at), _FAR, np.int32)
        some = at < self.top
        between[some] = self.least[at[some]]
        return np.where(last < 0, -1, np.minimum(self.rest[symbols], between))

    def after(self, symbols: np.ndarray, rest: np.ndarray) -> None:
        self.batch[symbols], self.rest[symbols] = self.now, rest

    def end_of_batch(self, least: int) -> None:
        while self.top and self.least[self.top - 1] >= least:
            self.top -= 1
        if self.top == len(self.ids):
            self.ids, self.least = np.resize(self.ids, 2 * self.top), np.resize(self.least, 2 * self.top)
        self.ids[self.top], self.least[self.top] = self.now, least
        self.top += 1
        self.now += 1


class Batch:
    """Queue tuples and seeds of some whole symbols, in order, and what they induce.

    A tuple that the batch induces into itself stands behind the queue's tuples
    of its symbol and before the seeds, in the order of its inducers. Entries
    are tuples that another symbol induced. Where an entry's symbol is repeated
    before it, the whole run follows at once: a layer has what is so many
    places before its entries, in the entries' order.
    """

    def __init__(self, rows: np.ndarray, seed_sym: np.ndarray, seeds: np.ndarray, seed_lcp: np.ndarray):
        self.parts = rows, seed_sym, seeds, seed_lcp
        self.own = np.empty((0, 2), np.int32)  # (symbol, place) of those it induces into itself
        self._sort()

    def _sort(self) -> None:
        rows, seed_sym, seeds, seed_lcp = self.parts
        k, e = len(rows), len(self.own)
        sym = np.concatenate([rows[:, 0], self.own[:, 0], seed_sym])
        place = np.concatenate([rows[:, 1], self.own[:, 1], seeds])
        lcp = np.concatenate([rows[:, 2], np.zeros(e, np.int32), seed_lcp])
        kind = np.zeros(len(sym), np.int8)  # 0 queue, 1 own, 2 seed
        kind[k:] = 1
        kind[k + e :] = 2
        order = np.argsort(sym, kind="stable")
        self.sym, self.place, self.lcp, self.kind = sym[order], place[order], lcp[order], kind[order]

    @property
    def seed(self) -> np.ndarray:
        return self.kind == 2

    def find(self, text: np.ndarray, wanted: np.ndarray) -> None:
        """The suffixes that this batch's suffixes induce, by symbol and then in order."""
        to = self.place - 1
        makes = np.flatnonzero(wanted[to] & (to >= 0))
        to_sym = text[to[makes]]
        order = np.argsort(to_sym, kind="stable")
        self.makes, self.to_sym = makes[order], to_sym[order]
        self.to = to[self.makes]

    def close(self, text: np.ndarray, wanted: np.ndarray, back: np.ndarray, hi: int, rounds: int = 8) -> bool:
        """Takes in what the batch induces into itself; false if that does not end soon."""
        rows = self.parts[0]
        for _ in range(rounds):
            k = int(np.searchsorted(self.to_sym, hi))
            new = np.flatnonzero(self.to_sym[:k] != self.sym[self.makes[:k]])
            sym, place = np.concatenate([rows[:, 0], self.to_sym[new]]), np.concatenate([rows[:, 1], self.to[new]])
            order = np.argsort(sym, kind="stable")
            sym, place = sym[order], place[order]
            queued = order < len(rows)
            times = back[place] + 1
            entry = np.repeat(np.arange(len(sym)), times)
            layer = np.arange(len(entry)) - np.repeat(np.cumsum(times) - times, times)
            if len(entry) > len(sym):
                order = np.lexsort([entry, layer, sym[entry]])
                entry, layer = entry[order], layer[order]
            inside = (layer > 0) | ~queued[entry]
            own = np.stack([sym[entry], place[entry] - layer], axis=1)[inside]
            if np.array_equal(own, self.own):
                self.entry, self.layer, self.inside, self.head = entry, layer, inside, np.concatenate([[True], sym[1:] != sym[:-1]])
                return True
            self.own = own
            self._sort()
            self.find(text, wanted)
        self.own = self.own[:0]
        self._sort()
        self.find(text, wanted)
        return False

    def cut(self, hi: int, first: int) -> tuple[int, bool]:
        """Ends the batch before the first symbol that it induces, or, where the first symbol induces itself, before its seeds."""
        k = int(np.searchsorted(self.to_sym, hi))
        to_sym, by = self.to_sym[:k], self.sym[self.makes[:k]]
        same = to_sym == by
        cut, least = int(to_sym[~same].min(initial=hi)), int(by[same].min(initial=hi))
        one = least == first
        cut = min(cut, first + 1 if one else least)
        kept = int(((self.sym < cut) & ((self.kind != 2) | (not one))).sum())
        self.sym, self.place, self.lcp, self.kind = (x[:kept] for x in (self.sym, self.place, self.lcp, self.kind))
        some = self.makes < kept
        self.makes, self.to, self.to_sym = self.makes[some], self.to[some], self.to_sym[some]
        return cut, one

    def measure(self, before: tuple[int, bool, int], run: np.ndarray, carry: Carry, own_ends: int) -> tuple[int, bool, int]:
        """Common prefixes of all with the element before, and of what is induced with the one of its symbol before."""
        seed = self.seed
        past_sym, past_seed, past_place = (np.concatenate([[b], a[:-1]]) for a, b in zip((self.sym, seed, self.place), before, strict=True))
        turn = np.flatnonzero(seed & ~past_seed & (self.sym == past_sym))
        self.lcp[turn] = np.minimum(run[self.place[turn]], run[past_place[turn]])
        self.lcp[self.sym != past_sym] = 0
        self.shared = np.empty(0, np.int32)
        if len(self.makes):
            head = np.concatenate([[True], self.to_sym[1:] != self.to_sym[:-1]])
            heads = np.flatnonzero(head)
            from_ = np.where(head, 0, np.concatenate([[0], self.makes[:-1] + 1]))
            since = carry.since(self.to_sym[heads])
            while True:  # what is induced inside depends on what stands before it alone, so this ends
                shared = least_of_ranges(self.lcp, from_, self.makes + 1)
                shared[heads] = np.minimum(shared[heads], since)
                if not len(self.own) or not self._measure_own(shared + 1, run, past_sym):
                    break
            self.shared = shared
            lasts = np.append(heads[1:], len(self.makes)) - 1
            carry.after(self.to_sym[lasts], least_of_ranges(self.lcp, self.makes[lasts] + 1, np.full(len(lasts), len(self.lcp))))
        return int(self.sym[-1]), bool(seed[-1]), int(self.place[-1])

    def _measure_own(self, value: np.ndarray, run: np.ndarray, past_sym: np.ndarray) -> bool:
        """Sets the common prefixes of what the batch induces into itself; true if any was another before."""
        first = np.flatnonzero(self.layer == 0)  # entries, in order
        inner = np.flatnonzero(self.kind < 2)  # entries and layers, in order
        given = self.lcp[inner].copy()
        mine = np.where(self.inside, 0, given)
        mine[self.inside] = value[: len(self.own)]
        base = mine[first]
        more = np.flatnonzero(self.layer > 0)
        if len(more):
            before = more - 1
            same = (self.layer[before] == self.layer[more]) & (self.entry[before] < self.entry[more])
            same &= self._sym_of_entry(before) == self._sym_of_entry(more)
            at = more[same]
            mine[at] = self.layer[at] + least_of_ranges(base, self.entry[at - 1] + 1, self.entry[at] + 1)
            place = self.place[inner]
            at = more[~same]
            mine[at] = np.minimum(run[place[at]], run[place[at - 1]])
        mine[self.sym[inner] != past_sym[inner]] = 0
        self.lcp[inner] = mine
        return not np.array_equal(given, mine)

    def _sym_of_entry(self, at: np.ndarray) -> np.ndarray:
        return (np.cumsum(self.head) - 1)[self.entry[at]]

    def induced(self) -> np.ndarray:
        """(symbol, place, common prefix) of all that is induced."""
        return np.stack([self.to_sym, self.to, self.shared + 1], axis=1).astype(np.int32, copy=False)


def induce(text: np.ndarray, wanted: np.ndarray, run: np.ndarray, back: np.ndarray, seeds: np.ndarray, seed_lcp: np.ndarray, folder: str, held: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places, common prefixes, whether seeds) of the seeds and the wanted suffixes in order, by batches.

    ``seeds`` are in order, ``seed_lcp`` has the common prefix of each with the
    one before. A wanted suffix stands before the seeds of its symbol, and is
    induced by the one behind it. ``run`` says how often a symbol is there from
    a place on, ``back`` how often before.
    """
    n, symbols = len(text), int(text.max(initial=0)) + 1
    counts = np.bincount(text[wanted], minlength=symbols)
    fill = np.cumsum(counts) // min(RANGE, max(2048, n // 256))
    cuts = np.flatnonzero(np.concatenate([[True], fill[1:] != fill[:-1]]))
    queue, carry = Queue(cuts, folder, held), Carry(symbols)
    seed_sym = text[seeds]
    most = max(4096, n // 64)
    step = most  # about as much as batches hold when they are cut
    bounds = np.append(cuts, symbols)
    s_at, before = 0, (-1, False, 0)  # of the element before: symbol, seed, place
    for r in range(len(cuts)):
        main, m_at = queue.take(r), 0
        late = np.empty((0, 3), np.int32)
        end = int(bounds[r + 1])
        s_end = int(np.searchsorted(seed_sym, end))
        while m_at < len(main) or len(late) or s_at < s_end:
            first = min(int(x[0]) for x in (main[m_at : m_at + 1, 0], late[:1, 0], seed_sym[s_at : s_at + 1]) if len(x) and x[0] < end)
            whole = int(np.searchsorted(main[:, 0], first, side="right"))
            l_whole = int(np.searchsorted(late[:, 0], first, side="right"))
            runs = run[late[:l_whole, 1]]
            layered = bool((runs > 1).any())  # of a run: a layer at a time
            part = whole - m_at > BATCH or layered
            if part:
                hi, s_to = first + 1, s_at
                m_to, l_to = min(whole, m_at + BATCH), 0
                if m_to == m_at:
                    l_to = int((runs == runs[0]).argmin()) or l_whole
            else:
                hi = end
                if m_at + step < len(main):
                    hi = min(hi, max(int(main[m_at + step, 0]), first + 1))
                if s_at + step < s_end:
                    hi = min(hi, max(int(seed_sym[s_at + step]), first + 1))
                m_to, l_to, s_to = int(np.searchsorted(main[:, 0], hi)), int(np.searchsorted(late[:, 0], hi)), s_at + int(np.searchsorted(seed_sym[s_at:s_end], hi))
            rows = main[m_at:m_to]
            if l_to:
                rows = np.concatenate([rows, late[:l_to]])
                rows = rows[np.argsort(rows[:, 0], kind="stable")]
            batch = Batch(rows, seed_sym[s_at:s_to], seeds[s_at:s_to], seed_lcp[s_at:s_to])
            batch.find(text, wanted)
            own_ends = first if part else hi  # what is induced before that belongs to this batch
            if not part and not batch.close(text, wanted, back, hi):
                cut, one = batch.cut(hi, first)
                m_to, l_to = int(np.searchsorted(main[:, 0], cut)), int(np.searchsorted(late[:, 0], cut))
                s_to = s_at if one else s_at + int(np.searchsorted(seed_sym[s_at:s_to], cut))
                own_ends = first  # nothing that is induced now comes before what is left of the batch
            step = min(max(2 * len(batch.sym), 256), most)
            late, m_at, s_at = late[l_to:], m_to, s_to
            before = batch.measure(before, run, carry, own_ends)
            yield batch.place, batch.lcp, batch.seed
            new = batch.induced()
            new = new[int(np.searchsorted(new[:, 0], own_ends)) :]
            here = int(np.searchsorted(new[:, 0], end))
            if here:
                late = np.concatenate([late, new[:here]])
                late = late[np.argsort(late[:, 0], kind="stable")]
            if here < len(new):
                queue.push(new[here:])
            carry.end_of_batch(int(batch.lcp.min()))


def names(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The places of text[start:end] among their distinct values, none of which is another's beginning."""
    bits = max(1, int(text.max(initial=0) + 1).bit_length())
    width = 63 // bits
    rank = np.zeros(len(starts), np.int64)
    todo, at = np.arange(len(starts)), 0
    while len(todo):
        key = np.zeros(len(todo), np.int64)
        for j in range(at, at + width):
            spot = starts[todo] + j
            inside = spot < ends[todo]
            key <<= bits
            key[inside] |= text[spot[inside]].astype(np.int64) + 1
        order = np.argsort(key, kind="stable") if at == 0 else np.lexsort([key, rank[todo]])
        todo, key, group = todo[order], key[order], rank[todo[order]]
        same_group = np.concatenate([[False], group[1:] == group[:-1]])
        same = same_group & np.concatenate([[False], key[1:] == key[:-1]])
        spots = np.arange(len(todo))
        group_from = np.maximum.accumulate(np.where(same_group, 0, spots))
        own_from = np.maximum.accumulate(np.where(same, 0, spots))
        rank[todo] = group + own_from - group_from
        tied = same.copy()
        tied[:-1] |= same[1:]
        at += width
        todo = todo[tied & (starts[todo] + at < ends[todo])]
    used = np.zeros(len(starts), bool)
    used[rank] = True
    return (np.cumsum(used) - 1)[rank].astype(np.int32)


def suffix_array(text: np.ndarray, folder: str, held: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of a text in order, and the common prefix of each with the one before.

    The last symbol must be the least and occur once. Queues spill to files in
    ``folder``; the arrays that don't fit in memory are files there, too.
    """
    n, held = len(text), HELD if held is None else held
    if n >= 1 << 31:
        raise ValueError("a shard has fewer than 2**31 symbols")
    array = lambda size, kind: np.empty(size, kind) if size <= 2 * held else np.memmap(tempfile.TemporaryFile(dir=folder), kind, "w+", shape=(size,))  # noqa: E731, SIM115
    if n == 1:
        return np.zeros(1, np.int32), np.zeros(1, np.int32)
    spots = np.arange(n, dtype=np.int32)
    turn = np.full(n, n - 1, np.int32)
    turn[:-1] = np.where(text[1:] != text[:-1], spots[:-1], n - 1)
    turn = np.minimum.accumulate(turn[::-1])[::-1]
    rises = np.ones(n, bool)  # type S
    ahead = np.minimum(turn + 1, n - 1)
    rises[:-1] = text[turn[:-1]] < text[ahead[:-1]]
    run = array(n, np.int32)
    run[:] = turn - spots + 1
    back = array(n, np.int32)
    back[:1] = 0
    back[1:] = spots[1:] - np.maximum.accumulate(np.where(text[1:] != text[:-1], spots[1:], 0))
    del turn, ahead, spots
    marks = (np.flatnonzero(rises[1:] & ~rises[:-1]) + 1).astype(np.int32)
    both = 2 * text.astype(np.int32) + rises
    ends = np.append(marks[1:] + 1, n).astype(np.int32)
    short = names(both, marks, ends)
    if int(short.max(initial=0)) + 1 == len(short):
        order, lcp = np.argsort(short).astype(np.int32), np.zeros(len(short), np.int32)
    else:
        order, lcp = suffix_array(short, folder, held)
    del short
    # common prefixes of marks: of the names that two share, and on into those that differ
    seeds, seed_lcp = marks[order], np.zeros(len(order), np.int32)
    if len(order) > 1:
        a, b = order[:-1] + lcp[1:], order[1:] + lcp[1:]
        seed_lcp[1:] = marks[b] - marks[order[1:]]
        a, b, todo = marks[a], marks[b], np.arange(1, len(order))
        while len(todo):
            equal = both[a] == both[b]
            apart = np.flatnonzero(~equal)
            alike = apart[text[a[apart]] == text[b[apart]]]  # one symbol of two types: both runs, to the shorter's end
            seed_lcp[todo[alike]] += np.minimum(run[a[alike]], run[b[alike]])
            a, b, todo = a[equal] + 1, b[equal] + 1, todo[equal]
            seed_lcp[todo] += 1
    del both, order, lcp
    falls = ~rises
    down, down_lcp = array(n - int(rises.sum()), np.int32), array(n - int(rises.sum()), np.int32)
    at = 0
    for place, shared, seed in induce(text, falls, run, back, seeds, seed_lcp, folder, held):
        mine = ~seed
        k = int(mine.sum())
        down[at : at + k], down_lcp[at : at + k] = place[mine], shared[mine]
        at += k
    # L suffixes from the greatest: seeds of the S suffixes, symbols mirrored
    mirrored = int(text.max()) - text
    back_lcp = np.zeros(len(down), np.int32)
    back_lcp[1:] = down_lcp[1:][::-1]
    out, out_lcp = array(n, np.int32), array(n, np.int32)
    at = n
    rises[-1] = False
    held_lcp = 0
    for place, shared, _ in induce(mirrored, rises, run, back, down[::-1], back_lcp, folder, held):
        k = len(place)
        out[at - k : at] = place[::-1]
        out_lcp[at - k + 1 : at] = shared[1:][::-1]
        if at < n:
            out_lcp[at] = shared[0]
        at -= k
    out[0], out_lcp[0] = n - 1, held_lcp
    if n > 1:
        out_lcp[1] = 0
    return out, out_lcp
