"""Byte-level BPE encoding and decoding over a rank file.

Pre-tokenisation uses no regular expression. Code points become class codes
(letter, number, white space, other) through one table. Where a pre-token
begins depends on the class pair at a place, on the apostrophe endings, and on
where the white-space run around it begins and ends; the run ends come from
associative scans (running maxima and minima over transition places). The byte
slices are merged once each: a cache holds the ids of slices seen before, and
new slices are merged together, one pair of each slice at a time, by rank.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import ids_and_text, table
from ._text import BYTE_CODE, Run, gather, runs, span_hashes

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0

#: Fixed: code points with the White_Space property.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

#: Fixed: the endings that follow an apostrophe as a pre-token of their own.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")

#: Slices longer than this are merged one by one, with a heap.
LONG_SLICE = 64

#: So many bytes of slices' ids are cached in a worker before the cache is emptied.
CACHE_SLICES = 400_000

#: The table of pairs that merge has 2 to this many slots.
SLOT_BITS = 19

_classes: np.ndarray | None = None


def class_table() -> np.ndarray:
    """The class of every code point."""
    global _classes
    if _classes is None:
        kinds = {"L": LETTER, "N": NUMBER}
        _classes = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
        _classes[WHITE_SPACE] = SPACE
    return _classes


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes and the byte where each begins."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    cp = data[at].astype(np.int32)
    if len(at) == len(data):
        return cp, at
    padded = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int32)
    for lead, mask, extra in ((0xC0, 0x1F, 1), (0xE0, 0x0F, 2), (0xF0, 0x07, 3)):
        top = 0x100 if extra == 3 else lead + (0x20 >> (extra - 1))
        which = np.flatnonzero((cp >= lead) & (cp < top) & (data[at] >= lead))
        value = padded[at[which]] & mask
        for k in range(1, extra + 1):
            value = (value << 6) | (padded[at[which] + k] & 0x3F)
        cp[which] = -value - 1
    return np.where(cp < 0, -cp - 1, cp), at


def pretoken_starts(run: Run) -> np.ndarray:
    """The byte places where pre-tokens begin, over all rows of a run."""
    if not len(run.data):
        return np.empty(0, np.int64)
    cp, at = code_points(run.data)
    n = len(cp)
    kind = class_table()[cp]
    white = kind == SPACE
    first = np.zeros(n + 1, bool)
    first[np.searchsorted(at, run.offsets)] = True  # a row's first code point, and the end
    edge = np.empty(n, bool)  # the class changes here
    edge[0] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:])
    edge |= first[:n]
    begins = edge.copy()
    # a blank before other text goes with it
    blank = cp == 0x20
    after_blank = np.zeros(n, bool)
    after_blank[1:] = blank[:-1]
    after_blank &= ~first[:n] & ~white
    begins[after_blank] = False
    # the last of a white-space run begins anew, unless the row ends there
    closes = np.zeros(n, bool)
    closes[:-1] = white[:-1] & ~white[1:]
    closes &= ~first[1:]
    begins |= closes
    # apostrophe endings
    quotes = np.flatnonzero((cp == 0x27) & edge & ~after_blank)
    if len(quotes):
        row_end = np.flatnonzero(first)[np.searchsorted(np.flatnonzero(first), quotes, side="right")]
        padded = np.concatenate([cp, np.zeros(3, cp.dtype)])
        open_ = np.ones(len(quotes), bool)
        for ending in sorted(ENDINGS, key=len, reverse=True):
            hit = open_ & (quotes + len(ending) < row_end)
            for k, c in enumerate(ending, 1):
                hit &= padded[quotes + k] == ord(c)
            inside, after = quotes[hit] + 1, quotes[hit] + 1 + len(ending)
            begins[inside] = False
            after = after[after < n]
            begins[after[kind[after] == LETTER]] = True
            open_ &= ~hit
    return at[begins]


class Vocabulary:
    """Ranks, their bytes, and which pairs of ids merge into which id."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.size = max(self.ranks.values()) + 1
        self.tokens = [b""] * self.size
        for piece, rank in self.ranks.items():
            self.tokens[rank] = piece
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        lengths = np.array([len(x) for x in self.tokens], np.int64)
        self.token_len, self.token_at = lengths, np.cumsum(lengths) - lengths
        self.token_bytes = np.frombuffer(b"".join(self.tokens), np.uint8)
        pairs = {}
        for piece, rank in self.ranks.items():
            for cut in range(1, len(piece)):
                a, b = self.ranks.get(piece[:cut]), self.ranks.get(piece[cut:])
                if a is not None and b is not None:
                    pairs[a * self.size + b] = rank
        self.pairs = pairs
        keys, rank = np.fromiter(pairs, np.int64, len(pairs)), np.fromiter(pairs.values(), np.int64, len(pairs))
        slot = self.slot_of(keys)
        order = np.argsort(slot, kind="stable")
        self.pair_keys, self.pair_rank = keys[order], rank[order]
        self.slot_first = np.searchsorted(slot[order], np.arange((1 << SLOT_BITS) + 1)).astype(np.int32)
        self.none = np.int64(1 << 40)
        self.byte_pairs = self.rank_of(np.repeat(self.byte_ids, 256), np.tile(self.byte_ids, 256))

    @staticmethod
    def slot_of(keys: np.ndarray) -> np.ndarray:
        """The slot of each pair's key, in a table of so many pairs in a row for each slot."""
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank that each pair merges into; ``none`` if it doesn't."""
        keys = left * self.size + right
        slot = self.slot_of(keys)
        at, to = self.slot_first[slot], self.slot_first[slot + 1]
        out = np.full(len(keys), self.none)
        left_over = np.flatnonzero(at < to)
        keys, at, to = keys[left_over], at[left_over], to[left_over]
        while len(left_over):
            hit = self.pair_keys[at] == keys
            out[left_over[hit]] = self.pair_rank[at[hit]]
            at += 1
            more = ~hit & (at < to)
            left_over, keys, at, to = left_over[more], keys[more], at[more], to[more]
        return out

    def merge_one(self, piece: bytes) -> list[int]:
        """A long slice: a heap of pairs over a linked list."""
        import heapq

        ids = [int(self.byte_ids[b]) for b in piece]
        n = len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] >= 0:
                rank = self.pairs.get(ids[i] * self.size + ids[after[i]])
                if rank is not None:
                    heapq.heappush(heap, (rank, i, ids[i], ids[after[i]]))

        for i in range(n):
            offer(i)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = rank, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [x for x in ids if x >= 0]

    def merge_many(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all slices, one after the other, and how many each has."""
        whole = np.fromiter(map(self.ranks.get, pieces, repeat(-1)), np.int64, len(pieces))
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        out: dict[int, list[int]] = {}
        for k in np.flatnonzero((whole < 0) & (lengths > LONG_SLICE)).tolist():
            out[k] = self.merge_one(pieces[k])
        todo = np.flatnonzero((whole < 0) & (lengths <= LONG_SLICE))
        counts = np.where(whole >= 0, 1, 0)
        for k, ids in out.items():
            counts[k] = len(ids)
        done_owner, done_ids, done_at = [], [], []
        if len(todo):
            raw = np.frombuffer(b"".join([pieces[k] for k in todo.tolist()]), np.uint8).astype(np.int64)
            ids = self.byte_ids[raw]
            owner = np.repeat(np.arange(len(todo)), lengths[todo])
            # a pair's rank stands at its left symbol
            rank = np.full(len(ids), self.none)
            same = np.flatnonzero(owner[1:] == owner[:-1])
            rank[same] = self.byte_pairs[256 * raw[same] + raw[same + 1]]
            while len(ids):
                heads = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
                best = np.minimum.reduceat(rank, heads)
                size = np.diff(np.concatenate([heads, [len(ids)]]))
                over = best == self.none
                if over.any():
                    keep = np.repeat(~over, size)
                    done_owner.append(owner[~keep])
                    done_ids.append(ids[~keep])
                    ids, owner, rank = ids[keep], owner[keep], rank[keep]
                    best, size = best[~over], size[~over]
                    if not len(ids):
                        break
                    heads = np.cumsum(size) - size
                hits = np.flatnonzero(rank == np.repeat(best, size))
                hits = hits[np.concatenate([[True], owner[hits[1:]] != owner[hits[:-1]]])]  # the leftmost of each slice
                ids[hits] = best
                keep = np.ones(len(ids), bool)
                keep[hits + 1] = False
                ids, owner, rank = ids[keep], owner[keep], rank[keep]
                at = hits - np.arange(len(hits))  # one symbol of each earlier slice has gone
                rank[at] = self.none
                right = at[at + 1 < len(ids)]
                right = right[owner[right + 1] == owner[right]]
                rank[right] = self.rank_of(ids[right], ids[right + 1])
                left = at[at > 0]
                left = left[owner[left - 1] == owner[left]] - 1
                rank[left] = self.rank_of(ids[left], ids[left + 1])
        if done_owner:
            owner, ids = np.concatenate(done_owner), np.concatenate(done_ids)
            order = np.argsort(owner, kind="stable")
            owner, ids = todo[owner[order]], ids[order]
            counts[todo] = np.bincount(owner, minlength=len(pieces))[todo]
        else:
            owner = ids = np.empty(0, np.int64)
        first = np.cumsum(counts) - counts
        flat = np.empty(int(counts.sum()), np.int32)
        single = np.flatnonzero(whole >= 0)
        flat[first[single]] = whole[single]
        if len(owner):
            head = np.concatenate([[True], owner[1:] != owner[:-1]])
            place = np.arange(len(owner)) - np.maximum.accumulate(np.where(head, np.arange(len(owner)), 0))
            flat[first[owner] + place] = ids
        for k, x in out.items():
            flat[first[k] : first[k] + len(x)] = x
        return flat, counts

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of some ids."""
        return gather(self.token_bytes, self.token_at[ids], self.token_len[ids]).tobytes()


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary at a path, read once in each worker."""
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


class SliceCache:
    """Ids of byte slices by the slices' hashes; emptied when full."""

    def __init__(self, vocab: Vocabulary, most: int = CACHE_SLICES):
        self.vocab, self.most = vocab, most
        self.clear()

    def clear(self) -> None:
        self.keys = np.empty(0, np.uint64)
        self.first = np.empty(0, np.int64)
        self.count = np.empty(0, np.int64)
        self.flat = np.empty(0, np.int32)

    def lookup(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For distinct hashes of slices: where their ids begin in ``flat``, and how many they are."""
        if len(self.keys) > self.most:
            self.clear()
        spot = np.searchsorted(self.keys, hashes)
        known = np.zeros(len(hashes), bool)
        if len(self.keys):
            known = self.keys[np.minimum(spot, len(self.keys) - 1)] == hashes
        new = np.flatnonzero(~known)
        if len(new):
            raw = data.tobytes()
            flat, count = self.vocab.merge_many([raw[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)])
            first = np.cumsum(count) - count + len(self.flat)
            self.flat = np.concatenate([self.flat, flat])
            at = spot[new]
            self.keys = np.insert(self.keys, at, hashes[new])
            self.first = np.insert(self.first, at, first)
            self.count = np.insert(self.count, at, count)
            spot = np.searchsorted(self.keys, hashes)
        return self.first[spot], self.count[spot]


def encode_run(run: Run, cache: SliceCache) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a run, and the index of each row's first id (rows + 1 long)."""
    starts = pretoken_starts(run)
    if not len(starts):
        return np.empty(0, np.int32), np.zeros(run.rows + 1, np.int64)
    ends = np.append(starts[1:], len(run.data))
    hashes = span_hashes(BYTE_CODE[run.data], starts, ends)
    distinct, one, which = np.unique(hashes, return_index=True, return_inverse=True)
    first, count = cache.lookup(distinct, run.data, starts[one], ends[one])
    ids = gather(cache.flat, first[which], count[which])
    upto = np.concatenate([[0], np.cumsum(count[which])])
    return ids, upto[np.searchsorted(starts, run.offsets)]


def encoder(path: str):
    def run_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = SliceCache(vocabulary(path))
        for batch in batches:
            for run in runs(batch.column("text")):
                ids, at = encode_run(run, cache)
                rows = batch.column("doc_id").slice(run.first, run.rows)
                yield pa.RecordBatch.from_arrays([rows, pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))], ["doc_id", "ids"])

    return run_batches


def decoder(path: str):
    def run_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            lists = batch.column("ids")
            for at in range(0, len(lists), 256):
                part = lists.slice(at, 256)
                ids = part.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                counts = pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                size = vocab.token_len[ids]
                upto = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts)])]
                data = gather(vocab.token_bytes, vocab.token_at[ids], size).tobytes()
                texts = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(upto.astype(np.int32).tobytes()), pa.py_buffer(data)])
                names = [x for x in batch.schema.names]
                columns = [texts if x == "ids" else batch.column(x).slice(at, 256) for x in names]
                yield pa.RecordBatch.from_arrays(columns, ["decoded" if x == "ids" else x for x in names])

    return run_batches


def encode(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, ids array<int>) for every row; null and empty texts have no ids.

    Rows are encoded each for itself, so repeated rows and ties come out as
    often as they came in; other columns are not read. Texts are never cut.
    """
    return ids_and_text(docs, id_col, text_col).mapInArrow(encoder(path), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id long, decoded binary) from (doc_id, ids); null ids decode to nothing."""
    return encoded.select("doc_id", "ids").mapInArrow(decoder(path), "doc_id long, decoded binary")


def round_trip(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded): every text's ids, and the bytes those ids decode to."""

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoding = decoder(path)
        for batch in encoder(path)(batches):
            for back, at in _with_starts(decoding, batch):
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(at, back.num_rows) for k in (0, 1)), back.column("decoded")], ["doc_id", "ids", "decoded"])

    return ids_and_text(docs, id_col, text_col).mapInArrow(both, "doc_id long, ids array<int>, decoded binary")


def _with_starts(decoding, batch: pa.RecordBatch):
    at = 0
    for back in decoding(iter([batch])):
        yield back, at
        at += back.num_rows


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op3_byte_bpe(spark, sf_dir: str) -> DataFrame:
    out = round_trip(table(spark, sf_dir, "documents"), default_path())
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES = {"op3_byte_bpe": op3_byte_bpe}
ORACLE: dict[str, str] = {}
