"""Language-model scoring by causal self-attention on subword ids.

Tokens are lower-cased words and one end per text. Three parts score a token:

* Base: add-one unigram over all words of the training texts.
* Attention: each word is spelled in byte-level BPE subwords, the last of a
  word marked; one causal attention layer over the subwords before, trained in
  numpy, gates a fixed number of subword distributions. Their mixture is a
  proper distribution without a sum over the vocabulary at each place.
* Model: discounted unigram over all training words, with the mass that the
  discount frees, and a fixed share of the rest, given to the attention part.

The attention part starts from a few texts, then all training rows are learned
from: each task goes on from that start over its own rows, whole texts in
windows. Every subword counts for one distribution, drawn by its part in the
subword's probability, and the counts of all rows together make the
distributions (stochastic expectation maximisation). Every window of each row makes steps of
attention and gates, too, and the tasks' changes are averaged by use.

Texts are scored in overlapping windows: each block of ``BLOCK`` subwords
attends to itself and the block before, so every subword is scored once.
Word counts are exact over all training texts. The most frequent words' counts
(``HEAD`` at most) go to all tasks; the other words meet theirs in a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, table
from ._exchange import Outbox, exchange, first_of, pack, schema_of
from ._text import BYTE_CODE, LOWER, Run, gather, mix64, runs, span_hashes
from ._vectors import blob_column, from_blobs
from .bpe import SliceCache, default_path, vocabulary
from .language import held_out

BLOCK, KEYS, VALUES, MIX = 16, 8, 16, 32

#: Greatest exponent either way, so that sums of powers need no greatest one taken off; blocks at once.
MOST, SLAB = 30.0, 256

#: Words whose counts are broadcast, at most; 12 bytes each.
HEAD = 1 << 19

#: Bounds of what the attention part starts from, before it learns from all rows: texts, and characters of one.
SAMPLE, SAMPLE_TEXT = 700, 20_000

#: Windows of a step of a learning task; windows in a row, that share keys and values; windows that a step works on together.
STEP, PIECE, TOGETHER = 1024, 16, 128

#: Bytes of text that a learning task has at least, where that leaves every core a task.
LEARN_BYTES = 32 << 20

#: Share of each distribution that is the smoothed unigram, at least; its least weight.
SMOOTH, LEAST_SMOOTH = 0.001, 40

#: Width of a subword's embedding.
WIDTH = 16

#: Taken off each word's count; share of the model that is attention alone.
DISCOUNT, FREE = 0.75, 0.5

#: The hash that stands for a text's end among word hashes.
END = np.uint64(0x2545F4914F6CDD1D)

COUNT = {"hash": "u8", "c": "i8"}

#: Of a subword: how often it was attended from, its embedding's change that often, and expected
#: counts. Numbers from the vocabulary's size on: the other parameters' changes, by places.
LEARNED = {"token": "i8", "n": "i8", "row": f"V{4 * (WIDTH + MIX)}"}


@dataclass
class Net:
    """Tables of the attention part, by marked subword (2 * id + last)."""

    near: np.ndarray  # what a subword is to those after it: its key, its value, and a one
    here: np.ndarray  # what it is to itself: its query, and its own gate logits
    mix: np.ndarray  # from a value to gate logits
    bias: np.ndarray  # of BLOCK places by 2 * BLOCK keys; minus infinity where a key comes later
    out: np.ndarray  # of each subword, its probability in each of the MIX distributions

    def __post_init__(self):
        """Whether no exponent of attention, and none of the gates, can pass ``MOST``."""
        n = self.here.shape[1] - self.mix.shape[1]
        size = lambda x: float(np.sqrt((x * x).sum(axis=1)).max())
        gate = float(np.abs(self.near[:, n:-1]).max(axis=0) @ np.abs(self.mix).max(axis=1)) + float(np.abs(self.here[:, n:]).max())
        self.small = size(self.here[:, :n]) * size(self.near[:, :n]) < MOST, gate < MOST

    @property
    def pad(self) -> int:
        return len(self.out) - 1

    @property
    def end(self) -> int:
        return len(self.out) - 2

    def gates(self, given: np.ndarray) -> np.ndarray:
        """Gates of all places of all blocks but the first, each times an unknown number; a column for each place."""
        near, here = self.near.take(given, axis=0), self.here.take(given[1:].ravel(), axis=0)
        keys = self.here.shape[1] - self.mix.shape[1]
        one, place, number = near.strides
        near = np.lib.stride_tricks.as_strided(near, (len(given) - 1, 2 * BLOCK, near.shape[2]), (one, place, number), writeable=False)
        s = here[:, :keys].reshape(-1, BLOCK, keys) @ near[:, :, :keys].transpose(0, 2, 1)
        if not self.small[0]:
            bounded(s)
        s += self.bias
        np.exp(s, out=s)
        o = np.empty((near.shape[2] - keys, len(here)), s.dtype)
        np.matmul(near[:, :, keys:].transpose(0, 2, 1), s.transpose(0, 2, 1), out=o.reshape(len(o), -1, BLOCK).transpose(1, 0, 2))
        g = self.mix.T @ (o[:-1] * (1 / o[-1]))
        g += here[:, keys:].T
        if not self.small[1]:
            bounded(g)
        return np.exp(g, out=g)

    def log10(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """log10 probability of each subword; ``first`` cuts the ids into texts."""
        given, place = layout(ids, first, self.pad)
        wanted, p = np.zeros(given.size, np.int32), np.ones(given.size)
        wanted[place] = ids
        for at in range(1, len(given), SLAB):
            g = self.gates(given[at - 1 : at + SLAB])
            which = slice(at * BLOCK, (at + SLAB) * BLOCK)
            p[which] = (g * self.out.take(wanted[which], axis=0).T).sum(axis=0) / g.sum(axis=0)
        return np.log10(p[place])


def layout(ids: np.ndarray, first: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of what is given at each place, the subword before, with a block
    of padding before each text; and the places of all ids."""
    size = np.diff(first)
    blocks = -(-size // BLOCK) + 1
    base = (np.cumsum(blocks) - blocks) * BLOCK
    place = np.repeat(base + BLOCK - first[:-1], size) + np.arange(len(ids))
    given = np.full(int(blocks.sum()) * BLOCK + 1, pad, np.int32)
    given[place + 1] = ids
    given[base] = pad
    given[base + BLOCK] = pad
    return given[:-1].reshape(-1, BLOCK), place


def causal_bias(free: np.ndarray) -> np.ndarray:
    """Bias by distance, laid out for a block and the keys of it and the block before."""
    gap = BLOCK + np.arange(BLOCK)[:, None] - np.arange(2 * BLOCK)[None, :]
    return np.where(gap >= 0, free[np.clip(gap, 0, 2 * BLOCK - 1)], -np.inf).astype(np.float32)


def pieces(ids: np.ndarray, first: np.ndarray, size: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of so many blocks in a row and the one before them: what is given, the
    subwords wanted in all but that one, and which are real. Each real block is wanted in one piece."""
    given, place = layout(ids, first, size - 1)
    wanted, real = np.zeros(given.size, np.int32), np.zeros(given.size, bool)
    wanted[place], real[place] = ids, True
    more = -(len(given) - 1) % length
    given = np.concatenate([given, np.full((more, BLOCK), size - 1, np.int32)])
    wanted, real = (np.concatenate([x.reshape(-1, BLOCK), np.zeros((more, BLOCK), x.dtype)]) for x in (wanted, real))
    at = np.arange(0, len(given) - 1, length)[:, None] + np.arange(length + 1)
    at = at[real[at[:, 1:], 0].any(axis=1)]
    return given[at], wanted[at[:, 1:]], real[at[:, 1:]]


GAP = np.clip(BLOCK + np.arange(BLOCK)[:, None] - np.arange(2 * BLOCK)[None, :], 0, 2 * BLOCK - 1)

def bounded(x: np.ndarray) -> np.ndarray:
    """``x``, with exponents cut to ``MOST`` either way in place where one passes it."""
    return np.clip(x, -MOST, MOST, out=x) if x.max() > MOST or x.min() < -MOST else x


def by_block(x: np.ndarray, pieces: int, first: int = 0) -> np.ndarray:
    """Of rows of all places of pieces: for each piece and each block from ``first``, the rows at its places; a view."""
    return x.reshape(len(x), pieces, -1, BLOCK)[:, :, first:].transpose(1, 2, 0, 3)


def in_pairs(x: np.ndarray, pieces: int) -> np.ndarray:
    """As ``by_block`` from 1, of the places of the block before and of the block; a view of what lies in a row."""
    blocks = by_block(x, pieces)
    n, m, rows, _ = blocks.shape
    return np.ndarray((n, m - 1, rows, 2 * BLOCK), x.dtype, x, 0, blocks.strides)


def f4(x) -> np.ndarray:
    return np.ascontiguousarray(x, np.float32)


@dataclass
class Learner:
    """Parameters of the attention part while it is trained, with the steps' running means."""

    w: dict[str, np.ndarray]
    mean: dict[str, np.ndarray]
    var: dict[str, np.ndarray]
    out: np.ndarray
    steps: int = 0

    def copy(self) -> Learner:
        own = lambda d: {k: x.copy() for k, x in d.items()}
        return Learner(own(self.w), own(self.mean), own(self.var), self.out, self.steps)

    def step(self, given: np.ndarray, wanted: np.ndarray, real: np.ndarray, expected: np.ndarray, rate: float = 0.01, pace: float = 0.3, rng: np.random.Generator | None = None) -> None:
        """One step of attention and gates on ``pieces``; adds the responsibilities to ``expected``, or with ``rng`` one for each subword, drawn by them."""
        w, mean, var = self.w, self.mean, self.var
        self.steps += 1
        width = w["e"].shape[1]
        # what a subword is turned into, key, value, a one and query; and all that the gates come of, attended values and embedding
        into = np.concatenate([w["k"], w["v"], np.zeros((width, 1), np.float32), w["q"]], axis=1)
        gate, bias, share = np.concatenate([w["m"], w["r"]]), causal_bias(w["b"]), np.float32(1 / real.sum())
        grads: dict[str, np.ndarray] = {"into": np.zeros_like(into), "gate": np.zeros_like(gate), "gap": np.zeros(bias.size, np.float32)}
        used = np.zeros(len(w["e"]), bool)
        used[given.ravel()] = True
        spots = np.flatnonzero(used)
        number = np.empty(len(used), np.int64)
        number[spots] = np.arange(len(spots))
        which, rows = number[given.ravel()], w["e"][spots]
        back, each = np.empty((width, given.size), np.float32), given[0].size
        some = max(1, TOGETHER // wanted.shape[1])
        for at in range(0, len(given), some):
            part, places = slice(at, at + some), slice(at * each, (at + some) * each)
            self._back(into, gate, bias, rows.take(which[places], axis=0), wanted[part], real[part], share, expected, rng, grads, back[:, places])
        cut = np.cumsum([KEYS, VALUES, 1])
        grads["k"], grads["v"], _, grads["q"] = np.split(grads.pop("into"), cut, axis=1)
        grads["m"], grads["r"] = np.split(grads.pop("gate"), [VALUES])
        grads["b"] = np.bincount(GAP.ravel(), weights=grads.pop("gap"), minlength=2 * BLOCK)
        for name, grad in grads.items():
            mean[name] = 0.9 * mean[name] + 0.1 * grad
            var[name] = 0.99 * var[name] + 0.01 * grad**2
            w[name] = f4(w[name] - rate * mean[name] / (1 - 0.9**self.steps) / (np.sqrt(var[name] / (1 - 0.99**self.steps)) + 1e-8))
        cells = which + len(spots) * np.arange(width)[:, None]
        grad = f4(np.bincount(cells.ravel(), weights=back.ravel(), minlength=len(spots) * width).reshape(width, -1).T)
        seen = var["e"][spots] + grad**2
        var["e"][spots] = seen
        w["e"][spots] = rows - pace * grad / (np.sqrt(seen) + 1e-8)

    def _back(self, into: np.ndarray, gate: np.ndarray, bias: np.ndarray, es: np.ndarray, wanted: np.ndarray, real: np.ndarray, share: np.float32, expected: np.ndarray, rng: np.random.Generator | None, grads: dict[str, np.ndarray], back: np.ndarray) -> None:
        """Adds some pieces' part to a step's gradients, and puts that of the embeddings ``es`` of all places in ``back``.

        Arrays have a row for each number and a column for each place, so what holds for a place goes along rows. A block's
        keys and values are worked out once for both blocks that attend to it. Weights of attention stay undivided: what
        goes back to them is divided by their sum instead, and less its own mean by the one beside the values.
        """
        ones, n, width = KEYS + VALUES, len(wanted), len(into)
        x = into.T @ es.T
        x[ones] = 1
        k, v, q = in_pairs(x[:KEYS], n), in_pairs(x[KEYS : ones + 1], n), by_block(x[ones + 1 :], n, 1)
        s = bounded(q.swapaxes(2, 3) @ k)
        s += bias
        np.exp(s, out=s)
        t, real = wanted.ravel(), real.ravel()
        o = np.empty((VALUES + 1, len(t)), np.float32)
        np.matmul(v, s.swapaxes(2, 3), out=by_block(o, n))
        z = 1 / o[-1]
        of = np.empty((VALUES + width, len(t)), np.float32)
        o = np.multiply(o[:-1], z, out=of[:VALUES])
        of[VALUES:].reshape(width, n, -1)[...] = es.reshape(n, -1, width)[:, BLOCK:].transpose(2, 0, 1)
        g = bounded(gate.T @ of)
        np.exp(g, out=g)
        r = g * self.out.take(t, axis=0).T
        if rng is None:
            total = r.sum(axis=0)
            chosen = np.flatnonzero(real)
            chosen = chosen[np.argsort(t[chosen], kind="stable")]
            heads = np.flatnonzero(first_of(t[chosen]) == np.arange(len(chosen)))
            expected[t[chosen[heads]]] += np.add.reduceat((r / total).T[chosen], heads)
        else:
            upto = r.copy()
            for below, row in zip(upto[:-1], upto[1:], strict=True):
                row += below
            total = upto[-1]
            spot = (upto < rng.random(len(t), np.float32) * total).view(np.int8).sum(axis=0, dtype=np.int8)
            np.add.at(expected.ravel(), (t * np.int64(MIX) + np.minimum(spot, MIX - 1))[real], np.float32(1))
        weight = real * share
        g *= weight / g.sum(axis=0)
        r *= weight / total
        g -= r
        grads["gate"] += of @ g.T
        d = gate @ g
        do = np.empty((VALUES + 1, len(t)), np.float32)
        np.multiply(d[:VALUES], z, out=do[:-1])
        np.negative((do[:-1] * o).sum(axis=0), out=do[-1])
        to = by_block(do, n)
        ds = to.swapaxes(2, 3) @ v
        ds *= s
        grads["gap"] += np.ones(len(t) // BLOCK, np.float32) @ ds.reshape(-1, bias.size)
        dx, before = np.zeros_like(x), np.empty((ones, len(t)), np.float32)
        for to_k, to_v, at in ((by_block(before[:KEYS], n), by_block(before[KEYS:], n), slice(BLOCK)), (by_block(dx[:KEYS], n, 1), by_block(dx[KEYS:ones], n, 1), slice(BLOCK, None))):
            np.matmul(q, ds[..., at], out=to_k)
            np.matmul(to[:, :, :-1], s[..., at], out=to_v)
        dx[:ones].reshape(ones, n, -1)[:, :, :-BLOCK] += before.reshape(ones, n, -1)
        np.matmul(k, ds.swapaxes(2, 3), out=by_block(dx[ones + 1 :], n, 1))
        grads["into"] += es.T @ dx.T
        np.matmul(into, dx, out=back)
        back.reshape(width, n, -1)[:, :, BLOCK:] += d[VALUES:].reshape(width, n, -1)

    def net(self) -> Net:
        w, e = self.w, self.w["e"]
        near = np.concatenate([e @ w["k"], e @ w["v"], np.ones((len(e), 1))], axis=1)
        return Net(*(f4(x) for x in (near, np.concatenate([e @ w["q"], e @ w["r"]], axis=1), w["m"], causal_bias(w["b"]), self.out)))


def begin(ids: np.ndarray, first: np.ndarray, size: int, *, width: int = WIDTH, epochs: int = 6, batch: int = 64, rate: float = 0.01, pace: float = 0.3, seed: int = 5) -> Learner:
    """Attention and gates by Adam, distributions by expectation maximisation, in turn.

    The gradient of the gates' logits is gate minus responsibility, and the
    distributions are responsibilities summed, with a share of the smoothed
    unigram; so no step sums over the vocabulary but the distributions' own.
    """
    rng = np.random.default_rng(seed)
    counts = np.bincount(ids, minlength=size) + 0.05
    unigram = f4(counts / counts.sum())
    out = unigram[:, None] * np.exp(f4(rng.normal(0, 1, (size, MIX))))
    out /= out.sum(axis=0)
    shapes = {"e": (size, width), "q": (width, KEYS), "k": (width, KEYS), "v": (width, VALUES), "m": (VALUES, MIX), "r": (width, MIX)}
    scale = {"e": 0.5, "r": 0.5}
    w = {k: f4(rng.normal(0, scale.get(k, 0.3), x)) for k, x in shapes.items()} | {"b": np.zeros(2 * BLOCK, np.float32)}
    w["e"][size - 1] = 0
    now = Learner(w, {k: np.zeros_like(x) for k, x in w.items() if k != "e"}, {k: np.zeros_like(x) for k, x in w.items()}, out)
    parts = pieces(ids, first, size, 1)
    n = len(parts[0])
    expected = np.zeros((size, MIX), np.float32)
    every = max(20, n // batch // 8)
    for _ in range(epochs if n else 0):
        for some in np.array_split(rng.permutation(n), max(1, n // batch)):
            now.step(*(x[some] for x in parts), expected, rate, pace)
            if now.steps % every == 0:
                np.multiply(unigram[:, None], LEAST_SMOOTH, out=out)
                out += expected
                out /= out.sum(axis=0)
                expected *= 0.6
    return now


def train(ids: np.ndarray, first: np.ndarray, size: int, **how) -> Net:
    """The net learned from these texts alone."""
    return begin(ids, first, size, **how).net()


def _learn(shared, buckets: int):
    """What a task's rows change, by subword. Every window of every row makes steps of
    attention and gates, and every subword adds to the distributions' counts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, start = shared.value
        spell, now, size = speller(path), start.copy(), len(start.out)
        expected, n, places = np.zeros((size, MIX), np.float32), np.zeros(size, np.int64), 0
        rng = np.random.default_rng(7)
        for batch in batches:
            for run in runs(batch.column("text")):
                _, first, subwords, upto, _ = spell.words(run)
                parts = pieces(subwords, upto[first], size, PIECE)
                blocks = parts[2][:, :, 0]
                for some in np.array_split(rng.permutation(len(parts[0])), max(1, blocks.sum() // STEP)):
                    now.step(*(x[some] for x in parts), expected, rng=rng)
                n += np.bincount(parts[0][:, 1:][blocks].ravel(), minlength=size)
                places += len(subwords)
        if not places:
            return
        token = np.flatnonzero((n > 0) | (expected[:, 0] > 0))
        rows = np.concatenate([(now.w["e"][token] - start.w["e"][token]) * f4(n[token])[:, None], expected[token]], axis=1)
        rest = np.concatenate([(now.w[k] - start.w[k]).ravel() * np.float32(places) for k in start.mean])
        rest = np.append(rest, np.zeros(-len(rest) % rows.shape[1], np.float32)).reshape(-1, rows.shape[1])
        token = np.append(token, size + np.arange(len(rest)))
        fields = {"token": token, "n": np.append(n[token[token < size]], np.full(len(rest), places)), "row": f4(np.concatenate([rows, rest])).view(LEARNED["row"]).ravel()}
        yield pack(fields, token % buckets)

    return work


def _merge(x: dict) -> pa.Table:
    order = np.argsort(x["token"], kind="stable")
    token = x["token"][order]
    heads = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    rows = x["row"].view(np.float32).reshape(len(order), -1)[order].astype(np.float64)
    return pa.table({"token": pa.array(token[heads]), "n": pa.array(np.add.reduceat(x["n"][order], heads)), "row": blob_column(f4(np.add.reduceat(rows, heads)))})


def learn(texts: DataFrame, start: Learner, path: str, tasks: int) -> Learner:
    """``start`` after all texts were learned from, in so many tasks at most."""
    shared = texts.sparkSession.sparkContext.broadcast((path, start))
    buckets = 128
    sent = texts.select("text").coalesce(tasks).mapInArrow(_learn(shared, buckets), schema_of(LEARNED))
    found = exchange(sent, LEARNED, _merge, "token long, n long, row binary").toArrow()
    if not len(found):
        return start
    order = np.argsort(found.column("token").to_numpy())
    token, n = found.column("token").to_numpy()[order], found.column("n").to_numpy()[order]
    rows = from_blobs(found.column("row"), np.float32)[order]
    del found
    now, size = start.copy(), len(start.out)
    own = token < size
    now.w["e"][token[own]] += rows[own, :WIDTH] / f4(np.maximum(n[own], 1))[:, None]
    rest, at = (rows[~own] / f4(n[~own])[:, None]).ravel(), 0
    for k in start.mean:
        now.w[k] = now.w[k] + rest[at : at + now.w[k].size].reshape(now.w[k].shape)
        at += now.w[k].size
    expected = np.zeros((size, MIX))
    expected[token[own]] = rows[own, WIDTH:]
    unigram = expected.sum(axis=1) + 0.05
    expected += (unigram / unigram.sum())[:, None] * np.maximum(LEAST_SMOOTH, SMOOTH * expected.sum(axis=0))
    now.out = f4(expected / expected.sum(axis=0))
    return now


class Speller:
    """Words and marked subwords of runs of texts."""

    def __init__(self, path: str):
        self.vocab = vocabulary(path)
        self.cache = SliceCache(self.vocab)
        self.end = 2 * self.vocab.size

    @property
    def size(self) -> int:
        return self.end + 2

    def words(self, run: Run) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """Token hashes (each row's words, then an end), each row's first token
        (rows + 1 long), the subwords of all tokens, and each token's first (tokens + 1 long);
        and the distinct token hashes, and which of them each token's is."""
        data = LOWER[run.data]
        starts, ends, first = run.words(data)
        n = len(starts)
        hashes = span_hashes(BYTE_CODE[data], starts, ends) if n else np.empty(0, np.uint64)
        distinct, one, which = np.unique(hashes, return_index=True, return_inverse=True)
        at, count = self.cache.lookup(distinct, data, starts[one], ends[one]) if n else (np.empty(0, np.int64),) * 2
        ids = 2 * gather(self.cache.flat, at[which], count[which]).astype(np.int64)
        ids[np.cumsum(count[which]) - 1] += 1
        # an end after each row's words
        token_row_end = first[1:] + np.arange(1, run.rows + 1) - 1
        tokens = np.full(n + run.rows, END)
        is_word = np.ones(n + run.rows, bool)
        is_word[token_row_end] = False
        tokens[is_word] = hashes
        size = np.ones(n + run.rows, np.int64)
        size[is_word] = count[which]
        upto = np.concatenate([[0], np.cumsum(size)])
        subwords = np.full(int(upto[-1]), self.end, np.int64)
        subwords[np.repeat(is_word, size)] = ids
        kind = np.full(n + run.rows, len(distinct))
        kind[is_word] = which
        return tokens, np.concatenate([[0], token_row_end + 1]), subwords, upto, (np.append(distinct, END), kind)


_spellers: dict[str, Speller] = {}


def speller(path: str) -> Speller:
    """The speller of a vocabulary, one in each worker, with what it has spelled."""
    if path not in _spellers:
        _spellers[path] = Speller(path)
    return _spellers[path]


def _count(buckets: int):
    def combine(x: dict) -> tuple[dict, np.ndarray]:
        distinct, which = np.unique(x["hash"], return_inverse=True)
        return {"hash": distinct, "c": np.bincount(which, weights=x["c"]).astype(np.int64)}, mix64(distinct)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        box = Outbox(COUNT, buckets, combine)
        for batch in batches:
            for run in runs(batch.column("text")):
                data = LOWER[run.data]
                starts, ends, _ = run.words(data)
                hashes = np.append(span_hashes(BYTE_CODE[data], starts, ends), END) if len(starts) else np.array([END])
                distinct, c = np.unique(hashes, return_counts=True)
                c[distinct == END] = run.rows
                box.add(hash=distinct, c=c)
                yield from box.full()
        yield from box.close()

    return work


def _sum(x: dict) -> pa.Table:
    distinct, which = np.unique(x["hash"], return_inverse=True)
    return pa.table({"hash": pa.array(distinct.view(np.int64)), "c": pa.array(np.bincount(which, weights=x["c"]).astype(np.int64))})


def word_counts(texts: DataFrame) -> DataFrame:
    """(hash, c) of every distinct token of all texts, words by 64-bit hash."""
    buckets = max(128, texts.rdd.getNumPartitions())
    sent = texts.select("text").mapInArrow(_count(buckets), schema_of(COUNT))
    return exchange(sent, COUNT, _sum, "hash long, c long")


@dataclass
class Scorer:
    net: Net
    path: str
    heads: np.ndarray  # hashes of the frequent words, sorted
    counts: np.ndarray
    total: int
    distinct: int

    @property
    def share(self) -> float:
        """Share of the model that is given to the attention part."""
        freed = DISCOUNT * self.distinct / self.total if self.total else 1.0
        return (1 - FREE) * freed + FREE

    def log10(self, c: np.ndarray, attention: np.ndarray) -> np.ndarray:
        """log10 of the model's probability of tokens with count c, given that of the attention part.

        An unknown token's is a product, so it stays finite where the power would be zero.
        """
        seen = (1 - FREE) * np.maximum(c - DISCOUNT, 0) / max(self.total, 1)
        both = np.log10(np.where(seen > 0, seen + self.share * 10.0**attention, 1.0))
        return np.where(seen > 0, both, np.log10(self.share) + attention)


def _score(shared):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Scorer = shared.value
        spell = speller(m.path)
        for batch in batches:
            for run in runs(batch.column("text")):
                tokens, first, subwords, upto, (uniq, which) = spell.words(run)
                logs = m.net.log10(subwords, upto[first])
                logp = np.add.reduceat(logs, upto[:-1])
                spot = np.minimum(np.searchsorted(m.heads, uniq), max(len(m.heads) - 1, 0))
                known = m.heads[spot] == uniq if len(m.heads) else np.zeros(len(uniq), bool)
                c = np.where(known, m.counts[spot] if len(m.heads) else 0, 0)[which]
                head = known[which]
                base = np.where(head, np.log10((c + 1) / (m.total + m.distinct + 1)), 0.0)
                score = np.where(head, m.log10(c, logp), 0.0)
                rest = np.flatnonzero(~head)
                cut = np.searchsorted(rest, first).astype(np.int32)
                rows = batch.slice(run.first, run.rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("rid"), rows.column("doc_id"), pa.array(np.diff(first)),
                        pa.array(np.add.reduceat(head.astype(np.int64), first[:-1])), pa.array(np.add.reduceat(base, first[:-1])), pa.array(np.add.reduceat(score, first[:-1])),
                        pa.ListArray.from_arrays(pa.array(cut), pa.array(tokens[rest].view(np.int64))), pa.ListArray.from_arrays(pa.array(cut), pa.array(logp[rest])),
                    ],
                    ["rid", "doc_id", "n_tokens", "n_known", "base_score", "score", "rest", "rest_logp"],
                )

    return work


SCORED = "rid long, doc_id long, n_tokens long, n_known long, base_score double, score double, rest array<long>, rest_logp array<double>"


def fit(docs: DataFrame, scratch: Scratch, path: str) -> tuple[Scorer, DataFrame]:
    """The scorer learned from all rows of (doc_id, text), and their word counts."""
    counts = scratch.keep(word_counts(docs))
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # the least count of a broadcast word, by a histogram with a fixed number of bins
    step = F.floor(F.log2("c") * 8).cast("int")
    bins = sorted(counts.groupBy(step.alias("step")).count().collect(), key=lambda r: -r.step)
    sums = np.cumsum([r["count"] for r in bins])
    fits = [r.step for r, s in zip(bins, sums, strict=True) if s <= HEAD]
    names, numbers = np.empty(0, np.uint64), np.empty(0, np.int64)
    if fits:
        heads = counts.where(step >= fits[-1]).toArrow()
        names = heads.column("hash").to_numpy().view(np.uint64)
        order = np.argsort(names)
        names, numbers = names[order], heads.column("c").to_numpy()[order]
        del heads

    some = docs.where(F.octet_length("text") > 0)
    n, size = some.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    spot = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    some = some.where(spot < int(min(1.0, 1.5 * SAMPLE / max(n, 1)) * (1 << 30)))
    texts = [r.text for r in some.orderBy(spot, "text").limit(SAMPLE).select(F.substring("text", 1, SAMPLE_TEXT).alias("text")).collect()]
    spell = speller(path)
    parts, cuts = [np.empty(0, np.int64)], [0]
    for run in runs(pa.array(texts, pa.large_string())):
        _, first, subwords, upto, _ = spell.words(run)
        cuts += (upto[first][1:] + cuts[-1]).tolist()
        parts.append(subwords)
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // LEARN_BYTES))
    net = learn(docs, begin(np.concatenate(parts), np.array(cuts), spell.size), path, tasks).net()
    return Scorer(net, path, names, numbers, int(total), int(distinct)), counts


def score(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", mod: int = 7, rest: int = 2) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows whose crc32(id) mod ``mod`` is not ``rest`` (a null id
    is learned from). Null, empty and blank texts are one end token. Repeated
    rows count each time and are scored each for themselves. With no training
    rows at all no token is known. Whole texts count; other columns aren't read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "attention")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), held_out(F.col(id_col), mod, rest).alias("held"))
    scorer, counts = fit(rows.where("NOT held").select("doc_id", "text"), scratch, path)
    shared = spark.sparkContext.broadcast(scorer)
    parts = scratch.keep(rows.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text").mapInArrow(_score(shared), SCORED))
    words = parts.select("rid", F.explode(F.arrays_zip("rest", "rest_logp")).alias("x")).select("rid", F.col("x.rest").alias("hash"), F.col("x.rest_logp").alias("logp"))
    words = words.join(counts, "hash", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    n, v = max(scorer.total, 1), scorer.distinct
    seen = F.lit(1 - FREE) * F.greatest(F.col("c") - DISCOUNT, F.lit(0.0)) / n
    share = F.lit(float(scorer.share))
    logs = F.when(seen > 0, F.log10(seen + share * F.pow(F.lit(10.0), "logp"))).otherwise(F.log10(share) + F.col("logp"))
    more = words.groupBy("rid").agg(
        F.sum((F.col("c") > 0).cast("long")).alias("known2"), F.sum(F.log10((F.col("c") + 1) / F.lit(float(scorer.total + v + 1)))).alias("base2"), F.sum(logs).alias("score2")
    )
    zero = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    out = parts.drop("rest", "rest_logp").join(more, "rid", "left").select(
        "doc_id", held_out(F.col("doc_id"), mod, rest).alias("held_out"), "n_tokens", zero("n_known", "known2").alias("n_known"),
        F.lit(scorer.total).cast("long").alias("train_tokens"), zero("base_score", "base2").alias("base_score"), zero("score", "score2").alias("score"),
    )
    return scratch.result(out)


def op7_lm_score(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), default_path())


QUERIES = {"op7_lm_score": op7_lm_score}
ORACLE: dict[str, str] = {}
