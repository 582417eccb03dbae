"""Samples of FLAC files, decoded with numpy.

Frames are parsed one after the other, as a frame's end is known only when its
residuals are read. Rice codes are found by jumping from the end of one to the
next bit that is set; their values are then read all at once. Prediction runs
over the samples of all subframes of one order in step, so a file takes about as
many array operations as a frame has samples, not as the file has.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np

#: Fixed by the format: block sizes and rates by their codes in a frame's header, and sample sizes.
BLOCK_SIZES = {1: 192, 2: 576, 3: 1152, 4: 2304, 5: 4608, 8: 256, 9: 512, 10: 1024, 11: 2048, 12: 4096, 13: 8192, 14: 16384, 15: 32768}
SAMPLE_SIZES = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}

#: Fixed by the format: binomial coefficients of the fixed predictors.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))

#: Fixed by the format: generators of the checks of headers and of frames.
CRC8, CRC16 = 0x07, 0x8005


class Broken(ValueError):
    """A file that is no FLAC, is cut short, or does not pass its own checks."""


def _table(generator: int, bits: int) -> np.ndarray:
    out = np.arange(256, dtype=np.int64) << (bits - 8)
    for _ in range(8):
        out = np.where(out >> (bits - 1) & 1, out << 1 ^ generator, out << 1) & ((1 << bits) - 1)
    return out


def crc8(data: bytes) -> int:
    table, out = _table(CRC8, 8), 0
    for b in data:
        out = int(table[out ^ b])
    return out


def crc16(frames: list[bytes]) -> np.ndarray:
    """The checks of many frames, byte by byte over all of them; zeros before a frame change nothing."""
    table = _table(CRC16, 16)
    most = max(map(len, frames))
    data = np.frombuffer(b"".join(f.rjust(most, b"\0") for f in frames), np.uint8).reshape(len(frames), most).T.astype(np.int64)
    out = np.zeros(len(frames), np.int64)
    for column in data:
        out = (out << 8 & 0xFFFF) ^ table[out >> 8 ^ column]
    return out


@dataclass
class Stream:
    rate: int
    channels: int
    bits: int
    samples: int
    md5: bytes
    at: int  # of the first frame


def stream(data: bytes) -> Stream:
    """What the header says."""
    if data[:4] != b"fLaC":
        raise Broken("no FLAC file")
    at, last, found = 4, False, None
    while not last:
        if at + 4 > len(data):
            raise Broken("the header is cut short")
        last, kind, size = bool(data[at] & 0x80), data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
        block = data[at + 4 : at + 4 + size]
        at += 4 + size
        if kind == 0:
            if len(block) < 34:
                raise Broken("the stream information is cut short")
            word = int.from_bytes(block[10:18], "big")
            found = Stream(word >> 44, (word >> 41 & 7) + 1, (word >> 36 & 31) + 1, word & ((1 << 36) - 1), block[18:34], 0)
    if found is None or not found.rate:
        raise Broken("no stream information")
    found.at = at
    return found


class Bits:
    """A frame's bytes, read from any bit on."""

    def __init__(self, data: bytes):
        self.size = 8 * len(data)
        self.whole = int.from_bytes(data, "big")
        self.raw = np.frombuffer(data + b"\0" * 16, np.uint8)
        bits = np.unpackbits(np.frombuffer(data, np.uint8))
        self.ones = np.flatnonzero(bits)
        self.before = np.zeros(self.size + 1, np.int64)
        np.cumsum(bits, out=self.before[1:])
        self.at = 0

    def take(self, n: int) -> int:
        if self.at + n > self.size:
            raise EOFError
        self.at += n
        return self.whole >> (self.size - self.at) & ((1 << n) - 1)

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v - (1 << n) if n and v >> (n - 1) else v

    def unary(self) -> int:
        """Zeros before the next bit that is set."""
        k = int(self.before[self.at])
        if k >= len(self.ones):
            raise EOFError
        n = int(self.ones[k]) - self.at
        self.at += n + 1
        return n

    def numbers(self, spots: np.ndarray, n: int) -> np.ndarray:
        """Numbers of n bits that begin at these bits."""
        first = spots >> 3
        words = self.raw[first[:, None] + np.arange(8)].astype(np.uint64)
        out = np.zeros(len(spots), np.uint64)
        for j in range(8):
            out = out << np.uint64(8) | words[:, j]
        return (out << (spots & 7).astype(np.uint64) >> np.uint64(64 - n)).astype(np.int64) if n else np.zeros(len(spots), np.int64)

    def row(self, count: int, n: int) -> np.ndarray:
        """So many signed numbers of n bits, one after the other."""
        if self.at + count * n > self.size:
            raise EOFError
        v = self.numbers(self.at + n * np.arange(count), n)
        self.at += count * n
        return v - ((v >> max(n - 1, 0) & 1) << n) if n else v

    def rice(self, count: int, k: int) -> np.ndarray:
        """So many Rice codes: a unary quotient, then k bits."""
        if not count:
            return np.empty(0, np.int64)
        low = int(self.before[self.at])
        ones = self.ones[low : low + count * (k + 1) + 1]
        if not len(ones):
            raise EOFError
        # from each set bit to the first one behind its code
        jump = (self.before[np.minimum(ones + 1 + k, self.size)] - low).tolist()
        path, i, most = [0] * count, 0, len(ones)
        for c in range(count):
            if i >= most:
                raise EOFError
            path[c] = i
            i = jump[i]
        ends = ones[np.array(path)]
        if int(ends[-1]) + 1 + k > self.size:
            raise EOFError
        begins = np.concatenate([[self.at], ends[:-1] + 1 + k])
        self.at = int(ends[-1]) + 1 + k
        v = (ends - begins) << k | self.numbers(ends + 1, k)
        return v >> 1 ^ -(v & 1)


@dataclass
class Subframe:
    """Warm-up samples and residuals, and how they are predicted: the next sample is the weighted sum of those before, shifted, and the residual."""

    values: np.ndarray
    weights: tuple[int, ...] = ()
    shift: int = 0
    wasted: int = 0


def _residual(b: Bits, size: int, order: int) -> np.ndarray:
    method = b.take(2)
    if method > 1:
        raise Broken("a way of coding that is not known")
    width, parts = 4 + method, 1 << b.take(4)
    if size % parts or size // parts < order:
        raise Broken("partitions do not fit")
    out = []
    for part in range(parts):
        count = size // parts - (order if part == 0 else 0)
        k = b.take(width)
        out.append(b.row(count, b.take(5)) if k == (1 << width) - 1 else b.rice(count, k))
    return np.concatenate(out)


def _subframe(b: Bits, size: int, bits: int) -> Subframe:
    if b.take(1):
        raise Broken("a subframe does not begin with 0")
    kind = b.take(6)
    wasted = b.unary() + 1 if b.take(1) else 0
    bits -= wasted
    if kind == 0:
        return Subframe(np.full(size, b.signed(bits), np.int64), wasted=wasted)
    if kind == 1:
        return Subframe(b.row(size, bits), wasted=wasted)
    if 8 <= kind <= 12:
        weights, shift = FIXED[kind - 8], 0
        warm = b.row(len(weights), bits)
    elif kind >= 32:
        order = kind - 31
        warm = b.row(order, bits)
        precision, shift = b.take(4) + 1, b.signed(5)
        if precision == 16 or shift < 0:
            raise Broken("a predictor that is not allowed")
        weights = tuple(b.row(order, precision).tolist())
    else:
        raise Broken("a kind of subframe that is not known")
    if len(weights) > size:
        raise Broken("more warm-up than samples")
    return Subframe(np.concatenate([warm, _residual(b, size, len(weights))]), weights, shift, wasted)


def predicted(subframes: list[Subframe]) -> None:
    """Turns residuals into samples: all subframes of one order in step."""
    by_order: dict[int, list[Subframe]] = {}
    for s in subframes:
        if s.weights:
            by_order.setdefault(len(s.weights), []).append(s)
    for order, group in by_order.items():
        most = max(len(s.values) for s in group)
        x = np.zeros((most, len(group)), np.int64)
        for j, s in enumerate(group):
            x[: len(s.values), j] = s.values
        weights = np.array([s.weights[::-1] for s in group], np.int64).T
        shift = np.array([s.shift for s in group], np.int64)
        for n in range(order, most):
            x[n] += (weights * x[n - order : n]).sum(axis=0) >> shift
        for j, s in enumerate(group):
            s.values = x[: len(s.values), j]


def _header(data: bytes, at: int, s: Stream) -> tuple[int, int, int, int]:
    """(bytes of the header, samples, channel code, bits) of the frame at a place."""
    head = data[at : at + 16]
    if len(head) < 6:
        raise EOFError
    if head[0] != 0xFF or head[1] & 0xFE != 0xF8:
        raise Broken("a frame does not begin where the one before ends")
    size_code, rate_code, channel, bits_code = head[2] >> 4, head[2] & 15, head[3] >> 4, head[3] >> 1 & 7
    first = head[4]  # a number of 1 to 7 bytes
    n = 5 + max((8 - (~first & 0xFF).bit_length()) - 1, 0) if first & 0x80 else 5
    if size_code in (6, 7):
        wide = size_code - 5
        size = int.from_bytes(head[n : n + wide], "big") + 1
        n += wide
    elif size_code in BLOCK_SIZES:
        size = BLOCK_SIZES[size_code]
    else:
        raise Broken("a block size that is not known")
    n += {12: 1, 13: 2, 14: 2}.get(rate_code, 0)
    if len(head) <= n:
        raise EOFError
    if crc8(head[:n]) != head[n]:
        raise Broken("a frame's header fails its check")
    bits = SAMPLE_SIZES.get(bits_code, s.bits if bits_code == 0 else 0)
    if not bits or channel > 10:
        raise Broken("a frame's header is not known")
    return n + 1, size, channel, bits


def decode(data: bytes, seconds: float | None = None) -> tuple[np.ndarray, Stream]:
    """Samples (rows x channels) of the first seconds, or of all, as whole numbers.

    Frames must pass their checks, and a whole file its sum; else it is ``Broken``.
    """
    s = stream(data)
    wanted = None if seconds is None else int(seconds * s.rate)
    at, got, frames, checks, kept = s.at, 0, [], [], []
    try:
        while at < len(data) and (wanted is None or got < wanted) and not (s.samples and got >= s.samples):
            head, size, channel, bits = _header(data, at, s)
            channels = channel + 1 if channel < 8 else 2
            room = head + 64 + channels * (size * (bits + 2) // 8 + 64)
            while True:
                b = Bits(data[at + head : at + room])
                try:
                    parts = [_subframe(b, size, bits + int(channel in (8, 10) and c == 1 or channel == 9 and c == 0)) for c in range(channels)]
                    b.take(-b.at % 8)
                    check = b.take(16)
                    break
                except EOFError:
                    if at + room >= len(data):
                        raise
                    room *= 2
            end = at + head + b.at // 8
            kept.append(data[at : end - 2])
            checks.append(check)
            frames.append((size, channel, parts))
            at, got = end, got + size
    except EOFError:
        raise Broken("the file is cut short") from None
    if not frames:
        return np.empty((0, s.channels), np.int64), s
    if not np.array_equal(crc16(kept), checks):
        raise Broken("a frame fails its check")
    predicted([p for _, _, parts in frames for p in parts])
    out = []
    for _, channel, parts in frames:
        a, *more = (p.values << p.wasted for p in parts)
        if channel < 8:
            out.append(np.stack([a, *more], axis=1))
            continue
        b_ = more[0]
        if channel == 8:
            left, right = a, a - b_
        elif channel == 9:
            left, right = a + b_, b_
        else:
            mid = a << 1 | b_ & 1
            left, right = mid + b_ >> 1, mid - b_ >> 1
        out.append(np.stack([left, right], axis=1))
    y = np.concatenate(out)
    if wanted is None:
        if s.samples and len(y) < s.samples:
            raise Broken("the file is cut short")
        if any(s.md5) and hashlib.md5(packed(y, s.bits)).digest() != s.md5:
            raise Broken("the samples fail the file's check")
    return y[:wanted], s


def packed(y: np.ndarray, bits: int) -> bytes:
    """Samples as the file's sum takes them: little-endian, channels in turn, whole bytes."""
    width = (bits + 7) // 8
    raw = np.ascontiguousarray(y.astype("<i8")).view(np.uint8).reshape(-1, 8)
    return raw[:, :width].tobytes()
