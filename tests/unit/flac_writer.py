"""A small FLAC encoder for tests: all kinds of subframes, of Rice codes, and of channels."""

import hashlib

import numpy as np

from segue.sources import flac


class Writer:
    def __init__(self):
        self.parts = []

    def put(self, value, n):
        self.parts.append(format(value & ((1 << n) - 1), f"0{n}b") if n else "")

    def unary(self, n):
        self.parts.append("0" * n + "1")

    def data(self):
        bits = "".join(self.parts)
        bits += "0" * (-len(bits) % 8)
        return int(bits or "0", 2).to_bytes(len(bits) // 8, "big")


def rice(w, values, k):
    for v in values:
        u = v << 1 if v >= 0 else (-v << 1) - 1
        w.unary(u >> k)
        w.put(u, k)


def residual(w, values, size, order, parts_log, escape, wide):
    w.put(int(wide), 2)
    w.put(parts_log, 4)
    parts, at = 1 << parts_log, 0
    for p in range(parts):
        n = size // parts - (order if p == 0 else 0)
        some = values[at : at + n]
        at += n
        if escape:
            w.put((1 << (4 + wide)) - 1, 4 + wide)
            most = max([int(v).bit_length() + 1 for v in some], default=0)
            w.put(most, 5)
            for v in some:
                w.put(v, most)
        else:
            mean = max(1, int(np.mean(np.abs(some)))) if some else 1
            k = min(mean.bit_length(), 14)
            w.put(k, 4 + wide)
            rice(w, some, k)


def subframe(w, x, bits, kind, wasted=0, parts_log=2, escape=False, wide=False, weights=(1900, -900, 20), shift=10):
    """kind: constant, verbatim, fixed0 to fixed4, lpc."""
    x = [int(v) >> wasted for v in x]
    bits -= wasted
    code = {"constant": 0, "verbatim": 1, "lpc": 31 + len(weights)}.get(kind, 8 + int(kind[-1]) if kind.startswith("fixed") else 0)
    w.put(0, 1)
    w.put(code, 6)
    w.put(int(wasted > 0), 1)
    if wasted:
        w.unary(wasted - 1)
    if kind == "constant":
        w.put(x[0], bits)
        return
    if kind == "verbatim":
        for v in x:
            w.put(v, bits)
        return
    if kind == "lpc":
        c, s = weights, shift
    else:
        c, s = flac.FIXED[int(kind[-1])], 0
    order = len(c)
    for v in x[:order]:
        w.put(v, bits)
    if kind == "lpc":
        w.put(12 - 1, 4)
        w.put(shift, 5)
        for v in c:
            w.put(v, 12)
    left = [x[n] - (sum(c[j] * x[n - 1 - j] for j in range(order)) >> s) for n in range(order, len(x))]
    residual(w, left, len(x), order, parts_log, escape, wide)


def number(n):
    return chr(n).encode("utf-8") if n < 0xD800 else bytes([0xF0 | n >> 18, 0x80 | n >> 12 & 63, 0x80 | n >> 6 & 63, 0x80 | n & 63])


def frame(n, x, bits, channel, kinds, **options):
    """One frame of samples (rows x channels); channel 8 left and side, 9 side and right, 10 middle and side."""
    size = len(x)
    head = bytes([0xFF, 0xF8, 7 << 4 | 0, channel << 4]) + number(n) + (size - 1).to_bytes(2, "big")
    head += bytes([flac.crc8(head)])
    parts = list(x.T)
    if channel >= 8:
        left, right = parts
        side = left - right
        parts = {8: [left, side], 9: [side, right], 10: [left + right >> 1, side]}[channel]
    w = Writer()
    for c, (part, kind) in enumerate(zip(parts, kinds, strict=True)):
        subframe(w, part.tolist(), bits + int(channel in (8, 10) and c == 1 or channel == 9 and c == 0), kind, **options)
    body = head + w.data()
    return body + int(flac.crc16([body])[0]).to_bytes(2, "big")


def encode(x, rate=22050, bits=16, block=256, layouts=None, comments=(), total=None, **options):
    """A file of samples (rows x channels); ``layouts`` are (channel code, kinds) taken in turn."""
    channels = x.shape[1]
    layouts = layouts or [(channels - 1, ["fixed2"] * channels)]
    frames = []
    for n, at in enumerate(range(0, len(x), block)):
        part = x[at : at + block]
        code, kinds = layouts[n % len(layouts)]
        own = dict(options)
        if len(part) < block:
            own["parts_log"] = 0
        frames.append(frame(n, part, bits, code, kinds, **own))
    word = rate << 44 | (channels - 1) << 41 | (bits - 1) << 36 | (len(x) if total is None else total)
    info = (block).to_bytes(2, "big") * 2 + b"\0" * 6 + word.to_bytes(8, "big") + hashlib.md5(flac.packed(x, bits)).digest()
    note = b"\1\0\0\0x" + len(comments).to_bytes(4, "little") + b"".join(len(c.encode()).to_bytes(4, "little") + c.encode() for c in comments)
    return b"fLaC" + bytes([0, *len(info).to_bytes(3, "big")]) + info + bytes([0x84, *len(note).to_bytes(3, "big")]) + note + b"".join(frames)
