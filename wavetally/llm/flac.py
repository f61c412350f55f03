"""FLAC streams (RFC 9639): an encoder for mono 8-bit PCM and a decoder.

``encode`` and ``decode`` work on many streams at once: frames are the lanes of numpy
arrays, and a Rice-coded residual is read one code per lane and step. The encoder takes
fixed predictors up to order 2 or linear prediction of order ORDER, whichever is
smaller. Frames of any other make (several channels, other sample sizes, other orders,
several Rice partitions) are read one by one by ``read_frame``.
Every frame's header CRC-8 and CRC-16 and each stream's MD5 are verified; a
mismatch raises ``FlacError``. The seek table has a point for each frame, so that
``read_samples`` reads any stretch without the frames before it.
"""

from __future__ import annotations

import hashlib
import struct
from functools import lru_cache

import numpy as np

BLOCK = 2048
RATE = 8000
#: Frames that are encoded or decoded together.
LANES = 2048
#: Linear prediction of the encoder: order, bits of a coefficient, right shift of the sum.
ORDER, PRECISION, SHIFT = 8, 9, 6
LPC_BITS = 4 + 5 + ORDER * PRECISION
WARM = max(4, ORDER)
#: Longest unary part that the encoder writes; frames that would need more are stored verbatim.
MOST_UNARY = 40

# Fixed values of the format: polynomials, block sizes and sample sizes by code.
POLY8, POLY16 = 0x07, 0x8005
BLOCK_CODES = {1: 192, 2: 576, 3: 1152, 4: 2304, 5: 4608, 8: 256, 9: 512, 10: 1024, 11: 2048, 12: 4096, 13: 8192, 14: 16384, 15: 32768}
SIZE_CODES = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}


#: The code of a frame of BLOCK samples.
BLOCK_CODE = next(code for code, n in BLOCK_CODES.items() if n == BLOCK)


class FlacError(ValueError):
    pass


def _crc_table(poly: int, bits: int) -> np.ndarray:
    crc = np.arange(256, dtype=np.uint32) << (bits - 8)
    for _ in range(8):
        crc = np.where(crc >> (bits - 1) & 1, (crc << 1) ^ poly, crc << 1) & ((1 << bits) - 1)
    return crc.astype(np.uint16 if bits == 16 else np.uint8)


CRC8, CRC16 = _crc_table(POLY8, 8), _crc_table(POLY16, 16)


def crc8(data: bytes) -> int:
    crc = 0
    for b in data:
        crc = int(CRC8[crc ^ b])
    return crc


def crc16(data: bytes) -> int:
    crc = 0
    for b in data:
        crc = (crc << 8 & 0xFFFF) ^ int(CRC16[crc >> 8 ^ b])
    return crc


@lru_cache(maxsize=1)
def _crc16_at(most: int = 4096) -> np.ndarray:
    """[d, b]: what a byte b with d bytes after it adds to a CRC-16, which is linear."""
    rows = [CRC16]
    for _ in range(most - 1):
        last = rows[-1]
        rows.append((last << 8) ^ CRC16[last >> 8])
    return np.stack(rows)


def _crc16_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-16 of each data[start:end]; stretches are not empty, in order and don't overlap."""
    n = ends - starts
    if not len(n) or n.max() > 4096:
        return np.array([crc16(data[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)], dtype=np.uint16)
    at = np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())
    parts = _crc16_at()[np.repeat(ends - 1, n) - at, data[at]]
    return np.bitwise_xor.reduceat(parts, np.cumsum(n) - n)


def _coded_number(n: int) -> bytes:
    """A frame number, in the extended UTF-8 form."""
    if n < 0x80:
        return bytes([n])
    more = 1
    while n >> (6 * more + 6 - more):
        more += 1
    lead = (0xFF << (7 - more)) & 0xFF
    return bytes([lead | n >> 6 * more, *(0x80 | n >> 6 * k & 0x3F for k in range(more - 1, -1, -1))])


def _frame_header(number: int, n: int) -> bytes:
    code, extra = (BLOCK_CODE, b"") if n == BLOCK else (7, struct.pack(">H", n - 1))
    head = bytes([0xFF, 0xF8, code << 4 | 4, 0x02]) + _coded_number(number) + extra
    return head + bytes([crc8(head)])


_HEADERS: dict[tuple[int, int], bytes] = {}


def _header(number: int, n: int) -> bytes:
    found = _HEADERS.get((number, n))
    if found is None:
        found = _frame_header(number, n)
        if len(_HEADERS) < 1 << 16:
            _HEADERS[number, n] = found
    return found


def _predictors(samples: np.ndarray) -> np.ndarray:
    """[frame, ORDER] coefficients for the last samples, by the autocorrelation of each frame (Levinson and Durbin)."""
    x = samples.astype(np.float64)
    r = np.stack([np.einsum("ij,ij->i", x[:, : BLOCK - j], x[:, j:]) for j in range(ORDER + 1)], axis=1)
    a, error = np.zeros((len(x), ORDER)), r[:, 0] + 1e-9
    for i in range(ORDER):
        k = (r[:, i + 1] - (a[:, :i] * r[:, i:0:-1]).sum(axis=1)) / error
        a[:, :i] -= k[:, None] * a[:, :i][:, ::-1]
        a[:, i] = k
        error = np.maximum(error * (1 - k * k), 1e-9)
    most = 1 << (PRECISION - 1)
    return np.clip(np.rint(a * (1 << SHIFT)), -most, most - 1).astype(np.int32)


def _encode_frames(samples: np.ndarray, n: np.ndarray, numbers: np.ndarray) -> list[bytes]:
    """samples: [frame, BLOCK] with n of them in each frame, the rest zero."""
    lanes, at = len(n), np.arange(BLOCK)
    inside = at < n[:, None]
    best_sum, order, residual = np.full(lanes, np.iinfo(np.int64).max), np.zeros(lanes, np.int64), samples.copy()
    e = samples
    for o in range(3):
        if o:
            e = np.concatenate([e[:, :1], e[:, 1:] - e[:, :-1]], axis=1)
        total = (np.abs(e) * (inside & (at >= o))).sum(axis=1, dtype=np.int64)
        better = total < best_sum
        best_sum, order = np.where(better, total, best_sum), np.where(better, o, order)
        residual[better] = e[better]
    weights = _predictors(samples)
    guess = np.zeros_like(samples)
    for j in range(ORDER):
        guess[:, ORDER:] += weights[:, j, None] * samples[:, ORDER - 1 - j : BLOCK - 1 - j]
    e = samples - (guess >> SHIFT)
    total = (np.abs(e) * (inside & (at >= ORDER))).sum(axis=1, dtype=np.int64)
    # What the smaller residual saves, about, against what the coefficients cost.
    lpc = (n > 4 * ORDER) & (n * np.log2((best_sum + 1) / (total + 1)) > LPC_BITS + 8 * (ORDER - order))
    order = np.where(lpc, ORDER, order)
    residual[lpc] = e[lpc]
    extra = np.where(lpc, LPC_BITS, 0)
    coded = inside & (at >= order[:, None])
    u = np.where(coded, (residual << 1) ^ (residual >> 31), 0).astype(np.int64)
    count = np.maximum(n - order, 1)
    k = np.clip(np.floor(np.log2(np.maximum(u.sum(axis=1) / count, 1))).astype(np.int64) - 1, 0, 13)
    bits = np.full(lanes, np.iinfo(np.int64).max)
    for step in range(3):
        cost = (u >> (k + step)[:, None]).sum(axis=1) + count * (k + step + 1)
        better = cost < bits
        bits, chosen = np.where(better, cost, bits), np.where(better, k + step, chosen if step else k)
    k = chosen
    q = u >> k[:, None]
    constant = (np.where(inside, samples, samples[:, :1]) == samples[:, :1]).all(axis=1)
    verbatim = ~constant & ((bits + 10 + 8 * order + extra >= 8 * n) | (q.max(axis=1) > MOST_UNARY))
    rice = ~constant & ~verbatim
    heads = [_header(i, m) for i, m in zip(numbers.tolist(), n.tolist(), strict=True)]
    head_n = np.array([len(h) for h in heads])
    body = np.where(constant, 16, np.where(verbatim, 8 + 8 * n, 8 + 8 * order + extra + 10 + bits))
    size = head_n + (body + 7) // 8 + 2
    ends = np.cumsum(size)
    first = ends - size
    out = np.zeros(int(ends[-1]), dtype=np.uint8)
    if rice.any():
        stream = np.zeros(len(out) * 8, dtype=np.uint8)
        r = np.flatnonzero(rice)
        begin = (first + head_n)[r] * 8
        o, kk = order[r], k[r]
        start = begin + 8 + 8 * o + extra[r]
        for b in range(4):  # Rice parameter, after coding method 00 and partition order 0000
            stream[start + 6 + b] = kk >> (3 - b) & 1
        code = (u[r] & ((1 << kk) - 1)[:, None]) | (1 << kk)[:, None]
        length = np.where(coded[r], q[r] + 1 + kk[:, None], 0)
        end = (start + 10)[:, None] + np.cumsum(length, axis=1) - 1
        used = coded[r]
        code, end = code[used], end[used]
        for b in range(int(kk.max()) + 1):
            stream[end[(code >> b & 1).astype(bool)] - b] = 1
        own = lpc[r]
        fields = [(np.full(own.sum(), PRECISION - 1), 4), (np.full(own.sum(), SHIFT), 5), *((weights[r[own], j], PRECISION) for j in range(ORDER))]
        bit = (begin + 8 + 8 * o)[own]
        for value, width in fields:
            for b in range(width):
                stream[bit + b] = value >> (width - 1 - b) & 1
            bit = bit + width
        out |= np.packbits(stream)
        kind = np.where(own, 0x20 | ORDER - 1, 0x08 | o)  # linear prediction, or the fixed predictor of that order
        out[(first + head_n)[r]] = kind << 1
        for j in range(ORDER):
            w = r[o > j]
            out[(first + head_n)[w] + 1 + j] = samples[w, j].astype(np.uint8)
    for i in np.flatnonzero(constant).tolist():
        s = first[i] + head_n[i]
        out[s + 1] = samples[i, 0] & 0xFF
    for i in np.flatnonzero(verbatim).tolist():
        s = first[i] + head_n[i]
        out[s] = 0x02
        out[s + 1 : s + 1 + n[i]] = samples[i, : n[i]].astype(np.uint8)
    for i, h in enumerate(heads):
        out[first[i] : first[i] + len(h)] = np.frombuffer(h, np.uint8)
    crc = _crc16_of(out, first, ends - 2)
    out[ends - 2], out[ends - 1] = crc >> 8, crc & 0xFF
    whole = out.tobytes()
    return [whole[a:b] for a, b in zip(first.tolist(), ends.tolist(), strict=True)]


def encode(pcm: list[np.ndarray]) -> list[bytes]:
    """A FLAC stream for each array of int8 samples (none of them empty)."""
    counts = [-(-len(p) // BLOCK) for p in pcm]
    frames: list[bytes] = []
    flat = np.concatenate(pcm) if pcm else np.zeros(0, np.int8)
    n = np.concatenate([np.r_[np.full(c - 1, BLOCK), len(p) - (c - 1) * BLOCK] for c, p in zip(counts, pcm, strict=True)]) if pcm else np.zeros(0, int)
    numbers = np.concatenate([np.arange(c) for c in counts]) if pcm else n
    begin = np.cumsum(n) - n
    for a in range(0, len(n), LANES):
        part, rows = n[a : a + LANES], len(n[a : a + LANES])
        samples = np.zeros((rows, BLOCK), dtype=np.int32)
        lo, hi = begin[a], begin[a + rows - 1] + part[-1]
        samples[np.arange(BLOCK) < part[:, None]] = flat[lo:hi]
        frames += _encode_frames(samples, part, numbers[a : a + rows])
    out, at = [], 0
    for c, p in zip(counts, pcm, strict=True):
        own = frames[at : at + c]
        at += c
        sizes = [len(f) for f in own]
        md5 = hashlib.md5(p.tobytes()).digest()
        info = struct.pack(">HH", BLOCK, BLOCK) + struct.pack(">I", min(sizes))[1:] + struct.pack(">I", max(sizes))[1:]
        info += struct.pack(">Q", RATE << 44 | 0 << 41 | 7 << 36 | len(p)) + md5
        points, offset = [], 0
        for i, s in enumerate(sizes):
            points.append(struct.pack(">QQH", i * BLOCK, offset, min(BLOCK, len(p) - i * BLOCK)))
            offset += s
        table = b"".join(points)
        out.append(b"fLaC" + struct.pack(">I", len(info)) + info + struct.pack(">I", 0x83 << 24 | len(table)) + table + b"".join(own))
    return out


class Info:
    """What a stream's metadata say."""

    __slots__ = ("bits", "channels", "first", "md5", "points", "rate", "samples")

    def __init__(self, stream: bytes):
        if stream[:4] != b"fLaC":
            raise FlacError("not a FLAC stream")
        at, self.points, last, self.samples = 4, None, False, None
        while not last:
            (head,) = struct.unpack_from(">I", stream, at)
            last, kind, size = head >> 31, head >> 24 & 0x7F, head & 0xFFFFFF
            at += 4
            if kind == 0:
                (word,) = struct.unpack_from(">Q", stream, at + 10)
                self.rate, self.channels, self.bits, self.samples = word >> 44, (word >> 41 & 7) + 1, (word >> 36 & 31) + 1, word & (1 << 36) - 1
                self.md5 = stream[at + 18 : at + 34]
            elif kind == 3:
                self.points = np.frombuffer(stream, dtype=[("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")], count=size // 18, offset=at)
            at += size
        if self.samples is None:
            raise FlacError("no STREAMINFO")
        self.first = at


class _Bits:
    """A reader of bits, most significant first."""

    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, at * 8

    def read(self, n: int) -> int:
        a, b = self.at >> 3, (self.at + n + 7) >> 3
        word = int.from_bytes(self.data[a:b], "big") >> ((b << 3) - self.at - n)
        self.at += n
        if b > len(self.data):
            raise FlacError("the stream ends inside a frame")
        return word & ((1 << n) - 1)

    def signed(self, n: int) -> int:
        v = self.read(n)
        return v - (1 << n) if n and v >> (n - 1) else v

    def unary(self) -> int:
        q = 0
        while not self.read(1):
            q += 1
        return q


def _subframe(bits: _Bits, n: int, width: int) -> list[int]:
    if bits.read(1):
        raise FlacError("a subframe begins with 1")
    kind, wasted = bits.read(6), 0
    if bits.read(1):
        wasted = bits.unary() + 1
        width -= wasted
    if kind == 0:
        out = [bits.signed(width)] * n
    elif kind == 1:
        out = [bits.signed(width) for _ in range(n)]
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 8 if kind < 32 else kind - 31
        out = [bits.signed(width) for _ in range(order)]
        if kind >= 32:
            precision, shift = bits.read(4) + 1, bits.signed(5)
            weights = [bits.signed(precision) for _ in range(order)]
        else:  # fixed predictors: binomial weights
            weights, shift = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]][order], 0
        method, parts = bits.read(2), bits.read(4)
        if method > 1:
            raise FlacError("an unknown residual coding")
        field = 4 + method
        for p in range(1 << parts):
            k, m = bits.read(field), (n >> parts) - (order if p == 0 else 0)
            raw = bits.read(5) if k == (1 << field) - 1 else None
            for _ in range(m):
                if raw is None:
                    v = bits.unary() << k
                    v |= bits.read(k) if k else 0
                    r = v >> 1 ^ -(v & 1)
                else:
                    r = bits.signed(raw) if raw else 0
                out.append(r + (sum(w * out[-1 - j] for j, w in enumerate(weights)) >> shift))
    else:
        raise FlacError("a reserved kind of subframe")
    return [v << wasted for v in out] if wasted else out


def read_frame(data: bytes, at: int, info: Info) -> tuple[list[list[int]], int]:
    """Samples by channel of the frame at a byte, and the byte after it."""
    bits = _Bits(data, at)
    if bits.read(15) != 0x7FFC:
        raise FlacError("no frame here")
    bits.read(1)
    block, rate, channels, width = bits.read(4), bits.read(4), bits.read(4), bits.read(3)
    bits.read(1)
    lead = bits.read(8)
    more = max(0, 8 - (~lead & 0xFF).bit_length() - 1) if lead & 0x80 else 0
    bits.read(8 * more)
    n = bits.read(8) + 1 if block == 6 else bits.read(16) + 1 if block == 7 else BLOCK_CODES[block]
    bits.read({12: 8, 13: 16, 14: 16}.get(rate, 0))
    end = bits.at >> 3
    if bits.read(8) != crc8(data[at:end]):
        raise FlacError("a frame header's CRC-8 is wrong")
    width = SIZE_CODES.get(width, info.bits)
    count = channels + 1 if channels < 8 else 2
    got = [_subframe(bits, n, width + ((channels, c) in ((8, 1), (9, 0), (10, 1)))) for c in range(count)]
    if channels == 8:  # left, difference
        got[1] = [a - b for a, b in zip(*got, strict=True)]
    elif channels == 9:  # difference, right
        got[0] = [a + b for a, b in zip(*got, strict=True)]
    elif channels == 10:  # mean, difference
        sides = [((m << 1 | s & 1), s) for m, s in zip(*got, strict=True)]
        got = [[(m + s) >> 1 for m, s in sides], [(m - s) >> 1 for m, s in sides]]
    end = (bits.at + 7) >> 3
    if data[end : end + 2] != struct.pack(">H", crc16(data[at:end])):
        raise FlacError("a frame's CRC-16 is wrong")
    return got, end + 2


def read_samples(stream: bytes, first: int, count: int) -> list[list[int]]:
    """Samples first, first + 1, ... by channel; begins at the last seek point before them."""
    info = Info(stream)
    at, sample = info.first, 0
    if info.points is not None and len(info.points):
        real = info.points[info.points["sample"] != 0xFFFFFFFFFFFFFFFF]
        if (i := int(np.searchsorted(real["sample"], first, "right")) - 1) >= 0:
            at, sample = at + int(real["offset"][i]), int(real["sample"][i])
    out: list[list[int]] = [[] for _ in range(info.channels)]
    last = min(first + count, info.samples)
    while sample < last:
        got, at = read_frame(stream, at, info)
        n = len(got[0])
        for c, x in enumerate(got):
            out[c] += x[max(0, first - sample) : max(0, last - sample)]
        sample += n
    return out


def _decode_frames(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Samples [frame, BLOCK] of mono 8-bit frames with up to BLOCK samples, and which frames are of another make."""
    lanes = len(n)
    at = lambda i: data[starts + i].astype(np.int64)
    odd = (at(0) != 0xFF) | (at(1) != 0xF8) | (at(3) != 0x02) | (n > BLOCK)
    block, rate, lead = at(2) >> 4, at(2) & 15, at(4)
    more = np.select([lead < 0x80, lead < 0xE0, lead < 0xF0], [0, 1, 2], 3)
    odd |= (lead >= 0xF8) | (rate >= 12) | ~((block == BLOCK_CODE) | (block == 7))
    head = 5 + more + 2 * (block == 7)
    odd |= ends - starts < head + 5
    crc = np.zeros(lanes, dtype=np.uint8)
    for i in range(10):
        crc = np.where(i < head, CRC8[crc ^ data[np.minimum(starts + i, len(data) - 1)]], crc)
    size = np.where(block == BLOCK_CODE, BLOCK, at(5 + more) * 256 + data[starts + 6 + more] + 1)
    odd |= size != n
    if (crc != data[starts + head])[~odd].any():
        raise FlacError("a frame header's CRC-8 is wrong")
    got = _crc16_of(data, starts, ends - 2)
    if (got != data[ends - 2].astype(np.uint16) << 8 | data[ends - 1])[~odd].any():
        raise FlacError("a frame's CRC-16 is wrong")
    kind = data[starts + head + 1]
    out = np.zeros((lanes, BLOCK), dtype=np.int32)
    constant, verbatim, fixed = ~odd & (kind == 0), ~odd & (kind == 2), ~odd & (kind & 1 == 0) & (kind >> 1 >= 8) & (kind >> 1 <= 12)
    linear = ~odd & (kind == (0x20 | ORDER - 1) << 1)
    odd |= ~(constant | verbatim | fixed | linear)
    body = starts + head + 2
    out[constant] = data[body[constant]].astype(np.int8)[:, None]
    for i in np.flatnonzero(verbatim).tolist():
        out[i, : n[i]] = data[body[i] : body[i] + n[i]].view(np.int8)
    f = np.flatnonzero(fixed | linear)
    if len(f):
        lpc = linear[f]
        order = np.where(lpc, ORDER, (kind[f] >> 1).astype(np.int64) - 8)
        warm = np.zeros((len(f), WARM), dtype=np.int64)
        for j in range(WARM):
            warm[:, j] = np.where(order > j, data[np.minimum(body[f] + j, len(data) - 1)].astype(np.int8), 0)

        def field(bit: np.ndarray, width: int) -> np.ndarray:
            """width bits (16 at most) from each bit on."""
            at, word = bit >> 3, np.zeros(len(bit), dtype=np.int64)
            for j in range(3):
                word = word << 8 | data[np.minimum(at + j, len(data) - 1)]
            return word >> (24 - width - (bit & 7)) & ((1 << width) - 1)

        s = (body[f] + order) * 8
        weights = np.zeros((len(f), ORDER), dtype=np.int64)
        for j in range(ORDER):
            w = field(s + 9 + j * PRECISION, PRECISION)
            weights[:, j] = w - (w >> (PRECISION - 1) << PRECISION)
        own = ~lpc | ((field(s, 4) == PRECISION - 1) & (field(s + 4, 5) == SHIFT))
        s = s + np.where(lpc, LPC_BITS, 0)
        first = field(s, 10)
        k = first & 15
        plain = (first >> 4 == 0) & (k < 15) & own  # Rice codes in one partition
        odd[f[~plain]] = True
        f, order, warm, s, k, lpc, weights = (x[plain] for x in (f, order, warm, s, k, lpc, weights))
    if len(f):
        by = np.argsort(-n[f], kind="stable")
        f, order, warm, s, k, lpc, weights = (x[by] for x in (f, order, warm, s, k, lpc, weights))
        lo = int(s.min()) >> 3
        padded = np.concatenate([data[lo : int(ends[f].max())], np.zeros(16, np.uint8)])
        words = np.zeros(len(padded) - 8, dtype=np.uint64)  # the 64 bits from each byte on
        for j in range(8):
            words |= padded[j : len(padded) - 8 + j].astype(np.uint64) << np.uint64(56 - 8 * j)
        bit = s - lo * 8 + 10
        e = np.zeros((BLOCK, len(f)), dtype=np.int64)
        long = np.zeros(len(f), dtype=bool)
        last = len(words) - 1
        one = np.uint64(1)
        ku, rest = k.astype(np.uint64), (63 - k).astype(np.uint64)
        falling = -n[f]
        least = int(order.min())
        for t in range(least, int(n[f[0]])):
            m = int(np.searchsorted(falling, -t, "left"))  # lanes with more than t samples
            b = bit[:m]
            x = words[np.minimum(b >> 3, last)] << (b & 7).astype(np.uint64)
            q = 1075 - ((x >> np.uint64(11)).astype(np.float64).view(np.int64) >> 52)  # leading zeros of 53 bits
            bad = q > MOST_UNARY
            if bad.any():
                long[:m] |= bad & (order[:m] <= t)
                q = np.minimum(q, MOST_UNARY)
            qu = q.astype(np.uint64)
            v = (q << k[:m]) | ((x << (qu + one)) >> one >> rest[:m]).astype(np.int64)
            r = (v >> 1) ^ -(v & 1)
            if t < WARM:
                on = order[:m] <= t
                e[t, :m] = np.where(on, r, 0)
                bit[:m] += np.where(on, q + 1 + k[:m], 0)
            else:
                e[t, :m] = r
                bit[:m] += q + 1 + k[:m]
        # The samples are the order-th running sum of the residual; the warm-up's own differences start it.
        for o in range(int(order.max()) + 1):
            lane = (order == o) & ~lpc
            part = e[:, lane]
            w = warm[lane].T.copy()
            for j in range(o):
                d = w[: o].copy()
                for _ in range(o):
                    d = np.concatenate([d[:1], d[1:] - d[:-1]])
                part[j] = d[j]
            for _ in range(o):
                part = np.cumsum(part, axis=0)
            out[f[lane]] = part.T
        if lpc.any():
            part, w = e[:, lpc], weights[lpc].T
            part[:ORDER] = warm[lpc, :ORDER].T
            for t in range(ORDER, int(n[f[lpc]].max())):
                part[t] += (w * part[t - ORDER : t][::-1]).sum(axis=0) >> SHIFT
            out[f[lpc]] = part.T
        odd[f[long]] = True
    return out, odd


def decode(streams: list[bytes]) -> list[np.ndarray]:
    """The samples of each mono 8-bit stream as int8; every check sum is verified."""
    infos = [Info(s) for s in streams]
    out: list[list[np.ndarray]] = [[] for _ in streams]
    lanes: list[tuple[int, int, int, int]] = []  # stream, first byte, byte after, samples

    def run() -> None:
        data = np.frombuffer(b"".join(streams[i][a:b] for i, a, b, _ in lanes), dtype=np.uint8)
        size = np.array([b - a for _, a, b, _ in lanes])
        ends = np.cumsum(size)
        n = np.array([m for *_, m in lanes])
        samples, odd = _decode_frames(data, ends - size, ends, n)
        narrow = samples.astype(np.int8)
        for j, (i, a, _, m) in enumerate(lanes):
            out[i].append(np.array(read_frame(streams[i], a, infos[i])[0][0], dtype=np.int8) if odd[j] else narrow[j, :m])
        lanes.clear()

    for i, (s, info) in enumerate(zip(streams, infos, strict=True)):
        if info.channels != 1 or info.bits != 8:
            raise FlacError("not mono 8-bit")
        if info.points is None or int(info.points["n"].astype(np.int64).sum()) != info.samples:  # no point for each frame
            at, got = info.first, 0
            while got < info.samples:
                part, at = read_frame(s, at, info)
                out[i].append(np.array(part[0], dtype=np.int8))
                got += len(part[0])
            continue
        begin = (info.points["offset"].astype(np.int64) + info.first).tolist()
        for a, b, m in zip(begin, [*begin[1:], len(s)], info.points["n"].tolist(), strict=True):
            lanes.append((i, a, b, m))
            if len(lanes) == LANES:
                run()
    if lanes:
        run()
    whole = [np.concatenate(parts) for parts in out]
    for info, pcm in zip(infos, whole, strict=True):
        if len(pcm) != info.samples or (any(info.md5) and hashlib.md5(pcm.tobytes()).digest() != info.md5):
            raise FlacError("the MD5 of the samples is wrong")
    return whole
