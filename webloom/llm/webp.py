"""Lossless WebP (VP8L) after the public bitstream specification: decoder, and an encoder for stored samples."""

from __future__ import annotations

import struct
from functools import cache, cached_property, lru_cache

import numpy as np

# Fixed values of the bitstream specification.
SIGNATURE = 0x2F
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
HASH_MULTIPLIER = 0x1E35A7BD
PREDICTOR, CROSS_COLOR, SUBTRACT_GREEN, COLOR_INDEXING = range(4)
MAX_SIDE = 16384

#: Short distance codes: neighbours up to 8 columns and 7 rows away, nearest first.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))


class Bits:
    """Reads bits, the least of a byte first."""

    def __init__(self, data: bytes, at: int = 0) -> None:
        self.data, self.at, self.end = data, at * 8, len(data) * 8

    def read(self, n: int) -> int:
        if not n:
            return 0
        a = self.at
        if a + n > self.end:
            raise ValueError("the stream ends early")
        self.at = a + n
        return int.from_bytes(self.data[a >> 3 : (a + n + 7) >> 3], "little") >> (a & 7) & ((1 << n) - 1)


#: The 16 bits of a number in reverse.
REVERSED = (np.packbits(np.unpackbits(np.arange(1 << 16, dtype=">u2").view(np.uint8).reshape(-1, 2), axis=1)[:, ::-1], axis=1).view(">u2").ravel()).astype(np.int64)


def code_words(lengths: np.ndarray) -> np.ndarray:
    """The canonical code of each symbol (by length, then symbol), its first bit lowest, as the stream holds it."""
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    own = lengths[order]
    out = np.zeros(len(lengths), np.int64)
    # Each code follows the one before it, counted in units of the longest code's bits.
    out[order] = REVERSED[np.cumsum(1 << (16 - own)) - (1 << (16 - own))] if len(order) else 0
    return out


@cache
def _reversed(n: int) -> np.ndarray:
    """The numbers of ``n`` bits in reverse."""
    return REVERSED[: 1 << n] >> (16 - n)


#: Least value and extra bits of each prefix of a length or distance, and a mask of those bits.
BASE = np.array([p if p < 4 else (2 + (p & 1)) << ((p - 2) >> 1) for p in range(40)]) + 1
EXTRA = np.array([0 if p < 4 else (p - 2) >> 1 for p in range(40)])
EXTRA_MASK = (1 << EXTRA) - 1
#: A reference's symbol and length take at most 26 bits, to which this is added.
REFERENCE = 32
GREEN_MORE = np.concatenate([np.zeros(256, np.int64), EXTRA[:24] + REFERENCE])


class Prefix:
    """A canonical prefix code; its table by the next ``width`` bits gives symbol * 16 + length and is made on first use."""

    def __init__(self, lengths: np.ndarray | None, lone: int | None = None) -> None:
        self.lengths = lengths
        self.used = np.flatnonzero(lengths) if lone is None else [lone]
        if len(self.used) == 0:
            raise ValueError("an empty prefix code")
        self.width = 0
        if len(self.used) > 1:
            own = lengths[self.used]
            self.width = int(own.max())
            if int((1 << (self.width - own)).sum()) != 1 << self.width:
                raise ValueError("a prefix code that isn't complete")

    @cached_property
    def order(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols in the order of their codes, their lengths, and by the next ``width`` bits which of them it is."""
        if not self.width:
            return np.array(self.used[:1], np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64)
        own = self.lengths[self.used]
        by_length = own.argsort(kind="stable")
        used, own = self.used.take(by_length), own.take(by_length)
        return used, own, np.arange(len(used)).repeat(1 << (self.width - own)).take(_reversed(self.width))

    @cached_property
    def array(self) -> np.ndarray:
        used, own, which = self.order
        return (used * 16 + own).take(which)

    @cached_property
    def green_steps(self) -> np.ndarray:
        """By the next bits, those of a literal; for a reference those of its symbol and length and REFERENCE."""
        used, own, which = self.order
        return (own + GREEN_MORE.take(used)).take(which)

    @cached_property
    def far_steps(self) -> np.ndarray:
        """By the next bits, those of a distance with its extra bits."""
        used, own, which = self.order
        return (own + EXTRA.take(used)).take(which)

    @cached_property
    def table(self) -> list[int]:
        return self.array.tolist()

    @cached_property
    def pieces(self) -> dict[int, tuple]:
        """What :func:`_lengths_of` has found by the next PIECE bits."""
        return {}

    def read(self, bits: Bits) -> int:
        if not self.width:
            return int(self.used[0])
        a = bits.at
        entry = self.table[int.from_bytes(bits.data[a >> 3 : (a >> 3) + 3], "little") >> (a & 7) & ((1 << self.width) - 1)]
        bits.at = a + (entry & 15)
        if bits.at > bits.end:
            raise ValueError("the stream ends early")
        return entry >> 4


@lru_cache(maxsize=16)
def _outer_code(k: int, known: int) -> Prefix:
    """The code of code lengths, by its ``k`` lengths of three bits."""
    outer = np.zeros(19, np.int64)
    outer[list(CODE_LENGTH_ORDER[:k])] = [known >> i & 7 for i in range(0, 3 * k, 3)]
    return Prefix(outer)


#: Bits of a stream of code lengths that are read in one step.
PIECE = 14


def _lengths_of(code: Prefix, held: int) -> tuple[int, list[int], int, int]:
    """The whole symbols in the PIECE bits held, up to one that repeats what stands before them: bits, code lengths, number of symbols, the last length above 0."""
    found: list[int] = []
    at = count = last = 0
    while True:
        entry = code.table[held >> at & (1 << code.width) - 1]
        symbol, end = entry >> 4, at + (entry & 15)
        k = {17: 3, 18: 7}.get(symbol, 0)
        if symbol == 16 or end == at or end + k > PIECE:
            break
        if symbol < 16:
            found.append(symbol)
            last = symbol or last
        else:
            found += [0] * ((3 if symbol == 17 else 11) + (held >> end & (1 << k) - 1))
        at = end + k
        count += 1
    code.pieces[held] = at, found, count, last
    return at, found, count, last


def read_prefix(bits: Bits, size: int) -> Prefix:
    """One prefix code over ``size`` symbols: a simple one or one with coded lengths. What is written often is told by its bits and not read again."""
    if size == len(FAR_LENGTHS):
        value, n, code, _ = usual_distances()
        if bits.at + n <= bits.end and int.from_bytes(bits.data[bits.at >> 3 : (bits.at + n + 7) >> 3], "little") >> (bits.at & 7) & ((1 << n) - 1) == value:
            bits.at += n
            return code
    if bits.at + 11 <= bits.end:
        few = int.from_bytes(bits.data[bits.at >> 3 : (bits.at >> 3) + 3], "little") >> (bits.at & 7)
        if few & 7 == 0b101 and (few >> 3 & 255) < size:  # one symbol of eight bits
            bits.at += 11
            return Prefix(None, few >> 3 & 255)
    if bits.read(1):
        two = bits.read(1)
        symbols = [bits.read(8 if bits.read(1) else 1)]
        symbols += [bits.read(8)] if two else []
        if max(symbols) >= size:
            raise ValueError("a symbol beyond its alphabet")
        if len(set(symbols)) == 1:
            return Prefix(None, symbols[0])
        lengths = np.zeros(size, np.int64)
        lengths[symbols] = 1
        return Prefix(lengths)
    k = 4 + bits.read(4)
    code = _outer_code(k, bits.read(3 * k))
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    # All of the coded lengths lie in the next 14 bits a symbol.
    held, at = int.from_bytes(bits.data[bits.at >> 3 : (bits.at >> 3) + 2 * size + 8], "little"), bits.at & 7
    start, table, mask, pieces = bits.at - at, code.table, (1 << code.width) - 1, code.pieces
    found: list[int] = []
    before = 8
    while len(found) < size and left:
        window = held >> at & (1 << PIECE) - 1
        n, some, count, last = pieces.get(window) or _lengths_of(code, window)
        if 0 < count <= left and len(found) + len(some) <= size:
            found += some
            at, left, before = at + n, left - count, last or before
            continue
        left -= 1
        entry = table[held >> at & mask]
        at += entry & 15
        symbol = entry >> 4
        if symbol < 16:
            found.append(symbol)
            before = symbol or before
            continue
        value, least, k = ((before, 3, 2), (0, 3, 3), (0, 11, 7))[symbol - 16]
        found += [value] * (least + (held >> at & ((1 << k) - 1)))
        at += k
    bits.at = start + at
    if bits.at > bits.end:
        raise ValueError("the stream ends early")
    if len(found) > size:
        raise ValueError("code lengths beyond the alphabet")
    lengths = np.zeros(size, np.int64)
    lengths[: len(found)] = found
    return Prefix(lengths)


def _amount(bits: Bits, prefix: int) -> int:
    """A length or distance of its prefix and extra bits."""
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


#: Bytes of a stream whose bit positions are worked out together.
WINDOW = 1 << 17
EIGHT, PLACES = np.arange(8), np.arange((WINDOW + 16) * 8)


def _vector(bits: Bits, codes: list[Prefix], n: int, width: int) -> np.ndarray | None:
    """``n`` pixels of one group without a colour cache: every bit position's symbol and successor at once, then the chain from the first.

    At each bit position of a window the green code's table gives a symbol; for a literal the other
    channels' tables are asked where it ends, for a back-reference length, distance code and
    extra bits are read behind it. So the successor of every position is known before the real
    chain of symbols is followed, which is then a walk over integers. None if the green code has one
    symbol that takes no bits and isn't a literal.
    """
    rest = [c for c in (codes[1], codes[2], codes[3]) if c.width]
    if not codes[0].width and not rest:
        if codes[0].used[0] > 255:
            return None
        return _filled(codes, np.zeros(n, np.int64) + codes[0].used[0], [None] * 3)
    raw = np.frombuffer(bits.data, np.uint8)
    out, done = bytearray(4 * n), 0
    while done < n:
        base = bits.at >> 3
        part = raw[base : base + WINDOW + 16]
        size = len(part)
        b = np.concatenate([part, np.zeros(8, np.uint8)]).astype(np.int64)
        word = b[: size + 4] | b[1 : size + 5] << 8 | b[2 : size + 6] << 16 | b[3 : size + 7] << 24

        def peek(at: np.ndarray, k: np.ndarray | int, word: np.ndarray = word) -> np.ndarray:
            return word[at >> 3] >> (at & 7) & ((1 << k) - 1)

        last = size * 8
        every = word[:size, None] >> EIGHT
        every &= (1 << codes[0].width) - 1
        entry = codes[0].array[every.ravel()]
        to = entry & 15
        to += PLACES[:last]
        for c in rest:
            to += c.array[peek(np.minimum(to, last), c.width)] & 15
        ref = np.flatnonzero(entry > 4095)
        far_of, long_of = ref, ref
        if len(ref):
            k = (entry[ref] >> 4) - 256
            e = np.maximum((k - 2) >> 1, 0)
            at = np.minimum(ref + (entry[ref] & 15), last)
            long_of = np.where(k < 4, k, (2 + (k & 1)) << e) + peek(at, e) + 1
            at = np.minimum(at + e, last)
            d = codes[4].array[peek(at, codes[4].width)]
            at = np.minimum(at + (d & 15), last)
            d >>= 4
            e = np.maximum((d - 2) >> 1, 0)
            far_of = np.where(d < 4, d, (2 + (d & 1)) << e) + peek(at, e) + 1
            to[ref] = at + e
        stop = last if base + size >= len(raw) else WINDOW * 8
        one = np.append(to, last)
        np.minimum(one, last, out=one)
        two = one[one]
        four, at, hops = memoryview(two[two]), bits.at & 7, []
        while at < stop:  # the walk takes four symbols a step; those between are filled in after it
            hops.append(at)
            at = four[at]
        hops = np.array(hops, np.int64)
        path = np.stack([hops, one[hops], two[hops], one[two[hops]]], 1).ravel()
        path = path[: int(np.searchsorted(path, stop))]
        p = int(to[path[-1]]) if len(path) else bits.at & 7
        met = entry[path]
        jump = met > 4095
        length = np.ones(len(path), np.int64)
        which = np.searchsorted(ref, path[jump])
        length[jump] = long_of[which]
        ends = np.cumsum(length)
        m = int(np.searchsorted(ends, n - done)) + 1
        if m <= len(path):
            path, ends, p, met, jump, length = path[:m], ends[:m], int(to[path[m - 1]]), met[:m], jump[:m], length[:m]
            which = which[: int(jump.sum())]
            if ends[-1] != n - done:
                raise ValueError("a reference outside the image")
        elif stop == last:
            raise ValueError("the stream ends early")
        if p > last:
            raise ValueError("the stream ends early")
        begin = done + ends - length
        plain = ~jump
        values, at = [], path[plain] + (met[plain] & 15) if rest else None
        for c in codes[1:4]:
            if c.width:
                got = c.array[peek(at, c.width)]
                values.append(got >> 4)
                at = at + (got & 15)
            else:
                values.append(None)
        np.frombuffer(out, "<u4")[begin[plain]] = _filled(codes, met[plain] >> 4, values)
        if len(which):
            far, start = far_of[which], begin[jump]
            near = far <= 120
            if near.any():
                x, y = np.array(NEAR)[far[near] - 1].T
                far[near] = np.maximum(1, x + y * width)
            far[~near] -= 120
            if (far > start).any():
                raise ValueError("a reference outside the image")
            for a, l, d in zip((start * 4).tolist(), (length[jump] * 4).tolist(), (far * 4).tolist(), strict=True):
                out[a : a + l] = out[a - d : a - d + l] if d >= l else (out[a - d : a] * (l // d + 1))[:l]
        done += int(ends[-1]) if len(ends) else 0
        bits.at = base * 8 + p
    return np.frombuffer(out, "<u4").copy()


NEAR_XY = np.array(NEAR)
SHIFTS = np.tile(EIGHT, WINDOW + 16)
#: More bits than any symbol takes.
SLACK = 64


def _one_channel(bits: Bits, codes: list[Prefix], n: int, width: int) -> np.ndarray:
    """:func:`_vector` where red, blue and alpha take no bits, as in all that :func:`encode_grey` writes: a symbol a sample or reference, a byte a pixel.

    Only successors are worked out for every bit position; values are read for the positions of the chain. Gives planes like :func:`_planes`.
    """
    green, mask, far_code, far_mask = codes[0].array, (1 << codes[0].width) - 1, codes[4].array, (1 << codes[4].width) - 1
    step, far_step = codes[0].green_steps, codes[4].far_steps
    out, done = bytearray(n), 0
    pixels = np.frombuffer(out, np.uint8)
    while done < n:
        base = bits.at >> 3
        part = bits.data[base : base + WINDOW + 16]
        size = len(part)
        last = size * 8
        word = np.ndarray((size + 8,), "<i8", part + bytes(16), strides=(1,)).astype(np.int64)
        every = word[:size].repeat(8)
        every >>= SHIFTS[:last]
        every &= mask
        one = np.empty(last + SLACK, np.int64)
        one[last:] = last
        to = one[:last]
        step.take(every, out=to, mode="clip")
        ref = (to >= REFERENCE).nonzero()[0]
        to += PLACES[:last]
        at = to.take(ref)
        at -= REFERENCE
        held = word.take(at >> 3)
        held >>= at & 7
        held &= far_mask
        at += far_step.take(held)
        to[ref] = at
        two = one.take(one)
        four = memoryview(two.take(two))
        stop, at, hops = last if base + size >= len(bits.data) else WINDOW * 8, bits.at & 7, []
        push = hops.append
        while at < stop:  # the walk takes four symbols a step; those between are filled in after it
            push(at)
            at = four[at]
        path = np.empty((len(hops), 4), np.int64)
        path[:, 0] = hops
        path[:, 1] = one.take(path[:, 0])
        path[:, 2] = two.take(path[:, 0])
        path[:, 3] = one.take(path[:, 2])
        path = path.ravel()
        path = path[: int(path.searchsorted(stop))]
        met = green.take(every.take(path))
        jump = (met > 4095).nonzero()[0]
        sign = met[jump]
        at = path[jump] + (sign & 15)
        held = word.take(at >> 3) >> (at & 7)
        k = (sign >> 4) - 256
        long = BASE.take(k) + (held & EXTRA_MASK.take(k))
        length = np.ones(len(path), np.int64)
        length[jump] = long
        ends = length.cumsum()
        m = int(ends.searchsorted(n - done)) + 1
        if m <= len(path):
            path, ends, met, length = path[:m], ends[:m], met[:m], length[:m]
            jump = jump[: int(jump.searchsorted(m))]
            held, k, long = held[: len(jump)], k[: len(jump)], long[: len(jump)]
            if ends[-1] != n - done:
                raise ValueError("a reference outside the image")
        elif stop == last:
            raise ValueError("the stream ends early")
        p = int(one[path[-1]]) if len(path) else bits.at & 7
        if p > last:
            raise ValueError("the stream ends early")
        begin = ends - length
        begin += done
        met >>= 4
        pixels[begin] = met  # where a reference starts too: it is copied over below
        if len(jump):
            held >>= EXTRA.take(k)
            d = far_code.take(held & far_mask)
            held >>= d & 15
            d >>= 4
            far, start = BASE.take(d) + (held & EXTRA_MASK.take(d)), begin[jump]
            near = (far <= 120).nonzero()[0]
            far -= 120
            if len(near):
                x, y = NEAR_XY[far[near] + 119].T
                far[near] = np.maximum(1, x + y * width)
            if (far > start).any():
                raise ValueError("a reference outside the image")
            for a, l, d in zip(start.tolist(), long.tolist(), far.tolist(), strict=True):
                out[a : a + l] = out[a - d : a - d + l] if d >= l else (out[a - d : a] * (l // d + 1))[:l]
        done += int(ends[-1]) if len(ends) else 0
        bits.at = base * 8 + p
    argb = np.empty((4, n), np.uint8)
    argb[1] = pixels
    for i, c in ((0, 2), (2, 1), (3, 3)):
        argb[i] = codes[c].used[0]
    return argb.T


def _filled(codes: list[Prefix], green: np.ndarray, values: list) -> np.ndarray:
    """Pixels of green values and of red, blue and alpha ones, where a code without bits stands for its one symbol."""
    red, blue, alpha = (np.int64(c.used[0]) if v is None else v for c, v in zip(codes[1:4], values, strict=True))
    return (green << 8 | red << 16 | blue | alpha << 24).astype("<u4")


def _image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image as channels blue, green, red, alpha in reading order."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("a colour cache that is too large")
    block, groups_of, n_groups = 0, None, 1
    if main and bits.read(1):
        block = bits.read(3) + 2
        gw = -(-width >> block)
        which = _image(bits, gw, -(-height >> block), False).astype(int)
        groups_of = (which[:, 1] | which[:, 2] << 8).tolist()
        n_groups = max(groups_of) + 1
    sizes = (256 + 24 + ((1 << cache_bits) if cache_bits else 0), 256, 256, 256, 40)
    groups = [[read_prefix(bits, s) for s in sizes] for _ in range(n_groups)]
    n = width * height
    if not cache_bits and groups_of is None:
        if groups[0][0].width and not any(c.width for c in groups[0][1:4]):
            return _planes(_one_channel(bits, groups[0], n, width))
        if (fast := _vector(bits, groups[0], n, width)) is not None:
            return _planes(fast)
    out = [0] * n
    cache, shift = [0] * (1 << cache_bits), 32 - cache_bits
    at, g = 0, groups[0]
    while at < n:
        if groups_of is not None:
            g = groups[groups_of[(at // width >> block) * gw + (at % width >> block)]]
        s = g[0].read(bits)
        if s < 256:
            out[at] = s << 8 | g[1].read(bits) << 16 | g[2].read(bits) | g[3].read(bits) << 24
            fresh, at = at, at + 1
        elif s < 280:
            length = _amount(bits, s - 256)
            d = _amount(bits, g[4].read(bits))
            if d <= 120:
                x, y = NEAR[d - 1]
                d = max(1, x + y * width)
            else:
                d -= 120
            if d > at or at + length > n:
                raise ValueError("a reference outside the image")
            fresh = at
            for at in range(at, at + length):
                out[at] = out[at - d]
            at += 1
        else:
            out[at] = cache[s - 280]
            fresh, at = at, at + 1
        if cache_bits:
            for p in out[fresh:at]:
                cache[(HASH_MULTIPLIER * p & 0xFFFFFFFF) >> shift] = p
    return _planes(np.array(out, np.uint32))


def _planes(argb: np.ndarray) -> np.ndarray:
    """(n, 4) channels blue, green, red, alpha of numbers; what has that shape stays."""
    return argb if argb.ndim == 2 else argb.astype("<u4", copy=False).view(np.uint8).reshape(-1, 4)


def predict(mode: int, left: np.ndarray, top: np.ndarray, top_right: np.ndarray, top_left: np.ndarray) -> np.ndarray:
    """One of the 14 predictors on channel values; the two numbers left over are black, like 0."""
    l, t, r, c = (x.astype(np.int32) for x in (left, top, top_right, top_left))
    mean = lambda a, b: (a + b) >> 1
    if mode == 11:
        return l if np.abs(t - c).sum() < np.abs(l - c).sum() else t
    if mode == 12:
        return np.clip(l + t - c, 0, 255)
    if mode == 13:
        a = mean(l, t)
        d = a - c
        return np.clip(a + np.where(d < 0, -(-d >> 1), d >> 1), 0, 255)
    return {
        14: lambda: np.array([0, 0, 0, 255]), 15: lambda: np.array([0, 0, 0, 255]), 0: lambda: np.array([0, 0, 0, 255]), 1: lambda: l, 2: lambda: t, 3: lambda: r, 4: lambda: c, 5: lambda: mean(mean(l, r), t), 6: lambda: mean(l, c),
        7: lambda: mean(l, t), 8: lambda: mean(c, t), 9: lambda: mean(t, r), 10: lambda: mean(mean(l, c), mean(t, r)),
    }[mode]()


def _predicted(values: np.ndarray, modes: np.ndarray, width: int, height: int, bits: int, sign: int) -> np.ndarray:
    """Adds (sign 1) or subtracts (-1) the prediction from pixels already known; ``values`` of shape (height * width, 4)."""
    source = values.astype(np.int32)
    known = source if sign < 0 else source.copy()
    out = source.copy() if sign < 0 else known
    bw = -(-width >> bits)
    for i in range(height * width):
        y, x = divmod(i, width)
        if i == 0:
            p = np.array([0, 0, 0, 255])
        elif y == 0:
            p = known[i - 1]
        elif x == 0:
            p = known[i - width]
        else:
            p = predict(int(modes[(y >> bits) * bw + (x >> bits)]), known[i - 1], known[i - width], known[i - width + 1], known[i - width - 1])
        out[i] = (source[i] + sign * p) & 255
    return out.astype(np.uint8)


def _crossed(values: np.ndarray, elements: np.ndarray, width: int, height: int, bits: int, sign: int) -> np.ndarray:
    """Adds or takes away what red and blue owe to green and red."""
    y, x = np.divmod(np.arange(width * height), width)
    e = elements[(y >> bits) * -(-width >> bits) + (x >> bits)].view(np.int8).astype(np.int32)
    v = values.astype(np.int32)
    signed = lambda a: a.astype(np.uint8).view(np.int8).astype(np.int32)
    green = signed(v[:, 1])
    red = (v[:, 2] + sign * (e[:, 0] * green >> 5)) & 255
    of_red = signed(red if sign > 0 else v[:, 2])
    blue = (v[:, 0] + sign * ((e[:, 1] * green >> 5) + (e[:, 2] * of_red >> 5))) & 255
    out = values.copy()
    out[:, 0], out[:, 2] = blue, red
    return out


def _greened(values: np.ndarray, sign: int) -> np.ndarray:
    """Adds (sign 1) or takes away (-1) green from red and blue, in bytes that wrap around."""
    out = values.copy("K")
    for c in (0, 2):
        out[:, c] = values[:, c] + values[:, 1] if sign > 0 else values[:, c] - values[:, 1]
    return out


def _pack_bits(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def _stream(data: bytes) -> bytes:
    """The VP8L chunk of a simple or an extended file."""
    if len(data) < 20 or data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP")
    at = 12
    while at + 8 <= len(data):
        size = struct.unpack_from("<I", data, at + 4)[0]
        if data[at : at + 4] == b"VP8L":
            return data[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("not a lossless WebP")


def decode(data: bytes) -> np.ndarray:
    """Pixels (height, width, 4) as red, green, blue, alpha."""
    bits = Bits(_stream(data))
    if bits.read(8) != SIGNATURE:
        raise ValueError("no VP8L signature")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("an unknown version")
    full, steps = width, []
    while bits.read(1):
        kind = bits.read(2)
        if kind in (s[0] for s in steps):
            raise ValueError("a transform twice")
        if kind in (PREDICTOR, CROSS_COLOR):
            block = bits.read(3) + 2
            steps.append((kind, width, block, _image(bits, -(-width >> block), -(-height >> block), False)))
        elif kind == SUBTRACT_GREEN:
            steps.append((kind, width, 0, None))
        else:
            n = bits.read(8) + 1
            table = np.cumsum(_image(bits, n, 1, False), axis=0, dtype=np.uint8)
            steps.append((kind, width, n, table))
            width = -(-width >> _pack_bits(n))
    v = _image(bits, width, height, True)
    for kind, w, arg, extra in reversed(steps):
        if kind == PREDICTOR:
            v = _predicted(v, extra[:, 1], w, height, arg, 1)
        elif kind == CROSS_COLOR:
            v = _crossed(v, extra, w, height, arg, 1)
        elif kind == SUBTRACT_GREEN:
            v = _greened(v, 1)
        else:
            k = _pack_bits(arg)
            index = v[:, 1].reshape(height, -1)
            if k:
                index = np.stack([index >> (j << (3 - k)) & ((1 << (1 << (3 - k))) - 1) for j in range(1 << k)], axis=2).reshape(height, -1)[:, :w]
            table = np.zeros((256, 4), np.uint8)
            table[: len(extra)] = extra
            v = table[index.ravel()]
    out = np.empty((4, height, full), np.uint8)  # a channel lies in one piece
    for i, c in enumerate((2, 1, 0, 3)):
        out[i] = v[:, c].reshape(height, full)
    return out.transpose(1, 2, 0)


class Writer:
    """Writes bits, the least of a byte first."""

    def __init__(self) -> None:
        self.parts: list[np.ndarray] = []
        self.held, self.size = 0, 0

    def put(self, value: int, n: int) -> None:
        self.held |= value << self.size
        self.size += n
        if self.size > 4096:
            self.flush()

    def flush(self) -> None:
        if self.size:
            raw = np.frombuffer(self.held.to_bytes((self.size + 7) // 8, "little"), np.uint8)
            self.parts.append(np.unpackbits(raw, count=self.size, bitorder="little"))
            self.held, self.size = 0, 0

    def words(self, raw: np.ndarray, size: int) -> None:
        """The first ``size`` bits of 64-bit words."""
        self.flush()
        self.parts.append(np.unpackbits(raw.astype("<u8").view(np.uint8), count=size, bitorder="little"))

    def done(self) -> bytes:
        self.flush()
        return np.packbits(np.concatenate(self.parts), bitorder="little").tobytes()


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Huffman lengths of at most ``limit``; counts are halved until they fit. A lone symbol gets 1."""
    counts = counts.astype(np.int64)
    lengths = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    while True:
        # Leaves by weight, then inner nodes as they are made: both are in order, so the two least are at the two fronts.
        leaves = used[np.argsort(counts[used], kind="stable")]
        n, most = len(leaves), int(counts.sum()) + 1
        leaf, inner = [*counts[leaves].tolist(), most, most], [most] * n
        over_leaf, over_inner = [0] * n, [0] * n
        i = j = 0
        for node in range(n - 1):
            x, y = leaf[i], inner[j]
            if x <= y:
                over_leaf[i] = node
                i += 1
                total = x
            else:
                over_inner[j] = node
                j += 1
                total = y
            x, y = leaf[i], inner[j]
            if x <= y:
                over_leaf[i] = node
                i += 1
                total += x
            else:
                over_inner[j] = node
                j += 1
                total += y
            inner[node] = total
        below = [1] * (n - 1)
        for k in range(n - 3, -1, -1):
            below[k] = below[over_inner[k]] + 1
        depth = [below[k] for k in over_leaf]
        if max(depth) <= limit:
            lengths[leaves] = depth
            return lengths
        counts = np.where(counts > 0, (counts + 1) // 2, 0)


#: The code that code lengths are written in, and that of distances in images with fewer than FEW references: fitted to prose once. Codes of
#: their own would make such images some 2 % smaller and take longer to write and read.
OUTER_LENGTHS = (3, 6, 4, 3, 3, 3, 4, 4, 6, 5, 5, 6, 7, 7, 7, 7, 6, 5, 3)
OUTER_WORDS = code_words(np.array(OUTER_LENGTHS)).tolist()
FAR_LENGTHS = np.array((0,) * 13 + (3, 3, 3, 3, 3, 3, 4, 4, 4, 5, 6, 7, 8, 9, 10, 11, 13, 14, 15, 15, 15, 15, 15, 15, 15, 15, 14))
FEW = 200


@cache
def usual_distances() -> tuple[int, int, Prefix, np.ndarray]:
    """The usual code of distances: the bits that write it and their number, the code, its words."""
    return *prefix_bits(FAR_LENGTHS), Prefix(FAR_LENGTHS), code_words(FAR_LENGTHS)


@lru_cache(maxsize=1 << 14)
def _lengths_piece(zeros: int, value: int, run: int) -> tuple[int, int, int]:
    """Code lengths as bits, number of bits and of symbols: so many zeros, then a length ``run`` times."""
    tokens: list[tuple[int, int, int]] = []
    for same, left in ((0, zeros), (value, run)):
        if same:
            tokens.append((same, 0, 0))
            left -= 1
        while left >= (3 if same else 11):
            n = min(left, 6 if same else 138)
            tokens.append((16, n - 3, 2) if same else (18, n - 11, 7))
            left -= n
        if left >= 3:
            tokens.append((17, left - 3, 3))
            left = 0
        tokens += [(same, 0, 0)] * left
    held = at = 0
    for s, extra, k in tokens:
        held |= OUTER_WORDS[s] << at | extra << (at + OUTER_LENGTHS[s])
        at += OUTER_LENGTHS[s] + k
    return held, at, len(tokens)


#: What stands before coded lengths: not simple, 19 lengths of the outer code, a number of symbols that is given.
OUTER_HEAD = 15 << 1 | sum(OUTER_LENGTHS[s] << 3 * i for i, s in enumerate(CODE_LENGTH_ORDER)) << 5 | 1 << 62


def prefix_bits(lengths: np.ndarray) -> tuple[int, int]:
    """A code as bits and their number: simple for one or two small symbols, else by coded lengths with runs."""
    used = lengths.nonzero()[0]
    symbols = used.tolist()
    if len(symbols) <= 2 and (not symbols or symbols[-1] < 256):
        first, *other = symbols or [0]
        return (0b111 | first << 3 | other[0] << 11, 19) if other else (0b101 | first << 3, 11)
    held = at = count = 0
    zeros, value, run, following = symbols[0], 0, 0, symbols[0]
    for s, x in zip([*symbols, -1], [*lengths[used].tolist(), 0], strict=True):
        if s == following and (x == value or not run):
            value, run, following = x, run + 1, s + 1
            continue
        bits, k, n = _lengths_piece(zeros, value, run)
        held |= bits << at
        at += k
        count += n
        zeros, value, run, following = s - following, x, 1, s + 1
    size = max(2, (count - 2).bit_length())
    size += size & 1
    return OUTER_HEAD | (size - 2) // 2 << 63 | (count - 2) << 66 | held << (66 + size), 66 + size + at


def put_prefix(w: Writer, lengths: np.ndarray) -> None:
    """Writes a code."""
    w.put(*prefix_bits(lengths))


def _prefix_of(value: int) -> tuple[int, int, int]:
    """Prefix, extra value, extra bits of a length or distance."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    k = v.bit_length() - 2
    return 2 * k + 2 + (v >> k & 1), v & ((1 << k) - 1), k


def _put_image(w: Writer, argb: np.ndarray, width: int, main: bool, cache_bits: int = 0, references: bool = False) -> None:
    """An entropy-coded image with Huffman codes, and with back-references and a colour cache if asked for."""
    pixels = [int(x) for x in argb]
    near = {max(1, x + y * width): i + 1 for i, (x, y) in reversed(list(enumerate(NEAR)))}
    tokens: list[tuple] = []
    seen: dict[tuple, int] = {}
    cache, shift = [0] * (1 << cache_bits), 32 - cache_bits
    at = 0
    while at < len(pixels):
        p, n = pixels[at], 1
        j = seen.get(tuple(pixels[at : at + 3])) if references else None
        if j is not None:
            n = 3
            while n < 4096 and at + n < len(pixels) and pixels[j + n] == pixels[at + n]:
                n += 1
            d = at - j
            tokens.append(("ref", _prefix_of(n), _prefix_of(near.get(d, d + 120))))
        elif cache_bits and cache[(HASH_MULTIPLIER * p & 0xFFFFFFFF) >> shift] == p:
            tokens.append(("hit", (HASH_MULTIPLIER * p & 0xFFFFFFFF) >> shift))
        else:
            tokens.append(("pixel", p))
        for k in range(at, at + n):
            if references:
                seen[tuple(pixels[k : k + 3])] = k
            if cache_bits:
                cache[(HASH_MULTIPLIER * pixels[k] & 0xFFFFFFFF) >> shift] = pixels[k]
        at += n
    counts = [np.zeros(k, np.int64) for k in (280 + ((1 << cache_bits) if cache_bits else 0), 256, 256, 256, 40)]
    for t in tokens:
        if t[0] == "pixel":
            for c, s in zip(counts, (8, 16, 0, 24), strict=False):
                c[t[1] >> s & 255] += 1
        elif t[0] == "hit":
            counts[0][280 + t[1]] += 1
        else:
            counts[0][256 + t[1][0]] += 1
            counts[4][t[2][0]] += 1
    lengths = [code_lengths(c, 15) for c in counts]
    codes, lone = [code_words(x).tolist() for x in lengths], [np.count_nonzero(x) < 2 for x in lengths]
    w.put(int(bool(cache_bits)), 1)
    if cache_bits:
        w.put(cache_bits, 4)
    if main:
        w.put(0, 1)
    for x in lengths:
        put_prefix(w, x)

    def put(k: int, s: int) -> None:
        if not lone[k]:
            w.put(codes[k][s], int(lengths[k][s]))

    for t in tokens:
        if t[0] == "pixel":
            for k, s in enumerate((8, 16, 0, 24)):
                put(k, t[1] >> s & 255)
        elif t[0] == "hit":
            put(0, 280 + t[1])
        else:
            for k, base, (prefix, extra, n) in ((0, 256, t[1]), (4, 0, t[2])):
                put(k, base + prefix)
                if n:
                    w.put(extra, n)


def _container(body: bytes) -> bytes:
    pad = b"\0" * (len(body) & 1)
    return b"RIFF" + struct.pack("<I", 4 + 8 + len(body) + len(pad)) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body + pad


def _header(w: Writer, width: int, height: int) -> None:
    for value, n in ((SIGNATURE, 8), (width - 1, 14), (height - 1, 14), (0, 1), (0, 3)):
        w.put(value, n)


def encode(rgb: np.ndarray, transforms: tuple = (), cache_bits: int = 0, references: bool = False, mode: int = 11, block: int = 2) -> bytes:
    """Lossless WebP of (height, width, 3) samples with any of the format's tools, in the order given."""
    height, width = rgb.shape[:2]
    v = np.concatenate([rgb[:, :, ::-1], np.full((height, width, 1), 255, np.uint8)], axis=2).reshape(-1, 4)
    w = Writer()
    _header(w, width, height)
    number = lambda a: np.ascontiguousarray(a, np.uint8).view("<u4").ravel()
    for kind in transforms:
        w.put(1, 1)
        w.put(kind, 2)
        n = -(-width >> block) * -(-height >> block)
        if kind == PREDICTOR:
            modes = np.arange(n) % 14 if mode < 0 else np.full(n, mode)
            w.put(block - 2, 3)
            image = np.zeros((n, 4), np.uint8)
            image[:, 1], image[:, 3] = modes, 255
            _put_image(w, number(image), -(-width >> block), False)
            v = _predicted(v, modes, width, height, block, -1)
        elif kind == CROSS_COLOR:
            image = np.tile(np.array([[12, 250, 9, 255]], np.uint8), (n, 1))
            w.put(block - 2, 3)
            _put_image(w, number(image), -(-width >> block), False)
            v = _crossed(v, image, width, height, block, -1)
        elif kind == SUBTRACT_GREEN:
            v = _greened(v, -1)
        else:
            table, index = np.unique(number(v), return_inverse=True)
            w.put(len(table) - 1, 8)
            t = _planes(table)
            _put_image(w, number(np.diff(t, axis=0, prepend=np.zeros((1, 4), np.uint8))), len(table), False)
            k = _pack_bits(len(table))
            wide = -(-width >> k)
            grid = np.zeros((height, wide << k), np.int64)
            grid[:, :width] = index.reshape(height, width)
            packed = sum(grid[:, j :: 1 << k] << (j << (3 - k)) for j in range(1 << k))
            v = np.zeros((height * wide, 4), np.uint8)
            v[:, 1], v[:, 3] = packed.ravel(), 255
            width = wide
    w.put(0, 1)
    _put_image(w, number(v), width, True, cache_bits, references)
    return _container(w.done())


#: Least bytes of a back-reference, and most of one and of its distance.
MATCH, MATCH_MOST, FAR = 6, 4096, 1_000_000


def _references(v: np.ndarray) -> np.ndarray:
    """Greedy rows (start, length, distance) of what repeats: runs of positions whose MATCH bytes last stood the same distance before."""
    n = len(v) - MATCH + 1
    if n < 2:
        return np.empty((0, 3), np.int64)
    # MATCH bytes in the upper 48 bits; behind them, or behind a hash of them, goes the position, so that plain numbers are sorted.
    key = np.ndarray((n,), "<u8", v.tobytes() + bytes(8), strides=(1,)) << np.uint64(64 - 8 * MATCH)
    low = max(64 - 8 * MATCH, n.bit_length())
    order = key
    if low > 64 - 8 * MATCH:
        order = key * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(low) << np.uint64(low)
    order = order | np.arange(n, dtype=np.uint64)
    order.sort()
    again = (order[1:] ^ order[:-1] < np.uint64(1 << low)).nonzero()[0]
    order &= np.uint64((1 << low) - 1)
    order = order.view(np.int64)
    here, before = order.take(again + 1), order.take(again)
    back = here - before
    if low > 64 - 8 * MATCH:
        back[(key.take(here) != key.take(before)) | (back > FAR)] = 0
    known = np.zeros(n + 2, np.int64)
    known[here + 1] = back
    edge = (known[1:] != known[:-1]).nonzero()[0]
    far = known.take(edge + 1)
    some = far.nonzero()[0]
    start, which, at = [], [], 0
    for i, s, e in zip(some.tolist(), edge.take(some).tolist(), edge.take(some + 1).tolist(), strict=True):
        if at < e:
            start.append(s if s > at else at)
            which.append(i)
            at = e + MATCH - 1
    found = np.empty((len(start), 3), np.int64)
    if start:
        which = np.array(which)
        found[:, 0] = start
        found[:, 1] = edge.take(which + 1) + (MATCH - 1) - found[:, 0]
        found[:, 2] = far.take(which)
        if found[:, 1].max() > MATCH_MOST:
            found = np.array([(x, min(MATCH_MOST, s + n - x), d) for s, n, d in found.tolist() for x in range(s, s + n, MATCH_MOST)])
    return found


def _prefixes_of(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix, extra value and extra bits of lengths or distances."""
    prefix = BASE.searchsorted(value, "right") - 1
    return prefix, value - BASE.take(prefix), EXTRA.take(prefix)


def _packed(held: int, n: int, value: np.ndarray, size: np.ndarray) -> bytes:
    """The ``n`` bits held, then values of ``size`` bits each (64 at most; 0 for zeros), lowest bit first, filled up to a byte."""
    whole = n >> 6
    ends = size.cumsum()
    ends += n & 63
    shift = ends - size
    at = shift >> 6
    shift &= 63
    out = np.zeros((int(ends[-1]) >> 6) + 2, np.uint64)
    out[0] = held >> (whole << 6)
    edge = (at[1:] != at[:-1]).nonzero()[0]
    first, final = np.empty((2, len(edge) + 1), np.int64)
    first[0], final[-1] = 0, len(at) - 1
    first[1:], final[:-1] = edge + 1, edge
    value, shift = value.view(np.uint64), shift.view(np.uint64)
    out[at.take(first)] |= np.bitwise_or.reduceat(value << shift, first)
    # What the last value of a word has beyond it; a shift by 1 and by the rest is one by 64 bits where the rest is 63.
    out[at.take(final) + 1] |= value.take(final) >> np.uint64(1) >> np.uint64(63) - shift.take(final)
    return ((held & (1 << (whole << 6)) - 1).to_bytes(whole * 8, "little") + out.tobytes())[: whole * 8 + (int(ends[-1]) + 7 >> 3)]


#: Distances are written as those beyond the near ones; the codes of red, blue and alpha, 0, 0 and 255.
BEYOND_NEAR = np.array([0, len(NEAR)])
LONE_CODES = sum((0b101 | s << 3) << 11 * i for i, s in enumerate((0, 0, 255)))


def encode_grey(samples: np.ndarray) -> bytes:
    """Lossless WebP of (height, width) grey samples: subtract-green, back-references and Huffman codes.

    Red and blue equal green, so the transform leaves zeros, whose codes take no bits; what is coded
    is one symbol a sample or reference.
    """
    height, width = samples.shape
    v = samples.ravel()
    found = _references(v)
    start = found[:, 0]
    symbol = v.astype(np.int64)
    if len(found):
        prefix, extra, more = _prefixes_of(found[:, 1:] + BEYOND_NEAR)
        symbol[start] = prefix[:, 0] + 256
        inside = np.zeros(len(v) + 1, np.int8)
        inside[start + 1] = 1
        inside[start + found[:, 1]] -= 1  # no two begin, and no two end, at one place
        symbol = symbol[inside[:-1].cumsum(dtype=np.int8) == 0]
    main = code_lengths(np.bincount(symbol, minlength=280), 15)
    if 0 < len(found) < FEW:
        far_head, far_n, _, far_words = usual_distances()
        far_bits = FAR_LENGTHS
    else:
        far_bits = code_lengths(np.bincount(prefix[:, 1], minlength=40) if len(found) else np.zeros(40, np.int64), 15)
        far_words = code_words(far_bits)
        far_head, far_n = prefix_bits(far_bits)
    # One transform, no more, no cache, one group; codes, those of red, blue and alpha with one symbol.
    head, n = prefix_bits(main)
    held = SIGNATURE | (width - 1) << 8 | (height - 1) << 22 | 1 << 40 | SUBTRACT_GREEN << 41 | head << 46 | LONE_CODES << (46 + n) | far_head << (79 + n)
    n += 79 + far_n
    words = code_words(main)
    for lengths, own in ((main, words), (far_bits, far_words)):
        if np.count_nonzero(lengths) < 2:  # a lone symbol takes no bits
            lengths[:] = own[:] = 0
    value, size = words.take(symbol), main.take(symbol)
    if len(found):
        which = (symbol > 255).nonzero()[0]
        d = prefix[:, 1]
        own, k = size.take(which), far_bits.take(d)
        value[which] |= (extra[:, 0] | (far_words.take(d) | extra[:, 1] << k) << more[:, 0]) << own
        size[which] = own + more[:, 0] + k + more[:, 1]
    return _container(_packed(held, n, value, size))


def files(data: bytes) -> list[bytes]:
    """The files of a sequence of WebP files."""
    out, at = [], 0
    while at < len(data):
        n = 8 + struct.unpack_from("<I", data, at + 4)[0]
        out.append(data[at : at + n])
        at += n
    return out


