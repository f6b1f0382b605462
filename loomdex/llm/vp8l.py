"""The lossless WebP (VP8L) bitstream: a decoder for all of it, and two encoders.

``decode`` reads prefix codes, back-references, the colour cache, meta prefix images
and inverts the predictor, cross-colour, subtract-green and palette transforms.

An image with one group of codes is read by whole arrays: what a pixel would take if it
began at a bit is looked up for every bit at once, the true beginnings are found by walking
along these lengths, references and cache entries become pointers to earlier pixels, and
the pointers are followed by doubling.  Predictors that don't mix the left neighbour with
others are inverted row by row.  Other images and predictors are read pixel by pixel.

``encode`` writes Huffman codes with references and, if asked to, palette, predictor,
cross-colour and cache, by arrays (for bulk storage); ``encode_full`` writes also meta
prefix images and all predictors.
Pixels are arrays (height, width, 4) of uint8 in the order R, G, B, A.
"""

from __future__ import annotations

import heapq
import struct
from collections import Counter
from functools import lru_cache

import numpy as np

MAX_SIDE = 1 << 14
_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
_HASH = 0x1E35A7BD
# the 120 near distances: by (|x|, y) pairs, x to the left being positive
_NEAR = [tuple(map(int, p.split(","))) for p in (
    "0,1 1,0 1,1 -1,1 0,2 2,0 1,2 -1,2 2,1 -2,1 2,2 -2,2 0,3 3,0 1,3 -1,3 3,1 -3,1 2,3 -2,3 3,2 -3,2 0,4 4,0 1,4 -1,4 4,1 -4,1 3,3 -3,3 "
    "2,4 -2,4 4,2 -4,2 0,5 3,4 -3,4 4,3 -4,3 5,0 1,5 -1,5 5,1 -5,1 2,5 -2,5 5,2 -5,2 4,4 -4,4 3,5 -3,5 5,3 -5,3 0,6 6,0 1,6 -1,6 6,1 -6,1 "
    "2,6 -2,6 6,2 -6,2 4,5 -4,5 5,4 -5,4 3,6 -3,6 6,3 -6,3 0,7 7,0 1,7 -1,7 5,5 -5,5 7,1 -7,1 4,6 -4,6 6,4 -6,4 2,7 -2,7 7,2 -7,2 3,7 -3,7 "
    "7,3 -7,3 5,6 -5,6 6,5 -6,5 8,0 4,7 -4,7 7,4 -7,4 8,1 8,2 6,6 -6,6 8,3 5,7 -5,7 7,5 -7,5 8,4 6,7 -6,7 7,6 -7,6 8,5 7,7 -7,7 8,6 8,7"
).split()]


class Bits:
    """Little-endian bit reader over a whole stream."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.size = data, 0, 8 * len(data)

    def read(self, n: int) -> int:
        at = self.at
        self.at = at + n
        return int.from_bytes(self.data[at >> 3 : (at + n + 7) >> 3], "little") >> (at & 7) & ((1 << n) - 1)


def _places(x: np.ndarray) -> np.ndarray:
    return x.nonzero()[0]


@lru_cache(maxsize=16)
def _reversed_bits(n: int) -> np.ndarray:
    """The numbers below 2**n with their n bits in reverse order."""
    out = np.zeros(1, np.int64)
    for _ in range(n):
        out = np.concatenate((out * 2, out * 2 + 1))
    return out


class Code:
    """A canonical prefix code: symbols and lengths by the bits that come next."""

    def __init__(self, lengths: np.ndarray | None, only: int = 0) -> None:
        self.size, self.only, self.symbols, self.lengths = 0, only, None, None
        if lengths is None:
            return
        used = _places(lengths)
        if len(used) <= 1:
            self.only = int(used[0]) if len(used) else 0
            return
        size = lengths[used]
        self.size = int(size.max())
        order = size.argsort(kind="stable")
        spread = np.left_shift(1, self.size - size[order])
        if spread.sum() != 1 << self.size:
            raise ValueError("incomplete prefix code")
        flip = _reversed_bits(self.size)
        #: symbol * 16 + length by the next ``size`` bits; symbols are below 280 + 2**11
        self.table = np.repeat((used[order] << 4 | size[order]).astype(np.uint16), spread)[flip]

    def next(self, bits: Bits) -> int:
        if not self.size:
            return self.only
        if self.symbols is None:
            self.symbols, self.lengths = (self.table >> 4).tolist(), (self.table & 15).tolist()
        at = bits.at
        k = int.from_bytes(bits.data[at >> 3 : (at >> 3) + 4], "little") >> (at & 7) & ((1 << self.size) - 1)
        bits.at = at + self.lengths[k]
        return self.symbols[k]


#: Codes that say one symbol and take no bits.
_SINGLE = [Code(None, s) for s in range(256)]
_FLIPS = [_reversed_bits(n).tolist() for n in range(8)]


def _read_code(bits: Bits, alphabet: int) -> Code:
    at = bits.at
    k = int.from_bytes(bits.data[at >> 3 : (at >> 3) + 4], "little") >> (at & 7)
    if k & 1:
        two, n = k >> 1 & 1, 8 if k & 4 else 1
        one = k >> 3 & ((1 << n) - 1)
        bits.at = at + 3 + n + 8 * two
        if not two:
            return _SINGLE[one]
        lengths = np.zeros(alphabet, np.int64)
        lengths[[one, k >> 3 + n & 255]] = 1
        return Code(lengths)
    given = 4 + (k >> 1 & 15)
    bits.at = at + 5
    sizes = bits.read(3 * given)
    first = sorted((n, s) for k, s in enumerate(_ORDER[:given]) if (n := sizes >> 3 * k & 7))
    # the length and the symbol by the next bits, as in Code: a symbol alone takes none
    table, most = [(0, first[0][1] if first else 0)], 0
    if len(first) > 1:
        most = first[-1][0]
        table = [x for x in first for _ in range(1 << most - x[0])]
        if len(table) != 1 << most:
            raise ValueError("incomplete prefix code")
        table = [table[k] for k in _FLIPS[most]]
    mask = (1 << most) - 1
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    found = []
    # code lengths have at most 7 + 7 bits: the stream is held as one number while they are read, under a bit that tells what is left
    at, most = bits.at, min(left, alphabet) * 14 + 8
    held = int.from_bytes(bits.data[at >> 3 : (at + most + 7) >> 3], "little") >> (at & 7) & ((1 << most) - 1) | 1 << most
    for _ in range(left):
        n, s = table[held & mask]
        held >>= n
        if s < 16:
            found.append(s)
        else:
            n = 2 if s == 16 else 3 if s == 17 else 7
            again = next((x for x in reversed(found) if x), 8) if s == 16 else 0
            found += [again] * ((11 if s == 18 else 3) + (held & ((1 << n) - 1)))
            held >>= n
        if len(found) >= alphabet:
            break
    bits.at = at + most + 1 - held.bit_length()
    if len(found) > alphabet:
        raise ValueError("too many code lengths")
    lengths = np.zeros(alphabet, np.int64)
    lengths[: len(found)] = found
    return Code(lengths)


def _extra(bits: Bits, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    n = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << n) + bits.read(n) + 1


def _distance(code: int, width: int) -> int:
    if code > 120:
        return code - 120
    x, y = _NEAR[code - 1]
    return max(1, x + y * width)


def _pixels(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image as argb numbers, flat."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits and not 1 <= cache_bits <= 11:
        raise ValueError("bad colour cache size")
    groups, meta, block = 1, None, 0
    if main and bits.read(1):
        block = bits.read(3) + 2
        mw = -(-width >> block)
        meta = (_pixels(bits, mw, -(-height >> block), False) >> 8) & 0xFFFF
        groups = int(meta.max()) + 1
    sets = [[_read_code(bits, n) for n in (256 + 24 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)] for _ in range(groups)]
    total = width * height
    if groups == 1 and (out := _all_pixels(bits, sets[0], width, total, cache_bits)) is not None:
        return out
    cache, out, i = [0] * (1 << cache_bits), [0] * total, 0
    shift = 32 - cache_bits
    while i < total:
        if meta is not None:
            y, x = divmod(i, width)
            g, r, b, a, d = sets[meta[(y >> block) * mw + (x >> block)]]
        else:
            g, r, b, a, d = sets[0]
        s = g.next(bits)
        if s < 256:
            red = r.next(bits)
            blue = b.next(bits)
            px = a.next(bits) << 24 | red << 16 | s << 8 | blue
        elif s < 280:
            n = _extra(bits, s - 256)
            back = _distance(_extra(bits, d.next(bits)), width)
            if back > i or i + n > total:
                raise ValueError("reference outside the image")
            for k in range(i, i + n):
                px = out[k] = out[k - back]
                if cache_bits:
                    cache[(_HASH * px & 0xFFFFFFFF) >> shift] = px
            i += n
            continue
        else:
            px = cache[s - 280]
        out[i] = px
        if cache_bits:
            cache[(_HASH * px & 0xFFFFFFFF) >> shift] = px
        i += 1
    return np.array(out, np.uint32)


#: What was decoded by whole arrays, for tests: feature to count.
taken: Counter = Counter()

_NEAR_XY = np.array(_NEAR).T


@lru_cache(maxsize=64)
def _near_distances(width: int) -> np.ndarray:
    """The distances that the 120 near codes stand for."""
    return np.maximum(1, _NEAR_XY[0] + _NEAR_XY[1] * width)


_PREFIX_BITS = np.array([0] * 4 + [(p - 2) >> 1 for p in range(4, 40)])
_PREFIX_BASE = np.array([p + 1 for p in range(4)] + [((2 + (p & 1)) << ((p - 2) >> 1)) + 1 for p in range(4, 40)])


_EIGHT = np.arange(8, dtype=np.uint32)


def _ahead(data: bytes, begin: int, end: int) -> np.ndarray:
    """The next 25 bits, and some more, at every bit from ``begin`` to ``end``, zeros after the data."""
    first = begin >> 3
    n = ((end - 1) >> 3) - first + 1
    four = np.ndarray(n, "<u4", data[first : first + n + 3].ljust(n + 3, b"\0"), 0, (1,)).astype(np.uint32)
    return (four[:, None] >> _EIGHT).reshape(-1)[begin & 7 : (begin & 7) + end - begin]


def _follow(pointer: np.ndarray, moved: np.ndarray) -> np.ndarray:
    """The roots to which pointers to earlier pixels lead; those that aren't ``moved`` are their own."""
    pointer, to = pointer.copy(), pointer[moved]
    while True:
        beyond = pointer[to]
        if (beyond == to).all():
            return pointer
        pointer[moved] = to = beyond


def _all_pixels(bits: Bits, codes: list[Code], width: int, total: int, cache_bits: int) -> np.ndarray | None:
    """The pixels of an image with one group of codes, by whole arrays; None if that can't be done."""
    g, r, b, a, d = codes
    if not g.size and g.only < 256 and not (r.size or b.size or a.size):
        return np.full(total, a.only << 24 | r.only << 16 | g.only << 8 | b.only, np.uint32)
    rest = bits.size - bits.at
    if rest <= 0:
        raise ValueError("stream is cut short")
    for most in (total * 8 + 64 if rest > total * 40 else rest, total * 96):  # no pixel takes 96 bits, and few images so much as 8 a pixel
        n = min(rest, most)
        out = _pixels_of(bits, codes, width, total, cache_bits, n, n == rest or most == total * 96)
        if out is not _MORE:
            return out
    return None


_MORE = np.zeros(0, np.uint32)


def _pixels_of(bits: Bits, codes: list[Code], width: int, total: int, cache_bits: int, n: int, last: bool) -> np.ndarray | None:
    """The same from the next ``n`` bits; _MORE if these weren't enough and aren't the ``last``."""
    g, r, b, a, d = codes
    ahead = _ahead(bits.data, bits.at, bits.at + n + 512)  # so that a pixel's later parts can be looked up

    def look(code: Code, at: np.ndarray) -> np.ndarray:
        """Symbol * 16 + length of the code at some bits."""
        return code.table.take(ahead[at] & ((1 << code.size) - 1)) if code.size else np.full(len(at), code.only << 4, np.uint16)

    # what each bit's pixel would be, and how many bits it would take
    green = g.table.take(ahead & ((1 << g.size) - 1)) if g.size else np.full(len(ahead), g.only << 4, np.uint16)
    green[n:] = 1  # beyond the end
    step = (green & 15).astype(np.uint8)
    every = np.arange(n)
    mixed = bool(r.size or b.size or a.size)
    if mixed:
        at = every + step[:n]
        for code in (r, b, a):
            if code.size:
                at += look(code, at) & 15
        np.copyto(step[:n], at - every, casting="unsafe", where=green[:n] < 256 << 4)
    copies = _places(green[:n] - np.uint16(256 << 4) < 24 << 4)  # below 0 is far above
    if len(copies):
        at = copies + step[copies] + _PREFIX_BITS[(green[copies] >> 4) - 256]
        far = look(d, at)
        step[copies] = at + (far & 15) + _PREFIX_BITS[far >> 4] - copies
    if not step.min():
        return None
    # walk from pixel to pixel, several at a time: jumps[k] leads 2**k pixels on
    jumps = [step]
    while len(jumps) < 3 and int(jumps[-1].max()) < 128:
        longer = jumps[-1].copy()
        longer[:n] += jumps[-1][every + jumps[-1][:n]]
        jumps.append(longer)
    walk, at, heads = jumps[-1].tobytes(), 0, []
    for _ in range(-(-total >> len(jumps) - 1)):
        if at >= n:
            break
        heads.append(at)
        at += walk[at]
    places = np.fromiter(heads, np.int64, len(heads))
    for jump in reversed(jumps[:-1]):  # and fill in what was jumped over
        both = np.empty((len(places), 2), np.int64)
        both[:, 0] = places
        np.add(places, jump[places], out=both[:, 1])
        places = both.reshape(-1)
    places = places[: np.searchsorted(places, n)]
    kind = green[places] >> 4
    copied = _places(kind - np.uint16(256) < 24)
    run = np.ones(len(places), np.int64)
    if len(copied):
        at = places[copied]
        prefix = kind[copied] - 256
        at = at + (green[at] & 15)
        run[copied] = _PREFIX_BASE[prefix] + (ahead[at] & ((1 << _PREFIX_BITS[prefix]) - 1))
        at = at + _PREFIX_BITS[prefix]
        far = look(d, at)
        at, far = at + (far & 15), far >> 4
        code = _PREFIX_BASE[far] + (ahead[at] & ((1 << _PREFIX_BITS[far]) - 1))
        back = np.where(code > 120, code - 120, _near_distances(width)[np.minimum(code, 120) - 1])
    end = np.cumsum(run)
    count = int(np.searchsorted(end, total)) + 1
    if count > len(places) and not last:
        return _MORE
    if count > len(places) or end[count - 1] != total:
        raise ValueError("stream is cut short" if count > len(places) else "reference outside the image")
    places, kind, run, begin = places[:count], kind[:count], run[:count], end[:count] - run[:count]
    begun = bits.at
    bits.at += int(places[-1]) + int(step[places[-1]])
    if bits.at > bits.size:
        raise ValueError("stream is cut short")
    # literals
    value = np.zeros(total, np.uint32)
    own = _places(kind < 256)
    px, at = kind[own].astype(np.uint32) << 8, places[own]
    px |= np.uint32(r.only << 16 | b.only | a.only << 24)  # a code with several symbols has none here
    if mixed:
        at = at + (green[at] & 15)
        for code, shift in ((r, 16), (b, 0), (a, 24)):
            if code.size:
                found = look(code, at)
                at = at + (found & 15)
                px |= (found >> 4).astype(np.uint32) << shift
    value[begin[own]] = px
    taken["prefix codes"] += 1
    copied = copied[copied < count]
    cached = _places(kind >= 280)
    if not len(copied) and not len(cached):
        return value
    pointer, moved = np.arange(total), begin[cached]
    if len(copied):
        size = run[copied]
        if (back[: len(copied)] > begin[copied]).any():
            raise ValueError("reference outside the image")
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - begin[copied], size)
        pointer[at] = at - np.repeat(back[: len(copied)], size)
        moved = at if not len(cached) else np.concatenate((at, moved))
        taken["references"] += 1
    if len(cached):
        root = _follow(pointer, moved)
        slot = ((value * np.uint32(_HASH)) >> np.uint32(32 - cache_bits)).astype(np.uint16)
        slot[begin[cached]] = kind[cached] - 280
        slot = slot[root]
        # a slot holds the last pixel before that has its hash
        order = np.argsort(slot, kind="stable")
        before = np.full(total, -1)
        same = slot[order[1:]] == slot[order[:-1]]
        before[order[1:][same]] = order[:-1][same]
        if (before[begin[cached]] < 0).any():
            bits.at = begun
            return None  # a slot that was never filled
        pointer[begin[cached]] = before[begin[cached]]
        taken["cache"] += 1
    return value[_follow(pointer, moved)]


def _channels(argb: np.ndarray) -> np.ndarray:
    """Flat argb numbers as rows of A, R, G, B."""
    return argb.astype(">u4").view(np.uint8).reshape(-1, 4).astype(np.int64)


def _number(ch: np.ndarray) -> np.ndarray:
    c = (ch & 255).astype(np.uint32)
    return c[:, 0] << 24 | c[:, 1] << 16 | c[:, 2] << 8 | c[:, 3]


def _predict(mode: int, left, top, right, corner):
    """A predicted pixel from its neighbours (left, top, top right, top left), as four numbers."""
    avg = lambda p, q: [(x + y) >> 1 for x, y in zip(p, q, strict=True)]
    clamp = lambda v: 0 if v < 0 else 255 if v > 255 else v
    if mode == 0 or mode > 13:
        return [255, 0, 0, 0]
    if mode <= 4:
        return (left, top, right, corner)[mode - 1]
    if mode == 5:
        return avg(avg(left, right), top)
    if mode in (6, 7, 8, 9):
        return avg(*((left, corner), (left, top), (corner, top), (top, right))[mode - 6])
    if mode == 10:
        return avg(avg(left, corner), avg(top, right))
    if mode == 11:
        to_left = sum(abs(t - c) for t, c in zip(top, corner, strict=True))
        to_top = sum(abs(x - c) for x, c in zip(left, corner, strict=True))
        return left if to_left < to_top else top
    if mode == 12:
        return [clamp(x + t - c) for x, t, c in zip(left, top, corner, strict=True)]
    mean = avg(left, top)
    return [clamp(m + int((m - c) / 2)) for m, c in zip(mean, corner, strict=True)]


def _neighbours(px, i: int, x: int, y: int, width: int):
    return px[i - 1], px[i - width], px[i - width + 1], px[i - width - 1]


#: Predictors that take the left neighbour alone or not at all.
_BY_ROWS = (0, 1, 2, 3, 4, 8, 9)


def _varied(argb: np.ndarray, plain: int, height: int, width: int) -> tuple[list[int], np.ndarray] | None:
    """Shifts and values (height, width, channels) of the channels that aren't all as in ``plain``; None if all are."""
    other = int(np.bitwise_or.reduce(argb ^ np.uint32(plain)))
    shifts = [s for s in (24, 16, 8, 0) if other >> s & 255]
    if not shifts:
        return None
    out = np.empty((height * width, len(shifts)), np.int16)
    for k, s in enumerate(shifts):
        out[:, k] = argb >> np.uint32(s) & np.uint32(255)
    return shifts, out.reshape(height, width, len(shifts))


def _predicted(argb: np.ndarray, modes: np.ndarray, bits_: int, width: int, height: int, forward: bool) -> np.ndarray:
    """Apply or invert predictors of _BY_ROWS, modes (rows, columns of blocks).

    A channel that is opaque black's all over has no residual, and one without a residual is.
    """
    found = _varied(argb, 0xFF000000 if forward else 0, height, width)
    out = np.full(height * width, 0 if forward else 0xFF000000, np.uint32)
    if found:
        shifts, part = found
        start = np.array([255 if s == 24 else 0 for s in shifts])
        part = _residual(part, modes, bits_, start) if forward else _rows(part.astype(np.int32), modes, bits_, start)
        for k, s in enumerate(shifts):
            out &= np.uint32(0xFFFFFFFF ^ 255 << s)
            out |= part[:, :, k].reshape(-1).astype(np.uint32) << np.uint32(s)
    return out


def _rows(residual: np.ndarray, modes: np.ndarray, bits_: int, start: np.ndarray) -> np.ndarray:
    """Invert predictors of _BY_ROWS; residual (height, width, channels), ``start``: opaque black's channels."""
    taken["predictor"] += 1
    height, width, n = residual.shape
    out = np.empty_like(residual)
    out[0] = residual[0]
    out[0, 0] += start
    out[0] = np.cumsum(out[0], axis=0) & 255
    place = np.arange(width)
    for y in range(height)[1:]:
        if y == 1 or not y & ((1 << bits_) - 1):  # a row of blocks begins
            block = modes[y >> bits_]
            kinds, done = set(block.tolist()), y
            row = np.repeat(block, 1 << bits_)[:width] if len(kinds) > 1 else None
            if kinds in ({1}, {2}):  # sums along rows or columns, for all its rows at once
                done = min(height, (y >> bits_) + 1 << bits_)
                part = residual[y:done].copy()
                down = part if kinds == {2} else part[:, :1]
                down[0] += out[y - 1, : down.shape[1]]
                down[:] = np.cumsum(down, axis=0)
                out[y:done] = (part if kinds == {2} else np.cumsum(part, axis=1)) & 255
        if y < done:
            continue
        top = out[y - 1]
        first = (residual[y, 0] + top[0]) & 255
        guess = np.zeros_like(top)
        for kind in kinds - {1}:
            if kind == 0:
                part = np.broadcast_to(start, top.shape)
            else:
                right = np.concatenate((top[1:], first[None])) if kind in (3, 9) else None
                corner = np.concatenate((top[:1], top[:-1])) if kind in (4, 8) else None
                part = top if kind == 2 else right if kind == 3 else corner if kind == 4 else (top + corner) >> 1 if kind == 8 else (top + right) >> 1
            guess = part if row is None else np.where((row == kind)[:, None], part, guess)
        now = residual[y] + guess
        now[0] = first
        if row is None and 1 in kinds:
            now = np.cumsum(now, axis=0)
        elif 1 in kinds:  # sums along each stretch that takes its left neighbour
            since = np.maximum.accumulate(np.where((row != 1) | (place == 0), place, 0))
            total = np.cumsum(now, axis=0)
            now = total - total[since] + now[since]
        out[y] = now & 255
    return out


#: Predictors among which ``encode`` chooses.
_TRIED = (1, 2, 9)


def _guess(kind: int, px: np.ndarray, start: np.ndarray | int = 0) -> np.ndarray:
    """What a predictor of _BY_ROWS says of every pixel (height, width, channels), but for the first row and column."""
    height, width, n = px.shape
    flat = px.reshape(-1, n)
    moved = lambda k: np.concatenate((np.zeros((k, n), px.dtype), flat))[: len(flat)].reshape(px.shape)
    if kind == 0:
        return np.broadcast_to(start, px.shape)
    if kind <= 4:
        return moved((1, width, width - 1, width + 1)[kind - 1])
    return (moved(width) + moved(width + 1 if kind == 8 else width - 1)) >> 1


def _residual(px: np.ndarray, modes: np.ndarray, bits_: int, start: np.ndarray) -> np.ndarray:
    """The opposite of ``_rows``."""
    height, width, _ = px.shape
    kinds = sorted(set(modes.reshape(-1).tolist()))
    guess = _guess(kinds[0], px, start).copy()
    if len(kinds) > 1:
        each = np.repeat(np.repeat(modes, 1 << bits_, 0)[:height], 1 << bits_, 1)[:, :width]
        for kind in kinds[1:]:
            guess = np.where((each == kind)[:, :, None], _guess(kind, px, start), guess)
    guess[1:, 0] = px[:-1, 0]
    guess[0, 1:] = px[0, :-1]
    guess[0, 0] = start
    return (px - guess) & 255


def _apply_predictor(argb: np.ndarray, modes: np.ndarray, bits_: int, width: int, height: int, forward: bool) -> np.ndarray:
    mode = (modes >> 8) & 15
    across = -(-width >> bits_)
    if set(mode.tolist()) <= set(_BY_ROWS):
        return _predicted(argb, mode.astype(np.int64).reshape(-1, across), bits_, width, height, forward)
    px = _channels(argb).tolist()
    out = [list(p) for p in px]
    known = px if forward else out  # predictions come from true pixels
    for y in range(height):
        for x in range(width):
            i = y * width + x
            if not i:
                guess = [255, 0, 0, 0]
            elif not y:
                guess = known[i - 1]
            elif not x:
                guess = known[i - width]
            else:
                guess = _predict(int(mode[(y >> bits_) * across + (x >> bits_)]), *_neighbours(known, i, x, y, width))
            sign = -1 if forward else 1
            out[i] = [(v + sign * g) & 255 for v, g in zip(px[i], guess, strict=True)]
    return _number(np.array(out))


def _apply_cross(argb: np.ndarray, elements: np.ndarray, bits_: int, width: int, height: int, forward: bool) -> np.ndarray:
    if (elements == elements[0]).all():
        e = elements[:1]
    else:
        y, x = np.divmod(np.arange(width * height), width)
        e = elements[(y >> bits_) * -(-width >> bits_) + (x >> bits_)]
    channel = lambda px, shift: (px >> np.uint32(shift) & np.uint32(255)).astype(np.uint8).view(np.int8).astype(np.int32)
    delta = lambda shift, colour: (channel(e, shift) * colour) >> 5
    sign = -1 if forward else 1
    green = channel(argb, 8)
    blue, kept, changed = channel(argb, 0) + sign * delta(8, green), 0xFFFFFF00, 0
    by_red, to_red = (e >> 16 & 255).any(), (e & 255).any()
    if by_red or to_red:
        red = channel(argb, 16)
        true = red + sign * delta(0, green)
        kept, changed = 0xFF00FF00, (true & 255).astype(np.uint32) << np.uint32(16)
        if by_red:
            blue = blue + sign * delta(16, red if forward else true.astype(np.uint8).view(np.int8).astype(np.int32))
    return argb & np.uint32(kept) | changed | (blue & 255).astype(np.uint32)


def _apply_green(argb: np.ndarray, sign: int) -> np.ndarray:
    ch = _channels(argb)
    ch[:, 1] += sign * ch[:, 2]
    ch[:, 3] += sign * ch[:, 2]
    return _number(ch)


def _pack_bits(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def _unpack_palette(argb: np.ndarray, table: np.ndarray, width: int, height: int) -> np.ndarray:
    pack = _pack_bits(len(table))
    index = ((argb >> 8) & 255).reshape(height, -(-width >> pack))
    if pack:
        each = 8 >> pack
        index = (index[:, :, None] >> (np.arange(1 << pack, dtype=np.uint32) * each)) & ((1 << each) - 1)
        index = index.reshape(height, -1)[:, :width]
    index = index.reshape(-1)
    return np.where(index < len(table), table[np.minimum(index, len(table) - 1)], 0).astype(np.uint32)


def _payload(webp: bytes) -> bytes:
    if webp[:4] != b"RIFF" or webp[8:12] != b"WEBP":
        raise ValueError("no WebP file")
    at = 12
    while at + 8 <= len(webp):
        size = struct.unpack_from("<I", webp, at + 4)[0]
        if webp[at : at + 4] == b"VP8L":
            return webp[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no lossless image in the file")


def decode(webp: bytes) -> np.ndarray:
    """Pixels (height, width, RGBA) of a lossless WebP file."""
    argb, width, height = decode_argb(webp)
    # argb in memory is B, G, R, A
    return argb.astype("<u4").view(np.uint8).reshape(height, width, 4)[:, :, [2, 1, 0, 3]]


def decode_argb(webp: bytes) -> tuple[np.ndarray, int, int]:
    """Pixels as argb numbers, row by row, and the image's width and height."""
    data = _payload(webp)
    if data[0] != 0x2F:
        raise ValueError("bad signature")
    bits = Bits(data)
    bits.at = 8
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    undo, w = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in (0, 1):
            k = bits.read(3) + 2
            undo.append((kind, w, k, _pixels(bits, -(-w >> k), -(-height >> k), False)))
        elif kind == 2:
            undo.append((kind, w, 0, None))
        else:
            n = bits.read(8) + 1
            table = _number(np.cumsum(_channels(_pixels(bits, n, 1, False)), axis=0))
            undo.append((kind, w, 0, table))
            w = -(-w >> _pack_bits(n))
    argb = _pixels(bits, w, height, True)
    if bits.at > bits.size:
        raise ValueError("stream is cut short")
    for kind, w, k, extra in reversed(undo):
        if kind == 0:
            argb = _apply_predictor(argb, extra, k, w, height, False)
        elif kind == 1:
            argb = _apply_cross(argb, extra, k, w, height, False)
            taken["cross-colour"] += 1
        elif kind == 2:
            argb = _apply_green(argb, 1)
        else:
            argb = _unpack_palette(argb, extra, w, height)
            taken["palette"] += 1
    return argb, width, height


# ---- writing


#: A part of a stream: a number and how many bits of it, lowest first.
Part = tuple[int, int]


def _joined(parts: list[Part]) -> Part:
    """Parts one after the other as one."""
    value = size = 0
    for v, n in parts:
        value |= v << size
        size += n
    return value, size


def _file(parts: list[Part]) -> bytes:
    value, size = _joined(parts)
    body = value.to_bytes((size + 7) >> 3, "little")
    pad = b"\0" * (len(body) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(body) + len(pad)) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body + pad


def _head(width: int, height: int) -> list[Part]:
    return [(0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)]


_END = 1 << 62


def _huffman(counts: np.ndarray, limit: int = 15) -> np.ndarray:
    """Code lengths of at most ``limit`` bits (counts are flattened until they fit)."""
    used = _places(counts)
    lengths = np.zeros(len(counts), np.int64)
    lengths[used] = _depths(counts[used].tolist(), limit)
    return lengths


def _depths(weights: list[int], limit: int) -> list[int]:
    """The same of the symbols that occur."""
    n = len(weights)
    if n <= 1:
        return [1] * n
    while True:
        order = sorted(range(n), key=weights.__getitem__)
        # leaves in order and the nodes made of them, which come in order by themselves: always the two lightest are joined
        light, made = [weights[k] for k in order] + [_END], [_END] * n
        above, over = [], []  # the node above each leaf, and above each node
        leaf, node = light[0], _END
        for new in range(n - 1):
            if leaf <= node:
                total = leaf
                above.append(new)
                leaf = light[len(above)]
            else:
                total = node
                over.append(new)
                node = made[len(over)]
            if leaf <= node:
                total += leaf
                above.append(new)
                leaf = light[len(above)]
            else:
                total += node
                over.append(new)
                node = made[len(over)]
            made[new] = total
            if len(over) == new:
                node = total
        depth = [1] * n  # of what is below a node
        for k in range(n - 3, -1, -1):
            depth[k] = depth[over[k]] + 1
        if depth[above[0]] <= limit:  # the lightest is among the deepest
            out = [0] * n
            for k, node in zip(order, above, strict=True):
                out[k] = depth[node]
            return out
        weights = [w // 2 + 1 for w in weights]


def _code_values(lengths: np.ndarray) -> np.ndarray:
    """Every symbol's code, its first bit lowest."""
    out = np.zeros(len(lengths), np.int64)
    used = _places(lengths)
    if len(used) <= 1:
        return out
    size = lengths[used]
    order = size.argsort(kind="stable")
    most = int(size.max())
    spread = np.left_shift(1, most - size[order])
    code = spread.cumsum() - spread  # left-aligned in ``most`` bits
    out[used[order]] = _reversed_bits(most)[code]
    return out


def _codes(lengths: np.ndarray) -> dict[int, tuple[int, int]]:
    used = _places(lengths)
    if len(used) <= 1:
        return {int(s): (0, 0) for s in used}
    value = _code_values(lengths)
    return {s: (v, n) for s, v, n in zip(used.tolist(), value[used].tolist(), lengths[used].tolist(), strict=True)}


_ONE_SYMBOL = [_joined([(1, 1), (0, 1), (1, 1), (s, 8)]) for s in range(256)]


def _write_code(lengths: np.ndarray) -> list[Part]:
    used = _places(lengths)
    if len(used) <= 1 and (not len(used) or used[0] < 256):
        return [_ONE_SYMBOL[int(used[0]) if len(used) else 0]]
    if len(used) == 2 and used[1] < 256:
        return [(1, 1), (1, 1), (1, 1), (int(used[0]), 8), (int(used[1]), 8)]
    # steps: lengths as they are, runs of zeros by 17 and 18; what follows the last length is left out
    steps, before = [], -1  # with what a run adds to its least length above the lowest 5 bits
    for s, n in zip(used.tolist(), lengths[used].tolist(), strict=True):
        gap, before = s - before - 1, s
        if gap:
            many, rest = divmod(gap, 138)
            steps += [127 << 5 | 18] * many
            if rest >= 11:
                steps.append(rest - 11 << 5 | 18)
            elif rest >= 3:
                steps.append(rest - 3 << 5 | 17)
            else:
                steps += [0] * rest
        steps.append(n)
    counts = [0] * 19
    for x in steps:
        counts[x & 31] += 1
    kinds = [k for k in range(19) if counts[k]]
    first = dict(zip(kinds, _depths([counts[k] for k in kinds], 7), strict=True))
    out = [(0, 1), (15, 4), *((first.get(k, 0), 3) for k in _ORDER)]
    size = len(steps)
    k = max(1, -(-max(1, (size - 2).bit_length()) // 2))
    out += [(1, 1), (k - 1, 3), (size - 2, 2 * k)]  # there are two steps at least: a symbol alone is below 256 or comes after zeros
    code, v, before = {}, 0, 0  # canonical, the first bit lowest; a kind alone takes none
    for n, k in sorted((n, k) for k, n in first.items()):
        v <<= n - before
        code[k] = (_FLIPS[n][v], n) if len(kinds) > 1 else (0, 0)
        v, before = v + 1, n
    word = {}
    for x in set(steps):
        v, size = code[x & 31]
        n = size + (0 if x < 17 else 3 if x & 31 == 17 else 7)
        word[x] = f"{v | x >> 5 << size:0{n}b}" if n else ""
    steps.reverse()
    written = "".join([word[x] for x in steps])
    return [_joined(out), (int(written or "0", 2), len(written))]


def _packed(word: np.ndarray, used: np.ndarray) -> Part:
    """Numbers one after the other, each with as many bits as it uses, 62 at most."""
    if not len(used):
        return 0, 0
    end = used.cumsum()
    begin = end - used
    place, low = begin >> 6, begin & 63
    head = np.concatenate(([0], _places(place[1:] != place[:-1]) + 1))
    out = np.zeros((int(end[-1]) >> 6) + 2, np.int64)
    out[place[head]] = np.bitwise_or.reduceat(word << low, head)
    over = _places(low + used > 64)
    out[place[over] + 1] |= word[over] >> (64 - low[over])
    return int.from_bytes(out.astype("<i8").tobytes(), "little"), int(end[-1])


def _prefix(value: int) -> tuple[int, int, int]:
    """Prefix code, extra value and extra bits of a length or distance code of 1 and more."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    n = v.bit_length() - 2
    return 2 * n + 2 + (v >> n & 1), v & ((1 << n) - 1), n


def _prefixes(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``_prefix`` for arrays."""
    if value.max() <= 4096:
        code, extra, n = _small_prefixes()
        return code[value], extra[value], n[value]
    return _any_prefixes(value)


@lru_cache(maxsize=1)
def _small_prefixes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _any_prefixes(np.maximum(1, np.arange(4097)))


def _any_prefixes(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    v = value - 1
    n = np.maximum(np.frexp(v.astype(np.float64))[1] - 2, 0)
    return np.where(v < 4, v, 2 * n + 2 + (v >> n & 1)), np.where(v < 4, 0, v & (np.left_shift(1, n) - 1)), np.where(v < 4, 0, n)


#: Pixels by which a reference is found, and the fewest that it copies.
GRAM = 8
_FAR = (1 << 20) - 121


def _references(argb: np.ndarray, varied: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, length, distance) of stretches that are copied from where their pixels stood before, in order and apart.

    ``varied``: the bits that aren't the same in all pixels.
    """
    n = len(argb)
    none = np.zeros(0, np.int64)
    if n < 2 * GRAM:
        return none, none, none
    # each pixel's gram as one, two or four numbers, according to the bytes that vary
    each = 4 if varied & 0xFFFF0000 else 2 if varied & 0xFF else 1
    flat = np.zeros(n, f"<u{each}")
    flat[:] = (argb >> np.uint32(8) if each == 1 else argb).astype(flat.dtype)
    words = [np.ndarray(n - GRAM + 1, "<u8", flat, 8 * k, (each,)).astype(np.uint64) for k in range(each * GRAM // 8)]
    key = words[0] * np.uint64(0x9E3779B97F4A7C15)
    for w in words[1:]:
        key = (key ^ (key >> np.uint64(29)) ^ w) * np.uint64(0x9E3779B97F4A7C15)
    # the hash's upper bits and the place in one number: sorting that is cheaper than sorting places by hash
    low = np.uint64((1 << n.bit_length()) - 1)
    order = np.sort(key & ~low | np.arange(n - GRAM + 1, dtype=np.uint64))
    same = _places((order[1:] ^ order[:-1]) <= low)
    order = (order & low).astype(np.int64)
    at, source = order[same + 1], order[same]
    alike = at - source <= _FAR
    for w in words:  # hashes only find candidates
        alike &= w[at] == w[source]
    far = np.zeros(n, np.int64)
    far[at[alike]] = at[alike] - source[alike]
    found = _places(far)
    if not len(found):
        return none, none, none
    # a stretch goes on while its distance stays
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1] + 1) | (far[found[1:]] != far[found[:-1]])
    head = _places(new)
    end = found[np.append(head[1:], len(found)) - 1] + GRAM
    begin = np.maximum(found[head], np.concatenate(([0], end[:-1])))
    size, back = end - begin, far[found[head]]
    good = size >= GRAM
    begin, size, back = begin[good], size[good], back[good]
    if not len(size) or size.max() <= 4096:
        return begin, size, back
    parts = -(-size // 4096)  # the most that one reference copies
    k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    return np.repeat(begin, parts) + 4096 * k, np.minimum(4096, np.repeat(size, parts) - 4096 * k), np.repeat(back, parts)


def _bulk(argb: np.ndarray, cache_bits: int = 0, main: bool = False, references: bool = True) -> list[Part]:
    """An entropy-coded image with one group of codes and references, by arrays."""
    n = len(argb)
    out = [(1, 1), (cache_bits, 4)] if cache_bits else [(0, 1)]
    if main:
        out.append((0, 1))
    varied = int(np.bitwise_or.reduce(argb ^ argb[0]))
    if not varied:
        return out + [_ONE_SYMBOL[int(argb[0]) >> shift & 255] for shift in (8, 16, 0, 24)] + [_ONE_SYMBOL[0]]
    begin, size, back = _references(argb if references else argb[:0], varied)
    at = np.arange(n)  # pixels and references, by their first pixel
    if len(begin):
        inside = np.zeros(n + 1, np.int8)  # stretches lie apart, but may touch
        inside[begin] = 1
        inside[begin + size] -= 1
        covered = np.cumsum(inside[:n], dtype=np.int8).view(bool)
        covered[begin] = False
        at = _places(~covered)
    px = argb[at].astype(np.int64)
    green = px >> 8 & 255
    if cache_bits:
        slot = ((argb.astype(np.uint32) * np.uint32(_HASH)) >> np.uint32(32 - cache_bits)).astype(np.uint16)
        order = np.argsort(slot, kind="stable")
        hit = np.zeros(n, bool)
        hit[order[1:]] = (slot[order[1:]] == slot[order[:-1]]) & (argb[order[1:]] == argb[order[:-1]])
        green = np.where(hit[at], 280 + slot[at].astype(np.int64), green)
    if len(begin):
        copy, length, far = np.searchsorted(at, begin), _prefixes(size), _prefixes(back + 120)
        green[copy] = 256 + length[0]
    coded = [(green, 280 + (1 << cache_bits if cache_bits else 0))]
    literal = _places(green < 256)
    own = px if len(literal) == len(px) else px[literal]
    for shift in (16, 0, 24):
        coded.append(((own if varied >> shift & 255 else own[:1]) >> shift & 255, 256))
    coded.append((far[0] if len(begin) else at[:0], 40))
    # each token's bits as one number: a pixel's four codes, or a reference's with their extra bits
    codes = []
    for v, m in coded:
        if not len(v) or (v[0] < 256 and v[0] == v[-1] and (v == v[0]).all()):
            codes.append(None)
            out.append(_ONE_SYMBOL[int(v[0]) if len(v) else 0])
            continue
        lengths = _huffman(np.bincount(v, minlength=m))
        out += _write_code(lengths)
        if np.count_nonzero(lengths) == 1:
            codes.append(None)
        else:
            codes.append((_code_values(lengths)[v], lengths[v]))
    word, used = codes[0] or (np.zeros(len(at), np.int64), np.zeros(len(at), np.int64))
    for own in codes[1:4]:
        if own:
            word[literal] |= own[0] << used[literal]
            used[literal] += own[1]
    if len(begin):
        for v, w in (length[1:], codes[4] or (0, 0), far[1:]):
            word[copy] |= v << used[copy]
            used[copy] += w
    out.append(_packed(word, used))
    return out


def encode(rgba: np.ndarray, **wanted) -> bytes:
    """A lossless WebP file of pixels (height, width, RGBA); see ``encode_argb``."""
    height, width, _ = rgba.shape
    argb = np.ascontiguousarray(rgba[:, :, [3, 0, 1, 2]]).view(">u4").reshape(-1).astype(np.uint32)
    return encode_argb(argb, width, height, **wanted)


def encode_argb(argb: np.ndarray, width: int, height: int, *, palette: bool = False, predictor: bool = False, cross: bool = False, cache_bits: int = 0, references: bool = True) -> bytes:
    """A lossless WebP file with Huffman codes, and what else is asked for.

    Predictors are chosen by block among _TRIED, cross-colour's multiplier of blue by
    green for the whole image; a palette needs at most 256 colours.
    """
    out, w = _head(width, height), width
    if palette:
        if ((argb ^ argb[0]) & 0xFFFF00FF).any():
            table, index = np.unique(argb, return_inverse=True)
        else:  # only green differs
            green = argb >> 8 & 255
            seen = np.bincount(green, minlength=256) > 0
            table, index = argb[0] & np.uint32(0xFFFF00FF) | _places(seen).astype(np.uint32) << 8, (np.cumsum(seen) - 1)[green]
        pack = _pack_bits(len(table))
        delta = _channels(table)
        delta[1:] -= delta[:-1].copy()
        out += [(1, 1), (3, 2), (len(table) - 1, 8), *_bulk(_number(delta))]
        w = -(-width >> pack)
        if pack:
            wide = np.zeros((height, w << pack), np.int64)
            wide[:, :width] = index.reshape(height, width)
            index = (wide.reshape(height, w, 1 << pack) << (np.arange(1 << pack) * (8 >> pack))).sum(2).reshape(-1)
        argb = (0xFF000000 | index << 8).astype(np.uint32)
    if cross:
        x, y = ((argb >> shift & 255).astype(np.uint8).view(np.int8).astype(np.int64) for shift in (8, 0))
        slope = int(np.clip(np.round(32 * (x @ y) / max(1, x @ x)), -128, 127)) & 255
        k = 9
        elements = np.full(-(-w >> k) * -(-height >> k), 0xFF000000 | slope << 8, np.uint32)
        argb = _apply_cross(argb, elements, k, w, height, True)
        out += [(1, 1), (1, 2), (k - 2, 3), *_bulk(elements)]
    if predictor:
        k = 7
        some = _varied(argb, 0xFF000000, height, w)
        rows, cols = -(-height >> k), -(-w >> k)
        cost = []
        for kind in _TRIED:
            rest = some[1] - _guess(kind, some[1]) if some else np.zeros((height, w, 1), np.int16)
            rest = np.abs(rest.astype(np.int8)).reshape(height, -1)
            for axis, step in ((0, 1 << k), (1, rest.shape[1] // w << k)):  # sums by block
                rest = np.add.reduceat(rest, np.arange(0, rest.shape[axis], step), axis, np.int64)
            cost.append(rest)
        modes = np.array(_TRIED)[np.argmin(cost, 0)].reshape(rows, cols)
        argb = _predicted(argb, modes, k, w, height, True)
        out += [(1, 1), (0, 2), (k - 2, 3), *_bulk((0xFF000000 | modes.reshape(-1) << 8).astype(np.uint32))]
    out += [(0, 1), *_bulk(argb, cache_bits, True, references)]
    return _file(out)


def _write_pixels(argb: np.ndarray, width: int, height: int, main: bool, cache_bits: int = 0, meta_bits: int = 0) -> list[Part]:
    out = [(1, 1), (cache_bits, 4)] if cache_bits else [(0, 1)]
    groups, group = 1, lambda i: 0
    if main and meta_bits:
        mw, mh = -(-width >> meta_bits), -(-height >> meta_bits)
        pick = np.arange(mw * mh) % 2  # two code groups, in turns
        groups = int(pick.max()) + 1
        out += [(1, 1), (meta_bits - 2, 3), *_write_pixels((pick << 8).astype(np.uint32), mw, mh, False)]
        group = lambda i: int(pick[(i // width >> meta_bits) * mw + (i % width >> meta_bits)])
    elif main:
        out.append((0, 1))
    px = argb.tolist()
    near = {max(1, x + y * width): k + 1 for k, (x, y) in reversed(list(enumerate(_NEAR)))}
    cache, seen, steps, i = [0] * (1 << cache_bits), {}, [], 0
    while i < len(px):
        at, n = seen.get(tuple(px[i : i + 3])), 0
        if at is not None and i + 3 <= len(px):
            while i + n < len(px) and n < 4096 and px[at + n] == px[i + n]:
                n += 1
        if n >= 3:
            back = i - at
            steps.append((group(i), "copy", _prefix(n), _prefix(near.get(back, back + 120))))
        else:
            n = 1
            slot = (_HASH * px[i] & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else 0
            if cache_bits and cache[slot] == px[i] and i:
                steps.append((group(i), "cache", slot, None))
            else:
                steps.append((group(i), "pixel", px[i], None))
        for k in range(i, i + n):
            seen[tuple(px[k : k + 3])] = k
            if cache_bits:
                cache[(_HASH * px[k] & 0xFFFFFFFF) >> (32 - cache_bits)] = px[k]
        i += n
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    counts = [[[0] * n for n in sizes] for _ in range(groups)]
    for g, kind, v, d in steps:
        c = counts[g]
        if kind == "pixel":
            for k, shift in ((0, 8), (1, 16), (2, 0), (3, 24)):
                c[k][v >> shift & 255] += 1
        elif kind == "cache":
            c[0][280 + v] += 1
        else:
            c[0][256 + v[0]] += 1
            c[4][d[0]] += 1
    lengths = [[_huffman(np.array(c)) for c in group_] for group_ in counts]
    for group_ in lengths:
        for one in group_:
            out += _write_code(one)
    table = [[_codes(one) for one in group_] for group_ in lengths]
    for g, kind, v, d in steps:
        t = table[g]
        if kind == "pixel":
            out += [t[k][v >> shift & 255] for k, shift in ((0, 8), (1, 16), (2, 0), (3, 24))]
        elif kind == "cache":
            out.append(t[0][280 + v])
        else:
            out += [t[0][256 + v[0]], (v[1], v[2]), t[4][d[0]], (d[1], d[2])]
    return out


def encode_full(rgba: np.ndarray, *, predictor: bool = False, cross: bool = False, green: bool = False, palette: bool = False, cache_bits: int = 0, meta_bits: int = 0, seed: int = 0) -> bytes:
    """A file that uses the named parts of the format; predictor modes and cross-colour elements are drawn at random."""
    height, width, _ = rgba.shape
    rng = np.random.default_rng(seed)
    argb = np.ascontiguousarray(rgba[:, :, [3, 0, 1, 2]]).view(">u4").reshape(-1).astype(np.uint32)
    out, w = _head(width, height), width
    if palette:
        table = np.unique(argb)
        if len(table) > 256:
            raise ValueError("a palette holds 256 colours")
        pack = _pack_bits(len(table))
        delta = _channels(table)
        delta[1:] -= delta[:-1].copy()
        out += [(1, 1), (3, 2), (len(table) - 1, 8), *_write_pixels(_number(delta), len(table), 1, False)]
        index = np.searchsorted(table, argb).reshape(height, width)
        w = -(-width >> pack)
        wide = np.zeros((height, w << pack), np.int64)
        wide[:, :width] = index
        packed = (wide.reshape(height, w, 1 << pack) << (np.arange(1 << pack) * (8 >> pack))).sum(2)
        argb = (0xFF000000 | packed.reshape(-1) << 8).astype(np.uint32)
    if green:
        argb = _apply_green(argb, -1)
        out += [(1, 1), (2, 2)]
    if cross:
        k = 2
        elements = _number(np.append(np.full((-(-w >> k) * -(-height >> k), 1), 255), rng.integers(0, 256, (-(-w >> k) * -(-height >> k), 3)), 1))
        argb = _apply_cross(argb, elements, k, w, height, True)
        out += [(1, 1), (1, 2), (k - 2, 3), *_write_pixels(elements, -(-w >> k), -(-height >> k), False)]
    if predictor:
        k = 2
        modes = (rng.permutation(-(-w >> k) * -(-height >> k)) % 14 << 8).astype(np.uint32)
        argb = _apply_predictor(argb, modes, k, w, height, True)
        out += [(1, 1), (0, 2), (k - 2, 3), *_write_pixels(modes, -(-w >> k), -(-height >> k), False)]
    out += [(0, 1), *_write_pixels(argb, w, height, True, cache_bits, meta_bits)]
    return _file(out)
