"""Media columns: lossless WebP, written and read on whole Arrow batches.

The format (RIFF container, VP8L bit stream) is the public one: prefix codes, length and
distance pairs, a colour cache, and the predictor, cross-colour, subtract-green and palette
transforms. The reader takes any such stream. Two of its parts decode pixels: a scalar loop
that knows everything, and a lockstep decoder that advances thousands of images by one pixel
per step with array operations, for streams of one group of codes in which green, red
and blue fit 32 bits together. The long images of a batch finish in the scalar loop, once too
few are left to fill an array.

The writer finds cached colours and repeats of four pixels by sorting, for all images of a
batch at once, so it does not depend on which images share a batch. Code lengths come from
giving every symbol that occurs one leaf, dealing the other leaves out in proportion, and
spending what is left over on the most frequent symbols of each length: complete codes of
bounded length. It uses the palette where few colours make up an image. Predictor, cross-colour
and subtract-green only ever lengthen text, whose neighbouring bytes are no gradients: they are
written on request, and the reader inverts them in whatever stream it is given.

Text as an image: three bytes a pixel, 64 pixels a row, padded by spaces.

Defined cases: a null text is empty: one row of spaces; a text beyond 16,384 rows gets wider
rows, and a chunk PLEN keeps its length; beyond 16,384 x 16,384 pixels (805 MB) a ValueError
says so; a damaged stream raises ValueError; rows are written one by one, so repeated ids and
rows give equal values; an empty table gives no rows; other columns may have any names.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowmill.llm.common import batches, flat, text_of

ROW, PAD = 192, 32
CACHE_BITS = 7
#: Longest green, red, blue, alpha and distance codes that the writer makes.
LONGEST = (11, 10, 10, 8, 10)
#: Images per lockstep batch at most, and images below which the scalar loop takes over.
LANES, FEW = 2048, 64
#: Images that are written at once: few enough for a processor's cache.
TOGETHER = 64
_HASH = 0x1E35A7BD
#: Bits of a pixel's place in a batch of images; image and cache slot take 13 more.
_PLACE = np.uint64(40)
_MIN_COPY, _MAX_COPY, _WINDOW = 4, 4096, (1 << 20) - 120

# Fixed values of the format: the order in which lengths of the code-length code are stored.
_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
# Fixed values of the format: the neighbours (x, y) that distance codes 1 to 120 stand for.
_NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2),
    (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0),
    (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4),
    (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3),
    (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4),
    (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7),
    (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)

_REV16 = np.zeros(1 << 16, np.uint32)
for _i in range(16):
    _REV16 |= ((np.arange(1 << 16, dtype=np.uint32) >> _i) & 1) << (15 - _i)


# ---------------------------------------------------------------- codes


def code_lengths(hist: np.ndarray, longest: int) -> np.ndarray:
    """Lengths of complete prefix codes, one row of counts each; a single symbol gets 0 bits
    (marked by no length at all), as the format has it."""
    used = hist > 0
    n = used.sum(axis=1)
    order = np.argsort(-hist, axis=1, kind="stable")[:, : max(1, int(n.max()))]
    c = np.take_along_axis(hist, order, 1)
    leaves, total = 1 << longest, np.maximum(1, hist.sum(axis=1))[:, None]
    units = np.where(c > 0, 1 + (leaves - n[:, None]) * c // total, 0)
    length = np.where(c > 0, longest + 1 - np.frexp(np.maximum(units, 1).astype(np.float64))[1], 0)
    length[n < 2] = 0
    spare = np.where(n > 1, leaves - ((1 << (longest - length)) * (length > 0)).sum(axis=1), 0)
    while spare.any():
        rows = np.flatnonzero(spare)
        part, left = length[rows], spare[rows]
        for bits in range(2, longest + 1):
            at = part == bits
            k = left >> (longest - bits)
            up = at & (np.cumsum(at, axis=1) <= k[:, None])
            left -= up.sum(axis=1) << (longest - bits)
            part[up] -= 1
        length[rows], spare[rows] = part, left
    out = np.zeros(hist.shape, np.uint8)
    np.put_along_axis(out, order, length.astype(np.uint8), 1)
    return out


def codes(length: np.ndarray) -> np.ndarray:
    """The canonical codes of rows of lengths, bits reversed: first bit lowest."""
    out = np.zeros(length.shape, np.uint32)
    first = np.zeros(len(length), np.int64)
    for bits in range(1, int(length.max()) + 1 if length.size else 1):
        at = length == bits
        first <<= 1
        code = first[:, None] + np.cumsum(at, axis=1) - 1
        out[at] = _REV16[code[at]] >> (16 - bits)
        first += at.sum(axis=1)
    return out


def tables(length: np.ndarray, bits: int, single: np.ndarray) -> np.ndarray:
    """Rows of 2**bits entries symbol * 16 + length, by the next `bits` bits of a stream."""
    n, size = len(length), 1 << bits
    order = np.argsort(np.where(length > 0, length, 99), axis=1, kind="stable")
    ln = np.take_along_axis(length, order, 1).astype(np.int64)
    many = np.where(ln > 0, 1 << (bits - np.minimum(ln, bits)), 0)
    lone = ~(length > 0).any(axis=1)
    many[lone, 0], order[lone, 0] = size, single[lone]
    if (many.sum(axis=1) != size).any():
        raise ValueError("an incomplete prefix code")
    flat_ = np.repeat((order * 16 + ln).reshape(-1).astype(np.uint32), many.reshape(-1)).reshape(n, size)
    return flat_[:, _REV16[np.arange(size)] >> (16 - bits)]


# ---------------------------------------------------------------- writing

# The code for code lengths: fixed, complete, for lengths 0 to 11 and both runs of zeros.
_CL = {17: 3, 18: 3, 0: 3, 6: 3, 7: 3, 8: 3, 9: 4, 10: 4, 4: 5, 5: 5, 11: 5, 3: 6, 1: 7, 2: 7}


def _bits(value: int, n: int) -> str:
    return format(value, f"0{n}b")[::-1] if n else ""


def _cl_tokens() -> tuple[str, dict[bytes, str]]:
    row = np.zeros((1, 19), np.uint8)
    for s, n in _CL.items():
        row[0, s] = n
    code = {s: _bits(int(codes(row)[0, s]), n) for s, n in _CL.items()}
    stored = 15
    head = "0" + _bits(stored - 4, 4) + "".join(_bits(_CL.get(s, 0), 3) for s in _ORDER[:stored]) + "0"
    out = {bytes([s]): code[s] for s in range(12)}
    out |= {bytes(n): code[17] + _bits(n - 3, 3) for n in range(3, 11)}
    out |= {bytes(n): code[18] + _bits(n - 11, 7) for n in range(11, 139)}
    return head, out


_CL_HEAD, _CL_TOKENS = _cl_tokens()
_CL_FIND = re.compile(rb"\x00{3,138}|[\x00-\x0b]").findall


def _code_header(length: np.ndarray, symbol: int) -> str:
    """Bits that store one prefix code; without lengths, the only symbol."""
    if length.any():
        return _CL_HEAD + "".join(map(_CL_TOKENS.__getitem__, _CL_FIND(length.tobytes())))
    return "10" + ("0" + _bits(symbol, 1) if symbol < 2 else "1" + _bits(symbol, 8))


def _prefix(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbol, extra bits and their number for lengths or distances v >= 1."""
    v = v.astype(np.int64) - 1
    top = np.maximum(np.frexp(v.astype(np.float64))[1].astype(np.int64) - 1, 0)
    extra = np.where(v < 2, 0, top - 1)
    extra = np.maximum(extra, 0)
    sym = np.where(v < 2, v, 2 * top + ((v >> extra) & 1))
    return sym, v & ((1 << extra) - 1), extra


def _copies(pix: np.ndarray, img: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and distance of copies that do not overlap, for all images at once."""
    n, none = len(pix), (np.zeros(0, np.int64),) * 3
    if n < _MIN_COPY:
        return none
    m = n - _MIN_COPY + 1
    h = img[:m].astype(np.uint64)
    for t in range(_MIN_COPY):
        h = (h ^ pix[t : t + m]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    s = np.sort((h & ~np.uint64(0xFFFFFF)) | np.arange(m, dtype=np.uint64))
    same = np.flatnonzero((s[1:] >> np.uint64(24)) == (s[:-1] >> np.uint64(24)))
    at, before = (s[same + 1] & np.uint64(0xFFFFFF)).astype(np.int64), (s[same] & np.uint64(0xFFFFFF)).astype(np.int64)
    ok = (img[at] == img[before]) & (left[at] >= _MIN_COPY) & (left[before] >= _MIN_COPY) & (at - before <= _WINDOW)
    for t in range(_MIN_COPY):
        ok &= pix[at + t] == pix[before + t]
    dist = np.zeros(m + 1, np.int64)
    dist[at[ok]] = at[ok] - before[ok]
    edge = np.flatnonzero(np.diff(dist, prepend=0))
    start, end = edge, np.append(edge[1:], m)
    keep = dist[start] > 0
    start, end = start[keep], end[keep] + _MIN_COPY - 1
    if not len(start):
        return none
    start = np.maximum(start, np.append(0, end[:-1]))  # none of a run's pixels is copied twice
    d, size = dist[np.maximum(edge[keep], 0)], end - start
    keep = size >= _MIN_COPY
    start, size, d = start[keep], size[keep], d[keep]
    if len(size) and size.max() > _MAX_COPY:
        k = -(-size // _MAX_COPY)
        part = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        start, size, d = np.repeat(start, k) + part * _MAX_COPY, np.minimum(np.repeat(size, k) - part * _MAX_COPY, _MAX_COPY), np.repeat(d, k)
    return start, size, d


def entropy_coded(images: list[np.ndarray], main: bool, heads: list[str] | None = None, cache_bits: int = CACHE_BITS) -> list[bytes]:
    """Each image's codes and pixels as bytes, after its bits of `heads`."""
    n = np.array([len(x) for x in images])
    offs = np.concatenate([[0], np.cumsum(n)])
    pix = np.concatenate(images).astype(np.uint32)
    img = np.repeat(np.arange(len(images)), n)
    left = np.repeat(offs[1:], n) - np.arange(len(pix))
    # cached colours: the last pixel before this one in the same slot has the same colour
    slot = ((pix.astype(np.uint64) * np.uint64(_HASH)) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - cache_bits)
    s = np.sort((((img.astype(np.uint64) << np.uint64(cache_bits)) | slot) << _PLACE) | np.arange(len(pix), dtype=np.uint64))
    place = (s & ((np.uint64(1) << _PLACE) - np.uint64(1))).astype(np.int64)
    cached = np.zeros(len(pix), bool)
    cached[place[1:]] = ((s[1:] >> _PLACE) == (s[:-1] >> _PLACE)) & (pix[place[1:]] == pix[place[:-1]])
    start, size, dist = _copies(pix, img, left)
    kind = np.where(cached, 1, 0).astype(np.int8)  # 0 literal, 1 cached, 2 copy, 3 inside a copy
    if len(start):
        cover = np.zeros(len(pix) + 1, np.int32)
        np.add.at(cover, start, 1)
        np.add.at(cover, start + size, -1)
        kind[np.cumsum(cover[:-1]) > 0] = 3
        kind[start] = 2
    lsym, lextra, lbits = _prefix(size)
    dsym, dextra, dbits = _prefix(dist + 120)
    g, r, b, a = (pix >> np.uint32(8)) & np.uint32(255), (pix >> np.uint32(16)) & np.uint32(255), pix & np.uint32(255), pix >> np.uint32(24)
    green = g.astype(np.int64)
    hit = kind == 1
    green[hit] = 280 + slot[hit].astype(np.int64)
    green[start] = 256 + lsym
    told, lit = kind != 3, kind == 0
    wide = 280 + (1 << cache_bits)
    count = lambda i, v, w: np.bincount(i * w + v.astype(np.int64), minlength=len(images) * w).reshape(len(images), w)
    hists = [count(img[told], green[told], wide), *(count(img[lit], c[lit], 256) for c in (r, b, a)), count(img[start], dsym, 40)]
    lengths = [code_lengths(h, x) for h, x in zip(hists, LONGEST)]
    code = [codes(x) for x in lengths]
    only = [h.argmax(axis=1) for h in hists]
    # entries of bits: one a token, a second for the distance of a copy or for alpha
    varied = lengths[3].any()
    second = (kind == 2) | (lit if varied else False)
    token = np.flatnonzero(told)
    many = 1 + second[token].astype(np.int64)
    where = np.cumsum(many) - many
    value, bits = np.zeros(int(many.sum()), np.uint64), np.zeros(int(many.sum()), np.int64)
    ti = img[token]
    v, nb = code[0][ti, green[token]].astype(np.uint64), lengths[0][ti, green[token]].astype(np.int64)
    l_at = np.flatnonzero(lit[token])
    p = token[l_at]
    for ch, c in ((1, r), (2, b)):
        v[l_at] |= code[ch][img[p], c[p]].astype(np.uint64) << nb[l_at].astype(np.uint64)
        nb[l_at] += lengths[ch][img[p], c[p]]
    c_at = np.flatnonzero(kind[token] == 2)
    v[c_at] |= lextra.astype(np.uint64) << nb[c_at].astype(np.uint64)
    nb[c_at] += lbits
    value[where], bits[where] = v, nb
    w = where[c_at] + 1
    dn = lengths[4][img[start], dsym].astype(np.int64)
    value[w] = code[4][img[start], dsym].astype(np.uint64) | (dextra.astype(np.uint64) << dn.astype(np.uint64))
    bits[w] = dn + dbits
    if varied:
        w = where[l_at] + 1
        value[w], bits[w] = code[3][img[p], a[p]], lengths[3][img[p], a[p]]
    # each image starts at a 32-bit word of its own
    header = []
    for i in range(len(images)):
        h = (heads[i] if heads else "") + "1" + _bits(cache_bits, 4) + ("0" if main else "")
        header.append(h + "".join(_code_header(lengths[c][i], int(only[c][i])) for c in range(5)))
    hbits = np.array([len(h) for h in header])
    entry_img = np.repeat(ti, many)
    ends = np.cumsum(bits)
    last = np.searchsorted(entry_img, np.arange(len(images)), "right")
    upto = np.concatenate([[0], ends])[last]
    body = np.diff(np.concatenate([[0], upto]))
    word = np.concatenate([[0], np.cumsum((hbits + body + 63) // 32 + 1)])
    at = ends - bits - (upto - body)[entry_img] + hbits[entry_img] + word[entry_img] * 32
    out = np.zeros(int(word[-1]) + 2, np.uint64)
    w, sh = at >> 5, (at & 31).astype(np.uint64)
    both = value << sh
    head = np.flatnonzero(np.diff(w, prepend=-1))
    low = np.add.reduceat(both & np.uint64(0xFFFFFFFF), head)
    high = np.add.reduceat(both >> np.uint64(32), head)
    out[w[head]] += low
    out[w[head] + 1] += high
    raw = (out & np.uint64(0xFFFFFFFF)).astype("<u4").view(np.uint8)
    streams = []
    for i, h in enumerate(header):
        x = int(h[::-1], 2).to_bytes((len(h) + 7) // 8, "little")
        z = raw[int(word[i]) * 4 : int(word[i]) * 4 + (int(hbits[i] + body[i]) + 7) // 8].copy()
        z[: len(x)] |= np.frombuffer(x, np.uint8)
        streams.append((z.tobytes(), int(hbits[i] + body[i])))
    return streams


def _as_bits(stream: tuple[bytes, int]) -> str:
    data, n = stream
    return format(int.from_bytes(data, "little"), f"0{len(data) * 8}b")[::-1][:n]


def container(vp8l: bytes, extra: bytes = b"") -> bytes:
    body = b"WEBPVP8L" + struct.pack("<I", len(vp8l)) + vp8l + b"\0" * (len(vp8l) & 1) + extra
    return b"RIFF" + struct.pack("<I", len(body)) + body


def _shape_bits(w: int, h: int, alpha: bool) -> str:
    if not (1 <= w <= 16384 and 1 <= h <= 16384):
        raise ValueError(f"{w} x {h} pixels are more than the format holds")
    return _bits(0x2F, 8) + _bits(w - 1, 14) + _bits(h - 1, 14) + str(int(alpha)) + "000"


def encode_images(images: list[tuple[int, int, np.ndarray]], transforms: list[tuple] | None = None) -> list[bytes]:
    """VP8L streams of (width, height, argb); transforms: for each image names out of
    "palette", "predictor", "cross", "green", in the order of application."""
    heads, bodies = [], []
    for i, (w, h, pix) in enumerate(images):
        head = _shape_bits(w, h, bool((pix >> 24 != 255).any()))
        for name in transforms[i] if transforms else ():
            more, w, pix = _FORWARD[name](w, h, pix)
            head += "1" + more
        heads.append(head + "0")
        bodies.append(pix)
    return [x[0] for x in entropy_coded(bodies, True, heads)]


# ---------------------------------------------------------------- transforms


def _channels(pix: np.ndarray) -> np.ndarray:
    """alpha, red, green, blue as rows of int64."""
    return np.array([(pix >> np.uint32(s)) & np.uint32(255) for s in (24, 16, 8, 0)], np.int64)


def _join(c: np.ndarray) -> np.ndarray:
    c = (c & 255).astype(np.uint32)
    return (c[0] << np.uint32(24)) | (c[1] << np.uint32(16)) | (c[2] << np.uint32(8)) | c[3]


def _forward_green(w, h, pix):
    c = _channels(pix)
    c[1] -= c[2]
    c[3] -= c[2]
    return _bits(2, 2), w, _join(c)


def _inverse_green(w, h, pix):
    c = _channels(pix)
    c[1] += c[2]
    c[3] += c[2]
    return _join(c)


def _forward_palette(w, h, pix):
    table, index = np.unique(pix, return_inverse=True)
    if len(table) > 256:
        raise ValueError("a palette has at most 256 colours")
    delta = _join(_channels(table) - np.concatenate([np.zeros((4, 1), np.int64), _channels(table)[:, :-1]], axis=1))
    shift = _shift(len(table))
    packed = -(-w // (1 << shift))
    grid = np.zeros((h, packed << shift), np.uint32)
    grid[:, :w] = index.reshape(h, w)
    each = 8 >> shift
    grid = grid.reshape(h, packed, 1 << shift) << (np.arange(1 << shift, dtype=np.uint32) * np.uint32(each))
    green = grid.sum(axis=2, dtype=np.uint32).reshape(-1)
    return _bits(3, 2) + _bits(len(table) - 1, 8) + _as_bits(entropy_coded([delta], False)[0]), packed, np.uint32(0xFF000000) | (green << np.uint32(8))


def _shift(colours: int) -> int:
    """Pixels that share one are 1 << this."""
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def _inverse_palette(w, h, pix, table):
    shift = _shift(len(table))
    each = 8 >> shift
    x = np.arange(w)
    green = ((pix.reshape(h, -1) >> np.uint32(8)) & np.uint32(255))[:, x >> shift]
    index = (green >> ((x & ((1 << shift) - 1)) * each).astype(np.uint32)) & np.uint32((1 << each) - 1)
    full = np.zeros(256, np.uint32)
    full[: len(table)] = table
    return full[index.reshape(-1)]


_BLOCK = 4  # blocks of 16 x 16 pixels


def _signed8(x):
    return (x.astype(np.int64) + 128) % 256 - 128


def _cross(c, m, w, h, bits, sign):
    """Applies (sign -1) or inverts (+1) cross-colour elements m on channels c."""
    y, x = np.divmod(np.arange(w * h), w)
    e = _channels(m)[:, (y >> bits) * ((w + (1 << bits) - 1) >> bits) + (x >> bits)]
    to_blue_red, to_blue, to_red = _signed8(e[1]), _signed8(e[2]), _signed8(e[3])
    g = _signed8(c[2])
    red_before = c[1]
    red = (c[1] + sign * ((to_red * g) >> 5)) & 255
    source = _signed8(red if sign > 0 else red_before)
    c = c.copy()
    c[3] = (c[3] + sign * ((to_blue * g) >> 5) + sign * ((to_blue_red * source) >> 5)) & 255
    c[1] = red
    return c


def _forward_cross(w, h, pix):
    nb = ((w + 15) >> _BLOCK) * ((h + 15) >> _BLOCK)
    k = np.arange(nb, dtype=np.uint32)
    m = np.uint32(0xFF000000) | ((k * np.uint32(7) & np.uint32(63)) << np.uint32(16)) | ((k * np.uint32(5) & np.uint32(31)) << np.uint32(8)) | np.uint32(240)
    return _bits(1, 2) + _bits(_BLOCK - 2, 3) + _as_bits(entropy_coded([m], False)[0]), w, _join(_cross(_channels(pix), m, w, h, _BLOCK, -1))


def _predict(mode: int, left, top, topright, topleft):
    """One pixel's prediction from its neighbours' four channels (tuples)."""
    z = range(4)
    avg = lambda p, q: tuple((p[i] + q[i]) // 2 for i in z)
    clip = lambda v: 0 if v < 0 else 255 if v > 255 else v
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return topright
    if mode == 4:
        return topleft
    if mode == 5:
        return avg(avg(left, topright), top)
    if mode == 6:
        return avg(left, topleft)
    if mode == 7:
        return avg(left, top)
    if mode == 8:
        return avg(topleft, top)
    if mode == 9:
        return avg(top, topright)
    if mode == 10:
        return avg(avg(left, topleft), avg(top, topright))
    if mode == 11:
        by_left = sum(abs(top[i] - topleft[i]) for i in z)
        by_top = sum(abs(left[i] - topleft[i]) for i in z)
        return left if by_left < by_top else top
    if mode == 12:
        return tuple(clip(left[i] + top[i] - topleft[i]) for i in z)
    if mode == 13:
        a = avg(left, top)
        return tuple(clip(a[i] + int((a[i] - topleft[i]) / 2)) for i in z)
    return (255, 0, 0, 0)


def _predictions(pix: list, i: int, w: int, mode: int):
    y, x = divmod(i, w)
    if y == 0:
        return pix[i - 1] if x else (255, 0, 0, 0)
    if x == 0:
        return pix[i - w]
    return _predict(mode, pix[i - 1], pix[i - w], pix[i - w + 1], pix[i - w - 1])


def _forward_predictor(w, h, pix):
    wide = (w + 15) >> _BLOCK
    nb = wide * ((h + 15) >> _BLOCK)
    modes = np.arange(nb) % 14
    c = _channels(pix)
    px = list(zip(*c.tolist()))
    guess = np.array([_predictions(px, i, w, int(modes[(i // w >> _BLOCK) * wide + (i % w >> _BLOCK)])) for i in range(w * h)], np.int64).T
    sub = np.uint32(0xFF000000) | (modes.astype(np.uint32) << np.uint32(8))
    return _bits(0, 2) + _bits(_BLOCK - 2, 3) + _as_bits(entropy_coded([sub], False)[0]), w, _join(c - guess)


def _inverse_predictor(w, h, pix, sub, bits):
    wide = (w + (1 << bits) - 1) >> bits
    modes = ((sub >> np.uint32(8)) & np.uint32(15)).tolist()
    rest = list(zip(*_channels(pix).tolist()))
    out: list = []
    for i in range(w * h):
        out.append(None)
        # the right neighbour above a row's last pixel is the row's own first pixel
        g = _predictions(out, i, w, modes[(i // w >> bits) * wide + (i % w >> bits)])
        r = rest[i]
        out[i] = ((g[0] + r[0]) & 255, (g[1] + r[1]) & 255, (g[2] + r[2]) & 255, (g[3] + r[3]) & 255)
    return _join(np.array(out, np.int64).T)


_FORWARD = {"palette": _forward_palette, "predictor": _forward_predictor, "cross": _forward_cross, "green": _forward_green}


# ---------------------------------------------------------------- reading


class Bits:
    """A reader of bits, lowest first."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.end = data, 0, len(data) * 8

    def peek(self, n: int) -> int:
        p = self.at >> 3
        return (int.from_bytes(self.data[p : p + (n + 14 >> 3)], "little") >> (self.at & 7)) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        if self.at + n > self.end:
            raise ValueError("the stream ends early")
        v = self.peek(n)
        self.at += n
        return v


def _table(length: np.ndarray) -> tuple[int, list[int]]:
    bits = int(length.max())
    return bits, tables(length[None], bits, np.zeros(1, np.int64))[0].tolist()


_known: dict[tuple[int, int], tuple[int, list[int]]] = {}


def read_code(b: Bits, size: int) -> tuple[np.ndarray, int]:
    """Lengths of a stored prefix code and its only symbol, if it has one."""
    length = np.zeros(size, np.uint8)
    if b.read(1):
        two = b.read(1)
        first = b.read(8 if b.read(1) else 1)
        if not two:
            return length, first
        second = b.read(8)
        if first == second:
            return length, first
        length[[first, second]] = 1
        return length, 0
    many = 4 + b.read(4)
    key = (many, b.read(3 * many))
    if key not in _known:
        if len(_known) > 64:
            _known.clear()
        cl = np.zeros(19, np.uint8)
        cl[list(_ORDER[:many])] = [key[1] >> 3 * i & 7 for i in range(many)]
        _known[key] = (0, [int(cl.argmax()) * 16]) if (cl > 0).sum() == 1 else _table(cl)
    bits, table = _known[key]
    left = 2 + b.read(2 + 2 * b.read(3)) if b.read(1) else size
    data, at, mask, out, before = b.data, b.at, (1 << bits) - 1, bytearray(), 8
    while len(out) < size and left:
        left -= 1
        p = at >> 3
        v = int.from_bytes(data[p : p + 3], "little") >> (at & 7)
        e = table[v & mask]
        s, n = e >> 4, e & 15
        at += n
        if s < 16:
            out.append(s)
            if s:
                before = s
        elif s == 16:
            out += bytes([before]) * (3 + (v >> n & 3))
            at += 2
        elif s == 17:
            out += bytes(3 + (v >> n & 7))
            at += 3
        else:
            out += bytes(11 + (v >> n & 127))
            at += 7
    if len(out) > size or at > b.end:
        raise ValueError("a damaged prefix code")
    b.at = at
    length[: len(out)] = np.frombuffer(bytes(out), np.uint8)
    if (length > 0).sum() == 1:
        s = int(length.argmax())
        return np.zeros(size, np.uint8), s
    if not length.any():
        raise ValueError("an empty prefix code")
    return length, 0


def _value(sym: int, b: Bits) -> int:
    if sym < 4:
        return sym + 1
    n = (sym - 2) >> 1
    return ((2 + (sym & 1)) << n) + b.read(n) + 1


class Group:
    """The five codes of a group, as tables for the scalar loop."""

    def __init__(self, stored: list[tuple[np.ndarray, int]]) -> None:
        self.tables = [_table(length) if length.any() else (0, [only * 16]) for length, only in stored]
        self.masked = [((1 << bits) - 1, t) for bits, t in self.tables]


def scalar_pixels(b: Bits, w: int, n: int, groups: list[Group], which, cache_bits: int, out: list[int] | None = None, cache: list[int] | None = None) -> list[int]:
    """Pixels of a stream, from the one after `out` on; which: pixel to its group, or None."""
    out = [] if out is None else out
    cache = ([0] * (1 << cache_bits)) if cache is None else cache
    shift, data, at, end, number = 32 - cache_bits, b.data, b.at, b.end, int.from_bytes
    (gm, gt), (rm, rt), (bm, bt), (am, a_t), (dm, dt) = groups[0].masked
    while len(out) < n:
        if which is not None:
            (gm, gt), (rm, rt), (bm, bt), (am, a_t), (dm, dt) = groups[which[len(out)]].masked
        # the four codes of a literal have 60 bits at most
        v = number(data[at >> 3 : (at >> 3) + 9], "little") >> (at & 7)
        e = gt[v & gm]
        s, k = e >> 4, e & 15
        if s < 256:
            v >>= k
            e = rt[v & rm]
            v >>= e & 15
            f = bt[v & bm]
            v >>= f & 15
            h = a_t[v & am]
            at += k + (e & 15) + (f & 15) + (h & 15)
            new = h >> 4 << 24 | e >> 4 << 16 | s << 8 | f >> 4
        elif s >= 280:
            at += k
            if s - 280 >= len(cache) or not cache_bits:
                raise ValueError("no such cached colour")
            new = cache[s - 280]
        else:
            b.at = at + k
            size = _value(s - 256, b)
            e = dt[b.peek(15) & dm]
            b.at += e & 15
            d = _value(e >> 4, b)
            at = b.at
            if d > 120:
                d -= 120
            else:
                x, y = _NEAR[d - 1]
                d = max(1, x + y * w)
            first = len(out)
            if d > first or first + size > n:
                raise ValueError("a copy reaches beyond the image")
            out += out[first - d : first - d + size] if d >= size else [out[first - d + i % d] for i in range(size)]
            if cache_bits:
                for p in out[first:]:
                    cache[(_HASH * p & 0xFFFFFFFF) >> shift] = p
            continue
        if at > end:
            raise ValueError("the stream ends early")
        out.append(new)
        if cache_bits:
            cache[(_HASH * new & 0xFFFFFFFF) >> shift] = new
    b.at = at
    return out


def _stored_codes(b: Bits, cache_bits: int) -> list[tuple[np.ndarray, int]]:
    return [read_code(b, s) for s in (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)]


def _cache_bits(b: Bits) -> int:
    if not b.read(1):
        return 0
    n = b.read(4)
    if not 1 <= n <= 11:
        raise ValueError("a damaged colour cache")
    return n


def _small_image(b: Bits, w: int, h: int) -> np.ndarray:
    cb = _cache_bits(b)
    return np.array(scalar_pixels(b, w, w * h, [Group(_stored_codes(b, cb))], None, cb), np.uint32)


class Open:
    """A stream whose headers have been read; what is left are the main image's pixels."""

    def __init__(self, vp8l: bytes) -> None:
        self.b = b = Bits(vp8l)
        if b.read(8) != 0x2F:
            raise ValueError("not a lossless WebP stream")
        self.width, self.height = b.read(14) + 1, b.read(14) + 1
        if b.read(1) + b.read(3) > 1:
            raise ValueError("an unknown version")
        self.undo: list = []
        w, h, seen = self.width, self.height, set()
        while b.read(1):
            kind = b.read(2)
            if kind in seen:
                raise ValueError("a transform comes twice")
            seen.add(kind)
            if kind == 2:
                self.undo.append(lambda p, w=w: _inverse_green(w, h, p))
            elif kind == 3:
                size = b.read(8) + 1
                table = _join(np.cumsum(_channels(_small_image(b, size, 1)), axis=1))
                self.undo.append(lambda p, w=w, t=table: _inverse_palette(w, h, p, t))
                w = (w + (1 << _shift(size)) - 1) >> _shift(size)
            else:
                bits = b.read(3) + 2
                sub = _small_image(b, (w + (1 << bits) - 1) >> bits, (h + (1 << bits) - 1) >> bits)
                if kind == 0:
                    self.undo.append(lambda p, w=w, s=sub, n=bits: _inverse_predictor(w, h, p, s, n))
                else:
                    self.undo.append(lambda p, w=w, s=sub, n=bits: _join(_cross(_channels(p), s, w, h, n, 1)))
        self.coded_width, self.n = w, w * h
        self.cache_bits = _cache_bits(b)
        self.which = None
        if b.read(1):
            bits = b.read(3) + 2
            wide = (w + (1 << bits) - 1) >> bits
            meta = (_small_image(b, wide, (h + (1 << bits) - 1) >> bits) >> np.uint32(8)) & np.uint32(0xFFFF)
            y, x = np.divmod(np.arange(self.n), w)
            self.which = meta[(y >> bits) * wide + (x >> bits)].tolist()
            self.stored = [_stored_codes(b, self.cache_bits) for _ in range(int(meta.max()) + 1)]
        else:
            self.stored = [_stored_codes(b, self.cache_bits)]
        self.longest = [int(x.max()) for x, _ in self.stored[0]]

    def in_step(self) -> bool:
        g, r, b, a, d = self.longest
        return self.which is None and a == 0 and g <= LONGEST[0] and r <= LONGEST[1] and b <= LONGEST[2] and d <= LONGEST[4] and self.cache_bits == CACHE_BITS

    def finish(self, pix: np.ndarray) -> np.ndarray:
        for f in reversed(self.undo):
            pix = f(pix)
        return pix

    def scalar(self, out: list[int] | None = None, cache: list[int] | None = None) -> np.ndarray:
        return np.array(scalar_pixels(self.b, self.coded_width, self.n, [Group(s) for s in self.stored], self.which, self.cache_bits, out, cache), np.uint32)


_NEAR_X, _NEAR_Y = np.array([x for x, _ in _NEAR]), np.array([y for _, y in _NEAR])


def lockstep(streams: list[Open]) -> list[np.ndarray]:
    """Coded pixels of streams that are in_step(), one pixel of each image per step."""
    order = sorted(range(len(streams)), key=lambda i: -streams[i].n)
    own = [streams[i] for i in order]
    lanes = np.arange(len(own))
    n = np.array([s.n for s in own])
    tabs = []
    for c, bits in ((0, LONGEST[0]), (1, LONGEST[1]), (2, LONGEST[2]), (4, LONGEST[4])):
        tabs.append(tables(np.array([s.stored[0][c][0] for s in own]), bits, np.array([s.stored[0][c][1] for s in own])).reshape(-1))
    green, red, blue, far = tabs
    alpha = np.array([s.stored[0][3][1] for s in own], np.uint32) << np.uint32(24)
    width = np.array([s.coded_width for s in own])
    # the streams end to end, as 64-bit values at every 32-bit word
    words, base = [], []
    total = 0
    for s in own:
        raw = np.frombuffer(s.b.data + b"\0" * (16 - len(s.b.data) % 4), "<u4")
        words.append(raw)
        base.append(total * 32)
        total += len(raw)
    w32 = np.concatenate([*words, np.zeros(4, np.uint32)]).astype(np.uint64)
    w64 = w32[:-1] | (w32[1:] << np.uint64(32))
    base = np.array(base)
    end = base + np.array([s.b.end for s in own])
    at = base + np.array([s.b.at for s in own])
    top = len(w64) - 1
    offs = np.concatenate([[0], np.cumsum(n)])
    out = np.zeros(int(offs[-1]), np.uint32)
    cache = np.zeros(len(own) << CACHE_BITS, np.uint32)
    rest, dist = np.zeros(len(own), np.int64), np.ones(len(own), np.int64)
    g0, r0, b0, f0 = lanes << LONGEST[0], lanes << LONGEST[1], lanes << LONGEST[2], lanes << LONGEST[4]
    gm, rm, bm, fm = (np.uint64((1 << x) - 1) for x in (LONGEST[0], LONGEST[1], LONGEST[2], LONGEST[4]))
    c0 = lanes << CACHE_BITS

    def look(p):
        p = np.minimum(p >> 5, top), (p & 31).astype(np.uint64)
        return w64[p[0]] >> p[1]

    def number(sym, p):
        """Lengths or distances of prefix symbols; and the place after their extra bits."""
        extra = np.maximum((sym - 2) >> 1, 0)
        more = (look(p) & ((np.uint64(1) << extra.astype(np.uint64)) - np.uint64(1))).astype(np.int64)
        return np.where(sym < 4, sym + 1, ((2 + (sym & 1)) << extra) + more + 1), p + extra

    step, k = 0, len(own)
    while True:
        while k and n[k - 1] <= step:
            k -= 1
        if k < FEW:
            break
        # steps until the shortest image of those left ends
        for t in range(step, int(n[k - 1])):
            pos = at[:k]
            v = look(pos)
            e = green[g0[:k] + (v & gm).astype(np.int64)]
            busy = rest[:k] > 0
            ln, sym = e & np.uint32(15), e >> np.uint32(4)
            lit = sym < 256
            v >>= ln.astype(np.uint64)
            er = red[r0[:k] + (v & rm).astype(np.int64)]
            v >>= (er & np.uint32(15)).astype(np.uint64)
            eb = blue[b0[:k] + (v & bm).astype(np.int64)]
            colour = alpha[:k] | ((er >> np.uint32(4)) << np.uint32(16)) | (sym << np.uint32(8)) | (eb >> np.uint32(4))
            ahead = ln + np.where(lit, (er & np.uint32(15)) + (eb & np.uint32(15)), 0)
            other = np.flatnonzero(~lit | busy)
            if len(other):
                ahead = ahead.astype(np.int64)
                ahead[busy] = 0
                new = np.flatnonzero(~busy & ~lit & (sym < 280))
                if len(new):
                    size, p = number(sym[new].astype(np.int64) - 256, pos[new] + ln[new])
                    ef = far[f0[new] + (look(p) & fm).astype(np.int64)]
                    d, p = number((ef >> np.uint32(4)).astype(np.int64), p + (ef & np.uint32(15)))
                    near = np.minimum(d, 120) - 1
                    d = np.where(d > 120, d - 120, np.maximum(1, _NEAR_X[near] + _NEAR_Y[near] * width[new]))
                    if (d > t).any() or (size > n[new] - t).any():
                        raise ValueError("a copy reaches beyond the image")
                    ahead[new] = p - pos[new]
                    rest[new], dist[new] = size, d
                    busy[new] = True
                hit = np.flatnonzero(~busy & (sym >= 280))
                colour[hit] = cache[c0[hit] + sym[hit] - 280]
                copy = np.flatnonzero(busy)
                colour[copy] = out[offs[copy] + t - dist[copy]]
                rest[copy] -= 1
            at[:k] = pos + ahead
            out[offs[:k] + t] = colour
            cache[c0[:k] + ((colour * np.uint32(_HASH)) >> np.uint32(32 - CACHE_BITS))] = colour
        step = max(step, int(n[k - 1]))
    if (at > end).any():
        raise ValueError("a stream ends early")
    result: list = [None] * len(own)
    for i, s in enumerate(own):
        pix = out[offs[i] : offs[i + 1]]
        if i < k:
            done = pix[:step].tolist()
            while rest[i] > 0 and len(done) < s.n:
                done.append(done[len(done) - int(dist[i])])
                rest[i] -= 1
            s.b.at = int(at[i] - base[i])
            c = cache[i << CACHE_BITS : (i + 1) << CACHE_BITS].tolist()
            for p in done[step:]:
                c[(_HASH * p & 0xFFFFFFFF) >> (32 - CACHE_BITS)] = p
            pix = s.scalar(done, c)
        result[order[i]] = pix
    return result


def chunks(media: bytes) -> dict[bytes, bytes]:
    if media[:4] != b"RIFF" or media[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    out, at = {}, 12
    while at + 8 <= len(media):
        size = struct.unpack("<I", media[at + 4 : at + 8])[0]
        out[media[at : at + 4]] = media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    return out


def decode_images(media: list[bytes]) -> list[tuple[int, int, np.ndarray]]:
    """(width, height, argb) of each file."""
    opened = [Open(chunks(m).get(b"VP8L", b"")) for m in media]
    fast = [i for i, s in enumerate(opened) if s.in_step()]
    out: list = [None] * len(media)
    for a in range(0, len(fast), LANES):
        for i, p in zip(fast[a : a + LANES], lockstep([opened[i] for i in fast[a : a + LANES]])):
            out[i] = p
    return [(s.width, s.height, s.finish(s.scalar() if p is None else p)) for s, p in zip(opened, out)]


# ---------------------------------------------------------------- texts


def padded_size(n: int) -> int:
    return max(ROW, -(-n // ROW) * ROW)


def texts_to_media(data: np.ndarray, offs: np.ndarray) -> list[bytes]:
    """Each text's bytes as a WebP file."""
    images, extra, few = [], [], []
    for a, z in zip(offs[:-1].tolist(), offs[1:].tolist()):
        size = padded_size(z - a)
        wide = -(-size // ROW // 16384)
        rows = -(-size // (ROW * wide))
        raw = np.full(rows * wide * ROW, PAD, np.uint8)
        raw[: z - a] = data[a:z]
        raw = raw.reshape(-1, 3).astype(np.uint32)
        pix = np.uint32(0xFF000000) | (raw[:, 0] << np.uint32(16)) | (raw[:, 1] << np.uint32(8)) | raw[:, 2]
        images.append((64 * wide, rows, pix))
        extra.append(b"PLEN" + struct.pack("<IQ", 8, size) if rows * wide * ROW != size else b"")
        few.append(len(np.unique(pix)) <= min(256, len(pix) // 12) if len(pix) < 4096 or len(np.unique(pix[:2048])) <= 256 else False)
    out: list = [None] * len(images)
    for kind, steps in ((False, ()), (True, ("palette",))):
        mine = [i for i, f in enumerate(few) if f == kind]
        for at in range(0, len(mine), TOGETHER):
            part = mine[at : at + TOGETHER]
            for i, v in zip(part, encode_images([images[i] for i in part], [steps] * len(part))):
                out[i] = v
    return [container(v, x) for v, x in zip(out, extra)]


def media_to_payloads(media: list[bytes]) -> list[tuple[int, int, bytes]]:
    """(width, height, payload) of files that texts_to_media wrote."""
    out = []
    for m, (w, h, pix) in zip(media, decode_images(media)):
        raw = np.empty((len(pix), 3), np.uint8)
        raw[:, 0], raw[:, 1], raw[:, 2] = (pix >> np.uint32(16)) & np.uint32(255), (pix >> np.uint32(8)) & np.uint32(255), pix & np.uint32(255)
        raw = raw.reshape(-1).tobytes()
        if raw and len(m) > 20:
            c = m.find(b"PLEN", 20 + struct.unpack("<I", m[16:20])[0])
            if c >= 0:
                raw = raw[: struct.unpack("<Q", m[c + 8 : c + 16])[0]]
        out.append((w, h, raw))
    return out


def feature(w: int, h: int, payload: bytes) -> str:
    """Shape, mean of each channel, and the share of the commonest value."""
    raw = np.frombuffer(payload, np.uint8).reshape(-1, 3)
    mean = raw.sum(axis=0, dtype=np.int64) / len(raw)
    top = np.bincount(raw.reshape(-1)).max() / raw.size
    return f"{w}x{h};{mean[0]:.4f};{mean[1]:.4f};{mean[2]:.4f};{top:.4f}"


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """One row per document: id, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature; with keep also media and pixels (binary)."""
    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("text"))

    def run(it):
        for b in batches(it, 8 << 20):
            data, offs = flat(b.column(1))
            media = texts_to_media(data, offs)
            back = media_to_payloads(media)
            cols = [
                b.column(0),
                pa.array(np.diff(offs), pa.int64()),
                pa.array([len(p) for _, _, p in back], pa.int64()),
                pa.array([hashlib.sha256(p).hexdigest() for _, _, p in back], pa.string()),
                pa.array([zlib.crc32(p[-16:]) for _, _, p in back], pa.int64()),
                pa.array([len(m) for m in media], pa.int64()),
                pa.array([hashlib.sha256(m).hexdigest() for m in media], pa.string()),
                pa.array([feature(*x) for x in back], pa.string()),
            ]
            if keep:
                cols += [pa.array(media, pa.binary()), pa.array([p for _, _, p in back], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=[id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media", "pixels"][: len(cols)])

    return src.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary, pixels binary" * keep)


def op1(spark, sf_dir: str) -> DataFrame:
    return media_column(spark.read.parquet(f"{sf_dir}/documents.parquet"))
