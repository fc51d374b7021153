"""Progressive JPEG, written and read in numpy for many images in step.

A coefficient array is coded in several scans: bands of the spectrum
(spectral selection), and bits from high to low (successive approximation).
The reader accumulates the scans into coefficient arrays, inverse-transforms
them, upsamples the chroma and gives full-resolution RGB.

Restart markers part a scan into intervals that can be read by themselves.
All intervals of all images that share a scan's tables are read in step, one
symbol of each at a time, so the cost is that of a few array operations per
symbol of the longest interval.  Images without restart markers are read the
same way, an interval each.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

#: Fixed values of the JPEG standard: the zigzag order of an 8 x 8 block.
ZIGZAG = np.array(
    [
        0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5,
        12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
        35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51,
        58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
    ]
)
#: Blocks coded or read at a time.
_SLICE = 1 << 15
_HALF = np.array([0, *(1 << s - 1 for s in range(1, 17))], dtype=np.int64)
_FULL = np.array([(1 << s) - 1 for s in range(17)], dtype=np.int64)


def _basis() -> np.ndarray:
    """Rows: coefficients in zigzag order; columns: samples.  Scaled by 2 ** 14 and rounded, so that products and sums
    of whole numbers stay exact in double precision, whatever the order in which they are added."""
    x = np.arange(8)
    c = np.cos((2 * x[None, :] + 1) * x[:, None] * np.pi / 16) * np.where(x == 0, np.sqrt(0.125), 0.5)[:, None]
    full = np.einsum("vy,ux->vuyx", c, c).reshape(64, 64)
    return np.rint(full[ZIGZAG] * (1 << 14))


_BASIS = _basis()


def inverse(coefficients: np.ndarray, quantiser: np.ndarray) -> np.ndarray:
    """8-bit samples (n, 8, 8) of blocks of zigzag coefficients (n, 64)."""
    scaled = (coefficients.astype(np.float64) * quantiser) @ _BASIS
    return np.clip(np.floor((scaled + (1 << 13)) / (1 << 14)) + 128, 0, 255).astype(np.uint8).reshape(-1, 8, 8)


# --- Huffman tables ---


@dataclass(frozen=True)
class Table:
    """Symbols by code length, as in a DHT segment."""

    counts: tuple[int, ...]
    symbols: tuple[int, ...]

    @staticmethod
    def of(lengths: dict[int, int]) -> Table:
        order = sorted(lengths, key=lambda s: (lengths[s], s))
        return Table(tuple(sum(n == k for n in lengths.values()) for k in range(1, 17)), tuple(order))

    def codes(self) -> tuple[np.ndarray, np.ndarray]:
        """(code, length) by symbol; length 0 for none."""
        code, length = np.zeros(256, dtype=np.uint64), np.zeros(256, dtype=np.int64)
        at = now = 0
        for n, many in enumerate(self.counts, 1):
            for s in self.symbols[at : at + many]:
                code[s], length[s] = now, n
                now += 1
            at += many
            now <<= 1
        return code, length

    def lookup(self) -> tuple[np.ndarray, np.ndarray]:
        """(symbol, length) by the next 16 bits."""
        symbol, length = np.zeros(1 << 16, dtype=np.int64), np.full(1 << 16, 16, dtype=np.int64)
        code, n = self.codes()
        for s in self.symbols:
            lo = int(code[s]) << 16 - int(n[s])
            symbol[lo : lo + (1 << 16 - int(n[s]))] = s
            length[lo : lo + (1 << 16 - int(n[s]))] = n[s]
        return symbol, length


def _sizes_first(order: list[int]) -> Table:
    """For coefficients that are seldom zero: short codes for sizes after no zeros, in the given order, long ones for the rest."""
    lengths = {s: n for s, n in zip(order, (2, 2, 3, 3, 3, 5, 5, 5))}
    lengths[0x00] = 7
    rest = [r << 4 | s for r in range(16) for s in range(11) if r << 4 | s not in lengths]
    return Table.of(lengths | {s: 13 for s in rest})


DC = Table.of({s: 4 for s in range(12)})
AC = _sizes_first([5, 4, 3, 7, 6, 1, 2, 8])
AC_HIGH = _sizes_first([4, 3, 2, 6, 5, 1, 7, 8])
AC_REFINE = Table.of({0x00: 1} | {r << 4 | 1: 6 for r in range(16)} | {r << 4: 8 for r in range(1, 16)})
_LOOKUPS: dict[Table, tuple[np.ndarray, np.ndarray]] = {}


def _lookup(table: Table) -> tuple[np.ndarray, np.ndarray]:
    if table not in _LOOKUPS:
        _LOOKUPS[table] = table.lookup()
    return _LOOKUPS[table]


# --- writing ---


@dataclass
class Scan:
    components: tuple[int, ...]
    first: int
    last: int
    high: int
    low: int
    dc: Table | None = None
    ac: Table | None = None
    slot: int = 0


#: The scans that write() makes.
SCRIPT = [
    Scan((0, 1, 2), 0, 0, 0, 1, dc=DC),
    Scan((0,), 1, 5, 0, 0, ac=AC, slot=0),
    Scan((1,), 1, 63, 0, 0, ac=AC, slot=0),
    Scan((2,), 1, 63, 0, 0, ac=AC, slot=0),
    Scan((0,), 6, 63, 0, 1, ac=AC_HIGH, slot=1),
    Scan((0, 1, 2), 0, 0, 1, 0),
    Scan((0,), 6, 63, 1, 0, ac=AC_REFINE, slot=2),
]


def _size(v: np.ndarray) -> np.ndarray:
    """Bits of magnitudes below 2 ** 15."""
    return np.frexp(v.astype(np.float64))[1].astype(np.int64)


def _packed(value: np.ndarray, length: np.ndarray, lane: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray]:
    """Bit fields, ordered by lane, as bytes; each lane is filled up with ones.  Returns bytes and bytes per lane."""
    bits = np.bincount(lane, weights=length, minlength=lanes).astype(np.int64)
    n_bytes = (bits + 7) // 8
    start = np.concatenate([[0], np.cumsum(n_bytes)[:-1]]) * 8
    through = np.cumsum(length)
    before = np.concatenate([[0], np.cumsum(bits)[:-1]])
    at = start[lane] + through - length - before[lane]
    out = np.zeros(int(n_bytes.sum()) // 8 + 3, dtype=np.uint64)
    word, stop = at >> 6, (at & 63) + length
    over = stop > 64
    shifted = np.where(over, value >> np.where(over, stop - 64, 0).astype(np.uint64), value << np.where(over, 0, 64 - stop).astype(np.uint64))
    if len(word):
        heads = np.concatenate([[0], np.flatnonzero(np.diff(word)) + 1])
        out[word[heads]] = np.add.reduceat(shifted, heads)
        out[word[over] + 1] |= value[over] << (128 - stop[over]).astype(np.uint64)
    raw = out.astype(">u8").view(np.uint8)[: int(n_bytes.sum())].copy()
    pad = n_bytes * 8 - bits
    ends = np.cumsum(n_bytes) - 1
    some = pad > 0
    raw[ends[some]] |= ((1 << pad[some]) - 1).astype(np.uint8)
    return raw, n_bytes


def _framed(raw: np.ndarray, n_bytes: np.ndarray, within: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stuffs bytes and puts restart markers between the intervals of an image.  within: an interval's number in its
    image; last: whether it ends it.  Returns bytes and bytes per interval, its marker included."""
    stuffed = raw == 0xFF
    extra = stuffed.astype(np.int64)
    ends = np.cumsum(n_bytes) - 1
    marked = ends[~last]
    extra[marked] += 2
    place = np.arange(len(raw)) + np.concatenate([[0], np.cumsum(extra)[:-1]]) if len(raw) else np.zeros(0, dtype=np.int64)
    out = np.zeros(len(raw) + int(extra.sum()), dtype=np.uint8)
    out[place] = raw
    at = place[marked] + 1 + stuffed[marked]
    out[at] = 0xFF
    out[at + 1] = 0xD0 + within[~last] % 8
    return out, np.add.reduceat(extra + 1, np.concatenate([[0], ends[:-1] + 1])) if len(raw) else n_bytes


def _ac_first(block: np.ndarray, scan: Scan, lane: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bit fields of a band's first scan: (value, length, lane)."""
    code, width = scan.ac.codes()
    v = block[:, scan.first : scan.last + 1].astype(np.int64)
    magnitude = np.abs(v) >> scan.low
    b, k = np.nonzero(magnitude)
    m = magnitude[b, k]
    previous = np.concatenate([[-1], k[:-1]])
    previous[np.concatenate([[True], b[1:] != b[:-1]])[: len(b)]] = -1
    run = k - previous[: len(k)] - 1
    zrl = run >> 4
    last = np.full(len(block), -1)
    last[b] = k  # the last of equal rows stays
    eob = last < v.shape[1] - 1
    size = _size(m)
    symbol = (run & 15) << 4 | size
    if (size > 10).any():
        raise ValueError("a coefficient is out of range")
    bits = np.where(v[b, k] > 0, m, _FULL[size] - m).astype(np.uint64)
    value = code[symbol] << size.astype(np.uint64) | bits
    length = width[symbol] + size
    if not zrl.any() and not eob.any():
        return value, length, lane[b]
    # each symbol's place: those before it, their runs of sixteen zeros, and the ends of the blocks before its own
    place = np.cumsum(1 + zrl) - 1 + (np.cumsum(eob) - eob)[b]
    total = len(b) + int(zrl.sum()) + int(eob.sum())
    all_value, all_length = np.full(total, code[0xF0]), np.full(total, width[0xF0])
    all_lane = np.zeros(total, dtype=np.int64)
    all_value[place], all_length[place], all_lane[place] = value, length, lane[b]
    zeros = np.repeat(np.arange(len(b)), zrl)
    all_lane[place[zeros] - 1 - (np.arange(len(zeros)) - np.repeat(np.cumsum(zrl) - zrl, zrl))] = lane[b][zeros]
    own = np.bincount(b, weights=1 + zrl, minlength=len(block)).astype(np.int64)
    at = (np.cumsum(own) + np.cumsum(eob) - 1)[eob]
    all_value[at], all_length[at], all_lane[at] = code[0], width[0], lane[eob]
    return all_value, all_length, all_lane


def _ac_refine(block: np.ndarray, scan: Scan, lane: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bit fields of a band's next lower bit: corrections of coefficients known to be non-zero, and new ones."""
    code, width = scan.ac.codes()
    v = block[:, scan.first : scan.last + 1].astype(np.int64)
    m = np.abs(v) >> scan.low
    known, new = m > 1, m == 1
    plain = ~new.any(axis=1)
    fields: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def corrections(rows: np.ndarray, bits: np.ndarray, many: np.ndarray, order: np.ndarray) -> None:
        """Up to 64 bits, as two fields of up to 32."""
        low = np.minimum(many, 32)
        fields.append((rows, order, bits >> low.astype(np.uint64), many - low))
        fields.append((rows, order + 1, bits & ((np.uint64(1) << low.astype(np.uint64)) - np.uint64(1)), low))

    # no new coefficient: an end of block, then all corrections; nothing at all if there are none and no zero
    rows = np.flatnonzero(plain)
    many = known[rows].sum(axis=1)
    ends = (many > 0) | (v.shape[1] > many)
    fields.append((rows[ends], np.zeros(int(ends.sum()), dtype=np.int64), np.full(int(ends.sum()), code[0]), np.full(int(ends.sum()), width[0])))
    weight = np.where(known[rows], np.uint64(1) << (many[:, None] - np.cumsum(known[rows], axis=1)).clip(0).astype(np.uint64), np.uint64(0))
    corrections(rows, ((m[rows] & 1).astype(np.uint64) * weight).sum(axis=1, dtype=np.uint64), many, np.full(len(rows), 1))
    rows = np.flatnonzero(~plain)
    if len(rows):
        n = len(rows)
        run, held, many, order = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        stop = v.shape[1] - 1 - new[rows][:, ::-1].argmax(axis=1)

        def emit(some: np.ndarray, value: np.ndarray, length: np.ndarray) -> None:
            fields.append((rows[some], order[some].copy(), value, length))
            corrections(rows[some], held[some], many[some], order[some] + 1)
            order[some] += 3
            held[some], many[some] = 0, 0

        for k in range(v.shape[1]):
            own = m[rows, k]
            run[own == 0] += 1
            while len(some := np.flatnonzero((own > 0) & (run > 15) & (k <= stop))):
                emit(some, np.full(len(some), code[0xF0]), np.full(len(some), width[0xF0]))
                run[some] -= 16
            some = own > 1
            held[some] = held[some] << np.uint64(1) | (own[some] & 1).astype(np.uint64)
            many[some] += 1
            some = np.flatnonzero(own == 1)
            symbol = run[some] << 4 | 1
            emit(some, code[symbol] << np.uint64(1) | (v[rows[some], k] > 0).astype(np.uint64), width[symbol] + 1)
            run[some] = 0
        some = np.flatnonzero((run > 0) | (many > 0))
        emit(some, np.full(len(some), code[0]), np.full(len(some), width[0]))
    row, order, value, length = (np.concatenate([np.asarray(f[i]) for f in fields]) for i in range(4))
    keep = np.flatnonzero(length > 0)
    keep = keep[np.lexsort((order[keep], row[keep]))]
    return value[keep].astype(np.uint64), length[keep].astype(np.int64), lane[row[keep]]


@dataclass
class Image:
    """Coefficients by component: (rows of blocks, columns of blocks, 64) in zigzag order."""

    width: int
    height: int
    sampling: tuple[tuple[int, int], ...]
    coefficients: list[np.ndarray]
    comment: bytes = b""
    quantisers: list[np.ndarray] = field(default_factory=list)

    def rgb(self) -> np.ndarray:
        """(height, width, 3) samples, chroma upsampled by repetition."""
        return rgb([self])[0]


def rgb(images: list[Image]) -> list[np.ndarray]:
    """The images' RGB samples; their blocks are transformed together."""
    planes: list[list[np.ndarray]] = [[] for _ in images]
    for c in range(max((len(x.coefficients) for x in images), default=0)):
        own = [k for k, x in enumerate(images) if c < len(x.coefficients)]
        blocks = np.concatenate([images[k].coefficients[c].reshape(-1, 64) for k in own])
        quantiser = np.stack([images[k].quantisers[c] if images[k].quantisers else np.ones(64) for k in own])
        many = [images[k].coefficients[c].size // 64 for k in own]
        same = (quantiser == quantiser[0]).all()
        pixels = np.concatenate([inverse(blocks[at : at + _SLICE], quantiser[0] if same else np.repeat(quantiser, many, axis=0)[at : at + _SLICE]) for at in range(0, len(blocks), _SLICE)])
        at = 0
        for k, n in zip(own, many):
            rows, cols = images[k].coefficients[c].shape[:2]
            planes[k].append(pixels[at : at + n].reshape(rows, cols, 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, cols * 8))
            at += n
    out = []
    for image, own in zip(images, planes):
        h_most, v_most = max(h for h, _ in image.sampling), max(v for _, v in image.sampling)
        full = []
        for plane, (h, v) in zip(own, image.sampling):
            if (h, v) != (h_most, v_most):
                plane = plane.repeat(v_most // v, axis=0).repeat(h_most // h, axis=1)
            full.append(plane[: image.height, : image.width].astype(np.int32))
        if len(full) == 1:
            out.append(np.repeat(full[0].astype(np.uint8)[:, :, None], 3, axis=2))
            continue
        y, cb, cr = full[0], full[1] - 128, full[2] - 128
        # ITU-R BT.601 in 16-bit fixed point
        parts = (y + ((91881 * cr + 32768) >> 16), y - ((22554 * cb + 46802 * cr + 32768) >> 16), y + ((116130 * cb + 32768) >> 16))
        out.append(np.clip(np.stack(parts, axis=2), 0, 255).astype(np.uint8))
    return out


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def write(images: list[Image], interval: int = 4) -> list[bytes]:
    """Progressive files of images with three components, the first sampled twice as densely each way."""
    if not images:
        return []
    many = np.array([x.coefficients[1].size // 64 for x in images])  # minimum coded units
    image = np.repeat(np.arange(len(images)), many)
    unit = np.arange(len(image)) - np.repeat(np.cumsum(many) - many, many)
    y4 = []
    for x in images:
        rows, cols = x.coefficients[1].shape[:2]
        y4.append(x.coefficients[0].reshape(rows, 2, cols, 2, 64).transpose(0, 2, 1, 3, 4).reshape(-1, 4, 64)[:, :, 0])
    chroma = [np.concatenate([x.coefficients[c].reshape(-1, 64)[:, :1] for x in images]) for c in (1, 2)]
    dc = np.concatenate([np.concatenate(y4), *chroma], axis=1).astype(np.int64)  # a unit's blocks in order
    coded: list[list[bytes]] = [[] for _ in images]
    for scan in SCRIPT:
        if len(scan.components) > 1:
            per, own, number = many, image, unit
        else:
            per = np.array([x.coefficients[scan.components[0]].size // 64 for x in images])
            own = np.repeat(np.arange(len(images)), per)
            number = np.arange(len(own)) - np.repeat(np.cumsum(per) - per, per)
        per_lane = -(-per // interval)
        lane = number // interval + (np.cumsum(per_lane) - per_lane)[own]
        within = np.arange(int(per_lane.sum())) - np.repeat(np.cumsum(per_lane) - per_lane, per_lane)
        last = within == np.repeat(per_lane, per_lane) - 1
        if scan.last == 0 and scan.high == 0:
            v = dc >> scan.low
            before = np.concatenate([np.zeros((1, 6), dtype=np.int64), v[:-1]])
            before[number % interval == 0] = 0
            delta = v - np.stack([before[:, 3], v[:, 0], v[:, 1], v[:, 2], before[:, 4], before[:, 5]], axis=1)
            size = _size(np.abs(delta))
            code, width = scan.dc.codes()
            bits = np.where(delta > 0, delta, _FULL[size] + delta).astype(np.uint64)
            value = (code[size] << size.astype(np.uint64) | np.where(size > 0, bits, np.uint64(0))).ravel()
            raw, n_bytes = _packed(value, (width[size] + size).ravel(), np.repeat(lane, 6), len(within))
        elif scan.last == 0:
            value = ((dc >> scan.low & 1) << np.arange(5, -1, -1)).sum(axis=1).astype(np.uint64)
            raw, n_bytes = _packed(value, np.full(len(value), 6), lane, len(within))
        else:
            blocks = np.concatenate([x.coefficients[scan.components[0]].reshape(-1, 64) for x in images])
            raws, sizes, at = [], [], 0
            while at < len(blocks):
                stop = at + _SLICE
                if stop < len(blocks):  # cut between intervals
                    stop = int(np.searchsorted(lane, lane[stop]))
                    stop = stop if stop > at else int(np.searchsorted(lane, lane[at], side="right"))
                stop = min(stop, len(blocks))
                first = int(lane[at])
                fields = (_ac_refine if scan.high else _ac_first)(blocks[at:stop], scan, lane[at:stop] - first)
                some = _packed(*fields, int(lane[stop - 1]) - first + 1)
                raws.append(some[0])
                sizes.append(some[1])
                at = stop
            raw, n_bytes = np.concatenate(raws), np.concatenate(sizes)
        data, sizes = _framed(raw, n_bytes, within, last)
        ends = np.cumsum(sizes)[np.cumsum(per_lane) - 1].tolist()
        held = data.tobytes()
        for k, (lo, hi) in enumerate(zip([0, *ends[:-1]], ends)):
            coded[k].append(held[lo:hi])
    tables = [(0x00, DC), (0x10, AC), (0x11, AC_HIGH), (0x12, AC_REFINE)]
    common = b"".join(_segment(0xC4, bytes([slot, *t.counts, *t.symbols])) for slot, t in tables) + _segment(0xDD, struct.pack(">H", interval))
    heads = []
    for scan in SCRIPT:
        body = bytes([len(scan.components)]) + b"".join(bytes([c + 1, scan.slot]) for c in scan.components) + bytes([scan.first, scan.last, scan.high << 4 | scan.low])
        heads.append(_segment(0xDA, body))
    out = []
    for x, scans in zip(images, coded):
        frame = struct.pack(">BHHB", 8, x.height, x.width, 3) + b"".join(bytes([c + 1, h << 4 | v, 0]) for c, (h, v) in enumerate(x.sampling))
        parts = [b"\xff\xd8", _segment(0xFE, x.comment), _segment(0xDB, bytes([0] + [1] * 64)), _segment(0xC2, frame), common]
        for head, data in zip(heads, scans):
            parts += [head, data]
        out.append(b"".join([*parts, b"\xff\xd9"]))
    return out


# --- reading ---


class _Bits:
    """Bit positions of lanes in one buffer of unstuffed bytes."""

    def __init__(self, raw: np.ndarray, start: np.ndarray):
        self.raw = np.concatenate([raw, np.zeros(16, dtype=np.uint8)])
        self.words = np.ndarray((len(raw) + 8,), dtype=">u8", buffer=self.raw.data, strides=(1,))
        self.at = start.astype(np.int64) * 8

    def peek(self, at: np.ndarray) -> np.ndarray:
        """At least 57 bits from each position, left-aligned."""
        byte = np.minimum(at >> 3, len(self.words) - 1)
        return self.words[byte].astype(np.uint64) << (at & 7).astype(np.uint64)


def _parted(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entropy-coded data of several images: unstuffed bytes, the first byte of each interval, intervals per image."""
    lengths = np.array([len(p) for p in parts])
    raw = np.frombuffer(b"".join(parts), dtype=np.uint8)
    begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    ff = np.flatnonzero(raw[:-1] == 0xFF) if len(raw) > 1 else np.zeros(0, dtype=np.int64)
    after = raw[ff + 1]
    owner = np.searchsorted(begin, ff, side="right") - 1
    inside = ff + 1 < begin[owner] + lengths[owner]
    ff, after, owner = ff[inside], after[inside], owner[inside]
    keep = np.ones(len(raw), dtype=bool)
    keep[ff[after == 0] + 1] = False
    restart = (after >= 0xD0) & (after <= 0xD7)
    keep[ff[restart]] = False
    keep[ff[restart] + 1] = False
    place = np.concatenate([[0], np.cumsum(keep)])
    starts = np.sort(np.concatenate([begin, ff[restart] + 2]), kind="stable")
    lanes = np.bincount(owner[restart], minlength=len(parts)) + 1
    return raw[keep], place[starts], lanes


@dataclass
class _Frame:
    image: Image
    interval: int = 0
    blocks: list[tuple[int, int]] = field(default_factory=list)  # blocks of each component that scans of it alone hold
    ids: list[int] = field(default_factory=list)
    units: tuple[int, int] = (0, 0)  # rows and columns of minimum coded units
    offset: dict[int, int] = field(default_factory=dict)  # of its first block, by component, in the shared array
    whole: dict[int, np.ndarray] = field(default_factory=dict)


def _parse(raw: bytes) -> tuple[_Frame, list[tuple[Scan, int, bytes]]]:
    """The frame and the scans (parameters, restart interval, entropy-coded data) of one file."""
    if raw[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    tables: dict[int, Table] = {}
    quantisers: dict[int, np.ndarray] = {}
    frame, scans, interval, comment, at = None, [], 0, b"", 2
    selectors: list[int] = []
    while at + 4 <= len(raw):
        marker = raw[at + 1]
        if raw[at] != 0xFF:
            raise ValueError("a marker is missing")
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xD9:
            break
        (n,) = struct.unpack_from(">H", raw, at + 2)
        body = raw[at + 4 : at + 2 + n]
        at += 2 + n
        if marker == 0xFE:
            comment = body
        elif marker == 0xDD:
            (interval,) = struct.unpack(">H", body)
        elif marker == 0xDB:
            while body:
                wide, k = body[0] >> 4, body[0] & 15
                size = 128 if wide else 64
                quantisers[k] = np.frombuffer(body[1 : 1 + size], dtype=">u2" if wide else np.uint8).astype(np.float64)
                body = body[1 + size :]
        elif marker == 0xC4:
            while body:
                many = sum(body[1:17])
                tables[body[0]] = Table(tuple(body[1:17]), tuple(body[17 : 17 + many]))
                body = body[17 + many :]
        elif marker == 0xC2:
            bits, height, width, parts = struct.unpack_from(">BHHB", body)
            if bits != 8 or parts not in (1, 3):
                raise ValueError("only 8-bit files of one or three components are read")
            rest = [body[6 + 3 * k : 9 + 3 * k] for k in range(parts)]
            sampling = tuple((r[1] >> 4, r[1] & 15) for r in rest)
            if parts == 1:
                sampling = ((1, 1),)
            h_most, v_most = max(h for h, _ in sampling), max(v for _, v in sampling)
            cols, rows = -(-width // (8 * h_most)), -(-height // (8 * v_most))
            image = Image(width, height, sampling, [np.zeros((rows * v, cols * h, 64), dtype=np.int16) for h, v in sampling])
            frame = _Frame(image, ids=[r[0] for r in rest], units=(rows, cols))
            frame.blocks = [(-(--(-height * v // v_most) // 8), -(--(-width * h // h_most) // 8)) for h, v in sampling]
            selectors = [r[2] for r in rest]
        elif marker in range(0xC0, 0xD0) and marker not in (0xC8, 0xCC):
            raise ValueError("not a progressive file")
        elif marker == 0xDA:
            many = body[0]
            chosen = tuple(frame.ids.index(body[1 + 2 * k]) for k in range(many))
            slots = [body[2 + 2 * k] for k in range(many)]
            first, last, approx = body[1 + 2 * many : 4 + 2 * many]
            stop = at
            while True:
                stop = raw.find(b"\xff", stop)
                if stop < 0 or stop + 1 >= len(raw):
                    stop = len(raw)
                    break
                if raw[stop + 1] == 0 or 0xD0 <= raw[stop + 1] <= 0xD7:
                    stop += 2
                    continue
                break
            dc = tables.get(slots[0] >> 4) if last == 0 and approx >> 4 == 0 else None
            ac = tables.get(0x10 | slots[0] & 15) if last else None
            if last == 0 and len({slots[k] >> 4 for k in range(many)}) > 1:
                dc = tuple(tables.get(s >> 4) for s in slots)
            scans.append((Scan(chosen, first, last, approx >> 4, approx & 15, dc, ac), interval, raw[at:stop]))
            at = stop
    if frame is None:
        raise ValueError("no frame")
    frame.image.comment = comment
    frame.image.quantisers = [quantisers[k] for k in selectors]
    return frame, scans


def _value(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Signed values of `size` bits."""
    return bits - np.where(bits < _HALF[size], _FULL[size], 0)


def _read_dc(bits: _Bits, scan: Scan, flat: list[np.ndarray], where, units: np.ndarray) -> None:
    """where(lanes, unit): per component the blocks of each lane's unit, in order."""
    tables = scan.dc if isinstance(scan.dc, tuple) else (scan.dc,) * len(scan.components)
    predicted = [np.zeros(len(units), dtype=np.int64) for _ in scan.components]
    for u in range(int(units.max())):
        lanes = np.flatnonzero(units > u)
        for k, blocks in enumerate(where(lanes, u)):
            for block in blocks:
                word = bits.peek(bits.at[lanes])
                if scan.high:
                    flat[k][block * 64] |= ((word >> np.uint64(63)).astype(np.int64) << scan.low).astype(np.int16)
                    bits.at[lanes] += 1
                    continue
                symbol, length = _lookup(tables[k])
                top = (word >> np.uint64(48)).astype(np.int64)
                size, n = symbol[top], length[top]
                own = (word << n.astype(np.uint64) >> np.uint64(1) >> (63 - size).astype(np.uint64)).astype(np.int64)
                predicted[k][lanes] += _value(own, size)
                flat[k][block * 64] = predicted[k][lanes] << scan.low
                bits.at[lanes] += n + size


def _read_ac_first(bits: _Bits, scan: Scan, flat: np.ndarray, where, units: np.ndarray) -> None:
    symbol, length = _lookup(scan.ac)
    skip = np.zeros(len(units), dtype=np.int64)
    for u in range(int(units.max())):
        lanes = np.flatnonzero(units > u)
        block = where(lanes, u)[0][0]
        open_ = skip[lanes] == 0
        skip[lanes[~open_]] -= 1
        lanes, base = lanes[open_], block[open_] * 64
        at, k = bits.at[lanes], np.full(len(lanes), scan.first)
        while len(lanes):
            word = bits.peek(at)
            top = (word >> np.uint64(48)).astype(np.int64)
            own, n = symbol[top], length[top]
            size, run = own & 15, own >> 4
            some = size > 0
            if some.all():
                value = (word << n.astype(np.uint64) >> (64 - size).astype(np.uint64)).astype(np.int64)
                k += run
                flat[base + k] = _value(value, size) << scan.low
                at += n + size
                k += 1
            else:
                extra = np.where(some, size, np.where(run < 15, run, 0))
                value = (word << n.astype(np.uint64) >> np.uint64(1) >> (63 - extra).astype(np.uint64)).astype(np.int64)
                at += n + extra
                k += run
                put = np.flatnonzero(some)
                flat[base[put] + k[put]] = _value(value[put], size[put]) << scan.low
                k += 1
                end = ~some & (run < 15)
                skip[lanes[end]] = (1 << run[end]) + value[end] - 1
                k[end] = 64
            over = k > scan.last
            if over.any():
                bits.at[lanes[over]] = at[over]
                left = ~over
                lanes, base, at, k = lanes[left], base[left], at[left], k[left]


def _correct(flat: np.ndarray, index: np.ndarray, bit: np.ndarray, low: int) -> None:
    now = flat[index].astype(np.int64)
    flat[index] = now + np.where(bit > 0, np.sign(now) << low, 0)


def _read_ac_refine(bits: _Bits, scan: Scan, flat: np.ndarray, where, units: np.ndarray) -> None:
    symbol, length = _lookup(scan.ac)
    skip = np.zeros(len(units), dtype=np.int64)
    band = np.arange(scan.first, scan.last + 1)
    for u in range(int(units.max())):
        lanes = np.flatnonzero(units > u)
        base = where(lanes, u)[0][0] * 64
        k = np.full(len(lanes), scan.first)
        at = bits.at[lanes]
        ended = skip[lanes] > 0
        fresh = ~ended
        run, new = np.zeros(len(lanes), dtype=np.int64), np.zeros(len(lanes), dtype=np.int64)
        while True:
            # those that need a symbol
            ask = np.flatnonzero(fresh & ~ended & (k <= scan.last))
            if len(ask):
                word = bits.peek(at[ask])
                top = (word >> np.uint64(48)).astype(np.int64)
                own, n = symbol[top], length[top]
                size, zeros = own & 15, own >> 4
                extra = np.where(size > 0, 1, np.where(zeros < 15, zeros, 0))
                value = (word << n.astype(np.uint64) >> np.uint64(1) >> (63 - extra).astype(np.uint64)).astype(np.int64)
                at[ask] += n + extra
                end = (size == 0) & (zeros < 15)
                skip[lanes[ask[end]]] = (1 << zeros[end]) + value[end]
                ended[ask[end]] = True
                run[ask] = zeros
                new[ask] = np.where(size > 0, np.where(value > 0, 1, -1), 0)
                fresh[ask] = False
            # a block that has ended: all its corrections at once
            close = np.flatnonzero(ended & (k <= scan.last))
            if len(close):
                index = base[close, None] + band
                known = (flat[index] != 0) & (band >= k[close, None])
                row, col = np.nonzero(known)
                nth = (np.cumsum(known, axis=1) - 1)[row, col]
                bit = bits.peek(at[close][row] + nth) >> np.uint64(63)
                _correct(flat, index[row, col], bit, scan.low)
                at[close] += known.sum(axis=1)
                k[close] = 64
            walk = np.flatnonzero(~ended & (k <= scan.last))
            if not len(walk):
                break
            spot = base[walk] + k[walk]
            known = flat[spot] != 0
            some = walk[known]
            if len(some):
                _correct(flat, spot[known], bits.peek(at[some]) >> np.uint64(63), scan.low)
                at[some] += 1
            rest = walk[~known]
            here = run[rest] == 0
            stop = rest[here]
            flat[base[stop] + k[stop]] = new[stop] << scan.low
            fresh[stop] = True
            run[rest[~here]] -= 1
            k[walk] += 1
        skip[lanes[ended]] -= 1
        bits.at[lanes] = at


def read(files: list[bytes]) -> list[Image]:
    """Reads progressive files, with or without restart markers; those that share their scans' tables go in step."""
    parsed = [_parse(f) for f in files]
    frames = [p[0] for p in parsed]
    # one array of coefficients per component for all images, so that lanes can be written to together
    for c in range(3):
        own = [f for f in frames if c < len(f.image.coefficients)]
        whole = np.zeros(sum(f.image.coefficients[c].size for f in own), dtype=np.int16)
        at = 0
        for f in own:
            shape = f.image.coefficients[c].shape
            n = shape[0] * shape[1] * 64
            f.image.coefficients[c] = whole[at : at + n].reshape(shape)
            f.offset[c] = at // 64
            at += n
        if own:
            for f in own:
                f.whole[c] = whole
    for step in range(max((len(p[1]) for p in parsed), default=0)):
        groups: dict[tuple, list[int]] = {}
        for k, (frame, scans) in enumerate(parsed):
            if step < len(scans):
                s, interval, _ = scans[step]
                groups.setdefault((s.components, s.first, s.last, s.high, s.low, s.dc, s.ac, interval, frame.image.sampling), []).append(k)
        for (components, *_), members in groups.items():
            held, size = [], 0
            for k in members:  # at most about _SLICE blocks of lanes in step
                held.append(k)
                size += len(parsed[k][1][step][2])
                if size > 64 * _SLICE:
                    _read_scan(parsed, held, step)
                    held, size = [], 0
            if held:
                _read_scan(parsed, held, step)
    return [f.image for f in frames]


def _read_scan(parsed: list, members: list[int], step: int) -> None:
    scan, interval, _ = parsed[members[0]][1][step]
    frames = [parsed[k][0] for k in members]
    raw, start, lanes = _parted([parsed[k][1][step][2] for k in members])
    alone = len(scan.components) == 1
    c0 = scan.components[0]
    grid = [f.blocks[c0] if alone else f.units for f in frames]
    total = np.array([r * c for r, c in grid])
    cols = np.array([c for _, c in grid])
    owner = np.repeat(np.arange(len(frames)), lanes)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    per = np.full(len(frames), interval) if interval else total
    first = within * per[owner]
    units = np.clip(np.minimum(per[owner], total[owner] - first), 0, None)
    flat = [frames[0].whole[c] for c in scan.components]
    offset = [np.array([f.offset[c] for f in frames]) for c in scan.components]
    stride = [np.array([f.image.coefficients[c].shape[1] for f in frames]) for c in scan.components]
    sampling = [frames[0].image.sampling[c] for c in scan.components]

    def where(some: np.ndarray, u: int):
        o = owner[some]
        n = first[some] + u
        row, col = n // cols[o], n % cols[o]
        if alone:
            return [[offset[0][o] + row * stride[0][o] + col]]
        return [[offset[k][o] + (row * v + y) * stride[k][o] + col * h + x for y in range(v) for x in range(h)] for k, (h, v) in enumerate(sampling)]

    bits = _Bits(raw, start)
    if scan.last == 0:
        _read_dc(bits, scan, flat, where, units)
    elif scan.high:
        _read_ac_refine(bits, scan, flat[0], where, units)
    else:
        _read_ac_first(bits, scan, flat[0], where, units)
