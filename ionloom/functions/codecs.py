"""Numeric array codecs of the public MS-Numpress formats, in numpy over whole batches, and as Arrow functions of columns.

A stream of half-bytes holds signed 32-bit integers: a head, saying how many leading half-bytes are dropped (0 to 8 zeros, or
9 to 15 less 8 of ones), then the others, lowest first. Only the heads must be walked: for all streams of a batch in lockstep,
a step an integer, or one by one where few streams are left. Everything else is arithmetic on the arrays of the batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import functions as F

# The accessions of the codecs.
LINEAR, PIC, SLOF = "MS:1002312", "MS:1002313", "MS:1002314"
SLOF_TOP = 65535
#: Streams from which on heads are walked in lockstep.
LOCKSTEP = 24
#: Half-bytes that follow a head.
_HELD = np.array([8 - (h if h <= 8 else h - 8) for h in range(16)], np.int64)
_STEPS = bytes(int(1 + h) for h in _HELD) + bytes(240)


def _offsets(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(counts, dtype=np.int64)])


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... for each count, in a row."""
    return np.arange(int(counts.sum())) - np.repeat(_offsets(counts)[:-1], counts)


def _segment_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Running sums of whole numbers inside each segment; exact, since overflow of the total cancels."""
    total = np.cumsum(values, dtype=np.int64)
    starts = _offsets(counts)[:-1]
    before = np.where(starts > 0, total[np.maximum(starts, 1) - 1] if len(total) else 0, 0)
    return total - np.repeat(before, counts)


def pack(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Integers, each within 32 bits, as a stream of half-bytes for each count: (bytes of all, bytes of each)."""
    u = (values.astype(np.int64) & 0xFFFFFFFF).astype(np.uint32)
    halves = ((u[:, None] >> (np.arange(8, dtype=np.uint32) * np.uint32(4))) & np.uint32(15)).astype(np.uint8)  # lowest first
    high = halves[:, ::-1]
    top = halves[:, 7]
    zeros = np.where(u == 0, 8, (high != 0).argmax(1))
    ones = np.where(u == 0xFFFFFFFF, 7, (high != 15).argmax(1))
    dropped = np.where(top == 0, zeros, np.where(top == 15, ones, 0))
    head = np.where(top == 15, dropped | 8, dropped).astype(np.uint8)
    rows = np.concatenate([head[:, None], halves], axis=1)
    held = 9 - dropped
    stream = rows[np.arange(9)[None, :] < held[:, None]]
    ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(held)])[_offsets(counts)]
    lengths = np.diff(ends)
    even = lengths + lengths % 2
    out = np.zeros(int(even.sum()), np.uint8)
    out[np.repeat(_offsets(even)[:-1], lengths) + _within(lengths)] = stream
    return (out[0::2] << 4) | out[1::2], even // 2


def _heads(halves: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the heads of each stream are, in stream order, and how many each has; a last odd half-byte that is no integer of its own is padding."""
    at, live = at.astype(np.int64), np.flatnonzero(at < end)
    streams, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(live) >= LOCKSTEP:
        p = at[live]
        head = halves[p]
        real = (p < end[live] - 1) | (head == 8)
        live, p, head = live[real], p[real], head[real]
        streams.append(live)
        places.append(p)
        at[live] = p + 1 + _HELD[head]
        if (at[live] > end[live]).any():
            raise ValueError("truncated half-byte stream")
        live = live[at[live] < end[live]]
    for i in live:
        base, last = int(at[i]), int(end[i])
        steps = halves[base:last].tobytes().translate(_STEPS)
        p, found, last = 0, [], last - base
        while p < last:
            found.append(p)
            p += steps[p]
        if found and found[-1] == last - 1 and halves[base + found[-1]] != 8:
            found.pop()
        elif p > last:
            raise ValueError("truncated half-byte stream")
        streams.append(np.full(len(found), i))
        places.append(base + np.array(found, np.int64))
    stream, place = np.concatenate(streams), np.concatenate(places)
    return place[np.argsort(stream, kind="stable")], np.bincount(stream, minlength=len(at))


def unpack(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The integers of the streams in data (bytes), each from its start to its end: (values of all, how many each has)."""
    halves = np.empty(2 * len(data) + 8, np.uint8)
    halves[0 : 2 * len(data) : 2], halves[1 : 2 * len(data) : 2], halves[2 * len(data) :] = data >> 4, data & 15, 0
    place, counts = _heads(halves, 2 * starts, 2 * ends)
    head = halves[place]
    held = _HELD[head]
    value = np.zeros(len(place), np.int64)
    for j in range(8):
        value |= np.where(held > j, halves[np.minimum(place + 1 + j, len(halves) - 1)].astype(np.int64) << (4 * j), 0)
    value |= np.where(head > 8, (0xFFFFFFFF << (4 * held)) & 0xFFFFFFFF, 0)
    return np.where(value >> 31 != 0, value - (1 << 32), value), counts


def _rounded(values: np.ndarray) -> np.ndarray:
    return np.trunc(values + 0.5).astype(np.int64)


def _gathered(data: np.ndarray, starts: np.ndarray, width: int, kind: str) -> np.ndarray:
    return np.ascontiguousarray(data[starts[:, None] + np.arange(width)]).view(kind).ravel() if len(starts) else np.zeros(0, kind)


def _points(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    if (sizes < 8).any():
        raise ValueError("no fixed point in the data")
    return _gathered(data, starts, 8, ">f8").astype(np.float64)


def _assembled(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all, bytes of each) of rows that consist of one piece of each part, in order."""
    sizes = sum(size for _, size in parts)
    out, at = np.empty(int(sizes.sum()), np.uint8), _offsets(sizes)[:-1]
    for data, size in parts:
        out[np.repeat(at, size) + _within(size)] = data
        at = at + size
    return out, sizes


def encode_linear_batch(values: np.ndarray, counts: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Residuals of a straight-line prediction of the values times the fixed point."""
    v, place = _rounded(values * np.repeat(points, counts)), _within(counts)
    first = (v[place < 2] & 0xFFFFFFFF).astype("<u4").view(np.uint8)
    rest = np.flatnonzero(place >= 2)
    packed = pack(v[rest] - 2 * v[rest - 1] + v[rest - 2], np.maximum(counts - 2, 0))
    return _assembled([(points.astype(">f8").view(np.uint8), np.full(len(counts), 8)), (first, 4 * np.minimum(counts, 2)), packed])


def decode_linear_batch(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = ends - starts
    points = _points(data, starts, sizes)
    if ((sizes > 8) & (sizes < 16) & (sizes != 12)).any():
        raise ValueError("truncated linear data")
    rest, more = unpack(data, np.minimum(starts + 16, ends), ends)
    counts = np.where(sizes == 8, 0, np.where(sizes == 12, 1, 2)) + more
    place = _within(counts)
    steps = np.zeros(len(place), np.int64)
    steps[place >= 2] = rest
    base = _offsets(counts)[:-1]
    one, two = np.flatnonzero(counts > 0), np.flatnonzero(counts > 1)
    begin, second = _gathered(data, starts[one] + 8, 4, "<u4").astype(np.int64), _gathered(data, starts[two] + 12, 4, "<u4").astype(np.int64)
    by_row = np.zeros(len(counts), np.int64)
    by_row[one] = begin
    steps[base[two] + 1] = second - by_row[two]
    steps = _segment_sums(steps, counts)  # each residual changes the step
    steps[base[one]] = begin
    return _segment_sums(steps, counts) / np.repeat(points, counts), counts


def encode_pic_batch(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return pack(_rounded(values), counts)


def decode_pic_batch(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts; data of any length, however short."""
    values, counts = unpack(data, starts, ends)
    return values.astype(np.float64), counts


def encode_slof_batch(values: np.ndarray, counts: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    v = _rounded(np.log(values + 1) * np.repeat(points, counts))
    return _assembled([(points.astype(">f8").view(np.uint8), np.full(len(counts), 8)), ((v & 0xFFFF).astype("<u2").view(np.uint8), 2 * counts)])


def decode_slof_batch(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    points = _points(data, starts, ends - starts)
    counts = (ends - starts - 8) // 2
    codes = _gathered(data, np.repeat(starts + 8, counts) + 2 * _within(counts), 2, "<u2")
    return np.exp(codes / np.repeat(points, counts)) - 1, counts


def _one(values) -> tuple[np.ndarray, np.ndarray]:
    v = np.asarray(values, np.float64)
    return v, np.array([len(v)])


def _whole(how, data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    return how(raw, np.array([0]), np.array([len(raw)]))[0]


def encode_linear(values, fixed_point: float) -> bytes:
    return encode_linear_batch(*_one(values), np.array([float(fixed_point)]))[0].tobytes()


def decode_linear(data: bytes) -> np.ndarray:
    return _whole(decode_linear_batch, data)


def encode_pic(values) -> bytes:
    return encode_pic_batch(*_one(values))[0].tobytes()


def decode_pic(data: bytes) -> np.ndarray:
    return _whole(decode_pic_batch, data)


def encode_slof(values, fixed_point: float) -> bytes:
    return encode_slof_batch(*_one(values), np.array([float(fixed_point)]))[0].tobytes()


def decode_slof(data: bytes) -> np.ndarray:
    return _whole(decode_slof_batch, data)


def slof_fixed_point(values) -> float:
    """The largest fixed point with which the largest value still fits; 1 if none is above nought."""
    top = float(np.max(values, initial=0.0))
    return float(np.floor(SLOF_TOP / np.log(top + 1))) if top > 0 else 1.0


def linear_fixed_point(values) -> float:
    """The largest fixed point with which values and residuals fit: 31 bits, or 32 for a single value; 0 for no values.

    Values are taken to be positive, as m/z are.
    """
    v = np.asarray(values, np.float64)
    if len(v) == 0:
        return 0.0
    if len(v) == 1:
        return float(np.floor(0xFFFFFFFF / v[0]))
    residuals = np.ceil(np.abs(v[2:] - (2 * v[1:-1] - v[:-2])) + 1)
    return float(np.floor(0x7FFFFFFF / max(float(v[:2].max()), float(residuals.max(initial=0.0)))))


def linear_fixed_point_for(values, accuracy: float) -> float:
    """The fixed point that keeps every value within the accuracy; -1 if it is above linear_fixed_point(); 0 for fewer than three values."""
    v = np.asarray(values, np.float64)
    if len(v) < 3:
        return 0.0
    point = 0.5 / accuracy
    return -1.0 if point > linear_fixed_point(v) else float(point)


DECODERS = {LINEAR: decode_linear_batch, PIC: decode_pic_batch, SLOF: decode_slof_batch}


def decode(term: str, data: bytes) -> np.ndarray:
    """By the codec's accession."""
    if term not in DECODERS:
        raise ValueError(f"no codec has the accession {term}")
    return _whole(DECODERS[term], data)


def _as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of binary, or of lists of byte values, signed or not; rows that are null have none."""
    if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        offsets = column.offsets.to_numpy().astype(np.int64)
        return (column.values.to_numpy(zero_copy_only=False).astype(np.int64) & 255).astype(np.uint8), offsets
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, 8 * column.offset) if offsets else np.zeros(len(column) + 1, np.int64)
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), offsets


def decoder(term: str):
    """A function of a column (binary, or array of byte values) that gives array<double>; NULL for NULL."""
    how = DECODERS[term]

    def decoded(column: pa.Array) -> pa.Array:
        data, offsets = _as_bytes(column)
        some = column.is_valid().to_numpy(zero_copy_only=False)
        values, held = how(data, offsets[:-1][some], offsets[1:][some])
        counts = np.zeros(len(column), np.int64)
        counts[some] = held
        return pa.ListArray.from_arrays(pa.array(_offsets(counts), pa.int32()), pa.array(values, pa.float64()), mask=pa.array(~some))

    return F.arrow_udf(decoded, "array<double>")


def encoder(term: str, fixed_point: float | None = None):
    """A function of an array<double> column that gives binary; NULL for NULL; without a fixed point LINEAR and SLOF take the best of each array."""

    def encoded(column: pa.Array) -> pa.Array:
        some = column.is_valid().to_numpy(zero_copy_only=False)
        kept = column.drop_null()
        values, offsets = kept.flatten().to_numpy(zero_copy_only=False).astype(np.float64), _offsets(pa.compute.list_value_length(kept).to_numpy(zero_copy_only=False).astype(np.int64))
        counts = np.diff(offsets)
        if term == PIC:
            data, sizes = encode_pic_batch(values, counts)
        else:
            best = linear_fixed_point if term == LINEAR else slof_fixed_point
            own = [fixed_point] * len(counts) if fixed_point else [best(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
            data, sizes = (encode_linear_batch if term == LINEAR else encode_slof_batch)(values, counts, np.array(own, np.float64))
        all_sizes = np.zeros(len(column), np.int64)
        all_sizes[some] = sizes
        valid = pa.py_buffer(np.packbits(some, bitorder="little").tobytes())
        return pa.Array.from_buffers(pa.binary(), len(column), [valid, pa.py_buffer(_offsets(all_sizes).astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])

    return F.arrow_udf(encoded, "binary")
