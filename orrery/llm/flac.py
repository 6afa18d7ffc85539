"""FLAC media columns: a decoder for FLAC streams, the lossless encoder that fills them, and features of the samples.

Frames are decoded side by side: every step reads the next residual of all frames of a batch at once, so that the bit by
bit work (unary quotient, Rice remainder) is array work. The decoder reads constant, verbatim, fixed-predictor and LPC
subframes, both Rice parameter sizes, partitions and escapes, wasted bits, mono with 8 to 24 bits a sample; it verifies
the CRC-8 of each header, the CRC-16 of each frame, the sample numbers and the MD5 of all samples, and raises ValueError
on a mismatch. Frames are found through the seek table, else by their sync codes with a valid header and frame checksum.
Decoded samples are written as PCM blocks, one a frame, with the sample offset of each for seeking.

The encoder writes mono 8-bit frames of 576 samples with a seek point for each: fixed predictors of order 0 to 2, one Rice
partition, verbatim where that is shorter, constant where all samples are equal.

Edge cases: a null text is an empty payload; an empty payload is one block of padding; equal texts give equal streams;
repeated rows stay repeated; an empty table gives no rows; further columns are ignored whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, pieces, small_batches, texts_of

BLOCK = 576
PAD = 255
SEEK_POINT = 18


def crc_table(polynomial: int, bits: int) -> np.ndarray:
    out = np.zeros(256, np.uint32)
    for i in range(256):
        x = i << (bits - 8)
        for _ in range(8):
            x = ((x << 1) ^ polynomial) if x >> (bits - 1) & 1 else x << 1
        out[i] = x & ((1 << bits) - 1)
    return out


CRC8, CRC16 = crc_table(0x07, 8), crc_table(0x8005, 16)


#: CRC16_AT[k, b]: what a byte b that k bytes follow adds to the checksum, which is linear.
CRC16_AT = np.zeros((1024, 256), np.uint16)
CRC16_AT[0] = CRC16
for _k in range(1, len(CRC16_AT)):
    _before = CRC16_AT[_k - 1].astype(np.uint32)
    CRC16_AT[_k] = ((_before << np.uint32(8)) & np.uint32(0xFFFF)) ^ CRC16[_before >> np.uint32(8)]
CRC16_FLAT = CRC16_AT.ravel()


def crc(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, bits: int) -> np.ndarray:
    """Checksums of many byte runs; both checksums start at 0, so runs can stand right-aligned behind zeros."""
    value = np.zeros(len(starts), np.uint32)
    if not len(starts):
        return value
    longest = int(lengths.max())
    if bits == 16 and longest <= len(CRC16_AT) and int(lengths.min()) > 0:
        for at in range(0, len(starts), 512):
            n, first = lengths[at : at + 512], starts[at : at + 512]
            to = np.cumsum(n)
            place = np.arange(to[-1])
            byte = data[place + np.repeat(first - to + n, n)]
            key = ((np.repeat(to, n) - 1 - place) << 8) + byte
            value[at : at + 512] = np.bitwise_xor.reduceat(CRC16_FLAT[key], to - n)
        return value
    table = CRC8 if bits == 8 else CRC16
    ends = starts + lengths
    mask = np.uint32((1 << bits) - 1)
    for k in range(longest, 0, -1):
        at = ends - k
        byte = np.where(k <= lengths, data[np.maximum(at, 0)], 0).astype(np.uint32)
        value = ((value << np.uint32(8)) & mask) ^ table[((value >> np.uint32(bits - 8)) ^ byte) & np.uint32(255)]
    return value


def utf8_number(n: int) -> bytes:
    """A frame number in the variable-length code of frame headers."""
    if n < 0x80:
        return bytes([n])
    k = 1
    while n >= 1 << (5 * k + 6 if k == 1 else 5 * k + 6):
        k += 1
    tail = [0x80 | (n >> 6 * i & 0x3F) for i in range(k - 1, -1, -1)]
    return bytes([(0xFF00 >> (k + 1) & 0xFF) | n >> 6 * k, *tail])


HEADERS: list[bytes] = []


def header(n: int) -> bytes:
    """Frame header: fixed block size 576, sample rate and size from STREAMINFO, mono."""
    while len(HEADERS) <= min(n, 20_000):
        h = bytes([0xFF, 0xF8, 0x20, 0x00]) + utf8_number(len(HEADERS))
        HEADERS.append(h + bytes([int(crc(np.frombuffer(h, np.uint8), np.array([0]), np.array([len(h)]), 8)[0])]))
    if n < len(HEADERS):
        return HEADERS[n]
    h = bytes([0xFF, 0xF8, 0x20, 0x00]) + utf8_number(n)
    return h + bytes([int(crc(np.frombuffer(h, np.uint8), np.array([0]), np.array([len(h)]), 8)[0])])


def encode(payloads: list[bytes]) -> list[bytes]:
    """FLAC streams of payloads, each a positive multiple of 576 bytes; a byte b is the sample b - 128."""
    if not payloads:
        return []
    samples = (np.frombuffer(b"".join(payloads), np.uint8).astype(np.int32) - 128).reshape(-1, BLOCK)
    n = len(samples)
    best = np.full(n, 8 + 8 * BLOCK)  # bits of a verbatim subframe
    order, rice = np.full(n, -1), np.zeros(n, np.int64)
    residuals, coded = samples, []
    for p in range(3):
        if p:
            residuals = np.diff(residuals, axis=1)
        u = np.where(residuals < 0, -2 * residuals - 1, 2 * residuals)
        coded.append(u)
        mean = u.mean(axis=1)
        for k in range(2, 9):
            close = np.flatnonzero((mean >= 2 ** (k - 2)) & (mean < 2 ** (k + 1.5)) | (k == 2) & (mean < 4))
            bits = 8 + 8 * p + 6 + 4 + (u[close] >> k).sum(axis=1) + (BLOCK - p) * (k + 1)
            better = bits < best[close]
            best[close[better]], order[close[better]], rice[close[better]] = bits[better], p, k
    constant = (samples == samples[:, :1]).all(axis=1)
    best[constant], order[constant] = 16, -2
    number = np.concatenate([np.arange(len(x) // BLOCK) for x in payloads])
    heads = [header(int(i)) for i in number]
    size = np.array([len(h) for h in heads]) + (best + 7) // 8 + 2
    end = np.cumsum(size)
    start = end - size
    body = 8 * (start + size - 2 - (best + 7) // 8)  # first bit of each subframe
    # Each frame is 578 codes (value, bits): type, warm-up samples, coding parameters, residuals; a code of no bits is none.
    value, width = np.zeros((n, BLOCK + 2), np.uint64), np.zeros((n, BLOCK + 2), np.int64)
    value[:, 0], width[:, 0] = np.where(order == -2, 0, np.where(order == -1, 1, 8 + order)) << 1, 8
    for v, many in ((np.flatnonzero(order == -1), BLOCK), (np.flatnonzero(order == -2), 1)):
        value[v, 1 : 1 + many], width[v, 1 : 1 + many] = samples[v, :many] & 255, 8
    for p in range(3):
        v = np.flatnonzero(order == p)
        if len(v):
            value[v, 1 : 1 + p], width[v, 1 : 1 + p] = samples[v, :p] & 255, 8
            value[v, 1 + p], width[v, 1 + p] = rice[v], 10  # coding method 0, partition order 0, parameter
            u, k = coded[p][v], rice[v, None].astype(np.int32)
            value[v, 2 + p :] = (u & ((1 << k) - 1)) | (1 << k)
            width[v, 2 + p :] = (u >> k) + 1 + k
    last = ((np.cumsum(width, axis=1) + (body - 1)[:, None])).ravel()  # last bit of each code
    value = value.ravel()
    word, up = last >> 6, (63 - (last & 63)).astype(np.uint64)
    words = np.zeros((int(end[-1]) >> 3) + 2, np.uint64)
    firsts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    words[word[firsts]] = np.add.reduceat(value << up, firsts)
    over = np.where(up > 0, value >> np.minimum(np.uint64(64) - up, np.uint64(63)), 0)
    cross = np.flatnonzero(over)
    words[word[cross] - 1] |= over[cross]
    stream = words.byteswap().view(np.uint8)[: int(end[-1])]
    out_heads = np.frombuffer(b"".join(heads), np.uint8)
    widths = np.array([len(h) for h in heads])
    stream[np.repeat(start - np.cumsum(widths) + widths, widths) + np.arange(len(out_heads))] = out_heads
    check = crc(stream, start, size - 2, 16)
    stream[end - 2], stream[end - 1] = check >> 8, check & 255
    raw, out, at = stream.tobytes(), [], 0
    for x in payloads:
        k = len(x) // BLOCK
        a, b = int(start[at]), int(end[at + k - 1])
        points = np.zeros(k, np.dtype([("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")]))
        points["sample"], points["offset"], points["n"] = np.arange(k) * BLOCK, start[at : at + k] - a, BLOCK
        signed = (np.frombuffer(x, np.uint8) ^ np.uint8(128)).tobytes()
        part = size[at : at + k]
        info = BLOCK.to_bytes(2) * 2 + int(part.min()).to_bytes(3) + int(part.max()).to_bytes(3)
        info += (8000 << 44 | 0 << 41 | 7 << 36 | len(x)).to_bytes(8) + hashlib.md5(signed).digest()
        tables = points.tobytes()
        cuts = [tables[i : i + SEEK_POINT * 900_000] for i in range(0, len(tables), SEEK_POINT * 900_000)]
        blocks = b"".join(bytes([3 | 128 * (i == len(cuts) - 1)]) + len(c).to_bytes(3) + c for i, c in enumerate(cuts))
        out.append(b"fLaC" + bytes([0]) + len(info).to_bytes(3) + info + blocks + raw[a:b])
        at += k
    return out


class Stream:
    """Metadata of a FLAC stream: STREAMINFO, seek points and where frames begin."""

    def __init__(self, data: bytes) -> None:
        if data[:4] != b"fLaC":
            raise ValueError("not a FLAC stream")
        at, self.points = 4, []
        while True:
            last, kind, size = data[at] >> 7, data[at] & 127, int.from_bytes(data[at + 1 : at + 4])
            block = data[at + 4 : at + 4 + size]
            if kind == 0:
                self.block = int.from_bytes(block[2:4])
                packed = int.from_bytes(block[10:18])
                self.channels, self.bits, self.n = (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1
                self.md5 = block[18:34]
            elif kind == 3:
                p = np.frombuffer(block, np.dtype([("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")]))
                self.points.extend(p["offset"][p["sample"] != 2**64 - 1].astype(np.int64).tolist())
            at += 4 + size
            if last:
                break
        if self.channels != 1:
            raise ValueError("only mono streams are read")
        self.frames_at = at

    def starts(self, data: bytes) -> np.ndarray:
        """Offsets in data of all frames: the seek table where it has them all, else a search for headers."""
        count = -(-self.n // self.block) if self.n else 0
        if len(self.points) == count and count:
            return self.frames_at + np.array(self.points, np.int64)
        raw = np.frombuffer(data, np.uint8)
        sync = np.flatnonzero((raw[:-1] == 0xFF) & (raw[1:] & 0xFE == 0xF8)) if len(raw) > 1 else np.zeros(0, np.int64)
        found, at = [], self.frames_at
        sync = [int(s) for s in sync if s >= at and parse_header(data, int(s), self) is not None]
        while at < len(data):
            found.append(at)
            for to in [*[s for s in sync if s > at], len(data)]:
                if int(crc(raw, np.array([at]), np.array([to - at]), 16)[0]) == 0:
                    at = to
                    break
            else:
                raise ValueError("no frame end with a valid checksum")
        return np.array(found, np.int64)


def parse_header(data: bytes, at: int, info: Stream) -> tuple[int, int, int] | None:
    """(bytes of the header, samples, frame or sample number) if a valid header with its CRC-8 starts here."""
    h = data[at : at + 16]
    if len(h) < 6 or h[0] != 0xFF or h[1] & 0xFE != 0xF8 or h[3] & 1:
        return None
    size, rate = h[2] >> 4, h[2] & 15
    lead = h[4]
    extra = 0 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length() - 1
    if lead >= 0x80 and not 1 <= extra <= 6 or size == 0 or rate == 15:
        return None
    number = lead if lead < 0x80 else lead & (1 << 6 - extra) - 1
    for x in h[5 : 5 + extra]:
        number = number << 6 | x & 0x3F
    end = 5 + extra
    n = 192 if size == 1 else 576 << size - 2 if size < 6 else 256 << max(0, size - 8)
    if size in (6, 7):
        n = int.from_bytes(h[end : end + size - 5]) + 1
        end += size - 5
    end += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if end >= len(h) or int(crc(np.frombuffer(h, np.uint8), np.array([0]), np.array([end]), 8)[0]) != h[end]:
        return None
    return end + 1, n, number


KNOWN: dict[bytes, tuple[int, int, int]] = {}


class Bits:
    """A read position in each lane of one byte array."""

    def __init__(self, data: np.ndarray, at: np.ndarray) -> None:
        held = np.concatenate([data, np.zeros(16, np.uint8)])
        self.data, self.at = np.ndarray(len(held) - 8, np.uint64, held, strides=(1,)), at.astype(np.int64)  # 8 bytes from each byte on

    def window(self, lanes: np.ndarray) -> np.ndarray:
        """The next 32 bits of the lanes."""
        at = self.at[lanes]
        x = self.data[at >> 3].byteswap()
        x <<= (at & 7).astype(np.uint64)
        x >>= np.uint64(32)
        return x

    def read(self, lanes: np.ndarray, width: int | np.ndarray) -> np.ndarray:
        """Unsigned numbers of up to 32 bits."""
        w = np.broadcast_to(np.asarray(width), lanes.shape)
        out = (self.window(lanes) >> (32 - w).astype(np.uint64)).astype(np.int64)
        self.at[lanes] += w
        return np.where(w > 0, out, 0)

    def signed(self, lanes: np.ndarray, width: int | np.ndarray) -> np.ndarray:
        w = np.broadcast_to(np.asarray(width), lanes.shape)
        out = self.read(lanes, w)
        return np.where(w > 0, out - ((out >> np.maximum(w - 1, 0)) << w), 0)

    def unary(self, lanes: np.ndarray) -> np.ndarray:
        out, left = np.zeros(len(lanes), np.int64), np.arange(len(lanes))
        while len(left):
            x = self.window(lanes[left])
            zeros = 32 - np.frexp(x.astype(np.float64))[1].astype(np.int64)
            out[left] += zeros
            done = x > 0
            self.at[lanes[left]] += zeros + done
            left = left[~done]
        return out


def decode_frames(data: np.ndarray, first_bit: np.ndarray, sizes: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Samples (lanes, longest block) of the subframes that start at these bits, and the bit where each ends."""
    bits, n_lanes = Bits(data, first_bit), len(first_bit)
    every = np.arange(n_lanes)
    head = bits.read(every, 8)
    if (head >> 7).any():
        raise ValueError("bad subframe header")
    kind, wasted = head >> 1 & 63, np.zeros(n_lanes, np.int64)
    more = every[(head & 1) == 1]
    if len(more):
        wasted[more] = bits.unary(more) + 1
    depth = depth - wasted
    out = np.zeros((int(sizes.max(initial=0)), n_lanes), np.int64)
    v = every[kind == 0]
    if len(v):
        out[:, v] = bits.signed(v, depth[v])
    v = every[kind == 1]
    for i in range(len(out) if len(v) else 0):
        w = v[sizes[v] > i]
        out[i, w] = bits.signed(w, depth[w])
    fixed, lpc = (kind >= 8) & (kind <= 12), kind >= 32
    if ((kind > 1) & ~fixed & ~lpc).any():
        raise ValueError("reserved subframe")
    order = np.where(fixed, kind - 8, np.where(lpc, kind - 31, 0))
    coded = every[fixed | lpc]
    for i in range(int(order.max(initial=0))):
        w = coded[order[coded] > i]
        out[i, w] = bits.signed(w, depth[w])
    factors, shift = np.zeros((32, n_lanes), np.int64), np.zeros(n_lanes, np.int64)
    v = every[lpc]
    if len(v):
        precision = bits.read(v, 4) + 1
        shift[v] = bits.signed(v, 5)
        for i in range(int(order[v].max())):
            w = order[v] > i
            factors[i, v[w]] = bits.signed(v[w], precision[w])
    if len(coded):
        method = bits.read(coded, 2)
        if (method > 1).any():
            raise ValueError("reserved residual coding")
        width, parts = np.zeros(n_lanes, np.int64), np.zeros(n_lanes, np.int64)
        width[coded] = 4 + method
        parts[coded] = bits.read(coded, 4)
        each = np.where(sizes > 0, sizes >> parts, 1)
        rice, raw = np.zeros(n_lanes, np.int64), np.full(n_lanes, -1)
        escaped = False
        latest, least, parted = int(order[coded].max()), int(sizes[coded].min()), bool(parts[coded].any())
        for i in range(len(out)):
            lanes = coded if latest <= i < least else coded[(i >= order[coded]) & (i < sizes[coded])]
            new = lanes[(i == order[lanes]) | (i % each[lanes] == 0)] if parted or i <= latest else lanes[:0]
            if len(new):
                rice[new] = bits.read(new, width[new])
                escape = rice[new] == (1 << width[new]) - 1
                raw[new] = -1
                if escape.any():
                    raw[new[escape]] = bits.read(new[escape], 5)
                escaped = bool((raw >= 0).any())
            plain = lanes[raw[lanes] < 0] if escaped else lanes
            x = bits.window(plain)
            zeros = 32 - np.frexp(x.astype(np.float64))[1].astype(np.int64)
            k = rice[plain]
            short = zeros + 1 + k <= 32
            if short.all():
                u = zeros << k | ((x >> np.maximum(31 - zeros - k, 0).astype(np.uint64)).astype(np.int64) & ((1 << k) - 1))
                bits.at[plain] += zeros + 1 + k
            else:
                u = bits.unary(plain) << k
                u |= bits.read(plain, k)
            out[i, plain] = (u >> 1) ^ -(u & 1)
            if len(plain) < len(lanes):
                w = lanes[raw[lanes] >= 0]
                out[i, w] = bits.signed(w, raw[w])
    for p in range(1, 5):
        v = every[fixed & (order == p)]
        if len(v):
            x = out[:, v]
            warm = x[:p].copy()
            firsts = [warm[0]]
            for _ in range(1, p):
                warm = np.diff(warm, axis=0)
                firsts.append(warm[0])
            x = x[p:]
            for q in range(p - 1, -1, -1):
                # the last difference of order q among the warm-up samples, from which the residuals continue
                base = out[:p, v]
                for _ in range(q):
                    base = np.diff(base, axis=0)
                x = np.cumsum(x, axis=0) + base[-1]
            out[p:, v] = x
    v = every[lpc]
    if len(v):
        most = int(order[v].max())
        for i in range(len(out)):
            w = v[(i >= order[v]) & (i < sizes[v])]
            if len(w):
                guess = np.zeros(len(w), np.int64)
                for j in range(min(most, i)):
                    guess += factors[j, w] * out[i - 1 - j, w]
                out[i, w] += np.where(shift[w] >= 0, guess >> np.maximum(shift[w], 0), guess << np.maximum(-shift[w], 0))
    return (out << wasted).T, bits.at


def decode(streams: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, Stream]]:
    """(samples, sample offset of each frame, metadata) of each stream, all checksums verified."""
    if not streams:
        return []
    infos = [Stream(s) for s in streams]
    bases = np.cumsum([0, *[len(s) for s in streams]])
    begin, end, sizes, skip, lane_of, numbers = [], [], [], [], [], []
    for i, (s, info) in enumerate(zip(streams, infos)):
        at = info.starts(s)
        for a, b in zip(at.tolist(), [*at[1:].tolist(), len(s)]):
            key = s[a : a + 16]
            h = KNOWN.get(key[:8]) if key[4] < 0x80 and key[2] >> 4 in (1, 2, 3, 4, 5, *range(8, 16)) and key[2] & 15 < 12 else None
            if h is None:
                h = parse_header(s, a, info)
                if h is None:
                    raise ValueError("bad frame header")
                if h[0] == 6:
                    KNOWN[key[:8]] = h
                    if len(KNOWN) > 50_000:
                        KNOWN.clear()
            begin.append(bases[i] + a)
            end.append(bases[i] + b)
            skip.append(h[0])
            sizes.append(h[1])
            numbers.append(h[2] if key[1] & 1 else h[2] * info.block)
            lane_of.append(i)
    data = np.frombuffer(b"".join(streams), np.uint8)
    begin, end, skip, sizes, lane_of, numbers = (np.array(x, np.int64) for x in (begin, end, skip, sizes, lane_of, numbers))
    left = np.array([info.n for info in infos])[lane_of] - numbers
    sizes = np.minimum(sizes, np.where(left > 0, left, sizes))
    if crc(data, begin, end - begin, 16).any():
        raise ValueError("frame checksum does not match")
    samples, stop = decode_frames(data, 8 * (begin + skip), sizes, np.array([x.bits for x in infos])[lane_of])
    if ((stop + 7) // 8 != end - 2).any():
        raise ValueError("frame length does not match")
    out = []
    first = np.searchsorted(lane_of, np.arange(len(streams) + 1))
    for i, info in enumerate(infos):
        mine = slice(first[i], first[i + 1])
        n = sizes[mine]
        at = np.cumsum(n) - n
        if (numbers[mine] != at).any():
            raise ValueError("sample numbers do not follow")
        rows = samples[mine]
        flat = rows.ravel() if len(n) and (n == rows.shape[1]).all() else rows[np.arange(rows.shape[1]) < n[:, None]]
        wide = (info.bits + 7) // 8
        pcm = flat.astype("<i4").view(np.uint8).reshape(-1, 4)[:, :wide].tobytes() if wide > 1 else flat.astype(np.int8).tobytes()
        if info.md5 != bytes(16) and hashlib.md5(pcm).digest() != info.md5:
            raise ValueError("MD5 of the samples does not match")
        out.append((flat, at, info))
    return out


def payload_of(text: bytes | None) -> bytes:
    text = text or b""
    return text + bytes([PAD]) * (-len(text) % BLOCK if text else BLOCK)


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text (doc_id, text) as a FLAC stream of 8-bit samples."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 1, 1 << 20):
                texts = texts_of(part.column(1))
                media = encode([payload_of(t) for t in texts])
                yield pa.record_batch([part.column(0), pa.array([len(t or b"") for t in texts], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


PCM = "doc_id long, n_bytes long, media_bytes long, media_sha256 string, error string, blocks array<struct<sample_offset:long,n_samples:long,pcm:binary>>"


def decoded(streams: list[bytes | None]) -> list[tuple]:
    """(samples, frame offsets, metadata, error) of each stream; one that is null or can't be read gives an error, not a failed task."""
    try:
        return [(*x, None) for x in decode(streams)] if None not in streams else [x for s in streams for x in (decoded([s]) if s is not None else [(None, None, None, "no stream")])]
    except (ValueError, IndexError, KeyError) as e:
        if len(streams) == 1:
            return [(None, None, None, str(e) or type(e).__name__)]
        return [x for s in streams for x in decoded([s])]


def pcm(media: DataFrame) -> DataFrame:
    """PCM blocks of media (doc_id, n_bytes, media), a row a stream: digest of the stored form, and blocks that can be sought
    by sample_offset (signed little-endian samples). A null or broken stream has null blocks and an error."""
    small_batches(media.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 2, 1 << 20):
                streams = part.column(2).to_pylist()
                ends, offsets, sizes, raw, errors = [0], [], [], [], []
                for flat, at, info, error in decoded(streams):
                    errors.append(error)
                    if error is None:
                        wide = (info.bits + 7) // 8
                        data = flat.astype("<i4").view(np.uint8).reshape(-1, 4)[:, :wide].tobytes() if wide > 1 else flat.astype(np.int8).tobytes()
                        cuts = [*at.tolist(), len(flat)]
                        offsets += cuts[:-1]
                        sizes += [y - x for x, y in zip(cuts, cuts[1:])]
                        raw += [data[x * wide : y * wide] for x, y in zip(cuts, cuts[1:])]
                    ends.append(len(offsets))
                items = pa.StructArray.from_arrays([pa.array(offsets, pa.int64()), pa.array(sizes, pa.int64()), pa.array(raw, pa.binary())], ["sample_offset", "n_samples", "pcm"])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items, mask=pa.array([e is not None for e in errors]))
                digests = [None if m is None else hashlib.sha256(m).hexdigest() for m in streams]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([None if m is None else len(m) for m in streams], pa.int64()), pa.array(digests, pa.string()), pa.array(errors, pa.string()), lists], ["doc_id", "n_bytes", "media_bytes", "media_sha256", "error", "blocks"])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, PCM)


def blocks(media: DataFrame) -> DataFrame:
    """Rows (doc_id, block, sample_offset, n_samples, pcm) of media (doc_id, n_bytes, media)."""
    each = pcm(media).select("doc_id", F.posexplode("blocks").alias("block", "b"))
    return each.select("doc_id", F.col("block").cast("long").alias("block"), "b.*")


def feature_text(x: np.ndarray) -> str:
    """Energy, peak, zero crossings and the sum of absolute differences: exact integers of the samples."""
    d = np.abs(np.diff(x)).sum() if len(x) > 1 else 0
    return f"energy={int((x * x).sum())};peak={int(np.abs(x).max(initial=0))};crossings={int(((x[1:] < 0) != (x[:-1] < 0)).sum())};variation={int(d)};blocks={-(-len(x) // BLOCK)}"


def features(stored: DataFrame) -> DataFrame:
    """Per row of pcm(): digests of the payload read back and of the stored form, and features of the 8-bit samples. Rows
    without blocks keep their ids and sizes and have nulls."""
    small_batches(stored.sparkSession)
    names = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for held in batch.column(4):
                if not held.is_valid:
                    rows.append((None, None, None, None))
                    continue
                flat = np.frombuffer(b"".join(held.values.field(2).to_pylist()), np.int8).astype(np.int64)
                payload = (flat + 128).astype(np.uint8).tobytes()
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), feature_text(flat)))
            n, sha, tail, feature = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(tail, pa.int64()), batch.column(2), batch.column(3), pa.array(feature, pa.string())], [x.split()[0] for x in names.split(", ")])

    return stored.select("doc_id", "n_bytes", "media_bytes", "media_sha256", "blocks").mapInArrow(run, names)


def read_back(docs: DataFrame) -> DataFrame:
    """features() of each text of docs (doc_id, text): streams are written to the shared folder, read again and decoded to PCM
    blocks. blocks() gives those as a table of their own, to be written where samples are to be sought."""
    return features(pcm(Scratch(docs.sparkSession, "flac").table(store(docs), "media")))
