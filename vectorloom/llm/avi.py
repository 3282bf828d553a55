"""Media columns: AVI motion-JPEG files in binary columns.

`write_avi` stores bytes losslessly: every byte is one quantised DCT coefficient of an 8 x 8 block (64 bytes a block, in
zigzag order). Byte values map one to one onto the 256 coefficients of magnitude category 8, so each coefficient takes a
one-bit code and eight bits; each block is its own restart interval. Frames are ordinary baseline JPEG images of one
fixed size; blocks past the payload's end in the last frame are all zero, which no data block is.

`read_avi` parses the RIFF tree, takes frames from the idx1 index (or an OpenDML index; or, without either, from the
movi list itself), and `decode` reads any baseline 8-bit JPEG frames, with tables of their own or the standard's: Huffman codes are
decoded for all restart intervals of a batch at once, then dequantised and transformed in exact integer arithmetic, so
equal files give equal values in any batch. Shots are cut where the difference of two frames' luma histograms exceeds a
threshold that adapts to the differences around it; clips are timed by the file's frame rate.

Null texts read as empty. Empty texts store 64 zero bytes. Long texts are handled some frames at a time. Tables without
rows give no rows. Media that are null, not AVI, or use other codings give no clips and a null feature.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom.llm._spark import arrow_batches
from vectorloom.llm._text import byte_column

#: Blocks of a stored frame's side, frame rate, histogram bins; shots: window, deviations over its mean, least difference.
SIDE, FPS, BINS = 4, 25, 32
WINDOW, DEVIATIONS, LEAST = 8, 2.0, 0.08
BLOCKS = SIDE * SIDE
GROUP = 4096  # frames handled at once


@cache
def zigzag() -> np.ndarray:
    """Natural index of each zigzag position."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([r * 8 + c for r, c in cells])


@cache
def inverse_dct() -> np.ndarray:
    """64 x 64: zigzag coefficients to samples, scaled by 2^14 and rounded, so that sums of products are exact."""
    u = np.arange(8)
    basis = np.cos((2 * u[:, None] + 1) * u[None, :] * np.pi / 16) * np.where(u == 0, np.sqrt(0.125), 0.5)
    full = np.einsum("xu,yv->uvxy", basis, basis).reshape(64, 64)
    return np.rint(full[zigzag()] * (1 << 14))


# Fixed values of the JPEG standard (its annex K.3), which motion-JPEG frames may rely on without carrying them: for each
# table, how many codes have 1 to 16 bits, and the symbols in code order.
DEFAULT_TABLES = {
    0x00: (
        "00 01 05 01 01 01 01 01 01 00 00 00 00 00 00 00",
        "00 01 02 03 04 05 06 07 08 09 0a 0b",
    ),
    0x01: (
        "00 03 01 01 01 01 01 01 01 01 01 00 00 00 00 00",
        "00 01 02 03 04 05 06 07 08 09 0a 0b",
    ),
    0x10: (
        "00 02 01 03 03 02 04 03 05 05 04 04 00 00 01 7d",
        "01 02 03 00 04 11 05 12 21 31 41 06 13 51 61 07 22 71 14 32 81 91 a1 08 23 42 b1 c1 15 52 d1 f0 "
        "24 33 62 72 82 09 0a 16 17 18 19 1a 25 26 27 28 29 2a 34 35 36 37 38 39 3a 43 44 45 46 47 48 49 "
        "4a 53 54 55 56 57 58 59 5a 63 64 65 66 67 68 69 6a 73 74 75 76 77 78 79 7a 83 84 85 86 87 88 89 "
        "8a 92 93 94 95 96 97 98 99 9a a2 a3 a4 a5 a6 a7 a8 a9 aa b2 b3 b4 b5 b6 b7 b8 b9 ba c2 c3 c4 c5 "
        "c6 c7 c8 c9 ca d2 d3 d4 d5 d6 d7 d8 d9 da e1 e2 e3 e4 e5 e6 e7 e8 e9 ea f1 f2 f3 f4 f5 f6 f7 f8 "
        "f9 fa",
    ),
    0x11: (
        "00 02 01 02 04 04 03 04 07 05 04 04 00 01 02 77",
        "00 01 02 03 11 04 05 21 31 06 12 41 51 07 61 71 13 22 32 81 08 14 42 91 a1 b1 c1 09 23 33 52 f0 "
        "15 62 72 d1 0a 16 24 34 e1 25 f1 17 18 19 1a 26 27 28 29 2a 35 36 37 38 39 3a 43 44 45 46 47 48 "
        "49 4a 53 54 55 56 57 58 59 5a 63 64 65 66 67 68 69 6a 73 74 75 76 77 78 79 7a 82 83 84 85 86 87 "
        "88 89 8a 92 93 94 95 96 97 98 99 9a a2 a3 a4 a5 a6 a7 a8 a9 aa b2 b3 b4 b5 b6 b7 b8 b9 ba c2 c3 "
        "c4 c5 c6 c7 c8 c9 ca d2 d3 d4 d5 d6 d7 d8 d9 da e2 e3 e4 e5 e6 e7 e8 e9 ea f2 f3 f4 f5 f6 f7 f8 "
        "f9 fa",
    ),
}


def default_table(number: int) -> tuple[bytes, bytes]:
    """Code lengths and symbols of a default table."""
    lengths, symbols = DEFAULT_TABLES[number]
    return bytes.fromhex(lengths), bytes.fromhex(symbols)


def lookup(lengths: bytes, symbols: bytes) -> np.ndarray:
    """For each 16 bits, the length of the code they begin with and its symbol, as length * 256 + symbol."""
    table, code, k = np.zeros(65536, np.int32), 0, 0
    for bits in range(1, 17):
        for _ in range(lengths[bits - 1]):
            table[code << (16 - bits) : (code + 1) << (16 - bits)] = bits << 8 | symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return table


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


@cache
def jpeg_head(side: int) -> bytes:
    """Everything before a stored frame's entropy-coded data."""
    table = lambda kind, long: bytes([kind, 1, 1, *[0] * 14, long, 0])  # noqa: E731  code 0: category 8; code 10: zero or end
    return (
        b"\xff\xd8"
        + _segment(0xDB, bytes([0]) + bytes([1] * 64))
        + _segment(0xC0, struct.pack(">BHHB", 8, side * 8, side * 8, 1) + bytes([1, 0x11, 0]))
        + _segment(0xC4, table(0x00, 8) + table(0x10, 8))
        + _segment(0xDD, struct.pack(">H", 1))
        + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
    )


def stored_frames(payload: np.ndarray, ends: np.ndarray, side: int = SIDE) -> list[list[bytes]]:
    """JPEG frames of each payload; payloads follow one another in `payload`, and end at `ends` (multiples of 64)."""
    per, head = side * side, jpeg_head(side)
    blocks_of = np.diff(np.concatenate([[0], ends])) // 64
    frames: list[list[bytes]] = [[] for _ in ends]
    n = len(payload) // 64
    first = np.concatenate([[0], np.cumsum(blocks_of)])
    within = np.arange(n) - np.repeat(first[:-1], blocks_of)
    step = GROUP * per
    edge = 0
    while edge < n:
        stop = min(n, edge + step)
        if stop < n:  # cut between frames
            stop -= int(within[stop]) % per if within[stop] % per < stop - edge else 0
        part = np.unpackbits(payload[edge * 64 : stop * 64].reshape(-1, 64, 1), axis=2)
        bits = np.zeros((stop - edge, 64, 9), np.uint8)
        bits[:, :, 1:] = part
        coded = np.packbits(bits.reshape(-1, 576), axis=1)
        full = coded == 255
        grown = 72 + full.sum(1) + 2
        at = np.concatenate([[0], np.cumsum(grown)])
        out = np.zeros(at[-1], np.uint8)
        place = np.arange(72)[None, :] + np.cumsum(full, 1) - full + at[:-1, None]
        out[place.ravel()] = coded.ravel()
        out[at[1:] - 2] = 255
        out[at[1:] - 1] = 0xD0 + within[edge:stop] % per % 8
        stream, own = out.tobytes(), within[edge:stop]
        heads = np.flatnonzero(own % per == 0)
        doc = np.searchsorted(first, heads + edge, "right") - 1
        tails = np.minimum(np.minimum(heads + per, first[doc + 1] - edge), stop - edge)
        for d, a, b in zip(doc.tolist(), heads.tolist(), tails.tolist()):
            body = stream[at[a] : at[b] - 2]
            for blank in range(b - a, per):
                body += bytes([0xFF, 0xD0 + (blank - 1) % 8, 0xAF])
            frames[d].append(head + body + b"\xff\xd9")
        edge = stop
    return frames


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def avi_file(frames: list[bytes], width: int, height: int, fps: int = FPS) -> bytes:
    """A RIFF AVI file with one motion-JPEG stream and an idx1 index."""
    largest = max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // fps, largest * fps, 0, 0x10, len(frames), 0, 1, largest, width, height, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, fps, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    chunks = [_chunk(b"00dc", f) for f in frames]
    size = np.array([len(f) for f in frames], np.uint32)
    index = np.zeros((len(frames), 4), "<u4")
    index[:, 0], index[:, 1], index[:, 3] = int.from_bytes(b"00dc", "little"), 0x10, size
    index[:, 2] = 4 + np.concatenate([[0], np.cumsum(8 + size + (size & 1))[:-1]]) if len(frames) else 0
    movi = _chunk(b"LIST", b"movi" + b"".join(chunks))
    body = b"AVI " + hdrl + movi + _chunk(b"idx1", index.tobytes())
    return b"RIFF" + struct.pack("<I", len(body)) + body


def _chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while at + 8 <= end:
        size = struct.unpack_from("<I", data, at + 4)[0]
        yield data[at : at + 4], at + 8, min(end, at + 8 + size)
        at += 8 + size + (size & 1)


def read_avi(data: bytes) -> tuple[list[bytes], float]:
    """The video frames of an AVI file and its milliseconds a frame. ValueError if it is none."""
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    frame_ms, stream, movi, idx1, spans = 1000 / FPS, 0, None, None, []
    super_index: list[tuple[int, int]] = []
    for riff, at, end in _chunks(data, 0, len(data)):
        if riff != b"RIFF":
            continue
        for name, a, b in _chunks(data, at + 4, end):
            kind = data[a : a + 4] if name == b"LIST" else name
            if kind == b"hdrl":
                number = 0
                for sub, c, d in _chunks(data, a + 4, b):
                    if sub == b"avih":
                        frame_ms = struct.unpack_from("<I", data, c)[0] / 1000
                    elif sub == b"LIST":
                        inner = {x: (y, z) for x, y, z in _chunks(data, c + 4, d)}
                        if b"strh" in inner and data[inner[b"strh"][0] : inner[b"strh"][0] + 4] == b"vids":
                            stream = number
                            scale, rate = struct.unpack_from("<II", data, inner[b"strh"][0] + 20)
                            frame_ms = 1000 * scale / rate if rate else frame_ms
                            if b"indx" in inner:
                                base = inner[b"indx"][0]
                                for i in range(struct.unpack_from("<I", data, base + 4)[0]):
                                    super_index.append(struct.unpack_from("<QI", data, base + 24 + 16 * i))
                        number += 1
            elif kind == b"movi":
                movi = movi or (a, b)
                spans.append((a + 4, b))
            elif kind == b"idx1":
                idx1 = np.frombuffer(data[a : a + (b - a) // 16 * 16], "<u4").reshape(-1, 4)
    want = [f"{stream:02d}{kind}".encode() for kind in ("dc", "db")]
    if super_index:
        frames = []
        for where, _ in super_index:
            count, base = struct.unpack_from("<I", data, where + 12)[0], struct.unpack_from("<Q", data, where + 20)[0]
            for offset, size in np.frombuffer(data, "<u4", count * 2, where + 32).reshape(-1, 2).tolist():
                frames.append(data[base + offset : base + offset + (size & 0x7FFFFFFF)])
        return frames, frame_ms
    if idx1 is not None and movi is not None and len(idx1):
        rows = idx1[np.isin(idx1[:, 0], [int.from_bytes(w, "little") for w in want])].tolist()
        base = movi[0] if rows and data[movi[0] + rows[0][2] : movi[0] + rows[0][2] + 4] in want else 0
        return [data[base + r[2] + 8 : base + r[2] + 8 + r[3]] for r in rows], frame_ms
    return [data[a:b] for lo, hi in spans for name, a, b in _chunks(data, lo, hi) if name in want], frame_ms


@cache
def jpeg_tables(head: bytes) -> dict:
    """What the segments before the entropy-coded data say."""
    out: dict = {"q": {}, "huff": {}, "restart": 0}
    at = 2
    while at + 4 <= len(head):
        marker, size = head[at + 1], struct.unpack_from(">H", head, at + 2)[0]
        body = head[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                out["q"][body[0] & 15] = np.frombuffer(body, ">u2" if wide else "u1", 64, 1).astype(np.float64)
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                total = sum(body[1:17])
                out["huff"][body[0]] = lookup(body[1:17], body[17 : 17 + total])
                body = body[17 + total :]
        elif marker == 0xC0:
            _, out["height"], out["width"], n = struct.unpack_from(">BHHB", body)
            out["parts"] = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("not a baseline JPEG frame")
        elif marker == 0xDD:
            out["restart"] = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            out["scan"] = {body[1 + 2 * i]: (body[2 + 2 * i] >> 4, 0x10 | body[2 + 2 * i] & 15) for i in range(body[0])}
    if "scan" not in out or "parts" not in out:
        raise ValueError("JPEG frame without a header")
    for number in DEFAULT_TABLES:
        if number not in out["huff"]:
            out["huff"][number] = lookup(*default_table(number))
    return out


def _head_length(frame: bytes) -> int:
    at = 2
    while at + 4 <= len(frame):
        size = struct.unpack_from(">H", frame, at + 2)[0]
        if frame[at + 1] == 0xDA:
            return at + 2 + size
        at += 2 + size
    raise ValueError("JPEG frame without a scan")


def coefficients(frames: list[bytes], head: bytes) -> tuple[np.ndarray, np.ndarray, dict]:
    """Quantised coefficients (frames, blocks, 64) in zigzag order of frames that share one head; each block's component."""
    t = jpeg_tables(head)
    wide, high = max(p[1] for p in t["parts"]), max(p[2] for p in t["parts"])
    if len(t["parts"]) == 1:
        wide = high = 1
    plan = [(i, *t["scan"][p[0]]) for i, p in enumerate(t["parts"]) for _ in range(1 if len(t["parts"]) == 1 else p[1] * p[2])]
    mcus = -(-t["width"] // (8 * wide)) * -(-t["height"] // (8 * high))
    each = t["restart"] or mcus
    runs = -(-mcus // each)
    size = np.array([len(f) - len(head) for f in frames])
    data = np.frombuffer(b"".join(f[len(head) :] for f in frames), np.uint8)
    begin = np.concatenate([[0], np.cumsum(size)[:-1]])
    mark = np.flatnonzero(data[:-1] == 255)
    follow = data[mark + 1]
    restart = mark[(follow >= 0xD0) & (follow <= 0xD7)]
    keep = np.ones(len(data) + 1, bool)
    keep[mark[follow == 0] + 1] = False
    gone = mark[(follow != 0) & (follow != 255)]
    keep[gone] = keep[gone + 1] = False
    keep = keep[:-1]
    starts = np.sort(np.concatenate([begin, restart + 2]))
    if len(starts) != len(frames) * runs:
        raise ValueError("JPEG frame with missing restart intervals")
    place = np.cumsum(keep) - keep
    bit = place[np.minimum(starts, len(data) - 1)].astype(np.int64) * 8
    clean = np.concatenate([data[keep], np.full(8, 255, np.uint8)]).astype(np.int64)
    word = clean[:-2] << 16 | clean[1:-1] << 8 | clean[2:]
    last = len(word) * 8 - 1

    def peek(at):
        at = np.minimum(at, last)
        return word[at >> 3] >> (8 - (at & 7)) & 0xFFFF

    def take(at, bits):
        raw = peek(at) >> (16 - bits)
        return np.where(bits == 0, 0, np.where(raw >> np.maximum(bits - 1, 0) & 1, raw, raw - (1 << bits) + 1))

    out = np.zeros((len(starts), each * len(plan), 64), np.int16)
    before = np.zeros((len(starts), len(t["parts"])), np.int64)
    left = np.tile(np.minimum(each, mcus - np.arange(runs) * each), len(frames))
    for mcu in range(each):
        for slot, (part, dc, ac) in enumerate(plan):
            live = np.flatnonzero(left > mcu)
            block = mcu * len(plan) + slot
            hit = t["huff"][dc][peek(bit[live])]
            bit[live] += hit >> 8
            before[live, part] += take(bit[live], hit & 15)
            out[live, block, 0] = before[live, part]
            bit[live] += hit & 15
            k = np.ones(len(live), np.int64)
            while len(live):
                hit = t["huff"][ac][peek(bit[live])]
                bit[live] += hit >> 8
                run, bits = hit >> 4 & 15, hit & 15
                k += np.where((bits == 0) & (run < 15), 64, np.where(bits == 0, 16, run))
                on = k < 64
                on_bits = bits > 0
                put = on & on_bits
                rows = live[put]
                out[rows, block, k[put]] = take(bit[rows], bits[put])
                bit[rows] += bits[put]
                k += on_bits
                if not (on := k < 64).all():
                    live, k = live[on], k[on]
    out = out.reshape(len(frames), runs * each * len(plan), 64)[:, : mcus * len(plan)]
    return out, np.tile([p[0] for p in plan], mcus), t


def decode(frames: list[bytes], bins: int = BINS) -> tuple[np.ndarray, list[bytes]]:
    """Luma histogram of each frame, and the bytes that `write_avi` stored in it (empty for frames of other makers)."""
    histograms, stored = np.zeros((len(frames), bins), np.int64), [b""] * len(frames)
    by_head: dict[bytes, list[int]] = {}
    for i, f in enumerate(frames):
        by_head.setdefault(f[: _head_length(f)], []).append(i)
    for head, ids in by_head.items():
        for lo in range(0, len(ids), GROUP):
            part = ids[lo : lo + GROUP]
            c, component, t = coefficients([frames[i] for i in part], head)
            luma = c[:, component == 0]
            n = luma.shape[1]
            flat = luma.reshape(-1, 64)
            samples = flat * t["q"][t["parts"][0][3]] @ inverse_dct()
            samples = np.clip(np.floor((samples + (1 << 13)) / (1 << 14)) + 128, 0, 255).astype(np.int64)
            cell = samples * bins >> 8
            cell += np.repeat(np.arange(len(part)), n)[:, None] * bins
            histograms[part] = np.bincount(cell.ravel(), minlength=len(part) * bins).reshape(-1, bins)
            size = np.abs(luma)
            whole = ((size >= 128) & (size <= 255)).all(2)
            data = np.where(luma > 0, luma, luma + 255).astype(np.uint8)
            for k, i in enumerate(part):
                stored[i] = data[k][whole[k]].tobytes()
    return histograms, stored


def shots(histograms: np.ndarray) -> list[tuple[int, int, float]]:
    """(first frame, frame after the last, difference at its start) of each shot.

    A difference is a cut if it stands out from its neighbours; with fewer than two of these, in files of two or three
    frames, nothing can stand out, and the file is one shot."""
    n = len(histograms)
    if not n:
        return []
    total = np.maximum(histograms.sum(1), 1)
    share = histograms / total[:, None]
    d = np.abs(np.diff(share, axis=0)).sum(1) / 2
    cuts = [(0, 0.0)]
    for i in range(len(d)):
        near = np.concatenate([d[max(0, i - WINDOW) : i], d[i + 1 : i + 1 + WINDOW]])
        if len(near) >= 2 and d[i] > max(LEAST, near.mean() + DEVIATIONS * near.std()):
            cuts.append((i + 1, float(d[i])))
    ends = [c[0] for c in cuts[1:]] + [n]
    return [(a, b, x) for (a, x), b in zip(cuts, ends)]


def write_avi(payloads: list[bytes], side: int = SIDE) -> list[bytes]:
    """AVI files that store the payloads, whose lengths are positive multiples of 64."""
    ends = np.cumsum([len(p) for p in payloads])
    data = np.frombuffer(b"".join(payloads), np.uint8)
    return [avi_file(f, side * 8, side * 8) for f in stored_frames(data, ends, side)] if payloads else []


def padded(data: bytes) -> bytes:
    return data + b"\0" * (-len(data) % 64 if data else 64)


def encode_media(df: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """df with a column of AVI files that store its texts, padded by zero bytes to a positive multiple of 64."""
    arrow_batches(df.sparkSession)

    def run(batches):
        for batch in batches:
            data, at = byte_column(batch.column(batch.schema.get_field_index(text)))
            files = write_avi([padded(data[a:b].tobytes()) for a, b in zip(at[:-1], at[1:])])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(files, pa.binary())], [*batch.schema.names, media])

    return df.mapInArrow(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, `{media}` binary")


def analyse(files: list[bytes | None]) -> list[dict | None]:
    """Per file: its frames, milliseconds a frame, shots, and stored bytes; None if it can't be read."""
    opened: list = []
    for f in files:
        try:
            opened.append(read_avi(f) if f is not None else None)
        except (ValueError, struct.error):
            opened.append(None)
    frames = [x for o in opened if o for x in o[0]]
    try:
        histograms, stored = decode(frames)
    except (ValueError, KeyError, IndexError, struct.error):
        return [None] * len(files) if len(files) == 1 else [analyse([f])[0] for f in files]
    out, at = [], 0
    for o in opened:
        if o is None:
            out.append(None)
            continue
        n = len(o[0])
        out.append({"frames": n, "frame_ms": o[1], "shots": shots(histograms[at : at + n]), "stored": b"".join(stored[at : at + n])})
        at += n
    return out


def media_clips(df: DataFrame, key: str, media: str = "media") -> DataFrame:
    """A row per shot of each AVI file: key, clip, first_frame, n_frames, start_ms, end_ms, difference."""

    def run(batches):
        for batch in batches:
            rows = []
            for k, x in zip(batch.column(0).to_pylist(), analyse(batch.column(1).to_pylist())):
                for i, (a, b, d) in enumerate(x["shots"] if x else []):
                    rows.append((k, i, a, b - a, a * x["frame_ms"], b * x["frame_ms"], d))
            types = [batch.schema.field(0).type, pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64()]
            names = [batch.schema.names[0], "clip", "first_frame", "n_frames", "start_ms", "end_ms", "difference"]
            columns = list(zip(*rows)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    kind = df.select(key).schema[0].dataType.simpleString()
    return df.select(key, media).mapInArrow(run, f"`{key}` {kind}, clip int, first_frame int, n_frames int, start_ms double, end_ms double, difference double")


def feature(x: dict | None) -> str | None:
    if x is None:
        return None
    clips = ",".join(f"{a * x['frame_ms']:.0f}-{b * x['frame_ms']:.0f}:{d:.4f}" for a, b, d in x["shots"])
    return f"frames={x['frames']};shots={len(x['shots'])};clips={clips}"


def media_digest(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Store each text as an AVI file, read the file back, and return digests of both and the file's clips."""
    arrow_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            data, at = byte_column(batch.column(1))
            files = write_avi([padded(data[a:b].tobytes()) for a, b in zip(at[:-1], at[1:])])
            rows = []
            for k, n, f, x in zip(batch.column(0).to_pylist(), np.diff(at).tolist(), files, analyse(files)):
                p = x["stored"]
                rows.append((k, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(f), hashlib.sha256(f).hexdigest(), feature(x)))
            types = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = [batch.schema.names[0], "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            columns = list(zip(*rows)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    kind = docs.select(key).schema[0].dataType.simpleString()
    schema = f"`{key}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return docs.select(key, F.col(text).cast("string").alias(text)).mapInArrow(run, schema)


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
