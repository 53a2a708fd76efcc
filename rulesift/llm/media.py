"""Media columns: AVI files of motion JPEG.

``write_avi`` and ``read_avi`` handle RIFF ``AVI `` files with an ``idx1`` index. Frames are JPEG images of one
component: baseline DCT (SOF0) or lossless (SOF3, predictors 1 to 7). ``shots`` finds shot boundaries where the
distance of consecutive frames' histograms exceeds a threshold that follows the distances around it, and gives timed
clips.

The codec for payloads writes lossless frames of 16 x 12 samples with predictor 1 and a Huffman table in which
category s has a code of 9 - s bits. As s more bits follow it, every sample takes exactly 9 bits, and a whole file is
coded and decoded with array operations. The files are ordinary ones: ``read_avi`` decodes frames with any table, one
symbol at a time, where this table isn't met.

Cases: null text is an empty payload; payloads are padded with blanks to a positive multiple of 192 bytes. Equal texts
give equal files and features. Damaged files raise ``ValueError``. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulesift.llm.common import map_pieces, utf8

WIDTH, HEIGHT, FRAMES_PER_SECOND = 16, 12, 25
SAMPLES = WIDTH * HEIGHT
#: Histogram bins of a frame, frames on either side that set the threshold, and deviations above their mean that make a cut.
BINS, AROUND, DEVIATIONS = 16, 8, 3.0
#: A cut needs at least this histogram distance (of at most 2).
LEAST_DISTANCE = 0.3

# --- Huffman tables ---------------------------------------------------------------------------------------------

#: One code of each length from 1 to 9, for the categories 8 to 0.
_BITS, _VALUES = bytes([1] * 9 + [0] * 7), bytes(range(8, -1, -1))
FIXED_TABLE = _BITS + _VALUES


def _codes(bits: bytes, values: bytes) -> dict[tuple[int, int], int]:
    """(length, code) to value, by the canonical rule."""
    found, code, at = {}, 0, 0
    for length, n in enumerate(bits, 1):
        for _ in range(n):
            found[length, code] = values[at]
            code, at = code + 1, at + 1
        code <<= 1
    return found


def _sample_codes() -> np.ndarray:
    """The 9 bits of each difference from -255 to 255."""
    prefix = {v: (length, code) for (length, code), v in _codes(_BITS, _VALUES).items()}
    out = np.zeros(511, np.uint16)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        out[d + 255] = (prefix[s][1] << s) | (d if d >= 0 else d + (1 << s) - 1)
    return out


_ENCODE = _sample_codes()
_DECODE = np.full(512, 1000, np.int16)
_DECODE[_ENCODE] = np.arange(-255, 256)


def _pack(words: np.ndarray) -> np.ndarray:
    """Eight 9-bit words in nine bytes: byte k ends word k - 1 and begins word k."""
    w = np.ascontiguousarray(words.reshape(-1, 8).T)
    out = np.empty((len(words) // 8, 9), np.uint8)
    for k in range(9):
        byte = w[k] >> (k + 1) if k < 8 else 0
        out[:, k] = byte | ((w[k - 1] & ((1 << k) - 1)) << (8 - k)) if k else byte
    return out.reshape(-1)


def _unpack(data: np.ndarray) -> np.ndarray:
    b = np.ascontiguousarray(data.reshape(-1, 9).T).astype(np.uint16)
    out = np.empty((b.shape[1], 8), np.uint16)
    for k in range(8):
        out[:, k] = ((b[k] & ((1 << (8 - k)) - 1)) << (k + 1)) | (b[k + 1] >> (7 - k))
    return out.reshape(-1)


# --- JPEG -------------------------------------------------------------------------------------------------------


def _segment(marker: int, data: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(data) + 2) + data


_HEADER = (
    b"\xff\xd8"
    + _segment(0xC3, struct.pack(">BHHB", 8, HEIGHT, WIDTH, 1) + bytes([1, 0x11, 0]))
    + _segment(0xC4, b"\x00" + FIXED_TABLE)
    + _segment(0xDA, bytes([1, 1, 0x00, 1, 0, 0]))
)
_SCAN_BYTES = SAMPLES * 9 // 8


def encode_frames(payload: bytes) -> list[bytes]:
    """Lossless JPEG images of the payload's samples, 192 a frame."""
    x = np.frombuffer(payload, np.uint8).reshape(-1, HEIGHT, WIDTH).astype(np.int16)
    d = np.empty_like(x)
    d[:, :, 1:] = x[:, :, 1:] - x[:, :, :-1]
    d[:, 1:, 0] = x[:, 1:, 0] - x[:, :-1, 0]
    d[:, 0, 0] = x[:, 0, 0] - 128
    scan = _pack(_ENCODE[(d + 255).reshape(-1)]).tobytes()
    return [_HEADER + scan[i : i + _SCAN_BYTES].replace(b"\xff", b"\xff\x00") + b"\xff\xd9" for i in range(0, len(scan), _SCAN_BYTES)]


def _decode_own(scans: list[bytes]) -> np.ndarray:
    """Frames whose scans hold 9 bits a sample."""
    d = _DECODE[_unpack(np.frombuffer(b"".join(scans), np.uint8))]
    if (d == 1000).any():
        raise ValueError("damaged scan")
    d = d.reshape(-1, HEIGHT, WIDTH)
    d[:, :, 0] = np.cumsum(d[:, :, 0], axis=1, dtype=np.int16) + 128
    return np.cumsum(d, axis=2, dtype=np.int16).astype(np.uint8)


class _Bits:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> int:
        value = 0
        for _ in range(n):
            byte = self.at >> 3
            if byte >= len(self.data):
                raise ValueError("scan ends early")
            value = value << 1 | (self.data[byte] >> (7 - (self.at & 7)) & 1)
            self.at += 1
        return value

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.take(1)
            if (length, code) in codes:
                return codes[length, code]
        raise ValueError("no such code")

    def difference(self, size: int) -> int:
        if not size:
            return 0
        if size == 16:
            return 32768
        v = self.take(size)
        return v if v >> (size - 1) else v - (1 << size) + 1


def _zigzag() -> list[int]:
    return [8 * y + x for _, _, y, x in sorted((x + y, y if (x + y) % 2 else x, y, x) for x in range(8) for y in range(8))]


_K = np.arange(8)
_DCT = np.where(_K[:, None] == 0, np.sqrt(1 / 8), 0.5 * np.cos((2 * _K[None, :] + 1) * _K[:, None] * np.pi / 16))


def decode_jpeg(image: bytes) -> np.ndarray:
    """The samples (height x width) of a one-component baseline or lossless image."""
    if image[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG image")
    tables, quant, at, restart, frame = {}, {}, 2, 0, None
    while True:
        if at + 4 > len(image) or image[at] != 0xFF:
            raise ValueError("damaged JPEG image")
        marker, length = image[at + 1], struct.unpack_from(">H", image, at + 2)[0]
        data, at = image[at + 4 : at + 2 + length], at + 2 + length
        if marker == 0xC4:
            while data:
                n = sum(data[1:17])
                tables[data[0]] = _codes(data[1:17], data[17 : 17 + n])
                data = data[17 + n :]
        elif marker == 0xDB:
            while data:
                wide = data[0] >> 4
                quant[data[0] & 15] = np.array(struct.unpack(">64H", data[1:129]) if wide else list(data[1:65]))
                data = data[129 if wide else 65 :]
        elif marker == 0xDD:
            restart = struct.unpack(">H", data)[0]
        elif marker in (0xC0, 0xC1, 0xC3):
            precision, height, width, parts = struct.unpack_from(">BHHB", data)
            if parts != 1 or precision != 8:
                raise ValueError("images of one 8-bit component only")
            frame = (marker, height, width, data[8])
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError(f"coding process {marker:#x} isn't supported")
        elif marker == 0xDA:
            break
    if frame is None:
        raise ValueError("no frame header")
    table, (predictor, _, transform) = data[2], data[3:6]
    end = image.rfind(b"\xff\xd9")
    raw = image[at : end if end > 0 else len(image)]
    runs, start = [], 0  # of data between restart markers
    while (i := raw.find(b"\xff", start)) >= 0 and i + 1 < len(raw):
        if 0xD0 <= raw[i + 1] <= 0xD7:
            runs.append(raw[:i].replace(b"\xff\x00", b"\xff"))
            raw, start = raw[i + 2 :], 0
        else:
            start = i + 2
    runs.append(raw.replace(b"\xff\x00", b"\xff"))
    marker, height, width, q = frame
    if marker == 0xC3:
        return _lossless(runs, tables[table >> 4], height, width, predictor, transform & 15, restart)
    return _baseline(runs, tables[table >> 4], tables[16 | table & 15], quant[q], height, width, restart)


def _lossless(runs: list[bytes], codes: dict, height: int, width: int, predictor: int, shift: int, restart: int) -> np.ndarray:
    out, bits, run = np.zeros((height, width), np.int64), _Bits(runs[0]), 0
    first_row = 0
    for y in range(height):
        if restart and y and y * width % restart == 0:
            run, first_row = run + 1, y
            bits = _Bits(runs[run])
        for x in range(width):
            a, b, c = (int(out[y, x - 1]) if x else 0), (int(out[y - 1, x]) if y else 0), (int(out[y - 1, x - 1]) if x and y else 0)
            if y == first_row:
                p = a if x else 1 << (7 - shift)
            elif not x:
                p = b
            else:
                p = (0, a, b, c, a + b - c, a + (b - c >> 1), b + (a - c >> 1), a + b >> 1)[predictor]
            out[y, x] = (p + bits.difference(bits.symbol(codes))) & 0xFFFF
    return (out << shift).astype(np.uint8)


def _baseline(runs: list[bytes], dc: dict, ac: dict, quant: np.ndarray, height: int, width: int, restart: int) -> np.ndarray:
    rows, columns, order = -(-height // 8), -(-width // 8), _zigzag()
    out, bits, last, run = np.zeros((rows * 8, columns * 8)), _Bits(runs[0]), 0, 0
    for i in range(rows * columns):
        if restart and i and i % restart == 0:
            run, last = run + 1, 0
            bits = _Bits(runs[run])
        block = np.zeros(64)
        last += bits.difference(bits.symbol(dc))
        block[0], k = last * quant[0], 1
        while k < 64:
            skip, size = divmod(bits.symbol(ac), 16)
            if not size:
                if skip < 15:
                    break
                k += 16
                continue
            k += skip
            block[order[k]] = bits.difference(size) * quant[k]
            k += 1
        y, x = divmod(i, columns)
        out[8 * y : 8 * y + 8, 8 * x : 8 * x + 8] = _DCT.T @ block.reshape(8, 8) @ _DCT
    return np.clip(np.rint(out[:height, :width] + 128), 0, 255).astype(np.uint8)


# --- AVI --------------------------------------------------------------------------------------------------------


def _chunk(name: bytes, data: bytes) -> bytes:
    return name + struct.pack("<I", len(data)) + data + b"\x00" * (len(data) & 1)


def write_avi(frames: list[bytes], width: int = WIDTH, height: int = HEIGHT, rate: int = FRAMES_PER_SECOND) -> bytes:
    most = max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // rate, most * rate, 0, 0x10, len(frames), 0, 1, most, width, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIhhhh", 0, 0, 0, 0, 1, rate, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 8, b"MJPG", width * height, 0, 0, 0, 0)
    hdrl = b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf))
    movi = b"movi" + b"".join(_chunk(b"00dc", f) for f in frames)
    size = np.fromiter(map(len, frames), np.uint32, len(frames))
    index = np.zeros((len(frames), 4), "<u4")
    index[:, 0], index[:, 1], index[:, 3] = int.from_bytes(b"00dc", "little"), 0x10, size
    padded = size.astype(np.int64) + (size & 1) + 8
    index[:, 2] = np.cumsum(padded) - padded + 4
    body = b"AVI " + _chunk(b"LIST", hdrl) + _chunk(b"LIST", movi) + _chunk(b"idx1", index.tobytes())
    return b"RIFF" + struct.pack("<I", len(body)) + body


def _chunks(data: bytes, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Name, start and end of the data of each chunk."""
    while start + 8 <= end:
        size = struct.unpack_from("<I", data, start + 4)[0]
        if start + 8 + size > end:
            raise ValueError("a chunk passes its list's end")
        yield data[start : start + 4], start + 8, start + 8 + size
        start += 8 + size + (size & 1)


def frame_spans(data: bytes) -> tuple[int, np.ndarray]:
    """Microseconds a frame, and start and end of every video frame, by the index (by the list where there is none)."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    movi, index, micros = None, None, 1_000_000 // FRAMES_PER_SECOND
    for name, a, b in _chunks(data, 12, min(len(data), 8 + struct.unpack_from("<I", data, 4)[0])):
        if name == b"LIST" and data[a : a + 4] == b"movi":
            movi = (a, b)
        elif name == b"LIST" and data[a : a + 4] == b"hdrl":
            for inner, c, _ in _chunks(data, a + 4, b):
                if inner == b"avih":
                    micros = struct.unpack_from("<I", data, c)[0]
        elif name == b"idx1":
            index = np.frombuffer(data[a : a + (b - a) // 16 * 16], "<u4").reshape(-1, 4)
    if movi is None:
        raise ValueError("no list of frames")
    if index is None:
        return micros, np.array([(a, b) for name, a, b in _chunks(data, movi[0] + 4, movi[1]) if name[2:] in (b"dc", b"db")], np.int64).reshape(-1, 2)
    kinds = index[:, 0] >> 16
    index = index[(kinds == int.from_bytes(b"dc", "little")) | (kinds == int.from_bytes(b"db", "little"))]
    start = index[:, 2].astype(np.int64)
    if len(start):  # offsets count from the list's name or from the file's start
        start += 8 + (movi[0] if start[0] < movi[0] else 0)
    spans = np.stack((start, start + index[:, 3]), axis=1)
    if len(spans) and (spans.min() < 0 or spans.max() > len(data)):
        raise ValueError("the index passes the file's end")
    return micros, spans


def read_avi(data: bytes) -> tuple[int, np.ndarray | list[np.ndarray]]:
    """Microseconds a frame, and the frames' samples: one array if all have one size."""
    micros, spans = frame_spans(data)
    head, frames = len(_HEADER), []
    scans = []
    for a, b in spans.tolist():
        if data[a : a + head] != _HEADER or data[b - 2 : b] != b"\xff\xd9":
            break
        scans.append(data[a + head : b - 2].replace(b"\xff\x00", b"\xff"))
    if len(scans) == len(spans):
        if any(len(s) != _SCAN_BYTES for s in scans):
            raise ValueError("damaged scan")
        return micros, _decode_own(scans) if scans else np.zeros((0, HEIGHT, WIDTH), np.uint8)
    frames = [decode_jpeg(data[a:b]) for a, b in spans.tolist()]
    return micros, np.stack(frames) if len({f.shape for f in frames}) == 1 else frames


# --- shots ------------------------------------------------------------------------------------------------------


def histograms(frames: np.ndarray | list[np.ndarray]) -> np.ndarray:
    """Each frame's share of samples in each bin."""
    if isinstance(frames, list):
        return np.stack([np.bincount(f.reshape(-1) >> 4, minlength=BINS) / f.size for f in frames])
    flat = (frames.reshape(len(frames), -1) >> 4).astype(np.int64)
    flat += np.arange(len(frames))[:, None] * BINS
    return np.bincount(flat.reshape(-1), minlength=len(frames) * BINS).reshape(-1, BINS) / max(flat.shape[1] if len(frames) else 1, 1)


def cuts(histogram: np.ndarray) -> np.ndarray:
    """Frames that begin a shot, the first included: the distance to the frame before passes the mean of the distances around by some deviations."""
    if len(histogram) < 2:
        return np.zeros(min(len(histogram), 1), np.int64)
    d = np.abs(np.diff(histogram, axis=0)).sum(axis=1)
    at = np.arange(len(d))
    low, high = np.maximum(at - AROUND, 0), np.minimum(at + AROUND + 1, len(d))
    sums, squares = np.concatenate(([0], np.cumsum(d))), np.concatenate(([0], np.cumsum(d * d)))
    n = np.maximum(high - low - 1, 1)  # the distance itself is left out
    mean = (sums[high] - sums[low] - d) / n
    deviation = np.sqrt(np.maximum((squares[high] - squares[low] - d * d) / n - mean * mean, 0))
    return np.concatenate(([0], np.flatnonzero(d > np.maximum(mean + DEVIATIONS * deviation, LEAST_DISTANCE)) + 1))


def shots(frames: np.ndarray | list[np.ndarray], micros: int) -> list[dict]:
    """Timed clips that follow each other without a gap."""
    if not len(frames):
        return []
    starts = cuts(histograms(frames)).tolist()
    light = frames.reshape(len(frames), -1).mean(axis=1) if isinstance(frames, np.ndarray) else np.array([f.mean() for f in frames])
    out = []
    for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(frames)], strict=True)):
        out.append({"clip": k, "start_ms": a * micros // 1000, "end_ms": b * micros // 1000, "frames": b - a, "mean": round(float(light[a:b].mean()), 3)})
    return out


CLIP = "clip int, start_ms bigint, end_ms bigint, frames int, mean double"


def _beside(files: DataFrame, column: str, own: tuple[str, ...]) -> tuple[DataFrame, str, list[Column]]:
    """row (a struct of the other columns that haven't the name of a result) and text (the files), the row's type, and its columns."""
    names = [x for x in files.columns if x != column and x.lower() not in own]
    row = F.struct(*[F.col(f"`{x}`") for x in names]) if names else F.struct(F.lit(0).alias("none"))
    kept = files.select(row.alias("row"), F.col(f"`{column}`").alias("text"))
    return kept, kept.schema["row"].dataType.simpleString(), [F.col(f"row.`{x}`").alias(x) for x in names]


def clips(files: DataFrame, column: str = "media") -> DataFrame:
    """One row for each clip of each AVI file in a binary column, beside the other columns; null files give no row. Other columns with the names of results are dropped."""
    own = ("clip", "start_ms", "end_ms", "frames", "mean")
    kept, kind, rest = _beside(files.where(F.col(f"`{column}`").isNotNull()), column, own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, row = [], []
            for i, data in enumerate(batch.column("text").to_pylist()):
                micros, frames = read_avi(data)
                parts = shots(frames, micros)
                found += parts
                row += [i] * len(parts)
            clip = [pa.array([c[k] for c in found], t) for k, t in zip(own, (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.float64()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(row, pa.int64())), *clip], ["row", *own])

    return map_pieces(kept, run, f"row {kind}, {CLIP}").select(*rest, *own)


# --- payloads ---------------------------------------------------------------------------------------------------


def payload_of(text: bytes) -> bytes:
    return text.ljust(max(1, -(-len(text) // SAMPLES)) * SAMPLES, b" ")


def encode(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` but text, n_bytes, and media, an AVI file that holds the text."""
    kept = docs.select(*[F.col(f"`{x}`") for x in docs.columns if x.lower() not in ("text", "media", "n_bytes")], utf8())
    rest = [f for f in kept.schema if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column("text").to_pylist()]
            files = [write_avi(encode_frames(payload_of(t))) for t in texts]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in rest), pa.array(map(len, texts), pa.int64()), pa.array(files, pa.binary())], [*(f.name for f in rest), "n_bytes", "media"])

    return map_pieces(kept, run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), "n_bytes bigint, media binary"]))


def digest(data: bytes | None) -> dict:
    """What the stored file says once it is read back; nothing (nulls) where there is no file. Frames may differ in size."""
    if data is None:
        return dict.fromkeys(k for k, *_ in DIGEST)
    micros, frames = read_avi(data)
    payload = b"".join(f.tobytes() for f in frames)
    found = shots(frames, micros)
    return {
        "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-16:]),
        "media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest(),
        "feature": f"frames={len(frames)};shots={len(found)};" + ",".join(f"{c['start_ms']}-{c['end_ms']}:{c['mean']}" for c in found),
    }


DIGEST = (("payload_bytes", "bigint", pa.int64()), ("payload_sha256", "string", pa.string()), ("tail_crc32", "bigint", pa.int64()), ("media_bytes", "bigint", pa.int64()), ("media_sha256", "string", pa.string()), ("feature", "string", pa.string()))


def digests(files: DataFrame) -> DataFrame:
    """The columns of ``files`` but media, and the digest of each file, nulls for a null one. Other columns with the names of results are dropped."""
    own = tuple(k for k, *_ in DIGEST)
    kept, kind, rest = _beside(files, "media", own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [digest(x) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *(pa.array([d[k] for d in found], t) for k, _, t in DIGEST)], ["row", *own])

    return map_pieces(kept, run, f"row {kind}, {', '.join(f'{k} {t}' for k, t, _ in DIGEST)}").select(*rest, *own)


def store_and_read(docs: DataFrame) -> DataFrame:
    """Every text stored as an AVI file, read back and described."""
    return digests(encode(docs.select("doc_id", "text")))
