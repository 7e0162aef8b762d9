"""Media columns from baseline JPEG files: dimensions, and hashes of thumbnails.

Markers are parsed for each file and its scan is Huffman-decoded once, from table to table: an entry for each
16 bits tells how many of them whole AC symbols take and how many coefficients those fill, so that the values
nobody needs are stepped over several at a time. Of the coefficients only the DC ones of the luminance are
kept; numpy dequantises them, each is the mean of a block of 8 x 8 pixels, and together they are the
thumbnail. No inverse transform is needed.

Columns: status, width, height, n_components, thumb_width, thumb_height, thumb (bytes by row),
thumb_digest (SHA-256 of size and bytes, for exact copies) and thumb_hash (64 bits, each telling whether the
thumbnail gets brighter to the right, for near ones).

Defined results, by status: `ok`; `null` for a null; `not_jpeg` for bytes without the start marker, empty
ones too; `unsupported` for other kinds of JPEG (progressive, lossless, arithmetic, 12 bits), with dimensions
and no thumbnail; `corrupt` for broken markers, tables that are missing, codes that don't exist and data that
ends early, with the dimensions if they were read. Repeated rows get the same result each.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.shared import whole_id

OUT = "status string, width int, height int, n_components int, thumb_width int, thumb_height int, thumb binary, thumb_digest string, thumb_hash long"
#: Tables that a worker keeps, and bytes of data from which on a table of several symbols is worth making.
TABLES, LONG_SCAN = 256, 8192
#: Bytes after the data: no block reads further.
_PAD = b"\xff" * 512


@dataclass
class Parsed:
    status: str
    width: int | None = None
    height: int | None = None
    n: int | None = None
    across: int = 0
    down: int = 0
    #: Of the luminance in a scan: blocks of a MCU to the right and down, and MCUs of a row.
    h: int = 1
    v: int = 1
    mcus: int = 0
    mcu_row: int = 0
    q0: int = 1
    restart: int = 0
    #: For each block of an MCU, whether it is luminance, its component, and its DC and AC tables.
    blocks: list[tuple[bool, int, bytes, bytes]] = field(default_factory=list)
    data: bytes = b""


class _Bad(Exception):
    pass


def parse(raw: bytes | None) -> Parsed:
    """Walks the markers up to the scan that holds the luminance."""
    if raw is None:
        return Parsed("null")
    if raw[:2] != b"\xff\xd8":
        return Parsed("not_jpeg")
    found = Parsed("corrupt")
    try:
        _walk(raw, found)
    except (_Bad, IndexError, KeyError, ZeroDivisionError):
        pass
    return found


def _walk(raw: bytes, found: Parsed) -> None:
    at, quant, dc, ac, frame = 2, {}, {}, {}, []
    while True:
        if raw[at] != 0xFF:
            raise _Bad
        while raw[at] == 0xFF:
            at += 1
        kind, at = raw[at], at + 1
        if kind == 0x01 or 0xD0 <= kind <= 0xD7:
            continue
        if kind == 0xD9:
            raise _Bad
        size = raw[at] << 8 | raw[at + 1]
        body = raw[at + 2 : at + size]
        if size < 2 or len(body) != size - 2:
            raise _Bad
        at += size
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            bits, n = body[0], body[5]
            found.height, found.width, found.n = body[1] << 8 | body[2], body[3] << 8 | body[4], n
            if kind not in (0xC0, 0xC1) or bits != 8:
                found.status = "unsupported"
                return
            frame = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            if not found.width or not found.height or not frame or any(not (1 <= h <= 4 and 1 <= v <= 4) for _, h, v, _ in frame):
                raise _Bad
        elif kind == 0xDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                quant[body[k] & 15] = body[k + 1] << 8 | body[k + 2] if wide else body[k + 1]
                k += 129 if wide else 65
        elif kind == 0xC4:
            k = 0
            while k < len(body):
                n = sum(body[k + 1 : k + 17])
                (ac if body[k] >> 4 else dc)[body[k] & 15] = body[k + 1 : k + 17 + n]
                if len(body) < k + 17 + n:
                    raise _Bad
                k += 17 + n
        elif kind == 0xDD:
            found.restart = body[0] << 8 | body[1]
        elif kind == 0xDA:
            end = _scan_end(raw, at)
            tables = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
            if not frame:
                raise _Bad
            if frame[0][0] in tables:
                _scan(found, frame, tables, quant, dc, ac)
                found.data = raw[at:end]
                return
            at = end


def _scan_end(raw: bytes, at: int) -> int:
    while True:
        at = raw.find(b"\xff", at)
        if at < 0 or at + 1 >= len(raw):
            return len(raw)
        if raw[at + 1] and not 0xD0 <= raw[at + 1] <= 0xD7:
            return at
        at += 2


def _scan(found: Parsed, frame: list, tables: dict, quant: dict, dc: dict, ac: dict) -> None:
    most_h, most_v = max(f[1] for f in frame), max(f[2] for f in frame)
    _, h, v, q = frame[0]
    found.across, found.down = (-(-(-(-side * own // most)) // 8) for side, own, most in ((found.width, h, most_h), (found.height, v, most_v)))
    if len(tables) == 1:  # not interleaved: a MCU is one block, and there are only those of the picture
        found.h = found.v = 1
        found.mcu_row, found.mcus = found.across, found.across * found.down
    else:
        found.h, found.v = h, v
        found.mcu_row = -(-found.width // (8 * most_h))
        found.mcus = found.mcu_row * -(-found.height // (8 * most_v))
    found.q0 = quant[q]
    for i, (c, ch, cv, _) in enumerate(frame):
        if c in tables:
            n = 1 if len(tables) == 1 else ch * cv
            found.blocks += [(i == 0, i, dc[tables[c] >> 4], ac[tables[c] & 15])] * n
    found.status = "ok"


def table_of(spec: bytes) -> np.ndarray:
    """For each 16 bits, length << 8 | symbol of the code they start with; 0 where there is none."""
    out, code, at = np.zeros(1 << 16, np.uint16), 0, 16
    for length in range(1, 17):
        for _ in range(spec[length - 1]):
            low = code << (16 - length)
            if low + (1 << (16 - length)) > 1 << 16 or at >= len(spec):
                return out
            out[low : low + (1 << (16 - length))] = length << 8 | spec[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


def intervals(data: bytes) -> list[bytes]:
    """The scan's data cut at restart markers, stuffed zero bytes taken out."""
    out, start, at = [], 0, 0
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            break
        if 0xD0 <= data[at + 1] <= 0xD7:
            out.append(data[start:at])
            start = at + 2
        at += 2
    return [x.replace(b"\xff\x00", b"\xff") for x in [*out, data[start:]]]


class Table:
    """What decoding needs of a Huffman table; for AC symbols bits | coefficients << 6 | end of the block << 14, 0 where no code is."""

    def __init__(self, spec: bytes) -> None:
        self.codes = table_of(spec)
        self.dc, self.one, self._many = array("H", self.codes.tobytes()), self._steps(1), None

    @property
    def many(self) -> array:
        if self._many is None:
            self._many = self._steps(8)
        return self._many

    def _steps(self, most: int) -> array:
        """Entries of up to so many symbols whose codes lie in the 16 bits."""
        window = np.arange(1 << 16, dtype=np.uint32)
        bits, filled, end = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, bool)
        live = np.arange(1 << 16)
        for _ in range(most):
            code = self.codes[(window[live] << bits[live]) & np.uint32(0xFFFF)].astype(np.uint32)
            length, run, size = code >> np.uint32(8), (code >> np.uint32(4)) & np.uint32(15), code & np.uint32(15)
            ok = (code > 0) & (bits[live] + length <= 16) & ((size > 0) | (run == 0) | (run == 15))
            live, length, run, size = live[ok], length[ok], run[ok], size[ok]
            stop = (size == 0) & (run == 0)
            bits[live] += length + size
            filled[live] += np.where(stop, 0, run + 1).astype(np.uint32)
            end[live] = stop
            live = live[~stop & (bits[live] < 16)]
        return array("H", (bits | filled << np.uint32(6) | end.astype(np.uint32) << np.uint32(14)).astype(np.uint16).tobytes())


_tables: dict[bytes, Table] = {}


def _table(spec: bytes) -> Table:
    found = _tables.get(spec)
    if found is None:
        if len(_tables) >= TABLES:
            _tables.clear()
        found = _tables[spec] = Table(spec)
    return found


def luminance(f: Parsed) -> np.ndarray | None:
    """The DC coefficients (down x across) of a file; None if its data is corrupt."""
    if f.mcus * len(f.blocks) > 8 * len(f.data) + 8:  # each block takes two bits at least
        return None
    parts, step = intervals(f.data), f.restart or f.mcus
    if len(parts) != -(-f.mcus // step):
        return None
    long = len(f.data) >= LONG_SCAN
    blocks = []
    for own, _, dc, ac in f.blocks:
        t = _table(ac)
        blocks.append((own, t.many if long else t.one, t.one, _table(dc).dc))
    out: list[int] = []
    for r, part in enumerate(parts):
        if not _decode(part, min(step, f.mcus - r * step), blocks, out):
            return None
    return _grid(f, np.array(out, np.int64))


def _decode(part: bytes, mcus: int, blocks: list[tuple[bool, array, array, array]], out: list[int]) -> bool:
    """Appends the luminance's DC coefficients of one interval; False if it is broken."""
    raw = np.frombuffer(part + _PAD, np.uint8).astype(np.uint32)
    word = memoryview(raw[:-3] << np.uint32(24) | raw[1:-2] << np.uint32(16) | raw[2:-1] << np.uint32(8) | raw[3:])
    p, stop, value = 0, 8 * len(part), 0
    for _ in range(mcus):
        for own, many, one, dc in blocks:
            code = dc[(word[p >> 3] >> (16 - (p & 7))) & 0xFFFF]
            size = code & 255
            if not code or size > 15:
                return False
            p += code >> 8
            if own:
                if size:
                    bits = ((word[p >> 3] >> (16 - (p & 7))) & 0xFFFF) >> (16 - size)
                    value += bits if bits >> (size - 1) else bits - (1 << size) + 1
                out.append(value)
            p += size
            z = 1
            while True:
                code = many[(word[p >> 3] >> (16 - (p & 7))) & 0xFFFF]
                now = z + ((code >> 6) & 255)
                if now > 63:  # the block ends among these symbols: one by one from here
                    while z < 64:
                        code = one[(word[p >> 3] >> (16 - (p & 7))) & 0xFFFF]
                        z += (code >> 6) & 255
                        p += code & 63
                        if code >> 14:
                            break
                        if not code or z > 64:
                            return False
                    break
                if not code:
                    return False
                p += code & 63
                if code >> 14:
                    break
                z = now
            if p > stop:
                return False
    return True


def _grid(f: Parsed, dc: np.ndarray) -> np.ndarray:
    """Coefficients in the order of the scan by rows, without what only fills up MCUs."""
    rows = f.mcus // f.mcu_row
    return dc.reshape(rows, f.mcu_row, f.v, f.h).transpose(0, 2, 1, 3).reshape(rows * f.v, f.mcu_row * f.h)[: f.down, : f.across]


def thumbnail(f: Parsed, dc: np.ndarray) -> np.ndarray:
    """Means of the blocks as bytes."""
    return np.clip(np.floor(dc * f.q0 / 8 + 128.5), 0, 255).astype(np.uint8)


def thumb_hash(thumb: np.ndarray) -> int:
    """64 bits: for 8 rows of 9 samples, whether each is darker than the one to its right."""
    down, across = thumb.shape
    rows = ((np.arange(8) * 2 + 1) * down) // 16
    cols = ((np.arange(9) * 2 + 1) * across) // 18
    small = thumb[rows][:, cols]
    return int.from_bytes(np.packbits(small[:, :-1] < small[:, 1:]).tobytes(), "big", signed=True)


def read(files: list[bytes | None]) -> list[tuple]:
    """The columns of OUT for each file."""
    out: list[tuple] = []
    for raw in files:
        f = parse(raw)
        dc = luminance(f) if f.status == "ok" else None
        if dc is None:
            out.append(("corrupt" if f.status == "ok" else f.status, f.width, f.height, f.n, None, None, None, None, None))
            continue
        thumb = thumbnail(f, dc)
        digest = hashlib.sha256(f"{f.width}x{f.height}:".encode() + thumb.tobytes()).hexdigest()
        out.append(("ok", f.width, f.height, f.n, thumb.shape[1], thumb.shape[0], thumb.tobytes(), digest, thumb_hash(thumb)))
    return out


_NAMES = [x.split()[0] for x in OUT.split(", ")]
_TYPES = [pa.string(), *[pa.int32()] * 5, pa.binary(), pa.string(), pa.int64()]


def media_columns(rows: DataFrame, key: str, image: str) -> DataFrame:
    """(key, columns of OUT) for the files in column `image`, which is binary; one narrow pass."""

    def read_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                cols = zip(*read(part.column("__image").to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([part.column("__key"), *(pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True))], [key, *_NAMES])

    picked = rows.select(whole_id(rows, key).alias("__key"), F.col(image).alias("__image"))
    return picked.mapInArrow(read_rows, f"`{key}` long, {OUT}")
