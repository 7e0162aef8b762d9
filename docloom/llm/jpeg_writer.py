"""A small baseline JPEG writer: it makes the media columns of the queries and the files of the tests.

Blocks are given by their quantised coefficients, so that what a reader must find is known exactly.
"""

from __future__ import annotations

import numpy as np

#: The typical Huffman tables of the JPEG standard's annex K: numbers of codes by length, and the symbols.
DC_TABLE = bytes.fromhex("00010501010101010100000000000000") + bytes(range(12))
_AC_SYMBOLS = (
    "0102030004110512213141061351610722711432 8191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a4344454647"
    "48494a535455565758595a636465666768696a737475767778797a838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9ba"
    "c2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa"
)
AC_TABLE = bytes.fromhex("0002010303020403050504040000017d") + bytes.fromhex(_AC_SYMBOLS.replace(" ", ""))


def codes_of(table: bytes) -> dict[int, tuple[int, int]]:
    """Symbol -> (code, length)."""
    found, code, at = {}, 0, 16
    for length in range(1, 17):
        for _ in range(table[length - 1]):
            found[table[at]] = code, length
            code, at = code + 1, at + 1
        code <<= 1
    return found


_DC, _AC = codes_of(DC_TABLE), codes_of(AC_TABLE)


class _Bits:
    def __init__(self) -> None:
        self.value, self.length = 0, 0

    def put(self, value: int, length: int) -> None:
        self.value, self.length = self.value << length | value, self.length + length

    def number(self, v: int, size: int) -> None:
        if size:
            self.put(v if v > 0 else v + (1 << size) - 1, size)

    def end(self) -> bytes:
        pad = -self.length % 8
        raw = ((self.value << pad) | ((1 << pad) - 1)).to_bytes((self.length + pad) // 8, "big")
        return raw.replace(b"\xff", b"\xff\x00")


def _block(bits: _Bits, block: list[int], before: int) -> int:
    """Coefficients in zigzag order, of which trailing zeros may be left out."""
    size = abs(d := block[0] - before).bit_length()
    bits.put(*_DC[size])
    bits.number(d, size)
    run = 0
    for k, v in enumerate(block[1:], 1):
        if not v:
            run += 1
            continue
        while run > 15:
            bits.put(*_AC[0xF0])
            run -= 16
        size = abs(v).bit_length()
        bits.put(*_AC[run << 4 | size])
        bits.number(v, size)
        run = 0
    if run or len(block) < 64:
        bits.put(*_AC[0])
    return block[0]


def _segment(marker: int, body: bytes) -> bytes:
    return bytes((0xFF, marker)) + (len(body) + 2).to_bytes(2, "big") + body


def write(width: int, height: int, planes: list[list[list[int]]], sampling: tuple[tuple[int, int], ...] = ((1, 1),), q0: int = 8, restart: int = 0, comment: bytes = b"", sof: int = 0xC0) -> bytes:
    """A file of these planes, each a list of blocks (of coefficients in zigzag order) by rows over whole MCUs."""
    h, v = max(s[0] for s in sampling), max(s[1] for s in sampling)
    across, down = -(-width // (8 * h)), -(-height // (8 * v))
    out = [b"\xff\xd8", _segment(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0"), _segment(0xFE, comment) if comment else b""]
    out.append(_segment(0xDB, b"\0" + bytes([q0] + [8] * 63)))
    parts = b"".join(bytes((i + 1, s[0] << 4 | s[1], 0)) for i, s in enumerate(sampling))
    out.append(_segment(sof, b"\x08" + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([len(sampling)]) + parts))
    out += [_segment(0xC4, b"\x00" + DC_TABLE + b"\x10" + AC_TABLE), _segment(0xDD, restart.to_bytes(2, "big")) if restart else b""]
    out.append(_segment(0xDA, bytes([len(sampling)]) + b"".join(bytes((i + 1, 0)) for i in range(len(sampling))) + b"\0\x3f\0"))
    bits, before, marks = _Bits(), [0] * len(planes), 0
    chunks: list[bytes] = []
    for mcu in range(across * down):
        if restart and mcu and mcu % restart == 0:
            chunks += [bits.end(), bytes((0xFF, 0xD0 + marks % 8))]
            bits, before, marks = _Bits(), [0] * len(planes), marks + 1
        if bits.length > 4096:  # whole bytes go out, so the number stays small
            keep = bits.length % 8
            chunks.append((bits.value >> keep).to_bytes(bits.length // 8, "big").replace(b"\xff", b"\xff\x00"))
            bits.value, bits.length = bits.value & ((1 << keep) - 1), keep
        y, x = divmod(mcu, across)
        for c, (sh, sv) in enumerate(sampling):
            for j in range(sv):
                for i in range(sh):
                    before[c] = _block(bits, planes[c][(y * sv + j) * across * sh + x * sh + i], before[c])
    return b"".join(out + chunks + [bits.end(), b"\xff\xd9"])


def picture(vector: np.ndarray, colour: bool, restart: int) -> bytes:
    """A vector as a picture: each value is the mean of a block of a square as large as it takes, ramped to the right."""
    n = max(1, int(np.ceil(np.sqrt(len(vector)))))
    side = n + n % 2
    level = np.zeros(n * n)
    level[: len(vector)] = np.clip(np.nan_to_num(vector), -1, 1)
    dc = np.zeros((side, side), np.int64)
    dc[:n, :n] = np.round(level.reshape(n, n) * 120)
    ramp = np.zeros((side, side), np.int64)
    ramp[:, :-1] = (dc[:, :-1] - dc[:, 1:]) // 4
    luma = [[a, b, b // 3] for a, b in zip(dc.ravel().tolist(), ramp.ravel().tolist(), strict=True)]
    if not colour:
        narrow = [b for i, b in enumerate(luma) if i // side < n and i % side < n]
        return write(8 * n - 3, 8 * n - 5, [narrow], restart=restart)
    chroma = [[int(v), 0, 0, 1] for v in dc[::2, ::2].ravel() // 2]
    return write(8 * n - 3, 8 * n - 5, [luma, chroma, chroma], ((2, 2), (1, 1), (1, 1)), restart=restart)
