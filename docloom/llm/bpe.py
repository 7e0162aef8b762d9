"""Byte-level BPE encoding and decoding against a public vocabulary.

Texts are encoded a few MB at a time: their characters' kinds tell where PATTERN cuts, equal pieces are
brought together by their bytes, and the distinct ones are merged side by side in numpy: each round merges in
every piece the leftmost pair of the lowest rank, until no piece has a pair that is a token. No
piece is remembered between batches, so the time doesn't grow with the number of different pieces in a table.
A long text is taken in stretches, cut before spaces, where a piece begins whatever follows.

Pieces of more than 64 bytes are encoded one by one. Bytes are mapped to the characters of Latin-1, so that a
pyahocorasick trie over the vocabulary gives the longest token at any place. A piece is encoded from left to
right with longest matches; a token is accepted if it is compatible with the one before (merging by rank would
leave the boundary between them), else the next shorter one is tried, and when none is left the encoder steps
back. Places that have failed are remembered, so each is left once at most and the time is linear in the piece.
Compatibility of two adjacent tokens is memoised. The result equals that of merging the lowest rank first.

Defined results: a null text gives null tokens, an empty text an empty list. Strings that name special
tokens are ordinary text. Decoding bytes that are no UTF-8 (a list cut within a character) gives U+FFFD for
them; a list with a null or with a number that is no token gives a null text. Ids that are no whole numbers
are null in the result.

Whether two adjacent tokens are compatible is told as in the public linear-time encoders: split both back
along the merges that made them and see whether an earlier merge would cross the boundary.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from docloom.llm import textvec as tv
from docloom.llm.shared import ids_and_texts, small_batches, whole_id

#: How the vocabulary's texts were cut into pieces before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pairs of tokens of long pieces that are remembered.
MEMO = 240_000
#: Bytes of the pieces that are merged side by side, in blocks of so many; longer pieces are encoded one by one.
WIDTHS, BLOCK = (8, 16, 32, 64), 1 << 14
#: Bytes of text that are encoded at once.
STRETCH = 2 << 20
OUT = "doc_id long, tokens array<int>, n_tokens long, round_trip boolean"
_NONE = np.int32(2**31 - 1)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_known: dict[str, Coder] = {}


def _kinds() -> np.ndarray:
    """What each character is to PATTERN: 1 a letter, 2 a number, 3 white space, 0 anything else."""
    every, out = "".join(map(chr, range(0x110000))), np.zeros(0x110000, np.uint8)
    for k, kind in enumerate((r"\p{L}+", r"\p{N}+", r"\s+"), 1):
        for m in regex.finditer(kind, every):
            out[m.start() : m.end()] = k
    return out


def begins(chars: np.ndarray, kind: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Whether each character begins a piece of PATTERN; heads: the places where texts begin."""
    out = np.ones(len(chars), bool)
    np.not_equal(kind[1:], kind[:-1], out=out[1:])
    out[heads] = True
    first = np.zeros(len(chars), bool)
    first[heads] = True
    runs = np.flatnonzero(out)
    size = np.diff(runs, append=len(chars))
    kinds, joined = kind[runs], ~first[runs]  # joined: the run before is of the same text
    after = runs[1:][joined[1:] & (kinds[:-1] == 3)]
    out[after - 1] = True  # of white space before a word the last character stands apart,
    out[after[chars[after - 1] == 32]] = False  # and a space goes with the word
    at = np.flatnonzero((chars[runs[:-1]] == 39) & (size[:-1] == 1) & out[runs[:-1]] & joined[1:] & (kinds[1:] == 1))
    word, length = runs[at + 1], size[at + 1]
    one, two = chars[word], chars[np.minimum(word + 1, len(chars) - 1)]
    short = np.isin(one, (115, 100, 109, 116))  # 's 'd 'm 't, then 'll 've 're
    both = ~short & (length > 1) & (((one == 108) & (two == 108)) | (((one == 118) | (one == 114)) & (two == 101)))
    out[word[short | both]] = False
    cut = np.where(both, 2, 1)
    rest = (short | both) & (length > cut)
    out[word[rest] + cut[rest]] = True
    return out


def _spread(first: np.ndarray, number: np.ndarray) -> np.ndarray:
    """first, first + 1 and so on, as many as the number says, of each."""
    ends = np.cumsum(number)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - number), number)


class Coder:
    """A vocabulary of (base64 token, rank) lines with the tables that encoding needs."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            ranks = sorted((int(b), base64.b64decode(a)) for a, b in map(bytes.split, f))
        self.bytes = {r: t for r, t in ranks}
        self.rank = {t.decode("latin-1"): r for r, t in ranks}
        self.trie = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for text, r in self.rank.items():
            self.trie.add_word(text, r)
        self.size = {r: len(t) for r, t in ranks}
        self.widest = max(self.size.values(), default=0)
        self.shorter: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.compatible: dict[tuple[int, int], bool] = {}
        for r, t in ranks:
            text = t.decode("latin-1")
            for n in range(len(text) - 1, 0, -1):
                if (p := self.rank.get(text[:n])) is not None:
                    self.shorter[r] = p
                    break
        for r, t in ranks:  # by rank: the two parts of a token are older than it
            text, left = t.decode("latin-1"), self.shorter.get(r)
            self.parts[r] = (r, r)
            while left is not None:
                right = self.rank.get(text[self.size[left] :])
                if right is not None and left < r and right < r and self._check(left, right):
                    self.merged[left, right] = r
                    self.parts[r] = (left, right)
                    break
                left = self.shorter.get(left)
        self.compatible.clear()
        self.kind = _kinds()
        self._tables([t for _, t in ranks])

    def _tables(self, tokens: list[bytes]) -> None:
        """What merging side by side needs; tokens are their places in the order of rank there, and len(tokens) is none."""
        place, n = {t: i for i, t in enumerate(tokens)}, len(tokens)
        if n >= 1 << 24:
            raise ValueError("a vocabulary of 2^24 tokens or more")
        self.ids, self.none = np.array(list(self.bytes), np.int32), n
        self.dense = n > 0 and self.ids[-1] == n - 1 and self.ids[0] == 0
        self.ends = np.cumsum([0, *map(len, tokens)])
        self.all_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.byte = np.array([place.get(bytes([b]), n) for b in range(256)], np.int32)
        pairs = {
            place[t[:k]] * (n + 1) + place[t[k:]]: i for i, t in enumerate(tokens) for k in range(1, len(t)) if t[:k] in place and t[k:] in place
        }
        keys, made = np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int32)
        bits = max(4, (8 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.pair_keys, self.pair_made = np.full(1 << bits, -1, np.int64), np.full(1 << bits, _NONE, np.int32)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):  # whoever finds a slot empty and is the last to write its key there has it
            free = left[self.pair_keys[slot[left]] == -1]
            self.pair_keys[slot[free]] = keys[free]
            left = left[self.pair_keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & self.mask
        self.pair_made[slot] = made

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * _FACTOR) >> self.shift).astype(np.int64)

    def made(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The token that each pair makes, or _NONE."""
        keys = a.astype(np.int64) * (self.none + 1) + b
        slot = self._slot(keys)
        found = self.pair_keys[slot]
        out = np.where(found == keys, self.pair_made[slot], _NONE)
        left = np.flatnonzero((found != keys) & (found != -1))
        while len(left):
            slot[left] = (slot[left] + 1) & self.mask
            found = self.pair_keys[slot[left]]
            hit = found == keys[left]
            out[left[hit]] = self.pair_made[slot[left[hit]]]
            left = left[~hit & (found != -1)]
        return out

    def _check(self, a: int, b: int) -> bool:
        """Whether no merge before the last ones of a and b would cross the boundary between them."""
        limit = 1 << 60
        while True:
            if self.merged.get((a, b), limit) < limit:
                return False
            if a > b:
                limit, a = a, self.parts[a][1]
                if a == limit:
                    limit, b = b + 1, self.parts[b][0]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, self.parts[b][0]
                if b + 1 == limit:
                    limit, a = a, self.parts[a][1]
                    if a == limit:
                        return True

    def fits(self, a: int, b: int) -> bool:
        found = self.compatible.get((a, b))
        if found is None:
            if len(self.compatible) >= MEMO:
                self.compatible.clear()
            found = self.compatible[a, b] = self._check(a, b)
        return found

    def _longest(self, text: str, at: int) -> int:
        part = text[at : at + self.widest]
        n = self.trie.longest_prefix(part)
        while n:  # a prefix in the trie need not be a token itself
            r = self.rank.get(part[:n])
            if r is not None:
                return r
            n -= 1
        raise ValueError("a byte of the text is not in the vocabulary")

    def merge(self, raw: bytes) -> list[int]:
        """Tokens of one piece."""
        text = raw.decode("latin-1")
        whole = self.rank.get(text)
        if whole is not None and (len(text) == 1 or self.parts[whole][0] != whole):
            return [whole]
        out: list[int] = []
        dead = bytearray(len(text) + 1)
        at, end = 0, len(text)
        token = self._longest(text, 0) if end else None
        while token is not None:
            last = out[-1] if out else None
            while True:
                stop = at + self.size[token]
                if not dead[stop] and (last is None or self.fits(last, token)):
                    out.append(token)
                    at = stop
                    token = self._longest(text, at) if at < end else None
                    break
                less = self.shorter.get(token)
                if less is None:  # nothing fits here: step back and try less there
                    dead[at] = 1
                    token = out.pop()
                    at -= self.size[token]
                    break
                token = less
        return out

    def _side_by_side(self, raw: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, number of each piece's) of pieces of these sizes in the rows of `raw`."""
        n, width = raw.shape
        rows = np.arange(width + 2, dtype=np.int32)[:, None]  # one for each place in a piece, and one at either end
        token = np.full((width + 2, n), self.none, np.int32)
        token[1:-1] = np.where(rows[1:-1] <= size, self.byte[raw.T], self.none)
        if np.count_nonzero(token != self.none) != size.sum():
            raise ValueError("a byte of the text is not in the vocabulary")
        pair = np.full((width + 2, n), _NONE, np.int32)  # the token that a place makes with the next one, and the place
        some = np.nonzero(token[2:-1] != self.none)
        pair[1:-2][some] = self._keyed(token[1:-2][some], token[2:-1][some], some[0].astype(np.int32) + 1)
        after, before = np.repeat(np.minimum(rows + 1, width + 1), n), np.repeat(np.maximum(rows - 1, 0), n)
        tokens, pairs = token.ravel(), pair.ravel()
        while True:
            least = pair.min(0)
            cols = np.flatnonzero(least != _NONE)
            if not len(cols):
                break
            least = least[cols]
            place, new = least & 127, least >> 7
            at = place * n + cols
            gone = after[at] * n + cols
            left, right = before[at], after[gone]
            at_left, at_right = left * n + cols, right * n + cols
            tokens[at], tokens[gone], pairs[gone] = new, self.none, _NONE
            after[at], before[at_right] = right, place
            both = self._keyed(np.concatenate((tokens[at_left], new)), np.concatenate((new, tokens[at_right])), np.concatenate((left, place)))
            pairs[at_left], pairs[at] = both[: len(cols)], both[len(cols) :]
        kept = token[1:-1].T != self.none
        return token[1:-1].T[kept], kept.sum(1)

    def _keyed(self, a: np.ndarray, b: np.ndarray, place: np.ndarray) -> np.ndarray:
        made = self.made(a, b)
        return np.where(made == _NONE, _NONE, made << 7 | place)

    def _distinct(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(tokens, number of each distinct piece's, distinct piece of each piece)."""
        which, tokens, numbers, n = np.zeros(len(start), np.int64), [], [], 0
        at_byte = np.ndarray(len(data) + WIDTHS[-1] - 7, "<u8", np.append(data, np.zeros(WIDTHS[-1], np.uint8)), strides=(1,))
        for low, width in zip((0, *WIDTHS), WIDTHS, strict=False):
            some = np.flatnonzero((size > low) & (size <= width))
            if not len(some):
                continue
            begin, length = start[some], size[some]
            words = [at_byte[begin + k] & _MASKS[np.clip(length - k, 0, 8)] for k in range(0, width, 8)]
            key = length.astype(np.uint64)
            for word in words:
                key = (key ^ word) * _FACTOR
                key ^= key >> np.uint64(31)
            mask = np.uint64((1 << len(some).bit_length()) - 1)
            order = (np.sort(key & ~mask | np.arange(len(some), dtype=np.uint64)) & mask).astype(np.int64)
            new = np.ones(len(some), bool)  # different pieces of one key in turns only make more of them
            new[1:] = np.any([x[order[1:]] != x[order[:-1]] for x in (length, *words)], axis=0)
            which[some[order]] = n + np.cumsum(new) - 1
            first = order[new]
            raw = np.stack([word[first] for word in words], 1).view(np.uint8)
            step = BLOCK * WIDTHS[0] // width
            for i in range(0, len(first), step):
                found, number = self._side_by_side(raw[i : i + step], length[first[i : i + step]])
                tokens.append(self.ids[found])
                numbers.append(number)
            n += len(first)
        met: dict[bytes, int] = {}
        for i in np.flatnonzero(size > WIDTHS[-1]).tolist():
            piece = data[start[i] : start[i] + size[i]].tobytes()
            if piece not in met:
                met[piece] = n + len(met)
                tokens.append(np.array(self.merge(piece), np.int32))
                numbers.append(tokens[-1].shape)
            which[i] = met[piece]
        return np.concatenate(tokens), np.concatenate(numbers), which

    def _stretch(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        chars = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        heads = offsets[:-1][offsets[:-1] < len(data)]
        at = np.flatnonzero((data & 0xC0) != 0x80) if len(chars) != len(data) else None
        start = np.flatnonzero(begins(chars, self.kind[chars], heads if at is None else np.searchsorted(at, heads)))
        start = start if at is None else at[start]
        tokens, numbers, which = self._distinct(data, start, np.diff(start, append=len(data)))
        out = tokens[_spread((np.cumsum(numbers) - numbers)[which], numbers[which])]
        return out, np.diff(tv.spans(numbers[which])[np.searchsorted(start, offsets)])

    def encode_all(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, number of each text's) of the texts in UTF-8 between these offsets, which begin at 0."""
        edges = np.unique(offsets)
        if len(data) > STRETCH:
            safe = np.flatnonzero((data[1:] == 32) & (data[:-1] > 32) & (data[:-1] < 127)) + 1
            edges = np.union1d(edges, safe[np.searchsorted(safe[:-1], np.arange(STRETCH, len(data), STRETCH))] if len(safe) else safe)
        found = [self._stretch(data[edges[i] : edges[j]], edges[i : j + 1] - edges[i]) for i, j in tv.pieces(edges, STRETCH)]
        if not found:
            return np.zeros(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
        total = tv.spans(np.concatenate([number for _, number in found]))
        return np.concatenate([tokens for tokens, _ in found]), np.diff(total[np.searchsorted(edges, offsets)])

    def encode(self, text: str) -> list[int]:
        data = np.frombuffer(text.encode(), np.uint8)
        return self.encode_all(data, np.array([0, len(data)]))[0].tolist()

    def same(self, tokens: np.ndarray, numbers: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Whether decoding each text's tokens gives its bytes."""
        place = tokens if self.dense else np.searchsorted(self.ids, tokens)
        size, spans = np.diff(self.ends)[place], np.diff(offsets)
        fine = np.diff(tv.spans(size)[tv.spans(numbers)]) == spans
        if not fine.all():
            kept = np.repeat(fine, numbers)
            place, size, data = place[kept], size[kept], data[np.repeat(fine, spans)]
        wrong = tv.spans(self.all_bytes[_spread(self.ends[place], size)] != data)
        fine[fine] = np.diff(wrong[tv.spans(spans[fine])]) == 0
        return fine

    def raw(self, tokens) -> bytes:
        return b"".join(map(self.bytes.__getitem__, tokens))

    def decode(self, tokens) -> str | None:
        """The text, U+FFFD for what is no UTF-8; None for a number that is no token."""
        try:
            return self.raw(tokens).decode(errors="replace")
        except KeyError:
            return None


def coder(path: str) -> Coder:
    """The vocabulary of this file, read once in each worker."""
    if path not in _known:
        _known[path] = Coder(path)
    return _known[path]


def _rows(path: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for batch in tv.parts(batches, limit=STRETCH):
            texts = batch.column("text")
            data, offsets = tv.flat(texts)
            flat, numbers = c.encode_all(data, offsets)
            null = texts.is_null()
            none = null.to_numpy(zero_copy_only=False)
            tokens = pa.ListArray.from_arrays(pa.array(tv.spans(numbers), pa.int32()), pa.array(flat, pa.int32()), mask=null)
            same = pa.array(c.same(flat, numbers, data, offsets), mask=none)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), tokens, pa.array(numbers, pa.int64(), mask=none), same], ["doc_id", "tokens", "n_tokens", "round_trip"])

    return rows


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, tokens, n_tokens, round_trip) of every row; round_trip tells whether decoding gives the text again."""
    small_batches(docs.sparkSession)
    return ids_and_texts(docs).mapInArrow(_rows(path), OUT)


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of rows with a doc_id and tokens; null tokens give a null text."""
    small_batches(tokens.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for batch in batches:
            text = [None if t is None else c.decode(t) for t in batch.column("tokens").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(text, pa.string())], ["doc_id", "text"])

    return tokens.select(whole_id(tokens, "doc_id").alias("doc_id"), "tokens").mapInArrow(rows, "doc_id long, text string")
