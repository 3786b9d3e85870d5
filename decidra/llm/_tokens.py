"""Exact encoding of whole columns with the tokenizers library, each distinct piece of text once.

Byte-pair merges never cross the places where a tokenizer's pattern cuts a text. The two kinds of pattern known here are
followed by vector operations over a column's bytes, so a text becomes pieces without a loop over its words. A piece is
looked up by a 64-bit hash in a table of ids, and its bytes are compared with those found there; only pieces that the
process has not met, or whose hash another piece has, go through the library's model.

The pattern is followed for printable ASCII, ASCII white space and Latin letters, where it and the normaliser are plain. A
word with any other character is one piece, which the whole tokenizer encodes, and a text that could hold a special
token's string, or has white space beyond ASCII, is one piece as a whole. Tokenizers of other kinds encode whole texts.

The table is bounded in pieces, bytes and ids, and is started afresh when full, so a worker's memory is bounded too.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from decidra.llm._common import U64, mix64
from decidra.llm._shingles import powers, text_buffers

CHUNK = 1 << 18  # bytes of text at a time
SLOT_BITS = 21
MOST_PIECES, MOST_IDS, MOST_BYTES = 1_200_000, 6_000_000, 16_000_000
LETTER, DIGIT, SIGN, ODD, BLANK, SPACE = 1, 2, 3, 4, 5, 6  # classes of bytes; BLANK is the space itself
#: White space beyond ASCII.
_WIDE_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def _classes() -> np.ndarray:
    table = np.full(256, ODD, np.uint8)
    table[33:127] = SIGN
    table[48:58] = DIGIT
    table[[*range(65, 91), *range(97, 123)]] = LETTER
    table[0x80:0xC0] = LETTER  # the second byte of a letter
    table[0xC3:0xC9] = LETTER  # the first byte of a letter from U+00C0 to U+023F
    table[[9, 10, 11, 12, 13]] = SPACE
    table[32] = BLANK
    return table


def _byte_letters() -> dict[int, str]:
    """Byte-level tokenizers' printable stand-ins: printable Latin-1 stands for itself, the rest follow from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    table, nxt = {}, 256
    for b in range(256):
        table[b] = chr(b) if b in plain else chr(nxt)
        nxt += b not in plain
    return table


_CLASS, _LETTERS = _classes(), _byte_letters()
_BYTE = mix64(np.arange(1, 257, dtype=U64) * U64(0xA0761D6478BD642F))
#: Fixed value: the pattern with which word-level cutting lower-cased texts goes.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def kind_of(path: str) -> str:
    """'spaced': a byte-level pattern that carries a space into the word after it; 'words': WORD_PATTERN on lower case; or 'other'."""
    with open(path, encoding="utf-8") as f:
        config = json.load(f)
    steps = config["pre_tokenizer"] or {}
    steps = steps["pretokenizers"] if steps.get("type") == "Sequence" else [steps]
    normal = config["normalizer"] or {"type": "Sequence", "normalizers": []}
    normal = [x["type"] for x in (normal["normalizers"] if normal["type"] == "Sequence" else [normal])]
    if config["model"]["type"] != "BPE" or steps[-1].get("type") != "ByteLevel" or steps[-1].get("add_prefix_space"):
        return "other"
    if len(steps) == 1 and steps[0].get("use_regex") and not normal:
        return "spaced"
    if len(steps) == 2 and steps[0] | {"type": "Split", "pattern": {"Regex": WORD_PATTERN}, "behavior": "Removed", "invert": True} == steps[0] and not steps[1].get("use_regex") and normal == ["NFC", "Replace", "Lowercase"]:
        return "words"
    return "other"


def _contractions(text: np.ndarray, kinds: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> None:
    """Moves the starts after an apostrophe that begins a piece and goes with the letters behind it ('s, 't, 'm, 'd, 're, 've, 'll)."""
    at = np.flatnonzero((text == 39) & starts)
    at = at[at + 1 < len(text)]
    at = at[(kinds[at + 1] == LETTER) & ~ends[at + 1]]
    if not len(at):
        return
    one = text[at + 1] | np.uint8(0x20 if lower else 0)
    third = np.minimum(at + 2, len(text) - 1)
    two = np.where((at + 2 < len(text)) & ~ends[third], text[third] | np.uint8(0x20 if lower else 0), 0)
    short = np.isin(one, [ord(x) for x in "stmd"])
    longer = ((two == ord("e")) & ((one == ord("r")) | (one == ord("v")))) | ((two == ord("l")) & (one == ord("l")))
    taken = short | longer
    starts[at[taken] + 1] = False
    after = at[taken] + np.where(short[taken], 2, 3)
    starts[after[after < len(text)]] = True


class _Ids:
    """hash of a piece -> its ids: an open-addressed table of rows over pools of ids and of the pieces' bytes."""

    def __init__(self, wide: bool):
        self.wide = wide
        self.clear()

    def clear(self) -> None:
        self.keys, self.rows = np.zeros(1 << SLOT_BITS, U64), np.zeros(1 << SLOT_BITS, np.int32)
        self.start, self.length, self.byte_start, self.byte_length = (np.zeros(1 << 12, np.int32) for _ in range(4))
        self.pool, self.bytes = np.zeros(1 << 14, np.uint32 if self.wide else np.uint16), np.zeros(1 << 14, np.uint8)
        self.n = self.used = self.held = 0

    def full(self, more: int) -> bool:
        return self.n + more > MOST_PIECES or self.used > MOST_IDS or self.held > MOST_BYTES

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The row of each hash, or -1."""
        slot = (hashes >> U64(64 - SLOT_BITS)).astype(np.int64)
        keys = self.keys[slot]
        out = np.where(keys == hashes, self.rows[slot], -1)
        left = np.flatnonzero((keys != hashes) & (keys != 0))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << SLOT_BITS) - 1)
            keys = self.keys[slot[left]]
            hit = keys == hashes[left]
            out[left[hit]] = self.rows[slot[left[hit]]]
            left = left[~hit & (keys != 0)]
        return out

    def others(self, rows: np.ndarray, text: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Numbers of the pieces of text whose bytes aren't those of their row."""
        lengths = stops - starts
        wrong = self.byte_length[rows] != lengths
        lengths = np.where(wrong, 0, lengths)
        before = np.cumsum(lengths) - lengths
        step = np.arange(int(lengths.sum()))
        differ = text[np.repeat(starts - before, lengths) + step] != self.bytes[np.repeat(self.byte_start[rows] - before, lengths) + step]
        if differ.any():
            wrong[np.searchsorted(before + lengths, np.flatnonzero(differ), "right")] = True
        return np.flatnonzero(wrong)

    def append(self, ids: list[list[int]], pieces: list[bytes]) -> np.ndarray:
        """New rows, which no hash leads to."""
        n = self.n + len(ids)
        for start, length, pool, used, flat, sizes in (
            ("start", "length", "pool", "used", np.array([i for x in ids for i in x], self.pool.dtype), [len(x) for x in ids]),
            ("byte_start", "byte_length", "bytes", "held", np.frombuffer(b"".join(pieces), np.uint8), [len(x) for x in pieces]),
        ):
            before, lengths = getattr(self, used), np.array(sizes, np.int32)
            for name, wanted in ((start, n), (length, n), (pool, before + len(flat))):
                held = getattr(self, name)
                if wanted > len(held):
                    setattr(self, name, np.concatenate([held, np.zeros(max(wanted, len(held) * 3 // 2) - len(held), held.dtype)]))
            getattr(self, start)[self.n : n] = before + np.cumsum(lengths) - lengths
            getattr(self, length)[self.n : n] = lengths
            getattr(self, pool)[before : before + len(flat)] = flat
            setattr(self, used, before + len(flat))
        self.n = n
        return np.arange(n - len(ids), n, dtype=np.int32)

    def add(self, hashes: np.ndarray, ids: list[list[int]], pieces: list[bytes]) -> None:
        """Adds distinct new hashes."""
        rows, slot = self.append(ids, pieces), (hashes >> U64(64 - SLOT_BITS)).astype(np.int64)
        while len(hashes):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = hashes[free]  # of several for one slot, one stays
            mine = self.keys[slot] == hashes
            self.rows[slot[mine]] = rows[mine]
            hashes, rows, slot = hashes[~mine], rows[~mine], (slot[~mine] + 1) & ((1 << SLOT_BITS) - 1)


class ColumnEncoder:
    """texts(column) gives the ids of Tokenizer.from_file(path).encode(text, add_special_tokens=False) for each text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.kind = Tokenizer.from_file(path), kind_of(path)
        self.model = self.tokenizer.model
        special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        #: What every special token's string begins with; an empty prefix sends all texts through the library whole.
        self.special = os.path.commonprefix(special).encode() if special else None
        self.wide = self.tokenizer.get_vocab_size() > 65536
        self.ids = _Ids(self.wide)

    def _starts(self, text: np.ndarray, first: np.ndarray, whole: np.ndarray) -> np.ndarray:
        """Where pieces begin. first: where each text begins; whole: which texts are one piece."""
        n = len(text)
        kinds = _CLASS[text]
        for lead, second in ((0xC3, 0x97), (0xC3, 0xB7), (0xC4, 0xB0)):  # signs among the letters, and dotted capital I
            kinds[:-1][(text[:-1] == lead) & (text[1:] == second)] = ODD
        edge = np.zeros(n + 1, bool)
        edge[first] = True
        ends = edge[:n]
        blank = kinds >= BLANK
        after_blank, before = np.empty(n, bool), np.empty(n, np.uint8)
        after_blank[0], after_blank[1:] = True, blank[:-1]
        before[0], before[1:] = 0, kinds[:-1]
        after_blank |= ends
        word = ~blank & after_blank
        starts = ~blank & ~after_blank & (kinds != before)
        starts |= blank & (~after_blank | ends | (before < BLANK))
        if self.kind == "spaced":
            last = blank.copy()
            last[:-1] &= ~blank[1:] & ~ends[1:]
            last[-1] = False
            starts |= last | (word & ((before != BLANK) | ends))
        else:
            starts |= word | (kinds == DIGIT)
        starts |= ends
        _contractions(text, kinds, starts, ends, self.kind == "words")
        odd = np.flatnonzero(kinds == ODD)
        if len(odd):  # a word that holds one is a single piece
            number = np.cumsum(word, dtype=np.int32)
            bad = np.zeros(int(number[-1]) + 1, bool)
            bad[number[odd]] = True
            starts &= ~(bad[number] & ~blank & ~word)
        if whole.any():
            inside = np.repeat(whole, np.diff(np.append(first, n)))
            starts &= ~inside | ends
        return starts

    def _encode(self, piece: bytes, whole: bool) -> list[int]:
        text = piece.decode()
        if whole:
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        if (piece.isalpha() or (piece[:1] == b" " and piece[1:].isalpha())):  # bytes.isalpha() is ASCII only
            raw = text.lower() if self.kind == "words" else text.replace(" ", _LETTERS[32])
            return [t.id for t in self.model.tokenize(raw)]
        kinds = _CLASS[np.frombuffer(piece, np.uint8)]
        if not (kinds == ODD).any() and "×" not in text and "÷" not in text and "İ" not in text:
            if self.kind == "words":
                text = text.lower()
            return [t.id for t in self.model.tokenize(text.encode().decode("latin-1").translate(_LETTERS))]
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _encoded(self, places: np.ndarray, starts: np.ndarray, stops: np.ndarray, first: np.ndarray, whole: np.ndarray, raw: bytes) -> tuple[list[list[int]], list[bytes]]:
        """(ids, bytes) of the pieces with these numbers."""
        entire = whole[np.searchsorted(first, starts[places], "right") - 1].tolist()
        pieces = [raw[a:b] for a, b in zip(starts[places].tolist(), stops[places].tolist(), strict=True)]
        return [self._encode(piece, w) for piece, w in zip(pieces, entire, strict=True)], pieces

    def _chunk(self, text: np.ndarray, first: np.ndarray, raw: bytes, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's end among them) of texts of a byte at least."""
        n = len(text)
        bounds = np.append(first, n)
        whole = np.full(len(first), self.kind == "other")
        if self.kind != "other" and self.special is not None and self.special in raw:
            whole |= [self.special in raw[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        high = np.isin(text, [0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3])  # what white space beyond ASCII begins with
        if self.kind != "other" and high.any():
            for d in np.unique(np.searchsorted(first, np.flatnonzero(high), "right") - 1):
                whole[d] |= _WIDE_SPACE.search(raw[bounds[d] : bounds[d + 1]].decode()) is not None
        starts = np.flatnonzero(self._starts(text, first, whole) if self.kind != "other" else np.isin(np.arange(n), first))
        stops = np.append(starts[1:], n)
        if self.kind == "words":  # white space has no ids
            blank = _CLASS[text[starts]] >= BLANK
            if whole.any():
                blank &= ~whole[np.searchsorted(first, starts, "right") - 1]
            starts, stops = starts[~blank], stops[~blank]
        sums = np.zeros(n + 1, U64)
        np.cumsum(_BYTE[text] * powers("down", n), out=sums[1:])
        hashes = mix64((sums[stops] - sums[starts]) * powers("up", n)[starts] + (stops - starts).astype(U64)) | U64(1)
        rows = self.ids.find(hashes)
        new = np.flatnonzero(rows < 0)
        if len(new):
            fresh, at = np.unique(hashes[new], return_index=True)
            if self.ids.full(len(fresh)):
                self.ids.clear()
                new = np.arange(len(hashes))
                fresh, at = np.unique(hashes, return_index=True)
            self.ids.add(fresh, *self._encoded(new[at], starts, stops, first, whole, raw))
            rows[new] = self.ids.find(hashes[new])
        if len(other := self.ids.others(rows, text, starts, stops)):
            rows[other] = self.ids.append(*self._encoded(other, starts, stops, first, whole, raw))
        lengths, begin = self.ids.length[rows], self.ids.start[rows]
        upto = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        ids = self.ids.pool[np.repeat(begin - upto[:-1], lengths) + np.arange(upto[-1])]
        ends = upto[np.searchsorted(starts, bounds[1:])]
        if end_id is not None:
            ids = np.insert(ids, ends, end_id)
            ends = ends + np.arange(1, len(ends) + 1)
        return ids, ends

    def texts(self, column: pa.Array, end_id: int | None = None) -> Iterator[bytes]:
        """Each text's ids, and end_id behind them if given, as little-endian unsigned 32-bit bytes; null is empty."""
        data, offsets = text_buffers(column)
        nothing = b"" if end_id is None else end_id.to_bytes(4, "little")
        first, n = 0, len(column)
        with np.errstate(over="ignore"):
            while first < n:
                last = min(n, max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK, "right")) - 1))
                at = offsets[first : last + 1] - offsets[first]
                some = np.flatnonzero(np.diff(at))
                if len(some):
                    part = data[offsets[first] : offsets[last]]
                    ids, ends = self._chunk(part, at[some], part.tobytes(), end_id)
                    out, places = ids.astype("<u4").tobytes(), [0, *(4 * ends).tolist()]
                k = 0
                for filled in (np.diff(at) > 0).tolist():
                    if filled:
                        yield out[places[k] : places[k + 1]]
                        k += 1
                    else:
                        yield nothing
                first = last


_ENCODERS: dict[str, ColumnEncoder] = {}


def encoder(path: str) -> ColumnEncoder:
    """One encoder for each Python process: that of the file asked for last."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = ColumnEncoder(path)
    return _ENCODERS[path]
