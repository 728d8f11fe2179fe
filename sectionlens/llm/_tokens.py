"""Exact, vectorised use of a ``tokenizers`` vocabulary inside Python workers.

Encoding a corpus word by word repeats most of its work, since most words repeat.
``BlockEncoder`` cuts a block of UTF-8 texts at white space where the vocabulary's own
pre-tokenizer must cut as well, finds the distinct pieces with Arrow, has the tokenizers
library encode each distinct piece once, and gathers the ids of the whole block with numpy.
The ids equal those of ``Tokenizer.encode(text, add_special_tokens=False)`` (tests hold
this): strings of special tokens become those tokens, and the texts around them are encoded
apart.  Vocabularies whose normalizer or pre-tokenizer isn't one of the two known kinds are
refused, since the cuts wouldn't be known to be theirs.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are held as numpy arrays at once; a longer text is a block of its own.
BLOCK_BYTES = 4 << 20
#: Distinct pieces, and ids, that a worker keeps between blocks.
CACHE_PIECES, CACHE_IDS = 800_000, 8_000_000
#: Pieces whose encodings, objects of the library, exist at once.
ENCODED_AT_ONCE = 4096

#: Kinds of bytes; the exclusive or of two kinds tells the pair.
_OTHER, _SPACE, _LETTER, _PUNCTUATION = 0, 1, 2, 4
_KIND = np.zeros(256, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = _SPACE
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[[i for i in range(33, 127) if not chr(i).isalnum() and chr(i) != "'"]] = _PUNCTUATION
#: UTF-8 forms of white space beyond ASCII (fixed values of Unicode).
_WIDE_SPACE = [
    b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80",
    *(b"\xe2\x80" + bytes([x]) for x in (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)),
    b"\xe2\x81\x9f", b"\xe3\x80\x80",
]

#: Normalizers and pre-tokenizers whose cuts are known (fixed values of the vocabulary files).
_BYTE_LEVEL = (None, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True})
_WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_WORD_LEVEL = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": _WORD_SPLIT}, "behavior": "Removed", "invert": True}, {**_BYTE_LEVEL[1], "use_regex": False}]},
)


def _values(column: pa.Array) -> list[bytes]:
    raw = column.buffers()
    at = np.frombuffer(raw[1], np.int32)[column.offset : column.offset + len(column) + 1].tolist()
    data = raw[2].to_pybytes()
    return [data[i:j] for i, j in zip(at, at[1:])]


class BlockEncoder:
    """Encodes blocks of texts with one vocabulary file.

    ``keeps_space`` tells whether the vocabulary encodes white space (byte-level BPE) or
    drops it (word BPE); it is read from the file's pre-tokenizer.  ``specials`` are the
    strings that become a token of their own, with their ids.
    """

    specials: tuple[tuple[bytes, int], ...] = ()
    _made: dict[str, BlockEncoder] = {}

    @classmethod
    def of(cls, path: str) -> BlockEncoder:
        """The worker's encoder for a vocabulary file, made once."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kind = spec["normalizer"], spec["pre_tokenizer"]
        if kind not in (_BYTE_LEVEL, _WORD_LEVEL):
            raise ValueError(f"{path}: a normalizer or pre-tokenizer whose cuts aren't known")
        if any(x[k] for x in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"{path}: an added token that takes in its surroundings")
        self.keeps_space = kind == _BYTE_LEVEL
        self.specials = tuple((x["content"].encode(), x["id"]) for x in spec["added_tokens"])
        self.vocab_size = self.tokenizer.get_vocab_size()
        self._reset()

    def _reset(self) -> None:
        self._known = pa.array([], pa.binary())  # end to end: as objects, pieces took 300 bytes each
        self._len = np.zeros(0, np.int64)
        self._off = np.zeros(0, np.int64)
        self._ids = np.zeros(0, np.uint32)

    def _pieces(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Piece bytes, piece offsets, and the first piece of each text (one more at the end).

        Cuts stand only where the pre-tokenizer cuts whatever surrounds them: at white space,
        and between a letter and ASCII punctuation (but for the apostrophe of contractions).
        """
        n = len(data)
        first = np.zeros(n + 1, bool)
        first[starts] = True
        first[n] = False
        kind = _KIND[data]
        if len(lead := np.flatnonzero(data[:-1] == 0xC3)):
            lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
            kind[lead] = kind[lead + 1] = _LETTER
        begins = first[:n].copy()
        begins[1:] |= (kind[1:] ^ kind[:-1]) == _LETTER ^ _PUNCTUATION
        if not self.keeps_space:
            word = kind != _SPACE
            begins[1:] |= ~word[:-1]
            begins &= word
            at = np.flatnonzero(begins)
            before = np.zeros(n + 1, np.int32)
            np.cumsum(word, out=before[1:])
            upper = (data >= 65) & (data <= 90)
            upper[:-1] &= (data[1:] < 0x80) | (data[1:] == 0xC3)  # a combining mark may follow otherwise
            return (data | (upper.view(np.uint8) << 5))[np.flatnonzero(word)], np.append(before[at], before[n]), np.searchsorted(at, starts)
        solid = data > 0x20
        lead = np.flatnonzero((data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3)))
        for form in _WIDE_SPACE if len(lead) else ():
            hit = lead[lead + len(form) <= n]
            for k, byte in enumerate(form):
                hit = hit[data[hit + k] == byte]
            for k in range(len(form)):
                solid[hit + k] = False
        alone = np.zeros(n, bool)
        if n > 2:
            alone[1:-1] = ((data[1:-1] == 0x20) | (data[1:-1] == 0x0A)) & solid[:-2] & solid[2:]
        alone &= ~first[:n]
        alone[:-1] &= ~first[1:n]
        begins |= alone
        begins[1:] |= alone[:-1] & (data[:-1] == 0x0A)
        at = np.flatnonzero(begins)
        return data, np.append(at, n), np.searchsorted(at, starts)

    def _encode_new(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, end to end, and how many each has."""
        flat, lens = [], []
        for i in range(0, len(pieces), ENCODED_AT_ONCE):
            lists = [x.ids for x in self.tokenizer.encode_batch([x.decode("utf-8") for x in pieces[i : i + ENCODED_AT_ONCE]], add_special_tokens=False)]
            lens.append(np.fromiter(map(len, lists), np.int64, len(lists)))
            flat.append(np.fromiter((i for x in lists for i in x), np.uint32, int(lens[-1].sum())))
        return np.concatenate(flat), np.concatenate(lens)

    def _look_up(self, pieces: pa.Array) -> np.ndarray:
        """The place of each piece in the cache, into which new ones are encoded."""
        coded = pieces.dictionary_encode()
        distinct = coded.dictionary
        slots = pc.index_in(distinct, self._known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        missing = np.flatnonzero(slots < 0)
        if len(missing):
            new = distinct.take(pa.array(missing))
            flat, lens = self._encode_new(_values(new))
            slots[missing] = np.arange(len(self._known), len(self._known) + len(new))
            self._known = pa.concat_arrays([self._known, new])
            self._off = np.concatenate([self._off, len(self._ids) + np.cumsum(lens) - lens])
            self._len = np.concatenate([self._len, lens])
            self._ids = np.concatenate([self._ids, flat])
        return slots[coded.indices.to_numpy(zero_copy_only=False)]

    def _ids_of(self, pieces: pa.Array, first_piece: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where those of each piece begin in them and how many they are."""
        of_piece = self._look_up(pieces)
        return self._ids, self._off[of_piece], self._len[of_piece]

    def encode(self, data: np.ndarray, starts: np.ndarray, *own) -> tuple[np.ndarray, np.ndarray]:
        """Ids (uint32) of all texts, and how many each text has.

        ``data``: the texts' UTF-8 bytes end to end; ``starts``: where each text begins,
        and ``len(data)`` at the end; ``own``: what ``_ids_of`` takes besides.
        """
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(starts) - 1, np.int64)
        if found := self._found_specials(data, starts):
            return self._encode_around(found, data, starts)
        solid, offsets, first_piece = self._pieces(data, starts)
        n = len(offsets) - 1
        pieces = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(solid))])
        flat, off, lens = self._ids_of(pieces, first_piece, *own)
        ids = gathered(flat, off, lens)
        bounds = np.append(0, np.cumsum(lens))[first_piece]
        if len(self._known) > CACHE_PIECES or len(self._ids) > CACHE_IDS:
            self._reset()
        return ids, np.diff(bounds)

    def _found_specials(self, data: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int]]:
        """(start, end, id) of each special string that lies in one text, by start."""
        if not self.specials:
            return []
        whole, found = data.tobytes(), []
        for string, number in self.specials:
            at = whole.find(string)
            while at >= 0:
                if starts[np.searchsorted(starts, at, "right")] >= at + len(string):
                    found.append((at, at + len(string), number))
                at = whole.find(string, at + 1)
        return sorted(found)

    def _encode_around(self, found: list[tuple[int, int, int]], data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encodes what stands around special strings as texts of their own, and puts their ids between."""
        begin, end, number = (np.array(x, np.int64) for x in zip(*found))
        left = np.ones(len(data), bool)
        left[_ragged(begin, end - begin)] = False
        before = np.append(0, np.cumsum(left))
        # a text of k special strings is k + 1 texts
        doc = np.searchsorted(starts, begin, "right") - 1
        cuts = np.insert(before[starts], doc + 1, before[end])
        ids, lens = self.encode(data[left], cuts)
        first = np.arange(len(starts)) + np.searchsorted(doc, np.arange(len(starts)))
        ends = np.append(0, np.cumsum(lens))
        out = np.insert(ids, ends[np.arange(len(doc)) + doc + 1], number.astype(np.uint32))
        return out, np.diff(ends[first]) + np.bincount(doc, minlength=len(starts) - 1)


def _ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices of runs of ``lens`` from ``starts`` on, end to end."""
    ends = np.cumsum(lens)
    return np.repeat(starts - (ends - lens), lens) + np.arange(ends[-1] if len(ends) else 0)


def gathered(flat: np.ndarray, off: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` that begin at ``off``, end to end."""
    return flat[_ragged(off, lens)]


def text_blocks(column: pa.Array | pa.ChunkedArray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cuts a string column into blocks: (first row, end row, bytes, starts); null texts are empty."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    row = 0
    for x in chunks:
        if x.null_count:
            x = x.fill_null("")
        wide = pa.types.is_large_string(x.type)
        raw = x.buffers()
        offsets = np.frombuffer(raw[1], np.int64 if wide else np.int32)[x.offset : x.offset + len(x) + 1].astype(np.int64) if len(x) else np.zeros(1, np.int64)
        data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None and raw[2].size else np.zeros(0, np.uint8)
        i = 0
        while i < len(x):
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
            yield row + i, row + j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            i = j
        row += len(x)


def with_end(ids: np.ndarray, lens: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with ``end_id`` after each text's own, and the bounds of the texts."""
    bounds = np.append(0, np.cumsum(lens + 1))
    out = np.empty(bounds[-1], np.uint32)
    last = np.zeros(len(out), bool)
    last[bounds[1:] - 1] = True
    out[last] = end_id
    out[~last] = ids
    return out, bounds


def crc32(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())
