"""SentencePiece (merge type) encoding with seeded merge-dropout, and decoding.

A word's symbols are merged in the order of an agenda: the best-scored adjacent pair first,
the leftmost of equals.  With dropout each candidate pair is skipped for good if a hash of
(seed, id of the document, place of the word in it, bounds of the pair) falls below the rate,
so every occurrence of a word is cut by its own draws, which depend on nothing else: not on
partitions, order or retries.  At rate 0 the ids equal the sentencepiece library's.

Method: a block's distinct words are encoded together without dropout, and their ids and
merges are kept.  An occurrence that skips none of its word's merges has the word's ids,
since skipping other candidates changes nothing; the others run agendas of their own.  Words
of up to ``MOST_LOCKSTEP`` symbols run them in lockstep, as rows of a matrix of which each
step merges the best pair of every row; longer words run a heap.  Both are the same agenda
(tests hold this).  Decoding maps pieces to bytes and is exact for every text.

Defined cases: a null or empty text has no ids and decodes to the empty text; characters
without a piece become byte pieces; so does U+2581, which the model uses for the space (the
library would decode it as one); null ids draw alike; repeated rows are encoded alike;
an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import lean
from ._tokens import BlockEncoder, _values, crc32, gathered, text_blocks

MOST_LOCKSTEP = 32
#: Words whose merges are held against their draws at once.
PORTION = 1 << 17
SPACE = "▁"
ENCODED = "doc_id long, ids array<int>"
DIGEST = "doc_id long, variant int, n_tokens long, ids_crc32 long, decoded_sha256 string, lossless boolean"
_NEVER = 1 << 40


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_WORD64 = (1 << 64) - 1


def _mix_one(x: int) -> int:
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _WORD64
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _WORD64
    return x ^ (x >> 31)


def document_keys(doc_ids: pa.Array, seed: int) -> np.ndarray:
    """Hashes of documents' ids; 0 for null ids."""
    key = np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
    keys = _mix(doc_ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) ^ key)
    return np.where(doc_ids.is_null().to_numpy(zero_copy_only=False), np.uint64(0), keys)


class PieceTable:
    """Pieces of a merge-type model, and which adjacent pieces merge into which."""

    _made: dict[str, PieceTable] = {}
    _pairs: dict[tuple[int, int], tuple[int, int]] | None = None

    @classmethod
    def of(cls, path: str) -> PieceTable:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.size = n
        self.byte_ids = np.zeros(256, np.int64)
        of_text: dict[str, int] = {}
        surface: list[bytes] = []
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                surface.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                surface.append(b"")
            else:
                of_text[piece] = i
                surface.append(piece.replace(SPACE, " ").encode())
        if any(piece[k] == SPACE != piece[k - 1] for piece in of_text for k in range(1, len(piece))):
            raise ValueError("a piece holds a space after other characters: words can't be told apart")
        scores = sorted({-model.get_score(i) for i in of_text.values()})
        place = {s: k for k, s in enumerate(scores)}
        self.of_char = np.full(0x110000, -1, np.int32)
        pairs = []
        for piece, i in of_text.items():
            if len(piece) == 1:
                self.of_char[ord(piece)] = i
            for k in range(1, len(piece)):
                a, b = of_text.get(piece[:k]), of_text.get(piece[k:])
                if a is not None and b is not None:
                    pairs.append((a * n + b, place[-model.get_score(i)], i))
        self.of_char[0x20] = self.of_char[ord(SPACE)]
        self.of_char[ord(SPACE)] = -1
        pairs.sort()
        self.keys, self.ranks, self.merged = (np.array(x, np.int64) for x in zip(*pairs))
        self.lens = np.array([len(x) for x in surface])
        self.starts = np.cumsum(self.lens) - self.lens
        self.bytes = np.frombuffer(b"".join(surface), np.uint8)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and id of the pieces that pairs merge into; ``_NEVER`` for those that don't."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        has = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(has, self.ranks[at], _NEVER), self.merged[at]

    def pairs(self) -> dict[tuple[int, int], tuple[int, int]]:
        """``find`` for one pair at a time: (rank, id) by pair; made when first asked for."""
        if self._pairs is None:
            a, b = np.divmod(self.keys, self.size)
            self._pairs = dict(zip(zip(a.tolist(), b.tolist()), zip(self.ranks.tolist(), self.merged.tolist())))
        return self._pairs

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """Texts of ``counts`` ids each, end to end, without the space that encoding puts first."""
        lens = self.lens[ids]
        ends = np.cumsum(lens)
        flat = self.bytes[np.repeat(self.starts[ids] - (ends - lens), lens) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.append(0, ends)[np.append(0, np.cumsum(counts))].tolist()
        return [flat[a + (b > a) : b].tobytes() for a, b in zip(bounds, bounds[1:])]


class DropoutEncoder(BlockEncoder):
    """Encodes blocks of texts with the draws of a seed; ``variant`` tells draws of one seed apart."""

    _last: tuple[tuple, DropoutEncoder] | None = None

    @classmethod
    def of(cls, path: str, seed: int, rate: float) -> DropoutEncoder:
        key = (path, seed, rate)
        if cls._last is None or cls._last[0] != key:
            cls._last = key, cls(*key)
        return cls._last[1]

    def __init__(self, path: str, seed: int, rate: float, variant: int = 0):
        self.table = PieceTable.of(path)
        self.key = int.from_bytes(hashlib.blake2b(f"{seed}:{variant}".encode(), digest_size=8).digest(), "little")
        self.below = np.uint64(min(int(rate * 2**64), 2**64 - 1))
        self.rate = rate
        self._reset()

    def _reset(self) -> None:
        super()._reset()
        self._merges = np.zeros(0, np.uint64)
        self._merges_off = np.zeros(0, np.int64)
        self._merges_len = np.zeros(0, np.int64)

    def _pieces(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A space is put before every text that isn't empty; a word begins at each run of spaces."""
        some = starts[:-1][np.diff(starts) > 0]
        wide = np.insert(data, some, 32)
        begin = starts + np.searchsorted(some, starts, "left")
        first = np.zeros(len(wide), bool)
        first[some + np.arange(len(some))] = True
        begins = wide == 32
        begins[1:] &= wide[:-1] != 32
        at = np.flatnonzero(begins | first)
        return wide, np.append(at, len(wide)), np.searchsorted(at, begin)

    def _spans(self, start: np.ndarray, middle: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the bounds of pairs."""
        return _mix(((start.astype(np.uint64) << np.uint64(42)) ^ (middle.astype(np.uint64) << np.uint64(21)) ^ end.astype(np.uint64)) + np.uint64(self.key))

    def _skipped(self, words: np.ndarray, spans: np.ndarray) -> np.ndarray:
        return _mix(words ^ spans) < self.below

    def _skips(self, word: int, start: int, middle: int, end: int) -> bool:
        """``_skipped`` of one pair, in whole numbers."""
        span = _mix_one((((start << 42) ^ (middle << 21) ^ end) + self.key) & _WORD64)
        return _mix_one(word ^ span) < int(self.below)

    def _encode_new(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words without dropout; what they merge is kept."""
        merges: list[tuple[np.ndarray, np.ndarray]] = []
        flat, off, counts = self._run([x.decode("utf-8") for x in pieces], None, merges)
        rows, spans = (np.concatenate(x) for x in zip((np.zeros(0, np.int64), np.zeros(0, np.uint64)), *merges))
        lens = np.bincount(rows, minlength=len(pieces))
        self._merges_off = np.concatenate([self._merges_off, len(self._merges) + np.cumsum(lens) - lens])
        self._merges_len = np.concatenate([self._merges_len, lens])
        self._merges = np.concatenate([self._merges, spans[np.argsort(rows, kind="stable")]])
        return gathered(flat, off, counts), counts

    def _ids_of(self, pieces: pa.Array, first_piece: np.ndarray, docs: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``docs``: the keys of the texts' documents (0 if not given)."""
        of_piece = self._look_up(pieces)
        off, lens = self._off[of_piece], self._len[of_piece]
        if not self.rate:
            return self._ids, off, lens
        n_words = np.diff(first_piece)
        place = np.arange(len(of_piece)) - np.repeat(first_piece[:-1], n_words)
        words = _mix(np.repeat(np.zeros(len(n_words), np.uint64) if docs is None else docs, n_words) ^ _mix(place.astype(np.uint64) + np.uint64(self.key)))
        pools = [self._ids]
        base = len(self._ids)
        for i in range(0, len(of_piece), PORTION):
            at = of_piece[i : i + PORTION]
            k = self._merges_len[at]
            skipped = self._skipped(np.repeat(words[i : i + PORTION], k), gathered(self._merges, self._merges_off[at], k))
            varied = i + np.unique(np.searchsorted(np.cumsum(k), np.flatnonzero(skipped), "right"))
            texts = [x.decode("utf-8") for x in _values(pieces.take(pa.array(varied, pa.int64())))]
            flat, own, counts = self._run(texts, words[varied])
            off[varied], lens[varied] = base + own, counts
            pools.append(flat)
            base += len(flat)
        return np.concatenate(pools), off, lens

    def _run(self, texts: list[str], words: np.ndarray | None, merges: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where those of each word begin and how many they are, with the draws of ``words`` (None: no dropout)."""
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        off, counts = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        pools, base = [np.zeros(0, np.uint32)], 0

        def keep(rows: np.ndarray, flat: np.ndarray, n: np.ndarray) -> None:
            nonlocal base
            off[rows], counts[rows] = base + np.cumsum(n) - n, n
            pools.append(flat.astype(np.uint32))
            base += len(flat)

        low = 0
        for high in (5, 8, 12, 16, 32):
            high = min(high, MOST_LOCKSTEP)
            rows = np.flatnonzero((lens > low) & (lens <= high))
            for i in range(0, len(rows), 3000):
                keep(rows[i : i + 3000], *self._lockstep(rows[i : i + 3000], texts, words, high, merges))
            low = high
        for k in np.flatnonzero(lens > MOST_LOCKSTEP).tolist():
            ids = self.agenda(texts[k], None if words is None else words[k], None if merges is None else (merges, k))
            keep(np.array([k]), np.array(ids), np.array([len(ids)]))
        return np.concatenate(pools), off, counts

    def _bytes(self, symbols: list[int], places: list[int], text: str) -> list[int]:
        """Ids of symbols; those without a piece as the bytes of their character."""
        out: list[int] = []
        for s, p in zip(symbols, places):
            out += [s] if s >= 0 else self.table.byte_ids[list(text[p].encode())].tolist()
        return out

    def _lockstep(self, rows: np.ndarray, texts: list[str], words: np.ndarray | None, width: int, merges: list | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words of these rows, end to end, and how many each has."""
        table, n = self.table, len(rows)
        own = [texts[k] for k in rows.tolist()]
        chars = np.array(own, dtype=f"U{width}").view(np.uint32).reshape(n, width)
        size = np.fromiter(map(len, own), np.int64, n)
        inside = np.arange(width) < size[:, None]
        ids = np.where(inside, table.of_char[chars], -2).astype(np.int64)
        after = np.tile(np.arange(1, width + 1), (n, 1))
        before = after - 2
        rank = np.full((n, width), _NEVER, np.int64)
        into = np.zeros((n, width), np.int64)
        word = None if words is None else words[rows]

        def rate(r: np.ndarray, c: np.ndarray) -> None:
            """Looks the pair up that begins at column c of row r."""
            nxt = after[r, c]
            ok = nxt < size[r]
            r, c, nxt = r[ok], c[ok], nxt[ok]
            got, merged = table.find(ids[r, c], ids[r, nxt])
            if word is not None:
                got[self._skipped(word[r], self._spans(c, nxt, after[r, nxt]))] = _NEVER
            rank[r, c], into[r, c] = got, merged

        r, c = np.nonzero(inside[:, 1:])
        rate(r, c)
        active = np.arange(n)
        while len(active):
            best = rank[active].argmin(axis=1)
            go = rank[active, best] < _NEVER
            active, c = active[go], best[go]
            if not len(active):
                break
            gone = after[active, c]
            ids[active, c] = into[active, c]
            ids[active, gone] = -2
            rank[active, gone] = rank[active, c] = _NEVER
            end = after[active, gone]
            if merges is not None:
                merges.append((rows[active], self._spans(c, gone, end)))
            after[active, c] = end
            inner = end < size[active]
            before[active[inner], end[inner]] = c[inner]
            rate(active, c)
            left = before[active, c]
            has = left >= 0
            rank[active[has], left[has]] = _NEVER
            rate(active[has], left[has])
        alive = ids != -2
        counts = alive.sum(axis=1)
        flat = ids[alive]
        odd = np.unique(np.nonzero(ids == -1)[0]).tolist()
        if odd:
            bounds = np.append(0, np.cumsum(counts)).tolist()
            parts, done = [], 0
            for k in odd:
                own_ids = self._bytes(flat[bounds[k] : bounds[k + 1]].tolist(), np.flatnonzero(alive[k]).tolist(), own[k])
                parts += [flat[done : bounds[k]], np.array(own_ids, np.int64)]
                done, counts[k] = bounds[k + 1], len(own_ids)
            flat = np.concatenate([*parts, flat[done:]])
        return flat, counts

    def agenda(self, text: str, hashed: np.uint64 | None, merges: tuple[list, int] | None = None) -> list[int]:
        """One word, by a heap of candidate pairs."""
        table, n = self.table, len(text)
        ids = table.of_char[np.array([text], dtype=f"U{n}").view(np.uint32)].astype(np.int64)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        word = None if hashed is None else np.array([hashed], np.uint64)
        made: list[tuple[int, int, int]] = []
        symbols: list[int] = ids.tolist()
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(starts: np.ndarray) -> None:
            """Many pairs at once: those of the word as it begins."""
            nxt = starts + 1
            got, merged = table.find(ids[starts], ids[nxt])
            if word is not None:
                got[self._skipped(word.repeat(len(starts)), self._spans(starts, nxt, nxt + 1))] = _NEVER
            heap.extend(row for row in zip(got.tolist(), starts.tolist(), nxt.tolist(), (nxt + 1).tolist(), merged.tolist()) if row[0] < _NEVER)
            heapq.heapify(heap)

        def offer_one(c: int) -> None:
            """One pair, without arrays."""
            if c < 0 or after[c] >= n:
                return
            nxt = after[c]
            found = table.pairs().get((symbols[c], symbols[nxt]))
            if found and not (word is not None and self._skips(int(word[0]), c, nxt, after[nxt])):
                heapq.heappush(heap, (found[0], c, nxt, after[nxt], found[1]))

        offer(np.arange(n - 1))
        alive = [True] * n
        while heap:
            _, c, nxt, end, merged = heapq.heappop(heap)
            if not alive[c] or after[c] != nxt or not alive[nxt] or after[nxt] != end:
                continue  # one of the two has grown since
            symbols[c], alive[nxt], after[c] = merged, False, end
            made.append((c, nxt, end))
            if end < n:
                before[end] = c
            offer_one(before[c])
            offer_one(c)
        if merges is not None and made:
            merges[0].append((np.full(len(made), merges[1]), self._spans(*np.array(made).T)))
        places = [k for k in range(n) if alive[k]]
        return self._bytes([symbols[k] for k in places], places, text)


def _encoded(batch: pa.RecordBatch, model: str, seed: int, rate: float) -> Iterator[tuple]:
    """For the texts of a batch, by block: doc ids, their keys, ids, counts, and the texts' bytes."""
    for i, j, data, starts in text_blocks(batch.column(1)):
        names = batch.column(0).slice(i, j - i)
        keys = document_keys(names, seed)
        tokens, counts = DropoutEncoder.of(model, seed, rate).encode(data, starts, keys)
        yield names, keys, tokens, counts, data, starts


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text"))


def encode_documents(docs: DataFrame, model: str, seed: int = 0, rate: float = 0.1) -> DataFrame:
    """(doc_id, ids) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for names, _, tokens, counts, _, _ in _encoded(batch, model, seed, rate):
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(tokens.astype(np.int32)))
                yield pa.record_batch([names, lists], names=["doc_id", "ids"])

    return _columns(docs).mapInArrow(lean(run), ENCODED)


def decode_documents(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) of encoded documents; null ids decode to the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = PieceTable.of(model)
        for batch in batches:
            lists = batch.column(1)
            counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            texts = table.decode(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), counts)
            yield pa.record_batch([batch.column(0), pa.array([x.decode("utf-8") for x in texts])], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(lean(run), "doc_id long, text string")


def encode_and_decode(docs: DataFrame, model: str, seed: int = 0, rate: float = 0.1) -> DataFrame:
    """Digest of every document's ids, and of the text that they decode to (``DIGEST``).

    ``variant`` is the first 31 bits of the document's key, from which its words' draws come.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = PieceTable.of(model)
        for batch in batches:
            for names, keys, tokens, counts, own, bounds in _encoded(batch, model, seed, rate):
                texts = table.decode(tokens, counts)
                at = np.append(0, np.cumsum(counts)).tolist()
                columns = [
                    names, pa.array((keys >> np.uint64(33)).astype(np.int32)), pa.array(counts, pa.int64()),
                    pa.array([crc32(tokens[a:b]) for a, b in zip(at, at[1:])], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in texts]),
                    pa.array([own[a:b].tobytes() == x for a, b, x in zip(bounds.tolist(), bounds[1:].tolist(), texts)]),
                ]
                yield pa.record_batch(columns, names=[x.split()[0] for x in DIGEST.split(", ")])

    return _columns(docs).mapInArrow(lean(run), DIGEST)
