"""Exact substring deduplication with a sparse, distributed suffix array.

A byte goes if it lies in a string of ``length`` bytes that also starts earlier: in a
document of smaller id, or earlier in the same one.  Matches never cross documents.

A suffix array of every byte would move a hundred bytes for each.  This one is sparse and
still exact: in every window of ``length`` bytes the ``gram``-byte string of least hash
(the leftmost of equals) is its anchor, so equal windows have equal anchors at equal
places, and only suffixes at anchors can begin a repeat.  The stages:

1. The texts are written once to the shared folder; each file is a *part*.
2. Each part sends the hashes of its anchors and how often it holds each, dealt by hash;
   the receivers send back those that more than one place holds.
3. Parts cut the suffixes at repeated anchors, with the bytes around them that the
   anchor's windows cover, merge identical ones, and send them to ranges of leading bytes,
   whose splitters come from a sample.
4. Each range sorts its suffixes by multikey quicksort (8 bytes a step, only ties go on),
   which brings equal anchors and equal surroundings together.  Within an anchor's run the
   windows of different surroundings are compared, and all but the first of equals are
   reported to their parts.  Splitters are whole leading words and ranges closed on one
   side, so that no two equal suffixes are in different ranges: the comparison across a
   boundary is between words that differ.
5. Parts unite the reported spans of each document and cut the texts.

What moves is packed: one row for each sender and receiver, so Spark handles few rows.
Parts read their file from the shared folder and never move texts.  A part's repeats of one
suffix count once before anything is sent, which flattens groups of copies.  The anchors at
the ends of a passage have surroundings that differ at each occurrence, and all would meet
in one range.  An anchor that outweighs its range (see ``HOT_SHARE``: a share of what is there,
not a size) has its windows dealt out one by one by their own 128-bit digests instead: those
inside the passage are one row a part, those that reach beyond it are spread evenly.

Defined cases: a null text is empty; null ids come last, like the greatest long; rows with
equal ids are separate documents in the order of their files; texts under ``length`` bytes
lose nothing; an empty table gives an empty result; other columns aren't read unless
``carry`` names them: they come back in one struct, ``carried``, whatever their names.
"""

from __future__ import annotations

import hashlib
import pickle
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import lean, open_random, shuffle_partitions, work_dir
from ._tokens import text_blocks

LENGTH, GRAM = 100, 32
#: Bytes of text whose hashes are held at once, and rows read from a file at once.
BLOCK, ROWS = 1 << 20, 512
#: Splitters are drawn from so many leading words for each range.
SAMPLES_A_RANGE = 64
#: Surroundings whose windows are hashed at once, or one anchor's if it has more.
WINDOW_ROWS = 1 << 14
#: An anchor whose occurrences are more than this times the rows (of any repeated anchor, one
#: for each part) that the task which counts it holds would weigh down its range: its windows
#: are dealt out by their own content.
HOT_SHARE = 1.0
_LAST_ID = np.iinfo(np.int64).max
_RNG = np.random.default_rng(20_240_229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = int(_RNG.integers(1 << 61, 1 << 62, dtype=np.uint64)) | 1
_BASE_2 = int(_RNG.integers(1 << 61, 1 << 62, dtype=np.uint64)) | 1
_PACK = "to int, sender int, payload binary"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
RESULT_WITH_TEXT = RESULT + ", kept binary, kept_text string, spans array<long>"


def gram_hashes(data: np.ndarray, gram: int, base: int = _BASE) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes from each place on that has as many."""
    n = len(data) - gram + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, size, have = base, 1, _BYTE[data]
    out, covered = None, 0
    k = gram
    while k:
        if k & 1:
            piece = have[covered : covered + n]
            out = piece.copy() if out is None else out * np.uint64(power) + piece
            covered += size
        k >>= 1
        if k:
            have = have[:-size] * np.uint64(power) + have[size:]
            power, size = power * power % (1 << 64), 2 * size
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out


def anchors(data: np.ndarray, starts: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Anchors of the texts in a block: place, hash, first and last start of its windows."""
    hashes = gram_hashes(data, gram)
    width, n = length - gram + 1, len(data) - length + 1
    if n <= 0:
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64))
    least = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    size = 1
    while 2 * size <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if rest := width - size:
        least = np.minimum(least[:-rest], least[rest:])
    begin, end = starts[:-1], starts[1:]
    long_enough = end - begin >= length
    edge = np.zeros(len(data) + 1, np.int32)
    np.add.at(edge, begin[long_enough], 1)
    np.add.at(edge, end[long_enough] - length + 1, -1)
    x = np.flatnonzero(np.cumsum(edge)[:n])
    if not len(x):
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64))
    place = (least[x] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.append(True, (np.diff(place) != 0) | (np.diff(x) != 1)))
    last = np.append(new[1:], len(x)) - 1
    return place[new], hashes[place[new]], x[new], x[last]


def multikey_order(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows of 64-bit words, and the depth (in words) at which each row first differs
    from the one before it (the number of words if it doesn't).

    Multikey quicksort, all groups of tied rows at once: a group is parted at a pivot, the
    median of three of its words, into less, equal and greater; the equal go on to the next
    word, the others stay at theirs; groups of one row, or out of words, are done.
    """
    n, m = words.shape
    order, depth = np.arange(n), np.zeros(n, np.int64)
    slot = np.arange(n if n > 1 else 0)  # of rows that still tie with others
    begins = np.append(True, np.zeros(max(0, len(slot) - 1), bool))[: len(slot)]
    level = np.zeros(len(slot), np.int64)
    while len(slot):
        key = words[order[slot], level]
        first = np.flatnonzero(begins)
        size = np.diff(np.append(first, len(slot)))
        a, b, c = key[first], key[first + size // 2], key[first + size - 1]
        pivot = np.repeat(np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c)), size)
        kind = (key >= pivot).astype(np.int8) + (key > pivot)
        # places: within its group a row follows the rows of lesser kinds, in order
        to = np.repeat(first, size) - 1
        part = np.zeros((3, len(first)), np.int64)
        for k in range(3):
            count = np.cumsum(kind == k)
            before = np.append(0, count)[first]
            part[k] = np.append(count[first[1:] - 1], count[-1]) - before
            of = np.flatnonzero(kind == k)
            to[of] += (count - np.repeat(before - part[:k].sum(axis=0), size))[of]
        moved = order[slot]
        order[slot[to]] = moved
        # of each part: where it begins, how long it is, and its word
        begin = first[None, :] + np.cumsum(part, axis=0) - part
        some = part.T.ravel() > 0
        begin, length = begin.T.ravel()[some], part.T.ravel()[some]
        word = np.stack([level[first], level[first] + 1, level[first]], axis=1).ravel()[some]
        inner = ~begins[begin]
        depth[slot[begin[inner]]] = level[begin[inner]]
        ended = word == m
        if ended.any():  # rows equal in all words
            equal = np.repeat(ended, length)
            equal[begin] = False
            depth[slot[equal]] = m
        on = np.repeat((length > 1) & ~ended, length)
        begins = np.zeros(len(slot), bool)
        begins[begin] = True
        slot, begins, level = slot[on], begins[on], np.repeat(word, length)[on]
    return order, depth


def _anchor_bytes(data: np.ndarray, place: np.ndarray, gram: int) -> np.ndarray:
    """The anchors at these places as byte strings of one width."""
    rows = np.ascontiguousarray(data[place[:, None] + np.arange(gram)]).reshape(len(place), gram)
    return rows.view(f"S{gram}").ravel()


class _Part:
    """A part's texts, block by block, from its file in the shared folder."""

    def __init__(self, file: str):
        self.file = pq.ParquetFile(open_random(file))

    def carrying(self, carried: bool = True) -> Iterator[tuple[int, pa.Array, np.ndarray, np.ndarray, pa.Array | None]]:
        """(number of the first row, ids, bytes, starts, carried columns)"""
        row = 0
        for batch in self.file.iter_batches(batch_size=ROWS, columns=["doc_id", "text", *["carried"] * carried]):
            for i, j, data, starts in text_blocks(batch.column(1), BLOCK):
                yield row + i, batch.column(0).slice(i, j - i), data, starts, batch.column(2).slice(i, j - i) if carried else None
            row += len(batch)

    def blocks(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(number of the first row, ids to order by, bytes, starts)"""
        for row, ids, data, starts, _ in self.carrying(False):
            yield row, ids.fill_null(_LAST_ID).to_numpy(zero_copy_only=False), data, starts


def _packed(rows: list[tuple[int, int, tuple]]) -> pa.RecordBatch:
    return pa.record_batch(
        [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([pickle.dumps(r[2], 5) for r in rows], pa.binary())],
        names=["to", "sender", "payload"],
    )


def _received(batches: Iterator[pa.RecordBatch]) -> dict[int, list[tuple[int, tuple]]]:
    got: dict[int, list] = defaultdict(list)
    for batch in batches:
        for to, sender, payload in zip(*(batch.column(k).to_pylist() for k in range(3))):
            got[to].append((sender, pickle.loads(payload)))
    for rows in got.values():
        rows.sort(key=lambda r: r[0])
    return got


def _by_receiver(to: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Receivers and the rows that each gets."""
    by = np.argsort(to, kind="stable")
    cuts = np.flatnonzero(np.append(True, np.diff(to[by]) != 0)) if len(by) else []
    for a, b in zip(cuts, [*cuts[1:], len(by)]):
        yield int(to[by[a]]), by[a:b]


def _ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices of runs of ``lens`` from ``starts`` on, end to end."""
    ends = np.cumsum(lens)
    return np.repeat(starts - (ends - lens), lens) + np.arange(ends[-1] if len(ends) else 0)


def _surroundings(lens: np.ndarray, flat: np.ndarray, reach: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Surroundings as rows of ``2 * length - gram`` bytes, their anchors at one place, 0 beyond."""
    left = length - gram
    out = np.zeros((len(lens), left + length), np.uint8)
    ends = np.cumsum(lens)
    for i in range(0, len(lens), 1 << 13):  # so that the indices stay small
        n, width = lens[i : i + (1 << 13)], out.shape[1]
        to = _ragged(np.arange(len(n)) * width + left - reach[i : i + (1 << 13)], n)
        out[i : i + (1 << 13)].reshape(-1)[to] = flat[ends[i] - lens[i] : ends[i + len(n) - 1]]
    return out


def _words(rows: np.ndarray, bounds: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Rows of surroundings as big-endian words: the suffix at the anchor, then what is left of it, then the bounds."""
    left = length - gram
    suffix, before = rows[:, left:], rows[:, :left][:, ::-1]
    pad = lambda x: np.pad(x, ((0, 0), (0, -x.shape[1] % 8)))
    # the anchor itself fills whole words first, so that depth tells equal anchors
    parts = [pad(suffix[:, :gram]), pad(suffix[:, gram:]), pad(before)]
    words = [np.ascontiguousarray(x).view(">u8").astype(np.uint64) for x in parts]
    return np.hstack([*words, bounds.astype(np.uint64)[:, None]])


def first_and_repeats(rows: np.ndarray, low: np.ndarray, high: np.ndarray, rank: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For suffixes with surroundings: least and greatest reach of their windows that have an
    earlier equal (greatest -1 if none does).

    ``low``, ``high``: how far before the anchor the windows start; ``rank``: order of starts.
    """
    n = len(rows)
    words = _words(rows, low.astype(np.int64) << 32 | high, length, gram)
    order, depth = multikey_order(words)
    anchor_words = -(-gram // 8)
    same_anchor = depth >= anchor_words
    same_anchor[:1] = False
    identical = depth >= words.shape[1]
    identical[:1] = False
    del words
    group = np.cumsum(~same_anchor)
    cls = np.cumsum(~identical) - 1
    first_of = np.full(cls[-1] + 1 if n else 0, np.iinfo(np.int64).max, np.int64)
    np.minimum.at(first_of, cls, rank[order])
    out_low, out_high = np.full(n, 1 << 30, np.int64), np.full(n, -1, np.int64)
    is_first = rank[order] == first_of[cls]
    later = order[~is_first]
    out_low[later], out_high[later] = low[later], high[later]
    # distinct surroundings of one anchor: compare their windows, some anchors at a time
    several = np.bincount(group[is_first], minlength=group[-1] + 1 if n else 0)[group] > 1
    pick = np.flatnonzero(is_first & several)
    pick = pick[np.lexsort((rank[order[pick]], group[pick]))]
    starts = np.flatnonzero(np.append(True, np.diff(group[pick]) != 0)) if len(pick) else pick
    at = 0
    while at < len(pick):
        end = int(np.append(starts, len(pick))[max(np.searchsorted(starts, at) + 1, np.searchsorted(starts, at + WINDOW_ROWS, "right") - 1)])
        ids = order[pick[at:end]]
        least, most = _window_repeats(rows[ids], low[ids], high[ids], group[pick[at:end]], length, gram)
        out_low[ids], out_high[ids] = np.minimum(out_low[ids], least), np.maximum(out_high[ids], most)
        at = end
    return out_low, out_high


def _window_repeats(own: np.ndarray, lo: np.ndarray, hi: np.ndarray, groups: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest reach of the windows that an earlier row of the same group has as well."""
    least, most = np.full(len(own), 1 << 30, np.int64), np.full(len(own), -1, np.int64)
    base, over = np.uint64(_BASE), np.uint64(pow(_BASE, length, 1 << 64))
    prefix = np.zeros((own.shape[1] + 1, len(own)), np.uint64)
    for j in range(own.shape[1]):
        prefix[j + 1] = prefix[j] * base + _BYTE[own[:, j]]
    salt = groups.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for reach in range(int(lo.min()), int(hi.max()) + 1):
        has = np.flatnonzero((lo <= reach) & (reach <= hi))
        if len(has) < 2:
            continue
        at = length - gram - reach
        key = (prefix[at + length, has] - prefix[at, has] * over) ^ salt[has]
        by = np.argsort(key, kind="stable")
        same = np.append(False, np.diff(key[by]) == 0)
        hit = np.flatnonzero(same)
        if not len(hit):
            continue
        heads = np.maximum.accumulate(np.where(same, 0, np.arange(len(by))))
        a, b = has[by[hit]], has[by[heads[hit]]]
        for i in range(0, len(a), 1 << 15):  # equal hashes are checked byte by byte
            p, q = a[i : i + (1 << 15)], b[i : i + (1 << 15)]
            p = p[(own[p, at : at + length] == own[q, at : at + length]).all(axis=1) & (groups[p] == groups[q])]
            least[p], most[p] = np.minimum(least[p], reach), np.maximum(most[p], reach)
    return least, most


def _send_hashes(length: int, gram: int, n_to: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, file in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = [anchors(data, starts, length, gram)[1] for _, _, data, starts in _Part(file).blocks()]
                values, times = np.unique(np.concatenate([*found, np.zeros(0, np.uint64)]), return_counts=True)
                to = (values % np.uint64(n_to)).astype(np.int64)
                yield _packed([(k, part, (values[rows], np.minimum(times[rows], 255).astype(np.uint8), *_many(times[rows]))) for k, rows in _by_receiver(to)])

    return run


def _many(times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of counts that a byte can't hold."""
    at = np.flatnonzero(times > 255)
    return at.astype(np.int32), times[at].astype(np.int64)


def _return_repeated(hot_share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for to, rows in _received(batches).items():
            values = np.concatenate([x[0] for _, x in rows])
            counts = []
            for _, x in rows:
                counts.append(x[1].astype(np.int64))
                counts[-1][x[2]] = x[3]
            owner = np.repeat([s for s, _ in rows], [len(x[0]) for _, x in rows])
            by = np.argsort(values, kind="stable")
            values, owner, counts = values[by], owner[by], np.concatenate(counts)[by]
            starts = np.flatnonzero(np.append(True, np.diff(values) != 0)[: len(values)])
            total = np.repeat(np.add.reduceat(counts, starts), np.diff(np.append(starts, len(values)))) if len(values) else counts
            own = np.flatnonzero(total > 1)
            values, owner, hot = values[own], owner[own], total[own] > hot_share * len(own)
            yield _packed([(k, to, (values[r], hot[r])) for k, r in _by_receiver(owner)])

    return run


def _runs(row: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of what windows of ``length`` at these starts cover, neighbours joined."""
    by = np.lexsort((start, row))
    row, start = row[by], start[by]
    new = np.flatnonzero(np.append(True, (np.diff(row) != 0) | (np.diff(start) != 1))[: len(row)])
    last = np.append(new[1:], len(row)) - 1 if len(row) else new
    return row[new].astype(np.int32), start[new], start[last] + length


def _later(order: tuple[np.ndarray, ...], high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Which rows have an equal digest (high, low) earlier in the order (its last key counts most)."""
    by = np.lexsort((*order, low, high))
    same = np.append(False, (np.diff(high[by]) == 0) & (np.diff(low[by]) == 0))[: len(by)]
    out = np.zeros(len(by), bool)
    out[by[same]] = True
    return out


def _sample_words(length: int, gram: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(1).to_pylist():
                for _, _, data, starts in _Part(file).blocks():
                    place = anchors(data, starts, length, gram)[0]
                    if len(place):
                        place = place[:: max(1, len(place) // most)][:most]
                        yield pa.record_batch([pa.array(_anchor_bytes(data, place, gram).tolist(), pa.binary())], names=["word"])
                        break

    return run


def _single_windows(part: int, held: list[tuple[np.ndarray, ...]], n_to: int, length: int) -> list[tuple[int, int, tuple]]:
    """Windows of hot anchors, by their digests; those that the part has earlier are told at once."""
    high, low, ids, row, start = (np.concatenate(x) for x in zip(*held))
    later = _later((start, row, ids), high, low)
    rows = [(part % n_to, part, ("spans", *_runs(row[later], start[later], length)))]
    high, low, ids, row, start = (x[~later] for x in (high, low, ids, row.astype(np.int32), start))
    for k, r in _by_receiver((high % np.uint64(n_to)).astype(np.int64)):
        rows.append((k, part, ("windows", high[r], low[r], ids[r], row[r], start[r])))
    return rows


def _send_suffixes(files: list[str], splitters: np.ndarray, n_to: int, length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, replies in _received(batches).items():
            repeated, hot = (np.concatenate([x[k] for _, x in replies]) for k in range(2))
            by = np.argsort(repeated)
            repeated, hot = repeated[by], hot[by]
            held: list[tuple[np.ndarray, ...]] = []
            single: list[tuple[np.ndarray, ...]] = []
            for row, ids, data, starts in _Part(files[part]).blocks():
                place, value, first, last = anchors(data, starts, length, gram)
                at = np.minimum(np.searchsorted(repeated, value), len(repeated) - 1)
                own = np.flatnonzero(repeated[at] == value)
                if not len(own):
                    continue
                if (often := hot[at[own]]).any():
                    x = _ragged(first[own[often]], last[own[often]] - first[own[often]] + 1)
                    doc = np.searchsorted(starts, x, "right") - 1
                    single.append((gram_hashes(data, length)[x], gram_hashes(data, length, _BASE_2)[x], ids[doc], row + doc, x - starts[doc]))
                    own = own[~often]
                    if not len(own):
                        continue
                place, first, last = place[own], first[own], last[own]
                doc = np.searchsorted(starts, place, "right") - 1
                lens = last - first + length
                word = _anchor_bytes(data, place, gram)
                held.append((word, ids[doc], row + doc, place - starts[doc], place - last, place - first, lens, data[_ragged(first, lens)]))
            if single:
                yield _packed(_single_windows(part, single, n_to, length))
            if not held:
                continue
            word, ids, row, place, low, high, lens, flat = (np.concatenate(x) for x in zip(*held))
            del held
            # equal surroundings within the part are merged: one is sent, with the places of the others
            cls = _equal_runs(lens, flat, low, high)
            rank = np.lexsort((place, row, ids))
            head = np.full(cls.max() + 1, -1, np.int64)
            head[cls[rank[::-1]]] = rank[::-1]  # the first of each class
            twins = np.flatnonzero(head[cls] != np.arange(len(cls)))
            new = np.full(len(cls), -1, np.int64)
            rows = []
            begin = np.cumsum(lens) - lens
            to = np.searchsorted(splitters, word[head], "right")
            twin_to = to[cls[twins]]
            twins_of = dict(_by_receiver(twin_to))
            for k, of in _by_receiver(to):
                send = head[of]
                new[send] = np.arange(len(send))
                t = twins[twins_of[k]] if k in twins_of else twins[:0]
                rows.append((k, part, ("suffixes", ids[send], row[send].astype(np.int32), place[send], low[send].astype(np.uint8), high[send].astype(np.uint8), flat[_ragged(begin[send], lens[send])], row[t].astype(np.int32), place[t], low[t].astype(np.uint8), high[t].astype(np.uint8))))
            yield _packed(rows)

    return run


def _equal_runs(lens: np.ndarray, flat: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Class of each byte string (with its bounds): equal classes are equal strings."""
    offsets = np.append(0, np.cumsum(lens))
    # Arrow tells equal strings apart by their bytes
    strings = pa.Array.from_buffers(pa.large_binary(), len(lens), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat))])
    kind = strings.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return np.unique((kind << 20) | (low << 10) | high, return_inverse=True)[1]


def _compare(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for to, received in _received(batches).items():
            spans: dict[int, list[tuple]] = defaultdict(list)
            for s, x in received:
                if x[0] == "spans":
                    spans[s].append(x[1:])
            if single := [(s, x[1:]) for s, x in received if x[0] == "windows"]:
                sender = np.repeat([s for s, _ in single], [len(x[0]) for _, x in single])
                high, low, ids, row, place = (np.concatenate([x[k] for _, x in single]) for k in range(5))
                later = np.flatnonzero(_later((place, row, sender, ids), high, low))
                for k, r in _by_receiver(sender[later]):
                    spans[k].append(_runs(row[later[r]], place[later[r]], length))
            got = [(s, x[1:]) for s, x in received if x[0] == "suffixes"]
            if got:
                sender = np.repeat([s for s, _ in got], [len(x[0]) for _, x in got])
                ids, row, place, low, high, flat = (np.concatenate([x[k] for _, x in got]) for k in range(6))
                low, high = low.astype(np.int64), high.astype(np.int64)
                rank = np.empty(len(ids), np.int64)
                rank[np.lexsort((place, row, sender, ids))] = np.arange(len(ids))
                rows = _surroundings(high - low + length, flat, high, length, gram)
                least, most = first_and_repeats(rows, low, high, rank, length, gram)
                hit = np.flatnonzero(most >= 0)
                for k, r in _by_receiver(sender[hit]):
                    spans[k].append((row[hit[r]], place[hit[r]] - most[hit[r]], place[hit[r]] - least[hit[r]] + length))
            for s, x in got:  # places whose whole surroundings their part had already
                if len(x[6]):
                    spans[s].append((x[6], x[7] - x[9], x[7] - x[8] + length))
            if spans:
                yield _packed([(k, to, tuple(np.concatenate(c) for c in zip(*v))) for k, v in spans.items()])

    return run


def _cut(files: list[str], with_text: bool, with_carried: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, list] = defaultdict(list)
        parts: list[int] = []
        for batch in batches:
            for to, payload in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if payload is None:
                    parts.append(to)
                else:
                    got[to].append(pickle.loads(payload))
        for part in parts:
            spans = [np.concatenate(c) for c in zip(*got[part])] if got[part] else [np.zeros(0, np.int64)] * 3
            by = np.lexsort((spans[1], spans[0]))
            row, begin, end = (x[by].astype(np.int64) for x in spans)
            for first, ids, data, starts, carried in _Part(files[part]).carrying(with_carried):
                n = len(ids)
                bounds = np.searchsorted(row, np.arange(first, first + n + 1)).tolist()
                out: list[list] = [[] for _ in range(6)]
                for k in range(n):
                    text = data[starts[k] : starts[k + 1]].tobytes()
                    a, b = bounds[k], bounds[k + 1]
                    merged: list[list[int]] = []
                    for s, e in zip(begin[a:b].tolist(), end[a:b].tolist()):
                        if merged and s <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], e)
                        else:
                            merged.append([s, e])
                    kept, at = [], 0
                    for s, e in merged:
                        kept.append(text[at:s])
                        at = e
                    whole = b"".join([*kept, text[at:]])
                    for c, v in zip(out, (len(text), len(text) - len(whole), len(merged), hashlib.sha256(whole).hexdigest(), whole, [x for m in merged for x in m])):
                        c.append(v)
                columns = [ids, pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3])]
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                if with_text:
                    texts = [x.decode("utf-8", "ignore") for x in out[4]]
                    columns += [pa.array(out[4], pa.binary()), pa.array(texts), pa.array(out[5], pa.list_(pa.int64()))]
                    names += ["kept", "kept_text", "spans"]
                if with_carried:
                    columns.append(carried)
                    names.append("carried")
                yield pa.record_batch(columns, names=names)

    return run


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, with_text: bool = False, carry: tuple[str, ...] = (), hot_share: float = HOT_SHARE) -> DataFrame:
    """One row for each document: what is removed and the digest of the rest (``RESULT``);
    ``with_text`` adds the kept bytes, the text of them (without what is left of characters
    that were cut through) and the removed spans (starts and ends in turn)."""
    spark = docs.sparkSession
    folder = work_dir(spark, "suffix-dedup")
    carried = [F.struct(*carry).alias("carried")] if carry else []
    docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *carried).write.option("compression", "zstd").parquet(f"{folder}/texts")
    files = sorted(spark.read.parquet(f"{folder}/texts").inputFiles())
    n_parts, n_to = max(1, len(files)), shuffle_partitions(spark)
    parts = spark.createDataFrame(list(enumerate(files)), "part int, file string").repartitionById(n_parts, "part")
    most = max(1, SAMPLES_A_RANGE * n_to // n_parts)
    words = np.sort(np.array([r.word for r in parts.mapInArrow(_sample_words(length, gram, most), "word binary").collect()], f"S{gram}"))
    splitters = np.unique(words[np.linspace(0, len(words) - 1, n_to + 1).astype(int)[1:-1]]) if len(words) else words
    asked = parts.mapInArrow(lean(_send_hashes(length, gram, n_to)), _PACK).repartitionById(n_to, "to")
    repeated = asked.mapInArrow(lean(_return_repeated(hot_share)), _PACK).repartitionById(n_parts, "to")
    suffixes = repeated.mapInArrow(lean(_send_suffixes(files, splitters, n_to, length, gram)), _PACK).repartitionById(n_to, "to")
    spans = suffixes.mapInArrow(lean(_compare(length, gram)), _PACK)
    asks = parts.select(F.col("part").alias("to"), F.lit(0).alias("sender"), F.lit(None).cast("binary").alias("payload"))
    schema = RESULT_WITH_TEXT if with_text else RESULT
    if carry:
        schema += f", carried {docs.select(carried).schema['carried'].dataType.simpleString()}"
    return spans.unionByName(asks).repartitionById(n_parts, "to").mapInArrow(lean(_cut(files, with_text, bool(carry))), schema)
