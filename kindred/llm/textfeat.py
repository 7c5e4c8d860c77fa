"""Vectorised word segmentation and n-gram hashing straight over Arrow string buffers.

Texts are never copied into Python strings: classes, boundaries and hashes of all words of a
batch come from array operations on its bytes. Memory is bounded by pieces of ``PIECE`` bytes;
longer texts are cut at white space. Words of over 16 bytes are known by their ends and length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
SPACE, WORD, PUNCT = 0, 1, 2

_bytes = np.arange(256)
IS_SPACE = ((_bytes >= 9) & (_bytes <= 13)) | (_bytes == 32)
IS_UPPER = (_bytes >= 65) & (_bytes <= 90)
IS_DIGIT = (_bytes >= 48) & (_bytes <= 57)
IS_WORD = IS_UPPER | IS_DIGIT | ((_bytes >= 97) & (_bytes <= 122)) | (_bytes >= 128)
CLASS = np.where(IS_SPACE, SPACE, np.where(IS_WORD, WORD, PUNCT)).astype(np.uint8)
LOWERED = np.where(IS_UPPER, _bytes + 32, _bytes).astype(np.uint8)

#: 8 low bytes by how many of them count.
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_ends(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first 8 bytes, last 8 bytes, length) of each buf[start:end]; the last are 0 for up to 8 bytes.

    They tell words of up to 16 bytes apart exactly, zero bytes aside.
    """
    pad = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(buf) + 1, "<u8", pad, 0, (1,))  # the 8 bytes from each place on
    n = ends - starts
    head = eight[starts] & _MASKS[np.minimum(n, 8)]
    tail = np.where(n > 8, eight[np.maximum(ends - 8, 0)], np.uint64(0))
    return head, tail, n


def ends_hash(head: np.ndarray, tail: np.ndarray, n: np.ndarray) -> np.ndarray:
    return mix(head + n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ mix(tail * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1))


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; null texts are empty."""
    col = pa.concat_arrays(col.chunks) if isinstance(col, pa.ChunkedArray) else col
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_binary())
    _, offs, data = col.buffers()
    off = np.frombuffer(offs, np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    return off, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def pieces(off: np.ndarray, data: np.ndarray, limit: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of (rows, starts, bytes): neighbouring texts of at most `limit` bytes together, longer
    texts cut at their last white space before the limit (at the limit itself where there is none)."""
    rows, starts, begin = [], [], None
    for r, (s, e) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
        if e - s > limit or begin is not None and e - begin > limit:
            if rows:
                yield np.array(rows), np.array(starts) - begin, data[begin:s]
            rows, starts, begin = [], [], None
        while e - s > limit:
            space = np.flatnonzero(IS_SPACE[data[s : s + limit]])
            to = s + (int(space[-1]) + 1 if len(space) else limit)
            yield np.array([r]), np.zeros(1, np.int64), data[s:to]
            s = to
        if e > s:
            begin = s if begin is None else begin
            rows.append(r)
            starts.append(s)
            end = e
    if rows:
        yield np.array(rows), np.array(starts) - begin, data[begin:end]


def runs(cls: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of one class that no text boundary crosses."""
    edge = np.empty(len(cls), bool)
    edge[0] = True
    np.not_equal(cls[1:], cls[:-1], out=edge[1:])
    edge[starts] = True
    cuts = np.flatnonzero(edge)
    return cuts, np.append(cuts[1:], len(cls))


def ngram_keys(col: pa.Array, bits: int, bigrams: bool = True, shapes: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Rows and hashed features of a text column: each feature once per row, sorted by row.

    Features: words and runs of punctuation (lower case), with `bigrams` also neighbouring pairs,
    with `shapes` neighbouring pairs of word shapes (case, digits, length).
    """
    off, data = buffers(col)
    mask, out, last = np.uint64((1 << bits) - 1), [], -1
    for rows, begins, buf in pieces(off, data):
        again = rows[0] == last  # the rest of a long text
        last = rows[-1]
        cls = CLASS[buf]
        s, e = runs(cls, begins)
        keep = cls[s] != SPACE
        s, e = s[keep], e[keep]
        if not len(s):
            continue
        row = rows[np.searchsorted(begins, s, "right") - 1]
        h = ends_hash(*word_ends(LOWERED[buf], s, e))
        found = [(row, h)]
        near = row[1:] == row[:-1]
        if bigrams:
            found.append((row[1:][near], mix(h[:-1] * np.uint64(3) + h[1:])[near]))
        if shapes:
            ups = np.zeros(len(buf) + 1, np.int32)
            np.cumsum(IS_UPPER[buf], out=ups[1:])
            n, k = e - s, ups[e] - ups[s]
            shape = np.where(cls[s] == PUNCT, h, (1 + IS_DIGIT[buf[s]] + 2 * IS_UPPER[buf[s]] + 4 * ((k == n) & (n > 1)) + 8 * np.minimum(n // 4, 6)).astype(np.uint64))
            found.append((row[1:][near], mix(shape[:-1] * np.uint64(5) + shape[1:] + np.uint64(77))[near]))
        keys = np.concatenate([(r.astype(np.uint64) << np.uint64(bits)) | (x & mask) for r, x in found])
        if again and out:
            out[-1] = np.union1d(out[-1], keys)
        else:
            out.append(np.unique(keys))
    keys = np.concatenate(out) if out else np.zeros(0, np.uint64)
    return (keys >> np.uint64(bits)).astype(np.int64), (keys & mask).astype(np.int32)
