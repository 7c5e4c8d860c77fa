"""Exact ids of a word-end BPE tokenizer file, fast over Arrow batches, in bounded memory.

The tokenizer's model is asked once for each different word while it is remembered; words are found by
array operations on the bytes, looked up by a hash and then compared, so no two words are confused. This
path takes texts of ASCII and the letters of the Latin-1 block, for which NFC changes nothing and
lower-casing is a fixed shift. Any other text, texts that hold the string of a special token, and texts
with very long words go through the tokenizer itself, cut where no token can cross.

Memory: a batch is worked off in slices of SLICE bytes and pieces of PIECE bytes; what is remembered is
bounded by MEMO words, IDS ids and LONG_BYTES bytes of long words, and forgotten as a whole beyond. Only
a single word in which every two neighbouring bytes may share a token is tokenised in one go, whatever its length.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .textfeat import buffers, ends_hash, pieces, runs, word_ends

SPACE, LETTER, DIGIT, OTHER = 0, 1, 2, 3
_b = np.arange(256)
_letter = ((_b | 32) >= 97) & ((_b | 32) <= 122) & (_b < 128) | (_b >= 128)
_digit = (_b >= 48) & (_b <= 57)
_space = (_b >= 9) & (_b <= 13) | (_b == 32)
CLASS = np.where(_space, SPACE, np.where(_letter, LETTER, np.where(_digit, DIGIT, OTHER))).astype(np.uint8)
#: Control characters that some regex dialects take for white space.
_odd = (_b < 32) & ~_space
_upper = (_b >= 65) & (_b <= 90)
SLICE, PIECE = 1 << 22, 1 << 20
#: Bytes without white space that the fast path takes, and characters that the tokenizer gets at once.
GAP, PART = 1 << 16, 1 << 14
#: What is remembered at most: words, their ids, bytes of words of over 16 bytes.
MEMO, IDS, LONG_BYTES = 600_000, 4_000_000, 1 << 23
SLOTS = 1 << 20
_BLANK = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_BLANKS = re.compile(f"[{_BLANK}]+")
#: Between these signs and a letter no token, composition or contraction crosses.
_CUT = re.compile(r"(?<=[\s.,;:!?。，、！？；：])(?=[^\W\d_])")


def byte_chars() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class WordBpe:
    """encode() gives the ids of every text of a string column, as the tokenizer file defines them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.chars = byte_chars()
        self.special = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        self.apart = re.compile(b"|".join(map(re.escape, self.special)).decode().join("()"))
        self.joined: np.ndarray | None = None
        self._forget()

    def _forget(self, words: int = 0) -> None:
        """Forget all; the table gets room for so many words at half its load."""
        self.slots = max(SLOTS, 1 << (2 * words).bit_length())
        self.shift = np.uint64(64 - self.slots.bit_length() + 1)
        self.known = self.n = self.long_bytes = 0
        self.hashes, self.numbers = np.zeros(self.slots, np.uint64), np.zeros(self.slots, np.int32)
        self.flat, self.long = np.zeros(1 << 16, np.uint32), {}
        self._resize(1 << 14)

    def _resize(self, n: int) -> None:
        old = self.__dict__
        for name, kind in (("head", np.uint64), ("tail", np.uint64), ("size", np.int32), ("first", np.int32), ("count", np.int32)):
            new = np.zeros(n, kind)
            if self.known:
                new[: self.known] = old[name][: self.known]
            old[name] = new

    def _probe(self, h: np.ndarray) -> np.ndarray:
        """The number under each hash, -1 where there is none: open addressing, all at once."""
        slot = (h >> self.shift).astype(np.int64)
        out = np.where(self.hashes[slot] == h, self.numbers[slot], -1)
        todo = np.flatnonzero((out < 0) & (self.hashes[slot] != 0))
        while len(todo):  # the table is half empty, so this ends
            slot[todo] = (slot[todo] + 1) % self.slots
            have = self.hashes[slot[todo]]
            hit = have == h[todo]
            out[todo[hit]] = self.numbers[slot[todo[hit]]]
            todo = todo[~hit & (have != 0)]
        return out

    def _find(self, words: tuple, low: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(number of each word or -1, whether another word stands under its hash)."""
        h, head, tail, size, s, e = words
        out = self._probe(h)
        at = np.maximum(out, 0)
        same = (self.head[at] == head) & (self.tail[at] == tail) & (self.size[at] == size)
        for i in np.flatnonzero(same & (size > 16) & (out >= 0)):
            same[i] = self.long[int(out[i])] == low[s[i] : e[i]]
        other = (out >= 0) & ~same
        return np.where(other, -1, out), other

    def _number(self, words: tuple, which: np.ndarray, low: bytes) -> int:
        """Tokenise the words `which` and number them; the first number."""
        _, head, tail, size, s, e = words
        ids, lens, base = [], [], self.known
        for a, b in zip(s[which].tolist(), e[which].tolist(), strict=True):
            t = self._word(low[a:b])
            ids += t
            lens.append(len(t))
            if b - a > 16:
                self.long[base + len(lens) - 1] = low[a:b]
                self.long_bytes += b - a
        to = base + len(which)
        if to > len(self.first):
            self._resize(2 * to)
        if self.n + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.n], np.zeros(self.n + 2 * len(ids), np.uint32)])
        self.head[base:to], self.tail[base:to], self.size[base:to] = head[which], tail[which], size[which]
        self.first[base:to], self.count[base:to] = self.n + np.cumsum(lens) - lens, lens
        self.flat[self.n : self.n + len(ids)] = ids
        self.known, self.n = to, self.n + len(ids)
        return base

    def _learn(self, words: tuple, which: np.ndarray, low: bytes) -> None:
        """Number words, each with another hash, and enter them."""
        h = words[0][which]
        numbers = self._number(words, which, low) + np.arange(len(which))
        slot, todo = (h >> self.shift).astype(np.int64), np.arange(len(h))
        while len(todo):
            free = np.flatnonzero(self.hashes[slot[todo]] == 0)
            _, one = np.unique(slot[todo[free]], return_index=True)
            put = todo[free[one]]
            self.hashes[slot[put]], self.numbers[slot[put]] = h[put], numbers[put]
            todo = np.setdiff1d(todo, put, assume_unique=True)
            slot[todo] = (slot[todo] + 1) % self.slots

    def _word(self, w: bytes) -> list[int]:
        if len(w) > GAP:
            return [x for part in self._word_parts(w) for x in part]
        return [x.id for x in self.model.tokenize(w.decode() if w.isascii() and w.isalnum() else "".join([self.chars[x] for x in w]))]

    def _word_parts(self, w: bytes) -> Iterator[list[int]]:
        """Ids of a very long word, cut between bytes that stand side by side in no token. What follows a
        cut is kept off the word's end by a byte that no text holds."""
        if self.joined is None:
            back = {c: i for i, c in enumerate(self.chars)}
            self.joined = np.zeros((256, 256), bool)
            for token in self.tok.get_vocab():
                b = [back.get(c, 0) for c in token.removesuffix("</w>")]
                self.joined[b[:-1], b[1:]] = True
        guard = int(np.flatnonzero(~self.joined.any(0) & (_b >= 0xF8))[0])
        x = np.frombuffer(w, np.uint8)
        at, spell = 0, lambda a, b: "".join([self.chars[y] for y in w[a:b]])
        while len(w) - at > PART:
            to = at + PART
            while to < len(w):
                cuts = np.flatnonzero(~self.joined[x[to - 1 : to + GAP - 1][: len(x) - to], x[to : to + GAP]])
                if len(cuts):
                    to += int(cuts[0])
                    break
                to = min(to + GAP, len(w))
            if to >= len(w):
                break
            yield [t.id for t in self.model.tokenize(spell(at, to) + self.chars[guard])][:-1]
            at = to
        yield [t.id for t in self.model.tokenize(spell(at, len(w)))]

    def _plain(self, off: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Which texts the fast path may take."""
        ok = np.ones(len(off) - 1, bool)
        most = max(map(len, self.special), default=1)
        for a in range(int(off[0]), int(off[-1]), PIECE):
            buf = data[a : min(a + PIECE + most, int(off[-1]))]
            lead = np.zeros(len(buf), bool)
            lead[1:] = buf[:-1] == 0xC3
            lead[0] = a > off[0] and data[a - 1] == 0xC3
            bad = _odd[buf] | ((buf >= 128) & (buf != 0xC3) & ~lead) | (lead & ((buf == 0x97) | (buf == 0xB7)))
            ok[np.searchsorted(off, np.flatnonzero(bad) + a, "right") - 1] = False
            whole = buf.tobytes()
            for s in self.special:
                at = whole.find(s)
                while at >= 0:
                    ok[np.searchsorted(off, at + a, "right") - 1] = False
                    at = whole.find(s, at + 1)
        for r in np.flatnonzero(ok & (off[1:] - off[:-1] > GAP)):
            x = np.flatnonzero(_space[data[off[r] : off[r + 1]]])
            ok[r] = np.diff(np.concatenate([[-1], x, [off[r + 1] - off[r]]])).max() <= GAP
        return ok

    def _split(self, low: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word spans: letters together, digits alone, other signs together, contractions as one."""
        cls = CLASS[low]
        digits = np.flatnonzero(cls == DIGIT)
        s, e = runs(cls, np.unique(np.concatenate([begins, digits])))
        keep = cls[s] != SPACE
        s, e = s[keep], e[keep]
        quote = np.flatnonzero((low[s] == 39) & (e - s == 1) & (cls[s] == OTHER))
        quote = quote[quote + 1 < len(s)]
        quote = quote[(s[quote + 1] == e[quote]) & (cls[s[quote + 1]] == LETTER)]
        if len(begins) > 1 and len(quote):
            quote = quote[~np.isin(s[quote + 1], begins)]
        if len(quote):
            at, pad = s[quote + 1], np.concatenate([low, [0, 0]])
            a, b = pad[at], np.where(e[quote + 1] - at > 1, pad[at + 1], 0)
            one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
            two = ((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108)
            take = np.where(one, 1, np.where(two, 2, 0))
            e[quote] += take
            s[quote + 1] += take
            keep = s < e
            s, e = s[keep], e[keep]
        return s, e

    def _numbered(self, low: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """The number of each word of a piece."""
        whole = low.tobytes()
        head, tail, size = word_ends(low, s, e)
        h = ends_hash(head, tail, size)
        if len(long := np.flatnonzero(size > 16)):
            from xxhash import xxh64_intdigest

            h[long] = [xxh64_intdigest(whole[a:b]) for a, b in zip(s[long].tolist(), e[long].tolist(), strict=True)]
        words = (h | np.uint64(1), head, tail, size, s, e)
        if self.n > IDS or self.long_bytes > LONG_BYTES:
            self._forget()
        word, other = self._find(words, whole)
        new = np.flatnonzero((word < 0) & ~other)
        if len(new):
            _, one = np.unique(words[0][new], return_index=True)
            if self.known + len(one) > min(MEMO, self.slots // 2):
                self._forget(len(s))
                new, word[:], other[:] = np.arange(len(s)), -1, False
                _, one = np.unique(words[0], return_index=True)
            self._learn(words, new[one], whole)
            word[new], other[new] = self._find(tuple(x[new] for x in words), whole)
        if len(left := np.flatnonzero(other)):  # words whose hash another word has
            word[left] = self._number(words, left, whole) + np.arange(len(left))
        return word

    def _fast(self, off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many for each text) of plain texts."""
        lens, out = np.zeros(len(off) - 1, np.int64), [np.zeros(0, np.uint32)]
        for which, begins, buf in pieces(off, data, PIECE):
            low = np.where(_upper[buf], buf + 32, buf).astype(np.uint8)
            lead = np.zeros(len(low), bool)
            lead[1:] = low[:-1] == 0xC3
            low[lead & (low >= 0x80) & (low <= 0x9E)] += 0x20
            s, e = self._split(low, begins)
            if not len(s):
                continue
            word = self._numbered(low, s, e)
            many = self.count[word].astype(np.int64)
            row = np.searchsorted(begins, s, "right") - 1
            lens[which] += np.bincount(row, many, len(which)).astype(np.int64)
            src = np.repeat(self.first[word] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            out.append(self.flat[src])
        return np.concatenate(out), lens

    def _slow(self, text: str) -> np.ndarray:
        """Ids of any text: parts of about PART characters, cut where nothing crosses, by the tokenizer itself."""
        out = [np.zeros(0, np.uint32)]
        ask = lambda t: np.array(self.tok.encode(t, add_special_tokens=False).ids, np.uint32)
        for k, run in enumerate(self.apart.split(text)):
            at = 0
            while at < len(run):
                cut = _CUT.search(run, at + PART) if len(run) - at > 2 * PART else None
                to = cut.start() if cut else len(run)
                part, at = run[at:to], to
                if k % 2 or len(part) <= 4 * GAP:
                    out.append(ask(part))
                    continue
                # No cut for long: the tokenizer's own steps, word by word.
                part = _BLANKS.sub(" ", unicodedata.normalize("NFC", part)).replace("Σ", "σ").lower()
                for w in _words().finditer(part):
                    w = w[0].encode()
                    out += [np.array(ids, np.uint32) for ids in (self._word_parts(w) if len(w) > GAP else [self._word(w)])]
        return np.concatenate(out)

    def _slice(self, off: np.ndarray, data: np.ndarray, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        plain = self._plain(off, data)
        if plain.all():
            return self._fast(off, data)
        rows = np.flatnonzero(plain)
        kept = np.concatenate([np.zeros(0, np.uint8), *[data[off[r] : off[r + 1]] for r in rows]])
        fast, lens_ = self._fast(np.concatenate([[0], np.cumsum(np.diff(off)[rows])]), kept)
        slow = {int(r): self._slow(col[int(r)].as_py()) for r in np.flatnonzero(~plain)}
        lens = np.zeros(len(plain), np.int64)
        lens[rows] = lens_
        for r, ids in slow.items():
            lens[r] = len(ids)
        ends = np.cumsum(lens)
        out = np.empty(int(ends[-1]), np.uint32)
        out[np.repeat(plain, lens)] = fast
        for r, ids in slow.items():
            out[ends[r] - len(ids) : ends[r]] = ids
        return out, lens

    def parts(self, col: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids, how many for each text) of neighbouring texts of about SLICE bytes together."""
        off, data = buffers(col)
        at = 0
        while at < len(off) - 1:
            to = max(at + 1, int(np.searchsorted(off, off[at] + SLICE, "right")) - 1)
            yield at, *self._slice(off[at : to + 1], data, col.slice(at, to - at))
            at = to

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, where each text's ids begin and end)."""
        got = list(self.parts(col))
        lens = np.concatenate([np.zeros(1, np.int64), *[n for _, _, n in got]])
        return np.concatenate([np.zeros(0, np.uint32), *[ids for _, ids, _ in got]]), np.cumsum(lens)


_open: dict[str, WordBpe] = {}


@functools.cache
def _words():
    import regex

    # Fixed value: the tokenizer file's pattern of words.
    return regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{_BLANK}\p{{L}}\p{{N}}]+")


def encoder(path: str) -> WordBpe:
    """One encoder for each file and worker; what it has learned of words stays between tasks."""
    if path not in _open:
        _open[path] = WordBpe(path)
    return _open[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
