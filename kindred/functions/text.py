"""Text views as column expressions; Python only where Spark has no equivalent."""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LATIN = [chr(c) for c in range(0xC0, 0x250) if len(d := unicodedata.normalize("NFD", chr(c))) > 1 and d[0].isascii() and all(unicodedata.category(x) == "Mn" for x in d[1:])]
_BASES = "".join(unicodedata.normalize("NFD", c)[0] for c in _LATIN)

# Legal forms and general business words, which say nothing about which business is meant.
GENERIC_WORDS = tuple(
    """
llc inc ltd pvt private limited corp corporation co company companies
sarl sas sasu eurl sa sci snc selarl scop llp lp plc gmbh the and et
de la le les du des of group holding holdings services service center
centre international india industries enterprises partners associates
mr mrs smt shri sri dr ms m s dba formerly known as
""".split()
)


def is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.length(c)


def squeeze(c: Column) -> Column:
    """Everything but letters, digits and marks becomes single blanks."""
    return F.trim(F.regexp_replace(c, r"[^\p{L}\p{N}\p{M}]+", " "))


@F.pandas_udf(T.StringType())
def _folded(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).casefold())


def latin_fold(c: Column) -> Column:
    """Drops accents of Latin letters; marks of other scripts stay."""
    return F.when(is_ascii(c), c).otherwise(F.regexp_replace(F.translate(c, "".join(_LATIN), _BASES), r"(?<=[A-Za-z0-9])[̀-ͯ]+", ""))


def tokens(c: Column, least: int = 2) -> Column:
    return F.filter(F.split(c, " "), lambda t: F.length(t) >= least)


def trigrams(c: Column) -> Column:
    """Each three neighbouring characters of words of at least four, in order."""
    return F.regexp_extract_all(c, F.lit(r"(?=([^ ]{3}))(?:(?<=[^ ])|(?=[^ ]{4}))"), F.lit(1))


@functools.lru_cache(1 << 17)
def _word_trigrams(word: str) -> tuple[str, ...]:
    return tuple(word[i : i + 3] for i in range(len(word) - 2))


def _grams(word: str) -> Iterable[str]:
    return _word_trigrams(word) if len(word) <= 40 else (word[i : i + 3] for i in range(len(word) - 2))


_ACCENTS = dict(zip(map(ord, _LATIN), _BASES, strict=True))
_MARKS = re.compile("(?<=[A-Za-z0-9])[\u0300-\u036f]+")


def fold_word(word: str) -> str:
    """latin_fold() of a word."""
    return word if word.isascii() else _MARKS.sub("", word.translate(_ACCENTS))


def text_terms(norm: str) -> list[str]:
    """The different words of at least two characters and trigrams of a text, and the trigrams of its folded view, sorted."""
    words = set(norm.split(" "))
    out = {w for w in words if len(w) >= 2}
    for w in words:
        if len(w) >= 4:
            out.update(_grams(w))
        if not w.isascii() and len(w) >= 4 and (f := fold_word(w)) != w and len(f) >= 4:
            out.update(_grams(f))
    return sorted(out)


@F.arrow_udf(T.ArrayType(T.StringType()))
def _terms(norm: pa.Array) -> pa.Array:
    kind, out = pa.list_(pa.string()), []
    for k in range(0, len(norm), 256):  # lists of Python's strings take many times their bytes
        out.append(pa.array([None if n is None else text_terms(n) for n in norm[k : k + 256].to_pylist()], kind))
    return pa.concat_arrays(out) if out else pa.array([], kind)


def merged_terms(norm: Column) -> Column:
    """Words and trigrams of a normalised view and of its fold. A fold is that of its words, and only a text's different words
    are looked at: a regular expression at all places and a sort of what it finds took most of the time of retrieval."""
    return _terms(norm)


def is_indic(c: Column) -> Column:
    return c.rlike(r"[ऀ-෿]")


def numbers(c: Column) -> Column:
    """Digit runs without leading zeros."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"\d+"), F.lit(0)), lambda n: F.regexp_replace(n, "^0+(?=.)", ""))


def numeric_tokens(c: Column) -> Column:
    return F.array_distinct(F.filter(tokens(c), lambda t: t.rlike(r"\d")))


def token_set(c: Column) -> Column:
    return F.array_distinct(tokens(c))


def core_tokens(c: Column) -> Column:
    return F.array_except(token_set(c), F.array(*[F.lit(w) for w in GENERIC_WORDS]))


# Spellings of one sound, replaced in this order, then letters that merge.
DIGRAPHS = (("ph", "p"), ("sh", "s"), ("ch", "k"), ("th", "t"), ("dh", "d"), ("bh", "b"), ("kh", "k"), ("gh", "g"), ("jh", "j"))
MERGED, INTO = "cqwzxfbdg", "kkvjkpptk"


def skeleton_token(t: Column) -> Column:
    """Consonant skeleton: like sounds merge, vowels after the head and repeats go."""
    for a, b in DIGRAPHS:
        t = F.replace(t, F.lit(a), F.lit(b))
    t = F.translate(t, MERGED, INTO)
    t = F.concat(F.substring(t, 1, 1), F.regexp_replace(F.substring(t, 2, 1 << 20), "[aeiouyh]", ""))
    return F.regexp_replace(t, r"(.)\1+", "$1")


def skeletons(c: Column) -> Column:
    """Skeletons of the words of a view in Latin letters."""
    return skeletons_of(F.split(c, " "))


def skeletons_of(words: Column) -> Column:
    return F.filter(F.transform(words, skeleton_token), lambda t: t != "")


# Latin spelling by the offset in a block of 128 signs; the blocks follow one layout.
VOWELS = {0x05: "a", 0x06: "aa", 0x07: "i", 0x08: "i", 0x09: "u", 0x0A: "u", 0x0B: "ri", 0x0E: "e", 0x0F: "e", 0x10: "ai", 0x12: "o", 0x13: "o", 0x14: "au"}
CONSONANTS = {
    0x15: "k", 0x16: "kh", 0x17: "g", 0x18: "gh", 0x19: "n", 0x1A: "ch", 0x1B: "chh", 0x1C: "j", 0x1D: "jh", 0x1E: "n", 0x1F: "t", 0x20: "th",
    0x21: "d", 0x22: "dh", 0x23: "n", 0x24: "t", 0x25: "th", 0x26: "d", 0x27: "dh", 0x28: "n", 0x29: "n", 0x2A: "p", 0x2B: "ph", 0x2C: "b",
    0x2D: "bh", 0x2E: "m", 0x2F: "y", 0x30: "r", 0x31: "r", 0x32: "l", 0x33: "l", 0x34: "l", 0x35: "v", 0x36: "sh", 0x37: "sh", 0x38: "s", 0x39: "h",
}
SIGNS = {0x3E: "a", 0x3F: "i", 0x40: "i", 0x41: "u", 0x42: "u", 0x43: "ri", 0x46: "e", 0x47: "e", 0x48: "ai", 0x4A: "o", 0x4B: "o", 0x4C: "au"}
NASALS = {0x01: "n", 0x02: "n", 0x03: "h"}
VIRAMA, NUKTA, ZERO = 0x4D, 0x3C, 0x66


def _class(offsets) -> str:
    return "".join(chr(0x900 + 0x80 * block + k) for block in range(9) for k in offsets)


_INDIC = re.compile("[\u0900-\u0dff]")
_SYLLABLE = re.compile(f"([{_class(CONSONANTS)}])[{_class([NUKTA])}]*([{_class([*SIGNS, VIRAMA])}])?|[\u0900-\u0d7f]")
_SILENT = re.compile(f"[^\u0900-\u0d7f{_class([NUKTA])}]|[{_class([*NASALS, NUKTA])}]|$")


def transliterate_text(text: str) -> str:
    """Latin spelling of Indic letters, a syllable at a time; other characters stay.

    A consonant is followed by its sign's vowel; without a sign by `a`, but not before a virama, a nasal
    or the end of the word.
    """

    def latin(m: re.Match) -> str:
        k = (ord(m[0][0]) - 0x900) % 0x80
        if m[1]:
            if m[2]:
                return CONSONANTS[k] + SIGNS.get((ord(m[2]) - 0x900) % 0x80, "")
            return CONSONANTS[k] + ("" if _SILENT.match(text, m.end()) else "a")
        return VOWELS.get(k) or SIGNS.get(k) or NASALS.get(k) or (str(k - ZERO) if ZERO <= k < ZERO + 10 else "")

    return _SYLLABLE.sub(latin, text)


@F.pandas_udf(T.StringType())
def _latin(s: pd.Series) -> pd.Series:
    return s.map(lambda x: transliterate_text(x) if x and _INDIC.search(x) else x)


def latin_view(norm: Column) -> Column:
    """A normalised view in Latin letters."""
    return _latin(norm)


def with_views(df: DataFrame, **raw: str) -> DataFrame:
    """Adds for each new=column the views new_norm (NFKC, case folded, squeezed) and new_latin (that in Latin letters).
    Rows of ASCII alone never leave the JVM."""
    plain = is_ascii(F.concat(F.lit(""), *[F.coalesce(c, F.lit("")) for c in raw.values()]))
    short = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))  # noqa: E731  # squeeze() of ASCII
    fast = df.where(plain).withColumns({f"{n}_norm": short(F.col(c)) for n, c in raw.items()}).withColumns({f"{n}_latin": F.col(f"{n}_norm") for n in raw})
    slow = df.where(~plain).withColumns({f"{n}_norm": squeeze(_folded(F.col(c))) for n, c in raw.items()}).withColumns({f"{n}_latin": _latin(F.col(f"{n}_norm")) for n in raw})
    return fast.unionByName(slow)
