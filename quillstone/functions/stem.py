"""Analysis of words as a full-text index does it: fold case and diacritics, then Porter's stemmer.

The stemmer follows M. F. Porter, "An algorithm for suffix stripping" (1980), with the published revisions that full-
text engines use.  It runs in one Arrow-batched function, once when an index is built; queries touch no Python.
"""

from __future__ import annotations

import functools
import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Suffixes of steps 2 to 4 and their replacements, in the order of the paper.
STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("logi", "log"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"),
    ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"),
    ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(word: str) -> str:
    """v for a vowel, c for a consonant; y is a vowel after a consonant."""
    out = []
    for i, ch in enumerate(word):
        vowel = ch in "aeiou" or ch == "y" and i > 0 and out[-1] == "c"
        out.append("v" if vowel else "c")
    return "".join(out)


def _measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _has_vowel(stem: str) -> bool:
    return "v" in _shape(stem)


def _cvc(stem: str) -> bool:
    return len(stem) > 2 and _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _swap(word: str, rules, least: int) -> str:
    """Only the longest suffix that fits is looked at, whether or not its condition holds."""
    for suffix, new in sorted(rules, key=lambda r: -len(r[0])):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            return stem + new if _measure(stem) > least else word
    return word


def porter(word: str) -> str:
    """The stem of a lower-case word; words of other letters than a-z, too short or too long ones stay."""
    if not 2 < len(word) <= 64 or not (word.isascii() and word.isalnum()):
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        for suffix in ("ed", "ing"):
            if word.endswith(suffix) and _has_vowel(word[: -len(suffix)]):
                word = word[: -len(suffix)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c" and word[-1] not in "lsz":
                    word = word[:-1]
                elif _measure(word) == 1 and _cvc(word):
                    word += "e"
                break
    if word.endswith("y") and _has_vowel(word[:-1]):
        word = word[:-1] + "i"
    word = _swap(_swap(word, STEP2, 0), STEP3, 0)
    for suffix in sorted(STEP4, key=len, reverse=True):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            if _measure(stem) > 1 and (suffix != "ion" or stem.endswith(("s", "t"))):
                word = stem
            break
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or m == 1 and not _cvc(word[:-1]):
            word = word[:-1]
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


@functools.lru_cache(maxsize=100_000)
def analyzed(word: str) -> str:
    """Case and diacritics folded, then stemmed."""
    if not word.isascii():
        word = "".join(_folded(c) for c in word)
    return porter(word.lower())


def _folded(ch: str) -> str:
    """A letter without one mark on it; letters that carry two keep them, and other scripts stay as they are."""
    parts = unicodedata.normalize("NFD", ch.lower())
    if len(parts) == 2 and unicodedata.combining(parts[1]) and unicodedata.name(ch, "").startswith("LATIN"):
        return parts[0]
    return ch.lower()


@F.arrow_udf(ArrayType(StringType()))
def _analyze(words: pa.Array) -> pa.Array:
    encoded = words.flatten().dictionary_encode()  # each different word of a batch once
    terms = pa.array((analyzed(w) for w in encoded.dictionary.to_pylist()), pa.string(), size=len(encoded.dictionary)).take(encoded.indices)
    ends = pc.cumulative_sum(pc.cast(pc.fill_null(pc.list_value_length(words), 0), pa.int32()))
    offsets = pa.concat_arrays([pa.array([0], pa.int32()), ends])
    return pa.ListArray.from_arrays(offsets, terms, mask=words.is_null() if words.null_count else None)


def analyze(token_array: Column) -> Column:
    """Token arrays to arrays of analyzed terms."""
    return _analyze(token_array)


def analyze_phrase(text: str) -> list[str]:
    """The terms of a query's phrase, on the driver."""
    out, run = [], ""
    for ch in f"{text} ":
        if unicodedata.category(ch)[0] in "LN" or unicodedata.category(ch) == "Co":
            run += ch
        elif run:
            out.append(run)
            run = ""
    return [analyzed(w.lower()) for w in out]
