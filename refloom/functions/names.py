"""Keys of titles, surnames and styles; token overlap. The two title keys are different key spaces and are never compared."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words without weight in a title.
STOP_WORDS = "a an the and or of in on at to for with by from is are was were be been being have has had do does did will would could should may might shall that this these those it its our their your his her".split()
# Letters that decomposition leaves whole.
LETTERS = {"ß": "ss", "þ": "th", "ł": "l", "đ": "d", "ı": "i", "ø": "o", "æ": "ae", "œ": "oe"}


def _folded(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)))


def fold_accents(x: Column) -> Column:
    """Compatibility decomposition without combining marks. Spark has no built-in for it, so text beyond ASCII goes through Arrow;
    other rows send a null, since Spark evaluates the function for all of them."""
    beyond = x.rlike(r"[^\x00-\x7F]")
    return F.when(beyond, F.pandas_udf(_folded, "string")(F.when(beyond, x))).otherwise(x)


def _one_letter_folds() -> tuple[str, str]:
    """Characters whose decomposition without marks is one other character, by Unicode's own tables."""
    pairs = []
    for code in range(0xA0, 0x2FFF):
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(code):
            pairs.append((chr(code), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_FOLDS = _one_letter_folds()


def fold_letters(x: Column) -> Column:
    """As fold_accents, by a character table instead of Python, so it may stand inside a lambda. Characters that decompose
    into several letters (such as ligatures) stay as they are."""
    return F.regexp_replace(F.translate(x, *_FOLDS), r"\p{M}", "")


def _surname(folded: Column) -> Column:
    key = F.lower(folded)
    for a, b in LETTERS.items():
        key = F.replace(key, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(key, r"[^a-z \-]", ""))


def surname_fold(name: Column) -> Column:
    """surname_key for use inside a lambda."""
    return _surname(fold_letters(name))


def group_key(name: Column) -> Column:
    """A group's name as a key: as a surname's, without a leading "the"."""
    return F.regexp_replace(surname_fold(name), "^the ", "")


def library_title_key(title: Column) -> Column:
    """Accents folded, white space collapsed, lower case; punctuation stays."""
    return F.lower(F.trim(F.regexp_replace(fold_accents(title), r"(?U)\s+", " ")))


def fuzzy_title_key(title: Column) -> Column:
    """Letters a-z and digits only, words apart; accented letters are dropped, not folded."""
    return F.trim(F.regexp_replace(F.lower(title), "[^a-z0-9]+", " "))


def surname_key(name: Column) -> Column:
    return _surname(fold_accents(name))


def compact_surname(name: Column) -> Column:
    return F.regexp_replace(surname_key(name), r"[\s\-]", "")


def style_key(name: Column) -> Column:
    words = F.regexp_replace(F.replace(F.lower(name), F.lit("&"), F.lit(" and ")), r"[^a-z0-9]+", " ")
    return F.regexp_replace(F.trim(words), r"^the ", "")


def title_tokens(text: Column) -> Column:
    """Distinct words a-z over two letters that carry weight."""
    stop = F.array(*map(F.lit, STOP_WORDS))
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0)), lambda x: (F.length(x) > 2) & ~F.array_contains(stop, x)))


def jaccard(a: Column, b: Column) -> Column:
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0)), F.lit(0.0))
