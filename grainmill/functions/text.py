"""Text measures, single pattern edits, tokens."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# letters, marks, decimal digits, connectors: one word character, in Java and in RE2 alike
WORD_CHAR = r"[\p{L}\p{M}\p{Nd}\p{Pc}]"
# a word may hold apostrophes between word characters
WORD = rf"{WORD_CHAR}+(?:'{WORD_CHAR}+)*"

# fixed values: link patterns of the two feature sets
LINK_PLAIN = "http://"
LINK_ANY = "https?://"


def count_matches(col: Column, pattern: str) -> Column:
    return F.regexp_count(col, F.lit(pattern))


def count_words(col: Column) -> Column:
    return count_matches(col, f"{WORD_CHAR}+")


def has_match(col: Column, pattern: str) -> Column:
    """1.0 / 0.0, null for missing text."""
    return col.rlike(pattern).cast("double")


def remove_first(col: Column, pattern: str) -> Column:
    return replace_first(col, pattern, "")


def replace_first(col: Column, pattern: str, by: str) -> Column:
    """Changes the first match only: the lazy head keeps everything before it. `pattern` is anchored by
    the head at the text start, so later matches are out of reach."""
    return F.regexp_replace(col, rf"\A((?s:.*?))(?:{pattern})", "$1" + re.sub(r"([\\$])", r"\\\1", by))


def remove_all(col: Column, pattern: str) -> Column:
    return F.regexp_replace(col, pattern, "")


def replace_all(col: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(col, pattern, by)


def ascii_fold(col: Column) -> Column:
    """Every character outside ASCII becomes a space."""
    return F.regexp_replace(col, r"[^\x00-\x7F]", " ")


def squish(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, r"\s+", " "))


def any_word(words: Iterable[str]) -> str:
    """Alternation of literal words, the longer of two words with a common start first."""
    return "|".join(re.escape(w) for w in sorted(words, reverse=True))


def word_tree(words: Iterable[str]) -> str:
    """Pattern for any of the words with shared beginnings written once, so that a text position is tried
    against a few letters instead of the whole list. The longest word that fits is taken."""
    tree: dict = {}
    for word in set(words):
        node = tree
        for letter in word:
            node = node.setdefault(letter, {})
        node[""] = {}

    def write(node: dict) -> str:
        branches = [re.escape(k) + write(v) for k, v in sorted(node.items()) if k]
        if not branches:
            return ""
        group = f"(?:{'|'.join(branches)})"
        return group + "?" if "" in node else group

    return write(tree)


def remove_words(col: Column, words: Iterable[str]) -> Column:
    """Deletes whole-word matches; the blanks around them stay."""
    return F.regexp_replace(col, rf"(?U)\b{word_tree(words)}\b", "") if words else col


def remove_punctuation(col: Column) -> Column:
    """Deletes ASCII punctuation."""
    return F.regexp_replace(col, r"\p{Punct}", "")


def punctuation_to_space(col: Column) -> Column:
    return F.regexp_replace(col, r"[\p{P}\p{S}]", " ")


def non_alnum_to_space(col: Column) -> Column:
    return F.regexp_replace(col, r"[^\p{L}\p{Nd}]", " ")


def drop_short_words(col: Column, longest: int) -> Column:
    """Lower-case words of up to `longest` ASCII letters become a space."""
    return F.regexp_replace(col, rf"\b[a-z]{{1,{longest}}}\b", " ")


def distinct_pieces(col: Column) -> Column:
    """Number of distinct pieces between single spaces; an empty piece counts."""
    return F.size(F.array_distinct(F.split(col, " ", -1)))


def keyword_hit(col: Column, words: Iterable[str]) -> Column:
    """1 if any of the words or phrases occurs anywhere in the text, else 0."""
    return col.rlike(any_word(words)).cast("int")


def tokens(col: Column) -> Column:
    """Array of lower-cased words."""
    return F.regexp_extract_all(F.lower(col), F.lit(WORD), F.lit(0))


def ngrams(words: Column, n: int = 2) -> Column:
    """Array of runs of `n` neighbouring words; empty for shorter texts."""
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1)))
    runs = F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))
    return F.coalesce(runs, F.array().cast("array<string>"))


#: Names of the features below, in order.
TEXT_FEATURES = [
    "character_count", "hashtag_count", "has_hashtag", "mention_count", "has_mention", "link_count", "has_link", "word_count",
    "unique_words",
]


def text_features(text: str = "text") -> dict[str, Column]:
    """The nine numeric features of a text column."""
    c = F.col(text)
    return {
        "character_count": F.char_length(c),
        "hashtag_count": count_matches(c, "#"),
        "has_hashtag": has_match(c, "#"),
        "mention_count": count_matches(c, "@"),
        "has_mention": has_match(c, "@"),
        "link_count": count_matches(c, LINK_ANY),
        "has_link": has_match(c, LINK_ANY),
        "word_count": count_words(c),
        "unique_words": distinct_pieces(c),
    }
