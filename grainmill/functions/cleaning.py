"""Ordered cleaning rules folded into one expression."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from grainmill.functions import text as tx

Rule = Callable[[Column], Column]

# fixed values: patterns of the cleaning rules
LINK = r"https?://\S+"
LINK_TO_LINE_END = r"https?://.+"
SPACE_CODE = "%20"
AMP = "&amp"
DIGIT = "[0-9]"
MENTION = r"@_\S+ "
MENTION_GREEDY = "@_.+ "
HASHTAG = r"#\S+"
MOJIBAKE = "\u0089[Ûû]_"


def every(pattern: str, by: str = " ") -> Rule:
    return lambda c: tx.replace_all(c, pattern, by)


def first(pattern: str) -> Rule:
    return lambda c: tx.remove_first(c, pattern)


def without(words: Sequence[str]) -> Rule:
    return lambda c: tx.remove_words(c, words)


def apply_rules(col: Column, rules: Sequence[Rule]) -> Column:
    """One expression that runs the rules in order."""
    for rule in rules:
        col = rule(col)
    return col


def rules_v1() -> list[Rule]:
    """Links, codes, non-ASCII, line breaks, digits, mentions, other signs, one-letter words."""
    return [
        F.lower,
        every(SPACE_CODE, ""),
        every(LINK),
        every(AMP),
        tx.ascii_fold,
        every("[\n\r]"),
        every(DIGIT),
        every(MENTION),
        tx.non_alnum_to_space,
        lambda c: tx.drop_short_words(c, 1),
        tx.squish,
    ]


def rules_v2(stop: Sequence[str]) -> list[Rule]:
    """v1 without hashtags, stop words and words of up to two letters."""
    return [
        F.lower,
        every(SPACE_CODE, ""),
        every(LINK),
        every(AMP),
        tx.ascii_fold,
        every("\n"),
        every(HASHTAG),
        every("\r"),
        every(DIGIT),
        every(MENTION),
        tx.non_alnum_to_space,
        without(stop),
        lambda c: tx.drop_short_words(c, 2),
        tx.squish,
    ]


def rules_v3(stop: Sequence[str]) -> list[Rule]:
    """Stop words and punctuation deleted, short words kept."""
    return [
        F.lower,
        every(LINK),
        every(AMP),
        tx.ascii_fold,
        every("\n"),
        every(HASHTAG),
        every("\r"),
        every(DIGIT),
        every(MENTION),
        without(stop),
        tx.remove_punctuation,
        tx.squish,
    ]


def rules_v3b(stop: Sequence[str]) -> list[Rule]:
    """Punctuation to spaces, stop words deleted, hashtags' words kept."""
    return [
        F.lower,
        every(SPACE_CODE, ""),
        every(LINK),
        every(AMP),
        tx.ascii_fold,
        every("[\n\r]"),
        every(DIGIT),
        every(MENTION),
        tx.punctuation_to_space,
        without(stop),
        tx.squish,
    ]


def rules_v4(stop_a: Sequence[str], stop_b: Sequence[str]) -> list[Rule]:
    """First link (to the end of its line), first code, first line break; two stop lists; punctuation."""
    return [
        F.lower,
        first(LINK_TO_LINE_END),
        first(AMP),
        first("\n"),
        first("\r"),
        first(MOJIBAKE),
        every(DIGIT),
        every(MENTION_GREEDY),
        without(stop_a),
        without(stop_b),
        tx.remove_punctuation,
        tx.squish,
    ]


def rules_for_words() -> list[Rule]:
    """Light cleaning before counting words."""
    return [
        every(LINK, ""),
        first(AMP),
        first("\n"),
        first("\r"),
        first(MOJIBAKE),
        every(DIGIT),
        every(MENTION_GREEDY),
    ]


def rules_for_bigrams(stop_a: Sequence[str], stop_b: Sequence[str]) -> list[Rule]:
    """Light cleaning before counting word pairs: first link only, stop words out of the text."""
    return [
        first(LINK),
        first(AMP),
        first("\n"),
        first("\r"),
        first(MOJIBAKE),
        every(DIGIT),
        every(MENTION_GREEDY),
        without(stop_a),
        without(stop_b),
    ]
