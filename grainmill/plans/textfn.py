"""Text measures, pattern edits and the composite cleaning rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainmill.functions import cleaning
from grainmill.functions import text as tx
from grainmill.operators.scale import spread
from grainmill.plans.registry import query
from grainmill.plans.roles import TWEETS, tweets
from grainmill.plans.words import STOP_ENGLISH, STOP_OTHER, sql_list

_ASCII_ONLY = [w for w in STOP_ENGLISH + STOP_OTHER if w.isascii()]


def _words_sql(words):
    return "|".join(sorted(words, reverse=True))


def _sub(expr: str, pattern: str, by: str = " ", flags: str = "g") -> str:
    p, b = pattern.replace("'", "''"), by.replace("'", "''")
    return f"regexp_replace({expr}, '{p}', '{b}'{f", '{flags}'" if flags else ''})"


def _squish(expr: str) -> str:
    return f"trim({_sub(expr, chr(92) + 's+')})"


_WORD_CLASS = r"[\p{L}\p{M}\p{Nd}\p{Pc}]"


@query("str_lower", "select doc_id, lower(text) as text from documents")
def str_lower(t):
    return t.documents.select("doc_id", F.lower("text").alias("text"))


@query("str_length", "select doc_id, cast(length(text) as integer) as n_chars from documents")
def str_length(t):
    return t.documents.select("doc_id", F.char_length("text").alias("n_chars"))


@query(
    "str_count_pattern",
    f"""select doc_id, cast(len(regexp_extract_all(text, '{_WORD_CLASS}+')) as integer) as words, cast(len(regexp_extract_all(text, '#')) as integer) as hashtags,
        cast(len(regexp_extract_all(text, '@')) as integer) as mentions, cast(len(regexp_extract_all(text, 'https?://')) as integer) as links from documents""",
)
def str_count_pattern(t):
    c = F.col("text")
    return t.documents.select(
        "doc_id",
        tx.count_words(c).alias("words"),
        tx.count_matches(c, "#").alias("hashtags"),
        tx.count_matches(c, "@").alias("mentions"),
        tx.count_matches(c, tx.LINK_ANY).alias("links"),
    )


@query(
    "str_detect_flag",
    """select page_id, cast(contains(url, 'http://') as double) as plain_link, cast(regexp_matches(url, 'https?://') as double) as any_link,
       cast(contains(html, '#') as double) as has_hashtag from pages""",
)
def str_detect_flag(t):
    return t.pages.select(
        "page_id",
        tx.has_match(F.col("url"), tx.LINK_PLAIN).alias("plain_link"),
        tx.has_match(F.col("url"), tx.LINK_ANY).alias("any_link"),
        tx.has_match(F.col("html"), "#").alias("has_hashtag"),
    )


@query(
    "str_remove_first",
    f"""select page_id, {_sub("html", "&amp", "", "")} as html, {_sub("url || ' x ' || url", "https?://[^ ]+", "", "")} as links from pages""",
)
def str_remove_first(t):
    twice = F.concat_ws(" x ", "url", "url")
    return t.pages.select(
        "page_id",
        tx.remove_first(F.col("html"), cleaning.AMP).alias("html"),
        tx.remove_first(twice, "https?://[^ ]+").alias("links"),
    )


@query(
    "str_remove_all",
    f"""select page_id, {_sub("html", "&amp", "")} as html, {_sub("url || ' x ' || url", "https?://[^ ]+", "")} as links from pages""",
)
def str_remove_all(t):
    twice = F.concat_ws(" x ", "url", "url")
    return t.pages.select(
        "page_id",
        tx.remove_all(F.col("html"), cleaning.AMP).alias("html"),
        tx.remove_all(twice, "https?://[^ ]+").alias("links"),
    )


@query("str_replace_all", f"select doc_id, {_sub('text', '[0-9]')} as text from documents")
def str_replace_all(t):
    return t.documents.select("doc_id", tx.replace_all(F.col("text"), cleaning.DIGIT, " ").alias("text"))


_FOLD = r"[^\x00-\x7F]"


@query("ascii_fold", f"select doc_id, {_sub('text', _FOLD)} as text from documents")
def ascii_fold(t):
    return t.documents.select("doc_id", tx.ascii_fold(F.col("text")).alias("text"))


@query("str_squish", f"select doc_id, {_squish('text')} as text from documents")
def str_squish(t):
    return t.documents.select("doc_id", tx.squish(F.col("text")).alias("text"))


@query(
    "remove_words",
    f"select doc_id, {_sub(_sub('lower(text)', _FOLD), r'\b(?:' + _words_sql(_ASCII_ONLY) + r')\b', '')} as text from documents",
)
def remove_words(t):
    folded = tx.ascii_fold(F.lower("text"))
    return t.documents.select("doc_id", tx.remove_words(folded, _ASCII_ONLY).alias("text"))


@query("remove_punct", f"select doc_id, {_sub('text', '[[:punct:]]', '')} as text from documents")
def remove_punct(t):
    return t.documents.select("doc_id", tx.remove_punctuation(F.col("text")).alias("text"))


@query(
    "punct_to_space",
    f"select doc_id, {_sub('text', r'[\p{P}\p{S}]')} as no_punct, {_sub('text', r'[^\p{L}\p{Nd}]')} as no_signs from documents",
)
def punct_to_space(t):
    return t.documents.select(
        "doc_id",
        tx.punctuation_to_space(F.col("text")).alias("no_punct"),
        tx.non_alnum_to_space(F.col("text")).alias("no_signs"),
    )


@query(
    "drop_short_words",
    f"""select doc_id, {_sub(_sub('lower(text)', _FOLD), r'\b[a-z]{1}\b')} as one, {_sub(_sub('lower(text)', _FOLD), r'\b[a-z]{1,2}\b')} as two from documents""",
)
def drop_short_words(t):
    folded = tx.ascii_fold(F.lower("text"))
    return t.documents.select(
        "doc_id", tx.drop_short_words(folded, 1).alias("one"), tx.drop_short_words(folded, 2).alias("two")
    )


@query("distinct_word_count", "select doc_id, cast(len(list_distinct(string_split(text, ' '))) as integer) as unique_words from documents")
def distinct_word_count(t):
    return t.documents.select("doc_id", tx.distinct_pieces(F.col("text")).alias("unique_words"))


# fixed values: example keywords and phrases
_KEYWORDS = ["thing", "eaux", "worthless", "nicht"]
_PHRASES = ["of the", "de la", "in der"]
_HIT = "cast(regexp_matches(lower(text), '{}') as integer)"


@query(
    "keyword_hit",
    f"""with k as (select doc_id, {_HIT.format('|'.join(_KEYWORDS))} as keyword_hit, {_HIT.format('|'.join(_PHRASES))} as phrase_hit from documents)
        select doc_id, keyword_hit, phrase_hit, greatest(keyword_hit, phrase_hit) as either from k""",
)
def keyword_hit(t):
    low = F.lower("text")
    a, b = tx.keyword_hit(low, _KEYWORDS), tx.keyword_hit(low, _PHRASES)
    return t.documents.select("doc_id", a.alias("keyword_hit"), b.alias("phrase_hit"), F.greatest(a, b).alias("either"))


@query("default_text", f"with {TWEETS} select id, coalesce(keyword, 'None') as keyword, coalesce(location, 'None') as location from tweets")
def default_text(t):
    none = F.lit("None")
    return tweets(t).select("id", F.coalesce("keyword", none).alias("keyword"), F.coalesce("location", none).alias("location"))


_FEATURES_SQL = f"""cast(length(text) as integer) as character_count, cast(len(regexp_extract_all(text, '#')) as integer) as hashtag_count,
  cast(contains(text, '#') as double) as has_hashtag, cast(len(regexp_extract_all(text, '@')) as integer) as mention_count,
  cast(contains(text, '@') as double) as has_mention, cast(len(regexp_extract_all(text, 'https?://')) as integer) as link_count,
  cast(regexp_matches(text, 'https?://') as double) as has_link, cast(len(regexp_extract_all(text, '{_WORD_CLASS}+')) as integer) as word_count,
  cast(len(list_distinct(string_split(text, ' '))) as integer) as unique_words"""


@query("text_features", f"with {TWEETS} select id, coalesce(keyword, 'None') as keyword, location, {_FEATURES_SQL} from tweets")
def text_features(t):
    return tweets(t).select(
        "id",
        F.coalesce("keyword", F.lit("None")).alias("keyword"),
        "location",
        *[c.alias(n) for n, c in tx.text_features().items()],
    )


@query(
    "text_features_short",
    f"""with {TWEETS}, k as (select id, cast(contains(text, 'http://') as double) as has_link, cast(contains(text, '#') as double) as contains_hashtag,
        cast(length(text) as integer) as nchar, cast(len(regexp_extract_all(text, '{_WORD_CLASS}+')) as integer) as n_words,
        cast(regexp_matches(text, '{'|'.join(_KEYWORDS)}') as integer) as key_hit, cast(regexp_matches(text, '{'|'.join(_PHRASES)}') as integer) as ngram_hit from tweets)
        select *, greatest(key_hit, ngram_hit) as key_or_ngram from k""",
)
def text_features_short(t):
    c = F.col("text")
    a, b = tx.keyword_hit(c, _KEYWORDS), tx.keyword_hit(c, _PHRASES)
    return tweets(t).select(
        "id",
        tx.has_match(c, tx.LINK_PLAIN).alias("has_link"),
        tx.has_match(c, "#").alias("contains_hashtag"),
        F.char_length(c).alias("nchar"),
        tx.count_words(c).alias("n_words"),
        a.alias("key_hit"),
        b.alias("ngram_hit"),
        F.greatest(a, b).alias("key_or_ngram"),
    )


# ---- composite cleaning; the text carries a link and a mention so that every rule has work ------

_RAW_SQL = "raw as (select page_id as id, url || ' %20 @_ab ' || html || chr(13) || chr(10) || '#tag1 ' || url as text from pages union all select -1 - doc_id, text from documents)"


def _raw(t):
    made = F.concat(F.col("url"), F.lit(" %20 @_ab "), F.col("html"), F.lit("\r\n#tag1 "), F.col("url"))
    pages = spread(t.pages, "page_id").select(F.col("page_id").alias("id"), made.alias("text"))
    return pages.unionByName(spread(t.documents, "doc_id").select((-1 - F.col("doc_id")).alias("id"), "text"))


def _cleaned(t, rules):
    return _raw(t).select("id", cleaning.apply_rules(F.col("text"), rules).alias("text"))


def _clean_sql(steps, first_only=()):
    e = "lower(text)"
    for p, b in steps:
        e = _squish(e) if p == "squish" else _sub(e, p, b, "" if p in first_only else "g")
    return f"with {_RAW_SQL} select id, {e} as text from raw"


_STOP_RE = r"\b(?:" + _words_sql(_ASCII_ONLY) + r")\b"


@query(
    "clean_text_v1",
    _clean_sql([("%20", ""), (r"https?://\S+", " "), ("&amp", " "), (_FOLD, " "), ("[\n]", " "), ("[\r]", " "), ("[0-9]", " "), (r"@_\S+ ", " "),
                (r"[^\p{L}\p{Nd}]", " "), (r"\b[a-z]{1}\b", " "), ("squish", "")]),
)
def clean_text_v1(t):
    return _cleaned(t, cleaning.rules_v1())


@query(
    "clean_text_v2",
    _clean_sql([("%20", ""), (r"https?://\S+", " "), ("&amp", " "), (_FOLD, " "), ("[\n]", " "), (r"#\S+", " "), ("[\r]", " "), ("[0-9]", " "),
                (r"@_\S+ ", " "), (r"[^\p{L}\p{Nd}]", " "), (_STOP_RE, ""), (r"\b[a-z]{1,2}\b", " "), ("squish", "")]),
)
def clean_text_v2(t):
    return _cleaned(t, cleaning.rules_v2(_ASCII_ONLY))


@query(
    "clean_text_v3",
    _clean_sql([(r"https?://\S+", " "), ("&amp", " "), (_FOLD, " "), ("[\n]", " "), (r"#\S+", " "), ("[\r]", " "), ("[0-9]", " "), (r"@_\S+ ", " "),
                (_STOP_RE, ""), ("[[:punct:]]", ""), ("squish", "")]),
)
def clean_text_v3(t):
    return _cleaned(t, cleaning.rules_v3(_ASCII_ONLY))


@query(
    "clean_text_v3b",
    _clean_sql([("%20", ""), (r"https?://\S+", " "), ("&amp", " "), (_FOLD, " "), ("[\n]", " "), ("[\r]", " "), ("[0-9]", " "), (r"@_\S+ ", " "),
                (r"[\p{P}\p{S}]", " "), (_STOP_RE, ""), ("squish", "")]),
)
def clean_text_v3b(t):
    return _cleaned(t, cleaning.rules_v3b(_ASCII_ONLY))


_V4_STOP_A = [w for w in STOP_ENGLISH if w.isascii()]
_V4_STOP_B = [w for w in STOP_OTHER if w.isascii()]
_V4_FIRST = ("https?://[^\n\r]+", "&amp", "\n", "\r", "\u0089[Ûû]_")


@query(
    "clean_text_v4",
    "with f as (select id, cast(contains(lower(text), 'http://') as double) as has_link, cast(contains(text, '#') as double) as contains_hashtag from ("
    + f"with {_RAW_SQL} select * from raw)), c as ("
    + _clean_sql(
        [("https?://[^\n\r]+", ""), ("&amp", ""), ("\n", ""), ("\r", ""), ("\u0089[Ûû]_", ""), ("[0-9]", " "), ("@_[^\n\r]+ ", " "), (_FOLD, " "),
         (r"\b(?:" + _words_sql(_V4_STOP_A) + r")\b", ""), (r"\b(?:" + _words_sql(_V4_STOP_B) + r")\b", ""), ("[[:punct:]]", ""), ("squish", "")],
        _V4_FIRST,
    )
    + f") select c.id, text, has_link, contains_hashtag, cast(length(text) as integer) as nchar, cast(len(regexp_extract_all(text, '{_WORD_CLASS}+')) as integer) as n_words from c join f on c.id = f.id",
)
def clean_text_v4(t):
    """Flags are taken before links and hashtags are stripped. The text is folded to ASCII before the stop
    lists, so that both engines agree on word borders."""
    rules = cleaning.rules_v4(_V4_STOP_A, _V4_STOP_B)
    rules.insert(-4, tx.ascii_fold)
    c = cleaning.apply_rules(F.col("text"), rules)
    raw = _raw(t).select(
        "id",
        tx.has_match(F.lower("text"), tx.LINK_PLAIN).alias("has_link"),
        tx.has_match(F.col("text"), "#").alias("contains_hashtag"),
        c.alias("text"),
    )
    return raw.withColumns({"nchar": F.char_length("text"), "n_words": tx.count_words(F.col("text"))})
