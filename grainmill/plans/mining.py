"""Tokens, vocabularies, TF-IDF, co-occurrence, sequences, word vectors."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from grainmill.functions import cleaning, encode
from grainmill.functions import text as tx
from grainmill.operators import reshape, textmine, windows
from grainmill.operators.scale import key_counts, settle
from grainmill.plans.registry import query
from grainmill.plans.roles import LABELLED, TWEETS, labelled, r, texts, tweets
from grainmill.plans.words import STOP_ENGLISH, STOP_OTHER, STOP_SQL, WORD_SQL, tokens_sql

_TOKENS = f"{TWEETS}, {tokens_sql('tweets')}"
_DTM = f"{_TOKENS}, dtm as (select id, word, count(*) as n from tokens group by id, word)"
_VOCAB = f"{_DTM}, vocab as (select word, cast(sum(n) as bigint) as term_count, count(*) as doc_count from dtm group by word)"


@query("unnest_tokens", f"with {_TOKENS} select id, word from tokens")
def unnest_tokens(t):
    return textmine.unnest_tokens(texts(t))


_POSITIONS = f"""arrays as (select id, target, regexp_extract_all(lower(text), '{WORD_SQL}') as a from {{0}}),
  places as (select id, target, a, unnest(range(1, len(a) + 1)) as pos from arrays)"""
_BIGRAMS = _POSITIONS + ", bigrams as (select id, target, a[pos] || ' ' || a[pos + 1] as word from places where pos < len(a))"


@query("unnest_bigrams", f"with {TWEETS}, {_BIGRAMS.replace('{0}', 'tweets')} select id, word from bigrams")
def unnest_bigrams(t):
    return textmine.unnest_ngrams(texts(t))


def _light(sql_stop: bool) -> str:
    e = "text"
    e = f"regexp_replace({e}, 'https?://\\S+', ''{'' if sql_stop else ", 'g'"})"
    for p in ("&amp", "\n", "\r", "\u0089[Ûû]_"):
        e = f"regexp_replace({e}, '{p}', '')"
    e = f"regexp_replace({e}, '[0-9]', ' ', 'g')"
    e = f"regexp_replace({e}, '@_[^\n\r]+ ', ' ', 'g')"
    return e


_CLASS = "case target when 0 then 'Non-disaster' else 'Disaster' end as target"


@query(
    "top_words_by_class",
    f"""with {LABELLED}, kept as (select * from (select *, row_number() over (partition by keyword, location, text order by id) as k from labelled) where k = 1),
        clean as (select id, {_CLASS}, {_light(False)} as text from kept), {tokens_sql('clean', 'target')},
        c as (select target, word, count(*) as n from tokens where length(word) > 2 and word not in ({STOP_SQL}) group by all)
        select target, word, n from (select *, rank() over (partition by target order by n desc) as k from c) where k <= 20""",
)
def top_words_by_class(t):
    kept = windows.first_row_per_key(labelled(t), ["keyword", "location", "text"], ["id"])
    clean = kept.select(
        encode.recode(F.col("target"), {0: "Non-disaster", 1: "Disaster"}).alias("target"),
        cleaning.apply_rules(F.col("text"), cleaning.rules_for_words()).alias("text"),
    )
    words = textmine.unnest_tokens(clean, keep=["target"]).where(F.char_length("word") > 2)
    words = textmine.without_stopwords(words, STOP_ENGLISH, STOP_OTHER)
    return windows.top_n_ties(key_counts(words, ["target", "word"]), ["target"], "n", 20)


_ASCII_STOP = [w for w in STOP_ENGLISH + STOP_OTHER if w.isascii()]


@query(
    "top_bigrams_by_class",
    f"""with {LABELLED}, clean as (select id, target, regexp_replace(regexp_replace({_light(True)}, '[^\\x00-\\x7F]', ' ', 'g'),
        '\\b(?:{"|".join(sorted(_ASCII_STOP, reverse=True))})\\b', '', 'g') as text from labelled), {_BIGRAMS.replace('{0}', 'clean')},
        c as (select target, word, count(*) as n from bigrams where word not in ({STOP_SQL}) group by all)
        select target, word, n from (select *, rank() over (partition by target order by n desc) as k from c) where k <= 20""",
)
def top_bigrams_by_class(t):
    rules = cleaning.rules_for_bigrams(_ASCII_STOP, [])[:-2]
    rules += [tx.ascii_fold, cleaning.without(_ASCII_STOP)]
    clean = labelled(t).select("target", cleaning.apply_rules(F.col("text"), rules).alias("text"))
    pairs = textmine.unnest_ngrams(clean, keep=["target"])
    pairs = textmine.without_stopwords(pairs, STOP_ENGLISH, STOP_OTHER)
    return windows.top_n_ties(key_counts(pairs, ["target", "word"]), ["target"], "n", 20)


@query(
    "class_rate_by_keyword",
    f"""with {LABELLED}, c as (select keyword, target, count(*) as n from labelled where keyword is not null group by all),
        g as (select * from (select distinct target from c), (select distinct keyword from c)),
        f as (select g.keyword, g.target, coalesce(n, 0) as n from g left join c on g.keyword = c.keyword and g.target = c.target)
        select keyword, target, n, round(n / sum(n) over (partition by keyword), 6) as prop from f""",
)
def class_rate_by_keyword(t):
    counts = key_counts(labelled(t).where(F.col("keyword").isNotNull()), ["keyword", "target"])
    full = reshape.complete_counts(counts, "target", "keyword")
    rated = windows.share_within(full, ["keyword"]).withColumn("prop", r("prop"))
    return rated.orderBy(F.desc("target"), F.desc("prop"), "keyword")


@query("vocabulary", f"with {_VOCAB} select * from vocab")
def vocabulary(t):
    return textmine.vocabulary(texts(t))


@query("prune_vocabulary", f"with {_VOCAB} select * from vocab where term_count >= 5 and doc_count >= 10")
def prune_vocabulary(t):
    return textmine.prune_vocabulary(textmine.vocabulary(texts(t)), term_count_min=5, doc_count_min=10)


_TRAIN_VOCAB = f"""{TWEETS}, {tokens_sql('tweets', 'id, target')}, dtm as (select id, word, any_value(target) as target, count(*) as n from tokens group by id, word),
  vocab as (select word, count(*) as doc_count from dtm where target is not null group by word having count(*) >= 10)"""


def _train_vocab(t):
    return settle(textmine.prune_vocabulary(textmine.vocabulary(labelled(t)), doc_count_min=10), "vocabulary")


@query("doc_term_counts", f"with {_TRAIN_VOCAB} select d.id, d.word, n from dtm d join vocab v on d.word = v.word")
def doc_term_counts(t):
    """The vocabulary of the labelled documents, applied to all documents."""
    counts = textmine.doc_term_counts(texts(t))
    return textmine.restrict_to_vocabulary(counts, _train_vocab(t)).select("id", "word", "n")


_TFIDF = f"""{_VOCAB}, nd as (select count(*) as docs from tweets),
  c as (select d.id, d.word, n, doc_count from dtm d join vocab v on d.word = v.word where doc_count >= 10),
  w as (select id, word, n / sum(n) over (partition by id) * ln((docs + 1) / (doc_count + 1)) as tfidf from c, nd)"""


def _tfidf(t, norm):
    w = tweets(t)
    vocab = textmine.prune_vocabulary(textmine.vocabulary(w), doc_count_min=10)
    # the document count is needed twice: for the rows to spread and for the idf
    vocab = vocab.withColumn("docs", F.col("doc_count"))
    # texts are dealt by id, so that their words need not be, neither to be counted nor to be weighed per document
    own = w.select("id", "text").repartition("id")
    counts = textmine.restrict_to_vocabulary(textmine.doc_term_counts(own), vocab, extra=["docs"])
    out = textmine.tfidf(counts.withColumnRenamed("docs", "doc_count"), textmine.count_of(w), norm)
    return out.withColumn("tfidf", r("tfidf"))


@query("tfidf_l1", f"with {_TFIDF} select id, word, round(tfidf, 6) as tfidf from w")
def tfidf_l1(t):
    return _tfidf(t, "l1")


@query("tfidf_l2", f"with {_TFIDF} select id, word, round(tfidf / nullif(sqrt(sum(tfidf * tfidf) over (partition by id)), 0), 6) as tfidf from w")
def tfidf_l2(t):
    return _tfidf(t, "l2")


@query(
    "cooccurrence",
    f"""with {TWEETS}, {_POSITIONS.replace('{0}', 'tweets')}, p as (select a[pos] as x, a[pos + d] as y, 60 // d as w from places, range(1, 6) as u(d) where pos + d <= len(a))
        select least(x, y) as term_a, greatest(x, y) as term_b, round(sum(w) / 60, 6) as weight from p group by 1, 2""",
)
def cooccurrence(t):
    return textmine.cooccurrence(texts(t)).withColumn("weight", r("weight"))


_RANKED = f"{_VOCAB}, ranked as (select word, term_count, row_number() over (order by term_count desc, word) as rank from vocab)"
_SEQ = f"""{_RANKED}, arrays as (select id, regexp_extract_all(lower(text), '{WORD_SQL}') as a from tweets),
  places as (select id, unnest(range(1, len(a) + 1)) as pos, unnest(a) as word from arrays),
  coded as (select p.id, pos, rank from places p join ranked k on p.word = k.word where rank < 500)"""


def _sequences(t):
    w = tweets(t)
    ranked = textmine.ranked_vocabulary(textmine.vocabulary(w), top=499)
    return textmine.encode_sequences(w, ranked, 500)


@query(
    "encode_sequences",
    f"""with {_SEQ} select t.id, coalesce(string_agg(cast(rank as varchar), ' ' order by pos), '') as seq from tweets t left join coded c on t.id = c.id group by t.id""",
)
def encode_sequences(t):
    return _sequences(t).select("id", F.array_join(F.col("seq").cast("array<string>"), " ").alias("seq"))


def _padded_sql(padding, truncating):
    cut = "s[-50:]" if truncating == "pre" else "s[:50]"
    zeros = "repeat('0 ', greatest(50 - len(s), 0))"
    tail = f"array_to_string({cut}, ' ')"
    text = f"trim({zeros} || {tail})" if padding == "pre" else f"trim({tail} || ' ' || {zeros})"
    return f"""with {_SEQ}, q as (select t.id, coalesce(list(cast(rank as varchar) order by pos) filter (where rank is not null), []) as s
               from tweets t left join coded c on t.id = c.id group by t.id) select id, {text} as seq from q"""


def _padded(t, padding, truncating):
    seq = textmine.pad(F.col("seq"), 50, padding, truncating)
    return _sequences(t).select("id", F.array_join(seq.cast("array<string>"), " ").alias("seq"))


@query("pad_sequences", _padded_sql("pre", "pre"))
def pad_sequences(t):
    return _padded(t, "pre", "pre")


@query("pad_sequences_post", _padded_sql("post", "post"))
def pad_sequences_post(t):
    return _padded(t, "post", "post")


# the vector with number k belongs to the word of rank k + 1
_VECTORS = f"{_RANKED}, vectors as (select word, term_count, rank, embedding from ranked join embeddings on rank = vec_id + 1)"


def ranked_with_vectors(t):
    """(word, term_count, doc_count, rank, vec): the most frequent words with their vectors."""
    ranked = textmine.ranked_vocabulary(textmine.vocabulary(texts(t)))
    vecs = t.embeddings.select((F.col("vec_id") + 1).alias("rank"), F.col("embedding").alias("vec"))
    return ranked.join(vecs, "rank")


@query(
    "lookup_vectors",
    f"""with {_RANKED} select word, rank, round(cast(coalesce(embedding[1], 0) as double), 6) + 0.0 as first, round(cast(coalesce(embedding[64], 0) as double), 6) + 0.0 as last
        from ranked left join embeddings on rank = vec_id + 1""",
)
def lookup_vectors(t):
    ranked = settle(textmine.ranked_vocabulary(textmine.vocabulary(texts(t))), "ranked")
    vecs = t.embeddings.select((F.col("vec_id") + 1).alias("rank"), F.col("embedding").alias("vec"))
    vectors = ranked.join(vecs, "rank").select("word", "vec")
    found = textmine.lookup_vectors(ranked.select("word", "rank"), vectors, 64)
    return found.select("word", "rank", r(F.get("vec", 0)).alias("first"), r(F.get("vec", 63)).alias("last"))


@query(
    "mean_embedding",
    f"""with {_VECTORS}, e as (select d.id, n, unnest(range(0, 64)) as dim, unnest(embedding) as v from dtm d join vectors v on d.word = v.word)
        select id, cast(dim as integer) as dim, round(sum(n * cast(v as double)) / sum(n), 6) + 0.0 as value from e group by id, dim""",
)
def mean_embedding(t):
    vectors = ranked_with_vectors(t)
    found = textmine.mean_embedding(textmine.doc_term_counts(texts(t)), vectors)
    long = found.select("id", F.posexplode(vector_to_array("features")).alias("dim", "v"))
    return long.select("id", "dim", r("v").alias("value"))
