"""Tokens, vocabularies, document-term tables, TF-IDF, co-occurrence, sequences, vectors."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grainmill.functions import text as tx
from grainmill.operators.neighbours import pair_sums
from grainmill.operators.scale import attach_by_key, key_counts, row_positions, scalars, settle
from grainmill.session import shuffle_parts

#: Words of documents in a block: so many where there are few blocks, so many at most; words multiplied at once.
LEAST_ENTRIES, BLOCK_ENTRIES, STEP = 50_000, 4_000_000, 100_000


def word_list(spark: SparkSession, words: Sequence[str], name: str = "word") -> DataFrame:
    """A fixed list as a one-column table (no Python worker involved)."""
    return spark.range(1).select(F.explode(F.array(*[F.lit(w) for w in words])).alias(name))


def unnest_tokens(df: DataFrame, text: str = "text", keep: Sequence[str] = ("id",), name: str = "word") -> DataFrame:
    """One row per lower-cased word."""
    return df.select(*keep, F.explode(tx.tokens(F.col(text))).alias(name))


def unnest_ngrams(
    df: DataFrame, text: str = "text", keep: Sequence[str] = ("id",), n: int = 2, name: str = "word"
) -> DataFrame:
    """One row per run of `n` neighbouring words; texts with fewer words give no row."""
    words = df.select(*keep, tx.tokens(F.col(text)).alias("__t"))
    return words.select(*keep, F.explode(tx.ngrams(F.col("__t"), n)).alias(name))


def without_stopwords(tokens: DataFrame, *lists: Sequence[str], name: str = "word") -> DataFrame:
    """Anti join with fixed stop lists; a fixed list is small, so it is broadcast."""
    for words in lists:
        stop = F.broadcast(word_list(tokens.sparkSession, words, name))
        tokens = tokens.join(stop, name, "left_anti")
    return tokens


def doc_term_counts(df: DataFrame, text: str = "text", id_: str = "id") -> DataFrame:
    """(id, word, n). The words of a document are counted up in the task that reads it; rows already
    partitioned by id (after a join on it) are not shuffled again, here or in later windows over the id."""
    return key_counts(unnest_tokens(df, text, [id_]), [id_, "word"])


def vocabulary(df: DataFrame, text: str = "text", id_: str = "id") -> DataFrame:
    """(word, term_count, doc_count) with a single shuffle, on words already summed per task.

    The words of a document are sorted inside its row; the first of equal neighbours counts the document,
    so no pair of document and word ever leaves the task.
    """
    arrays = df.select(F.sort_array(tx.tokens(F.col(text))).alias("__t"))
    before = F.concat(F.array(F.lit(None).cast("string")), F.slice("__t", F.lit(1), F.greatest(F.size("__t") - 1, F.lit(0))))
    words = arrays.select(F.inline(F.arrays_zip(F.col("__t").alias("word"), before.alias("__before"))))
    # an empty text zips to one row without a word
    words = words.where(F.col("word").isNotNull())
    new = F.when(F.col("__before").isNull() | (F.col("__before") != F.col("word")), 1).otherwise(0)
    return words.groupBy("word").agg(
        F.count(F.lit(1)).alias("term_count"), F.sum(new.cast("long")).alias("doc_count")
    )


def prune_vocabulary(vocab: DataFrame, term_count_min: int = 1, doc_count_min: int = 1) -> DataFrame:
    return vocab.where((F.col("term_count") >= term_count_min) & (F.col("doc_count") >= doc_count_min))


def restrict_to_vocabulary(counts: DataFrame, vocab: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Rows of a document-term table whose word is in the vocabulary, with `extra` vocabulary columns.

    A frequent word has one row per document that holds it: such words are spread over slices."""
    stats = vocab.select("word", F.col("doc_count").alias("__docs"), *extra)
    return attach_by_key(counts, stats, ["word"], "__docs", ["id"], how="inner")


def tfidf(counts: DataFrame, n_docs: Column, norm: str) -> DataFrame:
    """(id, word, n, doc_count) -> (id, word, tfidf).

    Term frequency is the share of the document's words; idf is log((N + 1) / (df + 1)); norm "l2" scales
    each document to unit length afterwards. The windows span one document each.
    """
    doc = Window.partitionBy("id")
    idf = F.log((n_docs + 1) / (F.col("doc_count") + 1))
    weighted = counts.select("id", "word", (F.col("n") / F.sum("n").over(doc) * idf).alias("tfidf"))
    if norm == "l1":
        return weighted
    length = F.sqrt(F.sum(F.col("tfidf") * F.col("tfidf")).over(doc))
    return weighted.withColumn("tfidf", F.try_divide(F.col("tfidf"), length))


def cooccurrence(df: DataFrame, text: str = "text", window: int = 5, keep: Column | None = None) -> DataFrame:
    """(term_a, term_b, weight): unordered pairs at most `window` apart, each adding 1 / distance.

    Every word meets at most `window` followers, formed inside its own text. Weights are summed as
    integers over a common denominator, so the sum does not depend on the order of rows. Pairs are
    summed per task and shuffled packed (`neighbours.pair_sums`); the words are counted right away.
    """
    pairs = pair_sums(df.select(tx.tokens(F.col(text)).alias("__t")), "__t", window)
    return pairs if keep is None else pairs.where(keep)


def ranked_vocabulary(vocab: DataFrame, top: int | None = None) -> DataFrame:
    """Adds `rank`: 1 for the most frequent word, ties in word order. With `top`, only that many words:
    a bounded top-k instead of a global order."""
    ordered = vocab.withColumn("__neg", -F.col("term_count"))
    if top is not None:
        first = ordered.orderBy("__neg", "word").limit(top)
        return first.withColumn("rank", F.row_number().over(Window.orderBy("__neg", "word"))).drop("__neg")
    return row_positions(ordered, ["__neg", "word"], name="rank").drop("__neg")


def encode_sequences(df: DataFrame, ranked: DataFrame, num_words: int | None = None, text: str = "text") -> DataFrame:
    """(id, seq): array of word ranks in text order, only ranks below `num_words`; [] if none is left."""
    df = df.select("id", text)
    words = df.select("id", F.posexplode(tx.tokens(F.col(text))).alias("pos", "word"))
    stats = ranked if num_words is None else ranked.where(F.col("rank") < num_words)
    stats = stats.select("word", F.col("rank").cast("int").alias("rank"), "term_count")
    coded = attach_by_key(words, stats, ["word"], "term_count", ["id", "pos"], how="inner")
    seqs = coded.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", "rank"))).alias("__s"))
    seqs = seqs.select("id", F.col("__s.rank").alias("seq"))
    empty = F.array().cast("array<int>")
    return df.select("id").join(seqs, "id", "left").select("id", F.coalesce("seq", empty).alias("seq"))


def pad(seq: Column, length: int, padding: str = "pre", truncating: str = "pre") -> Column:
    """Fixed-length array: zeros in front (or behind), surplus cut in front (or behind)."""
    over = F.size(seq) > length
    start = F.when(over & F.lit(truncating == "pre"), F.size(seq) - length + 1).otherwise(1)
    cut = F.slice(seq, start, F.lit(length))
    zeros = F.array_repeat(F.lit(0), F.greatest(F.lit(length) - F.size(seq), F.lit(0)))
    return F.concat(zeros, cut) if padding == "pre" else F.concat(cut, zeros)


def lookup_vectors(words: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """Adds `vec` to (word, ...); a word without a vector gets zeros. Frequent words are spread over slices."""
    zero = F.array_repeat(F.lit(0.0).cast("float"), dim)
    stats = vectors.select("word", "vec").join(key_counts(words, ["word"], "__n"), "word")
    found = attach_by_key(words, stats, ["word"], "__n", words.columns)
    return found.withColumn("vec", F.coalesce("vec", zero))


def mean_embedding(counts: DataFrame, vectors: DataFrame) -> DataFrame:
    """(id, word, n) and (word, vec, doc_count) -> (id, features): mean vector of the words of a document
    that have one, weighted by how often they occur.

    Words become numbers first. Documents are dealt into blocks, and a block meets each vector that it needs once: what is
    shuffled are numbers per word of a document and vectors per word of a block, not vectors per word of a document.
    """
    vectors = vectors.where(F.col("vec").isNotNull()).select("word", "vec", F.col("doc_count").alias("__docs"))
    stored = settle(vectors.withColumn("place", F.monotonically_increasing_id()), "vectors")
    known = stored.select("word", "place", "__docs")
    coded = attach_by_key(counts, known, ["word"], "__docs", ["id"], how="inner")
    coded = settle(coded.select("id", "place", F.col("n").cast("double").alias("n")), "coded")
    rows = coded.count()
    blocks = max(min(shuffle_parts(counts.sparkSession), -(-rows // LEAST_ENTRIES)), -(-rows // BLOCK_ENTRIES), 1)
    dealt = coded.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    needed = dealt.select(F.col("block").alias("of"), F.col("place").alias("needs")).distinct()
    needed = needed.join(stored.select(F.col("place").alias("needs"), "vec"), "needs")

    def means(entries: pa.Table, own: pa.Table) -> pa.Table:
        if not entries.num_rows:
            return pa.table([entries.column("id"), pa.array([], pa.list_(pa.float64()))], names=["id", "values"])
        place = own.column("needs").to_numpy()
        order = np.argsort(place)
        dense = pa.concat_arrays([c.flatten() for c in own.column("vec").chunks]).to_numpy(zero_copy_only=False)
        dense = dense.reshape(len(place), -1)[order].astype(float)
        ids = entries.column("id").combine_chunks().dictionary_encode(null_encoding="encode")
        doc = ids.indices.to_numpy()
        by_doc = np.argsort(doc, kind="stable")
        doc, n = doc[by_doc], entries.column("n").to_numpy()[by_doc]
        at = np.searchsorted(place[order], entries.column("place").to_numpy()[by_doc])
        sums = np.zeros((len(ids.dictionary), dense.shape[1]))
        for a in range(0, len(doc), STEP):
            first = np.flatnonzero(np.diff(doc[a : a + STEP], prepend=-1))
            sums[doc[a : a + STEP][first]] += np.add.reduceat(dense[at[a : a + STEP]] * n[a : a + STEP, None], first, axis=0)
        sums /= np.bincount(doc, n)[:, None]
        return pa.table([ids.dictionary, pa.array(list(sums), pa.list_(pa.float64()))], names=["id", "values"])

    met = dealt.groupBy("block").cogroup(needed.groupBy("of"))
    found = met.applyInArrow(means, f"id {dict(counts.dtypes)['id']}, values array<double>")
    return found.select("id", array_to_vector("values").alias("features"))


def count_of(df: DataFrame) -> Column:
    """Number of rows as a scalar."""
    return scalars(df.agg(F.count(F.lit(1)).alias("n")))["n"]
