"""Mixing sources to target weights.

Every document gets a key from a hash of its id, so the order within a source is random and yet the same on
every run. Ranges of that key cut each source into even pieces whatever its size; totals per piece give the
words that come before it, and only inside a piece are rows sorted and summed up. Each source is cut at its
budget, after as many whole epochs as the budget holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainmill.llm.shelf import Shelf, shuffle_parts
from grainmill.operators.scale import row_positions

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
WORD = r"[^\x20\x09-\x0D]+"
#: Keys are whole numbers below 2 ** KEY_BITS.
KEY_BITS = 60


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_key(seed: str) -> Column:
    """Even over 0 .. 2 ** KEY_BITS - 1; the first 15 hex digits of a digest, so that any engine finds the same."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def source_targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target): `share` of all words by weight, no source above `most` times its own.

    `sources` is a written table (source, source_size). Weights repeat along the sources in code point order,
    a null source last. What a source cannot take is shared again among the others by weight until none is above.
    """
    spark = sources.sparkSession
    named = sources.withColumns({"__none": F.col("source").isNull(), "__name": F.coalesce("source", F.lit(""))})
    ranked = row_positions(named, ["__none", "__name"], name="__rank", stored=True)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("__rank") - 1) % len(weights) + 1).cast("int"))
    weighed = Shelf(spark).keep(ranked.select("source", "source_size", weight.alias("weight")), "sources")
    cap = F.col("source_size") * most
    total = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    level, held = 0.0, -1
    while True:  # each round lifts the level that open sources share; closed ones never open again
        open_ = cap.cast("double") > F.col("weight") * F.lit(level) if held >= 0 else F.lit(True)
        got = weighed.agg(
            F.sum(F.when(open_, F.col("weight"))).alias("w"),
            F.sum(F.when(~open_, cap)).alias("c"),
            F.count_if(~open_).alias("n"),
        ).first()
        if got["n"] == held or not got["w"]:
            break
        held, level = got["n"], (total - (got["c"] or 0)) / got["w"]
    wanted = F.col("weight") * F.lit(level)
    return weighed.select(
        "source", "source_size", F.when(cap.cast("double") > wanted, wanted).otherwise(cap.cast("double")).alias("target")
    )


def mix_sources(
    docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = "mix"
) -> DataFrame:
    """One row per document: its columns, size, source_size, target (its source's) and taken.

    `taken` counts the words that the mix takes, repeats included: size times the whole epochs, and in the
    last epoch the whole document before the budget, the part of it up to the budget, or nothing. The words
    taken of a source are its target, rounded down.

    Null text: size 0, taken 0. Null source: a source of its own, last. Ties in the key (rows that share a
    doc_id) are ordered by size, so equal rows may change places but the set of rows stays. Columns named
    size, source_size, target or taken are replaced. An empty table gives an empty result.
    """
    docs = docs.drop("size", "source_size", "target", "taken")
    shelf = Shelf(docs.sparkSession)
    pieces = 4 * shuffle_parts(docs.sparkSession)
    width = (1 << KEY_BITS) // pieces + 1
    narrow = docs.select(
        F.col("doc_id").alias("__id"),
        F.xxhash64("text").alias("__body"),
        "source",
        word_count(F.col("text")).alias("size"),
        shuffle_key(seed).alias("__key"),
    )
    narrow = narrow.withColumn("__piece", F.floor(F.col("__key") / F.lit(width)))
    sized = shelf.keep(narrow, "sized")
    piece_sums = shelf.keep(
        sized.groupBy("source", "__piece").agg(F.sum("size").alias("words")), "pieces"
    )
    sources = shelf.keep(piece_sums.groupBy("source").agg(F.sum("words").alias("source_size")), "totals")
    targets = source_targets(sources, weights, share, most)
    earlier = Window.partitionBy("source").orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = piece_sums.withColumn("start", F.coalesce(F.sum("words").over(earlier), F.lit(0)))
    named = lambda df: df.withColumns(
        {"__none": F.col("source").isNull(), "__name": F.coalesce("source", F.lit(""))}
    ).drop("source")
    starts = named(starts).join(named(targets), ["__none", "__name"]).drop("words")
    placed = sized.transform(named).join(starts, ["__none", "__name", "__piece"])
    inside = Window.partitionBy("__none", "__name", "__piece").orderBy("__key", "__id", "size", "__body")
    before = F.sum("size").over(inside) - F.col("size") + F.col("start")
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), budget - epochs * F.col("source_size") - before))
    return placed.select(
        F.col("__id").alias("doc_id"),
        F.col("__body").alias("body"),
        "size",
        "source_size",
        "target",
        (F.col("size") * epochs + rest).cast("long").alias("taken"),
    )


def first_words(text: str, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    space, word = r"[\x20\x09-\x0D]*+", r"[^\x20\x09-\x0D]++"
    pattern = F.concat(F.lit(f"^(?:{space}{word}){{"), n.cast("string"), F.lit("}+"))
    return F.call_function("regexp_extract", F.col(text), pattern, F.lit(0))


def mixed_documents(docs: DataFrame, **kinds) -> DataFrame:
    """The mix itself, in the columns of `docs`: a document stands as often as it is taken, the last time
    perhaps cut after some of its words. Documents of which no word is taken are left out.

    Rows equal in doc_id and text all stand as often as the one of them that is taken most. All columns but `text`
    stay, whatever their names. Null or empty text is never taken. An empty table gives an empty result.
    """
    taken = mix_sources(docs, **kinds).where("taken > 0").groupBy("doc_id", "body", "size").agg(F.max("taken").alias("t"))
    right = taken.select(F.col("doc_id").alias("__id"), "body", "size", "t")
    own = [F.col(f"`{c}`") for c in docs.columns]
    left = docs.select(F.struct(*own).alias("row"), F.col("doc_id"), F.xxhash64("text").alias("hash"))
    joined = left.join(right, left["doc_id"].eqNullSafe(right["__id"]) & (left["hash"] == right["body"]))
    copies = joined.select("row", "size", F.explode(F.sequence("t", F.lit(1).cast("long"), -F.col("size"))).alias("words"))
    text = F.when(F.col("words") >= F.col("size"), F.col("row.text")).otherwise(first_words("row.text", F.col("words")))
    return copies.withColumn("row", F.col("row").withField("text", text)).select("row.*")
