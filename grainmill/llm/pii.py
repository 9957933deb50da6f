"""Personal data: patterns for four kinds, and bootstrapped contextual extraction for what they miss.

What the base patterns find are seed entities. The words in front of a seed are a lexical pattern. A graph of
mentions links patterns and instances (the identifier-like strings behind them, whether a base pattern knows
them or not). Scores pass along it in rounds: a pattern is as good as the instances that follow it, set
against every place in the corpus where its words stand (one that stands elsewhere more often than not can
never be sure, and has no say); an instance is as good as the patterns it follows. Patterns
that end with a high score find the identifiers no base pattern knows. DataFrame functions alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainmill.llm.shelf import Shelf, lookup

KINDS = ("email", "ip", "card", "phone")
_NAME, _LABEL = "A-Za-z0-9._%+-", "A-Za-z0-9-"
#: The base patterns. Possessive repeats and a look behind instead of plain ones: they match the same spans, but
#: take one pass over a long run of characters. A match may begin inside a run only where another has ended.
BASE = {
    "email": rf"(?:(?<![{_NAME}])|\G)[{_NAME}]++@[{_LABEL}]++(?:\.[{_LABEL}]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
_IP = rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"
#: Identifier-like strings: at least 7 digits with single marks between them, or a name, a sign for "at" and a name.
LIKELY = r"(?<![0-9])\+?\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,}+|(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++(?:@|[\x20]?[(\[]at[)\]][\x20]?)[A-Za-z0-9-][A-Za-z0-9.-]*+"
#: Code points before a mention, and before the mention in front of it, in which its pattern is looked for; a pattern is
#: the last WORDS words there.
REACH, WORDS = 48, 2
ROUNDS = 3
#: Different seeds that a pattern needs, and the score from which it finds new identifiers.
SUPPORT, SURE = 5, 0.5
#: Words of patterns: letters or digits, whatever marks stand around them; START and ITEM are words as well, in place
#: of the start of a text and of an identifier-like string.
START, ITEM = "\x02", "\x03"
_WORD = r"[\p{L}\p{M}]++|\p{Nd}++|[\x02\x03]"
KEY = ["doc", "body"]


def luhn(digits: Column) -> Column:
    """Whether the check digit holds, for a string of digits."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.call_function("substring", digits, n - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def is_valid(kind: Column, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    return (
        F.when(kind == "ip", match.rlike(_IP))
        .when(kind == "card", n.between(13, 19) & F.when(n.between(13, 19), luhn(digits)).otherwise(False))
        .when(kind == "phone", n.between(9, 15))
        .otherwise(True)
    )


def _pieces(text: str, pattern: str) -> Column:
    """Matches of a text in order, each with the characters between it and the one before; null if there are none."""
    found = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"), F.split(text, pattern, -1).alias("gap")
    )
    return F.when(F.col(text).rlike(pattern), found)


def _placed(texts: DataFrame, patterns: dict[str, str], keep_gap: bool) -> DataFrame:
    """(doc, body, kind, at, match, start, end[, front]) of every match, in code points."""
    found = F.array(*[F.struct(F.lit(k).alias("kind"), _pieces("text", p).alias("hits")) for k, p in patterns.items()])
    rows = texts.select(*KEY, F.explode(found).alias("f")).select(*KEY, "f.kind", F.posexplode("f.hits").alias("at", "hit"))
    rows = rows.where("hit.match is not null").select(
        *KEY,
        "kind",
        "at",
        F.length("hit.gap").cast("long").alias("gap"),
        F.col("hit.match").alias("match"),
        *([F.right("hit.gap", F.lit(REACH)).alias("front")] if keep_gap else []),
    )
    rows = rows.dropDuplicates([*KEY, "kind", "at"])  # rows that repeat a document
    order = Window.partitionBy(*KEY, "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("match")).over(order)
    if keep_gap:
        last = F.lag("front").over(Window.partitionBy(*KEY, "kind").orderBy("at"))
        mark = lambda part, sign: F.when(F.length(part) < REACH, sign).otherwise("")
        behind = F.concat(mark(last, F.when(F.col("at") == 1, START).otherwise(ITEM)), last, F.lit(ITEM))
        ahead = F.when(F.col("at") > 0, behind).otherwise(mark(F.col("front"), F.lit(START)))
        rows = rows.withColumn("front", F.concat(ahead, "front"))
    return rows.withColumn("end", end).withColumn("start", F.col("end") - F.length("match")).drop("gap")


def base_spans(texts: DataFrame) -> DataFrame:
    """(doc, body, kind, at, match, start, end) of what the base patterns find and the checks let pass."""
    return _placed(texts, BASE, False).where(is_valid(F.col("kind"), F.col("match")))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0))


def _words_before(front: Column) -> Column:
    """The last words of a stretch, lower-cased, as one string; null if there are fewer."""
    words = _words(front)
    return F.when(F.size(words) >= WORDS, F.array_join(F.slice(words, -WORDS, WORDS), " "))


def _standing(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, places): how often the words of each pattern stand in the corpus."""
    words = _words(F.concat(F.lit(START), F.regexp_replace("text", LIKELY, f" {ITEM} ")))
    rows = texts.select(words.alias("w")).where(F.size("w") >= WORDS)
    pairs = F.arrays_zip(*[F.slice("w", i + 1, F.size("w") - (WORDS - 1)).alias(f"w{i}") for i in range(WORDS)])
    rows = rows.select(F.explode(pairs).alias("p")).select(F.concat_ws(" ", *[f"p.w{i}" for i in range(WORDS)]).alias("pattern"))
    return rows.join(patterns.select("pattern"), "pattern", "left_semi").groupBy("pattern").agg(F.count(F.lit(1)).alias("places"))


def contextual_spans(texts: DataFrame, base: DataFrame, shelf: Shelf) -> DataFrame:
    """(doc, body, kind, start, end) of identifiers that patterns of high score precede and no base span touches."""
    likely = _placed(texts, {"": LIKELY}, True).drop("kind")
    likely = shelf.keep(likely.withColumn("pattern", _words_before(F.col("front"))).where("pattern is not null"), "likely")
    known = base.select(*KEY, "kind", F.col("start").alias("s"), F.col("end").alias("e"))
    marked = likely.join(known, KEY, "left").groupBy(*KEY, "at").agg(
        *[F.first(c).alias(c) for c in ("match", "pattern", "start", "end")],
        F.min(F.when((F.col("s") < F.col("end")) & (F.col("start") < F.col("e")), F.col("kind"))).alias("seed"),
    )
    instance = F.regexp_replace(F.lower("match"), "[^a-z0-9@]", "")
    mentions = shelf.keep(marked.withColumn("instance", instance), "mentions")
    graph = mentions.groupBy("pattern", "instance").agg(F.count(F.lit(1)).alias("n"), F.max("seed").alias("seed"))
    graph = shelf.keep(graph, "graph")
    backed = graph.where("seed is not null").groupBy("pattern").agg(F.count(F.lit(1)).alias("seeds"))
    backed = backed.where(F.col("seeds") >= SUPPORT).select("pattern")
    follows = graph.groupBy("pattern").agg(F.sum("n").alias("follow"))
    backed = shelf.keep(backed.join(follows, "pattern"), "backed")
    # Most patterns are ordinary words. Those that the documents with identifier-like strings alone show to stand
    # elsewhere too often are left out before places are counted in all documents. Looking for such strings again
    # takes no shuffle of texts, as a join with the mentions would.
    near = texts.where(F.col("text").rlike(LIKELY))
    may = lambda places: backed.join(places, "pattern").where(F.col("follow") >= SURE * F.col("places"))
    hopeful = shelf.keep(may(_standing(near, backed)).select("pattern"), "hopeful")
    places = may(_standing(texts, hopeful)).select("pattern", "places")
    edges = graph.groupBy("pattern").agg(F.count(F.lit(1)).alias("edges"))
    patterns = shelf.keep(places.join(edges, "pattern"), "patterns")
    graph = shelf.keep(lookup(graph, patterns.select("pattern", "places", "edges"), ["pattern"], "edges"), "edges")
    kinds = [F.col("seed").eqNullSafe(k).cast("double").alias(k) for k in KINDS]
    scored = graph.select("pattern", "instance", "n", "places", "seed", *kinds)
    for i in range(ROUNDS):
        good = scored.groupBy("pattern").agg(
            *[(F.sum(F.col("n") * F.col(k)) / F.max("places")).alias(f"p_{k}") for k in KINDS], F.count(F.lit(1)).alias("edges")
        )
        good = shelf.keep(good, f"good{i}")
        if i == ROUNDS - 1:
            break
        # An instance no base pattern knows is missed by none of its patterns with the chance that all are wrong.
        rated = lookup(scored.drop(*KINDS), good, ["pattern"], "edges")
        wrong = lambda k: F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.least(F.lit(1.0), F.col(f"p_{k}"))))))
        instances = rated.groupBy("instance").agg(
            F.max("seed").alias("known"), F.count(F.lit(1)).alias("m"), *[(1 - wrong(k)).alias(k) for k in KINDS]
        )
        instances = instances.select(
            "instance",
            "m",
            *[F.when(F.col("known").isNull(), F.col(k)).otherwise((F.col("known") == k).cast("double")).alias(k) for k in KINDS],
        )
        instances = shelf.keep(instances, f"instances{i}")
        scored = shelf.keep(lookup(scored.drop(*KINDS), instances, ["instance"], "m"), f"scored{i}")
    best = F.greatest(*[F.struct(F.col(f"p_{k}").alias("score"), F.lit(k).alias("kind")) for k in KINDS])
    sure = good.withColumn("best", best).where(F.col("best.score") >= SURE).select("pattern", F.col("best.kind").alias("kind"))
    count = mentions.groupBy("pattern").agg(F.count(F.lit(1)).alias("w"))
    sure = shelf.keep(sure.join(count, "pattern"), "sure")
    return lookup(mentions.where("seed is null"), sure, ["pattern"], "w").select(*KEY, "kind", "start", "end")


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (of the base spans), and the spans as arrays of
    (order of the kind, start, end, kind): base_spans, spans (base and contextual). Code points, end exclusive.

    Null or empty text: no spans. Repeated rows get equal results; null doc_id is a document like any other.
    Other columns are not read. An empty table gives an empty result.
    """
    shelf = Shelf(docs.sparkSession)
    keyed = docs.select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("body"), "text")
    texts = keyed.where("text <> ''").withColumn("doc", F.coalesce(F.col("doc").cast("string"), F.lit("null")))
    base = shelf.keep(base_spans(texts), "base")
    more = contextual_spans(texts, base, shelf)
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    spans = base.select(*KEY, "kind", "start", "end", F.lit(True).alias("of_base")).unionByName(
        more.distinct().withColumn("of_base", F.lit(False))
    )
    spans = spans.withColumn("span", F.struct(order.alias("order"), "start", "end", "kind"))
    found = spans.groupBy(*KEY).agg(
        *[F.count_if((F.col("kind") == k) & F.col("of_base")).alias(f"n_{k}") for k in KINDS],
        F.sort_array(F.collect_list(F.when(F.col("of_base"), F.col("span")))).alias("base_spans"),
        F.sort_array(F.collect_list("span")).alias("spans"),
    )
    none = F.array().cast("array<struct<order:bigint,start:bigint,end:bigint,kind:string>>")
    rows = keyed.select("doc", "body").withColumns({"__id": F.col("doc"), "doc": F.coalesce(F.col("doc").cast("string"), F.lit("null"))})
    return rows.join(found, KEY, "left").select(
        F.col("__id").alias("doc_id"),
        *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS],
        *[F.coalesce(c, none).alias(c) for c in ("base_spans", "spans")],
    )


def spelled(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
