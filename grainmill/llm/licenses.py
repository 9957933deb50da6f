"""License scans by diagonal voting.

Every run of GRAM neighbouring words of every text meets the equal runs of the license templates in a Spark join. A
match votes for its diagonal, place in the text minus place in the template. Neighbouring diagonals (a word more or
less here and there) are merged into a span, and a span counts if the template words that it holds, compared word
for word, make up enough of the template and of the span.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainmill.llm.shelf import Shelf

#: Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: The notices that the licenses themselves ask for, and the usual one-line statements.
TEMPLATES = {
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software.",
        "Released under the MIT License",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is "
        "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "Licensed under the Apache License, Version 2.0",
    ],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
        "This work is licensed under the GNU General Public License, version 3",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation; either version 2.1 of the License, or "
        "(at your option) any later version.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: Redistributions of source code must retain the above copyright notice, this "
        "list of conditions and the following disclaimer.",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
    "cc-by": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0",
    ],
    "cc-by-sa": [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0",
    ],
    "cc-by-nc": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0",
    ],
}

#: What stands between words, once A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GRAM = 4
#: Diagonals this close belong to one span.
SLACK = 6
#: Least share of the template's words in the span, and of the span's words in the template.
SHARE = 0.8
#: Words of a text whose runs are spelled out at once.
STRETCH = 4096


def words_of(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    # lower() also folds other letters, but it is far quicker on texts that have none
    plain = F.octet_length(text) == F.char_length(text)
    folded = F.when(plain, F.lower(text)).otherwise(F.translate(text, upper, lower))
    return F.array_remove(F.split(folded, BETWEEN), "")


def runs_of(df: DataFrame, words: str, k: int) -> DataFrame:
    """Adds `at` (from 0) and `run`, an array of k neighbouring words, for each place of the array `words`."""
    rest = F.greatest(F.size(words), F.lit(1))
    side_by_side = F.arrays_zip(*[F.slice(words, d + 1, rest).alias(f"w{d}") for d in range(k)])
    out = df.select(*[c for c in df.columns if c != words], F.posexplode(side_by_side).alias("at", "side"))
    run = [F.col(f"side.{i}") for i in out.schema["side"].dataType.names]
    return out.where(run[-1].isNotNull()).withColumn("run", F.array(*run)).drop("side")


def places(words: Column, phrase: str) -> Column:
    """Numbers of the words at which a phrase starts."""
    parts = phrase.split(" ")
    some = F.contains(F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")), F.lit(f" {phrase} "))
    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - len(parts), F.lit(0)))
    here = lambda i: reduce(and_, [F.get(words, i + d) == p for d, p in enumerate(parts)])
    found = F.filter(starts, here)
    return F.when(some, F.transform(found, lambda i: i.cast("long"))).otherwise(F.array().cast("array<bigint>"))


def template_runs(spark, templates: Mapping[str, Sequence[str]], k: int) -> DataFrame:
    """(template, label, length, place, known) of all templates, a small table that follows from the parameter."""
    listed = [(label, text) for label, texts in templates.items() for text in texts]
    entries = F.array(
        *[
            F.struct(F.lit(i).alias("template"), F.lit(label).alias("label"), F.lit(text).alias("text"))
            for i, (label, text) in enumerate(listed)
        ]
    )
    words = spark.range(1).select(F.inline(entries)).withColumn("words", words_of(F.col("text")))
    words = words.select("template", "label", F.size("words").cast("long").alias("length"), "words")
    return runs_of(words, "words", k).withColumnsRenamed({"at": "place", "run": "known"})


def _hits(docs: DataFrame, known: DataFrame, k: int) -> DataFrame:
    """(doc, body, word, template, label, length, place): runs of words that a text shares with a template."""
    words = docs.select("doc", "body", words_of(F.col("text")).alias("words"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)), F.lit(STRETCH))
    cut = F.transform(
        starts, lambda s: F.struct(s.alias("start"), F.slice("words", s + 1, F.lit(STRETCH + k - 1)).alias("words"))
    )
    pieces = words.select("doc", "body", F.explode(cut).alias("piece")).select("doc", "body", "piece.start", "piece.words")
    runs = runs_of(pieces, "words", k).withColumn("hash", F.xxhash64("run"))
    known = F.broadcast(known.withColumn("hash", F.xxhash64("known")))  # as large as the templates, whatever the texts
    word = (F.col("start") + F.col("at")).cast("long").alias("word")
    own = ["template", "label", "length", "place"]
    return runs.join(known, "hash").where("run = known").select("doc", "body", word, *own)


def _spans(hits: DataFrame, k: int, slack: int, share: float) -> DataFrame:
    """(doc, body, label, template, first, end, votes, share): one row for each stretch that a template explains best."""
    text = ["doc", "body"]
    own = [*text, "template", "label", "length"]
    votes = hits.withColumn("diagonal", F.col("word") - F.col("place")).groupBy(*own, "diagonal")
    # rows that repeat a document give the same places again
    votes = votes.agg(F.collect_set("place").alias("places"))
    line = Window.partitionBy(*own).orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(line) > slack
    merged = votes.withColumn("new", F.coalesce(apart, F.lit(True)).cast("int"))
    merged = merged.withColumn("span", F.sum("new").over(line)).groupBy(*own, "span").agg(
        F.collect_list(F.struct("diagonal", "places")).alias("lines")
    )
    covered = lambda at: F.size(  # noqa: E731  words under runs that begin at these places
        F.array_distinct(F.flatten(F.transform(at, lambda p: F.sequence(p, p + (k - 1)))))
    )
    inside = F.array_distinct(F.flatten(F.col("lines.places")))
    text_places = F.flatten(F.transform("lines", lambda x: F.transform(x["places"], lambda p: p + x["diagonal"])))
    merged = merged.select(*own, inside.alias("at"), F.array_distinct(text_places).alias("text_at"))
    merged = merged.select(
        *own, F.size("at").alias("votes"), covered(F.col("at")).alias("known"), covered(F.col("text_at")).alias("held"),
        F.array_min("text_at").alias("first"), (F.array_max("text_at") + k).alias("end"),
    )
    merged = merged.withColumn("share", F.col("known") / F.col("length"))
    merged = merged.withColumn("dense", F.col("held") / (F.col("end") - F.col("first")))
    # overlapping spans tell of the same stretch: the one with most votes for its template's size explains it
    order = Window.partitionBy(*text).orderBy("first", "end", "template").rowsBetween(Window.unboundedPreceding, -1)
    islands = merged.withColumn("new", F.coalesce(F.col("first") >= F.max("end").over(order), F.lit(True)).cast("int"))
    running = Window.partitionBy(*text).orderBy("first", "end", "template").rowsBetween(Window.unboundedPreceding, 0)
    islands = islands.withColumn("island", F.sum("new").over(running))
    full = F.col("votes") / (F.col("length") - (k - 1))
    sure = (F.col("share") >= share) & (F.col("dense") >= share)
    best = Window.partitionBy(*text, "island").orderBy(F.desc("sure"), F.desc("full"), F.desc("votes"), "template")
    ranked = islands.withColumns({"full": full, "sure": sure}).withColumn("rank", F.row_number().over(best))
    return ranked.where("rank = 1").select(*text, "label", "template", "first", "end", "votes", "share", "sure")


def scan_licenses(
    docs: DataFrame,
    phrases: Mapping[str, str] = PHRASES,
    templates: Mapping[str, Sequence[str]] = TEMPLATES,
    gram: int = GRAM,
    slack: int = SLACK,
    share: float = SHARE,
) -> DataFrame:
    """(doc_id, n_words, base, spans, score), one row per row of `docs`; reads doc_id and text alone.

    `base` lists (label, phrase, words): the words, counted from 0, at which a phrase of `phrases` starts. `spans` lists
    (label, first, end, share, sure): stretches of words that look like a template, and whether the template words
    in them reach `share` of the template and of the stretch. `score`: 1 with a phrase, else the largest share of a
    stretch, 0 without one. Templates need at least `gram` words; shorter ones match nothing.

    Words are runs of characters other than ASCII signs and controls, A-Z lower-cased. Null and empty texts have none,
    no labels and score 0. A null doc_id is an id like any other. Rows with equal id and text get equal results, rows with
    equal ids and different texts are apart. An empty table gives an empty result.
    """
    shelf = Shelf(docs.sparkSession)
    texts = docs.select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("body"), "text")
    words = texts.select("doc", "body", words_of(F.col("text")).alias("words"))
    base = F.array(
        *[
            F.struct(F.lit(label).alias("label"), F.lit(phrase).alias("phrase"), places(F.col("words"), phrase).alias("words"))
            for phrase, label in phrases.items()
        ]
    )
    scanned = words.select("doc", "body", F.size("words").cast("long").alias("n_words"), base.alias("base"))
    scanned = scanned.withColumn("base", F.filter("base", lambda b: F.size(b["words"]) > 0))
    hits = shelf.keep(_hits(texts, template_runs(docs.sparkSession, templates, gram), gram), "hits")
    spans = _spans(hits, gram, slack, share).groupBy("doc", "body").agg(
        F.sort_array(F.collect_list(F.struct("first", "end", "label", "share", "sure"))).alias("spans")
    )
    spans = shelf.keep(spans.select(F.col("doc").alias("d"), F.col("body").alias("b"), "spans"), "spans")
    shelf.drop("hits")
    found = scanned.join(spans, scanned["doc"].eqNullSafe(spans["d"]) & (scanned["body"] == spans["b"]), "left")
    most = F.coalesce(F.array_max(F.transform("spans", lambda s: s["share"])), F.lit(0.0))
    nothing = F.array().cast("array<struct<first:bigint,end:bigint,label:string,share:double,sure:boolean>>")
    return found.select(
        F.col("doc").alias("doc_id"), "n_words", "base", F.coalesce("spans", nothing).alias("spans"),
        F.when(F.size("base") > 0, 1.0).otherwise(most).alias("score"),
    )
