"""License texts and phrases in documents, by diagonal voting; DataFrame expressions only.

Every run of `GRAM` words in a row is joined, by its hash and then by its words, with the places that it has in templates. A hit
at word i of the document and word j of the template votes for the diagonal i - j. Votes are aggregated by diagonal before
anything else; diagonals of a template that lie at most `SHIFT` words apart (a word put in or left out moves the rest of a text
to the next diagonal) merge into a span. A span is verified by its words: those of the template that it has, and in their
place, must be `COVERAGE` percent of the template and all of its numbers (versions), and `DENSITY` percent of the span. Where
spans overlap, the one with most words of its template counts (then the one with the greatest share), so a text is not told for the shorter one that it contains.

A phrase is a template whose words must all stand on one diagonal.

The join's other side is the templates' word runs, `HELD` at most where they are sent to every task. One more row goes
along for each document, so that the table is read once and documents without hits stay; it carries numbers alone, no text. Rows that
repeat an id and a text are merged before the shuffle, counted, and put out again, so masses of equal rows meet in no task.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, whole

GRAM = 3
SHIFT = 6
COVERAGE = 80
DENSITY = 60
#: Votes that a diagonal needs to take part in a span.
VOTES = 2
#: Characters of all templates up to which their word runs go to every task (a run for each word).
HELD = 2_000_000
#: Rows that one row is put out as at a time.
_CHUNK = 10_000

#: Phrases and their labels (fixed values).
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Notices of public licenses and their labels (fixed values).
NOTICES = (
    ("licensed under the MIT license", "mit"),
    (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
        "mit",
    ),
    ("licensed under the Apache License, Version 2.0", "apache-2"),
    ("Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at", "apache-2"),
    (
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License",
        "apache-2",
    ),
    ("licensed under the GNU General Public License", "gpl"),
    ("licensed under the GNU General Public License version 2", "gpl-2"),
    ("licensed under the GNU General Public License version 3", "gpl-3"),
    ("licensed under the GNU Lesser General Public License version 2.1", "lgpl-2.1"),
    ("licensed under the GNU Lesser General Public License version 3", "lgpl-3"),
    ("licensed under the GNU Affero General Public License version 3", "agpl-3"),
    ("redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version", "gpl-2"),
    ("redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", "gpl-3"),
    ("redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version", "lgpl-2.1"),
    ("redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", "agpl-3"),
    ("licensed under the Mozilla Public License version 2.0", "mpl-2"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", "mpl-2"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "bsd"),
    ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "bsd-3"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", "isc"),
    (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
        "for any purpose, commercial or non-commercial, and by any means",
        "unlicense",
    ),
    (
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",
        "zlib",
    ),
    ("licensed under a Creative Commons Attribution 4.0 International License", "cc-by"),
    ("licensed under a Creative Commons Attribution ShareAlike 4.0 International License", "cc-by-sa"),
    ("licensed under a Creative Commons Attribution NonCommercial 4.0 International License", "cc-by-nc"),
    ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "cc0"),
)

_KEY = ("doc_id", "_h1", "_h2", "n_words")


def words(text: Column) -> Column:
    """Words of a text: runs of ASCII letters and digits and of all other characters beyond ASCII, A-Z as a-z."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _grams(column: str) -> Column:
    """For each word the run of `GRAM` words that starts there; the last ones are shorter."""
    return F.transform(column, lambda w, i: F.concat_ws(" ", w, *[F.get(F.col(column), i + k) for k in range(1, GRAM)]))


def templates(spark: SparkSession, notices: Iterable[tuple[str, str]] = NOTICES, phrases: Iterable[tuple[str, str]] = PHRASES) -> DataFrame:
    """(template, label, phrase, length, needed, words) of each (text, label); needed are the places of numbers.

    A text of fewer than `GRAM` words cannot be found and is an error.
    """
    rows = [(t, label, flag, text) for t, (flag, text, label) in enumerate([*((True, *x) for x in phrases), *((False, *x) for x in notices)])]
    texts = spark.createDataFrame(rows, "template int, label string, phrase boolean, text string").withColumn("words", words(F.col("text")))
    n = F.size("words")
    numbers = F.filter(F.transform("words", lambda w, i: F.when(w.rlike("^[0-9]+$"), i)), lambda i: i.isNotNull())
    short = F.raise_error(F.concat(F.lit("too few words: "), F.col("text"))).cast("int")
    return texts.select("template", "label", "phrase", F.when(n < GRAM, short).otherwise(n).alias("length"), numbers.alias("needed"), "words")


def _votes(docs: DataFrame, places: DataFrame, held: bool) -> DataFrame:
    """(key, template, d, at, rows): the words where runs on diagonal d start, and how many equal rows the document has.

    Template -1 has one row for each document.
    """
    text = whole()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("_h1"), F.xxhash64(F.lit(GRAM), text).alias("_h2"), words(text).alias("_words"))
    rows = rows.withColumn("n_words", F.size("_words").cast("long"))
    # the run without a word stands for the document itself
    runs = rows.select(*_KEY, F.posexplode(F.concat(_grams("_words"), F.array(F.lit("")))).alias("i", "gram"))
    known = places.select("template", F.posexplode(F.slice(_grams("words"), F.lit(1), F.col("length") - (GRAM - 1))).alias("j", "gram"))
    known = known.union(docs.sparkSession.range(1).select(F.lit(-1), F.lit(0), F.lit("")))
    known = known.withColumn("_hash", F.xxhash64("gram"))
    hits = runs.withColumn("_hash", F.xxhash64("gram")).join(F.broadcast(known) if held else known, ["_hash", "gram"])
    return hits.groupBy(*_KEY, "template", (F.col("i") - F.col("j")).alias("d")).agg(F.collect_set("i").alias("at"), F.count(F.lit(1)).alias("rows"))


def _spans(votes: DataFrame, about: DataFrame) -> DataFrame:
    """(key, label, first, last, words, share) of verified spans, the best of each chain of overlapping ones."""
    diagonals = votes.where(F.size("at") >= VOTES).join(F.broadcast(about.where("not phrase")), "template")
    order = Window.partitionBy(*_KEY, "template").orderBy("d")
    far = F.coalesce(F.col("d") - F.lag("d").over(order) > SHIFT, F.lit(True))
    diagonals = diagonals.withColumn("far", far.cast("int")).withColumn("span", F.sum("far").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    covered = F.array_distinct(F.flatten(F.transform("at", lambda i: F.sequence(i - F.col("d"), i - F.col("d") + (GRAM - 1)))))
    diagonals = diagonals.withColumn("first", F.array_min("at")).withColumn("last", F.array_max("at") + (GRAM - 1)).withColumn("covered", covered)
    each = diagonals.select("*", F.posexplode("covered").alias("k", "j"))
    spans = each.groupBy(*_KEY, "template", "span").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.collect_set("j").alias("have"), F.sum(F.when(F.col("k") == 0, F.size("covered")).otherwise(0)).alias("matched"),
    )
    spans = spans.join(F.broadcast(about), "template").withColumn("words", F.size("have"))
    whole_enough = F.col("words") * 100 >= F.col("length") * COVERAGE
    dense = F.col("matched") * 100 >= (F.col("last") - F.col("first") + 1) * DENSITY
    spans = spans.where(whole_enough & dense & (F.size(F.array_except("needed", "have")) == 0))
    # chains of overlapping spans; the one with most words of its template, then with the greatest share, stands for its chain
    order = Window.partitionBy(*_KEY).orderBy("first", "last", "template")
    before = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("new", F.coalesce(F.col("first") > before, F.lit(True)).cast("int"))
    spans = spans.withColumn("chain", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    spans = spans.withColumn("share", F.col("words") / F.col("length")).withColumn("rank", F.struct("words", "share"))
    spans = spans.withColumn("best", F.max("rank").over(Window.partitionBy(*_KEY, "chain"))).where("rank = best")
    return spans.select(*_KEY, "label", "first", "last", "share", F.lit(False).alias("phrase"))


def find(docs: DataFrame, notices: Iterable[tuple[str, str]] = NOTICES, phrases: Iterable[tuple[str, str]] = PHRASES) -> DataFrame:
    """(doc_id, n_words, found) of each row of documents; found holds the label, first and last word, share and phrase flag of each place.

    notices and phrases are (text, label). Words are numbered from 0; phrases that overlap all count. A null text is an empty
    one, with no words and no places; a null doc_id stays null; rows that repeat an id and a text each have their row; other
    columns take no part. Spans of a chain that are equally good all stay. An empty table gives none. A text is split into
    words where it is read; from there on a task holds the hits of one document and template at a time, by diagonal.
    """
    notices, phrases = list(notices), list(phrases)
    about = templates(docs.sparkSession, notices, phrases)
    votes = stored(_votes(docs, about, sum(len(x) for x, _ in [*notices, *phrases]) <= HELD), "votes")
    about = about.drop("words")
    full = votes.where("template >= 0").join(F.broadcast(about.where("phrase")), "template").where(F.size("at") == F.col("length") - (GRAM - 1))
    exact = full.select(*_KEY, "label", F.col("d").alias("first"), (F.col("d") + F.col("length") - 1).alias("last"), F.lit(1.0).alias("share"), "phrase")
    found = exact.unionByName(_spans(votes.where("template >= 0"), about))
    place = F.struct("first", "last", "label", "share", "phrase")
    both = found.select(*_KEY, place.alias("place"), F.lit(None).cast("long").alias("rows")).unionByName(votes.where("template < 0").select(*_KEY, F.lit(None).alias("place"), "rows"), allowMissingColumns=True)
    merged = both.groupBy(*_KEY).agg(F.max("rows").alias("rows"), F.array_sort(F.collect_set("place")).alias("found"))
    many = merged.select("*", F.explode(F.sequence(F.lit(0), (F.col("rows") - 1).cast("long"), F.lit(_CHUNK).cast("long"))).alias("past"))
    return many.select("doc_id", "n_words", "found", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(_CHUNK).cast("long"), F.col("rows") - F.col("past")))).alias("_copy")).drop("_copy")


def digest(found: DataFrame) -> DataFrame:
    """Counts, first and last place of the phrases, their labels and those of all places, and the greatest share."""
    exact = F.filter("found", lambda p: p.phrase)
    named = lambda places: F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p.label))), ",")
    starts = F.transform(exact, lambda p: p.first.cast("long"))
    return found.select(
        "doc_id", "n_words", F.size(exact).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), named(exact).alias("base_labels"),
        named(F.col("found")).alias("labels"), F.coalesce(F.array_max(F.transform("found", lambda p: p.share)), F.lit(0.0)).alias("score"),
    )
