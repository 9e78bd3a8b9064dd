"""License scan by diagonal voting, in DataFrame operations only.

Every rolling word pair of every text is hashed and joined (a broadcast of the
fixed template list) to the places where a template has the same pair.  A hit
at text word p and template word t lies on diagonal p - t; hits are counted by
(text, template, diagonal), neighbouring diagonals (a word put in or left out)
are merged into runs, and a stretch of a run no wider than the template is kept
when hits in rising order of text and template cover enough of the template.
A phrase of the base list counts only when its own diagonal is complete.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
COVERAGE = 0.75                 # share of a template's word pairs in a span
GAP = 2                         # diagonals at most this far apart are merged

# Phrases and labels of the base list.
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

# Notice texts (public license notices) and their labels; each
# has at most 63 word pairs.
NOTICES = [
    ("licensed under the apache license version 2.0", "apache-2.0"),
    ("you may not use this file except in compliance with the license", "apache-2.0"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
     "documentation files", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that "
     "the following conditions are met", "bsd"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general "
     "public license", "gpl"),
    ("licensed under cc by nc 4.0", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution 4.0 international license", "cc-by"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
]


def template_pairs(base, notices) -> list[tuple]:
    """One row per template word pair: template, its label, whether it is a
    base phrase, number of pairs, position, the two words."""
    rows = []
    for number, (text, label, is_base) in enumerate([(*x, True) for x in base] + [(*x, False) for x in notices]):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
        if not 2 <= len(words) <= 64:
            raise ValueError(f"a template needs 2 to 64 words: {text!r}")
        rows += [(number, label, is_base, len(words) - 1, i, a, b) for i, (a, b) in enumerate(zip(words, words[1:]))]
    return rows


def in_order(diagonals: str, pairs: str):
    """Length of the longest chain of hits whose places in the text and in the
    template both rise, over an array of (d, bits)."""
    hit = lambda d, t: F.struct((d + t).alias("p"), (-t).alias("back"))
    places = F.sequence(F.lit(0), F.col(pairs) - 1)
    hits = F.array_sort(F.flatten(F.transform(diagonals, lambda x: F.transform(
        F.filter(places, lambda t: F.getbit(x["bits"], t) == 1), lambda t: hit(x["d"], t)))))

    def longer(best, x):
        before = F.coalesce(F.array_max(F.slice(best, F.lit(1), -x["back"])), F.lit(0))
        return F.transform(best, lambda v, i: F.when(i == -x["back"], F.greatest(v, before + 1)).otherwise(v))

    return F.array_max(F.aggregate(hits, F.array_repeat(F.lit(0), F.col(pairs)), longer))


def scan_licenses(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  base=BASE, notices=NOTICES, coverage: float = COVERAGE) -> DataFrame:
    """One row per input row: its id, n_words, n_base, first_word, last_word,
    base_labels, labels, score.

    Defined cases: a null text counts as empty (n_words 0, no labels, score
    0); a null id stays null; repeated rows each give a row; other columns of
    the input are not read; an empty table gives an empty result.  ``score``
    is the best coverage of any stretch that was kept (1 for a base place).
    Word pairs out of the template's order do not count towards its coverage.
    """
    pairs = spark.createDataFrame(
        template_pairs(base, notices),
        "template int, label string, is_base boolean, pairs int, t int, ta string, tb string")
    # the mark gives each text one hit, so texts without any stay in the result
    pairs = pairs.withColumn("th", F.xxhash64("ta", "tb")).unionByName(spark.createDataFrame(
        [(-1, "", False, 0, 0, None, None, 0)],
        "template int, label string, is_base boolean, pairs int, t int, ta string, tb string, th long"))

    words = F.regexp_extract_all(F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER), F.lit(WORD), 0)
    gram = lambda a, b: F.struct(F.xxhash64(a, b).alias("h"), a.alias("a"), b.alias("b"))
    mark = F.array(F.struct(F.lit(0).cast("long").alias("h"), F.lit(None).cast("string").alias("a"),
                            F.lit(None).cast("string").alias("b")))
    n = F.size("w")
    rolled = F.when(n >= 2, F.zip_with(F.slice("w", F.lit(1), n - 1), F.slice("w", F.lit(2), n - 1), gram))
    text = (docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), words.alias("w"))
            .select("row", "id", n.alias("n_words"), F.posexplode(F.concat(mark, F.coalesce(rolled, F.slice(mark, 1, 0))))
                    .alias("p", "g")))
    hits = (text.join(F.broadcast(pairs), (F.col("g.h") == F.col("th"))
                      & (F.col("g.a").eqNullSafe(F.col("ta"))) & (F.col("g.b").eqNullSafe(F.col("tb"))))
            .withColumn("p", F.col("p") - 1))

    # votes by diagonal; a template's covered pairs are one bit each
    voted = (hits.withColumn("d", F.col("p") - F.col("t"))
             .groupBy("row", "id", "n_words", "template", "label", "is_base", "pairs", "d")
             .agg(F.bit_or(F.expr("shiftleft(1L, t)")).alias("bits")))
    order = Window.partitionBy("row", "template").orderBy("d")
    apart = F.coalesce(F.col("d") - F.lag("d").over(order) > GAP, F.lit(True))
    run = F.sum(apart.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # a run of neighbouring diagonals is verified stretch by stretch: from each
    # of its diagonals on, the diagonals at most pairs + GAP further
    most = max((len(re.findall(WORD, text)) for text, _ in [*base, *notices]), default=0) + GAP
    ahead = Window.partitionBy("row", "template", "run").orderBy("d").rangeBetween(Window.currentRow, most)
    stretch = F.filter("ahead", lambda x: x["d"] <= F.col("d") + F.col("pairs") + GAP)
    merged = (voted.withColumn("run", run).withColumn("ahead", F.collect_list(F.struct("d", "bits")).over(ahead))
              .withColumn("ahead", F.when(~F.col("is_base"), stretch)))
    votes = F.bit_count(F.aggregate("ahead", F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(x["bits"])))
    enough = F.try_divide(votes, F.col("pairs")) >= coverage
    share = F.when(F.col("is_base"), F.lit(1.0)).otherwise(F.try_divide(in_order("ahead", "pairs"), F.col("pairs")))
    merged = merged.withColumn("share", F.when(F.col("is_base") | enough, share))
    place = F.col("is_base") & (F.bit_count("bits") == F.col("pairs"))
    notice = ~F.col("is_base") & (F.col("share") >= coverage)
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("label")))), ",")
    return (merged.groupBy("row", "id", "n_words")
            .agg(F.count(F.when(place, 1)).alias("n_base"),
                 F.min(F.when(place, F.col("d"))).cast("long").alias("first_word"),
                 F.max(F.when(place, F.col("d"))).cast("long").alias("last_word"),
                 joined(place).alias("base_labels"), joined(place | notice).alias("labels"),
                 F.coalesce(F.max(F.when(place | notice, F.col("share"))), F.lit(0.0)).alias("score"))
            .select(F.col("id").alias(id_col), F.col("n_words").cast("long").alias("n_words"), "n_base", "first_word",
                    "last_word", "base_labels", "labels", F.col("score").cast("double").alias("score")))
