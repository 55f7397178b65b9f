"""License scans by diagonal voting: word k-gram hashes joined to template positions.

Every k-gram of a text is joined to the places where it stands in the templates. A hit votes for its diagonal
(place in the text less place in the template); the votes of a diagonal give the template words that it
matches, and neighbouring diagonals of one template are merged (an inserted or lost word moves the rest by one) by
window functions over the sorted diagonals, so a text costs in proportion to its hits. A merged span whose votes cover
enough of the template is verified on the words of the text themselves: its score is the share of words that template
and span have in common, so words put in between lower it. Of overlapping spans the best counts.

Joining on the k-gram beside its hash makes every vote an exact match. The templates are a fixed table of a few hundred
rows, which is broadcast.

Defined cases: a null text is empty and gets n_words 0; a text without hits gets a row with null places, no
labels and score 0; repeated rows (same id and text) each get the same result; a null doc_id is an id of
its own; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ascii_lower, doc_key, let, materialise, text_of

#: The phrases and labels of the base scan.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Notices of public licenses that the method looks for beyond the base, allowing for edits (63 words at most).
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license": "apache-2",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache-2",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl",
    "this work is licensed under the gnu general public license version 3": "gpl-3",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation": "lgpl",
    "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation": "agpl",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2",
    "this program and the accompanying materials are made available under the terms of the eclipse public license": "epl",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software": "zlib",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license": "boost",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc",
    "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work": "cc0",
}
K = 3
#: Diagonals this close are one span; votes that a diagonal, or one as close to it, must have.
NEAR, VOTES = 3, 2
#: The least share of a notice's words that votes must cover, and the least score.
COVER, SCORE = 0.6, 0.75


def _words() -> Column:
    """The words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z in lower case."""
    return F.filter(F.split(ascii_lower(text_of()), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), lambda w: w != "")


def _templates(spark) -> DataFrame:
    """A row for each k-gram place of each template."""
    rows = []
    for number, (phrase, label, exact) in enumerate([(p, b, True) for p, b in BASE.items()] + [(p, b, False) for p, b in NOTICES.items()]):
        words = phrase.split()
        rows += [(number, label, exact, len(words), i, " ".join(words[i : i + K])) for i in range(len(words) - K + 1)]
    return spark.createDataFrame(rows, "t int, label string, exact boolean, t_words int, t_pos int, gram string").withColumn("h", F.xxhash64("gram"))


def _key() -> list[Column]:
    return [doc_key().alias("doc"), F.xxhash64(text_of()).alias("k")]


def votes(docs: DataFrame) -> DataFrame:
    """doc, k, t, label, exact, t_words, diag, mask: the diagonals with hits; mask has a bit a voting place of the template.
    Rows equal in id and text are one text here."""
    gram_of = lambda w: F.transform(F.slice(w, 1, F.greatest(F.size(w) - (K - 1), F.lit(0))), lambda x, i: F.concat_ws(" ", x, *(F.get(w, i + j) for j in range(1, K))))
    each = docs.select(*_key(), F.posexplode(let(_words(), gram_of)).alias("pos", "gram")).withColumn("h", F.xxhash64("gram"))
    hits = each.join(F.broadcast(_templates(docs.sparkSession)), ["h", "gram"])
    bit = F.expr("shiftleft(1L, t_pos)")
    return hits.groupBy("doc", "k", "t", "label", "exact", "t_words", (F.col("pos") - F.col("t_pos")).alias("diag")).agg(F.bit_or(bit).alias("mask"))


def merged(diagonals: DataFrame) -> DataFrame:
    """doc, k, t, label, t_words, low, high (diagonals), start, end (words of the text) of the runs of neighbouring
    diagonals that cover enough of their template."""
    lowest = F.expr("length(bin(mask & -mask)) - 1")
    highest = F.expr("length(bin(mask)) - 1")
    order = W.partitionBy("doc", "k", "t").orderBy("diag")
    d = diagonals.where(~F.col("exact")).withColumns({"start": F.col("diag") + lowest, "end": F.col("diag") + highest + K})
    # a single vote counts only beside a diagonal of several
    d = d.withColumn("strong", F.max(F.bit_count("mask")).over(order.rangeBetween(-NEAR, NEAR)) >= VOTES).where("strong").drop("strong")
    d = d.withColumn("far", (F.col("diag") - F.lag("diag").over(order) > NEAR).cast("int"))
    d = d.withColumn("run", F.sum(F.coalesce("far", F.lit(0))).over(order.rowsBetween(W.unboundedPreceding, 0)))
    runs = d.groupBy("doc", "k", "t", "label", "t_words", "run").agg(F.min("diag").alias("low"), F.max("diag").alias("high"), F.min("start").alias("start"), F.max("end").alias("end"), F.bit_or("mask").alias("mask"))
    spread = " | ".join(f"shiftleft(mask, {i})" for i in range(K))
    return runs.where(F.bit_count(F.expr(f"({spread})")) >= COVER * F.col("t_words")).drop("mask", "run")


def _verified(words: Column, span: Column) -> Column:
    """The share of words that a span and its template have in common."""
    templates = F.array(*(F.split(F.lit(p), " ") for p in [*BASE, *NOTICES]))
    template = F.get(templates, span.t)

    def stands(word: Column, i: Column) -> Column:
        low, high = F.greatest(span.low + i, span.start), F.least(span.high + i, span.end - 1)
        return (high >= low) & F.array_contains(F.slice(words, F.greatest(low, F.lit(0)) + 1, F.greatest(high - low + 1, F.lit(0))), word)

    same = F.size(F.filter(template, lambda w, i: F.coalesce(stands(w, i), F.lit(False))))
    return 2 * same / (span.t_words + span.end - span.start)


def _best(spans: Column) -> Column:
    """labels and the best score of verified spans (start, end, label, score), sorted: of spans that overlap, one counts."""
    zero = F.expr("named_struct('end', -1, 'label', cast(null as string), 'score', 0D, 'labels', cast(array() as array<string>), 'top', 0D)")
    kept = lambda acc: F.when(acc.label.isNull(), acc.labels).otherwise(F.array_union(acc.labels, F.array(acc.label)))

    def add(acc: Column, s: Column) -> Column:
        overlaps = s.start < acc.end
        better = ~overlaps | (s.score > acc.score)
        return F.struct(F.greatest(acc.end, s.end).alias("end"), F.when(better, s.label).otherwise(acc.label).alias("label"), F.when(better, s.score).otherwise(acc.score).alias("score"),
                        F.when(overlaps, acc.labels).otherwise(kept(acc)).alias("labels"), F.greatest(acc.top, s.score).alias("top"))

    return F.aggregate(spans, zero, add, lambda acc: F.struct(kept(acc).alias("labels"), acc.top.alias("score")))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every document."""
    # of rows equal in id and text each hit stands once: they vote as one text and share its result
    diagonals = materialise(votes(docs), "diagonals")  # both branches below read it: the texts are scanned once
    whole = diagonals.where(F.col("exact") & (F.bit_count("mask") == F.col("t_words") - (K - 1))).groupBy("doc", "k").agg(
        F.count("*").alias("n_base"), F.min("diag").cast("long").alias("first_word"), F.max("diag").cast("long").alias("last_word"), F.sort_array(F.collect_set("label")).alias("base_labels"))
    spans = merged(diagonals).groupBy("doc", "k").agg(F.collect_list(F.struct("start", "end", "label", "t", "t_words", "low", "high")).alias("spans"))

    def judged(words: Column) -> Column:
        scored = F.transform("spans", lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), s.label.alias("label"), _verified(words, s).alias("score")))
        return _best(F.sort_array(F.filter(scored, lambda s: s.score >= SCORE)))

    # only texts with spans are cut into words again; texts themselves are joined, not their words
    met = docs.select(*_key(), "text").join(spans, ["doc", "k"])
    more = met.select("doc", "k", let(_words(), judged).alias("more")).dropDuplicates(["doc", "k"])
    rows = docs.select("doc_id", *_key(), F.size(_words()).cast("long").alias("n_words")).join(whole.join(more, ["doc", "k"], "full"), ["doc", "k"], "left")
    none = F.array().cast("array<string>")
    out = rows.select("doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", none).alias("base"), "more")
    every = F.sort_array(F.array_union(F.col("base"), F.coalesce("more.labels", none)))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("more.score", F.lit(0.0)))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), score.alias("score"))
