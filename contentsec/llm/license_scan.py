"""License scans by diagonal voting, DataFrame functions only.

Every rolling 3-word gram of every text is hashed; those whose hash is a template gram's, a test inside the row, are joined
to the grams of the license templates. A hit votes for the diagonal (place in the text minus place in the template) on
which the whole template would lie. Votes are summed by diagonal; diagonals at most DRIFT apart, as insertions and
deletions leave them, are merged into one span, which is WIDE diagonals wide at most. A span is verified by aligning it:
each place of the template is looked for once, on the span's strongest diagonal that has it, and counts if it stands
behind all places before it in the text; the share of the template's grams that count decides. The words themselves are
compared in the join, so a hash collision gives no vote. Templates are a fixed list in this file, which bounds what is
broadcast.

Texts are read once; what is written out of it is a row for each text with its few candidate grams. Null text is empty: no
words, null places, empty labels, score 0. Rows with the same doc_id and text get the same result each, however many they
are; a null doc_id is an id. Texts are read whole. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contentsec.llm.common import materialize

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same characters, named by what they are: Java takes a tenth of the time.
JAVA_WORD = r"[0-9a-z\x80-\x{10FFFF}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GRAM, DRIFT, WIDE, SHARE = 3, 3, 24, 0.6
#: (label, words, kind). base and short phrases must stand whole; of long ones SHARE of the grams.
TEMPLATES = (
    ("mit", "under the mit license", "base"),
    ("apache-2", "apache license version 2", "base"),
    ("cc-by-nc", "cc by nc", "base"),
    ("mit", "licensed under the mit license", "short"),
    ("gpl-3", "gnu general public license version 3", "short"),
    ("gpl-2", "gnu general public license version 2", "short"),
    ("lgpl", "gnu lesser general public license", "short"),
    ("agpl-3", "gnu affero general public license version 3", "short"),
    ("mpl-2", "mozilla public license version 2", "short"),
    ("cc-by-sa", "cc by sa", "short"),
    ("bsd", "under the bsd license", "short"),
    ("epl-2", "eclipse public license version 2", "short"),
    ("epl-2", "eclipse public license v 2 0", "short"),
    ("cc-by", "creative commons attribution 4 0 international", "short"),
    ("cc-by-sa", "creative commons attribution sharealike 4 0 international", "short"),
    ("cc-by-nd", "cc by nd", "short"),
    ("cc0", "cc0 1 0 universal", "short"),
    ("isc", "under the isc license", "short"),
    ("zlib", "under the zlib license", "short"),
    ("bsl-1", "boost software license version 1", "short"),
    ("unlicense", "released into the public domain", "short"),
    ("apache-2", "spdx license identifier apache 2 0", "short"),
    ("mit", "spdx license identifier mit", "short"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", "long"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", "long"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "long"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "long"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "long"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "long"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "long"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", "long"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "long"),
    ("bsl-1", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "long"),
)


def template_grams() -> list[tuple[int, str, str, int, int, str, str, str]]:
    """(template, label, kind, grams in it, place, its three words)."""
    rows = []
    for t, (label, phrase, kind) in enumerate(TEMPLATES):
        w = phrase.split()
        rows += [(t, label, kind, len(w) - GRAM + 1, i, *w[i : i + GRAM]) for i in range(len(w) - GRAM + 1)]
    return rows


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(JAVA_WORD), F.lit(0))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, n_words, grams array<struct<at, a, b, c>>), one row for each row of docs, written out: the rolling
    grams that have a template gram's hash. Only behind a template gram's first word a gram is looked at at all."""
    known = template_grams()
    firsts, hashes = sorted({g[5] for g in known}), F.array(*(F.xxhash64(F.lit(a), F.lit(b), F.lit(c)) for a, b, c in sorted({g[5:] for g in known})))
    lists = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text_col).alias("text_key"), words_of(F.col(text_col)).alias("w"))
    n = F.size("w")
    starts = F.filter(F.sequence(F.lit(0), n - GRAM), lambda i: F.get("w", i).isin(*firsts))
    grams = F.transform(starts, lambda i: F.struct(i.alias("at"), F.get("w", i).alias("a"), F.get("w", i + 1).alias("b"), F.get("w", i + 2).alias("c")))
    grams = F.filter(grams, lambda g: F.array_contains(hashes, F.xxhash64(g["a"], g["b"], g["c"])))
    return materialize(lists.select("doc_id", "text_key", n.cast("bigint").alias("n_words"), F.when(n >= GRAM, grams).alias("grams")), "grams")


def hits(found: DataFrame) -> DataFrame:
    """(doc_id, text_key, template, label, kind, grams, diagonal, place, at): the votes of candidates(), each once for a
    text however many rows have it."""
    grams = found.filter(F.size("grams") > 0).dropDuplicates(["doc_id", "text_key"]).select("doc_id", "text_key", F.explode("grams").alias("g")).select("doc_id", "text_key", "g.*")
    known = found.sparkSession.createDataFrame(template_grams(), "template int, label string, kind string, grams int, place int, x string, y string, z string")
    same = (F.xxhash64("a", "b", "c") == F.xxhash64("x", "y", "z")) & (F.col("a") == F.col("x")) & (F.col("b") == F.col("y")) & (F.col("c") == F.col("z"))
    return grams.join(F.broadcast(known), same).select("doc_id", "text_key", "template", "label", "kind", "grams", (F.col("at") - F.col("place")).alias("diagonal"), "place", "at")


def spans(votes: DataFrame) -> DataFrame:
    """(doc_id, text_key, template, label, kind, start, share): merged diagonals with the share of grams that align."""
    doc = ["doc_id", "text_key", "template", "label", "kind", "grams"]
    lines = votes.groupBy(*doc, "diagonal").agg(F.collect_list(F.struct("place", "at")).alias("hits"), F.count("*").alias("n"))
    order = Window.partitionBy(*doc).orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(order) > F.when(F.col("kind") == "long", DRIFT).otherwise(0)
    chains = lines.withColumn("chain", F.sum(F.coalesce(apart.cast("int"), F.lit(1))).over(order))
    chains = chains.withColumn("part", F.floor((F.col("diagonal") - F.min("diagonal").over(Window.partitionBy(*doc, "chain"))) / WIDE))
    run = [*doc, "chain", "part"]
    places = chains.select(*run, "diagonal", "n", F.explode("hits").alias("x")).groupBy(*run, "x.place").agg(F.min("diagonal").alias("least"), F.min(F.struct(-F.col("n"), "diagonal", "x.at")).alias("best"))
    before = F.max("best.at").over(Window.partitionBy(*run).orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    aligned = places.select(*run, "least", (F.col("best.at") > F.coalesce(before, F.lit(-1))).alias("rises"))
    share = F.count(F.when(F.col("rises"), 1)) / F.col("grams")
    return aligned.groupBy(*run).agg(F.min("least").alias("start"), share.alias("share")).drop("chain", "part")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), one row for each row of docs.

    score is the greatest share of a template's grams that align on one span; labels are those of verified spans."""
    rows = candidates(docs, id_col, text_col)
    found = spans(hits(rows))
    good = F.when(F.col("kind") == "long", F.col("share") >= SHARE).otherwise(F.col("share") >= 1)
    base = good & (F.col("kind") == "base")
    joined = lambda when: F.array_join(F.sort_array(F.collect_set(F.when(when, F.col("label")))), ",")  # noqa: E731  at most one for each template
    per = found.groupBy("doc_id", "text_key").agg(F.count(F.when(base, 1)).alias("n_base"), F.min(F.when(base, F.col("start"))).alias("first_word"), F.max(F.when(base, F.col("start"))).alias("last_word"), joined(base).alias("base_labels"), joined(good).alias("labels"), F.max("share").alias("score"))
    per = materialize(per.withColumnsRenamed({"doc_id": "_id", "text_key": "_key"}), "licenses")
    rows = rows.join(per, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left")
    whole = lambda c: F.col(c).cast("bigint").alias(c)
    return rows.select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("bigint").alias("n_base"), whole("first_word"), whole("last_word"), F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
