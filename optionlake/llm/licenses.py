"""License scan: phrases, and an exact set-similarity join of text blocks with license templates.

A block is a line. It holds a template when at least THRESHOLD of the template's
distinct words are in it. Words are ordered by their count over all blocks,
rarest first; a block that holds a template then shares one of its first few
words, is long enough, and has enough words left after the shared one. Blocks
that pass these filters are compared exactly. Everything is Catalyst.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
#: Template words up to which the join sends them to all executors.
MOST_BROADCAST = 10_000

# Phrases and the label of each; words are runs of digits, letters and anything beyond ASCII.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
SEPARATOR, WORD = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
# Notices that projects put on top of a text, and the label of each.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("mit", "released under the mit license"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl-2.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("agpl-3.0", "licensed under the gnu affero general public license version 3"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    ("cc-by-4.0", "licensed under cc by 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights to this work"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)


def _lower(text: Column) -> Column:
    """Lower case in which only A-Z turn into a-z: two other letters would, and are put out of the way."""
    for other in "Kİ":
        text = F.replace(text, F.lit(other), F.lit("ß"))
    return F.lower(text)


def _phrase(phrase: str) -> str:
    """Pattern of a phrase. What precedes it is looked at after its first letter: few places have that letter."""
    first, rest = phrase[0], f"[{SEPARATOR}]+".join(phrase[1:].split(" "))
    return rf"(?i){first}(?<![^{SEPARATOR}]{first}){rest}(?![^{SEPARATOR}])"


def _blocks(text: Column, words: list[str]) -> Column:
    """Per line, which of ``words`` are in it, in their order."""
    listed = F.array(*[F.lit(w) for w in words])
    return F.transform(F.split(_lower(text), "\n"), lambda line: F.array_intersect(listed, F.split(line, f"[{SEPARATOR}]+")))


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"))


def _need(n: int, threshold: float) -> int:
    """Least number of shared words: the integer ceiling of threshold * n, safe from rounding."""
    return -int(-n * round(threshold * 1000) // 1000)


def word_order(docs: DataFrame, templates) -> list[str]:
    """All template words, rarest over the blocks of ``docs`` first. There are as many as the templates have, not the corpus."""
    words = sorted({w for _, t in templates for w in t.split(" ")})
    blocks = _texts(docs).select(F.explode(_blocks(F.col("text"), words)).alias("own")).where(F.size("own") > 0)
    counted = blocks.select(F.explode("own").alias("word")).groupBy("word").count().collect()
    count = {r.word: r["count"] for r in counted}
    return sorted(words, key=lambda w: (count.get(w, 0), w))


def contained(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, digest, label, containment): every block, template pair at or over the threshold, best per label."""
    order = word_order(docs, templates)
    rank = {w: k for k, w in enumerate(order)}
    sets = [(label, sorted({rank[w] for w in t.split(" ")})) for label, t in templates]
    prefix = [
        (rank_, number, at, len(words), _need(len(words), threshold), label, [order[k] for k in words])
        for number, (label, words) in enumerate(sets) for at, rank_ in enumerate(words[: len(words) - _need(len(words), threshold) + 1])
    ]
    spark = docs.sparkSession
    heads = spark.createDataFrame(
        [(order[r], *rest) for r, *rest in prefix], "word string, template int, at int, size int, need int, label string, words array<string>"
    )
    if len(prefix) <= MOST_BROADCAST:  # known before the join: it is the number of template words, not of blocks
        heads = F.broadcast(heads)
    least = min(_need(len(words), threshold) for _, words in sets)
    blocks = _texts(docs).select("doc_id", F.xxhash64("text").alias("digest"), F.posexplode(_blocks(F.col("text"), order)).alias("line", "own"))
    probes = blocks.where(F.size("own") >= least).select("doc_id", "digest", "line", "own", F.posexplode("own").alias("own_at", "word"))
    left = F.least(F.size("own") - F.col("own_at"), F.col("size") - F.col("at"))
    met = probes.join(heads, "word").where((F.size("own") >= F.col("need")) & (left >= F.col("need")))
    share = F.size(F.array_intersect("own", "words"))
    checked = met.withColumn("shared", share).where("shared >= need")
    return checked.groupBy("doc_id", "digest", "label").agg(F.max(F.col("shared") / F.col("size")).alias("containment"))


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """A row per document: n_words, phrase counts and places, base_labels, labels, score.

    The score is the best containment of a template, 1 where a phrase stands. A
    null text counts as empty; repeated rows get equal results.
    """
    t = F.col("text")
    words = lambda c: F.regexp_count(c, F.lit(WORD)).cast("bigint")
    rows = _texts(docs).withColumn("digest", F.xxhash64("text"))
    firsts, lasts, counts, labels = [], [], [], []
    for phrase, label in PHRASES:
        pattern = _phrase(phrase)
        pieces = F.split(t, pattern, -1)
        any_ = t.rlike(pattern)
        counts.append(F.when(any_, F.size(pieces) - 1).otherwise(0))
        firsts.append(F.when(any_, words(F.get(pieces, F.lit(0)))))
        lasts.append(F.when(any_, words(t) - words(F.element_at(pieces, -1)) - len(phrase.split(" "))))
        labels.append(F.when(any_, F.lit(label)))
    n_base = counts[0]
    for c in counts[1:]:
        n_base = n_base + c
    found = rows.select(
        "doc_id", "digest", words(t).alias("n_words"), n_base.cast("bigint").alias("n_base"), F.least(*firsts).alias("first_word"),
        F.greatest(*lasts).alias("last_word"), F.array_compact(F.array(*labels)).alias("base"),
    )
    more = contained(docs, templates, threshold).groupBy("doc_id", "digest").agg(
        F.collect_set("label").alias("more"), F.max("containment").alias("best")  # as many as there are templates at most
    )
    joined = found.join(
        more.toDF("_id", "_digest", "more", "best"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left"
    )
    listed = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", listed(F.col("base")).alias("base_labels"),
        listed(F.concat("base", F.coalesce("more", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
