"""License scans: license phrases, and an exact set-similarity join of text blocks with license templates, with DataFrame functions only.

A text is cut into overlapping blocks of words, across its lines: for templates of up to 8, 16 or 32 words (and so on) blocks of twice that number begin every so
many words, so that each run of words as long as the template lies in one. A block matches a template if it has at least 0.8 of the template's distinct
words and all those that tell it from its neighbours; of the templates that a block matches, the one that fits best counts (by containment, then by its number of words). Template words are ordered by
how often they occur in all texts, rarest first. Of a template with n words of which m must be present, any match has one of
the first n - m + 1 (prefix filter), a block needs m template words at all (length filter), and the places of a common word in the
template and in the block limit how many can follow (positional filter); what is left is compared word by word.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanweave.llm.common import saved

THRESHOLD = 0.8
# Phrases with their labels, and public license notices with theirs.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl-2.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2"),
    ("lgpl-2.1", "licensed under the gnu lesser general public license version 2 1"),
    ("agpl-3.0", "licensed under the gnu affero general public license version 3"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa-4.0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("proprietary", "no part of this publication may be reproduced distributed or transmitted in any form or by any means without prior written permission"),
]
# Words that a label needs, as they tell it from licenses whose notices are otherwise alike.
NEEDED = {"agpl-3.0": ["affero"], "lgpl-2.1": ["lesser"], "gpl-3.0": ["gnu", "3"], "gpl-2.0": ["gnu", "2"], "cc-by-sa-4.0": ["sharealike"], "cc-by-nc-4.0": ["nc"], "apache-2.0": [], "mit": []}
#: What stands between words: all of ASCII but letters and digits.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lower(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, BETWEEN), "")


def _reach(notice: str) -> int:
    """Words after which the next block for a template begins: a power of two, 8 at least."""
    return max(8, 1 << (len(notice.split()) - 1).bit_length())


def _needed(label: str, notice: str) -> list[str]:
    return sorted(set(NEEDED.get(label, [])) & set(notice.split()))


def _templates(spark, templates: list[tuple[str, str]], threshold: float, ranks: dict[str, int]) -> DataFrame:
    """A row for each word of a template's prefix: its place, how many template words there are and how many are needed."""
    rows = []
    for number, (label, notice) in enumerate(templates):
        words = sorted(set(notice.split()), key=lambda w: (ranks.get(w, 0), w))
        need = max(1, math.ceil(threshold * len(words) - 1e-9))
        rows += [(w, number, label, place, len(words), need, words, _reach(notice), _needed(label, notice)) for place, w in enumerate(words[: len(words) - need + 1])]
    return spark.createDataFrame(rows, "word string, template int, label string, place int, total int, need int, words array<string>, reach int, needed array<string>")


def _blocks(texts: DataFrame, vocabularies: dict[int, list[str]], least: dict[int, int]) -> DataFrame:
    """``text_key, text_bytes, block_reach, block, own``: blocks with enough template words, which ``own`` holds once each, in the vocabulary's order."""

    def of(reach: int, vocabulary: list[str]) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size("words") / reach).cast("int") - 2))
        known = F.array(*map(F.lit, vocabulary))
        blocks = F.transform(starts, lambda k: F.struct(F.lit(reach).alias("block_reach"), k.alias("block"), F.array_intersect(known, F.slice("words", k * reach + 1, F.lit(2 * reach))).alias("own")))
        return F.filter(blocks, lambda b: F.size(b["own"]) >= least[reach])

    return texts.select("text_key", "text_bytes", F.inline(F.flatten(F.array(*(of(*kind) for kind in vocabularies.items())))))


def template_matches(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``text_key, text_bytes, block_reach, block, label, containment, total`` of each block of each distinct text that meets a template's threshold;
    ``total`` is the number of the template's words."""
    templates = TEMPLATES if templates is None else templates
    words = {w for _, notice in templates for w in notice.split()}
    counted = docs.select(F.explode(_words(_lower(F.col("text")))).alias("word")).filter(F.col("word").isin(sorted(words))).groupBy("word").count()
    ranks = {r["word"]: r["count"] for r in counted.collect()}  # as many rows as the templates have words
    prefix = _templates(docs.sparkSession, templates, threshold, ranks)
    rare = sorted({r["word"] for r in prefix.select("word").collect()})
    vocabularies: dict[int, set[str]] = {}
    least: dict[int, int] = {}
    for _, notice in templates:
        own = set(notice.split())
        vocabularies.setdefault(_reach(notice), set()).update(own)
        least[_reach(notice)] = min(least.get(_reach(notice), len(own)), max(1, math.ceil(threshold * len(own) - 1e-9)))
    texts = docs.select(F.xxhash64("text").alias("text_key"), F.octet_length("text").alias("text_bytes"), _words(_lower(F.col("text"))).alias("words"))
    maybe = texts.filter(F.arrays_overlap("words", F.array(*map(F.lit, rare))))
    blocks = _blocks(maybe, {r: sorted(v, key=lambda w: (ranks.get(w, 0), w)) for r, v in sorted(vocabularies.items())}, least)
    found = blocks.withColumn("n_own", F.size("own")).select("*", F.posexplode("own").alias("own_place", "word"))
    # After the first common word, no more can be common than follow it on either side; a later one's row may go, the first one's stays.
    rest = F.least(F.col("total") - F.col("place"), F.col("n_own") - F.col("own_place"))
    prefix = prefix.withColumnsRenamed({"word": "prefix_word"})
    found = found.join(F.broadcast(prefix), (F.col("word") == F.col("prefix_word")) & (F.col("block_reach") == F.col("reach")) & (F.col("n_own") >= F.col("need")) & (rest >= F.col("need")))
    shared = F.size(F.array_intersect("own", "words"))
    whole = F.size(F.array_except("needed", "own")) == 0
    found = found.filter((shared >= F.col("need")) & whole).select("text_key", "text_bytes", "block_reach", "block", "label", (shared / F.col("total")).alias("containment"), "total")
    return found.groupBy("text_key", "text_bytes", "block_reach", "block", "label").agg(F.max(F.struct("containment", "total")).alias("fit")).select("text_key", "text_bytes", "block_reach", "block", "label", "fit.*")


def _best_labels(matches: DataFrame) -> DataFrame:
    """``text_key, text_bytes, more, best``: each text's labels that fit a block best (by containment, then by the number of words), and the highest containment."""
    block = ["text_key", "text_bytes", "block_reach", "block"]
    fit = F.struct("containment", "total")
    top = matches.groupBy(*block).agg(F.collect_set(F.struct(fit.alias("fit"), "label")).alias("found"), F.max(fit).alias("top"), F.max("containment").alias("best"))
    labels = F.transform(F.filter("found", lambda x: x["fit"] == F.col("top")), lambda x: x["label"])
    top = top.select("text_key", "text_bytes", F.explode(labels).alias("label"), "best")
    return top.groupBy("text_key", "text_bytes").agg(F.collect_set("label").alias("more"), F.max("best").alias("best"))


def _places(parts: list[str]) -> Column:
    """Where in the array ``words`` the parts stand one after the other, from 0. Few texts have all of them; only those are searched."""

    def here(i: Column) -> Column:
        found = F.lit(True)
        for k, part in enumerate(parts):
            found = found & (F.try_element_at("words", i + k + 1) == part)
        return F.coalesce(found, F.lit(False))

    there = F.lit(True)
    for part in parts:
        there = there & F.array_contains("words", part)
    return F.when(there, F.filter(F.sequence(F.lit(0), F.size("words")), here)).otherwise(F.array().cast("array<int>"))


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` of each row.

    Words are letters, digits and all beyond ASCII, A-Z in lower case; a null text is empty. Base counts the places where a
    phrase's words stand one after the other. The score is 1 with a base phrase, else the best template's share of present words,
    else 0. Rows that repeat, or have no id, get a row each. Very long texts are cut into blocks as a whole. Other columns are ignored; an empty
    table gives no rows.
    """
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.octet_length("text").alias("text_bytes"), _words(_lower(F.col("text"))).alias("words"))
    starts = [_places(phrase.split()) for phrase in PHRASES]
    rows = rows.select("doc_id", "text_key", "text_bytes", F.size("words").cast("long").alias("n_words"), F.array(*starts).alias("starts"))
    places = F.flatten("starts")
    base = F.filter(F.array(*(F.when(F.size(F.col("starts")[k]) > 0, F.lit(label)) for k, label in enumerate(PHRASES.values()))), lambda x: x.isNotNull())
    rows = rows.select("doc_id", "text_key", "text_bytes", "n_words", F.size(places).cast("long").alias("n_base"), F.array_min(places).cast("long").alias("first_word"), F.array_max(places).cast("long").alias("last_word"), F.array_sort(base).alias("base"))
    matches = saved(_best_labels(template_matches(docs, templates, threshold)))
    matches = matches.withColumnsRenamed({"text_key": "k", "text_bytes": "b"})
    found = rows.join(matches, F.col("text_key").eqNullSafe(F.col("k")) & F.col("text_bytes").eqNullSafe(F.col("b")), "left")
    every = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("more", F.array().cast("array<string>")))))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0)))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), score.alias("score"))


def _sql(templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> str:
    """The same by brute force: every block against every template."""
    templates = TEMPLATES if templates is None else templates
    listed = lambda words: f"CAST([{', '.join(repr(w) for w in words)}] AS VARCHAR[])"
    values = ", ".join(f"('{label}', {listed(sorted(set(notice.split())))}, {listed(_needed(label, notice))}, {_reach(notice)})" for label, notice in templates)
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    places = ", ".join(
        f"list_filter(range(0, greatest(len(w) - {len(p.split()) - 1}, 0)), lambda i: " + " AND ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(p.split())) + f") AS s{n}"
        for n, p in enumerate(PHRASES)
    )
    labels = ", ".join(f"CASE WHEN len(s{n}) > 0 THEN '{label}' END" for n, label in enumerate(PHRASES.values()))
    every = " || ".join(f"s{n}" for n in range(len(PHRASES)))
    return rf"""
WITH t(label, words, needed, reach) AS (VALUES {values}),
lowered AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), '{alphabet}', '{alphabet.lower()}') AS x FROM documents),
base AS (SELECT r, doc_id, w, {places} FROM (SELECT r, doc_id, regexp_extract_all(x, '{word}') AS w FROM lowered)),
standing AS (SELECT r, len(w) AS n, unnest(w) AS word, unnest(range(0, len(w))) AS i FROM base),
blocks AS (
  SELECT r, reach, k, list(DISTINCT word) AS own
  FROM (SELECT r, n, reach, word, unnest([i // reach - 1, i // reach]) AS k FROM standing JOIN (SELECT DISTINCT reach, unnest(words) AS word FROM t) USING (word))
  WHERE k BETWEEN 0 AND greatest(0, CAST(ceil(n / reach) AS BIGINT) - 2) GROUP BY r, reach, k
),
shared AS (
  SELECT r, t.reach, k, label, len(t.words) AS total, CAST(len(list_intersect(own, t.words)) AS DOUBLE) / len(t.words) AS share FROM blocks JOIN t ON t.reach = blocks.reach
  WHERE len(list_intersect(own, t.words)) >= ceil({threshold} * len(t.words) - 1e-9) AND list_has_all(own, t.needed)
),
matched AS (SELECT * FROM shared QUALIFY rank() OVER (PARTITION BY r, reach, k ORDER BY share DESC, total DESC) = 1),
more AS (SELECT r, list(DISTINCT label) AS labels, max(share) AS best FROM matched GROUP BY r),
flat AS (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n_words, {every} AS s, list_filter([{labels}], lambda l: l IS NOT NULL) AS b FROM base)
SELECT doc_id, n_words, CAST(len(s) AS BIGINT) AS n_base, CAST(list_min(s) AS BIGINT) AS first_word, CAST(list_max(s) AS BIGINT) AS last_word,
  array_to_string(list_sort(b), ',') AS base_labels, array_to_string(list_sort(list_distinct(b || coalesce(more.labels, []))), ',') AS labels,
  CASE WHEN len(s) > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0::DOUBLE) END AS score
FROM flat LEFT JOIN more USING (r)
"""


SCAN_SQL = _sql()
