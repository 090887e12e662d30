r"""License scans: an exact set-similarity join of text blocks with license templates, in built-in functions.

Blocks are lines, cut after sentence ends too, paragraphs (lines between blank ones), and, for statements that stand in a
longer paragraph, overlapping windows over its joined lines: a template of up to w words (w a power of two) is looked
for in windows of 2w words that start at every w-th. A block meets a template if it holds at least
``THRESHOLD`` of the template's distinct words (all of fewer than ``SHORT``). Template words are ranked by how many documents hold them,
counted over the whole table, the rarest first. A block that meets a template of n words, of which
k are needed, holds

* one of the template's n - k + 1 rarest words (prefix filter: on whole documents first, then on blocks; an index from such
  words to templates gives a block's candidates),
* at least k distinct words (length filter), and
* with its first shared word at place i of the template and place j of its own ranked template words,
  no more than 1 + min(n - i - 1, m - j - 1) shared words (positional filter).

Pairs that pass are verified on the sets. The templates are one literal table and its index, so the join needs no shuffle and the
plan doesn't grow with their number.

Beside the templates, the base phrases are located in each document's words: A-Z lower-cased, then runs
of digits, a-z and anything outside ASCII. Null and empty texts have no words, places or labels and
score 0. Repeated rows give equal results; empty tables give no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

THRESHOLD = 0.8

# Phrases and the labels they stand for.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

# License statements, as their licenses have them, and the labels of texts that hold them.
TEMPLATES = (
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    (
        "gpl-warranty",
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of "
        "merchantability or fitness for a particular purpose see the gnu general public license for more details",
    ),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    (
        "apache-notice",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain "
        "a copy of the license at",
    ),
    (
        "apache-basis",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
        "without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions "
        "and limitations under the license",
    ),
    ("mit-release", "released under the mit license"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    (
        "mit-permission",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense "
        "and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    ),
    (
        "mit-disclaimer",
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of "
        "merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any "
        "claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software "
        "or the use or other dealings in the software",
    ),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    (
        "bsd-disclaimer",
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited "
        "to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or "
        "contributors be liable for any direct indirect incidental special exemplary or consequential damages",
    ),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    (
        "lgpl-notice",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as "
        "published by the free software foundation",
    ),
    ("agpl-notice", "you should have received a copy of the gnu affero general public license along with this program"),
    (
        "isc-grant",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the "
        "above copyright notice and this permission notice appear in all copies",
    ),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or "
        "distribute this software",
    ),
    ("cc0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("cc-by-sa-4.0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"),
)
SHORT = 10  # distinct words below which all of a template must be held

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BLOCKS = r"\n|(?<=[.!?])\s"
_PARAGRAPHS = r"\n[\x00-\x2F\x3A-\x60\x7B-\x7F]*\n"  # blank lines, or such without a word, end a paragraph


def low(text: Column) -> Column:
    """A text as far as words with A-Z lower-cased go.

    ``lower`` changes other letters too, but of them only the Kelvin sign becomes an ASCII letter alone; it is taken out first, so
    no further word equals one of a phrase or template.
    """
    return F.lower(F.replace(text, F.lit("\u212a"), F.lit("\ufffd")))


def spaced(text: Column) -> Column:
    """Each word between single spaces, one before the first and one after the last."""
    return F.regexp_replace(F.concat(F.lit(" "), low(text), F.lit(" ")), _GAPS, " ")


def spaces(c: Column) -> Column:
    return F.octet_length(c) - F.octet_length(F.replace(c, F.lit(" "), F.lit("")))


def template_sets(templates=TEMPLATES) -> list[tuple[str, list[str], int]]:
    """Label, distinct words and how many of them a block must hold."""
    out = []
    for label, text in templates:
        words = sorted(set(text.split()))
        out.append((label, words, math.ceil(THRESHOLD * len(words) - 1e-9) if len(words) >= SHORT else len(words)))
    return out


def word_frequencies(norm: DataFrame, templates=TEMPLATES) -> dict[str, int]:
    """In how many documents each template word stands (``norm``: the column ``s`` of spaced texts)."""
    vocabulary = sorted({w for _, words, _ in template_sets(templates) for w in words})
    found = norm.select(F.explode(F.array_intersect(F.split("s", " "), _literal(vocabulary))).alias("w"))
    # one row for each template word
    return dict.fromkeys(vocabulary, 0) | {r.w: r.n for r in found.groupBy("w").agg(F.count("*").alias("n")).collect()}


def _literal(value: list) -> Column:
    return F.array(*[F.lit(v) for v in value])


def template_matches(norm: DataFrame, frequencies: dict[str, int], templates=TEMPLATES) -> DataFrame:
    """``norm`` (columns ``text`` and ``s`` at least) with ``matches``: the labels of templates that a block meets, with the largest containment."""
    order = {w: i for i, w in enumerate(sorted(frequencies, key=lambda w: (frequencies[w], w)))}
    by_rank = sorted(order, key=order.get)
    sets = [(label, sorted(order[w] for w in words), need) for label, words, need in template_sets(templates)]
    longest = [len(text.split()) for _, text in templates]
    sizes = [1 << max(4, (n - 1).bit_length()) for n in longest]
    index: dict[int, list[int]] = {}
    for t, (_, ranks, need) in enumerate(sets):
        for r in ranks[: len(ranks) - need + 1]:
            index.setdefault(r, []).append(t)
    rare = _literal([by_rank[r] for r in sorted(index)])

    # literals: the templates by number, and for each word the templates in whose prefix it is
    table = F.array(*[F.struct(F.lit(label).alias("label"), _literal(ranks).alias("ranks"), F.lit(need).alias("need"), F.lit(size).alias("size")) for (label, ranks, need), size in zip(sets, sizes, strict=True)])
    places = F.array(*[_literal(index.get(r, [])).cast("array<int>") for r in range(len(by_rank))])
    has_rare = lambda b: F.arrays_overlap(F.split(spaced(b), " "), rare)

    def windows(size: int):
        """(size, block) of a paragraph's windows of twice ``size`` words; short paragraphs are one."""

        def of(words: Column) -> Column:
            starts = F.sequence(F.lit(1), F.greatest(F.size(words) - size, F.lit(1)), F.lit(size))
            return F.transform(starts, lambda i: F.struct(F.lit(size).alias("size"), F.array_join(F.slice(words, i, 2 * size), " ").alias("block")))

        return of

    found = norm.withColumn("_rare", F.arrays_overlap(F.split("s", " "), rare))
    text = F.when(F.col("_rare"), low(F.col("text"))).otherwise("")
    lines = F.transform(F.filter(F.split(text, _BLOCKS), has_rare), lambda b: F.struct(F.lit(0).alias("size"), b.alias("block")))
    # a lambda's variable is computed once, what is written inside of it for each element: paragraphs are split before they are cut
    paragraphs = F.transform(F.filter(F.split(text, _PARAGRAPHS), has_rare), lambda p: F.split(F.trim(spaced(p)), " "))
    found = found.withColumns({"_lines": lines, "_paragraphs": paragraphs})
    wide = [F.flatten(F.transform("_paragraphs", windows(size))) for size in sorted(set(sizes))]
    found = found.withColumn("_blocks", F.filter(F.concat("_lines", *wide), lambda b: has_rare(b["block"])))

    vocabulary = _literal(by_rank)

    def ranked(b: Column) -> Column:
        held = F.array_intersect(vocabulary, F.split(spaced(b["block"]), " "))
        return F.struct(b["size"].alias("size"), F.transform(held, lambda w: (F.array_position(vocabulary, w) - 1).cast("int")).alias("ranks"))

    found = found.withColumn("_ranked", F.transform("_blocks", ranked))

    def of_block(b: Column) -> Column:
        near = F.array_distinct(F.flatten(F.transform(b["ranks"], lambda r: F.get(places, r))))  # templates that share a prefix word
        met = F.transform(near, lambda t: F.struct(F.get(table, t).alias("t"), b["ranks"].alias("ranks")))
        met = F.filter(met, lambda x: (b["size"] == 0) | (b["size"] == x["t"]["size"]))
        met = F.filter(met, lambda x: (F.size(x["ranks"]) >= x["t"]["need"]) & (_most(x) >= x["t"]["need"]))
        met = F.transform(met, lambda x: F.struct(x["t"]["label"].alias("label"), (_shared(x) / F.size(x["t"]["ranks"])).alias("held"), (_shared(x) >= x["t"]["need"]).alias("ok")))
        return F.filter(met, lambda x: x["ok"])

    found = found.withColumn("_met", F.flatten(F.transform("_ranked", of_block)))
    labels = F.array_distinct(F.transform("_met", lambda m: m["label"]))
    best = lambda k: F.array_max(F.transform(F.filter("_met", lambda m: m["label"] == k), lambda m: m["held"]))
    matches = F.transform(labels, lambda k: F.struct(k.alias("label"), best(k).alias("held")))
    return found.withColumn("matches", matches).drop("_rare", "_lines", "_paragraphs", "_blocks", "_ranked", "_met")


def _shared(x: Column) -> Column:
    return F.size(F.array_intersect(x["ranks"], x["t"]["ranks"]))


def _most(x: Column) -> Column:
    """How many words a block and a template can share, by the places of the first one."""
    first = F.array_min(F.array_intersect(x["ranks"], x["t"]["ranks"]))
    i, j = F.array_position(x["t"]["ranks"], first), F.array_position(x["ranks"], first)
    return 1 + F.least(F.size(x["t"]["ranks"]) - i, F.size(x["ranks"]) - j)


def license_scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """A row for each document: words, base places, labels and score."""
    norm = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    norm = norm.withColumn("s", spaced(F.col("text")))
    found = template_matches(norm, word_frequencies(norm.select("s"), templates), templates)
    n = (spaces(F.col("s")) - 1).cast("long")
    parts = {label: F.split("s", f" {phrase}(?= )", -1) for phrase, label in PHRASES}
    has = {label: F.contains(F.col("s"), F.lit(f" {phrase} ")) for phrase, label in PHRASES}
    places = sum((F.when(has[k], F.size(parts[k]) - 1).otherwise(0) for k in parts), F.lit(0)).cast("long")
    first = F.array_min(F.array(*[F.when(has[k], spaces(F.element_at(parts[k], 1))) for k in parts])).cast("long")
    last = F.array_max(
        F.array(
            *[
                F.when(has[k], n - (spaces(F.element_at(parts[k], -1)) - 1) - len(phrase.split()))
                for phrase, k in PHRASES
            ]
        )
    ).cast("long")
    base = F.array_compact(F.array(*[F.when(has[k], F.lit(k)) for k in parts]))
    held = F.array_max(F.transform("matches", lambda m: m["held"]))
    return found.select(
        "doc_id",
        n.alias("n_words"),
        places.alias("n_base"),
        first.alias("first_word"),
        last.alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.transform("matches", lambda m: m["label"]))), ",").alias("labels"),
        F.greatest(F.coalesce(held, F.lit(0.0)), F.when(F.size(base) > 0, 0.5).otherwise(0.0)).alias("score"),
    )


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _oracle() -> str:
    gaps = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    phrases = "[" + ", ".join(f"{{'p': {p.split()!r}, 'label': '{k}'}}" for p, k in PHRASES) + "]"
    size = {label: 1 << max(4, (len(text.split()) - 1).bit_length()) for label, text in TEMPLATES}
    sets = "[" + ", ".join(f"{{'t': {w!r}, 'k': {need}, 'label': '{k}', 'size': {size[k]}}}" for k, w, need in template_sets()) + "]"
    sizes, lowered = sorted(set(size.values())), f"translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}')"
    return f"""
WITH d AS (
  SELECT doc_id, {lowered} AS text,
    list_filter(regexp_split_to_array({lowered}, '{gaps}'), lambda w: w <> '') AS w FROM documents
), places AS (
  SELECT doc_id, q.label AS label, i - 1 AS place
  FROM d, unnest({phrases}) u(q), unnest(range(1, len(w) + 1)) r(i)
  WHERE len(list_intersect(w, q.p)) = len(q.p) AND list_slice(w, i, i + len(q.p) - 1) = q.p
), base AS (
  SELECT doc_id, count(*) AS n, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS labels FROM places GROUP BY doc_id
), lines AS (
  SELECT doc_id, 0 AS size, b FROM d, unnest(regexp_split_to_array(regexp_replace(text, '([.!?])\\s', '\\1' || chr(10), 'g'), '\\n')) u(b)
), wide AS (
  SELECT doc_id, list_filter(regexp_split_to_array(b, '{gaps}'), lambda w: w <> '') AS w
  FROM d, unnest(regexp_split_to_array(text, '\\n[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]*\\n')) u(b)
), blocks AS (
  SELECT doc_id, size, list_distinct(list_filter(regexp_split_to_array(b, '{gaps}'), lambda w: w <> '')) AS b FROM lines
  UNION ALL SELECT doc_id, size, list_distinct(list_slice(w, i, i + 2 * size - 1)) FROM wide, unnest({sizes}) z(size), unnest(range(1, greatest(len(w) - size, 1) + 1, size)) r(i)
), held AS (
  SELECT doc_id, s.label AS label, len(list_intersect(b, s.t)) / len(s.t)::DOUBLE AS held
  FROM blocks, unnest({sets}) u(s) WHERE (size = 0 OR size = s.size) AND len(list_intersect(b, s.t)) >= s.k
), own AS (
  SELECT doc_id, max(held) AS held, list(DISTINCT label) AS labels FROM held GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(base.n, 0)::BIGINT AS n_base,
  base.first_word::BIGINT AS first_word, base.last_word::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(own.labels, [])))), ','), '') AS labels,
  greatest(coalesce(own.held, 0.0), CASE WHEN base.n > 0 THEN 0.5 ELSE 0.0 END)::DOUBLE AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN own USING (doc_id)
"""


ORACLE_OP3 = _oracle()
