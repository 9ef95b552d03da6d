"""License scan as an exact set-similarity join, in DataFrame functions only.

Templates are sets of words.  A document is cut into blocks of ``2 * stride`` words,
one every ``stride`` words, where ``stride`` is at least the longest template's
number of words, so each run of that many words lies whole in some block.  The scan
finds every (block, template) with at least ``threshold`` of the template's words in
the block:

1. one pass counts the template words over all documents: the global frequency order;
2. *prefix filter*: to hold ``need = ceil(threshold * size)`` of a template's words, a
   block has to hold one of its ``size - need + 1`` rarest words, so only these are
   looked up in the second pass;
3. *positional filter*: the first prefix word that a block holds, at rank r, leaves
   at most ``size - r`` words to come, which must reach ``need``;
4. *length filter*: a block of fewer than ``need`` words can't qualify;
5. the full overlap of what is left is counted.

Both sides of the lookups but the documents come from the template list, whose size
is bounded (``MAX_TEMPLATES``), so they are broadcast.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table
from .wordsql import placed, words

THRESHOLD = 0.8
MAX_TEMPLATES, MAX_WORDS = 1000, 1000

# Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Openings of well-known public license notices, and their labels.
TEMPLATES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "apache": "licensed under the apache license version 2 0",
    "gpl": "this work is licensed under the gnu general public license version 3",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "mpl": "this source code form is subject to the terms of the mozilla public license",
    "cc-by": "licensed under cc by 4 0",
    "cc0": "released under cc0 1 0 universal public domain dedication",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
}


def starts_of(phrase: str, array: str) -> str:
    """SQL: the places (from 0) where the phrase's words stand consecutively; only documents with its last word are looked at."""
    parts = phrase.split()
    test = " AND ".join(f"try_element_at({array}, i + {k + 1}) = '{p}'" for k, p in enumerate(parts))
    return f"CASE WHEN array_contains({array}, '{parts[-1]}') THEN filter(sequence(0, size({array}) - 1), i -> {test}) ELSE cast(array() AS array<int>) END"


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks), one row a row of ``docs``.

    ``blocks``: the qualifying (first word, template label, containment), sorted.
    Null and empty texts have no words and no labels.  Rows that share a doc_id
    report their template labels together; a null doc_id gets base labels only.
    Templates without words match nothing.  Other columns are ignored.
    """
    if len(templates) > MAX_TEMPLATES or any(len(t.split()) > MAX_WORDS for t in templates.values()):
        raise ValueError(f"at most {MAX_TEMPLATES} templates of at most {MAX_WORDS} words")
    if not 0 < threshold <= 1:
        raise ValueError("threshold: above 0, at most 1")
    spark = docs.sparkSession
    scratch = Scratch(spark, "licenses")
    sets = {k: sorted(set(t.split())) for k, t in templates.items() if t.split()}
    stride = max([len(t.split()) for t in templates.values()] or [1])
    stride = max(stride, 1)
    base = docs.select("doc_id", words(F.col("text").cast("string")).alias("w")).withColumn("n_words", F.size("w"))
    vocabulary = sorted({w for t in sets.values() for w in t})
    counted = base.select(F.explode("w").alias("word"))
    known = spark.createDataFrame([(w,) for w in vocabulary], "word string")
    often = {r.word: r["count"] for r in counted.join(F.broadcast(known), "word").groupBy("word").count().collect()}  # bounded by the templates
    order = {w: (often.get(w, 0), w) for w in vocabulary}
    prefix = []
    for label, t in sets.items():
        ranked = sorted(t, key=order.get)
        need = math.ceil(threshold * len(t) - 1e-9)
        prefix += [(w, label, r, need, ranked) for r, w in enumerate(ranked[: len(ranked) - need + 1])]
    prefix.append(("", None, -1, 0, []))
    side = spark.createDataFrame(prefix, "word string, label string, rank int, need int, ranked array<string>")
    for phrase in phrases:
        base = base.withColumn(f"s_{phrase}".replace(" ", "_"), F.expr(starts_of(phrase, "w")))
    cols = {phrase: f"s_{phrase}".replace(" ", "_") for phrase in phrases}
    all_starts = F.array_sort(F.flatten(F.array(*[F.col(c) for c in cols.values()]))) if cols else F.array().cast("array<int>")
    labels = F.array_sort(F.array_distinct(F.filter(F.array(*[F.when(F.size(c) > 0, F.lit(phrases[p])) for p, c in cols.items()]) if cols else F.array().cast("array<string>"), lambda x: x.isNotNull())))
    base = base.withColumn("starts", all_starts).withColumn("base", labels).drop(*cols.values())
    base = base.select("doc_id", "n_words", "w", F.struct(F.size("starts").cast("long").alias("n"), F.try_element_at("starts", F.lit(1)).cast("long").alias("lo"), F.try_element_at("starts", F.lit(-1)).cast("long").alias("hi"), F.col("base").alias("labels")).alias("own"))
    met = placed(base, "w").join(F.broadcast(side), "word")
    # the two blocks that hold this place; the second one starts a stride before
    met = met.withColumn("block", F.explode(F.expr(f"CASE WHEN at < 0 THEN array(-1) WHEN at < {stride} THEN array(0) ELSE array(cast(at div {stride} AS int) * {stride}, cast(at div {stride} AS int) * {stride} - {stride}) END")))
    met = met.filter(f"at < 0 OR (least(n_words - block, {2 * stride}) >= need AND size(ranked) - rank >= need)")
    shared = F.size(F.array_intersect("ranked", F.expr(f"slice(w, block + 1, {2 * stride})")))
    met = met.withColumn("share", F.when(F.col("at") >= 0, shared / F.size("ranked")))
    met = met.filter("at < 0 OR share * size(ranked) >= need - 1e-9")
    rows = scratch.keep(met.select("doc_id", F.col("n_words").cast("long").alias("n_words"), F.when(F.col("at") < 0, F.col("own")).alias("own"), "block", "label", "share"))
    found = rows.filter("label is not null and doc_id is not null").select("doc_id", F.struct("block", "label", "share").alias("hit")).distinct().groupBy("doc_id").agg(F.sort_array(F.collect_list("hit")).alias("blocks"))
    out = rows.filter("label is null").join(scratch.keep(found), "doc_id", "left")
    both = F.array_sort(F.array_union(F.col("own.labels"), F.coalesce(F.transform("blocks", lambda x: x["label"]), F.array().cast("array<string>"))))
    score = F.when(F.col("own.n") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("blocks", lambda x: x["share"])), F.lit(0.0)))
    return out.select("doc_id", "n_words", F.col("own.n").alias("n_base"), F.col("own.lo").alias("first_word"), F.col("own.hi").alias("last_word"), F.array_join("own.labels", ",").alias("base_labels"), F.array_join(both, ",").alias("labels"), score.alias("score"), "blocks")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("blocks")


def _sql() -> str:
    stride = max(len(t.split()) for t in TEMPLATES.values())
    rows = ", ".join(f"('{k}', {sorted(set(t.split()))})" for k, t in TEMPLATES.items())
    phrase = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in PHRASES.items())
    return rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
t(label, ws) AS (VALUES {rows}),
p(phrase, label, n) AS (VALUES {phrase}),
place AS (
  SELECT x.doc_id, x.s - 1 AS s, p.label FROM (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS s FROM d) x
  JOIN p ON array_to_string(list_slice(x.w, x.s, x.s + p.n - 1), ' ') = p.phrase),
base AS (SELECT doc_id, count(*) AS n, min(s) AS lo, max(s) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM place GROUP BY doc_id),
b AS (SELECT doc_id, list_slice(w, s + 1, s + {2 * stride}) AS bw
      FROM (SELECT doc_id, w, unnest(generate_series(0, len(w) - 1, {stride})) AS s FROM d WHERE len(w) > 0)),
hit AS (SELECT doc_id, label, share FROM (
  SELECT doc_id, label, len(list_intersect(list_distinct(bw), ws)) / len(ws) AS share, len(list_intersect(list_distinct(bw), ws)) AS n, len(ws) AS size FROM b, t)
  WHERE n >= ceil({THRESHOLD} * size - 1e-9)),
best AS (SELECT doc_id, max(share) AS share FROM hit GROUP BY doc_id),
names AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
          FROM (SELECT doc_id, label FROM place UNION SELECT doc_id, label FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(base.n, 0) AS BIGINT) AS n_base, CAST(lo AS BIGINT) AS first_word, CAST(hi AS BIGINT) AS last_word,
  coalesce(base.labels, '') AS base_labels, coalesce(names.labels, '') AS labels,
  CAST(CASE WHEN base.n > 0 THEN 1 ELSE coalesce(best.share, 0) END AS DOUBLE) AS score
FROM d LEFT JOIN base ON base.doc_id = d.doc_id LEFT JOIN best ON best.doc_id = d.doc_id LEFT JOIN names ON names.doc_id = d.doc_id
"""


SQL = _sql()
