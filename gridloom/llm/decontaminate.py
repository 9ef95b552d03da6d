"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

An item's windows are its runs of ``size`` words (one shorter window for a shorter
item).  A window is the ordered set of its shingles (``SHINGLE`` consecutive words,
or the window's own length if that is less).

1. One pass over the documents keeps the places of shingles that some window has:
   item shingles meet document shingles by hash, and the place keeps the words
   around it, as far as any window can reach.
2. Shingles are ordered by how often the documents have them, rarest first.
   Containment of the whole window asks for every shingle, so its necessary prefix
   is the single rarest one.
3. Prefix shingles are joined.  The place of the shingle in the window fixes the
   window's start in the document (positional bound), and the window must fit
   between the document's ends (length bound).
4. What is left is verified word by word.

The item side is broadcast only if its counted rows are at most ``MAX_BROADCAST``;
otherwise Spark shuffles both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table
from .wordsql import placed, words

SIZE, SHINGLE = 10, 3
#: Rows of (long, int) keys: about 64 MB in memory.
MAX_BROADCAST = 1_000_000


def item_windows(items: DataFrame, size: int = SIZE, shingle: int = SHINGLE) -> DataFrame:
    """(item_id, window, words, k): distinct windows of every item, ``k`` the words of a shingle."""
    cut = items.select(F.col("item_id"), words(F.col("text").cast("string")).alias("w")).filter(F.size("w") > 0)
    cut = cut.withColumn("len", F.least(F.lit(size), F.size("w")))
    cut = cut.select("item_id", "w", "len", F.explode(F.expr("sequence(1, size(w) - len + 1)")).alias("from"))
    return cut.select("item_id", F.expr("slice(w, `from`, len)").alias("window"), F.least(F.lit(shingle), F.col("len")).alias("k")).distinct()


def shingle_key(array: str, at: str, k: int) -> F.Column:
    return F.xxhash64(*[F.expr(f"try_element_at({array}, {at} + {i + 1})") for i in range(k)])


def occurrences(docs: DataFrame, items: DataFrame, scratch: Scratch, size: int = SIZE, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_words) of every row of ``docs``, and (doc_id, item_id, start, len) of every place of an item's window.

    ``row`` tells rows of one doc_id apart.
    """
    spark = docs.sparkSession
    windows = scratch.keep(item_windows(items, size, shingle))
    sizes = [r.k for r in windows.select("k").distinct().collect()]  # at most ``shingle`` values
    parts = windows.select("window", "k").distinct().select("window", "k", F.explode(F.expr("sequence(0, size(window) - k)")).alias("off"))
    by = None
    for k in sizes:
        key = parts.filter(F.col("k") == k).select("window", "k", "off", shingle_key("window", "off", k).alias("key"))
        by = key if by is None else by.union(key)
    keys = spark.createDataFrame([], "window array<string>, k int, off int, key long") if by is None else scratch.keep(by)
    wanted = scratch.keep(keys.select("key", "k").distinct())
    small = wanted.count() <= MAX_BROADCAST
    base = docs.select(F.col("doc_id"), words(F.col("text").cast("string")).alias("w")).withColumn("n_words", F.size("w"))
    rows = placed(base, "w")
    around = F.when(F.col("at") >= 0, F.expr(f"slice(w, greatest(at - {size - 1}, 0) + 1, {2 * size - 1})")).alias("near")
    place = ["doc_id", "n_words", "at", "key"]
    hits = None
    for k in sizes or [shingle]:
        want = wanted.filter(F.col("k") == k).select("key")
        if small and k == (sizes or [shingle])[0]:
            want = want.union(spark.range(1).select(F.lit(-1).cast("long").alias("key"))).distinct()
            key = F.when(F.col("at") < 0, F.lit(-1).cast("long"))
        else:
            key = F.when(F.col("at") < 0, F.lit(None).cast("long"))
        key = key.when(F.col("at") + k <= F.col("n_words"), shingle_key("w", "at", k))
        side = rows.withColumn("key", key).filter("key is not null")
        # what is shuffled has the words around its place only, not the document's
        met = side.join(F.broadcast(want), "key").select(*place, around) if small else side.select(*place, around).join(want, "key").select(*place, "near")
        hits = met if hits is None else hits.union(met)
    if not small:  # a row for each document, which no key gathers
        hits = hits.union(base.select("doc_id", "n_words", F.lit(-1).alias("at"), F.lit(-1).cast("long").alias("key"), F.lit(None).cast("array<string>").alias("near")))
    hits = scratch.keep(hits)
    found = hits.filter("at >= 0")
    rare = keys.join(found.groupBy("key").agg(F.count("*").alias("often")), "key")
    # a window whose shingles don't all occur can't occur; the rest keep their rarest shingle
    need = rare.groupBy("window").agg(F.count("*").alias("have"), F.min(F.struct("often", "off", "key", "k")).alias("pick"))
    need = need.filter(F.expr("have = size(window) - pick.k + 1")).select("window", "pick.off", "pick.key")
    need = scratch.keep(need)
    met = found.join(need, "key").withColumn("start", F.col("at") - F.col("off"))
    met = met.filter("start >= 0 and start + size(window) <= n_words")
    met = met.filter(F.expr(f"slice(near, start - greatest(at - {size - 1}, 0) + 1, size(window)) = window"))
    places = scratch.keep(met.select("doc_id", "window", "start").distinct())
    return hits.filter("at < 0").select("doc_id", "n_words"), places.join(windows.select("window", "item_id"), "window").select("doc_id", "item_id", "start", F.size("window").alias("len"))


def decontaminate(docs: DataFrame, items: DataFrame, size: int = SIZE, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, item_ids), one row a row of ``docs``.

    Null and empty texts have no words and no hits; items without words have no
    window.  Equal items are all reported.  Rows that share a doc_id report their
    hits together.  A null doc_id is counted but not matched.  Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "decontaminate")
    base, places = occurrences(docs, items, scratch, size, shingle)
    places = scratch.keep(places)
    covered = places.select("doc_id", "start", "len").distinct().select("doc_id", F.explode(F.expr("sequence(start, start + len - 1)")).alias("at")).distinct()
    covered = covered.groupBy("doc_id").agg(F.count("*").alias("n_hit"))
    named = places.select("doc_id", F.col("item_id").cast("string").alias("item")).distinct().groupBy("doc_id").agg(F.sort_array(F.collect_list("item")).alias("item_ids"))
    hit = scratch.keep(covered.join(named, "doc_id"))
    base = scratch.keep(base)
    scratch.only(hit, base)
    out = base.join(hit, "doc_id", "left")
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select("doc_id", F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), ids.alias("item_ids"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits and items of each of ``documents``; cases as in ``decontaminate``."""
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("item_ids")


SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, list_slice(w, s, s + least(10, len(w)) - 1) AS win
  FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS s FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM wins),
places AS (
  SELECT d.doc_id, d.n, d.s, x.item_id
  FROM (SELECT doc_id, n, s, list_slice(w, s, s + n - 1) AS win
        FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM dw, sizes WHERE len(w) >= n)) d
  JOIN wins x ON x.n = d.n AND x.win = d.win),
hit AS (
  SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(generate_series(s, s + n - 1)) AS at FROM places) GROUP BY doc_id),
ids AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM places) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit ON hit.doc_id = dw.doc_id LEFT JOIN ids ON ids.doc_id = dw.doc_id
"""
