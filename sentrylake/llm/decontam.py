r"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

An item's windows are its runs of ``window`` words (a shorter item is one window). A document contains a window only
if it contains every shingle of it, so one shingle, the prefix of the set join at containment 1, is enough to find
every candidate: the rarest of the window, by occurrences in the documents, ties by hash then position. Documents join on that token
alone; the token's position gives the only place where the window could start, the length bound drops places that
run over either end, and the words there are compared with the window's words.

Benchmark tables are sent to every task only while ``broadcast_rows`` bounds them; beyond that the joins shuffle, and
AQE splits a frequent shingle. Covered words are counted by a running maximum per document, no pairs are made.

Defined results: null text, or text without words, has n_words 0 and is clean; a null item is no item; items with
equal windows are all reported; repeated item rows count once; rows with one doc_id share the union of their hits;
null doc_id rows are reported clean (they can't be told apart); empty tables on either side give clean rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, ascii_lower, fixed, split_words

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
GAP_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def shingles(words: str, k: int) -> Column:
    """Hashes of the k-word shingles of an array column, by position."""
    count = F.greatest(F.size(words) - (k - 1), F.lit(0))
    return F.transform(F.slice(words, 1, count), lambda w, i: F.xxhash64(w, *[F.get(F.col(words), i + j) for j in range(1, k)]))


def item_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """item_id, seq array<string>: distinct windows of each item."""
    items = fixed(benchmark.select("item_id", "text"), "w", split_words(ascii_lower(F.coalesce("text", F.lit(""))), GAP))
    items = items.filter((F.size("w") > 0) & F.col("item_id").isNotNull())
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1)))
    return items.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, window))).alias("seq")).distinct()


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 5, broadcast_rows: int = 200_000) -> DataFrame:
    """doc_id, n_words long, n_hit long, n_items long, items array<string> (sorted), one row per document row."""
    scratch = Scratch(documents.sparkSession, "decontam")
    windows = scratch.write(item_windows(benchmark, window), "windows")
    distinct = windows.select("seq").distinct()
    bounded = windows.count() <= broadcast_rows
    small = F.broadcast if bounded else (lambda df: df)
    # shingles of one length per window: of `shingle` words, or of all words of a shorter window
    lengths = [r[0] for r in distinct.select(F.least(F.size("seq"), F.lit(shingle)).alias("k")).distinct().collect()]
    tokens = None
    for k in sorted(lengths):
        part = distinct.filter(F.least(F.size("seq"), F.lit(shingle)) == k).select(F.lit(k).alias("k"), "seq", F.posexplode(shingles("seq", k)).alias("at", "token"))
        tokens = part if tokens is None else tokens.unionByName(part)
    counts = documents.select(F.size(split_words(F.col("text"), GAP_ANY_CASE)).cast("long").alias("n_words"), "doc_id")
    if tokens is None:
        return counts.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), F.array().cast("array<string>").alias("items"))

    words = fixed(documents.filter(F.col("doc_id").isNotNull()).select("doc_id", "text"), "w", split_words(ascii_lower(F.coalesce("text", F.lit(""))), GAP)).drop("text")
    seen = None
    for k in sorted(lengths):
        each = words.select("doc_id", "w", F.lit(k).alias("k"), F.posexplode(shingles("w", k)).alias("p", "token"))
        seen = each if seen is None else seen.unionByName(each)

    # every place of a benchmark shingle in the documents, with the words that any window over it can have
    own = small(tokens.select("k", "token").distinct())
    at_least = F.greatest(F.col("p") - (window - F.col("k")), F.lit(0))
    near = [F.expr("k"), F.col("token"), F.col("p"), at_least.alias("base"), F.slice("w", at_least + 1, F.col("p") - at_least + window).alias("near")]
    if bounded:
        places = seen.join(own, ["k", "token"], "left_semi").select("doc_id", *near)
    else:  # positions travel to the shingles, the words only to places that matched
        matched = seen.select("doc_id", "k", "p", "token").join(own, ["k", "token"], "left_semi")
        places = words.join(matched, "doc_id").select("doc_id", *near)
    places = scratch.write(places, "places")

    # rarity over all documents; a window with a shingle that no document has occurs nowhere and isn't joined at all
    rarity = places.groupBy("k", "token").agg(F.count("*").alias("df"))
    prefix = tokens.join(rarity, ["k", "token"]).withColumn("r", F.row_number().over(Window.partitionBy("seq").orderBy("df", "token", "at")))
    complete = prefix.groupBy("seq").agg(F.count("*").alias("have"), F.first("k").alias("kk")).filter(F.col("have") == F.size("seq") - F.col("kk") + 1).select("seq")
    prefix = prefix.filter("r = 1").join(complete, "seq", "left_semi").select("k", "token", "at", "seq", F.size("seq").alias("len"))
    prefix = scratch.write(prefix, "prefix")

    found = places.join(small(prefix), ["k", "token"]).withColumn("start", F.col("p") - F.col("at"))
    found = found.filter((F.col("start") >= 0) & (F.col("start") - F.col("base") + F.col("len") <= F.size("near")))
    found = found.filter(F.slice("near", F.greatest(F.col("start") - F.col("base") + 1, F.lit(1)).cast("int"), F.col("len")) == F.col("seq")).select("doc_id", "start", "len", "seq")
    found = scratch.write(found, "found")

    before = Window.partitionBy("doc_id").orderBy("start", "len").rowsBetween(Window.unboundedPreceding, -1)
    spans = found.groupBy("doc_id", "start").agg(F.max("len").alias("len"))
    ends = spans.withColumn("upto", F.coalesce(F.max(F.col("start") + F.col("len")).over(before), F.lit(0)))
    hit = ends.groupBy("doc_id").agg(F.sum(F.greatest(F.col("start") + F.col("len") - F.greatest("start", "upto"), F.lit(0))).cast("long").alias("n_hit"))
    which = found.select("doc_id", "seq").distinct().join(small(windows), "seq").select("doc_id", F.col("item_id").cast("string").alias("item")).distinct()
    items = which.groupBy("doc_id").agg(F.array_sort(F.collect_list("item")).alias("items"))
    return (
        counts.join(hit, "doc_id", "left")
        .join(items, "doc_id", "left")
        .select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    )
