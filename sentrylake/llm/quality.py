r"""Quality rules with thresholds taken from mergeable quantile sketches, in DataFrame functions only.

Per-document figures are array and string functions over the whole text. For each (lang, source) a KLL sketch of
every ratio is built (partial sketches per task are merged, so a hot source is only ever a sketch after the map
side); sketches of a language's sources are merged again for sources with few documents, and all of them for small
languages. A document is kept if no ratio lies outside its group's fences: ``reach`` times the distance from the median to
a high (or low) quantile of the group, which follows the group's own tail. Only where almost all of a group are alike
is that distance taken as ``least`` of the ratio, so that they don't condemn each other.

Defined results: null or empty text has no words (base_failed); null lang or source is a group of its own; equal
rows count each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, split_words

WHITE = r"[\x20\x09-\x0D]"
#: ratio: (the high quantile, the low one if a low value is also outside, the least distance that counts)
RATIOS = {"symbol_ratio": (0.95, None, 0.02), "repeat_ratio": (0.975, None, 0.03), "dup_line_ratio": (0.975, None, 0.03), "mean_word": (0.95, 0.01, 0.4)}


def with_repeated_words(df: DataFrame, words: str, name: str, k: int = 5) -> DataFrame:
    """Adds the count of words that lie in a k-word window found twice or more in the array ``words``.

    O(n log n): window hashes are sorted with their places and compared with their neighbours. Each array is a column
    of its own projection, used more than once there: an expression inside a lambda would be evaluated per element.
    """
    count = F.greatest(F.size(words) - (k - 1), F.lit(0))
    df = df.withColumn("_grams", F.transform(F.slice(words, 1, count), lambda w, i: F.xxhash64(w, *[F.get(F.col(words), i + j) for j in range(1, k)])))
    df = df.withColumn("_placed", F.when(F.size(F.array_distinct("_grams")) < F.size("_grams"), F.array_sort(F.transform("_grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, i: F.coalesce(x["h"] == F.get(F.col("_placed"), i)["h"], F.lit(False))
    df = df.withColumn("_at", F.sort_array(F.transform(F.filter("_placed", lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"])))
    start = F.struct(F.lit(-k).alias("last"), F.lit(0).cast("long").alias("n"))
    step = lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(p - acc["last"], F.lit(k))).cast("long").alias("n"))
    return df.withColumn(name, F.coalesce(F.aggregate("_at", start, step, lambda acc: acc["n"]), F.lit(0).cast("long"))).drop("_grams", "_placed", "_at")


def document_figures(documents: DataFrame, keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """``keep`` and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed of each row."""
    base = documents.select(*keep, F.coalesce("text", F.lit("")).alias("_text")).withColumn("_words", split_words(F.col("_text"), WHITE))
    base = base.withColumn("_inked", F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    base = base.select(
        *keep,
        "_words",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("_inked") - F.size(F.array_distinct("_inked"))).cast("long").alias("n_dup_lines"),
        F.size("_inked").alias("_lines"),
    )
    figures = with_repeated_words(base, "_words", "n_repeat_words").drop("_words")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return figures.withColumn("base_failed", failed)


def adaptive_filter(documents: DataFrame, reach: float = 2.5, least_group: int = 64, sketch_k: int = 200) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    Thresholds come from documents that passed the base rules. A (lang, source) of fewer than ``least_group`` of
    them takes its language's fences, a language of fewer takes the fences of all; with none there is no fence.
    """
    n = F.nullif(F.col("n_words"), F.lit(0))
    # written once: thresholds and decisions both read it, and a filter can't pull the array work apart again
    figures = Scratch(documents.sparkSession, "quality").write(document_figures(documents), "figures").withColumns(
        {
            "symbol_ratio": F.col("n_symbols") / n,
            "repeat_ratio": F.col("n_repeat_words") / n,
            "dup_line_ratio": F.col("n_dup_lines") / F.nullif(F.col("_lines"), F.lit(0)),
            "mean_word": F.col("word_chars") / n,
        }
    )
    good = figures.filter(~F.col("base_failed"))
    per_source = good.groupBy("lang", "source").agg(F.count("*").alias("size"), *[F.kll_sketch_agg_double(r, F.lit(sketch_k)).alias(r) for r in RATIOS])
    per_lang = per_source.groupBy("lang").agg(F.sum("size").alias("size"), *[F.kll_merge_agg_double(r, F.lit(sketch_k)).alias(r) for r in RATIOS])
    overall = per_lang.agg(F.sum("size").alias("size"), *[F.kll_merge_agg_double(r, F.lit(sketch_k)).alias(r) for r in RATIOS])

    def fences(df: DataFrame, prefix: str) -> DataFrame:
        out = df
        for r, (high, low, least) in RATIOS.items():
            at = lambda q: F.kll_sketch_get_quantile_double(F.col(r), F.lit(q))  # noqa: B023, E731
            out = out.withColumn(f"{prefix}{r}_hi", at(0.5) + reach * F.greatest(at(high) - at(0.5), F.lit(least)))
            out = out.withColumn(f"{prefix}{r}_lo", F.lit(None).cast("double") if low is None else at(0.5) - reach * F.greatest(at(0.5) - at(low), F.lit(least)))
        return out.drop(*RATIOS).withColumnRenamed("size", f"{prefix}size")

    # as many rows as there are groups; languages and sources, never documents
    table = fences(per_source, "s_").join(fences(per_lang, "l_").withColumnRenamed("lang", "lang2"), F.col("lang").eqNullSafe(F.col("lang2")), "left").crossJoin(fences(overall.filter("size > 0"), "a_"))
    pick = lambda name: F.when(F.col("s_size") >= least_group, F.col(f"s_{name}")).when(F.col("l_size") >= least_group, F.col(f"l_{name}")).otherwise(F.col(f"a_{name}"))
    table = table.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), *[pick(f"{r}_{e}").alias(f"{r}_{e}") for r in RATIOS for e in ("lo", "hi")])
    outside = F.lit(False)
    for r in RATIOS:
        outside = outside | F.coalesce(F.col(r) < F.col(f"{r}_lo"), F.lit(False)) | F.coalesce(F.col(r) > F.col(f"{r}_hi"), F.lit(False))
    joined = figures.join(table, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left")
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~outside).alias("kept"))
