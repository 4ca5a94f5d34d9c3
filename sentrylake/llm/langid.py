r"""Language identification by rank-order profiles.

A language's profile is its ``size`` most frequent letter n-grams (n = 1 to 3, words padded by one boundary sign on
either side) over all its labelled texts, counted per task and summed before ranking. A document's own ranking is
compared with each profile by the out-of-place distance: the sum over the document's n-grams of the difference of
ranks, or of ``size`` for an n-gram that the profile lacks. The score is one minus that sum over its greatest value.

Defined results: null text or text without letters is ``und`` with score 0, as is everything if nothing was learned;
equal counts rank by n-gram, equal distances go to the smaller language name; rows with null lang or text teach
nothing; whole texts are read; equal rows count each; columns named like the results are replaced.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import lean, text_slices

BITS, LAST = 18, 0x33480


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Lower-case code point of every letter, 0 for all else."""
    out = np.zeros(LAST + 1, np.int64)
    for c in range(LAST):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def grams_by_row(column) -> "list[tuple[int, np.ndarray, np.ndarray]]":
    """(row, n-gram keys, row bounds): keys of each slice's rows in one array, bounds one longer than its rows."""
    table = letters()
    for first, data, offsets in text_slices(column, 256 << 10):
        heads = (data & 0xC0) != 0x80
        places = np.concatenate(([0], np.cumsum(heads)))[offsets]
        points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        rows = len(offsets) - 1
        # a boundary before every row and two after the last
        at = places[:-1] + np.arange(rows)
        signs = np.zeros(len(points) + rows + 2, np.int64)
        keep = np.ones(len(signs), bool)
        keep[at] = False
        keep[-2:] = False
        signs[keep] = table[np.minimum(points, LAST)]
        a, b, c = signs[:-2], signs[1:-1], signs[2:]
        # centred on b, so that every n-gram of a row lies between the row's boundaries
        one = b
        two = np.where((a > 0) | (b > 0), (1 << 54) | (a << BITS) | b, 0)
        three = np.where((b > 0) & ((a > 0) | (c > 0)), (2 << 54) | (a << 2 * BITS) | (b << BITS) | c, 0)
        edges = np.concatenate((at, [len(signs) - 2]))
        yield first, np.stack((one, two, three), 1), edges


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys[keys > 0])
    if not len(keys):
        return keys, keys
    start = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[start], np.diff(np.concatenate((start, [len(keys)])))


def learn_profiles(labelled: DataFrame, size: int = 300, flush: int = 2_000_000) -> dict[str, list[int]]:
    """Language to its n-gram keys by rank, from the columns text and lang. Languages times ``size`` keys come back."""

    def count(batches):
        found: dict[str, list] = {}

        def rows():
            for lang, parts in found.items():
                keys, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(keys)), pa.array(keys), pa.array(np.bincount(where, np.concatenate([p[1] for p in parts])).astype(np.int64))],
                    ["lang", "gram", "n"],
                )
            found.clear()

        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            for first, keys, edges in grams_by_row(batch.column("text")):
                mine = langs[first : first + len(edges) - 1]
                of = np.repeat(np.arange(len(mine)), np.diff(edges))
                for lang in dict.fromkeys(mine):
                    found.setdefault(lang, []).append(counted(keys[(mine == lang)[of]].ravel()))
            if sum(len(p[0]) for parts in found.values() for p in parts) > flush:
                yield from rows()
        yield from rows()

    counts = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang").mapInArrow(lean(count), "lang string, gram long, n long")
    total = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    out: dict[str, list[int]] = {}
    for r in total.withColumn("rank", rank).filter(F.col("rank") <= size).orderBy("lang", "rank").collect():
        out.setdefault(r["lang"], []).append(r["gram"])
    return out


def predict(documents: DataFrame, profiles: dict[str, list[int]], size: int = 300) -> DataFrame:
    """``documents`` with lang_pred string and score double (0 to 1), read from ``text`` alone."""
    rest = documents.drop("lang_pred", "score")
    langs = sorted(profiles)
    known = np.unique(np.array([g for v in profiles.values() for g in v], np.int64))
    ranks = np.full((len(known) + 1, len(langs)), size, np.int32)
    for j, lang in enumerate(langs):
        ranks[np.searchsorted(known, profiles[lang]), j] = np.arange(len(profiles[lang]))

    def answer(batches):
        for batch in batches:
            pred, score = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            for first, keys, edges in grams_by_row(batch.column("text")) if langs else ():
                for i in range(len(edges) - 1):
                    own, n = counted(keys[edges[i] : edges[i + 1]].ravel())
                    if not len(own):
                        continue
                    top = own[np.argsort(-n, kind="stable")[:size]]
                    at = np.searchsorted(known, top)
                    at[(at == len(known)) | (known[np.minimum(at, len(known) - 1)] != top)] = len(known)
                    apart = ranks[at]
                    far = np.where(apart == size, size, np.abs(apart - np.arange(len(top), dtype=np.int32)[:, None])).sum(0)
                    best = int(far.argmin())
                    pred[first + i], score[first + i] = langs[best], 1 - far[best] / (size * len(top))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score)], [*batch.schema.names, "lang_pred", "score"])

    schema = T.StructType([*rest.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rest.mapInArrow(lean(answer), schema)


def least_scores(predicted: DataFrame, low: float = 0.05, share: float = 0.6) -> dict[str, float]:
    """Each predicted language's least score: ``share`` of a low quantile of its labelled documents that were told right.

    The share leaves room for short and odd texts. A language without such documents takes the least of the others.
    """
    right = F.when(F.col("lang") == F.col("lang_pred"), F.col("score"))
    found = predicted.filter("lang_pred <> 'und'").groupBy("lang_pred").agg(F.percentile_approx(right, low).alias("q")).collect()
    known = [r["q"] for r in found if r["q"] is not None]
    return {r["lang_pred"]: share * (min(known) if r["q"] is None else r["q"]) for r in found if known}
