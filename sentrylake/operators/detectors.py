"""Detectors in NumPy behind Arrow: isolation forest, local outlier factor, one-class SVM (Nystroem features).

Fitting reads all training rows, as distinct rows with their copies counted; none of them is gathered on the driver beyond the
basis of the SVM. Models of the forest and the SVM are plain dictionaries of lists; scoring with them is a map over all rows.
"""

from __future__ import annotations

import math
import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentrylake.operators.baselines import ecdf
from sentrylake.storage import Scratch


def vector(features: list[str]):
    """The features as one array of doubles; null is NaN, and -0.0 is 0.0."""
    return F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) + 0.0 for c in features])


def kept(df: DataFrame, name: str) -> DataFrame:
    """A written table, as fitting reads it more than once."""
    return Scratch(df.sparkSession, "detectors").write(df, name)


def distinct_rows(matrix: DataFrame, train, features: list[str]) -> DataFrame:
    """id, x, copies: the distinct rows of ``matrix`` and how many training rows each stands for (0: only scored).

    Copies are counted before they move. ``id`` hashes x under the first seed that gives no two rows the same one.
    """
    rows = matrix.select(vector(features).alias("x"), F.coalesce(train, F.lit(False)).alias("t"))
    rows = kept(rows.groupBy("x").agg(F.count_if("t").alias("copies")), "rows")
    odd = F.exists("x", lambda v: F.isnan(v) | (F.abs(v) == float("inf")))
    found = rows.agg(F.sum("copies").alias("n"), F.count_if(odd & (F.col("copies") > 0)).alias("odd"), F.count("*").alias("rows")).first()
    if not found["n"]:
        raise ValueError("no training rows")
    if found["odd"]:
        raise ValueError("features must be finite")
    for salt in range(16):
        out = rows.select(F.xxhash64("x", F.lit(salt)).alias("id"), "x", "copies")
        if out.agg(F.count_distinct("id")).first()[0] == found["rows"]:
            return out.withColumn("salt", F.lit(salt))
    raise RuntimeError("row hashes collide under every seed")


def array2d(column, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def drawn(rows: DataFrame, draws: int, size: int, seed: int) -> tuple[DataFrame, int]:
    """(draw, e, id, x) and the size: each draw's candidates, whose ``size`` least e are drawn from all training rows.

    Every copy of a row has an exponential key of its own for each draw, so a draw is without replacement and a group of
    copies gets its share; the j-th least key of c copies is the sum of j exponentials over c, c - 1, ... Keys hash id,
    draw and number of the copy: the same draw in any partitioning. Only keys below a bound that leaves about
    ``size + 16 * sqrt(size)`` of them move.
    """
    n = rows.agg(F.sum("copies")).first()[0]
    size = min(size, n)
    share = (size + 16 * math.sqrt(size) + 64) / n
    bound = math.inf if share >= 1 else -math.log1p(-share)

    def work(batches):
        for b in batches:
            ids, copies = (b.column(c).to_numpy() for c in ("id", "copies"))
            base = mixed(ids.view(np.uint64) + np.uint64(seed))
            for t in range(draws):
                own, at, e, j = mixed(base + np.uint64(t)), np.arange(len(ids)), np.zeros(len(ids)), 0
                where, keys = [], []
                while len(at) and j < size:
                    u = (mixed(own[at] + np.uint64(j)) >> np.uint64(11)) / 2.0**53
                    e[at] -= np.log1p(-u) / (copies[at] - j)
                    at = at[e[at] <= bound]
                    where.append(at)
                    keys.append(e[at])
                    j += 1
                    at = at[copies[at] > j]
                where, keys = np.concatenate([*where, np.zeros(0, int)]), np.concatenate([*keys, np.zeros(0)])
                if len(where):
                    taken = b.select(["id", "x"]).take(pa.array(where))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(where), t)), pa.array(keys), *taken.columns], ["draw", "e", "id", "x"])

    return rows.filter("copies > 0").select("id", "x", "copies").mapInArrow(work, "draw long, e double, id long, x array<double>"), size


def in_order(t: pa.Table, size: int, width: int) -> np.ndarray:
    """The drawn rows of one draw."""
    order = np.lexsort((t.column("id").to_numpy(), t.column("e").to_numpy()))[:size]
    if len(order) < size:
        raise RuntimeError("a draw has too few candidates")
    return array2d(t.column("x"), width)[order]


def scored(matrix: DataFrame, features: list[str], name: str, function) -> DataFrame:
    """``matrix`` with a score column from a function of a float array (rows, features)."""
    rest = matrix.drop(name)
    schema = T.StructType([*rest.schema.fields, T.StructField(name, T.DoubleType())])

    def work(batches):
        for b in batches:
            x = np.column_stack([b.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in features])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(function(x) if len(x) else np.zeros(0))], [*b.schema.names, name])

    return rest.mapInArrow(work, schema)


# ---------------------------------------------------------------- isolation forest


def mean_path(n: float) -> float:
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def tree(x: np.ndarray, rng: np.random.Generator) -> list[list[float]]:
    depth = max(1, math.ceil(math.log2(max(len(x), 2))))
    nodes: list[list[float]] = []  # feature (-1: leaf), cut or path length, left, right
    todo = [(x, 0, -1, 0)]
    while todo:
        part, level, parent, side = todo.pop()
        at = len(nodes)
        if parent >= 0:
            nodes[parent][2 + side] = at
        low, high = part.min(0), part.max(0)
        split = np.flatnonzero(high > low)
        if level >= depth or len(part) <= 1 or not len(split):
            nodes.append([-1, level + mean_path(len(part)), 0, 0])
            continue
        f = int(rng.choice(split))
        cut = float(rng.uniform(low[f], high[f]))
        nodes.append([f, cut, 0, 0])
        go = part[:, f] < cut
        todo += [(part[go], level + 1, at, 0), (part[~go], level + 1, at, 1)]
    return nodes


def fit_forest(rows: DataFrame, width: int, trees: int = 150, size: int = 256, seed: int = 42) -> dict:
    """Each tree's ``size`` rows are drawn from all training rows; trees are grown by the tasks."""
    candidates, size = drawn(rows, trees, size, seed)

    def grow(t: pa.Table) -> pa.Table:
        draw = t.column("draw")[0].as_py()
        nodes = np.array(tree(in_order(t, size, width), np.random.default_rng([seed, draw])), float)
        return pa.table({"draw": pa.array([draw]), "nodes": pa.array([nodes.ravel()], pa.list_(pa.float64()))})

    grown = candidates.groupBy("draw").applyInArrow(grow, "draw long, nodes array<double>").orderBy("draw").collect()
    return {"trees": [np.array(r["nodes"]).reshape(-1, 4).tolist() for r in grown], "norm": mean_path(size)}


def forest_scores(model: dict):
    trees = [np.array(t, float) for t in model["trees"]]
    norm = model["norm"] or 1.0

    def score(x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for t in trees:
            at = np.zeros(len(x), int)
            while True:
                f = t[at, 0].astype(int)
                inner = f >= 0
                if not inner.any():
                    break
                left = x[np.arange(len(x)), np.maximum(f, 0)] < t[at, 1]
                at = np.where(inner, np.where(left, t[at, 2], t[at, 3]).astype(int), at)
            total += t[at, 1]
        return 2.0 ** (-(total / len(trees)) / norm)

    return score


# ---------------------------------------------------------------- local outlier factor


def neighbours(x: np.ndarray, base: np.ndarray, k: int, spare: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Distances and places of the k nearest base rows (all, if there are fewer), in blocks. Those chosen, and some spare ones, are measured exactly."""
    k = min(k, len(base))
    more = min(k + spare, len(base))
    d_out, i_out = np.zeros((len(x), k)), np.zeros((len(x), k), int)
    square = np.einsum("ij,ij->i", base, base)
    for a in range(0, len(x), 512):
        part = x[a : a + 512]
        near = np.argpartition(square - 2 * part @ base.T, more - 1, axis=1)[:, :more]
        d = np.sqrt(((part[:, None] - base[near]) ** 2).sum(2))
        order = np.argsort(d, axis=1, kind="stable")[:, :k]
        d_out[a : a + 512], i_out[a : a + 512] = np.take_along_axis(d, order, 1), np.take_along_axis(near, order, 1)
    return d_out, i_out


def nearest(rows: DataFrame, n: int, width: int, k: int, block: int = 16_384) -> DataFrame:
    """id, near (array of d and i, by distance): the k nearest training rows of every row, itself among them if it is one.

    Rows and training rows are cut into blocks by hash; every pair of blocks is a group, and the nearest of each are merged.
    """
    blocks = max(-(-n // block), min(8, -(-n // 512)))
    every, mine = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    asked = rows.select(mine.alias("q"), every.alias("b"), F.lit(False).alias("base"), "id", "x")
    base = rows.filter("copies > 0").select(every.alias("q"), mine.alias("b"), F.lit(True).alias("base"), "id", "x")

    def pair(t: pa.Table) -> pa.Table:
        side, ids, x = t.column("base").to_numpy(), t.column("id").to_numpy(), array2d(t.column("x"), width)
        if side.all() or not side.any():
            return pa.table({"id": pa.array([], pa.int64()), "d": pa.array([], pa.list_(pa.float64())), "i": pa.array([], pa.list_(pa.int64()))})
        d, i = neighbours(x[~side], x[side], k)
        bounds = pa.array(np.arange(0, d.size + 1, d.shape[1], dtype=np.int32))
        return pa.table({"id": ids[~side], "d": pa.ListArray.from_arrays(bounds, pa.array(d.ravel())), "i": pa.ListArray.from_arrays(bounds, pa.array(ids[side][i.ravel()]))})

    found = asked.unionByName(base).groupBy("q", "b").applyInArrow(pair, "id long, d array<double>, i array<long>")
    found = found.select("id", F.arrays_zip("d", "i").alias("near"))
    return found.groupBy("id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))


def lof_by_row(rows: DataFrame, width: int, k: int = 20) -> DataFrame:
    """id, score. The base is every distinct training row; its densities leave out the row itself, scores don't."""
    n = rows.filter("copies > 0").count()
    if n < 2:
        raise ValueError("the local outlier factor needs two distinct training rows")
    k = max(1, min(k, n - 1))
    near = kept(nearest(rows, n, width, k + 1), "near")
    # all training rows are among their own k + 1, as only they are at distance 0
    others = near.join(rows.filter("copies > 0").select("id"), "id").select("id", F.slice(F.filter("near", lambda p: p["i"] != F.col("id")), 1, k).alias("near"))
    others = others.withColumn("reach", F.element_at("near", -1)["d"])
    pairs = lambda df: df.select("id", F.explode("near").alias("p")).select("id", F.col("p.i").alias("i"), F.col("p.d").alias("d"))
    far = F.avg(F.greatest("d", "reach")) + 1e-10
    reach = kept(others, "others")
    density = pairs(reach).join(reach.select(F.col("id").alias("i"), "reach"), "i").groupBy("id").agg((1 / far).alias("density"))
    known = kept(density.join(reach.select("id", "reach"), "id").withColumnRenamed("id", "i"), "densities")
    asked = pairs(near.select("id", F.slice("near", 1, k).alias("near")))
    return asked.join(known, "i").groupBy("id").agg((F.avg("density") * far).alias("score"))


# ---------------------------------------------------------------- one-class SVM


def fit_svm(rows: DataFrame, width: int, components: int = 100, gamma: float | None = None, nu: float = 0.05, seed: int = 42) -> dict:
    """Nystroem features, then w and rho of least |w|^2 / 2 - rho + mean(max(0, rho - w z)) / nu over all training rows.

    Newton steps on the hinge, rounded off over a width that shrinks; loss, gradient and curvature are sums per task.
    """
    train = rows.filter("copies > 0")
    n, total = train.agg(F.sum("copies"), F.sum(F.col("copies") * F.aggregate("x", F.lit(0.0), lambda a, v: a + v))).first()
    mean = total / (n * width)
    spread = train.agg(F.sum(F.col("copies") * F.aggregate("x", F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean)))).first()[0] / (n * width)
    gamma = gamma or 1.0 / (width * max(spread, 1e-12))
    candidates, size = drawn(rows, 1, components, seed)
    basis = in_order(candidates.toArrow(), size, width)
    kernel = np.exp(-gamma * ((basis[:, None] - basis[None]) ** 2).sum(2))
    u, s, _ = np.linalg.svd(kernel)
    model = {"basis": basis.tolist(), "root": (u / np.sqrt(np.maximum(s, 1e-12))).tolist(), "gamma": gamma}
    m = size + 1

    def sums(at: np.ndarray, soft: float) -> tuple[float, np.ndarray, np.ndarray]:
        def work(batches):
            loss, slope, bend = 0.0, np.zeros(m), np.zeros((m, m))
            for b in batches:
                c = b.column("copies").to_numpy().astype(float)
                a = np.column_stack([-nystroem(model, array2d(b.column("x"), width)), np.ones(len(c))])
                gap = a @ at
                inner = (gap > 0) & (gap < soft)
                loss += float(c @ np.where(inner, gap**2 / (2 * soft), np.maximum(gap - soft / 2, 0) * (gap > 0)))
                slope += (c * np.clip(gap / soft, 0, 1)) @ a
                bend += (a[inner] * (c[inner] / soft)[:, None]).T @ a[inner]
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(([loss], slope, bend.ravel()))], pa.list_(pa.float64()))], ["v"])

        def add(batches):
            all_ = [array2d(b.column("v"), 1 + m + m * m).sum(0) for b in batches]
            if all_:
                yield pa.RecordBatch.from_arrays([pa.array([sum(all_)], pa.list_(pa.float64()))], ["v"])

        got = sum(np.array(r["v"]) for r in train.select("x", "copies").mapInArrow(work, "v array<double>").repartition(4).mapInArrow(add, "v array<double>").collect())
        w, own, share = at.copy(), np.eye(m), nu * n
        w[-1] = own[-1, -1] = 0
        return w @ w / 2 - at[-1] + got[0] / share, w - np.eye(m)[-1] + got[1 : m + 1] / share, own + got[m + 1 :].reshape(m, m) / share

    # the mean of z, and its own margin, to start from
    w = (np.eye(m)[-1] - sums(np.eye(m)[-1] * 1e6, 1.0)[1])[:-1] * nu
    at = np.concatenate((w, [w @ w]))
    for soft in np.array([0.1, 1e-2, 1e-3, 1e-4, 1e-5]) * max(float(w @ w), 1e-3):
        now, damp = sums(at, soft), 1e-6
        for _ in range(200):
            step = -np.linalg.solve(now[2] + damp * np.eye(m), now[1])
            if -(now[1] @ step) < 1e-8:
                break
            new = sums(at + step, soft)
            if new[0] < now[0]:
                at, now, damp = at + step, new, max(damp / 100, 1e-9)
            else:
                damp *= 30
        else:
            raise RuntimeError("the one-class SVM did not converge")
    return model | {"w": at[:-1].tolist(), "rho": float(at[-1])}


def nystroem(model: dict, x: np.ndarray) -> np.ndarray:
    basis = np.array(model["basis"])
    d = np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", basis, basis) - 2 * x @ basis.T
    return np.exp(-model["gamma"] * np.maximum(d, 0)) @ np.array(model["root"])


def svm_scores(model: dict):
    w, rho = np.array(model["w"]), model["rho"]
    return lambda x: rho - nystroem(model, x) @ w


#: fit and scores; the local outlier factor has no model but the rows themselves
DETECTORS = {"iforest": (fit_forest, forest_scores), "lof": (None, None), "ocsvm": (fit_svm, svm_scores)}
ALIASES = {"isolation_forest": "iforest", "one_class_svm": "ocsvm", "local_outlier_factor": "lof"}


def fit_and_score(matrix: DataFrame, train, features: list[str], detector: str, sample_rows: int | None = None, seed: int = 42, **parameters) -> DataFrame:
    """``matrix`` with ``<detector>_score``, fitted on all training rows; on ``sample_rows`` of them only if a caller asks for that."""
    name = ALIASES.get(detector, detector)
    fit, make = DETECTORS[name]
    width, rows = len(features), distinct_rows(matrix, train, features)
    if sample_rows is not None and rows.agg(F.sum("copies")).first()[0] > sample_rows:
        some, size = drawn(rows, 1, sample_rows, seed)
        some = some.orderBy("e", "id").limit(size).groupBy("id").agg(F.count("*").alias("copies"))
        rows = kept(rows.drop("copies").join(some, "id", "left").withColumn("copies", F.coalesce("copies", F.lit(0))), "sample")
    if name == "lof":
        salt = rows.select("salt").first()[0]
        scores = kept(lof_by_row(rows, width, **parameters).withColumnRenamed("id", "_id").withColumnRenamed("score", "lof_score"), "scores")
        return matrix.drop("lof_score").withColumn("_id", F.xxhash64(vector(features), F.lit(salt))).join(scores, "_id", "left").drop("_id")
    return scored(matrix, features, f"{name}_score", make(fit(rows, width, seed=seed, **parameters)))


def by_segment(matrix: DataFrame, train, features: list[str], detector: str, segment: str, segments: list[str], **parameters) -> DataFrame:
    """A model of its own for every enabled segment; rows of other segments are left out, with a warning that counts them."""
    others = {r[0]: r[1] for r in matrix.filter(F.col(segment).isNull() | ~F.col(segment).isin(*segments)).groupBy(segment).count().collect()}  # one row a segment
    if others:
        warnings.warn(f"rows of other segments are not scored: {others}", stacklevel=2)
    out = None
    for s in segments:
        part = fit_and_score(matrix.filter(F.col(segment) == s), train, features, detector, **parameters)
        out = part if out is None else out.unionByName(part)
    return out


def with_percentile(scores: DataFrame, score: str, train) -> DataFrame:
    """Percentile of a score among the training scores, and the alert at the training quantile."""
    return ecdf(scores, train, score, score.replace("_score", "_pct"), "right")

