r"""Near-duplicate groups by fast similarity sketches, banding and exact verification.

1. One pass over the texts gives each document's shingle-set size, a 128-bit BLAKE2 digest of its word sequence and the
   hashes of its sketch bands. Equal sequences fall into one class, represented by its smallest doc_id, whatever its size.
2. Representatives that share a band are candidates. Each bucket links its members to its least one only (no pairs), and
   connected components of these links are the candidate groups.
3. Texts of candidate representatives travel to their group once; their full shingle sets are intersected there, as sets
   of words and not of hashes, and links at the threshold kept (a spanning forest of them). A group beyond
   ``most_members`` or ``most_shingles`` isn't gathered: its buckets are cut into blocks by hash, as many as keep both
   bounds, and each pair of blocks of one bucket is such a task.
4. Components of the verified links give the groups. Nothing but counts reaches the driver.

At 24 bands of 5 coordinates a pair at the threshold of 0.85 is missed with probability below 1e-6 (7e-5 at 0.8).
Hashes only choose candidates and count shingles; what is linked was compared word by word or by a cryptographic digest.

Defined results: null text, or text without words, has no shingles and is alone; fewer than k words are one shingle;
rows of one doc_id are one node; a null doc_id is linked with nothing and is kept; ties don't occur, as components are
named by the least doc_id; an empty table gives an empty result; extra columns are ignored. doc_id
is cast to long, so text that is no number raises an error. One text is never split: a worker needs memory for the
shingles of its longest text, about 60 bytes a word.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .shared import Scratch, gram_hashes, lean, mix, text_slices, trim, word_hashes, words_of

_SEED = np.uint64(0x2545F4914F6CDD1D)


def shingle_sets(column, k: int):
    """(row, its distinct shingle hashes, sorted) of every row; fewer than k words are one shingle, none is none."""
    for first, data, offsets in text_slices(column):
        starts, ends, rows = words_of(data, offsets)
        words = word_hashes(data, starts, ends, fold=True)
        grams = gram_hashes(words, k)
        for i in range(len(offsets) - 1):
            a, b = rows[i], rows[i + 1]
            if b - a >= k:
                own = np.sort(grams[a : b - k + 1])
                yield first + i, own[np.concatenate(([True], own[1:] != own[:-1]))]
            elif b > a:
                yield first + i, gram_hashes(words[a:b], b - a)
            else:
                yield first + i, np.zeros(0, np.uint64)


def exact_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """The distinct shingles of each text as numbers that are equal where all words are equal, and nowhere else."""
    numbers: dict[bytes, int] = {}
    parts = []
    for text in texts:
        words = (text or "").encode().lower().split()
        parts.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words)))
    bounds = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    grams = flat
    for j in range(1, k):  # a run of j + 1 words is a numbered run of j words and one more word
        grams = np.unique(grams[: max(0, len(flat) - j)] * len(numbers) + flat[j:], return_inverse=True)[1]
    few: dict[bytes, int] = {}
    out = []
    for a, b, own in zip(bounds, bounds[1:], parts):
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        else:  # one shingle, unlike every longer one
            out.append(np.array([-1 - few.setdefault(own.tobytes(), len(few))] if b > a else [], np.int64))
    return out


def sketches(sets: list[np.ndarray], t: int) -> np.ndarray:
    """Fast similarity sketches, t coordinates each. Sets must not be empty.

    Round i < t throws every element into one random bin, with a random value below those of later rounds; round
    t + j throws all of them into bin j. A coordinate keeps its least value, and a set is done when all are filled.
    """
    n = len(sets)
    out = np.full(n * t, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64)
    owner = np.repeat(np.arange(n, dtype=np.int64), [len(s) for s in sets])
    elements = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    for i in range(2 * t):
        h = mix(elements ^ mix(np.array([i + 1], np.uint64) * _SEED))
        place = ((h >> np.uint64(48)) * np.uint64(t) >> np.uint64(16)).astype(np.int64) if i < t else i - t
        np.minimum.at(out, owner * t + place, np.uint64(i) << np.uint64(48) | h & np.uint64(0xFFFFFFFFFFFF))
        open_ = (out.reshape(n, t) == np.uint64(0xFFFFFFFFFFFFFFFF)).any(1)
        if not open_.any():
            break
        keep = open_[owner]
        owner, elements = owner[keep], elements[keep]
    return out.reshape(n, t)


def sketched(documents: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n (set size), digest (of the words, null for none), bands array<long>."""

    def work(batches):
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            out = np.zeros((batch.num_rows, bands), np.uint64)
            held: list[np.ndarray] = []
            where: list[int] = []

            def flush():
                if held:
                    h = np.zeros((len(held), bands), np.uint64)
                    s = sketches(held, bands * rows).reshape(len(held), bands, rows)
                    for j in range(rows):
                        h = mix(h * np.uint64(0x100000001B3) + s[:, :, j])
                    out[where] = mix(h + np.arange(bands, dtype=np.uint64) * _SEED)
                    held.clear()
                    where.clear()

            for i, own in shingle_sets(batch.column("text"), k):
                if len(own):
                    n[i] = len(own)
                    held.append(own)
                    where.append(i)
                    if len(own) > 1 << 18 or len(held) >= 512:
                        flush()
            flush()
            words = [b" ".join((t or "").encode().lower().split()) for t in batch.column("text").to_pylist()]
            digests = pa.array([hashlib.blake2b(w, digest_size=16).digest() if w else None for w in words], pa.binary())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, bands, dtype=np.int32)), pa.array(out.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), digests, lists], ["doc_id", "n", "digest", "bands"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(work), "doc_id long, n long, digest binary, bands array<long>")


def linked(sets: list[np.ndarray], per_hundred: int, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the pairs with 100 * intersection >= per_hundred * union; with ``side`` only pairs across."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    if m < 2 or not sizes.any():
        return []
    owner = np.repeat(np.arange(m), sizes)
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    start = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    df = np.diff(np.concatenate((start, [len(values)])))
    column = np.repeat(np.arange(len(start)), df)
    shared = np.zeros((m, m), np.float32)
    # shingles of many sets by matrix products, those of few by their pairs
    many = df > 24
    number = np.cumsum(many) - 1
    chosen = many[column]
    rows, columns = owner[chosen], number[column[chosen]]
    for c in range(0, int(many.sum()), 4096):
        part = (columns >= c) & (columns < c + 4096)
        dense = np.zeros((m, min(4096, int(many.sum()) - c)), np.float32)
        dense[rows[part], columns[part] - c] = 1
        shared += dense @ dense.T
    for d in np.unique(df[(df > 1) & ~many]):
        members = owner[start[df == d][:, None] + np.arange(d)]
        for i in range(d):
            for j in range(i):
                np.add.at(shared, (members[:, i], members[:, j]), 1)
                np.add.at(shared, (members[:, j], members[:, i]), 1)
    both = shared.round().astype(np.int64)
    good = 100 * both >= per_hundred * (sizes[:, None] + sizes[None, :] - both)
    good &= (sizes > 0)[:, None]
    if side is not None:
        good &= side[:, None] != side[None, :]
    root = np.arange(m)
    forest = []
    x, y = np.nonzero(np.triu(good, 1))
    for i, j in zip(x.tolist(), y.tolist()):
        a, b = i, j
        while root[a] != a:
            root[a] = a = root[root[a]]
        while root[b] != b:
            root[b] = b = root[root[b]]
        if a != b:
            root[max(a, b)] = min(a, b)
            forest.append((i, j))
    return forest


def verify(gathered: DataFrame, keys: list[str], k: int, per_hundred: int) -> DataFrame:
    """u, v: verified links among the rows (doc_id, side, text) of each key; across sides only where side isn't null."""

    def group(t: pa.Table) -> pa.Table:
        docs = t.column("doc_id").to_numpy()
        sets = exact_sets(t.column("text").to_pylist(), k)
        sides = t.column("side").to_pylist()
        side = None if any(s is None for s in sides) or len(set(sides)) < 2 else np.array(sides)
        pairs = linked(sets, per_hundred, side)
        if t.nbytes > 1 << 20:
            trim()
        return pa.table({"u": pa.array([docs[i] for i, _ in pairs], pa.int64()), "v": pa.array([docs[j] for _, j in pairs], pa.int64())})

    return gathered.groupBy(*keys).applyInArrow(group, "u long, v long")


def near_duplicates(
    documents: DataFrame,
    threshold: int = 80,
    shingle: int = 5,
    bands: int = 24,
    rows: int = 5,
    most_members: int = 2048,
    most_shingles: int = 4_000_000,
    block: int = 1024,
) -> DataFrame:
    """doc_id, n_shingles, component_id (long), kept boolean, one row per document row; ``threshold`` is in hundredths."""
    scratch = Scratch(documents.sparkSession, "neardup")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    all_ = scratch.write(sketched(docs, shingle, bands, rows), "sketches")
    some = all_.filter("n > 0 and doc_id is not null")
    classes = scratch.write(some.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands")), "classes")
    placed = classes.select("rep", "n", F.explode("bands").alias("band"))
    buckets = placed.groupBy("band").agg(F.min("rep").alias("hub"), F.count("*").alias("members"), F.sum("n").alias("shingles")).filter("members > 1")
    stars = placed.join(buckets, "band").filter("rep <> hub").select(F.col("rep").alias("u"), F.col("hub").alias("v"))
    # rows of one doc_id with different words are one node already; their least class speaks for them
    group = scratch.write(components(stars, scratch), "candidates")
    weight = classes.groupBy("rep").agg(F.max("n").alias("n")).join(group, F.col("rep") == F.col("node")).groupBy("component").agg(F.count("*").alias("members"), F.sum("n").alias("n"))
    weight = weight.withColumn("whole", (F.col("members") <= most_members) & (F.col("n") <= most_shingles)).select("component", "whole")
    group = scratch.write(group.join(weight, "component"), "groups")

    texts = docs.filter(F.col("doc_id").isNotNull())
    small = texts.join(group.filter("whole").select(F.col("node").alias("doc_id"), "component"), "doc_id").select("component", "doc_id", F.lit(None).cast("long").alias("side"), "text")
    links = scratch.write(verify(small, ["component"], shingle, threshold), "links")
    large = group.filter("not whole")
    if large.limit(1).count():
        inside = placed.join(large.select(F.col("node").alias("rep")), "rep").join(buckets, "band")
        inside = inside.withColumn("blocks", F.ceil(F.greatest(F.col("members") / block, 2 * F.col("shingles") / most_shingles)).cast("int")).withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        unit = inside.select("rep", "band", F.col("mine").cast("long").alias("side"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        unit = unit.select("band", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"), F.col("rep").alias("doc_id"), "side")
        blocks = texts.join(unit, "doc_id").select("band", "lo", "hi", "doc_id", "side", "text")
        links = links.unionByName(scratch.write(verify(blocks, ["band", "lo", "hi"], shingle, threshold), "block-links"))
    # copies: every class of a document is one node with it
    same = some.join(classes.select("digest", "rep"), "digest").filter("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    found = scratch.write(components(links.unionByName(same), scratch), "components")
    return (
        all_.join(found, F.col("doc_id") == F.col("node"), "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )
