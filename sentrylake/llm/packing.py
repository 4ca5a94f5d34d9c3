r"""Packing by cutting-stock column generation.

Every document is tokenised once, by words through a bounded cache (no token spans white space), and cut into full
sequences and a rest. Piece lengths, rounded up to multiples of ``step``, form a histogram of at most
``capacity / step`` classes. A linear program over patterns (how many pieces of each class fill one sequence) is solved
by revised simplex on the driver; an unbounded knapsack by dynamic programming prices new columns from the dual
values. Rounded-down patterns take pieces by their rank within the class, and best-fit packs the classes' left-overs,
a few per pattern. Only the histogram reaches the driver. Ranks come from counts per (class, bucket), so a length that
a third of all documents share isn't sorted in one task.

Defined results: null or empty text is its end token alone; documents are whole rows, so equal rows or doc_ids are packed
each; ranks follow (doc_id, start), ties in any order, since tied pieces are alike; an empty table gives no pieces;
extra columns are ignored. A sequence is padded to ``capacity``: rounding wastes less than ``step`` tokens a piece.
"""

from __future__ import annotations

import os
import sys
import unicodedata
import zlib
from array import array
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, lean, text_slices

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
_words: dict[str, bytes] = {}
_tokenizer: list = [None, None]


def little_endian(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


#: letters below this code point keep to the letters when composed and lower-cased, but for the one that ``isalpha`` tells
EUROPEAN = "\u0530"


def plain_form(word: str) -> tuple[str, str]:
    """A word and its one closing sign; the word lower-cased where that is ASCII. Their ids, one after the other, are the word's.

    The sign is a pre-token of its own only after a letter of the composed and lower-cased word. U+0130 becomes a letter
    and a mark, and marks join the sign, so the lower-cased word must be letters too; other scripts are not taken apart.
    """
    base, tail = (word[:-1], word[-1]) if word[-1:] in (".", ",") else (word, "")
    if not base.isalpha():
        return word, ""
    if base.isascii():
        return base.lower(), tail
    return (base, tail) if max(base) < EUROPEAN and base.lower().isalpha() else (word, "")


#: the signs that byte-level vocabularies write bytes with: printable ones stand for themselves, the others follow from 256 on
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_SIGNS = {b: b if b in _PRINTABLE else 256 + sum(x not in _PRINTABLE for x in range(b)) for b in range(256)}


def simple(word: str) -> bool:
    """Is the word one run of lower-case letters that the tokenizer neither composes nor lower-cases nor splits?"""
    return word.isalpha() and (word.isascii() or max(word) < EUROPEAN and unicodedata.is_normalized("NFC", word)) and word == word.lower()


def spell(words: set[str]) -> None:
    """Puts the ids of ``words`` into the cache. Simple words go to the byte-pair model itself, in its byte signs."""
    _, tokenizer = _tokenizer
    merge = tokenizer.model.tokenize
    others = []
    for w in words:
        if simple(w):
            _words[w] = little_endian([x.id for x in merge(w if w.isascii() else w.encode().decode("latin-1").translate(BYTE_SIGNS))])
        else:
            others.append(w)
    for i in range(0, len(others), 20_000):
        part = others[i : i + 20_000]
        for w, e in zip(part, tokenizer.encode_batch_fast(part, add_special_tokens=False)):
            _words[w] = little_endian(e.ids)


def token_bytes(texts: list[str], tokenizer_path: str, cache: int) -> "list[bytes]":
    """Little-endian 32-bit ids of each text, end token not included."""
    if _tokenizer[0] != tokenizer_path:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _tokenizer[:] = tokenizer_path, Tokenizer.from_file(tokenizer_path)
        _words.clear()
        _words[""] = b""
    split = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
    new = list(set().union(*split).difference(_words))
    # the vocabulary is lower case and takes letters apart from signs: a word with capitals, a comma or a full stop is
    # spelt from its plain form, which is mostly known
    plain = [plain_form(w) for w in new]
    ask = ({b for b, _ in plain} | {t for _, t in plain if t}).difference(_words)
    spell(ask)
    for w, (base, tail) in zip(new, plain):
        if w not in _words:
            _words[w] = _words[base] + _words[tail] if tail else _words[base]
    out = [b"".join(itemgetter(*words, "")(_words)) for words in split]
    if len(_words) > cache:  # a full cache keeps the words it met first, which are the frequent ones
        for w in {*new, *ask}:
            _words.pop(w, None)
    return out


def cut(documents: DataFrame, tokenizer_path: str, end_id: int, capacity: int, cache: int) -> DataFrame:
    """The pieces of every document: full sequences and a rest."""

    def pieces(batches):
        for batch in batches:
            ids, out = batch.column("doc_id").to_pylist(), []
            for at, _, offsets in text_slices(batch.column("text"), 128 << 10):
                texts = batch.column("text").slice(at, len(offsets) - 1).to_pylist()
                for doc, own in zip(ids[at : at + len(texts)], token_bytes([t or "" for t in texts], tokenizer_path, cache)):
                    own += end_id.to_bytes(4, "little")
                    n = len(own) // 4
                    for s in range(0, n, capacity):
                        part = own[4 * s : 4 * (s + capacity)]
                        out.append((doc, s, len(part) // 4, zlib.crc32(part), n))
            names = [c.split()[0] for c in PIECES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 5)], names)

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(pieces), PIECES)


def price(duals: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The pattern of the greatest value within the capacity: unbounded knapsack by dynamic programming."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        n = int(np.searchsorted(sizes, c, "right"))
        best[c] = best[c - 1]
        if n:
            values = best[c - sizes[:n]] + duals[:n]
            j = int(values.argmax())
            if values[j] > best[c] + 1e-12:
                best[c], pick[c] = values[j], j
    pattern, c = np.zeros(len(sizes), np.int64), capacity
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            pattern[pick[c]] += 1
            c -= int(sizes[pick[c]])
    return float(best[capacity]), pattern


def solve(sizes: np.ndarray, counts: np.ndarray, capacity: int, gap: float = 1e-4, rounds: int = 3000) -> list[tuple[int, np.ndarray]]:
    """(times, pattern) that together take every piece once; sizes ascend and counts are positive.

    The duals that price a column are a blend of the basis's own and the best so far, which keeps column generation
    from oscillating. It ends when the bound sum(x) / value is within ``gap``, or after ``rounds`` columns; what the
    program has by then is rounded down where its patterns fill well, and the left-overs are packed by best fit.
    """
    m = len(sizes)
    if not m:
        return []
    columns = np.diag(capacity // sizes).astype(float)
    # counts a little apart from each other, so that steps aren't all of length 0
    target = counts * (1 + 1e-3 * ((np.arange(m) * 0.6180339887) % 1))
    inverse, x = np.diag(1 / np.diag(columns)), target / np.diag(columns)
    steady, bound = sizes / capacity, float((sizes * target).sum() / capacity)  # duals of the area bound
    cost = np.ones(m)  # 0 for a surplus column: a class may be taken more often than it occurs
    for k in range(rounds):
        duals = np.einsum("i,ij->j", cost, inverse)
        if float(cost @ x) <= bound * (1 + gap):
            break
        enter_cost = 1.0
        if duals.min() < -1e-9:
            pattern, enter_cost = np.zeros(m), 0.0
            pattern[int(duals.argmin())] = -1
        else:
            duals = np.maximum(duals, 0)
            blend = 0.7 * steady + 0.3 * duals
            value, pattern = price(blend, sizes, capacity)
            if float(blend @ target) / value > bound:
                steady, bound = blend / value, float(blend @ target) / value
            if float(duals @ pattern) <= 1 + 1e-7:
                value, pattern = price(duals, sizes, capacity)
                if float(duals @ target) / value > bound:
                    steady, bound = duals / value, float(duals @ target) / value
                if value <= 1 + 1e-7:
                    break
        d = np.einsum("ij,j->i", inverse, pattern.astype(float))
        ratio = np.where(d > 1e-7, x / np.where(d > 1e-7, d, 1), np.inf)
        ties = ratio <= ratio.min() * (1 + 1e-7) + 1e-9
        leave = int(np.where(ties, d, -1).argmax())  # of the tied rows the one that is safest to divide by
        x = np.maximum(x - ratio[leave] * d, 0)
        x[leave] = max(float(ratio[leave]), 0.0)
        columns[:, leave], cost[leave] = pattern, enter_cost
        row = inverse[leave] / d[leave]
        inverse = inverse - d[:, None] * row
        inverse[leave] = row
        if k % 100 == 99:  # one Newton step sets the inverse right again; einsum, as it starts no threads in the driver
            inverse = inverse + np.einsum("ij,jk->ik", inverse, np.eye(m) - np.einsum("ij,jk->ik", columns, inverse))
            x = np.maximum(np.einsum("ij,j->i", inverse, target), 0)
    plan, left = [], counts.astype(np.int64).copy()

    def take(pattern: np.ndarray, most: float = np.inf) -> int:
        used = pattern > 0
        times = int(min(most, (left[used] // pattern[used]).min())) if used.any() else 0
        if times > 0:
            plan.append((times, pattern))
            left[:] -= times * pattern
        return times

    for j in np.argsort(-x, kind="stable"):
        pattern = columns[:, j].round().astype(np.int64)
        if cost[j] and (pattern * sizes).sum() >= 0.998 * capacity:
            take(pattern, np.floor(x[j] + 1e-9))
    # the left-overs: the largest piece, then what fills the rest best (large before small), as often as there are pieces
    while left.any():
        have = np.flatnonzero(left)
        big = have[-1]
        pattern = np.zeros(m, np.int64)
        pattern[big] = 1
        room = capacity - int(sizes[big])
        if room >= sizes[have[0]]:
            _, part = price((sizes[have] / capacity) ** 1.05, sizes[have], room)
            pattern[have] += np.minimum(part, left[have] - pattern[have])
            room -= int(((pattern * sizes).sum()) - sizes[big])
            for j in have[::-1]:  # where counts cut the pattern short, the largest that fit
                more = min(int(left[j] - pattern[j]), room // int(sizes[j]))
                pattern[j] += more
                room -= more * int(sizes[j])
        take(pattern)
    return plan


def pack(documents: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1, step: int = 8, buckets: int | None = None, cache: int = 1_600_000, rank_rows: int = 500_000) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (all long), one row per piece.

    Ranks are dealt to ``buckets``, by default one for every ``rank_rows`` pieces, so that a bucket doesn't grow with the input.
    ``cache`` bounds the words that a worker keeps spelt, at about 200 bytes each.
    """
    if capacity % step:
        raise ValueError("capacity must be a multiple of step")
    spark = documents.sparkSession
    scratch = Scratch(spark, "pack")
    pieces = scratch.write(cut(documents, tokenizer_path, end_id, capacity, cache), "pieces")
    n = buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), pieces.count() // rank_rows)
    pieces = pieces.withColumn("cls", F.ceil(F.col("length") / step).cast("long")).withColumn("b", F.pmod(F.xxhash64("doc_id", "start"), F.lit(n)))
    per = pieces.groupBy("cls", "b").agg(F.count("*").alias("n"))
    base = F.coalesce(F.sum("n").over(Window.partitionBy("cls").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = scratch.write(per.withColumn("base", base), "histogram")
    histogram = {r["cls"]: r["n"] for r in per.groupBy("cls").agg(F.sum("n").alias("n")).collect()}
    sizes = np.array(sorted(histogram), np.int64)
    counts = np.array([histogram[s] for s in sizes], float)

    # per class: where each pattern's share of the ranks begins, its first sequence, pieces per sequence, first slot
    shares: dict[int, list[tuple[int, int, int, int]]] = {int(s): [] for s in sizes}
    taken, sequence = dict.fromkeys(shares, 0), 0
    for times, pattern in solve(sizes, counts, capacity // step):
        slot = 0
        for j in np.flatnonzero(pattern)[::-1]:
            s, a = int(sizes[j]), int(pattern[j])
            shares[s].append((taken[s], sequence, a, slot))
            taken[s] += a * times
            slot += a
        sequence += times
    tables = {s: np.array(v, np.int64).reshape(-1, 4) for s, v in shares.items()}

    def place(batches):
        for batch in batches:
            cls, rank = batch.column("cls").to_numpy(), batch.column("rank").to_numpy()
            seq, slot = np.zeros(len(cls), np.int64), np.zeros(len(cls), np.int64)
            for s in np.unique(cls):
                own, t = cls == s, tables[int(s)]
                at = t[np.searchsorted(t[:, 0], rank[own], "right") - 1]
                past = rank[own] - at[:, 0]
                seq[own], slot[own] = at[:, 1] + past // at[:, 2], at[:, 3] + past % at[:, 2]
            kept = batch.select([c.split()[0] for c in PIECES.split(", ")])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(seq), pa.array(slot)], [*kept.schema.names, "sequence_id", "slot"])

    within = F.row_number().over(Window.partitionBy("cls", "b").orderBy("doc_id", "start", "ids_crc32"))
    ranked = pieces.withColumn("r", within).join(per.select("cls", "b", "base"), ["cls", "b"]).withColumn("rank", (F.col("base") + F.col("r") - 1).cast("long"))
    placed = ranked.select(*[c.split()[0] for c in PIECES.split(", ")], F.col("cls"), "rank").mapInArrow(place, PIECES + ", sequence_id long, slot long")
    before = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long")).drop("slot")
