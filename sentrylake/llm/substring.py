r"""Substring deduplication: passages of at least ``window`` words that stand anywhere else, by FM-indexes per shard.

1. One pass takes each text's minimizers: in every window the least hash of its ``gram``-word runs. Equal windows have
   equal minimizers at equal places, so a window can only repeat if its minimizer does. Minimizer hashes are counted
   over all documents; texts with a repeated one are joined once and written.
2. A minimizer's segment is the run of windows that it rules; every window lies in one segment. Equal segments are
   counted before they move (copies of a passage are one row per task), and travel once with their number. A segment that
   is alone under its minimizer can't repeat; all others go to the minimizer's shard. A minimizer with more than
   ``most_segments`` of them has its segments cut into single windows, dealt out by their own hash, so no frequent
   passage gathers in one task. Minimizers only route: what may be equal meets in one shard.
3. A shard's segments are one text of word numbers under a compressed FM-index: a wavelet matrix of the Burrows-Wheeler
   transform, in packed bits with ranks per 64, and the sums of the segments' numbers in suffix order. All its
   segments are streamed against it: backward search gives a place's matching statistic, the length of the longest
   run ending there that stands in two places or more; the intervals where it reaches ``window`` are reported.
4. Intervals go back to the documents by segment; covered words are dropped, judged on the input alone.

Defined results: null, empty or shorter texts lose nothing; a passage repeated inside one text counts; rows equal in
doc_id and text are separate places of that text, and both lose it; rows of one doc_id with different texts are judged
each; null doc_id rows take part like others; an empty table gives an empty result; extra columns are ignored; doc_id is
cast to long, so text that is no number raises an error.
"""

from __future__ import annotations

import hashlib
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, gram_hashes, lean, mix, text_slices, trim, word_hashes, words_of


def minimizers(column, window: int, gram: int):
    """Per slice of rows: (first row, data, starts, ends, row bounds in words, window starts, minimizer place and hash of each)."""
    width = window - gram + 1
    for first, data, offsets in text_slices(column):
        starts, ends, rows = words_of(data, offsets)
        words = word_hashes(data, starts, ends, fold=False)
        grams = mix(gram_hashes(words, gram))
        n = len(words) - window + 1
        if n <= 0:
            yield first, data, starts, ends, rows, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
            continue
        best, at = grams[:n].copy(), np.zeros(n, np.int8)
        for s in range(1, width):
            here = grams[s : s + n]
            less = here < best
            np.copyto(best, here, where=less)
            at[less] = s
        row = np.searchsorted(rows, np.arange(len(words)), "right") - 1
        ok = np.flatnonzero(row[:n] == row[window - 1 :])
        yield first, data, starts, ends, rows, ok, ok + at[ok], best[ok]


def runs(places: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where a new segment begins: another minimizer place, or windows that aren't neighbours."""
    if not len(places):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], (places[1:] != places[:-1]) | (starts[1:] != starts[:-1] + 1))))


class FMIndex:
    """Counts occurrences of word runs in an array of symbols (small non-negative integers, 0 kept for the end).

    An occurrence counts ``times`` of its place, 1 by default.
    """

    def __init__(self, symbols: np.ndarray, depth: int, times: np.ndarray | None = None):
        text = np.concatenate((symbols + 1, [0]))
        n = len(text)
        rank, length = text.astype(np.int64), 1
        while True:  # suffix order to ``depth`` symbols by doubling
            after = np.zeros(n, np.int64)
            after[: n - length] = rank[length:] + 1
            key = rank * (int(rank.max()) + 2 if length > 1 else int(text.max()) + 2) + after if int(rank.max()) < 1 << 31 else None
            order = np.argsort(key, kind="stable")
            sorted_ = key[order]
            new = np.zeros(n, np.int64)
            new[order] = np.cumsum(np.concatenate(([False], sorted_[1:] != sorted_[:-1])))
            rank, length = new, length * 2
            if length > depth or int(rank.max()) == n - 1:
                break
        bwt = text[order - 1]
        own = np.concatenate((np.ones(n - 1, np.int64) if times is None else times, [0]))
        self.upto = np.concatenate(([0], np.cumsum(own[order])))
        self.n, self.sigma = n, int(text.max()) + 1
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=self.sigma))))
        self.levels = max(1, (self.sigma - 1).bit_length())
        self.bits, self.ranks, self.zeros = [], [], []
        now = bwt
        for level in range(self.levels - 1, -1, -1):
            bit = (now >> level & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            packed = np.concatenate((packed, np.zeros(-len(packed) % 8 + 8, np.uint8))).view(np.uint64)
            self.bits.append(packed)
            self.ranks.append(np.concatenate(([0], np.cumsum(np.bitwise_count(packed)))).astype(np.int32))
            self.zeros.append(int(n - bit.sum()))
            now = np.concatenate((now[~bit], now[bit]))
        self.origin = self._down(np.arange(self.sigma), np.zeros(self.sigma, np.int64))

    def _down(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        for i in range(self.levels):
            word = place >> 6
            ones = self.ranks[i][word] + np.bitwise_count(self.bits[i][word] & ((np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)))
            place = np.where(symbol >> (self.levels - 1 - i) & 1, self.zeros[i] + ones, place - ones)
        return place

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        base = self.before[symbol] - self.origin[symbol]
        return base + self._down(symbol, low), base + self._down(symbol, high)

    def matching(self, symbols: np.ndarray, stops: np.ndarray, longest) -> np.ndarray:
        """Matching statistics: the length, up to ``longest`` (of each), of the longest run before each stop that occurs twice or more."""
        longest = np.broadcast_to(np.asarray(longest), stops.shape)
        out = np.zeros(len(stops), np.int64)
        alive = np.flatnonzero(np.minimum(longest, stops) > 0)
        symbol = symbols[stops[alive] - 1] + 1
        low, high = self.before[symbol], self.before[symbol + 1]
        length = 0
        while len(alive):
            length += 1
            found = self.upto[high] - self.upto[low] >= 2
            out[alive[found]] = length
            keep = found & (np.minimum(longest, stops)[alive] > length)
            alive, low, high = alive[keep], low[keep], high[keep]
            if len(alive):
                low, high = self.step(symbols[stops[alive] - length - 1] + 1, low, high)
        return out

    def repeated(self, symbols: np.ndarray, begin: np.ndarray, lengths: np.ndarray, window: int) -> np.ndarray:
        """For each window of the runs that start at ``begin``, run by run: does it occur twice or more?

        A run's matching statistic at its end settles the windows it reaches over. The others are taken from the left:
        where the statistic at a window's end falls short, the run one longer stands once, and so do all windows over it, which are skipped.
        """
        count = lengths - window + 1
        at = np.concatenate(([0], np.cumsum(count)))
        reach = self.matching(symbols, begin + lengths, lengths)
        over = reach >= window
        edges = np.zeros(at[-1] + 1, np.int64)
        np.add.at(edges, (at[:-1] + lengths - reach)[over], 1)
        np.add.at(edges, at[1:][over], -1)
        out = np.cumsum(edges[:-1]) > 0
        place, end = np.zeros(len(begin), np.int64), np.where(over, lengths - reach, count - 1)
        while len(rows := np.flatnonzero(place < end)):
            length = self.matching(symbols, begin[rows] + place[rows] + window, window)
            out[(at[rows] + place[rows])[length >= window]] = True
            place[rows] += np.maximum(window - length, 1)
        return out


MARKS = "doc_id long, t long, n_words long, whole string, mins array<long>"
OCCURRENCES = "key long, sid long, doc_id long, t long, at long, windows int, seg string"


def marked(documents: DataFrame, window: int, gram: int) -> DataFrame:
    """doc_id, t, n_words, digest of all words, and the hashes of the minimizer places of each row."""

    def work(batches):
        for batch in batches:
            n, mins = np.zeros(batch.num_rows, np.int64), [np.zeros(0, np.int64)] * batch.num_rows
            for first, data, starts, ends, rows, ok, places, best in minimizers(batch.column("text"), window, gram):
                n[first : first + len(rows) - 1] = np.diff(rows)
                begin = runs(places, ok)
                of = np.searchsorted(rows, ok[begin], "right") - 1
                cut = np.searchsorted(of, np.arange(len(rows)))
                hashes = best[begin].view(np.int64)
                for i in range(len(rows) - 1):
                    if cut[i + 1] > cut[i]:
                        mins[first + i] = hashes[cut[i] : cut[i + 1]]
            whole = [hashlib.sha256(b" ".join((x or "").encode().split())).hexdigest() for x in batch.column("text").to_pylist()]
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in mins]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(mins) if mins else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("t"), pa.array(n), pa.array(whole), lists], ["doc_id", "t", "n_words", "whole", "mins"])

    return documents.mapInArrow(lean(work), MARKS)


def segments(candidates: DataFrame, window: int, gram: int) -> DataFrame:
    """Occurrences of the segments of repeated minimizers; a task writes the words of a segment that it has seen before no more."""

    def work(batches):
        seen: set[int] = set()
        for batch in batches:
            docs, texts, wanted = batch.column("doc_id").to_pylist(), batch.column("t").to_pylist(), batch.column("keys").to_pylist()
            out: list[tuple] = []
            for first, data, starts, ends, rows, ok, places, best in minimizers(batch.column("text"), window, gram):
                begin = runs(places, ok)
                stop = np.concatenate((begin[1:], [len(ok)])) if len(begin) else begin
                of = np.searchsorted(rows, ok[begin], "right") - 1
                hashes = best[begin].view(np.int64)
                cut = np.searchsorted(of, np.arange(len(rows)))
                raw = data.tobytes()
                for i in range(len(rows) - 1):
                    keep = np.flatnonzero(np.isin(hashes[cut[i] : cut[i + 1]], wanted[first + i])) + cut[i]
                    for j in keep.tolist():
                        a, count = int(ok[begin[j]]), int(stop[j] - begin[j])
                        seg = b" ".join(raw[starts[a] : ends[a + count + window - 2]].split()).decode()
                        out.append((int(hashes[j]), docs[first + i], texts[first + i], a - int(rows[i]), count, seg))
                if len(out) > 20_000:
                    yield from emit(out, seen)
            yield from emit(out, seen)

    def emit(out, seen):
        if out:
            c = list(zip(*out))
            sid = [int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little", signed=True) for x in c[5]]
            c[5] = [None if x in seen or seen.add(x) else seg for x, seg in zip(sid, c[5])]
            if len(seen) > 500_000:
                seen.clear()
            yield pa.RecordBatch.from_arrays(
                [pa.array(c[0], pa.int64()), pa.array(sid, pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.int64()), pa.array(c[4], pa.int32()), pa.array(c[5], pa.string())],
                ["key", "sid", "doc_id", "t", "at", "windows", "seg"],
            )
            out.clear()

    return candidates.mapInArrow(lean(work), OCCURRENCES)


def single_windows(distinct: DataFrame, window: int) -> DataFrame:
    """key, sid, n, place, ukey, usid, seg: the windows of each segment (key, sid, n, seg), every one with a key of its own."""
    words = F.split("seg", " ")
    each = distinct.select("key", "sid", "n", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(words) - window + 1), lambda i: F.array_join(F.slice(words, i, window), " "))).alias("place", "seg"))
    return each.select("key", "sid", "n", F.col("place").cast("long").alias("place"), F.xxhash64("seg").alias("ukey"), F.conv(F.substring(F.sha2(F.col("seg").cast("binary"), 256), 1, 15), 16, 10).cast("long").alias("usid"), "seg")


def search(counts: DataFrame, texts: DataFrame, window: int, shards: int) -> DataFrame:
    """key, sid, from, to: windows, of the segments of ``counts`` (key, sid, n), that stand in two places or more.

    ``texts`` has the words of each segment (key, sid, seg) at least once; both travel to the key's shard.
    """

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times: dict[tuple[int, int], int] = {}
        numbers: dict[bytes, int] = {}
        seen: dict[tuple[int, int], list[int]] = {}
        for batch in batches:  # one batch at a time: the words of a segment come from every task that met it, and are kept once
            for k, s, n, seg in zip(*(batch.column(c).to_pylist() for c in ("key", "sid", "n", "seg"))):
                if seg is None:
                    times[k, s] = n
                elif (k, s) not in seen:
                    seen[k, s] = [numbers.setdefault(w, len(numbers)) for w in seg.encode().split(b" ")]
        units = [u for u in seen if u in times]
        if not units:
            return
        parts, weights = [seen[u] for u in units], [times[u] for u in units]
        lengths = [len(p) for p in parts]
        # every segment ends with a symbol of its own, so no match runs over its end
        m = len(parts)
        text = np.fromiter((x for i, p in enumerate(parts) for x in (*p, len(numbers) + i)), np.int64)
        lengths = np.array(lengths)
        begin = np.concatenate(([0], np.cumsum(lengths + 1)))[:-1]
        index = FMIndex(text, int(lengths.max()), np.repeat(weights, lengths + 1))
        count = lengths - window + 1
        hit = index.repeated(text, begin, lengths, window)
        of = np.repeat(np.arange(m), count)
        number = (np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count))[hit]
        of = of[hit]
        first = np.flatnonzero(np.concatenate(([True], (of[1:] != of[:-1]) | (number[1:] != number[:-1] + 1)))) if len(of) else np.zeros(0, np.int64)
        last = np.concatenate((first[1:], [len(of)])) - 1 if len(of) else first
        own = np.array(units, np.int64)[of[first]]
        yield pa.RecordBatch.from_arrays([pa.array(own[:, 0]), pa.array(own[:, 1]), pa.array(number[first], pa.int64()), pa.array(number[last], pa.int64())], ["key", "sid", "from", "to"])
        trim()

    none = lambda kind: F.lit(None).cast(kind)
    rows = counts.select("key", "sid", "n", none("string").alias("seg")).unionByName(texts.select("key", "sid", none("long").alias("n"), "seg"))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    return rows.groupBy("shard").applyInArrow(shard, "key long, sid long, `from` long, `to` long")


def drop_repeats(documents: DataFrame, window: int = 35, gram: int = 18, shard_words: int = 400_000, most_segments: int = 4096) -> DataFrame:
    """doc_id, n_words, n_removed long, kept_sha256 string, intervals array<struct<from,to>> of removed words, one row per document row."""
    spark = documents.sparkSession
    scratch = Scratch(spark, "substring")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), "text")
    marks = scratch.write(marked(docs, window, gram), "marks")
    places = marks.select("doc_id", "t", F.explode("mins").alias("key"))
    # written, so that the join shuffles both sides and AQE can split a frequent key
    twice = scratch.write(places.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key"), "twice")
    own = marks.select("doc_id", "t", F.explode(F.array_distinct("mins")).alias("key"))
    wanted = own.join(twice, "key").groupBy("doc_id", "t").agg(F.collect_set("key").alias("keys"))
    wanted = wanted.withColumnsRenamed({"doc_id": "d", "t": "u"})
    candidates = scratch.write(docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("t") == F.col("u"))).drop("d", "u"), "candidates")
    occurrences = scratch.write(segments(candidates, window, gram), "occurrences")

    # numbers of equal segments; the words stay behind, they go to the shards straight away
    distinct = scratch.write(occurrences.groupBy("key", "sid").agg(F.count("*").alias("n"), F.max("windows").alias("windows")), "segments")
    texts = occurrences.filter("seg is not null").select("key", "sid", "seg")
    size = distinct.groupBy("key").agg(F.count("*").alias("segments"), F.sum(F.col("windows").cast("long") + (window - 1)).alias("words"))
    size = scratch.write(size, "sizes")
    shards_of = lambda words: max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(words or 0) // shard_words))
    heavy = size.filter(F.col("segments") > most_segments).select("key")
    total = size.agg(F.sum(F.when(F.col("segments") <= most_segments, F.col("words")))).first()[0]
    if not heavy.limit(1).count():
        found = scratch.write(search(distinct, texts, window, shards_of(total)), "intervals")
    else:
        found = search(distinct.join(heavy, "key", "left_anti"), texts.join(heavy, "key", "left_anti"), window, shards_of(total))
        whole = distinct.join(heavy, "key").join(texts.join(heavy, "key").dropDuplicates(["key", "sid"]), ["key", "sid"])
        cut = scratch.write(single_windows(whole, window), "windows")
        single = cut.groupBy(F.col("ukey").alias("key"), F.col("usid").alias("sid")).agg(F.sum("n").alias("n"))
        own = cut.select(F.col("ukey").alias("key"), F.col("usid").alias("sid"), "seg").dropDuplicates(["key", "sid"])
        single = scratch.write(search(single, own, window, shards_of(cut.count() * window)), "repeated-windows").select(F.col("key").alias("ukey"), F.col("sid").alias("usid"))
        single = cut.join(single, ["ukey", "usid"]).select("key", "sid", F.col("place").alias("from"), F.col("place").alias("to"))
        found = scratch.write(found.unionByName(single), "intervals")

    spans = occurrences.select("key", "sid", "doc_id", "t", "at").join(found, ["key", "sid"]).select("doc_id", "t", (F.col("at") + F.col("from")).alias("from"), (F.col("at") + F.col("to") + window).alias("to"))
    spans = spans.groupBy("doc_id", "t").agg(F.array_sort(F.collect_set(F.struct("from", "to"))).alias("spans")).withColumnsRenamed({"doc_id": "d", "t": "u"})
    affected = candidates.select("doc_id", "t", "text").dropDuplicates(["doc_id", "t"]).join(spans, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("t") == F.col("u")))

    def rewrite(batches):
        for batch in batches:
            removed, digests, intervals = [], [], []
            for text, spans_ in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                words = text.encode().split()
                merged: list[list[int]] = []
                for s in spans_:
                    if merged and s["from"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s["to"])
                    else:
                        merged.append([s["from"], s["to"]])
                kept, last = [], 0
                for a, b in merged:
                    kept += words[last:a]
                    last = b
                kept += words[last:]
                removed.append(len(words) - len(kept))
                digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
                intervals.append([{"from": a, "to": b} for a, b in merged])
            kind = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("t"), pa.array(removed, pa.int64()), pa.array(digests), pa.array(intervals, kind)], ["d", "u", "removed", "digest", "intervals"])

    changed = affected.select("doc_id", "t", "text", "spans").mapInArrow(rewrite, "d long, u long, removed long, digest string, intervals array<struct<`from`: long, `to`: long>>")
    return marks.join(changed, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("t") == F.col("u")), "left").select(
        "doc_id",
        "n_words",
        F.coalesce("removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("digest", "whole").alias("kept_sha256"),
        F.coalesce("intervals", F.array().cast("array<struct<`from`: long, `to`: long>>")).alias("intervals"),
    )
