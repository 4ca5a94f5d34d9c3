r"""LM scoring by subword lattices: the marginal likelihood of a text over all its segmentations.

The lattice of a text has the pieces of an existing vocabulary as arcs, weighted by the vocabulary's scores, byte pieces
for any character, and one arc for each whole word that training texts have. A text is its words, each led by the word sign, and
an end. No arc spans words, so the log-space forward recursion of a text is the sum of its words' recursions, and each
distinct word is solved once, in the word table.

The vocabulary's scores are ranks, so a piece of rank r weighs (r + 10) ** -t; the exponent t is fitted to the training
words. These weights alone give ``vocabulary_score``. For ``score`` they are the prior, worth ``prior`` pieces, of the expected piece
counts of the distinct training words (forward-backward, two passes over the word table), and whole-word arcs carry
the training counts less an absolute discount; what is discounted is the mass of the pieces. Either is a probability over
all texts: pieces led by the word sign share the mass that ends a word.

Texts are dealt to chunks that follow the input's size. A chunk sends its distinct words with their counts to the word
table and gets back its words with their counts and likelihoods: what is shuffled grows with the chunks' vocabularies,
not with tokens, and no table is broadcast but the vocabulary file's.

Defined results: null or empty text is its end token; rows not marked for training teach nothing; with no training
rows the vocabulary's own scores hold; equal rows count each and get equal scores; an empty table gives an empty result;
extra columns are ignored; doc_id is cast to long, so text that is no number raises an error.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, mix, tasks_for

SIGN = "▁"
_P = np.uint64(0x9E3779B97F4A7C15)
LOG10 = float(np.log(10))


def read_vocabulary(path: str) -> list[str]:
    """Pieces of a sentencepiece model in the order of their scores, byte pieces as <0xXX>, without control pieces."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
    ids.sort(key=lambda i: (m.is_byte(i), -m.get_score(i), i))
    return [m.id_to_piece(i) for i in ids if SIGN not in m.id_to_piece(i)[1:]]


def _hash(text: str) -> int:
    h = 0
    for c in text:
        h = (h * int(_P) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
    return h


class Lattice:
    """Piece lookup by hash tables and the recursions over batches of words of one length."""

    def __init__(self, pieces: list[str], log_p: np.ndarray):
        self.log_p = np.concatenate((log_p, [-np.inf]))
        self.byte = np.full(256, len(pieces))
        keys, ids = [], []
        for i, piece in enumerate(pieces):
            if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
                self.byte[int(piece[3:5], 16)] = i
            else:
                keys.append(_hash(piece))
                ids.append(i)
        self.longest = max(map(len, pieces))
        keys, ids = np.array(keys, np.uint64), np.array(ids)
        self.tables = []
        shift = 0
        while len(keys):  # what meets in one table goes to the next
            slot = self._slot(keys, shift)
            _, first = np.unique(slot, return_index=True)
            table_keys, table_ids = np.zeros(1 << 18, np.uint64), np.full(1 << 18, len(pieces))
            table_keys[slot[first]], table_ids[slot[first]] = keys[first], ids[first]
            self.tables.append((table_keys, table_ids))
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, ids, shift = keys[rest], ids[rest], shift + 1

    @staticmethod
    def _slot(keys: np.ndarray, shift: int) -> np.ndarray:
        return (mix(keys + np.uint64(shift)) >> np.uint64(46)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(keys.shape, len(self.log_p) - 1)
        for shift, (table_keys, table_ids) in enumerate(self.tables):
            slot = self._slot(keys, shift)
            np.copyto(out, table_ids[slot], where=table_keys[slot] == keys)
        return out

    def spelt(self, char: str) -> np.ndarray:
        return self.byte[list(char.encode("utf-8", "replace"))]

    def arcs(self, words: np.ndarray):
        """(start, length, rows, piece ids) of the pieces found in words, an array of code points (word, place)."""
        n, size = words.shape
        sums = np.zeros((n, size + 1), np.uint64)
        for j in range(size):
            sums[:, j + 1] = sums[:, j] * _P + words[:, j].astype(np.uint64) + np.uint64(1)
        power = np.ones(1, np.uint64)
        for k in range(1, min(self.longest, size) + 1):
            power = power * _P
            ids = self.find(sums[:, k:] - sums[:, :-k] * power)
            for i in range(size - k + 1):
                rows = np.flatnonzero(ids[:, i] < len(self.log_p) - 1)
                if len(rows):
                    yield i, k, rows, ids[rows, i]

    def batch(self, words: list[str], expected: np.ndarray | None = None, weights: np.ndarray | None = None) -> np.ndarray:
        """Natural log probability of each word (all of one length); adds weighted expected piece counts to ``expected``."""
        text = np.array([list(map(ord, SIGN + w)) for w in words], np.int64)
        n, size = text.shape
        chars, where = np.unique(text, return_inverse=True)
        spelling = [self.spelt(chr(c)) for c in chars]
        by_bytes = np.array([self.log_p[s].sum() for s in spelling])[where.reshape(n, size)]
        arcs: list[list] = [[] for _ in range(size + 1)]
        for i, k, rows, ids in self.arcs(text):
            arcs[i + k].append((i, rows, ids))
        forward = np.full((n, size + 1), -np.inf)
        forward[:, 0] = 0
        for j in range(1, size + 1):
            now = forward[:, j - 1] + by_bytes[:, j - 1]
            for i, rows, ids in arcs[j]:
                now[rows] = np.logaddexp(now[rows], forward[rows, i] + self.log_p[ids])
            forward[:, j] = now
        total = forward[:, size]
        if expected is not None:
            back = np.full((n, size + 1), -np.inf)
            back[:, size] = 0
            for j in range(size, 0, -1):
                for i, rows, ids in [*arcs[j], (j - 1, None, None)]:
                    if rows is None:
                        step = by_bytes[:, j - 1] + back[:, j]
                        share = np.exp(forward[:, j - 1] + step - total) * weights
                        for c in np.flatnonzero(np.bincount(where.reshape(n, size)[:, j - 1], minlength=len(chars))):
                            np.add.at(expected, spelling[c], share[where.reshape(n, size)[:, j - 1] == c].sum())
                        back[:, j - 1] = np.logaddexp(back[:, j - 1], step)
                    else:
                        step = self.log_p[ids] + back[rows, j]
                        np.add.at(expected, ids, np.exp(forward[rows, i] + step - total[rows]) * weights[rows])
                        back[rows, i] = np.logaddexp(back[rows, i], step)
        return total

    def words(self, words: list[str], expected: np.ndarray | None = None, counts: np.ndarray | None = None) -> np.ndarray:
        out = np.zeros(len(words))
        sizes = np.array(list(map(len, words)))
        order = np.argsort(sizes, kind="stable")
        edges = np.flatnonzero(np.concatenate(([True], np.diff(sizes[order]) > 0, [True]))) if len(words) else []
        for a, b in zip(edges, edges[1:]):
            step = max(1, 65_536 // (int(sizes[order[a]]) + 1))
            for at in range(a, b, step):
                rows = order[at : min(b, at + step)]
                out[rows] = self.batch([words[r] for r in rows], expected, None if counts is None else counts[rows])
        return out


def chunked(documents: DataFrame, chunks: int) -> DataFrame:
    return documents.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int"))


def fitted_exponent(expected: np.ndarray) -> float:
    """The t whose weights (rank + 10) ** -t make the expected piece counts most likely: their mean log rank is the weights' own."""
    logs = np.log(np.arange(len(expected)) + 10.0)
    if not expected.sum():
        return 1.0
    wanted, low, high = float(expected @ logs / expected.sum()), 0.0, 8.0
    for _ in range(60):
        t = (low + high) / 2
        weights = np.exp(-t * logs)
        low, high = (t, high) if float(weights @ logs / weights.sum()) > wanted else (low, t)
    return (low + high) / 2


def score(documents: DataFrame, vocabulary_path: str, training: str = "train", chunk_bytes: int = 16 << 20, prior: float = 2000.0) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens long, base_score, score, vocabulary_score double per row; ``training`` names a boolean column."""
    spark = documents.sparkSession
    scratch = Scratch(spark, "lattice")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col(training), F.lit(False)).alias("train"))
    facts = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("bytes"), F.count_if("train").alias("ends")).first()
    ends = int(facts["ends"])
    chunks = tasks_for(spark, facts["bytes"], chunk_bytes)
    # dealt out by as many partitions as there are chunks, so that a task's share doesn't grow with the input
    docs = chunked(docs, chunks).repartition(chunks, "chunk")

    def vocabulary(key, t):
        seen: Counter = Counter()
        for text, train in zip(t.column("text").to_pylist(), t.column("train").to_pylist()):
            words = text.encode().lower().split()
            if train:
                seen.update(words)
            else:
                for w in words:
                    if w not in seen:
                        seen[w] = 0
        return pa.table({"chunk": pa.array([key[0].as_py()] * len(seen), pa.int32()), "word": pa.array(list(seen), pa.binary()), "n": pa.array(list(seen.values()), pa.int64())})

    chunk_words = scratch.write(docs.groupBy("chunk").applyInArrow(vocabulary, "chunk int, word binary, n long"), "chunk-words")
    counts = scratch.write(chunk_words.groupBy("word").agg(F.sum("n").alias("c")), "words")
    told = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first()
    tokens, kinds, once, twice = map(int, told)
    n, v = tokens + ends, kinds + (ends > 0)

    pieces = read_vocabulary(vocabulary_path)
    ranks = np.log(np.arange(len(pieces)) + 10.0)

    def expected_counts(log_p: np.ndarray) -> np.ndarray:
        """Expected piece counts of the distinct training words; as many rows as the vocabulary file has come back."""

        def expect(batches):
            lattice, expected = Lattice(pieces, log_p), np.zeros(len(pieces))
            for batch in batches:
                lattice.words([w.decode() for w in batch.column("word").to_pylist()], expected, np.ones(batch.num_rows))
            at = np.flatnonzero(expected)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(expected[at])], ["piece", "n"])

        out = np.zeros(len(pieces))
        for r in counts.filter("c > 0").select("word").mapInArrow(expect, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect():
            out[r["piece"]] = r["n"]
        return out

    own = -ranks - np.logaddexp.reduce(-ranks)
    learned = own
    if kinds:
        expected = expected_counts(own)
        t = fitted_exponent(expected)
        own = -t * ranks - np.logaddexp.reduce(-t * ranks)
        for step in range(2):
            learned = np.log((expected + prior * np.exp(own)) / (expected.sum() + prior))
            if not step:
                expected = expected_counts(learned)
    discount = min(max(once / (once + 2 * twice), 0.1), 0.9) if once + twice else 0.5
    # one token more than there are, half of it an end and half of it an unknown word
    log_end = float(np.log((ends + 0.5) / (n + 1)))
    log_new = float(np.log((discount * kinds + 0.5) / (n + 1)))
    log_word = float(np.log1p(-np.exp(log_end)))

    def solve(batches):
        trained, bare = Lattice(pieces, learned), Lattice(pieces, own)
        for batch in batches:
            words, c = [w.decode() for w in batch.column("word").to_pylist()], batch.column("c").to_numpy()
            with np.errstate(divide="ignore"):
                whole = np.log(np.maximum(c - discount, 0) / (n + 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.logaddexp(whole, log_new + trained.words(words))), pa.array(log_word + bare.words(words))], ["word", "c", "lp", "vp"])

    solved = scratch.write(counts.select("word", "c").mapInArrow(solve, "word binary, c long, lp double, vp double"), "solved")
    back = chunk_words.select("chunk", "word").join(solved, "word")
    unit = n + 0.5 * (v + 1)

    def read(left, right):
        place = {w: i for i, w in enumerate(right.column("word").to_pylist())}
        c, lp, vp = right.column("c").to_numpy(), right.column("lp").to_numpy() / LOG10, right.column("vp").to_numpy() / LOG10
        base = np.log10((c + 0.5) / unit)
        end_base, end_known, end_own = float(np.log10((ends + 0.5) / unit)), int(ends > 0), log_end / LOG10
        out: list[tuple] = []
        for text in left.column("text").to_pylist():
            words = text.encode().lower().split()
            at = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
            out.append((len(words) + 1, int((c[at] > 0).sum()) + end_known, float(base[at].sum()) + end_base, float(lp[at].sum()) + end_own, float(vp[at].sum()) + end_own))
        cols = list(zip(*out)) if out else [[]] * 5
        return pa.table(
            {
                "doc_id": left.column("doc_id"),
                "n_tokens": pa.array(cols[0], pa.int64()),
                "n_known": pa.array(cols[1], pa.int64()),
                "train_tokens": pa.array([n] * left.num_rows, pa.int64()),
                "base_score": pa.array(cols[2], pa.float64()),
                "score": pa.array(cols[3], pa.float64()),
                "vocabulary_score": pa.array(cols[4], pa.float64()),
            }
        )

    schema = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double, vocabulary_score double"
    return docs.select("chunk", "doc_id", "text").repartition(chunks, "chunk").groupBy("chunk").cogroup(back.repartition(chunks, "chunk").groupBy("chunk")).applyInArrow(read, schema)
