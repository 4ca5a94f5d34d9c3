"""The thin queries over the operators, one for each, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, langid, lattice, linededup, neardup, packing, quality, substring, surrogate

#: where the vocabulary files of public tokenizers lie; a parameter of every operator that reads one
WORD_BPE = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def bucket_of(doc_id: str, n: int):
    """crc32 of doc_id as text, modulo n."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n


def op1_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A keyed run: the key is a deployment's secret, taken from the session where it is set."""
    key = spark.conf.get("spark.sentrylake.surrogate.key", "change this key")
    return surrogate.replace_entities(table(spark, sf_dir, "documents").select("doc_id", "text"), key.encode()).select("doc_id", "n_entities", "text")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(bucket_of("doc_id", 5) == 0, F.lit(False))
    profiles = langid.learn_profiles(docs.filter(~held_out))
    return langid.predict(docs.select("doc_id", "text", held_out.alias("held_out")), profiles).select("doc_id", "held_out", "lang_pred", "score")


def op3_lattice_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(bucket_of("doc_id", 5) == 1, F.lit(False))
    scored = lattice.score(docs.withColumn("train", ~held_out), tokenizer_path(PIECES))
    return scored.select("doc_id", F.coalesce(bucket_of("doc_id", 5) == 1, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "vocabulary_score")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.drop_repeats(table(spark, sf_dir, "documents")).drop("intervals")


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), threshold=85)


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(WORD_BPE))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.adaptive_filter(table(spark, sf_dir, "documents"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.read_back(chat.budgeted_windows(rows.unionByName(more)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_surrogates, op2_language, op3_lattice_score, op4_line_dedup, op5_decontaminate, op6_substring_dedup, op7_near_duplicates, op8_pack, op9_quality, op10_chat)}


LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
STRIP = r"regexp_replace({}, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')"

OP4_SQL = f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, {LOWER.format(STRIP.format("line"))} AS key FROM l),
f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
j AS (SELECT k.*, f.first IS NOT NULL AND doc_id > f.first AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(count_if(gone) AS BIGINT) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM j GROUP BY doc_id"""

OP5_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item_id, array_to_string(w[i : i + 9], ' ') AS seq, least(len(w), 10) AS k FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') AS seq FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw))),
h AS (SELECT dw.doc_id, dw.i, dw.k, bw.item_id FROM dw JOIN bw USING (seq, k)),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM h)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, c.n IS NOT NULL AS contaminated FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)"""

OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 34], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
r AS (SELECT doc_id, i FROM x JOIN (SELECT h FROM x GROUP BY h HAVING count(*) > 1) USING (h)),
c AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 35)) AS p FROM r)),
s AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
k AS (SELECT s.doc_id, count_if(c.p IS NOT NULL) AS gone, string_agg(word, ' ' ORDER BY s.p) FILTER (c.p IS NULL) AS kept FROM s LEFT JOIN c ON c.doc_id = s.doc_id AND c.p = s.p GROUP BY s.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""

OP7_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i : i + 4], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM g a JOIN g b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
c AS (SELECT doc_id, doc_id AS r FROM d UNION SELECT u.b, c.r FROM c JOIN u ON u.a = c.doc_id AND c.r < u.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r) AS component_id, min(r) = d.doc_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN c ON c.doc_id = d.doc_id GROUP BY d.doc_id, n.n"""


#: windows by recursion over the turns: tokens used so far, and characters written so far
OP10_SQL = r"""
WITH RECURSIVE a AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
b AS (SELECT *, length(regexp_replace(text, '[^\\<\[]', '', 'g')) AS signs, length(regexp_replace(role, '[^\\<\[]', '', 'g')) AS role_signs, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS i FROM a),
c AS (SELECT *, CAST(ceil((length(text) + signs) / 3.0) AS BIGINT) + strlen(text) - length(text) + 6 AS n, length(text) + signs + length(role) + role_signs + 13 AS size, CASE WHEN i = 0 AND role = 'system' THEN 1 ELSE 0 END AS is_system FROM b),
d AS (SELECT *, max(is_system) OVER p AS lowest, max(is_system * n) OVER p AS system_n, max(is_system * size) OVER p AS system_size, lag(n, 1) OVER o AS n1, lag(n, 2) OVER o AS n2, lag(size, 1) OVER o AS size1, lag(size, 2) OVER o AS size2, coalesce(floor(turn / 512) <> lag(floor(turn / 512)) OVER o, false) AS part_begins
  FROM c WINDOW p AS (PARTITION BY conv_id), o AS (PARTITION BY conv_id ORDER BY i)),
e AS (SELECT *, coalesce(i - 1 >= lowest AND n1 <= least(192, 1024 - system_n - n), false) AS one, coalesce(i - 2 >= lowest AND n1 + n2 <= least(192, 1024 - system_n - n), false) AS two FROM d),
f AS (SELECT *, CASE WHEN two THEN n1 + n2 WHEN one THEN n1 ELSE 0 END AS again_n, CASE WHEN two THEN size1 + size2 WHEN one THEN size1 ELSE 0 END AS again_size FROM e),
r AS (
  SELECT conv_id, i, n AS used, size AS chars FROM f WHERE i = 0
  UNION ALL
  SELECT f.conv_id, f.i, CASE WHEN used + n <= 1024 AND NOT part_begins THEN used + n ELSE system_n + again_n + n END, chars + size + CASE WHEN used + n <= 1024 AND NOT part_begins THEN 0 ELSE system_size + again_size END FROM r JOIN f ON f.conv_id = r.conv_id AND f.i = r.i + 1)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(max(chars) AS BIGINT) AS formatted_chars
FROM b JOIN r USING (conv_id, i) GROUP BY conv_id"""


def oracle_sql() -> dict[str, str]:
    return {"op4_line_dedup": OP4_SQL, "op5_decontaminate": OP5_SQL, "op6_substring_dedup": OP6_SQL, "op7_near_duplicates": OP7_SQL, "op10_chat": OP10_SQL}
