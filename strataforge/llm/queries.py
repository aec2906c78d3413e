"""The operators over whole tables, and their reference SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from public_tokenizers import PATTERN, path
from pyspark.sql import DataFrame, SparkSession, functions as F

from strataforge.functions.windows import rank_in_order
from strataforge.llm import (
    bpe, chat, context_mixing, decontaminate, jaccard_join, ordinal, periodic_runs, personal_data, quality_rules, resampling, sharding, suffix_dedup, token_files,
)
from strataforge.session import prepare, scratch, staged

RANKS, WORD_TOKENS = path("byte_bpe_50k.tiktoken"), path("word_bpe_49k.json")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def op1(spark: SparkSession, folder: str) -> DataFrame:
    """Grades: 0 low quality, 1 toxic, 2 neither."""
    grade = F.col("quality") * (2 - F.col("toxic"))
    rated = ordinal.rate(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "labels"), grade, 3)
    return rated.select("doc_id", "rating.expected_grade", "rating.p_top", ordinal.selected().alias("selected"))


def op2(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, folder, "documents"), words=3, percent=90)


def op3(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = decontaminate.find_passages(docs, table(spark, folder, "benchmark"))
    return found.select(
        "doc_id",
        "overlap.n_words",
        "overlap.n_hit",
        F.size("overlap.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("overlap.items", ","), 256).alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"),
    )


def op4(spark: SparkSession, folder: str) -> DataFrame:
    prepare(spark)
    given = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", control), (-7, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    order = [F.col(c).asc_nulls_first() for c in ("turn", "role", "text")]
    placed = rank_in_order(given.unionByName(more), ["conv_id"], order, "place")
    nodes = placed.select("conv_id", "place", (F.col("place") - 1).alias("reply_to"), "role", "text", F.lit(0.0).alias("score"))
    # formatted once; the digests below are read back from what was written
    done = chat.format_trees(nodes, "conv_id", "place", "reply_to", "role", "text", "score")
    done = staged(done.withColumnRenamed("tree", "conv_id"), "conversations")
    turns = chat.read_turns(F.col("formatted"))
    read = done.select("conv_id", "formatted", turns.alias("turns"), chat.read_learned(F.col("formatted"), F.col("learn")).alias("learned"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op5(spark: SparkSession, folder: str) -> DataFrame:
    coded = bpe.encode(table(spark, folder, "documents").select("doc_id", "text"), RANKS, PATTERN, slice_bytes=4 << 20).drop("text")
    read = bpe.read_back(coded, RANKS)
    return read.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2("read.packed", 256).alias("ids_sha256"),
        F.sha2("read.decoded", 256).alias("decoded_sha256"),
    )


def op6(spark: SparkSession, folder: str) -> DataFrame:
    left = suffix_dedup.remove_repeats(table(spark, folder, "documents"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7(spark: SparkSession, folder: str) -> DataFrame:
    placed = sharding.assign_shards(table(spark, folder, "documents"))
    return placed.select(
        "doc_id", "placed.size", "placed.text_crc32", F.lit("bytes").alias("law"), "placed.shard", "placed.slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op8(spark: SparkSession, folder: str) -> DataFrame:
    files = token_files.write_tokens(table(spark, folder, "documents"), scratch(spark, "tokens"), WORD_TOKENS)
    read = token_files.read_tokens(spark, files)
    packed = bpe.packed(read.select("doc", "start", "n_tokens", "ids"))
    return packed.select(F.col("doc").alias("doc_id"), "start", F.size("ids").cast("long").alias("n_tokens"), F.crc32("packed").alias("ids_crc32"))


def op9(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    rated = quality_rules.rate(docs, table(spark, folder, "labels"))
    return rated.select(
        "doc_id",
        *[f"quality.{c}" for c in quality_rules.FIELDS],
        quality_rules.base_failed().alias("base_failed"),
        quality_rules.kept().alias("kept"),
        F.col("quality.ratio").alias("log_ratio"),
    )


def op10(spark: SparkSession, folder: str) -> DataFrame:
    found = personal_data.find(table(spark, folder, "documents").select("doc_id", "text"))
    base = F.col("found.base")
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [(F.size(base) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in personal_data.KINDS]
    return found.select("doc_id", *counts, F.sha2(personal_data.joined(base), 256).alias("base_sha256"), personal_data.joined(F.col("found.spans")).alias("spans"))


def op11(spark: SparkSession, folder: str) -> DataFrame:
    docs, target = table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark")
    drawn = resampling.resample(docs, target, longest=1, buckets=10_000, seed=2024, percent=10, least_words=20)
    return drawn.select("doc_id", "drawn.n_features", "drawn.weight", "drawn.score", "drawn.rank")


def op12(spark: SparkSession, folder: str) -> DataFrame:
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    scored = context_mixing.score_texts(table(spark, folder, "documents").select("doc_id", "text"), ~held)
    fields = [f"lm.{c}" for c in ("n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")]
    return scored.select("doc_id", held.alias("held_out"), *fields)


def op13(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    split = docs.withColumn("h", h).withColumn("words", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))))
    n, g = F.size("words"), F.floor(F.col("h") / 10)
    sized = split.withColumn("n", n).withColumn("a", F.when(F.col("n") > 0, (g % F.col("n")).cast("int")))
    sized = sized.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + g % 8))).cast("int"))
    rest = F.col("n") - F.col("a")
    repeated = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil(rest / F.col("p")).cast("int")))
    periodic = F.array_join(F.concat(F.slice("words", 1, F.col("a")), F.slice(repeated, F.lit(1), rest)), " ")
    planted = sized.select("doc_id", F.when(F.col("n") > 0, periodic).otherwise(F.col("text")).alias("text"))
    found = periodic_runs.periodic_runs(planted).select("doc_id", "periodic.runs", "periodic.collapsed")
    greatest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("less"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("top", greatest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("top.before")).alias("start"),
        F.col("top.length").alias("length"),
        (-F.col("top.less")).alias("period"),
        F.floor(1000 * F.col("top.length") / -F.col("top.less")).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ordinal_quality": op1,
    "op2_ngram_jaccard": op2,
    "op3_wu_manber": op3,
    "op4_reply_trees": op4,
    "op5_merge_replay": op5,
    "op6_suffix_radix": op6,
    "op7_longest_first": op7,
    "op8_token_lists": op8,
    "op9_likelihood_rules": op9,
    "op10_bilstm_crf": op10,
    "op11_segment_resampling": op11,
    "op12_context_mixing": op12,
    "op13_diagonal_runs": op13,
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: crc32 in SQL: the table of the 256 remainders, and the fold over a text's bytes
CRC_TABLE = """crc_table AS (
  SELECT list(list_reduce(list_prepend(n::BIGINT, generate_series(1, 8)), lambda c, step: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY n) AS tab
  FROM generate_series(0, 255) AS g(n)
)"""
CRC = """xor(4294967295, list_reduce(
  list_prepend(4294967295::BIGINT, list_transform(generate_series(1, 2 * strlen({0}) - 1, 2), lambda i: ('0x' || substr(hex({0}), i, 2))::BIGINT)),
  lambda c, byte: xor(c // 256, tab[xor(c, byte) % 256 + 1])))"""

ORACLES = {
    "op2_ngram_jaccard": rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, list_aggregate(ws[i:i + least(len(ws), 3) - 1], 'string_agg', ' ') AS g
  FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 2, 1))) AS i FROM w WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n
  HAVING 100 * count(*) >= 90 * (na.n + nb.n - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, r.c AS component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS c FROM reach GROUP BY a) r USING (doc_id)
""",
    "op3_wu_manber": rf"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), p AS (
  SELECT DISTINCT item_id, least(len(ws), 13) AS k, list_aggregate(ws[i:i + least(len(ws), 13) - 1], 'string_agg', ' ') AS g
  FROM (SELECT item_id, ws, unnest(generate_series(1, greatest(len(ws) - 12, 1))) AS i FROM b WHERE len(ws) > 0)
), sizes AS (
  SELECT DISTINCT k FROM p
), d AS (
  SELECT doc_id, k, i, list_aggregate(ws[i:i + k - 1], 'string_agg', ' ') AS g
  FROM (SELECT doc_id, ws, k, unnest(generate_series(1, len(ws) - k + 1)) AS i FROM w, sizes WHERE len(ws) >= k)
), hits AS (
  SELECT d.doc_id, d.i, d.k, p.item_id FROM d JOIN p ON d.g = p.g AND d.k = p.k
), covered AS (
  SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS x FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
""",
    "op4_reply_trees": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, replace(replace(replace(role, '\', '\b'), '<|', '<\p'), chr(10), '\n') AS r, replace(replace(text, '\', '\b'), '<|', '<\p') AS x FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(r) + length(x) + 17)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
""",
    "op11_segment_resampling": rf"""
WITH {CRC_TABLE}, w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), d AS (
  SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(ws) AS word FROM w) GROUP BY ALL
), b AS (
  SELECT word, count(*) AS n FROM (
    SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark
  ) GROUP BY ALL
), bucket AS (
  SELECT word, {CRC.format("word")} % 10000 AS k FROM (SELECT word FROM d UNION SELECT word FROM b), crc_table
), s AS (
  SELECT k, sum(n) AS s FROM d JOIN bucket USING (word) GROUP BY k
), t AS (
  SELECT k, sum(n) AS t FROM b JOIN bucket USING (word) GROUP BY k
), gain AS (
  SELECT k, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + 10000)
    / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)))) AS gain FROM s FULL JOIN t USING (k)
), weight AS (
  SELECT doc_id, floor(sum(n * gain) / sum(n))::BIGINT AS weight FROM d JOIN bucket USING (word) JOIN gain USING (k) GROUP BY doc_id
), scored AS (
  SELECT doc_id, len(ws) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM w LEFT JOIN weight USING (doc_id)
), ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS able FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * able // 100 THEN place END AS rank FROM scored LEFT JOIN ranked USING (doc_id)
""",
    "op13_diagonal_runs": rf"""
WITH {CRC_TABLE}, w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws, {CRC.format("doc_id::VARCHAR")} AS h FROM documents, crc_table
), p AS (
  SELECT *, a, 1 + (len(ws) - a) // (3 + (h // 10) % 8) AS p
  FROM (SELECT *, CASE WHEN h % 10 = 0 AND len(ws) > 0 THEN (h // 10) % len(ws) ELSE len(ws) END AS a FROM w)
), t AS (
  SELECT doc_id, i, ws[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1] AS word
  FROM (SELECT doc_id, ws, a, p, unnest(generate_series(0, len(ws) - 1)) AS i FROM p WHERE len(ws) > 0)
), cells AS (
  SELECT x.doc_id, x.i - y.i AS q, x.i FROM t x JOIN t y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i < x.i
), islands AS (
  SELECT doc_id, q, min(i) - q AS start, count(*) + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM cells) GROUP BY doc_id, q, island
  HAVING count(*) >= greatest(q, 12 - q)
), runs AS (
  SELECT doc_id, start, length, min(q) AS period FROM islands GROUP BY doc_id, start, length
), dropped AS (
  SELECT DISTINCT doc_id, unnest(generate_series(start + period, start + length - 1)) AS i FROM runs
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS collapsed FROM t ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id
), said AS (
  SELECT doc_id, count(*) AS n, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
    max({{'length': length, 'before': -start, 'less': -period}}) AS top
  FROM runs GROUP BY doc_id
)
SELECT doc_id, coalesce(n, 0) AS n_runs, -top.before AS start, top.length AS length, -top.less AS period,
  1000 * top.length // -top.less AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM w LEFT JOIN said USING (doc_id) LEFT JOIN kept USING (doc_id)
""",
}
