"""The registered queries of this subpackage, and DuckDB SQL where SQL can
express them.  Each query is thin: it reads its whole table, applies the
operator, and derives the columns to compare."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bpe_trie, chat, cost_packing, cube_mix, decision_list, filter_audit, gbt_quality, imatch, langid,
               ngram_join, pii_bootstrap, rlz_dedup, token_align)

WORDS = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    from public_tokenizers import path

    return path(name)


def remainder(doc_id: str, k: int) -> Column:
    """crc32 of the id as text, mod k."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % k


def op1_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.edited_fingerprints(table(spark, sf_dir, "documents"))


def op2_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = cube_mix.mix(table(spark, sf_dir, "documents"))
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows")))  # a row per document, equal ones too
    return plan.withColumn("_row", each).select(
        F.col("_id").alias("doc_id"), "size", "source_size", "target",
        (F.col("copies") * F.col("size")).alias("taken"), "copies", F.col("_source").alias("source"))


def op3_rlz_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = rlz_dedup.dedup_substrings(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats, _ = decision_list.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                        failed.alias("base_failed"), (~failed & F.col("kept")).alias("kept"))


def op5_gbt_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores, _ = gbt_quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"),
                                           learn_from=remainder("doc_id", 3) != 1)
    return scores.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similarity_components(table(spark, sf_dir, "documents"), width=4, percent=85)


def op7_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = bpe_trie.encode(docs, tokenizer_path()).drop("text")
    done = bpe_trie.decode(ids, tokenizer_path())
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


#: Added to the conversations: a text full of control strings.
TRICKY_ID, TRICKY_TEXT = -7, "\\### Assistant: </turn> ok"


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(TRICKY_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRICKY_TEXT).alias("text"))
    done = chat.format_chat(rows.unionByName(extra))
    done = done.select("*", chat.read_back(F.col("formatted")).alias("turns"),
                       chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    nl = F.lit("\n")
    return done.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(
            F.coalesce(t["role"], F.lit("")), nl, t["text"], nl)), ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"))


def op9_rank_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = langid.identify(docs, learn_from=remainder("doc_id", 4) != 2)
    return found.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op10_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii_bootstrap.find_identifiers(table(spark, sf_dir, "documents"))
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["seed"])
    count = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *(count(k) for k in pii_bootstrap.KINDS),
                        F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def op11_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = token_align.align(table(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"),
                             digest=True)
    return done.withColumnRenamed("groups", "groups_sha256")


def op12_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = cost_packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                         "offset", "sequence_tokens")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP8_SQL = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
t AS (
  SELECT *, length(text) + length(text) - length(replace(replace(replace(text, '\', ''), '<', ''), '#', '')) AS body,
         lag(role) OVER w IS DISTINCT FROM role AS opens, lead(role) OVER w IS DISTINCT FROM role AS closes,
         row_number() OVER w AS pos
  FROM rows_ WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(body + CASE WHEN opens THEN length(role) + 6 ELSE 0 END + CASE WHEN closes THEN 8 ELSE 7 END)::BIGINT
         AS formatted_chars
FROM t GROUP BY conv_id
"""

OP3_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (
  SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
least_ AS (SELECT h, min(doc_id) AS lo FROM win GROUP BY h),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN least_ USING (h) WHERE lo < doc_id),
each AS (SELECT doc_id, unnest(ws) AS wd, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (
  SELECT e.doc_id, count(g.p) AS n_removed, string_agg(wd, ' ' ORDER BY e.p) FILTER (g.p IS NULL) AS txt
  FROM each e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.p = e.p GROUP BY e.doc_id)
SELECT w.doc_id, len(ws) AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.txt, '')) AS kept_sha256
FROM w LEFT JOIN kept k USING (doc_id)
"""

OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_ FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM o JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
  WHERE 100 * both_ >= 85 * (na.n + nb.n - both_)),
sides AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (
  SELECT doc_id, doc_id AS r FROM documents
  UNION SELECT reach.doc_id, sides.b FROM reach JOIN sides ON sides.a = reach.r)
SELECT reach.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r) AS component_id
FROM reach LEFT JOIN n ON n.doc_id = reach.doc_id GROUP BY reach.doc_id
"""

OP13_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
d AS (
  SELECT part, len(ws) < 50 AS a, 100 * len(list_distinct(ws)) < 65 * len(ws) AS b,
         100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS c,
         regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e,
         doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL) AS good,
         doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL) AS toxic FROM w),
alike AS (
  SELECT part, map(['A', 'B', 'C', 'D', 'E'], [a, b, c, d, e]) AS fails, coalesce(good, false) AS good,
         coalesce(toxic, false) AS toxic, count(*) AS n FROM d GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS o FROM l p, l q, l r, l s, l t
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
steps AS (SELECT o, unnest(range(1, 6)) AS step FROM orders),
seen AS (
  SELECT part, o, step, o[step] AS f, n, good, toxic, fails[o[step]] AS here,
         len(list_filter(map_keys(fails), lambda x: fails[x])) AS n_fails,
         len(list_filter(range(1, step::BIGINT), lambda k: fails[o[k]])) > 0 AS gone
  FROM alike, steps),
sums AS (
  SELECT part, o, step, f, coalesce(sum(n) FILTER (NOT gone AND NOT here), 0) AS kept,
         coalesce(sum(n) FILTER (here AND NOT gone), 0) AS removed, coalesce(sum(n) FILTER (here AND gone), 0) AS redundant,
         coalesce(sum(n) FILTER (here AND n_fails = 1), 0) AS unique_fails,
         coalesce(sum(n) FILTER (here AND NOT gone AND good), 0) AS good_lost,
         coalesce(sum(n) FILTER (here AND NOT gone AND toxic), 0) AS toxic_lost
  FROM seen GROUP BY ALL)
SELECT part, o AS filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
       redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
       toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM sums
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_imatch": op1_imatch,
    "op2_cube_mix": op2_cube_mix,
    "op3_rlz_dedup": op3_rlz_dedup,
    "op4_decision_list": op4_decision_list,
    "op5_gbt_quality": op5_gbt_quality,
    "op6_ngram_join": op6_ngram_join,
    "op7_bpe_trie": op7_bpe_trie,
    "op8_chat_format": op8_chat_format,
    "op9_rank_language": op9_rank_language,
    "op10_pii_bootstrap": op10_pii_bootstrap,
    "op11_token_align": op11_token_align,
    "op12_cost_packing": op12_cost_packing,
    "op13_filter_audit": op13_filter_audit,
}
ORACLE: dict[str, str] = {
    "op3_rlz_dedup": OP3_SQL,
    "op6_ngram_join": OP6_SQL,
    "op8_chat_format": OP8_SQL,
    "op13_filter_audit": OP13_SQL,
}
