"""The corpus pipeline: language, near duplicates, personal data, mixture,
tokens.

Every stage takes ``(spark, docs, sf_dir)``, works on all rows it is given and
returns a DataFrame that is written as Parquet and read again as the next
stage's ``docs``; all but the last return the columns of ``documents``.

1. ``language``: documents whose language cannot be told (null or without a
   letter) go; a null ``lang`` is filled with the language found.  If no
   document has a ``lang``, none can be learned and it stays null; the same
   documents go.
2. ``near_duplicates``: of each group of documents connected by a Jaccard
   similarity of 0.8 or more over five-word shingles, the one with the
   smallest id stays.  Documents without words stay, as they resemble nothing;
   rows with a null id stay, as a group cannot be named by it.  Rows with one
   id but different texts are documents of their own (of these, the one with
   the smaller hash counts as smaller); of rows equal in id and text the least
   stays.
3. ``personal_data``: every identifier found is replaced by its kind in
   brackets; ``n_chars`` follows the new text.
4. ``mixture``: sources are mixed to target weights; a document that is taken
   several times has several rows, one that is not taken has none.
5. ``tokens``: the token ids of every text, with the columns of the document.

Null ids, texts, languages and sources, empty and very long texts, repeated
rows, ties, empty tables and other columns are treated as the operators'
docstrings say.  No stage's result depends on the order of its input.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inboxsieve.llm import bpe_trie, cube_mix, langid, ngram_join, pii_bootstrap
from inboxsieve.llm.queries import tokenizer_path
from inboxsieve.session import checkpoint_dir


#: Size of an Arrow batch between an executor and its Python workers: a number of rows alone is no bound for long
#: texts, and both sides hold a batch of every running task.
BATCH_BYTES = "4m"


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    if docs.where("lang IS NOT NULL").limit(1).count() == 0:  # nothing to learn from
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = langid.identify(docs, pred="_lang_pred", score="_lang_score").where(
        F.col("_lang_pred") != langid.UNDETERMINED)
    return found.withColumn("lang", F.coalesce("lang", "_lang_pred")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    ids = docs.where("doc_id IS NOT NULL").select("doc_id")
    repeated = ids.groupBy("doc_id").count().where("count > 1").limit(1).count() > 0
    # an id that repeats does not name a text: then id and text do
    name = F.struct("doc_id", F.xxhash64("text").alias("hash")) if repeated else F.col("doc_id")
    named = docs.withColumn("_name", F.when(F.col("doc_id").isNotNull(), name))
    groups = ngram_join.similarity_components(named, doc_id="_name")
    stay = groups.where("_name = component_id").select(F.col("_name").alias("_stay")).distinct()
    kept = named.join(stay, F.col("_name") == F.col("_stay"), "left_semi")
    if repeated:
        one = kept.groupBy("_name").agg(F.min(F.struct(*docs.columns)).alias("_row"))
        kept = one.select("_row.*")
    return kept.select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = pii_bootstrap.redact(docs)
    size = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return clean.withColumn("n_chars", F.coalesce(size, F.col("n_chars"))).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    return cube_mix.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    done = bpe_trie.encode(docs.select("doc_id", "lang", "source", "n_chars", "text"), tokenizer_path())
    return done.select("doc_id", "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixture", mixture),
    ("tokens", tokens),
]

#: SQL cannot express these stages; tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and
    read again; a stage's files go once the next stage is written."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    folder = f"{checkpoint_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if k:
            before = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
            before.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(before, True)
    return docs
