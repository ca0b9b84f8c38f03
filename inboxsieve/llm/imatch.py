"""I-Match document fingerprints, in DataFrame expressions only.

The lexicon holds the terms whose document frequency lies in a band (so their
inverse document frequency does): neither words that stand everywhere nor
names and noise.  Frequencies are counted over different texts, so copies do
not push their words out of the band.  A document's fingerprint keeps its terms of the lexicon,
sorts the distinct ones, and hashes those that fall into each of several
randomised subsets of the lexicon.  A few changed words leave the subsets
without these words as they were, so the share of equal hashes tells how alike
two documents are.

One density of the subsets does not suit short and long documents alike.
Subsets come in densities 1, 1/4, 1/16, ...; a document with D terms uses the
density next to 1/D and the one after it, up to ten disjoint subsets each, so
a subset has about one term.  Two fingerprints are compared at the densities they have in
common; a subset that is empty in both counts for nothing.

Near copies that make up much of a table, short texts and rare languages may
have next to no term in the band.  So every document also has a fingerprint of
all its terms, made by the same subsets; where one of two documents has fewer
than ``FEW`` terms of the lexicon, or less than ``PART`` of its terms there,
they are compared by these.

Size of the lexicon: a term of it stands in a share ``min_df`` of all
documents at least, so there are at most (mean distinct terms of a document) /
``min_df`` of them, however many documents there are.  It is counted before it
is broadcast and joined by a shuffle beyond ``MAX_BROADCAST_TERMS``.

Cases: a null text is an empty one; documents with too few terms of the
lexicon show the fingerprint of all their terms; documents without any term
equal each other; equal texts get equal fingerprints; rows that repeat an id follow
its last row in no special order, the next document being that of the next
larger id (its longest text where it has several); a null id has no next
document; an empty table gives an empty result; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir

SPACE = r"[\x20\x09-\x0D]+"
MIN_DF, MAX_DF = 0.001, 0.1
SUBSETS = 10  # for each density
EACH = 0  # stands for a document itself among its terms, so that none is lost in the join
MAX_DENSITY = 6  # 4^-6
FEW, PART = 5, 0.25  # a document with fewer terms, or a smaller part of its terms, in the lexicon has too few there
NOTHING = 42  # the hash of an empty list
MAX_BROADCAST_TERMS = 2_000_000


def terms(text: Column) -> Column:
    """The distinct lower-cased words of a text, as 64-bit hashes."""
    hashes = F.transform(F.split(F.lower(text), SPACE), lambda w: F.xxhash64(w))
    return F.array_remove(F.array_distinct(hashes), F.xxhash64(F.lit("")))  # white space at an end gives an empty word


def lexicon(docs: DataFrame, text: str = "text", min_df: float = MIN_DF, max_df: float = MAX_DF) -> DataFrame:
    """``term`` (hash), one row for each term with a document frequency in the
    band; frequencies are counted over different texts: a row counts one
    divided by the number of rows with its text, so no text is moved."""
    checkpoint_dir(docs.sparkSession)
    texts = docs.groupBy(F.xxhash64(text).alias("_copy")).agg(F.count("*").alias("_rows")).checkpoint()
    n, copies = texts.count(), texts.where("_rows > 1")
    each = docs.select(F.xxhash64(text).alias("_key"), F.col(text).alias("_text"))
    repeated = copies.count()
    if repeated:
        side = F.broadcast(copies) if repeated <= MAX_BROADCAST_TERMS else copies
        each = each.join(side, F.col("_key") == F.col("_copy"), "left")
    else:
        each = each.withColumn("_rows", F.lit(None).cast("long"))
    each = each.select(F.coalesce("_rows", F.lit(1)).alias("_rows"), F.explode(terms(F.col("_text"))).alias("term"))
    df = F.round(F.sum(1 / F.col("_rows")), 3)  # a whole number but for rounding
    return (each.groupBy("term").agg(df.alias("df"))
            .where((F.col("df") >= min_df * n) & (F.col("df") <= max(max_df * n, 1))).select("term"))


def with_fingerprints(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """Add fingerprints (name -> column of the sorted terms): structs of the
    density's exponent (-1: no term), the hashes at it and at the next.

    The lexicon is dealt at random into 4^e subsets by the terms' hashes; the
    first ten count.  Their terms are picked out first, so that the ten subsets
    are looked for among few.  These parts are columns of their own, in steps:
    in one expression they would be worked out once for each subset."""
    e = lambda t: F.when(F.size(t) > 0, F.least(F.lit(MAX_DENSITY - 1), F.floor(F.log2(F.size(t)) / 2))).otherwise(-1)
    rows = rows.withColumns({f"_e_{n}": e(t).cast("int") for n, t in names.items()})
    mask = lambda n, more: F.pow(F.lit(4.0), F.greatest(F.col(f"_e_{n}") + more, F.lit(0))).cast("long") - 1
    rows = rows.withColumns({f"_mask_{n}_{m}": mask(n, m) for n in names for m in (0, 1)})

    def few(n: str, m: int) -> Column:
        return F.filter(names[n], lambda x: x.bitwiseAND(F.col(f"_mask_{n}_{m}")) < SUBSETS)

    rows = rows.withColumns({f"_few_{n}_{m}": few(n, m) for n in names for m in (0, 1)})

    def hashes(n: str, m: int) -> Column:
        one = lambda k: F.hash(F.filter(f"_few_{n}_{m}", lambda x: x.bitwiseAND(F.col(f"_mask_{n}_{m}")) == k))
        return F.when(F.col(f"_e_{n}") >= 0, F.array(*[one(k) for k in range(SUBSETS)]))

    return rows.withColumns({n: F.struct(F.col(f"_e_{n}").alias("e"), hashes(n, 0).alias("at"),
                                         hashes(n, 1).alias("after")) for n in names})


def as_text(f: Column, every: Column, few: Column) -> Column:
    """The fingerprint ``f`` of the lexicon terms, or ``every`` of all terms (marked) where these are too few."""
    hashes = lambda a: F.array_join(F.transform(a, lambda h: F.lower(F.lpad(F.hex(h.cast("long").bitwiseAND(
        F.lit(0xFFFFFFFF).cast("long"))), 8, "0"))), "")
    shown = lambda x: F.concat_ws(":", x["e"].cast("string"), hashes(x["at"]), hashes(x["after"]))
    return F.when(few, F.concat(F.lit("-:"), shown(every))).otherwise(shown(f))


def likeness(f: Column, g: Column) -> Column:
    """0 to 1: the greatest share of equal hashes at a density both have."""
    def share(x: Column, y: Column) -> Column:
        add = lambda flags: reduce(lambda a, b: a + b, [c.cast("int") for c in flags])
        places = [(x[k], y[k]) for k in range(SUBSETS)]
        equal = add((a == b) & (a != NOTHING) for a, b in places)
        used = add((a != NOTHING) | (b != NOTHING) for a, b in places)
        return F.when(used > 0, equal / used).otherwise(0.0)

    none = (f["e"] < 0) | (g["e"] < 0)
    return (F.when(none, (f["e"] == g["e"]).cast("double"))
            .when(f["e"] == g["e"], F.greatest(share(f["at"], g["at"]), share(f["after"], g["after"])))
            .when(f["e"] == g["e"] + 1, share(f["at"], g["after"]))
            .when(f["e"] + 1 == g["e"], share(f["after"], g["at"])).otherwise(0.0))


def next_ids(docs: DataFrame, doc_id: str) -> DataFrame:
    """``_id, _next``: each id and the next larger one, the last followed by
    the first.  Ids are dealt out by ranges; only the ranges' first ids (a row
    for each partition) meet in one task."""
    ids = (docs.select(F.col(doc_id).alias("_id")).where("_id IS NOT NULL").distinct().repartitionByRange("_id")
           .withColumn("_part", F.spark_partition_id())).checkpoint()
    firsts = ids.groupBy("_part").agg(F.min("_id").alias("first"))
    everything = Window.orderBy("_part")
    firsts = firsts.select(F.col("_part").alias("_p"), F.coalesce(
        F.lead("first").over(everything),
        F.first("first").over(everything.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("after"))
    inside = F.lead("_id").over(Window.partitionBy("_part").orderBy("_id"))
    return (ids.withColumn("_in", inside).join(F.broadcast(firsts), F.col("_part") == F.col("_p"))
            .select("_id", F.coalesce("_in", "after").alias("_next")))


def edited_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_df: float = MIN_DF,
                        max_df: float = MAX_DF) -> DataFrame:
    """Fingerprints of every whole text, and of an edited text in which the
    last quarter is replaced by as much of the beginning of the next document:
    ``<doc_id>, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next``.

    The texts are dealt out once, by id; the join with the next document's
    beginning and the collection of a document's terms stay where they are."""
    spark = docs.sparkSession
    checkpoint_dir(spark)
    docs = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    words = lexicon(docs, "_text", min_df, max_df)
    words = words.unionByName(docs.sparkSession.range(1).select(F.lit(EACH).cast("long").alias("term"))).checkpoint()
    if words.count() <= MAX_BROADCAST_TERMS:
        words = F.broadcast(words)
    sizes = docs.select("_id", F.char_length("_text").alias("n"))
    repeated = sizes.agg(F.count("_id") - F.count_distinct("_id")).first()[0] or docs.where("_id IS NULL").count() > 1
    if repeated:  # equal rows once here; what an id needs of the next document is its longest row's need
        times = docs.groupBy("_id", F.xxhash64("_text").alias("_key")).agg(F.count("*").alias("times"))
        docs = docs.dropDuplicates(["_id", "_text"])
    follow = next_ids(sizes, "_id").checkpoint()
    quarter = lambda n: F.floor(n / 4).cast("int")
    need = (sizes.groupBy("_id").agg(F.max("n").alias("n")).join(follow, "_id")
            .select(F.struct("_id").alias("before"), F.struct(F.col("_next").alias("_id")).alias("_k"),
                    quarter(F.col("n")).alias("need")))

    # one key that is never null, so both joins and the grouping below use one exchange of the texts
    placed = docs.select(F.struct("_id").alias("_k"), "_text").repartition("_k")
    heads = (placed.join(need, "_k")
             .select(F.col("before").alias("_k"), F.substring("_text", F.lit(1), F.col("need")).alias("head"),
                     F.char_length("_text").alias("of")))
    if repeated:
        heads = heads.groupBy("_k").agg(F.max_by("head", F.struct("of", "head")).alias("head"))
    n = F.char_length("_text")
    both = (placed.join(heads.select("_k", "head"), "_k", "left")
            .select("_k", "_text", n.alias("n"), F.concat(
                F.substring("_text", F.lit(1), n - quarter(n)),
                F.substring(F.coalesce("head", F.lit("")), F.lit(1), quarter(n))).alias("edited")))
    # the term lists are columns first, as both their hash and their elements are used
    lists = both.select("_k", F.xxhash64("_text").alias("_key"), "n", F.unhex(F.sha2("edited", 256)).alias("sha"),
                        terms(F.col("_text")).alias("l0"), terms(F.col("edited")).alias("l1"))
    lists = lists.withColumns({f"s{v}": F.sort_array(f"l{v}") for v in (0, 1)})
    lists = with_fingerprints(lists, {"all0": "s0", "all1": "s1"}).withColumns({f"m{v}": F.size(f"l{v}") for v in (0, 1)})
    own = lists.select("_k", "_key", "n", "sha", "all0", "all1", "m0", "m1", F.explode(F.array(
        F.struct(F.lit(0).alias("v"), F.array_append("l0", F.lit(EACH).cast("long")).alias("l")),
        F.struct(F.lit(1).alias("v"), F.col("l1").alias("l")))).alias("x"))
    own = own.select("_k", "_key", F.col("x.v").alias("v"), F.explode("x.l").alias("term"), F.struct(
        "n", "sha", "all0", "all1", "m0", "m1").alias("doc"))
    # what holds for the document goes with one of its rows
    each = own.withColumn("doc", F.when((F.col("term") == EACH) & (F.col("v") == 0), F.col("doc")))
    of = lambda v: F.when((F.col("v") == v) & (F.col("term") != EACH), F.col("term"))
    got = (each.join(words, "term").groupBy("_k", "_key")
           .agg(F.first("doc", ignorenulls=True).alias("doc"),
                *(F.sort_array(F.collect_list(of(v))).alias(f"t{v}") for v in (0, 1)))).select("_k", "_key", "doc.*", "t0", "t1")
    few = lambda v: (F.size(f"t{v}") < FEW) | (F.size(f"t{v}") < PART * F.col(f"m{v}"))
    prints = (with_fingerprints(got.withColumns({"few0": few(0), "few1": few(1)}), {"f": "t0", "g": "t1"})
              .select("_k._id", "_key", "n", F.lower(F.hex("sha")).alias("edited_sha256"), *(
                  F.struct(F.col(f).alias("own"), F.col(f"all{v}").alias("all"), F.col(f"few{v}").alias("few")).alias(f)
                  for v, f in enumerate("fg")))).checkpoint()
    after = prints.select(F.col("_id").alias("_want"), F.col("f").alias("h"), F.col("n").alias("_m"))
    if repeated:
        after = after.groupBy("_want").agg(F.max_by("h", "_m").alias("h"))

    def near(a: Column, b: Column) -> Column:
        return F.when(a["few"] | b["few"], likeness(a["all"], b["all"])).otherwise(likeness(a["own"], b["own"]))

    shown = lambda a: as_text(a["own"], a["all"], a["few"])
    done = (prints.join(follow.withColumnRenamed("_id", "_i"), F.col("_id") == F.col("_i"), "left")
            .join(after.select("_want", "h"), F.col("_next") == F.col("_want"), "left")
            .select("_id", "_key", F.col("n").cast("long").alias("n_chars"), "edited_sha256",
                    shown(F.col("f")).alias("fingerprint"), shown(F.col("g")).alias("edited_fingerprint"),
                    near(F.col("f"), F.col("g")).alias("near_edited"),
                    F.coalesce(near(F.col("f"), F.col("h")), F.lit(0.0)).alias("near_next")))
    if repeated:
        times = times.select(F.col("_id").alias("_i"), F.col("_key").alias("_y"), "times")
        done = (done.join(times, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_key") == F.col("_y")))
                .withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))))
    return done.select(F.col("_id").alias(doc_id), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                       "near_edited", "near_next")
