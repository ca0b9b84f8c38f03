"""Personal data by bootstrapped contextual extraction, in DataFrame
expressions only.

*Seeds.*  E-mail addresses, IP addresses, payment cards and phone numbers are
found by pattern and checked (parts, Luhn digits, lengths).
*Candidates.*  Other words that look like identifiers: with a digit, ``@`` or
``_``, or a dot or bracket inside.
*Graph.*  The word before a seed or candidate, and the two words before it, are
lexical patterns, told apart by their hashes; whatever these words are, they
are those before the white-space delimited word in which the match begins.
Punctuation between the beginning of that word and the match is passed over; a
match right after a letter, digit or match has no pattern, as the pattern
stands before something else.  Seeds of a kind that share a word share its
place.  A pattern is linked with the instances (strings) it stands before.  A pattern's confidence for a kind is the sum of its instances' scores
for that kind over all places in the corpus where the pattern stands before
any word, so frequent words get next to none; an instance's score is the
noisy-or of the confidences of its patterns.  Seeds keep score 1.  A pattern
needs ``MIN_SUPPORT`` different scored instances.  Scores are iterated until
those of accepted strings no longer grow (they only grow, so this ends); a
candidate whose score reaches ``ACCEPT`` is an identifier of that kind, counts
as an instance in the next round, and all its places become spans.

Spans are code point ranges, end exclusive.  They come from one explosion of
matches and the text between them, and running sums, so cost is linear in the
text.  Regular expressions use possessive loops and look-behinds where Java
would backtrack or recurse over very long runs; they match what the plain
ones in the comments match.

Cases: a null text is an empty one; a document without matches gets empty
results; rows equal in id and text get equal results; a null id is an id like
any other; of seeds of different kinds that overlap both stay, candidates that
overlap a seed are none; an empty table gives an empty result; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir

KINDS = ["email", "ip", "card", "phone"]
#: The patterns.  Plain forms:
#: [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
#: [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#: [0-9]([\x20-]?[0-9])+
#: \+[0-9][\x20().0-9-]+[0-9]
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without a place like this has no match; one cheap scan spares most texts the patterns above.
HINT = {"email": "@", "ip": "[0-9][.][0-9]", "card": "[0-9]", "phone": "[+][0-9]",
        "candidate": r"[0-9@_]|[A-Za-z0-9][.(\[{][A-Za-z0-9]"}
IP = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})){3}$"
SPACE = r"[\x20\x09-\x0D]+"
#: A whole word with a digit, @ or _, or with a dot or bracket between letters or digits.
CANDIDATE = (r"(?<![^\x20\x09-\x0D])(?=[^\x20\x09-\x0D0-9@_]*+[0-9@_]|"
             r"[^\x20\x09-\x0D]*?[A-Za-z0-9][.(\[{][A-Za-z0-9])[^\x20\x09-\x0D]++")
MIN_LENGTH = 1  # characters of a candidate, without the punctuation around it
MIN_SUPPORT, ACCEPT = 5, 0.8
STEP = 1e-6  # scores are compared between rounds in steps of this
MAX_BROADCAST_PATTERNS = 500_000


def _word_hashes(text: Column) -> Column:
    return F.transform(F.filter(F.split(F.lower(text), SPACE), lambda w: w != ""), lambda w: F.xxhash64(w))


def _candidates(text: Column) -> Column:
    """``match, w1, w2`` of every word that ``CANDIDATE`` matches, in order,
    with the hashes of the word before it and of the two words before it.
    Zipped, so that each list is worked out once for a text."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")

    def before(h: Column) -> Column:  # h: the list of all words' hashes
        n = F.greatest(F.size(h) - 1, F.lit(0))
        none = F.lit(None).cast("long")
        twos = F.zip_with(F.slice(h, F.lit(1), n), F.slice(h, F.lit(2), n), lambda a, b: F.xxhash64(a, b))
        return F.arrays_zip(words.alias("match"), F.concat(F.array(none), h).alias("w1"),
                            F.concat(F.array(none, none), twos).alias("w2"))

    # a list of one, so that the hashes are a variable and not worked out for each use
    zipped = F.element_at(F.transform(F.array(_word_hashes(text)), before), 1)
    return F.filter(zipped, lambda z: z["match"].rlike(HINT["candidate"]))


def _matches(docs: DataFrame) -> DataFrame:
    """One row per match: ``kind, k, match, gap, left, w1, w2`` - its number,
    the number of characters since the match before it, the last of them, and
    for candidates the words before.  Texts are searched only where their hint
    is found, and split only where something was matched."""
    text = F.col("_text")
    patterns = PATTERNS | {"candidate": CANDIDATE}
    none = F.lit(None).cast("long")
    alone = lambda m: F.transform(m, lambda x: F.struct(x.alias("match"), none.alias("w1"), none.alias("w2")))
    found = {k: alone(F.regexp_extract_all(text, F.lit(p), F.lit(0))) for k, p in PATTERNS.items()}
    found["candidate"] = _candidates(text)
    docs = docs.withColumns({f"m_{k}": F.when(text.rlike(HINT[k]), m) for k, m in found.items()})
    docs = docs.withColumns({f"p_{k}": F.when(F.size(f"m_{k}") > 0, F.split(text, p, -1)) for k, p in patterns.items()})

    def structs(kind: str) -> Column:
        pairs = F.arrays_zip(F.col(f"m_{kind}").alias("m"), F.col(f"p_{kind}").alias("before"))
        return F.coalesce(F.transform(F.filter(pairs, lambda z: z["m"].isNotNull()), lambda z, k: F.struct(
            F.lit(kind).alias("kind"), k.alias("k"), z["m"]["match"].alias("match"),
            F.char_length(z["before"]).alias("gap"), F.right(z["before"], F.lit(1)).alias("left"),
            z["m"]["w1"].alias("w1"), z["m"]["w2"].alias("w2"))), F.array())

    return (docs.select("_row", "_id", "_key", F.explode(F.concat(*[structs(k) for k in patterns])).alias("m"))
            .select("_row", "_id", "_key", "m.*"))


def _luhn(match: Column) -> Column:
    digits = F.reverse(F.regexp_replace(match, "[ -]", ""))
    value = lambda i: F.substring(digits, i, F.lit(1)).cast("int")
    doubled = lambda d: F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
    total = F.aggregate(F.sequence(F.lit(1), F.char_length(digits)), F.lit(0),
                        lambda acc, i: acc + F.when(i % 2 == 1, value(i)).otherwise(doubled(value(i))))
    # lengths first: only then the sum is worked out
    return F.when(F.char_length(digits).between(12, 19), total % 10 == 0).otherwise(False)


def _valid(kind: Column, match: Column) -> Column:
    digits = F.char_length(F.regexp_replace(match, "[^0-9]", ""))
    return (F.when(kind == "ip", match.rlike(IP)).when(kind == "card", _luhn(match))
            .when(kind == "phone", digits.between(9, 15)).otherwise(True))


def _places(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """Every seed and candidate with its place: ``_id, _key, kind, match,
    start, end, w1, w2, share`` (kind null: candidate; w1, w2: the hashes of
    the word before and of the two words before; share: its part of the place
    after them, added up over rows equal in id and text, as their places are).

    Every seed begins in a word that ``CANDIDATE`` matches, so it takes its
    context from there."""
    rows = _matches(docs).repartition("_row")  # for all windows
    size = F.char_length("match")
    upto = F.sum(F.col("gap") + size).over(Window.partitionBy("_row", "kind").orderBy("k"))
    rows = rows.withColumn("end", upto).withColumn("start", F.col("end") - size)
    cand = F.col("kind") == "candidate"
    rows = rows.where(cand | _valid(F.col("kind"), F.col("match")))
    begun = Window.partitionBy("_row").orderBy("start", (~cand).cast("int")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_word", F.last(F.when(cand, F.struct(F.col("start").alias("at"), "w1", "w2")), True).over(begun))
    # the word goes on into the match
    glued = ~cand & (F.col("start") > 0) & ((F.col("left") == "") | F.col("left").rlike(r"[\p{L}\p{N}]"))
    rows = rows.withColumns({w: F.when(~glued, F.col(f"_word.{w}")) for w in ("w1", "w2")} | {"_at": F.col("_word.at"), "_glued": glued})
    together = F.sum((~F.col("_glued")).cast("int")).over(Window.partitionBy("_row", "kind", "_at"))
    rows = rows.withColumn("share", F.when(F.col("_glued"), 0.0).otherwise(1 / together)).drop("_word", "_at", "_glued", "left")
    # a candidate without the punctuation around it
    lead = F.char_length("match") - F.char_length(F.regexp_replace("match", r"^[^\p{L}\p{N}+]+", ""))
    core = F.regexp_replace(F.regexp_replace("match", r"^[^\p{L}\p{N}+]+", ""), r"[^\p{L}\p{N}]++$", "")
    rows = (rows.withColumn("start", F.when(cand, F.col("start") + lead).otherwise(F.col("start")))
            .withColumn("match", F.when(cand, core).otherwise(F.col("match")))
            .withColumn("end", F.col("start") + F.char_length("match"))
            .where(~cand | (F.col("end") - F.col("start") >= min_length)))
    # candidates that overlap a seed go: seeds that began before, and seeds that begin inside
    order = Window.partitionBy("_row").orderBy("start", cand.cast("int"))
    begun = F.max(F.when(~cand, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    # the other way round, so that this too is a running frame: one that reaches to the end is worked out anew for each row
    back = Window.partitionBy("_row").orderBy(F.desc("start"), F.desc(cand.cast("int")))
    coming = F.min(F.when(~cand, F.col("start"))).over(back.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_begun", begun).withColumn("_coming", coming)
    clear = (F.coalesce(F.col("_begun") <= F.col("start"), F.lit(True))
             & F.coalesce(F.col("_coming") >= F.col("end"), F.lit(True)))
    return (rows.where(~cand | clear).withColumn("kind", F.when(~cand, F.col("kind")))
            .groupBy("_id", "_key", "kind", "match", "start", "end", "w1", "w2").agg(F.sum("share").alias("share")))


def _pattern_places(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """``pattern, places``: how often each pattern (a word or two, hashed)
    stands before a word."""
    hashed = docs.select(_word_hashes(F.col("_text")).alias("h")).where("size(h) > 1")
    ones = F.slice("h", F.lit(1), F.size("h") - 1)
    twos = F.zip_with(F.slice("h", F.lit(1), F.size("h") - 2), F.slice("h", F.lit(2), F.size("h") - 2),
                      lambda a, b: F.xxhash64(a, b))
    each = hashed.select(F.explode(F.when(F.size("h") > 2, F.concat(ones, twos)).otherwise(ones)).alias("pattern"))
    known = patterns.select("pattern")
    side = F.broadcast(known) if patterns.count() <= MAX_BROADCAST_PATTERNS else known
    return each.join(side, "pattern").groupBy("pattern").agg(F.count("*").alias("places"))


def discover(docs: DataFrame, places: DataFrame, min_support: int = MIN_SUPPORT, accept: float = ACCEPT) -> DataFrame:
    """``match, kind``: accepted candidate strings with their kind (``docs``:
    ``_text``; ``places``: from ``_places``)."""
    # one row for each pattern, instance and kind, with the number of places
    graph = (places.select("kind", "match", "share", F.explode(F.array("w1", "w2")).alias("pattern")).where("pattern IS NOT NULL")
             .groupBy("pattern", "match", "kind").agg(F.sum("share").alias("n")))
    support = graph.groupBy("pattern").agg(F.count("*").alias("m")).where(F.col("m") > min_support).select("pattern")
    # only patterns that also stand before a candidate can discover anything
    support = support.join(graph.where("kind IS NULL").select("pattern").distinct(), "pattern", "left_semi").checkpoint()
    graph = graph.join(support, "pattern").join(_pattern_places(docs, support), "pattern").checkpoint()
    seeds = graph.where("kind IS NOT NULL").withColumn("score", F.lit(1.0)).drop("places")
    candidates = graph.where("kind IS NULL").select("pattern", "match", "n")
    everywhere = graph.select("pattern", "places").distinct()
    scored, total = None, 0
    while True:
        known = seeds if scored is None else seeds.unionByName(
            candidates.join(scored.where(F.col("score") >= accept), "match").select(
                "pattern", "match", "kind", "n", "score"))
        confidence = (known.groupBy("pattern", "kind").agg(F.sum(F.col("n") * F.col("score")).alias("hits"),
                                                           F.count_distinct("match").alias("instances"))
                      .where(F.col("instances") >= min_support).join(everywhere, "pattern")
                      .select("pattern", "kind", F.least(F.lit(1.0), F.col("hits") / F.col("places")).alias("conf")))
        miss = F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("conf"))))
        scored = (candidates.join(confidence, "pattern").groupBy("match", "kind")
                  .agg((1 - F.exp(miss)).alias("score"))).checkpoint()
        # whole numbers, as their sum does not depend on the order
        steps = F.sum(F.floor(F.col("score") / STEP))
        before, total = total, scored.where(F.col("score") >= accept).agg(steps).first()[0] or 0
        if total <= before:  # nothing new to learn from
            break
    best = F.max_by("kind", F.struct("score", "kind"))
    return scored.where(F.col("score") >= accept).groupBy("match").agg(best.alias("kind"))


def find_identifiers(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_support: int = MIN_SUPPORT,
                     accept: float = ACCEPT, min_length: int = MIN_LENGTH) -> DataFrame:
    """``<doc_id>, _key, spans`` of every different row (id and text): array
    of ``start, rank, end, kind, seed`` ordered by start, then kind as listed.
    ``_key`` is ``xxhash64`` of the text (null: empty).  Candidates have
    ``min_length`` characters at least."""
    checkpoint_dir(docs.sparkSession)
    docs = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(doc_id).alias("_id"),
                       F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    docs = docs.withColumn("_key", F.xxhash64("_text"))
    places = _places(docs, min_length).checkpoint()
    new = discover(docs, places.select("kind", "match", "w1", "w2", "share"), min_support, accept)
    seeds = places.where("kind IS NOT NULL").select("_id", "_key", "kind", "start", "end", F.lit(True).alias("seed"))
    more = places.where("kind IS NULL").drop("kind").join(new, "match").select(
        "_id", "_key", "kind", "start", "end", F.lit(False).alias("seed"))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    spans = (seeds.unionByName(more).groupBy("_id", "_key").agg(F.sort_array(F.collect_list(F.struct(
        F.col("start"), rank.alias("rank"), F.col("end"), "kind", "seed"))).alias("spans"))
        .withColumnsRenamed({"_id": "_i", "_key": "_k"}))
    each = docs.select("_id", "_key")
    found = each.join(spans, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_key") == F.col("_k")), "left")
    empty = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string,seed:boolean>>")
    return found.select(F.col("_id").alias(doc_id), "_key", F.coalesce("spans", empty).alias("spans"))


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; spans that
    overlap become one, named after the first.  Null texts stay null."""
    found = (find_identifiers(docs, doc_id, text, **how).where(F.size("spans") > 0).dropDuplicates([doc_id, "_key"])
             .select(F.col(doc_id).alias("_i"), F.col("_key").alias("_k"), F.explode("spans").alias("s"))
             .select("_i", "_k", "s.*"))
    # what is written anew, and from where to where the text before it stays
    used = Window.partitionBy("_i", "_k").orderBy("start", "rank", "end").rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("upto", F.coalesce(F.max("end").over(used), F.lit(0)))
    piece = F.when(F.col("start") >= F.col("upto"), F.struct("start", "upto", "kind"))
    found = found.groupBy("_i", "_k").agg(F.sort_array(F.collect_list(piece)).alias("_pieces"), F.max("end").alias("_tail"))
    own = F.xxhash64(F.coalesce(F.col(f"d.`{text}`").cast("string"), F.lit("")))
    joined = docs.alias("d").join(found.alias("f"), F.col(f"d.`{doc_id}`").eqNullSafe(F.col("f._i")) & (own == F.col("f._k")), "left")
    whole = F.col(f"d.`{text}`")

    def part(points: Column, start: Column, n: Column) -> Column:
        return F.decode(F.substring(points, (4 * start + 1).cast("int"), (4 * n).cast("int")), "UTF-32")

    def written(points: Column) -> Column:
        pieces = F.transform("f._pieces", lambda p: F.concat(
            part(points, p["upto"], p["start"] - p["upto"]), F.lit("["), F.upper(p["kind"]), F.lit("]")))
        return F.concat(F.array_join(pieces, ""), part(points, F.col("f._tail"), F.octet_length(points)))

    # four bytes a character, so that each part is found without counting from the beginning; in a list of one, so
    # that they are a variable and not worked out for each part
    clean = F.when(F.col("f._tail").isNull(), whole).otherwise(
        F.element_at(F.transform(F.array(F.encode(whole, "UTF-32")), written), 1))
    return joined.select(*(clean.alias(c) if c == text else F.col(f"d.`{c}`") for c in docs.columns))
