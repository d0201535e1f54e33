"""SpotSigs document fingerprints, in DataFrame functions only.

A signature starts at a common word and chains the content words that follow it.
The set of a document's signatures is its fingerprint; likeness is the Jaccard
coefficient of two sets. For joins, documents are put into partitions by set
length, so that only neighbouring partitions can hold a pair over the threshold,
and pairs are met through their rarest signatures and pruned by length.

Positions make the chains without nested loops: in front of the k-th common word,
which stands at position p, there are p - k content words, so its chain is at that
index of the list of content words.

Defined results: the begin of a text counts as a common word, so every text has a
signature and empty or null texts are like each other (likeness 1). Chains at the
end of a text may be shorter. Repeated rows and ties give equal fingerprints;
extra columns are ignored; an empty table gives an empty table. Rows with a null
id have no next document: their edited text just loses its last third, and
near_next is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import Scratch, text_or_empty

CHAIN_WORDS = 3
THRESHOLD = 0.8
#: Ids per range when documents are put in order: one task sorts a range, and one short row a range is linked in one task.
IDS_PER_RANGE = 100_000

# Common words of English, German, French and Spanish.
COMMON_WORDS = tuple(dict.fromkeys("""
the of and to in a is that for it was on are as with be by this from or at not have an they which one you were all her she there would their we him been has when who will no more if out so
der die das und von den mit dem des ein eine ist im für auf zu sich nicht auch als an es er aus bei nach wie sie wird oder war
le la les de et des du un une est que qui dans pour par sur au aux avec ne pas se il elle ce plus ou son
el los las del y en una por con para se lo su al como más pero sus le ya o este sí porque
""".split()))  # fmt: skip


def word_list(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def with_signatures(df: DataFrame, text: str, out: str, chain: int = CHAIN_WORDS, common: tuple[str, ...] = COMMON_WORDS) -> DataFrame:
    """Add out: the sorted set of a text's 32-bit signatures."""
    is_common = lambda w: w.isin(*common)
    words, places, content = (f"__{out}_{x}" for x in ("words", "places", "content"))
    df = df.withColumn(words, word_list(F.col(text)))
    df = df.withColumns({
        places: F.filter(F.transform(words, lambda w, i: F.when(is_common(w), i).otherwise(-1)), lambda i: i >= 0),
        content: F.filter(words, lambda w: ~is_common(w)),
    })
    begin = lambda word, at: F.xxhash64(word, *[F.get(F.col(content), at + j) for j in range(chain)]).bitwiseAND(F.lit(0xFFFFFFFF))
    found = F.transform(places, lambda p, k: begin(F.get(F.col(words), p), p - k))
    return df.withColumn(out, F.array_sort(F.array_distinct(F.array_append(found, begin(F.lit("^"), F.lit(0)))))).drop(words, places, content)


def fingerprint_text(signatures: str) -> Column:
    """The set as text: 8 hex digits a signature, in rising order."""
    return F.array_join(F.transform(signatures, lambda s: F.lpad(F.lower(F.hex(s)), 8, "0")), "")


def likeness(a: str, b: str) -> Column:
    """Jaccard coefficient of two signature sets."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def length_partition(size: Column, threshold: float = THRESHOLD) -> Column:
    """Sets of Jaccard over the threshold differ in length by less than its inverse: by one partition at most."""
    return F.floor(F.log(F.greatest(size, F.lit(1)).cast("double")) / F.log(1 / F.lit(threshold))).cast("int")


def near_pairs(df: DataFrame, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(rep_a, rep_b, likeness) between classes of equal fingerprints; see classes() for who belongs to which.

    Each set is entered under its rarest signatures only: a pair over the threshold
    shares one of the first size - ceil(threshold * size) + 1 of both in any common order.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    sets = classes(df, key, text).groupBy("signatures").agg(F.min("class_id").alias("id")).select("id", "signatures", F.size("signatures").alias("n"))
    sets = Scratch(df.sparkSession, "spotsigs").table(sets.filter("id is not null"))
    single = sets.select("id", "n", F.explode("signatures").alias("s"))
    counts = single.groupBy("s").agg(F.count("*").alias("df"))
    ranked = single.join(counts, "s").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("order"))
    prefix = ranked.select("id", "n", F.explode(F.slice("order", 1, (F.col("n") - F.ceil(F.lit(threshold) * F.col("n")) + 1).cast("int"))).alias("x")).select("id", "n", F.col("x.s").alias("s"))
    part = length_partition(F.col("n"), threshold)
    left = prefix.select(F.col("id").alias("rep_a"), F.col("n").alias("n_a"), "s", F.explode(F.array(part, part + 1)).alias("part"))
    right = prefix.select(F.col("id").alias("rep_b"), F.col("n").alias("n_b"), "s", part.alias("part"))
    # The left one is the shorter (on equal length the one of the smaller id): it looks into its own and the next partition.
    met = left.join(right, ["s", "part"]).filter("(n_a < n_b or n_a = n_b and rep_a < rep_b) and n_a >= n_b * " + repr(float(threshold)))
    met = met.select("rep_a", "rep_b").distinct()
    a, b = (sets.select(F.col("id").alias(f"rep_{x}"), F.col("signatures").alias(f"sig_{x}")) for x in "ab")
    return met.join(a, "rep_a").join(b, "rep_b").select("rep_a", "rep_b", likeness("sig_a", "sig_b").alias("likeness")).filter(F.col("likeness") >= threshold)


def classes(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, class_id, signatures): class_id is the smallest key with the same fingerprint."""
    own = with_signatures(df.select(F.col(key).cast("long").alias(key), text_or_empty(text).alias("__text")), "__text", "signatures").drop("__text")
    ids = own.groupBy(F.col("signatures").alias("same")).agg(F.min(key).alias("class_id"))
    return own.join(ids, own["signatures"] == ids["same"]).select(key, "class_id", "signatures")


def next_ids(ids: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(id, next, n) of distinct ids with n: next is the next smaller id, for the smallest the largest.

    Ids are dealt into sorted ranges and written once, so that each step sees the same ranges.
    Inside a range a window finds the next id; over ranges, one short row each hands its largest
    id to the range above it.
    """
    scratch = scratch or Scratch(ids.sparkSession, "spotsigs")
    ranges = ids.count() // IDS_PER_RANGE + 1
    ranged = scratch.table(ids.repartitionByRange(ranges, "id").withColumn("range", F.spark_partition_id()))
    tops = ranged.groupBy("range").agg(F.max("id").alias("top"))
    below = F.coalesce(F.lag("top").over(Window.orderBy("range")), F.max("top").over(Window.partitionBy()))
    linked = tops.select("range", below.alias("below"))
    inner = F.lead("id").over(Window.partitionBy("range").orderBy(F.col("id").desc()))
    return ranged.withColumn("inner", inner).join(linked, "range").select("id", F.coalesce("inner", "below").alias("next"), "n")


def fingerprint_edits(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness to each other and to the next document's."""
    rows = df.select(F.col(key).cast("long").alias("k"), text_or_empty(text).alias("t"))
    docs = rows.filter("k is not null")  # the same for both joins below, so that texts are shuffled once
    scratch = Scratch(df.sparkSession, "spotsigs")
    # Read by the count, the ranges and the test for repeated ids: written once, so that texts are measured once.
    ids = scratch.table(docs.groupBy(F.col("k").alias("id")).agg(F.max(F.char_length("t")).alias("n"), F.count("*").alias("rows")))
    order = next_ids(ids.select("id", "n"), scratch)
    # Each document hands its set, and as much of its text as may be needed, to the one that it is next to.
    handed = docs.join(order.select(F.col("next").alias("k"), F.col("id").alias("to"), "n"), "k")
    handed = with_signatures(handed, "t", "next_set").select(F.col("to").alias("k"), F.expr("substring(t, 1, n div 3)").alias("head"), "next_set")
    if ids.filter("rows > 1").limit(1).count():  # of several texts with one id, the least in order stands for it
        handed = handed.groupBy("k").agg(F.min(F.struct("head", "next_set")).alias("x")).select("k", "x.*")
    alone = rows.filter("k is null").select("k", "t", F.lit(None).cast("string").alias("head"), F.lit(None).cast("array<bigint>").alias("next_set"))
    both = docs.join(handed, "k", "left").unionByName(alone).withColumn("n_chars", F.char_length("t").cast("long"))
    both = both.withColumn("edited", F.expr("concat(substring(t, 1, int(n_chars - n_chars div 3)), substring(coalesce(head, ''), 1, int(n_chars div 3)))"))
    both = with_signatures(with_signatures(both, "t", "own_set"), "edited", "edited_set")
    return both.select(
        F.col("k").alias(key), "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint_text("own_set").alias("fingerprint"), fingerprint_text("edited_set").alias("edited_fingerprint"),
        likeness("own_set", "edited_set").alias("near_edited"), likeness("own_set", "next_set").alias("near_next"),
    )


def op8_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))
