"""URL filtering by given rules and by association rules, in DataFrame functions only.

Spark's FP-growth mines combinations of URL tokens that go with a label. Tokens that
always occur together are mined as one, so that a path of many segments which recurs
whole is one item, not 2^n sets. Rules below the support or confidence floor, and rules
that a shorter one covers which is at least as certain, go. The rest is an inverted
index: each rule is entered under its rarest token, and fires if all its tokens are in
the URL. Of the rules that fire the one of the greatest certainty decides, which is the
share of the way from its verdict's base rate to 1 that its confidence goes, so that a
rule as common as the default outvotes none; then the longest. URLs are judged once per
distinct set of tokens, so a host with many pages costs one lookup.

Defined results: a null URL, or one without ://, has an empty host and path and no
tokens; it gets the default verdict, allow. Repeated rows give repeated equal rows;
extra columns are ignored; an empty table, or no labels, gives no mined rules.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

#: Share of all rows that a rule must hold in; none, so that results don't depend on the table's size.
MIN_SUPPORT = 0.0
#: Labelled rows that a rule must hold in, whatever their share.
MIN_ROWS = 2
MIN_CONFIDENCE = 0.9
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK, ALLOW = "block", "allow"


@dataclass(frozen=True)
class Rule:
    verdict: str
    rule: str

    @property
    def host(self) -> str:
        return self.rule.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.rule.partition("/")[2]


# The rules given.
GIVEN = tuple(Rule(*r.split()) for r in ("block com/en/", "allow example.com/en/7", "allow net/de/", "block example.net/de/8", "block org/es/"))
#: Equal labelled rows that one row of the mining's input is spread from.
COPIES_PER_ROW = 10_000


def host_of(url: Column) -> Column:
    """From behind the first :// up to /, ?, # or the end, A-Z in lower case."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the host's end up to ?, # or the end."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.regexp_extract(F.coalesce(rest, F.lit("")), r"(?s)^[^/?#]*([^?#]*)", 1)


def given_rule(host: Column, path: Column, rules: tuple[Rule, ...] = GIVEN) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    name = verdict = None
    for r in sorted(rules, key=lambda r: -len(r.rule)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name = F.when(fits, r.rule) if name is None else name.when(fits, r.rule)
        verdict = F.when(fits, r.verdict) if verdict is None else verdict.when(fits, r.verdict)
    return (F.lit(None).cast("string"),) * 2 if name is None else (name, verdict)


def tokens_of(host: Column, path: Column) -> Column:
    """Distinct tokens: words in the host, its labels of several words, path segments with digits as one sign, and what numbers begin with."""
    labels = F.filter(F.split(host, r"\."), lambda w: w != "")
    words = F.filter(F.flatten(F.transform(labels, lambda w: F.split(w, "-"))), lambda w: w != "")
    segments = F.filter(F.split(path, "/"), lambda w: w != "")
    leads = F.filter(F.transform(segments, lambda w: F.regexp_extract(w, r"^\d", 0)), lambda w: w != "")
    return F.array_distinct(F.concat(
        F.transform(F.filter(labels, lambda w: w.contains("-")), lambda w: F.concat(F.lit("host:"), w)),
        F.transform(words, lambda w: F.concat(F.lit("word:"), w)),
        F.transform(segments, lambda w: F.concat(F.lit("path:"), F.regexp_replace(w, r"\d+", "#"))),
        F.transform(leads, lambda w: F.concat(F.lit("lead:"), w)),
    ))


def as_one(each: DataFrame, scratch: Scratch, only: str | None) -> DataFrame:
    """(token, item): tokens of exactly the same sets are one item, named after the least. each: (row, token, verdict, n).

    Tokens of fewer than MIN_ROWS rows are in no rule; with only, nor are tokens that never occur with that verdict.
    An item has no more tokens than the sets it is in.
    """
    seen = F.sum(F.when(F.lit(only is None) | (F.col("verdict") == F.lit(only)), F.col("n")).otherwise(0))
    marks = [F.bit_xor(F.xxhash64("row", F.lit(i))).alias(f"mark{i}") for i in range(2)]
    tokens = each.groupBy("token").agg(F.count("*").alias("held"), *marks, F.sum("n").alias("rows"), seen.alias("seen"))
    same = tokens.filter(f"rows >= {MIN_ROWS} and seen > 0").groupBy("held", "mark0", "mark1").agg(F.collect_set("token").alias("members"))
    return scratch.table(same.select(F.explode("members").alias("token"), F.array_min("members").alias("item")))


def mine_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, keep_surer: bool = False, only: str | None = None) -> DataFrame:
    """(rule_id, tokens, verdict, confidence, lift, support) from (tokens, verdict).

    A rule goes if a shorter one of its verdict covers it; with keep_surer only if that one is at least as certain.
    Sets of any number of tokens are mined that hold in MIN_ROWS rows, and in the share of all rows that is asked
    for. only: rules of tokens that occur with this verdict; where another verdict is the default, the rest decides nothing.
    """
    from pyspark.ml.fpm import FPGrowth

    scratch = Scratch(labelled.sparkSession, "url-rules")
    sets = labelled.filter("verdict is not null").groupBy("tokens", "verdict").agg(F.count("*").alias("n"))
    sets = scratch.table(sets.withColumn("row", F.xxhash64("tokens", "verdict")))
    each = sets.select("row", "verdict", "n", F.explode("tokens").alias("token"))
    items = as_one(each, scratch, only)
    own = each.join(items, "token").groupBy("row").agg(F.collect_set("item").alias("items"))
    own = sets.select("row", "verdict", "n").join(own, "row", "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    own = own.select(F.array_append("items", F.concat(F.lit("verdict:"), F.col("verdict"))).alias("items"), "n")
    spread = own.select("items", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / COPIES_PER_ROW))).alias("i")).repartition("items", "i")
    copies = F.least(F.lit(COPIES_PER_ROW), F.col("n") - F.col("i") * COPIES_PER_ROW)
    baskets = scratch.table(spread.select("items", F.explode(F.array_repeat(F.lit(0), copies.cast("int")))).select("items"))
    total = baskets.count()
    floor = min(1.0, max(min_support, (MIN_ROWS - 0.5) / max(1, total)))  # half a row less, as a share of rows is rounded up
    model = FPGrowth(itemsCol="items", minSupport=floor, minConfidence=min_confidence).fit(baskets)
    rules = model.associationRules.filter(F.element_at("consequent", 1).startswith("verdict:"))
    rules = rules.filter(~F.exists("antecedent", lambda t: t.startswith("verdict:")))
    rules = rules.select(F.array_sort("antecedent").alias("items"), F.regexp_replace(F.element_at("consequent", 1), "^verdict:", "").alias("verdict"), "confidence", "lift", "support")
    rules = scratch.table(rules)
    shorter = rules.select(F.col("items").alias("part"), F.col("verdict").alias("v"), F.col("confidence").alias("sure"), F.element_at("items", 1).alias("first"))
    each_rule = rules.withColumn("first", F.explode("items"))
    inside = (F.size("part") < F.size("items")) & (F.size(F.array_except("part", "items")) == 0) & (F.lit(not keep_surer) | (F.col("sure") >= F.col("confidence")))
    covered = each_rule.join(shorter, (each_rule["first"] == shorter["first"]) & (F.col("verdict") == F.col("v")) & inside, "left_semi")
    kept = rules.join(covered.select("items", "verdict").distinct(), ["items", "verdict"], "left_anti")
    whole = kept.withColumn("item", F.explode("items")).join(items, "item").groupBy("items", "verdict", "confidence", "lift", "support").agg(F.array_sort(F.collect_set("token")).alias("tokens"))
    return scratch.table(whole.select(F.xxhash64("tokens", "verdict").alias("rule_id"), "tokens", "verdict", "confidence", "lift", "support"))


def match_rules(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """(tokens, verdict, mined): for each distinct token set, the verdict of the most certain rule that fires, then of the longest."""
    scratch = Scratch(sets.sparkSession, "url-index")
    single = sets.select("tokens", F.explode("tokens").alias("token"))
    wide = rules.select("rule_id", F.explode("tokens").alias("token"))
    counts = single.join(wide.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    rarest = wide.join(counts, "token", "left").groupBy("rule_id").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"))
    index = scratch.table(rules.withColumnRenamed("tokens", "need").join(rarest, "rule_id"))
    fired = single.join(index, "token").filter(F.size(F.array_except("need", "tokens")) == 0)
    base = F.col("confidence") / F.col("lift")
    certainty = F.when(base < 1, (F.col("confidence") - base) / (1 - base)).otherwise(0.0)
    best = F.max(F.struct(certainty, F.size("need"), F.col("lift"), F.col("support"), F.col("verdict"), F.array_join("need", " ").alias("mined")))
    return fired.groupBy("tokens").agg(best.alias("b")).select("tokens", F.col("b.verdict").alias("verdict"), F.col("b.mined").alias("mined"))


def judge(pages: DataFrame, labels: DataFrame | None = None, rules: tuple[Rule, ...] = GIVEN, key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, host, path, rule, verdict, mined) for every row.

    labels: (url, verdict) to mine from; by default the pages themselves, each labelled by
    the given rule that fits it, else as allowed. mined: the rule that the method goes by.
    """
    parts = lambda df: df.withColumn("host", host_of(F.col("u"))).withColumn("path", path_of(F.col("u")))
    own = parts(pages.select(F.col(key).alias("k"), F.col(url).cast("string").alias("u"))).drop("u")
    own = own.withColumn("tokens", tokens_of(F.col("host"), F.col("path")))
    rule, verdict = given_rule(F.col("host"), F.col("path"), rules)
    own = own.withColumns({"rule": rule, "given": verdict})
    if labels is None:
        labelled = own.filter("host <> ''").select("tokens", F.coalesce("given", F.lit(ALLOW)).alias("verdict"))
    else:
        seen = parts(labels.select(F.col("url").cast("string").alias("u"), "verdict"))
        labelled = seen.select(tokens_of(F.col("host"), F.col("path")).alias("tokens"), "verdict")
    mined = match_rules(own.select("tokens").distinct(), mine_rules(labelled, keep_surer=True, only=BLOCK))
    mined = Scratch(pages.sparkSession, "url-verdicts").table(mined.withColumnRenamed("verdict", "mined_verdict"))  # so that the join can split hot sets
    found = own.join(mined, "tokens", "left")
    return found.select(F.col("k").alias(key), "host", "path", "rule", F.coalesce("given", "mined_verdict", F.lit(ALLOW)).alias("verdict"), "mined", "mined_verdict")


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
