"""URL filtering by mined association rules (operator 9).

FP-growth mines combinations of URL tokens that go with the label "block";
rules below the least support or confidence, and rules that a shorter kept
rule implies, are pruned.  Tokens that occur on the same labelled URLs are one
item, so nested host suffixes and repeated long URLs don't multiply.  URLs of
many items, whose combinations FP-growth could not list, are mined by
PrefixSpan, which ends at a rule's length.  What either finds is counted over
all labelled URLs.  Kept rules form an inverted index from token to rule; a
URL fires a rule when all the rule's tokens are among its own.  Built-in
functions and pyspark.ml only.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth, PrefixSpan
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickweave.llm.common import cut

#: Least share and least number of labelled URLs behind a rule, least share of them to block, most tokens of a rule.
MIN_SUPPORT, MIN_COUNT, MIN_CONFIDENCE, MAX_TOKENS = 0.005, 5, 0.8, 3
#: Most items of a URL that FP-growth takes, with at most 2^MAX_ITEMS combinations; PrefixSpan takes those with more.
MAX_ITEMS = 12
# The rules of the query, (verdict, host, path).
FIXED_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """From behind the first :// to the next / ? # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """From behind the host to the next ? # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fixed_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens(url: Column) -> Column:
    """Sorted distinct tokens: host suffixes, path segments, extension, query keys; digit runs become 0."""
    text = F.coalesce(url, F.lit(""))
    host, path = host_of(text), path_of(text)
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("host="), F.array_join(F.slice(labels, -i, i), ".")))
    zeros = lambda x: F.regexp_replace(F.lower(x), "[0-9]+", "0")
    segments = F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), lambda s: F.concat(F.lit("path="), zeros(s)))
    extension = F.regexp_extract(path, r"\.([A-Za-z0-9]{1,8})$", 1)
    keys = F.transform(F.regexp_extract_all(text, F.lit(r"[?&]([^=&#]+)"), F.lit(1)), lambda k: F.concat(F.lit("key="), zeros(k)))
    more = F.array(F.concat(F.lit("scheme="), F.lower(F.regexp_extract(text, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))), F.when(extension != "", F.concat(F.lit("type="), F.lower(extension))), F.when(text.contains("#"), F.lit("fragment")))
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(F.when(host != "", suffixes).otherwise(F.array().cast("array<string>")), segments, keys, more))))


def items_of(labelled: DataFrame, tokens_col: str, block_col: str, least: int) -> DataFrame:
    """items, block of each labelled URL: one token of each group that occurs on the same URLs, if on ``least`` or more.

    Items are ordered by how many URLs hold them, the rarest first.
    """
    rows = labelled.select(F.monotonically_increasing_id().alias("_row"), F.col(tokens_col).alias("tokens"), F.col(block_col).alias("block"))
    rows = cut(rows)
    each = rows.select("_row", F.explode("tokens").alias("token"))
    # two folded hashes and a count stand for the set of URLs
    seen = each.groupBy("token").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("_row")).alias("h1"), F.bit_xor(F.xxhash64("_row", F.lit(1))).alias("h2")).filter(F.col("n") >= least)
    shortest = F.min(F.struct(F.length("token"), F.col("token")))["token"]
    chosen = seen.groupBy("n", "h1", "h2").agg(shortest.alias("token")).select("token", "n")
    order = F.transform(F.sort_array(F.collect_list(F.struct("n", "token"))), lambda x: x["token"])
    kept = each.join(chosen, "token").groupBy("_row").agg(order.alias("items"))
    return rows.join(kept, "_row").select("items", "block")


def candidates(rows: DataFrame, share: float, max_tokens: int) -> DataFrame:
    """antecedent (sorted): token sets that may be on this share of the labelled URLs and to be blocked.

    A set that is frequent in all rows is so among those of few items or among
    those of many, so each part is mined with the same share of its own size.
    """
    spark = rows.sparkSession
    found = spark.createDataFrame([], "antecedent array<string>")
    for many in (False, True):
        part = rows.filter(F.size("items") > MAX_ITEMS if many else F.size("items") <= MAX_ITEMS)
        n, blocked = part.count(), part.filter("block").select("items")
        n_blocked = blocked.count()
        if not n_blocked:
            continue
        support = min(1.0, max(0.5, math.ceil(share * n - 1e-9) - 0.5) / n_blocked)
        if many:
            ordered = blocked.select(F.transform(F.array_sort("items"), lambda x: F.array(x)).alias("sequence"))
            sets = PrefixSpan(minSupport=support, maxPatternLength=max_tokens, sequenceCol="sequence").findFrequentSequentialPatterns(ordered).select(F.flatten("sequence").alias("items"))
        else:
            sets = FPGrowth(itemsCol="items", minSupport=support).fit(blocked).freqItemsets.select("items")
        found = found.unionByName(sets.filter(F.size("items") <= max_tokens).select(F.array_sort("items").alias("antecedent")))
    return found.distinct()


def mine_rules(labelled: DataFrame, tokens_col: str, block_col: str, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, max_tokens: int = MAX_TOKENS, min_count: int = MIN_COUNT) -> DataFrame:
    """rule_id, antecedent, confidence, support of the kept rules for blocking; support is the share of labelled URLs.

    A rule has up to max_tokens tokens (20 at most), holds on at least
    min_count labelled URLs to block and on min_support of all.  Of tokens that
    occur on the same labelled URLs the shortest stands for all.  URLs may have
    any number of tokens.  Without labelled URLs: no rules.
    """
    assert 1 <= max_tokens <= 20
    total = labelled.count()
    least = max(min_count, math.ceil(min_support * total - 1e-9))
    spark = labelled.sparkSession
    rows = cut(items_of(labelled, tokens_col, block_col, least)) if total else None
    if not total or rows.isEmpty():
        return spark.createDataFrame([], "antecedent array<string>, confidence double, support double, rule_id long")
    sets = cut(candidates(rows, least / total, max_tokens).withColumn("rule_id", F.xxhash64("antecedent")))
    # equal item lists count together; a set meets those that hold its rarest token
    lists = rows.groupBy("items").agg(F.count("*").alias("n"), F.count_if("block").alias("n_block"))
    rank = rows.select(F.explode("items").alias("token")).groupBy("token").agg(F.count("*").alias("held"))
    rarest = sets.select("rule_id", F.explode("antecedent").alias("token")).join(rank, "token").groupBy("rule_id").agg(F.min(F.struct("held", "token"))["token"].alias("token"))
    met = lists.select("items", "n", "n_block", F.explode("items").alias("token")).join(sets.join(rarest, "rule_id"), "token").filter(F.size(F.array_except("antecedent", "items")) == 0)
    counted = met.groupBy("rule_id", "antecedent").agg(F.sum("n").alias("n"), F.sum("n_block").alias("n_block"))
    kept = counted.filter((F.col("n_block") >= least) & (F.col("n_block") / F.col("n") >= min_confidence))
    rules = cut(kept.select("antecedent", (F.col("n_block") / F.col("n")).alias("confidence"), (F.col("n_block") / total).alias("support"), "rule_id"))
    # a rule is implied by a kept one of fewer tokens: look its proper subsets up
    subsets = rules.select("rule_id", F.explode(_proper_subsets(F.col("antecedent"))).alias("subset")).select("rule_id", F.xxhash64("subset").alias("shorter"))
    implied = subsets.join(rules.select(F.col("rule_id").alias("shorter")), "shorter").select("rule_id").distinct()
    return rules.join(implied, "rule_id", "left_anti")


def _proper_subsets(items: Column) -> Column:
    """Non-empty proper subsets, in order; small because antecedents are."""
    masks = F.when(F.size(items) > 1, F.sequence(F.lit(1), F.pow(F.lit(2), F.size(items)).cast("int") - 2)).otherwise(F.array().cast("array<int>"))
    return F.transform(masks, lambda m: F.filter(items, lambda x, i: F.pmod(F.floor(m / F.pow(F.lit(2), i)), F.lit(2)) == 1))


def fired(token_sets: DataFrame, rules: DataFrame, tokens_col: str = "tokens") -> DataFrame:
    """Distinct token sets that fire a rule, by the inverted index."""
    index = rules.select("rule_id", F.size("antecedent").alias("need"), F.explode("antecedent").alias("token"))
    posted = token_sets.select(tokens_col, F.explode(tokens_col).alias("token")).join(index, "token")
    return posted.groupBy(tokens_col, "rule_id", "need").count().filter("count = need").select(tokens_col).distinct()


def judge(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", label_id_col: str = "doc_id", quality_col: str = "quality", toxic_col: str = "toxic", fixed: tuple[tuple[str, str, str], ...] = FIXED_RULES) -> DataFrame:
    """page_id, host, path, rule, verdict of every page.

    A page's label is the verdict of the fixed rule that fits it, else the row
    of ``labels`` with its id: to be blocked if its quality is 0 or it is
    toxic; a label whose both values are null counts for nothing, and of
    several rows for an id the strictest holds.  The fixed rules decide first;
    the rest is blocked if a mined rule fires.  Null urls or such without ://
    have empty host and path and are judged by their tokens.  Very long urls
    are judged whole.  Repeated rows get equal verdicts; without labels or
    rules all the rest is allowed; an empty table gives no rows.
    """
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), tokens(url).alias("tokens"))
    flags = labels.select(F.col(label_id_col).cast("long").alias("page_id"), ((F.col(quality_col) == 0) | (F.coalesce(F.col(toxic_col), F.lit(0)) == 1)).alias("block"), F.col(toxic_col).alias("t"))
    flags = flags.filter("block is not null or t is not null").groupBy("page_id").agg(F.bool_or(F.coalesce("block", F.lit(False))).alias("block"))
    plain = rows.withColumn("fixed", fixed_rule(F.col("host"), F.col("path"), fixed))
    known = plain.select("page_id", "tokens", F.col("fixed.verdict").alias("verdict")).dropDuplicates(["page_id", "tokens"]).join(flags, "page_id", "left")
    labelled = known.select("tokens", F.when(F.col("verdict").isNotNull(), F.col("verdict") == "block").otherwise(F.col("block")).alias("block"))
    labelled = cut(labelled.filter("block is not null"))
    if labelled.isEmpty():
        blocked = None
    else:
        rules = mine_rules(labelled, "tokens", "block")
        # URLs with equal tokens are matched once
        blocked = fired(rows.select("tokens").distinct(), rules).withColumn("hit", F.lit(True))
    out = plain.join(blocked, "tokens", "left") if blocked is not None else plain.withColumn("hit", F.lit(None).cast("boolean"))
    verdict = F.coalesce(F.col("fixed.verdict"), F.when(F.coalesce("hit", F.lit(False)), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("fixed.rule").alias("rule"), verdict.alias("verdict"))
