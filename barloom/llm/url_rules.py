"""URL filter by mined association rules and a rule list (operator 1); DataFrame functions only.

Mining: the tokens of a labelled url are a transaction, and a rule is ``tokens -> bad``.
1. Tokens that too few bad urls hold to reach the support are left out: no rule has them.
2. Tokens that stand in exactly the same labelled urls are one item (their row sets are
   compared by count, sum and exclusive or of 64-bit row hashes). A rule asks for any token
   of each of its items, which is the same as a rule for each choice of tokens.
3. Items that make a rule alone are taken out: every rule that holds one holds a shorter rule.
4. Spark's FP-growth finds the frequent combinations of the others among the bad urls; their
   counts in all labelled urls, by inverted index, give confidence and lift.
5. Rules stay if support, confidence and lift reach their thresholds. Support also has an
   absolute floor of ``MIN_ROWS`` bad urls, so that a small table gives no rules of chance.
   A rule whose items include those of another one decides nothing more and is dropped.
Matching: an inverted index lists each rule under the rarest of its items. The distinct
urls' tokens become items, are equi-joined to it, and a rule fits where all its items are
the url's. A url that fits a mined rule is blocked, any other is allowed.
The rule list (host and path prefixes) comes first; of the rules that fit, the longest
wins.

Defined cases: a null url, or one without ``://``, has empty host and path, fits no listed
rule, and is judged by its tokens (none: allow); empty tables give an empty result or no
mined rules; equal urls get equal verdicts, each row kept; a null page_id is passed on and
has no label; repeated labels of one page count once each. Other columns are ignored,
whatever their names. Very long urls: what repeats as a whole is one item; what grows with
two to the power of its number are items of several urls that neither always stand together
nor make a rule alone.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: (host, path prefix, verdict)
LISTED = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
MIN_SUPPORT, MIN_CONFIDENCE, MIN_LIFT, MIN_ROWS = 0.01, 0.6, 1.5, 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rest_of(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, url.substr(at + 3, F.length(url))), F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(rest_of(url), r"(?s)\A([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(rest_of(url), r"(?s)\A[^/?#]*([^?#]*)", 1)


def tokens_of(url: Column) -> Column:
    """Distinct runs of letters and digits of the url, lower-cased."""
    return F.array_remove(F.array_distinct(F.split(F.translate(F.coalesce(url, F.lit("")), _UPPER, _LOWER), r"[^a-z0-9]+")), "")


def listed_rule(host: Column, path: Column, listed=LISTED) -> Column:
    """The longest listed rule that fits as struct(size, rule, verdict); null if none does."""
    one = [
        F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for h, p, v in listed
    ]
    return F.array_max(F.array_compact(F.array(*one)))


def labelled(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(row, bad, tokens): a label is bad if quality is 0 or toxic is 1; it belongs to the page of the same id."""
    bad = F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))
    marked = labels.select(F.col("doc_id").cast("long").alias("id"), bad.alias("bad"))
    rows = pages.select(F.col("page_id").cast("long").alias("id"), tokens_of(F.col("url").cast("string")).alias("tokens")).join(marked, "id")
    return rows.select(F.monotonically_increasing_id().alias("row"), "bad", "tokens")


def items_of(rows: DataFrame, least: int) -> DataFrame:
    """(token, item, n, n_bad): tokens in at least ``least`` bad rows; those in the same rows share an item, the first of them."""
    h, g = F.xxhash64("row"), F.xxhash64("row", F.lit(1))
    seen = rows.select("row", "bad", F.explode("tokens").alias("token")).groupBy("token").agg(
        F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("n_bad"), F.bit_xor(h).alias("x"), F.bit_xor(g).alias("y"), F.sum(F.shiftright(h, 32)).alias("s")
    )
    seen = seen.where(F.col("n_bad") >= least)
    first = seen.groupBy("n", "n_bad", "x", "y", "s").agg(F.min("token").alias("item"))
    return seen.join(first, ["n", "n_bad", "x", "y", "s"]).select("token", "item", "n", "n_bad")


def as_items(sets: DataFrame, keys: tuple[str, ...], tokens: str, items: DataFrame) -> DataFrame:
    """(keys..., words): the items of each row that has any."""
    return sets.select(*keys, F.explode(tokens).alias("token")).join(items.select("token", "item"), "token").groupBy(*keys).agg(F.collect_set("item").alias("words"))


def mine(pages: DataFrame, labels: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT, min_rows: int = MIN_ROWS) -> tuple[DataFrame, DataFrame]:
    """Rules (rule_id, items, n, n_bad, confidence, lift, support, anchor), and the table (token, item, n, n_bad) of tokens."""
    rows = materialize(labelled(pages, labels), "labelled")
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0)).alias("bad")).first()
    least = max(min_rows, math.ceil(min_support * total["n"] - 1e-9), 1)
    items = materialize(items_of(rows, least), "items")
    share = total["bad"] / total["n"] if total["bad"] else 1.0
    confidence = F.col("n_bad") / F.col("n")
    good = (confidence >= min_confidence) & (confidence / share >= min_lift)
    single = items.where(good)
    short = single.where("token = item").select(F.array("item").alias("items"), "n", "n_bad", F.col("item").alias("anchor"))
    rest = items.join(single.select("token"), "token", "left_anti")
    sets = materialize(as_items(rows, ("row", "bad"), "tokens", rest), "transactions")
    n_sets = sets.where("bad").count()
    found = long_rules(sets, rest, least, n_sets, good) if n_sets >= least else None
    rules = short if found is None else short.unionByName(found)
    rules = rules.select(F.xxhash64("items").alias("rule_id"), "items", "n", "n_bad", confidence.alias("confidence"), (confidence / share).alias("lift"), (F.col("n_bad") / max(total["n"], 1)).alias("support"), "anchor")
    return materialize(rules, "rules"), items


def long_rules(sets: DataFrame, items: DataFrame, least: int, n_sets: int, good: Column) -> DataFrame:
    """Minimal rules of two items and more among transactions (row, bad, words)."""
    model = FPGrowth(itemsCol="words", minSupport=(least - 0.5) / n_sets).fit(sets.where("bad").select("words"))
    found = model.freqItemsets.where(F.size("items") > 1).select(F.array_sort("items").alias("items"), F.col("freq").alias("n_bad"))
    found = materialize(found.select(F.xxhash64("items").alias("rule_id"), "items", "n_bad"), "itemsets")
    often = items.where("token = item").select("item", F.col("n").alias("many"))
    anchors = found.select("rule_id", F.explode("items").alias("item")).join(often, "item").groupBy("rule_id").agg(F.min(F.struct("many", "item"))["item"].alias("anchor"))
    found = found.join(anchors, "rule_id")
    counted = fits(sets.select(F.col("row").alias("key"), "words"), found).groupBy("rule_id").agg(F.count("*").alias("n"))
    rules = materialize(found.join(counted, "rule_id").where(good), "long-rules")
    longer = fits(rules.select(F.col("rule_id").alias("key"), F.col("items").alias("words")), rules).where(F.size("words") > F.size("items"))
    return rules.join(longer.select(F.col("key").alias("rule_id")).distinct(), "rule_id", "left_anti").select("items", "n", "n_bad", "anchor")


def fits(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """(key, words, rule_id, items) where all of a rule's items are among a row's words.

    The inverted index lists each rule once, under its rarest item.
    """
    words = sets.select("key", "words", F.explode("words").alias("anchor"))
    met = words.join(rules.select("anchor", "rule_id", "items"), "anchor")
    return met.where(F.size(F.array_except("items", "words")) == 0).select("key", "words", "rule_id", "items")


def matches(urls: DataFrame, rules: DataFrame, items: DataFrame) -> DataFrame:
    """(url, n_rules): the distinct urls that fit at least one rule."""
    used = items.join(rules.select(F.explode("items").alias("item")).distinct(), "item", "left_semi")
    sets = urls.select("url").where("url is not null").distinct().select(F.col("url").alias("key"), tokens_of(F.col("url")).alias("tokens"))
    return fits(as_items(sets, ("key",), "tokens", used), rules).groupBy(F.col("key").alias("url")).agg(F.count("*").alias("n_rules"))


def judge(pages: DataFrame, labels: DataFrame, listed=LISTED, **thresholds) -> DataFrame:
    """page_id, host, path, rule, verdict, n_rules (mined rules that fit): one row per page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    mined = matches(rows, *mine(pages, labels, **thresholds))
    wide = rows.join(mined, "url", "left").withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    wide = wide.withColumn("hit", listed_rule(F.col("host"), F.col("path"), listed)).withColumn("n_rules", F.coalesce("n_rules", F.lit(0)))
    own = F.when(F.col("n_rules") > 0, F.lit("block")).otherwise(F.lit("allow"))
    return wide.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", own).alias("verdict"), "n_rules")
