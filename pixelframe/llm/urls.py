"""URL filtering by host and path rules, and by association rules that FP-growth mines from labelled URLs.

A URL that a rule judges is a labelled transaction: its tokens (host labels by place, path segments, query keys)
and its verdict. FP-growth finds token combinations that are frequent with a verdict; rules under the least support or
confidence go, and so does a rule that a shorter one with the same verdict makes idle. What no given rule
judges is matched by an inverted index: tokens are joined with the mined rules' tokens, and a rule fires when all of
its tokens are there. The fired rule of the highest confidence gives the verdict; without one the URL is allowed.

Defined results: a null URL or one without :// has empty host and path, no rule, and is allowed; repeated rows are
judged alike (and count as often as they stand); of rules of equal confidence the one with more support fires, then the one
with more tokens, then block; URLs may be of any length, but only their frequent tokens are mined; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import cut

#: Fixed rules: verdict, host, path.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Share of the labelled URLs that must hold a rule's tokens and verdict; least share of the verdict among those that
#: hold the tokens.
SUPPORT, CONFIDENCE = 0.01, 0.9
VERDICT = "verdict="
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    whole = F.coalesce(url.cast("string"), F.lit(""))
    rest = F.regexp_extract(whole, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text like net/ , and its verdict; null without one."""
    name = verdict = None
    for v, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, h + p) if name is None else name.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return name, verdict


def tokens(host: Column, path: Column, url: Column) -> Column:
    """Distinct tokens: host labels counted from the right, path segments (digits as #) by place, query keys."""
    labels = F.reverse(F.split(host, r"\."))
    hosts = F.transform(labels, lambda x, i: F.concat(F.lit("h"), i.cast("string"), F.lit("="), x))
    parts = F.filter(F.split(F.regexp_replace(path, "[0-9]+", "#"), "/"), lambda x: x != "")
    paths = F.transform(parts, lambda x, i: F.concat(F.lit("p"), i.cast("string"), F.lit("="), x))
    query = F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"(?s)\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("q="), F.substring_index(x, "=", 1)))
    scheme = F.array(F.concat(F.lit("s="), F.substring_index(F.coalesce(url.cast("string"), F.lit("")), "://", 1)))
    return F.array_distinct(F.concat(scheme, hosts, paths, keys))


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """labelled: tokens, verdict -> rule_id, tokens, verdict, confidence, support.

    Frequent tokens are counted first; a transaction keeps those only, which changes no frequent set. Equal
    transactions stay apart as FP-growth counts them in its tree. The rules are as many as the support allows."""
    from pyspark.ml.fpm import FPGrowth

    labelled = cut(labelled.where("verdict is not null").select("tokens", "verdict"))
    n = labelled.count()
    empty = labelled.sparkSession.createDataFrame([], "rule_id long, tokens array<string>, verdict string, confidence double, support double")
    if not n:
        return empty
    # a token that is in every labelled URL tells nothing about the verdict
    counts = labelled.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n")).where((F.col("n") >= support * n) & (F.col("n") < n))
    kept = counts.agg(F.collect_set("token").alias("kept"))  # at most tokens per URL / support
    items = labelled.crossJoin(F.broadcast(kept)).select(F.array_append(F.array_intersect("tokens", "kept"), F.concat(F.lit(VERDICT), "verdict")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(items)
    mined = model.associationRules.where(F.element_at("consequent", 1).startswith(VERDICT)).where(~F.exists("antecedent", lambda t: t.startswith(VERDICT)))
    mined = cut(mined.select(F.array_sort("antecedent").alias("tokens"), F.substring(F.element_at("consequent", 1), len(VERDICT) + 1, 99).alias("verdict"), "confidence", "support"))
    mined = mined.withColumn("rule_id", F.xxhash64(F.array_join("tokens", "\t"), "verdict"))
    # a rule is idle if one with fewer of its tokens says the same with no less confidence
    short = mined.select(F.col("tokens").alias("t2"), F.col("verdict").alias("v2"), F.col("confidence").alias("c2"), F.explode("tokens").alias("token"))
    long = mined.select("rule_id", "tokens", "verdict", "confidence", F.explode("tokens").alias("token"))
    idle = long.join(short, "token").where("verdict = v2 and c2 >= confidence and size(t2) < size(tokens)").groupBy("rule_id", "t2").agg(F.count("*").alias("shared"), F.first(F.size("t2")).alias("k")).where("shared = k")
    return cut(mined.join(idle.select("rule_id").distinct(), "rule_id", "left_anti").select("rule_id", "tokens", "verdict", "confidence", "support"))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """id, host, path, rule, verdict, mined_tokens (of the fired association rule), confidence."""
    host, path = split_url(F.col(url_col))
    df = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), host.alias("host"), path.alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    df = df.withColumn("rule", name).withColumn("given", verdict)
    df = cut(df.select("id", "host", "path", "rule", "given", F.when(F.col("host") != "", tokens(F.col("host"), F.col("path"), F.col("url"))).otherwise(F.array().cast("array<string>")).alias("tokens")))
    mined = mine(df.where("given is not null").select("tokens", F.col("given").alias("verdict")), support, confidence)
    # inverted index over token sets: equal sets are matched once
    sets = df.where("given is null and size(tokens) > 0").groupBy(F.xxhash64("tokens").alias("set_id"), "tokens").agg(F.count("*").alias("pages"))
    index = mined.select(F.explode("tokens").alias("token"), "rule_id", F.size("tokens").alias("k"))
    hits = sets.select("set_id", "tokens", F.explode("tokens").alias("token")).join(index, "token").groupBy("set_id", "tokens", "rule_id").agg(F.count("*").alias("shared"), F.first("k").alias("k")).where("shared = k")
    fired = hits.join(mined.select("rule_id", F.col("tokens").alias("mined_tokens"), "verdict", "confidence", "support"), "rule_id")
    best = fired.groupBy("set_id", "tokens").agg(F.max(F.struct("confidence", "support", F.size("mined_tokens").alias("k"), "verdict", "mined_tokens")).alias("m"))
    out = df.join(best.select("set_id", F.col("tokens").alias("set"), F.col("m.verdict").alias("found"), F.col("m.mined_tokens").alias("mined_tokens"), F.col("m.confidence").alias("confidence")), (F.xxhash64(df["tokens"]) == F.col("set_id")) & (df["tokens"] == F.col("set")) & F.col("given").isNull(), "left")
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("given", "found", F.lit("allow")).alias("verdict"), "mined_tokens", "confidence")
