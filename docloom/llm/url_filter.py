"""URL filters: host and path rules first, mined association rules for the rest.

The longest fitting rule decides a URL. Such decisions are also labels: FP-growth mines combinations of URL tokens
that go with a label, rules are pruned by support and confidence, and a URL that no rule fits is matched to the
mined rules by an inverted index. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.plans.stored import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MARK = "label="


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or where there is no ``://``."""
    url = F.coalesce(url, F.lit(""))
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(url, parts, 1), UPPER, LOWER), F.regexp_extract(url, parts, 2)


def _suffixes(host: Column) -> Column:
    """All domains that hold the host, itself included."""
    labels = F.split(host, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))


def tokens(url: Column, host: Column, path: Column) -> Column:
    """What of a URL can be shared with others: domains, labels, path segments by place, extension, query keys, fragment."""
    labels = F.split(host, r"\.", -1)
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    parts = (
        F.transform(F.filter(_suffixes(host), lambda s: s != ""), lambda s: F.concat(F.lit("domain:"), s)),
        F.array(F.concat(F.lit("first:"), F.element_at(labels, 1))),
        F.transform(segments, lambda s, i: F.concat(F.lit("path"), i.cast("string"), F.lit(":"), s)),
        F.array(F.concat(F.lit("ext:"), F.regexp_extract(path, r"\.([A-Za-z0-9]{1,5})$", 1))),
        F.transform(F.filter(F.split(query, "&"), lambda s: s != ""), lambda s: F.concat(F.lit("key:"), F.substring_index(s, "=", 1))),
        F.array(F.when(F.instr(url, "#") > 0, "fragment:").otherwise("fragment:none")),
        F.array(F.concat(F.lit("scheme:"), F.substring_index(url, "://", 1))),
    )
    return F.array_distinct(F.concat(*parts))


def fitted_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Add ``rule`` and ``given`` (its verdict) to distinct ``urls`` (url, host, path): the longest fitting rule or null."""
    near = urls.select("url", "path", F.explode(_suffixes(F.col("host"))).alias("domain"))
    best = (
        near.join(rules, near.domain == rules.rule_host)
        .where(F.startswith(F.col("path"), F.col("rule_path")))
        .groupBy("url")
        .agg(F.max(F.struct((F.length("rule_host") + F.length("rule_path")).alias("size"), F.concat("rule_host", "rule_path").alias("rule"), F.col("rule_verdict").alias("given"))).alias("best"))
    )
    return urls.join(best, "url", "left").select("url", "host", "path", F.col("best.rule").alias("rule"), F.col("best.given").alias("given"))


def mine_rules(labelled: DataFrame, min_support: float, min_confidence: float, max_tokens: int) -> DataFrame:
    """Rules (tokens, label, confidence, support) of up to ``max_tokens`` tokens from (tokens, label) rows.

    FP-growth gives the frequent sets. Rules under the confidence go, and so does a rule that says no more than one
    with fewer of its tokens.
    """
    baskets = labelled.select(F.array_append("tokens", F.concat(F.lit(MARK), "label")).alias("items"))
    # Only tokens frequent enough can be in a frequent set; FP-growth itself drops the rest.
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    sets = model.freqItemsets.where(F.size("items") <= max_tokens + 1)
    marked = F.filter("items", lambda t: t.startswith(MARK))
    split = sets.select(F.array_sort(F.filter("items", lambda t: ~t.startswith(MARK))).alias("tokens"), F.get(marked, F.lit(0)).alias("mark"), F.size(marked).alias("marks"), "freq")
    alone = split.where("marks = 0").select("tokens", F.col("freq").alias("total"))
    both = split.where("marks = 1 and size(tokens) > 0")
    rules = stored(
        both.join(alone, "tokens")
        .select("tokens", F.expr(f"substring(mark, {len(MARK) + 1})").alias("label"), (F.col("freq") / F.col("total")).alias("confidence"), F.col("freq").alias("support"))
        .where(F.col("confidence") >= min_confidence),
        "url-rules",
    )
    # A smaller rule holds at least one token of the larger: joined by that token, not by all pairs.
    small = rules.select(F.explode("tokens").alias("token"), F.col("tokens").alias("fewer"), F.col("label").alias("l"), F.col("confidence").alias("c")).where(F.col("token") == F.get("fewer", F.lit(0)))
    large = rules.select(F.explode("tokens").alias("token"), "tokens", "label", "confidence")
    needless = (
        large.join(small, "token")
        .where((F.col("label") == F.col("l")) & (F.col("c") >= F.col("confidence")) & (F.size("fewer") < F.size("tokens")) & (F.size(F.array_except("fewer", "tokens")) == 0))
        .select("tokens", "label")
        .distinct()
    )
    return rules.join(needless, ["tokens", "label"], "left_anti")


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, mined, mined_label, confidence): the best mined rule whose tokens a URL (url, tokens) all has.

    Inverted index: a rule is posted under its rarest token only; a URL meets the rules of its own tokens.
    """
    posted = rules.select("tokens", "label", "confidence", "support", F.explode("tokens").alias("token"))
    often = posted.groupBy("token").agg(F.sum("support").alias("often"))
    rarest = Window.partitionBy("tokens", "label").orderBy("often", "token")
    index = posted.join(often, "token").withColumn("n", F.row_number().over(rarest)).where("n = 1").select("token", F.col("tokens").alias("needs"), "label", "confidence", "support")
    return (
        urls.select("url", "tokens", F.explode("tokens").alias("token"))
        .join(index, "token")
        .where(F.size(F.array_except("needs", "tokens")) == 0)
        .groupBy("url")
        .agg(F.max(F.struct("confidence", "support", F.size("needs").alias("size"), "label", F.array_join("needs", " ").alias("mined"))).alias("best"))
        .select("url", "best.mined", F.col("best.label").alias("mined_label"), "best.confidence")
    )


def judge_urls(
    pages: DataFrame,
    rules: list[tuple[str, str, str]],
    key: str = "page_id",
    url: str = "url",
    min_support: float = 0.01,
    min_confidence: float = 0.8,
    max_tokens: int = 3,
    default: str = "allow",
) -> DataFrame:
    """One row for each row of ``pages``: key, host, path, rule, verdict, mined, confidence.

    ``rules``: (host, path, verdict). Null URLs and such without ``://`` have an empty host and path, fit no rule and
    get ``default`` unless a mined rule says otherwise. Repeated rows are judged alike and all returned. Ties between
    rules of one length go to the last in order of text; between mined rules by confidence, support, size, then text.
    With no labelled URL, or an empty table, nothing is mined. Other columns are not read.
    """
    spark = pages.sparkSession
    given = spark.createDataFrame(rules, "rule_host string, rule_path string, rule_verdict string")
    host, path = host_path(F.col("url"))
    named = pages.select(F.col(key).alias("key"), F.coalesce(F.col(url), F.lit("")).alias("url"))
    distinct = named.select("url").distinct().select("url", host.alias("host"), path.alias("path"))
    judged = stored(fitted_rules(distinct, given).withColumn("tokens", tokens(F.col("url"), F.col("host"), F.col("path"))), "urls")
    labelled = judged.where("given is not null").select("tokens", F.col("given").alias("label"))
    mined = mine_rules(labelled, min_support, min_confidence, max_tokens)
    matched = match_rules(judged.where("given is null").select("url", "tokens"), mined)
    decided = judged.join(matched, "url", "left").select(
        "url", "host", "path", "rule", F.coalesce("given", "mined_label", F.lit(default)).alias("verdict"), "mined", "confidence"
    )
    return named.join(decided, "url").select(F.col("key").alias(key), "host", "path", "rule", "verdict", "mined", "confidence")
