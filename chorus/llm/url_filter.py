"""URL filters: rules on host and path, then a logistic regression on hashed
character n-grams of host and path.

Everything is DataFrame expressions.  The model is trained from a small
labelled table (at most ``MAX_TRAINING`` rows by contract: it becomes one
row of arrays); full-batch gradient descent is one ``aggregate`` expression
over its sparse feature arrays, in both orders (rows to features and
features to rows).  The weights, one for each hash bucket, come to the
driver (``BUCKETS`` numbers) and are a literal of the scoring expression, so
scoring is a projection of the scan, with no join and no shuffle.

Cases: a null URL or one without ``://`` has empty host and path and meets
no rule; the model then judges the empty string by its intercept; repeated
rows are judged each; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chorus.llm.common import table

BUCKETS = 4096
GRAM = 4
EPOCHS = 150
RATE = 2.0
L2 = 0.002
MAX_TRAINING = 10_000
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

# The small labelled table: 1 for URLs to block.
LABELLED_URLS = (
    ("http://cheap-pills.example.com/en/1", 1), ("https://www.casino-win.example.org/de/22/", 1),
    ("http://best-casino-bonus.example.com/play?ref=x", 1), ("https://pills-online.example.org/buy/cheap", 1),
    ("http://free-viagra.example.com/order.html", 1), ("https://win-money-now.example.com/en/slots", 1),
    ("http://adult-cams.example.org/live", 1), ("https://xxx-videos.example.com/hot/7", 1),
    ("http://poker-casino.example.org/fr/9.html", 1), ("https://loan-cash-fast.example.com/apply", 1),
    ("http://replica-watches.example.com/shop/cheap?page=2", 1), ("https://blog.cheap-pills.example.org/es/4", 1),
    ("https://m.casino-win.example.com/fr/81#top", 1), ("http://betting-win.example.com/odds", 1),
    ("https://crypto-doubler.example.com/win", 1), ("http://download-crack.example.org/keygen", 1),
    ("https://blog.theran.example.com/en/853/", 0), ("http://www.thother.example.org/es/41", 0),
    ("https://news.example.com/en/2023/05/article.html", 0), ("http://blog.tiontion.example.com/fr/925?page=2&ref=x", 0),
    ("https://m.thther.example.org/en/125/", 0), ("http://www.library.example.org/es/catalog/77", 0),
    ("https://wiki.example.com/en/History", 0), ("http://recipes.example.com/fr/soup.html", 0),
    ("https://docs.example.org/en/guide/start", 0), ("http://www.university.example.org/de/research/19", 0),
    ("https://blog.example.com/en/travel/55?utm_source=feed", 0), ("http://museum.example.org/es/art/3", 0),
    ("https://weather.example.com/en/today#top", 0), ("http://forum.ththing.example.com/en/680", 0),
    ("https://www.ththwh.example.org/es/511#top", 0), ("http://garden.example.com/en/roses/12", 0),
)


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, with
    A-Z lower-cased; empty without one."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), upper, lower)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_column(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits: its host or a subdomain, and a path that
    starts with its path; null without one."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):       # longer rules are tested first
        name, slash, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def gram_buckets(text: Column) -> Column:
    """Distinct hash buckets of the character n-grams, marked at both ends."""
    marked = F.concat(F.lit("^"), text, F.lit("$"))
    spots = F.sequence(F.lit(1), F.greatest(F.length(marked) - (GRAM - 1), F.lit(1)))
    return F.array_distinct(F.transform(spots, lambda i: F.pmod(F.xxhash64(F.substring(marked, i, F.lit(GRAM))), F.lit(BUCKETS)).cast("int")))


def features(host: Column, path: Column) -> Column:
    return gram_buckets(F.concat(host, path))


def labelled_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LABELLED_URLS), "url string, label int")


def train(labelled: DataFrame, epochs: int = EPOCHS, rate: float = RATE, l2: float = L2,
          max_training: int = MAX_TRAINING) -> tuple[list[float], float]:
    """Weights by bucket and the intercept, from ``(url, label)`` rows, of
    which the first ``max_training`` by a hash of the URL are read; rows
    without a label are left out."""
    rows = (labelled.filter("label is not null").orderBy(F.xxhash64("url"), "url", "label").limit(max_training)
            .select(features(host_of(F.col("url")), path_of(F.col("url"))).alias("x"), F.col("label").cast("double").alias("y")))
    one = rows.agg(F.array_sort(F.collect_list(F.struct("y", "x"))).alias("rows"))
    one = one.withColumn("used", F.array_sort(F.array_distinct(F.flatten(F.transform("rows", lambda r: r["x"])))))
    # features to rows: for each bucket in use the rows that hold it; rows to
    # features: positions of a row's buckets in ``used``
    indexed = F.transform("rows", lambda r, i: F.struct(i.alias("i"), r["x"].alias("x")))
    one = one.withColumn("holders", F.transform("used", lambda b: F.transform(
        F.filter(indexed, lambda r: F.array_contains(r["x"], b)), lambda r: r["i"])))
    one = one.withColumn("rows", F.transform("rows", lambda r: F.struct(
        r["y"].alias("y"), F.transform(r["x"], lambda b: F.array_position(F.col("used"), b).cast("int")).alias("x"))))
    n = F.size("rows").cast("double")
    model = F.struct(F.transform("used", lambda b: F.lit(0.0)).alias("w"), F.lit(0.0).alias("b"))

    def epoch(m, _):
        errors = F.transform("rows", lambda r: (F.lit(1.0) / (F.lit(1.0) + F.exp(-F.aggregate(
            r["x"], m["b"], lambda z, k: z + F.element_at(m["w"], k))))) - r["y"])
        step = F.transform(F.array(errors), lambda e: F.struct(          # names the errors, so that they are made once
            F.transform(m["w"], lambda w, j: w - F.lit(rate) * (F.aggregate(
                F.get("holders", j), F.lit(0.0), lambda g, i: g + F.get(e, i)) / n + F.lit(l2) * w)).alias("w"),
            (m["b"] - F.lit(rate) * F.aggregate(e, F.lit(0.0), lambda g, x: g + x) / n).alias("b")))
        return F.element_at(step, 1)

    got = one.select("used", F.aggregate(F.sequence(F.lit(1), F.lit(epochs)), model, epoch).alias("m")).first()
    weights = [0.0] * BUCKETS
    for b, w in zip(got.used or [], got.m.w or []):
        weights[b] = w
    return weights, got.m.b if got.used else 0.0


def judge(pages: DataFrame, labelled: DataFrame, page_id: str = "page_id", url: str = "url", rules=RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, block_score`` of every URL."""
    weights, bias = train(labelled)
    table_of_weights = F.lit(weights)
    u = F.col(url)
    rows = pages.select(F.col(page_id).alias("page_id"), host_of(u).alias("host"), path_of(u).alias("path"))
    logit = F.aggregate(features(F.col("host"), F.col("path")), F.lit(float(bias)),
                        lambda z, k: z + F.get(table_of_weights, k))
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))
    out = rows.select("page_id", "host", "path", rule_column(F.col("host"), F.col("path"), rules).alias("rule"), score.alias("block_score"))
    says = F.lit(None).cast("string")
    for rule, verdict in rules:
        says = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(says)
    learned = F.when(F.col("block_score") >= 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", F.coalesce(says, learned).alias("verdict"), "block_score")


def op4_url_filter(spark, sf_dir):
    return judge(table(spark, sf_dir, "pages"), labelled_table(spark))
