"""LDA topics as relational variational steps (op 40-42).

The model is a table: a row per term of the vocabulary with its weight in
every topic.  A pass of variational Bayes is a join and an aggregate:

* E-step: each (document, term) row meets its term's expected log weights
  and its document's expected log mixture; their product, normalised over the
  topics, says how much of the term's count each topic takes;
* M-step: those shares, summed by term, are the next weights; summed by
  document, the next mixtures.  Both sums come from one pass over the rows
  (grouping sets) and are written once, which also cuts the lineage.

The document prior starts symmetric and is learned: after each pass it is the
mean mixture of the corpus, so frequent topics have more prior weight.  The
starting weights are the prior and what a hash of the term with the seed in
it gives (exponentially distributed), and the number of passes is fixed, so the same corpus
gives the same model on any engine and with any partitioning, up to the last
bits of sums.

Nothing grows on the driver but the weights of the ``HOT_TERMS`` most frequent
terms, whose number is bounded.  A document's terms lie in one row, as two
arrays, in a table bucketed by document, so a pass moves the mixtures to them
and not the rows.  The frequent terms, which hold nearly all rows, meet
their weights by a broadcast and add up inside the task; only rows of a rare
term, which none of ``BLOCK_ROWS`` documents or more is, are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chorus.functions.numeric import digamma
from chorus.operators.hot import frequent_join, hot_size
from chorus.plans.stage import stage, stage_bucketed, stage_large, unstage

BLOCK_ROWS = 200_000
HOT_TERMS = 200_000              # terms whose weights are copied to every task: some 10 MB
BUCKET_ROWS = 4_000_000          # (document, term) pairs of a bucket
HASH_DIGITS = 7                  # hex digits of the hash that give a starting weight


def start_weight(term: str, topic: int, seed: int) -> str:
    """A weight from the exponential distribution: minus the logarithm of a
    number in (0, 1) made of the first digits of ``md5(term|topic|seed)``."""
    digits = f"substring(md5(concat({term}, '|{topic}|{seed}')), 1, {HASH_DIGITS})"
    return f"-ln((cast(conv({digits}, 16, 10) as double) + 0.5D) / {16 ** HASH_DIGITS}D)"


def _names(prefix: str, k: int) -> list[str]:
    return [f"{prefix}{i}" for i in range(k)]


def _by_document(rows: DataFrame, pairs: int) -> DataFrame:
    """``rows(doc, id, n)`` as a table of a row per document, bucketed by it:
    ``hot`` and ``rare``, the pairs of frequent terms (``id`` from 0) and of
    the others."""
    spark = rows.sparkSession
    buckets = max(spark.sparkContext.defaultParallelism, -(-pairs // BUCKET_ROWS))
    pair = F.struct("id", "n")
    docs = rows.repartition(buckets, "doc").groupBy("doc").agg(
        F.collect_list(F.when(F.col("id") >= 0, pair)).alias("hot"), F.collect_list(F.when(F.col("id") < 0, pair)).alias("rare"))
    return stage_bucketed(docs, "lda-docs", "doc", buckets)


def fit(bags: DataFrame, vocabulary: DataFrame, k: int, passes: int, seed: int, id_col: str = "comment_id",
        block_rows: int = BLOCK_ROWS, hot_terms: int = HOT_TERMS, feeds: tuple[DataFrame, ...] = ()) -> tuple[DataFrame, DataFrame, list[float]]:
    """``(weights, mixtures, prior)`` from ``bags(id_col, term, n)`` and
    ``vocabulary(term, doc_freq)``: ``weights`` has ``term, l0 ..``,
    ``mixtures`` ``id_col, g0 ..`` (documents with a term), ``prior`` is K
    numbers.  Topic-term prior and sum of the document prior: 1 / k and 1.
    ``feeds``: large stage tables that only ``bags`` reads.  Tables go when
    their last reader is done, so one pass lies on disk besides the documents."""
    topics, ls = range(k), _names("l", k)
    whole = " + ".join(_names("g", k))
    least = hot_size(vocabulary, "doc_freq", block_rows, hot_terms)
    place = F.monotonically_increasing_id()
    terms = stage(vocabulary.select("term", "doc_freq", F.when(F.col("doc_freq") >= least, place).otherwise(-1 - place).alias("id")), "lda-terms")
    pairs, rare = terms.agg(F.sum("doc_freq"), F.count_if(F.col("id") < 0)).first()          # two numbers
    bags = stage_large(bags.select(F.col(id_col).alias("doc"), "term", F.col("n").cast("double").alias("n")), "lda-bags")
    unstage(*feeds)
    docs = _by_document(frequent_join(bags, terms, "term", "doc_freq").select("doc", "id", "n"), pairs or 0)
    unstage(bags)
    weights = stage(terms.selectExpr("id", *[f"{1.0 / k!r}D + {start_weight('term', i, seed)} AS l{i}" for i in topics]), "lda-weights")
    totals = weights.agg(*[F.sum(f"l{i}") for i in topics]).first()               # K numbers
    prior, mixtures, last = [1.0 / k] * k, None, None
    for _ in range(passes):
        beta = weights.selectExpr("id", *[f"exp({digamma(f'l{i}')} - {digamma(f'{totals[i]!r}D')}) AS b{i}" for i in topics])
        take, known, held = [f"b{i}" for i in topics], [], docs
        if mixtures is not None:
            theta = mixtures.selectExpr("doc", *[f"exp({digamma(f'g{i}')} - {digamma(whole)}) AS t{i}" for i in topics])
            take, known = [f"t{i} * b{i}" for i in topics], _names("t", k)
            held = docs.join(theta.hint("shuffle_hash"), "doc")
        met = None
        for part, table_part in (("hot", F.broadcast(beta.filter("id >= 0"))), ("rare", beta.filter("id < 0"))):
            if part == "rare" and not rare:
                continue
            rows = held.select("doc", *known, F.explode_outer(part).alias("_p")).filter("_p is not null").select("doc", *known, "_p.id", "_p.n")
            rows = rows.join(table_part, "id").selectExpr("doc", "id", "n", *[f"{t} AS p{i}" for i, t in zip(topics, take)])
            met = rows if met is None else met.unionByName(rows)
        met = met.selectExpr("doc", "id", *[f"n * p{i} / ({' + '.join(f'p{j}' for j in topics)}) AS p{i}" for i in topics])
        summed = met.groupingSets([["doc"], ["id"]], "doc", "id").agg(
            (F.grouping("doc") == 0).alias("is_doc"), *[F.sum(f"p{i}").alias(f"s{i}") for i in topics])
        summed = stage_large(summed, "lda-pass")
        if last is not None:
            unstage(last)
        last = summed
        mixtures = summed.filter("is_doc").selectExpr("doc", *[f"s{i} + {prior[i]!r}D AS g{i}" for i in topics])
        weights = summed.filter("not is_doc").selectExpr("id", *[f"s{i} + {1.0 / k!r}D AS l{i}" for i in topics])
        size = " + ".join(f"s{i} + {prior[i]!r}D" for i in topics)
        state = summed.selectExpr(*[f"sum(if(is_doc, null, s{i} + {1.0 / k!r}D))" for i in topics],
                                  *[f"avg(if(is_doc, (s{i} + {prior[i]!r}D) / ({size}), null))" for i in topics]).first()     # 2 K numbers
        totals, prior = state[:k], list(state[k:])
    unstage(docs)
    return weights.join(terms, "id").select("term", *ls), mixtures.withColumnRenamed("doc", id_col), prior


def top_terms(weights: DataFrame, k: int, n: int) -> DataFrame:
    """``topic_id, rank, term, weight``: the ``n`` heaviest terms of each
    topic, weight as a share of the topic (ties by term)."""
    totals = weights.agg(*[F.sum(f"l{i}") for i in range(k)]).first()          # K numbers
    long = weights.select("term", F.posexplode(F.array(*[F.col(f"l{i}") / t for i, t in enumerate(totals)])).alias("topic_id", "weight"))
    order = Window.partitionBy("topic_id").orderBy(F.round("weight", 9).desc(), "term")
    return long.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n).select("topic_id", "rank", "term", "weight")


def dominant(docs: DataFrame, mixtures: DataFrame, prior: list[float], k: int, id_col: str = "comment_id") -> DataFrame:
    """``docs`` with ``topic_id``, the topic of the largest share (the least
    on ties), and ``topic_score``, that share; a document without a term of
    the vocabulary has the prior's."""
    gs = _names("g", k)
    out = docs.join(mixtures, id_col, "left").withColumns({g: F.coalesce(g, F.lit(a)) for g, a in zip(gs, prior)})
    best, score = F.lit(0), F.col(gs[0])
    for i, g in enumerate(gs[1:], 1):
        best = F.when(F.col(g) > score, F.lit(i)).otherwise(best)
        score = F.greatest(score, F.col(g))
    return out.withColumns({"topic_id": best.cast("int"), "topic_score": score / F.expr(" + ".join(gs))}).drop(*gs)
