"""Topic preparation and LDA topics (ops 34-45).

Stop-word removal and topic text are per-row array functions.  Terms are
counted inside the row; the vocabulary and bags of words are aggregates and
joins over distinct (document, term) rows.  Topics are fitted by the
relational variational steps of ``lda``: nothing that grows with the
vocabulary or the corpus reaches the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chorus.data import fixed_values as fv
from chorus.functions.arrays import with_term_counts
from chorus.functions.bloom import BloomFilter
from chorus.functions.text import EDGE_SPACES_RE, explode_tokens
from chorus.operators import lda
from chorus.operators.hot import frequent_join
from chorus.operators.tokens import general_stopwords
from chorus.plans.stage import stage_large

TOPIC_TERMS = 10                 # terms listed per topic


def stopword_table(spark: SparkSession, user_text: str = "", domain: list[str] | None = None) -> DataFrame:
    """Op 34: the union of the general list, the domain list and the words
    that stand between the commas of a user string, in lower case."""
    dom = fv.DOMAIN_STOPWORDS if domain is None else domain
    fixed = spark.createDataFrame([(w,) for w in (*general_stopwords(), *dom)], "word STRING")
    said = spark.createDataFrame([(user_text,)], "said STRING").select(F.explode(F.split("said", ",")).alias("word"))
    said = said.select(F.lower(F.regexp_replace("word", EDGE_SPACES_RE, "")).alias("word")).filter("word <> ''")
    return fixed.union(said).distinct()


def topic_stopwords(spark: SparkSession, user_text: str = "", domain: list[str] | None = None) -> list[str]:
    """Op 34 as a literal set for the array filters (an ``INSET`` lookup
    inside the row); as long as the fixed lists and the user's string."""
    return sorted(r.word for r in stopword_table(spark, user_text, domain).collect())


def add_topic_tokens(df: DataFrame, stopwords: list[str], col: str = "token_clean",
                     out: str = "token_clean_topic", min_len: int = 3) -> DataFrame:
    """Op 35: drop stop words and tokens shorter than ``min_len``; order and
    repeats kept (so not ``array_except``)."""
    return df.withColumn(out, F.filter(col, lambda t: ~t.isin(*stopwords) & (F.length(t) >= min_len)))


def topic_text(df: DataFrame, stopwords: list[str], col: str = "token_clean",
               drop_empty: bool = True) -> DataFrame:
    """Op 36: topic tokens joined by a space; empty rows dropped."""
    out = add_topic_tokens(df, stopwords, col).withColumn(
        "topic_text", F.concat_ws(" ", "token_clean_topic"))
    # tokens are non-empty, so an empty list <=> an empty text; the size test
    # is the cheaper one to evaluate where Catalyst pushes it
    return out.filter(F.size("token_clean_topic") > 0) if drop_empty else out


def topic_docs(df: DataFrame, stopwords: list[str], col: str = "token_clean") -> DataFrame:
    """The topic corpus of the dashboard: comments left with at least one
    topic token."""
    return add_topic_tokens(df, stopwords, col).filter(F.size("token_clean_topic") > 0)


def vocabulary(docs: DataFrame, col: str = "token_clean_topic", no_below: int = fv.LDA_NO_BELOW,
               no_above: float = fv.LDA_NO_ABOVE, id_col: str = "comment_id") -> DataFrame:
    """Op 37: ``(term, doc_freq)`` kept when ``no_below <= df <=
    int(no_above * N)``.  N arrives as a scalar subquery (no join)."""
    n = docs.select(F.count("*")).scalar()
    dfs = (explode_tokens(docs, [], F.array_distinct(col), "term")
           .groupBy("term").agg(F.count("*").alias("doc_freq")))
    return dfs.filter((F.col("doc_freq") >= no_below) &
                      (F.col("doc_freq") <= F.floor(n * F.lit(no_above))))


def bag_of_words(docs: DataFrame, vocab: DataFrame, col: str = "token_clean_topic",
                 id_col: str = "comment_id") -> DataFrame:
    """Op 38: ``(comment_id, term, count)`` for vocabulary terms.  Counted in
    the row; a Bloom filter of the vocabulary keeps most other terms from
    the join, which is exact.  The counts are written once, as the join reads
    its rows twice; ``vocab`` is read more than once: store it."""
    return _bags(_term_runs(docs, col, id_col), vocab, id_col)


def _term_runs(docs: DataFrame, col: str, id_col: str) -> DataFrame:
    return stage_large(with_term_counts(docs.select(id_col, col), F.col(col), "runs").select(id_col, "runs"), "term-runs")


def _bags(runs: DataFrame, vocab: DataFrame, id_col: str) -> DataFrame:
    rows = runs.select(id_col, F.explode_outer("runs").alias("r")).filter(F.col("r").isNotNull())
    rows = rows.select(id_col, F.col("r.term").alias("term"), F.col("r.n").alias("n"))
    rows = rows.filter(BloomFilter.of(vocab, "term").may_hold("term"))
    return frequent_join(rows, vocab, "term", "doc_freq").select(id_col, "term", F.col("n").alias("count"))


def corpus_stats(docs: DataFrame, vocab: DataFrame) -> DataFrame:
    """Op 39: vocabulary size and number of documents (documents left with
    an empty bag included)."""
    return docs.agg(F.count("*").alias("documents")).select(
        vocab.select(F.count("*")).scalar().alias("vocabulary_size"), "documents")


@dataclass
class TopicModel:
    topics: DataFrame            # topic_id, rank, term, weight
    assignments: DataFrame       # docs + topic_id, topic_score


def no_topics(docs: DataFrame) -> TopicModel:
    assigned = docs.withColumns({"topic_id": F.lit(None).cast("int"), "topic_score": F.lit(None).cast("double")}).limit(0)
    return TopicModel(docs.sparkSession.createDataFrame([], "topic_id INT, rank INT, term STRING, weight DOUBLE"), assigned)


def fit_topics(docs: DataFrame, k: int = fv.LDA_TOPICS, passes: int = fv.LDA_PASSES, seed: int = fv.LDA_SEED,
               no_below: int = fv.LDA_NO_BELOW, no_above: float = fv.LDA_NO_ABOVE, topn: int = TOPIC_TERMS,
               col: str = "token_clean_topic", id_col: str = "comment_id", block_rows: int = lda.BLOCK_ROWS) -> TopicModel:
    """Ops 40-41.  Every term of the vocabulary takes part.  An empty corpus
    or vocabulary gives empty tables."""
    vocab = stage_large(vocabulary(docs, col, no_below, no_above, id_col), "vocabulary")
    if vocab.isEmpty():
        return no_topics(docs)
    runs = _term_runs(docs, col, id_col)
    bags = _bags(runs, vocab, id_col).withColumnRenamed("count", "n")
    weights, mixtures, prior = lda.fit(bags, vocab, k, passes, seed, id_col, block_rows, feeds=(runs,))
    return TopicModel(lda.top_terms(weights, k, topn), lda.dominant(docs, mixtures, prior, k, id_col))


def topic_keywords(topics: DataFrame, topn: int = fv.TOPIC_KEYWORDS_N) -> DataFrame:
    """Op 42: ``topn`` words and a name of the first three, a row per topic."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "term")))
    words = topics.filter(F.col("rank") <= topn).groupBy("topic_id").agg(F.transform(ordered, lambda s: s["term"]).alias("_t"))
    return words.select("topic_id", F.array_join("_t", ", ").alias("topic_keywords"),
                        F.array_join(F.slice("_t", 1, 3), " / ").alias("topic_name"))


def topic_summary(assigned: DataFrame, keywords: DataFrame, order: str = "topic_id") -> DataFrame:
    """Op 43: comments per dominant topic, left-joined to the keywords
    (K rows: broadcast)."""
    counts = assigned.groupBy("topic_id").agg(F.count("*").alias("comment_count"))
    out = counts.join(F.broadcast(keywords), "topic_id", "left")
    return out.orderBy("topic_id" if order == "topic_id" else F.col("comment_count").desc(), "topic_id")


def topic_comments(assigned: DataFrame, n: int = fv.TOPIC_COMMENTS, id_col: str = "comment_id") -> DataFrame:
    """Op 44: the ``n`` comments with the highest topic probability."""
    return assigned.orderBy(F.round("topic_score", 9).desc(), F.col(id_col)).limit(n)
