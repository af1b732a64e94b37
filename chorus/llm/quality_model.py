"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good (1), bad (0) or abstain (-1) on
every document.  Spark counts how often each pattern of votes occurs over
all documents; the patterns (at most 3 ** labellers, whatever the input) go
to the driver, where expectation-maximisation estimates the share of good
documents and, for each labeller, how often it votes right on good and on
bad ones.  The posterior of a document's pattern is its weak label.  A
hashed linear scorer (logistic regression on hashed byte n-grams of the
text, normalised by their number) is trained on a bounded sample of the
weakly labelled documents and scores every whole text.

Cases: null or empty text is voted bad for its length and gets the scorer's
intercept; repeated rows are scored each; an empty table gives an empty
result; extra columns are not read.

Bound: ``sample_docs`` documents of at most ``sample_bytes`` bytes train the
scorer; votes and their statistics cover all documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chorus.llm.common import WORD_GAPS, row_sums, rows_of, slices_by_size, small_batches, table, utf8_buffers
from chorus.llm.textstats import LETTER, TextStats

SAMPLE_DOCS = 4000
SAMPLE_BYTES = 16_000
BUCKETS = 1 << 14
GRAMS = (2, 4)
BLOCK_BYTES = 1_000_000
TRAIN_BYTES = 1 << 17            # texts of a training block
EM_STEPS = 200
FIT_STEPS = 300
KEEP_AT = 0.5
LABELLERS = ("length", "symbols", "repeats", "lines", "capitals", "short_lines", "sentences", "letters")


def votes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Votes of the labellers, texts x labellers: 1 good, 0 bad, -1 none."""
    s = TextStats(data, offsets)
    n = len(offsets) - 1
    words = np.maximum(s.n_words, 1)
    lines = np.maximum(np.bincount(s.line_row, minlength=n), 1)
    mean = lambda k: np.bincount(s.line_row, weights=s.line_features[:, k] * s.line_words, minlength=n) / words
    symbols, repeats, copies = s.n_symbols / words, s.n_repeat_words / words, s.n_dup_lines / lines
    capitals, shorts, ends = mean(6), mean(2), mean(10)

    # letters: ASCII letters and all bytes beyond ASCII, among the bytes of words
    solid = np.maximum(row_sums(~WORD_GAPS[data], offsets), 1)
    letters = row_sums(LETTER[data] | (data >= 128), offsets) / solid

    def vote(good, bad):
        return np.where(bad, 0, np.where(good, 1, -1))

    out = np.stack([
        vote((s.n_words >= 80) & (s.n_words <= 30_000), s.n_words < 20),
        vote(symbols < 0.02, symbols > 0.1),
        vote(repeats < 0.1, repeats > 0.4),
        vote(copies < 0.1, copies > 0.3),
        vote(capitals < 0.1, capitals > 0.5),
        vote(shorts < 0.2, shorts > 0.6),
        vote(ends > 0.6, ends < 0.1),
        vote(letters > 0.9, letters < 0.85),
    ], axis=1)
    return out.astype(np.int8)


def pattern_column(text: str = "text") -> Column:
    """The votes on each whole text as one number, base 3."""

    @F.arrow_udf("int")
    def pattern(column: pa.Array) -> pa.Array:
        data, offsets = utf8_buffers(column)
        base = 3 ** np.arange(len(LABELLERS))
        parts = [((votes(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]) + 1) * base).sum(axis=1)
                 for a, b in slices_by_size(offsets, BLOCK_BYTES)]
        return pa.array(np.concatenate(parts) if parts else [], pa.int32())

    return pattern(F.col(text))


def unpack(patterns: np.ndarray) -> np.ndarray:
    return patterns[:, None] // 3 ** np.arange(len(LABELLERS)) % 3 - 1


class LabelModel:
    """Accuracies of the labellers given the hidden class, and its share."""

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, steps: int = EM_STEPS):
        v, weight = unpack(patterns), counts.astype(float)
        k = v.shape[1]
        # right[c, k]: P(vote is c | class c, votes).  Faults differ, so a bad
        # document shows some labellers a fault; a good one hardly any.
        self.share, self.right = 0.85, np.stack([np.full(k, 0.4), np.full(k, 0.98)])
        said = v >= 0
        for _ in range(steps):
            post = self._posterior(v)
            w = np.stack([(1 - post) * weight, post * weight])
            self.share = np.clip(w[1].sum() / max(weight.sum(), 1e-9), 0.01, 0.99)
            for c in (0, 1):
                cast = (w[c][:, None] * said).sum(axis=0)
                agree = (w[c][:, None] * (v == c)).sum(axis=0)
                self.right[c] = np.clip((agree + (4, 9.8)[c]) / (cast + 10), 0.05, 0.999)

    def _posterior(self, v: np.ndarray) -> np.ndarray:
        log = np.zeros((2, len(v)))
        for c in (0, 1):
            p = np.where(v == c, self.right[c], 1 - self.right[c])
            log[c] = np.where(v >= 0, np.log(p), 0).sum(axis=1) + np.log(self.share if c else 1 - self.share)
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        return self._posterior(unpack(patterns))


def hashed_grams(data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS):
    """Buckets of all byte n-grams inside the texts: ``(bucket, row)``."""

    row = rows_of(offsets)
    out, rows = [], []
    for n in GRAMS:
        if len(data) < n:
            continue
        h = np.full(len(data) - n + 1, n, dtype=np.uint32)
        for i in range(n):
            h = (h ^ data[i:len(data) - n + 1 + i]) * np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
        inside = row[n - 1:] == row[:len(row) - n + 1]
        out.append((h % np.uint32(buckets)).astype(np.int32)[inside])
        rows.append(row[:len(row) - n + 1][inside])
    if not out:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(rows)


class LinearScorer:
    """Logistic regression on the shares of hashed n-grams."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        bucket, row = hashed_grams(data, offsets)
        n = len(offsets) - 1
        total = np.bincount(row, weights=self.weights[bucket], minlength=n)
        return self.bias + total / np.maximum(np.bincount(row, minlength=n), 1)

    @classmethod
    def train(cls, data: np.ndarray, offsets: np.ndarray, target: np.ndarray, steps: int = FIT_STEPS, l2: float = 1e-6):
        n = len(offsets) - 1
        blocks = [_counted(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], a)
                  for a, b in slices_by_size(offsets, TRAIN_BYTES)]
        every = np.arange(BUCKETS)
        w, b = np.zeros(BUCKETS), 0.0
        m, v, mb, vb = np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, 0.0
        for t in range(1, steps + 1):
            g, r = np.zeros(BUCKETS), np.zeros(n)
            for first, size, each, bucket, times in blocks:
                rows, bucket = slice(first, first + len(size)), bucket.astype(np.intp)
                row = np.repeat(np.arange(len(size)), each)
                x = times / size[row] * 100                       # per cent
                z = b + np.bincount(row, weights=x * w[bucket], minlength=len(size))
                r[rows] = 1 / (1 + np.exp(-np.clip(z, -50, 50))) - target[rows]
                # the sum so far leads, so terms add up in the order of the rows, whatever the blocks
                g = np.bincount(np.concatenate([every, bucket]), weights=np.concatenate([g, x * r[rows][row]]), minlength=BUCKETS)
            g, gb = g / n + l2 * w, r.mean()
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
            w = w - 0.05 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
            b = b - 0.05 * (mb / (1 - 0.9 ** t)) / (np.sqrt(vb / (1 - 0.99 ** t)) + 1e-8)
        return cls(w * 100, float(b))


def _counted(data: np.ndarray, offsets: np.ndarray, first: int):
    """The n-grams of some texts, the first of them row ``first``: number of
    n-grams and of buckets met of each text, then bucket and times met, in the
    order of texts and buckets, in as few bytes as hold them."""
    bucket, row = hashed_grams(data, offsets)
    n = len(offsets) - 1
    key, times = np.unique(row * BUCKETS + bucket, return_counts=True)
    narrow = np.min_scalar_type(int(times.max(initial=0)))
    return (first, np.maximum(np.bincount(row, minlength=n), 1), np.bincount(key // BUCKETS, minlength=n),
            (key % BUCKETS).astype(np.uint16), times.astype(narrow))


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample_docs: int = SAMPLE_DOCS,
        sample_bytes: int = SAMPLE_BYTES):
    """``(LabelModel, LinearScorer, documents with pattern)``."""
    small_batches(docs.sparkSession)
    from chorus.plans.stage import stage
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    voted = stage(rows.select("doc_id", F.octet_length("text").alias("n"), pattern_column().alias("pattern")), "votes")
    seen = voted.groupBy("pattern").count().collect()             # at most 3 ** labellers rows
    if not seen:
        return None, None
    seen.sort()
    model = LabelModel(np.array([r.pattern for r in seen]), np.array([r["count"] for r in seen]))
    ids = voted.filter(F.col("doc_id").isNotNull() & (F.col("n") <= sample_bytes)).groupBy("doc_id").agg(
        F.min("pattern").alias("pattern")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    got = rows.join(F.broadcast(ids), "doc_id").select("doc_id", "text", "pattern").toArrow()    # at most sample_docs
    if not got.num_rows:
        return model, LinearScorer(np.zeros(BUCKETS), 0.0)
    place = {k: i for i, k in enumerate(got["doc_id"].to_pylist())}
    got = got.take([place[k] for k in sorted(place)])
    target = model.posterior(got["pattern"].to_numpy())
    data, offsets = utf8_buffers(got["text"])
    return model, LinearScorer.train(data, offsets, target)


def score_columns(model: LabelModel, scorer: LinearScorer, text: str = "text") -> Column:
    """``struct<score, weak_label, n_votes>`` of each whole text."""
    label_state, weights, bias = vars(model), scorer.weights.astype(np.float32), scorer.bias

    @F.arrow_udf("struct<score:double,weak_label:double,n_votes:int>")
    def score(column: pa.Array) -> pa.Array:
        held = LabelModel.__new__(LabelModel)
        held.__dict__ = label_state
        line = LinearScorer(weights, bias)
        data, offsets = utf8_buffers(column)
        z, weak, cast = [], [], []
        for a, b in slices_by_size(offsets, BLOCK_BYTES):
            d, o = data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
            v = votes(d, o)
            z.append(line.logits(d, o))
            weak.append(held._posterior(v))
            cast.append((v >= 0).sum(axis=1))
        join = lambda x: np.concatenate(x) if x else np.zeros(0)
        return pa.StructArray.from_arrays(
            [pa.array(1 / (1 + np.exp(-np.clip(join(z), -50, 50))), pa.float64()), pa.array(join(weak), pa.float64()),
             pa.array(join(cast).astype(np.int32), pa.int32())], names=["score", "weak_label", "n_votes"])

    return score(F.col(text))


def classify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, score, weak_label, n_votes, kept`` of every document."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    model, scorer = fit(rows)
    if model is None:
        return rows.selectExpr("doc_id", "0D AS score", "0D AS weak_label", "0 AS n_votes", "false AS kept")
    out = rows.select("doc_id", score_columns(model, scorer).alias("s")).select("doc_id", "s.*")
    return out.withColumn("kept", F.col("score") >= KEEP_AT)


def op3_quality_classifier(spark, sf_dir):
    return classify(table(spark, sf_dir, "documents"))
