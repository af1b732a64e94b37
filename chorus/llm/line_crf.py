"""Quality rules: a linear-chain conditional random field marks the lines of
a text as content or boilerplate; the share of words in content lines
decides whether the text is kept.

A line that holds a word is one step of the chain.  Its features are word
count, shares of symbols, pipes, exclamation marks, capitals and digits,
whether it repeats an earlier line, the share of its words that lie in
repeated three-word windows and whether it ends a sentence.

Fit.  The labels are those of documents; lines get theirs from their own
faults (``faulty``: rows of symbols or pipes, shouting, copies of an earlier
line or of each other's words).  Lines without a fault in documents of
quality 1 are content, faulty lines in documents of quality 0 are
boilerplate, and all others are latent: either state is possible, and the
chain decides by the line and by its neighbours.  The field's weights
(emission, transition, start) rise along the gradient of the likelihood of
what is known, ``log Z(known) - log Z``, both sums by forward and backward
passes that move through the lines of many texts in step, over ragged
arrays.  Viterbi decoding does the same.

Cases: null or empty text has no words and fails the base rule; without
labelled documents of both kinds texts are judged by the base rule alone;
repeated rows are judged each; extra columns are not read.

Bound: ``sample_docs`` labelled documents of at most ``sample_bytes`` bytes
and ``sample_lines`` lines are read for the fit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chorus.llm.common import slices_by_size, small_batches, table, utf8_buffers
from chorus.llm.textstats import TextStats

SAMPLE_DOCS = 3000
SAMPLE_BYTES = 16_000
SAMPLE_LINES = 400
FIT_STEPS = 120
BLOCK_BYTES = 1_000_000
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_CONTENT_SHARE = 0.5
RESULT = ("struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,"
          "base_failed:boolean,kept:boolean,content_share:double>")


NEVER = -1e30                   # the score of a state that is not allowed


def _log_sum(a, b):
    m = np.maximum(a, b)
    return m + np.log1p(np.exp(-np.abs(a - b)))


def faulty(features: np.ndarray) -> np.ndarray:
    """Lines with a fault of their own (columns as ``TextStats`` has them)."""
    f = features.T
    return (f[3] >= 0.3) | (f[4] >= 0.4) | ((f[6] > 0) & (f[5] >= 0.4)) | (f[8] > 0) | (f[9] >= 0.5)


class Steps:
    """The lines of many texts in step: texts by falling number of lines, so
    that those with a line ``t`` are the first ``active[t]``."""

    def __init__(self, row: np.ndarray, n: int):
        count = np.bincount(row, minlength=n)
        first = np.cumsum(count) - count
        order = np.argsort(-count, kind="stable")
        self.order = order[count[order] > 0]
        self.begin, self.size = first[self.order], count[self.order]
        self.longest = int(self.size[0]) if len(self.size) else 0
        self.active = np.searchsorted(-self.size, -np.arange(self.longest), side="left")

    def lines(self, t: int, of: int | None = None) -> np.ndarray:
        """Line ``t`` of the texts that have a line ``of`` (``t`` if not given)."""
        return self.begin[:self.active[t if of is None else of]] + t


class ChainField:
    """Two states, 0 boilerplate and 1 content: ``emit`` weighs a line's
    features for state 1, ``move[i, j]`` a step from i to j, ``begin`` the
    first line."""

    def __init__(self, n_features: int):
        self.emit, self.move, self.begin = np.zeros(n_features), np.zeros((2, 2)), np.zeros(2)

    def expected(self, x: np.ndarray, steps: Steps, allowed: np.ndarray):
        """``log Z`` over the states that ``allowed`` (lines x 2) leaves, and
        under it the expected features, moves and first states."""
        score = np.where(allowed, 0.0, NEVER)
        score[:, 1] += x @ self.emit
        alpha, beta = np.zeros((len(x), 2)), np.zeros((len(x), 2))
        for t in range(steps.longest):
            at = steps.lines(t)
            into = self.begin if t == 0 else _log_sum(alpha[at - 1, :1] + self.move[0], alpha[at - 1, 1:] + self.move[1])
            alpha[at] = into + score[at]
        for t in range(steps.longest - 2, -1, -1):
            at = steps.lines(t, t + 1)
            inner = beta[at + 1] + score[at + 1]
            beta[at] = _log_sum(inner[:, :1] + self.move[:, 0], inner[:, 1:] + self.move[:, 1])
        last = steps.begin + steps.size - 1
        z = _log_sum(alpha[last, 0], alpha[last, 1])
        of = np.zeros(len(x))
        of[steps.begin] = z
        of = of[np.maximum.accumulate(np.where(np.isin(np.arange(len(x)), steps.begin), np.arange(len(x)), 0))]
        p = np.exp(alpha + beta - of[:, None])
        follow = np.ones(len(x), dtype=bool)
        follow[steps.begin] = False
        b = np.flatnonzero(follow)
        moves = [np.exp(alpha[b - 1, i] + self.move[i, j] + score[b, j] + beta[b, j] - of[b]).sum() for i in (0, 1) for j in (0, 1)]
        return z.sum(), np.concatenate([p[:, 1] @ x, moves, p[steps.begin].sum(axis=0)])

    def fit(self, x: np.ndarray, row: np.ndarray, n: int, known: np.ndarray, steps: int = FIT_STEPS, l2: float = 1e-3) -> None:
        """``x``: lines x features; ``known``: state of each line, -1 latent."""
        chain, f = Steps(row, n), len(self.emit)
        free = np.ones((len(x), 2), dtype=bool)
        told = np.stack([known != 1, known != 0], axis=1)
        theta = np.concatenate([self.emit, self.move.ravel(), self.begin])
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, steps + 1):
            self.emit, self.move, self.begin = theta[:f], theta[f:f + 4].reshape(2, 2), theta[f + 4:]
            g = (self.expected(x, chain, told)[1] - self.expected(x, chain, free)[1]) / max(n, 1) - l2 * theta
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            theta = theta + 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        self.emit, self.move, self.begin = theta[:f], theta[f:f + 4].reshape(2, 2), theta[f + 4:]

    def viterbi(self, features: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        """Best state of every line; lines of a row follow each other."""
        chain = Steps(row, n)
        gain = features @ self.emit
        back = np.zeros((len(row), 2), dtype=np.int8)
        best = np.zeros((len(chain.order), 2))
        for t in range(chain.longest):
            at = chain.lines(t)
            k = len(at)
            if t == 0:
                best[:k] = self.begin
            else:
                here = best[:k, :, None] + self.move
                pick = here[:, 1, :] > here[:, 0, :]
                back[at] = pick
                best[:k] = np.where(pick, here[:, 1, :], here[:, 0, :])
            best[:k, 1] += gain[at]
        state = np.zeros(len(row), dtype=np.int8)
        now = (best[:, 1] > best[:, 0]).astype(np.int8)
        for t in range(chain.longest - 1, -1, -1):
            at = chain.lines(t)
            k = len(at)
            state[at] = now[:k]
            now[:k] = back[at, now[:k]]
        return state


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
        sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES, sample_lines: int = SAMPLE_LINES) -> ChainField | None:
    """A field fitted on the labelled documents that come first by a hash of
    the id; None without documents of both kinds."""
    ids = labels.select(F.col("doc_id").alias("i"), F.col("quality").alias("q")).filter(
        "i is not null and q is not null").groupBy("i").agg(F.min("q").alias("q"))
    ids = ids.orderBy(F.xxhash64("i"), "i").limit(sample_docs)
    rows = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t")).filter(
        (F.octet_length("t") <= sample_bytes) & (F.length("t") - F.length(F.replace("t", F.lit("\n"), F.lit(""))) < sample_lines))
    got = rows.join(F.broadcast(ids), "i").select("i", "t", "q").collect()       # at most sample_docs ids
    got = sorted({r.i: r for r in got}.values(), key=lambda r: r.i)
    if len({r.q for r in got}) < 2:
        return None
    data, offsets = utf8_buffers(pa.array([r.t for r in got], pa.string()))
    s = TextStats(data, offsets)
    good, fault = np.array([bool(r.q) for r in got])[s.line_row], faulty(s.line_features)
    known = np.where(good, np.where(fault, -1, 1), np.where(fault, 0, -1))
    field = ChainField(s.line_features.shape[1])
    field.fit(s.line_features, s.line_row, len(got), known)
    return field


def judge_column(field: ChainField | None, text: str = "text") -> Column:
    """Counts and verdict of each whole text as a struct column."""
    weights = vars(field) if field is not None else None

    @F.arrow_udf(RESULT)
    def judge(column: pa.Array) -> pa.Array:
        data, offsets = utf8_buffers(column)
        parts = []
        for a, b in slices_by_size(offsets, BLOCK_BYTES):
            s = TextStats(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
            failed = (s.n_words < MIN_WORDS) | (100 * s.n_repeat_words > MAX_REPEAT_PERCENT * s.n_words)
            if weights is None:
                share = np.ones(b - a)
            else:
                chain = ChainField(0)
                chain.__dict__ = weights
                state = chain.viterbi(s.line_features, s.line_row, b - a)
                content = np.bincount(s.line_row, weights=s.line_words * state, minlength=b - a)
                share = content / np.maximum(s.n_words, 1)
            parts.append((s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words, failed,
                          ~failed & (share >= MIN_CONTENT_SHARE), share))
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share"]
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()]
        cols = [pa.array(np.concatenate([p[k] for p in parts]) if parts else [], kinds[k]) for k in range(8)]
        return pa.StructArray.from_arrays(cols, names=names)

    return judge(F.col(text))


def judge(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    field = fit(docs, labels, doc_id, text)
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.select("doc_id", judge_column(field).alias("j")).select("doc_id", "j.*")


def op7_quality_rules(spark, sf_dir):
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
