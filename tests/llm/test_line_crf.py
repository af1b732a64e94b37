"""The chain field's sums and fit against enumeration, and lines told from
their neighbours."""

import itertools
import random

import numpy as np
import pyarrow as pa

from chorus.llm import line_crf as L
from chorus.llm.common import utf8_buffers
from chorus.llm.textstats import TextStats


def field_of(rng, f=3):
    field = L.ChainField(f)
    field.emit, field.move, field.begin = rng.normal(size=f), rng.normal(size=(2, 2)), rng.normal(size=2)
    return field


def enumerated(field, x, row, n, allowed):
    total, seen = 0.0, np.zeros(len(field.emit) + 6)
    for k in range(n):
        at = np.flatnonzero(row == k)
        if not len(at):
            continue
        paths = [p for p in itertools.product((0, 1), repeat=len(at)) if all(allowed[i, s] for i, s in zip(at, p))]
        scores = np.array([field.begin[p[0]] + sum(field.move[a, b] for a, b in zip(p, p[1:])) + sum((x[i] @ field.emit) * s for i, s in zip(at, p))
                           for p in paths])
        z = np.log(np.exp(scores).sum())
        total += z
        for p, w in zip(paths, np.exp(scores - z)):
            seen[:len(field.emit)] += w * sum(x[i] * s for i, s in zip(at, p))
            for a, b in zip(p, p[1:]):
                seen[len(field.emit) + 2 * a + b] += w
            seen[len(field.emit) + 4 + p[0]] += w
    return total, seen


def test_sums_equal_enumeration():
    rng = np.random.default_rng(4)
    sizes = [4, 0, 1, 6, 2]
    row = np.repeat(range(5), sizes)
    x, field = rng.normal(size=(len(row), 3)), field_of(rng)
    known = np.array([1, -1, 0, -1, -1, -1, 0, -1, -1, 1, 1, -1, 0])
    for allowed in (np.ones((len(row), 2), bool), np.stack([known != 1, known != 0], axis=1)):
        z, seen = field.expected(x, L.Steps(row, 5), allowed)
        want_z, want = enumerated(field, x, row, 5, allowed)
        assert np.isclose(z, want_z) and np.allclose(seen, want)


def test_fit_raises_the_likelihood_and_finds_the_states():
    rng = np.random.default_rng(5)
    row = np.repeat(np.arange(60), 8)
    state = rng.random(len(row)) < 0.5
    x = np.stack([np.ones(len(row)), state + rng.normal(scale=0.3, size=len(row))], axis=1)
    known = np.where(rng.random(len(row)) < 0.4, state, -1)
    field, told = L.ChainField(2), np.stack([known != 1, known != 0], axis=1)
    value = lambda: field.expected(x, L.Steps(row, 60), told)[0] - field.expected(x, L.Steps(row, 60), np.ones_like(told))[0]
    before = value()
    field.fit(x, row, 60, known)
    assert value() > before + 50
    assert (field.viterbi(x, row, 60) == state).mean() > 0.9


RNG = random.Random(8)
WORDS = "river town house people evening talk quiet slow old garden winter music train letter window bread story morning field child".split()


def prose_line():
    return " ".join(RNG.choice(WORDS) + RNG.choice("abcdefgh") for _ in range(18)).capitalize() + ".\n"


def menu_line():
    return " | ".join(RNG.choice(WORDS) + RNG.choice("abcdefgh") for _ in range(6)) + "\n"


def test_a_text_half_menu_half_prose(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    field = L.fit(docs, labels)
    prose, more, menu = ("".join(line() for _ in range(8)) for line in (prose_line, prose_line, menu_line))
    data, offsets = utf8_buffers(pa.array([menu + prose, prose + menu + more, prose, menu]))
    s = TextStats(data, offsets)
    state = field.viterbi(s.line_features, s.line_row, 4)
    lines = [state[s.line_row == k].tolist() for k in range(4)]
    assert lines == [[0] * 8 + [1] * 8, [1] * 8 + [0] * 8 + [1] * 8, [1] * 8, [0] * 8]
    got = spark.createDataFrame([(1, prose + menu + "".join(menu_line() for _ in range(9))), (2, prose + menu), (3, prose)], "doc_id long, text string")
    share = {r.doc_id: r.j.content_share for r in got.select("doc_id", L.judge_column(field).alias("j")).collect()}
    assert 0 < share[1] < share[2] < share[3] == 1


def test_without_labels_of_both_kinds_the_base_rule_judges(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.createDataFrame([(0, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    rows = L.judge(docs, labels).collect()
    assert len(rows) == docs.count() and all(r.kept != r.base_failed for r in rows)


def test_labels_decide(spark, sf):
    """Held-out: fitted on one half of the labels, judged on the other."""
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = L.judge(docs, labels.filter("doc_id % 2 = 0")).join(labels.filter("doc_id % 2 = 1"), "doc_id").filter("not base_failed").collect()
    good, bad = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0]
    assert sum(good) > 0.98 * len(good) and sum(bad) < 0.1 * len(bad)
