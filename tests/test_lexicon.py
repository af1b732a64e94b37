import math
import string

import pytest

from chorus.data import lexicon as L
from chorus.functions.text import sentiment_label
from chorus.operators import lexicon as LX


def py_score(text, lex=L.SEED_LEXICON):
    """Brute-force spec of the rules, one comment at a time."""
    def strip(w):
        s = w.strip(string.punctuation)
        return w if len(s) <= 2 else s
    toks = [strip(w) for w in text.split()]
    low = [t.lower() for t in toks]
    isup = [t.isupper() for t in toks]
    capdiff = 0 < sum(isup) < len(toks)
    but = low.index("but") if "but" in low else -1
    neg = lambda w: w in L.NEGATIONS or "n't" in w
    total = 0.0
    for i, w in enumerate(low):
        if w not in lex:
            continue
        v = lex[w]
        if isup[i] and capdiff:
            v += L.CAPS_INCREMENT if v > 0 else -L.CAPS_INCREMENT
        for d in range(3):
            j = i - d - 1
            if j < 0:
                continue
            p = low[j]
            s = L.BOOSTER_INCREMENT if p in L.BOOSTERS else (-L.BOOSTER_INCREMENT if p in L.DAMPENERS else 0.0)
            if v < 0:
                s = -s
            if s != 0 and isup[j] and capdiff:
                s += L.CAPS_INCREMENT if v > 0 else -L.CAPS_INCREMENT
            v += s * L.DISTANCE_DECAY[d]
            if d == 0:
                if neg(p):
                    v *= L.NEGATION_SCALAR
            else:
                nearer = low[j + 1:i]
                if p == "never" and any(x in ("so", "this") for x in nearer):
                    v *= 1.25
                elif p == "without" and "doubt" in nearer:
                    pass
                elif neg(p):
                    v *= L.NEGATION_SCALAR
        if but >= 0:
            v *= L.BUT_BEFORE if i < but else (L.BUT_AFTER if i > but else 1.0)
        total += v
    if total != 0:
        ep = min(text.count("!"), 4) * L.EXCLAMATION_STEP
        qm = text.count("?")
        qa = qm * L.QUESTION_STEP if 1 < qm <= 3 else (L.QUESTION_MAX_AMP if qm > 3 else 0.0)
        total += (ep + qa) if total > 0 else -(ep + qa)
    c = total / math.sqrt(total * total + L.NORMALIZE_ALPHA)
    return round(max(-1.0, min(1.0, c)), 4)


TEXTS = ["nothing here at all", "good", "very good", "very nice good", "extremely so very good",
         "not good", "never so good", "without doubt good", "it was good but bad", "GOOD stuff here",
         "VERY GOOD", "very GOOD indeed", "good!", "good!!!!!", "bad?", "bad??", "bad????",
         "don't like it", "barely good", "this is the worst, stupid trash!", "No. no no", "BEST ever!!"]


def test_lexicon_matches_bruteforce(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "comment_id long, clean_comment string")
    got = {r.comment_id: (r.lexicon_score, r.lexicon_label) for r in LX.lexicon_scores(df).collect()}
    for i, t in enumerate(TEXTS):
        want = py_score(t)
        assert got[i][0] == pytest.approx(want, abs=1e-9), (t, got[i], want)
        assert got[i][1] == ("positive" if want >= 0.05 else "negative" if want <= -0.05 else "neutral")


def test_label_thresholds_inclusive(spark):
    df = spark.createDataFrame([(0.05,), (-0.05,), (0.0499,), (-0.0499,), (None,)], "s double")
    got = [r.l for r in df.select(sentiment_label("s").alias("l")).collect()]
    assert got == ["positive", "negative", "neutral", "neutral", "neutral"]


def test_word_classes_disjoint():
    lex = set(L.SEED_LEXICON)
    assert not lex & set(L.BOOSTERS)
    assert not lex & set(L.DAMPENERS)
    assert not lex & set(L.NEGATIONS)


def test_lexicon_is_broadcast(spark):
    df = spark.createDataFrame([(1, "good")], "comment_id long, clean_comment string")
    plan = LX.lexicon_sums(df)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan or "BroadcastExchange" in plan


def test_a_lexicon_table_of_any_size_takes_no_hint(spark):
    from pyspark.sql import functions as F
    big = spark.range(1_200_000).select(F.concat(F.lit("w"), "id").alias("token"), (F.col("id") % 5 - 2).cast("double").alias("valence"))
    df = spark.createDataFrame([(1, "w4 and w9"), (2, "w1199995"), (3, "w2 nothing")], "comment_id long, clean_comment string")
    got = {r.comment_id: r.lexicon_label for r in LX.lexicon_scores(df, big).collect()}
    assert got == {1: "positive", 2: "negative", 3: "neutral"}
    plan = LX.lexicon_scores(df, big)._jdf.queryExecution().analyzed().toString()
    assert "strategy=broadcast" not in plan
    assert len(LX.lexicon_table(spark, {f"t{i}": 1.0 for i in range(100_001)}).collect()) == 100_001
