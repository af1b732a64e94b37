"""Phrase collocation mining by best-first branch and bound.

Texts are lower-cased (A-Z), cut into pieces at punctuation and line ends and
into words at blanks.  Per language, a phrase of two or three words that
occurs ``min_count`` times or more is a candidate; cut after its first ``k``
words it scores ``floor(1000000 * a * a / (l * r))``, the lowest cut counts.
A candidate inside a longer one that is at least ``drop_percent`` per cent as
frequent is dropped.  The first ``top`` of each language are returned.

Growth.  Words and pairs are counted first; a phrase is never more frequent
than its parts, so a pair below ``min_count`` is not grown.  A pair's own score
is then exact, and its count ``a`` and that of its first word ``l`` bound
whatever grows out of it: for a longer phrase of count ``a'``, the cut after
the first word gives ``a' * a' / (l * r) <= a' / l <= a / l``, so no extension
scores above ``floor(1000000 * a / l)``.

Frontier.  A round takes per language a threshold, the score that the best
``width`` pairs or so reach (from a histogram of scores), and grows

* every pair whose bound reaches the threshold, and
* every pair that ends in the first word of a contender (a pair that reaches
  the threshold) and is frequent enough to grow into a phrase that drops it.

So every phrase that reaches the threshold is known with its score, and of
every contender it is known whether it is dropped.  If ``top`` phrases that
survive reach the threshold, the language is settled, ties included: nothing
that is not grown can reach it.  Otherwise ``width`` is four times as large
in the next round, down to threshold 0, where all is grown.  Only pairs not
grown before are counted again.

Pieces are written once; words, pairs and grown phrases are counted with
partial aggregation, so a frequent phrase or language is no hot key.  Pairs
to grow are broadcast up to ``BROADCAST_PAIRS`` rows; beyond that all
three-word phrases are counted and then joined to them.

Cases: null text is empty, null language is ``und`` (as is a language of that
name); repeated rows and texts count each time; ties end at the phrase; extra
columns are not read; an empty table, or none with a candidate, gives an empty
result; a text without punctuation is one piece, however long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chorus.llm.common import full_text, table
from chorus.plans.stage import stage

MIN_COUNT, TOP, DROP_PERCENT, SCALE = 10, 2000, 50, 1_000_000
PIECE_BREAKS = r"[.,;:!?\x0A-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BROADCAST_PAIRS = 300_000         # rows of some eighty bytes: 24 MB
GROWTH = 4


def pieces(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``lang, words`` of every piece that has a word."""
    cut = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.explode_outer(F.split(full_text(text), PIECE_BREAKS)).alias("piece"))
    # the plain lower-casing is the faster one, and the same for a piece of ASCII
    low = F.when(F.octet_length("piece") == F.length("piece"), F.lower("piece")).otherwise(F.translate("piece", UPPER, LOWER))
    words = cut.select("lang", F.array_remove(F.split(F.replace(low, F.lit("\t"), F.lit(" ")), " "), "").alias("words"))
    return words.filter(F.size("words") > 0)


def windows(words: DataFrame, n: int) -> DataFrame:
    """``lang, w1 .. wn`` of every run of ``n`` words within a piece: the
    array zipped with itself shifted."""
    names = [f"w{i}" for i in range(1, n + 1)]
    size = F.size("words")
    shifted = words.filter(size >= n).select("lang", *[F.slice("words", i, size).alias(f"w{i}") for i in range(1, n + 1)])
    rows = shifted.select("lang", F.explode_outer(F.arrays_zip(*names)).alias("w")).select("lang", *[F.col(f"w.{x}").alias(x) for x in names])
    return rows.filter(F.col(names[-1]).isNotNull())


def counted(rows: DataFrame, min_count: int) -> DataFrame:
    """``a``, the number of equal rows, where it is ``min_count`` or more."""
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("a")).filter(F.col("a") >= min_count)


def ratio(a: str | Column, l: str | Column, r: str | Column | None = None) -> Column:
    """``floor(SCALE * a * a / (l * r))``, or ``floor(SCALE * a / l)``, in
    decimals, which hold counts up to 10**15 exactly."""
    d = lambda c: (F.col(c) if isinstance(c, str) else c).cast("decimal(15,0)")
    scale = F.lit(SCALE).cast("decimal(7,0)")
    above, below = (scale * d(a), d(l)) if r is None else (scale * d(a) * d(a), d(l) * d(r))
    return F.call_function("div", above, below)


def scored_pairs(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """``lang, w1, w2, a, l, r, score, bound``."""
    first = words.select("lang", F.col("w1"), F.col("a").alias("l"))
    second = words.select("lang", F.col("w1").alias("w2"), F.col("a").alias("r"))
    both = pairs.join(first, ["lang", "w1"]).join(second, ["lang", "w2"])
    return both.select("lang", "w1", "w2", "a", "l", "r", ratio("a", "l", "r").alias("score"), ratio("a", "l").alias("bound"))


def scored_triples(triples: DataFrame, pairs: DataFrame, words: DataFrame) -> DataFrame:
    """``lang, w1, w2, w3, a, l, r, score`` by the lowest cut, the first on ties."""
    head = pairs.select("lang", "w1", "w2", F.col("a").alias("l2"), F.col("l").alias("l1"))
    tail = pairs.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("r1"))
    last = words.select("lang", F.col("w1").alias("w3"), F.col("a").alias("r2"))
    t = triples.join(head, ["lang", "w1", "w2"]).join(tail, ["lang", "w2", "w3"]).join(last, ["lang", "w3"])
    t = t.withColumns({"s1": ratio("a", "l1", "r1"), "s2": ratio("a", "l2", "r2")})
    first = F.col("s1") <= F.col("s2")
    return t.select("lang", "w1", "w2", "w3", "a", F.when(first, F.col("l1")).otherwise(F.col("l2")).alias("l"),
                    F.when(first, F.col("r1")).otherwise(F.col("r2")).alias("r"), F.least("s1", "s2").alias("score"))


def thresholds(pairs: DataFrame, width: int) -> DataFrame:
    """``lang, tau``: a score that ``width`` pairs of the language or some
    more reach, 0 where it has fewer; from a histogram of some 160 cells."""
    cell = F.floor(F.log2(F.col("score") + 1) * 8)
    cells = pairs.groupBy("lang", cell.alias("cell")).agg(F.count("*").alias("n"), F.min("score").alias("edge"))
    above = Window.partitionBy("lang").orderBy(F.desc("cell"))
    reach = cells.withColumn("reached", F.sum("n").over(above)).filter(F.col("reached") >= width)
    tau = reach.groupBy("lang").agg(F.max("edge").alias("tau"))
    return cells.select("lang").distinct().join(tau, "lang", "left").select("lang", F.coalesce("tau", F.lit(0)).alias("tau"))


def pairs_to_grow(pairs: DataFrame, tau: DataFrame, drop_percent: int) -> DataFrame:
    known = pairs.join(F.broadcast(tau), "lang")                       # a row per language
    least = known.filter("score >= tau").groupBy("lang", F.col("w1").alias("w2")).agg(F.min("a").alias("least"))
    known = known.join(least, ["lang", "w2"], "left")
    return known.filter((F.col("bound") >= F.col("tau")) | (100 * F.col("a") >= drop_percent * F.col("least"))).select("lang", "w1", "w2")


def survivors(pairs: DataFrame, triples: DataFrame, tau: DataFrame, drop_percent: int) -> DataFrame:
    """The phrases that reach the threshold and are not dropped."""
    inside = triples.select("lang", "w1", "w2", "a").unionByName(triples.select("lang", F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a"))
    inside = inside.groupBy("lang", "w1", "w2").agg(F.max("a").alias("longer"))
    two = pairs.join(F.broadcast(tau), "lang").filter("score >= tau").join(inside, ["lang", "w1", "w2"], "left")
    two = two.filter(F.coalesce(100 * F.col("longer") < drop_percent * F.col("a"), F.lit(True)))
    three = triples.join(F.broadcast(tau), "lang").filter("score >= tau")
    cols = ["lang", "a", "l", "r", "score"]
    return two.select(*cols, F.concat_ws(" ", "w1", "w2").alias("phrase")).unionByName(
        three.select(*cols, F.concat_ws(" ", "w1", "w2", "w3").alias("phrase")))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT, top: int = TOP,
                 drop_percent: int = DROP_PERCENT, width: int | None = None, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of each language's first
    ``top`` phrases."""
    said = stage(pieces(docs, text, lang), "pieces")
    all_words = stage(counted(windows(said, 1), 1), "word-counts")
    totals = all_words.groupBy("lang").agg(F.sum("a").alias("n"))
    words = all_words.filter(F.col("a") >= min_count)
    pairs = stage(scored_pairs(counted(windows(said, 2), min_count), words), "pair-scores")
    width = width or 2 * top
    tau, grown, triples = None, None, None
    while True:
        new_tau = thresholds(pairs, width)
        if tau is not None:                                # settled languages keep their threshold
            new_tau = new_tau.join(F.broadcast(tau.select("lang", F.col("tau").alias("old"), "settled")), "lang").select(
                "lang", F.when(F.col("settled"), F.col("old")).otherwise(F.col("tau")).alias("tau"))
        new_tau = stage(new_tau, "tau")
        ask = pairs_to_grow(pairs, new_tau, drop_percent)
        if grown is not None:
            ask = ask.join(grown, ["lang", "w1", "w2"], "left_anti")
        ask = stage(ask, "grow")
        rows = windows(said, 3)
        if ask.count() <= broadcast_pairs:
            found = counted(rows.join(F.broadcast(ask), ["lang", "w1", "w2"], "left_semi").select("lang", "w1", "w2", "w3"), min_count)
        else:
            found = counted(rows, min_count).join(ask, ["lang", "w1", "w2"], "left_semi")
        found = stage(scored_triples(found, pairs, words), "triples")
        grown = ask if grown is None else grown.unionByName(ask)
        triples = found if triples is None else triples.unionByName(found)
        out = stage(survivors(pairs, triples, new_tau, drop_percent), "survivors")
        reached = out.groupBy("lang").agg(F.count("*").alias("found"))
        tau = stage(new_tau.join(reached, "lang", "left").select(
            "lang", "tau", ((F.col("tau") <= 0) | F.coalesce(F.col("found") >= top, F.lit(False))).alias("settled")), "settled")
        if tau.filter("not settled").isEmpty():
            break
        width *= GROWTH
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return best.join(F.broadcast(totals), "lang").select("lang", F.col("rank").cast("bigint"), "phrase", "a", "l", "r", "n", "score")


def op12_phrase_collocations(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents"))


OP12_SQL = f"""WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
said AS MATERIALIZED (
  SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces),
runs AS MATERIALIZED (
  SELECT lang, t[1] AS w1, t[2] AS w2, t[3] AS w3 FROM (SELECT lang, unnest(list_zip(w, w[2:], w[3:])) AS t FROM said)),
f1 AS MATERIALIZED (SELECT lang, w1, count(*) AS a FROM runs GROUP BY ALL),
f2 AS MATERIALIZED (SELECT lang, w1, w2, count(*) AS a FROM runs WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= {MIN_COUNT}),
f3 AS MATERIALIZED (SELECT lang, w1, w2, w3, count(*) AS a FROM runs WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= {MIN_COUNT}),
n AS (SELECT lang, sum(a) AS n FROM f1 GROUP BY lang),
two AS (
  SELECT p.lang, p.w1 || ' ' || p.w2 AS phrase, p.a, x.a AS l, y.a AS r, ({SCALE}::HUGEINT * p.a * p.a) // (x.a::HUGEINT * y.a) AS score
  FROM f2 p JOIN f1 x ON x.lang = p.lang AND x.w1 = p.w1 JOIN f1 y ON y.lang = p.lang AND y.w1 = p.w2
  WHERE NOT EXISTS (SELECT 1 FROM f3 t WHERE t.lang = p.lang AND t.w1 = p.w1 AND t.w2 = p.w2 AND 100 * t.a >= {DROP_PERCENT} * p.a)
    AND NOT EXISTS (SELECT 1 FROM f3 t WHERE t.lang = p.lang AND t.w2 = p.w1 AND t.w3 = p.w2 AND 100 * t.a >= {DROP_PERCENT} * p.a)),
cuts AS (
  SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3 AS phrase, t.a, x.a AS l1, bc.a AS r1, ab.a AS l2, z.a AS r2,
         ({SCALE}::HUGEINT * t.a * t.a) // (x.a::HUGEINT * bc.a) AS s1, ({SCALE}::HUGEINT * t.a * t.a) // (ab.a::HUGEINT * z.a) AS s2
  FROM f3 t JOIN f1 x ON x.lang = t.lang AND x.w1 = t.w1 JOIN f1 z ON z.lang = t.lang AND z.w1 = t.w3
  JOIN f2 ab ON ab.lang = t.lang AND ab.w1 = t.w1 AND ab.w2 = t.w2 JOIN f2 bc ON bc.lang = t.lang AND bc.w1 = t.w2 AND bc.w2 = t.w3),
found AS (
  SELECT lang, phrase, a, l, r, score FROM two
  UNION ALL SELECT lang, phrase, a, if(s1 <= s2, l1, l2), if(s1 <= s2, r1, r2), least(s1, s2) FROM cuts)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM found) JOIN n USING (lang)
WHERE rank <= {TOP}"""
