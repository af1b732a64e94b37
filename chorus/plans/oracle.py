"""DuckDB twins of the registered queries (the correctness oracle).

Each entry is plain SQL over the given tables.  Seed tables (lexicon, stop
words, lemma table) are written in as ``VALUES`` lists from the same Python
data the Spark side uses; the logic is written out independently.
"""

from __future__ import annotations

from chorus.data import fixed_values as fv
from chorus.data import lexicon as L
from chorus.data.language import ACCENTED, IRREGULAR_LEMMAS, PLAIN


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def in_list(words) -> str:
    return "(" + ", ".join(q(w) for w in sorted(set(words))) + ")"


def values(rows, cols) -> str:
    body = ", ".join("(" + ", ".join(q(v) if isinstance(v, str) else repr(float(v)) for v in r) + ")"
                     for r in rows)
    return f"(VALUES {body}) AS v({', '.join(cols)})"


P = r"!-/:-@\[-`{-~"

COMMENTS = """comments AS (
  SELECT doc_id AS comment_id, source AS video_id,
         printf('2024-%02d-%02dT%02d:00:00Z', doc_id % 12 + 1, doc_id % 28 + 1, doc_id % 24) AS date,
         text AS comment, (doc_id * 37) % 1000 AS like_count,
         'user_' || CAST(doc_id % 997 AS VARCHAR) AS author
  FROM documents)"""


def clean_sql(col: str, strict: bool = True) -> str:
    t = f"regexp_replace(translate(coalesce({col}, ''), chr(10) || chr(13), '  '), 'http\\S+|www\\S+', '', 'g')"
    if strict:
        t = f"regexp_replace({t}, '[^A-Za-z0-9\\s''.,!?]', ' ', 'g')"
    t = f"regexp_replace({t}, '\\s+', ' ', 'g')"
    return f"regexp_replace({t}, '^\\s+|\\s+$', '', 'g')"


CLEANED = f"""cleaned AS (
  SELECT *, {clean_sql('comment')} AS clean_comment FROM comments)"""

PREPARED = """prepared AS (
  SELECT comment_id, video_id, date, comment, like_count, author, clean_comment FROM (
    SELECT *, row_number() OVER (PARTITION BY clean_comment ORDER BY comment_id) AS rn
    FROM cleaned WHERE length(clean_comment) > 0) WHERE rn = 1)"""

BASE = f"WITH {COMMENTS},\n{CLEANED},\n{PREPARED}"


def _strip_punct(w: str) -> str:
    s = f"regexp_replace({w}, '^[{P}]+|[{P}]+$', '', 'g')"
    return f"CASE WHEN length({s}) <= 2 THEN {w} ELSE {s} END"


def _caps(w: str) -> str:
    return f"({w} = upper({w}) AND {w} <> lower({w}))"


def lexicon_ctes(src: str = "prepared", lexicon: str | None = None) -> str:
    """CTEs ending in ``lex_scored(comment_id, lexicon_score, lexicon_label)``."""
    lex = lexicon or values(sorted((k.lower(), v) for k, v in L.SEED_LEXICON.items()), ["token", "valence"])
    boost, damp, neg = in_list(L.BOOSTERS), in_list(L.DAMPENERS), in_list(L.NEGATIONS)
    parts = [f"""lx_t AS (
  SELECT comment_id, clean_comment,
    list_transform(list_filter(string_split_regex(regexp_replace(clean_comment, '^\\s+|\\s+$', '', 'g'), '\\s+'), lambda w: w <> ''),
                   lambda w: {_strip_punct('w')}) AS toks
  FROM {src})""",
             f"""lx_f AS (
  SELECT comment_id, clean_comment, toks,
    (len(list_filter(toks, lambda w: {_caps('w')})) > 0
     AND len(list_filter(toks, lambda w: {_caps('w')})) < len(toks)) AS capdiff,
    coalesce(list_position(list_transform(toks, lambda w: lower(w)), 'but'), 0) - 1 AS butpos
  FROM lx_t)""",
             """lx_x AS (
  SELECT comment_id, capdiff, butpos, i AS pos, toks[i + 1] AS tok,
    CASE WHEN i >= 1 THEN toks[i] END AS p1,
    CASE WHEN i >= 2 THEN toks[i - 1] END AS p2,
    CASE WHEN i >= 3 THEN toks[i - 2] END AS p3
  FROM (SELECT *, unnest(range(len(toks))) AS i FROM lx_f))""",
             f"""lx_h0 AS (
  SELECT x.*, lower(p1) AS l1, lower(p2) AS l2, lower(p3) AS l3,
    CASE WHEN {_caps('x.tok')} AND capdiff
         THEN (CASE WHEN v.valence > 0 THEN v.valence + {L.CAPS_INCREMENT} ELSE v.valence - {L.CAPS_INCREMENT} END)
         ELSE v.valence END AS v0
  FROM lx_x x JOIN {lex} ON lower(x.tok) = v.token)"""]
    prev = "lx_h0"
    for d in (1, 2, 3):
        p, lp, vin = f"p{d}", f"l{d}", f"v{d - 1}"
        s = f"(CASE WHEN {lp} IN {boost} THEN {L.BOOSTER_INCREMENT} WHEN {lp} IN {damp} THEN {-L.BOOSTER_INCREMENT} ELSE 0.0 END)"
        s = f"(CASE WHEN {vin} < 0 THEN -{s} ELSE {s} END)"
        s = (f"(CASE WHEN {s} <> 0 AND {_caps(p)} AND capdiff THEN "
             f"(CASE WHEN {vin} > 0 THEN {s} + {L.CAPS_INCREMENT} ELSE {s} - {L.CAPS_INCREMENT} END) ELSE {s} END)")
        w = f"(CASE WHEN {p} IS NULL THEN {vin} ELSE {vin} + {s} * {L.DISTANCE_DECAY[d - 1]} END)"
        negd = f"coalesce({lp} IN {neg} OR contains({lp}, 'n''t'), false)"
        if d == 1:
            nxt = f"CASE WHEN {negd} THEN {w} * {L.NEGATION_SCALAR} ELSE {w} END"
        else:
            so = "coalesce(l1 IN ('so', 'this'), false)" if d == 2 else \
                 "coalesce(l2 IN ('so', 'this') OR l1 IN ('so', 'this'), false)"
            doubt = "coalesce(l1 = 'doubt', false)" if d == 2 else "coalesce(l2 = 'doubt' OR l1 = 'doubt', false)"
            nxt = (f"CASE WHEN coalesce({lp} = 'never', false) AND {so} THEN {w} * 1.25 "
                   f"WHEN coalesce({lp} = 'without', false) AND {doubt} THEN {w} "
                   f"WHEN {negd} THEN {w} * {L.NEGATION_SCALAR} ELSE {w} END")
        parts.append(f"lx_h{d} AS (SELECT *, {nxt} AS v{d} FROM {prev})")
        prev = f"lx_h{d}"
    parts.append(f"""lx_s AS (
  SELECT comment_id, sum(v3 * CASE WHEN butpos < 0 THEN 1.0 WHEN pos < butpos THEN {L.BUT_BEFORE}
                                   WHEN pos > butpos THEN {L.BUT_AFTER} ELSE 1.0 END) AS s
  FROM {prev} GROUP BY comment_id)""")
    parts.append(f"""lx_a AS (
  SELECT c.comment_id, coalesce(lx_s.s, 0.0) AS s,
    least(length(c.clean_comment) - length(replace(c.clean_comment, '!', '')), {L.EXCLAMATION_MAX}) * {L.EXCLAMATION_STEP} AS ep,
    length(c.clean_comment) - length(replace(c.clean_comment, '?', '')) AS qm
  FROM {src} c LEFT JOIN lx_s ON c.comment_id = lx_s.comment_id)""")
    parts.append(f"""lx_b AS (
  SELECT comment_id,
    CASE WHEN s > 0 THEN s + ep + qa WHEN s < 0 THEN s - ep - qa ELSE s END AS s2
  FROM (SELECT *, CASE WHEN qm > 1 AND qm <= 3 THEN qm * {L.QUESTION_STEP} WHEN qm > 3 THEN {L.QUESTION_MAX_AMP} ELSE 0.0 END AS qa FROM lx_a))""")
    parts.append(f"""lex_scored AS (
  SELECT comment_id, lexicon_score,
    CASE WHEN lexicon_score >= {fv.POSITIVE_AT_OR_ABOVE} THEN 'positive'
         WHEN lexicon_score <= {fv.NEGATIVE_AT_OR_BELOW} THEN 'negative' ELSE 'neutral' END AS lexicon_label
  FROM (SELECT comment_id, round(greatest(least(s2 / sqrt(s2 * s2 + {L.NORMALIZE_ALPHA}), 1.0), -1.0), 4) AS lexicon_score FROM lx_b))""")
    return ",\n".join(parts)


NB_CLASSES = {"binary": ("negative", "positive"), "ternary": ("negative", "neutral", "positive")}


def nb_ctes(scheme: str, src: str = "prepared") -> str:
    """CTEs ending in ``<scheme>_scored(comment_id, <scheme>_label, <scheme>_score)``."""
    cs = NB_CLASSES[scheme]
    s = f"nb_{scheme}"
    if scheme == "binary":
        lab = "CASE WHEN l.quality = 1 THEN 'positive' ELSE 'negative' END"
    else:
        lab = "CASE WHEN l.toxic = 1 THEN 'negative' WHEN l.quality = 1 THEN 'positive' ELSE 'neutral' END"
    toks = "unnest(regexp_extract_all(lower(clean_comment), '[a-z0-9]+'))"
    order = sorted(cs)
    arg = "CASE " + " ".join(
        f"WHEN {' AND '.join(f'e_{c} >= e_{o}' for o in order[i + 1:]) or 'true'} THEN '{c}'"
        for i, c in enumerate(order[:-1])) + f" ELSE '{order[-1]}' END"
    return ",\n".join([
        f"{s}_train AS (SELECT p.comment_id, p.clean_comment, {lab} AS label FROM {src} p JOIN labels l ON p.comment_id = l.doc_id)",
        f"{s}_tok AS (SELECT label, {toks} AS term FROM {s}_train)",
        f"{s}_cnt AS (SELECT term, " + ", ".join(
            f"sum(CASE WHEN label = '{c}' THEN 1 ELSE 0 END) AS n_{c}" for c in cs) + f" FROM {s}_tok GROUP BY term)",
        f"{s}_w AS (SELECT term, " + ", ".join(
            f"ln((n_{c} + 1.0) / ((SELECT CAST(sum(n_{c}) AS DOUBLE) FROM {s}_cnt) + (SELECT CAST(count(*) AS DOUBLE) FROM {s}_cnt))) AS lp_{c}"
            for c in cs) + f" FROM {s}_cnt)",
        f"{s}_pri AS (SELECT " + ", ".join(
            f"ln(CAST(count_if(label = '{c}') AS DOUBLE) / count(*)) AS pr_{c}" for c in cs) + f" FROM {s}_train)",
        f"{s}_q AS (SELECT comment_id, {toks} AS term FROM {src})",
        f"{s}_sum AS (SELECT q.comment_id, " + ", ".join(f"sum(w.lp_{c}) AS s_{c}" for c in cs)
        + f", count(*) AS m FROM {s}_q q JOIN {s}_w w ON q.term = w.term GROUP BY q.comment_id)",
        f"{s}_z AS (SELECT p.comment_id, " + ", ".join(
            f"(SELECT pr_{c} FROM {s}_pri) + coalesce(x.s_{c} / x.m, 0.0) AS z_{c}" for c in cs)
        + f" FROM {src} p LEFT JOIN {s}_sum x ON p.comment_id = x.comment_id)",
        f"{s}_e AS (SELECT comment_id, " + ", ".join(
            f"exp(z_{c} - greatest({', '.join('z_' + o for o in cs)})) AS e_{c}" for c in cs) + f" FROM {s}_z)",
        f"{scheme}_scored AS (SELECT comment_id, {arg} AS {scheme}_label, "
        f"greatest({', '.join('e_' + c for c in cs)}) / ({' + '.join('e_' + c for c in cs)}) AS {scheme}_score FROM {s}_e)",
    ])


def simple_tokens_sql(col: str) -> str:
    return (f"list_filter(regexp_extract_all(translate(lower({col}), {q(ACCENTED)}, {q(PLAIN)}), '[a-z]+'), "
            f"lambda x: length(x) BETWEEN 2 AND 15)")


def lemma_sql(t: str) -> str:
    forms = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in sorted(IRREGULAR_LEMMAS.items()))
    return (f"CASE WHEN {t} IN {in_list(IRREGULAR_LEMMAS)} THEN (CASE {t} {forms} END) "
            f"WHEN length({t}) > 4 AND suffix({t}, 'ies') THEN left({t}, length({t}) - 3) || 'y' "
            f"WHEN suffix({t}, 'sses') THEN left({t}, length({t}) - 2) "
            f"WHEN length({t}) > 3 AND regexp_matches({t}, '[^sui]s$') THEN left({t}, length({t}) - 1) "
            f"ELSE {t} END")


def lemma_tokens_sql(col: str, stopwords) -> str:
    words = f"regexp_extract_all(lower({col}), '[a-z0-9]+(?:[''.][a-z0-9]+)*')"
    kept = f"list_filter({words}, lambda t: t NOT IN {in_list(stopwords)})"
    return f"list_filter(list_transform({kept}, lambda t: {lemma_sql('t')}), lambda t: length(t) >= 3)"


def nlp_cte(stopwords, src: str = "prepared") -> str:
    return f"""nlp AS (
  SELECT comment_id, clean_comment, {simple_tokens_sql('clean_comment')} AS tokens,
         {lemma_tokens_sql('clean_comment', stopwords)} AS token_clean
  FROM {src})"""


def ngrams_sql(t: str, n: int) -> str:
    return (f"CASE WHEN len({t}) >= {n} THEN list_transform(range(1, len({t}) - {n} + 2), "
            f"lambda i: array_to_string({t}[i:i + {n - 1}], ' ')) ELSE [] END")


def vtokens_sql(text: str, stopwords=None) -> str:
    t = f"regexp_extract_all(lower({text}), '[a-z0-9_]{{2,}}')"
    if stopwords:
        t = f"list_filter({t}, lambda w: w NOT IN {in_list(stopwords)})"
    return t


def top_ngrams_sql(docs: str, n: int, top: int, min_df: int = 2, max_df: float = 0.8) -> str:
    """``docs(comment_id, vtokens)`` -> top n-grams."""
    return f"""SELECT term AS ngram, count FROM (
  SELECT term, sum(tf) AS count, count(*) AS doc_freq FROM (
    SELECT comment_id, term, count(*) AS tf FROM (
      SELECT comment_id, unnest({ngrams_sql('vtokens', n)}) AS term FROM {docs}) GROUP BY 1, 2)
  GROUP BY term)
WHERE doc_freq >= {min_df} AND doc_freq <= (SELECT count(*) FROM {docs}) * CAST({max_df} AS DOUBLE)
ORDER BY count DESC, term LIMIT {top}"""


def tfidf_sql(docs: str, top: int, min_df: int = 2, max_df: float = 0.8) -> str:
    n = f"(SELECT CAST(count(*) AS DOUBLE) FROM {docs})"
    terms = f"list_concat({ngrams_sql('vtokens', 1)}, {ngrams_sql('vtokens', 2)})"
    return f"""SELECT term, round(score, 6) AS tfidf_score FROM (
  SELECT term, sum(r / norm) / {n} AS score FROM (
    SELECT *, sqrt(sum(r * r) OVER (PARTITION BY comment_id)) AS norm FROM (
      SELECT tf.comment_id, tf.term, tf.tf * (ln(({n} + 1.0) / (k.doc_freq + 1.0)) + 1.0) AS r
      FROM (SELECT comment_id, term, count(*) AS tf FROM (
              SELECT comment_id, unnest({terms}) AS term FROM {docs}) GROUP BY 1, 2) tf
      JOIN (SELECT term, doc_freq FROM (
              SELECT term, count(*) AS doc_freq FROM (
                SELECT DISTINCT comment_id, term FROM (SELECT comment_id, unnest({terms}) AS term FROM {docs}))
              GROUP BY term)
            WHERE doc_freq >= {min_df} AND doc_freq <= {n} * CAST({max_df} AS DOUBLE)) k
      ON tf.term = k.term))
  GROUP BY term)
ORDER BY round(score, 9) DESC, term LIMIT {top}"""


def pages_ctes(cap=None) -> str:
    """CTEs ending in ``page_state(video_id, page_no, is_error, stop_page, readp)``."""
    capc = "" if cap is None else f" AND p.nth <= {int(cap)}"
    return f"""pg AS (SELECT video_id, comment_id // 100 AS page_no FROM comments GROUP BY 1, 2),
pgs AS (SELECT video_id, page_no, ascii(right(video_id, 1)) % 5 = 0
                 AND page_no = max(page_no) OVER (PARTITION BY video_id) - 1 AS is_error,
               row_number() OVER (PARTITION BY video_id ORDER BY page_no) AS nth,
               page_no = max(page_no) OVER (PARTITION BY video_id) AS is_last FROM pg),
stops AS (SELECT video_id, min(page_no) AS stop_page FROM pgs WHERE is_error OR is_last GROUP BY 1),
page_state AS (
  SELECT p.video_id, p.page_no, p.is_error, s.stop_page,
         (s.stop_page IS NULL OR p.page_no <= s.stop_page){capc} AS readp
  FROM pgs p LEFT JOIN stops s USING (video_id))"""


def page_rows_sql(cap=None) -> str:
    return f"""WITH {COMMENTS},
{pages_ctes(cap)}
SELECT c.comment_id, c.video_id, c.date, c.comment,
       CASE WHEN c.comment_id % 13 <> 0 THEN c.like_count END AS like_count, c.author
FROM comments c JOIN page_state s ON c.video_id = s.video_id AND c.comment_id // 100 = s.page_no
WHERE s.readp AND NOT s.is_error"""


def stops_cte(user_text: str, domain, general, name: str = "stops") -> str:
    fixed = ", ".join(q(w) for w in (*general, *domain))
    return f"""{name} AS (
  SELECT DISTINCT word FROM (
    SELECT unnest([{fixed}]) AS word
    UNION ALL SELECT lower(regexp_replace(w, '^\\s+|\\s+$', '', 'g')) FROM (SELECT unnest(string_split({q(user_text)}, ',')) AS w))
  WHERE word <> '')"""


def topic_ctes(user_text: str, domain, general) -> str:
    """CTEs ``stops``, ``topic``, ``tdocs`` and ``pdocs`` over ``nlp``."""
    return f"""{stops_cte(user_text, domain, general)},
topic AS (
  SELECT comment_id, list_filter(token_clean, lambda t: NOT list_contains(sw, t) AND length(t) >= 3) AS toks
  FROM nlp, (SELECT list(word) AS sw FROM stops)),
tdocs AS (SELECT comment_id, toks, array_to_string(toks, ' ') AS topic_text FROM topic WHERE len(toks) > 0),
pdocs AS (SELECT comment_id, {vtokens_sql('topic_text')} AS vtokens FROM tdocs)"""


def vocab_cte(no_below: int, no_above: float) -> str:
    return f"""vocab AS MATERIALIZED (
  SELECT term, doc_freq FROM (
    SELECT term, count(*) AS doc_freq FROM (SELECT unnest(list_distinct(toks)) AS term FROM tdocs) GROUP BY term)
  WHERE doc_freq >= {no_below} AND doc_freq <= floor((SELECT count(*) FROM tdocs) * CAST({no_above} AS DOUBLE)))"""


def digamma_sql(x: str) -> str:
    y = f"(({x}) + 6.0)"
    return (f"(ln({y}) - 1.0 / (2.0 * {y}) - 1.0 / (12.0 * {y} ** 2) + 1.0 / (120.0 * {y} ** 4) - 1.0 / (252.0 * {y} ** 6) - "
            + " - ".join(f"1.0 / (({x}) + {i}.0)" for i in range(6)) + ")")


def lda_ctes(k: int, passes: int, seed: int) -> str:
    """The variational passes unrolled, over ``tdocs`` and ``vocab``: CTEs
    ``topic_terms(topic_id, rank, term, weight)`` and ``assigned(comment_id,
    topic_id, topic_score)``."""
    ks = range(k)
    cols = lambda f: ", ".join(f(i) for i in ks)
    plus = lambda f: "(" + " + ".join(f(i) for i in ks) + ")"
    digest = lambda i: f"md5(term || '|{i}|{seed}')"
    start = lambda i: "(-ln((" + " + ".join(
        f"(strpos('0123456789abcdef', substr({digest(i)}, {d + 1}, 1)) - 1) * {16 ** (6 - d)}.0" for d in range(7)) + f" + 0.5) / {16 ** 7}.0::DOUBLE))"
    out = [f"""bags AS MATERIALIZED (
  SELECT comment_id, term, CAST(count(*) AS DOUBLE) AS n FROM (SELECT comment_id, unnest(toks) AS term FROM tdocs)
  WHERE term IN (SELECT term FROM vocab) GROUP BY 1, 2)""",
           f"w0 AS MATERIALIZED (SELECT term, {cols(lambda i: f'CAST({1.0 / k!r} AS DOUBLE) + CAST({start(i)} AS DOUBLE) AS l{i}')} FROM vocab)"]
    for t in range(passes):
        beta = cols(lambda i: f"exp({digamma_sql(f'l{i}')} - {digamma_sql(f's{i}')}) AS b{i}")
        total = cols(lambda i: f"sum(l{i}) AS s{i}")
        out.append(f"b{t} AS MATERIALIZED (SELECT term, {beta} FROM w{t}, (SELECT {total} FROM w{t}))")
        if t == 0:
            src, take = f"bags JOIN b{t} USING (term)", lambda i: f"b{i}"
        else:
            theta = cols(lambda i: f"exp({digamma_sql(f'g{i}')} - {digamma_sql(plus(lambda j: f'g{j}'))}) AS t{i}")
            out.append(f"m{t} AS MATERIALIZED (SELECT comment_id, {theta} FROM g{t})")
            src, take = f"bags JOIN b{t} USING (term) JOIN m{t} USING (comment_id)", lambda i: f"t{i} * b{i}"
        out.append(f"r{t} AS MATERIALIZED (SELECT comment_id, term, {cols(lambda i: f'n * p{i} / {plus(lambda j: f'p{j}')} AS p{i}')} "
                   f"FROM (SELECT comment_id, term, n, {cols(lambda i: f'{take(i)} AS p{i}')} FROM {src}))")
        prior = cols(lambda i: f"a{i}" if t else f"CAST({1.0 / k!r} AS DOUBLE) AS a{i}")
        before = f"SELECT {prior} FROM a{t}" if t else f"SELECT {prior}"
        out.append(f"g{t + 1} AS MATERIALIZED (SELECT comment_id, {cols(lambda i: f'sum(p{i}) + any_value(a{i}) AS g{i}')} "
                   f"FROM r{t}, ({before}) GROUP BY comment_id)")
        out.append(f"a{t + 1} AS MATERIALIZED (SELECT {cols(lambda i: f'avg(g{i} / {plus(lambda j: f'g{j}')}) AS a{i}')} FROM g{t + 1})")
        out.append(f"w{t + 1} AS MATERIALIZED (SELECT term, {cols(lambda i: f'sum(p{i}) + CAST({1.0 / k!r} AS DOUBLE) AS l{i}')} FROM r{t} GROUP BY term)")
    terms = " UNION ALL ".join(f"SELECT {i} AS topic_id, term, l{i} / (SELECT sum(l{i}) FROM w{passes}) AS weight FROM w{passes}" for i in ks)
    out.append(f"""topic_terms AS MATERIALIZED (SELECT * FROM (
  SELECT topic_id, CAST(row_number() OVER (PARTITION BY topic_id ORDER BY round(weight, 9) DESC, term) AS INTEGER) AS rank, term, weight
  FROM ({terms})) WHERE rank <= 10)""")
    best = "CASE " + " ".join(f"WHEN g{i} = greatest({cols(lambda j: f'g{j}')}) THEN {i}" for i in ks) + " END"
    out.append(f"""assigned AS MATERIALIZED (
  SELECT comment_id, CAST({best} AS INTEGER) AS topic_id, greatest({cols(lambda i: f'g{i}')}) / {plus(lambda i: f'g{i}')} AS topic_score
  FROM (SELECT d.comment_id, {cols(lambda i: f'coalesce(g.g{i}, a.a{i}) AS g{i}')}
        FROM tdocs d LEFT JOIN g{passes} g USING (comment_id), a{passes} a))""")
    out.append("""topic_words AS (
  SELECT topic_id, string_agg(term, ', ' ORDER BY rank) FILTER (rank <= 8) AS topic_keywords,
         string_agg(term, ' / ' ORDER BY rank) FILTER (rank <= 3) AS topic_name
  FROM topic_terms GROUP BY topic_id)""")
    return ",\n".join(out)
