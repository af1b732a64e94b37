"""Column expressions for comment text.

All of these are built-in Spark expressions (regexp, translate, higher-order
array functions), so they run inside the JVM and need no Python worker.
Java's ``\\s`` is ASCII-only unless ``(?U)`` is given; the URL step and the
whitespace collapse use ``(?U)`` so non-ASCII spaces behave like Python's
``str`` regexes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chorus.data import fixed_values as fv
from chorus.data.language import ACCENTED, IRREGULAR_LEMMAS, PLAIN

ColumnOrName = Column | str

# Raw regex literals shared with the oracle SQL.
URL_RE = r"(?U)http\S+|www\S+"
STRICT_KEPT_RE = r"[A-Za-z0-9'.,!?]+"
SPACES_RE = r"(?U)\s+"
EDGE_SPACES_RE = r"(?U)^\s+|\s+$"
ASCII_PUNCT = r"!-/:-@\[-`{-~"          # string.punctuation as ranges
PUNCT_CHARS = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum())   # the same, one by one
WORD_TOKEN_RE = r"[a-z0-9]+(?:['.][a-z0-9]+)*"
MODEL_TOKEN_RE = r"[a-z0-9]+"
VECTORIZER_TOKEN_RE = r"[a-z0-9_]{2,}"


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _without_urls(c: ColumnOrName) -> Column:
    """Null as empty, URLs deleted; most texts hold none and are spared the
    regular expression."""
    t = F.coalesce(_c(c).cast("string"), F.lit(""))
    return F.when(t.contains("http") | t.contains("www"), F.regexp_replace(t, URL_RE, "")).otherwise(t)


def clean_strict(c: ColumnOrName) -> Column:
    """null -> ''; drop URLs; every character outside letters, digits and
    ' . , ! ? -> space; collapse; strip.  White space and other characters
    that go all end in one space, so the runs of what is kept are joined by
    one (replacing the runs between them gives the same text and takes seven
    times as long)."""
    return F.array_join(F.regexp_extract_all(_without_urls(c), F.lit(STRICT_KEPT_RE), 0), " ")


def clean_light(c: ColumnOrName) -> Column:
    """As ``clean_strict`` without the character whitelist (keeps accents,
    emoji and all punctuation)."""
    return F.trim(F.regexp_replace(_without_urls(c), SPACES_RE, " "))


def video_id(c: ColumnOrName) -> Column:
    """Video ID from a URL or a bare ID: the first hit of the short-link,
    ``v=`` and ``shorts/`` patterns, in that order, else the stripped text.
    Null or empty input gives null."""
    raw = _c(c)
    t = F.regexp_replace(raw, EDGE_SPACES_RE, "")
    short = F.regexp_extract(t, r"youtu\.be/([^?&]+)", 1)
    watch = F.regexp_extract(t, r"v=([^?&]+)", 1)
    shorts = F.regexp_extract(t, r"shorts/([^?&]+)", 1)
    return (F.when(raw.isNull() | (raw == ""), F.lit(None).cast("string"))
            .when(short != "", short)
            .when(watch != "", watch)
            .when(shorts != "", shorts)
            .otherwise(t))


def sentiment_label(score: ColumnOrName, title_case: bool = False) -> Column:
    s = _c(score)
    pos, neg, neu = ("Positive", "Negative", "Neutral") if title_case else (
        "positive", "negative", "neutral")
    return (F.when(s >= fv.POSITIVE_AT_OR_ABOVE, pos)
            .when(s <= fv.NEGATIVE_AT_OR_BELOW, neg)
            .otherwise(neu))


def count_char(c: ColumnOrName, ch: str) -> Column:
    t = _c(c)
    return F.length(t) - F.length(F.replace(t, F.lit(ch), F.lit("")))


def strip_outer_punct(t: Column) -> Column:
    """Strip leading/trailing ASCII punctuation unless that leaves <= 2
    characters (then the token is kept as it was)."""
    s = F.btrim(t, F.lit(PUNCT_CHARS))
    return F.when(F.length(s) <= 2, t).otherwise(s)


def is_all_caps(t: Column) -> Column:
    """Python ``str.isupper``: has a cased letter and none is lower case."""
    return (t == F.upper(t)) & (t != F.lower(t))


def simple_tokens(c: ColumnOrName, min_len: int = 2, max_len: int = 15) -> Column:
    """Lower-case, fold accents, alphabetic runs of ``min_len..max_len``."""
    t = F.lower(_c(c))
    # every accented letter takes two bytes or more; a text of one-byte characters holds none
    t = F.when(F.octet_length(t) != F.length(t), F.translate(t, ACCENTED, PLAIN)).otherwise(t)
    toks = F.regexp_extract_all(t, F.lit("[a-z]+"), 0)
    return F.filter(toks, lambda x: F.length(x).between(min_len, max_len))


def word_tokens(c: ColumnOrName) -> Column:
    """Lower-cased word tokens: letter/digit runs that may hold an inner
    apostrophe or dot.  Punctuation never forms a token."""
    return F.regexp_extract_all(F.lower(_c(c)), F.lit(WORD_TOKEN_RE), 0)


_FORMS = sorted(IRREGULAR_LEMMAS)


def lemma_of(t: Column) -> Column:
    """Table lemma for irregular forms, else the regular-plural rules (no
    regular expression: one a token took a third of the time of all lemmas)."""
    table = F.map_from_arrays(F.array(*[F.lit(k) for k in _FORMS]),
                              F.array(*[F.lit(IRREGULAR_LEMMAS[k]) for k in _FORMS]))
    n = F.length(t)
    plural = (F.when((n > 4) & t.endswith("ies"), F.concat(F.substring(t, 1, n - 3), F.lit("y")))
              .when(t.endswith("sses"), F.substring(t, 1, n - 2))
              .when((n > 3) & ~(t.endswith("ss") | t.endswith("us") | t.endswith("is")), F.substring(t, 1, n - 1))
              .otherwise(t))
    return (F.when(t.isin(*_FORMS), F.element_at(table, t))
            .when(t.endswith("s"), plural)
            .otherwise(t))


def model_tokens(c: ColumnOrName) -> Column:
    """Classifier input: the lower-cased letter/digit runs of the whole text."""
    return F.regexp_extract_all(F.lower(_c(c)), F.lit(MODEL_TOKEN_RE), 0)


def vectorizer_tokens(c: ColumnOrName) -> Column:
    """Re-split of joined token text the way the phrase/keyword vectorisers
    do it: lower-case word runs of at least two characters."""
    return F.regexp_extract_all(F.lower(_c(c)), F.lit(VECTORIZER_TOKEN_RE), 0)


def explode_tokens(df, cols, arr: Column, name: str):
    """``explode`` without the inferred ``size(arr) > 0`` filter.

    For an inner explode Catalyst adds ``size(arr) > 0`` and pushes it as
    far down as it can -- below windows on the text and into the scan --
    where the whole array expression is computed a second time.  The outer
    form plus a null test on the produced column keeps the work in one
    place."""
    return df.select(*cols, F.explode_outer(arr).alias(name)).filter(F.col(name).isNotNull())
