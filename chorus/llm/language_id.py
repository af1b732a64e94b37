"""Language identification by cross-parsing entropy.

A suffix automaton is built of a sample of labelled text per language.  A
text is then parsed against each automaton from left to right into the
longest phrases that occur in that language's sample; the number of phrases
``c`` gives the cross entropy ``c * log2(m) / n`` (``m`` sample characters,
``n`` text characters).  The language with the least entropy wins, so the
one that needs the fewest normalised phrases; ties go to the alphabetically
first.

Letters are lower-cased; every run of other characters reads as one space.
Texts are parsed in pieces of ``SEGMENT`` characters (a piece's end ends a
phrase, alike for all languages), many pieces in step with each other: the
transitions of all automata lie in one displaced table (a state is an offset,
a transition the entry at offset plus symbol, which names its owner), and one
NumPy step moves all pieces by one character in ``LANG_GROUP`` languages.

Every labelled language is learned, with every letter of its sample.  Bounds:
training reads at most ``sample_docs`` documents and ``sample_chars``
characters a language, so the model, which is broadcast, grows with the
languages alone, by under 2 MB each.

Cases: null text or text without a letter gives ``und`` with score 0; so
does every text when no row is labelled.  With one language learned the
score is 1.  Otherwise the score is ``1 - best / second`` of the entropies.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chorus.llm.common import slices_by_size, small_batches, table, worker_state

SAMPLE_CHARS = 24_000
SAMPLE_DOCS = 64
LANG_GROUP = 64                 # languages that are scored in one step
SEGMENT = 1024
BATCH_CHARS = 2_000_000
UNKNOWN = "und"
RESULT = "struct<lang_pred:string,score:double,phrases:bigint,phrase_length:double,known:boolean>"


def held_out(doc_id: str = "doc_id") -> Column:
    """True for every fifth document by CRC-32 of its id; a null id is not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
                  sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> list:
    """``(lang, text)`` of the sample: for each language the ``sample_docs``
    documents that come first by a hash of the id, those of at most a
    sixteenth of the sample's characters before longer ones, as far as they
    make up the sample's characters.  Ranks are made of ids and lengths;
    Spark limits each group before its shuffle."""
    rows = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t"), F.col(lang).alias("l")).filter(
        F.col("l").isNotNull() & F.col("t").isNotNull() & F.col("i").isNotNull() & ~held_out("i"))
    order = Window.partitionBy("l").orderBy("long", F.xxhash64("i"), "i")
    ids = rows.select("i", "l", F.length("t").alias("n"), (F.length("t") > sample_chars // 16).alias("long"))
    first = ids.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= sample_docs)
    before = Window.partitionBy("l").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    first = first.withColumn("before", F.coalesce(F.sum(F.col("n") + 1).over(before), F.lit(0))).filter(F.col("before") < sample_chars)
    first = first.groupBy("i", "l").agg(F.min("k").alias("k"))
    hit = rows.select("i", "l", F.substring("t", 1, sample_chars).alias("t")).join(F.broadcast(first), ["i", "l"]).collect()
    return [(r.l, r.t) for r in sorted(hit, key=lambda r: (r.l, r.k, r.t))]


class SuffixAutomaton:
    """All substrings of a sequence of symbols; built one symbol at a time."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.last = [-1], [0], 0

    def add(self, symbol: int) -> None:
        nxt, link, length = self.next, self.link, self.length
        new, p = len(nxt), self.last
        nxt.append({})
        length.append(length[p] + 1)
        link.append(0)
        while p >= 0 and symbol not in nxt[p]:
            nxt[p][symbol] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][symbol]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[new] = copy
                while p >= 0 and nxt[p].get(symbol) == q:
                    nxt[p][symbol] = copy
                    p = link[p]
        self.last = new


def letters_table() -> np.ndarray:
    """True for the code points that are letters."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def script(ch: str) -> str:
    """The script of a letter, the first word of its Unicode name."""
    return unicodedata.name(ch, "").split(" ")[0]


def letter_scripts() -> tuple[list, np.ndarray]:
    """The scripts' names, and the place of its script for each code point."""
    place: dict[str, int] = {}
    at = np.zeros(0x110000, dtype=np.uint16)
    for i in np.flatnonzero(worker_state("letters", letters_table)).tolist():
        at[i] = place.setdefault(script(chr(i)), len(place))
    return list(place), at


def place_rows(rows: list, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Displaces rows ``{symbol: value}`` into one table without overlap, no
    two at one offset: ``(offsets, owners, values)``, where the entry at
    ``offset + symbol`` has the row's offset as its owner, or another's or
    -1 where the row has no such symbol.  Row 0 has offset 0; long rows are
    placed first, at offsets that are tried at random, the table doubled
    where none fits."""
    rng = np.random.default_rng(0)
    span = 1 << max(8, (sum(map(len, rows)) + len(rows)).bit_length())
    owners, values, offsets, taken = [-1] * (span + width), [-1] * (span + width), [-1] * len(rows), set()

    def draws():
        while True:
            yield from rng.integers(0, span, 4096).tolist()

    draw = draws()
    for i in [0, *sorted(range(1, len(rows)), key=lambda i: -len(rows[i]))]:
        at, tries = (next(draw) if i else 0), 0
        while at in taken or any(owners[at + x] >= 0 for x in rows[i]):
            at, tries = next(draw), tries + 1
            if tries % 4096 == 0:
                owners += [-1] * span
                values += [-1] * span
                span *= 2
        taken.add(at)
        offsets[i] = at
        for x, value in rows[i].items():
            owners[at + x], values[at + x] = at, value
    return np.array(offsets), np.array(owners), np.array(values)


def read_symbols(texts: list, classes: np.ndarray):
    """Symbols of the texts in a row, and where each text's begin; class 0
    is the space, of which runs, and those before a text's first letter,
    read as one and as none."""
    low = [t.lower() if t else "" for t in texts]
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    bounds = np.concatenate(([0], np.cumsum([len(t) for t in low]))).astype(np.int64)
    symbols = classes[codes]
    keep = symbols != 0
    if len(symbols):
        after_letter = np.concatenate(([False], keep[:-1]))
        starts = bounds[:-1][bounds[:-1] < len(symbols)]
        after_letter[starts] = False
        keep = keep | after_letter
    total = np.concatenate(([0], np.cumsum(keep)))
    return symbols[keep], total[bounds]


class PhraseModel:
    """Automata of all languages; picklable."""

    def __init__(self, samples: list, sample_chars: int = SAMPLE_CHARS):
        by_lang: dict[str, list[str]] = {}
        for lang, text in samples:
            by_lang.setdefault(lang, []).append(text)
        self.langs = sorted(by_lang)
        joined = {l: " ".join(by_lang[l])[:sample_chars] for l in self.langs}
        self.letters = sorted({ch for t in joined.values() for ch in t.lower() if ch.isalpha()})
        self.scripts = sorted({script(ch) for ch in self.letters})
        self.width = len(self.letters) + 3         # space, letters, any other letter of a learned script, and of no such script
        self.other, self.foreign = self.width - 2, self.width - 1
        classes = self.classes()
        tables, starts, self.roots, sizes, base = [], [], [], [], 0
        for l in self.langs:
            symbols, _ = read_symbols([joined[l]], classes)
            auto = SuffixAutomaton()
            for s in symbols.tolist():
                auto.add(s)
            offsets, owners, values = place_rows(auto.next, self.width)
            target = offsets[values] + base
            # an entry is its owner's offset and its target's
            tables.append(np.where(owners >= 0, (owners + base) << 32 | target, -1))
            # where no transition exists the phrase ends and the symbol
            # begins the next one at the root, whose offset is 0
            here = tables[-1][:self.width]
            starts.append(np.where(owners[:self.width] == 0, here & 0x7FFFFFFF, base))
            self.roots.append(base)
            sizes.append(max(2, len(symbols)))
            base += len(owners)
            if base >= 1 << 31:
                raise ValueError("more languages than 31-bit offsets hold")
        self.table = np.concatenate(tables) if tables else np.zeros(0, np.int64)
        self.starts = np.stack(starts).astype(np.int32) if starts else np.zeros((0, self.width), np.int32)
        self.weights = np.log2(np.array(sizes, dtype=float))

    def classes(self) -> np.ndarray:
        """Symbol of each code point; letters not learned share one if their
        script is learned, and one otherwise."""
        letters = worker_state("letters", letters_table)
        names, at = worker_state("letter scripts", letter_scripts)
        learned = np.isin(np.array(names), self.scripts)
        out = np.where(letters, np.where(learned[at], self.other, self.foreign), 0).astype(np.uint16 if self.width < 1 << 16 else np.int32)
        out[[ord(ch) for ch in self.letters]] = np.arange(1, len(self.letters) + 1)
        return out

    def phrases(self, symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Phrases of each text in each language, ``(texts, languages)``."""
        length = np.diff(first)
        pieces = -(-length // SEGMENT)
        owner = np.repeat(np.arange(len(length)), pieces)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = first[:-1][owner] + nth * SEGMENT
        size = np.minimum(SEGMENT, first[1:][owner] - begin)
        order = np.argsort(-size, kind="stable")
        owner, begin, size = owner[order], begin[order], size[order]
        active = np.searchsorted(-size, -np.arange(SEGMENT), side="left")   # pieces longer than t
        out = np.zeros((len(length), len(self.langs)), dtype=np.int64)
        for a in range(0, len(self.langs), LANG_GROUP):
            group = slice(a, a + LANG_GROUP)
            np.add.at(out[:, group], owner, self._step(symbols, begin, size, active, group))
        return out

    def _step(self, symbols, begin, size, active, group: slice) -> np.ndarray:
        """Phrases of each piece in the languages of ``group``."""
        starts = np.ascontiguousarray(self.starts[group].T)              # by symbol
        lanes, langs = len(begin), starts.shape[1]
        state = np.tile(np.array(self.roots[group], dtype=np.int64), (lanes, 1))
        count = np.ones((lanes, langs), dtype=np.int32)
        spot, got, ends = np.empty_like(state), np.empty_like(state), np.empty(state.shape, dtype=bool)
        for t in range(int(size[0]) if lanes else 0):
            k = active[t]
            sym = symbols[begin[:k] + t]
            np.add(state[:k], sym[:, None], out=spot[:k])
            self.table.take(spot[:k], out=got[:k], mode="clip")
            np.right_shift(got[:k], 32, out=spot[:k])
            np.not_equal(spot[:k], state[:k], out=ends[:k])
            count[:k] += ends[:k]
            np.bitwise_and(got[:k], 0x7FFFFFFF, out=state[:k])
            np.copyto(state[:k], starts[sym], where=ends[:k])
        return count

    def predict(self, texts: list, classes: np.ndarray):
        """``(lang, score, phrases, phrase_length, known)`` lists for the
        texts; ``known`` where at least half of the letters are of scripts
        that occur in a sample."""
        symbols, first = read_symbols(texts, classes)
        n = np.diff(first)
        has_letter = n > 0
        if not self.langs:
            m = len(texts)
            return [UNKNOWN] * m, [0.0] * m, [0] * m, [0.0] * m, [False] * m
        counts = self.phrases(symbols, first)
        entropy = counts * self.weights / np.maximum(n, 1)[:, None]
        best = np.argmin(entropy, axis=1)
        at = np.arange(len(texts))
        least = entropy[at, best]
        if len(self.langs) > 1:
            entropy[at, best] = np.inf
            second = entropy.min(axis=1)
            score = np.where(has_letter, 1 - least / np.where(second > 0, second, 1), 0.0)
        else:
            score = has_letter.astype(float)
        won = counts[at, best]
        mean = np.where(has_letter, n / np.maximum(won, 1), 0.0)
        known = has_letter.copy()
        if len(symbols):
            begin = first[:-1][has_letter]         # the texts between have no symbols
            letters = np.add.reduceat(symbols != 0, begin, dtype=np.int64)
            known[has_letter] = 2 * np.add.reduceat(symbols == self.foreign, begin, dtype=np.int64) <= letters
        names = np.where(has_letter, np.array(self.langs, dtype=object)[best], UNKNOWN)
        return names.tolist(), np.clip(score, 0, 1).tolist(), np.where(has_letter, won, 0).tolist(), mean.tolist(), known.tolist()


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
        sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> PhraseModel:
    return PhraseModel(training_rows(docs, doc_id, text, lang, sample_docs, sample_chars), sample_chars)


def predict_column(model: PhraseModel, docs: DataFrame, text: str = "text") -> Column:
    """The prediction for each whole text as a struct column."""
    sent = docs.sparkSession.sparkContext.broadcast(vars(model))     # plain arrays and lists
    small_batches(docs.sparkSession)

    @F.arrow_udf(RESULT)
    def predict(column: pa.Array) -> pa.Array:
        held = PhraseModel.__new__(PhraseModel)
        held.__dict__ = sent.value
        classes = held.classes()
        texts = column.to_pylist()
        sizes = np.concatenate(([0], np.cumsum([len(t) if t else 0 for t in texts])))
        parts = [held.predict(texts[a:b], classes) for a, b in slices_by_size(sizes, BATCH_CHARS)]
        cols = [sum((p[k] for p in parts), []) for k in range(5)]
        return pa.StructArray.from_arrays(
            [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.int64()),
             pa.array(cols[3], pa.float64()), pa.array(cols[4], pa.bool_())],
            names=["lang_pred", "score", "phrases", "phrase_length", "known"])

    return predict(F.col(text))


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Language of every document, learned from the labelled rows that are
    not held out.  Other columns of ``docs`` are not read."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    model = fit(rows)
    return rows.select("doc_id", held_out().alias("held_out"), predict_column(model, rows).alias("p")).select(
        "doc_id", "held_out", "p.lang_pred", "p.score", "p.phrases", "p.phrase_length")


def keep_known(docs: DataFrame) -> DataFrame:
    """The documents in a language that is learned: those with no letter, or
    most of whose letters are of scripts that occur in no sample, go."""
    model = fit(docs)
    return docs.filter(predict_column(model, docs)["known"]) if model.langs else docs


def op1_language_id(spark, sf_dir):
    return identify(table(spark, sf_dir, "documents"))
