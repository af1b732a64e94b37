"""N-gram Jaccard join in metric space.

A document is the set of its distinct word shingles; ``1 - J`` is a metric.
Two documents link when ``J >= num / den``.  Equal sets are one class, and
classes are joined in three steps, exactly.

1. Families.  Linked sets differ in few shingles: with ``n`` the smaller
   size, in at most ``(den - num) * n / num``.  The shingles' universe is cut
   into more slices than that, so linked sets agree on a whole slice.  A set
   emits one signature per slice, in the table of its size class and, near
   the lower end of its class, in that of the class below.  An empty slice
   agrees with any other and gives no signature, unless so many of a set's
   slices are empty that a link could rest on those alone;
   only such sets emit them, and both ends of such a link are such sets.
   Linked sets agree on more slices than one, say ``a`` at least, so each
   set may leave out its ``a - 1`` commonest signatures: of the slices that
   two linked sets share, the rarest has ``a - 1`` commoner ones in both.
   Sets that share one of the others are tied to the least that has it;
   components of the ties are the families, and no link leaves a family.
2. Regions.  A family is joined in one task.  Beyond ``LEAF`` sets, pivots
   are taken, every set goes to the Voronoi region of its nearest pivot, and
   to each other region whose pivot is at most ``2 * radius`` farther (the
   triangle inequality's window: a partner may lie there); regions are
   joined recursively, down to leaves that are compared exactly, counting
   shared shingles by matrix products over blocks of shingles.  A family of
   more than ``FAMILY_CAP`` sets or ``FAMILY_SHINGLES`` shingles is dealt out
   in pairs of blocks.
3. Components of the links give each document the least ``doc_id`` that it
   reaches.

Cases: null and empty texts have no shingles and link with nothing; a text
of fewer words than a shingle is one shingle; sets are told apart by both of
their keys, so rows that repeat an id are each judged by their text and
answered each; rows without an id link like others, but their id names no
component; extra columns are not read; an
empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chorus.functions.bloom import BloomFilter
from chorus.llm.common import ByteHashes, mix64, slices_by_size, small_batches, table, utf8_buffers, word_bounds
from chorus.llm.components import connected_components
from chorus.plans.stage import stage

SHINGLE = 4
NUM, DEN = 85, 100
CLASS_RATIO = 0.6              # lower / upper size of a size class
LEAF = 12
PIVOTS = 8
FAMILY_CAP = 1000              # sets of a family that one task joins
FAMILY_SHINGLES = 1_500_000    # and their shingles: 12 MB
BLOCK_BYTES = 250_000          # of text whose shingles are hashed at a time, some fifty bytes held for each
TASK_SIGNATURES = 400_000      # signatures that a task counts, some 90 MB
BROADCAST_ROWS = 300_000       # rows of some eighty bytes that may be broadcast
MET = 200_000                  # sets a task remembers to spare their copies' signatures
NO_SIGNATURES = np.zeros(0, np.uint64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def doc_sets(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE):
    """The sorted distinct shingle hashes of each text in turn."""
    low = LOWER[data]
    starts, ends, first = word_bounds(low, offsets)
    words = ByteHashes(low).ranges(starts, ends)
    chain = None
    if len(words) >= k:
        chain = words[:len(words) - k + 1].copy()
        for i in range(1, k):
            chain = mix64(chain * np.uint64(3) + words[i:len(words) - k + 1 + i])
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= k:
            yield np.unique(chain[a:b - k + 1])
        elif b > a:
            h = np.array([b - a], dtype=np.uint64)
            for w in words[a:b]:
                h = mix64(h * np.uint64(5) + w)
            yield h
        else:
            yield words[:0]


def size_class(n: int) -> int:
    return int(math.log(n) / math.log(1 / CLASS_RATIO) + 1e-9)


class SliceTables:
    """For each size class ``j``: the largest size, how many shingles linked
    sets can differ in at most, and the number of slices."""

    def __init__(self, num: int = NUM, den: int = DEN):
        self.num, self.den = num, den
        self.rows: dict[int, tuple[int, int]] = {}

    def table(self, j: int) -> tuple[int, int]:
        if j not in self.rows:
            most = 1
            while size_class(most) <= j:                     # doubling, then bisection: sizes are monotone in class
                most *= 2
            lo, hi = most // 2, most
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (mid, hi) if size_class(mid) <= j else (lo, mid)
            differ = (self.den - self.num) * lo // self.num
            self.rows[j] = lo, differ + 3 + differ // 4
        return self.rows[j]

    def signatures(self, s: np.ndarray) -> tuple[np.ndarray, int]:
        """Signatures, whose last bit tells the table, and by table how many
        of the commonest the set may leave out (16 bits each)."""
        n, drops = len(s), 0
        own = (self.den - self.num) * n // self.num          # differences to a set no smaller than this
        j = size_class(n) if n else 0
        out = []
        for t in (j, j - 1):
            if not n or t < 0:
                continue
            most, slices = self.table(t)
            if (self.den - self.num) * most // self.num == 0 or (t < j and self.num * n > self.den * most):
                continue
            part = (mix64(s ^ np.uint64(0x51ED27 + t)) % np.uint64(slices)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            sorted_part = part[order]
            at = np.flatnonzero(np.concatenate(([True], sorted_part[1:] != sorted_part[:-1])))
            total = np.add.reduceat(mix64(s[order] + np.uint64(1)), at)
            used = sorted_part[at]
            out.append(self._named(t, used, total))
            agree = slices - min(own, (self.den - self.num) * most // self.num)      # slices that a linked set shares, at least
            empty = slices - len(used)
            drops |= min(max(0, agree - 1 - empty), 0x7FFF) << (16 * (t & 1))
            if empty >= agree:                           # lonely: links may rest on empty slices alone
                empty = np.setdiff1d(np.arange(slices), used)
                out.append(self._named(t, empty, np.zeros(len(empty), np.uint64)))
        return np.concatenate(out) if out else np.zeros(0, np.uint64), drops

    @staticmethod
    def _named(t: int, part: np.ndarray, total: np.ndarray) -> np.ndarray:
        name = mix64(total ^ mix64((np.uint64(t) << np.uint64(32)) + part.astype(np.uint64)))
        return name & ~np.uint64(1) | np.uint64(t & 1)


def set_keys(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit names of a set."""
    a = int(mix64(np.array([mix64(s).sum(dtype=np.uint64) + np.uint64(len(s))])).view(np.int64)[0])
    return a, int(mix64(s ^ np.uint64(0xA5A5A5A5)).sum(dtype=np.uint64).astype(np.int64))


def sketch(k: int, num: int, den: int):
    """``doc_id, text_hash, n, k1, k2, drops, named, sigs`` of each text, with
    ``named`` the number of signatures; keys are null without words.  A set that the task has met gives its signatures no
    second time (``MET`` sets are remembered), so a group of copies, however
    large, gives some rows a task."""

    def run(batches):
        tables, met = SliceTables(num, den), set()
        for batch in batches:
            data, offsets = utf8_buffers(batch.column("text"))
            n, k1, k2, drops, sigs = [], [], [], [], []
            for a, b in slices_by_size(offsets, BLOCK_BYTES):
                for s in doc_sets(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], k):
                    n.append(len(s))
                    key = set_keys(s) if len(s) else (None, None)
                    k1.append(key[0])
                    k2.append(key[1])
                    if key in met:
                        named, most = NO_SIGNATURES, None
                    else:
                        named, most = tables.signatures(s)
                        if len(met) >= MET:
                            met.clear()
                        met.add(key)
                    drops.append(most)
                    sigs.append(named.view(np.int64))
            ends = np.cumsum([0] + [len(x) for x in sigs])
            flat = np.concatenate(sigs) if sigs else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()),
                 pa.array(drops, pa.int32()), pa.array(np.diff(ends), pa.int32()),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))],
                names=["doc_id", "text_hash", "n", "k1", "k2", "drops", "named", "sigs"])

    return run


def member_sets(k: int):
    """The sets of the documents that stand for their classes."""

    def run(batches):
        for batch in batches:
            data, offsets = utf8_buffers(batch.column("text"))
            sets = []
            for a, b in slices_by_size(offsets, BLOCK_BYTES):
                sets.extend(doc_sets(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], k))
            keys = [set_keys(s) for s in sets]
            same = np.array([(x, y) == z for x, y, z in zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), keys)], dtype=bool)
            at = pa.array(np.flatnonzero(same))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(at) for c in ("family", "i", "j", "block", "cls", "size")]
                + [pa.array([sets[r].tobytes() for r in np.flatnonzero(same)], pa.binary())],
                names=["family", "i", "j", "block", "cls", "size", "shingles"])

    return run


class RegionJoin:
    """All links among the sets of one family."""

    def __init__(self, sets: list[np.ndarray], num: int = NUM, den: int = DEN):
        self.num, self.den = num, den
        self.size = np.array([len(s) for s in sets])
        flat = np.concatenate(sets)
        self.element = np.unique(flat, return_inverse=True)[1]
        self.first = np.concatenate(([0], np.cumsum(self.size)))
        self.width = int(self.element.max(initial=-1)) + 1
        self.linked = np.zeros((len(sets), len(sets)), dtype=bool)
        self.regions = 0                      # regions that pivots cut out
        self.join(np.arange(len(sets)))
        np.fill_diagonal(self.linked, False)

    def _elements(self, docs: np.ndarray):
        """``(element, place in docs)`` of the sets of ``docs``."""
        size = self.size[docs]
        place = np.repeat(np.arange(len(docs)), size)
        nth = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        return self.element[self.first[docs][place] + nth], place

    def join(self, docs: np.ndarray) -> None:
        if len(docs) > LEAF:
            order = docs[np.argsort(self.size[docs], kind="stable")]
            pivots = order[np.linspace(0, len(order) - 1, PIVOTS).astype(int)]
            distance = np.stack([self._distance(p, docs) for p in pivots])
            window = distance - distance.min(axis=0) <= 2 * (self.den - self.num) / self.den + 1e-9
            regions = {r.tobytes(): r for r in (docs[w] for w in window)}.values()
            if sum(len(r) ** 2 for r in regions) < 0.7 * len(docs) ** 2:
                self.regions += len(regions)
                for r in regions:
                    self.join(r)
                return
        self._leaf(docs)

    def _distance(self, pivot: int, docs: np.ndarray) -> np.ndarray:
        inside = np.zeros(self.width, dtype=bool)
        inside[self.element[self.first[pivot]:self.first[pivot + 1]]] = True
        element, place = self._elements(docs)
        shared = np.bincount(place, weights=inside[element], minlength=len(docs))
        return 1 - shared / (self.size[docs] + self.size[pivot] - shared)

    def _leaf(self, docs: np.ndarray) -> None:
        element, place = self._elements(docs)
        often = np.bincount(element, minlength=self.width)
        keep = often[element] > 1
        name = np.cumsum(often > 1) - 1
        column, place = name[element[keep]], place[keep]
        m, width = len(docs), int((often > 1).sum())
        shared = np.zeros((m, m), dtype=np.float32)
        order = np.argsort(column, kind="stable")
        column, place = column[order], place[order]
        for a in range(0, width, 2048):
            lo, hi = np.searchsorted(column, (a, a + 2048))
            x = np.zeros((m, min(2048, width - a)), dtype=np.float32)
            x[place[lo:hi], column[lo:hi] - a] = 1
            shared += x @ x.T
        size = self.size[docs]
        hit = self.den * shared.astype(np.int64) >= self.num * (size[:, None] + size[None, :] - shared.astype(np.int64))
        self.linked[np.ix_(docs, docs)] |= hit

    def roots(self, names: np.ndarray) -> np.ndarray:
        """The least name in each set's component."""
        out, todo = np.zeros(len(names), dtype=np.int64), np.ones(len(names), dtype=bool)
        for s in np.argsort(names, kind="stable"):
            if todo[s]:
                group = np.zeros(len(names), dtype=bool)
                front = np.zeros(len(names), dtype=bool)
                front[s] = True
                while front.any():
                    group |= front
                    front = self.linked[front].any(axis=0) & ~group
                out[group], todo[group] = names[s], False
        return out


LINKS = "cls bigint, root bigint, links bigint, regions bigint"


def join_families(num: int, den: int):
    """Joins the families of a task, which come one after another; yields
    ``cls, root, links, regions``: of each class the least class that it
    reaches here, the documents linked outside it, and in how many regions
    its family was joined (0: as one leaf; told once a family)."""

    def answer(key, block, cls, size, sets):
        names, at = np.unique(np.array(cls), return_index=True)          # rows that repeat id and text come twice
        if len(names) < 2:
            return names.tolist(), names.tolist(), [0] * len(names), [0] * len(names)
        block, size = np.array(block)[at], np.array(size)[at]
        join = RegionJoin([np.frombuffer(sets[i], dtype=np.uint64) for i in at], num, den)
        if key[1] != key[2]:
            join.linked &= block[:, None] != block[None, :]
        return names.tolist(), join.roots(names).tolist(), (join.linked @ size).tolist(), [join.regions] + [0] * (len(names) - 1)

    def batch_of(cols):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["cls", "root", "links", "regions"])

    def run(batches):
        key, held = None, ([], [], [], [])
        for batch in batches:
            out = ([], [], [], [])
            cols = [batch.column(c).to_pylist() for c in ("family", "i", "j", "block", "cls", "size", "shingles")]
            for family, i, j, *rest in zip(*cols):
                if (family, i, j) != key:
                    if key is not None:
                        for o, x in zip(out, answer(key, *held)):
                            o.extend(x)
                    key, held = (family, i, j), ([], [], [], [])
                for h, x in zip(held, rest):
                    h.append(x)
            yield batch_of(out)
        if key is not None:
            yield batch_of(answer(key, *held))

    return run


SKETCH = "doc_id bigint, text_hash bigint, n bigint, k1 bigint, k2 bigint, drops int, named int, sigs array<bigint>"


def classes_of(seen: DataFrame) -> DataFrame:
    """A row per distinct set: ``cls`` (its number), keys, the id and text
    hash of the row that stands for it (the least id; null ones last), how
    many documents and shingles it has."""
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    out = seen.filter("k1 is not null").groupBy("k1", "k2").agg(F.min(row).alias("r"), F.count("*").alias("size"), F.first("n").alias("n"))
    return out.select(F.monotonically_increasing_id().alias("cls"), "k1", "k2", F.col("r.doc_id").alias("rep"),
                      F.col("r.text_hash").alias("rep_hash"), "size", "n")


def tied_sets(seen: DataFrame) -> DataFrame:
    """``k1, lo``: sets that share a signature are tied to the least of them;
    each set leaves out its commonest signatures, as many as it may.

    Most signatures are found in one set only.  They are moved once, to count
    them, in as many tasks as hold ``TASK_SIGNATURES`` each; the shared ones
    go into a Bloom filter, and only rows that pass it are moved again to
    meet their signature's count."""
    total = seen.agg(F.coalesce(F.sum("named"), F.lit(0))).first()[0]
    named = seen.filter("named > 0").select("k1", F.explode("sigs").alias("sig"))
    least = named.repartition(max(1, -(-total // TASK_SIGNATURES)), "sig").groupBy("sig").agg(F.min("k1").alias("lo"), F.max("k1").alias("hi"), F.count("*").alias("n"))
    least = stage(least.filter("lo < hi").select("sig", "lo", "n"), "shared-signatures")
    shared = named.filter(BloomFilter.of(least, "sig").may_hold("sig")).join(least, "sig").distinct()
    may = seen.filter("k1 is not null").groupBy("k1").agg(F.min("drops").alias("drops"))
    in_table = Window.partitionBy("k1", F.col("sig").bitwiseAND(1)).orderBy(F.desc("n"), "sig")
    shared = shared.join(may, "k1").withColumn("nth", F.row_number().over(in_table))
    drop = F.when(F.col("sig").bitwiseAND(1) == 1, F.shiftright("drops", 16)).otherwise(F.col("drops").bitwiseAND(0x7FFF))
    return shared.filter((F.col("nth") > drop) & (F.col("k1") > F.col("lo"))).select("k1", "lo").distinct()


def joined_families(rows: DataFrame, classes: DataFrame, ties: DataFrame, shingle: int, num: int, den: int, family_cap: int) -> DataFrame:
    """``LINKS`` of every class in a family, joined family by family."""
    families = connected_components(ties, "k1", "lo")
    members = classes.join(families, F.col("k1") == F.col("node")).select(
        "cls", "k1", "k2", "rep", "rep_hash", "size", "n", F.col("root").alias("family"))
    members = stage(members, "members")
    sizes = members.groupBy("family").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles"))
    blocks = F.greatest(F.ceil(F.col("sets") * 2 / family_cap), F.ceil(F.col("shingles") * 2 / FAMILY_SHINGLES)).cast("int")
    sizes = sizes.filter((F.col("sets") > family_cap) | (F.col("shingles") > FAMILY_SHINGLES)).select("family", blocks.alias("blocks"))
    dealt = members.join(sizes, "family", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = dealt.select("family", "cls", "k1", "k2", "rep", "rep_hash", "size", "block", other).select(
        "family", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "cls", "k1", "k2", "rep", "rep_hash", "size")
    few = members.count() <= BROADCAST_ROWS
    match = rows["doc_id"].eqNullSafe(F.col("rep")) & (rows["text_hash"] == F.col("rep_hash"))
    got = rows.join(F.broadcast(dealt) if few else dealt, match).select("family", "i", "j", "block", "cls", "k1", "k2", "size", "text")
    sets = got.mapInArrow(member_sets(shingle), "family bigint, i int, j int, block int, cls bigint, size bigint, shingles binary")
    sets = sets.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j")
    return stage(sets.mapInArrow(join_families(num, den), LINKS), "links")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                    num: int = NUM, den: int = DEN, family_cap: int = FAMILY_CAP) -> DataFrame:
    """``doc_id, n_shingles, component_id, class_size, n_links`` of every
    document; ``n_links`` counts the documents it links with."""
    small_batches(docs.sparkSession)
    t = F.col(text)
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(t).alias("text_hash"), t.alias("text"))
    seen = stage(rows.mapInArrow(sketch(shingle, num, den), SKETCH), "sketch")
    classes = stage(classes_of(seen), "classes")
    ties = stage(tied_sets(seen), "ties")
    found = joined_families(rows, classes, ties, shingle, num, den, family_cap)
    # a class in several blocks has a root in each: components of them all
    roots = connected_components(found.filter("cls <> root"), "cls", "root")
    grouped = classes.join(roots.select(F.col("node").alias("cls"), F.col("root").alias("of")), "cls", "left")
    grouped = grouped.withColumn("of", F.coalesce("of", "cls"))
    least = grouped.groupBy("of").agg(F.min("rep").alias("component_id"))
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    known = grouped.join(least, "of").join(links, "cls", "left").select(
        "k1", "k2", "component_id", F.col("size").alias("class_size"), F.coalesce("links", F.lit(0)).alias("links"))
    out = seen.select("doc_id", "n", "k1", "k2").join(known, ["k1", "k2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"),
                      F.coalesce("class_size", F.lit(1)).alias("class_size"),
                      (F.coalesce("class_size", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
             num: int = NUM, den: int = DEN) -> DataFrame:
    """The documents, of each group that links reach only the one with the
    least id.  Where rows repeat an id, it stays if one of them stays."""
    judged = near_duplicates(docs, doc_id, text, shingle, num, den).filter("doc_id is not null")
    drop = judged.groupBy(F.col("doc_id").alias("_drop_id")).agg(F.min(F.col("component_id") != F.col("doc_id")).alias("gone"))
    drop = stage(drop.filter("gone").select("_drop_id"), "drop")
    few = drop.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(drop) if few else drop, F.col(doc_id) == F.col("_drop_id"), "left_anti")


def op10_jaccard_join(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
