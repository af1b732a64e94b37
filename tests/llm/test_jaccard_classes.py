"""Jaccard join: rows that repeat or lack an id, and regions that pivots cut."""

import random

import numpy as np

from chorus.llm import jaccard_join as J

SCHEMA = "doc_id long, text string, rep string, cls string, k1 string, text_hash string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "a", "b", "c", "d") for i, t in rows], SCHEMA)


def near(rng, base, changes):
    w = list(base)
    for _ in range(changes):
        w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
    return " ".join(w)


def test_rows_that_repeat_an_id_are_each_judged(spark):
    rng = random.Random(2)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    a, a2, b = near(rng, base, 0), near(rng, base, 1), near(rng, base, 1)
    other = " ".join(f"o{i}" for i in range(80))
    rows = [(7, a), (7, a2), (9, b), (7, a), (5, other), (5, "quite another text of some words here")]
    got = sorted((r.doc_id, r.component_id, r.n_links) for r in J.near_duplicates(docs_of(spark, rows)).collect())
    assert got == [(5, 5, 0), (5, 5, 0), (7, 7, 3), (7, 7, 3), (7, 7, 3), (9, 7, 3)]


def test_links_through_a_repeated_id_are_not_lost(spark):
    """B links with the second text of id 7 only."""
    rng = random.Random(3)
    left = " ".join(f"l{i}" for i in range(100))
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    got = {(r.doc_id, r.component_id) for r in J.near_duplicates(docs_of(spark, [(7, left), (7, near(rng, base, 0)), (9, near(rng, base, 1))])).collect()}
    assert got == {(7, 7), (9, 7)}


def test_rows_without_an_id_link(spark):
    rng = random.Random(4)
    base = [f"w{rng.randrange(500)}" for _ in range(150)]
    rows = [(None, near(rng, base, 0)), (None, near(rng, base, 1)), (3, near(rng, base, 1)), (8, near(rng, base, 1)), (None, "alone with these words")]
    got = sorted(((r.doc_id, r.component_id, r.n_links) for r in J.near_duplicates(docs_of(spark, rows)).collect()), key=str)
    assert got == sorted([(3, 3, 3), (8, 3, 3), (None, 3, 3), (None, 3, 3), (None, None, 0)], key=str)


def test_pivots_cut_regions(spark):
    """A family of clusters that chance ties hold together is cut by pivots,
    and the links are those of all pairs."""
    rng = np.random.default_rng(1)
    sets, common = [], rng.integers(0, 2**60, 60)
    for c in range(6):
        core = np.concatenate([common, rng.integers(0, 2**60, 200 + 10 * c)])
        for _ in range(9):
            s = core.copy()
            s[rng.integers(60, len(s), 4)] = rng.integers(0, 2**60, 4)
            sets.append(np.unique(s).astype(np.uint64))
    join = J.RegionJoin(sets, 85, 100)
    want = [[i != j and 100 * len(np.intersect1d(a, b)) >= 85 * len(np.union1d(a, b)) for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    assert (join.linked == np.array(want)).all()
    assert join.regions >= 6


def test_regions_on_the_given_documents(spark):
    """Families of the given tables are joined in regions, or are too alike
    (or too small) for a pivot to part them; both are counted."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = docs.select("doc_id", J.F.xxhash64("text").alias("text_hash"), "text")
    seen = J.stage(rows.mapInArrow(J.sketch(4, 85, 100), J.SKETCH), "sketch")
    classes = J.stage(J.classes_of(seen), "classes")
    found = J.joined_families(rows, classes, J.stage(J.tied_sets(seen), "ties"), 4, 85, 100, J.FAMILY_CAP)
    got = found.agg(J.F.count("*").alias("sets"), J.F.sum("links").alias("links"), J.F.sum("regions").alias("regions")).first()
    assert got.sets > 100 and got.links > 100
    print("sets in families", got.sets, "regions", got.regions)


def test_signatures_are_counted_in_tasks_of_bounded_size(spark, monkeypatch):
    """As many tasks as the signatures need, whatever the session's shuffle
    partitions, and the same groups."""
    rng = random.Random(6)
    bases = [[f"w{rng.randrange(500)}" for _ in range(150)] for _ in range(8)]
    docs = docs_of(spark, [(10 * i + k, near(rng, base, k)) for i, base in enumerate(bases) for k in range(3)]).cache()
    whole = sorted(map(tuple, J.near_duplicates(docs).collect()))
    tasks, total, stage = {}, [], J.stage

    def watched(df, name):
        if name == "shared-signatures":
            tasks[name] = df.rdd.getNumPartitions()
        out = stage(df, name)
        if name == "sketch":
            total.append(out.agg(J.F.sum(J.F.size("sigs"))).first()[0])
        return out

    monkeypatch.setattr(J, "TASK_SIGNATURES", 50, raising=False)
    monkeypatch.setattr(J, "stage", watched)
    assert sorted(map(tuple, J.near_duplicates(docs).collect())) == whole
    assert tasks["shared-signatures"] == -(-total[0] // 50) > 8
