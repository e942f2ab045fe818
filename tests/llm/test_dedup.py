import random

import pytest

from graphloom.llm import exact_dedup, near_dedup, substring_dedup
from graphloom.llm.components import connected_components

from . import brute
from .conftest import ODD, prose


def distinct_ids(rows):
    seen = {}
    for i, t in rows:
        if i is not None:
            seen.setdefault(i, t)
    return sorted(seen.items())


def test_exact_against_brute_force(docs_of):
    rows = distinct_ids(ODD) + [(100 + k, "copy  of\na text" if k % 2 else "copy of a\ttext") for k in range(40)]
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(docs_of(rows, extra=True)).collect()}
    assert got == brute.exact(rows)


def test_exact_with_few_counters_gives_the_same(docs_of):
    rows = [(k, f"text {k % 7}") for k in range(200)]
    a, b = ({tuple(r) for r in exact_dedup.exact_dedup(docs_of(rows), k=k).collect()} for k in (2, 1024))
    assert a == b and sum(x[3] for x in a) == 7


def test_exact_keeps_one_of_repeated_rows_and_takes_nulls_last(docs_of):
    out = exact_dedup.exact_dedup(docs_of(ODD)).collect()
    assert len(out) == len(ODD)
    by = {}
    for r in out:
        by.setdefault(r.text_sha256, []).append(r)
    assert all(sum(r.kept for r in g) == 1 for g in by.values())
    assert sorted(r.keep_id for r in out if r.doc_id is None) == [1, 7]
    kept = exact_dedup.keep_first(docs_of(ODD, extra=True))
    assert kept.count() == len(by) and len(kept.columns) > 20


def test_misra_gries_finds_frequent_items(spark):
    r = random.Random(3)
    items = ["hot"] * 400 + ["warm"] * 250 + [str(r.random()) for _ in range(600)]
    r.shuffle(items)
    df = spark.createDataFrame([(x,) for x in items], "x string").repartition(5)
    assert {"hot", "warm"} <= set(exact_dedup.heavy_candidates(df, "x", k=10))
    assert exact_dedup.misra_gries(df, "x", 10).count() <= 50


@pytest.mark.parametrize("size, percent", [(3, 85), (5, 80)])
def test_near_against_brute_force(docs_of, size, percent):
    r = random.Random(size)
    rows = distinct_ids(ODD)
    for k in range(30):
        base = prose(100 + k, 80).split()
        for m in range(6):
            w = list(base)
            for _ in range(m * 2 if k % 3 else m):
                w[r.randrange(len(w))] = f"w{r.randrange(10**6)}"
            rows.append((1000 + 10 * k + m, " ".join(w)))
    rows += [(5000 + k, prose(999, 60) if k % 2 else prose(999, 60).upper()) for k in range(20)]
    out = near_dedup.near_duplicates(docs_of(rows, extra=True), size, percent).collect()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in out}
    assert got == brute.components(rows, size, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_near_when_a_keys_first_document_is_not_similar(docs_of, monkeypatch):
    """A chain in which the first document is like few others: links have to be found across a key's components."""
    base = [f"t{k}" for k in range(200)]
    rows = []
    for k in range(40):
        w = list(base)
        w[0 : 3 * k] = [f"c{k}x{j}" for j in range(3 * k)]
        rows.append((k, " ".join(w)))
        rows.append((100 + k, " ".join([*w, "end"])))
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    monkeypatch.setattr(near_dedup, "FAMILY_BLOCK", 9)
    out = near_dedup.near_duplicates(docs_of(rows), 3, 85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute.components(rows, 3, 85)


def test_near_in_a_star_whose_centre_is_last(docs_of, monkeypatch):
    """Copies are like the original, which has the largest id, and mostly not like each other."""
    r = random.Random(8)
    monkeypatch.setattr(near_dedup, "BLOCK", 30)
    monkeypatch.setattr(near_dedup, "FAMILY_BLOCK", 20)
    base = [f"t{k}" for k in range(100)]
    rows = [(1000, " ".join(base))]
    for k in range(90):
        w = list(base)
        for _ in range(2 + k % 3):
            w[r.randrange(len(w))] = f"x{r.random()}"
        rows.append((k, " ".join(w)))
    out = near_dedup.near_duplicates(docs_of(rows), 5, 80).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute.components(rows, 5, 80)


def test_shared_counts():
    import numpy as np

    r = random.Random(2)
    sets = [np.unique(np.array([r.randrange(300) for _ in range(r.randrange(1, 90))], np.uint64)) for _ in range(40)]
    got = near_dedup.shared_counts(sets, width=16)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(40) for j in range(40) if i != j)


@pytest.mark.parametrize("n, size", [(0, 26), (5, 26), (1_500_000, 27)])
def test_filters_have_all_their_keys(spark, n, size):
    import numpy as np

    from graphloom.llm import filters

    bits = filters.key_filter(spark.range(0, 3 * n, 3).withColumnRenamed("id", "doc"), "doc")
    keys = np.arange(3 * n)
    passed = filters.has(bits, keys)
    assert passed[::3].all() and (n == 0 or passed.mean() < 1 / 3 + 0.02) and size == (len(bits) * 64 - 1).bit_length()


def test_near_of_repeated_and_null_ids(docs_of):
    out = near_dedup.near_duplicates(docs_of(ODD), 3, 85)
    assert out.count() == len(ODD)
    kept = near_dedup.keep_one(docs_of(ODD, extra=True))
    assert kept.columns[:2] == ["doc_id", "text"] and kept.count() < len(ODD)


def test_components_of_a_long_chain(spark):
    n = 300
    links = spark.createDataFrame([(k, k + 1) for k in range(n)] + [(1000, 1001), (5, 5)], "a long, b long")
    got = {r.doc: r.component for r in connected_components(links).collect()}
    assert got == {**{k: 0 for k in range(n + 1)}, 1000: 1000, 1001: 1000}


@pytest.mark.parametrize("batches, heavy", [(1, 1024), (2, 1), (3, 5), (3, 1024)])
def test_substrings_against_brute_force(docs_of, batches, heavy, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HEAVY", heavy)
    r = random.Random(batches)
    passages = [prose(500 + k, 20 + 7 * k) for k in range(8)]
    rows = distinct_ids(ODD)
    for k in range(60):
        parts = [prose(2000 + k, r.randrange(5, 60))]
        for _ in range(r.randrange(3)):
            p = r.choice(passages).split()
            a = r.randrange(len(p))
            parts += [" ".join(p[a : a + r.randrange(10, 60)]), prose(3000 + k, r.randrange(0, 30))]
        rows.append((100 + k, " \n".join(parts)))
    rows += [(900 + k, "again " * (15 + k)) for k in range(10)]
    out = substring_dedup.remove_repeats(docs_of(rows, extra=True), batches=batches).collect()
    want = {i: (len(w), len(w) - len(k), brute.sha(" ".join(k))) for i, (w, k) in brute.without_repeats(rows).items()}
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in out} == want


def test_index_compacts_its_runs(spark, docs_of, monkeypatch):
    """So that a batch meets a compacted run."""
    monkeypatch.setattr(substring_dedup, "MAX_RUNS", 1)
    made, init = [], substring_dedup.FingerprintIndex.__init__
    monkeypatch.setattr(substring_dedup.FingerprintIndex, "__init__", lambda self, *a, **k: (made.append(self), init(self, *a, **k))[1])
    rows = [(k, prose(k % 5, 60)) for k in range(60)]
    want = {i: len(w) - len(k) for i, (w, k) in brute.without_repeats(rows).items()}
    out = substring_dedup.remove_repeats(docs_of(rows), batches=(0.05, 0.15, 0.6)).collect()
    assert {r.doc_id: r.n_removed for r in out} == want and made[-1].compacted == 3


def test_index_is_opened_again(spark, tmp_path):
    from pyspark.sql import functions as F

    shared = prose(77, 50)
    rows = [(k, f"{prose(k, 30)} {shared if k % 3 == 0 else ''} {prose(k + 100, 30)}") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc long, text string").select("doc", F.col("text").cast("binary").alias("text"))
    first, second = docs.where("doc < 20"), docs.where("doc >= 20")
    index = substring_dedup.FingerprintIndex(spark, path=str(tmp_path / "index"))
    index.add(first)
    index.save()
    index.drop()
    again = substring_dedup.FingerprintIndex.open(spark, str(tmp_path / "index"), first)
    found = {r.doc for r in again.add(second).collect()}
    again.drop()
    assert found == {k for k in range(20, 40) if k % 3 == 0}


def test_substrings_of_repeated_and_null_ids(docs_of):
    out = substring_dedup.remove_repeats(docs_of(ODD))
    assert out.count() == len(ODD)
    cut = substring_dedup.cut_repeats(docs_of(ODD, extra=True))
    assert cut.count() == len(ODD) and len(cut.columns) > 20
    assert all(len(r.text) == r.n_chars for r in cut.where("text IS NOT NULL").select("text", "n_chars").collect())


@pytest.mark.parametrize("run", [lambda d: exact_dedup.exact_dedup(d), lambda d: near_dedup.near_duplicates(d), lambda d: substring_dedup.remove_repeats(d), lambda d: exact_dedup.keep_first(d), lambda d: near_dedup.keep_one(d), lambda d: substring_dedup.cut_repeats(d)])
def test_empty_table(docs_of, run):
    assert run(docs_of([])).count() == 0
