import random
from collections import Counter

import pytest

from weftline.operators import orphans
from weftline.plans import registry

SCHEMA = "path long, file_hash long, source_hash long"


def shuffled_rows(spark):
    context = spark.sparkContext
    context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(spark._jvm.double, 0), None)
    return {stages.apply(k).stageId(): stages.apply(k).shuffleWriteRecords() for k in range(stages.size())}


def table(spark, files):
    return spark.createDataFrame([(p, f, h) for p, f, hs in files for h in (hs or [None])], SCHEMA)


def test_a_hash_of_all_files_makes_no_pairs_of_all_files(spark):
    """Each file has three hashes of its own besides one that all have; before, all 250,000 pairs were shuffled."""
    make = lambda base: [(base + k, base + k, [0, *(base * 10 + 3 * k + j for j in range(3))]) for k in range(500)]
    new, old = make(10_000), make(20_000)
    old.append((30_000, 1, new[7][2][:3]))
    before = set(shuffled_rows(spark))
    assert [(r.path, r.orphan_path, r.overlap) for r in orphans.overlaps(table(spark, new), table(spark, old)).collect()] == [(10_007, 30_000, 0.75)]
    assert sum(n for k, n in shuffled_rows(spark).items() if k not in before) < 100_000


@pytest.mark.parametrize("seed", range(2))
def test_overlaps_equal_counts_of_all_pairs(spark, monkeypatch, seed):
    monkeypatch.setattr(orphans, "PART", 3)
    rnd = random.Random(seed)
    make = lambda base: [(base + k, k, [min(rnd.randrange(30), rnd.randrange(30)) for _ in range(rnd.randint(0, 9))]) for k in range(60)]
    new, old = make(100), make(500)
    want = {(p, q): len(set(a) & set(b)) / len(set(a)) for p, _, a in new for q, _, b in old if a and len(set(a) & set(b)) >= orphans.OVERLAP * len(set(a))}
    got = orphans.overlaps(table(spark, new), table(spark, old)).collect()
    assert {(r.path, r.orphan_path): r.overlap for r in got} == want and len(got) == len(want)


def test_claims_go_on_behind_the_first_wishes(spark, monkeypatch):
    """All want the same orphans, in the same order; with one wish at first most files wait, and take from later ones what those have had."""
    monkeypatch.setattr(orphans, "WISHES", 1)
    rnd = random.Random(5)
    new = [(k, k + 1000, rnd.sample(range(4), rnd.randint(1, 3))) for k in range(50)]
    old = [(500 + k, rnd.randrange(1000, 1100), rnd.sample(range(5), rnd.randint(1, 4))) for k in range(45)]
    want, taken = {}, set()
    for p, f, hs in new:
        shares = {q: len(set(hs) & set(ks)) / len(hs) for q, _, ks in old}
        wishes = sorted((f != g, -1.0 if f == g else -shares[q], q) for q, g, _ in old if (f == g or shares[q] >= orphans.OVERLAP) and q not in taken)
        if wishes:
            want[p] = wishes[0][2]
            taken.add(want[p])
    got = orphans.match_orphans(table(spark, new), table(spark, old)).collect()
    assert {r.path: r.orphan_path for r in got} == want and len(want) > 30 and max(Counter(r.orphan_path for r in got).values()) == 1


def test_files_without_segments(spark, tmp_path):
    """Blank texts share no hash, and a null text equals nothing; both as in the SQL."""
    docs = spark.createDataFrame([(1, "  "), (2, "  "), (3, None), (4, None), (5, "Same."), (6, "Same.")], "doc_id long, text string").selectExpr("*", "'en' AS lang")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: [tuple(r) for r in registry.queries()[name](spark, str(tmp_path)).collect()]
    assert run("orphan_overlap") == [(5, 6, 1.0)]
    assert sorted(run("match_orphans")) == [(1, 2), (5, 6)]
