import random
import re
import time

import numpy as np
import pytest

from weftline.llm import common, embedding_dedup, line_dedup, minhash_dedup
from weftline.llm.linking import components


def roots(n, pairs):
    up = list(range(n))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return [top(i) for i in range(n)]


@pytest.mark.parametrize("shape", ["chain", "random", "none"])
def test_components(spark, shape):
    rnd = random.Random(1)
    n = 60
    links = {"chain": [(i, i + 1) for i in range(n - 1)], "star": [(7, i) for i in range(n)], "random": [(rnd.randrange(n), rnd.randrange(n)) for _ in range(40)], "none": []}[shape]
    rnd.shuffle(links)
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = roots(n, links)
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {i: want[i] for i in linked}


def word_sets(texts, k):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    out = []
    for t in texts:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").translate(lower)) if x]
        out.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    return out


@pytest.mark.parametrize("words", [2])
def test_documents_against_brute_force(spark, words):
    rnd = random.Random(words)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [None, "", " \n\t", "One", "one", "one two", "ONE  two", "é\x0btwo", "\x85"]
    for _ in range(12):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randint(20, 200))]
        for _ in range(rnd.choice([1, 3, 25])):
            copy = list(base)
            for _ in range(rnd.randint(0, max(1, len(base) // 12))):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
            texts.append(" ".join(copy))
    shared = " ".join(rnd.choice(vocabulary) for _ in range(60))
    texts += [shared + " " + " ".join(rnd.choice(vocabulary) for _ in range(60)) for _ in range(30)]
    texts += ["same text over and over again"] * 40 + ["long " * 60_000]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, rep int, component string").repartition(4)
    sets = word_sets(texts, words)
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    want = roots(len(sets), pairs)
    got = {r.doc_id: r for r in minhash_dedup.near_duplicates(docs, words).collect()}
    assert len(got) == len(texts)
    assert [got[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]
    assert [got[i].component_id for i in range(len(texts))] == want
    assert all(r.kept == (r.component_id == r.doc_id) for r in got.values())
    kept = minhash_dedup.keep_one(docs, words)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want))


def test_blocks_of_a_large_bucket(spark, monkeypatch):
    # one bucket for all, compared in blocks of four: no link is lost
    from weftline.llm import linking

    monkeypatch.setattr(linking, "BLOCK", 4)
    # four chains, each text linked to the next only
    texts = [" ".join(f"v{i // 8 * 100 + i % 8 * 3 + k}" for k in range(40)) for i in range(32)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    signed = minhash_dedup.sign
    monkeypatch.setattr(minhash_dedup, "sign", lambda d, w: signed(d, w).selectExpr("doc_id", "version", "n_shingles", "low", "high", "array(0L) as bands", "X'0000000000000000' as packed", "planes"))
    sets = word_sets(texts, 5)
    pairs = [(i, j) for i in range(32) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    want = roots(32, pairs)
    assert len(set(want)) == 4 and len(pairs) == 28
    assert [r.component_id for r in minhash_dedup.near_duplicates(docs).orderBy("doc_id").collect()] == want


def test_blocks_about_the_threshold(spark, monkeypatch):
    # a large group of near copies of which few are links, and rows of one doc_id
    from weftline.llm import linking

    monkeypatch.setattr(linking, "BLOCK", 16)
    rnd = random.Random(4)
    base = [f"w{k}" for k in range(80)]
    texts = []
    for _ in range(150):
        words = list(base)
        for k in rnd.sample(range(80), rnd.randint(1, 4)):
            words[k] = f"x{rnd.random()}"
        texts.append(" ".join(words))
    sets = word_sets(texts, 2)
    pairs = [(i, j) for i in range(150) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.component_id for r in minhash_dedup.near_duplicates(docs, 2).orderBy("doc_id").collect()]
    want = roots(150, pairs)
    assert 0 < len(pairs) < 150 * 149 / 3 and len(set(want)) > 1
    assert sum(x != y for x, y in zip(got, want, strict=True)) <= 1


def test_one_row_of_a_group_stays(spark):
    one, two = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    rows = [(1, one, "m"), (1, one, "n"), (2, one + " end", "o"), (3, two, "p"), (3, one, "q"), (4, None, "r"), (4, None, "s"), (None, two, "t"), (5, "", "u"), (6, two + " more", "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, version string")
    kept = sorted(r.version for r in minhash_dedup.keep_one(docs).collect())
    assert minhash_dedup.keep_one(docs).columns == docs.columns
    assert kept in (sorted("mprstu"), sorted("nprstu"))
    assert minhash_dedup.keep_one(docs.limit(0)).count() == 0


def test_empty_and_null_documents(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert minhash_dedup.near_duplicates(empty).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f")], "doc_id long, text string")
    rows = minhash_dedup.near_duplicates(odd).collect()
    assert sorted((r.doc_id is None, r.component_id, r.kept) for r in rows if r.doc_id) == [(False, 1, True)] * 2
    assert [r.kept for r in rows if r.doc_id is None] == [True]


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(40):
        centre = rng.normal(size=32)
        for _ in range(int(rng.choice([1, 2, 30]))):
            rows.append((centre + rng.normal(size=32) * rng.choice([0.05, 0.2, 0.3]) * np.abs(centre).mean()).tolist())
    rows += [rows[0]] * 5 + [[2 * x for x in rows[1]]]
    odd = [None, [], [0.0] * 32, [float("nan")] * 32, [float("inf")] + [1.0] * 31, [None] + [1.0] * 31, [1.0] * 3, [1.0] * 3]
    data = [(i, v, 1) for i, v in enumerate(rows + odd)]
    vectors = spark.createDataFrame(data, "vec_id long, embedding array<double>, component int").repartition(3)
    x = np.array(rows)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(vectors).collect()}
    n = len(rows)
    assert [got[i].n_links for i in range(n)] == near.sum(1).tolist()
    assert [got[i].component_id for i in range(n)] == roots(n, np.argwhere(near).tolist())
    for i in range(n, n + 6):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert (got[n + 6].n_links, got[n + 7].component_id) == (1, n + 6)
    assert embedding_dedup.near_duplicates(vectors.limit(0)).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 64))
    x[150:] = x[:150] + 0.2 * rng.normal(size=(150, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    rotated, signs, factors = embedding_dedup.encode(x)
    exact = x @ x.T
    code = np.where(signs, 1, -1) / np.sqrt(embedding_dedup.BITS)
    estimate = rotated @ code.T / factors
    np.fill_diagonal(estimate, 1)
    assert abs((estimate - exact).mean()) < 0.002
    assert (embedding_dedup.upper_bounds(rotated, signs, factors) >= exact - 1e-6).mean() > 0.9999


def lines_removed(texts):
    """By document: the line numbers that repeat an earlier line, by brute force."""
    known, place = {}, []
    for i, t in enumerate(texts):
        for k, line in enumerate((t or "").split("\n")):
            if line.strip():
                place.append((i, k, known.setdefault(line, len(known))))
    lines = list(known)
    sets = [frozenset(x.lower()[k : k + 5] for k in range(len(x.lower()) - 4)) if len(x) >= 20 else frozenset() for x in lines]
    pairs = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    top, seen, gone = roots(len(lines), pairs), set(), set()
    for i, k, line in place:
        if top[line] in seen:
            gone.add((i, k))
        seen.add(top[line])
    return gone


def test_lines_against_brute_force(spark):
    rnd = random.Random(6)
    vocabulary = ["alpha", "be", "gamma,", "Delta", "of", "the", "épsilon", "zeta.", "eta", "theta"] + [f"word{i}" for i in range(300)]
    pool = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(1, 40))) for _ in range(60)]
    texts = [None, "", "\n\n", " ", "short", "short"]
    for _ in range(60):
        lines = [rnd.choice(pool) for _ in range(rnd.randint(1, 6))]
        for k in range(len(lines)):
            if rnd.random() < 0.4:
                words = lines[k].split()
                words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
                lines[k] = " ".join(words)
        texts.append("\n".join(lines))
    texts.append("x" * 50_000 + "\n" + "x" * 50_000)
    docs = spark.createDataFrame([(i, t, "l", 1) for i, t in enumerate(texts)], "doc_id long, text string, line string, h1 int").repartition(3)
    want = lines_removed(texts)
    got = {(r.doc_id, r.line_no) for r in line_dedup.duplicate_lines(docs).collect()}
    assert got <= want and len(got) >= 0.97 * len(want)
    rebuilt = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    assert len(rebuilt) == len(texts)
    for i, t in enumerate(texts):
        gone = {k for d, k in got if d == i}
        assert rebuilt[i].n_removed == len(gone)
        assert rebuilt[i].text == (None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone))
    assert rebuilt[0].n_lines == 0
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_lines_plans_have_no_python(spark, monkeypatch):
    from weftline.llm import linking

    plans = []

    def recorded(df, name):
        plans.append((name, df._jdf.queryExecution().toString()))
        return common.written(df, name)

    for module in (line_dedup, linking):
        monkeypatch.setattr(module, "written", recorded)
    words = [f"word{k}" for k in range(60)]
    docs = spark.createDataFrame([(k, " ".join(words[: 40 + k % 9]) + "\nanother") for k in range(40)], "doc_id long, text string")
    done = line_dedup.dedup_lines(docs)
    plans.append(("result", done._jdf.queryExecution().toString()))
    assert {"lines", "shared", "near", "line-components"} <= {name for name, _ in plans}
    assert not [name for name, plan in plans if "Python" in plan or "Arrow" in plan or "Pandas" in plan]


def test_lines_of_odd_tables(spark):
    # extra and clashing columns stay, texts of one doc_id are told apart, repeated rows stay alike, long and wide lines
    long = " ".join(f"w{k}" for k in range(40_000))
    line = "a line that is long enough to be compared with the others of the table"
    rows = [(1, line, "m", 7), (1, line + "\nsomething else entirely in the other version", "n", 8), (1, line, "o", 9), (None, line, "p", 1), (2, None, "q", 2), (3, "", "r", 3)]
    rows += [(4, long, "s", 4), (5, long.replace("w7 ", "w8 "), "t", 5), (6, "\U0001f600" * 3 + line, "u", 6), (7, "x\n\n x", "v", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, version string, _gone int")
    got = {r.version: r for r in line_dedup.dedup_lines(docs).collect()}
    assert line_dedup.dedup_lines(docs).columns == [*docs.columns, "n_lines", "n_removed"]
    assert {k: r._gone for k, r in got.items()} == {r[2]: r[3] for r in rows}
    assert got["m"].text == got["o"].text and {got["m"].text, got["n"].text.split("\n")[0]} != {line}
    assert [got["m"].n_removed + got["n"].n_removed, got["p"].text, got["q"].text, got["r"].text] == [1, line, None, ""]
    assert (got["s"].n_removed, got["t"].n_removed, got["u"].n_removed, got["v"].text) == (0, 1, 1, "x\n\n x")


def test_lines_in_passes(spark, monkeypatch):
    """Many keys and blocks are shuffled in passes, none of which holds most rows; what is removed stays the same."""
    from weftline.llm import linking

    rnd = random.Random(11)
    lines = ["".join(rnd.choices("abcdefghij ", k=rnd.choice([30, 60, 90, 120]))) for _ in range(80)]
    texts = ["\n".join((x + rnd.choice("xyz") if rnd.random() < 0.5 else x) for x in rnd.choices(lines, k=6)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def removed():
        return sorted(tuple(r) for r in line_dedup.duplicate_lines(docs).select("doc_id", "line_no").collect())

    expected = removed()
    rows = {"shared": [], "line-links": []}

    def recorded(df, name):
        out = common.written(df, name)
        if name in rows:
            rows[name].append(out.count())
        return out

    for module in (line_dedup, linking):
        monkeypatch.setattr(module, "written", recorded)
    # no rounds of heads, so that blocks are left
    monkeypatch.setattr(line_dedup, "link", lambda members, confirm, links: linking.link(members, confirm, links, rounds=0))
    monkeypatch.setattr(line_dedup, "PASS_KEYS", 10)
    monkeypatch.setattr(line_dedup, "PASS_ROWS", 10)
    assert removed() == expected
    for name, counts in rows.items():
        assert len(counts) == line_dedup.PASSES and 0 < max(counts) < sum(counts) / 2, (name, counts)


def test_lines_are_fetched_and_compared_in_passes(spark, monkeypatch):
    """Keys and texts beyond a broadcast are fetched in passes, and passes of blocks grow in number with their rows; what is removed stays the same."""
    from weftline.llm import linking

    rnd = random.Random(12)
    lines = ["".join(rnd.choices("abcdefghij ", k=rnd.choice([30, 60, 90, 120]))) for _ in range(60)]
    texts = ["\n".join((x + rnd.choice("xyz") if rnd.random() < 0.5 else x) for x in rnd.choices(lines, k=6)) for _ in range(50)]
    # rows of one doc_id with other texts, repeated rows, and rows without text or id
    rows = [(k // 2, t) for k, t in enumerate(texts)] + [(3, texts[6]), (60, None), (61, ""), (None, texts[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    def left():
        return sorted(map(repr, line_dedup.dedup_lines(docs).collect()))

    counts = {"lines-keys": [], "lines-texts": [], "line-links": [], "blocks": []}

    def recorded(df, name):
        out = common.written(df, name)
        if name in counts:
            counts[name].append(out.count())
        return out

    monkeypatch.setattr(line_dedup, "link", lambda members, confirm, links: linking.link(members, confirm, links, rounds=0))
    expected = left()
    for module in (line_dedup, linking):
        monkeypatch.setattr(module, "written", recorded)
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", 10, raising=False)
    monkeypatch.setattr(line_dedup, "PASS_ROWS", 10)
    monkeypatch.setattr(line_dedup, "MOST_ROWS", 300, raising=False)
    assert left() == expected
    for name in ("lines-keys", "lines-texts"):
        assert len(counts[name]) == line_dedup.PASSES and 0 < max(counts[name]) < sum(counts[name]) / 2, (name, counts)
    assert sum(counts["lines-keys"]) == sum(counts["lines-texts"])
    assert len(counts["line-links"]) == -(-counts["blocks"][0] // 300) > line_dedup.PASSES, counts


def test_shuffles_end_with_their_query(spark, tmp_path):
    def held():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f.getName() for f in (files.apply(k) for k in range(files.size())) if f.getName().endswith(".data")}

    before = held()
    with common.shuffles_dropped(spark):
        spark.range(1000).selectExpr("id % 10 as a").groupBy("a").count().write.parquet(str(tmp_path / "counts"))
    for _ in range(50):
        if not held() - before:
            break
        time.sleep(0.1)
    assert not held() - before
    assert spark.conf.get(common._CLEANUP, None) is None
    assert spark.read.parquet(str(tmp_path / "counts")).count() == 10
