import random

import pytest
from pyspark.sql import functions as F

from weftline.functions import hashing as H
from weftline.functions import text as T
from weftline.operators import coverage, evaluate, glossary, orphans, reconcile, reconstruct, selection, translate
from weftline.streaming import events as E


def column(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}").coalesce(1)
    return [r.y for r in rows.orderBy("i").select(expression(F.col("x")).alias("y")).collect()]


def test_sentences(spark):
    cases = {
        "One. Two! Three?": ["One.", "Two!", "Three?"],
        "See e.g. Smith. Then go.": ["See e.g. Smith.", "Then go."],
        "Dr. Who came.  Yes.": ["Dr. Who came.", "Yes."],
        "at 3.5 and more. lower case": ["at 3.5 and more. lower case"],
        "": [],
        "  spaced.  Out  ": ["spaced.", "Out"],
        "What?! Really.": ["What?!", "Really."],
        "Éa. École": ["Éa.", "École"],
    }
    assert column(spark, list(cases), T.split_sentences) == list(cases.values())


def test_ids(spark):
    assert column(spark, ["section:1/block:2/seg:3", "bad", None], T.flat_index) == [1_002_003, 0, 0]


def test_terms_in_prose(spark):
    texts = ["The heap grows", "heaps", "`heap` only", "see https://x.y/heap now", "[heap](target)", "[x](heap)", "HEAP_x", "(heap)"]
    got = column(spark, texts, lambda x: T.has_term(x, F.lit("Heap")))
    assert got == [True, False, False, False, True, False, False, True]


def test_urls(spark):
    texts = ["a https://x.y/a(b)c. b", "[t](http://x.y/z)tail", "<http://x.y>", "none", "http://a,b;"]
    assert column(spark, texts, T.extract_urls) == [["https://x.y/a(b)c"], ["http://x.y/z"], ["http://x.y"], [], ["http://a,b"]]


def test_compat_hashes(spark):
    import xxhash

    signed = lambda h: h - (h >> 63 << 64)
    assert column(spark, ["a", "", None, "é"], H.compat_hash) == [signed(xxhash.xxh64_intdigest(b)) if b is not None else None for b in (b"a", b"", None, "é".encode())]
    got = column(spark, [1, -1], lambda x: H.compat_context(x, F.lit(None).cast("bigint")), "long")
    assert got == [signed(xxhash.xxh64_intdigest((v % (1 << 64)).to_bytes(8, "little") + bytes(8))) for v in (1, -1)]


def greedy(new, old):
    """By path and hash, in order: the nearest unclaimed stored row, the first of equals."""
    out, claimed = {}, set()
    for path, seq, value, idx in sorted(new):
        free = [(abs(idx - i), pos) for p, pos, v, i in old if (p, v) == (path, value) and (p, pos) not in claimed]
        if free:
            claimed.add((path, min(free)[1]))
            out[path, seq] = min(free)[1]
    return out


def test_reconcile_is_greedy(spark):
    rnd = random.Random(3)
    ident = lambda i: f"section:{i // 40}/block:{i // 8 % 5}/seg:{i % 8}"
    flat = lambda i: i // 40 * 10**6 + i // 8 % 5 * 1000 + i % 8
    new = [(f"p{p}", s, rnd.randrange(6), rnd.randrange(60)) for p in range(3) for s in range(25)]
    old = [(f"p{p}", s, rnd.randrange(6), rnd.randrange(60)) for p in range(3) for s in range(20)]
    segments = spark.createDataFrame([(p, s, v, ident(i)) for p, s, v, i in new], "path string, seq long, source_hash long, segment_id string")
    state = spark.createDataFrame([(p, s, v, ident(i)) for p, s, v, i in old], "path string, pos int, source_hash long, segment_id string")
    got = {(r.path, r.seq): r.pos for r in reconcile.matches(segments, state).collect()}
    assert got == greedy([(p, s, v, flat(i)) for p, s, v, i in new], [(p, s, v, flat(i)) for p, s, v, i in old])


def test_statuses(spark):
    rows = [("t", 1, 1, False, 5, 5), (None, 1, 1, True, 5, 6), ("t", 1, 2, True, 5, 6), ("t", 1, 1, True, 5, 6), ("t", 1, 1, False, 5, 6)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, a int, b int, s boolean, c int, d int").coalesce(1).orderBy("i")
    got = [r.x for r in df.select(reconcile.status(*(F.col(c) for c in "tabscd")).alias("x")).collect()]
    assert got == ["Translated", "Pending", "Stale", "GlossaryStale", "ContextChanged"]


def test_glossary(spark):
    terms = spark.createDataFrame([("heap", "T1", None), ("C++", "T2", "n"), ("", "T3", None)], "term string, translation string, note string")
    rows = spark.createDataFrame([("p", 0, "The Heap and C++ code", {"heap": "T1", "C++": "T2"}), ("p", 1, "heap", {}), ("p", 2, "none", {}), ("p", 3, "heap", {"heap": "old"})], "path string, seq long, source string, glossary_snapshot map<string,string>")
    assert sorted((r.seq, r.term) for r in glossary.term_join(rows, terms).collect()) == [(0, "C++"), (0, "heap"), (1, "heap"), (3, "heap")]
    assert sorted(r.seq for r in glossary.stale_keys(rows, terms).collect()) == [1, 3]
    changed = glossary.upsert_term(terms, spark.createDataFrame([("C++", "X"), ("new", "Y")], "term string, translation string"))
    assert sorted((r.term, r.translation, r.note) for r in changed.filter("term <> ''").collect()) == [("C++", "X", "n"), ("heap", "T1", None), ("new", "Y", None)]


def test_gaps(spark):
    rnd = random.Random(5)
    rows = [(p, n, rnd.choice(["word", "----", ""]), rnd.random() < 0.3) for p in range(40) for n in range(1, 20)]
    df = spark.createDataFrame(rows, "path int, line int, text string, offered boolean").withColumn("has_word", T.has_word(F.col("text")))
    want = []
    for p in range(40):
        run = []
        for _, n, text, offered in [r for r in rows if r[0] == p] + [(p, 99, "", True)]:
            if offered:
                if run:
                    want.append((p, run[0], run[-1], len(run)))
                run = []
            elif text == "word":
                run.append(n)
    assert sorted((r.path, r.first_line, r.last_line, r.lines) for r in coverage.gaps(df).collect()) == sorted(want)


def test_table_rules(spark):
    cells = [("a/t.adoc", 0, r * 3 + c, 0, c, r == 0, f"H{c}" if r == 0 else None, f"x{r}{c}", True) for r in range(3) for c in range(3)]
    df = spark.createDataFrame(cells, "path string, section_idx int, block_idx int, table_idx int, column_idx int, label_row boolean, header string, raw_content string, translatable boolean")
    rules = spark.createDataFrame(
        [(0, "*.md", selection.glob_pattern("*.md"), ["H0"], None, [(0, None)]), (1, "**/*.adoc", selection.glob_pattern("**/*.adoc"), ["h0", "H2"], [(1, None), (None, "h2")], None)],
        "rule_idx int, files string, pattern string, headers array<string>, translate array<struct<idx:int,header:string>>, skip array<struct<idx:int,header:string>>",
    )
    out = selection.apply_table_rules(df, rules).collect()
    assert {(r.column_idx, r.translatable) for r in out if not r.label_row} == {(0, False), (1, True), (2, True)}
    assert all(r.translatable for r in out if r.label_row)
    shown = {r.column_idx: r for r in selection.inspect_tables(selection.apply_table_rules(df, rules)).collect()}
    assert [shown[c].state for c in range(3)] == ["kept", "translated", "translated"] and shown[0].samples == ["x10", "x20"]
    assert column(spark, [["a", "b"], ["b", "a"], []], lambda w: selection.subsequence(F.array(F.lit("A"), F.lit("x"), F.lit("b")), w), "array<string>") == [True, False, False]


def test_orphans(spark):
    new = [("n1", 1, h) for h in (1, 2, 3, 4)] + [("n2", 2, h) for h in (1, 2)] + [("n3", 9, None)]
    old = [("o1", 5, h) for h in (1, 2, 7)] + [("o2", 2, 50)] + [("o3", 6, h) for h in (1, 2, 3)]
    schema = "path string, file_hash long, source_hash long"
    got = {r.path: r.orphan_path for r in orphans.match_orphans(spark.createDataFrame(new, schema), spark.createDataFrame(old, schema)).collect()}
    assert got == {"n1": "o3", "n2": "o2"}


@pytest.mark.parametrize("seed", range(3))
def test_splices(spark, seed):
    rnd = random.Random(seed)
    files, splices, want = [], [], []
    for p in range(30):
        source = "".join(rnd.choice("aé日\n ") for _ in range(rnd.randint(0, 30)))
        raw = source.encode()
        edges = [len(source[:k].encode()) for k in range(len(source) + 1)]
        spans = []
        for k in range(rnd.randint(0, 5)):
            a, b = sorted((rnd.choice(edges), rnd.choice(edges)))
            spans.append((a, k, b, rnd.choice(["X", "", "長い"])))
        out, at = b"", 0
        for a, _, b, t in sorted(spans):
            if a >= at:
                out, at = out + raw[at:a] + t.encode(), b
        files.append((p, source))
        splices += [(p, *s) for s in spans]
        want.append((out + raw[at:]).decode())
    df = reconstruct.apply_splices(spark.createDataFrame(files, "path int, source string"), spark.createDataFrame(splices, "path int, start long, ord long, stop long, text string"))
    assert [r.output for r in df.orderBy("path").collect()] == want


def test_evaluators(spark):
    rows = [
        ("see http://a.b/c.", "no link", "markdown"),
        ("`x` here.", "`x`은 하다.", "markdown"),
        ("Fine.", "좋습니다.", "markdown"),
        ("*b* word", "*b*은 word", "asciidoc"),
        ("plain", "- list", "rst"),
        ("a {ref x}", "a", "verso"),
        ("`phrase`_ x", "gone", "rst"),
        ("**x** y", "**x**은 y", "rst"),
    ]
    df = spark.createDataFrame([("p", i, s, t, m) for i, (s, t, m) in enumerate(rows)], "path string, seq long, source string, translation string, markup string")
    found = {}
    for r in evaluate.mechanical(df, "ko").collect():
        found.setdefault(r.seq, set()).add(r.kind)
    assert found[0] == {"link_broken"} and found[1] == {"style_issue"} and 2 not in found and "format_lost" in found[3]
    assert found[4] == {"format_lost"} and "format_lost" in found[5] and "link_broken" in found[6] and found[7] == {"format_lost"}
    assert {r.seq: r.passed for r in evaluate.passed(df, evaluate.mechanical(df, "ko")).collect()}[2] is True
    assert column(spark, ["GOOD", "acceptable\nso so", "BAD\nwhy", None], lambda x: F.transform(evaluate.eval_style(x), lambda i: i["severity"])) == [[], ["warning"], ["error"], []]


def test_responses(spark):
    answers = ["[1] one\n\n[2]  two \n[x] no\n[1] again\n[3]\nrest", "nothing"]
    assert column(spark, answers, translate.parse_response) == [{1: "again", 2: "two"}, None]
    assert column(spark, ["bare"], lambda x: translate.parse_response_for(x, F.array(F.lit(4)))) == [{4: "bare"}]


def test_retry_is_bounded(spark, tmp_path):
    blocks = spark.createDataFrame([("p", 0, 0, 2, "ctx", [(1, 0, "keep http://a.b"), (2, 1, "two")]), ("p", 0, 1, 1, "c", [(1, 5, "fine")])], "path string, section_idx int, block_idx int, n long, context string, segments array<struct<idx:int,seq:long,source:string>>")

    def stubborn(request):
        return "\n".join(f"[{i}] lost {request['feedback'] is not None}" for i, _ in request["segments"])

    def save(rows, attempt):
        rows.write.parquet(f"{tmp_path}/{attempt}")
        return spark.read.parquet(f"{tmp_path}/{attempt}")

    check = lambda done: evaluate.mechanical(done.withColumn("markup", F.lit("markdown")), "de")
    out = {r.seq: r for r in translate.translate_evaluate_retry(blocks, stubborn, check, save, "en", "de", max_retries=2).collect()}
    assert (out[0].attempt, out[0].translation) == (3, "lost True") and (out[5].attempt, out[5].translation) == (1, "lost False")


def test_rate_limit():
    limit = translate.RateLimit()
    assert limit.wait(0.0) == 0 and limit.wait(0.0) == pytest.approx(0.1)
    limit.refused(1.0, 5.0)
    assert limit.wait(1.0) == pytest.approx(5.0)
    for _ in range(20):
        limit.refused(0.0)
    assert limit.factor == 64


def test_stream_equals_batch(spark, tmp_path):
    kinds = ["run_started", "file_discovered", "block_queued", "block_started", "block_attempt", "block_translated", "block_failed", "file_completed"]
    rows = [(f"r{i % 3}", i, kinds[i % 8], i % 5, f"f{i % 4}", i % 7, i % 3 + 1, None, 4, i % 9) for i in range(200)]
    for k in range(4):
        spark.createDataFrame(rows[k::4], E.EVENT).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    folder = str(tmp_path / "in")
    E.stream_totals(E.event_source(spark, folder), "totals", str(tmp_path / "check")).awaitTermination(120)
    batch = E.job_totals(E.event_source(spark, folder, stream=False)).collect()
    assert sorted(spark.table("totals").collect()) == sorted(batch) and len(batch) == 3
