import random

import pytest
import xxhash
from pyspark.sql import functions as F

from weftline.api import Engine
from weftline.functions import text as T
from weftline.operators import evaluate, orphans, segments
from weftline.parsers.registry import parse_files
from weftline.parsers.rst import OPAQUE_DIRECTIVES, width
from weftline.sources.project import resolve_output

STATE = "path string, pos int, segment_id string, file_hash long, source string, source_hash long, context_hash long, translation string, glossary_snapshot map<string,string>, translated_at timestamp, issues array<string>"
SOURCES = "source_idx int, dir string, pattern string, output string, parser string"
TERMS = "term string, translation string, note string"


def signed(data):
    h = xxhash.xxh64_intdigest(data)
    return h - (h >> 63 << 64)


def stored(path, text, sentences, translated):
    """State rows as files have them: hashes of texts, and of the neighbours' hashes, lowest byte first."""
    hashes = [xxhash.xxh64_intdigest(s.encode()) for s in sentences]
    out = []
    for k, s in enumerate(sentences):
        around = [hashes[j] if 0 <= j < len(hashes) else 0 for j in (k - 1, k + 1)]
        context = signed(b"".join(h.to_bytes(8, "little") for h in around))
        out.append((path, k, f"section:0/block:{k}/seg:0", signed(text.encode()), s, signed(s.encode()), context, f"ko {s}" if translated(k) else None, {}, None, []))
    return out


@pytest.fixture
def project(spark):
    def make(files, state, rules=None, terms=()):
        tables = (spark.createDataFrame(files, "path string, source string"), spark.createDataFrame(state, STATE), spark.createDataFrame(list(terms), TERMS), spark.createDataFrame([], SOURCES))
        return Engine(spark, *tables, rules=rules)

    return make


def test_state_files_are_matched_by_their_own_hashes(project):
    kept, text = ["First one.", "Second, über it.", "Third."], "First one.\n\nSecond, über it.\n\nThird.\n"
    moved = "Here.\n\nAll of this moved.\n"
    state = stored("a.md", text, kept, lambda k: k != 1) + stored("old.md", moved, ["Here.", "All of this moved."], lambda k: True)
    engine = project([("a.md", text + "\nNew.\n"), ("new.md", moved)], state)
    got = {(r.path, r.source): r.status for r in engine.segments().collect()}
    assert got == {
        ("a.md", "First one."): "Translated", ("a.md", "Second, über it."): "Pending", ("a.md", "Third."): "ContextChanged", ("a.md", "New."): "Pending",
        ("new.md", "Here."): "Pending", ("new.md", "All of this moved."): "Pending",
    }
    assert [tuple(r) for r in engine.orphans().collect()] == [("old.md", "new.md")]
    engine.close()


GRID = "Title\n=====\n\n+-------+----------+\n| Name  | Meaning  |\n+=======+==========+\n| x     | a number |\n+-------+----------+\n| 42    | ---      |\n+-------+----------+\n\nEnd.\n"


def test_table_cells_are_segments_and_tables_are_drawn_anew(spark, project):
    engine = project([("t.rst", GRID)], [])
    rows = engine.segments()
    assert [r.source for r in rows.orderBy("seq").collect()] == ["Title", "Name", "Meaning", "x", "a number", "42", "End."]
    same = {r.path: r.output for r in engine.outputs(rows).collect()}
    assert same == {"t.rst": GRID}
    # with each text as its own translation the file stays, and parses alike
    self_told = engine.outputs(rows.withColumn("translation", F.col("source"))).first().output
    assert self_told == GRID
    new = rows.withColumn("translation", F.when(F.col("source") == "a number", "숫자입니다 그리고"))
    out = engine.outputs(new).first().output
    assert "숫자입니다" in out and "| Name " in out and "---" in out
    border = next(x for x in out.split("\n") if x.startswith("+"))
    body = [x for x in out.split("\n") if x.startswith(("+", "|"))]
    assert all(width(x) == width(border) for x in body)
    again = parse_files(spark.createDataFrame([("t.rst", out, "rst")], "path string, source string, markup string"))
    assert {r.raw_content for r in again.filter("role_kind = 'table_cell'").collect()} == {"Name", "Meaning", "x", "숫자입니다 그리고", "42"}
    cells = engine.blocks.filter("role_kind = 'table_cell'").orderBy("section_idx", "block_idx").collect()
    assert [(r.column_idx, r.label_row, r.header) for r in cells] == [(0, True, None), (1, True, None), (0, False, "Name"), (1, False, "Meaning"), (0, False, "Name")]


def test_simple_tables(spark, project):
    text = "=====  ======\nName   Use\n=====  ======\none    first\ntwo    next\n=====  ======\n"
    engine = project([("s.rst", text)], [])
    rows = engine.segments().withColumn("translation", F.when(F.col("source") == "first", "아주 긴 번역문"))
    assert [r.source for r in rows.orderBy("seq").collect()] == ["Name", "Use", "one", "first", "two", "next"]
    out = engine.outputs(rows).first().output
    assert "one    아주 긴 번역문" in out and out.split("\n")[0] == "=====  " + "=" * 14


def test_fixed_values(spark):
    assert len(OPAQUE_DIRECTIVES) == 18 and {"contents", "figure", "list-table", "tabularcolumns"} <= set(OPAQUE_DIRECTIVES)
    assert not {"index", "graphviz", "testcode", "testoutput"} & set(OPAQUE_DIRECTIVES)
    text = "a漢é한😀。"
    row = spark.createDataFrame([(text,)], "t string").select(T.display_width(F.col("t")).alias("w")).first()
    assert row.w == width(text) == 9


def test_slugs(spark):
    titles = {"my_func": "myfunc", "A `b c` *d*": "a-b-c-d", "x {name open": "x", "{role}`Y` z!": "y-z", "--": ""}
    got = {r.t: r.s for r in spark.createDataFrame([(t,) for t in titles], "t string").select("t", T.heading_slug(F.col("t")).alias("s")).collect()}
    assert got == titles


def test_a_reference_may_get_an_alias(spark):
    rows = [("See `the docs`_ now.", "`문서 <the docs_>`_ 를 보라. the docs", 0), ("See `the docs`_ now.", "문서를 보라.", 1), ("Python_ is it.", "Python_ 이다.", 0), ("Python_ is it.", "Python 이다.", 1), ("``a_`` and b", "``x``", 0)]
    df = spark.createDataFrame(rows, "s string, t string, n int").withColumn("got", F.size(evaluate.eval_link_rst(F.col("s"), F.col("t"))))
    assert all(r.n == r.got for r in df.collect())


def test_output_paths_are_below_the_source(spark):
    sources = spark.createDataFrame([(0, "docs", ".*", "out/{path}", None), (1, "", ".*", "ko/{dir}/{stem}{ext}", None)], SOURCES)
    files = spark.createDataFrame([("docs/a/b.md",), ("x/y.rst",)], "path string")
    assert {r.path: r.output for r in resolve_output(files, sources).collect()} == {"docs/a/b.md": "out/a/b.md", "x/y.rst": "ko/x/y.rst"}


@pytest.mark.parametrize("kind", ["long", "string"])
def test_renames_are_claimed_in_order(spark, kind):
    rnd = random.Random(3)
    make = lambda base, n: [(base + k, rnd.randrange(12), [rnd.randrange(40) for _ in range(rnd.randint(0, 6))]) for k in range(n)]
    new, old = make(100, 40), make(500, 40)
    name = (lambda p: p) if kind == "long" else str
    table = lambda files: spark.createDataFrame([(name(p), f, h) for p, f, hs in files for h in (hs or [None])], f"path {kind}, file_hash long, source_hash long")
    want, taken = {}, set()
    for p, f, hs in sorted(new, key=lambda x: name(x[0])):
        wishes = []
        for q, g, ks in old:
            overlap = len(set(hs) & set(ks)) / len(set(hs)) if hs else 0
            if f == g or (hs and overlap >= orphans.OVERLAP):
                wishes.append((-(f == g), -max(overlap, float(f == g)), name(q)))
        free = [w for w in wishes if w[2] not in taken]
        if free:
            want[name(p)] = min(free)[2]
            taken.add(want[name(p)])
    got = {r.path: r.orphan_path for r in orphans.match_orphans(table(new), table(old)).collect()}
    assert got == want


def test_all_segments_of_a_store(spark):
    from weftline.functions.hashing import STORED

    blocks = segments.line_blocks(spark.createDataFrame([("a", "Ein Satz. Über zwei.")], "path string, source string"))
    got = segments.translatable_segments(blocks, STORED).orderBy("seq").collect()
    assert [r.source_hash for r in got] == [signed(x.encode()) for x in ("Ein Satz.", "Über zwei.")]
