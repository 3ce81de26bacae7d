import pytest

from weftline.parsers.asciidoc import column_count, parse_asciidoc
from weftline.parsers.base import Offsets, rows
from weftline.parsers.markdown import parse_markdown
from weftline.parsers.rst import grid_table, parse_rst, rebuild_table, render, simple_table
from weftline.parsers.verso import ManifestError, fnv1a64, parse_verso, read_manifest


def seen(parser, text):
    return [(b.kind, text[b.start : b.end]) for b in parser(text) if b.translatable]


def test_markdown_blocks():
    text = "---\ntitle: x\n---\n# One\n\nA para\ngoes on.\n\n> quoted\n> more\n\n- item *a*\n  second line\n  - nested\n1. first\n\n```py\ncode\n```\n\n    indented\n\n| a | b |\n|---|---|\n| c | d |\n\n<div>\nhtml\n</div>\n\nTitle\n=====\n\n***\nbreak  \nhere\n- [x] task\n"
    assert seen(parse_markdown, text) == [
        ("heading", "One"),
        ("paragraph", "A para\ngoes on."),
        ("block_quote", "quoted\n> more"),
        ("list_item", "item *a*\n  second line"),
        ("list_item", "nested"),
        ("list_item", "first"),
        ("table", "a"),
        ("table", "b"),
        ("table", "c"),
        ("table", "d"),
        ("heading", "Title"),
        ("paragraph", "break"),
        ("paragraph", "here"),
        ("list_item", "task"),
    ]
    assert [b.kind for b in parse_markdown(text) if not b.translatable] == ["html_block", "code_block", "code_block", "html_block", "thematic_break"]


def test_asciidoc_blocks():
    text = "= Doc\nAuthor\n\n== Part\n\nText here\non.\n\n----\ncode\n----\n\n* item\n** deeper\n. num\n\nNOTE: mind this\n\nterm:: meaning\n\n.Caption\n____\nquoted\n____\n\n// comment\n:attr: v\n\nTitle\n-----\n\n[cols=\"1,1\"]\n|===\n|H1 |H2\n|a |b\n|===\n"
    assert seen(parse_asciidoc, text) == [
        ("heading", "Doc"),
        ("heading", "Part"),
        ("paragraph", "Text here\non."),
        ("list_item", "item"),
        ("list_item", "deeper"),
        ("list_item", "num"),
        ("paragraph", "mind this"),
        ("list_item", "term"),
        ("list_item", "meaning"),
        ("paragraph", "Caption"),
        ("block_quote", "quoted"),
        ("heading", "Title"),
        ("table", "H1"),
        ("table", "H2"),
        ("table", "a"),
        ("table", "b"),
    ]
    cells = [(b.column, b.label_row) for b in parse_asciidoc(text) if b.kind == "table"]
    assert cells == [(0, True), (1, True), (0, False), (1, False)]
    assert [column_count(c) for c in ("3", '"1,2,1"', '"3*"', "1,2*")] == [3, 3, 3, 3]


def test_rst_blocks():
    text = "=====\nTitle\n=====\n\nPart\n----\n\nPara one\ntwo::\n\n   literal\n\n- item\n  more\n\n1. num\n\n.. note:: mind\n\n   body\n\n.. code-block:: py\n\n   x = 1\n\n.. a comment\n   goes on\n\n:field: value\n\n>>> doctest\n1\n\n.. [1] footnote text\n"
    assert seen(parse_rst, text) == [
        ("heading", "Title"),
        ("heading", "Part"),
        ("paragraph", "Para one\ntwo"),
        ("list_item", "item\n  more"),
        ("list_item", "num"),
        ("paragraph", "mind"),
        ("paragraph", "body"),
        ("paragraph", "value"),
        ("paragraph", "footnote text"),
    ]
    assert [b.level for b in parse_rst(text) if b.kind == "heading"] == [1, 2]


GRID = "+-----+-----+\n| A   | B   |\n+=====+=====+\n| one | two |\n+-----+-----+"
SIMPLE = "===  ====\nA    B\n===  ====\none  two\n..   tail\n===  ===="


@pytest.mark.parametrize(("geometry", "source"), [(grid_table, GRID), (simple_table, SIMPLE)])
def test_tables_draw_themselves(geometry, source):
    table = geometry(source.split("\n"))
    assert table.labels == 1 and table.rows[0] == ["A", "B"]
    assert render(table, table.rows) == source


def test_tables_with_wide_text():
    out = rebuild_table(GRID, {"one": "번역"})
    assert out.split("\n")[3] == "| 번역 | two |" or "번역" in out
    assert rebuild_table("+--+--+\n| spans |\n+--+--+", {}) is None


def test_offsets_are_bytes():
    text = "é\n\n日本 x\n"
    assert [r[5:7] for r in rows(text, parse_markdown(text))] == [(0, 2), (4, 12)]
    assert Offsets("añb")(2) == 3


def test_manifest():
    text = "# Ü\n\nprose"
    doc = {"path": "./a", "sourceHash": str(fnv1a64(text.encode())), "spans": [{"start": 2, "stop": 4, "kind": "header", "level": 1}, {"start": 6, "stop": 11, "kind": "para"}]}
    assert [(b.kind, text[b.start : b.end]) for b in parse_verso(text, doc)] == [("heading", "Ü"), ("paragraph", "prose")]
    for bad in ({"start": 3, "stop": 4, "kind": "para"}, {"start": 2, "stop": 2, "kind": "para"}, {"start": 2, "stop": 4, "kind": "header"}, {"start": 2, "stop": 99, "kind": "para"}):
        with pytest.raises(ManifestError):
            parse_verso(text, doc | {"spans": [bad]})
    with pytest.raises(ManifestError):
        parse_verso(text + " ", doc)
    import json

    good = {"schema": 1, "generator": "g", "versoRevision": "r", "documents": [doc]}
    assert list(read_manifest(json.dumps(good), "r")) == ["a"]
    for change in ({"schema": 2}, {"versoRevision": "q"}, {"more": 1}):
        with pytest.raises(ManifestError):
            read_manifest(json.dumps(good | change), "r")
