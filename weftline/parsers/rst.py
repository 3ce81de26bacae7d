"""reStructuredText blocks, with grid and simple tables measured in display columns."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from weftline.functions.text import WIDE
from weftline.parsers.base import Block, Line, has_word, lines_of

# Directives whose body is not prose.
OPAQUE_DIRECTIVES = (
    "code",
    "code-block",
    "sourcecode",
    "literalinclude",
    "parsed-literal",
    "doctest",
    "raw",
    "math",
    "toctree",
    "contents",
    "include",
    "highlight",
    "image",
    "figure",
    "csv-table",
    "list-table",
    "productionlist",
    "tabularcolumns",
)
_ADORN = re.compile(r"([!-/:-@\[-`{-~])\1+$")
_BULLET = re.compile(r"[-*+•‣⁃][ \t]+(?=\S)")
_ENUMERATOR = re.compile(r"(?:\d+\.|#\.|[A-Za-z]\)|\(?(?:\d+|[A-Za-z]|#)\))[ \t]+(?=\S)")
_FIELD = re.compile(r":[^:\s][^:]*:(?:[ \t]+|$)")
_DIRECTIVE = re.compile(r"\.\.[ \t]+(?:\|[^|]+\|[ \t]+)?([\w:.+-]+?)::(?:[ \t]+(.*))?$")
_FOOTNOTE = re.compile(r"\.\.[ \t]+\[[^\]]+\][ \t]+(?=\S)")
_GRID = re.compile(r"\+(?:[-=]+\+)+$")
_SIMPLE = re.compile(r"=+(?:[ \t]+=+)+$")


def width(text: str) -> int:
    """Display columns: two for wide characters."""
    return sum(2 if any(lo <= ord(c) <= hi for lo, hi in WIDE) else 1 for c in text)


def columns(text: str, start: int, stop: int | None) -> str:
    """The part of a text between two display columns."""
    at, out = 0, []
    for c in text:
        if at >= start and (stop is None or at < stop):
            out.append(c)
        at += width(c)
    return "".join(out)


@dataclass
class Table:
    """kind, indent, column widths and rows of cell texts; labels says how many rows stand above the header border."""

    kind: str
    indent: int
    edges: list[tuple[int, int]]
    rows: list[list[str]] = field(default_factory=list)
    labels: int = 0


def grid_table(lines: list[str]) -> Table | None:
    """Geometry of a grid table, or None where cells span, borders differ, or a cell holds several paragraphs."""
    indent = len(lines[0]) - len(lines[0].lstrip())
    body = [x[indent:].rstrip() for x in lines]
    border = body[0]
    cuts = [i for i, c in enumerate(border) if c == "+"]
    edges = list(zip((c + 1 for c in cuts), cuts[1:], strict=False))
    table, cells = Table("grid", indent, edges), None
    for line in body[1:]:
        if line.startswith("+"):
            if not _GRID.fullmatch(line) or [i for i, c in enumerate(line) if c == "+"] != cuts:
                return None
            if cells is None:
                return None
            for parts in cells:
                text = "\n".join(parts).strip("\n")
                if "\n\n" in text:
                    return None
            table.rows.append([" ".join(p.strip() for p in parts if p.strip()) for parts in cells])
            cells = None
            if "=" in line:
                if table.labels:
                    return None
                table.labels = len(table.rows)
            continue
        if not line.startswith("|") or not line.endswith("|") or width(line) != width(border):
            return None
        if any(columns(line, e, e + 1) != "|" for _, e in edges):
            return None
        cells = cells or [[] for _ in edges]
        for k, (a, b) in enumerate(edges):
            cells[k].append(columns(line, a, b).strip())
    return table if cells is None and table.rows else None


def simple_table(lines: list[str]) -> Table | None:
    """Geometry of a simple table, or None where text stands between columns or columns span."""
    indent = len(lines[0]) - len(lines[0].lstrip())
    body = [x[indent:].rstrip() for x in lines]
    border = body[0]
    starts = [m.start() for m in re.finditer(r"=+", border)]
    ends = [m.end() for m in re.finditer(r"=+", border)]
    edges = list(zip(starts, ends, strict=True))
    table = Table("simple", indent, edges)
    for k, line in enumerate(body[1:-1]):
        if line == border:
            if table.labels or not table.rows:
                return None
            table.labels = len(table.rows)
            continue
        if not line:
            continue
        if re.fullmatch(r"[-= ]+", line) and len(line) > 3 and set(line) & set("-="):
            return None
        for a, b in zip(ends, starts[1:], strict=False):
            if columns(line, a, b).strip():
                return None
        stops = [*starts[1:], None]
        cells = [columns(line, a, b).strip() for (a, _), b in zip(edges, stops, strict=True)]
        if cells[0] == "..":
            cells[0] = ""
        elif not cells[0]:
            if not table.rows or table.labels == len(table.rows) and k == 0:
                return None
            table.rows[-1] = [" ".join(x for x in pair if x) for pair in zip(table.rows[-1], cells, strict=True)]
            continue
        table.rows.append(cells)
    return table if table.rows else None


def _wrap(text: str, most: int) -> list[str]:
    out = [""]
    for word in text.split():
        if out[-1] and width(out[-1]) + 1 + width(word) > most:
            out.append("")
        out[-1] = f"{out[-1]} {word}" if out[-1] else word
    return out


def render(table: Table, rows: list[list[str]]) -> str:
    """The table with new cell texts: columns never shrink, text wraps at the original width; a simple table's first column does not wrap and its last has no bound."""
    n, pad = len(table.edges), " " * table.indent
    old = [b - a - (2 if table.kind == "grid" else 0) for a, b in table.edges]
    free = lambda c: table.kind == "simple" and c in (0, n - 1)
    cells = [[[t] if free(c) else _wrap(t, old[c]) for c, t in enumerate(r)] for r in rows]
    wide = [max([old[c], *(width(x) for r in cells for x in r[c])]) for c in range(n)]
    fill = lambda t, w: t + " " * (w - width(t))
    out = []
    if table.kind == "grid":
        border = lambda ch: pad + "+" + "+".join(ch * (w + 2) for w in wide) + "+"
        out.append(border("-"))
        for k, r in enumerate(cells):
            for i in range(max(len(x) for x in r)):
                out.append(pad + "|" + "|".join(" " + fill(x[i] if i < len(x) else "", w) + " " for x, w in zip(r, wide, strict=True)) + "|")
            out.append(border("=" if table.labels == k + 1 else "-"))
        return "\n".join(out)
    gaps = [b[0] - a[1] for a, b in zip(table.edges, table.edges[1:], strict=False)]
    join = lambda parts: (pad + "".join(p + " " * g for p, g in zip(parts, [*gaps, 0], strict=True))).rstrip()
    border = join(["=" * w for w in wide])
    out.append(border)
    for k, r in enumerate(cells):
        for i in range(max(len(x) for x in r)):
            first = r[0][i] if i < len(r[0]) else ""
            if i == 0 and not first:
                first = ".."
            out.append(join([fill(first, wide[0]), *(fill(x[i] if i < len(x) else "", w) for x, w in zip(r[1:], wide[1:], strict=True))]))
        if table.labels == k + 1:
            out.append(border)
    out.append(border)
    return "\n".join(out)


class _Parser:
    def __init__(self, text: str):
        self.text, self.lines, self.blocks = text, lines_of(text), []
        self.styles: list[tuple[str, bool]] = []
        self.literal: int | None = None  # indent that announces a literal block
        self.tables = 0

    def indent(self, line: Line) -> int:
        return len(line.text) - len(line.text.lstrip())

    def level(self, mark: str, over: bool) -> int:
        if (mark, over) not in self.styles:
            self.styles.append((mark, over))
        return self.styles.index((mark, over)) + 1

    def skip(self, i: int, deeper: int) -> int:
        """The first line from i on that is neither blank nor indented by more than ``deeper``."""
        while i < len(self.lines) and (self.lines[i].blank or self.indent(self.lines[i]) > deeper):
            i += 1
        return i

    def opaque(self, first: int, after: int) -> None:
        last = after - 1
        while last > first and self.lines[last].blank:
            last -= 1
        self.blocks.append(Block("code_block", self.lines[first].start, self.lines[last].end, translatable=False))

    def covers(self, mark: str, title: str) -> bool:
        return len(mark) >= 4 or len(mark) >= width(title)

    def run(self) -> list[Block]:
        i = 0
        while i < len(self.lines):
            i = self.step(i)
        return self.blocks

    def step(self, i: int) -> int:
        line = self.lines[i]
        if line.blank:
            return i + 1
        depth, s = self.indent(line), line.text.strip()
        if self.literal is not None:
            base, self.literal = self.literal, None
            if depth > base or (depth == base and s[0] in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"):
                after = self.skip(i, base) if depth > base else next((k for k in range(i, len(self.lines)) if self.lines[k].blank), len(self.lines))
                self.opaque(i, after)
                return after
        if s == "::":
            self.literal = depth
            return i + 1
        below = self.lines[i + 1].text.rstrip() if i + 1 < len(self.lines) else ""
        if depth == 0 and not _ADORN.fullmatch(s) and _ADORN.fullmatch(below) and self.covers(below, s) and has_word(s):
            at = self.lines[i + 1].start
            self.blocks.append(Block("heading", line.start, line.start + len(s), self.level(below[0], False), role="adorned_title", mark=below[0], under=(at, at + len(below))))
            return i + 2
        if depth == 0 and _ADORN.fullmatch(s) and not _SIMPLE.fullmatch(s):
            third = self.lines[i + 2].text.rstrip() if i + 2 < len(self.lines) else ""
            if below.strip() and third == s and has_word(below):
                title = self.lines[i + 1]
                lead = self.indent(title)
                at = self.lines[i + 2].start
                self.blocks.append(Block("heading", title.start + lead, title.start + len(below), self.level(s[0], True), role="adorned_title", mark=s[0], under=(at, at + len(third)), over=(line.start, line.start + len(s))))
                return i + 3
            if len(s) >= 4:
                self.blocks.append(Block("thematic_break", line.start, line.end, translatable=False))
                return i + 1
        if s == ".." or s.startswith(".. "):
            return self.explicit(i, depth, s)
        if s.startswith(">>>"):
            after = next((k for k in range(i, len(self.lines)) if self.lines[k].blank), len(self.lines))
            self.opaque(i, after)
            return after
        if _GRID.fullmatch(s):
            after = next((k for k in range(i, len(self.lines)) if not self.lines[k].text.strip().startswith(("+", "|"))), len(self.lines))
            return self.table(i, after, grid_table)
        if _SIMPLE.fullmatch(s):
            after = self.simple_end(i, s)
            return self.table(i, after, simple_table)
        if m := _FIELD.match(s):
            rest = s[m.end() :]
            if rest and has_word(rest):
                return self.paragraph(i, depth, "paragraph", depth + m.end())
            return i + 1
        if s.startswith("| ") or s == "|":
            if len(s) > 2:
                self.add("paragraph", line.start + depth + 2, line.start + depth + len(s))
            return i + 1
        if m := _BULLET.match(s) or _ENUMERATOR.match(s):
            return self.paragraph(i, depth, "list_item", depth + m.end())
        return self.paragraph(i, depth, "block_quote" if depth and not self.blocks else "paragraph", depth)

    def add(self, kind: str, a: int, b: int) -> None:
        if has_word(self.text[a:b]):
            self.blocks.append(Block(kind, a, b))

    def paragraph(self, i: int, depth: int, kind: str, at: int) -> int:
        """Lines of equal indent from i on (after a mark, of the text's indent); a final ``::`` announces a literal block."""
        k = i + 1
        while k < len(self.lines) and not self.lines[k].blank and self.indent(self.lines[k]) == at:
            k += 1
        last = self.lines[k - 1]
        end = last.start + len(last.text.rstrip())
        tail = self.text[self.lines[i].start : end]
        if tail.endswith("::"):
            self.literal = depth
            end -= 2
            end -= len(self.text[:end]) - len(self.text[self.lines[i].start : end].rstrip()) - self.lines[i].start
        self.add(kind, self.lines[i].start + at, end)
        return k

    def explicit(self, i: int, depth: int, s: str) -> int:
        line = self.lines[i]
        if m := _DIRECTIVE.match(s):
            if m[1].rpartition(":")[2] in OPAQUE_DIRECTIVES or s.startswith(".. |"):
                after = self.skip(i + 1, depth)
                self.opaque(i, after)
                return after
            if m[2] and has_word(m[2]) and m[1] in ("note", "warning", "tip", "important", "caution", "danger", "hint", "attention", "error", "admonition", "topic", "sidebar", "rubric", "seealso", "versionadded", "versionchanged", "deprecated"):
                self.add("paragraph", line.start + depth + m.start(2), line.start + depth + m.end(2))
            k = i + 1
            while k < len(self.lines) and self.indent(self.lines[k]) > depth and _FIELD.match(self.lines[k].text.strip() or " "):
                k += 1
            return k
        if m := _FOOTNOTE.match(s):
            self.add("paragraph", line.start + depth + m.end(), line.start + depth + len(s))
            return i + 1
        if s.startswith((".. _", ".. |")):
            return i + 1
        return self.skip(i + 1, depth)  # a comment

    def simple_end(self, i: int, border: str) -> int:
        seen = 0
        for k in range(i + 1, len(self.lines)):
            if self.lines[k].text.strip() == border:
                seen += 1
                after = k + 1
                if after >= len(self.lines) or self.lines[after].blank:
                    return after
        return i + 1

    def table(self, i: int, after: int, geometry) -> int:
        raw = [x.text for x in self.lines[i:after]]
        found = geometry(raw) if len(raw) > 2 else None
        start, end = self.lines[i].start, self.lines[after - 1].end
        self.blocks.append(Block("table", start, end, translatable=False, role="table_anchor" if found else "none", table=self.tables if found else None))
        if found:
            labels = found.labels or 0
            for r, row in enumerate(found.rows):
                for c, cell in enumerate(row):
                    if has_word(cell):
                        # a body cell carries the label above it; a label is its own text
                        header = (found.rows[0][c] or None) if labels and c < len(found.rows[0]) and r >= labels else None
                        self.blocks.append(Block("table", start, start, role="table_cell", table=self.tables, column=c, label_row=r < labels, header=header, text=cell))
            self.tables += 1
        return after


def parse_rst(text: str) -> list[Block]:
    return _Parser(text).run()


def redraw_table(source: str, texts: list[str]) -> str | None:
    """A table's source drawn anew with the texts of its cells that have a word, in order; None where cells and geometry disagree, which leaves it as it is."""
    lines = source.rstrip("\n").split("\n")
    found = grid_table(lines) if lines[0].strip().startswith("+") else simple_table(lines)
    if found is None or sum(has_word(c) for r in found.rows for c in r) != len(texts):
        return None
    left = iter(texts)
    return render(found, [[next(left) if has_word(c) else c for c in r] for r in found.rows])


def rebuild_table(source: str, translations: dict[str, str]) -> str | None:
    """A table's source drawn anew with cells replaced by text; None where it has no geometry, which leaves it as it is."""
    lines = source.split("\n")
    found = grid_table(lines) if lines[0].strip().startswith("+") else simple_table(lines)
    return None if found is None else render(found, [[translations.get(c, c) for c in r] for r in found.rows])
