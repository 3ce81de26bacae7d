"""Markdown blocks: headings, paragraphs, lists, quotes and tables; code, HTML, front matter and rules are opaque.

Of CommonMark this leaves out link reference definitions and nested fences inside
list items that are indented by less than the item's text.
"""

from __future__ import annotations

import re

from weftline.parsers.base import Block, Line, has_word, lines_of

_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})(.*)$")
_ITEM = re.compile(r"( {0,3})([-+*]|\d{1,9}[.)])(?:([ \t]+)|$)")
_TASK = re.compile(r"\[[ xX]\][ \t]+")
_HTML = re.compile(r" {0,3}<(?:[A-Za-z][\w-]*[\s/>]|[A-Za-z][\w-]*$|/[A-Za-z]|!--|\?|![A-Z])")
_DELIMITER = re.compile(r"^[ \t]*\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_FOOTNOTE = re.compile(r" {0,3}\[\^[^\]]+\]:[ \t]*")


def _cells(line: Line) -> list[tuple[int, int]]:
    """Spans of a table row's cells, without the white space around them."""
    cuts = [m.start() for m in re.finditer(r"(?<!\\)\|", line.text)]
    edges = [-1, *cuts, len(line.text)]
    out = []
    for a, b in zip(edges, edges[1:], strict=False):
        part = line.text[a + 1 : b]
        lead = len(part) - len(part.lstrip())
        out.append((line.start + a + 1 + lead, line.start + a + 1 + len(part.rstrip())))
    if out and out[0][0] >= out[0][1]:
        out = out[1:]
    if out and out[-1][0] >= out[-1][1]:
        out = out[:-1]
    return [(a, max(a, b)) for a, b in out]


class _Parser:
    def __init__(self, text: str):
        self.text, self.lines, self.blocks = text, lines_of(text), []
        self.boxes: list[tuple[str, int]] = []  # ("block_quote", 0) or ("list_item", columns of its text)
        self.para: list[tuple[int, int]] = []  # spans of a paragraph's lines
        self.html_to_blank = False

    def label(self) -> str:
        return self.boxes[-1][0] if self.boxes else "paragraph"

    def flush(self, level: int | None = None, under: tuple[int, int] | None = None) -> None:
        """Ends the paragraph: a block for each stretch between hard breaks."""
        spans, self.para = self.para, []
        run: list[tuple[int, int]] = []
        for i, (a, b) in enumerate(spans):
            hard = i + 1 < len(spans) and (self.text[a:b].endswith("\\") or self.text[b : b + 2] == "  ")
            run.append((a, b - 1 if hard and self.text[a:b].endswith("\\") else b))
            if hard or i + 1 == len(spans):
                start, end = run[0][0], run[-1][1]
                if self.text[start:end].strip():
                    self.blocks.append(Block("heading" if level else self.label(), start, end, level, under=under, role="setext_title" if under else "none", mark=self.text[under[0]] if under else None))
                run = []

    def opaque(self, kind: str, start: int, end: int) -> None:
        self.flush()
        self.blocks.append(Block(kind, start, end, translatable=False))

    def enter(self, line: Line) -> tuple[int, int]:
        """(offset after the marks of containers that go on, how many do)."""
        at, kept = 0, 0
        for kind, width in self.boxes:
            rest = line.text[at:]
            if kind == "block_quote":
                m = re.match(r" {0,3}> ?", rest)
                if not m:
                    break
                at += m.end()
            elif not rest.strip():
                pass
            elif len(rest) - len(rest.lstrip(" ")) >= width:
                at += width
            else:
                break
            kept += 1
        return at, kept

    def run(self) -> list[Block]:
        i, n = 0, len(self.lines)
        if n and self.lines[0].text.rstrip() == "---":
            end = next((k for k in range(1, n) if self.lines[k].text.rstrip() in ("---", "...")), None)
            if end:
                self.opaque("html_block", 0, self.lines[end].end)
                i = end + 1
        while i < n:
            i = self.line(i)
        self.flush()
        return self.blocks

    def line(self, i: int) -> int:
        line = self.lines[i]
        at, kept = self.enter(line)
        rest = line.text[at:]
        if not rest.strip():
            self.flush()
            if kept < len(self.boxes) and any(k == "block_quote" for k, _ in self.boxes[kept:]):
                self.boxes = self.boxes[:kept]
            return i + 1
        starts = _ITEM.match(rest) or re.match(r" {0,3}>", rest) or _ATX.match(rest) or _FENCE.match(rest) or _RULE.match(rest)
        if kept < len(self.boxes):
            if self.para and not starts:  # lazy continuation
                self.add(line, at)
                return i + 1
            self.flush()
            self.boxes = self.boxes[:kept]
        while True:
            quote, item = re.match(r" {0,3}> ?", rest), _ITEM.match(rest)
            if quote:
                self.flush()
                self.boxes.append(("block_quote", 0))
                at += quote.end()
            elif item and not _RULE.match(rest) and not (self.para and (not rest[item.end() :].strip() or (item[2][0].isdigit() and int(item[2][:-1]) != 1))):
                self.flush()
                gap = len(item[3] or " ")
                width = len(item[1]) + len(item[2]) + (gap if gap <= 4 else 1)
                self.boxes.append(("list_item", width))
                at += min(width, len(rest))
                task = _TASK.match(line.text[at:])
                if task:
                    at += task.end()
            else:
                break
            rest = line.text[at:]
            if not rest.strip():
                return i + 1
        return self.leaf(i, at, rest)

    def leaf(self, i: int, at: int, rest: str) -> int:
        line = self.lines[i]
        if self.para and re.match(r" {0,3}(=+|-+)[ \t]*$", rest):
            lead = len(rest) - len(rest.lstrip())
            self.flush(1 if "=" in rest else 2, (line.start + at + lead, line.start + at + len(rest.rstrip())))
            return i + 1
        if m := _ATX.match(rest):
            self.flush()
            if m[2] and m[2].strip():
                start = line.start + at + m.start(2)
                self.blocks.append(Block("heading", start, start + len(m[2].rstrip()), len(m[1])))
            return i + 1
        if _RULE.match(rest):
            self.opaque("thematic_break", line.start + at, line.end)
            return i + 1
        if (m := _FENCE.match(rest)) and not (m[1][0] == "`" and "`" in m[2]):
            return self.until(i, at, "code_block", lambda r: re.match(rf" {{0,3}}{re.escape(m[1][0])}{{{len(m[1])},}}[ \t]*$", r), True)
        if not self.para and re.match(r"    |\t", rest):
            return self.until(i, at, "code_block", lambda r: r.strip() and not re.match(r"    |\t", r), False)
        if not self.para and _HTML.match(rest):
            if rest.lstrip().startswith("<!--"):
                return self.until(i, at, "html_block", lambda r: "-->" in r, True, same=True)
            return self.until(i, at, "html_block", lambda r: not r.strip(), False)
        if not self.para and "|" in rest and i + 1 < len(self.lines):
            below = self.lines[i + 1].text[min(at, len(self.lines[i + 1].text)) :]
            if "-" in below and _DELIMITER.match(below) and below.count("|") + 1 >= rest.strip().strip("|").count("|") + 1 - 1 and len(_cells(Line(0, below))) == len(_cells(Line(0, rest))):
                return self.table(i, at)
        if m := _FOOTNOTE.match(rest):
            self.flush()
            at += m.end()
        self.add(line, at)
        return i + 1

    def add(self, line: Line, at: int) -> None:
        part = line.text[at:]
        lead = len(part) - len(part.lstrip())
        self.para.append((line.start + at + lead, line.start + at + len(part.rstrip())))

    def until(self, i: int, at: int, kind: str, ends, inclusive: bool, same: bool = False) -> int:
        first, k = i, i if same else i + 1
        depth = len(self.boxes)
        while k < len(self.lines):
            skip, kept = self.enter(self.lines[k])
            if kept < depth and not self.lines[k].blank:
                break
            if ends(self.lines[k].text[skip:]):
                k += inclusive
                break
            k += 1
        last = max(first, k - 1)
        while last > first and self.lines[last].blank:
            last -= 1
        self.opaque(kind, self.lines[first].start + at, self.lines[last].end)
        return k

    def table(self, i: int, at: int) -> int:
        self.flush()
        k = i
        while k < len(self.lines):
            skip, kept = self.enter(self.lines[k])
            rest = self.lines[k].text[skip:]
            if kept < len(self.boxes) or not rest.strip() or (k > i + 1 and (_ATX.match(rest) or _FENCE.match(rest) or re.match(r" {0,3}>", rest))):
                break
            if k != i + 1:
                for a, b in _cells(Line(self.lines[k].start + skip, rest)):
                    if self.text[a:b].strip():
                        self.blocks.append(Block("table", a, b))
            k += 1
        return k


def parse_markdown(text: str) -> list[Block]:
    return [b for b in _Parser(text).run() if not b.translatable or has_word(text[b.start : b.end]) or text[b.start : b.end].strip()]
