"""AsciiDoc blocks. Delimited listings, literals, passthroughs and comments are opaque; tables give a block a cell."""

from __future__ import annotations

import re

from weftline.parsers.base import Block, has_word, lines_of

_OPAQUE = re.compile(r"(-{4,}|\.{4,}|\+{4,}|/{4,})$")
_FENCE = re.compile(r"(`{3,}|~{3,})(.*)$")
_BOX = re.compile(r"(_{4,}|={4,}|\*{4,}|--)$")
_HEADING = re.compile(r"(={1,6})[ \t]+(\S.*)$")
_META = re.compile(r"//(?!/)|:[!\w][^:\s]*!?:(?:[ \t]|$)|\[.*\]$")
_LIST = re.compile(r"[ \t]*(?:\*{1,6}|\.{1,6}|-|•|\d+\.|[A-Za-z]\.)[ \t]+(?=\S)")
_CALLOUT = re.compile(r"<(?:\d+|\.)>[ \t]+(?=\S)")
_ADMONITION = re.compile(r"(?:NOTE|TIP|IMPORTANT|WARNING|CAUTION):[ \t]+(?=\S)")
_DESCRIPTION = re.compile(r"(\S.*?)(:{2,4}|;;)(?:[ \t]+(\S.*))?$")
_TITLE = re.compile(r"\.(?=[^\s.])")
_SPEC = re.compile(r"(?:(\d+)\*)?(?:(\d+)?(?:\.(\d+))?\+)?([<^>]?(?:\.[<^>])?)([adehlmsv]?)$")
# Setext marks by heading level.
_SETEXT = "=-~^+"


def column_count(cols: str) -> int:
    """Columns that a cols attribute declares: a number, a list, or repeats such as 3*."""
    cols = cols.strip().strip('"')
    if re.fullmatch(r"\d+", cols):
        return int(cols)
    total = 0
    for part in re.split(r"[,;]", cols):
        m = re.match(r"\s*(\d+)\*", part)
        total += int(m[1]) if m else 1
    return total


def split_row(line: str) -> list[tuple[str, int, int]]:
    """(cell spec, start, end) of the cells that begin on a line; an escaped bar is text."""
    bars = [m.start() for m in re.finditer(r"(?<!\\)\|", line)]
    out = []
    for k, bar in enumerate(bars):
        stop = bars[k + 1] if k + 1 < len(bars) else len(line)
        before = line[(bars[k - 1] + 1 if k else 0) : bar]
        spec = re.search(r"(?:^|\s)(\S*)$", before)[1] if before.strip() or k == 0 else ""
        spec = spec if spec and _SPEC.match(spec) else ""
        if k + 1 < len(bars):
            following = re.search(r"(?:^|\s)(\S+)$", line[bar + 1 : stop])
            if following and _SPEC.match(following[1]):
                stop = bar + 1 + following.start(1)
        part = line[bar + 1 : stop]
        lead = len(part) - len(part.lstrip())
        out.append((spec, bar + 1 + lead, bar + 1 + len(part.rstrip())))
    return out


class Grid:
    """Which columns of coming rows are taken by cells that span rows."""

    def __init__(self, columns: int):
        self.columns, self.row, self.taken, self.column = max(1, columns), 0, set(), 0

    def place(self, spec: str) -> list[tuple[int, int]]:
        """(row, column) of a cell's copies, in order."""
        m = _SPEC.match(spec)
        copies, wide, high = int(m[1] or 1), int(m[2] or 1), int(m[3] or 1)
        out = []
        for _ in range(copies):
            while (self.row, self.column) in self.taken or self.column >= self.columns:
                self.column += 1
                if self.column >= self.columns:
                    self.row, self.column = self.row + 1, 0
            out.append((self.row, self.column))
            for r in range(high):
                for c in range(wide):
                    self.taken.add((self.row + r, self.column + c))
            self.column += wide
            if self.column >= self.columns:
                self.row, self.column = self.row + 1, 0
        return out


def parse_asciidoc(text: str) -> list[Block]:
    lines, blocks, para = lines_of(text), [], []
    boxes: list[str] = []
    header = bool(lines) and bool(re.match(r"=[ \t]+\S", lines[0].text))
    kind, tables, cols, i = "paragraph", 0, None, 0

    def emit(block: Block) -> None:
        if has_word(text[block.start : block.end]):
            blocks.append(block)

    def flush() -> None:
        nonlocal para, kind
        if para:
            quoted = any(b.startswith("_") for b in boxes)
            emit(Block("block_quote" if quoted and kind == "paragraph" else kind, para[0][0], para[-1][1]))
        para, kind = [], "paragraph"

    while i < len(lines):
        line, s = lines[i], lines[i].text.rstrip()
        if not s.strip():
            flush()
            header, i = False, i + 1
            continue
        if header and i:
            i += 1
            continue
        below = lines[i + 1].text.rstrip() if i + 1 < len(lines) else ""
        if not para and below and below[0] in _SETEXT and set(below) == {below[0]} and len(below) > 1 and abs(len(below) - len(s)) <= 1 and has_word(s) and not _OPAQUE.fullmatch(s) and not s.startswith(("|", "[", ".")):
            under = (lines[i + 1].start, lines[i + 1].start + len(below))
            emit(Block("heading", line.start, line.start + len(s), _SETEXT.index(below[0]) + 1, role="setext_title", mark=below[0], under=under))
            i += 2
            continue
        fence = _FENCE.fullmatch(s)
        if _OPAQUE.fullmatch(s) or fence:
            flush()
            close = (lambda t, m=fence[1]: set(t) == {m[0]} and len(t) >= len(m)) if fence else (lambda t, s=s: t == s)
            end = next((k for k in range(i + 1, len(lines)) if close(lines[k].text.rstrip() or " ")), None)
            if end is None:
                break
            blocks.append(Block("code_block", line.start, lines[end].end, translatable=False))
            i = end + 1
            continue
        if s == "|===":
            flush()
            end = next((k for k in range(i + 1, len(lines)) if lines[k].text.rstrip() == "|==="), len(lines))
            _table(text, lines[i + 1 : end], cols, tables, emit)
            tables, cols, i = tables + 1, None, end + 1
            continue
        if _BOX.fullmatch(s):
            flush()
            boxes = boxes[:-1] if boxes and boxes[-1] == s else [*boxes, s]
        elif m := _HEADING.match(s):
            flush()
            emit(Block("heading", line.start + m.start(2), line.start + len(s), len(m[1])))
        elif _META.match(s):
            flush()
            if m := re.search(r'cols=("[^"]*"|[^,\]]+)', s):
                cols = column_count(m[1])
        elif s == "+":
            flush()
        elif m := _LIST.match(s) or _CALLOUT.match(s):
            flush()
            kind = "list_item"
            para = [(line.start + m.end(), line.start + len(s))]
        elif (m := _ADMONITION.match(s)) and not para:
            para = [(line.start + m.end(), line.start + len(s))]
        elif (m := _DESCRIPTION.match(s)) and "://" not in m[1] and not para:
            emit(Block("list_item", line.start, line.start + m.end(1)))
            if m[3]:
                kind, para = "list_item", [(line.start + m.start(3), line.start + len(s))]
        elif (m := _TITLE.match(s)) and not para:
            emit(Block("paragraph", line.start + m.end(), line.start + len(s)))
        else:
            lead = len(line.text) - len(line.text.lstrip())
            para.append((line.start + lead, line.start + len(s)))
        i += 1
    flush()
    return blocks


def _table(text: str, lines, cols: int | None, number: int, emit) -> None:
    """Cells of a table: text up to the next bar, over line ends; the first row labels the columns."""
    found: list[list] = []
    for line in lines:
        cells = split_row(line.text)
        first = line.text.find("|")
        head = line.text if first < 0 else line.text[:first]
        if found and head.strip() and not (cells and cells[0][0] == head.strip()):
            found[-1][2] = line.start + len(head.rstrip())
        found += [[spec, line.start + a, line.start + b] for spec, a, b in cells]
    if not found:
        return
    if cols is None:
        cols = len(split_row(next(x for x in lines if "|" in x.text).text))
    grid, headers = Grid(cols), {}
    for spec, a, b in found:
        for row, column in grid.place(spec)[:1]:
            if row == 0:
                headers[column] = text[a:b]
            if b > a:
                emit(Block("table", a, b, role="table_cell", table=number, column=column, label_row=row == 0, header=headers.get(column) if row == 0 else None))
