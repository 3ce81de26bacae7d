"""Blocks, lines with offsets, and the table function that applies a parser to files."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = (
    "array<struct<section_idx:int,block_idx:int,block_type:string,heading_level:int,raw_content:string,span_start:bigint,span_end:bigint,translatable:boolean,"
    "role_kind:string,table_idx:int,column_idx:int,label_row:boolean,header:string,mark:string,under_start:bigint,under_end:bigint,over_start:bigint,over_end:bigint>>"
)


@dataclass
class Block:
    """A block with its span in characters; end is exclusive."""

    kind: str
    start: int
    end: int
    level: int | None = None
    translatable: bool = True
    role: str = "none"
    table: int | None = None
    column: int | None = None
    label_row: bool | None = None
    header: str | None = None
    mark: str | None = None
    under: tuple[int, int] | None = None
    over: tuple[int, int] | None = None
    #: Of a block that is no span of the source, as a cell that wraps: its text.
    text: str | None = None


@dataclass
class Line:
    start: int
    text: str

    @property
    def end(self) -> int:
        return self.start + len(self.text)

    @property
    def blank(self) -> bool:
        return not self.text.strip()


def lines_of(text: str) -> list[Line]:
    """Lines without their line ends; a final line feed opens no line."""
    out, at = [], 0
    for part in text.splitlines(keepends=True) if "\r" not in text and "\x0b" not in text else _split(text):
        out.append(Line(at, part.rstrip("\r\n")))
        at += len(part)
    return out


def _split(text: str) -> list[str]:
    parts = text.split("\n")
    return [p + "\n" for p in parts[:-1]] + ([parts[-1]] if parts[-1] else [])


def has_word(text: str) -> bool:
    return any(map(str.isalnum, text))


class Offsets:
    """Byte offsets of character offsets of one text."""

    def __init__(self, text: str):
        self.text, self.plain = text, text.isascii()
        self.at, self.bytes = 0, 0

    def __call__(self, char: int) -> int:
        if self.plain:
            return char
        if char < self.at:
            self.at = self.bytes = 0
        self.bytes += len(self.text[self.at : char].encode())
        self.at = char
        return self.bytes


def rows(text: str, blocks: list[Block]) -> list[tuple]:
    """Blocks as rows: sections counted by headings of level 2 or less, byte spans."""
    of, section, within, out = Offsets(text), 0, 0, []
    for b in blocks:
        if b.level is not None and b.level <= 2 and within:
            section, within = section + 1, 0
        spans = [None if s is None else (of(s[0]), of(s[1])) for s in ((b.start, b.end) if b.text is None else None, b.under, b.over)]
        flat = [x for s in spans for x in (s or (None, None))]
        out.append((section, within, b.kind, b.level, text[b.start : b.end] if b.text is None else b.text, *flat[:2], b.translatable, b.role, b.table, b.column, b.label_row, b.header, b.mark, *flat[2:]))
        within += 1
    return out


def parse(files: DataFrame, parsers: dict[str, Callable[[str], list[Block]]]) -> DataFrame:
    """Blocks of files(path, source, markup), a row a block; one Arrow UDF, then all is native."""
    names = [x.split(":")[0] for x in BLOCK[len("array<struct<") : -2].split(",")]

    @F.pandas_udf(BLOCK)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for sources, markups in batches:
            yield pd.Series([[dict(zip(names, r, strict=True)) for r in rows(s or "", parsers.get(m, parsers["markdown"])(s or ""))] for s, m in zip(sources, markups, strict=True)])

    return files.select("path", "markup", F.inline(run("source", "markup")))
