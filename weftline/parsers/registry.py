"""Parsers by markup."""

from __future__ import annotations

from pyspark.sql import DataFrame

from weftline.parsers.asciidoc import parse_asciidoc
from weftline.parsers.base import parse
from weftline.parsers.markdown import parse_markdown
from weftline.parsers.rst import parse_rst

PARSERS = {"markdown": parse_markdown, "asciidoc": parse_asciidoc, "rst": parse_rst}


def parse_files(files: DataFrame) -> DataFrame:
    """Blocks of files(path, source, markup)."""
    return parse(files, PARSERS)
