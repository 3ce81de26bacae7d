"""Rules over (source, translation) pairs. Each is a Column of issues: array<struct<evaluator, severity, kind, message>>."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from weftline.functions import text as T
from weftline.operators import glossary as G

ISSUES = "array<struct<evaluator:string,severity:string,kind:string,message:string>>"
# Polite endings outside the formal register.
POLITE = ("세요", "어요", "아요", "해요", "예요", "에요", "네요", "지요", "죠")


def _issue(evaluator: str, kind: str, message: Column, severity: str = "error") -> Column:
    return F.struct(F.lit(evaluator).alias("evaluator"), F.lit(severity).alias("severity"), F.lit(kind).alias("kind"), message.alias("message"))


def _none() -> Column:
    return F.array().cast(ISSUES)


def _when(bad: Column, issue: Column) -> Column:
    return F.when(F.coalesce(bad, F.lit(False)), F.array(issue)).otherwise(_none())


def _each(items: Column, evaluator: str, kind: str, message) -> Column:
    return F.transform(items, lambda x: _issue(evaluator, kind, message(x))).cast(ISSUES)


def eval_link(source: Column, translation: Column) -> Column:
    """One issue for each occurrence of a source address that the translation lacks, in order."""
    kept = T.extract_urls(translation)
    lost = F.filter(T.extract_urls(source), lambda u: ~F.array_contains(kept, u))
    return _each(lost, "link", "link_broken", lambda u: F.concat(F.lit("the translation lacks the address "), u))


_NAMED = r"(?<![\p{IsAlphabetic}\p{N}`_:])(?:`([^`<]+)`_(?!_)|([\p{IsAlphabetic}\p{N}]+(?:[-.+][\p{IsAlphabetic}\p{N}]+)*)_(?![\p{IsAlphabetic}\p{N}_]))"
_ANONYMOUS = r"(?<![\p{IsAlphabetic}\p{N}`_])(?:`[^`]+`__|[\p{IsAlphabetic}\p{N}]+(?:[-.+][\p{IsAlphabetic}\p{N}]+)*__)(?![\p{IsAlphabetic}\p{N}_])"
_LITERAL = r"``(?:(?!``).)*``"


def rst_named_refs(text: Column) -> Column:
    """Named references outside literals, each once: (check, shown). A quoted phrase is checked without its quotes, so that it may get an alias; a word is checked with its underscore."""
    prose = F.regexp_replace(text, _LITERAL, "")
    written = F.array_distinct(F.regexp_extract_all(prose, F.lit(f"({_NAMED})"), F.lit(1)))
    phrase = lambda r: F.regexp_extract(r, "^`([^`]+)`_$", 1)
    return F.transform(written, lambda r: F.struct(F.when(r.startswith("`"), phrase(r)).otherwise(r).alias("check"), r.alias("shown")))


def rst_anon_refs(text: Column) -> Column:
    return F.regexp_count(F.regexp_replace(text, _LITERAL, ""), F.lit(_ANONYMOUS))


def eval_link_rst(source: Column, translation: Column) -> Column:
    lost = F.filter(rst_named_refs(source), lambda r: ~F.contains(translation, r["check"]))
    named = _each(lost, "link", "link_broken", lambda r: F.concat(F.lit("the reference names its target and must stay: "), r["shown"]))
    counts = rst_anon_refs(source), rst_anon_refs(translation)
    return F.concat(named, _when(counts[0] != counts[1], _issue("link", "link_broken", F.format_string("anonymous references: %d in the source, %d in the translation", *counts))))


_CURVED = r'"`|`"|\'`|`\''


def mark_runs(text: Column) -> Column:
    """Runs of back quotes, without those of curved quotes."""
    return F.regexp_count(F.regexp_replace(text, _CURVED, ""), F.lit("`+"))


def emphasis_runs(text: Column, underscore: bool) -> Column:
    return F.regexp_count(text, F.lit(r"\*+|_+" if underscore else r"\*+"))


def eval_format_runs(source: Column, translation: Column, markup: Column) -> Column:
    """Back-quote runs and emphasis runs must be as many as in the source."""
    ticks = mark_runs(source), mark_runs(translation)
    low = markup.isin("markdown", "verso")
    stars = tuple(F.when(low, emphasis_runs(x, True)).otherwise(emphasis_runs(x, False)) for x in (source, translation))
    return F.concat(
        _when(ticks[0] != ticks[1], _issue("format", "format_lost", F.format_string("code marks: %d in the source, %d in the translation", *ticks))),
        _when(stars[0] != stars[1], _issue("format", "format_lost", F.format_string("emphasis marks: %d in the source, %d in the translation", *stars))),
    )


def eval_format_quotes(source: Column, translation: Column, markup: Column) -> Column:
    """AsciiDoc: a curved quote that a word character follows does not close."""
    glued = r"`[\"'](?=[\p{IsAlphabetic}\p{N}_])"
    bad = (markup == "asciidoc") & F.rlike(translation, F.lit(glued)) & ~F.rlike(source, F.lit(glued))
    return _when(bad, _issue("format", "format_lost", F.lit("a curved quote is followed by a letter and stays open")))


_VERSO = r"(\{[A-Za-z][^}]*\}|\$\$?`[^`]*`)"


def verso_tokens(text: Column) -> Column:
    """Sorted role headers and formulas."""
    return F.array_sort(F.regexp_extract_all(text, F.lit(_VERSO), F.lit(1)))


def eval_format_verso(source: Column, translation: Column, markup: Column) -> Column:
    bad = (markup == "verso") & (verso_tokens(source) != verso_tokens(translation))
    return _when(bad, _issue("format", "format_lost", F.lit("role headers or formulas differ from the source")))


def line_start_construct(text: Column) -> Column:
    """What block construct a text would open at a line's start; null for prose."""
    t = F.regexp_replace(text, r"(?U)^\s+", "")
    return (
        F.when((t == "..") | t.startswith(".. "), "explicit markup")
        .when(t.rlike(r"^\.[^. \t]"), "block title")
        .when(t.rlike(r"^[*+-][ \t]"), "list item")
        .when(t.rlike(r"^=[ \t]"), "section title")
        .when(t.rlike(r"^#[ \t]"), "heading")
        .when(t.rlike(r"^>[ \t]"), "block quote")
        .when(t.startswith("|"), "table cell")
        .when(t.startswith("//"), "comment")
        .when(t.startswith("[") & t.endswith("]"), "attribute line")
        .when(t.rlike(r"(?U)^:[^:\s]+:"), "attribute entry")
    )


def eval_format_line_start(source: Column, translation: Column) -> Column:
    opened = line_start_construct(translation)
    bad = opened.isNotNull() & ~opened.eqNullSafe(line_start_construct(source))
    return _when(bad, _issue("format", "format_lost", F.concat(F.lit("the translation opens a construct the source does not: "), opened)))


def off_register_endings(text: Column) -> Column:
    """Sentence ends outside the formal register: at most the last six syllables of each."""
    tails = F.transform(F.split(text, r"\."), lambda p: F.regexp_extract(p, "([가-힣]+)$", 1))
    polite = "(?:" + "|".join(POLITE) + ")$"
    off = F.filter(tails, lambda t: (t != "") & ((t.endswith("다") & ~t.endswith("니다")) | t.rlike(polite)))
    return F.transform(off, lambda t: F.concat(F.lit("…"), F.right(t, F.lit(6)), F.lit(".")))


def eval_ending(source: Column, translation: Column, target: Column) -> Column:
    found = off_register_endings(translation)
    bad = target.startswith("ko") & F.regexp_replace(source, r"(?U)\s+$", "").endswith(".") & (F.size(found) > 0)
    return _when(bad, _issue("ending", "style_issue", F.concat(F.lit("sentences leave the formal register: "), F.array_join(found, ", "))))


def open_marks(text: str, mark: str) -> tuple[int, int]:
    """(pairs, left open) of a constrained mark: it opens after no word character and before no white space, and closes after no white space and before no word character."""
    pairs, at, end = 0, None, len(text)
    for m in re.finditer(rf"(?<!{re.escape(mark)}){re.escape(mark)}(?!{re.escape(mark)})", text):
        before = text[m.start() - 1] if m.start() else " "
        after = text[m.end()] if m.end() < end else " "
        word = lambda c: c.isalnum() or c == "_"
        if at is not None and not before.isspace() and not word(after):
            pairs, at = pairs + 1, None
        elif at is None and not word(before) and not after.isspace():
            at = m.start()
    return pairs, int(at is not None)


@pandas_udf(StringType())
def _pairs(sources: pd.Series, translations: pd.Series, markups: pd.Series) -> pd.Series:
    def one(source: str | None, translation: str | None, markup: str | None) -> str | None:
        if source is None or translation is None:
            return None
        marks = {"asciidoc": "`*_", "markdown": "_", "verso": "_"}.get(markup or "", "")
        said = []
        for mark in marks:
            (a, a_open), (b, b_open) = open_marks(source, mark), open_marks(translation, mark)
            if a_open:
                continue
            if b_open:
                said.append(f"{mark} is opened and cannot close")
            elif a != b:
                said.append(f"{mark} pairs: {a} in the source, {b} in the translation")
        return "; ".join(said) or None

    return pd.Series([one(*x) for x in zip(sources, translations, markups, strict=True)], dtype=object)


def eval_format_pairs(source: Column, translation: Column, markup: Column) -> Column:
    """Constrained pairs must form as in the source, unless the source itself leaves one open."""
    said = _pairs(source, translation, markup)
    return _when(said.isNotNull(), _issue("format", "format_lost", said))


_RST_GLUED = r"(?<![\p{IsAlphabetic}\p{N}_`*\\])(``[^`]+``|`[^`]+`_{0,2}|\*\*[^*]+\*\*|\*[^*\s][^*]*\*)(?=[\p{IsAlphabetic}\p{N}])"


def eval_format_rst(source: Column, translation: Column, markup: Column) -> Column:
    """reStructuredText: a pair that a letter follows is not recognised."""
    found = F.regexp_extract_all(translation, F.lit(_RST_GLUED), F.lit(1))
    bad = (markup == "rst") & (F.size(found) > 0) & (F.regexp_count(source, F.lit(_RST_GLUED)) == 0)
    return _when(bad, _issue("format", "format_lost", F.concat(F.lit("inline markup touches a letter: "), F.array_join(found, ", "))))


def restore_nbsp(source: Column, translation: Column) -> Column:
    """translation with the source's code payloads where they differ from its own by no-break spaces alone."""
    spans = F.regexp_extract_all(source, F.lit("`([^`]*)`"), F.lit(1))
    nbsp = F.filter(spans, lambda s: F.contains(s, F.lit(" ")))
    return F.aggregate(nbsp, translation, lambda acc, s: F.replace(acc, F.concat(F.lit("`"), F.replace(s, F.lit(" "), F.lit(" ")), F.lit("`")), F.concat(F.lit("`"), s, F.lit("`"))))


def eval_style(verdict: Column) -> Column:
    """Issues of a judge's answer, by its first line: GOOD has none, ACCEPTABLE warns, anything else is an error."""
    lines = F.split(T.trim(verdict), "\n")
    first = F.upper(T.trim(F.get(lines, F.lit(0))))
    rest = T.trim(F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), "\n"))
    return (
        F.when(verdict.isNull() | first.startswith("GOOD"), _none())
        .when(first.startswith("ACCEPTABLE"), F.array(_issue("style", "style_issue", rest, "warning")))
        .otherwise(F.array(_issue("style", "style_issue", rest)))
    )


def eval_glossary(rows: DataFrame, glossary: DataFrame) -> DataFrame:
    """(path, seq, evaluator, severity, kind, message) for each term of the source whose translation the target lacks, whatever the case."""
    found = G.term_join(rows.withColumn("source", G.enforced(F.col("source"), F.col("markup"))).select("path", "seq", "source", "translation"), glossary)
    lost = found.filter(~F.contains(F.lower("translation"), F.lower("term_translation")))
    said = F.concat(F.lit("the term "), F.col("term"), F.lit(" must be rendered "), F.col("term_translation"))
    return lost.select("path", "seq", _issue("glossary", "glossary_mismatch", said).alias("i")).select("path", "seq", "i.*")


def mechanical(rows: DataFrame, target: str) -> DataFrame:
    """(path, seq, evaluator, severity, kind, message) of all rules that need no judge, for rows(path, seq, source, translation, markup)."""
    s, t, m = F.col("source"), F.col("translation"), F.col("markup")
    rst = F.when(m == "rst", eval_link_rst(s, t)).otherwise(_none())
    found = F.concat(
        eval_link(s, t), rst, eval_format_runs(s, t, m), eval_format_pairs(s, t, m), eval_format_quotes(s, t, m), eval_format_rst(s, t, m), eval_format_verso(s, t, m), eval_format_line_start(s, t), eval_ending(s, t, F.lit(target))
    )
    return rows.filter("translation is not null").select("path", "seq", F.inline(found))


def issues_combine(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def passed(rows: DataFrame, issues: DataFrame) -> DataFrame:
    """(path, seq, passed, n_issues): passed where no issue is an error."""
    by = issues.groupBy("path", "seq").agg(F.count("message").alias("n"), F.count_if(F.col("severity") == "error").alias("errors"))
    return rows.select("path", "seq").join(by, ["path", "seq"], "left").select("path", "seq", (F.coalesce("errors", F.lit(0)) == 0).alias("passed"), F.coalesce("n", F.lit(0)).alias("n_issues"))


def evaluate_filter(rows: DataFrame, states: DataFrame) -> DataFrame:
    return rows.filter("status = 'Translated'").join(states.select("path").distinct(), "path", "left_semi")


def issue_totals(rows: DataFrame, issues: DataFrame) -> DataFrame:
    """Segments checked and issues found, per file and over all (path null)."""
    counted = passed(rows, issues)
    return counted.rollup("path").agg(F.count("seq").alias("checked"), F.coalesce(F.sum("n_issues"), F.lit(0)).alias("issues"))


def batches_of(rows: DataFrame, n: int) -> Iterator[DataFrame]:
    """rows in n parts by hash of their path, for judges that are called part by part."""
    for k in range(n):
        yield rows.filter(F.pmod(F.xxhash64("path"), F.lit(n)) == k)
