"""Prompts, answers, and translation with bounded retry over any provider."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import text as T

#: A request as a dict (source_lang, target_lang, context, glossary, segments, feedback) to the numbered answer's text.
Provider = Callable[[dict], str]

_RULES = {
    "asciidoc": "A mark before a letter does not close: double it at both ends of the term where a suffix follows.",
    "markdown": "An underscore before a letter does not close: use an asterisk where a suffix follows.",
    "rst": "A mark before a letter does not close: put an escaped space between a term and its suffix.",
    "verso": "Keep role headers and the code or formula after them as they are.",
}
_KOREAN = "Write in the formal written register throughout."


def build_prompt(source_lang: Column, target_lang: Column, markup: Column, context: Column, glossary: Column, segments: Column, feedback: Column, template: Column) -> Column:
    """glossary: map term -> translation. segments: array<struct<idx, text>>. A template with {source_lang} {target_lang} {glossary} {feedback} {context} {segments} replaces the built-in text."""
    terms = F.array_join(F.transform(F.array_sort(F.map_entries(glossary)), lambda e: F.concat(F.lit("- "), e["key"], F.lit(" → "), e["value"])), "\n")
    numbered = F.array_join(F.transform(segments, lambda s: F.concat(F.lit("["), s["idx"].cast("string"), F.lit("] "), s["text"])), "\n")
    rule = F.create_map(*(F.lit(x) for kv in _RULES.items() for x in kv))[markup]
    own = F.concat_ws(
        "\n",
        F.concat(F.lit("Translate these sentences from "), source_lang, F.lit(" to "), target_lang, F.lit(".")),
        F.lit("Answer each one as [N] translation, on one line."),
        F.lit("Keep links, addresses, emphasis marks and inline code."),
        rule,
        F.when(target_lang.startswith("ko"), F.lit(_KOREAN)),
        F.when(terms != "", F.concat(F.lit("\nTerms:\n"), terms)),
        F.when(feedback.isNotNull(), F.concat(F.lit("\nMend these faults of the last answer:\n"), feedback)),
        F.concat(F.lit("\nParagraph:\n"), context),
        F.concat(F.lit("\nSentences:\n"), numbered),
    )
    filled = template
    for name, value in (("source_lang", source_lang), ("target_lang", target_lang), ("glossary", terms), ("feedback", F.coalesce(feedback, F.lit(""))), ("context", context), ("segments", numbered)):
        filled = F.replace(filled, F.lit("{" + name + "}"), value)
    return F.when(template.isNotNull(), filled).otherwise(own)


def parse_response(answer: Column) -> Column:
    """map idx -> translation of the lines ``[N] text``; lines without a number or text don't count, the last of repeated numbers wins, null where none is left."""
    lines = F.transform(F.split(answer, "\n"), T.trim)
    pairs = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"^\[(\d+)\]", 1).try_cast("bigint").alias("k"), T.trim(F.regexp_extract(x, r"^\[\d+\](.*)$", 1)).alias("v")))
    good = F.filter(pairs, lambda p: p["k"].isNotNull() & (p["v"] != ""))
    last = F.filter(good, lambda p, i: ~F.exists(F.slice(good, i + 2, F.size(good)), lambda q: q["k"] == p["k"]))
    return F.when(F.size(good) > 0, F.map_from_entries(last))


def parse_response_for(answer: Column, indexes: Column) -> Column:
    """As parse_response; a request of one segment also takes a bare answer."""
    bare = (F.size(indexes) == 1) & (T.trim(answer) != "")
    return F.coalesce(parse_response(answer), F.when(bare, F.map_from_entries(F.array(F.struct(F.get(indexes, F.lit(0)).cast("bigint").alias("k"), T.trim(answer).alias("v"))))))


class RateLimit:
    """Least time between requests of one worker, longer after refusals and shorter after successes."""

    def __init__(self, interval: float = 0.1, most: float = 64.0):
        self.interval, self.most, self.factor, self.until = interval, most, 1.0, 0.0

    def wait(self, now: float) -> float:
        """Seconds to wait at ``now``; the request counts as made then."""
        delay = max(0.0, self.until - now)
        self.until = now + delay + self.interval * self.factor
        return delay

    def succeeded(self, remaining: int | None = None) -> None:
        self.factor *= 0.9
        if remaining is not None:
            self.factor *= 2 if remaining == 0 else 0.8 if remaining > 100 else 1
        self._clip()

    def refused(self, now: float, retry_after: float | None = None) -> None:
        self.factor *= 2
        if retry_after is not None:
            self.until = max(self.until, now + retry_after)
        self._clip()

    def _clip(self) -> None:
        self.factor = min(self.most, max(1.0, self.factor))


def offline(request: dict) -> str:
    """A provider without a network: terms replaced, each sentence tagged with the target language. The same request always has the same answer."""
    out = []
    for idx, text in request["segments"]:
        for term, translation in sorted(request["glossary"].items()):
            text = text.replace(term, translation)
        out.append(f"[{idx}] <{request['target_lang']}> {text}")
    return "\n".join(out)


PROVIDERS: dict[str, Callable[..., Provider]] = {"offline": lambda **_: offline}


def provider_factory(kind: str, **options) -> Provider:
    """The provider registered under kind; others are added to PROVIDERS."""
    if kind not in PROVIDERS:
        raise ValueError(f"no provider {kind!r}; there are {', '.join(sorted(PROVIDERS))}")
    return PROVIDERS[kind](**options)


_ASKED = "path {0}, section_idx int, block_idx int, attempt int, seq long, idx int, translation string"


def translate(blocks: DataFrame, provider: Provider, source_lang: str, target_lang: str, glossary: dict[str, str] | None = None) -> DataFrame:
    """Calls the provider once for each block of group_by_block (with feedback and attempt, where present): a row a segment, translation null where the answer lacks it."""
    fields = dict(blocks.dtypes)
    has = set(blocks.columns)
    terms = dict(glossary or {})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        for rows in batches:
            out = []
            for r in rows.itertuples(index=False):
                asked = [(s["idx"], s["source"], s["seq"]) for s in r.segments]
                request = {
                    "source_lang": source_lang,
                    "target_lang": target_lang,
                    "context": r.context,
                    "glossary": terms,
                    "feedback": getattr(r, "feedback", None),
                    "segments": [(i, s) for i, s, _ in asked],
                }
                answer = provider(request)
                got = {int(m[1]): m[2].strip() for m in re.finditer(r"^\s*\[(\d+)\](.*)$", answer, re.M) if m[2].strip()}
                if not got and len(asked) == 1 and answer.strip():
                    got = {asked[0][0]: answer.strip()}
                attempt = getattr(r, "attempt", 1)
                out += [(r.path, r.section_idx, r.block_idx, attempt, seq, i, got.get(i)) for i, _, seq in asked]
            yield pd.DataFrame(out, columns=["path", "section_idx", "block_idx", "attempt", "seq", "idx", "translation"])

    return blocks.select(*[c for c in blocks.columns if c in has]).mapInPandas(run, _ASKED.format(fields["path"]))


def translate_evaluate_retry(blocks: DataFrame, provider: Provider, check: Callable[[DataFrame], DataFrame], save: Callable[[DataFrame, int], DataFrame], source_lang: str, target_lang: str, glossary: dict[str, str] | None = None, max_retries: int = 3) -> DataFrame:
    """Translates blocks and asks anew, whole blocks with the faults found, at most max_retries times.

    check(rows with path, seq, source, translation) gives issues (path, seq, severity,
    message) that call for a retry. save(rows, attempt) writes a round's rows and returns
    them as read back, which ends lineage. The latest answer to each segment is kept, a
    faulty one too; a segment missing from an answer is no fault.
    """
    rows, left, attempt = None, blocks.withColumn("attempt", F.lit(1)).withColumn("feedback", F.lit(None).cast("string")), 1
    sources = blocks.select("path", "section_idx", "block_idx", F.inline("segments")).select("path", "seq", "source")
    while True:
        done = save(translate(left, provider, source_lang, target_lang, glossary).filter("translation is not null"), attempt)
        rows = done if rows is None else rows.unionByName(done)
        if attempt > max_retries:
            break
        issues = check(done.join(sources, ["path", "seq"])).filter("severity = 'error'")
        faults = done.join(issues.select("path", "seq", "message"), ["path", "seq"]).groupBy("path", "section_idx", "block_idx").agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "message"))), lambda x: x["message"]), "\n").alias("feedback")
        )
        left = blocks.join(faults, ["path", "section_idx", "block_idx"]).withColumn("attempt", F.lit(attempt + 1))
        if left.limit(1).count() == 0:
            break
        attempt += 1
    return rows.groupBy("path", "section_idx", "block_idx", "seq", "idx").agg(F.max_by("translation", "attempt").alias("translation"), F.max("attempt").alias("attempt"))


def token_usage(requests: DataFrame) -> DataFrame:
    return requests.agg(F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"))


def run_outcome(files: DataFrame, failed: DataFrame, done: DataFrame) -> DataFrame:
    """(processed, failed, translated) of files, failed(path) and done(path, seq)."""
    bad = files.select("path").join(failed.select("path").distinct().withColumn("_bad", F.lit(True)), "path", "left")
    counts = bad.agg(F.count_if(F.col("_bad").isNull()).alias("processed"), F.count("_bad").alias("failed"))
    return counts.crossJoin(done.agg(F.count("seq").alias("translated")))
