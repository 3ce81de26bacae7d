"""One object with the operations of the tool, each a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.hashing import STORED, Store
from weftline.operators import coverage, evaluate, glossary, orphans, reconcile, reconstruct, segments, selection, translate
from weftline.parsers.registry import parse_files
from weftline.sources.project import select_parser


class Engine:
    """A project's files, state, glossary and sources as tables.

    files(path, source); state as of weftline.sources.state.read_state; glossary(term,
    translation, note); sources as of weftline.sources.project.sources_table. store names
    the hashes that state was written with: those of state files unless told otherwise.
    rules are table rules (weftline.operators.selection), which clear the flag of cells.
    close() frees the parsed blocks, which several operations share.
    """

    def __init__(
        self, spark: SparkSession, files: DataFrame, state: DataFrame, terms: DataFrame, sources: DataFrame, target_lang: str = "ko", store: Store = STORED, rules: DataFrame | None = None
    ):
        self.spark, self.state, self.terms, self.target_lang, self.store = spark, state, terms, target_lang, store
        self.files = select_parser(files, sources)
        parsed = parse_files(self.files)
        if rules is not None:
            cells = parsed.filter("role_kind = 'table_cell'")
            ruled = selection.apply_table_rules(cells, rules).select(*parsed.columns)
            parsed = parsed.filter("role_kind is null or role_kind <> 'table_cell'").unionByName(ruled)
        self.blocks = parsed.persist()

    def close(self) -> None:
        self.blocks.unpersist()

    def segments(self, status: str = "all") -> DataFrame:
        rows = reconcile.reconcile_status(segments.translatable_segments(self.blocks, self.store), self.state, self.terms, self.store)
        return reconcile.segments_filter(rows, status)

    def status(self) -> DataFrame:
        return reconcile.status_summary(self.segments())

    def check(self) -> bool:
        """Whether nothing is left to translate."""
        return reconcile.status_check(self.segments()).first().ok

    def coverage(self, least: int = coverage.LEAST_LINES) -> DataFrame:
        lines = coverage.lines(self.files)
        offered = coverage.span_lines(lines, self.blocks.filter("translatable and span_start is not null"))
        flagged = coverage.flagged(lines, offered)
        return coverage.coverage_report(coverage.coverage(flagged), coverage.gaps(flagged), least)

    def orphans(self) -> DataFrame:
        gone = orphans.orphan_states(self.state, self.files)
        fresh = orphans.stateless_files(self.files, self.state).select("path", self.store.content(F.col("source")).alias("file_hash"))
        new = fresh.join(segments.translatable_segments(self.blocks, self.store).select("path", "source_hash"), "path", "left")
        return orphans.orphan_report(gone, orphans.match_orphans(new, gone.select("path", "file_hash", "source_hash")))

    def evaluate(self) -> DataFrame:
        rows = evaluate.evaluate_filter(self.segments(), self.state).join(self.files.select("path", "markup"), "path")
        return evaluate.issues_combine(evaluate.eval_glossary(rows, self.terms), evaluate.mechanical(rows, self.target_lang))

    def translate(self, provider: translate.Provider, save: Callable[[DataFrame, int], DataFrame], source_lang: str = "en", max_retries: int = 3) -> DataFrame:
        asked = reconcile.group_by_block(self.segments())
        markup = self.files.select("path", "markup")
        check = lambda done: evaluate.mechanical(done.join(markup, "path"), self.target_lang)
        terms = {r.term: r.translation for r in self.terms.select("term", "translation").collect()}  # a glossary is kept by hand
        return translate.translate_evaluate_retry(asked, provider, check, save, source_lang, self.target_lang, terms, max_retries)

    def outputs(self, rows: DataFrame) -> DataFrame:
        """(path, output) with the translations of rows(path, section_idx, block_idx, seq, source, translation); lines under and over translated titles, and tables with translated cells, are drawn anew."""
        texts = reconstruct.join_translations(rows)
        splices = reconstruct.collect_splices(self.blocks, rows).unionByName(reconstruct.underline_splices(self.blocks, texts)).unionByName(reconstruct.table_splices(self.blocks, texts))
        return reconstruct.apply_splices(self.files, splices).select("path", "output")

    def set_terms(self, changes: DataFrame) -> None:
        self.terms = glossary.upsert_term(self.terms, changes)

    def remove_terms(self, gone: DataFrame) -> None:
        self.terms = glossary.remove_term(self.terms, gone)

    def glossary(self) -> DataFrame:
        return glossary.glossary_list(self.terms)
