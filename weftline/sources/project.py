"""Project configuration, glossary files, source scans, and where outputs go."""

from __future__ import annotations

import json
import os
import tomllib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.selection import glob_pattern

RULES = "rule_idx int, files string, pattern string, headers array<string>, translate array<struct<idx:int,header:string>>, skip array<struct<idx:int,header:string>>"
# Extensions by parser; any other is Markdown.
EXTENSIONS = {"adoc": "asciidoc", "asciidoc": "asciidoc", "asc": "asciidoc", "rst": "rst", "rest": "rst", "lean": "verso"}
PARSERS = ("markdown", "asciidoc", "rst", "verso")
# Defaults of what a configuration leaves out.
DEFAULTS = {"glossary": "glossary.toml", "port": 3000, "max_retries": 3, "evaluate": True, "style": True, "concurrency": 4, "target": "build/tree", "dist": "dist"}


@dataclass
class Config:
    source_lang: str = "en"
    target_lang: str = "ko"
    state_dir: str | None = None
    sources: list[dict] = field(default_factory=list)
    tables: list[dict] = field(default_factory=list)
    settings: dict = field(default_factory=lambda: dict(DEFAULTS))
    build: dict | None = None


def read_config(text: str) -> Config:
    """Configuration of TOML text with its defaults; the build section rejects unknown keys."""
    raw = tomllib.loads(text)
    project, translation, evaluation = (raw.get(k, {}) for k in ("project", "translation", "evaluation"))
    settings = dict(DEFAULTS)
    settings |= {"glossary": project.get("glossary", DEFAULTS["glossary"]), "port": raw.get("server", {}).get("port", DEFAULTS["port"])}
    settings |= {k: translation.get(k, DEFAULTS[k]) for k in ("max_retries", "concurrency")}
    settings |= {"evaluate": translation.get("evaluate", True), "style": evaluation.get("style", True)}
    build = raw.get("build")
    if build is not None:
        unknown = set(build) - {"base", "target", "dist", "overlay", "step", "command", "outputs", "targets"}
        if unknown:
            raise ValueError(f"unknown build keys: {', '.join(sorted(unknown))}")
        settings |= {k: build.get(k, DEFAULTS[k]) for k in ("target", "dist")}
    return Config(project.get("source_lang", "en"), project.get("target_lang", "ko"), project.get("state_dir"), raw.get("sources", []), raw.get("tables", raw.get("table", [])), settings, build)


def rules_table(spark: SparkSession, config: Config) -> DataFrame:
    """The table rules in order of declaration; a column is named by number or header."""

    def refs(items: list | None) -> list | None:
        return None if items is None else [(x, None) if isinstance(x, int) else (None, x) for x in items]

    rows = []
    for i, r in enumerate(config.tables):
        glob = r.get("files")
        rows.append((i, glob, glob_pattern(glob) if glob else None, r.get("headers", []), refs(r.get("translate")), refs(r.get("skip"))))
    return spark.createDataFrame(rows, RULES)


def read_glossary(spark: SparkSession, text: str) -> DataFrame:
    """(term, translation, note) of TOML ``[terms.X]`` sections."""
    terms = tomllib.loads(text).get("terms", {})
    return spark.createDataFrame([(k, v["translation"], v.get("note")) for k, v in terms.items()], "term string, translation string, note string")


def glossary_text(glossary: DataFrame) -> str:
    """TOML of a glossary, which an editor keeps: its terms are few."""
    quote = lambda s: json.dumps(s, ensure_ascii=False)
    out = []
    for r in glossary.orderBy("term").collect():
        out.append(f"[terms.{quote(r.term)}]\ntranslation = {quote(r.translation)}\n" + (f"note = {quote(r.note)}\n" if r.note else ""))
    return "\n".join(out)


def load_project(folder: str, name: str) -> tuple[Config, str]:
    """(configuration, glossary text) of a folder; the configuration must exist, a missing glossary is empty."""
    with open(os.path.join(folder, name), encoding="utf-8") as f:
        config = read_config(f.read())
    path = os.path.join(folder, config.settings["glossary"])
    if not os.path.exists(path):
        return config, ""
    with open(path, encoding="utf-8") as f:
        return config, f.read()


def sources_table(spark: SparkSession, config: Config) -> DataFrame:
    rows = [(i, s["path"].rstrip("/"), s.get("pattern", "**/*.md"), glob_pattern(s.get("pattern", "**/*.md")), s.get("parser"), s.get("output")) for i, s in enumerate(config.sources)]
    return spark.createDataFrame(rows, "source_idx int, dir string, glob string, pattern string, parser string, output string")


def scan_files(spark: SparkSession, folder: str, sources: DataFrame, below: str = "") -> DataFrame:
    """(path, source) of the files of folder that a source's glob takes (``**/*.md`` where there is none), below a path, without those that are another one's output."""
    base = os.path.abspath(folder).rstrip("/") + "/"
    raw = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(folder)
    name = F.regexp_replace(F.url_decode(F.col("_metadata.file_path")), "^file:/+", "/")
    files = raw.select(F.substring(name, len(base) + 1, 1 << 30).alias("path"), F.col("value").alias("source"))
    return selected(files, sources, below)


def selected(files: DataFrame, sources: DataFrame, below: str = "") -> DataFrame:
    if sources.limit(1).count() == 0:
        found = files.filter(F.col("path").rlike(glob_pattern("**/*.md")))
    else:
        inside = F.when(F.col("dir").isin("", "."), F.col("path")).otherwise(F.expr("substring(path, length(dir) + 2)"))
        under = F.col("dir").isin("", ".") | F.col("path").startswith(F.concat("dir", F.lit("/")))
        found = files.join(F.broadcast(sources.select("dir", "pattern")), under & F.rlike(inside, F.col("pattern")), "left_semi")
    if below not in ("", "."):
        below = below.rstrip("/")
        found = found.filter((F.col("path") == below) | F.col("path").startswith(below + "/"))
    outputs = resolve_output(found.select("path"), sources).select(F.col("output").alias("path")).distinct()
    return found.dropDuplicates(["path"]).join(outputs, "path", "left_anti")


def resolve_output(files: DataFrame, sources: DataFrame) -> DataFrame:
    """files with output: the template of the first source whose folder holds the path (its glob is not asked), else ``{stem}.ko{ext}`` beside it."""
    under = F.col("dir").isin("", ".") | F.col("path").startswith(F.concat("dir", F.lit("/")))
    first = files.select("path").join(F.broadcast(sources.select("source_idx", "dir", F.col("output").alias("template"))), under).groupBy("path").agg(F.min_by(F.struct("dir", "template"), "source_idx").alias("s"))
    joined = files.join(first, "path", "left")
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.regexp_extract(name, r"[^.](\.[^.]+)$", 1)
    stem = F.when(ext == "", name).otherwise(F.expr("substring(element_at(split(path, '/'), -1), 1, length(element_at(split(path, '/'), -1)) - length(regexp_extract(element_at(split(path, '/'), -1), '[^.](\\\\.[^.]+)$', 1)))"))
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    beside = F.concat(F.when(folder == "", "").otherwise(F.concat(folder, F.lit("/"))), stem, F.lit(".ko"), ext)
    filled = F.col("s.template")
    for key, value in (("dir", folder), ("stem", stem), ("ext", ext), ("path", F.when(F.col("s.dir").isin("", "."), F.col("path")).otherwise(F.expr("substring(path, length(s.dir) + 2)")))):
        filled = F.replace(filled, F.lit("{" + key + "}"), value)
    return joined.withColumn("output", F.coalesce(filled, beside)).drop("s")


def select_parser(files: DataFrame, sources: DataFrame) -> DataFrame:
    """files with markup: the parser of the first source whose folder and glob take the path, if it names one; else by extension. An unknown name is Markdown."""
    inside = F.when(F.col("dir").isin("", "."), F.col("path")).otherwise(F.expr("substring(path, length(dir) + 2)"))
    under = F.col("dir").isin("", ".") | F.col("path").startswith(F.concat("dir", F.lit("/")))
    named = files.select("path").join(F.broadcast(sources.filter("parser is not null")), under & F.rlike(inside, F.col("pattern"))).groupBy("path").agg(F.min_by("parser", "source_idx").alias("_parser"))
    return files.join(named, "path", "left").withColumn("markup", F.when(F.col("_parser").isin(*PARSERS), F.col("_parser")).when(F.col("_parser").isNotNull(), "markdown").otherwise(by_extension(F.col("path")))).drop("_parser")


def by_extension(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    table = F.create_map(*(F.lit(x) for kv in EXTENSIONS.items() for x in kv))
    return F.coalesce(table[ext], F.lit("markdown"))
