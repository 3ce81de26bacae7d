import datetime as dt

from pyspark.sql import functions as F

from weftline.parsers.registry import parse_files
from weftline.operators import reconstruct, segments
from weftline.sources import project, state

CONFIG = """
[project]
source_lang = "en"
[[sources]]
path = "docs"
pattern = "**/*.md"
output = "{dir}/{stem}.out{ext}"
[[sources]]
path = "."
pattern = "*.txt"
parser = "rst"
[[tables]]
headers = ["A"]
skip = [0, "B"]
"""


def test_scan_and_outputs(spark, tmp_path):
    for name in ("docs/a.md", "docs/a.out.md", "docs/sub/b.md", "c.txt", "docs/x.rst"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(f"# {name}\n")
    config = project.read_config(CONFIG)
    sources = project.sources_table(spark, config)
    files = project.scan_files(spark, str(tmp_path), sources)
    assert sorted(r.path for r in files.collect()) == ["c.txt", "docs/a.md", "docs/sub/b.md"]
    assert sorted(r.path for r in project.scan_files(spark, str(tmp_path), sources, "docs/sub").collect()) == ["docs/sub/b.md"]
    outputs = {r.path: r.output for r in project.resolve_output(files, sources).collect()}
    assert outputs == {"c.txt": "c.ko.txt", "docs/a.md": "docs/a.out.md", "docs/sub/b.md": "docs/sub/b.out.md"}
    assert {r.path: r.markup for r in project.select_parser(files, sources).collect()} == {"c.txt": "rst", "docs/a.md": "markdown", "docs/sub/b.md": "markdown"}
    rules = project.rules_table(spark, config).first()
    assert rules.translate is None and [(x.idx, x.header) for x in rules.skip] == [(0, None), (None, "B")]
    assert (config.settings["max_retries"], config.settings["port"]) == (3, 3000)


def test_state_round_trip(spark, tmp_path):
    big = (1 << 63) + 5
    rows = [("a/b.md", 1 - (1 << 62), k, f"section:0/block:0/seg:{k}", f"text {k} é", big - (1 << 64) if k else 7, k, "t" if k else None, {"x": "y"} if k else {}, dt.datetime(2024, 1, 2, 3, 4, 5) if k else None, ["i"] if k else []) for k in range(3)]
    df = spark.createDataFrame(rows, "path string, file_hash long, pos int, segment_id string, source string, source_hash long, context_hash long, translation string, glossary_snapshot map<string,string>, translated_at timestamp, issues array<string>")
    state.write_state(df, str(tmp_path))
    back = state.read_state(spark, str(tmp_path)).select(*df.columns).orderBy("pos")
    assert back.collect() == df.orderBy("pos").collect()
    assert '"source_hash": 9223372036854775813' in (tmp_path / ("a/b.md" + state.SUFFIX)).read_text()


def test_glossary_text(spark):
    text = '[terms."C++"]\ntranslation = "T"\nnote = "n"\n\n[terms."a"]\ntranslation = "b"\n'
    table = project.read_glossary(spark, text)
    assert project.glossary_text(table) == text


def test_documents_without_translations_come_back(spark):
    texts = ["# One\n\nA para. Two.\n\n| a | b |\n|---|---|\n| c | d |\n", "Über\n====\n\nText\n", ""]
    files = spark.createDataFrame([(i, t, m) for i, t in enumerate(texts) for m in ("markdown", "asciidoc", "rst")], "path int, source string, markup string")
    files = files.withColumn("path", F.concat_ws("/", "path", "markup"))
    blocks = parse_files(files)
    rows = segments.translatable_segments(blocks).withColumn("translation", F.lit(None).cast("string"))
    same = reconstruct.apply_splices(files, reconstruct.collect_splices(blocks, rows))
    assert all(r.output == r.source for r in same.collect())
    done = reconstruct.apply_splices(files, reconstruct.collect_splices(blocks, rows.withColumn("translation", F.upper("source")))).collect()
    assert next(r.output for r in done if r.path == "0/markdown") == "# ONE\n\nA PARA. TWO.\n\n| A | B |\n|---|---|\n| C | D |\n"
