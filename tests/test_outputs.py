from pyspark.sql import functions as F

from weftline.api import Engine
from weftline.operators import segments
from weftline.parsers.registry import parse_files


def test_lines_of_translated_titles_are_drawn_anew(spark):
    sources = [("a.rst", "=====\nTitle\n=====\n\nText.\n\nPart\n----\n\nEnd.\n", "rst"), ("b.md", "Title\n=====\n\nText.\n", "markdown"), ("c.md", "Kept\n====\n", "markdown")]
    engine = Engine.__new__(Engine)
    engine.files = spark.createDataFrame(sources, "path string, source string, markup string")
    engine.blocks = parse_files(engine.files)
    new = F.when(F.col("source") == "Title", "A longer title").when(F.col("source") == "Part", "제목입니다")
    rows = segments.translatable_segments(engine.blocks).withColumn("translation", new)
    got = {r.path: r.output for r in engine.outputs(rows).collect()}
    assert got == {
        "a.rst": f"{'=' * 14}\nA longer title\n{'=' * 14}\n\nText.\n\n제목입니다\n{'-' * 10}\n\nEnd.\n",
        "b.md": f"A longer title\n{'=' * 14}\n\nText.\n",
        "c.md": "Kept\n====\n",
    }
