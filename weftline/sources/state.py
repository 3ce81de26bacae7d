"""Stored translation state: one JSON document a file."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

SUFFIX = ".state.json"
# Hashes are unsigned 64-bit numbers: as bigint the larger half would be read as null.
_U64 = S.DecimalType(20, 0)
SEGMENT = S.StructType(
    [
        S.StructField("id", S.StringType()),
        S.StructField("source", S.StringType()),
        S.StructField("source_hash", _U64),
        S.StructField("context_hash", _U64),
        S.StructField("translation", S.StringType()),
        S.StructField("glossary_snapshot", S.MapType(S.StringType(), S.StringType())),
        S.StructField("translated_at", S.StringType()),
        S.StructField("issues", S.ArrayType(S.StringType())),
    ]
)
STATE = S.StructType([S.StructField("version", S.IntegerType()), S.StructField("source_hash", _U64), S.StructField("segments", S.ArrayType(SEGMENT))])


def signed(value: Column) -> Column:
    """An unsigned 64-bit number as the bigint of the same bits."""
    half, whole = F.lit("9223372036854775808").cast("decimal(20,0)"), F.lit("18446744073709551616").cast("decimal(20,0)")
    return F.when(value >= half, value - whole).otherwise(value).cast("bigint")


def unsigned(value: Column) -> Column:
    whole = F.lit("18446744073709551616").cast("decimal(20,0)")
    return F.when(value < 0, value.cast("decimal(20,0)") + whole).otherwise(value).cast("decimal(20,0)")


def read_state(spark: SparkSession, folder: str, suffix: str = SUFFIX) -> DataFrame:
    """(path, version, file_hash, pos, segment_id, source, source_hash, context_hash, translation, glossary_snapshot, translated_at, issues) of the state files below folder; path is that of the source, relative to folder."""
    raw = spark.read.schema(STATE).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").json(folder)
    base = F.lit(os.path.abspath(folder).rstrip("/") + "/") if "://" not in folder else F.lit(folder.rstrip("/") + "/")
    name = F.regexp_replace(F.url_decode(F.col("_metadata.file_path")), "^file:/+", "/")
    path = F.replace(F.substring(name, F.length(base) + 1, F.length(name)), F.lit(suffix), F.lit(""))
    out = raw.select(path.alias("path"), "version", signed(F.col("source_hash")).alias("file_hash"), F.posexplode("segments").alias("pos", "s"))
    return out.select(
        "path",
        "version",
        "file_hash",
        "pos",
        F.col("s.id").alias("segment_id"),
        "s.source",
        signed(F.col("s.source_hash")).alias("source_hash"),
        signed(F.col("s.context_hash")).alias("context_hash"),
        "s.translation",
        F.coalesce("s.glossary_snapshot", F.create_map().cast("map<string,string>")).alias("glossary_snapshot"),
        F.col("s.translated_at").cast("timestamp").alias("translated_at"),
        F.coalesce("s.issues", F.array().cast("array<string>")).alias("issues"),
    )


def write_state(rows: DataFrame, folder: str, suffix: str = SUFFIX) -> None:
    """Writes a state file for each path of rows, in order of pos, whole or not at all: each under a name of its own first, then renamed."""
    ordered = rows.groupBy("path").agg(
        F.first("file_hash").alias("file_hash"),
        F.array_sort(
            F.collect_list(
                F.struct(
                    "pos", "segment_id", "source", unsigned(F.col("source_hash")).cast("string").alias("sh"), unsigned(F.col("context_hash")).cast("string").alias("ch"),
                    "translation", F.to_json("glossary_snapshot").alias("snapshot"), F.date_format("translated_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("at"), "issues",
                )
            )
        ).alias("s"),
    )

    def save(part) -> None:
        for r in part:
            segments = [
                {"id": x.segment_id, "source": x.source, "source_hash": int(x.sh), "context_hash": int(x.ch), "translation": x.translation, "glossary_snapshot": json.loads(x.snapshot or "{}"), "translated_at": x.at, "issues": x.issues or []}
                for x in r.s
            ]
            target = os.path.join(folder, r.path + suffix)
            os.makedirs(os.path.dirname(target), exist_ok=True)
            with open(f"{target}.{os.getpid()}", "w", encoding="utf-8") as f:
                json.dump({"version": 1, "source_hash": (r.file_hash or 0) % (1 << 64), "segments": segments}, f, ensure_ascii=False, indent=2)
            os.replace(f.name, target)

    ordered.foreachPartition(save)


def state_path(path: Column, state_dir: str | None = None, suffix: str = SUFFIX) -> Column:
    """Where the state of a source lies: beside it, or at its place below state_dir; an absolute path stays beside."""
    plain = F.regexp_replace(path, r"^(\./)+", "")
    beside = F.concat(plain, F.lit(suffix))
    return beside if state_dir is None else F.when(plain.startswith("/"), beside).otherwise(F.concat(F.lit(state_dir.rstrip("/") + "/"), beside))
