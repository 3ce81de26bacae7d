from collections import Counter, defaultdict

from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.functions.hashing import context_hash
from weftline.plans import inputs, registry

TEXTS = ["Same here. Same here. Other.\nSame here.\nSame here. Last one.", "One. Two. One.\nTwo. One.\n" * 3, "Alone. Once.\nNever again.", "Again.\n" * 12, ""]


def test_queries_over_all_segments(spark, tmp_path):
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(TEXTS * 4)], "doc_id long, text string, lang string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = inputs.segments(spark, str(tmp_path))
    old = inputs.state(rows).withColumn("idx", T.flat_index(F.col("segment_id"))).orderBy("path", "pos").collect()
    new = rows.withColumn("idx", T.flat_index(F.col("segment_id"))).withColumn("current", context_hash(F.col("source_hash"))).orderBy("path", "seq").collect()
    stored, want, claimed = defaultdict(list), {}, set()
    for o in old:
        stored[o.path, o.source_hash].append(o)
    for n in new:
        free = [(abs(o.idx - n.idx), o.pos, o) for o in stored[n.path, n.source_hash] if (o.path, o.pos) not in claimed]
        if not free:
            want[n.path, n.seq] = "Pending"
            continue
        o = min(free, key=lambda x: x[:2])[2]
        claimed.add((o.path, o.pos))
        want[n.path, n.seq] = "Pending" if o.translation is None else "ContextChanged" if o.context_hash != n.current else "Translated"
    assert len({(n.path, n.source_hash) for n in new}) < len(new)
    run = lambda name: registry.queries()[name](spark, str(tmp_path)).collect()
    assert {(r.path, r.seq): r.status for r in run("reconcile_status")} == want
    counts, total = Counter(want.values()), len(want)
    (s,) = run("status_summary")
    assert (s.total, s.translated, s.pending, s.contextchanged, s.stale, s.glossarystale) == (total, counts["Translated"], counts["Pending"], counts["ContextChanged"], 0, 0)
    assert abs(s.percent - 100 * counts["Translated"] / total) < 1e-5 and s.files == len({n.path for n in new})
    assert [tuple(r) for r in run("status_check")] == [(total - counts["Translated"], False)]
    assert dict(tuple(r) for r in run("status_counts")) == dict(counts)
    open_ = Counter(p for (p, _), v in want.items() if v != "Translated")
    assert {r.path: r.pending for r in run("pending_per_file")} == {i: open_[i] for i in range(len(TEXTS) * 4)}
    assert {(r.path, r.seq) for r in run("high_priority")} == {k for k, v in want.items() if v == "Pending"}
    blocks = defaultdict(list)
    for n in new:
        if want[n.path, n.seq] != "Translated":
            blocks[n.path, n.block_idx].append(n.source)
    assert {(r.path, r.block_idx): (r.n, r.asked) for r in run("group_by_block")} == {k: (len(v), " ".join(v)) for k, v in blocks.items()}
