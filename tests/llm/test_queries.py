"""The registered opN_ queries and the pipeline against plain computations over a small set of tables."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import sentencepiece
from test_dedup import lines_removed, roots, word_sets
from test_packing import check
from tokenizers import Tokenizer

import corpus_pipeline
from weftline.llm import media_chunks, registry, toxicity
from weftline.llm.piece_codec import model_path
from weftline.llm.word_tokens import BYTE_BPE, tokenizer_path

WORDS = {"en": ["the", "house", "and", "river", "walks", "over", "green"], "de": ["der", "fluß", "und", "häuser", "geht", "über", "grün"]}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """(folder, texts by doc_id, vectors): null, empty and long texts, copies, near copies, repeated lines, toxic and bad documents."""
    rnd = random.Random(12)
    names = [f"name{i}" for i in range(500)]
    docs, labels = [], []
    for i in range(400):
        lang = rnd.choice(list(WORDS))
        lines = [" ".join(rnd.choice(WORDS[lang] + names) for _ in range(rnd.randint(8, 30))) + "." for _ in range(rnd.randint(1, 4))]
        toxic, good = i % 5 == 0, i % 4 != 0
        if toxic:
            lines[0] = "Blarghead snotwit " + lines[0]
        text = "\n".join(lines) if good else " | ".join(w + "##" for w in " ".join(lines).split())
        docs.append([i, text, lang, "s"])
        labels.append((i, int(good), int(toxic)))
    for i in range(400, 460):
        copied = docs[rnd.choice([1, 2, 3, 6, 7])][1].split(" ")
        for _ in range(rnd.randint(0, 2)):
            copied[rnd.randrange(len(copied))] = rnd.choice(names)
        docs.append([i, " ".join(copied) + rnd.choice(["", "\n" + docs[9][1].split("\n")[0]]), "en", "s"])
        labels.append((i, 1, 0))
    docs += [[500, None, None, None], [501, "", "en", "s"], [502, " \n\n", None, "s"], [503, "A  b\n\n    c <|endoftext|>", "en", "s"], [504, "the river walks " * 4000, "en", "s"]]
    labels += [(500, None, None), (501, 0, 0), (504, 1, 0)]
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 32))
    vectors = [(centres[i % 12] + rng.normal(size=32) * 0.15).tolist() for i in range(150)] + [[0.0] * 32, None]
    folder = str(tmp_path_factory.mktemp("tables"))
    docs = [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in docs]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>").write.parquet(f"{folder}/embeddings.parquet")
    return folder, {d[0]: d[1] for d in docs}, vectors


def rows(spark, tables, name):
    df = registry.queries()[name](spark, tables[0])
    found = df.collect()
    key = "vec_id" if "vec_id" in df.columns else "doc_id"
    ids = range(len(tables[2])) if key == "vec_id" else tables[1]
    if name != "op8_packing":
        assert sorted(r[key] for r in found) == sorted(ids)  # a row for each row of the table
    return found


@pytest.mark.parametrize(("name", "least"), [("op1_toxicity", 0.5), ("op10_quality", 0.3)])
def test_scores(spark, tables, name, least):
    for r in rows(spark, tables, name):
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= least)
        if r.doc_id < 400 and r.held_out:
            assert r.predicted == int(r.doc_id % 5 == 0 if name == "op1_toxicity" else r.doc_id % 4 != 0)


def test_op2(spark, tables):
    library = sentencepiece.SentencePieceProcessor(model_file=model_path())
    for r in rows(spark, tables, "op2_sentencepiece"):
        ids = library.encode(tables[1][r.doc_id] or "", add_bos=True, add_eos=True)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_op3(spark, tables):
    for r in rows(spark, tables, "op3_language_id"):
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
        letters = any(c.isalpha() for c in tables[1][r.doc_id] or "")
        assert r.lang_pred in WORDS if letters else r.lang_pred == "und"


def test_op4(spark, tables):
    library, at = Tokenizer.from_file(tokenizer_path(BYTE_BPE)), 0
    for r in sorted(rows(spark, tables, "op4_token_files")):
        ids = [*library.encode(tables[1][r.doc_id] or "", add_special_tokens=False).ids, 0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_op5(spark, tables):
    by_text = {}
    for r in rows(spark, tables, "op5_media_chunks"):
        payload = media_chunks.padded(tables[1][r.doc_id])
        assert r.n_bytes == len((tables[1][r.doc_id] or "").encode()) and r.payload_bytes == len(payload) and len(payload) % 192 == 0
        assert (r.payload_sha256, r.tail_crc32) == (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        by_text.setdefault(payload, set()).add((r.media_bytes, r.media_sha256, r.feature))
    assert all(len(x) == 1 for x in by_text.values())


def test_op6(spark, tables):
    x = np.array(tables[2][:150])
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    top = roots(150, np.argwhere(near).tolist())
    assert near.any()
    want = [(i, int(near[i].sum()), top[i], top[i] == i) for i in range(150)] + [(i, 0, i, True) for i in (150, 151)]
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in rows(spark, tables, "op6_embedding_dedup")) == want


def without_repeats(texts):
    """The texts without the lines that brute force finds to repeat earlier ones."""
    ids = sorted(texts)
    gone = lines_removed([texts[i] for i in ids])
    assert gone
    return {i: None if texts[i] is None else "\n".join(x for k, x in enumerate(texts[i].split("\n")) if (at, k) not in gone) for at, i in enumerate(ids)}


def test_op7(spark, tables):
    assert {r.doc_id: r.text for r in rows(spark, tables, "op7_line_dedup")} == without_repeats(tables[1])


def test_op8(spark, tables):
    check(rows(spark, tables, "op8_packing"), tables[1])


def groups(texts, words):
    ids = sorted(texts)
    sets = word_sets([texts[i] for i in ids], words)
    links = [(a, b) for a in range(len(ids)) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return {i: (len(s), ids[t]) for i, s, t in zip(ids, sets, roots(len(ids), links), strict=True)}


def test_op9(spark, tables):
    want = groups(tables[1], 2)
    assert any(c != i for i, (_, c) in want.items())
    found = rows(spark, tables, "op9_minhash_dedup")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_pipeline(spark, tables):
    """Each stage against brute force over its own input, in the given order; run() has the last one's rows."""
    folder = tables[0]
    docs = corpus_pipeline.read(spark, folder, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "line_dedup", "minhash_dedup", "packing"]
    scores = {r.doc_id: r.score for r in toxicity.toxicity(docs, corpus_pipeline.read(spark, folder, "labels")).collect()}
    texts, kept = dict(tables[1]), None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.written(stage(spark, docs, folder), "tested")
        assert out.columns == docs.columns and out.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
        kept = {r.doc_id: r.text for r in out.collect()}
        if name == "toxicity":
            want = {i: t for i, t in texts.items() if scores[i] < 0.5}
            assert not any(i % 5 == 0 for i in kept if i < 400) and all(i in kept for i in range(400) if i % 5)
        elif name == "quality":
            want = {i: t for i, t in texts.items() if i in kept}
            assert not any(i % 4 == 0 for i in kept if i < 400) and all(i in kept for i in texts if i < 400 and i % 4)
        elif name == "line_dedup":
            left = without_repeats(texts)
            want = {i: t for i, t in left.items() if t == texts[i] or (t or "").strip()}
        else:
            # one document of each group, whichever
            group = {i: c for i, (_, c) in groups(texts, 5).items()}
            assert sorted(group[i] for i in kept) == sorted(set(group.values()))
            want = {i: texts[i] for i in kept}
        assert kept == want
        texts, docs = kept, out
    want = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    check(want, texts)
    got = corpus_pipeline.run(spark, folder).collect()
    check(got, texts)
