import random
import zlib

import pytest

from weftline.llm import language_id, quality, toxicity

WORDS = {"en": ["the", "house", "and", "river", "walks", "over", "green"], "de": ["der", "fluß", "und", "häuser", "geht", "über", "grün"], "es": ["la", "casa", "y", "río", "camina", "sobre", "verde"]}
EDGES = [(90_001, None, None), (90_002, "", "en"), (90_003, "1234 !!", "en"), (90_004, "the house " * 9000, "en"), (90_005, " ", None)]


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(4)
    docs, labels = [], []
    for i in range(900):
        lang = rnd.choice(list(WORDS))
        words = [rnd.choice(WORDS[lang]) for _ in range(rnd.randint(8, 80))]
        toxic, good = i % 5 == 0, i % 4 != 0
        if toxic:
            words.insert(rnd.randrange(len(words)), rnd.choice(["Blarghead", "snotwit"]))
        text = " ".join(words).capitalize() + "." if good else " | ".join(w + "##" for w in words)
        docs.append((i, text, lang, "s"))
        labels.append((i, int(good), int(toxic)))
    docs += [(*e, "s") for e in EDGES] + [docs[0]]
    labels += [(None, 1, 1), (90_006, None, None), labels[0]]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {x[0]: x for x in labels}


def held_out(doc_id, mod, at):
    return zlib.crc32(str(doc_id).encode()) % mod == at


def test_toxicity(corpus):
    docs, labels, truth = corpus
    rows = toxicity.toxicity(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.doc_id < 90_000 and held_out(r.doc_id, 5, 0)]
    assert sum((r.score >= 0.5) == bool(truth[r.doc_id][2]) for r in held) > 0.97 * len(held)


def test_quality(corpus):
    docs, labels, truth = corpus
    network, prior = quality.train(docs, labels)
    assert 0.6 < prior < 0.9
    rows = quality.score(docs, network).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.doc_id < 90_000 and held_out(r.doc_id, 5, 0)]
    assert sum((r.score >= 0.3) == bool(truth[r.doc_id][1]) for r in held) > 0.97 * len(held)


def test_language(corpus):
    docs = corpus[0]
    rows = language_id.identify(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        if r.doc_id in (90_001, 90_002, 90_003, 90_005):
            assert r.lang_pred == "und" and r.score == 0
        elif held_out(r.doc_id, 3, 1):
            assert r.lang_pred == r.lang
    flagged = [r for r in rows if r.rejected and r.lang_pred != "und"]
    assert len(flagged) < 0.1 * len(rows)


def test_nothing_to_learn_from(corpus, spark):
    docs, labels, _ = corpus
    some = docs.limit(5)
    assert all(0 <= r.score <= 1 for r in toxicity.toxicity(some, labels.limit(0)).collect())
    assert all(r.score == 0.5 for r in quality.quality(some, labels.limit(0)).collect())
    assert all(r.lang_pred == "und" for r in language_id.predict(some, language_id.train(docs.limit(0))).collect())
    assert toxicity.toxicity(docs.limit(0), labels).count() == quality.quality(docs.limit(0), labels).count() == language_id.identify(docs.limit(0)).count() == 0


def test_class_prior_of_a_mixture():
    import numpy as np

    rng = np.random.default_rng(1)
    p, n = rng.normal(0.8, 0.1, 4000), rng.normal(0.3, 0.1, 4000)
    assert abs(quality.class_prior(p[:2000], np.concatenate([p[2000:3400], n[:600]])) - 0.7) < 0.06


def test_toxicity_is_the_plain_computation(corpus, monkeypatch):
    """Features, ratios and fit against dictionaries and sets of n-grams; long texts read in parts have the same features."""
    import numpy as np

    docs, labels, truth = corpus

    def plain(text):
        text = " " + " ".join((text or "").lower().split()) + " "
        return {text[k : k + n] for n in toxicity.ORDERS for k in range(len(text) - n + 1)}

    text = "Some WORDS\tand  wörds, 漢字 and 😀 again; " * 40
    grams = plain(text)
    whole = toxicity.buckets(text)
    assert abs(len(whole) - len(grams)) <= 1  # but for a collision
    monkeypatch.setattr(toxicity, "PART", 64)
    assert toxicity.buckets(text).tolist() == whole.tolist()
    sample = toxicity.labelled_sample(docs, labels, "toxic").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 for r in sample)
    sets = [(r.label, plain(r.text)) for r in sample]
    n, t = len(sets), sum(label for label, _ in sets)
    want = {}
    for gram in set().union(*(s for _, s in sets)):
        have = [label for label, s in sets if gram in s]
        p, q = sum(have) + toxicity.SMOOTHING, len(have) - sum(have) + toxicity.SMOOTHING
        r = np.log(p / (t + 2 * toxicity.SMOOTHING)) - np.log(q / (n - t + 2 * toxicity.SMOOTHING))
        if len(have) >= toxicity.LEAST_DOCS and abs(r) >= toxicity.LEAST_ERRORS * np.sqrt(1 / p + 1 / q):
            want[int(toxicity._ngrams(gram)[-1])] = r
    found = toxicity._sets_of(toxicity.labelled_sample(docs, labels, "toxic"))
    got = {r.bucket: r.ratio for r in toxicity.ratios(toxicity._counted(found), n, t).collect()}
    assert len(set(got) ^ set(want)) <= 2 and all(abs(got[k] - want[k]) < 1e-9 for k in set(got) & set(want))


def test_fit_is_the_plain_gradient():
    """A few documents: weights as plain sums over documents give them."""
    import numpy as np

    ratio, kept = np.array([1.5, -2.0, 0.7]), np.array([5, 9, 11])
    sets, y = [np.array([0], np.int32), np.array([0, 2], np.int32), np.array([1], np.int32), np.array([], np.int32)], [1, 1, 0, 0]
    model = toxicity.fit(sets, y, kept, ratio, 0.5)
    dense = np.zeros((4, 3))
    for row, s in zip(dense, sets, strict=True):
        row[s] = ratio[s]
    w, b, m, v, mb, vb = np.full(3, 0.02), 0.0, np.zeros(3), np.zeros(3), 0.0, 0.0
    for step in range(1, toxicity.STEPS + 1):
        gap = (1 / (1 + np.exp(-(dense @ w + b))) - y) / 4
        g, gb = gap @ dense + toxicity.PENALTY * w / 3, gap.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g**2, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
        rate = 0.02 / (1 - 0.9**step)
        w, b = w - rate * m / (np.sqrt(v / (1 - 0.99**step)) + 1e-8), b - rate * mb / (np.sqrt(vb / (1 - 0.99**step)) + 1e-8)
    w = 0.9 * w + 0.1 * np.abs(w).mean()
    assert np.allclose(model.weights[kept], w * ratio, atol=1e-5) and abs(model.intercept - b) < 1e-6


def test_samples_are_bounded_and_whole_where_they_fit(spark):
    from weftline.llm.common import spread_sample

    rows = spark.createDataFrame([(k, "hot" if k % 50 else "rare") for k in range(20_000)], "doc_id long, lang string")
    counts = {r.lang: r.n for r in spread_sample(rows, "doc_id", 500, by="lang").groupBy("lang").agg({"doc_id": "count"}).toDF("lang", "n").collect()}
    assert counts == {"hot": 500, "rare": 400}


def test_quality_features_in_parts(monkeypatch):
    import numpy as np

    text = "One line. Two 22 lines!\n(three) «vier» 漢字\n" * 30
    whole = quality.features(text)
    monkeypatch.setattr(quality, "PART", 7)
    assert np.allclose(quality.features(text), whole)
