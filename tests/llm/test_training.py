"""What classifiers learn, against plain forms: word vectors, network slopes and temperature, language counts, ties."""

import math
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from duelgrid.llm import langid, quality

SF = "/root/testdata/sf0.001"


def test_word_vectors_are_sums_of_neighbours(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(25).select("text")
    texts = [r.text or "" for r in docs.collect()] + ["one two three two one", "alone", ""]
    sample = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    index, reader = quality.index_vectors(quality.WORDS, 1), quality.Reader()
    plain = defaultdict(lambda: np.zeros(quality.DIMENSIONS))
    for t in texts:
        ids = reader.read(t)[0].tolist()
        for k, w in enumerate(ids):
            for d in range(1, quality.REACH + 1):
                for other in (k - d, k + d):
                    if 0 <= other < len(ids):
                        plain[w] += index[ids[other]]
    got = quality.word_vectors(sample)
    assert set(np.flatnonzero(np.abs(got).sum(1))) == {w for w, v in plain.items() if np.abs(v).sum()}
    for w, v in plain.items():
        assert np.allclose(got[w], v / (np.linalg.norm(v) or 1.0), atol=1e-6)


def loss(p, x, y):
    w1, b1, w2, b2 = p
    s = np.tanh(x @ w1 + b1) @ w2 + b2
    return np.mean(np.logaddexp(0, s) - y * s) + quality.DECAY / 2 * ((w1**2).sum() + (w2**2).sum())


def test_network_descends_its_loss_along_the_slopes(monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 2 * quality.DIMENSIONS + quality.EXTRA))
    y = (x[:, 0] > 0).astype(float)
    net = quality.Network(np.zeros((0, x.shape[1])), np.zeros(0))
    start = [p.copy() for p in net.p]
    monkeypatch.setattr(quality, "EPOCHS", 1)
    monkeypatch.setattr(quality, "BATCH", 40)
    net._fit(x, y, rng)
    # the first step of this optimiser goes by its rate against the sign of each slope
    for k, (before, after) in enumerate(zip(start, net.p)):
        at = tuple(rng.integers(0, n) for n in before.shape)
        ahead, behind = [p.copy() for p in start], [p.copy() for p in start]
        ahead[k][at] += 1e-5
        behind[k][at] -= 1e-5
        slope = (loss(ahead, x, y) - loss(behind, x, y)) / 2e-5
        assert abs(slope) < 1e-7 or np.sign(before[at] - after[at]) == np.sign(slope)
        assert np.abs(before - after).max() <= quality.RATE * 1.0001
    assert loss(net.p, x, y) < loss(start, x, y)


def test_temperature_is_the_best_of_many():
    rng = np.random.default_rng(2)
    z = rng.normal(0, 4, 500)
    y = (rng.random(500) < 1 / (1 + np.exp(-z / 3))).astype(float)
    net = quality.Network(np.zeros((0, 2 * quality.DIMENSIONS + quality.EXTRA)), np.zeros(0))
    net._calibrate(z, y)
    of = lambda t: np.mean(np.logaddexp(0, z / t) - y * z / t)
    assert of(net.temperature) <= min(of(t) for t in np.exp(np.linspace(-3, 3, 400))) + 1e-9 and 2 < net.temperature < 4.5


def test_a_score_of_one_half_predicts_one(spark):
    got = spark.createDataFrame([(0.5,), (0.4999999,)], "score double").select((F.col("score") >= 0.5).cast("int").alias("predicted"))
    assert [r.predicted for r in got.collect()] == [1, 0]


def test_language_counts_are_the_plain_ones(spark):
    rows = [(k, t, lang) for k, (t, lang) in enumerate([("Der Hund, der bellt", "de"), ("das Haus das", "de"), ("the dog the house", "en"), ("a b-c", "en"), (None, "en")])]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2))
    words = {"de": Counter("der hund der bellt das haus das".split()), "en": Counter("the dog the house a b c".split())}
    grams = {n: {lang: Counter(g for w, k in c.items() for g in langid.grams(w, n) for _ in range(k)) for lang, c in words.items()} for n in range(1, 6)}
    assert model.languages == ["de", "en"]
    known = {w for lang, c in words.items() for w in c}
    assert set(model.words) == known
    for n in range(1, 6):
        assert set(model.tables[n]) == {g for lang, c in grams[n].items() for g, k in c.items() if k > 1 or n < 3}
    for k, lang in enumerate(model.languages):
        total = sum(words[lang].values())
        for w in known:
            want = math.log(words[lang][w] + langid.SMOOTHING) - math.log(total + langid.SMOOTHING * (len(known) + 1))
            assert abs(model.matrix[model.words[w], k] - want) < 1e-5


def test_equally_likely_languages_go_to_the_first_by_name(spark):
    rows = [(k, "same words here", lang) for k, lang in enumerate(("xx", "aa", "mm"))]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    asked = spark.createDataFrame([(1, "same words"), (2, "unseen")], "doc_id long, text string")
    assert {r.lang_pred for r in langid.with_language(asked, model).collect()} == {"aa"}
