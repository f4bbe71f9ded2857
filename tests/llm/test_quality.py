import zlib

import numpy as np

from cairn.llm import quality
from cairn.llm.shared import cut


def corpus(n):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(n):
        words = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 9))) for _ in range(rng.integers(5, 60))]
        bad = rng.random() < 0.3
        if bad:
            words = [w + "***" for w in words] if rng.random() < 0.5 else words[:2] * len(words)
        rows.append((i, " ".join(words), int(not bad)))
    return rows


def test_held_out_accuracy_and_cases(spark):
    rows = corpus(900)
    docs = spark.createDataFrame([(i, t, "s") for i, t, _ in rows] + [(-1, None, "s"), (-2, "", "s"), (3, rows[3][1], "s")], "doc_id long, text string, stats string")
    labels = spark.createDataFrame([(i, y if i % 50 else None) for i, _, y in rows], "doc_id long, quality int")
    got = quality.quality_scores(docs, labels).toPandas()
    assert len(got) == 903 and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(got.doc_id, got.held_out, strict=True))
    by = got.drop_duplicates("doc_id").set_index("doc_id").score
    held = [(by[i], y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert quality.held_out_auc(np.array([s for s, _ in held]), np.array([y for _, y in held])) > 0.97
    assert by[-1] == by[-2] and got[got.doc_id == 3].score.nunique() == 1
    kept = quality.drop_low_quality(docs, labels)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(got[got.predicted == 1].doc_id)


def test_held_out_labels_do_not_matter(spark):
    rows = corpus(300)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    out = [(zlib.crc32(str(i).encode()) % 5 == 0) for i, *_ in rows]
    one, two = (spark.createDataFrame([(i, 1 - y if o and flip else y) for (i, _, y), o in zip(rows, out, strict=True)], "doc_id long, quality int") for flip in (0, 1))
    a, b = (quality.quality_scores(docs, x).toPandas().sort_values("doc_id").score.tolist() for x in (one, two))
    assert a == b


def test_no_labels_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in quality.quality_scores(docs, labels).collect()] == [1.0]
    assert quality.quality_scores(docs.limit(0), labels).count() == 0 and quality.drop_low_quality(docs.limit(0), labels).count() == 0


def test_rising_fit():
    pools = quality.rising(np.array([0.1, 0.5, 0.3, 0.2, 0.9]), np.array([1, 1, 1, 2, 1]))
    assert [round(v, 4) for v, *_ in pools] == [0.1, 0.3, 0.9] and sum(n for *_, n in pools) == 5


def test_fit_matches_plain_ridge_on_cosine_features(spark):
    rows = corpus(400)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    model = quality.fit(cut(quality.statistics(docs)), quality.label_sample(labels))
    stats = quality.statistics_of([t for _, t, _ in rows]).astype(float)
    y = np.array([y for *_, y in rows], float)
    kept = spark.createDataFrame([(i,) for i, *_ in rows], "doc_id long").select("doc_id", quality.fold().alias("f")).toPandas().set_index("doc_id").f
    own = np.array([kept[i] not in (0, 4) for i, *_ in rows])
    x = stats[own]
    assert np.allclose(model.mean, x.mean(0)) and np.allclose(model.scale, np.sqrt(np.maximum(x.var(0), 1e-6)))
    z = np.clip((stats - model.mean) / model.scale, -6, 6)
    waves = np.cos(z @ model.project + model.shift) * np.sqrt(2 / len(model.shift))
    features = np.column_stack([waves, z / 10, np.ones(len(z))])
    weights = np.linalg.solve(features[own].T @ features[own] + 1e-4 * own.sum() * np.eye(features.shape[1]), features[own].T @ y[own])
    assert np.allclose(model.weights, weights, atol=1e-6)
    raw = np.clip(features @ weights, -1, 2)
    assert np.allclose(model.score(stats), np.interp(raw, model.knots, model.values), atol=1e-6)
    # inner products of the waves approximate a Gaussian kernel of the standardised statistics
    near = np.exp(-((z[:60, None] - z[None, :60]) ** 2).sum(2) / (2 * z.shape[1]))
    assert np.abs(waves[:60] @ waves[:60].T - near).mean() < 0.06


def test_long_texts_ties_and_repeated_rows(spark):
    rows = corpus(300)
    long = "word " * 200_000
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t, _ in rows] + [(900, long, 1, 2), (901, long, 3, 4), (5, rows[5][1], 1, 2), (5, rows[6][1], 1, 2)], "doc_id long, text string, score int, label int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(5, rows[5][2])], "doc_id long, quality int")
    got = quality.quality_scores(docs, labels).toPandas()
    assert len(got) == 304 and got[got.doc_id.isin([900, 901])].score.nunique() == 1
    kept = quality.drop_low_quality(docs, labels)
    assert kept.columns == docs.columns and kept.count() == int((got.predicted == 1).sum())
