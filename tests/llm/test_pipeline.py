import random
import re

import numpy as np
import public_tokenizers
import pytest

from cairn.llm import packing, pii

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t.lower())


def shingles(t):
    w = words(t)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} - {()}


def tables(spark, folder):
    rng = random.Random(12)
    good = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(n)).capitalize() + "."
    items = [(k, good(25)) for k in range(4)]
    rows, labels = [], []
    for i in range(260):
        kind = rng.randrange(8)
        t = good(rng.randrange(20, 90))
        if kind == 0:
            t = " ".join(w + "***" for w in t.split())
        elif kind == 1 and rows:
            w = (rows[rng.randrange(len(rows))][1] or "").split(" ")
            w[len(w) // 2] = "edited"
            t = " ".join(w)
        elif kind == 2:
            t = t + " " + rng.choice(items)[1] + " " + good(9)
        elif kind == 3:
            t = t + " write to ana.b@mail.example.com now"
        rows.append((i, t, "en", "s", len(t)))
        if kind not in (1, 2, 3):
            labels.append((i, int(kind != 0), 0))
    rows += [(1000, None, None, None, None), (1001, "", "en", "s", 0), rows[5]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, items


def test_run_matches_brute_force(spark, tmp_path):
    rows, items = tables(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["keep_quality", "keep_distinct", "keep_clean_of_benchmark", "mask_private", "pack_sequences"]
    first = corpus_pipeline.keep_quality(spark, docs, str(tmp_path))
    assert first.columns == docs.columns
    kept = {r.doc_id: r.text for r in first.collect()}
    marred = {i for i, t, *_ in rows if t and "***" in t}
    assert not marred & set(kept) and len(set(i for i, *_ in rows) - marred - set(kept)) <= 3

    comp = {i: i for i in kept}
    find = lambda i: i if comp[i] == i else find(comp[i])
    sets = {i: shingles(t or "") for i, t in kept.items()}
    ids = sorted(kept)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                p, q = sorted((find(a), find(b)))
                comp[q] = p
    single = [i for i in ids if find(i) == i]
    assert len(single) < len(ids)
    clean = [i for i in single if not any(x[1].lower().rstrip(".") in (kept[i] or "").lower() for x in items)]
    assert len(clean) < len(single)

    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert set(got.doc_id) == set(clean)
    tokens = packing.tokens(public_tokenizers.path("word_bpe_49k.json"))
    masks = 0
    for i, g in got.sort_values("start").groupby("doc_id"):
        text = kept[i] or ""
        (spans,) = pii.found_spans([text], pii.default_field())
        masks += len(spans)
        want = tokens(pii.masked(text, spans)) + np.array([2], "<u4").tobytes()
        assert b"".join(map(bytes, g["ids"])) == want
    assert masks
