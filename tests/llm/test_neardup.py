import random
import re

from cairn.llm import neardup


def brute(docs):
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t or ""))
        sets[i] = {tuple(w[k : k + 2]) for k in range(len(w) - 1)} if len(w) > 1 else {tuple(w)} - {()}
    ids, comp = sorted(sets), {i: i for i in sets}
    find = lambda i: i if comp[i] == i else find(comp[i])
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((find(a), find(b)))
                comp[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


def make_docs(seed, n, edits):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    docs, base = [], [rng.choice(words) for _ in range(120)]
    for i in range(n):
        kind = rng.randrange(6)
        if kind < 3:
            w = list(base)
            for _ in range(rng.randrange(edits)):
                w[rng.randrange(len(w))] = rng.choice(words)
        elif kind == 3 and docs:
            w = (rng.choice(docs)[1] or "").split(" ")
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = rng.choice(words)
        else:
            w = [rng.choice(words) for _ in range(rng.choice([1, 2, 3, 60, 300]))]
        docs.append((i, " ".join(w)))
    return docs


def test_components_match_brute_force(spark):
    docs = make_docs(3, 220, 12)
    docs += [(300, None), (301, ""), (302, "one"), (303, "ONE"), (304, " \t"), (305, docs[5][1].upper()), (306, "one\x1ftwo"), (307, "é x")]
    df = spark.createDataFrame([(i, t, i) for i, t in docs], "doc_id long, text string, n_shingles long").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect()}
    want = brute(docs)
    assert got == {i: (n, c, i == c) for i, (n, c) in want.items()}
    repeated = [d for d in docs if d[0] in (0, 3, 11, 300, 302)]
    kept = neardup.drop_near_duplicates(df.union(spark.createDataFrame([(i, t, i) for i, t in repeated], df.schema)))
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, (_, c) in want.items() if i == c]


def test_borderline_group(spark, monkeypatch):
    """Members differ so much that many pairs are no links; centres alone don't reach all."""
    docs = make_docs(8, 150, 22)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = {i: c for i, (_, c) in brute(docs).items()}
    for size in (12, 2):
        monkeypatch.setattr(neardup, "SMALL", size)
        monkeypatch.setattr(neardup, "REST", 9)
        monkeypatch.setattr(neardup, "BLOCK", 40)
        assert {r.doc_id: r.component_id for r in neardup.near_duplicates(df).collect()} == want


def test_empty_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.near_duplicates(empty).count() == 0 and neardup.drop_near_duplicates(empty).count() == 0
    rows = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (None, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in neardup.near_duplicates(rows).collect()) == [(0, 0, True), (0, 0, True), (1, 1, True)]


def test_texts_that_share_an_id_are_judged_each(spark):
    docs = make_docs(5, 40, 8)
    docs += [(2, docs[9][1] + " more"), (2, "something of its own"), (2, docs[2][1]), (30, docs[4][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    row = [1000 * k + i for k, (i, _) in enumerate(docs)]
    apart = brute([(r, t) for r, (_, t) in zip(row, docs, strict=True)])
    groups = {}
    for r, (i, _) in zip(row, docs, strict=True):
        groups.setdefault(apart[r][1], []).append(i)
    want = sorted((i, apart[r][0], min(groups[apart[r][1]])) for r, (i, _) in zip(row, docs, strict=True))
    got = neardup.near_duplicates(df).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    kept = {(r.doc_id, r.text) for r in neardup.drop_near_duplicates(df).collect()}
    assert (2, "something of its own") in kept and len(kept) == len(set(apart[r][1] for r in row))


def test_stage_judges_rows_without_id_by_their_text(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (7, "a b c d e f"), (None, "q r s"), (None, "q r s"), (None, None), (None, "")]
    got = neardup.drop_near_duplicates(spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, rep int, set int"))
    assert got.columns == ["doc_id", "text", "rep", "set"]
    found = sorted((r.doc_id or 0, r.text or "") for r in got.collect())
    assert found.count((0, "q r s")) == 1 and sum(t == "a b c d e f" for _, t in found) == 1


def test_very_long_texts_and_blocks_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL", 2)
    monkeypatch.setattr(neardup, "REST_BYTES", 200_000)
    monkeypatch.setattr(neardup, "BLOCK_BYTES", 400_000)
    rng = random.Random(4)
    base = [f"w{rng.randrange(9000)}" for _ in range(12_000)]
    docs = []
    for i in range(14):
        w = list(base)
        for _ in range(rng.choice([10, 700, 1500])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(9000)}"
        docs.append((i, " ".join(w)))
    want = {i: c for i, (_, c) in brute(docs).items()}
    got = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in got.collect()} == want


def test_many_loose_clusters_in_one_list(spark, monkeypatch):
    """Groups that share half of their words meet in long lists without a largest cluster."""
    monkeypatch.setattr(neardup, "SMALL", 3)
    rng = random.Random(9)
    shared = [f"s{k}" for k in range(70)]
    docs = []
    for g in range(12):
        own = [f"g{g}_{k}" for k in range(30)]
        for _ in range(5):
            w = shared + own
            for _ in range(rng.randrange(5)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(99)}"
            docs.append((len(docs), " ".join(w)))
    want = {i: c for i, (_, c) in brute(docs).items()}
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()} == want
