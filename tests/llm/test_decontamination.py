import random
import re
from itertools import combinations

from cairn.llm import decontamination as d


def brute(text, item, window=20, percent=80):
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    a, b = words(text), words(item)
    if len(b) < d.LEAST_WORDS:
        return False
    wide = min(window, len(b))
    for start in range(-len(b) + 1, len(a)):
        same = [0 <= start + k < len(a) and a[start + k] == b[k] for k in range(len(b))]
        if any(100 * sum(same[s : s + wide]) >= percent * wide for s in range(len(b) - wide + 1)):
            return True
    return False


def test_substitution_tolerant(spark):
    rng = random.Random(9)
    word = lambda: rng.choice("abcdefghij") + str(rng.randrange(30))
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([4, 5, 7, 8, 9, 16, 25, 40, 59, 12])]
    items += [(20, None), (21, items[6][1]), (22, "Short, words: five of-them")]
    docs = []
    for i in range(120):
        w = [word() for _ in range(rng.randrange(0, 120))]
        k, t = rng.choice(items)
        t = (t or "").split()
        if i % 3:
            for _ in range(rng.randrange(0, 1 + len(t) // 8)):
                t[rng.randrange(len(t))] = "changed"
            if i % 7 == 0:
                t = t[len(t) // 3 :]
            at = rng.randrange(len(w) + 1)
            w[at:at] = t
        docs.append((i, (", " if i % 2 else " ").join(w).upper(), 0))
    docs += [(200, None, 0), (201, "", 0), docs[1], (202, "x short words five of them", 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {(i, k) for i, t, _ in docs for k, x in items if brute(t, x)}
    for most in (1_000_000, 0):
        got = [(r.doc_id, r.item_id) for r in d.contaminated(df, bench, broadcast_keys=most).collect()]
        assert set(got) <= want, sorted(set(got) - want)
        assert len(set(got)) >= 0.97 * len(want) and len(want) > 40
    kept = d.drop_contaminated(df, bench)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, *_ in docs} - {i for i, _ in got}
    exact = {(i, k) for i, t, _ in docs for k, x in items if x and len(x.split()) > 4 and " ".join(re.findall(r"\w+", x.lower())) in " ".join(re.findall(r"\w+", (t or "").lower()))}
    assert exact <= set(got)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert d.contaminated(docs, bench).count() == 0 and d.drop_contaminated(docs, bench).count() == 0


def test_no_allowed_pattern_escapes(spark):
    """Every pattern of changed words that the comparison accepts is found, alone and across the document's ends."""
    rng = random.Random(4)
    items, docs = [], []
    for n in (5, 6, 7, 8, 9, 10, 11, 12, 13, 15, 16, 17, 20, 24):
        t = [f"w{n}x{k}" for k in range(n)]
        items.append((n, " ".join(t)))
        wide = min(n, 20)
        patterns = list(combinations(range(wide), wide // 5))
        for p in patterns if len(patterns) <= 60 else rng.sample(patterns, 60):
            docs.append(" ".join("changed" if k in p else w for k, w in enumerate(t)))
        docs += [" ".join(t), " ".join(t[wide // 5 :]), " ".join(t[: n - wide // 5]), " ".join(t[: n // 2])]
    # the only patterns of their lengths that no run of four words survives
    for n, p in ((5, (1,)), (5, (2,)), (5, (3,)), (6, (2,)), (6, (3,)), (7, (3,)), (10, (3, 6)), (11, (3, 7)), (15, (3, 7, 11)), (20, (4, 8, 12, 16))):
        docs.append(" ".join("changed" if k in p else f"w{n}x{k}" for k in range(n)))
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for percent in (80, 100, 60):
        want = {(i, k) for i, t in enumerate(docs) for k, x in items if f"w{k}x" in t and brute(t, x, percent=percent)}
        got = {(r.doc_id, r.item_id) for r in d.contaminated(df, bench, percent=percent).collect()}
        assert got == want and len(want) >= len(items), (percent, sorted(want ^ got)[:9])


def test_masks_are_complete():
    for words in range(1, 21):
        for changed in range(words // 5 + 1):
            masks = d.complete_masks(words, changed)
            laid = [{at + k for k, c in enumerate(m) if c == "1"} for m in masks for at in range(words - len(m) + 1)]
            assert all(any(x.isdisjoint(p) for x in laid) for p in combinations(range(words), changed)), (words, changed, masks)


def test_items_of_one_to_four_words(spark):
    items = [(1, "Zebra"), (2, "red, fox"), (3, "a b c"), (4, "four words in all"), (5, ""), (6, "!?"), (7, None)]
    docs = [(1, "one zebra"), (2, "the red fox"), (3, "a B c"), (4, "x four words in all x"), (5, "red x fox"), (6, "four words x all"), (7, "zebras"), (8, ""), (9, "fox red a b"), (10, "zebra")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in d.contaminated(df, bench).collect()}
    assert got == {(1, 1), (2, 2), (3, 3), (4, 4), (10, 1)}
    assert {r.doc_id for r in d.drop_contaminated(df, bench).collect()} == {5, 6, 7, 8, 9}


def test_rows_without_doc_id(spark):
    """A missing or shared doc_id doesn't keep a passage, nor drop a clean text."""
    item = "one two three four five six seven"
    docs = [(None, f"a {item}"), (None, f"a {item}"), (None, f"{item} b"), (None, "clean"), (None, None), (1, f"c {item}"), (1, "also clean"), (2, "clean")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    for most in (1_000_000, 0):
        got = [(r.doc_id, r.start) for r in d.contaminated(df, bench, broadcast_keys=most).collect()]
        assert sorted(got, key=str) == [(1, 1), (None, 0), (None, 1)]
        kept = [tuple(r) for r in d.drop_contaminated(df, bench, broadcast_keys=most).collect()]
        assert sorted(kept, key=str) == sorted([(None, "clean"), (None, None), (1, "also clean"), (2, "clean")], key=str)
