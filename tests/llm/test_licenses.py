import re

from cairn.llm import licenses


def words(t):
    return re.findall(r"[^\W_]+", t.lower())


def runs(t):
    w = words(t)
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


def brute(text, template):
    """Greatest share of the template's shingles in a stretch about as long as it."""
    own, all_runs = set(runs(template)), runs(text or "")
    best = max((len(own & set(all_runs[i : i + 2 * len(own) + 8])) for i in range(len(all_runs))), default=0)
    return best * 100 >= len(own) * 80


def test_found_as_by_brute_force(spark):
    filler = " ".join(f"w{i}" for i in range(300))
    texts = [None, "", "one two", filler]
    for name, t in licenses.TEMPLATES.items():
        w = t.split()
        texts += [t, f"{filler} {t.upper()} {filler}", f"a {t}"]
        if len(w) > 30:
            texts += [" ".join([*w[:20], "changed", *w[21:]]), " ".join(w[: len(w) // 2]), f"{filler} " + " ".join(w[3:])]
    texts += ["Released under the MIT License. " * 40 + filler, "licensed under the apache foundation version 2"]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate([*texts, texts[4]])], "doc_id long, text string, place int")
    got = {(r.doc_id, r.license) for r in licenses.licenses_found(docs).collect()}
    want = {(i, name) for i, t in enumerate([*texts, texts[4]]) for name, x in licenses.TEMPLATES.items() if brute(t, x)}
    assert got == want and len(got) > 30


def test_own_templates_and_empty(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta")], "doc_id long, text string")
    got = licenses.licenses_found(docs, {"x": "beta gamma delta epsilon zeta", "short": "alpha beta"}).collect()
    assert sorted((r.license, r.matched, r.shingles, r.place) for r in got) == [("short", 1, 1, 0), ("x", 1, 1, 0)]
    many = spark.createDataFrame([(1, "a. B a b c"), (1, "a. B a b c"), (2, "b"), (3, None), (4, "word " * 200_000 + "a b")], "doc_id long, text string")
    got = licenses.licenses_found(many, {"ab": "A B", "b": "b", "none": "??"}).collect()
    assert sorted((r.doc_id, r.license, r.place) for r in got) == [(1, "ab", 0), (1, "b", 1), (2, "b", 0), (4, "ab", 200_000), (4, "b", 200_001)]
    assert licenses.licenses_found(docs.limit(0)).count() == 0


def test_rows_without_doc_id_are_left_out(spark):
    docs = spark.createDataFrame([(1, "Released under the MIT License"), (None, "Released under the MIT License")], "doc_id long, text string")
    assert [(r.doc_id, r.license) for r in licenses.licenses_found(docs).collect()] == [(1, "mit-notice")]


def test_long_texts_and_ties(spark):
    notice = "Released under the MIT License. "
    docs = spark.createDataFrame([(1, "word " * 100_000 + notice + "word " * 50 + notice, "x")], "doc_id long, text string, license string")
    (row,) = licenses.licenses_found(docs).collect()
    assert (row.doc_id, row.license) == (1, "mit-notice") and row.place in (99_999, 100_000)  # the first word of a window over it
