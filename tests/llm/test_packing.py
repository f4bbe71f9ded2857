import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from cairn.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("abé'sT 1.,!\n\t ́ \x1d\x85中½"), max_size=40))
def test_words_encode_like_the_whole(text):
    t = packing.tokens(PATH)
    assert t(text) == t.whole(text).tobytes()


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aBé'sTÑ 1.,!\n日½"), max_size=30), min_size=1, max_size=5))
def test_parts_are_forgotten_and_learnt_again(texts):
    t = test_parts_are_forgotten_and_learnt_again.__dict__.setdefault("tokens", packing.Tokens(PATH, most=12))
    for _ in range(2):
        assert [x.tolist() for x in t.batch(texts)] == [t.whole(x).tolist() for x in texts]
    assert len(t.number) == len(t.starts) - 1 == len(t.used) and t.starts[-1] == len(t.ids)


def test_special_marks_go_whole():
    t = packing.tokens(PATH)
    for text in ("a <|endoftext|> b", "a<|startoftext|>b", "<|x|>"):
        assert t(text) == t.whole(text).tobytes()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 7), st.integers(0, 5)), min_size=1, max_size=12))
def test_cuts_cost_the_least(gaps):
    places = np.concatenate([[0], np.cumsum([g for g, _ in gaps])])
    penalty = np.array([0, *(p for _, p in gaps)])
    n, length = len(places), 7

    def cost(cuts):
        return sum(length - (places[b] - places[a]) + penalty[b] for a, b in zip([0, *cuts], cuts, strict=False))

    best = [0] + [10**9] * (n - 1)
    for j in range(1, n):
        best[j] = min(best[i] + length - (places[j] - places[i]) + penalty[j] for i in range(j) if places[j] - places[i] <= length)
    assert cost(packing.choose_cuts(places, penalty, length)) == best[-1]


def test_pieces(spark):
    texts = {0: "One two. Three four! " * 900, 1: None, 2: "", 3: "word " * 20000, 4: "short", 5: "One. " * 3000}
    rows = [(i, texts[i % 6], 1) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int").coalesce(2)
    got = packing.pack(docs, PATH, block=50_000).toPandas()
    t = packing.tokens(PATH)
    for i, g in got.sort_values(["doc_id", "start"]).groupby("doc_id"):
        want = t(texts[i % 6] or "") + np.array([2], "<u4").tobytes()
        assert b"".join(map(bytes, g["ids"])) == want and set(g["doc_tokens"]) == {len(want) // 4}
        assert list(g["start"]) == [0, *g["length"].cumsum()[:-1]]
    fills = []
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert list(g["offset"]) == [0, *g["length"].cumsum()[:-1]] and g["length"].sum() <= 4096
        fills.append(g["length"].sum())
    assert sum(fills) / (4096 * len(fills)) > 0.97
    digests = packing.piece_digests(packing.pack(docs, PATH)).toPandas()
    row = digests[digests.doc_id == 4].iloc[0]
    assert row.ids_crc32 == zlib.crc32(t("short") + np.array([2], "<u4").tobytes())


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_rows_with_one_id_are_packed_each(spark):
    docs = spark.createDataFrame([(1, "one two"), (1, "one two"), (1, "three"), (None, "four")], "doc_id long, text string").coalesce(1)
    got = [(r.doc_id, r.start, r.length, r.sequence_id, r.offset) for r in packing.pack(docs, PATH).collect()]
    assert got == [(1, 0, 3, 0, 0), (1, 0, 3, 0, 3), (1, 0, 2, 0, 6), (None, 0, 2, 0, 8)]
