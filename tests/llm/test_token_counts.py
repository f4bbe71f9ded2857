import random

import public_tokenizers

from cairn.llm import token_counts
from cairn.llm.token_counts import UNKNOWN, LongestMatch


def brute(word, initial, inner):
    at, n = 0, 0
    while at < len(word):
        pieces = inner if at else initial
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), 0)
        if not end:
            return UNKNOWN + 1
        at, n = end, n + 1
    return n


def test_random_vocabularies():
    rng = random.Random(2)
    word = lambda m: "".join(rng.choice("abc") for _ in range(rng.randrange(1, m)))
    for _ in range(300):
        initial, inner = {word(5) for _ in range(rng.randrange(1, 12))}, {word(5) for _ in range(rng.randrange(1, 12))}
        m = LongestMatch(initial, inner)
        for _ in range(40):
            w = word(14)
            assert m.count(w) == brute(w, initial, inner), (w, initial, inner)


def test_table(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.createDataFrame([(1, "the cat sat", "x"), (2, None, "x"), (3, "", "x"), (4, "a" * 30000, "x"), (1, "the cat sat", "x"), (5, "☃￿", "x")], "doc_id long, text string, n_words string")
    got = sorted(token_counts.token_counts(docs, path).collect(), key=lambda r: (r.doc_id, r.n_words))
    assert [(r.doc_id, r.n_words) for r in got] == [(1, 3), (1, 3), (2, 0), (3, 0), (4, 1), (5, 1)]
    assert got[0].n_tokens >= 3 and got[2].n_tokens == 0 and got[5].n_unknown == 1


def test_full_vocabulary(spark):
    """Words that no marked piece begins take the bare mark as a piece, as by greedy matching of mark and word."""
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))}
    rng = random.Random(3)
    single = sorted(p for p in pieces if len(p) == 1)
    words = ["2024", "3.14", "ñandú", "ça", "ßa", "中国人民" * 50, "▁", "a▁b", "the", "x☃", "☃", *single]
    words += ["".join(rng.choices(single, k=rng.randrange(1, 9))) for _ in range(2000)]
    words = [w for w in words if len(w.split()) == 1]
    counter = token_counts.automaton(path)
    assert [counter.count(w) for w in words] == [brute("▁" + w, pieces, pieces) for w in words]
    assert [counter.count(w) for w in ("2024", "3.14")] == [5, 5]
    docs = spark.createDataFrame([(1, "2024 3.14"), (2, "\uffff 2024")], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_tokens, r.n_unknown) for r in token_counts.token_counts(docs, path).collect()}
    assert got == {1: (2, 10, 0), 2: (2, 6, 1)}


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, n_tokens int")
    assert token_counts.token_counts(empty, public_tokenizers.path("piece_bpe_32k.model")).count() == 0


def test_query_counts_like_greedy_matching_with_the_real_vocabulary(spark, tmp_path):
    import sentencepiece

    from cairn.llm import queries

    m = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    pieces = {m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))}
    texts = ["The quick brown fox, 2024!", "über Straßen — ça va? 中国", None, "supercalifragilistic antidisestablishmentarianism"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in queries.op8_token_counts(spark, str(tmp_path)).collect():
        counts = [brute("▁" + w, pieces, pieces) for w in (texts[r.doc_id] or "").split()]
        assert (r.n_words, r.n_tokens) == (len(counts), sum(c % UNKNOWN for c in counts))
