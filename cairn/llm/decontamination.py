"""Benchmark decontamination by spaced seeds, with DataFrame operations only.

A mask is laid over every run of words; words under its 0 places are ignored, so
a key survives substitutions there. Keys of the benchmark's items are joined
with those of all documents; a hit fixes which item word lies on which document
word. For each such placement the words of item and document are compared in
place, and the document is contaminated where some window of ``window`` item
words (the whole item if shorter) agrees in at least ``percent`` of its places.

The item side is broadcast only after its keys were counted and are at most
``broadcast_keys``; a larger benchmark is joined by shuffle. Document keys are
made and probed in one pass without a shuffle. Only texts of documents with a
hit are read again.

Masks are chosen by the lengths that the benchmark's items have, so that no
pattern of substitutions that the comparison would accept escapes them all.

Words are runs of letters and digits, in lower case. Items of fewer than four
words have one exact run of their own length; items without words are not
looked for.

Cases: null and empty texts have no words; very long texts are read whole; equal
items are all reported, and so are placements that tie; an empty table of
documents or items gives no rows; other columns, whatever their names, are not
read; rows that repeat a doc_id are compared each, and reported once; rows without doc_id
are compared too, and reported under null. Rows are dropped by their texts, so
that a missing or repeated doc_id makes no difference.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.shared import cut, id_text

#: Masks of four words, tried in this order.
MASKS = ("1111", "11011", "10111", "11101")
#: An item length with more patterns of changed words is not enumerated; it has a plain run.
PATTERNS = 20_000
LEAST_WORDS = 1
TEXT_KEYS = ("_text_key_0", "_text_key_1")


def complete_masks(words: int, changed: int) -> list[str]:
    """Masks of which one lies on unchanged words somewhere, whichever ``changed`` of ``words`` words are changed."""
    run = max(1, -(-(words - changed) // (changed + 1)))  # some run of unchanged words is at least so long
    if run >= len(MASKS[0]):
        return [MASKS[0]]
    chosen, escaped = [], [set(p) for p in combinations(range(words), changed)] if comb(words, changed) <= PATTERNS else []
    for mask in MASKS if escaped else ():
        laid = [{at + k for k, c in enumerate(mask) if c == "1"} for at in range(words - len(mask) + 1)]
        left = [p for p in escaped if not any(p.isdisjoint(x) for x in laid)]
        if len(left) < len(escaped):
            chosen.append(mask)
        escaped = left
        if not escaped:
            return chosen
    return ["1" * run]


def word_hashes(text: Column) -> Column:
    """Hashes of the words of a text, in order."""
    words = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def seed_keys(h: Column, n: Column, mask: str) -> Column:
    """Key of a mask at every word; none if the words are too few."""
    last = n - len(mask)
    places = [k for k, c in enumerate(mask) if c == "1"]
    keys = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.lit(mask), *[F.get(h, i + k) for k in places]))
    return F.when(last >= 0, keys).otherwise(F.array().cast("array<bigint>"))


def keyed(rows: DataFrame, masks: list[str], keep: list[str]) -> DataFrame:
    """keep, key and place (word) for every mask and place of rows with h and n."""
    arrays = [F.transform(seed_keys(F.col("h"), F.col("n"), m), lambda k, i: F.struct(k.alias("key"), i.alias("place"))) for m in masks]
    return rows.select(*keep, F.explode(F.concat(*arrays)).alias("_k")).select(*keep, "_k.key", "_k.place")


def contaminated(docs: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """doc_id, item_id, start (document word under the item's first word, may be negative), matched, best_window and item_words; parameters: those of found_passages."""
    return found_passages(docs, benchmark, **parameters).drop(*TEXT_KEYS).distinct()


def text_keys(text: Column) -> dict[str, Column]:
    """Two hashes that stand for a whole text."""
    return {k: F.xxhash64(F.lit(i), F.coalesce(text, F.lit(""))) for i, k in enumerate(TEXT_KEYS)}


def found_passages(docs: DataFrame, benchmark: DataFrame, window: int = 20, percent: int = 80, broadcast_keys: int = 1_000_000) -> DataFrame:
    """What contaminated() returns, with the keys of the text."""
    items = benchmark.select(F.col("item_id"), word_hashes(F.coalesce(F.col("text"), F.lit(""))).alias("h"))
    items = cut(items.withColumn("n", F.size("h")).where(F.col("n") >= LEAST_WORDS))
    wide = F.least(F.col("n"), F.lit(window))
    masks: dict[str, list[int]] = {MASKS[0]: []}
    for r in items.select(wide.alias("wide")).distinct().collect():  # at most window different lengths
        for m in complete_masks(r.wide, int(r.wide * (100 - percent) // 100)):
            masks.setdefault(m, []).append(r.wide)
    parts = [keyed(items.where(wide.isin(own)), [m], ["item_id"]) for m, own in masks.items()]
    item_keys = cut(reduce(DataFrame.unionByName, parts).select("item_id", "key", F.col("place").alias("item_place")))
    if item_keys.count() <= broadcast_keys:
        item_keys, items = F.broadcast(item_keys), F.broadcast(items)

    rows = id_text(docs).withColumns(text_keys(F.col("text")))
    words = rows.select("doc_id", TEXT_KEYS[0], word_hashes(F.col("text")).alias("h"))
    words = words.withColumn("n", F.size("h"))
    hits = keyed(words, list(masks), ["doc_id", TEXT_KEYS[0]]).join(item_keys, "key")
    placed = cut(hits.select(F.col("doc_id").alias("_id"), F.col(TEXT_KEYS[0]).alias("_text"), "item_id", (F.col("place") - F.col("item_place")).alias("start")).distinct())

    found = placed.select(F.col("_text").alias(TEXT_KEYS[0])).distinct()
    if placed.count() <= broadcast_keys:
        found = F.broadcast(found)
    texts = rows.join(found, TEXT_KEYS[0], "left_semi").select("doc_id", *TEXT_KEYS, word_hashes(F.col("text")).alias("doc_h"))
    both = placed.join(texts, (F.col("_text") == F.col(TEXT_KEYS[0])) & F.col("_id").eqNullSafe(F.col("doc_id"))).join(items.withColumnRenamed("h", "item_h"), "item_id")
    at = lambda i: F.when(i >= 0, F.get(F.col("doc_h"), i))
    same = F.transform("item_h", lambda w, k: F.when(at(F.col("start") + k) == w, 1).otherwise(0))
    sums = F.transform(F.sequence(F.lit(1), F.col("n") - wide + 1), lambda s: F.aggregate(F.slice("same", s, wide), F.lit(0), lambda a, x: a + x))
    out = both.select("doc_id", *TEXT_KEYS, "item_id", "start", "n", same.alias("same")).select("*", F.array_max(sums).alias("best_window"), F.aggregate("same", F.lit(0), lambda a, x: a + x).alias("matched"))
    out = out.where(F.col("best_window") * 100 >= wide * percent)
    return out.select("doc_id", *TEXT_KEYS, "item_id", "start", "matched", "best_window", F.col("n").alias("item_words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """docs without those that hold a passage of the benchmark."""
    bad = cut(found_passages(docs, benchmark, **parameters).select(*TEXT_KEYS).distinct())
    return docs.withColumns(text_keys(F.col("text"))).join(F.broadcast(bad) if bounded(bad) else bad, [*TEXT_KEYS], "left_anti").select(*docs.columns)


def bounded(ids: DataFrame, most: int = 1_000_000) -> bool:
    """Whether a table of keys is small enough for a broadcast (16 MB)."""
    return ids.count() <= most
