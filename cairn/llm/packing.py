"""Packing token streams into sequences by order-preserving dynamic programming.

Documents follow each other in the order of their partition. Places where a
sequence may end are document ends (free), sentence ends (a small penalty, a
truncation) and, inside long sentences, every few dozen tokens (a larger
penalty). With positions p and costs f,

    f[j] = min over p[j] - p[i] <= length of f[i] + (length - (p[j] - p[i])) + penalty[j]
         = length - p[j] + penalty[j] + min (f[i] + p[i]),

a sliding minimum that a monotone queue keeps at constant cost for each place.

A partition is worked off in blocks of at most about ``block`` tokens; the last
unfinished sequence of a block goes on into the next, so memory is bounded by a
block and the longest text. Nothing is shuffled: a task packs what it reads.
Sequence ids hold the partition and a count, and a task that is run again gives
the same rows.

Cases: null and empty texts have the end token alone; texts longer than a
sequence are cut; rows repeated, or with a doc_id met before, are packed again
as documents of their own; equal costs take the earliest cut; an empty table
gives no rows; other columns of docs, whatever their names, are not read.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.shared import by_bytes, id_text, in_small_batches

#: Penalties in tokens of padding.
SENTENCE_CUT, WORD_CUT = 4, 64
#: Inside longer sentences, every so many tokens is a place too.
WORD_STEP = 64
#: White space for str.split() that the tokenizers' rules don't count as such.
ODD_SPACE = re.compile("[\x1c-\x1f]")
#: Texts and words of ASCII and Latin letters: lower-casing works by character and parts are the tokenizer's own.
PLAIN_TEXT = re.compile(r"[\t-\r -~À-ÖØ-öø-ÿ]*")
PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
PARTS = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]|[^\sA-Za-z0-9À-ÖØ-öø-ÿ]+")


class Tokens:
    """Ids of texts as arrays; the parts that texts are made of are encoded once.

    The word vocabulary drops white space, and never joins characters across it
    or across letters, digits and marks; so a plain text's ids are those of its
    parts in lower case, and another text's those of its words. Texts with
    special-token marks or odd control characters go to the tokenizer whole.

    A part has a number; numbers of many texts are looked up at once, and parts
    not met before are encoded in one call, as every part ends in a token with
    the mark of a word's end. Beyond ``most`` parts the often used half is kept.
    """

    def __init__(self, path: str, most: int = 300_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.marks = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.most = most
        self.closes = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.closes[i] = token.endswith("</w>")
        self.clear()

    def clear(self) -> None:
        """Forget all parts."""
        self.number = _Numbers()
        self.ids, self.starts, self.used = np.zeros(0, "<u4"), np.zeros(1, np.int64), np.zeros(0, np.int64)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def together(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts, joined, and how many each has."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(parts)], add_special_tokens=False)[0].ids, "<u4")
        sizes = np.diff(np.flatnonzero(self.closes[ids]), prepend=-1)
        if len(sizes) == len(parts) and sizes.sum() == len(ids):
            return ids, sizes
        each = [self.whole(p) for p in parts]
        return np.concatenate(each), np.array(list(map(len, each)), np.int64)

    def learn(self) -> None:
        """Encode the parts that were numbered since."""
        fresh = self.number.fresh
        plain = [p for p in fresh if PLAIN.fullmatch(p)]
        ids, sizes = self.together(plain) if plain else (np.zeros(0, "<u4"), np.zeros(0, np.int64))
        if len(plain) < len(fresh):  # words of other scripts, one by one
            found, ends = [], iter(np.split(ids, np.cumsum(sizes)[:-1]) if plain else ())
            found = [next(ends) if PLAIN.fullmatch(p) else self.whole(p) for p in fresh]
            ids, sizes = np.concatenate(found), np.array(list(map(len, found)), np.int64)
        self.ids = np.concatenate([self.ids, ids])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
        self.used = np.concatenate([self.used, np.zeros(len(fresh), np.int64)])
        fresh.clear()

    def forget(self) -> None:
        """Keep the often used half of the parts."""
        keep = np.sort(np.argsort(-self.used, kind="stable")[: self.most // 2])
        parts = list(self.number)
        sizes = np.diff(self.starts)[keep]
        self.ids = self.ids[stretches(self.starts[keep], sizes)]
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        self.used = self.used[keep] // 2
        self.number = _Numbers({parts[k]: i for i, k in enumerate(keep.tolist())})

    def parts_of(self, text: str) -> list[str]:
        if PLAIN_TEXT.fullmatch(text):
            return PARTS.findall(text.lower())
        return [p for w in text.split() for p in (PARTS.findall(w.lower()) if PLAIN.fullmatch(w) else (w,))]

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        if len(self.number) > self.most or len(self.ids) > 16 * self.most:
            self.forget()
        odd = {k: self.whole(t) for k, t in enumerate(texts) if any(m in t for m in self.marks) or ODD_SPACE.search(t)}
        parts = [[] if k in odd else self.parts_of(t) for k, t in enumerate(texts)]
        bounds = np.cumsum([0, *map(len, parts)])
        at = np.fromiter(map(self.number.__getitem__, chain.from_iterable(parts)), np.int64, bounds[-1])
        if self.number.fresh:
            self.learn()
        self.used += np.bincount(at, minlength=len(self.used))
        sizes = self.starts[at + 1] - self.starts[at]
        ids = self.ids[stretches(self.starts[at], sizes)]
        ends = np.concatenate([[0], np.cumsum(sizes)])[bounds]
        return [odd[k] if k in odd else ids[a:b] for k, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))]

    def __call__(self, text: str) -> bytes:
        return self.batch([text])[0].tobytes()

    def sentence_ends(self) -> np.ndarray:
        """By id: whether a sentence may end after it."""
        size = self.tokenizer.get_vocab_size()
        out = np.zeros(size + 1, bool)
        for token, i in self.tokenizer.get_vocab().items():
            out[i] = bool(re.fullmatch(r"[.!?]+(</w>)?", token))
        return out


class _Numbers(dict):
    """Numbers of parts in the order of their coming; fresh: parts that came since it was cleared."""

    def __init__(self, *known):
        super().__init__(*known)
        self.fresh: list[str] = []

    def __missing__(self, part: str) -> int:
        self[part] = n = len(self)
        self.fresh.append(part)
        return n


def stretches(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each stretch, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


@lru_cache(maxsize=1)
def tokens(path: str) -> Tokens:
    return Tokens(path)


def choose_cuts(places: np.ndarray, penalty: np.ndarray, length: int, last: bool = True) -> list[int]:
    """Indices into places (rising, first 0, gaps <= length) where sequences end, at the least total cost.

    Not last: more tokens follow, so the cuts may stop at any place within a length of the end, at the least cost up to there.
    """
    p, extra = places.tolist(), penalty.tolist()
    n = len(p)
    best, back = [0] * n, [0] * n  # best[i] is f[i] + p[i]
    queue = deque([0])
    for j in range(1, n):
        low = p[j] - length
        while p[queue[0]] < low:
            queue.popleft()
        back[j] = queue[0]
        best[j] = value = best[queue[0]] + length + extra[j]
        while queue and best[queue[-1]] >= value:
            queue.pop()
        queue.append(j)
    out, j = [], n - 1
    if not last:
        open_places = range(int(np.searchsorted(places, p[-1] - length, "right")), n)
        j = min(open_places, key=lambda i: (best[i] - p[i], -i))
    while j:
        out.append(j)
        j = back[j]
    return out[::-1]


def cut_places(ids: np.ndarray, ends: np.ndarray, is_end: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where sequences may end and their penalties; ends: positions after each document."""
    kind = np.full(len(ids) + 1, -1, np.int16)
    kind[1:][is_end[np.minimum(ids, len(is_end) - 1)]] = SENTENCE_CUT
    kind[ends] = 0
    kind[0] = 0
    places = np.flatnonzero(kind >= 0)
    wide = np.flatnonzero(np.diff(places) > (step := min(WORD_STEP, length)))
    for i in wide:
        kind[np.arange(places[i] + step, places[i + 1], step)] = WORD_CUT
    if len(wide):
        places = np.flatnonzero(kind >= 0)
    return places, kind[places]


def pack(docs: DataFrame, path: str, length: int = 4096, end_id: int = 2, block: int = 1_000_000) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian uint32), doc_tokens, sequence_id, offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens(path)
        is_end, tail = encode.sentence_ends(), np.array([end_id], "<u4").tobytes()
        sequence = TaskContext.get().partitionId() << 40
        held: list[tuple] = []  # (doc_id, tokens before this part, ids, tokens of the whole document)
        size = 0

        def settle(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size, sequence
            stream = b"".join(x[2] for x in held)
            ids = np.frombuffer(stream, "<u4")
            ends = np.cumsum([len(x[2]) // 4 for x in held])
            places, penalty = cut_places(ids, ends, is_end, length)
            at = places[choose_cuts(places, penalty, length, last)].tolist()
            rows: list[tuple] = []
            begin, k, low = 0, 0, 0
            left: list[tuple] = []
            for stop in [*at, None]:
                offset = 0
                while k < len(held) and (stop is None or low < stop):
                    doc, before, part, whole = held[k]
                    high = int(ends[k])
                    upto = high if stop is None else min(high, stop)
                    first = high - len(part) // 4
                    piece = part[4 * (low - first) : 4 * (upto - first)]
                    if stop is None:
                        left.append((doc, before + low - first, piece, whole))
                    else:
                        rows.append((doc, before + low - first, upto - low, piece, whole, sequence, offset))
                        offset += upto - low
                    low = upto
                    k += upto == high
                if stop is not None:
                    sequence += 1
                    begin = stop
            held, size = left, len(ids) - begin
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), kind, strict=True)], schema=kind)

        for batch in batches:
            for part in by_bytes(batch):
                for doc, found in zip(part.column(0).to_pylist(), encode.batch(part.column(1).to_pylist()), strict=True):
                    ids = found.tobytes() + tail
                    held.append((doc, 0, ids, len(ids) // 4))
                    size += len(ids) // 4
                    if size >= block:
                        yield from settle(False)
        if held:
            yield from settle(True)
        encode.clear()  # a worker that waits for its next task holds no parts

    kind = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
    in_small_batches(docs.sparkSession)
    return id_text(docs).mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def piece_digests(pieces: DataFrame) -> DataFrame:
    """Pieces with a checksum in place of their ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
