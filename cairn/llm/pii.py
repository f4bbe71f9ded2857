"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

The patterns give the base spans. The random field labels every word of every
text (email, ip, card, phone or nothing) by the shapes of the word and of its
neighbours; it is trained, where it is called from, on a small labelled table
that ``labelled_table`` writes out by rule, with forms that the patterns leave
out, such as phone numbers without a plus sign. Its spans are added where they
touch no base span, under the kinds crf_email to crf_phone.

Texts are worked off in numpy steps of bounded size: word bounds and shapes come
from arrays of code points. A line is a sequence, however long. A word whose
label 0 leads every other by more than any neighbours could make up has label 0
on the best path; Viterbi then runs over the stretches between such words, all
of a step side by side, which gives the same path as over the whole lines.

Stretches of one label are cut into spans that can be such a thing: cards are 13
to 19 digits that pass Luhn, phones 7 to 15 digits, emails and addresses are
single words.

Cases: null and empty texts have no spans; very long texts and lines are decoded
whole; offsets count code points, the end excluded; equal texts have equal spans;
of labels that tie the first wins; rows that repeat a doc_id have a row of spans
each; an empty table gives no rows; other columns are left alone, whatever their
names, and a masked table has the columns of its input.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import lru_cache
from itertools import accumulate
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.shared import STEP_BYTES, by_bytes, id_text, in_small_batches, map_rows

KINDS = ("email", "ip", "card", "phone")

# ---- base spans

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)+")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_PART = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def emails(text: str) -> list[tuple[int, int]]:
    """A match begins with the run of local characters that ends at an @: found from the @ backwards."""
    out, low, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, low := m.end()))
        at = text.find("@", m.end() if m else at + 1)
    return out


def addresses(text: str) -> list[tuple[int, int]]:
    """Fours of a dotted run of numbers, from its left; those with a part over 255 drop out."""
    out = []
    for m in _DOTTED.finditer(text):
        if "." in m[0]:
            parts = list(_PART.finditer(text, m.start(), m.end()))
            for k in range(0, len(parts) - 3, 4):
                if all(len(x := p[0].lstrip("0")) <= 3 and int(x or 0) <= 255 for p in parts[k : k + 4]):
                    out.append((parts[k].start(), parts[k + 3].end()))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    if "+" not in text:
        return []
    return [m.span() for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    return [(kind, a, b) for kind, find in zip(KINDS, (emails, addresses, cards, phones), strict=True) for a, b in find(text)]


# ---- word shapes

SHAPES, EDGES = 9 * 6 * 2 * 4 * 2 + 1, 5 * 5 * 2 * 3 + 1
#: Kinds of code points: 0 other, 1 lower or beyond ASCII, 2 upper, 3 digit, 4 @, 5 point, 6 plus, 7 bracket or hyphen, 8 white space, 9 line end.
_KINDS = np.zeros(128, np.uint8)
for _chars, _k in ((range(97, 123), 1), (range(65, 91), 2), (range(48, 58), 3), (b"@", 4), (b".", 5), (b"+", 6), (b"()-", 7), (b" \t\x0b\x0c\r", 8), (b"\n", 9)):
    _KINDS[list(_chars)] = _k
_DIGITS = np.array([0, 1, 2, 3, 3, 4, 4, 4, 4, 5, 5, 5, 5, 6, 6, 6, 7, 7, 7, 7, 8])
_OTHERS = np.array([0, 1, 2, 3, 3, 3, 4, 4, 4, 4, 4, 4, 5])
_SIDE = np.array([0, 1, 2, 3, 0, 4, 4, 4, 0, 0])


class Words(NamedTuple):
    """Words of joined texts: bounds, ids of shapes and edges, and where sequences begin (plus the end)."""

    start: np.ndarray
    end: np.ndarray
    shape: np.ndarray
    edge: np.ndarray
    sequences: np.ndarray


def words_of(text: str) -> Words:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    kind = np.ones(len(points) + 1, np.uint8)
    low = points < 128
    kind[:-1][low] = _KINDS[points[low]]
    kind[-1] = 8
    gap = kind >= 8
    turns = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if not gap[0]:
        turns = np.concatenate([[0], turns])
    start, end = turns[::2], turns[1::2]

    def count(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([np.zeros(1, np.uint32), np.cumsum(mask, dtype=np.uint32)])
        return (sums[end] - sums[start]).astype(np.int64)

    digits, ats, dots, marks, upper = (count(kind == k) for k in (3, 4, 5, 7, 2))
    length = end - start
    first, last = kind[start], kind[end - 1]
    shape = _DIGITS[np.minimum(digits, 20)]
    for value, n in ((_OTHERS[np.minimum(length - digits, 12)], 6), (ats > 0, 2), (np.minimum(dots, 3), 4), (first == 6, 2)):
        shape = shape * n + value
    edge = _SIDE[first]
    for value, n in ((_SIDE[last], 5), (marks > 0, 2), (np.where(upper == 0, 0, np.where(upper == 1, 1, 2)), 3)):
        edge = edge * n + value
    lines = np.concatenate([np.zeros(1, np.uint32), np.cumsum(kind == 9, dtype=np.uint32)])[start]
    fresh = np.flatnonzero(np.diff(lines, prepend=lines[:1] - 1 if len(lines) else 0)) if len(lines) else np.zeros(0, np.int64)
    return Words(start, end, shape, edge, np.concatenate([fresh, [len(start)]]))


# ---- the random field

LABELS = len(KINDS) + 1


class Field(NamedTuple):
    """Weights: of the shape, edge, shape before and shape after by label; of a first label; of label after label."""

    shape: np.ndarray
    edge: np.ndarray
    before: np.ndarray
    after: np.ndarray
    first: np.ndarray
    step: np.ndarray


def neighbours(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Shapes before and after each word in its sequence; SHAPES - 1 outside."""
    before = np.concatenate([[SHAPES - 1], w.shape[:-1]])[: len(w.shape)]
    after = np.concatenate([w.shape[1:], [SHAPES - 1]])[: len(w.shape)]
    before[w.sequences[:-1]] = SHAPES - 1
    after[w.sequences[1:] - 1] = SHAPES - 1
    return before, after


def best_gain(f: Field) -> np.ndarray:
    """The most that label k instead of 0 can win on the way in and out of a word, for each k."""
    into = np.vstack([f.step - f.step[:, :1], f.first - f.first[:1]]).max(0)
    out = np.maximum((f.step - f.step[:1]).max(1), 0)
    return into + out


def decoded(w: Words, f: Field) -> np.ndarray:
    """Best label of each word (Viterbi): words that are surely 0 part the lines into stretches, worked off side by side, the longest first."""
    if not len(w.shape):
        return np.zeros(0, np.int8)
    before, after = neighbours(w)
    score = f.shape[w.shape] + f.edge[w.edge] + f.before[before] + f.after[after]
    open_ = (score[:, 1:] + (best_gain(f)[1:] + 1e-6) >= score[:, :1]).any(1)
    out = np.zeros(len(w.shape), np.int8)
    if not open_.any():
        return out
    heads = np.zeros(len(w.shape) + 1, bool)
    heads[w.sequences] = True
    begins = open_ & (heads[:-1] | ~np.concatenate([[False], open_[:-1]]))
    ends = open_ & (heads[1:] | ~np.concatenate([open_[1:], [False]]))
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    order = np.argsort(starts - stops, kind="stable")
    starts, stops = starts[order], stops[order]
    sizes = stops - starts
    place = np.cumsum(open_) - 1  # of a word among the open ones
    best = np.where(heads[starts][:, None], f.first, f.step[0]) + score[starts]
    back = np.zeros((int(open_.sum()), LABELS), np.int8)
    final = np.empty((len(starts), LABELS))
    live = len(starts)
    alive = len(starts) - np.searchsorted(sizes[::-1], np.arange(sizes[0] + 1), "right")
    for t in range(1, sizes[0]):
        n = alive[t]
        final[n:live] = best[n:live]
        best, live = best[:n], n
        at = starts[:n] + t
        top, arg = best[:, :1] + f.step[0], np.zeros((n, LABELS), np.int8)
        for k in range(1, LABELS):
            other = best[:, k : k + 1] + f.step[k]
            better = other > top
            top[better] = other[better]
            arg[better] = k
        back[place[at]] = arg
        best = top + score[at]
    final[:live] = best
    final += np.where(heads[stops][:, None], 0, f.step[:, 0])  # on to the sure word behind
    label = final.argmax(1).astype(np.int8)
    for t in range(int(sizes[0]) - 1, -1, -1):
        n = alive[t]
        at = starts[:n] + t
        if t + 1 < sizes[0]:
            more = alive[t + 1]
            label[:more] = back[place[starts[:more] + t + 1], label[:more]]
        out[at] = label[:n]
    return out


def labelled_table() -> list[tuple[str, list[int]]]:
    """Small table of lines and labels of their words, written by rule."""
    import random

    rng = random.Random(17)
    syllables = "the an er tion ing on re ed in st de la que der sch ung ment el os ción".split()
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def plain() -> str:
        w = "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
        kind = rng.randrange(24)
        w = w.capitalize() if kind < 4 else w.upper() if kind == 4 else w
        if kind in (5, 6):
            w = rng.choice([digits(1), digits(2), digits(3), "19" + digits(2), "20" + digits(2), digits(1) + "." + digits(1), digits(2) + "%", "$" + digits(3), digits(1) + "." + digits(1) + "." + digits(1), "v" + digits(1), digits(1) + "," + digits(3), digits(2) + ":" + digits(2), digits(4) + "-" + digits(2) + "-" + digits(2), "#" + digits(5), w + digits(2), digits(8), digits(40), "(" + w + ")", w + "-" + w, '"' + "".join(rng.choice("0123456789abcdef") for _ in range(40)) + '"', "|", "=", "-", "+", "token"])
        return w + rng.choice(["", "", "", "", "", ".", ",", "!!", "***", "?", ":", ";", "%%%"])

    def email() -> list[str]:
        return ["".join(rng.choice(["ana", "jo", "li", "max", ".", digits(2)]) for _ in range(rng.randint(2, 4))).strip(".") + "x@" + rng.choice(["mail", "post", "uni"]) + digits(rng.randrange(2)) + rng.choice([".org", ".example.com", ".de", ""]) + rng.choice(["", "", ".", ","])]

    def ip() -> list[str]:
        return [".".join(str(rng.randrange(256)) for _ in range(4)) + rng.choice(["", "", ",", ":8080", "/24"])]

    def card() -> list[str]:
        return rng.choice([[digits(16)], [digits(4) for _ in range(4)], ["-".join(digits(4) for _ in range(4))], [digits(4), digits(6), digits(5)]])

    def phone() -> list[str]:
        a, b, c = digits(3), digits(3), digits(4)
        return rng.choice([["+" + digits(1), f"({a})", f"{b}-{c}"], [f"({a})", f"{b}-{c}"], [f"{a}-{b}-{c}"], [f"{a}.{b}.{c}"], ["+" + digits(2), a, b, c], [f"+{digits(2)}{a}{b}{c}"], [f"({a}){b}-{c}"]])

    rows = []
    for k in range(700):
        words, labels = [], []
        for _ in range(rng.randint(0, 9)):
            words.append(plain())
            labels.append(0)
        if k % 3:
            kind = rng.randrange(4)
            found = (email, ip, card, phone)[kind]()
            words += [*found[:-1], found[-1] + rng.choice(["", "", "", ",", "."])] if kind > 1 else found
            labels += [kind + 1] * len(found)
        for _ in range(rng.randint(1, 9)):
            words.append(plain())
            labels.append(0)
        rows.append((" ".join(words), labels))
    return rows


def trained(table: list[tuple[str, list[int]]], turns: int = 80, rate: float = 0.15, decay: float = 2e-4) -> Field:
    """Weights of greatest penalised likelihood, by forward-backward and Adam over the whole table."""
    w = words_of("\n".join(text for text, _ in table))
    y = np.concatenate([labels for _, labels in table])
    before, after = neighbours(w)
    starts, sizes = w.sequences[:-1], np.diff(w.sequences)
    longest, lanes = int(sizes.max()), len(starts)
    there = np.arange(longest)[None] < sizes[:, None]
    place = np.where(there, starts[:, None] + np.arange(longest), 0)
    ids = ((w.shape, SHAPES), (w.edge, EDGES), (before, SHAPES), (after, SHAPES))
    weights = [np.zeros((n, LABELS)) for _, n in ids] + [np.zeros(LABELS), np.zeros((LABELS, LABELS))]
    gold = np.eye(LABELS)[y]
    inner = np.setdiff1d(np.arange(len(y)), starts)
    pair = np.zeros((LABELS, LABELS))
    np.add.at(pair, (y[inner - 1], y[inner]), 1)
    first, second = [np.zeros_like(x) for x in weights], [np.zeros_like(x) for x in weights]

    def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis, keepdims=True)
        return (np.log(np.exp(x - top).sum(axis, keepdims=True)) + top).squeeze(axis)

    for turn in range(1, turns + 1):
        score = sum(x[i] for (i, _), x in zip(ids, weights, strict=False))[place]
        begin, step = weights[4], weights[5]
        ahead = np.empty((longest, lanes, LABELS))
        ahead[0] = begin + score[:, 0]
        for t in range(1, longest):
            ahead[t] = np.where(there[:, t, None], log_sum(ahead[t - 1][:, :, None] + step, 1) + score[:, t], ahead[t - 1])
        total = log_sum(ahead[-1], 1)
        behind = np.zeros((longest, lanes, LABELS))
        pairs = np.zeros((LABELS, LABELS))
        for t in range(longest - 2, -1, -1):
            on = there[:, t + 1, None]
            move = step + (score[:, t + 1] + behind[t + 1])[:, None]
            behind[t] = np.where(on, log_sum(move, 2), 0)
            chance = np.exp(ahead[t][:, :, None] + move - total[:, None, None])
            pairs += (chance * on[:, :, None]).sum(0)
        chance = np.exp(ahead + behind - total[:, None]).transpose(1, 0, 2)
        own = np.zeros((len(y), LABELS))
        own[place[there]] = chance[there]
        slopes = []
        for (i, n), _ in zip(ids, weights, strict=False):
            g = np.zeros((n, LABELS))
            np.add.at(g, i, own - gold)
            slopes.append(g / lanes)
        slopes += [(own - gold)[starts].sum(0) / lanes, (pairs - pair) / lanes]
        for k, g in enumerate(slopes):
            g = g + decay * weights[k]
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            weights[k] = weights[k] - rate * (first[k] / (1 - 0.9**turn)) / (np.sqrt(second[k] / (1 - 0.99**turn)) + 1e-8)
    return Field(*weights)


@lru_cache(maxsize=1)
def default_field() -> Field:
    return trained(labelled_table())


# ---- spans of texts


def plausible(kind: str, words: list[str]) -> bool:
    """Whether words beside each other can be one span of a kind."""
    digits = "".join(c for x in words for c in x if "0" <= c <= "9")
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":  # a plus sign begins a number, and so does a bracket that doesn't follow one
        fresh = [k for k, x in enumerate(words) if x[0] == "+" or x[0] == "(" and not (k == 1 and words[0][0] == "+")]
        return 7 <= len(digits) <= 15 and not any(fresh)
    return len(words) == 1


def split_run(kind: str, words: list[str]) -> list[tuple[int, int]]:
    """Bounds of the spans in a run of words of one label: from the left, the longest plausible one at each word."""
    out, i = [], 0
    while i < len(words):
        j = next((j for j in range(min(len(words), i + 8), i, -1) if plausible(kind, words[i:j])), None)
        if j:
            out.append((i, j))
        i = j or i + 1
    return out


def found_spans(texts: list[str], field: Field) -> list[list[tuple[str, int, int]]]:
    """Spans of each text: base ones, then added ones, each by kind and start."""
    joined = "\n".join(texts)
    w = words_of(joined)
    labels = decoded(w, field)
    hot = np.flatnonzero(labels)
    fresh = np.zeros(len(labels) + 1, bool)
    fresh[w.sequences] = True
    runs: list[tuple[int, int, int]] = []  # label, first and last word
    for i in hot.tolist():
        if runs and runs[-1][0] == labels[i] and runs[-1][2] == i - 1 and not fresh[i]:
            runs[-1] = (runs[-1][0], runs[-1][1], i)
        else:
            runs.append((int(labels[i]), i, i))
    out = [base_spans(t) for t in texts]
    taken: dict[int, tuple[list[int], list[int]]] = {}  # of a text: starts of its base spans, and the furthest end up to each
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    for label, first, last in runs:
        kind = KINDS[label - 1]
        for i, j in split_run(kind, [joined[a:b] for a, b in zip(w.start[first : last + 1].tolist(), w.end[first : last + 1].tolist(), strict=True)]):
            a, b = int(w.start[first + i]), int(w.end[first + j - 1])
            while a < b and not (joined[a].isalnum() or joined[a] in "+("):
                a += 1
            while a < b and not (joined[b - 1].isalnum() or joined[b - 1] == ")"):
                b -= 1
            k = int(np.searchsorted(starts, a, "right")) - 1
            if k not in taken:
                own = sorted((s, e) for _, s, e in out[k])
                taken[k] = [s for s, _ in own], list(accumulate((e for _, e in own), max))
            a, b = a - int(starts[k]), b - int(starts[k])
            before = bisect_left(taken[k][0], b)  # base spans that begin before the end
            if a < b and (not before or taken[k][1][before - 1] <= a):
                out[k].append((f"crf_{kind}", a, b))
    return out


def in_steps(texts: list[str]):
    """Ranges of texts with about STEP_BYTES characters each."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= STEP_BYTES):
            size += len(texts[end])
            end += 1
        yield texts[at:end]
        at = end


def find_personal_data(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id and spans, an array of (kind, start, end, base), of every whole text."""
    field = field or default_field()

    def make():
        def step(x: dict) -> dict:
            found = [s for part in in_steps(x["text"]) for s in found_spans(part, field)]
            spans = [[{"kind": k, "start": a, "end": b, "base": k in KINDS} for k, a, b in s] for s in found]
            return {"doc_id": x["doc_id"], "spans": spans}

        return step

    return map_rows(id_text(docs), make, "doc_id long, spans array<struct<kind:string,start:long,end:long,base:boolean>>")


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """text with each stretch of touching spans replaced by the kind of its first, in brackets."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.removeprefix('crf_').upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def mask_personal_data(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """docs with personal data replaced by marks such as [EMAIL]; n_chars, if there, counts the new text. A null text stays null."""
    import pyarrow as pa

    field = field or default_field()
    columns = docs.columns

    at = columns.index("text")

    def run(batches):
        for batch in batches:
            for b in by_bytes(batch):
                texts = b.column(at).to_pylist()
                found = [s for part in in_steps([t or "" for t in texts]) for s in found_spans(part, field)]
                texts = [None if t is None else masked(t, s) if s else t for t, s in zip(texts, found, strict=True)]
                arrays = list(b.columns)
                arrays[at] = pa.array(texts, type=b.schema.field(at).type)
                yield pa.RecordBatch.from_arrays(arrays, schema=b.schema)

    in_small_batches(docs.sparkSession)
    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*columns) if "n_chars" in columns else out
