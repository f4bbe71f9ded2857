"""Quality scores: random Fourier features of document statistics, ridge, isotonic calibration.

Texts are read once; what is written of them is a short vector of statistics
(shares of character kinds, word lengths, repetition). Everything else runs on
these vectors:

* standardise and map to cosines of random projections, whose inner products
  approximate a Gaussian kernel;
* every partition sums its part of the normal equations; the driver adds the
  sums of FIT_PARTS partitions and solves the ridge system;
* scores of rows kept back from the fit are calibrated: counts by score bin,
  pooled until they rise, joined by straight lines.

The fit uses at most about ``fit_rows`` labelled rows, chosen by a hash of
doc_id; the bound is a parameter. Rows with crc32(doc_id as text) mod 5 = 0 are
held out: no label of theirs is used.

Cases: null texts count as empty and have a score; very long texts are measured
whole; labels other than 0 and 1 are no labels; without labels every score is 1;
rows that repeat a doc_id are scored each, and a label counts for each of them;
equal texts have equal scores, so ties stay ties; empty tables give no rows;
other columns pass through the filter untouched, whatever their names.
"""

from __future__ import annotations

from operator import eq
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.shared import cut, id_text, kept_rows, map_rows

FIT_PARTS, BINS = 16, 1000
#: Kinds of bytes: 0 other letters and UTF-8 rest, 1 upper case, 2 digit, 3 blank, 4 line end, 5 sentence mark, 6 exclamation, 7 bar, 8 other mark.
_KINDS = np.zeros(256, np.uint8)
for _chars, _k in ((range(65, 91), 1), (range(48, 58), 2), (b" \t\r\x0b\x0c", 3), (b"\n", 4), (b".,;:?'-", 5), (b"!", 6), (b"|", 7), (b"\"#$%&()*+/<=>@[\\]^_`{}~", 8)):
    _KINDS[list(_chars)] = _k


def statistics_of(texts: list[str]) -> np.ndarray:
    """Row of statistics for each text."""
    data = [t.encode("utf-8", "surrogatepass") + b" " for t in texts]
    kinds = _KINDS[np.frombuffer(b"".join(data), np.uint8)]
    starts = np.cumsum([0, *map(len, data[:-1])])
    n = np.array(list(map(len, data)), float)
    shares = [np.add.reduceat((kinds == k).astype(np.uint32), starts) for k in range(1, 9)]
    rows = []
    for d in data:
        words = d.split()
        lines = [x for x in d.split(b"\n") if x.strip()]
        m = max(1, len(words))
        sizes = np.fromiter(map(len, words), np.int32, len(words)) if words else np.zeros(1, np.int32)
        half = len(words) // 2
        rows.append((
            np.log1p(len(words)), sizes.mean(), sizes.std(), sizes.max() ** 0.5, len(set(words)) / m, sum(map(eq, words, words[1:])) / m, sum(map(eq, words, words[2:])) / m,
            len(set(lines)) / max(1, len(lines)), np.log1p(m / max(1, len(lines))), len(set(words[:half])) / max(1, half), float(not words),
        ))
    return np.column_stack([np.sqrt(s / n) for s in shares] + [np.log1p(n), np.array(rows)]).astype(np.float32)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and stats (array of float)."""

    def make():
        return lambda x: {"doc_id": x["doc_id"], "stats": list(statistics_of(x["text"])) if x["text"] else []}

    return map_rows(id_text(docs), make, "doc_id long, stats array<float>")


class Model(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    project: np.ndarray
    shift: np.ndarray
    weights: np.ndarray
    knots: np.ndarray  # raw scores and calibrated ones
    values: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -6, 6)
        waves = np.cos(x @ self.project + self.shift) * (2 / len(self.shift)) ** 0.5
        return np.column_stack([waves, x / 10, np.ones(len(x))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return np.round(np.clip(self.features(stats) @ self.weights, -1, 2), 9)  # alike in any batch

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), self.knots, self.values)


def rising(values: np.ndarray, counts: np.ndarray) -> list[tuple[float, float, int]]:
    """Least-squares rising fit (pool adjacent violators): mean, weight, number of places of each pool."""
    pools: list[tuple[float, float, int]] = []
    for v, n in zip(values, counts, strict=True):
        pools.append((float(v), float(n), 1))
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            (a, n, i), (b, m, j) = pools[-2:]
            pools[-2:] = [((a * n + b * m) / (n + m), n + m, i + j)]
    return pools


def fold(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5))


def label_sample(labels: DataFrame, target: str = "quality", fit_rows: int = 200_000) -> DataFrame:
    """doc_id and label (0 or 1) of at most about ``fit_rows`` rows outside the held-out fold."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias("label")).where("label in (0, 1)").where(fold() != 0)
    n = known.count()
    if n > fit_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_000)) < F.lit(int(1e6 * fit_rows / n)))
    return known


def fit(stats: DataFrame, known: DataFrame, waves: int = 192, width: float = 1.0, ridge: float = 1e-3) -> Model:
    """Model of known.label (0 or 1) by stats; width: the kernel's, in root mean square distances."""
    rows = cut(stats.join(known, "doc_id").withColumn("fold", fold()).repartition(FIT_PARTS, F.xxhash64("doc_id")))

    def sums(of, width: int, where: str) -> np.ndarray:
        """Sum of of(stats, labels), a vector, over rows; one vector comes from each partition."""

        def run(batches):
            import pyarrow as pa

            total = np.zeros(width)
            for b in batches:
                if b.num_rows:
                    x = np.array(b.column(0).flatten(), np.float64).reshape(b.num_rows, -1)
                    total += of(x, np.array(b.column(1), np.float64))
            yield pa.RecordBatch.from_pydict({"total": [total.tobytes()]})

        parts = rows.where(where).select("stats", "label").mapInArrow(run, "total binary").collect()
        return sum((np.frombuffer(p.total) for p in parts), np.zeros(width))

    d = len(statistics_of([""])[0])
    total = sums(lambda x, y: np.concatenate([[len(y)], x.sum(0), (x * x).sum(0)]), 1 + 2 * d, "fold <> 4")
    count = max(1.0, total[0])
    mean = total[1 : 1 + d] / count
    scale = np.sqrt(np.maximum(total[1 + d :] / count - mean**2, 1e-6))
    rng = np.random.default_rng(11)
    model = Model(mean, scale, rng.normal(0, 1 / (width * d**0.5), (d, waves)), rng.uniform(0, 2 * np.pi, waves), np.zeros(0), np.zeros(1), np.ones(1))
    if not total[0]:
        return model._replace(weights=np.zeros(waves + d + 1))

    size = waves + d + 1

    def equations(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = model.features(x)
        return np.concatenate([(z.T @ z).ravel(), z.T @ y])

    total = sums(equations, size * size + size, "fold <> 4")
    gram, right = total[: size * size].reshape(size, size), total[size * size :]
    model = model._replace(weights=np.linalg.solve(gram + ridge * count * np.eye(size) / 10, right))

    def binned(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        at = np.minimum(((model.raw(x) + 1) / 3 * BINS).astype(int), BINS - 1)
        return np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at, y, minlength=BINS)])

    total = sums(binned, 2 * BINS, "fold = 4")
    seen, good = total[:BINS], total[BINS:]
    full = np.flatnonzero(seen)
    if not len(full):
        return model._replace(knots=np.array([0.0, 1.0]), values=np.array([0.0, 1.0]))
    knots, values, at = [], [], 0
    for value, weight, places in rising(good[full] / seen[full], seen[full]):
        bins = full[at : at + places]
        at += places
        value = (value * weight + 0.5) / (weight + 1)  # a small pool says less
        centre = float((seen[bins] * (bins + 0.5)).sum() / seen[bins].sum()) / BINS * 3 - 1
        knots.append(centre)
        values.append(max([value, *values[-1:]]))
    return model._replace(knots=np.array(knots), values=np.array(values))


def scored(stats: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted (1: kept)."""

    def make():
        def step(x: dict) -> dict:
            scores = model.score(np.array(x["stats"], np.float64)) if x["doc_id"] else np.zeros(0)
            return {"doc_id": x["doc_id"], "score": scores}

        return step

    out = map_rows(stats, make, "doc_id long, score double")
    return out.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, target: str = "quality", fit_rows: int = 200_000, **parameters) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs."""
    stats = cut(statistics(docs))
    return scored(stats, fit(stats, label_sample(labels, target, fit_rows), **parameters), threshold)


def drop_low_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, target: str = "quality", fit_rows: int = 200_000, **parameters) -> DataFrame:
    """docs without those that score below the threshold.

    The model is fitted on the texts of the sampled labels alone; each text is
    then scored as it passes, so that no text is shuffled or joined.
    """
    known = cut(label_sample(labels, target, fit_rows))
    ids = known.select("doc_id").distinct()
    if known.count() <= 2 * fit_rows:  # a hash chooses about fit_rows of them; 16 bytes each
        ids = F.broadcast(ids)
    model = fit(statistics(id_text(docs).join(ids, "doc_id", "left_semi")), known, **parameters)

    def make():
        return lambda texts: model.score(statistics_of([t or "" for t in texts])) >= threshold

    return kept_rows(docs, make, "text")


def held_out_auc(scores: np.ndarray, labels: np.ndarray) -> float:
    """Chance that a row labelled 1 scores above one labelled 0; ties count half."""
    values, place = np.unique(scores, return_inverse=True)
    pos, neg = (np.bincount(place, labels == k, len(values)) for k in (1, 0))
    return float((pos * (np.cumsum(neg) - neg / 2)).sum() / (pos.sum() * neg.sum()))
