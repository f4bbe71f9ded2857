"""Near-duplicate documents by an inverted join over signature coordinates.

1. Sketch: every text becomes its set of word shingles (hashed to 64 bits), the
   set's digest and a signature of ``coordinates`` minima.
2. Classes: documents with equal sets are one class from here on, so copies cost
   one row of a map-side combined aggregate and nothing more.
3. Postings: a class is posted under each coordinate and its value. A value met
   once is skipped; a class with fewer than ``match`` shared values is skipped; and
   a class keeps a prefix only, all but its match - 1 most frequent values: two
   classes with ``match`` values in common still meet in one that both have kept.
   A posting carries a few bytes of the signature, so that chance meetings end in
   the join itself, before anything is looked up.
4. Links: in a list of at most SMALL classes all pairs are candidates. In a
   longer one the most central classes are heads, those whose values are met most
   often, and a class is compared with the most central heads of its lists only.
   Pairs agreeing on ``match`` coordinates are
   confirmed on full sets and join components.
   Classes that agree with such a head in at least CLUSTER coordinates make up its
   cluster. What is left of a cluster outside its largest
   component is compared with all of the cluster in blocks: a task holds about REST
   classes of the one kind and BLOCK of the other, and of both a bounded number of
   bytes, passes over pairs that are connected already, and returns links, not
   pairs. Where most of a cluster is one component this costs in proportion to its
   size; a rest of many classes is copied to every block of them, which is its
   square over REST and BLOCK. Members of a list outside its largest cluster are
   at last compared with those of other clusters, in the join itself: no list or
   group is capped.
5. Components by contraction of minimal neighbours, in tables, never in the driver.

match = 38 of 64 and ALIKE of 24 bytes miss a pair of similarity 0.8 with a chance
of about 4e-5; pairs above it, and groups held together by several links, with less.

Cases: a null or empty text has no shingles and is linked with nothing; with
fewer words than a shingle the whole sequence is the one shingle; very long texts
are taken whole; rows that repeat a doc_id and its text are one document; texts
that share a doc_id are documents of their own under one name, each with its own
component; rows without doc_id are linked with nothing; of links that tie in
strength any may be found first, which leaves components as they are; an empty
table gives no rows; other columns of docs, whatever their names, are not read.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.llm.shared import Memo, cut, id_text, map_rows, small

#: Low bytes of so many coordinates travel with a posting, as longs; so many of them agree for a pair that is looked up.
MINI, ALIKE = 24, 9
#: Lists up to so many classes give all pairs; classes of the rest and of all in a block of a cluster.
SMALL, REST, BLOCK = 12, 256, 2048
#: Bytes of the sets of each of the two.
REST_BYTES, BLOCK_BYTES = 16_000_000, 32_000_000
#: Coordinates (and low bytes of MINI) in which a class agrees with its cluster's centre; classes met by chance agree in two or three.
CLUSTER, CLUSTER_ALIKE = 16, 5
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[2]
    x = (x ^ (x >> np.uint64(27))) * _MIX[3]
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str], memo: Memo, words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles; A-Z in lower case, words between ASCII white space."""
    split = [t.encode("utf-8", "surrogatepass").translate(LOWER).split() for t in texts]
    flat = np.fromiter(map(memo.__getitem__, chain.from_iterable(split)), np.uint64)
    out, at = [], 0
    for n in map(len, split):
        h = flat[at : at + n]
        at += n
        if not n:
            out.append(h)
            continue
        m = max(1, n - words + 1)
        s = np.full(m, min(n, words), np.uint64)
        for k in range(min(n, words)):
            s = mixed(s * _MIX[0] + h[k : k + m] * _MIX[1])
        out.append(np.unique(s))
    return out


def word_memo() -> Memo:
    return Memo(xxhash.xxh64_intdigest)


def signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """Row for each non-empty set: minima of its elements under fixed random maps."""
    rng = np.random.default_rng(1729)
    odd, flip = rng.integers(0, 1 << 31, coordinates, np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, coordinates, np.uint32)
    keys = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), coordinates), "<u4")
    for c in range(coordinates):
        out[:, c] = np.minimum.reduceat((keys ^ flip[c]) * odd[c], starts)
    return out


def sketch(docs: DataFrame, words: int, coordinates: int) -> DataFrame:
    """doc_id, n_shingles, two longs of digest and the signature (null without shingles)."""

    def make():
        memo = word_memo()

        def step(x: dict) -> dict:
            sets = shingle_sets(x["text"], memo, words)
            full = [s for s in sets if len(s)]
            rows = iter(signatures(full, coordinates) if full else ())
            sums = [(int(s.sum().astype(np.int64)), int(mixed(s * _MIX[1]).sum().astype(np.int64))) for s in sets]
            return {"doc_id": x["doc_id"], "n_shingles": list(map(len, sets)), "d1": [a for a, _ in sums], "d2": [b for _, b in sums], "sig": [next(rows).tobytes() if len(s) else None for s in sets]}

        return step

    return map_rows(id_text(docs), make, "doc_id long, n_shingles long, d1 long, d2 long, sig binary")


def postings(classes: DataFrame, coordinates: int) -> DataFrame:
    """rep and key (coordinate and value) for every coordinate."""

    def make():
        def step(x: dict) -> dict:
            values = np.frombuffer(b"".join(x["sig"]), "<u4").reshape(-1, coordinates)
            keys = values.astype(np.int64) + (np.arange(coordinates, dtype=np.int64) << 32)
            return {"rep": np.repeat(np.array(x["rep"], np.int64), coordinates), "key": keys.ravel()}

        return step

    return map_rows(classes.select("rep", "sig"), make, "rep long, key long")


MINIS = [f"m{k}" for k in range(MINI // 8)]


def low_bytes(classes: DataFrame, coordinates: int) -> DataFrame:
    """rep and m0 to m2, the low bytes of MINI coordinates."""

    def make():
        def step(x: dict) -> dict:
            values = np.frombuffer(b"".join(x["sig"]), "<u4").reshape(-1, coordinates)
            mini = np.ascontiguousarray(values[:, :MINI].astype(np.uint8)).view("<i8").reshape(-1, MINI // 8)
            return {"rep": x["rep"], **{f"m{k}": mini[:, k] for k in range(MINI // 8)}}

        return step

    return map_rows(classes.select("rep", "sig"), make, "rep long, " + ", ".join(f"{m} long" for m in MINIS))


def alike(head: str, member: str, least: int = ALIKE) -> Column:
    """Whether at least ``least`` bytes of the two postings agree: bytes that differ are folded to one bit each and counted."""
    differing = F.lit(0)
    for m in MINIS:
        x = F.col(head + m).bitwiseXOR(F.col(member + m))
        for k in (4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, k))
        differing = differing + F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))
    return differing <= MINI - least


def agreeing(pairs: DataFrame, sigs: DataFrame, match: int) -> DataFrame:
    """Pairs (a, b) with at least ``match`` equal coordinates, and their number."""

    def make():
        def step(x: dict) -> dict:
            one, two = (np.frombuffer(b"".join(x[c]), "<u4").reshape(len(x["a"]), -1) for c in ("sig_a", "sig_b"))
            n = (one == two).sum(1)
            keep = np.flatnonzero(n >= match)
            return {"a": np.array(x["a"], np.int64)[keep], "b": np.array(x["b"], np.int64)[keep], "n": n[keep]}

        return step

    both = pairs.join(sigs.select(F.col("rep").alias("a"), F.col("sig").alias("sig_a")), "a").join(sigs.select(F.col("rep").alias("b"), F.col("sig").alias("sig_b")), "b")
    return map_rows(both, make, "a long, b long, n int")


def similar(one: np.ndarray, two: np.ndarray, percent: int) -> bool:
    """Whether two sets (sorted) have 100 * intersection >= percent * union."""
    if 100 * min(len(one), len(two)) < percent * max(len(one), len(two)):
        return False
    both = np.concatenate([one, two])
    both.sort()
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= percent * (len(both) - common)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that are similar by their full sets."""

    def make():
        def step(x: dict) -> dict:
            keep = [(a, b) for a, b, one, two in zip(x["a"], x["b"], x["set_a"], x["set_b"], strict=True) if similar(np.frombuffer(one, "<u8"), np.frombuffer(two, "<u8"), percent)]
            return {"a": [a for a, _ in keep], "b": [b for _, b in keep]}

        return step

    both = pairs.select("a", "b").join(sets.select(F.col("rep").alias("b"), F.col("set").alias("set_b")), "b").join(sets.select(F.col("rep").alias("a"), F.col("set").alias("set_a")), "a")
    return map_rows(both, make, "a long, b long")


def block_links(rows: DataFrame, match: int, percent: int) -> DataFrame:
    """Links (a, b) between the rest and the members of each block of a cluster; a tree of them for each component that meets."""

    def run(df):
        import pandas as pd

        rest, members = df[df["rest"]], df[~df["rest"]]
        sigs = np.frombuffer(b"".join(members["sig"]), "<u4").reshape(len(members), -1)
        sets = [np.frombuffer(s, "<u8") for s in members["set"]]
        reps, comps = members["rep"].tolist(), members["comp"].tolist()
        top = {c: c for c in [*comps, *rest["comp"].tolist()]}

        def find(c: int) -> int:
            while top[c] != c:
                top[c] = c = top[top[c]]
            return c

        out = []
        for rep, comp, sig, full in zip(rest["rep"], rest["comp"], rest["sig"], rest["set"], strict=True):
            own, n = np.frombuffer(full, "<u8"), (sigs == np.frombuffer(sig, "<u4")).sum(1)
            near = np.flatnonzero(n >= match)
            for k in near[np.argsort(-n[near], kind="stable")].tolist():
                if find(comps[k]) != find(comp) and similar(own, sets[k], percent):
                    top[find(comps[k])] = find(comp)
                    out.append((rep, reps[k]))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return rows.groupBy("center", "chunk", "block").applyInPandas(run, "a long, b long")


def contracted(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """labels (rep, comp) after joining the components that edges (a, b) between reps connect; comp is the smallest rep."""
    of = lambda side: labels.select(F.col("rep").alias(side), F.col("comp").alias(f"c{side}"))
    links = cut(edges.join(of("a"), "a").join(of("b"), "b").where("ca <> cb").select("ca", "cb").distinct())
    while not links.isEmpty():
        both = links.union(links.select("cb", "ca"))
        up = both.groupBy(F.col("ca").alias("c")).agg(F.least(F.col("c"), F.min("cb")).alias("p"))
        for _ in range(2):  # four steps up; a chain of rising ids moves as a whole and loses four nodes a round, others more
            up = up.join(up.select(F.col("c").alias("p"), F.col("p").alias("top")), "p", "left").select("c", F.coalesce("top", "p").alias("p"))
        up = cut(up)
        labels = labels.join(up, labels.comp == up.c, "left").select("rep", F.coalesce("p", "comp").alias("comp"))
        one, two = (up.select(F.col("c").alias(c), F.col("p").alias(f"p{c}")) for c in ("ca", "cb"))
        links = cut(links.join(one, "ca").join(two, "cb").where("pca <> pcb").select(F.col("pca").alias("ca"), F.col("pcb").alias("cb")).distinct())
    return cut(labels)


def with_rows(docs: DataFrame, nulls: bool) -> tuple[DataFrame, bool]:
    """docs with __row, and whether it differs from doc_id anywhere.

    __row is the doc_id; where a doc_id stands on different texts, all but one of
    them have a hash of both instead, and so have rows without doc_id if ``nulls``.
    """
    doc_id, text = F.col("doc_id").cast("long"), F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    own = F.xxhash64(F.lit(1), F.col("doc_id").cast("long"), text).bitwiseAND(F.lit((1 << 63) - 1))
    named = docs.select(doc_id.alias("__id"), text.alias("__text")).groupBy("__id").agg(F.min("__text").alias("__low"), F.max("__text").alias("__high"))
    odd = cut(named.where("__low <> __high or __id is null").select("__id", "__low"))
    if (odd if nulls else odd.where("__id is not null")).isEmpty():
        return docs.withColumn("__row", doc_id), False
    out = docs.join(small(odd.where("__id is not null")), doc_id == F.col("__id"), "left")
    row = F.when(doc_id.isNull(), own if nulls else F.lit(None)).when(F.col("__low").isNull() | (F.col("__low") == text), doc_id).otherwise(own)
    return out.withColumn("__row", row).drop("__id", "__low"), True


def near_duplicates(docs: DataFrame, **parameters) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) and kept (doc_id = component_id); parameters: those of linked."""
    rows, differ = with_rows(docs.select("doc_id", "text"), False)
    if not differ:
        return linked(docs, **parameters)
    names = rows.select(F.col("__row").alias("row"), F.col("doc_id").cast("long").alias("name")).where("row is not null").distinct()
    found = linked(rows.select(F.col("__row").alias("doc_id"), "text"), **parameters).withColumnRenamed("doc_id", "row").join(names, "row", "left")
    found = cut(found)
    smallest = found.where("component_id is not null").groupBy("component_id").agg(F.min("name").alias("smallest"))
    found = found.join(smallest, "component_id", "left")
    return found.select(F.col("name").alias("doc_id"), "n_shingles", F.col("smallest").alias("component_id"), F.coalesce(F.col("name") == F.col("smallest"), F.lit(True)).alias("kept"))


def linked(docs: DataFrame, percent: int = 80, words: int = 2, coordinates: int = 64, match: int = 38, centers: int = 2) -> DataFrame:
    """What near_duplicates() returns, for docs of which no doc_id stands on different texts."""
    sketches = cut(sketch(docs, words, coordinates))
    known = sketches.where("n_shingles > 0 and doc_id is not null")
    repeated = not known.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    single = (lambda df: df.dropDuplicates(["rep"])) if repeated else (lambda df: df)  # sets are shuffled only where rows repeat
    classes = cut(known.groupBy("d1", "d2", "n_shingles", "sig").agg(F.min("doc_id").alias("rep")))
    sigs = classes.select("rep", "sig")

    posts = postings(sigs, coordinates)
    shared = posts.groupBy("key").agg(F.count("*").alias("freq")).where("freq > 1")
    by_rep = Window.partitionBy("rep")
    lists = posts.join(shared, "key").withColumn("s", F.count("*").over(by_rep)).where(F.col("s") >= match)
    lists = lists.withColumn("place", F.row_number().over(by_rep.orderBy("freq", "key"))).withColumn("weight", F.sum(F.log("freq")).over(by_rep))
    lists = lists.where(F.col("place") <= F.col("s") - match + 1).select("key", "rep", "freq", "weight")
    lists = cut(lists.join(low_bytes(sigs, coordinates), "rep"))
    labels = cut(lists.select("rep").distinct().withColumn("comp", F.col("rep")))

    def make():
        memo = word_memo()

        def step(x: dict) -> dict:
            return {"rep": x["doc_id"], "set": [s.astype("<u8").tobytes() for s in shingle_sets(x["text"], memo, words)]}

        return step

    def sets_of(reps: DataFrame) -> DataFrame:
        found = small(reps.select(F.col("rep").alias("doc_id")).distinct())
        return cut(single(map_rows(id_text(docs).join(found, "doc_id", "left_semi"), make, "rep long, set binary")))

    short = lists.where(F.col("freq") <= SMALL)
    other = short.select("key", F.col("rep").alias("a"), *[F.col(m).alias(f"a_{m}") for m in MINIS])
    near = short.join(other, "key").where(F.col("a") < F.col("rep")).where(alike("a_", "")).select("a", F.col("rep").alias("b")).distinct()

    long = lists.where(F.col("freq") > SMALL)
    order = F.struct("weight", F.xxhash64("rep"))
    heads = long.groupBy("key", F.pmod(F.xxhash64("rep"), F.lit(centers)).alias("salt")).agg(F.max_by(F.struct("rep", "weight", *MINIS), order).alias("head"))
    heads = heads.select("key", "salt", F.col("head.rep").alias("a"), F.col("head.weight").alias("a_weight"), *[F.col(f"head.{m}").alias(f"a_{m}") for m in MINIS])
    # of all centres in its lists a class keeps the most central one of each salt, so that dense groups gather round the same few
    starred = long.join(heads, "key").where(F.col("a") != F.col("rep")).where(alike("a_", "", CLUSTER_ALIKE))
    starred = starred.groupBy(F.col("rep").alias("b"), "salt").agg(F.max_by("a", F.struct("a_weight", "a")).alias("a"))
    starred = cut(agreeing(starred.select("a", "b"), sigs, CLUSTER))

    pairs = cut(agreeing(near, sigs, match).select("a", "b").union(starred.where(F.col("n") >= match).select("a", "b")).distinct())
    labels = contracted(labels, confirmed(pairs, sets_of(pairs.select(F.explode(F.array("a", "b")).alias("rep"))), percent))

    # centres that lie in another centre's cluster are followed, so that a dense group is one cluster
    clusters = contracted(labels.select("rep", F.col("rep").alias("comp")), starred.select("a", "b")).withColumnRenamed("comp", "center")
    members = clusters.join(labels, "rep")
    sizes = members.groupBy("center", "comp").agg(F.count("*").alias("n"))
    main = sizes.groupBy("center").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.sum("n").alias("all"), (F.sum("n") - F.max("n")).alias("left")).where("left > 0")
    members = cut(members.join(small(main), "center").join(classes.select("rep", (8 * F.col("n_shingles")).alias("bytes")), "rep"))
    weights = members.groupBy("center").agg(F.sum("bytes").alias("all_bytes"), F.sum(F.when(F.col("comp") != F.col("main"), F.col("bytes"))).alias("left_bytes"))
    full = members.join(small(weights), "center").join(sigs, "rep").join(sets_of(members), "rep")
    chunks = F.greatest(F.ceil(F.col("left") / REST), F.ceil(F.col("left_bytes") / REST_BYTES)).cast("int")
    blocks = F.greatest(F.ceil(F.col("all") / BLOCK), F.ceil(F.col("all_bytes") / BLOCK_BYTES)).cast("int")
    place = F.xxhash64("rep", F.lit(1))
    columns = ["center", "chunk", "block", "rest", "rep", "comp", "sig", "set"]
    rest = full.where("comp <> main").withColumn("chunk", F.pmod(place, chunks).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumn("rest", F.lit(True))
    all_of = full.withColumn("block", F.pmod(place, blocks).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks - 1))).withColumn("rest", F.lit(False))
    labels = contracted(labels, block_links(rest.select(*columns).unionByName(all_of.select(*columns)), match, percent))

    # across clusters of one list
    placed = long.join(clusters, "rep").join(labels, "rep")
    by_cluster = placed.groupBy("key", "center").agg(F.count("*").alias("n"))
    several = by_cluster.groupBy("key").agg(F.max_by("center", F.struct("n", "center")).alias("main"), F.count("*").alias("n_clusters")).where("n_clusters > 1").select("key", "main")
    placed = cut(placed.join(several, "key"))
    other = placed.where("center <> main").select("key", F.col("rep").alias("a"), F.col("center").alias("a_center"), F.col("comp").alias("ca"), *[F.col(m).alias(f"a_{m}") for m in MINIS])
    pairs = placed.join(other, "key").where("a_center <> center and ca <> comp and (center = main or a < rep)").where(alike("a_", "")).select("a", F.col("rep").alias("b")).distinct()
    pairs = cut(agreeing(pairs, sigs, match).select("a", "b"))
    labels = contracted(labels, confirmed(pairs, sets_of(pairs.select(F.explode(F.array("a", "b")).alias("rep"))), percent))

    # a component's id is the smallest document of its classes, and a class's rep is its smallest
    tops = classes.join(labels, "rep", "left").select("d1", "d2", "n_shingles", F.coalesce("comp", "rep").alias("component_id"))
    own = ["d1", "d2", "n_shingles"]
    placed = sketches.join(tops, own, "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return placed.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, **parameters) -> DataFrame:
    """docs with one document of each group, the one with the smallest doc_id.

    Of rows that repeat a doc_id and its text one stays. Texts that share a
    doc_id, and rows without doc_id, are judged each by its text.
    """
    rows, _ = with_rows(docs, True)
    found = cut(linked(rows.select(F.col("__row").alias("doc_id"), "text"), **parameters))
    dropped = small(found.where("not kept").select(F.col("doc_id").alias("__row")).distinct())
    out = rows.join(dropped, "__row", "left_anti")
    if not found.where("kept").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        out = out.dropDuplicates(["__row"])
    return out.select(*docs.columns)
