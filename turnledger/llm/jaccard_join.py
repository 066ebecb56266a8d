"""Operator 5: exact self-join of n-gram sets on Jaccard similarity.

Universe partitioning with the pigeonhole principle.  Two sets with a
similarity of at least ``t`` differ in at most ``(1-t)/(1+t) * (|a|+|b|)``
elements.  Tokens (word n-grams) are hashed into ``m`` segments, the number
depending on a band of set sizes.  If the allocation over the segments, 1 for
one whose whole subset is indexed and 2 for one whose one-deletion
neighbourhood is indexed too, sums to more than the largest possible
difference, a similar pair has an equal subset in some segment, or one within
one deletion in some segment of the second kind.

A set is indexed in the band of its size, and in the next band where a larger
partner may lie.  Empty subsets are not indexed, nor the empty deletion of a
single element; the slack in the allocation pays for them, and a set with more
of these than the slack indexes them too, so that nothing is lost.

Sets that share a key are not paired with each other: each goes to the smallest
id under the key (its hub).  Any pair that shares a key also shares that key's
hub.  The members of a hub are compared by sketches first, the counts of their
tokens in a few hundred buckets: the sum of the smaller counts bounds an
intersection from above, so a pair under the threshold there is no link.  The
components of the pairs that remain are clusters, in which every document lies
once; within them exact intersection counts decide.  Both comparisons are dealt
out as pairs of blocks of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnledger.llm.common import Scratch, free_shuffles, keep_ids, only
from turnledger.llm.components import connected_components
from turnledger.llm.words import byte_table, hash_words, mix, slices

_SPACE = byte_table("space")
_C = [np.uint64(x) for x in (0x8CB92BA72F3D8DD7, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def shingles(h: np.ndarray, first: np.ndarray, n: int) -> list[np.ndarray]:
    """The sorted distinct n-word shingles of each text, as 64-bit hashes.

    A text of fewer words, but not none, has one element: its whole sequence.
    """
    k = len(h)
    roll = np.zeros(k, np.uint64)
    for j in range(min(n, k)):
        part = h[j:] * _C[j % 4] + np.uint64(j)
        roll[: k - j] = mix(roll[: k - j] + part)
    out = []
    for i in range(len(first) - 1):
        a, b = int(first[i]), int(first[i + 1])
        if b - a >= n:
            out.append(np.unique(roll[a : b - n + 1]))
        elif b > a:
            x = np.array([b - a], np.uint64)
            for j in range(a, b):
                x = mix(x + h[j : j + 1] * _C[0])
            out.append(x)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def identity(s: np.ndarray) -> tuple[int, int]:
    """128 bits that depend on the set alone."""
    return tuple(int(mix(s ^ c).sum(dtype=np.uint64).astype(np.int64)) for c in _C[:2])


class Bands:
    """The allocation for each band of set sizes.

    ``percent``: least similarity in hundredths.  Band b holds sizes from
    ``low[b]`` to ``low[b+1] - 1``, each about ``1 / t**2`` times the last.
    ``allocation[b]`` is (m, r, slack): m segments, the first r with one-deletion
    neighbourhoods, so that m + r = difference + 1 + slack.
    """

    def __init__(self, percent: int, sizes: dict[int, int] | None = None):
        t = percent / 100
        self.percent, self.low = percent, [1]
        while self.low[-1] < 1 << 31:
            self.low.append(max(self.low[-1] + 1, math.ceil(self.low[-1] / t / t)))
        self.allocation = [self._allocate(b, (sizes or {}).get(b, 1)) for b in range(len(self.low) - 1)]

    def band(self, n: int) -> int:
        return int(np.searchsorted(self.low, n, "right")) - 1

    def next(self, n: int) -> int | None:
        """The next band, if a larger set that is similar may lie in it."""
        b = self.band(n) + 1
        return b if 100 * n >= self.percent * self.low[b] else None

    def _allocate(self, b: int, rows: int, shared: float = 1e-4, check: float = 5.0, spare: float = 6.0) -> tuple[int, int, int]:
        """The cheapest allocation: keys made, plus ``check`` for each expected candidate.

        ``shared`` is the assumed share of a band's sets with which a segment of
        a single element is shared; ``spare`` are the standard deviations of the
        number of empty segments that the slack has room for, so that few sets
        index empty segments, whose keys all those sets share.  Both change costs
        only, not results.
        """
        low, high = max(1, self.low[b] * self.percent // 100), self.low[b + 1] - 1  # sets of the band before lie here too
        differ = (100 - self.percent) * 2 * high // (100 + self.percent)
        if differ == 0:
            return 1, 0, 0
        best = None
        for r in range(1, min(differ, 64) + 1):
            m = max(r, differ + 1 - r)
            thin = math.exp(-low / m)
            empty = m * thin + r * (low / m + 1) * thin
            slack = m + r - differ - 1 + math.ceil(empty + spare * math.sqrt(empty)) + 1
            m = differ + 1 + slack - r
            s = low / m
            cost = m + r * (s + 1) + check * rows * shared * m * s * math.exp(-s)
            if best is None or cost < best[0]:
                best = cost, (m, r, slack)
        return best[1]

    def keys(self, s: np.ndarray) -> np.ndarray:
        """The index keys of a sorted distinct set; none for sets without a different similar set."""
        n, out = len(s), []
        b = self.band(n)
        for b in (b, self.next(n)):
            if b is None or (100 - self.percent) * 2 * (self.low[b + 1] - 1) // (100 + self.percent) == 0:
                continue
            m, r, slack = self.allocation[b]
            base = np.uint64((b + 1) * int(_C[2]) % (1 << 64))
            token = mix(s + base)
            segment = ((token >> np.uint64(33)) % np.uint64(m)).astype(np.int64)
            total = np.zeros(m, np.uint64)
            np.add.at(total, segment, token)
            count = np.bincount(segment, minlength=m)
            place = mix(np.arange(m, dtype=np.uint64) * _C[3] + base)
            whole = mix(total ^ place)
            use = count > 0
            near = (segment < r) & (count[segment] > 1)
            if m - int(use.sum()) + int((count[:r] < 2).sum()) > slack:
                use[:] = True
                near = segment < r
            out.append(whole[use])
            if near.any():
                out.append(mix((total[segment[near]] - token[near]) ^ place[segment[near]]))
        return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def _texts(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    for rows, data, bounds in slices(batches):
        h, _, _, first = hash_words(data, bounds, _SPACE)
        yield rows.column("doc_id"), shingles(h, first, n)


#: Buckets of a sketch.
SKETCH = 256


def sketch(s: np.ndarray) -> np.ndarray:
    """Counts of a set's tokens by bucket."""
    return np.minimum(np.bincount((mix(s ^ _C[3]) >> np.uint64(56)).astype(np.int64), minlength=SKETCH), 65535).astype(np.uint16)


def _forest(near: Callable[[int, np.ndarray], np.ndarray], n: int) -> list[tuple[int, int]]:
    """A spanning forest of n nodes; ``near(i, others)`` marks the others that i is linked with."""
    left, out = np.arange(n), []
    while len(left):
        stack, left = [int(left[0])], left[1:]
        while stack and len(left):
            i = stack.pop()
            hit = near(i, left)
            found = left[hit]
            left = left[~hit]
            out.extend((i, int(j)) for j in found)
            stack.extend(found.tolist())
    return out


def _possible(sketches: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs whose upper bound reaches the threshold.

    A bound from buckets added up by eights, which is weaker and cheaper, sorts most pairs out.
    """
    x = np.array(sketches)
    size = x.sum(1, dtype=np.int64)
    full = (x == 65535).any(1)
    coarse = np.minimum(x.reshape(len(x), -1, 8).sum(2, dtype=np.int64), 65535).astype(np.uint16)
    full |= (coarse == 65535).any(1)

    def reaches(table, i, others):
        both = np.minimum(table[i], table[others]).sum(1, dtype=np.int64)
        both = np.where(full[i] | full[others], np.minimum(size[i], size[others]), both)
        return 100 * both >= percent * (size[i] + size[others] - both)

    def near(i, others):
        out = reaches(coarse, i, others)
        at = np.flatnonzero(out)
        out[at] = reaches(x, i, others[at])
        return out

    return _forest(near, len(x))


def _linked(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among sets, by exact intersection counts.

    Tokens of many sets are multiplied out as columns of a matrix, a slice at a
    time; those of few are counted pair by pair; those of one count for nothing.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets])
    if n == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(0, 1)] if 100 * both >= percent * (size.sum() - both) else []
    _, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), size)
    keep = count[token] > 1
    token, owner = token[keep], owner[keep]
    both = np.zeros((n, n), np.int64)
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]]) if len(token) else np.zeros(0, np.int64)
    ends = np.r_[starts[1:], len(token)].astype(np.int64)[: len(starts)]
    dense = (ends - starts) > 24
    if dense.any():
        column = np.cumsum(dense) - 1
        which = np.repeat(np.arange(len(starts)), ends - starts)
        width = 1024
        for c in range(0, int(dense.sum()), width):
            pick = dense[which] & (column[which] >= c) & (column[which] < c + width)
            x = np.zeros((n, width), np.float32)
            x[owner[pick], column[which[pick]] - c] = 1
            both += (x @ x.T).astype(np.int64)
    for f in np.unique((ends - starts)[~dense]):
        rows = owner[starts[(ends - starts) == f][:, None] + np.arange(f)]
        for i in range(f):
            for j in range(i + 1, f):
                np.add.at(both, (rows[:, i], rows[:, j]), 1)
                np.add.at(both, (rows[:, j], rows[:, i]), 1)
    return _forest(lambda i, others: 100 * both[i, others] >= percent * (size[i] + size[others] - both[i, others]), n)


def _dealt(members: DataFrame, load: DataFrame) -> DataFrame:
    """(hub, p, q, doc_id): the members of a hub as pairs of blocks; load: hub and blocks."""
    rows = members.join(load, "hub").withColumn("k", F.pmod(F.xxhash64("doc_id", "hub"), "blocks").cast("int"))
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select("hub", F.least("k", "j").alias("p"), F.greatest("k", "j").alias("q"), "doc_id")


def _compare(column: str, kind: type, links: Callable[[list[np.ndarray], int], list[tuple[int, int]]], percent: int):
    """A mapInArrow body over rows sorted by (hub, p, q): the links of each pair of blocks, as (a, b)."""

    def run(batches):
        group, ids, found = None, [], []

        def flush():
            if len(ids) > 1:
                found.extend((ids[i][0], ids[j][0]) for i, j in links([x for _, x in ids], percent))
            ids.clear()

        def batch_of():
            out = pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})
            found.clear()
            return out

        for batch in batches:
            hub, p, q, d = (batch.column(c).to_pylist() for c in ("hub", "p", "q", "doc_id"))
            data = batch.column(column)
            for i in range(batch.num_rows):
                if (key := (hub[i], p[i], q[i])) != group:
                    flush()
                    group = key
                ids.append((d[i], np.frombuffer(data[i].as_buffer(), kind).copy()))
            if found:
                yield batch_of()
        flush()
        yield batch_of()

    return run


def jaccard_components(docs: DataFrame, n: int = 4, percent: int = 85, block_docs: int = 1200, block_tokens: int = 1_000_000) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each document, by links of similarity ``percent``.

    docs: doc_id and text; other columns are ignored.  A set is the distinct
    n-word shingles of the lower-cased text; documents with fewer words have
    one element, the whole sequence.  Null and empty texts have an empty set,
    a class of their own and no links.  Equal sets are one class, of which one
    representative is compared.  Repeated rows give repeated rows; different texts
    under one doc_id are sets of one document, which has the links of all.  Rows
    without a doc_id have no links and a null component.  An empty table gives no
    rows.  ``block_docs`` and ``block_tokens`` bound what one
    task compares in memory; larger groups are dealt out as pairs of blocks.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    docs = only(docs, doc_id="long", text="string")

    def sizes(batches):
        for ids, sets in _texts(batches, n):
            who = [identity(s) for s in sets]
            yield pa.RecordBatch.from_pydict({"doc_id": ids, "n_shingles": pa.array([len(s) for s in sets], pa.int64()), "s1": pa.array([x for x, _ in who], pa.int64()), "s2": pa.array([x for _, x in who], pa.int64()), "sketch": pa.array([sketch(s).tobytes() for s in sets], pa.binary())})

    sized = scratch.write(docs.mapInArrow(sizes, "doc_id long, n_shingles long, s1 long, s2 long, sketch binary"), "sizes")
    named = sized.where("n_shingles > 0 and doc_id is not null").select("doc_id", "s1", "s2", "n_shingles")
    several = named.groupBy("doc_id").agg(F.min(F.struct("s1", "s2", "n_shingles")).alias("a"), F.max(F.struct("s1", "s2", "n_shingles")).alias("b"))
    several = scratch.write(several.where("a <> b").select("doc_id"), "several")
    first = named.groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("top"))
    equal = scratch.write(named.join(first.where("top > rep"), ["s1", "s2", "n_shingles"]).where("doc_id <> rep").select("doc_id", "rep").distinct(), "equal")
    copies = keep_ids(equal, several, "left_anti")
    histogram = {r[0]: r[1] for r in first.groupBy(F.floor(F.log2("n_shingles") * 4).alias("q")).count().collect()}
    counts: dict[int, int] = {}
    probe = Bands(percent)
    for q, c in histogram.items():
        b = probe.band(max(1, int(2 ** (q / 4))))
        counts[b] = counts.get(b, 0) + c
    bands = Bands(percent, counts)

    def keyed(batches):
        for ids, sets in _texts(batches, n):
            keys = [bands.keys(s) if len(s) else s for s in sets]
            lengths = [len(k) for k in keys]
            yield pa.RecordBatch.from_pydict({"key": pa.array(np.concatenate(keys).view(np.int64)), "doc_id": pa.array(np.repeat(ids.to_numpy(), lengths), pa.int64())})

    docs = docs.where("doc_id is not null")
    reps = keep_ids(docs, copies.select("doc_id"), "left_anti")
    keys = reps.mapInArrow(keyed, "key long, doc_id long")
    same = Window.partitionBy("key")
    star = keys.withColumn("hub", F.min("doc_id").over(same)).where("hub <> doc_id").groupBy("hub", "doc_id").agg(F.lit(1).alias("x")).drop("x")
    star = scratch.write(star, "star")
    free_shuffles(spark)

    by = ("hub", "p", "q")
    members = star.select("hub", "doc_id").unionByName(star.select("hub", F.col("hub").alias("doc_id")).distinct())
    load = members.groupBy("hub").agg(F.ceil(F.count("*") / block_docs).cast("int").alias("blocks"))
    drawn = _dealt(members, load).join(sized.select("doc_id", "sketch"), "doc_id").repartition(*by).sortWithinPartitions(*by, "doc_id")
    clusters = connected_components(spark, drawn.mapInArrow(_compare("sketch", np.uint16, _possible, percent), "a long, b long"), scratch)
    clusters = scratch.write(clusters.select(F.col("component").alias("hub"), F.col("node").alias("doc_id")), "clusters")
    scratch.drop("star")
    free_shuffles(spark)

    def kept(batches):
        for ids, sets in _texts(batches, n):
            yield pa.RecordBatch.from_pydict({"doc_id": ids, "tokens": pa.array([s.tobytes() for s in sets], pa.binary())})

    load = clusters.join(sized.select("doc_id", "n_shingles"), "doc_id").groupBy("hub").agg(F.count("*").alias("c"), F.sum("n_shingles").alias("t"))
    load = load.select("hub", F.ceil(F.greatest(F.col("c") / block_docs, F.col("t") / block_tokens)).cast("int").alias("blocks"))
    sets = keep_ids(docs, clusters.select("doc_id")).mapInArrow(kept, "doc_id long, tokens binary")
    drawn = _dealt(clusters, load).join(sets, "doc_id").repartition(*by).sortWithinPartitions(*by, "doc_id")
    links = drawn.mapInArrow(_compare("tokens", np.uint64, _linked, percent), "a long, b long")
    links = links.unionByName(keep_ids(equal, several).select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    classes = connected_components(spark, links, scratch)
    free_shuffles(spark)
    near = sized.select("doc_id", "n_shingles").join(copies, "doc_id", "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    out = near.join(classes, near.rep == classes.node, "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))


def near_duplicate_stage(docs: DataFrame, **options) -> DataFrame:
    """docs without all but the smallest doc_id of each class; all columns stay.

    Rows of one doc_id go or stay together.  Null, empty and blank texts are classes
    of their own and stay, as do rows without an id.  An empty table gives an
    empty one.
    """
    spark = docs.sparkSession
    classes = jaccard_components(docs, **options)
    drop = Scratch(spark, "jaccard-drop").write(classes.where("component_id <> doc_id").select("doc_id").distinct(), "drop")
    return keep_ids(docs, drop, "left_anti")
