"""Operator 8: quality rules with an n-gram perplexity band for each language.

The language model is a modified Kneser-Ney model over the characters themselves,
two for each value of lang, of one half of its different texts each; a text is
scored by the half that it isn't in.  Spark counts the n-grams of the whole corpus and
derives continuation counts, discounts and probabilities by aggregates and joins
over (lang, n-gram), so the model grows with the corpus and never meets in one
place.  It is kept in the shared folder as hashes of n-grams with their values,
dealt out to shards by the two characters before the last, so that all that a
position of a text may look up lies in one shard.  A shard, of bounded size, is
sorted and broadcast, and texts pass the shards one after another, adding up the
log-probabilities of the positions that a shard answers for.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnledger.llm.common import BROADCAST_IDS, Scratch, free_shuffles, keep_ids, only
from turnledger.llm.words import byte_table, hash_words, mix, slices

#: Characters of an n-gram.
ORDER = 5
#: Entries of the model that a shard holds, 12 bytes each.
SHARD = 8_000_000
_EXACT = byte_table("space")
_EXACT[65:91] = np.arange(65, 91)
_SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_M = np.uint64(0xD1342543DE82EF95)
_GAP = np.isin(np.arange(129), [0, *range(9, 14), 32])
_MARK = np.array([c < 128 and not chr(c).isalnum() for c in range(129)])
_KIND = _GAP + 2 * _MARK.astype(np.uint8)


def named(lang: str | None) -> str:
    """The key of a language's model and band: its value, ``und`` for null."""
    return "und" if lang is None else lang


def seed(lang: str) -> np.uint64:
    """The hash of a language's empty n-gram."""
    out = np.array([len(lang)], np.uint64)
    for c in lang:
        out = mix(out * _M + np.uint64(ord(c)))
    return out[0]


def characters(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, where each text begins and the end): runs of white space are one space, runs of one ASCII mark one mark, and ORDER - 1 spaces stand before each text."""
    cp = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    at = np.r_[0, np.cumsum((data & 0xC0) != 0x80)][bounds] if len(data) else np.zeros(len(bounds), np.int64)
    kind = _KIND[np.minimum(cp, 128)]
    cp = np.where((kind & 1).view(bool), np.uint32(32), cp)
    head = np.zeros(len(cp) + 1, bool)
    head[at] = True
    mark = kind > 1  # a space is a mark
    keep = ~mark | np.r_[True, cp[1:] != cp[:-1]][: len(cp)] | head[:-1]
    n = np.r_[0, np.cumsum(keep)][at]
    out = np.full(int(n[-1]) + (ORDER - 1) * (len(bounds) - 1), 32, np.uint32)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(n))
    out[np.arange(int(n[-1])) + (ORDER - 1) * (text + 1)] = cp[keep]
    return out, n + (ORDER - 1) * np.arange(len(bounds))


def positions(begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of the texts' own characters, text of each)."""
    n = np.diff(begin) - (ORDER - 1)
    text = np.repeat(np.arange(len(n)), n)
    return np.arange(int(n.sum())) + (ORDER - 1) * (text + 1), text


#: Multipliers of the characters of an n-gram, from the last.
_R = mix(np.arange(1, ORDER + 1, dtype=np.uint64) * _M) | np.uint64(1)


class Suffixes:
    """Hashes of the last characters at each place, begun with the language's: sums of products with fixed numbers, finalised."""

    def __init__(self, c: np.ndarray, at: np.ndarray, start: np.ndarray | np.uint64, order: int):
        self.sums = [np.broadcast_to(np.asarray(start, np.uint64), at.shape)]
        for o in range(order):
            self.sums.append(self.sums[-1] + (c[at - o].astype(np.uint64) + np.uint64(1)) * _R[o])

    def hashes(self, order: int, which: np.ndarray | slice = slice(None)) -> np.ndarray:
        return mix(self.sums[order][which])


def gram_sums(c: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``Suffixes(c, at, 0, ORDER).sums[ORDER]``, with the products made once a character."""
    x = c.astype(np.uint64) + np.uint64(1)
    sums = x[ORDER - 1 :] * _R[0]
    for o in range(1, ORDER):
        sums += x[ORDER - 1 - o : len(x) - o] * _R[o]
    return sums[at - (ORDER - 1)]


def repeats(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(an order in which equal hashes stand together, as they stood, where each different one begins in it).

    Sorts values, the place in the low bits, as that is several times faster than an
    argsort; where two hashes have all other bits alike it sorts the whole ones.
    """
    bits = np.uint64(len(h).bit_length())
    order = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)
    order.sort()
    order = (order & np.uint64((1 << int(bits)) - 1)).view(np.int64)
    g = h[order]
    new = g[1:] != g[:-1]
    if (new & (g[1:] >> bits == g[:-1] >> bits)).any():
        order = np.argsort(h, kind="stable")
        g = h[order]
        new = g[1:] != g[:-1]
    return order, np.flatnonzero(np.r_[True, new][: len(h)])


def shard_of(before: np.ndarray, last: np.ndarray, shards: int) -> np.ndarray:
    """The shard of positions by the two characters before them."""
    return (mix(before.astype(np.uint64) * _M + last.astype(np.uint64)) % np.uint64(shards)).astype(np.int64)


def count_ngrams(docs: DataFrame, held: int = 1 << 19) -> DataFrame:
    """(lang, gram, n0, n1) over all texts, by fold; a task adds up its own counts, of about ``held`` n-grams at a time."""

    def run(batches):
        parts: list[tuple[np.ndarray, ...]] = []  # hash, language, numbers, characters
        names: dict[str, int] = {}

        def summed():
            columns = [list(x) for x in zip(*parts, strict=True)]  # hash, language, numbers, characters
            parts.clear()
            whole = lambda: np.concatenate(columns.pop())  # noqa: E731  one column at a time, so that no second copy of all is held
            h = np.concatenate(columns[0])
            order, start = repeats(h)
            first = order[start]
            h = h[first]
            c, n = whole()[first], whole()  # n: a column a fold
            n = np.stack([np.add.reduceat(n[order, k], start) for k in (0, 1)], 1)
            parts.append((h, whole()[first], n, c))

        def batches_of():
            _, lang, n, c = parts[0]
            known = pa.array(list(names), pa.string())
            for i in range(0, len(n), 1 << 16):
                grams = np.ascontiguousarray(c[i : i + (1 << 16)]).view(f"<U{ORDER}").ravel().tolist()
                yield pa.RecordBatch.from_arrays([known.take(pa.array(lang[i : i + (1 << 16)])), pa.array(grams, pa.string()), *(pa.array(n[i : i + (1 << 16), k]) for k in (0, 1))], ["lang", "gram", "n0", "n1"])

        size = 0
        for rows, data, bounds in slices(batches):
            c, begin = characters(data, bounds)
            at, text = positions(begin)
            langs = np.array([names.setdefault(x, len(names)) for x in map(named, rows.column("lang").to_pylist())], np.int64)[text]
            if not len(at):
                continue
            h = mix(gram_sums(c, at) + np.array([seed(x) for x in names], np.uint64)[langs])
            order, start = repeats(h)
            ones = np.add.reduceat(rows.column("fold").to_numpy()[text[order]], start)
            n, first = np.diff(np.r_[start, len(h)]), order[start]
            parts.append((h[first], langs[first].astype(np.int32), np.stack([n - ones, ones], 1), c[at[first][:, None] + np.arange(1 - ORDER, 1)]))
            size += len(n)
            if size > 2 * held:
                summed()
                size = len(parts[0][0])
                if size > held:
                    yield from batches_of()
                    parts.clear()
                    names.clear()
                    size = 0
        if parts:
            summed()
            yield from batches_of()
            parts.clear()
        pa.default_memory_pool().release_unused()

    return docs.select("text", "lang", "fold").mapInArrow(run, "lang string, gram string, n0 long, n1 long").groupBy("lang", "gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _model_of(lang: Column, fold: Column) -> Column:
    """The key of the model of a half of a language's texts."""
    return F.concat(lang, F.lit("|"), fold.cast("string"))


def train(scratch: Scratch, docs: DataFrame) -> DataFrame:
    """(lang, gram, kind, value) of a model for each lang, and for each fold of it where docs have one, 0 or 1: for kind 0 the log-probability of an n-gram's last character after the others, for kind 1 the log of the weight that a history leaves to the shorter one.

    Discounts are those of modified Kneser-Ney, by language and order; shorter
    n-grams count the distinct characters before them.  Below the single
    characters all of a language's characters, and one for the unseen, are equal:
    the empty history's value is the log-probability of an unseen character.
    """
    folded = "fold" in docs.columns
    counts = scratch.write(count_ngrams(docs if folded else docs.withColumn("fold", F.lit(0).cast("long"))), f"level-{ORDER}")
    half = lambda k: counts.where(f"n{k} > 0").select(_model_of(F.col("lang"), F.lit(k)).alias("lang"), "gram", F.col(f"n{k}").alias("n"))
    levels = {ORDER: half(0).unionByName(half(1)) if folded else counts.select("lang", "gram", F.col("n0").alias("n"))}
    for o in range(ORDER - 1, 0, -1):
        levels[o] = levels[o + 1].groupBy("lang", F.substring("gram", 2, o).alias("gram")).agg(F.count("*").alias("n"))
        if o == ORDER - 1:  # the others are made anew from it, as they are far smaller
            levels[o] = scratch.write(levels[o], f"level-{o}")
    few = levels[ORDER - 1].select("lang").distinct().count() <= BROADCAST_IDS  # rows of a table of discounts
    lower, out = None, None
    for o in range(1, ORDER + 1):
        of = [F.greatest(F.lit(1), F.count(F.when(F.col("n") == i, 1))).alias(f"n{i}") for i in range(1, 5)]
        y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
        cut = [F.least(F.greatest(i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}"), F.lit(0.05)), F.lit(float(i))) for i in (1, 2, 3)]
        discounts = levels[o].groupBy("lang").agg(*of, F.count("*").alias("size")).select("lang", "size", *(x.alias(f"d{i}") for i, x in enumerate(cut, 1)))
        same = Window.partitionBy("lang", "history")
        t = levels[o].join(F.broadcast(discounts) if few else discounts, "lang").withColumn("history", F.substring("gram", 1, o - 1) if o > 1 else F.lit(""))
        t = t if few else t.repartition("lang", "history")  # or the window would take the join's partitions, a language each
        t = t.withColumn("d", F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3")))
        t = t.withColumn("total", F.sum("n").over(same)).withColumn("left", F.sum("d").over(same) / F.col("total"))
        if o > 1:
            t = t.withColumn("tail", F.substring("gram", 2, o - 1)).join(lower.select("lang", F.col("gram").alias("tail"), F.col("p").alias("below")), ["lang", "tail"])
        else:
            t = t.withColumn("below", 1 / (F.col("size") + 1))
        lower = scratch.write(t.select("lang", "gram", "history", "left", "below", ((F.col("n") - F.col("d")) / F.col("total") + F.col("left") * F.col("below")).alias("p")), f"order-{o}")
        grams = lower.select("lang", "gram", F.lit(0).alias("kind"), F.log("p").alias("value"))
        value = F.log(F.greatest(F.col("left"), F.lit(1e-9)) * (F.col("below") if o == 1 else F.lit(1.0)))
        histories = lower.groupBy("lang", F.col("history").alias("gram")).agg(F.lit(1).alias("kind"), F.max(value).alias("value"))
        part = grams.unionByName(histories)
        out = part if out is None else out.unionByName(part)
    return out


class Shard:
    """Sorted hashes of the n-grams and histories of a shard, with their values and where each prefix of hashes begins."""

    def __init__(self, number: int, shards: int, tables: Iterable[pa.Table]):
        """tables: the hashes and values of n-grams, then those of histories."""
        self.number, self.shards, self.arrays = number, shards, []
        for table in tables:
            key, value = table.column("key").to_numpy().view(np.uint64), table.column("value").to_numpy()
            order = np.argsort(key)
            key, value, bits = key[order], value[order], max(1, len(key).bit_length())
            start = np.searchsorted(key, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
            self.arrays.append((key, value, np.r_[start, len(key)].astype(np.int32), np.uint64(64 - bits)))

    def find(self, kind: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether each hash is there, its value or 0)."""
        key, value, start, shift = self.arrays[kind]
        hit, out = np.zeros(len(h), bool), np.zeros(len(h), np.float32)
        slot = (h >> shift).astype(np.int64)
        at, end = start[slot], start[slot + 1]
        todo = np.flatnonzero(at < end)
        while len(todo):
            same = key[at[todo]] == h[todo]
            yes = todo[same]
            hit[yes], out[yes] = True, value[at[yes]]
            todo = todo[~same]
            at[todo] += 1
            todo = todo[at[todo] < end[todo]]
        return hit, out

    def mine(self, c: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The places that this shard answers for."""
        return at if self.shards == 1 else at[shard_of(c[at - 2], c[at - 1], self.shards) == self.number]

    def score(self, c: np.ndarray, at: np.ndarray, start: np.ndarray | np.uint64) -> np.ndarray:
        """The log-probability of the character at each of its places, by ``scores``."""
        return next(self.scores(c, at, [start]))

    def scores(self, c: np.ndarray, at: np.ndarray, starts: Iterable[np.ndarray | np.uint64]) -> Iterator[np.ndarray]:
        """The log-probabilities at the places for each of ``starts``; an n-gram is looked up once, for places alike under the first, which have to be alike under the others."""
        sums, order = gram_sums(c, at), None
        for start in starts:
            start = np.broadcast_to(np.asarray(start, np.uint64), at.shape)
            if order is None:
                order, group = repeats(mix(sums + start))
                first, sizes = order[group], np.diff(np.r_[group, len(at)])
                sums, ends = sums[first], at[first]
            start, out = start[first], np.empty(len(at), np.float64)
            hit, value = self.find(0, mix(sums + start))
            value, miss = value.astype(np.float64), np.flatnonzero(~hit)
            value[miss] = self.backed_off(c, ends[miss], start[miss])
            out[order] = np.repeat(value, sizes)
            yield out

    def backed_off(self, c: np.ndarray, at: np.ndarray, start: np.ndarray) -> np.ndarray:
        """The log-probability of the character at each place, whose n-gram of ORDER characters wasn't seen."""
        out, todo = np.zeros(len(at), np.float64), np.arange(len(at))
        grams, before = Suffixes(c, at, start, ORDER - 1), Suffixes(c, at - 1, start, ORDER - 1)
        for o in range(ORDER - 1, -1, -1):
            out[todo] += self.find(1, before.hashes(o, todo))[1]
            if o:
                hit, value = self.find(0, grams.hashes(o, todo))
                out[todo] += value
                todo = todo[~hit]
            if not len(todo):
                break
        return out


def sharded(scratch: Scratch, model: DataFrame) -> tuple[DataFrame, int]:
    """(the model's rows as (shard, kind, key, value), the number of shards); rows of shard -1 belong to every shard.

    An n-gram of two characters or one and a history of one or none are needed in
    every shard; there are at most as many as pairs of characters in a language.
    """
    shards = max(1, -(-model.count() // SHARD))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            langs, grams, kind = (batch.column(c).to_pylist() for c in ("lang", "gram", "kind"))
            seeds = {x: seed(x) for x in set(langs)}
            key, shard = np.zeros(batch.num_rows, np.uint64), np.full(batch.num_rows, -1, np.int64)
            size = np.array([len(g) for g in grams])
            for n in np.unique(size).tolist():
                for k in (0, 1):
                    pick = np.flatnonzero((size == n) & (np.array(kind) == k))
                    if not len(pick):
                        continue
                    c = np.frombuffer("".join(grams[i] for i in pick).encode("utf-32-le"), np.uint32).reshape(len(pick), n)
                    flat = c.ravel()
                    last = np.arange(len(pick)) * n + n - 1
                    key[pick] = Suffixes(flat, last, np.array([seeds[langs[i]] for i in pick], np.uint64), n).hashes(n)
                    if n - 1 + k >= 2:
                        shard[pick] = shard_of(c[:, n - 3 + k], c[:, n - 2 + k], shards)
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), batch.column("kind"), pa.array(key.view(np.int64)), batch.column("value").cast(pa.float32())], ["shard", "kind", "key", "value"])

    return scratch.write(model.mapInArrow(run, "shard int, kind int, key long, value float"), "shards"), shards


def _shards(spark: SparkSession, table: DataFrame, shards: int) -> Iterator:
    for i in range(shards):
        mine = table.where(F.col("shard").isin(-1, i))
        yield spark.sparkContext.broadcast(Shard(i, shards, (mine.where(F.col("kind") == k).select("key", "value").toArrow() for k in (0, 1))))
        pa.default_memory_pool().release_unused()


def same_in_text(g: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``repeats`` of the hashes g, each text by itself; texts rise."""
    order, start = repeats(mix(g + text.astype(np.uint64) * _M))
    new = np.zeros(len(g), bool)
    new[start] = True
    new[1:] |= text[order[1:]] != text[order[:-1]]  # of two texts with one hash the places follow each other
    return order, np.flatnonzero(new)


def base_counts(data: np.ndarray, bounds: np.ndarray, h: np.ndarray, s: np.ndarray, e: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    d = len(bounds) - 1
    lead = np.r_[0, np.cumsum(((data & 0xC0) != 0x80) & (_EXACT[data] != 0))] if len(data) else np.zeros(1, np.int64)
    symbols = np.r_[0, np.cumsum(_SYMBOLS[data])] if len(data) else np.zeros(1, np.int64)
    words = np.diff(first)
    repeat, lines = np.zeros(d, np.int64), np.zeros(d, np.int64)
    text = np.repeat(np.arange(d), words)
    at = np.flatnonzero(text[2:] == text[:-2])  # windows of one text
    if len(at):
        text = text[at]
        g = mix(mix(h[at] * np.uint64(3) + h[at + 1] * np.uint64(0x9E3779B97F4A7C15)) + h[at + 2])
        order, start = same_in_text(g, text)
        size = np.diff(np.r_[start, len(at)])
        twice = at[order[np.repeat(size > 1, size)]]
        m = np.zeros(len(h), bool)
        for j in range(3):
            m[twice + j] = True
        repeat = np.diff(np.r_[0, np.cumsum(m)][first])
    newline = np.flatnonzero(data == 10)
    cut = np.searchsorted(newline, bounds)
    for i in np.flatnonzero((np.diff(cut) > 0) & (words > 0)).tolist():
        seen: set[bytes] = set()
        for line in data[bounds[i] : bounds[i + 1]].tobytes().split(b"\n"):
            if line in seen:
                lines[i] += 1
            elif line.strip(b" \t\n\r\x0b\x0c"):
                seen.add(line)
    return {"n_words": words, "word_chars": lead[bounds[1:]] - lead[bounds[:-1]], "n_symbols": symbols[bounds[1:]] - symbols[bounds[:-1]], "n_dup_lines": lines, "n_repeat_words": repeat}


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _passes(scratch: Scratch, rows: DataFrame, shards: list, scan) -> DataFrame:
    """rows after a scan with each shard; after every second one they are written, so that a task holds two shards at most."""
    for i, shared in enumerate(shards):
        if i and i % 2 == 0:
            rows = scratch.write(rows, f"pass-{i}")
        rows = rows.mapInArrow(scan(shared), rows.schema)
    return rows


def distinct_texts(scratch: Scratch, docs: DataFrame) -> DataFrame:
    """docs with each text of a language once; c is the hash of both.

    Texts without a copy stay where they are; only those with copies are shuffled.
    """
    many = scratch.write(docs.groupBy("c").agg(F.count("*").alias("n")).where("n > 1").select("c"), "copies")
    return keep_ids(docs, many, "left_anti", "c").unionByName(keep_ids(docs, many, key="c").dropDuplicates(["c"]))


def _own(scratch: Scratch, docs: DataFrame, shards: list) -> DataFrame:
    """docs' columns without the text, the base counts, n_chars and total, the summed log-probabilities under the model that lang names."""

    def scan(shared):
        def run(batches):
            shard = shared.value
            for rows, data, bounds in slices(batches):
                c, begin = characters(data, bounds)
                at, text = positions(begin)
                mine = shard.mine(c, at)
                whose = text if len(mine) == len(at) else text[np.searchsorted(at, mine)]
                seeds = np.array([seed(x) for x in rows.column("lang").to_pylist()], np.uint64)
                out = dict(zip(rows.schema.names, rows.columns, strict=True))
                out["total"] = pa.array(out["total"].to_numpy() + np.bincount(whose, shard.score(c, mine, seeds[whose]), rows.num_rows))
                if shard.number == 0:
                    counts = base_counts(data, bounds, *hash_words(data, bounds, _EXACT)) | {"n_chars": np.diff(begin) - (ORDER - 1)}
                    out |= {x: pa.array(n, pa.int64()) for x, n in counts.items()}
                if shard.number == shard.shards - 1:
                    out["text"] = pa.nulls(rows.num_rows, pa.string())
                yield pa.RecordBatch.from_pydict(out)

        return run

    rows = docs.withColumn("total", F.lit(0.0)).withColumns({x: F.lit(None).cast("long") for x in (*_COUNTS, "n_chars")})
    return _passes(scratch, rows, shards, scan).drop("text")


def _best(cell: np.ndarray, share: float) -> float:
    """The negative sum of a text's windows, in rows with the own language first, with up to ``share`` of them under their best one."""
    gain = np.sort(cell.max(1) - cell[:, 0])[::-1][: int(share * len(cell))]
    return -float(cell[:, 0].sum() + gain.sum())


def _mixed(scratch: Scratch, docs: DataFrame, shards: list, langs: list[str], window: int, share: float) -> DataFrame:
    """(h, best): the mean of -log-probability with at most ``share`` of a text's windows, those that gain most, under the one of ``langs`` that suits them best, each by the half that a text's own model is of."""

    def scan(shared):
        def run(batches):
            shard, seeds = shared.value, np.array([[seed(f"{x}|{fold}") for fold in (0, 1)] for x in langs], np.uint64).reshape(-1, 2)
            for rows, data, bounds in slices(batches):
                c, begin = characters(data, bounds)
                at, text = positions(begin)
                own = np.array([seed(x) for x in rows.column("lang").to_pylist()], np.uint64)
                fold = np.array([int(x[-1]) for x in rows.column("lang").to_pylist()], np.int64)
                n = np.diff(begin) - (ORDER - 1)
                first = np.r_[0, np.cumsum(-(-n // window))]
                old = [np.frombuffer(x, np.float32) for x in rows.column("sums").to_pylist() if x]
                cell = np.concatenate(old).reshape(-1, len(langs) + 1).copy() if old else np.zeros((int(first[-1]), len(langs) + 1), np.float32)
                mine = shard.mine(c, at)
                whose = text if len(mine) == len(at) else text[np.searchsorted(at, mine)]
                where = first[whose] + (mine - begin[whose] - ORDER + 1) // window
                for j, values in enumerate(shard.scores(c, mine, (own[whose], *(x[fold[whose]] for x in seeds)))):
                    cell[:, j] += np.bincount(where, values, len(cell))
                parts = [cell[i:j] for i, j in zip(first[:-1], first[1:], strict=True)]
                if shard.number == shard.shards - 1:
                    parts = [np.array([_best(x.astype(np.float64), share) / m]) for x, m in zip(parts, n, strict=True)]
                yield rows.set_column(rows.schema.get_field_index("sums"), "sums", pa.array([x.tobytes() for x in parts], pa.binary()))

        return run

    def last(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"h": batch.column("h"), "best": pa.array([np.frombuffer(x, np.float64)[0] for x in batch.column("sums").to_pylist()], pa.float64())})

    rows = _passes(scratch, docs.select("h", "lang", "text", F.lit(None).cast("binary").alias("sums")), shards, scan)
    return rows.mapInArrow(last, "h long, best double").distinct()


def _bands(scored: DataFrame, floor: float) -> DataFrame:
    """(of, mid, spread): the median log_ppl of a language's different texts that pass the base rules, and 1.4826 times the median distance from it, at least ``floor``."""

    def median(rows: DataFrame, value: str) -> DataFrame:
        same = Window.partitionBy("of")
        rows = rows.withColumn("up", F.sum("n").over(same.orderBy(value))).withColumn("all", F.sum("n").over(same))
        return rows.where(2 * F.col("up") >= F.col("all")).groupBy("of").agg(F.min(value).alias("mid"))

    each = scored.where("not base_failed and log_ppl is not null").groupBy("of", "c").agg(F.min("log_ppl").alias("log_ppl"))
    rows = each.groupBy("of", F.round(F.col("log_ppl") * 1000).cast("long").alias("q")).agg(F.count("*").alias("n"))
    mid = median(rows, "q")
    apart = rows.join(mid, "of").groupBy("of", F.abs(F.col("q") - F.col("mid")).alias("a")).agg(F.sum("n").alias("n"))
    spread = median(apart, "a").select("of", F.greatest(F.lit(floor), 1.4826 * F.col("mid") / 1000).alias("spread"))
    return mid.join(spread, "of").select("of", (F.col("mid") / 1000).alias("mid"), "spread")


def quality_rules(docs: DataFrame, under: float = 5.0, over: float = 3.0, floor: float = 0.02, window: int = 64, share: float = 0.5, least: float = 0.001) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, log_ppl, best_ppl) for each row.

    docs: doc_id, text and lang; other columns are ignored.  base_failed: fewer
    than 50 words, or more than half of the words in repeated 3-word windows.
    log_ppl is the mean negative log-probability of a character under a model of
    the document's language that hasn't seen its text: the different texts of a
    language fall into two halves by a hash of the text, and each half is scored by
    the model of the other, so that neither a text nor its copies, of any number,
    speak for it.  Null languages share the models of ``und``.  Where the other half
    has no text log_ppl is null and the base rules decide.  The band of a language reaches from
    ``under`` robust deviations under its median to ``over`` above it (1.4826 times the
    median absolute deviation, at least ``floor``), from all different texts that pass
    the base rules; a text of n words gets sqrt(1 + 60 / n) of that width.  A text over
    its band may quote other languages: best_ppl then has the mean with up to
    ``share`` of its windows of ``window`` characters, those that gain most, under the
    model that suits them best of the languages with at least ``least`` of all
    characters, and is null for other texts.  kept: not base_failed, log_ppl not
    under the band, and log_ppl or best_ppl not over it.  Null and empty texts have
    no words, a null log_ppl and are not kept.  Repeated rows are judged alike and
    count once.  Very long texts are read whole.  An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    docs = only(docs, doc_id="long", text="string", lang="string")
    of, fold = F.coalesce("lang", F.lit(named(None))), F.crc32(F.coalesce("text", F.lit(""))) % 2
    docs = docs.select("doc_id", of.alias("of"), _model_of(of, 1 - fold).alias("lang"), F.xxhash64("doc_id", "text", "lang").alias("h"), F.xxhash64("text", of).alias("c"), "text")
    model = train(scratch, distinct_texts(scratch, docs).select("text", F.col("of").alias("lang"), (F.crc32(F.coalesce("text", F.lit(""))) % 2).alias("fold")))
    trained = scratch.write(model.select("lang").distinct(), "trained")
    table, count = sharded(scratch, model)
    for name in [x for x in scratch.paths if x not in ("shards", "trained", "copies")]:
        scratch.drop(name)
    free_shuffles(docs.sparkSession)
    shards = list(_shards(docs.sparkSession, table, count))
    scored = _own(scratch, docs, shards)
    scored = scored.join(trained.withColumn("seen", F.lit(True)), "lang", "left")
    scored = scored.withColumn("log_ppl", F.when(F.col("seen") & (F.col("n_chars") > 0), -F.col("total") / F.col("n_chars"))).drop("seen")
    scored = scratch.write(scored.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")), "scored")
    bands = scratch.write(_bands(scored, floor), "bands")
    wide = F.sqrt(1 + 60 / F.greatest(F.col("n_words"), F.lit(1))) * F.col("spread")
    judged = scored.join(bands, "of", "left").withColumns({"low": F.col("mid") - under * wide, "high": F.col("mid") + over * wide})
    above = scratch.write(judged.where("not base_failed and log_ppl > high").select("h").distinct(), "above")
    chars = scored.groupBy("of").agg(F.sum("n_chars").alias("n"))
    total = chars.agg(F.sum("n")).first()[0] or 0
    frequent = chars.where(F.col("n") >= least * total).select("of")  # at most 1 / least
    both = trained.select(F.expr("substring(lang, 1, length(lang) - 2)").alias("of")).groupBy("of").count().where("count = 2")
    langs = sorted(r[0] for r in frequent.join(both, "of").select("of").collect())
    free_shuffles(docs.sparkSession)
    best = scratch.write(_mixed(scratch, keep_ids(docs, above, key="h"), shards, langs, window, share), "best")
    for shared in shards:  # all that was made with them is written
        shared.destroy()
    shards.clear()
    free_shuffles(docs.sparkSession)
    judged = judged.join(best.withColumnRenamed("best", "best_ppl"), "h", "left")
    kept = ~F.col("base_failed") & F.coalesce((F.col("log_ppl") >= F.col("low")) & (F.coalesce("best_ppl", "log_ppl") <= F.col("high")), F.lit(True))
    return judged.select("doc_id", *_COUNTS, "base_failed", kept.alias("kept"), "log_ppl", "best_ppl")


def quality_stage(docs: DataFrame, **options) -> DataFrame:
    """docs without those that the rules reject; all columns stay.

    Of rows with one doc_id all go when one is rejected; rows without an id stay,
    as nothing can name them; null, empty and short texts are rejected.  Repeated
    rows are judged alike.  An empty table gives an empty one.
    """
    bad = quality_rules(docs, **options).where("not kept").select("doc_id").distinct()
    return keep_ids(docs, Scratch(docs.sparkSession, "quality-drop").write(bad, "ids"), "left_anti")
