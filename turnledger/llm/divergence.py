"""Operator 11: source divergence audit by a heavy-light split of terms.

Each language keeps its frequent terms; a term's smoothed share in a source, and
in the language, is an integer, so that all sums are exact.  The distance of two
sources is the sum of absolute differences over all kept terms.  With p0 the
share of a term that a source lacks, it is

    V * |p0a - p0b|  +  the sum over terms of  |pa - pb| - |p0a - p0b|

where a term that neither has adds nothing.  Terms of many sources (heavy) are
put into dense tiles of sources by terms, of bounded size, and subtracted there
in numpy.  Of terms of few sources (light) each source's shares, as a histogram,
are set against every p0b, and for pairs of sources that share a light term its
postings, at most as many as ``light``, correct what the two histograms have
counted.  The partial sums are integers, and Spark adds them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnledger.llm.common import Scratch, only
from turnledger.llm.words import SLICE_BYTES, hash_words, mix, slices

_LETTERS = np.zeros(256, np.uint8)
_LETTERS[65:91] = np.arange(97, 123)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Sources of a tile's side, and terms of a tile, about: tiles are dealt by hashes.
SIDE, WIDE = 64, 512


def count_terms(docs: DataFrame, held: int = 400_000) -> DataFrame:
    """(lang, source, term, n, df): occurrences, and rows that hold the term; a task adds up its own, about ``held`` at a time.

    Terms are runs of A-Z, a-z and everything from U+0080, A-Z in lower case.
    """
    key = ["lang", "source", "term"]

    def summed(parts: list[pa.Table]) -> pa.Table:
        out = pa.concat_tables(parts).group_by(key).aggregate([("n", "sum"), ("df", "sum")])
        return out.select([*key, "n_sum", "df_sum"]).rename_columns([*key, "n", "df"])

    def run(batches):
        parts: list[pa.Table] = []
        size = 0
        for rows, data, bounds in slices(batches, size=4 * SLICE_BYTES):
            h, s, e, first = hash_words(data, bounds, _LETTERS)
            if not len(h):
                continue
            names: dict[tuple, int] = {}
            group = np.array([names.setdefault(g, len(names)) for g in zip(rows.column("lang").to_pylist(), rows.column("source").to_pylist(), strict=True)], np.uint64)
            row = np.repeat(np.arange(len(first) - 1), np.diff(first))
            own = mix(h + group[row] * _ODD)
            order = np.argsort(own, kind="stable")  # rows of an equal key stay in order
            k, r = own[order], row[order]
            start = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            fresh = np.r_[True, (k[1:] != k[:-1]) | (r[1:] != r[:-1])]
            w = order[start]
            ends = np.r_[0, np.cumsum(e[w] - s[w])]
            letters = _LETTERS[data[np.repeat(s[w] - ends[:-1], e[w] - s[w]) + np.arange(ends[-1])]]
            terms = pa.Array.from_buffers(pa.large_string(), len(w), [None, pa.py_buffer(ends), pa.py_buffer(letters)])
            at = pa.array(r[start])
            n = np.diff(np.r_[start, len(k)])
            parts.append(pa.table({"lang": rows.column("lang").take(at), "source": rows.column("source").take(at), "term": terms.cast(pa.string()), "n": n, "df": np.add.reduceat(fresh.astype(np.int64), start)}))
            size += len(start)
            if size > 2 * held:
                parts = [summed(parts)]
                size = parts[0].num_rows
                if size > held:
                    yield from parts[0].to_batches(max_chunksize=1 << 16)
                    parts, size = [], 0
        if parts:
            yield from summed(parts).to_batches(max_chunksize=1 << 16)

    found = docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n long, df long")
    return found.groupBy(*key).agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def _share(n: str, total: str, kept: str) -> Column:
    """1 + floor(10**9 * (n + 5) / (total + 5 * kept)), in decimals, so that no product overflows; null without terms."""
    return F.expr(f"1 + (cast(1000000000 as decimal(10,0)) * cast({n} + 5 as decimal(20,0))) div nullif(cast({total} + 5 * {kept} as decimal(20,0)), 0)")


def _pair_rows(lang: str, a: list[str], b: list[str], v: np.ndarray) -> pa.Table:
    low = [min(x, y) for x, y in zip(a, b, strict=True)]
    high = [max(x, y) for x, y in zip(a, b, strict=True)]
    return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "a": pa.array(low, pa.string()), "b": pa.array(high, pa.string()), "v": pa.array(v, pa.int64())})


def tile(table: pa.Table) -> pa.Table:
    """The partial sums of the pairs of sources of a tile: lang, a, b, v.

    table: source, side, term, p, n and p0, all of one language, two sides and a
    block; a row without a term stands for its source.  Block -1 holds the
    histograms of the light shares, n terms of share p, and adds the constant part.
    """
    lang, low, high, block, kept = (table.column(c)[0].as_py() for c in ("lang", "low", "high", "block", "kept"))
    whole = table.filter(pa.compute.is_null(table.column("term")))
    names, side = whole.column("source").to_pylist(), whole.column("side").to_numpy()
    p0 = whole.column("p0").fill_null(0).to_numpy()
    number = {x: i for i, x in enumerate(names)}
    rest = table.filter(pa.compute.is_valid(table.column("term")))
    row = np.array([number[x] for x in rest.column("source").to_pylist()], np.int64)
    p, n = rest.column("p").to_numpy(), rest.column("n").to_numpy()
    out: list[pa.Table] = []
    if block >= 0:
        term = rest.column("term").combine_chunks().dictionary_encode()
        dense = np.repeat(p0[:, None], len(term.dictionary), 1)
        dense[row, term.indices.to_numpy(zero_copy_only=False)] = p
    else:
        order = np.lexsort((p, row))
        row, p, n = row[order], p[order], n[order]
        at = np.searchsorted(row, np.arange(len(names) + 1))
        count, mass = np.r_[0, np.cumsum(n)], np.r_[0, np.cumsum(n * p)]

        def apart(i: int, to: np.ndarray) -> np.ndarray:
            """The sums of |p - to| - |p0 - to| over the light shares of a source."""
            x, y = at[i], at[i + 1]
            cut = x + np.searchsorted(p[x:y], to)
            under = to * (count[cut] - count[x]) - (mass[cut] - mass[x])
            return under + (mass[y] - mass[cut]) - to * (count[y] - count[cut]) - (count[y] - count[x]) * np.abs(p0[i] - to)

    for i in np.flatnonzero(side == low).tolist():
        js = np.flatnonzero(side == high)
        if low == high:
            js = js[js > i]
        if not len(js):
            continue
        level = np.abs(p0[i] - p0[js])
        if block >= 0:
            v = np.abs(dense[js] - dense[i]).sum(1) - dense.shape[1] * level
        else:
            v = kept * level + apart(i, p0[js]) + np.array([apart(j, p0[i : i + 1])[0] for j in js.tolist()], np.int64)
        out.append(_pair_rows(lang, [names[i]] * len(js), [names[j] for j in js.tolist()], v))
    return pa.concat_tables(out) if out else _pair_rows(lang, [], [], np.zeros(0, np.int64))


def light_corrections(postings: DataFrame) -> DataFrame:
    """(lang, a, b, v): for each pair of sources what their common light terms add to the two histograms' sums.

    postings: lang and held, the array of (source, p, p0) of a term, of bounded
    length.  A task adds up its own pairs.
    """

    def run(batches):
        for batch in batches:
            lang = batch.column("lang")
            held = batch.column("held")
            size = pa.compute.list_value_length(held).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = held.flatten()
            begin = np.cumsum(size) - size
            source, p, p0 = flat.field("source"), flat.field("p").to_numpy(), flat.field("p0").to_numpy()
            parts = []
            for i in range(int(size.max(initial=0))):
                for j in range(i + 1, int(size.max())):
                    t = np.flatnonzero(size > j)
                    x, y = begin[t] + i, begin[t] + j
                    v = np.abs(p[x] - p[y]) - np.abs(p[x] - p0[y]) - np.abs(p[y] - p0[x]) + np.abs(p0[x] - p0[y])
                    parts.append(pa.table({"lang": lang.take(pa.array(t)), "a": source.take(pa.array(x)), "b": source.take(pa.array(y)), "v": v}))
            if parts:
                both = pa.concat_tables(parts).group_by(["lang", "a", "b"]).aggregate([("v", "sum")])
                yield from both.rename_columns(["lang", "a", "b", "v"]).to_batches()

    return postings.select("lang", "held").mapInArrow(run, "lang string, a string, b string, v long")


def source_divergence(docs: DataFrame, least: int = 30, top: int = 50, light: int = 8) -> DataFrame:
    """(lang, source, part, item, value, rank) for each pair of sources of a language, and the ``top`` terms of each source.

    docs: text, lang and source; nulls are empty, other columns are ignored.  A
    language keeps the terms of at least ``least`` of its rows; repeated rows count
    each.  Part ``pair``: item is another source, value the sum over all kept terms of
    the absolute differences of their shares, 0 if there are none.  Part ``term``:
    item is a term that the source holds and whose share there is over the
    language's, value the difference.  Ranks are by falling value, ties by the bytes
    of the item.  Sources of empty, null or very long texts, or of none of the kept
    terms, have rows like any other; a language of one source has no pairs, an empty
    table no rows.  Terms of more than ``light`` sources are heavy.
    """
    scratch = Scratch(docs.sparkSession, "divergence")
    docs = only(docs, text="string", lang="string", source="string").fillna("", ["lang", "source"])
    counts = scratch.write(count_terms(docs), "counts")
    terms = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("df").alias("df"), F.count("*").alias("held")).where(F.col("df") >= least).drop("df")
    terms = scratch.write(terms, "terms")
    kept = scratch.write(counts.select("lang", "source", "term", "n").join(terms, ["lang", "term"]), "kept")
    scratch.drop("counts")
    languages = terms.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("lang_total"), F.count_if(F.col("held") > light).alias("heavy"))
    sources = docs.select("lang", "source").distinct().join(kept.groupBy("lang", "source").agg(F.sum("n").alias("size")), ["lang", "source"], "left")
    sources = sources.join(sources.groupBy("lang").agg(F.count("*").alias("n_sources")), "lang").join(languages, "lang", "left").fillna(0, ["size", "kept", "lang_total", "heavy"])
    sources = sources.withColumn("sides", F.ceil(F.col("n_sources") / SIDE).cast("int")).withColumn("side", F.pmod(F.xxhash64("source"), "sides").cast("int")).withColumn("blocks", F.ceil(F.col("heavy") / WIDE).cast("int"))
    sources = scratch.write(sources.withColumn("p0", _share("0", "size", "kept")).drop("n_sources", "heavy"), "sources")
    shares = kept.join(sources, ["lang", "source"]).withColumns({"p": _share("n", "size", "kept"), "q": _share("total", "lang_total", "kept")})
    shares = scratch.write(shares.select("lang", "source", "term", "n", "p", "q", "p0", F.col("held") > light, "side", "sides", "blocks", "kept").toDF("lang", "source", "term", "n", "p", "q", "p0", "heavy", "side", "sides", "blocks", "kept"), "shares")

    columns = ["lang", "source", "side", "sides", "block", "term", "p", "n", "p0", "kept"]
    none = F.lit(None)
    every = sources.select("lang", "source", "side", "sides", F.explode(F.concat(F.array(F.lit(-1)), F.when(F.col("blocks") > 0, F.sequence(F.lit(0), F.greatest(F.col("blocks"), F.lit(1)) - 1)).otherwise(F.array().cast("array<int>")))).alias("block"), none.cast("string").alias("term"), none.cast("long").alias("p"), none.cast("long").alias("n"), "p0", "kept")
    dense = shares.where("heavy").withColumn("block", F.pmod(F.xxhash64("term"), "blocks").cast("int")).select(*columns)
    histogram = shares.where("not heavy").groupBy("lang", "source", "side", "sides", "p0", "kept", "p").agg(F.count("*").alias("n")).withColumn("block", F.lit(-1)).withColumn("term", F.lit("")).select(*columns)
    dealt = every.unionByName(dense).unionByName(histogram).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))
    dealt = dealt.withColumns({"low": F.least("side", "other"), "high": F.greatest("side", "other")}).drop("other", "sides")
    tiles = dealt.groupBy("lang", "low", "high", "block").applyInArrow(tile, "lang string, a string, b string, v long")
    postings = shares.where("not heavy").groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "p0")).alias("held")).where(F.size("held") > 1)
    apart = light_corrections(postings)
    apart = apart.select("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "v")
    pairs = scratch.write(tiles.unionByName(apart).groupBy("lang", "a", "b").agg(F.sum("v").alias("value")), "pairs")
    both = pairs.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(pairs.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))

    order = [F.desc("value"), F.asc("item")]
    ranked = both.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order)))
    over = shares.where("n > 0 and p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"), F.pmod(F.xxhash64("term"), F.lit(32)).alias("salt"))
    first = over.withColumn("r", F.row_number().over(Window.partitionBy("lang", "source", "salt").orderBy(*order))).where(F.col("r") <= top).drop("r", "salt")
    best = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order))).where(F.col("rank") <= top)
    part = lambda df, name: df.select("lang", "source", F.lit(name).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
    return part(ranked, "pair").unionByName(part(best, "term"))
