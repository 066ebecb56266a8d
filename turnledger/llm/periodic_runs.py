"""Operator 12: periodic runs of words, by power-of-two names and a grid of candidates.

The words of a slice of texts are numbered, and windows of 2**j words named from
pairs of names of half their length (Karp, Miller and Rosenberg), so two windows
are equal where their names are.  A run of period q holds, where it is four
periods long, a multiple of 2 * q from which a window of 2**j <= q words equals
the one q words on: these grid points are all the candidates.  Neighbouring grid
points of one run are chained, and only the first and the last of a chain are
extended, by names of falling length.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from turnledger.llm.common import only
from turnledger.llm.words import byte_table, slices

_SPACE = byte_table("space") == 0


def word_bounds(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte of each word, the byte after it, first word of each text and the total)."""
    inside = ~_SPACE[data] if len(data) else np.zeros(0, bool)
    cut = np.zeros(len(data) + 1, bool)
    cut[bounds] = True
    begins = inside & (~np.r_[False, inside[:-1]] | cut[:-1]) if len(data) else inside
    ends = inside & (~np.r_[inside[1:], False] | cut[1:]) if len(data) else inside
    s = np.flatnonzero(begins)
    return s, np.flatnonzero(ends) + 1, np.searchsorted(s, bounds)


def word_ids(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A number for each word, equal for equal words only."""
    if not len(s):
        return np.zeros(0, np.int64)
    size = np.r_[0, np.cumsum(e - s)]
    held = data[np.repeat(s - size[:-1], e - s) + np.arange(size[-1])]
    words = pa.Array.from_buffers(pa.large_binary(), len(s), [None, pa.py_buffer(size.astype(np.int64)), pa.py_buffer(held)])
    return words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


class Names:
    """Names of the windows of 2**j items of a sequence, as far as any name occurs twice."""

    def __init__(self, ids: np.ndarray, longest: int):
        """longest: windows up to the first power of two beyond it are named."""
        _, first = np.unique(ids, return_inverse=True)
        self.levels, self.n = [first.astype(np.int32)], len(ids)
        j = 0
        while (1 << j) <= longest and len(ids) > 2 << j:
            low = self.levels[-1]
            half = 1 << j
            pair = low[:-half].astype(np.int64) * (int(low.max()) + 1) + low[half:]
            known, name = np.unique(pair, return_inverse=True)
            self.levels.append(name.astype(np.int32))
            j += 1
            if len(known) == len(pair):  # no longer window occurs twice
                break

    def same(self, j: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the windows of 2**j items from a and b are equal; windows beyond an end aren't."""
        level = self.levels[j]
        fits = (a >= 0) & (b < len(level)) & (b >= 0)
        out = np.zeros(len(a), bool)
        out[fits] = level[a[fits]] == level[b[fits]]
        return out

    def after(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many items from a on equal those from b on, a < b."""
        out = np.zeros(len(a), np.int64)
        live = np.arange(len(a))
        for j in range(len(self.levels) - 1, -1, -1):
            again = live
            while len(again):
                hit = self.same(j, a[again] + out[again], b[again] + out[again])
                again = again[hit]
                out[again] += 1 << j
                if j < len(self.levels) - 1:
                    break
        return out

    def before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many items just before a equal those just before b."""
        out = np.zeros(len(a), np.int64)
        for j in range(len(self.levels) - 1, -1, -1):
            again = np.arange(len(a))
            while len(again):
                hit = self.same(j, a[again] - out[again] - (1 << j), b[again] - out[again] - (1 << j))
                again = again[hit]
                out[again] += 1 << j
                if j < len(self.levels) - 1:
                    break
        return out


def runs(ids: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of the runs of a sequence, by start, then period.

    ids: items, numbered; longest: an upper bound of the periods.  A run is a
    stretch of at least max(6, 4 * q) items of smallest period q which no
    neighbour extends.
    """
    found = [np.zeros((0, 3), np.int64)]
    names = Names(ids, longest)
    for j in range(len(names.levels)):
        low, high = 1 << j, min(2 << j, longest + 1)
        if low >= high:
            break
        q = np.arange(low, high, dtype=np.int64)
        n = np.maximum(0, -(-(len(ids) - q) // (2 * q)))  # multiples of 2 * q that have an item q further on
        period = np.repeat(q, n)
        at = (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)) * 2 * period
        pick = names.same(j, at, at + period)
        at, period = at[pick], period[pick]
        if not len(at):
            continue
        chained = np.r_[False, (period[1:] == period[:-1]) & (at[1:] == at[:-1] + 2 * period[1:])]
        for k in range(1, 4):  # 4 windows of 2**j reach beyond 2 * q
            prior = np.r_[at[:1], at[:-1]] + (k << j)
            chained &= names.same(j, prior, prior + period)
        first = np.flatnonzero(~chained)
        last = np.r_[first[1:], len(at)] - 1
        a, z, p = at[first], at[last], period[first]
        start = a - names.before(a, a + p)
        length = z + names.after(z, z + p) + p - start
        keep = length >= np.maximum(6, 4 * p)
        found.append(np.stack([start, length, p], 1)[keep])
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    if len(rows):  # a run's multiples of its period have the same stretch
        rows = rows[np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(1)]]
        rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    return rows[:, 0], rows[:, 1], rows[:, 2]


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """For a document whose id's crc32 is a multiple of 10, the original word at each place of the periodic text that is made of it; else None."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def periodic_runs(docs: DataFrame, plant: bool = False, texts: bool = True) -> DataFrame:
    """(doc_id, n_words, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256, collapsed) for each row.

    docs: doc_id and text; other columns are ignored.  Words are runs without
    U+0020 and U+0009 to U+000D, numbered from 0.  start, length, period and exponent_milli are of
    the longest run, of equal ones the first, then that of the smallest period; null
    without a run.  collapsed is the text without what follows the first period of
    a run, its words joined by a space; without ``texts`` its hash alone is returned.  With ``plant`` a tenth of the documents, by
    the hash of the id, become periodic first; rows without an id never do.  Null
    and empty texts have no words.  Repeated rows give a row each, an empty table
    none.  A text is handled whole, with some 4 bytes a word for each doubling of the
    longest period, up to the length at which nothing in the slice repeats.
    """
    schema = "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string" + ", collapsed string" * texts

    def run(batches):
        for rows, data, bounds in slices(batches):
            s, e, first = word_bounds(data, bounds)
            n = np.diff(first)
            source = np.arange(len(s))
            for i, d in enumerate(rows.column("doc_id").to_pylist() if plant else ()):
                at = planted(d, int(n[i]))
                if at is not None:
                    source[first[i] : first[i + 1]] = first[i] + at
            ids = word_ids(data, s, e)[source]
            text = np.repeat(np.arange(len(n)), n)
            ids = np.insert(ids, first[1:-1], -1 - np.arange(len(n) - 1)) if len(n) > 1 else ids  # an item of its own between two texts
            start, length, period = runs(ids, int(n.max(initial=0)) // 4)
            whose = np.searchsorted(first[1:] + np.arange(len(n)), start, "right")
            start = start - whose
            drop = np.zeros(len(s) + 1, np.int64)
            np.add.at(drop, start + period, 1)
            np.add.at(drop, start + length, -1)
            keep = np.flatnonzero(np.cumsum(drop[:-1]) == 0)
            size = e[source[keep]] - s[source[keep]] + 1
            ends = np.r_[0, np.cumsum(size)]
            out = np.append(data, np.uint8(32))[np.minimum(np.repeat(s[source[keep]] - ends[:-1], size) + np.arange(ends[-1]), len(data))]
            out[ends[1:] - 1] = 32
            held = out.tobytes()
            word = np.searchsorted(text[keep], np.arange(len(n) + 1))
            row = np.searchsorted(whose, np.arange(len(n) + 1))
            start = start - first[whose]
            answers: dict[str, list] = {c.split()[0]: [] for c in schema.split(", ")}
            for i, d in enumerate(rows.column("doc_id").to_pylist()):
                mine = slice(row[i], row[i + 1])
                listed = list(zip(start[mine].tolist(), length[mine].tolist(), period[mine].tolist(), strict=True))
                best = min(listed, key=lambda r: (-r[1], r[0], r[2]), default=None)
                collapsed = held[ends[word[i]] : max(ends[word[i]], ends[word[i + 1]] - 1)]
                digest = hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in listed).encode()).hexdigest()
                values = (d, int(n[i]), len(listed), *(best or (None,) * 3), best and 1000 * best[1] // best[2], digest, hashlib.sha256(collapsed).hexdigest(), *((collapsed.decode("utf-8", "replace"),) * texts))
                for c, v in zip(answers.values(), values, strict=True):
                    c.append(v)
            kinds = {"doc_id": pa.int64(), "runs_sha256": pa.string(), "collapsed_sha256": pa.string(), "collapsed": pa.string()}
            yield pa.RecordBatch.from_arrays([pa.array(v, kinds.get(c, pa.int64())) for c, v in answers.items()], list(answers))

    return only(docs, doc_id="long", text="string").mapInArrow(run, schema)
