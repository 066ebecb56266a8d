"""Operator 13: best-fit packing of documents into sequences by length patterns.

The lengths of all pieces make a histogram of at most as many numbers as a
sequence has tokens.  Patterns of one to three lengths that fill a sequence are
enumerated, their repeat counts fitted to the histogram by non-negative least
squares and rounded down, and what is left goes to the fullest sequence that
still has room, many equal pieces at a time.  All that is planned on the
histogram, and so costs the same for any number of documents; Spark then numbers
the pieces of each length, and a piece finds its place by length and number.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnledger.llm.common import Scratch, only
from turnledger.llm.words import SLICE_BYTES, slices

#: Tokens of a sequence, and the number that ends a document.
TOKENS, END = 4096, 1
#: Words whose identifiers a worker keeps; beyond it the cache begins anew.
CACHE = 400_000
#: Rows of a part in which pieces are numbered.
RANGE_ROWS = 500_000
#: Bytes by class: 0 white space, 1 letters, 2 digits, 3 other marks, 4 those that never stand at a cut (the apostrophe, all from U+0080).
_CLASS = np.full(256, 3, np.uint8)
_CLASS[[32, *range(9, 14)]] = 0
_CLASS[65:91] = _CLASS[97:123] = 1
_CLASS[48:58] = 2
_CLASS[39] = _CLASS[128:] = 4
#: Whether a text may be cut between bytes of two classes.
_CUT = np.array([not a or not b or (a < 4 and b < 4 and (a != b or a == 2)) for a in range(5) for b in range(5)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Encoder:
    """Identifiers of texts by a vocabulary whose pre-tokens are runs of letters, single digits and runs of other marks, in lower case.

    A text is cut where no pre-token can cross (at white space, and between ASCII
    letters, digits and marks), and each different part is encoded once.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.mapped = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat, self.ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _plain(self, word: bytes) -> str | None:
        """The word as the model takes it, if the normaliser leaves it alone and it is one pre-token: ASCII letters or digits, or letters in lower case and normal form."""
        text = word.decode("utf-8", "replace")
        if text.isascii():
            return text if text.isalnum() else None
        if text.isalpha() and text == text.lower() and unicodedata.is_normalized("NFC", text):
            return self.mapped(text)[0][0]
        return None

    def _learn(self, words: list[bytes]) -> None:
        """Encodes new parts, plain ones by the model alone."""
        tokenize, plain = self.model.tokenize, [self._plain(w) for w in words]
        other = iter(self.whole([w.decode("utf-8", "replace") for w, p in zip(words, plain, strict=True) if p is None]))
        listed = [next(other) if p is None else [t.id for t in tokenize(p)] for p in plain]
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words)), strict=True))
        self.flat = np.concatenate([self.flat, np.array([i for x in listed for i in x], np.uint32)])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.array([len(x) for x in listed], np.int64))])

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(identifiers of the texts, each followed by END, one after another; where each begins and the end)."""
        kind = _CLASS[data]
        cut = np.ones(len(data) + 1, bool)
        if len(data):
            cut[1:-1] = _CUT[kind[:-1] * np.uint8(5) + kind[1:]]
        cut[bounds] = True
        at = np.flatnonzero(cut)
        s, e = at[:-1], at[1:]
        live = kind[s] > 0 if len(s) else np.zeros(0, bool)
        s, e = s[live], e[live]
        size = np.r_[0, np.cumsum(e - s)].astype(np.int64)
        held = _LOWER[data[kind > 0]]
        parts = pa.Array.from_buffers(pa.large_binary(), len(s), [None, pa.py_buffer(size), pa.py_buffer(held)]).dictionary_encode()
        which, distinct = parts.indices.to_numpy(zero_copy_only=False), parts.dictionary.to_pylist()
        if len(self.known) > CACHE:
            self._forget()
        if new := [w for w in distinct if w not in self.known]:
            self._learn(new)
        number = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))[which]
        begin, many = self.ends[number], self.ends[number + 1] - self.ends[number]
        total = np.r_[0, np.cumsum(many)]
        out = self.flat[np.repeat(begin - total[:-1], many) + np.arange(total[-1])]
        ends = total[np.searchsorted(s, bounds)]
        ids = np.insert(out, ends[1:], np.uint32(END))
        starts = ends + np.arange(len(ends))
        held = data.tobytes()
        odd = [i for i in range(len(bounds) - 1) if any(x in held[bounds[i] : bounds[i + 1]] for x in self.special)] if any(x in held for x in self.special) else []
        if odd:  # texts that name a special token are encoded whole
            each = [ids[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]
            for i, x in zip(odd, self.whole([held[bounds[i] : bounds[i + 1]].decode("utf-8", "replace") for i in odd]), strict=True):
                each[i] = np.append(np.array(x, np.uint32), np.uint32(END))
            ids, starts = np.concatenate(each), np.r_[0, np.cumsum([len(x) for x in each])]
        return ids, starts


def token_pieces(docs: DataFrame, vocabulary: str, tokens: int = TOKENS) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): documents as identifiers and END, those over ``tokens`` cut.

    ``vocabulary`` is a file that driver and executors open.  Null and empty texts
    are END alone.
    """

    def run(batches):
        encoder = Encoder(vocabulary)
        for rows, data, bounds in slices(batches, size=4 * SLICE_BYTES):
            ids, starts = encoder.encode(data, bounds)
            n = np.diff(starts)
            count = -(-n // tokens)
            row = np.repeat(np.arange(len(n)), count)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            begin = piece * tokens
            length = np.minimum(tokens, n[row] - begin)
            held = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(held[4 * a : 4 * b]) for a, b in zip((starts[row] + begin).tolist(), (starts[row] + begin + length).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(begin, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return only(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def patterns(lengths: np.ndarray, tokens: int, thirds: int = 24) -> np.ndarray:
    """Rows of three lengths, 0 for none, that fill a sequence: one, two, or three of which one is among ``thirds`` spread over the smaller lengths."""
    there = np.zeros(tokens + 1, bool)
    there[lengths] = True
    out = [np.array([[tokens, 0, 0]])] if there[tokens] else []
    two = lengths[(2 * lengths >= tokens) & (lengths < tokens)]
    two = two[there[tokens - two]]
    out.append(np.stack([two, tokens - two, np.zeros_like(two)], 1))
    small = lengths[lengths <= tokens // 3]
    for c in np.unique(small[np.linspace(0, len(small) - 1, min(thirds, len(small))).astype(int)]) if len(small) else ():
        rest = tokens - c
        a = lengths[(2 * lengths >= rest) & (lengths < rest)]
        a = a[there[rest - a] & (rest - a >= c)]
        out.append(np.stack([a, rest - a, np.full_like(a, c)], 1))
    rows = np.concatenate(out) if out else np.zeros((0, 3), np.int64)
    return np.unique(rows, axis=0)[::-1]  # those of the longest pieces first


def fitted(rows: np.ndarray, histogram: np.ndarray, rounds: int = 20) -> np.ndarray:
    """Non-negative repeat counts of the patterns whose sums are nearest to the histogram in squares.

    Coordinate descent from zero: a pattern takes what the residual of its lengths
    leaves to it, and never goes below 0.
    """
    left, x = histogram.astype(np.float64), np.zeros(len(rows))
    left[0] = 0.0
    uses = []
    for row in rows.tolist():
        n: dict[int, int] = defaultdict(int)
        for k in row:
            if k:
                n[k] += 1
        uses.append((tuple(n.items()), sum(c * c for c in n.values())))
    values = left.tolist()
    for _ in range(rounds):
        moved = 0.0
        for i, (use, norm) in enumerate(uses):
            step = max(-x[i], sum(c * values[k] for k, c in use) / norm)
            if abs(step) > 1e-9:
                x[i] += step
                moved = max(moved, abs(step))
                for k, c in use:
                    values[k] -= c * step
        if moved < 0.25:
            break
    return x


def plan(histogram: np.ndarray, tokens: int = TOKENS) -> np.ndarray:
    """Places of all pieces of a histogram of lengths: rows of (length, first number, how many, first sequence, offset).

    The pieces of a length are numbered from 0; those of a row go to sequences that
    follow one another, each at the offset.  Sequences are numbered from 0.
    """
    left = histogram.astype(np.int64).copy()
    used, out, sequence = np.zeros(len(left), np.int64), [], 0
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free tokens -> (first sequence, how many)

    def place(length: int, n: int, first: int, offset: int) -> None:
        out.append((length, int(used[length]), n, first, offset))
        used[length] += n
        left[length] -= n

    rows = patterns(np.flatnonzero(left), tokens)
    for row, x in zip(rows.tolist(), fitted(rows, left).tolist(), strict=True):
        need: dict[int, int] = defaultdict(int)
        for k in row:
            if k:
                need[k] += 1
        n = min([int(x), *(int(left[k]) // c for k, c in need.items())])
        if n <= 0:
            continue
        offset = 0
        for k in row:
            if k:
                place(k, n, sequence, offset)
                offset += k
        sequence += n
    live = np.zeros(tokens + 1, bool)
    for length in range(tokens, 0, -1):
        n = int(left[length])
        while n:
            fit = np.flatnonzero(live[length:])
            if len(fit):
                r = length + int(fit[0])
                first, many = room[r].pop()
                if not room[r]:
                    live[r] = False
                take = min(n, many)
                place(length, take, first, tokens - r)
                if take < many:
                    room[r].append((first + take, many - take))
                    live[r] = True
                if r > length:
                    room[r - length].append((first, take))
                    live[r - length] = True
            else:
                each = tokens // length
                take = n // each
                if take:
                    for k in range(each):
                        place(length, take, sequence, k * length)
                    if rest := tokens - each * length:
                        room[rest].append((sequence, take))
                        live[rest] = True
                    sequence += take
                else:
                    for k in range(n):
                        place(length, 1, sequence, k * length)
                    rest = tokens - n * length
                    room[rest].append((sequence, 1))
                    live[rest] = True
                    sequence += 1
                    n = 0
                n -= take * each
                continue
            n -= take
    return np.array(out, np.int64).reshape(-1, 5)


def packed(docs: DataFrame, vocabulary: str, tokens: int = TOKENS) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): every piece of docs and its place.

    docs: doc_id and text; other columns are ignored.  A document is its
    identifiers and END; one longer than ``tokens`` is cut into pieces of so many, the
    last of which may be shorter.  No other is cut.  The pieces of a sequence follow
    one another from offset 0 without a gap.  Null and empty texts are END alone.
    Repeated rows, and rows without an id, are packed each for itself; an empty table
    gives no rows.  Very long texts are encoded whole, in one task.

    The histogram, at most ``tokens`` numbers, is all that reaches the driver, and its
    plan, a few rows for each length, all that is broadcast.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    pieces = scratch.write(token_pieces(docs, vocabulary, tokens), "pieces")
    histogram = np.zeros(tokens + 1, np.int64)
    for length, n in pieces.groupBy("length").count().collect():
        histogram[length] = n
    if not histogram.any():
        return pieces.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).limit(0)
    places = plan(histogram, tokens)
    places = places[np.lexsort((places[:, 1], places[:, 0]))]

    def number(batches):
        seen = np.zeros(tokens + 1, np.int64)
        part = TaskContext.get().partitionId()
        for batch in batches:
            length = batch.column("length").to_numpy()
            order = np.argsort(length, kind="stable")
            ranked = length[order]
            run = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]]) if len(ranked) else np.zeros(0, np.int64)
            count = np.diff(np.r_[run, len(ranked)])
            nth = np.empty(len(length), np.int64)
            nth[order] = np.arange(len(ranked)) - np.repeat(run, count) + seen[ranked]
            seen[ranked[run]] += count
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(length), part), pa.int32()), pa.array(nth)], [*batch.schema.names, "part", "nth"])

    kind = "doc_id long, piece int, start long, length long, ids_crc32 long"
    parts = max(1, int(histogram.sum()) // RANGE_ROWS)
    dealt = pieces.repartitionByRange(parts, "length", "ids_crc32", "doc_id", "piece") if parts > 1 else pieces
    numbered = scratch.write(dealt.mapInArrow(number, f"{kind}, part int, nth long"), "numbered")
    counts = numbered.groupBy("length", "part").agg(F.count("*").alias("n"))  # a range of lengths lies in one part, a frequent length in several
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shared = spark.sparkContext.broadcast(places)

    def locate(batches):
        table = shared.value
        key = table[:, 0] << np.int64(48) | table[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy()
            nth = batch.column("nth").to_numpy() + batch.column("before").to_numpy()
            row = table[np.searchsorted(key, length << np.int64(48) | nth, "right") - 1]
            columns = [batch.column(c.split()[0]) for c in kind.split(", ")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(row[:, 3] + nth - row[:, 1]), pa.array(row[:, 4])], [*(c.split()[0] for c in kind.split(", ")), "sequence_id", "offset"])

    found = numbered.join(counts.select("length", "part", before.alias("before")), ["length", "part"])
    return found.mapInArrow(locate, f"{kind}, sequence_id long, offset long")
