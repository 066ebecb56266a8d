"""Action spans and thinking chunks from the pieces of sampled tokens, by built-in functions.

The pieces of a response are joined by a mark that no text holds, so a tag may
cross any number of tokens, and the number of marks before a place is its token.
All work is linear in the text and in the number of tags.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnledger.schema import MAX_CHUNKS

#: Joins pieces; a noncharacter of Unicode, so that no text holds it.
MARK = "￿"
#: Tags of the method, fixed values.
THINK, ACTIONS = "think", ("search", "answer")
_NAME = "|".join(f"{MARK}?".join(n) for n in (THINK, *ACTIONS))
#: A tag, its characters dealt out over tokens in any way.
TAG = f"<{MARK}?(?:/{MARK}?)?(?:{_NAME}){MARK}?>"
#: White space around an action's text.
_GAP = rf"[\s{MARK}]*"
#: What a chunk may end with: marks of punctuation, and line ends.
STOPS = ".!?;:,…。！？；，\n"


def marks(text: Column) -> Column:
    """How many tokens a joined text crosses into."""
    return F.length(text) - F.length(F.replace(text, F.lit(MARK), F.lit("")))


def _between(first: Column, last: Column) -> Column:
    return F.when(first <= last, F.sequence(first, F.greatest(first, last))).otherwise(F.array().cast("array<int>"))


def action_spans(pieces: Column) -> Column:
    """struct(action_type, action_text, invalid_action, empty_action, unclosed_action, think, search, answer, tags) of a response.

    pieces: the texts of its tokens, in order; null and empty responses have no
    action.  think, search, answer and tags are positions of tokens, from 0.

    An action is what stands between <search> and </search>, or <answer> and
    </answer>, outside of thinking.  The first one counts: its type, its text without
    the white space around, and the tokens that hold a character of that text.  A
    token that also holds a part of a tag is among tags as well.  Thinking is what
    stands between <think> and </think>, in one or more blocks, or to the end if
    unclosed; its tokens hold no part of a tag, and other tags in it are text.  A
    second action, a tag inside an action, and an end without its beginning make the
    action invalid.  An action without text is empty, one that isn't closed reaches
    to the end.  Without an action the type is ``other``.
    """
    joined = F.array_join(pieces, MARK)
    texts = F.split(joined, TAG, -1)
    tags = F.regexp_extract_all(joined, F.lit(TAG), F.lit(0))
    none, empty = F.lit(-1), F.array().cast("array<int>")
    start = F.struct(
        F.lit("out").alias("mode"), marks(F.get(texts, F.lit(0))).alias("at"), none.alias("from"), F.lit("other").alias("kind"), F.lit(None).cast("string").alias("text"), none.alias("first"),
        F.lit(False).alias("invalid"), F.lit(False).alias("closed"), empty.alias("think"), empty.alias("tags"),
    )

    def step(s: Column, x: Column) -> Column:
        """x: a tag and the text after it; s.at is the token in which the tag begins, s.from that in which the last one ended."""
        name = F.regexp_replace(x["tag"], f"[<>/{MARK}]", "")
        ends = F.replace(x["tag"], F.lit(MARK), F.lit("")).startswith("</")
        last = s["at"] + marks(x["tag"])
        out, thinking = s["mode"] == "out", s["mode"] == THINK
        acting = ~out & ~thinking
        begins = out & ~ends & (name != THINK) & (s["kind"] == "other")
        closes = acting & ends & (name == s["mode"])
        closes_think = thinking & ends & (name == THINK)
        wrong = (out & ends) | (out & ~ends & (name != THINK) & (s["kind"] != "other")) | (acting & ~closes)
        mode = F.when(out & ~ends & (name == THINK), THINK).when(begins, name).when(closes | closes_think, "out").otherwise(s["mode"])
        own = begins | closes
        return F.struct(
            mode.alias("mode"), (last + marks(x["after"])).alias("at"), F.when(mode != s["mode"], last).otherwise(s["from"]).alias("from"), F.when(begins, name).otherwise(s["kind"]).alias("kind"),
            F.when(begins, x["after"]).when(acting & ~closes, F.concat(s["text"], x["tag"], x["after"])).otherwise(s["text"]).alias("text"), F.when(begins, last).otherwise(s["first"]).alias("first"),
            (s["invalid"] | wrong).alias("invalid"), (s["closed"] | closes).alias("closed"), F.when(closes_think, F.concat(s["think"], _between(s["from"] + 1, s["at"] - 1))).otherwise(s["think"]).alias("think"),
            F.when(own, F.concat(s["tags"], F.sequence(s["at"], last))).otherwise(s["tags"]).alias("tags"),
        )

    steps = F.transform(tags, lambda t, i: F.struct(t.alias("tag"), F.get(texts, i + 1).alias("after")))

    def finish(s: Column) -> Column:
        size = F.greatest(F.size(pieces), F.lit(0))
        think = F.when(s["mode"] == THINK, F.concat(s["think"], _between(s["from"] + 1, size - 1))).otherwise(s["think"])
        lead = marks(F.regexp_extract(s["text"], f"^{_GAP}", 0))
        core = F.regexp_replace(s["text"], f"^{_GAP}|{_GAP}$", "")
        first = s["first"] + lead
        target = F.when(F.length(core) > 0, F.sequence(first, first + marks(core))).otherwise(empty)
        acts = s["kind"] != "other"
        of = lambda k: F.when(s["kind"] == k, target).otherwise(empty)
        return F.struct(
            s["kind"].alias("action_type"), F.when(acts, F.replace(core, F.lit(MARK), F.lit(""))).alias("action_text"), s["invalid"].alias("invalid_action"), (acts & (F.length(core) == 0)).alias("empty_action"),
            (acts & ~s["closed"]).alias("unclosed_action"), think.alias("think"), of("search").alias("search"), of("answer").alias("answer"), F.array_sort(F.array_distinct(s["tags"])).alias("tags"),
        )

    return F.aggregate(F.coalesce(steps, F.array()), start, step, finish)


def _merged(sizes: Column, most: int) -> Column:
    """sizes with the smallest neighbouring pair, the first of equal ones, added up until ``most`` are left."""

    def merge(s: Column, _: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.size(s) - 1), lambda i: F.get(s, i - 1) + F.get(s, i))
        at = F.array_position(pairs, F.array_min(pairs)).cast("int")
        return F.concat(F.slice(s, F.lit(1), at - 1), F.array(F.array_min(pairs)), F.slice(s, at + 2, F.size(s)))

    turns = F.when(F.size(sizes) > most, F.sequence(F.lit(1), F.greatest(F.size(sizes) - most, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(turns, sizes, merge)


def think_chunks(pieces: Column, think: Column, least: int = 8, aim: int = 64, most: int = MAX_CHUNKS) -> Column:
    """array<array<int>>: the thinking's positions in chunks, all of them, in order.

    A chunk of at least ``least`` tokens ends with a token that ends with a stop or a
    line end; one of ``aim`` tokens ends anyway.  A shorter rest joins the chunk before
    it.  Neighbouring chunks, the shortest pair first, are put together until there
    are at most ``most``, so the aim gives way.  No thinking has no chunks.
    """
    none = F.array().cast("array<int>")
    stops = F.transform(think, lambda p: F.regexp_replace(F.get(pieces, p), " +$", "").rlike(f"[{STOPS}]$"))

    def step(s: Column, stop: Column) -> Column:
        n = s["n"] + 1
        cut = (stop & (n >= least)) | (n >= aim)
        return F.struct(F.when(cut, F.concat(s["sizes"], F.array(n))).otherwise(s["sizes"]).alias("sizes"), F.when(cut, F.lit(0)).otherwise(n).alias("n"))

    def finish(s: Column) -> Column:
        whole, rest = s["sizes"], s["n"]
        joined = F.concat(F.slice(whole, F.lit(1), F.size(whole) - 1), F.array(F.element_at(whole, -1) + rest))
        return F.when(rest == 0, whole).when((rest >= least) | (F.size(whole) == 0), F.concat(whole, F.array(rest))).otherwise(joined)

    sizes = F.aggregate(stops, F.struct(none.alias("sizes"), F.lit(0).alias("n")), step, finish)
    spans = F.aggregate(_merged(sizes, most), F.struct(F.array().cast("array<struct<at:int,n:int>>").alias("spans"), F.lit(1).alias("at")), lambda s, n: F.struct(F.concat(s["spans"], F.array(F.struct(s["at"].alias("at"), n.alias("n")))).alias("spans"), (s["at"] + n).alias("at")), lambda s: s["spans"])
    return F.transform(spans, lambda x: F.slice(think, x["at"], x["n"]))


def mask_of(found: Column, size: Column) -> Column:
    """A mask of 0 and 1 with the positions set; empty for no tokens."""
    marked = F.transform(F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0))), lambda i: F.array_contains(found, i).cast("int"))
    return F.when(size > 0, marked).otherwise(F.array().cast("array<int>"))
