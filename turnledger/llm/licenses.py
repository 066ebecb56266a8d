"""Operator 10: licence detection by ordered signature rules, in DataFrame functions only.

A gate of keywords lets through the few texts that can match.  Those are reduced
to their words, in lower case and one space apart, and each rule is tried where
its own keyword occurs.  Detections are word intervals; one that lies inside
an interval of a rule of equal or higher priority is suppressed.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnledger.llm.common import only
from turnledger.llm.licence_rules import SIGNATURES

#: The phrases of the base labels.
BASE = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))


def rules() -> list[tuple[str, list[str], str, int, float]]:
    """(label, keywords, pattern, priority, weight) of every rule; a rule is tried where all its keywords stand."""
    return [(label, [keyword], f"(?<![^ ])(?:{wording})(?![^ ])", priority, weight) for label, keyword, wording, priority, weight in SIGNATURES]


def gates() -> list[tuple[str, ...]]:
    """Sets of words of which every text that a rule matches holds one: ``licen`` where the rule always has it, else the words of its keyword."""
    found = set()
    for _, keyword, wording, *_ in SIGNATURES:
        bare, last = wording, ""
        while bare != last:
            bare, last = re.sub(r"\([^()]*\)\??", "", bare), bare
        if "licen" in bare:
            found.add(("licen",))
        elif not keyword.startswith("cc by"):
            found.add(tuple(sorted(set(keyword.split(" ")), key=lambda w: (-len(w), w))))
    return sorted(g for g in found if not any(o != g and all(any(v in w for w in g) for v in o) for o in found))  # what holds g holds o


def gate(low: Column) -> Column:
    """Whether a text, in lower case, may match a rule: it holds the words of a gate, or ``cc`` and ``by`` with only separators between."""
    out = F.contains(low, F.lit("cc")) & F.rlike(low, F.lit(r"cc[\x00-/:-`{-\x7f]+by"))
    for words in gates():
        out = out | reduce(and_, (F.contains(low, F.lit(w)) for w in words))
    return out


def normal(text: Column) -> Column:
    """The words of a text, lower-cased, one space apart; null is empty.

    Lower-casing other letters as well changes neither the number of words nor
    where a phrase of a to z can stand.
    """
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\x00-/:-`{-\x7f]+", " "))


def _once(value: Column) -> Column:
    """A column that is computed once a row: as a generator's output, the planner doesn't copy it into each use."""
    return F.explode(F.array(value))


def _spaces(part: Column) -> Column:
    return F.length(part) - F.length(F.replace(part, F.lit(" "), F.lit("")))


def _base(norm: Column, n_words: Column, phrase: str) -> tuple[Column, Column, Column]:
    """(places, first start, last start) of a phrase of plain words; the text is cut at its places."""
    parts = F.split(norm, f"(?<![^ ]){phrase}(?![^ ])")
    here = F.contains(norm, F.lit(phrase))
    n = F.when(here, F.size(parts) - 1).otherwise(0)
    first = F.when(n > 0, _spaces(F.get(parts, F.lit(0))))
    last = F.when(n > 0, n_words - _spaces(F.element_at(parts, -1)) - len(phrase.split(" ")))
    return n, first, last


def detections(docs: DataFrame) -> DataFrame:
    """(doc_id, text, label, start_word, end_word, priority, weight) that no other detection suppresses; text is a hash.

    docs: doc_id and norm, of the texts that pass the gate of keywords.  Matches of one rule are numbered by a window over that rule and
    text, so that their places are a running sum of the words before them.
    """
    listed = rules()
    # every pattern is a literal behind its keyword, so it is compiled once a task and tried on few texts
    keywords = sorted({k[0] for _, k, *_ in listed})
    has = F.array(*(F.contains("norm", F.lit(k)) for k in keywords))
    hits = [F.when(F.get("has", F.lit(keywords.index(k[0]))) & F.rlike("norm", F.lit(p)), F.lit(i)) for i, (_, k, p, _, _) in enumerate(listed)]
    chosen = F.array(*(F.struct(F.lit(a).alias("label"), F.lit(p).alias("pattern"), F.lit(n).alias("priority"), F.lit(w).alias("weight")) for a, _, p, n, w in listed))
    tried = docs.select("doc_id", "norm", _once(has).alias("has")).where(F.array_contains("has", True))
    tried = tried.select("doc_id", "norm", F.explode(F.array_compact(F.array(*hits))).alias("rule"))
    tried = tried.withColumn("r", F.get(chosen, F.col("rule"))).select("doc_id", "norm", "rule", "r.*")
    marked = F.regexp_replace("norm", F.col("pattern"), F.lit("\u0001$0\u0001"))
    parts = tried.select("doc_id", F.xxhash64("norm").alias("text"), "rule", "label", "priority", "weight", F.posexplode(F.split(marked, "\u0001")).alias("k", "part"))
    spaces = parts.groupBy("doc_id", "text", "rule", "label", "priority", "weight", "k").agg(F.first(_spaces(F.col("part"))).alias("n"))  # repeated rows count once
    each = Window.partitionBy("doc_id", "text", "rule").orderBy("k")
    found = spaces.withColumn("before", F.sum("n").over(each.rowsBetween(Window.unboundedPreceding, -1))).where("k % 2 = 1")
    found = found.select("doc_id", "text", "label", "priority", "weight", F.coalesce("before", F.lit(0)).alias("start_word"), (F.coalesce("before", F.lit(0)) + F.col("n") + 1).alias("end_word"))
    found = found.groupBy("doc_id", "text", "label", "priority", "start_word", "end_word").agg(F.max("weight").alias("weight"))
    # by rising start, falling end and priority, whatever holds an interval comes before it
    order = Window.partitionBy("doc_id", "text").orderBy("start_word", F.desc("end_word"), F.desc("priority"), "label").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.lit(False)
    for level in sorted({r[3] for r in listed}):
        reach = F.max(F.when(F.col("priority") >= level, F.col("end_word"))).over(order)
        inside = inside | ((F.col("priority") == level) & F.coalesce(reach >= F.col("end_word"), F.lit(False)))
    return found.withColumn("inside", inside).where("not inside").drop("inside")


def license_scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for each row.

    docs: doc_id and text; other columns are ignored.  n_base counts every place
    where a base phrase stands, first_word and last_word are the least and
    greatest of their starts, null without one.  labels adds the labels of the
    detections to the base ones.  score is the largest weight of a detection, 1
    with a base label, else 0.  Null and empty texts have no words and no labels.
    Repeated rows, and rows without an id, each have the detections of their own
    text.  Very long texts are searched whole.  An empty table gives no rows.
    """
    norm = only(docs, doc_id="long", text="string").select("doc_id", _once(normal(F.col("text"))).alias("norm"))
    low = only(docs, doc_id="long", text="string").select("doc_id", "text", _once(F.lower(F.coalesce("text", F.lit("")))).alias("low"))
    passed = low.where(gate(F.col("low"))).select("doc_id", _once(normal(F.col("text"))).alias("norm"))
    found = detections(passed).groupBy(F.col("doc_id").alias("id"), F.col("text").alias("hash")).agg(F.collect_set("label").alias("found"), F.max("weight").alias("weight"))
    words = F.when(F.col("norm") == "", 0).otherwise(_spaces(F.col("norm")) + 1)
    places = [_base(F.col("norm"), words, p) for _, p in BASE]
    base = F.array_compact(F.array(*(F.when(n > 0, F.lit(label)) for (label, _), (n, _, _) in zip(BASE, places, strict=True))))
    total = sum((n for n, _, _ in places[1:]), places[0][0])
    rows = norm.select(
        "doc_id", F.xxhash64("norm").alias("text"), words.cast("long").alias("n_words"), total.cast("long").alias("n_base"), F.least(*(a for _, a, _ in places)).cast("long").alias("first_word"),
        F.greatest(*(z for _, _, z in places)).cast("long").alias("last_word"), F.array_sort(F.array_distinct(base)).alias("base"),
    )
    out = rows.join(found, (F.col("text") == F.col("hash")) & F.col("doc_id").eqNullSafe(F.col("id")), "left")
    every = F.array_sort(F.array_union("base", F.coalesce("found", F.array().cast("array<string>"))))
    score = F.greatest(F.when(F.size("base") > 0, 1.0).otherwise(0.0), F.coalesce("weight", F.lit(0.0)))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), score.cast("double").alias("score"))
