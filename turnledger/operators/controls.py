"""Other-question controls for search turns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnledger.functions import scalars
from turnledger.operators.stages import written
from turnledger.schema import CONTROL_COUNT, CONTROL_STREAM, REVISION


def tier() -> Column:
    """0 same source, bucket and length; 1 same source and length; 2 length; 3 any other."""
    near = scalars.near_length(F.col("a_length"), F.col("token_length"))
    source, bucket = F.col("a_source") == F.col("data_source"), F.col("a_bucket") == F.col("call_bucket")
    return F.when(source & bucket & near, 0).when(source & near, 1).when(near, 2).otherwise(3)


def fingerprint() -> Column:
    """What makes two observations one: the signature, or the text where there is none."""
    return F.when(F.size("document_signature") > 0, F.sha2(F.to_json("document_signature"), 256)).otherwise(F.sha2(F.concat(F.lit("serialized|"), "serialized_observation"), 256))


def candidate_pairs(anchors: DataFrame, pool: DataFrame) -> DataFrame:
    """(anchor_id, observation_id, fingerprint, tier) for all admissible pairs of a step.

    A candidate has the anchor's step and document count, which are the keys of
    the join, and another question, text and signature.  Pools are a step's, so
    the pairs grow with the square of a step, not of the data.
    """
    a = anchors.select(
        "global_step", "document_count", F.col("observation_id").alias("anchor_id"), F.col("question_id").alias("a_question"), F.col("data_source").alias("a_source"), F.col("call_bucket").alias("a_bucket"),
        F.xxhash64("serialized_observation").alias("a_h"), F.col("serialized_observation").alias("a_text"), F.col("token_length").alias("a_length"), F.col("document_signature").alias("a_signature"),
    )
    b = pool.where(F.col("valid") & (F.trim("serialized_observation") != ""))
    different = (F.col("a_question") != F.col("question_id")) & (F.col("a_text") != F.col("serialized_observation"))
    signed = (F.size("a_signature") > 0) & (F.size("document_signature") > 0) & (F.col("a_signature") == F.col("document_signature"))
    return a.join(b, ["global_step", "document_count"]).where(different & ~F.coalesce(signed, F.lit(False))).select("global_step", "anchor_id", "observation_id", fingerprint().alias("fingerprint"), tier().alias("tier"))


def best_by_fingerprint(pairs: DataFrame) -> DataFrame:
    """One candidate for each anchor and fingerprint: the lowest tier, then id."""
    best = pairs.groupBy("global_step", "anchor_id", "fingerprint").agg(F.min(F.struct("tier", "observation_id")).alias("b"))
    return best.select("global_step", "anchor_id", "fingerprint", "b.tier", "b.observation_id")


def hashed_controls(best: DataFrame, count: int = CONTROL_COUNT) -> DataFrame:
    """(anchor_id, control_index, observation_id, tier, used_replacement): lowest tiers first, a hash within a tier.

    Fewer candidates than ``count`` are taken again in turn.  A hash is not the
    reference draw: it is stable, but selects other rows of a tier; see
    drawn_controls for that.
    """
    order = Window.partitionBy("anchor_id").orderBy("tier", scalars.hash_order(REVISION, "control", F.col("anchor_id"), F.col("observation_id")), "observation_id")
    ranked = best.withColumn("k", F.row_number().over(order) - 1).where(F.col("k") < count)
    n = F.count("*").over(Window.partitionBy("anchor_id"))
    again = ranked.withColumn("n", n).withColumn("control_index", F.explode(F.sequence(F.col("k"), F.lit(count - 1), F.col("n"))))
    return again.select("anchor_id", F.col("control_index").cast("int").alias("control_index"), "observation_id", "tier", (F.col("n") < count).alias("used_replacement"))


def drawn_controls(best: DataFrame, count: int = CONTROL_COUNT) -> DataFrame:
    """As hashed_controls, by the published draw: a PCG64 stream seeded from SHA-256 of the anchor.

    Each tier, in order of ids, is permuted by the stream; what lacks is drawn
    with replacement from what was selected.  An anchor's candidates, at most its
    step's pool, are one group.
    """
    import hashlib

    import numpy as np

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        step, anchor = int(pdf["global_step"].iloc[0]), pdf["anchor_id"].iloc[0]
        seed = hashlib.sha256(f"{CONTROL_STREAM}|{REVISION}|{step}|{anchor}".encode()).digest()[:16]
        rng, chosen = np.random.default_rng(int.from_bytes(seed, "big")), []
        for t, rows in pdf.sort_values(["tier", "observation_id"]).groupby("tier"):
            ids = rows["observation_id"].tolist()
            chosen += [(ids[i], int(t)) for i in rng.permutation(len(ids))]
        chosen = chosen[:count]
        short, n = len(chosen) < count, len(chosen)
        chosen += [chosen[int(rng.integers(0, n))] for _ in range(count - n)]
        return pd.DataFrame({"anchor_id": anchor, "control_index": range(count), "observation_id": [c[0] for c in chosen], "tier": [c[1] for c in chosen], "used_replacement": short})

    return best.groupBy("global_step", "anchor_id").applyInPandas(draw, "anchor_id string, control_index int, observation_id string, tier int, used_replacement boolean")


#: Points of the circle on which the index orders fingerprints, and parts of it that are ranked apart.
CIRCLE, ARCS = 1 << 60, 1024
#: Lengths of one band differ by less than this factor.
BAND = 1.25
#: Keys of a tier's index, from the closest: what a candidate shares with an anchor besides step and document count.
TIERS = (("data_source", "call_bucket", "band"), ("data_source", "band"), ("band",), ())


def point(*parts: Column | str) -> Column:
    """A place on the circle: the first 60 bits of the SHA-256 of the parts."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 15), 16, 10).cast("long")


def _band(length: Column) -> Column:
    return F.when(length > 0, F.floor(F.log(F.greatest(length, F.lit(1e-9))) / F.log(F.lit(BAND))).cast("int"))


def control_index(pool: DataFrame) -> DataFrame:
    """The candidates of a pool by fingerprint, text and length, each with the ids that any anchor can take.

    Equal observations of any number are one row: its smallest id, and the smallest
    of another question, for anchors of the first one's question.
    """
    rows = pool.where(F.col("valid") & (F.trim("serialized_observation") != "")).select("global_step", "document_count", "data_source", "call_bucket", "token_length", "question_id", "observation_id", fingerprint().alias("fingerprint"), F.unhex(F.sha2("serialized_observation", 256)).alias("text"))
    key = ["global_step", "document_count", "data_source", "call_bucket", "token_length", "fingerprint", "text"]
    asked = rows.groupBy(*key, "question_id").agg(F.min("observation_id").alias("id"))
    first = asked.groupBy(*key).agg(F.min(F.struct("id", "question_id")).alias("first"))
    second = asked.join(first, key).where("question_id <> first.question_id").groupBy(*key).agg(F.min("id").alias("second"))
    return first.join(second, key, "left").withColumn("point", point("fingerprint")).withColumn("band", _band(F.col("token_length")))


def _placed(index: DataFrame, wanted: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(index with its position on the circle of its key, wanted with how many come before its point and how many there are).

    Arcs of the circle are ranked apart and their counts added up, so no key meets in one task.
    Both are ranked in one shuffle and written once.
    """
    both = index.select(*key, "point", F.lit(1).alias("is_index"), F.struct("*").alias("row"), F.lit(None).cast(wanted.select(F.struct("*").alias("x")).schema["x"].dataType).alias("ask"))
    both = both.unionByName(wanted.select(*key, "point", F.lit(0).alias("is_index"), F.lit(None).cast(both.schema["row"].dataType).alias("row"), F.struct("*").alias("ask"))).withColumn("arc", F.floor(F.col("point") / (CIRCLE // ARCS)))
    arcs = both.groupBy(*key, "arc").agg(F.sum("is_index").alias("n"))
    before = Window.partitionBy(*key)
    arcs = arcs.withColumn("base", F.sum("n").over(before.orderBy("arc")) - F.col("n")).withColumn("total", F.sum("n").over(before)).drop("n")
    order = Window.partitionBy(*key, "arc").orderBy("point", "is_index", "row.fingerprint", "row.token_length", "row.text", "row.data_source", "row.call_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = both.withColumn("rank", F.sum("is_index").over(order) - F.col("is_index")).join(arcs, [*key, "arc"])
    placed = written(placed.select("is_index", "row", "ask", (F.col("base") + F.col("rank")).alias("place"), "total").where("is_index = 1 or total > 0"))
    return placed.where("is_index = 1").select("row.*", "place"), placed.where("is_index = 0").select("ask.*", "place", "total")


def next_controls(anchors: DataFrame, pool: DataFrame, count: int = CONTROL_COUNT, window: int = 8) -> DataFrame:
    """(anchor_id, control_index, observation_id, tier, used_replacement) for every anchor that has a control, from an index of the pool.

    Fingerprints lie on a circle by their hash.  In each tier, from 0, an anchor
    takes the fingerprints that come next after its own point until it has ``count``, of
    each the observation of the smallest id in that tier; what lacks is taken again
    in turn.  A tier's index has what a candidate shares with an anchor as its key,
    lengths in bands, and places by number.  An anchor reads the next ``window``
    places of its bands, those that are not done eight times as many, so what it reads
    is bounded by what it takes and rejects, not by its step.
    """
    at = ["global_step", "document_count"]
    index = written(control_index(pool))
    asks = anchors.select(
        *at, F.col("observation_id").alias("anchor_id"), F.col("question_id").alias("a_question"), "data_source", "call_bucket", F.col("token_length").alias("a_length"), fingerprint().alias("a_fingerprint"), F.unhex(F.sha2("serialized_observation", 256)).alias("a_text"),
        point(F.lit(REVISION), F.lit("anchor"), F.col("observation_id")).alias("point"), F.array().cast("array<string>").alias("taken"),
    ).withColumnsRenamed({"data_source": "a_source", "call_bucket": "a_bucket"})
    asks, chosen = written(asks), None
    for number, own in enumerate(TIERS):
        keys = {"data_source": F.col("a_source"), "call_bucket": F.col("a_bucket")}
        rows = asks.select("*", *(keys[k].alias(k) for k in own if k != "band"))
        if "band" in own:
            edge = lambda share, slack: F.floor(F.log(F.greatest(F.col("a_length") * share, F.lit(1e-9))) / F.log(F.lit(BAND)) + slack).cast("int")
            rows = rows.where("a_length > 0").withColumn("band", F.explode(F.sequence(edge(0.75, -1e-9), edge(1.25, 1e-9))))
        placed, open_ = _placed(index, rows, [*at, *own])
        size = window
        while True:
            steps = F.least(F.col("total"), F.lit(size)).cast("int")
            read = open_.select("*", F.explode(F.sequence(F.lit(0), steps - 1)).alias("j")).withColumn("place", F.pmod(F.col("place") + F.col("j"), F.col("total")))
            found = read.withColumnRenamed("point", "a_point").join(placed.drop("a_text").withColumnsRenamed({c: f"c_{c}" for c in ("data_source", "call_bucket", "band") if c not in own}), [*at, *own, "place"])
            away = F.pmod(F.col("point") - F.col("a_point"), F.lit(CIRCLE))
            id_ = F.when(F.col("first.question_id") != F.col("a_question"), F.col("first.id")).otherwise(F.col("second"))
            good = id_.isNotNull() & (F.col("fingerprint") != F.col("a_fingerprint")) & (F.col("text") != F.col("a_text")) & ~F.array_contains("taken", F.col("fingerprint"))
            if "band" in own:
                good &= scalars.near_length(F.col("a_length"), F.col("token_length"))
            found = found.select("anchor_id", "taken", "total", "j", *own, away.alias("away"), "fingerprint", F.when(good, id_).alias("id"))
            # a part of the circle is known as far as its last place, or wholly
            last = found.groupBy("anchor_id", "taken", *own).agg(F.max("away").alias("away"), F.max("total").alias("total"), F.count("*").alias("n")).groupBy("anchor_id", "taken").agg(F.min(F.when(F.col("n") < F.col("total"), F.col("away")).otherwise(CIRCLE)).alias("known"))
            prints = found.where("id is not null").groupBy("anchor_id", "fingerprint").agg(F.min("away").alias("away"), F.min("id").alias("id"))
            sure = prints.join(last, "anchor_id").where("away < known")
            first = sure.withColumn("k", F.row_number().over(Window.partitionBy("anchor_id").orderBy("away", "fingerprint"))).where(F.col("k") + F.size("taken") <= count)
            got = written(last.join(first.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("k", "fingerprint", "id"))).alias("got")), "anchor_id", "left").withColumn("done", (F.col("known") == CIRCLE) | (F.size(F.coalesce("got", F.array())) + F.size("taken") >= count)))
            done = got.where("done and got is not null").select("anchor_id", F.posexplode("got").alias("i", "g"), F.size("taken").alias("before")).select("anchor_id", (F.col("before") + F.col("i")).alias("k"), F.col("g.id").alias("observation_id"), F.col("g.fingerprint").alias("fingerprint"), F.lit(number).alias("tier"))
            chosen = done if chosen is None else chosen.unionByName(done)
            left = got.where("not done").select("anchor_id")
            if left.isEmpty():
                break
            open_, size = written(open_.join(left, "anchor_id", "left_semi")), size * 8
        chosen = written(chosen)
        held = chosen.groupBy("anchor_id").agg(F.collect_list("fingerprint").alias("held"))  # at most count
        asks = asks.join(held, "anchor_id", "left").withColumn("taken", F.coalesce("held", F.array().cast("array<string>"))).drop("held").where(F.size("taken") < count)
        asks = written(asks)
        if asks.isEmpty():
            break
    n = chosen.groupBy("anchor_id").agg(F.count("*").cast("int").alias("n"))
    again = chosen.join(n, "anchor_id").withColumn("control_index", F.explode(F.sequence(F.col("k"), F.lit(count - 1), F.col("n"))))
    return again.select("anchor_id", F.col("control_index").cast("int").alias("control_index"), "observation_id", "tier", (F.col("n") < count).alias("used_replacement"))


def control_failures(anchors: DataFrame, controls: DataFrame) -> DataFrame:
    """(turn_id, control_failure) of anchors without any control."""
    lost = anchors.select(F.col("observation_id").alias("turn_id")).join(controls.select(F.col("anchor_id").alias("turn_id")).distinct(), "turn_id", "left_anti")
    return lost.withColumn("control_failure", F.lit("no_other_question_control"))
