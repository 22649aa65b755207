"""Mixing sources to target weights by capped water-filling, by DataFrame operations only.

A document's size is its number of words. The sources, in the order of their code points with null last, weigh 1, 2, 3,
repeating, and share the words of all documents by weight. A target stops at ``epochs`` times its source's size; what it
leaves goes to the open sources by weight, until no target is above its cap. A source then takes its target in whole
repetitions of all its documents and one fractional repetition: in an order seeded by the document's id, documents are
taken whole until the rest is used up, and the one at the edge gives its leading words. So a source takes its rounded
target exactly, and no document more than ``epochs`` times its size.

The places in a source are sums before a row in two levels (:func:`~quillframe.operators.planning.sums_before`), so one
source may hold most rows. The driver sees one total and one weight for each round of the water-filling, which is
repeated until no further source is clamped.

Null and empty texts, and texts of blanks, have no words and take none. Null is a source of its own. Repeated rows count
each; rows of one id (null too) follow each other in the order, smaller ones first, and equal rows are interchangeable.
A table without words has targets of 0, an empty table gives an empty table. A kept column named like a result is
replaced by it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.llm.storage import dealt_anew, lookup, written
from quillframe.operators.planning import numbered, sums_before

WORD = r"[^\x20\x09-\x0D]+"
EPOCHS = 3
WEIGHTS = (1, 2, 3)
RESULTS = ("size", "source_size", "target", "taken")


def _wide(column):
    """A whole number wide enough for products of sizes and weights."""
    return F.col(column).cast("decimal(20,0)")


def targets(sources: DataFrame, epochs: int = EPOCHS, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """sources (source, source_size; one row each) with ``target`` (double)."""
    ranked = numbered(sources.withColumn("_last", F.col("source").isNull()), "_nth", "_last", "source")
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), ((F.col("_nth") - 1) % len(weights) + 1).cast("int"))
    weighed = written(ranked.select("source", "source_size", weight.cast("long").alias("weight"), (F.col("source_size") * epochs).alias("cap")), "sources")
    whole = weighed.agg(F.sum(_wide("source_size")).alias("words"), F.sum(_wide("weight")).alias("weight")).first()
    left, open_weight = int(whole.words or 0), int(whole.weight or 0)
    while True:  # clamp what is above its cap, give the rest to the others
        share = _wide("weight") * F.lit(left).cast("decimal(20,0)")
        above = share.cast("decimal(38,0)") > (_wide("cap") * F.lit(open_weight).cast("decimal(17,0)")).cast("decimal(38,0)")
        clamped = weighed.where(above).agg(F.sum(_wide("cap")).alias("cap"), F.sum(_wide("weight")).alias("weight")).first()
        now = int(whole.words or 0) - int(clamped.cap or 0), int(whole.weight or 0) - int(clamped.weight or 0)
        if now == (left, open_weight):
            break
        left, open_weight = now
    open_share = (F.col("weight") * F.lit(left)).cast("double") / F.lit(float(max(open_weight, 1)))
    return weighed.select("source", "source_size", F.when(above, F.col("cap").cast("double")).otherwise(open_share).alias("target"))


def mix(docs: DataFrame, *, text: str = "text", source: str = "source", key: str = "doc_id", keep: tuple[str, ...] = ("doc_id",), epochs: int = EPOCHS, weights: tuple[int, ...] = WEIGHTS, seed: str = "mix") -> DataFrame:
    """The columns ``keep`` of docs with size, source_size, target (double, of the source) and taken (words, repeats
    counted). Keep the text for :func:`repetitions`; what is kept is written twice."""
    rows = F.struct(*(F.col(f"`{c}`").alias(c) for c in keep)).alias("_row")
    place = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    sized = written(docs.select(F.col(source).alias("source"), size.alias("size"), place.alias("_place"), rows), "sized")
    plan = written(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), epochs, weights), "targets")
    quota = F.round("target").cast("long")
    turns = F.when(F.col("source_size") > 0, F.floor(quota / F.col("source_size")).cast("long")).otherwise(0)
    planned = plan.select(F.col("source").alias("_source"), "source_size", "target", quota.alias("_quota"), turns.alias("_turns"))
    placed = sums_before(sized, ["source"], ["_place", "size"], _before=F.col("size"))
    joined = dealt_anew(placed, "_place").join(lookup(planned), F.col("source").eqNullSafe(F.col("_source")))
    rest = F.col("_quota") - F.col("_turns") * F.col("source_size") - F.col("_before")
    taken = F.col("_turns") * F.col("size") + F.greatest(F.least(rest, F.col("size")), F.lit(0))
    kept = (F.col(f"_row.`{c}`").alias(c) for c in keep if c not in RESULTS)
    return joined.select(*kept, "size", "source_size", "target", taken.cast("long").alias("taken"))


def repetitions(mixed: DataFrame, text: str = "text") -> DataFrame:
    """The mix itself: each row of :func:`mix` as often as it is taken, numbered by ``repetition`` from 0; the last one,
    if it is fractional, has the leading words of the text."""
    times = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    each = mixed.withColumn("repetition", F.explode(F.when(times > 0, F.sequence(F.lit(0), times - 1))))
    rest = (F.col("taken") - F.col("repetition") * F.col("size")).cast("int")
    leading = F.array_join(F.slice(F.regexp_extract_all(F.col(text), F.lit(WORD), 0), F.lit(1), F.greatest(rest, F.lit(1))), " ")
    return each.withColumn(text, F.when(rest < F.col("size"), leading).otherwise(F.col(text)))
