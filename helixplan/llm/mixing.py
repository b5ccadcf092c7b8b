"""Mixing sources to target weights by capped water-filling.

A budget of words (``share`` of all words) is dealt to the sources by weight. Sources whose share would
exceed ``max_epochs`` passes over them are clamped there and the excess goes to the others by weight, round
after round, until none is above. A source then takes whole passes over all its documents and a fraction
of one more pass: its documents in the order of a seeded hash, up to the point nearest to what is left.

The hash order is kept in ``2**bucket_bits`` ranges; sizes add up per (source, range), and only the one
range in which a source's fraction ends is sorted, so a source with a third of all rows is never in one
task, neither in the sums nor in the join that hands the decision back. The driver sees four numbers a round, and each
round's sources are a table.

Edge cases: a null text has size 0; a null source is a source of its own and the last; a source without
words has target 0 and takes nothing; repeated rows are documents of their own, and which of several with
the same id and size takes the last place doesn't show; an empty table gives no rows; a text of any length is
counted where it lies; other columns are left alone, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from helixplan.plans.runtime import Scratch

#: Sources, one row each, that may be broadcast.
BROADCAST_SOURCES = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def water_fill(sources: DataFrame, budget: float, max_epochs: float, scratch: Scratch) -> DataFrame:
    """Adds ``target`` to ``(source, weight, source_size)``; weights are positive."""
    cap = F.col("source_size") * F.lit(float(max_epochs))
    state = scratch.keep(sources.withColumn("__full", F.lit(False)))
    while True:
        free = state.agg(F.sum(F.when(~F.col("__full"), F.col("weight"))).alias("w"), F.sum(F.when(F.col("__full"), cap)).alias("c"), F.count_if("__full").alias("full")).first()
        rest, weights = budget - (free["c"] or 0.0), free["w"]
        if not weights:
            return state.withColumn("target", cap).drop("__full")
        share = F.lit(rest) * F.col("weight") / F.lit(float(weights))
        grown = scratch.keep(state.withColumn("__full", F.col("__full") | (share > cap)))
        if grown.where("__full").count() == free["full"]:
            return state.withColumn("target", F.when(F.col("__full"), cap).otherwise(share)).drop("__full")
        scratch.drop(state)
        state = grown


def _order(id_col: str, seed: str) -> Column:
    """Place of a document in its source, as hex digits."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)


def _placed(docs: DataFrame, weights: Column, id_col: str, text_col: str, source_col: str, share: float, max_epochs: float, seed: str, bucket_bits: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Rows without their texts, and for each (source, range) in use what is decided; ``__side`` 0 marks the range in which a source's fraction ends."""
    rows = scratch.keep(
        docs.select(F.col(id_col).alias("__id"), F.col(source_col).alias("__s"), word_count(F.col(text_col)).alias("size"), _order(id_col, seed).alias("__at")).withColumn(
            "__b", F.shiftright(F.conv(F.substring("__at", 1, 6), 16, 10).cast("int"), 24 - bucket_bits)
        )
    )
    cells = scratch.keep(rows.groupBy("__s", "__b").agg(F.sum("size").alias("__cell")))
    sums = cells.groupBy("__s").agg(F.sum("__cell").alias("source_size"))
    # One row per source, not per document.
    placed = sums.withColumn("place", F.row_number().over(Window.orderBy(F.col("__s").cast("binary").asc_nulls_last())) - 1)
    total = cells.agg(F.sum("__cell")).first()[0] or 0
    sources = placed.withColumn("weight", weights.cast("double")).select(F.col("__s"), "source_size", "weight")
    filled = water_fill(sources, share * total, max_epochs, scratch)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = filled.withColumn("__whole", whole).withColumn("__rest", F.col("target") - F.col("__whole") * F.col("source_size")).drop("weight")
    upto = F.sum("__cell").over(Window.partitionBy("__s").orderBy("__b"))
    cut = cells.withColumn("__upto", upto).withColumnRenamed("__s", "__c").join(plan, F.col("__c").eqNullSafe(F.col("__s"))).drop("__c")
    cut = cut.withColumn("__before", F.col("__upto") - F.col("__cell")).select(
        F.col("__s").alias("__c"), F.col("__b").alias("__k"), "source_size", "target", "__whole", "__rest", "__before", F.when(F.col("__rest") <= 0, -1).when(F.col("__upto") <= F.col("__rest"), 1).when(F.col("__before") >= F.col("__rest"), -1).otherwise(0).alias("__side")
    )
    return rows, scratch.keep(cut)


def _edge(rows: DataFrame, cut: DataFrame) -> DataFrame:
    """Rows of the ranges in which fractions end, with ``__more``: 1 up to the point nearest to what is left."""
    run = F.sum("size").over(Window.partitionBy("__s", "__b").orderBy("__at", "__id", "size").rowsBetween(Window.unboundedPreceding, 0))
    met = rows.join(cut.where("__side = 0"), F.col("__s").eqNullSafe(F.col("__c")) & (F.col("__b") == F.col("__k")))
    return met.withColumn("__more", (2 * (F.col("__before") + run) - F.col("size") <= 2 * F.col("__rest")).cast("long"))


def mix(docs: DataFrame, weights: Column, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, max_epochs: float = 2.0, seed: str = "mix-1", bucket_bits: int = 12) -> DataFrame:
    """One row per document: its ``size``, its source's ``source_size`` and ``target``, and ``taken``.

    ``weights`` is a positive Column over ``place``, the source's place (from 0) in the order of the sources'
    UTF-8 bytes, null last.
    """
    rows, cut = _placed(docs, weights, id_col, text_col, source_col, share, max_epochs, seed, bucket_bits, Scratch(docs.sparkSession, "mixing"))
    sure = rows.join(cut.where("__side <> 0"), F.col("__s").eqNullSafe(F.col("__c")) & (F.col("__b") == F.col("__k"))).withColumn("__more", (F.col("__side") > 0).cast("long"))
    out = sure.unionByName(_edge(rows, cut))
    return out.select(F.col("__id").alias(id_col), "size", "source_size", "target", (F.col("size") * (F.col("__whole") + F.col("__more"))).alias("taken"))


def mixed_documents(
    docs: DataFrame, weights: Column, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, max_epochs: float = 2.0, seed: str = "mix-1", bucket_bits: int = 12
) -> DataFrame:
    """The mix itself: each document as often as it is taken.

    A source's decision is one place in its hash order, so the texts stay where they are if the sources, one
    row each, are at most ``BROADCAST_SOURCES`` (counted); more take one shuffled join. Rows alike in id at a
    source's last place are taken together.
    """
    scratch = Scratch(docs.sparkSession, "mixed")
    rows, cut = _placed(docs, weights, id_col, text_col, source_col, share, max_epochs, seed, bucket_bits, scratch)
    last = _edge(rows, cut).where("__more = 1").groupBy("__s").agg(F.max("__at").alias("__end")).select(F.col("__s").alias("__e"), "__end")
    # Where no document of the range is taken, the range before it is the last.
    full = cut.where("__side > 0").groupBy("__c").agg(F.max("__k").alias("__full"))
    first = cut.groupBy("__c").agg(F.first("__whole").alias("__whole"))
    named = first.join(full.withColumnRenamed("__c", "__f"), F.col("__c").eqNullSafe(F.col("__f")), "left").join(last, F.col("__c").eqNullSafe(F.col("__e")), "left")
    decided = scratch.keep(named.select("__c", "__whole", F.coalesce("__full", F.lit(-1)).alias("__full"), F.coalesce("__end", F.lit("")).alias("__end")))
    few = decided.count() <= BROADCAST_SOURCES
    # The table's own columns are held in one, so that none of their names can clash with ours.
    held = docs.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("row"), F.col(source_col).alias("__s"), _order(id_col, seed).alias("__at"))
    at = held.withColumn("__b", F.shiftright(F.conv(F.substring("__at", 1, 6), 16, 10).cast("int"), 24 - bucket_bits))
    met = at.join(F.broadcast(decided) if few else decided, F.col("__s").eqNullSafe(F.col("__c")))
    copies = F.col("__whole") + F.when((F.col("__b") <= F.col("__full")) | (F.col("__at") <= F.col("__end")), 1).otherwise(0)
    return met.withColumn("__n", F.explode(F.array_repeat(F.lit(0), copies.cast("int")))).select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])


def cycle_weights(values: tuple[float, ...] = (3.0, 1.0, 2.0)) -> Column:
    """Weights that repeat in the order of the sources."""
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (F.col("place") % len(values) + 1).cast("int"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), cycle_weights())


OP6_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, sha256('mix-1:' || coalesce(doc_id::VARCHAR, '')) AS at FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
p AS (SELECT source, source_size, [3, 1, 2][(row_number() OVER (ORDER BY encode(source) ASC NULLS LAST) - 1) % 3 + 1] AS weight FROM s),
o AS (SELECT *, sum(2 * source_size) OVER w AS caps, sum(weight) OVER w AS ws, row_number() OVER w AS place,
        2 * source_size / weight AS ratio
      FROM p WINDOW w AS (ORDER BY 2 * source_size / weight, encode(source) NULLS LAST ROWS UNBOUNDED PRECEDING)),
t AS (SELECT 1.5::DOUBLE * sum(source_size)::DOUBLE AS budget, sum(weight) AS weights FROM p),
levels AS (SELECT 0 AS place, 0::DOUBLE AS caps, 0 AS ws UNION ALL SELECT place, caps::DOUBLE, ws FROM o),
chosen AS (SELECT l.place, l.caps, t.weights - l.ws AS free, t.budget - l.caps AS rest
           FROM levels l, t LEFT JOIN o n ON n.place = l.place + 1
           WHERE n.place IS NULL OR (t.budget - l.caps) * n.weight / (t.weights - l.ws) <= 2.0 * n.source_size
           ORDER BY l.place LIMIT 1),
f AS (SELECT o.source, o.source_size, CASE WHEN o.place <= c.place THEN o.source_size * 2.0::DOUBLE ELSE c.rest * o.weight::DOUBLE / c.free::DOUBLE END AS target FROM o, chosen c),
g AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM f),
r AS (SELECT d.doc_id, d.size, g.source_size, g.target, g.whole, g.target - g.whole * g.source_size AS rest,
        sum(d.size) OVER (PARTITION BY d.source ORDER BY d.at, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS upto
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN rest > 0 AND 2 * upto - size <= 2 * rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM r
"""
