"""Mixing sources to target weights (operator 4).

A document's size is its number of words. Sources in the order of their names (by code point, null last) weigh weights[0], weights[1],
..., over and over, and share the sum of all sizes; a target stops at `epochs` times its source's size, and what is over is shared
again by weight among the others. In closed form, with r = epochs * size / weight ascending, the sources that stop are the first ones
for which r is below what is left to share, divided by the weight that is left.

Within a source, documents come in the order of a random key (from md5 of the doc_id). A source takes its documents in that order until
its budget (its target, rounded down) is used up, over and over if the budget is larger than the source: each document once for every
whole epoch, and in the last one those whose running sum of sizes stays below the rest, the one at the border in part.

Edge cases: a null text has size 0; a null source is a source, the last one; rows with the same doc_id come in the order of their
size, so equal rows may trade places, with the same result; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD_RE, checkpoint, numbered, portions, running_sums


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), epochs: int = 3) -> DataFrame:
    """(source, source_size, target) from (source, source_size), a row for each source; one task orders these few short rows."""
    by_name = W.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    s = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("ratio", epochs * F.col("source_size") / F.col("weight"))
    order = W.orderBy("ratio", F.col("source").isNull(), F.encode("source", "UTF-8"))
    before, all_rows = order.rowsBetween(W.unboundedPreceding, -1), W.partitionBy(F.lit(1))
    left = F.sum("source_size").over(all_rows) - epochs * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    weight = F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    s = s.withColumn("share", left / weight)
    # the share of the first source that does not stop holds for all behind it
    s = s.withColumn("place", F.row_number().over(order))
    s = s.withColumn("level", F.min(F.when(F.col("ratio") >= F.col("share"), F.struct("place", "share"))).over(all_rows)["share"])
    target = F.when(F.col("ratio") < F.coalesce("level", F.lit(float("inf"))), (epochs * F.col("source_size")).cast("double")).otherwise(F.col("level") * F.col("weight"))
    return s.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), epochs: int = 3, row: str | None = None) -> DataFrame:
    """([row,] doc_id, source, size, source_size, target, taken) of every row of docs (doc_id, text, source); row: a column to keep."""
    keep = [row] if row else []
    key = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 1, 15), 16, 10).cast("long")
    sized = docs.select(*keep, "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD_RE)), F.lit(0)).cast("long").alias("size"), key.alias("key"))
    sized = checkpoint(sized)
    t = checkpoint(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, epochs))
    placed = running_sums(sized, [F.col("source"), F.col("key"), F.col("doc_id"), F.col("size")], "size", "before", "source")
    placed = placed.join(t.withColumnRenamed("source", "named"), F.col("source").eqNullSafe(F.col("named")))
    budget = F.floor("target")
    rest = budget - F.when(F.col("source_size") > 0, F.expr("floor(target) div nullif(source_size, 0)")).otherwise(0) * F.col("source_size")
    whole = F.when(F.col("source_size") > 0, F.expr("floor(target) div nullif(source_size, 0)")).otherwise(0)
    taken = whole * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before")))
    return placed.select(*keep, "doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))



def mixed(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), epochs: int = 3, broadcast_up_to: int = 1_000_000) -> DataFrame:
    """What the mix takes, with the columns of docs: a row for each whole copy of a document, and one with the first words of a text that is
    taken in part; n_chars, if there is such a column, follows the text. docs must give the same rows each time it is read, as files do.

    The chosen rows are broadcast only if there are no more than broadcast_up_to (32 MB), and joined by shuffle beyond that.
    """
    rows = numbered(docs)
    chosen = checkpoint(mix(rows, weights, epochs, "__row").where("taken > 0").select("__row", F.col("size").alias("__size"), F.col("taken").alias("__taken")))
    if chosen.count() <= broadcast_up_to:
        chosen = F.broadcast(chosen)
    names = docs.columns
    at, chars = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def copies(batches):
        for b in portions(batches, at, 2 << 20):  # a text may come three times over
            rows, texts = [], []
            for i, (text, size, taken) in enumerate(zip(*(b.column(c).to_pylist() for c in (at, len(names), len(names) + 1)))):
                rows += [i] * (taken // size)
                texts += [text] * (taken // size)
                if taken % size:
                    ends = [m.end() for _, m in zip(range(taken % size), re.finditer(WORD_RE, text))]
                    rows.append(i)
                    texts.append(text[: ends[-1]])
            cols = [pa.array(texts, pa.string()) if i == at else b.column(i).take(pa.array(rows, pa.int64())) for i in range(len(names))]
            if chars is not None:
                cols[chars] = pa.array([len(t) for t in texts]).cast(cols[chars].type)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return rows.join(chosen, "__row").select(*names, "__size", "__taken").mapInArrow(copies, docs.schema)


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS key
  FROM documents
), named AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, [1, 2, 3][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM named
), shared AS (
  SELECT *, 3 * source_size / weight::DOUBLE AS ratio, row_number() OVER (ORDER BY 3 * source_size / weight::DOUBLE, source NULLS LAST) AS place,
         ((sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (ORDER BY 3 * source_size / weight::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY 3 * source_size / weight::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE) AS share
  FROM weighed
), levels AS (
  SELECT *, (SELECT arg_min(share, place) FROM shared WHERE ratio >= share) AS level FROM shared
), aimed AS (
  SELECT source, source_size, CASE WHEN level IS NULL OR ratio < level THEN (3 * source_size)::DOUBLE ELSE level * weight END AS target FROM levels
), placed AS (
  SELECT s.*, a.source_size, a.target, coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized s JOIN aimed a ON s.source IS NOT DISTINCT FROM a.source
)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0 ELSE (floor(target)::BIGINT // source_size) * size
         + greatest(0, least(size, floor(target)::BIGINT % source_size - before)) END::BIGINT AS taken
FROM placed
"""
