"""Mixing sources to target weights by weighted fair queueing.

Every source has a target (words to take). Its documents stand in a shuffled
order (md5 of seed and id); a copy's virtual finish time is the source's
cumulative words up to and including it, divided by the target. All copies of
all sources are then range-sorted by finish time and taken while the running
total stays within the budget (the sum of the targets). At virtual time 1 every
source has given its target.

All cumulative sums are distributed (range partitions plus per-partition
offsets), so a source that holds a third of all rows is spread over many tasks.
The number of sources is not bounded either: their order, weights and the
water level of the targets come from the same distributed sums.

Defined results: NULL or empty text has size 0 and is taken 0 times its size;
NULL is a source of its own, last in order; identical ``(id, source, size)`` rows
are taken together; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripsense.llm.common import WORD, text_or_empty
from tripsense.operators.keyed import global_rank, prefix_sums
from tripsense.session import materialize

WEIGHTS = (3, 1, 2)   # repeating, by the source's rank
SHARE = 1.5           # budget as a multiple of all words
MAX_REPEAT = 2        # a source's target stops at this multiple of its size
SEED = 7


def source_targets(units: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE,
                   max_repeat: int = MAX_REPEAT) -> tuple[DataFrame, int]:
    """``(_key, source_size, target)`` per source and the total size.

    ``target = min(max_repeat * size, level * weight)``. Sorted by the weight-relative
    ceiling ``max_repeat * size / weight``, the level is the one at the first source
    that stays below its ceiling if all before it are at theirs.
    """
    sizes = materialize(units.groupBy("_key").agg(F.sum("_size_all").alias("source_size")))
    total = sizes.agg(F.sum("source_size")).first()[0] or 0
    ranked = global_rank(sizes, ["_key"])
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    src = (ranked.select("_key", "source_size", weight.cast("long").alias("w"))
           .withColumn("cap", F.col("source_size") * max_repeat)
           .withColumn("ceiling", F.col("cap") / F.col("w")))
    src = prefix_sums(src, None, ["ceiling", "_key"], ["cap", "w"])
    w_all = src.agg(F.sum("w")).first()[0] or 0
    src = src.withColumn("level", (F.lit(share * total) - (F.col("_cum_cap") - F.col("cap")))
                         / (F.lit(w_all) - (F.col("_cum_w") - F.col("w"))))
    level = src.filter("level <= ceiling").agg(F.min_by("level", F.struct("ceiling", "_key"))).first()[0]
    target = F.col("cap").cast("double")
    if level is not None:
        target = F.least(target, F.lit(level) * F.col("w"))
    return src.select("_key", "source_size", target.alias("target")), total


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: Sequence[int] = WEIGHTS, share: float = SHARE, max_repeat: int = MAX_REPEAT,
        seed: int = SEED) -> DataFrame:
    """One row per document: id, source, ``size``, ``source_size``, ``target``, ``copies`` (0 to
    ``max_repeat``) and ``taken`` words."""
    key = F.concat(F.when(F.col(source_col).isNull(), "1").otherwise("0"), F.coalesce(F.col(source_col), F.lit("")))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), key.alias("_key"),
                       F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long").alias("_size"))
    units = materialize(rows.groupBy("_id", "_source", "_key", "_size").agg(F.count(F.lit(1)).alias("_rows"))
                        .withColumn("_size_all", F.col("_size") * F.col("_rows"))
                        .withColumn("_order", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit(""))))))
    targets, total = source_targets(units, weights, share, max_repeat)
    targets = materialize(targets)
    queued = prefix_sums(units, "_key", ["_order", "_id", "_size"], ["_size_all"])
    copies = (queued.join(targets, "_key")
              .withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(max_repeat - 1))))
              .withColumn("_finish", F.when(F.col("target") > 0, (F.col("_copy") * F.col("source_size") + F.col("_cum__size_all"))
                                            / F.col("target")).otherwise(F.lit(0.0))))
    sent = prefix_sums(copies.drop("_cum__size_all"), None,
                       ["_finish", "_order", "_key", "_id", "_size", "_copy"], ["_size_all"])
    taken = (sent.groupBy("_id", "_source", "_size", "_rows", "source_size", "target")
             .agg(F.sum(F.when(F.col("_cum__size_all") <= F.lit(share * total), 1).otherwise(0)).alias("copies")))
    return (taken.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_rows").cast("int"))))
            .select(F.col("_id").alias(id_col), F.col("_source").alias(source_col), F.col("_size").alias("size"),
                    "source_size", "target", F.col("copies").cast("int").alias("copies"),
                    (F.col("copies") * F.col("_size")).alias("taken")))


def op3(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target",
                            F.col("taken").cast("long").alias("taken"))


SQL = rf"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    md5(concat('{SEED}:', doc_id)) AS o FROM documents),
s AS (SELECT source, sum(size) AS ss FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM s),
r AS (SELECT *, 2 * ss AS cap, CAST(2 * ss AS DOUBLE) / w AS ceiling, sum(ss) OVER () AS total, sum(w) OVER () AS wall FROM w),
c AS (SELECT *, sum(cap) OVER q - cap AS cap0, sum(w) OVER q - w AS w0 FROM r
  WINDOW q AS (ORDER BY ceiling, encode(source) NULLS LAST ROWS UNBOUNDED PRECEDING)),
l AS (SELECT *, (CAST(1.5 AS DOUBLE) * total - cap0) / (wall - w0) AS level FROM c),
b AS (SELECT arg_min(level, ceiling) AS level FROM l WHERE level <= ceiling),
t AS (SELECT source, ss, total, least(CAST(cap AS DOUBLE), coalesce(b.level * w, CAST(cap AS DOUBLE))) AS target FROM l, b),
q AS (SELECT d.doc_id, d.source, size, o, ss, total, target,
    sum(size) OVER (PARTITION BY d.source ORDER BY o, doc_id ROWS UNBOUNDED PRECEDING) AS cum
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN target > 0 THEN CAST(k * ss + cum AS DOUBLE) / target ELSE 0 END AS finish
  FROM q, (VALUES (0), (1)) v(k)),
f AS (SELECT *, sum(size) OVER (ORDER BY finish, o, encode(source) NULLS LAST, doc_id, k ROWS UNBOUNDED PRECEDING) AS run FROM e)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(ss AS BIGINT) AS source_size, target,
  CAST(sum(CASE WHEN run <= CAST(1.5 AS DOUBLE) * total THEN size ELSE 0 END) AS BIGINT) AS taken
FROM f GROUP BY doc_id, size, ss, target"""
