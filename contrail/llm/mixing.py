"""Op 9: mixing sources to target weights by hash-threshold histograms. DataFrame functions only.

Sources in code point order (null last) weigh 1, 2, 3, 1, 2, 3, ... and share the whole corpus' words. A target
stops at `max_repeat` times its source's size and the excess is reshared by weight. A document is taken whole,
floor(target / source size) times, and once more if its hash lies below its source's threshold. Thresholds come
from nested histograms: words are summed by source and hash bucket, the bucket in which the budget ends is refined
by further bits, and the documents are filtered, never sorted.

Reruns agree: the hash's first CONTENT_BITS depend on doc_id and text alone. Rows that agree in both (or whose hashes
meet) are told apart by a hash of their place in the table, so that a group of equal rows needn't be taken as one. A
null or empty text has size 0 and takes part with no words; a source without words has target 0; a very long text is
taken whole like any other; no rows yield no rows. Other columns of docs are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, stage

#: Bits of the hash by which each level of the histograms splits a bucket, and how many of all bits hash the content.
LEVEL_BITS, LEVELS, CONTENT_BITS = 10, 6, 40
HASH_BITS = LEVEL_BITS * LEVELS


def source_key():
    """A key per source that is never null."""
    return F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))


def size_in_words():
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def mixing_hash():
    """A row's place in its source's order, of HASH_BITS bits."""
    content = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    high = F.conv(F.substring(F.md5(content.cast("binary")), 1, CONTENT_BITS // 4), 16, 10).cast("long")
    low_bits = HASH_BITS - CONTENT_BITS
    low = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << low_bits))
    return F.shiftleft(high, low_bits).bitwiseOR(low)


def with_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, skey (its key), size in words and h, the mixing hash, as a written table."""
    return stage(docs.select("doc_id", "source", source_key().alias("skey"), size_in_words().alias("size"), mixing_hash().alias("h")), "mix-sizes")


def targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = 3) -> DataFrame:
    """A row per source: skey, source_size, target.

    Sources are capped in order of cap over weight: after the first k are capped, the rest share what is left.
    The windows without partition run over one row a source.
    """
    per = sized.groupBy("skey").agg(F.max("source").alias("source"), F.sum("size").alias("source_size"))
    rank = F.row_number().over(W.orderBy(F.col("source").isNull(), "source"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int")).cast("long")
    per = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_repeat)
    ordered = W.orderBy(F.col("cap") / F.col("weight"), "skey")
    before, everything = ordered.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    weights_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    per = per.withColumn("share", left / weights_left)
    # the share holds from the first source on whose cap isn't below it
    open_share = F.min(F.when(F.col("cap") >= F.col("share") * F.col("weight"), F.struct(F.col("cap") / F.col("weight"), "skey", "share"))).over(everything)
    return per.select("skey", "source_size", F.least(F.col("cap").cast("double"), F.col("weight") * open_share["share"]).alias("target"))


def thresholds(sized: DataFrame, per_source: DataFrame) -> DataFrame:
    """per_source with `repeats`, the times that all documents are taken, and `below`, the hash threshold for one more."""
    repeats = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    per = per_source.withColumn("repeats", repeats)
    per = stage(per.withColumn("budget", F.col("target") - F.col("repeats") * F.col("source_size")), "mix-sources")
    edge = per.select("skey", F.col("budget").alias("left"), F.lit(0).cast("long").alias("prefix"))
    for level in range(1, LEVELS + 1):
        shift = HASH_BITS - LEVEL_BITS * level
        inside = sized.join(edge, "skey").where(F.shiftright("h", shift + LEVEL_BITS) == F.col("prefix"))
        sums = inside.groupBy("skey", "left", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("words"))
        before = F.coalesce(F.sum("words").over(W.partitionBy("skey").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        rest = F.col("left") - before
        reach = F.lit(0.0) if level < LEVELS else F.col("words") / 2
        # the last bucket that begins within the budget is refined; at the last level it is taken if half of it fits
        found = sums.withColumns({"rest": rest, "fits": rest >= reach}).groupBy("skey").agg(
            F.max(F.when(F.col("fits"), F.struct("bucket", "rest"))).alias("last"), F.min("bucket").alias("first")
        )
        if level < LEVELS:
            edge = stage(found.select("skey", F.col("last.rest").alias("left"), F.col("last.bucket").alias("prefix")), f"mix-edge{level}")
        else:
            edge = found.select("skey", F.coalesce(F.col("last.bucket") + 1, F.col("first")).alias("below"))
    return stage(per.join(edge, "skey", "left"), "mix-thresholds")


def copies_of(key: str, h: str, rule: DataFrame, docs: DataFrame, max_repeat: int) -> DataFrame:
    """docs with the columns of rule, a row per source, and `copies`. key, h: docs' columns of source keys and hashes."""
    joined = docs.join(rule, F.col(key) == F.col("skey"))
    more = (F.col("repeats") < max_repeat) & (F.col(h) < F.coalesce("below", F.lit(0)))
    return joined.withColumn("copies", (F.col("repeats") + more.cast("long")).cast("int"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = 3) -> DataFrame:
    """doc_id, source_size, target, size, copies and taken for each row of docs."""
    sized = with_sizes(docs)
    rule = thresholds(sized, targets(sized, weights, max_repeat))
    rows = copies_of("key", "h", rule, sized.withColumnRenamed("skey", "key"), max_repeat)
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mixed_rows(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = 3) -> DataFrame:
    """The rows of docs with all their columns, each as often as the mix takes it.

    Rows are copied by their own hash, without a join of documents; the rule is a row per source.
    """
    sized = with_sizes(docs)
    rule = thresholds(sized, targets(sized, weights, max_repeat)).select("skey", "repeats", "below")
    own = docs.select(F.struct(*docs.columns).alias("row"), source_key().alias("key"), mixing_hash().alias("h"))
    rows = copies_of("key", "h", rule, own, max_repeat).where("copies > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")


#: The same mix in DuckDB's SQL: documents in hash order, the last one taken if half of it fits.
SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))), 1, 10))::BIGINT AS h FROM {docs}),
s AS (SELECT source, sum(size)::BIGINT AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM d GROUP BY source),
c AS (SELECT *, 3 * source_size AS cap, 3 * source_size / weight AS ratio FROM s),
w AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS share
  FROM c WINDOW o AS (ORDER BY ratio, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min(share, ratio) AS share FROM w WHERE cap >= share * weight),
t AS (SELECT source, source_size, least(cap::DOUBLE, weight * l.share) AS target FROM c, l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS repeats FROM t),
g AS (SELECT d.source, h, sum(size) AS words FROM d GROUP BY ALL),
e AS (SELECT g.source, h, words, target - repeats * source_size - (sum(words) OVER (PARTITION BY g.source ORDER BY h) - words) AS rest
  FROM g JOIN r ON g.source IS NOT DISTINCT FROM r.source),
b AS (SELECT source, max(h) AS upto FROM e WHERE rest >= words / 2 GROUP BY source)
SELECT d.*, r.source_size, r.target, (r.repeats + CASE WHEN r.repeats < 3 AND h <= coalesce(upto, -1) THEN 1 ELSE 0 END)::BIGINT AS copies
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source LEFT JOIN b ON d.source IS NOT DISTINCT FROM b.source
"""
