"""Op 4: chat formatting with cumulative-snapshot collapse. DataFrame functions only.

Chat logs often hold a conversation again and again as it grows. Rolling hashes of the turns' prefixes find each
conversation that is a prefix of a longer one (or equals another; the smallest conv_id stays), an anti-join keeps
the maximal conversations, and only those are rendered.

Turns are ordered by (turn, role, text), nulls first; repeated rows are turns of their own. A null role or text
renders as an empty one, yet differs from it in comparisons. Rows with null conv_id form one conversation. Turns of any
length are hashed and rendered whole. No rows yield no rows. Columns other than conv_id, turn, role and text are ignored,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stage


def rolling_prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, pos (from 1) and two 64-bit hashes of the conversation's first pos turns.

    A turn is hashed with its position, and a prefix is the exclusive or of its turns' hashes, which a window
    rolls over a few bytes a turn.
    """
    digest = F.md5(F.concat_ws("|", F.col("role").isNull().cast("int"), F.col("text").isNull().cast("int"), F.length("role"), "role", "text").cast("binary"))
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text_md5", "digest")
    thin = turns.select("conv_id", "turn", "role", F.md5(F.col("text").cast("binary")).alias("text_md5"), digest.alias("digest"))
    placed = thin.withColumn("pos", F.row_number().over(order))
    for i, salt in enumerate(("prefix-a", "prefix-b"), 1):
        rolled = F.bit_xor(F.xxhash64(F.lit(salt), "pos", "digest")).over(W.partitionBy("conv_id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
        placed = placed.withColumn(f"h{i}", rolled)
    return placed.select("conv_id", "pos", "h1", "h2")


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id and n_turns of the conversations that are no prefix of another.

    The proper prefixes and the whole conversations meet on the hashes, aggregated before the shuffle; so a first
    turn that very many conversations share is one row a task.
    """
    prefixes = stage(rolling_prefixes(turns), "chat-prefixes")
    length = prefixes.groupBy("conv_id").agg(F.max("pos").alias("n_turns"))
    whole = prefixes.groupBy("conv_id").agg(F.max_by(F.struct("h1", "h2"), "pos").alias("h"), F.max("pos").alias("n_turns"))
    whole = stage(whole.select("conv_id", "n_turns", "h.h1", "h.h2"), "chat-whole")
    proper = prefixes.join(length.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c"))).where("pos < n_turns").select("h1", "h2").distinct()
    first = whole.groupBy("h1", "h2").agg(F.min(F.struct(F.col("conv_id").isNull().alias("last"), "conv_id", "n_turns")).alias("one"))
    return first.join(proper, ["h1", "h2"], "left_anti").select("one.conv_id", "one.n_turns")


def render(turns: DataFrame, start: str = "<|im_start|>", end: str = "<|im_end|>\n") -> DataFrame:
    """conv_id, n_turns and the conversation's text, a row per conversation."""
    turn = F.struct("turn", "role", F.md5(F.col("text").cast("binary")).alias("m"), "text")
    parts = F.transform(
        F.array_sort(F.collect_list(turn)),
        lambda t: F.concat(F.lit(start), F.coalesce(t["role"], F.lit("")), F.lit("\n"), F.coalesce(t["text"], F.lit("")), F.lit(end)),
    )
    return turns.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.array_join(parts, "").alias("rendered"))


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns and rendered of the maximal conversations."""
    turns = turns.select("conv_id", "turn", "role", "text")
    kept = maximal(turns).select(F.col("conv_id").alias("kept_id"))
    return render(turns.join(kept, F.col("conv_id").eqNullSafe(F.col("kept_id")), "left_semi"))


SQL = """
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, md5(text) NULLS FIRST) AS pos,
  md5(coalesce('r' || length(role) || role, 'n') || coalesce('t' || text, 'n')) AS x,
  '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS line FROM conversations),
p AS (SELECT conv_id, pos, string_agg(x, '') OVER (PARTITION BY conv_id ORDER BY pos) AS prefix FROM t),
w AS (SELECT conv_id, count(*) AS n_turns, string_agg(x, '' ORDER BY pos) AS whole, string_agg(line, '' ORDER BY pos) AS rendered FROM t GROUP BY conv_id),
r AS (SELECT *, row_number() OVER (PARTITION BY whole ORDER BY conv_id NULLS LAST) AS nth FROM w),
q AS (SELECT DISTINCT prefix FROM p JOIN w ON p.conv_id IS NOT DISTINCT FROM w.conv_id WHERE pos < n_turns)
SELECT conv_id, n_turns, length(rendered) AS n_chars, sha256(rendered) AS rendered_sha256 FROM r WHERE nth = 1 AND whole NOT IN (SELECT prefix FROM q)
"""
