"""Phrases are counted in a bounded number of passes, however full the buckets are."""

import numpy as np
from pyspark import SparkContext

from contrail.llm import collocations

from .test_counts_search_phrases import phrases_by_hand

KINDS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def test_full_buckets_make_no_more_passes(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(["en", None][i % 2], " ".join(f"w{n}" for n in rng.integers(0, 1100, 1000)) + " again and again and again") for i in range(300)]  # 4.6 pairs for each of 2**16 buckets, few of them frequent
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    wanted, made, plain = phrases_by_hand(rows, 3, 60), [], SparkContext.broadcast
    monkeypatch.setattr(SparkContext, "broadcast", lambda self, value: made.append(1) or plain(self, value))
    mine = lambda: sorted(tuple(r) for r in collocations.mine(docs, top=60, least=3, shard=5000, pack=20_000, most_bits=16).select(*KINDS).collect())
    assert mine() == wanted and len(made) <= 10
    monkeypatch.setattr(collocations, "KNOWN", 300)  # of more phrases in the first packs
    assert mine() == wanted


def test_files_hold_few_packs(spark):
    docs = spark.range(200).selectExpr("'en' AS lang", "'a b c d e' AS text").coalesce(1)
    sizes = [r["count"] for r in collocations.packs(docs, size=10).selectExpr("input_file_name() AS file").groupBy("file").count().collect()]
    assert max(sizes) <= collocations.HELD < sum(sizes)
