"""What is broadcast for phrases is gone once it has been used."""

import os
import random

from pyspark import SparkContext

from contrail.llm import collocations


def test_no_broadcast_outlives_its_step(spark, monkeypatch):
    rng = random.Random(2)
    docs = spark.createDataFrame([("en", " ".join(rng.choices("abcdefgh", k=60))) for _ in range(40)], "lang string, text string").repartition(3)
    wanted = sorted(map(repr, collocations.mine(docs, least=3, shard=1 << 19).collect()))
    made, plain = [], SparkContext.broadcast
    monkeypatch.setattr(SparkContext, "broadcast", lambda self, value: made.append(plain(self, value)) or made[-1])
    found = collocations.mine(docs, least=3, shard=20, pack=100)
    assert len(made) > 10 and not any(os.path.exists(b._path) for b in made)
    assert wanted and sorted(map(repr, found.collect())) == wanted
