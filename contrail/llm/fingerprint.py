"""Op 7: document fingerprints by one-permutation MinHash.

A document's five-word shingles are hashed once; the hash picks a bin and the least rest in each bin stays. Empty
bins copy a bin picked by a chain of hashes that depends on the bin alone (optimal densification). The low bits of
each bin are packed into a hex string. The likeness of two fingerprints is their share of equal bins, corrected for
bits that agree by chance.

Texts that are null or have no words have the empty fingerprint "": like to itself (1), unlike anything else (0). Very
long texts are hashed whole. Rows of one doc_id are ordered by their texts' hashes. No rows yield no rows. Columns other than
doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, stage
from .shingles import mix64, shingles

BINS, BITS = 512, 4


def _donors(bins: int, attempts: int = 4096) -> np.ndarray:
    """For each bin and attempt, the bin to copy from."""
    x = np.arange(bins, dtype=np.uint64)[:, None] * np.uint64(attempts) + np.arange(attempts, dtype=np.uint64)
    return (mix64(x + np.uint64(0x5851F42D4C957F2D)) % np.uint64(bins)).astype(np.int64)


_DONORS: dict[int, np.ndarray] = {}


def bin_values(hashes: np.ndarray, bins: int = BINS) -> np.ndarray:
    """The least hash of each bin, with empty bins filled."""
    if bins not in _DONORS:
        _DONORS[bins] = _donors(bins)
    least = np.full(bins, np.iinfo(np.uint64).max, np.uint64)
    falling = np.sort(hashes)[::-1]  # of the hashes of a bin the last, the least, stays
    least[(falling % np.uint64(bins)).astype(np.int64)] = falling // np.uint64(bins)
    empty = least == np.iinfo(np.uint64).max
    if not empty.any():
        return least
    rows, full = np.flatnonzero(empty), np.flatnonzero(~empty)
    donors, step = _DONORS[bins], 16
    source = np.full(len(rows), -1)
    for a in range(0, donors.shape[1], step):
        todo = np.flatnonzero(source < 0)
        if not len(todo):
            break
        some = donors[rows[todo], a : a + step]
        hit = ~empty[some]
        found = hit.any(1)
        source[todo[found]] = some[found, hit[found].argmax(1)]
    source[source < 0] = full[0]
    least[rows] = least[source]
    return least


def fingerprint(hashes: np.ndarray, bins: int = BINS) -> np.ndarray | None:
    """BITS low bits of each bin; None for a document without shingles.

    The bin's number is mixed in, so that two values that agree in their low bits in one bin, and fill others that
    were empty, agree there no oftener than others.
    """
    if not len(hashes):
        return None
    salt = mix64(np.arange(1, bins + 1, dtype=np.uint64))
    return (mix64(bin_values(hashes, bins) ^ salt) & np.uint64(2**BITS - 1)).astype(np.uint8)


def packed(codes: np.ndarray | None) -> str:
    return "" if codes is None else ((codes[::2] << 4) | codes[1::2]).tobytes().hex()


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    if a is None or b is None:
        return float(a is b)
    chance = 2.0**-BITS
    return float(max(0.0, (np.mean(a == b) - chance) / (1 - chance)))


def ranges(docs: DataFrame, n: int) -> DataFrame:
    """docs with `part`, rising as doc_id falls (null ids last) and, within one id, as the text's `hash` falls; each part is about an n-th of the rows.

    An id that fills several n-ths, null included, is cut into as many parts by the hashes of its texts. Only copies
    of one text under one id stay together.
    """
    found = docs.agg(F.count("*").alias("rows"), F.count("doc_id").alias("known"), F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 10_000).alias("cuts")).first()
    times = Counter(found["cuts"] or []) if n > 1 else {}
    cuts = sorted(times)
    # parts in falling order: the ids above all cuts, those up to each cut, null
    shares = [1, *(times[c] for c in reversed(cuts)), max(1, round(n * (found["rows"] - found["known"]) / max(1, found["rows"])))]
    begins = [sum(shares[:i]) for i in range(len(shares))]
    above = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c >= F.col("doc_id"))) if cuts else F.lit(0)
    docs = docs.withColumn("place", F.when(F.col("doc_id").isNull(), len(shares) - 1).otherwise(above).cast("int"))
    at = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("place") + 1)
    # the cut itself comes first among the ids of its place, in falling order of hashes; smaller ids go to the last part
    whole = F.col("doc_id").isNull() | F.coalesce(F.col("doc_id") == at([None, *reversed(cuts), None]).cast("long"), F.lit(False))
    nth = F.least(F.floor((2.0**63 - F.col("hash").cast("double")) / 2.0**64 * at(shares)), at(shares) - 1)
    return docs.withColumn("part", (at(begins) + F.when(whole, nth).otherwise(at(shares) - 1)).cast("int")).drop("place")


def with_next(docs: DataFrame) -> DataFrame:
    """fingerprints of docs (doc_id, text) and of their edited texts, as the query op7 returns them.

    The next document is that of the next smaller doc_id (equal ids: by hash and text); the first follows the last. Ranges
    of ids are dealt to tasks once, each with the first row of the next range; these borders are one row a task.
    """
    spark = docs.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    text = F.coalesce("text", F.lit(""))
    rows = ranges(docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.xxhash64(text).alias("hash")), n)
    key = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "hash", "text")
    borders = stage(rows.groupBy("part").agg(F.max(key).alias("first")), "fingerprint-borders")
    parts = sorted(r["part"] for r in borders.select("part").collect())  # at most one a shuffle partition
    before = {p: parts[i - 1] for i, p in enumerate(parts)}
    if not parts:
        before = {0: 0}
    back = F.element_at(F.create_map(*[F.lit(x) for p in before.items() for x in p]), F.col("part"))
    halo = borders.select(F.col("first.doc_id").alias("doc_id"), F.col("first.text").alias("text"), F.col("first.hash").alias("hash"), back.alias("part"), F.lit(True).alias("halo"))
    dealt = rows.withColumn("halo", F.lit(False)).unionByName(halo).repartitionById(max([0, *parts]) + 1, F.col("part"))
    ordered = dealt.sortWithinPartitions("halo", F.desc_nulls_last("doc_id"), F.desc("hash"), F.desc("text"))
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches):
        held = None
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for a, b in batches_of(texts):
                pairs = ([held] if held else []) + list(zip(ids[a:b], texts[a:b], strict=True))
                held = pairs[-1]
                if len(pairs) > 1:
                    yield edited([i for i, _ in pairs], [t for _, t in pairs])

    def edited(ids: list, texts: list[str]) -> pa.RecordBatch:
        halves = [len(t) // 2 for t in texts[:-1]]
        changed = [t[: len(t) - h] + after[:h] for t, after, h in zip(texts, texts[1:], halves, strict=False)]
        own = [fingerprint(x) for x in shingles(texts)]
        new = [fingerprint(x) for x in shingles(changed)]
        columns = {
            "doc_id": pa.array(ids[:-1], pa.int64()),
            "n_chars": pa.array([len(t) for t in texts[:-1]], pa.int64()),
            "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in changed],
            "fingerprint": [packed(x) for x in own[:-1]],
            "edited_fingerprint": [packed(x) for x in new],
            "near_edited": [likeness(x, y) for x, y in zip(own, new, strict=False)],
            "near_next": [likeness(x, y) for x, y in zip(own, own[1:], strict=False)],
        }
        return pa.RecordBatch.from_pydict(columns)

    return ordered.mapInArrow(run, schema)
