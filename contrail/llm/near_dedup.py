"""Op 5: near-duplicate documents by circulant MinHash, with links confirmed on full shingle sets.

A document's set are its distinct five-word shingles. Two permutations give all coordinates of its signature: the
first shuffles the shingles' hashes, the second is applied to them shifted by k, for the k-th coordinate. Bands of
coordinates put sets into buckets. Documents of equal sets are one node. In each bucket all nodes are first held
against one of them (the bucket's hub); then, where nodes of different components are left, blocks of the bucket
are held against each other as matrices (all of them against those outside the bucket's largest component). Blocks
are bounded by nodes and by shingles. Only confirmed links leave a task. No bucket is capped, no pair of a bucket left
out but those whose nodes are known to be in one component; so all pairs inside a group of copies are never made.
Texts meet nodes before these are dealt to jobs, so a hub of many members is one row of that join; its text is then
copied to its jobs in two steps. A bucket of n nodes of which most are unlike costs about (n / BLOCK)^2 jobs, and each
text is sent once to each block that it is held against.

Bands and rows follow from the similarity: with 30 bands of 6 coordinates two sets of Jaccard 0.85, and with 36 bands
of 5 two sets of Jaccard 0.8, share no bucket with odds of 7 in 10^7.

Null and empty texts, or those without words, have no shingles, are linked with nothing and are components of
their own. Repeated rows are copies. A null doc_id takes part; the component_id ignores it unless it is alone. Very
long texts are shingled whole. No rows yield no rows. Columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, join_hot, slices, stage
from .components import components
from .shingles import mix32, mix64, shingles

MISSED, MOST_BANDS, BLOCK, BLOCK_SHINGLES, FAN_OUT = 7e-7, 42, 128, 1 << 20, 64


def bands_and_rows(percent: int) -> tuple[int, int]:
    """The longest bands, of 6 coordinates at most, of which MOST_BANDS miss a pair of this similarity with odds of MISSED or less."""
    for rows in range(6, 0, -1):
        bands = math.ceil(math.log(MISSED) / math.log1p(-min(percent / 100, 0.99) ** rows))
        if bands <= MOST_BANDS:
            break
    return bands, rows


def signatures(hashes: np.ndarray, starts: np.ndarray, coordinates: int) -> np.ndarray:
    """Signatures of the sets whose shingles' hashes begin at starts, a column per set."""
    first = mix32((hashes ^ (hashes >> np.uint64(32))).astype(np.uint32) ^ np.uint32(0x5BD1E995))
    return np.stack([np.minimum.reduceat(mix32(first + np.uint32(k)), starts) for k in range(coordinates)])


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key per set and band."""
    out = []
    for band in range(bands):
        key = np.full(signature.shape[1], band, np.uint64)
        for row in signature[band * rows : (band + 1) * rows]:
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + row.astype(np.uint64))
        out.append(key)
    return np.stack(out, axis=1).view(np.int64)


def unique_sets(texts: list[str], width: int) -> list[np.ndarray]:
    """Each text's set of shingle hashes, sorted. Long texts are split into words a slice at a time."""
    return [np.unique(h) for a, b in batches_of(texts, 1 << 19) for h in shingles(texts[a:b], width)]


def sets(docs: DataFrame, bands: int, rows: int, width: int) -> DataFrame:
    """row (a number), doc_id, text, n_shingles, node (a 128-bit digest of the set, null if empty) and the set's band keys."""

    def run(batches):
        for batch in batches:
            lengths = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)
            for a, b in slices(lengths, 1 << 19):
                part = batch.slice(a, b - a)
                found = unique_sets(part.column("text").to_pylist(), width)
                sizes = np.array([len(h) for h in found], np.int64)
                full = np.flatnonzero(sizes)
                keys: list = [None] * (b - a)
                if len(full):
                    starts = np.cumsum(sizes[full]) - sizes[full]
                    made = band_keys(signatures(np.concatenate([found[i] for i in full]), starts, bands * rows), bands, rows)
                    for i, row in zip(full, made, strict=True):
                        keys[i] = row
                nodes = [hashlib.blake2b(h.tobytes(), digest_size=16).hexdigest() if len(h) else None for h in found]
                columns = [*part.columns, pa.array(sizes), pa.array(nodes, pa.string()), pa.array(keys, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "text", "n_shingles", "node", "bands"])

    clean = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return clean.mapInArrow(run, "row long, doc_id long, text string, n_shingles long, node string, bands array<long>")


def overlaps(left: list[np.ndarray], right: list[np.ndarray], step: int = 1 << 15) -> np.ndarray:
    """Sizes of the intersections of all left with all right sets, by products of incidence matrices."""
    known = np.unique(np.concatenate(left))
    out = np.zeros((len(left), len(right)), np.int64)

    def cells(group):
        owner = np.repeat(np.arange(len(group)), [len(h) for h in group])
        flat = np.concatenate(group)
        at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
        good = known[at] == flat
        return owner[good], at[good]

    (lo, la), (ro, ra) = cells(left), cells(right)
    for a in range(0, len(known), step):
        width = min(step, len(known) - a)
        matrices = []
        for owner, at, n in ((lo, la, len(left)), (ro, ra, len(right))):
            here = (at >= a) & (at < a + width)
            m = np.zeros((n, width), np.float32)
            m[owner[here], at[here] - a] = 1
            matrices.append(m)
        out += (matrices[0] @ matrices[1].T).astype(np.int64)  # at most `step` each, which single precision holds exactly
    return out


def copied(rows: DataFrame, times: str, by: list[str]) -> DataFrame:
    """rows with `other`, a copy each of 0 <= other < times. More than FAN_OUT copies are made in two steps, by many tasks.

    by: what tells rows apart.
    """
    few = rows.where(F.col(times) <= FAN_OUT).withColumn("other", F.explode(F.sequence(F.lit(0), F.col(times) - 1)))
    many = rows.where(F.col(times) > FAN_OUT).withColumn("step", F.explode(F.sequence(F.lit(0), F.col(times) - 1, F.lit(FAN_OUT)))).repartition(*by, "step")
    return few.unionByName(many.withColumn("other", F.explode(F.sequence("step", F.least(F.col("step") + FAN_OUT, times) - 1))).drop("step"))


def confirm(rows: DataFrame, percent: int, width: int) -> DataFrame:
    """Links a, b among rows (job, side, node, label, text): side 0 against side 1 of each job.

    Rows of one label are in one component already.
    """

    def links(job: list):
        sides = [[r for r in job if r[0] == s] for s in (0, 1)]
        if all(sides):
            left, right = (unique_sets([r[3] for r in side], width) for side in sides)
            common = overlaps(left, right)
            union = np.array([len(h) for h in left])[:, None] + np.array([len(h) for h in right]) - common
            for i, j in zip(*np.nonzero(100 * common >= percent * union), strict=True):
                a, b = sides[0][i], sides[1][j]
                if a[2] != b[2]:
                    yield a[1], b[1]

    def run(batches):
        name, job = None, []
        for batch in batches:
            found = []
            for a in range(0, batch.num_rows, 2 * BLOCK):
                for key, *row in zip(*(c.to_pylist() for c in batch.slice(a, 2 * BLOCK).columns), strict=True):
                    if key != name:
                        found += links(job)
                        name, job = key, []
                    job.append(row)
            yield linked(found)
        yield linked(links(job))

    def linked(found) -> pa.RecordBatch:
        found = list(found)
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.string()) for i in (0, 1)], ["a", "b"])

    return rows.repartition("job").sortWithinPartitions("job", "side").mapInArrow(run, "a string, b string")


def blocks(count, size):
    """Into how many blocks so many nodes of so many shingles go."""
    return F.ceil(F.greatest(count / F.lit(BLOCK), size / F.lit(BLOCK_SHINGLES))).cast("int")


def labelled_nodes(held: DataFrame, percent: int, width: int) -> DataFrame:
    """node and label (which names its component) of all sets of held (see sets)."""
    full = held.where("node IS NOT NULL")
    nodes = full.groupBy("node").agg(F.first("bands").alias("bands"), F.first("n_shingles").alias("size"))
    members = stage(nodes.select("node", "size", F.explode("bands").alias("bucket")), "near-buckets")

    hub = F.min(F.struct(F.xxhash64("bucket", "node").alias("h"), "node"))
    hubs = members.groupBy("bucket").agg(hub["node"].alias("hub"), F.count("*").alias("n")).where("n > 1")
    members = stage(join_hot(members, stage(hubs, "near-hubs"), "bucket").where("hub IS NOT NULL"), "near-members")
    # of each node one row's text; nodes of very many rows are no hot keys, as the join is by row
    picked = full.groupBy("node").agg(F.min("row").alias("row")).join(members.select("node").distinct(), "node", "left_semi")
    texts = stage(full.select("row", "text").join(picked, "row").select("node", "text"), "near-texts")

    pairs = members.where("node <> hub").select("hub", "node", "size").distinct()
    chunks = stage(pairs.groupBy("hub").agg(blocks(F.count("*"), F.sum("size")).alias("chunks"), F.count("*").alias("n")), "near-chunks")
    job = lambda key, *of: F.concat_ws(":", key, *of).alias("job")
    placed = join_hot(pairs, chunks, "hub").select(job("hub", F.pmod(F.xxhash64("node"), F.col("chunks"))), "node").join(texts, "node")
    first = copied(chunks.select(F.col("hub").alias("node"), "chunks").join(texts, "node"), "chunks", ["node"])
    first = first.select(job("node", "other"), F.lit(0).alias("side"), "node", F.col("node").alias("label"), "text")
    work = first.union(placed.select("job", F.lit(1), "node", F.col("node").alias("label"), "text"))
    links = stage(confirm(work, percent, width), "near-links")

    known = stage(components(links), "near-components")
    left = members.where("node <> hub").select("bucket", "node", "size").join(known, "node", "left")
    left = stage(left.select("bucket", "node", "size", F.coalesce("label", "node").alias("label")), "near-left")
    counts = left.groupBy("bucket", "label").agg(F.count("*").alias("n"), F.sum("size").alias("size"), *(F.bit_xor(F.xxhash64(F.lit(i), "node")).alias(f"x{i}") for i in (1, 2)))
    # buckets of several components; of those with equal members one is enough
    mixed = counts.groupBy("bucket").agg(
        F.count("*").alias("labels"), F.sum("n").alias("all"), F.sum("size").alias("size"), F.max(F.struct("n", "label", "size")).alias("major"), F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2")
    )
    mixed = mixed.where("labels > 1").groupBy("all", "x1", "x2").agg(F.min(F.struct("bucket", "major", "size")).alias("one"))
    ones = blocks(F.col("all") - F.col("one.major.n"), F.col("one.size") - F.col("one.major.size"))
    mixed = mixed.select("one.bucket", F.col("one.major.label").alias("major"), ones.alias("ones"), blocks(F.col("all"), F.col("one.size")).alias("every"), F.col("all").alias("n"))
    left = stage(join_hot(left, mixed, "bucket").where("major IS NOT NULL"), "near-mixed").join(texts, "node")  # a node has a row a band at most
    # nodes outside the bucket's largest component against all of the bucket, in blocks
    block = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    low = copied(left.where("label <> major"), "every", ["bucket", "node"])
    high = copied(left, "ones", ["bucket", "node"])
    work = low.select(job("bucket", block("ones"), "other"), F.lit(0).alias("side"), "node", "label", "text")
    work = work.union(high.select(job("bucket", "other", block("every")), F.lit(1), "node", "label", "text"))
    links = links.union(confirm(work, percent, width))

    labels = stage(components(links), "near-labels")
    return nodes.select("node").join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"))


def held_sets(docs: DataFrame, percent: int, width: int) -> DataFrame:
    return stage(sets(docs, *bands_and_rows(percent), width), "near-sets")


def one_of_each(docs: DataFrame, percent: int = 85, width: int = 5) -> DataFrame:
    """doc_id and digest (the text's MD5; null: empty) of one row of each component, of the least doc_id and digest, and of all rows without shingles."""
    held = held_sets(docs, percent, width)
    rows = held.select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), "node")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest"))
    own = rows.where("node IS NOT NULL").groupBy("node").agg(least.alias("row"))
    ones = own.join(labelled_nodes(held, percent, width), "node").groupBy("label").agg(F.min("row").alias("row"))
    return ones.select("row.doc_id", "row.digest").union(rows.where("node IS NULL").select("doc_id", "digest").distinct())


def dedup(docs: DataFrame, percent: int = 85, width: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs (doc_id, text)."""
    held = held_sets(docs, percent, width)
    rows = held.select("doc_id", "n_shingles", "node")
    own = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    nodes = stage(own.join(labelled_nodes(held, percent, width), "node"), "near-nodes")
    whole = nodes.groupBy("label").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    resolved = join_hot(nodes.select("node", "label", F.col("n").alias("copies")), whole, "label")
    resolved = stage(resolved.select("node", "component_id", F.col("copies").alias("n")), "near-resolved")
    out = join_hot(rows, resolved, "node").withColumn("component_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


#: op5_near_dedup in SQL, by all pairs that share a shingle: for tables of some thousand documents.
SQL = r"""
WITH RECURSIVE words AS (
 SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
 SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS shingle FROM words
), sizes AS (
 SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
 SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM shingles a JOIN shingles b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
 SELECT x, y FROM shared JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * common >= 85 * (a.n + b.n - common)
), reach AS (
 SELECT doc_id, doc_id AS root FROM documents UNION SELECT y, root FROM reach JOIN links ON x = doc_id
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)
"""
