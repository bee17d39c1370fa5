"""Op 12: ranked lexical search over deduplicated bags of terms.

Terms are the longest runs of letters, digits and characters beyond ASCII, A-Z lower-cased. Only terms of the items matter
for scores, so each document is cut down to its bag: how often it has each term of the items' vocabulary. Two documents
with equal bags and equal length weight m score alike for every item. Such classes are found by hash, verified on the whole
bags, and scored once; a class keeps its k smallest doc_ids, as no item can rank more of them. Items are taken in
blocks of a bounded number of terms, so that what is broadcast has a fixed bound whatever the number of items; a single
item's own distinct terms have to fit. Each task keeps the k best classes of each item of the block and no more.

Null and empty texts have no terms: such documents don't count, such items rank nothing. Very long texts count whole. Repeated rows
are documents of their own, also under one doc_id; a null doc_id ranks last among ties; each row of items gets its own
ranking. Empty tables give no rows. Columns other than the named ones are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import batches_of, stage
from .pieces import ragged

K1, B = 12, 25  # k1 = 1.2 in tenths, b = 0.25 in hundredths
ITEM_TERMS = 1 << 20  # distinct terms of all items in a block
ENTRIES = 1 << 21  # products that are held at once
NO_ID = 2**63 - 1  # stands for a null id

#: Bytes of a term, A-Z lower-cased; all others become spaces.
_TABLE = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else c + 32 if 65 <= c < 91 else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item_no (a number per row), item_id, terms and how often the item has each, as a written table. Items without terms are left out."""
    rows = items.select(F.monotonically_increasing_id().alias("item_no"), F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            found = list(map(Counter, map(terms, batch.column("text").to_pylist())))
            bags = [pa.array([list(f) for f in found], pa.list_(pa.binary())), pa.array([list(f.values()) for f in found], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("item_no"), batch.column("item_id"), *bags], ["item_no", "item_id", "terms", "times"])

    return stage(rows.mapInArrow(run, "item_no long, item_id long, terms array<binary>, times array<long>").where("size(terms) > 0"), "search-items")


def bags(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """id, n (the document's terms), and of those in the vocabulary the number (`terms`, ascending) and count (`tfs`), as a written table."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)
    size = max(1, len(vocabulary))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        number = held.value
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for a, b in batches_of(texts):
                split = list(map(terms, texts[a:b]))
                n = np.fromiter(map(len, split), np.int64, b - a)
                codes = np.fromiter(map(number.get, chain.from_iterable(split), repeat(-1)), np.int64, int(n.sum()))
                keys, tfs = np.unique((np.repeat(np.arange(b - a), n) * size + codes)[codes >= 0], return_counts=True)
                bounds = pa.array(np.searchsorted(keys, np.arange(b - a + 1) * size), pa.int32())
                lists = [pa.ListArray.from_arrays(bounds, pa.array(x, kind)) for x, kind in ((keys % size, pa.int32()), (tfs, pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), pa.array(n), *lists], ["id", "n", "terms", "tfs"])

    return stage(rows.mapInArrow(run, "id long, n long, terms array<int>, tfs array<long>").where("n > 0"), "search-bags")


def classes(found: DataFrame, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """m, terms, tfs and members (the k smallest ids, ascending) of each class of documents that score alike."""
    m = (F.lit(100 - B) + F.expr(f"({B} * n * {n_docs}L) div {max(1, n_terms)}L")).alias("m")
    rows = found.where("size(terms) > 0").select("id", m, "terms", "tfs").withColumn("h", F.xxhash64("m", "terms", "tfs"))
    alike = ("h", "m", "terms", "tfs")  # the hash decides most comparisons, the rest verifies it
    nth = F.row_number().over(W.partitionBy(*alike).orderBy("id"))  # limited before the shuffle, too
    return rows.withColumn("nth", nth).where(F.col("nth") <= k).groupBy(*alike).agg(F.array_sort(F.collect_list("id")).alias("members")).drop("h")


class Ranking:
    """The k best classes of each item so far."""

    def __init__(self, items: int, k: int):
        self.k, self.floor = k, np.ones(items, np.int64)
        self.item, self.score, self.first, self.members = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, object)

    def add(self, scores: np.ndarray, members: np.ndarray) -> None:
        """scores: a row per class, a column per item. A class whose score equals the k-th may still hold smaller ids."""
        own, item = np.nonzero(scores >= self.floor)
        first = np.fromiter((m[0] for m in members), np.int64, len(members))
        columns = zip((self.item, self.score, self.first, self.members), (item, scores[own, item], first[own], members[own]), strict=True)
        item, score, first, held = (np.concatenate(pair) for pair in columns)
        order = np.lexsort((first, -score, item))
        begins = np.searchsorted(item[order], np.arange(len(self.floor)))
        rank = np.arange(len(order)) - begins[item[order]]
        order = order[rank < self.k]
        self.item, self.score, self.first, self.members = item[order], score[order], first[order], held[order]
        full = np.bincount(self.item, minlength=len(self.floor)) >= self.k
        lowest = np.searchsorted(self.item, np.arange(len(self.floor)), "right") - 1
        self.floor[full] = self.score[lowest[full]]


def products(m: np.ndarray, flat: np.ndarray, tfs: np.ndarray, own: np.ndarray, block) -> np.ndarray:
    """Scores, a row per class and a column per item. flat: terms of all classes, own: the class of each."""
    weight, starts, degrees, item, times = block
    part = weight[flat] * ((1_000_000_000 * tfs) // (1000 * tfs + K1 * m[own]))
    met = ragged(starts[flat], degrees[flat])
    out = np.zeros((len(m), len(item[1])), np.int64)
    np.add.at(out.reshape(-1), np.repeat(own, degrees[flat]) * out.shape[1] + item[0][met], np.repeat(part, degrees[flat]) * times[met])
    return out


def ranked(found: DataFrame, block, k: int) -> DataFrame:
    """item_no, item_id, score and members of each task's k best classes of each item."""
    held = found.sparkSession.sparkContext.broadcast(block)

    def run(batches):
        block = held.value
        degrees, numbers, ids = block[2], block[3][1], block[3][2]
        best = Ranking(len(numbers), k)
        for batch in batches:
            m, lists = batch.column("m").to_numpy(), batch.column("terms")
            bounds, flat, tfs = lists.offsets.to_numpy(), lists.values.to_numpy(), batch.column("tfs").values.to_numpy()
            members = np.empty(len(m), object)
            members[:] = batch.column("members").to_pylist()
            work = np.concatenate([[0], np.cumsum(degrees[flat])])[bounds - bounds[0]] if len(flat) else np.zeros(len(m) + 1, np.int64)
            a = 0
            while a < len(m):
                b = int(max(a + 1, min(np.searchsorted(work, work[a] + ENTRIES, "right") - 1, a + max(1, ENTRIES // len(numbers)))))
                i, j = bounds[a], bounds[b]
                best.add(products(m[a:b], flat[i:j], tfs[i:j], np.repeat(np.arange(b - a), np.diff(bounds[a : b + 1])), block), members[a:b])
                a = b
        at = best.item
        yield pa.RecordBatch.from_arrays([pa.array(numbers[at]), pa.array([ids[i] for i in at], pa.int64()), pa.array(best.score), pa.array(best.members.tolist(), pa.list_(pa.int64()))], ["item_no", "item_id", "score", "members"])

    return found.mapInArrow(run, "item_no long, item_id long, score long, members array<long>")


def search(docs: DataFrame, items: DataFrame, k: int = 20, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", item_terms_bound: int = ITEM_TERMS) -> DataFrame:
    """item_id, rank, doc_id and score: the k best documents with a score above 0 of each row of items."""
    asked = item_terms(items, item_id, text)
    blocks = max(1, math.ceil((asked.agg(F.sum(F.size("terms"))).first()[0] or 0) / item_terms_bound))
    parts = []
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item_no"), F.lit(blocks)) == b).orderBy("item_no").collect()  # of bounded size
        vocabulary = {t: i for i, t in enumerate(sorted({bytes(t) for r in rows for t in r.terms}))}
        found = bags(docs, vocabulary, doc_id, text)
        n_docs, n_terms = found.agg(F.count("*"), F.sum("n")).first()
        df = np.zeros(len(vocabulary), np.int64)
        for r in found.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row a term of the block
            df[r["t"]] = r["count"]
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        code = np.fromiter((vocabulary[bytes(t)] for r in rows for t in r.terms), np.int64)
        item = np.repeat(np.arange(len(rows)), [len(r.terms) for r in rows]) if rows else np.zeros(0, np.int64)
        order, degrees = np.argsort(code, kind="stable"), np.bincount(code, minlength=len(vocabulary))
        times = np.fromiter((n for r in rows for n in r.times), np.int64)[order]
        block = (weight, np.cumsum(degrees) - degrees, degrees, (item[order], np.array([r.item_no for r in rows], np.int64), [r.item_id for r in rows]), times)
        parts.append(ranked(classes(found, n_docs, n_terms or 0, k), block, k))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = rows.select("item_no", "item_id", "score", F.explode("members").alias("doc_id"))
    rank = F.row_number().over(W.partitionBy("item_no").orderBy(F.desc("score"), "doc_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "score")


SQL = r"""
WITH words AS (SELECT row_number() OVER () AS no, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
asked AS (SELECT no, item_id, term, count(*) AS times FROM (SELECT row_number() OVER () AS no, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
lens AS (SELECT no, count(*) AS n FROM words GROUP BY no),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM lens),
bag AS (SELECT no, doc_id, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weight AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM bag, total GROUP BY term, docs),
part AS (SELECT bag.no, doc_id, bag.term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // words))) AS p FROM bag JOIN weight USING (term) JOIN lens USING (no), total),
score AS (SELECT a.no AS item_no, item_id, part.no, doc_id, sum(times * p)::BIGINT AS score FROM part JOIN asked AS a USING (term) GROUP BY ALL),
ranked AS (SELECT item_id, (row_number() OVER (PARTITION BY item_no ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM score WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 20
"""
