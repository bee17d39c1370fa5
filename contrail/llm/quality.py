"""Op 6: a quality classifier by nearest-neighbour voting in a latent-semantic space.

A document's terms are its words and, for every word, its shape (case, marks before and behind, length) and its line's
and text's shape, hashed to `TERMS` numbers. The latent space is a truncated singular value decomposition of the
weighted terms of at most `per_label` labelled rows a label (those of smallest hash), which are also the neighbours;
so what is broadcast has a fixed bound. Every document is then projected, its cosines with all neighbours computed in
blocks, and the neighbours vote with weights that rise with similarity. Each vote counts as much as its label is
frequent among all labelled rows, so the sample doesn't shift the score.

Null texts are empty; a text without terms gets the share of label 1; very long texts are scored whole; no rows yield no
rows. All labelled rows vote, by the POWER-th power of their cosine, so that near ones decide. Rows whose quality is null teach nothing;
a doc_id that is labelled twice teaches twice. Of several documents of one doc_id that of the least text teaches.
"""

from __future__ import annotations

import re
import zlib
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from .common import batches_of

TERMS, DIMS, PER_LABEL, POWER = 4096, 64, 1500, 24
_SHAPE = re.compile(rb"[A-Z]+|[a-z]+|[0-9]+|[\x80-\xff]+|[^A-Za-z0-9\x80-\xff]")
_KIND = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789" + bytes(range(128, 256)), b"A" * 26 + b"a" * 26 + b"0" * 10 + b"a" * 128)


def _shape(word: bytes) -> bytes:
    """The word with runs of letters and digits shortened to their kind, as in A, Aa, aa! or 0-0."""
    kinds = word.translate(_KIND)
    return re.sub(rb"(.)\1+", rb"\1\1", kinds)[:8]


class Terms:
    """Term numbers of words, held per worker up to a bound."""

    def __init__(self, limit: int = 100_000):
        self.limit, self.code = limit, {}

    def __call__(self, split: list[list[bytes]]) -> np.ndarray:
        """Two columns: the numbers of each word and of its shape."""
        flat = list(chain.from_iterable(split))
        new = set(flat).difference(self.code)
        if len(new) + len(self.code) > self.limit:
            self.code, new = {}, set(flat)
        if new:
            new = list(new)
            word = pd.util.hash_array(np.array(new, object), categorize=False) % np.uint64(TERMS // 2)
            shape = pd.util.hash_array(np.array([_shape(w) for w in new], object), categorize=True) % np.uint64(TERMS // 4)
            self.code.update(zip(new, (word.astype(np.int64) * TERMS + TERMS // 2 + shape.astype(np.int64)).tolist(), strict=True))
        codes = np.fromiter(map(self.code.__getitem__, flat), np.int64, len(flat))
        return np.stack([codes // TERMS, codes % TERMS], 1)


_TERMS = Terms()


def weighted(texts: list[str]) -> np.ndarray:
    """A row of log-weighted term counts per text, of unit length."""
    raw = [t.encode() for t in texts]
    split = [r.split() for r in raw]
    lens = np.array([len(w) for w in split], np.int64)
    out = np.zeros((len(texts), TERMS), np.float32)
    if lens.sum():
        numbers = _TERMS(split) + np.repeat(np.arange(len(texts)) * TERMS, lens)[:, None]
        out = np.bincount(numbers.ravel(), minlength=out.size).reshape(out.shape).astype(np.float32)
    for i, (r, words) in enumerate(zip(raw, split, strict=True)):
        if words:
            lines = r.split(b"\n")
            log = lambda x: int(2 * np.log2(1 + x))
            facts = (log(len(words)), log(len(lines)), int(20 * len(set(lines)) / len(lines)), int(20 * len(set(words)) / len(words)), log(len(r) / len(words)), int(20 * sum(map(bytes.isupper, words)) / len(words)), int(20 * sum(map(bytes.isalpha, words)) / len(words)))
            for kind, value in enumerate(facts):
                out[i, TERMS * 3 // 4 + (kind * 37 + value) % (TERMS // 4)] += 1 + len(words) / 50
    out = np.log1p(out)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


class Model:
    """The latent space and the labelled vectors in it: at most 2 * per_label rows of DIMS numbers."""

    def __init__(self, x: np.ndarray, labels: np.ndarray, share: float, dims: int = DIMS):
        """x: a row of `weighted` per label."""
        self.share, self.labels = share, labels.astype(np.float32)
        seen = (x > 0).sum(0)
        self.idf = np.log((1 + len(x)) / (1 + seen)).astype(np.float32) + 1
        x = x * self.idf
        rng = np.random.default_rng(7)
        basis = rng.standard_normal((TERMS, dims)).astype(np.float32)
        for _ in range(5):  # subspace iteration
            basis, _ = np.linalg.qr(x.T @ (x @ basis))
        self.basis = basis.astype(np.float32)
        self.near = self.unit(x @ self.basis)
        counts = np.array([max(1, (labels == v).sum()) for v in (0, 1)])
        self.weight = np.where(labels == 1, share / counts[1], (1 - share) / counts[0]).astype(np.float32)

    @staticmethod
    def unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def score(self, texts: list[str]) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(texts), self.share)
        x = weighted(texts)
        cosines = self.unit((x * self.idf) @ self.basis) @ self.near.T
        votes = np.maximum(cosines, 0) ** POWER * self.weight
        total = votes.sum(1)
        vote = np.where(total > 0, (votes @ self.labels) / np.maximum(total, 1e-30), self.share)
        return np.where(x.any(1), np.clip(vote, 0, 1), self.share).astype(np.float64)


@F.pandas_udf(BinaryType())
def _packed(texts: pd.Series) -> pd.Series:
    """The rows of `weighted`, compressed."""
    found = texts.tolist()
    return pd.Series([zlib.compress(row.tobytes(), 1) for a, b in batches_of(found, 1 << 20) for c in range(a, b, 512) for row in weighted(found[c : min(b, c + 512)])], dtype=object)


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Model:
    """Learns from the rows of labels (doc_id, quality) whose documents are in docs.

    The sample is a documented bound; the labels' shares are counted over all of labels. Executors weigh the sampled
    texts; the driver gets TERMS numbers a label, however long the texts are.
    """
    labels = labels.where(F.col("quality").isin(0, 1)).select("doc_id", "quality")
    counts = {r["quality"]: r["n"] for r in labels.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values())) if counts else 0.5
    present = labels.join(docs.select("doc_id"), "doc_id", "left_semi")  # only what can teach is sampled
    parts = [present.where(F.col("quality") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label) for v in (0, 1)]
    sample = parts[0].union(parts[1]).groupBy("doc_id", "quality").agg(F.count("*").alias("times"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    # one text a sampled label, as often as it is labelled: 2 * per_label rows at most
    one = rows.groupBy("doc_id", "quality", "times").agg(F.min("text").alias("text"))
    got = one.select("doc_id", "quality", "times", _packed("text").alias("x")).toPandas().sort_values(["doc_id", "quality"])
    times = got["times"].to_numpy(np.int64)
    x = np.frombuffer(b"".join(map(zlib.decompress, got["x"])), np.float32).reshape(-1, TERMS)
    return Model(np.repeat(x, times, axis=0), np.repeat(got["quality"].to_numpy(np.int64), times), share)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with `score` (0 to 1, higher: label 1 likelier) and `predicted`. Clashing columns are replaced."""
    kept = docs.select(*(c for c in docs.columns if c not in ("score", "predicted")), *([] if "text" in docs.columns else [F.lit("").alias("text")]))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        found = texts.fillna("").tolist()
        out = []
        for a, b in batches_of(found, 1 << 20):
            for c in range(a, b, 512):
                out.append(shared.value.score(found[c : min(b, c + 512)]))
        return pd.Series(np.concatenate(out) if out else [], dtype="float64")

    return kept.withColumn("score", of("text")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
