"""Op 8: language-model scoring with a hidden Markov model trained on the whole corpus.

Words are counted exactly. The model draws latent states by a Markov chain; a state emits a word class (short words
by themselves, longer ones by their ends, hashed to `CLASSES` numbers) and the class a word by its smoothed count.
Starting values come from the counts of each class 1, 2, 4 and 8 words before each of `GROUPS` groups of classes,
over all training documents: the parameters that make these pairs likely are found by expectation and maximization
on the driver. Then Baum-Welch counts are computed in each task over whole documents, summed across partitions, and give
the next parameters. A document's score is the exact likelihood of its tokens by the scaled forward recursion. All
training documents are in every count and in every pass; nothing is sampled.

What is broadcast or sent to the driver has a fixed size (CLASSES x STATES; CLASSES x GROUPS by distance for pairs). The vocabulary isn't broadcast: documents are packed with
the list of their distinct words, each pack deals its words to buckets by hash, and gets back the sums of the buckets.

Null texts are empty: they hold the end token alone. Repeated rows count and are scored once each. Texts are never
cut; a pack ends with the text that fills it. No rows yield no rows. Other columns than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

CLASSES, STATES, GROUPS, INIT_STEPS, PASSES = 8192, 8, 256, 60, 2
DISTANCES, CHUNK = (1, 2, 4, 8), 1 << 16
PACK = ["pack", "doc_ids", "held", "lens", "codes", "words", "hashes", "classes", "counts"]
PACK_CHARS, WAVE, PART_PACKS, BUCKET_WORDS = 6 << 20, 1 << 20, 8, 500_000


def word_classes(found: list[bytes]) -> np.ndarray:
    keys = [w if len(w) <= 4 else w[:2] + b" " + w[-3:] for w in found]
    return (pd.util.hash_array(np.array(keys, object), categorize=True) % np.uint64(CLASSES)).astype(np.int32) if keys else np.zeros(0, np.int32)


def coded(texts: list[str]) -> tuple[np.ndarray, np.ndarray, pa.StringArray]:
    """The tokens of all texts as numbers into the array of words, and their number per text. Each text's last token is the end, which is the empty word."""
    texts = pa.array([f"{t} " for t in texts], pa.string())  # the space yields an empty word at the end
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    counts, words = split.value_lengths().to_numpy().astype(np.int64), split.flatten().dictionary_encode()
    codes, ends = words.indices.to_numpy(), np.cumsum(counts)
    real = pc.not_equal(words.dictionary, "").to_numpy(zero_copy_only=False)[codes]
    real[ends - 1] = True  # other empty words stand before the first word
    before = np.concatenate([[0], np.cumsum(real)])
    return codes[real], before[ends] - before[ends - counts], words.dictionary


def packs(docs: DataFrame) -> DataFrame:
    """Rows of about PACK_CHARS characters of documents: their ids, lengths and word numbers, and the pack's distinct words with hashes, classes and training counts."""
    def pack(number: int, rows: list) -> pa.RecordBatch:
        ids, held, texts = (list(c) for c in zip(*rows, strict=True))
        codes, lens, found = coded(texts)
        counts = np.bincount(codes[~np.repeat(np.array(held, bool), lens)], minlength=len(found))
        words = found.to_numpy(zero_copy_only=False)
        hashes = (pd.util.hash_array(words, categorize=False) >> np.uint64(32)).astype(np.uint32)
        blobs = (lens.astype(np.int32), codes.astype(np.int32), hashes, word_classes(list(map(str.encode, words))))
        lens, codes, hashes, classes = (pa.array([x.tobytes()], pa.binary()) for x in blobs)
        lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), found, pa.array(counts, pa.int64()))]
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *lists[:2], lens, codes, lists[2], hashes, classes, lists[3]], names=PACK)

    def run(batches):
        number, rows, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "held", "text")), strict=True):
                rows.append(row)
                size += len(row[2])
                if size >= PACK_CHARS:
                    yield pack(number, rows)
                    number, rows, size = number + 1, [], 0
        if rows:
            yield pack(number, rows)

    schema = "pack long, doc_ids array<long>, held array<boolean>, lens binary, codes binary, words array<string>, hashes binary, classes binary, counts array<long>"
    return docs.select("doc_id", "held", "text").mapInArrow(run, schema)


def in_buckets(hashes: bytes, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of a pack's words by bucket, and how many are in each."""
    bucket = (np.frombuffer(hashes, np.uint32) % np.uint32(buckets)).astype(np.int64)
    return np.argsort(bucket, kind="stable"), np.bincount(bucket, minlength=buckets)


def word_counts(packed: DataFrame, buckets: int) -> DataFrame:
    """Each word's count in all training documents, given back to the packs that hold it, as a written table.

    Rows with `pack` hold the counts of its words in one bucket; the others, by class, the counts and the number of words.
    A pack gives each bucket that its words fall into one row, so words that all packs hold are no hot keys, and there
    are at most as many rows as the packs have distinct words, however many buckets there are.
    """

    def deal(batches):
        for batch in batches:
            for row, words, counts in zip(batch.select(["pack", "hashes"]).to_pylist(), batch.column("words"), batch.column("counts"), strict=True):
                order, sizes = in_buckets(row["hashes"], buckets)
                some = np.flatnonzero(sizes)
                ends = pa.array(np.concatenate([[0], np.cumsum(sizes[some])]), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, x.values.take(pa.array(order))) for x in (words, counts)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), row["pack"])), pa.array(some, pa.int32()), *lists], ["pack", "bucket", "words", "counts"])

    names = ["pack", "bucket", "known", "class", "c", "v"]

    def add(batches):
        rows = pa.Table.from_batches(batches, pa.schema([("pack", pa.int64()), ("bucket", pa.int32()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))]))
        words = pc.list_flatten(rows["words"]).combine_chunks()
        if not len(words):
            return
        if isinstance(words, pa.ChunkedArray):
            words = pa.concat_arrays(words.chunks)
        coded = words.dictionary_encode()
        at = coded.indices.to_numpy()
        sums = np.bincount(at, pc.list_flatten(rows["counts"]).to_numpy(), len(coded.dictionary)).astype(np.int64)
        ends = np.cumsum(pc.list_value_length(rows["words"]).to_numpy())
        known, begin = sums[at], np.concatenate([[0], ends[:-1]])
        none = lambda kind: pa.nulls(len(rows), kind)
        blobs = pa.array([known[i:j].tobytes() for i, j in zip(begin, ends, strict=True)], pa.binary())
        yield pa.RecordBatch.from_arrays([rows["pack"].combine_chunks(), rows["bucket"].combine_chunks(), blobs, none(pa.int32()), none(pa.int64()), none(pa.int64())], names)
        classes, seen = word_classes([w.encode() for w in coded.dictionary.to_pylist()]), sums > 0
        c, v = (np.bincount(classes[seen], w, CLASSES).astype(np.int64) for w in (sums[seen], None))
        some = np.flatnonzero(v)
        empty = [pa.nulls(len(some), kind) for kind in (pa.int64(), pa.int32(), pa.binary())]
        yield pa.RecordBatch.from_arrays([*empty, pa.array(some, pa.int32()), pa.array(c[some]), pa.array(v[some])], names)

    dealt = packed.select("pack", "hashes", "words", "counts").mapInArrow(deal, "pack long, bucket int, words array<string>, counts array<long>")
    return stage(dealt.repartition(buckets, "bucket").mapInArrow(add, "pack long, bucket int, known binary, class int, c long, v long"), "lm-counts")


class Hmm:
    """Parameters. ratio: a state's class probabilities over the corpus' own (`prior`, the classes' shares)."""

    def __init__(self, prior: np.ndarray, states: int = STATES):
        rng = np.random.default_rng(11)
        self.prior = prior
        self.start = np.full(states, 1 / states)
        self.move = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
        noise = rng.gamma(2.0, 0.5, (len(prior), states))
        self.ratio = noise / (prior @ noise)

    def update(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray, strength: float = 200.0) -> None:
        self.start = (start + 0.1) / (start + 0.1).sum()
        self.move = (move + 0.1) / (move + 0.1).sum(1, keepdims=True)
        emitted = emit + strength * self.prior[:, None]
        self.ratio = emitted / emitted.sum(0) / self.prior[:, None]

    def waves(self, classes: np.ndarray, lens: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Documents by falling length, up to WAVE tokens at once: their numbers, begins and lengths."""
        order, begins = np.argsort(-lens, kind="stable"), np.cumsum(lens) - lens
        group = np.cumsum(lens[order]) // WAVE
        for docs in np.split(order, np.flatnonzero(np.diff(group)) + 1):
            yield docs, begins[docs], lens[docs]

    def forward(self, classes: np.ndarray, begins: np.ndarray, lens: np.ndarray, keep: bool, before: np.ndarray | None = None):
        """log10 likelihood over that of the class shares, per document; with keep also the states and scales by token; the longest documents' last states.

        before: the documents' states at the token before, where they begin inside texts.
        """
        active = np.searchsorted(-lens, -np.arange(lens[0]), side="left")  # how many are longer than t
        state, total = np.tile(self.start, (len(lens), 1)) if before is None else before, np.zeros(len(lens))
        states, scales = (np.empty((len(classes), len(self.start))), np.ones(len(classes))) if keep else (None, None)
        for t, n in enumerate(active):
            at = begins[:n] + t
            state = (state[:n] @ self.move if t or before is not None else state[:n]) * self.ratio[classes[at]]
            scale = state.sum(1)
            state /= scale[:, None]
            total[:n] += np.log10(scale)
            if keep:
                states[at], scales[at] = state, scale
        return total, states, scales, active, state

    def expect(self, classes: np.ndarray, lens: np.ndarray, steps: int = WAVE):
        """Baum-Welch counts over whole documents: first states, moves, and classes by state.

        Documents of more than `steps` tokens are gone through in parts: forward once for the states at the cuts, then
        part by part from the end, so the states of one part are held at a time. The counts are the same.
        """
        start, move, emit = np.zeros(len(self.start)), np.zeros_like(self.move), np.zeros_like(self.ratio)
        for _, begins, ls in self.waves(classes, lens):
            parts = []
            for cut in range(0, ls[0], steps):
                n = np.searchsorted(-ls, -cut, side="left")  # how many are longer than cut
                parts.append((begins[:n] + cut, np.minimum(ls[:n] - cut, steps)))
            entering = [None]
            for part, after in pairwise(parts):
                entering.append(self.forward(classes, *part, keep=False, before=entering[-1])[-1][: len(after[0])])
            ahead = np.zeros((0, len(self.start)))
            for (b, n), before in zip(reversed(parts), reversed(entering), strict=True):
                local = np.cumsum(n) - n
                own = np.concatenate([classes[i : i + k] for i, k in zip(b, n, strict=True)])
                _, states, scales, active, _ = self.forward(own, local, n, keep=True, before=before)
                back = np.ones((len(n), len(self.start)))
                for t in range(len(active) - 1, -1, -1):
                    at = local[: active[t]] + t
                    move += states[at[: len(ahead)]].T @ ahead
                    back[: len(ahead)] = ahead @ self.move.T
                    states[at] *= back[: len(at)]
                    ahead = self.ratio[own[at]] * back[: len(at)] / scales[at][:, None]
                for s in range(len(self.start)):
                    emit[:, s] += np.bincount(own, states[:, s], len(emit))
            start += states[local].sum(0)
        return start, move * self.move, emit


def _sequences(row: dict) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row["classes"], np.int32)[np.frombuffer(row["codes"], np.int32)], np.frombuffer(row["lens"], np.int32).astype(np.int64)


def baum_welch_pass(packed: DataFrame, hmm: Hmm) -> None:
    """One pass over all training documents; the counts of all tasks are summed by Spark."""
    spark, states = packed.sparkSession, len(hmm.start)
    shared = spark.sparkContext.broadcast(hmm)
    names = [f"s{i}" for i in range(states)]

    def run(batches):
        model, sums, held_classes, held_lens = shared.value, None, [], []

        def add():
            nonlocal sums, held_classes, held_lens
            if held_lens and sum(map(len, held_classes)):
                part = model.expect(np.concatenate(held_classes), np.concatenate(held_lens))
                sums = part if sums is None else tuple(a + b for a, b in zip(sums, part, strict=True))
            held_classes, held_lens = [], []

        for batch in batches:
            for row in batch.to_pylist():
                classes, lens = _sequences(row)
                train = ~np.array(row["held"], bool)
                held_classes.append(classes[np.repeat(train, lens)])
                held_lens.append(lens[train])
                if sum(map(len, held_classes)) > 4 * WAVE:
                    add()
        add()
        if sums is not None:
            table = np.concatenate([sums[0][None], sums[1], sums[2]])
            yield pa.RecordBatch.from_pydict({"row": pa.array(np.arange(len(table)), pa.int64())} | {n: table[:, i] for i, n in enumerate(names)})

    schema = "row long, " + ", ".join(f"{n} double" for n in names)
    rows = packed.select("held", "lens", "codes", "classes").mapInArrow(run, schema).groupBy("row").agg(*(F.sum(n).alias(n) for n in names))
    got = rows.toPandas().sort_values("row")  # 1 + STATES + CLASSES rows
    if len(got):
        table = got[names].to_numpy()
        hmm.update(table[0], table[1 : 1 + states], table[1 + states :])


def neighbour_groups(prior: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """A group per class: the most frequent classes by themselves in three quarters of the groups, the others mixed in the rest."""
    own = groups * 3 // 4
    out = (own + np.arange(len(prior)) % (groups - own)).astype(np.int64)
    out[np.argsort(-prior, kind="stable")[:own]] = np.arange(own)
    return out


def pair_counts(packed: DataFrame, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Over all training documents: how often each class stands by distance before each group, and how often it begins a document."""
    shared, width = packed.sparkSession.sparkContext.broadcast(group), int(group.max()) + 1
    shape = (len(DISTANCES), len(group), width)
    begin, size = int(np.prod(shape)), int(np.prod(shape)) + len(group)

    def chunks(sums: dict) -> Iterator[pa.RecordBatch]:
        for key, dense in sums.items():
            at = np.flatnonzero(dense)
            least = np.min_scalar_type(dense.max())  # the narrowest unsigned type that holds them all
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([key], pa.int32()), "at": pa.array([at.astype(np.uint16).tobytes()], pa.binary()), "n": pa.array([dense[at].astype(least).tobytes()], pa.binary())})

    def cells(row) -> tuple[np.ndarray, np.ndarray]:
        at = np.frombuffer(row["at"], np.uint16).astype(np.int64)
        return at, np.frombuffer(row["n"], f"u{len(row['n']) // len(at)}").astype(np.int64)

    def count(batches):
        groups, sums = shared.value, np.zeros(size, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                classes, lens = _sequences(row)
                train = ~np.array(row["held"], bool)
                classes, lens = classes[np.repeat(train, lens)].astype(np.int64), lens[train]
                doc = np.repeat(np.arange(len(lens)), lens)
                for i, d in enumerate(DISTANCES):
                    at = np.flatnonzero(doc[:-d] == doc[d:])
                    sums[i * begin // shape[0] :][: begin // shape[0]] += np.bincount(classes[at] * width + groups[classes[at + d]], minlength=begin // shape[0])
                sums[begin:] += np.bincount(classes[np.cumsum(lens) - lens], minlength=len(groups))
        yield from chunks({a // CHUNK: sums[a : a + CHUNK] for a in range(0, size, CHUNK) if sums[a : a + CHUNK].any()})

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                dense = sums.setdefault(row["chunk"], np.zeros(CHUNK, np.int64))
                at, n = cells(row)
                dense[at] += n
        yield from chunks(sums)

    schema, total = "chunk int, at binary, n binary", np.zeros(size)
    rows = packed.select("held", "lens", "codes", "classes").mapInArrow(count, schema).repartition("chunk").mapInArrow(add, schema)
    for row in rows.toLocalIterator():  # at most size / CHUNK rows
        at, n = cells(row)
        total[row["chunk"] * CHUNK + at] = n
    return total[:begin].reshape(shape), total[begin:]


def starting_values(packed: DataFrame, hmm: Hmm) -> None:
    """The parameters that make the pairs of words of all training documents likely, to begin the full passes well."""
    group = neighbour_groups(hmm.prior)
    pairs, first = pair_counts(packed, group)
    member = np.zeros((pairs.shape[2], len(group)))
    member[group, np.arange(len(group))] = 1
    share = hmm.start.copy()  # of the states among the words of pairs
    for _ in range(INIT_STEPS if first.any() else 0):
        emit = hmm.prior[:, None] * hmm.ratio
        right, left = member @ emit, emit * share  # groups, and classes, by state
        powers = [np.linalg.matrix_power(hmm.move, d) for d in range(max(DISTANCES) + 1)]
        lefts, rights, moves = np.zeros_like(left), np.zeros_like(right), np.zeros_like(hmm.move)
        for d, counts in zip(DISTANCES, pairs, strict=True):
            ahead = powers[d] @ right.T
            odds = counts / np.maximum(left @ ahead, 1e-300)
            lefts += left * (odds @ ahead.T)
            from_left = left.T @ odds
            rights += right * (from_left.T @ powers[d])
            ends = from_left @ right
            for k in range(d):  # the move k steps after the left word
                moves += hmm.move * (powers[k].T @ ends @ powers[d - 1 - k].T)
        starts = emit * hmm.start
        starts *= (first / np.maximum(starts.sum(1), 1e-300))[:, None]
        share = (lefts.sum(0) + 0.1) / (lefts.sum(0) + 0.1).sum()
        hmm.update(starts.sum(0), moves, lefts + starts + emit * (rights / np.maximum(right, 1e-300))[group])


def score(docs: DataFrame, held, passes: int = PASSES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every row of docs (doc_id, text).

    held: a column; rows where it is true teach nothing.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), held.alias("held"), F.coalesce("text", F.lit("")).alias("text"))
    packed = stage(packs(docs), "lm-packs")
    default, size = int(spark.conf.get("spark.sql.shuffle.partitions")), packed.agg(F.count("*"), F.coalesce(F.sum(F.size("words")), F.lit(0))).first()
    buckets = max(default, -(-size[1] // BUCKET_WORDS))
    counts = word_counts(packed, buckets)
    shares, n, v = np.full(CLASSES, 0.5), 0, 0
    for row in counts.where("pack IS NULL").groupBy("class").agg(F.sum("c").alias("c"), F.sum("v").alias("v")).collect():  # at most CLASSES rows
        shares[row["class"]] += row["c"] + 0.5 * row["v"]
        n, v = n + row["c"], v + row["v"]
    z = n + 0.5 * (v + 1)
    hmm = Hmm(shares / shares.sum())
    starting_values(packed, hmm)
    for _ in range(passes):
        baum_welch_pass(packed, hmm)
    # a word's probability in its class is (c + 0.5) / the class' mass; the forward recursion gives the classes'
    log_base, log_total = float(np.log10(z)), float(np.log10(shares.sum()))
    shared = spark.sparkContext.broadcast(hmm)
    parts = max(default, -(-size[0] // PART_PACKS))
    known = counts.where("pack IS NOT NULL").select("pack", F.struct("bucket", "known").alias("b")).repartition(parts, "pack").groupBy("pack").agg(F.array_sort(F.collect_list("b"))["known"].alias("known"))
    rows = packed.select("pack", "doc_ids", "held", "lens", "codes", "classes", "hashes").repartition(parts, "pack").join(known, "pack")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def run(batches):
        model = shared.value
        for batch in batches:
            for row in batch.to_pylist():
                classes, lens = _sequences(row)
                order, _ = in_buckets(row["hashes"], buckets)
                of_word = np.empty(len(order), np.int64)
                of_word[order] = np.frombuffer(b"".join(row["known"]), np.int64)
                c = of_word[np.frombuffer(row["codes"], np.int32)]
                begins = np.cumsum(lens) - lens
                logs = np.add.reduceat(np.log10(c + 0.5), begins)
                gained = np.empty(len(lens))
                for docs_, b, ls in model.waves(classes, lens):
                    gained[docs_] = model.forward(classes, b, ls, keep=False)[0]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(row["doc_ids"], pa.int64()), "held_out": row["held"], "n_tokens": lens, "n_known": np.add.reduceat(c > 0, begins, dtype=np.int64),
                    "train_tokens": np.full(len(lens), n), "base_score": logs - lens * log_base, "score": logs - lens * log_total + gained,
                })

    return rows.mapInArrow(run, schema)
