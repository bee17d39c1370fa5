"""Op 13: phrase collocation mining with double-array tries.

Texts become packs: all words of some documents of one language as numbers, with -1 between pieces. Phrases of one to
`LONGEST` words are then found level by level, by the Apriori rule that no part of a frequent phrase is rarer than it:
the phrases at positions whose two shorter parts can be frequent are hashed, each task sorts and counts its hashes, and their
counts are summed by ranges of hashes. A level's sieve has one bit a bucket, set where the hash of a frequent phrase falls, and rules
out all other phrases; it holds frequent phrases only, so rare ones don't fill it, however many there are. The distinct
phrases that no level rules out are the candidates. Tries over word numbers, double arrays, hold them: those that some packs
show, at most about `KNOWN`, are dealt to shards of a bounded number of phrases, whose tries are broadcast in turn; a task counts
all others with tries of its own, of the candidates in its next positions. Numpy moves the states of all positions of a pack one word
deeper at a time and bincounts the accepting ones; the sums over all tasks are the exact counts, since the trie compares
words, not hashes. Hashes tell phrases apart only while candidates are gathered.

What is broadcast are one bit a bucket (at most 2**MOST_BITS buckets), `KNOWN` hashes and tries of about `shard` phrases, so all
are bounded. The number of times that packs are read is bounded too: once a level, once for the others and once a shard.

A null text is empty, a null language is `und`; very long texts count whole, since packs are cut
between documents only. Repeated rows count each. No rows give no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stage

LEAST, LONGEST, CONTAINED = 30, 4, 80  # least count; words of the longest phrase; per cent of a phrase's count that a longer one has to have
SHARD, PACK, MOST_BITS = 1 << 19, 1 << 18, 27  # phrases of a trie, words of a pack, binary logarithm of the buckets
PART = 1 << 16  # buckets or phrases that are summed together
RUN = 1 << 22  # positions that a task counts together
HELD = 16  # packs of a file, since Spark's reader holds some thousands of a file's rows at once
SEEN, KNOWN = 20, 1_000_000  # binary logarithm of the phrases that a task remembers as given out; phrases that are counted in shared tries

#: Bytes of a piece's words, A-Z lower-cased; marks and line ends become a word of their own.
_BREAK = b"\n"
_TABLE = bytes(10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c < 91 else c for c in range(256))
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[bytes]:
    """The text's words, with `_BREAK` between its pieces."""
    return [w for w in text.encode().translate(_TABLE).replace(_BREAK, b" \n ").split(b" ") if w]


def packs(docs: DataFrame, lang: str = "lang", text: str = "text", size: int = PACK) -> DataFrame:
    """lang, words (the distinct ones), ids (the words' numbers in order, -1 between pieces) and n (how many words), of about `size` words each."""
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def pack(lang: str, words: list[bytes]) -> pa.RecordBatch:
        coded = pa.array(words, pa.binary()).dictionary_encode()
        names, ids = coded.dictionary, coded.indices.to_numpy().astype(np.int32)
        breaks = pc.index(names, pa.scalar(_BREAK, pa.binary())).as_py()
        if breaks >= 0:
            ids = np.where(ids == breaks, -1, ids - (ids > breaks)).astype(np.int32)
            names = pa.concat_arrays([names.slice(0, breaks), names.slice(breaks + 1)])
        lists = pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names.cast(pa.string()))
        return pa.RecordBatch.from_arrays([pa.array([lang]), lists, pa.array([ids.tobytes()], pa.binary()), pa.array([int((ids >= 0).sum())], pa.int64())], ["lang", "words", "ids", "n"])

    def run(batches) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        for batch in batches:
            for name, body in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = held.setdefault(name, [])
                own += words_of(body)
                own.append(_BREAK)
                if len(own) >= size:
                    yield pack(name, held.pop(name))
            while sum(map(len, held.values())) > 8 * size:  # of many languages
                most = max(held, key=lambda n: len(held[n]))
                yield pack(most, held.pop(most))
        for name, own in held.items():
            yield pack(name, own)

    return stage(rows.mapInArrow(run, "lang string, words array<string>, ids binary, n long"), "phrase-packs", rows=HELD)


class Positions:
    """A pack's positions: the hash of the phrase of k words that begins at each, level by level."""

    def __init__(self, lang: str, words: list[str], ids: bytes):
        self.lang, self.words, self.ids = lang, words, np.frombuffer(ids, np.int32)
        own = np.uint64(zlib.crc32(lang.encode()) * int(_PRIME) % 2**64)
        word = pd.util.hash_array(np.array(words, object), categorize=False) ^ own if words else np.zeros(0, np.uint64)
        self.at = np.flatnonzero(self.ids >= 0)
        self.word = np.zeros(len(self.ids), np.uint64)
        self.word[self.at] = word[self.ids[self.at]]
        self.k, self.hash = 1, self.word[self.at] * _PRIME

    def buckets(self, bits: int) -> np.ndarray:
        return (self.hash >> np.uint64(64 - bits)).astype(np.int64)

    def deeper(self, possible: np.ndarray) -> None:
        """To phrases of one word more, of positions whose own phrase and the next position's are possible."""
        ok = np.zeros(len(self.ids) + 1, bool)
        ok[self.at[possible]] = True
        both = possible & ok[self.at + 1]
        self.at, self.k = self.at[both], self.k + 1
        mixed = (self.hash[both] ^ (self.hash[both] >> np.uint64(29))) * _PRIME + self.word[self.at + self.k - 1]
        self.hash = (mixed ^ (mixed >> np.uint64(32))) * _PRIME


def _positions(batches) -> Iterator[Positions]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield Positions(batch.column("lang")[i].as_py(), batch.column("words")[i].as_py(), batch.column("ids")[i].as_py())


def sieved(found: DataFrame, sieves: list, bits: int, least: int) -> np.ndarray:
    """One bit a bucket: whether a phrase of len(sieves) + 1 words that falls into it occurs `least` times or more. sieves: the bits of fewer words."""
    shift, low_bits = np.uint64(48 - bits), np.uint64(32)  # a key: the bucket and 16 bits more, of which the last 32 are told apart within a part

    def summed(held: list[np.ndarray]) -> pa.RecordBatch:
        keys = np.sort(np.concatenate(held))
        begins = np.append(0, np.flatnonzero(keys[1:] != keys[:-1]) + 1)
        times = np.minimum(np.diff(begins, append=len(keys)), least).astype(np.uint8)  # more is as good as enough
        keys = keys[begins]
        parts = (keys >> low_bits).astype(np.int64)
        cuts = np.append(np.flatnonzero(np.diff(parts, prepend=-1)), len(keys))
        low = keys.astype(np.uint32)
        steps = np.diff(low, prepend=np.uint32(0))
        steps[cuts[:-1]] = low[cuts[:-1]]
        raw = [steps[i:j].view(np.uint8).reshape(-1, 4).T.tobytes() + times[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)]  # by bytes' places, which compress
        return pa.RecordBatch.from_arrays([pa.array(parts[cuts[:-1]]), pa.array(raw, pa.binary())], ["part", "counts"])

    def run(batches) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for p in _positions(batches):
            for sieve in sieves:
                p.deeper(_bit(sieve.value, p.buckets(bits)))
            held.append(p.hash >> shift)
            size += len(p.hash)
            if size >= RUN:
                yield summed(held)
                held, size = [], 0
        if size:
            yield summed(held)

    def often(held: list[bytes]) -> bytes:
        each = []
        for raw in held:
            n = len(raw) // 5
            steps = np.frombuffer(raw, np.uint8, 4 * n).reshape(4, n).T.copy().view(np.uint32).ravel()
            each.append((np.cumsum(steps, dtype=np.uint32).astype(np.uint64) << np.uint64(8)) | np.frombuffer(raw, np.uint8, n, 4 * n))
        keys = np.sort(np.concatenate(each))
        low = keys >> np.uint64(8)
        begins = np.append(0, np.flatnonzero(low[1:] != low[:-1]) + 1)
        enough = np.add.reduceat(keys & np.uint64(255), begins) >= least
        own = np.zeros(PART, bool)
        own[(low[begins[enough]] >> np.uint64(16)).astype(np.int64)] = True
        return np.packbits(own).tobytes()

    def add(batches) -> Iterator[pa.RecordBatch]:  # sorted by part, of which one is held at a time
        part, held = -1, []
        give = lambda: pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([often(held)], pa.binary())], ["part", "bits"])
        for batch in batches:
            for at, raw in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                if at != part and held:
                    yield give()
                    held = []
                part = at
                held.append(raw)
        if held:
            yield give()

    dealt = found.mapInArrow(run, "part long, counts binary").repartition("part").sortWithinPartitions("part")
    out = np.zeros((1 << bits) // 8, np.uint8)
    for row in dealt.mapInArrow(add, "part long, bits binary").collect():  # a bit a bucket
        own = np.frombuffer(row["bits"], np.uint8)
        out[row["part"] * len(own) : (row["part"] + 1) * len(own)] = own
    return out


def _bit(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).astype(bool)


def frequent(found: DataFrame, longest: int, least: int, shard: int, most_bits: int) -> DataFrame:
    """lang, k, phrase and f, the exact count, of all phrases that occur `least` times or more, from written tables."""
    if least > 127:  # counts of a run of positions are kept as bytes
        raise ValueError("least is at most 127")
    sc = found.sparkSession.sparkContext
    n_words = found.agg(F.sum("n")).first()[0] or 0
    bits = min(most_bits, max(16, math.ceil(math.log2(n_words / 8 + 1))))
    sieves = []
    for _ in range(longest):
        sieves.append(sc.broadcast(sieved(found, sieves, bits, least)))

    def new(p: Positions, seen: np.ndarray, skipped: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        """A pack's phrases that no sieve rules out, each about once, without those seen and skipped."""
        names = pa.array(p.words, pa.string())
        for k in range(1, longest + 1):
            possible = _bit(sieves[k - 1].value, p.buckets(bits))
            at, hashes = p.at[possible], p.hash[possible]
            slots = (hashes >> np.uint64(64 - SEEN)).astype(np.int64)
            fresh = np.flatnonzero(seen[slots] != hashes)
            fresh = fresh[np.unique(hashes[fresh], return_index=True)[1]]
            if skipped is not None and len(skipped):
                fresh = fresh[skipped[np.minimum(np.searchsorted(skipped, hashes[fresh]), len(skipped) - 1)] != hashes[fresh]]
            seen[slots[fresh]] = hashes[fresh]
            if len(fresh):
                at = at[fresh]
                columns = [names.take(pa.array(p.ids[at + j])) for j in range(k)]
                lists = [pa.array([p.lang] * len(at), pa.string()), pa.array([k] * len(at), pa.int32()), pc.binary_join_element_wise(*columns, " "), pa.array(hashes[fresh].view(np.int64))]
                yield pa.RecordBatch.from_arrays(lists, ["lang", "k", "phrase", "hash"])
            if k < longest:
                p.deeper(possible)

    def given(batches) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << SEEN, np.uint64)  # phrases that are out already, by their hash's first bits
        for p in _positions(batches):
            yield from new(p, seen, None)

    # the phrases of some packs first: most tasks meet them, so they are counted in tries that all share
    some = found.where(F.pmod(F.xxhash64("ids"), F.lit(max(8, n_words >> 24))) == 0).mapInArrow(given, "lang string, k int, phrase string, hash long").distinct()
    some = stage(some.withColumn("no", F.monotonically_increasing_id()), "phrase-some")
    many = some.count()
    shared = some.where(F.col("hash") < F.lit(int(2**64 * KNOWN / many) - 2**63)) if many > KNOWN else some  # hashes are spread evenly
    known = sc.broadcast(np.sort(shared.select("hash").toArrow()["hash"].to_numpy().view(np.uint64)))

    def others(batches) -> Iterator[pa.RecordBatch]:
        skipped = known.value
        first = np.zeros(1 << SEEN, np.uint64)
        first[(skipped >> np.uint64(64 - SEEN)).astype(np.int64)] = skipped
        seen, held, rows, size = first.copy(), [], [], 0

        def counts() -> pa.RecordBatch:
            own = pa.Table.from_batches(rows).select(["lang", "k", "phrase"])
            trie, named = built(own, longest)
            total = sum(occurrences(trie, named, *h, longest) for h in held)
            often = np.flatnonzero(total)  # a phrase that was given twice has its count once
            return own.take(pa.array(often)).append_column("f", pa.array(total[often])).combine_chunks()

        for p in _positions(batches):
            held.append((p.lang, pa.array(p.words, pa.string()), p.ids))
            rows += new(p, seen, skipped)
            size += len(p.ids)
            if size >= RUN or sum(map(len, rows)) >= shard:
                if rows:
                    yield from counts().to_batches()
                seen, held, rows, size = first.copy(), [], [], 0
        if rows:
            yield from counts().to_batches()

    kind = "lang string, k int, phrase string, f long"
    rest = found.mapInArrow(others, kind).groupBy("lang", "k", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    rest = stage(rest, "phrase-rest")
    for b in (*sieves, known):  # the driver and each executor hold it as a file
        b.destroy()
    return rest.unionByName(counted(found, shared, longest, least, shard))


class Trie:
    """Phrases of word numbers as a double array: the child of state s by word w is base[s] + w, if check[base[s] + w] is s."""

    def __init__(self, phrases: np.ndarray, words: int):
        """phrases: a row each of word numbers, filled up with -1."""
        n, longest = phrases.shape
        self.phrases = n
        node, depth_of = np.zeros(n, np.int64), (phrases >= 0).sum(1)
        parents, symbols, ends, made = [], [], np.zeros(n, np.int64), 1
        for depth in range(longest):
            on = np.flatnonzero(depth_of > depth)
            keys, which = np.unique(node[on] * words + phrases[on, depth], return_inverse=True)
            parents.append(keys // words)
            symbols.append(keys % words)
            node[on] = made + which
            ends[on] = node[on]
            made += len(keys)
        parent, symbol = np.concatenate(parents), np.concatenate(symbols)  # of node i + 1; nodes of one parent are together
        base, slot = self.placed(parent, symbol, words, made)
        size = int(slot.max(initial=0)) + 1
        self.base, self.check, self.accepts = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        self.base[slot] = base
        self.check[slot[1:]] = slot[parent]
        self.accepts[slot[ends]] = np.arange(n)

    @staticmethod
    def placed(parent: np.ndarray, symbol: np.ndarray, words: int, nodes: int) -> tuple[np.ndarray, np.ndarray]:
        """Each node's base and slot. The root's children come first, then families by falling size, each where it fits at random."""
        rng = np.random.default_rng(3)
        base, slot = np.zeros(nodes, np.int64), np.zeros(nodes, np.int64)
        begins = np.flatnonzero(np.diff(parent, prepend=-1))
        sizes, owners = np.diff(begins, append=len(parent)), parent[begins]
        used = np.zeros(words + 2 + 4 * nodes, bool)
        used[: words + 1] = True  # the root's own: slot 1 + word
        base[0] = 1
        family = np.flatnonzero(owners == 0)
        for f in family:
            slot[begins[f] + 1 : begins[f] + 1 + sizes[f]] = 1 + symbol[begins[f] : begins[f] + sizes[f]]
        left = np.flatnonzero(owners != 0)
        left = left[np.argsort(-sizes[left], kind="stable")]
        large = left[sizes[left] >= 24]
        for f in large:  # one by one; in new slots where no try fits
            own = symbol[begins[f] : begins[f] + sizes[f]]
            tries = rng.integers(words + 1, len(used) - (own[-1] - own[0]), 64) - own[0] if len(used) - (own[-1] - own[0]) > words + 1 else np.zeros(0, np.int64)
            fits = tries[~used[tries[:, None] + own].any(1)]
            if not len(fits):
                fits = np.array([len(used) - own[0]])
                used = np.concatenate([used, np.zeros(own[-1] - own[0] + 1, bool)])
            base[owners[f]] = fits[0]
            slot[begins[f] + 1 : begins[f] + 1 + sizes[f]] = fits[0] + own
            used[fits[0] + own] = True
        left, rounds = left[len(large) :], 0
        while len(left):  # all at once: whoever finds all slots free and meets no one in them stays
            own = np.repeat(np.arange(len(left)), sizes[left])
            at = np.repeat(begins[left] - (np.cumsum(sizes[left]) - sizes[left]), sizes[left]) + np.arange(len(own))
            start = rng.integers(words + 1, len(used), len(left)) - symbol[begins[left]]
            want = start[own] + symbol[at]
            inside = want < len(used)
            first = np.zeros(len(own), bool)
            first[np.unique(want, return_index=True)[1]] = True
            bad = np.bincount(own, ~(inside & first & ~used[np.where(inside, want, 0)]), minlength=len(left)) > 0
            base[owners[left[~bad]]] = start[~bad]
            good = ~bad[own]
            slot[at[good] + 1] = want[good]
            used[want[good]] = True
            left, rounds = left[bad], rounds + 1
            if rounds % 64 == 0:
                used = np.concatenate([used, np.zeros(len(used), bool)])
        return base, slot

    def counts(self, symbols: np.ndarray, longest: int) -> np.ndarray:
        """How often each phrase occurs in a row of word numbers, in which -1 stands for words of no phrase and for borders."""
        n = self.phrases
        total = np.zeros(n + 1, np.int64)
        at, state = np.arange(len(symbols)), np.zeros(len(symbols), np.int64)
        for depth in range(longest):
            keep = at + depth < len(symbols)
            at, state = at[keep], state[keep]
            symbol = symbols[at + depth]
            to = np.where(symbol >= 0, self.base[state] + symbol, 0)
            to[(to < 0) | (to >= len(self.check))] = 0
            ok = (to > 0) & (self.check[to] == state)
            at, state = at[ok], to[ok]
            total += np.bincount(self.accepts[state] + 1, minlength=n + 1)
        return total[1:]


def built(rows: pa.Table, longest: int) -> tuple[Trie, dict]:
    """The trie of phrases (lang, phrase), and each language's words and their numbers. Words of many phrases get small numbers."""
    langs, split = rows["lang"].combine_chunks().dictionary_encode(), pc.split_pattern(rows["phrase"].combine_chunks(), " ")
    lens, flat = split.value_lengths().to_numpy(), split.flatten()
    lang = np.repeat(langs.indices.to_numpy(), lens)
    number, names, made = np.zeros(len(flat), np.int64), [], 0
    for i in range(len(langs.dictionary)):
        own = np.flatnonzero(lang == i)
        coded = flat.take(pa.array(own)).dictionary_encode()
        number[own] = made + coded.indices.to_numpy()
        names.append(coded.dictionary)
        made += len(coded.dictionary)
    place = np.empty(made, np.int64)
    place[np.argsort(-np.bincount(number, minlength=made), kind="stable")] = np.arange(made)
    matrix = np.full((len(rows), longest), -1, np.int64)
    row = np.repeat(np.arange(len(rows)), lens)
    matrix[row, np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)] = place[number]
    ends = np.cumsum([len(n) for n in names])
    named = {la: (own, place[end - len(own) : end].astype(np.int32)) for la, own, end in zip(langs.dictionary.to_pylist(), names, ends, strict=True)}
    return Trie(matrix, max(1, made)), named


def occurrences(trie: Trie, named: dict, lang: str, words: pa.Array, ids: np.ndarray, longest: int) -> np.ndarray:
    """How often each of a trie's phrases occurs in a pack."""
    if lang not in named:
        return np.zeros(trie.phrases, np.int64)
    names, symbols = named[lang]
    own = pc.fill_null(pc.index_in(words, value_set=names), -1).to_numpy()
    number = np.append(np.where(own >= 0, symbols[own], -1), -1)  # the last stands for id -1
    return trie.counts(number[ids], longest)


def counted(found: DataFrame, phrases: DataFrame, longest: int, least: int, shard: int) -> DataFrame:
    """lang, k, phrase and f, the exact count, of the candidates that are frequent, as a written table."""
    sc = found.sparkSession.sparkContext
    shards = max(1, math.ceil(phrases.count() / shard))
    parts = []
    for s in range(shards):
        rows = phrases.where(F.pmod(F.xxhash64("lang", "phrase"), F.lit(shards)) == s).select("no", "lang", "phrase").toArrow()  # about `shard` of them
        if not len(rows):
            continue
        held = sc.broadcast(built(rows, longest))

        def run(batches, held=held) -> Iterator[pa.RecordBatch]:
            trie, named = held.value
            total = np.zeros(trie.phrases, np.int64)
            for batch in batches:
                for i in range(batch.num_rows):
                    total += occurrences(trie, named, batch.column("lang")[i].as_py(), batch.column("words")[i].values, np.frombuffer(batch.column("ids")[i].as_py(), np.int32), longest)
            for part in range(0, len(total), PART):
                own = total[part : part + PART]
                if own.any():
                    raw = zlib.compress(np.packbits(own > 0).tobytes() + own[own > 0].tobytes(), 1)
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([raw], pa.binary())], ["part", "counts"])

        numbers = sc.broadcast(rows["no"].to_numpy())

        def add(batches, numbers=numbers) -> Iterator[pa.RecordBatch]:
            totals: dict[int, np.ndarray] = {}
            for batch in batches:
                for part, raw in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                    size = min(PART, len(numbers.value) - part)
                    raw = np.frombuffer(zlib.decompress(raw), np.uint8)
                    where = np.flatnonzero(np.unpackbits(raw[: -(-size // 8)], count=size))
                    totals.setdefault(part, np.zeros(size, np.int64))[where] += np.frombuffer(raw[-(-size // 8) :].tobytes(), np.int64)
            for part, total in totals.items():
                often = np.flatnonzero(total >= least)
                yield pa.RecordBatch.from_arrays([pa.array(numbers.value[part + often]), pa.array(total[often])], ["no", "f"])

        parts.append(stage(found.select("lang", "words", "ids").mapInArrow(run, "part long, counts binary").repartition("part").mapInArrow(add, "no long, f long"), "phrase-shard"))
        for b in (held, numbers):  # the driver and each executor hold a trie as a file: one shard's at a time
            b.destroy()
    if not parts:
        return stage(phrases.select("lang", "k", "phrase", F.lit(0).cast("long").alias("f")), "phrase-counts")
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return stage(phrases.join(rows, "no").select("lang", "k", "phrase", "f"), "phrase-counts")


def scored(frequent: DataFrame) -> DataFrame:
    """lang, phrase, k, a, l, r and score of phrases of two words or more, by the cut that scores lowest."""
    cuts = frequent.where("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    words = F.split("phrase", " ")
    cuts = cuts.withColumns({"head": F.array_join(F.slice(words, F.lit(1), F.col("cut")), " "), "tail": F.array_join(F.slice(words, F.col("cut") + 1, F.col("k") - F.col("cut")), " ")})
    cuts = cuts.join(frequent.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"]).join(frequent.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    score = F.expr("(CAST(2000000 AS DECIMAL(18,0)) * CAST(a AS DECIMAL(19,0))) div CAST(l + r AS DECIMAL(20,0))")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "k", "a", "l", "r")).alias("best"))
    return best.select("lang", "phrase", "best.k", "best.a", "best.l", "best.r", "best.score")


def uncontained(found: DataFrame, longest: int, contained: int) -> DataFrame:
    """found without phrases inside a longer one that has at least `contained` per cent of their count."""
    words, cuts = F.split("phrase", " "), [(i, k) for k in range(2, longest) for i in range(longest - k + 1)]
    inner = F.filter(F.array(*(F.when(F.col("k") >= i + k, F.when(F.col("k") > k, F.array_join(F.slice(words, i + 1, k), " "))) for i, k in cuts)), lambda x: x.isNotNull()) if cuts else F.array().cast("array<string>")
    within = found.where("k > 2").select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    return found.join(within, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * contained)).drop("longer")


def mine(docs: DataFrame, top: int = 2000, least: int = LEAST, longest: int = LONGEST, contained: int = CONTAINED, shard: int = SHARD, pack: int = PACK, most_bits: int = MOST_BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's `top` collocations."""
    found = packs(docs, size=pack)
    often = frequent(found, longest, least, shard, most_bits)
    sizes = found.groupBy("lang").agg(F.sum("n").alias("n"))
    kept = uncontained(scored(often), longest, contained)
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    first = kept.withColumn("rank", rank).where(F.col("rank") <= top)
    return first.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH piece AS (SELECT row_number() OVER () AS no, lang, words FROM (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')), '[^ 	]+') AS words FROM documents)),
place AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM piece),
gram AS (SELECT lang, array_to_string(words[i : i + k - 1], ' ') AS phrase, k FROM place, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE i + k - 1 <= len(words)),
f AS (SELECT lang, phrase, k, count(*) AS f FROM gram GROUP BY ALL HAVING count(*) >= 30),
size AS (SELECT lang, count(*) AS n FROM gram WHERE k = 1 GROUP BY lang),
split AS (SELECT lang, phrase, k, f, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS cut FROM f WHERE k > 1),
cuts AS (SELECT s.lang, s.phrase, s.k, s.f AS a, cut, h.f AS l, t.f AS r, ((2000000::HUGEINT * s.f) // (h.f + t.f))::BIGINT AS score
  FROM split AS s JOIN f AS h ON h.lang = s.lang AND h.phrase = array_to_string(w[1 : cut], ' ') JOIN f AS t ON t.lang = s.lang AND t.phrase = array_to_string(w[cut + 1 :], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
within AS (SELECT lang, array_to_string(w[i : i + m - 1], ' ') AS phrase, max(a) AS longer FROM (SELECT lang, string_split(phrase, ' ') AS w, k, a, m, unnest(range(1, k - m + 2)) AS i FROM best, (SELECT unnest([2, 3]) AS m) WHERE m < k) GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN within USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * a)
SELECT lang, (row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)))::INT AS rank, phrase, a, l, r, n, score FROM kept JOIN size USING (lang)
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) <= 2000
"""
