"""The training-data operators on small fixtures: brute force, round trips, and odd inputs."""

import hashlib
import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from contrail.llm import byte_bpe, chat, fingerprint, hmm_lm, mixing, near_dedup, pieces, quality, queries, shingles, token_store, vafile, warc
from contrail.llm.common import join_hot, new_path

SF = "/root/testdata/sf0.001"
BASE = " ".join(f"word{i}" for i in range(60))
ODD = [
    (0, None, "s"), (1, "", None), (2, " \n\t ", "s"), (3, BASE, "s"), (4, BASE, "t"), (5, BASE.replace("word30", "other"), "t"), (6, BASE.upper(), "t"),
    (7, "one two", "u"), (8, "One  TWO", "u"), (9, "x" * 100_000 + " é的😀\x1c " + "long text " * 20_000, "u"), (10, "<|endoftext|> it's  3 apples", "s"), (10, "<|endoftext|> it's  3 apples", "s"), (None, "no id", None),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = spark.createDataFrame(ODD, "doc_id long, text string, source string")
    return rows.withColumns({"score": F.lit("clash"), "ids": F.lit(1), "label": F.lit(2), "part": F.lit(3), "size": F.lit(4)})


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


def _compare(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found, wanted = queries.QUERIES[name](spark, SF), con.sql(queries.ORACLES[name])
    columns = sorted(found.columns)
    assert columns == sorted(wanted.columns)
    key = lambda rows: sorted(map(repr, rows))
    assert key(tuple(r) for r in found.select(*columns).collect()) == key(wanted.select(*columns).fetchall())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    _compare(spark, name)


def test_token_store(spark, odd):
    path, vocabulary = new_path(spark, "t"), public_tokenizers.path("word_bpe_49k.json")
    token_store.write(odd, path, vocabulary)
    rows = token_store.read(spark, path).collect()
    plain = Tokenizer.from_file(vocabulary)
    wanted = sorted(((i, [*plain.encode(t or "", add_special_tokens=False).ids, 1]) for i, t, _ in ODD), key=lambda x: (x[0] is not None, x[0] or 0))
    got = sorted(((r.doc_id, r.start, r.ids, r.ids_crc32) for r in rows), key=lambda x: x[1])
    start = 0
    for (i, ids), (doc_id, at, found, crc) in zip(wanted, got, strict=True):
        assert (i, start, ids) == (doc_id, at, found)
        assert crc == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert token_store.lookup(spark, path, 7) == [[*plain.encode("one two", add_special_tokens=False).ids, 1]]


def _odd_texts(seed: int, n: int = 3000) -> list[str]:
    rng = np.random.default_rng(seed)
    parts = [*"aZé的😀 ..,,'\t\n\x0b\x1c\x85\xa0  ÀΣςİſK1२", "e\u0301", "H\u0331", "it's", "WE'LL", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "end", "###"]
    return ["".join(rng.choice(parts, rng.integers(0, 12))) for _ in range(n)]


def test_token_store_is_the_library_on_odd_texts():
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    library, texts = Tokenizer.from_file(vocabulary), _odd_texts(3)
    for text, ids in zip(texts, token_store.encode_texts(texts, vocabulary, 1), strict=True):
        assert ids.tolist() == [*library.encode(text, add_special_tokens=False).ids, 1], repr(text)


def test_tables_of_pieces_stay_small_and_right():
    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).model
    small, large = (pieces.PieceTable(model, lambda w: (w,), n, n) for n in (7, 10_000))
    for k in range(0, 300, 30):
        words = pa.array([f"w{i % 170}" for i in range(k, k + 40)])
        for a, b in zip(small.ids(words, np.full(4, 10)), large.ids(words, np.full(4, 10)), strict=True):
            assert a.tolist() == b.tolist()
        assert len(small.pieces.code) <= 47


def test_dictionary_is_alike_in_every_layout(spark):
    docs = spark.createDataFrame([(i % 500, f"text {i} " * (1 + i % 7 * 300)) for i in range(900)], "doc_id long, text string")
    made = [token_store.train_dictionary(docs.repartition(n), public_tokenizers.path("word_bpe_49k.json"), 1, 1 << 12, 100, 512) for n in (1, 7)]
    assert made[0] == made[1] != b""


def test_byte_bpe(spark, odd):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(path), special_tokens={})
    texts = odd.select("doc_id", "text", F.monotonically_increasing_id().alias("n"))
    for r in byte_bpe.decode(byte_bpe.encode(texts, path), path).collect():
        text = r.text or ""
        assert r.ids == reference.encode_ordinary(text)
        assert bytes(r.decoded).decode() == text
        assert not r.ends or (r.begins[0] == 0 and r.ends[-1] == len(text))
    digest = {r.doc_id: r for r in byte_bpe.digests(odd, path).collect()}
    assert digest[0].n_tokens == 0 and digest[0].ids_sha256 == hashlib.sha256(b"").hexdigest()
    for text in _odd_texts(4):
        ids, _ = byte_bpe._pieces(path).ids(pa.array(byte_bpe.PIECE.findall(text), pa.string()), np.array([len(byte_bpe.PIECE.findall(text))]))
        assert ids.tolist() == reference.encode_ordinary(text), repr(text)
    split = spark.createDataFrame([([reference.encode_ordinary("😀")[0]],)], "ids array<int>")
    assert byte_bpe.decode(split, path, text=True).first().decoded == "�"


def test_vafile_ties_nulls_and_repeats(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-4, 4, 6) / 64]) for i in range(200)] + [(3, [0.5] * 6), (500, None), (501, [float("nan")] * 6), (502, [None] * 6), (None, [0.25] * 6), (503, [1.0, 2.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = vafile.top_k(v, v.where("vec_id % 20 = 0"), k=5, cells=4).collect()
    good = [(i, [math.floor(64 * x) for x in e]) for i, e in rows if e and all(x is not None and math.isfinite(x) for x in e)]
    for q, e in [(i, e) for i, e in good if i is not None and i % 20 == 0]:
        wanted = sorted((-sum(a * b for a, b in zip(e, w, strict=True)), math.inf if i is None else i) for i, w in good if i != q and len(w) == len(e))[:5]
        assert [(-r.score, math.inf if r.vec_id is None else r.vec_id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == wanted


def test_vafile_ranks_each_query_row_and_reads_few_exact_vectors(spark):
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in rng.normal(size=24)], i, "x", 0.5) for i in range(3000)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>, no long, block string, score double")
    q = spark.createDataFrame([(20, rows[20][1]), (20, rows[40][1])], "vec_id long, embedding array<double>")
    got = vafile.top_k(v, q, k=3, cells=16).collect()
    exact = {i: np.floor(64 * np.array(e)).astype(int) for i, e, *_ in rows}
    wanted = [s for n in (20, 40) for s in sorted((-int(exact[n] @ w), i) for i, w in exact.items() if i != 20)[:3]]
    assert sorted((-r.score, r.vec_id) for r in got) == sorted(wanted)
    held, asked = vafile.integers(v, "vec_id", "embedding", 64.0), vafile.integers(q, "vec_id", "embedding", 64.0)
    near = vafile.candidates(vafile.va_file(held, 16), asked, 3)
    assert 6 <= near.count() < 0.1 * 2 * 3000  # of the pairs, so few exact vectors are read at most


def test_chat_collapse(spark):
    turns = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a"), (3, 0, "user", "a"), (3, 1, "assistant", "b"), (4, 0, "user", None), (5, 0, "user", ""), (None, 0, "user", "z")]
    rows = chat.format_conversations(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()
    assert sorted((r.conv_id or 0, r.n_turns) for r in rows) == [(0, 1), (1, 2), (4, 1), (5, 1)]
    assert next(r.rendered for r in rows if r.conv_id == 1) == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n"


def test_near_dedup(spark, odd):
    rows = {r.doc_id: r for r in near_dedup.dedup(odd).collect() if r.doc_id is not None}
    assert {i: r.component_id for i, r in rows.items()} == {0: 0, 1: 1, 2: 2, 3: 3, 4: 3, 5: 3 if 100 * 51 >= 85 * 61 else 5, 6: 3, 7: 7, 8: 7, 9: 9, 10: 10}
    assert rows[7].n_shingles == 1 and rows[0].n_shingles == 0 and rows[3].n_shingles == 56


def test_copies_in_two_steps(spark):
    """More copies than FAN_OUT, as many, and one."""
    fan = near_dedup.FAN_OUT
    rows = spark.createDataFrame([("a", 1), ("b", fan), ("c", fan + 1), ("d", 3 * fan + 5)], "node string, n int")
    found = sorted((r.node, r.other) for r in near_dedup.copied(rows, "n", ["node"]).collect())
    assert found == [(node, i) for node, n in (("a", 1), ("b", fan), ("c", fan + 1), ("d", 3 * fan + 5)) for i in range(n)]


def test_overlaps_of_huge_sets_are_whole_numbers():
    big = np.arange(1 << 18, dtype=np.uint64)
    found = near_dedup.overlaps([big, big[:7]], [big, big[5:9]])
    assert found.dtype == np.int64 and found.tolist() == [[1 << 18, 4], [7, 2]]


@pytest.mark.parametrize("small", [False, True])
def test_near_dedup_finds_links_between_copies_of_copies(spark, monkeypatch, small):
    """A chain in which only neighbours are alike, among many texts that share a long passage; also with blocks so small that each bucket takes many."""
    if small:
        monkeypatch.setattr(near_dedup, "BLOCK", 2)
        monkeypatch.setattr(near_dedup, "FAN_OUT", 3)
    words = [f"w{i}" for i in range(400)]
    chain = []
    for k in range(20):
        chain.append((k, " ".join(words)))
        words = words[:10 * k] + [f"c{k}-{j}" for j in range(8)] + words[10 * k + 8 :]
    noise = [(1000 + k, " ".join(f"w{i}" for i in range(200)) + " " + " ".join(f"n{k}-{i}" for i in range(200))) for k in range(60)]
    rows = {r.doc_id: r.component_id for r in near_dedup.dedup(spark.createDataFrame(chain + noise, "doc_id long, text string")).collect()}
    assert all(rows[k] == 0 for k in range(20)) and all(rows[1000 + k] == 1000 + k for k in range(60))


@pytest.mark.parametrize("percent", [80, 85])
def test_near_dedup_is_brute_force_on_a_whole_table(spark, percent):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    sets = {}
    for i, text in texts.items():
        words = text.encode().lower().split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    parent = {i: i for i in texts}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(i for i in texts if sets[i])
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            a, b = sets[i], sets[j]
            if 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)) and 100 * (n := len(a & b)) >= percent * (len(a) + len(b) - n):
                low, high = sorted((find(i), find(j)))
                parent[high] = low
    rows = near_dedup.dedup(docs, percent).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows} == {(i, len(sets[i]), find(i), find(i) == i) for i in texts}


def test_hot_keys_are_joined_like_others(spark):
    rows = spark.createDataFrame([(i, "hot" if i < 50 else None if i == 50 else f"k{i % 7}") for i in range(90)], "i long, key string")
    values = rows.groupBy("key").agg(F.max("i").alias("top"), F.count("*").alias("n")).where("key IS NOT NULL AND key <> 'k3'")
    found = join_hot(rows, values, "key", hot=10, most=1)
    plain = rows.join(values.drop("n"), "key", "left")
    assert sorted(map(repr, found.select("i", "key", "top").collect())) == sorted(map(repr, plain.select("i", "key", "top").collect()))


def test_quality_learns(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    scored = queries.QUERIES["op6_quality"](spark, "/root/testdata/sf0.01").join(labels, "doc_id").where("held_out").collect()
    assert scored and np.mean([r.predicted == r.quality for r in scored]) > 0.95
    assert docs.count() == queries.QUERIES["op6_quality"](spark, "/root/testdata/sf0.01").count()


def test_fingerprints(spark, odd):
    rows = fingerprint.with_next(odd).collect()
    assert len(rows) == len(ODD)
    ordered = sorted(ODD, key=lambda r: (r[0] is None, -(r[0] or 0), [-ord(c) for c in (r[1] or "")[:50]]))
    by_id = {r.doc_id: r for r in rows}
    for (i, text, _), (_, after, _) in zip(ordered, [*ordered[1:], ordered[0]], strict=True):
        text, after, half = text or "", after or "", len(text or "") // 2
        assert by_id[i].n_chars == len(text)
        if i != 10:
            assert by_id[i].edited_sha256 == hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()
    assert by_id[3].fingerprint == by_id[4].fingerprint == by_id[6].fingerprint != by_id[5].fingerprint
    assert by_id[5].near_next > 0.6 and by_id[3].near_next == 0.0


@pytest.mark.parametrize("ids", [[None] * 300, [7] * 300, [None] * 80 + [5] * 120 + [6] * 80 + list(range(20)), [4, 4, None]])
def test_fingerprints_with_hot_ids_follow_the_order(spark, ids):
    """Rows of one id, or of none, are many: each row still meets the next one, and no task takes them all."""
    rows = [(i, f"text {n} " + "é" * (n % 5)) for n, i in enumerate(ids)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (xxhash.xxh64_intdigest(r[1].encode(), 42) + 2**63) % 2**64), reverse=True)
    wanted = Counter()
    for (i, t), (_, after) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        half = len(t) // 2
        wanted[i, len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in fingerprint.with_next(docs).collect()) == wanted
    if len(ids) == 300:
        parts = fingerprint.ranges(docs.withColumn("hash", F.xxhash64("text")), 8).groupBy("part").count().collect()
        assert max(r["count"] for r in parts) < 80


def test_likeness_is_near_jaccard(spark):
    """Over all of sf0.01: fingerprints of each document and the next one against their exact shingle sets."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = [r.text or "" for r in docs.orderBy(F.desc("doc_id")).collect()]
    rows = fingerprint.with_next(docs).orderBy(F.desc("doc_id")).collect()
    sets = [set(h.tolist()) for h in shingles.shingles(texts)]
    off = []
    for i, r in enumerate(rows):
        a, b = sets[i], sets[(i + 1) % len(sets)]
        off.append(abs(r.near_next - (len(a & b) / len(a | b) if a or b else 1.0)))
        half = len(texts[i]) // 2
        c = set(shingles.shingles([texts[i][: len(texts[i]) - half] + texts[(i + 1) % len(texts)][:half]])[0].tolist())
        off.append(abs(r.near_edited - (len(a & c) / len(a | c) if a or c else 1.0)))
    assert max(off) < 0.1 and np.mean(off) < 0.02


def test_language_model(spark, odd):
    rows = hmm_lm.score(odd, F.coalesce(F.col("doc_id"), F.lit(0)) == 7, passes=1).collect()
    tokens = [((t or "").encode().lower().split() + [b""], i == 7) for i, t, _ in ODD]
    counts = Counter(w for doc, held in tokens if not held for w in doc)
    n, v = sum(counts.values()), len(counts)
    wanted = sorted(round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in doc), 6) for doc, _ in tokens)
    assert sorted(round(r.base_score, 6) for r in rows) == wanted
    assert all(r.train_tokens == n and math.isfinite(r.score) and r.score < 0 for r in rows)


def test_forward_is_exact():
    rng = np.random.default_rng(2)
    model = hmm_lm.Hmm(np.full(5, 0.2), states=3)
    classes, lens = rng.integers(0, 5, 9).astype(np.int32), np.array([5, 4])
    found, *_ = model.forward(classes, np.array([0, 5]), lens, keep=False)
    for at, n, value in ((0, 5, found[0]), (5, 4, found[1])):
        total = 0.0
        for path in np.ndindex(*[3] * n):
            p = model.start[path[0]] * model.ratio[classes[at], path[0]]
            for t in range(1, n):
                p *= model.move[path[t - 1], path[t]] * model.ratio[classes[at + t], path[t]]
            total += p
        assert math.isclose(math.log10(total), value)
    start, move, emit = model.expect(classes, lens)
    assert math.isclose(start.sum(), 2) and math.isclose(move.sum(), 7) and math.isclose(emit.sum(), 9)


@pytest.mark.parametrize("steps", [1, 2, 3, 4, 100])
def test_expected_counts_are_those_of_all_paths(steps):
    """Also where documents are gone through in parts that are shorter than they are."""
    rng = np.random.default_rng(4)
    model = hmm_lm.Hmm(np.full(5, 0.2), states=3)
    model.start, model.move = rng.dirichlet([1] * 3), rng.dirichlet([1] * 3, 3)
    lens = np.array([4, 1, 7, 2, 7, 3])
    classes = rng.integers(0, 5, lens.sum()).astype(np.int32)
    start, move, emit = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
    for at, n in zip(np.cumsum(lens) - lens, lens, strict=True):
        doc, paths = classes[at : at + n], list(np.ndindex(*[3] * n))
        odds = np.array([model.start[p[0]] * np.prod([model.ratio[c, s] for c, s in zip(doc, p, strict=True)]) * np.prod([model.move[a, b] for a, b in zip(p, p[1:])]) for p in paths])
        for path, odd in zip(paths, odds / odds.sum(), strict=True):
            start[path[0]] += odd
            np.add.at(move, (path[:-1], path[1:]), odd)
            np.add.at(emit, (doc, path), odd)
    found = model.expect(classes, lens, steps)
    assert all(np.allclose(a, b) for a, b in zip(found, (start, move, emit), strict=True))


def test_language_model_deals_no_empty_buckets(spark, odd):
    """As many rows as the packs have distinct words at most, and the same counts in one bucket or in thousands."""
    docs = odd.select("doc_id", F.lit(False).alias("held"), F.coalesce("text", F.lit("")).alias("text")).repartition(3)
    packed = hmm_lm.stage(hmm_lm.packs(docs), "test-packs")
    words = packed.agg(F.sum(F.size("words"))).first()[0]
    sums = []
    for buckets in (1, 5000):
        counts = hmm_lm.word_counts(packed, buckets)
        assert counts.where("pack IS NOT NULL").count() <= words
        sums.append(sorted(map(tuple, counts.where("pack IS NULL").groupBy("class").agg(F.sum("c"), F.sum("v")).collect())))
    assert sums[0] == sums[1]


def test_language_model_score_of_a_row_is_the_sum_over_all_paths(spark, monkeypatch):
    """A whole query row by brute force: words drawn from their classes by smoothed counts, classes from the states of the model."""
    models, begin = [], hmm_lm.starting_values
    monkeypatch.setattr(hmm_lm, "starting_values", lambda packed, model: models.append(model) or begin(packed, model))
    docs = spark.createDataFrame([(0, "a b a c"), (1, "b b C"), (2, "a unseen c"), (3, "")], "doc_id long, text string")
    rows = {r.doc_id: r for r in hmm_lm.score(docs, F.col("doc_id") == 2).collect()}
    counts, words = Counter(["a", "b", "a", "c", "", "b", "b", "c", "", ""]), ["a", "unseen", "c", ""]
    model, mass = models[0], np.full(hmm_lm.CLASSES, 0.5)
    for w, c in counts.items():
        mass[hmm_lm.word_classes([w.encode()])[0]] += c + 0.5
    classes = hmm_lm.word_classes([w.encode() for w in words])
    emit = model.ratio[classes] * (mass / mass.sum())[classes, None] * (np.array([counts[w] + 0.5 for w in words]) / mass[classes])[:, None]
    total = sum(model.start[p[0]] * np.prod([model.move[a, b] for a, b in zip(p, p[1:])]) * np.prod(emit[range(4), p]) for p in np.ndindex(*[hmm_lm.STATES] * 4))
    assert math.isclose(rows[2].score, math.log10(total)) and rows[2].held_out and (rows[2].n_tokens, rows[2].n_known) == (4, 3)


def test_mixing_comes_near_targets_with_null_and_repeated_ids(spark):
    """Within one document of each source's target, also where all ids are null or rows are equal; other columns stay."""
    texts = [" ".join(["w"] * (1 + i * 7 % 50)) for i in range(400)]
    for rows in ([(None, t, f"s{i % 4}") for i, t in enumerate(texts)], [(7, "a b c", f"s{i % 2}") for i in range(300)] + [(8, "d", None)]):
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"copies": F.lit("c"), "skey": F.lit(1), "h": F.lit(2), "below": F.lit(3), "row": F.lit(4)})
        found = mixing.mix(docs).groupBy("target", "source_size").agg(F.sum("taken").alias("taken")).collect()
        assert found and all(abs(r.taken - r.target) <= 50 for r in found)
        mixed = mixing.mixed_rows(docs)
        words = F.size(F.split("text", " "))
        assert mixed.columns == docs.columns
        assert mixed.agg(F.sum(words)).first()[0] == sum(r.taken for r in found)


def test_mixing_odd_rows(odd):
    rows = mixing.mix(odd).collect()
    assert len(rows) == len(ODD) and all(0 <= r.taken <= 3 * r.size for r in rows)


def test_warc_odd_pages(spark):
    big = "<p>\r\n\r\nWARC/1.1\r\n" + "é" * 1000
    pages = [(1, "http://a", big), (2, None, big), (2, None, big), (3, "x\ny", None), (4, "", "small"), (5, "", "small"), (None, "n", big)]
    path = new_path(spark, "w")
    warc.write(spark.createDataFrame(pages, "page_id long, url string, html string"), path)
    rows = warc.captures(warc.read_records(spark, path)).collect()
    got = sorted((r.metadata.page_id or 0, r.response.record_type, r.response.refers_to, r.response.payload_bytes) for r in rows)
    n = len(big.encode())
    assert got == [(0, "revisit", 2, n), (1, "revisit", 2, n), (2, "response", None, n), (2, "response", None, n), (3, "response", None, 0), (4, "response", None, 5), (5, "response", None, 5)]
    assert all(r.request is not None for r in rows)


def test_warc_reader_streams(spark):
    """Records above the unpacking step, several gzip streams a file, other columns, and truncated archives."""
    import gzip

    pages = spark.createDataFrame([(i, f"http://h/{i}", f"{i}" * 3_000_000) for i in range(3)], "page_id long, url string, html string").withColumns({"n": F.lit(1), "payload": F.lit("x"), "kept_n": F.lit(2)})
    path = new_path(spark, "w")
    warc.write(pages, path, file_bytes=1 << 20)
    rows = warc.captures(warc.read_records(spark, path)).collect()
    assert sorted((r.metadata.page_id, r.response.payload_bytes) for r in rows) == [(i, 3_000_000) for i in range(3)]
    assert all(r.response.payload_digest == hashlib.sha1(bytes(r.response.payload)).hexdigest() for r in rows)
    record = lambda n: f"WARC/1.1\r\nWARC-Type: x\r\nContent-Length: {n}\r\n\r\n".encode() + b"\r\n\r\n"[:n] + b"y" * (n - 4) + b"\r\n\r\n"
    data = b"".join(gzip.compress(record(n)) for n in (0, 3, 5_000_000))
    assert [len(b) for _, b in warc.parse(warc.unpacked(data))] == [0, 3, 5_000_000]
    for cut in (len(data) - 9, 30):
        with pytest.raises(ValueError):
            list(warc.parse(warc.unpacked(data[:cut])))


def test_empty_tables(spark, empty):
    assert near_dedup.dedup(empty).count() == 0
    assert fingerprint.with_next(empty).count() == 0
    assert mixing.mix(empty).count() == 0
    assert hmm_lm.score(empty, F.lit(False), passes=1).count() == 0
    assert byte_bpe.digests(empty, public_tokenizers.path("byte_bpe_50k.tiktoken")).count() == 0
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.score(empty, quality.fit(empty, none)).count() == 0
    path = new_path(spark, "t")
    token_store.write(empty, path, public_tokenizers.path("word_bpe_49k.json"))
    assert token_store.read(spark, path).count() == 0
    path = new_path(spark, "w")
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.captures(warc.read_records(spark, path)).count() == 0
    v = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vafile.top_k(v, v).count() == 0
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = corpus_pipeline.keep_good(spark, docs, "/root/testdata/sf0.01")
    assert kept.columns == docs.columns and 0.7 * docs.count() < kept.count() < docs.count()
    single = corpus_pipeline.drop_near_copies(spark, kept, "/root/testdata/sf0.01")
    assert single.columns == docs.columns and single.count() == near_dedup.dedup(kept).where("kept").count()
    mixed = corpus_pipeline.mix_sources(spark, single, "/root/testdata/sf0.01")
    copies = {r.doc_id: r.copies for r in mixing.mix(single).collect()}
    assert mixed.columns == docs.columns and mixed.count() == sum(copies.values())


def test_pipeline_drops_near_copies_from_four_fifths(spark):
    """Two texts of Jaccard 51/61, between the pipeline's 0.8 and op5_near_dedup's 0.85."""
    import corpus_pipeline

    docs = spark.createDataFrame([(1, BASE), (2, BASE.replace("word30", "other"))], "doc_id long, text string")
    assert near_dedup.dedup(docs).where("kept").count() == 2
    assert [r.doc_id for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, SF).collect()] == [1]


def test_bands_follow_the_similarity():
    assert near_dedup.bands_and_rows(85) == (30, 6)
    for percent in (50, 80, 85, 95, 100):
        bands, rows = near_dedup.bands_and_rows(percent)
        assert rows == 1 or (1 - min(percent / 100, 0.99) ** rows) ** bands <= 1e-6


def test_language_model_starts_from_long_documents(spark):
    """Two languages in texts of over 4,000 bytes each: without any full pass, both are told apart in every layout."""
    rng = np.random.default_rng(5)
    words = [[f"{a}{b}" for a in side for b in "xyz"] for side in ("abcdefgh", "stuvwpqr")]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(words[i % 2], 2000))) for i in range(60)], "doc_id long, text string")
    held = F.col("doc_id") % 5 == 1
    one, many = ({r.doc_id: r for r in hmm_lm.score(docs.repartition(n), held, passes=0).collect()} for n in (1, 6))
    assert all(r.score > r.base_score + 0.2 * r.n_tokens for r in one.values())
    assert all(math.isclose(r.score, many[i].score, rel_tol=1e-9) for i, r in one.items())


def test_pipeline_keeps_one_row_of_each_group(spark):
    """Null and repeated ids: rows count, not ids."""
    import corpus_pipeline

    far = " ".join(f"far{i}" for i in range(60))
    rows = [(None, BASE), (None, BASE + " end"), (None, ""), (None, far), (7, far), (8, "of its own"), (8, far + " end"), (None, "alone"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    single = [tuple(r) for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()]
    first = min(BASE, BASE + " end", key=lambda t: hashlib.md5(t.encode()).hexdigest())
    assert sorted(single, key=repr) == sorted([(None, first), (None, ""), (None, None), (7, far), (8, "of its own"), (None, "alone")], key=repr)


def test_quality_odd_rows_are_scored_by_a_plain_vote(spark):
    """Null, empty, very long and repeated texts, clashing columns: each row's score is that of a vote written out a document at a time."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    long = BASE * 4000
    texts = [None, "", " ", BASE, BASE, long, *[r.text for r in docs.orderBy("doc_id").limit(40).collect()]]
    odd = spark.createDataFrame([(i // 2 or None, t, -1.0, "kept", 7) for i, t in enumerate(texts)], "doc_id long, text string, score double, k string, predicted int")
    found = quality.score(odd, model)
    assert sorted(found.columns) == sorted(odd.columns)

    def vote(text):
        x = quality.weighted([text or ""])[0]
        if not x.any():
            return model.share
        y = (x * model.idf) @ model.basis
        sums = [0.0, 0.0]
        for near, label in zip(model.near, model.labels, strict=True):
            cosine = max(0.0, float(y @ near) / float(np.linalg.norm(y)))
            sums[int(label)] += cosine**quality.POWER * float(model.weight[model.labels == label][0])
        return sums[1] / sum(sums)

    rows = found.collect()
    assert len(rows) == len(texts) and {r.k for r in rows} == {"kept"}
    for r in rows:
        assert math.isclose(r.score, vote(r.text), abs_tol=2e-3) and r.predicted == (r.score >= 0.5)


def test_quality_takes_vectors_of_a_fixed_size_to_the_driver(spark):
    """The model of very long texts is that of weighing them here, and no text reaches the driver."""
    rows = [(i, ("good words " if i % 2 else "poor TEXT! ") * (20_000 + i)) for i in range(6)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(6)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    own = quality.Model(quality.weighted([t for _, t in rows]), np.array([i % 2 for i in range(6)]), 0.5)
    assert model.labels.tolist() == own.labels.tolist() and np.allclose(model.idf, own.idf) and np.allclose(model.near, own.near, atol=1e-5)


def test_quality_learns_from_all_labels_where_an_id_is_repeated(spark):
    docs = spark.createDataFrame([(0, f"poor text {i}") for i in range(40)] + [(i, f"good words {i}") for i in (1, 2)] + [(3, "poor text of its own")], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 0), (3, 0), (1, 1), (2, 1)], "doc_id long, quality int")
    model = quality.fit(docs, labels, per_label=2)
    assert model.labels.tolist() == [0, 1, 1, 0]


def test_language_model_reads_words_as_the_contract_does():
    texts = [*_odd_texts(8, 400), "", " ", "\x0b a", "a \x1fB\x85C É"]
    codes, lens, found = hmm_lm.coded(texts)
    found = found.to_pylist()
    own = [[*t.encode().lower().split(), b""] for t in texts]
    assert lens.tolist() == [len(w) for w in own] and [found[c].encode() for c in codes] == [w for doc in own for w in doc]
