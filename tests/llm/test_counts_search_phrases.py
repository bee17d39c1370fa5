"""Token counts, ranked search and collocations against brute force, with odd rows."""

import math
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from contrail.llm import collocations, quality, ranked_search, token_counts, vafile

BPE = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", None, " ", "\n\n \t", "a", "<|endoftext|>", "x  <|endoftext|> y<|endoftext|><|endoftext|>'s", "it's we'll DON'T 'tis", "é ß 中文字 😀 \x85 ​　x", "\x00\x1c", "." * 300, "the the the. The, the; the\tthe"]


@pytest.fixture(scope="module")
def long_text():
    rng = np.random.default_rng(5)
    return "".join(rng.choice(list("abcdefghij klmnop'.\nÄé中"), 60_000)) + "z" * 20_000 + "ab" * 5_000


def test_token_counts_are_the_librarys(spark, long_text):
    rng = np.random.default_rng(3)
    texts = [*ODD, long_text, "hello", "hello", *("".join(rng.choice([*"aeshtn '.,!0\n\té中", "ing", " the", "<|endoftext|>"], 30)) for _ in range(400))]
    docs = spark.createDataFrame([(i, t, "kept", 7) for i, t in enumerate(texts)], "doc_id long, text string, extra string, n_tokens int").repartition(3)
    got = {r.doc_id: r for r in token_counts.count(docs, BPE).collect()}
    library = Tokenizer.from_file(BPE)
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        want = len(library.encode(text or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit, got[i].extra) == (len((text or "").encode()), want, want > 512, "kept")


def test_token_counts_forget_what_is_beyond_the_bound(long_text):
    library, few = Tokenizer.from_file(BPE), token_counts.Counter(BPE, limit=50)
    for _ in range(2):
        assert few([long_text]).tolist() == [len(library.encode(long_text).ids)]
        assert few(["a b c", long_text, ""]).tolist() == [3, len(library.encode(long_text).ids), 0]


def test_merging_at_once_needs_ranks_in_order():
    letters = {c: i for i, c in enumerate(token_counts.byte_characters())}
    with pytest.raises(ValueError):
        token_counts.Merges(letters | {"abc": 256, "ab": 257}, [("ab", "c"), ("a", "b")])


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert token_counts.count(docs, BPE).count() == 0
    assert ranked_search.search(docs, items).count() == 0
    assert ranked_search.search(items.selectExpr("item_id AS doc_id", "text"), items.where("item_id < 0")).count() == 0
    assert collocations.mine(docs).count() == 0


def search_by_hand(docs, items, k):
    found = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    terms = lambda t: found.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    bags = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        rows = []
        for i, b in bags:
            m = 100 - 25 + 25 * sum(b.values()) * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 12 * m)) for t in terms(text) if b[t])
            if score:
                rows.append((-score, 2**63 if i is None else i, i))
        out += [(item, n + 1, i, -s) for n, (s, _, i) in enumerate(sorted(rows, key=lambda r: r[:2])[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("bound", [1 << 20, 10])
def test_search_is_brute_force(spark, long_text, bound):
    rng = np.random.default_rng(8)
    vocabulary = ["alpha", "beta", "Ünder", "x1", "no-one", "the", "of", "中文"]
    texts = [*ODD, long_text, *(" ".join(rng.choice(vocabulary, rng.integers(1, 9))) for _ in range(300)), *["the alpha beta"] * 70]
    docs = [(None if i % 41 == 0 else int(i % 250), t) for i, t in enumerate(texts)]  # ids repeat
    items = [(1, "ALPHA the the x1"), (2, "beta"), (2, "of Ünder, no-one"), (3, None), (4, ""), (5, "unseen"), (None, "中文 alpha"), (6, " ".join(vocabulary) * 3), (7, "the alpha beta")]
    rows = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, score int").repartition(5)
    got = ranked_search.search(rows, spark.createDataFrame(items, "item_id long, text string"), item_terms_bound=bound)
    assert sorted((tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()), key=str) == search_by_hand(docs, items, 20)


def test_classes_keep_the_smallest_ids(spark):
    docs = spark.range(5000).selectExpr("id AS doc_id", "'one two two' AS text").repartition(9)
    found = ranked_search.classes(ranked_search.bags(docs, {b"one": 0, b"two": 1}, "doc_id", "text"), 5000, 15000, 20).collect()
    assert [(r.terms, r.tfs, r.members) for r in found] == [([0, 1], [1, 2], list(range(20)))]


def phrases_by_hand(docs, least, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\f\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in often.items():
            score, _, l, r = min((2_000_000 * a // (counts[p[:c]] + counts[p[c:]]), c, counts[p[:c]], counts[p[c:]]) for c in range(1, len(p)))  # noqa: E741
            if not any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in often.items()):
                rows.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top])]  # noqa: E741
    return sorted(out)


@pytest.mark.parametrize("layout", [{}, {"shard": 7, "pack": 50, "most_bits": 16}])
def test_collocations_are_brute_force(spark, long_text, layout):
    rng = np.random.default_rng(2)
    words = ["Of", "the", "a", "a", "on", "é", "l'eau", "zz\x1c", "<x>"]
    texts = [*ODD, long_text, *("".join(w + rng.choice([" ", " ", " ", "\t", ". ", "\n", " , "]) for w in rng.choice(words, 40)) for _ in range(200)), *["same words each time here"] * 90]
    docs = [([None, "en", "und", "xx"][i % 4], t) for i, t in enumerate(texts)]
    rows = spark.createDataFrame([(la, t, 1) for la, t in docs], "lang string, text string, phrase int").repartition(4)
    got = collocations.mine(rows, top=60, least=5, **layout)
    assert sorted(map(tuple, got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())) == phrases_by_hand(docs, 5, 60)


def test_trie_counts_overlapping_phrases():
    rng = np.random.default_rng(4)
    words = rng.zipf(1.3, 3000) % 300
    phrases = sorted({tuple(words[i : i + k]) for k in range(1, 5) for i in range(0, 2990, 3)})
    matrix = np.array([[*p, -1, -1, -1][:4] for p in phrases])
    trie = collocations.Trie(matrix, 300)
    text = np.where(rng.random(20_000) < 0.02, -1, np.concatenate([words] * 7)[:20_000])
    want = Counter(tuple(text[i : i + k]) for k in range(1, 5) for i in range(len(text) - k + 1))
    assert trie.counts(text, 4).tolist() == [want[p] for p in phrases]
    slots = np.flatnonzero(trie.check >= 0)
    assert (trie.check[slots] < len(trie.base)).all()


def test_huge_components_rank_exactly(spark):
    rng = np.random.default_rng(6)
    vectors = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(120)]
    for i, value in ((3, 1e10), (20, -1e300), (40, 1.7e308), (41, 3e15), (60, 20_000.0), (77, -9.1e18)):
        vectors[i][1][i % 4] = value
    vectors += [(200, None), (201, [1.0, None, 2.0, 3.0]), (202, [1.0, math.inf, 2.0, 3.0]), (203, [1.0, 2.0])]
    rows = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(3)
    got = vafile.top_k(rows, rows.where("vec_id % 20 = 0"), k=5)
    good = {i: [math.floor(64 * Fraction(x)) if abs(x) > 1e6 else math.floor(64 * x) for x in v] for i, v in vectors if v and all(x is not None and math.isfinite(x) for x in v)}
    want = []
    for q in (i for i in good if i % 20 == 0):
        clip = lambda s: max(-(2**63), min(2**63 - 1, s))
        scores = sorted((-clip(sum(a * b for a, b in zip(good[q], v, strict=True))), i) for i, v in good.items() if i != q and len(v) == len(good[q]))
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:5])]
    assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == sorted(want)
    with pytest.raises(ValueError):
        vafile.top_k(rows, rows, cells=1024)


def test_only_labels_with_documents_are_sampled(spark):
    docs = spark.range(200).selectExpr("id AS doc_id", "concat('some words of ', id) AS text")
    labels = spark.range(10_000, 20_000).unionAll(spark.range(200)).selectExpr("id AS doc_id", "int(id % 2) AS quality")
    assert len(quality.fit(docs, labels, per_label=100).labels) == 200
