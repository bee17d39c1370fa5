"""Op 11: token counts of byte-level BPE without the tokens, by rank-synchronous merging of arrays.

Texts are cut into pieces at white space and pieces into pre-tokens. All distinct pre-tokens of a batch lie one after
the other in one array of symbols. In every round each pre-token's lowest-ranked pair is found, all its occurrences are
merged at once (of overlapping ones every second, from the left), and only the pairs beside a merge are ranked again.
A pre-token without a known pair is done, and the symbols it has left are its tokens.

Merging all occurrences at once is what the library does one by one, since no pair with the new symbol ranks lower; a
vocabulary without that property is refused. The strings of added tokens count as one token each and end the pre-token
before them, as by the library's default.

A null text is empty: no bytes, no tokens. Very long texts are counted whole, so many pieces at a time. Repeated rows are
counted each, no rows yield no rows. Columns named n_bytes, n_tokens or over_limit are replaced, others but text are carried.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .byte_bpe import PIECE
from .common import batches_of
from .pieces import byte_characters, plain, sums, unmapped

MADE = ("n_bytes", "n_tokens", "over_limit")
NONE = np.iinfo(np.int32).max  # the rank of a pair that isn't merged


class Merges:
    """The vocabulary's merges as sorted arrays: for a pair of symbols its rank and the symbol it becomes."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]]):
        self.size = max(vocabulary.values()) + 1
        self.symbol = np.array([vocabulary[c] for c in byte_characters()], np.int64)
        pairs = np.array([(vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in merges], np.int64).reshape(-1, 3)
        self.made = pairs[:, 2]
        made_at = np.full(self.size, -1, np.int64)
        made_at[self.made[::-1]] = np.arange(len(pairs))[::-1]  # a symbol's first merge
        if (np.maximum(made_at[pairs[:, 0]], made_at[pairs[:, 1]]) >= np.arange(len(pairs))).any():
            raise ValueError("a merge ranks lower than one that makes its parts")
        keys = pairs[:, 0] * self.size + pairs[:, 1]
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = np.append(keys[order], -1), np.append(order, NONE).astype(np.int32)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left * self.size + right
        at = np.searchsorted(self.keys[:-1], keys)
        return np.where(self.keys[at] == keys, self.ranks[at], NONE)

    def counts(self, parts: list[bytes]) -> np.ndarray:
        """The number of symbols left of each part (none is empty) when no pair can be merged."""
        lens = np.fromiter(map(len, parts), np.int64, len(parts))
        sym = self.symbol[np.frombuffer(b"".join(parts), np.uint8)]
        out, own = lens.copy(), np.arange(len(parts))  # own: which part each sequence is
        ranks = np.full(len(sym), NONE, np.int32)
        ranks[:-1] = self.rank(sym[:-1], sym[1:])
        ranks[np.cumsum(lens) - 1] = NONE
        while len(own):
            lowest = np.minimum.reduceat(ranks, np.cumsum(lens) - lens)
            going = lowest < NONE
            out[own[~going]] = lens[~going]
            if not going.all():
                held = np.repeat(going, lens)
                sym, ranks, own, lens, lowest = sym[held], ranks[held], own[going], lens[going], lowest[going]
                if not len(own):
                    break
            hits = np.flatnonzero(ranks == np.repeat(lowest, lens))
            nth = np.arange(len(hits))
            first = np.flatnonzero(np.diff(hits, prepend=-2) != 1)  # of runs of overlapping pairs
            hits = hits[(nth - np.repeat(first, np.diff(first, append=len(hits)))) % 2 == 0]
            sym[hits] = self.made[ranks[hits]]
            kept = np.ones(len(sym), bool)
            kept[hits + 1] = False
            ends = np.cumsum(lens) - 1
            gone = np.searchsorted(ends, hits)  # the sequence of each merge
            lens = lens - np.bincount(gone, minlength=len(lens))
            at = hits - np.arange(len(hits))  # where the new symbols are now
            sym, ranks = sym[kept], ranks[kept]
            last = np.zeros(len(sym), bool)
            last[np.cumsum(lens) - 1] = True
            changed = np.zeros(len(sym), bool)
            changed[at] = changed[np.maximum(at - 1, 0)] = True
            beside = np.flatnonzero(changed & ~last)
            ranks[at[last[at]]] = NONE
            ranks[beside] = self.rank(sym[beside], sym[beside + 1])
        return out


class Counter:
    """Counts tokens of texts. Counts of pieces and pre-tokens are held up to a bound each."""

    def __init__(self, path: str, limit: int = 400_000):
        from tokenizers import pre_tokenizers

        with open(path, encoding="utf-8") as file:
            found = json.load(file)
        model, before, added = found["model"], found["pre_tokenizer"] or {}, found["added_tokens"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        odd = before.get("type") != "ByteLevel" or not before.get("use_regex", True) or before.get("add_prefix_space") or found.get("normalizer")
        if model["type"] != "BPE" or odd or model.get("ignore_merges") or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError(f"not a plain byte-level BPE vocabulary: {path}")
        self.merges, self.limit = Merges(model["vocab"], merges), limit
        self.added = re.compile("|".join(re.escape(t["content"]) for t in sorted(added, key=lambda t: -len(t["content"])))) if added else None
        self.matches = regex.compile(public_tokenizers.PATTERN)
        self.library = pre_tokenizers.ByteLevel(add_prefix_space=False)
        self.held: dict[str, int] = {}  # a pre-token is a piece of its own, too

    def split(self, piece: str) -> list[str]:
        """A piece's pre-tokens. Only the library knows its own version of Unicode, so other than Latin ones go through it."""
        if not plain(piece):
            return [unmapped(part).decode() for part, _ in self.library.pre_tokenize_str(piece)]
        if piece[-1] in ".," and piece[:-1].lstrip(" ").isalpha() and piece[1:2] != " ":
            return [piece[:-1], piece[-1]]
        return self.matches.findall(piece)

    def learn(self, pieces: list[str]) -> None:
        whole, split, held = [], [], self.held
        for piece in pieces:
            if (piece[1:] if piece[0] == " " else piece).isalpha() and plain(piece):
                whole.append(piece)
            else:
                split.append((piece, self.split(piece)))
        new = list({*whole, *chain.from_iterable(own for _, own in split)}.difference(held))
        for a in range(0, len(new), 1 << 16):
            some = new[a : a + (1 << 16)]
            held.update(zip(some, self.merges.counts(list(map(str.encode, some))).tolist(), strict=True))
        held.update([(piece, sum([held[p] for p in own])) for piece, own in split])

    def of_pieces(self, pieces: list[str]) -> np.ndarray:
        coded = pa.array(pieces, pa.string()).dictionary_encode()
        names = coded.dictionary.to_pylist()
        new = set(names).difference(self.held)
        if len(self.held) + len(new) > self.limit:
            self.held, new = {}, names
        self.learn(list(new))
        counts = np.fromiter(map(self.held.__getitem__, names), np.int64, len(names))
        return counts[coded.indices.to_numpy()]

    def segments(self, text: str) -> tuple[list[str], int]:
        """The text between added tokens, and how many of these there are."""
        found = self.added.split(text) if self.added else [text]
        return [s for s in found if s], len(found) - 1

    def __call__(self, texts: list[str]) -> np.ndarray:
        own = list(map(self.segments, texts))
        out = np.array([n for _, n in own], np.int64)
        if len(texts) == 1:  # possibly a very long one
            found = (m.group() for segment in own[0][0] for m in PIECE.finditer(segment))
            while some := list(islice(found, 1 << 18)):
                out[0] += self.of_pieces(some).sum()
            return out
        split = [list(chain.from_iterable(map(PIECE.findall, segments))) for segments, _ in own]
        return out + sums(self.of_pieces(list(chain.from_iterable(split))), np.fromiter(map(len, split), np.int64, len(split)))


@functools.lru_cache(2)
def counter(path: str) -> Counter:
    return Counter(path)


def count(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """docs' columns but text, with n_bytes (of the text in UTF-8), n_tokens and over_limit (n_tokens > limit)."""
    text = F.coalesce("text", F.lit("")) if "text" in docs.columns else F.lit("")
    carried = [c for c in docs.columns if c not in ("text", *MADE)]
    rows = docs.select(*carried, F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))

    def run(batches) -> Iterator[pa.RecordBatch]:
        tokens = counter(path)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in batches_of(texts, 1 << 22):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(tokens(texts[a:b]), pa.int64())], [*part.schema.names[:-1], "n_tokens"])

    kinds = T.StructType([*rows.schema.fields[:-1], T.StructField("n_tokens", T.LongType())])
    return rows.mapInArrow(run, kinds).withColumn("over_limit", F.col("n_tokens") > limit)
