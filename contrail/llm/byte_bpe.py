"""Op 2: byte-level BPE encoding and decoding.

The tokenizers library runs over Arrow batches. Its vocabulary and merges are derived from a ranks file: every
way to put a token together from two others is a merge, at the rank of the token. Bytes are mapped to printable
characters for the library and back for decoding.

A null text is an empty one and has no ids; very long ones are encoded whole; no rows yield no rows. Clashing columns are
replaced by encode and decode, others carried. Offsets are in characters; a token that holds a part of a character
spans all of it. Decoding gives bytes, and text in which incomplete characters become U+FFFD.
"""

from __future__ import annotations

import base64
import functools
import os
import re
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches_of, slices
from .pieces import PieceTable, mapped, plain, ragged

#: Unicode White_Space, which is what \s is in the tokenizers' patterns (Python's own \s has four more).
SPACE = r"\t-\r \x85\xa0  -     　"
#: No match of the pattern ends inside such a piece's border: white space opens a match or fills one.
PIECE = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")


@functools.lru_cache(4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@functools.lru_cache(4)
def tokenizer(path: str, pattern: str = public_tokenizers.PATTERN):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Regex, Tokenizer, decoders, models, pre_tokenizers

    ranks = load_ranks(path)
    name = {token: mapped([token])[0] for token in ranks}
    pairs = [(rank, max(ranks[token[:i]], ranks[token[i:]]), token[:i], token[i:]) for token, rank in ranks.items() for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
    merges = [(name[a], name[b]) for _, _, a, b in sorted(pairs)]
    out = Tokenizer(models.BPE({name[token]: rank for token, rank in ranks.items()}, merges, ignore_merges=True))
    out.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    out.decoder = decoders.ByteLevel()
    return out


@functools.lru_cache(4)
def _pieces(path: str) -> PieceTable:
    matches = regex.compile(public_tokenizers.PATTERN)

    def split(piece: str) -> tuple:
        word = piece[1:] if piece[0] == " " else piece
        if word.isalpha() and plain(word):
            return (piece,)
        if word[-1:] in {".", ","} and word[:-1].isalpha() and plain(word):
            return piece[:-1], piece[-1]
        return tuple(matches.findall(piece))

    # a worker keeps these tables between tasks, so they are kept small
    return PieceTable(tokenizer(path).model, split, pieces=100_000, parts=250_000)


@functools.lru_cache(4)
def _byte_table(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens' bytes one after the other; where each id's begin; how many they are."""
    ranks = load_ranks(path)
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    lens = np.array([len(t) for t in tokens], np.int64)
    return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(lens) - lens, lens


def character_offsets(texts: list, ids: np.ndarray, counts: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Where each token begins and ends, in characters of its text. ids: those of all texts, of which counts many are each one's."""
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    char = np.cumsum((data & 0xC0) != 0x80) - 1
    ends = np.cumsum(_byte_table(path)[2][ids])
    begins = np.concatenate([[0], ends[:-1]])
    if not len(data):
        return begins, ends
    sizes = np.array([len(t) for t in texts], np.int64)
    base = np.repeat(np.cumsum(sizes) - sizes, counts)
    return char[begins] - base, char[ends - 1] + 1 - base


def encoded(batches, path: str, made: list[str]):
    """Arrow batches with a `text` column, with the columns named by made (ids and, if asked for, begins and ends)."""
    pieces = _pieces(path)
    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        for a, b in batches_of(texts, 1 << 20):
            found = [PIECE.findall(t) for t in texts[a:b]]
            ids, counts = pieces.ids(pa.array(chain.from_iterable(found), pa.string()), np.fromiter(map(len, found), np.int64, b - a))
            bounds = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
            columns = [ids, *(character_offsets(texts[a:b], ids, counts, path) if len(made) > 1 else [])]
            lists = [pa.ListArray.from_arrays(bounds, pa.array(x, pa.int32())) for x in columns]
            part = batch.slice(a, b - a)
            yield pa.RecordBatch.from_arrays([*part.columns, *lists], [*part.schema.names, *made])


def encode(docs: DataFrame, path: str, offsets: bool = True) -> DataFrame:
    """docs with `ids` and, if asked for, `begins` and `ends`. Clashing columns of docs are replaced."""
    made = ["ids", "begins", "ends"][: 3 if offsets else 1]
    kept = docs.select(*(c for c in docs.columns if c not in made), *([] if "text" in docs.columns else [F.lit("").alias("text")]))
    return kept.mapInArrow(lambda batches: encoded(batches, path, made), _with(kept, made))


def _with(df: DataFrame, made: list[str], kind: T.DataType = T.ArrayType(T.IntegerType())) -> T.StructType:
    return T.StructType([*df.schema.fields, *(T.StructField(name, kind) for name in made)])


def decoded(batches, path: str, text: bool = False):
    """Arrow batches with an `ids` column, with `decoded`."""
    flat, starts, lens = _byte_table(path)
    for whole in batches:
        sizes = whole.column("ids").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        for a, b in slices(sizes, 1 << 18):
            batch = whole.slice(a, b - a)
            ids, counts = batch.column("ids").flatten().to_numpy(zero_copy_only=False), sizes[a:b]
            data = flat[ragged(starts[ids], lens[ids])].tobytes()
            at = np.concatenate([[0], np.cumsum(lens[ids])])[np.concatenate([[0], np.cumsum(counts)])]
            found = [data[i:j] for i, j in zip(at, at[1:], strict=False)]
            column = pa.array([x.decode("utf-8", "replace") for x in found], pa.string()) if text else pa.array(found, pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, "decoded"])


def decode(docs: DataFrame, path: str, text: bool = False) -> DataFrame:
    """docs with `decoded`: the bytes that `ids` stand for, or their text. Unknown ids are an error."""
    kept = docs.select(*(c for c in docs.columns if c != "decoded"))
    return kept.mapInArrow(lambda batches: decoded(batches, path, text), _with(kept, ["decoded"], T.StringType() if text else T.BinaryType()))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, n_chars and decoded: both ways in one Python worker, so a task holds one set of tables."""

    def run(batches):
        for batch in decoded(encoded(batches, path, ["ids", "begins", "ends"]), path):
            ends = batch.column("ends")
            bounds, flat = ends.offsets.to_numpy(), ends.values.to_numpy()
            n_chars = np.where(np.diff(bounds) > 0, flat[np.maximum(bounds[1:] - 1, 0)], 0) if len(flat) else np.zeros(len(ends))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array(n_chars, pa.int64()), batch.column("decoded")], ["doc_id", "ids", "n_chars", "decoded"])

    kept = docs.select("doc_id", "text")
    kinds = {"ids": T.ArrayType(T.IntegerType()), "n_chars": T.LongType(), "decoded": T.BinaryType()}
    return kept.mapInArrow(run, T.StructType([kept.schema["doc_id"], *(T.StructField(n, k) for n, k in kinds.items())]))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, SHA-256 of the decimal ids and of the decoded bytes, and n_chars."""
    return round_trip(docs, path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "n_chars",
    )
