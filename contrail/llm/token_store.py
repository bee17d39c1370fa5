"""Op 1: token ids in a binary file format with a shared zstandard dictionary.

A store is a folder with two Parquet tables, so Spark's commit protocol covers it and any file system that Spark
can reach holds it:

* `dictionary`: the zstandard dictionary and its SHA-256;
* `blocks`: a row per block of documents in ascending doc_id order, with the dictionary's hash, the ids of its
  documents, their token counts, an offset index and the concatenated frames, one zstandard frame a document
  over its ids as little-endian unsigned 32-bit integers.

A short document is read by pruning blocks on first_id/last_id, slicing its frame by the offset index and
decompressing that frame alone.

Ids are those of the tokenizers library: its added tokens (here <|startoftext|> and <|endoftext|>) get their own ids
where a text spells them out. Null doc_ids come first; equal doc_ids are ordered by a hash of their text, then by it. A
null or empty text yields the end id alone. Very long texts are whole frames; no table at all yields an empty store.
Columns other than doc_id and text are ignored, whatever their names. The dictionary is fitted on at most `sample_docs`
doc_ids (those of least hash) and one run of at most `sample_chars` characters of each, from a place that the hash picks;
it affects the size of the frames only, never the ids. With fewer than 16 texts there is none.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import batches_of, stage
from .pieces import PieceTable, plain, unmapped

#: Characters on which Unicode versions, or libraries in their lower case, may differ.
OTHER = re.compile("[^\x00-\u012f\u0131-\u024f]")
BLOCK_DOCS, BLOCK_BYTES, SLICE = 2048, 4 << 20, 2 << 20
BLOCKS = (
    "shard int, block int, dict_hash string, first_id long, last_id long, before long, tokens long,"
    " doc_ids array<long>, n_tokens array<long>, offsets array<long>, frames binary"
)


#: The vocabulary's pattern for parts of a word after lower-casing (a fixed value).
PART = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


@functools.lru_cache(4)
def _pieces(path: str) -> tuple[PieceTable, re.Pattern, str]:
    """The table of words, a pattern of the vocabulary's added tokens, and what all of them begin with."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    added = {token.content: i for i, token in tokenizer.get_added_tokens_decoder().items()}
    if any(t.single_word or t.lstrip or t.rstrip or t.normalized for t in tokenizer.get_added_tokens_decoder().values()):
        raise ValueError("only added tokens that match as they are can be encoded")

    def split(word: str) -> tuple:
        if word.isascii() and word.isalpha():
            return (word.lower(),)
        if word in added:
            return (word,)
        if not plain(word):  # Unicode versions may differ
            found = tokenizer.pre_tokenizer.pre_tokenize_str(tokenizer.normalizer.normalize_str(word))
            return tuple(unmapped(part).decode() for part, _ in found)
        word = word.lower()
        if word.isalpha():
            return (word,)
        if word[-1:] in {".", ","} and word[:-1].isalpha():
            return word[:-1], word[-1]
        return tuple(PART.findall(word))

    names = "|".join(sorted(map(re.escape, added), key=len, reverse=True))
    return PieceTable(tokenizer.model, split, pieces=150_000, parts=250_000, special=added), re.compile(f"({names or '(?!)'})"), os.path.commonprefix(list(added))


def words_of(texts: list[str], added: re.Pattern, lead: str) -> tuple[pa.StringArray, np.ndarray]:
    """What the texts' tokens lie in, in one array, and how many there are per text: words between ASCII white space, added tokens on their own.

    Texts of Latin characters alone are lower-cased and cut behind each run of letters, where no part of a word goes on.
    """
    latin = np.array([OTHER.search(t) is None and lead not in t for t in texts], bool)
    made = pa.array([added.sub(r" \1 ", t) if lead in t else t for t in texts], pa.string())
    if latin.any():
        cut = pc.replace_substring_regex(pc.utf8_lower(made), r"(\p{L})([^\s\p{L}])", r"\1 \2")
        made = cut if latin.all() else pc.if_else(pa.array(latin), cut, made)
    split = pc.ascii_split_whitespace(made)
    return split.flatten(), split.value_lengths().to_numpy()


def encode_texts(texts: list, path: str, end_id: int) -> Iterator[np.ndarray]:
    """Each text's ids and the end id. The vocabulary drops white space, so words are encoded apart."""
    pieces, *added = _pieces(path)
    for a, b in batches_of(texts, SLICE):
        ids, counts = pieces.ids(*words_of(texts[a:b], *added))
        ends = np.cumsum(counts + 1)
        flat = np.full(len(ids) + b - a, end_id, "<u4")
        inside = np.ones(len(flat), bool)
        inside[ends - 1] = False
        flat[inside] = ids
        yield from (flat[i:j] for i, j in zip(ends - counts - 1, ends, strict=True))


def train_dictionary(docs: DataFrame, path: str, end_id: int, size: int, sample_docs: int, sample_chars: int) -> bytes:
    """A dictionary of at most `size` bytes; empty if the sample is too small for one. It is alike in every layout of docs."""
    place = F.xxhash64("doc_id")
    picked = docs.select("doc_id").distinct().orderBy(place, "doc_id").limit(sample_docs)
    start = 1 + F.pmod(place, F.greatest(F.lit(1), F.length("text") - sample_chars + 1).cast("long"))
    runs = docs.join(F.broadcast(picked), "doc_id", "left_semi").select("doc_id", F.substring("text", start.cast("int"), F.lit(sample_chars)).alias("run"))
    texts = sorted(r["run"] for r in runs.groupBy("doc_id").agg(F.max("run").alias("run")).collect())
    samples = [ids.tobytes() for ids in encode_texts(texts, path, end_id)]
    if len(samples) < 16:
        return b""
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, samples)) // 8)), samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _compressors(dictionary: bytes):
    shared = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
    return zstandard.ZstdCompressor(level=3, **shared), zstandard.ZstdDecompressor(**shared)


def write(docs: DataFrame, to: str, tokenizer: str, end_id: int = 1, dict_bytes: int = 64 << 10, sample_docs: int = 1000, sample_chars: int = 4096) -> None:
    """Encodes every whole text of docs (doc_id, text) and writes the store.

    One range shuffle by doc_id (and a hash of the text, so that rows of one doc_id may be many) orders the
    documents; each task then writes the blocks of its own range.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    dictionary = train_dictionary(docs, tokenizer, end_id, dict_bytes, sample_docs, sample_chars)
    dict_hash = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(dict_hash, bytearray(dictionary))], "dict_hash string, dictionary binary").coalesce(1).write.parquet(f"{to}/dictionary")
    fields = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("dict_hash", pa.string()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("before", pa.int64()), ("tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("frames", pa.binary())])

    def blocks(batches):
        compress, _ = _compressors(dictionary)
        shard, block, before = TaskContext.get().partitionId(), 0, 0
        ids, counts, frames, size = [], [], [], 0

        def flush():
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in frames])]).tolist()
            known = [i for i in ids if i is not None]
            row = [shard, block, dict_hash, min(known, default=None), max(known, default=None), before, sum(counts), ids, counts, offsets, b"".join(frames)]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, fields, strict=True)], schema=fields)

        for batch in batches:
            texts = batch.column("text").to_pylist()
            for doc_id, doc in zip(batch.column("doc_id").to_pylist(), encode_texts(texts, tokenizer, end_id), strict=True):
                frame = compress.compress(doc.tobytes())
                ids.append(doc_id), counts.append(len(doc)), frames.append(frame)
                size += len(frame)
                if len(ids) >= BLOCK_DOCS or size >= BLOCK_BYTES:
                    yield flush()
                    block, before = block + 1, before + sum(counts)
                    ids, counts, frames, size = [], [], [], 0
        if ids:
            yield flush()

    placed = docs.withColumn("place", F.xxhash64("text"))
    ordered = placed.repartitionByRange("doc_id", "place").sortWithinPartitions("doc_id", "place", "text").drop("place")
    ordered.mapInArrow(blocks, BLOCKS).write.option("compression", "uncompressed").parquet(f"{to}/blocks")


def _dictionaries(spark: SparkSession, path: str) -> dict[str, bytes]:
    """A store's dictionaries: one a write, at most 64 KB each by default."""
    rows = spark.read.parquet(f"{path}/dictionary").collect()
    for row in rows:
        if hashlib.sha256(row["dictionary"]).hexdigest() != row["dict_hash"]:
            raise ValueError("the stored dictionary doesn't match its hash")
    return {row["dict_hash"]: bytes(row["dictionary"]) for row in rows}


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and the ids themselves.

    Starts inside a shard come from the index; the shards' bases are sums over one row a shard.
    """
    dictionaries = _dictionaries(spark, path)
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    shards = blocks.groupBy("shard").agg(F.sum("tokens").alias("tokens"))
    ahead = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    bases = stage(shards.select("shard", F.coalesce(F.sum("tokens").over(ahead), F.lit(0)).alias("base")), "token-bases")
    wanted = blocks.select("shard", "dict_hash", "before", "doc_ids", "n_tokens", "offsets", "frames").join(bases, "shard")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def documents(batches):
        of = {h: _compressors(d)[1] for h, d in dictionaries.items()}
        for batch in batches:
            for row in batch.to_pylist():
                start, frames, decompress = row["base"] + row["before"], memoryview(row["frames"]), of[row["dict_hash"]]
                raws = [decompress.decompress(frames[a:b]) for a, b in zip(row["offsets"], row["offsets"][1:], strict=False)]
                counts = [len(raw) // 4 for raw in raws]
                if counts != row["n_tokens"]:
                    raise ValueError("a frame doesn't hold the tokens that the index names")
                starts = (start + np.cumsum([0, *counts])[:-1]).tolist()
                columns = [pa.array(row["doc_ids"], pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array([zlib.crc32(raw) for raw in raws], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    flat = pa.array(np.frombuffer(b"".join(raws), "<u4").astype(np.int64))
                    columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts]), pa.int32()), flat))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return wanted.mapInArrow(documents, schema)


def lookup(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """The ids of the documents with this doc_id, decompressing their frames alone."""
    of = {h: _compressors(d)[1] for h, d in _dictionaries(spark, path).items()}
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id))
    entry = F.explode(F.arrays_zip(F.col("doc_ids"), F.col("offsets"), F.slice("offsets", 2, F.size("doc_ids")).alias("ends")))
    hits = blocks.select("dict_hash", "frames", entry.alias("e")).where(F.col("e.doc_ids") == doc_id)
    frame = F.expr("substring(frames, cast(e.offsets + 1 as int), cast(e.ends - e.offsets as int))")
    rows = hits.select("dict_hash", frame.alias("frame")).collect()
    return [np.frombuffer(of[r["dict_hash"]].decompress(bytes(r["frame"])), "<u4").tolist() for r in rows]
