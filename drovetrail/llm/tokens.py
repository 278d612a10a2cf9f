"""Encoding of a whole corpus with a public byte-level BPE vocabulary through a table of distinct words."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, salted_lookup, stored

#: Words of the documents that share one list of distinct words; a longer text has one of its own.
BLOCK_WORDS = 1 << 20


def default_vocabulary() -> tuple[str, str]:
    """Path of the byte_bpe_50k ranks and the pattern that splits texts before its merges."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class _Numbers(dict):
    """Numbers of words in the order in which they first come."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def split_corpus(docs: DataFrame, doc_id: str, text: str, pattern: str) -> DataFrame:
    """Documents as word numbers, and the distinct words of each block of documents: block, doc_id, at, word, number.

    The texts are split once. A block is some consecutive documents of about BLOCK_WORDS words; it has one row per
    document with the numbers of its words by position (``at``; empty for null and empty texts), and one row per distinct
    word with its ``number`` (and null ``at``).
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, base, n = regex.compile(pattern).findall, TaskContext.get().partitionId() << 32, 0
        numbers, ids, at, id_type = _Numbers(), [], [], None

        def block() -> Iterator[pa.RecordBatch]:
            rows, words = len(ids), list(numbers)
            ends = np.cumsum([0, *map(len, at)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *at])))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(rows, base + n)), pa.array(ids, id_type), lists, pa.nulls(rows, pa.string()), pa.nulls(rows, pa.int32())], names)
            rows = len(words)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(rows, base + n)), pa.nulls(rows, id_type), pa.nulls(rows, pa.list_(pa.int32())), pa.array(words, pa.string()), pa.array(np.arange(rows, dtype=np.int32))], names)

        held = 0
        for batch in batches:
            id_type = batch.column(0).type
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = find(t.as_py()) if t.is_valid else []
                ids.append(i)
                at.append(np.fromiter(map(numbers.__getitem__, found), np.int32, len(found)))
                held += len(found)
                if held >= BLOCK_WORDS:
                    yield from block()
                    n, held = n + 1, 0
                    numbers.clear(), ids.clear(), at.clear()
        if ids:
            yield from block()

    names = ["block", "doc_id", "at", "word", "number"]
    return docs.select(F.col(doc_id).alias("doc_id"), text).mapInArrow(split, f"block bigint, doc_id {kind}, at array<int>, word string, number int")


def encode_words(words: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """word, n, ids: every distinct word encoded once. A word is one unit of merging: nothing in it is a special token.

    The ranks have the size of the vocabulary; every executor gets a copy of them.
    """
    shared = words.sparkSession.sparkContext.broadcast(ranks)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        encoding = None
        for batch in batches:
            encoding = encoding or tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=shared.value, special_tokens={})
            ids = [encoding._encode_single_piece(w) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], ["word", "n", "ids"])

    return words.select("word", "n").mapInArrow(encode, "word string, n bigint, ids array<int>")


def encode_corpus(docs: DataFrame, doc_id: str, text: str, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, ids: the token ids of every document, without special tokens.

    All texts are split into words, once; the distinct words are a table in which each is encoded once. That table is
    joined to the words of every block of documents, frequent ones (a block has each at most once) spread over tasks, and
    the ids found come back to the block's documents by word number and position. Nothing but the vocabulary is sent to all executors,
    however many words there are. Null and empty texts have an empty list, blank ones the ids of their blanks; text that looks
    like a special token is ordinary text. Rows are independent of each other, so ties and repeated rows don't matter; other
    columns are ignored.
    """
    own = default_vocabulary() if path is None or pattern is None else None
    path, pattern = path or own[0], pattern or own[1]
    parts = stored(split_corpus(docs, doc_id, text, pattern), "words")
    listed = parts.filter("word is not null").select("block", "word", "number")
    words = cut(encode_words(listed.groupBy("word").agg(F.count("*").alias("n")), read_ranks(path), pattern))
    found = salted_lookup(listed, words, "word", F.col("block"), "n", "inner").select(F.col("block").alias("owner"), "number", "ids")
    texts = parts.filter("at is not null").select("block", "doc_id", "at")

    def put(texts: pa.Table, found: pa.Table) -> pa.Table:
        """A block: its words' ids in the order of their numbers, then those of every position."""
        order = np.argsort(found.column("number").to_numpy())
        lists = found.column("ids").combine_chunks()
        lengths = np.asarray(lists.value_lengths(), np.int64)
        flat, starts = lists.flatten().to_numpy(), (np.cumsum(lengths) - lengths)[order]
        lengths = lengths[order]
        at = texts.column("at").combine_chunks()
        places = at.flatten().to_numpy()
        size = lengths[places]
        before = np.concatenate(([0], np.cumsum(size)))
        ids = flat[np.repeat(starts[places] - before[:-1], size) + np.arange(before[-1])] if len(places) else np.zeros(0, np.int32)
        ends = before[np.concatenate(([0], np.cumsum(np.asarray(at.value_lengths(), np.int64))))]
        return pa.table({"doc_id": texts.column("doc_id"), "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))})

    kind = docs.schema[doc_id].dataType.simpleString()
    return texts.groupBy("block").cogroup(found.groupBy("owner")).applyInArrow(put, f"doc_id {kind}, ids array<int>")


def decode_corpus(encoded: DataFrame, doc_id: str, ids: str, path: str | None = None) -> DataFrame:
    """doc_id, text: the pieces of the ids, found by a join, put together by position and read as UTF-8.

    The table of pieces has the size of the vocabulary, so every executor gets it. Equal rows are decoded once. A null list
    gives null, an empty one the empty text; an id outside the vocabulary fails the job.
    """
    ranks = read_ranks(path or default_vocabulary()[0])
    # A piece travels as a text with one character per byte.
    pieces = encoded.sparkSession.createDataFrame([(i, p.decode("latin-1")) for p, i in ranks.items()], "id int, piece string")
    rows = encoded.select(F.col(doc_id).alias("doc_id"), F.col(ids).alias("ids"), F.xxhash64(F.col(ids)).alias("h"), F.col(ids).isNull().alias("none"))
    rows = rows.groupBy("doc_id", "h", "none").agg(F.first("ids").alias("ids"), F.count("*").alias("n"))
    tokens = rows.select("doc_id", "h", "none", "n", F.posexplode_outer("ids").alias("at", "id")).join(F.broadcast(pieces), "id", "left")
    unknown = F.col("id").isNotNull() & F.col("piece").isNull()
    piece = F.when(unknown, F.raise_error(F.concat(F.lit("no such id: "), F.col("id").cast("string")))).otherwise(F.col("piece"))
    # The tokens of a row are where the row is, so they are put together without another shuffle.
    whole = tokens.groupBy("doc_id", "h", "none", "n").agg(F.array_sort(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", piece.alias("piece"))))).alias("pieces"))
    text = F.encode(F.array_join(F.transform("pieces", lambda p: p["piece"]), ""), "ISO-8859-1").cast("string")
    return whole.select("doc_id", F.when(~F.col("none"), text).alias("text"), F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).select("doc_id", "text")
