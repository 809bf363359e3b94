"""Encoding of a corpus with a public byte-level BPE vocabulary (problem 6).

A text is cut where the tokenizer's own pre-tokens end, so that every piece can be encoded alone. Within one chunk these are the places where
white space begins: no pre-token reaches over them. A text longer than a chunk is spread over tasks: overlapping chunks are pre-tokenised in
parallel, neighbours are stitched at the first place in their overlap where both have a pre-token boundary (from there on they agree, for a
boundary depends only on what follows), the pieces between stitches are encoded, and their ids are joined in order.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.operators.spread import over_cores

#: Where the vocabulary files are; the same path on all executors.
VOCABULARIES = "/opt/tokenizers"
#: The pattern of the vocabulary's pre-tokens (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Unicode's white space (a fixed value), as in the pattern's \s.
WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
#: Code points of a chunk and of the overlap with the next one. Longer texts are spread over tasks.
CHUNK, OVERLAP = 32_768, 1_024
#: Pieces remembered by a Python worker, and the longest that is.
REMEMBERED, LONGEST = 300_000, 48
#: A piece longer than this is cut into pre-tokens by us: the library's recursion has bounds.
LONG_PIECE = 65_536


class Encoder:
    """Ids of texts as bytes of little-endian int32. Equal pieces are encoded once while they are remembered."""

    def __init__(self, path: str):
        import re

        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pre_tokens = regex.compile(PATTERN)
        self.pieces = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+").findall
        outer = self

        class Memory(dict):
            def __missing__(self, piece: str) -> bytes:
                ids = outer._encode_piece(piece)
                if len(piece) <= LONGEST:
                    if len(self) >= REMEMBERED:
                        self.clear()
                    self[piece] = ids
                return ids

        self.memory = Memory()

    def _encode_piece(self, piece: str) -> bytes:
        if len(piece) <= LONG_PIECE:
            return array("i", self.bpe.encode_ordinary(piece)).tobytes()
        return b"".join(array("i", self.bpe._encode_single_piece(p.encode())).tobytes() for p in self.pre_tokens.findall(piece))

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.memory.__getitem__, self.pieces(text)))

    def boundaries(self, text: str) -> list[int]:
        """Ends of pre-tokens at which a piece may end as well: what stands before is no white space, which the next characters could join."""
        return [m.end() for m in self.pre_tokens.finditer(text) if not m[0][-1].isspace()]


@cache
def encoder(vocabularies: str, name: str) -> Encoder:
    return Encoder(f"{vocabularies}/{name}.tiktoken")


def _ids_array(encoded: list[bytes]) -> pa.Array:
    offsets = np.fromiter(accumulate((len(e) // 4 for e in encoded), initial=0), np.int64, len(encoded) + 1)
    if offsets[-1] >= 2**31:
        raise ValueError("more ids in one batch than a list array can hold; lower spark.sql.execution.arrow.maxRecordsPerBatch")
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(np.frombuffer(b"".join(encoded), np.int32)))


def token_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k", vocabularies: str = VOCABULARIES, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(id, ids) of every document: the ids of its whole text, all of it taken as ordinary text. NULL and empty texts have the empty list.

    id_col must be unique. Texts of at most ``chunk`` code points are encoded where they lie; only longer ones are shuffled.
    """
    return _run(docs, id_col, text_col, vocabulary, vocabularies, chunk, overlap, counts=False)


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k", vocabularies: str = VOCABULARIES, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(id, n_tokens) of every document: the number of its ids, which themselves stay in the Python workers."""
    return _run(docs, id_col, text_col, vocabulary, vocabularies, chunk, overlap, counts=True)


def _run(docs: DataFrame, id_col: str, text_col: str, vocabulary: str, vocabularies: str, chunk: int, overlap: int, counts: bool) -> DataFrame:
    if overlap * 4 > chunk:
        raise ValueError("chunks must be at least four overlaps long")
    src = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    long = F.coalesce(F.length("text") > chunk, F.lit(False))
    result = "n_tokens" if counts else "ids"
    id_field = src.schema[id_col]
    schema = T.StructType([id_field, T.StructField(result, T.LongType() if counts else T.ArrayType(T.IntegerType(), False))])

    def finish(ids: pa.Array, encoded: list[bytes]) -> pa.RecordBatch:
        out = pa.array([len(e) // 4 for e in encoded], pa.int64()) if counts else _ids_array(encoded)
        return pa.RecordBatch.from_arrays([ids, out], [id_col, result])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabularies, vocabulary)
        for b in batches:
            yield finish(b.column(0), [enc.encode(t) if t else b"" for t in b.column(1).to_pylist()])

    short = over_cores(src.where(~long)).mapInArrow(whole, schema)

    pieces = _stitched(src.where(long), id_col, vocabulary, vocabularies, chunk, overlap)
    piece_schema = T.StructType([id_field, T.StructField("piece", T.IntegerType()), schema[result]])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabularies, vocabulary)
        for b in batches:
            done = finish(b.column(0), [enc.encode(t) for t in b.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([done.column(0), b.column(1), done.column(1)], [id_col, "piece", result])

    encoded = pieces.mapInArrow(parts, piece_schema)
    if counts:
        joined = encoded.groupBy(id_col).agg(F.sum(result).alias(result))
    else:
        # the list of one document's pieces is that document's own result
        ordered = F.transform(F.sort_array(F.collect_list(F.struct("piece", result))), lambda x: x[result])
        joined = encoded.groupBy(id_col).agg(F.flatten(ordered).alias(result))
    return short.unionByName(joined)


def _stitched(docs: DataFrame, id_col: str, vocabulary: str, vocabularies: str, chunk: int, overlap: int) -> DataFrame:
    """(id, piece, text): each text in pieces that can be encoded alone, numbered in order; together they are the whole text."""
    id_field = docs.schema[id_col]
    cut_schema = T.StructType([id_field, T.StructField("k", T.IntegerType()), T.StructField("last", T.BooleanType()), T.StructField("text", T.StringType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t in enumerate(b.column(1).to_pylist()):
                # the last chunk is never shorter than the overlap
                n = max(1, (len(t) - overlap - 1) // chunk + 1)
                for k in range(n):
                    text = t[k * chunk :] if k == n - 1 else t[k * chunk : (k + 1) * chunk + overlap]
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).slice(i, 1), pa.array([k], pa.int32()), pa.array([k == n - 1]), pa.array([text])], [id_col, "k", "last", "text"]
                    )

    ends = T.ArrayType(T.IntegerType(), False)
    bound_schema = T.StructType([*cut_schema.fields, T.StructField("head", ends), T.StructField("tail", ends)])

    def pre_tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabularies, vocabulary)
        int_list = pa.list_(pa.int32())
        for b in batches:
            head, tail = [], []
            for last, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                # what stands behind the chunk could change its last characters' pre-tokens
                all_ = [e for e in enc.boundaries(t) if last or e <= len(t) - 4]
                head.append([e for e in all_ if 0 < e <= overlap])
                tail.append([e - chunk for e in all_ if e > chunk])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(head, int_list), pa.array(tail, int_list)], [*b.schema.names, "head", "tail"])

    chunks = docs.mapInArrow(cut, cut_schema).repartition(F.col(id_col), F.col("k")).mapInArrow(pre_tokenise, bound_schema)
    # a document's chunks are few: a text has at most 2^31 bytes
    order = Window.partitionBy(id_col).orderBy("k")
    common = F.array_min(F.array_intersect(F.lag("tail").over(order), F.col("head")))
    chunks = chunks.withColumn("start", F.when(F.col("k") == 0, 0).otherwise(common))
    # neighbours that never meet stay one piece
    chunks = chunks.withColumn("piece", F.count("start").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    chunks = chunks.withColumn("stop", F.lead("start").over(order)).withColumn("same", F.lead("piece").over(order) == F.col("piece"))
    # a chunk gives its text from its start (0 if it goes on with a piece) to the next one's start, or to its own length if that goes on with it
    begin = F.coalesce(F.col("start"), F.lit(0))
    stop = F.when(F.col("last"), F.length("text")).when(F.col("same"), F.lit(chunk)).otherwise(F.col("stop") + chunk)
    parts = chunks.select(id_col, "piece", "k", F.substring(F.col("text"), begin + 1, stop - begin).alias("text"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "text"))), lambda x: x["text"]), "")
    return parts.groupBy(id_col, "piece").agg(joined.alias("text"))


def decode(ids: list[int], vocabulary: str = "byte_bpe_50k", vocabularies: str = VOCABULARIES) -> str:
    """The text of ids: their bytes, joined."""
    return encoder(vocabularies, vocabulary).bpe.decode_bytes(ids).decode()
