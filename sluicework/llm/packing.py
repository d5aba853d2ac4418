"""Packing by power-of-two decomposition.

A document of n tokens is cut, from its start, into as many pieces of the full
length as it holds and then into one piece for each binary digit of the rest,
longest first. Each piece is a sequence of its own, and pieces of equal length
are bucketed into batches of ``BATCH`` tokens. So no sequence crosses documents,
nothing is padded and all sequences of a batch have one length.

The work is one narrow Arrow pass: a piece needs its own document only. A
sequence's number is made of the partition and the place in it, and a batch's of
the partition, the bucket and its place there, so numbers are unique without a
shuffle, whatever key is hot. Each partition ends with at most one unfull batch
a bucket.

Defined results. A null text is an empty one; it has the end id alone, one
piece of one token. Repeated rows are packed each; a very long text gives as many
full pieces as it holds. An empty table gives an empty result. Extra columns are
not looked at, and an id column that is named like an output gets underscores
before its name.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import kept, table
from .textvec import blocks
from .word_tokens import word_ids

SEQUENCE = 4096
END_ID = 2
BATCH = 1 << 16  # tokens
TOKENIZER = "word_bpe_49k.json"
BLOCK_BYTES = 1 << 20


def pieces(n: int, longest: int = SEQUENCE) -> list[int]:
    """Lengths of the pieces of n tokens."""
    out = [longest] * (n // longest)
    rest = n % longest
    return out + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


_OUT = ["start", "length", "ids_crc32", "doc_tokens", "bucket", "batch", "sequence_id", "offset"]


def pack(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", longest: int = SEQUENCE, end_id: int = END_ID, with_ids: bool = True, batch_tokens: int = BATCH) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, bucket (its length), batch, sequence_id, offset, ids: one row for each piece.

    batch: sequences of one bucket, ``batch_tokens`` tokens together (one
    sequence at least). ids: the token ids as little-endian unsigned 32-bit
    bytes, only on demand.
    """
    if longest & (longest - 1):
        raise ValueError("the longest sequence must be a power of two")
    kind = docs.schema[doc_id].dataType.simpleString()
    end = end_id.to_bytes(4, "little")

    def run(batches):
        encoder = word_ids(path)
        task = TaskContext.get().partitionId() << 38
        full = {1 << b: max(1, batch_tokens >> b) for b in range(longest.bit_length())}
        base = {size: task | (size.bit_length() - 1) << 32 for size in full}
        seen = dict.fromkeys(full, 0)
        for block in blocks(batches, BLOCK_BYTES, keep="word_ids"):
            of, start, length, ids, crc, total, batch = [], [], [], [], [], [], []
            for i, value in enumerate(block.column(0)):
                data = memoryview(encoder.ids(value.as_py()) + end)
                n = len(data) // 4
                at = 0
                for size in pieces(n, longest):
                    piece = data[4 * at : 4 * (at + size)]
                    of.append(i)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(piece))
                    total.append(n)
                    batch.append(base[size] + seen[size] // full[size])
                    seen[size] += 1
                    if with_ids:
                        ids.append(bytes(piece))
                    at += size
            columns = [block.column(1).take(pa.array(of, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total, batch))]
            names = ["id", "start", "length", "ids_crc32", "doc_tokens", "batch"]
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(ids, pa.binary())] if with_ids else [])], names=[*names, *(["ids"] if with_ids else [])])

    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, batch long" + ", ids binary" * with_ids
    out = docs.select(F.col(text).alias("text"), F.col(doc_id).alias("id")).mapInArrow(run, schema)
    out = out.withColumns({"bucket": F.col("length"), "sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    names = [*_OUT, *(["ids"] if with_ids else [])]
    return out.select("id", *names).toDF(*kept([doc_id], names), *names)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), with_ids=False)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket", "batch")
