"""Packing by power-of-two decomposition.

A document's ids, with the end id after them, are cut into pieces whose lengths
are powers of two: as many of the longest as fit, then one for each set bit of the
rest, the longest first. Each piece is a sequence by itself, so no sequence crosses
documents and none needs padding. Sequences of equal length form a bucket; the
bucket stands in the highest bits of sequence_id, so those of one bucket are one
range of ids, ready to be batched without padding.

A null or empty text is its end id alone: one piece of length 1. Repeated rows are
packed each by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyvox.llm.bpe import codec_of, default_path, read_spec

LONGEST = 1024
END_ID = 0


def lengths(n: int, longest: int = LONGEST) -> list[int]:
    """The pieces of n ids: n as a sum of powers of two not over longest, in falling order."""
    whole, rest = divmod(n, longest)
    return [longest] * whole + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def packed(docs: DataFrame, path: str | None = None, longest: int = LONGEST, end_id: int = END_ID) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids (binary), doc_tokens, bucket, sequence_id, offset.

    One narrow pass, no shuffle: sequence_id is unique through the task's number and a
    count in the task, and the same again when a lost task is repeated.
    """
    if longest & (longest - 1):
        raise ValueError("longest is no power of two")
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(path or default_path()))
    schema = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, bucket int, sequence_id bigint, offset bigint"

    def pack(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        codec, task, made = codec_of(spec.value), TaskContext.get().partitionId(), 0
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = codec.encode(text) + end
                    n, start = len(ids) // 4, 0
                    for length in lengths(n, longest):
                        bucket = length.bit_length() - 1
                        rows.append((doc, start, length, ids[4 * start : 4 * (start + length)], n, bucket, bucket << 58 | task << 36 | made, 0))
                        start, made = start + length, made + 1
                columns = list(zip(*rows))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
                names = ["doc_id", "start", "length", "ids", "doc_tokens", "bucket", "sequence_id", "offset"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text")).mapInArrow(pack, schema)
