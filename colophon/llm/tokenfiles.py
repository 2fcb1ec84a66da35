"""Token files: ids of all documents in order of their ids, as coded blocks.

Documents are dealt into ranges of ``doc_id``, encoded in order, and written as rows of Parquet
files in the shared work folder, one row a block of ``idcoder`` with the ids and lengths of its
documents.  Blocks are coded and read on their own; a document lies in one block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from colophon.llm.common import mapped, slices, table
from colophon.llm.idcoder import decode_block, encode_block
from colophon.llm.tokens import encoded
from colophon.operators.ranking import running_totals
from colophon.session import partitions_of, reuse

#: a block is closed at the first end of a document beyond so many ids
BLOCK_IDS = 1 << 22


def blocks_of(docs: DataFrame, path: str, alphabet: int, end_id: int = 0) -> DataFrame:
    """Rows ``part``, ``block``, ``doc_ids``, ``lengths``, ``n_ids``, ``payload`` in order of ``doc_id``.

    Null ids come last, repeated ids in order of a hash of their texts; null texts count as empty.
    """
    rows = docs.select("doc_id", "text").withColumn("_h", F.xxhash64("text"))
    keys = [F.col("doc_id").asc_nulls_last(), F.col("_h")]
    ranged = rows.repartitionByRange(partitions_of(docs.sparkSession), *keys).sortWithinPartitions(*keys).select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        names: list[pa.Array] = []
        held: list[bytes] = []
        n = block = 0

        def close() -> pa.RecordBatch:
            nonlocal n, block
            ids = pa.concat_arrays(names)
            payload = encode_block(np.frombuffer(b"".join(held), "<u4"), alphabet)
            out = pa.RecordBatch.from_arrays(
                [pa.array([part]), pa.array([block]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([[len(x) // 4 for x in held]], pa.list_(pa.int64())), pa.array([n]), pa.array([payload], pa.binary())],
                ["part", "block", "doc_ids", "lengths", "n_ids", "payload"],
            )
            names.clear()
            held.clear()
            n, block = 0, block + 1
            return out

        for batch, ids in encoded(batches, path, end_id, most=2 << 20, together=8):
            column = batch.column("doc_id")
            for k, x in enumerate(ids):
                names.append(column.slice(k, 1))
                held.append(x)
                n += len(x) // 4
                if n >= BLOCK_IDS:
                    yield close()
        if held:
            yield close()

    return mapped(ranged, work, f"part bigint, block bigint, doc_ids array<{kind}>, lengths array<bigint>, n_ids bigint, payload binary")


def documents_in(blocks: DataFrame) -> DataFrame:
    """Decodes blocks: ``part``, ``block``, ``doc_id``, ``begin`` (ids before it in the block), ``n_tokens``, ``ids`` as bytes."""
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "payload", 1):
            part, block, names, lengths, payload = (batch.column(c) for c in ("part", "block", "doc_ids", "lengths", "payload"))
            ids = decode_block(payload[0].as_py())
            sizes = lengths.values.slice(lengths.offsets[0].as_py(), lengths.offsets[1].as_py() - lengths.offsets[0].as_py()).to_numpy()
            ends = np.cumsum(sizes)
            own = names.values.slice(names.offsets[0].as_py(), len(sizes))
            texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(4 * np.r_[0, ends]), pa.py_buffer(ids)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array([part[0].as_py()] * len(sizes), pa.int64()), pa.array([block[0].as_py()] * len(sizes), pa.int64()), own, pa.array(ends - sizes), pa.array(sizes), texts],
                ["part", "block", "doc_id", "begin", "n_tokens", "ids"],
            )

    return mapped(blocks.select("part", "block", "doc_ids", "lengths", "payload"), work, f"part bigint, block bigint, doc_id {kind}, begin bigint, n_tokens bigint, ids binary")


def op7_token_files(spark, sf_dir: str) -> DataFrame:
    """Contract: writes the token files of all documents, reads them back, and describes each document."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    files = reuse(blocks_of(table(spark, sf_dir, "documents"), path, Tokenizer.from_file(path).get_vocab_size()), "tokens")
    # block numbers and sizes only, not their bytes
    starts = running_totals(files.select("part", "block", "n_ids"), [("part", "asc"), ("block", "asc")], {"first": "n_ids"}).drop("n_ids")
    found = documents_in(files).select("part", "block", "doc_id", "begin", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    return found.join(starts, ["part", "block"]).select("doc_id", (F.col("first") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32")
