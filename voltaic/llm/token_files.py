"""Operator 1: token-ID output as flat unsigned integer files with 64-bit document offsets.

``write_token_files`` lays the corpus out as shards ``shard-00000.*`` in
ascending document order:

* ``.ids``     flat little-endian ids, 16 bits each if the vocabulary fits, else 32; every
               document ends with ``end_id``;
* ``.offsets`` little-endian unsigned 64-bit *global* token offsets, one per document plus the end;
* ``.docs``    Arrow file with the document ids (NULL allowed);
* ``index/``   Parquet table: shard, n_docs, n_tokens, base (tokens in all shards before).

Documents are range-partitioned by id (one shuffle of the texts), each task
encodes its range and writes one shard; a shard's base is a prefix sum over
the shard sizes (one row per shard). ``read_token_files`` maps the files into
memory and returns one row per document.

A task writes under a name of its own and renames at the end, so a retried or
zombie task never leaves a half-written shard; ties in the id are put in order
by the text's hash, so a re-run task writes the same bytes.

Edge cases: NULL text is the empty text (only the end id); NULL ids come first;
repeated ids and rows are documents of their own; an empty table gives no shard
and an empty result; other columns are never read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voltaic.llm.common import open_fs, shuffle_partitions, stored
from voltaic.llm.encoder import worker_encoder

TOKEN_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _write_shards(out_dir: str, tokenizer, end_id: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        encoder = worker_encoder(tokenizer.value)
        dtype = encoder.dtype if end_id < 1 << 16 else np.dtype("<u4")
        fs, root = open_fs(out_dir)
        name, own = f"{root}/shard-{shard:05d}", f"{root}/_writing-{shard:05d}-{uuid.uuid4().hex}"
        fs.create_dir(root, recursive=True)
        docs = lengths = 0
        sink = {}
        try:
            for batch in batches:
                if not sink:
                    sink = {k: fs.open_output_stream(f"{own}.{k}") for k in ("ids", "lengths", "docs")}
                    arrow = pa.ipc.new_file(sink["docs"], pa.schema([("doc_id", pa.int64())]))
                for part in (batch.slice(i, 4096) for i in range(0, batch.num_rows, 4096)):
                    coded, bounds = encoder.encode_column(part.column(1))
                    sizes = np.diff(bounds).astype("<u8") + np.uint64(1)
                    ends = bounds[1:] + np.arange(len(sizes))  # places of the end ids
                    ids = np.full(len(coded) + len(sizes), end_id, dtype)
                    text = np.ones(len(ids), bool)
                    text[ends] = False
                    ids[text] = coded
                    sink["ids"].write(ids.tobytes())
                    sink["lengths"].write(sizes.tobytes())
                    arrow.write(pa.record_batch([part.column(0).cast(pa.int64())], names=["doc_id"]))
                    docs, lengths = docs + len(sizes), lengths + int(sizes.sum())
            if sink:
                arrow.close()
        finally:
            for s in sink.values():
                s.close()
        for k in sink:
            fs.move(f"{own}.{k}", f"{name}.{k}")
        if docs:
            yield pa.record_batch([[shard], [docs], [lengths], [dtype.itemsize]],
                                  schema=pa.schema([(c, pa.int64()) for c in ("shard", "n_docs", "n_tokens", "width")]))
    return run


def _write_offsets(out_dir: str):
    def run(batches):
        import numpy as np
        fs, root = open_fs(out_dir)
        for batch in batches:
            for shard, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                name = f"{root}/shard-{shard:05d}"
                with fs.open_input_file(f"{name}.lengths") as f:
                    sizes = np.frombuffer(f.read_buffer(), "<u8")
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype("<u8") + np.uint64(base)
                own = f"{root}/_writing-{shard:05d}-{uuid.uuid4().hex}.offsets"
                with fs.open_output_stream(own) as f:
                    f.write(offsets.tobytes())
                fs.move(own, f"{name}.offsets")
            yield batch
    return run


def write_token_files(docs: DataFrame, out_dir: str, tokenizer_json: str, end_id: int,
                      id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> DataFrame:
    """Encode every text and write the shards; returns the index (shard, n_docs, n_tokens, base, width)."""
    spark = docs.sparkSession
    tokenizer = spark.sparkContext.broadcast(tokenizer_json)  # one vocabulary file
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    ranged = rows.repartitionByRange(shards or shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    sizes = stored(ranged.mapInArrow(_write_shards(out_dir, tokenizer, end_id),
                                     "shard long, n_docs long, n_tokens long, width long"), "token-shards")
    # one row per shard: the prefix sum over shards is the base of each
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    index = sizes.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    spread = index.select("shard", "base", "n_docs", "n_tokens", "width").repartition(shuffle_partitions(spark))
    spread.mapInArrow(_write_offsets(out_dir), spread.schema).write.mode("overwrite").parquet(f"{out_dir}/index")
    return spark.read.schema(spread.schema).parquet(f"{out_dir}/index")


def _read_shards(out_dir: str):
    def run(batches):
        import zlib

        import numpy as np
        import pyarrow as pa
        fs, root = open_fs(out_dir)
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()),
                            ("ids_crc32", pa.int64())])
        for batch in batches:
            for shard, width in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                name = f"{root}/shard-{shard:05d}"
                with fs.open_input_file(f"{name}.offsets") as f:
                    offsets = np.frombuffer(f.read_buffer(), "<u8").astype(np.int64)
                with fs.open_input_file(f"{name}.docs") as f:
                    doc_ids = pa.ipc.open_file(f).read_all().column("doc_id").combine_chunks()
                sizes = np.diff(offsets)
                with fs.open_input_file(f"{name}.ids") as f:
                    crcs = np.array([zlib.crc32(np.frombuffer(f.read_buffer(int(n) * width), f"<u{width}")
                                                .astype("<u4").tobytes()) for n in sizes], np.int64)
                for i in range(0, len(sizes), 10_000):
                    yield pa.record_batch([doc_ids.slice(i, 10_000), offsets[:-1][i:i + 10_000],
                                           sizes[i:i + 10_000], crcs[i:i + 10_000]], schema=schema)
    return run


def read_token_files(spark: SparkSession, out_dir: str) -> DataFrame:
    """One row per document from the files: id, global start, token count (end id included), crc32 of its ids."""
    index = spark.read.schema("shard long, width long").parquet(f"{out_dir}/index")
    spread = index.repartition(shuffle_partitions(spark))
    return spread.mapInArrow(_read_shards(out_dir), TOKEN_SCHEMA)
