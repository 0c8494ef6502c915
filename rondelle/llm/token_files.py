"""Token-ID output: documents' ids in id order in patched frame-of-reference images."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import new_folder

#: Ids of an image before the next document starts a new one.
IMAGE_IDS = 1 << 19


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end_id: int = 2, image_ids: int = IMAGE_IDS) -> None:
    """Encode whole texts and write their ids, ascending by doc_id, under ``path``.

    A row of the written table is one image of about ``image_ids`` ids: part and
    seq say its place in the whole order, n_docs and n_tokens what it holds, and
    image the bytes. Parquet's row-group statistics on these columns let a
    reader open only the images it needs; Spark's commit protocol makes a rerun
    task safe. Ranges of doc_id are dealt out by sampling, so no task gets all.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select("doc_id", "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")

    def images(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        from .pfor import encode
        from .tokens import units_of

        units, end, part = units_of(tokenizer), end_id.to_bytes(4, "little"), TaskContext.get().partitionId()
        held, ids, size, seq = [], [], 0, 0

        def image():
            flat = np.frombuffer(b"".join(ids), "<u4")
            data = encode(flat, held, np.array([len(x) // 4 for x in ids]))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(held)], pa.int64()), pa.array([size], pa.int64()), pa.array([data], pa.binary())], names=["part", "seq", "n_docs", "n_tokens", "image"])

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                own = units.encode(text.as_py()) + end
                held.append(doc.as_py())
                ids.append(own)
                size += len(own) // 4
                if size >= image_ids:
                    yield image()
                    held, ids, size, seq = [], [], 0, seq + 1
        if held:
            yield image()

    ordered.mapInArrow(images, "part int, seq int, n_docs bigint, n_tokens bigint, image binary").write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files under ``path``.

    start counts the ids of all documents before it. The places of the images
    come from one total per written part (as many rows as write tasks).
    """
    kind = "part int, seq int, n_docs bigint, n_tokens bigint, image binary"
    files = spark.read.schema(kind).parquet(path)
    totals = sorted((r["part"], r["n"]) for r in files.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    base, before = [], 0
    for part, n in totals:
        base.append((part, before))
        before += n
    from pyspark.sql import Window as W

    earlier = F.coalesce(F.sum("n_tokens").over(W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    places = files.select("part", "seq", "n_tokens").withColumn("_earlier", earlier)  # without the images
    places = places.join(F.broadcast(spark.createDataFrame(base, "part int, _base bigint")), "part").select("part", "seq", (F.col("_base") + F.col("_earlier")).alias("base"))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        from .pfor import Reader

        for batch in batches:
            for part, seq, image in zip(*(batch.column(i) for i in range(3)), strict=True):
                reader = Reader(image.as_py())
                ids, ends = reader.ids().tobytes(), np.cumsum(reader.lengths.astype(np.int64))
                starts = ends - reader.lengths
                crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                size = len(crc)
                yield pa.RecordBatch.from_arrays([pa.array([part.as_py()] * size, pa.int32()), pa.array([seq.as_py()] * size, pa.int32()), pa.array(reader.doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(reader.lengths.astype(np.int64), pa.int64()), pa.array(crc, pa.int64())], names=["part", "seq", "doc_id", "_start", "n_tokens", "ids_crc32"])

    rows = files.select("part", "seq", "image").mapInArrow(documents, "part int, seq int, doc_id bigint, _start bigint, n_tokens bigint, ids_crc32 bigint")
    return rows.join(places, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("_start")).alias("start"), "n_tokens", "ids_crc32")


def token_round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write the ids of all documents and read them back.

    Input: doc_id, text; other columns are left aside. A null or empty text has
    the end id alone; rows with one doc_id follow each other by text; null ids
    come first. An empty table gives an empty result.
    """
    path = new_folder(docs.sparkSession, "tokens")
    write_tokens(docs, tokenizer, path, end_id)
    return read_tokens(docs.sparkSession, path)
