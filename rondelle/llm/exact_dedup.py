"""Exact dedup: a streaming aggregation whose disk-backed state never expires."""

from __future__ import annotations

from contextlib import contextmanager
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import ASCII_SPACE, drop_folder, file_system, join_sized, new_folder, numbered, stash, text_or_empty

#: State of each digest lives in RocksDB on the executors' disks, with change
#: logs in the shared folder from which a lost executor's part is rebuilt.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    # else each of the many small stores takes megabytes of disk in advance
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}

#: Bits of the filter that says which digests may have copies: 8 MB, whatever the corpus.
FILTER_BITS = 1 << 26

ADDED = ["keep_id", "group_size", "kept", "text_sha256"]
FIRST = "struct<run: int, no_id: boolean, doc_id: bigint, file: string, row: bigint>"


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def normalised(text: str = "text") -> Column:
    """Each run of ASCII white space becomes one space; null counts as empty."""
    return F.regexp_replace(text_or_empty(text), ASCII_SPACE, " ")


def digest() -> Column:
    """SHA-256 of the normalised text; not nullable, so joins on it need no null test (which would hash twice)."""
    return F.coalesce(F.unhex(F.sha2(normalised(), 256)), F.lit(bytearray()))


def rank() -> Column:
    """Order of the rows of a digest: earlier runs, smallest doc_id (null ids last), then content locator (file, row)."""
    return F.struct("run", F.col("doc_id").isNull().alias("no_id"), "doc_id", "file", "row")


def located(docs: DataFrame, *columns: str | Column) -> DataFrame:
    """Digest, content locator and the given columns of a plain scan."""
    return docs.select(digest().alias("digest"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), *columns)


def plain(docs: DataFrame) -> DataFrame:
    """``docs`` if it is a bare scan of files, whose rows have a locator; else a copy of its rows in the shared folder."""
    if docs._jdf.queryExecution().analyzed().nodeName() == "LogicalRelation" and docs.inputFiles():
        return docs
    return stash(docs, "rows")


def digests(spark: SparkSession, at: str, files_per_batch: int | None = None) -> DataFrame:
    """Stream the rows under ``at``/rows that no earlier call has seen through the state kept under ``at``.

    Returns (digest, first, copies) of every digest among them: the identifier
    and content locator of its first row, and its copies, both over all runs.
    Copies meet map-side before the state is touched, so a digest that a third
    of all rows share costs one state row a task. State is kept for ever.
    """
    known = numbered(spark, f"{at}/states", "batch=")
    reader = spark.readStream.schema("digest binary, doc_id bigint, file string, row bigint, run int").option("maxFileAge", "36500d")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    state = reader.parquet(f"{at}/rows").groupBy("digest").agg(F.min(rank()).alias("first"), F.count("*").alias("copies"))

    def keep(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{at}/states/batch={batch}")  # a batch that runs again writes the same rows

    with settings(spark, STATE):
        query = state.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    kind = f"digest binary, first {FIRST}, copies bigint"
    new = [b for b in numbered(spark, f"{at}/states", "batch=") if b not in known]
    if not new:
        return spark.createDataFrame([], kind)
    states = spark.read.schema(kind).parquet(*[f"{at}/states/batch={b}" for b in new])
    if len(new) > 1:
        states = states.groupBy("digest").agg(F.min("first").alias("first"), F.max("copies").alias("copies"))
    return states


def _place() -> Column:
    """Place of a digest in the filter, from 1 on."""
    return F.coalesce(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("bigint"), F.lit(0)) % FILTER_BITS + 1


def copy_filter(states: DataFrame) -> DataFrame:
    """(bucket, bits): a bit for each digest that has copies, in 4 KB pieces; FILTER_BITS / 32768 rows at most."""
    at = states.where("copies > 1").select(_place().alias("at"))
    return stash(at.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")), "filter")


def split_by_filter(rows: DataFrame, bits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose digest may have copies, and those that have none for certain.

    Digests that share a bit with one that has copies are among the first;
    nothing depends on how many there are but the rows that move.
    """
    flagged = rows.withColumn("_at", _place()).withColumn("_bucket", F.bitmap_bucket_number("_at"))
    flagged = flagged.join(F.broadcast(bits), F.col("_bucket") == F.col("bucket"), "left")  # 8 MB at most
    bit = F.bitmap_bit_position("_at")
    byte = F.conv(F.hex(F.expr("substring(bits, CAST(bitmap_bit_position(_at) div 8 AS INT) + 1, 1)")), 16, 10).cast("int")
    hit = F.coalesce(F.expr("0") != byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), (bit % 8).cast("int"))), F.lit(False))
    return flagged.where(hit).select(*rows.columns), flagged.where(~hit).select(*rows.columns)


def _retained(spark: SparkSession, states: DataFrame, run: int) -> DataFrame | None:
    """The texts that earlier runs have kept of digests met again, read at their locators; the files must still be there."""
    known = states.where(F.col("first.run") < run)
    paths = [r["file"] for r in known.select("first.file").distinct().collect()]  # a list of files, as any scan has
    if not paths:
        return None
    found = [p if (at := file_system(spark, p))[1].exists(at[0]) else unquote(p) for p in paths]
    texts = located(spark.read.schema("doc_id bigint, text string").parquet(*found), "doc_id", "text")
    wanted = known.select("digest", F.col("first.file").alias("file"), F.col("first.row").alias("row"), F.col("first.run").alias("run"))
    return texts.join(wanted, ["digest", "file", "row"]).select("digest", "text", "run", "doc_id", "file", "row")


def decide(docs: DataFrame, state: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """file, row (content locator), doc_id, keep_id, group_size, kept, text_sha256 for each row of a plain scan; see exact_groups."""
    return _decide(docs, state, files_per_batch)[0].drop("digest")


def _decide(docs: DataFrame, state: str | None, files_per_batch: int | None) -> tuple[DataFrame, DataFrame]:
    spark = docs.sparkSession
    at = state or new_folder(spark, "digests")
    runs = numbered(spark, f"{at}/rows", "run=")
    run = runs[-1] + 1 if runs else 0
    located(docs, "doc_id").write.parquet(f"{at}/rows/run={run}")
    states = digests(spark, at, files_per_batch)
    if state is None:
        drop_folder(spark, f"{at}/checkpoint")  # no later run goes on from here
    bits = copy_filter(states)
    # full bytes of hits: texts of a digest that may have copies, copies met map-side before they move
    hits = split_by_filter(located(docs, "doc_id", "text"), bits)[0].withColumn("run", F.lit(run))
    earlier = _retained(spark, states, run) if run else None
    if earlier is not None:
        hits = hits.unionByName(earlier)
    hits = hits.withColumn("_text", normalised())
    texts = hits.groupBy("digest", "_text").agg(F.lit(1).alias("_one"))
    clashes = texts.groupBy("digest").agg(F.count("*").alias("_texts")).where("_texts > 1").select("digest")
    mine = spark.read.schema("digest binary, doc_id bigint, file string, row bigint").parquet(f"{at}/rows/run={run}").withColumn("run", F.lit(run))
    everything = spark.read.schema("digest binary").parquet(f"{at}/rows").count()
    found = join_sized(mine, states, "digest", "copies", everything)
    if clashes.limit(1).count():
        taken = hits.join(clashes, "digest", "left_semi")
        own = taken.groupBy("digest", "_text").agg(F.min(rank()).alias("_first"), F.count("*").alias("_copies"))
        apart = taken.where(F.col("run") == run).select("digest", "_text", "file", "row").join(own, ["digest", "_text"]).select("file", "row", "_first", "_copies")
        found = found.join(apart, ["file", "row"], "left").withColumn("first", F.coalesce("_first", "first")).withColumn("copies", F.coalesce("_copies", "copies"))
    out = found.select("file", "row", "doc_id", F.col("first.doc_id").alias("keep_id"), F.col("copies").alias("group_size"), rank().eqNullSafe(F.col("first")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "digest")
    return out, bits


def exact_groups(docs: DataFrame, state: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """Each row of ``docs`` with the row that stays for its text.

    Input: doc_id and text; other columns are kept. A plain scan of files is
    read as it is, exactly the files that it reads; anything else is written to
    the shared folder first. Adds (or replaces) keep_id, group_size, kept,
    text_sha256. Texts are equal when identical after each run of ASCII white
    space has become one space, however long they are; null counts as empty.
    The smallest doc_id stays; of rows repeated with that doc_id the one with
    the first content locator; null ids give way to any id. An empty table
    gives an empty result.

    ``state`` is a folder from which a later call goes on: a text that an
    earlier run has met stays dropped for ever, whatever the ids, keep_id is
    that run's, and group_size counts all runs. Without it each call begins anew.

    The digest finds hits, and then whole texts decide: the texts of hits alone
    are grouped by digest and text, those kept by earlier runs read at their
    locators, and a digest of two texts is taken apart. Rows without copies stay
    where they are; only rows whose digest may have copies are joined.
    """
    docs = plain(docs)
    decided, bits = _decide(docs, state, files_per_batch)
    columns = [c for c in docs.columns if c not in ADDED]
    rows = docs.select(F.struct(*columns).alias("doc"), digest().alias("digest"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    some, alone = split_by_filter(rows, bits)
    own = [F.col("doc.doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")]
    hits = some.select("doc", "file", "row").join(split_by_filter(decided, bits)[0].select("file", "row", *ADDED), ["file", "row"])
    return alone.select("doc.*", *own).unionByName(hits.select("doc.*", *ADDED))


def group_ids(docs: DataFrame, state: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of each row of ``docs``, without the other columns; see exact_groups."""
    return decide(plain(docs), state, files_per_batch).select("doc_id", *ADDED)
