"""Exact dedup against a persistent digest index, a table bucketed and sorted by hash."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscope.llm.common import drop_rows, fresh, materialize, remove_folder, scratch_path, text_mark

SCHEMA = "digest binary, keep_id long, group_size long, batch string, written string"
LAYOUT = "folder string, buckets int, generation long, n_rows long, batch string, written string"
#: Rows of a bucket that call for more buckets, and appends after which the files of all buckets are joined.
FULL, APPENDS = 8_000_000, 32


def text_digest(text: Column) -> Column:
    """SHA-256 of the text in UTF-8; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


class DigestIndex:
    """One row for each distinct text so far, in buckets of files sorted by digest.

    `path` must be in storage that all executors share. The index is what stands at its path, whatever the session's
    catalog knows and whatever another handle has done meanwhile: the table `layout` there is read anew at each call. It
    names the folder that holds the rows, their number of buckets and the writes that were completed. Rows of a write
    that isn't named there don't count, so a write that dies halfway leaves no trace; the note is written last.

    When buckets have grown too full, or too many small files were appended, the rows are dealt anew into another
    folder, `layout` names that once it is complete, and the old folder is removed. `buckets` holds for an index that
    doesn't exist yet; with `new` the path is known to be free. One writer at a time: two that append at once may both
    take a text for new.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, new: bool = False):
        self.spark, self.path = spark, path.rstrip("/")
        if new or not self._layouts():
            self._note(uuid.uuid4().hex, buckets, 0, 0)
        self._open()

    def _layouts(self) -> list:
        try:
            return self.spark.read.schema(LAYOUT).parquet(f"{self.path}/layout").collect()  # a row for each batch
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return []

    def _note(self, folder: str, buckets: int, generation: int, n_rows: int, batch: str | None = None, written: str | None = None) -> None:
        row = self.spark.createDataFrame([(folder, buckets, generation, n_rows, batch, written)], LAYOUT)
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/layout")

    def _open(self) -> None:
        rows = self._layouts()
        self.generation = max(r["generation"] for r in rows)
        own = [r for r in rows if r["generation"] == self.generation]
        self.folder, self.buckets = own[0]["folder"], own[0]["buckets"]
        self.batches = {r["batch"] for r in rows if r["batch"] is not None}
        self.written = sorted(r["written"] for r in own if r["n_rows"])
        self.n_rows = sum(r["n_rows"] for r in own)
        self.table = f"digests_{self.folder}"
        self._declare(self.table, self.folder, self.buckets)
        self.spark.catalog.refreshTable(self.table)  # another session may have appended

    def _declare(self, table: str, folder: str, buckets: int) -> None:
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {table} (digest BINARY, keep_id BIGINT, group_size BIGINT, batch STRING, written STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.path}/{folder}'"
        )

    def _dealt(self, rows: DataFrame, buckets: int) -> DataFrame:
        """`rows` dealt like the index, so that a merge join on the digest shuffles no row of the index."""
        return rows.repartition(buckets, "digest")

    def _append(self, rows: DataFrame, batch: str) -> None:
        """Append `rows` (digest, keep_id, group_size); they count from the moment the layout names their write."""
        n, written = rows.count(), uuid.uuid4().hex
        if n:
            own = rows.select("digest", "keep_id", "group_size", F.lit(batch).alias("batch"), F.lit(written).alias("written"))
            self._dealt(own, self.buckets).sortWithinPartitions("digest").write.insertInto(self.table)
        self._note(self.folder, self.buckets, self.generation, n, batch, written)
        self._open()
        if self.n_rows > FULL * self.buckets or len(self.written) > APPENDS:
            self.rebuild(max(self.buckets, 2 * (self.n_rows // FULL)))

    def rebuild(self, buckets: int) -> None:
        """Deal all rows into `buckets` buckets of one file each, in a folder of their own; the old folder goes."""
        self._open()
        folder, written = uuid.uuid4().hex, uuid.uuid4().hex
        old, old_table = self.folder, self.table
        self._declare(f"digests_{folder}", folder, buckets)
        whole = self.rows().withColumn("written", F.lit(written))
        self._dealt(whole, buckets).sortWithinPartitions("digest").write.insertInto(f"digests_{folder}")
        self._note(folder, buckets, self.generation + 1, self.n_rows, None, written)
        self._open()
        self.spark.sql(f"DROP TABLE IF EXISTS {old_table}")
        remove_folder(self.spark, f"{self.path}/{old}")

    def close(self) -> None:
        """Take the index out of the session's catalog; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def rows(self) -> DataFrame:
        """The index as a bucketed table: the rows of completed writes."""
        return self.spark.table(self.table).where(F.col("written").isin(self.written))

    def dedup(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
        """doc_id, keep_id, group_size, kept, text_sha256, mark for every row of `docs`, whose new texts are appended.

        Equal texts are one group; its row with the largest doc_id stays, unless the index knew the text from an
        earlier batch: then that document stays and none of this batch. group_size counts the rows of the batch in
        which the text first came. Of repeated rows with the same doc_id one stays. A null text counts as empty, a
        null doc_id as smaller than any other. An empty table gives an empty result and appends no row. Other
        columns are ignored. mark is text_mark of the text.

        `batch` names the batch. A batch that was appended before is not appended again, and gets the answer it got
        then: a run that failed after the append may be repeated under the same name. Without a name each call is a
        batch of its own.
        """
        self._open()
        digests = materialize(
            docs.select(
                F.monotonically_increasing_id().alias("row"),
                F.col(id_col).cast("long").alias("doc_id"),
                text_digest(F.col(text_col)).alias("digest"),
                text_mark(F.col(text_col)).alias("mark"),
            ),
            "digests",
        )
        name = uuid.uuid4().hex if batch is None else batch
        best = F.max(F.struct(F.col("doc_id"), F.col("row")))
        groups = digests.groupBy("digest").agg(best.alias("best"), F.count("*").alias("n"))
        groups = materialize(self._dealt(groups, self.buckets), "batch-groups")
        old = self.rows().where(~F.col("batch").eqNullSafe(name)).hint("merge")
        new = self._dealt(groups, self.buckets).join(old, "digest", "left_anti").select(
            "digest", F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size"), F.col("best.row").alias("keep_row")
        )
        new = materialize(new, "new")
        past = self._dealt(groups.select("digest"), self.buckets).join(old, "digest")
        past = past.select("digest", "keep_id", "group_size", F.lit(None).cast("long").alias("keep_row"))
        known = materialize(new.unionByName(past), "known")
        if batch is None or name not in self.batches:
            self._append(new.select("digest", "keep_id", "group_size"), name)
        return digests.join(known, "digest").select(
            "doc_id",
            "keep_id",
            "group_size",
            F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False)).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
            "mark",
        )


def scratch_index(spark: SparkSession, buckets: int = 64) -> DigestIndex:
    """An index of its own in the scratch folder, for one run over one table."""
    return DigestIndex(spark, scratch_path(spark, "index"), buckets, new=True)


def dedup_once(docs: DataFrame) -> DataFrame:
    """A result of dedup over `docs` alone, against an empty index."""
    index = scratch_index(docs.sparkSession)
    found = index.dedup(docs)
    index.close()
    return found


def keep_first(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """The rows of `docs` (doc_id, text, ...) that `decisions` (a result of dedup over them) keeps; one of any repeated
    rows, told by id and text.

    Null texts count as empty, a null doc_id is an id like others; an empty table gives an empty result. All columns are
    kept, whatever their names; of repeated rows that differ in other columns any one stays.
    """
    rows = decisions.groupBy("doc_id", "mark").agg(F.bool_or("kept").alias("kept"), F.count("*").alias("n"))
    rows = materialize(rows.where("not kept or n > 1"), "dropped")
    stays = drop_rows(docs, rows.where("not kept"))
    twice = rows.where("kept").select("doc_id", "mark")
    if twice.isEmpty():
        return stays
    doc_id, mark = fresh("id"), fresh("mark")
    twice = twice.select(F.col("doc_id").alias(doc_id), F.col("mark").alias(mark))
    same = stays["doc_id"].eqNullSafe(twice[doc_id]) & (text_mark(stays["text"]) == twice[mark])
    repeated = stays.join(twice, same, "left_semi").withColumn(mark, text_mark(F.col("text"))).dropDuplicates(["doc_id", mark]).drop(mark)
    return drop_rows(stays, rows.where("kept")).unionByName(repeated)
