"""Documents and their chunks in hash buckets on disk, changed batch by batch; only the buckets of changed files are rewritten."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ("tenant", "file_uid")
#: What says which of two changes of a file is newer, in this order; null is the least.
ORDER = "source_version string, ts string, event_id string"
FIELDS = "mime string, name string, path string, status string, error string"
CHANGES = f"tenant string, file_uid string, {ORDER}, {FIELDS}, content_md string, deleted boolean"
STATE = (
    "tenant string, file_uid string, "
    f"last struct<{', '.join(c.replace(' ', ':') for c in ORDER.split(', '))},deleted:boolean,{','.join(c.replace(' ', ':') for c in FIELDS.split(', '))}>, "
    f"text struct<{','.join(c.replace(' ', ':') for c in ORDER.split(', '))},content:string>, gone struct<{','.join(c.replace(' ', ':') for c in ORDER.split(', '))}>"
)
LEDGER = "turn long, batch string, gen string, buckets array<int>"


def _names(ddl: str) -> list[str]:
    return [c.split(" ")[0] for c in ddl.split(", ")]


class FileStore:
    """Documents and chunks of all tenants under ``path``.

    A file lies in the bucket of its key's hash. ``apply`` folds a batch of changes into the buckets it touches: these are
    written anew, in folders of their own, and count once the ledger has the batch; a batch that is there already changes
    nothing. A writer that dies leaves files that nobody reads, and the batch can come again. One writer at a time.

    The result does not depend on the order of batches, nor on rows that repeat: of a file the newest change counts, by
    version, then time stamp, then event, then all other fields; a change without a text keeps the newest text since the
    file was last deleted; a deletion stays on record, so that an older change that comes late does not bring a file back.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 1024, chunker: Callable[[DataFrame], DataFrame] | None = None, chunk_schema: str = "ordinal int, text string") -> None:
        """``chunker`` maps documents (tenant, file_uid, content_md) to chunks (tenant, file_uid, *chunk_schema)."""
        self.spark, self.path, self.buckets, self.chunker, self.chunk_schema = spark, path.rstrip("/"), buckets, chunker, chunk_schema

    # what is there

    def ledger(self) -> DataFrame:
        """Rows (turn, batch, gen, buckets) of the batches that are done."""
        return self.spark.read.schema(LEDGER).parquet(f"{self.path}/ledger")

    def _done(self) -> list:
        try:
            return self.ledger().orderBy("turn").collect()  # one short row a batch
        except Exception as error:
            if "PATH_NOT_FOUND" in str(error):
                return []
            raise

    def _table(self, kind: str, schema: str, done: list, only: list[int] | None = None) -> DataFrame:
        """The current rows of all buckets, or of ``only`` some: the folder that each bucket was last written to."""
        current = {b: r["gen"] for r in done for b in r["buckets"]}
        wanted = [f"{b} {current[b]}" for b in (current if only is None else only) if b in current]
        if not wanted:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(f"{schema}, bucket int, gen string").parquet(f"{self.path}/{kind}")
        return rows.filter(F.concat_ws(" ", "bucket", "gen").isin(wanted)).select(*_names_of(schema))  # on folders only: others are not listed as input

    def documents(self) -> DataFrame:
        """Rows (tenant, file_uid, source_version, mime, name, path, status, error, content_md) of the files that are there."""
        rows = self._table("files", STATE, self._done()).filter("not last.deleted")
        return rows.select(*KEY, "last.source_version", *(f"last.{c}" for c in _names(FIELDS)), _content().alias("content_md"))

    def chunks(self) -> DataFrame:
        """Rows (tenant, file_uid, *chunk_schema) of the files that are there."""
        schema = f"tenant string, file_uid string, {self.chunk_schema}"
        return self._table("chunks", schema, self._done())

    # changes

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*KEY), F.lit(self.buckets)).cast("int")

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Fold in a batch of changes (CHANGES; columns that are missing are null); false if it was done already."""
        done = self._done()
        if any(r["batch"] == batch for r in done):
            return False
        given = changes.select(*(F.col(c).cast(t) if c in changes.columns else F.lit(None).cast(t).alias(c) for c, t in (x.split(" ") for x in CHANGES.split(", "))))
        given = _state(given).withColumn("bucket", self._bucket()).persist()
        try:
            touched = sorted(r[0] for r in given.select("bucket").distinct().collect())  # at most all buckets
            if touched:
                self._rewrite(batch, given, touched, done)
        finally:
            given.unpersist()
        return True

    def _rewrite(self, batch: str, given: DataFrame, touched: list[int], done: list) -> None:
        gen = uuid.uuid4().hex
        old = self._table("files", STATE, done, touched)
        new = _folded(old.unionByName(given.drop("bucket")))
        self._write(new, "files", gen)
        if self.chunker:
            now = self.spark.read.schema(f"{STATE}, bucket int, gen string").parquet(f"{self.path}/files").filter((F.col("gen") == gen) & F.col("bucket").isin(touched))
            text = now.filter("not last.deleted").withColumn("content_md", _content()).filter("content_md is not null")
            before = old.filter("not last.deleted").withColumn("content_md", _content()).filter("content_md is not null")
            same = text.select(*KEY, "text").join(before.select(*KEY, F.col("text").alias("was")), list(KEY)).filter("text = was").select(*KEY)
            schema = f"tenant string, file_uid string, {self.chunk_schema}"
            kept = self._table("chunks", schema, done, touched).join(same, list(KEY), "left_semi")
            fresh = self.chunker(text.join(same, list(KEY), "left_anti").select(*KEY, "content_md"))
            self._write(kept.unionByName(fresh.select(*_names_of(schema))), "chunks", gen)
        turn = max((r["turn"] for r in done), default=-1) + 1
        self.spark.createDataFrame([(turn, batch, gen, touched)], LEDGER).coalesce(1).write.mode("append").parquet(f"{self.path}/ledger")

    def _write(self, rows: DataFrame, kind: str, gen: str) -> None:
        out = rows.withColumns({"bucket": self._bucket(), "gen": F.lit(gen)})
        out.repartition("bucket").write.mode("append").partitionBy("bucket", "gen").parquet(f"{self.path}/{kind}")

    def handler(self, load: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, DataFrame, int], None]:
        """What streaming.ingest.ingest() calls: ``load`` maps events to changes; deletions are put on record."""

        def handle(convert: DataFrame, delete: DataFrame, number: int) -> None:
            gone = delete.select(*KEY, F.col("version").alias("source_version"), "ts", "event_id", F.lit(True).alias("deleted"))
            self.apply(f"stream-{number}", load(convert).unionByName(gone, allowMissingColumns=True))

        return handle

    def outdated(self) -> DataFrame:
        """Rows (kind, bucket, gen) of folders that no reader wants any more, of batches done: a clean-up may remove them."""
        done = self._done()
        current = {b: r["gen"] for r in done for b in r["buckets"]}
        old = [(kind, b, r["gen"]) for r in done for b in r["buckets"] if current[b] != r["gen"] for kind in ("files", "chunks")]
        return self.spark.createDataFrame(old, "kind string, bucket int, gen string")


def _names_of(schema: str) -> list[str]:
    """Column names of a schema in words, nested ones included as one."""
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema).names


def _order(prefix: str = "") -> Column:
    return F.struct(*(F.col(f"{prefix}{c}").alias(c) for c in _names(ORDER)))


def _content() -> Column:
    """The text of a file, unless it is older than the file's last deletion."""
    of = F.struct(*(F.col(f"text.{c}") for c in _names(ORDER)))
    return F.when(F.col("gone").isNull() | (of > F.col("gone")), F.col("text.content"))


def _state(changes: DataFrame) -> DataFrame:
    """Each change as the state of a file that nothing else has happened to."""
    order = [F.col(c) for c in _names(ORDER)]
    deleted = F.coalesce("deleted", F.lit(False))
    rows = changes.filter(F.col("file_uid").isNotNull()).select(
        F.coalesce("tenant", F.lit("default")).alias("tenant"), "file_uid",
        F.struct(*order, deleted.alias("deleted"), *_names(FIELDS)).alias("last"),
        F.when(~deleted & F.col("content_md").isNotNull(), F.struct(*order, F.col("content_md").alias("content"))).alias("text"),
        F.when(deleted, F.struct(*order)).alias("gone"),
    )
    return _folded(rows)


def _folded(states: DataFrame) -> DataFrame:
    """One state a file: the greatest of each part, whatever the order of rows. Structs compare field by field, null first."""
    return states.groupBy(*KEY).agg(*(F.max(c).alias(c) for c in ("last", "text", "gone")))
