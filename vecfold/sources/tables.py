"""The collections and embeddings tables as Parquet.

Embeddings are partitioned by ``vector_type``, ``collection_id`` and ``bucket``, a hash of the id: the
choice of precision and collection is partition pruning, and a change writes in proportion to itself.
(In an indexed collection the bucket is the number of the cell whose centroid is nearest.)
New rows are appended as files of a folder of their own; changed rows are replaced with their bucket,
and only the touched buckets are read and written. A collection's buckets follow its size: once it has
grown fourfold it is dealt out anew, which adds up to a constant per row.

A change never overwrites files it reads. A commit writes its rows to a new folder, and what changes of
the catalog to others: the collections, the pieces (which folder holds which bucket), the last batch of
each stream. Then it publishes the generation: a pointer file, named by its number and created only if
it is not there, names the folders of these three tables. The highest pointer is the table, so a commit is all or nothing,
of two writers one wins, and what a failed write leaves behind is never read. Creation must be atomic:
HDFS and local file systems give that, an object store only with conditional writes.
"""

import time
import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecfold.operators.fields import column_name, stored_value
from vecfold.schemas import COLLECTIONS, EMBEDDINGS

# The catalog as stored: its rows plus the number of buckets of each collection (null if it has no rows).
CATALOG = T.StructType([*COLLECTIONS.fields, T.StructField("buckets", T.IntegerType())])
# Rows of a bucket in a folder; ``written`` is the number of buckets of the collection there.
PIECES = "id long, vector_type string, bucket int, folder string, rows long, written int"
STREAMS = "stream string, batch long"
# Cells of indexed collections, whose rows lie in the bucket of the nearest centroid.
CELLS = "id long, bucket int, metric string, centroid array<double>, radius double"
# Metadata fields that have a column of their own in what is written from then on.
FIELDS = "field string"
STORED = T.StructType([*EMBEDDINGS.fields, T.StructField("bucket", T.IntegerType())])

# A pointer that is still empty after this time belongs to a writer that died.
PUBLISHING_SECONDS = 600

# Buckets of at least so many rows up to FEW_BUCKETS, then of so many bytes.
BUCKET_ROWS = 512
FEW_BUCKETS = 512
BUCKET_BYTES = 64 * 1024 * 1024
# A bucket in so many folders is put together when its collection is next written.
MERGED_PIECES = 16
# With fields as columns files are sorted by them, and a bucket's file has several row groups to choose from.
ROW_GROUP_BYTES = 8 * 1024 * 1024


def bucket_count(rows: int, dimensions: int) -> int:
    """Buckets of a collection with so many rows, a power of two."""
    by_bytes = rows * (4 * dimensions + 200) // BUCKET_BYTES
    wanted = max(1, min(FEW_BUCKETS, rows // BUCKET_ROWS), by_bytes)
    return 1 << (wanted - 1).bit_length()


def bucket_of(buckets: Column) -> Column:
    return F.pmod(F.xxhash64("embedding_id"), buckets).cast("int")


class StaleWrite(Exception):
    """Another commit came first."""


class Tables:
    """One collections table and its embeddings below ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def _file(self, path: str):
        """Spark's own handle of a path and its file system, which may be any that Spark reads."""
        jvm = self.spark._jvm.org.apache.hadoop.fs
        handle = jvm.Path(path)
        return handle, handle.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _pointers(self) -> list[tuple[int, int, float]]:
        """(number, bytes, time of change) of every pointer; one listing, no scan of the catalog."""
        folder, system = self._file(f"{self.root}/current")
        if not system.exists(folder):
            return []
        found = [(f.getPath().getName(), f.getLen(), f.getModificationTime() / 1000) for f in system.listStatus(folder)]
        return sorted((int(name), size, at) for name, size, at in found if name.isdigit())

    def generation(self) -> int:
        """The current generation, 0 for a table that has none yet."""
        return max((number for number, size, _ in self._pointers() if size), default=0)

    def _publish(self, current: int, folders: dict[str, str]) -> int:
        last, size, at = self._pointers()[-1:][0] if self._pointers() else (0, 1, 0.0)
        if size and last != current:
            raise StaleWrite(f"the table is at generation {last}, not {current}")
        if not size and time.time() - at < PUBLISHING_SECONDS:
            raise StaleWrite("another commit is being published")
        target, system = self._file(f"{self.root}/current/{last + 1:012d}")
        try:
            out = system.create(target, False)
        except Py4JJavaError as error:
            if "FileAlreadyExists" in str(error.java_exception):
                raise StaleWrite("another commit came first") from None
            raise
        out.write(bytearray("\n".join(f"{part}={folder}" for part, folder in folders.items()).encode()))
        out.close()
        return last + 1

    def _folders(self, generation: int) -> dict[str, str]:
        """The folder of each table of a generation."""
        if generation == 0:
            return {}
        pointer, system = self._file(f"{self.root}/current/{generation:012d}")
        stream = system.open(pointer)
        text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return dict(line.split("=") for line in text.split("\n"))

    def _part(self, part: str, schema, generation: int | None = None) -> DataFrame:
        """One of the tables of a generation: collections, pieces or streams."""
        folder = self._folders(self.generation() if generation is None else generation).get(part)
        if folder is None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/catalog/{folder}")

    def catalog(self, generation: int | None = None) -> DataFrame:
        """The collections with the number of their buckets."""
        return self._part("collections", CATALOG, generation)

    def pieces(self, generation: int | None = None) -> DataFrame:
        return self._part("pieces", PIECES, generation)

    def cells(self, collections: Sequence[int], generation: int | None = None) -> DataFrame:
        """The cells of those of the collections that are indexed."""
        return self._part("cells", CELLS, generation).where(F.col("id").isin(list(collections)))

    def last_batch(self, stream: str, generation: int | None = None) -> int | None:
        """The last batch of a stream that a commit holds."""
        row = self._part("streams", STREAMS, generation).where(F.col("stream") == stream).first()
        return None if row is None else row.batch

    def fields(self, generation: int | None = None) -> list[str]:
        """The metadata fields stored as columns too."""
        generation = self.generation() if generation is None else generation
        if "fields" not in self._folders(generation):
            return []
        return sorted(row.field for row in self._part("fields", FIELDS, generation).collect())

    def collections(self, generation: int | None = None) -> DataFrame:
        """The catalog, as of now or of a generation read before."""
        return self.catalog(generation).select(*COLLECTIONS.names)

    def embeddings(
        self,
        generation: int | None = None,
        collections: Sequence[int] | DataFrame | None = None,
        buckets: Sequence[tuple[int, int]] | None = None,
        fields: Sequence[str] = (),
    ) -> DataFrame:
        """Rows of both precisions, of all collections, those with an id among ``collections`` (ids, or a
        frame with ``id``), or those of (collection, bucket) pairs; further filters prune partitions.
        ``fields`` are metadata fields whose columns come too.

        A row per collection and folder comes to the driver, of the collections asked for.
        """
        return self.bucketed(generation, collections, buckets, fields).select(*EMBEDDINGS.names, *map(column_name, fields))

    def bucketed(self, generation=None, collections=None, buckets=None, fields=()) -> DataFrame:
        """The same with ``bucket``."""
        schema = T.StructType([*STORED.fields, *[T.StructField(column_name(f), T.StringType()) for f in fields]])
        pieces = self.pieces(generation)
        if isinstance(collections, DataFrame):
            pieces = pieces.join(collections.select("id"), "id", "left_semi")
        elif collections is not None:
            pieces = pieces.where(F.col("id").isin(list(collections)))
        if buckets is not None:
            pieces = pieces.join(self._pairs(buckets), ["id", "bucket"], "left_semi")
        held = pieces.groupBy("folder", "vector_type", "id").agg(F.count(F.lit(1)).alias("live"), F.max("written").alias("written"), F.collect_list("bucket").alias("buckets"))
        whole = F.col("live") == F.col("written")
        base, paths = f"{self.root}/embeddings", []
        for r in held.select("folder", "vector_type", "id", F.when(~whole, F.col("buckets")).alias("buckets")).collect():
            of_collection = f"{base}/folder={r.folder}/vector_type={r.vector_type}/collection_id={r.id}"
            paths += [of_collection] if r.buckets is None else [f"{of_collection}/bucket={b}" for b in r.buckets]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", base).parquet(*paths).select(*schema.names)

    def _pairs(self, buckets: Sequence[tuple[int, int]]) -> DataFrame:
        return F.broadcast(self.spark.createDataFrame(list(buckets), "id long, bucket int"))

    def sizes(self, collections: Sequence[int], generation: int) -> dict:
        """Per collection asked for, by id: dimensions, buckets, rows, and the buckets in many folders."""
        of = F.col("id").isin(list(collections))
        held = self.pieces(generation).where(of).groupBy("id", "bucket").agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("pieces"))
        many = F.collect_list(F.when(F.col("pieces") >= MERGED_PIECES, F.col("bucket")))
        held = held.groupBy("id").agg(F.sum("rows").alias("rows"), many.alias("many"))
        known = self.catalog(generation).where(of).join(held, "id", "left")
        return {r.id: r for r in known.select("id", "dimensions", "buckets", F.coalesce("rows", F.lit(0)).alias("rows"), "many").collect()}

    def commit(
        self,
        catalog: DataFrame | None = None,
        whole: DataFrame | None = None,
        collection_ids: Sequence[int] = (),
        expect: int | None = None,
        *,
        buckets: dict[int, int] | None = None,
        added: DataFrame | None = None,
        replaced: Sequence[tuple[int, int]] = (),
        kept: DataFrame | None = None,
        stream: tuple[str, int] | None = None,
        cells: DataFrame | None = None,
        fields: Sequence[str] | None = None,
    ) -> int:
        """Store ``catalog``, if it changes, and a change of the rows, computed from generation ``expect``.

        ``whole`` is the full new content of the collections in ``collection_ids``, which are dealt to
        buckets anew. ``added`` are further rows of collections that have buckets, ``kept`` (with their
        ``bucket``) what stays of the (collection, bucket) pairs in ``replaced``. ``buckets`` gives the number
        of buckets of collections with ``whole`` (counted if not given) or ``added`` rows. ``stream`` names a
        batch that this commit makes part of the table. ``cells`` are the new cells of the collections
        they name; rows that come with their ``bucket`` keep it. ``fields`` are the metadata fields that
        have a column in what this and later commits write.
        """
        current = self.generation()
        if expect is not None and expect != current:
            raise StaleWrite(f"the table is at generation {current}, not {expect}")
        folders, known = self._folders(current), self.catalog(current)
        listed = known if catalog is None else catalog
        if whole is not None and buckets is None:
            buckets = self._dealt(whole, collection_ids, listed)
        pieces = self.pieces(current)
        if catalog is not None:
            pieces = pieces.join(catalog.select("id"), "id", "left_semi")
        if collection_ids:
            pieces = pieces.where(~F.col("id").isin(list(collection_ids)))
        if replaced:
            pieces = pieces.join(self._pairs(replaced), ["id", "bucket"], "left_anti")
        pieces = pieces.select("id", "vector_type", "bucket", "folder", "rows", "written")
        as_columns = self.fields(current) if fields is None else fields
        for rows, moved in ((whole, True), (added, True), (kept, False)):
            if rows is not None:
                rows = self.with_bucket(rows, buckets) if "bucket" not in rows.columns else rows
                pieces = pieces.union(self._write_rows(rows, f"from-{current}", moved, as_columns))
        changed = {}
        if catalog is not None or collection_ids:
            changed["collections"] = self._listed(listed, known, collection_ids, buckets or {})
        if catalog is not None or collection_ids or added is not None or kept is not None or replaced:
            changed["pieces"] = pieces
        if stream is not None:
            others = self._part("streams", STREAMS, current).where(F.col("stream") != stream[0])
            changed["streams"] = others.union(self.spark.createDataFrame([stream], STREAMS))
        if cells is not None:
            others = self._part("cells", CELLS, current).join(cells.select("id").distinct(), "id", "left_anti")
            changed["cells"] = others.unionByName(cells)
        if fields is not None:
            changed["fields"] = self.spark.createDataFrame([(f,) for f in fields], FIELDS)
        for part, frame in changed.items():
            folders[part] = f"{part}-{current + 1}-{uuid.uuid4().hex}"
            frame.hint("rebalance").write.mode("errorifexists").parquet(f"{self.root}/catalog/{folders[part]}")
        return self._publish(current, folders)

    def _listed(self, listed: DataFrame, known: DataFrame, collection_ids: Sequence[int], buckets: dict[int, int]) -> DataFrame:
        """The collections with their buckets: new ones for those written whole, else those they had."""
        rows = listed.select(*COLLECTIONS.names).join(known.select("id", F.col("buckets").alias("old_buckets")), "id", "left")
        number = F.col("old_buckets")
        if collection_ids:
            dealt = self.spark.createDataFrame([(i, buckets.get(i)) for i in collection_ids], "id long, new_buckets int")
            rows = rows.join(F.broadcast(dealt.withColumn("anew", F.lit(True))), "id", "left")
            number = F.when(F.col("anew"), F.col("new_buckets")).otherwise(number)
        return rows.select(*COLLECTIONS.names, number.cast("int").alias("buckets"))

    def _dealt(self, rows: DataFrame, collection_ids: Sequence[int], catalog: DataFrame) -> dict[int, int]:
        """Buckets of the collections that are written whole, a number each."""
        counts = rows.groupBy(F.col("collection_id").alias("id")).agg(F.count(F.lit(1)).alias("rows"))
        sized = counts.join(catalog.where(F.col("id").isin(list(collection_ids))).select("id", "dimensions"), "id")
        return {r.id: bucket_count(r.rows, r.dimensions) for r in sized.collect()}

    def with_bucket(self, rows: DataFrame, buckets: dict[int, int]) -> DataFrame:
        known = F.broadcast(self.spark.createDataFrame(list(buckets.items()), "collection_id long, buckets int"))
        return rows.select(*EMBEDDINGS.names).join(known, "collection_id").withColumn("bucket", bucket_of(F.col("buckets"))).drop("buckets")

    def _write_rows(self, rows: DataFrame, name: str, moved: bool, fields: Sequence[str] = ()) -> DataFrame:
        """Write rows with their bucket; gives the pieces.

        New rows are rebalanced, which gives a small collection one file and splits large buckets. What is
        kept of stored buckets is written by the tasks that read it, without an exchange. The order
        within files lets readers skip row groups by authz, ``fields`` and id.
        """
        name = f"{name}-{uuid.uuid4().hex}"
        target = f"{self.root}/embeddings/folder={name}"
        partitions = ["vector_type", "collection_id", "bucket"]
        rows = rows.select(*STORED.names)
        if moved:
            rows = rows.hint("rebalance", *[F.col(c) for c in partitions])
        columns = [column_name(f) for f in fields]
        rows = rows.select("*", *[stored_value(F.col("metadata"), f).alias(c) for f, c in zip(fields, columns)])
        writer = rows.sortWithinPartitions(*partitions, "authz", *columns, "embedding_id").write.mode("errorifexists").partitionBy(*partitions)
        if fields:
            writer = writer.option("parquet.block.size", ROW_GROUP_BYTES)
        writer.parquet(target)
        written = self.spark.read.schema(STORED).parquet(target).groupBy(F.col("collection_id").alias("id"), "vector_type", "bucket").agg(F.count(F.lit(1)).alias("rows"))
        of_collection = written.groupBy("id").agg(F.count(F.lit(1)).cast("int").alias("written"))
        return written.join(of_collection, "id").select("id", "vector_type", "bucket", F.lit(name).alias("folder"), "rows", "written")
