"""Reply streams closed in rounds: a round reads what came since the last one and what is still open.

Below ``root`` lie ``chunks/batch=N`` as the stream brought them, and for every round the texts it closed
(``texts``), the chunks of replies still open after it (``open``), the ids it closed (``ids``) and
its pointer. The pointer, a file created only if it is not there, makes a round: what a failed round left is
never read, and of two rounds at once one wins. Chunks of closed replies are not read again; of the ledger of
closed ids only those of new chunks are looked up, by a scan of ids without an exchange where the new ids are few.

Repeated chunks count once (the one that came first, in a batch the least text), chunks after the last one and
chunks of replies that are closed are ignored. A chunk without text is empty; one without ``is_last`` is not the last.
Chunks without id or number belong to no reply. A reply that never ends stays open and is read by each round.
"""

import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from vecfold.operators.deltas import assemble_deltas
from vecfold.operators.skew import lookup_join

CHUNKS = "response_id string, seq long, delta string, is_last boolean"
STORED = CHUNKS + ", batch long"
TEXTS = "response_id string, chunks int, text string"

# A pointer that is still empty after this time belongs to a round that died.
PUBLISHING_SECONDS = 600


class StaleRound(Exception):
    """Another round came first."""


class ReplyLog:
    """Reply chunks below ``root`` and the replies closed so far."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def append(self, chunks: DataFrame) -> DataStreamWriter:
        """Chunks of every micro-batch, in a folder of its number; a replayed batch writes its own again."""

        def write(batch: DataFrame, number: int) -> None:
            rows = batch.select("response_id", "seq", "delta", "is_last")
            rows.write.mode("overwrite").parquet(f"{self.root}/chunks/batch={number}")

        return chunks.writeStream.foreachBatch(write)

    def close(self) -> DataFrame:
        """One round: close every reply whose chunks are all there. The texts it closed."""
        number, upto, names = self._last()
        fresh = [batch for batch in self._batches() if batch > upto]
        if not fresh:
            return self.spark.createDataFrame([], TEXTS)
        name = f"round={number + 1}/name={uuid.uuid4().hex}"
        # The first of repeated chunks, whatever the order in which tasks see them.
        came = F.min(F.struct("batch", F.coalesce("delta", F.lit("")).alias("delta"))).alias("came")
        chunks = self._pending(fresh, names).groupBy("response_id", "seq").agg(came, F.max(F.coalesce("is_last", F.lit(False))).alias("is_last"))
        chunks = self._store(chunks.select("response_id", "seq", "came.delta", "is_last", "came.batch"), "pending", name, STORED)
        ends = chunks.where("is_last").groupBy("response_id").agg(F.min("seq").alias("end"))
        # Whether a reply is whole is found on numbers alone.
        within = lookup_join(chunks.select("response_id", "seq"), ends, ["response_id"]).where("seq between 0 and end")
        whole = within.groupBy("response_id").agg(F.count(F.lit(1)).alias("n"), F.first("end").alias("end"))
        closing = self._store(whole.where("n = end + 1").select("response_id", "end"), "ids", name, "response_id string, end long")
        closed = lookup_join(chunks, closing, ["response_id"]).where("seq between 0 and end")
        texts = self._store(assemble_deltas(closed), "texts", name, TEXTS)
        self._store(lookup_join(chunks, closing, ["response_id"], "left_anti"), "open", name, STORED)
        self._publish(number + 1, [str(max(fresh)), *names, name])
        return texts

    def pending(self) -> DataFrame:
        """What the next round reads: chunks that came since the last one, and those of replies still open."""
        _, upto, names = self._last()
        return self._pending([batch for batch in self._batches() if batch > upto], names)

    def _pending(self, batches: list[int], names: list[str]) -> DataFrame:
        rows = self._read("chunks", [f"batch={batch}" for batch in batches], STORED).where("response_id is not null and seq is not null")
        if not names:
            return rows
        new = rows.select("response_id").distinct()
        late = self._read("ids", names, "response_id string").join(new, "response_id", "left_semi")
        rows = lookup_join(rows, late, ["response_id"], "left_anti")
        return rows.unionByName(self._read("open", names[-1:], STORED))

    def closed(self) -> DataFrame:
        """``response_id, chunks, text`` of all replies closed so far, and the ``round`` (from 1) that did it."""
        return self._read("texts", self._last()[2], TEXTS + ", round int")

    def _read(self, part: str, names: list[str], schema: str) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], schema)
        base = f"{self.root}/{part}"
        rows = self.spark.read.schema(schema).option("basePath", base).parquet(*[f"{base}/{name}" for name in names])
        return rows.select(*[column.split()[0] for column in schema.split(", ")])

    def _store(self, rows: DataFrame, part: str, name: str, schema: str) -> DataFrame:
        path = f"{self.root}/{part}/{name}"
        rows.write.mode("errorifexists").parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def _file(self, path: str):
        handle = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return handle, handle.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _listed(self, part: str) -> list:
        folder, system = self._file(f"{self.root}/{part}")
        return list(system.listStatus(folder)) if system.exists(folder) else []

    def _batches(self) -> list[int]:
        """Numbers of the batches that are written whole, in order; one listing."""
        names = [f.getPath().getName() for f in self._listed("chunks")]
        numbers = sorted(int(name.split("=")[1]) for name in names if name.startswith("batch="))
        if numbers:
            marker, system = self._file(f"{self.root}/chunks/batch={numbers[-1]}/_SUCCESS")
            # Batches come one after the other, so only the last can be half written.
            if not system.exists(marker):
                numbers.pop()
        return numbers

    def _last(self) -> tuple[int, int, list[str]]:
        """The number of the last round, the last batch it read, and the folders of all rounds."""
        pointers = [f for f in self._listed("rounds") if f.getPath().getName().isdigit()]
        number = max((int(f.getPath().getName()) for f in pointers), default=0)
        whole = max((f for f in pointers if f.getLen()), key=lambda f: int(f.getPath().getName()), default=None)
        if whole is None:
            return number, -1, []
        system = whole.getPath().getFileSystem(self.spark._jsc.hadoopConfiguration())
        stream = system.open(whole.getPath())
        upto, *names = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split("\n")
        stream.close()
        return number, int(upto), names

    def _publish(self, number: int, lines: list[str]) -> None:
        for other in self._listed("rounds"):
            if not other.getLen() and time.time() - other.getModificationTime() / 1000 < PUBLISHING_SECONDS:
                raise StaleRound("another round is being published")
        pointer, system = self._file(f"{self.root}/rounds/{number:012d}")
        try:
            out = system.create(pointer, False)
        except Py4JJavaError as error:
            if "FileAlreadyExists" in str(error.java_exception):
                raise StaleRound("another round came first") from None
            raise
        out.write(bytearray("\n".join(lines).encode()))
        out.close()
