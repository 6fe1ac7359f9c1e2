"""New PDF files of a folder, parsed as they arrive.

The comparison itself is of a whole corpus (how common a feature is decides what counts), so a
stream only keeps the parsed tables up to date; an analysis then reads them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from simweave.sources.pdf import parse_pdfs, split_parsed

_BINARY = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"


def watch_pdfs(spark: SparkSession, folder: str, out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append to ``out/files``, ``out/pages`` and ``out/images``; each file is read once, also after a restart.

    A batch that is repeated after a failure overwrites its own folder, so nothing is doubled.
    """
    source = spark.readStream.format("binaryFile").schema(_BINARY).option("pathGlobFilter", "*.[pP][dD][fF]").load(folder)

    def store(batch: DataFrame, number: int) -> None:
        parsed = parse_pdfs(batch).persist()
        try:
            for name, df in zip(("files", "pages", "images"), split_parsed(parsed), strict=True):
                df.write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")
        finally:
            parsed.unpersist()

    writer = source.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
