"""Files that arrive in a folder: parsed and judged as they come.

A file is one row and needs no other, so the stream keeps no state but which files it
has seen; each micro-batch goes through the batch operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quirelake.operators import rules
from quirelake.operators.tables import tables_of
from quirelake.sources.files import stream_folder


def watch(spark: SparkSession, inbox: str, out: str, state: str, rules_only: list[str] | None = None) -> StreamingQuery:
    """Writes ``structure`` and ``findings`` of all that lies in ``inbox`` and was not read
    before to Parquet tables under ``out``, then ends. A batch has a folder of its own
    (``batch=N``), which a repeated batch writes anew, so that no row stands twice."""

    def judge(batch: DataFrame, number: int) -> None:
        tables = tables_of(batch, "structure", *(x for x in rules.reads(rules_only) if x != "structure"))
        tables.structure.write.mode("overwrite").parquet(f"{out}/structure/batch={number}")
        rules.findings(tables, rules_only).write.mode("overwrite").parquet(f"{out}/findings/batch={number}")
        tables.release()

    files = stream_folder(spark, inbox)
    return files.writeStream.foreachBatch(judge).option("checkpointLocation", state).trigger(availableNow=True).start()
