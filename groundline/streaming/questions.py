"""A stream of questions answered batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from groundline.plans.answer import answer
from groundline.session import release
from groundline.settings import DEFAULT, Settings


def answer_stream(questions: DataFrame, index: DataFrame, target: str, checkpoint: str, embedder: Callable | None = None, generator: Callable | None = None, settings: Settings = DEFAULT, **trigger) -> StreamingQuery:
    """Append the answers of each micro-batch to Parquet; a batch that is run again replaces its own folder."""
    options = {"generator": generator} if generator else {}

    def write(batch: DataFrame, number: int) -> None:
        used: list[DataFrame] = []
        try:
            answer(batch, index, embedder, settings=settings, used=used, **options).write.mode("overwrite").parquet(f"{target}/batch={number}")
        finally:
            release(*used)

    return questions.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
