"""Keeping an index up to date from a stream of pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lectern.operators.chunks import CHUNK_OVERLAP, CHUNK_SIZE
from lectern.plans.knowledge import update_index
from lectern.sources.index import create_index


def stream_index(
    pages: DataFrame,
    path: str,
    checkpoint: str,
    embed: Callable[[DataFrame], DataFrame],
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
) -> StreamingQuery:
    """Bring the index at ``path`` up to date with newly arrived pages and stop when the stream is
    worked off.

    ``pages`` is a streaming ``(source, page_num, content)``, with a ``page_key`` where pages keep one; page
    numbers must come with the data. Pages that are known with the same text are left out before they
    are cut, so a batch that is repeated after a failure adds nothing. A page that arrives again in a later
    batch replaces its stored chunks; of two texts of a page in one batch both are kept. ``checkpoint``
    must be on shared storage.
    """
    create_index(pages.sparkSession, path)

    def append(batch: DataFrame, batch_id: int) -> None:
        # The batch is looked at twice; without this the source would be, too.
        batch.persist()
        update_index(batch, path, embed, size, overlap, given=("source", "page_num"))
        batch.unpersist()

    return (
        pages.writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
