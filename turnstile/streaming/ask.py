"""Answers to sequents that arrive as a stream.

Each micro-batch is a batch of queries against a base that does not change meanwhile, so a query needs no
state beyond its micro-batch and answers are exact however late they come.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from turnstile.operators.base import Base
from turnstile.plans.ask import ask


def answer_stream(queries: DataFrame, base: Base, sink, checkpoint: str, **trigger) -> StreamingQuery:
    """Start a query over a stream (qid, antecedent, consequent); sink(answers, batch_id) gets (qid, derivable, error).

    After a failure a micro-batch may come again with the same batch_id; a sink that overwrites by it is exact.
    """
    return queries.writeStream.foreachBatch(lambda rows, batch: sink(ask(rows, base), batch)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
