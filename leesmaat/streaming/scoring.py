"""Readability over streams: documents scored as they arrive, editing decisions kept per document."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from leesmaat import workspace
from leesmaat.api import Readability
from leesmaat.operators.editor import decide
from leesmaat.sources.lexicons import Lexicons


def score_stream(documents: DataFrame, lexicons: Lexicons, target: str, checkpoint: str, key: str = "doc_id", text: str = "text", trigger: dict | None = None) -> StreamingQuery:
    """Write doc_id, score, level, batch of each arriving document to a folder of tables.

    A document stands on its own, so batches need no state; a batch that is repeated after a failure overwrites its own
    folder and so counts once."""

    def score(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        since = workspace.mark(session)
        scores = Readability(lexicons).analyze(batch, key, text).scores
        scores.select("doc_id", "score", "level").withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{target}/batch_no={number}")
        workspace.release(session, since)  # a stream would fill the folder otherwise

    return documents.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


STATE = "seq array<bigint>, id array<string>, sent_idx array<int>, cluster array<string>, type array<string>, action array<string>"
LOG = ["seq", "id", "sent_idx", "cluster", "type", "action"]


def decision_stream(log: DataFrame) -> DataFrame:
    """doc_id, id, state after every arriving decision: the state of each document is the log of its decisions so far, which
    the planner's cap keeps short. log: doc_id, seq, id, sent_idx, cluster, type, action; a decision that comes twice counts once."""

    def fold(key, batches, state: GroupState):
        held = dict(zip(LOG, state.get, strict=True)) if state.exists else {c: [] for c in LOG}
        rows = pd.concat([pd.DataFrame({c: list(held[c]) for c in LOG}), *[b[LOG] for b in batches]], ignore_index=True).drop_duplicates(["seq", "id"])
        state.update(tuple(rows[c].tolist() for c in LOG))
        yield decide(rows.assign(doc_id=key[0]))

    return log.groupBy("doc_id").applyInPandasWithState(fold, "doc_id bigint, id string, state string", STATE, "update", GroupStateTimeout.NoTimeout)


def hourly_levels(scored: DataFrame, at: str = "published_at", late: str = "2 hours") -> DataFrame:
    """window start, level, documents: how many documents of each level an hour brings; rows later than `late` are left out."""
    return scored.withWatermark(at, late).groupBy(F.window(at, "1 hour").alias("w"), "level").agg(F.count("*").alias("documents")).select(F.col("w.start").alias("hour"), "level", "documents")
