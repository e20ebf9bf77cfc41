"""Stream-static blocking: probe records arrive as a stream, the source-1 index stands still. Beyond the batch operators; optional."""

from __future__ import annotations

from pyspark.sql import DataFrame

from kinmatch.operators import blocking as K
from kinmatch.sources.settled import settled


def stream_pairs(records: DataFrame, light_index: DataFrame, sink_path: str, checkpoint: str, p: K.BlockingParams = K.BlockingParams()):
    """Start a query that blocks each micro-batch of probe records against the index and appends gated, ranked pairs.

    The entity budget needs the order of all probe records and is left to a
    batch pass over the sink.
    """
    light_index = settled(light_index, "stream-index")
    index_keys = K.block_keys(light_index, p).filter("src = 1")
    df = settled(K.trimmed(index_keys, p), "stream-keys")

    def batch(rows: DataFrame, epoch: int) -> None:
        light = K.prepare(rows)
        pairs = K.top_by_weight(K.candidates(K.budgeted(K.block_keys(light, p), df, p), index_keys.join(df, "key", "left_semi")), p.pre_collect)
        both = K.with_sides(pairs, light_index.unionByName(light))
        scored = K.ranked(both.withColumn("score", K.evidence(both["l"], both["r"])), p)
        scored.select("s1_id", "other_id", "score", "rank").write.mode("overwrite").parquet(f"{sink_path}/epoch={epoch}")

    return records.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
