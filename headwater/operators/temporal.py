"""As-of joins: the state that was last observed before an event."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from headwater.operators.network import checkpointed


def as_of(events: DataFrame, observations: DataFrame, on: Sequence[str], ts: str, values: Sequence[str], blocks: int = 64) -> DataFrame:
    """Each event with the last observation of its key at or before it: ``<ts>_seen`` and ``values``, null where there is none.

    One sorted pass over both tables together instead of a join by inequality. Of several observations at one time the
    one with the greatest values counts. Rows are dealt by ranges of time, so a key with a third of all rows is in as many tasks as
    any other: each (range, key) is filled on its own, and starts with the last observation of the ranges before, which are one row a range and key.
    Events with a null key or time see nothing; observations with one are not seen. Columns of events stay as they are.
    """
    keys = [f"_on{i}" for i in range(len(on))]
    seen = f"{ts}_seen"
    clash = {seen, *values} & set(events.columns)
    if clash:
        raise ValueError(f"columns of the events: {', '.join(sorted(clash))}")
    known = F.col(ts).isNotNull()
    for c in on:
        known = known & F.col(c).isNotNull()
    obs = F.struct(F.col(ts).alias(seen), *values)
    row = F.struct(*[F.col(c) for c in events.columns])
    kinds = {f.name: f.dataType for f in observations.select(obs.alias("o")).schema["o"].dataType.fields}
    named = [F.col(c).alias(k) for c, k in zip(on, keys, strict=True)]
    # At one time observations come first, so an event sees those of its own time.
    a = events.where(known).select(*named, F.col(ts).alias("_ts"), F.lit(1).alias("_kind"), row.alias("_row"), F.lit(None).cast(observations.select(obs.alias("o")).schema["o"].dataType).alias("_obs"))
    b = observations.where(known).select(*named, F.col(ts).alias("_ts"), F.lit(0).alias("_kind"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), obs.alias("_obs"))
    dealt = checkpointed(a.unionByName(b).repartitionByRange(blocks, "_ts").withColumn("_block", F.spark_partition_id()))
    own = F.last("_obs", ignorenulls=True).over(Window.partitionBy("_block", *keys).orderBy("_ts", "_kind", "_obs").rowsBetween(Window.unboundedPreceding, 0))
    before = F.last("_last", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    carried = dealt.groupBy("_block", *keys).agg(F.max("_obs").alias("_last")).select("_block", *keys, before.alias("_before"))
    filled = dealt.withColumn("_own", own).where("_kind = 1").join(carried, ["_block", *keys]).select("_row.*", F.coalesce("_own", "_before").alias("_found"))
    found = filled.select(*events.columns, *[F.col(f"_found.{c}").alias(c) for c in (seen, *values)])
    return found.unionByName(events.where(~known).select("*", *[F.lit(None).cast(kinds[c]).alias(c) for c in (seen, *values)]))
