"""Row-wise operators on a stream that is stopped and started again."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.features import Arithmetic, add_arithmetic
from ..operators.filters import Condition, apply_filters
from ..operators.labels import clean_labels
from ..operators.rules import Rule, apply_rules
from ..operators.types import cast_types
from ..session import shared_path
from ..streaming.incremental import load_new_files
from .cleaning import _TITLE
from .registry import query, table

_STEPS = [
    lambda s: cast_types(s, {"value": "numeric"}),
    lambda s: apply_filters(s, [Condition("value", ">=", "10")]),
    lambda s: clean_labels(s, ["event_type"]),
    lambda s: add_arithmetic(s, [Arithmetic("twice", "value", "value", "add")]),
    lambda s: apply_rules(s, [Rule("twice", ">=", 100.0, "band", "high"), Rule("twice", "<", 100.0, "band", "low")]),
]


@query("stream_restarted_load", f"""SELECT event_id, user_id, {_TITLE.format(c='event_type')} AS event_type, value, value + value AS twice,
  CASE WHEN value + value >= 100 THEN 'high' ELSE 'low' END AS band FROM events WHERE value >= 10""")
def stream_restarted_load(spark, folder):
    """The later half of the events arrives after the first run; a third run finds nothing new."""
    events = table(spark, folder, "events").select("event_id", "user_id", "event_type", F.col("value").cast("string").alias("value"))
    path = shared_path(spark)
    source, target, checkpoint = f"{path}/in", f"{path}/out", f"{path}/checkpoint"
    middle = events.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY event_id)").alias("k")).first()["k"]
    middle = 0 if middle is None else int(middle)
    for part in (events.where(F.col("event_id") <= middle), events.where(F.col("event_id") > middle), None):
        if part is not None:
            part.write.mode("append").parquet(source)
        load_new_files(spark, source, events.schema, target, checkpoint, _STEPS).awaitTermination()
    return spark.read.parquet(target)
