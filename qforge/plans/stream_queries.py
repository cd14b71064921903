"""Registered streaming queries: stateless operators on a file stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import coerce_number
from ..operators import encode as E
from ..streaming.stream import read_stream, run_available
from .model_queries import KEY, trained
from .registry import query

# Event type codes for the streamed ranked encoding.
EVENT_LEVELS = {"view": 0, "click": 1, "signup": 2, "purchase": 3}


@query("stream_encode_events", oracle="""
SELECT event_id,
       CAST(CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3
            ELSE -1 END AS INTEGER) AS event_type_Enc,
       round(pow(1.0 + greatest(floor((epoch_us(TIMESTAMP '2024-03-01 00:00:00') - epoch_us(ts)) / 86400000000.0)
             / 365.25, 0.0), -2.0), 12) AS weight,
       coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 0.0) AS k_value
FROM events
""")
def stream_encode_events(spark, sf):
    """E1 + E7 + C3 applied to the events table read as a stream."""
    ev = read_stream(spark, f"{sf.rstrip('/')}/events.parquet")
    enc = E.RankedEncoder.create("event_type", EVENT_LEVELS)
    weight = E.SampleWeighterModel(inputCol="ts", outputCol="weight", spec=(
        '{"ref_date": "2024-03-01 00:00:00", "k": 2.0, "any_valid": true}'))
    out = weight.transform(enc.transform(ev)).select(
        "event_id", "event_type_Enc", F.round("weight", 12).alias("weight"),
        coerce_number(F.get_json_object("props", "$.k")).alias("k_value"))
    return run_available(out, "encode_events")


@query("stream_score_lineitem")
def stream_score_lineitem(spark, sf):
    """P1 on a stream: lineitem files joined to static orders, scored by the
    trained model set (a stateless projection), appended to a Parquet sink."""
    fc = trained(spark, sf)
    li = read_stream(spark, f"{sf.rstrip('/')}/lineitem.parquet")
    o = spark.read.parquet(f"{sf.rstrip('/')}/orders.parquet").select("o_orderkey", "o_orderpriority")
    joined = li.join(o, li.l_orderkey == o.o_orderkey, "inner").drop("o_orderkey")
    return run_available(fc.predict(joined, "long", keep=KEY), "score_lineitem")
