"""Incremental runs: each panorama once across runs, and review events folded into verdicts."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

REVIEW = "run_key string, pid string, dets array<string>, missed array<struct<x:double,y:double,unsure:boolean>>, no_missed boolean, seen boolean"
#: What a verdict becomes with each click.
NEXT = {None: "true", "true": "false", "false": "unsure", "unsure": None}


def once(spark: SparkSession, source: str, schema: str, key: str, out: str, checkpoint: str) -> None:
    """Append the rows of new files of source whose key was in no earlier run to out. State and
    progress are in checkpoint: a run that breaks off is taken up where it was."""
    stream = spark.readStream.schema(schema).parquet(source).dropDuplicates([key])
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def opened() -> dict:
    return {"dets": [], "missed": [], "no_missed": False, "seen": False}


def step(state: dict, kind: str, i: int, n: int, x: float, y: float) -> dict:
    """The state after one event. Kinds: open (with n detections), cycle (verdict i), mark (at x, y),
    touch (mark i: certain, unsure, gone), none (toggles no_missed, which marks forbid and revoke)."""
    dets, missed = state["dets"], state["missed"]
    if kind == "open":
        state["seen"] = True
        if len(dets) != n:
            state["dets"] = [None] * int(n)
    elif kind == "cycle" and 0 <= i < len(dets):
        dets[int(i)] = NEXT[dets[int(i)]]
    elif kind == "mark":
        missed.append({"x": float(x), "y": float(y), "unsure": False})
        state["no_missed"] = False
    elif kind == "touch" and 0 <= i < len(missed):
        if missed[int(i)]["unsure"]:
            del missed[int(i)]
        else:
            missed[int(i)]["unsure"] = True
    elif kind == "none" and not missed:
        state["no_missed"] = not state["no_missed"]
    return state


def _after(state: dict, rows: pd.DataFrame) -> dict:
    for e in rows.sort_values("seq").itertuples():
        state = step(state, e.kind, e.i, e.n, e.x, e.y)
    return state


def fold_reviews(events: DataFrame) -> DataFrame:
    """REVIEW of events (run_key, pid, seq, kind, i, n, x, y), in order of seq. A group is what people
    clicked on one panorama."""

    def fold(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"run_key": key[0], "pid": key[1], **_after(opened(), rows)}])

    return events.groupBy("run_key", "pid").applyInPandas(fold, REVIEW)


def follow_reviews(events: DataFrame) -> DataFrame:
    """The same of a stream of events: the new state of each panorama that a batch speaks of (output
    mode update). Within a batch events go by seq; batches as they come."""

    def fold(key: tuple, parts: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        state = _after(json.loads(kept.get[0]) if kept.exists else opened(), pd.concat(list(parts)))
        kept.update((json.dumps(state),))
        yield pd.DataFrame([{"run_key": key[0], "pid": key[1], **state}])

    return events.groupBy("run_key", "pid").applyInPandasWithState(fold, REVIEW, "state string", "update", GroupStateTimeout.NoTimeout)
