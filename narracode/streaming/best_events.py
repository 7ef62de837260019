"""The running best after every evaluation, as a keyed stateful stream."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

cloudpickle.register_pickle_by_value(sys.modules[__name__])

STATE = "step long, best_f1 double, best_thresh double"


def advance(by: tuple[str, ...], key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One output row for each evaluation of a key, in the order of the steps.

    Of several evaluations of a step the best one counts (the higher score, then the higher
    threshold). A step that is not after the last one of an earlier trigger comes late or twice:
    later rows have been put out already, so it gives no row and changes nothing. The state is three
    numbers, however many evaluations there were."""
    rows = pd.concat(list(parts))
    last, best_f1, best_thresh = state.get if state.exists else (None, 0.0, 0.5)
    rows = rows.sort_values(["step", "f1", "thresh"]).drop_duplicates("step", keep="last")
    if last is not None:
        rows = rows[rows["step"] > last]
    if not len(rows):
        return
    f1 = np.append(best_f1, rows["f1"].to_numpy())
    top = np.maximum.accumulate(f1)
    # of equal scores the later one counts
    at = np.maximum.accumulate(np.where(f1 >= top, np.arange(len(f1)), 0))
    thresh = np.append(best_thresh, rows["thresh"].to_numpy())[at][1:]
    state.update((int(rows["step"].iloc[-1]), float(top[-1]), float(thresh[-1])))
    out = rows.assign(best_thresh=thresh, best_f1=top[1:])
    yield out.assign(**dict(zip(by, key, strict=True)))[[*by, "step", "thresh", "f1", "best_thresh", "best_f1"]]


def best_events(evals: DataFrame, by: tuple[str, ...] = ("run", "label")) -> DataFrame:
    """``step, thresh, f1, best_thresh, best_f1`` of every evaluation of a stream, by key."""
    kinds = ", ".join(f"{c} {evals.schema[c].dataType.simpleString()}" for c in by)
    schema = f"{kinds}, step long, thresh double, f1 double, best_thresh double, best_f1 double"
    rows = evals.select(*by, "step", "thresh", "f1")
    step = lambda key, parts, state: advance(by, key, parts, state)
    return rows.groupBy(*by).applyInPandasWithState(step, schema, STATE, "append", GroupStateTimeout.NoTimeout)


def append_events(evals: DataFrame, out: str, checkpoint: str, by: tuple[str, ...] = ("run", "label")) -> None:
    """Append the rows of what is available to the table ``out`` and end; a later call with the same
    checkpoint goes on where this one ended. The file sink writes each trigger once."""
    query = (
        best_events(evals, by)
        .writeStream.outputMode("append")
        .format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
