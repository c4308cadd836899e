"""Bull and bear dating by turning points."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def bear_states(wealth: np.ndarray, fall: float = 0.2) -> np.ndarray:
    """1 from a peak that a fall of ``fall`` follows to the trough before a rise of ``fall``, else 0; a switch is dated back to its extreme, the first of equal ones."""
    out = np.zeros(len(wealth), np.int32)
    bear, at = False, 0
    for t, x in enumerate(wealth):
        if (x < wealth[at]) if bear else (x > wealth[at]):
            at = t
        elif (x >= (1 + fall) * wealth[at]) if bear else (x <= (1 - fall) * wealth[at]):
            bear = not bear
            out[at + 1 :] = int(bear)
            at = t
    return out


def turning_points(df: DataFrame, wealth: str = "wealth", fall: float = 0.2) -> DataFrame:
    """``df`` (series_id, ts, wealth) with bear: a state machine in time order, one series a group; a row holds a few numbers."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("ts")
        return pd.DataFrame({"series_id": p["series_id"], "ts": p["ts"], "bear": bear_states(p[wealth].ffill().fillna(1.0).to_numpy(float), fall)})

    kinds = dict(df.dtypes)
    return df.select("series_id", "ts", wealth).groupBy("series_id").applyInPandas(run, f"series_id {kinds['series_id']}, ts {kinds['ts']}, bear int")
