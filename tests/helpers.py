import datetime as dt

import numpy as np
import pandas as pd


def day(i: int) -> dt.date:
    return dt.date(2020, 1, 1) + dt.timedelta(days=i)


def series(spark, values, asset="A", col="close"):
    rows = [(asset, day(i), None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"asset string, ts date, {col} double")


def panel(spark, data: dict, col="r"):
    rows = [(a, day(i), float(v)) for a, vs in data.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, f"asset string, ts date, {col} double")


def pdf(df, *order) -> pd.DataFrame:
    out = df.toPandas()
    return out.sort_values(list(order)).reset_index(drop=True) if order else out


def rng(seed=0):
    return np.random.default_rng(seed)
