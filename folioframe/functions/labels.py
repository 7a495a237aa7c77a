"""Result labels. The defaults are fixed values; every analytic takes its own set as an argument."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class BandLabels(NamedTuple):
    above: str = "과매수"
    below: str = "과매도"
    inside: str = "중립"


class TrendLabels(NamedTuple):
    up: str = "상승추세"
    down: str = "하락추세"
    flat: str = "중립"


class StatusLabels(NamedTuple):
    anomaly: str = "이상치"
    normal: str = "정상"


def band_signal(close: Column, upper: Column, lower: Column, labels: BandLabels = BandLabels()) -> Column:
    return F.when(close > upper, labels.above).when(close < lower, labels.below).otherwise(labels.inside)


def trend(short: Column, long: Column, labels: TrendLabels = TrendLabels()) -> Column:
    return F.when(short > long, labels.up).when(short < long, labels.down).otherwise(labels.flat)


def anomaly_status(z: Column, threshold: float, labels: StatusLabels = StatusLabels()) -> Column:
    return F.when(F.abs(z) >= F.lit(threshold), labels.anomaly).otherwise(labels.normal)
