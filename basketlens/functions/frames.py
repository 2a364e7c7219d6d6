"""Stacking frames."""

from functools import reduce

from pyspark.sql import DataFrame

from ..session import guarded


def stacked(*frames: DataFrame) -> DataFrame:
    """Frames over one another by column name, absent columns as NULL.

    Readings aggregate what they stack, which is only right with the session
    guard on: see `guarded`.
    """
    guarded(frames[0].sparkSession)
    return reduce(lambda one, two: one.unionByName(two, allowMissingColumns=True), frames)
