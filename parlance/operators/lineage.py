"""Where a plan is cut: rows that later steps read several times are written once."""

from __future__ import annotations

import re
import tempfile
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def cut(frame: DataFrame) -> DataFrame:
    """frame from files in the checkpoint folder, which driver and executors share. A lost executor costs
    no second call of a model, and nothing stays in memory. The folder is spark.checkpoint.dir; in local
    mode, where it may be unset, one of our own."""
    context = frame.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = frame.sparkSession.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="parlance-"))
    return frame.checkpoint(eager=True)


@dataclass
class Stages:
    """A cut that measures: per stage its name, seconds and rows, in the order in which they ran. The rows
    are observed while the stage is written, so nothing runs twice."""

    taken: list[tuple[str, float, int]] = field(default_factory=list)

    def __call__(self, frame: DataFrame, name: str = "stage") -> DataFrame:
        seen, began = Observation(), time.perf_counter()
        out = cut(frame.observe(seen, F.count(F.lit(1)).alias("rows")))
        self.taken.append((name, time.perf_counter() - began, seen.get["rows"]))
        return out

    @property
    def total_seconds(self) -> float:
        return sum(seconds for _, seconds, _ in self.taken)


def named(by, frame: DataFrame, name: str) -> DataFrame:
    """frame cut by ``by`` (any function of a frame), under a name where it measures."""
    return by(frame, name) if isinstance(by, Stages) else by(frame)
