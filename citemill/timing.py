"""Wall-clock times of the stages of a run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citemill.logs import get_logger
from citemill.session import held

STAGES = ("retrieval", "rerank", "generation")
TIMING = "struct<" + ",".join(f"{s}_ms:int" for s in (*STAGES, "total")) + ">"

# Rows with texts that are kept on the driver between stages; more are staged.
HELD_ROWS = 200

log = get_logger(__name__)


class StageClock:
    """Times stages: each is computed when it is marked, so that its time is its own, and kept for the next one."""

    def __init__(self, clock: Callable[[], float]):
        self.clock, self.ms = clock, {}
        self.started = self.last = clock()

    def mark(self, stage: str, df: DataFrame) -> DataFrame:
        done, rows = held(df, stage, HELD_ROWS)
        now = self.clock()
        self.ms[stage] = int(round((now - self.last) * 1000))
        self.last = now
        log.info(stage, extra={"ms": self.ms[stage], "rows": None if rows is None else rows.num_rows})
        return done

    def column(self, generated: Column) -> Column:
        """Times of a question, in ms. A batch takes as long for each of its questions; one that was not ``generated``
        for did not wait for that."""
        value = lambda s: F.lit(self.ms.get(s, 0))
        times = [value("retrieval"), value("rerank"), F.when(generated, value("generation")).otherwise(0)]
        return F.struct(*times, times[0] + times[1] + times[2]).cast(TIMING)


def latency(responses: DataFrame) -> DataFrame:
    """(stage, n, p50_ms, p95_ms) of responses with a ``timing``, those without left out."""
    names = [*STAGES, "total"]
    each = responses.where("timing IS NOT NULL").select(
        F.explode(F.array(*[F.struct(F.lit(s).alias("stage"), F.col(f"timing.{s}_ms").alias("ms")) for s in names])).alias("t")
    )
    return each.groupBy("t.stage").agg(
        F.count("*").alias("n"), F.percentile_approx("t.ms", 0.5, 10_000).alias("p50_ms"), F.percentile_approx("t.ms", 0.95, 10_000).alias("p95_ms")
    )
