"""When samples were taken, as far as a run's name tells."""

from pyspark.sql import DataFrame, functions as F

from hoplens.functions.parsing import elapsed, probe_clock, run_clock
from hoplens.settings import Settings


def with_clock(samples: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Add the run's clock ``run_ts``, the seconds axis ``elapsed_s`` and the sample's clock ``probe_ts``, all without a zone.

    Positions count probes, which are ``settings.ping_interval`` seconds apart. Runs that no clock names have no clocks.
    """
    run_id, seq = F.col("run_id"), F.col("seq")
    return samples.withColumns(
        {
            "run_ts": run_clock(run_id),
            "elapsed_s": elapsed(seq, settings.ping_interval),
            "probe_ts": probe_clock(run_id, seq, settings.ping_interval),
        }
    )
