"""Column expressions over latencies and positions."""

from pyspark.sql import Column, functions as F

from hoplens.settings import LATENCY_CAP_MS


def measured(latency: Column) -> Column:
    """The latency where there is one: NaN is no measurement and becomes NULL."""
    return F.when(~F.isnan(latency), latency)


def fill_and_clip(latency: Column, cap: float = LATENCY_CAP_MS) -> Column:
    """Series value: a lost sample sits at the cap, and nothing lies above it."""
    return F.least(F.coalesce(measured(latency), F.lit(cap)), F.lit(cap))


def zero_fill(latency: Column) -> Column:
    """Live value: a lost sample is zero, and nothing is capped."""
    return F.coalesce(measured(latency), F.lit(0.0))


def display_value(latency: Column, cap: float = LATENCY_CAP_MS) -> Column:
    shown = F.least(measured(latency), F.lit(cap)).cast("string")
    # Below a thousandth the text has an exponent; it is written out.
    plain = F.rtrim(shown.try_cast("decimal(38,30)").cast("string"), F.lit("0"))
    shown = F.when(shown.contains("E-"), plain).otherwise(shown)
    return F.when(measured(latency).isNull(), "Lost").otherwise(F.concat(shown, F.lit(" ms")))


def health_band(latency: Column) -> Column:
    return F.when(latency < 75, "green").when(latency < 125, "yellow").otherwise("red")


def live_scale(window_max: Column) -> Column:
    """Upper end of the live scale, never below 100."""
    return F.greatest(F.coalesce(window_max, F.lit(100.0)), F.lit(100.0))


def window_index(seq: Column, interval: int) -> Column:
    return _div(seq - 1, interval)


def segment_index(seq: Column, segment_len: int | None) -> Column:
    """Segment a position falls into; one segment for everything when ``segment_len`` is None."""
    return F.lit(0).cast("long") if segment_len is None else _div(seq, segment_len)


def _div(number: Column, by: int) -> Column:
    """Whole-number division that stays in BIGINT."""
    return F.call_function("div", number, F.lit(by).cast("long"))


def fixed2(number: Column) -> Column:
    """Two decimals, rounded half-even on the exact binary value as Python's ``.2f`` does; NULL reads N/A."""
    return (
        F.when(number.isNull(), "N/A")
        .when(number == float("inf"), "inf")
        .when(number == float("-inf"), "-inf")
        .otherwise(F.call_function("format_number", number, F.lit("0.00")))
    )


def span_text(seconds: Column) -> Column:
    """Seconds as ``[N day[s], ]H:MM:SS``."""
    days, rest = _div(seconds, 86400), seconds % 86400
    prefix = (
        F.when(days == 0, "")
        .when(days == 1, "1 day, ")
        .otherwise(F.format_string("%d days, ", days))
    )
    clock = F.format_string("%d:%02d:%02d", _div(rest, 3600), _div(rest % 3600, 60), rest % 60)
    return F.concat(prefix, clock)
