"""Run parameters with the defaults a monitoring run uses."""

from dataclasses import dataclass

# Fixed values the results depend on.
WINDOW_SAMPLES = 60
SEGMENT_SECONDS = 3600
LATENCY_CAP_MS = 800.0
LIVE_WINDOW = 30
MIN_DURATION_FOR_AGGREGATION = 60
DEFAULT_HOSTS = ("8.8.8.8",)


@dataclass(frozen=True)
class Settings:
    duration: int = 10800
    ping_interval: int = 1
    latency_threshold: float = 200.0
    no_aggregation: bool = False
    no_segmentation: bool = False

    def __post_init__(self) -> None:
        for name in ("duration", "ping_interval"):
            value = getattr(self, name)
            if not isinstance(value, int) or value <= 0:
                raise ValueError(f"{name} must be a positive whole number, got {value!r}")
        if not isinstance(self.latency_threshold, (int, float)) or self.latency_threshold <= 0:
            raise ValueError(f"latency_threshold must be a positive number, got {self.latency_threshold!r}")

    @property
    def aggregate(self) -> bool:
        """Whether window means are computed: never for runs shorter than a minute."""
        return self.duration >= MIN_DURATION_FOR_AGGREGATION and not self.no_aggregation

    @property
    def segment_len(self) -> int | None:
        return None if self.no_segmentation else SEGMENT_SECONDS
