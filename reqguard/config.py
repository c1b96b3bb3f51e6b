"""Window lengths and sizing of the jobs."""

from dataclasses import dataclass

SECOND = 1_000_000
DAY = 86_400


@dataclass(frozen=True)
class Config:
    """Time windows in seconds, and how finely a key's rows are split over tasks.

    ``segment_s`` is the time slice within which one key's rows are sorted together; ``block_rows`` is the number of
    consecutive rows of one key handled together by row-based frames. Both bound the rows of a busy key per task.
    """

    short_s: int = 300
    long_s: int = 3600
    burst_s: int = 10
    burst_rows: int = 20
    segment_s: int = 60
    block_rows: int = 65_536

    @property
    def short_us(self):
        return self.short_s * SECOND

    @property
    def long_us(self):
        return self.long_s * SECOND

    @property
    def burst_us(self):
        return self.burst_s * SECOND

    @property
    def segment_us(self):
        return self.segment_s * SECOND


LIVE = Config()
# The sample events are sparse (about two rows per actor and day), so the same thresholds are bound to longer windows.
SAMPLE = Config(short_s=7 * DAY, long_s=30 * DAY, burst_s=DAY, segment_s=5 * DAY, block_rows=4096)
