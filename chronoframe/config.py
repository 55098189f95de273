"""Settings of the engine."""

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    """Windows are in seconds; ``keep_buckets`` is how many buckets a series keeps beside its newest."""

    window: int = 7200
    keep_buckets: int = 13
    shards: int = 10
    allowed_behind: int = 900
    allowed_ahead: int = 60
    min_delta: int = 0
    default_delta: int = 60
    adjust_timestamps: bool = False
    finalize_slack: int = 60
    log_gap: int = 600
    max_key_bytes: int = 400
    max_key_id: int = 10_000_000
    max_block_points: int = 32767
    max_block_bytes: int = 32767


DEFAULT = EngineConfig()
#: Ownership states in their order.  A shard only goes to a later one, or from OWNED to PRE_UNOWNED.
STATES = ("PRE_UNOWNED", "UNOWNED", "PRE_OWNED", "READING_KEYS", "READING_KEYS_DONE", "READING_LOGS", "PROCESSING_QUEUED_DATA_POINTS", "READING_BLOCK_DATA", "OWNED")
#: States that serve reads, and take points in at once.
READABLE = ("READING_BLOCK_DATA", "OWNED", "PRE_UNOWNED")
