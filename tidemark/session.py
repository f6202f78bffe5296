"""Session settings that follow the size of the data and of the cluster."""

from __future__ import annotations

MB = 1 << 20
# What one task should read, and what it should get from a shuffle.
SCAN_BYTES, SHUFFLE_BYTES = 256 * MB, 128 * MB


def settings_for(input_bytes: int, cores: int) -> dict[str, str]:
    """Settings for a job over `input_bytes` on `cores`.

    Shuffles start from partitions small enough to stay in memory and AQE joins
    the ones that turn out smaller; few enough data still use every core.
    """
    partitions = max(cores, -(-input_bytes // SHUFFLE_BYTES))
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(SHUFFLE_BYTES),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.files.maxPartitionBytes": str(SCAN_BYTES),
        "spark.sql.session.timeZone": "UTC",
    }
