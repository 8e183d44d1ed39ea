"""Helpers shared by tests."""


def shuffle_partitions(spark, n: int) -> None:
    """Set the number of shuffle partitions for one test, and keep them apart."""
    for key, value in (("spark.sql.shuffle.partitions", str(n)), ("spark.sql.adaptive.coalescePartitions.enabled", "false")):
        old = spark.conf.get(key)
        spark.conf.set(key, value)
        _RESTORE.append((key, old))


_RESTORE: list = []


def restore(spark) -> None:
    while _RESTORE:
        spark.conf.set(*_RESTORE.pop())
