"""Session settings that the library's semantics rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

CONF = {"spark.sql.session.timeZone": "UTC", "spark.sql.mapKeyDedupPolicy": "LAST_WIN", "spark.sql.adaptive.enabled": "true"}


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with those settings; conf is added."""
    builder = SparkSession.builder.config(map=CONF | {k.replace("__", "."): v for k, v in conf.items()})
    return (builder.master(master) if master else builder).getOrCreate()
