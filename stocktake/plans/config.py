"""Configuration of runs, endpoint presets, and Spark settings by size of input."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, fields, replace

from pyspark.sql import SparkSession


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class Config:
    """Settings of a run. Both timeouts and ``channel_capacity`` are read and checked, but a Spark task has no use for them."""

    bucket: str = ""
    region: str | None = None
    profile: str | None = None
    endpoint_url: str | None = None
    addressing_style: str = "auto"
    prefix: str = ""
    delimiter: str = ""
    max_keys: int | None = None
    filter: str | None = None
    threads: int = 0
    concurrency: int = 100
    max_attempts: int = 10
    backoff_secs: float = 1.0
    connect_timeout_secs: float = 60.0
    operation_timeout_secs: float = 5.0
    compression: str = "zstd"
    compression_level: int = 1
    row_group_size: int = 100_000
    channel_capacity: int = 64

    def check(self) -> Config:
        for name in ("concurrency", "row_group_size", "channel_capacity", "max_attempts"):
            if getattr(self, name) <= 0:
                raise ConfigError(f"{name} must be positive")
        if self.addressing_style not in ("auto", "path", "virtual"):
            raise ConfigError(f"unknown addressing style {self.addressing_style}")
        return replace(self, prefix="" if self.prefix == "/" else self.prefix)


def load(explicit: str | None = None, name: str = "stocktake.toml", **overrides: object) -> Config:
    """From the explicit file, else the working folder's, else the home folder's; arguments win."""
    places = [explicit] if explicit else [name, os.path.expanduser(f"~/.{name}")]
    found = next((p for p in places if os.path.isfile(p)), None)
    if explicit and not found:
        raise ConfigError(f"{explicit} is missing")
    data: dict = {}
    if found:
        with open(found, "rb") as f:
            for k, v in tomllib.load(f).items():
                data |= v if isinstance(v, dict) else {k: v}
    known = {f.name for f in fields(Config)}
    given = {k: v for k, v in overrides.items() if v is not None}
    return Config(**{k: v for k, v in (data | given).items() if k in known}).check()


# Presets of known endpoints - region, URL by region, addressing, whether a URL must be given.
PRESETS = {
    "aws": {"region": None, "url": None, "addressing": "virtual", "needs_url": False},
    "minio": {"region": None, "url": None, "addressing": "path", "needs_url": True},
    "bos": {"region": "bj", "url": "https://s3.{region}.bcebos.com", "addressing": "virtual", "needs_url": False},
    "r2": {"region": "auto", "url": None, "addressing": "path", "needs_url": True},
    "b2": {"region": None, "url": "https://s3.{region}.backblazeb2.com", "addressing": "path", "needs_url": False},
    "oss": {"region": None, "url": "https://{region}.aliyuncs.com", "addressing": "virtual", "needs_url": False},
}


def apply_preset(config: Config) -> Config:
    if not config.profile:
        return config
    preset = PRESETS.get(config.profile.lower())
    if preset is None:
        return config
    region = config.region or preset["region"]
    url = config.endpoint_url or (preset["url"].format(region=region) if preset["url"] and region else None)
    if preset["needs_url"] and not url:
        raise ConfigError(f"{config.profile} needs an endpoint URL")
    style = preset["addressing"] if config.addressing_style == "auto" else config.addressing_style
    return replace(config, endpoint_url=url, addressing_style=style)


def spark_settings(input_bytes: int, cores: int) -> dict[str, str]:
    """Shuffle partitions of about 128 MB, at least two a core; scans of 128 MB.

    Joins sort and spill, but hash where the partitions, as measured when they are there, are all small.
    """
    parts = max(2 * cores, -(-input_bytes // (128 << 20)))
    return {
        "spark.sql.shuffle.partitions": str(parts), "spark.sql.files.maxPartitionBytes": "128m",
        "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
    }


def session(cores: int | str = "*", input_bytes: int = 0, **conf: str) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]")
    n = os.cpu_count() or 1 if cores == "*" else int(cores)
    for k, v in (spark_settings(input_bytes, n) | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
