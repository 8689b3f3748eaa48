"""Engine settings, checked and applied to a session."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import SparkSession

from flowframe.functions.policy import CHUNK_STRATEGY, MEMORY_LIMIT, parse_bytes

#: What a compression name means to Spark's shuffle and to Parquet.
CODECS = {"none": (None, "uncompressed"), "gzip": ("zstd", "gzip"), "lz4": ("lz4", "lz4"), "zstd": ("zstd", "zstd"), "snappy": ("snappy", "snappy")}
STRATEGIES = ("sqrt_n", "memory_based", "fixed", "adaptive")


@dataclass(frozen=True)
class EngineConfig:
    memory_limit: str | None = None
    chunk_strategy: str = "sqrt_n"
    compression: str = "zstd"
    shuffle_partitions: int | None = None
    max_partition_bytes: str = "128MB"
    checkpoint_dir: str | None = None

    def __post_init__(self):
        if self.chunk_strategy not in STRATEGIES:
            raise ValueError(f"chunk_strategy must be one of {STRATEGIES}")
        if self.compression not in CODECS:
            raise ValueError(f"compression must be one of {tuple(CODECS)}")
        for text in (self.memory_limit, self.max_partition_bytes):
            if text is not None:
                parse_bytes(text)

    def with_defaults(self, **changes) -> EngineConfig:
        """A changed copy; unknown names raise."""
        known = {f.name for f in fields(self)}
        if unknown := set(changes) - known:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return replace(self, **changes)

    def session_settings(self) -> dict[str, str]:
        """What must be set before a session begins, for get_spark(**settings): the shuffle's codec and the shared folder."""
        codec = CODECS[self.compression][0]
        out = {"spark.shuffle.compress": "false"} if codec is None else {"spark.io.compression.codec": codec, "spark.shuffle.compress": "true"}
        return out | ({"spark.checkpoint.dir": self.checkpoint_dir} if self.checkpoint_dir else {})

    def apply(self, spark: SparkSession) -> SparkSession:
        """Sets what a running session lets one set.

        memory_limit bounds what MemoryMonitor takes as the total, chunk_strategy sizes chunks that
        are given no size, checkpoint_dir holds checkpoints and intermediate tables. A folder that
        the session already names cannot be changed: another one is an error.
        """
        named = spark.conf.get("spark.checkpoint.dir", None)
        if self.checkpoint_dir and named and named.rstrip("/") != self.checkpoint_dir.rstrip("/"):
            raise ValueError(f"the session's spark.checkpoint.dir is {named}")
        for name, value in ((CHUNK_STRATEGY, self.chunk_strategy), (MEMORY_LIMIT, self.memory_limit)):
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)
        spark.conf.set("spark.sql.parquet.compression.codec", CODECS[self.compression][1])
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(parse_bytes(self.max_partition_bytes)))
        if self.shuffle_partitions:
            spark.conf.set("spark.sql.shuffle.partitions", str(self.shuffle_partitions))
        if self.checkpoint_dir:
            spark.sparkContext.setCheckpointDir(self.checkpoint_dir)
        return spark
