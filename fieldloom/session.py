"""Session, checkpoint and join-size helpers shared by all operators."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if its counted rows times its row width stay below this.
BROADCAST_BYTES = 48 << 20


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("fieldloom")
    conf = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": memory,
        "spark.driver.host": "127.0.0.1",
    }
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; a temporary one only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + os.path.join(tempfile.gettempdir(), f"fieldloom-{os.getpid()}")
    return folder.rstrip("/")


def scratch(spark: SparkSession, suffix: str = "") -> str:
    """A path in the shared folder that is removed with the checkpoints."""
    path = f"{shared_folder(spark)}/fieldloom-{uuid.uuid4().hex}{suffix}"
    _written.append((spark, path))
    return path


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage: write the rows once as a table in the shared folder and read them back.

    Unlike an RDD checkpoint this computes the rows once and keeps column
    pruning. The files survive the loss of executors; they are removed at the
    end of the process or by ``drop_checkpoint``.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/fieldloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._fieldloom_path = path
    return out


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def drop_checkpoint(df: DataFrame | None) -> None:
    """Remove the files of a superseded checkpoint; other frames are left alone."""
    path = getattr(df, "_fieldloom_path", None)
    for item in [x for x in _written if x[1] == path]:
        _written.remove(item)
        _remove(*item)


@atexit.register
def drop_checkpoints() -> None:
    """Remove the files of all checkpoints of this process; tables read from them are no longer usable."""
    while _written:
        try:
            _remove(*_written.pop())
        except Exception:  # noqa: BLE001 - the session may be gone already
            return


def row_bytes(df: DataFrame, text: int = 64) -> int:
    """Rough width of a row from its schema; strings and arrays count ``text`` bytes."""
    width = 16
    for field in df.schema.fields:
        name = field.dataType.typeName()
        width += text if name in ("string", "array", "map", "struct", "binary") else 8
    return width


def sized_join(
    large: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    salt_by: str | None = None,
    salts: int | None = None,
    bound: int = BROADCAST_BYTES,
    width: int | None = None,
) -> DataFrame:
    """Join ``small`` (unique or few rows per key) to ``large`` without a hot-key task.

    The rows of ``small`` are counted first. Below ``bound`` bytes it is
    broadcast. Beyond it both sides are shuffled on the key and a salt: rows of
    ``large`` take one of ``salts`` values from ``salt_by`` (by default as many
    as there are shuffle partitions, 16 at least), rows of ``small`` are
    repeated for each, so that one key never lies in one task only.
    ``how`` is inner, left, left_semi or left_anti.
    """
    count = small.count()
    if count * (width or row_bytes(small)) <= bound:
        return large.join(F.broadcast(small), list(on), how)
    if salt_by is None:
        return large.join(small, list(on), how)
    salts = salts or max(16, int(large.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    keyed = large.withColumn("_salt", F.pmod(F.xxhash64(salt_by), F.lit(salts)).cast("int"))
    return keyed.join(salted, [*on, "_salt"], how).drop("_salt")


def skewed_join(large: DataFrame, small: DataFrame, on: Sequence[str], weight: str, hot: int = 100_000) -> DataFrame:
    """Join rows to a table of one row per key whose column ``weight`` tells how many rows have the key.

    Keys of more than ``hot`` rows, of which there are few, are joined by
    ``sized_join``, the others by one shuffle; so no task gets all rows of one
    key. Both inputs are read twice and should be checkpoints. Rows without a
    partner are dropped.
    """
    crowded = small.where(F.col(weight) > hot)
    if not crowded.take(1):
        return large.join(small, list(on))
    marked = sized_join(large, crowded.select(*on, F.lit(True).alias("_hot")), on, "left", salt_by=large.columns[0])
    thin = marked.where("_hot is null").drop("_hot").join(small.where(F.col(weight) <= hot), list(on))
    return thin.unionByName(sized_join(marked.where("_hot").drop("_hot"), crowded, on, salt_by=large.columns[0]))


def fence(df: DataFrame, *columns: str) -> DataFrame:
    """Keep the optimiser from moving filters into long expressions above.

    A projection that holds a nondeterministic expression is neither merged
    with others nor passed by filters, so each of ``columns`` is evaluated once
    per row. Their values do not change. (A comparison of ``rand`` would be
    folded away.)
    """
    always = F.monotonically_increasing_id() >= 0
    return df.withColumns({c: F.when(always, F.col(c)) for c in columns})
