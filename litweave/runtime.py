"""Session-level helpers: tables, shared storage and skew-safe joins."""

from __future__ import annotations

import atexit
import io
import json
import math
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A key is hot when it holds about 1/HOT_PARTS of the rows or more.
HOT_PARTS = 256

_written: list[tuple[SparkSession, str]] = []


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a session: they need not have it installed."""
    context = spark.sparkContext
    if getattr(context, "_litweave_shipped", False):
        return
    root = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    path = new_path(spark, "package") + ".zip"
    hadoop = context._jvm.org.apache.hadoop.fs.Path(path)
    out = hadoop.getFileSystem(context._jsc.hadoopConfiguration()).create(hadoop, True)
    out.write(bytearray(packed.getvalue()))
    out.close()
    _written.append((spark, path))
    context.addPyFile(path)
    context._litweave_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: spark.checkpoint.dir. Only a local session may go without it (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local[") and master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="litweave-")
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """An unused path in the shared folder, removed when the driver exits or the enclosing ``scratch`` ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, and survives the loss of executors."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a path of the shared folder."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def _remove(kept: int) -> None:
    while len(_written) > kept:
        spark, path = _written.pop()
        try:
            if spark.sparkContext._jsc is not None:
                delete_path(spark, path)
        except Exception:
            return


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables written inside are removed at the end, when the results have been taken: for long sessions."""
    ship(spark)
    kept = len(_written)
    try:
        yield
    finally:
        _remove(kept)


@atexit.register
def _cleanup() -> None:
    _remove(0)


def spread(df: DataFrame) -> DataFrame:
    """Give CPU-heavy stages at least two tasks a core. Inputs that already have as many splits are not shuffled.

    Rows are dealt round, so that no key, however frequent, decides where they go.
    """
    want = 2 * df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= want else df.repartition(want)


def hot_keys(df: DataFrame, key: str, parts: int = HOT_PARTS) -> dict[int, float]:
    """Hashes of the keys holding about 1/parts of the rows or more (nulls aside), with their share: at most 2 * parts.

    One pass with a mergeable sketch: nothing is shuffled but a sketch a task. The sketch may over- or underrate a share
    by a thousandth of the rows; the answer only decides how a join is laid out, never its result.
    """
    return _shares(df.agg(*_sketch(key, parts)).first().asDict(), parts)


def watch_keys(df: DataFrame, key: str, parts: int = HOT_PARTS) -> tuple[DataFrame, Callable[[], dict[int, float]]]:
    """The same rows, and what ``hot_keys`` says of them once an action has read them: no pass of its own."""
    seen = Observation()

    def said() -> dict[int, float]:
        try:
            return _shares(seen.get, parts)
        except Py4JJavaError:  # the planner found the input empty and left the observation out
            return {}

    return df.observe(seen, *_sketch(key, parts)), said


def _sketch(key: str, parts: int) -> list[Column]:
    item = F.when(F.col(key).isNotNull(), F.xxhash64(key))
    return [F.count(key).alias("n"), F.to_json(F.call_function("approx_top_k", item, F.lit(2 * parts), F.lit(16 * parts))).alias("top")]


def _shares(row: dict, parts: int) -> dict[int, float]:
    if not row["n"] or row["n"] < 100 * parts:
        return {}
    return {r["item"]: r["count"] / row["n"] for r in json.loads(row["top"]) if r.get("item") is not None and r["count"] * parts >= row["n"]}


def _salt(df: DataFrame, key: str, salts: Column, seed: int) -> Column:
    """A number below ``salts`` from the row's other columns (so a retried task gives the same), 0 for most keys."""
    others = [c for c, t in df.dtypes if c != key and "map<" not in t and t != "variant"]
    return F.when(salts > 1, F.pmod(F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in others]), salts)).otherwise(0).cast("int")


def skew_join(big: DataFrame, small: DataFrame, key: str, also: tuple[str, ...] = (), how: str = "inner", hot: dict[int, float] | None = None) -> DataFrame:
    """Join ``big`` (any skew on ``key``) with ``small``, which has few rows a key, in one pass over both.

    Rows of a hot key of ``big`` are spread over as many salts as its share of twice the shuffle partitions; its rows of
    ``small`` are repeated for each salt, so ``small`` grows by at most that number of rows times its rows a key.
    Nothing is broadcast. ``how`` is inner or left; ``hot`` is what ``hot_keys`` or ``watch_keys`` said, if known.
    """
    on = [key, *also]
    hot = hot_keys(big, key) if hot is None else hot
    if not hot:
        return big.join(small, on, how)
    partitions = max(8, int(big.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    number = {h: max(2, math.ceil(2 * share * partitions)) for h, share in hot.items()}
    table = F.create_map(*[F.lit(x) for h, n in number.items() for x in (h, n)])
    salts = F.when(F.xxhash64(key).isin(list(number)), F.try_element_at(table, F.xxhash64(key))).otherwise(1)
    left = big.withColumn("__salts", salts)
    left = left.withColumn("__salt", _salt(big, key, F.col("__salts"), 11)).drop("__salts")
    right = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return left.join(right, [*on, "__salt"], how).drop("__salt")


def to_utc_ntz(col: Column) -> Column:
    """A timestamp without zone, whichever timestamp type the source has."""
    return col.cast("timestamp_ntz")
