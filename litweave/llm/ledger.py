"""Copies hidden by formatting differences, counted in an incremental ledger.

The ledger is a table (key, n_copies, first_id, earliest_at, earliest_id) in hash buckets. A batch is aggregated by
canonical key (map-side first), full-outer-joined with the buckets it touches and only those are written anew: counts add
up, the smallest id and the earliest arrival stay the representatives. A generation of files becomes valid with its
manifest, which is numbered and written whole before it gets its name; the newest one counts, so a merge that fails at any
point changes nothing. Files that a merge replaces stay until the next one, for readers that are under way. Buckets that
have grown to twice their size are split in two.

Defined results
    * a field null, without letters and digits, or reading as NA: the row has no key and stays outside the ledger.
    * key: SHA-256 over both canonical fields in sorted order, so swapped fields give the same key.
    * a repeated row counts as one more copy; of rows that arrived at the same time the smallest id is the earliest, and a
      row without time comes before all others.
    * empty batch: the ledger stays as it is. Texts of any length; other columns are not read.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from litweave.runtime import delete_path, materialise, new_path, skew_join

_COLUMNS = "key binary, n_copies long, first_id long, earliest_at long, earliest_id long"
#: Keys a bucket is made for.
BUCKET_ROWS = 2_000_000
_NO_TIME = -(1 << 62)


def canonical(col: Column) -> Column:
    """Letters and digits only, letter case aside.

    Upper case comes first, so that ß reads as ss; the removal stands between both because the optimizer takes
    lower(upper(x)) for lower(x).
    """
    return F.lower(F.regexp_replace(F.upper(col), r"[^\p{L}\p{N}]+", ""))


def canonical_key(*fields: Column) -> Column:
    """Identity of a record whatever the order of its fields; null where a field says nothing."""
    read = [canonical(f) for f in fields]
    said = F.lit(True)
    for r in read:
        said = said & F.coalesce((r != "") & (r != "na"), F.lit(False))
    # lengths keep ("ab", "c") and ("a", "bc") apart
    parts = F.transform(F.sort_array(F.array(*read)), lambda x: F.concat(F.length(x).cast("string"), F.lit(":"), x))
    return F.when(said, F.unhex(F.sha2(F.concat_ws("|", parts), 256)))


class DuplicateLedger:
    """A persistent ledger at ``path``; opening the same path again continues it. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, bucket_rows: int = BUCKET_ROWS) -> None:
        self.spark, self.path, self.buckets, self.bucket_rows = spark, path, buckets, bucket_rows
        self.generation, self.where, self.stale = 0, {}, []
        for n in sorted(self._manifests(), reverse=True):
            try:
                said = json.loads(self.spark.read.text(f"{self.path}/manifest-{n:012d}.json", wholetext=True).first()[0])
            except (ValueError, TypeError):
                continue
            self.generation, self.buckets, self.where, self.stale = said["generation"], said["buckets"], {int(k): v for k, v in said["where"].items()}, said["stale"]
            break

    def _fs(self, name: str = ""):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _manifests(self) -> list[int]:
        fs, p = self._fs()
        names = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
        return [int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json")]

    def _commit(self, generation: int, where: dict[int, int], buckets: int) -> None:
        """Make a generation valid, then remove what the one before it had replaced."""
        splits, kept = buckets != self.buckets, {(g, b) for b, g in where.items()}
        gone = [] if splits else self.stale  # a split follows a merge: what that replaced stays, too
        if splits:
            stale = [*self.stale, *([g, None] for g in sorted(set(self.where.values())))]
        else:
            stale = [[g, b] for b, g in self.where.items() if (g, b) not in kept]
        fs, tmp = self._fs(f"writing-{generation:012d}")
        out = fs.create(tmp, True)
        out.write(bytearray(json.dumps({"generation": generation, "buckets": buckets, "where": where, "stale": stale}).encode()))
        out.close()
        _, to = self._fs(f"manifest-{generation:012d}.json")
        if not fs.rename(tmp, to):
            raise OSError(f"generation {generation} was written by another ledger")
        self.generation, self.where, self.buckets, self.stale = generation, where, buckets, stale
        for g, b in gone:
            delete_path(self.spark, f"{self.path}/gen={g}" if b is None else f"{self.path}/gen={g}/bucket={b}")
        for n in self._manifests():
            if n < generation - 1:
                delete_path(self.spark, f"{self.path}/manifest-{n:012d}.json")

    def _read(self, buckets: list[int]) -> DataFrame:
        paths = [f"{self.path}/gen={self.where[b]}/bucket={b}" for b in buckets if b in self.where]
        if not paths:
            return self.spark.createDataFrame([], f"{_COLUMNS}, bucket int")
        return self.spark.read.schema(_COLUMNS).parquet(*paths).withColumn("bucket", self._bucket(F.col("key"), self.buckets))

    @staticmethod
    def _bucket(key: Column, buckets: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")

    def _write(self, rows: DataFrame, generation: int, buckets: int) -> int:
        """Write rows with their bucket, a task a bucket, and tell how many there were."""
        seen = Observation()
        rows.repartition(buckets, "bucket").observe(seen, F.count("*").alias("n")).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/gen={generation}")
        return seen.get["n"]

    def merge(self, batch: DataFrame) -> None:
        """Add a batch (key, id, at). Rows without key are left out."""
        first = F.min(F.struct(F.coalesce("at", F.lit(_NO_TIME)).alias("at"), "id"))
        new = batch.where(F.col("key").isNotNull()).groupBy("key").agg(F.count("*").alias("n_new"), F.min("id").alias("first_new"), first.alias("new"))
        new = materialise(new.withColumn("bucket", self._bucket(F.col("key"), self.buckets)), "ledger-batch")
        touched = [r[0] for r in new.select("bucket").distinct().collect()]  # at most the number of buckets
        if not touched:
            return
        both = new.join(self._read(touched), ["bucket", "key"], "full_outer")
        old = F.when(F.col("n_copies").isNotNull(), F.struct(F.col("earliest_at").alias("at"), F.col("earliest_id").alias("id")))
        merged = both.withColumn("e", F.least(old, "new")).select(
            "bucket",
            "key",
            (F.coalesce("n_copies", F.lit(0)) + F.coalesce("n_new", F.lit(0))).cast("long").alias("n_copies"),
            F.least("first_id", "first_new").alias("first_id"),
            F.col("e.at").alias("earliest_at"),
            F.col("e.id").alias("earliest_id"),
        )
        gen = self.generation + 1
        rows = self._write(merged, gen, len(touched))
        self._commit(gen, self.where | dict.fromkeys(touched, gen), self.buckets)
        if rows > 2 * self.bucket_rows * len(touched):
            self.split()

    def split(self) -> None:
        """Rewrite the ledger with twice as many buckets: the keys of a bucket go to it or to its new partner."""
        gen, buckets = self.generation + 1, 2 * self.buckets
        rows = self._read(sorted(self.where)).withColumn("bucket", self._bucket(F.col("key"), buckets))
        self._write(rows, gen, buckets)
        fs, at = self._fs(f"gen={gen}")
        held = [int(x.getPath().getName()[7:]) for x in fs.listStatus(at) if x.getPath().getName().startswith("bucket=")]
        self._commit(gen, dict.fromkeys(held, gen), buckets)

    def read(self) -> DataFrame:
        """(key, n_copies, first_id, earliest_at, earliest_id) of everything merged so far; earliest_at null without time."""
        return self._read(sorted(self.where)).drop("bucket").withColumn("earliest_at", F.when(F.col("earliest_at") > _NO_TIME, F.col("earliest_at")))


def collapse_copies(df: DataFrame, id_col: str, fields: tuple[str, ...], at: str, batches: int = 3, bucket_rows: int = BUCKET_ROWS) -> tuple[DataFrame, DataFrame]:
    """Replay a table into a ledger in the order of arrival: (ledger, keyed rows (key, id)).

    The batches hold about equally many rows; rows without time come first. Buckets are made for about ``bucket_rows``
    keys each, so that one task writes one bucket at any size.
    """
    spark = df.sparkSession
    keyed = df.select(canonical_key(*[F.col(f) for f in fields]).alias("key"), F.col(id_col).alias("id"), F.unix_micros(F.col(at).cast("timestamp")).alias("at")).where(F.col("key").isNotNull())
    keyed = materialise(keyed, "ledger-keys")
    bounds, n = keyed.agg(F.percentile_approx("at", [k / batches for k in range(1, batches)], 1000), F.count("*")).first()
    ledger = DuplicateLedger(spark, new_path(spark, "ledger"), max(8, n // bucket_rows), bucket_rows)
    number = F.lit(0)
    for b in bounds or []:
        number = number + F.coalesce((F.col("at") > b).cast("int"), F.lit(0))
    for b in range(batches):
        ledger.merge(keyed.where(number == b))
    return ledger.read(), keyed.select("key", "id")


def copies(ledger: DataFrame, keyed: DataFrame) -> DataFrame:
    """(first_id, copy_id): every row but the representative of its group. Only groups of two and more are joined."""
    several = ledger.where(F.col("n_copies") > 1).select("key", "first_id")
    return skew_join(keyed, several, "key").where(F.col("id") != F.col("first_id")).select("first_id", F.col("id").alias("copy_id")).distinct()
