"""What the operators share: tables in the shared folder, filters before joins, row keys."""

from __future__ import annotations

import atexit
import io
import os
import shutil
import tempfile
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .textops import U64, mix

#: Texts go to Python in batches of about so many bytes, so that a worker's memory stays small, if the session leaves Spark's default.
BATCH_SETTING, BATCH_BYTES, BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "8m", 64 << 20
#: Up to so many keys (40 MB in memory) are broadcast as they are; beyond it a filter of them is.
EXACT_KEYS = 1 << 19
#: A filter of keys has so many bits a key, so many places for each, and at most so many bits (8 MB).
FILTER_BITS, FILTER_PLACES, MOST_FILTER_BITS = 12, 4, 1 << 26
#: Types of ids that can be keys as they are.
WHOLE = ("tinyint", "smallint", "int", "bigint")

_own_folders: dict[str, str] = {}
_sent: set[str] = set()
_roots: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share.

    Read from ``spark.checkpoint.dir``. Only where that is unset (tests on one machine) a folder
    of our own is made, and only with a local master.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folders:
        _own_folders[app] = tempfile.mkdtemp(prefix="scrubline-")
        atexit.register(shutil.rmtree, _own_folders[app], ignore_errors=True)
    return "file://" + _own_folders[app]


class Scratch:
    """Intermediate tables of one operator call, written to the shared folder.

    A written table cuts the lineage: when an executor is lost, only the tasks that read the table run
    again. ``drop`` removes one as soon as nothing will read it any more.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/scrubline/{name}-{uuid.uuid4().hex}"
        self.n = 0
        _roots.append(self.root)
        atexit.register(_remove, spark, self.root)

    def path(self) -> str:
        """A path that nothing has yet."""
        self.n += 1
        return f"{self.root}/{self.n}"

    def write(self, df: DataFrame, compression: str | None = None) -> DataFrame:
        """``df`` as a table that has been written, with its path as ``.path``."""
        path = self.path()
        schema = df.schema
        df.write.parquet(path, compression=compression)
        out = self.spark.read.schema(schema).parquet(path)
        out.path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            _remove(self.spark, t.path)


def marked() -> int:
    """A mark for ``clear``."""
    return len(_roots)


def clear(spark: SparkSession, since: int = 0) -> None:
    """Removes the intermediate tables of all operator calls since ``marked`` gave ``since``, once what they returned has been written.

    What an operator returns reads its tables when it runs, so they can't go before; without this they go when Python ends.
    """
    while len(_roots) > since:
        _remove(spark, _roots.pop())


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is None:
        return
    try:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session ended first
        if path.startswith("file:"):
            shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


def _places(keys: np.ndarray, bits: int) -> np.ndarray:
    h = mix(keys.astype(np.int64).view(U64))
    step = mix(h) | U64(1)
    return (h[None, :] + np.arange(FILTER_PLACES, dtype=U64)[:, None] * step[None, :]) & U64(bits - 1)


def _hashed(df: DataFrame, name: str) -> Column:
    """The column as a long: itself, or a hash of it where it is of another type."""
    c = col(name)
    return c.cast("long") if kind_of(df, name) in WHOLE else F.xxhash64(c)


def likely_in(df: DataFrame, name: str, keys: DataFrame, apart: bool = False) -> DataFrame | tuple[DataFrame, DataFrame]:
    """The rows of ``df`` whose column ``name`` is in the one column of ``keys`` (a written table), and perhaps one in a hundred others.

    Put before a join, so that rows without a partner aren't shuffled. Up to EXACT_KEYS keys are broadcast themselves; for more, a
    Bloom filter is. Where it would have over MOST_FILTER_BITS, all rows pass. With ``apart`` also the other rows.
    """
    return _likely_in(df, name, keys, keys.count(), apart)


def _likely_in(df: DataFrame, name: str, keys: DataFrame, n: int, apart: bool = False) -> DataFrame | tuple[DataFrame, DataFrame]:
    if n <= EXACT_KEYS:
        found = _broadcast_join(df, name, keys, "left_semi")
        return (found, _broadcast_join(df, name, keys, "left_anti")) if apart else found
    bits = 1 << max(10, (n * FILTER_BITS - 1).bit_length())
    if bits > MOST_FILTER_BITS:
        return (df, df.limit(0)) if apart else df

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits >> 3, np.uint8)
        for b in batches:
            at = np.unique(_places(b.column(0).to_numpy(), bits))
            np.bitwise_or.at(own, (at >> U64(3)).astype(np.int64), (1 << (at & U64(7)).astype(np.uint8)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(own.tobytes(), 1)], pa.binary())], ["bits"])

    whole = np.zeros(bits >> 3, np.uint8)
    hashed = keys.select(_hashed(keys, keys.columns[0]).alias("k")).filter("k is not null")
    for r in hashed.coalesce(4).mapInArrow(fill, "bits binary").toLocalIterator():
        whole |= np.frombuffer(zlib.decompress(r["bits"]), np.uint8)
    shared = df.sparkSession.sparkContext.broadcast(whole)

    @F.pandas_udf("boolean")
    def known(values):
        import pandas as pd

        at = _places(values.to_numpy(), bits)
        return pd.Series(((shared.value[(at >> U64(3)).astype(np.int64)] >> (at & U64(7)).astype(np.uint8)) & 1).all(axis=0))

    found = col(name).isNotNull() & known(F.coalesce(_hashed(df, name), F.lit(0)))
    return (df.filter(found), df.filter(~found)) if apart else df.filter(found)


def _broadcast_join(df: DataFrame, name: str, keys: DataFrame, kind: str) -> DataFrame:
    (other,) = free_name(df, "__in")
    return df.join(F.broadcast(keys.toDF(other)), col(name) == F.col(other), kind)


def within(df: DataFrame, name: str, keys: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``name`` is in the one column of ``keys``, of a written table; read once, and only those are shuffled that likely are."""
    n = keys.count()
    if n <= EXACT_KEYS:
        return _broadcast_join(df, name, keys, "left_semi")
    (other,) = free_name(df, "__in")
    return _likely_in(df, name, keys, n).join(keys.toDF(other), col(name) == F.col(other), "left_semi")


def without(df: DataFrame, name: str, keys: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``name`` isn't in the one column of ``keys``, of a written table; only those are shuffled that likely are.

    Keys that can be broadcast as they are need one pass over ``df``; with a filter of them a second one reads the rows outside it.
    """
    n = keys.count()
    if n <= EXACT_KEYS:
        return _broadcast_join(df, name, keys, "left_anti")
    some, others = _likely_in(df, name, keys, n, apart=True)
    (other,) = free_name(df, "__in")
    return some.join(keys.toDF(other), col(name) == F.col(other), "left_anti").union(others)


def free_name(df: DataFrame, *wanted: str) -> list[str]:
    """Names like ``wanted`` that no column of ``df`` has, compared without case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for w in wanted:
        name = w
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def col(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def kind_of(df: DataFrame, name: str) -> str:
    """The type of a column by its exact name, as SQL writes it."""
    return df.select(col(name)).schema[0].dataType.simpleString()


def keyed(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", key: str = "__key") -> DataFrame:
    """``docs`` with a long column ``key`` that is unique, never null and in the order of ``id_col``, nulls last.

    Ids of any type that can be sorted are never cast. Whole numbers that are unique and not null are keys as they are, and ``.ids`` of the
    result is None. Otherwise the rows are copied to the shared folder as they lie, without a shuffle, each with its place; places alone are
    put in order of (id, text hash, place) and numbered, and the numbers are looked up by place. ``.ids`` is then the written table
    (key, doc_id) of all rows.
    """
    if kind_of(docs, id_col) in WHOLE:
        times = docs.groupBy(col(id_col).alias("i")).agg(F.count("*").alias("n"))
        most, nulls = times.agg(F.max("n"), F.count_if(F.col("i").isNull())).first()
        if (most or 0) <= 1 and not nulls:
            out = docs.withColumn(key, col(id_col).cast("long"))
            out.ids = None
            return out
    (place,) = free_name(docs, "__place")
    rows = scratch.write(docs.withColumn(place, F.monotonically_increasing_id()))
    order = [F.asc_nulls_last("doc_id"), F.asc("h"), F.asc("place")]
    places = rows.select(col(id_col).alias("doc_id"), F.xxhash64(col(text_col)).alias("h"), col(place).alias("place"))
    numbered = scratch.write(places.repartitionByRange(*order).sortWithinPartitions(*order).select("place", "doc_id", F.monotonically_increasing_id().alias("key")))
    if numbered.count() <= EXACT_KEYS:
        out = rows.join(F.broadcast(numbered.select(F.col("place").alias(place), F.col("key").alias(key))), place)
    else:
        out = rows.withColumn(key, _looked_up(numbered, scratch)(col(place)))
    out = out.select(*[col(c) for c in docs.columns], col(key))
    out.ids = numbered.select("key", "doc_id")
    return out


def _looked_up(numbered: DataFrame, scratch: Scratch):
    """A function of places to the keys in ``numbered``: a task reads the keys of the partitions whose places it meets, one at a time."""
    path = scratch.path()
    split = numbered.select(F.shiftright("place", 33).alias("p"), "place", "key").repartition("p").sortWithinPartitions("p", "place")
    split.write.partitionBy("p").parquet(path)

    @F.pandas_udf("long")
    def look_up(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from pyarrow import fs
        from pyarrow import parquet

        system, folder = fs.FileSystem.from_uri(path if "://" in path else "file://" + path)
        own, places, keys = -1, np.zeros(0, np.int64), np.zeros(0, np.int64)
        for s in series:
            asked = s.to_numpy()
            out = np.zeros(len(asked), np.int64)
            for p in np.unique(asked >> 33):
                if p != own:
                    table = parquet.read_table(f"{folder}/p={p}", filesystem=system, columns=["place", "key"], partitioning=None)
                    own, places, keys = p, *(table.column(c).to_numpy() for c in ("place", "key"))
                    order = np.argsort(places)
                    places, keys = places[order], keys[order]
                here = asked >> 33 == p
                out[here] = keys[np.searchsorted(places, asked[here])]
            yield pd.Series(out)

    return look_up


def with_ids(pairs: DataFrame, rows: DataFrame, *names: str) -> DataFrame:
    """``pairs`` of keys, of ``keyed`` ``rows``, with the ids in their place, each column under a name of ``names``."""
    out = pairs.toDF(*names)
    if rows.ids is None:
        return out
    for n in names:
        out = out.join(rows.ids.select(F.col("key").alias(n), F.col("doc_id").alias("__" + n)), n).drop(n).withColumnRenamed("__" + n, n)
    return out.select(*names)


def package_zip() -> bytes:
    """The package's modules as a zip file that Python can import from."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in sorted(os.walk(root)):
            for f in sorted(files):
                if f.endswith(".py"):
                    z.write(os.path.join(folder, f), os.path.relpath(os.path.join(folder, f), os.path.dirname(root)))
    return raw.getvalue()


def send_package(spark: SparkSession) -> None:
    """Adds the package to what Spark hands to Python workers, from the shared folder, once an application."""
    sc = spark.sparkContext
    if sc.applicationId in _sent:
        return
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/scrubline/package-{uuid.uuid4().hex}/scrubline.zip")
    out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(package_zip()))
    out.close()
    sc.addPyFile(path.toString())
    _sent.add(sc.applicationId)


def ship_package(spark: SparkSession) -> None:
    """Lets Python workers import the package, and sets the session's batches to Python to BATCH_BYTES if it left Spark's default.

    Workers on this machine find it by its path; those of a cluster get it as a file (``send_package``). The size of a batch is a setting of the
    session, as it counts when a plan runs, which is after the operator returned it.
    """
    if spark.conf.get(BATCH_SETTING) in (str(BATCH_DEFAULT), f"{BATCH_DEFAULT}b", "64m", "64MB"):
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)
    if not spark.sparkContext.master.startswith("local"):
        send_package(spark)
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
