"""Session defaults, shared-folder tables and table reading."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def build_session(cpus: int = 8, memory: str = "8g", partitions: int | None = None) -> SparkSession:
    """A local session with the settings the operators are written for."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("notefathom")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset a local session gets one of its own; on a cluster that is an error, since a machine's own folder
    would hold only what its own executor wrote.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jsc = spark.sparkContext._jsc.sc()
        found = jsc.getCheckpointDir().get() if jsc.getCheckpointDir().isDefined() else None
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = os.path.join(tempfile.gettempdir(), "notefathom-shared")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut_lineage(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back.

    Lost executors cannot take the result with them, and the columnar, compressed files are far smaller than
    a row checkpoint.  The folder goes with ``discard`` or ``drop_cuts``, at the latest when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    delete_at_exit(spark, path)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut = path
    _CUTS.append(path)
    return out


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """Have a folder deleted when the application ends."""
    _file_system(spark, path).deleteOnExit(spark._jvm.org.apache.hadoop.fs.Path(path))


#: Folders written by this process.
_CUTS: list[str] = []


def _file_system(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())


def _delete(spark: SparkSession, path: str) -> None:
    _file_system(spark, path).delete(spark._jvm.org.apache.hadoop.fs.Path(path), True)


def discard(cut: DataFrame) -> None:
    """Delete a table of ``cut_lineage`` that nothing will read again."""
    _delete(cut.sparkSession, cut._cut)
    if cut._cut in _CUTS:
        _CUTS.remove(cut._cut)


def drop_cuts(spark: SparkSession) -> None:
    """Delete all tables this process cut; call it when the results that rest on them have been written."""
    while _CUTS:
        _delete(spark, _CUTS.pop())


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a test or production folder; a Parquet file or a folder of them."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Applications and the classes that they have.
_ADDED: set[tuple[str, str]] = set()


def java_class(spark: SparkSession, name: str, source: str):
    """A Java class for the driver and all executors, compiled by the compiler that Spark compiles its plans with.  None if there is none."""
    state, jvm = spark._jsparkSession.sharedState(), spark._jvm
    key = (spark.sparkContext.applicationId, name)
    if key not in _ADDED:
        compiler = jvm.org.codehaus.janino.SimpleCompiler
        if not callable(compiler):
            return None
        compiler = compiler()
        compiler.cook(source)
        path = os.path.join(tempfile.mkdtemp(prefix="notefathom-"), f"{name}.jar")
        with zipfile.ZipFile(path, "w") as jar:
            for k, code in compiler.getBytecodes().items():
                jar.writestr(k.replace(".", "/") + ".class", bytes(code))
        delete_at_exit(spark, f"file://{os.path.dirname(path)}")
        spark.sql(f"ADD JAR '{path}'")
        _ADDED.add(key)
    return state.jarClassLoader().loadClass(name)
