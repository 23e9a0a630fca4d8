"""Reading and writing the file forms that corpora come in."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.storage import staged


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """JSON lines; malformed ones are dropped, or fail the query if ``strict``. Blank lines are skipped."""
    return spark.read.schema(schema).json(path, mode="FAILFAST" if strict else "DROPMALFORMED")


#: What stands for null in CSV files, where an empty text is an empty field.
CSV_NULL = "\\N"


def read_csv(spark: SparkSession, path: str, schema: str, null: str = CSV_NULL) -> DataFrame:
    """CSV with a header, quoted fields with line ends, and doubled quotes; a field that is ``null`` is null, an empty one is an empty text."""
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, quote='"', escape='"', lineSep="\n", nullValue=null, emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, maxCharsPerColumn=-1)


def write_csv(rows: DataFrame, path: str, mode: str = "errorifexists", null: str = CSV_NULL) -> None:
    """CSV that :func:`read_csv` reads back as it was, with a header in each file; ``mode`` append adds to what is there."""
    rows.write.mode(mode).csv(path, header=True, quote='"', escape='"', quoteAll=True, lineSep="\n", nullValue=null, emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_ranked_csv(rows: DataFrame, path: str, order: list[Column], digits: int = 6) -> None:
    """CSV in order, with all fractional numbers to ``digits`` digits."""
    shown = [F.when(F.col(name).isNotNull(), F.format_string(f"%.{digits}f", name)).alias(name) if kind in ("double", "float") else F.col(name) for name, kind in rows.dtypes]
    write_csv(rows.orderBy(*order).select(*shown), path, "overwrite")


def write_list(words: DataFrame, path: str) -> None:
    """The distinct words of a single column in order, one a line."""
    name = words.columns[0]
    words.filter(F.col(name).isNotNull()).distinct().orderBy(name).select(F.col(name).cast("string").alias("value")).write.mode("overwrite").text(path)


def append_pair(rows: DataFrame, path: str, key: str) -> int:
    """Appends the rows with a new key to ``path``/jsonl and ``path``/csv alike, each key once; the number of rows that were added.

    The Parquet table ``path``/keys is the state: a run that breaks off leaves it behind the pair, so a rerun may add a
    row to the pair again, but never loses one.
    """
    spark = rows.sparkSession
    new = rows.filter(F.col(key).isNotNull()).dropDuplicates([key])
    if _exists(spark, f"{path}/keys"):
        new = new.join(spark.read.parquet(f"{path}/keys"), key, "left_anti").select(*rows.columns)
    new = staged(new, "to-append")
    n = new.count()
    if n:
        new.write.mode("append").json(f"{path}/jsonl")
        write_csv(new, f"{path}/csv", "append")
        new.select(key).write.mode("append").parquet(f"{path}/keys")
    return n


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def read_documents(spark: SparkSession, root: str) -> DataFrame:
    """(model, word, name, text) of one file per document under ``root``/model/word; no rows if there is no file.

    Folders are listed, not files one by one.
    """
    if not _exists(spark, root):
        return spark.createDataFrame([], "model string, word string, name string, text string")
    rows = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.txt").select("value", "_metadata.file_path")
    rows = rows.coalesce(16 * spark.sparkContext.defaultParallelism)  # a few small files would make a task
    parts = F.split(F.col("file_path"), "/")
    return rows.select(F.element_at(parts, -3).alias("model"), F.element_at(parts, -2).alias("word"), F.element_at(parts, -1).alias("name"), F.col("value").alias("text"))


def write_documents(rows: DataFrame, root: str) -> None:
    """One file ``root``/source/lang/name.txt for each row of (source, lang, name, text), on any file system that pyarrow opens; the others fail.

    A file gets its name when it is whole, so a task that is repeated replaces what it wrote.
    """

    def write(batches):
        import uuid

        from pyarrow import fs

        files, top = fs.FileSystem.from_uri(root if ":" in root else "file://" + root)
        made = set()
        for batch in batches:
            for source, lang, name, text in zip(*(batch.column(c).to_pylist() for c in ("source", "lang", "name", "text"))):
                place = f"{top}/{source}/{lang}"
                if place not in made:
                    files.create_dir(place, recursive=True)
                    made.add(place)
                part = f"{place}/.{name}-{uuid.uuid4().hex}"
                with files.open_output_stream(part, compression=None) as f:
                    f.write(text.encode("utf-8", "surrogatepass"))
                files.move(part, f"{place}/{name}.txt")
            yield batch.select(["name"])

    rows.select("source", "lang", "name", "text").mapInArrow(write, "name string").count()


def read_vectors(spark: SparkSession, root: str, size: int) -> DataFrame:
    """(word, vec) of a folder of numpy files, each with a JSON file of the same name that says its ``word``; broken, missing and misshapen ones are skipped, of a word that comes twice the last file by name stands."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, vectors = [], []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                try:
                    x = np.load(io.BytesIO(content), allow_pickle=False)
                except (ValueError, EOFError, OSError):
                    continue
                if x.shape == (size,) and x.dtype.kind == "f":
                    paths.append(path.removesuffix(".npy"))
                    vectors.append(x.astype(np.float64).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(vectors, pa.list_(pa.float64()))], ["at", "vec"])

    if not _exists(spark, root):
        return spark.createDataFrame([], "word string, vec array<double>")
    binary = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    found = binary.option("pathGlobFilter", "*.npy").load(root).select("path", "content").mapInArrow(decode, "at string, vec array<double>")
    meta = binary.option("pathGlobFilter", "*.json").load(root).select(F.regexp_replace("path", r"\.json$", "").alias("at"), F.get_json_object(F.decode("content", "UTF-8"), "$.word").alias("word"))
    rows = found.join(meta.filter(F.trim("word") != ""), "at")
    return rows.groupBy("word").agg(F.max_by("vec", "at").alias("vec"))


#: File names under which a folder may have its phone symbols, in order.
SYMBOL_FILES = ["phones.sym", "phones.syms", "phones.txt"]


def read_symbols(spark: SparkSession, folder: str) -> dict[str, int]:
    """The numbers of the phone symbols of a folder's first symbol file that can be read; empty if there is none. A symbol table has some hundred lines."""
    for name in SYMBOL_FILES:
        if _exists(spark, f"{folder}/{name}"):
            parts = F.split(F.trim("value"), r"\s+")
            rows = spark.read.text(f"{folder}/{name}").select(F.get(parts, F.lit(0)).alias("symbol"), F.get(parts, F.lit(1)).try_cast("int").alias("number")).filter("number is not null").limit(10_001).collect()
            if len(rows) > 10_000:
                raise ValueError("too long for a table of phone symbols")
            if rows:
                return {r.symbol: r.number for r in rows}
    return {}


def read_lines(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """(value): lines that aren't blank; with ``most``, so many for a trial run."""
    rows = spark.read.text(path).filter(F.trim("value") != "")
    return rows if most is None else rows.limit(most)


def read_lexicon(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON files of one entry each; broken files are skipped, and entries without a lemma."""
    rows = spark.read.schema(schema + ", _corrupt_record string").json(path, multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record")
    return rows.filter(F.col("_corrupt_record").isNull() & F.col("lemma").isNotNull()).drop("_corrupt_record")


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """``df``, or an error that names the missing columns."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def first_readable(readers: list[Callable[[], DataFrame]]) -> DataFrame:
    """The first source that can be opened; the last error if none can."""
    error: Exception | None = None
    for reader in readers:
        try:
            return reader()
        except Exception as e:  # noqa: BLE001
            error = e
    raise ValueError("no source can be read") from error


class Sources:
    """Named sources in order: each name gives a function that reads it."""

    def __init__(self) -> None:
        self._readers: dict[str, Callable[[SparkSession], DataFrame]] = {}

    def add(self, name: str, reader: Callable[[SparkSession], DataFrame]) -> None:
        self._readers[name] = reader

    def names(self) -> list[str]:
        return list(self._readers)

    def read(self, spark: SparkSession, most: int | None = None) -> DataFrame:
        """All sources, one after another, by column name; with ``most``, so many rows of each for a trial run."""
        out: DataFrame | None = None
        for reader in self._readers.values():
            rows = reader(spark) if most is None else reader(spark).limit(most)
            out = rows if out is None else out.unionByName(rows)
        if out is None:
            raise ValueError("no sources")
        return out


def append_new(rows: DataFrame, path: str, key: str) -> None:
    """Appends the rows whose key the Parquet table at ``path`` doesn't hold yet, each key once."""
    spark = rows.sparkSession
    new = rows.dropDuplicates([key])
    if _exists(spark, path):
        new = new.join(spark.read.parquet(path).select(key), key, "left_anti").select(*rows.columns)
    new.write.mode("append").parquet(path)


def write_routed(rows: DataFrame, path: str, by: list[str]) -> None:
    """JSON lines in a folder for each value of ``by``; nulls inside records are left out."""
    rows.write.mode("overwrite").partitionBy(*by).json(path)


def publish(rows: DataFrame, path: str, expected: int, check: Callable[[DataFrame], bool] | None = None) -> None:
    """Writes Parquet and keeps it only if it reads back with ``expected`` rows and passes ``check``."""
    spark = rows.sparkSession
    rows.write.mode("overwrite").parquet(path + ".tmp")
    back = spark.read.parquet(path + ".tmp")
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if back.count() != expected or (check is not None and not check(back)):
        fs.delete(fs_path(path + ".tmp"), True)
        raise ValueError("the written table fails its check")
    fs.delete(fs_path(path), True)
    fs.rename(fs_path(path + ".tmp"), fs_path(path))
