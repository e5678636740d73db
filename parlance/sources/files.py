"""Sources and sinks: JSON documents in and out, CSV out, tables."""

from __future__ import annotations

import csv
import io
import json
import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from parlance.sources import arrays

ROOT_VARIABLE = "PARLANCE_ROOT"
SPLITS = ("val", "test")
DATASET = "source_index string, instruction string, input string, output string"
PREPARED = DATASET + ", component_ids array<string>, eval_type string, input_tokens int"
FACTS = "struct<speakers:array<string>,numbers:array<string>,mentioned_people:array<string>>"
MODE = (
    "struct<summary:string,requested_mode:string,actual_mode:string,chunk_count:int,chunks:array<struct<text:string,turn_indices:array<int>,token_count:int>>,"
    f"chunk_summaries:array<string>,input_coverage:double,truncated:boolean,source_facts:{FACTS},deduplicated_turns:int,deduplication_applied:boolean,"
    "generated_tokens_total:int,final_tokens:int,peak_memory_gb:double,total_seconds:double,"
    "rouge:struct<rouge1:double,rouge2:double,rougeL:double,rouge1_recall:double>,error_proxy:struct<speaker:int,number:int,omission:double,critical:double>>"
)
RECORDS = f"split string, count int, complete boolean, test_split_read boolean, records array<struct<source_index:string,eval_type:string,input_tokens:int,dialogue:string,reference:string,direct:{MODE},hierarchical:{MODE}>>"


def root(given: str | None = None) -> str:
    """The data folder: given, or the environment's, or the working directory."""
    return given or os.environ.get(ROOT_VARIABLE) or os.getcwd()


def check_split(split: str) -> str:
    if split not in SPLITS:
        raise ValueError(f"split must be one of {', '.join(SPLITS)}")
    return split


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_dataset(spark: SparkSession, path: str, schema: str = DATASET) -> DataFrame:
    """A JSON array of rows, with an explicit schema; a large one is read by several tasks."""
    return arrays.read_array(spark, path, schema)


def read_split(spark: SparkSession, folder: str, split: str, prepared: bool = False) -> DataFrame:
    """A split's rows, with the flag that tells whether the test split was read."""
    check_split(split)
    path = f"{folder}/long_dialogue/{split}/combined.json" if prepared else f"{folder}/samsum/{split}.json"
    return read_dataset(spark, path, PREPARED if prepared else DATASET).withColumn("test_split_read", F.lit(split == "test"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of an evaluation file, one row each."""
    return spark.read.schema(RECORDS).option("multiLine", True).json(path).select(F.explode("records").alias("r")).select("r.*")


def read_if_there(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a previous run (Parquet), or none."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def append_records(records: DataFrame, path: str) -> None:
    """Adds a batch; a run that is started again reads it and leaves its keys out."""
    records.write.mode("append").parquet(path)


class Ledger:
    """Records in parts, each written once. A part is a folder of its own; it counts when its write has
    ended (Spark's marker _SUCCESS), and is written anew if it has not. For one writer at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._folder = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._files = self._folder.getFileSystem(spark._jsc.hadoopConfiguration())

    def parts(self) -> list[str]:
        """Names of the parts that count."""
        if not self._files.exists(self._folder):
            return []
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        names = sorted(x.getPath().getName() for x in self._files.listStatus(self._folder) if x.isDirectory())
        return [n.removeprefix("part=") for n in names if self._files.exists(path(f"{self.path}/{n}/_SUCCESS"))]

    def read(self, schema: str | StructType | None = None) -> DataFrame:
        """The records (of a part at least, if no schema is given)."""
        folders = [f"{self.path}/part={n}" for n in self.parts()]
        if not folders:
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(*folders)

    def add(self, name: str, records: DataFrame) -> None:
        """Writes a part; ``name`` gets the number of its parts so far, so later rows have parts of their own."""
        many = sum(n.rpartition(".")[0] == name for n in self.parts())
        records.write.mode("overwrite").parquet(f"{self.path}/part={name}.{many}")


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines, one file per partition, overwriting."""
    df.write.mode("overwrite").json(path)


def _one_file(lines: DataFrame, path: str, separator: str, head: bytes, tail: bytes, drop: int = 0) -> None:
    """lines: one string column. A single file of their texts, each followed by the separator, in the order of
    the frame: tasks write parts beside it, which are then copied behind one another as streams of bytes,
    without the last ``drop`` bytes; no row reaches the driver. The file replaces an older one when it is whole."""
    spark = lines.sparkSession
    java, parts, new = spark._jvm, f"{path}.parts-{uuid.uuid4().hex}", f"{path}.new-{uuid.uuid4().hex}"
    place = java.org.apache.hadoop.fs.Path
    files = place(path).getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        lines.write.option("lineSep", separator).text(parts)
        found = sorted((x.getPath().getName(), x.getLen()) for x in files.listStatus(place(parts)) if x.getPath().getName().startswith("part-") and x.getLen())
        left = max(0, sum(size for _, size in found) - drop)
        out = files.create(place(new), True)
        try:
            out.write(bytearray(head))
            for name, size in found:
                source = files.open(place(f"{parts}/{name}"))
                try:
                    java.org.apache.commons.io.IOUtils.copyLarge(source, out, 0, min(size, left))
                finally:
                    source.close()
                left -= min(size, left)
            out.write(bytearray(tail))
        finally:
            out.close()
        files.delete(place(path), True)
        if not files.rename(place(new), place(path)):
            raise OSError(f"{path} could not be written")
    finally:
        files.delete(place(parts), True)
        files.delete(place(new), True)


def write_report(df: DataFrame, path: str) -> str | None:
    """A report as one pretty UTF-8 JSON document, overwriting: the object of a single row, whose text is
    returned, or an array of any number."""

    def pretty(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            texts = [json.dumps(json.loads(x), ensure_ascii=False, indent=2) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["value"])

    lines = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).mapInArrow(pretty, "value string")
    first = lines.limit(2).collect()
    if len(first) == 1:
        _one_file(lines, path, "\n", b"", b"", 1)
        return first[0]["value"]
    if not first:
        _one_file(lines, path, "\n", b"[]", b"")
    else:
        indented = lines.select(F.regexp_replace("value", "(?m)^", "  ").alias("value"))
        _one_file(indented, path, ",\n", b"[\n", b"\n]", 2)
    return None


def write_csv(df: DataFrame, path: str) -> None:
    """Distributed CSV with a header; quotes keep line feeds within fields."""
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def _field(value: Column) -> Column:
    """A CSV field: quoted if it holds a comma, a quote or a line end. Null is empty."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def write_sheet(df: DataFrame, path: str) -> None:
    """A sheet as one CSV file with a byte order mark, as spreadsheets expect, overwriting. Line feeds within
    fields stay."""
    header = io.StringIO()
    csv.writer(header).writerow(df.columns)
    fields = [_field(F.col("`" + c.replace("`", "``") + "`")) for c in df.columns]
    line = F.array_join(F.array(*fields), ",")
    if len(fields) == 1:  # an empty line would be no row
        line = F.when(line == "", '""').otherwise(line)
    _one_file(df.select(line.alias("value")), path, "\r\n", ("\ufeff" + header.getvalue()).encode(), b"")


EXAMPLES = (
    ("short", "Mara: Can we move the review to 3:00 PM?\nIvo: Yes, I will book the small room.\nMara: I will send the agenda today.\nIvo: Thanks!"),
    ("long", "\n".join(["\n".join([f"{a}: I will check part {k}." for k, a in enumerate(("Mara", "Ivo", "Lena", "Tariq") * 4, 1)])] * 4)),
)


def examples(spark: SparkSession) -> DataFrame:
    """Two built-in dialogues: one of 4 lines, one of 16 lines four times over."""
    return spark.createDataFrame(list(EXAMPLES), "name string, dialogue string")
