"""Readers: annotation tables, ragged file lists, waveforms in archives, labels in paths; and sinks."""

from __future__ import annotations

import io
import wave
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Behaviour codes of the annotation tables. Fixed values.
CONTEXTS = {0: "Unknown", 1: "Separation", 2: "Biting", 3: "Feeding", 4: "Fighting", 5: "Grooming", 6: "Isolation", 7: "Kissing", 8: "Landing", 9: "Mating protest", 10: "Threat-like", 11: "General", 12: "Sleeping"}
EXCLUDED = ("General", "Sleeping", "Unknown")

ANNOTATION = "FileID string, Emitter string, Addressee string, Context string, `Start sample` string, `End sample` string"


def file_list(spark: SparkSession, path: str) -> DataFrame:
    """FileID, File name, File folder of a CSV whose rows may have more fields than its header: the first three count."""
    lines = spark.read.text(path).select(F.split("value", ",", -1).alias("f"))
    part = lambda i: F.trim(F.get("f", F.lit(i)))
    return lines.select(part(0).alias("FileID"), part(1).alias("File name"), part(2).alias("File folder")).where(F.expr("try_cast(FileID as bigint)").isNotNull()).withColumn("FileID", F.col("FileID").cast("long"))


def code_names(code: Column, names: dict[int, str] = CONTEXTS) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), code)


def annotations(spark: SparkSession, annotation_csv: str, file_csv: str, least_emitter: int | None = 200, known_emitter: bool = False, excluded: tuple[str, ...] = EXCLUDED) -> DataFrame:
    """file_id, file_name, file_folder, emitter, addressee, context, context_name, start, end.

    Files are joined by their first row; fields that are not numbers drop their row; emitters below the least, contexts
    without a name and excluded ones go. known_emitter keeps only those other than 0, least_emitter=None keeps all.
    """
    a = spark.read.csv(annotation_csv, header=True, schema=ANNOTATION, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    number = lambda c, t: F.expr(f"cast(try_cast(`{c}` as double) as {t})")
    a = a.select(number("FileID", "bigint").alias("file_id"), number("Emitter", "int").alias("emitter"), number("Addressee", "int").alias("addressee"), number("Context", "int").alias("context"), number("Start sample", "bigint").alias("start"), number("End sample", "bigint").alias("end"))
    a = a.dropna(subset=["file_id", "emitter", "context", "start", "end"])
    if least_emitter is not None:
        a = a.where(F.col("emitter") >= least_emitter)
    if known_emitter:
        a = a.where("emitter <> 0")
    a = a.withColumn("context_name", code_names(F.col("context"))).where(F.col("context_name").isNotNull() & ~F.col("context_name").isin(*excluded) if excluded else F.col("context_name").isNotNull())
    files = file_list(spark, file_csv).dropDuplicates(["FileID"]).select(F.col("FileID").alias("file_id"), F.col("File name").alias("file_name"), F.col("File folder").alias("file_folder"))
    return a.join(files, "file_id")


def decoded(data: bytes) -> tuple[np.ndarray, int]:
    """Samples between -1 and 1 (first channel) and rate of a PCM WAV file."""
    with wave.open(io.BytesIO(data)) as w:
        width, channels = w.getsampwidth(), w.getnchannels()
        raw = np.frombuffer(w.readframes(w.getnframes()), {1: np.uint8, 2: "<i2", 4: "<i4"}[width]).reshape(-1, channels)[:, 0].astype(float)
        return ((raw - 128) / 128 if width == 1 else raw / 2 ** (8 * width - 1)), w.getframerate()


def archived_waves(spark: SparkSession, path: str) -> DataFrame:
    """file_name, rate, audio, error of each WAV file in ZIP archives (or plain WAV files); what cannot be read has an error."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for where, content in zip(b["path"], b["content"]):
                if where.lower().endswith(".zip"):
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        names = [(n, z.read(n)) for n in z.namelist() if n.lower().endswith(".wav")]
                else:
                    names = [(where.rsplit("/", 1)[-1], content)]
                for name, data in names:
                    try:
                        y, rate = decoded(data)
                        yield pd.DataFrame({"file_name": [name.rsplit("/", 1)[-1]], "rate": [rate], "audio": [y], "error": [None]})
                    except Exception as e:  # noqa: BLE001  a bad file is a row, not a failed job
                        yield pd.DataFrame({"file_name": [name.rsplit("/", 1)[-1]], "rate": [0], "audio": [np.zeros(0)], "error": [str(e)]})

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content").mapInPandas(run, "file_name string, rate int, audio array<double>, error string")


def arrays(spark: SparkSession, path: str) -> DataFrame:
    """path, name, row, values, error: the rows of all numeric arrays in .npy and .npz files (of more than two dimensions
    the rest is laid out flat; a single number is one row). What cannot be read has an error."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for where, content in zip(b["path"], b["content"]):
                try:
                    got = np.load(io.BytesIO(content), allow_pickle=False)
                    named = {"": got} if isinstance(got, np.ndarray) else {n: got[n] for n in got.files}
                    for name, x in named.items():
                        x = np.asarray(x, float)
                        x = x.reshape(len(x), -1) if x.ndim else x.reshape(1, 1)
                        yield pd.DataFrame({"path": where, "name": name, "row": np.arange(len(x)), "values": list(x), "error": None})
                except Exception as e:  # noqa: BLE001  a bad file is a row, not a failed job
                    yield pd.DataFrame({"path": [where], "name": [""], "row": [0], "values": [None], "error": [str(e)]})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.np[yz]").load(path)
    return files.select("path", "content").mapInPandas(run, "path string, name string, row long, values array<double>, error string")


def cut(waves: DataFrame, notes: DataFrame, least: int = 100) -> DataFrame:
    """A row for each annotation with its samples [start, end); shorter ones than "least" go; pos_segment counts within a file."""
    from pyspark.sql import Window

    good = waves.where(F.col("error").isNull()).drop("error")
    out = notes.join(good, "file_name").withColumn("audio", F.slice("audio", F.greatest(F.col("start"), F.lit(0)).cast("int") + 1, F.greatest(F.col("end") - F.col("start"), F.lit(0)).cast("int")))
    out = out.where(F.size("audio") >= least).withColumn("duration_s", F.size("audio") / F.col("rate"))
    return out.withColumn("pos_segment", F.row_number().over(Window.partitionBy("file_id").orderBy("start", "end")) - 1).withColumn("seg_id", F.xxhash64("file_id", "start", "end"))


def path_labels(spark: SparkSession, path: str, pattern: str, group: int = 1) -> DataFrame:
    """path, label: what the pattern's group matches in each file's name."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.regexp_extract(F.element_at(F.split("path", "/"), -1), pattern, group).alias("label"))


def save(df: DataFrame, path: str, kind: str = "parquet", **options) -> None:
    """One folder per result; JSON, CSV, ORC and Parquet keep the rows, "markdown" is for small tables of numbers."""
    if kind != "markdown":
        df.write.mode("overwrite").options(**options).format(kind).option("header", "true").save(path)
        return
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]), F.lit(" |"))
    head = df.sparkSession.createDataFrame([("| " + " | ".join(df.columns) + " |",), ("|" + "---|" * len(df.columns),)], "value string").coalesce(1)
    head.unionByName(df.select(row.alias("value"))).coalesce(1).write.mode("overwrite").text(path)
