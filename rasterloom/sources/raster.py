"""Images in files: reading through Spark's own binary source, and an all-or-nothing sink."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from rasterloom.functions import images
from rasterloom.operators.detect import detect_format
from rasterloom.operators.policy import DecodePolicy


def scan(spark: SparkSession, path: str, policy: DecodePolicy | None = None, glob: str | None = None) -> DataFrame:
    """(path, length, content, format) of the files under a path of any Spark file system.

    A policy's limit on encoded bytes is pushed to the source's length column, so larger files aren't read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    df = (reader.option("pathGlobFilter", glob) if glob else reader).load(path).select("path", "length", "content")
    if policy and policy.max_encoded_bytes is not None:
        df = df.where(F.col("length") <= policy.max_encoded_bytes)
    df = df.withColumn("format", detect_format(F.col("content")))
    return df.where(F.col("format").isin(*policy.formats)) if policy and policy.formats is not None else df


def read(spark: SparkSession, path: str, policy: DecodePolicy | None = None, frames: bool = False) -> DataFrame:
    df = scan(spark, path, policy).select("path", "content")
    return images.decode_frames(df, policy=policy) if frames else images.decode_images(df, policy=policy)


@dataclass
class _Written(WriterCommitMessage):
    names: list[tuple[str, str]]


class ImageSink(DataSource):
    """df.write.format("rasterloom").option("path", uri): columns name (string) and encoded (binary).

    Tasks write under a hidden folder; the driver's commit moves files to their names, and abort removes them, so
    readers see all of a job or nothing. Attempts write to folders of their own."""

    @classmethod
    def name(cls) -> str:
        return "rasterloom"

    def schema(self) -> str:
        return "name string, encoded binary"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _SinkWriter(self.options["path"], overwrite)


class _SinkWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def _fs(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        store, root = self._fs()
        own, names = f"{root}/.{self.job}/{uuid.uuid4().hex}", []
        store.create_dir(own, recursive=True)
        for i, row in enumerate(rows):
            if not row["name"] or row["encoded"] is None:
                raise ValueError("a row of the sink needs a name and its bytes")
            if "/" in row["name"] or row["name"].startswith("."):
                raise ValueError(f"{row['name']!r} is no file name")
            with store.open_output_stream(f"{own}/{i}") as f:
                f.write(bytes(row["encoded"]))
            names.append((f"{own}/{i}", row["name"]))
        return _Written(names)

    def commit(self, messages: list) -> None:
        from pyarrow import fs

        store, root = self._fs()
        moves = [x for m in messages if m for x in m.names]
        if len({n for _, n in moves}) < len(moves):
            self.abort(messages)
            raise ValueError("two rows have one name")
        for at, name in moves:
            if not self.overwrite and store.get_file_info(f"{root}/{name}").type != fs.FileType.NotFound:
                self.abort(messages)
                raise FileExistsError(name)
        for at, name in moves:
            store.move(at, f"{root}/{name}")
        self._drop(store, root)

    def abort(self, messages: list) -> None:
        self._drop(*self._fs())

    def _drop(self, store, root: str) -> None:
        from pyarrow import fs

        if store.get_file_info(f"{root}/.{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/.{self.job}")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ImageSink)


def _save(encoded: DataFrame, path: str, overwrite: bool) -> None:
    register(encoded.sparkSession)
    encoded.write.format("rasterloom").option("path", path).mode("overwrite" if overwrite else "append").save()


def write_images(df: DataFrame, fmt: str, path: str, name: str = "name", image: str = "image", overwrite: bool = False, **options) -> None:
    """Encode images and write each to the file that its `name` says. A row that can't be encoded fails the job, and
    then no file appears."""
    out = images.encode_images(df.select(F.col(name).alias("name"), F.col(image).alias("image")), fmt, **options)
    _save(out.select("name", F.when(F.col("ok"), F.col("encoded")).otherwise(F.raise_error(F.concat(F.lit("not encoded: "), F.coalesce("error.message", F.lit("")))).cast("binary")).alias("encoded")), path, overwrite)


def write_sequences(frames: DataFrame, fmt: str, path: str, name: str = "name", overwrite: bool = False, **options) -> None:
    """The same for frames (name, value: the frame struct of decode_frames), a file for each name."""
    out = images.encode_sequences(frames.select(F.col(name).alias("name"), "value"), fmt, key="name", **options)
    _save(out.select("name", F.when(F.col("ok"), F.col("encoded")).otherwise(F.raise_error(F.concat(F.lit("not encoded: "), F.coalesce("message", F.lit("")))).cast("binary")).alias("encoded")), path, overwrite)
