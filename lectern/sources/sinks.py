"""Sinks: renamed-into-place JSON, tables keyed by id, quarantine, and conditional publishing."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from . import versions


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines that replace what was there as a whole; the sources' readers find them by their path."""
    versions.replace(df, path, "json")


def read_json(spark: SparkSession, path: str, schema) -> DataFrame:
    """What ``write_json`` has written last."""
    return versions.read(spark, path, schema, "json")


def append_records(df: DataFrame, path: str) -> None:
    """Adds answered rows to the ledger table."""
    df.write.mode("append").parquet(path)


def split_quarantine(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that succeeded, and rows that failed with their raw responses."""
    return df.filter("status = 'ok'"), df.filter("status <> 'ok'")


def audit_name(key, stem: str = "essay-request-", ending: str = ".json"):
    """Name of an item's file: a stem and twelve hexadecimal digits of the id's digest."""
    return F.concat(F.lit(stem), F.substring(F.sha2(key, 256), 1, 12), F.lit(ending))


class NamedFiles(DataSource):
    """A sink for rows of name and body: each becomes the file of its name, with the body's bytes as they are.

    A task writes beside the final names; only when all tasks are done are the
    files renamed, so a job that fails leaves none.  Names that occur twice, or
    lead out of the folder, are an error.  The folder is on any file system
    that Arrow reaches from the executors.  Read, it gives name and content of
    all files of the folder, empty ones too, which Spark's own readers skip.
    """

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "name string, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _NamedFilesReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _NamedFilesWriter(self.options["path"])


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")


#: Files of a folder that one task reads.
FILES_A_TASK = 1024


@dataclass
class _Names(InputPartition):
    names: list[str]


class _NamedFilesReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[_Names]:
        from pyarrow import fs

        system, root = _file_system(self.path)
        names = sorted(f.base_name for f in system.get_file_info(fs.FileSelector(root)) if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")))
        return [_Names(names[i : i + FILES_A_TASK]) for i in range(0, len(names), FILES_A_TASK)] or [_Names([])]

    def read(self, partition: _Names) -> Iterator[tuple]:
        system, root = _file_system(self.path)
        for name in partition.names:
            with system.open_input_stream(f"{root}/{name}") as file:
                yield name, file.read()


@dataclass
class _Written(WriterCommitMessage):
    names: list[str]


class _NamedFilesWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.job = path, uuid.uuid4().hex
        system, root = self._open()
        system.create_dir(self._held(root))

    def _open(self):
        return _file_system(self.path)

    def _held(self, root: str) -> str:
        return f"{root}/.{self.job}"

    def write(self, rows: Iterator) -> _Written:
        system, root = self._open()
        # a task that runs again writes to a folder of its own
        own = f"{self._held(root)}/{uuid.uuid4().hex}"
        # once a job was given up its folder is gone, and no task of it can write any more
        system.create_dir(own, recursive=False)
        names = []
        for row in rows:
            if not row["name"] or "/" in row["name"] or row["name"] in (".", ".."):
                raise ValueError(f"no file's name: {row['name']!r}")
            with system.open_output_stream(f"{own}/{row['name']}") as out:
                out.write((row["body"] or "").encode("utf-8"))
            names.append(f"{own.rsplit('/', 1)[-1]}/{row['name']}")
        return _Written(names)

    def commit(self, messages: list) -> None:
        system, root = self._open()
        names = [name for m in messages if m is not None for name in m.names]
        if len({n.split("/")[1] for n in names}) < len(names):
            self.abort(messages)
            raise ValueError("names occur more than once")
        for name in names:
            system.move(f"{self._held(root)}/{name}", f"{root}/{name.split('/')[1]}")
        self.abort(messages)

    def abort(self, messages: list) -> None:
        """Removes what was not renamed."""
        from pyarrow import fs

        system, root = self._open()
        if system.get_file_info(self._held(root)).type == fs.FileType.Directory:
            system.delete_dir(self._held(root))


def write_named(files: DataFrame, folder: str) -> None:
    """Rows of name and body as files of exactly these names."""
    files.sparkSession.dataSource.register(NamedFiles)
    files.select("name", "body").write.format("named_files").mode("append").save(folder)


def read_named(spark: SparkSession, folder: str) -> DataFrame:
    """name and content of a folder's files, empty ones too; hidden ones are left out."""
    spark.dataSource.register(NamedFiles)
    return spark.read.format("named_files").load(folder)


def audited(rows: DataFrame, context: str = "context") -> DataFrame:
    """The rows whose item has a context: only their requests are kept for an audit."""
    return rows.filter(F.coalesce(F.col(context), F.lit("")) != "")


def write_audits(rows: DataFrame, folder: str, key: str = "id", body: str = "payload") -> None:
    """A file for each row, by its audit name; where rows have a context, for those that are ``audited``."""
    rows = audited(rows) if "context" in rows.columns else rows
    write_named(rows.select(audit_name(F.col(key)).alias("name"), F.col(body).alias("body")), folder)


def write_stage(rows: DataFrame, folder: str, stem: str) -> None:
    """What a first call leaves for each item: its request, the raw response and the text, if there is one.

    ``rows`` has id, payload, raw and answer.
    """
    files = F.array(*[F.struct(audit_name(F.col("id"), stem, ending).alias("name"), F.col(body).alias("body")) for ending, body in (("-request.json", "payload"), ("-response.json", "raw"), (".txt", "answer"))])
    write_named(rows.select(F.explode(files).alias("f")).select("f.*").filter("body is not null"), folder)


def write_contexts(contexts: DataFrame, audit: DataFrame, folder: str) -> None:
    """A run that stops after retrieval: the contexts and their audit."""
    write_json(contexts, f"{folder}/contexts")
    write_json(audit, f"{folder}/retrieval")


def tee(lines, path: str):
    """Passes lines on, one by one, and appends each to a file of the driver as it passes."""
    with open(path, "a", encoding="utf-8") as log:
        for line in lines:
            log.write(line)
            log.flush()
            yield line


def publish(answers: DataFrame, violations: DataFrame, path: str) -> bool:
    """Writes the answers if there is no violation, else removes what was published before."""
    spark = answers.sparkSession
    if violations.limit(1).count():
        versions.withdraw(spark, path)
        return False
    write_json(answers, path)
    return True


def remove(spark: SparkSession, path: str) -> None:
    """Removes a file or folder, if it is there, on any file system that Spark reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def pack(folder: str, archive: str) -> None:
    """A folder of the driver as a gzip-compressed tar file."""
    import tarfile

    with tarfile.open(archive, "w:gz") as tar:
        tar.add(folder, arcname=folder.rstrip("/").rsplit("/", 1)[-1])
