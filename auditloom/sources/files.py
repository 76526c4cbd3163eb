"""A sink of one file a row, committed as a whole: ``df.write.format("auditloom_files").mode("append").save(folder)`` for (file_name, body).

Each task attempt writes below a staging folder of its own; when all tasks are through, the driver moves the files of those attempts that
count into place, one rename each, and drops the rest. So a task that fails, or runs twice, leaves no partial file. The folder is a path of any
file system that Arrow opens (local, hdfs, s3, gs), seen by executors and driver alike.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


@dataclass
class Written(WriterCommitMessage):
    folder: str
    names: list


class FileWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path.rstrip("/")
        self.staging = f"{self.path}/.staging-{uuid.uuid4().hex}"

    def write(self, rows):
        from pyarrow.fs import FileSystem
        from pyspark import TaskContext

        fs, base = FileSystem.from_uri(self.staging)
        context = TaskContext.get()
        own, names = f"{base}/{context.partitionId()}-{context.taskAttemptId()}", []
        fs.create_dir(own, recursive=True)
        for r in rows:
            with fs.open_output_stream(f"{own}/{r['file_name']}") as f:
                f.write((r["body"] or "").encode("utf-8", "surrogatepass"))
            names.append(r["file_name"])
        return Written(own, names)

    def commit(self, messages):
        from pyarrow.fs import FileSystem

        fs, base = FileSystem.from_uri(self.path)
        for m in messages:
            for name in m.names if m else ():
                fs.move(f"{m.folder}/{name}", f"{base}/{name}")
        self._drop()

    def abort(self, messages):
        self._drop()

    def _drop(self):
        from pyarrow.fs import FileSystem, FileType

        fs, base = FileSystem.from_uri(self.staging)
        if fs.get_file_info(base).type == FileType.Directory:
            fs.delete_dir(base)


class Files(DataSource):
    @classmethod
    def name(cls):
        return "auditloom_files"

    def writer(self, schema, overwrite):
        return FileWriter(self.options["path"])


def write_files(rows, folder: str) -> None:
    """One file below folder for each row of (file_name, body); a file of that name is replaced."""
    from auditloom.session import ship

    ship(rows.sparkSession)
    rows.sparkSession.dataSource.register(Files)
    rows.select("file_name", "body").write.format("auditloom_files").mode("append").save(folder)
