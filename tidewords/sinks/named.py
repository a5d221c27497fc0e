"""A Python data source that writes text rows to files of their own names: ``format("named_text")``.

Rows are ``name STRING, line_no DOUBLE, line STRING``. Lines are parted by ``separator`` (a blank line unless given) in
the order they come; rows of one file must be in one partition, together and sorted, as :func:`write_named` has them.
Files appear when the job commits, so a task that runs twice leaves one copy.
"""

from __future__ import annotations

import os
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

_SAFE = re.compile(r"[^\w.-]+")


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class _Writer(DataSourceWriter):
    def __init__(self, folder: str, separator: str, suffix: str):
        self.folder, self.separator, self.suffix = folder.removeprefix("file://"), separator, suffix

    def write(self, iterator):
        import uuid

        os.makedirs(self.folder, exist_ok=True)
        files: list[tuple[str, str]] = []
        name = out = None
        try:
            for row in iterator:
                if row.name != name:
                    if out:
                        out.write("\n")
                        out.close()
                    name = row.name
                    part = os.path.join(self.folder, f".{uuid.uuid4().hex}.part")
                    files.append((part, os.path.join(self.folder, (_SAFE.sub("-", name or "") or "unnamed") + self.suffix)))
                    out = open(part, "w", encoding="utf-8")  # noqa: SIM115
                else:
                    out.write(self.separator)
                out.write(row.line or "")
        finally:
            if out:
                out.write("\n")
                out.close()
        return _Written(files)

    def commit(self, messages):
        for m in messages:
            for part, final in m.files if m else ():
                os.replace(part, final)

    def abort(self, messages):
        for m in messages:
            for part, _ in m.files if m else ():
                if os.path.exists(part):
                    os.remove(part)


class NamedText(DataSource):
    """The writer's data source; the folder must be one that all executors share."""

    @classmethod
    def name(cls):
        return "named_text"

    def schema(self):
        return "name string, line_no double, line string"

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"], self.options.get("separator", "\n\n"), self.options.get("suffix", ".md"))


def write_named(lines: DataFrame, folder: str, *, separator: str = "\n\n", suffix: str = ".md") -> None:
    """Writes ``name, line_no, line`` rows, one file per name, lines in order."""
    lines.sparkSession.dataSource.register(NamedText)
    rows = lines.select("name", "line_no", "line").repartition("name").sortWithinPartitions("name", "line_no")
    rows.write.format("named_text").mode("append").option("separator", separator).option("suffix", suffix).save(folder)
