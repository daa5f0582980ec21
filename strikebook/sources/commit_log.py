"""Tables loaded export by export, with a log of commits for each.

An export's log is a folder of numbered entries on the shared file system. An entry is written aside and moved to the
next number, which fails where another writer was faster; the loser reads the log again and compares once
more. So no load replaces a newer one, whatever runs at the same time, and readers see a load whole or not at
all.
"""

from __future__ import annotations

import json
import uuid
from urllib.parse import quote

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "export string, seq long, stamp string, name string, n_rows long, location string, batch_id long"


class CommitLog:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._names = self._jvm.org.apache.hadoop.fs
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._files = self._names.FileContext.getFileContext(self._path(self.root).toUri(), conf)

    def _path(self, text: str):
        return self._names.Path(text)

    def _folder(self, export: str) -> str:
        return f"{self.root}/_log/{quote(export, safe='')}"

    def _numbers(self, export: str) -> list[int]:
        folder = self._path(self._folder(export))
        if not self._files.util().exists(folder):
            return []
        names = [s.getPath().getName() for s in self._files.util().listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit())

    def head(self, export: str) -> dict | None:
        """The entry that is current."""
        numbers = self._numbers(export)
        if not numbers:
            return None
        stream = self._files.open(self._path(f"{self._folder(export)}/{numbers[-1]:012d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _place(self, export: str, entry: dict) -> bool:
        """Writes the entry under its number; false where that number is taken."""
        self._files.mkdir(self._path(self._folder(export)), None, True)
        aside = self._path(f"{self._folder(export)}/_{uuid.uuid4().hex}")
        flags = self._jvm.java.util.EnumSet.of(self._names.CreateFlag.CREATE)
        create = self.spark.sparkContext._gateway.new_array(getattr(self._names, "Options$CreateOpts"), 0)
        out = self._files.create(aside, flags, create)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        never = self.spark.sparkContext._gateway.new_array(getattr(self._names, "Options$Rename"), 1)
        never[0] = getattr(self._names, "Options$Rename").NONE
        try:
            self._files.rename(aside, self._path(f"{self._folder(export)}/{entry['seq']:012d}.json"), never)
        except Py4JJavaError as error:
            self._files.delete(aside, False)
            if "FileAlreadyExistsException" in error.java_exception.getClass().getName():
                return False
            raise
        return True

    def append(self, export: str, stamp: str, name: str, n_rows: int, location: str, batch_id: int, allow_older: bool = False) -> str:
        """Makes a written load current: downloaded, current (that stamp is held already) or stale (a newer one is)."""
        while True:
            held = self.head(export)
            if held and held["stamp"] == stamp:
                return "current"
            if held and held["stamp"] > stamp and not allow_older:
                return "stale"
            entry = {"export": export, "seq": held["seq"] + 1 if held else 1, "stamp": stamp, "name": name, "n_rows": n_rows}
            if self._place(export, entry | {"location": location, "batch_id": batch_id}):
                return "downloaded"

    def heads(self) -> DataFrame:
        """The current entry of each export."""
        if not self._files.util().exists(self._path(f"{self.root}/_log")):
            return self.spark.createDataFrame([], ENTRY)
        entries = self.spark.read.schema(ENTRY).json(f"{self.root}/_log/*/[0-9]*.json")
        newest = F.max_by(F.struct(*[c for c in entries.columns if c != "export"]), "seq").alias("e")
        return entries.groupBy("export").agg(newest).select("export", "e.*")

    def read(self, export: str) -> DataFrame:
        """The current load of an export."""
        held = self.head(export)
        if held is None:
            raise ValueError(f"no load of {export}")
        return self.spark.read.parquet(held["location"])
