"""Which tables of a session are whole: a numbered list, swapped at once.

A writer names its tables as it likes, writes them, and then commits an epoch
with the names that count from then on.  The list is a small file, put in place by
a rename, so a reader sees the one before or the one after and never a table that
is still being written.  Tables that a commit drops are deleted by the commit
after the next that drops some, so what a reader has listed stays a while.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from ..workspace import delete, folders, path_of, read_text, write_text

#: Lists kept besides the one that counts.
KEPT = 2


@dataclass
class Manifest:
    """`epoch`: the last one committed, -1 for none; `tables`: names by kind; `dropped`: those to delete next."""

    spark: SparkSession
    folder: str
    epoch: int = -1
    tables: dict[str, list[str]] = field(default_factory=dict)
    dropped: list[str] = field(default_factory=list)

    @classmethod
    def read(cls, spark: SparkSession, folder: str) -> Manifest:
        """The last list committed to `folder`."""
        while names := [n for n in folders(spark, folder) if n.isdigit()]:
            try:
                found = json.loads(read_text(spark, f"{folder}/{names[-1]}"))
            except FileNotFoundError:  # replaced while it was looked for
                continue
            return cls(spark, folder, found["epoch"], found["tables"], found["dropped"])
        return cls(spark, folder)

    def commit(self, epoch: int, tables: dict[str, list[str]], merged: list[str]) -> Manifest:
        """Make `tables` those of the session; nothing if `epoch` was committed before.  `merged`: tables that others now stand for."""
        if epoch <= self.epoch:
            return self
        new = Manifest(self.spark, self.folder, epoch, tables, merged or self.dropped)
        write_text(self.spark, f"{self.folder}/{epoch:012}", json.dumps({"epoch": epoch, "tables": tables, "dropped": new.dropped}))
        if merged:
            for name in self.dropped:
                delete(self.spark, name)
        for name in [n for n in folders(self.spark, self.folder) if n.isdigit()][: -1 - KEPT]:
            delete(self.spark, path_of(self.folder, name))
        return new
