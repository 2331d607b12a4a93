"""Version control: what a working tree says of its branch, revision and changes. Driver-side, a few lines each."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.sources.files import diff_changes, status_changes


class Vcs:
    """Port of a version control system; this one asks git. None or an empty table where the folder is under none."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _ask(self, *words: str) -> str | None:
        try:
            said = subprocess.run(["git", "-C", self.folder, *words], capture_output=True, timeout=60)
        except (OSError, subprocess.TimeoutExpired):
            return None
        return said.stdout.decode("utf-8", "replace") if said.returncode == 0 else None

    def branch(self) -> str | None:
        said = (self._ask("rev-parse", "--abbrev-ref", "HEAD") or "").strip()
        return said if said and said != "HEAD" else None

    def revision(self) -> str | None:
        return (self._ask("rev-parse", "HEAD") or "").strip() or None

    def _lines(self, said: str | None) -> DataFrame:
        return self.spark.createDataFrame([(x,) for x in (said or "").split("\n") if x], "line string")

    def status(self) -> DataFrame:
        """(path, op) of what is not committed."""
        return status_changes(self._lines(self._ask("status", "--porcelain")))

    def since(self, revision: str) -> DataFrame:
        """(path, op) of what changed since a revision."""
        return diff_changes(self._lines(self._ask("diff", "--name-status", revision)))

    def changed(self, deletions: bool = False) -> DataFrame:
        """(path, op) of files to take in again: modified and added ones, and deleted ones if asked for."""
        return self.status().where(F.col("op").isin("modified", "added", *(["deleted"] if deletions else [])))
