"""Commits over several Parquet tables at once.

The files of a commit are written to folders of their own first; then one manifest names
them. Readers take the folders that manifests name and nothing else, so a writer that
breaks between two tables leaves nothing to be seen, and the next attempt starts anew. A
commit has a name (a batch id); a name that is committed already is not written again, so
a repeated batch adds no row. Compaction is a commit too: it names larger files and the
folders that they replace.

One writer at a time is assumed for each name, as with a streaming query. Manifests are a
few hundred bytes for each commit; compaction keeps the live folders few.
"""

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

_MANIFEST = "table string, folder string, rows long, replaces array<string>, note string, name string"


@dataclass(frozen=True)
class CommitLog:
    """Tables below ``base``: ``base/<table>/<folder>``, manifests in ``base/log``."""

    spark: SparkSession
    base: str

    def _manifests(self) -> list:
        try:
            found = self.spark.read.schema(_MANIFEST).option("recursiveFileLookup", "true")
            return found.parquet(f"{self.base}/log").collect()  # a row for each table and commit
        except AnalysisException:  # no commit yet
            return []

    def names(self) -> set[str]:
        return {m.name for m in self._manifests()}

    def last_note(self) -> str | None:
        """The greatest note of all commits; notes are sortable progress marks."""
        return max((m.note for m in self._manifests() if m.note is not None), default=None)

    def folders(self, table: str) -> list[str]:
        """Live folders of a table."""
        own = [m for m in self._manifests() if m.table == table]
        gone = {f for m in own for f in m.replaces or []}
        return sorted({m.folder for m in own} - gone)

    def stage(self, name: str, tables: dict[str, DataFrame], partition_by: dict[str, list[str]] | None = None) -> list:
        """Write the files of a commit; nobody sees them before ``publish``."""
        attempt = f"commit={name}-{uuid.uuid4().hex[:8]}"
        out = []
        for table, df in tables.items():
            folder = f"{self.base}/{table}/{attempt}"
            df.write.partitionBy(*(partition_by or {}).get(table, [])).parquet(folder)
            out.append((table, folder, self.spark.read.parquet(folder).count()))
        return out

    def publish(self, name: str, staged: list, note: str | None = None, replaces: dict | None = None) -> None:
        """Make staged files visible, all at once: one file holds the whole manifest."""
        rows = [(t, f, n, (replaces or {}).get(t, []), note, name) for t, f, n in staged]
        if not rows:  # a commit without tables still moves the progress mark
            rows = [(None, None, 0, [], note, name)]
        manifest = self.spark.createDataFrame(rows, _MANIFEST).coalesce(1)
        manifest.write.mode("overwrite").parquet(f"{self.base}/log/{name}")

    def commit(
        self,
        name: str,
        tables: dict[str, DataFrame],
        partition_by: dict[str, list[str]] | None = None,
        note: str | None = None,
    ) -> bool:
        """Commit all ``tables`` or none; False if the name is committed already."""
        if name in self.names():
            return False
        self.publish(name, self.stage(name, tables, partition_by), note)
        return True

    def read(self, table: str) -> DataFrame | None:
        """All committed rows of a table, with the partition columns of its commits."""
        folders = self.folders(table)
        if not folders:
            return None
        like = self.spark.read.parquet(folders[-1])
        read = self.spark.read.schema(like.schema).option("basePath", f"{self.base}/{table}")
        return read.parquet(*folders).select(*like.columns)  # one scan over all live folders

    def compact(self, table: str, name: str, partition_by: list[str] | None = None, where=None) -> bool:
        """Rewrite a table's live folders as one; rows failing ``where`` go."""
        if name in self.names():
            return False
        old = self.folders(table)
        if not old:
            return False
        rows = self.read(table)
        rows = rows if where is None else rows.where(where)
        staged = self.stage(name, {table: rows.hint("rebalance", *(partition_by or []))}, {table: partition_by or []})
        self.publish(name, staged, replaces={table: old})
        return True
