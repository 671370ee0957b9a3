"""Changing a table of Parquet files without a table format: numbered versions, and swaps of files behind a journal.

All paths go through Hadoop's file system, so any store that Spark writes to will do. A table has one writer at a time.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Folder:
    """Names, moves and small texts below one path."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        self.system = at.getFileSystem(spark._jsc.hadoopConfiguration())
        self.path = self.system.makeQualified(at).toString()

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name if "://" in name or name.startswith(("/", "file:")) else f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str = "") -> bool:
        return self.system.exists(self._at(name))

    def names(self, name: str = "") -> list[str]:
        """What lies directly in a folder, sorted; nothing where there is none."""
        return sorted(x.getPath().getName() for x in self.system.listStatus(self._at(name))) if self.exists(name) else []

    def delete(self, name: str) -> None:
        self.system.delete(self._at(name), True)

    def move(self, name: str, to: str) -> None:
        self.system.mkdirs(self._at(to).getParent())
        if not self.system.rename(self._at(name), self._at(to)):
            raise OSError(f"cannot move {name} to {to}")

    def write_text(self, name: str, text: str) -> None:
        """Write a small file as a whole: readers see all of it or nothing."""
        out = self.system.create(self._at(f"{name}.unfinished"), True)
        out.write(bytearray(text.encode()))
        out.close()
        self.delete(name)
        self.move(f"{name}.unfinished", name)

    def read_text(self, name: str) -> str:
        stream = self.system.open(self._at(name))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def files(self, name: str) -> list[str]:
        """Data files anywhere below a folder, by their path in it."""
        if not self.exists(name):
            return []
        base, found = self._at(name), []
        base = self.system.makeQualified(base).toString()
        walk = self.system.listFiles(self._at(name), True)
        while walk.hasNext():
            full = walk.next().getPath().toString()
            inside = full[len(base) + 1 :]
            if not any(part.startswith(("_", ".")) for part in inside.split("/")):
                found.append(inside)
        return sorted(found)


def read_table(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """A Parquet table, or no rows of the columns of ``like`` where nothing is stored yet."""
    return spark.read.parquet(path) if Folder(spark, path).files("") else like.limit(0)


class Versions:
    """Numbered versions of a small table, each written as a whole; the newest complete one counts."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.folder = spark, Folder(spark, path)

    def complete(self) -> list[int]:
        names = [n for n in self.folder.names() if n.startswith("at=")]
        return sorted(int(n[3:]) for n in names if self.folder.exists(f"{n}/_SUCCESS"))

    def newest(self) -> int | None:
        done = self.complete()
        return done[-1] if done else None

    def read(self, number: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder.path}/at={number}")

    def write(self, df: DataFrame, number: int) -> None:
        df.coalesce(1).write.mode("overwrite").parquet(f"{self.folder.path}/at={number}")

    def retire(self, keep: int = 2) -> None:
        for number in self.complete()[:-keep]:
            self.folder.delete(f"at={number}")


class PartStore:
    """Rows in parts that are rewritten as a whole, each in a version of its own; a manifest names every part's version.

    ``fold`` brings rows together, in any grouping and order of arrival alike. A merge rewrites only the parts it has rows of
    (and the parts of the oldest versions, once more than ``most`` versions are named), then writes the manifest; so readers
    see it as a whole or not at all, and one that is repeated under its own ``commit`` changes nothing. What only older
    manifests than the last two name is deleted.
    """

    #: Up to so many parts are named by a broadcast list, so that Spark prunes by them.
    LISTED = 200_000

    def __init__(self, spark: SparkSession, path: str, parts: tuple[str, ...], fold: Callable[[DataFrame], DataFrame], most: int = 32) -> None:
        self.spark, self.parts, self.fold, self.most = spark, list(parts), fold, most
        self.folder, self.manifests = Folder(spark, path), Versions(spark, f"{path}/manifest")

    def manifest(self) -> tuple[int, DataFrame] | None:
        """The newest complete version and its rows: the part columns, ``version`` and ``commit``."""
        newest = self.manifests.newest()
        return None if newest is None else (newest, self.manifests.read(newest))

    def commit(self) -> str | None:
        """Under which name the last merge was made."""
        found = self.manifest()
        row = found[1].select("commit").first() if found else None
        return row["commit"] if row else None

    def _stored(self, named: DataFrame) -> DataFrame:
        versions = sorted(r["version"] for r in named.select("version").distinct().collect())
        rows = self.spark.read.option("basePath", f"{self.folder.path}/data").parquet(*(f"{self.folder.path}/data/version={v}" for v in versions))
        listed = named.select("version", *self.parts)
        if listed.limit(self.LISTED + 1).count() <= self.LISTED:
            listed = F.broadcast(listed)
        same = rows.select(*(F.col(c).cast(t).alias(c) if c in (*self.parts, "version") else F.col(c) for c, t in ((c, dict(named.dtypes).get(c)) for c in rows.columns)))
        return same.join(listed, ["version", *self.parts], "left_semi")

    def read(self, only: DataFrame | None = None) -> DataFrame | None:
        """The stored rows (of the parts in ``only``), or None where nothing is stored."""
        found = self.manifest()
        if found is None or found[1].isEmpty():
            return None
        named = found[1] if only is None else found[1].join(only, [c for c in self.parts if c in only.columns], "left_semi")
        if named.isEmpty():
            named = found[1].limit(1)
            return self._stored(named).drop("version").limit(0)
        return self._stored(named).drop("version")

    def merge(self, rows: DataFrame, commit: str, keep=None) -> bool:
        """Fold ``rows`` into the store; False if this commit is the last one made already.

        ``keep``, a condition on part columns, says which parts stay listed.
        """
        found = self.manifest()
        if found is not None and self.commit() == commit:
            return False
        number = found[0] + 1 if found else 0
        touched = rows.select(*self.parts).distinct().persist()
        try:
            kept, all_rows = None, rows
            if found is not None:
                listed = found[1]
                versions = sorted(r["version"] for r in listed.select("version").distinct().collect())
                if len(versions) > self.most:
                    old = listed.where(F.col("version").isin(versions[: -self.most // 2])).select(*self.parts)
                    touched = touched.unionByName(old).distinct().persist()
                wanted = listed.join(touched, self.parts, "left_semi")
                if not wanted.isEmpty():
                    stored = self._stored(wanted)
                    if not wanted.join(stored.select("version", *self.parts).distinct(), ["version", *self.parts], "left_anti").isEmpty():
                        raise RuntimeError(f"stored parts that the manifest names are missing in {self.folder.path}")
                    all_rows = rows.unionByName(stored.select(*rows.columns))
                kept = listed.join(touched, self.parts, "left_anti")
            folded = self.fold(all_rows)
            folded.repartition(*self.parts).write.mode("overwrite").partitionBy(*self.parts).parquet(f"{self.folder.path}/data/version={number}")
            listed = touched.select(*self.parts, F.lit(number).cast("long").alias("version"))
            if kept is not None:
                listed = listed.unionByName(kept.select(*listed.columns))
            if keep is not None:
                listed = listed.where(keep)
            self.manifests.write(listed.withColumn("commit", F.lit(commit)), number)
        finally:
            touched.unpersist()
        self.retire()
        return True

    def retire(self, keep: int = 2) -> int:
        """Delete what no manifest but the newest ``keep`` names; returns how many versions went."""
        self.manifests.retire(keep)
        needed = {r["version"] for n in self.manifests.complete() for r in self.manifests.read(n).select("version").distinct().collect()}
        gone = [n for n in self.folder.names("data") if n.startswith("version=") and int(n[8:]) not in needed]
        for n in gone:
            self.folder.delete(f"data/{n}")
        return len(gone)


class TableFiles:
    """Files of a partitioned table, changed by swaps: new files are staged, a journal is written, then it is carried out.

    Until the journal is there the table is the old one; from then on it is the new one, once ``recover`` has carried out what a
    crash left undone. A swap that is repeated under its name is carried out once. ``then`` is called with a swap's name and its new
    files, once they are in their places; it may be called again after a crash.
    """

    #: Names of finished swaps that are remembered.
    REMEMBERED = 100

    def __init__(self, spark: SparkSession, table: str, then: Callable[[str, list[str]], None] | None = None) -> None:
        self.spark, self.folder, self.then = spark, Folder(spark, table), then

    def staging(self, swap: str) -> str:
        return f"{self.folder.path}/_staging/{swap}"

    def finished(self, swap: str) -> bool:
        """The swap is journalled; what is open of it is carried out now."""
        if self.folder.exists(f"_journal/{swap}.json"):
            self._carry_out(swap)
        return self.folder.exists(f"_journal/{swap}.done")

    def recover(self) -> None:
        for name in self.folder.names("_journal"):
            if name.endswith(".json"):
                self._carry_out(name[: -len(".json")])

    def commit(self, swap: str, gone: Iterable[str] = (), texts: dict[str, str] | None = None) -> None:
        """Bring what is staged into the table, take the files or folders ``gone`` out of it and write small ``texts`` by name."""
        new = [[f"_staging/{swap}/{f}", "/".join((*f.split("/")[:-1], f"{swap}-{f.split('/')[-1]}"))] for f in self.folder.files(f"_staging/{swap}")]
        self.folder.write_text(f"_journal/{swap}.json", json.dumps({"new": new, "gone": list(gone), "texts": texts or {}}))
        self._carry_out(swap)
        done = [n for n in self.folder.names("_journal") if n.endswith(".done")]
        if len(done) > self.REMEMBERED:
            times = {n: self.folder.system.getFileStatus(self.folder._at(f"_journal/{n}")).getModificationTime() for n in done}
            for n in sorted(done, key=times.get)[: -self.REMEMBERED]:
                self.folder.delete(f"_journal/{n}")

    def _carry_out(self, swap: str) -> None:
        journal = json.loads(self.folder.read_text(f"_journal/{swap}.json"))
        for source, target in journal["new"]:
            if self.folder.exists(source):
                self.folder.move(source, target)
        for name in journal["gone"]:
            self.folder.delete(name)
        for name, text in journal["texts"].items():
            self.folder.write_text(name, text)
        if self.then is not None:
            self.then(swap, [f"{self.folder.path}/{target}" for _, target in journal["new"]])
        self.folder.delete(f"_staging/{swap}")
        self.folder.move(f"_journal/{swap}.json", f"_journal/{swap}.done")

    def abandon(self, swap: str) -> None:
        """Forget what is staged under a name whose journal was never written."""
        self.folder.delete(f"_staging/{swap}")
