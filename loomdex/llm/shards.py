"""Sharding by size-tiered compaction: small immutable shards, merged by tiers, under a versioned manifest."""

from __future__ import annotations

import json
import time
import uuid
from contextlib import ExitStack, contextmanager
from dataclasses import asdict, dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from loomdex.llm.common import hadoop_path


class CommitConflict(RuntimeError):
    """Another writer committed this version first."""


@dataclass(frozen=True)
class Run:
    """A shard file: never changed once written."""

    path: str
    bytes: int


class ShardStore:
    """A table of shard files at a path in any store that Spark reaches.

    data/<uuid>/part-*.parquet are shards; manifest/<version>.json lists those of a version. A version is committed by writing its
    manifest under another name and giving it, in one step that fails if it is taken, the version's name: readers see all of a version or
    nothing, and of two writers one gets CommitConflict (append() then tries again with the version that won). That step is a hard link in local
    folders and a rename without overwriting elsewhere; it is as safe as the store's rename, so only stores in ATOMIC are taken.

    While a writer works, writing/<uuid> says that data/<uuid> is not to be deleted. Files that no manifest names, such as those of a failed job,
    are never read and go with vacuum().
    """

    #: Schemes of stores whose rename is one step that fails where the target exists.
    ATOMIC = ("file", "hdfs", "viewfs", "abfs", "abfss")

    def __init__(self, spark: SparkSession, path: str, target_bytes: int = 128 << 20, fan_in: int = 4):
        self.spark, self.path, self.target, self.fan_in = spark, path.rstrip("/"), target_bytes, fan_in

    def versions(self) -> list[int]:
        fs, p = hadoop_path(self.spark, f"{self.path}/manifest")
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        found = self.versions()
        if not found:
            return {"version": 0, "schema": None, "runs": []}
        fs, p = hadoop_path(self.spark, f"{self.path}/manifest/{found[-1] if version is None else version:020d}.json")
        stream = fs.open(p)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def runs(self, version: int | None = None) -> list[Run]:
        return [Run(**r) for r in self.manifest(version)["runs"]]

    def _commit(self, base: int, schema: str | None, runs: list[Run]) -> int:
        """Make `runs` version base + 1."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        fs, final = hadoop_path(self.spark, f"{self.path}/manifest/{base + 1:020d}.json")
        if (scheme := fs.getUri().getScheme()) not in self.ATOMIC:
            raise ValueError(f"{scheme} has no rename that is safe to commit by")
        _, draft = hadoop_path(self.spark, f"{self.path}/manifest/.{uuid.uuid4().hex}.draft")
        fs.mkdirs(final.getParent())
        out = fs.create(draft, False)
        out.write(json.dumps({"version": base + 1, "schema": schema, "runs": [asdict(r) for r in runs]}).encode())
        out.close()
        try:
            if scheme == "file":
                at = lambda p: jvm.java.nio.file.Paths.get(fs.makeQualified(p).toUri())
                jvm.java.nio.file.Files.createLink(at(final), at(draft))
            else:
                none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), conf).rename(draft, final, none)
        except Py4JJavaError as e:
            if fs.exists(final):
                raise CommitConflict(f"version {base + 1} exists") from e
            raise
        finally:
            fs.delete(draft, False)
        return base + 1

    @contextmanager
    def _writing(self):
        """A name for a folder of data that vacuum() leaves alone until the block ends."""
        name = uuid.uuid4().hex
        fs, mark = hadoop_path(self.spark, f"{self.path}/writing/{name}")
        fs.mkdirs(mark.getParent())
        fs.create(mark, False).close()
        try:
            yield name
        finally:
            fs.delete(mark, False)

    def _write(self, df: DataFrame, name: str | None = None) -> list[Run]:
        """Write df, a file for each of its partitions that has rows, and list the files."""
        folder = f"{self.path}/data/{name or uuid.uuid4().hex}"
        df.write.parquet(folder)
        fs, p = hadoop_path(self.spark, folder)
        return sorted((Run(s.getPath().toString(), s.getLen()) for s in fs.listStatus(p) if s.getPath().getName().startswith("part-")), key=lambda r: r.path)

    def append(self, df: DataFrame) -> int:
        """Add an arrival as small shards, one for each of its partitions; returns the version. Rows are neither moved nor changed.

        An arrival without rows makes a version all the same; the first one sets the columns, by name, and later ones must have these and no
        others, or ValueError is raised. If another writer commits first, the same shards are added to its version.
        """
        with self._writing() as name:
            new, at = None, None
            while True:
                now = self.manifest()
                if new is None or at != now["schema"]:
                    own, schema = df, df.schema
                    if now["schema"]:
                        schema = T.StructType.fromJson(json.loads(now["schema"]))
                        if sorted(df.columns) != sorted(schema.names):
                            raise ValueError(f"columns {df.columns} are not those of the store, {schema.names}")
                        own = df.select(*[f"`{f.name}`" for f in schema])
                    new = new or self._write(own, name)
                    at = now["schema"]
                try:
                    return self._commit(now["version"], now["schema"] or schema.json(), [*(Run(**r) for r in now["runs"]), *new])
                except CommitConflict:
                    continue

    def tier(self, run: Run) -> int:
        """0 for full files; else higher the smaller: runs of one tier differ in size by less than the factor fan_in."""
        t, size = 0, run.bytes
        while size * 2 <= self.target and t < 32:
            t, size = t + 1, size * self.fan_in
        return t

    def due(self, runs: list[Run], all_tiers: bool = False) -> list[list[Run]]:
        """Groups to merge: tiers below the full one with fan_in runs or more (or, to finish, all runs that aren't full)."""
        by: dict[int, list[Run]] = {}
        for r in runs:
            by.setdefault(self.tier(r), []).append(r)
        small = [v for k, v in sorted(by.items(), reverse=True) if k]
        if all_tiers:
            rest = [r for v in small for r in v]
            return [rest] if len(rest) > 1 else []
        return [v for v in small if len(v) >= self.fan_in]

    def compact(self, finish: bool = False, keep: int = 1, grace: float = 86_400.0) -> int:
        """Merge tiers until none is due and commit each round; returns the version.

        A tier's runs, similar in size, are read in one job whose partitions are joined, without a shuffle, into as many tasks as files of the
        tier above or of the target size come out. finish: then merge what is left of all tiers too. After each round vacuum(keep, grace)
        runs. A round that another writer's commit overtakes is given up and made anew from the new version.
        """
        done = False
        while not done:
            now = self.manifest()
            schema, runs = now["schema"], [Run(**r) for r in now["runs"]]
            groups, last = self.due(runs), False
            if not groups and finish:
                groups, last = self.due(runs, all_tiers=True), True
            if not groups:
                break
            with ExitStack() as names:
                gone, new = set(), []
                for group in groups:
                    size = sum(r.bytes for r in group)
                    files = max(1, round(size / self.target)) if last or size >= self.target else max(1, len(group) // self.fan_in)
                    if files >= len(group):
                        continue
                    merged = self.spark.read.schema(T.StructType.fromJson(json.loads(schema))).parquet(*[r.path for r in sorted(group, key=lambda r: -r.bytes)])
                    new += self._write(merged.coalesce(files), names.enter_context(self._writing()))
                    gone |= {r.path for r in group}
                if not gone:
                    break
                try:
                    self._commit(now["version"], schema, [*(r for r in runs if r.path not in gone), *new])
                    done = last
                except CommitConflict:
                    continue
            self.vacuum(keep, grace)
        return self.manifest()["version"]

    def vacuum(self, keep: int = 1, grace: float = 86_400.0) -> None:
        """Delete old versions, and the files that no version left names and no writer works on.

        The last `keep` versions stay, and those that were the latest at some time in the last `grace` seconds, so that readers who began then can
        end; grace=0 is for a store that nobody else reads. Folders are listed before the writers' marks, and these before the manifests: a
        writer who ends in between has its version counted. Marks of writers that died stay, with their folders, until they are deleted.
        """
        fs, data = hadoop_path(self.spark, f"{self.path}/data")
        folders = [s.getPath() for s in fs.listStatus(data)] if fs.exists(data) else []
        _, marks = hadoop_path(self.spark, f"{self.path}/writing")
        busy = {s.getPath().getName() for s in fs.listStatus(marks)} if fs.exists(marks) else set()
        found = self.versions()
        when = {v: fs.getFileStatus(hadoop_path(self.spark, f"{self.path}/manifest/{v:020d}.json")[1]).getModificationTime() / 1000 for v in found}
        old = [v for v, later in zip(found, found[1:], strict=False) if when[later] <= time.time() - grace]
        gone = set(old) & set(found[:-keep])
        named = {r.path for v in found if v not in gone for r in self.runs(v)}
        for v in gone:
            fs.delete(hadoop_path(self.spark, f"{self.path}/manifest/{v:020d}.json")[1], False)
        for folder in folders:
            if folder.getName() in busy:
                continue
            files = [s.getPath() for s in fs.listStatus(folder)]
            if not any(f.toString() in named for f in files):
                fs.delete(folder, True)
                continue
            for f in files:
                if f.getName().startswith("part-") and f.toString() not in named:
                    fs.delete(f, False)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the latest by default."""
        now = self.manifest(version)
        if now["schema"] is None:
            raise FileNotFoundError(f"no version at {self.path}")
        schema = T.StructType.fromJson(json.loads(now["schema"]))
        paths = [r["path"] for r in now["runs"]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
