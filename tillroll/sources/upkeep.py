"""A written join that is kept up with its input files.

The result of an inner join of several tables is written as Parquet parts
under one folder, beside a manifest: which input files (path, length, time of
change) each table had when the parts were written, and which parts make up
the table. ``refresh`` lists the input files and compares:

* nothing changed: the parts stand;
* files were only added: the rows that they bring are joined and appended as
  new parts. For tables T1 ... Tn those are, for each i with new files, T1 ...
  T(i-1) before the change, the new files of Ti, and T(i+1) ... Tn after it,
  so every new combination of rows is joined once and no old one again. Where a
  join key links Ti to another table, that table is read between the least and
  the greatest key of the new files (pushed to its row groups);
* a file is gone or differs: the join is written anew;
* more than ``most_parts`` parts: they are read and written as one, without the join.

A part can be measured while it is written: ``measures`` are aggregates that ride on
the write as observed metrics, no scan of their own, and their values stand in the
manifest, so what they say of the whole table is known without reading it.

A new manifest is a file of the next number, renamed into place; the rename
fails where another process was first, which then counts, and the draft is
thrown away. Readers see the old table or the new one, never a mixture; parts
of earlier manifests stay until ``vacuum``.

Parts are joined, sorted and written in a session of their own (``sized_session``):
its number of tasks follows the size of the input, so a task's memory does not.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tillroll.session import file_system, sized_session

Files = dict[str, list]  # path -> [length, time of change]
Read = Callable[[str], DataFrame]


@dataclass
class Refresh:
    """What a refresh did, and per appended part the number of files read of each table."""
    action: str
    parts: list[str]
    read: list[dict[str, int]] = field(default_factory=list)


@dataclass(frozen=True)
class Link:
    """Two tables that the join links by equal keys."""
    left: str
    left_key: str
    right: str
    right_key: str


class MaintainedJoin:
    """``build`` joins the tables it reads through its argument, each once and
    by inner joins only; ``layout`` names what is written, so that a folder
    written by another version is written anew."""

    def __init__(self, spark: SparkSession, root: str, tables: Mapping[str, str], build: Callable[[Read], DataFrame],
                 layout: str, links: Sequence[Link] = (), sort: Sequence[str] = (), most_parts: int = 16,
                 measures: Mapping[str, Column] | None = None):
        self.spark, self.root, self.tables, self.build = spark, root.rstrip("/"), dict(tables), build
        self.links, self.sort, self.most_parts = links, sort, most_parts
        self.measures, self._measured, self._schema = dict(measures or {}), {}, None
        self.layout = ";".join([layout, *self.measures])

    # ------------------------------------------------------------ input files

    def files(self) -> dict[str, Files]:
        """The files of every table, listed by Spark (in parallel where there are many)."""
        rows = (self.spark.read.format("binaryFile").option("recursiveFileLookup", True)
                .load(list(self.tables.values()))
                .select("path", "length", F.unix_micros("modificationTime").alias("changed")).collect())
        out: dict[str, Files] = {name: {} for name in self.tables}
        roots = {name: self._qualified(path) for name, path in self.tables.items()}
        for r in rows:
            for name, root in roots.items():
                if r["path"] == root or r["path"].startswith(root + "/"):
                    out[name][r["path"]] = [r["length"], r["changed"]]
        return out

    def _qualified(self, path: str) -> str:
        fs, target = file_system(self.spark, path)
        return fs.makeQualified(target).toString()

    def _scan(self, own: SparkSession, name: str, paths: Sequence[str]) -> DataFrame:
        root = self._qualified(self.tables[name])
        reader = own.read
        if list(paths) != [root]:
            reader = reader.option("basePath", root)  # columns of partition folders
        return reader.parquet(*sorted(paths))

    # --------------------------------------------------------------- manifest

    def _folder(self, name: str):
        return file_system(self.spark, f"{self.root}/{name}")

    def manifest(self) -> tuple[int, dict | None]:
        """The number and content of the newest manifest; 0 and None without one."""
        fs, folder = self._folder("manifest")
        if not fs.exists(folder):
            return 0, None
        numbers = [int(n) for f in fs.listStatus(folder) if (n := f.getPath().getName()).isdigit()]
        if not numbers:
            return 0, None
        stream = fs.open(self._folder(f"manifest/{max(numbers)}")[1])
        text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return max(numbers), json.loads(text)

    def _publish(self, number: int, content: dict) -> bool:
        """Put a manifest in place; False where that number is taken."""
        jvm = self.spark.sparkContext._jvm
        fs, draft = self._folder(f"manifest/_{uuid.uuid4().hex}")
        stream = fs.create(draft)
        stream.write(bytearray(json.dumps(content).encode()))
        stream.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            draft.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        never = self.spark.sparkContext._gateway.new_array(rename, 1)
        never[0] = rename.NONE
        try:
            context.rename(draft, self._folder(f"manifest/{number}")[1], never)
        except Exception as error:
            fs.delete(draft, False)
            if "FileAlreadyExists" in str(error) or "already exists" in str(error):
                return False
            raise
        return True

    # ------------------------------------------------------------------ parts

    def _write(self, df: DataFrame) -> str:
        part, seen = uuid.uuid4().hex, Observation()
        if self.measures:
            df = df.observe(seen, *(c.cast("string").alias(name) for name, c in self.measures.items()))
        if self.sort:
            df = df.sortWithinPartitions(*self.sort)
        df.write.parquet(f"{self.root}/parts/{part}")
        self._schema = df.schema.json()
        self._measured[part] = seen.get if self.measures else {}
        return part

    def _bounds(self, name: str, new: DataFrame) -> dict[str, list]:
        """Per linked table the filter on its key: between the least and the greatest key of ``new``."""
        ends = [(x.left_key, x.right, x.right_key) if x.left == name else (x.right_key, x.left, x.left_key)
                for x in self.links if name in (x.left, x.right)]
        if not ends:
            return {}
        row = new.agg(*(f(own).alias(f"{f.__name__}{k}") for k, (own, _, _) in enumerate(ends)
                        for f in (F.min, F.max))).first()
        return {other: F.col(key).between(F.lit(row[f"min{k}"]), F.lit(row[f"max{k}"]))
                for k, (_, other, key) in enumerate(ends)}

    def _append(self, own: SparkSession, old: dict[str, Files],
                now: dict[str, Files]) -> tuple[list[str], list[dict[str, int]]]:
        parts, read, names = [], [], list(self.tables)
        for i, name in enumerate(names):
            added = sorted(set(now[name]) - set(old[name]))
            if not added:
                continue
            chosen = {n: added if n == name else sorted(old[n] if k < i else now[n]) for k, n in enumerate(names)}
            if not all(chosen.values()):
                continue  # a table without files joins nothing
            bounds = self._bounds(name, self._scan(own, name, added))

            def scan(n, chosen=chosen, bounds=bounds):
                df = self._scan(own, n, chosen[n])
                return df.where(bounds[n]) if n in bounds else df

            parts.append(self._write(self.build(scan)))
            read.append({n: len(c) for n, c in chosen.items()})
        return parts, read

    def refresh(self) -> Refresh:
        """Bring the parts up to the input's state; returns the parts to read."""
        while True:
            number, before = self.manifest()
            now = self.files()
            usable = before is not None and before["layout"] == self.layout
            old = before["inputs"] if usable else {}
            added_only = usable and all(now[n].get(p) == state for n in old for p, state in old[n].items())
            if added_only and now == old and len(before["parts"]) <= self.most_parts:
                return Refresh("none", before["parts"])
            own = sized_session(self.spark, sum(length for files in now.values() for length, _ in files.values()))
            if added_only and now == old:
                done = Refresh("compact", [self._write(self._table(before["parts"], own))])
            elif added_only:
                parts, read = self._append(own, old, now)
                done = Refresh("append", [*before["parts"], *parts], read)
            else:
                part = self._write(self.build(lambda n: self._scan(own, n, list(now[n]))))  # noqa: B023
                done = Refresh("rebuild", [part], [{n: len(f) for n, f in now.items()}])
            known = (before["measured"] if usable else {}) | self._measured
            measured = {p: known[p] for p in done.parts}
            schema = self._schema or before["schema"]  # nothing was written where the new files join nothing
            if self._publish(number + 1, {"layout": self.layout, "schema": schema, "inputs": now, "parts": done.parts,
                                          "measured": measured}):
                return done
            for part in set(done.parts) - set(before["parts"] if usable else []):
                fs, target = self._folder(f"parts/{part}")
                fs.delete(target, True)

    def _table(self, parts: Sequence[str], own: SparkSession | None = None) -> DataFrame:
        reader = (own or self.spark).read
        content = self.manifest()[1]
        if content:  # no job to infer what is known
            reader = reader.schema(StructType.fromJson(json.loads(content["schema"])))
        return reader.parquet(*(f"{self.root}/parts/{p}" for p in parts))

    def read(self) -> DataFrame:
        """The table, brought up to the input's state first."""
        return self._table(self.refresh().parts)

    def measured(self) -> list[dict[str, str | None]]:
        """What was measured of each part (values as text), the parts brought up to the input's state first."""
        parts = self.refresh().parts
        known = self.manifest()[1]["measured"]
        return [known[p] for p in parts if p in known]

    def vacuum(self) -> list[str]:
        """Delete parts that the newest manifest does not name (no reader may still use them)."""
        used = set((self.manifest()[1] or {"parts": []})["parts"])
        fs, folder = self._folder("parts")
        gone = [s.getPath() for s in (fs.listStatus(folder) if fs.exists(folder) else [])
                if s.getPath().getName() not in used]
        for path in gone:
            fs.delete(path, True)
        return sorted(p.getName() for p in gone)
