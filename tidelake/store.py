"""Tables of immutable snapshots over Parquet: append, upsert, update, delete, time travel, compaction, expiry, metadata.

A table is a folder: data folders, each written once; manifests, each a list of data folders; and a log of numbered
JSON snapshots that list manifests. A commit writes its data first, then one manifest for what it adds, and last its
snapshot with create-only semantics: of two writers one wins, the other fails whole. Readers see the last complete
snapshot; log files and manifests never change, so a table object reads each of them once. Partitioned tables (days of
a time column) are rewritten by partition: an upsert replaces only the days that hold matched keys or receive rows.
Tables of mode upsert are merge-on-read for row changes: a delete or update writes the positions of dead rows beside
the data, and readers leave these out, until they are folded in. A commit may carry a token (query and batch of a
stream); a token once committed is skipped, also after its snapshot has expired."""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelake.operators.merge import upsert
from tidelake.schemas import TableSpec

DAY = "_day"
#: What a file of a compacted table aims at.
TARGET_BYTES = 256 * 1024 * 1024


@dataclass(frozen=True)
class Part:
    """One folder of a snapshot, the day it holds (None: any), its rows, and whether these are positions of deleted rows."""

    path: str
    day: str | None
    rows: int
    deletes: bool = False


class Table:
    def __init__(self, spark: SparkSession, path: str, spec: TableSpec) -> None:
        self.spark, self.path, self.spec = spark, path.rstrip("/"), spec
        self._P = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._P(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._known: dict[str, object] = {}

    # the log

    def _json(self, name: str):
        """A small file of the table's own that never changes once written."""
        if name not in self._known:
            stream = self._fs.open(self._P(f"{self.path}/{name}"))
            try:
                self._known[name] = json.loads(bytes(stream.readAllBytes()).decode())
            finally:
                stream.close()
        return self._known[name]

    def _put(self, name: str, value, overwrite: bool = False) -> None:
        out = self._fs.create(self._P(f"{self.path}/{name}"), overwrite)
        try:
            out.write(bytearray(json.dumps(value).encode()))
        finally:
            out.close()
        if overwrite:
            self._known.pop(name, None)

    def _log(self) -> list[dict]:
        folder = self._P(f"{self.path}/log")
        if not self._fs.exists(folder):
            return []
        return [self._json(f"log/{n}") for n in sorted(s.getPath().getName() for s in self._fs.listStatus(folder))]

    def _commit(self, operation: str, new: list[Part], token: str | None, kept: list[str] | None = None, **summary) -> None:
        """A snapshot of the kept manifests (all of the last one's by default) and one of what is added."""
        log = self._log()
        number = (log[-1]["id"] if log else 0) + 1
        manifests = list((log[-1]["manifests"] if log else []) if kept is None else kept)
        if new:
            name = f"manifests/{uuid.uuid4().hex}.json"
            self._put(name, [p.__dict__ for p in new])
            manifests.append(name)
        entry = {"id": number, "parent": number - 1 or None, "committed_ms": int(time.time() * 1000), "operation": operation, "token": token, "summary": summary, "manifests": manifests}
        self._put(f"log/{number:012d}.json", entry)  # fails if another writer was first

    def _replace(self, operation: str, gone: Iterable[Part], added: list[Part], token: str | None = None, **summary) -> None:
        """A snapshot without some parts: manifests that hold none of them are kept, what is left of the others goes into the new one."""
        gone = {p.path for p in gone}
        kept, left = [], []
        log = self._log()
        for m in log[-1]["manifests"] if log else []:
            parts = [Part(**p) for p in self._json(m)]
            if any(p.path in gone for p in parts):
                left += [p for p in parts if p.path not in gone]
            else:
                kept.append(m)
        self._commit(operation, left + added, token, kept, **summary)

    def _parts_of(self, entry: dict) -> list[Part]:
        return [Part(**p) for m in entry["manifests"] for p in self._json(m)]

    def snapshots(self) -> DataFrame:
        """snapshot_id, parent_id, committed_at, operation, parts, rows (less the deleted), manifests, summary."""
        rows = []
        for e in self._log():
            parts = self._parts_of(e)
            rows.append((e["id"], e["parent"], e["committed_ms"], e["operation"], len(parts), sum(-p.rows if p.deletes else p.rows for p in parts), len(e["manifests"]), {k: str(v) for k, v in e["summary"].items()}))
        made = self.spark.createDataFrame(rows, "snapshot_id bigint, parent_id bigint, ms bigint, operation string, parts bigint, rows bigint, manifests bigint, summary map<string,string>")
        return made.select("snapshot_id", "parent_id", F.timestamp_millis("ms").alias("committed_at"), "operation", "parts", "rows", "manifests", "summary")

    def history(self, last: int = 20) -> DataFrame:
        """The latest snapshots, newest first."""
        return self.snapshots().orderBy(F.col("committed_at").desc(), F.col("snapshot_id").desc()).limit(last)

    def manifests(self) -> DataFrame:
        """path, parts, delete_parts, rows of each manifest of the last snapshot."""
        log = self._log()
        rows = [(m, len(ps), sum(p["deletes"] for p in ps), sum(p["rows"] for p in ps)) for m in (log[-1]["manifests"] if log else []) for ps in [self._json(m)]]
        return self.spark.createDataFrame(rows, "path string, parts bigint, delete_parts bigint, rows bigint")

    def parts(self, snapshot: int | None = None) -> list[Part]:
        log = [e for e in self._log() if snapshot is None or e["id"] == snapshot]
        return self._parts_of(log[-1]) if log else []

    def files(self, snapshot: int | None = None) -> DataFrame:
        """content (0 data, 1 position deletes), file_path, file_size_in_bytes, record_count of the snapshot's files, from their footers."""
        out = self.spark.createDataFrame([], "content int, file_path string, file_size_in_bytes bigint, record_count bigint")
        for content in (0, 1):
            paths = [p.path for p in self.parts(snapshot) if p.deletes == bool(content)]
            if paths:
                out = out.unionAll(self.spark.read.parquet(*paths).groupBy(F.lit(content).alias("content"), F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_size").alias("file_size_in_bytes")).agg(F.count("*").alias("record_count")))
        return out

    # reading

    def read(self, snapshot: int | None = None, days: tuple[str, str] | None = None) -> DataFrame:
        """The table at a snapshot (the last by default); days: first and last day to read, others are not listed at all.

        Columns added to the schema since a folder was written are null in it."""
        return self._read([p for p in self.parts(snapshot) if days is None or p.day is None or p.deletes or days[0] <= p.day <= days[1]])

    def _read(self, parts: list[Part], positions: bool = False) -> DataFrame:
        """The rows of the data parts less those that the delete parts name; positions adds where each stands (_file, _row)."""
        schema = self.spec.schema
        data, deletes = [p.path for p in parts if not p.deletes], [p.path for p in parts if p.deletes]
        if not data:
            made = self.spark.createDataFrame([], schema)
            return made.withColumns({"_file": F.lit(""), "_row": F.lit(0).cast("bigint")}) if positions else made
        rows = self.spark.read.schema(schema).parquet(*data)
        if not positions and not deletes:
            return rows
        rows = rows.withColumns({"_file": F.col("_metadata.file_path"), "_row": F.col("_metadata.row_index")})
        if deletes:  # Spark broadcasts the positions if their files are small, else both sides meet by position
            rows = rows.join(self.spark.read.schema("_file string, _row bigint").parquet(*deletes), ["_file", "_row"], "left_anti")
        return rows if positions else rows.select(*schema.names)

    # writing

    def _conform(self, df: DataFrame) -> DataFrame:
        have = set(df.columns)
        return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.spec.schema.fields])

    def _day(self) -> Column:
        return F.coalesce(F.date_format(F.col(self.spec.days).cast("timestamp"), "yyyy-MM-dd"), F.lit("none"))

    def _write(self, df: DataFrame) -> list[Part]:
        """Writes rows into new folders, one a day for a table partitioned by days. Rows are counted from the footers."""
        root = f"{self.path}/data/{uuid.uuid4().hex}"
        if not self.spec.days or self.spec.days not in df.columns:
            df.write.parquet(root)
            parts = [Part(root, None, self.spark.read.schema(self.spec.schema).parquet(root).count())]
        else:
            df.withColumn(DAY, self._day()).write.partitionBy(DAY).parquet(root)
            days = [s.getPath().getName() for s in self._fs.listStatus(self._P(root)) if s.isDirectory()]
            counts = self.spark.read.parquet(root).groupBy(F.col(DAY).cast("string").alias(DAY)).count().collect() if days else []  # one row a day
            parts = [Part(f"{root}/{DAY}={r[DAY]}", r[DAY], r["count"]) for r in counts]
        return [p for p in parts if p.rows]

    def _seen(self, token: str | None) -> bool:
        """Whether a token was committed, in a snapshot that is still there or in one that expired."""
        if token is None:
            return False
        stream, _, batch = token.rpartition("/")
        past = self._past()
        return any(e["token"] == token for e in self._log()) or token in past["whole"] or batch.isdigit() and int(batch) <= past["batches"].get(stream, -1)

    def _past(self) -> dict:
        """Tokens of expired snapshots: of those that end in a batch number only the last number of each stream."""
        self._known.pop("tokens.json", None)
        return self._json("tokens.json") if self._fs.exists(self._P(f"{self.path}/tokens.json")) else {"whole": [], "batches": {}}

    def append(self, df: DataFrame, token: str | None = None) -> None:
        """Adds rows as new folders; an empty input commits nothing."""
        if self._seen(token):
            return
        new = self._write(self._conform(df))
        if new:
            self._commit("append", new, token, added=sum(p.rows for p in new))

    def overwrite(self, df: DataFrame, operation: str = "overwrite") -> None:
        self._commit(operation, self._write(self._conform(df)), None, [])

    def merge(self, source: DataFrame, token: str | None = None, **how) -> None:
        """Upsert by the table's key under its guard. Rewrites the days of matched rows and of incoming rows only.

        The source is written once beside the table, as the merge reads it more than once."""
        if self._seen(token):
            return
        keys, parts = list(self.spec.key), self.parts()
        if self.spec.guard and "guard" not in how:
            how["guard"] = lambda s, t: s(self.spec.guard) >= t(self.spec.guard)
        staged = f"{self.path}/staged/{uuid.uuid4().hex}"
        have = [f.name for f in self.spec.schema.fields if f.name in source.columns]  # what the source lacks stays as it is
        self._conform(source).select(*have).write.parquet(staged)
        source = self.spark.read.schema(T.StructType([f for f in self.spec.schema.fields if f.name in have])).parquet(staged)
        if self.spec.days and self.spec.days in have and parts:
            hit = self._read(parts).join(source.select(*keys).distinct(), keys, "left_semi")
            days = {r[DAY] for r in hit.select(self._day().alias(DAY)).unionAll(source.select(self._day().alias(DAY))).distinct().collect()}  # one row a day
        else:
            days = None
        redo = [p for p in parts if not p.deletes and (days is None or p.day in days)]
        new = self._write(upsert(self._read([*redo, *(p for p in parts if p.deletes)]), source, keys, **how))
        self._replace("merge", redo, new, token, rewritten=len(redo))
        self._fs.delete(self._P(staged), True)

    def update(self, where: Column, assign: dict[str, Column]) -> None:
        """Sets columns in rows where the condition holds (null does not): the old rows' positions are deleted, the new rows added.

        A table of mode append is rewritten instead, only the folders that hold such rows."""
        self._change("update", where, assign)

    def delete(self, where: Column) -> None:
        """Deletes the rows where the condition holds, by position; a table of mode append is rewritten where it holds such rows."""
        self._change("delete", where, None)

    def _change(self, operation: str, where: Column, assign: dict[str, Column] | None) -> None:
        parts, names = self.parts(), self.spec.schema.names
        hit = F.coalesce(where, F.lit(False))
        if not [p for p in parts if not p.deletes]:
            return
        if self.spec.mode == "append":
            touched = self._read(parts, positions=True).filter(hit).select(F.regexp_replace("_file", "/[^/]*$", "").alias("f")).distinct().collect()  # one row a folder
            redo = self._under(parts, [r["f"] for r in touched])
            rows = self._read(redo)
            kept = rows.filter(~hit) if assign is None else rows.select(*[self._set(c, hit, assign) for c in names])
            if redo:
                self._replace(operation, redo, self._write(kept))
            return
        found = f"{self.path}/staged/{uuid.uuid4().hex}"
        self._read(parts, positions=True).filter(hit).write.parquet(found)
        dead = self.spark.read.schema(self.spec.schema.add("_file", T.StringType()).add("_row", T.LongType())).parquet(found)
        root = f"{self.path}/deletes/{uuid.uuid4().hex}"
        dead.select("_file", "_row").sortWithinPartitions("_file", "_row").write.parquet(root)
        n = self.spark.read.parquet(root).count()
        if n:
            added = [] if assign is None else self._write(dead.select(*[self._set(c, F.lit(True), assign) for c in names]))
            self._commit(operation, [*added, Part(root, None, n, True)], None, changed=n)
        self._fs.delete(self._P(found), True)

    def _set(self, name: str, hit: Column, assign: dict[str, Column]) -> Column:
        kind = self.spec.schema[name].dataType
        return F.when(hit, assign[name].cast(kind)).otherwise(F.col(name)).alias(name) if name in assign else F.col(name)

    # upkeep

    def _sizes(self, parts: list[Part]) -> dict[str, tuple[int, int]]:
        """Files and bytes of each part, from the file system."""
        out = {}
        for p in parts:
            files = [s for s in self._fs.listStatus(self._P(p.path)) if s.getPath().getName().endswith(".parquet")]
            out[p.path] = (len(files), sum(s.getLen() for s in files))
        return out

    def compact(self, target_bytes: int = TARGET_BYTES) -> int:
        """Rewrites the days (or the table) that have more files than their size asks for, each into files of about the target size. Gives the number of parts rewritten.

        Folders with deleted rows are rewritten too, so that no positions are left. A day's rows are spread over as many
        tasks as it gets files."""
        parts = self.parts()
        data, deletes = [p for p in parts if not p.deletes], [p for p in parts if p.deletes]
        sizes, days = self._sizes(data), {}
        for p in data:
            days.setdefault(p.day, []).append(p)
        want = {d: max(1, math.ceil(sum(sizes[p.path][1] for p in ps) / target_bytes)) for d, ps in days.items()}
        holed = set(self._holed(data, deletes))
        redo = [p for d, ps in days.items() if sum(sizes[p.path][0] for p in ps) > want[d] or any(p in holed for p in ps) for p in ps]
        if not redo and not deletes:
            return 0
        again = {p.day for p in redo}
        rows = self._read([*redo, *deletes])
        if self.spec.days and again and None not in again:
            files = F.element_at(F.create_map(*[F.lit(x) for d in sorted(again) for x in (d, want[d])]), self._day())  # one entry a day
            rows = rows.withColumn("_file_no", F.pmod(F.xxhash64(*rows.columns), files)).repartition(sum(want[d] for d in again), self._day(), "_file_no").drop("_file_no")
        elif again:
            rows = rows.repartition(sum(want[d] for d in again))
        self._replace("compact", [*redo, *deletes], self._write(rows) if redo else [], rewritten=len(redo))
        return len(redo)

    def _holed(self, data: list[Part], deletes: list[Part]) -> list[Part]:
        """The data parts with rows that the delete parts name."""
        if not deletes:
            return []
        named = self.spark.read.schema("_file string, _row bigint").parquet(*[p.path for p in deletes]).select(F.regexp_replace("_file", "/[^/]*$", "").alias("f")).distinct().collect()  # one row a folder
        return self._under(data, [r["f"] for r in named])

    @staticmethod
    def _under(parts: list[Part], folders: list[str]) -> list[Part]:
        """The parts that are these folders, however their addresses are spelt."""
        tail = lambda path: path.split("://")[-1].removeprefix("file:").strip("/")
        names = {tail(f) for f in folders}
        return [p for p in parts if tail(p.path) in names]

    def fold_deletes(self) -> int:
        """Rewrites the data folders that have deleted rows, without these, and drops the positions. Gives the number of delete parts dropped."""
        parts = self.parts()
        data, deletes = [p for p in parts if not p.deletes], [p for p in parts if p.deletes]
        if deletes:
            redo = self._holed(data, deletes)
            self._replace("fold", [*redo, *deletes], self._write(self._read([*redo, *deletes])) if redo else [], folded=len(deletes))
        return len(deletes)

    def rewrite_manifests(self) -> tuple[int, int]:
        """All parts in one manifest. Gives the number of manifests before and after."""
        log = self._log()
        before = len(log[-1]["manifests"]) if log else 0
        if before > 1:
            self._commit("manifests", self.parts(), None, [])
        return before, min(before, 1)

    def expire(self, older_than_ms: int, keep_last: int = 10) -> int:
        """Drops snapshots committed before a time, but not the last few, and the manifests and folders no kept snapshot lists. Gives the number dropped.

        Their tokens stay known."""
        log = self._log()
        gone = [e for e in log[: max(0, len(log) - keep_last)] if e["committed_ms"] < older_than_ms]
        if not gone:
            return 0
        past = self._past()
        for e in gone:
            stream, _, batch = (e["token"] or "").rpartition("/")
            if batch.isdigit():
                past["batches"][stream] = max(int(batch), past["batches"].get(stream, -1))
            elif e["token"]:
                past["whole"] = sorted({*past["whole"], e["token"]})
        self._put("tokens.json", past, overwrite=True)
        left = [e for e in log if e not in gone]
        paths, manifests = {p.path for e in left for p in self._parts_of(e)}, {m for e in left for m in e["manifests"]}
        dead = {p.path for e in gone for p in self._parts_of(e)} - paths
        for e in gone:
            self._fs.delete(self._P(f"{self.path}/log/{e['id']:012d}.json"), False)
        for m in {m for e in gone for m in e["manifests"]} - manifests:
            self._fs.delete(self._P(f"{self.path}/{m}"), False)
        for path in dead:
            self._fs.delete(self._P(path), True)
        return len(gone)

    def health(self) -> DataFrame:
        """The figures of one table_health_summary row, from the log and the footers, without reading data columns."""
        log = self._log()
        data = F.col("content") == 0
        f = self.files().agg(
            F.count_if(data).alias("data_file_count"),
            F.count_if(F.col("content") == 1).alias("position_delete_file_count"),
            F.count_if(F.col("content") == 2).alias("equality_delete_file_count"),
            F.round(F.coalesce(F.avg(F.when(data, F.col("file_size_in_bytes"))), F.lit(0.0)) / 1048576, 4).alias("avg_file_size_mb"),
            F.round(F.coalesce(F.sum(F.when(data, F.col("file_size_in_bytes"))), F.lit(0)) / 1048576, 4).alias("total_size_mb"),
            F.coalesce(F.sum(F.when(data, F.col("record_count"))), F.lit(0)).alias("record_count"),
            F.count_if(data & (F.col("file_size_in_bytes") < 16 * 1048576)).alias("small_file_count"),
        )
        ratio = F.coalesce((F.col("position_delete_file_count") + F.col("equality_delete_file_count")) / F.nullif(F.col("data_file_count"), F.lit(0)), F.lit(0.0))
        return f.select(
            F.lit(self.spec.mode).alias("table_mode"), "*", ratio.alias("delete_to_data_file_ratio"), F.lit(len(log[-1]["manifests"]) if log else 0).cast("bigint").alias("manifest_count"),
            F.lit(len(log)).cast("bigint").alias("snapshot_count"), F.timestamp_millis(F.lit(log[-1]["committed_ms"] if log else None).cast("bigint")).alias("last_committed_at"),
        )


class Catalog:
    """Tables by name under one folder, in namespaces that are folders of it."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._P = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._P(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def create_namespace(self, name: str) -> None:
        """Makes a namespace unless it is there."""
        self._fs.mkdirs(self._P(f"{self.root}/{name}"))

    def namespaces(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._P(self.root))) if self._fs.exists(self._P(self.root)) else []

    def table(self, name: str, spec: TableSpec) -> Table:
        """A table as namespace.name; its declaration is noted when it is first asked for."""
        t = Table(self.spark, f"{self.root}/{name.replace('.', '/')}", spec)
        if not self._fs.exists(self._P(f"{t.path}/table.json")):
            t._put("table.json", {"columns": spec.columns, "key": list(spec.key), "mode": spec.mode, "guard": spec.guard, "days": spec.days})
        return t

    def tables(self, namespace: str) -> list[str]:
        root = self._P(f"{self.root}/{namespace}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(root) if self._fs.exists(self._P(s.getPath(), "table.json"))) if self._fs.exists(root) else []

    def properties(self, name: str) -> DataFrame:
        """key and value of a table's declaration."""
        path = f"{self.root}/{name.replace('.', '/')}"
        noted = Table(self.spark, path, TableSpec("x int"))._json("table.json")
        return self.spark.createDataFrame([(k, json.dumps(v) if not isinstance(v, str) else v) for k, v in sorted(noted.items())], "key string, value string")

    def drop(self, name: str) -> bool:
        """Drops a table with its data, if it is there."""
        return self._fs.delete(self._P(f"{self.root}/{name.replace('.', '/')}"), True)


def health_summary(tables: dict[str, Table], run_id: str, failed: Callable[[str, Exception], None] | None = None) -> DataFrame | None:
    """table_health_summary rows of several tables; one that can't be read is left out and told to failed()."""
    out = None
    for name, t in tables.items():
        try:
            h = t.health()
            row = h.select(F.lit(run_id).alias("run_id"), F.current_timestamp().alias("checked_at"), F.lit(name).alias("table_name"), *[c for c in h.columns if c != "small_file_count"])
        except Exception as error:  # noqa: BLE001
            if failed:
                failed(name, error)
            continue
        out = row if out is None else out.unionByName(row)
    return out


def maintain(tables: dict[str, Table], older_than_ms: int, keep_last: int = 10) -> list[tuple[str, str, str]]:
    """Compacts, folds deletes in (upsert tables only), rewrites manifests and expires, table by table; a failure is noted and the next step goes on. (table, step, outcome)."""
    out = []
    for name, t in tables.items():
        steps: list[tuple[str, Callable[[], object]]] = [("compact", t.compact), ("fold_deletes", t.fold_deletes), ("rewrite_manifests", t.rewrite_manifests), ("expire", lambda t=t: t.expire(older_than_ms, keep_last))]
        for step, run in steps:
            if step == "fold_deletes" and t.spec.mode == "append":
                out.append((name, step, "skipped"))
                continue
            try:
                run()
                out.append((name, step, "ok"))
            except Exception as error:  # noqa: BLE001
                out.append((name, step, f"failed: {str(error)[:200]}"))
    return out


def watched(table: Table, steps: dict[str, Callable[[Table], object]], query: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """A table's file figures before any step and after each, and how long a query over it then takes: stage, data_files, delete_files, manifests, snapshots, total_mb, seconds."""
    rows = []
    for stage, run in {"before": lambda _: None, **steps}.items():
        run(table)
        h = table.health().first()
        began = time.perf_counter()
        if query:
            query(table.read()).write.format("noop").mode("overwrite").save()
        rows.append((stage, h["data_file_count"], h["position_delete_file_count"], h["manifest_count"], h["snapshot_count"], float(h["total_size_mb"]), time.perf_counter() - began if query else None))
    return table.spark.createDataFrame(rows, "stage string, data_files bigint, delete_files bigint, manifests bigint, snapshots bigint, total_mb double, seconds double")
