"""Versioned snapshots of a keyed table on plain Parquet.

Rows live in id-range buckets, so a bucket holds at most ``bucket_width`` rows whatever the key
distribution; where that would make more than ``MOST_BUCKETS`` of them, a table written from scratch
takes a multiple of the width, so files do not grow small as tables grow large. A version is a small map bucket -> folder and a list of change folders. A change
writes its own rows only, with the number of its version; reading takes the latest change of each
key and leaves the key's row in the bucket out. ``FAN`` change folders of one level become one of
the next, so a row is written again a logarithmic number of times, and changes that exceed
``SHARE`` of the buckets they touch are worked into them. Names (``read``,
``current``, ``write``) point at versions; one appended line re-points any number of names at
once, and is written last, so a crash at any earlier moment leaves the old state in force.

One writer owns a store. Readers see the version their name points at.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: So many change folders of a level become one of the next.
FAN = 8
#: Changes above this share of the rows in the buckets they touch are worked into the buckets.
SHARE = 0.25
#: A table written from scratch has about so many buckets at most, unless its keys are sparse.
MOST_BUCKETS = 256


#: What a change row has beside the table's columns.
CHANGE = [
    T.StructField("_deleted", T.BooleanType()),
    T.StructField("_seq", T.LongType()),
    T.StructField("_bucket", T.LongType()),
]


@dataclass(frozen=True)
class Version:
    """Folder and rows of each bucket with its parts, and the change folders in order."""

    base: dict[int, dict]
    changes: list[dict]
    #: Width of its buckets; the store's own where none is stated.
    width: int | None = None


@dataclass(frozen=True)
class Pointer:
    """What the names point at from here on."""

    seq: int
    names: dict[str, int]
    action: str
    batch: str | None = None
    #: The pointer whose content this one changed; 0 for the first.
    parent: int | None = None


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """One line of text as a one-file folder; what a crashed attempt left there is replaced."""
    line = spark.range(0, 1, 1, 1).select(F.lit(text).alias("value"))
    line.write.mode("overwrite").text(path)


def get_lines(spark: SparkSession, path: str) -> list[str]:
    """All lines of the folders that match ``path``; none if there is no such folder."""
    try:
        return [r.value for r in spark.read.text(path).collect()]
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return []
        raise


def id_bucket(width: int, key: str = "id") -> Column:
    """Floor division, also right for negative ids."""
    rid = F.col(key)
    return F.call_function("div", rid - F.pmod(rid, F.lit(width)), F.lit(width))


class SnapshotStore:
    def __init__(
        self,
        spark: SparkSession,
        root: str,
        schema: T.StructType,
        key: str = "id",
        bucket_width: int = 1_000_000,
        closed: Column | None = None,
        most_buckets: int | None = MOST_BUCKETS,
    ):
        """``closed`` says which rows are finished; they are kept in files of their own.

        Without ``most_buckets`` every bucket is ``bucket_width`` wide, however many there are.
        """
        self.spark = spark
        self.root = root.rstrip("/")
        self.schema = schema
        self.key = key
        self.bucket_width = bucket_width
        self.most_buckets = most_buckets
        self._pointers: list[Pointer] | None = None
        self._manifests: dict[int, Version] = {}
        self.closed = None if closed is None else F.coalesce(closed, F.lit(False))

    # ---- names and versions -------------------------------------------------------------

    def _dir(self, *parts: str) -> str:
        return "/".join([self.root, *parts])

    def history(self) -> list[Pointer]:
        """All pointers in order; read once, then kept up by this single writer."""
        if self._pointers is None:
            lines = get_lines(self.spark, self._dir("pointers", "*"))
            found = [Pointer(**json.loads(line)) for line in lines]
            found = [p if p.parent is not None else replace(p, parent=p.seq - 1) for p in found]
            self._pointers = sorted(found, key=lambda p: p.seq)
        return self._pointers

    def refresh(self) -> "SnapshotStore":
        self._pointers = None
        return self

    def names(self) -> dict[str, int]:
        history = self.history()
        return dict(history[-1].names) if history else {}

    def _point(self, names: dict[str, int], action: str, batch: str | None = None) -> None:
        last = len(self.history())
        self._append(Pointer(last + 1, names, action, batch, last))

    def _append(self, pointer: Pointer) -> None:
        text = json.dumps(asdict(pointer))
        put_text(self.spark, self._dir("pointers", f"seq={pointer.seq:09d}"), text)
        self._pointers = [*self.history(), pointer]

    def switch(self, version: int, *names: str) -> None:
        """Points the given names (default: all known and ``read``) at a version, at once."""
        self._version(version)
        wanted = names or tuple({*self.names(), "read"})
        self._point({**self.names(), **{n: version for n in wanted}}, "switch")

    def rollback(self) -> dict[str, int]:
        """Restores all names to what they were before the switch or change now in force.

        The restored state takes up its own past again: a second rollback goes one step further
        back, and a batch that was rolled back may be applied anew.
        """
        history = self.history()
        before = self._parent(history[-1]) if history else None
        if before is None:
            raise ValueError("nothing to roll back to")
        self._append(replace(before, seq=len(history) + 1, action="rollback"))
        return self.names()

    def _parent(self, pointer: Pointer) -> Pointer | None:
        return self.history()[pointer.parent - 1] if pointer.parent else None

    def applied(self, batch: str) -> bool:
        """Whether the content in force contains the batch."""
        history = self.history()
        pointer = history[-1] if history else None
        while pointer is not None:
            if pointer.batch == batch:
                return True
            pointer = self._parent(pointer)
        return False

    # ---- content ------------------------------------------------------------------------

    def _version(self, version: int) -> Version:
        if version not in self._manifests:
            (line,) = get_lines(self.spark, self._dir("versions", f"v{version:09d}"))
            stored = json.loads(line)
            base = {int(b): held for b, held in stored["base"].items()}
            self._manifests[version] = Version(base, stored["changes"], stored.get("width"))
        return self._manifests[version]

    def _folders(self, version: int) -> dict[int, str]:
        return {b: held["folder"] for b, held in self._version(version).base.items()}

    def _parts(self, held: list[dict], closed: bool | None) -> list[str]:
        """The folders of these buckets that hold rows of the wanted kind."""
        wanted = None if closed is None or self.closed is None else f"closed={str(closed).lower()}"
        return [
            f"{h['folder']}/{part}".rstrip("/") for h in held for part in h["parts"] if wanted in (None, part)
        ]

    def _load(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[self._dir(f) for f in folders])

    def _latest(self, changes: list[dict]) -> DataFrame:
        """The last change of each key; an upsert goes before a delete of the same batch."""
        shape = T.StructType([*self.schema, *CHANGE])
        rows = self.spark.read.schema(shape).parquet(*[self._dir(c["folder"]) for c in changes])
        if len(changes) == 1 and changes[0].get("unique"):
            return rows
        rest = F.struct(*[n for n in shape.names if n != self.key])
        order = F.struct("_seq", ~F.col("_deleted"))
        return rows.groupBy(self.key).agg(F.max_by(rest, order).alias("last")).select(self.key, "last.*")

    def _merged(self, held: list[dict], changes: list[dict], closed: bool | None = None) -> DataFrame:
        """The rows of these buckets with the changes; ``closed`` asks for one kind of rows only."""
        rows = self._load(self._parts(held, closed))
        if not changes:
            return rows
        latest = self._latest(changes)
        kept = rows.join(latest.select(self.key), self.key, "left_anti").select(*self.schema.names)
        new = latest.where(~F.col("_deleted")).select(*self.schema.names)
        if closed is not None and self.closed is not None:
            new = new.where(self.closed == F.lit(closed))
        return kept.unionByName(new)

    def read(self, name: str = "read", closed: bool | None = None) -> DataFrame:
        """The rows a name points at; of a store that keeps closed rows apart also one kind only."""
        names = self.names()
        if name not in names:
            return self.spark.createDataFrame([], self.schema)
        return self.read_version(names[name], closed)

    def read_version(self, version: int, closed: bool | None = None) -> DataFrame:
        found = self._version(version)
        return self._merged(list(found.base.values()), found.changes, closed)

    def upserted(self, version: int) -> DataFrame:
        """The rows that the change of this version brought."""
        shape = T.StructType([*self.schema, *CHANGE])
        rows = self.spark.read.schema(shape).parquet(self._dir("changes", f"v{version:09d}"))
        return rows.where(~F.col("_deleted")).select(*self.schema.names)

    def view(self, view_name: str, name: str = "read") -> None:
        self.read(name).createOrReplaceTempView(view_name)

    def _next_version(self) -> int:
        """One past every version that any name ever pointed at."""
        seen = [v for row in self.history() for v in row.names.values()]
        version = max(seen, default=0) + 1
        left = set(self._children("data")) | {v[:10] for v in self._children("changes")}
        while f"v{version:09d}" in left:  # left behind by a crash
            version += 1
        return version

    def _fitting(self, buckets: int) -> int:
        """The width at which so many buckets of the store's own width become few enough."""
        return self.bucket_width * max(1, -(-buckets // (self.most_buckets or max(1, buckets))))

    def width_for(self, keys: DataFrame) -> int:
        """The width of the buckets of a table written from scratch with about these keys."""
        if not self.most_buckets:
            return self.bucket_width
        bucket = id_bucket(self.bucket_width, self.key)
        return self._fitting(keys.agg(F.count_distinct(bucket)).first()[0])

    def bucket(self, width: int) -> Column:
        """The bucket of a key; rows for ``replace`` may be dealt by it."""
        return id_bucket(width, self.key)

    def size(self, name: str = "read") -> tuple[int, int]:
        """Width of the buckets and number of rows, those of changes included, a name points at."""
        version = self.names().get(name)
        found = self._version(version) if version is not None else Version({}, [])
        rows = sum(h["rows"] for h in found.base.values())
        return found.width or self.bucket_width, rows + sum(n for c in found.changes for n in c["rows"].values())

    def _write_buckets(
        self, rows: DataFrame, version: int, width: int | None = None, dealt: bool = False
    ) -> dict[int, dict]:
        """Writes rows bucket by bucket; large buckets are split over several files.

        Rows that are ``dealt`` by bucket already do not move again, and a bucket is one file.
        """
        path = f"data/v{version:09d}"
        rows = rows.select(*self.schema.names).withColumn("bucket", id_bucket(width or self.bucket_width, self.key))
        by = ["bucket"]
        if self.closed is not None:
            rows, by = rows.withColumn("closed", self.closed), ["bucket", "closed"]
        rows = rows if dealt else rows.hint("rebalance", *by)
        rows.write.partitionBy(*by).parquet(self._dir(path))
        shape = "bucket long" if self.closed is None else "bucket long, closed boolean"
        found = self.spark.read.schema(shape).parquet(self._dir(path)).groupBy(*by).count().collect()
        base: dict[int, dict] = {}
        for r in found:
            held = base.setdefault(r["bucket"], {"folder": f"{path}/bucket={r['bucket']}", "rows": 0, "parts": []})
            held["rows"] += r["count"]
            held["parts"].append("" if self.closed is None else f"closed={str(r['closed']).lower()}")
        return base

    def _write_changes(self, rows: DataFrame, folder: str, level: int, unique: bool = True) -> dict:
        """Writes change rows in few files and counts them by bucket; ``unique``: one row per key."""
        path = self._dir("changes", folder)
        rows.hint("rebalance").write.parquet(path)
        found = self.spark.read.schema("_bucket long").parquet(path).groupBy("_bucket").count().collect()
        counts = {str(r[0]): r[1] for r in found}
        return {"folder": f"changes/{folder}", "level": level, "rows": counts, "unique": unique}

    def _commit(self, found: Version, version: int) -> int:
        put_text(self.spark, self._dir("versions", f"v{version:09d}"), json.dumps(asdict(found)))
        self._manifests[version] = found
        return version

    def replace(
        self,
        rows: DataFrame,
        *names: str,
        batch: str | None = None,
        keys: DataFrame | None = None,
        dealt: int | None = None,
    ) -> int:
        """Truncate-and-rebuild: a new version from scratch.

        ``keys`` are rows with the keys, or with about the same ones, that are cheaper to count.
        ``dealt`` is the width of the buckets by which the rows have been dealt already.
        """
        version = self._next_version()
        width = dealt or self.width_for(rows if keys is None else keys)
        base = self._write_buckets(rows, version, width, dealt is not None)
        self._commit(Version(base, [], width), version)
        targets = names or ("read", "current", "write")
        self._point({**self.names(), **{n: version for n in targets}}, "replace", batch)
        return version

    def apply_changes(
        self,
        upserts: DataFrame | None,
        deletes: DataFrame | None,
        batch: str | None = None,
        names: tuple[str, ...] = ("read", "current", "write"),
        compact: bool = False,
    ) -> int | None:
        """Upserts rows and deletes keys; deleting a missing key is fine.

        ``upserts`` has the table's columns, one row per key; ``deletes`` has the key column. A
        batch that was applied before is skipped and gives None, as does one without rows. A key
        in both is upserted. ``compact`` works all changes into their buckets at once.
        """
        if batch is not None and self.applied(batch):
            return None
        sides = []
        if upserts is not None:
            sides.append(upserts.select(*self.schema.names, F.lit(False).alias("_deleted")))
        if deletes is not None:
            empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema if f.name != self.key]
            sides.append(deletes.select(self.key, *empty, F.lit(True).alias("_deleted")))
        if not sides:
            return None
        return self._change(reduce(DataFrame.unionByName, sides), deletes is None, batch, names, compact)

    def apply_marked(
        self, rows: DataFrame, batch: str | None = None, names: tuple[str, ...] = ("read", "current", "write")
    ) -> int | None:
        """Like ``apply_changes``, with upserts and deletes in one frame that says ``_deleted``; one row per key."""
        if batch is not None and self.applied(batch):
            return None
        return self._change(rows.select(*self.schema.names, "_deleted"), True, batch, names, False)

    def _change(
        self, rows: DataFrame, unique: bool, batch: str | None, names: tuple[str, ...], compact: bool
    ) -> int | None:
        version = self._next_version()
        current = self.names().get("write")
        before = self._version(current) if current is not None else Version({}, [])
        width = before.width or self.bucket_width
        rows = rows.withColumns(
            {"_seq": F.lit(version).cast("long"), "_bucket": id_bucket(width, self.key)}
        )
        own = self._write_changes(rows, f"v{version:09d}", 0, unique)
        if not own["rows"]:
            return None
        self._commit(self._settled(before, own, version, compact), version)
        self._point({**self.names(), **{n: version for n in names}}, "change", batch)
        return version

    def _settled(self, before: Version, own: dict, version: int, compact: bool) -> Version:
        """The version with one more change folder, after the merges and compaction that are due."""
        changes = [*before.changes, own]
        touched = {int(b) for c in changes for b in c["rows"]}
        held = [before.base[b] for b in touched if b in before.base]
        waiting = sum(n for c in changes for n in c["rows"].values())
        if compact or waiting > SHARE * sum(h["rows"] for h in held):
            width = before.width or self.bucket_width
            if not before.base and not before.changes:
                width = self._fitting(len(touched))
            written = self._write_buckets(self._merged(held, changes), version, width)
            rest = {b: h for b, h in before.base.items() if b not in touched}
            return Version({**rest, **written}, [], width)
        level = 0
        while len(same := [c for c in changes if c["level"] == level]) >= FAN:
            level += 1
            merged = self._write_changes(self._latest(same), f"v{version:09d}-{level}", level)
            at = changes.index(same[0])
            changes = [*changes[:at], merged, *changes[at + len(same) :]]
        return Version(before.base, changes, before.width)

    # ---- clean-up -----------------------------------------------------------------------

    def clean_up(self, steps: int = 1) -> list[str]:
        """Removes version folders that neither the names in force nor ``steps`` rollbacks reach.

        Returns the removed folders, relative to the root. Pointers stay, so batches stay known as
        applied; a rollback beyond the kept steps finds its folders gone and fails. Folders of a
        version that crashed before it was committed go too. Readers of older versions must have
        ended; a folder that is gone already is passed over, so an interrupted clean-up may run again.
        """
        history = self.refresh().history()
        pointer = history[-1] if history else None
        live: set[int] = set()
        for _ in range(steps + 1):
            if pointer is None:
                break
            live |= set(pointer.names.values())
            pointer = self._parent(pointer)
        kept = {folder for version in live for folder in self._folders(version).values()}
        changes = {c["folder"] for version in live for c in self._version(version).changes}
        removed = []
        for version in self._children("data"):
            path = f"data/{version}"
            held = {f for f in kept if f.startswith(f"{path}/")}
            if not held:
                removed.append(path)
            else:
                buckets = [f"{path}/{b}" for b in self._children(path) if b.startswith("bucket=")]
                removed += [b for b in buckets if b not in held]
        removed += [f for f in (f"changes/{v}" for v in self._children("changes")) if f not in changes]
        live_names = {f"v{version:09d}" for version in live}
        removed += [f"versions/{v}" for v in self._children("versions") if v not in live_names]
        files, root = self._files()
        for folder in removed:
            files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(root, folder), True)
        self._manifests = {v: f for v, f in self._manifests.items() if v in live}
        return sorted(removed)

    def folders(self) -> list[str]:
        """All bucket and change folders in the store, whether a version needs them or not."""
        versions = [f"data/{v}" for v in self._children("data")]
        buckets = [f"{v}/{b}" for v in versions for b in self._children(v) if b.startswith("bucket=")]
        return [*buckets, *(f"changes/{v}" for v in self._children("changes"))]

    def _files(self):
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return root.getFileSystem(self.spark._jsc.hadoopConfiguration()), root

    def _children(self, folder: str) -> list[str]:
        files, root = self._files()
        path = self.spark._jvm.org.apache.hadoop.fs.Path(root, folder)
        return sorted(f.getPath().getName() for f in files.listStatus(path)) if files.exists(path) else []


def apply_changes(
    rows: DataFrame, upserts: DataFrame, deletes: DataFrame, key: str = "id"
) -> DataFrame:
    """The keyed upsert and delete as a plain query over a table without a store."""
    changed = upserts.select(key).unionByName(deletes.select(key))
    kept = rows.join(changed, key, "left_anti").select(*rows.columns)
    return kept.unionByName(upserts.select(*rows.columns))
