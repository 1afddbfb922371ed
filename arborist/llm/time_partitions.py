"""Adaptive time partitions: a table as Parquet files, each a part of a leaf of the calendar, none over a limit of rows.

Counts by hour are grouped by Spark and summed up to days, months and years.  The driver takes the years, and below them
only the counts of what it has to split, and recurses: a node above the limit is split into all its months, days or
hours; of siblings in time order each within the limit joins the run of the one directly before it if that stays within
the limit, else it starts a run.  Leaves are the runs that have rows, hours above the limit, and the rows without a moment.
A leaf's rows, in the order asked for, fill parts of `limit` rows, one Parquet file each.

With a limit that is a share of the table there are at most 1/share nodes above it a level, so what the driver collects and
what is broadcast (a map from the years, months, days and hours that are members of runs, by which each row's hour finds its
leaf) is bounded by the calendar and the share, not by the rows.  Rows of leaves within the limit go straight to their file.
Leaves of several parts, which may be most of the table, are first dealt by ranges of the order into slices, and
row_number within a slice, with the sizes of the slices before it, gives the part; so no task sorts such a leaf.  Then all
rows are dealt by file, a file being written by one task.  Spark's writer commits to a folder of its own; files are moved
into place from there, so tasks may be lost and run again.

A rewrite for a table that has gained rows leaves those files as they are whose leaf, part and rows recur: where a leaf has
as many rows as before all do, else those parts that end before the first new row.

Cases: rows without a moment are the leaf `null`; null ids and arrival times sort first, a null id isn't moved and counts as an
empty text in the digest; ties in the order go by a hash of all columns (map columns aside), so rows that are still tied are alike;
repeated rows are kept.  Columns that differ only by case are kept (names are then taken exactly).  An empty table has no files.
"""

from __future__ import annotations

import contextlib
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .spark_io import new_folder, stored

LEVELS = ("year", "month", "day", "hour")
NULLS = "null"
_DAY_US, _HOUR_US = 86_400_000_000, 3_600_000_000


# ---- the calendar

def microseconds(ts: Column) -> Column:
    """Of a timestamp without a zone, since 1970; no session zone takes part."""
    ts = ts.cast("timestamp_ntz")
    minutes = (F.unix_date(ts.cast("date")).cast("bigint") * 24 + F.hour(ts)) * 60 + F.minute(ts)
    return minutes * 60_000_000 + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("bigint")


def node_keys(us: Column) -> dict[str, Column]:
    """The keys of a moment's year, month, day and hour; a node's key is its parent's times the parent's width, and its place there."""
    date = F.date_from_unix_date(F.call_function("div", us - F.pmod(us, F.lit(_DAY_US)), F.lit(_DAY_US)).cast("int"))
    year = F.year(date).cast("bigint")
    month = year * 12 + F.month(date) - 1
    day = month * 31 + F.dayofmonth(date) - 1
    return {"year": year, "month": month, "day": day, "hour": day * 24 + (F.pmod(us, F.lit(_DAY_US)) / _HOUR_US).cast("int")}


def _children(level: str, key: int) -> list[int]:
    """Keys of all months of a year, days of a month or hours of a day."""
    if level == "year":
        return [key * 12 + m for m in range(12)]
    if level == "day":
        return [key * 24 + h for h in range(24)]
    year, month = divmod(key, 12)
    leap = year % 4 == 0 and (year % 100 != 0 or year % 400 == 0)
    return [key * 31 + d for d in range((31, 29 if leap else 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)[month])]


def _place(level: str, key: int) -> str:
    return {"year": f"{key:04d}", "month": f"{key % 12 + 1:02d}", "day": f"{key % 31 + 1:02d}", "hour": f"{key % 24:02d}"}[level]


@dataclass
class Counts:
    """Rows by year, and by month, day and hour of the nodes that are split; rows without a moment."""

    nodes: dict[str, dict[int, int]] = field(default_factory=lambda: {k: {} for k in LEVELS})
    nulls: int = 0


@dataclass(frozen=True)
class Leaf:
    """A run of siblings (their keys), the number of its first file, and its rows."""

    name: str
    level: str | None
    members: tuple[int, ...]
    rows: int
    first_file: int = 0

    def parts(self, limit: int) -> int:
        return -(-self.rows // limit)


def _split(level: str, siblings: list[int], parents: str, counts: Counts, limit: int) -> Iterator[Leaf]:
    below = LEVELS[LEVELS.index(level) + 1] if level != "hour" else None
    run: list[int] = []
    total = 0

    def ended():
        if run and total:
            yield Leaf(f"{parents}{_place(level, run[0])}-{_place(level, run[-1])}", level, tuple(run), total)

    for key in siblings:
        n = counts.nodes[level].get(key, 0)
        if n > limit and below:
            yield from ended()
            run, total = [], 0
            yield from _split(below, _children(level, key), f"{parents}{_place(level, key)}/", counts, limit)
        elif run and total + n <= limit:
            run.append(key)
            total += n
        else:
            yield from ended()
            run, total = [key], n
    yield from ended()


def leaves(counts: Counts, limit: int) -> list[Leaf]:
    """All leaves in time order, those without a moment last; files are numbered through."""
    years = counts.nodes["year"]
    found = list(_split("year", list(range(min(years), max(years) + 1)), "", counts, limit)) if years else []
    if counts.nulls:
        found.append(Leaf(NULLS, None, (), counts.nulls))
    out, at = [], 0
    for leaf in found:
        out.append(replace(leaf, first_file=at))
        at += leaf.parts(limit)
    return out


def hourly(rows: DataFrame, us: Column, **which: Column) -> DataFrame:
    """Rows by hour (null: no moment) and the keys above it; a column of counts for each of which."""
    counts = (F.count(F.when(c, 1)).alias(name) for name, c in which.items())
    return rows.groupBy(*(c.alias(k) for k, c in node_keys(us).items())).agg(*counts)


def collected(hours: DataFrame, n: str, limit: int) -> Counts:
    """What leaves() needs of a table of hourly(): all years, and the children of nodes above the limit."""
    out = Counts()
    years = hours.groupBy("year").agg(F.sum(n).alias("n")).where("n > 0").collect()
    out.nulls = sum(r.n for r in years if r.year is None)
    out.nodes["year"] = {r.year: r.n for r in years if r.year is not None}
    for level, below in zip(LEVELS, LEVELS[1:]):
        above = [k for k, x in out.nodes[level].items() if x > limit]
        if above:
            kids = hours.where(F.col(level).isin(above)).groupBy(below).agg(F.sum(n).alias("n")).where("n > 0")
            out.nodes[below] = {r[0]: r.n for r in kids.collect()}
    return out


# ---- files

@dataclass(frozen=True)
class File:
    leaf: str
    part: int
    rows: int
    place: str  # within the layout's folder
    stayed: bool = False


@contextlib.contextmanager
def _exact_names(spark: SparkSession):
    before = spark.conf.get("spark.sql.caseSensitive")
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.caseSensitive", before)


class Layout:
    """A folder of Parquet files for rows (any columns) under a limit.

    us: the moment in microseconds; order: columns by which a leaf's rows are ordered after it.
    """

    def __init__(self, rows: DataFrame, us: Column, order: list[Column], limit: int, folder: str):
        spark = self.spark = rows.sparkSession
        self.columns, self.limit, self.folder = rows.columns, limit, folder
        prefix = "_"
        while any(c.lower().startswith(prefix) for c in rows.columns):
            prefix += "_"
        self.us, self.tie, self.file, self.slice, self.parts = (prefix + c for c in ("us", "tie", "file", "slice", "parts"))
        self.order = [f"{prefix}o{i}" for i in range(len(order))]
        hashed = [F.col(f"`{f.name}`") for f in rows.schema.fields if not isinstance(f.dataType, T.MapType)]
        with _exact_names(spark):
            self.rows = rows.select("*", us.alias(self.us), *(c.alias(n) for c, n in zip(order, self.order)), F.xxhash64(*hashed).alias(self.tie))
        self.sort = [self.us, *self.order, self.tie]

    def _with_leaf(self, rows: DataFrame, found: list[Leaf]) -> DataFrame:
        """Rows with their leaf's first file and number of parts: the map of members is joined level by level."""
        keys, firsts, parts = node_keys(F.col(self.us)), [], []
        for level in LEVELS:
            members = [(k, x.first_file, x.parts(self.limit)) for x in found if x.level == level for k in x.members]
            if members:
                names = [f"{self.file}_{level}_{i}" for i in range(3)]
                known = self.spark.createDataFrame(members, f"{names[0]} bigint, {names[1]} int, {names[2]} int")
                rows = rows.withColumn(f"{names[0]}k", keys[level]).join(F.broadcast(known), F.col(f"{names[0]}k") == F.col(names[0]), "left").drop(f"{names[0]}k", names[0])
                firsts, parts = [*firsts, F.col(names[1])], [*parts, F.col(names[2])]
        for x in found:
            if x.level is None:
                firsts, parts = [*firsts, F.lit(x.first_file)], [*parts, F.lit(x.parts(self.limit))]
        drop = [c for c in rows.columns if c.startswith(f"{self.file}_")]
        rows = rows.withColumn(self.file, F.coalesce(*firsts, F.lit(-1)).cast("int")).withColumn(self.parts, F.coalesce(*parts, F.lit(1)).cast("int"))
        return rows.drop(*drop)

    def _dealt(self, rows: DataFrame) -> DataFrame:
        """Rows of leaves of several parts, with the file of their own part."""
        ranged = rows.repartitionByRange(self.file, *self.sort, F.monotonically_increasing_id()).withColumn(self.slice, F.spark_partition_id())
        ranged = stored(ranged, "time_slices")
        sizes = ranged.groupBy(self.file, self.slice).agg(F.count("*").alias("n"))
        before = Window.partitionBy(self.file).orderBy(self.slice).rowsBetween(Window.unboundedPreceding, -1)
        sizes = sizes.select(self.file, self.slice, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(self.parts + "_n"))
        at = F.row_number().over(Window.partitionBy(self.file, self.slice).orderBy(*self.sort)) - 1 + F.col(self.parts + "_n")
        ranked = ranged.join(sizes, [self.file, self.slice]).withColumn(self.parts + "_at", at.cast("bigint"))
        return ranked.withColumn(self.file, (F.col(self.file) + F.expr(f"`{self.parts}_at` div {self.limit}")).cast("int")).drop(self.slice, self.parts + "_n")

    def _move(self, staged: str, found: dict[int, tuple[str, int, int]]) -> list[File]:
        """Files of a written folder moved to their places."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path
        fs = path(self.folder).getFileSystem(self.spark._jsc.hadoopConfiguration())
        out = []
        for status in fs.globStatus(path(f"{staged}/*/*.parquet")) or []:
            leaf, part, n = found[int(status.getPath().getParent().getName().partition("=")[2])]
            place = f"{leaf}/part-{part:05d}.parquet"
            fs.mkdirs(path(f"{self.folder}/{leaf}"))
            if not fs.rename(status.getPath(), path(f"{self.folder}/{place}")):
                raise OSError(f"{place} can't be moved into place")
            out.append(File(leaf, part, n, place))
        fs.delete(path(staged), True)
        return out

    def _delete(self, files: list[File]) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = path(self.folder).getFileSystem(self.spark._jsc.hadoopConfiguration())
        for f in files:
            at = path(f"{self.folder}/{f.place}")
            fs.delete(at, False)
            while len(fs.listStatus(at.getParent())) == 0:  # empty folders of leaves that are gone
                at = at.getParent()
                fs.delete(at, False)

    def write(self, found: list[Leaf], which: Column, before: tuple[list[Leaf], list[File], Column] | None = None) -> list[File]:
        """Writes the rows of which, whose leaves are found; returns all files.

        before: the leaves and files that are there, and the condition of the rows in them (all of which are written again).
        """
        with _exact_names(self.spark):
            return self._write(found, which, before)

    def _write(self, found, which, before):
        numbered = {x.first_file + p: (x.name, p + 1, min(self.limit, x.rows - p * self.limit)) for x in found for p in range(x.parts(self.limit))}
        old_leaves, old_files, old_rows = before or ([], [], F.lit(False))
        rows_before = {x.name: x.rows for x in old_leaves}
        rows = self._with_leaf(self.rows.where(which), found)
        several = any(x.parts(self.limit) > 1 for x in found)
        dealt = self._dealt(rows.where(F.col(self.parts) > 1)) if several else None
        stays = {n for x in found if rows_before.get(x.name) == x.rows for n in range(x.first_file, x.first_file + x.parts(self.limit))}
        grown = [x for x in found if x.parts(self.limit) > 1 and rows_before.get(x.name, x.rows) != x.rows]
        if grown:
            at = F.col(self.parts + "_at")
            first = F.col(self.file) - F.expr(f"`{self.parts}_at` div {self.limit}")
            new = dealt.where(~F.coalesce(old_rows, F.lit(False))).groupBy(first.cast("int").alias("first")).agg(F.min(at).alias("at")).collect()
            at_new = {r["first"]: r["at"] for r in new}
            stays |= {x.first_file + p for x in grown for p in range(at_new.get(x.first_file, 0) // self.limit)}
        out = rows.where(F.col(self.parts) == 1)
        kept = [self.file, *self.sort, *self.columns]
        out = out.select(*(F.col(f"`{c}`") for c in kept))
        if several:
            out = out.unionByName(dealt.select(*(F.col(f"`{c}`") for c in kept)))
        if stays:
            out = out.where(~F.col(self.file).isin(sorted(stays)))
        staged = f"{self.folder}-staged"
        ordered = out.repartition(self.file).sortWithinPartitions(self.file, *self.sort)
        ordered.select(self.file, *(F.col(f"`{c}`") for c in self.columns)).write.partitionBy(self.file).parquet(staged)
        recurring = {numbered[n][:2] for n in stays}
        kept_files = [replace(f, stayed=True) for f in old_files if (f.leaf, f.part) in recurring]
        self._delete([f for f in old_files if (f.leaf, f.part) not in recurring])
        return kept_files + self._move(staged, numbered)


def _digests(batches):
    """Of rows (place, at, id, new), sorted by place and at: place, rows, new rows, SHA-256 of the ids."""
    place, digest, n, new = None, None, 0, 0
    schema = pa.schema([("place", pa.string()), ("n_rows", pa.int64()), ("n_new", pa.int64()), ("ids_sha256", pa.string())])

    def row():
        return pa.RecordBatch.from_pylist([{"place": place, "n_rows": n, "n_new": new, "ids_sha256": digest.hexdigest()}], schema)

    for batch in batches:
        names = batch.column("place").dictionary_encode()
        codes = names.indices.to_numpy()
        edges = [0, *((codes[1:] != codes[:-1]).nonzero()[0] + 1).tolist(), len(codes)] if len(codes) else [0]
        for a, b in zip(edges, edges[1:]):
            name = names.dictionary[codes[a]].as_py()
            if name != place:
                if place is not None:
                    yield row()
                place, digest, n, new = name, hashlib.sha256(), 0, 0
            ids = pc.fill_null(batch.column("id").slice(a, b - a).cast(pa.string()), "")
            digest.update(("," * bool(n) + ",".join(ids.to_pylist())).encode())
            n += b - a
            new += pc.sum(batch.column("new").slice(a, b - a).cast(pa.int64())).as_py()
    if place is not None:
        yield row()


def described(spark: SparkSession, folder: str, files: list[File], ids: Column, new: Column) -> DataFrame:
    """leaf, part, path, columns, n_rows, n_new, ids_sha256 and rewritten of each file, as read back in the files' order."""
    if not files:
        return spark.createDataFrame([], "leaf string, part bigint, n_rows bigint, n_new bigint, columns string, ids_sha256 string, path string, rewritten boolean")
    with _exact_names(spark):
        read = spark.read.option("recursiveFileLookup", "true").parquet(folder)
        name = folder.rstrip("/").rpartition("/")[2]
        place = F.substring_index(F.col("_metadata.file_path"), f"{name}/", -1)
        rows = read.select(place.alias("place"), F.col("_metadata.row_index").alias("at"), ids.alias("id"), new.alias("new"))
        sums = rows.repartition("place").sortWithinPartitions("place", "at").select("place", "id", "new")
        sums = sums.mapInArrow(_digests, "place string, n_rows bigint, n_new bigint, ids_sha256 string")
        root = spark._jvm.org.apache.hadoop.fs.Path(folder)
        root = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toUri()
        base = f"{root.getScheme()}://{root.getAuthority() or ''}{root.getPath()}"
        known = spark.createDataFrame([(f.place, f.leaf, f.part, not f.stayed) for f in files], "place string, leaf string, part bigint, rewritten boolean")
        out = sums.join(F.broadcast(known), "place")
        out = out.select("leaf", "part", "n_rows", "n_new", F.lit(",".join(read.columns)).alias("columns"), "ids_sha256", F.concat(F.lit(base + "/"), "place").alias("path"), "rewritten")
        return stored(out, "files")  # a row a file; read while names are taken exactly


# ---- clicks

SHARE = 650
ARRIVED_BEFORE = "2024-03-01 00:00:00"


def click_moment(ts: Column, click_id: Column) -> Column:
    """The moment of a click in microseconds: ts, moved back or floored to its week for some ids."""
    k = F.crc32(F.encode(click_id.cast("string"), "UTF-8")) % 128
    us = microseconds(ts)
    week = us - F.pmod(us + 3 * _DAY_US, F.lit(7 * _DAY_US))  # 1970-01-01 was a Thursday
    return F.when(k < 16, us - (k + 6) * (k + 6) * (k + 6) * _DAY_US).when(k > 111, week).otherwise(us)


def click_partitions(clicks: DataFrame, share: int = SHARE, arrived_before: str = ARRIVED_BEFORE) -> DataFrame:
    """Writes the clicks that arrived before a time, then rewrites the layout for all; described() of the final files."""
    spark = clicks.sparkSession
    with _exact_names(spark):
        us = click_moment(F.col("ts"), F.col("click_id"))
        early = F.coalesce(F.col("arrived_at").cast("timestamp_ntz") < F.lit(arrived_before).cast("timestamp_ntz"), F.lit(False))
        hours = stored(hourly(clicks, us, early=early, total=F.lit(True)), "hours")
        limit = 1 + (hours.agg(F.sum("total")).first()[0] or 0) // share
        folder = new_folder(spark, "clicks")
        layout = Layout(clicks, us, [F.col("arrived_at"), F.col("click_id")], limit, folder)
        first = leaves(collected(hours, "early", limit), limit)
        files = layout.write(first, early) if first else []
        final = leaves(collected(hours, "total", limit), limit)
        files = layout.write(final, F.lit(True), (first, files, early)) if final else []
        return described(spark, folder, files, F.col("click_id"), ~early)


__all__ = ["Counts", "Layout", "Leaf", "click_moment", "click_partitions", "collected", "described", "hourly", "leaves", "microseconds"]
