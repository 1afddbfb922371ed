"""Time partitions against a plain version of the same rules over rows with nulls, repeats, ties and a hot hour."""

from __future__ import annotations

import datetime as dt
import hashlib
import random
import zlib

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from arborist.llm import time_partitions as tp

SCHEMA = "click_id bigint, ts timestamp_ntz, arrived_at timestamp_ntz, client_id bigint, kind string"
CUT = dt.datetime(2024, 3, 1)


def moment(ts, click_id):
    if ts is None or click_id is None:
        return ts
    k = zlib.crc32(str(click_id).encode()) % 128
    if k < 16:
        return ts - dt.timedelta(days=(k + 6) ** 3)
    if k > 111:
        ts -= dt.timedelta(days=ts.weekday())
        return ts.replace(hour=0, minute=0, second=0, microsecond=0)
    return ts


def plain_leaves(moments, limit):
    """Name of the leaf of each hour's first moment."""
    def siblings(level, at):
        if level == "year":
            return [dt.datetime(y, 1, 1) for y in range(min(moments).year, max(moments).year + 1)]
        if level == "month":
            return [at.replace(month=m) for m in range(1, 13)]
        if level == "day":
            return [d for d in (at + dt.timedelta(days=i) for i in range(31)) if d.month == at.month]
        return [at + dt.timedelta(hours=i) for i in range(24)]

    cut = {"year": (4, "%Y"), "month": (7, "%m"), "day": (10, "%d"), "hour": (13, "%H")}
    below = {"year": "month", "month": "day", "day": "hour"}
    out = []

    def split(level, at, rows, parents):
        size, form = cut[level]
        same = lambda x: str(x)[:size]
        runs, before = [], False
        for s in siblings(level, at):
            own = [m for m in rows if same(m) == same(s)]
            if len(own) > limit and level != "hour":
                split(below[level], s, own, f"{parents}{s.strftime(form).zfill(4 if level == 'year' else 2)}/")
                before = False
                continue
            if before and len(runs[-1][1]) + len(own) <= limit:
                runs[-1][0].append(s)
                runs[-1][1].extend(own)
            else:
                runs.append(([s], list(own)))
            before = True
        for members, own in runs:
            if own:
                ends = [m.strftime(form).zfill(4 if level == "year" else 2) for m in (members[0], members[-1])]
                out.append((f"{parents}{ends[0]}-{ends[1]}", set(own)))

    if moments:
        split("year", None, moments, "")
    return out


def plain(rows, limit):
    """{(leaf, part): rows}."""
    with_moment = [(moment(r[1], r[0]), r) for r in rows]
    found = plain_leaves([m for m, _ in with_moment if m], limit)
    leaf_of = {m: name for name, own in found for m in own}
    by_leaf = {}
    for m, r in with_moment:
        by_leaf.setdefault(leaf_of[m] if m else "null", []).append((m, r))
    first = lambda x: (x is not None, x or 0)
    out = {}
    for name, own in by_leaf.items():
        own.sort(key=lambda x: (x[0] or dt.datetime.min, x[1][2] is not None, x[1][2] or dt.datetime.min, first(x[1][0])))
        for i in range(0, len(own), limit):
            out[name, i // limit + 1] = [r for _, r in own[i : i + limit]]
    return out


def clicks(n, seed=3, hot=0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        ts = dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rng.randrange(120 * 86400), microseconds=rng.randrange(10**6))
        if i < hot:
            ts = dt.datetime(2024, 2, 7, 5) + dt.timedelta(seconds=rng.randrange(30))
        late = dt.timedelta(seconds=rng.choice([1, 2, 60, 86400 * 30 if rng.random() < 0.1 else 3]))
        out.append((i, None if rng.random() < 0.02 else ts, ts.replace(microsecond=0) + late, rng.randrange(9), rng.choice(["view", None])))
    out += rng.sample(out, n // 20)
    return out


def ids_sha(rows):
    return hashlib.sha256(",".join("" if r[0] is None else str(r[0]) for r in rows).encode()).hexdigest()


@pytest.mark.parametrize("n, hot, share", [(500, 0, 100), (900, 300, 30), (40, 0, 650), (300, 240, 15)])
def test_against_plain(spark, n, hot, share):
    rows = clicks(n, hot=hot)
    got = tp.click_partitions(spark.createDataFrame(rows, SCHEMA).repartition(4), share).collect()
    limit = 1 + len(rows) // share
    before, want = plain([r for r in rows if r[2] < CUT], limit), plain(rows, limit)
    assert {(r.leaf, r.part): (r.n_rows, r.ids_sha256) for r in got} == {k: (len(v), ids_sha(v)) for k, v in want.items()}
    key = lambda v: sorted(map(str, v))
    for r in got:
        own = want[r.leaf, r.part]
        assert r.n_new == sum(x[2] >= CUT for x in own)
        stays = (r.leaf, r.part) in before and key(before[r.leaf, r.part]) == key(own)
        assert r.rewritten == (not stays)
        assert r.columns == "click_id,ts,arrived_at,client_id,kind"
    assert any(r.rewritten for r in got)
    folder = {r.path.rpartition("/clicks-")[0] + "/clicks-" + r.path.rpartition("/clicks-")[2].partition("/")[0] for r in got}
    assert len(folder) == 1
    import pathlib

    files = sorted(str(p) for p in pathlib.Path(folder.pop().removeprefix("file://")).rglob("*") if p.is_file() and not p.name.endswith(".crc"))
    assert files == sorted(r.path.removeprefix("file://") for r in got)
    r = got[0]
    assert ids_sha(zip(pq.ParquetFile(r.path.removeprefix("file://")).read()["click_id"].to_pylist())) == r.ids_sha256


def test_some_files_stay_when_a_leaf_grows(spark):
    """A hot hour whose new rows come last keeps its first parts."""
    rows = [(10**6 + i, dt.datetime(2024, 2, 7, 5, 0, i % 50), dt.datetime(2024, 2, 7, 6), 1, "x") for i in range(400)]
    rows = [r for r in rows if 16 <= zlib.crc32(str(r[0]).encode()) % 128 <= 111]
    new = [(2 * 10**6 + i, dt.datetime(2024, 2, 7, 5, 59), dt.datetime(2024, 3, 2), 1, "x") for i in range(60)]
    new = [r for r in new if 16 <= zlib.crc32(str(r[0]).encode()) % 128 <= 111]
    got = tp.click_partitions(spark.createDataFrame(rows + new, SCHEMA).repartition(3), 10).collect()
    limit = 1 + len(rows + new) // 10
    stay = {r.part for r in got if not r.rewritten}
    assert stay == set(range(1, len(rows) // limit + 1)) and {r.leaf for r in got} == {"2024/02/07/05-05"}


def test_odd_tables(spark):
    assert tp.click_partitions(spark.createDataFrame([], SCHEMA)).collect() == []
    odd = [(None, None, None, None, None)] * 3 + [(None, dt.datetime(2024, 1, 1), None, None, None), (5, None, dt.datetime(2024, 1, 1), 1, "k")]
    got = tp.click_partitions(spark.createDataFrame(odd, SCHEMA), 2).collect()
    assert sorted((r.leaf, r.part, r.n_rows, r.n_new) for r in got) == [("2024-2024", 1, 1, 1), ("null", 1, 3, 3), ("null", 2, 1, 0)]
    before = spark.conf.get("spark.sql.caseSensitive")
    more = spark.createDataFrame(odd, SCHEMA).withColumns({"_us": F.lit(1), "_file": F.lit("x"), "n": F.lit(2), "place": F.lit("p")})
    spark.conf.set("spark.sql.caseSensitive", "true")
    more = more.withColumn("TS", F.lit(7))
    spark.conf.set("spark.sql.caseSensitive", before)
    got = tp.click_partitions(more, 2).collect()
    assert sum(r.n_rows for r in got) == 5 and {r.columns for r in got} == {"click_id,ts,arrived_at,client_id,kind,_us,_file,n,place,TS"}
    assert spark.conf.get("spark.sql.caseSensitive") == before


def test_moments_need_no_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    times = [dt.datetime(2024, 3, 31, 2, 30, 0, 123456), dt.datetime(1600, 2, 29, 23, 59, 59, 999999), dt.datetime(9999, 12, 31, 23, 0), dt.datetime(1, 1, 1)]
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        rows = spark.createDataFrame([(t,) for t in times], "ts timestamp_ntz").select(tp.microseconds(F.col("ts")).alias("us"))
        got = rows.select("us", *(c.alias(k) for k, c in tp.node_keys(F.col("us")).items())).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    for t, r in zip(times, got):
        assert r.us == (t - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)
        day = (t.year * 12 + t.month - 1) * 31 + t.day - 1
        assert (r.year, r.month, r.day, r.hour) == (t.year, t.year * 12 + t.month - 1, day, day * 24 + t.hour)
