"""Column functions over vectors (arrays of numbers); sums are in double precision."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body of a value that is computed once; an expression within a lambda would be computed for each element."""
    return F.transform(F.array(value), body)[0]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Column, least: float = 1e-12) -> Column:
    """a divided by its length, or by least if that is shorter."""
    return let(a, lambda v: let(F.greatest(norm(v), F.lit(least)), lambda n: F.transform(v, lambda x: x.cast("double") / n)))


MOST_KEYS = 4096  # keys whose sums a task holds before it sends them on


def _partial(keys: list[str], vector: str):
    """Arrow batches to a row a key: its vectors' sum and number, as far as a task has seen them."""

    def flushed(held, schema):
        columns = [pa.array([k[i] for k in held], schema.field(name).type) for i, name in enumerate(keys)]
        sums, counts = [s for s, _ in held.values()], [n for _, n in held.values()]
        return pa.RecordBatch.from_arrays([*columns, pa.array(sums, pa.list_(pa.float64())), pa.array(counts, pa.int64())], [*keys, "_sum", "_n"])

    def run(batches):
        held, schema = {}, None
        for batch in batches:
            schema = batch.schema
            batch = batch.filter(pc.is_valid(batch.column(vector)))
            if not batch.num_rows:
                continue
            lists = batch.column(vector)
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
            names = list(zip(*(batch.column(k).to_pylist() for k in keys)))
            place = {k: i for i, k in enumerate(dict.fromkeys(names))}
            code = np.fromiter((place[k] for k in names), int, len(names))
            order = np.argsort(code, kind="stable")
            edges = np.searchsorted(code[order], np.arange(len(place)))
            sums, counts = np.add.reduceat(values[order], edges), np.diff(np.append(edges, len(code)))
            for k, i in place.items():
                old, n = held.get(k, (0.0, 0))
                held[k] = sums[i] + old, int(counts[i]) + n
            if len(held) > MOST_KEYS:
                yield flushed(held, schema)
                held = {}
        if held:
            yield flushed(held, schema)

    return run


def _merged(keys: list[str], out: str):
    def run(table: pa.Table) -> pa.Table:
        rows = table.combine_chunks()
        sums = np.add.reduce([np.asarray(x, float) for x in rows["_sum"].to_pylist()])
        return pa.table([*(rows[k].slice(0, 1) for k in keys), pa.array([(sums / pc.sum(rows["_n"]).as_py()).tolist()], pa.list_(pa.float64()))], names=[*keys, out])

    return run


def mean_vector(rows, keys: list[str], vector: str, out: str = "centroid"):
    """The mean of vectors of one length by key; null vectors don't count.

    Each task adds up whole vectors, so a row a key and task is shuffled, whatever the vectors' length or a key's share."""
    kinds = [f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys]
    part = rows.select(*keys, vector).mapInArrow(_partial(keys, vector), ", ".join([*kinds, "_sum array<double>", "_n bigint"]))
    return part.groupBy(*keys).applyInArrow(_merged(keys, out), ", ".join([*kinds, f"{out} array<double>"]))
