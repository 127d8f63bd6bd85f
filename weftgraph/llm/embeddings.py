"""Embedding near-duplicates: p-stable hashing for Euclidean distance, then exact cosines.

Normalised vectors are projected onto Gaussian directions, shifted, and quantised by a width; `projections` such numbers
make a bucket of one of `tables` tables. Equal vectors of a label are one class with a weight. Buckets with one class are
dropped before any vector moves. Inside a bucket, cosines are computed in blocks; a pair counts in the first table that
it shares, so that counts over all tables hold each pair once. Out of a task come a count for each class and a forest of
links, never the pairs. A bucket of more than `BLOCK` classes is dealt as pairs of blocks over many tasks.

At a cosine of 0.93 a pair is at most 0.374 apart; the defaults find such a pair with a chance of 0.99, one at 0.97 with
1 - 1e-5.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and those with a null label,
link with nothing and stand alone; a label is of any type; vectors of different lengths have no cosine; equal rows link with each other; a null
vec_id is kept and is a class id only where there is no other; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lean
from .components import connected_components, star_labels

#: Classes of a bucket that one task compares with each other.
BLOCK = 2048


class Hashes:
    """Bucket numbers of vectors, the same in every process."""

    def __init__(self, tables: int, projections: int, width: float, seed: int):
        self.tables, self.projections, self.width, self.seed = tables, projections, width, seed
        self.made: dict[int, tuple] = {}

    def __call__(self, unit: np.ndarray) -> np.ndarray:
        """int64 buckets, one column per table."""
        dim = unit.shape[1]
        if dim not in self.made:
            rng = np.random.default_rng([self.seed, dim])
            n = self.tables * self.projections
            odd = rng.integers(0, 1 << 62, (self.tables, self.projections), dtype=np.int64) * 2 + 1
            self.made[dim] = rng.standard_normal((dim, n)), rng.uniform(0, self.width, n), odd
        directions, shifts, odd = self.made[dim]
        # Float products may differ in their last bits by the number of rows: round well above them.
        cells = np.floor(np.round((unit @ directions + shifts) / self.width, 9)).astype(np.int64).reshape(len(unit), self.tables, self.projections)
        with np.errstate(over="ignore"):
            mixed = (cells * odd).sum(axis=2)
            return mixed ^ (mixed >> np.int64(29))


def _units(lists: pa.Array) -> np.ndarray:
    """Rows of equal length as unit vectors in double precision."""
    rows = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)
    top = np.abs(rows).max(axis=1, keepdims=True)
    rows = rows / top
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _compare(ids: np.ndarray, unit: np.ndarray, keys: np.ndarray, table: np.ndarray, side: np.ndarray | None, weight: np.ndarray, least: float):
    """Counts of linked vectors for each row, and links between rows, of one bucket or pair of blocks."""
    counts, a_all, b_all = np.zeros(len(ids), np.int64), [], []
    for i in range(0, len(ids), 512):
        for j in range(i, len(ids), 512):
            near = unit[i : i + 512] @ unit[j : j + 512].T >= least
            if i == j:
                near = np.triu(near, 1)
            if side is not None:
                near &= side[i : i + 512, None] != side[None, j : j + 512]
            a, b = np.nonzero(near)
            a, b = a + i, b + j
            if len(a):
                first = (keys[a] == keys[b]).argmax(axis=1) == table
                np.add.at(counts, a, weight[b] * first)
                np.add.at(counts, b, weight[a] * first)
                label = star_labels(a, b, len(ids)) if len(a) > len(ids) else None
                if label is not None:
                    a = np.nonzero(label != np.arange(len(ids)))[0]
                    b = label[a]
                a_all.append(a)
                b_all.append(b)
    if not a_all:
        return counts, np.zeros(0, np.int64), np.zeros(0, np.int64)
    label = star_labels(np.concatenate(a_all), np.concatenate(b_all), len(ids))
    at = np.nonzero(label != np.arange(len(ids)))[0]
    return counts, at, label[at]


def classes(vectors: DataFrame, least: float = 0.93, tables: int = 34, projections: int = 10, width: float = 1.6, seed: int = 11) -> DataFrame:
    """One row per row of vectors (vec_id, embedding, label): vec_id, n_links, component_id and kept."""
    scratch, hashes = Scratch(vectors.sparkSession), Hashes(tables, projections, width, seed)
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("label").isNotNull() & e.isNotNull() & finite & F.exists(e, lambda x: x != 0)
    # Labels of any type, by their 64-bit hash.
    rows = vectors.select("vec_id", "embedding", F.xxhash64("label").alias("label"), F.coalesce(usable, F.lit(False)).alias("usable"))
    # A class is a distinct vector of a label; its number is drawn once and written.
    grouped = rows.where("usable").groupBy("label", "embedding").agg(F.count("*").alias("weight"), F.min("vec_id").alias("first"))
    distinct = scratch.save(grouped.withColumn("node", F.monotonically_increasing_id()))

    def hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("embedding")
            dims = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                part = pa.RecordBatch.from_arrays(batch.columns, batch.schema.names).filter(pa.array(dims == dim))
                if not part.num_rows:
                    continue
                keys = hashes(_units(part.column("embedding")))
                label = part.column("label").to_numpy()
                salt = (np.arange(tables, dtype=np.int64) + 1) * np.int64(0x5851F42D4C957F2D)
                with np.errstate(over="ignore"):
                    bucket = (keys * np.int64(0x2545F4914F6CDD1D)) ^ salt ^ ((label[:, None] * 1_000_003 + dim) * np.int64(0x1B873593CC9E2D51))
                n = part.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column("node").to_numpy(), tables)), pa.array(np.tile(np.arange(tables, dtype=np.int32), n)), pa.array(bucket.reshape(-1))], ["node", "t", "bucket"])

    buckets = scratch.save(distinct.select("node", "label", "embedding").mapInArrow(lean(hash_rows), "node long, t int, bucket long"))
    shared = buckets.groupBy("t", "bucket").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = buckets.join(shared, ["t", "bucket"]).withColumn("blocks", blocks).withColumn("own", own)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = dealt.select("node", "t", "bucket", "own", other.alias("other"))
    dealt = dealt.select("node", "t", F.xxhash64("t", "bucket", F.least("own", "other"), F.greatest("own", "other")).alias("work"), F.col("own").cast("long").alias("own"), (F.col("own") != F.col("other")).alias("cross"))
    work = dealt.join(distinct.select("node", "label", "embedding", "weight"), "node").repartition("work").sortWithinPartitions("work", "label")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            keys = held.column("work").to_numpy()
            last = int(np.searchsorted(keys, keys[-1]))
            if last:
                yield from bucket_links(held.slice(0, last).combine_chunks())
                held = held.slice(last)
        if held is not None and held.num_rows:
            yield from bucket_links(held.combine_chunks())

    def bucket_links(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.combine_chunks()
        work, label = rows.column("work").to_numpy(), rows.column("label").to_numpy()
        dims = pa.compute.list_value_length(rows.column("embedding")).to_numpy()
        order = np.lexsort([dims, label, work])
        cuts = np.nonzero((np.diff(work[order]) != 0) | (np.diff(label[order]) != 0) | (np.diff(dims[order]) != 0))[0] + 1
        nodes, out = rows.column("node").to_numpy(), []
        fields = {k: rows.column(k).to_numpy(zero_copy_only=False) for k in ("t", "own", "cross", "weight")}
        lists = rows.column("embedding").combine_chunks()
        for group in np.split(order, cuts):
            if len(group) < 2:
                continue
            unit = _units(lists.take(pa.array(group)))
            t, side = fields["t"][group[0]], fields["own"][group] if fields["cross"][group[0]] else None
            counts, a, b = _compare(nodes[group], unit, hashes(unit), t, side, fields["weight"][group], least)
            root = np.arange(len(group))
            root[a] = b
            hit = np.nonzero((counts > 0) | (root != np.arange(len(group))) | np.isin(root, b))[0]
            out.append((nodes[group][hit], nodes[group][root[hit]], counts[hit]))
        if out:
            a, b, n = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n)], ["a", "b", "n"])

    found = scratch.save(work.mapInArrow(lean(compare), "a long, b long, n long"))
    links = found.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    roots = connected_components(found.select("a", "b"), scratch)
    named = distinct.join(links, "node", "left").join(roots, "node", "left")
    named = named.select("label", "embedding", "first", "weight", F.coalesce("root", "node").alias("root"), F.coalesce("others", F.lit(0)).alias("others"))
    lowest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = named.join(lowest, "root").select("label", "embedding", (F.col("others") + F.col("weight") - 1).alias("n_links"), "component_id")
    linked = rows.where("usable").join(named, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
