"""SimHash near-duplicates: pigeonhole blocks over 64-bit fingerprints, verified by Hamming distance.

The fingerprint of a text sums the bits of the XXH64 hashes (seed 42) of its word shingles. Two fingerprints that differ
in at most `distance` bits agree in at least `blocks - distance` of `blocks` blocks, and so in one of the combinations of
that many blocks. Distinct fingerprints are joined on all combinations; inside a group, pairs are compared in blocks of
rows and only a forest of links leaves the task. A large group is cut again by the pigeonhole principle over its bytes,
which loses no link and takes far fewer comparisons than all its pairs.

Defined cases: a null text counts as empty, an empty one has fingerprint zero; equal texts have equal fingerprints and so
one class; a null doc_id never becomes a class id unless its class has no other; an empty table gives an empty table; other
columns are carried along by keep_one() as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEY, Scratch, byte_values, keyed, lean, numbered, slices, wider
from .components import connected_components, star_labels

SEED = 42
#: Rows of a group that are compared with each other; a larger group is cut by its bytes first.
DENSE = 4096
#: Shingles whose bits are summed at once.
CHUNK = 1 << 20
#: Fingerprints of more than this part of all rows are joined by a broadcast.
SHARE = 1000


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Bits that are set in more than half of the hashes of the lower-cased text's shingles, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    if len(words) > shingle:
        begins = np.concatenate([[0], ends[: len(words) - shingle] + 1]).tolist()
        stops = ends[shingle - 1 :].tolist()
    else:
        begins, stops = [0], [len(joined)]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for i in range(0, len(begins), CHUNK):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(begins[i : i + CHUNK], stops[i : i + CHUNK], strict=True)], ">u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(begins)).view(">u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """Replaces the text by its fingerprint (long, the 64 bits as signed)."""
    kept = [c for c in docs.columns if c not in ("text", "fingerprint")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            bits = np.array([fingerprint(x, shingle) for x in byte_values(batch.column("text"))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(bits)], [*kept, "fingerprint"])

    return docs.select(*kept, "text").mapInArrow(lean(run), wider(docs.select(*kept), "fingerprint long"))


def masks(blocks: int, distance: int) -> list[int]:
    """Bit masks of all combinations of blocks that a close pair can share."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(x) for x in combinations(parts, blocks - distance)]


def _pairs(values: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning set of the close pairs of a group, as positions."""
    if len(values) > DENSE:
        return _cut(values, distance)
    found_a, found_b = [], []
    for i in range(0, len(values), 256):
        near = np.bitwise_count(values[i : i + 256, None] ^ values[None, i:]) <= distance
        a, b = np.nonzero(near)
        up = a < b
        found_a.append(a[up] + i)
        found_b.append(b[up] + i)
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    label = star_labels(a, b, len(values))
    at = np.nonzero(label != np.arange(len(values)))[0]
    return at, label[at]


def _cut(values: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """As _pairs, over the sub-groups that share one of the widest runs of bits in which the group differs."""
    varying = int(np.bitwise_or.reduce(values) ^ np.bitwise_and.reduce(values))
    bits = [i for i in range(64) if varying >> i & 1]
    found_a, found_b = [], []
    for part in range(distance + 1):
        mask = np.uint64(sum(1 << i for i in bits[part :: distance + 1]))
        order = np.argsort(values & mask, kind="stable")
        cuts = np.nonzero(np.diff(values[order] & mask))[0] + 1
        for group in np.split(order, cuts):
            if len(group) < 2:
                continue
            if len(group) == len(values):  # nothing differs here: the other parts hold the differences
                a, b = _dense(values, distance)
            else:
                a, b = _pairs(values[group], distance)
            found_a.append(group[a])
            found_b.append(group[b])
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found_a, found_b))
    label = star_labels(a, b, len(values))
    at = np.nonzero(label != np.arange(len(values)))[0]
    return at, label[at]


def _dense(values: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """All rows against all, in blocks, for a group that can't be cut."""
    label = np.arange(len(values))
    for i in range(0, len(values), DENSE):
        for j in range(i, len(values), DENSE):
            a, b = np.nonzero(np.bitwise_count(values[i : i + DENSE, None] ^ values[None, j : j + DENSE]) <= distance)
            a, b = np.concatenate([label[a + i], np.arange(len(values))]), np.concatenate([label[b + j], label])
            label = star_labels(a, b, len(values))
    at = np.nonzero(label != np.arange(len(values)))[0]
    return at, label[at]


def group_links(keys: np.ndarray, values: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between values (distinct inside a group) of equal keys; keys are sorted."""
    cuts = np.concatenate([[0], np.nonzero(np.diff(keys))[0] + 1, [len(keys)]])
    sizes = np.diff(cuts)
    found_a, found_b = [], []
    small = np.repeat(sizes, sizes) <= 32
    for shift in range(1, min(32, int(sizes.max(initial=0)))):  # small groups all at once
        same = (keys[shift:] == keys[:-shift]) & small[shift:]
        at = np.nonzero(same & (np.bitwise_count(values[shift:] ^ values[:-shift]) <= distance))[0]
        found_a.append(values[at])
        found_b.append(values[at + shift])
    for g in np.nonzero(sizes > 32)[0]:
        group = values[cuts[g] : cuts[g + 1]]
        a, b = _pairs(group, distance)
        found_a.append(group[a])
        found_b.append(group[b])
    a, b = (np.concatenate([*x, np.zeros(0, np.uint64)]) for x in (found_a, found_b))
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = star_labels(at[: len(a)], at[len(a) :], len(nodes))
    keep = label != np.arange(len(nodes))
    return nodes[keep], nodes[label[keep]]


def close_links(distinct: DataFrame, distance: int = 3, blocks: int = 6) -> DataFrame:
    """Links (a, b) that span what distinct fingerprints form at `distance` bits or fewer."""
    tables = [F.struct(F.lit(i).alias("t"), F.col("fingerprint").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("bits")) for i, m in enumerate(masks(blocks, distance))]
    keyed = distinct.select("fingerprint", F.explode(F.array(*tables)).alias("k")).select(F.xxhash64("k.t", "k.bits").alias("key"), "fingerprint")
    keyed = keyed.repartition("key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k, held_v = [], []
        for batch in batches:
            keys, values = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            last = np.searchsorted(keys, keys[-1]) if len(keys) else 0
            if not len(keys):
                continue
            if last or (held_k and held_k[-1][-1] != keys[0]):
                # What is before the last key is whole; if the batch is of one key, all that was held is.
                k, v = np.concatenate([*held_k, keys[:last]]), np.concatenate([*held_v, values[:last]])
                held_k, held_v = [], []
                yield out(k, v)
            held_k.append(keys[last:])
            held_v.append(values[last:])
        if held_k:
            yield out(np.concatenate(held_k), np.concatenate(held_v))

    def out(keys: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
        a, b = group_links(keys, values, distance)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return keyed.mapInArrow(lean(run), "a long, b long")


def _roots(distinct: DataFrame, distance: int, scratch: Scratch) -> DataFrame:
    """distinct (fingerprint and others) with the root of each fingerprint's class."""
    found = connected_components(close_links(distinct, distance), scratch).select(F.col("node").alias("fingerprint"), "root")
    return distinct.join(found, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))


def classes(docs: DataFrame, distance: int = 3, shingle: int = 3) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (long) and component_id, the smallest doc_id reachable by links."""
    scratch = Scratch(docs.sparkSession)
    marked = scratch.save(fingerprints(docs.select("doc_id", "text"), shingle))
    distinct = marked.groupBy("fingerprint").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    found = _roots(distinct, distance, scratch)
    # A class's smallest doc_id by its root, then each fingerprint's class, then each row's.
    lowest = found.groupBy("root").agg(F.min("first").alias("component_id"))
    named = scratch.save(found.join(lowest, "root").select("fingerprint", "component_id", "n"))
    # Fewer than SHARE fingerprints can have more than that part of all rows: those may be broadcast.
    often = F.col("n") * SHARE > marked.count()
    hot = F.broadcast(named.where(often).drop("n"))
    rest = marked.join(hot, "fingerprint", "left_anti").join(named.where(~often).drop("n"), "fingerprint")
    return marked.join(hot, "fingerprint").unionByName(rest).select("doc_id", "fingerprint", "component_id")


def keep_one(docs: DataFrame, distance: int = 3, shingle: int = 3) -> DataFrame:
    """One row of docs of each class: that of the smallest doc_id."""
    scratch = Scratch(docs.sparkSession)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *KEY)).alias("best")
    # Copies go before anything is joined: a fingerprint is one row from here on.
    distinct = scratch.save(fingerprints(keyed(docs.select("doc_id", "text")), shingle).groupBy("fingerprint").agg(first))
    best = _roots(distinct, distance, scratch).groupBy("root").agg(F.min("best").alias("best"))
    rows = keyed(docs).join(best.select(*[f"best.{k}" for k in KEY]), KEY, "left_semi")
    return numbered(rows).where("_weft_nth = 1").select(*docs.columns)


def hex_fingerprint(classed: DataFrame) -> DataFrame:
    return classed.withColumn("fingerprint", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")))
