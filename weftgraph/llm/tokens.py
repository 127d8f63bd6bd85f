"""Token ids in a byte-aligned binary form, with ids ranked by frequency and control bytes apart from the data bytes.

An id is stored as its rank by corpus frequency, so that most take one byte. A rank takes one to four little-endian bytes;
four lengths of two bits each share a control byte. Decoding looks the four lengths up in a table of 256 rows and gathers
the bytes with numpy. A row of a file holds one document: its number of ids, its control bytes and its data bytes. Files
are shards in ascending order of doc_id, in shared storage; the rank table lies beside them.

Texts are cut at ASCII white space, which the tokenizer drops and nothing of it crosses. Distinct words of a slice of
texts that are plain (printable ASCII and letters of Latin-1) are lower-cased and split side by side in numpy, as the
tokenizer does; the library encodes each distinct part once for a worker's table, and other words whole. Ids are counted
while they are made.

Defined cases: a null text counts as empty and has the end id alone; rows with equal doc_id stand side by side, ordered
by their ids; a null doc_id comes first; an empty table gives an empty table; a vocabulary with ids above 65,535 is an error.
"""

from __future__ import annotations

import gc
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Index, Runs, Scratch, byte_values, coded_words, lean, slices, word_hashes

END_ID = 2
#: Parts of words, or other words, in a worker's table before it starts anew, and their bytes.
TABLE_WORDS, TABLE_BYTES = 900_000, 30_000_000
#: Bytes of text that are encoded at once.
SLICE_BYTES = 7_000_000
#: Bytes of ids that are packed or read at once: what they become stays in a processor's cache.
BLOCK_BYTES = 500_000
#: Parts that the library gets as one text.
TOGETHER = 500
_WORKERS: dict[str, WordTable] = {}
# How the tokenizer splits a word after lower-casing, for printable ASCII and the letters of Latin-1.
LETTER, DIGIT, MARK = 1, 2, 3
#: What each byte of a plain word belongs to; 0: the word is not plain.
CLASSES = np.zeros(256, np.uint8)
CLASSES[0x21:0x7F] = MARK
CLASSES[ord("0") : ord("9") + 1] = DIGIT
CLASSES[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), 0xC3, *range(0x80, 0xC0)]] = LETTER
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def _following(raw: np.ndarray, at: np.ndarray, first: np.ndarray, said: bytes) -> np.ndarray:
    """Whether the bytes behind places `at` are those, within the same word."""
    out = np.ones(len(at), bool)
    for k, x in enumerate(said, 1):
        out &= (raw[at + k] == x) & ~first[at + k]
    return out


def split_parts(words: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Which of the (not empty) words are plain; of those, the number of parts up to the end of each, and all parts, lower-cased."""
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    ends, begin = ends[1:] - ends[0], int(ends[0])
    raw = np.zeros(ends[-1] + 3, np.uint8)  # what looks ahead finds no word there
    raw[:-3] = np.frombuffer(words.buffers()[2], np.uint8)[begin : begin + ends[-1]]
    first = np.ones(len(raw), bool)
    first[:-3] = False
    first[0] = True
    first[ends[:-1]] = True
    lead, less = np.flatnonzero(raw == 0xC3), np.flatnonzero(raw == ord("<"))
    tail = raw[lead + 1]
    other = (tail < 0x80) | (tail > 0xBF) | (tail == 0x97) | (tail == 0xB7)  # not letters
    kinds = CLASSES[raw]
    bad = np.concatenate([np.flatnonzero(kinds[:-3] == 0), lead[other], less[_following(raw, less, first, b"|")]])
    low = LOWER[raw]
    low[lead[(tail < 0x9F) & ~other] + 1] += 32
    plain = np.ones(len(words), bool)
    if len(bad):
        plain[np.searchsorted(ends, bad, side="right")] = False
        sizes = np.diff(ends, prepend=0)
        keep = np.concatenate([np.repeat(plain, sizes), np.ones(3, bool)])
        low, kinds, first, ends = low[keep], kinds[keep], first[keep], np.cumsum(sizes[plain])
    starts = first.copy()
    starts[1:] |= kinds[1:] != kinds[:-1]
    starts |= kinds == DIGIT
    at = np.flatnonzero((low == ord("'")) & starts)
    for said in (b"s", b"t", b"m", b"d", b"re", b"ve", b"ll"):
        short = at[_following(low, at, first, said)]
        starts[short + 1] = False
        starts[short + 1 + len(said)] = True
    size = len(low) - 3
    starts = starts[:size]
    offsets = np.append(np.flatnonzero(starts), size).astype(np.int32)
    parts = pa.Array.from_buffers(pa.string(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(low[:size]))])
    return plain, np.cumsum(starts)[ends - 1], parts


class WordTable:
    """Ids of the parts of plain words, and of other words."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        gc.disable()  # tables of bytes and numbers hold no cycles, and a worker makes millions of them
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # The same model for parts, which need no lower-casing and are split already.
        steps = [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
        with_splits = json.loads(self.tokenizer.to_str())
        self.of_parts = Tokenizer.from_str(json.dumps(with_splits | {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": steps}}))
        vocabulary = self.tokenizer.get_vocab()
        if max(vocabulary.values()) >= 1 << 16:
            raise ValueError("ids above 65,535 don't fit the files")
        ends = [i for x, i in vocabulary.items() if x.endswith("</w>")]
        self.ends = np.zeros(1 << 16, bool)
        self.ends[ends] = True
        self.clear()
        self.clear_parts()

    def clear(self) -> None:
        self.words, self.runs, self.bytes = Index(), Runs(np.uint16), 0

    def clear_parts(self) -> None:
        self.parts, self.part_runs = pa.array([], pa.string()), Runs(np.uint16)
        self.keys, self.places = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # sorted hashes of parts, and whose they are

    def _part_runs(self, parts: pa.Array) -> np.ndarray:
        """The run of each part; new ones are encoded."""
        coded = parts.dictionary_encode()
        keys = word_hashes(coded.dictionary)
        order = np.argsort(keys)
        found, missing = np.zeros(len(keys), np.int64), np.ones(len(keys), bool)
        if len(self.keys):
            near = np.minimum(np.searchsorted(self.keys, keys[order]), len(self.keys) - 1)
            like = self.keys[near] == keys[order]
            at, near = order[like], self.places[near[like]]
            same = pc.equal(self.parts.take(pa.array(near)), coded.dictionary.take(pa.array(at))).to_numpy(zero_copy_only=False)
            found[at[same]], missing[at[same]] = near[same], False
        if missing.any():
            new = coded.dictionary.filter(pa.array(missing))
            found[missing] = len(self.parts) + np.arange(len(new))
            more = order[missing[order]]
            where = np.searchsorted(self.keys, keys[more])
            self.keys, self.places = np.insert(self.keys, where, keys[more]), np.insert(self.places, where, found[more])
            fresh = new.to_pylist()
            texts = [" ".join(fresh[j : j + TOGETHER]) for j in range(0, len(fresh), TOGETHER)]
            said = np.concatenate([np.array(x.ids, np.uint16) for x in self.of_parts.encode_batch_fast(texts, add_special_tokens=False)])
            stops = np.flatnonzero(self.ends[said]) + 1  # a part ends where a token does that ends a word
            assert len(stops) == len(fresh) and stops[-1] == len(said)
            self.parts = pa.concat_arrays([self.parts, new])
            self.part_runs.add(said, np.diff(stops, prepend=0))
        return found[coded.indices.to_numpy()]

    def _other_runs(self, words: list[bytes]) -> np.ndarray:
        """The run of each word that is not plain; new ones are encoded."""
        at = self.words.of([words])
        if new := self.words.new:
            self.words.new = []
            self.bytes += sum(map(len, new))
            found = [x.ids for x in self.tokenizer.encode_batch_fast([x.decode() for x in new], add_special_tokens=False)]
            self.runs.add(np.array([y for x in found for y in x], np.uint16), np.array([len(x) for x in found], np.int64))
        return at

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids, end id included, and all ids."""
        if not len(texts):
            return np.zeros(0, np.int64), np.zeros(0, np.uint16)
        if len(self.words) > TABLE_WORDS or self.bytes > TABLE_BYTES:
            self.clear()
        if len(self.parts) > TABLE_WORDS or self.parts.nbytes > TABLE_BYTES:
            self.clear_parts()
        n, codes, distinct = coded_words(texts)
        lens = np.ones(len(distinct) + 1, np.int64)  # the last one stands for the end of a document
        starts = np.zeros(len(distinct) + 1, np.int64)
        ids = np.array([END_ID], np.uint16)
        if len(distinct):
            plain, counts, parts = split_parts(distinct)
            for which, runs, at, stops in (
                (plain, self.part_runs, self._part_runs(parts) if len(parts) else None, counts - 1),
                (~plain, self.runs, self._other_runs(byte_values(distinct.filter(pa.array(~plain)))) if not plain.all() else None, slice(None)),
            ):
                if at is None:
                    continue
                more, ends = runs.join(at)
                which = np.flatnonzero(which)
                lens[which] = np.diff(ends[stops], prepend=0)
                starts[which] = len(ids) + ends[stops] - lens[which]
                ids = np.concatenate([ids, more])
        table = Runs(np.uint16)
        table.ids, table.starts, table.lens = ids, starts, lens
        ids, ends = table.join(np.insert(codes, np.cumsum(n), len(distinct)))
        return np.diff(ends[np.cumsum(n + 1) - 1], prepend=0), ids


def pack(ranks: np.ndarray, counts: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """Control and data bytes of each document; counts: numbers of ranks."""
    size = np.ones(len(ranks), np.uint8)
    for most in (0xFF, 0xFFFF, 0xFFFFFF):
        if (more := ranks > most).any():
            size += more
    wide = _width(size)
    data = np.ascontiguousarray(ranks, f"<u{wide}").view(np.uint8)[_kept(size, wide)].tobytes()
    stops = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])[np.concatenate([[0], np.cumsum(counts)])].tolist()
    real, first = _fields(counts)
    lengths = np.zeros(len(real), np.uint8)
    lengths[real] = size - 1
    four = lengths.view("<u4")
    control = (four | four >> 6 | four >> 12 | four >> 18).astype(np.uint8).tobytes()
    first = first.tolist()
    return [control[a:b] for a, b in zip(first, first[1:], strict=False)], [data[a:b] for a, b in zip(stops, stops[1:], strict=False)]


def _width(size: np.ndarray) -> int:
    """Bytes of the numbers in which ranks of these sizes have room."""
    most = int(size.max(initial=1))
    return 4 if most == 3 else most


def _kept(size: np.ndarray, wide: int) -> np.ndarray:
    """Which bytes of numbers of `wide` bytes are stored."""
    keep = np.ones(len(size) * wide, bool)
    for k in range(1, wide):
        keep[k::wide] = size > k
    return keep


def _fields(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which two-bit fields hold a rank, and the first control byte of each document: each begins with a new byte."""
    first = np.concatenate([[0], np.cumsum(-(-counts // 4))])
    real = np.ones(first[-1] * 4, bool)
    for k in range(1, 4):  # a document leaves up to three fields of its last byte
        real[first[1:][-counts % 4 >= k] * 4 - k] = False
    return real, first


#: Row c holds the four lengths that control byte c stands for.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1).astype(np.uint8)


def unpack(control: list[bytes], data: list[bytes], counts: np.ndarray) -> np.ndarray:
    """The ranks of documents, one behind the other."""
    lengths = LENGTHS[np.frombuffer(b"".join(control), np.uint8)].reshape(-1)[_fields(counts)[0]]
    wide = _width(lengths)
    raw = np.zeros(len(lengths) * wide, np.uint8)
    raw[_kept(lengths, wide)] = np.frombuffer(b"".join(data), np.uint8)
    return raw.view(f"<u{wide}").astype(np.uint32, copy=False)


def _rank_table(counts: DataFrame) -> list[int]:
    """Ids by falling frequency, ties by id. At most as many rows as the vocabulary has go to the driver."""
    found = counts.groupBy("id").agg(F.sum("n").alias("n")).collect()
    return [r["id"] for r in sorted(found, key=lambda r: (-r["n"], r["id"]))]


def write_ids(docs: DataFrame, tokenizer: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Writes the files; returns them as (shard, nth, doc_id, n_tokens, control, data), and the rank table (rank, id)."""
    spark = docs.sparkSession

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _WORKERS:
            _WORKERS[tokenizer] = WordTable(tokenizer)
        total = np.zeros(1 << 16, np.int64)
        for batch in slices(batches, "text", SLICE_BYTES):
            n, ids = _WORKERS[tokenizer].encode(batch.column("text"))
            total += np.bincount(ids, minlength=1 << 16)
            raw, stops = ids.astype("<u2").tobytes(), (2 * np.concatenate([[0], np.cumsum(n)])).tolist()
            none = pa.nulls(len(n), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([raw[a:b] for a, b in zip(stops, stops[1:], strict=False)], pa.binary()), none, none], ["doc_id", "ids", "id", "n"])
        at = np.flatnonzero(total)  # rows of their own: how often the task made each id
        yield pa.RecordBatch.from_arrays([pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.binary()), pa.array(at), pa.array(total[at])], ["doc_id", "ids", "id", "n"])

    made = scratch.save(docs.select("doc_id", "text").mapInArrow(encode, "doc_id long, ids binary, id long, n long"), compression="zstd")
    ids = made.where("id IS NULL").select("doc_id", "ids")
    ranked = _rank_table(made.where("id IS NOT NULL").select("id", "n"))
    rank_of = np.zeros(1 << 16, np.uint16)
    rank_of[ranked] = np.arange(len(ranked))
    shared = spark.sparkContext.broadcast(rank_of)  # 128 kB at any size of the corpus

    def to_ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nth = 0
        for batch in slices(batches, "ids", BLOCK_BYTES):
            raw = batch.column("ids").to_pylist()
            counts = np.array([len(x) // 2 for x in raw], np.int64)
            control, data = pack(shared.value[np.frombuffer(b"".join(raw), "<u2")], counts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("shard"), pa.array(np.arange(nth, nth + len(raw))), batch.column("doc_id"), pa.array(counts), pa.array(control, pa.binary()), pa.array(data, pa.binary())],
                ["shard", "nth", "doc_id", "n_tokens", "control", "data"],
            )
            nth += len(raw)

    ordered = ids.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids").withColumn("shard", F.spark_partition_id())
    files = scratch.save(ordered.select("shard", "doc_id", "ids").mapInArrow(lean(to_ranks), "shard int, nth long, doc_id long, n_tokens long, control binary, data binary"), compression="uncompressed")
    scratch.drop(made)
    ranks = scratch.save(spark.createDataFrame(list(enumerate(ranked)), "rank int, id long"))
    return files, ranks


def read_ids(files: DataFrame, ranks: DataFrame) -> DataFrame:
    """doc_id, n_tokens, start and ids_crc32 of each document, from the files."""
    spark: SparkSession = files.sparkSession
    table = np.array([r["id"] for r in ranks.orderBy("rank").collect()], "<u4")
    shared = spark.sparkContext.broadcast(table)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "data", BLOCK_BYTES):
            counts = batch.column("n_tokens").to_numpy()
            raw = memoryview(shared.value[unpack(batch.column("control").to_pylist(), batch.column("data").to_pylist(), counts)].tobytes())
            stops = (4 * np.concatenate([[0], np.cumsum(counts)])).tolist()
            sums = [zlib.crc32(raw[a:b]) for a, b in zip(stops, stops[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("shard", "nth", "doc_id", "n_tokens")], pa.array(sums, pa.int64())], ["shard", "nth", "doc_id", "n_tokens", "ids_crc32"])

    read = files.mapInArrow(lean(decode), "shard int, nth long, doc_id long, n_tokens long, ids_crc32 long")
    # A row per shard, and the shards are as many as the writing job had tasks.
    per_shard = files.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    per_shard = per_shard.select("shard", (F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    inside = Window.partitionBy("shard").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    started = read.withColumn("inside", F.sum("n_tokens").over(inside) - F.col("n_tokens")).join(per_shard, "shard")
    return started.select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
