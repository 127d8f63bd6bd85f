"""Line dedup by an exact set-similarity join: rarity-ordered prefixes with length, positional and parity filters.

A line is the set of its lower-cased words. Lines of equal sets form a class; its first line is the one of the smallest
(doc_id, line number). A line is removed if it isn't the first of its class, or if the Jaccard similarity of its class to
one that begins earlier is `4/5` or more, whether that one is removed itself or not. Blank lines stay.

How it works. One pass over the texts writes blocks: local vocabularies of 64-bit word hashes, sets as local numbers, and
for each set a sum of hashes and a parity signature, which together are its class. Document frequencies of words are
summed into a table of fixed size, so that rarity is one byte per slot, broadcast at 16 MB. Any order that is the same
everywhere gives exact results; this one puts words that few lines have first. Of each class, a block sends the words of
the first line's prefix, without those that occur once; a task packs what it sends to one bucket of words into one value.
Inside a word's group, a set proposes the PROPOSALS earliest sets that pass the filters. Proposals are verified on whole
sets. Where all of a set's proposals fail and it could have made more, it alone goes through those groups again, with a
wider parity signature and a higher bound, at last with none, so that nothing is lost. In a group of near copies most sets
are settled by the earliest, so that pairs do not grow with the square of a group.

Hot words. Words that about HOT lines or more have do not form groups of their own. Two similar sets share two words among
their prefixes and one word behind them, so that a set sends the pairs of hot words there instead, the first of a pair
being in the prefix. Sets of more than LONG words, which could have very many such pairs, send single words, and those
that may be similar to one send both.

Defined cases: a null text counts as empty and has no lines; a null doc_id sorts before all others; of equal rows one
counts as the earlier; a line is used whole at any length; an empty table gives an empty table; other columns are carried
along by dedupe() as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEY, Scratch, attached, byte_values, coded_words, keyed, lean, packed, slices, unpacked, word_hashes

#: log2 of the slots of the frequency table, and of the bits of the candidates' bitmap.
SLOTS, BITS = 24, 26
DENSE, PROPOSALS = 64, 1
#: Lines that have a hot word, about, and words of a set that sends hot words one by one.
HOT, LONG = 1 << 16, 320
IS_HOT = 128
#: Bytes of text in a block: a larger one repeats fewer words in its vocabulary.
SLICE_BYTES = 8_000_000
#: A set in more pairs than OFTEN, and than that SHARE of all pairs, has them dealt to SALTS tasks.
OFTEN, SHARE, SALTS = 512, 1000, 64
#: Bounds of the later rounds.
LATER = (1024, 1 << 40)
NO_ID = -(1 << 63)
#: Columns of a block, stored by byte planes but for hashes; tokens as differences, as they ascend inside a line.
_KINDS = dict(vocabulary="u8", frequency="i4", token="i4", size="i4", k1="i8", k2="i8", line_doc="i4", line_no="i4", doc_id="i8", key="i8", more="i8", n_lines="i4", first="?")
_PLAIN = {"vocabulary", "k1", "k2", "key", "more", "first"}
_BLOCK = list(_KINDS)


def prefix_length(size: np.ndarray) -> np.ndarray:
    """Of two sets with a Jaccard similarity of 4/5, some common word is among so many of each."""
    return size - (4 * size + 4) // 5 + 1


def least_overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (4 * (a + b) + 8) // 9


def block(texts: pa.Array, doc_ids: np.ndarray, *keys_of_docs: np.ndarray) -> dict[str, np.ndarray]:
    """What later passes need of some documents."""
    cut = pc.split_pattern(pc.ascii_lower(pc.fill_null(texts, "")), "\n")
    n_lines = pc.list_value_length(cut).to_numpy().astype(np.int64)
    n_words, codes, distinct = coded_words(cut.flatten())
    line_doc = np.repeat(np.arange(len(n_lines)), n_lines)
    line_no = np.arange(len(line_doc)) - np.repeat(np.cumsum(n_lines) - n_lines, n_lines)
    blank = n_words == 0
    line_doc, line_no, n_words = line_doc[~blank], line_no[~blank], n_words[~blank]
    n_lines[(pc.binary_length(pc.fill_null(texts, "")).to_numpy() == 0)] = 0
    bits = max(1, len(distinct).bit_length())
    keys = np.sort(np.repeat(np.arange(len(n_words)), n_words) << bits | codes)
    keys = keys[np.diff(keys, prepend=-1) != 0]
    line, token = keys >> bits, keys & (1 << bits) - 1
    vocabulary = word_hashes(distinct)
    size = np.bincount(line, minlength=len(n_words))
    k1, k2 = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    if len(size):
        starts = np.cumsum(size) - size
        mixed = (vocabulary ^ (vocabulary >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        k1 = np.add.reduceat(mixed[token], starts)
        k2 = np.bitwise_xor.reduceat((np.uint64(1) << (vocabulary & np.uint64(63)))[token], starts)
    k1, k2 = k1.view(np.int64), k2.view(np.int64)
    # Whether a line is the first of its class in the block.
    order = np.lexsort([line_doc, line_no, doc_ids[line_doc], k2, k1])
    first = np.ones(len(order), bool)
    first[order[1:]] = (np.diff(k1[order]) != 0) | (np.diff(k2[order]) != 0)
    made = [vocabulary, np.bincount(token, minlength=len(distinct)), token, size, k1, k2, line_doc, line_no, doc_ids, *keys_of_docs, n_lines, first]
    return {k: np.asarray(v).astype(_KINDS[k]) for k, v in zip(_BLOCK, made, strict=True)}


def _stored(name: str, values: np.ndarray) -> bytes:
    if name == "token":
        values = np.diff(values, prepend=np.int32(0))
    return values.tobytes() if name in _PLAIN else packed(values, _KINDS[name])


def _read(name: str, data) -> np.ndarray:
    values = np.frombuffer(data, _KINDS[name]) if name in _PLAIN else unpacked([data], _KINDS[name])
    return np.cumsum(values, dtype=np.int32) if name == "token" else values


def _blocks(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    for batch in batches:
        ids = batch.column("block").to_pylist()
        for i, number in enumerate(ids):
            yield number, {k: _read(k, batch.column(k)[i].as_buffer()) for k in names}


def write_blocks(docs: DataFrame, scratch: Scratch) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 20
        for i, batch in enumerate(slices(batches, "text", SLICE_BYTES)):
            ids = batch.column("doc_id").cast(pa.int64()).fill_null(NO_ID).to_numpy()
            made = block(batch.column("text"), ids, *[batch.column(k).to_numpy() for k in KEY])
            yield pa.RecordBatch.from_arrays([pa.array([base + i]), *[pa.array([_stored(k, made[k])], pa.binary()) for k in _BLOCK]], ["block", *_BLOCK])

    return scratch.save(keyed(docs.select("doc_id", "text")).mapInArrow(lean(run), "block long, " + ", ".join(f"{k} binary" for k in _BLOCK)), compression="zstd")


def _packed(columns: list[np.ndarray], part: np.ndarray, parts: int) -> tuple[np.ndarray, list[pa.Array]]:
    """Columns cut by part: the parts that have rows, and of each column a binary value per part."""
    order = np.argsort(part, kind="stable")
    stops = np.searchsorted(part[order], np.arange(parts + 1))
    used = np.nonzero(np.diff(stops))[0]
    out = []
    for c in columns:
        raw, width = np.ascontiguousarray(c[order]), c.dtype.itemsize
        offsets = np.append(stops[used], len(raw)).astype(np.int32) * width  # parts without rows take no bytes
        out.append(pa.Array.from_buffers(pa.binary(), len(used), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(raw)]))
    return used, out


def levels_of(n: np.ndarray, hot: int = HOT) -> np.ndarray:
    """The steps of rarity: 0 for what occurs once, and from IS_HOT on what occurs `hot` times or more."""
    return (np.minimum(IS_HOT - 1, np.round(4 * np.log2(np.maximum(n, 1)))) + np.where(n >= hot, IS_HOT, 0)).astype(np.uint8)


def rarity(blocks: DataFrame, hot: int = HOT) -> np.ndarray:
    """A byte per slot: 0 for words that one line has, and more for more frequent ones; 2 ** SLOTS bytes are collected."""
    wide = SLOTS - 16  # log2 of the ranges that are summed side by side

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SLOTS, np.uint32)
        for _, x in _blocks(batches, ["vocabulary", "frequency"]):
            np.add.at(total, (x["vocabulary"] >> np.uint64(64 - SLOTS)).astype(np.int64), x["frequency"].astype(np.uint32))
        slots = np.nonzero(total)[0]
        used, packed = _packed([(slots & 0xFFFF).astype(np.uint16), total[slots]], slots >> 16, 1 << wide)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *packed], ["range", "slot", "n"])

    def levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, r in enumerate(batch.column("range").to_pylist()):
                slots, n = (np.frombuffer(batch.column(k)[i].as_buffer(), kind) for k, kind in (("slot", "u2"), ("n", "u4")))
                total.setdefault(r, np.zeros(1 << 16, np.int64))[slots] += n
        found = [levels_of(x, hot).tobytes() for x in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(found, pa.binary())], ["range", "level"])

    counted = blocks.select("block", "vocabulary", "frequency").mapInArrow(lean(count), "range int, slot binary, n binary")
    out = np.zeros(1 << SLOTS, np.uint8)
    for r in counted.repartition("range").mapInArrow(lean(levels), "range int, level binary").collect():
        out[r["range"] << 16 : (r["range"] + 1) << 16] = np.frombuffer(r["level"], np.uint8)
    return out


#: What stands for a key of a line: the upper half of the key's hash, the line's class, and its place in time.
_ROW = dict(word="<u4", k1="<i8", k2="<i8", doc_id="<i8", line_no="<i4", size="<i4", position="<i4")
#: In later rounds also whether it may propose, and a wider parity.
_LATER_ROW = _ROW | dict(asked="?", p0="<u8", p1="<u8", p2="<u8", p3="<u8")
#: Those of whose bytes most are zero.
_SMALL = ["doc_id", "line_no", "size", "position"]
Rows = dict[str, np.ndarray]
#: Rows of a bucket of words, about, and rows that a task packs at once.
BUCKET_ROWS, PACK_ROWS = 300_000, 1_000_000


def _pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def prefixes(x: dict[str, np.ndarray], level: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, line, position) of all that lines are grouped by: prefix words that more than one line has, and pairs of hot ones."""
    words = x["vocabulary"]
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    of_word = level[(words >> np.uint64(64 - SLOTS)).astype(np.int64)]
    order = np.argsort(words)
    order = order[np.argsort(of_word[order], kind="stable")]  # by step, then by word
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    bits = max(1, len(words).bit_length())
    size = x["size"].astype(np.int64)
    keys = np.sort(np.repeat(np.arange(len(size)) << bits, size) | rank[x["token"]])
    n = prefix_length(size)
    taken = np.minimum(n + 1, size)  # the prefix and a word behind it
    line = np.repeat(np.arange(len(size)), taken)
    position = np.arange(len(line)) - np.repeat(np.cumsum(taken) - taken, taken)
    word = order[keys[np.repeat(np.cumsum(size) - size, taken) + position] & (1 << bits) - 1]
    inside, hot = position < np.repeat(n, taken), of_word[word] >= IS_HOT
    single = inside & (of_word[word] > 0) & (~hot | (5 * size[line] > 4 * LONG))
    found = [(words[word[single]], line[single], position[single])]
    at = np.nonzero(hot & (size[line] <= LONG))[0]  # ascending inside a line
    for step in range(1, len(at)):
        a, b = at[:-step], at[step:]
        same = line[a] == line[b]
        if not same.any():
            break
        a, b = a[same & inside[a]], b[same & inside[a]]
        found.append((_pair_keys(words[word[a]], words[word[b]]), line[a], position[a]))
    return tuple(np.concatenate(y) for y in zip(*found, strict=True))


def _parity(x: dict[str, np.ndarray]) -> np.ndarray:
    """256 bits of parity for each line, as four words."""
    out = np.zeros((4, len(x["size"])), np.uint64)
    if len(x["size"]):
        starts = np.cumsum(x["size"].astype(np.int64)) - x["size"]
        bits, quarter = np.uint64(1) << (x["vocabulary"] >> np.uint64(8) & np.uint64(63)), x["vocabulary"] >> np.uint64(14) & np.uint64(3)
        for i in range(4):
            out[i] = np.bitwise_xor.reduceat(np.where(quarter == i, bits, np.uint64(0))[x["token"]], starts)
    return out


def _of_lines(x: dict[str, np.ndarray], keep: np.ndarray) -> dict[str, np.ndarray]:
    """A block with some of its lines only."""
    line = np.repeat(np.arange(len(keep)), x["size"])
    return x | {k: x[k][keep] for k in ("size", "k1", "k2", "line_doc", "line_no", "first") if k in x} | {"token": x["token"][keep[line]]}


def _may_have_marked(x: dict[str, np.ndarray], marked: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Lines that have a marked word, or so many hot ones that their pairs may be marked."""
    if not len(x["size"]):
        return np.zeros(0, bool)
    starts = np.cumsum(x["size"].astype(np.int64)) - x["size"]
    hot = level[(x["vocabulary"] >> np.uint64(64 - SLOTS)).astype(np.int64)] >= IS_HOT
    has_marked = np.add.reduceat(marked[x["token"]].astype(np.int32), starts) > 0
    return has_marked | (np.add.reduceat(~hot[x["token"]], starts, dtype=np.int32) < prefix_length(x["size"]))


def _rows(x: dict[str, np.ndarray], level: np.ndarray, only: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, Rows]:
    """Keys and rows of a block's classes; only: bitmaps of keys, and of the sets that may propose."""
    x = _of_lines(x, x["first"])
    if only is not None:
        x = _of_lines(x, _may_have_marked(x, _marked(only[0], x["vocabulary"]), level))
    key, line, position = prefixes(x, level)
    if only is not None:
        keep = _marked(only[0], key)
        key, line, position = key[keep], line[keep], position[keep]
    out = {k: x[k][line] for k in ("k1", "k2", "size", "line_no")}
    out |= {"word": (key >> np.uint64(32)).astype(np.uint32), "position": position, "doc_id": x["doc_id"][x["line_doc"][line]]}
    if only is not None:
        out["asked"] = _marked(only[1], x["k1"])[line]
        out |= {name: parity[line] for name, parity in zip(("p0", "p1", "p2", "p3"), _parity(x), strict=True)}
    return key, out


def _cell(rows: Rows) -> bytes:
    return b"".join(packed(v, _LATER_ROW[k]) if k in _SMALL else v.astype(_LATER_ROW[k]).tobytes() for k, v in rows.items())


def _uncell(data: bytes, n: int, kinds: dict[str, str]) -> Rows:
    out, at = {}, 0
    for k, kind in kinds.items():
        end = at + n * np.dtype(kind).itemsize
        out[k] = unpacked([data[at:end]], kind) if k in _SMALL else np.frombuffer(data[at:end], kind)
        at = end
    return out


def _join(parts: list[Rows]) -> Rows:
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}


def prefix_rows(blocks: DataFrame, level, only=None) -> DataFrame:
    """(bucket, n, data): a row per bucket of keys and so many rows of a task, packed by byte planes.

    level: a broadcast table; only: broadcast bitmaps, or None for all.
    """
    names = ["vocabulary", "token", "size", "k1", "k2", "line_doc", "line_no", "doc_id", "first"]
    words = blocks.agg(F.sum(F.length("token") / 4)).first()[0] or 0
    buckets = max(8, int(words * 0.2 / BUCKET_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out() -> pa.RecordBatch:
            key, rows = np.concatenate([k for k, _ in held]), _join([r for _, r in held])
            bucket = (key & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)
            order = np.argsort(bucket << np.uint64(32) | key >> np.uint64(32))
            rows = {k: rows[k][order] for k in (_ROW if only is None else _LATER_ROW)}
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
            used = np.nonzero(np.diff(cuts))[0]
            data = [_cell({k: v[a:b] for k, v in rows.items()}) for a, b in zip(cuts[used].tolist(), cuts[used + 1].tolist(), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(np.diff(cuts)[used], pa.int32()), pa.array(data, pa.binary())], ["bucket", "n", "data"])

        for _, x in _blocks(batches, names):
            held.append(_rows(x, level.value, only.value if only is not None else None))
            n += len(held[-1][0])
            if n > PACK_ROWS:
                yield out()
                held, n = [], 0
        if n:
            yield out()

    rows = blocks.select("block", *names).mapInArrow(lean(run), "bucket int, n int, data binary")
    return rows.repartition(buckets, "bucket").sortWithinPartitions("bucket")


def _by_time(rows: Rows) -> np.ndarray:
    """The order by word, doc_id, line_no and class."""
    words, group = np.unique(rows["word"], return_inverse=True)
    low, high = int(rows["doc_id"].min(initial=0)), int(rows["doc_id"].max(initial=0))
    of_doc, of_line = (high - low).bit_length(), int(rows["line_no"].max(initial=0)).bit_length()
    if of_doc + of_line + len(words).bit_length() < 63:
        key = (group.astype(np.int64) << of_doc | rows["doc_id"] - low) << of_line | rows["line_no"]
        order = np.argsort(key)
        if (np.diff(key[order]) != 0).all():
            return order
    return np.lexsort([rows["k2"], rows["k1"], rows["line_no"], rows["doc_id"], rows["word"]])


def _firsts_of_classes(rows: Rows) -> np.ndarray:
    """Whether a row is the first of its class in its group; rows are in order of time in each group."""
    mixed = (rows["word"].astype(np.uint64) << np.uint64(32) | rows["position"].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) ^ rows["k1"].view(np.uint64)
    order = np.argsort(mixed)
    again = np.diff(mixed[order]) == 0
    keep = np.ones(len(mixed), bool)
    if again.any():
        at = np.unique(np.concatenate([np.nonzero(again)[0], np.nonzero(again)[0] + 1]))
        at = np.sort(order[at])  # few rows, in order of time
        few = np.lexsort([at, *[rows[k][at] for k in ("position", "k2", "k1", "word")]])
        same = np.ones(len(at) - 1, bool)
        for k in ("word", "k1", "k2", "position"):
            same &= rows[k][at[few[1:]]] == rows[k][at[few[:-1]]]
        keep[at[few[1:][same]]] = False
    return keep


class _Filters:
    """Whether rows a and b of a group may be similar: parity first, as it settles nearly all, then the others."""

    def __init__(self, rows: Rows):
        self.size, self.position, self.k1, self.k2 = (rows[k] for k in ("size", "position", "k1", "k2"))
        self.parity = [rows[k] for k in ("p0", "p1", "p2", "p3")] if "p0" in rows else [self.k2.view(np.uint64)]
        total = np.arange(2 * int(self.size.max(initial=0)) + 1, dtype=np.int64)
        #: How many words two sets may have that the other hasn't, by the sum of their sizes.
        self.apart = np.minimum(total - 2 * ((4 * total + 8) // 9), 255).astype(np.uint8)

    def likely(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.parity[0][a] ^ self.parity[0][b]) <= self.apart[self.size[a] + self.size[b]]

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For pairs that are likely."""
        size_a, size_b = self.size[a].astype(np.int64), self.size[b].astype(np.int64)
        need = least_overlap(size_a, size_b)
        length = 5 * np.minimum(size_a, size_b) >= 4 * np.maximum(size_a, size_b)
        left = np.minimum(size_a - self.position[a], size_b - self.position[b])
        differing = sum((np.bitwise_count(p[a] ^ p[b]).astype(np.int64) for p in self.parity), np.zeros(len(a), np.int64))
        other = (self.k1[a] != self.k1[b]) | (self.k2[a] != self.k2[b])
        return other & length & (left >= need) & (differing <= size_a + size_b - 2 * need)


def _nth(values: np.ndarray) -> np.ndarray:
    """How many equal values there are up to each, itself included."""
    order = np.argsort(values, kind="stable")
    new = np.append(True, np.diff(values[order]) != 0)
    begin = np.nonzero(new)[0]
    out = np.empty(len(values), np.int64)
    out[order] = np.arange(len(values)) - np.repeat(begin, np.diff(np.append(begin, len(values)))) + 1
    return out


def proposals(rows: Rows, bound: int = PROPOSALS) -> tuple[Rows, Rows, Rows]:
    """(earlier, later, more) as rows: pairs that may be similar, and rows that could have proposed more. Rows are of whole groups."""
    for choose in (_by_time, _firsts_of_classes):
        at = choose(rows)
        rows = {k: v[at] for k, v in rows.items()}
    word, filters = rows["word"], _Filters(rows)
    asked = rows.get("asked", np.ones(len(word), bool))
    cuts = np.concatenate([[0], np.nonzero(np.diff(word))[0] + 1, [len(word)]])
    sizes = np.diff(cuts)
    first = np.repeat(cuts[:-1], sizes)
    made = np.zeros(len(word), np.int64)
    a_all, b_all = [], []
    waiting = np.nonzero(asked & (np.repeat(sizes, sizes) <= DENSE) & (np.arange(len(word)) > first))[0]
    for step in range(DENSE - 1):  # small groups side by side: each row looks at the next earliest row of its group
        waiting = waiting[(first[waiting] + step < waiting) & (made[waiting] <= bound)]
        if not len(waiting):
            break
        a = first[waiting] + step
        likely = np.nonzero(filters.likely(a, waiting))[0]
        likely = likely[filters.near(a[likely], waiting[likely])]
        hit = waiting[likely]
        made[hit] += 1
        take = made[hit] <= bound
        a_all.append(a[likely][take])
        b_all.append(hit[take])
    for g in np.nonzero(sizes > DENSE)[0]:
        begin, stop = cuts[g], cuts[g + 1]
        for i in range(begin, stop, 256):
            a = np.arange(i, min(i + 256, stop))
            later = np.arange(i, stop)
            later = later[asked[later] & (made[later] <= bound)]  # one beyond the bound shows that there are more
            for j in range(0, len(later), 16_384):
                b = later[j : j + 16_384]
                x, y = np.nonzero(filters.likely(a[:, None], b[None, :]))
                x, y = a[x], b[y]
                up = x < y
                x, y = x[up], y[up]
                near = filters.near(x, y)
                x, y = x[near], y[near]
                if len(x):  # in order of x, so that the earliest come first for each y
                    nth = made[y] + _nth(y)
                    np.add.at(made, y, 1)
                    a_all.append(x[nth <= bound])
                    b_all.append(y[nth <= bound])
    a, b = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (a_all, b_all))
    return tuple({k: v[at] for k, v in rows.items()} for at in (a, b, made > bound))


def candidate_pairs(rows: DataFrame, bound: int = PROPOSALS, kinds: dict[str, str] = _ROW) -> DataFrame:
    """(a1, a2, b1, b2, word): a class a that begins before b, and no word; or no a, and a word where b could have proposed more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            for number, n, data in zip(batch.column("bucket").to_pylist(), batch.column("n").to_pylist(), byte_values(batch.column("data")), strict=True):
                if number != now and held:
                    yield out(_join(held))
                    held = []
                now = number
                held.append(_uncell(data, n, kinds))
        if held:
            yield out(_join(held))

    def out(x: Rows) -> pa.RecordBatch:
        a, b, more = proposals(x, bound)
        pairs = np.unique(np.stack([a["k1"], a["k2"], b["k1"], b["k2"]]), axis=1) if len(a["k1"]) else np.zeros((4, 0), np.int64)
        n, m = pairs.shape[1], len(more["word"])
        none = np.arange(n + m) >= n
        fill = np.zeros(m, np.int64)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([pairs[0], fill]), mask=none),
                pa.array(np.concatenate([pairs[1], fill]), mask=none),
                pa.array(np.concatenate([pairs[2], more["k1"]])),
                pa.array(np.concatenate([pairs[3], more["k2"]])),
                pa.array(np.concatenate([np.zeros(n, np.int64), more["word"].astype(np.int64) << 32]), mask=~none),
            ],
            ["a1", "a2", "b1", "b2", "word"],
        )

    return rows.mapInArrow(lean(run), "a1 long, a2 long, b1 long, b2 long, word long")


def _marked(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes.view(np.uint64) >> np.uint64(64 - BITS)
    return (bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def bitmap(hashes: DataFrame) -> np.ndarray:
    """Marks the first bits of the hashes in column h; at most 2 ** (BITS - 6) rows are collected."""
    at = F.shiftrightunsigned("h", 64 - BITS)
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - BITS}) & 63 as int))")
    words = hashes.groupBy(F.shiftright(at, 6).cast("int").alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(1 << (BITS - 6), np.uint64)
    out[words.column("at").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def _ends(pairs: DataFrame) -> np.ndarray:
    return bitmap(pairs.select(F.explode(F.array("a1", "b1")).alias("h")))


def with_earlier(pairs: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """pairs with the columns of their earlier set (a1, a2), of which many later ones may be near copies.

    SHARE sets at most are in more than that part of all pairs: their pairs are dealt to SALTS tasks each, and they alone
    are copied so often. AQE would not split this join, as the sets come out of an aggregate.
    """
    keys, total = ["a1", "a2"], pairs.count()
    found = scratch.save(pairs.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > max(OFTEN, total // SHARE)).select(*keys))
    if found.isEmpty():
        return pairs.join(sets, keys)
    hot = F.broadcast(found)
    often = pairs.join(hot, keys).withColumn("salt", F.pmod(F.xxhash64("b1", "b2"), F.lit(SALTS)).cast("int"))
    # An inner join, which unlike a semi-join stays above the aggregate, so that its exchange is reused.
    copies = sets.join(hot, keys).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rare = pairs.join(hot, keys, "left_anti").join(sets, keys)
    return rare.unionByName(often.join(copies, [*keys, "salt"]).drop("salt"))


def parity_filter(blocks: DataFrame, pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs without those whose 256 bits of parity differ too much; far narrower than the sets themselves."""
    marks = blocks.sparkSession.sparkContext.broadcast(_ends(pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x in _blocks(batches, ["vocabulary", "token", "size", "k1", "k2"]):
            x = _of_lines(x, _marked(marks.value, x["k1"]))
            yield pa.RecordBatch.from_arrays([pa.array(y) for y in (x["k1"], x["k2"], x["size"], *_parity(x).view(np.int64))], ["k1", "k2", "size", "p0", "p1", "p2", "p3"])

    words = ["p0", "p1", "p2", "p3"]
    rows = blocks.select("block", "vocabulary", "token", "size", "k1", "k2").mapInArrow(lean(run), "k1 long, k2 long, size int, p0 long, p1 long, p2 long, p3 long")
    known = rows.groupBy("k1", "k2").agg(*[F.max(c).alias(c) for c in ("size", *words)])
    a, b = (known.select(F.col("k1").alias(f"{e}1"), F.col("k2").alias(f"{e}2"), *[F.col(c).alias(f"{e}_{c}") for c in ("size", *words)]) for e in "ab")
    both = with_earlier(pairs.select("a1", "a2", "b1", "b2"), a, scratch).join(b, ["b1", "b2"])
    differing = sum((F.bit_count(F.col(f"a_{c}").bitwiseXOR(F.col(f"b_{c}"))) for c in words), F.lit(0))
    total = F.col("a_size") + F.col("b_size")
    return both.where(differing <= total - 2 * F.ceil(4 * total / 9)).select("a1", "a2", "b1", "b2")


def verified(blocks: DataFrame, pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """Distinct (b1, b2) of pairs whose sets are similar. Only sets that the bitmap marks are read out of the blocks."""
    spark = blocks.sparkSession
    marks = spark.sparkContext.broadcast(_ends(pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x in _blocks(batches, ["vocabulary", "token", "size", "k1", "k2"]):
            chosen = np.nonzero(_marked(marks.value, x["k1"]))[0]
            keep = np.zeros(len(x["size"]), bool)
            if len(chosen):
                keep[chosen[np.unique(np.stack([x["k1"][chosen], x["k2"][chosen]]), axis=1, return_index=True)[1]]] = True
            x = _of_lines(x, keep)
            ends = np.concatenate([[0], np.cumsum(x["size"])]).astype(np.int32)
            sets = pa.ListArray.from_arrays(pa.array(ends), pa.array(x["vocabulary"].view(np.int64)[x["token"]]))
            yield pa.RecordBatch.from_arrays([pa.array(x["k1"]), pa.array(x["k2"]), sets], ["k1", "k2", "words"])

    sets = blocks.select("block", "vocabulary", "token", "size", "k1", "k2").mapInArrow(lean(run), "k1 long, k2 long, words array<long>")
    sets = sets.groupBy("k1", "k2").agg(F.first("words").alias("words"))
    a = sets.select(F.col("k1").alias("a1"), F.col("k2").alias("a2"), F.col("words").alias("wa"))
    b = sets.select(F.col("k1").alias("b1"), F.col("k2").alias("b2"), F.col("words").alias("wb"))
    both = with_earlier(pairs, a, scratch).join(b, ["b1", "b2"])
    common = F.size(F.array_intersect("wa", "wb"))
    return both.where(9 * common >= 4 * (F.size("wa") + F.size("wb"))).select("b1", "b2").distinct()


def similar_classes(blocks: DataFrame, scratch: Scratch, bound: int = PROPOSALS, hot: int = HOT) -> DataFrame:
    """(b1, b2) of the classes that are similar to one that begins earlier."""
    context = blocks.sparkSession.sparkContext
    level = context.broadcast(rarity(blocks, hot))
    found = scratch.save(candidate_pairs(prefix_rows(blocks, level), bound))
    pairs = scratch.save(found.where("word is null").select("a1", "a2", "b1", "b2").distinct())
    similar = scratch.save(verified(blocks, scratch.save(parity_filter(blocks, pairs, scratch)), scratch))
    for later in LATER:
        more = scratch.save(found.where("word is not null").join(similar, ["b1", "b2"], "left_anti").select("b1", "b2", "word"))
        words = bitmap(more.select(F.col("word").alias("h")))
        if not words.any():
            break
        sets = more.select("b1", "b2").distinct()
        only = context.broadcast((words, bitmap(sets.select(F.col("b1").alias("h")))))
        # The bitmaps mark some others too; what those propose is dropped.
        found = scratch.save(candidate_pairs(prefix_rows(blocks, level, only), later, _LATER_ROW).join(sets, ["b1", "b2"], "left_semi"))
        pairs = scratch.save(found.where("word is null").select("a1", "a2", "b1", "b2").distinct())
        similar = scratch.save(similar.unionByName(verified(blocks, pairs, scratch)).distinct())
    return similar


def removed_lines(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """A row per document: uid, the columns of KEY, doc_id, n_lines and removed, the sorted numbers (from 0) of the lines that go."""
    scratch = Scratch(docs.sparkSession)
    blocks = write_blocks(docs, scratch)
    similar = similar_classes(blocks, scratch, hot=hot)

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, x in _blocks(batches, ["k1", "k2", "line_doc", "line_no", "doc_id", "first"]):
            at = np.nonzero(x["first"])[0]
            doc = x["line_doc"][at].astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(y) for y in (x["k1"][at], x["k2"][at], x["doc_id"][doc], x["line_no"][at], (number << 20) + doc)], ["k1", "k2", "doc_id", "line_no", "uid"])

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, x in _blocks(batches, ["line_doc", "line_no", "doc_id", "key", "more", "n_lines", "first"]):
            again = ~x["first"]
            sure = np.append(0, np.cumsum(np.bincount(x["line_doc"][again], minlength=len(x["doc_id"])))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(sure), pa.array(x["line_no"][again]))
            yield pa.RecordBatch.from_arrays([pa.array((number << 20) + np.arange(len(x["doc_id"]))), pa.array(x["doc_id"]), pa.array(x["key"]), pa.array(x["more"]), pa.array(x["n_lines"]), lists], ["uid", "doc_id", *KEY, "n_lines", "sure"])

    # Of each class, a block sends its first line only; what it holds behind that goes in any case.
    every = blocks.select("block", "k1", "k2", "line_doc", "line_no", "doc_id", "first").mapInArrow(lean(lines), "k1 long, k2 long, doc_id long, line_no int, uid long")
    first = every.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "line_no", "uid")).alias("first"))
    first = first.join(similar.select(F.col("b1").alias("k1"), F.col("b2").alias("k2"), F.lit(True).alias("similar")), ["k1", "k2"], "left")
    gone = every.join(first, ["k1", "k2"]).where((F.col("uid") != F.col("first.uid")) | (F.col("line_no") != F.col("first.line_no")) | F.col("similar"))
    by_document = gone.groupBy("uid").agg(F.collect_list("line_no").alias("more"))
    all_docs = blocks.select("block", "line_doc", "line_no", "doc_id", "key", "more", "n_lines", "first").mapInArrow(lean(documents), "uid long, doc_id long, _weft_key long, _weft_more long, n_lines int, sure array<int>")
    removed = F.sort_array(F.concat("sure", F.coalesce("more", F.array().cast("array<int>"))))
    out = all_docs.join(by_document, "uid", "left")
    return out.select("uid", *KEY, F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "n_lines", removed.alias("removed"))


def dedupe(docs: DataFrame) -> DataFrame:
    """docs without the removed lines; every row stays, with a text that may be empty."""
    columns = docs.columns
    rows = attached(docs, removed_lines(docs), "uid", "left", _weft_removed=F.col("removed"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = batch.column("text").to_pylist()
            for i, removed in enumerate(batch.column("_weft_removed").to_pylist()):
                if removed:
                    out = set(removed)
                    texts[i] = "\n".join(line for k, line in enumerate(texts[i].split("\n")) if k not in out)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in columns], columns)

    return rows.mapInArrow(lean(run), docs.schema)
