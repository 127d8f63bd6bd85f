"""Language-model scoring by cross-entropy difference: a target and a background bigram model over all words.

The vocabulary holds every word of the documents, and both models every bigram: they grow with the corpus and stay
distributed. Documents are dealt into blocks by the hash of doc_id. A block sums its words, histories and bigrams first and
sends each distinct one, under a 64-bit key, to the bucket of that key. A bucket adds up what the blocks sent, and sends back
those totals that differ from a block's own counts. So no key has more than one row per block, however frequent it is, and
what occurs in one block only isn't sent back. A model's chance of a word is its bigram count smoothed by its unigram model,
which counts one more of each word; both models are built alike. A document's score is the mean over its words of the
target's loss less the background's: the lower, the more it is like the target.

Words are lower-cased (A-Z), cut at ASCII white space, and known by their 64-bit hash. The first word follows a start mark.

Defined cases: a null text counts as empty; a text without words has null losses; documents that are named more than once
as target count once, and a null doc_id is never one; without a target its model is flat; an empty table gives an empty
table; columns named like an added one are replaced. Rows of one doc_id share a block, which a task holds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, packed, slices, split_words, unpacked, wider

#: Bytes of text in a block, about, and words whose keys share a bucket.
BLOCK_BYTES, WORDS = 12_000_000, 1 << 20
#: Blocks of a small table, so that several tasks share it.
LEAST_BLOCKS = 16
#: Words that the smoothing counts at least: a small vocabulary leaves a share to words that it doesn't hold.
SIZE = 1536


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) - (1 << 63)


#: The history of a first word, and what stands for "any" before and behind a word; no word holds a space.
START, BEFORE, BEHIND = (word_hash(x) for x in (b" ", b" <", b" >"))
ADDED = ("n_words", "target_loss", "background_loss", "difference")


def pair_keys(history: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Even 64-bit keys of pairs of word hashes."""
    x = history.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + words.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(31))) & ~np.uint64(1)


class Block:
    """What a block's documents hold: distinct bigrams, words and histories, in this order, with their counts."""

    def __init__(self, docs: pa.Table, targets: pa.Array):
        chosen = pc.is_in(docs.column("doc_id"), value_set=targets).to_numpy(zero_copy_only=False).astype(bool)
        lens, codes, hashes, held = [], [], [], 0
        for batch in slices(docs.select(["text"]).to_batches(), "text", BLOCK_BYTES):
            n, at, distinct = split_words(batch.column("text"), lower=True)
            lens.append(n)
            codes.append(at + held)
            hashes.append(np.array([word_hash(w) for w in distinct], np.int64))
            held += len(distinct)
        self.n = np.concatenate([np.zeros(0, np.int64), *lens])
        words, number = np.unique(np.concatenate([np.zeros(0, np.int64), *hashes]), return_inverse=True)
        word = number[np.concatenate([np.zeros(0, np.int64), *codes])]
        size = len(words)
        history = np.empty(len(word), np.int64)
        history[1:] = word[:-1]
        history[(np.cumsum(self.n) - self.n)[self.n > 0]] = size
        pairs, self.pair = np.unique(history * (size + 1) + word, return_inverse=True)
        self.history, self.word = pairs // (size + 1), pairs % (size + 1)
        self.sizes = len(pairs), size, size + 1
        starts = np.append(words, START)
        keys = np.concatenate([
            pair_keys(starts[self.history], words[self.word]),
            pair_keys(np.full(size, BEFORE), words) | np.uint64(1),  # odd keys are words
            pair_keys(starts, np.full(size + 1, BEHIND)),
        ])
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        wanted = np.repeat(chosen, self.n)
        self.background, self.target = (
            np.concatenate([np.bincount(x[of], minlength=m) for x, m in zip((self.pair, word, history), self.sizes, strict=True)])[self.order] for of in (slice(None), wanted)
        )

    def losses(self, counts: np.ndarray, total: int, size: int, strength: float = 50.0) -> np.ndarray:
        """The sum over each document's words of -log2 of their chances; counts: of all keys, in their order."""
        found = np.empty(len(counts))
        found[self.order] = counts
        pairs, words, histories = np.split(found, np.cumsum(self.sizes)[:2])
        unigram = (words + 1) / (total + size)
        chance = (pairs + strength * unigram[self.word]) / (histories[self.history] + strength)
        return np.bincount(np.repeat(np.arange(len(self.n)), self.n), -np.log2(chance)[self.pair], len(self.n))


def send(block: Block, number: int, buckets: int) -> pa.Table:
    """A row for each bucket, also where it has no key: each bucket then knows each block."""
    at = np.searchsorted(((block.keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))
    parts = [slice(a, b) for a, b in zip(at[:-1], at[1:], strict=True)]
    columns = [[packed(x[p], kind) for p in parts] for x, kind in ((block.keys, "<u8"), (block.background, "<u4"), (block.target, "<u4"))]
    return pa.table([pa.array(np.arange(buckets), pa.int32()), pa.array([number] * buckets, pa.int32()), pa.array(at[:-1], pa.int64()), *[pa.array(x, pa.binary()) for x in columns]], SENT_NAMES)


SENT = "bucket int, _weft_block int, first long, keys binary, background binary, target binary"
SENT_NAMES = [x.split()[0] for x in SENT.split(", ")]
TOTALS = "_weft_block int, at binary, background binary, target binary, n_background long, n_target long, n_distinct long"
TOTALS_NAMES = [x.split()[0] for x in TOTALS.split(", ")]


def add_up(rows: pa.Table) -> pa.Table:
    """For each block the places and totals of its keys that other blocks hold too, and numbers of the bucket's words."""
    blocks, first = rows.column("_weft_block").to_pylist(), rows.column("first").to_pylist()
    own = [[unpacked([x], kind) for x in rows.column(name).to_pylist()] for name, kind in (("keys", "<u8"), ("background", "<u4"), ("target", "<u4"))]
    keys, at = np.unique(np.concatenate(own[0]), return_inverse=True)
    background, target = (np.bincount(at, np.concatenate(x), len(keys)).astype(np.int64) for x in own[1:])
    is_word = (keys & np.uint64(1)).astype(bool)
    numbers = int(background[is_word].sum()), int(target[is_word].sum()), int(is_word.sum())
    out, begin = [], 0
    for block, start, mine in zip(blocks, first, own[1], strict=True):
        places = at[begin : begin + len(mine)]
        begin += len(mine)
        other = np.nonzero(background[places] != mine)[0]
        out.append((block, packed(other + start, "<u4"), packed(background[places[other]], "<u8"), packed(target[places[other]], "<u8"), *numbers))
    kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    return pa.table([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], TOTALS_NAMES)


def score(docs: DataFrame, target_ids: DataFrame) -> DataFrame:
    """doc_id and the other columns but text, n_words, target_loss, background_loss and difference (bits a word).

    target_ids: doc_id of the documents that train the target model.
    """
    kept = [c for c in docs.columns if c not in ("text", *ADDED)]
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, buckets = max(LEAST_BLOCKS, n_bytes // BLOCK_BYTES + 1), n_bytes // (6 * WORDS) + 1  # words have about six bytes

    def dealt(*columns: str) -> Column:
        return F.pmod(F.xxhash64(*columns), F.lit(blocks)).cast("int").alias("_weft_block")

    kind = docs.schema["doc_id"].dataType
    whole = docs.select(*kept, "text", F.when(F.col("doc_id").isNull(), dealt("text")).otherwise(dealt("doc_id")).alias("_weft_block"))
    ids = target_ids.select(F.col("doc_id").alias("_weft_given"), F.col("doc_id").try_cast(kind).alias("doc_id"))
    ids = ids.where("doc_id = _weft_given").select("doc_id", dealt("doc_id")).distinct()

    def count(mine: pa.Table, chosen: pa.Table) -> pa.Table:
        if not len(mine):
            return pa.table([pa.array([], t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())], SENT_NAMES)
        out = send(Block(mine, chosen.column("doc_id").combine_chunks()), mine.column("_weft_block")[0].as_py(), buckets)
        give_back()
        return out

    def judge(mine: pa.Table, others: pa.Table) -> pa.Table:
        is_total = pc.is_valid(others.column("at"))
        totals = others.filter(is_total)
        block = Block(mine, others.filter(pc.invert(is_total)).column("doc_id").combine_chunks())
        places = unpacked(totals.column("at").to_pylist(), "<u4")
        size = max(SIZE, pc.sum(totals.column("n_distinct")).as_py() or 0)
        found = []
        for name, counts in (("target", block.target), ("background", block.background)):
            counts[places] = unpacked(totals.column(name).to_pylist(), "<u8")
            found.append(block.losses(counts, pc.sum(totals.column(f"n_{name}")).as_py() or 0, size) / np.maximum(block.n, 1))
        none = block.n == 0
        added = [pa.array(block.n), *[pa.array(x, mask=none) for x in (*found, found[0] - found[1])]]
        del block, counts, places, totals
        give_back()
        return pa.table([*[mine.column(c) for c in kept], *added], [*kept, *ADDED])

    sent = whole.groupBy("_weft_block").cogroup(ids.groupBy("_weft_block")).applyInArrow(count, SENT)
    totals = sent.groupBy("bucket").applyInArrow(add_up, TOTALS)
    given = totals.unionByName(ids, allowMissingColumns=True)
    out = wider(docs.select(*kept), "n_words long, target_loss double, background_loss double, difference double")
    return whole.groupBy("_weft_block").cogroup(given.groupBy("_weft_block")).applyInArrow(judge, out)
