"""Quality classifier: EM over heuristic labellers, whose posteriors train a hashed linear scorer.

Each labeller looks at a whole text and votes bad, good or abstains; most know one defect and vote bad or abstain. The
votes of a document form a pattern, and the counts of patterns over all documents hold all that EM needs; there are at
most 3 ** labellers of them. EM fits the rate of documents that are bad and the accuracy of each labeller's votes. The
posteriors of a sample train a logistic scorer over hashed features: words, their shapes, and coarse facts of the text. The
sample is the documents of the smallest hashes of doc_id and text, SAMPLE at most, however they are partitioned. The scorer
then judges every document.

Defined cases: a null text counts as empty; a text without words is rejected with score 0; equal texts get equal scores;
an empty table gives an empty table; columns named like an added one are replaced, all others are carried along.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_values, lean, slices, split_words, wider

BAD, ABSTAIN, GOOD = 0, 1, 2
LABELLERS = ["capitals", "symbols", "bars", "exclamations", "neighbours", "variety", "sentences", "prose"]
#: Documents, at most, whose posteriors train the scorer.
SAMPLE = 6000
DIMENSIONS = 1 << 18
_UPPER, _LOWER = np.arange(65, 91), np.arange(97, 123)
#: Punctuation that does not belong to prose; vertical bars have a labeller of their own.
_SYMBOLS = np.frombuffer(b"#$%&*+/<=>@[\\]^_`{}~", np.uint8)
_PROSE = re.compile(rb"['\"(]*[A-Za-z\x80-\xff'-]+[.,;:?)'\"]*!?").fullmatch
_SHAPES = [(re.compile(rb"[A-Z]+"), b"A"), (re.compile(rb"[a-z\x80-\xff]+"), b"a"), (re.compile(rb"[0-9]+"), b"0"), (re.compile(rb"([^A-Za-z0-9])\1+"), rb"\1\1")]


class Measured:
    """The words of some texts as codes, and a measure of each text for each labeller."""

    def __init__(self, texts: pa.Array):
        self.n, self.codes, self.distinct = split_words(texts)
        self.row = np.repeat(np.arange(len(self.n)), self.n)
        n, row, codes, rows = np.maximum(self.n, 1), self.row, self.codes, len(self.n)
        of_bytes = np.array([np.bincount(np.frombuffer(t, np.uint8), minlength=256) for t in byte_values(texts)]).reshape(-1, 256)
        upper, lower = of_bytes[:, _UPPER].sum(axis=1), of_bytes[:, _LOWER].sum(axis=1)
        solid = of_bytes.sum(axis=1) - of_bytes[:, 32] - of_bytes[:, 9:14].sum(axis=1)
        flags = np.array([(w[-1] in b".?!", bool(_PROSE(w))) for w in self.distinct], float).reshape(-1, 2)[codes]
        same = (codes[1:] == codes[:-1]) & (row[1:] == row[:-1])
        bits = max(1, len(self.distinct).bit_length())
        keys = np.sort(row << bits | codes)
        variety = np.bincount(keys[np.diff(keys, prepend=-1) != 0] >> bits, minlength=rows)
        self.measures = np.stack([
            upper / np.maximum(upper + lower, 1),
            of_bytes[:, _SYMBOLS].sum(axis=1) / np.maximum(solid, 1),
            of_bytes[:, 124] / n,
            of_bytes[:, 33] / n,
            np.bincount(row[1:][same], minlength=rows) / np.maximum(n - 1, 1),
            variety / n**0.8,
            np.bincount(row, flags[:, 0], rows) / n,
            np.bincount(row, flags[:, 1], rows) / n,
        ], axis=1)


#: From where the labellers of one defect vote bad.
_DEFECTS = [0.6, 0.08, 0.2, 0.4, 0.25]
#: Where EM starts from: whoever knows one defect is rarely wrong about it.
_FIRST_GUESS = np.array([0.95] * 6 + [0.9, 0.7])
#: A labeller is better than chance and never certain.
_RANGE = (0.6, 0.999)


def votes(measures: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """A vote per document (row) and labeller (column)."""
    out = np.full(measures.shape, ABSTAIN)
    for i, bad in enumerate(_DEFECTS):
        out[measures[:, i] >= bad, i] = BAD
    variety, sentences, prose = measures[:, 5], measures[:, 6], measures[:, 7]
    out[(variety <= 0.35) & (n_words >= 20), 5] = BAD
    out[((sentences == 0) & (n_words >= 40)) | (sentences > 0.7) & (n_words >= 8), 6] = BAD
    out[(prose >= 0.9) & (variety >= 0.85), 7] = GOOD
    out[(prose <= 0.7) & (n_words >= 8), 7] = BAD
    out[n_words == 0] = ABSTAIN
    return out


def patterns(voted: np.ndarray) -> np.ndarray:
    return voted @ 3 ** np.arange(voted.shape[1])


def fit_labellers(counts: dict[int, int], rounds: int = 200) -> tuple[float, np.ndarray]:
    """(rate of bad documents, accuracy of each labeller) by EM over the counts of vote patterns."""
    keys = np.array(sorted(counts), np.int64)
    n = np.array([counts[k] for k in keys.tolist()], float)
    voted = keys[:, None] // 3 ** np.arange(len(LABELLERS)) % 3
    rate, accuracy = 0.2, _FIRST_GUESS
    for _ in range(rounds):
        bad = _bad(voted, rate, accuracy)
        right = ((voted == BAD) * (n * bad)[:, None] + (voted == GOOD) * (n * (1 - bad))[:, None]).sum(axis=0)
        cast = ((voted != ABSTAIN) * n[:, None]).sum(axis=0)
        new = np.clip((right + 20 * _FIRST_GUESS) / (cast + 20), *_RANGE)
        rate, done = float(((n * bad).sum() + 0.5) / (n.sum() + 1)), np.abs(new - accuracy).max() < 1e-9
        accuracy = new
        if done:
            break
    return rate, accuracy


def _bad(voted: np.ndarray, rate: float, accuracy: np.ndarray) -> np.ndarray:
    weight = np.log(accuracy / (1 - accuracy))
    z = ((voted == BAD) * weight - (voted == GOOD) * weight).sum(axis=1) + np.log(rate / (1 - rate))
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def posterior_bad(voted: np.ndarray, model: tuple[float, np.ndarray]) -> np.ndarray:
    return _bad(voted, *model)


def _slot(name: bytes) -> int:
    return xxhash.xxh64_intdigest(name) % DIMENSIONS


def word_slots(words: list[bytes]) -> np.ndarray:
    """Hashed features of words: of each, itself and its shape."""
    shapes = words
    for pattern, by in _SHAPES:
        shapes = [pattern.sub(by, x) for x in shapes]
    return np.array([(_slot(b"w" + w.lower()), _slot(b"s" + s[:12])) for w, s in zip(words, shapes, strict=True)], np.int64).reshape(-1, 2)


def text_slots(measures: np.ndarray) -> np.ndarray:
    """Hashed features of texts: coarse steps of each measure."""
    steps = np.minimum((measures * 10).astype(np.int64), 15)
    names = np.array([[_slot(b"%d=%d" % (i, s)) for s in range(16)] for i in range(measures.shape[1])])
    return names[np.arange(measures.shape[1]), steps]


def train(rows: list[tuple[np.ndarray, np.ndarray]], bad: np.ndarray, rounds: int = 60, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic model of `bad`, by full-batch AdaGrad; rows: slots and values of each document."""
    if not rows:
        return np.zeros(DIMENSIONS), 0.0
    slot, value = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    used, slot = np.unique(slot, return_inverse=True)
    w, b, g2, b2 = np.zeros(len(used)), 0.0, np.full(len(used), 1e-8), 1e-8
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[slot] * value, len(rows)) + b, -30, 30)))
        off = (p - bad) / len(rows)
        g, gb = np.bincount(slot, value * off[row], len(used)) + decay * w, off.sum()
        g2, b2 = g2 + g * g, b2 + gb * gb
        w, b = w - 0.5 * g / np.sqrt(g2), b - 0.5 * gb / b2**0.5
    weights = np.zeros(DIMENSIONS)
    weights[used] = w
    return weights, float(b)


def classify(docs: DataFrame, least: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """Adds bad_posterior (of the labellers), score (chance of good text, by the scorer) and kept."""
    spark = docs.sparkSession
    texts = docs.select("text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(3 ** len(LABELLERS), np.int64)
        for batch in slices(batches, "text"):
            x = Measured(batch.column("text"))
            total += np.bincount(patterns(votes(x.measures, x.n))[x.n > 0], minlength=len(total))
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["pattern", "n"])

    found = texts.mapInArrow(lean(count), "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    counts = {r["pattern"]: r["n"] for r in found}
    total = sum(counts.values())
    labellers = fit_labellers(counts) if counts else (0.5, _FIRST_GUESS)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            x = Measured(batch.column("text"))
            n, bad = x.n, posterior_bad(votes(x.measures, x.n), labellers)
            of_words, of_text = word_slots(x.distinct)[x.codes], text_slots(x.measures)
            at = np.concatenate([[0], np.cumsum(n)])
            slots, values, some = [], [], np.nonzero(n)[0]
            for i in some:
                s, k = np.unique(of_words[at[i] : at[i + 1]], return_counts=True)
                slots.append(np.concatenate([s, of_text[i]]).tolist())
                values.append(np.concatenate([k / n[i], np.ones(len(of_text[i]))]).tolist())
            yield pa.RecordBatch.from_arrays([batch.column("h").take(pa.array(some)), pa.array(slots, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32())), pa.array(bad[some])], ["h", "slots", "vals", "bad"])

    # 62 bits of a hash; twice the share of it that the sample needs, of which the driver gets the smallest ones.
    hashed = docs.select("text", F.shiftrightunsigned(F.xxhash64(F.lit(5), "doc_id", "text"), 2).alias("h")) if "doc_id" in docs.columns else docs.select("text", F.shiftrightunsigned(F.xxhash64(F.lit(5), "text"), 2).alias("h"))
    share = int(min(1.0, 2 * sample / max(total, 1)) * (1 << 62))
    smallest = [r["h"] for r in hashed.select("h").where(F.col("h") < share).orderBy("h").limit(sample + 1).collect()]
    drawn = hashed.where(F.col("h") < (smallest[sample] if len(smallest) > sample else share))
    rows = drawn.mapInArrow(lean(featured), "h long, slots array<int>, vals array<float>, bad double").toArrow().sort_by("h") if total else None
    if rows is not None and rows.num_rows:
        pairs = [(np.array(s.values), np.array(v.values, np.float64)) for s, v in zip(rows.column("slots"), rows.column("vals"), strict=True)]
        weights, bias = train(pairs, rows.column("bad").to_numpy())
    else:
        weights, bias = np.zeros(DIMENSIONS), 0.0
    shared = spark.sparkContext.broadcast((weights.astype(np.float32), bias))  # of fixed size
    kept = [c for c in docs.columns if c not in ("bad_posterior", "score", "kept")]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = shared.value
        for batch in slices(batches, "text"):
            x = Measured(batch.column("text"))
            n, bad = x.n, np.where(x.n > 0, posterior_bad(votes(x.measures, x.n), labellers), 1.0)
            sums = np.bincount(x.row, w[word_slots(x.distinct)].sum(axis=1)[x.codes], len(n))
            z = sums / np.maximum(n, 1) + w[text_slots(x.measures)].sum(axis=1) + b
            good = np.where(n > 0, 1 / (1 + np.exp(np.clip(z, -30, 30))), 0.0)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(bad), pa.array(good), pa.array(good >= least)], [*kept, "bad_posterior", "score", "kept"])

    return docs.select(*kept).mapInArrow(lean(score), wider(docs.select(*kept), "bad_posterior double, score double, kept boolean"))
