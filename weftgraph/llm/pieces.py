"""SentencePiece encoding and decoding through a table of distinct chunks.

A chunk is a run of whitespace markers with the word behind it, or a line break with the word behind it. Where no piece
of the model crosses the start of a chunk, no merge does either, so that each distinct chunk is segmented once and the
ids of a text are its chunks' ids, joined by position. Decoding joins the chunks' decoded pieces in the same way. Texts
of a model for which this doesn't hold are encoded whole.

Defined cases: a null text counts as empty and has no ids; whole texts are used at any length; each row is encoded for
itself, so that equal rows give equal results; an empty table gives an empty table; columns that are named like an added
one are replaced, all others are carried along.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Index, Runs, lean, slices, wider

MARK = "\u2581"
#: Chunks, and their characters, in a worker's table before it starts anew.
TABLE_CHUNKS, TABLE_CHARS = 300_000, 10_000_000
#: Bytes of text that are encoded at once.
SLICE_BYTES = 2_500_000
_WORKERS: dict[str, ChunkTable] = {}


class ChunkTable:
    """Segments texts by distinct chunks. Run i holds the ids of chunk i."""

    def __init__(self, model: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        crossing = re.compile(f"[^{MARK}]{MARK}|.\n|\n.", re.S)
        plain = [x.replace(MARK, " ") for x in ("a", " a", "a b", " a  b ", "\u00e9\ufb01", "\n")]
        self.exact = not any(crossing.search(p) for p in pieces) and all(self.sp.decode(self.sp.encode(x)) == x for x in plain)
        self.anchor = self.sp.encode("a")
        self.clear()

    def clear(self) -> None:
        self.index, self.runs, self.decoded, self.chars = Index(), Runs(np.int32), [], 0

    @staticmethod
    def chunks(text: str) -> list[str]:
        """Chunks in order. One that starts with a line break has no marker; the first one of others is left out."""
        if not text:
            return []
        if "  " in text or MARK in text or " \n" in text or text[0] == " ":
            found = re.findall("(?: +|\n)[^ \n]*", " " + text.replace(MARK, " "))
            return [x[1:] if x[0] == " " else x for x in found]
        return text.replace("\n", " \n").split(" ")

    def add(self, new: list[str]) -> None:
        marked = [x if x[:1] == "\n" else f" {x}" for x in new]
        # The model puts a marker before each text: it stands for the one that is left out, or is taken off again.
        ids = self.sp.encode(new, num_threads=1)
        for i, x in enumerate(marked):
            if x[0] == "\n":
                ids[i] = ids[i][1:]
            elif x == " ":
                ids[i] = [self.sp.piece_to_id(MARK)]
        said = self.sp.decode([self.anchor + x for x in ids], num_threads=1) if ids else []
        self.decoded.extend(d[1:] for d in said)
        self.chars += sum(map(len, new))
        self.runs.add(np.array([y for i in ids for y in i], np.int32), np.array([len(i) for i in ids], np.int64))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Numbers of ids, all ids, decoded texts."""
        if not self.exact:
            ids = self.sp.encode(texts, num_threads=1)
            return np.array([len(x) for x in ids], np.int64), np.array([i for x in ids for i in x], np.int32), self.sp.decode(ids, num_threads=1)
        if len(self.index) > TABLE_CHUNKS or self.chars > TABLE_CHARS:
            self.clear()
        cut = [self.chunks(t) for t in texts]
        at = self.index.of(cut)
        if new := self.index.new:
            self.index.new = []
            self.add(new)
        ids, ends = self.runs.join(at)
        said, decoded = list(map(self.decoded.__getitem__, at.tolist())), []
        stops = np.cumsum([0, *map(len, cut)])
        for a, b in zip(stops, stops[1:], strict=False):
            whole = "".join(said[a:b])
            decoded.append(whole[1:] if whole[:1] == " " else whole)
        return np.diff(np.concatenate([[0], ends])[stops]), ids, decoded


def _table(model: str) -> ChunkTable:
    """One table for each worker process and model; the model is read once."""
    if model not in _WORKERS:
        _WORKERS[model] = ChunkTable(model)
    return _WORKERS[model]


def encode_decode(docs: DataFrame, model: str) -> DataFrame:
    """Adds n_tokens, ids (array of int) and decoded (the text that the ids stand for)."""
    kept = [c for c in docs.columns if c not in ("n_tokens", "ids", "decoded")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _table(model)
        for batch in slices(batches, "text", SLICE_BYTES):
            n, ids, decoded = tokens.encode([x or "" for x in batch.column("text").to_pylist()])
            offsets = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array(n, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32())), pa.array(decoded, pa.string())],
                [*kept, "n_tokens", "ids", "decoded"],
            )
        tokens.clear()  # a worker lives on, and what it runs next needs the memory

    docs = docs.select(*kept)
    return docs.mapInArrow(lean(run), wider(docs, "n_tokens long, ids array<int>, decoded string"))


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of encode_decode()."""
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return encoded.select("doc_id", "n_tokens", F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
