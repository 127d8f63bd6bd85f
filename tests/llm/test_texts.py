"""Operators on whole texts: round trips, libraries' own results, brute force and held-out accuracy."""

import hashlib
import os
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
import public_tokenizers
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from weftgraph.llm import jpeg, lm, mixing, pieces, quality, queries, tokens
from weftgraph.llm.common import Scratch, split_words

SMALL = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " ", "\n", "  a  b ", " \n a", "a \nb", "▁a▁▁b", "é́x ﬁ", "\x00a\tb\x0b\x0c\x1c\x85\xa0c", "<s> </s> <0x0A>", "<|endoftext|>x<|startoftext|> <|endoftext |>", "I'll don't 'S 12!!", "ΣΑΣ ΟΔΟΣ İI", "日本 語 😀", "w" * 30_000, "word " * 20_000, "\r\n x\r"]


def noise(seed, n=300):
    r = random.Random(seed)
    return ["".join(r.choice("aB' \n▁é\t́Σσ<|>12!\x85\xa0\x1c\x0b😀ﬁ") for _ in range(r.randint(0, 40))) for _ in range(n)]


def table(spark, texts, **more):
    rows = [(i, t, i) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, (None, "a b", 0), *rows[2:3]], "doc_id long, text string, n_tokens int")


def test_pieces_agree_with_the_library(spark):
    docs = table(spark, ODD + noise(1))
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    encoded = pieces.encode_decode(docs, PIECES)
    assert encoded.columns == ["doc_id", "text", "n_tokens", "ids", "decoded"]
    for r in encoded.collect():
        ids = sp.encode(r["text"] or "")
        assert (r["n_tokens"], r["ids"], r["decoded"]) == (len(ids), ids, sp.decode(ids))
    first = pieces.digests(encoded.where("doc_id = 4")).first()
    ids = sp.encode(ODD[4])
    assert first["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert first["decoded_sha256"] == hashlib.sha256(sp.decode(ids).encode()).hexdigest()


def test_piece_tables_start_anew(monkeypatch):
    monkeypatch.setattr(pieces, "TABLE_CHUNKS", 50)
    chunks, sp = pieces.ChunkTable(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert chunks.exact
    for seed in range(4):
        texts = noise(seed, 60)
        n, ids, said = chunks.encode(texts)
        parts = np.split(ids, np.cumsum(n)[:-1])
        assert [p.tolist() for p in parts] == [sp.encode(t) for t in texts] and said == texts_without_marks(texts)
    chunks.exact = False
    n, ids, _ = chunks.encode(["a b", ""])
    assert n.tolist() == [2, 0] and ids.tolist() == sp.encode("a b")


def texts_without_marks(texts):
    return [t.replace("▁", " ") for t in texts]


def test_token_files_agree_with_the_library(spark):
    docs = table(spark, ODD + noise(2))
    tokenizer = Tokenizer.from_file(WORDS)
    expected, start = [], 0
    for r in sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"])):
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        expected.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    found = tokens.read_ids(*tokens.write_ids(docs, WORDS, Scratch(spark)))
    assert [tuple(r) for r in found.orderBy("start").collect()] == expected
    assert tokens.read_ids(*tokens.write_ids(docs.limit(0), WORDS, Scratch(spark))).count() == 0


def test_word_tables_start_anew(monkeypatch):
    monkeypatch.setattr(tokens, "TABLE_WORDS", 40)
    words, tokenizer = tokens.WordTable(WORDS), Tokenizer.from_file(WORDS)
    for seed in range(4):
        texts = noise(seed, 60)
        n, ids = words.encode(pa.array(texts))
        assert [p.tolist() for p in np.split(ids, np.cumsum(n)[:-1])] == [[*tokenizer.encode(t, add_special_tokens=False).ids, 2] for t in texts]


class OneByOne:
    """A tokenizer that keeps the texts which it encodes."""

    def __init__(self, tokenizer):
        self.tokenizer, self.texts = tokenizer, []

    def encode_batch_fast(self, texts, **how):
        self.texts += texts
        return self.tokenizer.encode_batch_fast(texts, **how)


def test_plain_words_skip_the_tokenizers_own_splitting():
    words, tokenizer = tokens.WordTable(WORDS), Tokenizer.from_file(WORDS)
    words.tokenizer = OneByOne(words.tokenizer)
    words.of_parts = OneByOne(getattr(words, "of_parts", None))
    r = random.Random(3)
    bits = ["'s", "'S", "'t", "'RE", "'ve", "'m", "'ll", "'Ll", "'d", "'", "''", "l", "e", "r", "a", "B", "\u00e9", "\u00c9", "\u00df", "\u00ff", "\u00de", "\u00c0", "0", "9", "!", "<", ">", " ", "\n"]
    odd = ["\u00d7", "\u00f7", "<|", "<|endoftext|>", "\u65e5", "\u0301", "\x7f", "\xa0", "\u00b5", "\u00b2"]
    for more in ([], odd):
        for _ in range(2):
            texts = ["".join(r.choice(bits + more) for _ in range(r.randint(0, 12))) for _ in range(3000)]
            for _ in range(2):  # all is known the second time
                n, ids = words.encode(pa.array(texts))
                assert [p.tolist() for p in np.split(ids, np.cumsum(n)[:-1])] == [[*x.ids, 2] for x in tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert bool(words.tokenizer.texts) == bool(more)
    for said in (words.tokenizer.texts, " ".join(words.of_parts.texts).split(" ")):
        assert len(said) == len(set(said)) > 100


def test_parts_of_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(tokens, "word_hashes", lambda words: np.zeros(len(words), np.uint64), raising=False)
    words, tokenizer = tokens.WordTable(WORDS), Tokenizer.from_file(WORDS)
    for texts in (["one two", "three one"], ["two four", "one", "three's"]):
        n, ids = words.encode(pa.array(texts))
        assert [p.tolist() for p in np.split(ids, np.cumsum(n)[:-1])] == [[*x.ids, 2] for x in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_ids_are_ranked_by_how_often_they_occur(spark):
    texts = ODD + noise(4)
    seen = {}
    for x in texts:
        for i in [*Tokenizer.from_file(WORDS).encode(x or "", add_special_tokens=False).ids, 2]:
            seen[i] = seen.get(i, 0) + 1
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    files, ranks = tokens.write_ids(docs, WORDS, Scratch(spark))
    assert [r["id"] for r in ranks.orderBy("rank").collect()] == sorted(seen, key=lambda i: (-seen[i], i))
    assert files.count() == len(texts) and files.agg(F.sum("n_tokens")).first()[0] == sum(seen.values())


def test_ranks_of_all_lengths_come_back():
    rng = np.random.default_rng(0)
    counts = np.array([0, 1, 4, 5, 0, 300, 3])
    ranks = (rng.integers(0, 1 << 32, counts.sum(), dtype=np.uint64) >> rng.integers(0, 32, counts.sum(), dtype=np.uint64)).astype(np.uint32)
    control, data = tokens.pack(ranks, counts)
    assert (tokens.unpack(control, data, counts) == ranks).all()
    assert [len(c) for c in control] == [0, 1, 1, 2, 0, 75, 1]


def test_words_are_cut_as_bytes_are():
    texts = ODD + noise(3)
    n, codes, distinct = split_words(pa.array(texts, pa.string()))
    parts = np.split(codes, np.cumsum(n)[:-1])
    assert [[distinct[c] for c in p] for p in parts] == [(t or "").encode().split() for t in texts]


def test_payloads_come_back(spark):
    texts = [None, "", "a", "é" * 288, "x" * 576, "\x7f" * 577, "long " * 300_000]
    docs = spark.createDataFrame([(i, t, b"x") for i, t in enumerate(texts)] + [(None, "a", b"y")], "doc_id long, text string, media binary")
    back = jpeg.read(jpeg.store(docs))
    for r in jpeg.digests(back).collect():
        data = (texts[r["doc_id"]] or "").encode() if r["doc_id"] is not None else b"a"
        whole = data + b"\xff" * (-len(data) % 576 if data else 576)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-32:]))
    same = {r["feature"] for r in jpeg.digests(back).where("n_bytes = 1").collect()}
    assert len(same) == 1
    assert jpeg.digests(jpeg.read(jpeg.store(docs.limit(0)))).count() == 0


# A small encoder of its own for what others may write: several components, sampling, codes of several lengths, runs.

DC_SYMBOLS, AC_SYMBOLS = list(range(12)), [r << 4 | s for r in range(16) for s in range(1, 11)] + [0x00, 0xF0]


def codes(symbols, short):
    """Canonical codes: the first `short` symbols have 3 bits, the others 9."""
    counts = [0, 0, short, 0, 0, 0, 0, 0, len(symbols) - short, *[0] * 7]
    out = {s: (3, i) for i, s in enumerate(symbols[:short])}
    return bytes(counts) + bytes(symbols), out | {s: (9, (short << 6) + i) for i, s in enumerate(symbols[short:])}


@needs_tables
def test_payloads_are_read_from_storage(spark):
    found = queries.op4_jpeg_payloads(spark, SMALL)
    files = found.inputFiles()
    assert files and not any("documents.parquet" in f for f in files)
    direct = jpeg.digests(jpeg.read(jpeg.store(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text"))))
    assert sorted(map(str, found.collect())) == sorted(map(str, direct.collect()))


def encode_picture(width, height, sampling, interval, seed, scans=None):
    """(file, coefficients of the first component by block row and column)."""
    rng = np.random.default_rng(seed)
    top = [max(s[i] for s in sampling) for i in (0, 1)]
    mcus = -(-width // (8 * top[0])), -(-height // (8 * top[1]))
    planes = []
    for h, v in sampling:
        shape = (mcus[1] * v, mcus[0] * h, 64)
        plane = np.where(rng.random(shape) < 0.15, rng.integers(-1000, 1000, shape), 0)
        plane[..., 0] = rng.integers(-900, 900, shape[:2])
        planes.append(plane)
    (dc_body, dc), (ac_body, ac) = codes(DC_SYMBOLS, 3), codes(AC_SYMBOLS[::-1], 3)
    out = [b"\xff\xd8", jpeg._segment(0xE0, b"JFIF\0"), jpeg._segment(0xDB, b"\x00" + bytes([2] * 64)), jpeg._segment(0xC4, b"\x00" + dc_body + b"\x10" + ac_body)]
    out.append(jpeg._segment(0xC0, struct.pack(">BHHB", 8, height, width, len(sampling)) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(sampling))))
    out += [jpeg._segment(0xDD, struct.pack(">H", interval))] if interval else []
    for parts in scans or [list(range(len(sampling)))]:
        out.append(jpeg._segment(0xDA, bytes([len(parts), *[x for p in parts for x in (p + 1, 0)], 0, 63, 0])))
        if len(parts) == 1:
            h, v = sampling[parts[0]]
            across, down = (-(-(-(-size * s // t)) // 8) for size, s, t in ((width, h, top[0]), (height, v, top[1])))
            units = [[(parts[0], y, x)] for y in range(down) for x in range(across)]
        else:
            units = [[(p, my * sampling[p][1] + y, mx * sampling[p][0] + x) for p in parts for y in range(sampling[p][1]) for x in range(sampling[p][0])] for my in range(mcus[1]) for mx in range(mcus[0])]
        step = interval or len(units)
        for n, i in enumerate(range(0, len(units), step)):
            bits, last = [], dict.fromkeys(parts, 0)

            def put(length, value, bits=bits):
                bits.append(f"{value:0{length}b}" if length else "")

            def number(value):
                size = int(abs(value)).bit_length()
                return size, value if value > 0 else value + (1 << size) - 1

            for p, y, x in (u for mcu in units[i : i + step] for u in mcu):
                block = planes[p][y, x]
                size, raw = number(int(block[0]) - last[p])
                last[p] = int(block[0])
                put(*dc[size])
                put(size, raw)
                run = 0
                end = max([0, *np.nonzero(block[1:])[0] + 1])
                for k in range(1, end + 1):
                    if block[k] == 0:
                        run += 1
                        continue
                    while run > 15:
                        put(*ac[0xF0])
                        run -= 16
                    size, raw = number(int(block[k]))
                    put(*ac[run << 4 | size])
                    put(size, raw)
                    run = 0
                if end < 63:
                    put(*ac[0])
            text = "".join(bits)
            text += "1" * (-len(text) % 8)
            raw = int(text, 2).to_bytes(len(text) // 8, "big").replace(b"\xff", b"\xff\x00")
            out += [b"\xff" + bytes([0xD0 + (n - 1) % 8])] * (n > 0) + [raw]
    return b"".join([*out, b"\xff\xd9"]), planes[0]


@pytest.mark.parametrize(
    ("size", "sampling", "interval", "scans"),
    [((24, 16), [(1, 1)], 0, None), ((50, 35), [(2, 2), (1, 1), (1, 1)], 0, None), ((50, 35), [(2, 1), (1, 1), (1, 1)], 3, None), ((33, 70), [(2, 2), (1, 1)], 0, [[0], [1]]), ((130, 9), [(1, 1)], 2, None)],
)
def test_pictures_of_other_encoders(size, sampling, interval, scans):
    data, plane = encode_picture(*size, sampling, interval, 7, scans)
    broken = data[: len(data) // 2] + b"\xff\xd9"
    found, bad, none = jpeg.decode([data, broken, b"GIF89a"])
    top = [max(s[i] for s in sampling) for i in (0, 1)]
    down, across = -(-(-(-size[1] * sampling[0][1] // top[1])) // 8), -(-(-(-size[0] * sampling[0][0] // top[0])) // 8)
    expected = np.clip((plane[:down, :across, 0] * 2 + 4 >> 3) + 128, 0, 255).astype(np.uint8)
    assert found[:4] == (*size, 1, expected.tobytes())
    assert none is None and (bad is None or bad[3] != found[3])


def test_features_cover_all_images():
    unit = jpeg.UNIT * jpeg.IMAGE_UNITS
    texts = [b"a" * unit, b"a" * unit + b"\x01" * unit, b"a" * unit + b"\x01" * jpeg.UNIT, b"a" * (unit // 2) + b"\x01" * unit]
    one, two, little, half = jpeg.decode(jpeg.encode([jpeg.payload(t) for t in texts]))
    high = 8 * 3 * jpeg.IMAGE_UNITS
    assert [x[:3] for x in (one, two, little)] == [(24, high, 1), (24, 2 * high, 2), (24, high + 24, 2)]
    assert len({x[4] for x in (one, two, half)}) == 3
    assert {two[4]} <= {"ffffffff00000000", "00000000ffffffff"}  # one value in each of both images
    rng = np.random.default_rng(0)
    picture = rng.integers(0, 256, (64, 24))
    small = picture.reshape(8, 8, 8, 3).mean(axis=(1, 3))
    assert jpeg.mean_hash([picture[:16], picture[16:]]) == np.packbits(small > small.mean()).tobytes().hex()


def test_labellers_find_their_defects():
    texts = ["A sound sentence of many different words, as people write them. " * 1, "THESE!! ARE!! LOUD!! WORDS!! AND!! MORE!! OF!! THEM!! HERE!!", "a*** b$$$ c%%% d&&& e### f*** g$$$ h%%%", "one | two | three | four | five | six | seven | eight |", "same same same same same same same same same same same same same same same same same same same same"]
    x = quality.Measured(pa.array([*texts, "", None]))
    voted = quality.votes(x.measures, x.n)
    names = [[quality.LABELLERS[i] for i in np.nonzero(v == quality.BAD)[0]] for v in voted]
    assert names[0] == [] and {"capitals", "exclamations"} <= set(names[1]) and "symbols" in names[2] and "bars" in names[3] and "neighbours" in names[4]
    assert (voted[5:] == quality.ABSTAIN).all()


def test_em_recovers_accuracies():
    rng = np.random.default_rng(0)
    truth = rng.random(40_000) < 0.25
    accuracy = np.array([0.9, 0.85, 0.95, 0.8, 0.9, 0.92, 0.88, 0.9])
    right = rng.random((len(truth), 8)) < accuracy
    voted = np.where(right == truth[:, None], quality.BAD, quality.GOOD)
    voted[rng.random(voted.shape) < 0.3] = quality.ABSTAIN
    keys, n = np.unique(quality.patterns(voted), return_counts=True)
    rate, found = quality.fit_labellers(dict(zip(keys.tolist(), n.tolist(), strict=True)))
    assert abs(rate - 0.25) < 0.02 and np.abs(found - accuracy).max() < 0.03
    assert ((quality.posterior_bad(voted, (rate, found)) > 0.5) == truth).mean() > 0.97


@needs_tables
def test_quality_on_held_out_labels(spark):
    found = queries.op6_quality(spark, "/root/testdata/sf0.01").toPandas().merge(spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas(), on="doc_id")
    clean = found[found.quality == 1]
    assert len(found) > 100 and (found.kept == (found.quality == 1)).mean() > 0.97 and clean.kept.mean() > 0.99


def test_quality_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, "s"), (2, "", "s"), (3, "A short one.", "s"), (3, "A short one.", "s"), (None, "x" * 100_000, "s")], "doc_id long, text string, kept string")
    rows = quality.classify(docs).collect()
    assert [r["kept"] for r in rows[:2]] == [False, False] and rows[2]["score"] == rows[3]["score"] and len(rows) == 5
    assert quality.classify(docs.limit(0)).count() == 0


def test_quality_does_not_depend_on_partitions(spark):
    """The sample is the same whatever the partitioning, and so are all scores; more rows than the sample holds."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(docs.limit(20))
    one, other = (sorted(map(tuple, quality.classify(x, sample=50).select("doc_id", "bad_posterior", "score").collect())) for x in (docs.coalesce(1), docs.repartition(7)))
    assert one == other and len({s for _, _, s in one}) > 50


def test_lm_difference_matches_brute_force(spark, monkeypatch):
    texts = ["The cat sat.", "the dog sat", None, " \n", "cat cat cat dog", "Zebra zebra the cat", "the cat sat. on the mat " * 50]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    wanted = spark.createDataFrame([(0,), (6,), (6,), (99,)], "doc_id long")
    found = {r["doc_id"]: r for r in lm.score(docs, wanted).collect()}
    words = [(t or "").encode().lower().split() for t in texts]
    counts = {}
    for w in (w for x in words for w in x):
        counts[lm.word_hash(w)] = counts.get(lm.word_hash(w), 0) + 1
    top = sorted(counts, key=lambda h: (-counts[h], h))[: lm.WORDS]

    def entry(w):
        h = lm.word_hash(w)
        return top.index(h) if h in top else lm.WORDS + h % lm.CLASSES

    def model(chosen):
        pair, history, single = {}, {}, {}
        for x in chosen:
            for a, b in zip([lm.START, *map(entry, x)], map(entry, x), strict=False):
                pair[a, b] = pair.get((a, b), 0) + 1
                history[a] = history.get(a, 0) + 1
                single[b] = single.get(b, 0) + 1
        total = sum(single.values()) + lm.SIZE
        return lambda a, b: -np.log2((pair.get((a, b), 0) + 50 * (single.get(b, 0) + 1) / total) / (history.get(a, 0) + 50))

    target, background = model([words[0], words[6]]), model(words)
    for i, x in enumerate(words):
        steps = list(zip([lm.START, *map(entry, x)], map(entry, x), strict=False))
        if not steps:
            assert found[i]["target_loss"] is None and found[i]["n_words"] == 0
            continue
        expected = [np.mean([m(a, b) for a, b in steps]) for m in (target, background)]
        assert np.allclose([found[i]["target_loss"], found[i]["background_loss"]], expected, atol=1e-4)
        assert found[i]["difference"] == pytest.approx(expected[0] - expected[1], abs=1e-4)
    assert lm.score(docs.limit(0), wanted).count() == 0


def exact_differences(texts, chosen):
    """Losses of both models by plain counts over all words; chosen: places of the target's texts."""
    words = [(t or "").encode().lower().split() for t in texts]
    size = max(lm.SIZE, len({w for x in words for w in x}))

    def model(texts):
        pair, history, single = {}, {}, {}
        for x in texts:
            for a, b in zip([None, *x], x, strict=False):
                pair[a, b] = pair.get((a, b), 0) + 1
                history[a] = history.get(a, 0) + 1
                single[b] = single.get(b, 0) + 1
        total = sum(single.values()) + size
        return lambda a, b: -np.log2((pair.get((a, b), 0) + 50 * (single.get(b, 0) + 1) / total) / (history.get(a, 0) + 50))

    models = model([words[i] for i in chosen]), model(words)
    return [[np.mean([m(a, b) for a, b in zip([None, *x], x, strict=False)]) for m in models] if x else None for x in words]


def check_differences(spark, docs, wanted):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    chosen = {r["doc_id"] for r in wanted.collect()} - {None}
    expected = exact_differences([t for _, t in rows], [i for i, (d, _) in enumerate(rows) if d in chosen])
    found = lm.score(docs, wanted).collect()
    assert len(found) == len(rows)
    by_id = {}
    for (i, t), x in zip(rows, expected, strict=True):
        by_id.setdefault(i, []).append((len((t or "").encode().split()), *([None] * 3 if x is None else [*x, x[0] - x[1]])))
    got = {}
    for r in found:
        got.setdefault(r["doc_id"], []).append((r["n_words"], r["target_loss"], r["background_loss"], r["difference"]))
    assert got.keys() == by_id.keys()
    for i in got:
        for a, b in zip(sorted(got[i], key=str), sorted(by_id[i], key=str), strict=True):
            assert a == pytest.approx(b, abs=1e-9)


def test_lm_difference_holds_every_word(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"W{int(x)}" for x in rng.zipf(1.3, int(rng.integers(0, 400))) % 50_000)) for i in range(300)]
    rows += [(7, "w1 w2 only-here"), (None, "w1 unnamed"), (None, "w1 w2 w3"), (900, None), (901, " \n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert len({w for _, t in rows for w in (t or "").lower().split()}) > 3 * lm.SIZE
    wanted = spark.createDataFrame([(i,) for i in [*range(0, 300, 7), 7, None, 5000]], "doc_id int")
    check_differences(spark, docs, wanted)
    monkeypatch.setattr(lm, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(lm, "WORDS", 3_000)
    check_differences(spark, docs, wanted)
    check_differences(spark, docs, wanted.limit(0))


@needs_tables
def test_lm_difference_of_the_tables(spark, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_BYTES", 100_000)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    check_differences(spark, docs, spark.read.parquet(f"{SMALL}/labels.parquet").where("quality = 1 and toxic = 0").select("doc_id"))


def test_targets_share_the_excess():
    found = mixing.targets([(None, 10), ("b", 1000), ("a", 10), ("c", 500)])
    assert [x[0] for x in found] == ["a", "b", "c", None]
    assert sum(x[2] for x in found) == pytest.approx(1520) and all(t <= 3 * s + 1e-9 for _, s, t in found)
    assert found[2][2] / 3 == pytest.approx(found[1][2] / 2)
    assert mixing.targets([]) == [] and mixing.targets([("a", 0)]) == [("a", 0, 0.0)]


def test_mix_comes_near_its_targets(spark):
    rng = np.random.default_rng(0)
    rows = [(i, "w " * int(rng.integers(0, 60)), ["s1", "s2", None, "é"][min(3, int(rng.integers(0, 9)) // 2)]) for i in range(600)]
    rows += [rows[5], (None, "a b", "s1"), (700, None, "s2"), (701, " ", "")]
    rows += [(800 + i // 2, "twin of another source", "s1" if i % 2 else "s2") for i in range(40)]
    docs = spark.createDataFrame([(*r, "old", 1) for r in rows], "doc_id long, text string, source string, taken string, passes int")
    found = mixing.shares(docs).toPandas()
    assert len(found) == len(rows) and (found.taken <= 3 * found["size"]).all()
    assert found.taken.sum() <= found["size"].sum()
    for source, part in found.groupby("source", dropna=False):
        assert part.source_size.iloc[0] == part["size"].sum()
        assert abs(part.taken.sum() - part.target.iloc[0]) <= 60
    again = mixing.shares(docs.repartition(7)).toPandas()
    key = ["doc_id", "size", "taken"]
    assert found[key].sort_values(key).values.tolist().__repr__() == again[key].sort_values(key).values.tolist().__repr__()
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    per = mixed.groupBy("doc_id", "source").count().collect()
    per = {(r["doc_id"], r["source"]): r["count"] for r in per}
    for r in found[(found.taken > 0) & found.doc_id.notna() & (found.doc_id != rows[5][0])].itertuples():
        assert per[r.doc_id, r.source if isinstance(r.source, str) else None] == r.passes
    assert mixing.shares(docs.limit(0)).count() == 0 and mixing.mix(docs.limit(0)).count() == 0


def cut_mix(rows, seed=7, repeats=3):
    """Passes by (doc_id, source): all entries of all passes, sorted by finish time and cut off at the total budget. rows: (hash, doc_id, source, size)"""
    plan = mixing.targets([(s, sum(r[3] for r in rows if r[2] == s)) for s in sorted({r[2] for r in rows})], repeats=repeats)
    entries = []
    for i, (name, _, target) in enumerate(plan):
        served = 0
        for _ in range(repeats):
            for _, doc, _, size in sorted(r for r in rows if r[2] == name):
                served += size
                if size:
                    entries.append((served / target, i, served, size, doc, name))
    left, passes = sum(r[3] for r in rows), {(r[1], r[2]): 0 for r in rows}
    for _, _, _, size, doc, name in sorted(entries):
        if size > left:
            break
        left -= size
        passes[doc, name] += 1
    return passes


def test_mix_is_cut_off_at_the_budget(spark):
    several = 0
    for seed in range(6):
        rng = np.random.default_rng(seed)
        rows = [(i, "w " * int(rng.integers(0, 4)), ["a", "b"][i % 2]) for i in range(60)] + [(100 + i, "w " * int(rng.integers(40, 90)), "c") for i in range(3)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
        found = mixing.shares(docs)
        hashed = found.select(F.xxhash64(F.lit(7), "doc_id", "size").alias("h"), "doc_id", "source", "size", "passes", "taken", "target").collect()
        expected = cut_mix([(r["h"], r["doc_id"], r["source"], r["size"]) for r in hashed])
        assert {(r["doc_id"], r["source"]): r["passes"] for r in hashed} == expected
        over = {s: sum(r["taken"] for r in hashed if r["source"] == s) - next(r["target"] for r in hashed if r["source"] == s) for s in "abc"}
        several += max(over["a"], over["b"]) >= 3  # more than one entry of at most three words after time 1
    assert several


@needs_tables
def test_targets_match_sql(spark):
    import duckdb

    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SMALL}/documents.parquet')")
    theirs = sorted(db.execute(queries.ORACLE_SQL["mixed_targets"]).fetchall())
    ours = sorted(map(tuple, queries.mixed_targets(spark, SMALL).collect()))
    assert [x[:3] for x in ours] == [x[:3] for x in theirs] and np.allclose([x[3] for x in ours], [x[3] for x in theirs], atol=0.002)


@needs_tables
def test_pipeline_keeps_what_its_stages_say(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, scratch = docs.columns, Scratch(spark)
    for name, stage in corpus_pipeline.STAGES:
        before = docs.count()
        docs = scratch.save(stage(spark, docs, SMALL))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        assert 0 < docs.count() <= (before if name != "source mix" else 3 * before)
    final = sorted(map(str, corpus_pipeline.run(spark, SMALL).collect()))
    assert final == sorted(map(str, docs.collect()))
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    assert docs.join(labels.where("quality = 0"), "doc_id").count() <= 1


def test_pipeline_of_odd_tables(spark):
    """Clashing names, a missing column, nulls, twins, a long text and an empty table: see the module's docstring."""
    text = "The quick brown fox jumps over the lazy dog near the river bank. " * 3
    rows = [(1, text, "s", -5.0, "x"), (1, text, "s", -5.0, "x"), (None, None, None, 1.0, None), (2, "", "t", 2.0, "y"), (3, "Many different words stand in this long text, number %d. " * 3000 % tuple(range(3000)), "t", 3.0, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, score double, kept string")
    scratch, before = Scratch(spark), docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, ""))
        assert docs.schema == before.schema, name
        assert {(r["doc_id"], r["score"], r["kept"]) for r in docs.collect()} <= {(r[0], r[3], r[4]) for r in rows}
    assert 1 in {r["doc_id"] for r in docs.collect()}
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").columns == ["doc_id", "source", "n_tokens", "ids", "decoded_sha256"]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, before.limit(0), "").count() == 0


@needs_tables
def test_pipeline_matches_plain_stages(spark):
    """Line dedup, near-dedup, mix and encoding in plain Python, behind the quality stage."""
    good = corpus_pipeline.good_texts(spark, spark.read.parquet(f"{SMALL}/documents.parquet"), SMALL)
    docs = sorted((r["doc_id"], r["text"] or "", r["source"]) for r in good.collect())
    assert len({d for d, _, _ in docs}) == len(docs)
    seen, kept_lines = {}, []
    for doc, text, source in docs:
        kept = []
        for line in text.split("\n"):
            words = frozenset(line.encode().lower().split())
            if not words or (words not in seen and not any(5 * len(words & x) >= 4 * len(words | x) for x in seen if 5 * len(x) >= 4 * len(words) and 5 * len(words) >= 4 * len(x))):
                kept.append(line)
            seen[words or None] = True
            seen.pop(None, None)
        kept_lines.append((doc, "\n".join(kept), source))

    def bits(text):
        words = text.encode().lower().split()
        grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    marks, root = [bits(t) for _, t, _ in kept_lines], list(range(len(kept_lines)))
    for i in range(len(marks)):
        for j in range(i):
            if (marks[i] ^ marks[j]).bit_count() <= 3 and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if x == high else x for x in root]
    unique = [x for i, x in enumerate(kept_lines) if root[i] == i]
    sized = spark.createDataFrame([(d, s, len(t.encode().split())) for d, t, s in unique], "doc_id long, source string, size long")
    hashed = sized.withColumn("h", F.xxhash64(F.lit(7), "doc_id", "size")).collect()
    passes = cut_mix([(r["h"], r["doc_id"], r["source"], r["size"]) for r in hashed])
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    expected = [(d, s, model.encode(t)) for d, t, s in unique for _ in range(passes[d, s])]
    found = [(r["doc_id"], r["source"], list(r["ids"])) for r in corpus_pipeline.run(spark, SMALL).collect()]
    assert sorted(found, key=str) == sorted(expected, key=str)
