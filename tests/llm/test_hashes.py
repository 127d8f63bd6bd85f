import numpy as np
import pyarrow as pa

from weftgraph.llm.common import SHORT, coded_words, split_words, word_hashes


def test_hashes_differ_by_length_and_every_byte():
    words = ["", "a", "a\x00", "aaaaaaaa", "aaaaaaaa\x00", "é" * 9, *("x" * i + y + "x" * j for i in (0, 7, 8, 30, SHORT - 1, SHORT) for j in (0, 1, 9) for y in "yz")]
    words = list(dict.fromkeys(words))
    hashes = word_hashes(pa.array(words))
    assert len(set(hashes.tolist())) == len(words)
    assert (word_hashes(pa.array(["before", *words, "behind"])[1:-1]) == hashes).all()  # wherever a word stands
    assert [word_hashes(pa.array([w]))[0] for w in words] == hashes.tolist()
    many = word_hashes(pa.array([f"w{i}" for i in range(200_000)]))
    assert len(np.unique(many)) == len(many) and all(abs(float((many >> np.uint64(b) & np.uint64(1)).mean()) - 0.5) < 0.01 for b in range(64))
    assert len(word_hashes(pa.array([], pa.string()))) == 0


def test_words_as_an_array_are_those_as_a_list():
    texts = pa.array([" a b\ta ", "", None, "b", "\n"])
    (n, codes, distinct), (m, again, listed) = coded_words(texts), split_words(texts)
    assert n.tolist() == m.tolist() == [3, 0, 0, 1, 0] and codes.tolist() == again.tolist() == [0, 1, 0, 1]
    assert distinct.to_pylist() == ["a", "b"] and listed == [b"a", b"b"]
