import numpy as np
import pyarrow as pa

from tallyscope.llm.wordhash import LETTERS, NOT_BLANK, Words, hash_words, per_doc, pieces


def test_words_and_hashes_do_not_depend_on_place():
    texts = ["The cat", "", "  ", "cat THE\tThe\ncät x", None, "a" * 5000 + " the"] * 30
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    for limit in (1, 50, 1 << 20):
        rows, seen = 0, {}
        for part, data, offsets in pieces(batch, "text", limit):
            found = Words(data, offsets)
            h = found.hashes()
            for i in range(len(found.start)):
                word = bytes(data[found.start[i] : found.end[i]]).decode().lower()
                assert seen.setdefault(word, h[i]) == h[i]
            want = [len((t or "").split()) for t in part.column("text").to_pylist()]
            assert np.diff(found.first).tolist() == want
            assert per_doc(np.ones(len(h)), found.first).tolist() == want
            rows += part.num_rows
        assert rows == len(texts)
        assert len(set(seen.values())) == len(seen) == 5
        assert hash_words(["the", "cät"]).tolist() == [seen["the"], seen["cät"]]


def test_hashes_are_spread():
    words = [f"w{i}" for i in range(50_000)]
    raw = " ".join(words).encode()
    h = Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])).hashes()
    assert len(set(h.tolist())) == len(words)
    assert abs(np.mean(h >> np.uint64(63)) - 0.5) < 0.02


def test_classes_and_beginnings():
    raw = "stupid! st*pid, Stupidity".encode()
    found = Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), LETTERS)
    assert len(found.start) == 4
    begin = found.hashes(5)
    assert begin[0] == begin[3] != begin[1]
    assert len(Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), NOT_BLANK).start) == 3
