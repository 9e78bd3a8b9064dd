import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from cohort_engine.llm import textkit

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbÉé \t\n\x0b zZ'", max_size=30)), max_size=8))
def test_words_and_shingles(texts):
    h, ptr = textkit.words(pa.array(texts, pa.string()))
    lists = [split(t) for t in texts]
    assert np.diff(ptr).tolist() == [len(x) for x in lists]
    flat = [w for x in lists for w in x]
    names = {}
    assert all(names.setdefault(w, v) == v for w, v in zip(flat, h.tolist())) and len(set(names.values())) == len(names)
    sh, at = textkit.shingles(h, ptr)
    sets, to = textkit.row_sets(sh, at)
    for i, x in enumerate(lists):
        want = [tuple(x[k:k + 5]) for k in range(max(len(x) - 4, 1))] if x else []
        assert at[i + 1] - at[i] == len(want) and to[i + 1] - to[i] == len(set(want))


def test_chunks_and_slices_change_nothing(monkeypatch):
    texts = pa.array(["alpha beta " * 50, None, "", "gamma " * 200, "x"])
    h, ptr = textkit.words(texts)
    monkeypatch.setattr(textkit, "CHUNK_BYTES", 17)
    h2, ptr2 = textkit.words(texts)
    assert (h == h2).all() and (ptr == ptr2).all()
    batch = pa.RecordBatch.from_arrays([texts], names=["text"])
    parts = list(textkit.slices(batch, "text", 100))
    assert sum(p.num_rows for p in parts) == 5 and len(parts) > 2
    assert np.concatenate([textkit.words(p.column("text"))[0] for p in parts]).tolist() == h.tolist()


def test_numbers_come_back_from_fewer_bytes():
    rng = np.random.default_rng(4)
    for n in (0, 1, 5000):
        x = np.sort(rng.integers(0, 2**64, n, dtype=np.uint64))
        assert (textkit.unpacked(textkit.packed(x)) == x).all()
        for kind in (np.uint8, np.uint32):
            y = rng.integers(0, 200, n).astype(kind)
            assert (textkit.from_planes(textkit.planes(y), kind) == y).all()
    assert len(textkit.packed(x)) < 0.9 * x.nbytes and len(textkit.planes(y)) < 0.5 * y.nbytes
