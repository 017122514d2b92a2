import re
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from brute import lower, split
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenframe.llm import blobs, jaccard_join, pretokens
from lumenframe.llm import textkernel as tk
from lumenframe.llm.common import releasing
from lumenframe.llm.kneser_ney import _inverse_mix
from lumenframe.llm.transducers import Transducer

TEXT = st.text(alphabet=st.sampled_from(list("abAB'stre ré\n\t\x0b !?1٣ß漢🎉　\x85\x1c")), max_size=40)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(TEXT, st.none()), min_size=1, max_size=5), st.booleans())
def test_words(texts, small):
    (a, b, w), = tk.split_batches(pa.array(texts, pa.string()), lower=small)
    assert (a, b) == (0, len(texts))
    for i, t in enumerate(texts):
        want = split(lower(t) if small else t)
        assert w.counts[i] == len(want)
        got = [tk.word_hash(x) for x in want]
        assert w.hash[w.first[i] : w.first[i + 1]].tolist() == got


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=4))
def test_pieces(texts):
    pattern = regex.compile(public_tokenizers.PATTERN)
    raw = [t.encode() for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in raw]))).astype(np.int64)
    p = pretokens.pieces(np.frombuffer(b"".join(raw), dtype=np.uint8), offsets)
    for i, t in enumerate(texts):
        k = slice(p.first[i], p.first[i + 1])
        assert [p.data[s:e].tobytes().decode() for s, e in zip(p.start[k], p.end[k], strict=True)] == pattern.findall(t)


@given(st.lists(st.integers(0, 2**64 - 1), max_size=50))
def test_blobs(keys):
    k, n = blobs.counted(np.array(keys, dtype=np.uint64))
    assert blobs.unpack_sorted(blobs.pack_sorted(k)).tolist() == sorted(set(keys))
    assert blobs.unpack_values(blobs.pack_values(n), 1).tolist() == n.tolist() and n.sum() == len(keys)
    x = np.array(keys, dtype=np.uint64)
    assert (_inverse_mix(tk.mix64(x)) == x).all()
    at = blobs.cut(k, 7)
    assert at[0] == 0 and at[-1] == len(k)


def test_slices_keep_long_texts_whole():
    offsets = np.array([0, 5, 5, 100, 103])
    assert list(tk.slices(offsets, 10)) == [(0, 2), (2, 3), (3, 4)]


def test_composition():
    a, b = Transducer(), Transducer()
    a.arc(0, "x", "y", 1.0, 1)
    a.arc(1, "x", "z", 2.0, 0)
    b.arc(0, "y", "-", 10.0, 0)
    b.arc(0, "z", "-", 100.0, 0)
    assert a.compose(b).compiled().best(["x", "x", "x"]) == 1 + 2 + 1 + 10 + 100 + 10


def test_fetched_arrays(tmp_path, monkeypatch):
    from lumenframe.llm import sharedfs

    for k, array in enumerate((np.arange(7), np.zeros(0, np.uint8), np.arange(20000, dtype=np.uint64).reshape(-1, 4))):
        uri = f"file://{tmp_path}/a{k}.npy"
        sharedfs.write_array(uri, array)
        assert (sharedfs.map_array(uri) == array).all()
        got = sharedfs._fetched(uri)
        assert got.shape == array.shape and got.dtype == array.dtype and (got == array).all()


def test_sets_are_made_piece_by_piece():
    """A large batch's sets are sent on in pieces of a bounded size, not all at once."""
    rng = np.random.default_rng(5)
    texts = [" ".join(map(str, rng.integers(0, 10_000, 2000))) for _ in range(400)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(400), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    most = 8 * tk.SLICE_BYTES // 2  # a set has fewer tokens than half the text's bytes
    found = list(jaccard_join._wanted_sets(5, np.full(1 << 17, 255, dtype=np.uint8), 20)(iter([batch])))
    assert len(found) > 2 and sum(b.num_rows for b in found) == 400 and max(b.nbytes for b in found) < most
    assert [s for b in found for s in b.column(1).to_pylist()] == [s.tobytes() for s in jaccard_join.shingle_sets(batch.column(1))]
    for run in (jaccard_join._signatures(5), jaccard_join._prefixes(5, np.full(1 << 20, 4, dtype=np.uint8), 1024)):
        assert len(list(run(iter([batch])))) > 2


def test_worker_gives_freed_memory_back():
    """What a task frees goes back to the machine at its end, though a block above it is still held."""

    def anonymous() -> int:
        return sum(int(n) for n in re.findall(r"\nAnonymous:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())) // 1024

    pinned = []

    def task(batches):
        blocks = [bytes(2000) for _ in range(100_000)]
        pinned.append(bytes(2000))
        blocks.clear()
        yield from batches

    before = anonymous()
    assert list(releasing(task)(iter([1, 2]))) == [1, 2]
    assert anonymous() - before < 60
