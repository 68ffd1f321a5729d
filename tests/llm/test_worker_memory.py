"""What a task of the n-gram join holds follows the texts hashed at a time, not the batch that Spark hands it."""

import tracemalloc

import numpy as np
import pyarrow as pa

from wayfold.llm import arrays, ngram_join


def peaks(run) -> tuple[int, int]:
    """Bytes that ``run`` had at most, by Arrow and by Python with numpy."""
    before, pool = pa.default_memory_pool(), pa.proxy_memory_pool(pa.default_memory_pool())
    pa.set_memory_pool(pool)
    tracemalloc.start()
    try:
        run()
        return pool.max_memory(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
        pa.set_memory_pool(before)


def many_texts(n: int = 2400) -> pa.RecordBatch:
    draw = np.random.default_rng(5)
    texts = [None if k % 97 == 0 else " ".join(map(str, draw.integers(0, 10**6, 1000))) for k in range(n)]
    return pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array(texts, pa.string())], names=["_id", "_text"])


def test_hashing_holds_slices_instead_of_the_batch():
    batch = many_texts()
    assert batch.nbytes > 15 << 20
    arrays._powers.cache_clear()
    arrow, numpy = peaks(lambda: [0 for _ in ngram_join.shingle_sets(batch.column("_text"))])
    assert arrow < 4 << 20 and numpy < 32 << 20


def test_counts_and_sets_are_handed_on_in_small_batches():
    batch = many_texts()
    counted = list(ngram_join._count(iter([batch])))
    sets = list(ngram_join._sets(ngram_join._Naming(frozenset()))(iter([batch])))
    assert max(x.nbytes for x in counted) < 1 << 20 and max(x.nbytes for x in sets) < 2 << 20
    expected = np.sort(np.concatenate(list(ngram_join.shingle_sets(batch.column("_text")))))
    tokens, counts = np.unique(expected[expected < np.uint64(int(ngram_join.COUNTED * 2**64))], return_counts=True)
    got = ngram_join._merged([x.column(0).to_numpy().view(np.uint64) for x in counted], [x.column(1).to_numpy() for x in counted])
    assert (got[0] == tokens).all() and (got[1] == counts).all()
    assert sum(x.num_rows for x in sets) == batch.num_rows


def test_slices_of_cut_and_null_texts():
    """Runs of rows hold the bytes of their rows, for both widths of offsets, cut arrays and nulls; a long text is a run of its own."""
    texts = ["ab", None, "", "c" * 50, "dé", None, "e"]
    for kind in (pa.string(), pa.large_string(), pa.string_view()):
        array = pa.array(["left out", *texts, "too"], kind)[1:-1]
        got = [bytes(data[a:b]).decode() for _, _, data, at in arrays.slices(array, 4) for a, b in zip(at[:-1], at[1:])]
        assert got == [x or "" for x in texts]
        assert list(arrays.slices(array[:0], 4)) == []
    assert [x[:2] for x in arrays.slices(pa.array(texts), 4)] == [(0, 3), (3, 4), (4, 7)]
