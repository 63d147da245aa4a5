import pyarrow as pa

from corvine.operators import chunking


def test_a_large_batch_is_cut_in_parts_and_stays_whole():
    texts = [f"# h{i}\n" + f"some words of {i}. " * 20 for i in range(1001)]
    batch = pa.RecordBatch.from_pydict({"source_path": [str(i) for i in range(1001)], "text": texts})
    rules = chunking.ChunkRules()
    out = list(chunking._chunk_batches(rules)(iter([batch])))
    assert max(b.num_rows for b in out) <= 200
    got = [r for b in out for r in b.to_pylist()]
    assert [r["source_path"] for r in got] == [str(i) for i in range(1001)]
    assert [r["pieces"] for r in got] == [chunking.chunk_text(t, rules) for t in texts]
