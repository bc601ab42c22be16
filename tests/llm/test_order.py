import glob

import numpy as np
import pytest

from scriptorium.llm import order
from scriptorium.llm.bpe import vocabulary
from scriptorium.llm.common import new_dir, written


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 63, 64, 65, 1000, 4097])
def test_feistel_is_a_permutation(n):
    assert sorted(order.feistel(np.arange(n), n)) == list(range(n))


def test_feistel_depends_on_its_key_and_spreads():
    a, b = order.feistel(np.arange(5000), 5000, 1), order.feistel(np.arange(5000), 5000, 2)
    assert (a != b).mean() > 0.99 and abs(np.corrcoef(a, np.arange(5000))[0, 1]) < 0.05


def test_shards(spark):
    import public_tokenizers
    import tiktoken

    ranks = vocabulary()[0]
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {1: "hello world\nfoo " * 50, 2: "", 3: None, 4: "x", 5: "line\n" * 30, None: "key"}
    df = spark.createDataFrame([(k, t, 1) for k, t in texts.items()], "doc_id long, text string, slot int")
    path, raw = new_dir(spark, "test-order"), new_dir(spark, "test-raw")
    schema = order.write_shards(df, path, shard_rows=5, length=16)
    rows = order.read_from(spark, path, schema).collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows))) and all(r.slot // 5 == r.shard for r in rows)
    for k, t in texts.items():
        own = sorted((r for r in rows if r.doc_id == k), key=lambda r: r.seq_no)
        ids = [i for r in own for i in np.frombuffer(bytes(r.record), "<u2")[: r.n_tokens]]
        assert ids == library.encode_ordinary(t or "") and all(len(r.record) == 32 for r in own)
    assert sorted(r.slot for r in order.read_from(spark, path, schema, 7, 5).collect()) == list(range(7, len(rows)))
    order.write_raw(spark, path, raw)
    files = {int(f.split("shard=")[1].split("/")[0]): open(f, "rb").read() for f in glob.glob(raw.removeprefix("file://") + "/shard=*/part*")}
    for r in rows:
        at = r.slot % 5 * 33
        assert files[r.shard][at : at + 32] == bytes(r.record)


def test_query(spark):
    rows = order.op4_training_order(spark, "/root/testdata/sf0.001").collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    assert len({(r.doc_id, r.seq_no) for r in rows}) == len(rows)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert order.with_slots(written(order.sequences(empty), "test-empty")).count() == 0
    path = new_dir(spark, "test-order")
    assert order.read_from(spark, path, order.write_shards(empty, path)).count() == 0
