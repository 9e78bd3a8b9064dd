import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from cohort_engine.llm import tokenstore as T

PATH = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(PATH)


def test_pieces_give_the_tokenizer_s_ids(tokenizer, monkeypatch):
    texts = ["", " ", "a", "  two  spaces ", "don't 's x  y", "é è  ñ　 b", "line\n\nnext \t tab", "<|endoftext|> plain", "a <|endoftext|>b", "x  <|endoftext|><|endoftext|>  y <|endo ftext|>", "q<|endoftext|>" * 3, "emoji 😀 x😀 y",
             "x\x1c y\x85 z", "1 22  333", None, "word " * 500]
    enc = T.Encoder(PATH)
    for _ in range(2):                                   # the second time from what is known
        ids, ptr = enc.encode(pa.array(texts))
        for i, t in enumerate(texts):
            assert ids[ptr[i]:ptr[i + 1]].tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids
    monkeypatch.setattr(T, "CACHE_PIECES", 1)            # forgetting changes nothing
    ids2, _ = enc.encode(pa.array(texts))
    assert ids2.tolist() == ids.tolist()


def test_index_is_minimal_and_perfect():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 1000):
        keys = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        sizes, bits, slot = T.build_index(keys)
        assert sorted(slot.tolist()) == list(range(len(keys)))
        flat = np.unpackbits(bits).astype(bool)
        assert T.find_slots(keys, sizes, flat, np.concatenate([[0], np.cumsum(flat)])).tolist() == slot.tolist()


@pytest.mark.parametrize("shard_ids", [T.SHARD_IDS, 3000])
def test_store_round_trip(spark, tokenizer, tmpdir_path, shard_ids):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(5)
    manifest = T.write_store(docs, tmpdir_path, PATH, shard_ids=shard_ids)
    got = {r["doc_id"]: r for r in T.read_store(manifest).collect()}
    start = 0
    for r in sorted(docs.select("doc_id", "text").collect()):
        ids = np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        assert tuple(got[r["doc_id"]])[1:] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    keys = spark.createDataFrame([(0,), (7,), (199,), (10**9,), (-3,), (None,)], "doc_id long")
    found = {r["doc_id"]: r["ids"] for r in T.lookup(manifest, keys).collect()}
    assert sorted(found) == [0, 7, 199] and all(len(v) == got[k]["n_tokens"] and v[-1] == 2 for k, v in found.items())


def test_special_tokens_keep_their_id(tokenizer):
    ids, _ = T.Encoder(PATH).encode(pa.array(["a <|endoftext|>b"]))
    assert ids.tolist() == tokenizer.encode("a <|endoftext|>b", add_special_tokens=False).ids == [64, 220, 50256, 65]


def test_many_empty_and_one_long_text(spark, documents, tokenizer, tmpdir_path):
    """Shards close by documents too; a long text is one document of one shard."""
    long = "word é  \n x1 " * 60_000
    docs = documents([(i, "" if i % 2 else None) for i in range(250)] + [(900, long)]).coalesce(1)
    manifest = T.write_store(docs, tmpdir_path, PATH, shard_docs=100)
    shards = manifest.collect()
    assert max(r["docs"] for r in shards) <= 100 and sum(r["docs"] for r in shards) == 251
    rows = {r["doc_id"]: r for r in T.read_store(manifest).collect()}
    want = np.array([*tokenizer.encode(long, add_special_tokens=False).ids, 2], "<u4")
    assert tuple(rows[900])[1:] == (250, len(want), zlib.crc32(want.tobytes())) and all(rows[i]["n_tokens"] == 1 for i in range(250))


def test_edges(spark, documents, tmpdir_path):
    docs = documents([(3, "c"), (None, "n"), (1, None), (3, "c"), (2, ""), (None, "m")])
    manifest = T.write_store(docs, tmpdir_path, PATH)
    rows = sorted(T.read_store(manifest).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, None, 1, 2, 3, 3] and [r["n_tokens"] for r in rows] == [2, 2, 1, 1, 2, 2]
    assert [r["doc_id"] for r in T.lookup(manifest, docs.select("doc_id")).sort("doc_id").collect()] == [1, 2, 3]
    none = T.write_store(documents([]), tmpdir_path + "/none", PATH)
    assert T.read_store(none).count() == 0 and T.lookup(none, docs.select("doc_id")).count() == 0


def test_rows_come_through_the_index(spark, documents, tmpdir_path):
    manifest = T.write_store(documents([(k, f"text {k}") for k in range(9)]).coalesce(1), tmpdir_path, PATH)
    assert T.read_store(manifest).count() == 9
    for r in manifest.collect():
        path = r["path"].removeprefix("file:")
        data = bytearray(open(path, "rb").read())
        data[-4 * r["docs"]:] = bytes(4 * r["docs"])      # the index names document 0 for all keys
        open(path, "wb").write(data)
    with pytest.raises(Exception, match="not in the index"):
        T.read_store(manifest).collect()
