"""What operators leave in the shared folder and in the shuffle folders."""
import os
import time

from cohort_engine.llm import mixing, store


def _files(spark):
    return spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()


def _shuffle_files(spark):
    files = _files(spark)
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def _folder(df):
    return os.path.dirname(df.inputFiles()[0].removeprefix("file://"))


def test_shuffle_files_of_a_written_table_go(spark):
    before, conf = _shuffle_files(spark), spark.conf.get(store.FREED, None)
    out = store.written(spark.range(1000).repartition(5, "id"), "t-freed")
    for _ in range(50):     # they are removed in the background
        if not _shuffle_files(spark) - before:
            break
        time.sleep(0.2)
    assert not _shuffle_files(spark) - before
    assert out.count() == 1000 and spark.conf.get(store.FREED, None) == conf


def test_a_scratch_block_leaves_what_it_keeps(spark):
    with store.scratch(spark, "t-scratch") as keep:
        inside = store.written(spark.range(10), "t-inside")
        with store.scratch(spark, "t-inner") as kept:
            middle = kept(spark.range(7), "t-middle")
        gone, out = _folder(inside), keep(inside.filter("id > 3"), "t-outside")
        assert os.path.isdir(gone) and middle.count() == 7
    assert not os.path.exists(os.path.dirname(gone)) and out.count() == 6
    assert os.path.dirname(_folder(out)) != os.path.dirname(gone)


def test_stored_documents_are_mixed_without_a_copy(spark, documents, monkeypatch):
    rows = [(i % 50, " ".join(f"w{k}" for k in range(5 + i % 40)), "abc"[i % 3]) for i in range(300)] + [(None, None, None), (None, "x y", None)] * 3
    docs = store.written(documents(rows).repartition(4), "t-docs")
    plain = sorted(mixing.mix_documents(spark, docs).collect(), key=str)
    names, write = [], mixing.written
    monkeypatch.setattr(mixing, "written", lambda df, name: names.append(name) or write(df, name))
    assert sorted(mixing.mix_documents(spark, docs, stored=True).collect(), key=str) == plain and plain
    assert "mix-documents" not in names
    names.clear()
    assert mixing.mix_documents(spark, documents(rows), stored=True).count() == len(plain) and "mix-documents" in names
