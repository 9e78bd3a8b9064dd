import hashlib

from pyspark.sql import functions as F

from cohort_engine.llm import warc

PAGES = "page_id long, url string, html string, payload string, keep int"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], PAGES)


def test_round_trip_with_revisits(spark, tmpdir_path, monkeypatch):
    big, uni = "<p>" + "x" * 1000, "é" * 600
    rows = [(1, "http://a/", big), (9, "http://b/\r\nInjected: 1", big), (5, None, big), (2, "u", "short"), (3, "u", "short"), (4, "u", None),
            (6, "u", ""), (7, "ü", uni), (8, "u", uni), (None, "n", big), (9, "again", big), (10, "u", "y" * 300_000)]
    folder = warc.archive(spark, pages(spark, rows), tmpdir_path + "/w")
    back = spark.read.format("warc").load(folder)
    got = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"],
                  None if r["payload"] is None else bytes(r["payload"]).decode()) for r in back.collect())
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        keep = {big: 9, uni: 8}.get(html)
        again = keep is not None and i != keep
        want.append((i or 0, "revisit" if again else "response", keep if again else None, len(data), hashlib.sha1(data).hexdigest(),
                     None if again else html or ""))
    assert got == sorted(want)
    assert sorted(r["target_uri"] or "" for r in back.select("target_uri").collect())[1] == "again"
    assert back.filter(F.col("target_uri").contains("Injected")).count() == 1     # one header line, no record of its own


def test_filters_reach_the_reader(spark, tmpdir_path):
    folder = warc.archive(spark, pages(spark, [(i, f"http://h/{i % 3}", "z" * 1500 + str(i // 4)) for i in range(40)]), tmpdir_path + "/w")
    back = spark.read.format("warc").option("payload", "skip").load(folder)
    some = back.filter((F.col("record_type") == "revisit") & (F.col("page_id") > 20) & F.col("target_uri").startswith("http://h/1"))
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "record_type" not in plan.split("Filter", 1)[1].split("BatchScan")[0] if "Filter" in plan else True
    assert sorted(r["page_id"] for r in some.collect()) == [i for i in range(21, 40) if i % 4 != 3 and i % 3 == 1]
    assert back.filter(F.col("payload").isNotNull()).count() == 0
    assert back.filter(F.col("page_id").isin(1, 3, 99)).count() == 2


def test_records_follow_the_format():
    row = {"record_type": "response", "target_uri": "u", "page_id": 4, "refers_to": None, "payload": b"abc",
           "payload_digest": hashlib.sha1(b"abc").hexdigest()}
    data = warc.record(row, "2020-01-01T00:00:00Z")
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = warc.parse(head)
    assert data.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and data.endswith(b"\r\n\r\n")
    assert len(rest) == fields["length"] + 4 and rest[:-4].endswith(b"\r\n\r\nabc")
    assert b"WARC-Payload-Digest: sha1:VGMT4NSHA2AWVOR6EVYXQUGCNSONBWE5" in head


def test_empty_table(spark, tmpdir_path):
    folder = warc.archive(spark, pages(spark, []), tmpdir_path + "/none")
    assert spark.read.format("warc").load(folder).count() == 0
