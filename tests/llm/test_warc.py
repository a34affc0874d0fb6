"""WARC: written and read back, predicates, skipped payloads, foreign files, commits."""

import gzip
import hashlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, IsNull, Not, StringContains, StringStartsWith

from vigilog.llm import warc
from vigilog.llm.queries import QUERIES
from vigilog.sources.shared import new_path

SCHEMA = "page_id bigint, url string, html string"


def plain(rows):
    """page_id, bytes, digest, type, refers_to of rows (page_id, url, html)."""
    bodies = [(p, (h or "").encode()) for p, _, h in rows]
    out = []
    for page, body in bodies:
        latest = max((p for p, b in bodies if b == body and p is not None), default=None)
        again = len(body) >= 1000 and page != latest
        out.append((page, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", latest if again else None))
    return out


def order(rows):
    return sorted(map(tuple, rows), key=str)


def archived(spark, pages, **options):
    warc.register(spark)
    path = new_path(spark, "warc-test")
    warc.records(pages).write.format("warc").mode("append").options(**options).save(path)
    return path


def back(spark, path):
    found = warc.verified(spark.read.format("warc").load(path))
    return found.select(warc.page_of(F.col("record_id")), "payload_bytes", "payload_digest", "type", warc.page_of(F.col("refers_to")))


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_round_trip(spark, compression):
    long = "ä" * 600
    rows = [(1, "http://a/\r\nX: y", long), (2, None, long), (2, None, long), (None, "u", long), (3, "u", "short"), (4, "u", "short"),
            (5, "u", None), (6, "u", ""), (7, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 200), (None, "v", "n" * 1000), (-9, "v", "x" * 999),
            (10, "http://ü", "y" * 3_000_000)]
    pages = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 type", "2 payload", "3 key", "4 latest", "5 copied")
    path = archived(spark, pages, compression=compression, fileBytes="2000")
    assert order(back(spark, path).collect()) == order(plain(rows))
    texts = {r.record_id: bytes(r.payload).decode() for r in spark.read.format("warc").load(path).filter("type = 'response'").collect()}
    assert texts["<urn:page:10>"] == rows[-1][2] and texts["<urn:page:7>"] == rows[8][2]


def test_empty_table(spark):
    path = archived(spark, spark.createDataFrame([], SCHEMA))
    assert back(spark, path).collect() == []


def test_predicates_reach_the_reader(spark):
    rows = [(i, f"http://h{i % 3}/", f"{'x' * 1200}{i % 5}") for i in range(20)]
    path = archived(spark, spark.createDataFrame(rows, SCHEMA))
    read = spark.read.format("warc").load(path)
    some = read.filter((F.col("type") == "revisit") & F.col("target_uri").startswith("http://h1"))
    want = [r for r in plain(rows) if r[3] == "revisit" and r[0] % 3 == 1]
    assert some.count() == len(want) > 0
    assert "Filter" not in some._jdf.queryExecution().optimizedPlan().toString().split("\n")[0]  # all of it was pushed


def test_predicates_and_skips_without_spark(tmp_path):
    writer = warc.WarcWriter(str(tmp_path), False, False, 1 << 20)
    records = [writer.record({"record_id": f"<urn:page:{i}>", "type": "response", "payload": b"p" * 50_000, "target_uri": None if i % 2 else f"u{i}"}) for i in range(6)]
    (tmp_path / "a.warc").write_bytes(b"".join(records))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    (tmp_path / "notes.txt").write_bytes(b"no archive")

    def ids(*tests, names="record_id string"):
        from pyspark.sql.types import StringType, StructField, StructType

        reader = warc.WarcReader(str(tmp_path), StructType([StructField("record_id", StringType())]), 1 << 30)
        assert list(reader.pushFilters(list(tests))) == []
        (part,) = reader.partitions()
        return sorted(x for b in reader.read(part) for x in b.column(0).to_pylist())

    every = sorted(f"<urn:page:{i}>" for i in range(6) for _ in "ab")
    assert ids() == every
    assert ids(IsNull(("target_uri",))) == [x for x in every if int(x[10]) % 2]
    assert ids(Not(EqualTo(("target_uri",), "u2"))) == [x for x in every if x[10] in "04"]
    assert ids(In(("target_uri",), ("u2", None)), IsNotNull(("target_uri",))) == ["<urn:page:2>"] * 2
    assert ids(StringStartsWith(("target_uri",), "u"), GreaterThan(("content_length",), 10)) == [x for x in every if not int(x[10]) % 2]
    assert ids(StringContains(("record_id",), "page:3")) == ["<urn:page:3>"] * 2
    reader = warc.WarcReader(str(tmp_path), warc_schema(), 1 << 30)
    assert list(reader.pushFilters([EqualTo(("payload_bytes",), 3)])) == [EqualTo(("payload_bytes",), 3)]
    # A skipped block of a plain file isn't read.
    with open(tmp_path / "a.warc", "rb") as file:
        import pyarrow as pa

        lines = warc._Lines(pa.PythonFile(file, "r"))
        while (head := warc._head(lines)) is not None:
            lines.skip(int(head["content-length"]))
        assert lines.tell() >= len(b"".join(records)) - 4


def warc_schema():
    from pyspark.sql.types import LongType, StructField, StructType

    return StructType([StructField("payload_bytes", LongType())])


def test_foreign_records(spark, tmp_path):
    record = b"WARC/1.0\r\nWARC-Type: resource\r\nwarc-record-id: <a>\r\nX-Long: one\r\n two\r\nContent-Type: text/plain\r\nContent-Length: 3\r\nWARC-Payload-Digest: sha1:" + b"A" * 40 + b"\r\n\r\nabc\r\n\r\n"
    (tmp_path / "x.warc").write_bytes(record * 2)
    warc.register(spark)
    rows = spark.read.format("warc").load(f"file://{tmp_path}").orderBy("offset").collect()
    assert [(r.record_id, r.type, bytes(r.payload), r.headers["x-long"], r.payload_digest) for r in rows] == [("<a>", "resource", b"abc", "one two", "a" * 40)] * 2
    assert [r.offset for r in rows] == [0, len(record) - 4]
    (tmp_path / "x.warc").write_bytes(record[:-6])
    with pytest.raises(Exception, match="ends inside a record"):
        spark.read.format("warc").load(f"file://{tmp_path}").collect()


def test_files_without_commit_are_not_read(spark, tmp_path):
    writer = warc.WarcWriter(str(tmp_path), False, True, 1 << 20)
    row = {"record_id": "<urn:page:1>", "type": "response", "payload": b"x"}
    import pyarrow as pa

    batch = pa.RecordBatch.from_pylist([row])
    lost, kept = writer.write(iter([batch])), writer.write(iter([batch]))
    writer.commit([kept, None])
    warc.register(spark)
    assert spark.read.format("warc").load(f"file://{tmp_path}").count() == 1
    writer.abort([lost])
    assert len(list(tmp_path.glob("*.gz"))) == 1
    over = warc.WarcWriter(str(tmp_path), True, True, 1 << 20)
    over.commit([over.write(iter([batch, batch]))])
    assert spark.read.format("warc").load(f"file://{tmp_path}").count() == 2
    assert len(list(tmp_path.glob("*.gz"))) == 1


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").collect()]
    assert order(QUERIES["op12_warc"](spark, sf_dir).collect()) == order(plain(rows))
