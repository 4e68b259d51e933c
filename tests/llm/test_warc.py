import gzip
import hashlib

from pyspark.sql import functions as F

from tessera.llm.queries import digest_captures
from tessera.llm.shared import shared_folder
from tessera.llm.warc import assemble, parse, read_warc, write_warc


def captures(spark, pages, **more):
    path = shared_folder(spark)
    write_warc(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3), path)
    return assemble(read_warc(spark, path, **more)), path


def test_round_trip_with_awkward_payloads(spark):
    long = "ü\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" * 60
    pages = [(1, "http://a/x y?q=1", long), (2, "http://b/", long), (7, None, long), (3, "http://c", "small"), (4, "http://d", "small"), (5, "é", None), (6, "http://e\r\nX: y", ""), (8, "http://f", "z" * 3_000_000)]
    got, path = captures(spark, pages)
    rows = {r.metadata[0].fields["page-id"]: r for r in got.collect()}
    assert len(rows) == len(pages)
    for i, _, html in pages:
        r = rows[str(i)]
        if r.type == "response":
            assert bytes(r.response.payload) == (html or "").encode() and r.response.digest_ok
        assert r.request.type == "request"
    out = {r.page_id: r for r in digest_captures(got).collect()}
    assert {i: (r.record_type, r.refers_to) for i, r in out.items()} == {1: ("revisit", 7), 2: ("revisit", 7), 7: ("response", None), **{i: ("response", None) for i in (3, 4, 5, 6, 8)}}
    for i, _, html in pages:
        raw = (html or "").encode()
        assert (out[i].payload_bytes, out[i].payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())


def test_reads_records_that_are_gzip_members_and_links_from_the_capture(spark, tmp_path):
    rec = lambda kind, i, more, block: (f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {i}\r\n{more}Content-Type: application/http\r\nContent-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"
    body = [rec("request", "<r>", "", b"GET / HTTP/1.1\r\n\r\n"), rec("response", "<c>", "WARC-Concurrent-To: <r>\r\nWARC-Concurrent-To: <m>\r\n", b"HTTP/1.1 200 OK\r\n\r\nhi"), rec("metadata", "<m>", "", b"")]
    assert len(list(parse(b"".join(body)))) == 3
    (tmp_path / "x.warc.gz").write_bytes(b"".join(map(gzip.compress, body)))
    r = assemble(read_warc(spark, f"file://{tmp_path}")).first()
    assert (bytes(r.response.payload), r.request.record_id, [m.record_id for m in r.metadata]) == (b"hi", "<r>", ["<m>"])


def test_empty_null_and_repeated(spark):
    assert captures(spark, [])[0].collect() == []
    got = digest_captures(captures(spark, [(None, "u", "x" * 2000), (None, "v", "x" * 2000), (4, "u", "y"), (4, "u", "y")], payload=False)[0])
    assert sorted(((r.page_id, r.record_type) for r in got.collect()), key=str) == [(4, "response"), (4, "response"), (None, "response"), (None, "response")]


def test_files_are_bounded_and_ties_and_other_columns_are_harmless(spark, tmp_path):
    pages = [(i, f"http://a/{i}", f"{i} " * 2000, 1, 2) for i in range(40)] + [(90, "http://b", "x" * 3000, 1, 2), (90, "http://c", "x" * 3000, 1, 2), (3, "http://d", "x" * 3000, 1, 2), (3, "http://d", "x" * 3000, 1, 2)]
    path = shared_folder(spark)
    write_warc(spark.createDataFrame(pages, "page_id long, url string, html string, n int, digest int").coalesce(1), path, file_bytes=50_000)
    sizes = [len(gzip.decompress(bytes(r.content))) for r in spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where("path like '%.gz'").collect()]
    assert len(sizes) > 4 and max(sizes) < 60_000
    got = digest_captures(assemble(read_warc(spark, path, payload=False)))
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in got.collect() if r.payload_bytes == 3000) == sorted([(90, "response", None), (90, "response", None), (3, "revisit", 90), (3, "revisit", 90)], key=lambda r: (r[0], r[1]))
    assert got.count() == len(pages)
    (tmp_path / "none").mkdir()
    assert read_warc(spark, f"file://{tmp_path}/none").collect() == []


def record(kind, i, block=b"", length=None, **more):
    head = {"WARC-Type": kind, "WARC-Record-ID": i, **{k.replace("_", "-"): v for k, v in more.items()}, "Content-Length": len(block) if length is None else length}
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n").encode() + block + b"\r\n\r\n"


def test_damaged_archives_give_what_can_be_read_and_say_what_is_wrong(spark, tmp_path):
    good = [record("resource", f"<{i}>", b"x" * 50_000 + bytes(str(i), "ascii")) for i in range(10)]
    noise = hashlib.sha512(b"n").digest() * 3000
    whole, members = gzip.compress(b"".join(good)), b"".join(map(gzip.compress, good))
    files = {
        "whole.gz": (whole, 10, None), "members.gz": (members, 10, None), "plain.warc": (b"".join(good), 10, None), "empty.warc": (b"", 0, None),
        "length.gz": (gzip.compress(good[0] + record("resource", "<bad>", b"x", "12a") + good[1]), 1, "Content-Length is no number"),
        "negative.warc": (good[0] + record("resource", "<bad>", b"x", "-1"), 1, "Content-Length is no number"),
        "cut.gz": (gzip.compress(b"".join(good[:3]) + record("resource", "<n>", noise))[:-200], 3, "the gzip stream ends early"),
        "cut.warc": (b"".join(good)[:-5000], 9, "a record ends early"),
        "tail.gz": (members + b"no gzip at all" * 20, 10, "no gzip data"),
        "tail.warc": (b"".join(good) + b"rest", 10, "bytes behind the last record"),
        "header.warc": (good[0] + b"HTTP/1.1 200 OK\r\n\r\n" + good[1], 1, "a record has no WARC header"),
        "trailer.gz": (whole[:-4], 10, "the gzip stream ends early"),
    }
    for name, (data, _, _) in files.items():
        (tmp_path / name).write_bytes(data)
    rows = {}
    for r in read_warc(spark, f"file://{tmp_path}").collect():
        rows.setdefault(r.file.rsplit("/", 1)[1], []).append(r)
    for name, (_, n, error) in files.items():
        own = rows.get(name, [])
        assert sum(r.type == "resource" for r in own) == n, name
        assert [r.error and r.error.startswith(error) and r.type is None and r.at >= 0 for r in own if r.error] == ([True] if error else []), name
    at = {r.record_id: r.at for r in rows["length.gz"]}
    assert at == {"<0>": 0, None: len(good[0])}
    assert assemble(read_warc(spark, f"file://{tmp_path}")).collect() == []


def test_equal_rows_have_one_metadata_record_each(spark):
    pages = [(4, "http://u", "y" * 10)] * 1000 + [(5, "http://u", "z" * 2000)] * 3 + [(6, "http://u", "z" * 2000)] * 2
    got, _ = captures(spark, pages)
    rows = got.selectExpr("metadata[0].fields['page-id'] as page", "size(metadata) as n", "request is not null as asked").groupBy("page", "n", "asked").count().collect()
    assert sorted(tuple(r) for r in rows) == [("4", 1, True, 1000), ("5", 1, True, 3), ("6", 1, True, 2)]


def test_metadata_records_that_differ_all_stay(spark, tmp_path):
    fields = {"Content_Type": "application/warc-fields", "WARC_Concurrent_To": "<c>"}
    body = [record("response", "<c>", b"HTTP/1.1 200 OK\r\n\r\nhi", Content_Type="application/http")] + [record("metadata", i, b"k: " + v + b"\r\n", **fields) for i, v in (("<m1>", b"a"), ("<m2>", b"a"), ("<m1>", b"a"), ("<m1>", b"b"))]
    (tmp_path / "x.warc").write_bytes(b"".join(body))
    (row,) = assemble(read_warc(spark, f"file://{tmp_path}")).collect()
    assert sorted((m.record_id, m.fields["k"]) for m in row.metadata) == [("<m1>", "a"), ("<m1>", "b"), ("<m2>", "a")]
