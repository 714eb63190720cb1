import struct

import pytest
import zstandard
from oracle import compare, connect

from quillmesh.llm import warc
from quillmesh.llm.queries import ORACLES, QUERIES

DATE = "2024-01-01T00:00:00Z"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, sf_dir, name):
    """All queries of the subpackage that SQL can state."""
    error, *_ = compare(spark, connect(sf_dir), name, QUERIES[name], ORACLES[name], sf_dir)
    assert error == ""


def archive(tmp_path, records):
    path = f"file://{tmp_path}/a.warc.zst"
    writer = warc.ArchiveWriter(path)
    for r in records:
        writer.add(r)
    writer.close()
    return path


def test_round_trip(tmp_path):
    payloads = [b"", b"\r\n\r\n", "é".encode() * 1000, bytes(range(256)) * 50] + [b"<p>%d</p>" % i * 50 for i in range(300)]
    path = archive(tmp_path, [warc.make_record(i, f"http://x/{i} \n", p, None, False, DATE) for i, p in enumerate(payloads)])
    found = list(warc.read_archive(path, block=1000))
    assert [r.payload for r in found] == payloads and [r.page for r in found] == list(range(len(payloads)))
    assert found[3].url == "http://x/3%20%0A"


def test_layout(tmp_path):
    """A dictionary in a skippable frame, then one frame per record."""
    path = archive(tmp_path, [warc.make_record(i, None, b"text %d" % i * 99, None, False, DATE) for i in range(200)])
    data = open(path.removeprefix("file://"), "rb").read()
    magic, size = struct.unpack("<II", data[:8])
    dictionary = zstandard.ZstdDecompressor().decompress(data[8 : 8 + size])
    assert magic == 0x184D2A5D
    rest, frames = data[8 + size :], 0
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    while rest:
        frame = reader.decompressobj()
        assert frame.decompress(rest).startswith(b"WARC/1.1\r\n")
        rest, frames = frame.unused_data, frames + 1
    assert frames == 200


def test_dictionary_that_is_not_compressed(tmp_path):
    plain = b"WARC/1.1\r\nWARC-Type: response\r\n" * 20
    record = warc.make_record(1, None, b"x", None, False, DATE)
    frame = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(plain)).compress(record)
    path = tmp_path / "p.warc.zst"
    path.write_bytes(struct.pack("<II", 0x184D2A5D, len(plain)) + plain + frame)
    assert next(warc.read_archive(f"file://{path}")).payload == b"x"


GOOD = warc.make_record(7, "http://x", b"payload", None, False, DATE)


@pytest.mark.parametrize(
    "record, message",
    [
        (GOOD[:-1], "Content-Length"),
        (GOOD + b"x", "Content-Length"),
        (GOOD.replace(b"WARC/1.1", b"WARC/9.9"), "no WARC header"),
        (GOOD.replace(b"payload", b"PAYLOAD"), "digest"),
        (GOOD.replace(b"WARC-Date: ", b"WARC-Dote: "), "no WARC-Date"),
        (GOOD.replace(b"WARC-Type: response", b"WARC-Type: strange!"), "record type"),
        (GOOD.replace(b"<urn:page:7>", b"<urn:pg:7>"), "record id"),
        (GOOD.replace(b"WARC-Date: ", b"bad name: "), "header line"),
        (b"", "no WARC header"),
    ],
)
def test_wrong_records(tmp_path, record, message):
    path = archive(tmp_path, [GOOD, record])
    found = warc.read_archive(path)
    assert next(found).payload == b"payload"
    with pytest.raises(ValueError, match=f"record 1: .*{message}"):
        next(found)


def test_wrong_archives(tmp_path):
    path = tmp_path / "x.warc.zst"
    path.write_bytes(b"nothing")
    with pytest.raises(ValueError, match="no dictionary frame"):
        next(warc.read_archive(f"file://{path}"))
    whole = open(archive(tmp_path, [GOOD]).removeprefix("file://"), "rb").read()
    path.write_bytes(whole[:-5])
    with pytest.raises(ValueError, match="frame cut off"):
        next(warc.read_archive(f"file://{path}"))


def test_rows_with_gaps(spark):
    rows = [(5, "u", "same"), (3, None, "same"), (None, "v", "same"), (9, "w", None), (8, "x", ""), (None, "y", "own"), (3, None, "same")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS payload")
    found = {(r.page_id, r.url, r.record_type, r.payload_bytes, r.refers_to) for r in warc.archive_round_trip(df).collect()}
    assert found == {
        (3, None, "response", 4, None), (5, "u", "revisit", 4, 3), (None, "v", "revisit", 4, 3),
        (8, "x", "response", 0, None), (9, "w", "revisit", 0, 8), (None, "y", "response", 3, None),
    }
    limited = {(r.page_id, r.record_type) for r in warc.archive_round_trip(df, least_bytes=4).collect()}
    assert (9, "response") in limited and (5, "revisit") in limited
    assert warc.archive_round_trip(df.limit(0)).count() == 0
