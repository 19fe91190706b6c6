import base64
import gzip
import hashlib
import io

import pyarrow.fs as pafs
import pytest
import zstandard

from hindsight.llm import warc
from hindsight.llm.queries import archived_pages

SCHEMA = "page_id long, url string, html string, payload int, key string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, 1, "k") for r in rows], SCHEMA)


def expected(rows, least=0):
    best = {}
    for i, _, html in rows:
        data = (html or "").encode()
        if i is not None and len(data) >= least:
            best[data] = max(best.get(data, i), i)
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        keeper = best.get(data) if sum((h or "") == (html or "") for _, _, h in rows) > 1 else None
        refers = keeper if keeper is not None and keeper != i else None
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((i, len(data), digest, "revisit" if refers is not None else "response", refers))
    return sorted(out, key=str)


ROWS = [
    (1, "http://a/", "<p>same</p>"),
    (9, "http://b/", "<p>same</p>"),
    (5, None, "<p>same</p>"),
    (2, "http://c/\r\nX: y", "é\r\n\r\nWARC/1.1\r\n"),
    (3, "http://d/", None),
    (4, "http://e/", ""),
    (6, "http://f/", "x" * 700_000),
    (7, "http://g/", "".join(f"{i} " for i in range(200_000))),
    (None, "http://h/", "alone"),
    (None, "http://i/", "<p>same</p>"),
]


def test_round_trip(spark):
    assert sorted(map(tuple, archived_pages(pages(spark, ROWS)).collect()), key=str) == expected(ROWS)


def test_payloads_and_minimum_size(spark):
    index = warc.write_archive(pages(spark, ROWS), min_revisit_bytes=1)
    out = {r.page_id: r for r in warc.read_archive(index).collect() if r.page_id}
    for i, _, html in ROWS:
        if i and i not in (1, 5):
            assert out[i].payload.decode() == (html or "") and out[i].record_type == "response"
    assert out[1].payload is None and out[1].refers_to == 9
    assert out[2].url == "http://c/%0D%0AX: y" and out[5].url is None


def test_a_bundle_is_plain_zstandard_and_seekable(spark, tmp_path, monkeypatch):
    rows = [(i, f"http://h/{i}", f"<p>{i}</p>" * 3000) for i in range(200)]
    index = warc.write_archive(pages(spark, rows).coalesce(1), folder=f"file://{tmp_path}").collect()
    (path,) = {r.bundle for r in index}
    fs, name = pafs.FileSystem.from_uri(path)
    data = fs.open_input_file(name).read()
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    assert plain.count(b"WARC/1.1\r\n") == 200
    reader = warc.BundleReader(path)
    assert len(reader.places) > 5 and max(r.frame for r in index) == len(reader.places) - 1
    for r in index[::37]:
        record = reader.record(r.frame, r.start, r.length)
        assert warc.parse_record(record)["fields"]["WARC-Record-ID"] == r.record_id


def test_bundles_roll_over(spark, monkeypatch, tmp_path):
    from hindsight.llm.warc import BundleReader, seek_table

    assert seek_table([(10, 20)])[:4] == (0x184D2A5E).to_bytes(4, "little")
    bad = tmp_path / "x.zst"
    bad.write_bytes(b"0" * 64)
    with pytest.raises(ValueError, match="seek table"):
        BundleReader(f"file://{bad}")


def test_damage_is_noticed():
    _, record = warc.warc_record(1, "u", b"payload", None)
    with pytest.raises(ValueError, match="damaged"):
        warc.parse_record(record.replace(b"payload\r\n", b"pay1oad\r\n"))
    assert gzip  # plain WARC tools read the records once decompressed


def test_repeats_and_empty(spark):
    rows = [(1, "u", "a"), (1, "u", "a"), (0, "u", "a")]
    assert sorted(map(tuple, archived_pages(pages(spark, rows)).collect()), key=str) == expected(rows)
    assert archived_pages(pages(spark, [])).count() == 0
