import base64
import hashlib
import os

import pytest

from millrace.llm import warc
from millrace.llm.common import shared_dir, table


def brute(rows, least=0):
    out = []
    for i, _, h in rows:
        p = (h or "").encode()
        ids = [j for j, _, g in rows if (g or "").encode() == p and j is not None]
        head = max(ids, default=None) if len(p) >= least else None
        revisit = head is not None and i != head
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if revisit else "response", head if revisit else None))
    return sorted(out, key=repr)


TRAP = "x\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0\r\n"
ROWS = [
    (1, "http://a/1", "<p>é</p>"), (2, None, "<p>é</p>"), (9, "http://a/ b\n", "<p>é</p>"), (9, "http://a/ b\n", "<p>é</p>"), (3, "u", None), (4, "u", ""), (None, "u", "only"),
    (None, "u", "<p>é</p>"), (5, "u", TRAP), (6, "u", TRAP + TRAP), (7, "u", "\r\n\r\n"), (8, "u", "WARC/1.0\r\nContent-Length: 9\r\n\r\nq"), (10, "u", "long " * 50_000), (-3, "u", "neg"),
    (11, "u", TRAP), (12, "u", "ends\r\n\r\nWARC/1.0\r\n"), (13, "u", "\r\n\r\nWARC/1.0\r\n\r\n\r\nWARC/1.0\r\nContent-Length: 999999\r\n\r\n"),
]


def trip(spark, df, path, **options):
    warc.write_archives(df, path, **options)
    return sorted(((r.id, r.bytes, r.sha, r.type, r.refers) for r in warc.read_archives(spark, path).collect()), key=repr)


@pytest.mark.parametrize("options", [{}, {"records_per_file": 3}, {"compression": "none"}, {"min_revisit_bytes": 5}])
def test_round_trip(spark, tmp_path, options):
    df = spark.createDataFrame([(*r, "k") for r in ROWS], "page_id long, url string, html string, value string").coalesce(2)
    assert trip(spark, df, str(tmp_path / "w"), **options) == brute(ROWS, options.get("min_revisit_bytes", 0))


def test_split_files_and_false_records(spark, tmp_path):
    """Uncompressed archives are read in parallel splits that begin anywhere, also inside a payload full of magic."""
    rows = [(i, "u", (TRAP + str(i)) * (i % 7) + "y" * (i * 37 % 900)) for i in range(150)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        assert trip(spark, df, str(tmp_path / "w"), compression="none") == brute(rows)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_records_are_valid(spark, tmp_path):
    df = spark.createDataFrame(ROWS[:2], "page_id long, url string, html string").coalesce(1)
    warc.write_archives(df, str(tmp_path / "w"), compression="none")
    (name,) = [f for f in os.listdir(tmp_path / "w") if f.startswith("part-")]
    raw = (tmp_path / "w" / name).read_bytes()
    assert raw.startswith(b"WARC/1.0\r\nWARC-Type: re") and raw.endswith(b"\r\n\r\n") and raw.count(b"WARC-Record-ID: <urn:uuid:") == 2
    assert raw.count(b"WARC-Type: revisit") == 1


def test_truncated_archives_are_refused(spark, tmp_path):
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "a.txt").write_bytes(b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 50\r\n\r\nshort")
    with pytest.raises(Exception, match="inside a record"):
        warc.read_archives(spark, str(tmp_path / "w")).collect()


def test_empty(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert trip(spark, df, str(tmp_path / "w")) == []


def test_query_removes_its_archives(spark):
    rows = warc.op10(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == table(spark, "/root/testdata/sf0.001", "pages").count()
    assert not [d for d in os.listdir(shared_dir(spark).removeprefix("file:")) if d.startswith("warc-")]
