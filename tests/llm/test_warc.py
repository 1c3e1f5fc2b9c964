import base64
import glob
import gzip
import hashlib
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from spreadloom.llm import warc

SF = "/root/testdata/sf0.01"


def slow(rows, least=0):
    groups = {}
    for page_id, _, html in rows:
        groups.setdefault((html or "").encode(), []).append(page_id)
    out = []
    for data, ids in groups.items():
        sha = base64.b32encode(hashlib.sha1(data).digest()).decode()
        ids = sorted(ids, key=lambda i: (i is None, i or 0))
        out += [(i, len(data), sha, "response", None) if k == 0 or len(data) < least else (i, len(data), sha, "revisit", ids[0]) for k, i in enumerate(ids)]
    return sorted(out, key=repr)


PAGES = [
    (5, "http://a/é x?q=1\r\nX: y", "<p>é\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n\0</p>"), (3, "http://b/", "<p>é\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n\0</p>"),
    (11, "u", None), (12, None, ""), (2, "u", ""), (4, "u", "x" * 3_000_000), (40, "v", "x" * 3_000_000), (7, "w", "twice"), (7, "w", "twice"), (None, "n", "twice"), (None, None, "alone"),
    *[(100 + k, "c", "copy") for k in range(50)], (99, "c", "copy"), (1000, "c", "copy "),
]


def rows_of(df):
    return sorted((tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in df.collect()), key=repr)


@pytest.mark.parametrize("size", [warc.ARCHIVE_BYTES, 200])
def test_edges(spark, tmp_path, size):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").select("*", F.lit(1).alias("digest"), F.lit("z").alias("path")).repartition(3)
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    assert rows_of(warc.op12_warc(spark, str(tmp_path))) == slow(PAGES)
    raw, lean, again = (str(tmp_path / n) for n in ("raw", "lean", "again"))
    warc.write(pages, raw, most=size)
    warc.deduplicate(spark, raw, lean, 5, most=size)
    back = warc.resolve(warc.headers(spark, lean), 5).withColumnsRenamed({"digest": "payload_digest"})
    assert rows_of(back.withColumns({c: F.col(c).cast("long") for c in ("page_id", "refers_to")})) == slow(PAGES, 5)
    # what is there already stays when archives are deduplicated again, and every payload comes back whole
    warc.deduplicate(spark, lean, again, 5)
    kinds = [sorted((h["warc-type"], h.get("warc-page-id", ""), h.get("warc-refers-to-page-id", "")) for h, _ in read(f)) for f in (lean, again)]
    assert kinds[0] == kinds[1]
    kept = sorted(warc.payload_of(h, b).decode() for h, b in read(again) if h["warc-type"] == "response")
    assert kept == sorted([*{h or "" for _, _, h in PAGES if len(h or "") >= 5}, *[h or "" for _, _, h in PAGES if len(h or "") < 5]])
    if size == 200:
        assert len(glob.glob(f"{raw}/part-*")) > 4


def read(folder):
    for f in glob.glob(f"{folder}/part-*"):
        data = open(f, "rb").read()
        records = [(h, b) for _, h, b in warc.members(data)]
        # members are plain gzip that any reader takes
        assert gzip.decompress(data).count(b"WARC/1.1\r\nWARC-Type: ") >= len(records)
        yield from records


def test_damage_is_seen(spark, tmp_path):
    whole = warc.record("response", {"WARC-Record-ID": "<x>", "WARC-Payload-Digest": "sha1:" + "A" * 32}, b"abc")
    for k, data in enumerate((whole, whole[:-20])):
        (tmp_path / str(k)).mkdir()
        (tmp_path / str(k) / "part-0").write_bytes(data)
        with pytest.raises(Exception, match="digest" if not k else "end|cut"):
            warc.headers(spark, str(tmp_path / str(k))).collect()


def test_empty_and_query(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert warc.op12_warc(spark, str(tmp_path)).collect() == []
    c = duckdb.connect()
    c.sql(f"create view pages as from '{SF}/pages.parquet'")
    got, want = warc.op12_warc(spark, SF), c.sql(warc.OP12_SQL)
    assert got.columns == want.columns
    assert rows_of(got) == sorted(want.fetchall(), key=repr)
    assert os.path.isdir(SF)
