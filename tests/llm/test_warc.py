"""Archives: records read back, determinism, commit and damage, against brute force."""

import gzip
import hashlib
import io
import random
from pathlib import Path

import pytest

from cellweave.llm import warc_files
from cellweave.llm.warc_files import manifest, read_warc, write_warc


def rows_of_pages():
    r = random.Random(3)
    big = ["x" * 1000, "é" * 600, "y" * 5000 + "\r\n\r\nWARC/1.1\r\n", "".join(r.choice("ab \n<>") for _ in range(70_000))]
    rows = [(i, f"http://h/{i} a\r\nX-Page-Id: 7", big[i % 4] if i % 3 else f"<p>{i}</p>" * (i % 150)) for i in range(400)]
    rows += [(1000 + i, None, "hot" * 500) for i in range(300)] + [(2000, "http://n", None), (2001, "http://e", ""), (2002, "u", "z" * 999), (2003, "u", "z" * 999)]
    rows += [(None, "http://null", "hot" * 500), (None, None, None), (3000, "http://twice", "hot" * 500), (3000, "http://twice", "hot" * 500), (5, "http://other", "other"), (5, "http://other", "other")]
    return rows


def brute(rows):
    top = {}
    for i, _, html in rows:
        if i is not None:
            top[html or ""] = max(top.get(html or "", i), i)
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        visit = i is not None and len(data) >= 1000 and i < top[html or ""]
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if visit else "response", top[html or ""] if visit else None))
    return sorted(map(repr, out))


@pytest.fixture
def pages(spark):
    return spark.createDataFrame([(*r, 1, "x") for r in rows_of_pages()], "page_id long, url string, html string, payload int, kind string").repartition(5)


def found(df):
    return sorted(repr((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])) for r in df.collect())


@pytest.mark.parametrize("share", [1000, 4])
def test_pages_come_back(spark, pages, tmp_path, monkeypatch, share):
    monkeypatch.setattr(warc_files, "RANGE_BYTES", 300_000)
    monkeypatch.setattr(warc_files, "HOT_SHARE", share)
    rows = rows_of_pages()
    path = write_warc(pages, f"file://{tmp_path}/a", file_bytes=20_000)
    assert found(read_warc(spark, path)) == brute(rows)
    files = manifest(spark, path).orderBy("bucket", "seq").collect()
    assert len({f["bucket"] for f in files}) > 5 and max(f["seq"] for f in files) > 0
    ids = [(f["first_id"], f["last_id"]) for f in files if f["first_id"] is not None]
    assert all(a <= b for a, b in ids) and all(x[1] <= y[0] for x, y in zip(ids, ids[1:], strict=False))
    for f in files:
        data = Path(tmp_path, "a", f["file"]).read_bytes()
        assert (len(data), hashlib.sha256(data).hexdigest()) == (f["bytes"], f["sha256"])
        assert gzip.decompress(data).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")
    assert {p.name for p in Path(tmp_path, "a").iterdir()} == {f["file"] for f in files} | {"manifest"}
    texts = {(r["page_id"], r["payload"].decode()) for r in read_warc(spark, path, payloads=True).where("record_type = 'response' and page_id is not null").collect()}
    assert texts == {(i, h or "") for i, _, h in rows if i is not None and not (len((h or "").encode()) >= 1000 and i < max(j for j, _, g in rows if j is not None and g == h))}
    urls = {r["url"] for r in read_warc(spark, path).collect()}
    assert "http://h/3%20a%0D%0AX-Page-Id:%207" in urls and None in urls


def test_equal_rows_give_equal_files(spark, pages, tmp_path, monkeypatch):
    monkeypatch.setattr(warc_files, "RANGE_BYTES", 300_000)
    one = write_warc(pages, f"file://{tmp_path}/a", file_bytes=20_000)
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        two = write_warc(pages.coalesce(1).orderBy("html"), f"file://{tmp_path}/b", file_bytes=20_000)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted(manifest(spark, one).collect()) == sorted(manifest(spark, two).collect())


def test_record_ids_differ(spark, pages, tmp_path):
    path = write_warc(pages, f"file://{tmp_path}/a")
    ids, refers = [], set()
    for f in manifest(spark, path).collect():
        with open(Path(tmp_path, "a", f["file"]), "rb") as stream:
            for fields, _ in map(warc_files.parsed, warc_files.members(stream)):
                ids.append(fields["warc-record-id"])
                refers.add(fields.get("warc-refers-to"))
    assert len(ids) == len(set(ids)) and refers - {None} <= set(ids)


def test_second_archive_is_refused_and_nothing_stands_without_a_manifest(spark, pages, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/a"
    with monkeypatch.context() as m:
        m.setattr(warc_files, "_put", lambda *_: 1 / 0)
        with pytest.raises(Exception, match="division"):
            write_warc(pages, path)
    assert not Path(tmp_path, "a", "manifest").exists()
    write_warc(pages, path)
    assert found(read_warc(spark, path)) == brute(rows_of_pages())
    with pytest.raises(FileExistsError):
        write_warc(pages, path)


def test_renames_can_be_repeated(tmp_path):
    store, _ = warc_files._place(f"file://{tmp_path}")
    Path(tmp_path, "x").write_bytes(b"abc")
    for _ in range(2):
        warc_files._put(store, f"{tmp_path}/x", f"{tmp_path}/y", 3)
    with pytest.raises(FileNotFoundError):
        warc_files._put(store, f"{tmp_path}/x", f"{tmp_path}/y", 4)


def test_damage_is_told():
    data = warc_files.page_record(1, "http://x", b"abc" * 100, None, "1970-01-01T00:00:00Z")
    fields, block = warc_files.parsed(data)
    assert warc_files.page_row(fields, block)[0][:3] == (1, "http://x", 300)
    with pytest.raises(ValueError, match="block digest"):
        warc_files.parsed(data.replace(b"abcabc", b"abcabd", 1))
    with pytest.raises(ValueError, match="length"):
        warc_files.parsed(data[:-5])
    with pytest.raises(ValueError, match="ends within"):
        list(warc_files.members(io.BytesIO(warc_files.packed(data)[:-9])))
    assert list(warc_files.members(io.BytesIO(warc_files.packed(data) * 2))) == [data, data]


def test_no_pages(spark, pages, tmp_path):
    path = write_warc(pages.limit(0), f"file://{tmp_path}/a")
    assert manifest(spark, path).count() == 0 and read_warc(spark, path).count() == 0
