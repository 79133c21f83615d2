"""Archives: both versions, odd records, round trip and revisits."""

from __future__ import annotations

import gzip

import duckdb
import pytest

from auditloom.llm import arc, queries


def test_header_lines_of_both_versions():
    for version in (1, 2):
        text = arc.arc_archive("a.arc", version, [(7, "http://x/a b", "<p>é</p>".encode()), (8, None, b""), (None, "", b"z")], "20010203")
        got = list(arc.arc_records(text, "a"))
        assert [r.url for r in got] == ["filedesc://a.arc", "http://x/a%20b", arc.NO_URL, arc.NO_URL]
        head, payload = got[1].split()
        assert payload.decode() == "<p>é</p>" and arc.header_value(head, b"x-page-id") == "7" and got[1].status == ("-" if version == 1 else "200")
        assert arc.iso_date(got[1].date) == "2001-02-03T00:00:00Z" and not got[1].truncated
        # Declared lengths are obeyed: a body that looks like a record stays a body.
    inner = arc.arc_archive("b.arc", 1, [(1, "http://y/", text)], "20010203040506")
    assert list(arc.arc_records(inner))[1].split()[1] == text


def test_odd_archives():
    text = arc.arc_archive("a.arc", 1, [(7, "http://x/", b"0123456789")], "20010203")
    assert list(arc.arc_records(text[:-4]))[1].truncated
    for bad in (b"no archive\n", text + b"\nrest of something\n", text.replace(b"1 0 auditloom", b"9 0 auditloom")):
        with pytest.raises(ValueError):
            list(arc.arc_records(bad))
    foreign = b"filedesc://f 0.0.0.0 20010101 text/plain 13\n1 0 X\nfields\n" + b"\ndns:x 1.2.3.4 20010101000000 text/dns 3\nabc\n"
    made = list(arc.warc_records(arc.warc_archive("f", foreign, {})))
    assert [h["warc-type"] for h, _ in made] == ["warcinfo", "resource"] and made[1][1] == b"abc" and made[1][0]["content-type"] == "text/dns"


def test_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    want = sorted(con.execute(queries.SQL["op10_warc"]).fetchall())
    got = sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in queries.op10_warc(spark, sf_dir).collect())
    assert got == want


def test_revisits(spark, monkeypatch):
    monkeypatch.setattr(arc, "ARCHIVE_BYTES", 500)
    big, other = "é" * 60 + "\r\n\r\nWARC/1.0\r\n", "o" * 99
    rows = [(9, "http://a", big), (3, "http://b", big), (3, "http://b", big), (None, None, big), (5, "", other), (6, "http://c", other), (7, "u v", None), (8, "x", "")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload_digest string")
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in arc.archived(pages).collect()), key=lambda r: (r[0] is None, r[0] or 0))
    n = len(big.encode())
    assert got == [(3, n, "response", None), (3, n, "response", None), (5, 99, "response", None), (6, 99, "response", None), (7, 0, "response", None),
                   (8, 0, "response", None), (9, n, "revisit", 3), (None, n, "revisit", 3)]
    ids = [r.record_id for r in arc.archived(pages).collect()]
    assert len(set(ids)) == len(ids)


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert arc.archived(pages).collect() == []


GIF = bytes(range(256)) * 3 + b"GIF89a\xff\xfe\x00"


def members(*records: bytes) -> bytes:
    return b"".join(gzip.compress(r + b"\n") for r in records)


def foreign() -> list[bytes]:
    """An archive of another writer, record by record: a picture, an address with a space, a broken line between records."""
    def record(url: str, mime: str, body: bytes) -> bytes:
        return f"{url} 1.2.3.4 20010203040506 {mime} {len(body)}\n".encode() + body
    return [record("filedesc://f.arc", "text/plain", b"1 0 X\nURL IP-address Archive-date Content-type Archive-length\n"),
            record("http://x/p.gif", "image/gif", b"HTTP/1.0 200 OK\r\nContent-Type: image/gif\r\n\r\n" + GIF),
            b"http://x/broken 1.2.3.4 2001020304 text/html many\nlost: \xff words\n",
            record("http://x/a b", "text/html", b"HTTP/1.0 200 OK\r\nX-Page-Id: none\r\n\r\n" + b"w" * 120),
            record("dns:x", "text/dns", b"abc")]


@pytest.mark.parametrize("form", ["plain", "one", "members", "cut"])
def test_foreign_archives(spark, tmp_path, form):
    raw = b"\n".join(foreign()) + b"\n"
    data = {"plain": raw, "one": gzip.compress(raw), "members": members(*foreign()), "cut": members(*foreign()) + gzip.compress(b"x" * 9)[:-6]}[form]
    (tmp_path / "arc").mkdir()
    (tmp_path / "arc" / "f.arc.gz").write_bytes(data)
    (tmp_path / "arc" / "none.arc").write_bytes(b"\xff no archive\n")
    rows = arc.read_arc(spark, str(tmp_path / "arc")).collect()
    read = {(r.archive.rsplit("/", 1)[-1], r.url, r.bad): bytes(r.payload) for r in rows}
    assert read["f.arc.gz", "http://x/p.gif", False] == GIF and read["f.arc.gz", "dns:x", False] == b"abc"
    assert read["f.arc.gz", "http://x/a b", False] == b"w" * 120 and read["none.arc", None, True] == b"\xff no archive\n"
    assert any(r.bad and b"lost: \xff words" in bytes(r.payload) for r in rows)
    arc.convert(spark, str(tmp_path / "arc"), str(tmp_path / "warc"))
    made = [x for f in (tmp_path / "warc").glob("*.gz") for x in arc.warc_records(arc.plain(f.read_bytes()))]
    kinds = sorted(h["warc-type"] for h, _ in made)
    assert kinds == sorted(["warcinfo", "response", "response", "resource", "metadata", "metadata", *(["metadata"] if form == "cut" else [])])
    assert any(block.endswith(GIF) for h, block in made if h["warc-type"] == "response")
    back = {r.target_uri: r for r in arc.read_warc(spark, str(tmp_path / "warc")).collect()}
    assert back["http://x/p.gif"].payload_bytes == len(GIF) and back["http://x/a b"].page_id is None


def test_next_header_line_is_found():
    raw = b"\n".join(foreign()) + b"\n"
    got = list(arc.arc_records(raw, strict=False))
    assert [r.bad for r in got] == [False, False, True, False, False]
    assert b"".join(raw[r.offset:r.offset + 4] for r in got) == b"filehttphttphttpdns:"
    with pytest.raises(ValueError):
        list(arc.arc_records(raw))
