"""Tail of text files: bytes that are read, files that move, are cut or replaced, ranges, restarts of the stream."""

from __future__ import annotations

import os
import random

import pytest
from pyarrow import fs as pafs

from auditloom.sources import tail as L


def grown(state: L.Tail, start: dict) -> tuple[list[tuple[str, int, str]], dict]:
    end = state.state()
    rows = [(b["file"].rsplit("/", 1)[1], b["pos"], b["value"]) for r in state.ranges(start, end) for t in state.read(r) for b in t.to_pylist()]
    return sorted(rows), end


def test_replaced_renamed_and_cut_files(tmp_path):
    t = L.Tail({"path": str(tmp_path), "pattern": "*.log*"})
    (tmp_path / "a.log").write_bytes(b"one\r\ntwo\nhal")
    (tmp_path / "_b.log").write_bytes(b"hidden\n")
    (tmp_path / "c.txt").write_bytes(b"other\n")
    (tmp_path / "e.log").write_bytes(b"")
    rows, s0 = grown(t, {})
    assert rows == [("a.log", 0, "one"), ("a.log", 5, "two")]
    (tmp_path / "a.log").write_bytes(b"one\r\ntwo\nhalf")  # only the open line grew: nothing to report, the same state
    rows, s1 = grown(t, s0)
    assert rows == [] and s1 == s0
    os.rename(tmp_path / "a.log", tmp_path / "a.log.1")
    with open(tmp_path / "a.log.1", "ab") as f:
        f.write(b" done\n")
    (tmp_path / "a.log").write_bytes(b"a new file that is longer than the old one\n")
    rows, s2 = grown(t, s1)
    assert rows == [("a.log", 0, "a new file that is longer than the old one"), ("a.log.1", 9, "half done")]
    (tmp_path / "a.log").write_bytes(b"cut\n\xff\n")
    rows, s3 = grown(t, s2)
    assert rows == [("a.log", 0, "cut"), ("a.log", 4, "\ufffd")]
    (tmp_path / "a.log").write_bytes(b"CUT\n\xff\n")  # as long as before, another file
    assert grown(t, s3)[0] == [("a.log", 0, "CUT"), ("a.log", 4, "\ufffd")]
    assert grown(L.Tail({"path": str(tmp_path / "none")}), {}) == ([], {})


def test_rotation_of_a_chain(tmp_path):
    t, seen, state = L.Tail({"path": str(tmp_path)}), [], {}
    for k in range(5):
        for j in (3, 2, 1):
            if (tmp_path / f"x.{j - 1}").exists():
                os.replace(tmp_path / f"x.{j - 1}", tmp_path / f"x.{j}")
        (tmp_path / "x.0").write_bytes(b"the same header\n" + b"".join(b"%d %d\n" % (k, i) for i in range(k, 9)))
        rows, state = grown(t, state)
        seen += [v for _, _, v in rows]
    assert sorted(seen) == sorted(["the same header"] * 5 + [f"{k} {i}" for k in range(5) for i in range(k, 9)])


@pytest.mark.parametrize("width", [1, 2, 7, 64, 10_000])
def test_ranges_give_each_line_once(tmp_path, monkeypatch, width):
    monkeypatch.setattr(L, "CHUNK", 16)
    rnd = random.Random(width)
    text = b"".join(bytes(rnd.choices(b"abc\xc3\xa9", k=rnd.randrange(0, 40))) + b"\n" for _ in range(60))
    (tmp_path / "a").write_bytes(text + b"open")
    t = L.Tail({"path": str(tmp_path), "rangeBytes": str(width)})
    rows, _ = grown(t, {})
    want, at = [], 0
    for x in text.split(b"\n")[:-1]:
        want.append(("a", at, x.decode("utf-8", "replace")))
        at += len(x) + 1
    assert rows == want


def test_reads_only_what_is_new(tmp_path, monkeypatch):
    big = tmp_path / "a"
    big.write_bytes(b"x" * 99 + b"\n" + (b"y" * 99 + b"\n") * 200_000)
    t = L.Tail({"path": str(tmp_path)})
    start = t.state()
    with open(big, "ab") as f:
        f.write(b"new\n")
    read = 0
    real = pafs.LocalFileSystem.open_input_file

    class Counted:
        def __init__(self, f):
            self.f = f

        def __enter__(self):
            return self

        def __exit__(self, *a):
            self.f.close()

        def read(self, n):
            nonlocal read
            data = self.f.read(n)
            read += len(data)
            return data

        def __getattr__(self, name):
            return getattr(self.f, name)

    class Files:
        def __init__(self, fs):
            self.fs = fs

        def open_input_file(self, path):
            return Counted(real(self.fs, path))

        def __getattr__(self, name):
            return getattr(self.fs, name)

    plain = L.file_system
    monkeypatch.setattr(L, "file_system", lambda p: (Files(plain(p)[0]), plain(p)[1]))
    assert grown(t, start)[0] == [("a", 20_000_100, "new")]
    assert read <= L.CHUNK + 8 * L.BLOCK


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    logs, out, ckpt = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ckpt")
    logs.mkdir()

    def catch_up() -> list[tuple[str, int, str]]:
        L.stream_lines(spark, str(logs), rangeBytes=10).writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt).trigger(
            availableNow=True).start().awaitTermination(120)
        return sorted((r.file.rsplit("/", 1)[1], r.pos, r.value) for r in spark.read.parquet(out).collect())

    (logs / "a").write_bytes(b"first line\nsecond line\nthi")
    assert catch_up() == [("a", 0, "first line"), ("a", 11, "second line")]
    with open(logs / "a", "ab") as f:
        f.write(b"rd\n")
    os.rename(logs / "a", logs / "a.1")
    (logs / "a").write_bytes("f\u00fcnf\n".encode())
    assert catch_up() == [("a", 0, "first line"), ("a", 0, "f\u00fcnf"), ("a", 11, "second line"), ("a.1", 23, "third")]
    assert len(catch_up()) == 4
