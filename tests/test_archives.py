"""Members of archives by range: bytes read follow the members wanted, and an archive may be larger than a task."""

import io
import os
import random
import tarfile
import zipfile

import pytest

from tallyloom.sources import archives
from tallyloom.sources.stores import Ranged

SIZE, COUNT = 300_000, 60


def noise(i):
    return random.Random(i).randbytes(SIZE)


@pytest.fixture(scope="module")
def at(tmp_path_factory):
    """A zip and two tars of the same 60 members, of 300 kB each, that do not compress."""
    folder = tmp_path_factory.mktemp("arc hives")
    with zipfile.ZipFile(folder / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for i in range(COUNT):
            z.writestr(f"d/m{i:02}.bin", noise(i), compress_type=zipfile.ZIP_STORED if i % 2 else zipfile.ZIP_DEFLATED)
    for name, mode in (("b.tar", "w"), ("c.tar.gz", "w:gz")):
        with tarfile.open(folder / name, mode) as t:
            for i in range(COUNT):
                info = tarfile.TarInfo(f"d/m{i:02}.bin")
                info.size = SIZE
                t.addfile(info, io.BytesIO(noise(i)))
    return folder


def reader(at, name, **options):
    return archives.ArchiveReader({"path": str(at / name), **options})


def test_few_members_of_a_zip_are_few_bytes(at):
    r = reader(at, "a.zip", members="*m[04]7.bin")
    parts = r.partitions()
    got = [x for p in parts for x in r.read(p)]
    assert [(x[1], x[2]) for x in got] == [(f"d/m{i:02}.bin", noise(i)) for i in (7, 47)]
    assert len(parts) == 2, "far members are not read together"
    assert sum(list(r.read(p))[-1][3] for p in parts) < 2 * (SIZE + 1000)


def test_all_members_are_cut_into_runs(at, monkeypatch):
    monkeypatch.setattr(archives, "RUN", 5 * SIZE)
    monkeypatch.setattr(archives.coalesced, "__defaults__", (archives.GAP, 5 * SIZE))
    r = reader(at, "a.zip")
    parts = r.partitions()
    assert len(parts) >= COUNT / 5 and max(len(p.members) for p in parts) <= 5
    assert {x[1]: x[2] for p in parts for x in r.read(p)} == {f"d/m{i:02}.bin": noise(i) for i in range(COUNT)}


@pytest.mark.parametrize("name", ["b.tar", "c.tar.gz"])
def test_a_tar_stops_at_its_quota(at, name):
    r = reader(at, name, quota="3", members="*[13579].bin")
    got = list(r.read(r.partitions()[0]))
    assert [x[1] for x in got] == ["d/m01.bin", "d/m03.bin", "d/m05.bin"] and got[0][2] == noise(1)
    assert got[-1][3] < 8 * SIZE + 3 * archives.STEP < os.path.getsize(at / name) / 2


def test_a_cut_off_tar_gives_what_it_has_and_a_damaged_zip_is_an_error(at, tmp_path):
    for name in ("b.tar", "c.tar.gz"):
        (tmp_path / name).write_bytes((at / name).read_bytes()[: 10 * SIZE])
        r = reader(tmp_path, name)
        assert 8 <= len(list(r.read(r.partitions()[0]))) <= 10
    raw = bytearray((at / "a.zip").read_bytes())
    raw[raw.index(noise(1)[:20]) + 5] ^= 1
    (tmp_path / "bad.zip").write_bytes(raw)
    r = reader(tmp_path, "bad.zip", members="*m01.bin")
    with pytest.raises(zipfile.BadZipFile, match="checksum"):
        list(r.read(r.partitions()[0]))
    (tmp_path / "none.bin").write_bytes(b"x" * 100)
    r = reader(tmp_path, "none.bin")
    assert list(r.read(r.partitions()[0])) == []


def test_by_spark(spark, at):
    whole = archives.members(spark, str(at), "*").collect()
    assert len(whole) == 3 * COUNT and all(bytes(r.content) == noise(int(r.member[3:5])) for r in whole)
    few = archives.members(spark, str(at), "*m1*", quota=2).collect()
    assert sorted(r.member for r in few) == sorted(["d/m10.bin", "d/m11.bin"] * 3)


def test_whole_archives_where_tasks_cannot_open_ranges(spark, at, monkeypatch):
    monkeypatch.setattr(archives, "reachable", lambda path: False)
    few = archives.members(spark, str(at), "*m1*", quota=2).collect()
    assert sorted(r.member for r in few) == sorted(["d/m10.bin", "d/m11.bin"] * 3)


def test_xml_inside(spark, tmp_path):
    text = '<t><row id="1"><a>x &amp; y</a></row>\n<row id="2"/><rows/><row id="3"><a>z</a>\n</row></t>'
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("in/x.xml", text)
        z.writestr("in/y.txt", text)
    got = archives.elements_inside(spark, str(tmp_path), "_id int, a string", "row").collect()
    assert sorted((r._id, r.a) for r in got) == [(1, "x & y"), (2, None), (3, "z")]


def test_ranged_files_seek(tmp_path):
    (tmp_path / "a b").write_bytes(bytes(range(100)))
    with Ranged(f"file:{tmp_path}/a%20b") as f:
        assert f.seek(-10, io.SEEK_END) == 90 and f.read(4) == bytes(range(90, 94)) and f.tell() == 94
        assert f.read() == bytes(range(94, 100)) and f.read() == b"" and f.fetched == 10
