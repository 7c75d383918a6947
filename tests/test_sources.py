"""Archives, event files and SQLite ranges against what Python's own modules give."""

from __future__ import annotations

import hashlib
import io
import json
import random
import sqlite3
import struct
import tarfile
import zipfile

import pytest

from corpusloom.sources import archives, readers, telemetry


@pytest.fixture(scope="module")
def packed(tmp_path_factory):
    """The same files in archives of several kinds."""
    at, rng = tmp_path_factory.mktemp("packed"), random.Random(5)
    files = [(f"d{k % 3}/f{k}.{'c' if k % 2 else 'txt'}", rng.randbytes(rng.choice([0, 1, 700, 90_000]))) for k in range(60)]
    files += [("a" * 150 + "/é.c", b"long name"), ("twice.c", b"one"), ("twice.c", b"two")]
    for kind, mode in (("tar", "w"), ("tar.gz", "w:gz"), ("tar.bz2", "w:bz2")):
        with tarfile.open(at / f"x.{kind}", mode) as t:
            for name, data in files:
                info = tarfile.TarInfo(name)
                info.size = len(data)
                t.addfile(info, io.BytesIO(data))
            link = tarfile.TarInfo("link.c")
            link.type, link.linkname = tarfile.SYMTYPE, "twice.c"
            t.addfile(link)
            folder = tarfile.TarInfo("folder.c")
            folder.type = tarfile.DIRTYPE
            t.addfile(folder)
    with zipfile.ZipFile(at / "x.zip", "w") as z:
        for k, (name, data) in enumerate(files[:-1]):
            z.writestr(name, data, zipfile.ZIP_DEFLATED if k % 2 else zipfile.ZIP_STORED)
    return at, files


@pytest.mark.parametrize("kind", ["tar", "tar.gz", "tar.bz2", "zip"])
def test_archive_members(spark, packed, kind):
    at, files = packed
    want = sorted((files if kind != "zip" else files[:-1]), key=str)
    got = archives.archive_members(spark, f"file://{at}/x.{kind}", members=7, bytes_at_once=200_000)
    assert sorted(((r.path, bytes(r.content)) for r in got.collect()), key=str) == want
    if kind in ("tar", "zip"):
        assert got.rdd.getNumPartitions() > 8
    stored = archives.stored_archive_members(spark, f"file://{at}/x.{kind}", (".c",))
    assert sorted(((r.path, bytes(r.content)) for r in stored.collect()), key=str) == [x for x in want if x[0].endswith(".c")]
    texts = readers.corpus_root(spark, f"{at}/x.{kind}")
    assert texts.where("path like '%long%' or text = 'long name'").count() == 1 and texts.count() == sum(n.endswith((".c", ".cl")) for n, _ in want)
    with pytest.raises(ValueError, match="no archive"):
        archives.archive_members(spark, f"{at}/x.rar")


def test_archive_hash(spark, packed, tmp_path):
    at, files = packed
    assert archives.archive_hash(spark, f"{at}/x.tar") == hashlib.sha256(b"temporary_unknown_corpus").hexdigest()
    (tmp_path / "x.tar").write_bytes((at / "x.tar").read_bytes())
    listing = tmp_path / "corpus_registry.json"
    listing.write_text("{}")
    with pytest.raises(FileNotFoundError):
        archives.archive_hash(spark, f"{tmp_path}/x.tar")
    listing.write_text('{"x.tar": {}}')
    want = hashlib.sha1("".join(sorted(hashlib.sha1(d).hexdigest() for _, d in files)).encode()).hexdigest()
    assert archives.archive_hash(spark, f"{tmp_path}/x.tar") == want
    listing.write_text(json.dumps({"x.tar": {"hash": want}}))
    assert archives.archive_hash(spark, f"{tmp_path}/x.tar", verify=True) == want
    listing.write_text('{"x.tar": {"hash": "other"}}')
    assert archives.archive_hash(spark, f"{tmp_path}/x.tar") == "other"
    with pytest.raises(ValueError, match="not other"):
        archives.archive_hash(spark, f"{tmp_path}/x.tar", verify=True)


def varint(n):
    n &= (1 << 64) - 1
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def field(number, kind, data):
    return varint(number << 3 | kind) + (varint(len(data)) if kind == 2 else b"") + data


def event(wall, step, *scalars):
    value = lambda tag, v: field(1, 2, field(1, 2, tag.encode()) + field(9, 2, b"plugin") + field(2, 5, struct.pack("<f", v)))
    return field(1, 1, struct.pack("<d", wall)) + varint(2 << 3) + varint(step) + (field(5, 2, b"".join(value(*s) for s in scalars)) if scalars else field(3, 2, b"brain.Event:2"))


def framed(*events):
    out = b""
    for e in events:
        head = struct.pack("<Q", len(e))
        out += head + struct.pack("<I", telemetry.masked_crc32c(head)) + e + struct.pack("<I", telemetry.masked_crc32c(e))
    return out


def test_checksum():
    crc = telemetry.masked_crc32c(b"123456789")
    turned = (crc - 0xA282EAD8) & 0xFFFFFFFF
    assert (turned >> 17 | turned << 15) & 0xFFFFFFFF == 0xE3069283  # the check value of CRC-32C


def test_event_files_equal_the_json_log(spark, tmp_path):
    (tmp_path / "e").mkdir()
    (tmp_path / "j").mkdir()
    steps = [(10.2, 0, 9.0), (11.5, 5, 4.5), (14.5, 10, 0.25), (20.4, -1, 0.125)]
    events = [event(1.0, 0)] + [event(w, s, ("training/total_loss", v), ("other", 1.0)) for w, s, v in steps]
    whole = framed(*events)
    (tmp_path / "e" / "events.out.tfevents.1").write_bytes(whole + framed(event(30.0, 11, ("training/total_loss", 7.0)))[:-3])  # cut off
    got = telemetry.event_scalars(spark, f"file://{tmp_path}/e").orderBy("place", "tag").collect()
    assert [(r.place, r.wall_time, r.step, r.tag, r.value) for r in got if r.tag != "other"] == [(k + 1, w, s, "training/total_loss", v) for k, (w, s, v) in enumerate(steps)]
    epochs = sorted(map(tuple, telemetry.epoch_telemetry(spark, f"file://{tmp_path}/e").collect()), key=lambda r: int(r[0]))
    assert epochs == [("12", 5, 2, 4.5), ("14", 10, 2, 0.25), ("20", -1, 6, 0.125)]
    (tmp_path / "j" / "training.json").write_text(json.dumps([{"step": s, "batch_execution_time_ms": w, "total_loss": v} for (_, s, _, v), w in zip(epochs, (2.2, 1.5, 6.0))] + [{"step": 99}]))
    same = sorted(map(tuple, telemetry.epoch_telemetry(spark, f"file://{tmp_path}/j").collect()))
    assert same == sorted([*(("0", s, w, v) for _, s, w, v in epochs), ("0", 99, -1, -1.0)])
    bad = bytearray(whole)
    bad[len(framed(events[0], events[1])) + 20] ^= 1  # the third record
    (tmp_path / "e" / "events.out.tfevents.1").write_bytes(bad)
    assert telemetry.event_scalars(spark, f"file://{tmp_path}/e").where("tag <> 'other'").count() == 1


def test_fallback_order(spark, tmp_path):
    read = lambda: sorted(map(tuple, telemetry.epoch_telemetry(spark, f"file://{tmp_path}").collect()))
    (tmp_path / "other.txt").write_text("x")
    assert read() == [("0", 0, 0, -1.0)]
    (tmp_path / "training.json").write_text("[]")
    assert read() == []
    (tmp_path / "events.out.tfevents.2").write_bytes(framed(event(1.0, 0)))
    assert read() == [("0", 0, 0, -1.0)]
    (tmp_path / "epoch_01_telemetry.pbtxt").write_text('timestamp_unix_epoch_ms: "17"\nepoch_num: 1\nepoch_wall_time_ms: 250\nloss: 0.5\n')
    (tmp_path / "epoch_02_telemetry.pbtxt").write_text("epoch_num: 2\n")
    (tmp_path / "epoch_x_telemetry.pbtxt").write_text("epoch_num: 3\n")
    assert read() == [("", 2, 0, 0.0), ("17", 1, 250, 0.5)]


def test_sqlite_ranges(spark, tmp_path):
    rng, path = random.Random(2), str(tmp_path / "a.db")
    rows = [(rng.choice([None, rng.randrange(-10**12, 10**12), rng.randrange(40)]), rng.choice(["a", "b", None])) for _ in range(500)]
    con = sqlite3.connect(path)
    con.execute("create table files (id integer, text text)")
    con.execute("create index at on files (id)")
    con.executemany("insert into files values (?, ?)", rows)
    con.execute("create table bare (id integer primary key, text text) without rowid")
    con.execute("insert into bare values (3, 'b'), (1, 'a')")
    con.execute("create table empty (id integer, text text)")
    con.execute("create table named (id text, text text)")
    con.execute("insert into named values ('x', 'y')")
    con.commit()
    con.close()
    show = lambda df: sorted(map(str, map(tuple, df.collect())))
    want, schema = sorted(map(str, rows)), "id long, text string"
    by_rowid = readers.sqlite_table(spark, path, "files", schema, rows=60)
    assert show(by_rowid) == want and by_rowid.rdd.getNumPartitions() == 9
    by_key = readers.sqlite_table(spark, path, "files", schema, rows=100, key="id")
    assert show(by_key) == want and by_key.rdd.getNumPartitions() == 6  # five ranges, and the null keys
    by_query = readers.sqlite_table(spark, path, "SELECT id, text FROM files", schema, rows=100, key="id", most_parts=20)
    assert show(by_query) == want and by_query.rdd.getNumPartitions() == 21
    bare = readers.sqlite_table(spark, path, "bare", schema, rows=1, key="id", numbered=False)
    assert show(bare) == ["(1, 'a')", "(3, 'b')"]
    assert readers.sqlite_table(spark, path, "SELECT id, text FROM files", schema).rdd.getNumPartitions() == 1
    assert show(readers.sqlite_table(spark, path, "empty", schema)) == []
    with pytest.raises(Exception, match="no integers"):
        readers.sqlite_table(spark, path, "named", schema, key="id").count()
