import hashlib
import json
import os
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from docloom.llm import media
from docloom.llm.common import shared_path
from tests.llm.data import documents, empty


def test_image_round_trip():
    for raw in (b"", b"\0", b"x" * 64, b"x" * 65, bytes(range(256)) * 9 + b"\0\0"):
        n, samples = media.decode(media.encode(raw))
        payload = samples.tobytes()
        assert n == len(raw) and payload[:n] == raw and not any(payload[n:]) and len(payload) == max(64, -(-n // 64) * 64)
    broken = bytearray(media.encode(b"hello"))
    broken[60] ^= 1
    with pytest.raises(ValueError):
        media.decode(bytes(broken))


def test_measures_equal_definition(spark):
    docs = documents(spark)
    got = sorted([tuple(r)[:7] for r in media.measure(docs).collect()], key=str)
    want = []
    for r in docs.collect():
        raw = (r.text or "").encode()
        payload = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        stored = media.encode(raw)
        want.append((r.doc_id, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest()))
    assert got == sorted(want, key=str)
    assert media.measure(empty(spark)).count() == 0


def test_byte_ranges_and_rolled_archives_hold_every_member(spark):
    media.register(spark)
    folder = shared_path(spark, "ranges")
    rows = spark.range(500).select(F.concat(F.col("id"), F.lit(".bin")).alias("member"), F.repeat(F.lit("abc"), F.col("id").cast("int")).cast("binary").alias("media")).repartition(3)
    rows.write.format(media.FORMAT).mode("append").option("roll_bytes", 50_000).save(folder)
    assert len([x for x in os.listdir(folder.removeprefix("file:")) if x.endswith(".zip")]) > 3
    for cut in (1_000, 1 << 30):
        back = media.read_media(spark, folder, range_bytes=cut, batch_bytes=5_000)
        assert sorted((r.member, bytes(r.media)) for r in back.collect()) == sorted((r.member, bytes(r.media)) for r in rows.collect())


def test_plain_folder_of_compressed_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("x.txt", "hello " * 100)
    assert bytes(media.read_media(spark, str(tmp_path)).first().media) == b"hello " * 100


def test_a_member_is_retried_alone(tmp_path, monkeypatch):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for i in range(4):
            z.writestr(f"{i}", b"data%d" % i)
    reader = media.ArchiveReader(str(tmp_path), 1 << 20, 1 << 20, 3)
    calls, real = [], media.zlib.crc32

    def flaky(data, *a):
        calls.append(bytes(data))
        return 0 if calls.count(b"data2") == 1 and data == b"data2" else real(data, *a)

    monkeypatch.setattr(media.zlib, "crc32", flaky)
    (part,) = reader.partitions()
    got = [x for b in reader.read(part) for x in b.column("media").to_pylist()]
    assert got == [b"data0", b"data1", b"data2", b"data3"]
    assert calls.count(b"data2") == 2 and calls.count(b"data1") == 1


def test_damage_is_reported(tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x", b"payload-bytes")
    raw = bytearray((tmp_path / "a.zip").read_bytes())
    raw[raw.index(b"payload")] ^= 1
    (tmp_path / "a.zip").write_bytes(bytes(raw))
    reader = media.ArchiveReader(str(tmp_path), 1 << 20, 1 << 20, 2)
    with pytest.raises(ValueError, match="checksum"):
        list(reader.read(reader.partitions()[0]))


def test_members_are_read_in_blocks(tmp_path, monkeypatch):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for i in range(500):
            z.writestr(f"{i}", b"d%d" % i * 100)
    opened, real = [], media._open

    class Counted:
        def __init__(self, where):
            self.where = where

        def __getattr__(self, name):
            if name == "open_input_file":
                opened.append(name)
            return getattr(self.where, name)

    monkeypatch.setattr(media, "_open", lambda path: (Counted(real(path)[0]), real(path)[1]))
    for block, most in ((4 << 20, 2), (50_000, 10), (1, 501)):
        reader = media.ArchiveReader(str(tmp_path), 1 << 30, 1 << 20, 3, block)
        opened.clear()
        got = [x for b in reader.read(reader.partitions()[0]) for x in b.column("media").to_pylist()]
        assert got == [b"d%d" % i * 100 for i in range(500)] and len(opened) <= most


def test_ranges_are_bounded(tmp_path, monkeypatch):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x", b"x" * 100_000)
    monkeypatch.setattr(media, "MAX_RANGES", 3)
    assert len(media.ArchiveReader(str(tmp_path), 10, 1 << 20, 3).partitions()) == 3


def test_many_small_archives_share_partitions(tmp_path):
    """150,000 archives of 5 KB would be as many partitions; nothing is opened to plan them."""
    (tmp_path / media.MANIFEST).write_text(json.dumps([[f"{i}.zip", 5000] for i in range(150_000)]))
    parts = media.ArchiveReader(str(tmp_path), 5000, 1 << 20, 3).partitions()
    assert 50_000 < len(parts) <= media.MAX_RANGES
    assert [r.name for p in parts for r in p.parts] == [f"{i}.zip" for i in range(150_000)]


def test_ranges_of_several_archives_are_read_in_one_task(tmp_path):
    for k in range(30):
        with zipfile.ZipFile(tmp_path / f"{k:02d}.zip", "w") as z:
            for i in range(k % 4):
                z.writestr(f"{k}-{i}", b"%d-%d" % (k, i) * 50)
    want = [f"{k}-{i}" for k in range(30) for i in range(k % 4)]
    for size in (1, 500, 2500, 1 << 20):
        reader = media.ArchiveReader(str(tmp_path), size, 1 << 20, 3)
        parts = reader.partitions()
        assert [n for p in parts for b in reader.read(p) for n in b.column("member").to_pylist()] == want
    assert len(parts) == 1
