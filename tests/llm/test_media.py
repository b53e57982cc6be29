from __future__ import annotations

import hashlib
import zipfile
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quireflow.llm import media

from .conftest import by_id


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=300))
def test_image_round_trip(raw):
    payload, n = media.from_image(media.to_image(raw))
    assert n == len(raw) and payload == media.padded(raw) and len(payload) % 64 == 0 < len(payload)
    assert payload[: len(raw)] == raw and not any(payload[len(raw) :])
    assert media.to_image(raw) == media.to_image(raw)


def test_documents(spark, edge, nothing, tmp_path, monkeypatch):
    monkeypatch.setattr(media, "ARCHIVE_BYTES", 4000)
    for df in (edge.repartition(3), spark.read.parquet("/root/testdata/sf0.001/documents.parquet")):
        texts = {r["doc_id"]: (r["text"] or "").encode() for r in df.collect()}
        found = by_id(media.as_media(df))
        assert set(found) == set(texts)
        for i, r in found.items():
            assert r["payload"] == media.padded(texts[i]) and r["n_bytes"] == len(texts[i])
            assert r["media_sha256"] == hashlib.sha256(media.to_image(texts[i])).hexdigest() and r["feature"] == media.feature(r["payload"])
    assert media.as_media(nothing).collect() == []
    same = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a")], "doc_id long, text string")
    assert len({(r["media_sha256"], r["feature"]) for r in media.as_media(same).collect()}) == 1


def test_ranges_cover_each_member_once_and_damage_stays_local(spark, tmp_path):
    folder = tmp_path / "archives"
    folder.mkdir()
    with zipfile.ZipFile(folder / "a.zip", "w") as z:
        for k in range(40):
            z.writestr(f"{k}-{k}.png", media.to_image(bytes([k]) * (k * 50)), zipfile.ZIP_DEFLATED if k % 2 else zipfile.ZIP_STORED)
        broken = z.getinfo("6-6.png").header_offset
    (folder / ".half-written.zip").write_bytes(b"x")
    raw = bytearray((folder / "a.zip").read_bytes())
    raw[broken + 40 : broken + 44] = b"\xff\xff\xff\xff"
    (folder / "a.zip").write_bytes(raw)
    for size in (1000, 10**6):
        rows = media.members(spark, str(folder), range_bytes=size, retries=1).collect()
        assert len(rows) == len({r["offset"] for r in rows}) == 40
        bad = [r for r in rows if r["error"]]
        assert [(r["name"], r["tries"], r["payload"]) for r in bad] == [("6-6.png", 2, None)]
        assert all(media.from_image(r["payload"])[1] == int(r["name"][:-4].partition("-")[2]) * 50 for r in rows if not r["error"])
    with pytest.raises(Exception, match="6-6.png"):
        spark.dataSource.register(media.ArchiveMembers)
        found = media.members(spark, str(folder), retries=0)
        media.decoded(found.withColumn("payload", media.F.when(media.F.col("error").isNull(), media.F.col("payload")).otherwise(media.F.raise_error(media.F.col("name")).cast("binary")))).collect()


def test_member_is_tried_again_by_its_offset(tmp_path, monkeypatch):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("0-0.png", media.to_image(b"first"))
        z.writestr("1-1.png", media.to_image(b"second"))
    reader = media.ArchiveReader({"path": str(tmp_path), "retries": "2"})
    calls, whole = [], media.ArchiveReader.member

    def flaky(self, fs, stream, info):
        calls.append(info.filename)
        if info.filename == "0-0.png" and calls.count("0-0.png") < 3:
            raise OSError("lost")
        return whole(self, fs, stream, info)

    monkeypatch.setattr(media.ArchiveReader, "member", flaky)
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert [(r["tries"], r["error"]) for r in rows] == [(3, None), (1, None)] and calls == ["0-0.png"] * 3 + ["1-1.png"]


def test_damage_is_noticed():
    image = bytearray(media.to_image(b"text" * 30))
    image[60] ^= 1
    with pytest.raises((ValueError, zlib.error)):
        media.from_image(bytes(image))
