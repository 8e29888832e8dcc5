"""Damage in gzip members that hold many records."""

from __future__ import annotations

import gzip
import io
import random

import pyarrow as pa
import pytest

from tallgrass.llm import warc


@pytest.mark.parametrize("damage", ["inner", "cut", "tail", "flip"])
def test_other_records_of_a_member_stay(damage):
    rng = random.Random(2)
    bodies = [bytes(rng.randrange(256) for _ in range(2000)) for _ in range(40)]
    parts = [warc.record(i, f"http://h/{i}", b, warc.sha1_base32(b), None, "2024-01-01T00:00:00Z") for i, b in enumerate(bodies)]
    if damage == "inner":
        parts[20] = parts[20].replace(bodies[20], bodies[20][:-1] + bytes([bodies[20][-1] ^ 1]))
    data = gzip.compress(b"".join(parts))
    data = data[: len(data) // 2] if damage == "cut" else data[:-7] if damage == "tail" else data
    if damage == "flip":
        data = data[:-6] + bytes([data[-6] ^ 1]) + data[-5:]
    found = list(warc.salvage(pa.PythonFile(io.BytesIO(data), mode="r")))
    ids = [int(h["X-Page-Id"]) for _, _, f, h, _ in found if not f]
    want = {"inner": [i for i in range(40) if i != 20], "cut": list(range(len(ids))), "tail": list(range(39)), "flip": list(range(39))}
    assert ids == want[damage] and len(ids) >= 18 and sum(bool(f) for _, _, f, _, _ in found) == 1


def test_inner_gaps_and_records_without_digest():
    good = [warc.record(i, None, b"x" * 50, warc.sha1_base32(b"x" * 50), None, "2024-01-01T00:00:00Z") for i in range(6)]
    bad = list(good)
    bad[1], bad[4] = bad[1].replace(b"xxxxx", b"xxxxy", 1), bad[4].replace(b"xxxxx", b"yxxxx", 1)
    found = list(warc.salvage(pa.PythonFile(io.BytesIO(gzip.compress(b"".join(bad))), mode="r")))
    assert [h["X-Page-Id"] for *_, f, h, _ in found if not f] == ["0", "2", "3", "5"]
    assert sum("of the member's data" in f for *_, f, _, _ in found) == 2
    plain = b"WARC/1.0\r\nWARC-Type: metadata\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    whole = gzip.compress(plain * 3)
    torn = whole[:-6] + bytes([whole[-6] ^ 1]) + whole[-5:]
    assert sum(not f for *_, f, _, _ in warc.salvage(pa.PythonFile(io.BytesIO(whole), mode="r"))) == 3
    assert [f for *_, f, _, _ in warc.salvage(pa.PythonFile(io.BytesIO(torn), mode="r"))] == ["member fails: Error -3 while decompressing data: incorrect data check"]


def test_large_member_is_read_as_a_stream(monkeypatch):
    monkeypatch.setattr(warc, "_HELD", 1000)
    bodies = [bytes([i]) * 3000 for i in range(50)]
    data = gzip.compress(b"".join(warc.record(i, None, b, warc.sha1_base32(b), None, "2024-01-01T00:00:00Z") for i, b in enumerate(bodies)))
    found = list(warc.salvage(pa.PythonFile(io.BytesIO(data), mode="r")))
    assert [p for *_, p in found] == bodies and not any(f for *_, f, _, _ in found)


def test_archives_are_read_in_several_tasks(spark, tmp_path):
    one = warc.record(1, None, b"abc", warc.sha1_base32(b"abc"), None, "2024-01-01T00:00:00Z")
    paths = []
    for i in range(6):
        (tmp_path / f"{i}.warc").write_bytes(one)
        paths.append((f"file://{tmp_path}/{i}.warc",))
    read = warc.read_archives(spark.createDataFrame(paths, "path string").coalesce(1))
    assert read.count() == 6 and read.rdd.getNumPartitions() == 6
