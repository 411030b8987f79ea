import bz2
import gzip
import io
import lzma
import random
import re
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from tracewell import engine
from tracewell.sources import lines as L


def text(n, seed=1):
    rng = random.Random(seed)
    return "\n".join(rng.choice(["", "é" * rng.randint(0, 40), "x" * rng.randint(0, 300), f"line {i}\r"]) for i in range(n))


def plain(data):
    parts = data.removeprefix(L.BOM).decode("utf-8", "replace").split("\n")
    return parts[:-1] if parts[-1] == "" else parts


def got(lines, name):
    return [r["line"] for r in sorted(lines.where(F.col("src_file") == name).collect(), key=lambda r: r["line_no"])]


def numbers(lines, name):
    return sorted(r["line_no"] for r in lines.where(F.col("src_file") == name).collect())


@pytest.fixture()
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "65536", "spark.sql.files.openCostInBytes": "1024"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_ranges_of_a_file_number_its_lines(spark, tmp_path, small_splits, monkeypatch):
    monkeypatch.setattr(L, "SPLIT_BZ2", 1000)
    data = {"a b%20c.log": text(12_000).encode(), "end.log": (text(3000, 2) + "\n\n").encode(), "bom.log": L.BOM + b"one\ntwo", "one": b"no newline", "empty": b"", "newline": b"\n"}
    data["wide.log"] = ("w" * 200_000 + "\n" + text(100, 3) + "\n" + "v" * 150_000).encode()  # lines longer than a range
    for name, content in data.items():
        (tmp_path / name).write_bytes(content)
    (tmp_path / "packed.bz2").write_bytes(bz2.compress(data["a b%20c.log"] * 3, 1))
    files, lines = L.read(spark, str(tmp_path))
    for name, content in data.items():
        assert got(lines, name) == plain(content), name
    want = plain(data["a b%20c.log"] * 3)
    assert got(lines, "packed.bz2") == want and numbers(lines, "packed.bz2") == list(range(1, len(want) + 1))
    assert {r["src_file"]: r["bytes"] for r in files.collect()} == {p.name: p.stat().st_size for p in tmp_path.iterdir()}
    raw = spark.read.option("lineSep", "\n").text(str(tmp_path / "a b%20c.log"))
    assert raw.select(F.col("_metadata.file_block_start").alias("b")).distinct().count() > 8  # the file was read in ranges


def test_plain_text_meets_no_python(spark, tmp_path, monkeypatch):
    (tmp_path / "a.log").write_text("one\ntwo\n")
    plans = []
    monkeypatch.setattr(L, "persisted", lambda df, label: plans.append((label, df._jdf.queryExecution().optimizedPlan().toString())) or df.cache())
    _, lines = L.read(spark, str(tmp_path))
    assert lines.count() == 2
    assert {k for k, p in plans if "MapInArrow" in p} == {"pieces"}
    # the read of packed files opens none of the plain ones
    assert spark.read.format("binaryFile").load(str(tmp_path)).where(F.col("_metadata.file_name").rlike(L.PACKED)).inputFiles() is not None


def zipped(members, method=zipfile.ZIP_DEFLATED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()


def tarred(members, mode="w"):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as t:
        for name, data in members.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


@pytest.mark.parametrize("chunk,slice_", [(1 << 20, 4 << 20), (100, 64)])
def test_members_of_archives(spark, tmp_path, monkeypatch, chunk, slice_):
    monkeypatch.setattr(L, "CHUNK", chunk)
    monkeypatch.setattr(L, "SLICE", slice_)
    body = {f"m{i}.log": text(20 + i % 7, i).encode() for i in range(30)} | {"../evil": b"no", "/abs": b"no", "bin": b"a\0b\n", "none": b"", "z.gz": gzip.compress(b"one\ntwo")}
    inner = zipped({"deep/a.log": b"deep\n", "t.tar": tarred({"b.log": b"x\ny"})})
    want = {}
    for name, data in (("a.zip", zipped(body | {"in.zip": inner})), ("stored.zip", zipped(body, zipfile.ZIP_STORED)), ("lz.zip", zipped(body, zipfile.ZIP_LZMA)), ("t.tar", tarred(body | {"in.zip": inner})), ("t.tar.gz", tarred(body | {"in.zip": inner}, "w:gz")), ("no suffix zip", zipped(body)), ("nosuffixtar", tarred(body))):
        (tmp_path / name).write_bytes(data)
        for k, v in body.items():
            if k[0] not in "./":
                want[f"{name}!/{k}"] = b"one\ntwo" if k == "z.gz" else v
        if name in ("a.zip", "t.tar", "t.tar.gz"):
            want |= {f"{name}!/in.zip!/deep/a.log": b"deep\n", f"{name}!/in.zip!/t.tar!/b.log": b"x\ny"}
    for name, data in (("x.gz", gzip.compress(text(500).encode())), ("x.xz", lzma.compress(text(500).encode())), ("x.bz2", bz2.compress(text(500).encode()))):
        (tmp_path / name).write_bytes(data)
        want[name] = text(500).encode()
    files, lines = L.read(spark, str(tmp_path))
    found = {r["src_file"]: r for r in files.collect()}
    assert set(found) == set(want) and not [r for r in found.values() if r["error"]]
    rows = {}
    for r in sorted(lines.collect(), key=lambda r: r["line_no"]):
        rows.setdefault(r["src_file"], []).append(r["line"])
        assert r["line_no"] == len(rows[r["src_file"]])
    for name, data in want.items():
        assert found[name]["binary"] == name.endswith("!/bin")
        assert rows.get(name, []) == ([] if name.endswith("!/bin") else plain(data)), name


def test_members_are_unpacked_by_many_tasks(spark, tmp_path):
    (tmp_path / "a.zip").write_bytes(zipped({f"m{i}": b"line\n" * 10 for i in range(1000)}))
    b = spark.read.format("binaryFile").load(str(tmp_path)).select(F.lit("a.zip").alias("src_file"), F.col("length").alias("bytes"), F.lit(2024).alias("file_year"), "content")
    slices = b.mapInArrow(L._sliced, L.SLICES).repartition(8, "src_file", "member").sortWithinPartitions("src_file", "member", "seq")
    done = slices.mapInArrow(L._unpacked_members, L.PIECES).withColumn("task", F.spark_partition_id())
    assert done.where("value is null").count() == 1000 and done.select("task").distinct().count() == 8
    assert done.agg(F.max(F.length("value"))).first()[0] <= L.CHUNK


def test_damage_ends_only_what_is_damaged(spark, tmp_path):
    whole = zipped({"a": text(2000).encode(), "b": b"fine\n", "c": text(2000, 5).encode()})
    at = whole.index(b"PK\x03\x04") + 31 + 200
    (tmp_path / "member.zip").write_bytes(whole[:at] + b"\xff\x00\xff" + whole[at + 3 :])
    cut = gzip.compress("\n".join(f"{i} {random.Random(i).random()}" for i in range(400_000)).encode())
    (tmp_path / "cut.gz").write_bytes(cut[: len(cut) * 3 // 4])
    (tmp_path / "bad.zip").write_bytes(b"PK\x03\x04nonsense")
    (tmp_path / "bad.tar").write_bytes(b"nonsense")
    (tmp_path / "ok.log").write_bytes(b"x\n")
    deep = b"end\n"
    for i in range(12):
        deep = zipped({f"{i}.zip" if i else "end.log": deep})
    (tmp_path / "deep.zip").write_bytes(deep)
    files, lines = L.read(spark, str(tmp_path))
    found = {r["src_file"]: r["error"] for r in files.collect()}
    assert found["ok.log"] is None and found["member.zip!/b"] is None and found["member.zip!/c"] is None
    assert all(found[k] for k in ("member.zip!/a", "cut.gz", "bad.zip", "bad.tar")) and any("nested deeper" in (v or "") for k, v in found.items() if k.startswith("deep.zip"))
    assert got(lines, "member.zip!/b") == ["fine"] and got(lines, "member.zip!/c") == plain(text(2000, 5).encode())
    assert len(numbers(lines, "cut.gz")) > 100_000  # lines before the damage stay


def test_ingest_reads_by_type_and_parses_once(spark, tmp_path, monkeypatch):
    calls = []
    real = engine.parse
    monkeypatch.setattr(engine, "parse", lambda rows, t, o: calls.append((t, rows)) or real(rows, t, o))
    (tmp_path / "auth.log").write_text("Jan  2 03:04:05 h sshd[1]: Failed password for joe from 1.2.3.4 port 5 ssh2\n" * 3)
    (tmp_path / "k.log").write_text("a=1 b=2\nc=3 d=4\n")
    events, manifest = engine.ingest(spark, str(tmp_path))
    assert sorted(t for t, _ in calls) == ["auth", "logfmt"]
    for t, rows in calls:  # each parser reads the folder of its type
        assert re.search(rf"type#\d+ = {t}\)", rows._jdf.queryExecution().executedPlan().toString())
    assert "MapIn" not in events._jdf.queryExecution().executedPlan().toString()  # what was written, not the parsers
    assert {r["src_file"]: r["events"] for r in manifest.collect()} == {"auth.log": 3, "k.log": 2}


def test_one_file_of_no_known_type_is_an_error(spark, tmp_path):
    (tmp_path / "prose").write_text("one\ntwo\nthree\n")
    with pytest.raises(ValueError, match="cannot be told"):
        engine.ingest(spark, str(tmp_path / "prose"), catch_all=False)
    assert engine.ingest(spark, str(tmp_path / "prose"))[0].count() == 3
    assert engine.ingest(spark, str(tmp_path / "prose"), kind="raw", catch_all=False)[0].count() == 3
    assert engine.ingest(spark, str(tmp_path), catch_all=False)[1].first()["status"] == "skipped"
