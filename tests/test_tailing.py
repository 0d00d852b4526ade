import random

from hostweave.sources import tailing
from hostweave.streaming import live


def test_ranges_give_every_line_once(tmp_path, monkeypatch):
    monkeypatch.setattr(tailing, "BLOCK", 7)
    monkeypatch.setattr(tailing, "BACK", 5)
    r = random.Random(3)
    path = tmp_path / "a.log"
    for split in (1, 3, 10, 1000):
        monkeypatch.setattr(tailing, "SPLIT", split)
        lines = ["x" * r.choice([0, 1, 2, 9, 40]) for _ in range(60)]
        path.write_bytes("".join(x + "\n" for x in lines).encode() + b"not yet")
        reader = tailing.TailReader({"s": str(tmp_path)})
        seen, start = [], reader.initialOffset()
        end = reader.latestOffset()
        for part in reader.partitions(start, end):
            for batch in reader.read(part):
                seen += zip(batch.column("offset").to_pylist(), batch.column("raw").to_pylist(), strict=True)
        places = [sum(len(x) + 1 for x in lines[:i]) for i in range(len(lines))]
        assert sorted(seen) == list(zip(places, lines, strict=True))
        assert end == {"s": {str(path): path.stat().st_size - 7}}


def test_offsets_follow_growing_shrinking_and_missing_files(tmp_path):
    a, b = tmp_path / "in" / "a.log", tmp_path / "in" / "b.log"
    a.parent.mkdir()
    reader = tailing.TailReader({"s": f"file:{tmp_path}/in", "none": str(tmp_path / "absent")})
    assert reader.latestOffset() == {"s": {}, "none": {}}

    def added(start):
        end = reader.latestOffset()
        rows = [x for p in reader.partitions(start, end) for batch in reader.read(p) for x in batch.column("raw").to_pylist()]
        return end, sorted(rows)

    a.write_text("1\n2\n")
    (a.parent / "_SUCCESS").write_text("no\n")
    offset, rows = added(reader.initialOffset())
    assert rows == ["1", "2"]
    with a.open("a") as f:
        f.write("3\r\n4")
    b.write_bytes(b"\xff\n")
    offset, rows = added(offset)
    assert rows == ["3", "�"]
    a.write_text("5\n")
    offset, rows = added(offset)
    assert rows == ["5"]
    b.unlink()
    offset, rows = added(offset)
    assert rows == [] and list(offset["s"]) == [str(a)]


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    logs, out = tmp_path / "logs", str(tmp_path / "out")
    logs.mkdir()

    def read():
        stream = live.tail_folders(spark, {"main": str(logs), "other": str(tmp_path / "absent")})
        live.start(stream, lambda b, i: b.write.mode("overwrite").parquet(f"{out}/batch={i}"), str(tmp_path / "ckpt")).awaitTermination()
        return sorted((r.source, r.raw) for r in spark.read.parquet(out).collect())

    (logs / "a.log").write_text("1\n\n 2 \n")
    assert read() == [("main", "1"), ("main", "2")]
    with (logs / "a.log").open("a") as f:
        f.write("3\n")
    (logs / "b.log").write_text("4\n")
    assert read() == [("main", x) for x in "1234"]
    (logs / "a.log").write_text("5\n")
    assert read() == [("main", x) for x in "12345"]
