import json

from cairn.__main__ import COMMANDS, dedup_scenarios, main, roundtrip, shell
from cairn.store import PLACE, SnapshotStore


def test_a_session(spark, tmp_path):
    """Commands line by line: reports, errors that end a line only, and what a damaged index still allows."""
    (tmp_path / "in dir").mkdir()
    (tmp_path / "in dir/f.txt").write_bytes(b"some text " * 2_000)
    store, said = SnapshotStore(spark, str(tmp_path / "store")), []

    def run(*lines):
        said.clear()
        shell(store, lines, said.append)
        return list(said)

    assert run("list", ":help", "", "nonsense x", "backup onlyone")[0] == "no snapshots"
    assert len(said) == 1 + len(COMMANDS) + 2 and "unknown command 'nonsense'" in said[-2] and "required" in said[-1]
    out = run(f"backup '{tmp_path}/in dir' s", "list", "info s --json", "fsck", "gc --dry-run", "quit", "never")
    assert out[0].startswith("s: 1 files, 19.5 KB") and out[1].startswith("s  ")
    assert json.loads(out[2])["files"] == 1 and out[3:5] == ["1 snapshots, 1 references", "ok"]
    assert out[-1] == "nothing to compact" and "0 garbage" in out[-2]
    run(f"restore s {tmp_path}/out", "checkpoint")
    assert (tmp_path / "out/f.txt").read_bytes() == b"some text " * 2_000 and said == [f"1 files in {tmp_path}/out", "checkpoint 1"]
    spark.createDataFrame([], PLACE).write.mode("overwrite").parquet(str(tmp_path / "store/index/v=000001"))
    store = SnapshotStore(spark, str(tmp_path / "store"))
    out = run("info s", f"export {tmp_path}/bytes", "list", "fsck", "fsck --rebuild", "unlock", "remove s")
    assert all("fsck --rebuild" in x for x in out[:2]) and out[2].startswith("s  ")
    assert out[3:] == ["1 snapshots, 1 references", "1 dangling references; not to be restored:", "  s", "rebuilt the index with 1 objects", "1 snapshots, 1 references", "ok", "not locked", "removed s; gc reclaims its space"]


def test_benchmarks_and_usage(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / f"in/f{k}").write_bytes(bytes(range(256)) * 40 + b"%d" % k * 9_000)
    store = SnapshotStore(spark, str(tmp_path / "store"))
    assert roundtrip(store, str(tmp_path / "in"))["identical"]
    rows = dedup_scenarios(SnapshotStore(spark, str(tmp_path / "other")), str(tmp_path / "in"))
    assert [r["stored"] > 0 for r in rows] == [True, False, True, False, True] and rows[2]["stored"] < 80_000
    assert rows[3]["actual"] == 2 * rows[2]["actual"] and rows[4]["actual"] == sum(r["actual"] for r in rows[:4])
    assert sorted(p.name for p in tmp_path.iterdir()) == ["in", "other", "store"]
    assert main([]) == 2 and "dedup-bench path" in capsys.readouterr().out
