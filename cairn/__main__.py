"""``python -m cairn STORE COMMAND ...``: the store's commands, one at a time or line by line (``shell``)."""

from __future__ import annotations

import argparse
import dataclasses
import filecmp
import json
import os
import shlex
import shutil
import sys
import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from cairn.functions.checks import human
from cairn.session import local_session, prepare
from cairn.sources import bytestore
from cairn.store import IndexUnavailable, SnapshotStore, StoreError

#: Commands that need no index.
FREE = {"list", "remove", "fsck", "unlock", "help"}


def workspace(store: SnapshotStore) -> str:
    """A new folder beside the store: executors that reach the store reach it too."""
    folder = f"{os.path.abspath(store.path.removeprefix('file:'))}.work-{uuid.uuid4().hex[:8]}"
    os.makedirs(folder)
    return folder


def roundtrip(store: SnapshotStore, root: str) -> dict:
    """Back up, restore and compare a folder; seconds for each."""
    name, work, t = "benchmark", workspace(store), [time.time()]
    out = os.path.join(work, "out")
    stats = store.backup(root, name)
    t.append(time.time())
    store.restore(name, out)
    t.append(time.time())
    files = [os.path.relpath(os.path.join(d, n), root) for d, _, names in os.walk(root) for n in names]
    _, other, failed = filecmp.cmpfiles(root, out, files, shallow=False)
    shutil.rmtree(work)
    return {**stats, "backup_s": round(t[1] - t[0], 2), "restore_s": round(t[2] - t[1], 2), "identical": not other and not failed}


def dedup_scenarios(store: SnapshotStore, root: str) -> list[dict]:
    """Growth over four backups: first, unchanged, one file with 64 KiB more, two copies of the folder; and in all."""
    work = workspace(store)
    tree, pair = os.path.join(work, "tree"), os.path.join(work, "pair")
    shutil.copytree(root, tree)
    rows = []

    def backup(scenario: str, folder: str) -> None:
        began = time.time()
        s = store.backup(folder, f"bench-{len(rows) + 1}")
        rows.append({"scenario": scenario, "actual": s["logical_bytes"], "stored": s["stored_bytes"], "seconds": round(time.time() - began, 1)})

    backup("first backup", tree)
    backup("unchanged", tree)
    first = min(os.path.join(d, n) for d, _, names in os.walk(tree) for n in names)
    with open(first, "ab") as f:
        f.write(os.urandom(64 << 10))
    backup("one file with 64 KiB more", tree)
    for k in "ab":
        shutil.copytree(tree, os.path.join(pair, k))
    backup("two copies", pair)
    shutil.rmtree(work)
    rows.append({"scenario": "in all"} | {c: sum(r[c] for r in rows) for c in ("actual", "stored", "seconds")})
    return [r | {"saved_pct": round(100 * (1 - r["stored"] / max(1, r["actual"])), 1)} for r in rows]


def import_store(store: SnapshotStore, folder: str) -> list[dict]:
    """Take over every snapshot of a store in the byte format; files are cut and named anew."""
    spark = store.spark
    kinds = bytestore.read_manifests(spark, folder).select("snapshot", "is_directory").distinct().collect()
    return [{"snapshot": r.snapshot, **store.ingest(bytestore.read_files(spark, folder, r.snapshot), r.snapshot, r.is_directory)} for r in sorted(kinds)]


def export_store(store: SnapshotStore, folder: str, as_log: bool = False) -> dict:
    """Write all snapshots, and the objects in force, in the byte format."""
    store.verify_checkpoint()
    return {"snapshots": bytestore.export(store.objects().join(store.index(), ["digest", "pack_id", "offset"]), store.entries(), folder, as_log)}


@dataclass
class Command:
    run: Callable[[SnapshotStore, argparse.Namespace], object]
    report: Callable[[object, argparse.Namespace], Iterable[str]]
    about: str
    args: tuple[str, ...] = ()


def _rows(rows: list[dict], _) -> list[str]:
    return [", ".join(f"{k} {v}" for k, v in r.items()) for r in rows]


def _row(row: dict, a) -> list[str]:
    return _rows([row], a)


def _gc(r: dict, _) -> list[str]:
    t = r["totals"]
    live, dead = t["live_objects"], t["garbage_objects"]
    out = [f"{live + dead} objects, {live} live, {dead} garbage, {human(t['garbage_bytes'])} to reclaim, {t['orphan_objects']} not indexed"]
    if r["dangling"]:
        out.append(f"{r['dangling']} referenced chunks are not in the index; run fsck")
    if not r["packs"]:
        return [*out, "nothing to compact"]
    done = f"would compact {len(r['packs'])} packs" if r["dry_run"] else f"compacted {len(r['packs'])} packs, {human(r['reclaimed'])} reclaimed"
    return [*out, done]


def _fsck(r: dict, _) -> list[str]:
    out = [f"rebuilt the index with {r['rebuilt']} objects"] if r["rebuilt"] is not None else []
    out.append(f"{r['snapshots']} snapshots, {r['live_chunks']} references")
    out += [f"{r[k]} {what}" for k, what in (("corrupt", "corrupt objects"), ("duplicated", "places with more than one object"), ("unplaced", "index entries without an object")) if r[k]]
    if r["dangling"]:
        out += [f"{r['dangling']} dangling references; not to be restored:", *(f"  {n}" for n in r["broken"])]
    return out if len(out) > 1 + (r["rebuilt"] is not None) else [*out, "ok"]


def _scenarios(rows: list[dict], _) -> list[str]:
    return [f"{'scenario':28}{'actual MB':>12}{'stored MB':>12}{'saved %':>10}{'s':>8}"] + [f"{r['scenario']:28}{r['actual'] / 2**20:>12.2f}{r['stored'] / 2**20:>12.2f}{r['saved_pct']:>10}{r['seconds']:>8}" for r in rows]


COMMANDS = {
    "backup": Command(lambda s, a: s.backup(a.path, a.name), lambda r, a: [f"{a.name}: {r['files']} files, {human(r['logical_bytes'])}, {r['new_objects']} new objects, {human(r['stored_bytes'])} stored"], "store a file or a folder as a snapshot", ("path", "name")),
    "restore": Command(lambda s, a: {"files": s.restore(a.name, a.out)}, lambda r, a: [f"{r['files']} files in {a.out}"], "write a snapshot's files", ("name", "out")),
    "list": Command(lambda s, a: [r.asDict() for r in s.list().collect()], lambda r, a: [f"{x['name']:28}{human(x['manifest_bytes']):>10}" for x in r] or ["no snapshots"], "the snapshots"),
    "remove": Command(lambda s, a: s.remove(a.name), lambda r, a: [f"removed {a.name}; gc reclaims its space"], "forget a snapshot", ("name",)),
    "info": Command(lambda s, a: [r.asDict() for r in s.info(a.name).collect()], _rows, "files and chunks of a snapshot", ("name",)),
    "gc": Command(lambda s, a: dataclasses.asdict(s.gc(a.dry_run)), _gc, "reclaim what no snapshot needs", ("--dry-run",)),
    "fsck": Command(lambda s, a: dataclasses.asdict(s.fsck(a.rebuild, a.deep)), _fsck, "hold references, index and objects against each other", ("--rebuild", "--deep")),
    "checkpoint": Command(lambda s, a: {"version": s.checkpoint()}, lambda r, a: [f"checkpoint {r['version']}"], "write the index whole"),
    "unlock": Command(lambda s, a: s.unlock(), lambda r, a: ["not locked" if r is None else f"unlocked; was held by {r}"], "remove the lock of a writer that has died elsewhere"),
    "benchmark": Command(lambda s, a: roundtrip(s, a.path), _row, "back up, restore and compare a folder", ("path",)),
    "dedup-bench": Command(lambda s, a: dedup_scenarios(s, a.path), _scenarios, "growth of the store over four backups", ("path",)),
    "import": Command(lambda s, a: import_store(s, a.folder), _rows, "take over a store in the byte format", ("folder",)),
    "export": Command(lambda s, a: export_store(s, a.folder, a.as_log), _row, "write the store in the byte format", ("folder", "--as-log")),
    "help": Command(lambda s, a: None, lambda r, a: [f"{' '.join([n, *c.args]):28}{c.about}" for n, c in COMMANDS.items()], "the commands"),
}


class Parser(argparse.ArgumentParser):
    def error(self, message: str):
        raise StoreError(message)


def parser() -> Parser:
    p = Parser(prog="cairn", add_help=False)
    commands = p.add_subparsers(dest="command", required=True, parser_class=Parser)
    for name, c in COMMANDS.items():
        sub = commands.add_parser(name, add_help=False)
        sub.add_argument("--json", action="store_true")
        for a in c.args:
            sub.add_argument(a, **({"action": "store_true"} if a.startswith("--") else {}))
    return p


def execute(store: SnapshotStore, words: list[str]) -> list[str]:
    """Run one command; its report as lines."""
    if words and words[0] not in COMMANDS:
        raise StoreError(f"unknown command {words[0]!r}; see help")
    a = parser().parse_args(words)
    if a.command not in FREE:
        try:
            store.verify_checkpoint()
        except IndexUnavailable as e:
            raise IndexUnavailable(f"index unavailable: {e}; fsck --rebuild makes it anew from the objects") from e
    c = COMMANDS[a.command]
    out = c.run(store, a)
    if a.json:
        return [json.dumps(r) for r in (out if isinstance(out, list) else [out])]
    return list(c.report(out, a))


def shell(store: SnapshotStore, lines: Iterable[str], say: Callable[[str], object] = print) -> None:
    """Commands line by line until ``exit`` or the end; an error ends the line only."""
    for line in lines:
        try:
            words = shlex.split(line)
            if words and words[0].lstrip(":") in ("exit", "quit", "q"):
                return
            if words:
                words[0] = words[0].lstrip(":")
                for text in execute(store, words):
                    say(text)
        except Exception as e:
            say(str(e).splitlines()[0] if str(e) else type(e).__name__)


def main(argv: list[str] | None = None) -> int:
    words = sys.argv[1:] if argv is None else argv
    if not words:
        print("usage: python -m cairn STORE [COMMAND ...]; without a command, commands are read line by line\n")
        print("\n".join(COMMANDS["help"].report(None, None)))
        return 2
    spark = local_session(os.cpu_count() or 2)
    prepare(spark)
    store = SnapshotStore(spark, words[0])
    if not words[1:] or words[1] == "shell":
        shell(store, sys.stdin)
        return 0
    try:
        for text in execute(store, words[1:]):
            print(text)
    except StoreError as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
