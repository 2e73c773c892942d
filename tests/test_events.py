"""Change logs, directory renames, feeds, hierarchy and the stream, against sequential replays."""

import os
import random
from datetime import datetime

import pytest

from fileloom.jobs import run
from fileloom.operators import events, hierarchy
from fileloom.operators.folders import FolderNames
from fileloom.schema import CATALOG, CHANGES, NODES, USN, WATCHER
from fileloom.sources import feeds
from fileloom.streaming.catalog_stream import CatalogStore, apply_batch, follow_changes

T0 = datetime(2024, 1, 1)


def replay(rows, log):
    """The catalog as {id: (name, path, is_dir)}, change by change."""
    state = {r[0]: (r[2], r[3], r[6]) for r in rows}
    for _, kind, i, _, name, path, _, _, is_dir, _ in sorted(log):
        if kind == "create":
            state[i] = (name, path, is_dir)
        elif kind == "delete":
            state.pop(i, None)
        elif i in state:
            _, old, is_dir = state[i]
            state[i] = (name, path, is_dir)
            if is_dir:
                for j, (n, p, d) in list(state.items()):
                    if j != i and p.startswith(old + "\\"):
                        state[j] = (n, path + p[len(old) :], d)
    return state


def row(i, path, is_dir=False):
    return (i, None, path.split("\\")[-1], path, 1, T0, is_dir, 0)


def change(seq, kind, i, path=None, is_dir=None):
    name = path.split("\\")[-1] if path else None
    return (seq, kind, i, None, name, path, 1, T0, is_dir, 0)


def result(df):
    return {r.id: (r.name, r.path, r.is_dir) for r in df.collect()}


def random_case(seed):
    """Two levels of directories and files; folders take others' former names, files are made under old paths."""
    rng = random.Random(seed)
    rows = [row(1, r"C:\a", True), row(2, r"C:\a\b", True), row(3, r"D:\c", True)]
    rows += [row(10 + k, rng.choice([r"C:\a", r"C:\a\b", r"D:\c", r"C:\ab"]) + f"\\f{k}") for k in range(8)]
    log = []
    for seq in range(1, 25):
        state = replay(rows, log)
        kind = rng.choice(["create", "delete", "rename", "rename", "move"])
        folders = [p for _, p, d in state.values() if d] + [r"C:\a", r"C:\ab"]
        files = [i for i, (_, _, d) in state.items() if not d]
        dirs = [i for i, (_, _, d) in state.items() if d]
        if kind == "create":
            i = rng.choice([100 + seq, 10])
            log.append(change(seq, "create", i, rng.choice(folders) + f"\\n{seq}", False))
        elif kind == "delete" and files:
            log.append(change(seq, "delete", rng.choice([*files, 999])))
        elif kind == "rename" and files:
            log.append(change(seq, "rename", rng.choice([*files, 998]), rng.choice(folders) + f"\\r{seq}"))
        elif kind == "move" and dirs:
            i = rng.choice(dirs)
            own = state[i][1]
            other = [p for p in folders if not (p + "\\").startswith(own + "\\")] or ["C:"]
            log.append(change(seq, "rename", i, rng.choice([*other, "C:"]) + f"\\d{seq}"))
    return rows, log


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("literal,most", [(2000, 0), (0, 2000), (0, 0)])
def test_changes_match_a_replay(spark, seed, literal, most, monkeypatch):
    monkeypatch.setattr(events, "LITERAL_RENAMES", literal)
    monkeypatch.setattr(events, "MOST_RENAMES", most)
    rows, log = random_case(seed)
    got = events.apply_changes(spark.createDataFrame(rows, CATALOG), spark.createDataFrame(log, CHANGES))
    assert result(got) == replay(rows, log)


def nested_case(seed):
    """Four levels of directories, renamed again and again, also back to former names and to where they are."""
    rng = random.Random(seed)
    dirs = {1: r"C:\a", 2: r"C:\a\b", 3: r"C:\a\b\c", 4: r"C:\a\b\c\d", 5: r"D:\e", 6: r"D:\e\f"}
    rows = [row(i, p, True) for i, p in dirs.items()] + [row(10 + i, p + r"\x", False) for i, p in dirs.items()]
    log = []
    for seq in range(1, 16):
        state = replay(rows, log)
        i = rng.choice(list(dirs))
        own = state[i][1]
        places = [p for _, p, d in state.values() if d and not (p + "\\").startswith(own + "\\")] + ["C:", "D:"]
        new = own if rng.random() < 0.1 else rng.choice(places) + "\\" + rng.choice("abcdef")
        if new == own or new not in {p for _, p, _ in state.values()}:
            log.append(change(seq, "rename", i, new))
    return rows, log


def test_folder_names_against_renames_one_by_one():
    """Paths at random times, followed to others; folders are renamed onto others, into themselves and out of themselves."""
    rng = random.Random(5)
    for _ in range(300):
        tree = ["C:", r"C:\a", r"C:\b", r"C:\a\b", r"C:\a\c", "C:/a", r"C:\a\b\d", r"C:\ab", r"D:\a", r"C:\b\c"]
        renames = [(s, rng.choice(tree[1:]), rng.choice(tree[1:])) for s in range(1, 12)]
        names = FolderNames(renames)
        for _ in range(20):
            since, until = sorted(rng.choices(range(13), k=2))
            path = want = rng.choice(tree) + rng.choice(["", r"\x", "/y", r"\b\z", "\\"])
            for s, old, new in renames:
                if since < s < until and (want.startswith(old + "\\") or want.startswith(old + "/")) and old != new:
                    want = new + want[len(old) :]
            assert names.moved(path, since, until) == want


@pytest.mark.parametrize("seed,literal,small", [(0, 100, True), (1, 100, True), (2, 0, True), (3, 0, False), (4, 0, None)])
def test_nested_directory_renames_match_a_replay(spark, seed, literal, small, monkeypatch):
    monkeypatch.setattr(events, "LITERAL_RENAMES", literal)
    if small is None:
        monkeypatch.setattr(events, "MOST_RENAMES", 0)
    if small is False:
        monkeypatch.setattr(events, "BROADCAST_BYTES", -1)
    rows, log = nested_case(seed)
    catalog, changes = spark.createDataFrame(rows, CATALOG), spark.createDataFrame(log, CHANGES)
    assert result(events.apply_changes(catalog, changes)) == replay(rows, log)
    want = set()
    for k, entry in enumerate(sorted(log)):
        old = replay(rows, sorted(log)[:k])[entry[2]][1]
        if old != entry[5]:
            want.add((entry[0], old, entry[5]))
    renames = events.directory_renames(catalog, changes)
    assert {(r.seq, r.old, r.new) for r in renames.collect()} == want
    below = {r.id for r in events.rows_below(catalog, renames).collect()}
    assert below == {r[0] for r in rows if any(r[3].startswith(old + "\\") for _, old, _ in want)}


def test_rename_keeps_the_rest_of_a_row(spark):
    catalog = spark.createDataFrame([(1, 7, "a", r"C:\a", 5, T0, False, 3)], CATALOG)
    log = spark.createDataFrame([change(1, "rename", 1, r"C:\b"), change(2, "rename", 2, r"C:\c")], CHANGES)
    (r,) = events.fold_changes(catalog, log).collect()
    assert (r.id, r.parent_id, r.name, r.path, r.size, r.attributes) == (1, 7, "b", r"C:\b", 5, 3)


def test_no_changes(spark):
    catalog = spark.createDataFrame([row(1, r"C:\a", True)], CATALOG)
    assert result(events.apply_changes(catalog, spark.createDataFrame([], CHANGES))) == {1: ("a", r"C:\a", True)}


def test_journal_reasons(spark):
    reasons = [0x100, 0x200, 0x2000, 0x1000, 0x2300, 0x80000100, 0x2100, 0]
    rows = [(k, k, 5, r, f"n{k}", f"C:\\n{k}", 1, T0, False) for k, r in enumerate(reasons)]
    got = {r.seq: r.kind for r in feeds.journal_changes(spark.createDataFrame(rows, USN)).collect()}
    assert got == {0: "create", 1: "delete", 2: "rename", 4: "delete", 5: "create", 6: "rename"}


def watch_replay(catalog, rows, first):
    at, out = dict(catalog), []
    for seq, kind, path, new, *_ in sorted(rows):
        if kind == "create":
            out.append((seq, "create", first, path))
            at[path], first = first, first + 1
        elif kind == "delete" and path in at:
            out.append((seq, "delete", at.pop(path), None))
        elif kind == "rename" and new is not None and path in at:
            i = at.pop(path)
            out.append((seq, "rename", i, new))
            at[new] = i
    return out


@pytest.mark.parametrize("seed,parts", [(0, 64), (1, 64), (2, 3), (3, 1)])
def test_watcher_ids_see_earlier_rows(spark, seed, parts, monkeypatch):
    monkeypatch.setattr(feeds, "PARTS", parts)
    rng = random.Random(seed)
    paths = [f"C:\\p{k}" for k in range(6)]
    rows = []
    for seq in range(1, 40):
        kind = rng.choice(["create", "delete", "rename", "rename", "modify"])
        rows.append((seq, kind, rng.choice(paths), rng.choice([*paths, None]) if kind == "rename" else None, False, 1, T0))
    # A row that asks for a path that nothing was put at is dropped, and so does not take or put anything either.
    rows = [r for r in rows if r[1] != "rename" or r[2] != r[3]]
    catalog = {"C:\\p0": 3, "C:\\p1": 4}
    table = spark.createDataFrame([row(i, p) for p, i in catalog.items()], CATALOG)
    got = feeds.watcher_changes(spark.createDataFrame(rows, WATCHER), table, 50)
    assert sorted((r.seq, r.kind, r.id, r.path) for r in got.collect()) == watch_replay(catalog, rows, 50)


def tree_replay(catalog, rows, first):
    """watch_replay with directories: catalog is {path: (id, is_dir)}, unique in paths."""
    at, out = dict(catalog), []
    for seq, kind, path, new, is_dir, *_ in sorted(rows):
        if kind == "create":
            out.append((seq, "create", first, path))
            at[path], first = (first, is_dir), first + 1
        elif kind == "delete" and path in at:
            out.append((seq, "delete", at.pop(path)[0], None))
        elif kind == "rename" and new is not None and path in at:
            i, d = at.pop(path)
            out.append((seq, "rename", i, new))
            if d:
                for p in [p for p in at if p.startswith(path + "\\")]:
                    at[new + p[len(path) :]] = at.pop(p)
            at[new] = (i, d)
    return out, at


@pytest.mark.parametrize("seed", range(4))
def test_watcher_batches_with_directory_renames(spark, seed):
    rng = random.Random(seed)
    catalog = {r"C:\a": (1, True), r"C:\a\x": (2, False), r"C:\a\s": (3, True), r"C:\a\s\y": (4, False), r"C:\c": (5, True)}
    rows = [(1, "rename", r"C:\a", r"C:\b", True, 0, T0), (2, "delete", r"C:\b\x", None, False, 0, T0), (3, "create", r"C:\b\z", None, False, 1, T0)] if seed == 0 else []
    for seq in range(10, 26):
        _, at = tree_replay(catalog, rows, 50)
        dirs = [p for p, (_, d) in at.items() if d] or ["C:"]
        some = rng.choice([*at, r"C:\gone", r"C:\a\x"])
        free = f"{rng.choice(dirs)}\\n{seq}"
        kind = rng.choice(["create", "create", "delete", "rename", "rename", "dir", "modify"])
        if kind == "rename" and not free.startswith(some + "\\"):
            # Not every watcher knows what it was that moved.
            rows.append((seq, "rename", some, free, rng.random() < 0.5 and at.get(some, (0, False))[1], 0, T0))
        elif kind in ("create", "dir"):
            rows.append((seq, "create", free, None, kind == "dir", 1, T0))
        elif kind in ("delete", "modify") and not at.get(some, (0, False))[1]:
            rows.append((seq, kind, some, None, False, 0, T0))
    want, at = tree_replay(catalog, rows, 50)
    table = spark.createDataFrame([row(i, p, d) for p, (i, d) in catalog.items()], CATALOG)
    got = feeds.watcher_changes(spark.createDataFrame(rows, WATCHER), table, 50)
    assert sorted((r.seq, r.kind, r.id, r.path) for r in got.collect()) == want
    after = events.apply_changes(table, got)
    assert {r.path: (r.id, r.is_dir) for r in after.collect()} == at


def counted_cuts(monkeypatch):
    """Tables that the feed writes, and passes over the catalog as changed so far."""
    cuts, passes, cut, apply = [], [], feeds.cut, events.apply_changes
    monkeypatch.setattr(feeds, "cut", lambda df: cuts.append(1) or cut(df))
    monkeypatch.setattr(events, "apply_changes", lambda *args: passes.append(1) or apply(*args))
    return cuts, passes


@pytest.mark.parametrize("marked", [True, False])
def test_a_batch_of_many_directory_renames_takes_as_many_passes_as_two(spark, marked, monkeypatch):
    catalog = {r"C:\a": (1, True), r"C:\a\s": (2, True), r"C:\a\s\y": (3, False), r"C:\q": (4, True), r"C:\q\f": (5, False)}
    table = spark.createDataFrame([row(i, p, d) for p, (i, d) in catalog.items()], CATALOG)
    taken = {}
    for many in (2, 120):
        rows, at, sub = [], r"C:\a", "s"
        for k in range(many):
            # In turn: the folder, its subfolder, a file within, and a folder that goes in and out of it.
            new = f"C:\\a{k}"
            rows.append((10 * k + 1, "rename", at, new, marked, 0, T0))
            at = new
            if k % 3 == 1:
                rows.append((10 * k + 2, "rename", f"{at}\\{sub}", f"{at}\\s{k}", marked, 0, T0))
                sub = f"s{k}"
            rows.append((10 * k + 3, "create", f"{at}\\{sub}\\n{k}", None, False, 1, T0))
            if k % 5 == 0:
                rows.append((10 * k + 4, "rename", r"C:\q", f"{at}\\{sub}\\q", marked, 0, T0))
                rows.append((10 * k + 5, "rename", f"{at}\\{sub}\\q\\f", f"{at}\\{sub}\\q\\g", False, 0, T0))
                rows.append((10 * k + 6, "rename", f"{at}\\{sub}\\q\\g", f"{at}\\{sub}\\q\\f", False, 0, T0))
                rows.append((10 * k + 7, "rename", f"{at}\\{sub}\\q", r"C:\q", marked, 0, T0))
            rows.append((10 * k + 8, "delete", f"{at}\\{sub}\\n{k - 1}" if k % 2 else r"C:\a\s\y", None, False, 0, T0))
        with monkeypatch.context() as m:
            cuts, passes = counted_cuts(m)
            got = feeds.watcher_changes(spark.createDataFrame(rows, WATCHER), table, 50)
            want, at = tree_replay(catalog, rows, 50)
            assert sorted((r.seq, r.kind, r.id, r.path) for r in got.collect()) == want
        taken[many] = len(cuts), len(passes)
    # Chains of renames are followed by doubling: some tables more for 60 times as many renames.
    assert taken[2][1] == taken[120][1] == 0 and taken[120][0] <= taken[2][0] + (40 if marked else 100)


@pytest.mark.parametrize("most", [100_000, 2])
def test_renames_onto_directories_that_hold_something(spark, most, monkeypatch):
    """What a deleted directory has left is seen beside what is moved there; it isn't where it has gone before."""
    monkeypatch.setattr(events, "MOST_RENAMES", most)
    catalog = {r"C:\a": (1, True), r"C:\a\x": (2, False), r"C:\b": (3, True), r"C:\b\y": (4, False), r"C:\c": (5, True), r"C:\c\z": (6, False), r"C:\d": (7, True), r"C:\d\w": (8, False)}
    rows = [
        (1, "delete", r"C:\b", None, True, 0, T0), (2, "rename", r"C:\a", r"C:\b", True, 0, T0), (3, "rename", r"C:\b\y", r"C:\b\y2", False, 0, T0),
        (4, "rename", r"C:\b", r"C:\e", True, 0, T0), (5, "delete", r"C:\e\y2", None, False, 0, T0), (6, "rename", r"C:\e\x", r"C:\b\x", False, 0, T0),
        (7, "delete", r"C:\c\z", None, False, 0, T0), (8, "delete", r"C:\c", None, True, 0, T0), (9, "rename", r"C:\d", r"C:\c", True, 0, T0),
        (10, "create", r"C:\c\z", None, False, 1, T0), (11, "create", r"C:\f", None, True, 1, T0), (12, "create", r"C:\f\u", None, False, 1, T0),
        (13, "rename", r"C:\c", r"C:\f\c", True, 0, T0), (14, "rename", r"C:\f", r"C:\c", True, 0, T0), (15, "delete", r"C:\c\c\w", None, False, 0, T0), (16, "rename", r"C:\c\u", r"C:\u", False, 0, T0),
    ]
    table = spark.createDataFrame([row(i, p, d) for p, (i, d) in catalog.items()], CATALOG)
    _, passes = counted_cuts(monkeypatch)
    got = feeds.watcher_changes(spark.createDataFrame(rows, WATCHER), table, 50)
    want, _ = tree_replay(catalog, rows, 50)
    assert sorted((r.seq, r.kind, r.id, r.path) for r in got.collect()) == want
    assert len(passes) == (1 if most > 2 else 2)


def test_rows_that_depend_on_void_rows(spark):
    """A chain of renames from nowhere, over paths at which the catalog has something or not."""
    rows = [(k, "rename", f"C:\\q{k}", f"C:\\q{k + 1}", False, 0, T0) for k in range(40)] + [(50, "delete", "C:\\q40", None, False, 0, T0), (51, "delete", "C:\\q20", None, False, 0, T0)]
    for catalog in ({}, {"C:\\q0": 1}, {"C:\\q20": 2}, {"C:\\q40": 3}):
        table = spark.createDataFrame([row(i, p) for p, i in catalog.items()], CATALOG)
        got = feeds.watcher_changes(spark.createDataFrame(rows, WATCHER), table, 50)
        assert sorted((r.seq, r.kind, r.id, r.path) for r in got.collect()) == watch_replay(catalog, rows, 50)


def test_a_tree_of_renames_from_nowhere_takes_no_pass_over_the_batch_for_each_level(spark, monkeypatch):
    """Two renames lead to each place, and neither brings anything; or one leaf has a file, which goes all the way up."""
    taken = {}
    for levels in (2, 7):
        nodes = range(2**levels - 1, 1, -1)
        rows = [(1000 - k, "rename", f"C:\\t{k}", f"C:\\t{k // 2}", False, 0, T0) for k in nodes]
        rows += [(1001, "delete", "C:\\t1", None, False, 0, T0), (1002, "create", "C:\\t1", None, False, 1, T0), (1003, "rename", "C:\\t1", "C:\\t1", False, 0, T0), (1004, "delete", "C:\\t1", None, False, 0, T0)]
        for catalog in ({}, {f"C:\\t{2**levels - 2}": 3}):
            table = spark.createDataFrame([row(i, p) for p, i in catalog.items()], CATALOG)
            with monkeypatch.context() as m:
                cuts, _ = counted_cuts(m)
                got = feeds.watcher_changes(spark.createDataFrame(rows, WATCHER), table, 50)
                assert sorted((r.seq, r.kind, r.id, r.path) for r in got.collect()) == watch_replay(catalog, rows, 50)
            taken[levels, len(catalog)] = len(cuts)
    assert taken[7, 0] <= taken[2, 0] + 6 and taken[7, 1] <= taken[2, 1] + 10


@pytest.mark.parametrize("levels,size", [(64, 1 << 25), (3, 1 << 25), (64, -1)])
def test_full_paths(spark, levels, size, monkeypatch):
    monkeypatch.setattr(hierarchy, "LEVELS", levels)
    monkeypatch.setattr(hierarchy, "BROADCAST_BYTES", size)
    root = 5
    chain = [(1000 + k, 1000 + k - 1 if k else root, f"d{k}") for k in range(40)]
    rows = [(root, root, "."), (1, root, "a"), (2, 1, "b"), (3, 2, "c.txt"), (4, 77, "orphan"), (6, 6, "self"), (7, 1, ""), (8, 7, "x"), (9, None, "top"), *chain, (11, 12, "p"), (12, 11, "q")]
    nodes = spark.createDataFrame([(i, p, n, False, 0, 0) for i, p, n in rows], NODES)
    got = {r.id: r.path for r in hierarchy.full_paths(nodes, "C:\\").collect()}
    want = {1: "C:\\a", 2: "C:\\a\\b", 3: "C:\\a\\b\\c.txt", 4: "C:\\orphan", 5: "C:\\", 6: "C:\\self", 7: "C:\\", 8: "C:\\x", 9: "C:\\top"}
    assert {i: got[i] for i in want} == want
    assert got[1039] == "C:\\" + "\\".join(f"d{k}" for k in range(40))
    assert got[11].count("\\") == 512 and got[11].endswith("q\\p")


def test_many_directories_under_one_parent(spark):
    """Their level meets them where they lie: no name and no path of another level is shuffled with them."""
    nodes = spark.range(100, 30_100).selectExpr("id", "if(id = 100, 5L, if(id < 20100, 100L, id - 20000)) as parent", "concat('n', id) as name")
    got = {r.id: r.path for r in hierarchy.full_paths(nodes, "C:").collect()}
    assert len(got) == 30_000 and got[101] == "C:\\n100\\n101" and got[20_200] == "C:\\n100\\n200\\n20200"
    plan = hierarchy.full_paths(nodes, "C:")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "array<string>" not in plan


def test_stream_of_batches_equals_one_fold(spark, tmp_path):
    rows, log = random_case(7)
    store = CatalogStore(spark, f"file://{tmp_path}/store")
    store.write(0, 0, spark.createDataFrame(rows, CATALOG), spark.createDataFrame([(r"C:\x", "old")], "path string, body string"))
    log = sorted(log)
    for k, part in enumerate((log[:9], log[9:10], log[10:])):
        spark.createDataFrame(part, CHANGES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{k}")
        stream = spark.readStream.schema(CHANGES).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        follow_changes(stream, store, f"{tmp_path}/checkpoint", once=True).awaitTermination()
    # Batch k writes version k + 1.
    assert result(store.catalog()) == replay(rows, log)
    assert [r.body for r in store.bodies().collect()] == ["old"]
    assert store.current() == (3, log[-1][0])


@pytest.mark.parametrize("fanout", [2, 100])
def test_bodies_and_postings_of_a_store_follow(spark, tmp_path, fanout):
    """Created files are read whatever their size or place, bodies move along, runs are merged."""
    store = CatalogStore(spark, f"file://{tmp_path}/store", fanout)
    rows = [row(1, r"C:\a", True), row(2, r"C:\a\x.txt"), row(3, r"C:\k.txt")]
    store.write(0, 0, spark.createDataFrame(rows, CATALOG), spark.createDataFrame([(r"C:\a\x.txt", "first words"), (r"C:\k.txt", "kept words")], "path string, body string"))

    def extract(files):
        return files.selectExpr("path", "concat('body of ', name) as body").where("path not like '%.bin'")

    log = [
        [change(1, "create", 10, r"C:\a\new.txt", False), change(2, "create", 11, r"C:\data.bin", False)],
        [change(3, "rename", 1, r"C:\b")],
        [change(4, "rename", 3, r"C:\b\k2.txt"), change(5, "create", 12, r"C:\a\x.txt", False)],
        [change(6, "delete", 10), change(7, "create", 13, r"C:\b\new.txt", False)],
        [],
    ]
    for k, part in enumerate(log):
        apply_batch(store, spark.createDataFrame(part, CHANGES), k, extract, follow_renames=True)
        apply_batch(store, spark.createDataFrame(part, CHANGES), k, extract, follow_renames=True)  # run again: nothing
    assert result(store.catalog()) == replay(rows, [c for part in log for c in part])
    want = {r"C:\b\x.txt": "first words", r"C:\b\k2.txt": "kept words", r"C:\a\x.txt": "body of x.txt", r"C:\b\new.txt": "body of new.txt"}
    bodies = {r.path: r.body for r in store.bodies().collect()}
    assert bodies == want
    words = {(r.word, r.path) for r in store.postings().collect()}
    assert words == {(w.lower(), p) for p, b in want.items() for w in b.replace(".", " ").split()}
    assert "path_norm" in store.catalog().columns and store.current() == (5, 7)
    runs = [r.name for r in store._runs()]
    assert len(runs) <= 3 if fanout == 2 else runs == ["0-0", "1-1", "2-2", "3-3", "4-4", "5-5"]
    # A merge with the base leaves out the bodies that no path has any more.
    base = store._merged(store._runs(), None)
    keys = store._table([base], "bodies", "body_key string").select("body_key")
    assert keys.count() == len(want) and {r.body_key for r in keys.collect()} == {r.body_key for r in store.paths().collect()}


def size_of(folder):
    return sum(p.stat().st_size for p in folder.rglob("*.parquet"))


def test_a_renamed_folder_adds_no_bytes_of_bodies(spark, tmp_path):
    store = CatalogStore(spark, f"file://{tmp_path}/store")
    rows = [row(1, r"C:\a", True)] + [row(10 + k, f"C:\\a\\f{k}.txt") for k in range(10_000)]
    bodies = spark.range(10_000).selectExpr("concat(r'C:\\a\\f', id, '.txt') as path", "concat('body ', id, ' ', repeat(md5(cast(id as string)), 8)) as body")
    store.write(0, 0, spark.createDataFrame(rows, CATALOG), bodies)
    apply_batch(store, spark.createDataFrame([change(1, "rename", 1, r"C:\b")], CHANGES), 0, follow_renames=True)
    part, whole = tmp_path / "store" / "runs" / "1-1", tmp_path / "store" / "runs" / "0-0"
    assert spark.read.parquet(f"{part}/bodies").count() == spark.read.parquet(f"{part}/postings").count() == 0
    assert size_of(part / "bodies") < 10_000 < size_of(whole / "bodies")
    moved = {r.path: r.body[:6] for r in store.bodies().where("path like '%f7.txt' or path like '%f77.txt'").collect()}
    assert moved == {r"C:\b\f7.txt": "body 7", r"C:\b\f77.txt": "body 7"} and store.bodies().count() == 10_000
    (hit,) = run.search_store(store, "content:7777 ext:txt", T0).where("name = 'f7777.txt'").collect()
    assert hit.path == r"C:\b\f7777.txt" and hit.content_match and hit.snippet.text.startswith("body 7777")


def test_a_store_of_many_batches_stays_small(spark, tmp_path):
    """Files under the pointers, the runs and the checkpoint folder are bounded, and merges write about what has changed."""
    checkpoints = spark.sparkContext.getCheckpointDir() or feeds.cut(spark.range(1)) and spark.sparkContext.getCheckpointDir()
    files = lambda: sum(len(f) for _, _, f in os.walk(checkpoints.removeprefix("file:")))
    store = CatalogStore(spark, f"file://{tmp_path}/store", fanout=3)
    rows = [row(k, f"C:\\k{k}.txt") for k in range(1, 2001)]
    bodies = spark.range(1, 2001).selectExpr("concat(r'C:\\k', id, '.txt') as path", "concat('w', id) as body")
    store.write(0, 0, spark.createDataFrame(rows, CATALOG), bodies)
    before, log, written = files(), [], []
    for k in range(10):
        part = [change(2 * k + 1, "create", 5000 + k, f"C:\\n{k}.txt", False), change(2 * k + 2, "rename", 1 + k, f"C:\\m{k}.txt")]
        log += part
        extract = lambda new: new.selectExpr("path", "'new' as body")
        apply_batch(store, spark.createDataFrame(part, CHANGES), k, extract, follow_renames=True)
        written.append([r for r in store._runs() if r.hi == k + 1])
    assert result(store.catalog()) == replay(rows, log)
    assert {r.path: r.body for r in store.bodies().collect()} == {p: "new" if i >= 5000 else f"w{i}" for i, (_, p, _) in replay(rows, log).items()}
    folder = tmp_path / "store"
    assert len([p for p in (folder / "current").iterdir() if p.suffix != ".crc"]) == 2
    assert len(list((folder / "runs").iterdir())) <= 10 and files() <= before + 2
    # No batch has written the base again: 20 changes are no quarter of 2000 rows.
    assert store._runs()[0].name == "0-0" and max(r.rows for runs in written for r in runs) <= 50


def test_a_watched_store_is_searched(spark, tmp_path):
    store = CatalogStore(spark, f"file://{tmp_path}/store")
    rows = [(1, "create", r"C:\d", None, True, 0, T0), (2, "create", r"C:\d\plan.txt", None, False, 5, T0), (3, "rename", r"C:\d", r"C:\e", True, 0, T0), (4, "modify", r"C:\e\plan.txt", None, False, 0, T0)]
    spark.createDataFrame(rows, WATCHER).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(WATCHER).parquet(f"{tmp_path}/in")
    extract = lambda files: files.selectExpr("path", "'the plan' as body")
    run.follow_feed(stream, store, f"{tmp_path}/checkpoint", "watcher", extract=extract, follow_renames=True, once=True).awaitTermination()
    assert result(store.catalog()) == {1: ("e", r"C:\e", True), 2: ("plan.txt", r"C:\e\plan.txt", False)}
    (hit,) = run.search_store(store, "plan ext:txt", T0).collect()
    assert hit.path == r"C:\e\plan.txt" and hit.name_match


@pytest.mark.parametrize("follow", [True, False])
def test_bodies_of_files_created_anew_and_renamed_in_one_batch(spark, tmp_path, follow):
    store = CatalogStore(spark, f"file://{tmp_path}/store")
    catalog = spark.createDataFrame([row(1, r"C:\a.txt"), row(2, r"C:\d", True), row(3, r"C:\k.txt")], CATALOG)
    store.write(0, -1, catalog, spark.createDataFrame([(r"C:\a.txt", "old"), (r"C:\k.txt", "kept")], "path string, body string"))
    log = [
        change(1, "create", 1, r"C:\b.txt", False), change(2, "rename", 1, r"C:\c.txt"), change(3, "rename", 3, r"C:\m.txt"),
        change(4, "create", 4, r"C:\d\n.txt", False), change(5, "rename", 2, r"C:\e"),
        change(6, "create", 5, r"C:\gone.txt", False), change(7, "delete", 5),
    ]
    extract = lambda files: files.selectExpr("path", "concat('read at ', path) as body")
    apply_batch(store, spark.createDataFrame(log, CHANGES), 0, extract, follow_renames=follow)
    got = {r.path: r.body for r in store.bodies().collect()}
    if follow:
        read, others = [r"C:\c.txt", r"C:\e\n.txt"], {r"C:\a.txt": "old", r"C:\m.txt": "kept"}
    else:
        read, others = [r"C:\b.txt", r"C:\d\n.txt", r"C:\gone.txt"], {r"C:\a.txt": "old", r"C:\k.txt": "kept"}
    assert got == {p: f"read at {p}" for p in read} | others
