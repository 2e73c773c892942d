"""The stateful stream against one fold of the whole log."""

import random

import pytest

from fileloom.operators import events
from fileloom.schema import CATALOG, CHANGES
from fileloom.streaming.file_state import PROVIDER, current_files, follow_files
from tests.test_events import change, row


@pytest.mark.parametrize("seed", range(2))
def test_state_equals_one_fold_also_after_restarts(spark, tmp_path, seed):
    rng = random.Random(seed)
    big = 2**62 + 5
    ids = [*range(8), big]
    rows = [(i, big - 1 if i % 2 else None, f"f{i}", f"C:\\f{i}", 10 * i, row(1, "x")[5], False, 3) for i in ids[:5]] + [row(big, r"C:\big")]
    log = []
    for seq in range(1, 60):
        i, kind = rng.choice(ids), rng.choice(["create", "delete", "rename", "rename"])
        log.append(change(seq, kind, i, f"C:\\n{seq}" if kind != "delete" else None, False if kind == "create" else None))
    catalog = spark.createDataFrame(rows, CATALOG)
    cuts = sorted(rng.sample(range(1, len(log)), 3))
    parts = [log[a:b] for a, b in zip([0, *cuts], [*cuts, len(log)], strict=True)]
    folder, was = f"file://{tmp_path}", spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    try:
        for k, part in enumerate(parts):
            rng.shuffle(part)
            # Rows that come again, or that are older than what an id has seen, change nothing.
            late = [c for c in parts[0] if k == 2]
            spark.createDataFrame(part + late, CHANGES).repartition(3).write.parquet(f"{folder}/in/{k}")
            stream = spark.readStream.schema(CHANGES).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
            query = follow_files(stream, f"{folder}/out", f"{folder}/checkpoint", catalog, once=True)
            query.awaitTermination()
            done = [c for p in parts[: k + 1] for c in p]
            want = events.fold_changes(catalog, spark.createDataFrame(done, CHANGES))
            assert sorted(map(tuple, current_files(spark, f"{folder}/out", catalog).collect())) == sorted(map(tuple, want.collect()))
        assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == PROVIDER
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", was)
