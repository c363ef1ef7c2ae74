"""Changes to a stored table: only touched buckets are written, in any order of the changes."""

import glob
import random

from clauseloom.session import scratch_path
from clauseloom.sources import writers as W


def _files(path):
    return {f.split("bucket=")[1] for f in glob.glob(f"{path}/bucket=*/*.parquet")}


def test_changes_in_any_order(spark):
    rng = random.Random(5)
    base = [(f"C{0 if i % 3 == 0 else i % 40}", i, f"t{i}") for i in range(600)] + [(None, 600, "t"), ("C9", None, "n")]
    sets = []
    for version in (1, 2, 3):
        picked = rng.sample(base, 12) + [("C7", 1000 + version, "added")]
        sets.append([(c, s, f"v{version}", version, rng.random() < 0.4) for c, s, _ in picked])
    want = {(c, s): (0, False, t) for c, s, t in base}
    for c, s, t, version, gone in (x for part in sets for x in part):
        want[(c, s)] = max(want.get((c, s), (-1, False, "")), (version, gone, t))
    want = {k: t for k, (_, gone, t) in want.items() if not gone}
    for order in ((0, 1, 2), (2, 0, 1, 1)):
        path = scratch_path(spark, "versions")
        W.write_versions(spark.createDataFrame(base, "c string, s long, t string"), path, "c", 16)
        for i in order:
            before = _files(path)
            changes = spark.createDataFrame(sets[i], "c string, s long, t string, version long, gone boolean")
            touched = W.apply_versions(changes, path, ["c", "s"], "c", 16)
            kept = {f for f in before if int(f.split("/")[0]) not in touched}
            assert kept and kept <= _files(path)
            assert not {f for f in _files(path) - before if int(f.split("/")[0]) not in touched}
        rows = W.read_versions(spark, path).collect()
        assert len(rows) == len(want) and {(r.c, r.s): r.t for r in rows} == want


def test_no_changes(spark):
    path = scratch_path(spark, "versions")
    W.write_versions(spark.createDataFrame([("C", 1, "t")], "c string, s long, t string"), path, "c", 4)
    none = spark.createDataFrame([], "c string, s long, t string, version long, gone boolean")
    assert W.apply_versions(none, path, ["c", "s"], "c", 4) == []
    assert W.read_versions(spark, path).count() == 1
