"""Sets as short codes in ranges of sizes: nothing is lost, pairs that only meet are not written, texts stay where they are."""

import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from clauseloom import session
from clauseloom.operators import setsim as S
from clauseloom.operators import settiles

COLUMNS = "id bigint, type string, text string"


def _similar(kept, t=0.7):
    pairs, hubs = set(), set()
    for a, (ta, x) in kept.items():
        for b, (tb, y) in kept.items():
            if a < b and ta == tb and len(x & y) / len(x | y) >= t:
                (hubs if len(x) == len(y) == len(x & y) + 1 else pairs).add((a, b))
    return pairs, hubs


def _rows():
    rng, texts = random.Random(11), []
    for _ in range(300):
        if texts and rng.random() < 0.7:
            base = sorted(rng.choice(texts))
            texts.append((set(base) - set(rng.sample(base, rng.randint(0, len(base) // 5)))) | {f"t{rng.randint(0, 400)}" for _ in range(rng.randint(0, 6))})
        else:
            texts.append({f"t{min(int(rng.paretovariate(0.6)), 400)}" for _ in range(rng.randint(2, 140))})
    return [(i, rng.choice("ab"), " ".join(sorted(t))) for i, t in enumerate(texts)]


def test_codes_come_back():
    rng = np.random.default_rng(3)
    known = np.unique(rng.integers(-2**63, 2**63 - 1, 3000))
    rank = rng.permutation(np.arange(1, len(known) + 1)) * 97
    lists = [np.unique(np.concatenate([rng.choice(known, k), rng.integers(-2**63, 2**63 - 1, r)])) for k, r in ((0, 0), (5, 0), (0, 4), (900, 40), (1, 1), (0, 0))]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    rare, common = settiles.packed(np.concatenate(lists), offsets, known, rank)
    for cut in (slice(0, 6), slice(2, 5), slice(5, 6)):
        flat, at = settiles.unpacked(rare[cut], common[cut])
        for i, x in enumerate(lists[cut]):
            assert list(flat[at[i]:at[i + 1]]) == sorted(settiles.codes(x, known, rank))
    assert len(pa.concat_arrays([common]).buffers()[2]) < 3 * 1000


@pytest.mark.parametrize("tokens", [20_000, 400, 60])
def test_pairs_across_ranges_equal_brute_force(spark, monkeypatch, tokens):
    """One range, several, and single sizes cut into parts; few places looked at and few rows at once."""
    monkeypatch.setattr(settiles, "FEW_TOKENS", 1)
    monkeypatch.setattr(settiles, "TILE_TOKENS", tokens)
    rows = _rows()
    sets = S.token_sets(spark.createDataFrame(rows, COLUMNS))
    if tokens < 20_000:
        assert settiles.Layout(sets.sets).homes > 20
    kept = {r["rep"]: (rows[r["rep"]][1], set(rows[r["rep"]][2].split())) for r in sets.sets.collect()}
    pairs, hubs = _similar(kept)
    got = [(r["rep_a"], r["rep_b"]) for r in S.explicit_pairs(sets, 0.7).collect()]
    assert pairs and hubs and len(got) == len(set(got)) and set(got) == pairs
    near = [(r["rep_a"], r["rep_b"]) for r in S.minhash_pairs(sets, 0.7).collect()]
    assert len(near) == len(set(near)) and set(near) <= pairs | hubs and len(set(near)) >= 0.9 * len(pairs | hubs)


def test_small_chunks_give_the_same(monkeypatch):
    monkeypatch.setattr(settiles, "CHUNK", 50)
    texts = [sorted(set(text.split())) for _, _, text in _rows()]
    texts = sorted({tuple(t) for t in texts}, key=lambda t: (len(t), t))
    number = {w: k + 1 for k, w in enumerate(sorted({w for t in texts for w in t}))}
    hashes = [np.array([number[w] for w in t]) for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    every = np.arange(1, len(number) + 1)
    rare, common = settiles.packed(np.concatenate(hashes), offsets, every, every)
    home = settiles._Home(0.7)
    home.add(pa.RecordBatch.from_arrays([pa.array(["t"] * len(texts)), pa.array(range(len(texts))), pa.array([len(t) for t in texts]), rare, common],
                                        ["type", "rep", "size", "rare", "common"]))
    home.hold(True)
    met = [p for b in home.meet(home.type, home.rep, home.size, None, home.at, 0) for p in zip(b["x"].to_pylist(), b["y"].to_pylist(), strict=True)]
    assert {(min(p), max(p)) for p in met} == _similar({i: ("t", set(t)) for i, t in enumerate(texts)})[0]


def test_neither_tokens_nor_places_are_stored(spark, tmp_path, monkeypatch):
    """Texts that meet at twenty tokens each, none of them similar."""
    monkeypatch.setattr(session, "shared_dir", lambda _: str(tmp_path))
    word = lambda k: F.concat(F.lit("w"), F.when(k < 20, k.cast("string")).otherwise(F.sha2(F.concat_ws("_", F.col("id"), k), 256)))
    rows = spark.range(400).select("id", F.lit("t").alias("type"), F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(59)), word)).alias("text"))
    assert [r["n_pairs"] for r in S.pair_counts(rows).collect()] == [0]
    kept = sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(tmp_path) for f in names if f.endswith(".parquet"))
    assert kept < 400 * 60 * 8 / 2  # less than half a hash per token


def test_repeated_ids_and_nulls(spark):
    rows = [(1, "a", "k l m n o p q r s t"), (1, "a", "k l m n o p q r s t"), (2, "a", "k l m n o p q r s t u"), (3, None, "k l m n o p q r s t u"),
            (4, "a", None), (None, "a", "k l m n o p q r s t u v"), (5, "b", "k l m n o p q r s t u"), (6, "a", " ")]
    got = S.similarity_relation(spark.createDataFrame(rows, COLUMNS)).collect()
    assert sorted((r["kind"], r["type"], r["from_id"], r["to_id"]) for r in got if r["kind"] == "pair") == [("pair", "a", 1, 2)] * 2
