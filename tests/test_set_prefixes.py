"""Token sets: rare tokens first, hub slots only where sets may be one token apart, all pairs found."""

import random

from pyspark.sql import functions as F

from clauseloom.operators import setsim as S


def _sets(spark, rows):
    return S.distinct_sets(spark.createDataFrame(rows, "id bigint, type string, text string"))[0]


def test_rare_tokens_come_first(spark):
    # "zz" is in half of the sets and goes last; "b1" is in three sets and goes behind "aa", which is in one
    rows = [(i, "t", " ".join(f"b{k}" for k in range(30 * i, 30 * i + 30))) for i in range(100)]
    rows += [(100 + i, t, text + " zz") for i, t, text in rows] + [(999, "t", "b1 aa")]
    got = S._rarest_first(_sets(spark, rows)).where("rep = 999").first()
    token = {r["t"]: r["h"] for r in spark.createDataFrame([("aa",), ("b1",)], "t string").select(
        "t", F.xxhash64(F.lit("t"), "t").alias("h")).collect()}
    assert list(got["o"]) == [token["aa"], token["b1"]]
    order = S._rarest_first(_sets(spark, rows)).where("rep >= 100 AND rep < 200").collect()
    zz = spark.range(1).select(F.xxhash64(F.lit("t"), F.lit("zz"))).first()[0]
    assert all(list(r["o"]).index(zz) == len(r["o"]) - 1 for r in order)


def test_only_sets_that_may_share_a_hub_get_slots(spark):
    rows = [(i, "t", " ".join(f"w{i}_{k}" for k in range(30))) for i in range(50)]
    rows += [(100, "t", rows[0][2].replace("w0_7", "x")), (101, "t", rows[0][2].replace("w0_7", "y"))]
    sets = _sets(spark, rows)
    assert {r["rep"] for r in S._maybe_one_apart(sets).collect()} == {0, 100, 101}
    assert {r["rep"] for r in S.hubs(sets, 0.7).collect()} == {0, 100, 101}


def test_pairs_equal_brute_force(spark):
    rng = random.Random(7)
    words = [f"t{k}" for k in range(400)]
    texts = []
    for i in range(240):
        if texts and rng.random() < 0.7:
            base = sorted(rng.choice(texts))
            texts.append((set(base) - set(rng.sample(base, rng.randint(0, len(base) // 4)))) | set(rng.choices(words, k=rng.randint(0, 5))))
        else:
            texts.append({words[min(int(rng.paretovariate(0.6)) - 1, 399)] for _ in range(rng.randint(3, 120))})
    rows = [(i, rng.choice("ab"), " ".join(sorted(t))) for i, t in enumerate(texts)]
    sets = _sets(spark, rows)
    kept = {r["rep"]: (r["type"], set(r["tokens"])) for r in sets.collect()}
    want_pairs, want_one = set(), set()
    for a in kept:
        for b in kept:
            (ta, x), (tb, y) = kept[a], kept[b]
            if a < b and ta == tb and len(x & y) / len(x | y) >= 0.7:
                one = len(x) == len(y) == len(x & y) + 1
                (want_one if one else want_pairs).add((a, b))
    assert {(r["rep_a"], r["rep_b"]) for r in S.explicit_pairs(sets, 0.7).collect()} == want_pairs and want_pairs
    hubs = {}
    for r in S.hubs(sets, 0.7).collect():
        hubs.setdefault((r["type"], r["hub_rep"], r["hub_token"]), set()).add(r["rep"])
    assert {(a, b) for m in hubs.values() for a in m for b in m if a < b} == want_one
