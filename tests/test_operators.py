"""Properties: operators against brute force on small fixtures, with hot keys."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from clauseloom import lookups
from clauseloom.operators import graph as G
from clauseloom.operators import lifecycle as L
from clauseloom.operators import setsim as S
from clauseloom.operators import vectors as V
from clauseloom.operators.numbering import running_number
from clauseloom.session import cut_lineage
from clauseloom.streaming import conformance as C


def test_running_number_with_a_hot_key(spark):
    rows = [(0 if i % 3 == 0 else i % 50, i * 7 % 4001) for i in range(4001)]
    df = spark.createDataFrame(rows, "k int, o long")
    got = {(r.k, r.o): r.n for r in running_number(df, ["k"], "o", "n", buckets=16).collect()}
    seen, want = {}, {}
    for k, o in sorted(rows, key=lambda r: r[1]):
        seen[k] = seen.get(k, 0) + 1
        want[(k, o)] = seen[k]
    assert got == want


def _pairs(texts, t):
    sets = {i: (ty, frozenset(x.lower().split())) for i, ty, x in texts}
    out = {}
    for a in sets:
        for b in sets:
            if a < b and sets[a][0] == sets[b][0]:
                s = len(sets[a][1] & sets[b][1]) / len(sets[a][1] | sets[b][1])
                if s >= t:
                    out[(a, b)] = round(s, 9)
    return out


def _expand(rel):
    """All similar row pairs from the compact relation."""
    members, hubs, out = {}, {}, {}
    for r in rel:
        if r.kind == "copy":
            members.setdefault(r.to_id, {r.to_id}).add(r.from_id)
        elif r.kind == "hub":
            hubs.setdefault((r.type, r.to_id, r.hub_token), []).append((r.from_id, r.score))
    group = lambda rep: members.get(rep, {rep})

    def link(a, b, score):
        for x in group(a):
            for y in group(b):
                out[(min(x, y), max(x, y))] = round(score, 9)

    for rep in members:
        for x in group(rep):
            for y in group(rep):
                if x < y:
                    out[(x, y)] = 1.0
    for items in hubs.values():
        for i, (a, s) in enumerate(items):
            for b, _ in items[i + 1:]:
                link(a, b, s)
    for r in rel:
        if r.kind == "pair":
            link(r.from_id, r.to_id, r.score)
    return out


def test_similarity_relation_equals_brute_force(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(300):
        ty = "hot" if i % 3 == 0 else f"t{i % 4}"
        if rows and rng.random() < 0.6:
            words = rng.choice(rows)[2].split()
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = rng.choice(vocab)
        else:
            words = [rng.choice(vocab) for _ in range(rng.randint(3, 40))]
        rows.append((i, ty, " ".join(words)))
    rows += [(1000 + i, "hot", "This Agreement is made on one day " + f"x{i}") for i in range(40)]
    rows += [(2000 + i, "hot", "the same text in many copies") for i in range(60)]
    df = spark.createDataFrame(rows, "id long, type string, text string")
    rel = S.similarity_relation(df, 0.7).collect()
    want = _pairs(rows, 0.7)
    assert _expand(rel) == want
    counts = {r.type: r.n_pairs for r in S.pair_counts(df, 0.7).collect()}
    types = {i: ty for i, ty, _ in rows}
    by_type = {}
    for a, _ in want:
        by_type[types[a]] = by_type.get(types[a], 0) + 1
    assert {k: v for k, v in counts.items() if v} == by_type


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    vecs = rng.normal(size=(130, 8)).astype("float32")
    rows = [(i, [float(x) for x in vecs[i]], f"t{i % 3}", f"c{i % 11}") for i in range(130)]
    df = spark.createDataFrame(rows, "id long, vec array<float>, type string, contract string")
    got = {}
    for r in V.top_k_by_id(df, k=5, block_rows=40).collect():
        got.setdefault(r.id, []).append((r["rank"], r.other_id, round(r.score, 6)))
    u = vecs.astype("float64")
    u = u / (np.linalg.norm(u, axis=1, keepdims=True) + V.EPSILON)
    s = u @ u.T
    for i in range(130):
        cand = [(-(s[i, j] * (1.1 if i % 3 == j % 3 else 1.0)), j) for j in range(130) if j != i and i % 11 != j % 11]
        want = [(n + 1, j, round(-v, 6)) for n, (v, j) in enumerate(sorted(cand)[:5])]
        assert sorted(got[i]) == want
    pairs = {(r.id_a, r.id_b) for r in V.similar_pairs(df, 0.6, block_rows=33).collect()}
    assert pairs == {(i, j) for i in range(130) for j in range(i + 1, 130) if s[i, j] >= 0.6}


def test_machine_checks(spark):
    states = L.normalized_states(spark.createDataFrame(
        [("m", i, n, "", 0.9, False) for i, n in enumerate(["opened", "checked", "active", "closed", "lost"])],
        "machine string, ord int, name string, description string, confidence double, is_terminal boolean"))
    moves = spark.createDataFrame(
        [("m", "opened", "checked", "GO", 0.9), ("m", "checked", "opened", "BACK", 0.9), ("m", "opened", "active", "GO", 0.9),
         ("m", "active", "closed", "END", 0.9), ("m", "closed", "active", "UNDO", 0.9)],
        "machine string, source string, target string, trigger string, confidence double")
    assert {r.name for r in L.reachable(moves, L.initial_states(states)).collect()} == {"active", "closed"}
    assert [r.source for r in L.non_deterministic(moves).collect()] == ["opened"]
    assert [r.name for r in L.orphan_states(states, moves).collect()] == ["lost"]
    assert [r.source for r in L.terminal_with_exit(states, moves).collect()] == ["closed"]
    s = L.validation_summary(states, moves).first()
    assert s.is_valid and s.n_warnings == 4 and not s.passes_gate
    reasons = {(r.source, r.target): r.reject_reason for r in L.judged_transitions(moves, states).collect()}
    assert reasons[("closed", "active")] == "terminal_source" and reasons[("opened", "checked")] is None


def _events(spark, n=500):
    """One key holds a third of the rows; half of its events fall into one instant."""
    hot = F.col("id") % 3 == 0
    return spark.range(n).select(
        F.when(hot, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 5)).alias("key"),
        F.concat(F.lit("e"), F.col("id") * 7 % 4).alias("event"),
        F.timestamp_seconds(F.when(hot & (F.col("id") % 2 == 0), 90_000).otherwise(F.col("id") * 977 % 100_003)).alias("ts"),
        F.col("id").alias("event_id"))


def _steps(events):
    """key, previous, event, event_id by sorting all events."""
    rows, last = [], {}
    for r in sorted(events.collect(), key=lambda r: (r.ts, r.event_id)):
        if r.key in last:
            rows.append((r.key, last[r.key], r.event, r.event_id))
        last[r.key] = r.event
    return sorted(rows)


def test_observed_steps_do_not_depend_on_the_ranges(spark):
    events = _events(spark)
    want = _steps(events)
    assert len(want) == 500 - 6
    for ranges in (1, 3, 64, None):
        assert sorted((r.key, r.previous, r.event, r.event_id) for r in L.observed_steps(events, ranges).collect()) == want
    assert L.observed_steps(events.where("false")).count() == 0


def test_streamed_steps_with_late_events(spark, tmp_path):
    """Batches in any order, overlapping in time, one given twice: the counts of one sorted run."""
    events, folder = _events(spark), str(tmp_path)
    parts = [F.col("event_id") % 4 == 3, F.col("ts") >= F.timestamp_seconds(F.lit(60_000)), F.lit(True)]
    left = F.lit(True)
    for number, part in enumerate(parts):
        C.keep_batch(events.where(left & part), number, folder)
        left = left & ~part
    C.keep_batch(events.where(parts[0]), 0, folder)
    C.keep_batch(events.where("false"), 9, folder)
    want = Counter((p, e) for _, p, e, _ in _steps(events))
    assert {(r.previous, r.event): r.n_steps for r in C.steps(spark, folder).collect()} == want


def test_streamed_steps_of_no_events(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("key string, event string, ts timestamp, event_id long").parquet(str(tmp_path / "in"))
    C.run(stream, str(tmp_path / "kept"))
    assert C.steps(spark, str(tmp_path / "kept")).count() == 0


def _depths(moves, starts):
    out = {}
    for machine, start in starts:
        out[machine, start], queue = 0, [start]
        for name in queue:
            for m, a, b in moves:
                if m == machine and a == name and (m, b) not in out:
                    out[m, b] = out[m, name] + 1
                    queue.append(b)
    return out


def test_reachable_matches_breadth_first_search(spark):
    rng = random.Random(3)
    moves = [("chain", f"s{i}", f"s{i + 1}") for i in range(11)] + [("chain", "s11", "s7"), ("chain", "x", "s3"), ("chain", "y", "x")]
    moves += [("dense", f"s{a}", f"s{b}") for a in range(9) for b in range(9)]  # self moves and all pairs
    moves += [("loose", f"s{rng.randrange(60)}", f"s{rng.randrange(60)}") for _ in range(75)]
    moves += [("wide", f"a{i}", f"a{i + 1}") for i in range(9)] + [("wide", f"a{i}", f"b{j}") for i in range(9) for j in range(6)]
    starts = [("chain", "s0"), ("dense", "s4"), ("loose", "s1"), ("wide", "a0"), ("alone", "s0")]
    table = spark.createDataFrame(moves + [("chain", "s1", None), (None, "s1", "s2")], "machine string, source string, target string")
    initial = spark.createDataFrame(starts, "machine string, initial string")
    for growth in (0.0, 4.0, 1000.0):  # no shortcuts at all, the usual, always
        assert {(r.machine, r.name): r.depth for r in L.reachable(table, initial, growth).collect()} == _depths(moves, starts)
    assert L.reachable(table, initial.where("false")).count() == 0


def test_reachable_along_a_long_chain(spark, monkeypatch):
    """2,000 states in a row, found in about log2(2,000) rounds."""
    rounds = []
    monkeypatch.setattr(L, "cut_lineage", lambda df: rounds.append(1) or cut_lineage(df))
    moves = spark.range(1999).select(F.lit("m").alias("machine"), F.col("id").alias("source"), (F.col("id") + 1).alias("target"))
    got = L.reachable(moves, spark.createDataFrame([("m", 0)], "machine string, initial long"))
    assert got.count() == 2000 and got.where("depth <> name").count() == 0
    assert len(rounds) <= 13


def test_titles(spark):
    row = spark.range(1).select(
        G.contract_title(F.lit("A_1"), F.array(F.lit("Ab Inc"), F.lit("Cd Inc"), F.lit("Ef Inc")), F.array(F.lit("parties"))).alias("three"),
        G.contract_title(F.lit("A_1"), F.array(F.lit("Ab Inc")), F.array(F.lit("insurance"))).alias("one"),
        G.contract_title(F.lit("deal_9"), F.array().cast("array<string>"), F.array().cast("array<string>")).alias("none")).first()
    assert row.three == "Ab Inc & Cd Inc & Others Agreement"
    assert row.one == "Ab Inc Insurance" and row.none == "Deal 9 Contract"


def test_lookup_sizes():
    rows = lookups.schema_rows()
    kinds = [r[2] for r in rows]
    assert len(lookups.CLAUSE_MAPPINGS) == len(lookups.VARIABLE_SCHEMA) == len(lookups.TEMPLATE_MAP) == 41
    assert len(rows) == 78 and kinds.count("Boolean") == 42 and kinds.count("Duration") == 17
    assert len(lookups.priority_rows()) == 41
