"""SimHash groups, spelling variants and token alignment against plain Python, and odd cases."""

import re
import zlib
from bisect import bisect_left
from collections import Counter
from hashlib import sha256
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

SF_DIR = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def entry():
    import __spark_entry__

    return __spark_entry__


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]


def odd_rows(spark, rows):
    """Rows as a table with clashing columns."""
    out = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("print", "key", "word", "n", "row", "pair", "component", "lang"):
        out = out.withColumn(name, F.lit("mine"))
    return out


def plain_print(text):
    words = WORD.findall((text or "").translate(UPPER))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """Smallest id reachable, from (id, fingerprint) pairs; all pairs of fingerprints are compared."""
    distinct = sorted({p for _, p in prints})
    parent = {p: p for p in distinct}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for a, b in combinations(distinct, 2):
        if (a ^ b).bit_count() <= 3:
            parent[root(a)] = root(b)
    by_id = {}
    for i, p in prints:
        if i is not None:
            parent[root(by_id.setdefault(i, p))] = root(p)
    least = {}
    for i, p in prints:
        if i is not None:
            least[root(p)] = min(i, least.get(root(p), i))
    return [(i, f"{p:016x}", least.get(root(p))) for i, p in prints]


def test_golay_keys_are_shared_within_three_bits():
    from clauseloom.llm import simhash

    remainders, errors, count = simhash.decoding()
    assert sorted(set(count.tolist())) == [1, 6]  # a perfect code: every word has a codeword within three bits
    rng = np.random.default_rng(5)
    flips = [sum(1 << b for b in c) for k in (1, 2, 3) for c in combinations(range(64), k)]
    for one in [0, 2**64 - 1, *rng.integers(0, 2**64, 6, dtype=np.uint64).tolist()]:
        others = np.array([one ^ f for f in flips], np.uint64).view(np.int64)
        own, valid = simhash.key_matrix(np.array([one], np.uint64).view(np.int64))
        matrix, also = simhash.key_matrix(others)
        assert (np.isin(matrix, own[valid]) & also).any(axis=1).all()
    assert not np.isin(*(m[v] for m, v in (simhash.key_matrix(rng.integers(0, 2**62, 50)) for _ in "ab"))).any()


def test_op11_matches_brute_force(spark, entry, docs):
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in entry.queries()["op11_simhash"](spark, SF_DIR).collect()]
    assert sorted(got) == sorted(plain_components([(i, plain_print(t)) for i, t in docs]))


def test_op11_dense_groups_chains_and_odd_rows(spark):
    from clauseloom.llm import simhash

    rng = np.random.default_rng(3)
    center = int(rng.integers(0, 2**63))
    dense = {center ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 5)), replace=False)) for _ in range(400)}
    chain, at = [], int(rng.integers(0, 2**63))
    for k in range(20):
        chain.append(at)
        at ^= 7 << 3 * k
    prints = [*dense, *chain, *rng.integers(0, 2**63, 100).tolist()]
    frame = spark.createDataFrame([(int(np.array([p], np.uint64).view(np.int64)[0]),) for p in prints], "print long")
    found = {r.node & 2**64 - 1: r.component for r in simhash.linked_components(frame.distinct()).collect()}
    want = {int(p, 16): c for _, p, c in plain_components(list(enumerate(prints)))}
    parts = lambda m: {frozenset(p for p in m if m[p] == c) for c in set(m.values())}
    assert {x for x in parts(found)} == {x for x in parts(want) if len(x) > 1}

    long = " ".join(f"w{i % 89} v{i % 53}" for i in range(9000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (4, "one"), (5, "ONE"), (None, "one"), (None, "none other here at all"), (6, long), (7, long + " end"),
            (8, "first text of an id, quite long"), (8, "second text of it, nothing alike"), (9, "second text of it, nothing alike")]
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.grouped(odd_rows(spark, rows)).collect()), key=str)
    assert got == sorted(plain_components([(i, plain_print(t)) for i, t in rows]), key=str)
    assert {i: c for i, _, c in got if i}[9] == 8 and {i: c for i, _, c in got if i}[3] == 1
    assert simhash.grouped(odd_rows(spark, rows).limit(0)).count() == 0
    kept = simhash.deduplicated(odd_rows(spark, rows))
    assert {r.doc_id for r in kept.collect()} == {None, 1, 4, 6, 8} and "lang" in kept.columns


def plain_words(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def plain_variants(words):
    """(word, form, root, n, n_near, form_n); words that share a string with one letter left out are compared."""
    by = {}
    for w in words:
        for s in {w, *(w[:i] + w[i + 1:] for i in range(len(w)))}:
            by.setdefault(s, []).append(w)

    def one_edit(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    near = {w: set() for w in words}
    for group in by.values():
        for a, b in combinations(group, 2):
            if b not in near[a] and one_edit(a, b):
                near[a].add(b)
                near[b].add(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 10 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words.get(form[w])))
    return sorted(out)


def variant_rows(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def test_op12_matches_brute_force(spark, entry, docs):
    got = variant_rows(entry.queries()["op12_spelling_variants"](spark, SF_DIR))
    assert got == plain_variants(plain_words(docs)) and any(r[1] for r in got)


def test_op12_blocks_in_chunks_and_odd_rows(spark):
    from clauseloom.llm import spelling

    rng = np.random.default_rng(1)
    words = {}
    for k in range(600):  # one hot beginning, one hot end, long words, letters beyond ASCII
        stem = "".join(rng.choice(list("abé"), int(rng.integers(3, 7))))
        for w in ("constitution" + stem, stem + "isationally", stem * 3):
            if len(w) >= 7:
                words[w] = int(10 ** rng.uniform(0.5, 5))
    words |= {"x" * 9000: 2, "x" * 8999: 50, "x" * 8998 + "y": 700, "abcdefg": 3, "abcdefgh": 30, "abcdefghi": 300, "zabcdefghi": 3000}
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    want = plain_variants({w: n for w, n in words.items() if len(w) < 1000})
    for letters in (spelling.BLOCK_LETTERS, 1000):
        got = variant_rows(spelling.grouped(table, letters))
        assert [r for r in got if len(r[0]) < 1000] == want
        assert {(r[3], r[4], r[5]) for r in got if len(r[0]) > 1000} == {(2, 1, 50), (50, 2, 700), (700, 1, None)}
    rows = [(1, None), (2, ""), (3, "É" * 5), (None, "Straßenbahn Straßenbahn"), (4, "Größere größere GRÖßere"), (4, "Größere größere GRÖßere"), (5, "résumées " * 40 + "resumées resumées")]
    assert variant_rows(spelling.variants(odd_rows(spark, rows))) == plain_variants(plain_words(rows))
    assert spelling.variants(odd_rows(spark, rows).limit(0)).count() == 0


def plain_alignment(rows):
    """The contract's row per text, with both libraries on whole texts and byte ranges compared one by one."""
    import json

    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(P.path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    a.encode_special_tokens = True
    names = {v: k for k, v in json.load(open(P.path("byte_bpe_50k.json")))["model"]["vocab"].items()}
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(x): x for x in shown} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in shown)}

    def spans(parts):
        at, out = 0, []
        for p in parts:
            out.append((at, at + len(p)))
            at += len(p)
        return out

    found = []
    for i, text in rows:
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        parts_a = [bytes(byte_of[c] for c in names[x]) for x in ids_a]
        parts_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in map(b.id_to_piece, ids_b)]
        if not text or b"".join(parts_a) != (" " + text).encode() or b"".join(parts_b) != (" " + text).encode():
            found.append((i, [], [], [], []))
            continue
        sa, sb = spans(parts_a), spans(parts_b)
        cuts = [0, *sorted({e for _, e in sa} & {e for _, e in sb})]
        group_of = {x: [bisect_left(cuts, e) for _, e in spans_] for x, spans_ in (("a", sa), ("b", sb))}  # the first common end at or after a token's
        groups = [([], []) for _ in cuts[1:]]
        for side, ids in enumerate((ids_a, ids_b)):
            for x, g in zip(ids, group_of["ab"[side]]):
                groups[g - 1][side].append(x)
        links, first = [], 0
        for x, (s, e) in zip(ids_a, sa):
            while sb[first][1] <= s:
                first += 1
            k = first
            while k < len(sb) and sb[k][0] < e:
                links.append((x, ids_b[k]))
                k += 1
        found.append((i, ids_a, ids_b, groups, links))
    counts = Counter(l for f in found for l in f[4])
    best = {}
    for (x, y), n in counts.items():
        best[y] = max(n, best.get(y, 0))
    return sorted(((i, len(x), len(y), len(g), len(l), sum(counts[p] == best[p[1]] for p in l), sum(counts[p] for p in l),
                    sha256(";".join(f"{','.join(map(str, p))}|{','.join(map(str, q))}" for p, q in g).encode()).hexdigest() if x else "")
                   for i, x, y, g, l in found), key=str)


def test_op13_matches_brute_force(spark, entry, docs):
    got = entry.queries()["op13_token_alignment"](spark, SF_DIR)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == plain_alignment(docs)


def test_op13_joined_pairs_odd_texts_and_groups(spark):
    import public_tokenizers as P

    from clauseloom.llm import tokenalign

    paths = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
    rng = np.random.default_rng(2)
    letters = list("ab' \t\n.,éß中文😀 　​ \x1c\x85\x00'st01<>|") + ["  ", " the", "<|endoftext|>", "<s>", "</s>", "<0x41>", "\r\n", "᠎", "﻿"]
    rows = [(k, "".join(rng.choice(letters, int(rng.integers(1, 30))))) for k in range(600)]
    rows += [(None, "no id"), (7, "again"), (7, "again"), (1000, None), (1001, ""), (1002, " "), (1003, "a▁b"), (1004, "x" * 5000), (1005, "中" * 2000 + " end  ")]
    want = plain_alignment(rows)
    for frequent in (tokenalign.FREQUENT, 40):
        got = tokenalign.with_alignment(odd_rows(spark, rows), *paths, frequent)
        assert sorted(map(tuple, got.collect()), key=str) == want
    assert tokenalign.with_alignment(odd_rows(spark, rows).limit(0), *paths).count() == 0
    shown = odd_rows(spark, rows).select("doc_id", tokenalign.groups(F.col("text"), *paths).alias("g")).collect()
    digest = {sha256(";".join(f"{','.join(map(str, x.a))}|{','.join(map(str, x.b))}" for x in r.g).encode()).hexdigest() if r.g else "" for r in shown}
    assert digest == {r[-1] for r in want}
