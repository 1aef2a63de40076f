"""Substring dedup and the Jaccard join against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np

from turnstile.llm import parity, substrings
from turnstile.llm.fmindex import FMIndex, earlier_windows

SCHEMA = "doc_id long, text string, doc string, id string, node int, start int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", 1, 2) for i, t in rows], SCHEMA)


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_index_counts_patterns():
    rng = np.random.default_rng(2)
    for sigma in (1, 2, 5, 40):
        parts = [rng.integers(1, sigma + 1, rng.integers(1, 30)) for _ in range(12)]
        text = np.concatenate([np.append(p, 0) for p in parts])
        index = FMIndex(text, sigma)
        for _ in range(60):
            pattern = rng.integers(1, sigma + 1, rng.integers(1, 6))
            low, high = np.array([0]), np.array([index.n])
            for symbol in pattern[::-1]:
                low, high = index.extend(np.array([symbol]), low, high)
            places = [i for i in range(len(text)) if np.array_equal(text[i : i + len(pattern)], pattern)]
            assert sorted(index.places[low[0] : max(low[0], high[0])].tolist()) == places


def test_earlier_windows_of_random_sequences():
    rng = np.random.default_rng(0)
    for _ in range(80):
        base = rng.integers(1, rng.integers(2, 6), 300).astype(np.uint64)
        size = int(rng.integers(2, 7))
        begins = rng.integers(0, 280, rng.integers(1, 25))
        parts = [base[a : a + int(rng.integers(size, size + 12))] for a in begins]
        parts = [p for p in parts if len(p) >= size]
        if not parts:
            continue
        orders = rng.permutation(len(parts)) * 100
        first = {}
        for p, o in zip(parts, orders, strict=True):
            for j in range(len(p) - size + 1):
                k = p[j : j + size].tobytes()
                first[k] = min(first.get(k, 1 << 60), o + j)
        for p, o, got in zip(parts, orders, earlier_windows(parts, orders, size), strict=True):
            assert got.tolist() == [first[p[j : j + size].tobytes()] < o + j for j in range(len(p) - size + 1)]


def brute_removed(rows, window):
    """Rows with one id and text are one document; order: null ids, id, then sha256 of the text."""
    import hashlib

    texts = sorted({(i, t or "") for i, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(r[1].encode()).hexdigest()))
    seen, out = set(), {}
    for i, text in texts:
        words = split(text)
        gone = set()
        for j in range(len(words) - window + 1):
            k = tuple(words[j : j + window])
            if k in seen:
                gone.update(range(j, j + window))
            seen.add(k)
        out[i, text] = (len(words), len(gone), " ".join(w for p, w in enumerate(words) if p not in gone))
    return sorted((str(i), *out[i, t or ""]) for i, t in rows)


def test_repeats_are_removed(spark, monkeypatch):
    rng = random.Random(8)
    word = lambda: rng.choice("abcdefghijklmnop") + rng.choice("xyz")
    passages = [[word() for _ in range(rng.randrange(8, 70))] for _ in range(12)]
    rows = []
    for i in range(120):
        parts = [word() for _ in range(rng.randrange(0, 30))]
        for _ in range(rng.randrange(0, 4)):
            p = rng.choice(passages)
            a = rng.randrange(0, len(p) - 7)
            parts += p[a : a + rng.randrange(7, 70)] + [word() for _ in range(rng.randrange(0, 9))]
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(parts)))
    rows += [(500, rows[3][1]), (501, None), (502, ""), (503, "same " * 3000), (504, "é " * 40)]
    for crowd, heavy, shard in ((4096, 0.002, 250_000), (1, 0.9, 300), (2, 0.002, 1000)):
        monkeypatch.setattr(substrings, "CROWD", crowd)
        monkeypatch.setattr(substrings, "HEAVY", heavy)
        monkeypatch.setattr(substrings, "SHARD_WORDS", shard)
        found = substrings.remove_repeats(frame(spark, rows).repartition(5), window=8, run=4)
        assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in found.collect()) == brute_removed(rows, 8)


def test_repeated_and_null_ids_are_documents_too(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(7, text), (7, text), (7, text + " more"), (None, text + " null"), (9, text), (9, "short")]
    found = substrings.remove_repeats(frame(spark, rows))
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in found.collect()) == brute_removed(rows, 20)
    assert substrings.remove_repeats(frame(spark, [])).count() == 0
    carried = substrings.remove_repeats(frame(spark, [(1, "a  b"), (2, None)]), carry=("doc", "start"), joined=False)
    assert sorted((r.doc_id, r.kept, r.doc, r.start) for r in carried.collect()) == [(1, "a  b", "x", 2), (2, "", "x", 2)]


def shingles(text):
    words = split("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[j : j + 5]) for j in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            holders[g].append(i)
    for i, s in enumerate(sets):
        for j, n in Counter(j for g in s for j in holders[g] if j < i).items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                up[find(i)] = find(j)
    least = {}
    for x, (i, _) in enumerate(rows):
        known = [v for v in (least.get(find(x)), i) if v is not None]
        least[find(x)] = min(known) if known else None
    return sorted((str(i), len(sets[x]), str(least[find(x)])) for x, (i, _) in enumerate(rows))


def near_rows(n, size, edits, seed):
    rng = random.Random(seed)
    word = lambda: f"{rng.choice('abcdefgh')}{rng.randrange(400)}"
    bases = [[word() for _ in range(rng.choice(size))] for _ in range(n // 6)]
    rows = []
    for i in range(n):
        words = list(rng.choice(bases))
        for _ in range(rng.randrange(0, edits)):
            if words:
                words[rng.randrange(len(words))] = word()
        rows.append((i * 3, " ".join(words).title() if i % 5 == 0 else " ".join(words)))
    return rows


def test_components_match_all_pairs(spark):
    rows = near_rows(160, [3, 5, 8, 14, 30, 60, 200], 5, 1)
    rows += [(None, rows[2][1]), (None, "lonely words in here now"), (6, rows[9][1]), (6, rows[9][1]), (900, None), (901, "\t"), (902, "b " * 3000), (903, "b " * 4000)]
    found = parity.near_components(frame(spark, rows))
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in found.collect()) == brute_components(rows)


def test_components_of_one_large_cluster_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(parity, "BLOCK", 16)
    rows = near_rows(150, [120], 14, 4)
    found = parity.near_components(frame(spark, rows))
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in found.collect()) == brute_components(rows)


def test_short_sketches_fall_back_to_single_shingles(spark):
    few = parity.Likeness(segments=1)  # too few segments for the guarantee
    rows = near_rows(60, [60, 90], 4, 6)
    sets = [np.sort(np.random.default_rng(i).integers(0, 1 << 63, 60).astype(np.uint64)) for i in range(9)]
    assert any(parity.SHORT in parity.segment_keys(s, np.empty(0, np.uint64), few, False) for s in sets)
    found = parity.near_components(frame(spark, rows), likeness=few)
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in found.collect()) == brute_components(rows)
    assert parity.near_components(frame(spark, [])).count() == 0


def test_sets_that_link_share_a_key():
    rng = np.random.default_rng(5)
    likeness = parity.Likeness()
    for _ in range(400):
        n = int(rng.integers(1, 300))
        base = np.sort(np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2)))
        other = base[rng.random(len(base)) > rng.choice([0.0, 0.05, 0.1])]
        extra = rng.integers(0, 1 << 63, int(rng.integers(0, max(1, n // 6)))).astype(np.uint64)
        other = np.unique(np.concatenate([other, extra]))
        common = len(np.intersect1d(base, other))
        if len(other) and likeness.links(common, len(base), len(other)):
            heavy = np.sort(rng.choice(base, len(base) // 2, replace=False))
            keys = [set(parity.segment_keys(s, heavy, likeness, False).tolist()) for s in (base, other)]
            assert keys[0] & keys[1]


def shuffled(spark):
    """Bytes that the stages of the session have written for shuffles so far."""
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty(30_000)
    stages = context.statusStore().stageList(None, False, False, spark._sc._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_sets_of_one_large_cluster_travel_a_few_times(spark, monkeypatch):
    monkeypatch.setattr(parity, "BLOCK", 16)
    rows = near_rows(150, [1200], 40, 4)
    rows = [(i, " ".join(rows[0][1].split()[:1100] + t.split()[1100:])) for i, t in rows]  # 150 sets near each other
    before = shuffled(spark)
    found = parity.near_components(frame(spark, rows)).collect()
    sent = shuffled(spark) - before
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in found) == brute_components(rows)
    assert sent < 4 * sum(len(t) for _, t in rows)
