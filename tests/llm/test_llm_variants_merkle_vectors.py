"""Spelling variants, the Merkle manifest and vector links against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

from turnstile.llm import merkle, rotations, spelling

DOCS = "doc_id long, text string, source string, lang string, n_chars long, word string, idx long, tree string, node long"


def documents(spark, rows):
    """Rows (doc_id, text, source, lang, n_chars) beside columns with names that the operators use themselves."""
    return spark.createDataFrame([(*r, "x", 7, "y", 9) for r in rows], DOCS)


def brute_words(rows, least=6, occurrences=5):
    counts = Counter()
    for i, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= least and n >= occurrences}


def one_edit(a, b):
    if len(a) < len(b):
        a, b = b, a
    if a == b or len(a) - len(b) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute_variants(rows):
    words = brute_words(rows)
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w], root(w), n, len(near[w]), words[form[w]] if form[w] else None) for w, n in words.items())


def test_variants_match_brute_force(spark):
    rng = random.Random(4)
    letters = "abcdeé÷Ü"
    bases = ["".join(rng.choice(letters) for _ in range(rng.choice([6, 6, 7, 9, 12]))) for _ in range(40)]
    bases += ["unter" + "".join(rng.choice("abc") for _ in range(4)) for _ in range(60)]

    def edited(w):
        at = rng.randrange(len(w))
        return rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice(letters) + w[at + 1 :], w[:at] + rng.choice(letters) + w[at:]])

    pool = []
    for base in bases:
        pool += [base] * rng.choice([5, 30, 200])
        for _ in range(3):
            w = edited(base)
            pool += [w] * rng.choice([4, 5, 6, 30])
            pool += [edited(w)] * 5
    rng.shuffle(pool)
    rows = []
    for i in range(0, len(pool), 300):
        text = " ".join(w.upper() if rng.random() < 0.2 else w for w in pool[i : i + 300])
        rows.append((None if i == 0 else rng.randrange(30), text, "s", "en", 1))
    rows += [rows[1]] * 2 + [(5, None, None, None, None), (6, "", "", "", 0), (None, "1 2", "s", None, 2)]
    rows += [(8, "q" * 5000 + " " + "é" * 300 + "\n" + "zz", "s", "en", 3)] * 5
    got = spelling.spelling_variants(documents(spark, rows), ratio=5)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.collect())) == brute_variants(rows)
    assert spelling.spelling_variants(documents(spark, [])).count() == 0


def test_pairs_are_found_once(spark, monkeypatch):
    found, near_words = spark.sparkContext.accumulator(0), spelling.near_words

    def counted(words):
        def count(batches):
            for batch in batches:
                found.add(batch.num_rows)
                yield batch

        pairs = near_words(words)
        return pairs.mapInArrow(count, pairs.schema)

    monkeypatch.setattr(spelling, "near_words", counted)
    rows = [(i, "orange oranges orangen lemons lemon melons", "s", "en", 1) for i in range(30)]
    got = spelling.spelling_variants(documents(spark, rows)).collect()
    assert sorted(map(tuple, got)) == brute_variants(rows)
    assert 2 * found.value == sum(r.n_near for r in got) > 0


def test_crowded_grams_find_the_same_pairs(spark):
    rng = random.Random(9)
    words = sorted({"stem" * rng.choice([1, 2]) + "".join(rng.choice("abcd") for _ in range(rng.choice([2, 3, 4]))) for _ in range(300)})
    frame = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, n long")
    want = sorted(tuple(sorted((a, b))) for i, a in enumerate(words) for b in words[:i] if one_edit(a, b))
    for crowd in (0, 3, 40, 10_000):
        pairs = spelling.near_words(frame, crowd)
        assert sorted(tuple(sorted((r.a, r.b))) for r in pairs.collect()) == want, crowd


def test_roots_follow_long_ways(spark):
    n = 37
    forms = spark.createDataFrame([(f"w{i:02}", f"w{i + 1:02}") for i in range(n)], "word string, form string")
    assert {r.root for r in spelling.roots(forms).collect()} == {f"w{n:02}"}


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, cut=False):
    i, text, source, lang, n = row
    text = text.replace("\n", "") if cut and text is not None else text
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))


def climb(nodes):
    """The root, and for each leaf its siblings (before, after) level by level."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, place in enumerate(at):
            g = place // 3 * 3
            ways[k].append(("".join(nodes[g:place]), "".join(nodes[place + 1 : g + 3])))
        nodes = [h(*nodes[g : g + 3]) for g in range(0, len(nodes), 3)]
        at = [place // 3 for place in at]
    return nodes[0], ways


def brute_manifest(rows):
    trees = defaultdict(list)
    for row in rows:
        trees[row[2]].append(row)
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    lows = []
    for name in names:
        ordered = sorted(trees[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        lows.append((ordered, *climb([leaf_of(r) for r in ordered])))
    root, tops = climb([sub for _, sub, _ in lows])
    out = []
    for (ordered, sub, ways), top in zip(lows, tops, strict=True):
        for row, way in zip(ordered, ways, strict=True):
            way = way + top
            cut = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0
            acc = leaf_of(row, cut)
            for before, after in way:
                acc = h(before, acc, after)
            out.append((row[0], leaf_of(row), sub, root, h(*(b + a for b, a in way)), acc, acc == root))
    return sorted(out, key=str)


def test_manifest_matches_brute_force(spark):
    rng = random.Random(6)
    many = []
    for i in range(90):
        source = rng.choice(["a", "a", "a", "b", "é", "", None])
        text = rng.choice([None, "", "one\ntwo", "\n\n", "süß\n" * 50, "plain"])
        many.append((rng.choice([None, rng.randrange(40)]), text, source, rng.choice(["en", None]), rng.choice([None, i])))
    many += [many[0]] * 5 + [many[-1]] * 2
    for rows in (many, [(1, "x\ny", "s", "en", 3)], [(i, "t", "only", None, i) for i in range(10)], [(i, "a\n", f"s{i}", "en", 2) for i in range(11)]):
        got = merkle.manifest(documents(spark, rows))
        assert sorted(map(tuple, got.collect()), key=str) == brute_manifest(rows)
    assert merkle.manifest(documents(spark, [])).count() == 0


def test_hot_tree_is_numbered_over_partitions(spark):
    rows = spark.range(5000).selectExpr("if(id % 3 = 0, 'hot', concat('t', id % 400)) as tree", "5000 - id as place", "'x' as idx_name")
    got = merkle.numbered(rows, "tree", ["place"]).collect()
    by = defaultdict(list)
    for r in got:
        by[r.tree].append((r.place, r.idx, r.n))
    assert sum(map(len, by.values())) == 5000
    for found in by.values():
        assert [i for _, i, _ in sorted(found)] == list(range(len(found)))
        assert {n for *_, n in found} == {len(found)}


def brute_links(rows, least=0.98):
    def sound(v):
        return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    n = len(rows)
    units = [np.array(v, float) / np.abs(v).max() if sound(v) else None for _, v, _ in rows]
    units = [None if u is None else u / np.sqrt(u @ u) for u in units]
    near = [[] for _ in rows]
    for i in range(n):
        for j in range(i):
            u, v = units[i], units[j]
            if u is not None and v is not None and rows[i][2] is not None and rows[i][2] == rows[j][2] and len(u) == len(v) and u @ v >= least:
                near[i].append(j)
                near[j].append(i)
    out = []
    for i in range(n):
        seen, stack = {i}, [i]
        while stack:
            for j in near[stack.pop()]:
                if j not in seen:
                    seen.add(j)
                    stack.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        least_id = min(ids) if ids else None
        out.append((rows[i][0], len(near[i]), least_id, rows[i][0] == least_id))
    return sorted(out, key=str)


def test_vector_links_match_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = []
    for size, label in ((24, 1), (24, 2), (64, 1), (3, 4)):
        centres = rng.standard_normal((6, size))
        for _ in range(70):
            v = centres[rng.integers(6)] + rng.choice([0.0, 0.05, 0.12, 0.16, 1.0]) * rng.standard_normal(size)
            rows.append([*v.astype(np.float32).tolist()])
            rows[-1] = (int(rng.integers(10_000)), rows[-1], int(label))
    rows += [rows[0]] * 4 + [(None, rows[0][1], 1), (77, [2.0 * x for x in rows[0][1]], 1), (78, rows[0][1], None)]
    rows += [(80, None, 1), (81, [0.0] * 24, 1), (82, [], 1), (83, [1.0, None], 1), (84, [math.nan] * 24, 1), (85, [math.inf] * 24, 1)]
    rows += [(90, [1e30] * 24, 1), (91, [1e-30] * 24, 1), (None, [0.0, 0.0], None)]
    schema = "vec_id long, embedding array<float>, label int, node long, size int, copies string"
    frame = spark.createDataFrame([(*r, 1, 2, "c") for r in rows], schema)
    for settings in (rotations.Settings(), rotations.Settings(block=8)):
        got = rotations.near_vectors(frame, settings)
        assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
        assert sorted(map(tuple, got.collect()), key=str) == brute_links(rows)
    assert rotations.near_vectors(frame.limit(0)).count() == 0


def test_estimates_are_unbiased_and_inside_their_bounds():
    rng = np.random.default_rng(8)
    shape = rotations.shape_for(100_000, rotations.Settings())
    x = rotations.unit(rng.standard_normal((400, 64)))
    y = rotations.unit(x + rng.uniform(0.1, 3, (400, 1)) * rotations.unit(rng.standard_normal((400, 64))))
    true = np.einsum("ij,ij->i", x, y)
    xe, xo, xs = rotations.halves(*rotations.encode(x, shape), 64, shape.settings.seed)
    ye, yo, ys = rotations.halves(*rotations.encode(y, shape), 64, shape.settings.seed)
    off = (np.einsum("ij,ij->i", xe, yo) + np.einsum("ij,ij->i", xo, ye)) / 2 - true
    assert abs(off.mean()) < 0.01
    assert (np.abs(off) <= 3 * np.sqrt(xs + ys + xs * ys * 63)).all()
