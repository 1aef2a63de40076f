"""Token files, pieces, licence scans and the classifier, and the pipeline as a whole."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_llm_near import brute_components, brute_removed, near_rows
from test_llm_urls_mixing import brute_mix

import corpus_pipeline
from turnstile.llm import licenses, pfor, pieces, quality
from turnstile.llm.encoding import ByteEncoder
from turnstile.llm.words import split_words, text_bytes

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, ids string, score string, block int, place int, label string, n_words string"
PARTS = [" ", "  ", "\n", "\n\n", "\t", "a", "é", "\xa0", "　", "'s", "12", "!", "<|endoftext|>", "中", "\x85", "The", "\x1c", "\x7f", "😀", "\r", "ing", "▁"]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "a", "b", 1, 2, "c", "d") for i, t in rows], SCHEMA)


def noise(n, seed, most=14):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, most))) for _ in range(n)]


def split_ids(ids, sizes):
    return [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]


def test_words_are_split_within_texts():
    texts = ["a b  a", "", None, " foo\n", "é a\x0bb", "\x1f x"]
    buffer, bounds = text_bytes(pa.array(texts))
    starts, ends, word_bounds = split_words(buffer, bounds)
    words = [bytes(buffer[a:b]).decode() for a, b in zip(starts, ends, strict=True)]
    found = [words[a:b] for a, b in zip(word_bounds[:-1], word_bounds[1:], strict=True)]
    assert found == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]


def test_chunks_give_the_ids_of_whole_texts():
    texts = noise(20_000, 1)
    ids, sizes = ByteEncoder(BYTES).encode(*text_bytes(pa.array(texts)), end=0)
    whole = tokenizers.Tokenizer.from_file(BYTES).encode_batch(texts, add_special_tokens=False)
    assert split_ids(ids, sizes) == [e.ids + [0] for e in whole]


@pytest.mark.parametrize("seed", range(5))
def test_frames_round_trip(seed):
    rng = np.random.default_rng(seed)
    for ids in (
        rng.integers(0, 50_000, 4096),
        np.zeros(5),
        np.array([2**32 - 1, 0, 5]),
        np.concatenate([np.arange(3000), np.full(40, 2**31)]),
        rng.zipf(1.3, 1000) % 2**32,
    ):
        ids = ids.astype(np.uint32)
        assert np.array_equal(pfor.decode_block(pfor.encode_block(ids)), ids)
        width = int(ids.max()).bit_length()
        assert np.array_equal(pfor.unpack(pfor.pack(ids, width), len(ids), width), ids)


def test_files_of_ids(spark):
    rows = list(zip(range(300), noise(300, 2, 60), strict=True)) + [(None, "no id"), (5, "again"), (5, "again"), (700, None), (701, "word " * 60_000)]
    random.Random(1).shuffle(rows)
    found = pfor.encoded(frame(spark, rows).repartition(7), BYTES).collect()
    whole = tokenizers.Tokenizer.from_file(BYTES)
    start, expected = 0, []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode())):
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 0]
        expected.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, found), key=lambda r: r[1]) == expected
    assert pfor.encoded(frame(spark, []), BYTES).count() == 0


def test_any_range_of_ids_can_be_read(spark, tmp_path):
    texts = noise(200, 3, 400)
    manifest = pfor.write_ids(frame(spark, enumerate(texts)), str(tmp_path / "ids"), BYTES)
    ids, _ = ByteEncoder(BYTES).encode(*text_bytes(pa.array(texts)), end=0)
    at = 0
    for file in manifest.orderBy("block").collect():
        with open(file.file, "rb") as opened:
            reader = pfor.Reader(opened)
            for a, b in ((0, 5), (reader.n_ids // 3, reader.n_ids // 2), (0, reader.n_ids), (7, 7)):
                assert np.array_equal(reader.ids(a, b), ids[at + a : at + b])
        at += file.n_ids
    assert at == len(ids)
    read = pfor.read_documents(spark, str(tmp_path / "ids")).orderBy("id").collect()
    assert [x for r in read for x in r.ids] == ids.tolist()


@pytest.fixture
def unigram(tmp_path):
    """The same pieces for the library's own Viterbi; scores of minus a billion, which its floats cannot add to, become -40,000."""
    proto = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    model = proto.ModelProto()
    with open(PIECES, "rb") as file:
        model.ParseFromString(file.read())
    model.trainer_spec.model_type = 1
    for piece in model.pieces:
        piece.score = max(piece.score, -40_000.0)
    path = tmp_path / "unigram.model"
    path.write_bytes(model.SerializeToString())
    return str(path)


def test_viterbi_gives_the_library_s_best_path(unigram):
    sentencepiece = pytest.importorskip("sentencepiece")
    model, library = pieces.PieceModel(unigram), sentencepiece.SentencePieceProcessor(model_file=unigram)
    rng = random.Random(2)
    letters = [*"abcdefgh é中\n😀", "  ", "the ", "ing", "tion", " wor"]
    texts = ["", *("".join(rng.choice(letters) for _ in range(rng.randint(1, 25))) for _ in range(6000))]
    found = split_ids(*model.encode_texts(*text_bytes(pa.array(texts))))
    assert found == [library.encode(t) for t in texts]


def test_words_alone_take_the_path_of_words_together(monkeypatch):
    """Few or long words, in blocks of few ends; scripts without spaces."""
    model = pieces.PieceModel(PIECES)
    rng = random.Random(5)
    letters = [*"abcdefgh é中文字を\U0001F600\u2581\n", "the", "ing", "tion", "    ", "<0x41>"]
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 300))) for _ in range(60)]
    codes = [np.frombuffer(w.encode("utf-32-le"), np.uint32)[None, :] for w in words]
    monkeypatch.setattr(pieces, "FEW", 0)
    together = [model.viterbi(c) for c in codes]
    monkeypatch.setattr(pieces, "FEW", 64)
    for ends in (7, 1 << 15):
        monkeypatch.setattr(pieces, "ENDS", ends)
        for (a, b), c in zip(together, codes, strict=True):
            x, y = model.viterbi(c)
            assert np.array_equal(a, x) and np.array_equal(b, y)
    out = 0
    terms = pieces.mix(codes[0][0].astype(np.uint64) + np.uint64(1))
    for j, term in enumerate(terms.tolist()):
        out = (out * int(pieces._BASE) + term) % 2**64
        assert model._prefixes(codes[0])[0, j + 1] == out
    han = "".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(50_000))
    ids, sizes = model.encode_texts(*text_bytes(pa.array([han, "a " + han[:70]])))
    assert [model.decode_ids(x) for x in split_ids(ids, sizes)] == [han, "a " + han[:70]]


def test_pieces_decode_to_the_text(spark):
    rows = list(enumerate(noise(400, 4, 40))) + [(None, "no id"), (7, None), (8, ""), (9, "x" * 40_000), (9, " lead"), (9, " lead")]
    encoded = pieces.encode_pieces(frame(spark, rows), PIECES)
    assert [c for c in encoded.columns if c not in ("ids",)] == [c for c in SCHEMA.replace(",", "").split()[::2] if c != "ids"]
    found = pieces.decode_pieces(encoded, PIECES).select("doc_id", "decoded").collect()
    key = lambda r: (str(r[0]), r[1])
    assert sorted(map(tuple, found), key=key) == sorted(((i, t or "") for i, t in rows), key=key)
    assert pieces.decode_pieces(pieces.encode_pieces(frame(spark, []), PIECES), PIECES).count() == 0
    nothing = spark.createDataFrame([(None,)], "ids array<int>")
    assert pieces.decode_pieces(nothing, PIECES).first().decoded == ""


LICENSED = [
    "", None, "  ", "CC BY cc by CC-BY 4.0 é", "x. All Rights  Reserved", "Licensed under the GNU General Public License version 3.0 or GPL",
    "a\xa0b", "the cc by, by cc. by", "Apache License 2.0", "Permission is hereby granted, free of charge, to any person obtaining a copy...",
    "nothing here", "cc by " * 9000, "GNU LESSER GENERAL PUBLIC LICENCE v2.1",
]


def test_license_scan(spark):
    rows = [*enumerate(LICENSED), (3, LICENSED[3]), (None, "general public license")]
    df = frame(spark, rows)
    found = licenses.scan_licenses(df).collect()
    assert len(found) == len(rows) and licenses.scan_licenses(df.limit(0)).count() == 0
    for r in found:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r.text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
        base = sorted((i, name) for phrase, name in licenses.PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())
        assert (r.n_words, r.n_base) == (len(words), len(base))
        assert (r.first_word, r.last_word) == ((base[0][0], base[-1][0]) if base else (None, None))
        assert r.base_labels == ",".join(sorted({name for _, name in base}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    labels = {r.doc_id: r.labels for r in found}
    assert (labels[5], labels[8], labels[9], labels[10], labels[12]) == ("gpl,gpl-3.0", "apache-2.0", "mit", "", "lgpl-2.1")


def test_suppression_matches_pairwise_containment():
    rng = random.Random(9)
    for _ in range(300):
        found = [(-rng.randrange(1, 4), i, a := rng.randrange(20), a + rng.randrange(6), str(i), 0.5) for i in range(rng.randrange(12))]
        kept = []
        for d in sorted(found, key=lambda d: (d[0], d[2] - d[3], d[1], d[2])):
            if not any(k[2] <= d[2] and d[3] <= k[3] for k in kept):
                kept.append(d)
        assert licenses.suppress(found) == sorted((d[2], d[3], d[4], d[5]) for d in kept)


def example(tree, rng):
    """A text that a parsed pattern matches."""
    out = ""
    for kind, value in tree:
        kind = str(kind)
        if kind == "LITERAL":
            out += chr(value)
        elif kind == "IN":
            first, arg = rng.choice(value)
            out += rng.choice("0123456789") if str(first) == "CATEGORY" else chr(arg if str(first) == "LITERAL" else arg[0])
        elif kind == "BRANCH":
            out += example(rng.choice(value[1]), rng)
        elif kind == "SUBPATTERN":
            out += example(value[-1], rng)
        else:
            low, high, inner = value
            out += "".join(example(inner, rng) for _ in range(rng.randint(low, min(high, 3))))
    return out


def test_each_rule_passes_its_own_gate():
    scanner, rng = licenses.Scanner(), random.Random(2)
    for i, rule in enumerate(licenses.RULES):
        tree = re._parser.parse(rule.pattern)
        for _ in range(12):
            text = f" x {re.sub(' +', ' ', example(tree, rng))} y "
            if scanner.rules[i][1].search(text):
                hits = {j for _, owners in scanner.automaton.iter(text) for j in owners}
                assert i in hits, (rule, text)
            else:
                assert "[a-z ]" in rule.pattern, (rule, text)
    labels = lambda text: {d[2] for d in scanner.scan(f" {text} ")[1]}
    assert labels("released under the unlicense") == labels("the unlicense") == {"unlicense"}
    assert (labels("gplv3"), labels("gplv2 or later"), labels("lgplv2 1"), labels("gpl3")) == ({"gpl-3"}, {"gpl-2"}, {"lgpl-2.1"}, {"gpl-3"})
    assert labels("gplv33") == labels("xgplv3") == set()


def test_rules_match_in_spite_of_the_keyword_gate():
    scanner = licenses.Scanner()
    assert len(licenses.RULES) > 300
    for name, version in (("mozilla public license", "2 0"), ("eclipse public licence", "1 0"), ("creative commons attribution share alike", "4 0")):
        text = f" x {name} version {version} y "
        gated = {d[2] for d in scanner.scan(text)[1]}
        every = [(-r.priority, i, text.count(" ", 0, m.start()) - 1, text.count(" ", 0, m.end()) - 1, r.label, r.confidence) for i, (r, p) in enumerate(scanner.rules) for m in p.finditer(text)]
        assert gated == {d[2] for d in licenses.suppress(every)} != set()


def labelled_rows(n, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 7)))
    good = lambda: " ".join(word() for _ in range(rng.randrange(60, 90))).capitalize() + "."
    bad = lambda: " ".join(f"{word()}{rng.choice(['###', '$$$', '***'])}" for _ in range(rng.randrange(60, 90)))
    return [(i, bad() if i % 4 == 0 else good(), i % 4 != 0) for i in range(n)]


def test_classifier_learns_from_its_part_only(spark):
    rows = labelled_rows(400, 1)
    docs = frame(spark, [(i, t) for i, t, _ in rows] + [(None, None), (900, ""), (900, ""), (901, "word " * 50_000)])
    labels = spark.createDataFrame([(i, int(q), 0) for i, _, q in rows] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    found = quality.classify(docs, labels).collect()
    assert len(found) == 404
    truth = {i: int(q) for i, _, q in rows}
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode() if r.doc_id is not None else b"") % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [r for r in found if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95
    # labels of the held-out part change nothing
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {(r.doc_id, r.text): r.score for r in quality.classify(docs, flipped).collect()}
    assert all(again[r.doc_id, r.text] == r.score for r in found)


def test_fit_takes_one_row_per_id_and_sound_labels(spark):
    rng = random.Random(12)
    texts = {i: " ".join(rng.choice(["good", "fine", "bad", "junk", "x"]) for _ in range(12)) for i in range(60)}
    least = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string")
    many = least
    for k in range(1, 6):
        many = many.unionByName(least.withColumn("text", F.concat("text", F.lit(" copy" * k))))
    one = many.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("m")).select("doc_id", "m.text")
    labels = [(i, i % 2) for i in texts] + [(1, 2), (200, -1), (4, None), (None, 1)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int")
    settings = quality.Settings(buckets=1 << 10, fit_rows=40)
    a, b = quality.fit(many.unionByName(many), labels, settings), quality.fit(one, labels, settings)
    assert np.array_equal(a.scaled, b.scaled) and (a.bias, a.slope, a.offset) == (b.bias, b.slope, b.offset)
    only = spark.createDataFrame([(1, 2), (2, -1), (3, 7)], "doc_id long, quality int")
    assert {r.score for r in quality.classify(many, only, settings).collect()} == {0.5}


def test_classifier_without_labels_or_documents(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.classify(frame(spark, [(1, "a"), (2, None)]), none).collect()} == {0.5}
    assert quality.classify(frame(spark, []), none).count() == 0


def test_descent_reaches_the_optimum():
    """The dual variables satisfy the conditions of the hinge-loss optimum."""
    rng = np.random.default_rng(3)
    rows = [np.sort(rng.choice(30, 8, replace=False)) for _ in range(40)]
    ratio, scales = np.ones(30), np.full(40, 1 / np.sqrt(8))
    values = [ratio[r] / np.sqrt(8) for r in rows]
    signs = np.where([5 in r for r in rows], 1.0, -1.0)
    weights, bias = quality._descend(rows, ratio, scales, signs, np.full(40, 2.0), 3000, 1)
    margins = signs * np.array([weights[r] @ v + bias for r, v in zip(rows, values, strict=True)])
    objective = lambda w, b: 0.5 * (w @ w + b * b) + 2.0 * sum(max(0, 1 - s * (w[r] @ v + b)) for r, v, s in zip(rows, values, signs, strict=True))
    best = objective(weights, bias)
    assert margins.min() > -5
    for _ in range(200):
        assert objective(weights + rng.normal(0, 0.02, 30), bias + rng.normal(0, 0.02)) >= best - 1e-6


def test_pipeline_matches_brute_force(spark, tmp_path):
    good = {i: t for i, t, q in labelled_rows(120, 5) if q}
    rows = [(i, t, ["en", "de", None][i % 3], f"s{i % 4}" if i % 7 else None, len(t)) for i, t, _ in labelled_rows(120, 5)]
    shared = " ".join(f"shared{i}" for i in range(30))
    rows += [(1000 + k, f"{t} {shared}", "en", "s1", 0) for k, t in enumerate(list(good.values())[:6])]  # repeats and near copies
    rows += [(2000 + i, t, "fr", "s9", 0) for i, t in near_rows(30, [60], 4, 3)]
    rows += [(3000, None, None, None, None), (3001, "", "en", "s1", 0), (3002, "plain words here " * 900, "en", "s2", 0)]
    folder = str(tmp_path / "data")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    marked = [(i, int(q)) for i, _, q in labelled_rows(120, 5)]
    spark.createDataFrame(marked, "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")

    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == list(corpus_pipeline.COLUMNS)
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        kept[name] = {r.doc_id: r for r in docs.collect()}
    judged = quality.classify(spark.createDataFrame(rows, schema), spark.read.parquet(f"{folder}/labels.parquet")).collect()
    assert set(kept["quality"]) == {r.doc_id for r in judged if r.predicted}
    assert set(good) <= set(kept["quality"])
    before = [(i, r.text) for i, r in kept["quality"].items()]
    assert set(kept["near duplicates"]) == {int(c) for _, _, c in brute_components(before)}
    before = [(i, r.text) for i, r in kept["near duplicates"].items()]
    removed = {int(i): (n, text) for i, _, n, text in brute_removed(before, 20)}
    for i, text in before:
        assert kept["substrings"][i].text == (removed[i][1] if removed[i][0] else text or "")
    assert any(n for n, _ in removed.values())
    rest = [(i, r.lang, r.source, r.text) for i, r in kept["substrings"].items()]
    domain = lambda s: "a" if hashlib.md5((s or "").encode()).hexdigest() < "8" else "b"
    leaves = [(i, f"{domain(s)}", f"{a or ''}|{s or ''}", t) for i, a, s, t in rest]
    total = sum(len((t or "").split()) for *_, t in leaves)
    taken = sum(len(r.text.split()) for r in kept["mixing"].values())
    assert taken == int(total * corpus_pipeline.MIX["share"])
    for i, r in kept["mixing"].items():
        text = kept["substrings"][i].text
        assert r.text == text or text.split()[: len(r.text.split())] == r.text.split()
    final = corpus_pipeline.run(spark, folder)
    assert final.columns == ["doc_id", "n_pieces", "ids"]
    back = {r.doc_id: r.decoded for r in pieces.decode_pieces(final, PIECES).collect()}
    assert back == {i: r.text for i, r in kept["mixing"].items()}


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def test_one_row_per_group_of_near_duplicates(spark):
    groups = [" ".join(f"g{g}x{j}" for j in range(40)) for g in range(9)]
    near = lambda g, k: f"{groups[g]} tail{k}"
    rows = [(1, groups[0]), (1, groups[0]), (2, near(0, 1))]  # repeated rows
    rows += [(None, groups[1]), (None, near(1, 1)), (None, near(1, 2)), (None, groups[1])]  # no id at all
    rows += [(7, groups[2]), (None, near(2, 1)), (None, groups[2])]
    rows += [(8, groups[3]), (8, near(3, 1)), (9, groups[3])]  # two texts under the least id
    rows += [(10, groups[4]), (10, groups[5]), (11, near(5, 1))]  # one id in two groups
    rows += [(12, groups[6]), (11, groups[7]), (3, "short"), (None, "short"), (4, "lone"), (None, "alone")]
    rows = [(i, t, "en", "s1", 0) for i, t in rows] + [(1, groups[0], "de", "s1", 0)]
    blank = [(None, None, "en", None, 0), (None, None, "en", None, 0), (20, "", "en", "s1", 0), (20, "", "en", "s1", 0), (1, " \t", "en", "s1", 1)]
    out = corpus_pipeline.near_duplicate_stage(spark, spark.createDataFrame(rows + blank, DOCUMENTS).repartition(3), "")
    assert out.columns == list(corpus_pipeline.COLUMNS)
    found = [tuple(r) for r in out.collect()]
    digest = lambda t: hashlib.md5(t.encode()).hexdigest()
    least = lambda *texts: min(texts, key=digest)
    want = [(1, groups[0]), (None, least(groups[1], near(1, 1), near(1, 2))), (7, groups[2]), (8, least(groups[3], near(3, 1)))]
    want += [(10, groups[4]), (10, groups[5]), (12, groups[6]), (11, groups[7]), (3, "short"), (4, "lone"), (None, "alone")]
    assert Counter(r[:2] for r in found if (r[1] or "").strip()) == Counter(want)
    assert Counter(r for r in found if not (r[1] or "").strip()) == Counter(blank)


def test_mixing_stage_gives_each_row_its_own_place(spark, monkeypatch):
    rng = random.Random(8)
    text = lambda: " ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(1, 30)))
    rows = [(rng.choice([None, i % 9, 100 + i]), text(), rng.choice(["en", None]), rng.choice(["s1", None])) for i in range(60)]
    rows += [(5, "one row seven times", "en", "s1")] * 7 + [(None, "no id five times", None, None)] * 5 + [(None, None, "en", "s1"), (5, " ", "en", "s1")]
    rows = [(*r, 0) for r in rows]
    df = spark.createDataFrame(rows, DOCUMENTS).repartition(3)
    monkeypatch.setattr(corpus_pipeline, "MIX_LEVELS", ("lang", "source"))
    for share, epochs in ((0.9, 1), (0.4, 1), (1.7, 2)):
        monkeypatch.setattr(corpus_pipeline, "MIX", {"share": share, "epochs": epochs, "seed": 4})
        out = corpus_pipeline.mixing_stage(spark, df, "").collect()
        plan = brute_mix([(i, a, s, f"{t or ''}") for i, t, a, s, _ in rows], {"lang": corpus_pipeline.MIX_WEIGHTS["lang"], "source": {}}, share, epochs, 4)
        words = sorted((str(i), a, s, n) for i, a, s, n, full, part, _ in plan for n in [n] * full + [part] if n)
        assert sorted((str(r.doc_id), r.lang or "", r.source or "", len(r.text.split())) for r in out) == words, share
        texts = Counter((r.doc_id, r.text, r.lang, r.source) for r in out if r.text in {t for _, t, *_ in rows})
        held = Counter(r[:4] for r in rows)
        assert all(n <= held[k] * math.ceil(share) for k, n in texts.items())
        for r in out:
            starts = [t.split()[: len(r.text.split())] for i, t, a, s, _ in rows if t and (i, a, s) == (r.doc_id, r.lang, r.source)]
            assert r.text.split() in starts and r.n_chars == len(r.text)
