"""Fingerprints and the rule ledger against brute force, with nulls, ties, long and clashing input."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from turnstile.llm import ledger, winnow

DOCS = "doc_id long, text string, id string, block int, lead boolean, n_words string, _words string, failure_bits string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, True, "y", "z", "w") for i, t in rows], DOCS)


def brute_marks(text, gram, window):
    gram = min(gram, len(text))
    hashes = [int(winnow.marks(text[i : i + gram], gram, 1)[0][0]) for i in range(len(text) - gram + 1)] if text else []
    window = min(window, len(hashes))
    chosen = set()
    for s in range(len(hashes) - window + 1 if hashes else 0):
        low = min(hashes[s : s + window])
        chosen.add(max(i for i in range(s, s + window) if hashes[i] == low))
    return sorted(chosen)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab é😀", max_size=80), st.integers(1, 9), st.integers(1, 12))
def test_marks_are_the_rightmost_minima(text, gram, window):
    assert winnow.marks(text, gram, window)[1].tolist() == brute_marks(text, gram, window)


def test_any_long_common_passage_leaves_a_common_mark():
    rng = np.random.default_rng(1)
    letters = lambda n: "".join(rng.choice(list("abcdefgh"), n))
    for _ in range(50):
        common = letters(winnow.GRAM + winnow.WINDOW - 1)
        a, b = (winnow.marks(letters(90) + common + letters(70))[0] for _ in range(2))
        assert len(np.intersect1d(a, b))


ROWS = [(3, "c" * 70), (1, "alpha beta gamma " * 9), (None, "nowhere"), (2, None), (1, "alpha beta gamma " * 9), (9, "é😀" * 60_000), (4, "")]


def test_edits_follow_the_next_document(spark, rows):
    found = rows(winnow.edited_likeness(frame(spark, ROWS)).select("doc_id", "n_chars", "edited_sha256", "near_next"))
    ordered = sorted(((i, t or "") for i, t in ROWS), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    expected = []
    for (i, text), (_, other) in zip(ordered, [*ordered[1:], ordered[0]], strict=True):
        n = len(text)
        edited = text[: n - n // 4] + other[: n // 4]
        near = winnow.likeness(winnow.marks(text)[0], winnow.marks(other)[0])
        expected.append((i, n, hashlib.sha256(edited.encode()).hexdigest(), near))
    key = lambda r: tuple((v is not None, str(v)) for v in r)
    assert found == sorted(expected, key=key)


def test_equal_texts_have_equal_fingerprints(spark):
    found = winnow.edited_likeness(frame(spark, ROWS)).filter("doc_id = 1").select("fingerprint").distinct()
    assert found.count() == 1


def test_a_single_document_follows_itself_and_none_gives_none(spark):
    one = winnow.edited_likeness(frame(spark, [(5, "one text that is here " * 5)])).first()
    assert one.near_next == 1.0
    assert winnow.edited_likeness(frame(spark, [])).count() == 0
    assert winnow.fingerprints(frame(spark, [(1, None), (2, "")])).count() == 0
    assert {r.position for r in winnow.fingerprints(frame(spark, [(1, "ab")])).collect()} == {0}


def brute_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    runs = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    repeated = {i + k for i, r in enumerate(runs) if runs.count(r) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated)


TEXTS = [None, "", " \n\t", "a b c a b c a b c", "x # y\nx # y\n\nx # y", "é😀 b\x0bc\x1fd", "a\nb\r\na\nb", "one two", "w " * 3000, "THE END " * 40]


def test_measures(spark):
    df = frame(spark, list(enumerate(TEXTS)) + [(3, TEXTS[3]), (None, "a b")])
    found = ledger.ledger(df)
    assert {"id", "block", "lead", "_words"} <= set(found.columns)
    for r in found.collect():
        text = "a b" if r.doc_id is None else TEXTS[r.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_measures(text), text
    assert ledger.ledger(frame(spark, [])).count() == 0


def test_policies_are_masks_and_ablations_count_them(spark):
    rows = ledger.ledger(frame(spark, list(enumerate(TEXTS))))
    bits = [r.failure_bits for r in rows.collect()]
    places = {r.name: 1 << i for i, r in enumerate(ledger.RULES)}

    def kept(b, policy, without=None):
        hard = any(b & places[n] for n in policy.hard if n != without)
        return not hard and sum(bool(b & places[n]) for n in policy.soft if n != without) <= policy.slack

    for policy in ledger.POLICIES:
        assert [r.kept for r in ledger.apply_policy(rows, policy).collect()] == [kept(b, policy) for b in bits]
    found = {(r.version, r.rule): (r.n_rows, r.n_kept, r.n_kept_without) for r in ledger.ablations(rows).collect()}
    for policy in ledger.POLICIES:
        for rule in (*policy.hard, *policy.soft):
            want = len(bits), sum(kept(b, policy) for b in bits), sum(kept(b, policy, rule) for b in bits)
            assert found[policy.version, rule] == want
    assert ledger.ablations(rows.limit(0)).count() == 0


def test_null_bits_count_as_no_failure(spark):
    stored = spark.createDataFrame([(1, None), (2, 1)], "doc_id long, failure_bits long")
    assert [r.kept for r in ledger.apply_policy(stored, ledger.BASE).orderBy("doc_id").collect()] == [True, False]


def test_an_unknown_rule_is_an_error():
    with pytest.raises(KeyError):
        ledger.mask(["no such rule"])


def test_short_near_copies_are_alike():
    rng = random.Random(5)
    letters = lambda n: "".join(rng.choice("abcdefghij klmnop") for _ in range(n))
    for size, error in ((30, 0.3), (60, 0.12), (200, 0.06)):
        off = []
        for _ in range(100):
            text = letters(size)
            other = text[: size - size // 4] + letters(size // 4)
            near = winnow.likeness(winnow.marks(text)[0], winnow.marks(other)[0])
            assert near > 0, size
            kept, all_grams = size - size // 4 - winnow.GRAM + 1, size - winnow.GRAM + 1
            off.append(near - kept / (2 * all_grams - kept))
        assert (sum(x * x for x in off) / len(off)) ** 0.5 < error, size
