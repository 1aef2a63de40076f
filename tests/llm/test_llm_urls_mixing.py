"""URL filter, components and source mixing against brute force."""

import hashlib
import random
from collections import defaultdict
from fractions import Fraction
from urllib.parse import urljoin

import pytest

from turnstile.llm import mixing, urls
from turnstile.llm.components import components

RULES = [urls.UrlRule("allow", "org", "/"), urls.UrlRule("block", "example.org", "/es/"), urls.UrlRule("block", "com", "/de/"), urls.UrlRule("allow", "com", "/fr/")]


def brute_components(edges):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


def test_components_of_chains_hubs_and_loops(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, 1000 + i) for i in range(50)] + [(5, 5), (2000, 2001), (2000, 2001), (2001, 2000)]
    edges += [(rng.randrange(3000, 3080), rng.randrange(3000, 3080)) for _ in range(60)]
    df = spark.createDataFrame([*edges, (None, 4), (4, None)], "a long, b long")
    assert {r.node: r.component for r in components(df).collect()} == brute_components(edges)
    assert components(df.limit(0)).count() == 0


def test_rules_aliases_and_allow_precedence(spark):
    pages = [
        (1, "http://www.shop.com/de/x", ""),
        (2, "https://shop.com/de/x/", ""),
        (3, "https://Mirror.NET/a#top", '<link rel="canonical" href="http://shop.com/de/x">'),
        (4, "https://mirror.net/b", '<META http-equiv="Refresh" content="0; url=http://good.org/p">'),
        (5, "https://both.net/c", '<link rel="canonical" href="http://shop.com/de/x?utm_source=a">'),
        (5, "https://both.net/c", '<meta http-equiv="refresh" content="0;url=https://good.org/p.html">'),
        (6, "http://other.net/z", None),
        (7, None, "x"),
        (8, "no scheme", ""),
        (9, "http://sub.example.org/es/1", ""),
        (10, "http://org", ""),
    ]
    df = spark.createDataFrame([(*p, "q", "r") for p in pages], "page_id long, url string, html string, host string, verdict string")
    found = {r.page_id: r for r in urls.judge_pages(df, urls.rule_table(spark, RULES)).collect()}
    assert (found[1].rule, found[1].verdict) == ("com/de/", "block")
    assert found[3].host == "mirror.net" and found[3].path == "/a" and found[3].rule is None
    # page 5 ties the blocked shop to the allowed site: allow wins for pages without a rule
    assert [found[i].verdict for i in (3, 4, 5, 6, 7, 8)] == ["allow"] * 6
    assert found[3].aliased and found[5].aliased and not found[6].aliased
    assert (found[9].rule, found[9].verdict) == ("example.org/es/", "block")
    assert (found[7].host, found[7].path, found[8].host, found[8].path) == ("", "", "", "")
    assert found[10].rule is None and found[10].path == ""
    assert urls.judge_pages(df, urls.rule_table(spark, RULES)).count() == len(pages)
    alone = urls.judge_pages(df.filter("page_id < 5"), urls.rule_table(spark, RULES))
    assert {r.page_id: r.verdict for r in alone.collect()} == {1: "block", 2: "block", 3: "block", 4: "allow"}
    assert urls.judge_pages(df.limit(0), urls.rule_table(spark, RULES)).count() == 0


def test_links_resolve_as_in_browsers(spark):
    rng = random.Random(2)
    bases = ["http://a.com", "https://a.com/", "http://a.com/x/y.html?q=1#f", "http://A.com/x/y/", "http://a.com/x?z=/p/q"]
    links = ["/de/x", "//m.b.org/p?q", "c", "./c", "../c", "../../../c/./d/..", "?k=v", "https://z.net/a/../b", "c/../d?x=../y", "/", "c?a=1&amp;b=2", ".", ".."]
    links += ["/".join(rng.choice(["..", ".", "a", "b"]) for _ in range(rng.randrange(1, 7))) for _ in range(40)]
    pairs = [(b, x) for b in bases for x in links]
    rows = spark.createDataFrame(pairs, "base string, link string")
    for r in rows.select("base", "link", urls.resolve(rows.link, rows.base).alias("got")).collect():
        assert r.got == urljoin(r.base, r.link.replace("&amp;", "&")), (r.base, r.link)
    odd = spark.createDataFrame([("http://a.com/", x) for x in ("mailto:me", "#top", "", "javascript:f()", None)] + [("a.com", "/x"), (None, "/x")], "base string, link string")
    assert [r.got for r in odd.select(urls.resolve(odd.link, odd.base).alias("got")).collect()] == [None] * 7


def test_relative_links_carry_decisions(spark):
    link, move = '<link href="{}" rel="canonical">', "<meta http-equiv='refresh' content='5; URL={}'>"
    pages = [
        (1, "http://a.com/other/1", link.format("/de/x")),
        (2, "http://a.net/2", link.format("//a.com/de/y")),
        (3, "http://a.com/de/sub/3", ""),
        (4, "http://b.net/4", '<base href="http://a.com/de/"><p>' + move.format("sub/z")),
        (5, "http://b.net/5", link.format("mailto:x") + link.format("http://a.com/de/w?a=1&amp;ref=2")),
        (6, "http://b.net/6", move.format("/7")),
        (7, "http://b.net/7", link.format("../4")),
        (8, "http://b.net/8", link.format("#x")),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    found = {r.page_id: (r.verdict, r.aliased) for r in urls.judge_pages(df, urls.rule_table(spark, RULES)).collect()}
    blocked = ("block", True)
    assert found == {1: blocked, 2: blocked, 3: ("block", False), 4: blocked, 5: blocked, 6: blocked, 7: blocked, 8: ("allow", False)}
    moved = spark.createDataFrame([("http://b.net/8", "http://www.good.org/x"), (None, "http://b.net/8")], "src string, dst string")
    found = {r.page_id: r.verdict for r in urls.judge_pages(df, urls.rule_table(spark, [*RULES, urls.UrlRule("block", "b.net", "/zz")]), redirects=moved).collect()}
    assert found[8] == "allow"


def test_many_rules_of_one_host_make_no_pairs(spark):
    n = 600
    rules = spark.range(n).selectExpr("if(id % 2 = 0, 'block', 'allow') as rule_verdict", "'big.com' as rule_host", "concat('/', id, '/') as rule_path")
    known = spark.range(n).selectExpr("concat('http://www.big.com/', id, '/x') as url")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = urls.rule_verdicts(known, rules)
        assert {(r.path, r.rule) for r in found.collect()} == {(f"/{i}/x", f"big.com/{i}/") for i in range(n)}
        made, walk = [], [found._jdf.queryExecution().executedPlan()]
        while walk:
            node = walk.pop()
            walk += [node.children().apply(i) for i in range(node.children().size())]
            if "Join" in node.nodeName():
                made.append(node.metrics().apply("numOutputRows").value())
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(made) == 3 and max(made) <= 3 * n


def brute_fill(amount, children):
    """children: (key, weight, held) -> tokens by key, by repeated sharing."""
    given, left, rest = {}, list(children), amount
    while True:
        total = sum(w for _, w, _ in left)
        full = [c for c in left if Fraction(rest * c[1], total) >= c[2]]
        if not full:
            break
        for k, _, held in full:
            given[k] = held
            rest -= held
        left = [c for c in left if c not in full]
        if not left:
            return given
    floors = {k: rest * w // total for k, w, _ in left}
    spare = rest - sum(floors.values())
    for k in sorted(floors):
        given[k] = floors[k] + (1 if spare > 0 else 0)
        spare -= 1
    return given


def brute_mix(rows, weights, share, epochs, seed):
    leaves = defaultdict(list)
    for i, lang, source, text in rows:
        leaves[lang or "", source or ""].append((i, len((text or "").split()), hashlib.md5((text or "").encode()).hexdigest()))
    tokens = {k: sum(n for _, n, _ in v) for k, v in leaves.items()}
    total = min(int(sum(tokens.values()) * share), sum(tokens.values()) * epochs)
    langs = {a for a, _ in leaves}
    top = brute_fill(total, [(a, weights["lang"].get(a, 1), epochs * sum(n for (x, _), n in tokens.items() if x == a)) for a in langs])
    out = []
    for lang in langs:
        inner = brute_fill(top[lang], [(s, weights["source"].get(s, 1), epochs * n) for (x, s), n in tokens.items() if x == lang])
        for source, given in inner.items():
            all_ = tokens[lang, source]
            full, rest = divmod(given, all_) if all_ else (0, 0)
            place = lambda d: hashlib.md5(f"{seed}:{full}:{'' if d[0] is None else d[0]}".encode()).hexdigest()  # noqa: B023, E731
            for i, n, _ in sorted(leaves[lang, source], key=lambda d: (place(d), d[0] is not None, d[0] or 0, d[2])):
                part = max(0, min(n, rest))
                rest -= part
                out.append((i, lang, source, n, full, part, given))
    return out


def test_mix_matches_repeated_sharing(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["en", "de", None]), rng.choice(["hot", "hot", "a", "b", None]), "w " * rng.randrange(0, 60)) for i in range(150)]
    rows += [(None, "en", "a", None), (3, "en", "hot", "same row"), (3, "en", "hot", "same row"), (999, "fr", "tiny", "x " * 20_000), (1000, "zz", "empty", "")]
    schema = "doc_id long, lang string, source string, text string, range string, tokens string, given string"
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], schema)
    weights = {"lang": {"en": 7, "fr": 5}, "source": {"hot": 3}}
    key = lambda r: tuple((v is not None, str(v)) for v in r)
    for share, epochs in ((0.4, 1), (1.6, 2), (5.0, 3), (0.0, 1)):
        found = mixing.mix(df, ["lang", "source"], weights, share=share, epochs=epochs, seed=4)
        assert found.columns == ["doc_id", "lang", "source", "n_words", "full_epochs", "prefix_words", "given"]
        assert sorted(map(tuple, found.collect()), key=key) == sorted(brute_mix(rows, weights, share, epochs, 4), key=key), share


def test_mix_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, lang string, source string, text string")
    assert mixing.mix(empty, ["lang", "source"], {}, share=0.5).count() == 0
    blank = spark.createDataFrame([(1, "en", "a", None)], empty.schema)
    assert [(r.full_epochs, r.prefix_words) for r in mixing.mix(blank, ["lang", "source"], {}, budget=10).collect()] == [(0, 0)]


def test_values_of_weight_zero_get_nothing(spark):
    rows = [(i, ["en", "de", "ads"][i % 3], "s", "w " * 10) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string")
    found = mixing.mix(df, ["lang", "source"], {"lang": {"ads": 0}}, share=0.5).collect()
    assert len(found) == 30 and {r.given for r in found if r.lang == "ads"} == {0}
    assert sum(r.prefix_words for r in found) == 100 and not any(r.prefix_words for r in found if r.lang == "ads")
    assert {r.given for r in mixing.mix(df, ["lang"], {"lang": {"en": 0, "de": 0, "ads": 0}}, budget=5).collect()} == {0}
    for weight in (-1, 0.5, None):
        with pytest.raises(ValueError, match="lang 'en'"):
            mixing.mix(df, ["lang"], {"lang": {"en": weight}})


def test_a_hot_id_is_dealt_out_by_its_rows(spark, monkeypatch):
    """Rows without an id, half of them equal, share one place: they are cut exactly, and in no single task."""
    rows = [(None, "en", "s", "same words here" if i % 2 else "w " * (i % 17 + 1)) for i in range(4_000)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string").repartition(4)
    parts, keep = [], mixing.stored

    def spy(rows, name):
        table = keep(rows, name)
        if name == "ends":
            parts.append([r["count"] for r in table.groupBy("part").count().collect()])
        return table

    monkeypatch.setattr(mixing, "stored", spy)
    # Else Spark joins such small partitions up to its advisory size.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = mixing.mix(df, ["lang", "source"], {}, share=0.37, seed=4).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    expected = brute_mix(rows, {"lang": {}, "source": {}}, 0.37, 1, 4)
    key = lambda r: tuple((v is not None, str(v)) for v in r)
    assert sorted(map(tuple, found), key=key) == sorted(expected, key=key)
    assert sum(parts[0]) == 4_000 and len(parts[0]) == 4 and max(parts[0]) < 1_500
