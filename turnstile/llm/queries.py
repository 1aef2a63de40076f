"""Queries of this subpackage over the shared tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstile.llm import ledger, licenses, merkle, mixing, parity, pfor, pieces, quality, rotations, spelling, substrings, urls, winnow

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(work: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[work.__name__] = work
    return work


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_winnowing(spark: SparkSession, folder: str) -> DataFrame:
    return winnow.edited_likeness(table(spark, folder, "documents"))


@query
def op2_ledger(spark: SparkSession, folder: str) -> DataFrame:
    rows = ledger.apply_policy(ledger.ledger(table(spark, folder, "documents").select("doc_id", "text")), ledger.POLICIES[1])
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~ledger.passes(F.col("failure_bits"), ledger.BASE)).alias("base_failed"), "kept", "n_lines", "n_capitals", "failure_bits",
    )


LEDGER = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
runs AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM runs QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
places AS (SELECT DISTINCT doc_id, i + k AS p FROM twice, (SELECT unnest([0, 1, 2]) AS k)),
repeats AS (SELECT doc_id, count(*) AS n FROM places GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, CAST(len(l) AS BIGINT) AS n_lines,
  CAST(length(regexp_replace(t, '[^A-Z]', '', 'g')) AS BIGINT) AS n_capitals
  FROM w LEFT JOIN repeats USING (doc_id)),
f AS (SELECT *, n_words < 50 AS f0, 100 * n_repeat_words > 50 * n_words AS f1, word_chars < 2 * n_words AS f2,
  word_chars > 25 * n_words AS f3, 10 * n_symbols > 3 * n_words AS f4, 100 * n_dup_lines > 30 * n_lines AS f5,
  100 * n_capitals > 50 * word_chars AS f6 FROM m)"""

ORACLES["op2_ledger"] = f"""{LEDGER}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f0 OR f1 AS base_failed,
  NOT (f0 OR f1 OR f4) AND f2::INT + f3::INT + f5::INT + f6::INT <= 1 AS kept, n_lines, n_capitals,
  CAST(f0::INT + 2 * f1::INT + 4 * f2::INT + 8 * f3::INT + 16 * f4::INT + 32 * f5::INT + 64 * f6::INT AS BIGINT) AS failure_bits
FROM f"""


@query
def rule_ablations(spark: SparkSession, folder: str) -> DataFrame:
    """What each rule of each policy alone removes, from the counts of the ledger's bit patterns."""
    return ledger.ablations(ledger.ledger(table(spark, folder, "documents").select("doc_id", "text")))


def ablation_sql() -> str:
    flag = {rule.name: f"f{i}" for i, rule in enumerate(ledger.RULES)}

    def kept(policy: ledger.Policy, without: str | None = None) -> str:
        hard = [flag[n] for n in policy.hard if n != without]
        soft = [f"{flag[n]}::INT" for n in policy.soft if n != without]
        return f"NOT ({' OR '.join(hard) or 'false'}) AND {' + '.join(soft) or '0'} <= {policy.slack}"

    cases = [
        f"SELECT {p.version!r} AS version, {r!r} AS rule, count(*) AS n_rows, count(*) FILTER (WHERE {kept(p)}) AS n_kept, "
        f"count(*) FILTER (WHERE {kept(p, r)}) AS n_kept_without FROM f"
        for p in ledger.POLICIES
        for r in (*p.hard, *p.soft)
    ]
    return f"{LEDGER} " + " UNION ALL ".join(cases)


ORACLES["rule_ablations"] = ablation_sql()

URL_RULES = (
    urls.UrlRule("allow", "org", "/"),
    urls.UrlRule("block", "example.org", "/es/"),
    urls.UrlRule("block", "example.org", "/en/1"),
    urls.UrlRule("allow", "com", "/fr/"),
    urls.UrlRule("block", "com", "/de/"),
)


@query
def op9_redirects(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge_pages(table(spark, folder, "pages"), urls.rule_table(spark, URL_RULES))


ORACLES["op9_redirects"] = r"""
WITH p AS (SELECT page_id, url, translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path,
  regexp_replace(regexp_replace(coalesce(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), ''), '(^|&)(?:utm_[a-z]+|ref|source|fbclid|gclid)=[^&]*', '', 'g'), '^&', '') AS query
  FROM pages),
r(verdict, rh, rp) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
  ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
own AS (SELECT DISTINCT p.url, p.host, p.path, 'https://' || regexp_replace(p.host, '^(?:www|m)\.', '') || regexp_replace(p.path, '(?:/|\.html?)$', '')
  || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS form FROM p),
ends AS (SELECT url, host, path, form FROM own UNION
  SELECT form, regexp_extract(form, '://([^/?#]*)', 1), regexp_extract(form, '://[^/?#]*([^?#]*)', 1), form FROM own),
fit AS (SELECT url, form, arg_max(rh || rp, length(rh) + length(rp)) AS rule, arg_max(verdict, length(rh) + length(rp)) AS verdict
  FROM ends JOIN r ON (host = rh OR host LIKE '%.' || rh) AND starts_with(path, rp) GROUP BY url, form),
spread AS (SELECT form, min(verdict) AS alias_verdict FROM fit GROUP BY form)
SELECT p.page_id, p.host, p.path, fit.rule, coalesce(fit.verdict, alias_verdict, 'allow') AS verdict,
  fit.verdict IS NULL AND alias_verdict IS NOT NULL AS aliased
FROM p JOIN own USING (url) LEFT JOIN fit USING (url) LEFT JOIN spread ON spread.form = own.form"""


@query
def linked_urls(spark: SparkSession, folder: str) -> DataFrame:
    """As ``op9_redirects`` with redirects besides: the first two of each five pages after one lead to it."""
    pages = table(spark, folder, "pages")
    first = (F.col("page_id") - F.col("page_id") % 5).alias("first")
    moved = pages.filter(F.col("page_id") % 5 < 3).select(F.col("url").alias("src"), first)
    redirects = moved.join(pages.select(F.col("page_id").alias("first"), F.col("url").alias("dst")), "first").select("src", "dst")
    return urls.judge_pages(pages, urls.rule_table(spark, URL_RULES), redirects=redirects)


_LINKED = ORACLES["op9_redirects"].replace("WITH p AS", "WITH RECURSIVE p AS", 1)
ORACLES["linked_urls"] = _LINKED.replace(
    "spread AS (SELECT form, min(verdict) AS alias_verdict FROM fit GROUP BY form)",
    """hop AS (SELECT DISTINCT a.form AS src, b.form AS dst FROM p x JOIN own a ON a.url = x.url JOIN p y ON y.page_id = x.page_id - x.page_id % 5 JOIN own b ON b.url = y.url
  WHERE x.page_id % 5 < 3),
reach AS (SELECT DISTINCT form AS src, form AS dst FROM own UNION SELECT reach.src, hops.dst FROM reach JOIN
  (SELECT src, dst FROM hop UNION SELECT dst, src FROM hop) hops ON hops.src = reach.dst),
spread AS (SELECT src AS form, min(verdict) AS alias_verdict FROM reach JOIN fit ON fit.form = reach.dst GROUP BY src)""",
)


@query
def op10_nbsvm(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select("doc_id", "text")
    judged = quality.classify(rows, table(spark, folder, "labels"))
    return judged.select("doc_id", "held_out", "score", "predicted")


@query
def op8_signatures(spark: SparkSession, folder: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score",
        F.size("detections").cast("long").alias("n_detections"),
    )


MIX_LEVELS = ("domain", "lang", "source")
MIX_WEIGHTS = {"domain": {"a": 3, "b": 2}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}, "source": {"src0": 2}}
MIX = {"share": 0.7, "epochs": 2, "seed": 11}


def with_domain(documents: DataFrame) -> DataFrame:
    """The tables have no domain: sources are parted into two by a hash of their name."""
    return documents.withColumn("domain", F.when(F.md5(F.coalesce("source", F.lit(""))) < "8", "a").otherwise("b"))


@query
def op3_mixing(spark: SparkSession, folder: str) -> DataFrame:
    documents = with_domain(table(spark, folder, "documents").select("doc_id", "text", "lang", "source"))
    return mixing.mix(documents, MIX_LEVELS, MIX_WEIGHTS, **MIX)


def mix_sql(source: str, levels, weights, share: float, epochs: int, seed: int) -> str:
    """The allotment in SQL. ``source`` gives doc_id, the levels without nulls, n_words and tie."""
    parts = [
        f"m AS ({source})",
        f"leaves AS (SELECT {', '.join(levels)}, sum(n_words)::BIGINT AS tokens, sum(n_words)::BIGINT * {epochs} AS held FROM m GROUP BY ALL)",
        f"given_0 AS (SELECT least(floor(sum(tokens) * {share}::DOUBLE), sum(held))::BIGINT AS amount FROM leaves)",
    ]
    for d, level in enumerate(levels, 1):
        path, parent = ", ".join(levels[:d]), ", ".join(levels[: d - 1])
        cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.get(level, {}).items())
        weight = f"CASE {level} {cases} ELSE 1 END" if cases else "1"
        by = f"PARTITION BY {parent}" if parent else ""
        join = f"JOIN given_{d - 1} USING ({parent})" if parent else "CROSS JOIN given_0"
        parts += [
            f"n_{d} AS (SELECT {path}, held::HUGEINT AS held, weight::HUGEINT AS weight, amount::HUGEINT AS amount FROM (SELECT {path}, sum(held) AS held, {weight} AS weight FROM leaves GROUP BY {path}) {join})",
            f"""c_{d} AS (SELECT *, (amount - coalesce(sum(held) OVER (x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * weight
  >= held * sum(weight) OVER (x ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS capped
  FROM n_{d} WINDOW x AS ({by} ORDER BY held::DOUBLE / weight, {level}))""",
            f"""r_{d} AS (SELECT *, (amount - coalesce(sum(held) FILTER (capped) OVER ({by}), 0))::HUGEINT AS rest,
  (sum(weight) FILTER (NOT capped) OVER ({by}))::HUGEINT AS openw,
  sum(CASE WHEN capped THEN 0 ELSE 1 END) OVER ({by} ORDER BY {level} ROWS UNBOUNDED PRECEDING) AS place FROM c_{d})""",
            f"f_{d} AS (SELECT *, CASE WHEN NOT capped THEN rest * weight // openw END AS share FROM r_{d})",
            f"""given_{d} AS (SELECT {path}, (CASE WHEN capped THEN held ELSE share + CASE WHEN place <= spare THEN 1 ELSE 0 END END)::BIGINT AS amount
  FROM (SELECT *, rest - coalesce(sum(share) OVER ({by}), 0) AS spare FROM f_{d}))""",
        ]
    path = ", ".join(levels)
    parts += [
        f"plan AS (SELECT {path}, amount AS given, CASE WHEN tokens > 0 THEN amount // tokens ELSE 0 END AS full_epochs, CASE WHEN tokens > 0 THEN amount % tokens ELSE 0 END AS rest FROM leaves JOIN given_{len(levels)} USING ({path}))",
        f"""o AS (SELECT *, coalesce(sum(n_words) OVER (PARTITION BY {path} ORDER BY md5('{seed}:' || full_epochs || ':' || coalesce(doc_id::VARCHAR, '')), doc_id, tie
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM m JOIN plan USING ({path}))""",
    ]
    return (
        f"WITH {', '.join(parts)} SELECT doc_id, {path}, n_words, full_epochs::BIGINT AS full_epochs, "
        "greatest(0, least(n_words, rest - ahead))::BIGINT AS prefix_words, given FROM o"
    )


ORACLES["op3_mixing"] = mix_sql(
    """SELECT doc_id, CASE WHEN md5(coalesce(source, '')) < '8' THEN 'a' ELSE 'b' END AS domain, coalesce(lang, '') AS lang,
  coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_words,
  md5(coalesce(text, '')) AS tie FROM documents""",
    MIX_LEVELS,
    MIX_WEIGHTS,
    **MIX,
)


@query
def op6_frames(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return pfor.encoded(table(spark, folder, "documents").select("doc_id", "text"), tokenizer)


@query
def op4_substrings(spark: SparkSession, folder: str) -> DataFrame:
    kept = substrings.remove_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


REPEATS_SQL = r"""
w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM {source}),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM w)),
again AS (SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM again, (SELECT unnest(range(20)) AS k)),
words AS (SELECT doc_id, p, w[p] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM w)),
stay AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)"""

ORACLES["op4_substrings"] = f"""
WITH {REPEATS_SQL.format(source="documents")}
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN stay USING (doc_id)"""


@query
def op5_parity(spark: SparkSession, folder: str) -> DataFrame:
    return parity.near_components(table(spark, folder, "documents").select("doc_id", "text"))


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query
def op7_viterbi(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    encoded = pieces.decode_pieces(pieces.encode_pieces(documents, piece_model()), piece_model())
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_pieces"),
        F.xxhash64("ids").alias("ids_hash"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("exact"),
    )


@query
def op11_qchunks(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, folder, "documents").select("doc_id", "text"))


#: crc32 of the bytes of a text, for DuckDB; ``crc_table`` must be in reach.
CRC_TABLE_SQL = """crc_table AS (SELECT list_transform(range(256), lambda i:
  list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t)"""


def crc_sql(byte_list: str) -> str:
    return f"xor(list_reduce({byte_list}, lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295::BIGINT), 4294967295)"


_WIDE = "".join(map(chr, range(0xC0, 0x100)))
#: One ASCII character for each of U+00C0 to U+00FF: the database compares bytes.
_NARROW = (urls.CAPITALS + "0123456789!#$%&()*+,-./:;<=>?@[]^_{|}~`")[: len(_WIDE)]
_RUN_BYTES = """flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda x:
  CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195::BIGINT, unicode(x)::BIGINT - 64] END))"""

ORACLES["op11_qchunks"] = f"""
WITH RECURSIVE {CRC_TABLE_SQL},
r AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), '{urls.CAPITALS}', '{urls.CAPITALS.lower()}') AS run FROM documents),
d AS (SELECT doc_id, run, count(*) AS n FROM r WHERE length(run) >= 6 GROUP BY ALL),
h AS (SELECT run, n, {crc_sql(_RUN_BYTES)} AS h FROM d, crc_table),
e AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM h),
v AS (SELECT word, sum(n)::BIGINT AS n, length(word) AS l, translate(word, '{_WIDE}', '{_NARROW}') AS c FROM e
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
near AS (SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM (SELECT *, unnest([l - 1, l, l + 1]) AS k FROM v) a JOIN v b
  ON a.k = b.l AND a.word <> b.word AND levenshtein(a.c, b.c) = 1),
best AS (SELECT word, count(*) AS n_near, min(struct_pack(o := -other_n, w := other)) AS b FROM near GROUP BY word),
forms AS (SELECT v.word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -b.o >= 5 * n THEN b.w END AS form,
  CASE WHEN -b.o >= 5 * n THEN -b.o END AS form_n FROM v LEFT JOIN best USING (word)),
way AS (SELECT word, coalesce(form, word) AS at, form IS NULL AS over FROM forms
  UNION ALL SELECT way.word, coalesce(forms.form, way.at), forms.form IS NULL FROM way JOIN forms ON forms.word = way.at WHERE NOT over)
SELECT f.word, f.form, way.at AS root, f.n, f.n_near, f.form_n FROM forms f JOIN way ON way.word = f.word AND way.over"""


@query
def op12_pointers(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.manifest(table(spark, folder, "documents"))


_FIELD_SQL = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(_FIELD_SQL.format(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _tree_sql(name: str, source: str, key: str) -> str:
    """Levels of trees and the steps of their nodes: ``source`` gives the key and the list of leaves in order."""
    return f"""{name}_levels AS (SELECT {key}, 0 AS level, nodes FROM {source}
  UNION ALL SELECT {key}, level + 1, list_transform(range(0, len(nodes), 3), lambda g: sha256(array_to_string(nodes[g + 1:g + 3], '')))
  FROM {name}_levels WHERE len(nodes) > 1),
{name}_steps AS (SELECT {key}, level, idx, array_to_string(nodes[idx // 3 * 3 + 1:idx], '') AS before, array_to_string(nodes[idx + 2:idx // 3 * 3 + 3], '') AS after
  FROM (SELECT *, unnest(range(0, len(nodes))) AS idx FROM {name}_levels WHERE len(nodes) > 1)),
{name}_root AS (SELECT {key}, nodes[1] AS digest, level AS height FROM {name}_levels WHERE len(nodes) = 1)"""


ORACLES["op12_pointers"] = f"""
WITH RECURSIVE {CRC_TABLE_SQL},
d AS (SELECT doc_id, coalesce('+' || source, '') AS tree, {_leaf_sql("text")} AS leaf, {_leaf_sql("replace(text, chr(10), '')")} AS other,
  {crc_sql("list_transform(string_split(doc_id::VARCHAR, ''), lambda x: unicode(x)::BIGINT)")} % 2 = 0 AS even FROM documents, crc_table),
p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id, leaf) - 1 AS idx FROM d),
trees AS (SELECT tree, list(leaf ORDER BY idx) AS nodes FROM p GROUP BY tree),
{_tree_sql("low", "trees", "tree")},
tops AS (SELECT 0 AS one, list(digest ORDER BY tree) AS nodes FROM low_root),
{_tree_sql("top", "tops", "one")},
place AS (SELECT tree, height, digest, row_number() OVER (ORDER BY tree) - 1 AS pos FROM low_root),
fold AS (SELECT doc_id, p.tree, leaf, 0 AS step, idx, CASE WHEN even THEN other ELSE leaf END AS acc, '' AS proof FROM p
  UNION ALL SELECT fold.doc_id, fold.tree, leaf, step + 1, CASE WHEN step + 1 = height THEN pos ELSE
    coalesce(l.idx, t.idx) // 3 END, sha256(coalesce(l.before, t.before) || acc || coalesce(l.after, t.after)),
    proof || coalesce(l.before, t.before) || coalesce(l.after, t.after)
  FROM fold JOIN place ON place.tree = fold.tree
  LEFT JOIN low_steps l ON l.tree = fold.tree AND l.level = step AND l.idx = fold.idx AND step < height
  LEFT JOIN top_steps t ON step >= height AND t.level = step - height AND t.idx = CASE WHEN height = 0 AND step = 0 THEN pos ELSE fold.idx END
  WHERE coalesce(l.idx, t.idx) IS NOT NULL)
SELECT doc_id, leaf, place.digest AS subroot, top_root.digest AS root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = top_root.digest AS verified
FROM (SELECT * FROM fold QUALIFY row_number() OVER (PARTITION BY doc_id, tree, leaf ORDER BY step DESC) = 1) JOIN place USING (tree), top_root"""


@query
def op13_rotations(spark: SparkSession, folder: str) -> DataFrame:
    return rotations.near_vectors(table(spark, folder, "embeddings"))


ORACLES["op13_rotations"] = """
WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, list_reduce(list_transform(embedding, lambda x: abs(x)), lambda a, b: a + b) AS size FROM embeddings),
sound AS (SELECT * FROM e WHERE label IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND size > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  AND list_cosine_similarity(a.v, b.v) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM e UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
least AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM e JOIN least USING (vec_id) LEFT JOIN counts USING (vec_id)"""
