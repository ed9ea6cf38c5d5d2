"""The corpus queries: thin wrappers that apply each operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import contaminated_pairs
from .language_id import identify_language
from .lexical_search import ranked_search
from .license_scan import TEMPLATES, scan_licenses, size_class
from .near_dedup import near_duplicate_groups
from .nearest import nearest_neighbours
from .packing import pack_documents
from .pii import find_personal_data
from .quality import BAD_IF_NOT, BAD_IF_SO, ROUNDS, RULES, SHARE, SLACK, STATISTICS, judge_quality
from .secret_scan import ALLOWED, ALLOWED_BEFORE, LEAST_BITS, WINDOW, scan_secrets
from .shared import table
from .toxicity import judge_toxicity
from .url_filter import judge_urls
from .whitening import whitened

#: The rules of the URL query (host, path, verdict).
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
TOKENIZER = "word_bpe_49k.json"


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(table(spark, sf_dir, "documents"))


def op2_forest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))


def op4_license_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op5_nnpu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op8_spectrum_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(table(spark, sf_dir, "documents"))


def op9_entropy_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op10_url_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op11_tiled_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))


def op12_wand_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    # sums of doubles differ in their last digits from order to order
    return judge_quality(table(spark, sf_dir, "documents")).withColumn("quality", F.round("quality", 6))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_minhash_near_dedup, op2_forest_neighbours, op3_personal_data, op4_license_windows, op5_nnpu_toxicity, op6_string_tiling,
        op7_vector_packing, op8_spectrum_language, op9_entropy_secrets, op10_url_digests, op11_tiled_whitening,
        op12_wand_search, op13_quality_votes,
    )
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rule_sql(value: int) -> str:
    """CASE over the URL rules, the longest first; ``value`` 0 gives the rule, 1 the verdict."""
    longest = sorted(URL_RULES, key=lambda r: -len(r[0] + r[1]))
    when = lambda h, p, v: f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{(h + p, v)[value]}'"
    return "CASE " + " ".join(when(*r) for r in longest) + (" ELSE NULL END" if value == 0 else " ELSE 'allow' END")


def _license_sql() -> str:
    """Containment of every template in every window, without minhashes."""
    lower = lambda c: f"translate({c}, '{_UPPER}', '{_LOWER}')"
    words = lambda c: rf"regexp_extract_all({lower(c)}, '[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+')"
    templates = ", ".join(f"('{n}', {size_class(t)}, '{t}')" for n, t in sorted(TEMPLATES.items()))
    return f"""
        WITH t(license, size, text) AS (VALUES {templates}),
        tw AS (SELECT license, size, {words("text")} AS w FROM t),
        ts AS (SELECT DISTINCT license, size, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - 3)) AS i FROM tw)),
        tn AS (SELECT license, count(*) AS n FROM ts GROUP BY license),
        dw AS (SELECT doc_id, {words("coalesce(text, '')")} AS w FROM documents),
        ds AS (SELECT doc_id, i - 1 AS pos, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - 3)) AS i FROM dw)),
        m AS (SELECT doc_id, license, size, pos, s FROM ds JOIN ts USING (s)),
        win AS (SELECT doc_id, license, size, pos // size AS k, s FROM m UNION ALL SELECT doc_id, license, size, pos // size - 1, s FROM m WHERE pos >= size),
        c AS (SELECT doc_id, license, size, k, count(DISTINCT s) AS hits FROM win GROUP BY ALL)
        SELECT doc_id, license, max(hits / n::DOUBLE) AS containment, CAST(first(k * size ORDER BY hits DESC, k) AS BIGINT) AS window_start
        FROM c JOIN tn USING (license) GROUP BY doc_id, license HAVING max(hits / n::DOUBLE) >= 0.8"""


def _secret_sql() -> str:
    """Spans from splits and matches of each pattern; entropies of all windows of each candidate."""
    assign = r"""(?i:password|passwd|secret|token|api_?key)["\x27]?\x20*[:=]\x20*["\x27]?"""
    patterns = {"assign": assign + "[A-Za-z0-9+/_.=-]+", "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]{32,}", "entropy": f"[A-Za-z0-9+/_=-]{{{WINDOW},}}"}
    found = " UNION ALL ".join(
        f"SELECT doc_id, text, '{k}' AS kind, {n} AS ord, regexp_extract_all(text, '{p}') AS hits, string_split_regex(text, '{p}') AS gaps FROM d" for n, (k, p) in enumerate(patterns.items())
    )
    size = lambda items: f"coalesce(list_sum(list_transform({items}, lambda x: length(x))), 0)"
    plain = lambda p: p.replace("++", "+").replace("*+", "*")
    allowed = " OR ".join(f"regexp_matches(value, '{plain(p)}')" for p in ALLOWED)
    bits = f"list_max(list_transform(range(1, length(value) - {WINDOW - 2}), lambda i: list_entropy(string_split(value, '')[i:i + {WINDOW - 1}])))"
    joined = "coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord){}, '')"
    base = " FILTER (WHERE kind <> 'entropy')"
    return f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), f AS ({found}),
        p AS (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM f WHERE len(hits) > 0),
        s AS (SELECT doc_id, text, kind, ord, hits[i] AS value, CAST({size("gaps[1:i]")} + {size("hits[1:i - 1]")} AS INTEGER) AS start FROM p),
        e AS (SELECT *, start + CAST(length(value) AS INTEGER) AS stop FROM s),
        b AS (SELECT * FROM e WHERE kind = 'hex' OR (kind = 'access' AND length(value) >= 16) OR (kind = 'assign' AND length(regexp_replace(value, '^{assign}', '')) >= 8)),
        x AS (
            SELECT * FROM e WHERE kind = 'entropy' AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]') AND NOT ({allowed})
              AND NOT regexp_matches(substr(text, greatest(1, start - 23), least(start, 24)), '{ALLOWED_BEFORE}')
              AND NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = e.doc_id AND e.start < b.stop AND b.start < e.stop)),
        y AS (SELECT * FROM x WHERE {bits} >= CASE WHEN regexp_matches(value, '^[0-9a-fA-F]+$') THEN {LEAST_BITS["hex"]} ELSE {LEAST_BITS["mixed"]} END),
        a AS (SELECT doc_id, kind, ord, start, stop FROM b UNION ALL SELECT doc_id, kind, ord, start, stop FROM y)
        SELECT d.doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
               sha256({joined.format(base)}) AS base_sha256, {joined.format("")} AS spans, count(*) FILTER (WHERE kind = 'entropy') AS n_entropy
        FROM (SELECT doc_id FROM d) d LEFT JOIN a USING (doc_id) GROUP BY d.doc_id"""


def _search_sql() -> str:
    """Scores of all documents that share a term with an item, without shards or bounds."""
    terms = lambda c: rf"regexp_extract_all(translate({c}, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+')"
    return f"""
        WITH d AS (SELECT doc_id, {terms("text")} AS w FROM documents WHERE text IS NOT NULL),
        sizes AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n FROM d WHERE len(w) > 0),
        total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sizes),
        tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) GROUP BY doc_id, term),
        q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({terms("text")}) AS term FROM benchmark WHERE text IS NOT NULL) GROUP BY item_id, term),
        df AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM tf, total GROUP BY term, docs),
        scores AS (
            SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms)))) AS BIGINT) AS score
            FROM q JOIN tf USING (term) JOIN df USING (term) JOIN sizes USING (doc_id), total GROUP BY item_id, doc_id)
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= 10"""


def _quality_sql() -> str:
    """Statistics by regular expressions and windows as rows; expectation-maximisation as a recursion over the counts of vote patterns."""
    size = lambda kept: f"CAST(length(regexp_replace(text, '[^{kept}]', '', 'g')) AS BIGINT)"
    some = lambda pattern, not_="": f"CAST(len(list_filter(w, lambda x: {not_} regexp_matches(x, '{pattern}'))) AS BIGINT)"
    kinds, votes = list(dict.fromkeys(r.kind for r in RULES)), range(len(RULES))
    cast = ", ".join(f"CASE WHEN {r.bad} THEN -1 WHEN {r.good} THEN 1 ELSE 0 END AS v{i}" for i, r in enumerate(RULES))
    start = lambda value, n: f"[{', '.join([f'{value}::DOUBLE'] * n)}]"
    tell = lambda i: f"CASE WHEN v{i} > 0 THEN ln((1 - b[{i + 1}]) / (1 - g[{i + 1}])) WHEN v{i} < 0 THEN ln(b[{i + 1}] / g[{i + 1}]) ELSE 0 END"
    odds = ", ".join(f"exp(least(700, ln(s[{k + 1}] / (1 - list_sum(s))) + {' + '.join(tell(i) for i in votes if RULES[i].kind == kind)})) AS o{k}" for k, kind in enumerate(kinds))
    all_ = " + ".join(f"o{k}" for k in range(len(kinds)))
    share = ", ".join(f"(sum(n * o{k} / (1 + {all_})) + {SLACK * SHARE}::DOUBLE) / (sum(n) + {SLACK}::DOUBLE)" for k in range(len(kinds)))
    have = lambda i: f"n * o{kinds.index(RULES[i].kind)} / (1 + {all_})"
    rate = lambda i, w, a: f"(coalesce(sum({w}) FILTER (WHERE v{i} < 0), 0) + {SLACK * a}::DOUBLE) / (coalesce(sum({w}) FILTER (WHERE v{i} <> 0), 0) + {SLACK}::DOUBLE)"
    return rf"""
        WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
        t AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
        win AS (SELECT rid, i, w[i:i + 4] AS five FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM t)),
        twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, five) AS n FROM win) WHERE n > 1),
        again AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS j FROM twice) GROUP BY rid),
        st AS (
            SELECT t.rid, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, {size("#*$%&|<>")} AS n_symbols,
                   CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(again.n, 0) AS n_repeat_words, CAST(len(lines) AS BIGINT) AS n_lines,
                   {size("A-Z")} AS n_upper, {size("a-z")} AS n_lower, {some("[^\x00-\x40\x5b-\x60\x7b-\x7f]", "NOT")} AS n_plain_words, CAST(len(list_distinct(w)) AS BIGINT) AS n_distinct,
                   {size("!-/:-@\x5b-\x60{-~")} AS n_marks, {some("^[A-Z]")} AS n_initial
            FROM t LEFT JOIN again ON again.rid = t.rid),
        votes AS (SELECT *, {cast} FROM st),
        p AS (SELECT {", ".join(f"v{i}" for i in votes)}, count(*) AS n FROM votes GROUP BY ALL),
        em AS (
            SELECT 0 AS round, {start(SHARE, len(kinds))} AS s, {start(BAD_IF_NOT, len(RULES))} AS g, {start(BAD_IF_SO, len(RULES))} AS b
            UNION ALL
            SELECT round + 1, [{share}], [{", ".join(rate(i, f"(n - {have(i)})", BAD_IF_NOT) for i in votes)}], [{", ".join(rate(i, f"({have(i)})", BAD_IF_SO) for i in votes)}]
            FROM (SELECT round, p.*, {odds} FROM em, p WHERE round < {ROUNDS}) GROUP BY round),
        last AS (SELECT * FROM em WHERE round = {ROUNDS}),
        judged AS (SELECT *, 1 / (1 + {all_}) AS q, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS failed FROM (SELECT votes.*, {odds} FROM votes, last))
        SELECT doc_id, {", ".join(STATISTICS[:5])}, failed AS base_failed, NOT failed AND q >= 0.5 AS kept, round(q, 6) AS quality FROM judged"""


ORACLE_SQL: dict[str, str] = {
    "op13_quality_votes": _quality_sql(),
    "op12_wand_search": _search_sql(),
    "op9_entropy_secrets": _secret_sql(),
    "op4_license_windows": _license_sql(),
    "op1_minhash_near_dedup": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), shingles AS (
            SELECT DISTINCT doc_id, s FROM (
                SELECT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS s
                FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM words WHERE len(w) > 0))
        ), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
        ), links AS (
            SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
            JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
            GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))
        ), reach AS (SELECT doc_id, doc_id AS seen FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.seen)
        SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, min(r.seen) AS component_id, d.doc_id = min(r.seen) AS kept
        FROM documents d JOIN reach r USING (doc_id) LEFT JOIN sizes s USING (doc_id) GROUP BY d.doc_id, s.n""",
    "op10_url_digests": f"""
        WITH cut AS (
            SELECT page_id, CASE WHEN url IS NULL OR instr(url, '://') = 0 THEN '' ELSE substr(url, instr(url, '://') + 3) END AS rest
            FROM pages
        ), parts AS (
            SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
            FROM cut
        )
        SELECT page_id, host, path, {_rule_sql(0)} AS rule, {_rule_sql(1)} AS verdict FROM parts""",
    "op2_forest_neighbours": """
        WITH usable AS (
            SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), near AS (
            SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: (q.v[i] - c.v[i]) * (q.v[i] - c.v[i])))) AS score
            FROM usable q JOIN usable c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
        ), ranked AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score FROM near
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10""",
}
