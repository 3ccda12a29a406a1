"""One query for each operator, over its whole table, and DuckDB SQL where that is fast enough."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitplane, decontaminate, html_text, licenses, packing, quality, secrets, simhash, substring_dedup, urls
from .common import shared_folder


def tokenizer_path(name: str) -> str:
    """Where the vocabulary file of a public tokenizer lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_substrings(table(spark, sf_dir, "documents"), window=35, with_text=False)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


#: Where a document lies: its source is a repository with a directory for each language.
DOC_PATH = "concat(source, '/', lang, '/', doc_id, '.txt')"


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("path", F.expr(DOC_PATH))
    return licenses.scan_licenses(docs).select("doc_id", "path", "license", F.round("similarity", 6).alias("similarity"), "inherited", "inherited_from")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = f"{shared_folder(spark)}/secret-ledger-{uuid.uuid4().hex}"
    found = secrets.scan_into_ledger(table(spark, sf_dir, "documents"), ledger)
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(secrets.spans_string(base), 256).alias("base_sha256"), secrets.spans_string(F.col("spans")).alias("spans"),
    )


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = bitplane.new_folder(spark)
    bitplane.write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_path("byte_bpe_50k.json"), end_id=2)
    return bitplane.read_tokens(spark, path, with_ids=False)


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), capacity=2048, end_id=0)


URL_RULES = (
    urls.UrlRule("block", "net", "/"),
    urls.UrlRule("allow", "example.net", "/en/"),
    urls.UrlRule("block", "example.com", "/de/"),
    urls.UrlRule("allow", "org", "/fr/"),
)
#: Listed hosts, as a category feed names them; fixed values.
LISTED_HOSTS = tuple(f"{name}.example.{top}" for name in ("ads-track", "free-bets", "cheap-pills", "spam-farm", "casino-win", "adult-x") for top in ("com", "net", "org"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.range(1).select(F.explode(F.array(*[F.lit(f"{h}/") for h in LISTED_HOSTS])).alias("key"))
    return urls.filter_urls(table(spark, sf_dir, "pages"), listed, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, distance=3)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            op1_substring_dedup, op2_decontaminate, op3_license_scan, op4_secrets, op5_token_files,
            op6_pack, op7_url_filter, op8_simhash, op9_quality, op10_html_text,
        )
    }


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_ALNUM = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP1 = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
wins AS (SELECT r, p, hash(array_to_string(list_slice(w, p, p + 34), ' ')) AS h, md5(array_to_string(list_slice(w, p, p + 34), ' ')) AS m
         FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS p FROM docs WHERE len(w) >= 35)),
many AS (SELECT h, m FROM wins GROUP BY h, m HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(p, p + 35)) AS p FROM wins JOIN many USING (h, m)),
lost AS (SELECT r, list(p) AS ps FROM gone GROUP BY r),
flat AS (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM docs WHERE len(w) > 0),
kept AS (SELECT flat.r, string_agg(x, ' ' ORDER BY flat.p) AS t FROM flat LEFT JOIN gone ON flat.r = gone.r AND flat.p = gone.p WHERE gone.r IS NULL GROUP BY flat.r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM docs LEFT JOIN lost USING (r) LEFT JOIN kept USING (r)"""

_OP2 = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_ALNUM} AS w FROM documents),
items AS (SELECT item_id::VARCHAR AS i, {_ALNUM} AS w FROM benchmark),
pats AS (SELECT DISTINCT i, n, array_to_string(list_slice(w, p, p + n - 1), ' ') AS s
         FROM (SELECT i, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM pats),
wins AS (SELECT r, n, p, array_to_string(list_slice(w, p, p + n - 1), ' ') AS s
         FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM docs, sizes WHERE len(w) >= n)),
hits AS (SELECT r, wins.n, p, i FROM wins JOIN pats ON wins.n = pats.n AND wins.s = pats.s),
cover AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM hits) GROUP BY r),
found AS (SELECT r, count(DISTINCT i) AS n_items, string_agg(DISTINCT i, ',' ORDER BY i) AS ids FROM hits GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN cover USING (r) LEFT JOIN found USING (r)"""


def _secret_sql() -> str:
    kinds = (
        ("assign", 0, r"""((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
        ("access", 1, "AKIA[A-Z0-9]+", 0, 20),
        ("hex", 2, "[0-9a-f]+", 0, 24),
    )
    parts = []
    for kind, rank, pattern, group, least in kinds:
        # the text with each match marked off by a character that no text holds, then cut there
        parts.append(
            f"""SELECT r, '{kind}' AS kind, {rank} AS rank, sum(len(gap) + len(m)) OVER (PARTITION BY r ORDER BY k) AS e, len(m) AS n, len(j) >= {least} AS ok
            FROM (SELECT r, unnest(ms) AS m, unnest(js) AS j, unnest(range(1, len(ms) + 1)) AS k,
                         unnest(list_slice(string_split(regexp_replace(t, '{pattern}', chr(57344), 'g'), chr(57344)), 1, len(ms))) AS gap
                  FROM (SELECT r, t, regexp_extract_all(t, '{pattern}', 0) AS ms, regexp_extract_all(t, '{pattern}', {group}) AS js FROM docs) WHERE len(ms) > 0)"""
        )
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
spans AS (SELECT r, kind, rank, e - n AS s, e FROM ({" UNION ALL ".join(parts)}) WHERE ok),
found AS (SELECT r, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS x, count(*) FILTER (kind = 'assign') AS a,
                 count(*) FILTER (kind = 'access') AS c, count(*) FILTER (kind = 'hex') AS h FROM spans GROUP BY r)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(c, 0)::BIGINT AS n_access, coalesce(h, 0)::BIGINT AS n_hex,
       sha256(coalesce(x, '')) AS base_sha256, coalesce(x, '') AS spans FROM docs LEFT JOIN found USING (r)"""


def _url_sql() -> str:
    rules = " UNION ALL ".join(f"SELECT '{r.verdict}' AS v, '{r.host}' AS rh, '{r.path}' AS rp" for r in URL_RULES)
    listed = ", ".join(f"'{h}'" for h in LISTED_HOSTS)
    lower = "translate(regexp_extract(u, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH p AS (SELECT row_number() OVER () AS r, page_id, coalesce(url, '') AS u FROM pages),
parts AS (SELECT r, page_id, {lower} AS host, regexp_extract(u, '^.*?://([^/?#]*)([^?#]*)', 2, 's') AS path FROM p),
rules AS ({rules}),
fit AS (SELECT r, max_by(rh || rp, len(rh || rp)) AS rule, max_by(v, len(rh || rp)) AS v FROM parts, rules
        WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY r),
hosts AS (SELECT unnest([{listed}]) AS lh),
hit AS (SELECT DISTINCT r FROM parts, hosts WHERE host = lh OR ends_with(host, '.' || lh))
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN hit.r IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM parts LEFT JOIN fit USING (r) LEFT JOIN hit USING (r)"""


def _quality_sql() -> str:
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(quality.STOP_WORDS))
    tests = {
        "n_words": "n_words", "n_stop_words": "n_stop", "repeat_ratio": "n_repeat_words / greatest(n_words, 1)", "symbol_ratio": "n_symbols / greatest(word_chars, 1)",
        "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)", "mean_word": "word_chars / greatest(n_words, 1)",
    }
    failed = " OR ".join(f"{tests[t.measure]} {'<' if t.fails == 'below' else '>'} {t.limit}" for t in quality.THRESHOLDS)
    return rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {_WORDS} AS w,
                     list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
grams AS (SELECT r, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS p FROM docs WHERE len(w) >= 3)),
many AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, g) AS n FROM grams) WHERE n > 1),
cover AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest(range(p, p + 3)) AS q FROM many) GROUP BY r),
base AS (SELECT doc_id, len(w)::BIGINT AS n_words, len(array_to_string(w, ''))::BIGINT AS word_chars,
                len(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
                coalesce(n, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines, len(list_intersect(list_distinct(w), [{stop}])) AS n_stop
         FROM docs LEFT JOIN cover USING (r)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({failed}) AS kept FROM judged"""


def oracle_sql() -> dict[str, str]:
    """The queries that DuckDB can express; the others are tested against plain versions."""
    return {
        "op1_substring_dedup": _OP1,
        "op2_decontaminate": _OP2,
        "op4_secrets": _secret_sql(),
        "op7_url_filter": _url_sql(),
        "op9_quality": _quality_sql(),
    }
