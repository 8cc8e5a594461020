"""The registered queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from antecede.llm.common import table
from antecede.llm.exact_dedup import exact_dedup
from antecede.llm.media import media_report
from antecede.llm.minhash import minhash_groups
from antecede.llm.mixing import mix
from antecede.llm.packing import pack
from antecede.llm.periodic_runs import periodic_runs, with_planted_runs
from antecede.llm.quality import classify
from antecede.llm.secret_scan import RULES, secret_report
from antecede.llm.simhash import simhash_groups
from antecede.llm.spelling import spelling_variants, without_some_letters
from antecede.llm.token_counts import count_tokens
from antecede.llm.token_store import stored_tokens
from antecede.llm.url_filter import captures_and_entries, filter_urls

WORDS, BYTES = "word_bpe_49k.json", "byte_bpe_50k.json"


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(WORDS))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(WORDS))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(*captures_and_entries(spark, sf_dir))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(table(spark, sf_dir, "documents"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_report(table(spark, sf_dir, "documents"))


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTES))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"), with_planted_runs)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"), rewrite=without_some_letters)


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_groups(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ours = (
        op1_token_counts, op2_best_fit_packing, op3_url_filter, op4_quality, op5_exact_dedup, op6_mix, op7_simhash, op8_secrets, op9_media, op10_token_store,
        op11_periodic_runs, op12_spelling_variants, op13_minhash,
    )
    return {f.__name__: f for f in ours}


def oracle_sql() -> dict[str, str]:
    return {"op3_url_filter": OP3, "op5_exact_dedup": OP5, "op6_mix": OP6, "op8_secrets": OP8}


OP5 = """
WITH keyed AS (
    SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents
), grouped AS (
    SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM keyed GROUP BY text_sha256
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM keyed JOIN grouped USING (text_sha256)
"""

#: Same sums in the same order as the operator's; the level is set by the first source that it doesn't lift to its cap.
OP6 = r"""
WITH sized AS (
    SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size,
           (('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
    FROM documents
), sources AS (
    SELECT source, sum(size)::BIGINT AS source_size,
           [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
    FROM sized GROUP BY source
), capped AS (
    SELECT *, source_size * 2.0::DOUBLE AS cap FROM sources
), levels AS (
    SELECT *, (sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
    FROM capped
), held AS (
    SELECT arg_min(level, cap / weight) AS held FROM levels WHERE level * weight < cap
), wanted AS (
    SELECT source, source_size, CASE WHEN held IS NULL OR held * weight >= cap THEN cap ELSE held * weight END AS target FROM levels CROSS JOIN held
), rated AS (
    SELECT *, CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0 END AS rate FROM wanted
), odds AS (
    SELECT *, floor(rate)::BIGINT AS whole, rate - floor(rate) AS part, target - floor(rate) * source_size AS rest FROM rated
), classes AS (
    SELECT s.source, length(bin(size)) AS class, sum(size)::BIGINT AS words, any_value(rest) AS rest
    FROM sized s JOIN odds o ON s.source IS NOT DISTINCT FROM o.source WHERE size > 0 AND part > 0 GROUP BY s.source, length(bin(size))
), tried AS (
    SELECT *, (rest - coalesce(sum(words) OVER (PARTITION BY source ORDER BY class DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
              / sum(class * words) OVER (PARTITION BY source ORDER BY class DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level
    FROM classes
), stopped AS (
    SELECT source AS held_source, max(class) AS held_class, arg_max(level, class) AS held_level FROM tried WHERE level * class < 1 GROUP BY source
), chances AS (
    SELECT source, class, CASE WHEN held_class IS NULL OR class > held_class THEN 1.0::DOUBLE ELSE held_level * class::DOUBLE END AS p
    FROM tried LEFT JOIN stopped ON source IS NOT DISTINCT FROM held_source
), ranked AS (
    SELECT s.*, source_size, target, whole, part, rest, CASE WHEN p >= 1 THEN 0 WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS rank
    FROM sized s JOIN odds o ON s.source IS NOT DISTINCT FROM o.source LEFT JOIN chances c ON s.source IS NOT DISTINCT FROM c.source AND length(bin(size)) = class
), running AS (
    SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rank NULLS FIRST, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM ranked
)
SELECT doc_id, source, size, source_size, target,
       whole + CASE WHEN part > 0 AND rank IS NOT NULL AND (upto <= rest OR upto - rest < rest - (upto - size)) THEN 1 ELSE 0 END AS copies,
       size * (whole + CASE WHEN part > 0 AND rank IS NOT NULL AND (upto <= rest OR upto - rest < rest - (upto - size)) THEN 1 ELSE 0 END) AS taken
FROM running
"""

OP3 = r"""
WITH stripped AS (
    SELECT page_id, url, regexp_replace(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://|[?#].*$', '', 'g') AS rest FROM pages
), parted AS (
    SELECT page_id, url, lower(regexp_replace(regexp_extract(rest, '^([^/]*)', 1), '^[^@]*@|:[0-9]*$|\.$', '', 'g')) AS host,
           regexp_replace(regexp_extract(rest, '^[^/]*(.*)$', 1), '/+$', '') AS path
    FROM stripped
), captures AS (
    SELECT row_number() OVER () AS tag, page_id, url, host, host || path AS bare, string_split(host, '.') AS labels,
           make_timestamp((1704067200 + ('0x' || substr(md5(url), 1, 8))::BIGINT % 525600 * 60) * 1000000) AS fetched_at
    FROM parted
), named AS (
    SELECT DISTINCT host AS pattern, 3 AS one_in FROM captures
    UNION SELECT DISTINCT array_to_string(labels[greatest(1, len(labels) - 1):], '.'), 6 FROM captures
    UNION SELECT DISTINCT bare, 20 FROM captures
), picked AS (
    SELECT DISTINCT pattern, ('0x' || substr(md5('day:' || pattern), 1, 8))::BIGINT AS n
    FROM named WHERE ('0x' || substr(md5('list:' || pattern), 1, 8))::BIGINT % one_in = 0
), entries AS (
    SELECT pattern, 'add' AS action, n % 200 AS d FROM picked
    UNION ALL SELECT pattern, 'remove', n % 200 + 60 FROM picked WHERE n % 2 = 0
    UNION ALL SELECT pattern, 'add', n % 200 + 120 FROM picked WHERE n % 4 = 0
), dated AS (
    SELECT pattern, action, make_timestamp((1704067200 + d * 86400) * 1000000) AS valid_from,
           lead(make_timestamp((1704067200 + d * 86400) * 1000000)) OVER (PARTITION BY pattern ORDER BY d) AS valid_to
    FROM entries
), asked AS (
    SELECT DISTINCT tag, page_id, url, fetched_at, pattern FROM (
        SELECT *, unnest(list_concat([host, bare], list_transform(range(2, len(labels) + 1), lambda k: array_to_string(labels[len(labels) - k + 1:], '.')))) AS pattern FROM captures
    )
), hits AS (
    SELECT a.tag, a.page_id, a.url, a.fetched_at, e.pattern, e.valid_from,
           row_number() OVER (PARTITION BY a.tag ORDER BY length(e.pattern) DESC NULLS LAST, e.pattern, e.valid_from) AS k, count(e.pattern) OVER (PARTITION BY a.tag) AS n_hits
    FROM asked a LEFT JOIN dated e ON a.pattern = e.pattern AND e.action = 'add' AND e.valid_from <= a.fetched_at AND (e.valid_to IS NULL OR a.fetched_at < e.valid_to)
)
SELECT page_id, url, fetched_at, n_hits > 0 AS blocked, n_hits, pattern, valid_from AS listed_since FROM hits WHERE k = 1
"""

#: Places come from what lies between the matches; one branch for each rule, as patterns must be constants.
OP8 = (
    r"""
WITH docs AS (
    SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS row_id FROM documents
), found AS ("""
    + " UNION ALL ".join(
        f"""
    SELECT row_id, {k} AS ord, '{r.kind}' AS kind, {r.least} AS least, hits, parts, gaps, unnest(range(1, len(hits) + 1)) AS i FROM (
        SELECT row_id, regexp_extract_all(text, '{(x := r.regex.replace("'", "''"))}', 0) AS hits, regexp_extract_all(text, '{x}', {r.group}) AS parts, string_split_regex(text, '{x}') AS gaps FROM docs
    )"""
        for k, r in enumerate(RULES)
    )
    + r"""
), placed AS (
    SELECT row_id, ord, kind, list_sum(list_transform(gaps[:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(hits[:i - 1], lambda x: length(x))), 0)::BIGINT AS start, length(hits[i]) AS size
    FROM found WHERE length(parts[i]) >= least
), joined AS (
    SELECT row_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
           string_agg(kind || ':' || start || ':' || (start + size), ',' ORDER BY start, ord) FILTER (WHERE ord < 3) AS base,
           string_agg(kind || ':' || start || ':' || (start + size), ',' ORDER BY start, ord) AS spans
    FROM placed GROUP BY row_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN joined USING (row_id)
"""
)
