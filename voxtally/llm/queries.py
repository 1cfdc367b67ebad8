"""The registered queries of this package, each over its whole table, and their reference SQL."""

from __future__ import annotations

import string

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import decontaminate
from .exact_dedup import exact_dedup
from .language import fold, identify_language, learn_dictionaries
from .line_dedup import line_dedup
from .near_dedup import near_dedup
from .packing import pack_tokens
from .preference import conversations, format_pairs, swapped_replies
from .resample import importance_resample
from .suffix_lm import suffix_lm
from .token_counts import token_counts
from .token_files import token_files
from .url_filter import TWO_LABEL_SUFFIXES, filter_urls
from .vector_codes import vector_codes

URL_RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
             ("block", "net/es/"), ("block", "net/fr/"))


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def op1_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup(read(spark, folder, "documents"), shingle=3, percent=85)


def op2_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every line of every document."""
    return token_counts(read(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                        public_tokenizers.PATTERN)


def op3_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files(read(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate(read(spark, folder, "documents"), read(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def op5_preference_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Spans as text ``start-stop,...``."""
    pairs = format_pairs(swapped_replies(conversations(read(spark, folder, "conversations"))))
    as_text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"], s["stop"])), ",")
    return pairs.withColumns({c: as_text(c) for c in ("chosen_spans", "rejected_spans")})


def op6_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup(read(spark, folder, "documents"))


def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Lengths in tokens."""
    return pack_tokens(read(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def page_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """Good or bad by page id: the label of the document with that number.

    Labels of one id are merged to the worst; an id without any value has none.
    """
    worst = read(spark, folder, "labels").groupBy(F.col("doc_id").alias("page_id")).agg(
        F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    known = F.col("quality").isNotNull() | F.col("toxic").isNotNull()
    good = (F.coalesce("quality", F.lit(1)) == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    return worst.select("page_id", F.when(known, good).alias("good"))


def op8_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return filter_urls(read(spark, folder, "pages"), page_outcomes(spark, folder), URL_RULES)


def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """The kept lines of every document and how many went."""
    return line_dedup(read(spark, folder, "documents").select("doc_id", "text"))


def op10_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text", "lang")
    held_out = fold(F.col("doc_id")) == 2
    model = learn_dictionaries(docs.filter(~held_out))
    found = identify_language(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op11_resample(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's weight towards ``benchmark`` by hashed words, its Gumbel score and its rank if drawn (10 %)."""
    return importance_resample(read(spark, folder, "documents"), read(spark, folder, "benchmark"),
                               longest=1, buckets=10_000, percent=10, least_words=20, seed="2024")


def op12_suffix_lm(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's log10 probability under a suffix tree learned from four folds of five, beside the unigram base."""
    return suffix_lm(read(spark, folder, "documents"), folds=5, held=1, depth=2, min_count=3, threshold=8.0)


def op13_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Product codes of every valid embedding: 8 parts, 16 entries, 6 rounds, components floor(4096 x)."""
    return vector_codes(read(spark, folder, "embeddings"), parts=8, entries=16, rounds=6, scale=4096)


QUERIES = {
    "op1_near_dedup": op1_near_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_token_files": op3_token_files,
    "op4_decontaminate": op4_decontaminate,
    "op5_preference_pairs": op5_preference_pairs,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_packing": op7_packing,
    "op8_url_filter": op8_url_filter,
    "op9_line_dedup": op9_line_dedup,
    "op10_language": op10_language,
    "op11_resample": op11_resample,
    "op12_suffix_lm": op12_suffix_lm,
    "op13_vector_codes": op13_vector_codes,
}

_LOWER = f"'{string.ascii_uppercase}', '{string.ascii_lowercase}'"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP4_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[s:s + least(10, len(w)) - 1], ' ') AS win
        FROM i, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS t(s) WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS win
       FROM d, lens, unnest(range(1, len(w) - n + 2)) AS t(s)),
h AS (SELECT doc_id, s, dw.n, item_id FROM dw JOIN win ON dw.n = win.n AND dw.win = win.win),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM h, unnest(range(s, s + n)) AS u(p) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words ON d.doc_id = words.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""

OP5_SQL = """
WITH talk AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn, role, text) AS c
              FROM (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
                    FROM conversations WHERE conv_id IS NOT NULL) GROUP BY conv_id),
pair AS (SELECT a.conv_id AS pair_id, a.c, a.c[1:len(a.c) - 1]
                || [{'role': a.c[-1].role, 'text': coalesce(b.c[-1].text, '')}] AS r
         FROM talk a LEFT JOIN talk b ON b.conv_id = xor(a.conv_id, 1)),
cut AS (SELECT pair_id, c, r, coalesce(list_position(list_transform(
            range(1, len(c) + 1), lambda k: c[k].role = r[k].role AND c[k].text = r[k].text), false) - 1, len(c)) AS n
        FROM pair),
part AS (SELECT pair_id, n, c[1:n] AS p, c[n + 1:] AS c, r[n + 1:] AS r FROM cut),
safe AS (SELECT pair_id, n, {0})
SELECT pair_id, CAST(n AS INTEGER) AS n_prompt_turns,
       array_to_string(list_transform(p, lambda t: t.h || t.b), '') AS prompt,
       array_to_string(list_transform(c, lambda t: t.h || t.b), '') AS chosen,
       {2} AS chosen_spans,
       array_to_string(list_transform(r, lambda t: t.h || t.b), '') AS rejected,
       {3} AS rejected_spans,
       len(list_filter(c, lambda t: t.role = 'assistant')) > 0 AND len(list_filter(r, lambda t: t.role = 'assistant')) > 0 AS usable
FROM safe
"""


def _op5_sql() -> str:
    shown = ", ".join(
        f"list_transform({s}, lambda t: {{'role': t.role, 'h': '<|' || replace(t.role, '<|', '< |') || '|>' || chr(10), "
        f"'b': replace(t.text, '<|', '< |') || '<|end|>' || chr(10)}}) AS {s}" for s in "pcr") + " FROM part"
    total = "coalesce(list_sum(list_transform({s}[1:k - {less}], lambda t: length(t.h) + length(t.b))), 0)"

    def spans(s: str) -> str:
        before, upto = total.format(s=s, less=1), total.format(s=s, less=0)
        return (f"array_to_string(list_transform(list_filter(range(1, len({s}) + 1), lambda k: {s}[k].role = 'assistant'), "
                f"lambda k: CAST(CAST({before} AS BIGINT) + length({s}[k].h) AS VARCHAR) || '-' || CAST(CAST({upto} AS BIGINT) AS VARCHAR)), ',')")

    return OP5_SQL.replace("{0}", shown).replace("{2}", spans("c")).replace("{3}", spans("r"))


OP6_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS body FROM documents),
g AS (SELECT body, count(*) AS group_size, first(doc_id ORDER BY n DESC, doc_id NULLS LAST) AS keep_id
      FROM d GROUP BY body)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(body) AS text_sha256
FROM d JOIN g USING (body)
"""


def _op8_sql() -> str:
    pairs = ", ".join(f"'{s}'" for s in TWO_LABEL_SUFFIXES)
    fits = []
    for verdict, rule in sorted(URL_RULES, key=lambda r: -len(r[1])):
        host, _, rest = rule.partition("/")
        fits.append((f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{rest}')", rule, verdict))
    case = lambda i: "CASE " + " ".join(f"WHEN {f[0]} THEN '{f[i]}'" for f in fits) + " END"

    def strength(table: str) -> str:
        rho = "((sum(k * k / n) - sum(k) * (sum(k) / sum(n)) - v * (count(*) - 1)) / (sum(n) - sum(n * n) / sum(n))) / v"
        rho = rho.replace("v", "(sum(k) / sum(n) * (1 - sum(k) / sum(n)))")
        return (f"SELECT least(1000, greatest(1, coalesce(CASE WHEN isfinite({rho}) THEN CASE WHEN {rho} <= 0 THEN 1000 "
                f"ELSE 1 / ({rho}) - 1 END END, 1000))) AS s FROM {table}")

    return f"""
WITH p AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS a
           FROM pages),
j AS (SELECT page_id, translate(regexp_extract(a, '^[^/?#]*'), {_LOWER}) AS host,
             regexp_extract(a, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
o AS (SELECT doc_id AS page_id, CASE WHEN coalesce(min(quality), 1) = 1 AND coalesce(max(toxic), 0) = 0 THEN 1 ELSE 0 END AS good
      FROM labels GROUP BY doc_id HAVING min(quality) IS NOT NULL OR max(toxic) IS NOT NULL),
h0 AS (SELECT host, CAST(count(good) AS DOUBLE) AS n, CAST(coalesce(sum(good), 0) AS DOUBLE) AS k,
              string_split(regexp_replace(host, ':\\d*$', ''), '.') AS l
       FROM j LEFT JOIN o USING (page_id) GROUP BY host),
h1 AS (SELECT host, n, k, l, CASE WHEN array_to_string(l[greatest(len(l) - 1, 1):], '.') IN ({pairs}) THEN 2 ELSE 1 END AS z FROM h0),
h AS (SELECT host, n, k, array_to_string(l[greatest(len(l) - z + 1, 1):], '.') AS suffix,
             array_to_string(l[greatest(len(l) - z, 1):], '.') AS domain FROM h1),
hl AS (SELECT * FROM h WHERE n > 0),
dl AS (SELECT domain, sum(n) AS n, sum(k) AS k FROM hl GROUP BY domain),
sl AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM hl GROUP BY suffix),
hs AS ({strength('hl')}), ds AS ({strength('dl')}), ss AS ({strength('sl')}),
g AS (SELECT coalesce(sum(k) / sum(n), 0.5) AS rate FROM hl),
m AS (SELECT host, h.n + hs.s AS t, (h.k + hs.s * ((coalesce(dl.k, 0) + ds.s * ((coalesce(sl.k, 0) + ss.s * rate)
             / (coalesce(sl.n, 0) + ss.s))) / (coalesce(dl.n, 0) + ds.s))) / (h.n + hs.s) AS mean
      FROM h LEFT JOIN dl USING (domain) LEFT JOIN sl USING (suffix), hs, ds, ss, g)
SELECT page_id, host, path, {case(1)} AS rule,
       coalesce({case(2)}, CASE WHEN mean + 1.645 * sqrt(mean * (1 - mean) / (t + 1)) < 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM j JOIN m USING (host)
"""


ORACLE = {
    "op4_decontaminate": OP4_SQL,
    "op5_preference_pairs": _op5_sql(),
    "op6_exact_dedup": OP6_SQL,
    "op8_url_filter": _op8_sql(),
}
