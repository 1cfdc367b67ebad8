"""Reference SQL (DuckDB) for the catalogue, written independently of the
DataFrame code: tokens are unnested and counted with windows and groupings."""

from __future__ import annotations

import string

from ..functions import wordlists as L
from ..operators.lemmas import NOUN_RULES
from . import catalog as C

SP = r"\p{Z}\x{09}-\x{0D}\x{1C}-\x{1F}\x{85}"
WD = r"\p{L}\p{N}_"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def lst(words) -> str:
    return "[" + ", ".join(q(w) for w in words) + "]"


def tup(words) -> str:
    return "(" + ", ".join(q(w) for w in words) + ")"


def values(rows, name: str, columns: str) -> str:
    body = ", ".join("(" + ", ".join(q(v) if isinstance(v, str) else str(v) for v in row) + ")"
                     for row in rows)
    return f"{name}({columns}) AS (VALUES {body})"


def strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^[{SP}]+', ''), '[{SP}]+$', '')"


def count_sub(text: str, needle: str) -> str:
    return f"CAST((length({text}) - length(replace({text}, {needle}, ''))) // length({needle}) AS INTEGER)"


def rint(x: str, digits: int = 2) -> str:
    return f"round_even(({x}) * {float(10 ** digits)}, 0) / {float(10 ** digits)}"


def build() -> dict[str, str]:
    stop = lst(L.ENGLISH_STOP_WORDS)
    generic = tup(L.GENERIC_WORDS)
    docs = ("docs AS (SELECT doc_id AS response_id, text AS response_text, lang AS question_text, "
            "source AS sheet_name FROM documents)")

    def clean_list(x: str) -> str:
        return rf"regexp_extract_all(lower(coalesce({x}, '')), '[^\p{{P}}{SP}]+')"

    def kept_list(x: str) -> str:
        return f"list_filter({clean_list(x)}, lambda t: NOT list_contains({stop}, t))"

    def clean(x: str) -> str:
        return f"array_to_string({kept_list(x)}, ' ')"

    lemma_map = "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in C.LEMMAS.items()) + "}"

    def lemma(x: str) -> str:
        return (f"array_to_string(list_transform({kept_list(x)}, lambda t: "
                f"coalesce({lemma_map}[t], t)), ' ')")

    # word-set sentiment, one word per row
    def wordset(positive, negative) -> str:
        return f"""words AS (SELECT DISTINCT response_id,
            unnest(regexp_extract_all(lower(response_text), '[^{SP}]+')) AS w FROM docs),
        hits AS (SELECT response_id, count(*) FILTER (w IN {tup(positive)}) AS p,
            count(*) FILTER (w IN {tup(negative)}) AS n FROM words GROUP BY response_id),
        senti AS (SELECT d.response_id,
            CASE WHEN p > n THEN 0.5 WHEN n > p THEN -0.5 ELSE 0.0 END::DOUBLE AS sentiment_score,
            CASE WHEN p > n THEN 'positive' WHEN n > p THEN 'negative' ELSE 'neutral' END
                AS sentiment_label
            FROM docs d LEFT JOIN hits USING (response_id))"""

    custom = wordset(C.CUSTOM_POSITIVE, C.CUSTOM_NEGATIVE)

    # whole-word matches by regular expression
    def matching(name: str, rows, docs_name: str = "docs") -> str:
        keywords = values([(i, k.strip(), k.strip().lower()) for i, k in enumerate(rows)],
                          f"{name}_kw", "pos, spelled, kw")
        return f"{keywords}, {regex_match(name, f'{name}_kw', docs_name)}"

    def regex_match(name: str, kw_table: str, docs_name: str = "docs") -> str:
        return rf"""{name}_re AS (SELECT *,
            CASE WHEN regexp_matches(kw, '^[{WD}]') THEN '(^|[^{WD}])' ELSE '[{WD}]' END
            || regexp_escape(kw) ||
            CASE WHEN regexp_matches(kw, '[{WD}]$') THEN '($|[^{WD}])' ELSE '[{WD}]' END AS re
            FROM {kw_table}),
        {name} AS (SELECT d.response_id, k.pos, k.kw, k.spelled FROM {docs_name} d
            JOIN {name}_re k ON contains(lower(d.response_text), k.kw)
            WHERE regexp_matches(lower(d.response_text), k.re))"""

    vocab = matching("voc", C.VOCABULARY)

    # RAKE: gaps and islands over tokens
    rake_from = lambda source: rf"""
        tok AS (SELECT response_id, u.tok, u.pos FROM {source},
            unnest(regexp_extract_all(lower(response_text),
                '[{WD}]+|[^{WD}{SP}]+|[\r\n]+')) WITH ORDINALITY AS u(tok, pos)),
        flagged AS (SELECT *, (NOT regexp_matches(tok, '^[{WD}]') OR list_contains({stop}, tok))
            AS brk FROM tok),
        isl AS (SELECT *, sum(brk::INT) OVER (PARTITION BY response_id ORDER BY pos) AS island
            FROM flagged),
        content AS (SELECT response_id, island, tok, pos,
            count(*) OVER (PARTITION BY response_id, island) AS n FROM isl WHERE NOT brk),
        ratio AS (SELECT *, sum(n) OVER (PARTITION BY response_id, tok)
            / count(*) OVER (PARTITION BY response_id, tok) AS r FROM content),
        phr AS (SELECT response_id, island, string_agg(tok, ' ' ORDER BY pos) AS phrase,
            round(sum(r), 6) AS score FROM ratio GROUP BY response_id, island),
        scored AS (SELECT DISTINCT response_id, phrase, score FROM phr)"""
    rake = rake_from("docs")
    topk = f"""usable AS (SELECT s.*, lower({strip('d.response_text')}) AS t
            FROM scored s JOIN docs d USING (response_id) WHERE phrase NOT IN {generic}),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY response_id
            ORDER BY score DESC, phrase DESC) AS rk FROM usable
            WHERE contains(t, phrase) AND length(t) >= 3),
        bag AS (SELECT response_id, (rk - 1)::INTEGER AS rank, phrase AS keyword,
            {count_sub('t', 'phrase')} AS count FROM ranked WHERE rk <= 5)"""
    boosted = f"""{vocab},
        merged AS (SELECT response_id, keyword, count, rank AS ord FROM bag
            UNION ALL SELECT response_id, kw, 1, 1000 + pos FROM voc),
        summed AS (SELECT response_id, keyword, sum(count)::INTEGER AS count, min(ord) AS ord
            FROM merged GROUP BY response_id, keyword),
        vbag AS (SELECT response_id, (row_number() OVER (PARTITION BY response_id ORDER BY ord)
            - 1)::INTEGER AS rank, keyword, count FROM summed)"""

    # rule-based compound score over windows of neighbouring tokens
    lex = values(C.LEXICON, "lex", "term, valence")
    boosters, dampeners = C.RULES["boosters"], C.RULES["dampeners"]
    idioms = values(list(C.RULES["idioms"].items()), "idiom", "gram, value")
    punct = r"!-/:-@\[-`{-~"

    def gram(*cols: str) -> str:
        return f"concat_ws(' ', {', '.join(cols)})"

    def idiom(*cols: str) -> str:
        return f"(SELECT value FROM idiom WHERE gram = {gram(*cols)})"

    def neg(c: str) -> str:
        return f"coalesce({c} IN {tup(C.RULES['negations'])} OR contains({c}, 'n''t'), FALSE)"

    def push(c: str) -> str:
        return (f"CASE WHEN {c} IN {tup(boosters)} THEN {L.BOOST} "
                f"WHEN {c} IN {tup(dampeners)} THEN {L.DAMPEN} ELSE 0.0 END")

    def step(n: int, source: str, scale: float, factor: str) -> str:
        p, raw = f"l{n}", f"w{n}"
        loud = (f"CASE WHEN {push(p)} <> 0 AND {raw} = upper({raw}) AND {raw} <> lower({raw}) AND cap "
                f"THEN CASE WHEN v > 0 THEN {L.CAPS_BOOST} ELSE -{L.CAPS_BOOST} END ELSE 0.0 END")
        return f"""s{n} AS (SELECT * REPLACE (CASE WHEN {p} IS NOT NULL AND NOT k{n} THEN
            (v + (({push(p)}) * CASE WHEN v < 0 THEN -1 ELSE 1 END + {loud}) * {scale}) * ({factor})
            ELSE v END AS v) FROM {source})"""

    flip = lambda c: f"CASE WHEN {neg(c)} THEN {L.NEGATION_SCALE} ELSE 1.0 END"
    so = lambda c: f"coalesce({c} IN ('so', 'this'), FALSE)"
    two = (f"CASE WHEN l2 = 'never' AND {so('l1')} THEN 1.25 WHEN l2 = 'without' AND l1 = 'doubt' "
           f"THEN 1.0 ELSE {flip('l2')} END")
    three = (f"CASE WHEN l3 = 'never' AND ({so('l2')} OR {so('l1')}) THEN 1.25 WHEN l3 = 'without' "
             f"AND (coalesce(l2 = 'doubt', FALSE) OR coalesce(l1 = 'doubt', FALSE)) THEN 1.0 "
             f"ELSE {flip('l3')} END")
    degree = tup([b for b in [*boosters, *dampeners] if " " not in b])
    lexicon = rf"""{docs}, {lex}, {idioms},
        raw AS (SELECT response_id, u.t, u.i FROM docs,
            unnest(regexp_extract_all(response_text, '[^{SP}]+')) WITH ORDINALITY AS u(t, i)),
        bare AS (SELECT response_id, i, CASE WHEN length(b) > 2 THEN b ELSE t END AS w FROM (
            SELECT *, regexp_replace(regexp_replace(t, '^[{punct}]+', ''), '[{punct}]+$', '') AS b
            FROM raw)),
        low AS (SELECT *, lower(w) AS l, (upper(w) = w AND lower(w) <> w) AS up FROM bare),
        doc AS (SELECT response_id, count(*) FILTER (up) AS n_up, count(*) AS n,
            min(i) FILTER (l = 'but') AS but FROM low GROUP BY response_id),
        ctx AS (SELECT response_id, i, w, l, up, lag(w, 1) OVER o AS w1, lag(w, 2) OVER o AS w2,
            lag(w, 3) OVER o AS w3, lag(l, 1) OVER o AS l1, lag(l, 2) OVER o AS l2,
            lag(l, 3) OVER o AS l3, lead(l, 1) OVER o AS n1, lead(l, 2) OVER o AS n2
            FROM low WINDOW o AS (PARTITION BY response_id ORDER BY i)),
        s0 AS (SELECT c.*, d.but, (d.n_up > 0 AND d.n_up < d.n) AS cap,
            coalesce(l1 IN (SELECT term FROM lex), FALSE) AS k1,
            coalesce(l2 IN (SELECT term FROM lex), FALSE) AS k2,
            coalesce(l3 IN (SELECT term FROM lex), FALSE) AS k3,
            (CASE WHEN coalesce(l1 = 'no', FALSE) OR coalesce(l2 = 'no', FALSE)
                OR (coalesce(l3 = 'no', FALSE) AND coalesce(l1 IN ('or', 'nor'), FALSE))
                THEN valence * {L.NEGATION_SCALE}
                WHEN l = 'no' AND coalesce(n1 IN (SELECT term FROM lex), FALSE) THEN 0.0
                ELSE valence END)::DOUBLE AS v
            FROM ctx c JOIN lex ON l = term JOIN doc d USING (response_id)
            WHERE l NOT IN {degree} AND NOT (l = 'kind' AND coalesce(n1 = 'of', FALSE))),
        sc AS (SELECT * REPLACE (v + CASE WHEN up AND cap THEN
            CASE WHEN v > 0 THEN {L.CAPS_BOOST} ELSE -{L.CAPS_BOOST} END ELSE 0.0 END AS v) FROM s0),
        {step(1, 'sc', 1.0, flip('l1'))},
        {step(2, 's1', 0.95, two)},
        {step(3, 's2', 0.9, three)},
        s4 AS (SELECT * REPLACE (CASE WHEN l3 IS NOT NULL AND NOT k3 THEN
            coalesce({idiom('l', 'n1', 'n2')}, {idiom('l', 'n1')}, {idiom('l1', 'l')},
                {idiom('l2', 'l1', 'l')}, {idiom('l2', 'l1')}, {idiom('l3', 'l2', 'l1')},
                {idiom('l3', 'l2')}, v)
            + {push(gram('l3', 'l2', 'l1'))} + {push(gram('l3', 'l2'))} + {push(gram('l2', 'l1'))}
            ELSE v END AS v) FROM s3),
        s5 AS (SELECT response_id, v * CASE WHEN coalesce(l1 = 'least', FALSE) AND NOT k1
                AND NOT coalesce(l2 IN ('at', 'very'), FALSE) THEN {L.NEGATION_SCALE} ELSE 1.0 END
            * CASE WHEN but IS NULL THEN 1.0 WHEN i < but THEN 0.5 WHEN i > but THEN 1.5 ELSE 1.0 END
            AS v FROM s4),
        tot AS (SELECT response_id, sum(round(v, 9)) AS s FROM s5 GROUP BY response_id),
        emph AS (SELECT response_id,
            least(length(response_text) - length(replace(response_text, '!', '')), 4) * 0.292 AS bang,
            length(response_text) - length(replace(response_text, '?', '')) AS marks FROM docs),
        lifted AS (SELECT d.response_id, coalesce(s, 0.0) + sign(coalesce(s, 0.0)) * (bang +
            CASE WHEN marks <= 1 THEN 0.0 WHEN marks <= 3 THEN marks * 0.18 ELSE 0.96 END) AS x
            FROM docs d JOIN emph USING (response_id) LEFT JOIN tot USING (response_id)),
        senti AS (SELECT response_id, round((x / sqrt(x * x + {L.NORMALISER}))::DOUBLE, 4)
            AS sentiment_score FROM lifted),
        lexs AS (SELECT *, CASE WHEN sentiment_score >= 0.05 THEN 'positive'
            WHEN sentiment_score <= -0.05 THEN 'negative' ELSE 'neutral' END AS sentiment_label
            FROM senti)"""

    # TF-IDF
    tfidf = rf"""{docs},
        valid AS (SELECT * FROM docs WHERE regexp_matches(response_text, '[^{SP}]')),
        nn AS (SELECT count(*) AS n FROM valid),
        tk AS (SELECT response_id, u.t, u.i FROM valid,
            unnest(regexp_extract_all(lower(response_text), '[{WD}]{{2,}}'))
            WITH ORDINALITY AS u(t, i) WHERE NOT list_contains({stop}, u.t)),
        terms AS (SELECT response_id, t AS term FROM tk UNION ALL
            SELECT response_id, t || ' ' || nxt FROM (SELECT response_id, t,
                lead(t) OVER (PARTITION BY response_id ORDER BY i) AS nxt FROM tk)
            WHERE nxt IS NOT NULL),
        tf AS (SELECT response_id, term, count(*) AS tf FROM terms GROUP BY ALL),
        df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
        idf AS (SELECT term, df, ln((1.0 + n) / (1.0 + df)) + 1.0 AS idf FROM df, nn
            WHERE df >= 10 AND df <= 0.85 * n),
        raw_w AS (SELECT response_id, term, tf, tf * idf AS w FROM tf JOIN idf USING (term)),
        weights AS (SELECT response_id, term, tf::INTEGER AS tf,
            w / sqrt(sum(w * w) OVER (PARTITION BY response_id)) AS weight FROM raw_w)"""
    topic_terms = rf"""{tfidf},
        ts AS (SELECT term, round(sum(weight), 6) AS score FROM weights GROUP BY term),
        cand AS (SELECT * FROM ts WHERE length(term) >= 5 AND NOT list_contains({stop}, term)
            AND term NOT IN {generic} AND NOT regexp_matches(replace(term, ' ', ''), '^\p{{Nd}}+$')),
        common AS (SELECT term FROM cand JOIN valid ON contains(lower(response_text), term)
            GROUP BY term HAVING count(*) > 0.30 * (SELECT n FROM nn)),
        inferred AS (SELECT row_number() OVER (ORDER BY score DESC, term) AS pos, term AS topic
            FROM cand WHERE term NOT IN (SELECT term FROM common)
            ORDER BY score DESC, term LIMIT 15)"""
    universe = f"""{topic_terms},
        {values(list(enumerate(C.PROVIDED_TOPICS)), 'provided', 'pos, topic')},
        universe AS (SELECT row_number() OVER (ORDER BY o, pos) AS pos, topic, origin FROM (
            SELECT 0 AS o, pos, topic, 'provided' AS origin FROM provided UNION ALL
            SELECT 1, pos, topic, 'inferred' FROM inferred
            WHERE lower(topic) NOT IN (SELECT lower(topic) FROM provided)))"""
    tagged = f"""{universe}, ukw AS (SELECT pos, topic AS spelled, lower(topic) AS kw FROM universe),
        {regex_match('hit', 'ukw')}"""
    provided = matching("hit", C.PROVIDED_TOPICS)

    seen = """qid AS (SELECT question_text, row_number() OVER (ORDER BY min(response_id))::INTEGER
            AS question_id FROM docs GROUP BY question_text),
        sid AS (SELECT sheet_name, row_number() OVER (ORDER BY min(response_id))::INTEGER
            AS survey_id FROM docs GROUP BY sheet_name)"""
    lengths = f"""lens AS (SELECT response_id, length(response_text)::INTEGER AS response_length,
            len({kept_list('response_text')})::INTEGER AS word_count FROM docs)"""
    base = f"""{docs}, {custom}, {lengths},
        full_r AS (SELECT * FROM docs JOIN senti USING (response_id) JOIN lens USING (response_id))"""

    def stats(keys: str) -> str:
        return f"""SELECT {keys}, count(*) AS total_responses,
            {rint('avg(response_length)')} AS avg_response_length,
            {rint('avg(word_count)')} AS avg_word_count,
            {rint('avg(sentiment_score)')} AS avg_sentiment_score,
            {rint('stddev_samp(sentiment_score)')} AS sentiment_std,
            count(*) FILTER (sentiment_label = 'positive') AS positive_responses,
            count(*) FILTER (sentiment_label = 'negative') AS negative_responses,
            count(*) FILTER (sentiment_label = 'neutral') AS neutral_responses
            FROM full_r"""

    sources = """src AS (SELECT question_text, string_agg(sheet_name, ', ' ORDER BY f)
            AS survey_sources FROM (SELECT question_text, sheet_name, min(response_id) AS f
            FROM docs GROUP BY ALL) GROUP BY question_text)"""
    bags = f"{base}, {rake}, {topk}, {boosted}"
    qkw = """qkw AS (SELECT question_text, keyword, sum(count)::BIGINT AS frequency,
            min(response_id * 100000 + rank) AS seen FROM vbag JOIN docs USING (response_id)
            GROUP BY question_text, keyword)"""
    pool = f"""{docs}, {rake}, {topk}, {vocab},
        tot AS (SELECT keyword, sum(count)::BIGINT AS frequency, min(response_id * 100000 + rank) AS seen
            FROM bag GROUP BY keyword),
        vdf AS (SELECT kw, count(DISTINCT response_id) AS frequency, min(pos) AS seen FROM voc GROUP BY kw),
        pool AS (SELECT keyword, frequency, 0 AS late, seen FROM tot
            UNION ALL SELECT kw, frequency, 1, seen FROM vdf
            WHERE kw NOT IN (SELECT lower(keyword) FROM tot))"""
    contract = """t AS (SELECT d.doc_id, quality, toxic, lang, source,
            CASE WHEN toxic IS NOT NULL THEN lang END AS question_text,
            CASE WHEN lang <> 'fr' THEN CASE WHEN quality = 0 THEN ' ' ELSE text END END
                AS response_text,
            CASE WHEN quality = 1 THEN source END AS survey_source,
            CASE WHEN toxic = 0 THEN source END AS email
            FROM documents d LEFT JOIN labels l USING (doc_id))"""
    empty = f"response_text IS NOT NULL AND NOT regexp_matches(response_text, '[^{SP}]')"
    long_part = """long AS (SELECT p_partkey, 0 AS col_pos, 'p_name' AS question_text,
            p_name AS response_text FROM part UNION ALL
        SELECT p_partkey, 1, 'p_brand', p_brand FROM part UNION ALL
        SELECT p_partkey, 2, 'p_type', p_type FROM part),
        kept AS (SELECT p_partkey, col_pos, question_text, trim(response_text) AS response_text
            FROM long WHERE trim(response_text) <> '')"""
    bench = r"""cells AS (SELECT item_id AS pos, text || ' (note ' || item_id ||
            '), Career; jobs etc., AI??; ai' AS raw,
            CASE WHEN item_id % 3 > 0 THEN 'cat' || (item_id % 3) END AS category FROM benchmark)"""
    parts = rf"""parts AS (SELECT pos, category, u.i, u.kw FROM cells,
            unnest(regexp_split_to_array({strip('raw')}, '[,;][{SP}]*')) WITH ORDINALITY AS u(kw, i))"""
    notes = strip("regexp_replace(" + strip("regexp_replace(" + strip(
        rf"regexp_replace({strip('kw')}, '\([^\n]*?\)', '', 'g')")
        + rf", '(^|[^{WD}])etc\.?[{SP}]*$', '\1')") + rf", '\?\?+[{SP}]*$', '')")

    def dedup(expr: str) -> str:
        return f"""named AS (SELECT pos, i, category, {expr} AS keyword FROM parts),
        firsts AS (SELECT *, row_number() OVER (PARTITION BY lower(keyword) ORDER BY pos, i) AS rn
            FROM named WHERE keyword <> ''),
        vocab_t AS (SELECT row_number() OVER (ORDER BY pos, i) AS pos, keyword,
            lower(keyword) AS norm, category FROM firsts WHERE rn = 1)"""

    centroid = """un AS (SELECT label, unnest(embedding)::DOUBLE AS x,
            unnest(range(len(embedding)))::INTEGER AS dim FROM embeddings),
        cd AS (SELECT label, dim, avg(x) AS x FROM un GROUP BY label, dim),
        cen AS (SELECT label, list(x ORDER BY dim) AS vec FROM cd GROUP BY label),
        sims AS (SELECT vec_id, e.label AS own, c.label,
            list_cosine_similarity(embedding::DOUBLE[], vec) AS sim FROM embeddings e, cen c),
        best AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(sim, 12) DESC, label)
            AS rn FROM sims)"""

    out: dict[str, str] = {}
    out["scan_csv_long"] = rf"""SELECT question_text, response_text, count(*) AS n FROM (
        SELECT 'Your answer, please' AS question_text, {strip('text')} AS response_text FROM documents
        UNION ALL SELECT 'lang', {strip('lang')} FROM documents) WHERE response_text <> ''
        GROUP BY ALL"""
    out["csv_sink"] = "SELECT doc_id, text, lang FROM documents"
    out["csv_one_file_split"] = out["csv_sink"]
    out["wide_variant_load"] = """SELECT doc_id, text, CASE WHEN doc_id % 2 = 0 THEN lang END AS lang,
        CASE WHEN doc_id % 2 = 1 THEN source END AS source FROM documents"""
    listed = ", ".join(f"('{w}')" for w in C.NOUN_INDEX)
    irregular = ", ".join(f"('{f}', {p}, '{w}')" for f, p, w in C.NOUN_EXCEPTIONS)
    rules = ", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(NOUN_RULES))
    out["noun_lemmas"] = f"""WITH RECURSIVE
        w AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}',
            '{string.ascii_lowercase}'), '[a-z]+')) AS word FROM documents),
        counts AS (SELECT word, count(*) AS n FROM w GROUP BY word),
        idx AS (SELECT word AS form FROM counts WHERE n >= 3 AND NOT suffix(word, 's')
                UNION SELECT form FROM (VALUES {listed}) v(form)),
        exc(word, pos, form) AS (VALUES {irregular}),
        rules(i, old, new) AS (VALUES {rules}),
        irr AS (SELECT word FROM counts WHERE word IN (SELECT word FROM exc)),
        cand AS (SELECT word, [-1] AS path, word AS form FROM irr
                 UNION ALL SELECT e.word, [e.pos], e.form FROM exc e JOIN irr USING (word)),
        irr_lemma AS (SELECT word, form AS lemma FROM (SELECT *, row_number() OVER (
            PARTITION BY word ORDER BY length(form), path) AS rn FROM cand WHERE form IN (SELECT form FROM idx)) WHERE rn = 1),
        f(word, r, path, form) AS (
            SELECT word, 1, [i], left(word, length(word) - length(old)) || new FROM counts, rules
            WHERE suffix(word, old) AND word NOT IN (SELECT word FROM exc)
            UNION ALL
            SELECT f.word, f.r + 1, list_append(f.path, i), left(f.form, length(f.form) - length(old)) || new
            FROM f, rules WHERE suffix(f.form, old)),
        levels AS (SELECT word, 1 AS r, [-1] AS path, word AS form FROM counts WHERE word NOT IN (SELECT word FROM exc)
                   UNION ALL SELECT word, r, path, form FROM f),
        reg_lemma AS (SELECT word, form AS lemma FROM (SELECT *, row_number() OVER (
            PARTITION BY word ORDER BY r, length(form), path) AS rn FROM levels WHERE form IN (SELECT form FROM idx))
            WHERE rn = 1)
        SELECT c.word, coalesce(l.lemma, c.word) AS lemma, c.n FROM counts c
        LEFT JOIN (SELECT * FROM irr_lemma UNION ALL SELECT * FROM reg_lemma) l USING (word)"""
    cells = [("part", "p_partkey", c) for c in ("p_name", "p_brand", "p_type", "p_size")] + [
        ("supplier", "s_suppkey", c) for c in ("s_name", "s_nationkey")] + [
        ("documents", "doc_id", c) for c in ("lang", "source", "n_chars")]
    out["workbook_by_sheet"] = "\nUNION ALL ".join(
        f"SELECT '{t}' AS tbl, {k}::VARCHAR AS key, '{c}' AS header, {c}::VARCHAR AS value FROM {t} WHERE {c} IS NOT NULL"
        for t, k, c in cells)
    out["scan_csv_split"] = out["scan_csv_long"]
    out["unpivot_long"] = f"""WITH {long_part} SELECT p_partkey, col_pos, question_text, response_text FROM kept
        UNION ALL SELECT p_partkey, 3, 'p_size', p_size::VARCHAR FROM part WHERE p_size IS NOT NULL
        UNION ALL SELECT p_partkey, 4, 'p_retailprice', p_retailprice::VARCHAR FROM part WHERE p_retailprice IS NOT NULL"""
    out["detect_text_columns_exact"] = """SELECT coalesce(bool_or(coalesce(regexp_matches(doc_id::VARCHAR, '[A-Za-z]'), TRUE)), FALSE) AS doc_id,
        coalesce(bool_or(coalesce(regexp_matches(text, '[A-Za-z]'), TRUE)), FALSE) AS text,
        coalesce(bool_or(coalesce(regexp_matches(source, '[A-Za-z]'), TRUE)), FALSE) AS timestamp,
        coalesce(bool_or(coalesce(regexp_matches(n_chars::VARCHAR, '[A-Za-z]'), TRUE)), FALSE) AS n_chars,
        coalesce(bool_or(coalesce(regexp_matches(quality::VARCHAR, '[A-Za-z]'), TRUE)), FALSE) AS quality,
        coalesce(bool_or(coalesce(regexp_matches(toxic::VARCHAR, '[A-Za-z]'), TRUE)), FALSE) AS toxic
        FROM documents LEFT JOIN labels USING (doc_id)"""
    out["validate_failing"] = """SELECT 'required_column' AS "check", 'question_text' AS "column", 'error' AS severity, 1::BIGINT AS n
        UNION ALL SELECT 'id_type', 'question_id', 'error', 1
        UNION ALL SELECT 'timestamp', 'Timestamp', 'error', count(*) FROM documents WHERE doc_id % 2 = 0"""
    out["response_ids"] = f"""WITH {long_part} SELECT *,
        row_number() OVER (ORDER BY col_pos, p_partkey) AS response_id FROM kept"""
    out["first_seen_ids"] = """WITH f AS (SELECT p_name, row_number() OVER (ORDER BY min(p_partkey))
        ::INTEGER AS question_id FROM part GROUP BY p_name)
        SELECT p_name, p_partkey, question_id FROM part JOIN f USING (p_name)"""
    skip = " OR ".join(f"contains(lower(source), {q(p.lower())})" for p in C.EXCLUDED_SHEETS)
    out["sheet_exclusion"] = f"SELECT doc_id, source AS sheet_name FROM documents WHERE NOT ({skip})"
    out["sheet_exclusion_exact"] = ("SELECT doc_id, source AS sheet_name FROM documents "
                                    f"WHERE source NOT IN {tup(C.EXCLUDED_SHEETS)}")
    out["wide_union"] = """SELECT 'part' AS sheet_name, p_name, p_brand, p_size FROM part
        UNION ALL BY NAME SELECT coalesce(s_name, '') AS s_name,
        coalesce(s_nationkey::VARCHAR, '') AS s_nationkey, 'supplier' AS sheet_name FROM supplier"""
    out["detect_text_columns"] = "SELECT " + ", ".join(
        f"coalesce(bool_or(regexp_matches({c}::VARCHAR, '[A-Za-z]')), FALSE) AS {c}"
        for c in ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")) + " FROM part"
    out["combine_row_text"] = """SELECT p_partkey, trim(concat_ws(' ', nullif(trim(p_name), ''),
        CASE WHEN p_size > 25 THEN nullif(trim(p_type), '') END, nullif(trim(p_brand), '')))
        AS combined FROM part"""
    out["meaningful_questions"] = """WITH t AS (SELECT conv_id || '#' || turn AS response_id,
        role || '-' || least(turn, 3) AS question_id, length(text)::INTEGER AS response_length
        FROM conversations) SELECT * FROM t WHERE question_id IN (SELECT question_id FROM t
        GROUP BY question_id HAVING avg(response_length) > 400)"""
    out["clean_text"] = (f"SELECT doc_id AS response_id, array_to_string({clean_list('text')}, ' ') "
                         "AS cleaned FROM documents")
    out["tokenize"] = f"""SELECT doc_id AS response_id, (u.i - 1)::INTEGER AS pos, u.t AS token
        FROM documents, unnest({clean_list('text')}) WITH ORDINALITY AS u(t, i)"""
    out["remove_stopwords"] = f"""SELECT doc_id AS response_id, {clean('text')} AS kept,
        len({kept_list('text')})::INTEGER AS n_kept FROM documents"""
    out["lemmatize"] = f"SELECT doc_id AS response_id, {lemma('text')} AS lemmas FROM documents"
    out["preprocess"] = f"""WITH {docs} SELECT response_id, {lemma('response_text')} AS response_text,
        {lemma('question_text')} AS question_text, sheet_name,
        question_text AS question_text_original, response_text AS response_text_original,
        length(response_text)::INTEGER AS response_length,
        len({kept_list('response_text')})::INTEGER AS word_count FROM docs"""
    out["preprocess_columns"] = f"""SELECT p_partkey, {clean('p_name')} AS p_name,
        {clean('p_brand')} AS p_brand, {clean('p_type')} AS p_type, p_size, p_retailprice FROM part"""
    out["text_lengths"] = f"WITH {docs}, {lengths} SELECT * FROM lens"
    out["phrase_counts"] = "SELECT doc_id AS response_id, " + ", ".join(
        f"{count_sub('lower(text)', q(p))} AS n{i}" for i, p in enumerate(C.PHRASES_COUNTED)
    ) + " FROM documents"
    for name, sets in (("sentiment_wordset", (L.POSITIVE_WORDS, L.NEGATIVE_WORDS)),
                       ("sentiment_wordset_custom", (C.CUSTOM_POSITIVE, C.CUSTOM_NEGATIVE))):
        out[name] = f"WITH {docs}, {wordset(*sets)} SELECT * FROM senti"
    out["sentiment_lexicon"] = (f"WITH {lexicon} SELECT response_id, sentiment_score, "
                                "sentiment_label FROM lexs")
    out["sentiment_distribution"] = f"""WITH {lexicon} SELECT sentiment_label, count(*) AS n,
        {rint('count(*) / sum(count(*)) OVER () * 100', 1)} AS percent FROM lexs GROUP BY 1"""
    out["sentiment_histogram"] = f"""WITH {lexicon} SELECT floor(sentiment_score / 0.25) * 0.25
        AS bucket, count(*) AS n FROM lexs GROUP BY 1"""
    out["rake_candidates"] = f"""WITH {docs}, {rake} SELECT response_id, phrase,
        (row_number() OVER (PARTITION BY response_id ORDER BY island) - 1)::INTEGER AS pos FROM phr"""
    out["rake_scores"] = f"WITH {docs}, {rake} SELECT response_id, phrase, score FROM scored"
    out["keyphrases_topk"] = f"WITH {docs}, {rake}, {topk} SELECT * FROM bag"
    out["keyphrases_memo"] = out["keyphrases_topk"]
    out["keyphrases_with_vocab"] = f"WITH {docs}, {rake}, {topk}, {boosted} SELECT * FROM vbag"
    combined = f"""docs AS (SELECT doc_id AS response_id,
        trim({strip('lang')} || ' ' || {strip('text')}) AS response_text FROM documents)"""
    out["keyphrases_simple"] = f"""WITH {combined}, {rake}, rk AS (SELECT *, row_number() OVER (
        PARTITION BY response_id ORDER BY score DESC, phrase DESC, island) AS r FROM phr
        WHERE length(phrase) >= 3)
        SELECT d.response_id, coalesce(string_agg(phrase, ', ' ORDER BY r), '') AS keywords
        FROM docs d LEFT JOIN (SELECT * FROM rk WHERE r <= 5) USING (response_id) GROUP BY 1"""
    out["frequent_tokens_topk"] = f"""WITH tk AS (SELECT doc_id AS response_id, u.t, u.i FROM documents,
        unnest({kept_list('text')}) WITH ORDINALITY AS u(t, i)
        WHERE length(u.t) > 2 AND u.t NOT IN {generic}),
        c AS (SELECT response_id, t, count(*)::INTEGER AS count, min(i) AS f FROM tk GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY response_id ORDER BY count DESC, f) AS rn FROM c)
        SELECT response_id, (rn - 1)::INTEGER AS rank, t AS keyword, count FROM r WHERE rn <= 5"""
    frequent = """tk AS (SELECT doc_id AS response_id, u.t, u.i FROM documents,
            unnest({0}) WITH ORDINALITY AS u(t, i) WHERE length(u.t) > 2 AND u.t NOT IN {1}),
        c AS (SELECT response_id, t, count(*)::INTEGER AS count, min(i) AS f FROM tk GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY response_id ORDER BY count DESC, f) AS rn FROM c)"""
    lemma_case = " ".join(f"WHEN t = {q(k)} THEN {q(v)}" for k, v in C.LEMMAS.items())
    lemmatised = f"list_transform({kept_list('text')}, lambda t: CASE {lemma_case} ELSE t END)"
    out["frequent_tokens_lemmas"] = f"""WITH {frequent.format(lemmatised, generic)}
        SELECT response_id, (rn - 1)::INTEGER AS rank, t AS keyword, count FROM r WHERE rn <= 5"""
    out["frequent_tokens_similar"] = f"""WITH {centroid}, {frequent.format(kept_list('text'), generic)},
        named AS (SELECT word, row_number() OVER (ORDER BY word) - 1 AS vec_id
            FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\\S+')) AS word FROM benchmark))
        SELECT response_id, (row_number() OVER (PARTITION BY response_id ORDER BY r.rn) - 1)::INTEGER AS rank,
        t AS keyword, count FROM r JOIN named ON t = word JOIN best USING (vec_id)
        WHERE r.rn <= 5 AND best.rn = 1 AND sim >= {L.SIMILARITY_THRESHOLD}"""
    out["keyword_json_roundtrip"] = f"""WITH {docs}, {rake}, {topk},
        packed AS (SELECT response_id, list({{'keyword': keyword, 'count': count}} ORDER BY rank) AS b
            FROM bag GROUP BY response_id)
        SELECT d.response_id, coalesce(to_json(b)::VARCHAR, '[]') AS json,
        coalesce(array_to_string(list_transform(b, lambda x: x.keyword), ', '), '') AS keys,
        coalesce(len(b), 0)::INTEGER AS n FROM docs d LEFT JOIN packed USING (response_id)"""
    out["vocab_parse"] = f"WITH {bench}, {parts}, {dedup(notes)} SELECT * FROM vocab_t"
    out["vocab_in_text"] = f"WITH {docs}, {vocab} SELECT DISTINCT response_id, kw AS keyword FROM voc"
    out["vocab_in_text_joined"] = f"""WITH {docs}, {bench}, {parts}, {dedup(strip('kw'))},
        vk AS (SELECT pos, keyword AS spelled, norm AS kw FROM vocab_t), {regex_match('voc', 'vk')}
        SELECT response_id, pos, kw AS keyword FROM voc"""
    out["vocab_present"] = f"WITH {docs}, {vocab} SELECT DISTINCT kw AS keyword FROM voc"
    out["vocab_doc_freq"] = f"""WITH {docs}, {vocab} SELECT kw AS keyword,
        count(DISTINCT response_id) AS doc_freq FROM voc GROUP BY kw"""
    out["vector_normalize"] = """WITH u AS (SELECT vec_id, embedding, unnest(embedding)::DOUBLE AS x,
        unnest(range(len(embedding)))::INTEGER AS dim FROM embeddings)
        SELECT vec_id, dim, round(x / (sqrt(sum(x * x) OVER (PARTITION BY vec_id)) + 1e-10), 6) AS x
        FROM u"""
    out["vector_mean_pool"] = f"""WITH {centroid} SELECT 'label' || label AS keyword, dim,
        round(x, 6) AS x FROM cd"""
    out["text_mean_vectors"] = r"""WITH named AS (SELECT word, row_number() OVER (ORDER BY word) - 1 AS vec_id
            FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\S+')) AS word FROM benchmark)),
        w AS (SELECT word, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding)))::INTEGER AS dim
            FROM named JOIN embeddings USING (vec_id)),
        t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\S+')) AS word FROM documents),
        m AS (SELECT doc_id, dim, avg(x) AS x FROM t JOIN w USING (word) GROUP BY ALL)
        SELECT doc_id, dim, round(x / (sqrt(sum(x * x) OVER (PARTITION BY doc_id)) + 1e-10), 6) AS x FROM m"""
    out["best_match"] = f"""WITH {centroid} SELECT vec_id, round(sim, 4) AS similarity,
        'label' || label AS closest FROM best WHERE rn = 1"""
    out["similar_filter"] = f"""WITH {centroid} SELECT vec_id, round(sim, 4) AS similarity
        FROM best WHERE rn = 1 AND sim >= {L.SIMILARITY_THRESHOLD}"""
    out["tfidf_weights"] = f"""WITH {tfidf} SELECT response_id, term, tf, round(weight, 6) AS weight
        FROM weights"""
    out["topic_terms"] = f"WITH {topic_terms} SELECT pos, topic FROM inferred"
    out["topic_universe"] = f"WITH {universe} SELECT * FROM universe"
    out["topic_assignments"] = f"WITH {tagged} SELECT response_id, spelled AS topic FROM hit"
    out["topics_column"] = f"""WITH {tagged} SELECT d.response_id,
        coalesce(string_agg(spelled, ', ' ORDER BY pos), '') AS topics
        FROM docs d LEFT JOIN hit USING (response_id) GROUP BY 1"""
    out["topic_counts"] = f"""WITH {tagged} SELECT spelled AS topic, count(*) AS responses
        FROM hit GROUP BY 1"""
    present = [t for t in C.PROVIDED_TOPICS if t != "data science"]
    out["topic_matrix"] = f"""WITH {docs}, {provided}, r AS (SELECT response_id, spelled,
        row_number() OVER (PARTITION BY spelled ORDER BY response_id) AS row_no FROM hit)
        SELECT row_no, """ + ", ".join(
        f"coalesce(max(response_id::VARCHAR) FILTER (spelled = {q(t)}), '') AS \"{t}\""
        for t in present) + " FROM r GROUP BY row_no"
    out["question_stats"] = (f"WITH {base} " + stats("question_text AS question_text_original")
                             + " GROUP BY question_text")
    out["survey_sources"] = f"WITH {docs}, {sources} SELECT * FROM src"
    out["question_keywords"] = f"""WITH {bags}, {qkw} SELECT question_text AS question_text_original,
        keyword, frequency FROM qkw"""
    out["summary_by_question"] = f"""WITH {bags}, {seen}, {sources}, {qkw},
        st AS ({stats('question_text')} GROUP BY question_text),
        best AS (SELECT *, row_number() OVER (PARTITION BY question_text
            ORDER BY frequency DESC, seen) AS r FROM qkw)
        SELECT question_id, st.*, survey_sources, coalesce(keyword, '') AS keyword,
        coalesce(frequency, 0) AS frequency FROM st JOIN src USING (question_text)
        JOIN qid USING (question_text)
        LEFT JOIN (SELECT question_text, keyword, frequency FROM best WHERE r <= 10)
        USING (question_text)"""
    out["keyword_pool"] = f"WITH {pool} SELECT keyword, frequency FROM pool"
    out["keyword_instances"] = f"""WITH {pool}, top AS (SELECT * FROM pool
        ORDER BY frequency DESC, late, seen LIMIT 200)
        SELECT keyword FROM top, range(frequency) AS g(i)"""
    out["keyword_instances_legacy"] = f"""WITH {bags}, good AS (SELECT question_text FROM full_r
        GROUP BY 1 HAVING avg(response_length) > 10),
        tot AS (SELECT keyword, sum(count)::BIGINT AS frequency, min(response_id * 100000 + rank) AS seen
            FROM vbag JOIN docs USING (response_id) SEMI JOIN good USING (question_text)
            GROUP BY keyword),
        top AS (SELECT * FROM tot ORDER BY frequency DESC, seen LIMIT 10)
        SELECT keyword FROM top, range(frequency) AS g(i)"""
    out["summary_profile"] = f"""WITH {bags}, {qkw}, best AS (SELECT *, row_number() OVER (
            PARTITION BY question_text ORDER BY frequency DESC, seen) AS r FROM qkw),
        per AS (SELECT d.question_text, greatest(count(DISTINCT keyword), 1) AS n
            FROM docs d LEFT JOIN (SELECT * FROM best WHERE r <= 10) USING (question_text) GROUP BY 1)
        SELECT sum(n)::BIGINT AS keyword_rows, count(*) AS questions,
        {rint('sum(n) / count(*)', 1)} AS keywords_per_question FROM per"""
    out["run_profile"] = f"""WITH {bags}, {provided},
        nb AS (SELECT response_id, count(*) AS n FROM vbag GROUP BY 1),
        nt AS (SELECT DISTINCT response_id, 1 AS tagged FROM hit)
        SELECT count(*) AS responses, count(DISTINCT question_text) AS questions,
        count(DISTINCT sheet_name) AS surveys, {rint('avg(response_length)', 1)} AS avg_response_length,
        {rint('avg(word_count)', 1)} AS avg_word_count, count(n) AS with_keywords,
        {rint('avg(CASE WHEN n IS NULL THEN 0.0 ELSE 100.0 END)', 1)} AS with_keywords_percent,
        count(tagged) AS with_topics
        FROM full_r LEFT JOIN nb USING (response_id) LEFT JOIN nt USING (response_id)"""
    out["responses_with_features"] = f"""WITH {tagged}, {custom}, {rake},
        {topk}, {boosted}, {seen},
        kws AS (SELECT response_id, string_agg(keyword, ', ' ORDER BY rank) AS k FROM vbag GROUP BY 1),
        tps AS (SELECT response_id, string_agg(spelled, ', ' ORDER BY pos) AS tp FROM hit GROUP BY 1)
        SELECT response_id, survey_id, question_id, response_text, sentiment_label, sentiment_score,
        coalesce(k, '') AS keywords, coalesce(tp, '') AS topics, coalesce(k, '') AS theme,
        question_text, sheet_name FROM docs JOIN senti USING (response_id)
        JOIN qid USING (question_text) JOIN sid USING (sheet_name)
        LEFT JOIN kws USING (response_id) LEFT JOIN tps USING (response_id)"""
    whole = rf"'^[{SP}]*[+-]?\d+[{SP}]*$'"
    out["validate_ids"] = f"""SELECT
        count(*) FILTER (NOT regexp_matches(event_id::VARCHAR, {whole})) AS bad_response_id,
        count(*) FILTER (NOT regexp_matches(event_type, {whole})) AS bad_survey_id,
        count(*) FILTER (NOT regexp_matches(json_extract_string(props, '$.k'), {whole}))
            AS bad_question_id FROM events"""
    out["validate_timestamp"] = """WITH t AS (SELECT CASE WHEN event_type = 'error' THEN event_type
        WHEN event_type <> 'view' THEN ts::VARCHAR END AS ts FROM events)
        SELECT count(*) AS total, count(ts) AS filled,
        count(*) FILTER (ts IS NOT NULL AND try_cast(ts AS TIMESTAMP) IS NULL) AS bad FROM t"""
    out["validate_content"] = f"""WITH {contract} SELECT count(*) AS total,
        count(*) FILTER (question_text IS NULL) AS missing_question_text,
        count(*) FILTER (response_text IS NULL) AS missing_response_text,
        count(*) FILTER ({empty}) AS empty_response_text, count(email) AS with_email FROM t"""
    out["source_distribution"] = f"""WITH {contract} SELECT survey_source, count(*) AS n FROM t
        GROUP BY survey_source"""
    out["validate_report"] = f"""WITH {contract} SELECT 'id_type' AS "check", 'question_id' AS "column",
        'warn' AS severity, 1::BIGINT AS n
        UNION ALL SELECT 'missing', 'question_text', 'warn', count(*) FROM t
            WHERE question_text IS NULL HAVING count(*) > 0
        UNION ALL SELECT 'missing', 'response_text', 'warn', count(*) FROM t
            WHERE response_text IS NULL HAVING count(*) > 0
        UNION ALL SELECT 'empty', 'response_text', 'warn', count(*) FROM t
            WHERE {empty} HAVING count(*) > 0
        UNION ALL SELECT 'coverage', 'email', 'info', count(email) FROM t"""
    out["response_detail"] = f"""WITH {base} SELECT response_id, question_text AS question_text_original,
        sentiment_score FROM full_r WHERE sentiment_label = 'negative'"""
    out["length_vs_sentiment"] = f"WITH {base} SELECT response_id, word_count, sentiment_score FROM full_r"
    out["questions_by_sentiment"] = f"""WITH {base}, {seen}, st AS ({stats('question_text')} GROUP BY 1)
        SELECT question_id, question_text AS question_text_original, avg_sentiment_score,
        rank() OVER (ORDER BY avg_sentiment_score DESC) AS rank FROM st JOIN qid USING (question_text)"""
    out["top_questions"] = f"""WITH {docs}, {seen} SELECT question_id, question_text
        AS question_text_original, count(*) AS total_responses FROM docs JOIN qid USING (question_text)
        GROUP BY ALL ORDER BY total_responses DESC, question_id LIMIT 3"""
    out["keyword_min_frequency"] = f"""WITH {bags}, {qkw} SELECT keyword,
        sum(frequency)::BIGINT AS frequency, count(*) AS questions FROM qkw GROUP BY keyword
        HAVING sum(frequency) >= 5"""
    out["filter_by_topic"] = f"""WITH {bags}, {provided}, tps AS (SELECT response_id,
            string_agg(spelled, ', ' ORDER BY pos) AS topics, bool_or(spelled = 'Thing') AS ok
            FROM hit GROUP BY 1)
        SELECT response_id, sheet_name, topics FROM docs JOIN tps USING (response_id)
        WHERE ok AND contains(lower(question_text), 'e') AND response_id IN (
            SELECT response_id FROM vbag WHERE keyword = 'the')"""
    out["responses_over_time"] = """SELECT date_trunc('day', ts)::TIMESTAMP AS window_start,
        count(*) AS n FROM events GROUP BY 1"""
    out["responses_join_summary"] = f"""WITH {base}, {seen}, st AS ({stats('question_text')} GROUP BY 1)
        SELECT response_id, question_id, sentiment_label, st.* EXCLUDE (question_text)
        FROM full_r JOIN st USING (question_text) JOIN qid USING (question_text)"""
    out["sentiment_lexicon_table"] = out["sentiment_lexicon"]
    return out


ORACLE = build()
