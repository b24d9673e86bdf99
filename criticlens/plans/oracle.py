"""SQL twins of the registered queries, for an independent engine on the same tables.

Each entry starts from the same views as its Spark query and then says the result in plain SQL.
"""

from __future__ import annotations

from criticlens.functions.stats import ALPHA, NOT_SIGNIFICANT, STRENGTH
from criticlens.functions.words import DOMAIN_STOP_WORDS, MISLEADING_ITEMS, REASON_CATEGORIES, STOP_WORDS
from criticlens.operators.negative import NOUN_ENDINGS
from criticlens.operators.pages import ENTITIES
from criticlens.plans import adapters as views
from criticlens.plans.registry import GOOD_SCORE, POLARITY, TONE_WORDS

TARGETS = ["score", "score_polarization_index"]


def text_list(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def r6(expression: str, name: str) -> str:
    """Rounded like the Spark side, with negative zero removed."""
    return f"round({expression}, 6) + 0e0 AS {name}"


def chain(*steps: tuple[str, str], final: str) -> str:
    return "WITH " + ",\n".join(f"{name} AS ({sql})" for name, sql in steps) + "\n" + final


RATINGS = ("ratings", views.RATINGS)
OFFERS = ("ratings", views.OFFERS)
TEXT_REVIEWS = ("text_reviews", views.TEXT_REVIEWS)
_TERMS = " + ".join(
    f"power(n{i} / total, 2.3e0) * (n{j} / total) * {abs(i - j)}e0" for i in range(1, 6) for j in range(1, 6) if i != j
)
INFO_ROWS = ("info_rows", views.PRODUCT_INFO)
PRODUCT_INFO = (
    "product_info",
    f"""SELECT * EXCLUDE (total), round({_TERMS}, 9) AS score_polarization_index
FROM (SELECT *, nullif(CAST(n1 + n2 + n3 + n4 + n5 AS DOUBLE), 0) AS total FROM info_rows)""",
)
INFO = (INFO_ROWS, PRODUCT_INFO)
ITEMS = ("items", f"SELECT * FROM ({views.PRODUCT_ITEMS}) WHERE NOT starts_with(item, '#')")

# --- text ----------------------------------------------------------------------------------

_SPACES = r"[\p{Z}\s\x0b\x1c-\x1f\x85]+"


def cleaned(column: str) -> str:
    spaced = f"regexp_replace(lower({column}), '{_SPACES}', ' ', 'g')"
    return rf"trim(regexp_replace(regexp_replace({spaced}, '[^\p{{L}}\p{{N}}_ ]', '', 'g'), ' +', ' ', 'g'))"


def words_of(cleaned_text: str) -> str:
    parts = f"list_filter(string_split(coalesce({cleaned_text}, ''), ' '), lambda w: w <> '')"
    split = " ".join(
        f"WHEN '{a}{b}' THEN ['{a}', '{b}']"
        for a, b in [("can", "not"), ("gim", "me"), ("gon", "na"), ("got", "ta"), ("lem", "me"), ("wan", "na")]
    )
    return f"flatten(list_transform({parts}, lambda w: CASE w {split} ELSE [w] END))"


def keywords_of(column: str) -> str:
    return f"list_filter({words_of(cleaned(column))}, lambda w: w NOT IN ({text_list(STOP_WORDS)}))"


def hits(tokens: str, words) -> str:
    return f"len(list_filter({tokens}, lambda w: w IN ({text_list(words)})))"


def lexicon(column: str) -> str:
    tokens = words_of(cleaned(column))
    pos = hits(tokens, [w for w, p in POLARITY.items() if p > 0])
    neg = hits(tokens, [w for w, p in POLARITY.items() if p < 0])
    return f"CASE WHEN true THEN CAST({pos} + 1 AS DOUBLE) / ({pos} + {neg} + 2) END"


def tone(column: str) -> str:
    parts = f"list_filter(string_split(regexp_replace(lower({column}), '{_SPACES}', ' ', 'g'), ' '), lambda w: w <> '')"
    return f"CAST({hits(parts, TONE_WORDS)} AS DOUBLE) / (len({parts}) + 1) * 100"


def reading_steps(source: str, column: str, keep: str) -> tuple[tuple[str, str], ...]:
    counted = rf"""SELECT {keep}, CAST(len(regexp_extract_all({column}, '[\p{{L}}\p{{N}}]+')) AS DOUBLE) AS w,
  CAST(greatest(len(regexp_extract_all({column}, '[.!?]+')), 1) AS DOUBLE) AS s,
  CAST(len(regexp_extract_all(lower({column}), '[aeiouy]+')) AS DOUBLE) AS y,
  CAST(len(list_filter(regexp_extract_all(lower({column}), '[\p{{L}}\p{{N}}]+'),
                       lambda x: len(regexp_extract_all(x, '[aeiouy]+')) >= 3)) AS DOUBLE) AS c
FROM {source}"""
    measured = """SELECT *,
  coalesce(206.835e0 - 1.015e0 * (w / s) - 84.6e0 * (y / nullif(w, 0)), 0e0) AS flesch_reading_ease,
  coalesce(0.39e0 * (w / s) + 11.8e0 * (y / nullif(w, 0)) - 15.59e0, 0e0) AS flesch_kincaid_grade,
  coalesce(0.4e0 * (w / s + 100 * (c / nullif(w, 0))), 0e0) AS gunning_fog
FROM counted"""
    return ("counted", counted), ("measured", measured)


# --- scores --------------------------------------------------------------------------------

WEIGHTS = (
    "weights",
    """SELECT *, score * weight_simple AS wscore_simple, score * weight_smooth AS wscore_smooth FROM (
  SELECT *, CASE WHEN greatest(coalesce(helpfulness_numerator, 0), 0) = 0 THEN 1e0
                 ELSE CAST(helpfulness_numerator AS DOUBLE) END AS weight_simple,
    CASE WHEN helpfulness_denominator IS NOT NULL THEN
      least(greatest((helpfulness_numerator + 1e0) / (helpfulness_denominator + 2e0)
                     * (1 + ln(1e0 + helpfulness_denominator)), 0.05e0), 10e0) END AS weight_smooth
  FROM ratings)""",
)
SUMS = (
    "sums",
    """SELECT product_id, avg(score) AS mean_score, count(*) AS num_reviews,
  coalesce(sum(weight_simple), 0) AS sum_weight_simple, coalesce(sum(wscore_simple), 0) AS sum_wscore_simple,
  coalesce(sum(weight_smooth), 0) AS sum_weight_smooth, coalesce(sum(wscore_smooth), 0) AS sum_wscore_smooth
FROM weights WHERE product_id IS NOT NULL GROUP BY product_id""",
)
MEANS = (
    "means",
    """SELECT *, CASE WHEN sum_weight_simple > 0 THEN sum_wscore_simple / sum_weight_simple END AS weighted_mean_simple,
  CASE WHEN sum_weight_smooth > 0 THEN sum_wscore_smooth / sum_weight_smooth END AS weighted_mean_smooth FROM sums""",
)
SCORES = (
    "scores",
    """SELECT means.*, (ms * c + weighted_mean_smooth * sum_weight_smooth) / (ms + sum_weight_smooth) AS bayesian_mean_smooth,
  (mp * c + weighted_mean_simple * sum_weight_simple) / (mp + sum_weight_simple) AS bayesian_mean_simple
FROM means, (SELECT greatest(coalesce(median(sum_weight_smooth), 0), 1e-6) AS ms,
                    greatest(coalesce(median(sum_weight_simple), 0), 1e-6) AS mp FROM means),
     (SELECT avg(score) AS c FROM ratings)""",
)
SCORING = (WEIGHTS, SUMS, MEANS, SCORES)
_SCORE_COLUMNS = ["mean_score", "weighted_mean_simple", "weighted_mean_smooth", "bayesian_mean_smooth", "bayesian_mean_simple"]
TABLE = "product_id, num_reviews, " + ", ".join(r6(c, c) for c in _SCORE_COLUMNS)

# --- correlations --------------------------------------------------------------------------

# Two-sided p of Student's t for whole degrees of freedom: its finite trigonometric sums, one for even and one for odd.
_ANGLE = "atan(abs(t) / sqrt(n - 2))"
_EVEN = f"""1 - sin({_ANGLE}) * list_sum([exp(lgamma(k + 0.5e0) - lgamma(k + 1)) * power(cos({_ANGLE}), 2 * k)
  FOR k IN range(CAST((n - 2) // 2 AS BIGINT))]) / sqrt(pi())"""
_ODD = f"""1 - 2 / pi() * ({_ANGLE} + sin({_ANGLE}) * coalesce(list_sum([exp(lgamma(k + 1) - lgamma(k + 1.5e0))
  * power(cos({_ANGLE}), 2 * k + 1) FOR k IN range(CAST((n - 3) // 2 AS BIGINT))]), 0) * sqrt(pi()) / 2)"""
P_VALUE = f"""CASE WHEN abs(corr) >= 1 THEN 0 WHEN n < 3 OR t IS NULL THEN NULL
  WHEN n % 2 = 0 THEN {_EVEN} ELSE {_ODD} END"""


def concluded(source: str, columns: str, with_p_value: bool = False) -> str:
    """Final select over (…, n, corr): t, the label and, if asked, its p."""
    labels = " ".join(f"WHEN abs(corr) > {b}e0 THEN '{name}'" for b, name in STRENGTH)
    shown = f"{r6('p', 'p_value')}, " if with_p_value else ""
    return f"""SELECT {columns}, n, {r6('corr', 'corr')}, {r6('t', 't')}, {shown}
  CASE WHEN NOT coalesce(p <= {ALPHA}, false) THEN '{NOT_SIGNIFICANT}' {labels} ELSE '{NOT_SIGNIFICANT}' END AS conclusion
FROM (SELECT *, {P_VALUE} AS p
  FROM (SELECT *, corr * sqrt((n - 2) / nullif(1 - corr * corr, 0)) AS t FROM {source}))"""


def rank_of(column: str) -> str:
    return f"rank() OVER (ORDER BY {column}) + (count(*) OVER (PARTITION BY {column}) - 1) / 2e0"


def spearman(source: str, pairs: list[tuple[str, str]], feature: str = "feature", where: str = "true") -> tuple:
    """Steps ranking the columns of ``source`` and one correlation row per pair."""
    columns = sorted({c for pair in pairs for c in pair})
    complete = " AND ".join(f"{c} IS NOT NULL" for c in columns)
    ranked = f"SELECT {', '.join(f'{rank_of(c)} AS r_{c}' for c in columns)} FROM {source} WHERE {complete} AND {where}"
    rows = "\nUNION ALL ".join(
        f"""SELECT '{a}' AS {feature}, '{b}' AS compare_with, count(*) AS n,
  covar_pop(r_{a}, r_{b}) / nullif(stddev_pop(r_{a}) * stddev_pop(r_{b}), 0) AS corr FROM ranked"""
        for a, b in pairs
    )
    return ("ranked", ranked), ("correlated", rows)


MAPPED = ("mapped", "SELECT DISTINCT section, item, product_id, value, score, score_polarization_index FROM items")
ITEM_STEPS = (
    *INFO,
    ITEMS,
    ("key_counts", "SELECT section, item, count(*) AS num_samples FROM items GROUP BY section, item"),
    ("chosen", f"SELECT * FROM key_counts WHERE num_samples > 10 AND item NOT IN ({text_list(MISLEADING_ITEMS)})"),
    (
        "complete",
        f"""SELECT product_id, {', '.join(f'{rank_of(t)} AS r_{t}' for t in TARGETS)} FROM product_info
WHERE score IS NOT NULL AND score_polarization_index IS NOT NULL""",
    ),
    (
        "presence",
        """SELECT c.section, c.item, c.num_samples, p.*, CASE WHEN i.value <> '' THEN 1 ELSE -1 END AS has
FROM chosen c, complete p LEFT JOIN items i ON i.product_id = p.product_id AND i.section = c.section AND i.item = c.item""",
    ),
    (
        "correlated",
        "\nUNION ALL ".join(
            f"""SELECT item, split_part(section, '_', 2) AS category, num_samples, '{t}' AS compare_with, count(*) AS n,
  covar_pop(r_{t}, has) / nullif(stddev_pop(r_{t}) * stddev_pop(has), 0) AS corr
FROM presence GROUP BY section, item, num_samples"""
            for t in TARGETS
        ),
    ),
)

# --- bins ----------------------------------------------------------------------------------


def cut_steps(source: str, column: str, n_bins: str, prefix: str = "") -> tuple:
    span = f"""SELECT n, lo, hi, (hi - lo) / n AS width FROM (
  SELECT CAST({n_bins} AS INT) AS n, least_v AS lo, most_v AS hi FROM (
    SELECT CAST(min({column}) AS DOUBLE) AS least_v, CAST(max({column}) AS DOUBLE) AS most_v FROM {source}))"""
    placed = f"""SELECT t.*, least(n, greatest(1, CAST(ceil(({column} - lo) / width) AS INT))) AS bin
FROM {source} t, {prefix}span WHERE {column} IS NOT NULL"""
    table = f"""SELECT CAST(bin AS INT) AS bin,
  lo + (bin - 1) * width - CASE WHEN bin = 1 THEN (hi - lo) * 0.001e0 ELSE 0e0 END AS bin_lo, lo + bin * width AS bin_hi
FROM (SELECT *, unnest(range(1, n + 1)) AS bin FROM {prefix}span)"""
    return (f"{prefix}span", span), (f"{prefix}placed", placed), (f"{prefix}bins", table)


_EDGES = f"{r6('bin_lo', 'bin_lo')}, {r6('bin_hi', 'bin_hi')}, {r6('(bin_lo + bin_hi) / 2', 'bin_mid')}"


def quality(n_name: str = "n_samples") -> str:
    return f"""count(score) AS {n_name}, avg(CASE WHEN score > {GOOD_SCORE}e0 THEN 1e0 ELSE 0e0 END) AS good_score_proportion,
  avg(CASE WHEN score_polarization_index < 0.25e0 THEN 1e0 ELSE 0e0 END) AS low_polarity_proportion"""


def histogram(source: str, columns: list[str], n: int) -> str:
    parts = []
    for c in columns:
        parts.append(
            f"""SELECT '{c}' AS variable, b AS bin, {r6(f'lo + (b - 1) * ((hi - lo) / {n})', 'bin_lo')},
  {r6(f'lo + b * ((hi - lo) / {n})', 'bin_hi')}, coalesce(k, 0) AS n
FROM (SELECT min({c}) AS lo, max({c}) AS hi, unnest(range(1, {n} + 1)) AS b FROM {source})
LEFT JOIN (SELECT least({n}, CAST(floor({n} * (v - lo) / (hi - lo)) AS BIGINT) + 1) AS b, count(*) AS k
           FROM (SELECT {c} AS v FROM {source} WHERE {c} IS NOT NULL),
                (SELECT min({c}) AS lo, max({c}) AS hi FROM {source}) GROUP BY 1) USING (b)"""
        )
    return "\nUNION ALL ".join(parts)


# --- negative reviews ----------------------------------------------------------------------


def _forms(word: str) -> str:
    forms = ", ".join(
        f"CASE WHEN ends_with({word}, '{old}') THEN concat(left({word}, length({word}) - {len(old)}), '{new}') END"
        for old, new in NOUN_ENDINGS.items()
    )
    return f"list_filter([{forms}], lambda f: f IS NOT NULL AND f <> '' AND f <> {word})"


def lemma_steps(source: str) -> tuple:
    """(id, pos, keyword) of the cleaned keywords; ``source`` has id and words."""
    stop = text_list([*STOP_WORDS, *DOMAIN_STOP_WORDS])
    return (
        ("spread", f"SELECT id, unnest(words) AS word, unnest(range(len(words))) AS pos FROM {source}"),
        ("vocabulary", "SELECT DISTINCT word FROM spread"),
        ("forms", f"SELECT word, unnest({_forms('word')}) AS lemma FROM vocabulary"),
        (
            "lemmas",
            """SELECT word, lemma FROM (SELECT word, lemma, row_number() OVER (PARTITION BY word ORDER BY length(lemma), lemma) AS k
FROM (SELECT DISTINCT word, lemma FROM forms WHERE lemma IN (SELECT word FROM vocabulary))) WHERE k = 1""",
        ),
        (
            "kept",
            f"""SELECT id, pos, keyword FROM (SELECT id, pos, coalesce(lemma, spread.word) AS keyword
FROM spread LEFT JOIN lemmas ON lemmas.word = spread.word) WHERE keyword NOT IN ({stop}) AND length(keyword) >= 3""",
        ),
    )


_LOW = "score <= 2 AND sentiment_score < 0.4e0"
TEXT_NEGATIVE = (TEXT_REVIEWS, ("low", f"SELECT id, {keywords_of('text')} AS words FROM text_reviews WHERE {_LOW}"))
SPOKEN_NEGATIVE = (
    ("spoken", views.SPOKEN_RATINGS),
    ("low", f"SELECT row_number() OVER () AS id, product_id, {keywords_of('text')} AS words FROM spoken WHERE {_LOW}"),
)
TOP = "SELECT keyword, count(*) AS frequency FROM kept GROUP BY keyword ORDER BY frequency DESC, keyword LIMIT 30"
CATEGORY = "CASE " + " ".join(
    f"WHEN keyword IN ({text_list(terms)}) THEN '{name}'" for name, terms in reversed(REASON_CATEGORIES.items())
) + " ELSE 'other' END"

# --- pages ---------------------------------------------------------------------------------

_INVISIBLE = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script>|\z)|<style\b.*?(?:</style>|\z)|<[!?][^>]*(?:>|\z)"
_VISIBLE = f"regexp_replace(html, '{_INVISIBLE}', '', 'g')"


def plain(fragment: str) -> str:
    text = f"regexp_replace({fragment}, '<[^<>]*>', '', 'g')"
    for entity, character in ENTITIES.items():
        text = f"regexp_replace({text}, '{entity}', '{character.replace(chr(39), chr(39) * 2)}', 'g')"
    return rf"regexp_replace({text}, '^[\s\x0b\p{{Z}}]+|[\s\x0b\p{{Z}}]+$', '', 'g')"


_FIELD = {
    "title": r"(?is)<title[^<>]*>(.*?)(?:</title|\z)",
    "heading": r"(?is)<h1[^<>]*>(.*?)(?:</h1|\z)",
    "lang": r'(?is)<html[^<>]*?\blang="([^"]*)"',
}
_LINK = r'(?is)<a\s[^<>]*?href="([^"]*)"'
FIELDS = (
    "fields",
    f"SELECT page_id, v, {', '.join(plain(f'regexp_extract(v, {chr(39)}{p}{chr(39)}, 1)') + f' AS {n}' for n, p in _FIELD.items())} "
    f"FROM (SELECT page_id, {_VISIBLE} AS v FROM pages)",
)

_DEDUP = "row_number() OVER (PARTITION BY {keys} ORDER BY {order})"


def _heatmap() -> str:
    months = ", ".join(r6(f"avg(CASE WHEN month(review_time) = {m} THEN CAST(score AS DOUBLE) END)", f"m{m}") for m in range(1, 13))
    return f"SELECT CAST(year(review_time) AS INT) AS year, {months} FROM ratings WHERE score IS NOT NULL GROUP BY 1"


_WRITTEN = (
    "written",
    """SELECT CAST(NULL AS BIGINT) AS id, product_id, CAST(NULL AS STRING) AS user_id,
  CASE WHEN n.text_no = 2 THEN 0 WHEN votes = 'One' THEN 1 ELSE CAST(replace(votes, ',', '') AS INT) END AS helpfulness_numerator,
  CAST(NULL AS INT) AS helpfulness_denominator, CAST(stars AS INT) AS score,
  CAST(DATE '2025-08-01' + CAST(day AS INT) AS TIMESTAMP) AS review_time, title AS summary,
  CASE WHEN n.text_no = 1 THEN text ELSE 'Same again' END AS text, 1 AS source
FROM comments, (SELECT unnest([1, 2]) AS text_no) n""",
)
_MERGE_COLUMNS = "id, product_id, user_id, helpfulness_numerator, helpfulness_denominator, score, review_time, summary, text"
_STARS = ", ".join(f"CAST(floor(n{i} * 100e0 / num_ratings) AS INT) AS p{i}" for i in range(1, 6))
_DOCUMENT = (
    "document",
    f"""SELECT *, CAST(floor(score * 10) AS INT) AS tenths, {_STARS.replace('num_ratings', 'nullif(num_ratings, 0)')} FROM product_info""",
)
_DOC_TERMS = " + ".join(
    f"power(p{i} / ptotal, 2.3e0) * (p{j} / ptotal) * {abs(i - j)}e0" for i in range(1, 6) for j in range(1, 6) if i != j
)
_DENSITY_ITEMS = ["Best Sellers Rank", "Directions", "Item model number", "Safety Information"]
READING = ["flesch_reading_ease", "flesch_kincaid_grade", "gunning_fog"]
_COMPLETE = "score IS NOT NULL AND score_polarization_index IS NOT NULL AND product_description IS NOT NULL"

ORACLE: dict[str, str] = {
    "bayesian_product_scores": chain(RATINGS, *SCORING, final=f"SELECT {TABLE} FROM scores"),
    "bayesian_offer_scores": chain(OFFERS, *SCORING, final=f"SELECT {TABLE} FROM scores"),
    "product_weight_sums": chain(
        RATINGS, WEIGHTS, SUMS,
        final="SELECT product_id, num_reviews, " + ", ".join(
            r6(c, c) for c in ["mean_score", "sum_weight_simple", "sum_wscore_simple", "sum_weight_smooth", "sum_wscore_smooth"]
        ) + " FROM sums",
    ),
    "weighted_product_scores": chain(
        OFFERS, WEIGHTS, SUMS, MEANS,
        final="SELECT product_id, num_reviews, " + ", ".join(r6(c, c) for c in _SCORE_COLUMNS[:3]) + " FROM means",
    ),
    "review_weights": chain(
        RATINGS, WEIGHTS,
        final="SELECT id, " + ", ".join(
            r6(c, c) for c in ["weight_simple", "weight_smooth", "wscore_simple", "wscore_smooth"]
        ) + " FROM weights",
    ),
    "impossible_votes": chain(
        RATINGS,
        final="""SELECT id, helpfulness_numerator, helpfulness_denominator FROM ratings
WHERE helpfulness_numerator > helpfulness_denominator""",
    ),
    "product_score_merge": chain(
        RATINGS, *SCORING, INFO_ROWS,
        final="SELECT i.product_id, product_title, num_ratings, num_reviews, " + ", ".join(r6(c, c) for c in _SCORE_COLUMNS)
        + f""", {r6('weighted_mean_smooth - weighted_mean_simple', 'diff_smooth_vs_simple')},
  {r6('bayesian_mean_smooth - mean_score', 'diff_bayes_vs_mean')}
FROM info_rows i LEFT JOIN scores s ON s.product_id = i.product_id""",
    ),
    "scored_products": chain(
        RATINGS, *SCORING, *INFO, _DOCUMENT,
        final="SELECT d.product_id, CASE WHEN num_ratings > 0 THEN CAST(" + views._VOTES + """ AS BIGINT)
  ELSE CAST(-1 AS BIGINT) END AS num_ratings, num_reviews, """ + ", ".join(r6(c, c) for c in _SCORE_COLUMNS) + ", "
        + ", ".join(f"coalesce(p{i}, 0) AS count_{i}star" for i in range(1, 6))
        + " FROM document d LEFT JOIN scores s ON s.product_id = d.product_id",
    ),
    "score_preview": chain(RATINGS, *SCORING, final=f"SELECT {TABLE} FROM scores ORDER BY scores.product_id LIMIT 10"),
    "score_sample": chain(
        RATINGS, *SCORING,
        final=f"""SELECT {TABLE} FROM scores WHERE num_reviews >= 5 AND mean_score IS NOT NULL
AND weighted_mean_smooth IS NOT NULL AND bayesian_mean_smooth IS NOT NULL
ORDER BY md5(concat(product_id, '#', '42')), product_id LIMIT 300""",
    ),
    "single_review_product": chain(
        OFFERS, *SCORING, final=f"SELECT {TABLE} FROM scores WHERE num_reviews = 1 ORDER BY scores.product_id LIMIT 1"
    ),
    "best_reviewed_product": chain(
        RATINGS, *SCORING,
        final=f"""SELECT {TABLE} FROM scores WHERE num_reviews >= 20
ORDER BY scores.weighted_mean_smooth DESC NULLS LAST, scores.product_id LIMIT 1""",
    ),
    "reviews_csv_roundtrip": chain(
        TEXT_REVIEWS,
        final="""SELECT id, product_id, user_id, helpfulness_numerator, helpfulness_denominator, score,
  CAST(make_timestamp(time * 1000000) AS TIMESTAMP) AS review_time, summary, text FROM text_reviews""",
    ),
    "read_cleaned_reviews": chain(
        TEXT_REVIEWS,
        final=f"""SELECT id, product_id, score, array_to_string({keywords_of('text')}, '|') AS keywords
FROM text_reviews WHERE text IS NOT NULL""",
    ),
    "product_json_load": chain(
        *INFO, _DOCUMENT,
        ("entries", views.PRODUCT_ITEMS),
        final="""SELECT product_id, product_title, 2 AS n_category,
  (SELECT CAST(count(*) AS INT) FROM entries e WHERE e.product_id = d.product_id AND section = 'product_detail') AS n_detail,
  (SELECT CAST(count(*) AS INT) FROM entries e WHERE e.product_id = d.product_id AND section = 'important_information')
    AS n_information,
  CASE WHEN num_ratings > 0 THEN concat(CAST(tenths // 10 AS STRING), '.', CAST(tenths % 10 AS STRING), ' out of 5 stars') END
    AS rating_score,
  CASE WHEN num_ratings > 0 THEN concat(CAST(p5 AS STRING), '%') END AS five_star
FROM document d""",
    ),
    "pending_products": """SELECT DISTINCT CAST(o_orderkey AS STRING) AS product_id FROM orders
WHERE o_orderkey NOT IN (SELECT p_partkey FROM part)""",
    "pending_rounds": """WITH wanted AS (SELECT DISTINCT o_orderkey AS k FROM orders)
SELECT r AS round, CAST(k AS STRING) AS product_id FROM wanted, (SELECT unnest(['none', 'replace']) AS r)
UNION ALL SELECT 'part', CAST(k AS STRING) FROM wanted WHERE k NOT IN (SELECT p_partkey FROM part)
UNION ALL SELECT 'customer', CAST(k AS STRING) FROM wanted
WHERE k NOT IN (SELECT p_partkey FROM part) AND k NOT IN (SELECT c_custkey FROM customer)""",
    "page_fields": chain(FIELDS, final="SELECT page_id, title, heading, lang FROM fields WHERE title <> ''"),
    "page_links": f"""SELECT page_id, CAST(len(links) AS INT) AS n_links, array_to_string(links, '|') AS links
FROM (SELECT page_id, regexp_extract_all({_VISIBLE}, '{_LINK}', 1) AS links FROM pages)""",
    "page_key_values": f"""SELECT page_id, label, arg_max(address, pos) AS address FROM (
  SELECT page_id, pos, {plain('item')} AS label, regexp_extract(item, '{_LINK}', 1) AS address FROM (
    SELECT page_id, unnest(items) AS item, unnest(range(len(items))) AS pos FROM (
      SELECT page_id, regexp_extract_all({_VISIBLE}, '(?is)<li[^>]*>(.*?)</li>', 1) AS items FROM pages)))
GROUP BY page_id, label""",
    "page_sections": f"""SELECT page_id, {plain("regexp_extract(v, '(?s)<h1[^>]*>(.*?)</h1>', 1)")} AS product_title,
  {plain("regexp_extract(v, '(?s)<article[^>]*>(.*)</article>', 1)")} AS product_description,
  CAST(len(list_distinct(list_transform(regexp_extract_all(v, '(?s)<li[^>]*>(.*?)</li>', 1), lambda i: {plain('i')}))) AS INT)
    AS n_detail, 0 AS n_comments
FROM (SELECT page_id, {_VISIBLE} AS v FROM pages)""",
    "page_lists": chain(
        ("parts", views.PAGE_PARTS),
        final=f"""SELECT page_id, {plain('title')} AS product_title, trim(concat('Visit ', coalesce({plain('labels[1]')}, ''))) AS byline_info,
  CASE WHEN len(labels) = 0 THEN '' ELSE array_to_string(list_transform(labels, lambda x: {plain('x')}), '|') END AS category,
  coalesce(array_to_string(list_transform(list_filter(range(len(labels)), lambda i: i % 3 <> 2),
    lambda i: concat('https://m.media-amazon.com/images/I/', page_id * 100 + i, '.jpg')), '|'), '') AS alt_images
FROM parts""",
    ),
    "page_bullets": chain(
        ("parts", views.PAGE_PARTS),
        ("bullets", f"""SELECT page_id, unnest(range(len(labels))) AS i, unnest(list_transform(labels, lambda x: {plain('x')})) AS label, unnest(addresses) AS address FROM parts"""),
        ("cut", "SELECT page_id, i, string_split(concat(label, ' : ', address), ':') AS p FROM bullets"),
        final="""SELECT page_id, trim(p[1]) AS label, arg_max(array_to_string(list_transform(p[2:], lambda x: trim(x)), ':'), i) AS value
FROM cut GROUP BY page_id, trim(p[1])""",
    ),
    "product_files_load": chain(
        ("parts", views.PAGE_PARTS),
        final=f"""SELECT {plain('title')} AS product_title, array_to_string(list_transform(labels, lambda x: {plain('x')}), '|') AS category,
  array_to_string(list_transform(list_filter(range(len(labels)), lambda i: i % 3 <> 2),
    lambda i: concat('https://m.media-amazon.com/images/I/', page_id * 100 + i, '.jpg')), '|') AS alt_images,
  CAST(len(list_filter(range(len(labels)), lambda i: i % 3 <> 2)) AS INT) AS count_alt_images, CAST(len(paragraphs) AS INT) AS n_comments, TRUE AS named
FROM parts WHERE page_id % 10 NOT IN (4, 9)""",
    ),
    "page_ratings": "SELECT page_id, " + ", ".join(
        f"CASE WHEN page_id % 7 <> 0 THEN concat({v}) END AS {n}"
        for v, n in [("1 + page_id % 5, ' out of 5'", "rating_score"), *[(f"(page_id + {k}) % 100, '%'", f"share_{k}") for k in range(1, 6)]]
    ) + " FROM pages",
    "page_comments": chain(
        ("parts", views.PAGE_PARTS),
        ("each", "SELECT page_id, title, unnest(range(len(paragraphs))) AS i, unnest(paragraphs) AS p FROM parts"),
        final=f"""SELECT page_id, CAST(i AS INT) AS nth, CASE WHEN i % 4 = 3 THEN '' ELSE concat('August ', 1 + i % 28, ', 2025') END AS date,
  {plain('title')} AS title, concat(1 + i % 5, '.0 out of 5 stars') AS score, {plain('p')} AS text,
  CASE WHEN i % 2 = 0 THEN CAST(i AS STRING) ELSE '0' END AS helpfulness
FROM each""",
    ),
    "page_fill_rate": chain(
        FIELDS,
        final="SELECT count(*) AS n_pages, " + ", ".join(
            r6(f"avg(CASE WHEN {n} <> '' THEN 1e0 ELSE 0e0 END)", f"share_{n}") for n in _FIELD
        ) + f", {r6(f'avg(CASE WHEN len(regexp_extract_all(v, {chr(39)}{_LINK}{chr(39)})) > 0 THEN 1e0 ELSE 0e0 END)', 'share_links')}"
        " FROM fields",
    ),
    "product_features": chain(
        *INFO, _DOCUMENT,
        final=f"""SELECT product_id, count_alt_images, CASE WHEN num_ratings > 0 THEN tenths / 10e0 END AS score,
  concat_ws('|', p1, p2, p3, p4, p5) AS score_distribution, {r6(_DOC_TERMS, 'score_polarization_index')},
  CASE WHEN num_ratings > 0 THEN CAST({views._VOTES} AS BIGINT) ELSE CAST(-1 AS BIGINT) END AS num_ratings,
  p_type = 'PROMO' AS is_food
FROM (SELECT *, nullif(CAST(p1 + p2 + p3 + p4 + p5 AS DOUBLE), 0) AS ptotal FROM document)""",
    ),
    "score_polarization": chain(
        INFO_ROWS,
        final=f"""SELECT product_id, {r6(_TERMS, 'polarization')}
FROM (SELECT *, nullif(CAST(n1 + n2 + n3 + n4 + n5 AS DOUBLE), 0) AS total FROM info_rows)""",
    ),
    "helpfulness_index": chain(
        RATINGS,
        final="""SELECT id, CASE WHEN helpfulness_denominator = 0 THEN 0e0
  ELSE round_even(helpfulness_numerator / nullif(CAST(helpfulness_denominator AS DOUBLE), 0), 2) END AS helpfulness_index
FROM ratings""",
    ),
    "clean_text": chain(TEXT_REVIEWS, final=f"SELECT id, {cleaned('text')} AS text_cleaned FROM text_reviews"),
    "tokenize": chain(
        TEXT_REVIEWS,
        final=f"""SELECT id, array_to_string(w, '|') AS tokens, CAST(len(w) AS INT) AS n_tokens
FROM (SELECT id, {words_of(cleaned('text'))} AS w FROM text_reviews)""",
    ),
    "keywords": chain(
        TEXT_REVIEWS,
        final=f"""SELECT id, array_to_string(w, '|') AS keywords, CAST(len(w) AS INT) AS n_keywords
FROM (SELECT id, {keywords_of('text')} AS w FROM text_reviews)""",
    ),
    "sentiment_word_model": chain(
        ("words", f"SELECT doc_id, unnest({words_of(cleaned('text'))}) AS word FROM documents"),
        ("counted", "SELECT doc_id, word, count(*) AS n FROM words GROUP BY doc_id, word"),
        (
            "learned",
            """SELECT word, coalesce(sum(n) FILTER (WHERE quality = 1), 0) AS pos, coalesce(sum(n) FILTER (WHERE quality = 0), 0) AS neg
FROM counted JOIN labels USING (doc_id) WHERE quality IN (0, 1) GROUP BY word""",
        ),
        ("totals", "SELECT sum(pos) AS p, sum(neg) AS q, count(*) AS v FROM learned"),
        ("odds", "SELECT word, ln((pos + 1e0) / (p + 1e0 * v)) - ln((neg + 1e0) / (q + 1e0 * v)) AS odds FROM learned, totals"),
        ("summed", "SELECT doc_id, sum(n * odds) AS odds FROM counted JOIN odds USING (word) GROUP BY doc_id"),
        final=f"""SELECT doc_id, {r6('coalesce(odds, 0e0)', 'log_odds')},
  {r6('1 / (1 + exp(-greatest(least(coalesce(odds, 0e0), 500e0), -500e0)))', 'sentiment_score')}
FROM (SELECT DISTINCT doc_id FROM documents) LEFT JOIN summed USING (doc_id)""",
    ),
    "sentiment_batch_score": chain(
        ("words", f"SELECT doc_id, unnest({words_of(cleaned('text'))}) AS word FROM documents"),
        ("counted", "SELECT doc_id, word, count(*) AS n FROM words GROUP BY doc_id, word"),
        (
            "learned",
            """SELECT word, coalesce(sum(n) FILTER (WHERE quality = 1), 0) AS pos, coalesce(sum(n) FILTER (WHERE quality = 0), 0) AS neg
FROM counted JOIN labels USING (doc_id) WHERE quality IN (0, 1) GROUP BY word""",
        ),
        ("totals", "SELECT sum(pos) AS p, sum(neg) AS q, count(*) AS v FROM learned"),
        ("chosen", "SELECT * FROM learned ORDER BY pos + neg DESC, word LIMIT 20000"),
        ("odds", "SELECT word, ln((pos + 1e0) / (p + 1e0 * v)) - ln((neg + 1e0) / (q + 1e0 * v)) AS odds FROM chosen, totals"),
        ("summed", "SELECT doc_id, sum(n * odds) AS odds FROM counted JOIN odds USING (word) GROUP BY doc_id"),
        final=f"""SELECT doc_id, {r6('1 / (1 + exp(-greatest(least(coalesce(odds, 0e0), 500e0), -500e0)))', 'sentiment_score')}
FROM documents LEFT JOIN summed USING (doc_id)""",
    ),
    "sentiment_lexicon_score": chain(
        TEXT_REVIEWS, final=f"SELECT id, {r6(lexicon('text'), 'sentiment_score')} FROM text_reviews"
    ),
    "review_time_parts": chain(
        TEXT_REVIEWS,
        final="""SELECT id, t AS review_date, CAST(year(t) AS INT) AS year, CAST(date_trunc('month', t) AS DATE) AS month,
  CAST(month(t) AS INT) AS month_num FROM (SELECT id, CAST(make_timestamp(time * 1000000) AS TIMESTAMP) AS t FROM text_reviews)""",
    ),
    "score_distribution_columns": chain(
        *INFO, _DOCUMENT,
        final="SELECT product_id, " + ", ".join(f"coalesce(p{i}, 0) AS count_{i}star" for i in range(1, 6)) + " FROM document",
    ),
    "marketing_tone": chain(TEXT_REVIEWS, final=f"SELECT id, {r6(tone('text'), 'marketing_tone_score')} FROM text_reviews"),
    "reading_ease": chain(
        TEXT_REVIEWS, *reading_steps("text_reviews", "text", "id"),
        final="SELECT id, " + ", ".join(r6(c, c) for c in READING) + " FROM measured",
    ),
    "clean_reviews": chain(
        TEXT_REVIEWS,
        final=f"""SELECT id, product_id, user_id, CASE WHEN helpfulness_denominator = 0 THEN 0e0
  ELSE round_even(helpfulness_numerator / nullif(CAST(helpfulness_denominator AS DOUBLE), 0), 2) END AS helpfulness_index,
  score, time, summary, {cleaned('text')} AS text_cleaned, array_to_string({keywords_of('text')}, '|') AS keywords
FROM (SELECT *, {_DEDUP.format(keys='product_id, user_id, score', order='id')} AS k FROM text_reviews
      WHERE text IS NOT NULL AND score IS NOT NULL AND product_id IS NOT NULL) WHERE k = 1""",
    ),
    "cleaning_report": chain(
        TEXT_REVIEWS,
        final="""SELECT count(*) AS rows_read,
  count(*) FILTER (WHERE text IS NULL OR score IS NULL OR product_id IS NULL) AS rows_missing,
  (SELECT count(*) - count(DISTINCT (product_id, user_id, score)) FROM text_reviews
   WHERE text IS NOT NULL AND score IS NOT NULL AND product_id IS NOT NULL) AS rows_duplicate,
  (SELECT count(DISTINCT (product_id, user_id, score)) FROM text_reviews
   WHERE text IS NOT NULL AND score IS NOT NULL AND product_id IS NOT NULL) AS rows_kept
FROM text_reviews""",
    ),
    "table_profile": chain(
        RATINGS,
        final="SELECT count(*) AS n_rows, count(DISTINCT product_id) AS distinct_product_id, " + ", ".join(
            f"count({c}) AS n_{c}"
            for c in ["id", "product_id", "user_id", "helpfulness_numerator", "helpfulness_denominator", "score",
                      "review_time", "summary", "sentiment_score"]
        ) + " FROM ratings",
    ),
    "merge_reviews": chain(
        TEXT_REVIEWS, ("comments", views.COMMENTS), _WRITTEN,
        (
            "both_sources",
            """SELECT id, product_id, user_id, helpfulness_numerator, helpfulness_denominator, score,
  CAST(make_timestamp(time * 1000000) AS TIMESTAMP) AS review_time, summary, text, 0 AS source FROM text_reviews
UNION ALL SELECT * FROM written""",
        ),
        final=f"""SELECT {_MERGE_COLUMNS} FROM (SELECT *, {_DEDUP.format(
            keys='score, review_time, summary',
            order='source, id NULLS LAST, product_id NULLS LAST, text NULLS LAST, helpfulness_numerator')} AS k
FROM both_sources) WHERE k = 1""",
    ),
    "sentiment_outliers": chain(
        RATINGS,
        ("gaps", "SELECT *, score - sentiment_score * 5 AS gap FROM ratings"),
        final=f"""SELECT id, {r6('sentiment_score * 5', 'sentiment_score_scaled')}, {r6('gap', 'sentiment_gap')}, {r6('z', 'z_score')},
  coalesce(abs(z) > 2, false) AS is_outlier
FROM (SELECT *, (gap - (SELECT avg(gap) FROM gaps)) / (SELECT nullif(stddev_samp(gap), 0) FROM gaps) AS z FROM gaps)""",
    ),
    "sentiment_gap_stats": chain(
        RATINGS,
        ("gaps", "SELECT *, score - sentiment_score * 5 AS gap FROM ratings"),
        final=f"""SELECT {r6('avg(gap)', 'mean_gap')}, {r6('stddev_samp(gap)', 'std_gap')},
  count(*) FILTER (WHERE abs((gap - m) / nullif(s, 0)) > 2) AS n_outliers, count(*) AS n_reviews
FROM gaps, (SELECT avg(gap) AS m, stddev_samp(gap) AS s FROM gaps)""",
    ),
    "outlier_sample": chain(
        RATINGS,
        ("gaps", "SELECT *, score - sentiment_score * 5 AS gap FROM ratings"),
        final=f"""SELECT id, product_id, score, {r6('gap', 'sentiment_gap')}, {r6('(gap - m) / s', 'z_score')}
FROM gaps, (SELECT avg(gap) AS m, stddev_samp(gap) AS s FROM gaps) WHERE abs((gap - m) / s) > 2 ORDER BY id LIMIT 10""",
    ),
    "outlier_extremes": chain(
        RATINGS,
        ("gaps", "SELECT *, score - sentiment_score * 5 AS gap FROM ratings"),
        final=f"""SELECT id, product_id, score, {r6('gap', 'sentiment_gap')}, {r6('(gap - m) / s', 'z_score')}
FROM gaps, (SELECT avg(gap) AS m, stddev_samp(gap) AS s FROM gaps) WHERE abs((gap - m) / s) > 2 ORDER BY abs((gap - m) / s) DESC, id LIMIT 25""",
    ),
    "sentiment_gap_histogram": chain(
        RATINGS,
        ("gaps", "SELECT score - sentiment_score * 5 AS sentiment_gap FROM ratings"),
        final=histogram("gaps", ["sentiment_gap"], 50),
    ),
    "monthly_review_volume": chain(
        TEXT_REVIEWS,
        ("dated", "SELECT CAST(date_trunc('month', make_timestamp(time * 1000000)) AS DATE) AS month FROM text_reviews"),
        final="""SELECT CAST(c.month AS DATE) AS month, count(d.month) AS review_count
FROM (SELECT unnest(generate_series((SELECT min(month) FROM dated), (SELECT max(month) FROM dated), INTERVAL 1 MONTH)) AS month) c
LEFT JOIN dated d ON d.month = CAST(c.month AS DATE) GROUP BY 1""",
    ),
    "yearly_review_count": chain(
        TEXT_REVIEWS,
        ("dated", "SELECT CAST(year(make_timestamp(time * 1000000)) AS INT) AS year FROM text_reviews"),
        final="""SELECT CAST(c.year AS INT) AS year, count(d.year) AS review_count
FROM (SELECT unnest(range((SELECT min(year) FROM dated), (SELECT max(year) FROM dated) + 1)) AS year) c
LEFT JOIN dated d ON d.year = c.year GROUP BY 1""",
    ),
    "rating_heatmap": chain(RATINGS, final=_heatmap()),
    "negative_reviews": chain(RATINGS, final=f"SELECT id, product_id, score, sentiment_score FROM ratings WHERE {_LOW}"),
    "negative_keywords_clean": chain(
        *TEXT_NEGATIVE, *lemma_steps("low"),
        final="""SELECT low.id, coalesce(string_agg(keyword, '|' ORDER BY pos), '') AS cleaned_keywords,
  CAST(count(keyword) AS INT) AS n_keywords FROM low LEFT JOIN kept ON kept.id = low.id GROUP BY low.id""",
    ),
    "negative_keyword_top": chain(*SPOKEN_NEGATIVE, *lemma_steps("low"), final=TOP),
    "negative_text_keyword_top": chain(*TEXT_NEGATIVE, *lemma_steps("low"), final=TOP),
    "negative_reason_categories": chain(
        *SPOKEN_NEGATIVE, *lemma_steps("low"), final=f"SELECT keyword, frequency, {CATEGORY} AS category FROM ({TOP})"
    ),
    "negative_category_share": chain(
        *SPOKEN_NEGATIVE, *lemma_steps("low"),
        ("totals", f"SELECT {CATEGORY} AS category, CAST(sum(frequency) AS BIGINT) AS frequency FROM ({TOP}) GROUP BY 1"),
        final=f"""SELECT category, frequency, {r6('frequency * 100e0 / (SELECT sum(frequency) FROM totals)', 'share_percent')}
FROM totals""",
    ),
    "product_top_issues": chain(
        *SPOKEN_NEGATIVE, *lemma_steps("low"),
        (
            "top_products",
            f"""SELECT product_id, count(score) AS negative_review_count FROM spoken WHERE {_LOW}
GROUP BY product_id ORDER BY negative_review_count DESC, product_id LIMIT 10""",
        ),
        (
            "ranked",
            """SELECT product_id, keyword, row_number() OVER (PARTITION BY product_id ORDER BY count(*) DESC, keyword) AS place
FROM kept JOIN low ON low.id = kept.id GROUP BY product_id, keyword""",
        ),
        final="""SELECT t.product_id, any_value(negative_review_count) AS negative_review_count,
  coalesce(string_agg(keyword, '|' ORDER BY place), '') AS top_issues
FROM top_products t LEFT JOIN ranked r ON r.product_id = t.product_id AND place <= 5 GROUP BY t.product_id""",
    ),
    "product_keyword_counts": chain(
        *SPOKEN_NEGATIVE, *lemma_steps("low"),
        final=f"""SELECT product_id, keyword, count(*) AS frequency FROM kept JOIN low ON low.id = kept.id
WHERE product_id IN (SELECT product_id FROM spoken WHERE {_LOW} GROUP BY product_id
  ORDER BY count(score) DESC, product_id LIMIT 10) GROUP BY product_id, keyword""",
    ),
    "negative_report_csv": chain(
        *SPOKEN_NEGATIVE, *lemma_steps("low"),
        final=f"""SELECT product_id, keyword, count(*) AS frequency, NULL AS category FROM kept JOIN low ON low.id = kept.id
WHERE product_id IN (SELECT product_id FROM spoken WHERE {_LOW} GROUP BY product_id
  ORDER BY count(score) DESC, product_id LIMIT 10) GROUP BY product_id, keyword
UNION ALL SELECT NULL, keyword, frequency, {CATEGORY} FROM ({TOP})""",
    ),
    "average_rank": """SELECT CAST(l_extendedprice AS DOUBLE) AS value, count(*) AS n, avg(k) AS rank
FROM (SELECT l_extendedprice, row_number() OVER (ORDER BY l_extendedprice) AS k FROM lineitem) GROUP BY l_extendedprice""",
    "description_item_counts": chain(
        *INFO, ITEMS, final="SELECT section, item, count(*) AS num_samples FROM items GROUP BY section, item"
    ),
    "score_bins": chain(
        *INFO,
        ("rated", "SELECT * FROM product_info WHERE num_ratings > 20"),
        *cut_steps("rated", "score", "floor((most_v - least_v) * 10 + 1)", "a_"),
        *cut_steps("rated", "score_polarization_index", "50", "b_"),
        final="\nUNION ALL ".join(
            f"""SELECT '{name}' AS variable, bin, {_EDGES}, coalesce(k, 0) AS n_samples
FROM {p}bins LEFT JOIN (SELECT bin, count(*) AS k FROM {p}placed GROUP BY bin) USING (bin)"""
            for name, p in (("score", "a_"), ("polarization", "b_"))
        ),
    ),
    "description_length_bins": chain(
        *INFO,
        (
            "described",
            f"""SELECT *, log2(len(string_split(product_description, ' '))) AS count_desc_length
FROM product_info WHERE num_ratings > 10 AND {_COMPLETE}""",
        ),
        *cut_steps("described", "count_desc_length", "15"),
        ("measures", f"SELECT bin, {quality('k')} FROM placed GROUP BY bin"),
        final=f"""SELECT bin, {_EDGES}, coalesce(k, 0) AS n_samples, {r6('good_score_proportion', 'good_score_proportion')},
  {r6('low_polarity_proportion', 'low_polarity_proportion')} FROM bins LEFT JOIN measures USING (bin)""",
    ),
    "image_count_quality": chain(
        *INFO,
        final=f"""SELECT count_alt_images, n_samples, {r6('good_score_proportion', 'good_score_proportion')},
  {r6('low_polarity_proportion', 'low_polarity_proportion')}
FROM (SELECT count_alt_images, {quality()} FROM product_info WHERE num_ratings > 10 GROUP BY count_alt_images)""",
    ),
    "spearman_images": chain(
        *INFO, *spearman("product_info", [("count_alt_images", t) for t in TARGETS]),
        final=concluded("correlated", "feature, compare_with"),
    ),
    "correlation_p_values": chain(
        *INFO, *spearman("product_info", [("count_alt_images", t) for t in TARGETS]),
        final=concluded("correlated", "feature, compare_with", with_p_value=True),
    ),
    "spearman_description_length": chain(
        *INFO,
        (
            "described",
            f"""SELECT *, log2(len(string_split(product_description, ' '))) AS count_desc_length
FROM product_info WHERE num_ratings > 10 AND {_COMPLETE}""",
        ),
        *spearman("described", [("count_desc_length", t) for t in TARGETS]),
        final=concluded("correlated", "feature, compare_with"),
    ),
    "spearman_marketing": chain(
        *INFO,
        (
            "described",
            f"""SELECT *, {lexicon('product_description')} AS sentiment_score, {tone('product_description')} AS marketing_tone_score
FROM product_info WHERE {_COMPLETE}""",
        ),
        *spearman("described", [(f, t) for t in TARGETS for f in ("sentiment_score", "marketing_tone_score")], "sentiment_type"),
        final=concluded("correlated", "sentiment_type, compare_with"),
    ),
    "spearman_reading_ease": chain(
        *INFO,
        ("described", f"SELECT * FROM product_info WHERE {_COMPLETE}"),
        *reading_steps("described", "product_description", "score, score_polarization_index"),
        *spearman("measured", [(m, t) for m in READING for t in TARGETS], "ease_index", "flesch_reading_ease <> 0"),
        final=concluded("correlated", "ease_index, compare_with"),
    ),
    "spearman_description_items": chain(
        *ITEM_STEPS, final=concluded("correlated", "item, category, num_samples, compare_with")
    ),
    "correlated_item_summary": chain(
        *ITEM_STEPS,
        ("concluded", concluded("correlated", "item")),
        final=f"""SELECT count(DISTINCT item) FILTER (WHERE conclusion <> '{NOT_SIGNIFICANT}') AS n_correlated,
  count(DISTINCT item) AS n_items FROM concluded""",
    ),
    "feature_histograms": chain(
        *INFO,
        (
            "described",
            f"""SELECT *, {tone('product_description')} AS marketing_tone_score, {lexicon('product_description')} AS sentiment_score
FROM product_info WHERE {_COMPLETE}""",
        ),
        *reading_steps("described", "product_description", "product_id"),
        ("readable", "SELECT * FROM measured WHERE flesch_reading_ease <> 0"),
        final=histogram("readable", READING, 25) + "\nUNION ALL "
        + histogram("described", ["marketing_tone_score", "sentiment_score"], 25),
    ),
    "score_density": chain(
        *INFO, ITEMS,
        (
            "curves",
            f"""SELECT item, score FROM items WHERE item IN ({text_list(_DENSITY_ITEMS)}) AND score IS NOT NULL
UNION ALL SELECT 'All', score FROM product_info WHERE score IS NOT NULL""",
        ),
        (
            "shapes",
            """SELECT item, count(*) AS n, stddev_samp(score) * power(count(*), -0.2e0) AS h, min(score) AS least_v,
  max(score) AS most_v FROM curves GROUP BY item""",
        ),
        (
            "grid",
            """SELECT *, least_v - 3 * h + point * ((most_v + 3 * h) - (least_v - 3 * h)) / 199 AS x
FROM (SELECT *, unnest(range(0, 200)) AS point FROM shapes)""",
        ),
        final=f"""SELECT g.item, CAST(point AS INT) AS point, {r6('any_value(x)', 'x')},
  {r6('sum(exp(-0.5e0 * power((x - score) / h, 2))) / any_value(n * h * sqrt(2 * pi()))', 'density')}
FROM grid g JOIN curves c ON c.item = g.item GROUP BY g.item, point""",
    ),
    "price_density": chain(
        ("priced", "SELECT l_returnflag, l_extendedprice / 1e3 AS price FROM lineitem"),
        (
            "shapes",
            """SELECT l_returnflag, n, h, least_v - 3 * h AS lo, most_v + 3 * h AS hi, ceil(32 * (most_v + 3 * h - (least_v - 3 * h)) / h) AS m
FROM (SELECT l_returnflag, count(*) AS n, stddev_samp(price) * power(count(*), -0.2e0) AS h, min(price) AS least_v,
  max(price) AS most_v FROM priced GROUP BY l_returnflag)""",
        ),
        ("dealt", "SELECT s.l_returnflag, (price - lo) / ((hi - lo) / m) AS place FROM priced l JOIN shapes s ON l.l_returnflag = s.l_returnflag"),
        (
            "knots",
            """SELECT l_returnflag, k, sum(w) AS w FROM (SELECT l_returnflag, floor(place) AS k, 1 - (place - floor(place)) AS w FROM dealt
UNION ALL SELECT l_returnflag, floor(place) + 1, place - floor(place) FROM dealt) GROUP BY l_returnflag, k""",
        ),
        ("grid", "SELECT *, lo + point * (hi - lo) / 199 AS x FROM (SELECT *, unnest(range(0, 200)) AS point FROM shapes)"),
        final=f"""SELECT g.l_returnflag, CAST(point AS INT) AS point, {r6('any_value(x)', 'x')},
  {r6('sum(w * exp(-0.5e0 * power((x - (lo + k * (hi - lo) / m)) / h, 2))) / any_value(n * h * sqrt(2 * pi()))', 'density')}
FROM grid g JOIN knots c ON c.l_returnflag = g.l_returnflag GROUP BY g.l_returnflag, point""",
    ),
    "yearly_cleaning_rounds": chain(
        TEXT_REVIEWS,
        (
            "kept",
            f"""SELECT CAST(year(make_timestamp(time * 1000000)) AS INT) AS year, score
FROM (SELECT *, {_DEDUP.format(keys='product_id, user_id, score', order='id')} AS k FROM text_reviews
      WHERE text IS NOT NULL AND score IS NOT NULL AND product_id IS NOT NULL) WHERE k = 1""",
        ),
        final="""SELECT year, count(*) AS n, CAST(sum(CASE WHEN year = (SELECT max(year) FROM kept) THEN 6 - score ELSE score END) AS BIGINT) AS score_sum,
  year = (SELECT max(year) FROM kept) AS rewritten FROM kept GROUP BY year""",
    ),
    "quarantined_reviews": """SELECT CASE WHEN ok THEN CAST(o_orderkey AS STRING) END AS id, CASE WHEN ok THEN concat('p', o_custkey) END AS product_id,
  CASE WHEN ok THEN CAST(1 + o_custkey % 5 AS INT) END AS score, CASE WHEN ok THEN 'said "yes" twice' END AS text,
  CASE WHEN o_orderkey % 10 = 3 THEN concat(o_orderkey, ',p,u,n,1,2,five,1700000000,s,t')
       WHEN o_orderkey % 10 = 7 THEN concat(o_orderkey, ',broken') END AS record
FROM (SELECT *, o_orderkey % 10 NOT IN (3, 7) AS ok FROM orders)""",
    "restarted_product_scores": chain(RATINGS, *SCORING, final=f"SELECT {TABLE} FROM scores"),
    "event_volume_stream": """SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, n
FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS n FROM events GROUP BY 1)
WHERE window_start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""",
    "late_event_counts": """SELECT CAST(1 AS INT) AS delivery, count(*) AS n_rows, CAST(0 AS BIGINT) AS n_late FROM events
UNION ALL SELECT 2, count(*), count(*) FILTER (WHERE ts <= date_trunc('millisecond', (SELECT max(ts) FROM events)) - INTERVAL 1 DAY) FROM events""",
    "deduplicated_stream": "SELECT event_id, user_id, event_type FROM events",
    "incremental_product_scores": chain(RATINGS, *SCORING, final=f"SELECT {TABLE} FROM scores"),
}

# Documents written and loaded again give the same reviews.
ORACLE["enriched_reviews"] = ORACLE["merge_reviews"]
