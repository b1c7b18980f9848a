"""DuckDB text of the queries that SQL can express."""

from __future__ import annotations

from firelake.llm import jaccard, licenses, mixing, negatives, quality, sharding, spelling, urls
from firelake.llm.quality import LEAST_WORDS, REPEATED_PERCENT, RULES, STOP_WORDS, WINDOW_WORDS

# Everything but capital letters.
CAPITALS = r"[^\p{Lu}]+"
BLANKS = r"[\x20\x09-\x0D]+"


def _broken(rule: quality.Rule) -> str:
    tests = []
    if rule.least is not None:
        tests.append(f"100 * {rule.top} < {rule.least} * {rule.bottom}")
    if rule.most is not None:
        tests.append(f"100 * {rule.top} > {rule.most} * {rule.bottom}")
    return f"CASE WHEN {' OR '.join(tests)} THEN '{rule.name}' END"


def quality_sql() -> str:
    stop = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    left = "length(regexp_replace(t, '{}', '', 'g'))".format
    following = "".join(f" || ' ' || lead(w, {j}) OVER o" for j in range(1, WINDOW_WORDS))
    broken = ", ".join(_broken(rule) for rule in RULES)
    return rf"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
split AS (
  SELECT doc_id, t, [x FOR x IN regexp_split_to_array(t, '{BLANKS}') IF x <> ''] AS words,
    [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines FROM texts),
each_word AS (SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM split),
windows AS (SELECT doc_id, i, w{following} AS s FROM each_word WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM windows WHERE s IS NOT NULL)
  WHERE c > 1),
covered AS (
  SELECT doc_id, sum(least({WINDOW_WORDS}, coalesce(after - i, {WINDOW_WORDS}))) AS n
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS after FROM again) GROUP BY doc_id),
measured AS (
  SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
    {left('[^#*$%&|<>]+')} AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(n, 0) AS n_repeat_words, len(lines) AS n_lines, {left('[^!]+')} AS n_exclamations,
    len(regexp_split_to_array(t, '\.\.\.|…')) - 1 AS n_ellipses,
    len([x FOR x IN words IF regexp_matches(x, '\p{{L}}')]) AS n_letter_words,
    len([x FOR x IN regexp_split_to_array(lower(t), '[^\p{{L}}\p{{M}}]+') IF x IN ({stop})]) AS n_stop_words,
    {left(CAPITALS)} AS n_capitals, {left('[^0-9]+')} AS n_digits,
    len([x FOR x IN lines IF regexp_matches(x, '^[ \t]*[-*•][ \t]')]) AS n_bullets
  FROM split LEFT JOIN covered USING (doc_id)),
judged AS (
  SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {REPEATED_PERCENT} * n_words AS base_failed,
    concat_ws(',', {broken}) AS broken FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND broken = '' AS kept, broken FROM judged"""


def licenses_sql() -> str:
    """All windows that hold a template shingle, without hashes or bands."""
    k = licenses.SHINGLE_WORDS
    quoted = [(name, notice.replace("'", "''")) for name, notice in sorted(licenses.TEMPLATES.items())]
    rows = ", ".join(f"('{name}', '{notice}')" for name, notice in quoted)
    following = "".join(f" || ' ' || lead(w, {j}) OVER o" for j in range(1, k))

    def shingles(key: str) -> str:
        return f"SELECT {key}, i, w{following} AS s FROM {{}} WINDOW o AS (PARTITION BY {key} ORDER BY i)"

    def words(text: str) -> str:
        return f"[x FOR x IN regexp_split_to_array(lower({text}), '{licenses.NOT_WORD}') IF x <> '']"

    return f"""
WITH notices(license, notice) AS (VALUES {rows}),
notice_words AS (SELECT license, {words('notice')} AS words FROM notices),
notice_each AS (SELECT license, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM notice_words),
templates AS (
  SELECT DISTINCT license, s, len(words) AS n, greatest(1, len(words) // 2) AS step
  FROM ({shingles('license').format('notice_each')}) JOIN notice_words USING (license) WHERE s IS NOT NULL),
sizes AS (SELECT license, count(*) AS size FROM templates GROUP BY license),
text_words AS (SELECT doc_id, {words("coalesce(text, '')")} AS words FROM documents),
text_each AS (SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM text_words),
hits AS (
  SELECT doc_id, i - 1 AS p, license, s, n, step FROM ({shingles('doc_id').format('text_each')}) JOIN templates USING (s)),
windows AS (
  SELECT doc_id, license, s, step,
    unnest(range(CAST(greatest(0, ceil((p + {k} - 2 * n) / step)) AS BIGINT), CAST(floor(p / step) AS BIGINT) + 1)) AS v FROM hits),
held AS (
  SELECT doc_id, license, v * step + 1 AS first, count(DISTINCT s) AS shared FROM windows GROUP BY doc_id, license, v, step)
SELECT doc_id, license, max(shared) / CAST(max(size) AS DOUBLE) AS containment,
  CAST(arg_min(first, (-shared, first)) AS INTEGER) AS first_word
FROM held JOIN sizes USING (license) WHERE 100 * shared >= {licenses.CONTAINMENT} * size GROUP BY doc_id, license"""


def mixing_sql() -> str:
    seed, power = mixing.SEED, float(mixing.TEMPERATURE)
    return f"""
WITH counts AS (SELECT source, count(*) AS n, pow(count(*), {power}) AS weight FROM documents GROUP BY source),
rates AS (
  SELECT source, weight / (SELECT sum(weight) FROM counts) * (SELECT sum(n) FROM counts) / n AS rate FROM counts),
each_k AS (
  SELECT source, rate, unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 30) AS BIGINT) + 1)) AS k FROM rates),
factorials AS (
  SELECT *, sum(CASE WHEN k > 0 THEN ln(k) ELSE 0e0 END) OVER (PARTITION BY source ORDER BY k) AS factorial FROM each_k),
steps AS (
  SELECT source, sum(exp(k * ln(rate) - rate - factorial)) OVER (PARTITION BY source ORDER BY k) AS step FROM factorials),
drawn AS (
  SELECT doc_id, source,
    CAST('0x' || substr(md5('{seed}:' || CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT) / {float(1 << 52):.1f} AS u FROM documents),
counted AS (
  SELECT doc_id, count(*) AS n_copies FROM drawn d JOIN steps s ON d.source IS NOT DISTINCT FROM s.source AND step <= u
  GROUP BY doc_id)
SELECT documents.*, n_copies, unnest(range(1, n_copies + 1)) AS copy FROM documents JOIN counted USING (doc_id)"""


def urls_sql() -> str:
    ranked = sorted(urls.SITE_RULES, key=lambda r: -len(r.name))
    fits = [(f"suffix('.' || host, '.{r.host}') AND starts_with(path, '{r.path}')", r) for r in ranked]
    rule = " ".join(f"WHEN {test} THEN '{r.name}'" for test, r in fits)
    verdict = " ".join(f"WHEN {test} THEN '{r.verdict}'" for test, r in fits)
    unwanted = " OR ".join(f"'.' || host || '#' || path LIKE '{g.replace('*', '%')}'" for g in urls.UNWANTED)
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
WITH parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{capitals}', '{capitals.lower()}') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages)
SELECT page_id, host, path, CASE {rule} END AS rule,
  CASE {verdict} WHEN {unwanted} THEN 'block' ELSE 'allow' END AS verdict FROM parts"""


# crc_table: the 256 values of CRC-32 as one list.
CRC_TABLE = """
crc_steps(i, c, k) AS (
  SELECT i, i, 0 FROM range(256) r(i) UNION ALL
  SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM crc_steps WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS crc FROM crc_steps WHERE k = 8)"""


def _crc32(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes; crc_table must be joined."""
    octets = f"[CAST('0x' || h AS BIGINT) FOR h IN regexp_extract_all(hex(encode({text})), '..')]"
    step = "lambda c, b: xor(c // 256, crc[xor(c % 256, b) + 1])"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {octets}), {step}), 4294967295)"


def near_duplicates_sql() -> str:
    """All pairs that share a shingle, and what each document reaches."""
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    k = jaccard.SHINGLE_WORDS
    run = " || ' ' || ".join(f"w[i + {j}]" for j in range(k))
    return rf"""
WITH RECURSIVE texts AS (
  SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), '{capitals}', '{capitals.lower()}'), '{BLANKS}')
    IF x <> ''] AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {k} THEN [array_to_string(w, ' ')]
    ELSE [{run} FOR i IN range(1, len(w) - {k - 2})] END) AS s FROM texts),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, a.n, b.n AS m, count(*) AS o
  FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shared WHERE 100 * o >= {jaccard.THRESHOLD} * (n + m - o)),
reached(x, y) AS (SELECT doc_id, doc_id FROM sets UNION SELECT reached.x, links.y FROM reached JOIN links ON reached.y = links.x)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, min(y) AS component_id FROM sets JOIN reached ON x = doc_id
GROUP BY doc_id, len(s)"""


def shards_sql() -> str:
    seed, shards = sharding.SEED, sharding.SHARDS
    return f"""
WITH RECURSIVE {CRC_TABLE},
records AS (
  SELECT doc_id, text, coalesce(strlen(text), 0) + 1 AS size,
    coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(md5(text), '') AS identity FROM documents),
numbered AS (SELECT *, row_number() OVER (PARTITION BY identity) - 1 AS copy FROM records),
totals AS (
  SELECT greatest(1, ceil(count(*) / {sharding.BUCKET_ROWS}), ceil(sum(size) / {sharding.BUCKET_BYTES})) AS buckets FROM records),
drawn AS (SELECT *, md5('{seed}:' || identity || ':' || copy) AS draw FROM numbered),
placed AS (SELECT *, CAST('0x' || substr(draw, 1, 15) AS BIGINT) % CAST(buckets AS BIGINT) AS bucket FROM drawn, totals),
ranked AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY draw) AS rank FROM placed),
counts AS (SELECT bucket, count(*) AS n, sum(count(*)) OVER (ORDER BY bucket) - count(*) AS start FROM placed GROUP BY bucket),
fisher_yates(bucket, start, i, a) AS (
  SELECT bucket, start, n - 1, range(n) FROM counts UNION ALL
  SELECT bucket, start, i - 1, list_transform(a, lambda x, p: CASE p - 1 WHEN i THEN a[j + 1] WHEN j THEN a[i + 1] ELSE x END)
  FROM (SELECT *, CAST('0x' || substr(md5('swap {seed}:' || bucket || ':' || i), 1, 13) AS BIGINT) % (i + 1) AS j
    FROM fisher_yates WHERE i > 0)),
put AS (
  SELECT doc_id, size, text, CAST(start + a[rank] AS BIGINT) AS place
  FROM ranked JOIN (SELECT * FROM fisher_yates WHERE i = 0) USING (bucket))
SELECT doc_id, CAST(size AS BIGINT) AS size, {_crc32("coalesce(text, '')")} AS text_crc32, 'rows' AS law,
  CAST(place % {shards} AS INTEGER) AS shard, place // {shards} AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM put, crc_table"""


def spelling_sql() -> str:
    """Near words by what is left of each without one letter; roots by walking the forms."""
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    least = spelling.LEAST_LETTERS
    return f"""
WITH RECURSIVE {CRC_TABLE},
runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, unnest(regexp_extract_all(translate(text, '{capitals}', '{capitals.lower()}'),
    '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents),
in_docs AS (SELECT doc, run, count(*) AS n FROM runs WHERE length(run) >= {least} GROUP BY ALL),
hashed AS (SELECT *, {_crc32("doc || ':' || run")} AS h FROM in_docs, crc_table),
strewn AS (
  SELECT CASE WHEN h % {spelling.STREWN} = 0
    THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n FROM hashed),
words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM strewn WHERE length(word) >= {least} GROUP BY word
  HAVING sum(n) >= {spelling.LEAST_COUNT}),
gaps AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM gaps a JOIN gaps b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM gaps a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM gaps a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM pairs GROUP BY word),
forms AS (
  SELECT word, CASE WHEN near_n >= {spelling.RATIO} * n THEN near END AS form, n, coalesce(n_near, 0) AS n_near,
    CASE WHEN near_n >= {spelling.RATIO} * n THEN near_n END AS form_n FROM words LEFT JOIN best USING (word)),
walk(word, place) AS (
  SELECT word, word FROM forms UNION ALL
  SELECT walk.word, form FROM walk JOIN forms ON walk.place = forms.word WHERE form IS NOT NULL)
SELECT forms.word, forms.form, walk.place AS root, forms.n, forms.n_near, forms.form_n
FROM forms JOIN walk USING (word) JOIN forms last ON last.word = walk.place AND last.form IS NULL"""


def negatives_sql() -> str:
    return f"""
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM usable a JOIN usable b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {negatives.POSITIVES})
SELECT anchor_id, positive_id, CAST(row_number() OVER inside AS INTEGER) AS rank, vec_id AS negative_id, positive_score,
  score AS negative_score
FROM positives JOIN scores USING (anchor_id)
WHERE NOT same AND {negatives.LOW} * positive_score <= 100 * score AND 100 * score <= {negatives.HIGH} * positive_score
WINDOW inside AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER inside <= {negatives.NEGATIVES}"""
