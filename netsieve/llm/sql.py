"""DuckDB SQL for the operators that SQL can express."""

from netsieve.llm import (cross_polytope as cp, jaccard as ja, licenses as li, mixing as mx, pivot_clusters as pv, quality_rules as qr,
                          spelling as sp, unit_dedup as ud)

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

#: Lines as (doc_id, place from 1, line).
_LINES = r"""
lines AS (
  SELECT doc_id, source, text, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place,
         unnest(string_split(coalesce(text, ''), chr(10))) AS line
  FROM documents)"""

#: Lines, cut into clauses with the blanks behind them; U+E000 marks the cuts. A newline is a piece of its own.
UNIT_DEDUP = rf"""
WITH {_LINES},
norms AS (SELECT *, trim(regexp_replace(line, '{GAP}', ' ', 'g')) AS norm, max(place) OVER (PARTITION BY doc_id) AS places FROM lines),
marked AS (
  SELECT *, norm <> '' AND row_number() OVER (PARTITION BY norm ORDER BY doc_id, place) > 1 AS gone FROM norms),
cut AS (
  SELECT doc_id, place, places, gone, string_split(regexp_replace(line, '([.!?,;:])([ \t]+)', '\1\2' || chr(57344), 'g'), chr(57344)) AS c
  FROM marked),
pieces AS (
  SELECT doc_id, place, generate_subscripts(c, 1) AS k, unnest(c) AS piece, gone FROM cut
  UNION ALL SELECT doc_id, place, len(c) + 1, chr(10), gone FROM cut WHERE place < places),
clauses AS (
  SELECT *, trim(regexp_replace(piece, '{GAP}', ' ', 'g')) AS norm,
         coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY place, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM pieces),
again AS (
  SELECT doc_id, place, k, len(string_split(norm, ' ')) AS words, row_number() OVER (PARTITION BY norm ORDER BY doc_id, place, k) > 1 AS rep
  FROM clauses WHERE norm <> ''),
turns AS (SELECT *, sum((NOT rep)::INT) OVER (PARTITION BY doc_id ORDER BY place, k) AS run FROM again),
long AS (
  SELECT doc_id, place, k FROM turns WHERE rep
  QUALIFY sum(words) OVER (PARTITION BY doc_id, run) >= {ud.RUN_WORDS}),
judged AS (
  SELECT c.doc_id, c.place, c.k, c.piece, c.pos, c.gone OR long.k IS NOT NULL AS out
  FROM clauses c LEFT JOIN long ON c.doc_id = long.doc_id AND c.place = long.place AND c.k = long.k),
spans AS (
  SELECT *, out AND NOT coalesce(lag(out) OVER (PARTITION BY doc_id ORDER BY place, k), false) AS starts,
         NOT out AND lag(out) OVER (PARTITION BY doc_id ORDER BY place, k) AS ends
  FROM (SELECT * FROM judged WHERE piece <> '')),
joined AS (
  SELECT doc_id, count(*) FILTER (starts) AS n_removed,
         coalesce(string_agg(pos::BIGINT::VARCHAR, ',' ORDER BY place, k) FILTER (starts), '') AS removed_starts,
         coalesce(string_agg(pos::BIGINT::VARCHAR, ',' ORDER BY place, k) FILTER (ends), '') AS inner_ends,
         arg_max(out, (place, k)) AS open_end, max(pos + length(piece)) AS size,
         coalesce(string_agg(piece, '' ORDER BY place, k) FILTER (NOT out), '') AS kept
  FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_removed, 0) AS n_removed, coalesce(removed_starts, '') AS removed_starts,
       CASE WHEN open_end THEN CASE WHEN inner_ends = '' THEN '' ELSE inner_ends || ',' END || size::BIGINT::VARCHAR
            ELSE coalesce(inner_ends, '') END AS removed_ends,
       length(coalesce(kept, '')) AS kept_chars, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept, '') END AS kept_text,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN joined USING (doc_id)
"""

#: Reachable pairs (a, b) of the symmetric relation links(a, b) over nodes(id).
_REACH = """
reach AS (
  SELECT id AS a, id AS b FROM nodes
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)"""

#: Links between near copies, and what they reach.
_COPIES = rf"""
shingled AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
shingles AS (
  SELECT doc_id, unnest(list_distinct(CASE
    WHEN len(w) = 0 THEN [] WHEN len(w) < {ja.WORDS} THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - {ja.WORDS - 2}), lambda i: array_to_string(w[i:i + {ja.WORDS - 1}], ' ')) END)) AS g
  FROM shingled),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
  FROM shingles x JOIN shingles y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b, c = p.n AND c = q.n AS same
  FROM shared JOIN sizes p ON a = p.doc_id JOIN sizes q ON b = q.doc_id
  WHERE c / (p.n + q.n - c) >= {ja.THRESHOLD}),
nodes AS (SELECT doc_id AS id FROM documents), {_REACH}"""

JACCARD = rf"""
WITH RECURSIVE {_COPIES}
SELECT id AS doc_id,
       least(id, (SELECT min(b) FROM links WHERE a = id AND same)) AS class_id,
       (SELECT count(*) FROM links WHERE a = id) AS n_links,
       (SELECT min(b) FROM reach WHERE a = id) AS component_id,
       id = (SELECT min(b) FROM reach WHERE a = id) AS kept
FROM nodes
"""

QUALITY_RULES = rf"""
WITH RECURSIVE {_COPIES},
copies AS (SELECT a AS doc_id, min(b) AS component FROM reach GROUP BY a),
texts AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
words AS (SELECT *, regexp_extract_all(text, '{WORD}') AS w FROM texts),
grams AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM words)),
twice AS (SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
repeats AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
  FROM twice, (VALUES (0), (1), (2)) AS v(k) GROUP BY doc_id),
split AS (
  SELECT doc_id, source, generate_subscripts(string_split(text, chr(10)), 1) AS place, unnest(string_split(text, chr(10))) AS line
  FROM texts),
lined AS (
  SELECT *, trim(regexp_replace(line, '{GAP}', ' ', 'g')) AS norm, len(regexp_extract_all(line, '{WORD}')) AS n
  FROM split WHERE regexp_matches(line, '{WORD}')),
dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM lined GROUP BY doc_id),
common AS (
  SELECT source, norm FROM lined JOIN copies USING (doc_id)
  GROUP BY source, norm HAVING count(DISTINCT component) > {qr.MAX_TEXTS_PER_HOST}),
gone AS (
  SELECT doc_id, place, n
  FROM lined JOIN common ON lined.source IS NOT DISTINCT FROM common.source AND lined.norm = common.norm),
told AS (
  SELECT s.doc_id, s.place, s.line, g.n, g.n IS NOT NULL AS out, max(s.place) OVER (PARTITION BY s.doc_id) AS places,
         sum(length(s.line) + 1) OVER (PARTITION BY s.doc_id ORDER BY s.place) - length(s.line) - 1 AS pos
  FROM split s LEFT JOIN gone g ON s.doc_id = g.doc_id AND s.place = g.place),
removed AS (
  SELECT doc_id, sum(n) FILTER (out)::BIGINT AS n_removed_words,
         string_agg(pos::BIGINT::VARCHAR, ',' ORDER BY place) FILTER (out) AS removed_starts,
         string_agg((pos + length(line))::BIGINT::VARCHAR, ',' ORDER BY place) FILTER (out) AS removed_ends,
         string_agg(line || CASE WHEN place < places THEN chr(10) ELSE '' END, '' ORDER BY place) FILTER (NOT out) AS kept_text
  FROM told GROUP BY doc_id),
base AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         coalesce(n_removed_words, 0)::BIGINT AS n_removed_words, coalesce(removed_starts, '') AS removed_starts,
         coalesce(removed_ends, '') AS removed_ends, coalesce(kept_text, '') AS kept_text
  FROM words LEFT JOIN dups USING (doc_id) LEFT JOIN repeats USING (doc_id) LEFT JOIN removed USING (doc_id)),
judged AS (
  SELECT *, n_words < {qr.MIN_WORDS} OR 100 * n_repeat_words > {qr.MAX_REPEAT_PERCENT} * n_words AS base_failed
  FROM base)
SELECT doc_id, n_words, coalesce(word_chars, 0) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       n_removed_words, NOT base_failed AND n_words - n_removed_words >= {qr.MIN_KEPT_SHARE} * n_words AS kept,
       removed_starts, removed_ends, CASE WHEN d.text IS NULL THEN NULL ELSE kept_text END AS kept_text
FROM judged JOIN (SELECT doc_id, text FROM documents) d USING (doc_id)
"""

NEAR_VECTORS = rf"""
WITH RECURSIVE able AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
    AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
links AS (
  SELECT x.vec_id AS a, y.vec_id AS b
  FROM able x JOIN able y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.v) = len(y.v)
  WHERE list_cosine_similarity(x.v, y.v) >= {cp.THRESHOLD}),
nodes AS (SELECT vec_id AS id FROM embeddings), {_REACH}
SELECT id AS vec_id, (SELECT count(*) FROM links WHERE a = id) AS n_links,
       (SELECT min(b) FROM reach WHERE a = id) AS component_id,
       id = (SELECT min(b) FROM reach WHERE a = id) AS kept
FROM nodes
"""


def mixing_sql() -> str:
    """Raking unrolled into one step per round and dimension; the factor c by cutting the cells in order of weight."""
    dims = list(mx.TEMPERING)
    steps, last = [], "c0"
    for r in range(mx.ROUNDS):
        for d in dims:
            steps.append(f"r{r}_{d} AS (SELECT *, sum(tokens * weight) OVER (PARTITION BY {d}) AS mass FROM {last}), "
                         f"r{r}_{d}_w AS (SELECT * EXCLUDE (mass) REPLACE (CASE WHEN mass > 0 THEN weight * target_{d} / mass "
                         f"ELSE weight END AS weight) FROM r{r}_{d})")
            last = f"r{r}_{d}_w"
    raw = ", ".join(f"sum(tokens) OVER (PARTITION BY {d}) AS of_{d}" for d in dims)
    parts = ", ".join(f"CASE WHEN of_{d} > 0 THEN pow(of_{d}, {mx.TEMPERING[d]}) ELSE 0 END AS raw_{d}" for d in dims)
    target = ", ".join(f"raw_{d} * sum(tokens) OVER () / sum(CASE WHEN of_{d} > 0 THEN raw_{d} * tokens / of_{d} ELSE 0 END) "
                       f"OVER () AS target_{d}" for d in dims)
    same = " AND ".join(f"docs.{d} IS NOT DISTINCT FROM probs.{d}" for d in dims)
    return rf"""
WITH counted AS (
  SELECT doc_id, source, lang, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS n_tokens FROM documents),
docs AS (SELECT *, CASE WHEN n_tokens < 100 THEN 'note' WHEN n_tokens < 1000 THEN 'article' ELSE 'book' END AS topic
         FROM counted),
cells AS (SELECT {", ".join(dims)}, sum(n_tokens)::DOUBLE AS tokens FROM docs GROUP BY ALL),
c_of AS (SELECT *, {raw} FROM cells), c_raw AS (SELECT *, {parts} FROM c_of),
c0 AS (SELECT {", ".join(dims)}, tokens, {target}, 1.0::DOUBLE AS weight FROM c_raw),
{", ".join(steps)},
cut AS (
  SELECT *, sum(tokens) OVER (ORDER BY weight DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
         sum(tokens * weight) OVER (ORDER BY weight DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS mass,
         sum(tokens) OVER () AS total
  FROM {last} WHERE tokens > 0),
factor AS (
  SELECT ({mx.SAMPLE_SHARE} * total - coalesce(before, 0)) / mass AS c FROM cut
  WHERE ({mx.SAMPLE_SHARE} * total - coalesce(before, 0)) / mass * weight < 1 ORDER BY weight DESC LIMIT 1),
probs AS (SELECT {", ".join(dims)}, weight, least(1.0, c * weight) AS prob FROM {last}, factor)
SELECT doc_id, n_tokens, round(weight, 4) AS weight, round(prob, 4) AS prob,
       ('0x' || left(md5(doc_id::VARCHAR), 8))::BIGINT / 4294967296 < prob AS sampled
FROM docs JOIN probs ON {same}
"""


def licenses_sql() -> str:
    quote = lambda t: "'" + t.replace("'", "''") + "'"
    values = ", ".join(f"({k}, {quote(name)}, {quote(text)})" for k, (name, text) in enumerate(li.TEMPLATES.items()))
    grams = (r"list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))")
    words = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"
    return rf"""
WITH shelf AS (
  SELECT k, license, {grams} AS t
  FROM (SELECT k, license, {words.format("body")} AS w FROM (VALUES {values}) AS v(k, license, body))),
units AS (
  SELECT DISTINCT doc_id, unnest(list_concat(string_split(text, chr(10)), regexp_split_to_array(text, '\n[ \t]*\n'), [text])) AS u
  FROM documents),
grams AS (SELECT doc_id, u, {grams} AS g FROM (SELECT doc_id, u, {words.format("u")} AS w FROM units)),
scored AS (
  SELECT doc_id, u, k, license, 2.0 * len(list_intersect(g, t)) / (len(g) + len(t)) AS dice
  FROM grams JOIN shelf ON len(g) >= len(t) * 0.6 AND len(g) <= len(t) * 1.6),
best AS (
  SELECT doc_id, arg_max(license, (dice, -k)) AS license, max(dice)::DOUBLE AS dice, count(DISTINCT u) AS n_units
  FROM scored WHERE dice >= {li.DICE} GROUP BY doc_id)
SELECT doc_id, license, dice, coalesce(n_units, 0) AS n_units FROM documents LEFT JOIN best USING (doc_id)
"""


#: Every 50-byte string by its hexadecimal form (100 digits).
SUFFIX_DEDUP = """
WITH bytes AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
places AS (SELECT doc_id, h, unnest(range(0, n - 49)) AS i FROM bytes),
windows AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM places),
repeated AS (SELECT doc_id, i FROM windows QUALIFY min(doc_id) OVER (PARTITION BY s) < doc_id),
turns AS (SELECT *, i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -1000) > 50 AS new FROM repeated),
runs AS (SELECT *, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM turns),
spans AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS b FROM runs GROUP BY ALL),
lists AS (SELECT doc_id, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b, count(*) AS n_spans, sum(b - a)::BIGINT AS n_removed
          FROM spans GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE array_to_string(list_transform(range(0, n_spans + 1), lambda k:
         substr(h, CASE WHEN k = 0 THEN 1 ELSE 2 * b[k] + 1 END,
                CASE WHEN k = n_spans THEN 2 * n ELSE 2 * a[k + 1] END - CASE WHEN k = 0 THEN 0 ELSE 2 * b[k] END)), '') END)) AS kept_sha256
FROM bytes LEFT JOIN lists USING (doc_id)
"""


def cluster_sql() -> str:
    """Rounds unrolled: every distance of every round, without bounds or pivots."""
    steps = []
    for r in range(pv.ROUNDS + 1):
        steps.append(f"""
d{r} AS (SELECT rid, k, sum((p.x - c.x) * (p.x - c.x))::BIGINT AS d FROM parts p JOIN c{r} c USING (i) GROUP BY ALL),
a{r} AS (SELECT rid, k, d FROM d{r} QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, k) = 1),
s{r} AS (SELECT k, i, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{r} JOIN parts USING (rid) GROUP BY ALL),
c{r + 1} AS (SELECT c.k, c.i, CASE WHEN n IS NULL THEN c.x ELSE ((s - ((s % n) + n) % n) // n)::BIGINT END AS x
       FROM c{r} c LEFT JOIN s{r} s ON c.k = s.k AND c.i = s.i)""")
    last = pv.ROUNDS
    return rf"""
WITH sound AS (
  SELECT row_number() OVER () AS rid, vec_id, embedding FROM embeddings
  WHERE len(embedding) = {pv.DIMENSION} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
kept AS (SELECT rid, vec_id, list_transform(embedding, lambda e: floor({pv.SCALE} * e::DOUBLE)::BIGINT) AS v FROM sound),
parts AS (SELECT rid, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM kept),
first AS (
  SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS k, v FROM kept QUALIFY k < {pv.CLUSTERS}),
c0 AS (SELECT k, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM first),{",".join(steps)},
shas AS (SELECT k, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{last} GROUP BY k)
SELECT vec_id, a.k::INTEGER AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.k))::BIGINT AS cluster_inertia,
       (sum(a.d) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a{last} a JOIN kept USING (rid) JOIN shas USING (k)
"""


def spelling_sql() -> str:
    """Near pairs by equal strings with one code point left out; the crc32 byte by byte from its polynomial."""
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    return rf"""
WITH RECURSIVE crc_table AS (
  SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, i: {step}) AS c FROM (SELECT unnest(range(256)) AS n)),
crcs AS MATERIALIZED (SELECT list(c ORDER BY n) AS t FROM crc_table),
found AS MATERIALIZED (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents) GROUP BY ALL),
bytes AS (
  SELECT doc_id, run, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS h FROM found WHERE length(run) >= {sp.MIN_LENGTH}),
hashed AS (
  SELECT doc_id, run, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(0, length(h) // 2),
           lambda k: (('0x' || substr(h, 2 * k + 1, 2))::BIGINT))),
           lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h
  FROM bytes, crcs),
shorn AS (
  SELECT CASE WHEN h % {sp.NOISE} = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n
  FROM hashed),
vocab AS MATERIALIZED (
  SELECT word, sum(n)::BIGINT AS n FROM shorn WHERE length(word) >= {sp.MIN_LENGTH} GROUP BY word HAVING sum(n) >= {sp.MIN_COUNT}),
gaps AS MATERIALIZED (
  SELECT word, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(0, length(word))) AS i FROM vocab)),
pairs AS (
  SELECT x.word AS a, y.word AS b FROM gaps x JOIN gaps y ON x.i = y.i AND x.rest = y.rest AND x.word <> y.word
  UNION SELECT word, rest FROM gaps JOIN (SELECT word AS w FROM vocab) ON w = rest
  UNION SELECT rest, word FROM gaps JOIN (SELECT word AS w FROM vocab) ON w = rest),
ranked AS (
  SELECT a, b, v.n AS form_n, count(*) OVER (PARTITION BY a) AS n_near
  FROM pairs JOIN vocab v ON v.word = b QUALIFY row_number() OVER (PARTITION BY a ORDER BY v.n DESC, encode(b)) = 1),
told AS MATERIALIZED (
  SELECT word, n, CASE WHEN form_n >= {sp.FORM_RATIO} * n THEN b END AS form, coalesce(n_near, 0) AS n_near,
         CASE WHEN form_n >= {sp.FORM_RATIO} * n THEN form_n END AS form_n
  FROM vocab LEFT JOIN ranked ON a = word),
steps AS (
  SELECT word, word AS reached FROM told
  UNION ALL SELECT steps.word, told.form FROM steps JOIN told ON told.word = reached WHERE told.form IS NOT NULL),
roots AS (SELECT steps.word, reached AS root FROM steps JOIN told ON told.word = reached WHERE told.form IS NULL)
SELECT word, n, form, root, n_near, form_n FROM told JOIN roots USING (word)
"""
