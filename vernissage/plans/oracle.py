"""DuckDB SQL twins of the registered queries, written from the definitions."""

from __future__ import annotations

from vernissage.schema import ARTIST_THRESHOLD, INGEST_THRESHOLD, SearchConfig

SQL: dict[str, str] = {}
CONFIG = SearchConfig()

# ---- scalar expressions


def strip_diacritics(c):
    return f"strip_accents(coalesce({c}, ''))"


def strip_parens(c):
    return rf"regexp_replace(coalesce({c}, ''), '\([^)]*\)', '', 'g')"


def delimiters(c):
    return f"translate(replace(coalesce({c}, ''), '&', ' and '), '-_/', '   ')"


def punct(c):
    return rf"regexp_replace(coalesce({c}, ''), '[^\p{{L}}\p{{N}}_\s]', '', 'g')"


def collapse(c):
    return rf"trim(regexp_replace(coalesce({c}, ''), '\s+', ' ', 'g'))"


def normal_name(c):
    return collapse(f"lower({punct(delimiters(strip_parens(strip_diacritics(c))))})")


def _article(c, pattern):
    return f"CASE WHEN regexp_matches({collapse(c)}, '{pattern}') THEN regexp_replace({collapse(c)}, '{pattern}', '') ELSE {c} END"


def leading_article(c):
    return _article(c, "^(the|a|an) ")


def trailing_article(c):
    return _article(c, " (the|a|an)$")


def normal_title(c):
    return f"regexp_replace(regexp_replace({normal_name(c)}, ' (the|a|an)$', ''), '^(the|a|an) ', '')"


def title_case(c):
    return (
        rf"array_to_string(list_transform(regexp_extract_all({c}, '\p{{L}}+|\P{{L}}+'),"
        " lambda p: CASE WHEN p[1] = 'ß' THEN 'Ss' ELSE upper(p[1]) END || lower(p[2:])), '')"
    )


def sorted_tokens(c):
    return f"array_to_string(list_sort(string_split({c}, ' ')), ' ')"


def token_set(c):
    return f"array_to_string(list_sort(list_distinct(string_split({c}, ' '))), ' ')"


def lcs(a, b):
    """Longest common subsequence: one bit per character of ``b`` (up to 62 characters)."""
    mask = (
        f"list_sum(list_transform(range(length({b})), lambda j: CASE WHEN substr({b}, (j + 1)::INT, 1) = ch"
        " THEN (1::BIGINT << j::INT) ELSE 0 END))::BIGINT"
    )
    masks = f"list_transform(string_split({a}, ''), lambda ch: {mask})"
    full = f"((1::BIGINT << length({b})::INT) - 1)"
    state = f"list_reduce({masks}, lambda s, m: ((s + (s & m)) | (s - (s & m))) & {full}, {full})"
    return f"(length({b}) - bit_count({state}))"


def ratio(a, b):
    return f"round_even(200.0::DOUBLE * {lcs(a, b)} / (length({a}) + length({b})), 0)::INT"


def partial(a, b):
    """``a`` is the shorter one."""
    window = f"substr({b}, (i + 1)::INT, length({a})::INT)"
    return f"list_max(list_transform(range(length({b})), lambda i: {ratio(a, window)}))"


def long_ratio(source):
    """The same for strings ``a`` and ``b`` of any length, as CTEs: words of 120 bits, and a carry from each to the next."""
    # the first entry of the inner list carries, the others are the words so far
    step = (
        "list_reduce(list_transform(range(len(s)), lambda w: [s[w + 1], m[w + 1]]), lambda acc, x:"
        " list_concat([(x[1] + (x[1] & x[2]) + acc[1]) >> 120], list_append(acc[2:],"
        " ((x[1] + (x[1] & x[2]) + acc[1]) | (x[1] - (x[1] & x[2]))) & ((1::HUGEINT << 120) - 1))), [0::HUGEINT])[2:]"
    )
    return f"""split AS (SELECT *, string_split(a, '') AS xs, string_split(b, '') AS ys FROM {source}),
cut AS (SELECT *, list_transform(range((len(ys) + 119) // 120), lambda w: ys[120 * w + 1:120 * w + 120]) AS parts FROM split),
masked AS (SELECT *,
    map_from_entries(list_transform(list_distinct(xs), lambda ch: (ch, list_transform(parts, lambda part:
      coalesce(list_sum(list_transform(part, lambda c, i: CASE WHEN c = ch THEN 1::HUGEINT << (i - 1)::INT ELSE 0 END)), 0)::HUGEINT)))) AS masks,
    list_transform(parts, lambda part: (1::HUGEINT << len(part)::INT) - 1) AS whole FROM cut),
stepped AS (SELECT *, list_reduce(list_transform(xs, lambda ch: masks[ch]), lambda s, m: {step}, whole) AS state FROM masked),
scored AS (SELECT *, CASE WHEN a = '' OR b = '' THEN 0 ELSE round_even(200.0::DOUBLE * (length(b)
    - list_sum(list_transform(list_zip(state, whole), lambda p: bit_count(p[1] & p[2])))) / (length(a) + length(b)), 0)::INT END AS score FROM stepped)"""


def unit(purpose, key, seed=42):
    return f"(('0x' || substr(md5('{seed}|{purpose}|' || {key}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def draw_between(purpose, lo, hi):
    return f"({lo}::DOUBLE + {hi - lo}::DOUBLE * {unit(purpose, 'id')})"


def perturbed(name, vec="vec", draws=None):
    p = draws or name
    if name == "brightness":
        g = draw_between(f"{p}|gamma", 0.35, 2.0)
        return f"list_transform({vec}, lambda x: sign(x) * pow(abs(x), {g}))"
    if name == "contrast":
        offset = f"((floor({unit(f'{p}|offset', 'id')} * 101) - 50) / 255.0::DOUBLE)"
        gain = draw_between(f"{p}|gain", 0.5, 1.6)
        return f"list_transform({vec}, lambda x: greatest(-1.0::DOUBLE, least(1.0::DOUBLE, {gain} * x + {offset})))"
    if name == "aged":
        gain, keep = draw_between(f"{p}|fade", 0.5, 1.1), draw_between(f"{p}|squeeze", 0.6, 0.9)
        mean = f"({gain} * list_sum({vec}) / len({vec}))"
        return f"list_transform({vec}, lambda x: ({gain} * x - {mean}) * {keep} + {mean})"
    if name == "random":
        choice = f"floor({unit('random|choice', 'id')} * 3)::INT"
        return (
            f"CASE {choice} WHEN 0 THEN {perturbed('aged', vec, 'random')} WHEN 1 THEN {perturbed('brightness', vec, 'random')}"
            f" ELSE {perturbed('contrast', vec, 'random')} END"
        )
    return vec


def cosine(a, b):
    return f"round(list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))), 6)"


def signature(vec):
    def word(at):
        return f"list_sum(list_transform(range(32), lambda i: CASE WHEN {vec}[i + {at + 1}] > 0 THEN (1::BIGINT << i::INT) ELSE 0 END))::BIGINT"

    return f"[{word(0)}, {word(32)}]"


def sig_text(vec):
    return f"array_to_string(list_transform({signature(vec)}, lambda x: x::VARCHAR), ',')"


def differing(a, b):
    return f"(bit_count(xor({a}[1], {b}[1])) + bit_count(xor({a}[2], {b}[2])))::INT"


def fixed(c, digits):
    scaled = f"floor(abs({c}) * {10**digits}.0::DOUBLE + 0.5)::BIGINT"
    return (
        f"(CASE WHEN {c} < 0 THEN '-' ELSE '' END || ({scaled} // {10**digits})::VARCHAR || '.'"
        f" || lpad(({scaled} % {10**digits})::VARCHAR, {digits}, '0'))"
    )


# ---- common table expressions

CATALOG = """catalog AS (
  SELECT p_partkey AS idx,
    CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 7 = 0 THEN '' ELSE p_type || ' ' || p_name END AS title,
    CASE p_partkey % 8
      WHEN 0 THEN p_name
      WHEN 1 THEN split_part(p_name, ' ', 2) || ', ' || split_part(p_name, ' ', 1)
      WHEN 2 THEN upper(p_name) || ' (' || p_size || ')'
      WHEN 3 THEN split_part(p_name, ' ', 1) || '-' || split_part(p_name, ' ', 2)
      WHEN 4 THEN substr(p_name, 1, 2) || substr(p_name, 4)
      WHEN 5 THEN translate(p_name, 'aeo', 'áéö')
      WHEN 7 THEN 'The ' || p_brand END AS artist,
    CASE WHEN p_partkey % 11 <> 0 THEN (1900 + p_size)::VARCHAR END AS date,
    p_type AS genre, p_brand AS style
  FROM part)"""
AUTHORITY = "authority AS (SELECT DISTINCT p_name AS name FROM part WHERE md5(p_name) < 'b')"


def prepared(name, source, column):
    return f"""{name}_raw AS (SELECT DISTINCT {column} AS name FROM {source}),
{name}_norm AS (SELECT name, {normal_name('name')} AS norm FROM {name}_raw),
{name} AS (SELECT name, norm, {token_set('norm')} AS tokens, {sorted_tokens('norm')} AS sorted
  FROM {name}_norm WHERE norm <> '')"""


def record(artist):
    return f"""SELECT 'wikiart_' || idx AS id, coalesce(nullif(title, ''), 'Unknown Title') AS title, {artist} AS artist,
  'https://www.wikiart.org' AS url, coalesce(genre, '') AS genre, coalesce(style, '') AS style, coalesce(date, '') AS date"""


NAMED = "named AS (SELECT *, coalesce(nullif(artist, ''), 'Unknown') AS raw FROM catalog)"
FORMS = f"""forms AS (SELECT DISTINCT n.sorted, a.sorted AS other FROM names n, known a
  WHERE n.sorted <> '' AND abs(length(n.sorted) - length(a.sorted)) <= 0.25 * (length(n.sorted) + length(a.sorted))),
scores AS (SELECT sorted, other, {ratio('sorted', 'other')} AS score FROM forms)"""
# the length condition only spares work: a longer gap cannot reach a ratio of 0.75
MATCHED = f"""{CATALOG}, {AUTHORITY}, {NAMED}, {prepared('names', 'named', 'raw')}, {prepared('known', 'authority', 'name')}, {FORMS},
options AS (
  SELECT n.name, a.name AS canonical,
    CASE WHEN n.norm = a.norm THEN 1 WHEN n.tokens = a.tokens THEN 2 ELSE 3 END AS tier,
    CASE WHEN n.norm = a.norm OR n.tokens = a.tokens THEN 100 ELSE s.score END AS score
  FROM names n CROSS JOIN known a LEFT JOIN scores s ON s.sorted = n.sorted AND s.other = a.sorted),
best AS (SELECT name, canonical FROM options WHERE tier < 3 OR score >= {INGEST_THRESHOLD}
  QUALIFY row_number() OVER (PARTITION BY name ORDER BY tier, score DESC, canonical) = 1),
matched AS (SELECT c.*, b.canonical FROM named c JOIN best b ON c.raw = b.name),
metadata AS ({record(title_case('canonical'))}, idx FROM matched)"""
HISTORY = f"""{CATALOG},
written AS ({record(title_case('artist'))}, 2 * idx AS ord FROM catalog WHERE artist IS NOT NULL),
history AS (SELECT * FROM written UNION ALL
  SELECT id, title, artist, url, genre, style, '2000' AS date, ord + 1 AS ord FROM written
  JOIN part ON id = 'wikiart_' || p_partkey WHERE p_size > 25),
latest AS (SELECT * FROM history QUALIFY row_number() OVER (PARTITION BY id ORDER BY ord DESC) = 1)"""
META = "id, title, artist, url, genre, style, date"
VECTORS = "vectors AS (SELECT 'wikiart_' || vec_id AS id, vec_id AS ord, embedding::DOUBLE[] AS vec, label FROM embeddings)"
LATENCY = "latency AS (SELECT 'wikiart_' || event_id AS id, value AS latency_ms FROM events)"


def index(training="vectors"):
    return f"""cells AS (SELECT row_number() OVER (ORDER BY ord) - 1 AS cell, vec FROM {training}
  QUALIFY cell < greatest(16, floor(sqrt((SELECT count(*) FROM vectors))))),
postings AS (SELECT v.id, v.vec, c.cell FROM vectors v CROSS JOIN cells c
  QUALIFY row_number() OVER (PARTITION BY v.id ORDER BY {cosine('v.vec', 'c.vec')} DESC, c.cell) = 1)"""


def search(queries="queries"):
    return f"""ranked AS (SELECT q.qid, q.vec, c.cell, row_number() OVER (PARTITION BY q.qid ORDER BY {cosine('q.vec', 'c.vec')} DESC, c.cell) AS r
  FROM {queries} q CROSS JOIN cells c),
pairs AS (SELECT k.qid, k.r, p.id, {cosine('k.vec', 'p.vec')} AS score FROM ranked k JOIN postings p ON k.cell = p.cell
  WHERE k.r <= {CONFIG.nprobe_deep}),
fast AS (SELECT qid, id, score FROM pairs WHERE r <= {CONFIG.nprobe_fast}
  QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) = 1),
deep AS (SELECT qid, id, score FROM pairs QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) = 1),
hits AS (SELECT q.qid,
    CASE WHEN f.score >= {CONFIG.confidence_threshold} THEN f.id WHEN d.score >= {CONFIG.confidence_threshold} THEN d.id ELSE 'Unknown' END AS label,
    CASE WHEN f.score >= {CONFIG.confidence_threshold} THEN f.score ELSE coalesce(d.score, 0.0) END AS confidence,
    coalesce(f.score < {CONFIG.confidence_threshold}, true) AS fallback_used
  FROM {queries} q LEFT JOIN fast f ON q.qid = f.qid LEFT JOIN deep d ON q.qid = d.qid)"""


def eval_queries(transforms):
    parts = [
        f"SELECT '{t}|' || id AS qid, '{t}' AS transform, id, {perturbed(t)} AS vec FROM vectors" for t in transforms
    ]
    return "queries AS (" + " UNION ALL ".join(parts) + ")"


def evaluated(transforms):
    return f"""{VECTORS}, {LATENCY}, {index()}, {eval_queries(transforms)}, {search()},
detail AS (SELECT q.qid, q.transform, q.id, h.label, h.confidence, h.fallback_used, h.label = q.id AS correct, l.latency_ms
  FROM queries q JOIN hits h ON q.qid = h.qid LEFT JOIN latency l ON q.id = l.id)"""


RATES = """count(*) AS n, sum(correct::INT)::BIGINT AS correct, round(100 * avg(correct::INT), 6) AS accuracy,
  round(100 * avg(fallback_used::INT), 6) AS fallbacks, round(avg(latency_ms), 6) AS avg_ms,
  round(quantile_cont(latency_ms, 0.95), 6) AS p95_ms"""
ALL = ["aged", "brightness", "contrast"]
EVAL = ["none", *ALL, "random"]


def sampled(source, seed=42):
    return f"md5('{seed}|' || {source})"


# ---- queries

SQL["scan_catalog"] = f"WITH {CATALOG} SELECT idx, title, artist, date, genre, style, idx || '.jpg' AS filename FROM catalog"
SQL["authority_load"] = "SELECT DISTINCT p_name AS name FROM part"
SQL["authority_build"] = """WITH ranked AS (
  SELECT CASE WHEN p_size <= 5 THEN 'Q' || p_partkey ELSE p_name END AS name FROM part
  JOIN (SELECT l_partkey, count(*) AS weight FROM lineitem GROUP BY 1) ON l_partkey = p_partkey
  ORDER BY weight DESC, p_partkey LIMIT 1000),
kept AS (SELECT name FROM ranked WHERE name <> '' AND name NOT LIKE 'Q%')
SELECT to_json(list(name ORDER BY name))::VARCHAR AS value FROM kept"""
SQL["known_ids"] = r"""SELECT DISTINCT regexp_replace(list_last(string_split(regexp_replace(url, '[?#].*$', ''), '/')), '\.jpg$', '') AS id FROM pages"""
SQL["asset_store"] = """SELECT doc_id::VARCHAR AS id, floor((('0x' || substr(md5('0|bucket|' || doc_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE) * 16)::INT AS bucket,
  strlen(text)::INT AS bytes, md5(text) AS digest FROM documents"""
SQL["asset_fetch"] = """SELECT p_partkey::VARCHAR AS id, coalesce(strlen(text), -1)::INT AS bytes, md5(text) AS digest
FROM (SELECT DISTINCT p_partkey FROM part) LEFT JOIN documents ON doc_id = p_partkey"""
SQL["metadata_roundtrip"] = f"WITH {HISTORY} SELECT {META} FROM history"
SQL["authority_filter"] = f"WITH {MATCHED} SELECT {META} FROM metadata"


def dataset(training):
    """Metadata, asset and cell of every kept item; the index is trained on the vectors of ``training``."""
    return f"""WITH {MATCHED}, {VECTORS}, training AS ({training}), {index('training')}
SELECT {', '.join('m.' + c for c in META.split(', '))}, coalesce(strlen(d.text), -1)::INT AS asset_bytes, coalesce(p.cell, -1)::INT AS cell
FROM metadata m LEFT JOIN documents d ON 'wikiart_' || d.doc_id = m.id LEFT JOIN postings p ON p.id = m.id"""


_KEPT = "SELECT v.* FROM vectors v JOIN metadata m ON v.id = m.id"
SQL["full_rebuild"] = dataset(_KEPT)
SQL["incremental_ingest"] = dataset(f"{_KEPT} WHERE m.genre = 'ECONOMY'")
SQL["stream_ingest"] = dataset("SELECT * FROM vectors")
SQL["incremental_limit"] = f"""WITH {MATCHED},
fresh AS (SELECT {META} FROM metadata WHERE genre <> 'ECONOMY' ORDER BY idx LIMIT 200)
SELECT {META} FROM metadata WHERE genre = 'ECONOMY' UNION ALL SELECT {META} FROM fresh"""
SQL["standard_schema"] = f"""WITH {CATALOG}, {NAMED}
SELECT 'wikiart_' || idx AS visual_id, coalesce(nullif(title, ''), 'Unknown Title') AS title, {title_case('raw')} AS artist,
  coalesce(genre, '') AS genre, coalesce(style, '') AS style, coalesce(date, '') AS date, 'wikiart_' || idx || '.jpg' AS filename,
  'hf://wikiart/' || idx AS "ImageURL", 'https://www.wikiart.org' AS "SourceURL", 'wikiart' AS "Source" FROM named"""
SQL["authority_passthrough"] = f"WITH {CATALOG}, {NAMED} {record(title_case('raw'))} FROM named"
_TIERS = f"WITH {CATALOG}, {AUTHORITY}, {prepared('names', 'catalog', 'artist')}, {prepared('known', 'authority', 'name')}"
SQL["match_exact"] = f"{_TIERS} SELECT n.name, min(a.name) AS canonical FROM names n JOIN known a ON n.norm = a.norm GROUP BY n.name"
SQL["match_token_set"] = f"{_TIERS} SELECT n.name, min(a.name) AS canonical FROM names n JOIN known a ON n.tokens = a.tokens GROUP BY n.name"
SQL["match_fuzzy"] = f"""{_TIERS}, {FORMS}
SELECT n.name, a.name AS canonical, s.score FROM scores s JOIN names n ON n.sorted = s.sorted JOIN known a ON a.sorted = s.other
WHERE s.score >= {ARTIST_THRESHOLD}"""
SQL["match_titles"] = f"""WITH l AS (SELECT DISTINCT 'The ' || p_name AS title, {normal_title("'The ' || p_name")} AS norm FROM part),
r AS (SELECT DISTINCT p_name AS title, {normal_title('p_name')} AS norm FROM part),
ordered AS (SELECT l.title AS left_title, r.title AS right_title, l.norm = r.norm AS same,
    CASE WHEN length(l.norm) <= length(r.norm) THEN l.norm ELSE r.norm END AS a,
    CASE WHEN length(l.norm) <= length(r.norm) THEN r.norm ELSE l.norm END AS b
  FROM l CROSS JOIN r WHERE l.norm <> '' AND r.norm <> ''),
scored AS (SELECT *, CASE WHEN same THEN 100 ELSE greatest({ratio('a', 'b')}, {partial('a', 'b')}) END AS score FROM ordered)
SELECT left_title, right_title, score FROM scored WHERE score >= 85"""
_TEXTS = f"WITH {CATALOG}, texts AS (SELECT 'd' || doc_id AS key, text FROM documents UNION ALL SELECT 'a' || idx, artist FROM catalog)"
for _name, _fn in {
    "fn_strip_diacritics": strip_diacritics, "fn_strip_parens": strip_parens, "fn_delimiters": delimiters, "fn_punct": punct,
    "fn_collapse_ws": collapse, "fn_normalize_name": normal_name, "fn_normalize_title": normal_title,
    "fn_title_case": lambda c: title_case(f"coalesce({c}, '')"),
}.items():
    SQL[_name] = f"{_TEXTS} SELECT key, {_fn('text')} AS out FROM texts"
SQL["fn_articles"] = f"""{_TEXTS}, lowered AS (SELECT key, lower(coalesce(text, '')) AS text FROM texts)
SELECT key, {leading_article('text')} AS out1, {trailing_article('text')} AS out2 FROM lowered"""


def pairs(a, b):
    return f"WITH {CATALOG}, pairs AS (SELECT DISTINCT {a} AS a, {b} AS b FROM catalog JOIN part ON idx = p_partkey WHERE artist IS NOT NULL)"


SQL["score_token_sort"] = f"""{pairs(normal_name('artist'), normal_name('p_name'))},
t AS (SELECT a, b, {sorted_tokens('a')} AS x, {sorted_tokens('b')} AS y FROM pairs)
SELECT a, b, {ratio('x', 'y')} AS score FROM t"""
SQL["score_long"] = f"""WITH turns AS (SELECT conv_id, turn, {normal_title('text')} AS a,
    lead(text) OVER later AS answer, lead(turn) OVER later AS following FROM conversations
    WINDOW later AS (PARTITION BY conv_id ORDER BY turn)),
pairs AS (SELECT conv_id, turn, a, {normal_title('answer')} AS b FROM turns WHERE following = turn + 1), {long_ratio('pairs')}
SELECT conv_id, turn, score FROM scored"""
SQL["score_sequence"] = f"""{pairs(normal_title('artist'), normal_title("p_type || ' ' || p_name"))},
t AS (SELECT a, b, CASE WHEN length(a) <= length(b) THEN a ELSE b END AS x, CASE WHEN length(a) <= length(b) THEN b ELSE a END AS y FROM pairs)
SELECT a, b, greatest({ratio('x', 'y')}, {partial('x', 'y')}) AS score FROM t"""

SQL["perturb_vector"] = f"""WITH {VECTORS}, {eval_queries(EVAL)}
SELECT id, transform, (i - 1)::INT AS pos, round(vec[i], 6) + 0.0::DOUBLE AS x FROM queries, range(1, 65) t(i)"""
_CONTRAST = f"queries AS (SELECT id AS qid, {perturbed('contrast')} AS vec FROM vectors)"
SQL["knn_exact"] = f"""WITH {VECTORS}, {_CONTRAST},
pairs AS (SELECT qid, id, {cosine('q.vec', 'v.vec')} AS confidence FROM queries q CROSS JOIN vectors v)
SELECT qid, id, confidence, row_number() OVER (PARTITION BY qid ORDER BY confidence DESC, id)::INT AS rank FROM pairs QUALIFY rank <= 5"""
SQL["knn_tiled"] = f"""WITH {VECTORS},
queries AS (SELECT id AS qid, {perturbed('contrast')} AS vec FROM vectors UNION ALL SELECT id, {perturbed('brightness')} FROM vectors),
stored AS (SELECT id, vec FROM vectors UNION ALL SELECT id, {perturbed('aged')} FROM vectors),
pairs AS (SELECT qid, id, max({cosine('q.vec', 'v.vec')}) AS confidence FROM queries q CROSS JOIN stored v GROUP BY ALL)
SELECT qid, id, confidence, row_number() OVER (PARTITION BY qid ORDER BY confidence DESC, id)::INT AS rank FROM pairs QUALIFY rank <= 5"""
SQL["hamming_search"] = f"""WITH {VECTORS},
changed AS (SELECT id AS qid, {perturbed('brightness')} AS vec FROM vectors UNION ALL SELECT id || 'c', {perturbed('contrast')} FROM vectors),
queries AS (SELECT qid, {signature('vec')} AS sig FROM changed), stored AS (SELECT id, {signature('vec')} AS sig FROM vectors),
pairs AS (SELECT qid, id, {differing('q.sig', 'v.sig')} AS distance FROM queries q CROSS JOIN stored v
  QUALIFY row_number() OVER (PARTITION BY qid ORDER BY distance, id) = 1)
SELECT qid, id, distance FROM pairs WHERE distance <= {CONFIG.max_hamming}"""
SQL["mutual_nn"] = f"""WITH {VECTORS}, l AS (SELECT id, {signature(f"({perturbed('contrast')})")} AS sig FROM vectors),
r AS (SELECT id, {signature('vec')} AS sig FROM vectors),
pairs AS (SELECT l.id AS left_id, r.id AS right_id, {differing('l.sig', 'r.sig')} AS distance FROM l CROSS JOIN r),
forth AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY left_id ORDER BY distance, right_id) = 1),
back AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY right_id ORDER BY distance, left_id) = 1)
SELECT left_id, right_id, f.distance, row_number() OVER (ORDER BY f.distance, left_id, right_id)::INT AS rank
FROM forth f JOIN back USING (left_id, right_id) WHERE f.distance <= {CONFIG.max_hamming} ORDER BY rank LIMIT 50"""
SQL["ivf_assign"] = f"WITH {VECTORS}, {index()} SELECT id, cell::INT AS cell, {sig_text('vec')} AS sig FROM postings"
SQL["ivf_append"] = f"""WITH {VECTORS}, training AS (SELECT * FROM vectors WHERE label < 5), {index('training')}
SELECT id, cell::INT AS cell, {sig_text('vec')} AS sig FROM postings"""
SQL["ivf_kmeans"] = f"""WITH {VECTORS}
SELECT q.id AS qid, min(v.id) AS label, 1.0::DOUBLE AS confidence, false AS fallback_used
FROM vectors q JOIN vectors v ON {cosine('q.vec', 'v.vec')} = 1.0 GROUP BY q.id"""
SQL["ivf_search"] = f"WITH {VECTORS}, {index()}, {_CONTRAST}, {search()} SELECT qid, label, confidence, fallback_used FROM hits"
_TWICE = f"queries AS (SELECT id AS qid, {perturbed('contrast')} AS vec FROM vectors UNION ALL SELECT id || 'a', {perturbed('aged')} FROM vectors)"
SQL["ivf_search_joined"] = f"""WITH {VECTORS}, training AS (SELECT * FROM vectors WHERE label < 5), {index('training')}, {_TWICE}, {search()}
SELECT qid, label, confidence, fallback_used FROM hits"""
SQL["index_stats"] = f"""WITH {VECTORS}, {index()}
SELECT count(DISTINCT id) AS n_images, count(*) AS n_features, count(DISTINCT cell) AS nlist, count(*) > 0 AS is_built FROM postings"""
SQL["dedupe_last"] = f"WITH {HISTORY} SELECT {META}, ord FROM latest"
SQL["search_lookup"] = f"""WITH {HISTORY}, {VECTORS}, {index()}, {_CONTRAST}, {search()}
SELECT qid, CASE WHEN m.id IS NULL THEN 'unknown' ELSE label END AS artwork_id, coalesce(m.title, 'Unknown') AS title,
  coalesce(m.artist, 'Unknown') AS artist, coalesce(m.url, '') AS source_url,
  CASE WHEN m.id IS NULL THEN 0.0 ELSE confidence END AS confidence, m.id IS NOT NULL AND fallback_used AS fallback_triggered,
  coalesce(m.genre, '') AS genre, coalesce(m.style, '') AS style, coalesce(m.date, '') AS date
FROM hits h LEFT JOIN latest m ON h.label = m.id"""
SQL["resolve_returned"] = f"""WITH {VECTORS},
pairs AS (SELECT s.id AS qid, v.id, {cosine('s.vec', 'v.vec')} AS score FROM vectors s CROSS JOIN vectors v),
second AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r FROM pairs QUALIFY r = 2 OR (r = 1 AND score < 0.9)),
detail AS (SELECT qid AS id, CASE WHEN score < 0.36 THEN 'Unknown' ELSE id END AS label FROM second),
store AS (SELECT 'wikiart_' || doc_id AS id, text, doc_id FROM documents), own AS (SELECT id, text FROM store WHERE doc_id % 2 = 0)
SELECT d.id, d.label,
  CASE WHEN d.id = d.label THEN 'same' WHEN s.id IS NOT NULL THEN 'sample' WHEN t.id IS NOT NULL AND d.label <> 'Unknown' THEN 'store' ELSE 'original' END AS origin,
  md5(CASE WHEN d.id = d.label THEN o.text ELSE coalesce(s.text, t.text, o.text) END) AS digest
FROM detail d LEFT JOIN own o ON o.id = d.id LEFT JOIN own s ON s.id = d.label LEFT JOIN store t ON t.id = d.label"""

SQL["sample_n"] = f"WITH {HISTORY} SELECT id FROM latest ORDER BY {sampled('id')}, id LIMIT 100"
SQL["eval_summary"] = f"WITH {evaluated(['contrast'])} SELECT {RATES} FROM detail"
SQL["eval_matrix"] = f"WITH {evaluated(EVAL)} SELECT transform, {RATES} FROM detail GROUP BY transform"


def summarized(transforms):
    return f"""WITH {evaluated(transforms)}, stored AS (SELECT count(DISTINCT id) AS n_images FROM postings),
summary AS (SELECT transform, count(*) AS n, sum(correct::INT)::BIGINT AS correct, 100 * avg(correct::INT) AS accuracy,
  100 * avg(fallback_used::INT) AS fallbacks, avg(latency_ms) AS avg_ms, quantile_cont(latency_ms, 0.95) AS p95_ms FROM detail GROUP BY transform)"""


_RULE = f"'{'=' * 56}'"
SQL["eval_report"] = f"""SELECT 'table' AS layout, unnest([{_RULE}, '  Transform        Accuracy    Fallback%       Avg ms       p95 ms', '  ' || repeat('-', 64)]
  || (SELECT list(line ORDER BY transform) FROM ({summarized(ALL)}
    SELECT transform, '  ' || rpad(transform, 12, ' ') || lpad({fixed('accuracy', 1)}, 13, ' ') || '%' || lpad({fixed('fallbacks', 1)}, 13, ' ') || '%'
      || lpad({fixed('avg_ms', 2)}, 13, ' ') || lpad({fixed('p95_ms', 2)}, 13, ' ') AS line FROM summary)) || [{_RULE}]) AS line
UNION ALL
SELECT 'block', unnest(lines) FROM ({summarized(['contrast'])}
  SELECT [{_RULE}, '  Transform:         ' || transform, '  Vault size:        ' || format('{{:,}}', n_images) || ' images',
    '  Evaluated:         ' || n || ' samples', '  Accuracy:          ' || correct || '/' || n || '  (' || {fixed('accuracy', 2)} || '%)',
    '  Fallbacks used:    ' || {fixed('fallbacks', 1)} || '%', '  Avg latency:       ' || {fixed('avg_ms', 2)} || ' ms',
    '  p95 latency:       ' || {fixed('p95_ms', 2)} || ' ms', {_RULE}] AS lines FROM summary, stored)"""
SQL["eval_latency"] = """SELECT event_type, count(value) AS n, round(avg(value), 6) AS avg_ms, round(quantile_cont(value, 0.95), 6) AS p95_ms
FROM events GROUP BY event_type"""
_PLACE = "CASE WHEN rank > 999 THEN rank::VARCHAR ELSE lpad(rank::VARCHAR, 3, '0') END"
SQL["eval_detail"] = f"""WITH {evaluated(ALL)},
places AS (SELECT id, row_number() OVER (ORDER BY {sampled('id')}, id) AS rank FROM vectors),
shown AS (SELECT d.*, p.rank, CASE WHEN correct THEN 'MATCH' ELSE 'FAIL' END AS status FROM detail d JOIN places p ON d.id = p.id
  WHERE p.rank <= 20 OR NOT correct)
SELECT transform, rank, status, id, label, confidence,
  '[' || {_PLACE} || '] ' || status || '  |  ' || id || '  →  ' || label || '  conf=' || {fixed('(confidence * 100)', 2)} || '%' AS title,
  {_PLACE} || '_' || lower(status) || '_' || id AS file_name FROM shown"""


def live(n):
    return f"""{HISTORY}, {VECTORS}, {LATENCY}, {index()},
asked AS (SELECT id, row_number() OVER (ORDER BY {sampled('id')}, id) AS rank FROM latest QUALIFY rank <= {n}),
queries AS (SELECT v.id AS qid, v.vec FROM vectors v JOIN asked a ON v.id = a.id), {search()},
detail AS (SELECT a.id, a.rank, coalesce(h.label = a.id, false) AS correct, CASE WHEN h.label IS NOT NULL THEN l.latency_ms END AS latency_ms
  FROM asked a LEFT JOIN hits h ON a.id = h.qid LEFT JOIN latency l ON a.id = l.id)"""


_LIVE = "count(*) AS n, sum(correct::INT)::BIGINT AS correct, round(100 * avg(correct::INT), 6) AS accuracy, round(coalesce(avg(latency_ms), 0), 6) AS avg_ms"
SQL["eval_live"] = f"WITH {live(100)} SELECT {_LIVE} FROM detail"
SQL["eval_scaling"] = f"""WITH {live(500)}
SELECT size, {_LIVE} FROM detail JOIN (VALUES (10), (50), (100), (250), (500)) s(size) ON rank <= size GROUP BY size"""
SQL["eval_stress"] = f"""WITH {HISTORY}, {VECTORS}, {LATENCY}, {index()},
asked AS (SELECT id, (['aged', 'brightness', 'contrast'])[floor({unit('scenario', 'id')} * 3)::INT + 1] AS scenario FROM latest),
queries AS (SELECT v.id AS qid, CASE scenario WHEN 'aged' THEN {perturbed('aged', 'v.vec').replace("|' || id", "|' || v.id")}
   WHEN 'brightness' THEN {perturbed('brightness', 'v.vec').replace("|' || id", "|' || v.id")}
   ELSE {perturbed('contrast', 'v.vec').replace("|' || id", "|' || v.id")} END AS vec
  FROM vectors v JOIN asked a ON v.id = a.id), {search()},
detail AS (SELECT a.scenario, coalesce(h.label = a.id, false) AS correct, CASE WHEN h.label IS NOT NULL THEN l.latency_ms END AS latency_ms
  FROM asked a LEFT JOIN hits h ON a.id = h.qid LEFT JOIN latency l ON a.id = l.id)
SELECT scenario, {_LIVE} FROM detail GROUP BY scenario UNION ALL SELECT 'overall', {_LIVE} FROM detail"""
SQL["diagnostics"] = f"WITH {MATCHED} SELECT count(*) AS paintings, count(DISTINCT artist) AS artists FROM metadata"
SQL["top_artists"] = f"""WITH {MATCHED}, counts AS (SELECT artist, count(*) AS paintings FROM metadata GROUP BY artist)
SELECT row_number() OVER (ORDER BY paintings DESC, artist)::INT AS rank, artist, paintings FROM counts ORDER BY rank LIMIT 100"""
