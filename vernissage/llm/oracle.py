"""DuckDB twins of the queries that SQL can express."""

from __future__ import annotations

SQL = {
    "op1_exact_dedup": r"""
        WITH t AS (
          SELECT doc_id, length(coalesce(text, '')) AS size,
                 sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
          FROM documents)
        SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER same AS group_size,
               row_number() OVER best = 1 AS kept, text_sha256
        FROM t
        WINDOW same AS (PARTITION BY text_sha256), best AS (PARTITION BY text_sha256 ORDER BY size DESC, doc_id)""",
    "op7_line_dedup": r"""
        WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        k AS (
          SELECT doc_id, lines, list_transform(lines, lambda x: translate(
                   trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS keys
          FROM d),
        often AS (
          SELECT key FROM (SELECT unnest(list_distinct(keys)) AS key FROM k)
          WHERE length(key) >= 1 GROUP BY key HAVING count(*) >= 10),
        l AS (
          SELECT doc_id, unnest(lines) AS line, unnest(keys) AS key, unnest(range(len(lines))) AS pos FROM k),
        m AS (SELECT l.*, often.key IS NOT NULL AS hit FROM l LEFT JOIN often ON l.key = often.key)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE hit) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT hit), '')) AS kept_sha256
        FROM m GROUP BY doc_id""",
    "op9_licence_scan": """
        SELECT doc_id, len(string_split(coalesce(text, ''), chr(10))) AS n_paragraphs,
               concat_ws(',',
                 CASE WHEN contains(text, 'Licensed under the Apache License, Version 2.0') THEN 'Apache-2.0' END,
                 CASE WHEN contains(text, 'Licensed under CC BY-NC 4.0') THEN 'CC-BY-NC' END,
                 CASE WHEN contains(text, 'licensed under the GNU General Public License, version 3') THEN 'GPL' END,
                 CASE WHEN contains(text, 'Released under the MIT License') THEN 'MIT' END) AS licences
        FROM documents""",
    "op12_hard_negatives": """
        WITH e AS (
          SELECT row_number() OVER () AS n, vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                 list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
          FROM embeddings
          WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
          SELECT a.n AS anchor, a.id AS anchor_id, r.id, r.label = a.label AS same,
                 CAST(coalesce(list_sum(list_transform(list_zip(a.v, r.v), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
          FROM e a JOIN e r ON a.n <> r.n WHERE a.id % 100 = 0),
        p AS (
          SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) AS nth FROM s WHERE same
          QUALIFY nth <= 5)
        SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.anchor, p.nth ORDER BY s.score DESC, s.id) AS rank,
               s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
        FROM p JOIN s ON p.anchor = s.anchor
        WHERE NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score
        QUALIFY rank <= 5""",
    "op13_collocations": r"""
        WITH pieces AS (
          SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
          FROM documents),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
        g AS (
          SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase
          FROM w, (SELECT unnest(range(1, 6)) AS k)),
        f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL),
        t AS (SELECT lang, sum(a) AS n FROM f WHERE k = 1 GROUP BY lang),
        c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND a >= 100),
        cuts AS (
          SELECT lang, phrase, k, a, cut, array_to_string(ws[1:cut], ' ') AS one, array_to_string(ws[cut + 1:], ' ') AS two
          FROM (SELECT *, unnest(range(1, k)) AS cut FROM c)),
        scored AS (
          SELECT cuts.*, x.a AS l, y.a AS r, t.n, (1000 * cuts.a::HUGEINT * t.n::HUGEINT) // (x.a::HUGEINT * y.a::HUGEINT) AS score
          FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = cuts.one JOIN f y ON y.lang = cuts.lang AND y.phrase = cuts.two
          JOIN t ON t.lang = cuts.lang),
        best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
        inner_phrases AS (
          SELECT lang, a AS longer, unnest(flatten(list_transform(range(2, k), lambda m:
                   list_transform(range(1, k - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' '))))) AS phrase
          FROM c WHERE k > 2),
        gone AS (SELECT DISTINCT i.lang, i.phrase FROM inner_phrases i JOIN c ON c.lang = i.lang AND c.phrase = i.phrase WHERE 100 * i.longer >= 100 * c.a),
        ranked AS (
          SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank
          FROM best ANTI JOIN gone USING (lang, phrase))
        SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000""",
}
