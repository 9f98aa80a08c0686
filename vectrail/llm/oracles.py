"""SQL that gives the same rows as some of the queries, for tables of a few megabytes."""

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all(coalesce({_LOWER}, ''), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"

DECONTAMINATE = f"""
WITH items AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, {_WORDS} AS words FROM benchmark),
sized AS (SELECT item, words, CAST(least(13, len(words)) AS BIGINT) AS n FROM items WHERE len(words) > 0),
windows AS (SELECT DISTINCT item, n, array_to_string(words[i : i + n - 1], ' ') AS w FROM (SELECT *, unnest(range(1, len(words) - n + 2)) AS i FROM sized)),
docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS words FROM documents),
places AS (SELECT r, n, i, array_to_string(words[i : i + n - 1], ' ') AS w FROM (SELECT r, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(words) >= n)),
hits AS (SELECT DISTINCT r, i, n, item FROM places JOIN windows USING (n, w)),
hit_words AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS place FROM hits) GROUP BY 1),
found AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS list FROM hits GROUP BY 1)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(list, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM docs LEFT JOIN hit_words USING (r) LEFT JOIN found USING (r)
"""

SUBSTRINGS = """
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+') AS words FROM documents),
windows AS (SELECT doc_id, i, array_to_string(words[i : i + 19], ' ') AS w FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM docs WHERE len(words) >= 20)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS n FROM windows) WHERE n > 1),
gone AS (SELECT doc_id, list(DISTINCT place) AS place FROM (SELECT doc_id, unnest(range(i, i + 20)) AS place FROM later) GROUP BY 1),
kept AS (SELECT doc_id, len(words) AS n, coalesce(len(place), 0) AS r, CASE WHEN place IS NULL THEN words ELSE list_select(words, list_filter(range(1, len(words) + 1), lambda x: NOT list_contains(place, x))) END AS rest FROM docs LEFT JOIN gone USING (doc_id))
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(r AS BIGINT) AS n_removed, sha256(array_to_string(rest, ' ')) AS kept_sha256 FROM kept
"""
