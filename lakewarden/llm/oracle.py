"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations


def _crc32(text: str) -> str:
    """Unsigned CRC-32 of an ASCII text: every byte is xored in, then eight bits are shifted out."""
    steps = f"flatten(list_transform(range(1, length({text}) + 1), lambda i: list_concat([ascii({text}[i])], [-1, -1, -1, -1, -1, -1, -1, -1])))"
    shift = "xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END)"
    return f"xor(list_reduce({steps}, lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE {shift} END, 4294967295), 4294967295)"


def _field(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


_LEAF = "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "{n}", "text")) + ")"


def _tree(name: str, leaves: str, group: str) -> str:
    """Recursive levels of the trees over ``leaves`` (group, place, leaf)."""
    return f"""{name} AS (
  SELECT {group} AS tree, 0 AS level, place, count(*) OVER (PARTITION BY {group}) AS total, leaf AS node FROM {leaves}
  UNION ALL
  SELECT tree, level + 1, place // 2, (total + 1) // 2, sha256(string_agg(node, '' ORDER BY place)) FROM {name}
  WHERE total > 1 GROUP BY tree, level, place // 2, total
)"""


def _steps(nodes: str, leaves: str, key: str, tree: str) -> str:
    """For each leaf the steps to its root: L or R and the sibling, or - where it has none."""
    return f"""(
  SELECT l.{key} AS leaf_key, list(CASE WHEN s.node IS NULL THEN '-' WHEN s.place < n.place THEN 'L' || s.node ELSE 'R' || s.node END ORDER BY n.level) AS steps
  FROM {leaves} l
  JOIN {nodes} n ON n.tree = {tree} AND n.place = l.place >> n.level AND n.total > 1
  LEFT JOIN {nodes} s ON s.tree = n.tree AND s.level = n.level AND s.place = xor(n.place, 1)
  GROUP BY l.{key})"""


MERKLE = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, coalesce('=' || lang, '-') AS tree, {_LEAF.format(n="n_chars")} AS leaf,
    {_crc32("CAST(doc_id AS VARCHAR)")} % 7 = 0 AS spoiled, {_LEAF.format(n="n_chars + 1")} AS spoiled_leaf
  FROM documents
), low_leaves AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id) - 1 AS place FROM leaves
), {_tree("low", "low_leaves", "tree")}
, subroots AS (SELECT tree AS lang, node AS leaf FROM low WHERE total = 1)
, high_leaves AS (
  SELECT *, row_number() OVER (ORDER BY lang) - 1 AS place, 'top' AS tree FROM subroots
), {_tree("high", "high_leaves", "tree")}
, folds AS (
  SELECT l.doc_id, l.leaf, s.leaf AS subroot, (SELECT node FROM high WHERE total = 1) AS root,
    CASE WHEN l.spoiled THEN l.spoiled_leaf ELSE l.leaf END AS start,
    list_concat(coalesce(a.steps, []), coalesce(b.steps, [])) AS steps
  FROM low_leaves l
  JOIN subroots s ON s.lang = l.tree
  LEFT JOIN {_steps("low", "low_leaves", "doc_id", "l.tree")} a ON a.leaf_key = l.doc_id
  LEFT JOIN {_steps("high", "high_leaves", "lang", "l.tree")} b ON b.leaf_key = l.tree
), ends AS (
  SELECT *, list_reduce(steps, lambda a, s: sha256(CASE s[1] WHEN 'L' THEN s[2:] || a WHEN 'R' THEN a || s[2:] ELSE a END), start) AS folded_root
  FROM folds
)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(steps, lambda s: s[2:]), '')) AS proof_sha256,
  folded_root, folded_root = root AS verified
FROM ends
"""

COLLOCATIONS = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\n-\\r]')) AS piece
  FROM documents
), words AS (
  SELECT lang, row_number() OVER () AS piece_no, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda x: x <> '') AS w FROM pieces
), places AS (
  SELECT lang, piece_no, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM words
), leads AS (
  SELECT lang, word AS w1, word || ' ' || lead(word, 1) OVER piece AS w2, word || ' ' || lead(word, 1) OVER piece || ' ' || lead(word, 2) OVER piece AS w3
  FROM places WINDOW piece AS (PARTITION BY piece_no ORDER BY i)
), grams AS (
  SELECT lang, 1 AS size, w1 AS phrase, count(*) AS f FROM leads GROUP BY ALL
  UNION ALL SELECT lang, 2, w2, count(*) FROM leads WHERE w2 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 3, w3, count(*) FROM leads WHERE w3 IS NOT NULL GROUP BY ALL
), totals AS (
  SELECT lang, sum(f) AS n FROM grams WHERE size = 1 GROUP BY lang
), candidates AS (
  SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM grams WHERE size > 1 AND f >= 10
), cuts AS (
  SELECT c.lang, c.size, c.phrase, c.a, c.w, k, l.f AS l, r.f AS r,
    (1000000::HUGEINT * c.a * c.a) // (l.f::HUGEINT * r.f) AS score
  FROM candidates c, (VALUES (1), (2)) t(k)
  JOIN grams l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:k], ' ')
  JOIN grams r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[k + 1:], ' ')
  WHERE k < c.size
), best AS (
  SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM cuts
), free AS (
  SELECT * FROM best b WHERE nth = 1 AND NOT EXISTS (
    SELECT 1 FROM candidates c WHERE c.lang = b.lang AND c.size > b.size AND 100 * c.a >= 50 * b.a
      AND (array_to_string(c.w[1:2], ' ') = b.phrase OR array_to_string(c.w[2:3], ' ') = b.phrase))
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM free
)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
