"""SQL of the queries on spelling variants, manifests and MinHash, as DuckDB runs it."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _crc_table() -> list[int]:
    """The 256 entries of the reflected CRC-32 polynomial."""
    table = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ 0xEDB88320 if value & 1 else value >> 1
        table.append(value)
    return table


def crc32(text: str) -> str:
    """SQL for the unsigned CRC-32 of a text's UTF-8 bytes; ``crc.t`` must be in scope."""
    octets = f"list_transform(range(0, octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, o: xor(c >> 8, crc.t[xor(c & 255, o) + 1])), 4294967295)"


CRC = f"crc AS (SELECT {_crc_table()}::BIGINT[] AS t)"

SPELLING = f"""
WITH RECURSIVE {CRC},
runs AS (
  SELECT doc_id, r, count(*) AS c FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[a-zÀ-ÿ]+')) AS r FROM documents
  ) GROUP BY doc_id, r
), hashed AS (SELECT r, c, {crc32("doc_id || ':' || r")} AS h FROM runs, crc),
words AS (
  SELECT w AS word, CAST(sum(c) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 31 = 0 THEN substr(r, 1, CAST(h % length(r) AS BIGINT)) || substr(r, CAST(h % length(r) AS BIGINT) + 2) ELSE r END AS w, c FROM hashed
  ) WHERE length(w) >= 7 GROUP BY w HAVING sum(c) >= 2
), less AS (
  SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS s FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM words)
), pairs AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM less a JOIN less b ON a.s = b.s AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less b JOIN words a ON a.word = b.s
  UNION SELECT b.word, a.word, a.n FROM less b JOIN words a ON a.word = b.s
), near AS (
  SELECT word, count(*) AS n_near, max(other_n) AS form_n, arg_min(other, (-other_n, other)) AS form FROM pairs GROUP BY word
), linked AS (
  SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * n THEN form END AS form, CASE WHEN form_n >= 10 * n THEN form_n END AS form_n
  FROM words w LEFT JOIN near ON w.word = near.word
), up AS (
  SELECT word, word AS root, form AS next FROM linked
  UNION ALL SELECT up.word, up.next, l.form FROM up JOIN linked l ON l.word = up.next
)
SELECT l.word, form, root, n, n_near, form_n FROM linked l JOIN up ON up.word = l.word AND up.next IS NULL"""


def _value(column: str) -> str:
    """A leaf's part for one value."""
    return f"coalesce(octet_length(encode(CAST({column} AS VARCHAR))) || ':' || {column}, '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_value(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


#: One recursion climbs all trees, of leaves and of groups, a level at a time; another folds every leaf.
MANIFEST = f"""
WITH RECURSIVE {CRC},
rows AS (
  SELECT doc_id, coalesce('=' || lang, '') AS g, {_leaf("n_chars")} AS leaf,
         CASE WHEN {crc32("CAST(doc_id AS VARCHAR)")} % 7 = 0 THEN {_leaf("(n_chars + 1)")} ELSE {_leaf("n_chars")} END AS other
  FROM documents, crc
), leaves AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM rows),
climb AS (
  SELECT g, 0 AS level, pos, leaf AS node, count(*) OVER (PARTITION BY g) AS n FROM leaves
  UNION ALL
  SELECT g, level + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)), (any_value(n) + 1) // 2
  FROM climb WHERE n > 1 GROUP BY g, level, pos // 2
), subroots AS (SELECT g, level AS height, node AS subroot, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM climb WHERE n = 1),
over AS (
  SELECT 0 AS level, pos, subroot AS node, n FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)), (any_value(n) + 1) // 2 FROM over WHERE n > 1 GROUP BY level, pos // 2
), fold AS (
  SELECT doc_id, leaf, subroot, l.g, 0 AS level, l.pos, height, s.pos AS group_pos, other AS node, '' AS proof
  FROM leaves l JOIN subroots s ON l.g = s.g
  UNION ALL
  SELECT doc_id, leaf, subroot, f.g, f.level + 1, CASE WHEN f.level + 1 = height THEN group_pos ELSE f.pos // 2 END, height, group_pos,
         sha256(CASE WHEN s.node IS NULL THEN f.node WHEN f.pos % 2 = 0 THEN f.node || s.node ELSE s.node || f.node END), proof || coalesce(s.node, '')
  FROM fold f LEFT JOIN climb s ON s.g = f.g AND s.level = f.level AND s.pos = xor(f.pos, 1)
  WHERE f.level < height
), up AS (
  SELECT doc_id, leaf, subroot, 0 AS level, group_pos AS pos, node, proof FROM fold WHERE level = height
  UNION ALL
  SELECT doc_id, leaf, subroot, u.level + 1, u.pos // 2,
         sha256(CASE WHEN s.node IS NULL THEN u.node WHEN u.pos % 2 = 0 THEN u.node || s.node ELSE s.node || u.node END), proof || coalesce(s.node, '')
  FROM up u LEFT JOIN over s ON s.level = u.level AND s.pos = xor(u.pos, 1)
  WHERE u.level < (SELECT max(level) FROM over)
)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, u.node AS folded_root, u.node = root AS verified
FROM up u, (SELECT level, node AS root FROM over WHERE n = 1) r WHERE u.level = r.level"""


#: All pairs that share a shingle, and a recursion along the links.
MINHASH = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                 ELSE list_sort(list_distinct(list_transform(range(0, len(w) - 4), lambda i: array_to_string(w[i + 1 : i + 5], ' ')))) END AS s FROM w
), nodes AS (SELECT min(doc_id) AS node, s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
shingles AS (SELECT node, n, unnest(s) AS x FROM nodes),
links AS (
  SELECT a.node AS a, b.node AS b FROM shingles a JOIN shingles b ON a.x = b.x AND a.node < b.node AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT node, node AS other FROM nodes UNION SELECT node, b FROM reach JOIN ways ON other = a),
least AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node)
SELECT doc_id, len(sets.s) AS n_shingles, coalesce(component_id, doc_id) AS component_id, doc_id = coalesce(component_id, doc_id) AS kept
FROM sets LEFT JOIN nodes ON sets.s = nodes.s LEFT JOIN least ON least.node = nodes.node"""
