"""DuckDB SQL for the queries that SQL can express, over the same Parquet tables.

Plain quadratic or row-per-window ways, to compare with on small tables.
"""

from __future__ import annotations

REPEATS = r"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws
  FROM documents
),
windows AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS run
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM words)
),
later AS (
  SELECT doc_id, i FROM windows
  QUALIFY min(doc_id) OVER (PARTITION BY run) < doc_id
),
gone AS (
  SELECT DISTINCT doc_id, i + step AS i FROM later, range(13) AS steps(step)
),
runs AS (
  SELECT doc_id, min(i) - 1 AS lo, max(i) AS hi
  FROM (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS island FROM gone)
  GROUP BY doc_id, island
),
listed AS (
  SELECT doc_id, CAST(sum(hi - lo) AS BIGINT) AS n, string_agg(lo || ':' || hi, ',' ORDER BY lo) AS spans FROM runs GROUP BY doc_id
),
rest AS (
  SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS body
  FROM (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM words) ANTI JOIN gone USING (doc_id, i)
  GROUP BY doc_id
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed,
       sha256(coalesce(body, '')) AS kept_sha256, coalesce(spans, '') AS repeats
FROM words LEFT JOIN listed USING (doc_id) LEFT JOIN rest USING (doc_id)
"""

VECTORS = """
WITH RECURSIVE usable AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND list_max(list_transform(embedding, lambda x: abs(x))) > 0
),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable AS a JOIN usable AS b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
),
reach(vec_id, other) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT reach.vec_id, links.b FROM reach JOIN links ON reach.other = links.a
),
components AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
degrees AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM components LEFT JOIN degrees USING (vec_id)
"""

TOP_K = r"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws
  FROM documents
),
sizes AS (SELECT count(*) AS docs, avg(len(ws)) AS average FROM words),
postings AS (
  SELECT doc_id, w, count(*) AS tf, any_value(size) AS size
  FROM (SELECT doc_id, unnest(ws) AS w, len(ws) AS size FROM words) GROUP BY doc_id, w
),
idfs AS (
  SELECT w, ln(1 + (any_value(docs) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM postings, sizes GROUP BY w
),
scored AS (
  SELECT q.doc_id AS query_id, d.doc_id,
         round(sum(idf * d.tf * 2.2 / (d.tf + 1.2 * (0.25 + 0.75 * d.size / average))), 9) AS score
  FROM postings AS q JOIN postings AS d USING (w) JOIN idfs USING (w), sizes
  WHERE q.doc_id % 20 = 0 GROUP BY q.doc_id, d.doc_id
)
SELECT query_id, CAST(place AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS place FROM scored)
WHERE place <= 10
"""

# Steps of a bitwise CRC-32 over the decimal digits of an id: a digit is added, or (-1) a bit shifted out.
CRC32 = """xor(4294967295, list_reduce(
    list_concat([4294967295], flatten(list_transform(string_split(CAST({id} AS VARCHAR), ''),
                                                     lambda c: [ascii(c), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda crc, e: CASE WHEN e >= 0 THEN xor(crc, e) ELSE xor(crc >> 1, (crc & 1) * 3988292384) END))"""


def _leaf(text: str) -> str:
    parts = [
        f"CASE WHEN {v} IS NULL THEN '-' ELSE strlen(CAST({v} AS VARCHAR)) || ':' || {v} END"
        for v in ("doc_id", "source", "lang", "n_chars", text)
    ]
    return f"sha256({' || '.join(parts)})"


LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _tree(name: str, leaves: str, grp: str) -> str:
    """Levels of the trees over ``leaves`` (grp, pos, node), and what stands beside each node."""
    return f"""
{name} AS (
  SELECT {grp}, 0 AS level, pos, count(*) OVER (PARTITION BY {grp}) AS n, node FROM {leaves}
  UNION ALL
  SELECT {grp}, level + 1, pos // 16, any_value((n + 15) // 16), sha256(string_agg(node, '' ORDER BY pos))
  FROM {name} WHERE n > 1 GROUP BY {grp}, level, pos // 16
),
{name}_beside AS (
  SELECT {grp}, level, pos,
         coalesce(string_agg(node, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
         coalesce(string_agg(node, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
  FROM {name} WHERE n > 1 WINDOW run AS (PARTITION BY {grp}, level, pos // 16 ORDER BY pos)
)"""


def _climb(name: str, rows: str, tree: str, grp: str) -> str:
    """``rows`` (id, grp, pos, h, proof) step by step up to the root of their tree."""
    return f"""
{name} AS (
  SELECT id, {grp}, 0 AS level, pos, h, proof FROM {rows}
  UNION ALL
  SELECT id, {grp}, level + 1, pos // 16, sha256(before || h || after), proof || before || after
  FROM {name} JOIN {tree}_beside USING ({grp}, level, pos)
)"""


MANIFEST = f"""
WITH RECURSIVE hashed AS (
  SELECT *, coalesce(source, '') || '/' || (source IS NULL) AS grp, {_leaf("text")} AS node,
         CASE WHEN doc_id IS NOT NULL AND {CRC32.format(id="coalesce(doc_id, 0)")} % 5 = 0
              THEN {_leaf(LOWERED)} ELSE {_leaf("text")} END AS h
  FROM documents
),
leaves AS (
  SELECT doc_id, source, grp, node, h, '' AS proof, row_number() OVER () AS id,
         row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, node) - 1 AS pos
  FROM hashed
),
{_tree("tree", "leaves", "grp")},
subroots AS (
  SELECT grp, node, 0 AS one, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos
  FROM tree JOIN (SELECT DISTINCT grp, source FROM leaves) USING (grp) WHERE n = 1
),
{_tree("forest", "subroots", "one")},
{_climb("climbed", "leaves", "tree", "grp")},
middle AS (
  SELECT climbed.id, 0 AS one, s.pos, climbed.h, climbed.proof
  FROM climbed JOIN tree ON tree.grp = climbed.grp AND tree.level = climbed.level AND tree.n = 1
       JOIN subroots AS s ON s.grp = climbed.grp
),
{_climb("topped", "middle", "forest", "one")}
SELECT leaves.doc_id, leaves.node AS leaf, s.node AS subroot, forest.node AS root, sha256(t.proof) AS proof_sha256,
       t.h AS folded_root, t.h = forest.node AS verified
FROM leaves JOIN subroots AS s USING (grp) JOIN forest ON forest.n = 1
     JOIN topped AS t ON t.id = leaves.id AND t.level = forest.level
"""

# Every conversation as rows of its own, a node by the digest of its path, and subtrees by what lies on members' paths.
CONVERSATIONS = f"""
WITH placed AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL
),
shapes AS (
  SELECT c.conv_id, c.conv_id - c.conv_id % 5 AS base, {CRC32.format(id="c.conv_id")} % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM placed) AS c
),
pieces AS (
  SELECT shapes.conv_id, 0 AS part, pos, role, text FROM shapes JOIN placed ON placed.conv_id = base WHERE pos < h
  UNION ALL
  SELECT conv_id, 1, pos, role, text FROM shapes JOIN placed USING (conv_id) WHERE pos >= h
),
turns AS (
  SELECT conv_id, row_number() OVER path AS depth, strlen(text) AS octets,
         sha256(string_agg(sha256(strlen(role) || ':' || role || text), '') OVER path) AS node
  FROM pieces WINDOW path AS (PARTITION BY conv_id ORDER BY part, pos)
),
paths AS (
  SELECT *, lag(node, 1, '') OVER (PARTITION BY conv_id ORDER BY depth) AS parent FROM turns
  UNION ALL
  SELECT conv_id, 0, 0, '', NULL FROM shapes
),
nodes AS (
  SELECT node, min(conv_id) AS conv_id, any_value(depth) AS depth, any_value(parent) AS parent, count(*) AS n_convs,
         (count(*) - 1) * any_value(octets) AS saved
  FROM paths GROUP BY node
),
degrees AS (
  SELECT n.node, count(c.node) AS n_children FROM nodes AS n LEFT JOIN nodes AS c ON c.parent = n.node GROUP BY n.node
),
below AS (
  SELECT DISTINCT a.node AS top, b.node FROM paths AS a JOIN paths AS b USING (conv_id) WHERE b.depth >= a.depth
),
totals AS (
  SELECT top AS node, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens
  FROM below JOIN nodes USING (node) JOIN degrees USING (node) GROUP BY top
),
ends AS (
  SELECT node, string_agg(conv_id, ',' ORDER BY conv_id) AS ids
  FROM (SELECT * FROM paths QUALIFY depth = max(depth) OVER (PARTITION BY conv_id)) GROUP BY node
)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, n_children, n_leaves, saved_tokens,
       sha256(coalesce(ids, '')) AS ends_sha256
FROM nodes AS n LEFT JOIN nodes AS p ON p.node = n.parent JOIN degrees ON degrees.node = n.node
     JOIN totals ON totals.node = n.node LEFT JOIN ends ON ends.node = n.node
"""


def _digests(text: str) -> str:
    """The distinct 43-bit paragraph digests of a text, each with its 20-bit check value."""
    parts = f"list_transform(regexp_extract_all({text}, '[^\\n]{{1,160}}[^\\n.!?]{{0,160}}[.!?\\n]*|\\n+'), lambda p: rtrim(p, chr(10)))"
    number = "CAST('0x' || substr(md5(p), 1, 11) AS BIGINT) & 8796093022207"
    digests = f"list_transform(list_filter({parts}, lambda p: p <> ''), lambda p: {number})"
    return f"list_distinct(list_transform({digests}, lambda d: (d << 20) | (d * 1000003 % 1048573)))"


# Likeness from whole sets of paragraphs; cells by grouping digests.
FINGERPRINTS = f"""
WITH placed AS (
  SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS body,
         coalesce(lead(coalesce(text, '')) OVER whole, first_value(coalesce(text, '')) OVER whole) AS following
  FROM documents WINDOW whole AS (ORDER BY doc_id DESC NULLS LAST, coalesce(text, ''))
),
texts AS (
  SELECT id, doc_id, length(body) AS n_chars, body, following,
         substr(body, 1, length(body) - length(body) // 2) || substr(following, 1, length(body) // 2) AS edited
  FROM placed
),
sets AS (
  SELECT id, doc_id, n_chars, sha256(edited) AS edited_sha256, {_digests("body")} AS a, {_digests("edited")} AS e,
         {_digests("following")} AS f
  FROM texts
),
entries AS (
  SELECT id, 'a' AS version, unnest(a) AS key FROM sets UNION ALL SELECT id, 'e', unnest(e) FROM sets
),
cells AS (
  SELECT id, version, 8 * block + ((key >> (20 + 3 * block)) & 7) AS cell, count(*) AS n, bit_xor(key) AS keys
  FROM entries, (SELECT CAST(range AS INTEGER) AS block FROM range(3)) GROUP BY ALL
),
shown AS (
  SELECT id, version, string_agg(lpad(lower(hex(coalesce(n, 0) & 65535)), 4, '0') || lpad(lower(hex(coalesce(keys, 0))), 16, '0'),
                                 '' ORDER BY cell) AS print
  FROM (SELECT id, version, CAST(range AS INTEGER) AS cell FROM sets, (VALUES ('a'), ('e')) AS v(version), range(24))
       LEFT JOIN cells USING (id, version, cell)
  GROUP BY id, version
)
SELECT doc_id, n_chars, edited_sha256, own.print AS fingerprint, other.print AS edited_fingerprint,
       CASE WHEN len(a) + len(e) = 0 THEN 1 ELSE len(list_intersect(a, e)) / len(list_distinct(a || e)) END AS near_edited,
       CASE WHEN len(a) + len(f) = 0 THEN 1 ELSE len(list_intersect(a, f)) / len(list_distinct(a || f)) END AS near_next,
       len(a) AS n_paragraphs, len(a) - len(list_intersect(a, e)) AS n_removed, len(e) - len(list_intersect(a, e)) AS n_added
FROM sets JOIN shown AS own ON own.id = sets.id AND own.version = 'a' JOIN shown AS other ON other.id = sets.id AND other.version = 'e'
"""


def all_oracles() -> dict[str, str]:
    return {
        "op2_substring_dedup": REPEATS,
        "op5_embedding_near_dedup": VECTORS,
        "op9_bm25_top_k": TOP_K,
        "op11_document_fingerprints": FINGERPRINTS,
        "op12_conversation_trie": CONVERSATIONS,
        "op13_merkle_manifest": MANIFEST,
    }
