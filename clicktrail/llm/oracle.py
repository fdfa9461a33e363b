"""The text operators' results in DuckDB SQL, where SQL can say them."""

CRC32 = """list_reduce(list_prepend(4294967295::UBIGINT, flatten(list_transform(string_split({text}, ''), lambda c: [ascii(c)::UBIGINT, 0, 0, 0, 0, 0, 0, 0]))),
  lambda c, b: xor(xor(c, b) >> 1, (xor(c, b) & 1) * 3988292384::UBIGINT))"""
"""Bit by bit, without a table; the complement of the CRC."""

MERKLE = f"""WITH RECURSIVE
told AS (SELECT *, {CRC32.format(text="doc_id::VARCHAR")} AS crc FROM documents),
cells AS (SELECT *, unnest([false, true]) AS forged FROM told),
texts AS (SELECT doc_id, source, lang, n_chars, forged, xor(crc, 4294967295::UBIGINT) % 5 = 0 AS tampered,
  CASE WHEN forged THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS text FROM cells),
hashed AS (SELECT doc_id, source, forged, tampered, sha256(concat(
  coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'),
  coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-'), coalesce(strlen(text) || ':' || text, '-'))) AS leaf FROM texts),
leaves AS (SELECT a.doc_id, coalesce('=' || a.source, '-') AS grp, a.leaf, CASE WHEN a.tampered THEN b.leaf ELSE a.leaf END AS given
  FROM hashed a JOIN hashed b ON a.doc_id = b.doc_id AND NOT a.forged AND b.forged),
placed AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n FROM leaves),
tree AS (SELECT grp, 0 AS lvl, pos, n, leaf AS digest FROM placed
  UNION ALL SELECT grp, lvl + 1, pos // 16, (max(n) + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos)) FROM tree WHERE n > 1 GROUP BY grp, lvl, pos // 16),
groups AS (SELECT grp, digest, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
top AS (SELECT 0 AS lvl, pos, n, digest FROM groups
  UNION ALL SELECT lvl + 1, pos // 16, (max(n) + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY lvl, pos // 16),
own AS (SELECT p.doc_id, p.grp, p.leaf, p.given, p.pos, g.pos AS top_pos, g.digest AS subroot, r.digest AS root
  FROM placed p JOIN groups g ON p.grp = g.grp, (SELECT digest FROM top WHERE n = 1) r),
sides AS (SELECT o.doc_id, t.lvl AS step, t.pos, t.digest, o.pos // (16 ** t.lvl)::BIGINT AS mine FROM own o JOIN tree t
    ON o.grp = t.grp AND t.n > 1 AND t.pos // 16 = o.pos // (16 ** (t.lvl + 1))::BIGINT
  UNION ALL SELECT o.doc_id, 100 + t.lvl, t.pos, t.digest, o.top_pos // (16 ** t.lvl)::BIGINT FROM own o JOIN top t
    ON t.n > 1 AND t.pos // 16 = o.top_pos // (16 ** (t.lvl + 1))::BIGINT),
joined AS (SELECT doc_id, step, coalesce(string_agg(digest, '' ORDER BY pos) FILTER (pos < mine), '') AS lefts,
  coalesce(string_agg(digest, '' ORDER BY pos) FILTER (pos > mine), '') AS rights FROM sides GROUP BY doc_id, step),
steps AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY step) AS k FROM joined),
fold AS (SELECT doc_id, 0 AS k, given AS digest FROM own
  UNION ALL SELECT f.doc_id, s.k, sha256(s.lefts || f.digest || s.rights) FROM fold f JOIN steps s ON f.doc_id = s.doc_id AND s.k = f.k + 1),
ends AS (SELECT doc_id, arg_max(digest, k) AS folded_root FROM fold GROUP BY doc_id),
proofs AS (SELECT doc_id, string_agg(lefts || rights, '' ORDER BY k) AS proof FROM steps GROUP BY doc_id)
SELECT o.doc_id, o.leaf, o.subroot, o.root, sha256(coalesce(p.proof, '')) AS proof_sha256, e.folded_root, e.folded_root = o.root AS verified
FROM own o JOIN ends e ON o.doc_id = e.doc_id LEFT JOIN proofs p ON o.doc_id = p.doc_id"""

TOP_PRODUCTS = """WITH whole AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 64)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)))),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x::DOUBLE[], c.x::DOUBLE[])::BIGINT AS score
  FROM whole q JOIN whole c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= 20"""

JACCARD = r"""WITH RECURSIVE
words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\x0B\f\r]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
sized AS (SELECT doc_id, len(s) AS n, s FROM sets),
shingles AS (SELECT doc_id, n, md5(unnest(s)) AS h FROM sized),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS shared
  FROM shingles a JOIN shingles b ON a.h = b.h AND a.doc_id <> b.doc_id AND 4 * least(a.n, b.n) >= 3 * greatest(a.n, b.n) GROUP BY ALL),
links AS (SELECT a, b FROM common WHERE 100 * shared >= 75 * (na + nb - shared)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, d.n::BIGINT AS n_shingles, min(r.b) AS component_id FROM sized d JOIN reach r ON r.a = d.doc_id GROUP BY d.doc_id, d.n"""
