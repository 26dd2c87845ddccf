"""DuckDB SQL of op11, op12 and op13, written apart from the operators."""

from __future__ import annotations

#: CRC-32 of a string of ASCII characters, bit by bit.
_CRC = (
    "xor(list_reduce([4294967295::BIGINT] || list_transform(string_split({0}, ''), lambda c: ascii(c)::BIGINT), lambda crc, byte: "
    "list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, zero: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295)"
)

#: Ties of a turn go by role, then by digest.
OP11_SQL = f"""
WITH turns AS (SELECT conv_id, COALESCE(role, '') AS role, COALESCE(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL),
placed AS (SELECT conv_id, octet_length(encode(role)) || ':' || role || text AS said, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(octet_length(encode(role)) || ':' || role || text)) AS p FROM turns),
convs AS (SELECT DISTINCT conv_id, conv_id - conv_id % 5 AS base, {_CRC.format("CAST(conv_id AS VARCHAR)")} % 9 AS h FROM turns),
spliced AS (
  SELECT c.conv_id, 0 AS part, p.p, p.said, p.n_bytes FROM convs c JOIN placed p ON p.conv_id = c.base AND p.p <= c.h
  UNION ALL SELECT c.conv_id, 1, p.p, p.said, p.n_bytes FROM convs c JOIN placed p ON p.conv_id = c.conv_id AND p.p > c.h),
numbered AS (SELECT conv_id, said, n_bytes, row_number() OVER (PARTITION BY conv_id ORDER BY part, p) AS depth FROM spliced),
paths AS (
  SELECT conv_id, depth, n_bytes, string_agg(octet_length(encode(said)) || ';' || said, '') OVER (PARTITION BY conv_id ORDER BY depth ROWS UNBOUNDED PRECEDING) AS k FROM numbered
  UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
lasts AS (SELECT conv_id, max(depth) AS last FROM paths GROUP BY conv_id),
nodes AS (SELECT k, depth, any_value(n_bytes) AS n_bytes, count(*) AS n_convs, min(conv_id) AS member FROM paths GROUP BY k, depth),
above AS (SELECT n.k, n.depth, (n.n_convs - 1) * n.n_bytes AS own, p.k AS over_k, p.depth AS over_depth FROM nodes n JOIN paths p ON p.conv_id = n.member AND p.depth <= n.depth),
parents AS (SELECT DISTINCT k AS child, over_k AS parent FROM above WHERE over_depth = depth - 1),
children AS (SELECT parent AS k, count(*) AS n FROM parents GROUP BY parent),
sums AS (SELECT a.over_k AS k, sum(a.own) AS saved, count(*) FILTER (WHERE c.n IS NULL) AS leaves FROM above a LEFT JOIN children c ON a.k = c.k GROUP BY a.over_k),
ends AS (SELECT p.k, string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id) AS ids FROM paths p JOIN lasts l ON p.conv_id = l.conv_id AND p.depth = l.last GROUP BY p.k)
SELECT n.member AS conv_id, CAST(n.depth AS BIGINT) AS depth, m.member AS parent_conv_id, n.n_convs, CAST(COALESCE(c.n, 0) AS BIGINT) AS n_children, CAST(s.leaves AS BIGINT) AS n_leaves,
  CAST(s.saved AS BIGINT) AS saved_tokens, sha256(COALESCE(e.ids, '')) AS ends_sha256
FROM nodes n JOIN sums s ON n.k = s.k LEFT JOIN children c ON n.k = c.k LEFT JOIN ends e ON n.k = e.k LEFT JOIN parents p ON n.k = p.child LEFT JOIN nodes m ON p.parent = m.k"""


def _lloyd(rounds: int) -> str:
    """CTEs near0, book1, near1 and so on: parts to entries, entries to means."""
    out = []
    for r in range(rounds + 1):
        out.append(
            f"near{r} AS MATERIALIZED (SELECT p.row, p.part, min(struct_pack(d := list_sum(list_transform(list_zip(p.v, b.v), lambda z: CAST((z[1] - z[2]) * (z[1] - z[2]) AS BIGINT))), entry := b.entry)) AS best "
            f"FROM pieces p JOIN book{r} b ON p.part = b.part GROUP BY p.row, p.part)"
        )
        if r < rounds:
            out.append(
                f"mean{r} AS (SELECT part, entry, list(m ORDER BY i) AS v FROM (SELECT n.part, n.best.entry AS entry, i, CAST((sum(p.v[i]) - ((sum(p.v[i]) % count(*) + count(*)) % count(*))) // count(*) AS BIGINT) AS m "
                f"FROM near{r} n JOIN pieces p ON n.row = p.row AND n.part = p.part, unnest(range(1, len(p.v) + 1)) AS t(i) GROUP BY n.part, n.best.entry, i) GROUP BY part, entry), "
                f"book{r + 1} AS MATERIALIZED (SELECT b.part, b.entry, COALESCE(m.v, b.v) AS v FROM book{r} b LEFT JOIN mean{r} m ON b.part = m.part AND b.entry = m.entry)"
            )
    return ", ".join(out)


OP12_SQL = f"""
WITH kept AS (SELECT vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
whole AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS FIRST, embedding) AS row, vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 4096) AS BIGINT)) AS v FROM kept),
pieces AS MATERIALIZED (SELECT row, part, v[part * len(v) // 8 + 1 : (part + 1) * len(v) // 8] AS v FROM whole, unnest(range(8)) AS t(part)),
book0 AS (SELECT part, row - 1 AS entry, v FROM pieces WHERE row <= 16),
{_lloyd(6)},
codes AS (SELECT row, string_agg(lpad(hex(best.entry), 2, '0'), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM near6 GROUP BY row),
told AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS h FROM book6)
SELECT w.vec_id, w.label, lower(c.code) AS code, c.error, CAST(sum(c.error) OVER (PARTITION BY w.label) AS BIGINT) AS label_error, told.h AS codebooks_sha256
FROM whole w JOIN codes c ON w.row = c.row, told"""

OP13_SQL = """
WITH normal AS (SELECT doc_id, translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM normal WINDOW same AS (PARTITION BY t)"""
