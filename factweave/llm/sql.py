"""What a plain SQL engine runs for the queries of this subpackage; only those that SQL can express."""

from __future__ import annotations

from factweave.llm.quality_rules import STOP_WORDS

_LINES = r"""WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, i, lines[i] || chr(10) || lines[i + 1] || chr(10) || lines[i + 2] AS body, lines[i] || lines[i + 1] || lines[i + 2] AS joined FROM (SELECT doc_id, lines, unnest(range(1, len(lines) - 1)) AS i FROM l WHERE len(lines) >= 3)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY body ORDER BY doc_id, i) AS n FROM w WHERE trim(joined) <> '') WHERE n > 1),
gone AS (SELECT doc_id, list_distinct(flatten(list([i, i + 1, i + 2]))) AS g FROM later GROUP BY doc_id)
SELECT d.doc_id, CAST(CASE WHEN d.text IS NULL THEN 0 ELSE len(l.lines) END AS BIGINT) AS n_lines, CAST(coalesce(len(g.g), 0) AS BIGINT) AS n_removed,
sha256(CASE WHEN g.g IS NULL THEN coalesce(d.text, '') ELSE array_to_string([x for x, k in l.lines if NOT list_contains(g.g, k)], chr(10)) END) AS kept_sha256
FROM documents d LEFT JOIN l ON l.doc_id = d.doc_id LEFT JOIN gone g ON g.doc_id = d.doc_id"""


_QUALITY = r"""WITH t AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
g AS (SELECT rid, i, array_to_string(words[i:i + 4], ' ') AS body FROM (SELECT rid, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) > 5)),
r AS (SELECT rid, count(DISTINCT i + k) AS n FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, body) AS c FROM g) CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4]) AS k) WHERE c > 1 GROUP BY rid),
c AS (SELECT doc_id, len(words) AS n_words, coalesce(length(array_to_string(words, '')), 0) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
  len(lines) AS n_lines, length(text) - length(regexp_replace(text, '[\x21-\x40\x5B-\x60\x7B-\x7E]', '', 'g')) AS marks, len(list_intersect(list_distinct(words), [STOPS])) AS stop_kinds FROM w LEFT JOIN r USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND word_chars / greatest(n_words, 1) BETWEEN 2 AND 15 AND n_symbols / greatest(word_chars, 1) <= 0.15 AND n_dup_lines / greatest(n_lines, 1) <= 0.3
  AND (n_words < 50 OR (stop_kinds >= 2 AND n_words / greatest(n_lines, 1) >= 1.5)) AND (n_words < 20 OR (word_chars - marks) / greatest(word_chars, 1) >= 0.5) AS kept FROM c"""



def _tree(nodes: str, prefix: str, depth: int) -> str:
    """CTEs over ``nodes`` (k, pos, h, n): the level ``i`` as prefix_n<i>, and its runs of 16 as prefix_g<i>."""
    out = [f"{prefix}_n0 AS ({nodes})"]
    for i in range(depth):
        out.append(f"{prefix}_g{i} AS (SELECT k, pos // 16 AS pos, n, list(h ORDER BY pos) AS hs FROM {prefix}_n{i} GROUP BY k, pos // 16, n)")
        out.append(f"{prefix}_n{i + 1} AS (SELECT k, pos, CASE WHEN n > 1 THEN sha256(array_to_string(hs, '')) ELSE hs[1] END AS h, (n + 15) // 16 AS n FROM {prefix}_g{i})")
    return ",\n".join(out)


def _climb(frm: str, prefix: str, depth: int, keep: str) -> str:
    """CTEs that lead the rows of ``frm`` (k, pos, f: a digest, s: siblings so far) up the tree, with the columns ``keep``."""
    out = []
    for i in range(depth):
        left, right = f"array_to_string(g.hs[1:r.pos % 16], '')", "array_to_string(g.hs[r.pos % 16 + 2:], '')"
        frm, before = f"{prefix}_r{i}", frm
        out.append(
            f"{frm} AS (SELECT {keep}, r.k, r.pos // 16 AS pos, CASE WHEN g.n > 1 THEN sha256({left} || r.f || {right}) ELSE r.f END AS f, CASE WHEN g.n > 1 THEN r.s || {left} || {right} ELSE r.s END AS s FROM {before} r JOIN {prefix}_g{i} g ON g.k = r.k AND g.pos = r.pos // 16)"
        )
    return ",\n".join(out)


def _merkle(depth: int = 5) -> str:
    """Trees of up to 16 ** depth leaves."""
    value = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')"
    leaf = lambda text: "sha256(" + " || ".join(value(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""WITH t AS (SELECT list(list_reduce([i, 1, 1, 1, 1, 1, 1, 1, 1], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM (SELECT unnest(range(256)) AS i)),
d AS (SELECT doc_id, coalesce('=' || source, '') AS k, {leaf("text")} AS leaf, {leaf(low)} AS low,
  xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, x: xor(c >> 8, t.t[(xor(c, x) & 255) + 1])), 4294967295) AS crc FROM documents, t),
p AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY k) AS n FROM d),
{_tree("SELECT k, pos, leaf AS h, n FROM p", "a", depth)},
sub AS (SELECT k AS tree, h FROM a_n{depth}),
{_tree("SELECT 0 AS k, row_number() OVER (ORDER BY tree) - 1 AS pos, h, count(*) OVER () AS n FROM sub", "b", depth)},
a_r AS (SELECT doc_id, leaf, k, pos, CASE WHEN crc % 5 = 0 THEN low ELSE leaf END AS f, '' AS s FROM p),
{_climb("a_r", "a", depth, "r.doc_id, r.leaf")},
b_r AS (SELECT r.doc_id, r.leaf, sub.h AS subroot, 0 AS k, (SELECT count(*) FROM sub x WHERE x.tree < sub.tree) AS pos, r.f, r.s FROM a_r{depth - 1} r JOIN sub ON sub.tree = r.k),
{_climb("b_r", "b", depth, "r.doc_id, r.leaf, r.subroot")}
SELECT r.doc_id, r.leaf, r.subroot, n.h AS root, sha256(r.s) AS proof_sha256, r.f AS folded_root, r.f = n.h AS verified FROM b_r{depth - 1} r, b_n{depth} n"""


def _clusters(rounds: int = 5) -> str:
    """Vectors and centroids in long form, a row for each component; a round's joins are unrolled."""
    assign = "a{0} AS (SELECT rid, arg_min(c, d * 64 + c) AS c, min(d) AS d FROM (SELECT v.rid, m.c, sum((v.x - m.x) * (v.x - m.x)) AS d FROM v JOIN m{0} m ON m.i = v.i GROUP BY v.rid, m.c) GROUP BY rid)"
    move = "s{0} AS (SELECT a.c, v.i, sum(v.x) AS s, count(*) AS n FROM v JOIN a{0} a ON a.rid = v.rid GROUP BY a.c, v.i),\nm{1} AS (SELECT m.c, m.i, CASE WHEN s.n IS NULL THEN m.x ELSE (s.s - ((s.s % s.n) + s.n) % s.n) // s.n END AS x FROM m{0} m LEFT JOIN s{0} s ON s.c = m.c AND s.i = m.i)"
    body = ",\n".join(x for r in range(rounds) for x in (assign.format(r), move.format(r, r + 1)))
    return f"""WITH k AS (SELECT row_number() OVER () AS rid, vec_id, embedding FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
v AS (SELECT rid, vec_id, i, CAST(floor(256 * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS x FROM (SELECT rid, vec_id, embedding, unnest(range(1, 65)) AS i FROM k)),
f AS (SELECT rid, row_number() OVER (ORDER BY sha256('2:' || vec_id), embedding) - 1 AS c FROM k QUALIFY c < 40),
m0 AS (SELECT f.c, v.i, v.x FROM f JOIN v ON v.rid = f.rid),
{body},
{assign.format(rounds)},
h AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS h FROM m{rounds} GROUP BY c)
SELECT k.vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia, h.h AS centroid_sha256
FROM a{rounds} a JOIN k ON k.rid = a.rid JOIN h ON h.c = a.c"""


def oracle_sql() -> dict[str, str]:
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return {"op5_quality_rules": _QUALITY.replace("STOPS", stops), "op7_line_dedup": _LINES, "op12_centroid_clusters": _clusters(), "op13_merkle_manifest": _merkle()}
