"""DuckDB SQL of the corpus queries that SQL can express."""

from __future__ import annotations

from pitline.llm import chat, licenses, mixing
from pitline.llm.queries import CONTROL


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


OP1 = f"""
WITH counts AS (SELECT source, count(*)::DOUBLE AS n FROM documents GROUP BY source),
means AS (SELECT source, sqrt(n) / (SELECT sum(sqrt(n)) FROM counts) * (SELECT sum(n) FROM counts) / n AS mean FROM counts),
parts AS (SELECT source, greatest(ceil(mean / {mixing.PART}), 1)::INT AS parts, mean / greatest(ceil(mean / {mixing.PART}), 1) AS m FROM means),
tables AS (
  SELECT source, parts, sum(exp(k * ln(m) - m - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS upto
  FROM parts, range({mixing.TERMS}) AS r(k)
),
draws AS (
  SELECT doc_id, source, p, ('0x' || substr(md5('0|' || p || '|' || md5(doc_id::VARCHAR)), 1, {mixing.DIGITS}))::BIGINT::DOUBLE / {16**mixing.DIGITS}.0 AS u
  FROM documents JOIN parts USING (source), LATERAL (SELECT unnest(range(1, parts + 1)) AS p)
),
times AS (SELECT doc_id, count(*) FILTER (WHERE upto <= u) AS times FROM draws JOIN tables USING (source) GROUP BY doc_id)
SELECT doc_id, text, lang, source, n_chars, copy::INT AS copy
FROM documents JOIN times USING (doc_id), LATERAL (SELECT unnest(range(1, times + 1)) AS copy)
"""

_ESCAPED = "replace(replace({0}, chr(92), chr(92) || chr(92)), '<|', '<' || chr(92) || '|')"
OP2 = f"""
WITH RECURSIVE turns AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', {quoted(CONTROL)}), (-1, 1, 'assistant', {quoted(CONTROL)})
),
sized AS (
  SELECT *, len(regexp_extract_all(text, '[\\pL\\pN]+|[^\\s\\pL\\pN]')) + {chat.OVERHEAD} AS tokens,
    {len(chat.START) + len(chat.END) + 2} + length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")}) AS chars
  FROM turns
),
begun AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM sized),
placed AS (
  SELECT *, start // {chat.BLOCK * chat.BUDGET} AS block, start = 0 AND role = 'system' AS system,
    row_number() OVER (PARTITION BY conv_id, start // {chat.BLOCK * chat.BUDGET} ORDER BY start) AS k,
    coalesce(max(tokens) FILTER (WHERE start = 0 AND role = 'system') OVER (PARTITION BY conv_id), 0) AS kept
  FROM begun
),
walk AS (
  SELECT conv_id, block, k, start, tokens, kept, start AS opened FROM placed WHERE k = 1
  UNION ALL
  SELECT p.conv_id, p.block, p.k, p.start, p.tokens, p.kept,
    CASE WHEN p.start + p.tokens - w.opened > CASE WHEN w.opened = 0 THEN {chat.BUDGET} ELSE {chat.BUDGET - chat.HISTORY} - p.kept END THEN p.start ELSE w.opened END
  FROM walk w JOIN placed p ON p.conv_id = w.conv_id AND p.block = w.block AND p.k = w.k + 1
),
windows AS (SELECT conv_id, opened, least({chat.HISTORY}, {chat.BUDGET} - any_value(kept) - (max(start + tokens) - opened)) AS room FROM walk GROUP BY conv_id, opened),
repeated AS (
  SELECT p.conv_id, chars FROM placed p JOIN windows v ON v.conv_id = p.conv_id AND p.start < v.opened AND p.start >= v.opened - v.room WHERE NOT system
  UNION ALL SELECT p.conv_id, chars FROM placed p JOIN windows v ON v.conv_id = p.conv_id AND v.opened > 0 WHERE system
),
more AS (SELECT conv_id, sum(chars) AS chars FROM repeated GROUP BY conv_id)
SELECT p.conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  (sum(p.chars) + coalesce(any_value(more.chars), 0))::BIGINT AS formatted_chars
FROM placed p LEFT JOIN more USING (conv_id) GROUP BY p.conv_id
"""

OP6 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def op9() -> str:
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    need = licenses.Templates(licenses.TEMPLATES, {}, licenses.THRESHOLD).rows
    templates = ", ".join(f"({quoted(label)}, {quoted(w)}, {len(words)}, {n})" for label, words, _, n in need for w in words)
    places = " UNION ALL ".join(
        f"SELECT doc_id, {quoted(label)} AS label, i FROM (SELECT doc_id, w, unnest(range(len(w))) AS i FROM words) WHERE "
        + " AND ".join(f"w[i + {k + 1}] = {quoted(p)}" for k, p in enumerate(phrase.split()))
        for phrase, label in licenses.PHRASES.items()
    )
    return f"""
WITH low AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
words AS (SELECT doc_id, regexp_extract_all(t, {quoted(word)}) AS w FROM low),
places AS ({places}),
base AS (
  SELECT doc_id, count(*) AS n_base, min(i)::BIGINT AS first_word, max(i)::BIGINT AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
  FROM places GROUP BY doc_id
),
templates(label, word, n, need) AS (VALUES {templates}),
lines AS (
  SELECT doc_id, words, row_number() OVER (PARTITION BY doc_id ORDER BY line_at) AS line_no, count(*) OVER (PARTITION BY doc_id) AS n_lines
  FROM (SELECT doc_id, line_at, regexp_extract_all(line, {quoted(word)}) AS words FROM (
    SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS line_at FROM low
  )) WHERE len(words) > 0
),
line_words AS (SELECT doc_id, line_no, n_lines, unnest(list_distinct(words)) AS word FROM lines),
known AS (SELECT * FROM line_words WHERE word IN (SELECT word FROM templates)),
block_words AS (
  SELECT DISTINCT doc_id, begin, word FROM known, LATERAL (SELECT unnest(range(greatest(line_no - {licenses.SPAN - 1}, 1), least(line_no, greatest(n_lines - {licenses.SPAN - 1}, 1)) + 1)) AS begin)
),
shared AS (SELECT doc_id, begin, label, count(*) / any_value(n) AS share FROM block_words JOIN templates USING (word) GROUP BY doc_id, begin, label HAVING count(*) >= any_value(need)),
score AS (SELECT doc_id, max(share) AS score FROM shared GROUP BY doc_id),
every AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM places UNION SELECT doc_id, label FROM shared) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM words LEFT JOIN base USING (doc_id) LEFT JOIN every USING (doc_id) LEFT JOIN score USING (doc_id)
"""


OP10 = """
WITH digests AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
bits AS (
  SELECT page_id, html, h, array_to_string(list_transform(range(1, 41), lambda i: substr('0000000100100011010001010110011110001001101010111100110111101111', strpos('0123456789abcdef', h[i]) * 4 - 3, 4)), '') AS b
  FROM digests
),
named AS (
  SELECT *, min(page_id) OVER (PARTITION BY html) AS first,
    array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(5), lambda j: substr(b, i * 5 + j + 1, 1)::INT * (16 >> j)))::INT, 1)), '') AS payload_digest
  FROM bits
)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM named
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OP11 = f"""
WITH low AS (SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS t FROM documents),
ranked AS (SELECT doc_id, t, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM low)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM ranked
"""


def crc32(text: str) -> str:
    """Unsigned CRC-32 of a short ASCII string."""
    step = "list_reduce(range(8), lambda c, i: xor(c >> 1, (c & 1) * 3988292384), {0})"  # fixed value: the reversed polynomial
    byte = "ascii(substr({0}, (k + 1)::INT, 1))::BIGINT".format(text)
    return f"xor(4294967295, list_reduce(range(length({text})), lambda a, k: {step.format(f'xor(a, {byte})')}, 4294967295::BIGINT))"


def op12(levels: int = 6) -> str:
    """The tree level by level, for up to 16^levels leaves of a source and as many sources."""
    value = lambda c: f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')"
    columns = ["doc_id", "source", "lang", "n_chars"]
    leaf = lambda text: "sha256(" + " || ".join([value(c) for c in columns] + [value(text)]) + ")"
    tampered = leaf(f"translate(text, '{_UPPER}', '{_LOWER}')")
    run = "(PARTITION BY source, pos // 16 ORDER BY pos ROWS BETWEEN {0})"
    parts = [
        f"""leaves AS (
  SELECT doc_id, source, {leaf("text")} AS leaf, CASE WHEN {crc32("doc_id::VARCHAR")} % 5 = 0 THEN {tampered} ELSE {leaf("text")} END AS other FROM documents
),
a0 AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, leaf AS digest, count(*) OVER (PARTITION BY source) AS n FROM leaves),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS at FROM leaves)"""
    ]

    def climb(name: str) -> None:
        for k in range(levels):
            parts.append(
                f"""{name}p{k} AS (
  SELECT *, coalesce(string_agg(digest, '') OVER {run.format("UNBOUNDED PRECEDING AND 1 PRECEDING")}, '') AS before,
    coalesce(string_agg(digest, '') OVER {run.format("1 FOLLOWING AND UNBOUNDED FOLLOWING")}, '') AS after FROM {name}{k}
),
{name}{k + 1} AS (
  SELECT source, pos // 16 AS pos, CASE WHEN n > 1 THEN sha256(string_agg(digest, '' ORDER BY pos)) ELSE any_value(digest) END AS digest, (n + 15) // 16 AS n
  FROM {name}{k} GROUP BY source, pos // 16, n
)"""
            )

    climb("a")
    parts.append(
        f"""b0 AS (SELECT 0 AS source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, digest, count(*) OVER () AS n FROM a{levels}),
sources AS (SELECT source, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS at FROM a{levels})"""
    )
    climb("b")
    parts.append("f0 AS (SELECT p.*, subroot, s.at AS place, '' AS proof, p.other AS folded FROM placed p JOIN sources s ON p.source IS NOT DISTINCT FROM s.source)")
    for i in range(2 * levels):
        name, k = ("a", i) if i < levels else ("b", i - levels)
        key = f"f.source IS NOT DISTINCT FROM x.source AND f.at // {16**k} = x.pos" if name == "a" else f"f.place // {16**k} = x.pos"
        parts.append(
            f"""f{i + 1} AS (
  SELECT f.doc_id, f.source, f.leaf, f.other, f.at, f.subroot, f.place, proof || before || after AS proof,
    CASE WHEN x.n > 1 THEN sha256(before || folded || after) ELSE folded END AS folded FROM f{i} f JOIN {name}p{k} x ON {key}
)"""
        )
    return (
        "WITH " + ",\n".join(parts) + f"""
SELECT doc_id, leaf, subroot, r.digest AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = r.digest AS verified
FROM f{2 * levels} CROSS JOIN b{levels} r
"""
    )


OP13 = f"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(octet_length(encode(role)) || ':' || role || text)) AS k
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations) WHERE conv_id IS NOT NULL
),
cut AS (SELECT DISTINCT conv_id, {crc32("conv_id::VARCHAR")} % 9 AS h FROM turns),
rebuilt AS (
  SELECT c.conv_id, t.k, role, text FROM cut c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % 5 AND t.k <= h
  UNION ALL SELECT c.conv_id, t.k, role, text FROM cut c JOIN turns t ON t.conv_id = c.conv_id AND t.k > h
),
numbered AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY k) AS depth, sha256(length(role) || ':' || role || text) AS id, octet_length(encode(text)) AS size FROM rebuilt
),
spelled AS (
  SELECT *, string_agg(id, '') OVER (PARTITION BY conv_id ORDER BY depth ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS path FROM numbered
),
places AS (
  SELECT conv_id, depth, size, path FROM spelled UNION ALL SELECT conv_id, 0, 0, '' FROM cut
),
longest AS (SELECT conv_id, max(depth) AS len FROM places GROUP BY conv_id),
nodes AS (
  SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE depth = len), '')) AS ends_sha256
  FROM places JOIN longest USING (conv_id) GROUP BY depth, path
),
related AS (
  SELECT n.depth, n.path, n.conv_id, n.n_convs, n.ends_sha256, count(c.path) AS n_children FROM nodes n
  LEFT JOIN nodes c ON c.depth = n.depth + 1 AND n.path = left(c.path, length(c.path) - 64) GROUP BY ALL
),
below AS (
  SELECT left(n.path, 64 * a) AS path, a AS depth, sum((n.n_convs - 1) * n.size)::BIGINT AS saved_tokens, count(*) FILTER (WHERE r.n_children = 0) AS n_leaves
  FROM nodes n JOIN related r USING (depth, path), LATERAL (SELECT unnest(range(n.depth + 1)) AS a) GROUP BY ALL
)
SELECT r.conv_id, r.depth, p.conv_id AS parent_conv_id, r.n_convs, r.n_children, n_leaves, saved_tokens, r.ends_sha256
FROM related r JOIN below b USING (depth, path) LEFT JOIN nodes p ON r.depth > 0 AND p.depth = r.depth - 1 AND p.path = left(r.path, length(r.path) - 64)
"""

ORACLE = {"op1_mix_sources": OP1, "op2_chat_windows": OP2, "op6_exact_top_k": OP6, "op9_license_scan": op9(), "op10_warc_archives": OP10, "op11_exact_dedup": OP11, "op12_merkle_manifest": op12(), "op13_prefix_trie": OP13}
