"""DuckDB SQL giving the rows of those registered queries that SQL can express."""

from __future__ import annotations

from latticework.llm import licences, sharding


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


CHAT = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
placed AS (
  SELECT *, row_number() OVER w AS place, count(*) OVER (PARTITION BY conv_id) AS n, role = 'assistant' AS target,
    23 + length(role) + 1 + length(regexp_replace(replace(text, '\', '\\'), '(<\||<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>)', 'x\1', 'g')) AS size
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
summed AS (
  SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY place) AS upto FROM placed)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (target), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (target), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (target OR place = n) AS BIGINT) AS formatted_chars, count(*) FILTER (target OR place = n) AS n_examples
FROM summed GROUP BY conv_id"""

SHARDS = f"""
WITH rows AS (
  SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || chr(31) || coalesce('=' || text, 'null')), 1, {sharding.HASH_BITS // 4}) AS BIGINT) AS hash,
    coalesce(strlen(text), 0) AS bytes FROM documents),
buckets AS (
  SELECT depth, hash >> ({sharding.HASH_BITS} - depth) AS prefix, sum(bytes) AS bytes, sum(bytes) <= {sharding.SHARD_BYTES} OR min(hash) = max(hash) AS closed
  FROM rows, range(0, {sharding.HASH_BITS + 1}) r(depth) GROUP BY ALL),
leaves AS (
  SELECT * FROM buckets b WHERE closed AND NOT EXISTS (
    SELECT 1 FROM buckets p WHERE p.depth = b.depth - 1 AND p.prefix = b.prefix >> 1 AND p.closed))
SELECT doc_id, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), CAST(depth AS INTEGER), '0') END AS shard, CAST(depth AS INTEGER) AS depth,
  CAST(l.bytes AS BIGINT) AS shard_bytes, l.bytes <= {sharding.SHARD_BYTES} AS fits
FROM rows r JOIN leaves l ON l.prefix = r.hash >> ({sharding.HASH_BITS} - l.depth)"""


def _canonical(text: str) -> str:
    spaced = f"regexp_replace(regexp_replace(lower(coalesce({text}, '')), {_quoted(licences.COPYRIGHT_LINE)}, chr(10), 'g'), {_quoted(licences.SEPARATORS)}, ' ', 'g')"
    out = f"(' ' || trim({spaced}, ' ') || ' ')"
    for spelling, same in licences.SPELLINGS:
        out = f"replace({out}, ' {spelling}', ' {same}')"
    return out


LICENCES = f"""
WITH known AS (
  SELECT sha256({_canonical('text')}) AS digest, min(license_id) AS license_id
  FROM (VALUES {', '.join(f'({_quoted(i)}, {_quoted(t)})' for i, t in licences.KNOWN)}) k(license_id, text) GROUP BY 1),
looked AS (SELECT doc_id, sha256({_canonical('text')}) AS digest FROM documents)
SELECT doc_id, digest, license_id FROM looked LEFT JOIN known USING (digest)"""

LINES = r"""
WITH rows AS (SELECT row_number() OVER () AS id, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (
  SELECT id, line, place, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT id, unnest(lines) AS line, unnest(range(len(lines))) AS place FROM rows)),
common AS (SELECT key FROM lines WHERE key <> '' GROUP BY key HAVING count(DISTINCT id) >= 10),
told AS (
  SELECT id, count(*) AS n_lines, count(c.key) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (c.key IS NULL), '')) AS kept_sha256
  FROM lines l LEFT JOIN common c ON l.key = c.key GROUP BY id)
SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM told JOIN rows USING (id)"""

#: CRC-32 of a number's decimal digits: DuckDB has no such function, so bits go through one by one.
_CRC32 = """list_reduce(
  list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: xor(v >> 1, 3988292384 * (v & 1))))"""

TRIE = rf"""
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS place, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, conv_id - conv_id % 20 AS first_id, xor(4294967295, CAST({_CRC32} AS BIGINT)) % 4 AS taken FROM (SELECT DISTINCT conv_id FROM turns)),
rebuilt AS (
  SELECT c.conv_id, 0 AS part, t.place, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.first_id AND t.place < c.taken
  UNION ALL SELECT c.conv_id, 1, t.place, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.place >= c.taken),
numbered AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, place) AS depth, md5(role || chr(0) || text) AS turn,
    len(regexp_extract_all(text, '[^ 	-]+')) AS words FROM rebuilt),
paths AS (
  SELECT conv_id, depth, string_agg(turn, '') OVER (PARTITION BY conv_id ORDER BY depth) AS path, words FROM numbered
  UNION ALL SELECT conv_id, 0, '', 0 FROM convs),
lengths AS (SELECT conv_id, max(depth) AS depth FROM paths GROUP BY 1),
ends AS (SELECT path, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends_sha256 FROM paths JOIN lengths USING (conv_id, depth) GROUP BY 1),
bare AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS saved FROM paths GROUP BY path, depth),
kids AS (SELECT left(path, length(path) - 32) AS path, count(*) AS n_children FROM bare WHERE depth > 0 GROUP BY 1),
nodes AS (SELECT b.*, coalesce(n_children, 0) AS n_children FROM bare b LEFT JOIN kids USING (path)),
sums AS (
  SELECT p.path, count(*) FILTER (n.n_children = 0) AS n_leaves, CAST(sum(n.saved) AS BIGINT) AS saved_tokens
  FROM nodes n JOIN paths p ON p.conv_id = n.conv_id AND p.depth <= n.depth GROUP BY 1)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves, saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM nodes n JOIN sums USING (path) LEFT JOIN ends USING (path) LEFT JOIN nodes p ON n.depth > 0 AND p.path = left(n.path, length(n.path) - 32)"""
