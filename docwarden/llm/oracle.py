"""SQL for DuckDB with the rows of those queries that SQL can express."""

from __future__ import annotations

import string

_FOLDED = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
_WORDS = r"'[^\x20\x09-\x0D]+'"

ORACLE: dict[str, str] = {}

# every pair of texts with a common n-gram, then the closure of the links
ORACLE["op4_ngram_jaccard_join"] = f"""WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(coalesce({_FOLDED}, ''), {_WORDS}) AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) >= 3 THEN list_distinct(list_transform(range(1, len(ws) - 1),
          lambda i: concat(ws[i], ' ', ws[i + 1], ' ', ws[i + 2])))
        WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS g FROM w),
u AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS o FROM u a JOIN u b
      ON a.x = b.x AND a.doc_id < b.doc_id WHERE 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
      GROUP BY ALL HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT doc_id AS id, doc_id AS c FROM documents UNION SELECT r.id, l.b FROM r JOIN l ON r.c = l.a)
SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, (SELECT min(c) FROM r WHERE r.id = s.doc_id) AS component_id
FROM s"""

_PRODUCT = "list_inner_product(q.v, c.v)"
ORACLE["op5_nearest_neighbours"] = f"""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (
  SELECT q.vec_id AS query_id, c.vec_id, {_PRODUCT} AS score,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY {_PRODUCT} DESC, c.vec_id) AS rank
  FROM e q JOIN e c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id) WHERE rank <= 20"""

# first place of every distinct line; lines of five words without one word, by place and without; then
# one line with a near one after another, kept if no near line before it was kept
ORACLE["op10_line_dedup"] = f"""WITH RECURSIVE sp AS (SELECT doc_id, string_split({_FOLDED}, chr(10)) AS l FROM documents
  WHERE coalesce(text, '') <> ''),
ln AS (SELECT doc_id, unnest(range(0, len(l))) AS line, unnest(l) AS t FROM sp),
wl AS (SELECT doc_id, line, struct_pack(d := doc_id, l := line) AS place, regexp_extract_all(t, {_WORDS}) AS ws FROM ln),
kl AS (SELECT * EXCLUDE ws, ws, array_to_string(ws, ' ') AS k, len(ws) AS n FROM wl WHERE len(ws) > 0),
cl AS (SELECT k, any_value(ws) AS ws, any_value(n) AS n, min(place) AS first FROM kl GROUP BY k),
va AS (SELECT k, n, first, i, array_to_string(list_concat(ws[1:i - 1], ws[i + 1:]), ' ') AS v
       FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM cl WHERE n >= 5)),
li AS (SELECT a.first AS a, b.first AS b FROM va a JOIN va b USING (n, i, v) WHERE a.first < b.first
       UNION SELECT least(va.first, cl.first), greatest(va.first, cl.first) FROM va JOIN cl ON cl.k = va.v AND cl.n = va.n - 1 AND cl.n >= 5),
no AS (SELECT p, row_number() OVER (ORDER BY p) AS r FROM (SELECT a AS p FROM li UNION SELECT b FROM li)),
nb AS (SELECT y.r, list(x.r) AS before FROM li JOIN no x ON x.p = li.a JOIN no y ON y.p = li.b GROUP BY y.r),
go(r, kept) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL
  SELECT go.r + 1, CASE WHEN list_has_any(coalesce(before, []), kept) THEN kept ELSE list_append(kept, go.r + 1) END
  FROM go LEFT JOIN nb ON nb.r = go.r + 1 WHERE go.r < (SELECT count(*) FROM no)),
ke AS (SELECT unnest(kept) AS r FROM go WHERE r = (SELECT count(*) FROM no)),
ne AS (SELECT cl.k FROM cl JOIN no ON no.p = cl.first WHERE no.r NOT IN (SELECT r FROM ke)),
rm AS (SELECT doc_id, list(CAST(line AS INT) ORDER BY line) AS removed FROM kl JOIN cl USING (k)
       WHERE place <> first OR k IN (SELECT k FROM ne) GROUP BY doc_id)
SELECT d.doc_id, CAST(CASE WHEN coalesce(text, '') = '' THEN 0 ELSE len(string_split(text, chr(10))) END AS INT) AS n_lines,
  CAST(coalesce(len(removed), 0) AS INT) AS n_removed, coalesce(array_to_string(removed, ','), '') AS removed
FROM documents d LEFT JOIN rm USING (doc_id)"""

# all pairs of vectors, then the closure of the links
ORACLE["op11_embedding_near_dedup"] = """WITH RECURSIVE e AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
r AS (SELECT vec_id AS id, vec_id AS c FROM e UNION SELECT r.id, l.b FROM r JOIN l ON r.c = l.a),
m AS (SELECT id, min(c) AS c FROM r GROUP BY id)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, c AS component_id, vec_id = c AS kept
FROM e JOIN m ON id = vec_id LEFT JOIN n ON a = vec_id"""


def _crc32(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit."""
    shift = "xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)"
    byte = f"list_reduce(list_prepend(xor(a, c), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: {shift})"
    codes = f"list_transform(string_split({text}, ''), lambda s: CAST(ord(s) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda a, c: {byte}), 4294967295)"


_INSERTS = "(VALUES (0,0,0,''),(1,1,0,''),(2,2,0,''),(3,3,0,''),(0,2,5,'I'),(0,3,10,'II'),(1,2,5,'I'),(1,3,10,'II'),(2,3,5,'I'),(3,2,5,'I'))"
_KEEPS = "(VALUES (0,'s',1),(0,'u',2),(1,'u',2),(2,'a',3),(3,'u',2))"
_REROLES = "(VALUES (0,2),(1,2),(2,3),(3,2))"

# one step per turn: the best cost and audit of every state of the pattern
ORACLE["op12_conversation_repair"] = f"""WITH RECURSIVE g AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_crc32("concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS k FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
    CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy FROM g WHERE k <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
    sha256(concat(strlen(role), ':', role, text)), copy) AS i, rtrim(text, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))) AS t FROM d),
f AS (SELECT *, coalesce(conv_id, -1) AS c, role[1:1] AS r, CASE WHEN t = '' THEN 1
    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2
    WHEN t[-1:] NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault, lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o),
s(c, i, q, best) AS (SELECT DISTINCT c, CAST(0 AS BIGINT), 0, struct_pack(cost := CAST(0 AS BIGINT), audit := '') FROM f
  UNION ALL SELECT c, i, q, min(best) FROM (
    SELECT f.c, f.i, e.q, struct_pack(cost := CAST(s.best.cost + n.cost + e.cost AS BIGINT), audit := concat(s.best.audit, n.audit, e.audit)) AS best
    FROM s JOIN f ON f.c = s.c AND f.i = s.i + 1 JOIN {_INSERTS} n(p, q, cost, audit) ON n.p = s.q
    JOIN LATERAL (SELECT n.q AS q, 2 AS cost, 'D' AS audit
      UNION ALL SELECT k.q, CASE f.fault WHEN 3 THEN 5 ELSE 0 END, 'K' FROM {_KEEPS} k(p, r, q) WHERE k.p = n.q AND k.r = f.r AND f.fault IN (0, 3)
      UNION ALL SELECT k.q, CASE f.fault WHEN 3 THEN 6 ELSE 1 END, 'R' FROM {_REROLES} k(p, q) WHERE k.p = n.q AND f.fault IN (0, 3)) e ON true)
  GROUP BY c, i, q),
z AS (SELECT c, max(i) AS i, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
    count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (before IS NOT NULL AND before || r NOT IN ('su', 'ua', 'au')) AS illegal,
    coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps FROM f GROUP BY c),
b AS (SELECT c, min(struct_pack(cost := s.best.cost + n.cost, audit := concat(s.best.audit, n.audit))) AS best
  FROM s JOIN z USING (c, i) JOIN {_INSERTS} n(p, q, cost, audit) ON n.p = s.q WHERE n.q IN (0, 3) GROUP BY c),
a AS (SELECT c, best.audit AS audit, unnest(range(1, length(best.audit) + 1)) AS p FROM b),
h AS (SELECT c, p, audit[p] AS e, length(replace(audit, 'D', '')) AS m, length(replace(audit[1:p], 'D', '')) - 1 AS j,
    length(replace(audit[1:p], 'I', '')) AS i FROM a),
x AS (SELECT h.c, p, CASE WHEN e = 'K' THEN f.role WHEN (j + m) % 2 = 0 THEN 'user' ELSE 'assistant' END AS role,
    CASE WHEN e = 'I' THEN '' ELSE f.text END AS text FROM h LEFT JOIN f ON f.c = h.c AND f.i = h.i AND e <> 'I' WHERE e <> 'D'),
y AS (SELECT c, sha256(string_agg(concat(role, ':', text), chr(10) ORDER BY p)) AS hash FROM x GROUP BY c)
SELECT v.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(best.cost, 0) AS BIGINT) AS cost,
  coalesce(best.audit, '') AS audit, coalesce(hash, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(conv_id, -1) AS c FROM conversations) v
LEFT JOIN z USING (c) LEFT JOIN b USING (c) LEFT JOIN y USING (c)"""


def _leaf(text: str) -> str:
    fields = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
    return "sha256(concat(" + ", ".join(f"coalesce(strlen({x}) || ':' || {x}, '-')" for x in fields) + "))"


def _levels(first: str, group: str) -> str:
    return f"""{first} UNION ALL SELECT {group}lv + 1, i // 16, (n + 15) // 16, sha256(string_agg(d, '' ORDER BY i))
  FROM self WHERE n > 1 GROUP BY {group}lv, i // 16, n"""


_LEFT, _RIGHT = "array_to_string(ds[1:w.i % 16], '')", "array_to_string(ds[w.i % 16 + 2:], '')"
_WALK = f"""SELECT w.row, w.t, w.lv + 1, w.i // 16, concat(w.proof, {_LEFT}, {_RIGHT}), sha256(concat({_LEFT}, w.fold, {_RIGHT}))
  FROM self w JOIN r ON r.t = w.t AND r.lv = w.lv AND r.p = w.i // 16"""
_FOLDED_TEXT = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
_LEVELS_U = _levels("SELECT t, 0, i, n, leaf FROM l", "t, ").replace("self", "u")
_LEVELS_V = _levels("SELECT 0, t, count(*) OVER (), d FROM u WHERE n = 1", "").replace("self", "v")

# trees level by level, then every leaf's way up
ORACLE["op13_merkle_manifest"] = f"""WITH RECURSIVE k AS (
  SELECT row_number() OVER () AS row, doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS t, {_leaf("text")} AS leaf,
    CASE WHEN {_crc32("CAST(doc_id AS VARCHAR)")} % 5 = 0 THEN {_leaf(_FOLDED_TEXT)} ELSE {_leaf("text")} END AS given FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, leaf, row) - 1 AS i, count(*) OVER (PARTITION BY t) AS n FROM k),
u(t, lv, i, n, d) AS ({_LEVELS_U}),
v(lv, i, n, d) AS ({_LEVELS_V}),
r AS (SELECT t, lv, i // 16 AS p, list(d ORDER BY i) AS ds FROM (FROM u UNION ALL SELECT -1, * FROM v) WHERE n > 1 GROUP BY t, lv, i // 16),
w1(row, t, lv, i, proof, fold) AS (SELECT row, t, 0, i, '', given FROM l UNION ALL {_WALK.replace("self", "w1")}),
e AS (SELECT w1.*, u.d FROM w1 JOIN u ON u.t = w1.t AND u.lv = w1.lv AND u.n = 1),
w2(row, t, lv, i, proof, fold) AS (SELECT row, -1, 0, t, proof, fold FROM e UNION ALL {_WALK.replace("self", "w2")})
SELECT doc_id, leaf, e.d AS subroot, v.d AS root, sha256(w2.proof) AS proof_sha256, w2.fold AS folded_root, w2.fold = v.d AS verified
FROM l JOIN e USING (row) JOIN w2 USING (row) JOIN v ON v.lv = w2.lv AND v.n = 1"""
