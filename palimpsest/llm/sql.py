"""DuckDB SQL for the queries that SQL can express over whole tables. Sharding, SimHash (XXH64), BPE and learnt rules it can't; tests hold those against brute force."""

SPACE = r"[\x20\x09-\x0D]+"
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: str, separator: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({text}, ''), '{separator}'), lambda w: w <> '')"


ITEM = words(f"translate({{}}, '{UPPER}', '{LOWER}')", SEPARATOR)

OP2 = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
pieces AS (SELECT r, n, o, substr(h, 2 * o + 1, 2398) AS piece FROM (SELECT *, unnest(range(0, n - 199, 1000)) AS o FROM d WHERE n >= 200)),
spots AS (SELECT r, o + i AS s, md5_number(substr(piece, 2 * i + 1, 400)) AS win FROM (SELECT *, unnest(range(0, least(1000, n - 199 - o))) AS i FROM pieces)),
twice AS (SELECT win FROM spots GROUP BY win HAVING count(*) > 1),
marked AS (SELECT r, s, s <= lag(s) OVER (PARTITION BY r ORDER BY s) + 200 AS joins FROM spots WHERE win IN (FROM twice)),
runs AS (SELECT r, min(s) AS a, max(s) + 200 AS b FROM (SELECT r, s, sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY s) AS g FROM marked) GROUP BY r, g),
totals AS (SELECT r, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM runs GROUP BY r),
ends AS (SELECT r, a, b FROM runs UNION ALL SELECT r, n, n FROM d),
kept AS (SELECT r, string_agg(substr(h, 2 * p + 1, 2 * (a - p)), '' ORDER BY a, b) AS k FROM (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a, b), 0) AS p FROM ends) JOIN d USING (r) GROUP BY r)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM d JOIN kept USING (r) LEFT JOIN totals USING (r)
"""

OP3 = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, length(text) + (length(regexp_replace(text, '<s>|</s>|\\[INST\\]|\\[/INST\\]|<<SYS>>|<</SYS>>|<\\|turn\\|>|<\\|text\\|>|<\\|end\\|>|\\\\', '\\0~', 'g')) - length(text)) AS n FROM rows
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(role) + n + 23)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""

OP4 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {ITEM.format("text")} AS w FROM documents),
b AS (SELECT item_id, {ITEM.format("text")} AS w FROM benchmark),
wins AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, s, s + 9), ' ') AS win, least(10, len(w)) AS n FROM (SELECT *, unnest(range(1, greatest(2, len(w) - 8))) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM wins),
spots AS (SELECT r, n, s, array_to_string(list_slice(w, s, s + n - 1), ' ') AS win FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes)),
hits AS (SELECT spots.r, spots.s, spots.n, wins.item_id FROM spots JOIN wins ON spots.win = wins.win AND spots.n = wins.n),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM hits) GROUP BY r),
items AS (SELECT r, count(DISTINCT item_id) AS n_items, sha256(array_to_string(list_sort(list_distinct(list(item_id::VARCHAR))), ',')) AS h FROM hits GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(h, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN items USING (r)
"""

OP5 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), q AS (SELECT *, strlen(h) AS n, max(page_id) OVER (PARTITION BY h) AS m FROM p)
SELECT page_id, n AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN n >= 1000 AND page_id <> m THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= 1000 AND page_id <> m THEN m END AS refers_to FROM q
"""

OP8 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words("text", SPACE)} AS w FROM documents),
spots AS (SELECT r, s, md5(array_to_string(list_slice(w, s, s + 34), ' ')) AS win FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS s FROM d WHERE len(w) >= 35)),
twice AS (SELECT win FROM spots GROUP BY win HAVING count(*) > 1),
gone AS (SELECT r, list(DISTINCT p) AS ps, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(s, s + 35)) AS p FROM spots WHERE win IN (FROM twice)) GROUP BY r),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY p) AS t FROM (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d) LEFT JOIN (SELECT r, unnest(ps) AS p, true AS g FROM gone) USING (r, p) WHERE g IS NULL GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN gone USING (r) LEFT JOIN kept USING (r)
"""

_WHOLE = "list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT)"
_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _round(i: int) -> str:
    """Assign to the centroids c{i}, then move them to c{i + 1}; the division rounds down for negative sums too."""
    return f"""
a{i} AS MATERIALIZED (SELECT v.r, arg_min(c.z, (list_sum(list_transform(list_zip(v.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), c.z)) AS z FROM v, c{i} AS c GROUP BY v.r),
m{i} AS (SELECT z, p, sum(x) AS s, count(*) AS n FROM (SELECT a.z, unnest(v.v) AS x, unnest(range(1, 65)) AS p FROM a{i} AS a JOIN v USING (r)) GROUP BY z, p),
n{i} AS (SELECT z, list(((s - ((s % n + n) % n)) // n)::BIGINT ORDER BY p) AS v FROM m{i} GROUP BY z),
c{i + 1} AS MATERIALIZED (SELECT c.z, coalesce(n.v, c.v) AS v FROM c{i} AS c LEFT JOIN n{i} AS n USING (z)),"""


OP11 = f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, {_WHOLE} AS v FROM embeddings WHERE len(embedding) = 64 AND {_FINITE}),
c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h, v) - 1)::INTEGER AS z, v FROM (SELECT sha256('3:' || vec_id::VARCHAR) AS h, v FROM v WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT 8)),
{"".join(map(_round, range(10)))}
d AS MATERIALIZED (SELECT v.r, c.z, list_sum(list_transform(list_zip(v.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS q FROM v, c10 AS c),
f AS MATERIALIZED (SELECT r, arg_min(z, (q, z)) AS z, min(q) AS q FROM d GROUP BY r)
SELECT vec_id, z AS cluster, q AS distance, (sum(q) OVER (PARTITION BY z))::BIGINT AS cluster_inertia, (sum(q) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM f JOIN v USING (r) JOIN c10 AS c USING (z)
"""

OP12 = f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, {_WHOLE} AS v FROM embeddings WHERE {_FINITE}),
s AS (SELECT a.r, a.vec_id AS query_id, b.vec_id, coalesce(list_sum(list_transform(list_zip(a.v, b.v), lambda p: coalesce(p[1] * p[2], 0))), 0)::BIGINT AS score FROM v AS a, v AS b WHERE a.vec_id % 100 = 0 AND a.r <> b.r)
SELECT query_id, (row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST))::INTEGER AS rank, vec_id, score FROM s QUALIFY rank <= 10
"""

# CRC-32 of a string of ASCII characters, bit by bit.
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({}, ''), lambda c: ord(c)::BIGINT)), lambda h, c: list_reduce(list_prepend(xor(h, c), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"
_BLANKS = r"[\x20\x09-\x0D]*"


def _least(*options: str) -> str:
    """The cheapest of the structs (c, a, t), of equal costs that with the least audit; a struct without a cost is none."""
    return f"list_sort(list_filter([{', '.join(options)}], lambda o: o.c IS NOT NULL))[1]"


def _put(cost: str, letter: str, line: str, after: str) -> str:
    text = f"CASE WHEN {after}.t IS NULL THEN {line} ELSE {line} || chr(10) || {after}.t END"
    return f"{{'c': {after}.c + {cost}, 'a': '{letter}' || {after}.a, 't': {text}}}"


def _insertions(b: list[str]) -> list[str]:
    """The best of each state when turns may be put in first; f: after the turn's own edit, three insertions at most."""
    user, assistant = "'user:'", "'assistant:'"
    one = [_put("3", "I", user, b[2]), _put("3", "I", user, b[2]), _put("3", "I", assistant, b[3]), _put("3", "I", user, b[2])]
    two = _put("3", "I", user, f"({_put('3', 'I', assistant, b[3])})")
    two_a = _put("3", "I", assistant, f"({_put('3', 'I', user, b[2])})")
    three = _put("3", "I", user, f"({_put('3', 'I', assistant, '(' + _put('3', 'I', user, b[2]) + ')')})")
    return [_least(b[0], one[0], two, three), _least(b[1], one[1], two, three), _least(b[2], one[2], two_a), _least(b[3], one[3], two)]


def _edits(p: int) -> str:
    """The best of state p at a turn x, given the best g of each state behind it."""
    kept = {0: "WHEN x.i = 's' THEN {s} WHEN x.i = 'u' THEN {u}", 1: "WHEN x.i = 'u' THEN {u}", 2: "WHEN x.i = 'a' THEN {a}", 3: "WHEN x.i = 'u' THEN {u}"}[p]
    line, more = "x.role || ':' || x.text", "CASE WHEN x.fault = 3 THEN 3 ELSE 0 END"
    kept = kept.format(**{k: _put(more, "K", line, g) for k, g in zip("sua", ("w.g1", "w.g2", "w.g3"))})
    none = "{'c': NULL::BIGINT, 'a': NULL::VARCHAR, 't': NULL::VARCHAR}"
    role, after = ("'assistant:'", "w.g3") if p == 2 else ("'user:'", "w.g2")
    keep = f"CASE WHEN x.fault IN (1, 2) THEN {none} {kept} ELSE {none} END"
    rerole = f"CASE WHEN x.fault IN (1, 2) THEN {none} ELSE {_put('3 + ' + more, 'R', role + ' || x.text', after)} END"
    return _least(f"{{'c': w.g{p}.c + 4, 'a': 'D' || w.g{p}.a, 't': w.g{p}.t}}", keep, rerole)


_END = ["{'c': 0::BIGINT, 'a': '', 't': NULL::VARCHAR}", "{'c': NULL::BIGINT, 'a': NULL::VARCHAR, 't': NULL::VARCHAR}"]

OP13 = f"""
WITH RECURSIVE d AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC.format("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS f FROM conversations
), e AS (
  SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN f = 3 THEN [0, 1] ELSE [0] END) AS copy FROM d WHERE f <> 0
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS n FROM e
), x AS MATERIALIZED (
  SELECT conv_id, n, turn, role, text, left(role, 1) AS i,
    CASE WHEN regexp_full_match(text, '{_BLANKS}') THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 2 WHEN NOT regexp_matches(text, '[.!?]{_BLANKS}\\z') THEN 3 ELSE 0 END AS fault,
    left(lag(role) OVER (PARTITION BY conv_id ORDER BY n), 1) AS before
  FROM o
), w AS (
  SELECT conv_id, max(n) AS n, {", ".join(f"{e} AS g{p}" for p, e in enumerate(_insertions([_END[0], _END[1], _END[1], _END[0]])))} FROM x GROUP BY conv_id
  UNION ALL
  SELECT conv_id, n, {", ".join(f"{e} AS g{p}" for p, e in enumerate(_insertions(["b0", "b1", "b2", "b3"])))} FROM (
    SELECT w.conv_id, w.n - 1 AS n, {", ".join(f"{_edits(p)} AS b{p}" for p in range(4))} FROM w JOIN x ON x.conv_id IS NOT DISTINCT FROM w.conv_id AND x.n = w.n
  )
), told AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
    count(*) FILTER (n > 1 AND before || i NOT IN ('su', 'ua', 'au')) AS illegal
  FROM x GROUP BY conv_id
), ids AS (SELECT DISTINCT conv_id AS id FROM conversations)
SELECT id AS conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(w.g0.c, 0)::BIGINT AS cost, coalesce(w.g0.a, '') AS audit, sha256(coalesce(w.g0.t, '')) AS repaired_sha256
FROM ids LEFT JOIN told ON id IS NOT DISTINCT FROM told.conv_id LEFT JOIN w ON id IS NOT DISTINCT FROM w.conv_id AND w.n = 0
"""

ORACLE_SQL = {"op2_suffix_dedup": OP2, "op3_chat_formatting": OP3, "op4_decontamination": OP4, "op5_warc": OP5, "op8_substring_dedup": OP8, "op11_centroid_clustering": OP11, "op12_top_k": OP12, "op13_conversation_repair": OP13}
