"""SQL twins for DuckDB of those queries that SQL can express."""

from __future__ import annotations

from webloom.llm import secrets


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _rule(number: int, rule: secrets.Rule) -> str:
    """doc_id, kind, start, stop of a rule's spans: lengths of matches and of the pieces between them add up."""
    pattern = rule.pattern
    if pattern.startswith("[") and pattern.endswith("]+") and pattern.count("[") == 1:
        pattern = f"{pattern[:-1]}{{{rule.least},}}"  # the same matches, without the many short ones
    p = _quoted(pattern)
    return f"""
SELECT doc_id, {number} AS kind, place AS start, place + length(m[i]) AS stop FROM (
  SELECT doc_id, m, g, i, (list_sum(list_transform(gaps[1:i], lambda x: length(x)))
         + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS place
  FROM (SELECT doc_id, m, g, gaps, unnest(range(1, len(m) + 1)) AS i
        FROM (SELECT doc_id, regexp_extract_all(text, {p}, 0) AS m, regexp_extract_all(text, {p}, {rule.group}) AS g,
                     regexp_split_to_array(text, {p}) AS gaps
              FROM documents WHERE regexp_matches(text, {p})))
) WHERE length(g[i]) >= {rule.least}"""


def secret_spans(rules: tuple[secrets.Rule, ...], base: int) -> str:
    names = " ".join(f"WHEN {n} THEN '{r.name}'" for n, r in enumerate(rules))
    one = f"CASE kind {names} END || ':' || start || ':' || stop"
    joined = f"string_agg({one}, ',' ORDER BY start, kind)"
    counts = ", ".join(
        f"count(*) FILTER (WHERE kind = {n}) AS n_{r.name}" for n, r in enumerate(rules[:base])
    )
    return f"""
WITH found AS ({" UNION ALL ".join(_rule(n, r) for n, r in enumerate(rules))}
)
SELECT d.doc_id, {counts}, sha256(coalesce({joined} FILTER (WHERE kind < {base}), '')) AS base_sha256,
       coalesce({joined} FILTER (WHERE kind IS NOT NULL), '') AS spans
FROM documents d LEFT JOIN found f ON f.doc_id = d.doc_id GROUP BY d.doc_id"""


_GROUPS = """list_transform(range(0, 8), lambda k: ('0x' || substring(sha, 5 * k + 1, 5))::BIGINT)"""
_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
_BASE32 = (
    "array_to_string(list_transform("
    + _GROUPS
    + ", lambda v: "
    + " || ".join(f"substring({_LETTERS}, ((v >> {s}) & 31) + 1, 1)" for s in (15, 10, 5, 0))
    + "), '')"
)
ARCHIVES = f"""
WITH hashed AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS size, sha1(coalesce(html, '')) AS sha FROM pages
),
placed AS (SELECT *, max(page_id) OVER (PARTITION BY sha) AS last FROM hashed)
SELECT page_id, size::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id < last THEN last END AS refers_to
FROM placed"""

# Shingles are compared as texts; a pair needs a shingle in common. Labels go along links until nothing changes.
NEAR_DUPLICATES = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
),
shingles AS (
  SELECT DISTINCT doc_id, hash(s) AS s FROM (
    SELECT doc_id, array_to_string(w, ' ') AS s FROM split WHERE len(w) BETWEEN 1 AND 4
    UNION ALL
    SELECT doc_id, array_to_string(w[i:i + 4], ' ') FROM (
      SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM split WHERE len(w) >= 5))
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
),
links AS (
  SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * c >= 75 * (p.n + q.n - c)
),
reach AS (SELECT doc_id, doc_id AS seen FROM documents UNION SELECT r.doc_id, y FROM reach r JOIN links ON x = seen),
labels AS (SELECT doc_id, min(seen) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN sizes z ON z.doc_id = d.doc_id"""

# Bytes are written as two hexadecimal digits each; a window is 100 of them.
REPEATED_BYTES = """
WITH texts AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n, hex(encode(coalesce(text, ''))) AS digits FROM documents
),
windows AS (
  SELECT doc_id, i, hash(substring(digits, 2 * i + 1, 100)) AS w
  FROM (SELECT doc_id, digits, unnest(range(0, n - 49)) AS i FROM texts WHERE n >= 50)
),
earliest AS (SELECT w, min(doc_id) AS earliest FROM windows GROUP BY w),
hits AS (SELECT doc_id, i FROM windows JOIN earliest USING (w) WHERE earliest < doc_id),
marked AS (
  SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM hits
),
numbered AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM numbered GROUP BY doc_id, run),
ordered AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans),
cut AS (
  SELECT t.doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans,
         string_agg(substring(digits, 2 * before + 1, 2 * (a - before)), '' ORDER BY a)
           || substring(any_value(digits), 2 * max(b) + 1) AS kept
  FROM ordered o JOIN texts t ON t.doc_id = o.doc_id GROUP BY t.doc_id
)
SELECT t.doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, digits))) AS kept_sha256
FROM texts t LEFT JOIN cut c ON c.doc_id = t.doc_id"""



def _add(cost: str, letters: str, state: str) -> str:
    return f"{{'c': {state}.c + {cost}, 'a': '{letters}' || {state}.a}}"


def _row(state: str, onward: str, keeps: dict[str, str]) -> str:
    """The cheapest way on from a state at a row, the smaller letters if equal: Delete, Keep or Rerole."""
    options = [_add("4", "D", state), f"CASE WHEN fault < 2 THEN {_add('3 + more', 'R', onward)} END"]
    for initial, to in keeps.items():
        options.append(f"CASE WHEN fault < 2 AND role LIKE '{initial}%' THEN {_add('more', 'K', to)} END")
    return f"list_min([{', '.join(options)}])"


# A dynamic program from the last row to the first: best[state] is the least cost behind a row with its letters. Inserted
# turns lead from user to assistant, from all other states to user.
CONVERSATIONS = rf"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(0, 256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
         lambda c, k: xor(c >> 1, 3988292384 * (c & 1)))) AS t
),
named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name
  FROM conversations
),
drawn AS (
  SELECT conv_id, turn, role, text, xor(4294967295, list_reduce(list_concat([4294967295],
         list_transform(string_split(name, ''), lambda x: ascii(x)::BIGINT)),
         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 20 AS kind
  FROM named, crc
),
damaged AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE kind WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM drawn WHERE kind <> 0
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM damaged
),
counted AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen FROM placed),
judged AS (
  SELECT *, CASE WHEN blank OR seen > 1 THEN 2 WHEN cut THEN 1 ELSE 0 END AS fault,
         CASE WHEN cut THEN 3 ELSE 0 END AS more,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair
  FROM (SELECT *, NOT regexp_matches(text, '[^ 	-]') AS blank,
               NOT regexp_matches(text, '[.!?][ 	-]*\z') AS cut FROM counted)
),
best AS (
  SELECT conv_id, count(*)::BIGINT + 1 AS i, {{'c': 0, 'a': ''}} AS s, {{'c': 6, 'a': 'II'}} AS y,
         {{'c': 3, 'a': 'I'}} AS u, {{'c': 0, 'a': ''}} AS v
  FROM judged GROUP BY conv_id
  UNION ALL
  SELECT conv_id, i, list_min([s, {_add("3", "I", "u")}, {_add("6", "II", "v")}]),
         list_min([y, {_add("3", "I", "u")}, {_add("6", "II", "v")}]), list_min([u, {_add("3", "I", "v")}]),
         list_min([v, {_add("3", "I", "u")}])
  FROM (SELECT conv_id, j.i, {_row("s", "u", {"s": "y", "u": "u"})} AS s, {_row("y", "u", {"u": "u"})} AS y,
               {_row("u", "v", {"a": "v"})} AS u, {_row("v", "u", {"u": "u"})} AS v
        FROM best b JOIN judged j USING (conv_id) WHERE j.i = b.i - 1)
),
turns AS (
  SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY i) AS rows,
         coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE NOT blank AND seen > 1) AS duplicate,
         count(*) FILTER (WHERE fault = 1) AS truncated,
         count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id
),
edited AS (
  SELECT *, list_reduce(
    list_concat([{{'q': 0, 'i': 0::BIGINT, 't': ''}}],
                list_transform(string_split(audit, ''), lambda l: {{'q': 0, 'i': 0::BIGINT, 't': l}})),
    lambda z, l: CASE l.t
      WHEN 'D' THEN {{'q': z.q, 'i': z.i + 1, 't': z.t}}
      WHEN 'K' THEN {{'q': CASE left(rows[z.i + 1].role, 1) WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END, 'i': z.i + 1,
                      't': z.t || chr(10) || rows[z.i + 1].role || ':' || rows[z.i + 1].text}}
      WHEN 'R' THEN {{'q': CASE z.q WHEN 2 THEN 3 ELSE 2 END, 'i': z.i + 1,
                      't': z.t || chr(10) || CASE z.q WHEN 2 THEN 'assistant:' ELSE 'user:' END || rows[z.i + 1].text}}
      WHEN 'I' THEN {{'q': CASE z.q WHEN 2 THEN 3 ELSE 2 END, 'i': z.i,
                      't': z.t || chr(10) || CASE z.q WHEN 2 THEN 'assistant:' ELSE 'user:' END}}
      ELSE z END).t AS repaired
  FROM (SELECT t.*, b.s.c AS cost, b.s.a AS audit FROM turns t JOIN best b USING (conv_id) WHERE b.i = 1)
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0)::BIGINT AS cost,
       coalesce(audit, '') AS audit, sha256(coalesce(substring(repaired, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN edited e ON e.conv_id IS NOT DISTINCT FROM c.conv_id"""

ORACLES = {
    "op4_superminhash": NEAR_DUPLICATES,
    "op6_repeated_bytes": REPEATED_BYTES,
    "op7_secrets": secret_spans(secrets.BASE + secrets.MORE, len(secrets.BASE)),
    "op8_warc": ARCHIVES,
    "op11_conversation_repair": CONVERSATIONS,
}
