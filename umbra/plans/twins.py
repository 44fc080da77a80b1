"""SQL twins of the text operators, for DuckDB: common table expressions that
follow the operators' contracts by relational means."""

from __future__ import annotations

import re

from ..functions.patterns import KEYS, PSEUDONYM, SPANS
from ..operators.cohort import DECOYS
from ..operators.detect import GAZETTEER
from .fixtures import PROMPTS, REPLIES


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


TOKEN = PSEUDONYM.replace("(", "(?:", 1)
NAMES = [(kind, re.escape(n)) for kind, row in GAZETTEER.items() for n in row]
API_KEY = chr(92) + "b" + KEYS + chr(92) + "b"


def found(src: str, out: str, patterns=SPANS) -> str:
    """Spans of each pattern, each scanned alone, without those that another one
    overlaps which starts before, is longer or comes first: rid, kind, text, s
    and e (bytes), c (characters before it), i (its place in the row)."""
    pats = ", ".join(f"({quoted(k)}, {i}, {quoted(p)})" for i, (k, p) in enumerate(patterns))
    before = lambda f: f"CAST(list_sum(list_transform(g[1:i], lambda x: {f}(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: {f}(x))), 0) AS INT)"
    return f"""{out}_pats(kind, ord, pat) AS (VALUES {pats}),
{out}_hits AS (SELECT rid, kind, ord, regexp_extract_all(text, pat) AS m, regexp_split_to_array(text, pat) AS g FROM {src}, {out}_pats WHERE text IS NOT NULL),
{out}_each AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM {out}_hits),
{out}_raw AS (SELECT rid, kind, ord, m[i] AS text, {before("strlen")} AS s, {before("length")} AS c FROM {out}_each),
{out}_all AS (SELECT *, s + CAST(strlen(text) AS INT) AS e FROM {out}_raw),
{out} AS (SELECT rid, kind, text, s, e, c, row_number() OVER (PARTITION BY rid ORDER BY s) - 1 AS i FROM {out}_all a WHERE NOT EXISTS (SELECT 1 FROM {out}_all b
  WHERE a.rid = b.rid AND b.s < a.e AND a.s < b.e AND (b.s < a.s OR b.s = a.s AND (b.e > a.e OR b.e = a.e AND b.ord < a.ord))))"""


def mapped(src: str, column: str, out: str, known: str, key: str, value: str) -> str:
    """src with ``done``: each token of the column that the session's table has, replaced."""
    return f"""{out}_t AS (SELECT rid, session_id, regexp_extract_all({column}, '{TOKEN}') AS m, regexp_split_to_array({column}, '{TOKEN}') AS g FROM {src} WHERE {column} IS NOT NULL),
{out}_k AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM {out}_t),
{out}_p AS (SELECT k.rid, list(g[i] || coalesce(d.{value}, m[i]) ORDER BY i) AS x, any_value(g[len(g)]) AS tail FROM {out}_k k LEFT JOIN {known} d ON d.session_id IS NOT DISTINCT FROM k.session_id AND d.{key} = m[i] GROUP BY k.rid),
{out} AS (SELECT s.*, CASE WHEN p.x IS NULL THEN s.{column} ELSE array_to_string(p.x, '') || p.tail END AS done FROM {src} s LEFT JOIN {out}_p p ON s.rid = p.rid)"""


FOUND = f"prompts AS ({PROMPTS}),\n{found('prompts', 'spans')}"
MINTED = f"""{FOUND},
sp AS (SELECT p.session_id, p.seq, s.* FROM spans s JOIN prompts p ON s.rid = p.rid),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id, text ORDER BY seq, i, kind) AS r FROM sp) WHERE r = 1),
minted AS (SELECT session_id, text AS norm, text AS canonical, kind, n, kind || '_' || CAST(n AS STRING) AS pseudonym, seq, CAST(i AS INT) AS ord
  FROM (SELECT *, CAST(row_number() OVER (PARTITION BY session_id, kind ORDER BY seq, i, text) AS INT) AS n FROM firsts))"""
SAFE = f"""{MINTED},
named AS (SELECT s.*, m.pseudonym FROM sp s JOIN minted m ON s.session_id IS NOT DISTINCT FROM m.session_id AND s.text = m.norm),
lists AS (SELECT rid, list(text ORDER BY s) AS t, list(pseudonym ORDER BY s) AS p, list(c ORDER BY s) AS a FROM named GROUP BY rid),
safe AS (SELECT p.rid, p.session_id, p.seq, p.text, CASE WHEN l.t IS NULL THEN p.text ELSE
  array_to_string(list_transform(range(1, len(l.t) + 1), lambda i: substr(p.text, CASE WHEN i = 1 THEN 1 ELSE l.a[i - 1] + length(l.t[i - 1]) + 1 END, CASE WHEN i = 1 THEN l.a[1] ELSE l.a[i] - l.a[i - 1] - length(l.t[i - 1]) END) || l.p[i]), '')
  || substr(p.text, l.a[len(l.a)] + length(l.t[len(l.t)]) + 1) END AS safe FROM prompts p LEFT JOIN lists l ON p.rid = l.rid)"""
RESTORED = f"{SAFE},\n{mapped('safe', 'safe', 'restored', 'minted', 'pseudonym', 'canonical')}"
AUDIT = f"""{MINTED}, replies AS ({REPLIES}),
{found('replies', 'toks', [('', TOKEN)])},
{found('replies', 'leaks')},
findings AS (SELECT t.rid, t.s, t.e, t.c, t.text, 'unknown_pseudonym' AS type, CASE WHEN split_part(t.text, '_', 1) = 'PII' THEN 'custom' ELSE lower(split_part(t.text, '_', 1)) END AS kind, 0 AS src
  FROM toks t JOIN replies r ON t.rid = r.rid WHERE NOT EXISTS (SELECT 1 FROM minted m WHERE m.session_id IS NOT DISTINCT FROM r.session_id AND m.pseudonym = t.text)
  UNION ALL SELECT rid, s, e, c, text, 'likely_leaked', lower(kind), 1 FROM leaks)"""
REDACTED = f"""{AUDIT},
cuts AS (SELECT * FROM findings a WHERE NOT EXISTS (SELECT 1 FROM findings b WHERE a.rid = b.rid AND (b.s < a.s AND b.e > a.s OR b.s = a.s AND b.src < a.src))),
lists AS (SELECT rid, list(text ORDER BY s) AS t, list(c ORDER BY s) AS a FROM cuts GROUP BY rid),
redacted AS (SELECT r.rid, CASE WHEN l.t IS NULL THEN r.text ELSE
  array_to_string(list_transform(range(1, len(l.t) + 1), lambda i: substr(r.text, CASE WHEN i = 1 THEN 1 ELSE l.a[i - 1] + length(l.t[i - 1]) + 1 END, CASE WHEN i = 1 THEN l.a[1] ELSE l.a[i] - l.a[i - 1] - length(l.t[i - 1]) END) || '[REDACTED]'), '')
  || substr(r.text, l.a[len(l.a)] + length(l.t[len(l.t)]) + 1) END AS text FROM replies r LEFT JOIN lists l ON r.rid = l.rid)"""
#: Names of each prompt in order of their first place, with their number within the kind.
COHORT = f"""{SAFE},
ct AS (SELECT rid, regexp_extract_all(safe, '{TOKEN}') AS m, regexp_split_to_array(safe, '{TOKEN}') AS g FROM safe WHERE safe IS NOT NULL),
ck AS (SELECT rid, m[i] AS tok, split_part(m[i], '_', 1) AS kind, g[i] AS gap, g[len(g)] AS tail, i FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM ct)),
names AS (SELECT rid, tok, kind, spot, row_number() OVER (PARTITION BY rid, kind ORDER BY spot) - 1 AS idx FROM (SELECT rid, tok, kind, min(i) AS spot FROM ck GROUP BY ALL)),
profiles AS (SELECT rid, string_agg(kind, '|' ORDER BY kind) AS profile FROM names GROUP BY rid),
crowded AS (SELECT DISTINCT rid FROM (SELECT rid, kind, count(*) AS n FROM names GROUP BY ALL) WHERE 3 * n > 16),
js AS (SELECT unnest([0, 1, 2]) AS j),
renamed AS (SELECT n.rid, j, n.tok, n.kind, n.idx, n.kind || '_' || CAST(10001 + n.idx * 3 + j AS STRING) AS name FROM names n, js),
other AS (SELECT k.rid, r.j, list(k.gap || r.name ORDER BY k.i) AS x, any_value(k.tail) AS tail FROM ck k JOIN renamed r ON k.rid = r.rid AND k.tok = r.tok GROUP BY k.rid, r.j),
members AS (SELECT s.rid, s.session_id, s.seq, 0 AS member, s.safe AS text, c.rid IS NOT NULL AS alone FROM safe s LEFT JOIN crowded c ON s.rid = c.rid
  UNION ALL SELECT s.rid, s.session_id, s.seq, js.j + 1, CASE WHEN o.x IS NULL THEN s.safe ELSE array_to_string(o.x, '') || o.tail END, false
  FROM safe s JOIN js ON true LEFT JOIN other o ON s.rid = o.rid AND o.j = js.j WHERE s.rid NOT IN (SELECT rid FROM crowded))"""
_FILL = "template"
for _kind in ("EMAIL", "PATH", "IP", "URL", "UUID", "PERSON", "LOCATION", "ORG"):
    _FILL = f"replace({_FILL}, '{{{_kind}}}', coalesce((SELECT name FROM renamed r WHERE r.rid = m.rid AND r.j = m.member - 1 AND r.kind = '{_kind}' AND r.idx = 0), ''))"
DECOYED = f"""{COHORT},
decoys(profile, idx, template) AS (VALUES {", ".join(f"({quoted(k)}, {i}, {quoted(t)})" for k, row in DECOYS.items() for i, t in enumerate(row))}),
many AS (SELECT profile, count(*) AS n FROM decoys GROUP BY profile)"""
DECOY_TEXT = f"CASE WHEN m.member = 0 OR d.template IS NULL THEN m.text ELSE {_FILL} END"
