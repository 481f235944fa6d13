"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from artifactlink.llm.licenses import PHRASES, TEMPLATES
from artifactlink.llm.mixing import DOMAINS, WEIGHTS

EXACT_DEDUP = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def license_scan(threshold_percent: int = 80) -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    phrases = ", ".join(f"({quoted(p)}, {quoted(v)}, [{', '.join(map(quoted, p.split()))}])" for p, v in PHRASES.items())
    templates = ", ".join(f"({quoted(t)}, {quoted(v)})" for t, v in TEMPLATES)
    words = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {words.format("coalesce(text, '')")} AS w FROM documents),
phrases(phrase, label, pw) AS (VALUES {phrases}),
templates AS (SELECT row_number() OVER () AS k, label, list_distinct({words.format("body")}) AS tw, len({words.format("body")}) * 5 // 4 AS size FROM (VALUES {templates}) v(body, label)),
base AS (
  SELECT doc_id, label, i - 1 AS pos
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d WHERE list_contains(w, 'license')) x, phrases
  WHERE w[i : i + len(pw) - 1] = pw
),
base_docs AS (SELECT doc_id, count(*) AS n, min(pos) AS lo, max(pos) AS hi, list(DISTINCT label) AS labels FROM base GROUP BY doc_id),
may AS (SELECT doc_id, w, label, tw, size FROM (SELECT doc_id, w, list_distinct(w) AS dw FROM d WHERE len(w) > 0), templates WHERE 100 * len(list_intersect(dw, tw)) >= {threshold_percent} * len(tw)),
runs AS (SELECT doc_id, label, len(list_intersect(list_distinct(w[i : i + size - 1]), tw)) AS n, len(tw) AS m FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM may)),
blocks AS (SELECT doc_id, label, n / m::DOUBLE AS share FROM runs WHERE 100 * n >= {threshold_percent} * m),
block_docs AS (SELECT doc_id, max(share) AS share, list(DISTINCT label) AS labels FROM blocks GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(b.n, 0)::BIGINT AS n_base, b.lo::BIGINT AS first_word, b.hi::BIGINT AS last_word,
       coalesce(array_to_string(list_sort(b.labels), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(k.labels, [])))), ','), '') AS labels,
       CASE WHEN b.n > 0 THEN 1.0::DOUBLE ELSE coalesce(k.share, 0.0)::DOUBLE END AS score
FROM d LEFT JOIN base_docs b USING (doc_id) LEFT JOIN block_docs k USING (doc_id)
"""


def mixing(numer: int = 7, denom: int = 10, epochs: int = 2, seed: int = 20) -> str:
    def weight(level: str) -> str:
        own = " ".join(f"WHEN '{v}' THEN {w}" for (at, v), w in WEIGHTS.items() if at == level)
        return f"CASE {level} {own} ELSE 1 END"

    domains = "[" + ", ".join(f"'{d}'" for d in DOMAINS) + "]"

    def dealt(name: str, nodes: str, parent: str, tie: str, keep: str) -> str:
        over = f"PARTITION BY {parent} ORDER BY (cap::HUGEINT * 1000000) // w, {tie}"
        return f"""
{name}_1 AS (
  SELECT *, row_number() OVER ({over}) AS k,
         parent_budget - coalesce(sum(cap) OVER ({over} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b_left,
         sum(w) OVER (PARTITION BY {parent}) - coalesce(sum(w) OVER ({over} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_left
  FROM ({nodes})
),
{name}_2 AS (SELECT *, min(CASE WHEN cap * w_left > w * b_left THEN k END) OVER (PARTITION BY {parent}) AS first_open FROM {name}_1),
{name} AS (
  SELECT {keep}, tokens, cap, CASE WHEN first_open IS NULL OR k < first_open THEN cap
    ELSE (w * max(CASE WHEN k = first_open THEN b_left END) OVER (PARTITION BY {parent})) // max(CASE WHEN k = first_open THEN w_left END) OVER (PARTITION BY {parent}) END AS budget
  FROM {name}_2
)"""

    key = f"md5(concat_ws(':', '{seed}', (whole + 1)::VARCHAR, coalesce(doc_id::VARCHAR, 'null')))"
    return rf"""
WITH sized AS (
  SELECT doc_id, {domains}[(instr('0123456789abcdef', substr(md5(coalesce(source, 'unknown')), 1, 1)) % {len(DOMAINS)}) + 1] AS domain,
         coalesce(lang, 'und') AS lang, coalesce(source, 'unknown') AS source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens
  FROM documents
),
leaves AS (SELECT domain, lang, source, sum(n_tokens) AS tokens, sum(n_tokens) * {epochs} AS cap FROM sized GROUP BY ALL),
root AS (SELECT least((sum(tokens) * {numer}) // {denom}, sum(cap)) AS parent_budget FROM leaves),
{dealt("a", f"SELECT domain, sum(tokens) AS tokens, sum(cap) AS cap, {weight('domain')} AS w, max(parent_budget) AS parent_budget FROM leaves, root GROUP BY domain", "1", "domain", "domain").strip()},
{dealt("b", f"SELECT l.domain, lang, sum(l.tokens) AS tokens, sum(l.cap) AS cap, {weight('lang')} AS w, max(a.budget) AS parent_budget FROM leaves l JOIN a USING (domain) GROUP BY l.domain, lang", "domain", "lang", "domain, lang").strip()},
{dealt("c", f"SELECT l.domain, l.lang, source, l.tokens, l.cap, {weight('source')} AS w, b.budget AS parent_budget FROM leaves l JOIN b USING (domain, lang)", "domain, lang", "source", "domain, lang, source").strip()},
leaf AS (SELECT *, budget // tokens AS whole, budget - (budget // tokens) * tokens AS rest FROM c WHERE budget > 0),
part AS (
  SELECT domain, lang, source, {key} AS key, rest, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY {key}) AS upto
  FROM sized JOIN leaf USING (domain, lang, source) WHERE whole < {epochs} AND rest > 0
),
stops AS (SELECT domain, lang, source, min(key) AS stop FROM part WHERE upto > rest GROUP BY ALL),
rows_ AS (
  SELECT doc_id, domain, lang, source, n_tokens, epoch, budget, whole, stop,
         md5(concat_ws(':', '{seed}', epoch::VARCHAR, coalesce(doc_id::VARCHAR, 'null'))) AS key
  FROM sized JOIN leaf USING (domain, lang, source) LEFT JOIN stops USING (domain, lang, source), (SELECT unnest(range(1, {epochs + 1})) AS epoch)
)
SELECT doc_id, domain, lang, source, n_tokens, epoch::INTEGER AS epoch, budget::BIGINT AS leaf_budget, key
FROM rows_ WHERE epoch <= whole OR (epoch = whole + 1 AND key < stop)
"""
