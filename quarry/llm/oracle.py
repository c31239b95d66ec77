"""The same results in DuckDB SQL, for the operators that SQL can express."""

from __future__ import annotations

from quarry.llm import chat_format as chat
from quarry.llm import url_filter as url
from quarry.llm.common import WORD_PATTERN

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{WORD_PATTERN}')"

OP2 = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, len(regexp_extract_all(text, '{chat.TOKEN}')) + {chat.MARKERS} AS tokens,
         length('<s><|' || replace(replace(replace(role, '%', '%25'), '|', '%7C'), '<', '%3C') || '|></s>')
         + CASE WHEN role = 'user' THEN length('[INST]  [/INST]') ELSE 0 END
         + length(text) + len(regexp_extract_all(text, '([<\[])(\\*)(/?(?:s>|INST\])|\|)')) AS chars,
         row_number() OVER w AS seq,
         role = 'system' AND sum(CASE WHEN role = 'system' THEN 1 ELSE 0 END) OVER (w ROWS UNBOUNDED PRECEDING) = 1 AS is_system
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), summed AS (
  SELECT *, CASE WHEN is_system THEN 0 ELSE tokens END AS cost,
         sum(CASE WHEN is_system THEN 0 ELSE tokens END) OVER (w ROWS UNBOUNDED PRECEDING) - CASE WHEN is_system THEN 0 ELSE tokens END AS before,
         max(CASE WHEN is_system THEN seq END) OVER (PARTITION BY conv_id) AS system_seq,
         max(CASE WHEN is_system THEN chars END) OVER (PARTITION BY conv_id) AS system_chars,
         max(CASE WHEN is_system THEN tokens END) OVER (PARTITION BY conv_id) AS system_tokens,
         {chat.BUDGET} - coalesce(max(CASE WHEN is_system THEN tokens END) OVER (PARTITION BY conv_id), 0) AS room,
         greatest(1, CASE WHEN room >= {2 * chat.HISTORY_BUDGET} THEN room - {chat.HISTORY_BUDGET} ELSE room END) AS cell,
         lag(tokens, 1) OVER w AS t1, lag(tokens, 2) OVER w AS t2, lag(chars, 1) OVER w AS c1, lag(chars, 2) OVER w AS c2,
         lag(is_system, 1) OVER w AS s1, lag(is_system, 2) OVER w AS s2
  FROM sized WINDOW w AS (PARTITION BY conv_id ORDER BY seq)
), placed AS (
  SELECT *, 2 * (before // cell) + CASE WHEN before // cell <> (before + greatest(cost, 1) - 1) // cell THEN 1 ELSE 0 END AS win FROM summed
), firsts AS (
  SELECT *, win IS DISTINCT FROM lag(win) OVER (PARTITION BY conv_id ORDER BY seq) AS opens, sum(tokens) OVER (PARTITION BY conv_id, win) AS own FROM placed
), given AS (
  SELECT *, coalesce(system_seq < seq, false) AS again, least({chat.HISTORY_BUDGET}, {chat.BUDGET} - own - CASE WHEN system_seq < seq THEN system_tokens ELSE 0 END) AS room_left FROM firsts
), counted AS (
  SELECT conv_id, seq, role, text, chars + CASE WHEN opens THEN
      CASE WHEN again THEN system_chars ELSE 0 END
      + CASE WHEN NOT s1 AND t1 <= room_left THEN c1 + CASE WHEN NOT s2 AND t1 + t2 <= room_left THEN c2 ELSE 0 END ELSE 0 END
    ELSE 0 END AS chars FROM given
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY seq)) AS turns_sha256,
       CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY seq), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM counted GROUP BY conv_id
"""

OP3 = f"""
WITH item_words AS (
  SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL
), windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM item_words WHERE len(w) > 0)
), doc_words AS (
  SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents
), hits AS (
  SELECT d.r, d.i, d.n, windows.item_id
  FROM (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM doc_words, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n) d
  JOIN windows ON windows.n = d.n AND windows.phrase = array_to_string(d.w[d.i : d.i + d.n - 1], ' ')
), covered AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r
), listed AS (
  SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN covered USING (r) LEFT JOIN listed USING (r)
"""

OP6 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, max(CAST(list_inner_product(q.e, c.e) AS BIGINT)) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e) GROUP BY ALL
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
"""


def _alike(part: str, of: str, all_parts: str, all_of: str) -> str:
    share = f"({all_parts} / {all_of})"
    return (
        f"CASE WHEN {of} = 0 OR {all_of} = {of} THEN true ELSE abs({part} / {of} - ({all_parts} - {part}) / ({all_of} - {of})) "
        f"<= {url.DIFFERENT} * sqrt({share} * (1 - {share}) * (1 / {of} + 1 / ({all_of} - {of}))) + 1e-9 END"
    )


def _url_sql() -> str:
    rules = sorted(url.RULES, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))
    fits = [f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for h, p, _ in rules]
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{h}{p}'" for f, (h, p, _) in zip(fits, rules, strict=True)) + " END"
    label = "CASE " + " ".join(f"WHEN {f} THEN '{v}'" for f, (_, _, v) in zip(fits, rules, strict=True)) + " END"
    prior = "(SELECT (coalesce(sum(nb), 0) + 1) / (coalesce(sum(nl), 0) + 2) FROM tree)"
    return f"""
WITH RECURSIVE parsed AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS h, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM parsed
), hosts AS (
  SELECT page_id, {_LOWER.format("h")} AS host, path FROM split
), judged AS (
  SELECT *, {rule} AS rule, {label} AS label,
         list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: regexp_replace(s, '[0-9]+', '#', 'g')) AS shape FROM hosts
), tree AS (
  SELECT host, shape, count(*) AS n, count(label) AS nl, count(*) FILTER (label = 'block') AS nb FROM judged WHERE host <> '' GROUP BY ALL
), walk AS (
  SELECT host, shape, shape[:0] AS t, shape AS rest FROM tree
  UNION ALL
  SELECT host, shape, list_append(t, CASE WHEN count(DISTINCT rest[1]) OVER (PARTITION BY host, t) > {url.FAN_OUT} THEN '*' ELSE rest[1] END), rest[2:]
  FROM walk WHERE len(rest) > 0
), ended AS (SELECT host, shape, t FROM walk WHERE len(rest) = 0),
leaves AS (SELECT host, t, sum(n) AS n, sum(nl) AS nl, sum(nb) AS nb FROM tree JOIN ended USING (host, shape) GROUP BY ALL),
places AS (
  SELECT host, t, n, nl, nb, t[:d - 1] AS before, t[d + 1:] AS after, sum(n) OVER (PARTITION BY host, t[:d]) AS bn
  FROM (SELECT *, unnest(range(1, len(t) + 1)) AS d FROM leaves)
), pools AS (
  SELECT *, count(*) OVER w AS leaves, sum(n) OVER w AS pn, sum(nl) OVER w AS pl, sum(nb) OVER w AS pb, sum(bn) OVER w AS pbn
  FROM places WINDOW w AS (PARTITION BY host, before, after)
), merged AS (
  SELECT * FROM pools WHERE leaves > 1 AND pl > 0 AND {_alike("n", "bn", "pn", "pbn")} AND {_alike("nb", "nl", "pb", "pl")}
), pooled AS (
  SELECT host, t, n, nl, nb, sum(n) OVER w - n AS mn, sum(nl) OVER w - nl AS ml, sum(nb) OVER w - nb AS mb FROM merged WINDOW w AS (PARTITION BY host, before, after)
), counted AS (
  SELECT host, t, any_value(l.n) + coalesce(sum(mn), 0) AS n, any_value(l.nl) + coalesce(sum(ml), 0) AS nl, any_value(l.nb) + coalesce(sum(mb), 0) AS nb
  FROM leaves l LEFT JOIN pooled USING (host, t) GROUP BY host, t
), rejected AS (
  SELECT host, t FROM counted WHERE nl >= {url.LABELS} AND nl >= {url.SEEN} * n AND (nb + {url.WEIGHT} * {prior}) / (nl + {url.WEIGHT}) >= {url.PURITY}
), shapes AS (SELECT host, shape FROM ended JOIN rejected USING (host, t))
SELECT page_id, judged.host, path, rule, coalesce(label, CASE WHEN shapes.host IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM judged LEFT JOIN shapes USING (host, shape)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_format": OP2, "op3_decontamination": OP3, "op6_top_k": OP6, "op7_url_filter": _url_sql()}
