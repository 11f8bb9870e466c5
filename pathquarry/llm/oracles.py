"""DuckDB SQL for the rows of those queries that SQL can express."""

from __future__ import annotations

from . import quality_rules as q
from . import secret_scan

_WORDS = r"list_filter(regexp_split_to_array({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def jaccard_join() -> str:
    words = _WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
    return f"""WITH RECURSIVE w AS (SELECT doc_id, {words} AS ws FROM documents),
    s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
    l AS (SELECT x, y FROM p JOIN n na ON x = na.doc_id JOIN n nb ON y = nb.doc_id WHERE 100 * o >= 80 * (na.n + nb.n - o)),
    e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
    r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.y FROM r JOIN e ON r.b = e.x)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) c USING (doc_id)"""


def quality_rules() -> str:
    rules = list(q.RULES)
    cuts = " UNION ALL ".join(f"SELECT '{r}' AS rule, {k} AS k, CAST({c} AS DOUBLE) AS cut, CAST({q.RISK[r]} AS DOUBLE) AS risk" for r, cs in q.RULES.items() for k, c in enumerate(cs))
    values = ", ".join(f"('{r}', {r})" for r in rules)
    return rf"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text FROM documents),
    w AS (SELECT *, {_WORDS.format(text='text')} AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
    g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM (SELECT doc_id, i, array_to_string(ws[i : i + 7], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w))),
    rep AS (SELECT doc_id, count(DISTINCT word_at) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS word_at FROM g WHERE n > 1) GROUP BY doc_id),
    c AS (SELECT w.doc_id, stratum, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
      length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols, CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
      length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS n_upper FROM w LEFT JOIN rep USING (doc_id)),
    f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, n_symbols / greatest(n_words, 1) AS symbols_per_word, n_dup_lines / greatest(n_lines, 1) AS dup_line_share,
      n_repeat_words / greatest(n_words, 1) AS repeat_share, word_chars / greatest(n_words, 1) AS chars_per_word, n_upper / greatest(word_chars, 1) AS upper_share FROM c),
    named AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
    good AS (SELECT f.* FROM f JOIN named USING (doc_id) WHERE NOT base_failed QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY stratum, {', '.join(rules)}) = 1),
    t AS (SELECT stratum, v.rule, k, cut, risk, count(*) AS n, count(*) FILTER (v.x >= cut) AS hits FROM good, LATERAL (VALUES {values}) v(rule, x) JOIN ({cuts}) u ON u.rule = v.rule GROUP BY ALL),
    p AS (SELECT *, CASE WHEN hits > n * risk THEN 1.0 ELSE list_sum(list_transform(range(0, hits + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(risk) + (n - j) * ln(1 - risk)))) END
      <= {q.DELTA} / ({len(rules)} * (SELECT count(DISTINCT stratum) FROM good)) AS passed FROM t),
    z AS (SELECT stratum, rule, min(cut) AS cut FROM (SELECT *, min(CASE WHEN passed THEN 1 ELSE 0 END) OVER (PARTITION BY stratum, rule ORDER BY k) AS still FROM p) WHERE still = 1 GROUP BY ALL),
    bad AS (SELECT DISTINCT f.doc_id FROM f, LATERAL (VALUES {values}) v(rule, x) JOIN z ON z.rule = v.rule WHERE z.stratum = f.stratum AND v.x >= z.cut)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {', '.join(rules)}, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept FROM f"""


def oracle_sql() -> dict[str, str]:
    return {"op3_jaccard_join": jaccard_join(), "op5_secret_scan": secret_scan.ORACLE, "op9_quality_rules": quality_rules()}
