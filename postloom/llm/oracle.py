"""SQL of the queries that SQL can express over whole tables."""

P4 = """
SELECT section, cluster_id, topic_id FROM (
  SELECT section, cluster_id, topic_id, row_number() OVER (PARTITION BY section, cluster_id ORDER BY score DESC, topic_id) AS rn
  FROM (SELECT section, cluster_id, topic_id, max(score) AS score FROM message_clusters
        WHERE cluster_id <> -1 AND score IS NOT NULL AND NOT isnan(score) AND topic_id IS NOT NULL GROUP BY ALL))
WHERE rn <= 5"""

P5 = """
WITH v AS (
  SELECT 'post/' || post_id AS name, min(emb) AS emb FROM post_embeddings WHERE emb IS NOT NULL GROUP BY 1
  UNION ALL
  SELECT 'title/' || section || '/' || cluster_id, min(title_emb) FROM cluster_topics_by_section WHERE title_emb IS NOT NULL GROUP BY 1),
u AS (SELECT name, emb::DOUBLE[] AS emb, sqrt(list_dot_product(emb::DOUBLE[], emb::DOUBLE[])) AS norm FROM v)
SELECT a.name AS vec_a, b.name AS vec_b FROM u a JOIN u b ON a.name < b.name
WHERE a.norm > 0 AND b.norm > 0 AND list_dot_product(a.emb, b.emb) >= (0.95 - 1e-7) * a.norm * b.norm"""

_TERMS = """
one AS (SELECT id, max(text_clean) AS t FROM topics GROUP BY id),
tp AS (SELECT 'topic' AS rec_type, id::VARCHAR AS rec_key, unnest(regexp_extract_all(lower(t), '[a-zа-яё]{3,}')) AS term FROM one),
st AS (SELECT DISTINCT 'style' AS rec_type, section || '/' || cluster_id AS rec_key,
         unnest(list_concat(coalesce(top_ngrams, []), coalesce(slang_ngrams, []))) AS term FROM cluster_style),
tf AS (SELECT rec_type, rec_key, term, count(*) AS tf FROM (SELECT * FROM tp UNION ALL SELECT * FROM st) WHERE term IS NOT NULL GROUP BY ALL),
n AS (SELECT 'topic' AS rec_type, count(DISTINCT id) AS n FROM topics UNION ALL
      SELECT 'style', count(*) FROM (SELECT DISTINCT section, cluster_id FROM cluster_style))"""

P6 = f"""
WITH {_TERMS},
s AS (SELECT rec_type, rec_key, term, tf, count(*) OVER (PARTITION BY rec_type, term) AS d, n FROM tf JOIN n USING (rec_type)),
w AS (SELECT *, tf * ln(n / d) AS score FROM s WHERE d > 1),
m AS (SELECT *, max(score) OVER (PARTITION BY rec_type, rec_key) AS best FROM w)
SELECT rec_type, rec_key, term FROM m WHERE score >= best - 1e-9 AND d <= 5 AND (rec_type = 'style' OR tf >= 2)"""

P6_STYLE = f"""
WITH {_TERMS},
s AS (SELECT rec_key, term, tf, sum(tf) OVER (PARTITION BY term) AS cf, sum(tf) OVER (PARTITION BY rec_key) AS len,
        (SELECT n FROM n WHERE rec_type = 'style') AS n, (SELECT sum(tf) FROM tf WHERE rec_type = 'style') AS total
      FROM tf WHERE rec_type = 'style'),
x AS (SELECT *, tf * log2(1 + (total / n) / len) AS tfn, cf / n AS mean FROM s)
SELECT rec_key, term, round((log2(1 + mean) + tfn * log2((1 + mean) / mean)) / (tfn + 1), 6) AS dfr FROM x"""

P6_ALL = f"""
WITH {_TERMS},
s AS (SELECT rec_type, rec_key, term, tf, sum(tf) OVER (PARTITION BY rec_type, term) AS cf, sum(tf) OVER (PARTITION BY rec_type, rec_key) AS len, sum(tf) OVER (PARTITION BY rec_type) AS total, n FROM tf JOIN n USING (rec_type)),
x AS (SELECT *, tf * log2(1 + (total / n) / len) AS tfn, cf / n AS mean FROM s)
SELECT rec_type, rec_key, term, round((log2(1 + mean) + tfn * log2((1 + mean) / mean)) / (tfn + 1), 6) AS dfr FROM x"""

# Signs of markup in the pattern language of the database, which looks neither ahead nor back.
_S, _B, _W = r"[\s\p{Z}]", r"\s\p{Z}", r"[\p{L}\p{N}_]"
_MARKUP = {
    "html": rf"</?[a-zA-Z][a-zA-Z0-9]{{0,14}}(?:{_S}+[a-zA-Z_:](?:{_W}|[:-])*(?:{_S}*={_S}*(?:\"[^\"]*\"|'[^']*'|[^{_B}\"'<>]+))?)*{_S}*/?>|<!--|-->|<!DOCTYPE|&(?:[a-zA-Z]{{2,8}}\p{{Nd}}{{0,2}}|#\p{{Nd}}{{1,7}}|#[xX][0-9a-fA-F]{{1,6}});",
    "markdown": rf"^ {{0,3}}#{{1,6}} +[^{_B}]|\*\*[^{_B}*](?:[^*\n]*[^{_B}*])?\*\*|(?:^|[^\p{{L}}\p{{N}}_])__[^{_B}_](?:[^\n]*?[^{_B}_])?__(?:$|[^\p{{L}}\p{{N}}_])|!?\[[^\]\n]*\]\([^(){_B}]+(?:{_S}+\"[^\"]*\")?\)|^ {{0,3}}(?:```|~~~)"
    rf"|`[^`\n]+`|^{_S}*[-*+] \[[ xX]\] |^ {{0,3}}> ?[^{_B}]|^ {{0,3}}\|(?: ?:?-{{3,}}:? ?\|)+{_S}*$|~~[^{_B}~](?:[^~\n]*[^{_B}~])?~~",
    "wiki": rf"^{_S}*(?:==[^=\n]+==|===[^=\n]+===|====[^=\n]+====|=====[^=\n]+=====|======[^=\n]+======){_S}*$|'''?[^'\n]+'''?|\[\[[^\[\]\n]+\]\]|\{{\{{[^{{}}\n]*\}}\}}|^{_S}*\{{\|[^\n]*$|^{_S}*\|\}}|^{_S}*\|-[^|\n]*$",
    "latex": r"\\(?:begin|end|emph|textbf|textit|texttt|underline|cite|ref|label|section|subsection|chapter|paragraph|item|frac|sqrt|sum|int|prod|leq|geq|neq|cdot|times|alpha|beta|gamma|footnote|url|href|left|right|infty)(?:[^a-zA-Z]|\z)|\\\[|\\\]|\\\(|\\\)"
    r"|\$\$[^$]+\$\$|\$[^$\n]*[\\^_{}][^$\n]*\$",
}


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


P7 = """
WITH o AS (SELECT id, text, text_clean, row_number() OVER (PARTITION BY id ORDER BY coalesce(source, chr(0)), text NULLS LAST, text_clean NULLS LAST) AS rn FROM topics WHERE id IS NOT NULL),
f AS (SELECT id AS topic_id, 'text' AS rec_field, text AS t FROM o WHERE rn = 1 UNION ALL SELECT id, 'text_clean', text_clean FROM o WHERE rn = 1)
""" + " UNION ALL ".join(f"SELECT topic_id, rec_field, '{kind}' AS markup_type FROM f WHERE regexp_matches(t, {_quoted('(?m)' + pattern)})" for kind, pattern in _MARKUP.items())

SQL = {"p4_found": P4, "p5_found": P5, "p6_found": P6, "p6_style_scores": P6_STYLE, "p6_scores": P6_ALL, "p7_found": P7}
