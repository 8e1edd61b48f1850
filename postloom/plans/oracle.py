"""SQL for the queries of the catalogue, over the same tables."""

from __future__ import annotations

_T = "t AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, hash, created_at) AS rn FROM topics) WHERE rn = 1)"
_M = "m AS (SELECT DISTINCT section, cluster_id, topic_id FROM message_clusters)"
_E = "e AS (SELECT post_id, min(emb) AS emb FROM post_embeddings WHERE emb IS NOT NULL GROUP BY post_id)"
_CT = """ct AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY section, cluster_id
  ORDER BY size_raw DESC NULLS LAST, size_kept DESC NULLS LAST, cohesion_raw DESC NULLS LAST, topic NULLS LAST) AS rn FROM cluster_topics_by_section) WHERE rn = 1)"""
_CS = """cs AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY section, cluster_id
  ORDER BY updated_at DESC NULLS LAST, avg_len_tokens DESC NULLS LAST) AS rn FROM cluster_style) WHERE rn = 1)"""
_REC = """rec AS (SELECT m.section, m.cluster_id,
  count(*) FILTER (WHERE t.created_at >= TIMESTAMPTZ '2025-07-01 00:00:00+00' - INTERVAL 7 DAY) AS cnt_7d,
  count(*) FILTER (WHERE t.created_at >= TIMESTAMPTZ '2025-07-01 00:00:00+00' - INTERVAL 30 DAY) AS cnt_30d
  FROM m JOIN t ON t.id = m.topic_id GROUP BY ALL)"""
_POP = """pc AS (SELECT p_partkey % 211 AS r, p_partkey, p_name AS phrase, count(*) AS cnt FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY ALL),
pr AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY cnt DESC, p_partkey) AS rn FROM pc),
pl AS (SELECT r, sum(cnt)::BIGINT AS total_count_30d FROM pr GROUP BY r),
pop AS (SELECT section, cluster_id, total_count_30d FROM ct JOIN pl ON cluster_id % 211 = r WHERE cluster_id % 9 <> 4)"""
_TR = """tr AS (SELECT section, cluster_id, total_count_30d, coalesce(cnt_7d, 0) AS cnt_7d, coalesce(cnt_30d, 0) AS cnt_30d,
  least(log10(1 + coalesce(total_count_30d, 0)) / 10, 1.0) * 0.7 + least(log10(1 + coalesce(cnt_7d, 0)), 1.0) * 0.2
  + least(log10(1 + coalesce(cnt_30d, 0)), 1.0) * 0.1 AS trend_score FROM pop LEFT JOIN rec USING (section, cluster_id))"""
_TREND = ",\n".join([_T, _M, _CT, _REC, _POP, _TR])
_CEN = """g AS (SELECT DISTINCT cluster_id, topic_id AS post_id FROM m WHERE cluster_id <> -1),
cx AS (SELECT cluster_id, i, avg(emb[i]::DOUBLE) AS x, count(*) AS n FROM (SELECT cluster_id, emb, unnest(range(1, 65)) AS i FROM g JOIN e USING (post_id)) GROUP BY ALL),
cen AS (SELECT cluster_id, list(x ORDER BY i) AS centroid, max(n)::INTEGER AS size FROM cx GROUP BY cluster_id)"""
_Q = "q AS (SELECT emb::DOUBLE[] AS v FROM e WHERE list_dot_product(emb::DOUBLE[], emb::DOUBLE[]) > 0 ORDER BY post_id LIMIT 1)"
_PS = "ps AS (SELECT m.section, m.cluster_id, t.id AS post_id, t.text, e.emb FROM m JOIN t ON t.id = m.topic_id JOIN e ON e.post_id = t.id WHERE m.cluster_id <> -1)"


def _words(x: str) -> str:
    return rf"list_sort(list_distinct(regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}]+')))"


def _trigrams(x: str) -> str:
    w = rf"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}]+')"
    return f"list_distinct(flatten(list_transform({w}, lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


def _trigram_similarity(a: str, b: str) -> str:
    x, y = _trigrams(f"coalesce({a}, '')"), _trigrams(b)
    return f"coalesce(len(list_intersect({x}, {y})) / nullif(len(list_distinct(list_concat({x}, {y}))), 0), 0)"


_HIT = f"list_has_all({_words('text')}, {_words("'board games'")})"
_CV = f"""cv AS (SELECT ct.section, ct.cluster_id, topic, title_emb, centroid, total_count_30d, coalesce(trend_score, 0) AS trend_score, avg_len_tokens, top_ngrams
  FROM ct JOIN cen USING (cluster_id) LEFT JOIN cs USING (section, cluster_id) LEFT JOIN pop USING (section, cluster_id)
  LEFT JOIN (SELECT section, cluster_id, trend_score FROM tr) USING (section, cluster_id)),
sc AS (SELECT *, 1 + list_dot_product(centroid, v) AS sim_centroid, 1 + list_dot_product(title_emb::DOUBLE[], v) AS sim_title,
  list_has_all({_words("section || ' ' || coalesce(topic, '')")}, {_words("'board games'")}) AS section_lex_hit, {_trigram_similarity('section', "'board games'")} AS section_trgm_sim FROM cv, q),
sf AS (SELECT *, coalesce(section_lex_hit::INTEGER, 0) * 0.7 + section_trgm_sim * 0.3 AS section_match_score,
  sim_centroid * 0.55 + coalesce(sim_title, 0) * 0.25 + trend_score * 0.2 AS final_score FROM sc),
nn AS (SELECT section, cluster_id FROM sf ORDER BY sim_centroid DESC, section, cluster_id LIMIT 8)"""
_VIEW = ",\n".join([_T, _M, _E, _CT, _CS, _REC, _POP, _TR, _CEN, _Q])
_SIM = "sm AS (SELECT *, 1 + list_dot_product(emb::DOUBLE[], v) AS sim FROM ps, q)"
_CL = "cl AS (SELECT m.section, m.cluster_id, m.topic_id AS post_id, t.text FROM m JOIN t ON t.id = m.topic_id WHERE m.cluster_id <> -1)"
_STOP = "'и','в','во','на','но','а','как','о','об','от','до','за','из','по','при','к','с','у','же','ли','или','что','это','то','так','там','тут','для','без','про','над','под','между','не','ни','да','ну','the','a','an','to','of','in','on','at','for','and','or','but','is','are','be','by','with','as','from'"
_HITS = """rq AS (SELECT request_id, max(text) AS text FROM moderation_requests GROUP BY request_id),
tm AS (SELECT DISTINCT CASE category WHEN 'abuse' THEN 'profanity' WHEN 'hate_target' THEN 'extremism_support' WHEN 'sexual' THEN 'illegal_content' END AS category, lemma, lower(form) AS form
  FROM moderation_terms WHERE form <> ''),
ht AS (SELECT DISTINCT request_id, category, lemma FROM rq JOIN tm ON contains(lower(text), form))"""
_TITLE = r"""regexp_replace(trim(topic), '^["''«»“”„`\s]+|["''«»“”„`.\s]+$', '', 'g')"""
_RESP = "rs AS (SELECT DISTINCT request_id, user_prompt, profile_prompt, bot_prompt, post_title, post_text FROM post_responses)"


def _block(tag: str, column: str) -> str:
    return f"CASE WHEN trim(coalesce({column}, '')) <> '' THEN '[{tag}]' || chr(10) || trim({column}) END"


_WHOLE = "regexp_replace(concat_ws(chr(10) || chr(10), post_title, post_text), '^\\s+|\\s+$', '', 'g')"
_LINE = lambda x: rf"trim(regexp_replace(regexp_replace({x}, '#', '', 'g'), '\s+', ' ', 'g'))"

SQL = {
    "recency": f"WITH {_T}, {_M}, {_REC} SELECT * FROM rec",
    "trend_score": f"WITH {_TREND} SELECT section, cluster_id, total_count_30d, cnt_7d, cnt_30d, round(trend_score, 9) AS trend_score FROM tr",
    "trend_top": f"WITH {_TREND} SELECT section, cluster_id, total_count_30d, cnt_7d, cnt_30d, round(trend_score, 9) AS trend_score FROM tr ORDER BY 6 DESC, section, cluster_id LIMIT 10",
    "topics_dedup": f"WITH {_T} SELECT id, hash FROM (SELECT id, hash, row_number() OVER (PARTITION BY hash ORDER BY id) AS rn FROM t) WHERE rn = 1",
    "topics_latest": f"WITH {_T} SELECT id, hash, section, epoch_us(updated_at) AS updated_us FROM t",
    "topics_insert_new": f"""WITH {_T}, n AS (SELECT id, hash, source, row_number() OVER (PARTITION BY hash ORDER BY id) AS rn FROM t WHERE source = 'board_main')
        SELECT id, hash, source FROM n WHERE rn = 1 AND hash NOT IN (SELECT hash FROM t WHERE source <> 'board_main' AND hash IS NOT NULL)""",
    "next_id": "SELECT greatest(1, coalesce(max(id), 0))::BIGINT AS last_id FROM topics",
    "pending_embeddings": f"WITH {_T} SELECT id, hash FROM t WHERE id NOT IN (SELECT post_id FROM post_embeddings WHERE post_id IS NOT NULL)",
    "pending_titles": f"WITH {_CT} SELECT section, cluster_id, topic FROM ct WHERE title_emb IS NULL AND topic IS NOT NULL AND trim(topic) <> ''",
    "popularity_wanted": rf"""WITH {_CT} SELECT section, cluster_id, left(trim(regexp_replace(regexp_replace(regexp_replace(topic, 'https?://\S+|www\.\S+', ' ', 'g'), '[^\p{{L}}\p{{N}}\s\-\+\.]', ' ', 'g'), '\s+', ' ', 'g')), 256) AS phrase
        FROM ct WHERE topic IS NOT NULL AND topic <> ''""",
    "embeddings_upsert": f"""WITH {_E}, {_CT}, n AS (SELECT cluster_id::BIGINT AS post_id, min(title_emb) AS emb FROM ct WHERE title_emb IS NOT NULL GROUP BY 1)
        SELECT post_id, round(list_dot_product(emb::DOUBLE[], emb::DOUBLE[]), 6) AS norm2 FROM (SELECT * FROM n UNION ALL SELECT * FROM e WHERE post_id NOT IN (SELECT post_id FROM n))""",
    "titles_update": f"WITH {_CT}, {_CS} SELECT ct.section, ct.cluster_id, coalesce(cs.top_ngrams[1], ct.topic) AS topic FROM ct LEFT JOIN cs USING (section, cluster_id)",
    "section_backfill": f"""WITH {_T}, {_M}, n AS (SELECT topic_id AS id, min(section) AS s FROM m WHERE section <> '' GROUP BY 1)
        SELECT id, coalesce(s, section, '') AS section FROM t LEFT JOIN n USING (id)""",
    "section_replace": f"WITH {_CT} SELECT section, cluster_id, CASE WHEN section = 'music' THEN upper(topic) ELSE topic END AS topic FROM ct",
    "style_latest": f"WITH {_CS} SELECT section, cluster_id, avg_len_tokens, p95_len_tokens, epoch_us(updated_at) AS updated_us FROM cs",
    "repeated_keys": "SELECT section, cluster_id, count(*) AS n FROM cluster_topics_by_section GROUP BY ALL HAVING count(*) > 1 OR section IS NULL OR cluster_id IS NULL",
    "centroids": f"WITH {_M}, {_E}, {_CEN} SELECT cluster_id, list_transform(centroid, lambda x: round(x, 6)) AS centroid, size FROM cen",
    "centroid_norms": f"""WITH {_M}, {_E}, {_CEN} SELECT cluster_id, round(sqrt(list_dot_product(centroid, centroid)), 6) AS norm,
        CASE WHEN list_dot_product(centroid, centroid) > 0 THEN 1.0 ELSE 0.0 END AS unit_norm FROM cen""",
    "cluster_sizes": f"WITH {_M} SELECT cluster_id, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM m GROUP BY cluster_id",
    "unit_vectors": f"WITH {_E} SELECT post_id, list_transform(emb, lambda x: round(x::DOUBLE / greatest(sqrt(list_dot_product(emb::DOUBLE[], emb::DOUBLE[])), 1e-8), 6)) AS unit FROM e",
    "vector_text": f"WITH {_E} SELECT post_id, len(emb)::INTEGER AS n, TRUE AS same FROM e",
    "retriever_view": f"""WITH {_VIEW}, {_CV} SELECT section, cluster_id, topic, total_count_30d, round(trend_score, 9) AS trend_score, round(sqrt(list_dot_product(centroid, centroid)), 6) AS norm,
        avg_len_tokens, coalesce(len(top_ngrams), 0)::INTEGER AS ngrams FROM cv""",
    "nn_clusters": f"""WITH {_VIEW}, {_CV} SELECT section, cluster_id, round(sim_centroid, 6) AS sim_centroid, round(sim_title, 6) AS sim_title, round(trend_score, 6) AS trend_score, round(section_trgm_sim, 6) AS section_trgm_sim,
        round(section_match_score, 6) AS section_match_score, round(final_score, 6) AS final_score, section_lex_hit FROM (SELECT cluster_id FROM nn) JOIN sf USING (cluster_id) ORDER BY sf.final_score DESC, section, cluster_id LIMIT 8""",
    "similar_posts": f"WITH {_T}, {_M}, {_E}, {_Q}, {_PS}, {_SIM} SELECT post_id, round(sim, 6) AS sim FROM sm WHERE section = 'pets' AND cluster_id = 0 ORDER BY sm.sim DESC, post_id LIMIT 8",
    "cosine_topn": f"""WITH {_E}, {_Q} SELECT post_id, round(list_cosine_similarity(emb::DOUBLE[], v), 6) AS cos FROM e, q WHERE list_dot_product(emb::DOUBLE[], emb::DOUBLE[]) > 0
        ORDER BY list_cosine_similarity(emb::DOUBLE[], v) DESC, post_id LIMIT 10""",
    "exemplar_posts": f"""WITH {_CT}, {_T}, x AS (SELECT section, cluster_id, unnest(range(0, least(len(exemplars), 4)::BIGINT)) AS position, exemplars FROM ct)
        SELECT x.section, cluster_id, position::INTEGER AS position, id AS post_id, text FROM x JOIN t ON t.id = exemplars[position + 1]""",
    "style_exemplars": f"""WITH {_T}, {_M}, {_E}, {_PS},
        u AS (SELECT section, cluster_id, post_id, list_transform(emb, lambda x: x::DOUBLE / greatest(sqrt(list_dot_product(emb::DOUBLE[], emb::DOUBLE[])), 1e-8)) AS u FROM ps),
        mx AS (SELECT section, cluster_id, i, avg(u[i]) AS x FROM (SELECT *, unnest(range(1, 65)) AS i FROM u) GROUP BY ALL),
        mn AS (SELECT section, cluster_id, list(x ORDER BY i) AS mean FROM mx GROUP BY ALL),
        c AS (SELECT u.section, u.cluster_id, post_id, round(list_dot_product(u, mean) / greatest(sqrt(list_dot_product(mean, mean)), 1e-8), 9) AS cos FROM u JOIN mn ON u.section = mn.section AND u.cluster_id = mn.cluster_id)
        SELECT section, cluster_id, post_id, round(cos, 6) AS cos, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY section, cluster_id ORDER BY cos DESC, post_id) AS rank FROM c) WHERE rank <= 5""",
    "lex_match": f"WITH {_T} SELECT id, len({_words('text')})::INTEGER AS words FROM t WHERE text IS NOT NULL AND {_HIT}",
    "trigram_sim": f"WITH {_CT}, s AS (SELECT section, cluster_id, round({_trigram_similarity('topic', "'board games'")}, 6) AS sim FROM ct) SELECT * FROM s WHERE sim > 0",
    "discover_clusters": f"""WITH {_T}, {_M}, {_E}, {_Q}, {_PS}, {_SIM}, top AS (SELECT * FROM sm ORDER BY sim DESC, post_id, section, cluster_id LIMIT 120)
        SELECT section, cluster_id, count(*) AS hits_in_top, round(avg(sim), 6) AS mean_sim, coalesce(sum({_HIT}::INTEGER), 0)::BIGINT AS lex_hits_in_top, sum((sim >= 1.4)::INTEGER)::BIGINT AS sem_hits_in_top
        FROM top WHERE cluster_id <> 0 GROUP BY section, cluster_id ORDER BY lex_hits_in_top DESC, sem_hits_in_top DESC NULLS LAST, hits_in_top DESC, round(avg(sim), 9) DESC, section, cluster_id LIMIT 5""",
    "rerank_posts": f"""WITH {_T}, {_M}, {_E}, {_Q}, {_PS}, {_SIM},
        r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY sim DESC, post_id, section) AS rn, count(*) OVER (PARTITION BY cluster_id) AS cluster_size FROM sm),
        top AS (SELECT * FROM r ORDER BY sim DESC, post_id, section, cluster_id LIMIT 3000)
        SELECT cluster_id, max(cluster_size) AS cluster_size, sum((sim >= 1.4)::INTEGER)::BIGINT AS post_hits_at_tau, sum({_HIT}::INTEGER)::BIGINT AS lex_hits_count, round(avg(sim) FILTER (WHERE rn <= 50), 6) AS post_topk_mean_sim,
        round(sum((sim >= 1.4)::INTEGER) / nullif(max(cluster_size), 0), 6) AS post_dens_at_tau, round(sum({_HIT}::INTEGER) / nullif(max(cluster_size), 0), 6) AS lex_dens FROM top WHERE cluster_id BETWEEN 0 AND 59 GROUP BY cluster_id""",
    "candidates_ranked": f"""WITH {_VIEW}, {_CV}, {_PS}, {_SIM},
        s1 AS (SELECT section, cluster_id, row_number() OVER (ORDER BY final_score DESC, section, cluster_id) - 1 AS position FROM (SELECT sf.section, sf.cluster_id, sf.final_score FROM nn JOIN sf USING (cluster_id) ORDER BY final_score DESC, section, cluster_id LIMIT 3)),
        lk AS (SELECT section FROM s1 WHERE position = 0),
        lp AS (SELECT sm.* FROM sm WHERE section = (SELECT section FROM lk)),
        tp AS (SELECT * FROM lp ORDER BY sim DESC, post_id, section, cluster_id LIMIT 120),
        dc AS (SELECT section, cluster_id, coalesce(sum({_HIT}::INTEGER), 0) AS a, sum((sim >= 1.4)::INTEGER) AS b, count(*) AS c, round(avg(sim), 9) AS d FROM tp WHERE cluster_id NOT IN (SELECT cluster_id FROM s1) GROUP BY section, cluster_id
               ORDER BY a DESC, b DESC NULLS LAST, c DESC, d DESC, section, cluster_id LIMIT 5),
        al AS (SELECT section, cluster_id, position FROM s1 UNION ALL SELECT section, cluster_id, 2 + row_number() OVER (ORDER BY a DESC, b DESC NULLS LAST, c DESC, d DESC, section, cluster_id) FROM dc),
        li AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY position) AS rn FROM al WHERE EXISTS (SELECT 1 FROM sf WHERE sf.section = al.section AND sf.cluster_id = al.cluster_id)) WHERE rn = 1),
        r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY sim DESC, post_id, section) AS rn, count(*) OVER (PARTITION BY cluster_id) AS cluster_size FROM lp),
        top AS (SELECT * FROM r ORDER BY sim DESC, post_id, section, cluster_id LIMIT (SELECT 50 * count(DISTINCT cluster_id) FROM al)),
        ev AS (SELECT cluster_id, max(cluster_size) AS cluster_size, avg(sim) FILTER (WHERE rn <= 50) AS post_topk_mean_sim, sum((sim >= 1.4)::INTEGER)::BIGINT AS post_hits_at_tau, sum({_HIT}::INTEGER)::BIGINT AS lex_hits_count
               FROM top WHERE cluster_id IN (SELECT cluster_id FROM al) GROUP BY cluster_id),
        j AS (SELECT sf.*, li.position, ev.cluster_size, post_topk_mean_sim, post_hits_at_tau, lex_hits_count FROM li JOIN sf ON sf.section = li.section AND sf.cluster_id = li.cluster_id LEFT JOIN ev ON ev.cluster_id = sf.cluster_id),
        k AS (SELECT *, row_number() OVER (ORDER BY coalesce(lex_hits_count, -1e12) DESC, coalesce(section_lex_hit::INTEGER, -1e12) DESC, coalesce(round(section_match_score, 9), -1e12) DESC, coalesce(post_hits_at_tau, -1e12) DESC,
               coalesce(round(lex_hits_count / nullif(cluster_size, 0), 9), -1e12) DESC, coalesce(round(post_hits_at_tau / nullif(cluster_size, 0), 9), -1e12) DESC, coalesce(round(post_topk_mean_sim, 9), -1e12) DESC, round(final_score, 9) DESC, position) AS rank FROM j)
        SELECT section, cluster_id, rank::INTEGER AS rank, lex_hits_count, post_hits_at_tau, cluster_size, round(final_score, 6) AS final_score, round(post_topk_mean_sim, 6) AS post_topk_mean_sim FROM k WHERE rank <= 3""",
    "batch_nearest": f"""WITH {_CT}, {_M}, {_E}, {_CEN}, rq AS (SELECT section || '/' || cluster_id AS request_id, title_emb::DOUBLE[] AS emb FROM ct WHERE title_emb IS NOT NULL),
        p AS (SELECT request_id, ct.section, ct.cluster_id, 1 + list_dot_product(centroid, emb) AS s FROM rq, ct JOIN cen USING (cluster_id))
        SELECT request_id, section, cluster_id, round(s, 6) AS sim_centroid, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY s DESC, section, cluster_id) AS rank FROM p) WHERE rank <= 3""",
    "style_lengths": rf"""WITH {_T}, {_M}, {_CL}, n AS (SELECT section, cluster_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\s\x{{0B}}\x{{1C}}-\x{{1F}}\x{{85}}\p{{Z}}]+'), lambda x: x <> '')) AS n FROM cl)
        SELECT section, cluster_id, trunc(avg(n))::INTEGER AS avg_len_tokens, trunc(quantile_cont(n, 0.95))::INTEGER AS p95_len_tokens FROM n GROUP BY ALL""",
    "style_rates": rf"""WITH {_T}, {_M}, {_CL} SELECT section, cluster_id, round(avg(coalesce(len(regexp_extract_all(text, '[\x{{1F300}}-\x{{1FAFF}}]')) / greatest(length(text), 1), 0)), 6) AS emoji_rate,
        round(avg(coalesce((length(text) - length(replace(text, '!', ''))) / greatest(length(text), 1), 0)), 6) AS exclam_rate, round(avg(coalesce((length(text) - length(replace(text, '?', ''))) / greatest(length(text), 1), 0)), 6) AS question_rate,
        0.0::DOUBLE AS markdown_rate FROM cl GROUP BY ALL""",
    "term_scores": rf"""WITH {_T}, {_M}, {_CL},
        k AS (SELECT section, cluster_id, post_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[A-Za-zА-Яа-яЁё0-9][A-Za-zА-Яа-яЁё0-9\-]+'), lambda w: w NOT IN ({_STOP}) AND length(w) > 2 AND NOT regexp_full_match(w, '[0-9]+')) AS w FROM cl),
        s AS (SELECT section, cluster_id, post_id, regexp_extract_all(array_to_string(w, ' '), '[\p{{L}}\p{{N}}_]{{2,}}') AS w FROM k),
        p AS (SELECT section, cluster_id, post_id, unnest(w) AS w, unnest(range(1, len(w) + 1)) AS pos FROM s),
        l AS (SELECT section, cluster_id, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM p WINDOW o AS (PARTITION BY section, cluster_id ORDER BY post_id, pos)),
        c AS (SELECT section, cluster_id, term, count(*) AS n FROM (SELECT section, cluster_id, w AS term FROM l UNION ALL SELECT section, cluster_id, w || ' ' || w2 FROM l UNION ALL SELECT section, cluster_id, w || ' ' || w2 || ' ' || w3 FROM l) WHERE term IS NOT NULL GROUP BY ALL),
        x AS (SELECT *, count(*) OVER (PARTITION BY section, term) AS clusters FROM c), o AS (SELECT section, count(DISTINCT cluster_id) AS n_of FROM c GROUP BY section),
        y AS (SELECT x.* FROM x JOIN o USING (section) WHERE clusters = 1 AND (n_of > 1 OR contains(term, ' ')))
        SELECT section, cluster_id, term, n, round(n / sum(n) OVER (PARTITION BY section, cluster_id) * (ln(1.5) + 1), 6) AS score FROM y""",
    "topic_groups": f"""WITH {_T}, {_M}, {_CL} SELECT section, cluster_id, count(*) AS size_raw, list(post_id ORDER BY post_id)[1:3] AS exemplars, least(count(*), 12)::INTEGER AS examples FROM cl GROUP BY ALL""",
    "cap_phrases": rf"""WITH {_T} SELECT phrase, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '(?:[А-ЯЁ][а-яё]+(?:\s+[А-ЯЁ][а-яё]+){{1,3}})|(?:[A-Z][a-z]+(?:\s+[A-Z][a-z]+){{1,3}})')) AS phrase FROM t) GROUP BY phrase""",
    "topic_clean": rf"""WITH {_CT}, s AS (SELECT section, cluster_id, {_TITLE} AS s FROM ct WHERE topic IS NOT NULL),
        c AS (SELECT section, cluster_id, CASE WHEN length(s) > 120 THEN regexp_replace(left(s, 120), '\s+\S*$', '') ELSE s END AS s FROM s) SELECT section, cluster_id, upper(left(s, 1)) || substr(s, 2) AS topic FROM c""",
    "top_request": f"""WITH {_CT}, {_POP}, f AS (SELECT r, p_partkey, phrase, cnt, row_number() OVER (PARTITION BY r ORDER BY p_partkey) AS pos FROM pr WHERE rn <= 10)
        SELECT r, total_count_30d, pr.phrase, pr.cnt AS count, '[{{"phrase":"' || f.phrase || '","count":' || f.cnt || '}}]' AS json FROM pl JOIN pr USING (r) JOIN f USING (r) WHERE pr.rn = 1 AND f.pos = 1""",
    "prompt_build": f"WITH {_RESP} SELECT request_id, concat_ws(chr(10) || chr(10), {_block('BOT', 'bot_prompt')}, {_block('PROFILE', 'profile_prompt')}, {_block('USER', 'user_prompt')}) AS prompt FROM rs",
    "prompt_parse": f"WITH {_RESP} SELECT request_id, trim(coalesce(bot_prompt, '')) AS bot, trim(coalesce(profile_prompt, '')) AS profile, trim(coalesce(user_prompt, '')) AS user FROM rs",
    "post_parts": rf"""WITH {_RESP}, w AS (SELECT request_id, regexp_split_to_array({_WHOLE}, '\n\s*\n') AS p FROM rs) SELECT request_id, {_LINE('p[1]')} AS title, {_LINE("array_to_string(p[2:], ' ')")} AS body FROM w""",
    "plain_hits": f"WITH {_HITS} SELECT * FROM ht",
    "moderation_decision": f"""WITH {_HITS}, k AS (SELECT request_id, bool_or(category = 'illegal_content') AS i, bool_or(category = 'extremism_support') AS e, bool_or(category = 'profanity') AS p FROM ht GROUP BY request_id)
        SELECT request_id, CASE WHEN i OR e THEN 'block' WHEN p THEN 'redact' ELSE 'allow' END AS decision, CASE WHEN i THEN 'illegal_content' WHEN e THEN 'extremism_support' WHEN p THEN 'profanity' ELSE 'clean' END AS reason
        FROM rq LEFT JOIN k USING (request_id)""",
    "tfidf": r"""WITH o AS (SELECT request_id, max(text) AS t FROM moderation_requests WHERE text IS NOT NULL GROUP BY request_id),
        tf AS (SELECT request_id, term, count(*) AS tf FROM (SELECT request_id, unnest(regexp_extract_all(lower(t), '[\p{L}\p{N}_]{2,}')) AS term FROM o) GROUP BY ALL),
        w AS (SELECT request_id, term, tf * (ln((1 + (SELECT count(*) FROM o)) / (1 + count(*) OVER (PARTITION BY term))) + 1) AS w FROM tf)
        SELECT request_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY request_id)), 6) AS weight FROM w""",
    "knn_dist": """WITH p AS (SELECT a.vec_id AS id, 1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)
        SELECT id, rank::INTEGER AS rank, round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d) AS rank FROM p) WHERE rank <= 4""",
    "cluster_eval": f"""WITH {_M} SELECT count(DISTINCT cluster_id) FILTER (WHERE cluster_id <> -1) AS clusters, count(*) FILTER (WHERE cluster_id = -1) AS noise, count(*) AS rows,
        round(count(*) FILTER (WHERE cluster_id = -1) / nullif(count(*), 0), 6) AS noise_share FROM m""",
}


def _fold(x: str, joiner: str) -> str:
    """The spelling that moderation compares, as an expression."""
    s = f"translate(strip_accents(lower(coalesce({x}, ''))), '@4€31!|05$7+', 'aaeeiiiosstt')"
    s = rf"regexp_replace({s}, '[\s\x{{0B}}\x{{1C}}-\x{{1F}}\x{{85}}\p{{Z}}.,\-_*|+=~\\/]+', '{joiner}', 'g')"
    s = f"list_reduce(list_prepend('', string_split({s}, '')), lambda a, c: CASE WHEN right(a, 2) = c || c THEN a ELSE a || c END)"
    s = f"translate({s}, 'aeopcxykmtih', 'аеорсхукмтіһ')"
    return rf"regexp_replace({s}, '[^\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}\x{{0400}}-\x{{04FF}}\s\x{{0B}}\x{{1C}}-\x{{1F}}\x{{85}}\p{{Z}}]+', '', 'g')"


def _surface(x: str) -> str:
    return rf"replace(trim(regexp_replace({_fold(x, ' ')}, '\s+', ' ', 'g')), 'ё', 'е')"


def _compact(x: str) -> str:
    return f"replace({_fold(x, '')}, 'ё', 'е')"


_FORMS = f"""rq AS (SELECT request_id, max(text) AS text FROM moderation_requests GROUP BY request_id),
nf AS MATERIALIZED (SELECT request_id, text, {_surface("text")} AS surface, {_compact("text")} AS compact FROM rq),
tr0 AS (SELECT DISTINCT CASE category WHEN 'abuse' THEN 'profanity' WHEN 'hate_target' THEN 'extremism_support' WHEN 'sexual' THEN 'illegal_content' END AS category, lemma, form FROM moderation_terms WHERE form <> ''),
tf0 AS MATERIALIZED (SELECT category, lemma, contains(trim(form), ' ') AS phrase, {_surface("form")} AS surface, {_compact("form")} AS compact FROM tr0),
fm AS (SELECT 0 AS kind, surface AS form, category, min(lemma) AS lemma FROM tf0 WHERE surface <> '' GROUP BY ALL UNION ALL SELECT 1, compact, category, min(lemma) FROM tf0 WHERE NOT phrase AND compact <> '' GROUP BY ALL),
hp AS (SELECT DISTINCT request_id, category, lemma FROM nf JOIN fm ON contains(CASE kind WHEN 0 THEN surface ELSE compact END, form)),
hc AS (SELECT request_id, category, list_sort(list(lemma)) AS lemmas FROM hp GROUP BY ALL),
hd AS (SELECT request_id, bool_or(category = 'illegal_content') AS i, bool_or(category = 'extremism_support') AS e, bool_or(category = 'profanity') AS p, list_distinct(flatten(list(lemmas))) AS lemmas, list_sort(list(category)) AS labels FROM hc GROUP BY request_id),
dc0 AS (SELECT request_id, text, lemmas, labels, CASE WHEN i OR e THEN 'block' WHEN p THEN 'redact' ELSE 'allow' END AS decision,
  CASE WHEN i THEN 'illegal_content' WHEN e THEN 'extremism_support' WHEN p THEN 'profanity' ELSE 'clean' END AS reason FROM rq LEFT JOIN hd USING (request_id))"""
_REDACTED = r"""list_reduce(list_prepend(text, list_sort(list_transform(lemmas, lambda l: {'n': -length(l), 'l': l})).list_transform(lambda z: z.l)),
  lambda a, l: regexp_replace(a, array_to_string(list_transform(string_split(l, ''), lambda c: regexp_escape(c)), '[^\p{L}\p{N}_]*'), '[REDACTED]', 'gi'))"""
_TERMS = SQL["term_scores"].rsplit("SELECT section, cluster_id, term, n, round(", 1)[0]
_PHRASES = f"""{_TERMS},
sc AS (SELECT section, cluster_id, term, contains(term, ' ') AS phrase, row_number() OVER (PARTITION BY section, cluster_id, contains(term, ' ') ORDER BY n DESC, term) AS rn FROM y),
ls AS (SELECT section, cluster_id, coalesce(list(term ORDER BY rn) FILTER (WHERE phrase AND rn <= 60), []) AS p, coalesce(list(term ORDER BY rn) FILTER (WHERE NOT phrase AND rn <= 120), []) AS w FROM sc GROUP BY ALL),
kp AS (SELECT section, cluster_id, w, list_reduce(list_prepend([]::VARCHAR[], list_transform(p, lambda t: [t])), lambda acc, x: CASE WHEN len(acc) >= 20 OR len(list_filter(acc, lambda t:
  len(list_intersect(string_split(x[1], ' '), string_split(t, ' '))) / least(len(list_distinct(string_split(x[1], ' '))), len(list_distinct(string_split(t, ' ')))) >= 0.66)) > 0 THEN acc ELSE list_concat(acc, x) END) AS top_ngrams FROM ls)"""
_NEAR = "WITH p AS (SELECT a.vec_id AS id, b.vec_id AS other, 1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d, sqrt(greatest(0, list_aggregate(list_transform(list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), lambda z: (z[1] - z[2]) ** 2), 'sum'))) AS l FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)"


def _quantile(k: int, n: int) -> str:
    """Values of the k-th neighbour distance at n ranks, on the grid of the histogram."""
    return f"""r AS (SELECT d FROM (SELECT id, d, row_number() OVER (PARTITION BY id ORDER BY d) AS rank FROM p) WHERE rank = {k}),
    o AS (SELECT floor(d / ((SELECT max(d) FROM r) / 100000)) * ((SELECT max(d) FROM r) / 100000) AS d, row_number() OVER (ORDER BY d) - 1 AS pos FROM r),
    q AS (SELECT i, (SELECT o.d FROM o WHERE pos = floor(i / {n - 1}.0 * ((SELECT count(*) FROM r) - 1))) AS d FROM range(0, {n}) t(i))"""


def _density(name: str, eps: float, least: int, column: str = "d") -> str:
    """CTEs of density clusters over the pairs p: {name}(id, label)."""
    return f"""{name}_c AS (SELECT vec_id AS id FROM embeddings LEFT JOIN p ON p.id = vec_id AND {column} <= {eps} GROUP BY vec_id HAVING count(p.id) + 1 >= {least}),
    {name}_e AS (SELECT p.id AS a, p.other AS b FROM p JOIN {name}_c x ON x.id = p.id JOIN {name}_c y ON y.id = p.other WHERE {column} <= {eps}),
    {name}_l(id, label) USING KEY (id) AS (SELECT id, id FROM {name}_c UNION (SELECT e.b, min(c.label) FROM {name}_l c JOIN {name}_e e ON e.a = c.id JOIN recurring.{name}_l r ON r.id = e.b WHERE c.label < r.label GROUP BY e.b)),
    {name} AS (SELECT vec_id AS id, coalesce((SELECT label FROM {name}_l l WHERE l.id = vec_id), (SELECT min(l.label) FROM p JOIN {name}_l l ON l.id = p.other WHERE p.id = vec_id AND {column} <= {eps}), -1) AS label FROM embeddings)"""


_GRID = [("cosine", "d", e) for e in (0.7, 0.8, 0.9)] + [("euclidean", "l", e) for e in (0.7, 0.8, 0.9)]
_SHARES = {"insult": (7, 101), "obscene": (11, 97), "drugs": (13, 89), "weapons": (17, 83), "calls": (19, 79)}
_SHARE = {k: f"(request_id * {a} % {m}) / {m}.0" for k, (a, m) in _SHARES.items()}
_WANTED = lambda signs: rf"left(trim(regexp_replace(regexp_replace(regexp_replace(topic, '(?i)https?://\S+|www\.\S+', ' ', 'g'), '[^{signs}]', ' ', 'g'), '\s+', ' ', 'g')), 256)"
SQL |= {
    "popularity_wanted": f"""WITH {_CT} SELECT section, cluster_id, {_WANTED('A-Za-zА-Яа-яЁё0-9' + chr(92) + 's+' + chr(92) + '-|!' + chr(92) + '[' + chr(92) + ']()"«»')} AS phrase FROM ct WHERE topic IS NOT NULL AND topic <> ''""",
    "plain_phrases": f"""WITH {_CT} SELECT section, cluster_id, {_WANTED('A-Za-zА-Яа-яЁё0-9' + chr(92) + 's')} AS phrase FROM ct WHERE topic IS NOT NULL AND topic <> ''""",
    "normalised": f"WITH {_FORMS} SELECT request_id, surface, compact FROM nf",
    "dict_hits": f"WITH {_FORMS} SELECT request_id, category, array_to_string(lemmas, ',') AS lemmas FROM hc",
    "moderated": f"WITH {_FORMS} SELECT request_id, decision, reason, CASE decision WHEN 'allow' THEN text WHEN 'redact' THEN {_REDACTED} END AS text FROM dc0",
    "moderation_answers": f"WITH {_FORMS} SELECT request_id, decision <> 'block' AS ok, coalesce(array_to_string(labels, ','), '') AS labels, CASE decision WHEN 'allow' THEN '' ELSE reason END AS reasons FROM dc0",
    "lemmatised": f"""WITH {_FORMS}, lm AS (SELECT {_surface("form")} AS w, min({_surface("lemma")}) AS l FROM tr0 WHERE form NOT LIKE '% %' GROUP BY 1),
        ws AS (SELECT request_id, unnest(string_split(surface, ' ')) AS w, unnest(range(0, len(string_split(surface, ' ')))) AS pos FROM nf)
        SELECT request_id, string_agg(coalesce(l, ws.w), ' ' ORDER BY pos) AS text FROM ws LEFT JOIN lm ON lm.w = ws.w GROUP BY request_id""",
    "expanded_forms": """WITH t AS (SELECT DISTINCT CASE category WHEN 'abuse' THEN 'profanity' WHEN 'hate_target' THEN 'extremism_support' WHEN 'sexual' THEN 'illegal_content' END AS category, lemma, form FROM moderation_terms)
        SELECT DISTINCT category, lemma, lemma AS form FROM t UNION SELECT a.category, a.lemma, b.form FROM t a JOIN t b ON a.lemma = b.lemma WHERE NOT contains(trim(a.lemma), ' ') AND b.form IS NOT NULL""",
    "model_decision": f"""WITH rq AS (SELECT DISTINCT request_id FROM moderation_requests), s AS (SELECT request_id, greatest({_SHARE['insult']}, {_SHARE['obscene']}) AS p, {_SHARE['calls']} AS e0, greatest({_SHARE['drugs']}, {_SHARE['weapons']}) AS i0 FROM rq),
        g AS (SELECT request_id, p, CASE WHEN e0 >= 0.6 THEN e0 ELSE 0 END AS e, greatest(CASE WHEN i0 >= 0.6 THEN i0 ELSE 0 END, CASE WHEN e0 >= 0.6 THEN e0 ELSE 0 END) AS i FROM s)
        SELECT request_id, round(p, 6) AS profanity, round(e::DOUBLE, 6) AS extremism_support, round(i::DOUBLE, 6) AS illegal_content, CASE WHEN i >= 0.8 OR e >= 0.8 THEN 'block' WHEN p >= 0.65 THEN 'redact' WHEN i >= 0.5 OR e >= 0.5 THEN 'review' ELSE 'allow' END AS decision,
        CASE WHEN i >= 0.8 THEN 'illegal_content' WHEN e >= 0.8 THEN 'extremism_support' WHEN p >= 0.65 THEN 'profanity' WHEN i >= 0.5 OR e >= 0.5 THEN 'uncertain_high_risk' ELSE 'clean' END AS reason FROM g""",
    "largest_clusters": f"WITH {_CT} SELECT section, cluster_id, size_raw FROM ct ORDER BY size_raw DESC NULLS LAST, section, cluster_id LIMIT 8",
    "style_upsert": rf"""WITH {_T}, {_M}, {_CS}, {_CL}, n AS (SELECT section, cluster_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\s\x{{0B}}\x{{1C}}-\x{{1F}}\x{{85}}\p{{Z}}]+'), lambda x: x <> '')) AS n FROM cl WHERE section = 'pets'),
        w AS (SELECT section, cluster_id, trunc(avg(n))::INTEGER AS a FROM n GROUP BY ALL) SELECT section, cluster_id, a AS avg_len_tokens, epoch_us(TIMESTAMPTZ '2025-07-01 00:00:00+00') AS updated_us FROM w
        UNION ALL SELECT section, cluster_id, avg_len_tokens, epoch_us(updated_at) FROM cs WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.section = cs.section AND w.cluster_id = cs.cluster_id)""",
    "popularity_upsert": f"""WITH {_CT}, {_POP} SELECT section, cluster_id, pop.total_count_30d, pr.phrase AS top_max_phrase, pr.cnt AS top_max_count,
        epoch_us(CASE WHEN section = 'music' THEN TIMESTAMPTZ '2025-07-01 00:00:00+00' ELSE TIMESTAMPTZ '2025-06-01 00:00:00+00' END) AS requested_us FROM pop JOIN pr ON pr.r = cluster_id % 211 AND pr.rn = 1""",
    "request_parse": f"WITH {_CT}, {_POP} SELECT r, count(*)::INTEGER AS n, sum(cnt)::BIGINT AS total, max_by(phrase, p_partkey) AS last FROM pr WHERE rn <= 10 GROUP BY r",
    "similar_to_text": f"""WITH {_T}, {_E}, v AS (SELECT * FROM e WHERE list_dot_product(emb::DOUBLE[], emb::DOUBLE[]) > 0),
        a AS (SELECT id, emb FROM t JOIN v ON v.post_id = t.id WHERE text = (SELECT min(text) FROM t WHERE length(text) > 0) ORDER BY id DESC LIMIT 1)
        SELECT post_id, round(list_cosine_similarity(v.emb::DOUBLE[], a.emb::DOUBLE[]), 6) AS cos FROM v, a WHERE post_id <> a.id ORDER BY list_cosine_similarity(v.emb::DOUBLE[], a.emb::DOUBLE[]) DESC, post_id LIMIT 10""",
    "style_topic": f"""WITH {_VIEW} SELECT section, cluster_id, ct.topic, avg_len_tokens, p95_len_tokens, top_ngrams, slang_ngrams FROM ct JOIN cen USING (cluster_id) LEFT JOIN cs USING (section, cluster_id) WHERE section = 'pets' AND cluster_id = 0""",
    "topic_prompts": rf"""WITH {_T}, {_M}, {_CL}, g AS (SELECT section, cluster_id, list(text ORDER BY post_id)[1:10] AS x FROM (SELECT *, row_number() OVER (PARTITION BY section, cluster_id ORDER BY post_id) AS rn FROM cl) WHERE rn <= 10 GROUP BY ALL),
        k AS (SELECT section, cluster_id, list_filter(list_transform(x, lambda t: trim(t)), lambda t: t <> '') AS x FROM g),
        h AS (SELECT section, cluster_id, x, flatten(list_transform(x, lambda t: regexp_extract_all(t, '(?:[А-ЯЁ][а-яё]+(?:\s+[А-ЯЁ][а-яё]+){{1,3}})|(?:[A-Z][a-z]+(?:\s+[A-Z][a-z]+){{1,3}})')))[1:12] AS h FROM k)
        SELECT section, cluster_id, 'Name one simple topic of these texts in three to ten words, without quotes.' || chr(10) || chr(10) || 'Texts:' || chr(10) || CASE WHEN len(x) > 0 THEN array_to_string(list_transform(x, lambda t: '- ' || left(t, 700)), chr(10)) ELSE '-' END
        || chr(10) || chr(10) || 'Names in them: ' || CASE WHEN len(h) > 0 THEN array_to_string(h, ', ') ELSE '-' END AS prompt FROM h""",
    "keyphrases": f"{_PHRASES} SELECT section, cluster_id, top_ngrams, list_filter(w, lambda t: NOT list_contains(flatten(list_transform(top_ngrams, lambda x: string_split(x, ' '))), t))[1:12] AS slang_ngrams FROM kp",
    "eps_knee": f"{_NEAR}, {_quantile(4, 256)}, b AS (SELECT i, d, round(lead(d) OVER (ORDER BY i) - 2 * d + lag(d) OVER (ORDER BY i), 9) AS bend FROM q) SELECT round(d, 4) AS eps FROM b WHERE bend IS NOT NULL ORDER BY bend DESC, i LIMIT 1",
    "automatic_eps": f"{_NEAR}, {_quantile(2, 3)} SELECT round(0.85 * d, 4) AS eps FROM q WHERE i = 1",
    "dbscan": f"{_NEAR.replace('WITH', 'WITH RECURSIVE')}, {_density('s', 0.9, 5)} SELECT id, label FROM s",
    "eps_grid": f"{_NEAR.replace('WITH', 'WITH RECURSIVE')}, {', '.join(_density(f's{i}', e, 5, c) for i, (_, c, e) in enumerate(_GRID))}, a AS ("
    + " UNION ALL ".join(f"SELECT '{m}' AS metric, {e}::DOUBLE AS eps, count(DISTINCT label) FILTER (WHERE label <> -1) AS clusters, count(*) FILTER (WHERE label = -1) AS noise FROM s{i}" for i, (m, _, e) in enumerate(_GRID))
    + ") SELECT *, row_number() OVER (ORDER BY noise, clusters DESC, metric, eps) = 1 AS best FROM a",
}
_SHORT = lambda xs, n, k: rf"array_to_string(list_transform(coalesce({xs}, [])[1:{k}], lambda x: '- ' || left(regexp_replace(x, '\s*\n\s*', ' ', 'g'), {n})), chr(10))"
SQL["context_prompts"] = rf"""WITH {_VIEW}, ta AS (SELECT r, list(phrase ORDER BY p_partkey) AS ps FROM pr WHERE rn <= 10 GROUP BY r), tb AS (SELECT r, phrase AS best FROM pr WHERE rn = 1),
    ex AS (SELECT x.section, x.cluster_id, list(text ORDER BY position) AS examples FROM (SELECT section, cluster_id, unnest(range(0, least(len(exemplars), 4)::BIGINT)) AS position, exemplars FROM ct) x JOIN t ON t.id = exemplars[position + 1] GROUP BY ALL),
    vw AS (SELECT ct.section, ct.cluster_id, {_TITLE} AS s, topic, pop.total_count_30d AS total, best, ps, top_ngrams, slang_ngrams, examples FROM ct JOIN cen USING (cluster_id) LEFT JOIN cs USING (section, cluster_id) LEFT JOIN pop USING (section, cluster_id)
      LEFT JOIN tb ON pop.total_count_30d IS NOT NULL AND tb.r = ct.cluster_id % 211 LEFT JOIN ta ON pop.total_count_30d IS NOT NULL AND ta.r = ct.cluster_id % 211 LEFT JOIN ex USING (section, cluster_id)),
    mg AS (SELECT *, CASE WHEN length(s) > 120 THEN regexp_replace(left(s, 120), '\s+\S*$', '') ELSE s END AS cut, list_transform(list_concat(CASE WHEN best IS NULL THEN [] ELSE [best] END,
      list_filter(list_transform(coalesce(ps, []), lambda x: trim(x)), lambda x: x <> '')[1:5], coalesce(top_ngrams, [])[1:10], coalesce(slang_ngrams, [])[1:8]), lambda x: trim(regexp_replace(regexp_replace(x, '["''«»“”„]', '', 'g'), '\s+', ' ', 'g'))) AS words FROM vw),
    uf AS (SELECT *, list_filter(words, lambda x: len(list_filter(string_split(lower(x), ' '), lambda w: w <> '' AND w NOT IN ({_STOP}))) > 0) AS useful FROM mg),
    kw AS (SELECT *, list_reduce(list_prepend([]::VARCHAR[], list_transform(useful, lambda x: [x])), lambda acc, x: CASE WHEN list_contains(list_transform(acc, lambda y: lower(y)), lower(x[1])) THEN acc ELSE list_concat(acc, x) END)[1:6] AS k FROM uf)
    SELECT section, cluster_id, concat_ws(chr(10), 'Topic: ' || coalesce(upper(left(cut, 1)) || substr(cut, 2), 'any'), 'Keywords: ' || array_to_string(k, ', '), 'Requests a month: ' || replace(format('{{:,}}', coalesce(total, 0)), ',', ' '), 'Author: anyone', 'Examples:',
    {_SHORT('examples', 300, 2)}, 'Also written:', {_SHORT('examples[3:6]', 200, 4)}) AS prompt FROM kw"""
SQL["clamped_demand"] = f"WITH {_CT}, {_POP} SELECT ct.section, ct.cluster_id, least(greatest(coalesce(total_count_30d, 100), 50), 2000)::BIGINT AS demand FROM ct LEFT JOIN pop USING (section, cluster_id)"
SQL["style_profile"] = f"""SELECT section, cluster_id, avg_len_tokens, p95_len_tokens, emoji_rate, exclam_rate, question_rate, markdown_rate, coalesce(top_ngrams, []) AS top_ngrams, coalesce(slang_ngrams, []) AS slang_ngrams, exemplar_post_ids
    FROM ({SQL["style_lengths"]}) JOIN ({SQL["style_rates"]}) USING (section, cluster_id) LEFT JOIN ({SQL["keyphrases"]}) USING (section, cluster_id)
    LEFT JOIN (SELECT section, cluster_id, list(post_id ORDER BY rank) AS exemplar_post_ids FROM ({SQL["style_exemplars"]}) GROUP BY ALL) USING (section, cluster_id)"""
