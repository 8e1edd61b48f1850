"""Queries of the core operators by name, each over whole tables, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postloom.functions import text as tx
from postloom.functions import vectors as vx
from postloom.operators import clustering, moderation, prompts, retrieval, store, style, trends
from postloom.plans.oracle import SQL
from postloom.sources import external
from postloom.sources import tables as tb
from postloom.storage import cut, read_table

#: Parameters of the queries.
AS_OF, DIM, TEXT, TAU, RESIDUES = "2025-07-01 00:00:00", 64, "board games", 1.4, 211
KEY = ["section", "cluster_id"]


def part_counts(spark: SparkSession, d: str) -> DataFrame:
    """(r, p_partkey, phrase, count): stand-in for phrase popularity, from parts and their orders."""
    lines = read_table(spark, d, "lineitem", "l_partkey").groupBy("l_partkey").agg(F.count("*").alias("count"))
    parts = read_table(spark, d, "part", "p_partkey", "p_name")
    return parts.join(lines, parts["p_partkey"] == lines["l_partkey"]).select((F.col("p_partkey") % RESIDUES).alias("r"), "p_partkey", F.col("p_name").alias("phrase"), "count")


def request_lists(spark: SparkSession, d: str) -> DataFrame:
    """(r, total_count_30d, top_requests): the ten most wanted phrases of each residue, in the order of their keys."""
    counts = part_counts(spark, d)
    ranked = counts.withColumn("rn", F.row_number().over(Window.partitionBy("r").orderBy(F.desc("count"), "p_partkey")))
    kept = F.transform(F.array_sort(F.collect_list(F.when(F.col("rn") <= 10, F.struct("p_partkey", "phrase", "count")))), lambda x: F.struct(x["phrase"].alias("phrase"), x["count"].alias("count")))
    return ranked.groupBy("r").agg(F.sum("count").alias("total_count_30d"), kept.alias("top_requests"))


def popularity(spark: SparkSession, d: str) -> DataFrame:
    keys = tb.cluster_topics(spark, d).filter("cluster_id % 9 <> 4").select(*KEY, "topic")
    lists = request_lists(spark, d)
    return keys.join(lists, keys["cluster_id"] % RESIDUES == lists["r"]).drop("r")


def recency(spark: SparkSession, d: str) -> DataFrame:
    return trends.recency(tb.assignments(spark, d), tb.current_topics(spark, d, "id", "created_at"), AS_OF)


def trend(spark: SparkSession, d: str) -> DataFrame:
    return trends.trend(popularity(spark, d), recency(spark, d))


def trend_score(spark: SparkSession, d: str) -> DataFrame:
    return trend(spark, d).withColumn("trend_score", F.round("trend_score", 9))


def trend_top(spark: SparkSession, d: str) -> DataFrame:
    return trend_score(spark, d).orderBy(F.desc("trend_score"), *KEY).limit(10)


def topics_dedup(spark: SparkSession, d: str) -> DataFrame:
    return tb.keep_first(tb.current_topics(spark, d, "id", "hash"), ["hash"], F.col("id").asc())


def topics_latest(spark: SparkSession, d: str) -> DataFrame:
    return tb.current_topics(spark, d, "id", "hash", "section", "updated_at").select("id", "hash", "section", F.unix_micros("updated_at").alias("updated_us"))


def topics_insert_new(spark: SparkSession, d: str) -> DataFrame:
    posts = tb.current_topics(spark, d, "id", "hash", "source")
    arriving = F.col("source") == "board_main"
    return store.insert_new(posts.filter(~arriving), posts.filter(arriving), "hash", "id")


def next_id(spark: SparkSession, d: str) -> DataFrame:
    return store.next_id(read_table(spark, d, "topics", "id"), "id")


def pending_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return store.missing_rows(tb.current_topics(spark, d, "id", "hash"), read_table(spark, d, "post_embeddings", "post_id"), "id", "post_id")


def pending_titles(spark: SparkSession, d: str) -> DataFrame:
    return tb.cluster_topics(spark, d).filter("title_emb IS NULL AND topic IS NOT NULL AND trim(topic) <> ''").select(*KEY, "topic")


def popularity_wanted(spark: SparkSession, d: str) -> DataFrame:
    return tb.cluster_topics(spark, d).filter("topic IS NOT NULL AND topic <> ''").select(*KEY, tx.request_phrase("topic").alias("phrase"))


def plain_phrases(spark: SparkSession, d: str) -> DataFrame:
    return tb.cluster_topics(spark, d).filter("topic IS NOT NULL AND topic <> ''").select(*KEY, tx.plain_phrase("topic").alias("phrase"))


def style_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Profiles made anew replace those of the table and get the time of the change."""
    old = tb.styles(spark, d).select(*KEY, "avg_len_tokens", "updated_at")
    new = style_lengths(spark, d).select(*KEY, "avg_len_tokens").filter("section = 'pets'")
    return store.upsert_touched(old, new, KEY, "updated_at", AS_OF).select(*KEY, "avg_len_tokens", F.unix_micros("updated_at").alias("updated_us"))


def popularity_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Popularity rows with their greatest request, those of one section fetched anew."""
    best = prompts.top_request(F.col("top_requests"))
    rows = popularity(spark, d).select(*KEY, "total_count_30d", best["phrase"].alias("top_max_phrase"), best["count"].alias("top_max_count"))
    old = rows.withColumn("requested_at", F.to_timestamp(F.lit("2025-06-01 00:00:00")))
    return store.upsert_touched(old, rows.filter("section = 'music'"), KEY, "requested_at", AS_OF).withColumn("requested_us", F.unix_micros("requested_at")).drop("requested_at")


def embeddings_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of titles replace and extend those of posts, by number."""
    old = tb.vectors(spark, d)
    new = tb.cluster_topics(spark, d).filter("title_emb IS NOT NULL").groupBy(F.col("cluster_id").cast("long").alias("post_id")).agg(F.min("title_emb").alias("emb"))
    return store.upsert(old, new, ["post_id"]).select("post_id", F.round(vx.dot("emb", "emb"), 6).alias("norm2"))


def titles_update(spark: SparkSession, d: str) -> DataFrame:
    topics = tb.cluster_topics(spark, d).select(*KEY, "topic")
    changes = tb.styles(spark, d).select(*KEY, F.get("top_ngrams", F.lit(0)).alias("topic"))
    return store.update_column(topics, changes, KEY, "topic")


def section_backfill(spark: SparkSession, d: str) -> DataFrame:
    """Sections of posts from their assignments where they have one, blank where nothing is known."""
    posts = tb.current_topics(spark, d, "id", "section")
    changes = tb.assignments(spark, d).filter("section <> ''").select(F.col("topic_id").alias("id"), "section")
    return store.update_column(posts, changes, ["id"], "section").select("id", F.coalesce("section", F.lit("")).alias("section"))


def section_replace(spark: SparkSession, d: str) -> DataFrame:
    topics = tb.cluster_topics(spark, d).select(*KEY, "topic")
    new = topics.filter("section = 'music'").select("section", "cluster_id", F.upper("topic").alias("topic"))
    return store.replace_slice(topics, new, "section")


def style_latest(spark: SparkSession, d: str) -> DataFrame:
    return tb.styles(spark, d).select(*KEY, "avg_len_tokens", "p95_len_tokens", F.unix_micros("updated_at").alias("updated_us"))


def repeated_keys(spark: SparkSession, d: str) -> DataFrame:
    return tb.check_keys(read_table(spark, d, "cluster_topics_by_section", *KEY), KEY)


def clusters_of(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.centroids(tb.assignments(spark, d), tb.vectors(spark, d), DIM)


def centroids(spark: SparkSession, d: str) -> DataFrame:
    return clusters_of(spark, d).select("cluster_id", F.transform("centroid", lambda x: F.round(x, 6)).alias("centroid"), "size")


def centroid_norms(spark: SparkSession, d: str) -> DataFrame:
    return clusters_of(spark, d).select("cluster_id", F.round(vx.norm("centroid"), 6).alias("norm"), F.round(vx.norm(vx.unit("centroid")), 6).alias("unit_norm"))


def cluster_sizes(spark: SparkSession, d: str) -> DataFrame:
    rows = tb.assignments(spark, d).groupBy("cluster_id").agg(F.count("*").alias("n"))
    total = rows.agg(F.sum("n").alias("_all"))  # one row
    return rows.crossJoin(F.broadcast(total)).select("cluster_id", "n", F.round(F.col("n") / F.col("_all"), 6).alias("share"))


def largest_clusters(spark: SparkSession, d: str) -> DataFrame:
    """The eight largest clusters, a first look at a clustering."""
    return tb.cluster_topics(spark, d).select(*KEY, "size_raw").orderBy(F.desc_nulls_last("size_raw"), *KEY).limit(8)


def unit_vectors(spark: SparkSession, d: str) -> DataFrame:
    return tb.vectors(spark, d).select("post_id", F.transform(vx.unit("emb"), lambda x: F.round(x, 6)).alias("unit"))


def vector_text(spark: SparkSession, d: str) -> DataFrame:
    """Whether vectors survive the way to text with eight decimals and back."""
    rows = tb.vectors(spark, d).withColumn("back", vx.from_text(vx.to_text("emb")))
    same = F.forall(F.zip_with("emb", "back", lambda x, y: F.abs(x - y) < 1e-7), lambda x: x)
    return rows.select("post_id", F.size("back").alias("n"), same.alias("same"))


def query_vector(spark: SparkSession, d: str) -> list[float]:
    """The vector of the first post that has one other than zero: stands for an embedded query."""
    return [float(x) for x in tb.vectors(spark, d).filter(vx.norm("emb") > 0).orderBy("post_id").limit(1).first()["emb"]]


def posts_of(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.post_search(tb.assignments(spark, d), tb.current_topics(spark, d, "id", "text"), tb.vectors(spark, d))


def view_of(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.cluster_view(tb.cluster_topics(spark, d), clusters_of(spark, d), tb.styles(spark, d), popularity(spark, d), trend(spark, d))


def retriever_view(spark: SparkSession, d: str) -> DataFrame:
    return view_of(spark, d).select(*KEY, "topic", "total_count_30d", F.round("trend_score", 9).alias("trend_score"), F.round(vx.norm("centroid"), 6).alias("norm"), "avg_len_tokens", F.size(F.coalesce("top_ngrams", F.array().cast("array<string>"))).alias("ngrams"))


def nn_clusters(spark: SparkSession, d: str) -> DataFrame:
    out = retrieval.nearest_clusters(view_of(spark, d), query_vector(spark, d), text=TEXT, limit=8)
    return out.select(*KEY, *(F.round(c, 6).alias(c) for c in ("sim_centroid", "sim_title", "trend_score", "section_trgm_sim", "section_match_score", "final_score")), "section_lex_hit")


def similar_posts(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.nearest_posts(posts_of(spark, d), query_vector(spark, d), 8, "pets", 0).select("post_id", F.round("sim", 6).alias("sim"))


def cosine_topn(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.cosine_top(tb.vectors(spark, d), query_vector(spark, d), 10).select("post_id", F.round("cos", 6).alias("cos"))


def similar_to_text(spark: SparkSession, d: str) -> DataFrame:
    """The posts nearest to the one that holds the first text by order."""
    posts = tb.current_topics(spark, d, "id", "text")
    text = posts.filter("length(text) > 0").agg(F.min("text").alias("t")).first()["t"]
    return retrieval.similar_to_text(tb.vectors(spark, d).filter(vx.norm("emb") > 0), posts, text, 10).select("post_id", F.round("cos", 6).alias("cos"))


def style_topic(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.style_and_topic(view_of(spark, d), "pets", 0).select(*KEY, "topic", "avg_len_tokens", "p95_len_tokens", "top_ngrams", "slang_ngrams")


def exemplar_posts(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.exemplar_posts(tb.cluster_topics(spark, d), tb.current_topics(spark, d, "id", "text"), 4)


def style_exemplars(spark: SparkSession, d: str) -> DataFrame:
    return style.typical_posts(posts_of(spark, d), DIM).select(*KEY, "post_id", F.round("cos", 6).alias("cos"), "rank")


def lex_match(spark: SparkSession, d: str) -> DataFrame:
    posts = tb.current_topics(spark, d, "id", "text").filter("text IS NOT NULL")
    return posts.filter(tx.holds_all(tx.words("text"), tx.words(F.lit(TEXT)))).select("id", F.size(tx.words("text")).alias("words"))


def trigram_sim(spark: SparkSession, d: str) -> DataFrame:
    topics = tb.cluster_topics(spark, d).select(*KEY, F.round(tx.trigram_similarity(F.col("topic"), F.lit(TEXT)), 6).alias("sim"))
    return topics.filter("sim > 0")


def discover_clusters(spark: SparkSession, d: str) -> DataFrame:
    out = retrieval.discover(posts_of(spark, d), query_vector(spark, d), [0], TEXT, TAU)
    return out.withColumn("mean_sim", F.round("mean_sim", 6))


def rerank_posts(spark: SparkSession, d: str) -> DataFrame:
    out = retrieval.rerank(posts_of(spark, d), query_vector(spark, d), list(range(60)), 50, TEXT, TAU)
    return out.select("cluster_id", "cluster_size", "post_hits_at_tau", "lex_hits_count", *(F.round(c, 6).alias(c) for c in ("post_topk_mean_sim", "post_dens_at_tau", "lex_dens")))


def candidates_ranked(spark: SparkSession, d: str) -> DataFrame:
    view, posts = cut(view_of(spark, d), "view"), cut(posts_of(spark, d), "posts")
    out = retrieval.select_clusters(view, posts, query_vector(spark, d), text=TEXT, tau=TAU)
    return out.select(*KEY, "rank", "lex_hits_count", "post_hits_at_tau", "cluster_size", F.round("final_score", 6).alias("final_score"), F.round("post_topk_mean_sim", 6).alias("post_topk_mean_sim"))


def batch_nearest(spark: SparkSession, d: str) -> DataFrame:
    """Nearest clusters for every title vector as a request, in one job."""
    requests = tb.cluster_topics(spark, d).filter("title_emb IS NOT NULL").select(F.concat_ws("/", *KEY).alias("request_id"), F.col("title_emb").alias("emb"))
    out = retrieval.nearest_clusters_batch(tb.cluster_topics(spark, d).join(clusters_of(spark, d), "cluster_id").select(*KEY, "centroid"), requests, 3)
    return out.withColumn("sim_centroid", F.round("sim_centroid", 6))


def context_prompts(spark: SparkSession, d: str) -> DataFrame:
    """A generator prompt for each cluster from its topic, keywords, demand and exemplar posts."""
    view = view_of(spark, d)
    shown = exemplar_posts(spark, d).groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda x: x["text"]).alias("examples"))
    empty = F.array().cast("array<struct<phrase:string,count:bigint>>")
    words = prompts.keywords(prompts.top_request(F.col("top_requests"))["phrase"], F.col("top_requests"), empty, F.coalesce("top_ngrams", F.array().cast("array<string>")), F.coalesce("slang_ngrams", F.array().cast("array<string>")))
    rows = view.join(shown, KEY, "left")
    return rows.select(*KEY, prompts.context_prompt(tx.clean_title("topic"), words, F.col("total_count_30d"), F.col("examples"), F.slice("examples", 3, 4), F.lit(None).cast("string")).alias("prompt"))


def topic_prompts(spark: SparkSession, d: str) -> DataFrame:
    """For each cluster the prompt that asks for its topic."""
    return style.topic_groups(clustered_texts(spark, d), 10).select(*KEY, prompts.topic_prompt(F.col("examples")).alias("prompt"))


def get_post(spark: SparkSession, d: str) -> DataFrame:
    """A title and a text for every request: its prompt is taken apart, embedded and answered by a chat model (here the
    stand-ins) from the context of the nearest cluster."""
    parts = prompts.parse(prompts.build(F.col("bot_prompt"), F.col("profile_prompt"), F.col("user_prompt")))
    asked = cut(responses(spark, d).groupBy("request_id").agg(*(F.max(c).alias(c) for c in ("bot_prompt", "profile_prompt", "user_prompt"))).select(F.col("request_id").cast("string").alias("request_id"), parts.alias("p")), "requests")
    vectors = external.embed(asked.select("request_id", "p.user"), "request_id", "user", external.HashEmbedder(DIM))
    near = retrieval.nearest_clusters_batch(tb.cluster_topics(spark, d).join(clusters_of(spark, d), "cluster_id").select(*KEY, "centroid"), vectors, 1)
    context = asked.join(near.select("request_id", *KEY), "request_id", "left").join(context_prompts(spark, d), KEY, "left")
    prompt = F.when(F.col("p.user") != "", F.concat_ws("\n\n", F.coalesce("prompt", F.lit("")), F.col("p.bot"), F.col("p.user")))
    answers = external.ask_chat(context.select("request_id", prompt.alias("prompt")), "request_id", "prompt", external.TemplateChat())
    return answers.select(F.col("request_id").cast("long").alias("request_id"), prompts.post_of(F.col("answer")).alias("post")).select("request_id", "post.post_title", "post.post_text")


def clustered_texts(spark: SparkSession, d: str) -> DataFrame:
    rows = tb.assignments(spark, d).filter(F.col("cluster_id") != tb.NOISE)
    return rows.join(tb.current_topics(spark, d, "id", "text").withColumnRenamed("id", "topic_id"), "topic_id").select(*KEY, F.col("topic_id").alias("post_id"), "text")


def style_lengths(spark: SparkSession, d: str) -> DataFrame:
    return style.lengths_and_rates(clustered_texts(spark, d)).select(*KEY, "avg_len_tokens", "p95_len_tokens")


def style_rates(spark: SparkSession, d: str) -> DataFrame:
    return style.lengths_and_rates(clustered_texts(spark, d)).select(*KEY, *(F.round(c, 6).alias(c) for c in ("emoji_rate", "exclam_rate", "question_rate")), "markdown_rate")


def term_scores(spark: SparkSession, d: str) -> DataFrame:
    return style.exclusive_terms(style.term_counts(clustered_texts(spark, d))).select(*KEY, "term", "n", F.round("score", 6).alias("score"))


def keyphrases(spark: SparkSession, d: str) -> DataFrame:
    return style.key_phrases(style.exclusive_terms(style.term_counts(clustered_texts(spark, d))))


def topic_groups(spark: SparkSession, d: str) -> DataFrame:
    return style.topic_groups(clustered_texts(spark, d)).select(*KEY, "size_raw", "exemplars", F.size("examples").alias("examples"))


def cap_phrases(spark: SparkSession, d: str) -> DataFrame:
    posts = tb.current_topics(spark, d, "id", "text").filter("text IS NOT NULL")
    return posts.select("id", F.explode(tx.capital_phrases("text")).alias("phrase")).groupBy("phrase").agg(F.count("*").alias("n"))


def topic_clean(spark: SparkSession, d: str) -> DataFrame:
    return tb.cluster_topics(spark, d).filter("topic IS NOT NULL").select(*KEY, tx.clean_title("topic").alias("topic"))


def top_request(spark: SparkSession, d: str) -> DataFrame:
    best = prompts.top_request(F.col("top_requests"))
    return request_lists(spark, d).select("r", "total_count_30d", best["phrase"].alias("phrase"), best["count"].alias("count"), F.to_json(F.slice("top_requests", 1, 1)).alias("json"))


def responses(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "post_responses", "request_id", "user_prompt", "profile_prompt", "bot_prompt", "post_title", "post_text").distinct()


def clamped_demand(spark: SparkSession, d: str) -> DataFrame:
    """Demand of clusters as a service may ask for it: between 50 and 2,000, 100 where nothing is known."""
    wanted = tb.cluster_topics(spark, d).select(*KEY).join(popularity(spark, d).select(*KEY, "total_count_30d"), KEY, "left")
    return wanted.select(*KEY, tx.clamped("total_count_30d", 50, 2000, 100).alias("demand"))


def style_profile(spark: SparkSession, d: str) -> DataFrame:
    """The whole profile of each cluster: lengths, rates, key phrases and typical posts."""
    typical = style_exemplars(spark, d).groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "post_id"))), lambda x: x["post_id"]).alias("exemplar_post_ids"))
    rows = style_lengths(spark, d).join(style_rates(spark, d), KEY).join(keyphrases(spark, d), KEY, "left").join(typical, KEY, "left")
    none = F.array().cast("array<string>")
    return rows.withColumn("top_ngrams", F.coalesce("top_ngrams", none)).withColumn("slang_ngrams", F.coalesce("slang_ngrams", none))


def request_parse(spark: SparkSession, d: str) -> DataFrame:
    """Requests from their JSON form, with the sum of their counts."""
    found = request_lists(spark, d).select("r", prompts.requests_from_json(F.to_json("top_requests")).alias("q"))
    return found.select("r", F.size("q").alias("n"), F.aggregate("q", F.lit(0).cast("bigint"), lambda s, x: s + x["count"]).alias("total"), F.element_at("q", -1)["phrase"].alias("last"))


def prompt_build(spark: SparkSession, d: str) -> DataFrame:
    return responses(spark, d).select("request_id", prompts.build(F.col("bot_prompt"), F.col("profile_prompt"), F.col("user_prompt")).alias("prompt"))


def prompt_parse(spark: SparkSession, d: str) -> DataFrame:
    rows = responses(spark, d).select("request_id", prompts.parse(prompts.build(F.col("bot_prompt"), F.col("profile_prompt"), F.col("user_prompt"))).alias("p"))
    return rows.select("request_id", "p.bot", "p.profile", "p.user")


def post_parts(spark: SparkSession, d: str) -> DataFrame:
    whole = F.concat_ws("\n\n", "post_title", "post_text")
    return responses(spark, d).select("request_id", prompts.title(whole).alias("title"), prompts.body(whole).alias("body"))


def terms_of(spark: SparkSession, d: str) -> DataFrame:
    """The dictionary under the categories of the policy."""
    kinds = F.create_map(*(F.lit(x) for x in ("abuse", "profanity", "hate_target", "extremism_support", "sexual", "illegal_content")))
    return read_table(spark, d, "moderation_terms", "category", "lemma", "form").withColumn("category", kinds[F.col("category")])


def requests_of(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "moderation_requests", "request_id", "text").groupBy("request_id").agg(F.max("text").alias("text"))


def plain_hits(spark: SparkSession, d: str) -> DataFrame:
    return moderation.plain_hits(requests_of(spark, d), terms_of(spark, d), "request_id", "text")


def dict_hits(spark: SparkSession, d: str) -> DataFrame:
    out = moderation.dictionary_hits(requests_of(spark, d), terms_of(spark, d), "request_id", "text")
    return out.select("request_id", F.explode("hits").alias("category", "lemmas")).select("request_id", "category", F.array_join("lemmas", ",").alias("lemmas"))


def moderation_decision(spark: SparkSession, d: str) -> DataFrame:
    hits = plain_hits(spark, d).groupBy("request_id").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("category", F.array().cast("array<string>"))))).alias("hits"))
    rows = requests_of(spark, d).join(hits, "request_id", "left")
    return rows.select("request_id", moderation.decide(F.col("hits"), F.create_map().cast("map<string,double>")).alias("v")).select("request_id", "v.decision", "v.reason")


def moderated(spark: SparkSession, d: str) -> DataFrame:
    return moderation.moderate(requests_of(spark, d), terms_of(spark, d), "request_id", "text").select("request_id", "decision", "reason", "text")


def model_decision(spark: SparkSession, d: str) -> DataFrame:
    """Decisions by scores of models, for which shares made of the request's number stand in."""
    share = lambda k, m: (F.col("request_id") * k % m) / F.lit(float(m))
    scores = moderation.combine_scores({"insult": share(7, 101), "obscene": share(11, 97)}, {"drugs": share(13, 89), "weapons": share(17, 83)}, {"calls": share(19, 79)})
    rows = requests_of(spark, d).select("request_id", scores.alias("s"))
    rows = rows.withColumn("v", moderation.decide(F.create_map().cast("map<string,array<string>>"), F.col("s")))
    return rows.select("request_id", *(F.round(F.col("s")[k], 6).alias(k) for k in ("profanity", "extremism_support", "illegal_content")), "v.decision", "v.reason")


def moderation_answers(spark: SparkSession, d: str) -> DataFrame:
    found = moderation.verdicts(moderation.moderate(requests_of(spark, d), terms_of(spark, d), "request_id", "text"), "request_id")
    return found.select("request_id", "ok", F.array_join("labels", ",").alias("labels"), F.array_join("reasons", ",").alias("reasons"))


def lemmatised(spark: SparkSession, d: str) -> DataFrame:
    return moderation.lemmatised(requests_of(spark, d), terms_of(spark, d).filter("form NOT LIKE '% %'"), "request_id", "text")


def expanded_forms(spark: SparkSession, d: str) -> DataFrame:
    terms = terms_of(spark, d)
    return moderation.expand_forms(terms.select("category", "lemma").distinct(), terms.select("lemma", "form").distinct())


def normalised(spark: SparkSession, d: str) -> DataFrame:
    return requests_of(spark, d).select("request_id", tx.surface("text").alias("surface"), tx.compact("text").alias("compact"))


def points(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "embeddings", "vec_id", "embedding").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("emb"))


def tfidf(spark: SparkSession, d: str) -> DataFrame:
    return style.tfidf(read_table(spark, d, "moderation_requests", "request_id", "text"), "request_id", "text").withColumn("weight", F.round("weight", 6))


def knn_dist(spark: SparkSession, d: str) -> DataFrame:
    return clustering.neighbour_distances(points(spark, d), 4).withColumn("distance", F.round("distance", 6))


def eps_knee(spark: SparkSession, d: str) -> DataFrame:
    return clustering.knee(clustering.neighbour_distances(points(spark, d), 4), 4).select(F.round("eps", 4).alias("eps"))


def dbscan(spark: SparkSession, d: str) -> DataFrame:
    return clustering.dbscan(points(spark, d), 0.9, 5)


def automatic_eps(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(clustering.automatic_eps(points(spark, d)),)], "eps double").select(F.round("eps", 4).alias("eps"))


def improved_clusters(spark: SparkSession, d: str) -> DataFrame:
    return clustering.improved_clusters(points(spark, d))


def eps_grid(spark: SparkSession, d: str) -> DataFrame:
    return clustering.eps_grid(points(spark, d), [0.7, 0.8, 0.9], ("cosine", "euclidean"))


def kmeans(spark: SparkSession, d: str) -> DataFrame:
    return clustering.kmeans(points(spark, d), 12)


def pca(spark: SparkSession, d: str) -> DataFrame:
    return clustering.reduce_dimensions(points(spark, d), 2)


def hdbscan(spark: SparkSession, d: str) -> DataFrame:
    return clustering.hierarchy(points(spark, d))


def cluster_eval(spark: SparkSession, d: str) -> DataFrame:
    return clustering.evaluate(tb.assignments(spark, d).select(F.col("cluster_id").alias("label"))).withColumn("noise_share", F.round("noise_share", 6))


QUERIES = {
    f.__name__: f
    for f in (
        recency, trend_score, trend_top, topics_dedup, topics_latest, topics_insert_new, next_id, pending_embeddings, pending_titles, popularity_wanted, embeddings_upsert, titles_update, section_backfill, section_replace, style_latest,
        repeated_keys, centroids, centroid_norms, cluster_sizes, unit_vectors, vector_text, retriever_view, nn_clusters, similar_posts, cosine_topn, exemplar_posts, style_exemplars, lex_match, trigram_sim, discover_clusters, rerank_posts,
        candidates_ranked, batch_nearest, context_prompts, style_lengths, style_rates, term_scores, keyphrases, topic_groups, cap_phrases, topic_clean, top_request, prompt_build, prompt_parse, post_parts, plain_hits, dict_hits,
        moderation_decision, moderated, normalised, largest_clusters, clamped_demand, style_profile, plain_phrases, style_upsert, popularity_upsert, similar_to_text, style_topic, topic_prompts, get_post, request_parse, model_decision, moderation_answers, lemmatised, expanded_forms, automatic_eps, improved_clusters, tfidf, knn_dist, eps_knee, dbscan, eps_grid, kmeans, pca, hdbscan, cluster_eval,
    )
}

__all__ = ["QUERIES", "SQL"]
