"""Text and vector operators over documents, benchmark passages, conversations and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import ids, stats, text, vector
from graphloom.plans.tables import Registry, table

R = Registry()
query = R.query
_WORDS = r"list_filter(string_split_regex({}, '[ \t\n\r\f\v]+'), lambda x: x <> '')"
_TERMS = r"list_filter(list_distinct(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')), lambda x: length(x) > 2)"


@query("SELECT doc_id, CAST(CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 3) END AS BIGINT) AS tokens, CAST(ceil(length(text) / 4.0) AS BIGINT) AS estimate, CAST(ceil(CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 3) END / 6144.0) AS BIGINT) AS chunks FROM documents")
def token_count(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", text.approx_tokens(t).alias("tokens"), text.estimated_tokens(t).alias("estimate"), text.chunk_estimate(text.approx_tokens(t), text.chunk_budget()).alias("chunks"))


@query(f"SELECT doc_id, CAST(len({_TERMS.format('text')}) AS BIGINT) AS terms, array_to_string(list_sort({_TERMS.format('text')})[1:5], ' ') AS first_terms FROM documents")
def term_set(spark, d):
    t = text.terms(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(t).cast("long").alias("terms"), F.array_join(F.slice(F.array_sort(t), 1, 5), " ").alias("first_terms"))


_LATIN = "list_filter(list_distinct(regexp_extract_all(lower(text), '[A-Za-zА-Яа-яЁё0-9]+')), lambda x: length(x) > 2)"


@query(f"SELECT doc_id, CAST(len({_LATIN}) AS BIGINT) AS terms, md5(array_to_string(list_sort({_LATIN}), ' ')) AS digest FROM documents")
def latin_cyrillic_terms(spark, d):
    rows = table(spark, d, "documents").select("doc_id", text.terms(F.col("text"), text.LATIN_CYRILLIC).alias("t"))
    return rows.select("doc_id", F.size("t").cast("long").alias("terms"), F.md5(F.array_join(F.array_sort("t"), " ")).alias("digest"))


@query(f"""WITH w AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents)
SELECT doc_id, CAST(i AS INTEGER) AS idx, CAST(len(w[i * 160 + 1 : i * 160 + 160]) AS BIGINT) AS n_words, md5(array_to_string(w[i * 160 + 1 : i * 160 + 160], ' ')) AS text_md5
FROM w, unnest(range(CAST(greatest(1, ceil(len(w) / 160.0)) AS BIGINT))) AS t(i)""")
def word_window_chunks(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.inline(text.word_windows(F.col("text"))))
    return rows.select("doc_id", "idx", F.size(text.words(F.col("text"))).cast("long").alias("n_words"), F.md5("text").alias("text_md5"))


@query("SELECT conv_id, turn, 'chunk_' || CAST(turn AS VARCHAR) || '_' || sha256(CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) || ':' || text)[1:12] AS chunk_id, 'ent_' || sha256(CAST(conv_id AS VARCHAR) || '|' || role)[1:16] AS entity_id FROM conversations")
def stable_ids(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", ids.chunk_id(F.col("turn"), F.col("text"), F.col("conv_id").cast("string")).alias("chunk_id"), ids.joined_id("ent", F.col("conv_id").cast("string"), F.col("role")).alias("entity_id"))


@query(r"""SELECT item_id, array_to_string(list_filter(string_split_regex(translate(lower(text), '!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~', ''), '\s+'), lambda t: t NOT IN ('a', 'an', 'the', '')), ' ') AS answer FROM benchmark""")
def normalize_answer(spark, d):
    return table(spark, d, "benchmark").select("item_id", text.normalized_answer(F.col("text")).alias("answer"))


_FACTS = r"""list_distinct(list_transform(list_filter(list_transform(regexp_extract_all({}, '[A-Za-z][A-Za-z0-9''.-]*|[0-9]+(?:\.[0-9]+)?'), lambda t: lower(trim(t, '.,;:!?()[]{{}}"'''))), lambda t: (length(t) > 3 OR regexp_full_match(t, '[0-9]+')) AND NOT list_contains(['""" + "','".join(text.STOPWORDS) + r"""'], t)), lambda t: 'term:' || t))"""


@query(f"SELECT doc_id, CAST(len({_FACTS.format('text')}) AS BIGINT) AS facts, md5(array_to_string(list_sort({_FACTS.format('text')}), ' ')) AS digest FROM documents")
def fact_terms(spark, d):
    # the generator computes the terms of a text once for both columns
    made = lambda f: F.struct(F.size(f).cast("long").alias("facts"), F.md5(F.array_join(F.array_sort(f), " ")).alias("digest"))
    return table(spark, d, "documents").select("doc_id", F.inline(F.transform(F.array(text.fact_terms(F.col("text"))), made)))


@query(r"SELECT item_id, CAST(len(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+(?:\.[0-9]+)?'), lambda t: length(t) > 3 OR regexp_full_match(t, '[0-9]+'))) AS BIGINT) AS facts FROM benchmark")
def plain_fact_tokens(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.size(text.plain_facts(F.col("text"))).cast("long").alias("facts"))


@query("""SELECT event_id, CAST(user_id AS VARCHAR) AS user_id, CASE WHEN event_type IN ('click', 'view') THEN 'ham' WHEN event_type = 'error' THEN 'spam' END AS label, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS occurred_at FROM events""")
def record_facts(spark, d):
    """Record lines are written in their delimited form and parsed back."""
    kind = F.when(F.col("event_type").isin("click", "view"), "not spam").when(F.col("event_type") == "error", "Spam").otherwise("unknown")
    line = F.concat(F.lit("Date: "), F.date_format("ts", "MMM d, yyyy"), F.lit(" || User: user "), F.col("user_id").cast("string"), F.lit(" || Label: "), kind)
    lines = table(spark, d, "events").select("event_id", F.explode(text.record_lines(F.concat(F.lit("header\n"), line))).alias("line"))
    return lines.select("event_id", text.normalized_user(text.field(F.col("line"), "User")).alias("user_id"), text.normalized_label(text.field(F.col("line"), "Label")).alias("label"), text.parsed_date(text.field(F.col("line"), "Date")).cast("timestamp_ntz").alias("occurred_at"))


@query(r"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '[.!?…]+|\n+'), lambda x: trim(x)), lambda x: x <> '') AS s FROM documents)
SELECT doc_id, CAST(len(s) AS BIGINT) AS sentences, CAST(len(list_filter(s, lambda x: regexp_matches(x, '(?i)\b(was|were|saw|gave|took)\b'))) AS BIGINT) AS eventive FROM s""")
def sentence_split(spark, d):
    s = text.sentences(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(s).cast("long").alias("sentences"), F.size(F.filter(s, lambda x: x.rlike(r"(?i)\b(was|were|saw|gave|took)\b"))).cast("long").alias("eventive"))


@query(r"SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9_]+', '_', 'g'), '_') AS slug FROM part")
def entity_slug(spark, d):
    return table(spark, d, "part").select("p_partkey", text.slug(F.col("p_name")).alias("slug"))


@query("""WITH s AS (SELECT * FROM (VALUES ('the'), ('of'), ('tion')) AS t(surface)), p AS (SELECT doc_id, surface, string_split(lower(text), surface) AS parts FROM documents, s), u AS (SELECT doc_id, surface, unnest(parts[1:len(parts) - 1]) AS x, generate_subscripts(parts[1:len(parts) - 1], 1) AS i FROM p WHERE len(parts) > 1),
a AS (SELECT doc_id, surface, i, CAST(sum(length(x)) OVER (PARTITION BY doc_id, surface ORDER BY i) + (i - 1) * length(surface) AS BIGINT) AS a FROM u)
SELECT doc_id, surface, count(*) AS n, md5(string_agg(CAST(a AS VARCHAR), ',' ORDER BY i)) AS places FROM a GROUP BY doc_id, surface""")
def find_occurrences(spark, d):
    surfaces = F.explode(F.array(*(F.lit(x) for x in ("the", "of", "tion"))))
    rows = table(spark, d, "documents").withColumn("surface", surfaces).withColumn("at", text.occurrences(F.col("text"), F.col("surface")))
    return rows.where(F.size("at") > 0).select("doc_id", "surface", F.size("at").cast("long").alias("n"), F.md5(F.array_join(F.transform("at", lambda x: x.cast("string")), ",")).alias("places"))


@query(r"""SELECT event_id, CASE WHEN event_type = 'purchase' THEN CAST(event_id % 97 AS VARCHAR) END AS answer, CAST(length('Answer from the context only.' || chr(10) || chr(10) || 'Context:' || chr(10) || CASE WHEN event_type = 'purchase' THEN 'hay The secret code is ' || CAST(event_id % 97 AS VARCHAR) || '.' ELSE 'hay' END || chr(10) || chr(10) || 'Question: what is it?') AS BIGINT) AS prompt_chars FROM events""")
def needle_answer(spark, d):
    context = F.when(F.col("event_type") == "purchase", F.concat(F.lit("hay The secret code is "), (F.col("event_id") % 97).cast("string"), F.lit("."))).otherwise("hay")
    return table(spark, d, "events").select("event_id", text.secret_answer(context).alias("answer"), F.length(text.direct_prompt(context, F.lit("what is it?"))).cast("long").alias("prompt_chars"))


@query(r"""WITH p AS (SELECT event_id, event_type, CASE event_type WHEN 'click' THEN 'NUMERIC' WHEN 'view' THEN 'USER' WHEN 'error' THEN 'COMPARISON' ELSE 'TEXT' END AS kind,
  CASE event_type WHEN 'click' THEN 'it is -' || CAST(event_id AS VARCHAR) || ' or 2.5' WHEN 'view' THEN 'user ' || CAST(user_id AS VARCHAR) WHEN 'error' THEN 'ham is more common than spam' WHEN 'signup' THEN 'Answer: Ham' ELSE '"Spam"' END AS said FROM events)
SELECT event_id, array_to_string(CASE kind WHEN 'NUMERIC' THEN regexp_extract_all(said, '-?\d+(?:\.\d+)?') WHEN 'USER' THEN regexp_extract_all(said, '\b\d+\b')
  WHEN 'COMPARISON' THEN ['more common than', 'more common'] ELSE [CASE WHEN event_type = 'signup' THEN 'ham' ELSE 'spam' END] END, '|') AS values, CAST(event_type IN ('signup', 'purchase') AS BOOLEAN) AS one_label FROM p""")
def predicted_values(spark, d):
    e = F.col("event_type")
    kind = F.when(e == "click", "NUMERIC").when(e == "view", "USER").when(e == "error", "COMPARISON").otherwise("TEXT")
    said = (
        F.when(e == "click", F.concat(F.lit("it is -"), F.col("event_id").cast("string"), F.lit(" or 2.5"))).when(e == "view", F.concat(F.lit("user "), F.col("user_id").cast("string")))
        .when(e == "error", "ham is more common than spam").when(e == "signup", "Answer: Ham").otherwise('"Spam"')
    )
    vocabulary = F.array(F.lit("ham"), F.lit("spam"))
    return table(spark, d, "events").select("event_id", F.array_join(text.predicted_values(kind, said), "|").alias("values"), (F.size(text.predicted_label(vocabulary, said)) == 1).alias("one_label"))


_V = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"


@query(f"""WITH v AS (SELECT vec_id, label, {_V} AS v FROM embeddings), q AS (SELECT vec_id AS query_id, v AS q FROM v WHERE vec_id % 50 = 0),
s AS (SELECT query_id, vec_id, round(list_cosine_similarity(q, v), 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(q, v), 6) DESC, vec_id) AS rank FROM v, q WHERE query_id <> vec_id)
SELECT query_id, vec_id, CAST(rank AS INTEGER) AS rank, score FROM s WHERE rank <= 5""")
def dense_topk(spark, d):
    from graphloom.operators import retrieval

    rows = table(spark, d, "embeddings").select("vec_id", vector.doubles(F.col("embedding")).alias("v"))
    return retrieval.dense_topk(rows, rows.where("vec_id % 50 = 0"), 5)


@query(f"""WITH v AS (SELECT vec_id, {_V} AS v FROM embeddings), q AS (SELECT v AS q FROM v WHERE vec_id = 0),
c AS (SELECT vec_id, i, q[i] * v[i] AS c, row_number() OVER (PARTITION BY vec_id ORDER BY abs(q[i] * v[i]) DESC, i) AS r FROM v, q, unnest(range(1, len(v) + 1)) AS t(i))
SELECT vec_id, CAST(i - 1 AS INTEGER) AS dimension, round(c, 9) AS contribution FROM c WHERE r <= 8""")
def contribution_top_components(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", vector.doubles(F.col("embedding")).alias("v"))
    one = rows.where("vec_id = 0").select(F.col("v").alias("q"))  # one row
    return rows.crossJoin(F.broadcast(one)).select("vec_id", F.inline(vector.top_components(F.col("q"), F.col("v")))).withColumn("contribution", F.round("contribution", 9))


@query(f"""WITH v AS (SELECT label, unnest({_V}) AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings) SELECT label, CAST(dim AS INTEGER) AS dim, round(avg(x), 6) AS mean FROM v GROUP BY label, dim""")
def mean_vector_by_label(spark, d):
    rows = table(spark, d, "embeddings").select("label", vector.doubles(F.col("embedding")).alias("v"))
    return vector.mean_vectors(rows, "label", "v").withColumn("mean", F.round("mean", 6))


@query(f"""WITH t AS (SELECT item_id, unnest({_WORDS.format('lower(text)')}) AS t FROM benchmark),
h AS (SELECT item_id, CAST(('0x' || sha256(t)[1:8]) AS BIGINT) % 256 AS dim, CASE WHEN CAST(('0x' || sha256(t)[9:10]) AS BIGINT) % 2 = 0 THEN 1.0 ELSE -1.0 END AS s FROM t),
r AS (SELECT item_id, dim, sum(s) AS raw FROM h GROUP BY item_id, dim HAVING sum(s) <> 0), n AS (SELECT item_id, sqrt(sum(CAST(raw * raw AS DOUBLE))) AS size FROM r GROUP BY item_id)
SELECT item_id, CAST(dim AS INTEGER) AS dim, round(CAST(raw AS DOUBLE) / size, 6) AS value FROM r JOIN n USING (item_id)""")
def hashing_vector_sparse(spark, d):
    return vector.hashed_tokens(table(spark, d, "benchmark"), "item_id", F.col("text")).withColumn("value", F.round("value", 6))


@query(f"""WITH v AS (SELECT vec_id, label, {_V} AS v FROM embeddings)
SELECT round(avg(CASE WHEN a.label = b.label THEN c END), 6) AS same_mean, round(avg(CASE WHEN a.label <> b.label THEN c END), 6) AS different_mean, round(avg(CASE WHEN a.label = b.label THEN c END) - avg(CASE WHEN a.label <> b.label THEN c END), 6) AS margin
FROM (SELECT a.label AS la, a, b, list_cosine_similarity(a.v, b.v) AS c FROM v a JOIN v b ON a.vec_id < b.vec_id) x""")
def cluster_separation(spark, d):
    from graphloom.operators import evaluation

    rows = table(spark, d, "embeddings").select("vec_id", "label", vector.doubles(F.col("embedding")).alias("v"))
    return evaluation.cluster_separation(rows)


@query(f"""WITH v AS (SELECT vec_id, {_V} AS v FROM embeddings), q AS (SELECT v AS q FROM v WHERE vec_id = 0), p AS (SELECT vec_id, list_transform(range(1, 65), lambda i: 0.45 * q[i] + 0.25 * q[i] + 0.30 * v[i]) AS u, list_transform(range(1, 65), lambda i: q[i] * v[i]) AS c FROM v, q)
SELECT vec_id, round(u[1] / sqrt(list_dot_product(u, u)), 6) AS navigation_0, round(c[1] / sqrt(list_dot_product(c, c)), 6) AS profile_0, round((list_cosine_similarity(u, c) + 1) / 2, 6) AS unit FROM p""")
def navigation_profile(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", vector.doubles(F.col("embedding")).alias("v"))
    one = rows.where("vec_id = 0").select(F.col("v").alias("q"))  # one row
    both = rows.crossJoin(F.broadcast(one)).withColumn("u", vector.navigation_update(F.col("q"), F.col("q"), F.col("v"))).withColumn("c", vector.contribution_profile(F.col("q"), F.col("v")))
    return both.select("vec_id", F.round(F.get("u", F.lit(0)), 6).alias("navigation_0"), F.round(F.get("c", F.lit(0)), 6).alias("profile_0"), F.round(vector.unit_cosine(vector.cosine(F.col("u"), F.col("c"))), 6).alias("unit"))


@query()
def hashed_interaction_profile(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", vector.doubles(F.col("embedding")).alias("v"))
    one = rows.where("vec_id = 0").select(F.col("v").alias("q"))  # one row
    return rows.crossJoin(F.broadcast(one)).select("vec_id", vector.hashed_profile(F.col("q"), F.col("v"), 64).alias("profile"))


@query("""WITH c AS (SELECT lang, count(*) AS n, sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS k FROM labels JOIN documents USING (doc_id) GROUP BY lang), p AS (SELECT lang, CAST(n AS DOUBLE) AS n, CAST(k AS DOUBLE) / n AS p, 1.959963984540054 AS z FROM c)
SELECT lang, round(greatest(0, (p + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)), 6) AS low, round(least(1, (p + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)), 6) AS high FROM p""")
def wilson_ci(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("quality") == 1).alias("k"))
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return rows.select("lang", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query()
def bootstrap_ci(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id").select("lang", F.col("quality").cast("double").alias("quality"))
    return stats.bootstrap_ci(rows, "lang", "quality")


@query("""SELECT event_type, percentile_disc(0.95) WITHIN GROUP (ORDER BY value) AS p95_nearest, round(percentile_cont(0.95) WITHIN GROUP (ORDER BY value), 6) AS p95_continuous,
  list_sort(list(value))[CAST(round_even((count(*) - 1) * 0.95, 0) AS BIGINT) + 1] AS p95_index, round(sum(value) / nullif(count(*), 0), 6) AS mean FROM events GROUP BY event_type""")
def percentile_kinds(spark, d):
    rows = table(spark, d, "events")
    return rows.groupBy("event_type").agg(
        stats.nearest_rank("value", 0.95).alias("p95_nearest"), F.round(stats.continuous("value", 0.95), 6).alias("p95_continuous"),
        stats.index_rounded(F.collect_list("value"), 0.95).alias("p95_index"), F.round(F.sum("value") / F.count(F.lit(1)), 6).alias("mean"),
    )
