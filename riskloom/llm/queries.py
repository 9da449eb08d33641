"""One registered query for each operator, over the whole of its table."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import chat, countjoin, lm, middle, mixing, packing, periodic, piecewise, quality, sharding, simhash, tokenshards, urls
from .common import LOWER, UPPER, n_words, unit, words_of

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def table(spark, sf: str, name: str):
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op1_quality_rules")
def op1(spark, sf):
    docs = table(spark, sf, "documents")
    rules = quality.fit(docs, table(spark, sf, "labels"))
    return quality.judge(docs.select("doc_id", "text"), rules).drop("text")


_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

OP2 = f"""
WITH d AS (
  SELECT doc_id, source, {_WORDS}::BIGINT AS size, coalesce(source, '') AS src, source IS NULL AS missing,
         md5(coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))) AS k FROM documents
), o AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY missing, src ORDER BY k, size
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM d
), s AS (
  SELECT missing, src, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY missing, src) - 1 AS place FROM d GROUP BY missing, src
), w AS (
  SELECT *, (place % 3)::INT AS class, [5e0, 2e0, 1e0][1 + place % 3] AS weight, 2e0 * source_size AS cap,
         sum(source_size) OVER () AS everything FROM s
), f AS (
  SELECT *, (1.5e0 * everything - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM w WINDOW b AS (ORDER BY cap / weight, missing, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT *, least(cap, coalesce(weight * max(CASE WHEN cap / weight > level THEN level END) OVER (), cap)) AS target FROM f
), u AS (
  SELECT doc_id, size, source_size, target, class, floor(target + 0.5)::BIGINT AS demand, start,
         greatest(least(floor(target + 0.5)::BIGINT - start, size), 0) AS first_words,
         greatest(least(floor(target + 0.5)::BIGINT - source_size - start, size), 0) AS second_words
  FROM o JOIN t USING (missing, src)
), q AS (SELECT *, CASE WHEN first_words > 0 THEN start::DOUBLE / demand END AS share FROM u)
SELECT doc_id, size, source_size, target, (first_words + second_words)::BIGINT AS taken,
       ((first_words > 0)::INT + (second_words > 0)::INT)::INT AS uses,
       round(CASE WHEN share <= 0 THEN 0e0
                  WHEN class = 0 THEN 2e0 * share / (1.5e0 + sqrt(2.25e0 + -2e0 * share))
                  WHEN class = 1 THEN 2e0 * share / (1e0 + sqrt(1e0 + 0e0 * share))
                  ELSE 2e0 * share / (0.5e0 + sqrt(0.25e0 + 2e0 * share)) END, 9) AS first_position
FROM q
"""


@query("op2_curriculum_mix", OP2)
def op2(spark, sf):
    docs = table(spark, sf, "documents")
    narrow = docs.select("doc_id", "source", "text")
    planned = mixing.plan_mix(
        narrow.select("doc_id", "source", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"),
                      n_words(F.col("text")).alias("n_words")),
        "source", F.col("n_words"), [F.col("doc_id"), F.col("text_md5")],
    )
    first = F.round(F.try_element_at("uses", F.lit(1))["position"], 9)
    out = planned.select(
        "doc_id", "size", "source_size", "target", "taken", F.size("uses").alias("uses"), first.alias("first_position")
    )
    by_time = F.coalesce("first_position", 1 + unit(F.xxhash64("doc_id")))
    return out.repartitionByRange(by_time).sortWithinPartitions("first_position")


URL_RULES = [
    urls.UrlRule("allow", "com"), urls.UrlRule("block", "example.com", "/en/"), urls.UrlRule("allow", "www.example.com", "/en/"),
    urls.UrlRule("block", "net", "/es/"), urls.UrlRule("block", "net", "/fr/"),
]
#: Hosts with one of these words between dots and hyphens make the block list.
BLOCKED_WORDS = "(^|[.-])(adult|ads|bets|casino|pills|spam)([.-]|$)"

OP3 = f"""
WITH r(action, host, path) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
                                      ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
u AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, url, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
p AS (SELECT page_id, row_number() OVER () AS n, translate(raw, '{UPPER}', '{LOWER}') AS host,
             regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
m AS (SELECT p.n, arg_max(r.host || r.path, length(r.host || r.path) * 1000 + length(r.host)) AS rule,
             arg_max(r.action, length(r.host || r.path) * 1000 + length(r.host)) AS action
      FROM p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY p.n)
SELECT page_id, host, path, rule,
       coalesce(action, CASE WHEN regexp_matches(host, '{BLOCKED_WORDS}') THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN m USING (n)
"""


@query("op3_url_filters", OP3)
def op3(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url")
    host, _ = urls.host_and_path(F.col("url"))
    blocked = pages.select(host.alias("host")).distinct().where(F.col("host").rlike(BLOCKED_WORDS))
    return urls.judge_urls(pages, "url", URL_RULES, blocked).drop("url")


@query("op4_sharding")
def op4(spark, sf):
    docs = table(spark, sf, "documents").select(
        "doc_id",
        (F.octet_length(F.coalesce("text", F.lit(""))) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    return sharding.assign_shards(docs, "doc_id", [1.0] * 24, grown=[1.0] * 25)


@query("op5_training_order")
def op5(spark, sf):
    out = tokenshards.new_folder(spark)
    index = tokenshards.write_training_order(f"{sf}/documents.parquet", out, spark)
    stored = tokenshards.read_training_order(spark, out)
    stored = stored.select("slot", F.crc32("tokens").cast("long").alias("tokens_crc32"))
    return index.join(stored, "slot", "left").select(
        "slot", "shard", F.col("id").alias("doc_id"), "seq", "n_tokens", "tokens_crc32"
    )


@query("op6_best_fit_packing")
def op6(spark, sf):
    return packing.pack_documents(table(spark, sf, "documents"))


@query("op7_simhash_near_duplicates")
def op7(spark, sf):
    return simhash.near_duplicates(table(spark, sf, "documents")).drop("component")


@query("op8_lm_scoring")
def op8(spark, sf):
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    return lm.score_documents(table(spark, sf, "documents"), held_out)


_ESCAPED = r"""regexp_replace(replace(coalesce({0}, ''), '\', '\\'),
  '(<)(\|im_start\|>|\|im_sep\|>|\|im_end\|>|s>|/s>|<SYS>>|</SYS>>)|(\[)(INST\]|/INST\])', '\1\3\\\2\4', 'g')"""

OP9 = f"""
WITH c AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(12 + length({_ESCAPED.format("role")}) + 10 + length({_ESCAPED.format("text")}) + 10)::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""


@query("op9_chat_formatting", OP9)
def op9(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    quoting = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", quoting), (-1, 1, "assistant", quoting)], rows.schema)
    messages = chat.linear_threads(rows.unionByName(extra), "conv_id", "turn")
    done = chat.format_conversations(messages)
    turns, loss = chat.read_turns(F.col("formatted")), chat.read_loss(F.col("formatted"), F.col("loss_spans"))
    done = done.withColumns({"turns": turns, "loss": loss})
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query("op10_piecewise_fingerprints")
def op10(spark, sf):
    found = piecewise.neighbour_fingerprints(table(spark, sf, "documents"))
    return found.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        piecewise.likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        piecewise.likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


OP11 = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), u AS (
  SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS lines,
         [('0x' || substr(h, 1 + 8 * i, 8))::BIGINT FOR i IN range(4)] AS draw FROM d
), c AS (
  SELECT *, len(lines) AS n, least(draw[1] % (len(lines) + 1), draw[2] % (len(lines) + 1)) AS a,
         greatest(draw[1] % (len(lines) + 1), draw[2] % (len(lines) + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR draw[3] % 100 >= 100 THEN 'plain'
              WHEN draw[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u
), p AS (
  SELECT *, array_to_string(lines[1:a], '') AS prefix, array_to_string(lines[a + 1:b], '') AS middle,
         array_to_string(lines[b + 1:], '') AS suffix FROM c
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE t END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""


@query("op11_fill_in_middle", OP11)
def op11(spark, sf):
    done = middle.fill_in_middle(table(spark, sf, "documents").select("doc_id", "text"))
    return done.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


@query("op12_periodic_runs")
def op12(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", words_of(F.col("text")).alias("words"))
    n, h = F.size("words"), F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    docs = docs.withColumns({"n": n, "h": h, "g": F.floor(h / 10)})
    docs = docs.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    docs = docs.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    a, p = F.col("a"), F.col("p")
    looped = F.transform("words", lambda w, i: F.when(i < a, w).otherwise(F.get("words", (a + F.pmod(i - a, p)).cast("int"))))
    docs = docs.select("doc_id", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), looped).otherwise(F.col("words")).alias("words"))
    found = docs.withColumn("found", periodic.periodic_runs(F.col("words"))).select("doc_id", "words", "found.*")
    best = periodic.longest_run(F.col("runs"))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    said = F.concat_ws("", F.transform(lines, lambda x: F.concat(x, F.lit("\n"))))
    found = found.withColumn("best", best)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"),
        F.col("best.period").alias("period"), F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(said, 256).alias("runs_sha256"),
        F.sha2(F.array_join(periodic.without_repetitions(F.col("words"), F.col("kept")), " "), 256).alias("collapsed_sha256"),
    )


@query("op13_count_vector_join")
def op13(spark, sf):
    return countjoin.jaccard_classes(table(spark, sf, "documents"))
