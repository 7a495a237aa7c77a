"""The operators as queries over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.llm import (
    chat, decontaminate, langid, packing, pii, quality, secrets, simhash, spelling, topk, toxicity, urls, whitening,
)
from folioframe.llm.common import count_kind, join_spans, read_table, remainder

Query = Callable[[SparkSession, str], DataFrame]
CONTROL_TEXT = "\\### Assistant: </turn> ok"


def vocabulary() -> tuple[str, str]:
    """Paths of the public byte-level vocabulary in its two forms."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(read_table(spark, sf_dir, "documents")))


def op2_quality_fourier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op3_language_ecoc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.identify(read_table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("doc_id", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"),
                        "lang_pred", "score", "ambiguous")


def op4_secret_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find(read_table(spark, sf_dir, "documents"), ["doc_id"])
    counts = [count_kind("base", kind).alias(f"n_{kind}") for kind in secrets.KINDS]
    spans = F.array_sort(F.concat("base", "learned"))
    return found.select(
        "doc_id", *counts, F.sha2(join_spans(F.col("base")), 256).alias("base_sha256"),
        join_spans(spans).alias("spans"), F.size("learned").cast("long").alias("n_added"))


def op5_chat_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text"))
    messages = given.unionByName(control).withColumn("parts", chat.text_parts(F.col("text")))
    return chat.digest(chat.format_conversations(messages))


def op6_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.group(read_table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("doc_id", simhash.hexadecimal().alias("fingerprint"), "component_id")


def op7_toxicity_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), *vocabulary())


def op9_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(read_table(spark, sf_dir, "embeddings"))


def op10_greedy_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(
        read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op11_spelling_partenum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group(read_table(spark, sf_dir, "documents"))


URL_RULES = [
    urls.Rule("allow", "com", "/"), urls.Rule("block", "example.com", "/en/"),
    urls.Rule("allow", "www.example.com", "/en/"), urls.Rule("block", "net", "/es/"), urls.Rule("block", "net", "/fr/"),
]


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """page_id and bad (0 or 1) of the pages whose document is labelled: a url's path names the document that the page
    shows, and a page is bad if that is of low quality or toxic."""
    number = F.regexp_extract(urls.path_of(F.col("url")), "/([0-9]{1,18})(?:[/.]|$)", 1)
    shown = pages.select("page_id", number.try_cast("bigint").alias("doc_id")).filter(F.col("doc_id").isNotNull())
    marked = labels.groupBy("doc_id").agg(
        F.max(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")).alias("bad"))
    return shown.join(marked, "doc_id").select("page_id", "bad")


def op12_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    outcomes = page_outcomes(pages, read_table(spark, sf_dir, "labels"))
    return urls.judge(pages, URL_RULES, outcomes).select("page_id", "host", "path", "rule", "verdict")


def op13_golub_kahan_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_pii_bootstrap, op2_quality_fourier, op3_language_ecoc, op4_secret_crf, op5_chat_parts, op6_simhash_bktree,
    op7_toxicity_trees, op8_best_fit_packing, op9_pivot_topk, op10_greedy_tiling,
    op11_spelling_partenum, op12_url_reputation, op13_golub_kahan_whitening)}

_ESCAPED = "(length({0}) + length({0}) - length(replace(replace(replace({0}, '\\', ''), '<', ''), '#', '')))"
_ROLE = ("(length({0}) + length({0}) - length(replace(replace(replace(replace(replace({0}, '\\', ''), '<', ''), "
         "'#', ''), ':', ''), chr(10), '')))")

_LOWERED = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_HOST = "coalesce(" + _LOWERED.format("regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)") + ", '')"
_PATH = "coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"


def _posterior(name: str, parent: str | None) -> str:
    """Two CTEs: a level's counts around its prior's mean, and the prior's weight beside them."""
    keys = f"{name}, {parent}" if parent else name
    join = f"JOIN {parent}_post USING ({parent})" if parent else "CROSS JOIN top_post"
    return f"""
        {name}_seen AS (
            SELECT {keys}, sum(g.pages) AS pages, sum(g.bad) AS bad FROM hosts g GROUP BY {keys}),
        {name}_prior AS (
            SELECT s.*, (up_weight * up_centre + up_bad - bad) / (up_weight + up_pages - pages) AS centre
            FROM {name}_seen s {join}),
        {name}_fit AS (
            SELECT CASE WHEN coalesce(sum((pages - 1) * centre * (1 - centre)), 0) = 0 THEN {urls.LEAST}
                   ELSE sum((bad - pages * centre) ** 2 / pages - centre * (1 - centre))
                        / sum((pages - 1) * centre * (1 - centre)) END AS r
            FROM {name}_prior WHERE pages > 0),
        {name}_post AS (
            SELECT {name}, centre AS up_centre, 1 / least(greatest(r, {urls.LEAST}), {urls.MOST}) - 1 AS up_weight,
                   pages AS up_pages, bad AS up_bad
            FROM {name}_prior CROSS JOIN {name}_fit)"""


_RULE_CASES = {kind: "CASE " + " ".join(
    f"WHEN ('.' || host) LIKE '%.{rule.host}' AND starts_with(path, '{rule.path}') THEN '{getattr(rule, kind)}'"
    for rule in sorted(URL_RULES, key=lambda r: -len(r.name))) + " END" for kind in ("name", "verdict")}

ORACLES: dict[str, str] = {
    "op5_chat_parts": f"""
        WITH messages AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL
            SELECT -7, n, CASE n WHEN 0 THEN 'user' ELSE 'assistant' END, '{CONTROL_TEXT}' FROM range(2) r(n))
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), ''))
                   AS loss_sha256,
               sum({_ROLE.format('role')} + {_ESCAPED.format('text')}
                   + length('### ') + length(': ') + length(' </turn>') + 1)::BIGINT AS formatted_chars
        FROM messages GROUP BY conv_id""",
    "op9_pivot_topk": """
        WITH vectors AS (
            SELECT vec_id, embedding AS given, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        asking AS (SELECT vec_id, arg_min(v, given) AS v FROM vectors WHERE vec_id % 50 = 0 GROUP BY vec_id),
        scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
            FROM asking q JOIN vectors c ON c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
        ranked AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM scored)
        SELECT query_id, place::INTEGER AS rank, vec_id, score FROM ranked WHERE place <= 5""",
    "op11_spelling_partenum": f"""
        WITH RECURSIVE crc_table AS (
            SELECT list(list_reduce([i, 0, 1, 2, 3, 4, 5, 6, 7], lambda c, k: CASE WHEN c & 1 = 1
                        THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS entries
            FROM (SELECT unnest(range(256)) AS i)),
        seen AS (
            SELECT doc_id, unnest(regexp_extract_all({_LOWERED.format('text')}, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run
            FROM documents),
        runs AS (SELECT doc_id, run, count(*) AS times FROM seen WHERE length(run) >= {spelling.SHORTEST} GROUP BY ALL),
        coded AS (
            SELECT *, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS code FROM runs),
        hashed AS (
            SELECT run, times, xor(4294967295, list_reduce(
                list_prepend(4294967295, list_transform(
                    range(length(code) // 2), lambda i: ('0x' || substr(code, (2 * i + 1)::INT, 2))::BIGINT)),
                lambda c, b: xor(c >> 8, entries[xor(c, b) % 256 + 1]))) AS h
            FROM coded, crc_table),
        damaged AS (
            SELECT times, CASE WHEN h % {spelling.DAMAGE} = 0
                   THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run) + 2)::INT) ELSE run END AS word
            FROM hashed),
        words AS (
            SELECT word, sum(times)::BIGINT AS n FROM damaged WHERE length(word) >= {spelling.SHORTEST}
            GROUP BY word HAVING sum(times) >= {spelling.FEWEST}),
        cuts AS (
            SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest
            FROM (SELECT *, unnest(range(length(word)))::INT AS i FROM words)),
        pairs AS (
            SELECT a.word, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b
            ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
            UNION SELECT c.word, w.word, w.n FROM cuts c JOIN words w ON w.word = c.rest
            UNION SELECT w.word, c.word, c.n FROM cuts c JOIN words w ON w.word = c.rest),
        best AS (
            SELECT word, count(*) AS n_near, max(other_n) AS most, arg_min(other, (-other_n, other)) AS form
            FROM pairs GROUP BY word),
        forms AS (
            SELECT word, CASE WHEN most >= {spelling.RATIO} * n THEN form END AS form, n,
                   coalesce(n_near, 0) AS n_near, CASE WHEN most >= {spelling.RATIO} * n THEN most END AS form_n
            FROM words LEFT JOIN best USING (word)),
        chains AS (
            SELECT word, coalesce(form, word) AS root, form IS NULL AS ended FROM forms
            UNION ALL
            SELECT c.word, coalesce(f.form, f.word), f.form IS NULL FROM chains c JOIN forms f ON f.word = c.root
            WHERE NOT c.ended)
        SELECT word, form, root, n, n_near, form_n FROM forms JOIN chains USING (word) WHERE ended""",
    "op12_url_reputation": f"""
        WITH split AS (SELECT page_id, url, {_HOST} AS host, {_PATH} AS path FROM pages),
        marked AS (
            SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality IS NULL OR toxic IS NULL THEN NULL
                               ELSE 0 END) AS bad
            FROM labels GROUP BY doc_id),
        shown AS (
            SELECT page_id, max(bad) AS bad
            FROM (SELECT page_id, TRY_CAST(regexp_extract(path, '/([0-9]{{1,18}})(?:[/.]|$)', 1) AS BIGINT) AS doc_id
                  FROM split) JOIN marked USING (doc_id)
            WHERE bad IS NOT NULL GROUP BY page_id),
        counted AS (
            SELECT host, count(bad) AS pages, coalesce(sum(bad), 0) AS bad, string_split(host, '.') AS labels
            FROM split LEFT JOIN shown USING (page_id) GROUP BY host),
        hosts AS (
            SELECT host, pages, bad, CASE WHEN address THEN '' ELSE labels[-1] END AS suffix,
                   CASE WHEN address THEN host ELSE array_to_string(labels[-2:], '.') END AS domain
            FROM (SELECT *, regexp_full_match(host, '[0-9]+([.][0-9]+){{3}}(:[0-9]*)?') AS address FROM counted)),
        top_post AS (
            SELECT 0.5::DOUBLE AS up_centre, 1.0::DOUBLE AS up_weight, coalesce(sum(pages), 0) AS up_pages,
                   coalesce(sum(bad), 0) AS up_bad
            FROM hosts),
        {_posterior('suffix', None)},
        {_posterior('domain', 'suffix')},
        {_posterior('host', 'domain')},
        rated AS (
            SELECT host, (up_weight * up_centre + up_bad) / (up_weight + up_pages) AS rate,
                   up_weight + up_pages AS total
            FROM host_post),
        judged AS (
            SELECT page_id, host, path, {_RULE_CASES['name']} AS rule, {_RULE_CASES['verdict']} AS ruled,
                   rate - {urls.Z} * sqrt(rate * (1 - rate) / (total + 1)) AS lower
            FROM split LEFT JOIN rated USING (host))
        SELECT page_id, host, path, rule,
               coalesce(ruled, CASE WHEN lower > {urls.THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict
        FROM judged""",
}
