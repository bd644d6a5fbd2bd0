"""The queries of this subpackage, and the SQL that must give the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialstats.llm import personal_data, secret_scan
from trialstats.llm.bpe import round_trip
from trialstats.llm.conversations import damaged, report
from trialstats.llm.decontaminate import contamination
from trialstats.llm.exact_dedup import exact_groups
from trialstats.llm.line_dedup import repeated_lines
from trialstats.llm.mixing import mixture
from trialstats.llm.passages import repeated_passages
from trialstats.llm.quality import judge
from trialstats.llm.simhash import fingerprint_hex, simhash_groups
from trialstats.llm.url_filter import filtered, host_of, steps_of
from trialstats.llm.whitening import whitened

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_mixing")
def op1(spark, sf_dir):
    return mixture(table(spark, sf_dir, "documents")).drop("text_hash")


@query("op3_quality")
def op3(spark, sf_dir):
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("text_hash")


@query("op4_simhash")
def op4(spark, sf_dir):
    groups = simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


@query(
    "op9_exact_dedup",
    r"""WITH hashed AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = min(doc_id) OVER same AS kept, text_sha256
FROM hashed WINDOW same AS (PARTITION BY text_sha256)""",
)
def op9(spark, sf_dir):
    groups = exact_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


_WORDS = r"""list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"""


@query(
    "op10_decontaminate",
    f"""WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
wins AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS l, array_to_string(list_slice(w, s, s + 12), ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM items WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT l FROM wins),
grams AS (
  SELECT doc_id, l, s, array_to_string(list_slice(w, s, s + l - 1), ' ') AS win
  FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS s FROM docs, lengths WHERE len(w) >= l)),
hits AS (SELECT doc_id, item_id, l, s FROM grams JOIN wins USING (l, win)),
hit_words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + l)) AS p FROM (SELECT DISTINCT doc_id, l, s FROM hits))
  GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)""",
)
def op10(spark, sf_dir):
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


@query("op6_secrets")
def op6(spark, sf_dir):
    return secret_scan.report(secret_scan.secrets(table(spark, sf_dir, "documents")))


@query("op7_personal_data")
def op7(spark, sf_dir):
    return personal_data.report(personal_data.personal_data(table(spark, sf_dir, "documents")))


@query("op11_whitening")
def op11(spark, sf_dir):
    rows = whitened(table(spark, sf_dir, "embeddings"))
    return rows.withColumn("deviation", F.col("deviation").cast("bigint"))


@query("op12_bpe")
def op12(spark, sf_dir):
    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op13_conversations")
def op13(spark, sf_dir):
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return report(conversations, damaged(conversations))


@query("op2_passages")
def op2(spark, sf_dir):
    return repeated_passages(table(spark, sf_dir, "documents"))


@query("op5_line_dedup")
def op5(spark, sf_dir):
    found = repeated_lines(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_lines", F.size("cut").cast("bigint").alias("n_cut"), F.array_join("cut", ",").alias("cut_lines"),
        F.array_join("refs", ",").alias("ref_ids"),
    )


# The first second of 2024 and the seconds of thirty days.
EPOCH, MONTH = 1_704_067_200, 2_592_000


def captures(pages: DataFrame) -> DataFrame:
    """All pages with a time of fetching, which the table lacks: made of their ids, evenly over thirty days."""
    return pages.select("page_id", "url", (F.lit(EPOCH) + F.col("page_id") * 7919 % MONTH).alias("fetched_at"))


def list_entries(pages: DataFrame) -> DataFrame:
    """A dated entry for every page, put on the list or taken off: its domain, its domain or host with a first step, or its host with the whole path."""
    host, steps, n = host_of(F.col("url")), steps_of(F.col("url")), F.col("page_id")
    name = F.when(n % 5 < 2, F.substring_index(host, ".", -3)).otherwise(host)
    taken = F.when(n % 5 == 0, F.slice(steps, 1, 0)).when(n % 5 == 3, steps).otherwise(F.slice(steps, 1, 1))
    key = F.concat(F.concat_ws("/", name, taken), F.when(n % 5 == 4, "/").otherwise(""))
    return pages.select(key.alias("key"), (F.lit(EPOCH) + n * 104729 % MONTH).alias("ts"), (n * 31 % 7 == 0).alias("listed"))


@query(
    "op8_url_filter",
    r"""WITH parts AS (
  SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
    list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)', 1), '/'), lambda x: x <> '') AS steps,
    1704067200 + page_id * 7919 % 2592000 AS fetched_at, 1704067200 + page_id * 104729 % 2592000 AS ts FROM pages),
labels AS (SELECT *, string_split(host, '.') AS l FROM parts),
entries AS (
  SELECT key, ts, max(listed) AS listed FROM (
    SELECT array_to_string(list_concat(
        [CASE WHEN page_id % 5 < 2 THEN array_to_string(l[greatest(len(l) - 2, 1):], '.') ELSE host END],
        CASE page_id % 5 WHEN 0 THEN steps[1:0] WHEN 3 THEN steps ELSE steps[1:1] END), '/') AS key, ts,
      page_id * 31 % 7 = 0 AS listed FROM labels) GROUP BY 1, 2),
periods AS (SELECT key, ts AS valid_from, lead(ts) OVER (PARTITION BY key ORDER BY ts) AS valid_to, listed FROM entries),
domains AS (SELECT page_id, fetched_at, steps, array_to_string(l[i:], '.') AS d FROM (SELECT *, unnest(range(1, greatest(len(l) - 1, 1) + 1)) AS i FROM labels)),
asked AS (
  SELECT DISTINCT page_id, fetched_at, array_to_string(list_concat([d], steps[1:k]), '/') AS key
  FROM (SELECT *, unnest(range(0, len(steps) + 1)) AS k FROM domains)),
active AS (
  SELECT page_id, key, valid_from, valid_to FROM asked JOIN periods USING (key)
  WHERE listed AND valid_from <= fetched_at AND (valid_to IS NULL OR fetched_at < valid_to)),
best AS (
  SELECT page_id, count(*) OVER (PARTITION BY page_id) AS n_listed, key AS rule, valid_from, valid_to FROM active
  QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(key) DESC, key DESC) = 1)
SELECT page_id, host, fetched_at, coalesce(n_listed, 0) AS n_listed, rule, valid_from, valid_to, n_listed IS NOT NULL AS blocked
FROM parts LEFT JOIN best USING (page_id)""",
)
def op8(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return filtered(captures(pages), list_entries(pages)).withColumnRenamed("id", "page_id")
