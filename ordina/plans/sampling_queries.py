"""Queries of sampling, splitting, ordering and dictionaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sampling as P
from .registry import events, query, table

_RANK = "row_number() OVER (ORDER BY md5('{0}:' || {1}), {1})"
_FRACTION = "CAST('0x' || substr(sha256('{0}:' || {1}), 1, 8) AS BIGINT) / 4294967296.0"


@query(f"SELECT doc_id FROM documents WHERE {_FRACTION.format('pick', 'doc_id')} < 0.2")
def keyed_sample(spark, sf):
    return P.bernoulli(table(spark, sf, "documents"), key="doc_id", seed="pick", share=0.2).select("doc_id")


@query(f"SELECT doc_id, ['one', 'two', 'three'][CAST(floor({_FRACTION.format('verses', 'doc_id')} * 3) AS INT) + 1] AS verses FROM documents")
def keyed_choice(spark, sf):
    return table(spark, sf, "documents").select("doc_id", P.categorical(F.col("doc_id"), "verses", ["one", "two", "three"]).alias("verses"))


@query(f"SELECT doc_id FROM documents QUALIFY {_RANK.format('take', 'doc_id')} <= 100")
def exact_sample(spark, sf):
    return P.sample_exact(table(spark, sf, "documents").select("doc_id"), key="doc_id", seed="take", n=100)


_SPLIT = f"WITH p AS (SELECT DISTINCT source FROM documents), r AS (SELECT source, {_RANK.format('split', 'source')} AS n, count(*) OVER () AS c FROM p), t AS (SELECT source, n <= greatest(1, round_even(c * 0.1, 0)) AS is_test FROM r)"


@query(f"{_SPLIT} SELECT doc_id, d.source, is_test FROM documents d JOIN t ON d.source = t.source")
def piece_split(spark, sf):
    return P.split_groups(table(spark, sf, "documents").select("doc_id", "source"), group="source", seed="split")


@query(f"{_SPLIT} SELECT doc_id, d.source, is_test FROM documents d JOIN t ON d.source = t.source WHERE d.source LIKE 'src1%'")
def split_then_filter(spark, sf):
    """The split is made on all pieces and filtered afterwards: the other way round gives another split."""
    return P.split_groups(table(spark, sf, "documents").select("doc_id", "source"), group="source", seed="split").where(F.startswith("source", F.lit("src1")))


@query(f"""WITH a AS (SELECT doc_id FROM documents WHERE lang = 'de'), b AS (SELECT doc_id, {_RANK.format('mix', 'doc_id')} AS n FROM documents WHERE lang = 'en')
SELECT doc_id FROM a UNION ALL SELECT doc_id FROM b WHERE n <= round_even((SELECT count(*) FROM a) * 0.5, 0)""")
def ratio_mix(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return P.ratio_mix(docs.where("lang = 'de'"), docs.where("lang = 'en'"), key="doc_id", seed="mix", ratio=0.5).select("doc_id")


@query("WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS n FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 5000)) SELECT o_orderkey FROM o WHERE n % 7 = 3")
def shard_stride(spark, sf):
    return P.shard(table(spark, sf, "orders").select("o_orderkey"), order=["o_orderkey"], k=3, n=7, limit=5000)


@query("WITH o AS (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS i, count(*) OVER () AS n FROM customer) SELECT c_custkey FROM o WHERE i IN (SELECT CAST(floor(j * (n - 1) / 23.0) AS BIGINT) FROM range(24) t(j))")
def linspace_pick(spark, sf):
    return P.evenly_spaced(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), order=["c_acctbal", "c_custkey"], k=24).select("c_custkey")


@query("SELECT c_custkey, CAST(floor((row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1) / 64) AS BIGINT) AS batch FROM customer")
def width_batches(spark, sf):
    return P.buckets(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), order=["c_acctbal", "c_custkey"], size=64).select("c_custkey", "batch")


@query("SELECT page_id, 'pdmx_' || substr(sha1(url), 1, 10) AS piece FROM pages")
def stable_key(spark, sf):
    return table(spark, sf, "pages").select("page_id", P.stable_key(F.col("url")).alias("piece"))


@query("SELECT name, row_number() OVER (ORDER BY a, b) AS place FROM (SELECT 's' || (s_suppkey % 120) || 'v' || s_suppkey AS name, s_suppkey % 120 AS a, s_suppkey AS b FROM supplier)")
def natural_sort(spark, sf):
    names = table(spark, sf, "supplier").select(F.format_string("s%dv%d", F.col("s_suppkey") % 120, "s_suppkey").alias("name"))
    return P.number_rows(names, order=[P.natural_key(F.col("name"))], name="place").select("name", "place")


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL")
def dedup_first(spark, sf):
    return P.dedup_first(events(spark, sf), by=["user_id", "event_type"], order=["event_id"]).select("user_id", "event_type", "event_id")


_WORDS = "SELECT DISTINCT unnest(string_split(text, ' ')) AS token FROM documents WHERE lang = 'en'"


@query(f"SELECT token, row_number() OVER (ORDER BY encode(token)) AS id FROM ({_WORDS})")
def vocabulary(spark, sf):
    docs = table(spark, sf, "documents").where("lang = 'en'").select(F.split("text", " ").alias("tokens"))
    return P.vocabulary(docs, tokens="tokens")


@query(f"""WITH v AS (SELECT token, row_number() OVER (ORDER BY encode(token)) AS id FROM ({_WORDS})), t AS (SELECT doc_id, unnest(string_split(text, ' ')) AS token FROM documents)
SELECT doc_id, count(*) AS n, count(v.id) AS known, CAST(sum(coalesce(v.id, 1)) AS BIGINT) AS id_sum FROM t LEFT JOIN v ON t.token = v.token GROUP BY doc_id""")
def encode_oov(spark, sf):
    docs = table(spark, sf, "documents")
    vocab = P.vocabulary(docs.where("lang = 'en'").select(F.split("text", " ").alias("tokens")), tokens="tokens")
    rows = docs.select("doc_id", F.explode(F.split("text", " ")).alias("token"))
    coded = P.encode(rows, vocab, token="token", default=1)
    return coded.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if("known").alias("known"), F.sum("id").alias("id_sum"))


@query("SELECT token FROM (SELECT unnest(string_split(text, ' ')) AS token FROM documents WHERE lang = 'fr') EXCEPT SELECT unnest(string_split(text, ' ')) FROM documents WHERE lang = 'en'")
def unseen_tokens(spark, sf):
    docs = table(spark, sf, "documents").select("lang", F.explode(F.split("text", " ")).alias("token"))
    return docs.where("lang = 'fr'").select("token").subtract(docs.where("lang = 'en'").select("token"))


@query(f"SELECT doc_id FROM documents WHERE n_chars > 500 QUALIFY {_RANK.format('build', 'doc_id')} <= 50")
def take_accepted(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    return P.take_accepted(docs, key="doc_id", seed="build", accepted=F.col("n_chars") > 500, n=50).select("doc_id")
