"""Queries of the aggregates and quality gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import metrics, numbers
from ..operators import aggregates as A
from ..operators import gates
from ..sources import writers
from .registry import K_SQL, ORDER, events, query, table, with_k

#: Systems of a piece: the lines of an order, by customer.
_SIZES = "WITH z AS (SELECT o_custkey, o_orderkey, count(*) AS size FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL), c AS (SELECT o_custkey, size, count(*) AS n FROM z GROUP BY ALL)"


def _sizes(spark, sf):
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("size"))
    return lines.join(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")


@query(f"{_SIZES} SELECT o_custkey, size AS mode FROM c QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, size) = 1")
def mode_small(spark, sf):
    return A.mode(_sizes(spark, sf), keys=["o_custkey"], value="size", tie="smaller").select("o_custkey", "mode")


@query(f"{_SIZES} SELECT o_custkey, size AS mode FROM c QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, size DESC) = 1")
def mode_large(spark, sf):
    return A.mode(_sizes(spark, sf), keys=["o_custkey"], value="size", tie="larger").select("o_custkey", "mode")


_SHARE = f"{_SIZES}, m AS (SELECT o_custkey, size AS mode, n / sum(n) OVER (PARTITION BY o_custkey) AS share FROM c QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, size DESC) = 1)"


@query(f"{_SHARE} SELECT * FROM m")
def mode_share(spark, sf):
    return A.mode(_sizes(spark, sf), keys=["o_custkey"], value="size", tie="larger")


@query(f"""{_SHARE}, f AS (SELECT m.o_custkey, mode, share, count(*) FILTER (WHERE size < mode) AS few FROM m JOIN z ON m.o_custkey = z.o_custkey GROUP BY ALL),
v AS (SELECT c_custkey AS o_custkey, mode, coalesce(share, 0) AS share, few, CASE WHEN mode IS NULL THEN 'leer' WHEN mode = 2 AND share >= 0.6 THEN 'closed score' WHEN share < 0.6 THEN 'wechselndes Satzbild' WHEN few > 0 THEN 'verdaechtig' ELSE 'konsistent' END AS verdict
  FROM customer LEFT JOIN f ON c_custkey = f.o_custkey)
SELECT o_custkey, mode, share, verdict, CASE WHEN verdict = 'verdaechtig' THEN few ELSE 0 END AS n_suspects FROM v""")
def consistency_verdict(spark, sf):
    pieces = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"))
    out = A.consistency(_sizes(spark, sf), keys=["o_custkey"], index="o_orderkey", size="size", pieces=pieces)
    return out.select("o_custkey", "mode", "share", "verdict", F.coalesce(F.size("suspects"), F.lit(0)).cast("long").alias("n_suspects"))


@query("""WITH p AS (SELECT user_id, median(CASE WHEN event_id % 4 = 0 THEN 0.80 ELSE 0.95 END + (user_id % 10) / 100.0) AS white, median(value / 100) AS run FROM events GROUP BY user_id),
s AS (SELECT o_custkey AS user_id, CAST(o_orderkey % 3 + 1 AS INT) AS staves, count(*) AS n FROM orders GROUP BY ALL),
m AS (SELECT user_id, staves FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, staves) = 1),
j AS (SELECT p.user_id, CAST(white AS DOUBLE) AS white, run, coalesce(staves, 0) AS modal_staves, white <= 0.875318 OR run <= 0.385546 AS scan_suspected FROM p LEFT JOIN m ON p.user_id = m.user_id),
r AS (SELECT *, CASE WHEN modal_staves = 0 THEN 'no-staves-found' WHEN NOT scan_suspected AND modal_staves = 2 THEN 'closed-score-suspected' END AS reason FROM j)
SELECT user_id, round(white, 6) AS white, round(run, 6) AS run, modal_staves, scan_suspected, reason, reason IS NOT NULL AS rejected FROM r""")
def scan_decision(spark, sf):
    white = F.when(F.col("event_id") % 4 == 0, 0.80).otherwise(0.95) + F.col("user_id") % 10 / F.lit(100.0)
    pages = events(spark, sf).select("user_id", white.alias("white_frac"), (F.col("value") / 100).alias("run_frac"))
    systems = table(spark, sf, "orders").select(F.col("o_custkey").alias("user_id"), (F.col("o_orderkey") % 3 + 1).cast("int").alias("staves"))
    return A.scan_decision(pages, systems, keys=["user_id"]).withColumns({"white": F.round("white", 6), "run": F.round("run", 6)})


@query("SELECT l_returnflag, l_linestatus, CAST(coalesce(median(l_quantity), 0) AS DOUBLE) AS median FROM lineitem GROUP BY ALL")
def medians(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(A.median_or_zero("l_quantity").alias("median"))


@query("SELECT l_suppkey, list_sort(list(l_quantity))[len(list(l_quantity)) // 2 + 1] AS upper_median FROM lineitem GROUP BY l_suppkey")
def upper_median(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(A.upper_median("l_quantity").alias("upper_median"))


@query("SELECT l_returnflag, quantile_cont(l_quantity, 0.5) AS p50, quantile_cont(l_quantity, 0.9) AS p90, quantile_cont(l_quantity, 0.99) AS p99 FROM lineitem GROUP BY l_returnflag")
def percentiles(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(*A.percentiles("l_quantity", (0.5, 0.9, 0.99)))


@query("""SELECT l_returnflag, count(*) AS n, min(l_quantity) AS low, max(l_quantity) AS high, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total, count(DISTINCT l_suppkey) AS suppliers,
count(*) FILTER (WHERE l_discount > 0.05) AS discounted, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY l_returnflag""")
def plain_aggregates(spark, sf):
    q = F.col("l_quantity")
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        F.count("*").alias("n"), F.min(q).alias("low"), F.max(q).alias("high"), F.sum(q.cast("long")).alias("total"), F.count_distinct("l_suppkey").alias("suppliers"),
        F.count_if(F.col("l_discount") > 0.05).alias("discounted"), F.round(F.avg(q), 6).alias("mean"),
    )


@query("""SELECT coalesce(event_type, 'all') AS stratum, count(*) AS n, round(avg(CAST(json_extract_string(props, '$.k') AS BIGINT) / 7), 6) AS mean FROM events GROUP BY ROLLUP (event_type)""")
def rollup_strata(spark, sf):
    return A.strata(with_k(events(spark, sf)).withColumn("ser", F.col("k") / 7), stratum="event_type", value="ser")


@query(f"SELECT round(sum({K_SQL} * user_id) / sum(user_id), 6) AS loss FROM events")
def weighted_mean(spark, sf):
    return with_k(events(spark, sf)).agg(F.round(F.sum(F.col("k") * F.col("user_id")) / F.sum("user_id"), 6).alias("loss"))


@query("SELECT l_orderkey, min(l_partkey) AS x, min(l_suppkey) AS y, max(l_partkey + CAST(l_quantity AS BIGINT)) - min(l_partkey) AS w, max(l_suppkey + l_linenumber) - min(l_suppkey) AS h FROM lineitem GROUP BY l_orderkey")
def bbox_union(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_partkey").alias("px"), F.col("l_suppkey").alias("py"), F.col("l_quantity").cast("long").alias("pw"), F.col("l_linenumber").cast("long").alias("ph"))
    return A.bounding_box(rows, keys=["l_orderkey"], x="px", y="py", w="pw", h="ph")


@query("SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey ORDER BY n DESC, l_partkey LIMIT 25")
def top_n_common(spark, sf):
    return A.top_n(table(spark, sf, "lineitem"), value="l_partkey", n=25)


@query("SELECT user_id, max(value) AS best, max(event_id) + 1 AS height FROM events GROUP BY user_id")
def max_per_key(spark, sf):
    return events(spark, sf).groupBy("user_id").agg(F.max("value").alias("best"), (F.max("event_id") + 1).alias("height"))


@query("SELECT n_regionkey, sha256(string_agg(n_name, chr(10) ORDER BY n_name)) AS digest FROM nation GROUP BY n_regionkey")
def set_digest(spark, sf):
    return A.set_digest(table(spark, sf, "nation"), keys=["n_regionkey"], name="n_name")


@query("SELECT 'v' || l_linenumber || '->F' || (l_suppkey % 5) AS pair, count(*) AS n FROM lineitem GROUP BY ALL")
def crosstab(spark, sf):
    return A.crosstab(table(spark, sf, "lineitem").withColumn("f", F.col("l_suppkey") % 5), a="l_linenumber", b="f")


@query("""SELECT d.doc_id, CAST(len(list_filter(list_zip(string_split(d.text, ' ')[1:n], string_split(e.text, ' ')[1:n]), lambda x: x[1] = x[2])) AS BIGINT) AS matches
FROM (SELECT d.doc_id, d.text, least(len(string_split(d.text, ' ')), len(string_split(e.text, ' '))) AS n FROM documents d JOIN documents e ON e.doc_id = d.doc_id + 1) d JOIN documents e ON e.doc_id = d.doc_id + 1""")
def position_matches(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.split("text", " ").alias("a"))
    following = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b"))
    return docs.join(following, "doc_id").select("doc_id", A.position_matches("a", "b").alias("matches"))


@query("SELECT vec_id, list_position(embedding, list_max(embedding)) - 1 AS at, round_even(1 / list_sum(list_transform(embedding, lambda x: exp(x::DOUBLE - list_max(embedding)::DOUBLE))), 4) AS confidence FROM embeddings")
def argmax_confidence(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", numbers.argmax("embedding").alias("at"), F.bround(numbers.best_probability(F.col("embedding")), 4).alias("confidence"))


@query("""SELECT vec_id, count(*) FILTER (WHERE v < 0.1) AS ink, round(CAST(count(*) FILTER (WHERE v >= 0.2) AS DOUBLE) / count(*), 6) AS white, sum(CAST(floor(greatest(0, least(1, v)) * 255 + 0.5) AS BIGINT))::BIGINT AS stored
FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY vec_id""")
def pixel_statistics(spark, sf):
    px = F.transform("embedding", lambda v: v.cast("double"))
    rows = table(spark, sf, "embeddings").withColumn("px", px)
    return rows.select(
        "vec_id",
        F.size(F.filter("px", lambda v: numbers.is_ink(v, 0.1))).cast("long").alias("ink"),
        F.round(F.size(F.filter("px", lambda v: v >= 0.2)) / F.size("px"), 6).alias("white"),
        F.aggregate("px", F.lit(0).cast("long"), lambda s, v: s + numbers.to_byte(v)).alias("stored"),
    )


@query("""SELECT doc_id, CAST(len(w) + len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS BIGINT) AS frames FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)""")
def ctc_min_frames(spark, sf):
    return table(spark, sf, "documents").select("doc_id", numbers.ctc_min_frames(F.split("text", " ")).alias("frames"))


def _lines(spark, sf):
    """A reference and a hypothesis of ASCII letters for each user and day: all events, and those of even k."""
    letter = F.substring("event_type", 1, 1)
    rows = with_k(events(spark, sf)).withColumn("day", F.date_trunc("week", "ts").cast("timestamp_ntz"))
    ordered = F.array_sort(F.collect_list(F.struct(*ORDER, letter.alias("x"), (F.col("k") % 5 > 0).alias("kept"))))
    lines = rows.groupBy("user_id", "day").agg(ordered.alias("r"))
    return lines.select("user_id", "day", F.transform("r", lambda x: x["x"]).alias("reference"), F.transform(F.filter("r", lambda x: x["kept"]), lambda x: x["x"]).alias("hypothesis"))


@query(f"""WITH l AS (SELECT user_id, date_trunc('week', ts) AS day, string_agg(event_type[1], '' ORDER BY ts, event_id) AS r, coalesce(string_agg(event_type[1], '' ORDER BY ts, event_id) FILTER (WHERE {K_SQL} % 5 > 0), '') AS h FROM events GROUP BY ALL)
SELECT user_id, CAST(day AS TIMESTAMP) AS day, round(levenshtein(r, h) / length(r), 6) AS ser FROM l""")
def ser(spark, sf):
    lines = _lines(spark, sf)
    return lines.select("user_id", "day", F.round(metrics.token_error_rate(F.col("reference"), F.col("hypothesis")), 6).alias("ser"))


@query()
def edit_script(spark, sf):
    lines = _lines(spark, sf).select("user_id", F.explode(metrics.edit_script("reference", "hypothesis")).alias("e"))
    return lines.groupBy("user_id", F.col("e.op").alias("op")).agg(F.count("*").alias("n"))


_CHECKS = "CASE WHEN n_chars < 300 THEN 'short' WHEN lang <> 'en' THEN 'language' WHEN n_chars > 6000 THEN 'long' END"


def _checked(spark, sf):
    checks = [(F.col("n_chars") < 300, "short -- few characters"), (F.col("lang") != "en", "language"), (F.col("n_chars") > 6000, "long -- many characters")]
    out = gates.with_reason(table(spark, sf, "documents"), checks)
    return out.withColumn("reject_reason", gates.normal_reason(F.col("reject_reason"), 60))


@query(f"SELECT doc_id, {_CHECKS} AS reject_reason FROM documents")
def reject_reasons(spark, sf):
    return _checked(spark, sf).select("doc_id", "reject_reason")


@query(f"SELECT {_CHECKS} AS reject_reason, count(*) AS n FROM documents WHERE {_CHECKS} IS NOT NULL GROUP BY 1")
def reason_counts(spark, sf):
    return gates.reason_counts(_checked(spark, sf))


@query(f"SELECT count(*) AS examined, count(*) FILTER (WHERE {_CHECKS} IS NULL) AS accepted, count(*) FILTER (WHERE {_CHECKS} IS NOT NULL) AS rejected FROM documents")
def funnel(spark, sf):
    return gates.funnel(_checked(spark, sf))


@query("SELECT l_orderkey, min(l_linenumber) = 0 AND max(l_linenumber) = count(*) - 1 AND count(DISTINCT l_linenumber) = count(*) AS contiguous FROM lineitem GROUP BY l_orderkey")
def contiguous_ids(spark, sf):
    return gates.contiguous(table(spark, sf, "lineitem"), keys=["l_orderkey"], number="l_linenumber")


@query("SELECT doc_id, CASE WHEN n_chars > 8000 THEN 'too_wide' WHEN n_chars // 4 < CAST(len(w) + len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS BIGINT) THEN 'target_longer_than_frames' ELSE 'ok' END AS kind FROM (SELECT doc_id, n_chars, string_split(text, ' ') AS w FROM documents)")
def sample_kinds(spark, sf):
    from ..sources import sample_kinds as kinds

    rows = table(spark, sf, "documents").select("doc_id", F.col("n_chars").alias("width"), F.split("text", " ").alias("tokens"))
    return kinds(rows, most_width=8000).select("doc_id", "kind")


@query("""SELECT doc_id, source AS piece, n_chars * 128 AS size, CAST(coalesce(sum(n_chars * 128) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM documents""")
def pack_offsets(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.col("source").alias("piece"), (F.col("n_chars") * 128).alias("size"))
    return writers.with_offsets(rows, size="size", order=["doc_id"])


@query("""WITH b AS (SELECT user_id, CAST(count(*) AS BIGINT) AS lines FROM events GROUP BY 1)
SELECT 'pool' AS name, count(*) AS pieces, CAST(sum(lines) AS BIGINT) AS lines, count(*) FILTER (WHERE user_id % 10 < 3) AS chor FROM b""")
def pool_sizes(spark, sf):
    lines = events(spark, sf).groupBy("user_id").agg(F.count("*").alias("lines"))
    return lines.agg(F.count("*").alias("pieces"), F.sum("lines").alias("lines"), F.count_if(F.col("user_id") % 10 < 3).alias("chor")).select(F.lit("pool").alias("name"), "pieces", "lines", "chor")


@query("""WITH p AS (SELECT count(*) FILTER (WHERE user_id % 10 < 3) AS n_first, count(*) FILTER (WHERE user_id % 10 >= 3) AS n_other FROM events)
SELECT n_first, n_other, CAST(n_first + least(round_even(n_first * 1.5, 0), n_other) AS BIGINT) AS epoch FROM p""")
def epoch_size(spark, sf):
    from ..operators.sampling import epoch_size as size

    return size(events(spark, sf), first=F.col("user_id") % 10 < 3, ratio=1.5)
