"""Queries of the sequence operators over the event stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import score
from ..operators import sequence as S
from .registry import BY_USER, K_SQL, ORDER, events, query, table, with_k

USER = ["user_id"]


@query(f"""WITH x AS (SELECT user_id, event_type, lag(event_type) {BY_USER} AS p FROM events)
SELECT user_id, count(*) AS n FROM x WHERE event_type <> 'view' AND (p IS NULL OR p <> event_type) GROUP BY user_id""")
def ctc_collapse(spark, sf):
    out = S.collapse(events(spark, sf), keys=USER, order=ORDER, symbol="event_type", blank="view")
    return out.groupBy("user_id").agg(F.count("*").alias("n"))


@query(f"""WITH x AS (SELECT user_id, event_type, lag(event_type) {BY_USER} AS p FROM events)
SELECT user_id, count(*) AS n FROM x WHERE NOT (event_type = 'error' AND coalesce(p = 'error', false)) GROUP BY user_id""")
def collapse_symbol(spark, sf):
    out = S.collapse_symbol(events(spark, sf), keys=USER, order=ORDER, symbol="event_type", value="error")
    return out.groupBy("user_id").agg(F.count("*").alias("n"))


@query(f"""WITH x AS (SELECT *, row_number() {BY_USER} - 1 AS f, CASE WHEN lag(event_type) {BY_USER} IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS c FROM events),
r AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM x)
SELECT user_id, CAST(run AS BIGINT) AS run, event_type, CAST(min(f) AS BIGINT) AS f0, CAST(max(f) AS BIGINT) AS f1, round_even(avg(value), 4) AS confidence
FROM r WHERE event_type <> 'view' GROUP BY user_id, run, event_type""")
def decode_spans(spark, sf):
    return S.decode_spans(events(spark, sf), keys=USER, order=ORDER, symbol="event_type", blank="view", weight="value")


_RUNS = f"""WITH x AS (SELECT *, CASE WHEN lag(event_type) {BY_USER} IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS c FROM events),
r AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM x),
i AS (SELECT user_id, run, event_type, count(*) AS length FROM r GROUP BY ALL)"""


@query(f"{_RUNS} SELECT user_id, CAST(run AS BIGINT) AS run, event_type, length FROM i")
def islands(spark, sf):
    return S.islands(events(spark, sf), keys=USER, order=ORDER, by="event_type")


@query(f"{_RUNS} SELECT user_id, event_type, max(length) AS longest FROM i GROUP BY ALL")
def longest_run(spark, sf):
    return S.longest_run(events(spark, sf), keys=USER, order=ORDER, by="event_type")


_RECORDS = """WITH r AS (SELECT *, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS record FROM events)"""


@query(f"{_RECORDS} SELECT user_id, record, count(*) AS n, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END)::BIGINT AS clicks FROM r WHERE event_type <> 'error' GROUP BY ALL")
def records_by_separator(spark, sf):
    out = S.segment(events(spark, sf), keys=USER, order=ORDER, symbol="event_type", separator="error")
    return out.groupBy("user_id", "record").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "click").alias("clicks"))


@query(f"""{_RECORDS}, s AS (SELECT user_id, record AS bar, CAST(sum({K_SQL}) AS BIGINT) AS total, CAST(sum(CASE WHEN event_type = 'click' THEN {K_SQL} ELSE 0 END) AS BIGINT) AS notes
FROM r WHERE event_type <> 'error' GROUP BY ALL) SELECT * FROM s WHERE total <> 0""")
def bar_sums(spark, sf):
    return S.bar_sums(with_k(events(spark, sf)), keys=USER, order=ORDER, symbol="event_type", barline="error", ticks=F.col("k"), is_note=F.col("event_type") == "click")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
CAST(coalesce(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM lineitem""")
def running_offset(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").withColumn("_size", F.col("l_quantity").cast("long"))
    return S.running_offset(rows, keys=["l_orderkey"], order=["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"], size="_size").drop("_size")


@query("""SELECT event_id, min(value) OVER w AS best, (min(value) OVER b IS NULL OR value < min(value) OVER b) AS improved FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def running_best(spark, sf):
    return S.running_best(events(spark, sf), keys=USER, order=ORDER, value="value").select("event_id", "best", "improved")


@query(f"""WITH x AS (SELECT *, row_number() {BY_USER} AS n, CASE WHEN event_type = 'purchase' THEN value END AS clef, CASE WHEN event_type = 'signup' THEN {K_SQL} END AS key FROM events)
SELECT user_id, arg_min(clef, n) FILTER (WHERE clef IS NOT NULL) AS clef, arg_min(key, n) FILTER (WHERE key IS NOT NULL) AS key FROM x GROUP BY user_id""")
def first_non_null(spark, sf):
    rows = with_k(events(spark, sf)).withColumns({"clef": F.when(F.col("event_type") == "purchase", F.col("value")), "key": F.when(F.col("event_type") == "signup", F.col("k"))})
    return S.first_non_null(rows, keys=USER, order=ORDER, columns=["clef", "key"])


@query(f"""WITH x AS (SELECT *, coalesce(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c,
row_number() {BY_USER} AS n FROM events),
m AS (SELECT user_id, c, count(*) FILTER (WHERE event_type <> 'error') AS events, arg_min(event_id, n) FILTER (WHERE event_type <> 'error') AS opened_by, bool_or(event_type = 'error') AS closed FROM x GROUP BY user_id, c)
SELECT user_id, events, opened_by, closed, CAST(row_number() OVER (PARTITION BY user_id ORDER BY c) - 1 AS BIGINT) AS measure FROM m WHERE events > 0""")
def measure_assembly(spark, sf):
    return S.assemble_measures(events(spark, sf), keys=USER, order=ORDER, symbol="event_type", barline="error", opener="event_id")


@query(f"""WITH x AS (SELECT *, {K_SQL} AS k FROM events),
y AS (SELECT *, row_number() OVER w AS n, count(*) OVER (PARTITION BY user_id, event_type) AS s FROM x WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id))
SELECT event_id, CASE WHEN s = 1 THEN '' WHEN n = 1 THEN '[' WHEN n = s THEN ']' ELSE '_' END AS mark FROM y""")
def tie_marks(spark, sf):
    return S.edge_marks(events(spark, sf), keys=["user_id", "event_type"], order=ORDER).select("event_id", "mark")


@query(f"""WITH x AS (SELECT *, {K_SQL} AS k, {K_SQL} % 3 > 0 AS b, date_trunc('day', ts) AS g FROM events),
y AS (SELECT *, CASE WHEN lag(b) {BY_USER} IS NOT DISTINCT FROM b AND lag(g) {BY_USER} IS NOT DISTINCT FROM g AND lag(event_id) {BY_USER} IS NOT NULL THEN 0 ELSE 1 END AS c FROM x),
z AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS r FROM y),
v AS (SELECT *, row_number() OVER (PARTITION BY user_id, r ORDER BY ts, event_id) AS n, count(*) OVER (PARTITION BY user_id, r) AS s FROM z)
SELECT event_id, CASE WHEN NOT b OR s < 2 THEN '' WHEN n = 1 THEN 'L' WHEN n = s THEN 'J' ELSE '' END AS beam FROM v""")
def beam_runs(spark, sf):
    rows = with_k(events(spark, sf)).withColumn("day", F.date_trunc("day", "ts"))
    return S.beam_marks(rows, keys=USER, order=ORDER, group=["day"], beamable=F.col("k") % 3 > 0).select("event_id", "beam")


@query(f"""WITH x AS (SELECT user_id, 100 * row_number() {BY_USER} AS s, 100 * row_number() {BY_USER} + {K_SQL} AS e FROM events),
k AS (SELECT * FROM x WHERE s >= 200), g AS (SELECT user_id, coalesce(lag(e) OVER (PARTITION BY user_id ORDER BY s), 200) AS b, s FROM k),
t AS (SELECT user_id, max(e) AS b FROM k GROUP BY user_id)
SELECT user_id, s AS "start", e AS "end", false AS is_rest FROM k UNION ALL SELECT user_id, b, s, true FROM g WHERE s > b UNION ALL SELECT user_id, b, 20000, true FROM t WHERE b < 20000""")
def gap_fill(spark, sf):
    n = F.row_number().over(S.over(USER, ORDER)).cast("long")
    rows = with_k(events(spark, sf)).select("user_id", (100 * n).alias("start"), (100 * n + F.col("k")).alias("end"))
    return S.fill_gaps(rows, keys=USER, start="start", end="end", origin=200, until=20000)


@query(f"""WITH x AS (SELECT user_id, row_number() {BY_USER} AS line, event_type, count(*) OVER (PARTITION BY user_id) AS last FROM events)
SELECT user_id, line AS "start", coalesce(lead(line) OVER (PARTITION BY user_id ORDER BY line) - 1, last) AS "end" FROM x WHERE event_type = 'signup'""")
def line_ranges(spark, sf):
    rows = events(spark, sf).withColumns({"start": F.row_number().over(S.over(USER, ORDER)).cast("long"), "last": F.count("*").over(S.Window.partitionBy("user_id"))})
    return S.line_ranges(rows.where("event_type = 'signup'"), keys=USER, order=["start"], start="start", end_of_all="last").select("user_id", "start", "end")


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id) = 1 AS is_first FROM events")
def first_of_group(spark, sf):
    rows = events(spark, sf).withColumn("day", F.date_trunc("day", "ts"))
    return S.first_of_group(rows, keys=["user_id", "day"], order=ORDER).select("event_id", "is_first")


@query(f"""WITH x AS (SELECT user_id, {K_SQL} AS k, row_number() OVER (PARTITION BY user_id ORDER BY {K_SQL} DESC, event_id) AS n FROM events)
SELECT user_id, avg(k) AS top_mean FROM x WHERE n <= 20 GROUP BY user_id""")
def top_rows_mean(spark, sf):
    return S.top_rows_mean(with_k(events(spark, sf)), keys=USER, rank_by=[F.desc("k"), "event_id"], value="k", n=20)


def _token_lines(spark, sf):
    """Each user's events as a line of score tokens."""
    n = F.row_number().over(S.over(USER, ORDER))
    token = F.element_at(F.array(*map(F.lit, ["=", "=||", "<b>", "4", "c", "r", "==", "*clefG2", "<b>", "8.", "<b>", "f#"])), (F.col("k") % 12 + 1).cast("int"))
    event = F.struct(token.alias("token"), F.col("n").alias("f0"), F.col("n").alias("f1"), (F.col("k") / 100).alias("confidence"))
    rows = with_k(events(spark, sf)).withColumn("n", n)
    return rows.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", event.alias("e")))), lambda x: x["e"]).alias("events"))


@query()
def barline_collapse(spark, sf):
    lines = _token_lines(spark, sf).withColumn("records", score.records_of(F.col("events")))
    done = lines.select("user_id", F.size("records").alias("before"), score.collapse_barlines("records").alias("r"))
    return done.select("user_id", "before", F.size("r").alias("after"))


@query()
def line_classify(spark, sf):
    done = score.line_elements(_token_lines(spark, sf))
    return done.select("user_id", F.explode("elements").alias("e")).groupBy("user_id", F.col("e.kind").alias("kind")).agg(F.count("*").alias("n"))


@query()
def score_documents(spark, sf):
    lines = score.line_elements(_token_lines(spark, sf)).select(
        (F.col("user_id") % 10).alias("score"), F.lit(0).alias("page"), F.floor(F.col("user_id") / 40).cast("int").alias("system"), F.floor(F.col("user_id") / 10 % 4).cast("int").alias("staff"), (F.col("user_id") % 7 == 0).alias("truncated"), "elements"
    )
    return score.to_documents(score.assemble(lines))
