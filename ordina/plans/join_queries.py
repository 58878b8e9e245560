"""Queries of the join and set operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gates
from ..operators import joins as J
from .registry import BY_USER, K_SQL, ORDER, events, query, table, with_k

USER = ["user_id"]


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def semi_join(spark, sf):
    orders = table(spark, sf, "orders").where("o_orderstatus = 'P'")
    return table(spark, sf, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def anti_join(spark, sf):
    orders = table(spark, sf, "orders").where("o_orderstatus = 'P'")
    return table(spark, sf, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("""SELECT c_custkey, CASE WHEN NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000) THEN 'no longer a candidate' END AS reason FROM customer""")
def left_with_reason(spark, sf):
    right = table(spark, sf, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return J.left_with_reason(table(spark, sf, "customer").select("c_custkey"), right, on=["c_custkey"], reason="no longer a candidate")


_STATE = "last_value(CASE WHEN event_type = '{0}' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query(f"SELECT event_id, {_STATE.format('purchase')} AS clef, {_STATE.format('signup')} AS key FROM events")
def asof_strict(spark, sf):
    states = {"clef": F.when(F.col("event_type") == "purchase", F.col("value")), "key": F.when(F.col("event_type") == "signup", F.col("value"))}
    return J.asof_strict(events(spark, sf), keys=USER, order=ORDER, states=states).select("event_id", "clef", "key")


@query("""WITH p AS (SELECT user_id, ts, max(event_id) AS bar FROM events WHERE event_type = 'purchase' GROUP BY ALL)
SELECT e.event_id, p.bar FROM events e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.ts >= p.ts""")
def asof_inclusive(spark, sf):
    rows = events(spark, sf)
    right = rows.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("bar_id"))
    return J.asof_inclusive(rows.select("event_id", "user_id", "ts"), right, keys=USER, left_time="ts", right_time="ts", value="bar_id", name="bar").select("event_id", "bar")


@query("""WITH l AS (SELECT c_custkey % 50 AS k, c_custkey, row_number() OVER (PARTITION BY c_custkey % 50 ORDER BY c_custkey) AS n, count(*) OVER (PARTITION BY c_custkey % 50) AS c FROM customer),
r AS (SELECT c_custkey % 50 AS k, c_name, row_number() OVER (PARTITION BY c_custkey % 50 ORDER BY c_acctbal, c_custkey) AS n, count(*) OVER (PARTITION BY c_custkey % 50) AS c FROM customer WHERE c_custkey > 20)
SELECT l.k, CAST(l.n AS BIGINT) AS n, c_custkey, c_name FROM l JOIN r ON l.k = r.k AND l.n = r.n WHERE l.c = r.c""")
def positional_zip(spark, sf):
    """Customers by number beside customers by balance; keys that lack one on the right are left out whole."""
    rows = table(spark, sf, "customer").withColumn("k", F.col("c_custkey") % 50)
    right = rows.where("c_custkey > 20").select("k", F.col("c_custkey").alias("id"), "c_acctbal", "c_name")
    pairs, _ = J.zip_rows(rows.select("k", "c_custkey"), right, keys=["k"], left_order=["c_custkey"], right_order=["c_acctbal", "id"])
    return pairs.select("k", F.col("n").cast("long").alias("n"), "c_custkey", "c_name")


@query("""WITH l AS (SELECT o_custkey % 150 AS k, count(*) AS n_left FROM orders GROUP BY 1), r AS (SELECT user_id AS k, count(*) AS n_right FROM events GROUP BY 1)
SELECT coalesce(l.k, r.k) AS k, coalesce(n_left, 0) AS n_left, coalesce(n_right, 0) AS n_right FROM l FULL JOIN r ON l.k = r.k WHERE coalesce(n_left, 0) <> coalesce(n_right, 0)""")
def positional_rejects(spark, sf):
    left = table(spark, sf, "orders").select((F.col("o_custkey") % 150).alias("k"), "o_orderkey")
    right = events(spark, sf).select(F.col("user_id").alias("k"), "event_id")
    return J.zip_rows(left, right, keys=["k"], left_order=["o_orderkey"], right_order=["event_id"])[1]


@query(f"""WITH n AS (SELECT event_id, user_id, 10 * event_id AS s, 10 * event_id + {K_SQL} * 40 AS e FROM events),
b AS (SELECT DISTINCT user_id, 10 * event_id AS t FROM events WHERE event_type = 'error'),
c AS (SELECT n.event_id, n.s AS p FROM n UNION ALL SELECT n.event_id, b.t FROM n JOIN b ON n.user_id = b.user_id AND b.t > n.s AND b.t < n.e),
q AS (SELECT event_id, p, row_number() OVER (PARTITION BY event_id ORDER BY p) - 1 AS piece, lead(p) OVER (PARTITION BY event_id ORDER BY p) AS nx FROM c)
SELECT q.event_id, CAST(piece AS INT) AS piece, p AS "start", coalesce(nx, e) AS "end" FROM q JOIN n ON q.event_id = n.event_id""")
def range_split(spark, sf):
    rows = with_k(events(spark, sf))
    notes = rows.select("event_id", "user_id", (10 * F.col("event_id")).alias("start"), (10 * F.col("event_id") + 40 * F.col("k")).alias("end"))
    bars = rows.where("event_type = 'error'").select("user_id", (10 * F.col("event_id")).alias("t"))
    return J.split_at(notes, bars, keys=USER, start="start", end="end", bound="t", width=2000).select("event_id", "piece", "start", "end")


_SPINES = ("click", "purchase", "signup")


@query(f"""WITH x AS (SELECT user_id, date_trunc('hour', ts) AS t, event_type, arg_max(event_id::VARCHAR, event_id) AS tok FROM events GROUP BY ALL)
SELECT user_id, t, {', '.join(f"coalesce(max(tok) FILTER (WHERE event_type = '{s}'), '.') AS {s}" for s in _SPINES)} FROM x
WHERE event_type IN {_SPINES} GROUP BY user_id, t""")
def time_pivot(spark, sf):
    rows = events(spark, sf).select("user_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("t"), "event_type", "event_id", F.col("event_id").cast("string").alias("tok"))
    return J.align_by_time(rows, keys=USER, time="t", spine="event_type", token="tok", order="event_id", spines=_SPINES)


@query(f"""WITH b AS (SELECT user_id, event_id % 2 AS voice, date_trunc('week', ts) AS bar, sum({K_SQL}) AS a, sum(CASE WHEN event_type = 'signup' THEN 0 ELSE {K_SQL} END) AS w, sum(CASE WHEN event_type = 'click' THEN {K_SQL} ELSE 0 END) AS notes FROM events GROUP BY ALL),
l AS (SELECT user_id, voice, row_number() OVER (PARTITION BY user_id, voice ORDER BY bar) AS n, a AS total, notes + CASE WHEN user_id % 5 = 0 AND bar > TIMESTAMP '2024-01-08' THEN 1 ELSE 0 END AS notes FROM b WHERE a <> 0 AND NOT (user_id % 11 = 0 AND voice = 1)),
r AS (SELECT user_id, voice, row_number() OVER (PARTITION BY user_id, voice ORDER BY bar) AS n, w AS total, notes FROM b WHERE w <> 0),
s AS (SELECT b.user_id, voice, user_id % 11 = 0 AND voice = 1 AS gone, (SELECT count(*) FROM l WHERE l.user_id = b.user_id AND l.voice = b.voice) AS nl, (SELECT count(*) FROM r WHERE r.user_id = b.user_id AND r.voice = b.voice) AS nr FROM (SELECT DISTINCT user_id, voice FROM b) b),
c AS (SELECT user_id, voice, max(total) AS cap FROM r GROUP BY ALL),
x AS (SELECT user_id, 0 AS rank, voice, 0 AS n, CASE WHEN gone THEN 'voices' END AS why FROM s UNION ALL SELECT user_id, 1, voice, 0, CASE WHEN nl <> nr THEN 'bar count' END FROM s UNION ALL
SELECT l.user_id, 1, l.voice, l.n, CASE WHEN l.notes <> r.notes THEN 'notes' WHEN l.total <> r.total AND NOT (l.total > r.total AND l.total <= cap) THEN 'total' END FROM l JOIN r ON l.user_id = r.user_id AND l.voice = r.voice AND l.n = r.n JOIN c ON c.user_id = l.user_id AND c.voice = l.voice)
SELECT user_id, arg_min(why, (rank, voice, n)) FILTER (WHERE why IS NOT NULL) AS violation FROM x GROUP BY user_id""")
def parity_check(spark, sf):
    """A reading in which signups lengthen bars, one voice of some users is lost and others have a note too many."""
    k, kind = F.col("k"), F.col("event_type")
    rows = with_k(events(spark, sf)).groupBy("user_id", (F.col("event_id") % 2).alias("voice"), F.date_trunc("week", "ts").alias("bar"))
    bars = rows.agg(F.sum("k").alias("a"), F.sum(F.when(kind == "signup", 0).otherwise(k)).alias("w"), F.sum(F.when(kind == "click", k).otherwise(0)).alias("notes"))
    more = F.when((F.col("user_id") % 5 == 0) & (F.col("bar") > F.lit("2024-01-08").cast("timestamp")), 1).otherwise(0)
    mine = bars.where("not (user_id % 11 = 0 and voice = 1)").select("user_id", "voice", "bar", F.col("a").alias("total"), (F.col("notes") + more).alias("notes"))
    return J.parity(mine, bars.select("user_id", "voice", "bar", F.col("w").alias("total"), "notes"), keys=USER, voice="voice", bar="bar")


@query("""WITH l AS (SELECT user_id, list(event_type ORDER BY event_id) AS a, list(event_type ORDER BY ts, event_id) AS b FROM events WHERE event_id % 3 > 0 OR user_id % 4 > 0 GROUP BY user_id)
SELECT user_id, a = CASE WHEN user_id % 4 = 1 THEN b[2:] ELSE b END AS same FROM l""")
def sequence_equality(spark, sf):
    rows = events(spark, sf).where("event_id % 3 > 0 or user_id % 4 > 0")
    n = F.row_number().over(J.over(USER, ORDER))
    left = rows.select("user_id", F.row_number().over(J.over(USER, ["event_id"])).alias("n"), "event_type")
    right = rows.select("user_id", n.alias("n"), "event_type").where("user_id % 4 <> 1 or n > 1")
    return J.same_sequences(left, right, keys=USER, order=["n"], value=["event_type"])


@query(f"""WITH n AS (SELECT user_id, event_id, event_id AS s, event_id + {K_SQL} AS e FROM events), x AS (SELECT *, lead(s) OVER (PARTITION BY user_id ORDER BY s, event_id) < e AS hit FROM n)
SELECT user_id, count(*) FILTER (WHERE hit) AS n_overlaps, count(*) FILTER (WHERE hit) > 0 AS rejected FROM x GROUP BY user_id""")
def overlap_reject(spark, sf):
    rows = with_k(events(spark, sf)).select("user_id", "event_id", F.col("event_id").alias("start"), (F.col("event_id") + F.col("k")).alias("end"))
    return J.overlaps(rows, keys=USER, start="start", end="end", tie=["event_id"])


@query(f"""WITH x AS (SELECT user_id, event_id, event_id * 100 AS top, event_id * 100 + {K_SQL} AS bottom FROM events)
SELECT event_id, (top - lag(bottom) OVER w) / 2 AS up_limit, (lead(top) OVER w - bottom) / 2 AS down_limit FROM x WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def neighbour_gap(spark, sf):
    rows = with_k(events(spark, sf)).select("user_id", "event_id", (100 * F.col("event_id")).alias("top"), (100 * F.col("event_id") + F.col("k")).alias("bottom"))
    return J.neighbour_limits(rows, keys=USER, order=["event_id"], top="top", bottom="bottom").select("event_id", "up_limit", "down_limit")


@query(f"""WITH d AS (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) - 1 AS i, count(*) OVER () AS n FROM nation), x AS (SELECT event_id, row_number() {BY_USER} - 1 AS k FROM events)
SELECT event_id, n_name AS syllable FROM x JOIN d ON x.k % d.n = d.i""")
def cyclic_lookup(spark, sf):
    return J.cyclic_lookup(events(spark, sf), table(spark, sf, "nation"), keys=USER, order=ORDER, dim_order=["n_nationkey"], dim_value="n_name", name="syllable").select("event_id", "syllable")


@query("SELECT n_nationkey AS k FROM nation UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark, sf):
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("k")).union(table(spark, sf, "supplier").select("s_nationkey")).distinct()


@query("SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def difference(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).subtract(table(spark, sf, "supplier").where("s_acctbal > 5000").select("s_nationkey"))


@query("SELECT count(*) AS n FROM (SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def intersection_size(spark, sf):
    both = table(spark, sf, "orders").select("o_custkey").intersect(table(spark, sf, "customer").where("c_acctbal > 0").select("c_custkey"))
    return both.agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders), b AS (SELECT c_custkey AS k FROM customer),
x AS (SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS only_left, (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS only_right)
SELECT only_left, only_right, only_left = 0 AND only_right = 0 AS same FROM x""")
def set_equality(spark, sf):
    return gates.same_set(table(spark, sf, "orders").select(F.col("o_custkey").alias("k")), table(spark, sf, "customer").select("c_custkey"))


@query("SELECT 'a' AS set_name, count(*) AS n FROM nation UNION ALL SELECT 'b', count(*) FROM region")
def evaluation_sets(spark, sf):
    from ..sources import evaluation_sets as together

    both = together(a=table(spark, sf, "nation").select("n_name"), b=table(spark, sf, "region").select(F.col("r_name").alias("n_name")))
    return both.groupBy("set_name").agg(F.count("*").alias("n"))


@query(f"SELECT event_id, {K_SQL} AS k FROM events WHERE event_type = 'click' AND {K_SQL} BETWEEN 10 AND 20")
def pushed_filter(spark, sf):
    return with_k(events(spark, sf).where("event_type = 'click'")).where(F.col("k").between(10, 20)).select("event_id", "k")


#: Drawn pages handed on at once (280 kB each): a supplier's row is small, so a batch of rows would make GBs of pages.
DRAWN = 16


def draw_pages(batches):
    """Two systems of two or three staves for each ``s_suppkey``."""
    import numpy as np
    import pandas as pd

    for some in (batch[i : i + DRAWN] for batch in batches for i in range(0, len(batch), DRAWN)):
        out = []
        for r in some.itertuples():
            gray, top = np.full((700, 400), 255, np.uint8), 40
            for n in (2, 2 + int(r.s_suppkey) % 2):
                first = top
                for _ in range(n):
                    for line in range(5):
                        gray[top + 10 * line : top + 10 * line + 2, 20:380] = 0
                    top += 100
                gray[first : top - 58, 20:22] = 0
                top += 40
            out.append((int(r.s_suppkey), 700, 400, gray.tobytes()))
        yield pd.DataFrame(out, columns=["page", "height", "width", "gray"])


@query()
def page_detect(spark, sf):
    """Boxes of drawn pages, one a supplier: two systems of two or three staves."""
    from ..operators import vision

    # Keys are dealt before they are drawn, by a number that adaptive execution keeps: it would join partitions so small.
    keys = table(spark, sf, "supplier").select("s_suppkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "s_suppkey")
    return vision.detect_pages(keys.mapInPandas(draw_pages, "page bigint, height int, width int, gray binary"))
