"""Secret scans with multipart credential linking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialise

#: Fixed patterns of the base scan, by kind, and the least length of what must be found.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex")
LEAST = {"assign": 12, "access": 18, "hex": 16}
#: Weak parts: too short or too common to be reported alone. Values are as in ASSIGN but shorter.
WEAK_SECRET = 6
WEAK_ACCESS = r"(?:AKIA|ASIA|ABIA|ACCA)[A-Z0-9]{8,}"
ENDPOINT = r"(?:https?|wss?|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|redis|mongodb|amqp)://[A-Za-z0-9._~:@/-]+"
#: Which other parts must stand beside a weak part for it to be reported.
PARTNERS = {"weak_access": ("secret",), "weak_secret": ("access", "endpoint"), "endpoint": ("secret",)}


#: Matches that are folded at a time: a text's matches are walked in two levels, so that no long array is copied for each.
CHUNK = 64


def _steps(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as structs of the gap's length before them and the match.

    Splitting by the pattern gives the gaps, extracting gives the matches.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    return F.transform(F.filter(F.arrays_zip(found.alias("hit"), gaps.alias("gap")), lambda x: x["hit"].isNotNull()), lambda x: F.struct(F.length(x["gap"]).alias("gap"), x["hit"].alias("hit")))


def _matches(steps: str) -> Column:
    """Structs start, end (code points), hit of the matches in a column of :func:`_steps`: running lengths give the places."""
    span = "struct<start:int,end:int,hit:string>"
    none = F.expr(f"cast(array() as array<{span}>)")
    chunks = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(steps) - 1) / CHUNK), F.lit(0)).cast("int")), lambda c: F.slice(steps, c * CHUNK + 1, F.lit(CHUNK)))

    def add(state: Column, x: Column) -> Column:
        begin = state["at"] + x["gap"]
        end = begin + F.length(x["hit"])
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(F.struct(begin.alias("start"), end.alias("end"), x["hit"].alias("hit")))).alias("out"))

    def add_chunk(state: Column, chunk: Column) -> Column:
        spans = F.aggregate(chunk, F.struct(state["at"].alias("at"), none.alias("out")), add, lambda s: s["out"])
        length = F.aggregate(chunk, F.lit(0), lambda n, x: n + x["gap"] + F.length(x["hit"]))
        return F.struct((state["at"] + length).alias("at"), F.concat(state["out"], F.array(spans)).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<array<{span}>>)").alias("out"))
    return F.flatten(F.aggregate(chunks, zero, add_chunk, lambda s: s["out"]))


def _guarded(text: Column, pattern: str, if_any: list[Column]) -> Column:
    """The pattern's steps, looked for only in texts with one of the strings without which it cannot match."""
    some = if_any[0]
    for x in if_any[1:]:
        some = some | x
    return F.when(some, _steps(text, pattern)).otherwise(F.expr("cast(array() as array<struct<gap:int,hit:string>>)"))


def _value(hit: Column) -> Column:
    return F.regexp_extract(hit, ASSIGN, 2)


def _spans(parts: Column, kind: str, test) -> Column:
    kept = F.filter(parts, test)
    return F.transform(kept, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(kind).alias("kind")))


def _joined(spans: Column) -> Column:
    """kind:start:end by start, then kind in the listed order, joined by commas."""
    order = {k: i for i, k in enumerate((*KINDS, *PARTNERS))}

    def rank_of(kind: Column) -> Column:
        out = F.lit(len(order))
        for k, i in order.items():
            out = F.when(kind == k, i).otherwise(out)
        return out

    keyed = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), rank_of(x["kind"]).alias("rank"), x["end"].alias("end"), x["kind"].alias("kind"))))
    return F.array_join(F.transform(keyed, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", scope: int = 400) -> DataFrame:
    """Find secrets in every text: id, ``n_assign, n_access, n_hex, base_sha256, spans, n_linked, linked``.

    Strong parts are the base findings: assignments, access identifiers and hex strings of the fixed least lengths.
    Weak parts (short values, short identifiers, endpoints) are reported only if a complementary part stands within
    ``scope`` code points: identifiers need a secret beside them, short values an identifier or an endpoint, endpoints
    a secret. ``linked`` holds the spans so added, ``spans`` those and the base ones as kind:start:end.

    The link is an interval join on cells of ``scope`` code points. The nearest part before and after is all that
    matters, so each cell holds one smallest start and one largest end a kind, and each weak part meets three cells:
    no pairs of parts are made, whatever a text holds. Texts are scanned once; only parts are shuffled.

    Null or empty text: no parts. A null id or rows that repeat are scanned each and keep their row. An empty table
    gives an empty result; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_text")).select(
        "_id",
        _guarded(F.col("_text"), ASSIGN, [F.contains(F.lower("_text"), F.lit(x)) for x in ("password", "passwd", "secret", "token", "apikey", "api_key")]).alias("assign"),
        _guarded(F.col("_text"), ACCESS, [F.contains("_text", F.lit("AKIA"))]).alias("access"),
        _guarded(F.col("_text"), WEAK_ACCESS, [F.contains("_text", F.lit(x)) for x in ("AKIA", "ASIA", "ABIA", "ACCA")]).alias("ids"),
        _steps(F.col("_text"), HEX).alias("hex"),
        _guarded(F.col("_text"), ENDPOINT, [F.contains("_text", F.lit("://"))]).alias("endpoint"),
        F.sha2("_text", 256).alias("_digest"),
    )
    rows = rows.withColumns({c: _matches(c) for c in ("assign", "access", "ids", "hex", "endpoint")})
    base = F.concat(
        _spans(F.col("assign"), "assign", lambda x: F.length(_value(x["hit"])) >= LEAST["assign"]),
        _spans(F.col("access"), "access", lambda x: F.length(x["hit"]) >= LEAST["access"]),
        _spans(F.col("hex"), "hex", lambda x: F.length(x["hit"]) >= LEAST["hex"]),
    )
    short = _spans(F.col("assign"), "weak_secret", lambda x: (F.length(_value(x["hit"])) >= WEAK_SECRET) & (F.length(_value(x["hit"])) < LEAST["assign"]))
    ids = _spans(F.col("ids"), "weak_access", lambda x: (F.length(x["hit"]) < LEAST["access"]) | ~F.startswith(x["hit"], F.lit("AKIA")))
    ends = _spans(F.col("endpoint"), "endpoint", lambda x: F.lit(True))
    found = materialise(rows.select("_id", "_digest", base.alias("base"), F.concat(short, ids, ends).alias("weak")), "secret-parts")

    # A text's parts are the same wherever it stands, so equal texts of an id share them and no row number is needed.
    some = found.where("size(weak) > 0").select("_id", "_digest", "base", "weak").dropDuplicates(["_id", "_digest"])
    part = some.select("_id", "_digest", F.explode(F.concat("base", "weak")).alias("p")).select("_id", "_digest", "p.*")
    role = F.when(F.col("kind").isin("assign", "hex", "weak_secret"), "secret").when(F.col("kind").isin("access", "weak_access"), "access").otherwise("endpoint")
    part = part.withColumn("role", role)
    cells = (
        part.withColumn("cell", F.explode(F.sequence(F.floor(F.col("start") / scope), F.floor(F.col("end") / scope))))
        .groupBy("_id", "_digest", "cell", "role")
        .agg(F.min("start").alias("low"), F.max("end").alias("high"))
    )
    need = F.create_map(*[x for k, v in PARTNERS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    asked = (
        part.where(F.col("kind").isin(*PARTNERS))
        .withColumn("role", F.explode(F.element_at(need, F.col("kind"))))
        .withColumn("cell", F.explode(F.sequence(F.floor(F.col("start") / scope) - 1, F.floor(F.col("end") / scope) + 1)))
    )
    near = (F.col("c.low") <= F.col("w.end") + scope) & (F.col("c.high") >= F.col("w.start") - scope)
    same = F.col("w._id").eqNullSafe(F.col("c._id")) & (F.col("w._digest") == F.col("c._digest")) & (F.col("w.cell") == F.col("c.cell")) & (F.col("w.role") == F.col("c.role"))
    linked = (
        asked.alias("w")
        .join(cells.alias("c"), same & near, "left_semi")
        .groupBy("_id", "_digest")
        .agg(F.collect_set(F.struct("start", "end", "kind")).alias("linked"))
        .withColumnsRenamed({"_id": "_lid", "_digest": "_ldigest"})
    )
    none = F.expr("cast(array() as array<struct<start:int,end:int,kind:string>>)")
    out = found.join(linked, F.col("_id").eqNullSafe(F.col("_lid")) & (F.col("_digest") == F.col("_ldigest")), "left").withColumn("linked", F.coalesce("linked", none))

    def n(kind: str) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")

    return out.select(
        F.col("_id").alias(id_col),
        *[n(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.concat("base", "linked")).alias("spans"),
        F.size("linked").cast("long").alias("n_linked"),
        F.col("base").alias("base_spans"),
        F.col("linked").alias("linked_spans"),
        F.col("_digest").alias("text_sha256"),
    )


def redact(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", mark: str = "[secret]", length_col: str | None = None) -> DataFrame:
    """``docs`` with every span that :func:`scan_secrets` reports replaced by ``mark``; all rows and columns stay.

    Spans that meet become one mark, and ``length_col`` gets the new length. Rows without a finding are not changed; a
    null text stays null.
    """
    found = scan_secrets(docs, id_col=id_col, text_col=text_col).where("spans <> ''")
    spans = F.array_sort(F.transform(F.concat("base_spans", "linked_spans"), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))))
    # Each span starts no earlier than the end of all before it, so that every place is cut once.
    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("out"))

    def add(state: Column, x: Column) -> Column:
        low = F.greatest(state["at"], x["start"])
        more = F.concat(state["out"], F.array(F.struct(low.alias("start"), x["end"].alias("end"))))
        return F.when(x["end"] <= state["at"], state).otherwise(F.struct(x["end"].alias("at"), more.alias("out")))

    cut = F.aggregate(spans, zero, add, lambda s: s["out"])
    fid, fdigest, digest, cuts = (free_name(docs, x) for x in ("_fid", "_fdigest", "_digest", "_cuts"))
    found = found.select(F.col(id_col).alias(fid), F.col("text_sha256").alias(fdigest), cut.alias(cuts)).dropDuplicates([fid, fdigest])
    text = F.col(text_col)
    whole = docs.withColumn(digest, F.sha2(F.coalesce(text, F.lit("")), 256)).join(found, F.col(id_col).eqNullSafe(F.col(fid)) & (F.col(digest) == F.col(fdigest)), "left")

    def end_before(i: Column) -> Column:
        return F.coalesce(F.get(cuts, i - 1)["end"], F.lit(0))

    def kept_and_mark(x: Column, i: Column) -> Column:
        meets = (i > 0) & (end_before(i) == x["start"])
        return F.concat(F.substring(text, end_before(i) + 1, x["start"] - end_before(i)), F.when(meets, "").otherwise(mark))

    changed = F.concat(F.array_join(F.transform(cuts, kept_and_mark), ""), F.substr(text, end_before(F.size(cuts)) + 1))
    new = {text_col: F.when(F.col(cuts).isNull(), text).otherwise(changed)}
    if length_col is not None:
        new[length_col] = F.when(F.col(cuts).isNull(), F.col(length_col)).otherwise(F.length(changed).cast(dict(docs.dtypes)[length_col]))
    return whole.withColumns(new).select(*docs.columns)
