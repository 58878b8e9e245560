"""Benchmark decontamination by template windows: typed placeholders, a hash join and consistent slots."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bits_of, materialise, text_key

#: Words that are units where they follow a number.
UNITS = (
    "km", "m", "cm", "mm", "mi", "miles", "mile", "ft", "feet", "inches", "inch", "kg", "g", "mg", "lb", "lbs", "pounds",
    "oz", "t", "tons", "l", "ml", "liters", "litres", "gallons", "s", "sec", "seconds", "min", "minutes", "h", "hours",
    "hour", "days", "day", "weeks", "months", "years", "usd", "dollars", "dollar", "cents", "euros", "eur", "degrees",
    "percent", "mph", "kmh", "hz", "w", "kw", "v", "mb", "gb",
)
#: A number, or a run of letters.
TOKEN = r"[0-9]+(?:[.,][0-9]+)*|\p{L}+"
#: One character each for a name, a number and a unit while texts are canonicalised; texts lose these characters.
NAME, NUMBER, UNIT = "\ue000", "\ue001", "\ue002"
WIDTH = 5
SHORT = "short"
#: A run of matched windows is enough where it covers so many widths, or a share of the item's words, but so many words.
RUN_WIDTHS, RUN_SHARE, LEAST_RUN = 3, (2, 3), 8
#: The prefilter's bits: as many a window, but not over a fixed size; what passes by mistake is dropped by the join. A hash
#: has bits in one word, numbered by these slices of it, so that plans need mention the bitmap only once.
BITS_PER_WINDOW, MAX_BITS, SLICES = 64, 1 << 22, (40, 46, 52, 58)


def plain(text: Column) -> Column:
    """The text without the placeholders' characters; only texts that hold one are built anew."""
    text = F.coalesce(text, F.lit(""))
    taken = F.contains(text, F.lit(NAME)) | F.contains(text, F.lit(NUMBER)) | F.contains(text, F.lit(UNIT))
    return F.when(taken, F.translate(text, NAME + NUMBER + UNIT, "")).otherwise(text)


def template(text: Column) -> Column:
    """The words of a plain text with typed placeholders for names (capitalised words), numbers and units after numbers.

    Other words are in lower case. There are as many words as :data:`TOKEN` finds in the text.
    """
    # Letters beyond the basic plane end in a low surrogate, which is all that a look behind sees of them.
    # Capitals are told first, as they are few and a look behind is slow.
    named = F.regexp_replace(text, r"(?=\p{Lu})(?<![\p{L}\x{DC00}-\x{DFFF}])\p{Lu}\p{L}+", NAME)
    units = "|".join(sorted(UNITS, key=len, reverse=True))
    counted = F.regexp_replace(named, r"[0-9]+(?:[.,][0-9]+)*", NUMBER)
    measured = F.regexp_replace(counted, rf"({NUMBER}[^\p{{L}}{NAME}{NUMBER}]*)(?i:{units})(?!\p{{L}})", f"$1{UNIT}")
    whole = F.when(F.rlike(text, F.lit("[0-9]")), measured).otherwise(named)
    # The one letter that lower case turns into a letter and a mark, which would cut its word in two.
    lower = F.lower(F.replace(whole, F.lit("\u0130"), F.lit("i")))
    return F.regexp_extract_all(lower, F.lit(rf"[{NAME}{NUMBER}{UNIT}]|\p{{L}}+"), F.lit(0))


def folded(text: Column) -> Column:
    """The words of a plain text, whatever their case; as many as :data:`TOKEN` finds in the text."""
    out = F.lower(F.replace(text, F.lit("\u0130"), F.lit("i")))
    for a, b in (("\u0131", "i"), ("\u03c2", "\u03c3"), ("\u00df", "ss")):  # letters that capitals do not come back to
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.regexp_extract_all(out, F.lit(TOKEN), F.lit(0))


def with_windows(rows: DataFrame, width: int, words: str, h: str) -> DataFrame:
    """``rows`` with ``h``: a 64-bit hash of each run of ``width`` words of the column ``words``, by place.

    Hashes of shorter runs are combined, each in a column of its own so that it is computed once.
    """
    have, rows = 1, rows.withColumn(h, F.transform(words, lambda x: F.xxhash64(x)))
    while have < width:
        step = min(have, width - have)
        short = F.greatest(F.size(h) - step, F.lit(0))
        rows = rows.withColumn(h, F.zip_with(F.slice(h, F.lit(1), short), F.slice(h, F.lit(step + 1), short), lambda a, b: F.xxhash64(a, b)))
        have += step
    return rows


def _is_slot(x: Column) -> Column:
    return x.isin(NAME, NUMBER, UNIT)


def item_windows(benchmark: DataFrame, *, id_col: str, text_col: str, width: int, literals: int) -> DataFrame:
    """Windows of the items by hash: of their templates, with at least ``literals`` words that are not slots
    (``rich``), and all of their folded words. ``words`` are what was hashed, ``raw`` and ``typed`` the same place's.

    An item of fewer words is one window of its own length: ``kind`` is :data:`SHORT` with that length."""
    text = plain(F.col(text_col))
    words = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    rows = benchmark.select(F.col(id_col).alias("item"), words.alias("raw"), template(text).alias("typed"), folded(text).alias("folded"))

    def of(kind: str, source: str, n: int, rows: DataFrame = rows) -> DataFrame:
        places = with_windows(rows, n, source, "h").select("item", F.size("raw").alias("n_words"), "raw", "typed", F.col(source).alias("words"), F.posexplode("h").alias("place", "h"))
        cut = [F.slice(c, F.col("place") + 1, F.lit(n)).alias(c) for c in ("raw", "typed", "words")]
        rich = F.size(F.filter("typed", lambda x: ~_is_slot(x))) >= literals
        return places.select("item", "n_words", "place", "h", F.lit(kind).alias("kind"), *cut).withColumn("rich", rich)

    out = of("typed", "typed", width).where("rich").unionByName(of("folded", "folded", width))
    for n in range(1, width):
        out = out.unionByName(of(f"{SHORT}{n}", "folded", n, rows.where(F.size("folded") == n)))
    return out


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    width: int = WIDTH,
    literals: int = 2,
    similarity: float = 0.8,
) -> DataFrame:
    """Benchmark items that texts hold, word for word or with other numbers, names and units.

    Returns one row per document and item: id, ``item_id``, ``n_windows`` (of the item's that were found),
    ``item_windows``, ``share`` (their quotient, below ``similarity`` only where a run was enough), ``n_changed`` (slots with another value than
    the item's), ``k1`` and ``k2`` (the text's key).

    Texts and items become templates. Windows of ``width`` template words (items': with at least ``literals`` words
    that are no slots) are hashed, and so are windows of the words themselves, whatever their case; a bitmap of fixed size of the items' hashes leaves the few places of a text that
    may match, and these are joined with the items' windows by hash. A match must have the same template, or the
    same words but for their case, and its slots must be consistent: equal values stand for equal values both ways. Over an occurrence of an item, values that
    stand for several others speak against it: at least ``similarity`` of both sides' slot values must stand for one each.
    Share and consistency are judged for each occurrence (matches that place the item at one start, or at starts within
    half an item) and for the text as a whole; one that passes is enough, and the figures are those of the best. The
    share is of the windows with enough literal words, or of all where that one does not suffice. Whatever the share, a
    consistent run of matches is enough that covers three widths, or two thirds of the item's words and at least 8.

    A text's windows stay in its row until the bitmap has been asked, so nothing is shuffled but matches. Null text:
    no words. Null ids are kept; rows that repeat give one row. Items of fewer than ``width`` words are found where
    all their words stand in a row, whatever the case, and items without a window of enough literal words by their
    words as they are. Items without a word are never found. Empty tables give an empty result; other columns are
    ignored.
    """
    windows = materialise(item_windows(benchmark, id_col=item_id_col, text_col=item_text_col, width=width, literals=literals), "item-windows")
    n = windows.select("h").distinct().count()
    bits = min(MAX_BITS, 64 * 2 ** max(0, math.ceil(math.log2(max(1, n) * BITS_PER_WINDOW / 64))))
    number = lambda h: h.bitwiseAND(F.lit(bits // 64 - 1)).cast("int")
    found = windows.groupBy(number(F.col("h")).alias("word")).agg(F.bit_or(bits_of(F.col("h"), SLICES)).alias("set")).collect()  # bits / 64 at most
    words = [0] * (bits // 64)
    for r in found:
        words[r.word] = r.set
    # All of it lies in the driver's plans, their texts and its event log, for each mention: it must be short.
    bitmap = F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")

    def maybe(h: Column) -> Column:
        return bits_of(h, SLICES).bitwiseAND(F.bitwise_not(F.get(bitmap, number(h)))) == 0

    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).withColumns({"typed": template(plain(F.col("_text"))), "folded": folded(plain(F.col("_text")))})
    # By kind, what is hashed and how many words a time; lengths of short items only where there are any.
    kinds = {"typed": ("typed", width), "folded": ("folded", width)}
    short = [r.kind for r in windows.where(F.col("kind").startswith(SHORT)).select("kind").distinct().collect()]  # width - 1 at most
    kinds |= {k: ("folded", int(k.removeprefix(SHORT))) for k in sorted(short)}

    asked = rows
    for kind, (source, n) in kinds.items():
        asked = with_windows(asked, n, source, f"h_{kind}")
    # All kinds go past the bitmap in one array, as each mention of it counts. Of a short item's hash one place is enough.
    parts = {k: F.array_distinct(f"h_{k}") if k.startswith(SHORT) else F.col(f"h_{k}") for k in kinds}
    asked = asked.withColumn("h_all", F.concat(*parts.values()))
    asked = asked.withColumn("passed", F.array_compact(F.transform("h_all", lambda x, i: F.when(maybe(x), i))))

    def tagged(kind: str, first: Column) -> Column:
        mine = F.filter("passed", lambda p: (p >= first) & (p < first + F.size(parts[kind])))
        place = (lambda p: F.array_position(f"h_{kind}", F.get("h_all", p)).cast("int") - 1) if kind.startswith(SHORT) else (lambda p: p - first)
        return F.transform(mine, lambda p: F.struct(F.lit(kind).alias("kind"), place(p).alias("i")))

    starts, first = [], F.lit(0)
    for kind in kinds:
        starts.append(first)
        first = first + F.size(parts[kind])
    # The row number keeps the filter above the projection: pushed below, it would work out every array again.
    asked = asked.withColumn("_row", F.monotonically_increasing_id())
    # Only texts with a place that may match are looked at word by word.
    found = asked.where("size(passed) > 0 and _row >= 0").withColumns({"raw": F.regexp_extract_all(plain(F.col("_text")), F.lit(TOKEN), F.lit(0)), "places": F.concat(*map(tagged, kinds, starts))})
    hits = found.select("_id", *text_key(F.col("_text")), "raw", "typed", "folded", *[f"h_{k}" for k in kinds], F.inline("places"))

    def window(kind: str) -> Column:
        source, n = kinds[kind]
        return F.struct(F.get(f"h_{kind}", F.col("i")).alias("h"), *[F.slice(c, F.col("i") + 1, F.lit(n)).alias(x) for c, x in (("raw", "mine"), (source, "same_words"))])

    hits = hits.select("_id", "k1", "k2", "i", "kind", F.coalesce(*[F.when(F.col("kind") == k, window(k)) for k in kinds]).alias("w"))
    # Written before the join, whose plan is then one without the bitmap.
    hits = materialise(hits.select("_id", "k1", "k2", "i", "kind", "w.*"), "template-hits")

    match = hits.join(windows, ["h", "kind"]).where(F.col("same_words") == F.col("words"))
    slot = F.filter(F.arrays_zip(F.col("typed").alias("t"), F.col("raw").alias("a"), F.col("mine").alias("b")), lambda x: _is_slot(x["t"]))
    pairs = F.array_distinct(F.transform(slot, lambda x: F.struct(F.lower(x["a"]).alias("a"), F.lower(x["b"]).alias("b"))))
    one_to_one = (F.size(F.array_distinct(pairs["a"])) == F.size(pairs)) & (F.size(F.array_distinct(pairs["b"])) == F.size(pairs))
    key = ["_id", "k1", "k2", "item"]
    # Written once: the counts below would each read all texts again.
    match = match.withColumn("pairs", pairs).where(one_to_one).select(*key, (F.col("i") - F.col("place")).alias("start"), "place", "rich", "n_words", "pairs")
    match = materialise(match.distinct(), "template-matches")

    # An occurrence: one start of the item in the text; starts within half an item, where words were added or left out;
    # or the whole text. Stretches overlap by half, and two whole items side by side share none.
    half = F.greatest(F.lit(1), F.expr("n_words div 2"))
    stretch = F.floor(F.col("start") / half)
    # Or a run: windows at one start that leave no word out between them.
    along = Window.partitionBy(*key, "start").orderBy("place")
    match = match.withColumn("_cut", F.coalesce((F.col("place") - F.lag("place").over(along) > width).cast("long"), F.lit(0)))
    match = match.withColumn("run", F.sum("_cut").over(along.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    start, none = F.col("start").cast("long"), F.lit(0).cast("long")
    views = [(0, start, none), (1, stretch, none), (1, stretch - 1, none), (2, none, none), (3, start, F.col("run"))]
    match = match.withColumn("at", F.explode(F.array(*[F.struct(F.lit(k).alias("view"), g.alias("part"), r.alias("run")) for k, g, r in views])))
    group = [*key, "at"]
    counts = [F.count("*").alias("n_all"), F.count_if("rich").alias("n_rich")]
    whole = windows.where("kind <> 'typed'").groupBy(F.col("item").alias("w_item")).agg(*[c.alias(n) for c, n in zip(counts, ("w_all", "w_rich"))])
    covered = F.max("place") - F.min("place") + width
    least = F.least(F.lit(RUN_WIDTHS * width), F.greatest(F.lit(LEAST_RUN), F.ceil(F.max("n_words") * RUN_SHARE[0] / RUN_SHARE[1])))
    long = (F.col("at.view") == 3) & (covered >= least)
    counted = match.select(*group, "place", "rich", "n_words").distinct().groupBy(*group).agg(*counts, long.alias("long"))
    counted = counted.join(whole, F.col("item").eqNullSafe(F.col("w_item")))
    enough = F.coalesce(F.try_divide("n_rich", "w_rich") >= similarity, F.lit(False))
    n, of = [F.when(enough, F.col(f"{x}_rich")).otherwise(F.col(f"{x}_all")) for x in ("n", "w")]
    counted = counted.select(*group, n.alias("n_windows"), of.alias("item_windows"), (n / of).alias("share"), "long").where((F.col("share") >= similarity) | F.col("long"))
    values = match.select(*group, F.explode("pairs").alias("p")).distinct().select(*group, "p.a", "p.b")
    # Values of the item that stand for one value of the text, and the other way round.
    theirs = values.groupBy(*group, "a").agg(F.count("*").alias("n"), F.max((F.col("a") == F.col("b")).cast("int")).alias("same"))
    mine = values.groupBy(*group, "b").agg(F.count("*").alias("n"), F.lit(1).alias("same"))
    both = theirs.drop("a").unionByName(mine.drop("b"))
    slots = both.groupBy(*group).agg(F.count("*").alias("n_slots"), F.sum((F.col("n") == 1).cast("int")).alias("n_single"), F.sum(1 - F.col("same")).alias("n_changed"))
    same_row = [F.col(f"c.{c}").eqNullSafe(F.col(f"s.{c}")) for c in group]
    steady = F.coalesce(F.col("n_single") >= similarity * F.col("n_slots"), F.lit(True))
    passed = counted.alias("c").join(slots.alias("s"), same_row, "left").where(steady).select(
        *[F.col(f"c.{c}").alias(c) for c in key], "share", F.coalesce("n_changed", F.lit(0)).cast("long").alias("n_changed"), "n_windows", "item_windows"
    )
    best = F.max(F.struct("share", (-F.col("n_changed")).alias("same"), "n_windows", "item_windows")).alias("best")
    return passed.groupBy(*key).agg(best).select(
        F.col("_id").alias(id_col),
        F.col("item").alias("item_id"),
        "best.n_windows",
        "best.item_windows",
        "best.share",
        (-F.col("best.same")).alias("n_changed"),
        "k1",
        "k2",
    )
