"""Score tokens: splitting, parsing and spelling, as column expressions.

A note token is opening brackets, a duration with dots, a pitch letter repeated for the octave (or ``r`` for a rest),
accidentals, and marks.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The grammar of a note, what passes through unsplit, and marks that are no sound.
NOTE = r"^([\[(]*)(\d+\.*)([a-gA-G]+|r)(#+|-+|n)?(.*)$"
PASS_THROUGH = r"^[*=!<]"
MARKS = r"L+|J+|."
DROPPED_MARKS = ("X", "y")
#: Durations, accidentals and barlines by token.
DURATIONS = ("0", "1", "2", "3", "4", "6", "8", "12", "16", "24", "32")
ACCIDENTALS = {"#": 1, "##": 2, "-": -1, "--": -2, "n": 0}
BARLINES = {
    "=": "regular", "==": "final", "=||": "double", "=-": "invisible", "=:|!": "repeat-end",
    "=!|:": "repeat-start", "=:|!|:": "repeat-both", "==:|!": "final-repeat-end",
}
WHOLE = 192
SHARPS = ("f#", "c#", "g#", "d#", "a#", "e#", "b#")
FLATS = ("b-", "e-", "a-", "d-", "g-", "c-", "f-")
PITCH_CLASSES = {"C": 0, "D": 2, "E": 4, "F": 5, "G": 7, "A": 9, "B": 11}


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def _is_note(token: Column) -> Column:
    return ~F.rlike(token, F.lit(PASS_THROUGH)) & F.rlike(token, F.lit(NOTE))


def split_token(token: Column) -> Column:
    """Sub-tokens in reading order; what is no note stays whole. Printing hints are dropped."""
    group = [F.regexp_extract(token, NOTE, i) for i in range(6)]
    marks = F.filter(F.regexp_extract_all(group[5], F.lit(MARKS), F.lit(0)), lambda m: ~m.isin(*DROPPED_MARKS))
    parts = F.concat(F.filter(F.split(group[1], ""), lambda x: x != ""), F.array(group[2], group[3]), F.when(group[4] != "", F.array(group[4])).otherwise(F.array().cast("array<string>")), marks)
    return F.when(_is_note(token), parts).otherwise(F.array(token))


def split_tokens(tokens: Column) -> Column:
    return F.flatten(F.transform(tokens, split_token))


def canonical_token(token: Column) -> Column:
    return F.array_join(split_token(token), "")


def token_pitch(token: Column) -> Column:
    """Pitch letters of a note, ``r`` of a rest, null otherwise."""
    return F.when(_is_note(token), F.regexp_extract(token, NOTE, 3))


def is_sung(token: Column) -> Column:
    """Whether a token begins a sung note: a note that does not continue or end a tie."""
    return F.coalesce((token_pitch(token) != "r") & ~F.rlike(token, F.lit(r"[\]_]")), F.lit(False))


def join_records(parts: Column, separator: str = "<b>") -> Column:
    """Spell the tokens between separators; the inverse of splitting that keeps ties where they belong."""
    marked = F.array_join(F.transform(parts, lambda x: F.when(x == separator, "\n").otherwise(x)), "")
    return F.filter(F.split(marked, "\n"), lambda x: x != "")


def join_legacy(parts: Column) -> Column:
    """Spell tokens without separators: a pass-through or a duration begins a token.

    A bracket before a duration sticks to the token before it; :func:`join_records` does not have that defect.
    """
    empty = F.expr("cast(array() as array<string>)")

    def add(out: Column, x: Column) -> Column:
        last = F.element_at(out, -1)
        begins = (
            (F.size(out) == 0)
            | F.rlike(x, F.lit(PASS_THROUGH))
            | F.rlike(last, F.lit(PASS_THROUGH))
            | (F.rlike(x, F.lit(r"^\d+\.*$")) & ~F.rlike(last, F.lit(r"^[\[(]+$")))
        )
        return F.when(F.size(out) == 0, F.array(x)).when(begins, F.concat(out, F.array(x))).otherwise(F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(F.concat(last, x))))

    return F.aggregate(parts, empty, add)


def with_separators(tokens: Column, separator: str = "<b>") -> Column:
    """The separator between each two tokens."""
    return F.slice(F.flatten(F.transform(tokens, lambda x: F.array(F.lit(separator), x))), F.lit(2), F.greatest(2 * F.size(tokens) - 1, F.lit(0)))


def duration(token: Column) -> Column:
    """Divisions, base and dots of a duration token, or null. Dots add halves, rounded down each time."""
    base = F.rtrim(token, F.lit("."))
    dots = F.length(token) - F.length(base)
    whole = F.when(base == "0", 2 * WHOLE).otherwise(F.floor(F.lit(WHOLE) / F.when(base.isin(*DURATIONS[1:]), base).cast("int")))
    halves = F.transform(F.sequence(F.lit(0), dots), lambda k: F.floor(whole / F.pow(F.lit(2.0), k)))
    total = F.aggregate(halves, F.lit(0).cast("long"), lambda s, x: s + x.cast("long"))
    return F.when(base.isin(*DURATIONS), F.struct(total.cast("int").alias("divisions"), base.alias("base"), dots.alias("dots")))


def ticks(token: Column, whole: int = 384) -> Column:
    """Exact length of a duration token in ticks of ``whole`` a whole note (96 a quarter serve all written lengths)."""
    base = F.rtrim(token, F.lit("."))
    dots = F.length(token) - F.length(base)
    plain = F.when(base == "0", 2.0 * whole).otherwise(F.lit(float(whole)) / F.when(base.isin(*DURATIONS[1:]), base).cast("double"))
    return F.round(plain * (2 - F.pow(F.lit(0.5), dots))).cast("long")


def pitch_step(token: Column) -> Column:
    """Step and octave of pitch letters, or null: c is C4, cc C5; C is C3, CC C2."""
    letter = F.left(token, F.lit(1))
    upper = F.upper(letter)
    octave = F.when(letter == upper, 4 - F.length(token)).otherwise(3 + F.length(token))
    return F.when(F.rlike(token, F.lit(r"^([a-gA-G])\1*$")), F.struct(upper.alias("step"), octave.alias("octave")))


def alter(tokens: Column) -> Column:
    """Semitones of the first accidental among sub-tokens, 0 without one."""
    found = F.filter(tokens, lambda t: t.isin(*ACCIDENTALS))
    return F.coalesce(F.element_at(_map(ACCIDENTALS), F.get(found, F.lit(0))), F.lit(0))


def barline_type(token: Column) -> Column:
    return F.coalesce(F.element_at(_map(BARLINES), token), F.lit("other"))


def clef(token: Column) -> Column:
    """Sign, line and octave change of a clef token, or null."""
    body = F.regexp_replace(F.substring(token, 6, 20), "[v^]", "")
    change = F.when(F.contains(token, F.lit("v")), -1).when(F.contains(token, F.lit("^")), 1).otherwise(0)
    return F.when(F.startswith(token, F.lit("*clef")), F.struct(F.left(body, F.lit(1)).alias("sign"), F.coalesce(F.substring(body, 2, 5).try_cast("int"), F.lit(0)).alias("line"), change.alias("octaveChange")))


def key_fifths(token: Column) -> Column:
    """Sharps, or minus flats, of a key signature token, or null."""
    sharps = F.length(token) - F.length(F.replace(token, F.lit("#"), F.lit("")))
    flats = F.length(token) - F.length(F.replace(token, F.lit("-"), F.lit("")))
    return F.when(F.startswith(token, F.lit("*k[")), F.when(sharps > 0, sharps).otherwise(-flats))


def meter(token: Column) -> Column:
    """Numerator and denominator of a meter token, or null; tempo tokens are none."""
    part = [F.regexp_extract(token, r"^\*M(\d+)/(\d+)$", i) for i in (1, 2)]
    return F.when(F.rlike(token, F.lit(r"^\*M\d+/\d+$")), F.struct(part[0].cast("int").alias("num"), part[1].cast("int").alias("den")))


def key_token(fifths: Column) -> Column:
    """The key signature of up to seven sharps or flats."""
    n = F.least(F.abs(F.coalesce(fifths, F.lit(0))), F.lit(7))
    names = F.when(fifths > 0, F.array(*map(F.lit, SHARPS))).otherwise(F.array(*map(F.lit, FLATS)))
    return F.concat(F.lit("*k["), F.array_join(F.slice(names, F.lit(1), n), ""), F.lit("]"))


def clef_token(median_pitch: Column, slot: Column, voices: Column) -> Column:
    """The clef of a voice by its upper median pitch; the third of four voices from the top may be a tenor."""
    return (
        F.when(median_pitch < 55, "*clefF4").when((voices == 4) & (slot == 2) & (median_pitch < 65), "*clefGv2").when(median_pitch < 60, "*clefGv2").otherwise("*clefG2")
    )


def spell_pitch(midi: Column, spelled: Column) -> Column:
    """Pitch letters and accidental of a MIDI number spelled as a name (``Bb``, ``F#``), or null where they disagree.

    A name with dashes is read as sharps and then usually disagrees, as in the source of the rule.
    """
    letter, tail = F.upper(F.left(spelled, F.lit(1))), F.substring(spelled, 2, 20)

    def count(x: Column, c: str) -> Column:
        return F.length(x) - F.length(F.replace(x, F.lit(c), F.lit("")))

    shift = F.when(F.startswith(tail, F.lit("b")), -count(tail, "b")).otherwise(count(spelled, "#") - count(spelled, "b") + count(spelled, "-"))
    above = midi - (F.element_at(_map(PITCH_CLASSES), letter) + shift)
    octave = F.floor(above / 12).cast("int") - 1
    accidental = F.when(shift > 0, F.repeat(F.lit("#"), shift)).otherwise(F.repeat(F.lit("-"), -shift))
    name = F.when(octave >= 4, F.repeat(F.lower(letter), octave - 3)).otherwise(F.repeat(letter, 4 - octave))
    return F.when(F.pmod(above, F.lit(12)) == 0, F.concat(name, accidental))


def beam_group(numerator: Column, denominator: Column, resolution: int = 480) -> Column:
    """Ticks of a beam group: dotted beats in compound meters, otherwise beats."""
    compound = (denominator == 8) & (numerator % 3 == 0) & (numerator > 3)
    return F.when(compound, resolution * 3 // 2).when(denominator == 2, resolution * 2).otherwise(resolution)


#: Written lengths, longest first, by rule: plain values with up to two dots, triplet values without.
_WRITTEN = sorted(
    [(1920 * (2 ** (d + 1) - 1) / (r * 2**d), d, r) for r in (1, 2, 4, 8, 16, 32) for d in range(3)] + [(1920 / r, 0, r) for r in (3, 6, 12, 24)],
    key=lambda x: (-x[0], x[1], x[2]),
)


def duration_codes(length: Column, resolution: int = 480, most: int = 4) -> Column:
    """Codes of the tied notes that make up a length in ticks, or null if it is not positive, not writable, or takes too many.

    One code where one is enough (fewest dots first), else the longest that fits, again and again.
    """
    table = [(t * resolution / 480, f"{r}{'.' * d}") for t, d, r in _WRITTEN]
    single = F.lit(None).cast("array<string>")
    for t, code in sorted(table, key=lambda x: (-x[1].count("."), -int(x[1].rstrip(".")))):
        single = F.when(length.cast("double") == t, F.array(F.lit(code))).otherwise(single)
    codes = F.array(*[F.struct(F.lit(float(t)).alias("t"), F.lit(c).alias("c")) for t, c in table])
    zero = F.struct(length.cast("double").alias("left"), F.expr("cast(array() as array<string>)").alias("out"))

    def add(state: Column, x: Column) -> Column:
        n = F.greatest(F.floor(state["left"] / x["t"]), F.lit(0))
        return F.struct((state["left"] - n * x["t"]).alias("left"), F.concat(state["out"], F.array_repeat(x["c"], F.least(n, F.lit(most + 1)).cast("int"))).alias("out"))

    greedy = F.aggregate(codes, zero, add, lambda s: F.when((s["left"] == 0) & (F.size(s["out"]) <= most), s["out"]))
    return F.when(length > 0, F.coalesce(single, greedy))


def syllables(text: Column) -> Column:
    """Words cut at hyphens; a hyphen stands on both sides of each cut: ``mei-nes`` gives ``mei-`` and ``-nes``."""
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")

    def cut(word: Column) -> Column:
        parts = F.split(word, "-")
        return F.transform(parts, lambda p, i: F.concat(F.when(i > 0, "-").otherwise(""), p, F.when(i < F.size(parts) - 1, "-").otherwise("")))

    return F.flatten(F.transform(words, cut))


def strip_unprinted(tokens: Column, separator: str = "<b>") -> Column:
    """Tokens that are drawn: without invisible rests, without what frames the spine, and no separator twice."""
    seen = F.filter(tokens, lambda t: ~F.rlike(t, F.lit(r"^\d+\.*r.*yy")))

    # From the first token that opens no spine to the last that closes none.
    first = F.array_position(F.transform(seen, lambda t: ~t.isin("**kern", separator)), F.lit(True)).cast("int")
    kept = F.when(first > 0, F.slice(seen, first, F.size(seen)))
    last = F.array_position(F.transform(F.reverse(kept), lambda t: ~t.isin("*-", separator)), F.lit(True)).cast("int")
    kept = F.when(last > 0, F.slice(kept, F.lit(1), F.size(kept) - last + 1))
    pairs = F.zip_with(kept, F.concat(F.array(F.lit("")), F.slice(kept, F.lit(1), F.size(kept) - 1)), lambda t, before: F.struct(t.alias("t"), before.alias("before")))
    printed = F.transform(F.filter(pairs, lambda x: (x["t"] != separator) | (x["before"] != separator)), lambda x: x["t"])
    return F.coalesce(printed, F.array().cast("array<string>"))


def is_repeat(barline: Column, direction: str) -> Column:
    """Whether a barline (kind, direction) is a repeat sign of that direction; the kind decides, not the style."""
    return F.coalesce((barline["kind"] == "repeat") & (barline["direction"] == direction), F.lit(False))


def barline_token(barline: Column, next_repeats: Column) -> Column:
    """The token of a measure's right barline (kind, direction, style), with a repeat that starts behind it folded in.

    Null for what cannot be printed: a start on the right, an unknown style, a start behind a final or double bar.
    """
    style = F.coalesce(barline["style"], F.lit("regular"))
    plain = F.when(style.isin("regular", "short", "tick"), "").when(style == "final", "=").when(style.isin("double", "light-light"), "||")
    core = F.when(is_repeat(barline, "start"), F.lit(None)).when(is_repeat(barline, "end"), ":|!").otherwise(plain)
    folded = F.when(core == "", "!|:").when(core == ":|!", ":|!|:")
    return F.concat(F.lit("="), F.when(next_repeats, folded).otherwise(core))
