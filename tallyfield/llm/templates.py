"""Benchmark decontamination by template: numbers, names and units become typed placeholders.

A text is cut into tokens, and each token into a canonical form: a number in digits or words is ``<n>``, a
capitalised word ``<p>`` (a name, or a noun or first word, which a name may replace), a unit ``<u>``, anything else the
lower-cased word without its punctuation. Windows of ``window`` canonical tokens are hashed and joined with the windows of the
benchmark items. The same windows are joined by their literal tokens too, lower-cased and without punctuation, so a
copy is found where a window is made of numbers and names; items shorter than a window are joined as a whole. Windows that match at the same distance between the two texts are one alignment. Its slots
are the placeholders with their original words. A value of the item has a reading in an alignment when more than
half of its places there stand for one value of the document. A window is consistent when all its slots
follow the readings, or when it is copied word for word; other windows of the alignment are not touched. Consistent
windows of an alignment that touch or overlap are one run. A document is
contaminated by an item when a run of it holds ``run`` words of the item, or all of them where it has fewer, and at
least ``solid`` of every ``window`` words in it are the item's own, slots with the same value included; tokens
without a letter or digit are no words. So a question with other numbers and names is found, and a text that
shares a stock phrase or a row of marks is not.

Only DataFrame functions are used. Before windows of the corpus are shuffled, they are checked
against the residues of benchmark windows modulo ``RESIDUES``: a table of at most so many numbers,
which is broadcast. What passes is joined exactly, on the hash and then on the window itself.

Defined cases: null and empty texts match nothing; windows and short items with fewer than ``anchors`` words that are
no placeholder match by their literal tokens only, so with other values they are not found; items of fewer than
``least`` words match nothing; marks between words do not tell tokens apart; repeated rows are judged alike, each by
itself; a null item id is an item like others; columns of ``docs`` keep their names and values whatever they are
called, except ``contaminated`` and ``items``, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfield.llm.matching import only_matching
from tallyfield.session import written

WINDOW = 8
SOLID = 5
ANCHORS = 3
RUN = 13
LEAST = 2
RESIDUES = 1 << 20
BLOCK = 4096
# Units of measure and money in four languages, placeholders wherever they stand.
UNITS = (
    "mm", "cm", "km", "mg", "kg", "ml", "lb", "lbs", "oz", "ft", "mph", "kmh", "usd", "eur",
    "inch", "inches", "foot", "feet", "yard", "yards", "mile", "miles", "meter", "meters", "metre", "metres",
    "kilometer", "kilometers", "centimeter", "centimeters", "gram", "grams", "kilogram", "kilograms", "pound", "pounds",
    "ounce", "ounces", "ton", "tons", "liter", "liters", "litre", "litres", "gallon", "gallons", "cup", "cups",
    "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months",
    "year", "years", "dollar", "dollars", "euro", "euros", "cent", "cents", "percent",
    "zoll", "meilen", "zentimeter", "gramm", "kilogramm", "pfund", "tonnen", "sekunden", "minuten", "stunde", "stunden",
    "tag", "tage", "woche", "wochen", "monat", "monate", "jahr", "jahre", "prozent",
    "mètre", "mètres", "kilomètres", "centimètres", "gramme", "grammes", "kilos", "livres", "tonnes", "secondes",
    "heure", "heures", "jour", "jours", "semaine", "semaines", "mois", "centimes", "pourcent",
    "metro", "metros", "kilómetros", "centímetros", "gramos", "kilogramos", "libras", "toneladas", "litros", "segundos",
    "minutos", "hora", "horas", "día", "días", "semana", "semanas", "meses", "año", "años", "dólares", "centavos",
)
# Units that are other words too, placeholders after a number in digits only.
SHORT_UNITS = ("m", "in", "g", "l", "s", "sec", "min", "h")
# Number words in four languages; those that are articles too are left out.
NUMBER_WORDS = (
    "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen",
    "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", "twenty", "thirty", "forty", "fifty", "sixty",
    "seventy", "eighty", "ninety", "hundred", "thousand", "million",
    "zwei", "drei", "vier", "fünf", "sechs", "sieben", "acht", "neun", "zehn", "elf", "zwölf", "dreizehn", "vierzehn",
    "fünfzehn", "sechzehn", "siebzehn", "achtzehn", "neunzehn", "zwanzig", "dreißig", "vierzig", "fünfzig", "sechzig",
    "siebzig", "achtzig", "neunzig", "hundert", "tausend",
    "deux", "trois", "quatre", "cinq", "sept", "huit", "neuf", "dix", "onze", "douze", "treize", "quatorze", "quinze",
    "seize", "vingt", "trente", "quarante", "cinquante", "soixante", "cent", "mille",
    "dos", "tres", "cuatro", "cinco", "seis", "siete", "ocho", "nueve", "diez", "doce", "trece", "catorce",
    "quince", "veinte", "treinta", "cuarenta", "cincuenta", "sesenta", "setenta", "ochenta", "noventa", "cien", "mil",
)

# Patterns run over whole texts with one blank between tokens and at both ends. They begin at a character that few
# places have and repeat possessively, so that they take no stack and look at each character once, however long a
# word is.
# A single space is left as it is.
_BLANKS = r"[\x20\x09-\x0D](?:(?<! )|(?=[\x20\x09-\x0D]))[\x20\x09-\x0D]*+"
_LEADING = r" [^\p{L}\p{N} ]++"
_TRAILING = r"[^\p{L}\p{N} ](?<=[\p{L}\p{N}].)[^\p{L}\p{N} ]*+(?= )"
_CAPITALISED = r" \p{Lu}\p{Ll}[^ ]*+"
_NUMBER = r" [0-9]++(?:[.,:/-][0-9]++)*+(?= )"
_SHORT_UNIT = rf" <n> (?:{'|'.join(SHORT_UNITS)})(?= )"
_EDGES = r"^[^\p{L}\p{N}]++|(?<![^\p{L}\p{N}])[^\p{L}\p{N}]++$"
_WORD = r"[\p{L}\p{N}]"
ALIGNMENT = ("_row", "_item", "shift")


def tokens_of(text: Column) -> Column:
    """The words of a text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def bare(text: Column) -> Column:
    """The text with one blank between tokens and at both ends, tokens without the marks at their edges."""
    spaced = F.concat(F.lit(" "), F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), _BLANKS, " ")), F.lit(" "))
    return F.regexp_replace(F.regexp_replace(spaced, _LEADING, " "), _TRAILING, "")


def cut_at_blanks(spaced: Column) -> Column:
    """The tokens of ``bare`` and its like; those of marks only are empty."""
    inner = F.substring(spaced, F.lit(2), F.length(spaced) - 2)
    return F.when(F.length(spaced) > 2, F.split(inner, " ")).otherwise(F.array().cast("array<string>"))


def literal(spaced: Column) -> Column:
    """The literal form of each token of ``bare``."""
    return cut_at_blanks(F.lower(spaced))


def canonical(spaced: Column, final=lambda form: form) -> Column:
    """The canonical form of each token of ``bare``, or ``final`` of it."""
    named = F.lower(F.regexp_replace(spaced, _CAPITALISED, " <p>"))
    counted = F.regexp_replace(F.regexp_replace(named, _NUMBER, " <n>"), _SHORT_UNIT, " <n> <u>")
    return F.transform(cut_at_blanks(counted), lambda t: final(
        F.when(t.isin(*NUMBER_WORDS), F.lit("<n>")).when(t.isin(*UNITS), F.lit("<u>")).otherwise(t)
    ))


def once(df: DataFrame, name: str, value: Column, *kept: str) -> DataFrame:
    """Add a column that is computed once a row: a generator keeps Spark from copying the expression."""
    return df.select(*kept, F.explode(F.array(value)).alias(name))


def window_hashes(rows: DataFrame, row: str, text: str, sizes: list[int]) -> DataFrame:
    """(row, exact, size, at, hash): the windows of each text, by canonical and (``exact``) by literal tokens.

    The hash of a window comes from hashes of shorter ones, the powers of two in its size, so each token is
    hashed once a form. No row carries more than its place and hash.
    """
    out = once(rows, "spaced", bare(F.col(text)), row)
    out = once(out, "h1", canonical(F.col("spaced"), lambda f: F.xxhash64(f)), row, "spaced")
    out = once(out, "h1x", F.transform(literal(F.col("spaced")), lambda f: F.xxhash64(f)), row, "h1")
    kept, keys = [row, "h1", "h1x"], []
    for exact in (False, True):
        name = lambda size: f"h{size}{'x' if exact else ''}"  # noqa: B023, E731

        def add(size, a, b, out, name=name):
            left = F.greatest(F.size(name(1)) - (size - 1), F.lit(0))
            joined = F.zip_with(F.slice(name(a), 1, left), F.slice(name(b), a + 1, left), lambda x, y: F.xxhash64(x, y))
            kept.append(name(size))
            return once(out, name(size), joined, *kept[:-1])

        power = 1
        while 2 * power <= max(sizes):
            out = add(2 * power, power, power, out)
            power *= 2
        for size in sizes:
            if name(size) not in kept:  # the largest power of two in it first
                rest, have = size, 0
                while rest:
                    part = 1 << (rest.bit_length() - 1)
                    if have and name(have + part) not in kept:
                        out = add(have + part, have, part, out)
                    have, rest = have + part, rest - part
            keys.append(F.struct(F.lit(exact).alias("exact"), F.lit(size).alias("size"), F.col(name(size)).alias("hashes")))
    out = out.select(row, F.inline(F.array(*keys)))
    return out.select(row, "exact", "size", F.posexplode("hashes").alias("at", "hash"))


def cut(places: DataFrame, rows: DataFrame, row: str, text: str) -> DataFrame:
    """The windows at (row, exact, size, at, hash) with their tokens and forms.

    Places of a text are taken together, at most those that begin in ``BLOCK`` tokens, so that it is cut into
    tokens once a block and not once a window.
    """
    place = F.struct("exact", "size", "at", "hash")
    blocks = places.groupBy(row, F.floor(F.col("at") / BLOCK).alias("block")).agg(F.collect_list(place).alias("places"))
    out = blocks.drop("block").join(rows.select(row, F.col(text).alias("_text")), row)
    out = once(out, "spaced", bare(F.col("_text")), row, "places", "_text")
    out = once(out, "tokens", tokens_of(F.col("_text")), row, "places", "spaced")
    out = once(out, "literals", literal(F.col("spaced")), row, "places", "spaced", "tokens")
    out = once(out, "forms", canonical(F.col("spaced")), row, "places", "tokens", "literals")
    part = lambda array, p: F.slice(array, p["at"] + 1, p["size"])
    windows = F.transform("places", lambda p: F.struct(
        *[p[c].alias(c) for c in ("exact", "size", "at", "hash")], part(F.col("tokens"), p).alias("tokens"),
        F.when(p["exact"], part(F.col("literals"), p)).otherwise(part(F.col("forms"), p)).alias("forms"),
    ))
    return out.select(row, F.inline(windows))


def words_in(tokens: Column) -> Column:
    return F.size(F.filter(tokens, lambda t: t.rlike(_WORD)))


def runs(windows: DataFrame) -> DataFrame:
    """(alignment, words, changed): the words of each run of windows [begin, end), counted in words of the item,
    and the slots with another value among them; no more than the item is long."""
    ordered = Window.partitionBy(*ALIGNMENT).orderBy("begin", "end")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    opens = (F.col("begin") > F.coalesce(F.max("end").over(before), F.lit(-1))).cast("int")
    numbered = windows.withColumn("_opens", opens).withColumn("_run", F.sum("_opens").over(ordered))
    changed = F.transform(F.filter("slots", lambda s: s["asked"] != s["given"]), lambda s: s["at"])
    return numbered.groupBy(*ALIGNMENT, "_run").agg(
        (F.max("end") - F.min("begin")).alias("words"), F.size(F.array_distinct(F.flatten(F.collect_list(changed)))).alias("changed"),
    ).drop("_run")


def consistent(aligned: DataFrame) -> DataFrame:
    """The windows of ``aligned`` whose slots follow the readings of their alignment or are copied word for word."""
    given = aligned.select(*ALIGNMENT, F.inline("slots")).distinct().groupBy(*ALIGNMENT, "asked", "given").agg(F.count("at").alias("n"))
    places = F.sum("n").over(Window.partitionBy(*ALIGNMENT, "asked"))
    strays = given.withColumn("places", places).where(F.col("n") * 2 <= F.col("places"))
    strays = strays.groupBy(*ALIGNMENT).agg(F.collect_set(F.struct("asked", "given")).alias("strays"))
    pairs = F.transform("slots", lambda s: F.struct(s["asked"].alias("asked"), s["given"].alias("given")))
    copied = F.forall("slots", lambda s: s["asked"] == s["given"])
    follows = F.col("strays").isNull() | copied | ~F.arrays_overlap(pairs, F.coalesce("strays", F.array().cast("array<struct<asked:string,given:string>>")))
    return aligned.join(strays, list(ALIGNMENT), "left").where(follows).drop("strays")


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
    window: int = WINDOW, solid: int = SOLID, run: int = RUN, anchors: int = ANCHORS, least: int = LEAST,
) -> DataFrame:
    """``docs`` with ``contaminated`` and ``items``, the sorted ids of the items found in each.

    ``window`` is a power of two. ``docs`` is written once with row numbers.
    """
    docs = docs.drop("contaminated", "items")
    rest = F.struct(F.lit(0).alias("_"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns) if c != text])
    numbered = written(docs.select(F.monotonically_increasing_id().alias("_row"), F.col(text).alias("text"), rest.alias("rest")), "documents", "zstd")
    asked = benchmark.select(F.col(item).alias("item"), F.col(item_text).alias("text"))
    asked = once(asked.withColumn("_item", F.monotonically_increasing_id()), "all", tokens_of(F.col("text")), "_item", "item", "text")
    asked = written(asked.withColumn("item_words", words_in(F.col("all"))).where(F.col("item_words") >= least), "items")

    def anchored(forms: Column) -> Column:
        return F.size(F.filter(forms, lambda f: ~f.startswith("<") & (f != ""))) >= anchors

    # at most window lengths: those of the short items, and the window's own
    shorter = asked.where(F.size("all") < window).select(F.size("all").alias("size")).distinct().collect()
    sizes = sorted({window} | {r["size"] for r in shorter if r["size"] > 0})
    frames = cut(window_hashes(asked, "_item", "text", sizes), asked, "_item", "text")
    frames = frames.join(asked.select("_item", "all"), "_item").where(F.col("size") == F.least(F.size("all"), F.lit(window)))
    frames = frames.where(F.when(F.col("exact"), words_in(F.col("tokens")) > 0).otherwise(anchored(F.col("forms"))))
    begin = words_in(F.slice("all", 1, F.col("at")))
    frames = frames.withColumn("begin", begin).withColumn("end", F.col("begin") + words_in(F.col("tokens")))
    frames = written(frames.drop("all"), "frames")
    residues = frames.select(F.pmod("hash", F.lit(RESIDUES)).alias("residue")).distinct()
    found = (
        window_hashes(numbered, "_row", "text", sizes)
        .withColumn("residue", F.pmod("hash", F.lit(RESIDUES)))
        .join(F.broadcast(residues), "residue", "left_semi")  # at most RESIDUES numbers
        .drop("residue")
        .join(frames.select("exact", "size", "hash").distinct(), ["exact", "size", "hash"], "left_semi")
    )
    found = written(found, "suspect-windows")
    # of texts, only those that hold such a window are shuffled
    found = cut(found, only_matching(numbered, "_row", found, "_row"), "_row", "text")
    frames = frames.select(
        "_item", F.col("at").alias("item_at"), "begin", "end", "exact", "size", "hash", F.col("tokens").alias("item_tokens"),
        F.col("forms").alias("item_forms"),
    )
    aligned = (
        found.join(frames, ["exact", "size", "hash"])
        .where(F.col("forms") == F.col("item_forms"))
        .withColumn("shift", F.col("at") - F.col("item_at"))
    )
    places = F.sequence(F.col("item_at"), F.col("item_at") + F.size("forms") - 1)
    slots = F.filter(
        F.zip_with(
            F.col("forms"), F.arrays_zip("tokens", "item_tokens", places.alias("item_at")),
            lambda f, t: F.when(~F.col("exact") & f.startswith("<"), F.struct(
                t["item_at"].alias("at"),
                F.lower(F.regexp_replace(t["item_tokens"], _EDGES, "")).alias("asked"),
                F.lower(F.regexp_replace(t["tokens"], _EDGES, "")).alias("given"),
            )),
        ),
        lambda s: s.isNotNull(),
    )
    aligned = written(
        aligned.withColumn("slots", slots).select(*ALIGNMENT, "item_at", "begin", "end", "slots"), "alignments"
    )
    good = consistent(aligned)
    hits = (
        runs(good).join(asked.select("_item", "item", "item_words"), "_item")
        .where(F.col("words") >= F.least(F.lit(run), "item_words"))
        .where(F.col("changed") * window <= F.col("words") * (window - solid))
        .groupBy("_row")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    none = F.array().cast(f"array<{benchmark.schema[item].dataType.simpleString()}>")
    return (
        numbered.join(written(hits, "leaks"), "_row", "left")
        .withColumn("items", F.coalesce("items", none))
        .withColumn("contaminated", F.size("items") > 0)
        .select(*[F.col("text" if c == text else f"rest.c{i}").alias(c) for i, c in enumerate(docs.columns)], "contaminated", "items")
    )
