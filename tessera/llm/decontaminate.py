"""Benchmark decontamination by template windows; DataFrame functions only.

Texts are brought to template form, word by word: a number, in digits or in words, becomes one placeholder, a unit after a
number another, a name (a run of capitalised words, at a sentence's start such as aren't known to begin sentences) a third;
everything else is lower-cased.  Items with names have a second form, all in lower case, which is that of texts without
capitals.  Windows of
``WINDOW`` template words are hashed; windows of documents and of benchmark items are joined on the hash.  What stands in the
slots comes along, and a match of an item at an offset counts only if its slots are consistent: equal values of the item have
equal values in the document.  So a question with other numbers or names is caught, a chance agreement of templates isn't.

Windows of the benchmark are broadcast if they take at most ``most`` bytes, and slots are then looked up for what matched.
Else both sides are shuffled by hash; a row carries its own window's slots only, never the words of the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SMALL, cut, fresh, size_of, sized, table

WINDOW = 8
LEAST = 5
COVERAGE = 0.25
RUN = 13

#: Placeholders, and what joins the parts of one number or name; from a private area so that no text has them by chance.
NUMBER, NAME, UNIT, POINT, GLUE = "\ue000", "\ue001", "\ue002", "\ue003", "\ue004"
PLACEHOLDERS = f"[{NUMBER}-{UNIT}]"
PRIVATE = f"[{NUMBER}-{GLUE}]"
UNITS = "kg|g|mg|lb|lbs|oz|tons?|km|m|cm|mm|miles?|mi|ft|feet|inch(?:es)?|yards?|h|hrs?|hours?|min|mins|minutes?|s|sec|secs|seconds?|days?|weeks?|months?|years?|l|ml|lit(?:er|re)s?|percent|dollars?|usd|euros?|eur|pounds?|cents?|degrees?|mph|kmh|kb|mb|gb|tb|hz|khz|mhz|ghz|w|kw|v|a|meters?|metres?"


# Numbers in words, and words that often begin a sentence and are no names.
NUMERALS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion"
).split()
STARTERS = (
    "A After All Also Although An And Any Are As Assume At Because Before Both But By Calculate Can Choose Compute Consider Could Describe Determine Did Do Does During Each Every "
    "Explain Finally Find First For From Given Had Has Have He Her Here His How However I If In Into Is It Its Later Let List Many Might Most Must My Name Next No Not Now Of On Once Or Our "
    "Prove Select She Should Show Since So Solve Some State Such Suppose Than That The Their Then There These They This Those Thus To Today Under Until Use Using Was We Were What When Where Which "
    "While Who Whom Whose Why Will With Without Would Write Yes You Your"
).split()
_NUMERAL = f"(?:{'|'.join(NUMERALS)})"
_NO_NAME = "|".join([*STARTERS, *(n.capitalize() for n in NUMERALS)])


def plain_words(text: Column) -> Column:
    """Words as they stand, lower-cased, joined by single spaces."""
    return F.btrim(F.regexp_replace(F.lower(F.regexp_replace(text, PRIVATE, " ")), r"[^\p{L}\p{M}\p{N}]+", " "))


def slotted_words(text: Column) -> Column:
    """Template words joined by single spaces; a placeholder is followed by what it stands for, without a space."""
    clean = F.regexp_replace(text, PRIVATE, " ")
    # one number: digits with points, commas and the like between them
    clean = F.regexp_replace(clean, r"(?<=[0-9])[.,:/](?=[0-9])", POINT)
    # one name: capitalised words, not all capitals, at a start or after anything but capitals, glued together
    named = F.regexp_replace(clean, rf"(?=\p{{Lu}}[\p{{Lu}}'’]*\p{{Ll}})(?!(?:{_NO_NAME})(?!\p{{L}}))(?:(?<=[\p{{Ll}}0-9,;.!?:)\"“”] )|(?<=[(\"“\n\r\t])|(?<![\s\S]))", NAME)
    inside = rf"(?: {NAME}|['’-](?=\p{{L}}))(?<={NAME}[\p{{L}}\p{{M}}'’-]{{1,40}}(?: {NAME}|['’-]))"
    named = F.regexp_replace(named, inside, GLUE)
    words = F.btrim(F.lower(F.regexp_replace(named, rf"[^\p{{L}}\p{{M}}\p{{N}}{NAME}{POINT}{GLUE}]+", " ")))
    words = F.regexp_replace(words, rf"(?<=[0-9])(?=(?:{UNITS})(?![^ ]))", " ")
    numbered = F.regexp_replace(words, rf"(?<![^ ])(?=[0-9b-z])([0-9]+(?:{POINT}[0-9]+)*|{_NUMERAL})(?![^ ])", f"{NUMBER}$1")
    # one number: words of it in a row
    numbered = F.regexp_replace(numbered, rf" (?:and )?{NUMBER}(?=[a-z])(?<={NUMBER}[a-z{GLUE}]{{3,80}} {NUMBER}|(?:hundred|thousand|million) and {NUMBER})", GLUE)
    return F.regexp_replace(numbered, rf"({NUMBER}[^ ]+ )(?=(?:{UNITS})(?![^ ]))", f"$1{UNIT}")


def template_of(slotted: Column) -> Column:
    """Template words from slotted ones: placeholders without what they stand for."""
    return F.regexp_replace(slotted, rf"({PLACEHOLDERS})[^ ]*", "$1")


def _listed(words: Column) -> Column:
    return F.when(words != "", F.split(words, " ")).otherwise(F.array().cast("array<string>"))


def _coded(n: int, plain: bool):
    return lambda i: i * 1024 + n * 2 + int(plain)


def windows(rows: DataFrame, kinds: list[tuple[bool, int]]) -> DataFrame:
    """``rows`` (with text) turned into windows of these kinds (plain, length): the other columns, plain, length, pos, hash,
    and the texts' ``slotted`` words.

    Windows are of template words or, if plain, of the words as they stand.  Positions are exploded and each window is hashed
    from the words it covers, all in one generated stage.
    """
    other = [c for c in rows.columns if c != "text"]
    both = rows.withColumn("text", F.coalesce("text", F.lit(""))).select(*other, "text", slotted_words(F.col("text")).alias("all"))
    slotted = F.when(F.col("all").rlike(PLACEHOLDERS), F.split("all", " "))
    split = both.select(*other, _listed(template_of(F.col("all"))).alias("words"), slotted.alias("slotted"), *([_listed(plain_words(F.col("text"))).alias("lower")] if any(p for p, _ in kinds) else []))
    none = F.array().cast("array<int>")
    starts = []
    for plain, n in kinds:
        size = F.size("lower" if plain else "words")
        starts.append(F.when(size >= n, F.sequence(F.lit(0), size - n)).otherwise(none))
    if len(kinds) > 1:
        coded = [F.transform(s.cast("array<long>"), _coded(n, plain)) for s, (plain, n) in zip(starts, kinds, strict=True)]
        placed = split.select("*", F.explode(F.concat(*coded)).alias("at"))
        placed = placed.withColumns({"pos": F.shiftright("at", 10).cast("int"), "length": F.shiftright("at", 1).bitwiseAND(F.lit(511)).cast("int"), "plain": F.col("at").bitwiseAND(F.lit(1)) == 1}).drop("at")
    else:
        placed = split.select("*", F.explode(starts[0]).alias("pos")).withColumns({"length": F.lit(kinds[0][1]), "plain": F.lit(kinds[0][0])})
    hashed = F.lit(None).cast("long")
    for plain, n in kinds:
        own = F.xxhash64(F.lit(int(plain)), *[F.col("lower" if plain else "words")[F.col("pos") + k] for k in range(n)])
        hashed = F.when((F.col("length") == n) & (F.col("plain") == plain), own).otherwise(hashed) if len(kinds) > 1 else own
    return placed.select(*other, "plain", "length", "pos", hashed.alias("hash"), "slotted")


def slots() -> Column:
    """What stands in the slots of a window, in order, joined by spaces, from slotted, plain, pos and length.

    Null for plain windows.  Without functions of functions, so that it is part of the generated stage.
    """
    word = [F.get("slotted", F.col("pos") + k) for k in range(WINDOW)]
    here = [F.when((F.col("length") > k) & w.substr(1, 1).isin(NUMBER, NAME, UNIT), w) for k, w in enumerate(word)]
    return F.when(~F.col("plain"), F.concat_ws(" ", *here))


def item_windows(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (hash, item, form, item_pos, item_slots, total, plain, length) of the benchmark; an item shorter than a window is one.

    ``form``: 1 for the lower-case form of an item with names.  Items of fewer than ``LEAST`` template words have windows of
    the words as they stand.  Items without words, null ids and null texts are left out.  Repeated items count once.
    """
    rows = items.select(F.col(id_col).alias("item"), F.col(text_col).cast("string").alias("text")).where("item is not null and text is not null").distinct()
    named = F.contains(slotted_words(F.col("text")), F.lit(NAME))
    rows = rows.withColumn("form", F.explode(F.when(named, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).withColumn("text", F.when(F.col("form") == 1, F.lower("text")).otherwise(F.col("text")))
    n_template = F.size(_listed(template_of(slotted_words(F.col("text")))))
    n_plain = F.size(_listed(plain_words(F.col("text"))))
    rows = rows.withColumn("few", n_template < LEAST).withColumn("n", F.when(F.col("few"), n_plain).otherwise(n_template)).where("n > 0")
    rows = rows.withColumn("want", F.least(F.lit(WINDOW), "n")).withColumn("total", F.col("n") - F.col("want") + 1).drop("n")
    kinds = [(False, n) for n in range(LEAST, WINDOW + 1)] + [(True, n) for n in range(1, WINDOW + 1)]
    made = windows(rows, kinds).where((F.col("length") == F.col("want")) & (F.col("plain") == F.col("few")))
    return made.select("hash", "item", "form", F.col("pos").alias("item_pos"), slots().alias("item_slots"), "total", "plain", "length")


def _before(step: int):
    return lambda p: p - step


def _holds_run(at: Column) -> Column:
    """Whether the positions ``at`` hold so many in a row that their windows cover ``RUN`` words."""
    starts, done = at, 1
    while done < RUN - WINDOW + 1:
        step = min(done, RUN - WINDOW + 1 - done)
        starts, done = F.array_intersect(starts, F.transform(starts, _before(step))), done + step
    return F.size(starts) > 0


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", coverage: float = COVERAGE, most: int = SMALL) -> DataFrame:
    """Rows (id, th, item, coverage, exact): the items of which a document has at least ``coverage`` of the windows, or
    ``RUN`` words in a row.  An item of fewer than ``LEAST`` template words counts only as it stands.

    ``exact``: every slot holds the item's own value.  th: hash of the text.  Equal rows give one result; null and empty
    texts have none; no documents or no items give no rows; columns other than those named are left aside.  A text of any
    length is searched whole.
    """
    bench = cut(item_windows(items, item_col, item_text_col))
    kinds = sorted((r["plain"], r["length"]) for r in bench.select("plain", "length").distinct().collect()) or [(False, WINDOW)]
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    made, keys = windows(rows, kinds), ["hash", "plain", "length"]
    slim = ["id", "th", "pos", *keys, "slots"]
    if size_of(bench) <= most:
        matched = made.join(F.broadcast(bench), keys).withColumn("slots", slots())
    else:
        matched = made.withColumn("slots", slots()).select(*slim).join(bench, keys)
    one = lambda column: F.filter(F.split(column, " "), lambda v: v != "")
    pairs = F.zip_with(one("item_slots"), one("slots"), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    group = ["id", "th", "item", "form", "total", "plain", "offset"]
    at_offset = (
        matched.select("id", "th", "item", "form", "total", "plain", (F.col("pos") - F.col("item_pos")).alias("offset"), "item_pos", F.coalesce(pairs, F.array().cast("array<struct<a:string,b:string>>")).alias("pairs"))
        .groupBy(*group)
        .agg(F.collect_set("item_pos").alias("at"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"))
    )
    consistent = at_offset.where(F.col("plain") | (F.size(F.array_distinct("pairs.a")) == F.size("pairs")))
    # of an item of few template words all windows must be there
    consistent = consistent.where(~F.col("plain") | (F.size("at") == F.col("total")))
    consistent = consistent.withColumn("exact", F.col("plain") | ~F.exists("pairs", lambda p: p["a"] != p["b"])).withColumn("run", _holds_run(F.col("at")))
    found = consistent.groupBy("id", "th", "item", "form", "total").agg(F.size(F.array_distinct(F.flatten(F.collect_list("at")))).alias("n"), F.min("exact").alias("exact"), F.max("run").alias("run"))
    leaks = found.withColumn("coverage", F.col("n") / F.col("total")).where((F.col("coverage") >= coverage) | F.col("run"))
    best = F.max(F.struct("coverage", "exact")).alias("best")  # of the two forms of an item
    return leaks.groupBy("id", "th", "item").agg(best).select("id", "th", "item", "best.coverage", "best.exact")


def _by_document(found: DataFrame) -> DataFrame:
    return found.groupBy("id", "th").agg(F.array_sort(F.collect_set("item")).alias("items"), F.max("coverage").alias("coverage"), F.min("exact").alias("exact"))


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Benchmark items found in each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = _by_document(find_leaks(docs, table(spark, sf_dir, "benchmark")))
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"))
    rows = rows.join(found, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("th")), "left")
    return rows.select(
        "doc_id",
        F.col("items").isNotNull().alias("contaminated"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce(F.array_join(F.transform("items", lambda x: x.cast("string")), ","), F.lit("")).alias("items"),
        F.coalesce("coverage", F.lit(0.0)).alias("coverage"),
        F.coalesce(F.when(F.col("exact"), "exact").when(~F.col("exact"), "reparameterised"), F.lit("")).alias("kind"),
    )


def remove_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` in which no item is found; their columns stay as they are, whatever their names.

    Rows without text stay; repeated rows stay or go together; without items all rows stay.
    """
    key, found_id, found_key = (fresh(c, docs) for c in ("_hash", "_found_id", "_found_hash"))
    found = find_leaks(docs, items, id_col, text_col, **how).select(F.col("id").alias(found_id), F.col("th").alias(found_key)).distinct()
    rows = docs.withColumn(key, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    same = F.col(id_col).eqNullSafe(F.col(found_id)) & (F.col(key) == F.col(found_key))
    return rows.join(sized(found), same, "left_anti").select(*docs.columns)
