"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

A text has two readings. Literally, it is its words in lower case without punctuation. As a template, names, numbers and
units are typed placeholders besides. Windows of five words of both readings are hash-joined with those of the benchmark.
A document with 0.8 of an item's different literal windows holds it verbatim. One with 0.8 of its template windows is a candidate: the values
in the placeholders' places must then be consistent, in the whole document or in one occurrence of the item there: a value of
the item always meets the same value, and two names never meet one. So a question with other numbers and names is found too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainflow.llm.common import text_or_empty, workspace, written

WINDOW, SHARE = 5, 0.8
#: Item windows (16 bytes each) up to which they are broadcast; beyond, both sides are shuffled by window.
BROADCAST_WINDOWS = 1_000_000
#: Words that open sentences, in capitals without being names.
OPENERS = (
    "A An And Are As At Because Before Both But By Calculate Can Compute Did Do Does Each Every Find First For From Given Has Have He Her Here His How I If In Is It "
    "Its Let Many My No Not Now Of On One Or Our She So Some Suppose That The Their Then There These They This Those To Two Was We Were What When Where Which While Who Whose Why Will With "
    "Yesterday Today Tomorrow You Your Aber Als Auf Aus Bei Das Dem Den Der Die Du Ein Eine Er Es Für Ich Ihr Im Mit Nach Sie Und Von Wann Warum Was Wenn Wer Wie Wir Wo Zu "
    "Au Aux Avec Ce Ces Cette Comment Dans De Des Elle En Est Et Il Ils Je La Le Les Mais Nous Où Par Pour Quand Que Quel Quelle Qui Si Sur Un Une Vous "
    "Al Con Cuando Cuánto Cuántos Del Dónde El Ella Ellos Las Lo Los Para Pero Por Qué Quién Se Sin Su Una Yo Y"
)
_OPENER = rf"(?:{'|'.join(sorted(set(OPENERS.split())))})(?![\p{{L}}'’-])"
_NAME = rf"(?!{_OPENER})\p{{Lu}}[\p{{L}}'’-]++"
#: Capitalised words one space apart are one name. Repetitions are possessive: they need no stack, however long they run.
NAME = rf"(?=\p{{Lu}})(?<![\p{{L}}\p{{N}}'’-]){_NAME}(?: {_NAME})*+"
NUMBER = r"[$€£]?[0-9]++(?:[.,:/][0-9]++)*+"
#: Units that may follow a number.
UNITS = "kilometers|kilometres|km|meters|metres|cm|mm|m|miles|mile|mi|feet|foot|ft|inches|inch|in|yards|kilograms|kg|grams|mg|g|pounds|lbs|lb|ounces|oz|tons|liters|litres|ml|l|gallons|seconds|sec|s|minutes|min|hours|hour|hrs|h|days|day|weeks|week|months|month|years|year|dollars|dollar|euros|euro|cents|percent|%|mph|kph|degrees|°c|°f"
_GAP = r"\x20\x09-\x0D"
SPACES = " \t\n\x0b\x0c\r"
_TAG = r"<(name|num|unit):[^<>]*>"


def literal_words(text: Column) -> Column:
    """The words of a text, lower case, without punctuation; one empty word if there are none."""
    return F.split(F.trim(F.regexp_replace(F.lower(text), rf"[^\p{{L}}\p{{N}}{_GAP}]+", ""), F.lit(SPACES)), f"[{_GAP}]+")


def template_words(text: Column, tagged: bool = False) -> Column:
    """The template's words. ``tagged``: placeholders are <name:value>, not <name>."""
    value = lambda k: f":${k}" if tagged else ""
    digits = text.rlike("[0-9]")
    text = F.when(text.rlike("[<>]"), F.translate(text, "<>", "  ")).otherwise(text)
    text = F.lower(F.regexp_replace(text, NAME, f"<name{value(0)}>"))
    if tagged:  # digits in a name's place stay in the name
        numbered = F.regexp_replace(text, rf"(<name:[^<>]*+>)|({NUMBER})", "$1<num:$2>")
        numbered = F.regexp_replace(numbered, "<num:>", "")
    else:
        numbered = F.regexp_replace(text, NUMBER, "<num>")
    numbered = F.regexp_replace(numbered, r"(<num[^<>]*+>[" + _GAP + r"]?)(" + UNITS + r")([^\p{L}\p{N}]|$)", f"$1<unit{value(2)}>$3")
    text = F.when(digits, numbered).otherwise(text)
    text = F.regexp_replace(text, rf"(<[^<>]*+>)|[^\p{{L}}\p{{N}}{_GAP}]+", "$1")
    if tagged:  # a name of several words is one word of the template
        return F.regexp_extract_all(text, F.lit(rf"(?:<[^<>]*+>|[^<>{_GAP}]++)++"), 0)
    return F.split(F.trim(text, F.lit(SPACES)), f"[{_GAP}]+")


def _windows(words: Column, of, length: int = WINDOW) -> Column:
    """``of`` of each window's words; none where there are fewer words than ``length``."""
    at = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(words) - length))
    return F.when(F.size(words) >= length, F.transform(at, lambda i: of([F.get(words, i + k) for k in range(length)])))


def _hashed(words: Column, length: int = WINDOW) -> Column:
    return F.coalesce(_windows(words, lambda ws: F.xxhash64(*ws), length), F.array().cast("array<long>"))


def _slots(ws: list[Column]) -> Column:
    """kind and value of a tagged window's placeholders, in order. Of a name the last word counts, without the genitive's s."""
    found = F.regexp_extract_all(F.concat_ws(" ", *ws), F.lit(r"<((?:name|num|unit):[^<>]*+)>"), 1)
    value = lambda s: F.regexp_replace(F.regexp_replace(F.substring_index(s, ":", -(1 << 20)), "^[a-z]+:(?:.* )?", ""), "['’]s?$", "")
    return F.transform(found, lambda s: F.struct(F.substring_index(s, ":", 1).alias("kind"), value(s).alias("value")))


def _untagged(ws: list[Column]) -> Column:
    return F.xxhash64(*(F.regexp_replace(w, _TAG, "<$1>") for w in ws))


def _item_windows(benchmark: DataFrame) -> DataFrame:
    """item_id, window, literal, template: an item's different windows and the readings that have them. An item of
    fewer than five words has one literal window; one of fewer than five template words has no template window."""
    words = benchmark.select("item_id", literal_words(text_or_empty()).alias("words"), template_words(text_or_empty()).alias("parts")).filter(F.array_join("words", "") != "")
    own = F.when(F.size("words") >= WINDOW, _hashed(F.col("words")))
    for n in range(1, WINDOW):
        own = own.when(F.size("words") == n, _hashed(F.col("words"), n))
    both = F.concat(F.transform(own, lambda w: F.struct(w.alias("window"), F.lit(True).alias("literal"))), F.transform(_hashed(F.col("parts")), lambda w: F.struct(w.alias("window"), F.lit(False).alias("literal"))))
    rows = words.select("item_id", F.least(F.size("words"), F.lit(WINDOW)).alias("length"), F.explode(both).alias("w"))
    return rows.groupBy("item_id", "w.window").agg(F.bool_or("w.literal").alias("literal"), F.bool_or(~F.col("w.literal")).alias("template"), F.min("length").alias("length"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """The pairs of document and item that leak: doc_id, item_id, matched (windows), windows (of the item), kind.

    docs: doc_id, text; benchmark: item_id, text; other columns are ignored. kind is ``verbatim`` (``share`` of the literal windows; matched and
    windows count these) or ``reparameterised`` (of the template's, with consistent values). Rows with the same doc_id are one document, with the
    same item_id one item. Null texts, and texts without words, hold no window and never match. An item of fewer than five words
    leaks where its words stand in a row. Null ids are kept as ids. An empty table gives no rows.
    """
    folder = workspace(docs.sparkSession, "decontaminate")
    items = written(_item_windows(benchmark), f"{folder}/items")
    found = items.agg(F.count(F.lit(1)).alias("n"), F.collect_set("length").alias("lengths")).first()
    hinted = F.broadcast if found.n <= broadcast_windows else (lambda df: df)
    literal, template = F.col("literal"), F.col("template")
    sizes = items.groupBy(F.col("item_id").alias("i")).agg(F.count_if(literal).alias("literals"), F.count_if(template).alias("templates"))
    words, parts = literal_words(F.col("text")), template_words(F.col("text"))
    texts = docs.select("doc_id", text_or_empty().alias("text"))
    texts = texts.select("doc_id", words.alias("words"), F.when(F.col("text").rlike(r"[\p{Lu}0-9]"), parts).alias("parts"))
    # A template window without placeholders is a literal one, so the union has it once.
    windows = F.array_union(_hashed(F.col("words")), F.coalesce(_hashed(F.col("parts")), F.array().cast("array<long>")))
    for n in sorted(n for n in found.lengths if n < WINDOW):
        windows = F.concat(windows, _hashed(F.col("words"), n))
    matched = texts.select("doc_id", F.explode(windows).alias("window")).join(hinted(items), "window")
    matched = matched.groupBy("doc_id", "item_id").agg(F.count_distinct(F.when(literal, F.col("window"))).alias("literal"), F.count_distinct(F.when(template, F.col("window"))).alias("template"))
    pairs = matched.join(hinted(sizes), F.col("item_id").eqNullSafe(F.col("i")))
    verbatim = literal >= F.col("literals") * share
    pairs = pairs.filter(verbatim | ((F.col("templates") > 0) & (template >= F.col("templates") * share)))
    pairs = written(pairs.select("doc_id", "item_id", "literal", "literals", "template", "templates", verbatim.alias("verbatim")), f"{folder}/pairs")
    sure = pairs.filter("verbatim").select("doc_id", "item_id", F.col("literal").alias("matched"), F.col("literals").alias("windows"), F.lit("verbatim").alias("kind"))
    candidates = pairs.filter("NOT verbatim").select("doc_id", "item_id", F.col("template").alias("matched"), F.col("templates").alias("windows"))
    return sure if candidates.isEmpty() else sure.unionByName(_consistent(docs, benchmark, candidates, hinted))


def _consistent(docs: DataFrame, benchmark: DataFrame, pairs: DataFrame, hinted) -> DataFrame:
    """The re-parameterised ones of ``pairs``: values fit over the whole document, in an occurrence by itself, or are the item's
    own in most windows. Only texts with such a pair are read again."""
    both = lambda words: F.arrays_zip(_windows(words, _untagged).alias("window"), _windows(words, _slots).alias("values"))
    tagged = benchmark.select(F.col("item_id").alias("i"), template_words(text_or_empty(), tagged=True).alias("words")).filter(F.size("words") >= WINDOW)
    item_windows = tagged.select("i", F.xxhash64("words").alias("item_row"), both(F.col("words")).alias("all"))
    item_windows = item_windows.select("i", "item_row", F.size(F.array_distinct("all.window")).alias("row_windows"), F.posexplode("all").alias("item_at", "w"))
    item_windows = item_windows.select("i", "item_row", "row_windows", "item_at", F.col("w.window").alias("window"), F.col("w.values").alias("item_values")).distinct()
    item_slots = item_windows.select("i", "window", "item_values").filter(F.size("item_values") > 0).distinct()
    slot_windows = item_slots.groupBy("i").agg(F.count_distinct("window").alias("slot_windows"))
    ids = pairs.select(F.col("doc_id").alias("d"), "item_id").distinct()
    mine = docs.select("doc_id", text_or_empty().alias("text")).join(ids.select("d").distinct(), F.col("doc_id").eqNullSafe(F.col("d")), "left_semi")
    mine = mine.select("doc_id", template_words(F.col("text"), tagged=True).alias("words")).filter(F.size("words") >= WINDOW)
    mine = mine.select("doc_id", F.xxhash64("words").alias("doc_row"), F.posexplode(both(F.col("words"))).alias("doc_at", "w"))
    mine = mine.select("doc_id", "doc_row", "doc_at", F.col("w.window").alias("window"), F.col("w.values").alias("values"))
    of_ids = F.col("doc_id").eqNullSafe(F.col("d")) & F.col("i").eqNullSafe(F.col("item_id"))
    met = mine.select("doc_id", "window", "values").filter(F.size("values") > 0).distinct().join(hinted(item_slots), "window").join(ids, of_ids)
    equal = met.filter(F.col("values") == F.col("item_values")).groupBy("doc_id", "item_id").agg(F.count_distinct("window").alias("equal"))
    whole = _judged(met.select("doc_id", "item_id", F.explode(F.arrays_zip("item_values", "values")).alias("v")), ["doc_id", "item_id"])
    aligned = _occurrences(mine.join(hinted(item_windows), "window").join(ids, of_ids))
    out = pairs.alias("p")
    for name, other in (("whole", whole), ("aligned", aligned), ("equal", equal)):
        out = out.join(other.alias(name), F.col("p.doc_id").eqNullSafe(F.col(f"{name}.doc_id")) & F.col("p.item_id").eqNullSafe(F.col(f"{name}.item_id")), "left")
    out = out.join(hinted(slot_windows), F.col("p.item_id").eqNullSafe(F.col("i")), "left")
    fits = (F.col("whole.consistent") >= SHARE) | F.coalesce("aligned.fits", F.lit(False)) | (F.col("equal") >= F.col("slot_windows") * SHARE)
    return out.filter(F.col("slot_windows").isNull() | fits).select("p.doc_id", "p.item_id", "matched", "windows", F.lit("reparameterised").alias("kind"))


def _judged(met: DataFrame, by: list[str]) -> DataFrame:
    """``consistent`` of each group: the share of the item's values that meet one value, for names one that no other of the item's names meets.
    Numbers may coincide: two different ones of a question are often the same in a variant. met: by, v (item_values, values)."""
    met = met.select(*by, F.col("v.item_values.kind").alias("kind"), F.col("v.item_values.value").alias("item_value"), F.col("v.values.value").alias("value")).distinct()
    alone = lambda c: F.count(F.lit(1)).over(Window.partitionBy(*by, "kind", c)) == 1
    met = met.select(*by, "kind", "item_value", (alone("item_value") & ((F.col("kind") != "name") | alone("value"))).alias("fits"))
    return met.groupBy(*by, "kind", "item_value").agg(F.bool_and("fits").cast("double").alias("fits")).groupBy(*by).agg(F.avg("fits").alias("consistent"))


def _occurrences(met: DataFrame) -> DataFrame:
    """doc_id, item_id, fits: whether an occurrence has consistent values.

    An occurrence is a row of the document, one of the item and the offset between them. Each window of the item takes its nearest place
    there, off by up to a fifth of the item's windows, so that words put in or left out don't end an occurrence. It
    counts if it has 0.8 of the row's different windows.
    """
    offset, slack = F.col("doc_at") - F.col("item_at"), F.floor(F.col("row_windows") * (1 - SHARE)).cast("int")
    keys = ["doc_id", "item_id", "doc_row", "item_row", "anchor"]
    near = met.withColumn("anchor", F.explode(F.sequence(offset - slack, offset + slack)))
    place = F.min(F.struct(F.abs(offset - F.col("anchor")), "doc_at", "window", "item_values", "values")).alias("place")
    near = near.groupBy(*keys, "item_at", "row_windows").agg(place).select(F.struct(*keys).alias("at"), "row_windows", "place.*")
    enough = near.groupBy("at", "row_windows").agg(F.count_distinct("window").alias("covered")).filter(F.col("covered") >= F.col("row_windows") * SHARE)
    judged = _judged(near.select("at", F.explode(F.arrays_zip("item_values", "values")).alias("v")), ["at"]).join(enough.select("at"), "at")
    return judged.groupBy("at.doc_id", "at.item_id").agg(F.bool_or(F.col("consistent") >= SHARE).alias("fits"))


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that leak no item of the benchmark. Rows with the same doc_id are one document; a null doc_id is an
    id like any other. The ids are written first, so that Spark knows their size and broadcasts a few instead of shuffling texts."""
    leaks = written(decontaminate(docs, benchmark).select("doc_id").distinct(), f"{workspace(docs.sparkSession, 'leaks')}/ids").alias("leaks")
    return docs.alias("docs").join(leaks, F.col("docs.doc_id").eqNullSafe(F.col("leaks.doc_id")), "left_anti")
