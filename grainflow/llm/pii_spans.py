"""Spans of text as column expressions: where patterns match, which matches are valid, and what describes them.

Matches of a pattern are leftmost and non-overlapping. Their places are found from the pieces between them, so that a
text is read once for each pattern. Patterns have no nested choice that could run long: runs are possessive, and a search starts
at the head of a run only (or where the last match ended), which changes no match but keeps the time linear in the text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
SPAN = "struct<kind:string,start:int,end:int,value:string,before:string,after:string>"

_LOCAL, _LABEL = r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9-]"
#: The base patterns, which every result has.
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without a match of these has none of the pattern above; a quick test.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}

#: High-recall generators. Those of different kinds propose overlapping spans on purpose.
GENERATORS = {
    "email": rf"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++(?: ?@ ?| ?[(\[{{](?i:at|@)[)\]}}] ?| (?i:at) ){_LABEL}++(?:(?:\.| ?[(\[{{](?i:dot|\.)[)\]}}] ?| (?i:dot) ){_LABEL}++)*+",
    "ip": r"(?:\G|(?<![0-9]))[0-9]{1,6}+(?: ?[.,:] ?[0-9]{1,6}+){3}+",
    "card": r"(?<![0-9])[0-9](?:[\x20./_-]{0,2}+[0-9]){11,22}+",
    "phone": r"(?<![0-9])[+(]?[0-9](?:[\x20()./-]{0,3}+[0-9]){6,16}+",
}
GENERATOR_NEEDS = {"email": r"@|[ (\[{](?i:at)[ )\]}]", "ip": r"[0-9] ?[.,:] ?[0-9]", "card": r"[0-9][\x20./_-]{0,2}[0-9]", "phone": r"[0-9][\x20()./-]{0,3}[0-9]"}
CONTEXT = 24
#: Matches whose spans one array gathers before the arrays are joined: appending copies an array, so a text with very many matches
#: is taken in runs, and its time stays near the number of matches.
RUN = 128


def matches(text: Column, pattern: str, needs: str, kind: str) -> Column:
    """The matches of ``pattern`` as an array of SPAN; places are code points, the end is exclusive."""
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    gaps = F.split(text, pattern, -1)
    none = F.array().cast(f"array<{SPAN}>")

    def step(done: Column, pair: Column) -> Column:
        start = done["at"] + F.length(pair["gap"])
        end = start + F.length(pair["value"])
        span = F.struct(
            F.lit(kind).alias("kind"),
            start.alias("start"),
            end.alias("end"),
            pair["value"].alias("value"),
            F.right(pair["gap"], F.lit(CONTEXT)).alias("before"),
            F.left(pair["next"], F.lit(CONTEXT)).alias("after"),
        )
        return F.struct(end.alias("at"), F.concat(done["spans"], F.array(span)).alias("spans"))

    def of_run(pairs: Column, lengths: Column, k: Column) -> Column:
        at = F.aggregate(F.slice(lengths, F.lit(1), k), F.lit(0), lambda n, m: n + m)
        return F.aggregate(run_of(pairs, k), F.struct(at.alias("at"), none.alias("spans")), step, lambda done: done["spans"])

    def spans(pairs: Column) -> Column:
        runs = runs_of(pairs)
        length = lambda k: F.aggregate(run_of(pairs, k), F.lit(0), lambda n, p: n + F.length(p["gap"]) + F.length(p["value"]))
        of_runs = let(F.transform(runs, length), lambda lengths: F.transform(runs, lambda k: of_run(pairs, lengths, k)))
        return F.flatten(of_runs)

    behind = F.slice(gaps, F.lit(2), F.size(found))
    pairs = F.filter(F.arrays_zip(found.alias("value"), gaps.alias("gap"), behind.alias("next")), lambda p: p["value"].isNotNull())
    return F.when(text.rlike(needs), let(pairs, spans)).otherwise(none)


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def runs_of(array: Column) -> Column:
    """The numbers of the runs of an array; an empty one has one run without elements."""
    return F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(array) - 1) / RUN).cast("int")))


def run_of(array: Column, k: Column) -> Column:
    return F.slice(array, k * RUN + 1, F.lit(RUN))


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test. Twice a digit, its own digits added, is 2d - 9 * (d > 4)."""
    n = F.length(digits)
    place = lambda i: F.substring(digits, n - i, F.lit(1)).cast("int")
    worth = lambda i: F.when(i % 2 == 1, place(i) * 2 - F.when(place(i) > 4, 9).otherwise(0)).otherwise(place(i))
    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda s, i: s + worth(i))
    return (n > 0) & (total % 10 == 0)


def small_parts(value: Column) -> Column:
    """Whether all parts of an address are at most 255, leading zeros or not."""
    bare = F.transform(F.regexp_extract_all(value, F.lit("[0-9]+"), 0), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    return F.forall(bare, lambda p: (F.length(p) <= 3) & (F.left(p, F.lit(3)).cast("int") <= 255))


def valid(kind: str, value: Column) -> Column:
    digits = digits_of(value)
    if kind == "ip":
        return small_parts(value)
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """The base spans, by kind and then by start. A match that fails its test is dropped and not tried again."""
    passing = lambda k: F.filter(matches(text, BASE[k], NEEDS[k], k), lambda s: valid(k, s["value"]))
    return F.concat(*map(passing, KINDS))


def candidate_spans(text: Column) -> Column:
    return F.concat(*(matches(text, GENERATORS[k], GENERATOR_NEEDS[k], k) for k in KINDS))


#: Words that say what a number or a name beside them is, in the languages of web text.
SAYS = {
    "email": "e-?mails?|mail|courriel|correo|contact|contacto|kontakt|write to|écris à|escribe a|schreib an|reach me at|adresse",
    "ip": "ip|host|server|serveur|servidor|address|adresse|dirección|client|login from|router",
    "card": "card|credit|visa|mastercard|amex|karte|kreditkarte|kartennummer|carte|tarjeta|cc",
    "phone": "phone|telephone|tel|call|fax|mobile|cell|whatsapp|telefon|telefonnummer|ruf|anrufen|tél|téléphone|appelez|teléfono|llame|llámame|handy|móvil|portable|sms|text",
    "other": "version|v|order|invoice|serial|isbn|pages?|section|id|chapter|license|number|price|total|date|figure|release|build|rechnung|bestellung|facture|commande|factura|pedido|seite|página|version|tracking|ref|reference",
}


def features(span: Column) -> list[Column]:
    """Format and context of a candidate, all doubles."""
    value, before, after = span["value"], F.lower(span["before"]), span["after"]
    digits = digits_of(value)
    n = F.length(digits)
    kind = [(span["kind"] == k) for k in KINDS]
    said = [before.rlike(rf"(?<!\p{{L}})(?:{SAYS[k]})(?!\p{{L}})") for k in (*KINDS, "other")]
    own_word = F.element_at(F.create_map(*(x for k, s in zip(KINDS, said) for x in (F.lit(k), s))), span["kind"])
    flags = [
        *kind,
        own_word,
        said[4],
        F.when((span["kind"] == "card") & n.between(12, 19), luhn(digits)).otherwise(F.lit(False)),
        F.when(span["kind"] == "ip", small_parts(value)).otherwise(F.lit(False)),
        value.rlike(r"^\+"),
        value.rlike(r"^\(?[0-9]{2,5}\)"),
        value.rlike(r"(?i)(?:\.| ?[(\[{](?:dot|\.)[)\]}] ?| dot )(?:com|org|net|edu|gov|io|info|de|fr|es|uk|eu|it|ch|at|mx|be)$"),
        value.rlike("@"),
        value.rlike(r"[(\[{]"),
        value.rlike(r"^[+(]?[0-9]{2,4}\)?[ ./-]{1,2}[0-9]{3,4}[ .-][0-9]{3,4}$"),
        value.rlike(r"^\(?0[0-9]{1,4}\)?[ ./-]"),
        value.rlike(r"^0[0-9](?:[ .-][0-9]{2}){4}$"),
        value.rlike(r"(?i) at .* dot |[(\[{](?:at|@)[)\]}]"),
        value.rlike("[ ,:]"),
        value.rlike("[./_]"),
        value.rlike(r"^[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}$"),
        value.rlike(r"^[0-9]+$"),
        value.rlike(r"[0-9]{4}-[0-9]{2}-[0-9]{2}"),
        span["before"].rlike(r"[\p{L}\p{N}_#$=/-]$"),
        after.rlike(r"^[\p{L}\p{N}_=/-]"),
    ]
    numbers = [n, F.length(value), F.size(F.split(value, "[^A-Za-z0-9]+")), F.size(F.array_distinct(F.split(digits, "")))]
    return [F.coalesce(f, F.lit(False)).cast("double") for f in flags] + [x.cast("double") for x in numbers]


def shown(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
