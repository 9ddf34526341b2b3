"""Personal data: candidate generators, gradient-boosted trees, calibrated thresholds. DataFrame functions only.

Generators propose spans with high recall. Boosted trees score each from its format and context, and a threshold for each
kind, calibrated on examples that the trees haven't seen, selects. Base spans (fixed patterns and tests) always stay.

The trees learn from ``TRAINING`` made-up sentences, personal data and look-alikes, which SQL expressions write out; no
text of the corpus is used, so a corpus of any size is scored alike. The fitted trees become column expressions.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grainflow.llm.common import text_or_empty
from grainflow.llm.pii_spans import KINDS, SPAN, base_spans, candidate_spans, features, let, run_of, runs_of, shown

#: Made-up sentences; a quarter of them calibrate the thresholds.
TRAINING, TREES, DEPTH, PRECISION = 10_000, 16, 5, 0.98


def _w(k: int) -> str:
    return f"w{k}"


def _n(k: int, n: int | str) -> str:
    return f"substr(n{k}, 1, {n})"


def _p(k: int, n: int) -> str:
    return f"pmod(p{k}, {n})"


def _luhn_tail(body: str, want: bool) -> str:
    """``body`` (15 digits) and a last digit that passes the Luhn test, or one that doesn't."""
    digit = lambda i: f"cast(substr({body}, {i + 1}, 1) as int)"
    total = " + ".join(f"({digit(i)} * 2 - if({digit(i)} > 4, 9, 0))" if i % 2 == 0 else digit(i) for i in range(15))
    last = f"pmod(10 - pmod({total}, 10), 10)"
    return f"concat({body}, {last if want else f'pmod({last} + 1 + {_p(77, 9)}, 10)'})"


def _grouped(card: str, by: str) -> str:
    return "concat_ws('" + by + "', " + ", ".join(f"substr({card}, {1 + 4 * i}, 4)" for i in range(4)) + ")"


def _short_card(body: str, want: bool) -> str:
    """``body`` (14 digits) and a last digit that makes 15 digits pass the Luhn test, or one that doesn't."""
    digit = lambda i: f"cast(substr({body}, {i + 1}, 1) as int)"
    total = " + ".join(f"({digit(i)} * 2 - if({digit(i)} > 4, 9, 0))" if i % 2 == 1 else digit(i) for i in range(14))
    last = f"pmod(10 - pmod({total}, 10), 10)"
    return f"concat({body}, {last if want else f'pmod({last} + 1 + {_p(77, 9)}, 10)'})"


def _amex(card: str, by: str) -> str:
    return f"concat_ws('{by}', substr({card}, 1, 4), substr({card}, 5, 6), substr({card}, 11, 5))"


def _ip(most: int) -> str:
    return "concat_ws('.', " + ", ".join(_p(k, most) for k in range(20, 24)) + ")"


#: Numbers that several frames share, each a column of its own, so that it is made once a row.
_SHARED = {"good": _luhn_tail(_n(1, 15), True), "bad": _luhn_tail(_n(1, 15), False), "amex": _short_card(f"concat('3', {_n(1, 13)})", True), "no_amex": _short_card(f"concat('3', {_n(1, 13)})", False)}
_GOOD, _BAD, _AMEX, _NO_AMEX = _SHARED
_TLD = f"element_at(array('com', 'org', 'net', 'de', 'fr', 'es', 'io'), 1 + {_p(5, 7)})"
_PHONE = f"concat('(', {_n(2, 3)}, ') ', {_n(3, 3)}, '-', {_n(4, 4)})"
_THREE = lambda by: f"concat_ws('{by}', concat(1 + {_p(6, 9)}, {_n(2, 2)}), {_n(3, 3)}, {_n(4, 4)})"
_PAIRS = lambda by: f"concat_ws('{by}', concat('0', 1 + {_p(6, 9)}), {_n(2, 2)}, {_n(3, 2)}, {_n(4, 2)}, {_n(5, 2)})"
_CALLS = ["phone", "call", "tel", "mobile", "téléphone", "telefon", "teléfono", "llame al", "cell", ""]
_MAILS = ["email", "contact", "mail", "write to", "correo", "kontakt", "courriel", "escribe a", ""]
#: Sentence frames: kind, whether the value is personal data, words before it, an expression for the value.
_FRAMES: list[tuple[str, int, list[str], str]] = [
    ("email", 1, ["email", "write to", "contact", "", "mail"], f"concat({_w(1)}, '.', {_w(2)}, '@', {_w(3)}, '.', {_TLD})"),
    ("email", 1, ["email", "contact", "mail", "write to", ""], f"concat({_w(1)}, ' (at) ', {_w(3)}, '.', {_TLD})"),
    ("email", 1, ["email", "contact", "mail", "correo", ""], f"concat({_w(1)}, ' [at] ', {_w(3)}, ' [dot] ', {_TLD})"),
    ("email", 1, ["email", "contact me", "mail", "courriel"], f"concat({_w(1)}, ' at ', {_w(3)}, ' dot ', {_TLD})"),
    ("email", 0, ["meet", "was", "seen", "", "the", "he looked", "contact", "server"], f"concat({_w(1)}, ' at ', {_w(3)})"),
    ("email", 0, ["price", "", "sold", "rate", "total"], f"concat({_w(1)}, ' @', {_n(2, 2)})"),
    ("email", 0, ["follow", "", "user", "thanks"], f"concat({_w(1)}, '@', {_w(2)})"),
    ("email", 0, ["look", "arrive", "", "the", "it was"], f"concat({_w(1)}, ' at ', {_w(3)}, '.', {_w(4)})"),
    ("ip", 1, ["ip", "server", "host", "", "from client"], _ip(256)),
    ("ip", 0, ["version", "release", "section", "build", "chapter"], "concat_ws('.', " + ", ".join(_p(k, 12) for k in range(20, 24)) + ")"),
    ("ip", 0, ["", "id", "number", "the"], "concat_ws('.', " + ", ".join(f"256 + {_p(k, 700)}" for k in range(20, 24)) + ")"),
    ("ip", 0, ["", "the", "values", "scores"], "concat_ws(', ', " + ", ".join(_p(k, 300) for k in range(20, 24)) + ")"),
    ("card", 1, ["card", "visa", "payment card", "", "karte"], _GOOD),
    ("card", 1, ["card", "visa", "", "carte", "credit"], _grouped(_GOOD, " ")),
    ("card", 1, ["card", "visa", "", "tarjeta"], _grouped(_GOOD, ".")),
    ("card", 0, ["order", "", "serial", "invoice", "number", "id", "the"], _BAD),
    ("card", 0, ["", "order", "serial", "code"], _grouped(_BAD, " ")),
    ("card", 0, ["isbn", "date", "", "number"], _n(1, f"12 + {_p(9, 3)}")),
    ("phone", 1, ["phone", "call", "tel", "", "mobile"], f"concat('+', {_n(5, 1)}, ' ', {_PHONE})"),
    ("phone", 1, ["phone", "call me on", "tel", "fax", "whatsapp"], _PHONE),
    ("phone", 1, ["phone", "call", "telefon", "mobile", "handy"], f"concat('0', {_n(2, 3)}, ' ', {_n(3, 3)}, ' ', {_n(4, 4)})"),
    ("email", 1, _MAILS, f"concat({_w(1)}, '.', {_w(2)}, ' AT ', {_w(3)}, ' DOT ', upper({_TLD}))"),
    ("email", 1, _MAILS, f"concat({_w(1)}, '{{at}}', {_w(3)}, '{{dot}}', {_TLD})"),
    ("email", 1, _MAILS, f"concat({_w(1)}, '_', {_w(2)}, ' (AT) ', {_w(3)}, '.', {_TLD})"),
    ("email", 1, _MAILS, f"concat({_w(1)}, ' @ ', {_w(3)}, '.', {_TLD})"),
    ("email", 1, _MAILS, f"concat({_w(1)}, '[at]', {_w(3)}, '-', {_w(4)}, '[dot]', {_TLD})"),
    ("email", 0, ["we met", "she stayed", "", "the shop"], f"concat({_w(1)}, ' AT ', upper({_w(3)}))"),
    ("card", 1, ["card", "amex", "credit card", "karte", "carte", ""], _AMEX),
    ("card", 1, ["card", "amex", "tarjeta", "kreditkarte", ""], _amex(_AMEX, " ")),
    ("card", 1, ["amex", "card", ""], _amex(_AMEX, "-")),
    ("card", 0, ["order", "serial", "", "tracking", "ref"], _NO_AMEX),
    ("card", 0, ["order", "invoice", ""], _amex(_NO_AMEX, " ")),
    ("card", 1, ["card", "visa", ""], _grouped(_GOOD, "/")),
    ("phone", 1, _CALLS, _THREE("-")),
    ("phone", 1, _CALLS, _THREE(".")),
    ("phone", 1, _CALLS, _THREE(" ")),
    ("phone", 1, _CALLS, _PAIRS(" ")),
    ("phone", 1, _CALLS, _PAIRS(".")),
    ("phone", 1, _CALLS, f"concat('0', {_n(2, 3)}, '/', {_n(3, 7)})"),
    ("phone", 1, _CALLS, f"concat('0', {_n(2, 2)}, '-', {_n(3, 8)})"),
    ("phone", 1, ["phone", "tel", "call", "teléfono"], f"concat(6 + {_p(6, 4)}, {_n(2, 2)}, ' ', {_n(3, 3)}, ' ', {_n(4, 3)})"),
    ("phone", 1, ["phone", "tel", "call", "sms"], f"concat({_n(2, 3)}, ' ', {_n(3, 4)}, ' ', {_n(4, 4)})"),
    ("phone", 0, ["order", "invoice", "serial", "ref", "tracking", "rechnung", "commande", "pedido"], _THREE("-")),
    ("phone", 0, ["total", "price", "", "page"], f"concat({_n(3, 1)}, '.', {_n(4, 3)}, '.', {_n(5, 3)})"),
    ("phone", 0, ["date", "on", "am", "le", "el", ""], f"concat('1', {_p(9, 10)}, '.0', 1 + {_p(6, 8)}, '.20', {_n(4, 2)})"),
    ("ip", 1, ["ip", "login from", "server", "serveur", "servidor", "router", ""], f"concat_ws(' . ', {_p(20, 256)}, {_p(21, 256)}, {_p(22, 256)}, {_p(23, 256)})"),
    ("phone", 0, ["date", "", "on", "since", "from"], f"concat('20', {_n(2, 2)}, '-0', 1 + {_p(6, 8)}, '-1', {_n(4, 1)})"),
    ("phone", 0, ["order", "", "id", "invoice", "number", "page", "the", "total"], _n(3, f"7 + {_p(9, 8)}")),
    ("phone", 0, ["pages", "figure", "", "price", "section"], f"concat({_n(3, 3)}, ' ', {_n(4, 3)}, ' ', {_n(5, 3)})"),
    ("phone", 0, ["", "years", "the", "in"], f"concat({_n(3, 4)}-', '-{_n(4, 4)})".replace("-', '-", ", '-', ")),
]


@dataclass(frozen=True)
class Model:
    """trees: nested (feature, threshold, left, right) or a number, with their weights; thresholds: least score by kind."""

    trees: tuple
    weights: tuple
    thresholds: dict


def made_up(spark: SparkSession, rows: int = TRAINING) -> DataFrame:
    """id, kind, label and text of the sentences that the trees learn from."""
    frames = len(_FRAMES)
    value = "CASE pmod(id, {}) {} END".format(frames, " ".join(f"WHEN {k} THEN {v}" for k, (_, _, _, v) in enumerate(_FRAMES)))
    lead = "CASE pmod(id, {}) {} END".format(frames, " ".join("WHEN {} THEN element_at(array({}), 1 + pmod(hash(id, 'lead'), {}))".format(k, ", ".join(f"'{x}'" for x in leads), len(leads)) for k, (_, _, leads, _) in enumerate(_FRAMES)))
    kind = "CASE pmod(id, {}) {} END".format(frames, " ".join(f"WHEN {k} THEN '{kind}'" for k, (kind, *_) in enumerate(_FRAMES)))
    label = "CASE pmod(id, {}) {} END".format(frames, " ".join(f"WHEN {k} THEN {y}" for k, (_, y, _, _) in enumerate(_FRAMES)))
    words = [f"substr(translate(sha1(concat('w', id, 'k', {k})), '0123456789', 'ghijklmnop'), 1, 3 + pmod(hash(id, {k}), 6)) AS w{k}" for k in (1, 2, 3, 4, 30, 31, 32)]
    numbers = [f"substr(translate(sha2(concat('n', id, 'k', {k}), 256), 'abcdef', '246813'), 1, 20) AS n{k}" for k in range(1, 6)]
    draws = [f"hash(id, {k}, 'p') AS p{k}" for k in (5, 6, 9, 20, 21, 22, 23, 77)]
    parts = spark.range(0, rows, 1, 8).selectExpr("id", *words, *numbers, *draws)
    parts = parts.selectExpr("*", *(f"{v} AS {k}" for k, v in _SHARED.items()))
    parts = parts.selectExpr("id", f"{kind} AS kind", f"{label} AS label", f"{lead} AS lead", f"{value} AS value", "w30", "w31", "w32")
    mark = F.element_at(F.array(F.lit(" "), F.lit(": "), F.lit(" ")), 1 + F.pmod(F.hash("id", F.lit("m")), F.lit(3)))
    text = F.concat("w30", F.lit(" "), "w31", F.lit(" "), "lead", mark)
    return parts.select("id", "kind", "label", F.length(text).alias("start"), (F.length(text) + F.length("value")).alias("end"), F.concat(text, "value", F.lit(" "), "w32", F.lit(".")).alias("text"))


def examples(spark: SparkSession, rows: int = TRAINING) -> DataFrame:
    """A row for each candidate in the made-up sentences: id, kind, y and f (features). A candidate is personal data if it has the
    kind and the place of one; one that reaches further, or has another kind, is a look-alike."""
    place = lambda s: (s["kind"] == F.col("kind")) & (s["start"] == F.col("start")) & (s["end"] == F.col("end"))
    described = lambda s: F.struct(s["kind"].alias("kind"), ((F.col("label") == 1) & place(s)).cast("double").alias("y"), F.array(*features(s)).alias("f"))
    spans = made_up(spark, rows).withColumn("spans", candidate_spans(F.col("text")))
    return spans.select("id", F.explode(F.transform("spans", described)).alias("x")).select("id", "x.kind", "x.y", "x.f")


def _walk(node):
    if node.getClass().getSimpleName() == "LeafNode":
        return float(node.prediction())
    split = node.split()
    return (int(split.featureIndex()), float(split.threshold()), _walk(node.leftChild()), _walk(node.rightChild()))


def _value(tree, f: Column) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    feature, threshold, left, right = tree
    return F.when(f[feature] <= threshold, _value(left, f)).otherwise(_value(right, f))


def scored(model: Model, f: Column) -> Column:
    """The trees' probability that a candidate with the features ``f`` (array) is personal data."""
    margin = F.lit(0.0)
    for tree, weight in zip(model.trees, model.weights):
        margin = margin + _value(tree, f) * weight
    return 1 / (1 + F.exp(-2 * margin))


def _scored_once(model: Model, f: Column) -> Column:
    """As ``scored``, inside a lambda: the trees' code is too long for one generated method."""
    return F.get(F.transform(F.array(f), lambda x: scored(model, x)), F.lit(0))


@lru_cache(maxsize=4)
def _fitted(rows: int, trees: int, depth: int, precision: float) -> Model:
    spark = SparkSession.active()
    found = examples(spark, rows).withColumn("features", array_to_vector("f")).persist()
    held = F.pmod(F.hash("id", F.lit("held")), F.lit(4)) == 0
    fitted = GBTClassifier(featuresCol="features", labelCol="y", maxIter=trees, maxDepth=depth, stepSize=0.3, seed=7, minInstancesPerNode=5).fit(found.filter(~held))
    model = Model(tuple(_walk(t._java_obj.rootNode()) for t in fitted.trees), tuple(float(w) for w in fitted.treeWeights), {})
    rated = found.filter(held).select("kind", "y", _scored_once(model, F.col("f")).alias("score"))
    # The least score of each kind from which on the share of personal data is ``precision``.
    upto = Window.partitionBy("kind").orderBy(F.col("score").desc()).rangeBetween(Window.unboundedPreceding, 0)
    share = rated.select("kind", "score", F.avg("y").over(upto).alias("share")).filter(F.col("share") >= precision)
    least = {r.kind: max(0.5, r.score) for r in share.groupBy("kind").agg(F.min("score").alias("score")).collect()}
    found.unpersist()
    return Model(model.trees, model.weights, {k: least.get(k, 1.1) for k in KINDS})


def fit(spark: SparkSession, rows: int = TRAINING, trees: int = TREES, depth: int = DEPTH, precision: float = PRECISION) -> Model:
    """The trees and thresholds. A process fits the same ones once."""
    spark.range(0)  # the session is active
    return _fitted(rows, trees, depth, precision)


def _chosen(spans: Column) -> Column:
    """Of spans by start, each with a score (null: a base span), those that overlap no base span and, of two that overlap, the one
    with the higher score, then the first. One pass, in runs: chosen spans don't overlap, so a new span meets the last one at most."""
    rated = f"struct<span:{SPAN},score:double>"
    none, nothing = F.array().cast(f"array<{rated}>"), F.lit(None).cast(rated)

    def state(chosen: Column, last: Column, taken: Column) -> Column:
        return F.struct(chosen.alias("chosen"), last.alias("last"), taken.alias("taken"))

    def step(done: Column, s: Column) -> Column:
        last, span, base = done["last"], s["span"], s["score"].isNull()
        apart = last.isNull() | (last["span"]["end"] <= span["start"])
        worse = ~base & ((span["start"] < done["taken"]) | (~apart & (s["score"] <= last["score"])))
        chosen = F.when(apart & last.isNotNull() & ~worse & ~base, F.concat(done["chosen"], F.array(last))).otherwise(done["chosen"])
        pending = F.when(base, F.when(apart, last)).when(worse, last).otherwise(s)
        return state(chosen, pending, F.when(base, F.greatest(done["taken"], span["end"])).otherwise(done["taken"]))

    def of_run(spans: Column, done: Column, k: Column) -> Column:
        run = F.aggregate(run_of(spans, k), state(none, done["last"], done["taken"]), step)
        return let(run, lambda r: state(F.concat(done["chosen"], r["chosen"]), r["last"], r["taken"]))

    whole = lambda spans: F.aggregate(runs_of(spans), state(none, nothing, F.lit(0)), lambda done, k: of_run(spans, done, k), lambda done: F.array_compact(F.concat(done["chosen"], F.array(done["last"]))))
    return let(spans, whole)


def find_personal_data(docs: DataFrame, model: Model) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, text, base (spans), spans (all of them).

    A span has kind, start and end (code points, end exclusive), value, and up to 24 characters before and after. Base spans are in the order of
    ``KINDS``, then start; so are all spans. A candidate is added if its score reaches its kind's threshold and it overlaps neither a base span
    nor a candidate with a higher score. Null texts are empty and have no spans. Repeated rows stay; other columns are ignored; an empty table gives no
    rows. Nothing is shuffled.
    """
    least = F.create_map(*(x for k, v in model.thresholds.items() for x in (F.lit(k), F.lit(float(v)))))
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    rows = rows.select("doc_id", "text", base_spans(F.col("text")).alias("base"), candidate_spans(F.col("text")).alias("proposed"))
    described = F.transform("proposed", lambda s: F.struct(s.alias("span"), F.array(*features(s)).alias("f")))
    rated = F.transform(described, lambda d: F.struct(d["span"].alias("span"), scored(model, d["f"]).alias("score")))
    passing = F.filter(rated, lambda s: s["score"] >= F.element_at(least, s["span"]["kind"]))
    certain = F.transform("base", lambda s: F.struct(s.alias("span"), F.lit(None).cast("double").alias("score")))
    rows = rows.select("doc_id", "text", "base", F.when(F.size("proposed") > 0, passing).alias("passing"))
    # By start; then base spans, then higher scores; kind and end decide between equals, so the order is whole.
    place = lambda s: F.struct(s["span"]["start"].alias("start"), F.coalesce(-s["score"], F.lit(-2.0)).alias("rank"), s["span"]["kind"].alias("kind"), s["span"]["end"].alias("end"), s.alias("s"))
    by_start = F.transform(F.array_sort(F.transform(F.concat(certain, "passing"), place)), lambda p: p["s"])
    added = F.transform(_chosen(by_start), lambda s: s["span"])
    rows = rows.select("doc_id", "text", "base", F.when(F.size("passing") > 0, added).alias("added"))
    everything = F.concat("base", F.coalesce("added", F.array().cast(f"array<{SPAN}>")))
    of_kind = lambda k: F.array_sort(F.filter(everything, lambda s: s["kind"] == k), lambda a, b: a["start"] - b["start"])
    ordered = F.concat(*map(of_kind, KINDS))
    return rows.select("doc_id", "text", "base", F.when(F.size("added") > 0, ordered).otherwise(F.col("base")).alias("spans"))


def redacted(found: DataFrame) -> DataFrame:
    """doc_id and text with each span replaced by its kind in brackets; of overlapping spans the union is replaced, named by the first."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(done: Column, s: Column) -> Column:
        inside = s["start"] < done["at"]
        gap = F.substring(F.col("text"), done["at"] + 1, s["start"] - done["at"])
        out = F.when(inside, done["out"]).otherwise(F.concat(done["out"], gap, F.lit("["), s["kind"], F.lit("]")))
        return F.struct(F.greatest(done["at"], s["end"]).alias("at"), out.alias("out"))

    by_start = F.array_sort("spans", lambda a, b: a["start"] - b["start"])
    text = F.aggregate(by_start, zero, step, lambda d: F.concat(d["out"], F.substring(F.col("text"), d["at"] + 1, F.length("text"))))
    return found.select("doc_id", F.when(F.size("spans") > 0, text).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """The counts of the base spans, their digest, and all spans as text."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(shown(F.col("base")), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))
