import random

from grainflow.llm import queries
from grainflow.llm.decontaminate import clean_documents, decontaminate, literal_words, template_words
from tests.llm.helpers import SF, docs_frame, spark_rows, sql_rows

PROSE = "the quick brown fox jumps over the lazy dog and then it rests near the old mill by the river"
SUM = "if Mary has 3 apples and gives Anna 2 of them, how many apples are left for Mary after lunch with Anna at noon?"
TOLD = SUM.replace("Mary", "Robert").replace("Anna", "Eve").replace("3", "17").replace("2", "9")
MIXED = TOLD.replace("for Robert", "for Carla").replace("with Eve", "with Dora").replace("and gives Eve 9", "and gives Tom 9")
#: Names, numbers and units of a question stand in braces: n, m, k are names, a to d numbers, u and v units.
QUESTIONS = [
    "{n} has {a} marbles. {m} has {b} more marbles than {n}. How many marbles do {n} and {m} have together?",
    "{n} is saving for a bicycle that costs ${a}. {m} decided to give {n} ${b}, and {k} gave {n} twice as much as {m}. How much more does {n} need?",
    "A train leaves {n} at {a} {u} per hour while a second train leaves {m} at {b} {u} per hour. When will the trains from {n} and {m} meet?",
    "How long does it take {n} to run {a} {u} if each lap of {b} {v} takes {c} {v} more than the last one?",
    "Yesterday {n} baked {a} loaves and sold {b} of them at the market. Today {n} baked {c} more. How many loaves does {n} still have?",
    "{n}, {m} and {k} share a prize of {a} dollars. If {n} gets {b} dollars more than {m}, and {m} gets {c} dollars more than {k}, what does {k} get?",
    "In a garden there are {a} rows with {b} tulips each. {n} picks {c} tulips from every row. What share of the tulips did {n} pick?",
    "{n} drives {a} {u} to work every day. What distance does {n} cover in {b} weeks if {n} works {c} days a week and never rests?",
    "What is the total mass of {a} boxes that weigh {b} {u} each when {n} adds a lid of {c} {v} to every box?",
    "{n} read {a} pages on the first day and {b} pages on every day after that. After how many days had {n} read a book of {c} pages?",
    "Why did {n} sell the house in {m} to {k} for ${a} when {k} had offered {n} ${b} only {c} months before?",
    "The sum of two numbers that {n} chose is {a} and their difference is {b}. Find the product of the numbers that {n} chose.",
]
NAMES = "Betty Julie Anna Oscar Priya Hamid Wei Fatima Łukasz Zoë O'Neill Nguyen Ivanka Diego Amélie Boris".split() + ["Mary Ann Lee", "Jean-Luc Picard"]


def filled(question: str, seed: int) -> str:
    r = random.Random(seed)
    names, units = r.sample(NAMES, 3), r.sample(["km", "miles", "minutes", "hours", "grams", "pounds", "meters"], 2)
    return question.format(n=names[0], m=names[1], k=names[2], u=units[0], v=units[1], **{x: str(r.randint(2, 9_000)) for x in "abcd"})


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_readings(spark):
    docs = docs_frame(spark, [(1, " He <b>ran</b> 5 km with Anna Smith, paid $3.50 — 20% more!")])
    words = [r[0] for r in docs.select(template_words(docs.text)).collect()]
    assert words == [["he", "b", "ran", "b", "<num>", "<unit>", "with", "<name>", "paid", "<num>", "<num><unit>", "more"]]
    tagged = docs.select(template_words(docs.text, True)).first()[0]
    assert tagged == ["he", "b", "ran", "b", "<num:5>", "<unit:km>", "with", "<name:anna smith>", "paid", "<num:$3.50>", "<num:20><unit:%>", "more"]
    assert docs.select(literal_words(docs.text)).first()[0] == "he branb 5 km with anna smith paid 350 20 more".split()


def test_kinds(spark):
    docs = docs_frame(spark, [(1, f"some words before. {PROSE.upper()} and after"), (2, f"so {SUM}"), (3, f"so {TOLD} fine"), (4, f"so {MIXED}"), (5, PROSE[: len(PROSE) // 2]), (6, None), (7, ""), (None, PROSE), (1, "another row"), (8, "short one"), (9, "a short one"), (10, "short and one")])
    bench = items(spark, [(10, PROSE), (11, SUM), (12, None), (13, ""), (14, "Short one."), (None, PROSE)])
    for most in (1_000_000, 0):
        got = decontaminate(docs.selectExpr("*", "1 as item_id", "2 as window", "3 as words"), bench.selectExpr("*", "7 as doc_id"), broadcast_windows=most)
        assert {(r.doc_id, r.item_id, r.kind) for r in got.collect()} == {(1, 10, "verbatim"), (1, None, "verbatim"), (None, 10, "verbatim"), (None, None, "verbatim"), (2, 11, "verbatim"), (3, 11, "reparameterised"), (8, 14, "verbatim"), (9, 14, "verbatim")}


def test_short_items_of_names(spark):
    """Four words of the template and fewer have the literal reading only, so that a name may not take them anywhere."""
    item = items(spark, [(1, "When did Franklin Delano Roosevelt die?"), (2, "Paris is big")])
    docs = docs_frame(spark, [(1, "He asked: when did franklin delano roosevelt die, and why"), (2, "When did Napoleon die?"), (3, "they say Paris is big."), (4, "London is big")])
    assert {(r.doc_id, r.item_id) for r in decontaminate(docs, item).collect()} == {(1, 1), (3, 2)}


SERIES = "what comes next in 2, 4, 6, 8, 10, 12 and why"


def test_repeated_windows_and_several_variants(spark):
    told = SERIES.replace("2, 4, 6, 8, 10, 12", "3, 5, 7, 9, 11, 13")
    longer = TOLD.replace("how many apples", "tell me how many apples")
    other = SUM.replace("Mary", "Julia").replace("Anna", "Peter").replace("3", "21").replace("2", "4")
    rows = [(1, f"so {SERIES} it is"), (2, f"so {told} it is"), (3, f"so {TOLD} {other}"), (4, f"so {SUM} {TOLD}"), (5, f"so {longer} {other}"), (6, f"so {MIXED} {MIXED}"), (None, f"so {TOLD} {SUM}"), (7, f"so {TOLD} and more"), (7, f"so {other}")]
    got = decontaminate(docs_frame(spark, rows), items(spark, [(20, SERIES), (None, SUM)]))
    assert {(r.doc_id, r.item_id, r.kind) for r in got.collect()} == {(1, 20, "verbatim"), (2, 20, "reparameterised"), (3, None, "reparameterised"), (4, None, "verbatim"), (5, None, "reparameterised"), (None, None, "verbatim"), (7, None, "reparameterised")}


def test_recall_on_reparameterised_questions(spark):
    """72 variants with other names, numbers and units, in other surroundings. Look-alikes: two names made one, one name made several, other questions."""
    bench = [(k, filled(q, k)) for k, q in enumerate(QUESTIONS)]
    frames = ["{}", "Problem 7. {}", "so he asked: {} I don't know.", "{} Thanks, Peter Parker", "\n{}\n", "Hint from Maria! {}"]
    variants = [(100 * k + j, frame.format(filled(q, 1000 + 100 * k + j))) for k, q in enumerate(QUESTIONS) for j, frame in enumerate(frames)]
    got = {(r.doc_id, r.item_id): r.kind for r in decontaminate(docs_frame(spark, variants), items(spark, bench)).collect()}
    caught = sum(got.get((d, d // 100)) == "reparameterised" for d, _ in variants)
    assert caught >= 0.95 * len(variants) and len(variants) == 72
    assert all(d // 100 == i for d, i in got)
    one = lambda q: q.replace("{m}", "{n}").replace("{k}", "{n}")
    many = QUESTIONS[0].replace("{m}", "Tom", 1).replace("{n}", "Eve", 1)
    others = ["{n} has {a} marbles and {m} has {b} dollars. How many dollars does {m} need for {c} marbles of {n}?", "How long does it take {n} to paint {a} rooms if {m} helps for {b} hours and leaves {n} alone for {c} hours?", "In a garden there are {a} bees. {n} counts {b} bees on every tulip. What did {n} learn?"]
    wrong = [one(QUESTIONS[0]), one(QUESTIONS[1]), one(QUESTIONS[5]), many, *others, "Only prose, " + PROSE]
    assert decontaminate(docs_frame(spark, [(k, filled(q, 77 + k)) for k, q in enumerate(wrong)]), items(spark, bench)).count() == 0


def test_empty(spark):
    none, some = docs_frame(spark, []), docs_frame(spark, [(1, PROSE)])
    assert decontaminate(none, items(spark, [(1, SUM)])).count() == 0
    assert decontaminate(some, items(spark, [])).count() == 0
    assert clean_documents(none, items(spark, [(1, SUM)])).count() == 0
    assert clean_documents(some, items(spark, [])).count() == 1


def test_clean_documents(spark):
    docs = docs_frame(spark, [(1, PROSE), (2, "fine"), (None, PROSE), (3, None), (1, "the same document")])
    clean = clean_documents(docs.selectExpr("*", "5 AS item_id", "6 AS leaks"), items(spark, [(1, PROSE)]))
    assert sorted(tuple(r) for r in clean.select("doc_id", "text", "item_id", "leaks").collect()) == [(2, "fine", 5, 6), (3, None, 5, 6)]
    assert clean_documents(docs.filter("doc_id > 1"), items(spark, [(None, PROSE)])).count() == 2


def test_long_texts_and_repeats(spark):
    """Runs of names, parts of a number and a name's letters have no bound, nor does the stack limit them."""
    name = "X" + "y" * 5_000
    item = f"did {name} see 3 of the 4 ships that {name} had sent?"
    rows = [(1, ("filler words " * 50_000) + PROSE), (2, (PROSE + " ") * 2000), (3, "Abc " * 200_000 + PROSE), (4, "1." * 100_000 + "1 " + PROSE), (5, "7 km " * 100_000 + PROSE), (6, f"well, did {'Zw' * 3_000} see 8 of the 9 ships that {'Zw' * 3_000} had sent?")]
    rows.append((7, f"{'Abc Def ' * 100_000}. {TOLD}"))
    got = decontaminate(docs_frame(spark, rows), items(spark, [(1, PROSE), (2, PROSE), (3, item), (4, SUM)])).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(d, i) for d in range(1, 6) for i in (1, 2)} | {(6, 3), (7, 4)}
    assert all(r.matched == r.windows for r in got if r.kind == "verbatim")


def test_sql(spark):
    got = spark_rows(queries.op3_template_decontamination(spark, SF))
    assert got == sql_rows(queries.ORACLE_SQL["op3_template_decontamination"]) and got[1]
