"""Personal data: base spans and digest against Python's regular expressions, added spans on sentences the trees haven't seen."""

import hashlib
import re

from pyspark.sql import functions as F

from grainflow.llm.pii import TRAINING, digest, examples, find_personal_data, fit, redacted, scored
from grainflow.llm.queries import QUERIES
from tests.llm.helpers import SF, docs_frame

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _passes(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def brute(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text) if _passes(k, m[0])]


def check(rows, texts):
    for r in rows:
        want = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), texts[r.doc_id][:200]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(w.startswith(k) for w in want) for k in PATTERNS)
        assert set(want) <= set(r.spans.split(",")) | {""}


def test_query_against_brute_force(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op4_pii_boosting"](spark, SF).collect()
    assert len(rows) == len(texts)
    check(rows, texts)


def test_hard_texts(spark):
    odd = [
        None, "", "a@b.c%d@e.f g@h", "x" * 60_000 + "@y.z", "1." * 30_000, "7" * 60_000, "é😀 a.b@c.de 😀+1 (017) 555-7713!", "1.2.3.4.5.6.7.8", "256.1.1.1 000001.2.3.4",
        "4111 1111 1111 1111 and 4111-1111-1111-1112", "4111111111111111 22", "+1" + " " * 9000 + "2 +49 30 1234567", "@@.@ +  +1", "a@b..c a@-.-", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6",
    ]
    rows = [(i, t) for i, t in enumerate(odd)] + [(0, None)]
    found = find_personal_data(docs_frame(spark, rows).withColumn("base", F.lit(1)).withColumn("spans", F.lit("x")), fit(spark))
    out = digest(found).collect()
    assert len(out) == len(rows)
    check(out, {i: t or "" for i, t in enumerate(odd)})
    assert find_personal_data(docs_frame(spark, []), fit(spark)).count() == 0
    clean = {r.doc_id: r.text for r in redacted(found).collect()}
    assert clean[6] == "é😀 [email] 😀[phone]!" and clean[1] == ""


def test_trees_add_what_base_patterns_miss(spark):
    rows = [(1, "Write to jane.doe (at) example.org please"), (2, "call (212) 555-0187 today"), (3, "order 9355130512476003 shipped"), (4, "release 4.2.1.7 is out, section 10.4.2"), (5, "on 2024-05-17 we met at noon")]
    found = {r.doc_id: r for r in digest(find_personal_data(docs_frame(spark, rows), fit(spark))).collect()}
    assert found[1].spans == "email:9:34" and found[1].n_email == 0
    assert found[2].spans == "phone:5:19"
    assert found[3].spans == "" and found[5].spans == ""


def test_precision_and_recall_on_new_sentences(spark):
    model = fit(spark)
    new = examples(spark, TRAINING + 4000).filter(F.col("id") >= TRAINING)
    least = F.create_map(*(x for k, v in model.thresholds.items() for x in (F.lit(k), F.lit(v))))
    rated = new.select("kind", "y", F.get(F.transform(F.array("f"), lambda f: scored(model, f)), F.lit(0)).alias("score"))
    for r in rated.groupBy("kind").agg(F.sum((F.col("score") >= least[F.col("kind")]).cast("int") * F.col("y")).alias("hit"), F.sum("y").alias("all"), F.sum((F.col("score") >= least[F.col("kind")]).cast("int")).alias("said")).collect():
        assert r.hit / r.said > 0.9 and r.hit / r.all > 0.8, r


#: Sentences that no frame of the trees' own has; personal data stands in «».
MARKED = {
    "email": [
        "If anything breaks, ping «lena.hofer (at) mailbox.org» and she will look.", "Bewerbungen bitte an «jobs [at] nordwerk [dot] de» senden.", "Pour toute question : «claire.petit AT exemple DOT fr», merci.", "Puedes escribir a nadie o a «ana.ruiz [at] correo.es».",
        "My old address «tom99 at webmail dot com» no longer works.", "send logs to «ops{at}cluster{dot}io» overnight", "— «j.doe @ example.org», Boston", "Ihr erreicht mich unter «k.braun(at)uni-koeln.de» jederzeit.", "Author: «priya [AT] lab-seven.edu»",
        "REACH ME: «SALES AT BIGSHOP DOT COM»", "forwarded by «m.rossi@posta.it» yesterday", "He signed as «webmaster [at] gardenclub.net» every time.",
    ],
    "ip": [
        "The login came from «203.0.113.77» at night.", "Bitte «10.20.30.41» in der Firewall sperren.", "La machine «192.168.44.5» ne répond plus.", "El servidor «172.16.9.200» está caído.", "ping «198.51.100.23» failed twice", "traffic between «10.0.0.8» and «10.0.0.9» doubled",
        "banned: «185.220.101.4»", "Her router is at «192.168.178.1», she said.", "from [«66.249.66.12»] GET /index", "DNS points to «93.184.216.34» now",
    ],
    "card": [
        "He paid with «4111 1111 1111 1111» and left.", "Meine Kreditkarte «5500-0000-0000-0004» wurde gesperrt.", "Numéro de carte : «4012.8888.8888.1881», expire bientôt.", "Mi tarjeta es «6011 0009 9013 9424», no la pierdas.", "amex «3782 822463 10005» was declined", "cc «371449635398431» exp 09/29", "They stored «5105105105105100» in plain text.",
        "please charge «4000/0566/5566/5556»", "visa: «4012888888881881»", "The number «5555 5555 5555 4444» is on the receipt.",
    ],
    "phone": [
        "Just dial «212-555-0187» after six.", "Ruf mich an: «030 1234567», danke!", "Appelez le «01 44 55 66 77» ce soir.", "Llame al «912 345 678» por la tarde.", "Her cell is «(415) 555-2671», text only.", "tel. «+49 (0)89 998877-12» Büro", "Fax: «0221/4567890»", "WhatsApp «+34 612 345 678» anytime", "you can reach Sam on «646.555.0119»",
        "Telefon «0176-55512345» (mobil)", "Our hotline, «1-800-555-0134», never sleeps.", "phone «020 7946 0958» works",
    ],
}
#: Look-alikes.
INNOCENT = [
    "We met at noon and stayed at home.", "The score was 3 at half time.", "She looked at maps at length.", "The shop at the corner sells tea.", "Order 212-5550-18 was sent back.", "Rechnung 4711-2024-0815 ist offen.", "Release 2.4.1 fixed section 3.2.1.7 of the guide.", "From 1914-1918 to 1939-1945.", "ISBN 978-3-16-148410-0 is out of print.",
    "Between 2019.05.12 and 2020.11.30 nothing happened.", "Population rose from 1 234 567 to 2 345 678.", "pages 112-118, 240-251 and 300", "The ratio was 16:9, then 4:3.", "Total: 12.450.300,00 euros", "tracking 1Z 999 AA1 01 2345 6784", "Serial 4111111111111112 failed.", "values 256.300.1.900 are wrong", "version 10.4.300.2", "Coordinates 48.8584, 2.2945",
    "Bestellung 20240517123456 vom 17.05.2024", "follow @garden_club today", "price @ 20 each", "At 10:15:30 the log says 10:15:31.", "Chapter 12, verses 3-7, lines 40-52", "the year 2024 and the number 1000000", "facture 88 2024 17", "He ran 10.5 km in 45.30 minutes.", "dot com bubbles burst at last", "room 214 at level 3", "Model X-200-300-400 is sold out.",
]


def test_labelled_sentences_of_other_templates(spark):
    """Of each kind nine in ten are found as a whole; nineteen in twenty of all that is said is right."""
    rows, want, k = [], {}, 0
    for kind, sentences in MARKED.items():
        for sentence in sentences:
            parts = re.split("[«»]", sentence)
            at = [len("".join(parts[:i])) for i in range(len(parts))]
            want[k] = {(kind, at[i], at[i] + len(parts[i])) for i in range(1, len(parts), 2)}
            rows.append((k, "".join(parts)))
            k += 1
    for sentence in INNOCENT:
        rows.append((k, sentence))
        want[k] = set()
        k += 1
    got = {r.doc_id: {(s.kind, s.start, s.end) for s in r.spans} for r in find_personal_data(docs_frame(spark, rows), fit(spark)).collect()}
    texts, said, right = dict(rows), 0, 0
    for kind in MARKED:
        mine = [(d, w) for d, ws in want.items() for w in ws if w[0] == kind]
        lost = [texts[d][w[1] : w[2]] for d, w in mine if w not in got[d]]
        assert len(lost) <= 0.1 * len(mine), (kind, lost)
    wrong = [(kind, texts[d][a:b]) for d in want for kind, a, b in got[d] - want[d]]
    said = sum(map(len, got.values()))
    assert len(wrong) <= 0.05 * said, wrong


def test_equal_scores_in_long_arrays(spark):
    """Spans with equal places and scores are ordered as well: hundreds of numbers that two generators propose."""
    text = "pay 4111 1111 1111 1111 or call 212-555-0187, " * 400
    found = find_personal_data(docs_frame(spark, [(1, text)]), fit(spark)).first()
    assert len(found.spans) >= 400 and len(found.base) == 400


def test_a_text_with_very_many_spans(spark):
    """Runs of spans join as one list does: every address is found where it is, and the overlapping ones at the runs' ends too."""
    text = "".join(f"mail a{k}@b.c, 10.0.{k % 250}.7 call 0{k % 900 + 100} 555 {k % 9000 + 1000} " for k in range(20_000))
    found = find_personal_data(docs_frame(spark, [(1, text)]), fit(spark))
    check(digest(found).collect(), {1: text})
    spans = sorted((s.start, s.end, s.kind) for s in found.first().spans)
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:])) and all(text[a:b] == s.value for s in found.first().spans for a, b in [(s.start, s.end)])
