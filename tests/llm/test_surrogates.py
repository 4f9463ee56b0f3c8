"""Names in surrogates: words that are no names stay, people stay apart, families stay together."""

import re

from tallywright.llm import pii

KEY = "a key of the tests"


def done(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["text"] for r in pii.pseudonymised(docs, KEY).orderBy("doc_id").collect()]


def test_words_that_are_no_names_stay(spark):
    texts = [
        "Mr Smith However did it. However, it rained.", "Mr Young spoke. Young people listened to Young and young men.", "Mr De Silva left. De vez en cuando vuelve Silva.", "Herr von der Berg kam. Der Berg ist hoch, der berg. Von dort sprach Berg.",
        "Mr The end.", "Ask mr baxter or Baxter about it.", "Mr Smith", "Dr. Long Nevertheless. Mr Ab. AB said so.",
    ]
    got = done(spark, texts)
    name = r"([\w'-]+)"
    a = re.fullmatch(rf"Mr {name} However did it\. However, it rained\.", got[0]).group(1)
    b = re.fullmatch(rf"Mr {name} spoke\. Young people listened to {name} and young men\.", got[1]).groups()
    c = re.fullmatch(rf"Mr De {name} left\. De vez en cuando vuelve {name}\.", got[2]).groups()
    d = re.fullmatch(rf"Herr von der {name} kam\. Der {name} ist hoch, der berg\. Von dort sprach {name}\.", got[3]).groups()
    e = re.fullmatch(rf"Ask mr {name} or {name} about it\.", got[5]).groups()
    assert b[0] == b[1] != "Young" and c[0] == c[1] != "Silva" and d[0] == d[2] != "Berg" and d[1] in ("Berg", d[0]) and e[0] == e[1].lower() != "baxter"
    assert got[4] == texts[4] and got[6] == f"Mr {a}" and a != "Smith"
    assert len({a, b[0], c[0], d[0], e[1]}) == 5


def test_people_stay_apart_and_families_together(spark):
    texts = [
        "Mr John Smith met Mrs Smith.", "Mr Bruce Lee and Ms Anna Lee came. Lee sat, Anna stood.", "Mr Konrad Hansen and Mr Marius Jansen came. Hansen sat. Jansen stood.", "Dr Maria Weber", "Ms Weber, Frau Maria Weber and MARIA",
    ] + [f"Mr Test{chr(97 + i)}{chr(97 + j)}x and Mr Probe{chr(97 + i)}{chr(97 + j)}y spoke." for i in range(12) for j in range(12)]
    got = done(spark, texts)
    john, smith, mrs = re.fullmatch(r"Mr (\S+) (\S+) met Mrs (\S+)\.", got[0]).groups()
    assert smith == mrs and john.split("-")[0] in pii.GIVEN["latin", "m"].split()
    bruce, lee, anna, again, sat, stood = re.fullmatch(r"Mr (\S+) (\S+) and Ms (\S+) (\S+) came\. (\S+) sat, (\S+) stood\.", got[1]).groups()
    assert lee == again == sat and anna == stood and bruce.split("-")[0] in pii.GIVEN["latin", "m"].split() and anna.split("-")[0] in pii.GIVEN["latin", "f"].split()
    k, h, m, j, h2, j2 = re.fullmatch(r"Mr (\S+) (\S+) and Mr (\S+) (\S+) came\. (\S+) sat\. (\S+) stood\.", got[2]).groups()
    assert h == h2 != j == j2 and k != m
    maria, weber = re.fullmatch(r"Dr (\S+) (\S+)", got[3]).groups()
    assert got[4] == f"Ms {weber}, Frau {maria} {weber} and {maria.upper()}" and maria.split("-")[0] in pii.GIVEN["latin", "f"].split()
    pairs = [re.fullmatch(r"Mr (\S+) and Mr (\S+) spoke\.", t).groups() for t in got[5:]]
    assert len({n for p in pairs for n in p}) == 288


def test_numbers_and_domains_that_nobody_has(spark):
    texts = [f"ssn 123-45-{6000 + i}, call +1 (706) 555-{1000 + i} or +49 30 {1234567 + i}, mail x@{chr(97 + i % 26)}.com and x@{chr(97 + i % 26)}.de." for i in range(40)]
    got = done(spark, texts)
    rows = [re.fullmatch(r"ssn (\d{3})-(\d\d)-(\d{4}), call \+1 \((\d{3})\) (\d{3})-(\d{4}) or \+49 (\d\d \d{7}), mail (\S+)@(\S+) and (\S+)@(\S+)\.", t).groups() for t in got]
    assert all(r[0] in ("666", "000") or r[1] == "00" for r in rows) and len({r[:3] for r in rows}) == 40
    assert all((r[4] == "555" and r[5].startswith("01")) or r[3][1] == "9" for r in rows) and len({r[3:6] for r in rows}) == 40
    assert all(r[6].startswith("00") for r in rows) and len({r[6] for r in rows}) == 40
    domains = {t.split("@")[1].split(" ")[0].rstrip("."): r[8] for t, r in zip(texts, rows)}
    assert len(set(domains.values())) == 26 and all(".example." in d for r in rows for d in (r[8], r[10])) and not {r[8] for r in rows} & {r[10] for r in rows}
