"""Names in operator 6: no surrogate is a real name, and the format of names stays."""

import re

from corpusloom.llm import pii


def replaced(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in sorted(pii.surrogate_entities(df).collect(), key=lambda r: r.doc_id)]


def test_no_surrogate_is_a_real_name_of_any_kind(spark):
    neutral = pii.GIVEN["LN"]
    women = [f"Frau {n} Meier{i}" for i, n in enumerate(neutral)]
    texts = [f"{w.rstrip('0123456789')}x kam." for w in women] + [f"Dr. {n}a Schmidt kam." for n in neutral] + [f"Herr {n} Anna kam." for n in pii.GIVEN["LF"]]
    real = {w.lower() for t in texts for w in t.split()}
    out = replaced(spark, texts)
    for before, after in zip(texts, out):
        old, new = before.split()[1:3], after.split()[1:3]
        assert before.split()[0] == after.split()[0] and not {w.lower() for w in new} & real and len(new) == len(old)
    # Distinct names stay distinct, equal ones equal.
    one = {}
    for before, after in zip(texts, out):
        for a, b in zip(before.split()[1:3], after.split()[1:3]):
            assert one.setdefault(a, b) == b
    assert len(set(one.values())) == len(one)


def test_particles_initials_hyphens_and_capitals_stay(spark):
    texts = ["Frau Anna von Berg sprach.", "Dr. John F. Kennedy sprach.", "Frau Anna-Maria Müller-Lüdenscheidt und Müller-Lüdenscheidt.", "JOHN: Mr. JOHN SMITH", "Dr. F. Berg und Dr. G. Berg", "Mr. President and Miss Universe spoke.", "Herr O'Brien"]
    a, b, c, d, e, f, g = replaced(spark, texts)
    assert re.fullmatch(r"Frau \w+ von \w+ sprach\.", a) and "Anna" not in a and "Berg" not in a
    assert re.fullmatch(r"Dr\. \w+ [A-Z]\. \w+ sprach\.", b) and "F." not in b
    m = re.fullmatch(r"Frau (\w+)-(\w+) (\w+-\w+) und (\w+-\w+)\.", c)
    assert m and m[3] == m[4] and m[1] == a.split()[1] and "Müller" not in c and "Lüdenscheidt" not in c
    m = re.fullmatch(r"([A-Z]+): Mr\. ([A-Z]+) ([A-Z]+)", d)
    assert m and m[1] == m[2] != "JOHN" and m[2].title() == b.split()[1]
    first, second = re.fullmatch(r"Dr\. ([A-Z]\.) \w+ und Dr\. ([A-Z]\.) \w+", e).groups()
    assert first != second and f == texts[5] and g != texts[6]


def test_scripts_without_case(spark):
    out = replaced(spark, ["Dr. 王 小明 来了。", "Prof. คน ดี", "Dr. is no name", "王 小明"])
    assert out[0].startswith("Dr. ") and "王" not in out[0] and "小明" not in out[0] and "来了。" in out[0]
    assert re.match(r"Prof\. [\u0e01-\u0e2e]", out[1]) and out[1] != "Prof. คน ดี" and out[2:] == ["Dr. is no name", "王 小明"]
