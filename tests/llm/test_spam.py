import random

from marginalia.llm.spam import page_measures, stuffed_pages

DOC = "doc_id long, text string, lang string, n int, lang_share double"
GLUE = "the of and in to was for with on that by at from it as".split()


def corpus():
    rng = random.Random(8)
    nouns = [f"noun{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    sentence = lambda: " ".join(rng.choice(GLUE) if k % 2 else rng.choice(nouns) for k in range(rng.randrange(8, 16))).capitalize() + "."
    prose = lambda n: " ".join(sentence() for _ in range(n))
    rows = [(i, prose(rng.randrange(5, 25)), rng.choice(["en", "EN", "en-US", None, "und"])) for i in range(300)]
    phrase = lambda: " ".join(rng.sample(["cheap", "garden hose", "best", "outlet", "coupon"], 3))
    spam = [
        (1000, ", ".join(phrase() for _ in range(60)), "en"),
        (1001, "\n".join(f"https://a{i}.example/noun{i}/page-{i}" for i in range(30)), "en"),
        (1002, " ".join(f"[[note {rng.choice(nouns)}]]" for _ in range(40)), "en"),
        (1003, " ".join(f"#hose-{w}-{i}" for i, w in enumerate(["buy", "cheap", "best"] * 20)), "xx"),
        (1004, ". ".join(phrase().capitalize() for _ in range(60)) + ".", None),
        (1005, prose(1) + "\n\n" + "\n".join(f"- {phrase()}" for _ in range(60)), "en"),
    ]
    fine = [
        (2000, prose(12) + "\n\n" + "\n".join(f"- [a{i}](https://x.example/{i})" for i in range(8)), "en"),
        (2001, "\n".join(f"2024-01-{i % 28 + 1:02d} 10:{i % 60:02d}:00 {i * 7 % 90}.{i % 9}" for i in range(60)), "en"),
        (2002, "cheap hose cheap hose", "en"),
        (2003, None, "en"),
        (2004, "", "en"),
        (2005, " \n", None),
        (2006, prose(2500), "en"),
        (2007, rows[0][1], "en"),
        (2007, rows[0][1], "en"),
    ]
    return rows + spam + fine, {r[0] for r in spam}


def test_spam_is_told_from_notes(spark):
    rows, spam = corpus()
    df = spark.createDataFrame([(*r, 1, 0.5) for r in rows], DOC)
    assert {r.doc_id for r in stuffed_pages(df).collect()} == spam
    m = page_measures(df)
    assert m.count() == len(rows) - 3 and m.where("doc_id = 2007").count() == 2


def test_empty(spark):
    df = spark.createDataFrame([], DOC)
    assert stuffed_pages(df).count() == 0
    assert stuffed_pages(spark.createDataFrame([(1, None, None, 0, 0.0), (2, "", "en", 0, 0.0)], DOC)).count() == 0


def _prose(rng, glue, stem, n):
    nouns = [f"{stem}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    said = lambda: " ".join(rng.choice(glue) if k % 2 else rng.choice(nouns) for k in range(rng.randrange(9, 16))).capitalize() + "."
    return " ".join(said() for _ in range(n))


RARE = {"nl": "de het een van en dat met voor niet zijn", "fi": "ja on se että ei joka mutta kun niin oli", "xx": "ku lo mi ta ra so ne fi pu ge"}


def test_prose_of_rare_languages_is_not_reported(spark):
    rng = random.Random(4)
    rows, spam = corpus()
    pages = [(5000 + 100 * k + i, _prose(rng, glue.split(), f"{lang}w", 15), lang) for k, (lang, glue) in enumerate(RARE.items()) for i in range(20)]
    found = stuffed_pages(spark.createDataFrame([(*r, 1, 0.5) for r in rows + pages], DOC))
    assert {r.doc_id for r in found.collect()} == spam


def test_the_curve_tells_prose_without_stops(spark):
    """Verses of an unknown language: no sentences, most words repeated, but as prose repeats them."""
    rng = random.Random(9)
    rows, spam = corpus()
    glue = [w for k, w in enumerate(RARE["xx"].split()) for _ in range(12 // (k + 1))]
    tail = [f"q{i}" for i in range(60)]
    verse = lambda: "\n".join(" ".join(rng.choice(glue) if rng.random() < 0.3 else rng.choice(tail) for _ in range(7)) for _ in range(40))
    m = page_measures(spark.createDataFrame([(*r, 1, 0.5) for r in rows + [(5000 + i, verse(), "xx") for i in range(20)]], DOC)).where("doc_id >= 5000")
    assert m.where("sentences < n / 4 AND linked + repeated > n / 2").count() == 20
    assert m.where("sentences < n / 4 AND linked + keywords > n / 2").count() < 20


def test_linked_prose_is_not_odd(spark):
    rng = random.Random(6)
    rows, _ = corpus()
    linked = " ".join(f"[[{_prose(rng, GLUE, 'noun', 1)[:-1]}]] the of." for _ in range(20))
    m = page_measures(spark.createDataFrame([(*r, 1, 0.5) for r in [*rows, (9000, linked, "en")]], DOC)).where("doc_id = 9000").first()
    assert m.linked > m.n / 2 and m.sentences < m.n / 4 and not m.odd


def test_small_tables_are_judged_by_a_fixed_law(spark):
    rng = random.Random(7)
    stuffed = " ".join(rng.choice(["cheap", "garden", "hose", "outlet"]) for _ in range(80))
    df = spark.createDataFrame([(1, stuffed, "en", 1, 0.5), (2, _prose(rng, GLUE, "noun", 12), "en", 1, 0.5)], DOC)
    assert [r.doc_id for r in stuffed_pages(df).collect()] == [1]
