import random

import pytest

from heronry.llm import truncation as T

#: Complete endings and the form they have; what a form means is learned from the source.
CLOSED = [
    "A whole sentence.", "Is it? Yes!", 'He said "so."', "Done.)", "It stays so.''", "完整的句子。", "```\nrun --x\n```", "\\begin{equation}\nx = 1\n\\end{equation}",
    "Text.\n\n{\"a\": [1, 2], \"b\": {\"c\": 1}}", "Text.\n\n| a | b |\n|---|---|\n| 1 | 2 |", "Text.\nassistant: {\"action\": \"x\"}", "<p>Text.</p>", "She left.\n\n", "It was so in 2019.",
    "She left." + " " * 100, "She left. …" + "\n" * 100,
]
#: Complete texts without a full stop: rows, code, a query, a poem, a letter's closing, an address, a long title and others.
COMPLETE = {
    "csv": "id,name,score\n1,first row,0.5\n2,second row,0.75\n3,third row,1.25",
    "python": "def keep(x):\n    y = x + 1\n    return y",
    "sql": "SELECT name, count(*) AS n\nFROM parts\nGROUP BY name\nORDER BY n DESC",
    "poem": "The water under heron wings\nis grey and slow and wide,\nand every reed that bends and sings\nbends only with the tide",
    "letter": "Thank you for the corrections. We have taken all of them.\n\nWith kind regards,\nAnna Lindqvist",
    "address": "Department of Birds\n12 Marsh Road\nSpringfield, IL 62704",
    "title": "On the measurement of slow water in wide rivers and what it tells of reeds that bend with tides",
    "caption": "Text.\n\nFigure 3: A plot of things", "list": "Text.\n\n- one item\n- two items", "reference": "Text.\n\n[1] Doe, Roe: a study, 2012", "terms": "Text.\n\nKeywords: one, two",
    "link": "Text.\n\ndoi:10.1/abc.12", "ids": "Text.\ntool: 2101.12345, 2102.12345", "loop": "for x in y:\n\tkeep(x)  # fine", "heading": "Text.\n\n## Heading", "name": "A short one. It is kept.\n\nAnna Lindqvist",
}
UNFINISHED = [
    ("A whole sentence. And one that bre", "running"), ("A whole sentence. And one that breaks …", "marked"), ("It breaks here [truncated]", "marked"), ("It was so (clipped)", "marked"), ("It breaks...", "marked"),
    ("It is done. It said \"so\" and", "running"), ("It is long. Let us see, for", "running"), ("Text.\n\n{\"a\": [1, 2", "inside"), ("Text.\n\n{\"a\": \"So.", "inside"), ("Text.\n\n```\nrun --x", "inside"),
    ("\\begin{equation}\nx = 1.", "inside"), ("Text.\n\n| a | b |\n| 1 | 2", "inside"), ("Text.\nassistant: {\"action\": \"x\", \"query\": \"so.", "inside"), ("这里没有结束。这里断", "running"), ("Several runs (made in", "inside"),
    ("Text.\n\nKeywords: one,", "hanging"), ("See e.g.", "hanging"), ("Ends in a byte\ufffd", "marked"), ("One sentence. Two.\n\nAfter 251 runs, the shared bou", "lead"), ("It breaks …" + " " * 100, "marked"), ("We measured 3.", "number"),
]
BLANK = [None, "", "  \n\t ", "…", "\xa0", "\u200b \u3000", " " * 200]


def test_forms(spark):
    want = [(t, "closed") for t in CLOSED] + UNFINISHED + [(t, "blank") for t in BLANK]
    want.append(("A sentence. " * 20_000 + "and", "running"))
    df = spark.createDataFrame([(i, t, "x") for i, (t, _) in enumerate(want)], "i int, t string, _body string")
    got = {r.i: r.form for r in T.forms(df.drop("_body"), "t").collect()}
    assert [(repr(t)[:60], got[i]) for i, (t, _) in enumerate(want)] == [(repr(t)[:60], k) for t, k in want]
    df = spark.createDataFrame(list(COMPLETE.items()), "name string, t string")
    got = {r.name: r.form for r in T.forms(df, "t").collect()}
    assert not {n: f for n, f in got.items() if f not in T.DOUBTFUL and f != "closed"}


WORDS = "reed water heron marsh slow wide river tide grey wing bank stone light north early small".split()


def prose(rng, n):
    out = ""
    while len(out) < n:
        one = " ".join(rng.choice(WORDS) for _ in range(rng.randint(4, 12))).capitalize()
        out += one + rng.choice([". ", ". ", f" by {rng.randint(1, 9)}.{rng.randint(1, 9)} of all. ", ".\n\n"])
    return out.strip()


def corpus(seed=1):
    """(doc_id, source, text, cut): a source without limits, one with a limit of characters, one of bytes, one that breaks in transfer."""
    rng, rows = random.Random(seed), []
    finished = lambda t: t.rstrip().endswith(".") and not t.rstrip()[-2].isdigit()
    for n in range(1500):
        rows.append((n, "free", prose(rng, rng.randint(60, 900)), False))
    for n in range(1500, 3000):
        t = prose(rng, rng.randint(60, 900))
        rows.append((n, "chars", t[:500], len(t) > 500 and not finished(t[:500])))
    for n in range(3000, 4500):
        t = prose(rng, rng.randint(60, 900)).replace("heron", "hérön")
        b = t.encode()[:400].decode(errors="ignore")
        rows.append((n, None, b, b != t and not finished(b)))
    for n in range(4500, 6000):
        t = prose(rng, rng.randint(60, 900))
        if n % 30 == 0:
            t = t[: rng.randint(40, len(t) - 1)]
        rows.append((n, "broken", t, n % 30 == 0 and not finished(t)))
    return rows


def truth(rows):
    # Not told by form: whether a point behind a digit ends a sentence, one word of a paragraph, the first sentence of a text (a title?).
    doubt = lambda t: t.rstrip()[-2:-1].isdigit() or " " not in t.rsplit("\n", 1)[-1].strip() or (". " not in t and "\n" not in t)
    return {r[0] for r in rows if r[3]}, {r[0] for r in rows if doubt(r[2]) and r[0] < 7000}


@pytest.fixture(scope="module")
def found(spark):
    rows = corpus()
    rows += [(7000 + n, s, t, False) for n, (s, t) in enumerate((s, t) for s in ("free", "chars", "broken") for t in COMPLETE.values())]
    rows += [(8000 + n, "chars", t, True) for n, t in enumerate(("x" * 0 + prose(random.Random(5), 500)[:450].rsplit(".", 1)[0] + ". " + "We measured 3.".rjust(500))[-500:] for _ in range(1))]
    rows.append((8001, "chars", ("We trained the model on the full corpus and then " * 20)[:500].strip().ljust(500, "x"), True))
    rows.append((8002, "chars", (prose(random.Random(6), 600).replace("\n\n", " ")[:440].rsplit(".", 1)[0] + ". The tide was so wide that every small bank of the river went und")[-500:].rjust(500), True))
    df = spark.createDataFrame([r[:3] for r in rows], "doc_id bigint, source string, text string").repartition(4)
    return rows, df, {r.doc_id: r.how for r in T.truncated(df, "doc_id", "text", "source").collect()}


def test_limits(spark, found):
    _, df, _ = found
    lim = {(r.source, r.unit, r.length) for r in T.limits(T.texts(T.measured(df, "doc_id", "text", "source"))).collect()}
    assert ("chars", "chars", 500) in lim and (None, "bytes", 400) in lim and not any(s in ("free", "broken") for s, _, _ in lim)


def test_cases(found):
    rows, _, got = found
    true, unsure = truth(rows)
    assert not {r[0]: r[2][-60:] for r in rows if r[0] in set(got) - true - unsure}
    assert not {r[0]: r[2][-60:] for r in rows if r[0] in true - set(got) - unsure}
    assert len(true) > 1200 and {got.get(n) for n in (8000, 8001, 8002)} == {"limit"}
    assert {got[r[0]] for r in rows if r[1] == "broken" and r[0] in got} == {"transfer"} and not any(r[0] in got for r in rows if 7000 <= r[0] < 8000)


def test_the_source_decides_what_an_ending_means(spark):
    """Texts that all end without a stop are complete in their source, and cut in one whose other texts end in stops."""
    rng = random.Random(4)
    loose = [(n, "loose", prose(rng, rng.randint(60, 600)).rstrip(".")) for n in range(300)]
    strict = [(1000 + n, "strict", prose(rng, rng.randint(60, 600))) for n in range(300)] + [(2000, "strict", "The reed bends. The water goes on and the sm")]
    got = {r.doc_id for r in T.truncated(spark.createDataFrame(loose + strict, "doc_id bigint, source string, text string"), "doc_id", "text", "source").collect()}
    assert got == {2000}


def test_limits_that_fall_back_to_whole_words(spark):
    rng, rows = random.Random(7), []
    for n in range(600):
        t = prose(rng, rng.randint(60, 900)).replace("\n\n", " ")
        rows.append((n, "s", t if len(t) <= 400 else t[:400].rsplit(" ", 1)[0] + " …"))
    got = {r.doc_id: r.how for r in T.truncated(spark.createDataFrame(rows, "doc_id bigint, source string, text string"), "doc_id", "text", "source").collect()}
    marked = {r[0] for r in rows if r[2].endswith(" …") and not r[2].endswith(". …")}
    assert set(got) == marked and sum(h == "limit" for h in got.values()) > 0.9 * len(marked)


def test_hazards_against_brute_force(spark):
    rng = random.Random(2)
    lens = [rng.choice([50, 50, *range(40, 60)]) for _ in range(500)]
    h = {r.length: r for r in T.hazards(spark.createDataFrame([("s", "chars", x, True) for x in lens], "source string, unit string, length int, event boolean")).collect()}
    for x in set(lens):
        assert h[x].n_ended == lens.count(x) and h[x].n_reached == sum(y >= x for y in lens)
    assert h[50].p_value < 1e-6 < h[45].p_value


def test_empty_and_repeats(spark):
    df = spark.createDataFrame([], "doc_id bigint, source string, text string")
    assert T.truncated(df, "doc_id", "text", "source").collect() == [] and T.rates(df, "doc_id", "text", "source").collect() == []
    df = spark.createDataFrame([(1, "s", "It was. It bre"), (1, "s", "It was. It bre"), (2, None, None), (3, "s", "x")], df.schema)
    assert [tuple(r) for r in T.truncated(df, "doc_id", "text", "source").collect()] == [(1, "s", "transfer")] * 2


def test_rates(spark, found):
    rows, df, got = found
    rates = {r.source: r for r in T.rates(df, "doc_id", "text", "source").collect()}
    assert rates["free"].rate == 0 and rates[None].n_docs == 1500
    assert all(rates[s].at_limit + rates[s].in_transfer == sum(r[0] in got for r in rows if r[1] == s) for s in rates)
