import random

import numpy as np

from heronry.llm import contamination as C

VERBS = "limits shifts narrows masks counts repeats recovers supports".split()
NOUNS = [f"{a}{b}" for a in ("gra", "ker", "lo", "mi", "ta", "ven", "sul", "por") for b in ("dient", "nel", "cale", "tric", "sk", "due", "phon", "tal", "ble", "rix")]
STOCK = "we thank the anonymous reviewers for their helpful comments on every draft of this long paper"


def sentence(rng):
    name = "".join(rng.choice(["za", "ku", "ro", "ti", "ne"]) for _ in range(4)).title()
    w = [rng.choice(NOUNS) for _ in range(6)]
    return f"The {w[0]} of {name} {rng.choice(VERBS)} the {w[1]} {w[2]} and {rng.choice(VERBS)} {w[3]} beyond {rng.randint(1, 999)} {w[4]} {w[5]}."


def text(rng, n):
    return " ".join(sentence(rng) for _ in range(n))


def tables(spark, docs, items):
    return (
        spark.createDataFrame([(i, t, "x") for i, t in enumerate(docs)], "doc_id bigint, text string, item_text string"),
        spark.createDataFrame([(i, t, "y") for i, t in items.items()], "item_id bigint, item_text string, text string"),
    )


def noisy(rng, words):
    w = list(words)
    for i in range(3, len(w), 9):
        w[i] = rng.choice([f"<i>{w[i]}</i>", w[i].upper(), f"**{w[i]}**", f"\\emph{{{w[i]}}}", w[i][:2] + "\u00ad" + w[i][2:], w[i] + ";", w[i].replace("e", "e\u0301"), w[i].replace("fi", "ﬁ")])
    return "\u2009 ".join(" ".join(w[a : a + 5]) for a in range(0, len(w), 5)).replace(" the ", "\n> the ", 1)


def planted(seed=7):
    rng = random.Random(seed)
    items = {100 + i: text(rng, 6) + (" " + STOCK + "." if i % 3 == 0 else "") for i in range(25)}
    docs, truth = [], set()
    for n in range(260):
        t = text(rng, rng.randint(2, 14)) + (" " + STOCK + "." if n % 4 == 0 else "")
        i = rng.choice(list(items))
        w = items[i].split()[:70]
        a = rng.randrange(0, len(w) - 45)
        part = w[a : a + rng.randint(30, 45)]
        kind = n % 10
        if kind in (0, 1):
            t, leak = t + " " + " ".join(part) + " " + text(rng, 2), True
        elif kind == 2:
            t, leak = noisy(rng, part) + " " + t, True
        elif kind == 3:
            for j in range(4, len(part), 12):
                part[j] = "altered"
            t, leak = t + " " + " ".join(part), True
        elif kind == 4:
            rng.shuffle(part)
            t, leak = t + " " + " ".join(part), False
        elif kind == 5:
            t, leak = t + " " + " ".join(part[:7]), False
        else:
            leak = False
        if leak:
            truth.add((n, i))
        docs.append(t)
    docs += [None, "", "   ", "short", "x" * 200_000, docs[0]]  # the last is a copy
    truth |= {(len(docs) - 1, i) for n, i in truth if n == 0}
    return docs, items, truth


def test_planted_leaks(spark):
    docs, items, truth = planted()
    d, q = tables(spark, docs, items)
    got = [tuple(r) for r in C.leaks(d, q).collect()]
    assert len(got) == len(set(got))
    assert set(got) == truth


def test_blocks_give_the_same(spark, monkeypatch):
    docs, items, truth = planted(8)
    monkeypatch.setattr(C, "BLOCK", 10)
    assert {tuple(r) for r in C.leaks(*tables(spark, docs, items)).collect()} == truth


def test_short_passages_are_found_among_many_items(spark, monkeypatch):
    """20 words with up to two replaced, whatever the number of items and of blocks."""
    rng = random.Random(12)
    hosts = [text(rng, 12) for _ in range(40)]
    items = {n: text(rng, 6) for n in range(30)}
    more = {1000 + n: " ".join(h.split()[a : a + 80]) for n, (h, a) in enumerate((rng.choice(hosts), rng.randrange(0, 80)) for _ in range(70))}
    docs, truth = list(hosts), set()
    for n in range(90):
        i, edits = rng.randrange(30), n % 3
        w = items[i].split()
        a = rng.randrange(0, len(w) - 20)
        part = w[a : a + 20]
        for p in rng.sample(range(1, 19), edits):
            part[p] = "altered"
        h = rng.choice(hosts).split()[:60]
        b = rng.randrange(0, len(h))
        truth.add((len(docs), i))
        docs.append(" ".join(h[:b] + part + h[b:]))
    got = {}
    for name, of, block in (("few", items, 4000), ("many", items | more, 4000), ("blocks", items | more, 30)):
        monkeypatch.setattr(C, "BLOCK", block)
        got[name] = {tuple(r) for r in C.leaks(*tables(spark, docs, of)).collect()}
        assert len(truth & got[name]) >= 0.95 * len(truth), name
    assert got["many"] == got["blocks"]


def test_a_stock_sentence_with_a_few_words_about_it_is_no_leak(spark):
    rng = random.Random(13)
    items = {n: text(rng, 3) + " " + STOCK + ". If reeds are counted the " + text(rng, 3) for n in range(4)} | {9: text(rng, 4) + " " + STOCK}
    docs = [text(rng, 4) + (" " + STOCK + ". If reeds are counted the " if n % 3 == 0 else " ") + text(rng, 4) for n in range(200)]
    assert C.leaks(*tables(spark, docs, items)).collect() == []


def test_a_much_leaked_item_is_no_stock_phrase(spark):
    rng = random.Random(10)
    items = {n: text(rng, 5) for n in range(8)}
    docs = [text(rng, 3) + " " + items[3] for _ in range(70)] + [text(rng, 6) for _ in range(140)]
    assert {tuple(r) for r in C.leaks(*tables(spark, docs, items)).collect()} == {(n, 3) for n in range(70)}


def test_a_copied_text_is_no_stock_phrase(spark):
    rng = random.Random(9)
    item = text(rng, 5)
    docs = [item + " " + text(random.Random(1), 2)] * 60 + [text(rng, 6) for _ in range(120)]
    got = {tuple(r) for r in C.leaks(*tables(spark, docs, {5: item})).collect()}
    assert got == {(n, 5) for n in range(60)}


def test_empty_tables_and_null_items(spark):
    d, q = tables(spark, ["a b c"], {1: "one two three four five"})
    assert C.leaks(d.limit(0), q).collect() == [] and C.leaks(d, q.limit(0)).collect() == []
    nulls = spark.createDataFrame([(1, None), (None, "x"), (2, "")], "item_id bigint, item_text string")
    assert C.leaks(d, nulls).collect() == []
    out = C.leaks(d, q)
    assert out.dtypes == [("doc_id", "bigint"), ("item_id", "bigint")]


def test_words_see_through_encodings():
    want = ["fine", "naive", "x4", "0.87", "direct", "boundary"]
    for t in ("Fine, naïve x4 0.87 direct boundary!", "<b>ﬁne</b> na\u00adi\u0308ve X4 0.87 di-\n> rect boundary", "**fine** nai&#776;ve x4 0.87 \\emph{direct} BOUNDARY", "\\u0066ine nai\u0308ve x\u200b4 0.87 direct bound&#97;ry", "fine%20na%C3%AFve%20x4%200.87%20direct%20boundary"):
        assert C.words(t) == want, t
    assert C.words(None) == C.words("") == C.words(" \n") == []


def test_randomised_svd_is_close_to_the_exact_one(spark, monkeypatch):
    docs, items, _ = planted(11)
    d, q = tables(spark, docs, items)
    monkeypatch.setattr(C, "RANK", 12)
    voc = C.Vocabulary({i: C.words(t) for i, t in items.items()})
    voc = C.statistics(C.read(d.selectExpr("doc_id", "text", "'s' as source"), voc), voc)
    space = C.latent_space(q.select("item_id", "item_text"), voc)
    rows = []
    for t in items.values():
        ids = voc.ids(C.words(t))
        for p in C._passages(ids[voc.own(ids)]):
            v = np.zeros(voc.size)
            terms, w = C._weights(p, voc)
            v[terms] = w
            rows.append(v)
    a = np.array(rows)
    exact = np.linalg.svd(a, compute_uv=False)[:12]
    assert np.allclose(space.T @ space, np.eye(space.shape[1]), atol=1e-8)
    got = np.linalg.norm(a @ space) ** 2
    assert got > 0.95 * (exact**2).sum()


def test_common_is_the_longest_common_subsequence():
    rng = random.Random(4)
    for _ in range(200):
        a, b = [rng.randrange(6) for _ in range(rng.randint(0, 30))], [rng.randrange(6) for _ in range(rng.randint(1, 40))]
        best = [0] * (len(b) + 1)
        for x in a:
            row = best[:]
            for j, y in enumerate(b):
                row[j + 1] = best[j] + 1 if x == y else max(row[j], best[j + 1])
            best = row
        assert C.common(a, C.masks(np.array(b)), len(b)) == best[-1]
