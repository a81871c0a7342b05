import random
import time

from tokenizers import Tokenizer

from heronry.llm import bpe as B

TEXTS = [
    None, "", " ", "\n\n  \t", "hello world", "<|endoftext|> as text", "don't we'll I'VE", "naïve café – ﬁne", "日本語のテキスト", "👩‍🔬😀", "e\u0301", "a" * 3000,
    "ab" * 2000, " " * 3000, "x\x1cy\x1f z\x85\u2003w\xa0", "\ufffd\u0000\u200b", "1234567890" * 50, "...!!!???" * 30, "The  quick\tbrown\n\nfox ", "Ελληνικά кириллица عربى",
]


def reference(path):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids if s else []


def test_equals_the_public_tokenizer(spark, tokenizer_file):
    rng, ref = random.Random(3), reference(tokenizer_file)
    alphabet = "abcdefghijklmnopqrstuvwxyz ABCé日́ \n\t0123456789.,'-_#$%&*()[]{}<>|\\\u200d👩\x1c\u2003"
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 80))) for _ in range(3000)]
    df = spark.createDataFrame([(i, t, 7, "clash") for i, t in enumerate(texts)], "doc_id bigint, text string, ids int, key string")
    got = {r.doc_id: list(r.ids) for r in B.encode_column(df, "doc_id", "text", tokenizer_file).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i] == ref(t), repr(t)[:80]


def test_every_token_and_round_trip(tokenizer_file):
    e, ref = B.Encoder(tokenizer_file), reference(tokenizer_file)
    text_of = {i: t for t, i in zip(e.text, e.ids, strict=True)}
    rng = random.Random(5)
    for t in rng.sample(e.text, 6000):
        try:
            s = t.encode("latin-1").decode()
        except UnicodeDecodeError:
            continue
        assert e.encode(s) == ref(s), repr(s)
        assert "".join(text_of[i] for i in e.encode(s)).encode("latin-1").decode() == s


def test_linear_time_and_small_memory(tokenizer_file, monkeypatch):
    e, ref = B.Encoder(tokenizer_file), reference(tokenizer_file)
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("etaoinshrdlu") for _ in range(n))
    took = []
    for n in (20_000, 80_000):
        s = word(n)
        a = time.perf_counter()
        assert len(e.encode(s)) > 0
        took.append(time.perf_counter() - a)
    assert took[1] < 12 * took[0] + 0.5
    monkeypatch.setattr(B, "MEMO", 50)
    e.memo.clear()
    texts = [" ".join(word(5) for _ in range(60)) for _ in range(40)]
    assert [e.encode(t) for t in texts] == [ref(t) for t in texts] and len(e.memo) <= 50


def test_repeated_rows_and_empty_table(spark, tokenizer_file):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id bigint, text string")
    got = B.encode_column(df, "doc_id", "text", tokenizer_file).collect()
    assert sorted((r.doc_id or 0, len(r.ids)) for r in got) == [(0, 1), (1, 2), (1, 2)]
    out = B.encode_column(df.limit(0), "doc_id", "text", tokenizer_file)
    assert out.collect() == [] and out.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
