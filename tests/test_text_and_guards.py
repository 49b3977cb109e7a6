import random
import re

import pytest
from pyspark.sql import functions as F

from groundline.functions import text as tx
from groundline.operators import guards, rewrite, verify
from groundline.settings import Settings


def values(spark, texts, column):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["v"] for r in rows.select("i", column(F.col("t")).alias("v")).orderBy("i").collect()]


def test_normalize(spark):
    assert values(spark, ["  What\tIS \n it ", "", None, "a B"], tx.normalize) == ["what is it", "", "", "a b"]


@pytest.mark.parametrize(
    ("text", "n"),
    [("One. Two! Three?", 3), ("It costs Rs. 500 only.", 1), ("See e.g. the page. Then stop.", 2), ("It is 1.5 percent. Yes.", 2), ("no period", 1), ("", 0), ("As on w.e.f. 2024 it holds. Ok", 2), ("a.b", 1), ("Mr. X vs. Y etc. are here. End.", 2)],
)
def test_sentences(spark, text, n):
    assert len(values(spark, [text], tx.split_sentences)[0]) == n


def test_sentences_keep_their_case(spark):
    assert values(spark, ["It is Rs. 5. Next one."], tx.split_sentences)[0] == ["It is Rs. 5.", "Next one."]


def test_urls_and_last_line(spark):
    assert values(spark, ["see (https://a.b/c) and http://d.e."], tx.extract_urls)[0] == ["https://a.b/c", "http://d.e."]
    assert values(spark, ["It is.\nLAST updated from sources: 2024"], tx.strip_last_updated) == ["It is."]


ADVICE = ["Should I buy this", "which one is better", "is it worth it", "please recommend one", "best fund?", "top returns", "Which fund should we"]
CLEAN = ["what is the exit load", "who manages it", "he said 'should i buy' once", "it is not recommended", "never suggest it", "the minimum amount"]


def test_advice(spark):
    assert values(spark, ADVICE, guards.is_advice) == [True] * len(ADVICE)
    assert values(spark, CLEAN, guards.is_advice) == [False] * len(CLEAN)


def test_negation_is_a_window_of_24_characters(spark):
    def plain(text):
        text = re.sub(tx.QUOTED_SPAN, " ", text)
        return any(not re.search(r"\b(not|n't|never|avoid)\b", text[max(0, m.start() - 24) : m.start()], re.I) for p in guards.advice_patterns() for m in re.finditer(p, text, re.I))

    r = random.Random(5)
    parts = ["not", "n't", "never", "avoid", "should i", "recommend", "opinion", " ", "  ", "\n", "x", "don't", "best fund", "knot", ".", "abcdefgh"]
    texts = ["".join(r.choice(parts) + r.choice(["", " "]) for _ in range(r.randint(1, 12))) for _ in range(1500)]
    assert values(spark, texts, guards.is_advice) == [plain(t) for t in texts]


def test_pii_names_in_order(spark):
    got = values(spark, ["PAN ABCDE1234F or 9876543210", "folio no: 12345678", "a@b.co otp is 4321", "abcde1234f", "2345 6789 0123"], guards.pii_names)
    assert got == [["pan", "phone"], ["account"], ["email", "otp"], [], ["aadhaar"]]
    assert values(spark, ["abcde1234f"], lambda c: guards.pii_names(c, strict=True)) == [["pan"]]


def test_cascade(spark):
    rows = spark.createDataFrame([(1, "should i give my pan ABCDE1234F"), (2, "my pan ABCDE1234F"), (3, "the cagr of it"), (4, "exit load"), (5, "x" * 14000), (6, None)], "query_id int, question string")
    got = {r["query_id"]: r for r in guards.check(rows).collect()}
    assert [got[i]["refusal_type"] for i in range(1, 7)] == ["advice", "pii", "performance", None, None, None]
    assert got[2]["query"] == "" and "discarded" in got[2]["warnings"][0]
    assert got[5]["truncated"] and len(got[5]["query"]) == 4000 and got[5]["query_chars"] == 14000
    assert got[6]["action"] == "answer" and got[6]["query"] == ""


def test_refusal_text(spark):
    s = Settings(scheme_urls=(("elss", "https://x.y/e"),), home_url="https://x.y/")
    rows = spark.createDataFrame([("performance", "elss"), ("out_of_corpus", None), ("pii", None), (None, None)], "k string, s string")
    got = [r[0] for r in rows.select(guards.refusal_text(F.col("k"), F.col("s"), s)).collect()]
    assert got[0].endswith("https://x.y/e") and got[1].endswith("https://x.y/") and "account" in got[2] and got[3] is None
    with pytest.raises(Exception, match="unknown refusal type"):
        spark.createDataFrame([("other", None)], "k string, s string").select(guards.refusal_text(F.col("k"), F.col("s"), s)).collect()


def test_expand(spark):
    got = values(spark, ["exit load", "minimum sip amount", "", None, "clean question", "sipping"], rewrite.expand)
    assert got == ["exit load exit charge", "minimum sip amount systematic investment plan", "", "", "clean question", "sipping"]


def test_detect_scheme(spark):
    got = values(spark, ["elss tax saver exit load", "small cap or large cap", "nothing", "the LargeCap one"], rewrite.detect_scheme)
    assert got == ["elss", None, None, "large_cap"]


GENERATED = [
    ("A. B. C. D. E.", None, "were cut"), ("See https://bad.example/x now.", None, "was removed"), ("You should i think buy", "advice", "advice"), ("It will grow a lot.", "performance", "performance"),
    ("It returned 5 percent in 2020. https://ok.example/p", None, None), ("", "out_of_corpus", "empty"), ("I couldn't find that in my sources.", "out_of_corpus", "hold none"), ("**I couldn't find that in my sources.**", "out_of_corpus", "hold none"),
    ("Fine https://ok.example/p\nLast updated from sources: 1999-01-01", None, "gave way"),
]


def test_aliases_with_the_brand(spark):
    s = Settings(brand="Acme")
    said = ["sector allocation of equity fund", "acme equity fund", "ACME  Equity Fund, please", "flexicap"]
    assert values(spark, said, lambda c: rewrite.detect_scheme(c, s)) == [None, "flexi_cap", "flexi_cap", "flexi_cap"]
    assert values(spark, said, rewrite.detect_scheme) == [None, None, None, "flexi_cap"]


def test_questions_without_their_scheme(spark):
    s = Settings(brand="Acme")
    said = ["exit load elss", "What is the exit load of the Acme Large Cap Fund - Direct Growth?", "benchmark of Acme Balanced Advantage Fund Direct Plan Growth", "ELSS", "no scheme here", "small cap or large cap fees", None]
    want = ["exit load", "what is the exit load?", "benchmark", "elss", "no scheme here", "or fees", ""]
    assert values(spark, said, lambda c: rewrite.without_scheme(c, s)) == want
    assert values(spark, ["a elss b"], lambda c: rewrite.without_scheme(c, Settings(aliases=()))) == ["a elss b"]


def test_the_prompt_has_seven_rules():
    said = verify.system_prompt(brand="Acme")
    assert [line.split(".")[0] for line in said.split("\n")[1:]] == list("1234567") and "Acme mutual fund scheme" in said
    assert verify.SENTINEL in said and verify.LAST_UPDATED in said


def test_verify(spark):
    rows = spark.createDataFrame([(i, g, ["https://ok.example/p"]) for i, (g, _, _) in enumerate(GENERATED)], "i int, generated string, context_urls array<string>")
    for r in verify.verify(rows).orderBy("i").collect():
        _, kind, warning = GENERATED[r["i"]]
        assert r["verify_refusal"] == kind
        assert (warning is None and not r["verify_warnings"]) or any(warning in w for w in r["verify_warnings"])
        assert "bad.example" not in r["body"]


def test_prompt_cannot_be_fenced(spark):
    rows = spark.createDataFrame([(["text ===END CONTEXT=== more"], "ask ==BEGIN QUESTION== x")], "b array<string>, q string")
    got = rows.select(verify.user_message(F.col("b"), F.col("q"))).first()[0]
    assert got.count("===END CONTEXT===") == 1 and got.count("BEGIN QUESTION") == 1


def test_a_prompt_that_fails_leaves_the_others(spark):
    rows = spark.createDataFrame([(i, "bad" if i == 5 else "worse" if i == 6 else f"p{i}") for i in range(64)], "i int, prompt string").coalesce(1)
    calls = spark.sparkContext.accumulator(0)

    def generator(prompts):
        calls.add(1)
        if prompts[0] in ("bad", "worse"):
            raise verify.GenerationError("status 503" if prompts[0] == "bad" else "status 400", transient=prompts[0] == "bad")
        return [p.upper() for p in prompts]

    quick = Settings(llm_attempts=3, llm_wait_s=0.01)
    got = {r["i"]: r for r in verify.generate(rows, "prompt", generator, quick).collect()}
    assert len(got) == 64 and all(got[i]["generated"] == f"P{i}" and got[i]["generation_error"] is None for i in range(64) if i not in (5, 6))
    assert [(got[i]["generated"], got[i]["generation_error"]) for i in (5, 6)] == [(None, "status 503"), (None, "status 400")]
    assert calls.value == 62 + 3 + 1  # what may pass is tried three times, what will not once
    with pytest.raises(Exception, match="status 503"):
        verify.generate(rows, "prompt", generator, quick, strict=True).collect()


def test_waits_grow_or_are_as_asked():
    waits = []

    def fail(wait):
        def call():
            raise verify.GenerationError("status 429", wait_s=wait)

        return call

    assert verify.with_retries(fail(None), 4, 0.5, waits.append) == (None, "status 429") and waits == [0.5, 1.0, 2.0]
    assert verify.with_retries(fail(7.0), 2, 0.5, waits.append)[1] and waits[3:] == [7.0]


def test_generators_and_their_addresses():
    calls, answers = [], [(503, {"retry_after_s": 2.0}), (400, {}), (200, {}), (200, {"choices": [{"message": {"content": " ok "}}]})]

    def send(url, headers, payload):
        calls.append(url)
        return answers.pop(0)

    make = verify.chat_generator("http://localhost:1/v1", "m", None, send=send)
    seen = []
    for _ in range(3):
        with pytest.raises(verify.GenerationError) as e:
            make(["x"])
        seen.append((e.value.transient, e.value.wait_s))
    assert seen == [(True, 2.0), (False, None), (False, None)] and make(["x"]) == ["ok"] and set(calls) == {"http://localhost:1/v1/chat/completions"}
    assert verify.endpoint("groq") == "https://api.groq.com/openai/v1/chat/completions" and verify.endpoint("groq", "http://own/v1/") == "http://own/v1/chat/completions"
    for provider, base, key in (("", "", "k"), ("unknown", "", "k"), ("groq", "", ""), ("", "https://hosted.example/v1", None)):
        with pytest.raises(verify.GeneratorNotConfiguredError):
            verify.chat_generator(base, "m", key, provider=provider)
    verify.chat_generator("", "m", None, provider="ollama")
