"""Cut texts of sources that cut most of what they send."""

import random

import pytest

from evplace.llm.pairs import cut_reasoning, defect
from evplace.llm.truncation import could_be_whole, find_truncated, source_rates

from test_pairs_truncation import profiles

WORDS = "the bank sold its bond before town had heard of any loss from Norwick".split()


def _article(rng, least):
    out = ""
    while len(out) < least:
        out += " ".join(rng.choices(WORDS, k=9)).capitalize() + ". "
    return out.strip()


def _is_cut(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return find_truncated(df), df


def test_a_source_that_cuts_most_texts_keeps_its_cuts(spark):
    rng = random.Random(3)
    rows, want = [], set()
    for n in (6, 60):  # the same source, small and large
        for i in range(n):
            text = _article(rng, 900)
            if i % 6:
                text = text[: rng.randrange(780, 801)].rstrip(". ")  # a limit in bytes: lengths spread
                want.add(1000 * n + i)
            rows.append((1000 * n + i, text, f"kurier{n}"))
    out, _ = _is_cut(spark, rows)
    assert {r["doc_id"] for r in out.where("is_cut").collect()} == want
    rates = {r["source"]: r["cut_share"] for r in source_rates(out).collect()}
    assert min(rates.values()) > 0.8


def test_a_spread_limit_of_a_source_of_lines(spark):
    rng = random.Random(4)
    whole = [(i, "line " + "x" * rng.randrange(20, 400) + " end", "lists") for i in range(200)]
    cut = [(1000 + i, "line " + "y" * rng.randrange(780, 790) + " end", "lists") for i in range(40)]
    out, _ = _is_cut(spark, whole + cut)
    assert {r["doc_id"] for r in out.where("is_cut").collect()} == {r[0] for r in cut}


def test_could_be_whole():
    assert could_be_whole("Bank sells its bond") and could_be_whole("One line\nAnother line\nThird line 35")
    assert not could_be_whole("All is said. But the ba") and not could_be_whole("Bank sells the") and not could_be_whole("Bank sells,")
    assert not could_be_whole("A title\nAll is said.\nThat too.\nBut the ba") and could_be_whole("By Dr. Lee in Rome")


@pytest.mark.parametrize("sign,closer", [("```\n", "\n```"), ("(", ")"), ("“", "”"), ('"', '"'), ("{", "}"), ("«", "»"), ("„", "“"), ("<quote>", "</quote>")])
def test_a_sign_opened_long_before_the_end_of_a_reasoning(sign, closer):
    body = "The harbour was sold to the city. " * 20
    assert cut_reasoning(f"First {sign}{body.strip()}") and not cut_reasoning(f"First {sign}{body.strip()}{closer} Then all is said.")


@pytest.mark.parametrize(
    "reasoning,want",
    [
        ("Порт был продан городу после долгого спора. Значит, ответ: Zorba Works.", "other_language"),
        ("تم بيع الميناء إلى المدينة بعد نزاع طويل.", "other_language"),
        ("港口在长期争议之后被卖给了这座城市。", "other_language"),
        ("Kwanza bandari iliuzwa kwa mji baada ya mgogoro mrefu kuhusu madeni ambayo hakuna mtu aliyesikia hapo awali.", "other_language"),
        ("The harbour was sold to the city. The answer is Zorba Works.", None),
        ("Zorba Works.", None),
    ],
)
def test_language_of_the_reasoning(reasoning, want):
    q = "Which organisation bought the harbour, according to the report of the Harbour Post?"
    assert defect(q, "Zorba Works", reasoning, None, "inference_query", profiles=profiles()) == want
