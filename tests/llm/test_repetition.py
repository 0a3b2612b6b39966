import random

import regex

from skerry.llm import repetition as rp


def share_by_hand(text, stretch=8):
    words = regex.findall(r"\p{L}+", (text or "").lower())
    seen, hit = set(), set()
    for p in range(len(words) - stretch + 1):
        gram = tuple(words[p : p + stretch])
        if gram in seen:
            hit |= set(range(p, p + stretch))
        seen.add(gram)
    return len(words), len(hit)


def test_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = ["a", "B", "é", "語彙", "x1y", "don't", "İ", "_", "42"]
    texts = []
    for _ in range(150):
        words = [rng.choice(vocabulary[: rng.randrange(1, 9)]) for _ in range(rng.randrange(0, 80))]
        texts.append("".join(w + rng.choice([" ", "\n", ", "]) for w in words))
    texts += [None, "", "   ", "123 456", "one two three four five six seven eight\n" * 40, "a " * 3000]
    rows = list(enumerate(texts)) + [(0, texts[0])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as words", "'c' as share").repartition(3)
    got = sorted((r.doc_id, r.words, r.repeated_words) for r in rp.repetition_shares(df).collect())
    assert got == sorted((i, *share_by_hand(t)) for i, t in rows)
    cases = sorted(r.doc_id for r in rp.repetitive_documents(df).collect())
    assert cases == sorted(i for i, t in rows if (s := share_by_hand(t))[0] and s[1] / s[0] >= 0.35)
    assert rp.repetition_shares(df.limit(0)).count() == 0


def test_documents_dont_mix(spark):
    line = "one two three four five six seven eight nine"
    df = spark.createDataFrame([(i, line) for i in range(50)], "doc_id bigint, text string").coalesce(1)
    assert rp.repetitive_documents(df).count() == 0


def test_line_rules(spark):
    text = "Home | News | About | Login\nThis is a sentence that ends well.\nAll rights reserved.\nsome words without an end here\n\nint value = call(some, other, thing, 3) +\nFine."
    row = rp.clean_lines(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id bigint, text string")).orderBy("doc_id").collect()
    assert row[0].text == "This is a sentence that ends well.\n\nint value = call(some, other, thing, 3) +\nFine." and row[0].rejected
    assert row[1].text is None and not row[1].rejected
    assert row[2].text == "" and row[2].lost == 0


def test_lines_of_many_documents(spark):
    rows = [(i, f"Own words {chr(97 + i % 26) * 5} number {i} of this text {chr(97 + i // 26) * 7}.\nPage {i} of the great manual of everything.") for i in range(60)]
    df = spark.createDataFrame(rows + [(100, "Page 7 of the great manual of everything.\n" * 3)], "doc_id bigint, text string")
    common = {r.line: r.documents for r in rp.common_lines(df, 0.5).collect()}
    assert common == {rp.line_key("page 0 of the great manual of everything."): 61}
    cleaned = {r.doc_id: r for r in rp.clean_lines(df, common_share=0.5).collect()}
    assert cleaned[3].text == rows[3][1].split("\n")[0] and cleaned[100].text == "" and cleaned[100].rejected
    assert {r.doc_id for r in rp.repetitive_documents(df).collect()} <= {i for i, r in cleaned.items() if r.rejected}
    assert rp.clean_lines(df.limit(0)).count() == 0
