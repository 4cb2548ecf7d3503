import random

import numpy as np

from holdfast.llm import language

from .cases import docs, none

WORDS = {"en": "the of and with house river light through thing would".split(), "de": "der und nicht schön über straße wird haben keine".split(), "ru": "это река дом свет вода человек время".split()}


def table(spark, n=240):
    rnd = random.Random(2)
    rows = [(i, " ".join(rnd.choice(WORDS[k]) for _ in range(40)), k) for i in range(n) for k in [("en", "de", "ru")[i % 3]]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def slow_viterbi(scores, switch):
    n, k = scores.shape
    best = [(scores[0][j], [j]) for j in range(k)]
    for t in range(1, n):
        best = [max((best[i][0] - (switch if i != j else 0) + scores[t][j], best[i][1] + [j]) for i in range(k)) for j in range(k)]
    return max(best)[0]


def test_viterbi_is_optimal():
    rnd = np.random.default_rng(1)
    lengths = np.array([3, 0, 7, 1, 12, 7])
    scores = rnd.normal(size=(lengths.sum(), 3)).astype(np.float32) * 4
    labels, p = language.viterbi(scores, lengths, 5.0), 0
    for n in lengths:
        if n:
            own, s = labels[p : p + n], scores[p : p + n]
            value = sum(s[t][own[t]] for t in range(n)) - 5.0 * sum(a != b for a, b in zip(own, own[1:], strict=False))
            assert abs(value - slow_viterbi(s, 5.0)) < 1e-3
        p += n


def test_languages_and_spans(spark):
    rows = table(spark)
    model = language.fit_languages(rows)
    got = language.identify(rows, model).collect()
    assert all(r["language"]["lang"] == r["lang"] and r["language"]["score"] == 1 for r in got)
    text = "12 the river of light and the house, über die straße wird nicht schön haben! это река дом свет вода... 7"
    mixed = language.identify(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()["language"]
    assert [(s["lang"], text[s["start"] : s["end"]]) for s in mixed["spans"]] == [
        ("en", "the river of light and the house"), ("de", "über die straße wird nicht schön haben"), ("ru", "это река дом свет вода"),
    ]


def test_held_out_rows_are_never_learnt_from(spark):
    rows = table(spark)
    from holdfast.llm.common import held_out
    from pyspark.sql import functions as F

    turned = rows.withColumn("lang", F.when(held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang")))
    assert language.fit_languages(turned).languages == ["de", "en", "ru"]


def test_all_trigrams_of_the_sample_count_and_clashing_columns_stay(spark):
    rows = spark.createDataFrame([(i, "".join(chr(97 + (i * k) % 26) for k in (1, 3, 7, 11, 5)), "en") for i in range(400)], "doc_id long, text string, lang string")
    from holdfast.llm.common import held_out

    texts = [r["text"] for r in rows.where(~held_out(rows["doc_id"])).collect()]
    assert set(language.fit_languages(rows).gram) == {g for t in texts for g in language.grams(t)}
    out = language.identify(rows.withColumnRenamed("lang", "Language"), language.fit_languages(rows))
    assert out.columns == ["doc_id", "text", "Language_input", "language"]


def test_marks_belong_to_their_words():
    text = "हिन्दी में é e\u0301te\u0301 สวัสดี ab2c"
    assert language.WORD.findall(text) == ["हिन्दी", "में", "é", "e\u0301te\u0301", "สวัสดี", "ab", "c"]
    assert language.last_end("x हिन्दी 12") == len("x हिन्दी") and language.last_end("é 1") == 1


def test_a_language_seen_once_in_a_script_is_a_candidate():
    model = language.Model([("en", " th", 900), ("ru", " эт", 5)], [("en", "latin", 1000), ("en", "cyrillic", 1), ("ru", "cyrillic", 9)])
    assert (model.masks["cyrillic"] == 0).all() and model.masks["latin"].tolist() == [0, language.OUT]


def test_word_scores_equal_plain_sums():
    counts = [("en", " th", 9), ("en", "the", 4), ("de", " th", 1), ("de", "he ", 2)]
    model = language.Model(counts, [("en", "latin", 9), ("de", "latin", 3)])
    kinds, plain = sorted({g for _, g, _ in counts}), {}
    for lang in ("de", "en"):
        own = {g: sum(n for k, x, n in counts if (k, x) == (lang, g)) + 0.5 for g in kinds}
        total = sum(own.values()) + 0.5
        plain[lang] = sum(np.log(own.get(g, 0.5) / total) for g in language.grams("the"))
    assert np.allclose(model.scores(["The"])[0], [plain["de"], plain["en"]], atol=1e-5)


def test_odd_rows(spark):
    model = language.fit_languages(table(spark))
    for df in (docs(spark), none(spark)):
        got = language.identify(df, model).collect()
        assert len(got) == df.count()
        for r in got:
            letters = any(c.isalpha() for c in r["text"] or "")
            assert (r["language"]["lang"] != "und") == letters and 0 <= r["language"]["score"] <= 1
    empty = language.fit_languages(none(spark))
    assert {r["language"]["lang"] for r in language.identify(docs(spark), empty).collect()} == {"und"}
