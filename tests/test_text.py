"""Persian and English text rules on inline rows."""

import pytest
from pyspark.sql import functions as F

from revlens import lexicons as lx
from revlens.functions import labels as lb
from revlens.functions import text as tx
from revlens.operators import filters as fl
from revlens.operators import labelling as lab


def test_clean_symbols(one):
    values = ["بی‌ادب", "مُهم", "Hello, WORLD!! 😀 a_b 12", "سلام؟", None, "  ", "a  b\t\nc"]
    out = one(values, lambda d: tx.clean_symbols_final(F.col("x")))
    assert out == ["بی ادب", "مُهم", "hello world a_b 12", "سلام", "", "", "a b c"]


def test_strip_urls(one):
    assert one(["see https://a.b/c?x=1 now", "www.x.y end", "plain"], lambda d: tx.strip_urls(F.col("x"))) == [
        "see  now", " end", "plain",
    ]


def test_clean_en(one):
    out = one(
        ["The images were NOT better! http://x.y", None, "No crashes, never... bugs?"], lambda d: tx.clean_en(F.col("x"))
    )
    assert out == ["image not good", "", "no crash never bug"]


def test_clean_fa(one):
    out = one(["من عكسها را ديدم! هیچ بد نیست", "خوب!! و عالی", None], lambda d: tx.clean_fa(F.col("x")))
    assert out == ["عکس دیدم هیچ بد نیست", "خوب !! عالی", ""]


def test_lemma_before_mark(one):
    assert one(["کردم"], lambda d: tx.clean_fa(F.col("x"))) == ["کرد"]


def test_stopwords_keep_negation():
    assert tx.stopwords_keep_negation(["a", "not", "b", "a"], ["not"]) == ["a", "b", "a"]


def test_clean_by_lang(one):
    values = [("the image و", "en_us"), ("the image و", "fa_ir")]
    out = one(values, lambda d: tx.clean_by_lang(F.col("x"), F.col("lang")), "x string, lang string")
    assert out == ["image و", "the image"]


def test_generic_or_short(one):
    values = [None, "", "عالی", "good app", "عالی خوب مرسی", " GOOD nice\n great ", "this is fine", "خوب عالی ولی کند"]
    assert one(values, lambda d: tx.is_generic_or_short(F.col("x"))) == [True] * 6 + [False, False]


def test_word_count(one):
    assert one([None, "", "  ", "a b", " a b\tc "], lambda d: tx.word_count(F.col("x"))) == [0, 0, 0, 2, 3]


def test_flag_keywords(one):
    values = [("It Hallucinates", "en_us"), ("توهم", "fa_ir"), ("fake", "fa_ir"), ("fake", "de"), (None, "en_us")]
    out = one(values, lambda d: tx.flag_keywords(F.col("x"), F.col("l")), "x string, l string")
    assert out == [True, True, False, False, False]


def test_category_flags_match_raw_text(one):
    def build(d):
        return tx.category_flags(F.col("x"), F.col("l"))["Localization_Culture"]

    values = [("بی‌ادب", "fa_ir"), ("RUDE bot", "en_us"), ("rude", "fa_ir"), (None, "en_us")]
    assert one(values, build, "x string, l string") == [True, True, False, False]


def test_digits_and_likert(one):
    assert one(["۱۴۰۴/۰۷/۰۹", None], lambda d: tx.fa_digits_to_latin(F.col("x"))) == ["1404/07/09", None]
    values = ["کاملاً مخالفم", "کاملاً موافقم", "قابل ارزیابی نیست", "3", "x", None]
    assert one(values, lambda d: tx.likert_recode(F.col("x"))) == [1.0, 7.0, None, 3.0, None, None]


def test_recode(one):
    values = ["شایستگی فنی و عملیاتی", " شایستگی چندرسانه‌ای ", "other", "شایستگی چندرسانه‌ای (اکتشافی)"]
    out = one(values, lambda d: tx.recode_label(F.col("x")))
    assert out == ["Technical Competence", "Multimedia Competence", "other", "شایستگی چندرسانه‌ای (اکتشافی)"]


@pytest.mark.parametrize("rules", [lx.SUBSTRING_RULES_SHORT, lx.SUBSTRING_RULES_WIDE])
def test_substring_rules_keep_their_order(one, rules):
    values = ["شایستگی چندرسانه‌ای", "چالش‌های زیرساختی و فیلترینگ", "پویایی زمانی و حافظه بافتی", "abc‌d"]
    out = one(values, lambda d: tx.recode_by_substring(F.col("x"), rules))
    assert out == ["Technical Competence", "Infrastructure & Filtering", "Temporal Memory", "abc d"]


def labelled(spark, texts, scores=None):
    scores = scores or [3.0] * len(texts)
    df = spark.createDataFrame(list(zip(range(len(texts)), texts, scores)), "i int, content string, score double")
    return lab.with_final_clean(df)


def column(df, name):
    return [r[name] for r in df.orderBy("i").collect()]


def test_aspect_lexicon_whole_words_and_substrings(spark):
    texts = ["کد نمیزنه", "کدام", "vpn", "vpns", "فیلترینگ شدید", "memory full and security", "", None]
    out = column(lab.aspect_lexicon(labelled(spark, texts)), "Final_Aspect")
    names = list(lx.ASPECT_LEXICON)
    # A word of three characters hits whole words only; of two aspects the first in lexicon order wins.
    assert out == [names[5], "Noise", names[0], "Noise", names[0], names[2], "Noise", "Noise"]


def test_shared_words_column_gives_the_same_labels(spark):
    texts = ["کد نمیزنه", "هُک شد", "بد", "vpn bug", "pic nice", "مُهم کد", None]
    clean = labelled(spark, texts)
    shared = lab.with_padded_words(clean)
    assert column(lab.aspect_lexicon(clean), "Final_Aspect") == column(
        lab.aspect_lexicon(shared, words="_words"), "Final_Aspect"
    )
    assert column(lab.sentiment_with_score(clean), "Sentiment_Polarity") == column(
        lab.sentiment_with_score(shared, words="_words"), "Sentiment_Polarity"
    )


def test_aspect_first_match(spark):
    texts = ["Photo of iran", "photo", "گفت خوبه", "nothing here", " ", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, cleaned_content string")
    out = column(lab.aspect_first_match(df), "Final_Aspect")
    names = list(lx.FIRST_MATCH_RULES)
    assert out == [names[0], names[1], names[-1], "Noise", "Noise", "Noise"]


def test_sentiment_lexicon(spark):
    texts = ["بی‌ادب خیلی بد", "خوبه عالی!", "خوبه", "good good bad slow", "plain words", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, cleaned_content string")
    # 2: no whole word, the substring rule finds one. 3: distinct words count, one good against two bad.
    assert column(lab.sentiment_lexicon(df), "Sentiment_Polarity") == [-1, 1, 1, -1, 0, 0, 0]


def test_sentiment_with_score(spark):
    texts = ["great app", "buggy mess", "plain words", "plain words", "plain words", "فوق العاده"]
    scores = [1.0, 5.0, 4.0, 3.0, float("nan"), 1.0]
    out = column(lab.sentiment_with_score(labelled(spark, texts, scores)), "Sentiment_Polarity")
    # "buggy" holds the short word "bug" only inside, but is itself listed.
    assert out == [1, -1, 1, -1, -1, 1]


def test_fill_sentiment_only_touches_zero(spark):
    df = labelled(spark, ["great", "great", "great", "great"]).withColumn(
        "Sentiment_Polarity", F.when(F.col("i") == 0, -1).when(F.col("i") == 1, 0).when(F.col("i") == 2, 1)
    )
    assert column(lab.fill_sentiment(df), "Sentiment_Polarity") == [-1, 1, 1, 1]
    assert column(lab.fill_sentiment(df.drop("Sentiment_Polarity")), "Sentiment_Polarity") == [1] * 4


def test_composite_trust(one):
    values = [(5.0, 1), (2.0, -1), (5.0, -1), (3.0, 1), (None, 1), (float("nan"), 1), (float("nan"), -1), (3.0, -1)]
    out = one(values, lambda d: lb.composite_trust(F.col("s"), F.col("p")), "s double, p int")
    assert out == [1, 0, -1, -1, -1, -1, -1, 0]


def test_trust_levels(one):
    values = [(5.0,), (4.5,), (3.0,), (2.0,), (0.0,), (None,), (float("nan"),)]
    high, low, mid = lx.LEVEL_HIGH, lx.LEVEL_LOW, lx.LEVEL_NEUTRAL
    assert one(values, lambda d: lb.trust_level(F.col("s")), "s double") == [high, high, mid, low, low, mid, mid]
    assert one(values, lambda d: lb.trust_level_exact(F.col("s")), "s double") == [high, mid, mid, low, mid, mid, mid]


def test_seed_anchor(spark):
    df = spark.createDataFrame([(0, "a b b c"), (1, "x y"), (2, "c c a x"), (3, None)], "i int, cleaned_content string")
    # 0: both topics hit two and one distinct words. 2: a tie goes to the first topic.
    assert column(lab.seed_anchor(df, [["a", "b"], ["c", "x"]]), "anchor") == [0, 1, 1, -1]
    assert column(lab.seed_anchor(df, [["a"], ["c"]]), "anchor") == [0, -1, 0, -1]
    texts = [(0, "my bank money and crash"), (1, "the app forgets history again"), (2, "هک و دزد"), (3, "why no source or link"), (4, "plain")]
    df = spark.createDataFrame(texts, "i int, cleaned_content string")
    assert column(lab.seed_anchor(df), "anchor") == [3, 2, 0, 6, -1]
    assert len(lx.SEED_TOPICS) == 7 and all(len(words) == 40 for words in lx.SEED_TOPICS.values())


def test_target_class(one):
    values = ["0", "1", "0.0", "1.0", "2", "x", None]
    assert one(values, lambda d: lb.target_class(F.col("x"))) == [
        lx.CLASS_LOW, lx.CLASS_HIGH, lx.CLASS_LOW, lx.CLASS_HIGH, "2", "x", None,
    ]


def test_filters(spark):
    df = spark.createDataFrame(
        [("  ", 1.0), ("a b c", None), (None, 2.0), ("خوب است واقعا", 4.0), (" ok ", 5.0)], "content string, score double"
    )
    assert [r.content for r in fl.non_empty_comment(df).collect()] == ["a b c", "خوب است واقعا", "ok"]
    assert [(r.content, r.score) for r in fl.non_blank(df, "content").collect()] == [("خوب است واقعا", 4), (" ok ", 5)]
    assert [r.content for r in fl.deep_filter(df).collect()] == ["a b c", "خوب است واقعا"]
    assert [r.tokens for r in fl.sentences(df, "content").collect()] == [["a", "b", "c"], ["خوب", "است", "واقعا"]]


def test_noise_filter_does_not_repeat_the_labelling(spark):
    kept = lab.drop_noise(lab.aspect_lexicon(labelled(spark, ["vpn"])))
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    # One keyword test for the long and one for the short words of an aspect, and not again in the filter.
    assert plan.count("exists(") <= 2 * len(lx.ASPECT_LEXICON)


def test_filler_words_are_no_patterns(one):
    texts = ["cx cy cz", "c. c. c.", "c++ c++ c.", "c c c"]
    assert one(texts, lambda d: tx.is_generic_or_short(F.col("x"), ["c.", "c++"])) == [False, True, True, False]


def test_large_lemma_table(one):
    table = {f"word{i}": f"lemma{i}" for i in range(3000)} | {"خوب": "نیک"}
    assert one(["word7 word2999 other", "خوب"], lambda d: tx.clean_en(F.col("x"), [], table))[0] == "lemma7 lemma2999 other"
    assert one(["word12", "خوب", "none"], lambda d: tx.lookup(table, F.col("x"))) == ["lemma12", "نیک", None]
