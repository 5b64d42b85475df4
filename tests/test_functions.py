import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from affinia.functions import address as A
from affinia.functions import scripts, similarity
from affinia.functions import text as X


def one(spark, make, *values):
    row = spark.createDataFrame([values], ", ".join(f"c{k} string" for k in range(len(values))))
    return row.select(make(*[F.col(f"c{k}") for k in range(len(values))]).alias("x")).first()["x"]


def each(spark, make, values):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, c string")
    return [r.x for r in rows.select("k", make(F.col("c")).alias("x")).orderBy("k").collect()]


@pytest.mark.parametrize("unicode", [False, True])
def test_normalized(spark, unicode):
    texts = ["महाकाल ट्रेडर्स Pvt. Ltd.", "ABC Healthcare, Pvt. Ltd.", "Middletown Pédiatric_Center", "Straße  9", None, "--"]
    assert each(spark, lambda c: X.normalized(c, unicode), texts) == ["महाकाल ट्रेडर्स pvt ltd", "abc healthcare pvt ltd", "middletown pédiatric center", "strasse 9", "", ""]


def test_folding_equals_python(spark):
    """Without Python, and the same as Python's NFKC and case folding."""
    rng = random.Random(8)
    letters = [chr(c) for low, high in ((0x20, 0x250), (0x370, 0x400), (0x900, 0x980), (0x1E00, 0x1F00), (0x2070, 0x2190), (0x3040, 0x30FF), (0xAC00, 0xAC40), (0xFB00, 0xFB07), (0xFF01, 0xFFBF)) for c in range(low, high) if unicodedata.category(chr(c)) != "Cn"]
    texts = ["", "Stra\u00dfe", "\u0130stanbul", *("".join(rng.choice(letters) for _ in range(rng.randrange(12))) for _ in range(3000))]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.nfkc_folded(F.col("t")).alias("f"))
    assert "Python" not in df._jdf.queryExecution().toString()
    assert all(r.f == unicodedata.normalize("NFKC", r.t).casefold() for r in df.collect())


def test_compatibility_forms(spark):
    assert each(spark, lambda c: X.nfkc_casefold(c), ["ＡＢＣ ﬁ", "ΣΑΣ", None]) == ["abc fi", "σασ", ""]


def test_normalizing_twice_changes_nothing(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("aß É_-.\t9ा") for _ in range(12)) for _ in range(200)]
    once = each(spark, X.normalized, texts)
    assert each(spark, X.normalized, once) == once


@pytest.mark.parametrize(("name", "suffix", "rest"), [("abc co ltd", "ltd", "abc"), ("abc ltd co", "co", "abc ltd"), ("llc", "llc", "llc"), ("x pvt ltd", "pvt ltd", "x"), ("plain", "", "plain"), ("a limited liability company", "limited liability company", "a")])
def test_legal_suffixes(spark, name, suffix, rest):
    assert one(spark, X.legal_suffix, name) == suffix and one(spark, X.without_legal_suffix, name) == rest


def test_titles_and_misreadings(spark):
    assert each(spark, X.without_titles, ["the professional x", "m s kaira", "dr dr green", "the", "m", "theory"]) == ["professional x", "kaira", "green", "", "m", "theory"]
    assert each(spark, X.without_misreadings, ["0q", "6reat", "5hort 8rothers", "1st", "123", ""]) == ["oq", "great", "short brothers", "1st", "123", ""]


def test_house_numbers(spark):
    assert each(spark, A.house_number, ["3rd floor", "00302", "005 8", "04b", "none", "000", "12A x"]) == ["3r", "302", "5", "4b", "", "0", "12a"]


def test_first_words(spark):
    texts = ["door no 04b first floor chokkalinganagar", "h no 209 b d chambers", "no 7 main", "flat", "2nd floor tower", "plot 12 green road", "काठमांडू 12"]
    assert each(spark, A.first_unlabelled_word, texts) == ["chokkalinganagar", "b", "main", "", "tower", "12", "काठमांडू"]
    assert each(spark, A.first_alphabetic_word, texts) == ["chokkalinganagar", "b", "main", "", "tower", "green", "काठमांडू"]
    assert each(spark, A.anchor_word, texts) == ["chokkalinganagar", "chambers", "main", "", "tower", "green", ""]
    assert each(spark, A.anchor_word, ["alpha bravo", "bravo alpha", "first alphabet", "first floor x"]) == ["alpha", "bravo", "alphabet", ""]


def test_address_sets(spark):
    assert sorted(one(spark, A.numbers, "12/012, 7–B")) == ["12", "7"]
    assert one(spark, A.compound_numbers, "61-25, 61-38d") == ["61-25", "61-38D"]
    assert one(spark, A.postal_codes, "01234 123 1234567") == ["1234"]
    assert one(spark, A.parts, "a-1 b, b") == ["A-1", "B"]


def test_scripts(spark):
    assert each(spark, scripts.script, ["abc", "महा", "abc महा", "Ж", "123", None]) == ["latin", "devanagari", "mixed", "other", "empty", "empty"]
    assert each(spark, scripts.script_profile, ["abc", "Ж", "12", "", "سلام", "日"]) == ["latin", "cyrillic", "non_alpha", "empty", "arabic", "other"]
    assert each(spark, scripts.dominant_script, ["abЖ", "Жa", "", "日本a", "ᾳβγ"]) == ["latin", "cyrillic", "none", "other", "greek"]
    assert each(spark, scripts.ascii_or_devanagari, ["a", "म", "aम", "é", " "]) == ["latin", "devanagari", "mixed_latin_devanagari", "other", "empty"]
    assert each(spark, scripts.indic_script, ["ఆంధ్ర a", "abc"]) == ["telugu", None]
    assert each(spark, lambda c: scripts.transliterated(c), ["Abc", "राम", "दिल्ली 9"]) == ["abc", "raama", "dillii 9"]


def test_ratio_properties():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc  d") for _ in range(rng.randrange(14))) for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert similarity.common_length(a, b) == table[-1][-1]
        for f in (similarity.ratio, similarity.token_sort_ratio, similarity.token_set_ratio, similarity.wratio, similarity.partial_ratio):
            assert 0 <= f(a, b) <= 100 and f(a, b) == pytest.approx(f(b, a))


def test_partial_ratio_equals_all_stretches():
    rng = random.Random(4)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randrange(1, n))) for n in (6, 12))
        short, text = sorted((a, b), key=len)
        stretches = [text[max(0, s) : s + len(short)] for s in range(1 - len(short), len(text))]
        best = max(similarity.ratio(short, s) for s in stretches)
        if len(a) == len(b):
            best = max(best, *(similarity.ratio(text, short[max(0, s) : s + len(text)]) for s in range(1 - len(text), len(short))))
        assert similarity.partial_ratio(a, b) == pytest.approx(best)


def test_ratio_cases():
    assert similarity.token_set_ratio("a b", "a b c") == 100 and similarity.token_set_ratio("", "a") == 0
    assert similarity.ratio("", "") == 100 and similarity.wratio("", "") == 0 and similarity.ratio("ab", "cd") == 0
    assert similarity.wratio("ab", "xx ab yyyyyyyyyyyyyyyyyyyyyy") == pytest.approx(max(similarity.ratio("ab", "xx ab yyyyyyyyyyyyyyyyyyyyyy"), 60, 57))


def test_guarded_ratios(spark):
    rows = spark.createDataFrame([("", ""), ("a", None), ("a", "a")], "a string, b string")
    assert [tuple(r.x) for r in rows.select(similarity.ratios(F.col("a"), F.col("b"), guarded=True).alias("x")).collect()] == [(100.0,) * 4, (0.0,) * 4, (100.0,) * 4]
    assert [tuple(r.x) for r in rows.select(similarity.ratios(F.col("a"), F.col("b")).alias("x")).collect()][0] == (100.0, 0.0, 100.0, 0.0)


def test_set_similarities(spark):
    rows = spark.createDataFrame([([], []), (["a"], []), (["a", "b"], ["b", "c"]), (["a"], ["a"])], "a array<string>, b array<string>")
    a, b = F.col("a"), F.col("b")
    got = rows.select(similarity.jaccard(a, b), similarity.overlap(a, b), similarity.same_set(a, b)).collect()
    assert [tuple(r) for r in got] == [(1, 0, 0), (0, 0, 0), (pytest.approx(1 / 3), 0.5, 0), (1, 1, 1)]


def test_ngram_cosine(spark):
    assert one(spark, lambda a, b: similarity.char_ngram_cosine(a, b, 3), "abcd", "ABCD ") == pytest.approx(1)
    assert one(spark, lambda a, b: similarity.char_ngram_cosine(a, b, 3), "ab", "abc") == 0
    assert one(spark, lambda a, b: similarity.char_ngram_cosine(a, b, 3), "aaaa", "aaab") == pytest.approx(2 / (2 * 2**0.5))


def test_functions_for_sql(spark):
    similarity.register(spark)
    assert tuple(spark.sql("select nfkc_casefold('ＡB'), ratio_of('ab', 'ab')").first()) == ("ab", 100.0)
