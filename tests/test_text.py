import unicodedata

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import fixed, text, unicode
from corpusloom.functions.registry import Registry, normalize, register_sql


def value(spark, expression, *texts):
    names = [f"c{i}" for i in range(len(texts))]
    df = spark.createDataFrame([tuple(texts)], ", ".join(f"{n} string" for n in names))
    return df.select(expression(*(F.col(n) for n in names)).alias("x")).first()["x"]


SPACES = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isspace())


def test_white_space_is_that_of_python(spark):
    t = "a".join(SPACES) + "a"
    assert value(spark, text.collapse, f" {t} ") == " ".join(t.split())
    assert value(spark, text.clean_whitespace, "a​b c") == "ab c"


def test_script_ranges_are_disjoint():
    ranges = sorted(r for rs in fixed.SCRIPTS.values() for r in rs)
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:], strict=False))
    assert len(fixed.LANGUAGES) == 43 and {script for _, script in fixed.LANGUAGES.values()} <= set(fixed.SCRIPTS)


@pytest.mark.parametrize(
    ("t", "script", "confidence"),
    [("Hello", "Latn", 1.0), ("नमस्ते दुनिया", "Deva", 1.0), ("こんにちは", "Hira", 1.0), ("123 !?", "Zzzz", 0.0), ("", "Zzzz", 0.0), ("abं", "Latn", 2 / 3), ("aд", "Latn", 0.5), ("你好 ab", "Latn", 0.5), ("мир мир a", "Cyrl", 6 / 7)],
)
def test_dominant_script(spark, t, script, confidence):
    x = value(spark, text.dominant_script, t)
    assert x["script"] == script and x["confidence"] == pytest.approx(confidence)


@pytest.mark.parametrize(("t", "language"), [("नमस्ते", "hi"), ("Hello", None), ("தமிழ்", "ta"), ("नमस्ते hello world", None), ("ひらがな", "ja"), ("мир", None), ("한국어", "ko")])
def test_infer_language(spark, t, language):
    assert value(spark, text.infer_language, t) == language


@pytest.mark.parametrize(("a", "p", "share"), [("Mumbai", "Mumbai is a city", 1.0), ("climate", "Mumbai is a city", 0.0), ("機械学習", "機械学習は面白い", 1.0), ("", "x", 0.0), ("Straße", "strasse", 1.0), ("機", "機械", 0.0)])
def test_overlap(spark, a, p, share):
    assert value(spark, text.overlap, a, p) == pytest.approx(share)


def test_words_keep_marks(spark):
    assert value(spark, text.text_words, "नमस्ते दुनिया don't हैं") == ["नमस्ते", "दुनिया", "don't", "हैं"]


def test_digits(spark):
    t = "".join(chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) == "Nd" and c < 0x10000)
    assert value(spark, unicode.decimal_digits, t) == "".join(str(unicodedata.decimal(c)) for c in t)
    assert value(spark, text.ascii_digits, "१२٣४5") == "12345".replace("4", "4")


def test_normal_forms(spark):
    t = "ﬁne é Å Straße"
    for form in ("NFC", "NFD", "NFKC", "NFKD"):
        assert value(spark, lambda c, f=form: unicode.normal_form(c, f), t) == unicodedata.normalize(form, t)
    assert value(spark, unicode.casefold, t) == t.casefold()
    assert value(spark, unicode.strip_accents, "éÅñ") == "eAn"
    assert value(spark, lambda c: normalize(c, "nfkc", "whitespace", {"type": "lowercase"}), " ﬁne   X ") == "fine x"


@pytest.mark.parametrize(
    ("t", "language", "want"),
    [
        ("Hello there. How are you?", None, ["Hello there.", "How are you?"]),
        ("Dr. Smith came. He left.", "en", ["Dr. Smith came.", "He left."]),
        ("Pi is 3.14 exactly. Yes!", "en", ["Pi is 3.14 exactly.", "Yes!"]),
        ("He said \"stop!\" Then left.", "en", ["He said \"stop!\"", "Then left."]),
        ("Wait... what? yes.", "en", ["Wait... what? yes."]),
        ("नमस्ते। आप कैसे हैं?", "hi", ["नमस्ते।", "आप कैसे हैं?"]),
        ("今日は。元気？はい", "ja", ["今日は。", "元気？", "はい"]),
        ("J. R. R. Tolkien wrote. End", None, ["J. R. R. Tolkien wrote.", "End"]),
        ("  \n ", None, []),
        ("Dr. Who. Was", "hi", ["Dr.", "Who.", "Was"]),
    ],
)
def test_sentences(spark, t, language, want):
    assert [t[a:b] for a, b in unicode.sentence_spans(t, language)] == want
    got = spark.createDataFrame([(t, language)], "t string, l string").select(unicode.sentences(F.col("t"), F.col("l")).alias("x")).first()["x"]
    assert [s["text"] for s in got] == want


def test_script_pre_tokens():
    assert unicode.script_pre_tokens("hello世界 мир, ok") == ["hello", "世", "界", "мир", ",", "ok"]


@pytest.mark.parametrize(
    ("markup", "prose"),
    [
        ("'''Bold''' [[Page|shown]] [[File:x.png|thumb]] {{tpl|a}} <ref>gone</ref> text<!-- no --> [https://x.org link] {| t |}&nbsp;end", "Bold shown text link end"),
        ("a {{x|{{y|{{z}} b}} c}} d", "a d"),  # any depth
        ("a [[File:p.png|thumb|of [[Here|there]]]] b [[Plain]] c", "a b Plain c"),
        ("a {{never closed [[b]]", "a {{never closed b"),
        ("a ]] b <ref name=x/> c<br/>d <ref>e {{f}}</ref> g", "a ]] b cd g"),
        ("a<!-- to the end", "a"),
        ("", ""),
    ],
)
def test_wikitext(spark, markup, prose):
    assert value(spark, unicode.wiki_prose, markup) == prose


def test_markup(spark):
    assert value(spark, text.has_markup, "a [[b") is True and value(spark, text.has_markup, "plain") is False


def test_language_names_and_scripts(spark):
    assert [value(spark, text.language_name, c) for c in ("hi", "EN-gb", "xx", "1")] == ["Hindi", "English", "xx", None]
    assert [value(spark, text.expected_script, c) for c in ("hi", "ru_RU", "xx", None)] == ["Deva", "Cyrl", None, None]


def test_language_codes(spark):
    for code, want in (("en", "en"), (" EN-us", "en"), ("zh_Hant", "zh"), ("mai", "mai"), ("e", None), ("1x", None)):
        assert value(spark, text.language_code, code) == want


def test_paragraphs(spark):
    assert value(spark, text.paragraphs, "a\n\nb c \n \t\n\n d") == ["a", "b c", "d"]


def test_sentence_pieces(spark):
    public = pytest.importorskip("public_tokenizers")
    spm = pytest.importorskip("sentencepiece")
    model = spm.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    assert value(spark, lambda c: unicode.pieces(c, public.path("piece_bpe_32k.model")), "Hello there") == model.encode("Hello there")


def test_registry():
    r = Registry("thing")
    r.register("One", lambda size=1: size)
    assert r.create("ONE", size=3) == 3 and r.from_config({"type": "one", "size": 2}) == 2 and r.keys() == ["one"]
    with pytest.raises(ValueError, match="there already"):
        r.register("one", int)
    with pytest.raises(KeyError, match="no thing"):
        r.get("two")
    with pytest.raises(TypeError, match="takes no"):
        r.create("one", colour=1)
    r.unregister("one")
    assert r.keys() == []


def test_sql_functions(spark):
    register_sql(spark)
    assert spark.sql("SELECT sentences('One. Two.') AS s, nfc('é') AS n").first() == (["One.", "Two."], "é")
