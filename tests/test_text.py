"""Hand-computed results of the text functions."""

import pytest
from pyspark.sql import functions as F

from emberloom import vocab
from emberloom.functions import text as T


def one(spark, f, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if not isinstance(v, dict) else 'map<string,string>'}" for k, v in values.items()))
    return df.select(f(*[F.col(k) for k in values]).alias("x")).first().x


def test_clean_name(spark):
    assert one(spark, T.clean_name, a=" 河童[12]　") == "河童"


def test_location_in_vocabulary_order(spark):
    assert one(spark, T.extract_location, a="土佐国と沖縄県と北海道と東京都") == "北海道、東京都、沖縄県"
    assert one(spark, T.extract_location, a="どこか") == vocab.NOWHERE


def test_summary(spark):
    assert one(spark, T.extract_summary, a="\n　\nひとつ。ふたつ！みっつ？よっつ。\n次の段落。") == "ひとつ。ふたつ！みっつ？"
    assert one(spark, T.extract_summary, a="あ" * 250) == "あ" * 200 + "…"
    assert one(spark, T.extract_summary, a="注[3]あり。") == "注あり。"
    assert one(spark, T.extract_summary, a="") == ""


def test_embedding_text(spark):
    assert one(spark, T.embedding_text, a="河童", b="川にいる。", c="岩手県") == "河童 川にいる。 地域: 岩手県"
    assert one(spark, T.embedding_text, a="河童", b="川にいる。", c=vocab.NOWHERE) == "河童 川にいる。"


def test_normalize_and_morphology(spark):
    assert one(spark, T.normalize_name, a="赤舌[注]、赤口, x") == "赤舌"
    assert tuple(one(spark, T.detect_suffix, a="海坊主")) == ("坊主", "人型・僧", "海")
    assert one(spark, T.detect_suffix, a="坊主") is None
    assert tuple(one(spark, T.detect_suffix, a="送り狐")) == ("狐", "動物・狐", "送り")
    assert tuple(one(spark, T.detect_prefix, a="送り狐")) == ("送り", "行為・送り", "狐")
    assert [tuple(x) for x in one(spark, T.detect_embedded, a="大天狗山")] == [("天狗", "超自然・天狗", 1), ("天", "場所・天", 1)]
    assert one(spark, T.slot_pattern, a="場所・海", b=None) == "[場所・海] + [BASE]"
    assert one(spark, T.slot_pattern, a=None, b=None) == ""


def test_classification_by_priority(spark):
    assert one(spark, T.classify, a="山で火の玉が死者を追う") == "死霊"
    assert one(spark, T.classify, a="山で火") == "山野"
    assert one(spark, T.classify, a="") is None


def test_regions(spark):
    assert one(spark, T.parse_regions, a="岩手県， 東京都、青森県、土佐国") == ["東北", "関東"]
    assert one(spark, T.parse_regions, a=vocab.NOWHERE) == [] and one(spark, T.parse_regions, a=None) == []
    assert one(spark, T.primary_region, a="土佐国、沖縄県") == "九州沖縄"


def test_search_query(spark):
    answers = {"when": "夕方", "where": "橋", "impression": "静か", "nature": " ", "event": "x"}
    assert one(spark, T.search_query, a="一行目\n二行目\n三行目", b=answers) == "一行目二行目\n三行目。夕方のころ、橋でその体験は静か。。"
    assert one(spark, T.search_query, a="ただの文", b={"x": "y"}) == "ただの文。"


def test_templates(spark):
    lines = ["a {x}", "", "{y}", "z"]
    assert one(spark, lambda x, y: T.fill_template(lines, {"x": x, "y": y}), x="1", y=None) == "a 1\n\nz"
    assert one(spark, lambda x, y: T.fill_template(lines, {"x": x, "y": y}, True), x="1", y="2") == "a 1\n2\nz"
    df = spark.createDataFrame([([("n", "l", "c"), ("m", "", "d")],)], "f array<struct<name:string,location:string,content:string>>")
    assert df.select(T.reference_lines(F.col("f"))).first()[0] == "- n（l）: c\n- m: d"


def test_signature_and_seeds(spark):
    assert one(spark, T.signature, a={"b": "2", "a": "1"}) == "a:1|b:2"
    assert one(spark, T.rolling_hash, a="あa") == (12354 + 97) % 9973
    assert one(spark, lambda a: T.client_seed(a, F.lit(3)), a="ab") == (97 + 98 + 3) % 997
    # beyond U+FFFF: a high surrogate, and both surrogates
    assert one(spark, T.rolling_hash, a="a😀") == (97 + 0xD83D) % 9973
    assert one(spark, lambda a: T.client_seed(a, F.lit(0)), a="😀\n") == (0xD83D + 0xDE00 + 10) % 997


def test_parse_reply(spark):
    got = one(spark, T.parse_reply, a='x [{"name":"n","type":"t"},{"reading":"r"}] y')
    assert [(r.name, r.reading, r.naming_type) for r in got] == [("n", "", "t"), ("名無し", "r", "unknown")]
    assert [(r.name, r.naming_type) for r in one(spark, T.parse_reply, a='{"name":"n"}')] == [("n", "place_action")]
    assert one(spark, T.parse_reply, a="nothing") is None


@pytest.mark.parametrize("text,ms", [("500ms", 500.0), ("12s", 12000.0), ("1.5s", 1500.0), ("250", 250.0), ("soon", None)])
def test_retry_delay(spark, text, ms):
    assert one(spark, T.retry_delay_ms, a=text) == ms


def test_small_ones(spark):
    assert one(spark, T.parse_multi_select, a="['A', 'B']") == ["A", "B"] and one(spark, T.parse_multi_select, a="{A,C}") == ["A", "C"]
    assert one(spark, T.strip_braces, a="{'A' }") == "A"
    assert one(spark, T.quote_url, a="a b/c+ä") == "a%20b/c%2B%C3%A4"
    assert one(spark, T.first_number, a="x", b="429 Too Many") == 429
    assert bytes(one(spark, T.data_uri_bytes, a="data:x;base64,aGk=")) == b"hi"
    assert one(spark, lambda a: T.tokens(a), a="passage: 河童 a bc") == ["河童", "bc"]
    assert one(spark, T.is_rate_limited, a="429", b="x") is True
