import hashlib
import hmac
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hushdex.functions import blind, extract, keys, tokens

KEY = bytes(range(32))


def tokens_of(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(tokens.token_set(F.col("t")).alias("s"))
    return [(r["s"]["words"], r["s"]["trigrams"]) for r in df.collect()]


def test_tokens(spark):
    got = tokens_of(spark, ["Green lamp, GREEN table", "", None, "a_b-c@d\x00e", "ab abc"])
    assert got[0] == (["w:green", "w:lamp", "w:table"], ["t:abl", "t:amp", "t:ble", "t:een", "t:gre", "t:lam", "t:ree", "t:tab"])
    assert got[1] == got[2] == ([], [])
    assert got[3] == (["w:a", "w:b", "w:c", "w:d", "w:e"], [])
    assert got[4] == (["w:ab", "w:abc"], ["t:abc"])


def test_unicode_tokens(spark):
    got = tokens_of(spark, ["ΟΔΟΣ", "Ⓐbc", "a😀b", "ÉTÉ été", "𝐀𝐁𝐂", "नमस्ते"])
    assert [w for w, _ in got] == [["w:οδος"], ["w:ⓐbc"], ["w:a", "w:b"], ["w:été"], ["w:𝐀𝐁𝐂"], ["w:ते", "w:नमस"]]
    assert got[4][1] == ["t:𝐀𝐁𝐂"]


def test_column_and_plain_tokens_agree(spark):
    texts = ["Green lamp", "ÀÉÎ-õü 12,5 x9", "ΟΔΟΣ ß", "Ⓐbc", "a😀b", "漢字かな 交じり", "naïve\u200bword", "x²y", "नमस्ते"]
    assert tokens_of(spark, texts) == [tokens.plain_tokens(t) for t in texts]


def test_column_and_plain_tokens_agree_on_every_code_point(spark):
    texts = ["".join(f"a{chr(c)}b " for c in range(k, k + 512) if not 0xD800 <= c < 0xE000) for k in range(0, 0x110000, 512)]
    got = tokens_of(spark, texts)
    wrong = [hex(k * 512) for k, (t, g) in enumerate(zip(texts, got, strict=True)) if g != tokens.plain_tokens(t)]
    assert wrong == []


def test_hmac_fixed_values(spark):
    want = {"w:lamp": "4120f1aa590b32fb8aee13f67f81bfc403cbc3d69cc958131e263f517d1943e5", "t:lam": "54325339be93f853e63469405c22b7913c32f479e9ce050ed99fc1e5ee4304c9"}
    i, o = keys.pads(KEY)
    df = spark.createDataFrame([(t, bytearray(i), bytearray(o)) for t in want], "t string, i binary, o binary")
    got = {r["t"]: r["h"] for r in df.select("t", blind.hmac_hex(F.col("t"), F.col("i"), F.col("o")).alias("h")).collect()}
    assert got == want == {t: keys.blind_token(KEY, t) for t in want}


def test_key_derivation():
    assert keys.derive(b"sample shared secret", b"sample-info").hex() == "de4a8fb6175e96b67056d4e5d1da7bb520634785c28cea99a75903a706a868c8"
    with pytest.raises(ValueError):
        keys.from_bytes(b"short")
    assert len(keys.generate()) == 32 and keys.generate() != keys.generate()


def test_key_is_in_no_plan(spark):
    rows = spark.createDataFrame([("x", "some text")], "index string, text string")
    plan = blind.blinded(rows, tokens.token_set(F.col("text")), blind.key_table(spark, {"x": KEY}))._jdf.queryExecution().toString()
    assert KEY.hex() not in plan.lower() and keys.pads(KEY)[0].hex() not in plan.lower()


DOC = '{"who":"Ana","town":"Oslo","n":7,"in":{"x":"deep"}}'


@pytest.mark.parametrize(
    ("data", "field", "text"),
    [
        (DOC, "who", "Ana"), (DOC, "n", ""), (DOC, "in", ""), (DOC, "nope", ""), (DOC, None, "Ana Oslo"),
        ("42", None, "42"), ("1.0", None, "1.0"), ('"quoted"', None, "quoted"), ('[1, "x"]', None, '[1,"x"]'), ("null", None, "null"), ('"s"', "who", ""),
        ("plain words", "who", "plain words"), ('{"a":"b"} tail', None, '{"a":"b"} tail'), ('{"a":"1","a":"2"}', None, "2"),
        ("NaN", None, "NaN"), ('{"a":"\\ud800"}', None, '{"a":"\\ud800"}'), ("", None, ""), ("[" * 5000, None, "[" * 5000),
    ],
)
def test_extract(data, field, text):
    assert extract.text_of(data.encode(), field) == text


def test_extract_bytes_and_column(spark):
    assert extract.text_of(b"\xff\xfeab") == "\ufffd\ufffdab"
    df = spark.createDataFrame([(bytearray(DOC.encode()),), (bytearray(b"\xff"),), (None,)], "d binary")
    assert [r[0] for r in df.select(extract.extracted(F.col("d"), "town")).collect()] == ["Oslo", "\ufffd", None]


@settings(deadline=None)
@given(st.dictionaries(st.text(max_size=5), st.one_of(st.text(max_size=8), st.integers(-(2**63), 2**63 - 1), st.none()), max_size=4))
def test_extract_takes_top_level_strings(value):
    assert extract.text_of(json.dumps(value, ensure_ascii=False).encode("utf-8", "surrogatepass")) == " ".join(v for v in value.values() if isinstance(v, str))


def test_base64_is_strict(spark):
    cases = ["SGVsbG8=", "SGVsbG8", "SGVsbG9=", "SGVs bG8=", "_-8="]
    df = spark.createDataFrame([(c,) for c in cases], "c string").select("c", blind.strict_base64(F.col("c")).alias("b"))
    got = {r["c"]: r["b"] for r in df.collect()}
    assert got["SGVsbG8="] == bytearray(b"Hello") and [got[c] for c in cases[1:]] == [None] * 4
    assert blind.decode_base64(cases[0]) == b"Hello"
    for c in cases[1:]:
        with pytest.raises(ValueError):
            blind.decode_base64(c)


def test_clients_and_columns_agree_on_the_wire(spark):
    """Token sets of many lines' worth of base64, made on either side and read on the other."""
    key = blind.BlindKey(KEY)
    words, trigrams = key.tokenize("a text of more than a few words")
    sent = blind.encode_set(words, trigrams)
    row = spark.createDataFrame([(sent, words, trigrams)], "t string, words array<string>, trigrams array<string>").select(blind.unwire(F.col("t")).alias("s"), blind.wire(F.struct("words", "trigrams")).alias("w")).first()
    assert (row["s"]["words"], row["s"]["trigrams"], row["w"]) == (words, trigrams, sent)


def test_wire(spark):
    df = spark.createDataFrame([(["ab"], ["cd", "ef"])], "words array<string>, trigrams array<string>").select(blind.wire(F.struct("words", "trigrams")).alias("w"))
    text = df.first()["w"]
    assert blind.decode_set(text) == (["ab"], ["cd", "ef"]) and text == blind.encode_set(["ab"], ["cd", "ef"])
    back = df.select(blind.unwire(F.col("w")).alias("s")).select("s.*", blind.well_formed(F.col("s")).alias("ok")).first()
    assert (list(back["words"]), list(back["trigrams"]), back["ok"]) == (["ab"], ["cd", "ef"], False)
    for bad in ('{"words":[]}', '{"words":[1],"trigrams":[]}', "[]", "x"):
        with pytest.raises(ValueError):
            blind.decode_set(__import__("base64").b64encode(bad.encode()).decode())


def test_client_key_equals_index_hashes(spark):
    client = blind.BlindKey(KEY)
    words, trigrams = client.tokenize("Red lamp")
    assert words == [hmac.new(KEY, t, hashlib.sha256).hexdigest() for t in (b"w:lamp", b"w:red")]
    rows = spark.createDataFrame([("x", "Red lamp")], "index string, text string")
    row = blind.blinded(rows, tokens.token_set(F.col("text")), blind.key_table(spark, {"x": KEY})).first()["tokens"]
    assert (row["words"], row["trigrams"]) == (words, trigrams)
    assert client.tokenize_field(b'{"a":"red lamp"}', "a") == (words, trigrams)
    assert blind.BlindKey.derive(b"s", b"i").as_bytes() == keys.derive(b"s", b"i")
    assert len(blind.BlindKey.generate().as_bytes()) == 32
