"""Keyed hashes of tokens, in columns and on the client's side; the wire form of token sets."""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hushdex.functions import extract, keys, tokens
from hushdex.sources.local import frame

BLIND_SET = "words array<string>, trigrams array<string>"
_HEX = r"\A[0-9a-f]{64}\z"


def hmac_hex(token: Column, ipad: Column, opad: Column) -> Column:
    """HMAC-SHA256 of a token as lowercase hex, from the key's two pads."""
    inner = F.unhex(F.sha2(F.concat(ipad, F.encode(token, "UTF-8")), 256))
    return F.sha2(F.concat(opad, inner), 256)


def key_table(spark: SparkSession, by_index: dict[str, bytes]) -> DataFrame:
    """(index, ipad, opad) rows. Joined as data, so that no key shows in a plan."""
    return frame(spark, [(name, *keys.pads(k)) for name, k in by_index.items()], "index string, ipad binary, opad binary")


def blinded(df: DataFrame, token_set: Column, key_rows: DataFrame, out: str = "tokens") -> DataFrame:
    """``df`` (with a column index) and struct ``out`` of both lists, each token hashed.

    ``key_rows`` has one row for each index, as the catalogue has.
    """
    each = lambda arr: F.transform(arr, lambda t: hmac_hex(t, F.col("ipad"), F.col("opad")))
    plain = df.withColumn(out, token_set).join(F.broadcast(key_rows), "index")
    return plain.withColumn(out, F.struct(each(F.col(f"{out}.words")).alias("words"), each(F.col(f"{out}.trigrams")).alias("trigrams"))).drop("ipad", "opad")


# -- wire ------------------------------------------------------------------------


def unbroken_base64(data: Column) -> Column:
    """Base64 on one line; Spark's own breaks it every 76 characters."""
    return F.translate(F.base64(data), "\r\n", "")


def wire(token_set: Column) -> Column:
    """Base64 of the token set's JSON."""
    return unbroken_base64(F.encode(F.to_json(token_set), "UTF-8"))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value worked out once however often it is used."""
    return F.transform(F.array(value), use)[0]


def strict_base64(text: Column) -> Column:
    """Bytes, or null where the text is not canonical base64."""
    same = lambda t: _once(F.try_to_binary(t, F.lit("base64")), lambda data: F.when(unbroken_base64(data) == t, data))
    return _once(text, same)


def unwire(text: Column) -> Column:
    """Token set of a wire text; null unless both lists are there."""
    got = F.from_json(F.decode(strict_base64(text), "UTF-8"), BLIND_SET)
    return _once(got, lambda s: F.when(s["words"].isNotNull() & s["trigrams"].isNotNull(), s))


def checked(text: Column) -> Column:
    """Token set of a wire text; null also if a token is not well formed."""
    return _once(unwire(text), lambda s: F.when(well_formed(s), s))


def well_formed(token_set: Column) -> Column:
    """All tokens are 64 lowercase hex digits."""
    ok = lambda arr: F.forall(arr, lambda t: F.coalesce(t.rlike(_HEX), F.lit(False)))
    return ok(token_set["words"]) & ok(token_set["trigrams"])


# -- without Spark ---------------------------------------------------------------

_HEX_PY = re.compile(r"[0-9a-f]{64}")


def decode_base64(text: str) -> bytes:
    try:
        data = base64.b64decode(text, validate=True)
    except (binascii.Error, ValueError) as e:
        raise ValueError("invalid base64") from e
    if base64.b64encode(data).decode() != text:
        raise ValueError("invalid base64")
    return data


def encode_set(words: list[str], trigrams: list[str]) -> str:
    return base64.b64encode(json.dumps({"words": words, "trigrams": trigrams}, separators=(",", ":")).encode()).decode()


def decode_set(text: str) -> tuple[list[str], list[str]]:
    """Both lists of a wire text; anything but two lists of strings is refused."""
    try:
        value = json.loads(decode_base64(text))
    except UnicodeDecodeError as e:
        raise ValueError("invalid blind tokens") from e
    if not isinstance(value, dict) or not all(isinstance(value.get(k), list) and all(isinstance(t, str) for t in value[k]) for k in ("words", "trigrams")):
        raise ValueError("invalid blind tokens: two lists of strings expected")
    return value["words"], value["trigrams"]


def check_hex(words: list[str], trigrams: list[str]) -> None:
    for t in (*words, *trigrams):
        if not _HEX_PY.fullmatch(t):
            raise ValueError("a blind token is 64 lowercase hex digits")


class BlindKey:
    """A client's key: tokenise and hash where the text is, send only hashes."""

    def __init__(self, data: bytes) -> None:
        self._key = keys.from_bytes(data)

    @classmethod
    def generate(cls) -> BlindKey:
        return cls(keys.generate())

    @classmethod
    def derive(cls, secret: bytes, info: bytes) -> BlindKey:
        return cls(keys.derive(secret, info))

    def as_bytes(self) -> bytes:
        return self._key

    def blind(self, words: list[str], trigrams: list[str]) -> tuple[list[str], list[str]]:
        one = lambda ts: [keys.blind_token(self._key, t) for t in ts]
        return one(words), one(trigrams)

    def tokenize(self, text: str) -> tuple[list[str], list[str]]:
        return self.blind(*tokens.plain_tokens(text))

    def tokenize_field(self, data: bytes, field: str | None) -> tuple[list[str], list[str]]:
        return self.tokenize(extract.text_of(data, field))
