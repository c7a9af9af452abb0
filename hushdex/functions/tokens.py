"""Word and trigram tokens, as column expressions and in plain Python."""

from __future__ import annotations

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Version of the token rules; an index built under another one must be refilled.
TOKENIZER_VERSION = 1
#: Kinds of tokens and the marks in front of them.
WORD, TRIGRAM = "w", "t"

#: Java regex: whatever is neither alphabetic nor numeric separates words.
SEPARATOR = r"[^\p{IsAlphabetic}\p{N}]+"


def words(text: Column) -> Column:
    """Lower-cased words in text order, repeats included."""
    return F.filter(F.split(F.lower(text), SEPARATOR), lambda w: w != "")


def _trigrams_of(word: Column) -> Column:
    n = F.char_length(word)
    # sequence() counts down when its end lies before its start, so short words are kept away.
    return F.when(n >= 3, F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.substring(word, i, F.lit(3)))).otherwise(F.array().cast("array<string>"))


def _marked(kind: str, found: Column) -> Column:
    """Sorted tokens of distinct texts; the mark in front changes no order."""
    return F.transform(F.array_sort(found), lambda x: F.concat(F.lit(f"{kind}:"), x))


def _trigrams(distinct: Column) -> Column:
    # Of distinct words: a text repeats most of them.
    return F.array_distinct(F.flatten(F.transform(distinct, _trigrams_of)))


def word_tokens(text: Column) -> Column:
    """Sorted distinct ``w:`` tokens."""
    return _marked(WORD, F.array_distinct(words(text)))


def trigram_tokens(text: Column) -> Column:
    """Sorted distinct ``t:`` tokens of words of three characters or more."""
    return _marked(TRIGRAM, _trigrams(F.array_distinct(words(text))))


def token_set(text: Column) -> Column:
    """Struct of both token lists; a null text has empty lists."""
    distinct = F.array_distinct(words(F.coalesce(text, F.lit(""))))
    # A list of one, so that the words are cut once for both lists.
    return F.transform(F.array(distinct), lambda d: F.struct(_marked(WORD, d).alias("words"), _marked(TRIGRAM, _trigrams(d)).alias("trigrams")))[0]


# -- the same without Spark ------------------------------------------------------

#: Code points that Python's Unicode tables take for letters or numbers
#: and those of the JVM (version 17) do not, in order.
NEWER = """
363-36f 558 58b-58c 5c8-5c9 870-887 889-88f 897 8b5 8c8-8c9 c04 c5c-c5d cdc-cdd
cf3 f82-f83 170d 171f 1acc-1ace 1b4c 1c89-1c8a 1dd3-1de6 208f 209d-209f 2c2f 2c5f
9ffd-9fff a7c0-a7c1 a7cb-a7dd a7e2 a7f1-a7f4 ab6c-ab6d 10570-1057a 1057c-1058a 1058c-10592 10594-10595 10597-105a1 105a3-105b1
105b3-105b9 105bb-105bc 105c0-105f3 10780-10785 10787-107b0 107b2-107bf 10940-10959 10d40-10d65 10d69 10d6f-10d85 10ec2-10ec7 10ecb-10ecd
10ed9-10eee 10ef3 10ef5 10ef7-10ef8 10efa-10efc 10f70-10f81 11071-11075 11080-11081 110c2 1123f-11241 11380-11389 1138b
1138e 11390-113b5 113b7-113c0 113c2 113c5 113c7-113ca 113cc-113cd 113d1 113d3 116d0-116e3 11740-11746 11ab0-11abf
11b0a 11b60-11b67 11bc0-11be0 11bf0-11bf9 11db0-11ddb 11de0-11de9 11df0-11df1 11f00-11f10 11f12-11f3a 11f3e-11f40 11f50-11f59 1246f
12475-1247f 12550-12686 12f90-12ff0 1342f 13441-13446 13460-143fa 16100-1612e 16130-16139 16a70-16abe 16ac0-16ac9 16d40-16d6c 16d70-16d79
16ea0-16eb8 16ebb-16ed3 16ff2-16ff6 187f8-187ff 18cd6-18cda 18cff 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1aff0-1aff3 1aff5-1affb
1affd-1affe 1b11f-1b128 1b132 1b155 1b168 1ccf0-1ccf9 1d2c0-1d2d3 1d6a6 1df00-1df81 1df90-1df96 1dfcd-1dfff 1e030-1e06d
1e08f 1e290-1e2ad 1e4d0-1e4eb 1e4f0-1e4f9 1e5d0-1e5ed 1e5f0-1e5fa 1e6c0-1e6de 1e6e0-1e6f5 1e6fe-1e6ff 1e7e0-1e7e6 1e7e8-1e7eb 1e7ed-1e7ee
1e7f0-1e7fe 2a6de-2a6df 2b735-2b73f 2b81e 2cea2-2cead 2ebf0-2ee5d 31350-33479 3d000-3fc3f
"""


#: Capitals that Spark's tables know and Python's (version 15.1) do not,
#: and their small letters.
CAPITALS = {0xA7CB: 0x264, 0xA7DC: 0x19B}


def _words_pattern() -> regex.Pattern:
    ranges = [r.split("-") for r in NEWER.split()]
    out = "".join("-".join(f"\\U{int(x, 16):08x}" for x in r) for r in ranges)
    return regex.compile(rf"(?V1)[[\p{{Alphabetic}}\p{{N}}]--[{out}]]+")


_WORDS = _words_pattern()


def plain_tokens(text: str) -> tuple[list[str], list[str]]:
    """Sorted distinct word and trigram tokens of a string, those of the columns above."""
    found = set(_WORDS.findall(text.translate(CAPITALS).lower()))
    return sorted(f"w:{w}" for w in found), sorted({f"t:{w[k : k + 3]}" for w in found for k in range(len(w) - 2)})
