"""Lexing of C-like source as column expressions: tokens, names in order of appearance, vocabulary classes.

A text is cut by one pattern whose alternatives stand from the longest token to the shortest, so each
place gives its longest token; what no rule takes is a token of one character. Cutting loses nothing."""

from __future__ import annotations

import functools
import hashlib
import re
import string
import sys
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.tokens import META

#: Space, meta tokens, comments, literals, names, numbers, operators, any other character. Possessive
#: repeats keep the matcher from recursing on long tokens; lexeme_pattern gives the pattern without them.
_RULES = (
    r"[ \t\n\x0B\f\r]++",
    r"\[[ \t]*+(?:START|MASK|HOLE|ENDHOLE|END|PAD)[ \t]*+\]",
    r"//[^\n]*+",
    r"/\*.*?\*/",
    r'"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"',
    r"'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'",
    r"[\p{L}_][\p{L}\p{Nd}_]*+",
    r"\.?[0-9][A-DF-OQ-Za-df-oq-z0-9_.]*+(?:[eEpP][-+]?[A-DF-OQ-Za-df-oq-z0-9_.]*+)*+",
    r"<<=|>>=|\.\.\.|->|\+\+|--|&&|\|\||<<|>>|##|[-+*/%&|^<>=!]=",
    r".",
)
#: Words of C and of OpenCL C that are no names.
C_KEYWORDS = (
    "auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed sizeof static struct switch "
    "typedef union unsigned void volatile while _Bool _Complex _Imaginary"
).split()
CL_KEYWORDS = (
    "kernel __kernel global __global local __local constant __constant private __private read_only __read_only write_only __write_only read_write __read_write "
    "bool half uchar ushort uint ulong size_t ptrdiff_t intptr_t uintptr_t image1d_t image2d_t image3d_t sampler_t event_t"
).split()
VECTOR_TYPES = [f"{base}{n}" for base in ("char", "uchar", "short", "ushort", "int", "uint", "long", "ulong", "half", "float", "double") for n in (2, 3, 4, 8, 16)]
KEYWORDS = [*C_KEYWORDS, *CL_KEYWORDS, *VECTOR_TYPES]
_RESERVED_WORDS = frozenset(KEYWORDS)
#: Words behind which a name with a bracket is a call, not a declaration.
BEFORE_CALLS = ("return", "else", "do", "case", "goto", "sizeof")
#: Marks of canonical tokens: a renamed one, any other.
RENAMED, PLAIN = "\x01", "\x02"


def lexeme_pattern(possessive: bool = True) -> str:
    pattern = "(?s)" + "|".join(_RULES)
    return pattern if possessive else pattern.replace("*+", "*").replace("++", "+")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often ``body`` names it, lambdas included."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lexemes(text: Column) -> Column:
    """All tokens with the white space between them; joined they are the text."""
    return F.regexp_extract_all(text, F.lit(lexeme_pattern()), F.lit(0))


def tokens(text: Column) -> Column:
    """Tokens without white space; meta tokens without blanks inside."""
    meta = lambda x: F.when(x.startswith("[") & (F.length(x) > 1), F.regexp_replace(x, "[ \t]", "")).otherwise(x)
    return F.transform(F.filter(lexemes(text), lambda x: ~x.rlike(r"^[ \t\n\x0B\f\r]")), meta)


@functools.cache
def _matcher() -> re.Pattern:
    """White space in front and a token, for plain Python; names come first, as nothing else begins like them. Its word
    characters are letters, decimal digits and _, but for _number_signs."""
    rules = [_RULES[6].replace(r"\p{L}\p{Nd}_", r"\w").replace(r"[\p{L}_]", r"[^\W\d]"), *(x for x in _RULES[1:] if x != _RULES[6])]
    return re.compile(rf"(?s)[ \t\n\x0B\f\r]*+({'|'.join(rules)}|\Z)")


@functools.cache
def _number_signs() -> tuple[frozenset[str], re.Pattern]:
    """Numbers that are no decimal digits, which are no part of a name, and a pattern that knows them."""
    signs = [c for c in map(chr, range(sys.maxunicode + 1)) if c.isalnum() and not c.isalpha() and not c.isdecimal()]
    own = "".join(signs)
    return frozenset(signs), re.compile(_matcher().pattern.replace(r"[^\W\d][\w]*+", rf"[^\W\d{own}][^\W{own}]*+"))


def text_tokens(text: str) -> list[str]:
    """``tokens`` of one text inside a task."""
    odd = not text.isascii() and not _number_signs()[0].isdisjoint(text)
    w = (_number_signs()[1] if odd else _matcher()).findall(text)
    while w and not w[-1]:
        w.pop()
    return [x if x[0] != "[" or len(x) == 1 else x.replace(" ", "").replace("\t", "") for x in w] if "[" in text else w


#: First signs of the tokens that can hold white space, which are meta tokens, comments and strings. Any other token has such
#: a sign only at its beginning, so the first place that begins one of these begins a token.
OPENING = ("[", "/", '"', "'")
_SPANNING = re.compile("(?s)(" + "|".join(_RULES[1:6]) + ")")
_BLANKS = re.compile("[ \t\n\x0b\f\r]+")
_SIGNS, _QUOTES, _DIGITS = frozenset(string.punctuation) - {"_"}, frozenset("'\""), frozenset("0123456789")


def text_words(text: str) -> list[str]:
    """Words of a text, whose tokens one behind the other are the text's: what stands between white space, and tokens that
    can hold white space. A text without OPENING is only split."""
    words = []
    for k, x in enumerate(_SPANNING.split(text)):
        words += [x] if k % 2 else filter(None, _BLANKS.split(x))
    return words


def word_tokens(word: str) -> list[str]:
    """Tokens of one of ``text_words``."""
    return [word[:-1], word[-1]] if word[-1] in _SIGNS and word[:-1].isalpha() else text_tokens(word)


def literal(x: str) -> bool:
    """Whether a token is a string or a number."""
    first = x[:1]
    return (first in _QUOTES and len(x) > 1) or first in _DIGITS or (first == "." and x[1:2] in _DIGITS)


def named(x: str) -> bool:
    """Whether a token is a name."""
    return (x[:1] == "_" or x[:1].isalpha()) and x not in _RESERVED_WORDS


def canonical_tokens(text: Column) -> Column:
    """Tokens with names numbered by first appearance (RENAMED and the number); all others follow PLAIN.

    What a text doesn't bind keeps its name: keywords, members behind . or ->, and functions that it calls but doesn't
    declare. So texts are equal exactly if one becomes the other by a one-to-one change of bound names. White
    space between tokens plays no part. (A declared function is recognised behind a plain type name; one that
    returns a pointer counts as called, and keeps its name.)"""

    return _canonical("array<string>")(tokens(text))


def canonical_key(text: Column) -> Column:
    """SHA-256 of canonical_tokens without spaces and line ends; null for null."""
    return _canonical("string")(tokens(text))


def _canonical(kind: str) -> Callable[[Column], Column]:
    """Canonical tokens of token arrays, or their digest (kind: string), in one pass; names are numbered by a table, which is
    linear, as a search in an array of names isn't. Distinct tokens of a batch are looked at once."""
    keywords = frozenset(KEYWORDS)

    def of_texts(w: pa.Array) -> pa.Array:
        held = w.flatten().dictionary_encode()
        vocabulary, at = held.dictionary.to_pylist(), held.indices.to_pylist()
        word = [x[:1] == "_" or x[:1].isalpha() for x in vocabulary]
        name = [y and x not in keywords for x, y in zip(vocabulary, word, strict=True)]
        member, bracket = ({k for k, x in enumerate(vocabulary) if x in some} for some in ((".", "->"), ("(",)))
        declares = {k for k, x in enumerate(vocabulary) if word[k] and x not in BEFORE_CALLS}
        plain = [PLAIN + (x if kind != "string" else x.replace(" ", "").replace("\n", "")) for x in vocabulary]
        out, end = [], 0
        for n in w.value_lengths().to_pylist():
            if n is None:
                out.append(None)
                continue
            own, end = at[end : end + n], end + n
            before, behind = [-1, *own], [*own[1:], -1]
            declared = {x for x, b, a in zip(own, before, behind, strict=False) if a in bracket and name[x] and b in declares}
            numbers: dict[int, str] = {}
            line = [
                (numbers.get(x) or numbers.setdefault(x, f"{RENAMED}{len(numbers) + 1}")) if name[x] and b not in member and (a not in bracket or x in declared) else plain[x]
                for x, b, a in zip(own, before, behind, strict=False)
            ]
            out.append(line if kind != "string" else hashlib.sha256("".join(line).encode()).hexdigest())
        return pa.array(out, pa.string() if kind == "string" else pa.list_(pa.string()))

    return F.arrow_udf(of_texts, kind)


#: Entries in front of a lexer vocabulary's tokens: meta tokens and printable characters.
RESERVED = len(META) + 100
