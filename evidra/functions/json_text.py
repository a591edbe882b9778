"""JSON text: a canonical form, and attribute values of any depth without their type wrappers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidra.functions import arrays

#: Marks from the private area of Unicode: for braces within texts, for braces of finished values, for an escaped backslash and quote.
_WITHIN, _DONE, _SLASH, _QUOTE = "", "", "", ""
_MARKS = "{}[]"


def canonical_text(json: Column) -> Column:
    """JSON text with the keys of every object sorted and no spaces, at any depth; null where the text is no JSON."""
    return F.to_json(F.try_parse_json(json))


def canonical(value: Column) -> Column:
    """A struct, map, array or variant as canonical JSON."""
    return canonical_text(F.to_json(value))


def unwrapped(json: Column) -> Column:
    """An attribute value's nested JSON (``arrayValue``, ``kvlistValue``) as plain lists and objects of texts, however deep; null where it is no such value.

    Made canonical first, so that a pair's key comes before its value.  Braces within texts are marked, so that all that are
    left are structure; scalars lose their wrappers at once, and each round then turns the innermost lists, pairs and objects into
    finished text, whose braces are marked too.  There are as many rounds as levels; every pattern is a plain run of characters.
    """
    c = canonical_text(json)
    for mark in _WITHIN + _DONE + _SLASH + _QUOTE:  # a text that has them itself has them escaped
        c = F.replace(c, F.lit(mark), F.lit(f"\\u{ord(mark):04x}"))
    c = F.replace(F.replace(c, F.lit("\\\\"), F.lit(_SLASH)), F.lit('\\"'), F.lit(_QUOTE))
    c = F.array_join(F.transform(F.split(c, '"'), lambda x, i: F.when(i % 2 == 1, F.translate(x, _MARKS, _WITHIN)).otherwise(x)), '"')
    c = F.regexp_replace(c, r'\{"(?:string|bytes)Value":("[^"]*+")\}', "$1")
    c = F.regexp_replace(c, r'\{"(?:int|double|bool)Value":"?([^"{}\[\]]++)"?\}', '"$1"')
    a, b, e, f = _DONE

    def inwards(x: Column) -> Column:
        x = F.regexp_replace(x, r'\{"arrayValue":\{(?:"values":\[([^{}\[\]]*+)\])?\}\}', f"{e}$1{f}")
        x = F.regexp_replace(x, r'\{"key":("[^"]*+"),"value":([^{}\[\]]++)\}', "$1:$2")
        return F.regexp_replace(x, r'\{"kvlistValue":\{(?:"values":\[([^{}\[\]]*+)\])?\}\}', f"{a}$1{b}")

    rounds = F.sequence(F.lit(1), F.greatest(F.lit(1), F.regexp_count(json, F.lit(r'Value"\s*:\s*\{'))))
    done = F.aggregate(rounds, c, lambda x, _: F.when(x.contains('Value":{'), inwards(x)).otherwise(x))
    text = arrays.let(done, lambda x: F.when(~x.rlike(r"[{}\[\]]"), F.translate(x, _WITHIN + _DONE, _MARKS * 2)))
    return canonical_text(F.replace(F.replace(text, F.lit(_SLASH), F.lit("\\\\")), F.lit(_QUOTE), F.lit('\\"')))
