"""Places inside JSON text, so that one value can be read or replaced and all else stays byte for byte.

Expressions over the text's tokens, in one pass a step of the path: nothing is parsed into a value and written anew.
Texts are taken to be valid JSON; a key is compared as it is written, so one written with escapes isn't found.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Two signs of a private area for an escape, so that a quote in a string isn't taken for its end and places stay.
_ESCAPED = "\ue000\ue000"
_TOKEN = r'"[^"]*+"|[{}\[\],:]|\s++|[^\s{}\[\],:"]++'


def tokens(text: Column) -> Column:
    """Strings, signs, blanks and other runs, which together have the text's length; escapes are masked."""
    return F.regexp_extract_all(F.regexp_replace(text, r"(?s)\\.", _ESCAPED), F.lit(_TOKEN), F.lit(0))


def path_parts(path: Column) -> Column:
    """``a.b[0]`` as its keys and indexes."""
    return F.regexp_extract_all(path, F.lit(r"[^.\[\]]+"), F.lit(0))


def member_span(text: Column, key: Column) -> Column:
    """struct(start, length) of the value of a key, or of an index, at the text's first level; the last of repeated keys; start 0 if there is none."""
    int_ = lambda n: F.lit(n).cast("int")
    first = F.struct(
        int_(1).alias("pos"), int_(0).alias("depth"), F.lit(False).alias("object"), int_(0).alias("index"), F.lit(None).cast("string").alias("name"),
        int_(0).alias("start"), int_(0).alias("stop"), int_(0).alias("hit"), int_(0).alias("size"),
    )

    def step(at: Column, token: Column) -> Column:
        sign, n = F.substring(token, 1, 1), F.char_length(token)
        opens, closes, blank = sign.isin("{", "["), sign.isin("}", "]"), token.rlike(r"^\s")
        top = at["depth"] == 1
        done, named = top & (closes | (sign == ",")), top & (sign == ":")
        begins = top & (at["start"] == 0) & ~blank & ~closes & ~sign.isin(",", ":")
        mine = done & (at["start"] > 0) & (F.when(at["object"], at["name"]).otherwise(at["index"].cast("string")) == key)
        mine = F.coalesce(mine, F.lit(False))
        return F.struct(
            (at["pos"] + n).alias("pos"),
            (at["depth"] + opens.cast("int") - closes.cast("int")).alias("depth"),
            F.when(at["depth"] == 0, sign == "{").otherwise(at["object"]).alias("object"),
            (at["index"] + (top & (sign == ",")).cast("int")).alias("index"),
            F.when(done, None).when(named, F.substring(text, at["start"] + 1, at["stop"] - at["start"] - 2)).otherwise(at["name"]).alias("name"),
            F.when(done | named, int_(0)).when(begins, at["pos"]).otherwise(at["start"]).alias("start"),
            F.when(blank | done, at["stop"]).otherwise(at["pos"] + n).alias("stop"),
            F.when(mine, at["start"]).otherwise(at["hit"]).alias("hit"),
            F.when(mine, at["stop"] - at["start"]).otherwise(at["size"]).alias("size"),
        )

    return F.aggregate(tokens(text), first, step, lambda at: F.struct(at["hit"].alias("start"), at["size"].alias("size")))


def span(text: Column, path: Column) -> Column:
    """struct(start, size) of the value at a path (array of keys and indexes) in the text; start 0 if there is none."""
    whole = F.struct(F.lit(1).cast("int").alias("start"), F.char_length(text).cast("int").alias("size"))

    def inner(at: Column, key: Column) -> Column:
        found = F.transform(F.array(member_span(F.substring(text, at["start"], at["size"]), key)), lambda m: F.struct(F.when((m["start"] > 0) & (at["start"] > 0), at["start"] + m["start"] - 1).otherwise(F.lit(0)).cast("int").alias("start"), m["size"].alias("size")))
        return F.get(found, 0)

    return F.aggregate(path, whole, inner)


def value_at(text: Column, path: Column) -> Column:
    """The value at a path as it is written; null if there is none."""
    return F.get(F.transform(F.array(span(text, path)), lambda s: F.when(s["start"] > 0, F.substring(text, s["start"], s["size"]))), 0)


def with_value(text: Column, path: Column, value: Column) -> Column:
    """The text with the value (JSON) at a path, all else byte for byte; as it is if there is no such place."""

    def put(s: Column) -> Column:
        after = s["start"] + s["size"]
        return F.when(s["start"] > 0, F.concat(F.substring(text, F.lit(1), s["start"] - 1), value, F.substring(text, after, F.char_length(text)))).otherwise(text)

    return F.get(F.transform(F.array(span(text, path)), put), 0)


def quoted(text: Column) -> Column:
    """A JSON string of the text."""
    out = F.regexp_replace(text, r'(["\\])', r"\\$1")
    for sign, written in (("\n", r"\\n"), ("\r", r"\\r"), ("\t", r"\\t"), ("\b", r"\\b"), ("\f", r"\\f")):
        out = F.regexp_replace(out, F.lit(sign), F.lit(written))
    return F.concat(F.lit('"'), out, F.lit('"'))


def plain(value: Column) -> Column:
    """The text of a JSON string, other values as they are written."""
    return F.when(F.startswith(value, F.lit('"')), F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v")).otherwise(value)
