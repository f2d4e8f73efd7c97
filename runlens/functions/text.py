"""Prompt texts and the clean-up of generated replies."""

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens import constants as C

_REPLY = T.StructType([
    T.StructField("dialogue", T.StringType()),
    T.StructField("bargain_descriptions", T.ArrayType(T.StringType())),
])


def fill(template: Column, **values: Column) -> Column:
    """`template` with each `{name}` replaced by the value of that name."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def spaced(name: Column) -> Column:
    return F.replace(name, F.lit("_"), F.lit(" "))


def bargain_prompt(template: Column, primary: Column, secondary: Column) -> Column:
    return fill(template, primary_feature=spaced(primary), secondary_feature=spaced(secondary))


def reply_object(reply: Column) -> Column:
    """Text from the first `{` to the last `}` of a reply, null when there is none."""
    found = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def parse_reply(reply: Column) -> Column:
    """Struct<dialogue, descriptions> of a reply; null when it holds no readable JSON object."""
    text = reply_object(reply)
    parsed = F.from_json(text, _REPLY)
    # Unreadable text parses to nulls only; a map of raw values tells it from an empty object.
    readable = F.from_json(text, "map<string,string>", {"mode": "PERMISSIVE"}).isNotNull()
    default = F.array(*[F.lit(line) for line in C.REPLY_DESCRIPTIONS])
    return F.when(readable, F.struct(
        F.coalesce(parsed["dialogue"], F.lit(C.REPLY_DIALOGUE)).alias("dialogue"),
        F.coalesce(parsed["bargain_descriptions"], default).alias("descriptions"),
    ))


def comment_prompt(personality: Column, key: Column, value: Column) -> Column:
    lines = [F.lit(line) for line in C.COMMENT_LINES]
    lines[0] = fill(lines[0], personality=personality)
    # One pass per placeholder of the last line: a key text may itself hold braces.
    head, tail = C.COMMENT_LINES[-1].split("{key}")
    middle, end = tail.split("{value}")
    lines[-1] = F.concat(F.lit(head), key, F.lit(middle), value, F.lit(end))
    return F.concat_ws("\n", *lines)


def clean_reply(reply: Column) -> Column:
    """Reply without outer blanks and double quotes; a fixed line when there is none."""
    trimmed = F.regexp_replace(reply, r"^\s+|\s+$", "")
    return F.coalesce(F.replace(trimmed, F.lit('"'), F.lit("")), F.lit(C.COMMENT_FALLBACK))
