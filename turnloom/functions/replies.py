"""Model replies: the JSON in them, read as far as it goes where it breaks off, and the values they may have."""

from __future__ import annotations

import json
from json.decoder import scanstring

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BLANK = " \t\n\r"


def loaded(text: str):
    try:
        return json.loads(text)
    except ValueError:
        return None


class Unreadable(ValueError):
    """Not JSON, nor the beginning of any."""


class Reader:
    """Reads a JSON value from a text that may end before it does: what is open at the end counts as closed there."""

    def __init__(self, text: str, at: int):
        self.text, self.at = text, at

    def peek(self) -> str:
        """The next character that isn't blank; empty at the end."""
        while self.at < len(self.text) and self.text[self.at] in _BLANK:
            self.at += 1
        return self.text[self.at : self.at + 1]

    def string(self) -> str:
        try:
            value, self.at = scanstring(self.text, self.at + 1)
        except ValueError:
            try:
                value, _ = scanstring(self.text + '"', self.at + 1)
            except ValueError:
                raise Unreadable from None
            self.at = len(self.text)
        return value

    def items(self, close: str, one):
        """The items up to a closing bracket or the end, each read by one."""
        self.at += 1
        out = []
        while (c := self.peek()) and c != close:
            out.append(one())
            if self.peek() not in ("", ",", close):
                raise Unreadable
            if self.peek() == ",":
                self.at += 1
                if self.peek() == close:
                    raise Unreadable
        self.at += bool(c)
        return out

    def pair(self) -> tuple[str, object]:
        if self.peek() != '"':
            raise Unreadable
        key = self.string()
        if self.peek() != ":":
            raise Unreadable
        self.at += 1
        return key, self.value() if self.peek() else None

    def value(self):
        c = self.peek()
        if c == "{":
            return dict(self.items("}", self.pair))
        if c == "[":
            return self.items("]", self.value)
        if c == '"':
            return self.string()
        try:
            value, self.at = json.JSONDecoder().raw_decode(self.text, self.at)
        except ValueError:
            raise Unreadable from None
        return value


def mended(text: str):
    """The JSON that starts at the first brace of a text that breaks off; None if it isn't JSON up to there, or something follows it."""
    if (at := text.find("{")) < 0:
        return None
    reader = Reader(text, at)
    try:
        value = reader.value()
    except (Unreadable, RecursionError):
        return None
    return None if reader.peek() else value


def without_fences(text: str) -> str:
    """The text without what marks a block of code at the beginning or end of its lines."""
    lines = [line.removeprefix("```json").removeprefix("```") if line.startswith("```") else line for line in text.strip().split("\n")]
    return "\n".join(line.rstrip().removesuffix("```") if line.rstrip().endswith("```") else line for line in lines).strip()


def reply_json(text: str | None) -> str | None:
    """The JSON of a reply as text: the whole reply without fences, what its outer braces hold, or what there is of one that breaks off."""
    bare = without_fences(text or "")
    first, last = bare.find("{"), bare.rfind("}")
    inside = bare[first : last + 1] if 0 <= first < last else ""
    for read in (lambda: loaded(bare), lambda: loaded(inside), lambda: mended(bare)):
        if (found := read()) is not None:
            return json.dumps(found, ensure_ascii=False)
    return None


@F.pandas_udf(T.StringType())
def extract_json(replies: pd.Series) -> pd.Series:
    return replies.map(reply_json)


def evaluation(replies: DataFrame, column: str, compact: bool = False) -> DataFrame:
    """replies with axes (verbal, vocal, visual as maps), critique and key_observations as an evaluation may have them."""
    text = extract_json(F.col(column))
    axis = lambda name: F.coalesce(F.from_json(F.get_json_object("_json", f"$.{name}"), "map<string,string>"), F.create_map().cast("map<string,string>"))
    items = lambda name, most: F.slice(F.coalesce(F.from_json(F.get_json_object("_json", f"$.{name}"), "array<string>"), F.array().cast("array<string>")), 1, most)
    summary = F.nullif(F.get_json_object("_json", "$.summary"), F.lit(""))
    told = F.filter(F.array(summary), lambda s: s.isNotNull()) if compact else items("key_observations", 8)
    columns = {name: axis(name) for name in ("verbal", "vocal", "visual")} | {"critique": items("critique", 2 if compact else 5), "key_observations": told}
    return replies.withColumn("_json", text).withColumns(columns).drop("_json")


def grounding(vision: Column, prosody: Column) -> Column:
    """What a prompt says of measures: their lines and the rule to keep to them; empty without any."""
    lines = F.array_join(F.filter(F.array(vision, prosody), lambda x: x.isNotNull() & (x != "")), "\n")
    return F.when(lines == "", "").otherwise(F.concat(F.lit("[measured]\n"), lines, F.lit("\nKeep to what is measured.")))
