"""Reading JSON objects out of model answers: natively, then with repairs."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Repairs tried on one answer at most.
MOST = 20


def outer_object(answer: Column) -> Column:
    """The answer without thinking blocks and code fences, from the first brace to the last."""
    s = F.regexp_replace(answer, r"(?s)<think>.*?</think>", "")
    s = F.regexp_replace(s, r"(?m)^\s*```(?:json)?\s*$", "")
    return F.regexp_extract(s, r"(?s)(\{.*\})", 1)


def _closers(text: str) -> str:
    """What is missing at the end to close strings and brackets."""
    stack, quoted, escaped = [], False, False
    for c in text:
        if quoted:
            quoted = escaped or c != '"'
            escaped = c == "\\" and not escaped
        elif c == '"':
            quoted = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c in "}]" and stack and stack[-1] == c:
            stack.pop()
    return ('"' if quoted else "") + "".join(reversed(stack))


def repaired(text: str | None) -> str | None:
    """``text`` as a JSON object, mended where the parser stumbles; null if it stays broken."""
    if not text:
        return None
    for _ in range(MOST):
        try:
            value = json.loads(text)
            return json.dumps(value, ensure_ascii=False) if isinstance(value, dict) else None
        except json.JSONDecodeError as e:
            at, what = e.pos, e.msg
        if at >= len(text.rstrip()) or what.startswith("Unterminated"):
            text = text.rstrip().rstrip(",:") + _closers(text.rstrip().rstrip(",:"))
        elif what.startswith("Expecting ',' delimiter"):
            before = text[:at].rstrip()
            if before.endswith('"') and not text[at] in '"{[':
                cut = len(before) - 1  # a quote inside a string
                text = text[:cut] + '\\"' + text[cut + 1 :]
            elif text[at] in "}]":
                want = _closers(text[:at])[:1]
                text = text[:at] + (want or "") + text[at + 1 :]
            else:
                text = text[:at] + "," + text[at:]
        elif what.startswith("Expecting value") or what.startswith("Expecting property name"):
            bare = re.match(r"[^\s,:{}\[\]\"]+", text[at:])
            if bare:
                text = text[:at] + json.dumps(bare[0]) + text[at + bare.end() :]
            elif text[at] in ",}]":
                text = text[:at].rstrip().removesuffix(",") + text[at + (text[at] == ",") :] if text[:at].rstrip().endswith((",", "{", "[")) else text[:at] + "null" + text[at:]
            else:
                return None
        else:
            return None
    return None


def parse_answer(answer: Column, schema: str) -> Column:
    """The fields of an answer; only answers the JVM cannot read go through the repair."""
    found = outer_object(answer)

    @F.pandas_udf("string")
    def mend(texts: pd.Series) -> pd.Series:
        return texts.map(repaired, na_action="ignore")

    sound = F.try_parse_json(found).isNotNull()
    text = F.when(sound, found).otherwise(mend(F.when(~F.coalesce(sound, F.lit(False)), found)))
    return F.from_json(text, schema)
