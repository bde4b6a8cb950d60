"""JSON texts without secrets: one pass over a text's tokens, which writes what may be shown and mutes the rest.

No document is built, so depth and size cost no stack, and a text that is no JSON is recognised on the way.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Parts of keys whose values are never shown, and limits of what is.
SENSITIVE = ("authorization", "access_key", "accesskey", "api-key", "api_key", "apikey", "credential", "key_sha256", "password", "private_key", "privatekey", "rtsp", "secret", "token")
MOST_DEPTH, MOST_ITEMS, MOST_CHARACTERS = 8, 1000, 4096
# What is shown instead.
REDACTED, TRUNCATED, NON_FINITE, UNSUPPORTED = "[REDACTED]", "[TRUNCATED]", "[NON_FINITE]", "[UNSUPPORTED]"

_TOKEN = re.compile(r'[ \t\r\n]*(?:(?P<mark>[][{},:])|(?P<text>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9A-Fa-f]{4}))*")|(?P<number>-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)|(?P<word>true|false|null|NaN|-?Infinity))')
_HIDDEN_KEY = re.compile("|".join(map(re.escape, SENSITIVE)))
_HIDDEN_TEXT = re.compile(r"bearer |rtsps?://|https?://[^/?#]*@", re.I)
_ADDRESS = re.compile(r"(https?)(://[^?#]*)", re.I)


def _quoted(text: str) -> str:
    try:
        text.encode()
    except UnicodeEncodeError:  # half a surrogate pair stays escaped
        return json.dumps(text)
    return json.dumps(text, ensure_ascii=False)


def _shown(kind: str, token: str) -> str:
    """What stands for a value that is no object or list."""
    if kind == "text":
        text = json.loads(token)
        if _HIDDEN_TEXT.match(text):
            return f'"{REDACTED}"'
        if address := _ADDRESS.match(text):
            text = address[1].lower() + address[2]
        return _quoted(text[:MOST_CHARACTERS])
    finite = token in ("true", "false", "null") if kind == "word" else abs(float(token)) != float("inf")
    return token if finite else f'"{NON_FINITE}"'


def redacted(text: str) -> str:
    """A JSON text as the audit log shows it. Keys and numbers stay as written, white space between tokens goes."""
    out: list[str] = []
    open_: list[str] = []  # closing marks of what is open, and how many members each has
    members: list[int] = []
    muted = -1  # nothing is written until so many are open; -1: all is
    muted_mark = ""  # written then
    hide = False  # the next value belongs to a sensitive key
    wants, at, end = "value", 0, len(text)
    while True:
        token = _TOKEN.match(text, at)
        if token is None:
            return "".join(out) if wants == "end" and not text[at:].strip(" \t\r\n") else f'"{UNSUPPORTED}"'
        at, kind, found = token.end(), token.lastgroup, token[token.lastgroup]
        if at > end or wants == "end":
            return f'"{UNSUPPORTED}"'
        if found in "]}" and wants in ("next", f"first{found}") and open_[-1] == found:
            open_.pop()
            members.pop()
            if muted < 0:
                out.append(found)
            elif len(open_) == muted:
                out.append(muted_mark)
                muted = -1
            wants = "next" if open_ else "end"
        elif found == "," and wants == "next":
            wants = "key" if open_[-1] == "}" else "value"
        elif found == ":" and wants == "colon":
            wants = "value"
        elif kind == "text" and wants in ("key", "first}"):
            members[-1] += 1
            if muted < 0:
                comma = "," if members[-1] > 1 else ""
                if members[-1] > MOST_ITEMS:
                    out.append(f'{comma}"_truncated":true')
                    muted, muted_mark = len(open_) - 1, "}"
                else:
                    out.append(f"{comma}{found}:")
                    hide = bool(_HIDDEN_KEY.search(json.loads(found).casefold()))
            wants = "colon"
        elif wants in ("value", "first]") and (kind != "mark" or found in "[{"):
            in_list = bool(open_) and open_[-1] == "]"
            members[-1:] = [members[-1] + in_list] if members else []
            if muted < 0 and in_list:
                out.append("," if members[-1] > 1 else "")
                if members[-1] > MOST_ITEMS:
                    out.append(f'"{TRUNCATED}"')
                    muted, muted_mark = len(open_) - 1, "]"
            if muted < 0:
                instead = f'"{REDACTED}"' if hide else f'"{TRUNCATED}"' if len(open_) > MOST_DEPTH else None
                hide = False
                out.append(instead or (found if kind == "mark" else _shown(kind, found)))
                if instead and kind == "mark":
                    muted, muted_mark = len(open_), ""
            if kind == "mark":
                open_.append("]" if found == "[" else "}")
                members.append(0)
                wants = f"first{open_[-1]}"
            else:
                wants = "next" if open_ else "end"
        else:
            return f'"{UNSUPPORTED}"'


def redact(document: Column) -> Column:
    """JSON documents without secrets, credentials and query strings, and cut to the audit log's limits; null stays null.

    A text that is no JSON becomes the JSON text "[UNSUPPORTED]", so no row stops a job.
    """

    @F.arrow_udf("string")
    def clean(documents: pa.Array) -> pa.Array:
        return pa.array((redacted(d.as_py()) if d.is_valid else None for d in documents), pa.string())  # one text at a time

    return clean(document)
