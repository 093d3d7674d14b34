"""Shell commands: segments and words, with quotes, escapes and substitutions kept whole."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _after_quote(text: str, at: int) -> int:
    """The place after the quoted run that begins at `at`; the end of the text where it isn't closed."""
    quote, k = text[at], at + 1
    while k < len(text):
        if quote == "\"" and text[k] == "\\":
            k += 2
        elif quote == "'" and text.startswith("'\\''", k):
            k += 4
        elif text[k] == quote:
            return k + 1
        else:
            k += 1
    return len(text)


def _after_substitution(text: str, at: int) -> int:
    """The place after the $( ) that begins at `at`, with what is nested in it."""
    depth, k = 0, at + 1
    while k < len(text):
        if text[k] in "'\"":
            k = _after_quote(text, k)
            continue
        depth += {"(": 1, ")": -1}.get(text[k], 0)
        k += 1
        if not depth:
            return k
    return len(text)


def _parts(command: str) -> list[str]:
    """The command cut at |, ;, && and || outside of quotes and substitutions."""
    out, begin, k = [], 0, 0
    while k < len(command):
        if command[k] in "'\"":
            k = _after_quote(command, k)
        elif command.startswith("$(", k):
            k = _after_substitution(command, k)
        elif cut := next((s for s in ("&&", "||", "|", ";") if command.startswith(s, k)), None):
            out.append(command[begin:k])
            k += len(cut)
            begin = k
        else:
            k += 1
    return [p.strip() for p in [*out, command[begin:]] if p.strip()]


def words(part: str) -> list[str]:
    """The words of a segment: quotes taken off, escapes resolved, a substitution a word of its own."""
    out, word, k = [], "", 0

    def close() -> None:
        nonlocal word
        if word:
            out.append(word)
        word = ""

    fresh = True
    while k < len(part):
        c = part[k]
        if c.isspace():
            close()
            fresh = True
            k += 1
            continue
        if fresh and c in "'\"":
            end = _after_quote(part, k)
            inner = part[k + 1 : end - 1]
            out.append(inner.replace("'\\''", "'") if c == "'" else "".join(_unescaped(inner)))
            k = end
            continue
        fresh = False
        if part.startswith("$(", k):
            close()
            end = _after_substitution(part, k)
            out.append(part[k:end])
            k = end
            continue
        if c == "\\" and k + 1 < len(part):
            k += 1
        word += part[k]
        k += 1
    close()
    return out


def _unescaped(text: str):
    rest = iter(text)
    for c in rest:
        yield next(rest, c) if c == "\\" else c


def segments(command: str | None) -> list[list[str]]:
    """The words of each segment of a command; none of null."""
    return [words(p) for p in _parts(command or "")]


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def segments_of(commands: pd.Series) -> pd.Series:
    return commands.map(segments)


def commits(command: Column) -> Column:
    """Whether a segment is a git commit that doesn't ask to skip checks."""
    return F.exists(segments_of(command), lambda s: (F.get(s, F.lit(0)) == "git") & (F.get(s, F.lit(1)) == "commit") & ~F.array_contains(s, "--no-verify") & ~F.array_contains(s, "-n"))
