"""Decisions about calls to services: which errors may be tried again, which voice reads a language."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Errors that are time-outs, status codes, and words of errors that pass.
TIMEOUTS = ["TimeoutError", "GeminiTimeoutError", "TimeoutException", "ConnectTimeout", "ReadTimeout", "WriteTimeout", "PoolTimeout"]
AGAIN_CODES, FINAL_CODES = [429, 499, 503, 504], [400, 401, 403, 404, 422]
AGAIN_WORDS = ["429", "499", "503", "504", "resource exhausted", "unavailable", "deadline", "gateway timeout", "timed out", "timeout", "cancelled"]
# Languages with a voice of India first, and the order of English voices.
INDIAN = ["ta", "hi", "te", "ml", "kn", "mr", "bn", "or"]
ENGLISH = ["en-in", "en-gb", "en-us", "en"]


def may_repeat(code: Column, kind: Column, message: Column) -> Column:
    """Whether an error of a service may be tried again: by its kind, else its code, else words in kind or message."""
    words = F.lower(F.concat_ws("\n", kind, message))
    spoken = F.lit(False)
    for word in AGAIN_WORDS:
        spoken = spoken | F.contains(words, F.lit(word))
    return F.when(kind.isin(TIMEOUTS), True).when(code.isin(AGAIN_CODES), True).when(code.isin(FINAL_CODES), False).otherwise(spoken)


def may_read_again(status: Column, attempt: Column) -> Column:
    """Whether a client repeats a read: once, after a dropped connection or a short gateway failure."""
    return F.coalesce((attempt == 0) & status.isin(0, 502, 503), F.lit(False))


def _code(x: Column) -> Column:
    return F.when(x.isNotNull(), F.concat_ws("-", F.split(F.lower(x), "_", 2)))


def best_voice(voices: Column, lang: Column) -> Column:
    """Of voices (structs with a field lang) the first of the language's preferred code, else of its first two letters; else null."""
    wanted = _code(lang)
    codes = F.when(wanted.isin(INDIAN), F.array(F.concat(wanted, F.lit("-in")), wanted)).when(wanted == "en", F.array(*map(F.lit, ENGLISH))).otherwise(F.array(wanted))
    exact = F.flatten(F.transform(codes, lambda c: F.filter(voices, lambda v: _code(v["lang"]) == c)))
    near = F.filter(voices, lambda v: F.startswith(_code(v["lang"]), F.left(wanted, F.lit(2))))
    return F.coalesce(F.get(exact, 0), F.get(near, 0))
