"""Which failures are worth another attempt, and how long to wait for it; for model calls and web sources alike."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from typing import Any, NamedTuple

# Status codes that are worth another attempt, and words of errors that are never, or are, worth one.
AGAIN_STATUS = (408, 409, 425, 429, 500, 502, 503, 504, 529)
NEVER_WORDS = ("invalid_api_key", "invalid api key", "authenticationerror", "authentication_error", "permissiondenied", "insufficient_quota", "context_length_exceeded", "contextlength", "content_filter", "contentfilter", "invalid_request_error", "badrequest", "notfounderror", "model_not_found", "unsupported")
AGAIN_WORDS = ("timeout", "timed out", "connection", "rate limit", "ratelimit", "overloaded", "temporarily unavailable", "server error", "service unavailable", "bad gateway", "try again")


class TransientError(RuntimeError):
    """A failure that another attempt may mend."""


class Rule(NamedTuple):
    """A fact of an error, the values that it must have (none: any), and what follows."""

    fact: str
    values: tuple
    again: bool


#: The first rule that fits decides; if none does, there is no other attempt.
RULES = (
    Rule("mendable", (True,), True),
    Rule("status", AGAIN_STATUS, True),
    Rule("status", (), False),
    Rule("words", NEVER_WORDS, False),
    Rule("words", AGAIN_WORDS, True),
)


def facts(error: BaseException) -> dict[str, Any]:
    """What rules look at: whether the error says it can be mended, its status code if it has one, its type and message."""
    found = {"mendable": isinstance(error, TransientError), "words": f"{type(error).__name__} {error}".lower()}
    status = [v for v in map(vars(error).get, ("status_code", "status", "http_status")) if type(v) is int]
    return found | ({"status": status[0]} if status else {})


def worth_another(error: BaseException) -> bool:
    known = facts(error)
    for rule in RULES:
        if rule.fact in known:
            value = known[rule.fact]
            if not rule.values or (any(w in value for w in rule.values) if rule.fact == "words" else value in rule.values):
                return rule.again
    return False


def waits(first_s: float, most_s: float, spread: float = 0.25) -> Iterator[float]:
    """Seconds before each further attempt: twice as long every time, up to a bound, and somewhat at random."""
    wait = first_s
    while True:
        yield min(wait, most_s) * random.uniform(1 - spread, 1 + spread)  # noqa: S311
        wait *= 2


def attempted(call: Callable[[], Any], attempts: int = 3, first_s: float = 0.5, most_s: float = 20.0, sleep: Callable[[float], None] = time.sleep) -> Any:
    """What `call` returns, at last; raises its last failure, or the first that another attempt can't mend."""
    for left, wait in zip(range(attempts - 1, -1, -1), waits(first_s, most_s), strict=False):
        try:
            return call()
        except Exception as error:
            if not left or not worth_another(error):
                raise
        sleep(wait)
    raise ValueError("attempts must be 1 or more")
