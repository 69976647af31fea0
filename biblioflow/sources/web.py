"""Calls out to the web from executors: attempts, waiting, rate limit and headers. The transport is injected."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from email.utils import parsedate_to_datetime

#: Attempts of a call, and the longest wait between two that no server asked for, in seconds (fixed values).
ATTEMPTS, LONGEST_WAIT = 3, 4.0


@dataclass(frozen=True)
class Reply:
    status: int
    headers: dict[str, str] = field(default_factory=dict)
    body: str = ""


class CallFailed(OSError):
    """A reply of status 400 or more after the last attempt."""

    def __init__(self, url: str, status: int):
        super().__init__(f"status {status} of {url}")
        self.status = status


def wait_before(attempt: int, headers: dict[str, str], now: float, reset_header: str | None = None) -> float:
    """Seconds to wait after attempt number ``attempt`` (from 1): what the server asks for, else a doubling wait.

    ``Retry-After`` is a number of seconds or a date; ``reset_header`` names one more header of either kind.
    """
    low = {k.lower(): v for k, v in headers.items()}
    for name in filter(None, ("retry-after", reset_header and reset_header.lower())):
        value = low.get(name, "").strip()
        if value.isdigit():
            return float(value)
        try:
            return max(0.0, parsedate_to_datetime(value).timestamp() - now)
        except (TypeError, ValueError):
            continue
    return min(LONGEST_WAIT, 2.0 ** (attempt - 1))


def polite_headers(user_agent: str, email: str | None = None) -> dict[str, str]:
    """The user agent with ``{email}`` filled in, or with a mail address added for the polite pool."""
    if "{email}" in user_agent:
        return {"User-Agent": user_agent.replace("{email}", email or "")}
    return {"User-Agent": f"{user_agent} (mailto:{email})" if email else user_agent}


@dataclass
class WebClient:
    """``client(url)`` gives the body of a page. One client serves one task; ``per_second`` is a task's share of the allowed rate.

    Statuses 429 and 500 or more and transport errors are tried again, other statuses of 400 or more are not.
    Redirects are the transport's work.
    """

    transport: Callable[[str, dict[str, str]], Reply]
    headers: dict[str, str] = field(default_factory=dict)
    per_second: float | None = None
    attempts: int = ATTEMPTS
    reset_header: str | None = None
    sleep: Callable[[float], None] = time.sleep
    clock: Callable[[], float] = time.time
    _last: float = field(default=float("-inf"), repr=False)

    def _in_turn(self) -> None:
        if self.per_second:
            left = self._last + 1 / self.per_second - self.clock()
            if left > 0:
                self.sleep(left)
            self._last = self.clock()

    def __call__(self, url: str) -> str:
        for attempt in range(1, self.attempts + 1):
            self._in_turn()
            last = attempt == self.attempts
            try:
                reply = self.transport(url, self.headers)
            except OSError:
                if last:
                    raise
                self.sleep(wait_before(attempt, {}, self.clock()))
                continue
            if reply.status < 400:
                return reply.body
            if last or (reply.status != 429 and reply.status < 500):
                raise CallFailed(url, reply.status)
            self.sleep(wait_before(attempt, reply.headers, self.clock(), self.reset_header))
        raise ValueError("attempts must be at least 1")


def urllib_transport(timeout: float = 30.0) -> Callable[[str, dict[str, str]], Reply]:
    """A transport of the standard library; follows redirects."""

    def send(url: str, headers: dict[str, str]) -> Reply:
        from urllib.error import HTTPError
        from urllib.request import Request, urlopen

        try:
            with urlopen(Request(url, headers=headers), timeout=timeout) as reply:
                return Reply(reply.status, dict(reply.headers), reply.read().decode(reply.headers.get_content_charset() or "utf-8", "replace"))
        except HTTPError as e:
            return Reply(e.code, dict(e.headers or {}))

    return send
