"""Small state machines of the request guards, one step per request in time order."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field

from . import fixed

MICROS = 1_000_000


@dataclass
class SlidingLog:
    """Admits a request while fewer than ``limit`` admitted ones lie in the window before it."""

    limit: int = fixed.RATE_LIMIT_REQUESTS
    window: int = fixed.RATE_LIMIT_WINDOW_SECONDS
    log: deque = field(default_factory=deque)

    def expire(self, now: int) -> None:
        span = self.window * MICROS
        while self.log and now - self.log[0] >= span:
            self.log.popleft()

    def admit(self, now: int) -> tuple[bool, int, int]:
        """(allowed, remaining, seconds until the oldest entry leaves)."""
        self.expire(now)
        reset = self.window
        if self.log:
            reset = (self.window * MICROS - (now - self.log[0])) // MICROS
        if len(self.log) >= self.limit:
            return False, 0, reset
        self.log.append(now)
        return True, self.limit - len(self.log), reset


CLOSED, OPEN, HALF_OPEN = "closed", "open", "half_open"


@dataclass
class Breaker:
    """Opens after repeated failures, probes after a pause, closes after successes."""

    state: str = CLOSED
    failures: int = 0
    successes: int = 0
    last_failure: int = 0

    def allows(self, now: int) -> bool:
        if self.state == OPEN:
            if now - self.last_failure < fixed.CIRCUIT_RESET_SECONDS * MICROS:
                return False
            self.state, self.successes = HALF_OPEN, 0
        return True

    def record(self, now: int, ok: bool) -> None:
        if ok and self.state == HALF_OPEN:
            self.successes += 1
            if self.successes >= fixed.CIRCUIT_SUCCESSES:
                self.state, self.failures = CLOSED, 0
        elif ok:
            self.failures = max(0, self.failures - 1)
        else:
            self.failures += 1
            self.last_failure = now
            if self.state == HALF_OPEN or self.failures >= fixed.CIRCUIT_FAILURES:
                self.state = OPEN

    def step(self, now: int, ok: bool) -> bool:
        allowed = self.allows(now)
        if allowed:
            self.record(now, ok)
        return allowed


@dataclass
class AbuseGuard:
    """Rate limit with a block after too many refusals; a filled honeypot weighs ten."""

    log: SlidingLog = field(default_factory=SlidingLog)
    threshold: int = fixed.ABUSE_THRESHOLD
    block_seconds: int = fixed.ABUSE_BLOCK_SECONDS
    refusals: int = 0
    blocked_until: int = 0

    def step(self, now: int, bot: bool) -> str:
        if now < self.blocked_until:
            return "blocked"
        allowed, _, _ = self.log.admit(now)
        if not allowed:
            self.refusals += 1
            if self.refusals >= self.threshold:
                self.blocked_until = now + self.block_seconds * MICROS
            return "rate_limited"
        if bot:
            self.refusals += fixed.HONEYPOT_PENALTY
            return "bot"
        return "ok"
