"""GET with retries, and what sources know about the offsets of pages and answers."""

from __future__ import annotations

import http.client
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Mapping

AGENT = "Mozilla/5.0 (compatible; loomwright)"
_LAST: dict[str, float] = {}


def get(url: str, options: Mapping[str, str]) -> tuple[bytes, str] | None:
    """Body and charset; None where the server says no (4xx but 429), or where no attempt brought a whole answer.

    options: timeout (15 s), attempts (3), wait (0.5 s, doubled each time), pause (0 s between requests of a worker to a host).
    """
    host, pause, wait = url.split("/", 3)[2] if "://" in url else "", float(options.get("pause", "0")), float(options.get("wait", "0.5"))
    request = urllib.request.Request(url, headers={"User-Agent": options.get("user_agent", AGENT)})
    for k in range(max(1, int(options.get("attempts", "3")))):
        time.sleep(max(wait * 2 ** (k - 1) if k else 0.0, _LAST.get(host, 0.0) + pause - time.monotonic() if pause else 0.0))
        _LAST[host] = time.monotonic()
        try:
            with urllib.request.urlopen(request, timeout=float(options.get("timeout", "15"))) as answer:
                return answer.read(), answer.headers.get_content_charset() or "utf-8"
        except urllib.error.HTTPError as problem:
            if problem.code < 500 and problem.code != 429:
                return None
        except (OSError, http.client.HTTPException):
            pass
    return None


def last_there(there: Callable[[int], bool], known: int, most: int) -> int:
    """The largest k up to most of which all before are there, from one that is known to be: by doubling, then halving."""
    step, lo = 1, known
    while lo + step <= most and there(lo + step):
        lo, step = lo + step, 2 * step
    hi = min(lo + step, most + 1)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if there(mid) else (lo, mid)
    return lo
