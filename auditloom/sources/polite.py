"""One task's requests to many hosts, none asked sooner than its delay after its last answer."""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Callable, Iterable, Iterator


def polite(items: Iterable[tuple[str, str]], delay: float, clock: Callable[[], float], sleep: Callable[[float], None], ahead: int = 10_000) -> Iterator[str]:
    """The items (host, url), as urls, in an order in which waits for one host are spent on others.

    A host waits in a heap for its next allowed time, ``delay`` seconds after the consumer came back for more; a host's own urls stay
    in order. At most ``ahead`` urls are read before they are due, so a partition of any size takes bounded memory.
    """
    source, queues, due, held, more = iter(items), {}, [], 0, True
    free: dict[str, float] = {}  # when hosts that have no url waiting may be asked again
    while True:
        while more and held < ahead and (not due or due[0][0] > clock()):
            try:
                host, url = next(source)
            except StopIteration:
                more = False
                break
            if host in queues:
                queues[host].append(url)
            else:
                queues[host] = deque([url])
                heapq.heappush(due, (free.pop(host, float("-inf")), host))
            held += 1
        if not due:
            return
        at, host = heapq.heappop(due)
        if at > clock():
            sleep(at - clock())
        held -= 1
        yield queues[host].popleft()
        now = clock()
        if queues[host]:
            heapq.heappush(due, (now + delay, host))
        else:
            del queues[host]
            free[host] = now + delay
            if len(free) > ahead:
                free = {h: t for h, t in free.items() if t > now}
