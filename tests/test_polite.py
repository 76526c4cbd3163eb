import random

from auditloom.sources.polite import polite


class Clock:
    def __init__(self):
        self.now = 0.0

    def __call__(self):
        return self.now

    def sleep(self, seconds):
        assert seconds > 0
        self.now += seconds


def asked(items, delay, ahead=10_000, answer=0.1):
    """(time, url, end) of each request, each of which takes a while."""
    clock, out = Clock(), []
    for url in polite(items, delay, clock, clock.sleep, ahead):
        began = clock.now
        clock.now += answer
        out.append((began, url, clock.now))
    return out, clock.now


def test_hosts_of_one_task_overlap_their_delays():
    _, alone = asked([("a", f"a{k}") for k in range(10)], 1.0)
    _, both = asked([(h, f"{h}{k}") for k in range(10) for h in "ab"], 1.0)
    _, many = asked([(h, f"{h}{k}") for h in "abcdefghij" for k in range(10)], 1.0)
    assert abs(alone - 10) < 1e-6 and both < alone + 1 and many < 10 * 10 * 0.1 + 3


def test_no_host_is_asked_sooner_than_its_delay():
    for seed in range(30):
        r = random.Random(seed)
        items = [(h := r.choice("abcdef" if seed % 2 else "ab"), f"{h}/{k}") for k in range(r.randint(0, 120))]
        out, _ = asked(items, 1.0, ahead=r.choice((1, 5, 10_000)), answer=r.choice((0.0, 0.3, 2.0)))
        assert sorted(u for _, u, _ in out) == sorted(u for _, u in items)
        for host in "abcdef":
            own = [x for x in out if x[1][0] == host]
            assert [x[1] for x in own] == [u for h, u in items if h == host]
            assert all(b[0] >= a[2] + 1.0 - 1e-9 for a, b in zip(own, own[1:]))


def test_reads_ahead_no_more_than_it_may():
    read = []

    def items():
        for k in range(1000):
            read.append(k)
            yield "one", f"u{k}"

    clock = Clock()
    for n, _ in enumerate(polite(items(), 1.0, clock, clock.sleep, ahead=50)):
        assert len(read) <= n + 51
