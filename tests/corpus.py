"""Random texts of every kind, with fixed seed."""

import random

INTENTS = [None, "debug:test-failure", "commit:generate", "refactor:x"]


def _log(r, n):
    kinds = ["GET /api/v1/items/{a} 200", "ERROR timeout after {a} ms at 10.0.{b}.1:443", "worker {b} idle",
             "2024-01-02T03:04:0{c}Z sync 0xdeadbeef{a}", "Retrying", "job aaaaaaaa-bbbb-cccc-dddd-eeeeeeee{d} ok"]
    pick = r.sample(kinds, r.randint(1, len(kinds)))
    return [r.choice(pick).format(a=r.randint(10, 99999), b=r.randint(0, 255), c=r.randint(0, 9),
                                  d=r.randint(1000, 9999)) for _ in range(n)]


def _table(r, n):
    states = [f"S{i}" for i in range(r.randint(1, 12))]
    rows = [f"{'é' if r.random() < .1 else 'r'}{i:<9}   {r.choice('abc') * 4:<10}{r.choice(states)}" for i in range(n)]
    return ["ID          NAME      STATE", *rows]


def _tree(r, n):
    marks = ["", "  ", "    ", "      ", "        ", "├── ", "│   ├── ", "\t", "\t\t", "  └─ "]
    return [r.choice(marks) + f"node{i}" for i in range(n)]


def _prose(r, n):
    words = "the log ran and then  stopped +x -y @@ diff ─ naïve 日本 error: at".split(" ")
    return [" ".join(r.choices(words, k=r.randint(0, 9))) + r.choice(["", "", " ", "\t", " \u3000"])
            if r.random() < .8 else r.choice(["", "  "]) for _ in range(n)]


def texts(count=240, seed=5):
    r = random.Random(seed)
    out = []
    for i in range(count):
        lines = r.choice([_log, _table, _tree, _prose])(r, r.choice([2, 5, 8, 13, 30, 90]))
        end = r.choice(["\n", "\r\n"])
        out.append((i, end.join(lines) + r.choice(["", end]), r.choice(INTENTS)))
    return out
