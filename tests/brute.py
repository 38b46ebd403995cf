"""Plain-Python answers for small inputs, stated as definitions over whole lists."""

import re
from collections import Counter

from brevilog.functions.fingerprint import TOKEN_SHAPES
from brevilog.operators.intents import FAILURE_MARKS

NAMES = ["<ISO8601>", "<UUID>", "<IP>", "<HEX>", "<PATH>", "<PATH>", "<NUM>"]
SHAPES = re.compile("|".join(f"({s})" for s in TOKEN_SHAPES))


def lines_of(text):
    parts = text.split("\n")
    return [p.removesuffix("\r") for p in (parts[:-1] if parts[-1] == "" else parts)]


def fingerprint(line):
    return SHAPES.sub(lambda m: NAMES[m.lastindex - 1], line)


def signature(line):
    raw = line.encode()
    return tuple(m.start() // 4 for m in re.finditer(rb" {2,}", raw) if m.start() > 0)


def scores(lines):
    sample = lines[:20]
    n = len(sample)
    rows = [l for l in sample if len(l.encode()) >= 8]
    shared = Counter(filter(None, map(signature, rows)))
    tab = max(shared.values(), default=0) / len(rows) if len(rows) >= 3 else 0.0
    tree = sum(l.startswith(("  ", "\t", "├", "└", "│")) for l in sample) / n if n else 0.0
    dup = 1.0 - len({fingerprint(l) for l in sample}) / n if n else 0.0
    lin = (0.35 + 0.65 * dup) * (min(n, 20) / 20) if n >= 4 else 0.0
    return tab, tree, lin


def archetype(lines):
    tab, tree, lin = scores(lines)
    best = max(tab, tree, lin)
    if not lines or best < 0.55:
        return "passthrough"
    return "linear-log" if lin == best else "tree" if tree == best else "tabular"


def table(lines):
    if len(lines) <= 7:
        return lines, False
    counts = Counter(l.split()[-1] for l in lines[4:-3] if l.split())
    note = ", ".join(f"{c} {t}" for t, c in sorted(counts.items(), key=lambda x: (-x[1], x[0])))
    tail = f": {note}" if 1 <= len(counts) <= 8 else ""
    return [*lines[:4], f"... [{len(lines) - 7} rows folded{tail}] ...", *lines[-3:]], True


def log(lines):
    if len(lines) <= 5:
        return lines, False
    head = lines[:-5]
    prints = [fingerprint(l) for l in head]
    counts = Counter(prints)
    firsts = [i for i, f in enumerate(prints) if f not in prints[:i]]
    shown = [head[i] + (f"  × {counts[prints[i]]}" if counts[prints[i]] > 1 else "") for i in firsts]
    return [*shown, "--- last 5 lines ---", *lines[-5:]], True


def depth(line):
    prefix = re.match(r"[ \t│├└─]*", line).group()
    return sum(1 if c in " ─" else 4 for c in prefix) // 2


def tree(lines):
    ds = [depth(l) for l in lines]
    visible = [i for i, d in enumerate(ds) if d <= 2]
    closing = [b for a, b in zip(visible, visible[1:]) if ds[a] == 2]
    out, seen = [], 0
    for i in visible:
        if i in closing:
            pending = ds[:i].count(3) - seen
            seen += pending
            out += [f"      ... [{pending} more]"] if pending else []
        out.append(lines[i])
    left = Counter(d for d in ds if d > 2)
    left[3] -= seen
    return out + ["  " * (d - 1) + f"... [{left[d]} more at depth {d}]" for d in sorted(left) if left[d] > 0], True


def prose(lines):
    cut = [l.rstrip() for l in lines]
    return [l for i, l in enumerate(cut) if l or i == 0 or cut[i - 1]], True


def focus(lines):
    hits = [i for i, l in enumerate(lines) if any(m in l for m in FAILURE_MARKS)]
    near = lambda i: any(abs(i - h) <= 10 for h in hits)
    if not hits:
        return None
    return [l if near(i) else "..." for i, l in enumerate(lines) if near(i) or (i > 0 and near(i - 1))]


def strip_diff(lines):
    keep = lambda l: l.startswith(("+++", "---", "diff ")) or not l.startswith(("+", "-", "@@"))
    return [l for l in lines if keep(l)]


def compact(text, intent=None):
    if len(text.encode()) < 256:
        return "passthrough", text
    lines = lines_of(text)
    kind = archetype(lines)
    out, ends = {"tabular": table, "linear-log": log, "tree": tree, "passthrough": prose}[kind](lines)
    done = "\n".join(out) + ("\n" if ends else "")
    again = {"debug:test-failure": focus, "commit:generate": strip_diff}.get(intent)
    biased = again(lines_of(done)) if again else None
    if biased is not None:
        done = "".join(l + "\n" for l in biased)
    return kind, done
