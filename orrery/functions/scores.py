"""Scores of a text against a reference, after their published formulas."""

from __future__ import annotations

import math
from collections import Counter


def bleu(reference: str, candidate: str, most: int = 4) -> float:
    """Sentence BLEU over words; a precision without matches counts 0.1 of a match."""
    a, b = reference.split(), candidate.split()
    if not a or not b:
        return 0.0
    total = 0.0
    for n in range(1, most + 1):
        x, y = (Counter(zip(*[w[i:] for i in range(n)])) for w in (a, b))
        hits, all_ = sum((x & y).values()), max(1, sum(y.values()))
        if not hits and n == 1:
            return 0.0
        total += math.log((hits or 0.1) / all_) / most
    return min(1.0, math.exp(1 - len(a) / len(b))) * math.exp(total) if len(b) < len(a) else math.exp(total)


def rouge_l(reference: str, candidate: str) -> float:
    """F1 of the longest common subsequence of words."""
    a, b = reference.split(), candidate.split()
    if not a or not b:
        return 0.0
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    p, r = row[-1] / len(b), row[-1] / len(a)
    return 2 * p * r / (p + r) if p + r else 0.0


def truncated(tac: str, most: int) -> tuple[str, str]:
    """A text of at most ``most`` words and how it got there: as it is, without comments, without dead code, or cut by lines."""
    fits = lambda t: len(t.split()) <= most
    if fits(tac):
        return tac, "none"
    lines = [x for x in tac.splitlines() if not x.strip().startswith("//")]
    if fits("\n".join(lines)):
        return "\n".join(lines), "strip_comments"
    live, dead = [], False
    for x in lines:
        s = x.strip()
        if s.endswith(":"):
            dead = False
        if not dead:
            live.append(x)
        if s.startswith(("return ", "revert ", "goto ", "stop(", "selfdestruct(")):
            dead = True
    if fits("\n".join(live)):
        return "\n".join(live), "drop_dead_code"
    kept, n = [], 0
    for x in live:
        n += len(x.split())
        if n > most - 10:
            break
        kept.append(x)
    return "\n".join([*kept, "// ... truncated"]), "hard_limit"


def masked(prompt: list[int], target: list[int], most: int, ignore: int = -100) -> tuple[list[int], list[int]]:
    """Ids and labels of a prompt and its target: the target has the first claim on the budget, the prompt isn't learned."""
    target = target[:most]
    prompt = prompt[: most - len(target)]
    return [*prompt, *target], [ignore] * len(prompt) + target
