"""Expectation-maximisation over the votes of labelers whose reliability is unknown (a Dawid-Skene model with two classes).

Votes are strings with a digit per labeler: 1 yes, 0 no, 2 nothing. Equal vote patterns are counted before, in Spark, so the
work and the memory here depend on the number of patterns (3 ** labelers at most) and not on the corpus.
"""

from __future__ import annotations

import math

ROUNDS = 50


def reliabilities(patterns: dict[str, float], expected: list[tuple[int, int]], rounds: int = ROUNDS, silence: bool = True) -> tuple[dict[str, float], list[dict[int, list[float]]], float]:
    """(probability of yes for each vote pattern, each labeler's vote probabilities given the class, share of yes).

    expected[k] is the vote that labeler k is thought to give for no and for yes: it is taken to be better than chance.
    silence: whether a labeler's silence says something of the class; if not, only its votes count."""
    total = sum(patterns.values())
    if not total:
        return {}, [], 0.5
    # the start: the share of yes among the votes, drawn a little to yes
    post = {v: (v.count("1") + 1) / (v.count("1") + v.count("0") + 1.5) for v in patterns}
    share, tables = 0.5, []
    for _ in range(rounds):
        share = min(max(sum(n * post[v] for v, n in patterns.items()) / total, 0.01), 0.99)
        tables = []
        for k, better in enumerate(expected):
            table = {}
            for c in (0, 1):
                cells = [0.5, 0.5, 0.5]
                cells[better[c]] += 1.0
                if not silence:
                    cells[2] = 0.0
                for v, n in patterns.items():
                    if v[k] == "2" and not silence:
                        continue
                    cells[int(v[k])] += n * (post[v] if c else 1 - post[v])
                table[c] = [x / sum(cells) for x in cells]
            tables.append(table)
        new = {}
        for v in patterns:
            odds = math.log(share / (1 - share)) + sum(math.log(tables[k][1][int(x)] / tables[k][0][int(x)]) for k, x in enumerate(v) if silence or x != "2")
            new[v] = 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))
        moved = max(abs(new[v] - post[v]) for v in patterns)
        post = new
        if moved < 1e-9:
            break
    return post, tables, share
