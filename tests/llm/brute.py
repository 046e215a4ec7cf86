"""Plain versions of operators, for comparison."""

import math
from collections import Counter

from sparkdraw.llm.lm import BACKOFF


def stupid_backoff(documents, order, cutoff):
    """The log-score of each list of token ids, by dictionaries of counts of whole documents."""
    mark = object()
    rows = [[mark, mark, *map(int, d)] for d in documents if len(d)]
    counts = Counter(tuple(r[i : i + k]) for r in rows for k in (2, 3) for i in range(len(r) - k + 1))
    counts.update((t,) for r in rows for t in r[1:])  # one mark a document
    total = sum(n for g, n in counts.items() if len(g) == 1 and g[0] is not mark)

    def one(gram):
        if len(gram) == 1:
            return counts[gram] / total
        return counts[gram] / counts[gram[:-1]] if counts[gram] >= cutoff else BACKOFF * one(gram[1:])

    padded = [[mark, mark, *map(int, d)] for d in documents]
    return [sum(math.log(one(tuple(r[i - order + 1 : i + 1]))) for i in range(2, len(r))) for r in padded]
