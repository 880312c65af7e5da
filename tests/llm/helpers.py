"""Inputs and plain re-implementations for the tests of the training-data operators."""

import re

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string, id long, line string, _size int, set string, n_lines string"
TABLE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def edge_docs(spark, texts):
    """Texts with ids 0.., then the hard rows: NULL, empty, repeated, NULL id, all with clashing columns."""
    rows = [(k, t, f"s{k % 3}") for k, t in enumerate(texts)]
    rows += [(900, None, None), (901, "", "s0"), (902, "twice said is well said", "s1"), (902, "twice said is well said", "s1"), (None, "no id at all for this", None), (None, None, "s1")]
    return spark.createDataFrame([(*r, 7, "x", 1, "y", "z") for r in rows], SCHEMA)


def plain(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def shingle_set(text):
    words = (text or "").lower().encode().translate(TABLE).split()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def classes(sets):
    """(class, links) by position: Jaccard of 0.8 or more between every two sets."""
    n = len(sets)
    head, links = list(range(n)), [0] * n

    def root(k):
        while head[k] != k:
            k = head[k]
        return k

    for a in range(n):
        for b in range(a + 1, n):
            both = len(sets[a] & sets[b])
            if both and both >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                links[a], links[b] = links[a] + 1, links[b] + 1
                x, y = sorted((root(a), root(b)))
                head[y] = x
    return [root(k) for k in range(n)], links


def edits_within(item, text):
    """Least edits of the item's letters to any stretch of the text's."""
    a, b = (re.sub(r"[\W_]", "", x.lower()) for x in (item, text))
    last = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j - 1] + (x != y), last[j] + 1, row[-1] + 1))
        last = row
    return min(last)
