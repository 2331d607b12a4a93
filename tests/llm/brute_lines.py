"""What line dedup must give, from the definition: each place is compared with every earlier one."""


def words(line):
    return len(line.encode().split())


def removed(rows, min_words, order=lambda t: t):
    """{(id, text): removed line numbers} of rows (id, text): a run of whole lines of at least min_words words goes where
    it occurs earlier as well (in an earlier document, or above in the same one), the two copies not overlapping. Documents
    of one id are ordered by `order` of their texts."""
    docs = sorted({(i, t) for i, t in rows if t is not None}, key=lambda d: (d[0] is not None, d[0] or 0, order(d[1])))
    lined = [[(k, x) for k, x in enumerate(t.split("\n")) if words(x)] for _, t in docs]
    out = {d: set() for d in docs}
    for n, own in enumerate(lined):
        for o in range(len(own)):
            for m in range(n + 1):
                for p in range(o if m == n else len(lined[m])):
                    most = min(len(own) - o, (o - p) if m == n else len(lined[m]) - p)
                    length = 0
                    while length < most and own[o + length][1] == lined[m][p + length][1]:
                        length += 1
                    if sum(words(x) for _, x in own[o : o + length]) >= min_words:
                        out[docs[n]] |= {k for k, _ in own[o : o + length]}
    return {d: v for d, v in out.items() if v}
