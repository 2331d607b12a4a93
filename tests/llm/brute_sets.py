"""What the Jaccard join must give, by comparing every set with every other."""


def shingles(text, k):
    w = [x.decode() for x in (text or "").encode().lower().split()]
    return set(map(tuple, ([w] if 0 < len(w) < k else [w[j : j + k] for j in range(len(w) - k + 1)])))


def components(texts, k, num, den):
    """A number of each text's component, the same for those that link, directly or over others; None for empty sets."""
    sets = [shingles(t, k) for t in texts]
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                up[find(a)] = find(b)
    return [find(k) if s else None for k, s in enumerate(sets)]
