"""Brute-force forms of the operators."""


def shingles(text, n=5):
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)}


def jaccard_components(rows, percent=75):
    """``[(doc_id, n, component)]`` from ``[(doc_id, text)]``, comparing every two rows that share a shingle."""
    sets = [shingles(text) for _, text in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    where = {}
    for i, s in enumerate(sets):
        shared = {}
        for x in s:
            for j in where.setdefault(x, []):
                shared[j] = shared.get(j, 0) + 1
            where[x].append(i)
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted((d, len(s), least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def katz_scores(rows, k=5):
    """``[(doc_id, n_tokens, n_known, base, score)]`` from ``[(doc_id, text)]`` by dictionaries of counts."""
    import math
    import zlib
    from collections import Counter, defaultdict

    texts = [(d, (t or "").encode().lower().split() + [1], d is not None and zlib.crc32(str(d).encode()) % 10 == 0) for d, t in rows]
    uni, follow, starts = Counter(), defaultdict(Counter), 0
    for _, tokens, held in texts:
        if not held:
            starts += 1
            uni.update(tokens)
            for h, w in zip([0] + tokens, tokens):
                follow[h][w] += 1
    total, types = sum(uni.values()), len(uni)

    def discount(counts):
        n = Counter(counts)
        tail = (k + 1) * n[k + 1] / n[1] if n[1] else 1.0
        out = {}
        for r in range(1, k + 1):
            d = ((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail) if n[r] and tail != 1 else 0
            out[r] = d if 0 < d < 1 else (r - 0.5) / r
        return lambda r: out.get(r, 1.0)

    d1, d2 = discount(uni.values()), discount(c for f in follow.values() for c in f.values())
    kept = sum(d1(c) * c for c in uni.values())
    rest = max(total - kept, 1) / max(total, 1) if total else 1.0
    low = {w: d1(c) * c * (1 - rest) / kept for w, c in uni.items()}

    def model(h, w):
        seen = follow.get(h)
        if not seen:
            return low.get(w, rest)
        count = sum(seen.values()) + (not any(c <= k for c in seen.values()))
        if w in seen:
            return d2(seen[w]) * seen[w] / count
        alpha = (1 - sum(d2(c) * c for c in seen.values()) / count) / (1 - sum(low[x] for x in seen))
        return alpha * low.get(w, rest)

    for h in list(follow)[:20]:
        assert abs(sum(model(h, w) for w in uni) + model(h, None) - 1) < 1e-9
    cache = {}
    out = []
    for d, tokens, _ in texts:
        base = sum(math.log10((uni[w] + 0.1) / (total + 0.1 * (types + 1))) for w in tokens)
        score = 0.0
        for pair in zip([0] + tokens, tokens):
            if pair not in cache:
                cache[pair] = math.log10(model(*pair))
            score += cache[pair]
        out.append((d, len(tokens), sum(uni[w] > 0 for w in tokens), total, base, score))
    return out
