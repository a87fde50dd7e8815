"""Plain versions of the operators' results, on lists in one process."""

import hashlib
import math
import re
import unicodedata
import zlib

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def canonical(text):
    nfkc = lambda s: unicodedata.normalize("NFKC", s)
    return re.sub(r"[\s\x1c-\x1f]+", " ", nfkc(nfkc(text or "").casefold())).strip(" ")


def wide(text):
    one = xxhash.xxh64_intdigest(text.encode(), 42)
    two = xxhash.xxh64_intdigest(text.encode(), xxhash.xxh64_intdigest(b"wide", 42))
    return f"{one:016x}{two:016x}"


def edited(rows):
    """{doc_id: (n_chars, edited_sha256, fingerprint, edited_fingerprint, near_next)}"""
    rows = sorted((i, t or "") for i, t in rows)
    out = {}
    for k, (i, text) in enumerate(rows):
        follow = rows[(k + 1) % len(rows)][1]
        q = len(text) // 4
        new = text[: len(text) - q] + follow[:q]
        fp = wide(canonical(text))
        out[i] = (len(text), hashlib.sha256(new.encode()).hexdigest(), fp, wide(canonical(new)), float(fp == wide(canonical(follow))))
    return out


def simhash(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = WORD.findall(text)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(rows, radius=3):
    """{doc_id: (fingerprint, component)} of (doc_id, text), all pairs compared."""
    fps = {i: simhash(t) for i, t in rows}
    parent = {i: i for i in fps}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(fps)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (f"{fps[i]:016x}", find(i)) for i in ids}


def tokens(rows, tokenizer):
    out, start = {}, 0
    for i, text in sorted((i, t or "") for i, t in rows):
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
        out[i] = (start, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids)))
        start += len(ids)
    return out


def first_of_similar(rows, similarity=0.8):
    """Ids that stay if all pairs of sets of five-word shingles are compared."""
    from fractions import Fraction

    least, sets = Fraction(str(similarity)), {}
    for i, text in rows:
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(words[p : p + 5]) for p in range(max(1, len(words) - 4))} if words else set()
    holders = {}
    for i in sorted(sets):
        for s in sets[i] or [()]:
            holders.setdefault(s, []).append(i)
    shared = {}
    for found in holders.values():
        for n, a in enumerate(found):
            for b in found[n + 1 :]:
                shared[a, b] = shared.get((a, b), 0) + 1
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (a, b), n in shared.items():
        if not sets[a] and not sets[b] or n >= least * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return sorted({find(i) for i in sets})


def quality_score(model, text):
    """Softmax over the mean of the features' weights, feature by feature."""
    words, features = (text or "").split(), []
    for word, last in zip(words, [None, *words]):
        marked = f"<{word}>"
        features += [f"\0{word}"] + [marked[i : i + 3] for i in range(len(marked) - 2)] + ["\1same word again"] * 8 * (word == last)
    weights = [float(model.weights[zlib.crc32(f.encode("utf-8", "surrogatepass")) % len(model.weights)]) for f in features]
    logit = model.bias + (sum(weights) / len(weights) if weights else 0)
    return 1 / (1 + math.exp(-min(30, max(-30, logit))))


def severity(model, text):
    """Expected grade: sums over all places of each feature in each word between marks."""
    marked = [f"<{w}>" for w in re.findall(r"[^\W\d_]+", (text or "").lower())]
    x = 0.0
    for feature, weight in model.weights.items():
        n = sum(w.startswith(feature, i) for w in marked for i in range(len(w)))
        x += weight * (1 + math.log(n)) if n else 0
    return sum(1 / (1 + math.exp(-min(40, max(-40, x - t)))) for t in model.thresholds)
