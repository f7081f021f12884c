"""Plain Python versions of the operators."""

import collections
import hashlib
import math
import re

import regex

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c)
        total += (v * 2 - 9 * (v > 4)) if i % 2 else v
    return total % 10 == 0


def pii(text):
    """Base spans as a comma-joined list."""
    out = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), rank, m.end(), kind))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    if len(w) >= 5:
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    return {tuple(w)} if w else set()


def near(docs, percent):
    """``{doc: (set size, component)}`` from all pairs that share a shingle."""
    sets = {d: shingles(t) for d, t in docs}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = collections.defaultdict(list)
    for d, s in sets.items():
        for g in s:
            holders[g].append(d)
    common = collections.Counter()
    for own in holders.values():
        for i, a in enumerate(own):
            for b in own[:i]:
                common[min(a, b), max(a, b)] += 1
    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def edit_distance_inside(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item):
        new = [i + 1]
        for j, b in enumerate(text):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def spot_signatures(text, common, chain=3):
    words = re.sub(r"[\W_]+", " ", (text or "").lower()).split()
    content = [w for w in words if w not in common]
    out, k = set(), 0
    fill = lambda seq, at: tuple(seq[at + c] if at + c < len(seq) else "-" for c in range(chain))
    if any(w in common for w in words):
        for i, w in enumerate(words):
            if w in common:
                out.add((w, *fill(content, i - k)))
                k += 1
    else:
        out = {(w, *fill(words, i + 1)) for i, w in enumerate(words)}
    return out


def jaccard(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def grams(text):
    """Buckets of the byte trigrams of a text's lower-case runs of letters."""
    raw = (" " + regex.sub(r"[^\p{L}]+", " ", (text or "").lower()).strip() + " ").encode()
    return [((int.from_bytes(raw[i : i + 3], "big") * 2654435761) % 2**32) >> 18 for i in range(len(raw) - 2)]


def languages(docs, pages):
    """``{page: (language, confidence)}`` by the product of all evidence, one page at a time."""
    primary = lambda v: (re.match(r"[A-Za-z]*", (v or "").strip()).group().lower()) or None
    counts = collections.defaultdict(collections.Counter)
    for text, label in docs:
        if text is not None and primary(label) not in (None, "und"):
            counts[primary(label)].update(grams(text))
    names = [*sorted(counts), "und"]

    def text_logs(seen):
        logs = []
        for name in names:
            total = sum(counts[name].values())
            share = (lambda g: 1 / 2**14) if name == "und" else (lambda g: 0.9 * counts[name][g] / total + 0.1 / 2**14)  # noqa: B023
            logs.append(sum(math.log(share(g)) for g in seen) * min(1.0, 100 / len(seen)))
        return [x - max(logs) for x in logs]

    rows = {}
    for page, url, html in pages:
        shown = regex.sub(r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<[^>]*>", " ", html or "")
        declared = re.search(r"(?i)<html\b[^>]*?\slang\s*=\s*[\"']?([A-Za-z]+)", html or "")
        host = re.match(r"^.*?://([^/?#]*)", url or "")
        host = host.group(1).lower() or None if host else None
        seen = grams(shown)
        logs = text_logs(seen) if len(seen) > 0 and regex.search(r"\p{L}", shown) else None
        rows[page] = {
            "logs": logs, "lang": names[logs.index(max(logs))] if logs else None, "host": host,
            "declared": declared and declared.group(1).lower(), "suffix": host.rsplit(".", 1)[-1] if host and "." in host else None,
            "domain": host and ".".join(host.split(".")[-2:]),
        }
    told = [r for r in rows.values() if r["lang"]]
    total = collections.Counter(r["lang"] for r in told)
    corpus = {n: (total[n] + 0.5) / (len(told) + 0.5 * len(names)) for n in names}
    by = lambda kind: collections.Counter((r[kind], r["lang"]) for r in told if r[kind] is not None)
    tables = {kind: by(kind) for kind in ("declared", "suffix", "host", "domain")}

    def share(kind, value, name):
        values = {v for v, _ in tables[kind]}
        every = sum(n for (_, other), n in tables[kind].items() if other == name)
        return math.log((tables[kind][value, name] + 0.5) / (every + 0.5 * (len(values) + 1))) if value in values else 0.0

    out = {}
    for page, r in rows.items():
        if r["logs"] is None:
            out[page] = ("und", 0.0)
            continue
        own = {n: float(n == r["lang"]) for n in names}
        prior = corpus
        for kind in ("domain", "host"):
            held = {n: tables[kind][r[kind], n] - own[n] if r[kind] is not None else 0.0 for n in names}
            prior = {n: (held[n] + 10 * prior[n]) / (sum(held.values()) + 10) for n in names}
        logs = [x + math.log(prior[n]) + share("declared", r["declared"], n) + share("suffix", r["suffix"], n) for x, n in zip(r["logs"], names)]
        best = max(logs)
        confidence = 1 / sum(math.exp(x - best) for x in logs)
        out[page] = (names[logs.index(best)] if confidence >= 0.5 else "und", confidence)
    return out
