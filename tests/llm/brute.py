"""Plain versions of the contracts, written apart from the operators."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def lower_ascii(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def chat(rows):
    """conv -> (n_turns, turns_sha256, loss_chars, loss_sha256)."""
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for _, _, r, t in turns)), len(loss), sha(loss))
    return out


def base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(8)}
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), failed


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def url(u, rules=RULES):
    """host, path, rule, verdict."""
    if u is None or "://" not in u:
        return "", "", None, "allow"
    rest = u.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = lower_ascii(host)
    fits = [r for r in rules if host and (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    if not fits:
        return host, path, None, "allow"
    best = max(fits, key=lambda r: (r[0].count("."), len(r[1]), r[2] == "block"))
    return host, path, best[0] + best[1], best[2]


def simhash(text):
    words = WORD.findall(lower_ascii(text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def components(fps, distance=3):
    """(id, fp) -> id -> least id of the component."""
    distinct = sorted({f for _, f in fps})
    parent = {f: f for f in distinct}

    def find(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= distance:
                parent[find(b)] = find(a)
    least = {}
    for k, f in fps:
        r = find(f)
        least[r] = min(x for x in (least.get(r), k) if x is not None) if k is not None or r in least else None
    return {(k, f): least[find(f)] for k, f in fps}


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(text):
    text = text or ""
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{k}:{a}:{b}" for a, _, k, b in sorted(found)]


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower_ascii(text or ""))


def contamination(documents, items):
    """n_words, n_hit, n_items, items_sha256, contaminated per document."""
    windows = defaultdict(set)
    for item, text in items:
        words = bench_words(text)
        for i in range(max(1, len(words) - 12)) if words else ():
            windows[tuple(words[i : i + 13])].add(item)
    sizes = {len(w) for w in windows}
    out = []
    for _, text in documents:
        words = bench_words(text)
        hit, held = set(), set()
        for size in sizes:
            for i in range(len(words) - size + 1):
                if (w := tuple(words[i : i + size])) in windows:
                    hit.update(range(i, i + size))
                    held |= windows[w]
        ids = sorted(str(x) for x in held if x is not None)
        out.append((len(words), len(hit), len(ids), sha(",".join(ids)), len(hit) > 0 and 20 * len(hit) >= len(words)))
    return out


def targets(sizes):
    """source -> target, by sharing the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    demand, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        rest, total = demand - sum(fixed.values()), sum(weight[s] for s in free)
        over = [s for s in free if rest * weight[s] / total > 2 * sizes[s]]
        if not over:
            return fixed | {s: rest * weight[s] / total for s in free}
        fixed |= {s: 2.0 * sizes[s] for s in over}


def warc(pages):
    """page_id -> (bytes, digest, type, refers_to)."""
    rows = [(p, len((h or "").encode()), sha(h or "")) for p, _, h in pages]
    first = {}
    for p, n, d in rows:
        if n >= 100 and p is not None:
            first[d] = min(first.get(d, p), p)
    return [(p, n, d, *(("revisit", first[d]) if d in first and n >= 100 and p != first[d] else ("response", None))) for p, n, d in rows]


def crc(text):
    return zlib.crc32((text or "").encode())


SYMBOLS = b"#*$%&|<>!?^~_=+@"


def quality_features(text, n_chars, buckets):
    """position -> value of the classifier's features: structure first, then hashed words."""
    import math

    text = text or ""
    words = re.findall(rb"[^\x20\x09-\x0D]+", text.encode())
    n, chars, d = len(words), len(text), max(1, len(words))
    lines = [x for x in text.split("\n") if x.strip()]
    count = lambda of: sum(text.count(c) for c in of)
    structure = [
        math.log1p(n) / 8, math.log1p(chars) / 10, min(2.0, chars / d / 10), sum(w.isupper() and len(w) > 1 for w in words) / d, sum(w[-1] in SYMBOLS for w in words) / d, count("0123456789") / max(1, chars),
        count("#*$%&|<>") / max(1, chars) * 4, len(set(words)) / d, sum(a == b for a, b in zip(words, words[1:], strict=False)) / d, 1 - len(set(lines)) / max(1, len(lines)), min(2.0, n / max(1, len(lines)) / 50),
        min(2.0, count(".!?") / d * 4), min(2.0, count("|»•·") / d * 2), count(" ") / max(1, chars), min(2.0, max((min(len(w), 255) for w in words), default=0) / 50), float(n == 0),
        math.log1p(max(0, n_chars or 0)) / 10, float(n_chars is None), float(n_chars is not None and n_chars != chars),
    ]
    bags = Counter(zlib.crc32(w.lower()) % buckets for w in words)
    norm = math.sqrt(n * (1 + 10 / n)) if n else 1.0
    return dict(enumerate(structure)) | {len(structure) + k: math.sqrt(v) / norm for k, v in bags.items()}


def quality_score(model, x):
    """The factorisation machine with its pairs one by one."""
    import math

    items = sorted(x.items())
    y = model.w0 + sum(model.w[i] * v for i, v in items)
    for k, (i, v) in enumerate(items):
        for j, w in items[k + 1 :]:
            y += float(model.v[i] @ model.v[j]) * v * w
    return 1 / (1 + math.exp(-max(-30, min(30, y))))


BROAD = {
    "prefixed": (r"\b(?:ghp_|gho_|ghs_|github_pat_|glpat-|xox[abprs]-|sk_live_|sk-|AIza|hf_)[A-Za-z0-9_-]{16,}", 16),
    "jwt": (r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 24),
    "login": (r"\b[a-z][a-z0-9+.-]{1,20}://[^\s:/@]{1,200}:[^\s:/@]{1,200}@", 8),
}


def all_spans(rows, owners=3, repositories=10):
    """spans of (doc_id, text, source) rows: the base kinds, and the others' whose value is not widely copied."""
    found, held = [], defaultdict(set)
    for i, text, source in rows:
        text = text or ""
        mine = [(m.start(), 0, "assign", m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
        mine += [(m.start(), 1, "access", m.end(), m[0]) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        mine += [(m.start(), 2, "hex", m.end(), m[0]) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
        for k, (kind, (pattern, least)) in enumerate(BROAD.items()):
            mine += [(m.start(), 3 + k, kind, m.end(), m[0]) for m in re.finditer(pattern, text, re.A) if len(m[0]) >= least]
        found.append((i, mine))
        for *_, value in mine:
            held[value].add((source, i))
    copied = {v for v, h in held.items() if len({s for s, _ in h}) >= owners or (len({s for s, _ in h}) >= 2 and len({i for _, i in h}) >= repositories)}
    return [(i, ",".join(f"{k}:{a}:{b}" for a, _, k, b, v in sorted(mine) if k not in BROAD or v not in copied)) for i, mine in found]


def mixed_positions(rows, schedules, steps=20_000):
    """(doc_id, size, taken, copies, position of the first word) of (doc_id, text, source) rows, with the schedules integrated in small steps."""
    import bisect

    size = lambda t: len(WORD.findall(t or ""))
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += size(t)
    want, order = targets(sizes), sorted(sizes, key=lambda s: (s is None, s or ""))

    def curve(knots):
        total, out = 0.0, [0.0]
        for k in range(steps):
            t = (k + 0.5) / steps
            (a, v), (b, w) = next((p, q) for p, q in zip(knots, knots[1:], strict=False) if p[0] <= t <= q[0])
            total += v + (w - v) * (t - a) / (b - a)
            out.append(total)
        return [x / total for x in out]

    curves = [curve(k) for k in schedules]
    which = {s: curves[i % len(curves)] for i, s in enumerate(order)}
    whole = sum(want.values())
    drawn = [sum(want[s] * which[s][k] for s in order) / whole if whole else 1.0 for k in range(steps + 1)]
    out = []
    for s in order:
        mine = sorted((hashlib.md5(f"{'null' if i is None else i}:{hashlib.md5((t or '').encode()).hexdigest()}".encode()).hexdigest(), i is None, i or 0, size(t), t) for i, t, z in rows if z == s)
        at, total = 0, int(want[s])
        for _, none, i, n, t in mine:
            passes = total // sizes[s] if sizes[s] else 0
            taken = passes * n + max(0, min(n, total - passes * sizes[s] - at))
            copies = (2 * taken + n) // (2 * n) if n else 0
            share = min(1.0, at / want[s]) if want[s] else 1.0
            out.append((None if none else i, t, n, taken, copies, drawn[min(steps, bisect.bisect_left(which[s], share))]))
            at += n
    return out
