"""Plain Python versions of the operators, for small inputs."""

import hashlib
import math
import re
from collections import Counter, defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def alnum(text):
    return ALNUM.findall((text or "").translate(LOWER))


def sentences(line):
    """(start, stop) of the parts of a line, each up to and with its closing marks; marks at the start belong to the first."""
    out, start, body = [], 0, False
    for i, c in enumerate(line):
        if c in ".!?…":
            continue
        if body and line[i - 1] in ".!?…":
            out.append((start, i))
            start = i
        body = True
    return [*out, (start, len(line))] if line else []


def substring_dedup(docs, least=10):
    """docs: (doc_id, text) with distinct ids. Goes through all texts in order and remembers every unit it has met."""
    say = lambda words: " ".join(words).lower()
    seen, out = {}, {}
    for doc_id, text in sorted(docs, key=lambda d: d[0]):
        if text is None:
            out[doc_id] = (None, 0, "")
            continue
        rows, at = [], 0  # number, start, stop, words of each line
        for number, line in enumerate(text.split("\n")):
            rows.append((number, at, at + len(line), SPACED.findall(line)))
            at += len(line) + 1
        few = sum(len(r[3]) for r in rows) < least
        groups = []  # lists of worded lines: a long one, or all shorter ones up to the next long one
        for r in rows:
            if r[3]:
                long = len(r[3]) >= least
                if long or not groups or len(groups[-1][0][3]) >= least:
                    groups.append([r])
                else:
                    groups[-1].append(r)
        state, inner = [], {}  # for each group: its first place, and whether it goes by itself; for each line: its repeated sentences
        for g in groups:
            ws = [w for r in g for w in r[3]]
            here = (doc_id, g[0][1])
            state.append((seen.setdefault(say(ws), here), few or len(ws) >= least))
            if len(g[0][3]) >= least:
                number, a, b, _ = g[0]
                parts = [(a + x, a + y, SPACED.findall(text[a + x : a + y])) for x, y in sentences(text[a:b])]
                parts = parts if sum(bool(p[2]) for p in parts) > 1 else []
                firsts = [(p, seen.setdefault(say(p[2]), (doc_id, p[0]))) for p in parts if len(p[2]) >= least]
                inner[number] = [(p[0], p[1], f) for p, f in firsts if f != (doc_id, p[0])]
        gone = [f != (doc_id, g[0][1]) for (f, _), g in zip(state, groups, strict=True)]
        edge = [True, *[go and own for go, (_, own) in zip(gone, state, strict=True)], True]
        all_gone = [gone[i] and (state[i][1] or (edge[i] and edge[i + 2])) for i in range(len(groups))]
        says, cut = [], set()
        for g, (f, _), go in zip(groups, state, all_gone, strict=True):
            if go:
                says.append((g[0][1], g[-1][2], f))
                cut.update(range(g[0][0], g[-1][0] + 1))
        left = []
        for number, a, b, _ in rows:
            if number in cut:
                continue
            rest, place = "", a
            for x, y, f in inner.get(number, ()):
                says.append((x, y, f))
                rest, place = rest + text[place:x], y
            rest += text[place:b]
            if not inner.get(number) or SPACED.search(rest):
                left.append(rest)
        shown = [f"{a}:{b}:{f[0]}:{f[1]}" for a, b, f in sorted(says, key=lambda x: x[0])]
        out[doc_id] = ("\n".join(left), len(says), ",".join(shown))
    return out


def chunk_dedup(docs, split):
    seen, out = {}, {}
    for doc_id, text in sorted(docs):
        if text is None:
            out[doc_id] = (None, 0, "")
            continue
        kept, says = [], []
        for a, b, lines in split(text):
            body = text[a:b].rstrip("\n")
            first = seen.setdefault(body, (doc_id, a)) if lines > 1 else (doc_id, a)
            if first == (doc_id, a):
                kept.append(text[a:b])
            else:
                says.append(f"{a}:{b}:{first[0]}:{first[1]}")
        out[doc_id] = ("".join(kept), len(says), ",".join(says))
    return out


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def pii(text):
    text, spans = text or "", []
    for kind, pattern in PII.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")),
                "card": 16 <= len(digits) <= 19 and luhn(digits),
                "phone": 8 <= len(digits) <= 15,
            }[kind]
            if good:
                spans.append((kind, m.start(), m.end()))
    return spans


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """sizes: source to words. Shares what is left by weight again and again until no source is above its most."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, free, left = dict.fromkeys(order, 0.0), set(order), share * sum(sizes.values())
    while left > 1e-9 and free:
        unit = left / sum(weight[s] for s in free)
        left = 0.0
        for s in sorted(free, key=str):
            target[s] += unit * weight[s]
        for s in list(free):
            if target[s] > most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                free.discard(s)
    return target


def decontaminate(docs, items, n=13):
    wins = defaultdict(set)
    for item_id, text in items:
        ws = alnum(text)
        for i in range(max(len(ws) - n, 0) + 1 if ws else 0):
            wins[tuple(ws[i : i + n])].add("" if item_id is None else str(item_id))
    lengths = {len(w) for w in wins}
    out = {}
    for doc_id, text in docs:
        ws, hit, ids = alnum(text), set(), set()
        for m in lengths:
            for i in range(len(ws) - m + 1):
                if tuple(ws[i : i + m]) in wins:
                    hit.update(range(i, i + m))
                    ids |= wins[tuple(ws[i : i + m])]
        out[doc_id] = (len(ws), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(ws))
    return out


def quality_base(text):
    text = text or ""
    ws = SPACED.findall(text)
    lines = [x for x in text.split("\n") if SPACED.search(x)]
    runs = defaultdict(list)
    for i in range(len(ws) - 4):
        runs[tuple(ws[i : i + 5])].append(i)
    covered = {j for at in runs.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    failed = len(ws) < 10 or 100 * len(covered) > 20 * len(ws)
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def run_buckets(text):
    data = (text or "").encode()
    return [((int.from_bytes(data[i : i + 4], "little") * 2654435761) % 2**32) >> 16 for i in range(len(data) - 3)]


def likelihood_scores(docs, trusted, size=1 << 16):
    raw, target = Counter(), Counter()
    for doc_id, text in docs:
        b = run_buckets(text)
        raw.update(b)
        if doc_id in trusted:
            target.update(b)
    r, t = sum(raw.values()) + size, sum(target.values()) + size
    score = {}
    for doc_id, text in docs:
        b = run_buckets(text)
        score[doc_id] = sum(math.log((target[x] + 1) / t) - math.log((raw[x] + 1) / r) for x in b) / max(len(b), 1)
    return score


def shingles(text, n=5):
    ws = alnum(text)
    return {tuple(ws[i : i + n]) for i in range(max(len(ws) - n, 0) + 1)} if ws else set()


def near_duplicates(docs, threshold=0.8):
    """{doc_id: (class id, links)} by comparing every pair of documents that share a shingle."""
    sets = {doc_id: shingles(text) for doc_id, text in docs}
    having, links, root = defaultdict(list), Counter(), {d: d for d in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for d in sorted(sets):
        common = Counter()
        for s in sets[d]:
            common.update(having[s])
            having[s].append(d)
        for other, c in common.items():
            if c >= threshold * (len(sets[d]) + len(sets[other]) - c) - 1e-9:
                links[d] += 1
                links[other] += 1
                a, b = top(d), top(other)
                root[max(a, b)] = min(a, b)
    return {d: (top(d), links[d]) for d in sets}


def ppm_bits(text, training, order=4):
    """Code length of bytes under counts of the training texts, with method C escapes and no exclusions."""
    counts = defaultdict(Counter)
    for t in training:
        padded = b"\n" * order + t
        for i in range(order, len(padded)):
            for k in range(order + 1):
                counts[padded[i - k : i]][padded[i]] += 1
    padded, bits = b"\n" * order + text, 0.0
    for i in range(order, len(padded)):
        for k in range(order, -1, -1):
            seen = counts.get(padded[i - k : i])
            if seen is None:
                continue
            total = sum(seen.values()) + len(seen)
            if seen[padded[i]]:
                bits -= math.log2(seen[padded[i]] / total)
                break
            bits -= math.log2(len(seen) / total)
        else:
            bits += 8
    return bits
