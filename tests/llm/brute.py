"""Plain versions of the operators' contracts, for small inputs."""

import hashlib
import re
from collections import Counter

import xxhash


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def op1(rows):
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for i, (doc, text) in enumerate(order):
        text, nxt = text or "", order[(i + 1) % len(order)][1] or ""
        k = len(text) // 3
        out[doc] = (len(text), sha(text[: len(text) - k] + nxt[:k]))
    return out


def op2(rows, window=35):
    words = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (doc, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((doc, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return sorted(out, key=str)


def simhash(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = WORD.findall(text)
    if not w:
        return 0
    grams = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def op5(rows):
    fps = [(d, simhash(t)) for d, t in rows]
    comp = {}
    left = dict(fps)
    for d, _ in sorted(fps):
        if d in comp:
            continue
        todo, comp[d] = [d], d
        while todo:
            a = todo.pop()
            for b, f in left.items():
                if b not in comp and (f ^ left[a]).bit_count() <= 4:
                    comp[b] = d
                    todo.append(b)
    return {d: (f"{f:016x}", comp[d]) for d, f in fps}


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, ch in enumerate(reversed(digits)):
        n = int(ch) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def op3_spans(text):
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", m) for m in EMAIL.finditer(text)]
    out += [("ip", m) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", m) for m in CARD.finditer(text) if 12 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [("phone", m) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]
    kinds = ["email", "ip", "card", "phone"]
    return sorted(((m.start(), kinds.index(k), k, m.end()) for k, m in out))


def op3(text):
    spans = op3_spans(text)
    count = Counter(k for _, _, k, _ in spans)
    return (*(count[k] for k in ("email", "ip", "card", "phone")), sha(",".join(f"{k}:{s}:{e}" for s, _, k, e in spans)))


def op3_found(texts, confidence=0.8, seeds=5):
    """All spans of each text: base ones and those of a plain bootstrapping loop (kinds by name)."""
    import regex

    space, ends = " \t\n\r\f\x0b", " \t\n\r\f\x0b\"'<>|,;="
    letter = regex.compile(r"[\p{L}\p{N}]")
    groups = regex.compile(r"[(]?[0-9]++[)]?(?:[ ./-][(]?[0-9]++[)]?)++(?![\p{L}\p{N}@])")

    def words(t):
        i = 0
        while i < len(t):
            if t[i] in ends:
                i += 1
                continue
            m = groups.match(t, i)
            j = m.end() if m else next((k for k in range(i, len(t)) if t[k] in ends), len(t))
            if any(c.isascii() and c.isdigit() or c == "@" for c in t[i:j]):
                yield i, j
            i = j
            if m:  # what is glued to a group of digits begins no word
                while i < len(t) and t[i] not in ends:
                    i += 1

    def inner(t, s, e):
        while s < e and not letter.match(t[s]):
            s += 1
        while s < e and not letter.match(t[e - 1]):
            e -= 1
        return s, e

    def context(t, left, s, e, right):
        b = s
        while b > left and not letter.match(t[b - 1]):
            b -= 1
        core = t[left:b].translate({ord(c): " " for c in space}).split(" ")[-1].lower()
        tail = "".join(c for c in t[b:s] if c not in space)
        m = regex.match(r"[^\p{L}\p{N}]*+([\p{L}\p{N}_]++)", t[e:right])
        return (f"{core} {tail}" if tail else core) if core else "", m[1].lower() if m else ""

    seen = []  # (text, s, e, kind or None, value, patterns)
    out = []
    for n, t in enumerate(texts):
        t = t or ""
        base = op3_spans(t)
        out.append({(s, e, k) for s, _, k, e in base})
        found = []
        for kind in ("email", "ip", "card", "phone"):
            shape = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}[kind]
            raw = [(m.start(), m.end()) for m in shape.finditer(t)]
            if kind == "card":  # other chains of digits do not end a context
                raw = [(s, e) for s, e in raw if 12 <= len(re.sub("[^0-9]", "", t[s:e])) <= 19]
            for i, (s, e) in enumerate(raw):
                if (s, e, kind) in out[-1]:
                    found.append((s, e, kind, t[s:e], context(t, raw[i - 1][1] if i else 0, s, e, raw[i + 1][0] if i + 1 < len(raw) else len(t))))
        runs = list(words(t))
        for i, (s, e) in enumerate(runs):
            x, y = inner(t, s, e)
            if x == y or any(b < y and x < f for b, f, _ in out[-1]):
                continue
            left, right = context(t, runs[i - 1][1] if i else 0, s, e, runs[i + 1][0] if i + 1 < len(runs) else len(t))
            if left and x > s:
                left += ("" if " " in left else " ") + t[s:x]
            v = t[x:y]
            is_hex = re.fullmatch("[0-9A-Fa-f]{32,}", v) and re.search("[A-Fa-f]", v) and re.search("[0-9]", v)
            found.append((x, y, "secret" if is_hex else None, v, (left, right)))
        for s, e, kind, v, (left, right) in found:
            ways = [f"<{left}"] * bool(left) + [f">{right}"] * bool(right) + [f"={left} {right}"] * bool(left and right)
            seen += [(n, s, e, kind, v, w) for w in ways]
    total = Counter(w for *_, w in seen)
    edges = Counter((w, v, kind) for _, _, _, kind, v, w in seen)
    belief, before = {}, None
    while True:
        good, some = Counter(), Counter()
        for (w, v, kind), c in edges.items():
            if kind:
                good[w, kind] += c
                some[w, kind] += 1
            else:
                for k, b in belief.get(v, {}).items():
                    good[w, k] += c * b
        trusted = {x: g / (total[x[0]] + 1) for x, g in good.items() if some[x] >= seeds and g / (total[x[0]] + 1) >= confidence}
        if trusted == before:
            break
        before, belief = trusted, {}
        for (w, v, kind), _ in edges.items():
            if not kind:
                for (x, k), p in trusted.items():
                    if x == w:
                        belief.setdefault(v, {}).setdefault(k, 0.0)
                        belief[v][k] = 1 - (1 - belief[v][k]) * (1 - min(p, 0.999999))
    order = ["email", "ip", "card", "phone", "secret"]
    best = {v: max(b, key=lambda k: (b[k], -order.index(k))) for v, b in belief.items() if max(b.values()) >= confidence}
    for n, s, e, kind, v, w in seen:
        if kind == "secret" and (w, "secret") in trusted:
            out[n].add((s, e, "secret"))
        if kind is None and v in best and (w, best[v]) in trusted:
            out[n].add((s, e, best[v]))
    return [",".join(f"{k}:{s}:{e}" for s, e, k in sorted(x, key=lambda x: (x[0], order.index(x[2]), x[1]))) for x in out]


def op10(rows, k=20, every=20):
    import math

    good = {i: [math.floor(64 * float(x)) for x in v] for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q, a in sorted(good.items()):
        if q % every == 0:
            s = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good.items() if i != q)[:k]
            out += [(q, r + 1, i, -t) for r, (t, i) in enumerate(s)]
    return out
