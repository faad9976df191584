"""Plain versions of the operators, one text or pair at a time."""

import math
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def components(ids, links):
    up = {i: i for i in ids}

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def jaccard_components(texts, k, percent):
    sets = {i: shingles(t, k) for i, t in texts.items()}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return {i: (len(sets[i]), c) for i, c in components(list(sets), links).items()}


def within_one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def dedup_lines(texts, least=1):
    """{id: text} in id order -> {id: text} without repeated lines."""
    norm = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    lines = [(i, n, x, norm(x)) for i in sorted(texts) for n, x in enumerate((texts[i] or "").split("\n"))]
    first, near = {}, set()
    for i, n, _, y in lines:
        if y and y not in first:
            if len(y) >= least and any(len(z) >= least and within_one_edit(z, y) for z in first):
                near.add(y)
            first[y] = (i, n)
    out = {i: [] for i in texts}
    for i, n, x, y in lines:
        if not y or (y not in near and first[y] == (i, n)):
            out[i].append(x)
    return {i: None if texts[i] is None else "\n".join(v) for i, v in out.items()}


def base_counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for x in text.split("\n"):
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    wins = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    twice = {x for x, n in Counter(wins).items() if n > 1}
    covered = {i + j for i, x in enumerate(wins) if x in twice for j in range(5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def mix(rows, weights=(5, 2, 1), share=1.5, most=2.0, block=64, buckets=1024, bits=44):
    """[(id, source, size, key)] -> {id: (target, taken, slot, slot2)}: slots drawn one by one."""
    names = sorted({r[1] for r in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(r[2] for r in rows if r[1] == s) for s in names}
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free = {}, [s for s in names if total[s]]
    while free:
        level = (share * sum(total.values()) - sum(target.values())) / sum(w[s] for s in free)
        over = [s for s in free if most * total[s] <= level * w[s]]
        target |= {s: most * total[s] for s in over}
        if not over:
            target |= {s: level * w[s] for s in free}
            break
        free = [s for s in free if s not in target]
    words, cum, run, out = {}, [], 0.0, {}
    for s in names:
        run += target.get(s, 0.0)
        cum.append((run, s))
        words[s] = [r[0] for r in sorted((r for r in rows if r[1] == s), key=lambda r: (r[3] % buckets, r[3])) for _ in range(r[2])]
    used, got, slots = dict.fromkeys(names, 0), {}, {}
    ends = [(round(c / run * 2**bits) if run else 0, s) for c, s in cum]
    for slot in range(round(share * sum(total.values()) / block)):
        x = int(f"{slot:0{bits}b}"[::-1], 2)
        s = next((s for e, s in ends if x < e), ends[-1][1])
        blocks = -(-total[s] // block)
        around, b = divmod(used[s], blocks)
        used[s] += 1
        if around < 2:
            for i in words[s][b * block : (b + 1) * block]:
                got[i] = got.get(i, 0) + 1
                slots.setdefault((i, around), slot)
                slots[i, around] = min(slots[i, around], slot)
    return {r[0]: (target.get(r[1], 0.0), got.get(r[0], 0), slots.get((r[0], 0)), slots.get((r[0], 1))) for r in rows}


def token_measures(word_chars, tokens, is_byte):
    """Characters per token, share of byte tokens, entropy of a list of ids."""
    n, counts = len(tokens), Counter(tokens)
    if not n:
        return 0.0, 0.0, 0.0
    return word_chars / n, sum(is_byte(t) for t in tokens) / n, -sum(c / n * math.log2(c / n) for c in counts.values())


def quantile(values, p):
    """The least value with a share of at least p at or below it."""
    v = sorted(values)
    return v[max(0, math.ceil(p * len(v) - 1e-9) - 1)]


def bands(rows, spread, width=5.0, prior=30.0):
    """[(lang, size class, measures)] -> {(lang, size class): [(lo, hi)]}."""
    def of(some):
        return len(some), [[quantile([m[j] for *_, m in some], p) for p in (0.1, 0.5, 0.9)] for j in range(len(spread))]

    out, (_, every) = {}, of(rows)
    for lang, size in {r[:2] for r in rows}:
        k, whole = of([r for r in rows if r[0] == lang])
        n, fine = of([r for r in rows if r[:2] == (lang, size)])
        held = []
        for j, least in enumerate(spread):
            q = [(n * fine[j][i] + prior * (k * whole[j][i] + prior * every[j][i]) / (k + prior)) / (n + prior) for i in range(3)]
            w = width * max((q[2] - q[0]) / 2.563, least)
            held.append((q[1] - w, q[1] + w))
        out[lang, size] = held
    return out


def isotonic(y, n):
    """Non-decreasing weighted fit: at each place the largest over starts before of the least mean up to an end after."""
    mean = lambda a, b: sum(y[a : b + 1]) / sum(n[a : b + 1])
    return [max(min(mean(a, b) for b in range(i, len(y))) for a in range(i + 1)) for i in range(len(y))]
