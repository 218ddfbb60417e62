"""What the operators have to find, said as plainly as possible, for small inputs."""

import hashlib
import re
import zlib
from collections import Counter
from functools import lru_cache
from itertools import combinations

import numpy as np
import xxhash

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def order_of(doc_id):
    """Null ids come first."""
    return (doc_id is not None, doc_id or 0)


def substrings(docs):
    """(doc_id, n_words, n_removed, kept) of (doc_id, text) rows."""
    words = [(i, SPACED.findall(t or "")) for i, t in docs]
    first = {}
    for i, w in words:
        for s in range(len(w) - 19):
            at = (order_of(i), s)
            key = tuple(w[s : s + 20])
            first[key] = min(first.get(key, at), at)
    gone = {}
    for i, w in words:
        for s in range(len(w) - 19):
            if first[tuple(w[s : s + 20])] < (order_of(i), s):
                gone.setdefault(i, set()).update(range(s, s + 20))
    out = []
    for i, w in words:
        kept = [x for p, x in enumerate(w) if p not in gone.get(i, ())]
        out.append((i, len(w), len(w) - len(kept), " ".join(kept)))
    return out


def contaminated(docs, items, window=10):
    """(doc_id, n_words, n_hit, sorted item ids) of every row."""
    windows = {}
    for item, text in items:
        w = ALNUM.findall((text or "").translate(LOWER))
        for s in range(len(w) - window + 1) if len(w) >= window else range(1 if w else 0):
            windows.setdefault(tuple(w[s : s + window]), set()).add(item)
    sizes = {len(k) for k in windows}
    out = []
    for i, text in docs:
        w = ALNUM.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    hit.update(range(s, s + n))
                    found |= windows[tuple(w[s : s + n])]
        out.append((i, len(w), len(hit), sorted(x for x in found if x is not None)))
    return out


def lines(docs, least=10):
    """(doc_id, n_lines, n_dropped, kept) of every row."""

    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)

    holders = {}
    for i, text in docs:
        for line in (text or "").split("\n"):
            holders.setdefault(key(line), set()).add(i)
    out = []
    for i, text in docs:
        own = (text or "").split("\n")
        kept = []
        for line in own:
            k = key(line)
            if len(k) < least or len(holders[k]) < 2 or i == min(holders[k], key=order_of):
                kept.append(line)
        out.append((i, len(own), len(own) - len(kept), "\n".join(kept)))
    return out


def simhash(text, words=4):
    w = SPACED.findall((text or "").translate(LOWER))
    grams = [" ".join(w[s : s + words]) for s in range(len(w) - words + 1)] if len(w) >= words else [" ".join(w)] * bool(w)
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(values, bits=4):
    """The component of each value, as its smallest member."""
    values = sorted(set(values))
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    for a, b in combinations(values, 2):
        if (a ^ b).bit_count() <= bits:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {v: find(v) for v in values}


def near_duplicates(docs):
    """(doc_id, fingerprint, component_id) of every row."""
    prints = [(i, simhash(t)) for i, t in docs]
    part = components([p for _, p in prints])
    least = {}
    for i, p in prints:
        if i is not None:
            least[part[p]] = min(least.get(part[p], i), i)
    return [(i, format(p, "016x"), least.get(part[p])) for i, p in prints]


def base_scores(docs):
    """(doc_id, n_tokens, n_known, train_tokens, base_score) of every row."""
    tokens = [(i, [*SPACED.findall((t or "").translate(LOWER)), ""]) for i, t in docs]
    counts = Counter()
    for i, w in tokens:
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(w)
    total = sum(counts.values())
    return [
        (i, len(w), sum(counts[x] > 0 for x in w), total, float(sum(np.log10((counts[x] + 1) / (total + len(counts) + 1)) for x in w)))
        for i, w in tokens
    ]


def edited(docs):
    """(doc_id, edited text) of rows with distinct ids."""
    ordered = sorted(docs, key=lambda r: order_of(r[0]), reverse=True)
    out = []
    for n, (i, text) in enumerate(ordered):
        text, following = text or "", ordered[(n + 1) % len(ordered)][1] or ""
        half = len(text) // 2
        out.append((i, text[: len(text) - half] + following[:half]))
    return out


def minhash(text, piece=8, run=4, bins=32, least=2):
    """The bins that order MinHash fills, each with its k-mers (places) in text order: which of them, not their hashes."""
    pieces = re.findall(rf"[^\x20\x09-\x0D]{{1,{piece}}}", text)
    grams = [tuple(pieces[s : s + run]) for s in range(len(pieces) - run + 1)] if len(pieces) >= run else [tuple(pieces)] * bool(pieces)
    seen, out = Counter(), []
    for g in grams:
        out.append((g, seen[g]))
        seen[g] += 1
    return out


def damaged(rows):
    """(conv_id, turn, role, text) rows behind the damage, and all ids."""
    out, ids = [], {r[0] for r in rows}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault = zlib.crc32(key.encode()) % 20
        if fault == 1:
            text = ""
        if fault == 2:
            text = re.sub(r"[.!?]", "", text)
        if fault == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(fault, 1)
    return out, ids


def repaired(rows, ids):
    """Counts, cost, audit and repaired text of every conversation, by a table over rows and states."""
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    turn_of = {"": "u", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}
    out = []
    for conv in ids:
        own = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        counts, seen, kinds = Counter(), set(), []
        for turn, role, text in own:
            bare = text.strip(" \t\n\x0b\x0c\r")
            kind = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            counts[kind] += 1
            kinds.append(kind)
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        turns = [r[0] for r in own if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        ways = {"": (0, "", [])}

        def insert(ways):
            for _ in range(3):
                for state, (cost, audit, said) in list(ways.items()):
                    to = turn_of[state]
                    new = (cost + 3, audit + "I", [*said, f"{name[to]}:"])
                    ways[to] = min(ways.get(to, new), new, key=lambda w: w[:2])
            return ways

        for (_, role, text), kind in zip(own, kinds):
            new = {}

            def offer(state, way):
                new[state] = min(new.get(state, way), way, key=lambda w: w[:2])

            for state, (cost, audit, said) in insert(ways).items():
                offer(state, (cost + 4, audit + "D", said))
                if kind in ("blank", "duplicate"):
                    continue
                cost += 3 * (kind == "truncated")
                if role[:1] in after[state]:
                    offer(after[state][role[:1]], (cost, audit + "K", [*said, f"{role}:{text}"]))
                to = turn_of[state]
                offer(to, (cost + 3, audit + "R", [*said, f"{name[to]}:{text}"]))
            ways = new
        cost, audit, said = min((w for s, w in insert(ways).items() if s in ("", "a")), key=lambda w: w[:2])
        out.append((conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, sha("\n".join(said))))
    return out


@lru_cache
def byte_bpe_library():
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def byte_bpe(text):
    """(n_tokens, ids_sha256, decoded_sha256) by the library."""
    ids = byte_bpe_library().encode_ordinary(text or "")
    data = np.array(ids, "<u4").tobytes()
    return len(ids), hashlib.sha256(data).hexdigest(), hashlib.sha256(byte_bpe_library().decode_bytes(ids)).hexdigest()


def divergence(docs, least=30, top=50):
    """(lang, source, part, item, value, rank) of (text, lang, source) rows."""
    letters = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    counts, held, groups = {}, Counter(), set()
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        terms = letters.findall((text or "").translate(LOWER))
        groups.add((lang, source))
        counts.setdefault((lang, source), Counter()).update(terms)
        held.update((lang, t) for t in set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        terms = sorted(t for (l, t), n in held.items() if l == lang and n >= least)
        own = {s: counts[l, s] for l, s in groups if l == lang}
        own[None] = sum(own.values(), Counter())
        shares = {}
        for source, n in own.items():
            size = sum(n[t] for t in terms) + 5 * len(terms)
            shares[source] = {t: 1 + 10**9 * (n[t] + 5) // size for t in terms}
        for source in own.keys() - {None}:
            pairs = [(o, sum(abs(shares[source][t] - shares[o][t]) for t in terms)) for o in own.keys() - {None, source}]
            apart = [(t, shares[source][t] - shares[None][t]) for t in terms if own[source][t]]
            for part, found in (("pair", pairs), ("term", [x for x in apart if x[1] > 0])):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, source, part, i, v, r) for r, (i, v) in enumerate(found, 1) if part == "pair" or r <= top]
    return out
