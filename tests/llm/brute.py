"""Plain Python versions of the operators' contracts, row by row."""

import hashlib
import re
import zlib

import xxhash

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def alnum_words(text):
    return ALNUM.findall((text or "").translate(LOW))


def secrets(rows):
    kinds = [
        ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 8),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
        ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 32),
    ]
    for doc_id, text in rows:
        spans = [(m.start(), i, m.end()) for i, (_, p, ok) in enumerate(kinds) for m in p.finditer(text or "") if ok(m)]
        spans.sort()
        counts = [sum(s[1] == i for s in spans) for i in range(3)]
        yield (doc_id, *counts, sha(",".join(f"{kinds[i][0]}:{a}:{b}" for a, i, b in spans)))


def licenses(rows):
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    for doc_id, text in rows:
        words, places, labels = alnum_words(text), [], set()
        for phrase, label in phrases.items():
            p = phrase.split()
            for i in range(len(words) - len(p) + 1):
                if words[i : i + len(p)] == p:
                    places.append(i)
                    labels.add(label)
        yield (doc_id, len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))


def repeats(rows, window=13):
    least = {}
    split = [(d, SPACED.findall(t or "")) for d, t in rows]
    for d, words in split:
        for i in range(len(words) - window + 1):
            w, key = tuple(words[i : i + window]), (d is None, d or 0)
            least[w] = min(least.get(w, key), key)
    for d, words in split:
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            if least[tuple(words[i : i + window])] < (d is None, d or 0):
                gone[i : i + window] = [True] * window
        yield (d, len(words), sum(gone), sha(" ".join(w for w, x in zip(words, gone) if not x)))


def edits(rows):
    """doc_id, n_chars, edited_sha256 by contract, for distinct ids."""
    rows = sorted((d, t or "") for d, t in rows)
    for (d, t), (_, following) in zip(rows, rows[1:] + rows[:1]):
        half = len(t) // 2
        yield (d, len(t), sha(t[: len(t) - half] + following[:half]))


def contamination(rows, items, size=13):
    windows = {}
    for item, text in items:
        words = alnum_words(text)
        n = min(size, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            windows.setdefault(tuple(words[i : i + n]), set()).add(str(item))
    lengths = {len(w) for w in windows}
    for d, text in rows:
        words = alnum_words(text)
        hit, found = [False] * len(words), set()
        for n in lengths:
            for i in range(len(words) - n + 1):
                if tuple(words[i : i + n]) in windows:
                    hit[i : i + n] = [True] * n
                    found |= windows[tuple(words[i : i + n])]
        n_hit = sum(hit)
        yield (d, len(words), n_hit, len(found), sha(",".join(sorted(found))), n_hit > 0 and 20 * n_hit >= len(words))


def simhash(text):
    words = SPACED.findall((text or "").translate(LOW))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(rows, radius=4):
    prints = [(d, simhash(t)) for d, t in rows]
    names = sorted({p for _, p in prints})
    root = {p: p for p in names}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                root[top(a)] = top(b)
    least = {}
    for d, p in prints:
        if d is not None:
            least[top(p)] = min(least.get(top(p), d), d)
    return [(d, f"{p:016x}", least.get(top(p))) for d, p in prints]


def tokens(rows, path):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(path)
    coder.no_truncation()
    coder.no_padding()
    for d, text in rows:
        ids = coder.encode(text or "", add_special_tokens=False).ids
        yield (d, len(ids), sha(" ".join(map(str, ids))), sha(coder.decode(ids, skip_special_tokens=False)))


def digests(rows):
    for d, text in rows:
        raw = (text or "").encode()
        yield (d, len(raw) + 16, zlib.crc32(raw))
