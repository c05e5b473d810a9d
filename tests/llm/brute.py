"""Plain versions of the corpus operators: whole tables as lists of (doc_id, text), no Spark."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import xxhash
from tokenizers import Tokenizer

BLANK = "\x20\x09\x0a\x0b\x0c\x0d"
LAST = 2**63 - 1


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def number(doc_id):
    return LAST if doc_id is None else doc_id


def lines(rows):
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANK))
    first = {}
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            k = key(line)
            if len(k) >= 10:
                first[k] = min(first.get(k, LAST), number(doc_id))
    out = []
    for doc_id, text in rows:
        own = (text or "").split("\n")
        kept = [x for x in own if first.get(key(x), number(doc_id)) == number(doc_id)]
        out.append((doc_id, len(own), len(own) - len(kept), "\n".join(kept)))
    return out


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def windows(rows, width=35):
    count = Counter()
    for _, text in rows:
        w = words(text)
        count.update(tuple(w[i : i + width]) for i in range(len(w) - width + 1))
    out = []
    for doc_id, text in rows:
        w = words(text)
        gone = set()
        for i in range(len(w) - width + 1):
            if count[tuple(w[i : i + width])] > 1:
                gone.update(range(i, i + width))
        out.append((doc_id, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def fingerprint(text):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    parts = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(rows, limit=2):
    prints = [fingerprint(t) for _, t in rows]
    nodes = sorted(set(prints))
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if (a ^ b).bit_count() <= limit:
                parent[root(a)] = root(b)
    lowest = defaultdict(lambda: None)
    for (doc_id, _), p in zip(rows, prints):
        r = root(p)
        if doc_id is not None and (lowest[r] is None or doc_id < lowest[r]):
            lowest[r] = doc_id
    return [(doc_id, f"{p:016x}", lowest[root(p)]) for (doc_id, _), p in zip(rows, prints)]


def jaccard_groups(texts, size=5, share=0.8):
    """The number of the first text of each text's group: sets of word shingles of this share are linked."""
    sets = []
    for text in texts:
        w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) >= share * len(a | b) - 1e-9:
                low, high = sorted((find(i), find(j)))
                root[high] = low
    return [find(i) for i in range(len(sets))]


def paragraphs(text):
    return Counter(p for p in re.split(r"\n|(?<=[.!?])[ \t]+", text or "") if p)


def likeness(a, b):
    a, b = paragraphs(a), paragraphs(b)
    total = sum((a | b).values())
    return sum((a & b).values()) / total if total else 1.0


def tokens(text):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer.encode_special_tokens = True
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
