"""Plain versions of the operators' contracts, and a table of awkward documents."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BLANK = re.compile(r"[\x20\x09-\x0D]")
COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, print int, copies int, score double, key string"


def words(seed, n, letters="abcdefgh"):
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choices(letters, k=rnd.randint(1, 7))) for _ in range(n))


def awkward():
    """Nulls, empty and very long texts, repeated rows, ties, shared passages, odd characters."""
    passage, long_ = words(1, 150), words(2, 30_000)
    texts = [
        (1, words(3, 50) + " " + passage, "a"),
        (2, passage + " " + words(4, 60), "a"),
        (2, passage + " " + words(4, 60), "a"),
        (3, None, "a"),
        (4, "", None),
        (5, " \t\n", None),
        (6, long_, "b"),
        (7, long_ + " tail", "b"),
        (8, long_[1000:9000] + passage, "b"),
        (9, "A  B c\td", "c"),
        (10, "ABcd", "c"),
        (11, "abcd", "c"),
        (12, "x" * 1500, "c"),
        (13, "ab" * 700, None),
        (14, "ÄÖ ſ 漢字 😀 don't 's Σας İ" * 20, "d"),
        (15, "ÄÖ ſ 漢字 😀 don't 's Σας İ" * 20, "e"),
        (None, words(5, 120), None),
        (None, words(6, 80), None),
        (18, "one two three four five six seven", "a"),
        (19, "one two three four five six seven eight", "a"),
    ]
    texts += [(100 + i, words(40, 90) + f" end{i}", "hot") for i in range(40)]
    texts += [(200 + i, words(41, 70), "hot") for i in range(30)]
    return [(d, t, "en", s, len(t or ""), 1, 2, 3, 0.5, "k") for d, t, s in texts]


def repeated_bytes(texts, length):
    """For each text (bytes) the removed spans."""
    count = Counter(hashlib.md5(t[i : i + length]).digest() for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        spans = []
        for i in range(len(t) - length + 1):
            if count[hashlib.md5(t[i : i + length]).digest()] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + length
                else:
                    spans.append([i, i + length])
        out.append([tuple(s) for s in spans])
    return out


def simhash(text, n=4, seed=42, turn=0):
    found = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(found[i : i + n]) for i in range(max(1, len(found) - n + 1))] if found else []
    value = 0
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed) for s in shingles]
    if turn:
        mix, most = 0xBF58476D1CE4E5B9, 1 << 64
        hashes = [(h + turn * mix) % most for h in hashes]
        hashes = [(h ^ h >> 30) * mix % most for h in hashes]
        hashes = [h ^ h >> 31 for h in hashes]
    for bit in range(64):
        if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes):
            value |= 1 << bit
    return value


def linked_turns(p, q, bits, triples):
    """Do two tuples of fingerprints link: few differing bits in all, 4 equal bytes, among them one of the triples?"""
    if sum((x ^ y).bit_count() for x, y in zip(p, q)) > bits:
        return False
    alike = {8 * t + b for t, (x, y) in enumerate(zip(p, q)) for b in range(8) if not (x ^ y) >> 8 * b & 255}
    return len(alike) >= 4 and any(alike.issuperset(t) for t in triples)


def classes(ids, prints, bits=4, triples=None):
    """Smallest id reachable over links of fingerprints; tuples of them, one a turn, link over `triples` or where the first are equal."""
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first = {}
    for i, p in enumerate(prints):
        parent[root(i)] = root(first.setdefault(p, i))
    distinct = list(first)
    for i, p in enumerate(distinct):
        for q in distinct[:i]:
            if triples is None:
                near = (p ^ q).bit_count() <= bits
            else:
                near = p[0] == q[0] or linked_turns(p, q, bits, triples)
            if near:
                parent[root(first[p])] = root(first[q])
    least = defaultdict(lambda: None)
    for i, d in enumerate(ids):
        r = root(i)
        if d is not None and (least[r] is None or d < least[r]):
            least[r] = d
    return [least[root(i)] for i in range(len(ids))]


def exact(rows):
    """(doc_id, text) -> sorted (doc_id, keep_id, group_size, kept, sha)."""
    groups = defaultdict(list)
    for d, t in rows:
        groups[BLANK.sub("", t or "")].append((-len(t or ""), d is not None, d or 0, d))
    out = []
    for d, t in rows:
        plain = BLANK.sub("", t or "")
        keep = min(groups[plain])[3]
        out.append((d, keep, len(groups[plain]), d == keep, hashlib.sha256(plain.encode()).hexdigest()))
    return out


def edited(rows):
    """(doc_id, text) with distinct ids -> {doc_id: (n_chars, edited text)}."""
    order = sorted(rows, key=lambda r: r[0], reverse=True)
    out = {}
    for i, (d, t) in enumerate(order):
        t, after = t or "", order[(i + 1) % len(order)][1] or ""
        third = len(t) // 3
        out[d] = len(t), t[: len(t) - third] + after[:third]
    return out


def targets(sizes, weights=(5, 2, 1), most=3):
    """{source: size} -> {source: target}, by repeated capping."""
    names = sorted(sizes, key=lambda s: (s is None, [ord(c) for c in s or ""]))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped, total = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in capped]
        left, share = total - sum(capped.values()), sum(weight[s] for s in free)
        goal = {s: left * weight[s] / share for s in free}
        over = [s for s in free if goal[s] > most * sizes[s]]
        if not over:
            return goal | capped
        capped |= {s: most * sizes[s] for s in over}


def url(value, rules, default):
    host = path = ""
    if value and "://" in value:
        rest = value.split("://", 1)[1]
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    best = None
    for verdict, rule in rules:
        name, _, tail = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + tail):
            if best is None or len(rule) > len(best[1]):
                best = verdict, rule
    return host, path, best and best[1], best[0] if best else default


def held(doc_id, parts, out):
    return zlib.crc32(str(doc_id).encode()) % parts == out


def aligned(texts):
    """For each text: n_a, n_b, n_groups, n_links, n_best, count_sum, groups; token by token."""
    import public_tokenizers
    import sentencepiece
    import tokenizers

    a_path, b_path = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    left = tokenizers.Tokenizer.from_file(a_path)
    left.encode_special_tokens = True
    right = sentencepiece.SentencePieceProcessor(model_file=b_path)
    shown = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or c >= 174]
    hidden = [c for c in range(256) if c not in shown]
    letter = {chr(c): c for c in shown} | {chr(256 + i): c for i, c in enumerate(hidden)}

    def piece(i):
        p = right.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if right.is_byte(i) else p.replace("\u2581", " ").encode()

    links, out = [], []
    for text in texts:
        a = left.encode(" " + text, add_special_tokens=False).ids if text else []
        b = right.encode(text) if text else []
        a_bytes = [bytes(letter[c] for c in left.id_to_token(i)) for i in a]
        b_bytes = [piece(i) for i in b]
        if not text or b"".join(a_bytes) != (" " + text).encode() or b"".join(b_bytes) != (" " + text).encode():
            a, b, a_bytes, b_bytes = [], [], [], []
        spans = []
        for parts in (a_bytes, b_bytes):
            at, found = 0, []
            for p in parts:
                found.append((at, at + len(p)))
                at += len(p)
            spans.append(found)
        ends = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, at = [], [0, 0]
        for end in ends:
            ids = []
            for side, x in enumerate((a, b)):
                begin = at[side]
                while at[side] < len(x) and spans[side][at[side]][1] <= end:
                    at[side] += 1
                ids.append(",".join(map(str, x[begin : at[side]])))
            groups.append("|".join(ids))
        own, first = [], 0
        for i, (s, e) in zip(a, spans[0]):
            while first < len(b) and spans[1][first][1] <= s:
                first += 1
            k = first
            while k < len(b) and spans[1][k][0] < e:
                own.append((i, b[k]))
                k += 1
        links.append(own)
        out.append([len(a), len(b), len(groups), len(own), ";".join(groups)])
    count = Counter(pair for own in links for pair in own)
    highest = {}
    for (_, i), n in count.items():
        highest[i] = max(highest.get(i, 0), n)
    rows = []
    for (a, b, groups, n, shown_), own in zip(out, links):
        rows.append((a, b, groups, n, sum(count[p] == highest[p[1]] for p in own), sum(count[p] for p in own), shown_))
    return rows, count


def quality(docs, labels, per_class, max_chars, dictionary_bytes, block, damp):
    """{doc_id: score} of (doc_id, text) and (doc_id, quality) rows with distinct ids, without Spark and without the library.

    The rows of a class with the smallest XXH64 of their ids teach, every other one for the dictionaries, the rest for the curve.
    """
    import math
    import struct

    import xxhash
    import zstandard

    def place(d):
        h = xxhash.xxh64_intdigest(struct.pack("<q", d), 42)
        return h - 2**64 if h >= 2**63 else h

    texts, classes = dict(docs), {0: [], 1: []}
    for d, mark in labels:
        if mark is not None and d in texts and not held(d, 4, 2) and texts[d] and len(texts[d]) <= max_chars:
            classes[mark].append(d)
    chosen = {m: sorted(texts[d].encode() for d in sorted(ds, key=place)[:per_class]) for m, ds in classes.items()}

    def cut_up(t):
        return [t[i : i + block] for i in range(0, len(t), block)]

    def compressor(samples):
        trained = zstandard.train_dictionary(dictionary_bytes, [b for t in samples for b in cut_up(t)])
        return zstandard.ZstdCompressor(level=3, dict_data=trained, write_content_size=False, write_checksum=False, write_dict_id=False)

    good, bad = compressor(chosen[1][0::2]), compressor(chosen[0][0::2])

    def feature(t):
        return (sum(len(bad.compress(b)) for b in cut_up(t)) - sum(len(good.compress(b)) for b in cut_up(t))) / (len(t) + damp)

    points = [(feature(t), m) for m in (0, 1) for t in chosen[m][1::2]]
    a = b = 0.0
    for _ in range(200):  # Newton on the logistic loss with a small ridge
        ga, gb, haa, hab, hbb = 1e-3 * a, 1e-3 * b, 1e-3, 0.0, 1e-3
        for x, y in points:
            p = 1 / (1 + math.exp(-(a + b * x)))
            ga, gb = ga + p - y, gb + (p - y) * x
            haa, hab, hbb = haa + p * (1 - p), hab + p * (1 - p) * x, hbb + p * (1 - p) * x * x
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        scale = min(1.0, 5 / max(abs(da), abs(db), 1e-12))
        a, b = a - scale * da, b - scale * db
    return {d: 1 / (1 + math.exp(-(a + b * (feature(t.encode()) if t else 0.0)))) for d, t in docs}
