"""Brute-force versions."""

import collections
import hashlib
import re

ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def joined(spans):
    return ",".join(f"{kind}:{start}:{end}" for start, _, end, kind in sorted(spans))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def luhn(digits):
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def pii(text):
    spans = [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(part) <= 255 for part in m[0].split(".")):
            spans.append((m.start(), 1, m.end(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            spans.append((m.start(), 2, m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            spans.append((m.start(), 3, m.end(), "phone"))
    return spans


def secrets(text):
    spans = [(m.start(), 0, m.end(), "assign") for m in re.finditer(ASSIGN, text, re.I | re.A) if len(m[2]) >= 8]
    spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return spans + [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]


def ngrams(text, size):
    found = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if len(found) < size:
        return {tuple(found)} if found else set()
    return {tuple(found[i : i + size]) for i in range(len(found) - size + 1)}


def similar_groups(docs, size, p, q):
    """Rows (doc_id, set size, smallest doc_id of the component), counted."""
    sets = [ngrams(text, size) for _, text in docs]
    parent = list(range(len(docs)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders, equal = collections.defaultdict(list), collections.defaultdict(list)
    for i, own in enumerate(sets):
        if own:
            equal[frozenset(own)].append(i)
    for rows in equal.values():
        for row in rows:
            parent[top(row)] = top(rows[0])
        counts = collections.Counter(j for gram in sets[rows[0]] for j in holders[gram])
        for j, n in counts.items():
            if q * n >= p * (len(sets[rows[0]]) + len(sets[j]) - n):
                parent[top(rows[0])] = top(j)
        for gram in sets[rows[0]]:
            holders[gram].append(rows[0])
    members = collections.defaultdict(list)
    for i, (doc_id, _) in enumerate(docs):
        members[top(i)].append(doc_id)
    out = collections.Counter()
    for i, (doc_id, _) in enumerate(docs):
        reached = [x for x in members[top(i)] if x is not None] if sets[i] else [doc_id]
        out[doc_id, len(sets[i]), min(reached, default=None)] += 1
    return out


def without_repeats(texts, length):
    """Each text's bytes that no string of the length covers which starts elsewhere too."""
    seen = collections.Counter(text[i : i + length] for text in texts for i in range(len(text) - length + 1))
    kept = []
    for text in texts:
        gone = bytearray(len(text))
        for i in range(len(text) - length + 1):
            if seen[text[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept.append(bytes(c for c, g in zip(text, gone, strict=True) if not g))
    return kept


def repeated_lines(docs, least):
    """Numbers of the lines, by row, that lie in a run of enough words which an earlier place has."""
    seen, out = set(), {}
    for doc_id, text in sorted(set(docs), key=lambda row: (row[0] is not None, row[0] or 0)):
        lines = [(i, line.strip()) for i, line in enumerate((text or "").split("\n")) if line.strip()]
        gone = set()
        for a in range(len(lines)):
            for b in range(a, len(lines)):
                run = tuple(line for _, line in lines[a : b + 1])
                if sum(len(line.split()) for line in run) >= least:
                    if run in seen:
                        gone.update(i for i, _ in lines[a : b + 1])
                    seen.add(run)
        out[doc_id, text] = gone
    return out


def tiled_words(item, doc, least):
    """Words of the item that greedy string tiles cover."""
    in_item, in_doc, total = [False] * len(item), [False] * len(doc), 0
    while True:
        longest, matches = least, []
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and not in_item[i + n] and not in_doc[j + n]:
                    n += 1
                if n > longest:
                    longest, matches = n, []
                if n == longest:
                    matches.append((i, j))
        for i, j in matches:
            if not any(in_item[i : i + longest]) and not any(in_doc[j : j + longest]):
                in_item[i : i + longest] = in_doc[j : j + longest] = [True] * longest
                total += longest
        if not matches or longest == least:
            return total
