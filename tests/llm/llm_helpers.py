"""Small corpora with every awkward case, and plain versions to compare with."""

import random
import re

import numpy as np

WORDS = "the old mill by a river turns slowly while grey water runs under its wheel and birds sing".split()


def corpus(seed: int, count: int) -> list[tuple]:
    """(doc_id, text, lang, source, n_chars): prose, exact and near copies, shared passages, blanks, nulls."""
    rnd = random.Random(seed)

    def line(n):
        return " ".join(f"{rnd.choice(WORDS)}{rnd.randrange(60)}" for _ in range(n)).capitalize() + "."

    passage = "\n".join(line(12) for _ in range(6))
    base = line(80)
    texts = []
    for i in range(count):
        kind = rnd.randrange(8)
        if kind == 0 and texts:
            texts.append(rnd.choice(texts))
        elif kind == 1:
            words = base.split()
            for _ in range(rnd.randrange(6)):
                words[rnd.randrange(len(words))] = f"x{rnd.randrange(999)}"
            texts.append(" ".join(words))
        elif kind == 2:
            texts.append(line(rnd.randrange(3, 30)) + "\n" + passage + "\n" + line(9))
        else:
            texts.append("\n".join(line(rnd.randrange(1, 25)) for _ in range(rnd.randrange(1, 9))))
    texts += ["", None, "   ", "one", "a b c", "\n\n\n", "a  b\t c\r\n", "12 34 !?", " leading and trailing "]
    rows = [(i * 3 + 1, t, "en" if i % 5 else None, f"s{i % 3}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]
    rnd.shuffle(rows)
    return rows


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def components(ids, links):
    parent = {i: i for i in ids}

    def root(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def shingle_set(text, size=5):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", low) if w]
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def near_components(rows, num, den):
    """Component by id of (id, text) rows linked where den * common >= num * union."""
    sets = {i: shingle_set(t) for i, t in rows}
    ids = sorted(sets)
    links = [
        (a, b) for k, a in enumerate(ids) for b in ids[k + 1 :]
        if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])
    ]
    return components(ids, links), {i: len(s) for i, s in sets.items()}


def unit_rows(seed, count, dim=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(count // 6, dim))
    return centres[rng.integers(0, len(centres), count)] + 0.12 * rng.normal(size=(count, dim))
