"""A small table with every odd case, and brute-force versions of the operators."""

from __future__ import annotations

import random
import re

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, score double, rate double, fp long, key string, n long, "
    "digest string, kept boolean, component_id long, mix_copy int, doc long, lines string, keep_id long, perspective string, lost_id long"
)
EXTRA = (0.5, 2.0, 7, "k", 3, "d", True, 9, 1, 4, "l", 5, "p", 6)


def odd_documents(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 8)))
    base = " ".join(word() for _ in range(300))
    common = "A shared line that many documents hold."
    texts = [
        (1, base), (2, base), (3, base.upper()), (4, base.replace("a", "A", 5)), (5, base + " tail"),
        (6, None), (7, ""), (8, "  \n\t \n"), (None, "no id"), (None, None), (9, "twice"), (9, "twice"), (9, "same id, other text"),
        (10, "É é Ä x"), (11, "x " * 40_000), (12, "<|endoftext|> end"), (13, "\U0001f600 你好 " * 50), (14, "a" * 5000),
    ]
    texts += [(20 + i, f"{common}\n{word()} {i}\n\t{common.upper()} \n{word()}\r") for i in range(12)]
    texts += [(40 + i, " ".join(word() for _ in range(rng.randrange(1, 60)))) for i in range(20)]
    return [(d, t, "en", None if d == 7 else f"s{(d or 0) % 3}", None, *EXTRA) for d, t in texts]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def lower(text: str) -> str:
    return text.translate({c: c + 32 for c in range(65, 91)})


def line_dedup(rows, min_docs):
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    docs = [(d, (t or "").split("\n")) for d, t in rows]
    seen: dict[str, int] = {}
    for _, lines in docs:
        for k in {key(x) for x in lines} - {""}:
            seen[k] = seen.get(k, 0) + 1
    out = []
    for d, lines in docs:
        kept = [x for x in lines if seen.get(key(x), 0) < min_docs]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def repeats(texts: list[str], depth: int) -> list[tuple[bytes, list[tuple[int, int]]]]:
    seen: set[bytes] = set()
    out = []
    for text in texts:
        raw = text.encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - depth + 1):
            w = raw[i : i + depth]
            if w in seen:
                gone[i : i + depth] = b"\1" * depth
            seen.add(w)
        spans = [m.span() for m in re.finditer(b"\1+", bytes(gone))]
        out.append((bytes(b for b, g in zip(raw, gone) if not g), spans))
    return out


def components(codes: dict, max_bits: int) -> dict:
    return linked(codes, lambda a, b: (a ^ b).bit_count() <= max_bits)


def linked(items: dict, link) -> dict:
    """The smallest key that each key reaches by links."""
    ids = sorted(items)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[:n]:
            if link(items[a], items[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}
