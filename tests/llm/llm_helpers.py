"""Rows and brute-force forms that the tests share."""

import re

import public_tokenizers

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
WORDS = "the quick brown fox jumps over a lazy dog while seven other animals look on from the far side of some river".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def edge_rows() -> list[tuple]:
    """Nulls in every column, empty and blank texts, repeated rows, copies, a very long text and ties."""
    story = " ".join(WORDS)
    long = " ".join(f"word{i % 5000}" for i in range(60_000))
    rows = [
        (None, story, "en", "a", 1), (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 3),
        (4, long, "en", "hot", len(long)), (5, story, "en", "hot", 5), (5, story, "en", "hot", 5), (6, story.upper(), "en", "hot", 5),
        (7, story + " again", "en", "hot", 5), (8, "two words", "en", "b", 9), (9, "Two WORDS", "en", "b", 9),
        (10, "  leading and   runs\r\n of   white space ", None, "b", 9), (11, "<|endoftext|> ünïcödé 日本語 é \U0001f600", "xx", "b", 9),
    ]
    return [(*r[:4], r[4]) for r in rows]


def ascii_lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def groups_of(links: list[tuple], nodes: list) -> dict:
    """Smallest member of each node's component."""
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def jaccard_links(rows: list[tuple], k: int, percent: int) -> tuple[dict, list[tuple]]:
    """Shingle sets by row number, and the linked pairs of row numbers, by comparing all."""
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    ids = list(sets)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[:n]
             if sets[a] and sets[b] and 100 * min(len(sets[a]), len(sets[b])) >= percent * max(len(sets[a]), len(sets[b]))
             and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return sets, links
