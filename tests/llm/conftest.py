from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PAGES = "page_id long, url string, html string"
LABELS = "doc_id long, quality int, toxic int"
BENCHMARK = "item_id long, text string"
CONVERSATIONS = "conv_id long, turn long, role string, text string"


@pytest.fixture(scope="session")
def folder(spark, tmp_path_factory):
    """Writes tables as a data folder and returns its path."""

    def write(**tables):
        at = tmp_path_factory.mktemp("data")
        for name, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).write.parquet(f"{at}/{name}.parquet")
        return str(at)

    return write


def hard_documents():
    """Nulls, empty and long texts, ties, repeated rows, near copies and odd characters."""
    import random

    rng = random.Random(8)
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "ou", "ti", "é"]

    def words(n):
        return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(n))

    texts = [None, "", " \n\t", "a", "a b", "日本語 テキスト\u00a0x", words(20_000), "one\ntwo\none\n" * 40]
    texts += [words(rng.randint(60, 400)) for _ in range(60)]
    copy = words(300).split()
    for i in range(12):
        near = list(copy)
        if i % 3:
            near[(i * 25) % 300] = "changed"
        texts.append(" ".join(near))
    texts += [texts[10]] * 5 + [t.upper() + "!!" for t in texts[20:24]] + [" ".join(w + "***" for w in texts[30].split())] * 2
    texts += [texts[i] + " you grumblewort snarkfish " + words(5) + " grumblewort" for i in range(40, 64)]
    rows = [(i * 3, t, "en" if i % 2 else None, None if i % 5 == 0 else "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[12], rows[12], (None, "no id here", None, None, None), (None, None, None, None, None)]
    labels = [(i * 3, 0 if t and ("!!" in t or "***" in t) else 1, int(bool(t) and "grumble" in t)) for i, t in enumerate(texts)]
    return rows, labels + [(None, 1, 1), (10**9, 0, 1), (3, None, None), labels[5]]


def hard_conversations():
    """Nulls, ties, repeated rows, one long conversation, odd roles and marks."""
    import random

    rng = random.Random(4)
    roles = ["user", "assistant", "system", "tool", "User", "", None, "übung"]
    texts = [None, "", " \t\n", "yes.", "no", "well?\n ", "wow!", "日本。", "a.b", ". x", "same", "\x00.", "x" * 3000]
    rows = []
    for conv in range(60):
        length = 700 if conv == 7 else rng.randint(1, 12)
        for turn in range(length):
            role = ("user", "assistant")[turn % 2] if rng.random() < 0.8 else rng.choice(roles)
            text = rng.choice(texts) if rng.random() < 0.5 else f"turn {turn} of {conv}" + rng.choice(["", ".", "?", "!\n"])
            rows.append((conv, rng.choice([turn * 2, turn * 2, turn * 2, None, 5]), role, text))
    rows += rows[:20] + [(None, 0, "user", "hello."), (None, None, None, None), (900, None, "user", "only nulls"), (900, None, "assistant", "here.")]
    return rows


@pytest.fixture(scope="session")
def hard(folder):
    rows, labels = hard_documents()
    benchmark = [(1, rows[40][1]), (2, None), (2, "a b A"), (None, "日本語 the")]
    pages = [
        (1, "http://www.Example.COM/en/1?x#y", "a" * 1200), (2, "https://m.example.com/en/2", "a" * 1200), (3, "http://a.net/es/", "b" * 999), (4, "http://b.net/es/", "b" * 999),
        (5, None, None), (6, "no scheme", ""), (7, "http://", "x"), (8, "http://net/fr/x", "a" * 1200), (9, "http://xcom/", "é" * 600), (10, "ftp://u:p@h.com:80/en?/", "é" * 600),
        (10, "ftp://u:p@h.com:80/en?/", "é" * 600), (None, "http://example.com/EN/", "a" * 1200), (11, "http://example.com", "\x00\r\n\r\n" * 500), (12, "http://a..com//en/", "z" * 3_000_000), (13, "http://example.com/en/a://b", "q"),
        (14, "a\nb://www.example.com/en/", None), (15, "http://www.example.com\n/en/", "b"),
    ]
    return folder(documents=(rows, DOCS), labels=(labels, LABELS), pages=(pages, PAGES), benchmark=(benchmark, BENCHMARK), conversations=(hard_conversations(), CONVERSATIONS))


@pytest.fixture(scope="session")
def empty(folder):
    return folder(documents=([], DOCS), labels=([], LABELS), pages=([], PAGES), benchmark=([], BENCHMARK), conversations=([], CONVERSATIONS))
